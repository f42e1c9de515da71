"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    app: str, cores: str = "*", shuffle_partitions: int = 8, checkpoints: str | None = None
) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder
    if checkpoints:
        builder = builder.config("spark.checkpoint.dir", checkpoints)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Superseded checkpoints of iterative jobs are removed once unreachable.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, or one in the warehouse if unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/ledgerline-checkpoints"


_written: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; ``clear_shared`` removes what was written there."""
    folder = f"{shared_dir(spark)}/ledgerline-{uuid.uuid4().hex}"
    _written.append(folder)
    return f"{folder}/{name}"


def clear_shared(spark: SparkSession) -> None:
    """Remove tables and files that this process has written below the shared folder.

    Frames that read them can't be computed any more, so call it when their results are stored.
    Checkpoints are Spark's to remove (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into reliable storage and cut its lineage."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def settle_columns(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back, which cuts its lineage.

    For tables that many passes read, few columns each: a pass decodes only the columns it uses.
    """
    path = shared_path(df.sparkSession, "columns")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_pieces(df: DataFrame, key: str, pieces: int) -> DataFrame:
    """Settle ``df`` in a fixed number of pieces by the key's hash, each sorted by key.

    What draws by partition, as Spark's forests do, then depends on rows and ``pieces`` only: not
    on cores, and not on the pieces that ``df`` comes in.
    """
    return settle(df.repartition(pieces, key).sortWithinPartitions(key))
