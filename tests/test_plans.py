"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from ledgerline.operators.ranks import percentiles, running_counts

FOLDER = "/root/testdata/sf0.01"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "report_by_three_keys",
        "report_by_segment",
        "boxplot_stats",
        "histogram_price",
        "kde_grid",
        "distribution_shift",
        "impute_group_median",
        "impute_nearest_group",
        "impute_donor_draw",
        "roc_points_price",
        "price_percentiles",
        "assemble_features",
        "naive_bayes_theta",
    ],
)
def test_no_pairing_of_all_rows_and_no_python(spark, name):
    text = plan(queries()[name](spark, FOLDER))
    for operator in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas"):
        assert operator not in text


def test_report_reads_its_columns_and_pushes_its_filter(spark):
    text = plan(queries()["report_by_class"](spark, FOLDER))
    assert "EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<o_orderstatus:string,o_orderpriority:string>" in text
    assert "partial_count" in text


def test_text_is_counted_before_the_join(spark):
    from ledgerline.plans.models import labelled_documents

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(labelled_documents(spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join, above = text.index("SortMergeJoin"), text.index("split(text")
    assert join < above, "the split belongs below the join"


@pytest.fixture
def rows(spark):
    return spark.range(3000).select(
        (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 2999).cast("double").alias("v")
    )


def test_rows_are_not_gathered_by_group(spark, rows):
    """Windows over values are split by range; only the heads are gathered by group."""
    for frame in (
        running_counts(rows, "v", {"n": F.lit(1)}, ["g"], values_per_range=100),
        percentiles(rows, "v", {"mid": 0.5}, ["g"], values_per_range=100),
    ):
        for line in plan(frame).splitlines():
            if "Window [" in line and " v#" in line:
                assert "__range" in line
