"""ROC curves and areas as DataFrame jobs; no score leaves the cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.ranks import VALUES_PER_RANGE, running_counts


def score_label_pairs(predictions: DataFrame, label: str = "label", *keep: str) -> DataFrame:
    """Probability of class 0 and the complement of the label, so class 0 counts as positive."""
    return predictions.select(
        *keep,
        vector_to_array("probability")[0].alias("score"),
        (F.lit(1.0) - F.col(label).cast("double")).alias("label"),
    )


def _running(
    rows: DataFrame, score: str, label: str, by: Sequence[str], values_per_range: int, following: bool = False
) -> DataFrame:
    positive = F.when(F.col(label) == 1, 1).otherwise(0)
    counts = {"pos": positive, "neg": 1 - positive}
    labelled = rows.where(F.col(label).isNotNull())
    return running_counts(labelled, score, counts, by, True, values_per_range, following=following)


def roc_points(
    rows: DataFrame,
    score: str,
    label: str,
    by: Sequence[str] = (),
    values_per_range: int = VALUES_PER_RANGE,
    collinear: bool = True,
) -> DataFrame:
    """One point per distinct score, highest first, and the origin with a null threshold.

    With ``by`` there is one curve per group, all from one pass. Without ``collinear`` points, those
    are left out whose step is that of the next point; the first and the last point always stay.
    """
    running = _running(rows, score, label, by, values_per_range, following=not collinear)
    if not collinear:
        turns = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
        first = F.col("cum_pos") + F.col("cum_neg") == F.col("pos") + F.col("neg")
        running = running.where(first | F.col("next_pos").isNull() | turns)
    point = F.struct(
        F.col(score).alias("threshold"),
        F.col("cum_neg").alias("fp"),
        F.col("cum_pos").alias("tp"),
        F.try_divide("cum_neg", "total_neg").alias("fpr"),
        F.try_divide("cum_pos", "total_pos").alias("tpr"),
    )
    none = F.lit(0).cast("bigint")
    origin = F.struct(
        F.lit(None).cast("double").alias("threshold"),
        none.alias("fp"),
        none.alias("tp"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    is_first = F.col("cum_pos") + F.col("cum_neg") == F.col("pos") + F.col("neg")
    return running.select(
        *by, F.inline(F.when(is_first, F.array(origin, point)).otherwise(F.array(point)))
    )


def trapezoid_area(
    rows: DataFrame,
    score: str,
    label: str,
    by: Sequence[str] = (),
    values_per_range: int = VALUES_PER_RANGE,
) -> DataFrame:
    """Area under the ROC points, a row per group; each point's predecessor is its own counts
    back, so no row needs its neighbour."""
    running = _running(rows, score, label, by, values_per_range)
    strip = F.col("neg").cast("double") * (2 * F.col("cum_pos") - F.col("pos")) / 2
    whole = F.max("total_pos").cast("double") * F.max("total_neg")
    return running.groupBy(*by).agg(F.try_divide(F.sum(strip), whole).alias("auc"))


def area_under_roc(predictions: DataFrame, score: str, label: str) -> float:
    """Spark's own evaluator with every distinct score as a threshold."""
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol=score, labelCol=label, metricName="areaUnderROC", numBins=0
    )
    return evaluator.evaluate(predictions)


def positive_probability(vector: Column | str = "probability") -> Column:
    return vector_to_array(vector)[1]
