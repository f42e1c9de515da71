"""ROC points and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.evaluate import roc_points, trapezoid_area
from ledgerline.sources import read_table


def _by_quantity(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "lineitem").select(
        "l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("label")
    )


def _by_price(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "lineitem").select(
        "l_extendedprice", (F.col("l_quantity") > 25).cast("int").alias("label")
    )


def auc_exact(spark: SparkSession, folder: str) -> DataFrame:
    area = trapezoid_area(_by_price(spark, folder), "l_extendedprice", "label")
    return area.select(F.round("auc", 9).alias("auc"))


def auc_score_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Label and score turned around: the area is the same."""
    turned = _by_price(spark, folder).select(
        (-F.col("l_extendedprice")).alias("score"), (1 - F.col("label")).alias("label")
    )
    area = trapezoid_area(turned, "score", "label")
    return area.select(F.round("auc", 9).alias("auc"))


def auc_trapezoid(spark: SparkSession, folder: str) -> DataFrame:
    area = trapezoid_area(_by_quantity(spark, folder), "l_quantity", "label")
    return area.select(F.round("auc", 9).alias("auc"))


def _points(rows: DataFrame, score: str, **settings) -> DataFrame:
    points = roc_points(rows, score, "label", **settings)
    return points.withColumns({"fpr": F.round("fpr", 9), "tpr": F.round("tpr", 9)})


def roc_quantity(spark: SparkSession, folder: str) -> DataFrame:
    return _points(_by_quantity(spark, folder), "l_quantity")


def roc_price(spark: SparkSession, folder: str) -> DataFrame:
    return _points(_by_price(spark, folder), "l_extendedprice")


def roc_quantity_corners(spark: SparkSession, folder: str) -> DataFrame:
    return _points(_by_quantity(spark, folder), "l_quantity", collinear=False)


def roc_price_corners(spark: SparkSession, folder: str) -> DataFrame:
    """Small ranges, so that many points have their neighbour in another one."""
    return _points(_by_price(spark, folder), "l_extendedprice", collinear=False, values_per_range=500)


QUERIES = {
    "auc_exact": auc_exact,
    "auc_score_pairs": auc_score_pairs,
    "auc_trapezoid": auc_trapezoid,
    "roc_points": roc_quantity,
    "roc_points_price": roc_price,
    "roc_points_corners": roc_quantity_corners,
    "roc_points_price_corners": roc_price_corners,
}

_RANK_SUM = """
    with places as (
        select label, rank() over (order by score)
                      + (count(*) over (partition by score) - 1) / 2.0 as place
        from ({scores}))
    select round((sum(place) filter (label = 1) - p * (p + 1) / 2.0) / (p * q), 9) as auc
    from places, (select count(*) filter (label = 1) * 1.0 as p,
                         count(*) filter (label = 0) * 1.0 as q from places)
    group by p, q"""

_POINTS = """
    with tallies as (
        select score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg
        from ({scores}) group by score),
    running as (
        select score as threshold,
               cast(sum(neg) over (order by score desc) as bigint) as fp,
               cast(sum(pos) over (order by score desc) as bigint) as tp
        from tallies)
    select threshold, fp, tp, round(fp / (select sum(neg) from tallies), 9) as fpr,
           round(tp / (select sum(pos) from tallies), 9) as tpr
    from running
    union all select null, 0, 0, 0, 0"""

_CORNERS = """
    with tallies as (
        select score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg
        from ({scores}) group by score),
    running as (
        select score as threshold,
               cast(sum(neg) over down as bigint) as fp, cast(sum(pos) over down as bigint) as tp,
               pos - lead(pos) over down as pos_turn, neg - lead(neg) over down as neg_turn,
               lag(score) over down is null as is_first
        from tallies window down as (order by score desc))
    select threshold, fp, tp, round(fp / (select sum(neg) from tallies), 9) as fpr,
           round(tp / (select sum(pos) from tallies), 9) as tpr
    from running where is_first or pos_turn is null or pos_turn <> 0 or neg_turn <> 0
    union all select null, 0, 0, 0, 0"""

_QUANTITY = """
    select l_quantity as score, case when l_returnflag = 'R' then 1 else 0 end as label
    from lineitem"""

_PRICE = """
    select l_extendedprice as score, case when l_quantity > 25 then 1 else 0 end as label
    from lineitem"""

ORACLE = {
    "auc_exact": _RANK_SUM.format(scores=_PRICE),
    "auc_score_pairs": _RANK_SUM.format(scores=_PRICE),
    "auc_trapezoid": _RANK_SUM.format(scores=_QUANTITY),
    "roc_points": _POINTS.format(scores=_QUANTITY),
    "roc_points_price": _POINTS.format(scores=_PRICE),
    "roc_points_corners": _CORNERS.format(scores=_QUANTITY),
    "roc_points_price_corners": _CORNERS.format(scores=_PRICE),
}
