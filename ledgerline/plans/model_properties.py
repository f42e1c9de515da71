"""What must hold of fitted models whatever they learn, on the same full work as their queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators.models import coefficients, fit, logistic, objective_history, optimality, positive_probability
from ledgerline.operators.ranks import running_counts
from ledgerline.plans import models
from ledgerline.session import settle

TOLERANCE = 1e-3
#: What slope and penalty of a slot may differ by at the optimum.
VIOLATION = 1e-5


def importances(spark: SparkSession, folder: str) -> DataFrame:
    return models.importances(spark, folder).agg(
        F.count(F.lit(1)).alias("n_slots"),
        F.count_distinct("name").alias("n_names"),
        F.count_if(F.col("importance") < 0).alias("n_negative"),
        F.round(F.sum("importance"), 9).alias("total"),
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Forest, tree and refitted forest: one row per test document, with a fitting prediction."""
    found = {"random_forest": models.forest, "decision_tree": models.tree, "random_forest_top_5": models.selected}
    reports = [
        settle(query(spark, folder)).agg(
            F.lit(name).alias("model"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct("doc_id").alias("n_documents"),
            F.sum("doc_id").alias("sum_doc_id"),
            F.sum("label").alias("n_positive"),
            F.count_if(~F.col("probability").between(0, 1)).alias("n_outside"),
            F.count_if((F.col("probability") > 0.5) != (F.col("prediction") == 1)).alias("n_misplaced"),
        )
        for name, query in found.items()
    ]
    return reduce(DataFrame.unionByName, reports)


def objectives(spark: SparkSession, folder: str) -> DataFrame:
    """The objective starts at the entropy of the training labels and never rises."""
    before = F.lag("objective").over(Window.partitionBy(F.lit(0)).orderBy("iteration"))  # a few rows
    return models.objectives(spark, folder).withColumn("before", before).agg(
        F.round(F.max(F.when(F.col("iteration") == 0, F.col("objective"))), 6).alias("first"),
        (F.max("iteration") + 1 == F.count(F.lit(1))).alias("is_whole"),
        (F.count(F.lit(1)) > 2).alias("has_steps"),
        F.count_if(F.col("objective") > F.col("before")).alias("n_rises"),
    )


def optimum(spark: SparkSession, folder: str) -> DataFrame:
    """One coefficient per slot and the intercept, which no penalty touches: at the optimum the
    mean probability of the training rows is the share of their labels."""
    data = models._data(spark, folder)
    model = fit(logistic(models.LIGHT_PENALTY), data.train)
    found = coefficients(model, data.names).agg(
        F.count_if(F.col("slot") >= 0).alias("n_slots"),
        F.count_if(F.col("slot") == -1).alias("n_intercepts"),
        F.count_distinct("name").alias("n_names"),
    )
    fitted = model.transform(data.train).agg(
        F.round(F.avg("label"), 9).alias("share"),
        (F.abs(F.avg(positive_probability()) - F.avg("label")) < TOLERANCE).alias("is_optimum"),
    )
    return found.crossJoin(fitted)  # one row each


def optimality_of_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Slope and penalty cancel out in every slot, so the coefficients are those of the one optimum."""
    data = models._data(spark, folder)
    model = fit(logistic(models.LIGHT_PENALTY, steps=100), data.train)
    found, _ = optimality(model, data.train, data.names, models.LIGHT_PENALTY, 0.8)
    return found.select(
        "slot",
        F.round("deviation", 6).alias("deviation"),
        (F.col("violation") < VIOLATION).alias("is_optimal"),
        ((F.col("coefficient") == 0) | (F.col("coefficient") * F.col("slope") < 0)).alias("is_downhill"),
    )


def last_objective(spark: SparkSession, folder: str) -> DataFrame:
    """The last objective, computed anew from the rows; the first is that of the intercept alone."""
    data = models._data(spark, folder)
    model = fit(logistic(models.LIGHT_PENALTY), data.train)
    _, objective = optimality(model, data.train, data.names, models.LIGHT_PENALTY, 0.8)
    history = objective_history(model).agg(F.max_by("objective", "iteration").alias("last"), F.min_by("objective", "iteration").alias("first"))
    share = data.train.agg(F.avg("label").alias("p"))
    entropy = -F.col("p") * F.log("p") - (1 - F.col("p")) * F.log(1 - F.col("p"))
    return history.crossJoin(share).select(  # one row each
        F.round("first", 6).alias("first"),
        (F.abs(F.col("last") - objective) < 1e-9).alias("is_last"),
        (F.col("last") < entropy).alias("is_better"),
    )


def curves(spark: SparkSession, folder: str) -> DataFrame:
    """Each model's curve runs from the origin to all rows and never goes back."""
    earlier = Window.partitionBy("model").orderBy("fp", "tp")  # a curve of the test documents
    points = models.curves(spark, folder).withColumn("threshold_before", F.lag("threshold").over(earlier))
    return points.groupBy("model").agg(
        F.count_if(F.col("threshold").isNull()).alias("n_origins"),
        F.count_if(F.col("threshold") >= F.col("threshold_before")).alias("n_back"),
        F.max("fp").alias("n_negative"),
        F.max("tp").alias("n_positive"),
        F.max("fpr").alias("last_fpr"),
        F.max("tpr").alias("last_tpr"),
    )


def _compared(found: DataFrame, scored: DataFrame) -> DataFrame:
    """How many areas differ from the rank sums of the models' scores, ranked anew."""

    def rank_sum(score: str, name: str) -> DataFrame:
        """Ranks come from counts of equal scores, added up range by range: no task holds a model's rows."""
        counts = {"n": F.lit(1), "pos": F.col("label")}
        placed = running_counts(scored, score, counts, ["model"])
        twice = F.sum(F.col("pos") * (2 * F.col("cum_n") - F.col("n") + 1))  # ties share their mean place
        p, q = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
        return placed.groupBy("model").agg(((twice / 2 - p * (p + 1) / 2) / (p * q)).alias(name))

    ranked = rank_sum("probability", "by_probability").join(rank_sum("raw", "by_raw"), "model")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-9
    return found.join(ranked, "model").select(
        "model", "n_features", near("auc", "by_probability").alias("is_area"), near("auc_raw", "by_raw").alias("is_raw_area")
    )


def comparison(spark: SparkSession, folder: str) -> DataFrame:
    return _compared(*models.compared_documents(spark, folder))


def line_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return _compared(*models.compared_lines(spark, folder))


QUERIES = {
    "feature_importance_properties": importances,
    "model_score_properties": scores,
    "objective_history_properties": objectives,
    "logistic_coefficients_properties": optimum,
    "logistic_optimality": optimality_of_slots,
    "objective_recomputed": last_objective,
    "model_roc_properties": curves,
    "model_comparison_properties": comparison,
    "model_comparison_lines_properties": line_comparison,
}

_DOCS = """
    with docs as (
        select doc_id, lang, source, quality,
               ('0x' || substr(md5(doc_id || ':42'), 1, 8))::bigint % 10 < 7 as is_train
        from documents join labels using (doc_id)),
    classes as (
        select quality, row_number() over (order by count(*) desc, quality) - 1 as label
        from docs group by quality),
    rows_ as (select doc_id, lang, source, label, is_train from docs join classes using (quality)),
    slots as (
        select 2 + count(distinct lang) + count(distinct source) as n_slots from rows_ where is_train),
    shares as (select avg(label) as p from rows_ where is_train),
    test as (select * from rows_ where not is_train)"""

_MODELS = "(select unnest([{}]) as model)"


def _named(*names: str) -> str:
    return _MODELS.format(", ".join(f"'{n}'" for n in names))


ORACLE = {
    "feature_importance_properties": f"""
        {_DOCS}
        select n_slots, n_slots as n_names, 0::bigint as n_negative, 1.0::double as total from slots""",
    "model_score_properties": f"""
        {_DOCS}
        select model, count(*) as n_rows, count(distinct doc_id) as n_documents,
               cast(sum(doc_id) as bigint) as sum_doc_id, cast(sum(label) as double) as n_positive,
               0::bigint as n_outside, 0::bigint as n_misplaced
        from test, {_named("random_forest", "decision_tree", "random_forest_top_5")} group by model""",
    "objective_history_properties": f"""
        {_DOCS}
        select round(-p * ln(p) - (1 - p) * ln(1 - p), 6) as first, true as is_whole,
               true as has_steps, 0::bigint as n_rises
        from shares""",
    "logistic_coefficients_properties": f"""
        {_DOCS}
        select n_slots, 1::bigint as n_intercepts, n_slots + 1 as n_names, round(p, 9) as share,
               true as is_optimum
        from slots, shares""",
    "logistic_optimality": f"""
        {models._LONG}
        select cast(slot as integer) as slot,
               round(sqrt((sum(x * x) - sum(x) * sum(x) / n) / (n - 1)), 6) as deviation,
               true as is_optimal, true as is_downhill
        from cells, (select cast(count(*) as double) as n from train)
        where is_train group by slot, n""",
    "objective_recomputed": f"""
        {_DOCS}
        select round(-p * ln(p) - (1 - p) * ln(1 - p), 6) as first, true as is_last, true as is_better from shares""",
    "model_roc_properties": f"""
        {_DOCS}
        select model, 1::bigint as n_origins, 0::bigint as n_back,
               count(*) filter (label = 0) as n_negative, count(*) filter (label = 1) as n_positive,
               1.0::double as last_fpr, 1.0::double as last_tpr
        from test, {_named("random_forest", "decision_tree", "naive_bayes", "logistic_regression")}
        group by model""",
    "model_comparison_properties": f"""
        {_DOCS}
        select model, cast(case when model like '%_top_4' then 4 when model like '%_top_5' then 5
                           else n_slots end as integer) as n_features,
               true as is_area, true as is_raw_area
        from slots, {_named("random_forest", "decision_tree", "naive_bayes", "logistic_regression",
                            "logistic_regression_light", "random_forest_top_4", "random_forest_top_5")}""",
    "model_comparison_lines_properties": f"""
        with lines as (
            select l_linestatus from lineitem
            where ('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)
                                      || ':42'), 1, 8))::bigint % 10 < 7)
        select model, cast(case when model like '%_top_4' then 4 else n_slots end as integer)
                   as n_features, true as is_area, true as is_raw_area
        from (select 5 + count(distinct l_linestatus) as n_slots from lines),
             {_named("random_forest", "naive_bayes", "logistic_regression", "random_forest_top_4")}""",
}
