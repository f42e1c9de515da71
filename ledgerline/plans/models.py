"""Classifiers on documents with quality labels."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.evaluate import roc_points, score_label_pairs
from ledgerline.operators.models import (
    Prepared,
    areas,
    cached,
    coefficients,
    decision_tree,
    feature_importances,
    fit,
    fit_all,
    logistic,
    naive_bayes,
    naive_bayes_parameters,
    objective_history,
    prepare,
    random_forest,
    refit_on_top,
    score,
    score_all,
)
from ledgerline.plans.features import CATEGORIES, NUMBERS, document_columns
from ledgerline.sources import read_table

SEED = 42
LIGHT_PENALTY = 0.01
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_table(spark, folder, "labels").select("doc_id", "quality")
    return document_columns(spark, folder).join(labels, "doc_id")


def _data(spark: SparkSession, folder: str) -> Prepared:
    return prepare(
        labelled_documents(spark, folder), "doc_id", "quality", NUMBERS, CATEGORIES, SEED
    )


def _scored(spark: SparkSession, folder: str, estimator: Estimator) -> DataFrame:
    data = _data(spark, folder)
    return score(fit(estimator, data.train), data.test, "doc_id")


def forest(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder, random_forest(SEED))


def tree(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder, decision_tree(SEED))


def bayes(spark: SparkSession, folder: str) -> DataFrame:
    scored = _scored(spark, folder, naive_bayes())
    return scored.withColumns({"raw": F.round("raw", 5), "probability": F.round("probability", 7)})


def penalised(spark: SparkSession, folder: str) -> DataFrame:
    """The default penalty leaves no slot a weight, so every score is the share of the training labels."""
    scored = _scored(spark, folder, logistic())
    return scored.withColumns({"raw": F.round("raw", 6), "probability": F.round("probability", 6)})


def importances(spark: SparkSession, folder: str) -> DataFrame:
    data = _data(spark, folder)
    return feature_importances(fit(random_forest(SEED), data.train), data.names)


def logistic_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    data = _data(spark, folder)
    return coefficients(fit(logistic(LIGHT_PENALTY), data.train), data.names)


def objectives(spark: SparkSession, folder: str) -> DataFrame:
    data = _data(spark, folder)
    return objective_history(fit(logistic(LIGHT_PENALTY), data.train))


def selected(spark: SparkSession, folder: str) -> DataFrame:
    model, test, _ = refit_on_top(_data(spark, folder), 5, SEED)
    return score(model, test, "doc_id")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    data = _data(spark, folder)
    model = fit(naive_bayes(), data.train)
    found = score_label_pairs(model.transform(data.test), "label", "doc_id")
    return found.withColumn("score", F.round("score", 7))


def curves(spark: SparkSession, folder: str) -> DataFrame:
    """One ROC curve per model, each from its own predictions."""
    data = _data(spark, folder)
    estimators = {
        "random_forest": random_forest(SEED),
        "decision_tree": decision_tree(SEED),
        "naive_bayes": naive_bayes(),
        "logistic_regression": logistic(LIGHT_PENALTY),
    }
    with cached(data.train):
        models = {name: estimator.fit(data.train) for name, estimator in estimators.items()}
    return roc_points(score_all(models, data.test, "doc_id"), "probability", "label", ["model"])


def _compared(
    data: Prepared, estimators: dict[str, Estimator], keep: list[int]
) -> tuple[DataFrame, DataFrame]:
    """Areas, and the scores they come from."""
    models, sizes, test = fit_all(data, estimators, keep, SEED)
    scored = score_all(models, test)
    return areas(scored, sizes), scored


def compared_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    estimators = {
        "random_forest": random_forest(SEED),
        "decision_tree": decision_tree(SEED),
        "naive_bayes": naive_bayes(),
        "logistic_regression": logistic(),
        "logistic_regression_light": logistic(LIGHT_PENALTY),
    }
    return _compared(_data(spark, folder), estimators, [4, 5])


def compared_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The same comparison on the largest table: which lines were returned."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = read_table(spark, folder, "lineitem").select(
        key.alias("line"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        *LINE_NUMBERS,
        "l_linestatus",
    )
    data = prepare(lines, "line", "returned", LINE_NUMBERS, ["l_linestatus"], SEED)
    estimators = {
        "random_forest": random_forest(SEED),
        "naive_bayes": naive_bayes(),
        "logistic_regression": logistic(LIGHT_PENALTY),
    }
    return _compared(data, estimators, [4])


def comparison(spark: SparkSession, folder: str) -> DataFrame:
    return compared_documents(spark, folder)[0]


def line_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return compared_lines(spark, folder)[0]


def bayes_parameters(spark: SparkSession, folder: str) -> DataFrame:
    data = _data(spark, folder)
    found = naive_bayes_parameters(data.train, "label", "features")
    return found.withColumns(
        {"log_prior": F.round("log_prior", 9), "log_theta": F.round("log_theta", 9)}
    )


QUERIES = {
    "model_random_forest": forest,
    "feature_importance": importances,
    "model_decision_tree": tree,
    "naive_bayes_theta": bayes_parameters,
    "model_naive_bayes": bayes,
    "model_logistic": penalised,
    "logistic_coefficients": logistic_coefficients,
    "objective_history": objectives,
    "model_selected_features": selected,
    "model_comparison": comparison,
    "model_comparison_lines": line_comparison,
    "score_label_pairs": pairs,
    "model_roc_points": curves,
}

# The training rows' slots and classes in long form: numbers first, then one slot per level.
_LONG = """
    with docs as (
        select doc_id, n_chars, len(string_split(text, ' ')) as n_words, lang, source, quality,
               ('0x' || substr(md5(doc_id || ':42'), 1, 8))::bigint % 10 < 7 as is_train
        from documents join labels using (doc_id)),
    train as (select * from docs where is_train),
    classes as (
        select quality, row_number() over (order by count(*) desc, quality) - 1 as label,
               count(*) filter (is_train) as members
        from docs group by quality),
    langs as (
        select lang, row_number() over (order by count(*) desc, lang) + 1 as slot
        from train group by lang),
    sources as (
        select source, (select count(*) from langs)
                       + row_number() over (order by count(*) desc, source) + 1 as slot
        from train group by source),
    cells as (
        select doc_id, is_train, quality, 0 as slot, n_chars as x from docs
        union all select doc_id, is_train, quality, 1, n_words from docs
        union all select doc_id, is_train, quality, slot, 1 from docs join langs using (lang)
        union all select doc_id, is_train, quality, slot, 1 from docs join sources using (source)),
    slots as (select distinct slot from cells),
    totals as (
        select label, s.slot, members,
               coalesce(sum(x) filter (is_train), 0) as total
        from classes c cross join slots s
        left join cells on cells.quality = c.quality and cells.slot = s.slot
        group by label, s.slot, members),
    thetas as (
        select label, slot,
               ln(members + 1) - ln((select count(*) from train)
                                    + (select count(*) from classes)) as log_prior,
               ln(total + 1) - ln(sum(total + 1) over (partition by label)) as log_theta
        from totals)"""

_SCORED = f"""
    {_LONG},
    raws as (
        select doc_id, quality, label, any_value(log_prior) + sum(x * log_theta) as raw
        from cells join thetas using (slot) where not is_train
        group by doc_id, quality, label),
    scored as (
        select doc_id, c.label, max(raw) filter (r.label = 0) as raw_0,
               max(raw) filter (r.label = 1) as raw_1
        from raws r join classes c using (quality) group by doc_id, c.label)"""

ORACLE = {
    "naive_bayes_theta": f"""
        {_LONG}
        select cast(label as double) as label, cast(slot as integer) as slot,
               round(log_prior, 9) as log_prior, round(log_theta, 9) as log_theta
        from thetas""",
    "model_naive_bayes": f"""
        {_SCORED}
        select doc_id, cast(label as double) as label, round(raw_1, 5) as raw,
               round(1 / (1 + exp(raw_0 - raw_1)), 7) as probability,
               case when raw_1 > raw_0 then 1.0::double else 0.0::double end as prediction
        from scored""",
    "model_logistic": f"""
        {_LONG},
        shares as (
            select sum(members * label) / sum(members) as p from classes)
        select doc_id, cast(label as double) as label, round(ln(p / (1 - p)), 6) as raw,
               round(p, 6) as probability,
               case when p > 0.5 then 1.0::double else 0.0::double end as prediction
        from docs join classes using (quality), shares where not is_train""",
    "score_label_pairs": f"""
        {_SCORED}
        select doc_id, round(1 / (1 + exp(raw_1 - raw_0)), 7) as score,
               1 - cast(label as double) as label
        from scored""",
}
