"""Classifiers on feature vectors: fitting, scoring, inspection and comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators.evaluate import positive_probability, trapezoid_area
from ledgerline.operators.features import FeatureEncoder, slice_features, slot_names, split_by_key
from ledgerline.operators.levels import LevelIndex
from ledgerline.session import settle_columns, settle_pieces


def random_forest(seed: int, trees: int = 10, features: str = "features") -> Estimator:
    return RandomForestClassifier(numTrees=trees, seed=seed, featuresCol=features)


def decision_tree(seed: int) -> Estimator:
    return DecisionTreeClassifier(seed=seed)


def naive_bayes(smoothing: float = 1.0) -> Estimator:
    return NaiveBayes(smoothing=smoothing, modelType="multinomial")


def logistic(regularisation: float = 0.3, elastic_net: float = 0.8, steps: int = 10) -> Estimator:
    return LogisticRegression(
        maxIter=steps, regParam=regularisation, elasticNetParam=elastic_net
    )


def index_label(rows: DataFrame, label: str) -> DataFrame:
    """Labels as 0.0, 1.0, ... by falling frequency, in a column ``label``."""
    return LevelIndex.fit(rows, [label]).transform(rows, outputs=["label"])


#: Pieces that model rows are dealt into; forests draw by piece, so it is part of the seed.
PIECES = 16


@dataclass
class Prepared:
    """Training and test rows with ``features`` and ``label``.

    The label index knows the labels of all rows; the features' encoders are fitted on training.
    """

    train: DataFrame
    test: DataFrame
    names: list[str]


def prepare(
    rows: DataFrame,
    key: str,
    label: str,
    numbers: Sequence[str],
    categories: Sequence[str],
    seed: int = 42,
    pieces: int = PIECES,
) -> Prepared:
    """Split and encode. The model columns are settled first: encoders, fits and scores all read
    them, and none goes back to the source. Raise ``pieces`` with the table: 16 suit some millions
    of rows. ``max_levels`` bounds what indexing a category brings to the driver."""
    rows = settle_pieces(rows.select(key, label, *numbers, *categories), key, pieces)
    labelled = index_label(rows, label)
    train, test = split_by_key(labelled, key, seed=seed)
    encoder = FeatureEncoder.fit(train, numbers, categories)
    keep = [key, "label", "features"]
    encoded = encoder.transform(train).select(*keep)
    return Prepared(encoded, encoder.transform(test).select(*keep), slot_names(encoded))


@contextmanager
def cached(*frames: DataFrame) -> Iterator[None]:
    """Keep frames that several passes read in memory, or on disk where they do not fit.

    A frame that is cached already is left to whoever cached it.
    """
    fresh = [frame for frame in frames if frame.storageLevel == StorageLevel.NONE]
    for frame in fresh:
        frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield
    finally:
        for frame in fresh:
            frame.unpersist()


def fit(estimator: Estimator, train: DataFrame) -> Model:
    with cached(train):
        return estimator.fit(train)


def score(model: Model, rows: DataFrame, key: str) -> DataFrame:
    """Key, label, raw score and probability of class 1, and predicted class."""
    return model.transform(rows).select(
        key,
        "label",
        vector_to_array("rawPrediction")[1].alias("raw"),
        positive_probability().alias("probability"),
        "prediction",
    )


def score_all(models: Mapping[str, Model], rows: DataFrame, *keep: str) -> DataFrame:
    """The same rows scored by several models in one pass, told apart by a column ``model``.

    The scores are settled: what ranks them reads them more than once.
    """
    scored = rows
    results = []
    for i, (name, model) in enumerate(models.items()):
        raw, probability, prediction = f"raw_{i}", f"probability_{i}", f"prediction_{i}"
        columns = {
            model.rawPredictionCol: raw,
            model.probabilityCol: probability,
            model.predictionCol: prediction,
        }
        scored = model.transform(scored, columns)
        results.append(
            F.struct(
                F.lit(name).alias("model"),
                vector_to_array(raw)[1].alias("raw"),
                positive_probability(probability).alias("probability"),
                F.col(prediction).alias("prediction"),
            )
        )
    return settle_columns(scored.select(*keep, "label", F.inline(F.array(*results))))


def feature_importances(model: Model, names: Sequence[str]) -> DataFrame:
    """One row per slot; the model holds one number per slot on the driver already."""
    rows = [(i, names[i], float(v)) for i, v in enumerate(model.featureImportances.toArray())]
    return _rows(rows, "slot int, name string, importance double")


def coefficients(model: Model, names: Sequence[str]) -> DataFrame:
    """One row per slot, and the intercept as slot -1."""
    rows = [(-1, "(intercept)", float(model.intercept))]
    rows += [(i, names[i], float(v)) for i, v in enumerate(model.coefficients.toArray())]
    return _rows(rows, "slot int, name string, coefficient double")


def objective_history(model: Model) -> DataFrame:
    rows = [(i, float(v)) for i, v in enumerate(model.summary.objectiveHistory)]
    return _rows(rows, "iteration int, objective double")


def optimality(
    model: Model, rows: DataFrame, names: Sequence[str], regularisation: float, elastic_net: float, features: str = "features"
) -> tuple[DataFrame, float]:
    """How far a binary logistic model is from the optimum of its penalised likelihood on ``rows``.

    One row per slot: its deviation, the slope of the mean loss along the scaled slot, and
    ``violation``: by how much slope and penalty fail to cancel out (a slot of weight 0 may have any
    slope within the penalty's edge). And the penalised objective. All from one aggregate over the
    rows; what comes back are three numbers a slot.
    """
    scored = model.transform(rows)
    p, x = positive_probability(model.getProbabilityCol()), F.col(features)
    of_label = F.when(F.col("label") == 1, p).otherwise(1 - p)
    found = scored.agg(
        F.count(F.lit(1)).alias("n"),
        Summarizer.sum(x, p).alias("expected"),
        Summarizer.sum(x, F.col("label")).alias("seen"),
        Summarizer.std(x).alias("deviation"),
        F.avg(-F.log(of_label)).alias("loss"),
    ).first()
    edge, bend = regularisation * elastic_net, regularisation * (1 - elastic_net)
    out, penalty = [], 0.0
    for i, weight in enumerate(model.coefficients.toArray()):
        deviation = float(found.deviation[i])
        slope = float(found.expected[i] - found.seen[i]) / found.n / deviation if deviation else 0.0
        scaled = float(weight) * deviation
        penalty += edge * abs(scaled) + bend * scaled**2 / 2
        violation = abs(slope + bend * scaled + math.copysign(edge, scaled)) if scaled else max(0.0, abs(slope) - edge)
        out.append((i, names[i], float(weight), deviation, slope, violation))
    table = _rows(out, "slot int, name string, coefficient double, deviation double, slope double, violation double")
    return table, found.loss + penalty


def _rows(rows: list[tuple], schema: str) -> DataFrame:
    return SparkSession.active().createDataFrame(rows, schema)


def top_slots(model: Model, names: Sequence[str], k: int) -> list[str]:
    """Names of the ``k`` most important slots."""
    ranked = sorted(enumerate(model.featureImportances.toArray()), key=lambda p: (-p[1], p[0]))
    return [names[i] for i, _ in ranked[:k]]


def refit_on_top(
    data: Prepared, k: int, seed: int, full: Model | None = None
) -> tuple[Model, DataFrame, list[str]]:
    """A forest on the ``k`` best slots of the forest ``full``, which is fitted if not given.

    Returns the model, the test rows with the sliced vector ``top_k``, and the slots' names.
    """
    with cached(data.train):
        full = full or random_forest(seed).fit(data.train)
        chosen = top_slots(full, data.names, k)
        out = f"top_{k}"
        train = slice_features(data.train, chosen, out=out)
        model = random_forest(seed, features=out).fit(train)
    return model, slice_features(data.test, chosen, out=out), chosen


def fit_all(
    data: Prepared,
    estimators: Mapping[str, Estimator],
    keep: Sequence[int],
    seed: int,
    ranker: str = "random_forest",
) -> tuple[dict[str, Model], dict[str, int], DataFrame]:
    """Models by name, their numbers of slots, and the test rows with all vectors they need.

    For each of ``keep`` there is a forest on so many best slots by the model ``ranker``.
    """
    with cached(data.train):
        models = {name: estimator.fit(data.train) for name, estimator in estimators.items()}
        sizes = dict.fromkeys(models, len(data.names))
        test = data.test
        for k in keep:
            name = f"random_forest_top_{k}"
            model, test, chosen = refit_on_top(
                replace(data, test=test), k, seed, models[ranker]
            )
            models[name], sizes[name] = model, len(chosen)
    return models, sizes, test


def areas(scored: DataFrame, sizes: Mapping[str, int]) -> DataFrame:
    """Area under ROC of each model, from the scores of ``score_all``.

    ``auc`` ranks by probability, ``auc_raw`` by the raw prediction. Where the raw scores of both
    classes don't add up to the same number in every row (naive Bayes, or a single tree, whose raw
    score counts the rows of its leaf) one is no function of the other, so both are ranked.
    """
    kinds = F.array(
        F.struct(F.lit("auc").alias("kind"), F.col("probability").alias("score")),
        F.struct(F.lit("auc_raw").alias("kind"), F.col("raw").alias("score")),
    )
    scores = scored.select("model", "label", F.inline(kinds))
    found = trapezoid_area(scores, "score", "label", ["model", "kind"])
    features = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("auc")))
    return found.groupBy("model").agg(
        F.max(features[F.col("model")]).alias("n_features"),
        of("auc").alias("auc"),
        of("auc_raw").alias("auc_raw"),
    )


def compare(
    data: Prepared,
    estimators: Mapping[str, Estimator],
    keep: Sequence[int],
    seed: int,
    ranker: str = "random_forest",
) -> DataFrame:
    """Area under ROC of each model on one split, and of forests on the best ``keep`` slots.

    All models score the test rows in one pass, and all areas come from the scores together.
    """
    models, sizes, test = fit_all(data, estimators, keep, seed, ranker)
    return areas(score_all(models, test), sizes)


def naive_bayes_parameters(
    rows: DataFrame, label: str, features: str, smoothing: float = 1.0
) -> DataFrame:
    """Log class priors and log slot probabilities of multinomial naive Bayes, as aggregates.

    One vector is added up per class, so the shuffle carries one row per task and class.
    """
    sums = rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.sum(F.col(features)).alias("sums")
    )
    # One row per class from here on.
    classes = Window.partitionBy(F.lit(0))
    slots = F.size("sums")
    mass = F.aggregate("sums", F.lit(0.0), lambda a, x: a + x)
    prior = F.log(F.col("n") + smoothing) - F.log(
        F.sum("n").over(classes) + smoothing * F.count(F.lit(1)).over(classes)
    )
    return (
        sums.withColumn("sums", vector_to_array("sums"))
        .withColumn("log_prior", prior)
        .withColumn("log_mass", F.log(mass + smoothing * slots))
        .select(label, "log_prior", "log_mass", F.posexplode("sums").alias("slot", "total"))
        .select(
            label,
            "slot",
            "log_prior",
            (F.log(F.col("total") + smoothing) - F.col("log_mass")).alias("log_theta"),
        )
    )
