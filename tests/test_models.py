import numpy as np
import pytest

from ledgerline.operators.evaluate import (
    area_under_roc,
    roc_points,
    score_label_pairs,
    trapezoid_area,
)
from ledgerline.operators.models import (
    cached,
    coefficients,
    compare,
    decision_tree,
    feature_importances,
    fit,
    logistic,
    naive_bayes,
    naive_bayes_parameters,
    objective_history,
    optimality,
    prepare,
    random_forest,
    refit_on_top,
    score,
)


@pytest.fixture(scope="module")
def data(spark):
    """Sex decides most, fare some, siblings nothing."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(1200):
        sex = "female" if rng.random() < 0.4 else "male"
        fare = float(rng.exponential(30))
        chance = 0.15 + 0.55 * (sex == "female") + 0.25 * (fare > 40)
        rows.append((i, sex, fare, int(rng.integers(0, 3)), int(rng.random() < chance)))
    frame = spark.createDataFrame(rows, "id int, sex string, fare double, sibsp int, survived int")
    return prepare(frame, "id", "survived", ["fare", "sibsp"], ["sex"])


def test_labels_by_frequency(data):
    counts = {r.label: r["count"] for r in data.train.groupBy("label").count().collect()}
    assert counts[0.0] > counts[1.0]


def test_forest_and_importances(data):
    model = fit(random_forest(1), data.train)
    rows = feature_importances(model, data.names).collect()
    assert [r.name for r in rows] == data.names
    assert sum(r.importance for r in rows) == pytest.approx(1)
    best = max(rows, key=lambda r: r.importance)
    assert best.name.startswith("sex_levels")
    scored = score(model, data.test, "id")
    assert area_under_roc(scored, "probability", "label") > 0.75


def test_a_tree_ranks_differently_by_its_raw_scores(data):
    """Raw scores count the rows of a leaf, and leaves differ in size."""
    estimators = {"random_forest": random_forest(1), "decision_tree": decision_tree(1)}
    found = {r.model: r for r in compare(data, estimators, [], 1).collect()}
    scored = score(fit(decision_tree(1), data.train), data.test, "id")
    assert found["decision_tree"].auc == pytest.approx(area_under_roc(scored, "probability", "label"))
    assert found["decision_tree"].auc_raw == pytest.approx(area_under_roc(scored, "raw", "label"))
    assert found["decision_tree"].auc != pytest.approx(found["decision_tree"].auc_raw)
    assert found["random_forest"].auc == pytest.approx(found["random_forest"].auc_raw)


def test_optimality(data):
    """Against numpy; a model stopped early is seen to be off."""
    rows = [(r.features.toArray(), r.label) for r in data.train.select("features", "label").collect()]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    off = {}
    for steps in (1, 100):
        model = fit(logistic(0.01, 0.5, steps), data.train)
        table, objective = optimality(model, data.train, data.names, 0.01, 0.5)
        weight, deviation = model.coefficients.toArray(), x.std(axis=0, ddof=1)
        p = 1 / (1 + np.exp(-(x @ weight + model.intercept)))
        slope = ((p - y)[:, None] * x).mean(axis=0) / deviation
        found = table.orderBy("slot").collect()
        assert [r.slope for r in found] == pytest.approx(slope.tolist(), abs=1e-9)
        scaled = weight * deviation
        loss = -np.log(np.where(y == 1, p, 1 - p)).mean() + 0.005 * np.abs(scaled).sum() + 0.0025 * (scaled**2).sum()
        assert objective == pytest.approx(loss) == pytest.approx(model.summary.objectiveHistory[-1])
        off[steps] = max(r.violation for r in found)
    assert off[100] < 1e-4 < off[1]


def test_three_areas_agree(data):
    model = fit(random_forest(1), data.train)
    scored = score(model, data.test, "id")
    area = area_under_roc(scored, "probability", "label")
    for per_range in (10, 50_000):
        ours = trapezoid_area(scored, "probability", "label", (), per_range).first().auc
        assert ours == pytest.approx(area)
    pairs = score_label_pairs(model.transform(data.test), "label")
    assert trapezoid_area(pairs, "score", "label").first().auc == pytest.approx(area)
    rows = scored.collect()
    positives = [r.probability for r in rows if r.label == 1]
    negatives = [r.probability for r in rows if r.label == 0]
    wins = sum((p > q) + (p == q) / 2 for p in positives for q in negatives)
    assert wins / (len(positives) * len(negatives)) == pytest.approx(area)


def test_roc_points_start_at_the_origin_and_end_at_one(data):
    scored = score(fit(decision_tree(1), data.train), data.test, "id")
    points = roc_points(scored, "probability", "label", (), 2).orderBy("fp", "tp").collect()
    assert (points[0].threshold, points[0].fpr, points[0].tpr) == (None, 0, 0)
    assert (points[-1].fpr, points[-1].tpr) == (1, 1)
    area = np.trapezoid([p.tpr for p in points], [p.fpr for p in points])
    assert area == pytest.approx(area_under_roc(scored, "probability", "label"))


def test_tied_and_one_sided_scores(spark):
    tied = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0)], "s double, y int")
    assert trapezoid_area(tied, "s", "y").first().auc == 0.5
    one_sided = spark.createDataFrame([(0.5, 1), (0.7, 1)], "s double, y int")
    assert trapezoid_area(one_sided, "s", "y").first().auc is None


def test_naive_bayes_closed_form(data):
    model = fit(naive_bayes(), data.train)
    rows = naive_bayes_parameters(data.train, "label", "features").collect()
    theta, prior = model.theta.toArray(), model.pi.toArray()
    assert len(rows) == theta.size
    for r in rows:
        assert r.log_theta == pytest.approx(theta[int(r.label), r.slot])
        assert r.log_prior == pytest.approx(prior[int(r.label)])


def test_logistic_inspection(data):
    model = fit(logistic(0.01), data.train)
    rows = {r.name: r.coefficient for r in coefficients(model, data.names).collect()}
    assert set(rows) == {"(intercept)", *data.names}
    assert rows["sex_levels_female"] - rows["sex_levels_male"] > 0.5
    history = objective_history(model).orderBy("iteration").collect()
    assert 1 < len(history) <= 11 and history[-1].objective < history[0].objective


def test_refit_and_comparison(data):
    model, test, chosen = refit_on_top(data, 2, seed=1)
    assert len(chosen) == 2 and model.numFeatures == 2
    assert area_under_roc(score(model, test, "id"), "probability", "label") > 0.7
    estimators = {"forest": random_forest(1), "bayes": naive_bayes()}
    got = {r.model: r for r in compare(data, estimators, [2], 1, "forest").collect()}
    assert set(got) == {"forest", "bayes", "random_forest_top_2"}
    assert got["forest"].auc == pytest.approx(got["forest"].auc_raw)
    forest = score(fit(random_forest(1), data.train), data.test, "id")
    assert got["forest"].auc == pytest.approx(area_under_roc(forest, "probability", "label"))
    assert got["forest"].n_features == len(data.names)
    assert not data.train.is_cached


def test_cached_leaves_a_cached_frame_cached(spark):
    frame = spark.range(5).cache()
    with cached(frame):
        pass
    assert frame.is_cached
    frame.unpersist()


def _rows(spark, n=600):
    rng = np.random.default_rng(5)
    return spark.createDataFrame(
        [(i, float(rng.normal()), f"c{rng.integers(0, 4)}", int(rng.random() < 0.4)) for i in range(n)],
        "id int, x double, c string, y int",
    )


def test_forests_do_not_depend_on_the_pieces_of_the_input(spark):
    def run(rows):
        data = prepare(rows, "id", "y", ["x"], ["c"])
        model = fit(random_forest(3), data.train)
        scored = score(model, data.test, "id").orderBy("id").collect()
        return model.featureImportances.toArray().tolist(), [(r.id, r.probability) for r in scored]

    rows = _rows(spark)
    assert run(rows.coalesce(1)) == run(rows.repartition(7, "x")) == run(rows.repartition(40))


@pytest.mark.parametrize("per_range", [3, 50_000])
def test_curves_without_collinear_points(spark, per_range):
    """Straight stretches keep their ends, also where these lie in different ranges."""
    pick = np.random.default_rng(4)
    rows = [(g, float(s), int(pick.random() < 0.5)) for g in ("a", "b", None) for s in pick.integers(0, 60, 90)]
    rows += [("straight", float(s), 1) for s in range(40)] + [("single", 1.0, 0)]
    frame = spark.createDataFrame(rows, "g string, s double, y int").repartition(4)
    found = {}
    for r in roc_points(frame, "s", "y", ["g"], per_range, collinear=False).collect():
        found.setdefault(r.g, []).append((r.threshold, r.fp, r.tp))
    for group in ("a", "b", None, "straight", "single"):
        held = [(s, y) for g, s, y in rows if g == group]
        scores = sorted({s for s, _ in held}, reverse=True)
        points = [(s, sum(1 - y for v, y in held if v >= s), sum(y for v, y in held if v >= s)) for s in scores]
        kept = [p for i, p in enumerate(points) if i in (0, len(points) - 1) or any(points[i + 1][k] - 2 * p[k] + points[i - 1][k] for k in (1, 2))]
        assert sorted(found[group], key=str) == sorted([(None, 0, 0), *kept], key=str)


def test_label_seen_in_test_rows_only(spark):
    from ledgerline.operators.features import split_part

    rows = _rows(spark)
    last = rows.where(split_part("id") == "test").agg({"id": "max"}).first()[0]
    rows = rows.selectExpr("id", "x", "c", f"if(id = {last}, 7, y) as y")
    data = prepare(rows, "id", "y", ["x"], ["c"])
    scored = score(fit(random_forest(3), data.train), data.test, "id")
    assert scored.where(f"id = {last}").first().label == 2.0


def test_many_levels_are_slots_too(spark):
    rows = spark.range(21_000).selectExpr("id", "cast(id % 7 as double) as x", "cast(id as string) as c", "cast(id % 2 as int) as y")
    data = prepare(rows, "id", "y", ["x"], ["c"])
    assert len(data.names) > 14_000 and data.test.count() > 6_000


def test_areas_are_ranked_anew_without_a_window_over_a_model(spark):
    from ledgerline.plans.model_properties import _compared

    scored = spark.range(400).selectExpr(
        "if(id % 2 = 0, 'a', 'b') as model", "cast(id % 3 = 0 as double) as label", "cast(id * 7 % 11 as double) as probability", "cast(id * 13 % 97 as double) as raw"
    )

    def area(rows, score):
        above = [(p[score] > n[score]) + (p[score] == n[score]) / 2 for p in rows if p.label for n in rows if not n.label]
        return sum(above) / len(above)

    held = scored.collect()
    of = {m: [r for r in held if r.model == m] for m in "ab"}
    found = spark.createDataFrame([("a", 2, area(of["a"], "probability"), area(of["a"], "raw")), ("b", 2, area(of["b"], "raw"), area(of["b"], "raw"))], "model string, n_features int, auc double, auc_raw double")
    got = _compared(found, scored)
    assert {r.model: (r.is_area, r.is_raw_area) for r in got.collect()} == {"a": (True, True), "b": (False, True)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(" not in plan


def test_scores_are_kept_by_column(spark):
    """What ranks the scores of all models reads them more than once, one column at a time."""
    from ledgerline.operators.models import fit, naive_bayes, prepare, score_all

    rows = spark.range(200).selectExpr("cast(id as string) as k", "cast(id % 3 = 0 as int) as y", "cast(id % 7 as double) as x", "concat('c', id % 2) as c")
    data = prepare(rows, "k", "y", ["x"], ["c"])
    model = fit(naive_bayes(), data.train)
    found = score_all({"a": model, "b": model}, data.test, "k")
    assert found.columns == ["k", "label", "model", "raw", "probability", "prediction"]
    assert found.count() == 2 * data.test.count() and found.inputFiles()
