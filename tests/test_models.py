"""Isolation forest, detector, ensemble, drift and retraining."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from keystride import schema as S
from keystride.plans import detector, feature_build, iforest, monitoring, risk, training
from keystride.session import materialise, new_path

WIDTH = 4


@pytest.fixture(scope="module")
def points(spark):
    """600 normal rows, 10 far away, 40 % of the normal ones copies of one row."""
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(600, WIDTH))
    rows[:240] = rows[0]
    rows = np.vstack([rows, rng.normal(loc=8.0, size=(10, WIDTH))])
    return materialise(spark.createDataFrame(
        [(i, [float(v) for v in r], int(i >= 600)) for i, r in enumerate(rows)],
        "id bigint, x array<double>, label int",
    ).select("id", array_to_vector("x").alias("features"), "label"), "points")


def forest(**options):
    return iforest.IsolationForest(idCol="id", **options)


@pytest.fixture(scope="module")
def fitted(points):
    return forest().fit(points)


def nodes_of(model):
    return sorted(tuple(r) for r in model.nodes.collect())


def test_every_tree_gets_its_rows(fitted):
    roots = fitted.nodes.filter("node = 0").collect()
    assert len(roots) == S.NUM_TREES and {r["size"] for r in roots} == {256}
    assert fitted.nodes.agg(F.max("depth")).first()[0] <= 8


def test_nodes_add_up(fitted):
    table = {(r["tree"], r["node"]): r for r in fitted.nodes.collect()}
    for (tree, _), r in table.items():
        if r["feature"] != iforest.LEAF:
            lo, hi = table[tree, r["lo"]], table[tree, r["hi"]]
            assert lo["size"] + hi["size"] == r["size"]
            assert min(lo["size"], hi["size"]) > 0
            assert lo["depth"] == hi["depth"] == r["depth"] + 1


def test_same_seed_same_trees_under_any_partitioning(points, fitted):
    assert nodes_of(forest().fit(points.repartition(13))) == nodes_of(fitted)
    assert nodes_of(forest(seed=1).fit(points)) != nodes_of(fitted)


def test_outliers_stand_out(points, fitted):
    scored = fitted.transform(points).cache()
    assert scored.filter("iforest_score >= 0 or iforest_score < -1").isEmpty()
    outliers = scored.filter("label = 1").agg(F.max("iforest_score")).first()[0]
    others = scored.filter("label = 0").agg(F.percentile("iforest_score", 0.05)).first()[0]
    assert outliers < others
    assert scored.filter("label = 1 and not iforest_anomaly").isEmpty()
    flagged = scored.filter("iforest_anomaly").count()
    assert flagged == 61
    assert scored.filter("abs(iforest_prediction - 1 - iforest_score) > 1e-12").isEmpty()


def test_score_follows_the_path_lengths(points, fitted):
    """Scores against a walk down the node table, one row and tree at a time."""
    table = {(r["tree"], r["node"]): r for r in fitted.nodes.collect()}
    rows = fitted.transform(points).select(
        vector_to_array("features").alias("x"), "iforest_score"
    ).filter("id >= 590").collect()
    for x, score in rows:
        lengths = []
        for tree in range(S.NUM_TREES):
            r = table[tree, 0]
            while r["feature"] != iforest.LEAF:
                r = table[tree, r["lo"] if x[r["feature"]] <= r["split"] else r["hi"]]
            lengths.append(r["depth"] + iforest.mean_path(r["size"]))
        expected = -2 ** (-np.mean(lengths) / iforest.mean_path(256))
        assert score == pytest.approx(expected, rel=1e-12)


def test_neighbouring_floats_can_be_split():
    x = np.array([[1.0], [np.nextafter(1.0, 2.0)]])
    for seed in range(50):
        nodes = iforest._grow(x, 0, seed, 8)
        assert sorted(n[6] for n in nodes) == [1, 1, 2]


def test_mean_path():
    assert [iforest.mean_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert iforest.mean_path(256) == pytest.approx(10.244770920116851)


def test_sampling_from_a_pool(spark):
    rows = spark.range(50_000).select(F.col("id"), F.array(F.rand(1)).alias("x"))
    drawn = iforest.sample_per_tree(rows, "id", 5, 16, 3, 50_000)
    sizes = drawn.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"))
    assert {(r["n"], r["d"]) for r in sizes.collect()} == {(16, 16)} and sizes.count() == 5


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.999])
def test_narrowed_quantile_is_exact(spark, monkeypatch, q):
    monkeypatch.setattr(iforest, "EXACT_ROWS", 100)
    monkeypatch.setattr(iforest, "RANK_ACCURACY", 200)
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=5000), rng.integers(0, 9, 5000).astype(float)):
        rows = spark.createDataFrame([(float(v),) for v in values], "s double")
        found = iforest.exact_quantile(rows, "s", q, len(values))
        assert found == pytest.approx(float(np.quantile(values, q)), abs=1e-12)


def test_no_rows_is_an_error(points):
    with pytest.raises(ValueError):
        forest().fit(points.limit(0))


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(60, 3))
    rows[:, 2] = 4.0
    return spark.createDataFrame(
        [(f"s{i}", *map(float, r)) for i, r in enumerate(rows)],
        "session_id string, a double, b double, constant double",
    )


def test_detector_round_trip(spark, features):
    fitted = detector.SessionDetector().fit(features)
    assert fitted.names == ["a", "b", "constant"]
    assert dict((n, s) for n, _, s in fitted.stats)["constant"] == 1.0
    path = new_path(spark, "detector")
    fitted.save(path)
    loaded = detector.SessionDetector.load(spark, path)
    before = sorted(map(str, fitted.predict(features).collect()))
    # Other order, an extra and a missing column: names decide.
    shuffled = features.select("constant", F.lit(9).alias("extra"), "b", "a", "session_id")
    assert sorted(map(str, loaded.predict(shuffled).collect())) == before
    row = fitted.predict(features).first()
    assert 0.5 < row["risk_score"] <= 0.7311 and 0 < row["confidence"] <= 0.4622
    assert row["feature_importance"]["constant"] == 0.0
    assert sum(row["feature_importance"].values()) == pytest.approx(1.0)
    assert fitted.predict(features).filter("is_anomaly").count() == 6


def test_an_unfitted_detector_refuses(spark, features):
    with pytest.raises(RuntimeError):
        detector.SessionDetector().predict(features)
    with pytest.raises(RuntimeError):
        detector.SessionDetector().save(new_path(spark, "detector"))
    with pytest.raises(ValueError):
        detector.SessionDetector().fit(features.limit(0))


@pytest.fixture(scope="module")
def small_run(spark, points):
    root = new_path(spark, "training")
    run = training.train(
        points, "20240101_000000", validation=points, root=root,
        features="features", key="id", trees=10, depth=4,
    )
    return root, run


def test_training_evaluates_saves_and_records(spark, points, small_run):
    root, run = small_run
    record = spark.read.json(f"{root}/runs").first()
    assert record["num_trees"] == 10 and record["max_depth"] == 4
    assert record["auc_roc"] == 1.0 and record["risk_auc_roc"] > 0.95
    loaded = training.load(record["model_path"])
    before = training.score(run.model, points).select("id", "risk_score")
    after = training.score(loaded, points).select("id", "risk_score")
    assert before.exceptAll(after).isEmpty()


def test_hard_class_instead_of_probability(points, small_run):
    scored = training.score(small_run[1].model, points, rf_mode="label")
    wrong = F.abs(
        F.col("risk_score") - 0.7 * (1 - F.col("iforest_prediction")) - 0.3 * F.col("rf_prediction")
    ) > 1e-12
    assert scored.filter(wrong).isEmpty()


def test_without_labels_only_the_isolation_forest_is_trained(points):
    unlabelled = points.withColumn("label", F.lit(None).cast("int"))
    run = training.train(unlabelled, "v", features="features", key="id", trees=5, depth=3)
    assert len(run.model.stages) == 1
    scored = training.score(run.model, points)
    assert scored.filter("abs(risk_score + iforest_score) > 1e-12").isEmpty()


def test_rows_without_label_still_train_the_isolation_forest(points):
    partly = points.withColumn("label", F.when(F.col("id") % 2 == 0, F.col("label")))
    model = training.fit_ensemble(partly, features="features", key="id", trees=5, depth=3)
    assert len(model.stages) == 2
    whole = forest(numTrees=5).fit(points)
    assert nodes_of(model.stages[0]) == nodes_of(whole)


def test_risk_records_for_requests(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(40, len(S.SESSION_FEATURES)))
    values[0] += 9
    features = spark.createDataFrame(
        [(f"s{i}", *map(float, v)) for i, v in enumerate(values)],
        "session_id string, " + ", ".join(f"{n} double" for n in S.SESSION_FEATURES),
    )
    risks = materialise(risk.risk_table(risk.model_rows(features)), "risks")
    assert risks.count() == 40
    assert risks.orderBy(F.desc("risk_score")).first()["session_id"] == "s0"
    assert risks.filter("size(factors) != 3 or size(array_distinct(factors)) != 3").isEmpty()
    requests = spark.createDataFrame([("s0",), ("x",), ("",), (None,)], "session_id string")
    found = risk.assess(requests, risks, F.lit("2024-01-01").cast("timestamp")).collect()
    assert [(r["session_id"], r["timestamp"]) for r in found] == [
        ("s0", "2024-01-01T00:00:00.000000Z")
    ]


def test_retraining_follows_drift(points):
    options = dict(features="features", key="id", trees=3, depth=2)
    assert training.retrain_if_drifted(0.2, points, "v", **options) is None
    assert training.retrain_if_drifted(None, points, "v", **options) is None
    assert training.retrain_if_drifted(0.21, points, "v", **options) is not None


def test_no_drift_between_equal_sides(spark):
    rows = spark.createDataFrame([(x / 10,) for x in range(11)], "risk_score double")
    assert monitoring.drift_index(rows, rows).first()[0] == 0.0
    moved = spark.createDataFrame([(1.0,)], "risk_score double")
    assert monitoring.drift_index(rows, moved).first()[0] > S.ALERT_DRIFT


def test_monitoring_counts_the_bound_as_high(spark):
    rows = spark.createDataFrame(
        [(0.7, 1), (0.7, 0), (0.69, 1), (0.9, None)], "risk_score double, label int"
    )
    found = monitoring.metrics(rows).first()
    assert found["prediction_count"] == 4
    assert found["true_positive_rate"] == found["false_positive_rate"] == 0.25
    assert found["recall"] == 0.5 and found["fall_out"] == 1.0
    assert "recall" not in monitoring.metrics(rows, labelled=False).columns
    root = new_path(spark, "monitoring")
    monitoring.append_metrics(monitoring.metrics(rows), root, "v1", "2024-01-01T00:00:00")
    stored = spark.read.json(f"{root}/metrics/v1").first()
    assert stored["timestamp"] == "2024-01-01T00:00:00" and stored["prediction_count"] == 4
    empty = monitoring.metrics(rows.limit(0)).first()
    assert empty["prediction_count"] == 0 and empty["true_positive_rate"] is None


def test_components_are_orthogonal_and_ordered(spark, features):
    rng = np.random.default_rng(9)
    names = [f"f{i}" for i in range(6)]
    rows = spark.createDataFrame(
        [(f"s{i}", *map(float, r @ np.diag([1, 2, 3, 4, 5, 6]))) for i, r in
         enumerate(rng.normal(size=(80, 6)))],
        "session_id string, " + ", ".join(f"{n} double" for n in names),
    )
    built = feature_build.vectorise(rows, names)
    axes = built.model.stages[2].pc.toArray()
    assert axes.T @ axes == pytest.approx(np.eye(5), abs=1e-9)
    shares = built.model.stages[2].explainedVariance.toArray()
    assert list(shares) == sorted(shares, reverse=True) and shares.sum() <= 1.0
    scaled = np.array([r[0] for r in built.features.select(
        vector_to_array("scaled_features")).collect()])
    assert scaled.std(axis=0, ddof=1) == pytest.approx(np.ones(6))
