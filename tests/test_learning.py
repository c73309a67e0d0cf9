import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsift.operators import explain, forest, learn, neighbours
from flowsift.plans import detection
from flowsift.plans import fixtures as fx
from flowsift.plans import learning_queries as queries


@pytest.fixture(scope="module")
def blob(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    x[:30] += 6
    pdf = pd.DataFrame({"id": range(600), "v": list(x), "y": [1] * 30 + [0] * 570})
    return spark.createDataFrame(pdf).cache()


def test_isolation_forest_ranks_outliers_first(blob):
    model = forest.fit_isolation_forest(blob.where("y = 0"), "id", "v", trees=50)
    scored = blob.select("y", model.anomaly(F.col("v")).alias("a"), model.score(F.col("v")).alias("s")).toPandas()
    assert scored[scored.y == 1].a.min() > scored[scored.y == 0].a.median()
    assert scored.s.between(0, 1).all()
    flagged = blob.where("y = 0").select((model.decision(F.col("v")) < 0).cast("int").alias("f")).agg(F.avg("f")).first()[0]
    assert flagged == pytest.approx(0.05, abs=0.01)


def test_isolation_forest_does_not_depend_on_partitions(blob):
    a = forest.fit_isolation_forest(blob, "id", "v", trees=5)
    b = forest.fit_isolation_forest(blob.repartition(13), "id", "v", trees=5)
    pd.testing.assert_frame_equal(a.nodes, b.nodes)


@pytest.mark.parametrize("width", [1, 4, 40])
def test_forest_paths_equal_a_plain_walk(width):
    """By look-ups and level by level, to the bit; missing numbers go above every cut."""
    rng = np.random.default_rng(6)
    trees = [rng.normal(size=(n, width)).round(1) for n in (1, 2, 90, 256, 256)]
    nodes = pd.DataFrame(
        [(t, *n) for t, x in enumerate(trees) for n in forest._grow(x, 8, np.random.default_rng(t))],
        columns=["tree", "node", "feature", "threshold", "below", "above", "length"])
    tables = [g.reset_index(drop=True) for _, g in nodes.groupby("tree")]
    x = rng.normal(size=(300, width)).round(1) * 1.5
    x[3, 0], x[4] = np.nan, np.nan
    x[5, 0] = nodes.threshold[nodes.feature == 0].iloc[0]

    def path(table, row):
        at = 0
        while table.feature[at] >= 0:
            at = table.below[at] if row[table.feature[at]] <= table.threshold[at] else table.above[at]
        return table.length[at]

    want = np.zeros(len(x))
    for table in tables:
        want += [path(table, row) for row in x]
    paths = forest._Paths([forest._Tree(t) for t in tables])
    assert (paths.masks is None) == (width > forest._MOST_FEATURES) and (paths(x) == want).all()
    paths.masks = None
    assert (paths(x) == want).all()


def test_samples_of_a_large_table_are_full_and_spread(spark):
    rows = spark.range(20_000).select("id", F.array(F.col("id").cast("double")).alias("v"))
    drawn = forest.hash_samples(rows, "id", "v", trees=20, sample=16, seed=7).select("tree", F.col("v")[0].alias("x")).toPandas()
    assert (drawn.groupby("tree").size() == 16).all() and drawn.tree.nunique() == 20
    assert 8_000 < drawn.x.mean() < 12_000 and drawn.x.nunique() > 250


@pytest.mark.parametrize("make", [lambda: learn.random_forest(trees=15, depth=4), lambda: learn.boosted_trees(rounds=5, depth=3)])
def test_classifiers_and_attribution(blob, make):
    model = make().fit(learn.training_frame(blob, "v", "y"))
    scored = learn.attack_probability(model, blob, "v", "p").withColumn("shap", explain.attribution(model, F.col("v"), 4)).toPandas()
    assert scored[scored.y == 1].p.min() > scored[scored.y == 0].p.max()
    shap = np.stack(scored["shap"])
    raw = scored.p.to_numpy() if "RandomForest" in type(model).__name__ else np.log(scored.p / (1 - scored.p)).to_numpy() / 2
    base = raw - shap.sum(axis=1)  # score minus attributions is one constant: the mean score
    assert np.ptp(base) < 1e-6
    top = explain.top_features(blob.withColumn("s", F.array(*[F.lit(x) for x in (.1, -.5, .2, 0.)])), "s", list("abcd"), 2).first()
    assert [f["name"] for f in top["top_features"]] == ["b", "c"]


def test_folds_are_stratified(blob):
    folds = learn.stratified_folds(blob, "y", "id", 5).groupBy("y", "fold").count().toPandas()
    assert folds.groupby("y")["count"].agg(np.ptp).max() == 0 and len(folds) == 10


def test_search(blob):
    folded = learn.stratified_folds(learn.training_frame(blob, "v", "y"), "y", "id", 2)
    grid = learn.random_grid({"maxDepth": [1, 2, 3], "numTrees": [3, 5]}, 2)
    found = learn.search(learn.random_forest(), folded, grid, folds=2)
    assert len(grid) == 2 and max(found.avgMetrics) > 0.9


def test_known_areas_are_not_fitted_again(spark, blob):
    folded = learn.stratified_folds(learn.training_frame(blob, "v", "y"), "y", "id", 2).cache()
    assert folded.rdd.getNumPartitions() <= max(spark.sparkContext.defaultParallelism, 1)
    grid = [{"maxDepth": 1}, {"maxDepth": 2}]
    every = learn.fold_areas(learn.random_forest(trees=3), folded, grid, range(2))
    again = learn.fold_areas(None, None, grid, range(2), known=every)
    assert again == every
    part = learn.fold_areas(learn.random_forest(trees=3), folded, grid, range(2), known={(0, 0): 0.25})
    assert part[0, 0] == 0.25 and part.keys() == every.keys() and part[1, 1] == pytest.approx(every[1, 1])


def test_reconstruction_scores_outliers(blob):
    flat = blob.where("y = 0").withColumn("v", F.transform("v", lambda x: x))
    model = learn.fit_reconstruction(flat, "v", 2, 0.9)
    share = flat.select((model.error(F.col("v")) > model.threshold).cast("int").alias("o")).agg(F.avg("o")).first()[0]
    assert share == pytest.approx(0.1, abs=0.01)
    empty = flat.limit(1).select(model.score(F.lit(None).cast("array<double>")).alias("s")).first()
    assert empty["s"] == 0.0


def test_plane_is_fitted_on_every_row(spark):
    x = np.random.default_rng(3).normal(size=(4000, 3)) * [1, 5, 2] @ np.linalg.qr(np.random.default_rng(4).normal(size=(3, 3)))[0]
    df = spark.createDataFrame(pd.DataFrame({"id": range(4000), "v": list(x)}))
    got = learn.plane(df, "v", "id").orderBy("id").toPandas()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    axes = np.linalg.eigh(np.cov(z.T))[1][:, ::-1][:, :2]
    assert np.allclose(np.abs(got[["x", "y"]].to_numpy()), np.abs(z @ axes), atol=1e-6)


def test_class_plane_returns_every_row(spark, sf):
    got = queries.class_plane(spark, sf).toPandas()
    rows = fx.table(spark, sf, "embeddings").select("vec_id", "label").toPandas()
    assert sorted(zip(got.vec_id, got.label)) == sorted(zip(rows.vec_id, rows.label))


def test_pipeline_with_every_detector(spark, sf):
    source = fx.view(spark, sf, "payloads")
    detectors = {
        **detection.DETECTORS, "isolation_forest": detection.isolation_detector(100, trees=10),
        "transformer_ae": detection.temporal_detector(100, 8), "gnn_detector": detection.topology_detector(warmup=100),
    }
    decided = detection.decide_flows(source, fx.PATTERNS[3:4], detectors=detectors, timeout_us=fx.FLOW_TIMEOUT_US).cache()
    rows = decided.toPandas()
    assert rows["flow_id"].is_unique and rows["confidence"].between(0, 1).all()
    assert (rows[rows.gate == 1].confidence == 1).all() and rows[rows.gate == 2].gnn_detector.max() > 0
    alerts = detection.alerts_from(decided, fx.COOLDOWN_US)
    assert 0 < alerts.count() <= (rows.gate == 1).sum()
    summary = detection.replay_summary(source, decided).first()
    assert summary["packets"] == 1000 and summary["flows"] == len(rows)


@pytest.mark.parametrize("search", [{}, {"cell_rows": 40}, {"cell_rows": 40, "probe_rows": 25}])
def test_neighbours_are_exact(spark, search):
    x = np.random.default_rng(5).normal(size=(400, 3))
    x[:150] *= 0.01  # a dense spot
    df = spark.createDataFrame(pd.DataFrame({"id": range(400), "vec": list(x)}))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    got = {r["id"]: r["near"] for r in neighbours.nearest_neighbours(df, 5, **search).collect()}
    assert len(got) == 400
    for i, near in got.items():
        assert [n["id"] for n in near] == np.argsort(d[i], kind="stable")[:5].tolist()


def test_oversampling_balances_and_interpolates(spark):
    rng = np.random.default_rng(2)
    few = rng.normal(size=(37, 3))
    few[30:] = few[0]  # copies of one row
    pdf = pd.DataFrame({"v": list(np.vstack([few, rng.normal(size=(200, 3)) + 9])), "y": [1] * 37 + [0] * 200})
    df = spark.createDataFrame(pdf)
    new = neighbours.oversample(df, "v", "y", 1, cell_rows=10).toPandas()
    assert len(new) == 163 and (new.y == 1).all()
    made = np.stack(new["v"])
    for row in made:  # on a segment between two minority rows
        best = min(
            np.linalg.norm(row - (a + np.clip(np.dot(row - a, b - a) / max(np.dot(b - a, b - a), 1e-12), 0, 1) * (b - a)))
            for a in few[:30] for b in few[:30])
        assert best < 1e-9
    again = neighbours.oversample(df.repartition(5), "v", "y", 1, cell_rows=10).toPandas()
    assert np.allclose(np.sort(np.stack(again["v"]), axis=0), np.sort(made, axis=0))
    assert neighbours.oversample(df, "v", "y", 0).count() == 0
