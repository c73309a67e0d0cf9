"""Versions of a model over a run against a plain replay; batch similarity against brute force; halving against its rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.operators import graph, learn, refit, similar
from flowsift.plans import detection
from flowsift.plans import fixtures as fx


def _replay(x, model, every, window, warmup):
    """Flow after flow: fit when a version is due, score by what is there."""
    current, out = None, []
    for s in range(1, len(x) + 1):
        out.append(0.0 if current is None else float(model.score(current, x[s - 1:s])[0]))
        if s % every == 0 and s >= warmup:
            current = model.fit(x[max(0, s - window):s], s // every)
    return out


@pytest.mark.parametrize("model", [refit.zscore_model(), refit.forest_model(trees=5, sample=16), refit.reconstruction_model(k=2)])
@pytest.mark.parametrize("every,window,warmup", [(20, 50, 40), (7, 7, 1), (50, 30, 60)])
def test_versions_equal_a_replay(spark, model, every, window, warmup):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(205, 3)) * [1, 5, 0.1] + np.linspace(0, 4, 205)[:, None]
    x[::40] += 6
    df = spark.createDataFrame([(int(i) + 1, x[i].tolist()) for i in rng.permutation(205)], "seq long, vec array<double>").repartition(5)
    got = refit.refitted_scores(df, F.col("vec"), model, "score", every, window, warmup).orderBy("seq").collect()
    want = _replay(x, model, every, window, warmup)
    assert [r["seq"] for r in got] == list(range(1, 206))
    assert [r["score"] for r in got] == pytest.approx(want, abs=1e-9)
    assert len({round(v, 6) for v in want}) > 30
    versions = refit.fit_versions(df, F.col("vec"), model, every, window, warmup)
    assert sorted(r["epoch"] for r in versions.collect()) == [e for e in range(1, 205 // every + 1) if e * every >= warmup]
    assert refit.refitted_scores(df.limit(0), F.col("vec"), model, "score", every, window, warmup).count() == 0


def test_refitted_detectors_in_the_plan(spark, sf):
    packets = fx.view(spark, sf, "packets").withColumn("payload", F.lit("")).cache()
    added = {"zscore": detection.refitted_detector("zscore", refit.zscore_model()), "isolation_forest": detection.refitted_detector(
        "isolation_forest", refit.forest_model(trees=10), every=100, warmup=100)}
    decided = detection.decide_flows(packets, [], detectors=added, timeout_us=fx.FLOW_TIMEOUT_US).cache()
    early, late = (decided.where(c).agg(F.max("isolation_forest"), F.count(F.lit(1))).first() for c in ("seq <= 100", "seq > 100"))
    assert early[0] == 0 and early[1] == 100 and late[0] > 0.4
    assert decided.where("isolation_forest not between 0 and 1 or zscore not between 0 and 1").count() == 0


@pytest.mark.parametrize("block_rows", [20_000, 30])
def test_nearest_to_each_brute(spark, block_rows):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 8))
    x[7], x[8], x[9] = x[6], x[6] * 3, 0.0
    ids = [f"v{i:03d}" for i in range(120)]
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in zip(ids, x)), ("none", None)], "vec_id string, embedding array<float>")
    x = x.astype(np.float32).astype(np.float64)
    size = np.linalg.norm(x, axis=1)
    unit = x / np.where(size > 0, size, 1)[:, None]
    found = similar.nearest_to_each(df, df.where("vec_id < 'v040'"), 4, block_rows=block_rows).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append((r["neighbour"], round(r["distance"], 9)))
    assert len(got) == 40
    for i in range(40):
        order = sorted((j for j in range(120) if j != i), key=lambda j: (round(1 - unit[i] @ unit[j], 12), ids[j]))[:4]
        assert [n for n, _ in got[ids[i]]] == [ids[j] for j in order]
        assert [d for _, d in got[ids[i]]] == pytest.approx([1 - unit[i] @ unit[j] for j in order], abs=1e-8)


def test_fan_sketches_are_merged_over_windows(spark):
    """Sketches of single hours, united, against the exact count of the same hours; one host talks to very many."""
    rows = [("hub", f"h{i % 9000}", i * 400_000) for i in range(40_000)] + [(f"h{i}", "hub", i * 1_000_000) for i in range(500)]
    flows = spark.createDataFrame(rows, "src_ip string, dst_ip string, end_us long")
    hour = 3_600_000_000
    sketches = graph.fan_sketches(flows, hour).cache()
    for since, until in ((0, 0), (1, 3), (None, None)):
        exact = flows.where(f"end_us >= {(since or 0) * hour} and end_us < {((until if until is not None else 99) + 1) * hour}")
        want = {r["ip"]: (r["fan_out"], r["fan_in"]) for r in graph.fan(exact).collect()}
        got = {r["ip"]: (r["fan_out"], r["fan_in"]) for r in graph.fan_over(sketches, since, until).collect()}
        assert set(got) == set(want)
        for ip, counts in want.items():
            assert all(abs(a - b) <= 0.5 + 4 * 0.0163 * b for a, b in zip(got[ip], counts)), (ip, got[ip], counts)
    assert sketches.where("octet_length(out) > 5000").count() == 0  # whatever the number of peers


def test_halving_keeps_the_better_points(monkeypatch):
    quality = [0.6, 0.9, 0.5, 0.8, 0.7]
    seen = []

    def areas(estimator, folded, grid, folds, points=None, parallelism=4):
        seen.append((tuple(points), tuple(folds)))
        return {(p, f): quality[p] + 0.001 * f for p in points for f in folds}

    monkeypatch.setattr(learn, "fold_areas", areas)
    found = learn.halving_search(None, None, [{}] * 5, folds=4)
    assert found.best == 1 and found.fits == 5 + 3 + 2 + 2
    assert [p for p, _ in seen] == [(0, 1, 2, 3, 4), (1, 3, 4), (1, 3), (1, 3)]
    assert {p: len(a) for p, a in found.areas.items()} == {0: 1, 1: 4, 2: 1, 3: 4, 4: 2}
