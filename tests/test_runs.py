"""Anchored runs against a plain replay, and independence from the split."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsift.operators.anchors import FRESH, Carry, RunRule, assign_runs

FLOW = RunRule(10, strict=True, consume=True)
COOL = RunRule(10, strict=False, consume=False)


def replay(ts, rule, state=FRESH):
    anchors, flags = [], []
    for t in ts:
        start = state == FRESH
        if not start:
            out = t - state > rule.limit if rule.strict else t - state >= rule.limit
            if out and not rule.consume:
                start = True
        if start:
            state = t
        anchors.append(state)
        flags.append(start)
        if not start and rule.consume and t - state > rule.limit:
            state = FRESH
    return anchors, flags, state


@pytest.mark.parametrize("rule", [FLOW, COOL])
@pytest.mark.parametrize("seed", range(30))
def test_walk_and_carry_equal_replay(rule, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    ts = np.cumsum(rng.choice([0, 1, 3, 5, 10, 11, 12, 40], n, p=[.2, .3, .2, .1, .05, .05, .05, .05])).astype(np.int64) + 100
    none = np.zeros(n, dtype=bool)
    f = rule.carry(ts)
    for state in [FRESH, *range(int(ts[0]) - 15, int(ts[0]) + 1)]:
        want = replay(ts.tolist(), rule, state)
        anchor, flag, leaving = rule.walk(ts, none, state)
        assert (anchor.tolist(), flag.tolist(), leaving) == want
        assert int(f(np.array([state]))[0]) == want[2]
    for cut in range(1, n):  # composing two parts equals the whole
        g = rule.carry(ts[:cut]).then(rule.carry(ts[cut:]))
        for state in [FRESH, *range(int(ts[0]) - 15, int(ts[0]) + 1)]:
            assert int(g(np.array([state]))[0]) == replay(ts.tolist(), rule, state)[2]


def test_constant_carry():
    const = Carry(np.array([], np.int64), np.array([7], np.int64), 7, "right")
    assert const(np.array([FRESH, 1, 99])).tolist() == [7, 7, 7]


@pytest.mark.parametrize("gap,runs", [(10, 1), (11, 1), (12, 1)])
def test_closing_row_belongs_to_the_closed_flow(gap, runs):
    anchors, _, state = replay([0, gap], FLOW)
    assert len(set(anchors)) == runs
    assert (state == FRESH) == (gap > 10)


def test_cooldown_boundary():
    assert replay([0, 9, 10, 19, 20], COOL)[1] == [True, False, True, False, True]


def _rows(spark, seed=0, n=3000):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.4, "hot", np.char.add("k", rng.integers(0, 50, n).astype(str)))
    pdf = pd.DataFrame({"k": key, "t": rng.integers(0, 4000, n), "id": np.arange(n)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("rule", [FLOW, COOL])
@pytest.mark.parametrize("split", [
    {}, {"hot_rows": 500, "chunk_rows": 100_000}, {"hot_rows": 500, "chunk_rows": 60, "fan_in": 3}, {"hot_rows": 1, "chunk_rows": 200},
])
def test_result_does_not_depend_on_the_split(spark, rule, split):
    pdf, df = _rows(spark)
    want = []
    for k, g in pdf.sort_values(["t", "id"]).groupby("k"):
        anchors, flags, _ = replay(g["t"].tolist(), rule)
        want += list(zip(g["id"], anchors, flags))
    got = assign_runs(df, ["k"], "t", ["id"], rule, **split).select("id", "anchor_us", "is_anchor").collect()
    assert sorted(tuple(r) for r in got) == sorted((int(i), int(a), bool(f)) for i, a, f in want)


def test_state_crosses_arrow_batches(spark):
    pdf, df = _rows(spark, seed=1)
    whole = assign_runs(df, ["k"], "t", ["id"], FLOW).orderBy("id").toPandas()
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = assign_runs(df, ["k"], "t", ["id"], FLOW).orderBy("id").toPandas()
        split = assign_runs(df, ["k"], "t", ["id"], FLOW, hot_rows=100, chunk_rows=150).orderBy("id").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    pd.testing.assert_frame_equal(whole, small)
    pd.testing.assert_frame_equal(whole, split[whole.columns])


def test_limit_must_be_positive(spark):
    _, df = _rows(spark, n=10)
    with pytest.raises(ValueError):
        assign_runs(df, ["k"], "t", ["id"], RunRule(0, True, True))
