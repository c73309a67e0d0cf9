"""Whole-flow matching over split flows and micro-batches; state that leaves by itself."""

import random

import pytest
from pyspark.sql import functions as F

from flowsift.functions.packets import FLOW_KEY
from flowsift.operators import flows, gates
from flowsift.streaming import jobs

S = 1_000_000
NAMES = "packet_id long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, length long, flags int, payload string"
RULES = [("shell", "CMD.exe"), ("long", "abcabcabd"), ("same", "cmd.exe"), ("one", "~")]


def _packets(seed, n=600):
    """Packets of a few keys, one with a third of them; payloads cut patterns into pieces of 0 to 4 characters."""
    rng = random.Random(seed)
    text = {}
    rows = []
    for i in range(n):
        key = 0 if rng.random() < 0.34 else rng.randint(1, 9)
        if not text.get(key):
            text[key] = rng.choice(["xcmd.EXEy", "abcabcabcabd", "cmd.ex", "e", "abcabca", "harmless ", "bd", "é~" if rng.random() < 0.1 else "é", "CMD", ".exe"])
        take = rng.randint(0, 4)
        piece, text[key] = text[key][:take], text[key][take:]
        forth = rng.random() < 0.5
        ends = ("10.0.0.1", f"10.0.1.{key}", 1, 80) if forth else (f"10.0.1.{key}", "10.0.0.1", 80, 1)
        rows.append((i, rng.randint(0, 40) * S // 2 + i * S // 4, *ends, 6, 10, rng.randint(0, 31), rng.choice([piece, piece, piece or None])))
    return sorted(rows, key=lambda r: (r[1], r[0]))


def _replay(rows, timeout_us=10 * S):
    """Flow id to gate, one packet after the other, payloads put together."""
    open_, done = {}, {}
    for r in rows:
        key = min((r[2], r[4]), (r[3], r[5])), max((r[2], r[4]), (r[3], r[5]))
        flow = open_.setdefault(key, [r[1], r[0], ""])
        flow[1], flow[2] = min(flow[1], r[0]), flow[2] + (r[9] or "")
        if r[1] - flow[0] > timeout_us:
            done[flow[1]] = (open_.pop(key)[2], "timeout")
    done |= {f[1]: (f[2], "flush") for f in open_.values()}
    return {i: (1 if any(p.lower() in text.lower() for _, p in RULES) else 2, how) for i, (text, how) in done.items()}


@pytest.mark.parametrize("split", [{}, {"hot_rows": 50, "chunk_rows": 400}, {"hot_rows": 20, "chunk_rows": 7}, {"hot_rows": 1, "chunk_rows": 3, "fan_in": 2}])
@pytest.mark.parametrize("binary", [False, True])
def test_gate_of_a_split_flow(spark, split, binary):
    rows = _packets(1)
    df = spark.createDataFrame(rows, NAMES)
    if binary:
        df = df.withColumn("payload", F.encode("payload", "UTF-8"))
    got = {r["flow_id"]: (r["gate"], r["close_reason"]) for r in gates.gated_flows(df, RULES, 10 * S, **split).collect()}
    want = _replay(rows)
    assert got == want and {1, 2} == {g for g, _ in got.values()}


def test_long_flow_is_one_match_over_many_tasks(spark):
    """One flow holds nearly all packets; the only match lies in one-character packets of several tasks."""
    text = "." * 400 + "abcabcabd" + "." * 400
    rows = [(i, i, "a", "b", 1, 2, 6, 1, 0, c) for i, c in enumerate(text)] + [(9000 + i, i, "c", "d", 1, 2, 6, 1, 0, "abcabcab") for i in range(3)]
    df = spark.createDataFrame(rows, NAMES)
    for chunk in (1000, 50, 4):
        got = {r["flow_id"]: r["gate"] for r in gates.gated_flows(df, RULES[1:2], 3600 * S, hot_rows=100, chunk_rows=chunk).collect()}
        assert got == {0: 1, 9000: 2}


def _stream(spark, folder, rows, cuts):
    """The packets as files that end at the given places, read one a micro-batch."""
    # the first watermark is the epoch: rows at it would be late
    df = spark.createDataFrame(rows, NAMES).withColumn("ts_us", F.col("ts_us") + 3600 * S).withColumn("ts", F.timestamp_micros("ts_us")).select(*jobs.PACKET.names)
    ids = [r[0] for r in rows]
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        df.where(F.col("packet_id").isin(ids[a:b])).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return jobs.packet_stream(spark, f"{folder}/in", files=1)


def _run(stream, name, folder):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None and not query.isActive
    return stream.sparkSession.table(name).collect()


@pytest.mark.parametrize("cuts", [[], [200, 201, 350], [40, 41, 42, 43, 300, 599]])
def test_streamed_gate_equals_batch(spark, folder, cuts):
    rows = _packets(2)
    stream = jobs.flow_stream(_stream(spark, folder, rows, cuts), 10 * S, idle_us=None, late="1 day", rules=RULES)
    got = {r["flow_id"]: r["gate"] for r in _run(stream, f"gated_{len(cuts)}", folder)}
    batch = gates.gated_flows(spark.createDataFrame(rows, NAMES), RULES, 10 * S).where("close_reason = 'timeout'").collect()
    assert got == {r["flow_id"]: r["gate"] for r in batch} == {i: g for i, (g, how) in _replay(rows).items() if how == "timeout"}
    assert set(got.values()) == {1, 2}


def test_flow_leaves_when_its_timer_fires(spark, folder):
    """A key without further rows is emitted as idle, with the match that two micro-batches share; its state is gone."""
    first = [(1, 0, "a", "b", 1, 2, 6, 10, 2, "cm"), (2, S, "c", "d", 1, 2, 6, 10, 0, "x")]
    second = [(3, 2 * S, "a", "b", 1, 2, 6, 10, 0, "d.exe"), (4, 3 * S, "c", "d", 1, 2, 6, 10, 0, "x")]
    later = [(5 + i, (100 + i) * S, "e", "f", 1, 2, 6, 10, 0, "x") for i in range(2)]
    again = [(9, 300 * S, "a", "b", 1, 2, 6, 10, 0, ".exe")]
    rows = [*first, *second, *later, *again]
    stream = jobs.flow_stream(_stream(spark, folder, rows, [2, 4, 5, 6]), 60 * S, idle_us=30 * S, late="0 seconds", rules=RULES)
    got = {r["flow_id"]: (r["close_reason"], r["gate"], r["packet_count"], r["start_us"]) for r in _run(stream, "timers", folder)}
    assert got[1] == ("idle", 1, 2, 3600 * S) and got[2] == ("idle", 2, 2, 3601 * S)
    assert got[5][0] == "idle" and got[5][2] == 2
    # the key's later packet began a new flow, which has not ended
    assert 9 not in got


def test_cooldown_state_leaves_without_new_rows(spark, folder):
    rows = [(0, 0, "a", "b", 1, 2, 6, 1, 0, ""), (1, 5 * S, "a", "b", 1, 2, 6, 1, 0, ""), (2, 50 * S, "c", "d", 1, 2, 6, 1, 0, ""),
            (3, 90 * S, "c", "d", 1, 2, 6, 1, 0, ""), (4, 91 * S, "a", "b", 1, 2, 6, 1, 0, "")]
    alerts = _stream(spark, folder, rows, [1, 2, 3, 4]).select(F.concat(F.lit("a"), "packet_id").alias("alert_id"), "ts", "ts_us", "src_ip", "dst_ip", "dst_port")
    stream = jobs.cooldown_stream(alerts, 30 * S, late="0 seconds")
    query = stream.writeStream.format("memory").queryName("cooled").outputMode("append").option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    assert sorted(r["alert_id"] for r in spark.table("cooled").collect()) == ["a0", "a2", "a3", "a4"]
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert kept[-1] <= 4 * len(FLOW_KEY)


def test_batch_flows_are_unchanged(spark):
    rows = _packets(3)
    df = spark.createDataFrame(rows, NAMES)
    plain = flows.assemble_flows(df, 10 * S).select("flow_id", "start_us", "end_us", "packet_count").collect()
    gated = gates.gated_flows(df, RULES, 10 * S, hot_rows=20, chunk_rows=9).select("flow_id", "start_us", "end_us", "packet_count").collect()
    assert sorted(plain) == sorted(gated)
