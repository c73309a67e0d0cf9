"""Boundaries and invariances of the operators."""

import math
import random
import time
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsift.functions import labels as L
from flowsift.functions import packets as P
from flowsift.functions import vectors as V
from flowsift.operators import alerts as A
from flowsift.operators import baseline, connections, ensemble, evaluate, flows, gates, graph, ordering, signatures, similar, ticks
from flowsift.plans import fixtures as fx
from flowsift.session import cut_lineage

PACKET = "packet_id long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, length long, flags int"
S = 1_000_000


def packets(spark, rows):
    return spark.createDataFrame([
        (i, int(t * S), *(("1.1.1.1", "2.2.2.2", 10, 80) if fwd else ("2.2.2.2", "1.1.1.1", 80, 10)), 6, n, flags)
        for i, (t, fwd, n, flags) in enumerate(rows)
    ], PACKET)


def test_single_packet_flow(spark):
    [f] = flows.with_basic_features(flows.assemble_flows(packets(spark, [(5, True, 100, 2)]))).collect()
    assert (f["packet_count"], f["duration"], f["close_reason"]) == (1, 0.001, "flush")
    assert f["bytes_per_second"] == pytest.approx(100_000) and f["serror_rate"] == 1.0


def test_directions_and_timeout(spark):
    rows = [(0, True, 100, 2), (60, False, 50, 18), (60.5, True, 10, 16), (61, True, 7, 0)]
    got = sorted(flows.assemble_flows(packets(spark, rows)).collect(), key=lambda f: f["start_us"])
    assert [(f["packet_count"], f["src_bytes"], f["dst_bytes"], f["close_reason"]) for f in got] == [
        (3, 110, 50, "timeout"), (1, 7, 0, "flush")]


def test_packet_cap_leaves_flags_alone(spark):
    [f] = flows.assemble_flows(packets(spark, [(0.1 * i, True, 1, 2) for i in range(5)]), packet_cap=3).collect()
    assert (f["packet_count"], f["flag_syn"], f["src_bytes"]) == (3, 5, 5)


def test_idle_sessions_gap_is_strict(spark):
    got = flows.idle_sessions(packets(spark, [(0, True, 1, 0), (60, False, 1, 0), (120.000001, True, 1, 0)]))
    assert sorted(r["packet_count"] for r in got.collect()) == [1, 2]


def _flows(spark, rows):
    schema = "end_us long, start_us long, src_ip string, src_port int, dst_ip string, dst_port int, protocol int"
    return spark.createDataFrame([(e, s, "a", i, d, p, 6) for i, (e, s, d, p) in enumerate(rows)], schema)


def test_connection_windows_equal_a_replay(spark):
    rng = np.random.default_rng(3)
    rows = sorted((int(e), 0, "hot" if rng.random() < .5 else str(rng.integers(4)), int(rng.integers(3))) for e in rng.integers(0, 3000, 700))
    by_time, by_conn, want = deque(), deque(maxlen=7), {}
    for i, (e, _, d, p) in sorted(enumerate(rows), key=lambda r: (r[1][0], r[1][1], "a", r[0])):
        while by_time and by_time[0][0] < e - 50:
            by_time.popleft()
        same = sum(q == p for _, q in by_conn)
        n = len(by_conn)
        want[i] = (sum(x == d for _, x, _ in by_time), sum(q == p for _, _, q in by_time), sum(x == d for x, _ in by_conn),
                   sum((x, q) == (d, p) for x, q in by_conn), same / n if n else 0.0, (n - same) / n if n else 0.0)
        by_time.append((e, d, p))
        by_conn.append((d, p))
    numbered = connections.number_flows(_flows(spark, rows), partitions=5)
    got = connections.with_host_counts(connections.with_time_counts(numbered, 50), 7, block=20).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["count"], r["srv_count"], r["dst_host_count"], r["dst_host_srv_count"]) == want[r["src_port"]][:4]
        assert (r["same_srv_rate"], r["diff_srv_rate"]) == pytest.approx(want[r["src_port"]][4:])
    burst = connections.earlier_in_time(numbered, ["dst_ip"], "count", 50, burst_rows=10)
    assert {r["src_port"]: r["count"] for r in burst.collect()} == {i: w[0] for i, w in want.items()}


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_order_numbers_do_not_depend_on_partitions(spark, partitions):
    df = spark.range(500).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(40)))
    got = ordering.dense_seq(df, ["x", "id"], partitions=partitions).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(1, 501))
    assert [(r["x"], r["id"]) for r in got] == sorted((r["x"], r["id"]) for r in got)
    keyed = ordering.keyed_seq(df, ["x"], ["id"], partitions=partitions).toPandas()
    assert (keyed.sort_values("id").groupby("x").cumcount() + 1 == keyed.sort_values("id")["kseq"]).all()
    sums = ordering.running_sums(df, ["id"], {"s": F.col("x")}, partitions).orderBy("id").toPandas()
    assert (sums["x"].cumsum() == sums["s"]).all()


def test_percentiles(spark):
    x = np.random.default_rng(0).normal(size=301)
    got = ordering.exact_percentiles(spark.createDataFrame(pd.DataFrame({"x": x})), "x", [0, .1, .5, .99, 1])
    assert got == pytest.approx(np.percentile(x, [0, 10, 50, 99, 100]).tolist())
    # more rows than the sketch resolves, with a value that a third of them share
    y = np.random.default_rng(1).exponential(size=60_000)
    y[:20_000] = 0.7
    df = spark.createDataFrame(pd.DataFrame({"x": y}))
    parts = [0.0, 0.05, 0.333, 0.5, 0.61, 0.9, 0.9999, 1.0]
    want = np.percentile(y, [100 * p for p in parts]).tolist()
    assert ordering.exact_percentiles(df, "x", parts, small=0) == pytest.approx(want)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_running_zscore_equals_welford(spark, partitions):
    x = np.random.default_rng(1).normal(size=(200, 3)) * [1, 100, 1e-3] + [0, 1e6, 5]
    x[150] += [50, 0, 1]
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))).withColumn("id", F.monotonically_increasing_id())
    order = df.orderBy("id").toPandas()
    df = spark.createDataFrame(order.assign(seq=range(1, 201)))
    n, mean, m2, want = 0, np.zeros(3), np.zeros(3), []
    for row in order[list("abc")].to_numpy():
        n += 1
        d = row - mean
        mean = mean + d / n
        m2 = m2 + d * (row - mean)
        std = np.sqrt(np.maximum(m2 / max(n - 1, 1), 1e-10))
        want.append(0.0 if n < 30 else float((np.abs((row - mean) / std) > 3).mean()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = baseline.running_zscore(df, list("abc")).orderBy("seq").toPandas()["zscore"].tolist()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == pytest.approx(want)
    assert got[28] == 0.0 and max(got) > 0


# --- signatures and gates --------------------------------------------------------------

RULES = [("1", "he"), ("2", "she"), ("3", "hers"), ("4", "' OR '1'='1"), ("5", "é")]
TEXTS = [(0, "usHERs"), (1, "admin' or '1'='1&x"), (2, "clean"), (3, None), (4, "xÉhe"), (5, "")]


def _plain(text):
    found = []
    raw = (text or "").lower().encode()
    for rid, p in RULES:
        q, at = p.lower().encode(), raw.find(p.lower().encode())
        while at >= 0:
            found.append((rid, at, at + len(q)))
            at = raw.find(q, at + 1)
    return found


def test_matcher(spark):
    df = spark.createDataFrame(TEXTS, "id int, text string")
    offsets = signatures.signature_offsets(df, "text", RULES).collect()
    assert sorted((r["id"], r["rule_id"], r["start"], r["stop"]) for r in offsets) == sorted((i, *m) for i, t in TEXTS for m in _plain(t))
    hits = {(r["id"], r["rule_id"]) for r in signatures.signature_hits(df, "text", RULES).collect()}
    assert hits == {(i, m[0]) for i, t in TEXTS for m in _plain(t)}
    any_hit = {r[0]: r[1] for r in df.select("id", signatures.signature_any(F.col("text"), RULES)).collect()}
    assert any_hit == {i: bool(_plain(t)) for i, t in TEXTS}
    names = {r["id"]: r["names"] for r in signatures.signature_names(df, "text", RULES).collect()}
    assert names[0] == ["she", "he", "hers"] and names[2] == []


def test_many_patterns(spark):
    rules = [(f"r{i}", f"word{i}x") for i in range(200)]
    df = spark.createDataFrame([(1, "a WORD7X b word150x"), (2, None), (3, "word200x")], "id int, text string")
    assert sorted((r["id"], r["rule_id"]) for r in signatures.signature_hits(df, "text", rules).collect()) == [(1, "r150"), (1, "r7")]
    names = {r["id"]: r["names"] for r in signatures.signature_names(df, "text", rules).collect()}
    assert names == {1: ["word7x", "word150x"], 2: [], 3: []}
    assert [r[0] for r in df.orderBy("id").select(signatures.signature_any(F.col("text"), rules)).collect()] == [True, False, False]


def test_gate_sees_the_whole_payload(spark):
    parts = {1: ["xxcm", "", "d.", "exeyy"], 2: ["cmd", "-", ".exe"], 3: ["z" * 70_000, "q" * 70_000 + "CMD.EXE"], 4: [None, "none"]}
    rows = [
        (10 * k + i, S * i, "10.0.0.1", f"10.0.1.{k}", 1, 80, 6, 1, 0, p) for k, texts in parts.items() for i, p in enumerate(texts)
    ]
    names = "packet_id long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, length long, flags int, payload string"
    df = spark.createDataFrame(rows, names)
    raw = df.withColumn("payload", F.encode("payload", "UTF-8"))
    for packets_ in (df, raw):
        got = gates.gated_flows(packets_, [("x", "cmd.exe"), ("e", "")], 60 * S).orderBy("dst_ip").collect()
        assert [r["gate"] for r in got] == [1, 2, 1, 2] and "matched" not in got[0].asDict()
    assert {r["gate"] for r in gates.gated_flows(df, [], 60 * S).collect()} == {2}
    assert [r["gate"] for r in gates.gated_flows(df, [("q", "q")], 60 * S).orderBy("dst_ip").collect()] == [2, 2, 1, 2]


def test_names_look_each_pattern_up_once(spark):
    """The text is folded once, and no pattern is searched twice."""
    df = spark.createDataFrame([(1, "ushers", "x"), (2, None, "y"), (3, "", "z")], "id int, text string, _folded string")
    named = signatures.signature_names(df, "text", RULES)
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(text") == 1 and plan.count("locate(") + plan.count("position(") == len([p for _, p in RULES if p])
    assert named.columns == ["id", "text", "_folded", "names"] and {r["id"]: r["names"] for r in named.collect()}[1][:2] == ["she", "he"]


def test_offsets_are_searched_in_chunks_of_texts(spark, monkeypatch):
    """Long and short texts, patterns of one byte, matches in pieces; nothing matches across two texts."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abAé\0 ") for _ in range(rng.choice([0, 1, 2, 50, 400]))) for _ in range(300)]
    rules = [("a", "a"), ("ab", "AB"), ("aba", "aba"), ("é", "É"), ("nul", "b\0"), ("same", "ab")]
    got = signatures._Finder([signatures._fold(p) for _, p in rules])([signatures._folded_bytes(t) for t in texts])
    want = []
    for row, t in enumerate(texts):
        raw = t.lower().encode()
        for number, (_, p) in enumerate(rules):
            p = p.lower().encode()
            want += [(row, i + len(p), i, number) for i in range(len(raw)) if raw.startswith(p, i)]
    assert list(zip(*(c.tolist() for c in got))) == sorted(want)
    monkeypatch.setattr(signatures, "_BYTES_AT_ONCE", 700)
    monkeypatch.setattr(signatures, "_MATCHES_PER_BATCH", 50)
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "id int, text string")
    found = signatures.signature_offsets(df, "text", rules).collect()
    assert sorted((r["id"], r["stop"], r["start"], r["rule_id"]) for r in found) == sorted((i, e, s, rules[n][0]) for i, e, s, n in want)


def test_address_ranges(spark):
    df = spark.createDataFrame([("10.0.0.1", "x"), ("10.0.0.150", "x"), ("fe80::1", "10.0.1.7"), (None, "10.0.0.300")], "src_ip string, dst_ip string")
    kept = lambda net: [r["src_ip"] for r in P.packet_filter(df, net=net).collect()]
    assert kept("10.0.0.1") == ["10.0.0.1"] and kept("10.0.0.0/25") == ["10.0.0.1"]
    assert kept("10.0.0.0/23") == ["10.0.0.1", "10.0.0.150", "fe80::1"]


def test_percentiles_ignore_nan(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1000)] + [(float("nan"),), (None,)], "x double")
    for small in (100_000, 0):
        assert ordering.exact_percentiles(df, "x", [0.0, 0.9, 1.0], small=small) == pytest.approx([0.0, 899.1, 999.0])


def test_bytes_and_empty_rules(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xffCMD.EXE\x90"))], "id int, text binary")
    [m] = signatures.signature_offsets(df, "text", [("x", "cmd.exe")]).collect()
    assert (m["start"], m["stop"]) == (1, 8)
    assert not df.select(signatures.signature_any(F.col("text"), []).alias("h")).first()["h"]
    raw = spark.createDataFrame([(1, "CAFÉ".encode()), (2, "caFé".encode()), (3, b"\xe9")], "id int, text binary")
    rules = [("x", "CAFé"), ("y", "zz")]
    hit = signatures.signature_any(F.col("text"), rules, binary=True)
    assert [r["h"] for r in raw.orderBy("id").select(hit.alias("h")).collect()] == [False, True, False]
    for inline in (signatures.signature_hits, signatures.signature_offsets):
        assert [r["id"] for r in inline(raw, "text", rules).collect()] == [2]
    pieces = spark.createDataFrame([("k", 1, b"\xff\x00"), ("k", 2, b"\xe9Z")], "k string, o int, p binary")
    assert bytes(gates.reassemble(pieces, ["k"], ["o"], "p", cap=3).first()["payload"]) == b"\xff\x00\xe9"
    assert signatures.signature_hits(df, "text", []).count() == 0


def test_reassembly_cap_and_order(spark):
    df = spark.createDataFrame([("k", 2, "cd"), ("k", 1, "ab"), ("k", 3, ""), ("k", 4, "efgh"), ("j", 1, "z")], "k string, o int, p string")
    for hot in (100, 1):  # whole keys, and keys cut per salt first
        got = {r["k"]: r["payload"] for r in gates.reassemble(df, ["k"], ["o"], "p", cap=5, hot_rows=hot).collect()}
        assert got == {"k": "abcde", "j": "z"}


@pytest.mark.parametrize("split", [{}, {"hot_rows": 1, "chunk_rows": 2}])
def test_flow_payload_is_capped_in_order(spark, split):
    df = packets(spark, [(i, i % 2 == 0, 1, 0) for i in range(9)] + [(70, True, 1, 0), (71, True, 1, 0)])
    df = df.withColumn("payload", F.when(F.col("packet_id") == 3, "").otherwise(F.concat(F.lit("p"), "packet_id")))
    got = {r["start_us"]: r["payload"] for r in flows.assemble_flows(df, payload_cap=7, **split).collect()}
    assert got == {0: "p0p1p2p", 71 * S: "p10"}


def test_host_pair_buffer_goes_to_the_first_flow_to_close(spark):
    rows = [(0, 0, "a", "b", 1, 80), (1, 10 * S, "a", "b", 2, 80), (2, 70 * S, "a", "b", 2, 80), (3, 80 * S, "a", "b", 1, 80), (4, 81 * S, "a", "b", 3, 80)]
    df = spark.createDataFrame([(*r, 6, 1, 0, f"p{r[0]}") for r in rows], PACKET + ", payload string")
    got = {(r["a_port"], r["start_us"]): r["payload"] for r in gates.host_pair_payloads(df, 60 * S).collect()}
    # port 1 closes at 80 s; port 2 (start 10 s) needs > 70 s and stays open
    assert got == {(1, 0): "p0p1p2p3", (2, 10 * S): "p4"}


def _pair_buffers(rows, timeout):
    """Buffers of host pairs, packet by packet."""
    flows, epoch, marked, key = {}, {}, [], lambda r: min((r[2], r[4]), (r[3], r[5])) + max((r[2], r[4]), (r[3], r[5]))
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        pair = (min(r[2], r[3]), max(r[2], r[3]))
        start = flows.setdefault(key(r), r[1])
        closes = r[1] - start > timeout
        marked.append((pair, epoch.get(pair, 0), (key(r), start), closes, r))
        if closes:
            epoch[pair] = epoch.get(pair, 0) + 1
            del flows[key(r)]
    ids, texts, takes, open_ = {}, {}, {}, {}
    for pair, e, flow, closes, r in marked:
        ids[flow] = min(ids.get(flow, r[0]), r[0])
        texts.setdefault((pair, e), []).append(r[-1] or "")
        if closes:
            takes[pair, e] = flow
    closed = set(takes.values())
    for pair, _, flow, _, _ in marked:
        if flow not in closed:
            open_[pair] = min(open_.get(pair, (flow[1], ids[flow], flow)), (flow[1], ids[flow], flow))
    takes |= {(pair, epoch.get(pair, 0)): flow for pair, (_, _, flow) in open_.items()}
    whole = {at: "".join(t) for at, t in texts.items()}
    return sorted((ids[flow], flow[1], whole[at]) for at, flow in takes.items() if whole.get(at))


def test_host_pair_payloads_move_once(spark, monkeypatch):
    """Against a plain walk; no payload goes through the sorts that number the epochs."""
    rng = random.Random(4)
    rows = []
    for i in range(600):
        a, b = f"h{rng.randrange(2)}", f"h{rng.randrange(2, 5)}"
        ends = (a, b, rng.randrange(3), 80) if rng.random() < 0.5 else (b, a, 80, rng.randrange(3))
        rows.append((i, rng.randrange(400) * S, *ends, 6, 1, 0, rng.choice([None, "", f"<{i}>", f"é{i}" * 40])))
    df = spark.createDataFrame(rows, PACKET + ", payload string")
    sums = gates.running_sums

    def thin(frame, *args, **kwargs):
        assert "payload" not in frame.columns
        return sums(frame, *args, **kwargs)

    monkeypatch.setattr(gates, "running_sums", thin)
    monkeypatch.setattr(gates, "_PARTS_PER_TASK", 400, raising=False)
    got = gates.host_pair_payloads(df.withColumn("payload", F.encode("payload", "UTF-8")), 60 * S).collect()
    assert sorted((r["flow_id"], r["start_us"], bytes(r["payload"]).decode()) for r in got) == _pair_buffers(rows, 60 * S)
    # packets that come twice lose no text and add none
    twice = gates.host_pair_payloads(df.unionByName(df), 60 * S).agg(F.sum(F.length("payload"))).first()[0]
    assert twice <= 2 * sum(len(r[-1] or "") for r in rows) and twice > 0


def test_host_pair_payloads_move_in_waves(spark, monkeypatch):
    """No wave holds more than its bytes and one part; buffers do not depend on waves, parts or Arrow batches."""
    rng = random.Random(5)
    rows = []
    for i in range(500):
        a, b = f"h{rng.randrange(2)}", f"h{rng.randrange(2, 5)}"
        rows.append((i, rng.randrange(500) * S, a, b, rng.randrange(3), 80, 6, 1, 0, rng.choice([None, "", f"<{i}>", f"é{i}" * 40])))
    df = spark.createDataFrame(rows, PACKET + ", payload string")
    want = _pair_buffers(rows, 60 * S)
    whole = sum(len((r[-1] or "").encode()) for r in rows)
    waves = []

    def measure(texts):
        texts = texts.select("flow_id", "start_us", "payload")
        waves.append(texts.agg(F.sum(F.octet_length("payload"))).first()[0] or 0)
        return texts

    def sized(batch_rows, **given):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
        for name, value in given.items():
            monkeypatch.setattr(gates, name, value)
        waves.clear()
        return sorted(map(tuple, gates.host_pair_payloads(df, 60 * S, measure=measure).collect()))

    largest = max(len(text.encode()) for _, _, text in want)
    try:
        assert sized(10_000) == want and len(waves) == 1
        assert sized(3, _WAVE_BYTES=1, _WAVES=4, _PARTS_PER_TASK=400) == want
        assert 4 <= len(waves) <= 8 and sum(waves) == sum(len(text.encode()) for _, _, text in want)
        assert max(waves) <= whole / 4 + 2 * largest
        short = {(r["flow_id"], r["start_us"]): r["payload"] for r in gates.host_pair_payloads(df, 60 * S, cap=5).collect()}
        assert short == {(flow, start): text[:5] for flow, start, text in want}
        assert gates.host_pair_payloads(df.limit(0), 60 * S, measure=lambda texts: texts).collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_host_pair_payloads_equal_packets_at_the_ends_of_parts(spark, monkeypatch):
    """Copies of a packet that closes a flow: the first in payload order goes with the flow, wherever parts end."""
    rows = []
    for k in range(12):  # a flow closes each 100 s; its last packet comes four times, once without payload
        t = 100 * k
        rows += [(10 * k, t, f"<{k}>"), *[(10 * k + 5, t + 70, p) for p in (f"c{k}", "", f"a{k}", f"b{k}")]]
    rows = [(i, t * S, "a", "b", 1, 80, 6, 1, 0, p) for i, t, p in rows]
    # copies after the first begin a flow, which the next first packet, 30 s later, joins and the next copies close
    df = spark.createDataFrame(rows, PACKET + ", payload string")
    want = {(10 * k + (0 if k == 0 else -5), (0 if k == 0 else 100 * k - 30) * S): (f"b{k - 1}c{k - 1}" if k else "") + f"<{k}>a{k}" for k in range(12)}
    want[115, 1170 * S] = "b11c11"
    for given in ({}, {"_PARTS_PER_TASK": 400}, {"_WAVE_BYTES": 1}):
        for name, value in given.items():
            monkeypatch.setattr(gates, name, value)
        got = gates.host_pair_payloads(df, 60 * S, measure=lambda texts: texts).collect()
        assert {(r["flow_id"], r["start_us"]): r["payload"] for r in got} == want


# --- decision ---------------------------------------------------------------------------


def test_ensemble_boundaries(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.5000001)], "id int, s double")
    got = ensemble.decide(df.withColumn("xgboost", F.col("s")), {"xgboost": 1.0}).orderBy("id").collect()
    assert [r["is_alert"] for r in got] == [False, True]
    odd = spark.createDataFrame([({"xgboost": 1.0, "other": 9.0},)], "scores map<string,double>")
    assert ensemble.decide_from_map(odd).first()["confidence"] == pytest.approx(0.22)
    bands = spark.createDataFrame([(x,) for x in (.9, .75, .6, .59)], "c double").select(ensemble.severity(F.col("c"))).collect()
    assert [b[0] for b in bands] == ["CRITICAL", "HIGH", "MED", "LOW"]


def test_feedback_lowers_and_recovers(spark):
    rows = [(i, i, "xgboost", True) for i in range(5)] + [(9, 9, "unknown", True)]
    df = spark.createDataFrame(rows, "feedback_id long, ts_us long, detector string, was_false_positive boolean")
    low = {r["detector"]: r["weight"] for r in ensemble.weights_after_feedback(df).collect()}
    assert low["xgboost"] < 0.02 and sum(low.values()) == pytest.approx(1.0)
    more = df.unionByName(spark.createDataFrame([(100 + i, 100 + i, "xgboost", False) for i in range(50)], df.schema))
    one = {r["detector"]: r["weight"] for r in ensemble.weights_after_feedback(more).collect()}
    many = {r["detector"]: r["weight"] for r in ensemble.weights_after_feedback(more, chunk_rows=9).collect()}
    assert one["xgboost"] > low["xgboost"] and one == pytest.approx(many)


def test_alert_defaults_and_json(spark):
    df = spark.createDataFrame([("x", None, None)], "alert_id string, src_ip string, detectors string")
    full = df.withColumns({c: F.lit(None) for c in ("dst_ip", "dst_port", "confidence", "severity", "shap_explanation")})
    row = A.alert_defaults(full.withColumn("dst_ip", F.lit(None).cast("string")).withColumn("severity", F.lit(None).cast("string"))
                           .withColumn("shap_explanation", F.lit(None).cast("string"))).first()
    assert (row["src_ip"], row["dst_port"], row["severity"], row["shap_explanation"]) == ("", 0, "LOW", "{}")
    lists = spark.createDataFrame([('["a"]',), ("bad",), (None,)], "d string").select(A.detector_list(F.col("d"))).collect()
    assert [r[0] for r in lists] == [["a"], [], []]


# --- vectors, labels, metrics ---------------------------------------------------------------


def test_finite_and_scale(spark):
    df = spark.createDataFrame([(1.0, math.nan), (3.0, math.inf), (5.0, None)], "a double, b double")
    stats = baseline.collect_stats(baseline.scaler_stats(df, ["a", "b"]))
    assert stats["b"] == (0.0, 0.0)
    scaled = V.scale(df, stats).toPandas()
    assert scaled["a"].tolist() == pytest.approx([-1.2247448, 0, 1.2247448]) and scaled["b"].tolist() == [0, 0, 0]


def test_csv_features(spark):
    df = spark.createDataFrame(
        [("BENIGN", "10", "0", "5", "x"), (" DDoS", "1", "2", "9", "7")],
        [" Label", "Total Fwd Packets", "Total Backward Packets", "SYN Flag Count", "Flow Duration"])
    rows = L.csv_features(df).collect()
    assert [r["y"] for r in rows] == [0, 1]
    assert rows[0]["serror_rate"] == 0.5 and rows[1]["serror_rate"] == 1.0 and rows[0]["duration"] == 0.0
    assert rows[0]["src_port"] == 0.0 and list(rows[0].asDict())[:-1] == V.FEATURES


def test_metrics_reference_case(spark):
    df = spark.createDataFrame(list(zip([0, 1, 1, 0, 1], [0, 1, 0, 0, 1], [.1, .9, .4, .2, .8])), "y_true int, y_pred int, y_score double")
    m = evaluate.binary_metrics(df).first()
    assert (m["f1"], m["precision"], m["recall"]) == (0.8, 1.0, 0.6667)
    assert evaluate.roc_auc(df).first()[0] == 1.0
    none = evaluate.binary_metrics(df.where("y_true = 0")).first()
    assert tuple(none) == (0.0, 0.0, 0.0)


def test_similar_excludes_itself_and_handles_missing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id int, embedding array<float>")
    got = similar.similar_to(df, 1, 2).collect()
    assert [r["vec_id"] for r in got] == [2, 3] and got[0]["similarity"] == pytest.approx(1.0)
    assert similar.similar_to(df, 99, 2).count() == 0


def test_graph_hub(spark):
    df = spark.createDataFrame([("h", f"n{i % 5}") for i in range(50)], "src_ip string, dst_ip string")
    degree = {r["ip"]: r["degree"] for r in graph.degrees(graph.undirected_edges(df)).collect()}
    assert degree["h"] == 6 and degree["n0"] == 2


def test_rolling_peak_over_gaps(spark):
    df = spark.createDataFrame([(1, 9), (2, 1), (64, 2), (65, 3)], "tick long, packets long")
    got = {r["tick"]: r["peak"] for r in ticks.rolling_peak(df, samples=64).collect()}
    assert got == {1: 9, 2: 9, 64: 9, 65: 3}


def test_training_sequences_drop_the_last_part(spark):
    df = spark.range(1, 36).select(F.col("id").alias("seq"), F.array("id").alias("v"))
    got = baseline.training_sequences(df, F.col("v"), 35, 10).orderBy("start").collect()
    assert [r["start"] for r in got] == [0, 10, 20] and all(len(r["sequence"]) == 10 for r in got)


def test_packet_columns(spark):
    df = packets(spark, [(0, True, 1, 2), (1, False, 1, 18)])
    keys = {tuple(r) for r in P.with_flow_key(df).select(*P.FLOW_KEY).collect()}
    assert keys == {("1.1.1.1", 10, "2.2.2.2", 80, 6)}
    assert P.port_violations(df, [80]).count() == 1
    assert [r[0] for r in df.select(P.ascii_lower(F.lit("AbÉ"))).take(1)] == ["abÉ"]


def test_views_are_whole(spark, sf):
    n = fx.table(spark, sf, "events").count()
    assert all(fx.view(spark, sf, v).count() == n for v in ("packets", "scores", "alerts", "payloads"))


def test_shuffle_files_behind_a_checkpoint_go_at_once(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    counted = spark.range(10_000).groupBy((F.col("id") % 997).alias("k")).count()
    before, cut, deadline = kept(), cut_lineage(counted), time.time() + 20
    while (left := kept() - before) and time.time() < deadline:
        time.sleep(0.2)  # files go in the background
    assert not left
    assert cut.count() == 997 and len(counted.collect()) == 997  # its own plan still has what it needs
