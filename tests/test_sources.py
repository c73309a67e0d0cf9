import json
import struct

import pytest
from pyspark.sql import functions as F

from flowsift.operators import forest
from flowsift.plans import detection
from flowsift.sources import datasets, pcap, rules, tables


def test_labelled_text(spark, folder):
    good = ",".join(["1", "tcp", "http", "SF"] + ["2.5"] * 36 + ["bad"]) + ",neptune.,21"
    with open(f"{folder}/a.txt", "w") as f:
        f.write(good + "\n\n1,2,3\n" + good.replace("neptune.", "normal") + "\n")
    rows = datasets.labelled_text_features(datasets.read_labelled_text(spark, folder)).collect()
    assert sorted((r["y"], r["y_multi"]) for r in rows) == [(0, 0), (1, 1)]
    assert rows[0]["src_bytes"] == 2.5 and rows[0]["dst_host_rerror_rate"] == 0.0 and len(rows[0]) == 25


def test_csv_directory_with_different_headers(spark, folder):
    open(f"{folder}/a.csv", "w").write(" Flow Duration,Label\n1,BENIGN\n1,BENIGN\nInfinity,DDoS\n")
    open(f"{folder}/b.csv", "w").write("Label,Extra\nBot,7\n")
    df = datasets.clean_flow_csvs(datasets.read_flow_csvs(spark, folder))
    assert sorted((r["label"], r["flow duration"], r["extra"]) for r in df.collect()) == [
        ("BENIGN", 1.0, 0.0), ("Bot", 0.0, 7.0), ("DDoS", 0.0, 0.0)]


def test_csv_rows_that_differ_in_text_only(spark, folder):
    open(f"{folder}/a.csv", "w").write("Source IP,Bytes,Label\n10.0.0.1,5,BENIGN\n10.0.0.2,5,BENIGN\n10.0.0.2,5,BENIGN\n10.0.0.3,NaN,BENIGN\n")
    df = datasets.clean_flow_csvs(datasets.read_flow_csvs(spark, folder))
    assert sorted((r["source ip"], r["bytes"]) for r in df.collect()) == [("10.0.0.1", 5.0), ("10.0.0.2", 5.0), ("10.0.0.3", 0.0)]


def test_later_fragment_has_no_ports():
    body = bytes([0, 1, 2, 3]) * 8
    frame = _frame(0x0800, struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 185, 64, 6, 0, b"\x0a\0\0\1", b"\x0a\0\0\2") + body)
    layers = pcap.decode_frame(frame)
    assert layers["tcp"] is None and layers["udp"] is None and layers["payload"] == body and layers["ip"]["proto"] == 6


def _ip(proto, body, src=b"\x0a\0\0\1", dst=b"\x0a\0\0\2"):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, src, dst) + body


def _frame(kind, body):
    return b"\1" * 6 + b"\2" * 6 + struct.pack(">H", kind) + body


def _capture(frames, order="<", magic=b"\xd4\xc3\xb2\xa1"):
    out = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 100 + i, 5, len(f), len(f)) + f
    return out


def _frames():
    tcp = struct.pack(">HHIIBBHHH", 1234, 80, 7, 8, 5 << 4, 0x12, 512, 0, 0) + b"GET /"
    question = b"\3www\4test\0" + struct.pack(">HH", 1, 1)
    answer = b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + b"\1\2\3\4"
    dns = struct.pack(">HHHHHH", 9, 0x8180, 1, 1, 0, 0) + question + answer
    udp = struct.pack(">HHHH", 53, 999, 8 + len(dns), 0) + dns
    return [_frame(0x0800, _ip(6, tcp)), _frame(0x0806, b"\0" * 28), _frame(0x0800, _ip(17, udp))]


@pytest.mark.parametrize("order,magic", [("<", b"\xd4\xc3\xb2\xa1"), (">", b"\xa1\xb2\xc3\xd4")])
def test_capture_files(spark, folder, order, magic):
    for name in ("b.pcap", "a.pcap"):
        open(f"{folder}/{name}", "wb").write(_capture(_frames(), order, magic) + b"\0\0\0")
    decoded = pcap.read_captures(spark, folder).orderBy("path", "record").collect()
    assert len(decoded) == 6
    first, arp, dns = decoded[:3]
    assert (first["tcp"]["sport"], first["tcp"]["flags"], bytes(first["payload"])) == (1234, 0x12, b"GET /")
    assert first["eth"]["src"] == "02:02:02:02:02:02" and arp["ip"] is None
    assert dns["dns"].asDict() == {"qname": "www.test", "qtype": 1, "is_response": True, "answers": ["1.2.3.4"]}
    packets = pcap.capture_packets(spark, folder).orderBy("packet_id").collect()
    assert len(packets) == 4 and len({p["packet_id"] for p in packets}) == 4
    assert (packets[0]["src_ip"], packets[0]["dst_port"], packets[0]["ts_us"]) == ("10.0.0.1", 80, 100_000_005)
    assert (packets[1]["src_port"], packets[1]["flags"]) == (53, 0)
    decided = detection.decide_flows(pcap.capture_packets(spark, folder), [("r", "get /GET")]).collect()
    assert sorted((d["gate"], d["protocol"], d["packet_count"]) for d in decided) == [(1, 6, 2), (2, 17, 2)]


def test_rules_precedence(spark, folder):
    path = f"{folder}/rules.yaml"
    open(path, "w").write("""
policies:
  - {name: P, type: payload_signature, patterns: ["abc", "d"]}
  - {name: L, type: protocol_limit, rules: {max_pps_per_ip: 5000}}
signatures:
  - {id: S1, patterns: ["x"], threshold: 10}
""")
    assert rules.load_rules(spark, path=path) == [("P", "abc"), ("P", "d")]
    assert rules.load_rules(spark, given=[("g", "q")], path=path) == [("g", "q")]
    assert rules.load_rules(spark, given=[]) == [] and len(rules.load_rules(spark)) == 10
    policy = rules.read_policy(spark, path)
    assert rules.limits(policy) == {"max_pps_per_ip": 5000}
    assert rules.signature_rules(policy) == ([("S1", "x")], {"S1": 10})
    attributes = rules.signature_attributes({"signatures": [{"id": 7, "name": "n", "severity": "HIGH", "protocol": "TCP"}, {"id": "b"}]})
    assert attributes == {"7": {"name": "n", "severity": "HIGH", "protocol": 6}, "b": {"name": None, "severity": None, "protocol": None}}
    assert rules.rules_frame(spark, [("a", "b")]).count() == 1


def _alerts(spark, rows):
    return spark.createDataFrame([(i, t, "1.1.1.1", 0.9) for i, t in rows], "alert_id string, ts_us long, src_ip string, confidence double")


def test_alert_table(spark, folder):
    path, day = f"{folder}/alerts", 86_400_000_000
    tables.append_alerts(_alerts(spark, [("a", 5), ("a", 3), ("b", day)]), path)
    tables.append_alerts(_alerts(spark, [("a", 9), ("c", 2 * day + 7)]), path)
    got = tables.read_alerts(spark, path)
    assert sorted((r["alert_id"], r["ts_us"]) for r in got.collect()) == [("a", 3), ("b", day), ("c", 2 * day + 7)]
    tables.drop_old_alerts(spark, path, 3 * day + 5, 2)
    assert [r["alert_id"] for r in tables.read_alerts(spark, path).collect()] == ["c"]


def test_small_sinks(spark, folder):
    events = spark.createDataFrame([(1, "login", None, True, None)], "ts_us long, event string, ip string, success boolean, detail string")
    tables.append_audit(events, f"{folder}/audit")
    row = spark.read.parquet(f"{folder}/audit").first()
    assert (row["ip"], row["detail"], len(row["id"])) == ("unknown", "", 36)
    tables.write_json_lines(events, f"{folder}/lines")
    assert json.loads(spark.read.text(f"{folder}/lines").first()[0])["event"] == "login"
    vectors = spark.createDataFrame([("a", [1.0], {"src_ip": "x"})], "alert_id string, embedding array<double>, metadata map<string,string>")
    tables.append_embeddings(vectors, f"{folder}/vectors")
    assert spark.read.parquet(f"{folder}/vectors").first()["embedding"] == [1.0]
    alert = spark.createDataFrame(
        [("a", "R", None, .91234, "s", "d", 80, "[]", '{"x": 0.12345}', 2_000_000)],
        "alert_id string, rule string, severity string, confidence double, src_ip string, dst_ip string, dst_port int, "
        "detectors string, shap_explanation string, ts_us long")
    event = tables.alert_events(alert).first()
    assert (event["severity"], event["confidence"], event["shap"], event["ts"]) == ("CRITICAL", 0.912, {"x": 0.123}, 2)


def test_forest_round_trip(spark, folder):
    df = spark.range(400).select("id", F.array((F.col("id") % 7).cast("double"), F.col("id").cast("double")).alias("v"))
    model = forest.fit_isolation_forest(df, "id", "v", trees=10)
    tables.save_forest(model, spark, f"{folder}/forest")
    again = tables.load_forest(spark, f"{folder}/forest")
    both = df.select(model.score(F.col("v")).alias("a"), again.score(F.col("v")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)


def test_append_reads_only_days_that_filters_allow(spark, folder):
    day = 86_400_000_000
    path = f"{folder}/alerts"
    tables.append_alerts(_alerts(spark, [(f"a{i}", i * day) for i in range(5)]), path)
    ids = spark.createDataFrame([("a3",), ("new",)], "alert_id string")
    filters = spark.read.parquet(f"{path}/_ids").withColumn("dt", F.col("dt").cast("string"))
    assert [tuple(r) for r in tables.possible_days(ids, filters).collect()] == [("a3", "1970-01-04")]
    assert [r[0] for r in tables.stored_ids(ids, path).collect()] == ["a3"]
    plan = tables.read_alerts(spark, path, ["1970-01-04"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "1970-01-04" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # an id of one day comes again on another day; nothing else is dropped
    tables.append_alerts(_alerts(spark, [("a3", 9 * day), ("b", 9 * day), ("b", 8 * day)]), path)
    got = {(r["alert_id"], r["ts_us"]) for r in tables.read_alerts(spark, path).collect()}
    assert got == {(f"a{i}", i * day) for i in range(5)} | {("b", 8 * day)}


def test_append_with_full_filters_is_still_exact(spark, folder, monkeypatch):
    monkeypatch.setattr(tables, "FILTER_BITS", 7)  # 128 bits a day: every filter says perhaps
    path = f"{folder}/alerts"
    rows = [(f"id{i}", (i % 3) * 86_400_000_000 + i) for i in range(400)]
    tables.append_alerts(_alerts(spark, rows[:250]), path)
    tables.append_alerts(_alerts(spark, rows[200:]), path)
    got = sorted(r["alert_id"] for r in tables.read_alerts(spark, path).collect())
    assert got == sorted(i for i, _ in rows)


def test_table_without_filters_gets_them(spark, folder):
    path = f"{folder}/alerts"
    old = _alerts(spark, [("a", 5), ("b", 6)])
    old.withColumn("dt", F.lit("1970-01-01")).write.partitionBy("dt").parquet(path)
    tables.append_alerts(_alerts(spark, [("b", 7), ("c", 8)]), path)
    assert sorted(r["alert_id"] for r in tables.read_alerts(spark, path).collect()) == ["a", "b", "c"]
