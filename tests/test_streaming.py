"""Streams give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from flowsift.operators import alerts as A
from flowsift.operators import flows, ticks
from flowsift.plans import fixtures as fx
from flowsift.streaming import jobs


@pytest.fixture(scope="module")
def written(spark, sf, tmp_path_factory):
    """Packets in several files, in time order, so that several micro-batches run."""
    path = str(tmp_path_factory.mktemp("packets"))
    packets = fx.view(spark, sf, "packets").withColumn("ts", F.timestamp_micros("ts_us")).withColumn("payload", F.lit(""))
    packets = packets.select(*jobs.PACKET.names)
    edges = [0.0, 0.3, 0.6, 1.0]
    low, high = packets.agg(F.min("ts_us"), F.max("ts_us")).first()
    for a, b in zip(edges, edges[1:]):
        part = packets.where((F.col("ts_us") >= low + a * (high - low)) & (F.col("ts_us") < low + b * (high - low) + (b == 1)))
        part.coalesce(1).write.mode("append").parquet(path)
    return path, packets.cache()


def run(stream, name, folder):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None and not query.isActive
    return stream.sparkSession.table(name)


def test_flows(spark, written, folder):
    path, packets = written
    stream = jobs.flow_stream(jobs.packet_stream(spark, path, files=1), fx.FLOW_TIMEOUT_US, late="40 days")
    got = run(stream, "stream_flows", folder).collect()
    want = flows.assemble_flows(packets, fx.FLOW_TIMEOUT_US).where("close_reason = 'timeout'").select(*stream.columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_idle_flows_are_emitted(spark, written, folder):
    path, packets = written
    stream = jobs.flow_stream(jobs.packet_stream(spark, path, files=1), fx.FLOW_TIMEOUT_US, idle_us=fx.DAY_US, late="1 hour")
    got = run(stream, "stream_idle", folder).toPandas()
    assert (got.close_reason == "idle").any()
    assert got.packet_count.sum() <= packets.count() and not got.duplicated(["src_ip", "src_port", "dst_ip", "dst_port", "protocol", "start_us"]).any()


def test_cooldown(spark, written, folder):
    path, packets = written

    def as_alerts(df):
        return df.select(F.concat(F.lit("a"), "packet_id").alias("alert_id"), "ts", "ts_us", "src_ip", "dst_ip", "dst_port")

    stream = jobs.cooldown_stream(as_alerts(jobs.packet_stream(spark, path, files=1)), fx.COOLDOWN_US)
    got = {r["alert_id"] for r in run(stream, "stream_cool", folder).collect()}
    want = {r["alert_id"] for r in A.cooldown(as_alerts(packets), fx.COOLDOWN_US).collect()}
    assert got == want and want


def test_throughput(spark, written, folder):
    path, packets = written
    stream = jobs.throughput_stream(jobs.packet_stream(spark, path, files=1), "1 hour", "1 hour")
    got = {(int(r["start"].timestamp()), r["packets"], r["bytes"]) for r in run(stream, "stream_ticks", folder).collect()}
    every = {(r["tick"] * 3600, r["packets"], r["bytes"]) for r in ticks.throughput(packets, fx.HOUR_US).collect()}
    assert got <= every and len(got) > 0.9 * len(every)  # windows after the last watermark stay open


def test_alert_sink_is_idempotent(spark, written, folder):
    path, packets = written
    stream = jobs.packet_stream(spark, path, files=1).select(
        F.concat(F.lit("a"), F.col("packet_id") % 100).alias("alert_id"), "ts_us", "src_ip", "dst_ip", "dst_port")
    jobs.store_alerts(stream, f"{folder}/alerts", f"{folder}/ckpt", availableNow=True).awaitTermination(300)
    stored = spark.read.parquet(f"{folder}/alerts")
    assert stored.count() == stored.select("alert_id").distinct().count() == 100


def test_json_sink(spark, written, folder):
    path, packets = written
    stream = jobs.packet_stream(spark, path, files=1).select("packet_id", "src_ip")
    jobs.write_json(stream, f"{folder}/json", f"{folder}/ckpt", availableNow=True).awaitTermination(300)
    assert spark.read.json(f"{folder}/json").select("packet_id").distinct().count() == packets.count()
