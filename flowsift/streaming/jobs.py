"""The batch operators as Structured Streaming jobs.

State is one small row per key (:mod:`flowsift.streaming.processors`), in the
RocksDB state store that :func:`flowsift.session.build_session` sets.  Rows of a
key are ordered inside a micro-batch, whose size the source's admission control
bounds (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from flowsift.functions.packets import FLOW_KEY, with_flow_key
from flowsift.operators.alerts import COOLDOWN_US
from flowsift.operators.anchors import RunRule
from flowsift.operators.flows import FLOW_TIMEOUT_US, flow_rule
from flowsift.operators.gates import payload_ends, payload_scan
from flowsift.operators.signatures import Rule, is_binary
from flowsift.schemas import PACKET
from flowsift.sources.tables import append_alerts
from flowsift.streaming.processors import FLOW_COLUMNS, PAYLOAD_COLUMNS, Cooldown, FlowTracker


def packet_stream(spark: SparkSession, path: str, schema: T.StructType = PACKET, files: int = 100) -> DataFrame:
    """Packets from a directory of parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def throughput_stream(packets: DataFrame, width: str = "1 second", late: str = "10 seconds", slide: str | None = None) -> DataFrame:
    """Packets and bytes per tumbling (or sliding) window, late rows up to ``late``."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counts = packets.withWatermark("ts", late).groupBy(window).agg(F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"))
    return counts.select(F.col("window.start").alias("start"), "packets", "bytes")


def flow_stream(
    packets: DataFrame,
    timeout_us: int = FLOW_TIMEOUT_US,
    packet_cap: int | None = None,
    idle_us: int | None = FLOW_TIMEOUT_US,
    late: str = "10 seconds",
    rules: Sequence[Rule] | None = None,
) -> DataFrame:
    """Flows as they close.

    The running aggregate is the state, not the packets.  An open flow is also
    emitted, as ``idle``, once the watermark passes its last packet by
    ``idle_us``, so state is bounded and late rows are dropped.  With None open
    flows wait for their closing packet for ever.

    With ``rules`` each flow gets ``gate``: 1 if its whole payload matches a
    rule, else 2, wherever micro-batches and packets cut it.  The state then
    also holds the payload's end, shorter than the longest pattern.
    """
    columns = [*FLOW_KEY, "ts", "ts_us", "packet_id", "length", "flags", "from_a"]
    keyed, scan = with_flow_key(packets.withWatermark("ts", late)), None
    if rules is not None:
        keyed, scan = payload_ends(keyed, rules), payload_scan(rules, is_binary(packets, "payload"))
        keyed = keyed.withColumnsRenamed({old: new for new, old in PAYLOAD_COLUMNS.items()})
        columns += PAYLOAD_COLUMNS
    keyed = keyed.select(*columns)
    out = T.StructType([keyed.schema[k] for k in FLOW_KEY] + [T.StructField(n, T.LongType()) for n in FLOW_COLUMNS])
    out = out.add("close_reason", "string")
    out = out if rules is None else out.add("matched", "boolean")
    tracker = FlowTracker(flow_rule(timeout_us), packet_cap, idle_us, rules is not None, scan)
    flows = keyed.groupBy(*FLOW_KEY).transformWithStateInPandas(tracker, out, "Append", "EventTime")
    flows = flows.withColumnsRenamed({"a_ip": "src_ip", "a_port": "src_port", "b_ip": "dst_ip", "b_port": "dst_port"})
    return flows if rules is None else flows.withColumn("gate", F.when(F.col("matched"), 1).otherwise(2)).drop("matched")


def cooldown_stream(alerts: DataFrame, cooldown_us: int = COOLDOWN_US, late: str = "10 seconds") -> DataFrame:
    """Alerts that survive the cooldown; a key's state expires one cooldown after its last kept alert."""
    keyed = alerts.withWatermark("ts", late)
    processor = Cooldown(RunRule(cooldown_us, strict=False, consume=False), ["ts_us", "alert_id"], alerts.columns)
    return keyed.groupBy("src_ip", "dst_ip", "dst_port").transformWithStateInPandas(processor, alerts.schema, "Append", "EventTime")


def store_alerts(alerts: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of alerts to the alert table; replays of a batch add nothing."""
    writer = alerts.writeStream.foreachBatch(lambda batch, _: append_alerts(batch, path))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def write_json(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A stream as files of JSON lines."""
    writer = rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
