"""Packets to bidirectional flows and their per-flow measures."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.functions.packets import FLOW_KEY, TCP_FLAGS, has_flag, protocol_code, with_flow_key
from flowsift.operators.anchors import RunRule, RunScan, assign_runs

# Default timeout (60 s); packets and payload that a capped flow remembers.
FLOW_TIMEOUT_US = 60_000_000
PACKET_CAP = 1000
MIN_DURATION = 0.001
PAYLOAD_CAP = 65_536  # characters (bytes of a latin-1 payload) kept per flow

FLOW_ORDER = ["end_us", "start_us", "src_ip", "src_port", "dst_ip", "dst_port", "protocol"]


def flow_rule(timeout_us: int) -> RunRule:
    return RunRule(timeout_us, strict=True, consume=True)


def split_flows(
    packets: DataFrame, timeout_us: int = FLOW_TIMEOUT_US, columns: Sequence[str] | None = None, **split
) -> DataFrame:
    """Packets (or these ``columns`` of them) with their flow: the key columns and ``anchor_us``, the flow's start."""
    keyed = with_flow_key(packets)
    if columns is not None:
        keyed = keyed.select(*FLOW_KEY, *columns)
    return assign_runs(keyed, FLOW_KEY, "ts_us", ["packet_id"], flow_rule(timeout_us), **split)


def seam_scan(seams: Callable[[list[str]], np.ndarray], longest: int) -> RunScan:
    """Marks packets with whose start a match ends that began in earlier packets of the flow.

    The summary of a run is its last ``longest`` - 1 characters.  A packet shorter
    than that has its whole payload in ``_head``.  Flows with a match inside a
    packet of the same batch need no search.
    """
    keep = longest - 1

    def ends(batch: pa.RecordBatch, is_anchor: np.ndarray, end: str) -> Iterator[tuple[int, str, str]]:
        """Rows with payload, the end of what came before and the end after them; at last the end after the batch."""
        some = batch.column("_some").to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(some)
        run = np.cumsum(is_anchor)
        heads, tails = batch.column("_head").take(pa.array(rows)).to_pylist(), batch.column("_tail").take(pa.array(rows)).to_pylist()
        at = 0  # rows before the first anchor go on with the run that came in
        for row, head, tail in zip(rows.tolist(), heads, tails):
            if run[row] != at:
                at, end = run[row], ""
            after = tail if len(tail) == keep else (end + tail)[-keep:]
            yield row, end, head
            end = after
        yield -1, end if at == (run[-1] if len(run) else 0) else "", ""

    def follow(batch: pa.RecordBatch, is_anchor: np.ndarray, end: str) -> str:
        for _, end, _ in ends(batch, is_anchor, end):
            pass
        return end

    def mark(batch: pa.RecordBatch, is_anchor: np.ndarray, end: str) -> tuple[np.ndarray, str]:
        marked, run = np.zeros(batch.num_rows, dtype=bool), np.cumsum(is_anchor)
        hit = np.zeros(int(run[-1]) + 1, dtype=bool)
        hit[run[batch.column("_hit").to_numpy(zero_copy_only=False)]] = True
        rows, texts = [], []
        for row, end, head in ends(batch, is_anchor, end):
            if row >= 0 and end and not hit[run[row]]:
                rows.append(row)
                texts.append(end + head)
        if rows:
            marked[np.array(rows)] = seams(texts)
        return marked, end

    return RunScan("_across", "", mark, follow, lambda a, b: (a + b)[-keep:])


def assemble_flows(
    packets: DataFrame,
    timeout_us: int = FLOW_TIMEOUT_US,
    packet_cap: int | None = None,
    payload_cap: int | None = None,
    ends: Callable[[DataFrame], DataFrame] | None = None,
    **split,
) -> DataFrame:
    """One row per flow; a flow closes *with* the first packet later than its start + timeout.

    With ``ends`` the flow gets ``matched``: whether its whole payload holds a
    match.  ``ends`` adds to each packet ``_hit`` (a match inside it), ``_some``
    (it has payload), ``_head`` and ``_tail`` (its first and last characters);
    a scan along the flow (:func:`seam_scan`) finds matches across packets.  No
    payload is moved or put together, and a flow that is split over tasks passes
    on its end only.

    With ``payload_cap`` the flow also gets the start of its ``payload``, in
    packet order.  The walk that finds the flows marks the packets that reach
    into the cap, so one aggregation serves both and no list outgrows the cap
    (by more than a piece per task the flow spans).

    Rows leave the walk sorted by flow, so partial aggregation leaves little
    more than one row per flow for the shuffle.
    """
    columns = ["packet_id", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length", "flags"]
    with_payload = payload_cap is not None
    keyed = with_flow_key(packets.select(*columns, *["payload"] * with_payload))
    binary = with_payload and isinstance(packets.schema["payload"].dataType, T.BinaryType)
    wanted = [*FLOW_KEY, "from_a", "ts_us", "packet_id", "length", "flags"]
    if with_payload:
        keyed = keyed.withColumn("_size", F.coalesce(F.length("payload"), F.lit(0)).cast("long"))
        wanted += ["payload", "_size"]
        split["head"] = ("_size", payload_cap)
    if ends is not None:
        keyed = ends(with_flow_key(packets.select(*columns, "payload")))
        wanted += ["_hit", "_some", "_head", "_tail"]
    runs = assign_runs(keyed.select(*wanted), FLOW_KEY, "ts_us", ["packet_id"], flow_rule(timeout_us), **split)
    measures = [
        F.min("packet_id").alias("flow_id"),
        F.max("ts_us").alias("end_us"),
        F.count(F.lit(1)).alias("packets_seen"),
        F.sum(F.when(F.col("from_a"), F.col("length")).otherwise(0)).alias("src_bytes"),
        F.sum(F.when(F.col("from_a"), 0).otherwise(F.col("length"))).alias("dst_bytes"),
        *[F.sum(has_flag(n).cast("bigint")).alias(f"flag_{n}") for n in TCP_FLAGS],
    ]
    if ends is not None:
        across = F.col(split["scan"].name) if split.get("scan") else F.lit(False)
        measures.append(F.max(F.col("_hit") | across).alias("matched"))
    if with_payload:
        piece = F.decode("payload", "ISO-8859-1") if binary else F.col("payload")  # one character per byte
        pieces = F.collect_list(F.when(F.col("in_head"), F.struct("ts_us", "packet_id", piece.alias("payload"))))
        text = F.substring(F.array_join(F.transform(F.sort_array(pieces), lambda p: p["payload"]), ""), 1, payload_cap)
        measures.append((F.encode(text, "ISO-8859-1") if binary else text).alias("payload"))
    flows = runs.groupBy(*FLOW_KEY, F.col("anchor_us").alias("start_us")).agg(*measures)
    count = F.col("packets_seen") if packet_cap is None else F.least("packets_seen", F.lit(packet_cap))
    closed = F.col("end_us") - F.col("start_us") > timeout_us
    return flows.select(
        "flow_id",
        F.col("a_ip").alias("src_ip"), F.col("a_port").alias("src_port"),
        F.col("b_ip").alias("dst_ip"), F.col("b_port").alias("dst_port"), "protocol",
        "start_us", "end_us", count.alias("packet_count"), "src_bytes", "dst_bytes",
        *[f"flag_{n}" for n in TCP_FLAGS],
        F.when(closed, "timeout").otherwise("flush").alias("close_reason"),
        *["payload"] * with_payload, *["matched"] * (ends is not None),
    )


def with_basic_features(flows: DataFrame) -> DataFrame:
    """Duration, protocol code, sizes, rates and flag shares."""
    span = (F.col("end_us") - F.col("start_us")) / F.lit(1e6)
    total = F.col("src_bytes") + F.col("dst_bytes")
    at_least_one = F.greatest("packet_count", F.lit(1))
    out = flows.withColumn(
        "duration",
        F.when(F.col("packet_count") < 2, F.lit(MIN_DURATION)).otherwise(F.greatest(span, F.lit(MIN_DURATION))),
    )
    return out.withColumns({
        "protocol_type": protocol_code(),
        "avg_packet_size": total / at_least_one,
        "bytes_per_second": total / F.col("duration"),
        "packets_per_second": F.col("packet_count") / F.col("duration"),
        "serror_rate": F.col("flag_syn") / at_least_one,
        "rerror_rate": F.col("flag_rst") / at_least_one,
    })


def idle_sessions(packets: DataFrame, gap_us: int = FLOW_TIMEOUT_US) -> DataFrame:
    """Sessions split where the silence exceeds ``gap_us``.

    Rows of one key in one ``gap_us`` slot always belong together, so they are
    summed (map side) before any ordering: what reaches the window is at most
    one row per key and slot, however many packets a hot key has.
    """
    keyed = with_flow_key(packets)
    slots = keyed.groupBy(*FLOW_KEY, F.floor(F.col("ts_us") / gap_us).alias("_slot")).agg(
        F.min("ts_us").alias("_lo"), F.max("ts_us").alias("_hi"),
        F.count(F.lit(1)).alias("_n"), F.sum("length").alias("_bytes"),
    )
    by_time = Window.partitionBy(*FLOW_KEY).orderBy("_lo")
    opens = F.coalesce((F.col("_lo") - F.lag("_hi").over(by_time) > gap_us).cast("int"), F.lit(1))
    numbered = slots.withColumn("_opens", opens).withColumn("_session", F.sum("_opens").over(by_time))
    return numbered.groupBy(*FLOW_KEY, "_session").agg(
        F.min("_lo").alias("start_us"), F.max("_hi").alias("end_us"),
        F.sum("_n").alias("packet_count"), F.sum("_bytes").alias("total_bytes"),
    ).drop("_session")


def expired_flows(open_flows: DataFrame, now_us: int, timeout_us: int = FLOW_TIMEOUT_US) -> DataFrame:
    """Open flows whose last packet is more than ``timeout_us`` before ``now_us``."""
    return open_flows.where(F.lit(now_us) - F.col("end_us") > timeout_us)


def protocol_mix(packets: DataFrame) -> DataFrame:
    return packets.groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"))


def top_flows(flows: DataFrame, n: int) -> DataFrame:
    total = (F.col("src_bytes") + F.col("dst_bytes")).alias("total_bytes")
    ordered = flows.select("*", total).orderBy(F.desc("total_bytes"), *FLOW_ORDER[1:])
    return ordered.limit(n)
