"""Payload reassembly and the two-gate decision."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.functions.packets import FLOW_KEY, host_pair, with_flow_key
from flowsift.operators.anchors import RunScan
from flowsift.operators.flows import FLOW_TIMEOUT_US, assemble_flows, seam_scan, split_flows
from flowsift.operators.ordering import key_changes, last_key, running_sums
from flowsift.operators.signatures import Rule, any_of, is_binary, signature_any
from flowsift.session import cut_lineage, shuffle_partitions, shuffles_dropped

_HOT_PIECES = 5_000_000
_SALTS = 64
_PARTS_PER_TASK = 1
_PART_BYTES = 64 << 20  # payload of a part, besides its last buffer
_WAVE_BYTES = 256 << 20  # payload on its way at once, for each core, or more if there were
_WAVES = 16  # more waves than this
_READY_BYTES = 16 << 20
_END = (1 << 63) - 1  # later than every packet


def reassemble(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: str, cap: int | None = None,
    hot_rows: int = _HOT_PIECES,
) -> DataFrame:
    """Concatenate the pieces of a key in order; with ``cap`` keep that many first characters.

    Every non-empty piece has at least one character, so only the first ``cap``
    pieces can matter.  A key with more than ``hot_rows`` pieces is first cut to
    its first ``cap`` per salt, so no task sees the whole key; the list that is
    built holds ``cap`` characters plus at most one piece.
    """
    binary = is_binary(df, piece)
    some = df.where(F.length(piece) > 0)
    if binary:  # one character per byte while joining
        some = some.withColumn(piece, F.decode(piece, "ISO-8859-1"))
    if cap is None:
        pieces = F.sort_array(F.collect_list(F.struct(*order, F.col(piece).alias("_piece"))))
        whole = some.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p["_piece"]), "").alias("payload"))
        return whole.withColumn("payload", F.encode("payload", "ISO-8859-1")) if binary else whole
    largest = some.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest > hot_rows:
        salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
        some = some.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(_SALTS)))
        some = some.withColumn("_rank", F.row_number().over(salted)).where(F.col("_rank") <= cap).drop("_salt", "_rank")
    by_order = Window.partitionBy(*keys).orderBy(*order)
    some = some.withColumn("_rank", F.row_number().over(by_order)).where(F.col("_rank") <= cap)
    before = F.sum(F.length(piece)).over(by_order.rowsBetween(Window.unboundedPreceding, -1))
    needed = some.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < cap)
    pieces = F.sort_array(F.collect_list(F.struct(F.col("_rank"), F.col(piece).alias("_piece"))))
    grouped = needed.groupBy(*keys).agg(pieces.alias("_pieces"))
    text = F.substring(F.array_join(F.transform("_pieces", lambda p: p["_piece"]), ""), 1, cap)
    return grouped.withColumn("payload", F.encode(text, "ISO-8859-1") if binary else text).drop("_pieces")


def _key_order(pair, ts, packet) -> tuple:
    """Spark's order of (pair, time, id) for Python: nulls first."""
    return pair, (ts is not None, ts), (packet is not None, packet)


def _takers(runs: DataFrame, timeout_us: int) -> DataFrame:
    """The flows that take a buffer, at the (pair, time, id) where it ends, with about the bytes it holds.

    A flow takes its pair's buffer with the packet that closes it; what is left
    at the end goes to the pair's oldest open flow.  A flow's bytes count where
    it ends: by timeout or so that is where its buffers are.
    """
    closes = F.col("ts_us") - F.col("anchor_us") > timeout_us  # one packet of a flow at most
    flows = runs.groupBy(*FLOW_KEY, F.col("anchor_us").alias("start_us")).agg(
        F.min("packet_id").alias("flow_id"), F.sum("_size").alias("_size"),
        F.max(F.when(closes, F.col("ts_us"))).alias("ts_us"), F.max(F.when(closes, F.col("packet_id"))).alias("packet_id"),
    )
    closer = F.when(F.col("ts_us").isNotNull(), F.struct("ts_us", "packet_id", "start_us", *FLOW_KEY))
    taken = flows.groupBy(host_pair("a_ip", "b_ip").alias("pair"), closer.alias("_at")).agg(
        F.min(F.struct("start_us", "flow_id", *FLOW_KEY)).alias("_f"), F.sum("_size").alias("_size"))
    return taken.select("pair", F.coalesce("_at.ts_us", F.lit(_END)).alias("ts_us"), "_at.packet_id", "_f.*", "_size")


def _cuts(takers: DataFrame) -> list[tuple[Row, int]]:
    """Last (pair, time, id) and bytes of each part of the takers in that order; a part has about ``share`` bytes."""
    with shuffles_dropped(takers.sparkSession):
        total = takers.agg(F.max("_upto")).first()[0] or 0
        tasks = _PARTS_PER_TASK * shuffle_partitions(takers.sparkSession)
        share = max(min(total / tasks, _PART_BYTES), 1.0)
        parts = takers.groupBy(F.floor(F.col("_upto") / share).alias("part")).agg(
            F.max(F.struct("pair", "ts_us", "packet_id")).alias("last"), F.sum("_size").alias("size"))
        return [(r["last"], r["size"]) for r in sorted(parts.collect(), key=lambda r: r["part"])]  # one row per part


def _waves(sizes: Sequence[int], most: float) -> list[tuple[int, int]]:
    """First and last of neighbouring parts that together have at most ``most`` bytes, or are one part."""
    waves, first, size = [], 0, 0
    for i, more in enumerate(sizes):
        if i > first and size + more > most:
            waves.append((first, i - 1))
            first, size = i, 0
        size += more
    return [*waves, (first, max(len(sizes) - 1, 0))]


def _parts(ends: list[tuple]) -> Column:
    """Part of a row; one that lies where a part ends is also in the next."""
    @F.arrow_udf("array<int>")
    def numbers(pair: pa.Array, ts: pa.Array, packet: pa.Array) -> pa.Array:
        found = []
        for row in zip(pair.to_pylist(), ts.to_pylist(), packet.to_pylist()):
            key = _key_order(*row)
            i = bisect_left(ends, key)
            found.append([i, i + 1] if i < len(ends) and ends[i] == key else [i])
        return pa.array(found, pa.list_(pa.int32()))

    return numbers(F.col("pair"), F.col("ts_us"), F.col("packet_id"))


def _beside_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of which only the last ends with a taker: the row after a taker lies in its batch."""
    late = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if late is not None:
            batch, late = pa.concat_batches([late, batch]), None
        if batch.column("_owns")[-1].is_valid:
            batch, late = batch.slice(0, batch.num_rows - 1), batch.slice(batch.num_rows - 1)
        if batch.num_rows:
            yield batch
    if late is not None:
        yield late


def _like_next(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Rows whose next row has the same keys; nulls are alike."""
    same = np.ones(batch.num_rows, dtype=bool)
    same[-1] = False
    for key in keys:
        here, there = batch.column(key).slice(0, batch.num_rows - 1), batch.column(key).slice(1)
        equal = pc.or_(pc.fill_null(pc.equal(here, there), False), pc.and_(here.is_null(), there.is_null()))
        same[:-1] &= equal.to_numpy(zero_copy_only=False)
    return same


def _join_pieces(rows: DataFrame, alike: Sequence[str], columns: Sequence[str], cap: int | None) -> DataFrame:
    """``columns`` of the takers that own a buffer that is not empty, and the buffer.

    Partitions hold parts, sorted by (pair, time, id, flow, payload): pieces and
    takers, which have no payload but ``_owns``.  A taker comes before the
    packets like its own and takes the first of them and all before.  Texts are
    cut out of the batches' bytes in one piece; one buffer is held at a time.
    """
    text = rows.schema["payload"].dataType
    schema = T.StructType([*(rows.schema[c] for c in columns), T.StructField("payload", text)])
    kind = pa.binary() if text == T.BinaryType() else pa.string()
    most = None if cap is None else cap if text == T.BinaryType() else 4 * cap  # bytes that hold so many characters

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, before = [], 0, None

        def hold(piece: memoryview) -> None:
            nonlocal size
            piece = piece if most is None else piece[:max(most - size, 0)]
            size += len(piece)
            held.append(bytes(piece))

        def drop() -> None:
            nonlocal size
            held.clear()
            size = 0

        for batch in _beside_next(batches):
            pieces = batch.column("payload").cast(pa.large_binary())
            _, places, data = pieces.buffers()
            at = np.frombuffer(places, np.int64)[pieces.offset:pieces.offset + batch.num_rows + 1].tolist()
            data = memoryview(data or b"")
            owns = batch.column("_owns").to_pylist()
            takes, first = batch.column("_owns").is_valid().to_numpy(zero_copy_only=False), key_changes(batch, ["_part", "pair"], before)
            before = last_key(batch, ["_part", "pair"])
            with_next = _like_next(batch, alike)
            begin, found, texts, ready = 0, [], [], 0
            for i in np.flatnonzero(takes | first).tolist():
                if first[i]:  # what no flow took
                    drop()
                    begin = i
                if not takes[i]:
                    continue
                end = i + 1 + int(with_next[i])
                hold(data[at[begin]:at[end]])
                begin = end
                if owns[i] and size:
                    found.append(i)
                    texts.append(b"".join(held))
                    ready += size
                drop()
                if ready >= _READY_BYTES:
                    yield given(batch, found, texts)
                    found, texts, ready = [], [], 0
            hold(data[at[begin]:at[-1]])
            if found:
                yield given(batch, found, texts)

    def given(batch: pa.RecordBatch, found: list[int], texts: list[bytes]) -> pa.RecordBatch:
        owners = batch.select(list(columns)).take(pa.array(found))
        return pa.RecordBatch.from_arrays([*owners.columns, pa.array(texts, pa.binary()).view(kind)], names=schema.names)

    whole = rows.mapInArrow(join, schema)
    return whole if cap is None else whole.withColumn("payload", F.substring("payload", 1, cap)).where(F.length("payload") > 0)


def host_pair_payloads(
    packets: DataFrame, timeout_us: int = FLOW_TIMEOUT_US, cap: int | None = None,
    measure: Callable[[DataFrame], DataFrame] | None = None, **split,
) -> DataFrame:
    """One shared buffer per host pair, taken by the pair's next flow to close.

    Flows and the packets that close them are found without the payloads.  In
    (pair, time, id) order the buffers then lie one after the other, each up to
    the packet that closes its taker, so a busy pair is not one task: the order
    is cut into parts of similar payload, between buffers, and a task joins the
    texts of a part in one pass.  Equal packets take their buffers in payload
    order.

    The texts are as large as all payloads.  ``measure`` makes of them what is
    wanted; parts then move in waves of ``_WAVE_BYTES`` for each core, or of a
    share of all payload, and the files of a wave go before the next begins.
    ``packets`` is read twice for the flows and once for each wave, which takes
    its own packets only, by a condition on pair, time and id.
    """
    spark = packets.sparkSession
    order, columns = ["pair", "ts_us", "packet_id"], [*FLOW_KEY, "start_us", "flow_id"]
    size = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")
    runs = split_flows(packets.withColumn("_size", size).drop("payload"), timeout_us, ["ts_us", "packet_id", "_size"], **split)
    takers = cut_lineage(running_sums(_takers(runs, timeout_us), order, {"_upto": F.col("_size")}))
    cuts = _cuts(takers)
    ends = [_key_order(*last) for last, _ in cuts[:-1]]

    pieces = with_flow_key(packets).where(F.length("payload") > 0).withColumn("pair", host_pair()).select(*order, *FLOW_KEY, "payload")
    rows = takers.select(*order, *columns, F.lit(True).alias("_taker")).unionByName(pieces, allowMissingColumns=True)

    def joined(first: int, last: int) -> DataFrame:
        here = F.lit(True)
        for i, beyond in ((first - 1, False), (last, True)):
            if 0 <= i < len(ends):
                at = F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, cuts[i][0])])
                here &= F.struct(*order) <= at if beyond else F.struct(*order) >= at
        placed = rows.where(here).select("*", F.posexplode(_parts(ends)).alias("_again", "_part"))
        placed = placed.where(F.col("_part").between(first, last)).withColumn("_owns", F.when(F.col("_taker"), F.col("_again") == 0))
        placed = placed.repartitionById(last - first + 1, F.col("_part") - first).drop("_taker", "_again")
        return _join_pieces(placed.sortWithinPartitions("_part", *order, *FLOW_KEY, "payload"), ["_part", *order, *FLOW_KEY], columns, cap)

    if measure is None:
        return joined(0, len(ends))
    sizes = [size for _, size in cuts]
    waves = _waves(sizes, max(_WAVE_BYTES * spark.sparkContext.defaultParallelism, sum(sizes) / _WAVES))
    if len(waves) == 1:
        return measure(joined(*waves[0]))
    return reduce(DataFrame.unionByName, [cut_lineage(measure(joined(*w))) for w in waves])


def _longest(rules: Sequence[Rule]) -> int:
    return max((len(p.encode()) for _, p in rules), default=1)


def payload_ends(packets: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``_hit`` (the payload holds a pattern), ``_some`` (it is not empty), ``_head`` and ``_tail`` (its ends, shorter than the longest pattern)."""
    binary = is_binary(packets, "payload")
    text = F.decode("payload", "ISO-8859-1") if binary else F.col("payload")  # one character per byte
    keep = F.lit(max(_longest(rules) - 1, 0))
    return packets.withColumns({
        "_hit": signature_any(F.col("payload"), rules, binary), "_some": F.coalesce(F.length("payload") > 0, F.lit(False)),
        "_head": F.left(text, keep), "_tail": F.right(text, keep),
    })


def payload_scan(rules: Sequence[Rule], binary: bool) -> RunScan | None:
    """Finds patterns that lie across the packets of a flow; None if no pattern is long enough."""
    return seam_scan(any_of(rules, binary), _longest(rules)) if _longest(rules) > 1 else None


def gated_flows(packets: DataFrame, rules: Sequence[Rule], timeout_us: int = FLOW_TIMEOUT_US, **split) -> DataFrame:
    """Flows with ``gate``: 1 if their whole payload matches a rule, else 2; no payload is put together."""
    found = assemble_flows(
        packets, timeout_us, ends=lambda rows: payload_ends(rows, rules), scan=payload_scan(rules, is_binary(packets, "payload")), **split)
    return found.withColumn("gate", F.when(F.col("matched"), 1).otherwise(2)).drop("matched")


def mark_gate(flows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Replace ``payload`` by ``gate``: 1 if it matches a rule, else 2."""
    hit = signature_any(F.col("payload"), rules, is_binary(flows, "payload"))
    gate = F.when(hit, 1).otherwise(2)
    return flows.withColumn("gate", gate).drop("payload")


def gate_decision(scored: DataFrame, confidence: Column, threshold: float = 0.5) -> DataFrame:
    """Gate 1 is certain; gate 2 takes the ensemble's confidence."""
    decided = scored.withColumn("confidence", F.when(F.col("gate") == 1, 1.0).otherwise(confidence))
    return decided.withColumn("is_alert", F.col("confidence") > threshold)
