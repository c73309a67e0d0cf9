"""Connection-behaviour features: how often were this host or service seen lately?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsift.operators.flows import FLOW_ORDER
from flowsift.operators.ordering import dense_seq, last_rows, running_sums

TIME_WINDOW_US = 2_000_000
CONNECTION_WINDOW = 100
_SLOTS = 4  # windows per time block; one block in four is copied


def _largest_blocks(flows: DataFrame, key_sets: Sequence[Sequence[str]], window_us: int) -> list[int]:
    """Rows of the largest time block of one key, per set of keys; all in one job."""
    at = F.floor(F.col("end_us") / (window_us * _SLOTS)).alias("at")
    marks = F.array(*[F.struct(F.lit(i).alias("keys"), F.xxhash64(*keys).alias("key"), at) for i, keys in enumerate(key_sets)])
    sizes = flows.select(F.explode(marks).alias("m")).groupBy("m.keys", "m.key", "m.at").count().groupBy("keys").agg(F.max("count").alias("n"))
    found = {r["keys"]: r["n"] for r in sizes.collect()}
    return [found.get(i, 0) for i in range(len(key_sets))]


def earlier_in_time(
    flows: DataFrame, keys: Sequence[str], out: str, window_us: int = TIME_WINDOW_US, burst_rows: int = 5_000_000,
    largest: int | None = None,
) -> DataFrame:
    """Flows processed before this one with the same keys that ended at most ``window_us`` ago.

    Partitioned by key *and* time block, so a hot host spreads over its blocks;
    the end of a block is copied into the next.  Two running counts replace a
    sliding frame, which would rescan the window for every row.  If even one
    block of one key is too large for a task, the counts come from a range sort.
    ``largest`` is that block's number of rows, if already known.
    """
    if largest is None:
        [largest] = _largest_blocks(flows, [keys], window_us)
    if largest > burst_rows:
        return _earlier_by_rank(flows, keys, out, window_us)
    span = window_us * _SLOTS
    at = F.floor(F.col("end_us") / span)
    tail = F.pmod(F.col("end_us"), F.lit(span)) >= span - window_us
    blocks = F.explode(F.when(tail, F.array(at, at + 1)).otherwise(F.array(at)))
    spread = flows.withColumn("_block", blocks).withColumn("_own", F.col("_block") == at)
    part = Window.partitionBy(*keys, "_block")
    seen = F.row_number().over(part.orderBy(*FLOW_ORDER)) - 1
    too_old = F.count(F.lit(1)).over(part.orderBy("end_us").rangeBetween(Window.unboundedPreceding, -window_us - 1))
    counted = spread.withColumn(out, (seen - too_old).cast("bigint"))
    return counted.where("_own").drop("_block", "_own")


def _earlier_by_rank(flows: DataFrame, keys: Sequence[str], out: str, window_us: int) -> DataFrame:
    """The same counts as differences of global ranks.

    Each flow sorts once at its end and once, as a probe, where its window
    opens; the flows between the two are the answer.  Range partitions stay
    equal whatever the keys and times are.
    """
    ids = flows.select(*dict.fromkeys([*keys, *FLOW_ORDER]))
    marks = ids.withColumns({"_at": F.col("end_us"), "_flow": F.lit(1)}).unionByName(
        ids.withColumns({"_at": F.col("end_us") - window_us, "_flow": F.lit(0)})
    )
    ranked = running_sums(marks, [*keys, "_at", "_flow", *FLOW_ORDER], {"_rank": F.col("_flow")})
    own, opening = (F.max(F.when(F.col("_flow") == f, F.col("_rank"))) for f in (1, 0))
    counts = ranked.groupBy(*FLOW_ORDER).agg((own - 1 - opening).cast("bigint").alias(out))
    return flows.join(counts, FLOW_ORDER)


def with_time_counts(flows: DataFrame, window_us: int = TIME_WINDOW_US) -> DataFrame:
    """``count`` (same destination host) and ``srv_count`` (same destination port)."""
    host, port = _largest_blocks(flows, [["dst_ip"], ["dst_port"]], window_us)
    hosts = earlier_in_time(flows, ["dst_ip"], "count", window_us, largest=host)
    return earlier_in_time(hosts, ["dst_port"], "srv_count", window_us, largest=port)


def with_host_counts(
    numbered: DataFrame, window: int = CONNECTION_WINDOW, seq: str = "seq", block: int | None = None
) -> DataFrame:
    """Same host / host and port / port among the previous ``window`` flows.

    One shuffle by block serves all three windows; a block is a fixed number
    of consecutive flows whatever their hosts are.
    """
    spread, _ = last_rows(numbered, [], seq, window, block)
    spread = spread.repartition("_block")

    def earlier(*keys: str):
        part = Window.partitionBy("_block", *keys).orderBy(seq)
        seen = F.row_number().over(part) - 1
        too_old = F.count(F.lit(1)).over(part.rangeBetween(Window.unboundedPreceding, -window - 1))
        return (seen - too_old).cast("bigint")

    counted = spread.withColumns({
        "dst_host_count": earlier("dst_ip"),
        "dst_host_srv_count": earlier("dst_ip", "dst_port"),
        "_same": earlier("dst_port"),
    }).where("_own")
    total = F.least(F.col(seq) - 1, F.lit(window))
    return counted.withColumns({
        "same_srv_rate": F.coalesce(F.try_divide("_same", total), F.lit(0.0)),
        "diff_srv_rate": F.coalesce(F.try_divide(total - F.col("_same"), total), F.lit(0.0)),
    }).drop("_same", "_block", "_own")


def number_flows(flows: DataFrame, partitions: int | None = None) -> DataFrame:
    """The processing order of flows as dense ``seq``."""
    return dense_seq(flows, FLOW_ORDER, "seq", partitions)
