"""Throughput over time: fixed ticks, sliding views, deltas and peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsift.operators.ordering import last_rows, running_sums

TICK_US = 1_000_000


def throughput(packets: DataFrame, width_us: int = TICK_US) -> DataFrame:
    """Packets and bytes per tick."""
    return packets.groupBy(F.floor(F.col("ts_us") / width_us).alias("tick")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes")
    )


def sliding(packets: DataFrame, width_us: int, step_us: int) -> DataFrame:
    """Packets and bytes in every window of ``width_us`` starting each ``step_us``.

    Steps are summed first, so rows are counted once and only step totals are
    copied to the windows that contain them.
    """
    if width_us % step_us:
        raise ValueError("the width must be a multiple of the step")
    steps = throughput(packets, step_us)
    starts = F.explode(F.sequence(F.col("tick") - (width_us // step_us - 1), F.col("tick")))
    copied = steps.select(starts.alias("start"), "packets", "bytes")
    return copied.groupBy((F.col("start") * step_us).alias("start_us")).agg(
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes")
    )


def deltas(ticks: DataFrame, column: str = "packets", width_us: int = TICK_US) -> DataFrame:
    """Rate per second and growth (never negative) since the tick just before."""
    before = ticks.select((F.col("tick") + 1).alias("tick"), F.col(column).alias("_before"))
    growth = F.greatest(F.col(column) - F.coalesce("_before", F.lit(0)), F.lit(0))
    joined = ticks.join(before, "tick", "left")
    return joined.withColumns({"rate": F.col(column) / F.lit(width_us / 1e6), "growth": growth}).drop("_before")


def rolling_peak(ticks: DataFrame, column: str = "packets", samples: int = 64) -> DataFrame:
    """Largest value of the last ``samples`` ticks of the clock."""
    spread, part = last_rows(ticks, [], "tick", samples - 1)
    window = Window.partitionBy(*part).orderBy("tick").rangeBetween(-(samples - 1), 0)
    return spread.withColumn("peak", F.max(column).over(window)).where("_own").drop("_block", "_own")


def against_average(ticks: DataFrame, column: str = "packets") -> DataFrame:
    """Each tick against the average of all ticks so far."""
    summed = running_sums(ticks, ["tick"], {"_sum": F.col(column), "_n": F.lit(1)})
    return summed.withColumn("running_avg", F.col("_sum") / F.col("_n")).drop("_sum", "_n")
