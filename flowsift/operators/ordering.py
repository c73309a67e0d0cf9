"""Global order without a one-partition window.

``repartitionByRange`` over a total order splits even a key (or an instant)
that holds a third of the rows, so every operator here gets equal partitions.
What crosses partitions is one row of totals per partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.session import cut_lineage, shuffle_partitions

_ROW_BITS = 33  # layout of monotonically_increasing_id(): partition << 33 | row


def range_sorted(df: DataFrame, order: Sequence[Column | str], partitions: int | None = None) -> DataFrame:
    """Rows in global order, one sorted range per partition, with ``_pid`` and ``_row``."""
    n = partitions or shuffle_partitions(df.sparkSession)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = placed.withColumn("_mid", F.monotonically_increasing_id())
    placed = placed.withColumns({
        "_pid": F.shiftright("_mid", _ROW_BITS).cast("int"),
        "_row": F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
    }).drop("_mid")
    return cut_lineage(placed)


def _with_offsets(placed: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Add, per partition, the totals of all earlier partitions.

    The totals table has one row per partition, so both the single-task window
    over it and its broadcast are bounded by the partition count.
    """
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_pid").agg(*[c.alias(k) for k, c in totals.items()])
    offsets = sums.select("_pid", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in totals])
    return placed.join(F.broadcast(offsets), "_pid")


def dense_seq(
    df: DataFrame, order: Sequence[Column | str], out: str = "seq", partitions: int | None = None
) -> DataFrame:
    """Number rows 1..n in ``order`` (which must be total)."""
    placed = range_sorted(df, order, partitions)
    numbered = _with_offsets(placed, {"_offset": F.count(F.lit(1))})
    return numbered.withColumn(out, F.col("_offset") + F.col("_row") + 1).drop("_pid", "_row", "_offset")


def key_changes(batch: pa.RecordBatch, keys: Sequence[str], before: list | None) -> np.ndarray:
    n = batch.num_rows
    first = np.zeros(n, dtype=bool)
    for key in keys:
        column = batch.column(key)
        if n > 1:
            first[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    first[0] = before is None or [batch.column(k)[0].as_py() for k in keys] != before
    return first


def last_key(batch: pa.RecordBatch, keys: Sequence[str]) -> list:
    return [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]


def keyed_seq(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "kseq", partitions: int | None = None
) -> DataFrame:
    """Number rows 1..n per key, with any number of tasks per key.

    A partition only needs to know how many rows of its *first* key came
    before it; that follows from one summary row per partition.
    """
    placed = range_sorted(df, [*keys, *order], partitions)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, first_key, before, changed, tail = None, None, None, False, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if pid is None:
                pid, first_key = batch.column("_pid")[0].as_py(), [batch.column(k)[0].as_py() for k in keys]
            starts = np.flatnonzero(key_changes(batch, keys, before if before is not None else first_key))
            changed = changed or len(starts) > 0
            tail = batch.num_rows - int(starts[-1]) if len(starts) else tail + batch.num_rows
            before = last_key(batch, keys)
        if pid is not None:
            yield pa.RecordBatch.from_pydict(
                {"pid": [pid], "head": [repr(first_key)], "tail": [repr(before)], "rows": [tail], "changed": [changed]}
            )

    parts = placed.select("_pid", *keys).mapInArrow(summarise, "pid long, head string, tail string, rows long, changed boolean")
    entering, key, rows = {}, None, 0
    for part in sorted(parts.collect(), key=lambda r: r["pid"]):  # one row per partition
        entering[part["pid"]] = rows if part["head"] == key else 0
        rows = part["rows"] + (0 if part["changed"] else entering[part["pid"]])
        key = part["tail"]

    kept = [f for f in placed.schema.fields if f.name not in ("_pid", "_row")]
    names = [f.name for f in kept]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, done = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if before is None:
                before, done = [batch.column(k)[0].as_py() for k in keys], entering[batch.column("_pid")[0].as_py()]
            at = np.arange(batch.num_rows)
            first = key_changes(batch, keys, before)
            start = np.maximum.accumulate(np.where(first, at, -1))
            position = np.where(start >= 0, at - start, at + done) + 1
            before, done = last_key(batch, keys), int(position[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(position)], names=[*names, out])

    return placed.mapInArrow(number, T.StructType([*kept, T.StructField(out, T.LongType())]))


def running_sums(
    df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column], partitions: int | None = None
) -> DataFrame:
    """Global inclusive running sums ``{name: expression}`` in ``order``."""
    names = list(sums)
    placed = range_sorted(df.withColumns({f"_v_{n}": c.cast("double") for n, c in sums.items()}), order, partitions)
    schema = T.StructType([f for f in placed.schema.fields if not f.name.startswith("_v_")])
    for name in names:
        schema = schema.add(f"_c_{name}", T.DoubleType())
    kept = [f.name for f in schema.fields if not f.name.startswith("_c_")]

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = np.zeros(len(names))
        for batch in batches:
            columns = [batch.column(k) for k in kept]
            for i, name in enumerate(names):
                values = batch.column(f"_v_{name}").to_numpy(zero_copy_only=False)
                total = np.cumsum(values) + carry[i]
                if len(total):
                    carry[i] = total[-1]
                columns.append(pa.array(total))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *(f"_c_{n}" for n in names)])

    local = placed.mapInArrow(accumulate, schema)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_pid").agg(*[F.sum(f"_v_{n}").alias(n) for n in names])
    offsets = totals.select("_pid", *[F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(f"_o_{n}") for n in names])
    joined = local.join(F.broadcast(offsets), "_pid")
    return joined.withColumns({n: F.col(f"_c_{n}") + F.col(f"_o_{n}") for n in names}).drop(
        "_pid", "_row", *[f"_c_{n}" for n in names], *[f"_o_{n}" for n in names]
    )


_ACCURACY = 10_000  # percentile_approx is off by at most 1 / _ACCURACY of the rows


def exact_percentiles(
    df: DataFrame, column: str, fractions: Sequence[float], small: int = 100_000
) -> list[float]:
    """Linearly interpolated percentiles of the numbers (no nulls, no NaN), exact at any size.

    The column is written out once.  A sketch brackets each rank; only the rows
    in the brackets, collapsed to distinct values with counts, are then sorted
    and summed up: a few ten-thousandths of the data.  ``percentile()`` would
    hold every distinct value in one buffer.
    """
    values = cut_lineage(df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)"))
    slack = 2.0 / _ACCURACY
    ends = [min(max(p + d, 0.0), 1.0) for p in fractions for d in (-slack, slack)]
    n, sketch = values.agg(F.count(F.lit(1)), F.percentile_approx("x", ends, _ACCURACY)).first()
    if n == 0:
        return [float("nan")] * len(fractions)
    if n <= small:
        return np.percentile([r["x"] for r in values.collect()], [100.0 * p for p in fractions]).tolist()
    positions = [p * (n - 1) for p in fractions]
    brackets = list(zip(sketch[::2], sketch[1::2]))

    inside = reduce(lambda a, b: a | b, [F.col("x").between(lo, hi) for lo, hi in brackets])
    found = {}
    sums = running_sums(values.where(inside).groupBy("x").agg(F.count(F.lit(1)).alias("n")), ["x"], {"upto": F.col("n")})
    sums = cut_lineage(sums)
    below = values.agg(*[F.count_if(F.col("x") < lo) for lo, _ in brackets]).first()
    for (lo, hi), before, at in zip(brackets, below, positions):
        # running sums start at the lowest bracket: shift them to ranks in the whole table
        start = sums.where(F.col("x") < lo).agg(F.max("upto")).first()[0] or 0.0
        for rank in {int(np.floor(at)), int(np.ceil(at))}:
            target = rank - before + start
            hit = sums.where(F.col("x").between(lo, hi) & (F.col("upto") > target)).agg(F.min("x")).first()[0]
            if hit is None or rank < before:
                raise ArithmeticError("percentile bracket missed its rank")
            found[rank] = hit
    low = [found[int(np.floor(x))] for x in positions]
    high = [found[int(np.ceil(x))] for x in positions]
    return [float(a + (b - a) * (x - np.floor(x))) for a, b, x in zip(low, high, positions)]


def last_rows(
    df: DataFrame, keys: Sequence[str], seq: str, width: int, block: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Prepare windows over "this row and up to ``width`` rows before it".

    Rows are cut into blocks of consecutive ``seq``; the last ``width`` rows of
    a block are copied into the next one.  Windows partitioned by the returned
    columns see at most ``block + width`` rows.  Filter ``_own`` afterwards.
    """
    size = max(block or 4096, width)
    at = F.floor(F.col(seq) / size)
    copies = F.when(F.pmod(F.col(seq), F.lit(size)) >= size - width, F.array(at, at + 1)).otherwise(F.array(at))
    spread = df.withColumn("_block", F.explode(copies)).withColumn("_own", F.col("_block") == at)
    return spread, [*keys, "_block"]
