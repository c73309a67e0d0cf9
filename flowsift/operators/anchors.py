"""Greedy anchored runs: each run of a key is measured from its first row.

Two rules share one mechanism:

* flow split - a run *ends with* the first row later than ``anchor + limit``
  (``strict=True, consume=True``); the row after that starts the next run;
* cooldown - a run ends *before* the first row at or after ``anchor + limit``
  (``strict=False, consume=False``); that row starts the next run.

Neither is a session window: the outcome depends on where the run started.

Ordinary keys are hashed to tasks, sorted and walked with constant memory.
Keys with more than ``hot_rows`` rows are range-split over many tasks instead.
A task in the middle of such a key does not know the run it enters, so it
first publishes *how its rows map any entering anchor to a leaving anchor*, a
step function.  The step functions are composed in groups of ``fan_in`` (a
parallel prefix), which gives every task its entering anchor, and the walk
then runs in parallel.  The result does not depend on the split.

A *scan* carries a summary along each run, such as the last characters of its
texts, and marks rows by what came before them.  Summaries are associative:
each task of a split key publishes that of its last run, one row per task, and
the entering ones are composed by prefix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.operators.ordering import key_changes, last_key
from flowsift.session import cut_lineage, shuffle_partitions, shuffles_dropped

FRESH = -(2**63)  # state: the next row of this key starts a run


@dataclass(frozen=True)
class RunRule:
    """``limit`` in the unit of the time column (> 0)."""

    limit: int
    strict: bool
    consume: bool

    @property
    def side(self) -> str:
        return "right" if self.strict else "left"

    def breaks(self, ts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per row: index of the first later row outside the run it would start.

        Gaps are cut to just over the limit and a key change counts as such a
        gap, so one sorted search over all keys is exact.
        """
        gap = self.limit + 1 if self.strict else self.limit
        step = np.minimum(np.diff(ts, prepend=ts[:1]), gap)
        step[first] = gap
        at = np.cumsum(step)
        return np.searchsorted(at, at + self.limit, side=self.side)

    def walk(self, ts: np.ndarray, first: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Anchor time and is-anchor flag per row, and the leaving state.

        ``state`` applies to the rows before the first key change.
        """
        n = len(ts)
        stop = self.breaks(ts, first)
        edge = np.append(first, True)
        follow = stop + (~edge[stop] if self.consume else 0)
        entering = state
        leaving = FRESH
        i = 0
        if not first[0] and state != FRESH:
            changes = np.flatnonzero(first)
            end = int(changes[0]) if len(changes) else n
            hit = int(np.searchsorted(ts[:end], state + self.limit, side=self.side))
            i = hit if hit == end else hit + int(self.consume)
            if hit == n:
                leaving = state
        starts = []
        jump = follow.tolist()
        while i < n:
            starts.append(i)
            i = jump[i]
        is_anchor = np.zeros(n, dtype=bool)
        is_anchor[starts] = True
        at = np.maximum.accumulate(np.where(is_anchor, np.arange(n), -1))
        anchor = np.where(at >= 0, ts[np.maximum(at, 0)], entering)
        if starts and stop[starts[-1]] == n:
            leaving = int(ts[starts[-1]])
        return anchor, is_anchor, leaving

    def carry(self, ts: np.ndarray) -> Carry:
        """The step function of a chunk that lies inside one key."""
        n = len(ts)
        first = np.zeros(n, dtype=bool)
        stop = self.breaks(ts, first)
        follow = np.append(np.minimum(stop + int(self.consume), n), n)
        open_end = np.append(stop == n, True)
        last = np.where(open_end, np.arange(n + 1), follow)
        while True:  # pointer doubling to each row's final run
            nxt = last[last]
            if np.array_equal(nxt, last):
                break
            last = nxt
        leave = np.where(last == n, FRESH, np.append(ts, 0)[last])
        # an entering anchor is never later than the first row of the chunk
        reach = int(np.searchsorted(ts - self.limit, ts[0], side=self.side))
        out = leave[np.arange(min(reach + 1, n)) + int(self.consume)]
        return Carry((ts - self.limit)[:reach], out, int(leave[0]), self.side).compact()


@dataclass(frozen=True)
class Carry:
    """Maps an entering anchor to a leaving one.

    ``out[k]`` answers anchors between ``at[k-1]`` and ``at[k]``; beyond the last
    ``out`` the run stays open and the anchor is unchanged.
    """

    at: np.ndarray
    out: np.ndarray
    fresh: int
    side: str

    def __call__(self, states: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.at, states, side=self.side)
        known = k < len(self.out)
        padded = np.append(self.out, 0)
        result = np.where(known, padded[np.minimum(k, len(self.out))], states)
        return np.where(states == FRESH, self.fresh, result)

    def then(self, later: Carry) -> Carry:
        at, out = self.at, later(self.out)
        if len(self.out) == len(self.at):  # some runs cross the whole chunk
            k = int(np.searchsorted(later.at, at[-1], side="right")) if len(at) else 0
            at = np.concatenate([at, later.at[k:]])
            out = np.concatenate([out, later.out[k:]])
        return Carry(at, out, int(later(np.array([self.fresh]))[0]), self.side).compact()

    def compact(self) -> Carry:
        if len(self.out) < 2:
            return self
        same = self.out[1:] == self.out[:-1]
        keep_at = np.append(~same, np.ones(len(self.at) - len(same), dtype=bool))
        return Carry(self.at[keep_at], self.out[np.append(True, ~same)], self.fresh, self.side)


@dataclass(frozen=True)
class RunScan:
    """Adds the boolean column ``name``: ``mark(batch, is_anchor, summary)`` gives it with the summary after the batch.

    ``summary`` is that of the rows before in the same run, ``empty`` if there
    are none.  ``follow`` gives the summary after a batch only.  ``join(a, b)``
    is the summary of rows with ``a`` followed by rows with ``b``.
    """

    name: str
    empty: str
    mark: Callable[[pa.RecordBatch, np.ndarray, str], tuple[np.ndarray, str]]
    follow: Callable[[pa.RecordBatch, np.ndarray, str], str]
    join: Callable[[str, str], str]


def _scan_split(walked: DataFrame, scan: RunScan) -> DataFrame:
    """``scan`` over partitions that hold consecutive parts of runs; ``_pid`` orders them."""
    walked = cut_lineage(walked)

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, summary, begins = None, scan.empty, False
        for batch in batches:
            if batch.num_rows:
                pid = batch.column("_pid")[0].as_py()
                is_anchor = batch.column("is_anchor").to_numpy(zero_copy_only=False)
                summary, begins = scan.follow(batch, is_anchor, summary), begins or bool(is_anchor.any())
        if pid is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([summary], pa.string()), pa.array([begins])], names=["pid", "summary", "begins"])

    parts = walked.mapInArrow(publish, "pid int, summary string, begins boolean").collect()  # one bounded row per partition
    entering, state = {}, scan.empty
    for part in sorted(parts, key=lambda r: r["pid"]):
        entering[part["pid"]] = state
        state = part["summary"] if part["begins"] else scan.join(state, part["summary"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if summary is None:
                summary = entering[batch.column("_pid")[0].as_py()]
            marked, summary = scan.mark(batch, batch.column("is_anchor").to_numpy(zero_copy_only=False), summary)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marked, pa.bool_())], names=[*batch.schema.names, scan.name])

    return walked.mapInArrow(mark, T.StructType([*walked.schema.fields]).add(scan.name, T.BooleanType()))


def _sizes_before(sizes: np.ndarray, is_anchor: np.ndarray, carried: int) -> tuple[np.ndarray, int]:
    """Total size of the earlier rows of each row's run, and of the last run so far."""
    earlier = np.cumsum(sizes) - sizes
    start = np.maximum.accumulate(np.where(is_anchor, np.arange(len(sizes)), -1))
    before = earlier - np.where(start >= 0, earlier[np.maximum(start, 0)], -carried)
    return before, int(before[-1] + sizes[-1])


def _walk_sorted(
    sorted_df: DataFrame, keys: Sequence[str], ts: str, rule: RunRule, entry: str | None, head: tuple[str, int] | None,
    scan: RunScan | None = None,
) -> DataFrame:
    """Walk partitions that are sorted by key and time; state crosses Arrow batches."""
    names = [f.name for f in sorted_df.schema.fields if f.name != entry]
    schema = T.StructType([f for f in sorted_df.schema.fields if f.name != entry])
    schema = schema.add("anchor_us", T.LongType()).add("is_anchor", T.BooleanType())
    if head:
        schema = schema.add("in_head", T.BooleanType())
    if scan:
        schema = schema.add(scan.name, T.BooleanType())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state, size, summary = None, FRESH, 0, scan.empty if scan else None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if before is None and entry is not None:
                given = batch.column(entry)[0].as_py()
                if given is not None:
                    before, state = [batch.column(k)[0].as_py() for k in keys], given
            first = key_changes(batch, keys, before)
            times = batch.column(ts).to_numpy(zero_copy_only=False)
            anchor, is_anchor, state = rule.walk(times, first, state)
            before = last_key(batch, keys)
            columns = [batch.column(c) for c in names] + [pa.array(anchor), pa.array(is_anchor)]
            if head:
                sizes = batch.column(head[0]).to_numpy(zero_copy_only=False)
                earlier, size = _sizes_before(sizes, is_anchor, size)
                columns.append(pa.array((earlier < head[1]) & (sizes > 0)))
            if scan:
                marked, summary = scan.mark(batch, is_anchor, summary)
                columns.append(pa.array(marked, pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return sorted_df.mapInArrow(fold, schema)


def _publish_carries(placed: DataFrame, keys: Sequence[str], ts: str, rule: RunRule) -> DataFrame:
    """One row per (partition, key that crosses its border): the step function.

    Only the last key of a partition is carried on, so only that key's rows are
    kept while reading; if it began in this partition its function is constant.
    """
    fields = [placed.schema[k] for k in keys]
    schema = T.StructType(list(fields)).add("_pid", "integer").add("at", "binary").add("out", "binary")
    schema = schema.add("fresh", "long").add("carries", "boolean").add("head", "boolean")

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, head, before, state, rows, single = None, None, None, FRESH, [], True
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if head is None:
                pid = batch.column("_pid")[0].as_py()
                head = [batch.column(k)[0].as_py() for k in keys]
            first = key_changes(batch, keys, before)
            times = batch.column(ts).to_numpy(zero_copy_only=False)
            single = single and not first[int(before is None):].any()
            if single:
                rows.append(times)
            _, _, state = rule.walk(times, first, state)
            before = last_key(batch, keys)
        if head is None:
            return
        if single:
            f = rule.carry(np.concatenate(rows))
            found = [(head, f.at.tobytes(), f.out.tobytes(), f.fresh, True, True)]
        else:
            const = np.array([state], dtype=np.int64)
            found = [(before, b"", const.tobytes(), state, True, False), (head, b"", b"", 0, False, True)]
        arrow = [
            pa.array([f[0][i] for f in found], type=batch.schema.field(k).type) for i, k in enumerate(keys)
        ]
        arrow += [pa.array([pid] * len(found), pa.int32())]
        arrow += [pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.binary())]
        arrow += [pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.bool_())]
        arrow += [pa.array([f[5] for f in found], pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrow, names=schema.names)

    return placed.select(*keys, ts, "_pid").mapInArrow(publish, schema)


def _entries(carries: DataFrame, keys: Sequence[str], side: str, fan_in: int) -> DataFrame:
    """Entering state of every chunk, by composing step functions ``fan_in`` at a time."""
    key_fields = [carries.schema[k] for k in keys]

    def load(row) -> Carry | None:
        if not row.carries:
            return None
        return Carry(np.frombuffer(row.at, np.int64), np.frombuffer(row.out, np.int64), row.fresh, side)

    def apply_in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pid")
        state = int(pdf["_start"].iloc[0])
        entering = []
        for row in pdf.itertuples():
            entering.append(state)
            f = load(row)
            if f is not None:
                state = int(f(np.array([state], dtype=np.int64))[0])
        return pdf[[*keys, "_pid"]].assign(entry=np.array(entering, dtype=np.int64))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pid")
        whole = None
        for row in pdf.itertuples():
            f = load(row)
            if f is not None:
                whole = f if whole is None else whole.then(f)
        head = pdf[[*keys, "_group"]].iloc[:1].rename(columns={"_group": "_pid"})
        if whole is None:
            return head.assign(at=b"", out=b"", fresh=0, carries=False)
        return head.assign(at=whole.at.tobytes(), out=whole.out.tobytes(), fresh=whole.fresh, carries=True)

    entry_schema = T.StructType(list(key_fields)).add("_pid", "integer").add("entry", "long")
    longest = carries.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if longest <= fan_in:
        return carries.withColumn("_start", F.lit(FRESH)).groupBy(*keys).applyInPandas(apply_in_order, entry_schema)
    grouped = carries.withColumn("_group", F.floor(F.col("_pid") / fan_in).cast("int"))
    whole = cut_lineage(grouped.groupBy(*keys, "_group").applyInPandas(compose, carries.schema))
    starts = _entries(whole, keys, side, fan_in).withColumnsRenamed({"_pid": "_group", "entry": "_start"})
    return grouped.join(starts, [*keys, "_group"]).groupBy(*keys, "_group").applyInPandas(apply_in_order, entry_schema)


def _split_hot(
    rows: DataFrame, keys, ts, ties, rule: RunRule, chunk_rows: int, total: int, fan_in: int, head, scan: RunScan | None
) -> DataFrame:
    n = max(shuffle_partitions(rows.sparkSession), -(-total // chunk_rows))
    order = [*keys, ts, *ties]
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id())
    placed = cut_lineage(placed)
    carries = cut_lineage(_publish_carries(placed, keys, ts, rule))
    entries = _entries(carries.drop("head"), keys, rule.side, fan_in)
    # only the first key of a partition can be entered from outside: one row per partition
    heads = carries.where("head").select(*keys, "_pid")
    entry = entries.join(heads, [*keys, "_pid"]).where(F.col("entry") != FRESH).select("_pid", "entry")
    walked = _walk_sorted(placed.join(F.broadcast(entry), "_pid", "left"), keys, ts, rule, "entry", head)
    return (_scan_split(walked, scan) if scan else walked).drop("_pid")


def _by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a key together and in order.  Sorting by a hash of the key first
    decides most comparisons without touching the key's strings."""
    hashed = df.withColumn("_key_hash", F.xxhash64(*keys)).repartition("_key_hash")
    return hashed.sortWithinPartitions("_key_hash", *order).drop("_key_hash")


_SEEN_OF_HOT = 1_000  # sampled rows expected of a key at the threshold


def assign_runs(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ties: Sequence[str],
    rule: RunRule,
    *,
    head: tuple[str, int] | None = None,
    scan: RunScan | None = None,
    hot_rows: int = 5_000_000,
    chunk_rows: int = 2_000_000,
    fan_in: int = 16,
) -> DataFrame:
    """Add ``anchor_us`` (start of the row's run) and ``is_anchor``.

    ``ts`` is an integer column; ``(ts, *ties)`` orders the rows of a key.
    Key columns must not be null.  ``head = (size column, cap)`` also adds
    ``in_head``: whether the row can reach the first ``cap`` units of its run.
    ``scan`` adds its own column.

    Keys near or above ``hot_rows`` are found in a sample; which side of the
    threshold a key falls on changes how it is computed, not the result.
    """
    if rule.limit <= 0:
        raise ValueError("limit must be positive")
    fraction = min(1.0, _SEEN_OF_HOT / hot_rows)
    sampled = df.select(*keys) if fraction == 1.0 else df.select(*keys).sample(fraction, seed=1)
    hot = sampled.groupBy(*keys).count().where(F.col("count") > hot_rows * fraction)
    with shuffles_dropped(df.sparkSession):
        n_hot, total = hot.agg(F.count(F.lit(1)), F.sum("count")).first()
    order = [*keys, ts, *ties]
    if n_hot == 0:
        return _walk_sorted(_by_key(df, keys, order), keys, ts, rule, None, head, scan)
    hot_keys = cut_lineage(hot.select(*keys))
    if n_hot <= 100_000:  # checked size; otherwise the planner chooses the join
        hot_keys = F.broadcast(hot_keys)
    cold = df.join(hot_keys, list(keys), "left_anti")
    cold = _walk_sorted(_by_key(cold, keys, order), keys, ts, rule, None, head, scan)
    hot_rows_df = df.join(hot_keys, list(keys), "left_semi")
    total = int(total / fraction)
    return cold.unionByName(_split_hot(hot_rows_df, keys, ts, ties, rule, chunk_rows, total, fan_in, head, scan))
