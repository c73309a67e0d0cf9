"""Statistical baselines: scalers, running and batch z-scores, thresholds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.functions.vectors import FEATURES, assemble, clip01, finite
from flowsift.operators.ordering import exact_percentiles, last_rows, range_sorted

# Fixed values of the detectors.
Z_THRESHOLD = 3.0
MIN_SAMPLES = 30
VARIANCE_FLOOR = 1e-10
STD_EPSILON = 1e-9
THRESHOLD_FLOOR = 1e-6
WARMUP = {"scaler": 50, "isolation_forest": 500, "gnn_detector": 500, "transformer_ae": 2000}
SEQUENCE = 10


def scaler_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per feature: mean and population standard deviation."""
    wide = df.agg(
        *[F.avg(finite(F.col(c))).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(finite(F.col(c))).alias(f"s_{c}") for c in columns],
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std"))
        for c in columns
    ])
    return wide.select(F.inline(rows))


def collect_stats(stats: DataFrame) -> dict[str, tuple[float, float]]:
    """Fitted statistics on the driver: one row per feature, nothing more."""
    return {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}


def baseline_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n, mean and sum of squared deviations per feature, as Welford state."""
    wide = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.var_pop(c).alias(f"v_{c}") for c in columns],
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col("n"), F.col(f"m_{c}").alias("mean"),
                 (F.col(f"v_{c}") * F.col("n")).alias("m2"))
        for c in columns
    ])
    return wide.select(F.inline(rows))


def _merge_moments(n1, mean1, m1, n2, mean2, m2):
    """Combine (count, mean, sum of squared deviations) of two sets of rows."""
    n = np.maximum(n1 + n2, 1)
    delta = mean2 - mean1
    return n1 + n2, mean1 + delta * n2 / n, m1 + m2 + delta * delta * (n1 * n2 / n)


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    values = batch.column("_vec").flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, width).astype(np.float64)


def _moments_before(placed: DataFrame, width: int) -> dict[int, tuple]:
    """Moments of all rows before each partition: one row per partition reaches the driver."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, state = None, (0, np.zeros(width), np.zeros(width))
        for batch in batches:
            if batch.num_rows:
                pid = batch.column("_pid")[0].as_py()
                x = _vectors(batch, width)
                mean = x.mean(axis=0)
                state = _merge_moments(*state, len(x), mean, ((x - mean) ** 2).sum(axis=0))
        if pid is not None:
            yield pa.RecordBatch.from_pydict(
                {"_pid": [pid], "n": [state[0]], "mean": [state[1].tolist()], "m2": [state[2].tolist()]}
            )

    parts = placed.select("_pid", "_vec").mapInArrow(summarise, "_pid bigint, n bigint, mean array<double>, m2 array<double>")
    before, state = {}, (0, np.zeros(width), np.zeros(width))
    for row in sorted(parts.collect(), key=lambda r: r["_pid"]):
        before[row["_pid"]] = state
        state = _merge_moments(*state, row["n"], np.array(row["mean"]), np.array(row["m2"]))
    return before


def running_zscore(
    numbered: DataFrame,
    columns: Sequence[str] = FEATURES,
    seq: str = "seq",
    threshold: float = Z_THRESHOLD,
    min_samples: int = MIN_SAMPLES,
) -> DataFrame:
    """Share of features more than ``threshold`` deviations from the mean so far.

    Rows are range-sorted by ``seq``; a partition starts from the merged
    moments of the ones before it and adds its rows batch by batch, centred on
    each batch's first row so that nothing cancels.
    """
    width = len(columns)
    placed = range_sorted(numbered.withColumn("_vec", assemble(columns)), [seq])
    before = _moments_before(placed, width)
    kept = [f for f in placed.schema.fields if f.name not in ("_vec", "_pid", "_row")]
    names = [f.name for f in kept]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if state is None:
                state = before[batch.column("_pid")[0].as_py()]
            x = _vectors(batch, width)
            shifted = x - x[0]
            k = np.arange(1, len(x) + 1)[:, None]
            total = np.cumsum(shifted, axis=0)
            spread = np.maximum(np.cumsum(shifted * shifted, axis=0) - total * total / k, 0.0)
            n, mean, m2 = _merge_moments(*state, k, x[0] + total / k, spread)
            std = np.sqrt(np.maximum(m2 / np.maximum(n - 1, 1), VARIANCE_FLOOR))
            share = (np.abs(x - mean) / std > threshold).mean(axis=1)
            share[n[:, 0] < min_samples] = 0.0
            state = (n[-1, 0], mean[-1], m2[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(share)], names=[*names, "zscore"])

    return placed.mapInArrow(score, T.StructType([*kept, T.StructField("zscore", T.DoubleType())]))


def batch_zscore(df: DataFrame, normal: Column, columns: Sequence[str], fraction: float = 0.99) -> DataFrame:
    """Largest absolute z against the normal rows, over its p99, clipped to 1."""
    stats = collect_stats(scaler_stats(df.where(normal), columns))
    z = [F.abs((F.col(c) - m) / (s + STD_EPSILON)) for c, (m, s) in stats.items()]
    raw = df.withColumn("_raw", F.greatest(*z) if len(z) > 1 else z[0])
    [top] = exact_percentiles(raw, "_raw", [fraction])
    return raw.withColumn("score", clip01(F.col("_raw") / top)).drop("_raw")


def calibrated_thresholds(df: DataFrame, column: str, fractions: Sequence[float]) -> DataFrame:
    values = exact_percentiles(df, column, fractions)
    rows = [(float(p), float(max(v, THRESHOLD_FLOOR))) for p, v in zip(fractions, values)]
    return df.sparkSession.createDataFrame(rows, "fraction double, threshold double")


def inverted_minmax(df: DataFrame, column: str, out: str = "score") -> DataFrame:
    low, high = df.agg(F.min(column), F.max(column)).first()
    return df.withColumn(out, 1.0 - (F.col(column) - low) / (high - low + STD_EPSILON))


def warmup_phase(numbered: DataFrame, warmup: int, seq: str = "seq") -> DataFrame:
    return numbered.withColumn("phase", F.when(F.col(seq) <= warmup, "fit").otherwise("score"))


def retrain_epoch(numbered: DataFrame, every: int = 50, seq: str = "seq") -> DataFrame:
    return numbered.withColumn("epoch", F.floor(F.col(seq) / every).cast("bigint"))


def last_sequences(numbered: DataFrame, value: Column, length: int = SEQUENCE, seq: str = "seq") -> DataFrame:
    """``sequence``: this row's value and the ``length - 1`` before it; null until full."""
    spread, part = last_rows(numbered.withColumn("_value", value), [], seq, length - 1)
    window = Window.partitionBy(*part).orderBy(seq).rowsBetween(-(length - 1), 0)
    listed = spread.withColumn("sequence", F.collect_list("_value").over(window))
    full = F.when(F.size("sequence") == length, F.col("sequence"))
    return listed.withColumn("sequence", full).where("_own").drop("_value", "_block", "_own")


def training_sequences(numbered: DataFrame, value: Column, total: int, length: int = SEQUENCE, seq: str = "seq"):
    """Back-to-back sequences that start before ``total - length``."""
    start = F.floor((F.col(seq) - 1) / length) * length
    rows = numbered.where(start < total - length).select(start.alias("start"), seq, value.alias("_value"))
    grouped = rows.groupBy("start").agg(F.sort_array(F.collect_list(F.struct(seq, "_value"))).alias("_rows"))
    return grouped.select("start", F.transform("_rows", lambda r: r["_value"]).alias("sequence"))
