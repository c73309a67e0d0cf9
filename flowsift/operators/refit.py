"""Models that are fitted again during a run.

Flows are numbered in processing order.  Version ``e`` of a model is fitted on
the last ``window`` flows up to flow ``e * every``, and scores the flows after
that one until the next version is due.  All versions are fitted side by side
and kept as a table (``epoch, model``); each flow then meets the newest version
before it.  A task holds one version's window or the flows between two versions,
both of fixed size, however long the run.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowsift.operators.baseline import THRESHOLD_FLOOR
from flowsift.operators.forest import _grow, _mean_path

#: Flows between two versions, flows that a version is fitted on, and flows before the first version.
EVERY, WINDOW, WARMUP = 50, 500, 100


@dataclass(frozen=True)
class Refit:
    """``fit(rows, epoch)`` gives a model of the rows of a matrix, ``score(model, rows)`` a number from 0 to 1 for each row."""

    fit: Callable[[np.ndarray, int], object]
    score: Callable[[object, np.ndarray], np.ndarray]


def zscore_model(scale: float = 10.0) -> Refit:
    """Largest distance from the window's means in standard deviations, over ``scale``."""

    def score(model: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
        mean, std = model
        z = np.abs(rows - mean) / np.where(std > 1e-12 * np.maximum(np.abs(mean), 1.0), std, np.inf)  # a constant column says nothing
        return np.clip(z.max(axis=1) / scale, 0.0, 1.0)

    return Refit(lambda rows, _: (rows.mean(axis=0), rows.std(axis=0)), score)


def forest_model(trees: int = 50, sample: int = 128, seed: int = 42) -> Refit:
    """Isolation forest on samples of the window."""

    def fit(rows: np.ndarray, epoch: int) -> list[np.ndarray]:
        rng = np.random.default_rng([seed, epoch])
        size = min(sample, len(rows))
        limit = max(1, math.ceil(math.log2(max(size, 2))))
        return [size, [np.array(_grow(rows[rng.permutation(len(rows))[:size]], limit, rng), dtype=np.float64) for _ in range(trees)]]

    def score(model: list, rows: np.ndarray) -> np.ndarray:
        size, grown = model
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for t in grown:
            at = np.zeros(len(rows), dtype=int)
            while (inner := t[at, 1] >= 0).any():
                f = t[at, 1].astype(int)
                step = np.where(rows[every, np.maximum(f, 0)] <= t[at, 2], t[at, 3], t[at, 4]).astype(int)
                at = np.where(inner, step, at)
            total += t[at, 5]
        return np.power(2.0, -total / len(grown) / (_mean_path(size) or 1.0))

    return Refit(fit, score)


def reconstruction_model(k: int = 4, fraction: float = 0.95) -> Refit:
    """Error beyond the window's ``k`` principal axes, over its percentile in the window."""

    def errors(model: tuple, rows: np.ndarray) -> np.ndarray:
        z = (rows - model[0]) / model[1]
        return ((z - z @ model[2].T @ model[2]) ** 2).mean(axis=1)

    def fit(rows: np.ndarray, _: int) -> tuple:
        std = rows.std(axis=0)
        model = (rows.mean(axis=0), np.where(std > 0, std, 1.0))
        axes = np.linalg.svd((rows - model[0]) / model[1], full_matrices=False)[2][:k]
        threshold = max(float(np.quantile(errors((*model, axes), rows), fraction)), THRESHOLD_FLOOR)
        return (*model, axes, threshold)

    return Refit(fit, lambda model, rows: np.clip(errors(model, rows) / model[3], 0.0, 1.0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def fit_versions(
    numbered: DataFrame, vector: Column, model: Refit, every: int = EVERY, window: int = WINDOW, warmup: int = WARMUP, seq: str = "seq"
) -> DataFrame:
    """``epoch, model``: every version that at least ``warmup`` flows come before."""
    # flow s is one of the last `window` up to e * every: s <= e * every < s + window
    first, last = F.ceil(F.col(seq) / every), F.ceil((F.col(seq) + window) / every) - 1
    first = F.greatest(first, F.lit(-(-warmup // every)))
    due = numbered.agg(F.floor(F.max(seq) / every)).first()[0] or 0
    spread = numbered.select(F.col(seq).alias("seq"), vector.alias("vector"), F.least(last, F.lit(due)).alias("last"), first.alias("first"))
    rows = spread.where("first <= last").select("seq", "vector", F.explode(F.sequence("first", "last")).alias("epoch"))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")  # a fit must not depend on arrival order
        epoch = table["epoch"][0].as_py()
        return pa.table({"epoch": [epoch], "model": [pickle.dumps(model.fit(_matrix(table["vector"]), epoch))]})

    return rows.groupBy("epoch").applyInArrow(fit, "epoch long, model binary")


def score_versions(
    numbered: DataFrame, versions: DataFrame, vector: Column, model: Refit, out: str, every: int = EVERY, seq: str = "seq"
) -> DataFrame:
    """Add ``out``: the score by the newest version fitted before the flow, 0 before the first one."""
    schema = T.StructType([*numbered.schema.fields, T.StructField(out, T.DoubleType())])
    schema_of = to_arrow_schema(schema)
    flows = numbered.withColumns({"_vector": vector, "_epoch": F.floor((F.col(seq) - 1) / every).cast("long")})

    def score(rows: pa.Table, version: pa.Table) -> pa.Table:
        if not rows.num_rows:  # a version after the last flow
            return schema_of.empty_table()
        found = np.zeros(rows.num_rows)
        if version.num_rows:
            found = model.score(pickle.loads(version["model"][0].as_py()), _matrix(rows["_vector"]))
        return rows.drop_columns(["_vector", "_epoch"]).append_column(out, pa.array(found, pa.float64()))

    return flows.groupBy("_epoch").cogroup(versions.withColumnRenamed("epoch", "_epoch").groupBy("_epoch")).applyInArrow(score, schema)


def refitted_scores(
    numbered: DataFrame, vector: Column, model: Refit, out: str, every: int = EVERY, window: int = WINDOW, warmup: int = WARMUP
) -> DataFrame:
    """Score flows by models that are fitted again every ``every`` flows."""
    return score_versions(numbered, fit_versions(numbered, vector, model, every, window, warmup), vector, model, out, every)
