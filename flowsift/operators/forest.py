"""Isolation forest: trees on small hash samples, scored in Arrow batches.

The published algorithm needs at most ``sample`` rows per tree, so fitting
ships a few hundred rows per tree whatever the table's size, and the model
(at most ``2 * sample`` nodes per tree) is small by construction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.functions.vectors import clip01
from flowsift.operators.ordering import exact_percentiles
from flowsift.session import cut_lineage

TREES, SAMPLE = 100, 256  # fixed values of the detector
_HASH_RANGE = 1 << 40
_ROWS_AT_ONCE = 4096  # of a batch: what is held for them stays in the processor's cache
_NODES = "tree int, node int, feature int, threshold double, below int, above int, length double"


def _mean_path(n: float) -> float:
    """Average depth of an unsuccessful search among ``n`` values."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes in creation order; leaves carry their expected path length."""
    nodes: list[tuple] = []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes[at] = (at, -1, 0.0, -1, -1, depth + _mean_path(len(rows)))
            return at
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        left = rows[:, feature] <= cut
        nodes[at] = (at, feature, cut, add(rows[left], depth + 1), add(rows[~left], depth + 1), 0.0)
        return at

    add(x, 0)
    return nodes


_MOST_FEATURES, _MOST_BYTES = 24, 1 << 26  # of a forest whose cuts are looked up; others are walked level by level


class _Tree:
    """A tree as arrays; ``to[2 * k]`` follows node ``k`` above its cut, ``to[2 * k + 1]`` below, a leaf follows itself."""

    def __init__(self, nodes: pd.DataFrame):
        self.feature, self.cut = nodes["feature"].to_numpy(np.intp), nodes["threshold"].to_numpy(np.float64)
        below, above = nodes["below"].to_numpy(np.intp), nodes["above"].to_numpy(np.intp)
        self.inner, self.length, own = self.feature >= 0, nodes["length"].to_numpy(np.float64), np.arange(len(nodes))
        self.to = np.stack([np.where(self.inner, above, own), np.where(self.inner, below, own)], axis=1).ravel()
        # leaves from the lowest cuts up, each inner node's leaves below its cut, and the depth
        self.leaves, self.under, self.depth, todo = [], {}, 0, [(0, 0)]
        while todo:
            k, depth = todo.pop()
            if depth < 0:  # what is below node k is done
                self.under[k] = (self.under[k], len(self.leaves))
            elif self.inner[k]:
                self.under[k] = len(self.leaves)
                self.depth = max(self.depth, depth + 1)
                todo += [(int(above[k]), depth + 1), (k, -1), (int(below[k]), depth + 1)]
            else:
                self.leaves.append(k)

    def walk(self, x: np.ndarray) -> np.ndarray:
        """Path lengths: all rows go down one level at a time; rows at a leaf stay there."""
        flat, first, feature = x.ravel(), np.arange(len(x)) * x.shape[1], np.maximum(self.feature, 0)
        at = np.zeros(len(x), dtype=np.intp)
        for _ in range(self.depth):
            low = flat.take(feature.take(at) + first) <= self.cut.take(at)
            at = self.to.take(2 * at + low)
        return self.length.take(at)

    def masks(self, cuts: dict[int, np.ndarray]) -> tuple[list[tuple[int, list[np.ndarray]]], np.ndarray]:
        """Per feature and number of cuts below a value: 64 leaves a word, those that the value leaves possible; and the leaves' lengths."""
        words, found = -(-len(self.leaves) // 64), {}
        for k, (first, last) in self.under.items():
            f = int(self.feature[k])
            table = found.setdefault(f, [np.full(len(cuts[f]) + 1, ~np.uint64(0)) for _ in range(words)])
            beyond = int(np.searchsorted(cuts[f], self.cut[k])) + 1
            bits = (1 << last) - (1 << first)
            for w in range(words):
                table[w][beyond:] &= np.uint64(~(bits >> 64 * w) & (1 << 64) - 1)
        return list(found.items()), self.length[self.leaves]


class _Paths:
    """Sums of path lengths over trees.

    A value's place among all cuts of its feature tells, per tree, which leaves
    it leaves possible; the lowest leaf that all features leave is the row's.
    """

    def __init__(self, trees: list[_Tree]):
        self.trees = trees
        self.cuts = {int(f): np.unique(np.concatenate([t.cut[t.feature == f] for t in trees]))
                     for f in np.unique(np.concatenate([np.zeros(0, np.intp), *(t.feature[t.inner] for t in trees)]))}
        size = sum(8 * -(-len(t.leaves) // 64) * (len(self.cuts[int(f)]) + 1) for t in trees for f in np.unique(t.feature[t.inner]))
        looked_up = len(self.cuts) <= _MOST_FEATURES and size <= _MOST_BYTES
        self.masks = [t.masks(self.cuts) for t in trees] if looked_up else None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        if self.masks is None:
            for tree in self.trees:
                total += tree.walk(x)
            return total
        place = {f: np.searchsorted(c, x[:, f]) for f, c in self.cuts.items()}  # NaN is beyond all cuts
        for tables, length in self.masks:
            if not tables:
                total += length[0]
                continue
            leaf, open_ = None, None
            for w in range(len(tables[0][1])):
                left = tables[0][1][w].take(place[tables[0][0]])
                for f, table in tables[1:]:
                    left &= table[w].take(place[f])
                zeros = np.bitwise_count(~left & (left - np.uint64(1))).astype(np.intp)  # before the lowest bit; 64 if there is none
                leaf = zeros if leaf is None else leaf + open_ * zeros
                open_ = leaf == 64 * (w + 1)
            total += length.take(leaf)
        return total


def _matrix(rows: pa.Array) -> np.ndarray:
    """Vectors as rows of doubles; a missing number is NaN."""
    if rows.null_count:
        raise ValueError("null vector")
    values = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return np.ascontiguousarray(values).reshape(len(rows), -1)


def hash_samples(df: DataFrame, row_id: str, vector: str, trees: int, sample: int, seed: int) -> DataFrame:
    """Per tree, the ``sample`` rows with the smallest hash of (row, tree).

    One hash per row first keeps a uniform pool of at most a few times
    ``trees * sample`` rows; the trees draw from the pool.  A threshold on
    the tree's hash then leaves few candidates to explode and shuffle.
    """
    n = max(df.count(), 1)
    pool = min(1.0, 8 * trees * sample / n)
    chosen = F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(_HASH_RANGE)) < int(pool * _HASH_RANGE)
    df = cut_lineage(df.select(row_id, vector).where(chosen))
    n = max(df.count(), 1)
    share = min(1.0, (4.0 * sample + 64.0) / n)
    tries = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        t.alias("tree"), F.pmod(F.xxhash64(F.col(row_id), t, F.lit(seed)), F.lit(_HASH_RANGE)).alias("hash")
    ))
    drawn = F.filter(tries, lambda d: d["hash"] < int(share * _HASH_RANGE))
    rows = df.select(F.col(row_id), F.col(vector), F.explode(drawn).alias("_draw"))
    rows = rows.select(row_id, vector, "_draw.tree", "_draw.hash")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("hash", row_id))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= sample).select("tree", vector)


@dataclass(frozen=True)
class IsolationForest:
    nodes: pd.DataFrame
    sample: int
    offset: float

    def anomaly(self, vector: Column) -> Column:
        """2^(-mean path / expected path): near 1 is anomalous."""
        trees = [g.drop(columns="tree") for _, g in self.nodes.groupby("tree", sort=True)]
        expected = _mean_path(self.sample) or 1.0

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            paths = _Paths([_Tree(g) for g in trees])
            for rows in batches:
                found = [paths(_matrix(rows.slice(at, _ROWS_AT_ONCE))) for at in range(0, len(rows), _ROWS_AT_ONCE)]
                total = np.concatenate([np.zeros(0), *found])
                yield pa.array(np.power(2.0, -total / len(trees) / expected))

        return score(vector)

    def decision(self, vector: Column) -> Column:
        """Negative for anomalies, as shifted by the contamination quantile."""
        return -self.anomaly(vector) - self.offset

    def score(self, vector: Column) -> Column:
        return clip01(0.5 - self.decision(vector))


def fit_isolation_forest(
    df: DataFrame, row_id: str, vector: str, *, trees: int = TREES, sample: int = SAMPLE,
    contamination: float = 0.05, seed: int = 42,
) -> IsolationForest:
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vector]])
        tree = int(pdf["tree"].iloc[0])
        order = np.lexsort(x.T)  # the draw must not depend on arrival order
        nodes = _grow(x[order], max(1, math.ceil(math.log2(max(sample, 2)))), np.random.default_rng([seed, tree]))
        return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "node", "feature", "threshold", "below", "above", "length"])

    drawn = hash_samples(df, row_id, vector, trees, sample, seed)
    nodes = drawn.groupBy("tree").applyInPandas(grow, _NODES).toPandas()  # bounded: trees * 2 * sample
    nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    used = min(sample, df.count())
    model = IsolationForest(nodes, used, 0.0)
    scored = df.select((-model.anomaly(F.col(vector))).alias("raw"))
    [offset] = exact_percentiles(scored, "raw", [contamination])
    return IsolationForest(nodes, used, float(offset))
