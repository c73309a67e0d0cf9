"""Per-row attribution of tree ensembles (path-dependent Shapley values)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    """A leaf as the box of feature intervals on its path.

    ``kept[i]`` is the share of training rows that stay on the path at the
    splits on ``features[i]``.
    """

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    kept: np.ndarray
    value: float


def _leaf_value(node, classifier: bool) -> float:
    if not classifier:
        return node.prediction()
    counts = list(node.impurityStats().stats())
    return counts[1] / sum(counts) if len(counts) > 1 and sum(counts) else 0.0


def _leaves(node, classifier: bool, path: dict[int, tuple[float, float, float]], weight: float) -> list[Leaf]:
    if not node.getClass().getSimpleName().startswith("Internal"):
        f = sorted(path)
        box = np.array([path[i] for i in f], dtype=np.float64).reshape(-1, 3)
        return [Leaf(np.array(f, dtype=int), box[:, 0], box[:, 1], box[:, 2], weight * _leaf_value(node, classifier))]
    split = node.split()
    feature, cut = split.featureIndex(), split.threshold()
    total = float(node.impurityStats().count())
    found = []
    for child, bounds in ((node.leftChild(), (-math.inf, cut)), (node.rightChild(), (cut, math.inf))):
        low, high, kept = path.get(feature, (-math.inf, math.inf, 1.0))
        share = float(child.impurityStats().count()) / total
        step = (max(low, bounds[0]), min(high, bounds[1]), kept * share)
        found += _leaves(child, classifier, {**path, feature: step}, weight)
    return found


def forest_leaves(model) -> list[Leaf]:
    """Leaves of a fitted MLlib tree ensemble; a few hundred per tree at most."""
    jvm = model._java_obj
    weights = list(model.treeWeights)
    classifier = "RandomForest" in type(model).__name__
    scale = 1.0 / sum(weights) if classifier else 1.0
    trees = jvm.trees()
    return [leaf for t, w in enumerate(weights) for leaf in _leaves(trees[t].rootNode(), classifier, {}, w * scale)]


def mean_score(model) -> float:
    """Score of a row of which no feature is known: what attributions are measured from."""
    return float(sum(leaf.value * leaf.kept.prod() for leaf in forest_leaves(model)))


def _attribute(x: np.ndarray, leaves: list[Leaf], width: int) -> np.ndarray:
    """Shapley values of every row; a leaf with d features costs d*d row operations."""
    out = np.zeros((len(x), width))
    for leaf in leaves:
        d = len(leaf.features)
        if d == 0:
            continue
        v = x[:, leaf.features]
        inside = ((v > leaf.low) & (v <= leaf.high)).astype(np.float64)
        for i in range(d):
            # coefficients of the product over the other features of (kept + inside * y)
            poly = np.zeros((len(x), d))
            poly[:, 0] = 1.0
            for j in range(d):
                if j != i:
                    shifted = np.zeros_like(poly)
                    shifted[:, 1:] = poly[:, :-1] * inside[:, [j]]
                    poly = poly * leaf.kept[j] + shifted
            weight = np.array([math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)])
            out[:, leaf.features[i]] += leaf.value * (inside[:, i] - leaf.kept[i]) * (poly @ weight)
    return out


def attribution(model, vector: Column, width: int) -> Column:
    """``array<double>`` of one value per feature; they sum to score minus mean score."""
    leaves = forest_leaves(model)

    @F.pandas_udf("array<double>")
    def explain(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        return pd.Series(list(_attribute(np.stack([np.asarray(r, dtype=np.float64) for r in rows]), leaves, width)))

    return explain(vector)


def top_features(df: DataFrame, shap: str, names: list[str], k: int = 5, out: str = "top_features") -> DataFrame:
    """The ``k`` largest attributions by magnitude as ``array<struct<name,value>>``."""
    entries = F.zip_with(F.array(*[F.lit(n) for n in names]), F.col(shap), lambda n, v: F.struct(
        (-F.abs(v)).alias("size"), n.alias("name"), v.alias("value")
    ))
    picked = F.slice(F.sort_array(entries), 1, k)
    return df.withColumn(out, F.transform(picked, lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value"))))
