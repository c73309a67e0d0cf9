"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.text import FEW_ROWS
from flowsift.session import cut_lineage


def _jumped(parents: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Follow parents to their roots; every pass doubles the reach."""
    while True:
        up = parents.select(F.col("a").alias("_a"), F.col("p").alias("_p"))
        next_ = cut(parents.join(up, F.col("p") == F.col("_a"), "left").select(
            "a", F.coalesce("_p", "p").alias("p"), (F.coalesce("_p", "p") != F.col("p")).alias("moved")))
        parents = next_.select("a", "p")
        if next_.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``x, y``); the root is the same for a whole component.

    Every node takes the smallest of itself and its neighbours as its parent,
    parents are followed to the roots, and edges are carried over to the roots
    until none joins two of them.  Each round at least halves the roots that
    still have edges; minima are aggregated before they are shuffled.  Few edges
    stay in one partition.
    """
    live = cut_lineage(edges.where("x <> y").select("x", "y").distinct())
    if live.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        live = cut_lineage(live.coalesce(1)).coalesce(1)

        def cut(df: DataFrame) -> DataFrame:
            return cut_lineage(df).coalesce(1)
    else:
        cut = cut_lineage
    labels = None
    while not live.isEmpty():
        both = live.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")),
                                             F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("e")).select("e.*")
        roots = _jumped(cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))), cut)
        if labels is None:
            labels = roots.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            labels = cut(labels.join(roots, F.col("root") == F.col("a"), "left").select("node", F.coalesce("p", "root").alias("root")))
        at_x = roots.select(F.col("a").alias("x"), F.col("p").alias("px"))
        at_y = roots.select(F.col("a").alias("y"), F.col("p").alias("py"))
        live = cut(live.join(at_x, "x").join(at_y, "y").where("px <> py").select(F.col("px").alias("x"), F.col("py").alias("y")).distinct())
    if labels is None:
        labels = edges.select(F.col("x").alias("node"), F.col("y").alias("root")).limit(0)
    return labels
