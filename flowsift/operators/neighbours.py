"""Exact nearest neighbours within a table, and minority oversampling on top.

Points are assigned to the nearest of a sample of pivots.  Every point first
searches its own cell, which bounds its k-th distance; it then visits only the
cells that the triangle inequality cannot rule out.  A cell with many visitors
is copied so that no task gets more than ``probe_rows`` of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.functions.labels import deterministic_sample
from flowsift.operators.ordering import dense_seq, running_sums
from flowsift.session import cut_lineage

_NEAR = "array<struct<distance:double,id:bigint>>"
_BLOCK = 256


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * x @ y.T
    return np.sqrt(np.maximum(squares, 0.0))


def _nearest(ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, y: np.ndarray, k: int) -> list[list[dict]]:
    """The k nearest of ``y`` to each row of ``x``, itself excluded; ties by id."""
    found = []
    for at in range(0, len(x), _BLOCK):
        rough = _distances(x[at:at + _BLOCK], y)
        keep = min(k + 9, len(y))  # a few spare: the rough distances are then recomputed exactly
        for i, candidates in enumerate(np.argpartition(rough, keep - 1, axis=1)[:, :keep], start=at):
            exact = np.sqrt(((y[candidates] - x[i]) ** 2).sum(axis=1))
            pairs = sorted((float(d), int(j)) for d, j in zip(exact, other_ids[candidates]) if j != ids[i])
            found.append([{"distance": d, "id": j} for d, j in pairs[:k]])
    return found


def nearest_neighbours(
    points: DataFrame, k: int, *, row_id: str = "id", vector: str = "vec", cell_rows: int = 5_000,
    probe_rows: int = 50_000, max_cells: int = 4_096, seed: int = 42,
) -> DataFrame:
    """``id`` and ``near``: its ``k`` nearest other points as (distance, id)."""
    points = cut_lineage(points.select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).alias("vec")))
    n_cells = max(1, min(max_cells, -(-points.count() // cell_rows)))
    pivots = _matrix(pd.Series([r["vec"] for r in deterministic_sample(points, "id", n_cells, seed).collect()]))

    @F.pandas_udf("struct<cell:int,apart:double>")
    def assign(vectors: pd.Series) -> pd.DataFrame:
        d = _distances(_matrix(vectors), pivots)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "apart": d[np.arange(len(d)), cell]})

    placed = cut_lineage(points.withColumn("_c", assign("vec")).select("id", "vec", "_c.cell", "_c.apart"))
    radius = np.zeros(n_cells)
    for r in placed.groupBy("cell").agg(F.max("apart").alias("r")).collect():  # one row per cell
        radius[r["cell"]] = r["r"]

    def own_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf["id"].to_numpy(), _matrix(pdf["vec"])
        near = _nearest(ids, x, ids, x, k)
        bound = [m[-1]["distance"] if len(m) == k else np.inf for m in near]
        return pdf[["id", "vec", "cell"]].assign(bound=bound, near=near)

    first = placed.groupBy("cell").applyInPandas(own_cell, f"id bigint, vec array<double>, cell int, bound double, near {_NEAR}")
    if n_cells == 1:
        return first.select("id", "near")
    first = cut_lineage(first)

    @F.pandas_udf("array<int>")
    def reachable(vectors: pd.Series, own: pd.Series, bound: pd.Series) -> pd.Series:
        least = _distances(_matrix(vectors), pivots) - radius - 1e-6
        hit = least <= bound.to_numpy()[:, None]
        hit[np.arange(len(hit)), own.to_numpy()] = False
        return pd.Series([np.flatnonzero(h).tolist() for h in hit])

    visits = first.select("id", "vec", F.explode(reachable("vec", "cell", "bound")).alias("cell"))
    counts = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
    copies = {c: -(-n // probe_rows) for c, n in counts.items()}
    share = F.lit(1)
    if any(v > 1 for v in copies.values()):
        table = F.create_map(*[F.lit(int(x)) for c, v in copies.items() if v > 1 for x in (c, v)])
        share = F.coalesce(F.try_element_at(table, F.col("cell")), F.lit(1))
    visits = visits.withColumn("part", F.pmod(F.xxhash64("id"), share).cast("int"))
    cells = placed.select("id", "vec", "cell", F.explode(F.sequence(F.lit(0), share - 1)).alias("part"))

    def other_cell(probes: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if probes.empty or members.empty:
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "near": pd.Series([], dtype=object)})
        near = _nearest(probes["id"].to_numpy(), _matrix(probes["vec"]), members["id"].to_numpy(), _matrix(members["vec"]), k)
        return pd.DataFrame({"id": probes["id"], "near": near})

    more = visits.groupBy("cell", "part").cogroup(cells.groupBy("cell", "part")).applyInPandas(other_cell, f"id bigint, near {_NEAR}")
    every = first.select("id", "near").unionByName(more)
    merged = every.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))
    return merged.select("id", F.slice("near", 1, k).alias("near"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on ``parts``."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def oversample(
    df: DataFrame, vector: str, label: str, minority, *, k: int = 5, seed: int = 42, **search
) -> DataFrame:
    """Synthetic minority rows (``vector``, ``label``) that make the classes equal.

    A synthetic row lies at a random place between a minority row and one of
    its ``k`` nearest minority rows.  Equal vectors are counted, not compared:
    they are each other's neighbours at distance 0.
    """
    few, rest = df.agg(
        F.count_if(F.col(label) == minority), F.count_if(F.col(label) != minority)
    ).first()
    wanted = rest - few
    rows = df.where(F.col(label) == minority).select(F.col(vector).cast("array<double>").alias("vec"))
    if few == 0 or wanted <= 0:
        return rows.where(F.lit(False)).select(F.col("vec").alias(vector), F.lit(minority).alias(label))
    counted = dense_seq(rows.groupBy("vec").agg(F.count(F.lit(1)).alias("times")), ["vec"], "id")
    # copy c of the t-th minority row; rows are numbered through the running multiplicity
    numbered = running_sums(counted, ["id"], {"_upto": F.col("times")})
    base, extra = divmod(wanted, few)
    before = (F.col("_upto") - F.col("times")).cast("bigint")
    copies = (F.col("times") * base + F.greatest(F.lit(0), F.least(F.col("times"), F.lit(extra) - before))).cast("int")
    near = nearest_neighbours(counted, k, **search)
    drawn = numbered.join(near, "id").where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    twins = F.least(F.col("times") - 1, F.lit(k))
    choices = F.least(F.lit(k), twins + F.size("near"))
    pick = F.floor(_uniform(F.col("id"), F.col("copy"), F.lit(seed)) * choices) - twins
    drawn = drawn.select(
        "id", "copy", "vec", F.when(pick >= 0, F.get("near", pick.cast("int"))["id"]).alias("other"),
    )
    partners = counted.select(F.col("id").alias("other"), F.col("vec").alias("_to"))
    step = _uniform(F.col("copy"), F.col("id"), F.lit(seed + 1))
    pairs = drawn.join(partners, "other", "left").withColumn("_u", step)
    between = F.zip_with("vec", F.coalesce("_to", "vec"), lambda a, b: a + F.col("_u") * (b - a))
    return pairs.select(between.alias(vector), F.lit(minority).alias(label))
