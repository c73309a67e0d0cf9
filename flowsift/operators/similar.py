"""Nearest stored vectors by cosine distance."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.functions.vectors import dot, norm, similarity


def cosine_distance(vector: Column, query: Sequence[float]) -> Column:
    size = math.sqrt(sum(float(x) * float(x) for x in query)) or 1.0
    return 1.0 - F.coalesce(F.try_divide(dot(vector, query), norm(vector) * size), F.lit(0.0))


def nearest(corpus: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows to one vector: one scan, ``k`` rows per task to the merge."""
    scored = corpus.withColumn("distance", cosine_distance(F.col(vector), query))
    return scored.orderBy("distance", id_col).limit(k)


def stored(corpus: DataFrame, key, id_col: str = "vec_id") -> DataFrame:
    """The stored row of one id; the filter reaches the scan."""
    return corpus.where(F.col(id_col) == key)


def lookup(corpus: DataFrame, key, id_col: str = "vec_id", vector: str = "embedding") -> list[float] | None:
    row = stored(corpus, key, id_col).select(vector).first()
    return None if row is None else list(row[0])


def similar_to(corpus: DataFrame, key, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows to a stored one, itself excluded."""
    query = lookup(corpus, key, id_col, vector)
    if query is None:
        empty = corpus.where(F.lit(False))
        return empty.withColumns({"distance": F.lit(0.0), "similarity": F.lit(0.0)})
    found = nearest(corpus, query, k + 1, id_col, vector).where(F.col(id_col) != key)
    return found.orderBy("distance", id_col).limit(k).withColumn("similarity", similarity(F.col("distance")))


#: Vectors of each side that one task compares.
BLOCK_ROWS = 20_000


def nearest_to_each(
    corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``query, neighbour, distance, rank``: for each stored row of ``queries`` the ``k`` nearest other rows of ``corpus``, exactly.

    Both sides are cut into blocks by hash.  A task compares one block of
    queries with one of the corpus by a matrix product and hands on ``k`` rows a
    query, so what is merged for a query is ``k`` rows per corpus block.  Equal
    distances are ordered by id.  A vector of zeros has distance 1 to all.
    """
    kind = corpus.schema[id_col].dataType.simpleString()
    parts = [max(1, -(-side.count() // block_rows)) for side in (corpus, queries)]

    def blocks(side: DataFrame, own: int, name: str, others: str) -> DataFrame:
        every = F.sequence(F.lit(0), F.lit(parts[1 - own] - 1))
        mine = F.pmod(F.xxhash64(id_col), F.lit(parts[own])).cast("int")
        rows = side.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vec"), mine.alias(name))
        return rows.withColumn(others, F.explode(every)).repartition(parts[0] * parts[1], "of", "to")

    def compare(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        found: list[tuple[list, list, list]] = []
        if rows.num_rows and wanted.num_rows:
            def unit(table: pa.Table) -> np.ndarray:
                x = np.array(table["vec"].to_pylist(), dtype=np.float64)
                size = np.sqrt((x * x).sum(axis=1, keepdims=True))
                return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

            rows = rows.sort_by("id")  # a stable sort by distance then breaks ties by id
            ids, own = rows["id"].to_pylist(), unit(rows)
            for begin in range(0, wanted.num_rows, 256):
                part = wanted.slice(begin, 256)
                distance = 1.0 - unit(part) @ own.T
                # one more than wanted: the query itself may be among them
                top = np.argsort(np.round(distance, 12), axis=1, kind="stable")[:, :k + 1]
                for query, at, d in zip(part["id"].to_pylist(), top, distance):
                    near = [j for j in at if ids[j] != query][:k]
                    found.append(([query] * len(near), [ids[j] for j in near], d[near].tolist()))
        kind_of = wanted.schema.field("id").type
        columns = [[x for f in found for x in f[i]] for i in range(3)]
        return pa.table([pa.array(columns[0], kind_of), pa.array(columns[1], kind_of), pa.array(columns[2], pa.float64())], names=["query", "neighbour", "distance"])

    left, right = blocks(corpus, 0, "of", "to"), blocks(queries, 1, "to", "of")
    near = left.groupBy("of", "to").cogroup(right.groupBy("of", "to")).applyInArrow(compare, f"query {kind}, neighbour {kind}, distance double")
    by_distance = Window.partitionBy("query").orderBy(F.round("distance", 12), "neighbour")
    return near.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= k)
