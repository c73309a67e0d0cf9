"""How filters interact: what each removes at each place of each order.

Every document becomes a mask with one bit for each filter that it fails.
Documents with equal mask, part and labels are one cell, so at most 2^filters
cells (times the labels) of a part are left after one aggregation.

A walk over all subsets of filters in Gray-code order then toggles one filter
at a time.  Each cell keeps how many *active* filters it fails; where that
counter leaves or reaches 0 the cell leaves or joins the survivors.  The
survivors of all subsets are stored (32 states for five filters), and what a
filter removes at a place of an order is the difference of two of them.

Nulls: a null text is empty, a null part is the empty string.  Empty texts are
copies of each other.  Rows without an id are copies of nothing, nothing is a
copy of them, and they have no labels.  Repeated rows count each; rows that
share an id are not smaller than one another.  Of several labels of one id the
largest counts.  An empty table has no parts and gives an empty result.  Only
the named columns are used, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.llm.text import let, small, words
from flowsift.session import cut_lineage

#: Letters of the filters in the order of their bits.  The last one is the copy of an earlier text.
FILTERS = "ABCDE"
#: Documents, those of good quality, toxic ones.
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> Column:
    """Bits of the first four filters: few words, few distinct words, many capitals, symbols."""
    text = F.coalesce(text, F.lit(""))
    by_words = let(words(text), lambda w: F.when(F.size(w) < 200, 1).otherwise(0).bitwiseOR(
        F.when(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 2).otherwise(0)))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return by_words.bitwiseOR(F.when(100 * capitals > 3 * F.length(text), 4).otherwise(0)).bitwiseOR(
        F.when(text.rlike("[#$%&*|]"), 8).otherwise(0))


def masked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``doc_id, part, mask``: which of the five filters every document fails.

    Only a digest of a text is moved.  Who holds a text first is one minimum
    for each text; it is joined by text *and* id, so a text that very many
    documents share is spread over the tasks like any other.
    """
    faced = cut_lineage(docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"), text_failures(F.col(text)).alias("own")))
    firsts = faced.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"))
    first = firsts.select(F.col("digest").alias("_digest"), "first")
    joined = faced.join(first, (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("first")), "left")
    copied = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return joined.select("doc_id", "part", F.col("own").bitwiseOR(F.when(copied, 16).otherwise(0)).alias("mask"))


def cells(faced: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``part, cells``: for every part the counts of its masks (``mask, n, good, toxic``)."""
    marks = cut_lineage(labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("bad")))
    marked = faced.join(small(marks), F.col("doc_id") == F.col("_id"), "left")
    counted = marked.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("bad").alias("toxic"))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))


def walk(masks: np.ndarray, counts: np.ndarray, filters: int) -> np.ndarray:
    """Survivors of every subset of filters: row s holds the counts of the cells that fail no filter of s.

    Subsets come in Gray-code order, so each differs from the one before in one
    filter; ``failed`` holds how many active filters each cell fails.
    """
    states = np.zeros((1 << filters, counts.shape[1]), dtype=np.int64)
    failed = np.zeros(len(masks), dtype=np.int64)
    running = counts.sum(axis=0)
    states[0], subset = running, 0
    for i in range(1, 1 << filters):
        bit = i & -i  # the bit that the Gray code changes
        subset ^= bit
        touched = (masks & bit) != 0
        if subset & bit:
            gone = touched & (failed == 0)
            running = running - counts[gone].sum(axis=0)
            failed[touched] += 1
        else:
            failed[touched] -= 1
            back = touched & (failed == 0)
            running = running + counts[back].sum(axis=0)
        states[subset] = running
    return states


def steps(states: np.ndarray, filters: Sequence[str] = FILTERS) -> dict[str, list]:
    """One row for each order of the filters and each of its steps."""
    everything = len(states) - 1
    total = {f: 0 for f in filters}
    out: dict[str, list] = {c: [] for c in ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
    letters = []
    for order in permutations(range(len(filters))):
        subset = 0
        for step, f in enumerate(order, 1):
            before, after = states[subset], states[subset | 1 << f]
            lost = before - after
            failing = states[0] - states[1 << f]
            row = ("".join(filters[x] for x in order), step, after[0], lost[0], failing[0] - lost[0],
                   (states[everything & ~(1 << f)] - states[everything])[0], lost[1], lost[2])
            for column, value in zip(out, row):
                out[column].append(value if isinstance(value, str) else int(value))
            total[filters[f]] += int(lost[0])
            letters.append(filters[f])
            subset |= 1 << f
    out["shapley"] = [total[f] for f in letters]
    return out


_ROW = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long")


def audit(counted: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """Rows of all orders and steps for each row ``part, cells``."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                masks = np.array([c["mask"] for c in own], dtype=np.int64)
                counts = np.array([[c[k] for k in COUNTS] for c in own], dtype=np.int64).reshape(-1, len(COUNTS))
                rows: Mapping[str, list] = steps(walk(masks, counts, len(filters)), filters)
                n = len(rows["step"])
                kinds = {"filter_order": pa.string(), "step": pa.int32()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.string()), *(pa.array(v, kinds.get(c, pa.int64())) for c, v in rows.items())], names=["part", *rows])

    return counted.select("part", "cells").mapInArrow(walked, _ROW)


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five text filters over ``docs``, by language."""
    return audit(cells(masked(docs), labels))
