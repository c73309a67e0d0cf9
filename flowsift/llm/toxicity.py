"""Toxicity as severity grades: cumulative-link ordinal regression.

P(grade <= j) = sigmoid(threshold_j - w x): one weight per feature, shared by
all ordered thresholds.  The output is the expected grade and the chance of any
grade above 0.

Features are the distinct words of a text, lower-cased, and their first five
letters.  Only features tied to toxic labels enter: their frequency among toxic
texts exceeds chance by ``LEAST_Z`` standard errors and most texts that have
them are toxic.  The labels say toxic or not.  A toxic text's grade is 1, 2 or
3 by how many distinct such words it has (up to 2, up to 5, more).

The fit sees a bounded sample of labelled rows (``fit_rows``, those with the
smallest hashes of their ids) and at most ``MOST_FEATURES`` features; scoring
covers every document's whole text.

Null and empty texts have no features; they get the grade of a text without any.
Repeated rows get equal grades.  Without toxic labels nothing is toxic.  An
empty table gives an empty result.  Other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.session import cut_lineage

FIT_ROWS = 20_000
MOST_FEATURES = 4096
LEAST_Z = 4.0
LEAST_TEXTS = 3
PREFIX = 5
#: Chance of a grade above 0 from which a document counts as toxic.
REJECT = 0.3
#: Most distinct toxic words of grades 1 and 2.
GRADES = (2, 5)

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """Distinct words, and the beginnings of long ones marked by ``^``."""
    words = set(_WORD.findall(text.lower()))
    return words | {"^" + w[:PREFIX] for w in words if len(w) >= PREFIX}


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]

    def exceeding(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold, one row per text."""
        return 1.0 / (1.0 + np.exp(np.clip(np.array(self.thresholds)[None, :] - score[:, None], -50, 50)))


def fit_ordinal(row: np.ndarray, column: np.ndarray, grade: np.ndarray, n_features: int, grades: int,
                l2: float = 1e-5, steps: int = 1500, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of a sparse 0/1 design by Adam on the mean negative log-likelihood.

    Thresholds are a first one and positive gaps, so they stay in order.
    """
    n = len(grade)
    # parameters: weights, first threshold, log gaps
    p = np.concatenate([np.zeros(n_features), [1.0], np.zeros(grades - 2)])
    mean, square = np.zeros_like(p), np.zeros_like(p)

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))

    for step in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1:])
        theta = np.concatenate([[-np.inf], p[n_features] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(row, weights=w[column], minlength=n)
        upper, lower = sigmoid(theta[grade + 1] - score), sigmoid(theta[grade] - score)
        likely = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / likely, lower * (1 - lower) / likely
        by_score = (du - dl) / n  # derivative of the negative log-likelihood
        at = np.zeros(grades + 1)
        np.add.at(at, grade + 1, -du / n)
        np.add.at(at, grade, dl / n)
        inner = at[1:grades]
        slope = np.concatenate([
            np.bincount(column, weights=by_score[row], minlength=n_features) + l2 * w,
            [inner.sum()], [inner[j + 1:].sum() * gaps[j] for j in range(grades - 2)],
        ])
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope ** 2
        p = p - rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-9)
    return p[:n_features], p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1:]))])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Model from ``labels`` (``doc_id``, ``toxic``) over ``docs`` (``doc_id`` and the text)."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    chosen = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "toxic", "features"])

    rows = cut_lineage(chosen.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
                       .mapInArrow(featured, "doc_id long, toxic int, features array<string>"))
    n, positive = rows.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    if not positive:
        return Model({}, [50.0])
    counts = rows.select(F.explode("features").alias("feature"), "toxic").groupBy("feature").agg(
        F.count(F.lit(1)).alias("all"), F.count_if(F.col("toxic") == 1).alias("bad"))
    rate = F.least((F.col("all") + 1) / F.lit(float(n + 1)), F.lit(0.999))
    z = (F.col("bad") - positive * rate) / F.sqrt(positive * rate * (1 - rate))
    tied = counts.where((F.col("bad") >= LEAST_TEXTS) & (2 * F.col("bad") > F.col("all"))).withColumn("z", z).where(F.col("z") >= LEAST_Z)
    chosen_features = [r["feature"] for r in tied.orderBy(F.desc("z"), "feature").limit(MOST_FEATURES).collect()]
    if not chosen_features:
        return Model({}, [50.0])
    wanted = F.array(*[F.lit(f) for f in chosen_features])
    sparse = rows.select("toxic", F.array_intersect("features", wanted).alias("features")).collect()  # at most fit_rows short rows
    place = {f: i for i, f in enumerate(chosen_features)}
    row = np.repeat(np.arange(len(sparse)), [len(r["features"]) for r in sparse])
    column = np.array([place[f] for r in sparse for f in r["features"]], dtype=np.int64)
    n_words = np.array([sum(not f.startswith("^") for f in r["features"]) for r in sparse])
    toxic = np.array([r["toxic"] for r in sparse]) == 1
    grade = np.where(toxic, 1 + np.searchsorted(GRADES, n_words), 0)
    present = np.unique(grade)  # a grade that does not occur needs no threshold
    w, theta = fit_ordinal(row, column, np.searchsorted(present, grade), len(place), max(len(present), 2))
    return Model(dict(zip(chosen_features, w.tolist())), theta.tolist())


def graded(docs: DataFrame, model: Model, text: str = "text", severity: str = "severity", chance: str = "toxic_probability") -> DataFrame:
    """``docs`` with the expected grade and P(grade > 0); clashing columns are replaced."""
    kept = docs.drop(severity, chance)
    spot = kept.columns.index(text) if text in kept.columns else None
    schema = T.StructType([*kept.schema.fields, T.StructField(severity, T.DoubleType()), T.StructField(chance, T.DoubleType())])
    weights = model.weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([
                sum(weights[f] for f in features(t).intersection(weights)) if t else 0.0 for t in batch.column(spot).to_pylist()
            ], dtype=np.float64)
            above = model.exceeding(scores)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(above.sum(axis=1)), pa.array(above[:, 0])], names=[*batch.schema.names, severity, chance])

    return kept.mapInArrow(score, schema)


def acceptable(docs: DataFrame, labels: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that are not toxic, with their columns as they are."""
    names, hidden = list(docs.columns), ["_severity", "_chance"]
    while any(h.lower() in {n.lower() for n in names} for h in hidden):
        hidden = [h + "_" for h in hidden]
    scored = graded(docs, fit(docs, labels, text, fit_rows), text, *hidden)
    return scored.where(F.col(hidden[1]) < REJECT).select(*names)


def report(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    scored = graded(docs.select("doc_id", "text"), fit(docs, labels, fit_rows=fit_rows))
    return scored.select("doc_id", "severity", "toxic_probability", (F.col("toxic_probability") >= REJECT).alias("toxic"))
