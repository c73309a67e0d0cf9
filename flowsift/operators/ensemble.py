"""Weighted vote of the detectors and feedback on their weights."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.functions.vectors import clip01
from flowsift.operators.ordering import keyed_seq, last_rows, range_sorted

# Starting weights (in score order), decision threshold and feedback constants.
WEIGHTS = {
    "aho_corasick": 0.20, "xgboost": 0.22, "random_forest": 0.08, "isolation_forest": 0.12,
    "transformer_ae": 0.15, "gnn_detector": 0.15, "zscore": 0.08,
}
THRESHOLD = 0.5
OUTCOMES_KEPT = 100
MIN_WEIGHT = 0.01
RECOVERY_RATE = 0.05

RULE_NAMES = {
    "aho_corasick": "Signature Match", "xgboost": "ML Anomaly", "gnn_detector": "Topology Anomaly",
    "transformer_ae": "Temporal Anomaly", "isolation_forest": "Statistical Outlier",
    "zscore": "Z-Score Spike", "random_forest": "ML Anomaly",
}
SEVERITIES = [(0.90, "CRITICAL"), (0.75, "HIGH"), (0.60, "MED")]  # below: LOW


def weighted_score(weights: Mapping[str, float] = WEIGHTS, columns: Mapping[str, Column] | None = None) -> Column:
    """Clipped weighted sum of one score column per detector; absent scores count 0."""
    scores = columns or {n: F.col(n) for n in weights}
    terms = [F.coalesce(scores[n], F.lit(0.0)) * w for n, w in weights.items() if n in scores]
    return clip01(reduce(lambda a, b: a + b, terms, F.lit(0.0)))


def decide(df: DataFrame, weights: Mapping[str, float] = WEIGHTS, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``confidence`` and ``is_alert`` (strictly above the threshold)."""
    return df.withColumn("confidence", weighted_score(weights)).withColumn("is_alert", F.col("confidence") > threshold)


def decide_from_map(df: DataFrame, scores: str = "scores", weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """The same for a map column; detectors without a weight contribute nothing."""
    named = {n: F.try_element_at(F.col(scores), F.lit(n)) for n in weights}
    decided = df.withColumn("confidence", weighted_score(weights, named))
    return decided.withColumn("is_alert", F.col("confidence") > THRESHOLD)


def severity(confidence: Column) -> Column:
    band = F.lit("LOW")
    for floor, name in reversed(SEVERITIES):
        band = F.when(confidence >= floor, name).otherwise(band)
    return band


def score_entries(names: list[str]) -> Column:
    """Scores as an array of structs, highest first, ties in the given order."""
    entries = F.array(*[
        F.struct((-F.col(n)).alias("neg"), F.lit(i).alias("at"), F.lit(n).alias("name")) for i, n in enumerate(names)
    ])
    return F.sort_array(entries)


def fired_detectors(names: list[str], above: float = 0.5) -> Column:
    """Detectors above ``above``, highest first."""
    return F.transform(F.filter(score_entries(names), lambda e: -e["neg"] > above), lambda e: e["name"])


def rule_from_scores(names: list[str]) -> Column:
    """Rule name of the highest-scoring detector; ties go to the first."""
    top = F.get(score_entries(names), F.lit(0))["name"]
    rule = F.lit("Unknown")
    for name, text in RULE_NAMES.items():
        rule = F.when(top == name, text).otherwise(rule)
    return rule


def false_positive_rate(feedback: DataFrame, kept: int = OUTCOMES_KEPT) -> DataFrame:
    """Share of false positives among a detector's last ``kept`` outcomes.

    A handful of detectors would make a handful of huge windows, so each
    detector's outcomes are numbered and cut into blocks first.
    """
    numbered = keyed_seq(feedback, ["detector"], ["ts_us", "feedback_id"], "_k")
    spread, part = last_rows(numbered, ["detector"], "_k", kept - 1)
    window = Window.partitionBy(*part).orderBy("_k").rowsBetween(-(kept - 1), 0)
    rated = spread.withColumn("fp_rate", F.avg(F.col("was_false_positive").cast("double")).over(window))
    return rated.where("_own").drop("_k", "_block", "_own")


def weights_after_feedback(
    feedback: DataFrame, weights: Mapping[str, float] = WEIGHTS, chunk_rows: int = 1_000_000
) -> DataFrame:
    """Detector weights after all feedback, in order.

    Every event rescales all weights, so events are inherently sequential.
    The costly part, the rates, is parallel; the rest hands seven numbers from
    one sorted chunk to the next, reading each chunk once in constant memory.
    """
    names = list(weights)
    spark = feedback.sparkSession
    known = feedback.where(F.col("detector").isin(names))
    rated = false_positive_rate(known).select("ts_us", "feedback_id", "detector", "was_false_positive", "fp_rate")
    chunks = max(1, -(-known.count() // chunk_rows))
    placed = range_sorted(rated, ["ts_us", "feedback_id"], chunks)
    outcomes = placed.select("detector", "was_false_positive", "fp_rate")
    initial = dict(weights)
    current = dict(weights)

    for chunk in range(chunks):
        state = dict(current)

        def fold(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            w, seen = dict(state), False
            for batch in batches:
                seen = seen or batch.num_rows > 0
                columns = (batch.column(c).to_pylist() for c in ("detector", "was_false_positive", "fp_rate"))
                for name, false_positive, rate in zip(*columns):
                    if false_positive:
                        w[name] = max(MIN_WEIGHT, initial[name] * (1.0 - rate))
                    else:
                        w[name] = min(initial[name], w[name] + RECOVERY_RATE * (initial[name] - w[name]))
                    total = sum(w.values())
                    w = {k: v / total for k, v in w.items()}
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(w)), pa.array(list(w.values()), pa.float64())], names=["detector", "weight"]
                )

        folded = outcomes.mapInArrow(fold, "detector string, weight double")
        for row in spark.sparkContext.runJob(folded.rdd, list, [chunk]):  # this partition only
            current[row["detector"]] = row["weight"]
    return spark.createDataFrame([(n, float(current[n])) for n in names], "detector string, weight double")


def normalised(weights: DataFrame, digits: int = 3) -> DataFrame:
    """Scale a weight table (one row per detector) to sum to 1."""
    total = weights.agg(F.sum("weight")).first()[0] or 1.0
    return weights.withColumn("weight", F.round(F.col("weight") / total, digits))
