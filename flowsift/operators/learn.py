"""Supervised detectors, search and reconstruction detectors on MLlib."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.functions.vectors import clip01
from flowsift.operators import graph
from flowsift.operators.baseline import THRESHOLD_FLOOR, last_sequences, training_sequences
from flowsift.operators.ordering import exact_percentiles, keyed_seq
from flowsift.session import cut_lineage, shuffle_partitions


_FOLD_ROWS = 50_000


def as_vectors(df: DataFrame, vector: str, out: str = "_features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vector).cast("array<double>")))


def balanced_weights(df: DataFrame, label: str, out: str = "_weight") -> DataFrame:
    """n / (classes * n_class) per row; the class table has one row per class."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = F.lit(1.0)
    for value, rows in counts.items():
        weight = F.when(F.col(label) == value, n / (len(counts) * rows)).otherwise(weight)
    return df.withColumn(out, weight)


def random_forest(trees: int = 200, depth: int = 10, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="_features", labelCol="_label", weightCol="_weight", numTrees=trees, maxDepth=depth, seed=seed
    )


def boosted_trees(rounds: int = 100, depth: int = 5, step: float = 0.1, rows: float = 0.8, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(
        featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=rounds, maxDepth=depth, stepSize=step,
        subsamplingRate=rows, seed=seed,
    )


def training_frame(df: DataFrame, vector: str, label: str, weighted: bool = True) -> DataFrame:
    ready = as_vectors(df, vector).withColumn("_label", F.col(label).cast("double"))
    return balanced_weights(ready, "_label") if weighted else ready.withColumn("_weight", F.lit(1.0))


def attack_probability(model, df: DataFrame, vector: str, out: str) -> DataFrame:
    """Probability of class 1 as a plain column."""
    scored = model.transform(as_vectors(df, vector)).withColumn(out, vector_to_array("probability").getItem(1))
    return scored.drop("_features", "probability", "rawPrediction", "prediction")


def stratified_folds(df: DataFrame, label: str, row_id: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Fold numbers of equal size within each class, in hash order.

    Every fit on the folds runs many short jobs over them, so there are no more
    partitions than cores until each holds ``_FOLD_ROWS`` rows.
    """
    spark = df.sparkSession
    partitions = min(shuffle_partitions(spark), max(spark.sparkContext.defaultParallelism, df.count() // _FOLD_ROWS))
    hashed = df.withColumn("_h", F.xxhash64(F.col(row_id), F.lit(seed)))
    numbered = keyed_seq(hashed, [label], ["_h", row_id], "_k", partitions)
    return numbered.withColumn("fold", F.pmod(F.col("_k") - 1, F.lit(folds)).cast("int")).drop("_h", "_k")


def random_grid(choices: dict[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """``n`` distinct random combinations."""
    every = [dict(zip(choices, values)) for values in itertools.product(*choices.values())]
    picked = np.random.default_rng(seed).permutation(len(every))[:n]
    return [every[i] for i in sorted(picked)]


def search(estimator, folded: DataFrame, grid: list[dict], folds: int = 5, parallelism: int = 4):
    """Cross-validated search over a training frame with a ``fold`` column."""
    maps = [{estimator.getParam(k): v for k, v in point.items()} for point in grid]
    evaluator = BinaryClassificationEvaluator(labelCol="_label", rawPredictionCol="rawPrediction")
    return CrossValidator(
        estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, foldCol="fold",
        parallelism=parallelism,
    ).fit(folded)


@dataclass(frozen=True)
class Halving:
    """What :func:`halving_search` found: the best point's number, each point's area per fold seen, and the fits made."""

    best: int
    areas: dict[int, list[float]]
    fits: int


def fold_areas(
    estimator, folded: DataFrame, grid: list[dict], folds: Sequence[int], points: Sequence[int] | None = None, parallelism: int = 4,
    known: dict | None = None,
) -> dict:
    """Area under the curve on each fold of a model fitted on the others, as ``{(point, fold): area}``; fits run side by side.

    ``known`` areas, of the same estimator, folds and grid, are not worked out again.
    """
    evaluator = BinaryClassificationEvaluator(labelCol="_label", rawPredictionCol="rawPrediction")

    def area(job: tuple[int, int]) -> float:
        point, fold = job
        chosen = {estimator.getParam(k): v for k, v in grid[point].items()}
        model = estimator.fit(folded.where(F.col("fold") != fold), chosen)
        return evaluator.evaluate(model.transform(folded.where(F.col("fold") == fold)))

    jobs = [(point, fold) for point in (range(len(grid)) if points is None else points) for fold in folds]
    given = {job: known[job] for job in jobs if job in (known or {})}
    left = [job for job in jobs if job not in given]
    with ThreadPoolExecutor(parallelism) as pool:  # only submits jobs: the fits are Spark's
        return given | dict(zip(left, pool.map(area, left)))


def halving_search(estimator, folded: DataFrame, grid: list[dict], folds: int = 5, keep: float = 0.5, parallelism: int = 4) -> Halving:
    """Search that stops poor points early: every round scores the points left on the next fold and keeps the better share.

    Points are compared by their mean over the folds seen; ties go to the
    earlier point.  The best of those that have seen every fold wins.
    """
    left, areas, fits = list(range(len(grid))), {k: [] for k in range(len(grid))}, 0
    for fold in range(folds):
        found = fold_areas(estimator, folded, grid, [fold], left, parallelism)
        fits += len(found)
        for point in left:
            areas[point].append(found[point, fold])
        ranked = sorted(left, key=lambda k: (-sum(areas[k]) / len(areas[k]), k))
        left = ranked if fold == folds - 1 else ranked[:max(2, math.ceil(len(ranked) * keep))]
    return Halving(left[0], areas, fits)


# --- reconstruction -----------------------------------------------------------------


@dataclass(frozen=True)
class Reconstruction:
    """A linear autoencoder: standardise, project on principal axes, expand back."""

    mean: np.ndarray
    std: np.ndarray
    axes: np.ndarray
    threshold: float = 1.0

    def error(self, vector: Column) -> Column:
        mean, std, axes = self.mean, self.std, self.axes

        @F.pandas_udf("double")
        def mse(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype="float64")
            known = rows.notna().to_numpy()
            out = np.full(len(rows), np.nan)
            if known.any():
                z = (np.stack([np.asarray(r, dtype=np.float64) for r in rows[known]]) - mean) / std
                out[known] = ((z - z @ axes @ axes.T) ** 2).mean(axis=1)
            return pd.Series(out)

        return F.nanvl(mse(vector), F.lit(None).cast("double"))

    def project(self, vector: Column, unit: bool = False) -> Column:
        """Coordinates on the axes, scaled to unit length if asked."""
        mean, std, axes = self.mean, self.std, self.axes

        def place(row) -> list[float] | None:
            if row is None:
                return None
            at = (np.asarray(row, dtype=np.float64) - mean) / std @ axes
            size = float(np.sqrt(at @ at)) if unit else 1.0
            return (at / (size or 1.0)).tolist()

        @F.pandas_udf("array<double>")
        def coordinates(rows: pd.Series) -> pd.Series:
            return rows.map(place)

        return coordinates(vector)

    def score(self, vector: Column) -> Column:
        """Clipped error over the threshold; 0 where there is no vector yet."""
        return F.coalesce(clip01(self.error(vector) / self.threshold), F.lit(0.0))


def fit_reconstruction(df: DataFrame, vector: str, k: int, fraction: float) -> Reconstruction:
    """PCA axes, and the error percentile of the training rows as threshold."""
    from pyspark.ml.feature import StandardScaler

    rows = as_vectors(df.where(F.col(vector).isNotNull()), vector, "_raw")
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_z").fit(rows)
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    k = min(k, len(mean))
    axes = PCA(k=k, inputCol="_z", outputCol="_p").fit(scaler.transform(rows)).pc.toArray()
    model = Reconstruction(mean, np.where(std > 0, std, 1.0), axes)
    [threshold] = exact_percentiles(df.select(model.error(F.col(vector)).alias("_e")), "_e", [fraction])
    return Reconstruction(model.mean, model.std, axes, max(float(threshold), THRESHOLD_FLOOR))


def flat_sequences(numbered: DataFrame, vector: str, length: int = 10) -> DataFrame:
    """The last ``length`` vectors joined to one, null until full."""
    listed = last_sequences(numbered, F.col(vector), length)
    return listed.withColumn("sequence", F.flatten("sequence"))


def fit_temporal(numbered: DataFrame, vector: str, warmup: int, k: int = 32, length: int = 10) -> Reconstruction:
    """Fit on back-to-back sequences of the first ``warmup`` rows; threshold p90."""
    first = numbered.where(F.col("seq") <= warmup)
    total = first.count()
    training = training_sequences(first, F.col(vector), total, length).select(F.flatten("sequence").alias("sequence"))
    return fit_reconstruction(training, "sequence", k, 0.90)


def sequence_embedding(df: DataFrame, model: Reconstruction, sequence: str = "sequence") -> DataFrame:
    """Unit-length projection of a sequence, for the similarity store."""
    return df.withColumn("embedding", model.project(F.col(sequence), unit=True))


def host_errors(
    flows: DataFrame, columns: Sequence[str], k: int = 4, hops: int = 2, warmup: int | None = None, seq: str = "seq"
) -> tuple[DataFrame, float]:
    """``ip, _error`` of every host, and the 95th percentile of the hosts that the model was fitted on.

    A host is described by its own mean flow vector and its neighbourhood's.
    With ``warmup`` the model is fitted on the graph of the first flows only.
    """

    def described_by(rows: DataFrame) -> DataFrame:
        nodes = graph.node_features(rows, columns)
        near = graph.propagate(graph.normalised_adjacency(graph.undirected_edges(rows)), nodes, columns, hops)
        both = graph.with_self(nodes, near, columns)
        return cut_lineage(both.select("ip", F.array(*[F.col(c) for c in both.columns if c != "ip"]).alias("_node")))

    described = described_by(flows)
    early = described if warmup is None else described_by(flows.where(F.col(seq) <= warmup))
    model = fit_reconstruction(early, "_node", k, 0.95)
    return described.select("ip", model.error(F.col("_node")).alias("_error")), model.threshold


def topology_scores(
    flows: DataFrame, columns: Sequence[str], k: int = 4, hops: int = 2, warmup: int | None = None, seq: str = "seq"
) -> DataFrame:
    """Mean reconstruction error of a flow's two hosts over the hosts' p95, clipped.

    With ``warmup`` the first flows score 0.  The flows are written out once:
    six steps read them.
    """
    flows = cut_lineage(flows)
    errors, threshold = host_errors(flows, columns, k, hops, warmup, seq)
    source = errors.withColumnsRenamed({"ip": "src_ip", "_error": "_src"})
    target = errors.withColumnsRenamed({"ip": "dst_ip", "_error": "_dst"})
    joined = flows.join(source, "src_ip").join(target, "dst_ip")
    score = clip01((F.col("_src") + F.col("_dst")) / 2.0 / threshold)
    if warmup is not None:
        score = F.when(F.col(seq) <= warmup, 0.0).otherwise(score)
    return joined.withColumn("gnn_detector", score).drop("_src", "_dst")


def plane(df: DataFrame, vector: str, row_id: str, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Two principal coordinates of every row, fitted on all rows; with ``sample`` on that many at most, the same ones in every run."""
    from flowsift.functions.labels import deterministic_sample

    drawn = df if sample is None else deterministic_sample(df, row_id, sample, seed)
    model = fit_reconstruction(drawn, vector, 2, 0.5)
    placed = df.withColumn("_xy", model.project(F.col(vector)))
    return placed.withColumns({"x": F.get("_xy", F.lit(0)), "y": F.get("_xy", F.lit(1))}).drop("_xy")
