"""Packets to alerts, end to end."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.functions.vectors import FEATURES, assemble
from flowsift.operators import baseline, connections, ensemble, flows, forest, gates, learn, refit
from flowsift.operators.alerts import COOLDOWN_US, cooldown
from flowsift.operators.signatures import Rule
from flowsift.session import cut_lineage

#: Takes numbered flows with all features, adds one score column named after the detector.
Detector = Callable[[DataFrame], DataFrame]


def isolation_detector(warmup: int = baseline.WARMUP["isolation_forest"], **fit) -> Detector:
    """Fitted on the first ``warmup`` flows, which score 0."""

    def add(numbered: DataFrame) -> DataFrame:
        rows = numbered.withColumn("_vec", assemble())
        model = forest.fit_isolation_forest(rows.where(F.col("seq") <= warmup), "seq", "_vec", **fit)
        score = F.when(F.col("seq") <= warmup, 0.0).otherwise(F.col("_score"))
        return rows.withColumn("_score", model.score(F.col("_vec"))).withColumn("isolation_forest", score).drop("_vec", "_score")

    return add


def temporal_detector(warmup: int = baseline.WARMUP["transformer_ae"], k: int = 32) -> Detector:
    def add(numbered: DataFrame) -> DataFrame:
        rows = numbered.withColumn("_vec", assemble())
        model = learn.fit_temporal(rows, "_vec", warmup, k)
        scored = learn.flat_sequences(rows, "_vec").withColumn("_score", model.score(F.col("sequence")))
        score = F.when(F.col("seq") <= warmup, 0.0).otherwise(F.col("_score"))
        return scored.withColumn("transformer_ae", score).drop("_vec", "sequence", "_score")

    return add


def topology_detector(
    columns: Sequence[str] = FEATURES, k: int = 4, warmup: int | None = baseline.WARMUP["gnn_detector"]
) -> Detector:
    """Fitted on the graph of the first ``warmup`` flows, which score 0."""
    return lambda numbered: learn.topology_scores(numbered, columns, k, warmup=warmup)


def model_detector(name: str, model) -> Detector:
    """A fitted classifier as the ``xgboost`` or ``random_forest`` detector."""

    def add(numbered: DataFrame) -> DataFrame:
        scored = learn.attack_probability(model, numbered.withColumn("_vec", assemble()), "_vec", name)
        return scored.drop("_vec")

    return add


def refitted_detector(name: str, model: refit.Refit, every: int = refit.EVERY, window: int = refit.WINDOW, warmup: int = refit.WARMUP) -> Detector:
    """A detector under ``name`` whose model is fitted again every ``every`` flows; flows before the first version score 0."""
    return lambda numbered: refit.refitted_scores(numbered, assemble(), model, name, every, window, warmup)


DETECTORS: dict[str, Detector] = {"zscore": baseline.running_zscore}


def features_of(flow_rows: DataFrame, time_window_us: int, connections_kept: int) -> DataFrame:
    """All 23 features in processing order."""
    numbered = connections.number_flows(flows.with_basic_features(flow_rows))
    return connections.with_host_counts(connections.with_time_counts(numbered, time_window_us), connections_kept)


def decide_flows(
    packets: DataFrame,
    rules: Sequence[Rule],
    *,
    detectors: Mapping[str, Detector] = DETECTORS,
    weights: Mapping[str, float] = ensemble.WEIGHTS,
    timeout_us: int = flows.FLOW_TIMEOUT_US,
    time_window_us: int = connections.TIME_WINDOW_US,
    connections_kept: int = connections.CONNECTION_WINDOW,
) -> DataFrame:
    """One decision per flow.

    Flows whose payload matches a rule are certain and end there: they never
    enter the feature windows of the others.  Detectors not given score 0.
    """
    gated = cut_lineage(gates.gated_flows(packets, rules, timeout_us))  # read by both gates
    certain = gated.where("gate = 1").withColumn("aho_corasick", F.lit(1.0))
    scored = features_of(gated.where("gate = 2"), time_window_us, connections_kept)
    if not gated.where("gate = 2").isEmpty():  # nothing to fit on otherwise
        for add in detectors.values():
            scored = add(scored)
    scored = scored.withColumn("aho_corasick", F.lit(0.0))
    scored = scored.withColumns({n: F.lit(0.0) for n in weights if n not in scored.columns})
    both = certain.unionByName(scored, allowMissingColumns=True)
    return gates.gate_decision(both, ensemble.weighted_score(weights), ensemble.THRESHOLD)


def alerts_from(decisions: DataFrame, cooldown_us: int | None = COOLDOWN_US) -> DataFrame:
    """Alert records of the decisions that fired, timed at the flow's end."""
    names = list(ensemble.WEIGHTS)
    scored = decisions.where("is_alert").fillna(0.0, names)
    rows = scored.select(
        F.concat(F.lit("a"), F.col("flow_id")).alias("alert_id"), F.col("end_us").alias("ts_us"), "src_ip", "dst_ip",
        "dst_port", "confidence", ensemble.severity(F.col("confidence")).alias("severity"),
        F.lit("{}").alias("shap_explanation"), ensemble.rule_from_scores(names).alias("rule"),
        F.to_json(ensemble.fired_detectors(names)).alias("detectors"),
    )
    return rows if cooldown_us is None else cooldown(rows, cooldown_us)


def replay_summary(packets: DataFrame, decisions: DataFrame) -> DataFrame:
    """Packets, flows, alerts and covered seconds as one row."""
    zero = F.lit(0).cast("bigint")
    seen = packets.agg(
        F.count(F.lit(1)).alias("packets"), F.max(zero).alias("flows"), F.max(zero).alias("alerts"),
        ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("duration_sec"),
    )
    decided = decisions.agg(
        F.max(zero).alias("packets"), F.count(F.lit(1)).alias("flows"), F.count_if("is_alert").alias("alerts"),
        F.max(F.lit(0.0)).alias("duration_sec"),
    )
    return seen.unionByName(decided).agg(*[F.sum(c).alias(c) for c in ("packets", "flows", "alerts", "duration_sec")])
