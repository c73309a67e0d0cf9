"""Alert de-duplication, the alert table and the queries over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.operators.anchors import RunRule, assign_runs

COOLDOWN_US = 60_000_000  # fixed value: 60 s


def cooldown(
    alerts: DataFrame,
    cooldown_us: int = COOLDOWN_US,
    keys: Sequence[str] = ("src_ip", "dst_ip", "dst_port"),
    ties: Sequence[str] = ("alert_id",),
    **split,
) -> DataFrame:
    """Keep an alert if the last *kept* one of its key is at least ``cooldown_us`` old."""
    rule = RunRule(cooldown_us, strict=False, consume=False)
    return assign_runs(alerts, list(keys), "ts_us", list(ties), rule, **split).where("is_anchor").drop(
        "anchor_us", "is_anchor"
    )


def alert_defaults(alerts: DataFrame) -> DataFrame:
    """Nulls to the record's defaults, and the casts of the alert record."""
    return alerts.withColumns({
        "src_ip": F.coalesce("src_ip", F.lit("")),
        "dst_ip": F.coalesce("dst_ip", F.lit("")),
        "dst_port": F.coalesce(F.col("dst_port").cast("int"), F.lit(0)),
        "confidence": F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)),
        "severity": F.coalesce("severity", F.lit("LOW")),
        "shap_explanation": F.coalesce("shap_explanation", F.lit("{}")),
    })


def epoch_seconds(ts_us: Column) -> Column:
    return F.coalesce(ts_us / F.lit(1e6), F.lit(0.0))


def recent(alerts: DataFrame, n: int = 50, by: str = "ts_us", tie: str = "alert_id") -> DataFrame:
    return alerts.orderBy(F.desc(by), F.asc(tie)).limit(n)


def filtered(alerts: DataFrame, severity: str | None = None, since_us: int | None = None) -> DataFrame:
    if severity is not None:
        alerts = alerts.where(F.col("severity") == severity.upper())
    if since_us is not None:
        alerts = alerts.where(F.col("ts_us") >= since_us)
    return alerts


def limit_then_filter(alerts: DataFrame, n: int, severity: str | None = None, since_us: int | None = None) -> DataFrame:
    """The newest ``n`` first, then the filter: may return fewer than exist."""
    return filtered(recent(alerts, n), severity, since_us)


def by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.where(F.col("alert_id") == alert_id).limit(1)


def by_source(alerts: DataFrame, asof_us: int, hours: int = 24, top: int = 100) -> DataFrame:
    since = asof_us - hours * 3_600_000_000
    counts = alerts.where(F.col("ts_us") >= since).groupBy("src_ip").agg(F.count(F.lit(1)).alias("alert_count"))
    return counts.orderBy(F.desc("alert_count"), "src_ip").limit(top)


def active_flows(alerts: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` alerts as flows, highest score first."""
    flows = recent(alerts, n).select(
        "src_ip", "dst_ip", F.lit("TCP").alias("proto"), F.col("confidence").alias("score"), "severity",
        detector_list(F.col("detectors")).alias("detectors"), F.lit(0).cast("bigint").alias("bytes"), "alert_id",
    )
    return flows.orderBy(F.desc("score"), "alert_id")


def detector_list(text: Column) -> Column:
    """A JSON list of names; anything else is the empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def cluster_summary(alerts: DataFrame) -> DataFrame:
    counts = alerts.groupBy("rule").agg(F.count(F.lit(1)).alias("alerts"))
    return counts.orderBy(F.desc("alerts"), "rule")


def gate_counts(alerts: DataFrame) -> DataFrame:
    signature = F.coalesce(F.col("rule") == "Signature Match", F.lit(False))
    return alerts.agg(F.count_if(signature).alias("gate1"), F.count_if(~signature).alias("gate2"))


def retained(alerts: DataFrame, asof_us: int, days: int) -> DataFrame:
    """Alerts of the last ``days`` days; on a table partitioned by day this prunes files."""
    return alerts.where(F.col("ts_us") >= asof_us - days * 86_400_000_000)


def alert_count(alerts: DataFrame, limit: int | None = None) -> DataFrame:
    source = alerts.select("alert_id") if limit is None else alerts.select("alert_id").limit(limit)
    return source.agg(F.count(F.lit(1)).alias("alerts"))


def attribution_rows(alerts: DataFrame, text: str = "shap_explanation") -> DataFrame:
    """One row per alert and feature of its JSON attribution map."""
    parsed = F.from_json(F.col(text), "map<string,double>")
    return alerts.select("alert_id", F.explode(parsed).alias("feature", "value"))


def topk_attribution(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest values by magnitude per alert, ties by name."""
    window = Window.partitionBy("alert_id").orderBy(F.desc(F.abs("value")), "feature")
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _largest(text: str, k: int) -> Column:
    """The ``k`` largest entries of a JSON map by magnitude, ties by name."""
    entries = F.map_entries(F.from_json(F.col(text), "map<string,double>"))
    ordered = F.sort_array(F.transform(entries, lambda e: F.struct(
        (-F.abs(e["value"])).alias("size"), e["key"].alias("feature"), e["value"].alias("value"))))
    return F.slice(ordered, 1, k)


def top_attributions(alerts: DataFrame, k: int, text: str = "shap_explanation") -> DataFrame:
    """:func:`topk_attribution` for a map that sits in the alert's row: no shuffle."""
    rows = alerts.select("alert_id", F.posexplode(_largest(text, k)).alias("_at", "_e"))
    return rows.select("alert_id", "_e.feature", "_e.value", (F.col("_at") + 1).alias("rank"))


def explain_alert(alerts: DataFrame, alert_id: str, k: int = 10) -> DataFrame:
    rows = top_attributions(by_id(alerts, alert_id), k)
    return rows.withColumn("direction", F.when(F.col("value") > 0, "attack").otherwise("normal"))


def explanation_text(alerts: DataFrame, k: int = 5, text: str = "shap_explanation") -> DataFrame:
    """``"name (+0.420), ..."`` for the ``k`` largest values, without leaving the row."""
    parts = F.transform(_largest(text, k), lambda e: F.format_string("%s (%+.3f)", e["feature"], e["value"]))
    return alerts.withColumn("explanation", F.array_join(parts, ", "))


def explanation_json(top: Column, summary: Column) -> Column:
    return F.to_json(F.struct(top.alias("top_features"), summary.alias("summary")))


def feature_importance(rows: DataFrame, top: int = 20) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    means = rows.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))
    return means.orderBy(F.desc("importance"), "feature").limit(top)


def recent_audit(log: DataFrame, n: int = 100) -> DataFrame:
    return recent(log, n, "ts_us", "id")
