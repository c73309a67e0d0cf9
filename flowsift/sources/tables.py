"""Stored alerts, vectors, audit log and model state as parquet tables."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.operators.ensemble import severity
from flowsift.session import cut_lineage


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _day(ts_us: str = "ts_us"):
    return F.date_format(F.timestamp_micros(F.col(ts_us)), "yyyy-MM-dd")


def unseen_alerts(alerts: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Alerts whose id is not stored yet; within a batch the earliest wins."""
    columns = alerts.columns
    first = alerts.groupBy("alert_id").agg(F.min_by(F.struct(*columns), F.struct("ts_us", *columns)).alias("_row"))
    rows = first.select("_row.*")
    return rows if stored is None else rows.join(stored.select("alert_id"), "alert_id", "left_anti")


#: Bits of a day's id filter as a power of two (16 MB when full), and bits that an id sets.  Only the reads depend on them.
FILTER_BITS = 27
FILTER_HASHES = 4


def _filters(path: str) -> str:
    """Beside the days of the table; the underscore hides it from readers of the table."""
    return f"{path}/_ids"


def _filter_bits(ids: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep, word, mask``: one row for each bit that an id sets."""
    places = F.array(*[F.xxhash64("alert_id", F.lit(i)).bitwiseAND((1 << FILTER_BITS) - 1) for i in range(FILTER_HASHES)])
    at = ids.select(*keep, F.explode(places).alias("_at"))
    return at.select(*keep, F.shiftright("_at", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_at").bitwiseAND(63).cast("int")).alias("mask"))


def _remember(rows: DataFrame, path: str) -> None:
    """Set the bits of the ids in the filters of their days; a day's words are joined where they are read."""
    words = _filter_bits(rows, ["dt"]).groupBy("dt", "word").agg(F.bit_or("mask").alias("bits"))
    words.repartition("dt").write.mode("append").partitionBy("dt").parquet(_filters(path))


def possible_days(ids: DataFrame, filters: DataFrame) -> DataFrame:
    """``alert_id, dt`` of the days whose filter has all bits of an id: all days that hold it, and seldom another."""
    bits = _filter_bits(ids, ["alert_id"]).distinct()
    wanted = bits.groupBy("alert_id").agg(F.count(F.lit(1)).alias("needed"))  # two hashes of an id may set one bit
    there = bits.join(filters, "word").where(F.col("bits").bitwiseAND(F.col("mask")) != 0)
    found = there.groupBy("alert_id", "dt").agg(F.countDistinct("word", "mask").alias("set"))
    return found.join(wanted, "alert_id").where(F.col("set") == F.col("needed")).select("alert_id", "dt")


def stored_ids(ids: DataFrame, path: str) -> DataFrame:
    """Those of ``ids`` that the table holds on any of its days.

    The filters of the days are read, not the table; only days that a filter
    cannot rule out are then read, by partition, for the exact answer.
    """
    spark = ids.sparkSession
    filters = spark.read.parquet(_filters(path)).withColumn("dt", F.col("dt").cast("string"))
    candidates = cut_lineage(possible_days(ids, filters))
    days = [r["dt"] for r in candidates.select("dt").distinct().collect()]  # at most the days of retention
    if not days:
        return ids.limit(0)
    return read_alerts(spark, path, days).select("alert_id").join(candidates.select("alert_id").distinct(), "alert_id", "left_semi").distinct()


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Add the alerts that are new to the table, by day.

    Filters are written first: a run that fails in between leaves bits without
    rows, which costs a read later, never a duplicate.
    """
    spark = alerts.sparkSession
    rows = cut_lineage(unseen_alerts(alerts, None))
    if _exists(spark, path):
        if not _exists(spark, _filters(path)):  # a table from before there were filters
            _remember(read_alerts(spark, path).select("alert_id", F.col("dt").cast("string").alias("dt")), path)
        rows = rows.join(stored_ids(rows.select("alert_id"), path), "alert_id", "left_anti")
    rows = cut_lineage(rows.select(*alerts.columns, _day().alias("dt")))
    if rows.isEmpty():
        return
    _remember(rows, path)
    rows.write.mode("append").partitionBy("dt").parquet(path)


def read_alerts(spark: SparkSession, path: str, days: Sequence[str] | None = None) -> DataFrame:
    """The alert table, or the partitions of some days (``yyyy-MM-dd``) of it."""
    stored = spark.read.parquet(path)
    if days is None:
        return stored
    wanted = F.col("dt").isin([datetime.date.fromisoformat(d) for d in days if d is not None])
    return stored.where(wanted | F.col("dt").isNull() if None in days else wanted)


def drop_old_alerts(spark: SparkSession, path: str, asof_us: int, days: int) -> None:
    """Retention: remove whole days before the limit, rewrite only the day it falls in."""
    since = asof_us - days * 86_400_000_000
    edge = spark.range(1).select(F.date_format(F.timestamp_micros(F.lit(since)), "yyyy-MM-dd")).first()[0]
    rows = spark.read.parquet(path)
    partial = cut_lineage(rows.where((F.col("dt") == edge) & (F.col("ts_us") >= since)))
    jvm = spark._jvm.org.apache.hadoop.fs
    system = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(jvm.Path(path)):
        name = status.getPath().getName()
        if name.startswith("dt=") and name[3:] < edge:
            system.delete(status.getPath(), True)
            system.delete(jvm.Path(f"{_filters(path)}/{name}"), True)
    partial.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)
    if partial.isEmpty():
        system.delete(jvm.Path(f"{path}/dt={edge}"), True)


def append_embeddings(vectors: DataFrame, path: str) -> None:
    """``alert_id``, ``embedding`` and a ``metadata`` map."""
    vectors.select("alert_id", F.col("embedding").cast("array<float>").alias("embedding"), "metadata").write.mode(
        "append"
    ).parquet(path)


def append_audit(events: DataFrame, path: str) -> None:
    """Audit rows get a new id; a missing address is ``unknown``."""
    events.select(
        F.uuid().alias("id"), "ts_us", "event", F.coalesce("ip", F.lit("unknown")).alias("ip"), "success",
        F.coalesce("detail", F.lit("")).alias("detail"),
    ).write.mode("append").parquet(path)


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object per row, as ``value``."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    json_lines(rows).write.mode("append").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def save_stats(stats: DataFrame, path: str) -> None:
    """Scaler or baseline statistics: one row per feature."""
    stats.write.mode("overwrite").parquet(path)


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_forest(model, spark: SparkSession, path: str) -> None:
    """Isolation forest nodes, with the sample size and offset on every row."""
    nodes = spark.createDataFrame(model.nodes).withColumns({"sample": F.lit(model.sample), "offset": F.lit(model.offset)})
    nodes.write.mode("overwrite").parquet(path)


def load_forest(spark: SparkSession, path: str):
    from flowsift.operators.forest import IsolationForest

    nodes = spark.read.parquet(path).toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
    return IsolationForest(nodes.drop(columns=["sample", "offset"]), int(nodes["sample"][0]), float(nodes["offset"][0]))


# --- event records -------------------------------------------------------------------


def packet_events(packets: DataFrame, score: str = "flow_score", flagged: str = "flagged") -> DataFrame:
    return packets.select(
        F.lit("packet_event").alias("type"), (F.col("ts_us") / 1e6).alias("ts"), F.col("src_ip").alias("src"),
        F.col("dst_ip").alias("dst"), F.col("protocol").alias("proto"), "length", "flags",
        F.round(score, 3).alias("flow_score"), F.col(flagged).alias("flagged"),
    )


def alert_events(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        F.lit("alert_event").alias("type"), F.col("alert_id").alias("id"), "rule",
        F.coalesce("severity", severity(F.col("confidence"))).alias("severity"), F.round("confidence", 3).alias("confidence"),
        "src_ip", "dst_ip", F.col("dst_port").alias("port"), "detectors",
        F.transform_values(F.from_json("shap_explanation", "map<string,double>"), lambda _, v: F.round(v, 3)).alias("shap"),
        F.floor(F.col("ts_us") / 1e6).alias("ts"),
    )


def stats_updates(ticks: DataFrame) -> DataFrame:
    return ticks.select(
        F.lit("stats_update").alias("type"), F.col("packets").alias("pps"), "flows",
        F.round("ensemble_conf", 3).alias("ensemble_conf"), "active_alerts",
    )


def flow_updates(flows: DataFrame, columns: Sequence[str] = ("src_ip", "dst_ip", "proto", "score", "severity")) -> DataFrame:
    return flows.select(F.lit("flow_update").alias("type"), F.struct(*columns).alias("flow"))
