"""Labelled flow datasets as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.functions import labels as L
from flowsift.functions.vectors import finite

# The 41-column text layout; which columns are categorical, and the 23 used.
TEXT_COLUMNS = 41
CATEGORICAL = {1, 2, 3}
USED_COLUMNS = [0, 1, 4, 5, 22, 23, 24, 25, 26, 27, 32, 33, 34, 35, 36, 37, 38, 39, 40, 2, 3, 6, 7]
USED_NAMES = [
    "duration", "protocol_type", "src_bytes", "dst_bytes", "count", "srv_count", "same_srv_rate", "serror_rate",
    "diff_srv_rate", "rerror_rate", "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate",
    "dst_host_diff_srv_rate", "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "service", "flag", "land", "wrong_fragment",
]


def read_labelled_text(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated lines of 41 features, label, difficulty; short lines are skipped."""
    names = [f"c{i}" for i in range(TEXT_COLUMNS)] + ["label", "difficulty"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).csv(path, header=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.where(F.col("label").isNotNull()).withColumn("label", F.regexp_replace(F.trim("label"), r"\.+$", ""))


def labelled_text_features(rows: DataFrame) -> DataFrame:
    """The 23 features in their fixed order, binary ``y`` and attack family ``y_multi``."""

    def value(i: int):
        raw = F.col(f"c{i}")
        return L.hashed(raw).cast("double") if i in CATEGORICAL else L.number_or_zero(raw)

    features = [value(i).cast("float").alias(n) for i, n in zip(USED_COLUMNS, USED_NAMES)]
    return rows.select(
        *features, (F.col("label") != "normal").cast("int").alias("y"), L.attack_family(F.col("label")).alias("y_multi")
    )


def read_flow_csvs(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files of a directory; files with equal headers are read together."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path")
    by_header: dict[tuple, list[str]] = {}
    for row in listing.orderBy("path").collect():  # one short row per file
        header = tuple(spark.read.csv(row["path"], header=True).columns)
        by_header.setdefault(header, []).append(row["path"])
    if not by_header:
        raise FileNotFoundError(f"no CSV files in {path}")
    parts = [
        spark.read.csv(files, header=True).toDF(*[c.strip().lower() for c in header])
        for header, files in by_header.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def clean_flow_csvs(df: DataFrame) -> DataFrame:
    """Exact duplicates removed, then numbers with NaN, infinities and gaps as 0.

    A column is numeric if every value that is not empty reads as a number;
    addresses, times and other text stay as they are.
    """
    distinct = df.dropDuplicates()
    others = [c for c in df.columns if c != "label"]
    seen = distinct.agg(*[F.count_if((F.trim(f"`{c}`") != "") & F.col(f"`{c}`").try_cast("double").isNull()).alias(c) for c in others])
    found = seen.first().asDict() if others else {}
    numeric = {c: finite(F.col(f"`{c}`").try_cast("double")) for c in others if not found[c]}
    return distinct.withColumns(numeric).fillna({"label": "0"})


def read_demo_alerts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of alerts."""
    return spark.read.option("multiLine", True).json(path)
