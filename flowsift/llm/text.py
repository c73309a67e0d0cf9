"""Column helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.session import cut_lineage

#: White space that separates words.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, even where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column, separator: str = SPACE) -> Column:
    """Array of the runs between separators; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each prolonged by underscores until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


#: Rows up to which a table of short rows is sent to every task.
SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` to be broadcast if it has at most ``rows`` rows, else as it is for a shuffled join.

    ``df`` should be written out already: its rows are counted here.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows up to which a table of short rows is kept in one partition.
FEW_ROWS = 50_000


def few(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """``df`` written out, in one partition if it has at most ``rows`` rows: steps on it then need no shuffles and no empty tasks."""
    df = cut_lineage(df)
    return cut_lineage(df.coalesce(1)).coalesce(1) if df.limit(rows + 1).count() <= rows else df
