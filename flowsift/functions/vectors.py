"""Feature vectors and vector algebra as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 23 features in vector order.
FEATURES = [
    "duration", "protocol_type", "src_bytes", "dst_bytes",
    "flag_syn", "flag_ack", "flag_fin", "flag_rst", "flag_psh",
    "packet_count", "avg_packet_size", "bytes_per_second", "packets_per_second",
    "count", "srv_count", "dst_host_count", "dst_host_srv_count",
    "serror_rate", "rerror_rate", "same_srv_rate", "diff_srv_rate",
    "src_port", "dst_port",
]


def finite(value: Column) -> Column:
    """NaN, infinities and null become 0."""
    x = value.cast("double")
    usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)
    return F.when(usable, x).otherwise(0.0)


def assemble(columns: Sequence[str] = FEATURES) -> Column:
    return F.array(*[F.col(c).cast("float") for c in columns])


def clip01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def dot(vector: Column, other: Sequence[float]) -> Column:
    """Dot product with a constant vector, unrolled so it is compiled."""
    return reduce(lambda a, b: a + b, [F.get(vector, i).cast("double") * float(v) for i, v in enumerate(other)])


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(vector: Column) -> Column:
    """Unit length; the zero vector stays as it is."""
    size = norm(vector)
    return F.when(size > 0, F.transform(vector, lambda x: x.cast("double") / size)).otherwise(
        F.transform(vector, lambda x: x.cast("double"))
    )


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - distance)


def scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Standard scaling with fitted ``{column: (mean, std)}``; std 0 divides by 1."""
    scaled = {c: (finite(F.col(c)) - mean) / (std if std > 0 else 1.0) for c, (mean, std) in stats.items()}
    return df.withColumns(scaled)
