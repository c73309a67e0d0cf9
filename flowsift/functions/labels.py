"""Labels, encodings and the mapping of public flow datasets to the feature vector."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.functions.vectors import FEATURES, finite

# Attack families (0 normal, 1 DoS, 2 probe, 3 R2L, 4 U2R); unknown names are 1.
FAMILIES = {
    "normal": 0,
    "back": 1, "land": 1, "neptune": 1, "pod": 1, "smurf": 1, "teardrop": 1, "apache2": 1, "udpstorm": 1,
    "processtable": 1, "mailbomb": 1,
    "ipsweep": 2, "nmap": 2, "portsweep": 2, "satan": 2, "mscan": 2, "saint": 2,
    "ftp_write": 3, "guess_passwd": 3, "imap": 3, "multihop": 3, "phf": 3, "spy": 3, "warezclient": 3,
    "warezmaster": 3, "sendmail": 3, "named": 3, "snmpgetattack": 3, "snmpguess": 3, "xlock": 3, "xsnoop": 3,
    "httptunnel": 3,
    "buffer_overflow": 4, "loadmodule": 4, "perl": 4, "rootkit": 4, "ps": 4, "sqlattack": 4, "xterm": 4,
}
UNKNOWN_FAMILY = 1

# Source columns of the 78-column flow CSVs, per feature (lower-cased).
CSV_COLUMNS = {
    "duration": "flow duration",
    "src_bytes": "total length of fwd packets",
    "dst_bytes": "total length of bwd packets",
    "flag_syn": "syn flag count",
    "flag_ack": "ack flag count",
    "flag_fin": "fin flag count",
    "flag_rst": "rst flag count",
    "flag_psh": "psh flag count",
    "avg_packet_size": "average packet size",
    "bytes_per_second": "flow bytes/s",
    "packets_per_second": "flow packets/s",
    "count": "fwd header length",
    "srv_count": "bwd header length",
    "dst_host_count": "fwd iat mean",
    "dst_host_srv_count": "bwd iat mean",
    "dst_port": "destination port",
}


def binary_label(label: Column, normal: str) -> Column:
    return (F.lower(F.trim(label)) != normal).cast("int")


def mapped_label(label: Column, classes: Mapping[str, int], unknown: int) -> Column:
    table = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, label), F.lit(unknown))


def attack_family(label: Column) -> Column:
    return mapped_label(label, FAMILIES, UNKNOWN_FAMILY)


def hashed(value: Column, buckets: int = 1000) -> Column:
    """Categorical code that is the same in every run and engine: first 32 bits of the MD5 digest, modulo ``buckets``."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("long") % buckets


def number_or_zero(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def csv_features(df: DataFrame) -> DataFrame:
    """The 23 features and binary ``y`` from a flow CSV; absent columns are 0."""
    by_name = {c.strip().lower(): c for c in df.columns}
    if "label" not in by_name:
        raise ValueError("no label column")

    def number(name: str) -> Column:
        if name not in by_name:
            return F.lit(0.0)
        return finite(F.col(f"`{by_name[name]}`").try_cast("double"))

    packets = F.greatest(number("total fwd packets") + number("total backward packets"), F.lit(1.0))
    values = {f: number(source) for f, source in CSV_COLUMNS.items()}
    values |= {
        "packet_count": packets,
        "serror_rate": F.least(F.greatest(values["flag_syn"] / packets, F.lit(0.0)), F.lit(1.0)),
        "rerror_rate": F.least(F.greatest(values["flag_rst"] / packets, F.lit(0.0)), F.lit(1.0)),
    }
    columns = [values.get(f, F.lit(0.0)).cast("float").alias(f) for f in FEATURES]
    return df.select(*columns, binary_label(F.col(f"`{by_name['label']}`"), "benign").alias("y"))


def deterministic_sample(df: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows, the same ones for the same seed."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string"))), row_id).limit(n)
