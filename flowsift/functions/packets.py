"""Packet-level columns: canonical keys, direction, protocol codes, TCP flags."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# TCP flag bits and the protocol encoding (anything else is 3).
TCP_FLAGS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16}
PROTOCOL_CODES = {6: 0, 17: 1, 1: 2}
OTHER_PROTOCOL = 3

FLOW_KEY = ["a_ip", "a_port", "b_ip", "b_port", "protocol"]


def _source_first() -> Column:
    same_ip = F.col("src_ip") == F.col("dst_ip")
    return (F.col("src_ip") < F.col("dst_ip")) | (same_ip & (F.col("src_port") <= F.col("dst_port")))


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Both directions of a conversation get one key, the smaller (ip, port) first."""
    forward = _source_first()
    return packets.withColumns({
        "a_ip": F.when(forward, F.col("src_ip")).otherwise(F.col("dst_ip")),
        "a_port": F.when(forward, F.col("src_port")).otherwise(F.col("dst_port")),
        "b_ip": F.when(forward, F.col("dst_ip")).otherwise(F.col("src_ip")),
        "b_port": F.when(forward, F.col("dst_port")).otherwise(F.col("src_port")),
        "from_a": forward,
    })


def host_pair(src: str = "src_ip", dst: str = "dst_ip", protocol: str = "protocol") -> Column:
    return F.concat_ws("-", F.least(src, dst), F.greatest(src, dst), F.col(protocol).cast("string"))


def protocol_code(protocol: str = "protocol") -> Column:
    code = F.lit(OTHER_PROTOCOL)
    for number, value in PROTOCOL_CODES.items():
        code = F.when(F.col(protocol) == number, value).otherwise(code)
    return code


def has_flag(name: str, flags: str = "flags") -> Column:
    return F.col(flags).bitwiseAND(F.lit(TCP_FLAGS[name])) != 0


def normalise_layers(decoded: DataFrame) -> DataFrame:
    """Decoded layers to packet rows: only IP, ports for TCP/UDP, flags for TCP."""
    return decoded.where(F.col("ip").isNotNull()).select(
        "packet_id", "ts_us",
        F.col("ip.src").alias("src_ip"), F.col("ip.dst").alias("dst_ip"),
        F.coalesce("tcp.sport", "udp.sport", F.lit(0)).alias("src_port"),
        F.coalesce("tcp.dport", "udp.dport", F.lit(0)).alias("dst_port"),
        F.col("ip.proto").alias("protocol"), "length",
        F.coalesce("tcp.flags", F.lit(0)).alias("flags"),
        F.coalesce("payload", F.lit(b"")).alias("payload"),
    )


def address_number(ip: str) -> Column:
    """IPv4 address as a number; null for anything else."""
    octets = F.split(F.col(ip), r"\.")
    values = [F.get(octets, F.lit(i)).try_cast("long") for i in range(4)]
    number = sum((v * (1 << 8 * (3 - i)) for i, v in enumerate(values)), F.lit(0))
    valid = F.col(ip).rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    for v in values:
        valid &= v <= 255
    return F.when(valid, number)


def packet_filter(
    packets: DataFrame,
    *,
    protocol: int | None = None,
    port: int | None = None,
    host: str | None = None,
    net: str | None = None,
) -> DataFrame:
    """Keep packets that satisfy every given predicate, in either direction.

    ``net`` is an IPv4 range, such as ``"10.0.0.0/24"``; a single address is a
    range of one.  Addresses that are not IPv4 are in no range.
    """
    keep = F.lit(True)
    if protocol is not None:
        keep &= F.col("protocol") == protocol
    if port is not None:
        keep &= (F.col("src_port") == port) | (F.col("dst_port") == port)
    if host is not None:
        keep &= (F.col("src_ip") == host) | (F.col("dst_ip") == host)
    if net is not None:
        span = ipaddress.ip_network(net, strict=False)
        first, last = int(span.network_address), int(span.broadcast_address)
        keep &= address_number("src_ip").between(first, last) | address_number("dst_ip").between(first, last)
    return packets.where(keep)


def port_violations(packets: DataFrame, allowed: Iterable[int]) -> DataFrame:
    return packets.where(~F.col("dst_port").isin(list(allowed)))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, so byte offsets survive."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def risk_band(flagged: Column, score: Column) -> Column:
    return F.when(flagged, "flagged").when(score >= 0.5, "suspicious").otherwise("normal")
