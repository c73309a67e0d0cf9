"""Frames of packet captures, and packets of capture files."""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.functions.packets import normalise_layers
from flowsift.operators.ordering import dense_seq
from flowsift.schemas import DECODED

# Magic number -> (byte order, time units per microsecond).
_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000),
}
_ETHERNET, _RAW_IP = 1, 101
_IPV4, _VLAN, _DNS_PORT = 0x0800, 0x8100, 53
_BATCH = 5000


def _mac(raw: bytes) -> str:
    return ":".join(f"{b:02x}" for b in raw)


def _name(data: bytes, at: int) -> tuple[str, int]:
    """A possibly compressed DNS name and the offset after it."""
    labels, end, hops = [], None, 0
    while at < len(data) and hops < 64:
        size = data[at]
        if size & 0xC0 == 0xC0:
            end = end or at + 2
            at = struct.unpack_from(">H", data, at)[0] & 0x3FFF
            hops += 1
        elif size == 0:
            at += 1
            break
        else:
            labels.append(data[at + 1:at + 1 + size].decode("latin-1"))
            at += 1 + size
    return ".".join(labels), end or at


def decode_dns(data: bytes) -> dict | None:
    try:
        _, flags, questions, answers = struct.unpack_from(">HHHH", data)
        at, qname, qtype, found = 12, "", 0, []
        for i in range(questions):
            name, at = _name(data, at)
            if i == 0:
                qname, qtype = name, struct.unpack_from(">H", data, at)[0]
            at += 4
        response = bool(flags & 0x8000)
        for _ in range(answers if response else 0):
            _, at = _name(data, at)
            kind, _, _, size = struct.unpack_from(">HHIH", data, at)
            at += 10
            value = data[at:at + size]
            if kind in (1, 28) and size in (4, 16):
                found.append(str(ipaddress.ip_address(value)))
            elif kind in (2, 5, 12):
                found.append(_name(data, at)[0])
            else:
                found.append(value.decode("utf-8", errors="replace"))
            at += size
        return {"qname": qname, "qtype": qtype, "is_response": response, "answers": found}
    except (struct.error, ValueError):
        return None


def decode_frame(frame: bytes, link: int = _ETHERNET) -> dict:
    """Layers of one frame; absent or truncated layers are None."""
    out: dict = dict.fromkeys(("eth", "ip", "tcp", "udp", "dns"))
    out["payload"] = b""
    at = 0
    try:
        kind = _IPV4
        if link == _ETHERNET:
            kind, at = struct.unpack_from(">H", frame, 12)[0], 14
            if kind == _VLAN:
                kind, at = struct.unpack_from(">H", frame, 16)[0], 18
            out["eth"] = {"dst": _mac(frame[:6]), "src": _mac(frame[6:12]), "ethertype": kind}
        if kind != _IPV4:
            return out
        head, _, length, _, place, ttl, proto, _, src, dst = struct.unpack_from(">BBHHHBBH4s4s", frame, at)
        if head >> 4 != 4:
            return out
        out["ip"] = {
            "src": str(ipaddress.IPv4Address(src)), "dst": str(ipaddress.IPv4Address(dst)),
            "proto": proto, "ttl": ttl, "length": length,
        }
        end = min(len(frame), at + length) if length else len(frame)
        at += (head & 15) * 4
        if place & 0x1FFF:  # a later fragment: what follows is no transport header
            out["payload"] = frame[at:end]
        elif proto == 6:
            sport, dport, seq, ack, offset, flags, window = struct.unpack_from(">HHIIBBH", frame, at)
            out["tcp"] = {"sport": sport, "dport": dport, "seq": seq, "ack": ack, "window": window, "flags": flags}
            out["payload"] = frame[at + (offset >> 4) * 4:end]
        elif proto == 17:
            sport, dport, size = struct.unpack_from(">HHH", frame, at)
            out["udp"] = {"sport": sport, "dport": dport, "length": size}
            out["payload"] = frame[at + 8:end]
            if _DNS_PORT in (sport, dport):
                out["dns"] = decode_dns(out["payload"])
    except struct.error:
        pass
    return out


def decode_records(content: bytes) -> Iterator[dict]:
    """Packets of one capture; a truncated last record is dropped."""
    if content[:4] not in _MAGIC:
        raise ValueError("not a packet capture file")
    order, per_us = _MAGIC[content[:4]]
    link = struct.unpack_from(order + "I", content, 20)[0]
    if link not in (_ETHERNET, _RAW_IP):
        raise ValueError(f"unsupported link type {link}")
    at, record = 24, 0
    while at + 16 <= len(content):
        seconds, fraction, kept, length = struct.unpack_from(order + "IIII", content, at)
        if at + 16 + kept > len(content):
            return
        layers = decode_frame(content[at + 16:at + 16 + kept], link)
        yield {"record": record, "ts_us": seconds * 1_000_000 + fraction // per_us, "length": length, **layers}
        at += 16 + kept
        record += 1


def read_captures(spark: SparkSession, path: str, range_bytes: int | None = 64 << 20) -> DataFrame:
    """Decoded layers of every packet below ``path``, files in ranges of ``range_bytes`` (:mod:`flowsift.sources.ranges`).

    With None each file is one task, read by Spark's own reader: for stores that
    only Spark opens and files of the older format below 2 GB.
    """
    if range_bytes is not None:
        from flowsift.sources.ranges import read_ranges

        return read_ranges(spark, path, range_bytes)
    schema = T.StructType([T.StructField("path", T.StringType()), *DECODED.fields])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows: list[dict] = []
                for row in decode_records(bytes(content)):
                    rows.append({"path": name, **row})
                    if len(rows) == _BATCH:
                        yield pd.DataFrame(rows, columns=schema.names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=schema.names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, schema)


def capture_packets(spark: SparkSession, path: str) -> DataFrame:
    """IP packets as flow input; ids follow (file name, record)."""
    listing = spark.read.format("binaryFile").load(path).select("path")
    numbered = dense_seq(listing, ["path"], "_file", partitions=1 if listing.count() < 100_000 else None)
    decoded = read_captures(spark, path).join(numbered, "path")
    ids = F.shiftleft(F.col("_file"), 40) + F.col("record")
    return normalise_layers(decoded.withColumn("packet_id", ids))
