"""Capture files of any size, read in byte ranges by many tasks.

A file is cut into ranges.  A record belongs to the range where its header
starts.  A task that begins inside a file does not know where a record starts,
so it looks for the first place from which a chain of plausible headers follows,
reading on beyond its end where needed.  Ranges are first walked header by
header; each says where its first record is and where the walk left it.  The
walk from the start of a file is exact, and a range whose first record is where
the range before it ended is exact by induction; the others are walked again
from there until all agree.  Only then are frames decoded, range by range, with
record numbers from the counts of the earlier ranges.  What a file says at its
start or on the way (byte order, interfaces) travels as a few rows per file.

Both capture formats are read: packet records after one file header, and blocks
with sections and interfaces.  Bytes come through ``pyarrow.fs``, so paths are
URIs of a store that it knows, or local paths.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowsift.schemas import DECODED
from flowsift.session import cut_lineage
from flowsift.sources.pcap import _ETHERNET, _MAGIC, _RAW_IP, decode_frame

#: Bytes in a range, and records that must follow each other to believe a place inside a file.
RANGE_BYTES = 64 << 20
CHAIN = 6
#: No captured frame is longer.
MOST_FRAME = 1 << 18
#: Rows that leave a task at once, and tasks at most (more ranges share them).
BATCH = 5000
MOST_TASKS = 100_000

# Fixed values of the block format.
_SECTION, _INTERFACE, _SIMPLE, _ENHANCED = 0x0A0D0D0A, 1, 3, 6
_BLOCK_TYPES = {_SECTION, _INTERFACE, 2, _SIMPLE, 4, 5, _ENHANCED, 7, 8, 9, 10, 0x0BAD, 0x40000BAD}
_BYTE_ORDER = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}


class Pieces:
    """Bytes of a file by absolute offset, fetched piece by piece and forgotten behind."""

    def __init__(self, file, size: int, piece: int = 1 << 20):
        self.file, self.size, self.piece, self.at, self.held = file, size, piece, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes; fewer at the end of the file."""
        n = max(0, min(n, self.size - at))
        if at < self.at or at > self.at + len(self.held):
            self.at, self.held = at, b""
        if at + n > self.at + len(self.held):
            self.held = self.held[at - self.at:]
            self.at = at
            self.file.seek(self.at + len(self.held))
            more = max(n - len(self.held), min(self.piece, self.size - self.at - len(self.held)))
            self.held += self.file.read(more)
        return self.held[at - self.at:at - self.at + n]


@dataclass(frozen=True)
class Format:
    """What is needed to read records: ``interfaces`` holds (link type, units per microsecond as a fraction's parts) by number."""

    blocks: bool
    order: str
    interfaces: tuple[tuple[int, int, int], ...]


def open_file(path: str):
    if "://" not in path:
        return pafs.LocalFileSystem().open_input_file(path.removeprefix("file:"))
    system, inner = pafs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def file_format(data: Pieces) -> tuple[Format, int]:
    """The format at the start of a file and the offset of its first record or block."""
    start = data.get(0, 28)
    if start[:4] in _MAGIC and len(start) >= 24:
        order, per_us = _MAGIC[start[:4]]
        return Format(False, order, ((struct.unpack_from(order + "I", start, 20)[0] & 0xFFFF, per_us, 1),)), 24
    if len(start) >= 12 and struct.unpack_from("<I", start)[0] == _SECTION and start[8:12] in _BYTE_ORDER:
        return Format(True, _BYTE_ORDER[start[8:12]], ()), 0
    raise ValueError("not a packet capture file")


def _resolution(options: bytes, order: str) -> tuple[int, int]:
    """Timestamp units per microsecond as numerator and denominator; microseconds if no option says otherwise."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 0:
            break
        if code == 9 and size >= 1:
            exponent = options[at + 4]
            units = 2 ** (exponent & 0x7F) if exponent & 0x80 else 10 ** exponent
            return units, 1_000_000
        at += 4 + size + -size % 4
    return 1, 1


def after(form: Format, head: bytes, body: Callable[[], bytes]) -> Format:
    """The format after a block that changes it."""
    kind = struct.unpack_from(form.order + "I", head)[0]
    if kind == _SECTION:
        return Format(True, _BYTE_ORDER[head[8:12]], ())
    if kind == _INTERFACE:
        whole = body()
        link = struct.unpack_from(form.order + "H", whole, 8)[0]
        units, per = _resolution(whole[16:-4], form.order)
        return replace(form, interfaces=(*form.interfaces, (link, units, per)))
    return form


def _record_at(data: Pieces, at: int, form: Format, doubt: bool = False) -> tuple[int, bytes] | None:
    """Size of the record or block at an offset, with its head, if it is whole, and with ``doubt`` if it is also plausible."""
    if not form.blocks:
        head = data.get(at, 16)
        if len(head) < 16:
            return None
        _, fraction, kept, length = struct.unpack(form.order + "IIII", head)
        odd = kept > MOST_FRAME or kept > length or fraction >= 1_000_000 * form.interfaces[0][1]
        return None if at + 16 + kept > data.size or (doubt and odd) else (16 + kept, head)
    head = data.get(at, 12)
    if len(head) < 12:
        return None
    kind, order = struct.unpack_from(form.order + "I", head)[0], form.order
    if kind == _SECTION:
        if head[8:12] not in _BYTE_ORDER:
            return None
        order = _BYTE_ORDER[head[8:12]]
    size = struct.unpack_from(order + "I", head, 4)[0]
    if size < 12 or size % 4 or at + size > data.size:
        return None
    if doubt and (kind not in _BLOCK_TYPES or struct.unpack(order + "I", data.get(at + size - 4, 4))[0] != size):
        return None
    return size, head


def first_record(data: Pieces, start: int, form: Format, chain: int = CHAIN) -> int:
    """The first offset from ``start`` on where ``chain`` records (or all up to the end of the file) follow each other."""
    step = 4 if form.blocks else 1  # blocks are aligned
    for at in range(start + -start % step, data.size, step):
        here, seen = at, 0
        while seen < chain and here < data.size:
            found = _record_at(data, here, form, doubt=True)
            if found is None:
                break
            here, seen = here + found[0], seen + 1
        if seen == chain or (seen and here == data.size):
            return at
    return data.size


def walk(data: Pieces, at: int, end: int, form: Format) -> Iterator[tuple[int, int, bytes, Format]]:
    """Offset, size, head and format of every record that starts before ``end``; stops at a record that is not whole."""
    while at < end:
        found = _record_at(data, at, form)
        if found is None:
            return
        size, head = found
        if form.blocks:
            form = after(form, head, lambda at=at, size=size: data.get(at, size))
        yield at, size, head, form
        at += size


def _is_packet(head: bytes, form: Format) -> bool:
    return not form.blocks or struct.unpack_from(form.order + "I", head)[0] in (_ENHANCED, _SIMPLE)


def packet(data: Pieces, at: int, size: int, head: bytes, form: Format) -> dict:
    """Time, length and layers of the packet record at an offset."""
    raw = data.get(at, size)
    if not form.blocks:
        seconds, fraction, kept, length = struct.unpack(form.order + "IIII", head)
        link, per_us, _ = form.interfaces[0]
        ts_us, frame = seconds * 1_000_000 + fraction // per_us, raw[16:16 + kept]
    elif struct.unpack_from(form.order + "I", head)[0] == _ENHANCED:
        number, high, low, kept, length = struct.unpack_from(form.order + "IIIII", raw, 8)
        link, units, per = form.interfaces[number]
        ts_us, frame = (high << 32 | low) * per // units, raw[28:28 + kept]
    else:  # a simple packet has no time
        length = struct.unpack_from(form.order + "I", raw, 8)[0]
        link, ts_us, frame = form.interfaces[0][0], 0, raw[12:12 + min(length, size - 16)]
    if link not in (_ETHERNET, _RAW_IP):
        raise ValueError(f"unsupported link type {link}")
    return {"ts_us": ts_us, "length": length, **decode_frame(frame, link)}


_CHANGES = "array<struct<at: long, body: binary>>"
_WALKED = f"path string, size long, start long, stop long, first long, left_at long, packets long, changes {_CHANGES}"


def _entered(data: Pieces, first: int, known: list[dict] | None) -> Format:
    """The format at an offset, by the start of the file and the blocks before the offset that change it."""
    form, _ = file_format(data)
    for change in sorted(known or [], key=lambda c: c["at"]):
        if change["at"] < first:
            form = after(form, change["body"][:12], lambda change=change: change["body"])
    return form


def _walked(ranges: DataFrame) -> DataFrame:
    """Walk every range from ``first`` (searched for where it is null): where it left off, its packets, and the blocks that change the format."""
    schema = T._parse_datatype_string(_WALKED)
    to_arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                with open_file(r["path"]) as file:
                    data, first = Pieces(file, r["size"]), r["first"]
                    if first is None:
                        form, begin = file_format(data)
                        first = begin if r["start"] == 0 else first_record(data, r["start"], form)
                    form, at, packets, changes = _entered(data, first, r["known"]), first, 0, []
                    for here, size, head, form in walk(data, first, r["stop"], form):
                        if form.blocks and struct.unpack_from(form.order + "I", head)[0] in (_SECTION, _INTERFACE):
                            changes.append({"at": here, "body": data.get(here, size)})
                        at, packets = here + size, packets + _is_packet(head, form)
                # a record that is not whole ends the file
                left = at if at >= r["stop"] else r["size"]
                out.append({k: r[k] for k in ("path", "size", "start", "stop")} | {"first": first, "left_at": left, "packets": packets, "changes": changes})
            yield pa.RecordBatch.from_pylist(out, schema=to_arrow)

    return cut_lineage(ranges.select("path", "size", "start", "stop", "first", "known").mapInArrow(run, schema))


def _known(walked: DataFrame) -> DataFrame:
    """``path, known``: the blocks of each file that change the format, a few per file."""
    found = walked.select("path", F.explode("changes").alias("c"))
    return found.groupBy(F.col("path").alias("_path")).agg(F.collect_list("c").alias("known"))


def capture_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, size, start, stop, first, left_at, packets, changes`` of every range of the files below ``path``, all of them exact."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).where("size > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.select("path", "size", F.explode(starts).alias("start")).withColumn("stop", F.least(F.col("start") + range_bytes, F.col("size")))
    ranges = cut_lineage(ranges)
    n = min(max(1, ranges.count()), MOST_TASKS)
    blank = ranges.withColumns({"first": F.lit(None).cast("long"), "known": F.lit(None).cast(_CHANGES)})
    walked = _walked(blank.repartition(n, "path", "start"))
    in_file = Window.partitionBy("path").orderBy("start")  # a row per range
    while True:
        due = walked.withColumn("due", F.lag("left_at").over(in_file)).withColumn("wrong", F.col("due") != F.col("first"))
        wrong = due.where("wrong").groupBy(F.col("path").alias("_p")).agg(F.min("start").alias("_s"))
        again = cut_lineage(due.join(wrong, (F.col("path") == F.col("_p")) & (F.col("start") == F.col("_s"))).join(
            _known(walked), F.col("path") == F.col("_path"), "left").select("path", "size", "start", "stop", F.col("due").alias("first"), "known"))
        if again.isEmpty():
            return walked
        walked = cut_lineage(walked.join(again.select("path", "start"), ["path", "start"], "left_anti").unionByName(_walked(again)))


def read_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path`` and decoded layers of every packet; ``record`` numbers the packets of a file."""
    walked = capture_ranges(spark, path, range_bytes)
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counted = walked.withColumn("before", F.coalesce(F.sum("packets").over(earlier), F.lit(0))).where("packets > 0")
    ranges = cut_lineage(counted.join(_known(walked), F.col("path") == F.col("_path"), "left").select("path", "size", "stop", "first", "before", "known"))
    schema = T.StructType([T.StructField("path", T.StringType()), *DECODED.fields])
    to_arrow = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open_file(r["path"]) as file:
                    data, rows, record = Pieces(file, r["size"]), [], r["before"]
                    for here, size, head, form in walk(data, r["first"], r["stop"], _entered(data, r["first"], r["known"])):
                        if _is_packet(head, form):
                            rows.append({"path": r["path"], "record": record, **packet(data, here, size, head, form)})
                            record += 1
                        if len(rows) == BATCH:
                            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=to_arrow)

    n = min(max(1, ranges.count()), MOST_TASKS)
    return ranges.repartition(n, "path", "first").mapInArrow(decode, schema)
