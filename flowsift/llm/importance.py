"""Documents drawn by importance weights towards a target distribution.

Features are hashed runs of one to three words.  The gain of a bucket is the
log ratio of its smoothed shares in the target and in the documents; a
document's weight is the sum of its features' gains, and the documents with the
highest weight plus Gumbel noise are drawn, which is sampling without
replacement in proportion to the weights' exponentials.

Segment deduplication.  A newline separates words, so a text is its lines.  A
line's features depend on the line only: lines are brought together by a
128-bit hash, features are counted once for each distinct line and multiplied
by how often it occurs, and later its sum of gains is worked out once and handed
to all documents that hold it.  Runs that cross a line break are few (three at a
break) and are added document by document.

The checksum of a run is put together from those of its words: appending is
linear over the checksum's bits, so whole batches are worked out in numpy.

Nothing that grows with the data is collected or broadcast but lines that make
up over 1/1000 of all lines, of which there are less than 1000 by definition;
they reach the documents by a broadcast, all others by a shuffle, so no key of
that shuffle holds more than a thousandth of the lines.

Null and empty texts and texts without words have no features and weight 0.
Repeated rows are drawn one by one; equal scores are ordered by id, then rows
without an id last.  A null id takes part with the noise of the text ``null``.
An empty table gives an empty result.  An empty target has no features.  Only
the named columns are used, so other columns cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.operators.ordering import dense_seq
from flowsift.session import cut_lineage

BUCKETS = 10_000
LONGEST = 3
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
#: A line with more than 1/HOT of all lines reaches the documents by a broadcast.
HOT = 1000

_LETTERS = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Lower-cases A-Z and makes every separator but the newline a space.
_CLEAN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS or b == 0x0A else 0x20 for b in range(256))


def segments(text: str | None) -> list[list[bytes]]:
    """Words of each line that has any."""
    if not text:
        return []
    return [own for line in text.encode("utf-8", "surrogatepass").translate(_CLEAN).split(b"\n") if (own := line.split())]


@lru_cache(maxsize=None)
def _shifts(power: int) -> np.ndarray:
    """Tables (4 x 256) of what 2^power zero bytes do to a checksum, by the place and value of its bytes."""
    if power == 0:
        zeros = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
        places = np.arange(256, dtype=np.uint32)
        return np.stack([zeros, *(places << np.uint32(8 * (j - 1)) for j in range(1, 4))])
    half = _shifts(power - 1)
    return np.stack([_appended(half, half[j]) for j in range(4)])


def _appended(tables: np.ndarray, sums: np.ndarray) -> np.ndarray:
    out = tables[0][sums & np.uint32(255)]
    for j in range(1, 4):
        out = out ^ tables[j][(sums >> np.uint32(8 * j)) & np.uint32(255)]
    return out


def joined_sums(left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray) -> np.ndarray:
    """Checksums of left + right from the checksums of both and the length of the right side."""
    out = left.copy()
    for power in range(int(right_bytes.max(initial=0)).bit_length()):
        at = np.flatnonzero(right_bytes >> power & 1)
        out[at] = _appended(_shifts(power), out[at])
    return out ^ right


def buckets(words: list[bytes], line: np.ndarray, longest: int = LONGEST, count: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and line of every run of up to ``longest`` words that stays on a line; ``line`` has each word's line."""
    n = len(words)
    own = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=n)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    space = np.full(1, zlib.crc32(b" "), dtype=np.uint32)
    found, at, run = [own], [line], own
    for k in range(1, min(longest, n)):
        # run[i] covers words i .. i + k - 1
        left = run[:n - k]
        left = joined_sums(left, np.broadcast_to(space, left.shape), np.ones(len(left), dtype=np.int64))
        run = joined_sums(left, own[k:], sizes[k:])
        same = line[:n - k] == line[k:]
        found.append(run[same])
        at.append(line[:n - k][same])
    return (np.concatenate(found) % np.uint32(count)).astype(np.int64), np.concatenate(at)


def crossing(lines: list[list[bytes]], longest: int = LONGEST, count: int = BUCKETS) -> list[int]:
    """Buckets of the runs that cross a line break; every run is taken where its first break is."""
    out = []
    for i in range(len(lines) - 1):
        tail, after, j = lines[i][1 - longest:] if longest > 1 else [], [], i + 1
        while len(after) < longest - 1 and j < len(lines):
            after += lines[j][:longest - 1 - len(after)]
            j += 1
        near = tail + after
        for a in range(len(tail)):
            for b in range(len(tail) + 1, min(a + longest, len(near)) + 1):
                out.append(zlib.crc32(b" ".join(near[a:b])) % count)
    return out


def _key(line: bytes) -> tuple[int, int]:
    import xxhash

    both = xxhash.xxh3_128_digest(line)
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


def distinct_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``a, b, line, n``: every distinct line with its number of occurrences; words are joined by one space.

    Rows with a null ``line`` count the runs that cross breaks: bucket ``a``, ``n`` times.
    A batch is summed up before it is shuffled.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines: dict[bytes, int] = {}
            over = np.zeros(BUCKETS, dtype=np.int64)
            for value in batch.column(0):
                own = segments(value.as_py())
                for line in own:
                    whole = b" ".join(line)
                    lines[whole] = lines.get(whole, 0) + 1
                if len(own) > 1:
                    over += np.bincount(crossing(own), minlength=BUCKETS)
            at = np.flatnonzero(over)
            keys = [_key(line) for line in lines]
            yield pa.RecordBatch.from_arrays([
                pa.array([*(k[0] for k in keys), *at.tolist()], pa.int64()), pa.array([*(k[1] for k in keys), *([None] * len(at))], pa.int64()),
                pa.array([*lines, *([None] * len(at))], pa.binary()), pa.array([*lines.values(), *over[at].tolist()], pa.int64()),
            ], names=["a", "b", "line", "n"])

    rows = docs.select(text).mapInArrow(split, "a long, b long, line binary, n long")
    return rows.groupBy("a", "b").agg(F.any_value("line").alias("line"), F.sum("n").alias("n"))


def _portions(lines: list[bytes | None], most: int = 1 << 22) -> Iterator[slice]:
    """Slices of about ``most`` bytes; one line is never cut."""
    begin, held = 0, 0
    for i, line in enumerate(lines):
        held += len(line or b"")
        if held >= most:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(lines):
        yield slice(begin, len(lines))


def _line_words(lines: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    split = [line.split(b" ") for line in lines]
    at = np.repeat(np.arange(len(split)), np.fromiter(map(len, split), dtype=np.int64, count=len(split)))
    return [w for own in split for w in own], at


def bucket_counts(lines: DataFrame) -> np.ndarray:
    """Occurrences of every bucket: the features of each distinct line once, times its occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            whole = batch.column("line").is_valid().to_numpy(zero_copy_only=False)
            np.add.at(total, batch.column("a").to_numpy(zero_copy_only=False)[~whole], n[~whole])
            own, times = [x for x in batch.column("line").to_pylist() if x is not None], n[whole]
            for part in _portions(own):
                found, at = buckets(*_line_words(own[part]))
                order = np.argsort(found, kind="stable")
                edge = np.flatnonzero(np.diff(found[order], prepend=-1))
                total[found[order][edge]] += np.add.reduceat(times[part][at[order]], edge)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = lines.select("a", "line", "n").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for row in rows.collect():  # one row for each bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    s, t = int(counts.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((int(y) + 1) * (s + BUCKETS)) / float((int(x) + 1) * (t + BUCKETS))))
                     for x, y in zip(counts, target)], dtype=np.int64)


def line_weights(lines: DataFrame, gain: np.ndarray) -> DataFrame:
    """``a, b, n, gain``: the sum of gains of every distinct line."""
    sent = lines.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("line").to_pylist()
            total = np.zeros(len(own), dtype=np.int64)
            for part in _portions(own):
                found, at = buckets(*_line_words(own[part]))
                np.add.at(total[part], at, sent.value[found])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("n"), pa.array(total)], names=["a", "b", "n", "gain"])

    return lines.where("line is not null").mapInArrow(weigh, "a long, b long, n long, gain long")


def documents_by_line(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, doc_id, n_words, crossing, lines``: every row with its distinct lines (``a, b, times``) and the gains across its breaks."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select(F.monotonically_increasing_id().alias("row"), "*")
    line = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("times", pa.int64())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, over, held = [], [], []
            for value in batch.column("text"):
                own = segments(value.as_py())
                times: dict[bytes, int] = {}
                for words in own:
                    whole = b" ".join(words)
                    times[whole] = times.get(whole, 0) + 1
                n_words.append(sum(map(len, own)))
                over.append(int(sent.value[crossing(own)].sum()) if len(own) > 1 else 0)
                held.append([dict(zip(("a", "b", "times"), (*_key(x), n))) for x, n in times.items()])
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(over, pa.int64()), pa.array(held, pa.list_(line))
            ], names=["row", "doc_id", "n_words", "crossing", "lines"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(split, f"row long, doc_id {kind}, n_words long, crossing long, lines array<struct<a: long, b: long, times: long>>")


def weighed(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``row, doc_id, n_words, weight`` for every row of ``docs``."""
    lines = cut_lineage(distinct_lines(docs, text))
    gain = gains(bucket_counts(lines), bucket_counts(distinct_lines(target, target_text)))
    weights = cut_lineage(line_weights(lines, gain))
    held = cut_lineage(documents_by_line(docs, gain, doc_id, text))
    pairs = held.select("row", F.explode("lines").alias("l")).select("row", "l.a", "l.b", "l.times")
    total = weights.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT > total  # fewer than HOT lines can be
    hot = F.broadcast(weights.where(often).select("a", "b", F.col("gain").alias("hot_gain")))
    rest = weights.where(~often).select("a", "b", "gain")
    found = pairs.join(hot, ["a", "b"], "left")
    sums = found.where("hot_gain is not null").select("row", (F.col("hot_gain") * F.col("times")).alias("w")).unionByName(
        found.where("hot_gain is null").join(rest, ["a", "b"]).select("row", (F.col("gain") * F.col("times")).alias("w")))
    by_row = sums.groupBy("row").agg(F.sum("w").alias("w"))
    return held.select("row", "doc_id", "n_words", "crossing").join(by_row, "row", "left").select(
        "row", "doc_id", "n_words", (F.col("crossing") + F.coalesce("w", F.lit(0))).alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate that depends on the id only, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row; ``rank`` only for the drawn ones."""
    # runs of up to 3 of n words: n + (n - 1) + (n - 2)
    features = sum((F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(1, LONGEST)), F.col("n_words"))
    scored = cut_lineage(weighed(docs, target, doc_id, text, target_text).select(
        "row", "doc_id", "n_words", features.alias("n_features"), "weight", (F.col("weight") + noise(F.col("doc_id"))).cast("long").alias("score")))
    able = scored.where(F.col("n_words") >= LEAST_WORDS)
    draw = able.count() * PERCENT // 100
    placed = dense_seq(able.withColumns({"_least": -F.col("score"), "_none": F.col("doc_id").isNull()}), ["_least", "_none", "doc_id", "row"], out="rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = placed.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(F.col("n_words") < LEAST_WORDS).select(*columns, F.lit(None).cast("long").alias("rank")))
