"""Pattern sets against whole texts, case-insensitively.

Which patterns occur, and where first, stays in JVM expressions for any number
of patterns.  Finding *every* occurrence searches Arrow batches of the text
column alone, and emits what it finds in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.functions.packets import ascii_lower

Rule = tuple[str, str]  # (rule id, pattern)

_MATCHES_PER_BATCH = 100_000
_BYTES_AT_ONCE = 1 << 19  # of texts that are searched as one


def _usable(rules: Sequence[Rule]) -> list[Rule]:
    return [(i, p) for i, p in rules if p]


def _folded_bytes(text) -> bytes:
    """Strings lower-case then UTF-8, bytes ASCII-folded."""
    return text.lower().encode() if isinstance(text, str) else bytes(text).lower()


def _fold(text) -> str | None:
    """One character per byte."""
    return None if text is None else _folded_bytes(text).decode("latin-1")


class _Finder:
    """All places of many patterns in many texts, overlaps included.

    Texts are searched end to end as one array of bytes.  A table over pairs of
    adjacent bytes gives the few places where a pattern may begin, in one pass
    however many patterns there are; the patterns that begin with the pair at
    such a place are then compared from there on.
    """

    def __init__(self, patterns: Sequence[str]):
        self.patterns = [p.encode("latin-1") for p in patterns]
        self.sizes = np.array([len(p) for p in self.patterns], dtype=np.int64)
        self.begins = np.zeros(1 << 16, dtype=bool)
        self.by_pair: dict[int, list[int]] = {}
        for number, pattern in enumerate(self.patterns):
            pairs = [pattern[0] << 8 | pattern[1]] if len(pattern) > 1 else range(pattern[0] << 8, pattern[0] + 1 << 8)
            for pair in pairs:
                self.begins[pair] = True
                self.by_pair.setdefault(pair, []).append(number)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``row, stop, start, pattern number`` in that order; places are counted from the start of their text."""
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        raw = np.frombuffer(b"".join(texts) + b"\0", dtype=np.uint8)
        pairs = raw[:-1].astype(np.uint16) << 8 | raw[1:]
        at = np.flatnonzero(self.begins[pairs])
        pair_at = pairs[at]
        starts, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for pair in np.flatnonzero(np.bincount(pair_at)).tolist() if len(at) else ():
            here = at[pair_at == pair]
            for number in self.by_pair[pair]:
                found, pattern = here, self.patterns[number]
                found = found[found + len(pattern) < len(raw)]  # the last byte belongs to no text
                for i in range(2, len(pattern)):
                    found = found[raw[found + i] == pattern[i]]
                starts.append(found)
                numbers.append(np.full(len(found), number, np.int64))
        start, number = np.concatenate(starts), np.concatenate(numbers)
        stop, row = start + self.sizes[number], np.searchsorted(ends, start, side="right")
        inside = stop <= ends[row] if len(row) else np.zeros(0, dtype=bool)
        row, stop, start, number = (c[inside] for c in (row, stop, start, number))
        order = np.lexsort((number, start, stop))  # texts lie in order, so do their places
        begin = (ends - [len(t) for t in texts])[row[order]]
        return row[order], stop[order] - begin, start[order] - begin, number[order]


def _automaton(patterns: Sequence[str]):
    """All patterns at once, in one pass over a text however many there are; each yields its numbers."""
    import ahocorasick

    numbers: dict[str, list[int]] = {}
    for number, pattern in enumerate(patterns):
        numbers.setdefault(pattern, []).append(number)
    automaton = ahocorasick.Automaton()
    for pattern, own in numbers.items():
        automaton.add_word(pattern, (len(pattern), own))
    automaton.make_automaton()
    return automaton


def any_of(rules: Sequence[Rule], binary: bool = False) -> Callable[[list[str]], np.ndarray]:
    """Which of some texts hold a pattern, for texts that a task has at hand; bytes come as one character each."""
    folded = [_fold(p) if binary else p.lower() for _, p in _usable(rules)]

    def search(texts: list[str]) -> np.ndarray:
        if not folded or not texts:
            return np.zeros(len(texts), dtype=bool)
        automaton = _automaton(folded)
        fold = (lambda t: t.encode("latin-1").lower().decode("latin-1")) if binary else str.lower
        return np.fromiter((next(automaton.iter(fold(t)), None) is not None for t in texts), dtype=bool, count=len(texts))

    return search


def _folded_text(text: Column, binary: bool) -> Column:
    """Bytes as one character each with A-Z folded; strings in lower case."""
    return ascii_lower(F.decode(text, "ISO-8859-1")) if binary else F.lower(text)


def _folded_pattern(pattern: str, binary: bool) -> Column:
    return F.lit(_fold(pattern) if binary else pattern.lower())


def is_binary(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.BinaryType)


def unused_names(taken: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """The wanted names, lengthened until no column has them."""
    taken = {t.lower() for t in taken}
    while any(w.lower() in taken for w in wanted):
        wanted = [w + "_" for w in wanted]
    return list(wanted)


def _rule_table(rules: Sequence[Rule], binary: bool) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("rule_id"), F.lit(p).alias("pattern"), _folded_pattern(p, binary).alias("folded")) for i, p in rules
    ])


def signature_any(text: Column, rules: Sequence[Rule], binary: bool = False) -> Column:
    """True if any pattern occurs; ``binary`` for a column of bytes."""
    usable = _usable(rules)
    if not usable:
        return F.lit(False)
    # a one-element array binds the lower-cased text once for all patterns
    found = F.transform(
        F.array(_folded_text(text, binary)), lambda t: F.exists(_rule_table(usable, binary), lambda r: F.contains(t, r["folded"])))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(False))


def signature_hits(df: DataFrame, text: str, rules: Sequence[Rule]) -> DataFrame:
    """One row per row and rule pattern that occurs: adds ``rule_id``, ``pattern``."""
    usable = _usable(rules)
    if not usable:
        return df.withColumns({"rule_id": F.lit(""), "pattern": F.lit("")}).where(F.lit(False))
    binary = is_binary(df, text)
    hits = F.transform(
        F.array(_folded_text(F.col(text), binary)), lambda t: F.filter(_rule_table(usable, binary), lambda r: F.contains(t, r["folded"])))
    # the outer form keeps the planner from testing every pattern twice (once to drop empty lists)
    found = df.withColumn("_hits", F.get(hits, F.lit(0))).select("*", F.inline_outer("_hits")).drop("_hits", "folded")
    return found.where(F.col("rule_id").isNotNull())


def signature_offsets(df: DataFrame, text: str, rules: Sequence[Rule]) -> DataFrame:
    """Every occurrence, overlaps included: byte offsets ``start`` and exclusive ``stop``.

    The other columns travel along; the text itself is not repeated per match.
    """
    usable = _usable(rules)
    kept = [f for f in df.schema.fields if f.name != text]
    names = [f.name for f in kept]
    schema = T.StructType(list(kept)).add("rule_id", "string").add("pattern", "string")
    schema = schema.add("start", "long").add("stop", "long")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder([_fold(p) for _, p in usable])
        ids, patterns = pa.array([i for i, _ in usable], pa.string()), pa.array([p for _, p in usable], pa.string())

        def pieces(batch: pa.RecordBatch, first: int, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            row, stop, start, rule = finder(texts)
            for at in range(0, len(row), _MATCHES_PER_BATCH):
                some = slice(at, at + _MATCHES_PER_BATCH)
                columns = [batch.column(n).take(pa.array(first + row[some])) for n in names]
                number = pa.array(rule[some])
                columns += [ids.take(number), patterns.take(number), pa.array(start[some]), pa.array(stop[some])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            first, texts, size = 0, [], 0
            for value in batch.column(text):
                texts.append(_folded_bytes(value.as_py()))
                size += len(texts[-1])
                if size > _BYTES_AT_ONCE:
                    yield from pieces(batch, first, texts)
                    first, texts, size = first + len(texts), [], 0
            if texts:
                yield from pieces(batch, first, texts)

    if not usable:
        return df.drop(text).mapInArrow(lambda batches: iter(()), schema)
    # the search passes over a text faster than the JVM folds it, so there is no test before it
    return df.where(F.length(text) > 0).mapInArrow(locate, schema)


def signature_names(df: DataFrame, text: str, rules: Sequence[Rule]) -> DataFrame:
    """``names``: matched patterns in order of their first match's end, then its start."""
    usable = _usable(rules)
    if not usable:
        return df.withColumn("names", F.array().cast("array<string>"))
    binary = is_binary(df, text)
    folded, *places = unused_names(df.columns, ["_folded", *(f"_at_{i}" for i in range(len(usable)))])
    # a projection of its own: the text is folded once, and every pattern is looked up once, in generated code;
    # a search for bytes decides first, since one that counts characters takes much longer
    found = df.withColumn(folded, _folded_text(F.col(text), binary)).select(
        *df.columns, *[F.when(F.contains(F.col(folded), _folded_pattern(p, binary)), F.position(_folded_pattern(p, binary), F.col(folded))).alias(c)
                       for c, (_, p) in zip(places, usable)])
    spots = F.array(*[
        F.when(F.col(c) > 0, F.struct(
            (F.col(c) + F.length(_folded_pattern(p, binary))).alias("stop"), F.col(c).alias("start"), F.lit(i).alias("number"), F.lit(p).alias("pattern")))
        for i, (c, (_, p)) in enumerate(zip(places, usable))])
    return found.withColumn("names", F.transform(F.sort_array(F.array_compact(spots)), lambda s: s["pattern"])).select(
        *[c for c in df.columns if c != "names"], "names")


def rule_counts(
    df: DataFrame, text: str, rules: Sequence[Rule], by: Sequence[Column | str], protocols: Mapping[str, int] | None = None
) -> DataFrame:
    """Rows matching each rule, per group; partial sums leave the map side.

    A rule in ``protocols`` counts rows of that ``protocol`` number only.
    """
    hits = signature_hits(df, text, rules)
    for rule_id, number in (protocols or {}).items():
        hits = hits.where((F.col("rule_id") != rule_id) | (F.col("protocol") == number))
    return hits.groupBy(*by, "rule_id").agg(F.count(F.lit(1)).alias("matches"))


def over_threshold(counts: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """Keep groups that reach their rule's threshold."""
    limit = F.lit(None).cast("int")
    for rule, n in thresholds.items():
        limit = F.when(F.col("rule_id") == rule, n).otherwise(limit)
    return counts.where(F.col("matches") >= limit)


def _slot(width_us: int) -> Column:
    return (F.floor(F.col("ts_us") / width_us) * width_us).alias("slot_us")


def rate_limit(packets: DataFrame, limit: int, width_us: int = 1_000_000) -> DataFrame:
    """Sources above ``limit`` packets in a tumbling window."""
    counts = packets.groupBy(_slot(width_us), "src_ip").agg(F.count(F.lit(1)).alias("packets"))
    return counts.where(F.col("packets") > limit)


def syn_limit(packets: DataFrame, limit: int, width_us: int = 1_000_000) -> DataFrame:
    """Sources above ``limit`` connection openings (SYN without ACK) in a window."""
    opening = (F.col("flags").bitwiseAND(F.lit(2)) != 0) & (F.col("flags").bitwiseAND(F.lit(16)) == 0)
    counts = packets.groupBy(_slot(width_us), "src_ip").agg(F.count_if(opening).alias("syns"))
    return counts.where(F.col("syns") > limit)
