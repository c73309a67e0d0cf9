"""Secrets in text: fixed patterns, and formats learnt by grammar inference.

What the fixed patterns find are labelled credentials.  For each kind a prefix
tree of such strings is turned into a probabilistic automaton: states whose
symbol and end frequencies differ by no more than a Hoeffding bound allows, at
every step below them, are merged (most visited states first).  Ordinary long
runs of the same characters give one automaton more.  Every run of credential
characters in every text is a candidate; its score for a kind is the log ratio
of the kind's automaton to the ordinary one, per symbol.  A run counts as found
if it reaches the kind's threshold, which comes from the sampled strings.  A
format that over 1 % of the ordinary runs have is not told from them.

The automata are fitted on at most ``FIT_ROWS`` distinct strings of a kind of
at most ``FIT_SYMBOLS`` symbols, those with the smallest hashes, so the choice
depends on the strings only; each task hands on no more than that many.  All
else covers whole texts and all rows.

Null, empty and clean texts have no spans.  Texts and runs may be of any length.
Repeated rows are scanned one by one.  Kinds with fewer than ``LEAST_ROWS``
strings have no automaton.  An empty table gives an empty result.  Only the
named columns are used, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from math import log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.session import cut_lineage

#: Kinds in the order that breaks ties; the last one is what the automata add.
KINDS = ("assign", "access", "hex", "format")
ORDINARY = "ordinary"
#: Strings of a kind, and their symbols, that an automaton is fitted on.
FIT_ROWS = 1000
FIT_SYMBOLS = 128
LEAST_ROWS = 20
#: Symbols of the shortest run that is scored.
LEAST_SYMBOLS = 16
#: Confidence of the merge test, and visits below which a state has too little to say against a merge.
ALPHA = 0.01
LEAST_VISITS = 8

# fixed values: the patterns of the contract
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is the match of a longest run that is long enough
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % LEAST_SYMBOLS)

# texts without these hold nothing of the kind; linear in the text
_MAY_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
_MAY_ACCESS = "AKIA[A-Z0-9]"
_MAY_HEX = "[0-9a-f]{32}"
_MAY_RUN = "[A-Za-z0-9+/_.=-]{%d}" % LEAST_SYMBOLS

Span = tuple[int, int, int]  # start, place in KINDS, end


def fixed_spans(text: str, kinds: Sequence[bool] = (True, True, True)) -> list[tuple[Span, str]]:
    """Matches of the fixed patterns with the credential itself, in order; ``kinds`` says which can occur."""
    found = []
    if kinds[0]:
        found += [((m.start(), 0, m.end()), m.group(1)) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    if kinds[1]:
        found += [((m.start(), 1, m.end()), m.group()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if kinds[2]:
        found += [((m.start(), 2, m.end()), m.group()) for m in _HEX.finditer(text)]
    return sorted(found)


def other_runs(text: str, taken: list[tuple[Span, str]]) -> Iterator[tuple[int, int]]:
    """Runs of credential characters that no fixed span overlaps, without dots at their ends."""
    spans = [(s, e) for (s, _, e), _ in taken]
    i, reach = 0, 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while i < len(spans) and spans[i][0] < end:
            reach = max(reach, spans[i][1])
            i += 1
        if reach > start:
            continue
        run = m.group()
        start, end = start + len(run) - len(run.lstrip(".")), end - len(run) + len(run.rstrip("."))
        if end - start >= LEAST_SYMBOLS:
            yield start, end


# automata -----------------------------------------------------------------------------------------------------------

@dataclass
class _State:
    visits: int = 0
    ends: int = 0
    next: dict[str, int] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)


@dataclass
class Automaton:
    """Per state: log probability to end, and for each symbol seen there the next state and its log probability."""

    ends: list[float]
    moves: list[dict[str, tuple[int, float]]]
    unseen: list[float]

    def score(self, text: str) -> float:
        """Log probability of ``text``; from a symbol not seen in a state the walk goes on at the start."""
        at, total = 0, 0.0
        for c in text:
            move = self.moves[at].get(c)
            if move is None:
                total += self.unseen[at]
                at = 0
            else:
                at = move[0]
                total += move[1]
        return total + self.ends[at]


def _differ(a: int, n: int, b: int, m: int, bound: float) -> bool:
    return abs(a / n - b / m) > bound * (1 / sqrt(n) + 1 / sqrt(m))


def infer(strings: Iterable[str], alpha: float = ALPHA, symbols: int = 66) -> Automaton:
    """Merge compatible states of the prefix tree of ``strings``."""
    states = [_State()]
    for text in strings:
        at = 0
        states[0].visits += 1
        for c in text:
            to = states[at].next.get(c)
            if to is None:
                to = states[at].next[c] = len(states)
                states.append(_State())
            states[at].counts[c] = states[at].counts.get(c, 0) + 1
            states[to].visits += 1
            at = to
        states[at].ends += 1
    bound = sqrt(0.5 * log(2 / alpha))

    def compatible(a: int, b: int) -> bool:
        pending = [(a, b)]
        while pending:
            a, b = pending.pop()
            x, y = states[a], states[b]
            if a == b or min(x.visits, y.visits) < LEAST_VISITS:
                continue
            if _differ(x.ends, x.visits, y.ends, y.visits, bound):
                return False
            for c in x.counts.keys() | y.counts.keys():
                if _differ(x.counts.get(c, 0), x.visits, y.counts.get(c, 0), y.visits, bound):
                    return False
                if c in x.next and c in y.next:
                    pending.append((x.next[c], y.next[c]))
        return True

    def fold(into: int, root: int) -> None:
        pending = [(into, root)]  # root heads a tree: it is not a part of the merged states yet
        while pending:
            a, b = pending.pop()
            x, y = states[a], states[b]
            x.visits += y.visits
            x.ends += y.ends
            for c, n in y.counts.items():
                x.counts[c] = x.counts.get(c, 0) + n
                if c in x.next:
                    pending.append((x.next[c], y.next[c]))
                else:
                    x.next[c] = y.next[c]

    kept = [0]
    settled = {0}
    while True:
        border = [(states[to].visits, -to, a, c) for a in kept for c, to in states[a].next.items() if to not in settled]
        if not border:
            break
        _, to, at, c = max(border)
        to = -to
        same = next((k for k in kept if compatible(k, to)), None)
        if same is None:
            kept.append(to)
            settled.add(to)
        else:
            states[at].next[c] = same
            fold(same, to)
    place = {k: i for i, k in enumerate(kept)}
    ends, moves, unseen = [], [], []
    for k in kept:
        s = states[k]
        whole = log(s.visits + 0.1 * (symbols + 1))
        ends.append(log(s.ends + 0.1) - whole)
        unseen.append(log(0.1) - whole)
        moves.append({c: (place[s.next[c]], log(n + 0.1) - whole) for c, n in s.counts.items()})
    return Automaton(ends, moves, unseen)


@dataclass
class Formats:
    """Automata of the kinds with their thresholds, and the ordinary one."""

    ordinary: Automaton
    kinds: dict[str, tuple[Automaton, float]]

    def likelihood(self, text: str) -> dict[str, float]:
        """Log ratio per symbol for each kind."""
        base = self.ordinary.score(text)
        return {k: (a.score(text) - base) / (len(text) + 1) for k, (a, _) in self.kinds.items()}

    def accepts(self, text: str) -> bool:
        return any(v >= self.kinds[k][1] for k, v in self.likelihood(text).items())


def learn(strings: dict[str, list[str]]) -> Formats | None:
    """Automata of the kinds with enough strings.

    A threshold leaves out 1 % of the strings that an automaton of the other half
    has not seen, and 99 % of the ordinary runs.
    """
    known = {k: v for k, v in strings.items() if k != ORDINARY and len(v) >= LEAST_ROWS}
    if not known:
        return None
    plain = strings.get(ORDINARY, [])
    formats = Formats(infer(plain), {k: (infer(v), 0.0) for k, v in known.items()})
    own: dict[str, list[float]] = {k: [] for k in known}
    for half in (0, 1):
        part = Formats(formats.ordinary, {k: (infer(v[half::2]), 0.0) for k, v in known.items()})
        for k, v in known.items():
            own[k] += [part.likelihood(x)[k] for x in v[1 - half::2]]
    other = [formats.likelihood(x) for x in plain]
    for k in known:
        least = float(np.quantile(own[k], 0.01))
        usual = float(np.quantile([x[k] for x in other], 0.99)) + 1e-9 if other else 0.0
        formats.kinds[k] = formats.kinds[k][0], max(least, usual, 0.0)
    return formats


# Spark --------------------------------------------------------------------------------------------------------------

def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) >> 1


def _gates(texts: pa.Array) -> list[tuple[bool, bool, bool, bool]]:
    texts = texts.cast(pa.large_string())
    return list(zip(*(pc.fill_null(pc.match_substring_regex(texts, p), False).to_pylist() for p in (_MAY_ASSIGN, _MAY_ACCESS, _MAY_HEX, _MAY_RUN))))


def labelled(docs: DataFrame, text: str = "text", rows: int = FIT_ROWS) -> dict[str, list[str]]:
    """At most ``rows`` distinct strings of each kind, those with the smallest hashes."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, dict[str, int]] = {}
        heaps: dict[str, list[tuple[int, str]]] = {}

        def offer(kind: str, value: str) -> None:
            if len(value) > FIT_SYMBOLS:
                return
            seen, heap = least.setdefault(kind, {}), heaps.setdefault(kind, [])
            if value in seen:
                return
            h = _hash(value)
            if len(heap) >= rows:
                if -heap[0][0] <= h:
                    return
                del seen[heapq.heappop(heap)[1]]
            seen[value] = h
            heapq.heappush(heap, (-h, value))

        for batch in batches:
            for value, gates in zip(batch.column(0), _gates(batch.column(0))):
                if not any(gates):
                    continue
                whole = value.as_py()
                found = fixed_spans(whole, gates)
                for (_, kind, _), credential in found:
                    offer(KINDS[kind], credential)
                if gates[3]:
                    for start, end in other_runs(whole, found):
                        offer(ORDINARY, whole[start:end])
        out = [(k, v, h) for k, own in least.items() for v, h in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["kind", "value", "h"])

    found = cut_lineage(docs.select(text).mapInArrow(sample, "kind string, value string, h long"))
    out = {}
    for kind in (*KINDS[:3], ORDINARY):
        own = found.where(F.col("kind") == kind).groupBy("value").agg(F.min("h").alias("h"))
        out[kind] = [r["value"] for r in own.orderBy("h", "value").limit(rows).collect()]
    return out


def scan(docs: DataFrame, formats: Formats | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans`` with ``kind, start, end`` in code points, ends exclusive, by start and then kind."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(formats)  # bounded by FIT_ROWS strings of FIT_SYMBOLS symbols
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, gates in zip(batch.column("text"), _gates(batch.column("text"))):
                spans: list[Span] = []
                if any(gates):
                    whole = value.as_py()
                    fixed = fixed_spans(whole, gates)
                    spans = [s for s, _ in fixed]
                    if gates[3] and sent.value:
                        spans += [(a, 3, b) for a, b in other_runs(whole, fixed) if sent.value.accepts(whole[a:b])]
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(span))], names=["doc_id", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(find, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long>>")


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fixed and learnt spans of every document."""
    return scan(docs, learn(labelled(docs, text)), doc_id, text)


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans`` for every document."""
    found = secrets(docs)

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    fixed = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    return found.select("doc_id", *map(number, KINDS), F.sha2(written(fixed), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))

