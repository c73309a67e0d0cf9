"""N-gram Jaccard join: texts linked by the overlap of their word shingles.

A text's set holds the 64-bit hashes of its distinct five-word shingles.  Equal
sets are one node.  Two nodes link if 100 |A n B| >= 80 |A u B|.

Index.  Under any one order of shingles, two sets that link share two among the
first n - ceil(0.8 n) + 2 of each, so one shared shingle is no reason to compare.
The order is by hash, with shingles that very many sets hold last; counts cover
all texts (a task leaves out what one of its texts alone holds), and only the
order, never the result, depends on them.  The index list of a shingle is sorted by set size and
cut into blocks; a block is skipped against another one if its sizes or its
positions leave too small an overlap.

Set relations.  A list first proposes only two pairs for each set: with its
neighbour and with the smallest set that it may link to.  Once sets are verified
to belong together, what one of them links to is an answer for all of them, so
later only pairs of sets that are not yet connected are proposed, from lists
that more than one component shares.  Proposals meet an exact bound first (the
parity bitmaps of two sets differ in at most as many bits as the sets in
elements), then the sets themselves.  In such a list the bound is applied before
a pair leaves the task, and a set is given a few likely partners a round; lists
that hold back pairs come again until none does.  Lists too long for a task are
compared as pairs of blocks.  Pairs around one set are verified in one bundle,
so a set moves once a bundle and not once a pair; large bundles are cut up.

Texts with fewer than five words are one shingle; null texts and texts without
words have the empty set and no links.  Repeated rows are equal sets.  Rows
without an id take part; a component of such rows only has no id.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.components import components
from flowsift.llm.text import few, small, unused
from flowsift.operators.ordering import keyed_seq
from flowsift.session import cut_lineage, shuffle_partitions

WORDS = 5
#: Similarity in percent.
LEAST = 80
#: Sets that hold a shingle from which it comes late in the order, and how many such shingles tasks are told of (the most frequent).
FREQUENT = 50
MOST_FREQUENT = 1_000_000
#: Shingles that a task counts at once.
COUNTED = 1_000_000
#: Smaller sets link to equal ones only.
LEAST_SET = 4
#: Partners that a set is given in a list and round.
PARTNERS = 8
#: Sets of a list that are compared at once, and sets of a list that one task gets.
BLOCK = 256
PART = 50_000
#: Texts whose sets or places leave a task at once (each is some kB).
TEXTS = 1000
#: 64-bit words in a parity bitmap.
BITMAP = 16
#: Elements of the sets that are verified in one bundle (8 bytes each).
BUNDLE = 4_000_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text."""
    import xxhash

    own = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z change, only ASCII space splits
    if not own:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, own), dtype=np.uint64, count=len(own))
    n = max(len(own) - words + 1, 1)
    rolled = np.full(n, min(words, len(own)), dtype=np.uint64)
    for i in range(min(words, len(own))):
        rolled += hashed[i:i + n] * (_MIX[0] + np.uint64(2 * i))  # an odd factor for each place
    rolled = np.sort(_mixed(rolled))
    return rolled[np.concatenate([[True], rolled[1:] != rolled[:-1]])]


def _member(found: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Which of ``found`` are among the values, by binary search: the long side is not touched."""
    if not len(sorted_values):
        return np.zeros(len(found), dtype=bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, found), len(sorted_values) - 1)] == found


def node_of(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def prefix_length(n: int) -> int:
    return min(n, n - -(-n * LEAST // 100) + 2)


def _least_overlap(a, b):
    """Smallest |A n B| of linked sets of sizes a and b."""
    return -(-(LEAST * (a + b)) // (100 + LEAST))


def _bitmap(found: np.ndarray) -> bytes:
    """Parity of the elements that fall on each bit."""
    bits = np.bincount((found % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for text in texts:
        yield shingles(text.as_py())


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(batch), TEXTS):
        yield batch.slice(at, TEXTS)


def _often(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come at least twice, and how often."""
    found = np.sort(np.concatenate(parts or [np.zeros(0, np.uint64)]))
    starts = _starts(found) if len(found) else np.zeros(0, np.int64)
    times = np.diff(np.append(starts, len(found)))
    return found[starts[times > 1]].view(np.int64), times[times > 1]


def nodes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, node, times``: every row, with null ``times``; and shingles (as ``node``) that ``times`` texts of a task could index.

    A task says nothing of shingles that only one of its texts holds (of some
    ``COUNTED`` in a row): lists that all tasks fill so are no longer than the
    tasks are many.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        early, held, kind = [], 0, None

        def counted() -> pa.RecordBatch:
            often, times = _often(early)
            return pa.RecordBatch.from_arrays([pa.nulls(len(often), kind), pa.nulls(len(often), pa.int64()), pa.array(often), pa.array(times, pa.int64())],
                                              names=["doc_id", "n_shingles", "node", "times"])

        for batch in batches:
            sizes, names, kind = [], [], batch.column("doc_id").type
            for found in _sets(batch.column("text")):
                sizes.append(len(found))
                names.append(node_of(found))
                early.append(found[:prefix_length(len(found)) * 3 // 2].copy())  # not the whole set
                held += len(early[-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.nulls(len(sizes), pa.int64())],
                                             names=["doc_id", "n_shingles", "node", "times"])
            if held > COUNTED:
                yield counted()
                early, held = [], 0
        if held:
            yield counted()

    return rows.mapInArrow(name, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles long, node long, times long")


def named_and_late(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, n_shingles, node`` of every row, and the shingles of many texts, at most ``MOST_FREQUENT``; the texts are read once for both."""
    both = cut_lineage(nodes(docs, doc_id, text))
    counts = both.where("times is not null").groupBy("node").agg(F.sum("times").alias("times")).where(F.col("times") > FREQUENT)
    most = counts.orderBy(F.desc("times"), "node").limit(MOST_FREQUENT)
    late = np.sort(np.array([r["node"] for r in most.select("node").collect()], dtype=np.int64).view(np.uint64))
    return both.where("times is null").drop("times"), late


def index_rows(docs: DataFrame, text: str, late: np.ndarray) -> DataFrame:
    """``shingle, node, n, pos``: the places of each set in the index; equal sets of a batch come once."""
    sent = docs.sparkSession.sparkContext.broadcast(late)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for part in _slices(batch):
                columns = [[], [], [], []]
                for found in _sets(part.column(0)):
                    n = len(found)
                    node = node_of(found)
                    if n < LEAST_SET or node in seen:
                        continue
                    seen.add(node)
                    last = _member(found, sent.value)
                    first = np.concatenate([found[~last], found[last]])[:prefix_length(n)]
                    k = len(first)
                    for column, values in zip(columns, (first.view(np.int64), np.full(k, node), np.full(k, n, np.int32), np.arange(k, dtype=np.int32))):
                        column.append(values)
                kinds = (np.int64, np.int64, np.int32, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, k)) for c, k in zip(columns, kinds)],
                                                 names=["shingle", "node", "n", "pos"])

    return docs.select(text).mapInArrow(places, "shingle long, node long, n int, pos int")


def _fits(smaller: np.ndarray, larger: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Whether sizes, and the elements left from a shared one on (the first or the second), allow a link."""
    return (100 * smaller >= LEAST * larger) & (rest + 1 >= _least_overlap(smaller, larger))


def block_pairs(
    node: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, bitmap: np.ndarray, side: np.ndarray | None = None,
    partners: int | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Likely pairs of one list (sorted by size) with different roots (and sides), and whether some are held back.

    Block against block; sizes and positions decide first, then the bitmaps.
    With ``partners`` a set that has as many already waits for another round.
    """
    rest = n - pos  # elements from the shared one on
    given = np.zeros(len(n), dtype=np.int64)
    for a in range(0, len(n), BLOCK):
        block_a = slice(a, a + BLOCK)
        for b in range(a, len(n), BLOCK):
            block_b = slice(b, b + BLOCK)
            if 100 * n[block_a][-1] < LEAST * n[b]:
                break  # all later blocks hold larger sets
            if min(rest[block_a].max(), rest[block_b].max()) + 1 < _least_overlap(n[a], n[b]):
                continue
            fits = _fits(n[block_a][:, None], n[block_b][None, :], np.minimum(rest[block_a][:, None], rest[block_b][None, :]))
            fits &= root[block_a][:, None] != root[block_b][None, :]
            if side is not None:
                fits &= side[block_a][:, None] != side[block_b][None, :]
            i, j = np.nonzero(fits)
            keep = a + i < b + j
            i, j, held = a + i[keep], b + j[keep], False
            if partners is not None:
                ready = given[i] < partners
                held = not ready.all()
                i, j = i[ready], j[ready]
            differ = np.bitwise_count(bitmap[i] ^ bitmap[j]).sum(axis=1, dtype=np.int64)
            likely = n[i] + n[j] - 2 * _least_overlap(n[i], n[j]) >= differ
            i, j = i[likely], j[likely]
            if partners is not None and len(i):
                first = np.flatnonzero(np.diff(i, prepend=-1))  # pairs are sorted by i
                nth = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
                ready = given[i] + nth < partners
                held = held or not ready.all()
                i, j = i[ready], j[ready]
                np.add.at(given, i, 1)
            if len(i) or held:
                yield node[i], node[j], held


def _ordered(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, the smaller node first, and how often they come."""
    low, high = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return low[new], high[new], np.diff(np.append(np.flatnonzero(new), len(new)))


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a run of rows with equal keys begins."""
    new = np.ones(len(sorted_keys[0]), dtype=bool)
    new[1:] = False
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _near_pairs(of: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row with the one before it and with the smallest one of its list that it may link to.

    ``of`` numbers the lists; rows are sorted by list and size.  That is two
    pairs for each row at most, however long the list.
    """
    n, at = n.astype(np.int64), np.arange(len(n))
    place = of << 32 | n
    smallest = np.searchsorted(place, of << 32 | -(-LEAST * n // 100))
    first = np.concatenate([smallest, at[:-1]])
    second = np.concatenate([at, at[1:]])
    fits = (first < second) & (of[first] == of[second])
    fits[len(n):] &= smallest[1:] != at[:-1]  # that pair is there already
    first, second = first[fits], second[fits]
    fits = _fits(n[first], n[second], np.minimum(n[first] - pos[first], n[second] - pos[second]))
    return node[first[fits]], node[second[fits]]


def _held_lists(columns: list[np.ndarray], begun: bool, goes_on: bool) -> list[np.ndarray]:
    """Rows ``list, node, n, pos`` of the lists that may hold more pairs than :func:`_near_pairs` gives.

    Lists of up to three rows do not.  Lists of the same nodes become one with
    the smallest position of each node, named by its nodes.  A list of which
    only a part is here (the first if ``begun``, the last if it ``goes_on``)
    keeps its shingle as its name.
    """
    shingle, node, n, pos = columns
    starts = _starts(shingle)
    sizes = np.diff(np.append(starts, len(node)))
    name = _mixed(np.add.reduceat(_mixed(node.view(np.uint64)), starts) + sizes.astype(np.uint64)).view(np.int64)
    kept = sizes > 3
    for at, partly in ((0, begun), (-1, goes_on)):
        if partly:
            name[at], kept[at] = shingle[starts[at]], True
    name, rank = np.repeat(name, sizes), np.arange(len(node)) - np.repeat(starts, sizes)
    rows = np.flatnonzero(np.repeat(kept, sizes) & ~(begun & (np.arange(len(node)) == 0)))  # the first row of a later part was in the part before
    order = rows[np.lexsort((node[rows], rank[rows], name[rows]))]
    name, node, n, pos, rank = (c[order] for c in (name, node, n, pos, rank))
    starts = _starts(name, rank, node)
    least = np.minimum.reduceat(pos, starts) if len(starts) else pos
    return [name[starts], node[starts], n[starts], least]


def proposals(index: DataFrame) -> DataFrame:
    """Pairs to verify first, as rows ``a, b`` with null ``n`` and their lists in ``pos``; and rows ``a`` (list), ``b`` (node), ``n``, ``pos`` of lists with more."""
    names = ["shingle", "node", "n", "pos"]
    sorted_ = index.repartition(shuffle_partitions(index.sparkSession), "shingle").sortWithinPartitions("shingle", "n", "node")

    def work(columns: list[np.ndarray], begun: bool, goes_on: bool) -> pa.RecordBatch:
        starts = _starts(columns[0], columns[1])  # equal sets of different batches are one node
        columns = [c[starts] for c in columns]
        of = np.zeros(len(starts), dtype=np.int64)
        of[_starts(columns[0])[1:]] = 1
        x, y, often = _ordered(*_near_pairs(np.cumsum(of), *columns[1:]))
        rows = _held_lists(columns, begun, goes_on)
        first = [pa.array(x), pa.array(y), pa.nulls(len(x), pa.int32()), pa.array(often, pa.int32())]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([p, pa.array(v, k)]) for p, v, k in zip(first, rows, kinds)], names=["a", "b", "n", "pos"])

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun = None, False  # rows of the last list; whether some of its rows were worked off already
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
            if not len(columns[0]):
                continue
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            if last:
                yield work([c[:last] for c in columns], begun, False)
                begun = False
            held = [c[last:] for c in columns]
            if len(held[0]) > PART:
                yield work(held, begun, True)
                held, begun = [c[-1:] for c in held], True  # the last row ties the parts
        if held is not None and len(held[0]):
            yield work(held, begun, False)

    return cut_lineage(sorted_.mapInArrow(propose, "a long, b long, n int, pos int"))


def _split_lists(rows: DataFrame) -> DataFrame:
    """``rows`` with ``side`` and ``pair``: lists of over ``PART`` rows as pairs of blocks of that many, others as they are.

    Rows of a long list are numbered by size over all tasks.  Each pair of its
    blocks whose sizes allow a link is a list of its own, so no task holds more
    than two blocks.
    """
    longer = cut_lineage(rows.groupBy("list").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > PART))
    plain = rows.select("*", F.lit(0).cast("long").alias("side"), F.lit(-1).cast("long").alias("pair"))
    if longer.isEmpty():
        return plain
    numbered = keyed_seq(rows.join(small(longer.select("list")), "list", "left_semi"), ["list"], ["n", "node", "pos"], out="rank")
    numbered = cut_lineage(numbered.select("list", "node", "n", "pos", "root", F.floor((F.col("rank") - 1) / PART).alias("side")))
    blocks = cut_lineage(numbered.groupBy("list", "side").agg(F.min("n").alias("least"), F.max("n").alias("most")))
    earlier = blocks.select("list", F.col("side").alias("a"), F.col("most").alias("most_a"))
    later = blocks.select("list", F.col("side").alias("b"), F.col("least").alias("least_b"))
    pairs = earlier.join(later, "list").where("a <= b").where(100 * F.col("most_a") >= LEAST * F.col("least_b"))
    sides = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    pairs = pairs.select("list", F.explode(sides).alias("side"), (F.col("a") * 2**31 + F.col("b")).alias("pair"))
    split = numbered.join(small(cut_lineage(pairs)), ["list", "side"]).select(*plain.columns)
    return plain.join(small(longer.select("list")), "list", "left_anti").unionByName(split)


def unconnected(rows: DataFrame, partners: int | None) -> DataFrame:
    """``x, y, nx, ny, list``: likely pairs (with sizes) of the lists (``list, node, n, pos, root, data``) whose sets are not connected; and, without a pair, lists that hold back some."""
    names = ["list", "pair", "side", "node", "n", "pos", "root", "data"]
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), "list", "pair").sortWithinPartitions("list", "pair", "n", "node", "pos")

    def of_list(columns: list) -> Iterator[pa.RecordBatch]:
        list_, pair, side, node, n, pos, root, data = columns
        first = _starts(node)  # the same nodes may come from several tasks: the smallest position stays
        node, n, pos, root, side = (c[first] for c in (node, n.astype(np.int64), pos.astype(np.int64), root, side))
        if (root == root[0]).all():
            return
        bitmap = np.frombuffer(b"".join(data[i] for i in first), dtype=np.uint64).reshape(len(first), -1)
        across = side if pair[0] >= 0 and pair[0] >> 31 != pair[0] & 0x7FFFFFFF else None
        by_node = np.argsort(node)
        for x, y, held in block_pairs(node, n, pos, root, bitmap, across, partners):
            low, high, _ = _ordered(x, y)
            sizes = [n[by_node[np.searchsorted(node, of, sorter=by_node)]] for of in (low, high)]
            gap, own = pa.nulls(int(held), pa.int64()), pa.array(list_[:int(held)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.concat_arrays([pa.array(c), gap]) for c in (low, high, *sizes)),
                                              pa.concat_arrays([pa.nulls(len(low), pa.int64()), own])], names=["x", "y", "nx", "ny", "list"])

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
            if not len(columns[0]):
                continue
            edges = _starts(*columns[:2])
            for begin, end in zip(edges[:-1], edges[1:]):
                yield from of_list([c[begin:end] for c in columns])
            held = [c[edges[-1]:] for c in columns]
        if held is not None and len(held[0]):
            yield from of_list(held)

    return rows.select(*names).mapInArrow(propose, "x long, y long, nx long, ny long, list long").distinct()


def _shared_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the lists that sets of several components share, with ``root``."""
    at = small(roots.select(F.col("node").alias("_node"), "root"))
    rows = lists.join(at, F.col("node") == F.col("_node"), "left").select("list", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
    mixed = rows.groupBy("list").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select("list")
    return cut_lineage(rows.join(small(cut_lineage(mixed)), "list", "left_semi"))


def _made(docs: DataFrame, doc_id: str, text: str, holders: DataFrame, wanted: DataFrame, whole: bool) -> DataFrame:
    """``node, n, data`` of the texts of the wanted nodes, and of some others: the set itself or its bitmap.

    Only texts of one holder of each node (and of rows without an id) are read
    again.  Equal texts of a batch come once.
    """
    nodes_ = wanted.select("node").distinct()
    sent = small(nodes_)
    ids = holders.join(sent, "node").select(F.col("holder").alias("_holder"))
    ids = ids if sent is nodes_ else F.broadcast(ids)  # no more than there are nodes
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_holder"), F.col(text).alias("text"))
    texts = rows.join(ids, "_holder", "left_semi").select("text").unionByName(
        docs.where(F.col(doc_id).isNull()).select(F.col(text).alias("text")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for part in _slices(batch):
                out = {}
                for found in _sets(part.column(0)):
                    node = node_of(found)
                    if len(found) and node not in seen:
                        seen.add(node)
                        out[node] = len(found), found.tobytes() if whole else _bitmap(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array(list(out), pa.int64()), pa.array([v[0] for v in out.values()], pa.int64()), pa.array([v[1] for v in out.values()], pa.binary())
                ], names=["node", "n", "data"])

    return texts.mapInArrow(make, "node long, n long, data binary")


def bitmaps_of(docs: DataFrame, doc_id: str, text: str, holders: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, n, data`` for the wanted nodes: the bitmap of each."""
    kept = _made(docs, doc_id, text, holders, wanted, whole=False).join(small(wanted.select("node")), "node", "left_semi")
    return kept.groupBy("node").agg(F.max("n").alias("n"), F.any_value("data").alias("data"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()


def _with_data(pairs: DataFrame, data: DataFrame) -> DataFrame:
    at_y = data.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("data").alias("dy"))
    at_x = data.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("data").alias("dx"))
    return pairs.join(at_y, "y").join(at_x, "x").select("x", "y", "nx", "ny", "dx", "dy")


def _likely(pairs: DataFrame) -> DataFrame:
    """The pairs (with bitmaps) that may link."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny = (batch.column(c).to_numpy() for c in ("nx", "ny"))
            yes = [_may_link(int(a), int(b), x.as_buffer(), y.as_buffer()) for a, b, x, y in zip(nx, ny, batch.column("dx"), batch.column("dy"))]
            yield batch.select(["x", "y", "nx", "ny"]).filter(pa.array(yes, pa.bool_()))

    return pairs.mapInArrow(judge, "x long, y long, nx long, ny long")


def _may_link(nx: int, ny: int, a, b) -> bool:
    differ = int(np.bitwise_count(np.frombuffer(a, dtype=np.uint64) ^ np.frombuffer(b, dtype=np.uint64)).sum())
    return nx + ny - 2 * _least_overlap(nx, ny) >= differ


def _link(a: np.ndarray, b: np.ndarray) -> bool:
    common = int(_member(a, b).sum()) if len(a) < len(b) else int(_member(b, a).sum())
    return 100 * common >= LEAST * (len(a) + len(b) - common)


def bundles(pairs: DataFrame) -> DataFrame:
    """``x, y, bundle`` of pairs (``x, y, nx, ny``): every pair in one bundle, together with most others of its sets.

    A bundle is named by the smallest set within two steps of ``x``.  One whose
    sets hold over ``BUNDLE`` elements is cut up by hash, into parts whose sets
    hold about as many even if no pairs share one.
    """
    x, y, n = F.col("x"), F.col("y"), F.col("nx")
    both = pairs.select(F.explode(F.array(F.struct(x, y), F.struct(y.alias("x"), x.alias("y")))).alias("e")).select("e.*")
    near = both.groupBy("x").agg(F.least("x", F.min("y")).alias("around"))
    further = both.join(near.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("around").alias("around"))
    placed = few(pairs.join(further, "x"))
    ends = placed.select("around", F.explode(F.array(F.struct(x, n.alias("n")), F.struct(y.alias("x"), F.col("ny").alias("n")))).alias("e"))
    heavy = ends.distinct().groupBy("around").agg(F.sum("e.n").alias("held")).where(F.col("held") > BUNDLE).select("around")
    parts = placed.join(heavy, "around").groupBy("around").agg(F.ceil(F.sum(n + F.col("ny")) / BUNDLE).alias("parts"))
    part = F.pmod(F.xxhash64("x", "y"), F.coalesce("parts", F.lit(1)))
    return placed.join(parts, "around", "left").select("x", "y", F.xxhash64("around", part).alias("bundle"))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``x, y, bundle``) that link; ``sets`` holds ``bundle, node, data``, some of them repeatedly."""

    def judge(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held = {node: np.frombuffer(data.as_buffer(), dtype=np.uint64) for node, data in zip(sets["node"].to_pylist(), sets["data"])}
        ends = zip(pairs["x"].to_pylist(), pairs["y"].to_pylist())
        return pairs.select(["x", "y"]).filter(pa.array([_link(held[x], held[y]) for x, y in ends], pa.bool_()))

    return pairs.groupBy("bundle").cogroup(sets.groupBy("bundle")).applyInArrow(judge, "x long, y long")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` after more links: only the roots that they join are worked on."""
    at_x = roots.select(F.col("node").alias("x"), F.col("root").alias("rx"))
    at_y = roots.select(F.col("node").alias("y"), F.col("root").alias("ry"))
    joined = links.join(at_x, "x", "left").join(at_y, "y", "left")
    over = components(joined.select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y")))
    over = over.select(F.col("node").alias("_was"), F.col("root").alias("_is"))
    known = roots.join(over, F.col("root") == F.col("_was"), "left").select("node", F.coalesce("_is", "root").alias("root"))
    fresh = _ends(links).join(roots.select("node"), "node", "left_anti").join(over, F.col("node") == F.col("_was")).select("node", F.col("_is").alias("root"))
    return few(known.unionByName(fresh))


def linked_sets(docs: DataFrame, named: DataFrame, late: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``node, root``: components of the sets that have links; ``named`` and ``late`` are what :func:`named_and_late` says of ``docs``."""
    holders = cut_lineage(named.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("holder")))
    found = proposals(index_rows(docs, text, late))
    # a linked pair shares two lists: two short ones, which propose all pairs, or a longer one, which is looked at again
    pairs = found.where("n is null").groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(F.sum("pos").alias("lists"))
    pairs = cut_lineage(pairs.where("lists > 1").select("x", "y"))
    bitmaps = cut_lineage(bitmaps_of(docs, doc_id, text, holders, cut_lineage(_ends(pairs))))
    likely = few(_likely(_with_data(pairs, bitmaps)))

    def verified(candidates: DataFrame) -> DataFrame:
        dealt = few(bundles(candidates))
        wanted = few(dealt.select(F.explode(F.array("x", "y")).alias("node"), "bundle").distinct())
        made = _made(docs, doc_id, text, holders, wanted, whole=True)
        return few(_linked(dealt, made.join(small(wanted), "node").select("bundle", "node", "data")))

    # first each set against its smallest likely partner
    both = likely.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.*")
    picked = both.groupBy("x").agg(F.min("y").alias("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    picked = few(likely.join(picked, ["x", "y"], "left_semi"))
    links = verified(picked)
    roots = components(links)

    def between(candidates: DataFrame) -> DataFrame:
        at_x = roots.select(F.col("node").alias("x"), F.col("root").alias("rx"))
        at_y = roots.select(F.col("node").alias("y"), F.col("root").alias("ry"))
        joined = candidates.join(at_x, "x", "left").join(at_y, "y", "left")
        return few(joined.where(F.coalesce("rx", "x") != F.coalesce("ry", "y")).select("x", "y", "nx", "ny"))

    # then the other likely pairs that are not connected yet
    open_ = between(likely.join(picked, ["x", "y"], "left_anti"))
    if not open_.isEmpty():
        roots = _merged(roots, verified(open_))
    tested = few(picked.unionByName(open_).select("x", "y"))

    # and what longer lists hold besides
    lists = found.where("n is not null").select(F.col("a").alias("list"), F.col("b").alias("node"), "n", "pos")
    partners: int | None = PARTNERS
    while True:
        lists = _shared_lists(lists.select("list", "node", "n", "pos"), roots)
        if lists.isEmpty():
            return roots
        lacking = cut_lineage(lists.select("node").distinct().join(bitmaps.select("node"), "node", "left_anti"))
        if not lacking.isEmpty():
            bitmaps = cut_lineage(bitmaps.unionByName(bitmaps_of(docs, doc_id, text, holders, lacking)))
        rows = _split_lists(lists).join(bitmaps.select("node", "data"), "node")
        found_ = cut_lineage(unconnected(rows, partners))
        waiting = few(found_.where("x is null").select("list").distinct())
        far = few(found_.where("x is not null").drop("list").distinct().join(tested, ["x", "y"], "left_anti"))
        new = verified(far) if not far.isEmpty() else links.limit(0)
        if not new.isEmpty():
            roots = _merged(roots, new)
        if waiting.isEmpty():
            return roots
        lists = few(lists.join(small(waiting), "list", "left_semi"))  # of the others no pair is left
        tested = few(tested.unionByName(far.select("x", "y")))
        partners = partners if not new.isEmpty() else None  # no link among the first partners: the others decide


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    named, late = named_and_late(docs, doc_id, text)
    roots = linked_sets(docs, named, late, doc_id, text)
    at = small(roots.select(F.col("node").alias("_node"), "root"))
    rooted = named.join(at, F.col("node") == F.col("_node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "node").alias("root"))
    rooted = cut_lineage(rooted)
    full = rooted.where("n_shingles > 0")
    # only groups of two or more need to be looked up; the others are their own
    groups = cut_lineage(full.groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("root", "least"))
    return full.join(small(groups), "root", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")
    ).unionByName(rooted.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id.

    Rows without words stay, all of them.  Of repeated rows one stays.
    """
    named, late = named_and_late(docs, doc_id, text)
    roots = small(linked_sets(docs, named, late, doc_id, text).select(F.col("node").alias("_node"), "root"))
    full = named.where("n_shingles > 0").join(roots, F.col("node") == F.col("_node"), "left").select(
        "doc_id", "node", F.coalesce("root", "node").alias("root"))
    full = cut_lineage(full.groupBy("root", "doc_id", "node").agg(F.count(F.lit(1)).alias("rows")))
    # (false, id) sorts before (true, null): a row with an id is preferred
    first = full.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("first"))
    groups = cut_lineage(full.groupBy("root").agg(F.sum("rows").alias("rows")).where("rows > 1").select("root")
                         .join(first, "root").select("root", F.col("first.doc_id").alias("kept_id"), F.col("first.node").alias("kept_node")))
    hit = full.join(small(groups), "root")
    chosen = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("node") == F.col("kept_node"))
    dropped = cut_lineage(hit.where(~chosen).select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")))
    repeated = cut_lineage(hit.where(chosen & (F.col("rows") > 1)).select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")))

    kept = docs.columns
    spot = kept.index(text)
    (own,) = unused(docs, "_own_node")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([node_of(found) for found in _sets(batch.column(spot))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*kept, own])

    rows = docs.mapInArrow(name, docs.withColumn(own, F.lit(0).cast("long")).schema)
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col(own) == F.col("_node"))
    rows = rows.join(small(dropped), same, "left_anti")
    if repeated.isEmpty():
        return rows.select(*kept)
    once = rows.join(small(repeated), same, "left_semi").dropDuplicates([doc_id, own])
    return rows.join(small(repeated), same, "left_anti").unionByName(once).select(*kept)
