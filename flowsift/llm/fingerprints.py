"""Document fingerprints by consistent weighted sampling.

A text is a set of words weighted by their counts.  Sample k draws, for every
word, r and c from Gamma(2, 1) and b from U(0, 1), all functions of the word and
k only.  With t = floor(ln(weight) / r + b) the word's value is
ln c - r (t - b) - r; the sample is the smallest value of all words.  Two texts
have the same smallest value if and only if they drew the same (word, t), and
that happens with the probability of their generalised Jaccard similarity
sum(min(weights)) / sum(max(weights)).  The share of equal samples estimates it.

A Gamma(2, 1) variate cut at a uniform place gives two independent exponentials,
so r (1 - b) = -ln u and r b = -ln v are drawn instead of r and b.  The value's
exponential is then c u exp(-r t), and t = 0 just where u weight < 1: most words
need one logarithm, not three.  A text and its edited form share what they draw
for a word; only the weights differ.

Null texts are empty.  Texts without words share one fingerprint and are alike
to each other only.  Repeated rows have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.llm.text import let, words
from flowsift.operators.ordering import range_sorted

SAMPLES = 64
#: Samples that one row of a term draws: more make one method of generated code too large to be compiled well.
LANE = 8
#: Consecutive ids in a block, and blocks at most where ids are dense.
BLOCK_IDS = 256
BLOCKS = 100_000


#: Factor that takes the value of an absent word beyond all others.
_ABSENT = 1e300


def weighted_terms(text: Column, other: Column | None = None) -> Column:
    """Array of (term, n, m): 63-bit word hashes with their counts in ``text`` and in ``other``; null for no words."""

    def hashed(value: Column, tag: int) -> Column:
        return F.transform(words(F.lower(value)), lambda w: F.xxhash64(w).bitwiseAND(-2).bitwiseOR(tag))

    def counts(run: Column, runs: Column, j: Column) -> Column:
        # a term's run in the text comes right before its run in the other one
        after = F.get(runs, j + 1)
        own = run["id"].bitwiseAND(1) == 0
        both = own & (after["id"] == run["id"].bitwiseOR(1))
        return F.struct(
            run["id"].bitwiseAND(-2).alias("term"), F.when(own, run["n"]).otherwise(0).alias("n"),
            F.when(~own, run["n"]).when(both, after["n"]).otherwise(0).alias("m"),
            (~own & (F.get(runs, j - 1)["id"] == run["id"].bitwiseAND(-2))).alias("counted"))

    def joined(runs: Column) -> Column:
        return F.filter(F.transform(runs, lambda run, j: counts(run, runs, j)), lambda t: ~F.coalesce(t["counted"], F.lit(False)))

    def terms(ids: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ids) - 1), lambda i: (i == 0) | (F.get(ids, i) != F.get(ids, i - 1)))
        runs = let(starts, lambda s: F.transform(s, lambda at, j: F.struct(
            F.get(ids, at).alias("id"), (F.coalesce(F.get(s, j + 1), F.size(ids)) - at).alias("n"))))
        return let(runs, joined)

    ids = hashed(text, 0) if other is None else F.concat(hashed(text, 0), hashed(other, 1))
    return let(F.sort_array(ids), lambda s: F.when(F.size(s) > 0, terms(s)))


def samples(term: Column, weights: Sequence[Column], count: int = SAMPLES) -> list[list[Column]]:
    """For each weight, the exponentials of the smallest values over a group of rows, one column per sample."""
    low, scale = 0x3FFFFFFF, 2.0 ** -30

    def two_uniforms(bits: Column) -> tuple[Column, Column]:
        return (bits.bitwiseAND(low) + 0.5) * scale, (F.shiftrightunsigned(bits, 34) + 0.5) * scale

    out: list[list[Column]] = [[] for _ in weights]
    for k in range(count):
        (u, v), (x, y) = (two_uniforms(F.xxhash64(term, F.lit(2 * k + i))) for i in (0, 1))
        at_once = -F.ln(x * y) * u  # c u: the value of a word with t = 0
        r = -F.ln(u * v)
        for weight, own in zip(weights, out):
            steps = F.floor((F.ln(weight) - F.ln(v)) / r)  # ln(weight) / r + b
            factor = F.when(weight <= 0, _ABSENT).when(u * weight < 1, 1.0).otherwise(F.exp(-r * steps))
            own.append(F.min(at_once * factor))
    return out


def signature(values: Sequence[Column]) -> Column:
    """Array of 16-bit digests of the samples; texts without words get a constant."""
    return F.array(*[F.when(v < _ABSENT / 1e50, F.xxhash64(v).bitwiseAND(0xFFFF)).otherwise(0).cast("int") for v in values])


def likeness(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.size(a)


def hexadecimal(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def fingerprints(docs: DataFrame, keys: Sequence[str], text: str = "text", other: str | None = None, count: int = SAMPLES,
                 out: Sequence[str] = ("signature", "other_signature")) -> DataFrame:
    """``keys`` and the signature of each group's texts, and of its ``other`` texts; rows with equal keys are one bag of words.

    If the input is already partitioned by some of ``keys`` nothing is shuffled.
    """
    found = weighted_terms(F.col(text), None if other is None else F.col(other))
    lane, lanes = LANE if count % LANE == 0 else count, count // LANE if count % LANE == 0 else 1
    numbers = F.array(*[F.lit(i) for i in range(lanes)])
    terms = docs.select(*keys, F.explode_outer(found).alias("_t")).select(*keys, "_t.*", F.explode(numbers).alias("lane"))
    terms = terms.withColumn("seed", F.when(F.col("term").isNotNull(), F.xxhash64("term", "lane")))
    kinds = ["n"] if other is None else ["n", "m"]
    drawn = samples(F.col("seed"), [F.col(k).cast("double") for k in kinds], lane)
    names = [[f"_{kind}{k}" for k in range(lane)] for kind in kinds]
    mins = terms.groupBy(*keys, "lane").agg(*[s.alias(n) for of, own in zip(drawn, names) for s, n in zip(of, own)])
    parts = mins.select(*keys, F.struct("lane", *[signature([F.col(n) for n in own]).alias(o) for own, o in zip(names, out)]).alias("_p"))
    whole = parts.groupBy(*keys).agg(F.sort_array(F.collect_list("_p")).alias("_p"))  # as many as there are lanes
    return whole.select(*keys, *[F.flatten(F.col(f"_p.{o}")).alias(o) for o, _ in zip(out, kinds)])


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text with the one of the next id, the last with the first: ``block, spread, pos, own, doc_id, text, next_text``.

    Ids are cut into blocks of consecutive numbers.  The first row of a block
    is copied to the end of the block before it, so a window per block sees all
    it needs, and the texts are shuffled once.  Which block follows which is
    worked out on one row per block.  Rows with equal ids are ordered by text.
    Rows without an id follow no order; their next text is empty.
    The result keeps the copies (``own`` false) and is partitioned by
    (``block``, ``spread``).
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = docs.select(F.count(F.lit(1))).first()[0]
    width = max(BLOCK_IDS, n // BLOCKS)
    block = F.floor(F.col("doc_id") / F.lit(width)) if width > 1 else F.col("doc_id")
    heads = base.where("doc_id is not null").groupBy(block.alias("block")).agg(F.min("doc_id").alias("head"))
    placed = range_sorted(heads, ["block"])
    firsts = {r["_pid"]: r["head"] for r in placed.groupBy("_pid").agg(F.min_by("head", "block").alias("head")).collect()}
    after, coming = [None] * (max(firsts, default=-1) + 1), firsts.get(min(firsts, default=0))
    for pid in sorted(firsts, reverse=True):  # one number per partition; the last is followed by the first
        after[pid], coming = coming, firsts[pid]
    inside = Window.partitionBy("_pid").orderBy("block")
    beyond = F.get(F.array(*[F.lit(x).cast("long") for x in after]), F.col("_pid")) if after else F.lit(None).cast("long")
    follow = placed.select(F.col("block").alias("_before"), F.coalesce(F.lead("head").over(inside), beyond).alias("_head"))
    if placed.count() <= 2 * BLOCKS:  # always so where ids are dense
        follow = F.broadcast(follow)
    copies = base.join(follow, base["doc_id"] == F.col("_head")).select(
        F.col("_before").alias("block"), F.lit(0).cast("long").alias("spread"), F.lit(False).alias("own"), "doc_id", "text")
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    own = base.select(block.alias("block"), spread.alias("spread"), F.lit(True).alias("own"), "doc_id", "text")
    order = Window.partitionBy("block", "spread").orderBy(F.desc("own"), "doc_id", "text")
    return own.unionByName(copies).select(
        "block", "spread", F.row_number().over(order).alias("pos"), "own", "doc_id", "text",
        F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order)).alias("next_text"),
    )


def compared(docs: DataFrame, count: int = SAMPLES) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike they and the next document's are.

    The edited text has its last half of the code points (rounded down)
    replaced by as many first code points of the next document.
    """
    rows = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half),
                      F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    place, facts = ["block", "spread", "pos"], ["own", "doc_id", "n_chars", "edited_sha256"]
    both = rows.withColumn("edited", F.when(F.col("own"), edited)).select(
        *place, "own", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    drawn = fingerprints(both, [*place, *facts], other="edited", count=count, out=("signature", "edited"))
    along = Window.partitionBy("block", "spread").orderBy("pos")
    joined = drawn.select("*", F.lead("signature").over(along).alias("next"))
    near_next = F.when(F.col("doc_id").isNotNull(), F.coalesce(likeness(F.col("signature"), F.col("next")), F.lit(0.0))).otherwise(0.0)
    return joined.where("own").select(
        "doc_id", "n_chars", "edited_sha256", hexadecimal(F.col("signature")).alias("fingerprint"),
        hexadecimal(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited")).alias("near_edited"), near_next.alias("near_next"),
    )
