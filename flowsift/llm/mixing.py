"""Mixing sources to target weights.

Every source gets a share of the budget by weight, but at most ``epochs`` times
its own size; what exceeds that goes to the others by weight.  Inside a source
the documents are put in hash-random order, range-sorted over the cluster, and
cut where the running sum of sizes reaches the source's exact budget.  A budget
above the source's size repeats whole epochs first.

What leaves the sort is one row per source (its cut), so the documents are
never moved: each compares its own hash with the cut of its source.

Null sources are one source, last in order; null texts have size 0 and are
taken 0 times.  Rows with equal ids share one place in the random order; at
the cut they share what is left by size.  Empty tables give an empty result.
Reruns agree, because order and cut depend only on ids and sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.llm.text import small, unused, word_count
from flowsift.operators.ordering import dense_seq, range_sorted
from flowsift.session import cut_lineage, shuffle_partitions

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = 9
#: Sources to a task where targets are worked out.
ROWS_PER_TASK = 100_000


def random_key(doc_id: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Sums over the earlier rows of the same key, in ``order``, with any number of tasks for a key.

    Rows are range-sorted by key and order.  Inside a sorted partition the sums
    are a window; what a key brings from earlier partitions is one row per
    key and partition.  ``sums`` maps new names to columns.
    """
    placed = range_sorted(df, [*keys, *order], partitions)
    parts = placed.groupBy("_pid", *keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_pid", *keys, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{n}") for n, c in sums.items()])
    joined = local.join(carried, ["_pid", *keys])
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``source_key, source_size`` to those and ``target``: the fair share by weight under caps.

    In order of cap per weight the sources that reach their cap come first.  The
    level of the first one that does not is what all the others get per weight.
    """
    n = max(1, min(shuffle_partitions(sizes.sparkSession), sizes.count() // ROWS_PER_TASK))
    ranked = dense_seq(sizes, ["source_key"], out="rank", partitions=n)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    capped = ranked.select(
        "source_key", "source_size", weight.cast("long").alias("weight"), (epochs * F.col("source_size")).alias("cap")
    ).withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("one", F.lit(0))
    before = cut_lineage(prefix_sums(capped, ["one"], ["ratio", "source_key"], {"caps": "cap", "weights": "weight"}, n))
    total = before.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left, unserved = F.lit(share * (total["size"] or 0)) - F.col("caps"), F.lit(total["weight"] or 0) - F.col("weights")
    leveled = before.withColumn("level", left / unserved)
    free = leveled.where(F.col("cap") > F.col("level") * F.col("weight"))
    level = free.agg(F.min_by("level", F.struct("ratio", "source_key"))).first()[0]
    fair = F.lit(level).cast("double") * F.col("weight")
    return leveled.select(
        "source_key", "source_size",
        F.when(fair < F.col("cap"), fair).otherwise(F.col("cap").cast("double")).alias("target"),
    )


def cuts(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: Column | None = None,
         weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per source: ``source_key, source_size, target, whole, cut, rest, at_cut``.

    A document is taken ``whole`` times, once more if its key is below ``cut``;
    rows at the cut share ``rest`` words of their ``at_cut``.
    """
    size = word_count(F.col("text")) if size is None else size
    sized = cut_lineage(
        docs.select(source_key(F.col(source)).alias("source_key"), random_key(F.col(doc_id), seed).alias("key"), size.alias("size"))
        .groupBy("source_key", "key").agg(F.sum("size").alias("size"))
    )
    sources = cut_lineage(sized.groupBy("source_key").agg(F.sum("size").alias("source_size")))
    planned = targets(sources, weights, share, epochs)
    budget = F.least(F.floor(F.col("target") + 0.5), epochs * F.col("source_size"))
    planned = planned.withColumn("budget", budget).withColumns({
        "whole": F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0),
    }).withColumn("rest", F.col("budget") - F.col("whole") * F.col("source_size"))
    planned = cut_lineage(planned)
    placed = prefix_sums(sized, ["source_key"], ["key"], {"before": "size"})
    at = placed.join(small(planned.select("source_key", "rest")), "source_key").where(
        (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size"))
    ).select("source_key", F.col("key").alias("cut"), (F.col("rest") - F.col("before")).alias("left"), F.col("size").alias("at_cut"))
    return cut_lineage(planned.join(at, "source_key", "left").select(
        "source_key", "source_size", "target", "whole", "cut", F.coalesce("left", F.lit(0)).alias("rest"), "at_cut"
    ))


def source_key(source: Column) -> Column:
    """Sorts by code point with null last; null stays apart from every string."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: Column | None = None, seed: int = SEED,
        names: Sequence[str] = ("size", "source_size", "target", "taken"), **plan: object) -> DataFrame:
    """``docs`` with four columns more, called ``names``; clashing columns of ``docs`` are replaced."""
    size = word_count(F.col("text")) if size is None else size
    cut = cuts(docs, doc_id, source, size, seed=seed, **plan)
    key, at, place, own = unused(docs, "_source_key", "_cut", "_key", "_size")
    kept = docs.drop(*names)
    sized = docs.select(*kept.columns, size.alias(own), source_key(F.col(source)).alias(key), random_key(F.col(doc_id), seed).alias(place))
    packed = cut.select(F.col("source_key").alias(key), F.struct("source_size", "target", "whole", "cut", "rest", "at_cut").alias(at))
    c = F.col(at)
    part = F.when(F.col(place) < c["cut"], F.col(own)).when(
        F.col(place) == c["cut"], F.floor(F.col(own) * c["rest"] / c["at_cut"])
    ).otherwise(0)
    taken = (c["whole"] * F.col(own) + part).cast("long")
    values = [F.col(own), c["source_size"], c["target"], taken]
    return sized.join(small(packed), key).select(*kept.columns, *[v.alias(n) for v, n in zip(values, names)])


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs`` (``doc_id, text, source`` among them); texts come whole.

    A document comes once per whole epoch.  The one at a source's cut comes once
    more if at least half of its words are inside the budget, so a source is off
    its target by at most half a document (where ids repeat, half of each row at
    the cut).  Texts without words are not taken.
    """
    size, total, target, taken = unused(docs, "_size", "_total", "_target", "_taken")
    planned = mix(docs, seed=seed, names=(size, total, target, taken)).where(F.col(size) > 0)
    copies = F.floor((2 * F.col(taken) + F.col(size)) / (2 * F.col(size))).cast("int")
    return planned.withColumn(taken, F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)
