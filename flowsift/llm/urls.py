"""URL filter: longest matching rule, else segmented words and naive Bayes.

Host labels and path parts are names.  A name is cut into words by unigram
Viterbi: of all ways to cut it the one with the likeliest words, by their
counts in the text of all pages, without tags, addresses and the labels of the
page's own host, which would make a run-together name a word.  Seeds count as
known words.  Every distinct name is cut once; its substrings meet the counts in
a join, so no word list is shipped around.

Multinomial naive Bayes then scores the words.  It learns from all distinct
addresses: those with a word of ``SEEDS`` are examples to block, the others
examples to allow, so words that come along with the seeds count too.

Null addresses and those without ``://`` have empty host and path, no words
and the verdict allow.  Repeated rows get equal verdicts; names of any length
are cut.  Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.llm.text import let, small
from flowsift.session import cut_lineage

#: Rules (host and path) with their verdicts.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words that mark an address as an example to block.
SEEDS = ("bets", "betting", "casino", "gambling", "pills", "porn", "spam", "viagra")
LONGEST_WORD = 24
#: A seed counts as this share of all words at least, so that it can be cut out of a name.
SEED_SHARE = 1e-5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, _UPPER, _UPPER.lower()), path


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def names(host: Column, path: Column) -> Column:
    """Letters-only parts of host and path; numbers count as one word."""
    parts = F.split(F.lower(F.concat_ws("/", host, path)), "[^\\p{L}\\p{N}]+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "\\p{N}+", "0")), lambda p: p != "")


def word_counts(texts: DataFrame, text: str, url: str | None = None) -> DataFrame:
    """``word, n`` over all texts, for words that a name could hold; tags, addresses and names of a row's own host do not count."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "<[^<>]*>", " ")
    plain = F.regexp_replace(plain, "[\\p{L}\\p{N}_-]++(?:\\.[\\p{L}\\p{N}_-]++)+", " ")
    own = F.split(plain, "[^\\p{L}]+")
    if url is not None:
        labels = F.split(F.coalesce(host_and_path(F.col(url))[0], F.lit("")), "[.:@]")
        own = let(labels, lambda names: F.filter(own, lambda w: ~F.array_contains(names, w)))
    tokens = texts.select(F.explode(own).alias("word"))
    return tokens.where(F.length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def with_seeds(counts: DataFrame, seeds: Sequence[str]) -> DataFrame:
    """``counts`` with every seed counted ``SEED_SHARE`` of all words at least."""
    counts = cut_lineage(counts)
    least = max(1, math.ceil(SEED_SHARE * (counts.agg(F.sum("n")).first()[0] or 0)))
    known = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in seeds]).cast("array<string>")).alias("word"), F.lit(least).cast("long").alias("n"))
    return counts.unionByName(known).groupBy("word").agg(F.max("n").alias("n"))


def segmented(distinct_names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name`` to ``words``, the likeliest cut of each name (one row per name)."""
    counts = cut_lineage(counts)
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    # a long name is not carried along with its substrings: its hash is
    keyed = distinct_names.withColumn("_id", F.xxhash64("name"))
    starts = let(F.split(F.col("name"), ""), lambda letters: F.transform(F.sequence(F.lit(0), F.length("name") - 1), lambda i: F.struct(
        i.alias("i"), F.array_join(F.slice(letters, i + 1, F.lit(LONGEST_WORD)), "").alias("piece"))))
    pieces = keyed.where(F.length("name") >= 2).select("_id", F.explode(starts).alias("s"))
    parts = pieces.select("_id", "s", F.explode(F.sequence(F.lit(1), F.length("s.piece"))).alias("n_letters")).select(
        "_id", F.col("s.i").alias("i"), (F.col("s.i") + F.col("n_letters")).alias("j"),
        F.substring(F.col("s.piece"), F.lit(1), F.col("n_letters")).alias("word"))
    met = parts.join(counts, "word").groupBy("_id").agg(F.collect_list(F.struct("i", "j", "n")).alias("known"))

    @F.pandas_udf("array<string>")
    def cut(name: pd.Series, known: pd.Series) -> pd.Series:
        def best_cut(word: str, spans) -> list[str]:
            seen = {(s["i"], s["j"]): s["n"] for s in (spans if spans is not None else [])}
            best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
            for j in range(1, len(word) + 1):
                for i in range(max(0, j - LONGEST_WORD), j):
                    count = seen.get((i, j))
                    # an unknown word is the less likely the longer it is
                    gain = math.log(count / total) if count else -math.log(total) - 2.5 * (j - i)
                    if best[i][0] + gain > best[j][0]:
                        best[j] = (best[i][0] + gain, i)
            out, j, before = [], len(word), True
            while j > 0:
                i = best[j][1]
                known = (i, j) in seen
                if known or before:
                    out.append([i, j])
                else:  # unknown parts side by side are one
                    out[-1][0] = i
                j, before = i, known
            return [word[a:b] for a, b in out[::-1]]

        return pd.Series([[w] if len(w) < 2 else best_cut(w, k) for w, k in zip(name, known)])

    return keyed.join(met, "_id", "left").select("name", cut("name", "known").alias("words"))


def judged(pages: DataFrame, url: str = "url", texts: tuple[DataFrame, str] | None = None,
           rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, words, score``; clashing columns are replaced."""
    out = ("host", "path", "rule", "verdict", "words", "score")
    host, path = host_and_path(F.col(url))
    kept = pages.drop(*[c for c in out if c != url]).columns
    parsed = pages.select(*kept, host.alias("host"), path.alias("path"))
    addresses = cut_lineage(parsed.select("host", "path").distinct())
    parts = addresses.select("host", "path", F.posexplode(names(F.col("host"), F.col("path"))).alias("at", "name"))
    frame, column = texts or (pages, "html")
    counts = with_seeds(word_counts(frame, column, None if texts else url), seeds)
    cuts = cut_lineage(segmented(parts.select("name").distinct(), counts))
    worded = parts.join(small(cuts), "name").groupBy("host", "path").agg(
        F.sort_array(F.collect_list(F.struct("at", "words"))).alias("cuts")
    ).select("host", "path", F.flatten(F.transform("cuts", lambda c: c["words"])).alias("words"))
    worded = cut_lineage(worded.withColumn("bad", F.arrays_overlap("words", F.array(*[F.lit(s) for s in seeds]))))

    counted = cut_lineage(worded.select("bad", F.explode("words").alias("word")).groupBy("word").agg(
        F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")))
    totals = counted.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")).first()
    prior = worded.agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).first()
    ratio = (F.ln((F.col("bad") + 1.0) / F.lit(float((totals["bad"] or 0) + totals["n"] + 1)))
             - F.ln((F.col("good") + 1.0) / F.lit(float((totals["good"] or 0) + totals["n"] + 1))))
    base = math.log((prior["bad"] + 1.0) / (prior["good"] + 1.0))
    scores = worded.select("host", "path", "words", F.explode("words").alias("word")).join(
        small(counted.select("word", ratio.alias("ratio"))), "word"
    ).groupBy("host", "path", "words").agg((F.sum("ratio") + base).alias("score"))
    at = let(matching_rule(F.col("host"), F.col("path"), rules), lambda r: r)
    return parsed.join(small(scores), ["host", "path"], "left").withColumn("_rule", at).select(
        *kept, "host", "path", F.col("_rule")["rule"].alias("rule"),
        F.coalesce(F.col("_rule")["verdict"], F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("words", F.array().cast("array<string>")).alias("words"), F.coalesce("score", F.lit(base)).alias("score"),
    )
