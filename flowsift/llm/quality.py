"""Quality rules as a short-circuit cascade.

A rule is a condition over measures of the text that is true where a document
fails.  Measures are taken of the text, of its words or of its lines.  On a
sample the costs of words, lines and measures and the rejections of each rule
are measured.  The cascade asks next the rule that rejects most of the documents
still there for what it costs *now*: words, lines and measures that an earlier
rule has worked out are bound and cost nothing more.  A later rule, and what only
it needs, is evaluated only for documents that passed the earlier ones.  The
order changes the work, never the verdict.

Nulls, empty texts and texts of white space have no words and fail
``few_words``.  Repeated rows are judged alike; other columns pass through.
An empty table gives an empty result and the rules in the given order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from statistics import median

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.llm.text import let, unused, words
from flowsift.session import cut_lineage

Measure = Callable[[Column], Column]

#: Words in a window, and the rows that cost and selectivity are measured on.
WINDOW = 8
SAMPLE_ROWS = 2000
#: Times that a cost is measured; the median counts.
RUNS = 3


def _matches(text: Column, pattern: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _lines(text: Column) -> Column:
    # a line with a word is one from which trimming leaves something
    blank = F.lit(" \t\n\x0b\x0c\r")
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.length(F.btrim(line, blank)) > 0)


def repeat_words(own: Column, width: int = WINDOW) -> Column:
    """Words of the array ``own`` inside windows of ``width`` words that occur at least twice in the text.

    Windows are compared by 64-bit hashes within one document.  Texts without
    a repeated window stop after one hash set; the others sort their windows,
    so a long text costs n log n, not n squared.
    """

    def covered(starts: Column) -> Column:
        # each start covers up to the next one; the last covers a whole window
        spans = F.transform(starts, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1) - p, F.lit(width))))
        return F.aggregate(spans, F.lit(0), lambda a, b: a + b)

    def repeated(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))

        def starts(s: Column) -> Column:
            twice = F.filter(
                F.transform(s, lambda x, k: F.when(
                    (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["p"]
                )),
                lambda p: p.isNotNull(),
            )
            return let(F.sort_array(twice), covered)

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, starts)).otherwise(0)

    def windows(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
        return F.when(F.size(w) > width, let(hashed, repeated)).otherwise(0)

    return let(F.transform(own, lambda w: F.xxhash64(w)), windows)


#: What measures are taken of.
PARTS: dict[str, Measure] = {"text": lambda text: text, "words": words, "lines": _lines}

#: The measures a rule may use, each of a part of the text.  Those of the base verdict come first.
MEASURES: dict[str, tuple[str, Measure]] = {
    "n_words": ("words", F.size), "word_chars": ("words", lambda w: F.length(F.array_join(w, ""))),
    "n_symbols": ("text", lambda text: _matches(text, "[#*$%&|<>]")),
    "n_dup_lines": ("lines", lambda x: F.size(x) - F.size(F.array_distinct(x))), "n_repeat_words": ("words", repeat_words),
    "n_lines": ("lines", F.size), "n_upper": ("text", lambda text: _matches(text, "\\p{Lu}")),
}


def measures(text: Column, names: Sequence[str]) -> Column:
    """Struct of the named measures; the parts that several of them need are made once."""
    parts = list(dict.fromkeys(MEASURES[m][0] for m in names))
    made = F.struct(*[PARTS[p](text).alias(p) for p in parts])
    return let(made, lambda v: F.struct(*[MEASURES[m][1](v[MEASURES[m][0]]).cast("long").alias(m) for m in names]))


def measures_of(rule: str) -> list[str]:
    return [m for m in MEASURES if m in rule.replace("(", " ").replace(")", " ").split()]


#: Rule name: condition over the measures under which a document fails.  The first two are the base verdict.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "upper_case": "2 * n_upper > word_chars",
    "repeated_lines": "10 * n_dup_lines > 4 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}


def failing(rule: str, measured: Mapping[str, Column]) -> Column:
    """The condition ``rule`` with its measures replaced by the given columns."""
    values = F.struct(*[measured[m].alias(m) for m in measures_of(rule)])
    parts = [part.split() for part in rule.split(" or ")]

    def term(tokens: list[str], v: Column) -> Column:
        factor, rest = F.lit(1), list(tokens)
        if rest[1:2] == ["*"]:
            factor, rest = F.lit(int(rest[0])), rest[2:]
        return factor * (v[rest[0]] if rest[0] in MEASURES else F.lit(int(rest[0])))

    def judge(v: Column) -> Column:
        out = F.lit(False)
        for part in parts:
            at = next(i for i, token in enumerate(part) if token in "<>")
            left, right = term(part[:at], v), term(part[at + 1:], v)
            out = out | ((left < right) if part[at] == "<" else (left > right))
        return out

    return let(values, judge)


def _seconds(sample: DataFrame, value: Column) -> float:
    """Median time of evaluating ``value`` for the whole sample."""
    job, took = sample.agg(F.count(value)), []
    for _ in range(RUNS):
        began = time.perf_counter()
        job.collect()
        took.append(time.perf_counter() - began)
    return median(took)


def costs(sample: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Seconds for the named measures and their parts on the sample, without the time that any job takes."""
    text = F.col(sample.columns[0])
    idle = _seconds(sample, text)
    of_part = {p: max(_seconds(sample, PARTS[p](text)) - idle, 0.0) if p != "text" else 0.0 for p in dict.fromkeys(MEASURES[m][0] for m in names)}
    of_measure = {m: max(_seconds(sample, measures(text, [m])) - idle - of_part[MEASURES[m][0]], 1e-6) for m in names}
    return of_part | of_measure


def greedy_order(failed: np.ndarray, rules: Mapping[str, str], cost: Mapping[str, float]) -> list[str]:
    """Rules by rejections per cost, both given the rules before.  ``failed`` has a row for each document, a column for each rule."""
    left, bound, order, at = np.ones(len(failed), dtype=bool), set(), [], {name: i for i, name in enumerate(rules)}

    def needed(name: str) -> set[str]:
        own = measures_of(rules[name])
        return {*own, *(MEASURES[m][0] for m in own)} - bound

    while len(order) < len(at):
        open_ = [name for name in rules if name not in order]
        gain = {name: failed[left, at[name]].sum() / max(sum(cost[x] for x in needed(name)), 1e-6) for name in open_}
        best = max(open_, key=lambda name: gain[name])
        order.append(best)
        bound |= needed(best)
        left &= ~failed[:, at[best]]
    return order


def measured_order(docs: DataFrame, text: str = "text", rules: Mapping[str, str] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names in the order of the cascade, by a sample of about ``sample_rows`` rows."""
    n = docs.select(F.count(F.lit(1))).first()[0]
    if n == 0:
        return list(rules)
    sample = cut_lineage(docs.select(F.col(text).alias("text")).sample(min(1.0, sample_rows / n), seed=4).coalesce(4))
    used = [m for m in MEASURES if any(m in measures_of(rule) for rule in rules.values())]
    taken = sample.select(measures(F.col("text"), used).alias("m"))
    rows = taken.select(*[failing(rule, {m: F.col("m")[m] for m in used}).alias(name) for name, rule in rules.items()]).collect()
    return greedy_order(np.array(rows, dtype=bool).reshape(-1, len(rules)), rules, costs(sample, used))


def cascade(docs: DataFrame, text: str = "text", rules: Mapping[str, str] = RULES, order: list[str] | None = None,
            measured: Mapping[str, Column] | None = None, out: str = "failed_rule") -> DataFrame:
    """Add ``out``: the first rule in cascade order that a document fails, null if it passes all.

    ``measured`` may name columns that already hold a measure.
    """

    def judge(names: list[str], parts: dict[str, Column], known: dict[str, Column]) -> Column:
        if not names:
            return F.lit(None).cast("string")
        wanted = [m for m in measures_of(rules[names[0]]) if m not in known]
        missing = [p for p in dict.fromkeys(MEASURES[m][0] for m in wanted) if p not in parts]
        if missing:  # made here, bound for all later rules
            made = F.struct(*[PARTS[p](parts["text"]).alias(p) for p in missing])
            return let(made, lambda v: judge(names, parts | {p: v[p] for p in missing}, known))
        if wanted:
            taken = F.struct(*[MEASURES[m][1](parts[MEASURES[m][0]]).alias(m) for m in wanted])
            return let(taken, lambda v: judge(names, parts, known | {m: v[m] for m in wanted}))
        # CASE evaluates a branch only if the earlier ones did not hold
        return F.when(failing(rules[names[0]], known), names[0]).otherwise(judge(names[1:], parts, known))

    order = order or measured_order(docs, text, rules)
    return docs.withColumn(out, judge(order, {"text": F.col(text)}, dict(measured or {})))


def passing(docs: DataFrame, text: str = "text", rules: Mapping[str, str] = RULES) -> DataFrame:
    """The documents that pass every rule, with their columns as they are."""
    (out,) = unused(docs, "failed_rule")
    return cascade(docs, text, rules, out=out).where(F.col(out).isNull()).drop(out)


def report(docs: DataFrame) -> DataFrame:
    """The base measures, the base verdict and the cascade's verdict for each document (``doc_id``, ``text``)."""
    order = measured_order(docs)
    base = [m for m in MEASURES if m not in ("n_lines", "n_upper")]
    counted = docs.select("doc_id", "text", measures(F.col("text"), [*base, "n_lines"]).alias("m"))
    known = {m: F.col("m")[m] for m in [*base, "n_lines"]}
    judged = cascade(counted, order=order, measured=known)
    base_failed = failing(RULES["few_words"], known) | failing(RULES["repeated_words"], known)
    return judged.select("doc_id", *[known[m].alias(m) for m in base], base_failed.alias("base_failed"), F.col("failed_rule").isNull().alias("kept"))
