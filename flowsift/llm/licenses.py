"""License scan with a positional index of rare words.

Every template (a notice of a known license, or a plain phrase) is a list of
words.  Document frequencies of all template words are counted over the whole
corpus.  The index keeps, for each template, the positions of its rarest words.
A text looks up those words; a word at position p that the template has at
position o proposes the start p - o.  The starts that both words propose are
verified; one counts if every word of the template's key phrases stands at its place relative to the start; its score is
the share of the template, weighted by inverse document frequency, that does.

As a hit needs every key word, the rarest key words of a template are those of
any file that holds it.  A plain phrase is its own key phrase, so all its places are found: each holds
the phrase's rarest word.  Null and empty texts have no words and no hits.
Repeated rows give equal results.  Very long texts cost one pass plus work per
hit.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.llm.text import let, unused, words

#: What separates words: ASCII except digits and letters.
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


#: Phrases that are reported wherever they stand.
BASE = (
    Template("cc-by", "cc by", ("cc by",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("reserved", "all rights reserved", ("all rights reserved",), True),
)

#: First words of public license notices and their short forms, with the phrases that must be there.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use in source and binary forms",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc0-1.0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             ("permission to use copy modify", "for any purpose")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             ("permission is hereby granted free of charge", "obtaining a copy")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
             ("mozilla public license v 2 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software", "released into the public domain")),
    *(Template(label, phrase, (phrase,)) for label, phrase in (
        ("apache-2.0", "apache license 2 0"), ("apache-2.0", "apache 2 0 license"),
        ("bsd", "bsd license"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"),
        ("cc-by-4.0", "creative commons attribution 4 0"),
        ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0"),
        ("cc-by-nc-4.0", "creative commons attribution non commercial 4 0"),
        ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0"),
        ("cc-by-sa-4.0", "creative commons attribution share alike 4 0"),
        ("cc0-1.0", "creative commons zero"),
        ("gpl-2.0", "gnu general public license as published by the free software foundation either version 2"),
        ("gpl-2.0", "gnu general public license as published by the free software foundation version 2"),
        ("gpl-3.0", "gnu general public license as published by the free software foundation either version 3"),
        ("gpl-3.0", "gnu general public license as published by the free software foundation version 3"),
        ("isc", "isc license"), ("mit", "mit license"), ("mit", "mit licence"),
        ("mpl-2.0", "mozilla public license version 2 0"),
    )),
)

#: Words of a template that the index holds.
RARE = 2


def _key_places(template: Template) -> list[tuple[int, str]]:
    """Position and word of every word of the key phrases."""
    own, out = template.text.split(), {}
    for phrase in template.keys:
        want = phrase.split()
        at = next(i for i in range(len(own)) if own[i:i + len(want)] == want)
        out |= {at + i: w for i, w in enumerate(want)}
    return sorted(out.items())


def word_rarity(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, float]:
    """Inverse document frequency of the given words over all documents; what is collected has their number."""
    own = F.array_distinct(words(F.lower(F.col(text)), SEPARATOR))
    found = F.array_intersect(own, F.array(*[F.lit(w) for w in vocabulary]))
    counts = docs.select(F.explode(F.concat(found, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    n = {r["word"]: r["count"] for r in counts.collect()}
    return {w: math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) + 1.0 for w in vocabulary}


def _entry(template: Template, rarity: dict[str, float]) -> Column:
    own = template.text.split()
    total = sum(rarity[w] for w in own)
    return F.struct(
        F.lit(template.label).alias("label"), F.lit(template.base).alias("base"),
        F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in _key_places(template)]).alias("keys"),
        F.array(*[
            F.struct(F.lit(o).alias("o"), F.lit(w).alias("w"), F.lit(rarity[w] / total).alias("share")) for o, w in enumerate(own)
        ]).alias("all"),
    )


def scan(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = BASE + NOTICES,
         words_out: str = "n_words", hits_out: str = "hits") -> DataFrame:
    """``docs`` with the number of words and ``hits``, an array of (label, base, start, score); clashing columns are replaced."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    rarity = word_rarity(docs, vocabulary, text)
    postings = []
    for number, template in enumerate(templates):
        places = _key_places(template)  # a rare word must be one that verification asks for
        rarest = sorted({w for _, w in places}, key=lambda w: (-rarity[w], w))[:RARE]
        for first, word in ((True, rarest[0]), (False, rarest[-1])):  # a key of one word has one posting
            postings += [(word, number, o, first) for o, w in places if w == word]
    rare = sorted({posting[0] for posting in postings})
    index = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), F.lit(o).alias("o"), F.lit(f).alias("first")) for w, t, o, f in postings])
    rare_words = F.array(*[F.lit(w) for w in rare])
    known = F.array(*[_entry(t, rarity) for t in templates])

    def found(own: Column) -> Column:
        def proposals(i: Column) -> Column:
            fitting = F.filter(index, lambda p: p["w"] == F.get(own, i))
            return F.transform(fitting, lambda p: F.struct(p["first"].alias("first"), F.struct(p["t"].alias("t"), (i - p["o"]).alias("start")).alias("at")))

        def verify(p: Column) -> Column:
            entry = F.get(known, p["t"])

            def hit(e: Column) -> Column:
                score = F.aggregate(e["all"], F.lit(0.0), lambda s, x: s + F.when(
                    F.get(own, p["start"] + x["o"]) == x["w"], x["share"]).otherwise(0.0))
                whole = F.forall(e["keys"], lambda k: F.coalesce(F.get(own, p["start"] + k["o"]) == k["w"], F.lit(False)))
                return F.when(whole, F.struct(e["label"].alias("label"), e["base"].alias("base"),
                                              p["start"].cast("long").alias("start"), F.least(score, F.lit(1.0)).alias("score")))

            return let(entry, hit)

        at = F.filter(F.transform(own, lambda w, i: F.when(F.array_contains(rare_words, w), i)), lambda i: i.isNotNull())

        def common(all_proposed: Column) -> Column:
            by_first = F.transform(F.filter(all_proposed, lambda p: p["first"]), lambda p: p["at"])
            return F.array_intersect(by_first, F.transform(F.filter(all_proposed, lambda p: ~p["first"]), lambda p: p["at"]))

        return F.filter(F.transform(let(F.flatten(F.transform(at, proposals)), common), verify), lambda h: h.isNotNull())

    (seen,) = unused(docs.drop(words_out, hits_out), "_seen")
    kept = docs.drop(words_out, hits_out).columns
    looked = docs.select(*kept, let(words(F.lower(F.col(text)), SEPARATOR), lambda own: F.struct(
        F.size(own).cast("long").alias("n"), F.arrays_overlap(own, rare_words).alias("any"))).alias(seen))
    exact = let(words(F.translate(F.col(text), _UPPER, _UPPER.lower()), SEPARATOR), found)
    none = F.filter(F.array(F.struct(F.lit("").alias("label"), F.lit(True).alias("base"), F.lit(0).cast("long").alias("start"),
                                     F.lit(0.0).alias("score"))), lambda _: F.lit(False))
    hits = F.when(F.coalesce(F.col(seen)["any"], F.lit(False)), exact).otherwise(none)
    return looked.select(*kept, F.col(seen)["n"].alias(words_out), hits.alias(hits_out))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: the base places and labels, all labels, and the best score."""
    scanned = scan(docs.select("doc_id", "text"))

    def labels(keep: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(F.transform(keep, lambda h: h["label"]))), ",")

    base = F.filter("hits", lambda h: h["base"])
    starts = F.transform(base, lambda h: h["start"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("score"),
    )
