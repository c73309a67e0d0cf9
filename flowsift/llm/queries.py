"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.llm import (
    credentials, fingerprints, importance, interactions, licenses, mixing, ngram_join, packing, pages, quality, tokens, toxicity, urls,
)
from flowsift.llm.text import table
from flowsift.plans.registry import query

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '')"


@query(rf"""
with split as (select doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
spot as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from split),
win as (select doc_id, i, string_agg(word, ' ') over eight as grams, count(*) over eight as n from spot
  window eight as (partition by doc_id order by i rows between current row and 7 following)),
twice as (select doc_id, i from win where n = 8 qualify count(*) over (partition by doc_id, grams) > 1),
hit as (select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + 8)) as k from twice) group by 1),
line as (select doc_id, unnest(string_split(text, chr(10))) as line from split),
lines as (select doc_id, count(*) as n, count(distinct line) as d from line where regexp_matches(line, '[^ \t-\r]') group by 1),
m as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(lines.n - lines.d, 0)::bigint as n_dup_lines, coalesce(hit.n, 0)::bigint as n_repeat_words,
    coalesce(lines.n, 0) as n_lines, length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) as n_upper
  from split left join lines using (doc_id) left join hit using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 10 * n_symbols > n_words or 2 * n_upper > word_chars
    or 10 * n_dup_lines > 4 * n_lines or word_chars < 2 * n_words or word_chars > 20 * n_words) as kept
from m""")
def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and the cascade's verdict for every document."""
    return quality.report(table(spark, sf_dir, "documents"))


@query(f"""
with d as (select doc_id, source, len({_WORDS})::bigint as size, md5('{mixing.SEED}|' || coalesce(doc_id::varchar, 'null')) as key from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as r from d group by 1),
w as (select *, [3, 1, 2][(r - 1) % 3 + 1] as weight, 2 * source_size as cap from s),
b as (select *, cap / weight as ratio,
    coalesce(sum(cap) over earlier, 0) as caps, coalesce(sum(weight) over earlier, 0) as weights,
    sum(source_size) over () as total, sum(weight) over () as total_weight
  from w window earlier as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select *, (1.5e0 * total - caps) / (total_weight - weights)::double as level from b),
f as (select arg_min(level, struct_pack(ratio, r)) as fair from l where cap > level * weight),
t as (select source, source_size, case when fair * weight < cap then fair * weight else cap::double end as target from l cross join f),
p as (select *, least(floor(target + 0.5), 2 * source_size)::bigint as budget from t),
e as (select *, case when source_size > 0 then budget // source_size else 0 end as whole from p),
o as (select d.*, e.* exclude (source), budget - whole * source_size as rest,
    coalesce(sum(size) over (partition by d.source order by key rows between unbounded preceding and 1 preceding), 0) as before
  from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::bigint as taken from o""")
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document by a mix of 150 % of all words, weights 3, 1, 2."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices and phrases in every document."""
    return licenses.digest(table(spark, sf_dir, "documents"))


@query()
def op2_weighted_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likeness."""
    return fingerprints.compared(table(spark, sf_dir, "documents"))


@query()
def op3_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a packed sequence."""
    return packing.pack(table(spark, sf_dir, "documents"), tokens.vocabulary())


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.vocabulary())


@query()
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for the address of every page."""
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


@query()
def op10_toxicity_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op6_template_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    texts = pages.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query(r"""
with recursive words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') as w from documents),
grams as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as g
  from words where len(w) > 0),
sizes as (select doc_id, count(*) as n from grams group by 1),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from common join sizes s on s.doc_id = x join sizes t on t.doc_id = y where 100 * c >= 80 * (s.n + t.n - c)),
edges as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id as r from documents union select reach.doc_id, e.y from reach join edges e on e.x = reach.r)
select doc_id, coalesce(n, 0) as n_shingles, min(r) as component_id from reach left join sizes using (doc_id) group by 1, 2""")
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 80 % shared shingles."""
    return ngram_join.joined(table(spark, sf_dir, "documents"))


@query(rf"""
with letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
orders as (select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e
  where (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps as (select filter_order, s::int as step, 1 << (ascii(substr(filter_order, s, 1)) - 65) as bit,
    list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))) as b
  from orders, range(1, 6) as r(s)),
split as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, {_WORDS} as w from documents),
l as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1),
masks as (select part, quality, toxic, case when len(w) < 200 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
    + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 4 else 0 end
    + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
    + case when doc_id > min(doc_id) over (partition by text) then 16 else 0 end as mask
  from split left join l using (doc_id)),
cell as (select part, mask, count(*) as n, count(*) filter (quality = 1) as good, count(*) filter (toxic = 1) as bad from masks group by 1, 2),
counted as (select part, filter_order, step, bit,
    sum(case when mask & (coalesce(b, 0)::int | bit) = 0 then n else 0 end) as kept,
    sum(case when mask & coalesce(b, 0)::int = 0 and mask & bit <> 0 then n else 0 end) as removed,
    sum(case when mask & coalesce(b, 0)::int <> 0 and mask & bit <> 0 then n else 0 end) as redundant,
    sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & coalesce(b, 0)::int = 0 and mask & bit <> 0 then good else 0 end) as good_lost,
    sum(case when mask & coalesce(b, 0)::int = 0 and mask & bit <> 0 then bad else 0 end) as toxic_lost
  from cell, steps group by 1, 2, 3, 4)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley
from counted""")
def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five text filters remove at each step of every order, by language."""
    return interactions.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials in every document, by fixed patterns and by learnt formats."""
    return credentials.digest(table(spark, sf_dir, "documents"))


# the checksum works on halves of bytes with the 16 fixed values of its table
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(2 * octet_length(encode(g))),
    lambda i: instr('0123456789ABCDEF', substr(hex(encode(g)), (i // 2 * 2 + 2 - i % 2)::int, 1))::bigint - 1)),
  lambda c, h: xor(c >> 4, list_extract([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580,
    3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::bigint[], (xor(c, h) & 15) + 1))), 4294967295)"""


@query(rf"""
with words as (select 0 as target, doc_id as id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents
  union all select 1, item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') from benchmark),
runs as (select target, id, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')),
    list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))))) as g from words),
held as (select target, id, g, count(*) as n from runs group by 1, 2, 3),
known as (select g, ({_CRC} % 10000)::int as b from (select distinct g from held)),
counts as (select b, coalesce(sum(n) filter (target = 0), 0) as s, coalesce(sum(n) filter (target = 1), 0) as t from held join known using (g) group by 1),
gain as (select b, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from counts),
weight as (select id as doc_id, sum(n * gain)::bigint as weight from held join known using (g) join gain using (b) where target = 0 group by 1),
scored as (select id as doc_id, len(w) as n, len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from words left join weight on doc_id = id where target = 0),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as able from scored where n >= 20)
select doc_id, n_features::bigint as n_features, weight, score, case when rank <= 5 * able // 100 then rank end::bigint as rank
from scored left join placed using (doc_id)""")
def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and place in the draw of every document, towards the benchmark texts."""
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
