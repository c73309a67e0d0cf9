"""Signatures, gates, decisions, alert queries, graph, similarity and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsift.functions import labels as L
from flowsift.functions.vectors import l2_normalise
from flowsift.operators import alerts as A
from flowsift.operators import connections, ensemble, evaluate, flows, gates, graph, signatures, similar
from flowsift.plans import fixtures as fx
from flowsift.plans.detection import decide_flows
from flowsift.plans.detection import replay_summary as summarise
from flowsift.plans.flow_queries import FEATS, TIMEOUT, ZSCORES, flow_oracle, flow_table, packets
from flowsift.plans.registry import query
from flowsift.session import cut_lineage

DETECTORS = list(ensemble.WEIGHTS)
_PATTERNS = "patterns as (select * from (values " + ", ".join(
    f"('{i}', '{p}')" for i, p in fx.PATTERNS) + ") t(rule_id, pattern))"
_CONFIDENCE = "greatest(least(" + " + ".join(["0e0", *(f"{n} * {w}e0" for n, w in ensemble.WEIGHTS.items())]) + ", 1e0), 0e0)"


def _view(name):
    return lambda spark, sf_dir: fx.view(spark, sf_dir, name)


_alerts, _scores, _payloads, _feedback = _view("alerts"), _view("scores"), _view("payloads"), _view("feedback")


def _pages(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", "html")


# --- signatures ----------------------------------------------------------------


@query(f"""with {_PATTERNS}
select page_id, exists (select 1 from patterns p where contains(lower(html), lower(p.pattern))) as hit from pages""")
def signature_any(spark, sf_dir):
    hit = signatures.signature_any(F.col("html"), fx.PATTERNS)
    return _pages(spark, sf_dir).select("page_id", hit.alias("hit"))


@query(f"""with {_PATTERNS}
select page_id, rule_id, pattern from pages join patterns on contains(lower(html), lower(pattern))""")
def signature_hits(spark, sf_dir):
    return signatures.signature_hits(_pages(spark, sf_dir), "html", fx.PATTERNS).drop("html")


# found once per page; a packet carries the page whose number is its own modulo the pages
_OFFSETS = """spots as (
  select page_id, unnest(string_split(lower(html), '')) as c, unnest(range(length(lower(html)))) as i from pages),
page_offsets as (
  select page_id, rule_id, pattern, strlen(substring(lower(html), 1, i)) as start, start + length(pattern) as stop
  from spots join patterns on c = substring(lower(pattern), 1, 1) join pages using (page_id)
  where substring(lower(html), cast(i as bigint) + 1, length(pattern)) = lower(pattern)),
offsets as (
  select packet_id, rule_id, pattern, start, stop from packets cross join (select count(*) as n from pages)
  join page_offsets on page_id = packet_id % n)"""


@query(fx.oracle(["payloads"], f"with {_PATTERNS}, {_OFFSETS} select packet_id, rule_id, start, stop from offsets"))
def signature_offsets(spark, sf_dir):
    found = signatures.signature_offsets(_payloads(spark, sf_dir).select("packet_id", "payload"), "payload", fx.PATTERNS)
    return found.select("packet_id", "rule_id", "start", "stop")


@query(fx.oracle(["payloads"], f"""with {_PATTERNS}, {_OFFSETS},
firsts as (select packet_id, pattern, min(struct_pack(stop := stop, start := start)) as f from offsets group by all)
select p.packet_id, coalesce(string_agg(f.pattern, '|' order by f.f.stop, f.f.start), '') as names
from payloads p left join firsts f using (packet_id) group by p.packet_id"""))
def signature_names(spark, sf_dir):
    named = signatures.signature_names(_payloads(spark, sf_dir).select("packet_id", "payload"), "payload", fx.PATTERNS)
    return named.select("packet_id", F.array_join("names", "|").alias("names"))


@query(fx.oracle(["payloads"], f"""with {_PATTERNS}
select * from (
  select src_ip, ts_us // {fx.DAY_US} * {fx.DAY_US} as slot_us, rule_id, count(*) as matches
  from payloads join patterns on contains(lower(payload), lower(pattern)) where protocol = 6 group by all)
where matches >= case rule_id when 'R1' then 3 when 'R7' then 8 end"""))
def signature_threshold(spark, sf_dir):
    slot = (F.floor(F.col("ts_us") / fx.DAY_US) * fx.DAY_US).alias("slot_us")
    counts = signatures.rule_counts(
        _payloads(spark, sf_dir), "payload", fx.PATTERNS, ["src_ip", slot], {"R1": 6, "R7": 6})
    return signatures.over_threshold(counts, {"R1": 3, "R7": 8})


@query(fx.oracle(["packets"], f"""
select ts_us // {fx.DAY_US} * {fx.DAY_US} as slot_us, src_ip, count(*) as packets from packets
group by all having count(*) > 20"""))
def rate_limit(spark, sf_dir):
    return signatures.rate_limit(packets(spark, sf_dir), 20, fx.DAY_US)


@query(fx.oracle(["packets"], f"""
select ts_us // {fx.DAY_US} * {fx.DAY_US} as slot_us, src_ip, count(*) as syns from packets
where flags & 2 != 0 and flags & 16 = 0 group by all having count(*) > 5"""))
def syn_limit(spark, sf_dir):
    return signatures.syn_limit(packets(spark, sf_dir), 5, fx.DAY_US)


# --- gates -----------------------------------------------------------------------


@query("""
select conv_id, string_agg(text, '' order by turn) as payload from conversations
where length(text) > 0 group by conv_id""")
def payload_reassembly(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return gates.reassemble(turns, ["conv_id"], ["turn"], "text")


_GATED = f"""{_PATTERNS},
texts as (
  select min(packet_id) as flow_id, string_agg(payload, '' order by ts_us, packet_id) as payload
  from payloads join (select packet_id, k, anchor from ranked join walk using (k, rn)) w using (packet_id)
  group by k, anchor),
gated as (
  select flow_id, case when exists (select 1 from patterns p where pattern in ('cmd.exe', 'href="/the')
    and contains(lower(payload), lower(p.pattern))) then 1 else 2 end as gate from texts)"""
_GATE_RULES = [r for r in fx.PATTERNS if r[1] in ("cmd.exe", 'href="/the')]


def _gated_flows(spark, sf_dir):
    return gates.gated_flows(_payloads(spark, sf_dir), _GATE_RULES, TIMEOUT)


@query(fx.oracle(["payloads"], f"with {_GATED} select flow_id, gate from gated", flows=True))
def gate_split(spark, sf_dir):
    return _gated_flows(spark, sf_dir).select("flow_id", "gate")


@query(fx.oracle(["payloads", "scores"], f"""with {_GATED},
decided as (select flow_id, gate, case when gate = 1 then 1e0 else {_CONFIDENCE} end as confidence
  from gated join scores using (flow_id))
select flow_id, gate, round(confidence, 6) as confidence, confidence > 0.5e0 as is_alert from decided""", flows=True))
def two_gate(spark, sf_dir):
    scored = _gated_flows(spark, sf_dir).join(_scores(spark, sf_dir), "flow_id")
    decided = gates.gate_decision(scored, ensemble.weighted_score())
    return decided.select("flow_id", "gate", F.round("confidence", 6).alias("confidence"), "is_alert")


@query(fx.oracle(["payloads"], f"""
with marked as (
  select packet_id, ts_us, k, anchor, ts_us - anchor > {TIMEOUT} as closes,
    concat(least(src_ip, dst_ip), '-', greatest(src_ip, dst_ip), '-', protocol) as pair
  from ranked join walk using (k, rn)),
epochs as (
  select *, coalesce(sum(closes::int) over (partition by pair order by ts_us, packet_id
    rows between unbounded preceding and 1 preceding), 0) as epoch from marked),
texts as (
  select pair, epoch, string_agg(payload, '' order by ts_us, packet_id) as payload
  from epochs join (select packet_id, payload from payloads) using (packet_id) group by all),
owners as (
  select pair, epoch, k, anchor from epochs where closes
  union all
  select pair, (select count(*) from epochs e where e.pair = o.pair and e.closes), arg_min(k, (anchor, id)), min(anchor)
  from (select pair, k, anchor, min(packet_id) as id from epochs group by all having not bool_or(closes)) o group by pair),
ids as (select k, anchor, min(packet_id) as flow_id from epochs group by all)
select flow_id, length(payload) as n_chars, md5(payload) as digest
from owners join texts using (pair, epoch) join ids using (k, anchor)""", flows=True))
def host_pair_payload(spark, sf_dir):
    def measure(texts):
        return texts.select("flow_id", F.length("payload").cast("bigint").alias("n_chars"), F.md5("payload").alias("digest"))

    return gates.host_pair_payloads(_payloads(spark, sf_dir), TIMEOUT, measure=measure)


_BUILD, _NUMBER = fx._FLOW_CTES.split("seqd as", 1)
_NUMBER = "seqd as" + _NUMBER.replace("from flows)", "from flows where flow_id in (select flow_id from gated where gate = 2))", 1)


@query("with recursive " + ",\n".join([fx._cte("packets"), fx._cte("payloads"), _BUILD.strip().rstrip(","), _GATED, _NUMBER, FEATS, ZSCORES]) + f"""
select flow_id, 1 as gate, 1e0 as confidence, true as is_alert from gated where gate = 1
union all
select flow_id, 2, round({ensemble.WEIGHTS["zscore"]}e0 * zscore, 6), false from zscores""")
def flow_decisions(spark, sf_dir):
    decided = decide_flows(
        _payloads(spark, sf_dir), _GATE_RULES, timeout_us=TIMEOUT, time_window_us=fx.COUNT_WINDOW_US,
    )
    return decided.select("flow_id", "gate", F.round("confidence", 6).alias("confidence"), "is_alert")


@query(fx.oracle(["payloads"], f"""with {_GATED}
select (select count(*) from packets) as packets, count(*) as flows, count(*) filter (gate = 1) as alerts,
  (select round((max(ts_us) - min(ts_us)) / 1e6, 3) from packets) as duration_sec from gated""", flows=True))
def replay_summary(spark, sf_dir):
    source = _payloads(spark, sf_dir)
    decided = decide_flows(source, _GATE_RULES, timeout_us=TIMEOUT, time_window_us=fx.COUNT_WINDOW_US)
    return summarise(source, decided).withColumn("duration_sec", F.round("duration_sec", 3))


# --- decision ----------------------------------------------------------------------


@query(fx.oracle(["scores"], f"""
select flow_id, round({_CONFIDENCE}, 6) as confidence, {_CONFIDENCE} > 0.5e0 as is_alert from scores"""))
def ensemble_decide(spark, sf_dir):
    decided = ensemble.decide(_scores(spark, sf_dir))
    return decided.select("flow_id", F.round("confidence", 6).alias("confidence"), "is_alert")


@query(fx.oracle(["scores"], """
select flow_id, case when xgboost >= 0.9e0 then 'CRITICAL' when xgboost >= 0.75e0 then 'HIGH'
  when xgboost >= 0.6e0 then 'MED' else 'LOW' end as severity from scores"""))
def severity_band(spark, sf_dir):
    return _scores(spark, sf_dir).select("flow_id", ensemble.severity(F.col("xgboost")).alias("severity"))


_ENTRIES = "entries as (" + " union all ".join(
    f"select flow_id, '{n}' as name, {i} as pos, {n} as score from scores" for i, n in enumerate(DETECTORS)) + ")"


@query(fx.oracle(["scores"], f"""with {_ENTRIES},
top as (select flow_id, arg_max(name, (score, -pos)) as name from entries group by flow_id)
select flow_id, case name """ + " ".join(
    f"when '{n}' then '{r}'" for n, r in ensemble.RULE_NAMES.items()) + " end as rule from top"))
def rule_from_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("flow_id", ensemble.rule_from_scores(DETECTORS).alias("rule"))


@query(fx.oracle(["scores"], f"""with {_ENTRIES}
select flow_id, coalesce(string_agg(name, ',' order by score desc, pos) filter (score > 0.5e0), '') as fired
from entries group by flow_id"""))
def fired_detectors(spark, sf_dir):
    fired = F.array_join(ensemble.fired_detectors(DETECTORS), ",")
    return _scores(spark, sf_dir).select("flow_id", fired.alias("fired"))


@query(fx.oracle(["feedback"], """
select feedback_id, detector, round(avg(was_false_positive::int) over (partition by detector
  order by ts_us, feedback_id rows 99 preceding), 6) as fp_rate from feedback"""))
def fp_rate(spark, sf_dir):
    rated = ensemble.false_positive_rate(_feedback(spark, sf_dir))
    return rated.select("feedback_id", "detector", F.round("fp_rate", 6).alias("fp_rate"))


_STEP = "list_transform(range(1, 8), lambda i: case when i <> e.d then w.ws[i] when e.fp then greatest(0.01e0, init[i] * (1 - e.rate)) " \
        "else least(init[i], w.ws[i] + 0.05e0 * (init[i] - w.ws[i])) end)"
_INIT = "[" + ", ".join(f"{w}e0" for w in ensemble.WEIGHTS.values()) + "]"


@query("with recursive " + fx._cte("feedback") + f""",
rated as (select list_position({DETECTORS!r}, detector) as d, was_false_positive as fp,
  avg(was_false_positive::int) over (partition by detector order by ts_us, feedback_id rows 99 preceding) as rate,
  row_number() over (order by ts_us, feedback_id) as n from feedback),
steps as (
  select 0::bigint as n, {_INIT} as ws
  union all
  select n, list_transform(nw, lambda x: x / list_sum(nw)) from (
    select e.n, {_STEP.replace("init", _INIT)} as nw from steps w join rated e on e.n = w.n + 1))
select unnest({DETECTORS!r}) as detector, round(unnest(ws), 6) as weight from (select ws from steps order by n desc limit 1)""")
def weights_after_feedback(spark, sf_dir):
    weights = ensemble.weights_after_feedback(_feedback(spark, sf_dir))
    return weights.select("detector", F.round("weight", 6).alias("weight"))


@query("with recursive " + fx._cte("packets") + ", " + fx._cte("alerts") + f""",
ranked as (select *, row_number() over (partition by src_ip, dst_ip, dst_port order by ts_us, alert_id) as rn,
  dense_rank() over (order by src_ip, dst_ip, dst_port) as k from alerts),
walk as (
  select k, rn, ts_us as anchor, true as kept from ranked where rn = 1
  union all
  select r.k, r.rn, case when r.ts_us - w.anchor >= {fx.COOLDOWN_US} then r.ts_us else w.anchor end,
    r.ts_us - w.anchor >= {fx.COOLDOWN_US}
  from walk w join ranked r on r.k = w.k and r.rn = w.rn + 1)
select alert_id, src_ip, dst_ip, dst_port, ts_us from ranked join walk using (k, rn) where kept""")
def alert_cooldown(spark, sf_dir):
    rows = _alerts(spark, sf_dir).select("alert_id", "src_ip", "dst_ip", "dst_port", "ts_us")
    return A.cooldown(rows, fx.COOLDOWN_US)


# --- alert queries -----------------------------------------------------------------

_SHORT = ["alert_id", "ts_us", "src_ip", "confidence", "severity"]
_SHORT_SQL = ", ".join(_SHORT)
_NEWEST = "order by ts_us desc, alert_id"


@query(fx.oracle(["alerts"], f"select {_SHORT_SQL} from alerts {_NEWEST} limit 50"))
def recent_alerts(spark, sf_dir):
    return A.recent(_alerts(spark, sf_dir), 50).select(*_SHORT)


_SINCE = 1_705_000_000_000_000


@query(fx.oracle(["alerts"], f"select {_SHORT_SQL} from alerts where severity = 'HIGH' and ts_us >= {_SINCE}"))
def alerts_filter(spark, sf_dir):
    return A.filtered(_alerts(spark, sf_dir), "high", _SINCE).select(*_SHORT)


@query(fx.oracle(["alerts"], f"""
select * from (select {_SHORT_SQL} from alerts {_NEWEST} limit 200) where severity = 'CRITICAL'"""))
def alerts_limit_then_filter(spark, sf_dir):
    return A.limit_then_filter(_alerts(spark, sf_dir), 200, "critical").select(*_SHORT)


@query(fx.oracle(["alerts"], f"select {_SHORT_SQL} from alerts where alert_id = 'a77'"))
def alert_by_id(spark, sf_dir):
    return A.by_id(_alerts(spark, sf_dir), "a77").select(*_SHORT)


def _newest_us(alerts):
    return alerts.agg(F.max("ts_us")).first()[0]


@query(fx.oracle(["alerts"], """
select src_ip, count(*) as alert_count from alerts
where ts_us >= (select max(ts_us) from alerts) - 240 * 3600000000
group by src_ip order by alert_count desc, src_ip limit 100"""))
def alerts_by_source(spark, sf_dir):
    rows = _alerts(spark, sf_dir)
    return A.by_source(rows, _newest_us(rows), hours=240)


@query(fx.oracle(["alerts"], f"""
select alert_id, src_ip, dst_ip, 'TCP' as proto, confidence as score, severity,
  case when detectors = 'not json' then '' else 'xgboost,zscore' end as detectors, 0::bigint as bytes
from (select * from alerts {_NEWEST} limit 50)"""))
def active_flows(spark, sf_dir):
    return A.active_flows(_alerts(spark, sf_dir), 50).withColumn("detectors", F.array_join("detectors", ","))


@query(fx.oracle(["alerts"], "select rule, count(*) as alerts from alerts group by rule"))
def cluster_summary(spark, sf_dir):
    return A.cluster_summary(_alerts(spark, sf_dir))


@query(fx.oracle(["alerts"], """
select count(*) filter (rule = 'Signature Match') as gate1, count(*) filter (rule <> 'Signature Match') as gate2 from alerts"""))
def gate_counts(spark, sf_dir):
    return A.gate_counts(_alerts(spark, sf_dir))


@query("""
select cast(event_id as varchar) as id, epoch_us(ts) as ts_us, event_type as event, concat('10.0.0.', user_id % 200) as ip,
  event_type <> 'error' as success, props as detail
from events order by ts_us desc, id limit 100""")
def audit_recent(spark, sf_dir):
    log = fx.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("event_type").alias("event"), F.concat(F.lit("10.0.0."), F.col("user_id") % 200).alias("ip"),
        (F.col("event_type") != "error").alias("success"), F.col("props").alias("detail"),
    )
    return A.recent_audit(log, 100)


_ATTRIBUTION = """rows as (
  select alert_id, k as feature, cast(json_extract(shap_explanation, '$.' || k) as double) as value
  from alerts, (select unnest(['duration', 'count', 'src_bytes']) as k))"""


@query(fx.oracle(["alerts"], f"""with {_ATTRIBUTION}
select feature, value, row_number() over (order by abs(value) desc, feature)::int as rank,
  case when value > 0 then 'attack' else 'normal' end as direction from rows where alert_id = 'a77'"""))
def explain_alert(spark, sf_dir):
    return A.explain_alert(_alerts(spark, sf_dir), "a77").select("feature", "value", "rank", "direction")


@query(fx.oracle(["alerts"], f"""with {_ATTRIBUTION}
select alert_id, string_agg(printf('%s (%+.3f)', feature, value), ', ' order by abs(value) desc, feature) as explanation
from (select *, row_number() over (partition by alert_id order by abs(value) desc, feature) as rn from rows) where rn <= 2
group by alert_id"""))
def explain_text(spark, sf_dir):
    return A.explanation_text(_alerts(spark, sf_dir), 2).select("alert_id", "explanation")


@query(fx.oracle(["alerts"], f"""with {_ATTRIBUTION}
select * from (select alert_id, feature, value,
  row_number() over (partition by alert_id order by abs(value) desc, feature)::int as rank from rows) where rank <= 2"""))
def topk_attribution(spark, sf_dir):
    return A.top_attributions(_alerts(spark, sf_dir), 2)


@query(fx.oracle(["alerts"], f"""with {_ATTRIBUTION}
select feature, round(avg(abs(value)), 6) as importance from rows group by feature"""))
def feature_importance(spark, sf_dir):
    means = A.feature_importance(A.attribution_rows(_alerts(spark, sf_dir)))
    return means.select("feature", F.round("importance", 6).alias("importance"))


@query(fx.oracle(["alerts"], """
select alert_id, case when detectors = 'not json' then 0 else 2 end as n_detectors,
  case when detectors = 'not json' then '' else 'xgboost,zscore' end as detectors from alerts"""))
def json_fallback(spark, sf_dir):
    parsed = _alerts(spark, sf_dir).select("alert_id", A.detector_list(F.col("detectors")).alias("d"))
    return parsed.select("alert_id", F.size("d").alias("n_detectors"), F.array_join("d", ",").alias("detectors"))


@query(fx.oracle(["alerts"], f"""
select {_SHORT_SQL} from alerts where ts_us >= (select max(ts_us) from alerts) - 7 * {fx.DAY_US}"""))
def alerts_retained(spark, sf_dir):
    rows = _alerts(spark, sf_dir)
    return A.retained(rows, _newest_us(rows), 7).select(*_SHORT)


@query(fx.oracle(["alerts"], "select count(*) as alerts from alerts"))
def alert_count(spark, sf_dir):
    return A.alert_count(_alerts(spark, sf_dir))


# --- graph ---------------------------------------------------------------------------

_EDGES = """edges as (
  select distinct a, b from (
    select src_ip as a, dst_ip as b from flows union all select dst_ip, src_ip from flows
    union all select src_ip, src_ip from flows union all select dst_ip, dst_ip from flows)),
degree as (select a as ip, count(*) as degree from edges group by a)"""
_ADJ = _EDGES + """,
adj as (select a, b, 1 / sqrt((x.degree * y.degree)::double) as weight from edges join degree x on x.ip = a join degree y on y.ip = b)"""
_NODE = ["packet_count", "src_bytes", "dst_bytes"]
_NODES = """nodes as (
  select ip, """ + ", ".join(f"avg({c}) as {c}" for c in _NODE) + """ from (
    select src_ip as ip, * from flows union all select dst_ip, * from flows) group by ip)"""


@query(flow_oracle(f"with {_EDGES} select a, b from edges"))
def graph_edges(spark, sf_dir):
    return graph.undirected_edges(flow_table(spark, sf_dir))


@query(flow_oracle(f"""with {_EDGES},
o as (select src_ip as ip, count(distinct dst_ip) as fan_out from flows group by 1),
i as (select dst_ip as ip, count(distinct src_ip) as fan_in from flows group by 1)
select ip, degree, coalesce(fan_out, 0) as fan_out, coalesce(fan_in, 0) as fan_in
from degree left join o using (ip) left join i using (ip)"""))
def graph_degree(spark, sf_dir):
    table = cut_lineage(flow_table(spark, sf_dir))  # read more than once
    return graph.degrees(graph.undirected_edges(table)).join(graph.fan(table), "ip")


@query(flow_oracle("""
select ip, coalesce(o, 0) as fan_out, coalesce(i, 0) as fan_in, true as out_within, true as in_within
from (select src_ip as ip, count(distinct dst_ip) as o from flows group by 1) full join
  (select dst_ip as ip, count(distinct src_ip) as i from flows group by 1) using (ip)"""))
def fan_sketched(spark, sf_dir):
    """Exact fan-out and fan-in, and whether the union of a day's sketches is within four standard errors of them."""
    table = cut_lineage(flow_table(spark, sf_dir))
    found = graph.fan_over(graph.fan_sketches(table, fx.DAY_US)).select("ip", F.col("fan_out").alias("o"), F.col("fan_in").alias("i"))

    def within(estimate, exact):
        return F.abs(F.col(estimate) - F.col(exact)) <= 0.5 + 4 * 0.0163 * F.col(exact)

    return graph.fan(table).join(found, "ip").select(
        "ip", "fan_out", "fan_in", within("o", "fan_out").alias("out_within"), within("i", "fan_in").alias("in_within"))


@query(flow_oracle(f"with {_ADJ} select a, b, round(weight, 6) as weight from adj"))
def graph_norm_adj(spark, sf_dir):
    adjacency = graph.normalised_adjacency(cut_lineage(graph.undirected_edges(flow_table(spark, sf_dir))))
    return adjacency.select("a", "b", F.round("weight", 6).alias("weight"))


@query(flow_oracle(f"with {_NODES} select ip, " + ", ".join(f"round({c}, 6) as {c}" for c in _NODE) + " from nodes"))
def graph_node_features(spark, sf_dir):
    nodes = graph.node_features(flow_table(spark, sf_dir), _NODE)
    return nodes.select("ip", *[F.round(c, 6).alias(c) for c in _NODE])


@query(flow_oracle(f"""with {_ADJ}, {_NODES},
hop1 as (select a as ip, """ + ", ".join(f"sum(weight * {c}) as {c}" for c in _NODE) + """ from adj join nodes on ip = b group by a),
hop2 as (select a as ip, """ + ", ".join(f"sum(weight * {c}) as {c}" for c in _NODE) + """ from adj join hop1 on ip = b group by a)
select nodes.ip, """ + ", ".join(f"round(nodes.{c}, 6) as {c}, round(hop2.{c}, 6) as n_{c}" for c in _NODE) + """
from nodes join hop2 on nodes.ip = hop2.ip"""))
def graph_propagate(spark, sf_dir):
    table = cut_lineage(flow_table(spark, sf_dir))  # read more than once
    nodes = graph.node_features(table, _NODE)
    two_hops = graph.propagate(graph.normalised_adjacency(graph.undirected_edges(table)), nodes, _NODE, hops=2)
    both = graph.with_self(nodes, two_hops, _NODE)
    return both.select("ip", *[F.round(c, 6).alias(c) for c in both.columns if c != "ip"])


# --- similarity ------------------------------------------------------------------------

_COSINE = "1 - list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7))"


@query("""
select vec_id, i, round(embedding[i]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as value
from embeddings, range(1, 65) r(i)""")
def l2_normalize(spark, sf_dir):
    unit = fx.table(spark, sf_dir, "embeddings").select("vec_id", l2_normalise(F.col("embedding")).alias("unit"))
    rows = unit.select("vec_id", F.posexplode("unit").alias("pos", "value"))
    return rows.select("vec_id", (F.col("pos") + 1).cast("bigint").alias("i"), F.round("value", 6).alias("value"))


@query(f"select vec_id, label, round({_COSINE}, 6) as distance from embeddings order by {_COSINE}, vec_id limit 10")
def similar_topk(spark, sf_dir):
    corpus = fx.table(spark, sf_dir, "embeddings")
    found = similar.nearest(corpus, similar.lookup(corpus, 7), 10)
    return found.select("vec_id", "label", F.abs(F.round("distance", 6)).alias("distance"))


@query(f"""
select vec_id, label, round(greatest(0, 1 - ({_COSINE})), 6) as similarity from embeddings where vec_id <> 7
order by {_COSINE}, vec_id limit 5""")
def similar_excl_self(spark, sf_dir):
    found = similar.similar_to(fx.table(spark, sf_dir, "embeddings"), 7, 5)
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


_PAIRS = """
q as (select vec_id as query, embedding::double[] as e from embeddings where vec_id % 20 = 0),
d as (select query, vec_id as neighbour, 1 - list_cosine_similarity(embedding::double[], e) as distance from q, embeddings where vec_id <> query)"""


@query(f"""
with {_PAIRS}, r as (select *, row_number() over (partition by query order by round(distance, 12), neighbour) as rank from d)
select query, neighbour, rank::int as rank, round(distance, 6) as distance from r where rank <= 5""")
def similar_to_each(spark, sf_dir):
    """The five nearest other vectors of every vector whose id 20 divides."""
    corpus = fx.table(spark, sf_dir, "embeddings")
    found = similar.nearest_to_each(corpus, corpus.where("vec_id % 20 = 0"), 5)
    return found.select("query", "neighbour", "rank", F.round("distance", 6).alias("distance"))


# --- evaluation --------------------------------------------------------------------------

_PREDICTED = "p as (select *, case when y_score > 0.5e0 then 1 else 0 end as y_pred from eval_scores)"
_BINARY = """round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) as f1,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 4) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) as recall"""
_CELLS = """count(*) filter (y_true = 1 and y_pred = 1)::double as tp, count(*) filter (y_true = 0 and y_pred = 1)::double as fp,
  count(*) filter (y_true = 1 and y_pred = 0)::double as fn"""


def _eval(spark, sf_dir):
    return fx.view(spark, sf_dir, "eval_scores")


def _predicted(spark, sf_dir):
    return _eval(spark, sf_dir).withColumn("y_pred", (F.col("y_score") > 0.5).cast("int"))


@query(fx.oracle(["eval_scores"], f"with {_PREDICTED} select {_BINARY} from (select {_CELLS} from p)"))
def binary_metrics(spark, sf_dir):
    return evaluate.binary_metrics(_predicted(spark, sf_dir))


_AUC = """(select sum(case when n.y_score < q.y_score then 1e0 when n.y_score = q.y_score then 0.5e0 else 0e0 end) / count(*)
  from {t} q join {t} n on q.y_true = 1 and n.y_true = 0)"""


@query(fx.oracle(["eval_scores"], f"select round({_AUC.format(t='eval_scores')}, 6) as roc_auc"))
def roc_auc(spark, sf_dir):
    return evaluate.roc_auc(_eval(spark, sf_dir)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query(fx.oracle(["eval_scores"], """
select t.y_score as threshold,
  round(count(*) filter (s.y_true = 0 and s.y_score >= t.y_score) / count(*) filter (s.y_true = 0)::double, 6) as fpr,
  round(count(*) filter (s.y_true = 1 and s.y_score >= t.y_score) / count(*) filter (s.y_true = 1)::double, 6) as tpr
from (select distinct y_score from eval_scores) t cross join eval_scores s group by t.y_score"""))
def roc_curve(spark, sf_dir):
    curve = evaluate.roc_curve(_eval(spark, sf_dir))
    return curve.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(fx.oracle(["eval_scores"], f"with {_PREDICTED} select y_true, y_pred, count(*) as rows from p group by all"))
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(_predicted(spark, sf_dir))


@query(fx.oracle(["eval_scores"], f"""with {_PREDICTED},
classes as (select unnest([0, 1]) as c),
sums as (select c, count(*) filter (y_true = c)::double as support, count(*) filter (y_pred = c)::double as said,
  count(*) filter (y_true = c and y_pred = c)::double as hit from p, classes group by c),
per_class as (select c::varchar as label, coalesce(hit / nullif(said, 0), 0) as precision,
  coalesce(hit / nullif(support, 0), 0) as recall, 2 * hit / (said + support) as f1, support from sums),
report as (select * from per_class
  union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from per_class
  union all select 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) from sums)
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
  support::bigint as support from report"""))
def class_report(spark, sf_dir):
    report = evaluate.class_report(_predicted(spark, sf_dir))
    return report.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("select toxic, count(*) as rows, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from labels group by toxic")
def class_balance(spark, sf_dir):
    balance = evaluate.class_balance(fx.table(spark, sf_dir, "labels").select("toxic"), "toxic")
    return balance.select("toxic", "rows", F.round("percent", 6).alias("percent"))


@query(fx.oracle(["eval_scores"], "select doc_id, y_true, y_score from eval_scores order by y_score desc, doc_id limit 1"))
def top_confidence(spark, sf_dir):
    return evaluate.top_confidence(_eval(spark, sf_dir), "y_score", "doc_id")


@query("""
select event_id, case event_type when 'view' then 0 when 'click' then 0 when 'purchase' then 2 when 'error' then 3
  else 1 end as cls from events""")
def label_map(spark, sf_dir):
    classes = {"view": 0, "click": 0, "purchase": 2, "error": 3}
    cls = L.mapped_label(F.col("event_type"), classes, L.UNKNOWN_FAMILY)
    return fx.table(spark, sf_dir, "events").select("event_id", cls.alias("cls"))


@query("""
select cast(sum(n) as bigint) as rows_before, count(*) as rows_after, cast(sum(n - 1) as bigint) as dropped
from (select count(*) as n from documents group by text, lang, source)""")
def dedup_rows(spark, sf_dir):
    return evaluate.duplicate_counts(fx.table(spark, sf_dir, "documents"), ["text", "lang", "source"])


@query("""
select doc_id, lang, n_chars, '' as source from documents where lang = 'en'
union all select doc_id, lang, -1, source from documents where lang <> 'en'""")
def union_files(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents")
    english = documents.where("lang = 'en'").select("doc_id", "lang", "n_chars")
    others = documents.where("lang <> 'en'").select("doc_id", "lang", "source")
    return english.unionByName(others, allowMissingColumns=True).fillna({"n_chars": -1, "source": ""})


@query(fx.oracle(["eval_scores"], f"""
with models as (
  select 'length' as model, y_true, y_score from eval_scores
  union all select 'hash', y_true, (doc_id * 37 + 11) % 101 / 100e0 from eval_scores),
p as (select *, case when y_score > 0.5e0 then 1 else 0 end as y_pred from models),
m as (select model, {_CELLS} from p group by model)
select model, {_BINARY}, round({_AUC.format(t="(select * from models where model = 'length')")}, 4) as roc_auc from m where model = 'length'
union all
select model, {_BINARY}, round({_AUC.format(t="(select * from models where model = 'hash')")}, 4) from m where model = 'hash'"""))
def model_comparison(spark, sf_dir):
    scored = _eval(spark, sf_dir)
    hashed = scored.withColumn("y_score", (F.col("doc_id") * 37 + 11) % 101 / F.lit(100.0))
    return evaluate.comparison({"length": scored, "hash": hashed})
