"""Deterministic network views over the generic test tables.

Each view exists twice with one text: as a Spark DataFrame and as a CTE for
the DuckDB oracle.  Only engine-specific spellings differ (``{S}``, ``{US}``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
FLOW_TIMEOUT_US = 2 * DAY_US
COUNT_WINDOW_US = 6 * HOUR_US
COOLDOWN_US = DAY_US

PATTERNS = [
    ("R1", "<script>"), ("R2", "</nav>"), ("R3", "TRACK("), ("R4", 'href="/the'), ("R5", "cmd.exe"),
    ("R6", "<h1>"), ("R7", "an"), ("R8", "ana"), ("R9", "nan"),
]

_VIEWS = {
    "packets": """
select event_id as packet_id, ts, {US} as ts_us,
  case when event_id % 3 = 0 then s_ip else c_ip end as src_ip,
  case when event_id % 3 = 0 then c_ip else s_ip end as dst_ip,
  case when event_id % 3 = 0 then s_port else c_port end as src_port,
  case when event_id % 3 = 0 then c_port else s_port end as dst_port,
  protocol, cast(floor(value) as bigint) + 40 as length,
  case when protocol = 6 then cast((event_id * 7) % 32 as int) else 0 end as flags
from (select *,
    concat('10.0.0.', cast(user_id % 200 as {S})) as c_ip,
    concat('192.168.1.', cast(user_id % 5 as {S})) as s_ip,
    case when event_type = 'signup' then 0 else cast(40000 + user_id % 200 as int) end as c_port,
    case event_type when 'click' then 80 when 'view' then 443 when 'purchase' then 22
      when 'error' then 53 else 0 end as s_port,
    case event_type when 'error' then 17 when 'signup' then 1 else 6 end as protocol
  from events) e""",
    "scores": """
select event_id as flow_id,
  (event_id * 37 + 11) % 101 / 100e0 as xgboost, (event_id * 41 + 5) % 101 / 100e0 as random_forest,
  (event_id * 43 + 3) % 101 / 100e0 as isolation_forest, (event_id * 47 + 2) % 101 / 100e0 as transformer_ae,
  (event_id * 59 + 1) % 101 / 100e0 as gnn_detector, (event_id * 61 + 9) % 101 / 100e0 as zscore,
  case when event_id % 10 = 0 then 1e0 else 0e0 end as aho_corasick
from events""",
    "alerts": """
select concat('a', cast(packet_id as {S})) as alert_id, ts, ts_us, src_ip, dst_ip, dst_port, confidence,
  case when confidence >= 0.9e0 then 'CRITICAL' when confidence >= 0.75e0 then 'HIGH'
       when confidence >= 0.6e0 then 'MED' else 'LOW' end as severity,
  concat('{{"duration": ', cast(packet_id % 7 - 3 as {S}), ', "count": ', cast(packet_id % 11 - 5 as {S}),
         ', "src_bytes": ', cast(packet_id % 5 - 2 as {S}), '}}') as shap_explanation,
  case when packet_id % 4 = 0 then 'Signature Match' when packet_id % 4 = 1 then 'ML Anomaly'
       when packet_id % 4 = 2 then 'Topology Anomaly' else 'Z-Score Spike' end as rule,
  case when packet_id % 9 = 0 then 'not json' else '["xgboost", "zscore"]' end as detectors
from (select *, (packet_id * 53 + 7) % 101 / 100e0 as confidence from packets) p""",
    "feedback": """
select event_id as feedback_id, {US} as ts_us,
  case event_id % 7 when 0 then 'aho_corasick' when 1 then 'xgboost' when 2 then 'random_forest'
    when 3 then 'isolation_forest' when 4 then 'transformer_ae' when 5 then 'gnn_detector'
    else 'zscore' end as detector,
  event_id % 3 = 0 as was_false_positive
from events where event_type = 'error'""",
    "payloads": """
select p.packet_id, p.ts_us, p.src_ip, p.dst_ip, p.src_port, p.dst_port, p.protocol, p.length, p.flags,
  g.html as payload
from packets p join pages g on g.page_id = p.packet_id % {PAGES}""",
    "eval_scores": """
select l.doc_id, l.toxic as y_true, least(d.n_chars / 20000e0, 1e0) as y_score
from labels l join documents d on d.doc_id = l.doc_id""",
}

_NEEDS = {"alerts": ["packets"], "payloads": ["packets"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame."""
    tables = {
        "packets": ["events"], "scores": ["events"], "feedback": ["events"], "alerts": [],
        "payloads": ["pages"], "eval_scores": ["labels", "documents"],
    }[name]
    sources = {t: table(spark, sf_dir, t) for t in tables}
    sources |= {v: view(spark, sf_dir, v) for v in _NEEDS.get(name, [])}
    pages = sources["pages"].count() if "pages" in sources else 0
    text = _VIEWS[name].format(S="string", US="unix_micros(cast(ts as timestamp))", PAGES=pages)
    for source in sources:
        text = text.replace(f"from {source}", f"from {{{source}}}").replace(f"join {source}", f"join {{{source}}}")
    # JSON braces in literals are doubled again for the DataFrame-reference formatter
    for literal in ('\'{"duration', "'}'"):
        text = text.replace(literal, literal.replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **sources)


def _cte(name: str) -> str:
    pages = "(select count(*) from pages)"
    text = _VIEWS[name].format(S="varchar", US="epoch_us(ts)", PAGES=pages)
    if name == "payloads":
        text = text.replace(f"p.packet_id % {pages}", "p.packet_id % c.n").replace(
            "from packets p", "from packets p cross join (select count(*) as n from pages) c"
        )
    return f"{name} as ({text})"


# Flow building as a recursive walk: one packet per key and step.
_FLOW_CTES = f"""
keyed as (
  select *, (src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port)) as from_a,
    case when from_a then src_ip else dst_ip end as a_ip, case when from_a then src_port else dst_port end as a_port,
    case when from_a then dst_ip else src_ip end as b_ip, case when from_a then dst_port else src_port end as b_port
  from packets),
ranked as (
  select *, row_number() over (partition by a_ip, a_port, b_ip, b_port, protocol order by ts_us, packet_id) as rn,
    dense_rank() over (order by a_ip, a_port, b_ip, b_port, protocol) as k
  from keyed),
walk as (
  select k, rn, ts_us as anchor, false as closed from ranked where rn = 1
  union all
  select r.k, r.rn, case when w.closed then r.ts_us else w.anchor end,
    case when w.closed then false else r.ts_us - w.anchor > {FLOW_TIMEOUT_US} end
  from walk w join ranked r on r.k = w.k and r.rn = w.rn + 1),
flows as (
  select min(packet_id) as flow_id, a_ip as src_ip, a_port as src_port, b_ip as dst_ip, b_port as dst_port, protocol, anchor as start_us,
    max(ts_us) as end_us, count(*) as packet_count,
    cast(sum(case when from_a then length else 0 end) as bigint) as src_bytes,
    cast(sum(case when from_a then 0 else length end) as bigint) as dst_bytes,
    count(*) filter (flags & 1 != 0) as flag_fin, count(*) filter (flags & 2 != 0) as flag_syn,
    count(*) filter (flags & 4 != 0) as flag_rst, count(*) filter (flags & 8 != 0) as flag_psh,
    count(*) filter (flags & 16 != 0) as flag_ack,
    case when bool_or(closed) then 'timeout' else 'flush' end as close_reason
  from ranked join walk using (k, rn) group by a_ip, a_port, b_ip, b_port, protocol, anchor),
seqd as (
  select *, row_number() over (order by end_us, start_us, src_ip, src_port, dst_ip, dst_port, protocol) as seq
  from flows),
basic as (
  select *, case when packet_count < 2 then 0.001e0
      else greatest((end_us - start_us) / 1e6, 0.001e0) end as duration,
    case protocol when 6 then 0 when 17 then 1 when 1 then 2 else 3 end as protocol_type,
    (src_bytes + dst_bytes) / packet_count::double as avg_packet_size,
    (src_bytes + dst_bytes) / duration as bytes_per_second, packet_count / duration as packets_per_second,
    flag_syn / packet_count::double as serror_rate, flag_rst / packet_count::double as rerror_rate
  from seqd)"""


def oracle(views: list[str], body: str, flows: bool = False) -> str:
    """Oracle text: the named views (and the flow tables) as CTEs, then ``body``."""
    wanted: list[str] = []
    for name in views + (["packets"] if flows else []):
        wanted += [n for n in [*_NEEDS.get(name, []), name] if n not in wanted]
    parts = [_cte(n) for n in wanted] + ([_FLOW_CTES] if flows else [])
    head = f"with {'recursive ' if flows else ''}" + ",\n".join(parts) + "\n" if parts else ""
    body = body.strip()
    if head and body.lower().startswith("with "):
        return head.rstrip() + ",\n" + body[5:]
    return head + body
