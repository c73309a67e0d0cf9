"""Flow building, per-flow and connection features, throughput."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsift.functions import packets as P
from flowsift.functions.vectors import FEATURES, scale
from flowsift.operators import baseline, connections, flows, ticks
from flowsift.operators.ensemble import decide
from flowsift.plans import fixtures as fx
from flowsift.plans.registry import query
from flowsift.session import cut_lineage

TIMEOUT = fx.FLOW_TIMEOUT_US
SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLOW_COLUMNS = (
    "flow_id, src_ip, src_port, dst_ip, dst_port, protocol, start_us, end_us, packet_count, src_bytes, dst_bytes, "
    "flag_syn, flag_ack, flag_fin, flag_rst, flag_psh, close_reason"
)


def packets(spark, sf_dir):
    return fx.view(spark, sf_dir, "packets")


def flow_table(spark, sf_dir):
    return flows.assemble_flows(packets(spark, sf_dir), TIMEOUT)


def numbered_flows(spark, sf_dir):
    return connections.number_flows(flows.with_basic_features(flow_table(spark, sf_dir)))


def feature_table(spark, sf_dir):
    """All 23 features, numbered in processing order."""
    timed = connections.with_time_counts(numbered_flows(spark, sf_dir), fx.COUNT_WINDOW_US)
    return connections.with_host_counts(timed)


def flow_oracle(body: str) -> str:
    return fx.oracle([], body, flows=True)


# --- packets ---------------------------------------------------------------


@query(fx.oracle(["packets"], """
select packet_id, case when k then src_ip else dst_ip end as a_ip, case when k then src_port else dst_port end as a_port,
  case when k then dst_ip else src_ip end as b_ip, case when k then dst_port else src_port end as b_port, protocol
from (select *, src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port) as k from packets)"""))
def flow_key(spark, sf_dir):
    return P.with_flow_key(packets(spark, sf_dir)).select("packet_id", *P.FLOW_KEY)


@query(fx.oracle(["packets"], """
select packet_id, concat(least(src_ip, dst_ip), '-', greatest(src_ip, dst_ip), '-', protocol) as host_pair
from packets"""))
def host_pair(spark, sf_dir):
    return packets(spark, sf_dir).select("packet_id", P.host_pair().alias("host_pair"))


@query(fx.oracle(["packets"], """
select packet_id, src_ip, dst_ip, src_port, dst_port from packets
where protocol = 6 and (src_port = 443 or dst_port = 443)
  and (regexp_matches(src_ip, '^10[.]0[.]0[.](6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])$')
    or regexp_matches(dst_ip, '^10[.]0[.]0[.](6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])$'))"""))
def packet_filter(spark, sf_dir):
    kept = P.packet_filter(packets(spark, sf_dir), protocol=6, port=443, net="10.0.0.64/26")
    return kept.select("packet_id", "src_ip", "dst_ip", "src_port", "dst_port")


@query(fx.oracle(["packets"], """
select packet_id, src_ip, dst_port from packets where dst_port not in (80, 443, 8000, 22)"""))
def port_restriction(spark, sf_dir):
    return P.port_violations(packets(spark, sf_dir), [80, 443, 8000, 22]).select("packet_id", "src_ip", "dst_port")


@query(fx.oracle(["packets"], """
select protocol, count(*) as packets, cast(sum(length) as bigint) as bytes from packets group by protocol"""))
def protocol_mix(spark, sf_dir):
    return flows.protocol_mix(packets(spark, sf_dir))


# --- flows -----------------------------------------------------------------


@query(flow_oracle(f"select {FLOW_COLUMNS} from flows"))
def flow_sessions(spark, sf_dir):
    return flow_table(spark, sf_dir).select(*FLOW_COLUMNS.split(", "))


@query(fx.oracle(["packets"], f"""
with keyed as (
  select ts_us, packet_id, length, protocol, src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port) as k,
    case when k then src_ip else dst_ip end as a_ip, case when k then src_port else dst_port end as a_port,
    case when k then dst_ip else src_ip end as b_ip, case when k then dst_port else src_port end as b_port
  from packets),
gaps as (
  select *, case when ts_us - lag(ts_us) over w <= {fx.DAY_US} then 0 else 1 end as opens from keyed
  window w as (partition by a_ip, a_port, b_ip, b_port, protocol order by ts_us, packet_id)),
numbered as (
  select *, sum(opens) over (partition by a_ip, a_port, b_ip, b_port, protocol order by ts_us, packet_id
    rows unbounded preceding) as session from gaps)
select a_ip, a_port, b_ip, b_port, protocol, min(ts_us) as start_us, max(ts_us) as end_us,
  count(*) as packet_count, cast(sum(length) as bigint) as total_bytes
from numbered group by a_ip, a_port, b_ip, b_port, protocol, session"""))
def idle_sessions(spark, sf_dir):
    return flows.idle_sessions(packets(spark, sf_dir), fx.DAY_US)


@query(flow_oracle("""
select flow_id, packet_count, src_bytes, dst_bytes, round(duration, 6) as duration, protocol_type,
  round(avg_packet_size, 6) as avg_packet_size, round(bytes_per_second, 6) as bytes_per_second,
  round(packets_per_second, 6) as packets_per_second, round(serror_rate, 6) as serror_rate,
  round(rerror_rate, 6) as rerror_rate
from basic"""))
def flow_aggregate(spark, sf_dir):
    exact = ["flow_id", "packet_count", "src_bytes", "dst_bytes", "protocol_type"]
    rounded = ["duration", "avg_packet_size", "bytes_per_second", "packets_per_second", "serror_rate", "rerror_rate"]
    featured = flows.with_basic_features(flow_table(spark, sf_dir))
    return featured.select(*exact, *[F.round(c, 6).alias(c) for c in rounded])


@query(flow_oracle("select flow_id, flag_syn, flag_ack, flag_fin, flag_rst, flag_psh from flows"))
def tcp_flag_counts(spark, sf_dir):
    return flow_table(spark, sf_dir).select("flow_id", *[f"flag_{n}" for n in ("syn", "ack", "fin", "rst", "psh")])


@query(flow_oracle("""
select flow_id, src_ip, dst_ip, src_bytes + dst_bytes as total_bytes from flows
order by total_bytes desc, start_us, src_ip, src_port, dst_ip, dst_port, protocol limit 20"""))
def top_flows(spark, sf_dir):
    return flows.top_flows(flow_table(spark, sf_dir), 20).select("flow_id", "src_ip", "dst_ip", "total_bytes")


@query(fx.oracle(["scores"], """
with p as (select count(*) as packets, cast(sum(length) as bigint) as bytes from packets),
f as (select count(*) filter (close_reason = 'flush') as active_flows,
  count(*) filter (close_reason = 'timeout') as completed_flows from flows),
a as (select count(*) filter (0.2e0*aho_corasick + 0.22e0*xgboost + 0.08e0*random_forest + 0.12e0*isolation_forest
    + 0.15e0*transformer_ae + 0.15e0*gnn_detector + 0.08e0*zscore > 0.5e0) as alerts from scores)
select * from p, f, a""", flows=True))
def capture_stats(spark, sf_dir):
    names = ["packets", "bytes", "active_flows", "completed_flows", "alerts"]

    def part(df, **counters):
        zero = F.lit(0).cast("bigint")
        return df.agg(*[counters.get(n, F.max(zero)).alias(n) for n in names])

    source = packets(spark, sf_dir)
    seen = part(source, packets=F.count(F.lit(1)), bytes=F.sum("length"))
    built = part(
        flows.assemble_flows(source, TIMEOUT),
        active_flows=F.count_if(F.col("close_reason") == "flush"),
        completed_flows=F.count_if(F.col("close_reason") == "timeout"),
    )
    fired = part(decide(fx.view(spark, sf_dir, "scores")), alerts=F.count_if("is_alert"))
    return seen.unionByName(built).unionByName(fired).agg(*[F.sum(n).alias(n) for n in names])


# --- order and connection features -------------------------------------------


@query(flow_oracle("select flow_id, seq from seqd"))
def dense_seq(spark, sf_dir):
    return connections.number_flows(flow_table(spark, sf_dir)).select("flow_id", "seq")


def _time_count(key: str, out: str) -> str:
    return flow_oracle(f"""
select f.flow_id, count(g.seq) as "{out}" from seqd f left join seqd g
  on g.{key} = f.{key} and g.seq < f.seq and g.end_us >= f.end_us - {fx.COUNT_WINDOW_US}
group by f.flow_id""")


@query(_time_count("dst_ip", "count"))
def conn_count(spark, sf_dir):
    counted = connections.earlier_in_time(cut_lineage(flow_table(spark, sf_dir)), ["dst_ip"], "count", fx.COUNT_WINDOW_US)
    return counted.select("flow_id", "count")


@query(_time_count("dst_port", "srv_count"))
def srv_count(spark, sf_dir):
    counted = connections.earlier_in_time(cut_lineage(flow_table(spark, sf_dir)), ["dst_port"], "srv_count", fx.COUNT_WINDOW_US)
    return counted.select("flow_id", "srv_count")


def _host_count(keys: list[str], out: str) -> str:
    on = " and ".join(f"g.{k} = f.{k}" for k in keys)
    return flow_oracle(f"""
select f.flow_id, count(g.seq) as {out} from seqd f left join seqd g
  on {on} and g.seq between f.seq - 100 and f.seq - 1
group by f.flow_id""")


def _host_counts(spark, sf_dir):
    return connections.with_host_counts(connections.number_flows(flow_table(spark, sf_dir)))


@query(_host_count(["dst_ip"], "dst_host_count"))
def dst_host_count(spark, sf_dir):
    return _host_counts(spark, sf_dir).select("flow_id", "dst_host_count")


@query(_host_count(["dst_ip", "dst_port"], "dst_host_srv_count"))
def dst_host_srv_count(spark, sf_dir):
    return _host_counts(spark, sf_dir).select("flow_id", "dst_host_srv_count")


@query(flow_oracle("""
select flow_id, round(coalesce(same / nullif(total, 0), 0), 6) as same_srv_rate,
  round(coalesce((total - same) / nullif(total, 0), 0), 6) as diff_srv_rate
from (select f.flow_id, count(g.seq) filter (g.dst_port = f.dst_port)::double as same, count(g.seq)::double as total
  from seqd f left join seqd g on g.seq between f.seq - 100 and f.seq - 1 group by f.flow_id)"""))
def service_rates(spark, sf_dir):
    rates = ["same_srv_rate", "diff_srv_rate"]
    return _host_counts(spark, sf_dir).select("flow_id", *[F.round(c, 6).alias(c) for c in rates])


# every window as a literal self join on the sequence number
FEATS = f"""
near as (
  select f.flow_id, count(g.seq) filter (g.dst_ip = f.dst_ip) as dst_host_count,
    count(g.seq) filter (g.dst_ip = f.dst_ip and g.dst_port = f.dst_port) as dst_host_srv_count,
    count(g.seq) filter (g.dst_port = f.dst_port)::double as same, count(g.seq)::double as total
  from seqd f left join seqd g on g.seq between f.seq - 100 and f.seq - 1 group by f.flow_id),
timed as (
  select f.flow_id, count(g.seq) filter (g.dst_ip = f.dst_ip) as "count",
    count(g.seq) filter (g.dst_port = f.dst_port) as srv_count
  from seqd f left join seqd g on g.seq < f.seq and g.end_us >= f.end_us - {fx.COUNT_WINDOW_US} group by f.flow_id),
feats as (
  select b.*, t."count", t.srv_count, n.dst_host_count, n.dst_host_srv_count,
    coalesce(n.same / nullif(n.total, 0), 0) as same_srv_rate,
    coalesce((n.total - n.same) / nullif(n.total, 0), 0) as diff_srv_rate
  from basic b join near n using (flow_id) join timed t using (flow_id))"""


@query(flow_oracle("with " + FEATS + """
select flow_id, seq, """ + ", ".join(f'round(cast("{c}" as double), 6) as "{c}"' for c in FEATURES) + " from feats"))
def flow_features(spark, sf_dir):
    return feature_table(spark, sf_dir).select(
        "flow_id", "seq", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in FEATURES]
    )


ZSCORES = """
stats as (select flow_id, seq, """ + ", ".join(
    f"case when abs(x_{c} - avg(x_{c}) over w) / sqrt(greatest(coalesce(var_samp(x_{c}) over w, 0), 1e-10)) > 3 "
    f"then 1 else 0 end as o_{c}" for c in FEATURES) + """
  from (select flow_id, seq, """ + ", ".join(f'cast(cast("{c}" as float) as double) as x_{c}' for c in FEATURES) + """
    from feats) window w as (order by seq rows unbounded preceding)),
zscores as (select flow_id, case when seq < 30 then 0 else (""" + " + ".join(f"o_{c}" for c in FEATURES) + """) / 23e0 end
  as zscore from stats)"""


@query(flow_oracle("with " + FEATS + ", " + ZSCORES + " select flow_id, round(zscore, 6) as zscore from zscores"))
def zscore_running(spark, sf_dir):
    scored = baseline.running_zscore(feature_table(spark, sf_dir))
    return scored.select("flow_id", F.round("zscore", 6).alias("zscore"))


@query(flow_oracle("""
select seq, case when seq <= 500 then 'fit' else 'score' end as phase, seq // 50 as epoch from seqd"""))
def warmup_gate(spark, sf_dir):
    numbered = connections.number_flows(flow_table(spark, sf_dir))
    phased = baseline.retrain_epoch(baseline.warmup_phase(numbered, baseline.WARMUP["isolation_forest"]))
    return phased.select("seq", "phase", "epoch")


@query(flow_oracle("""
select seq, case when seq >= 10 then array_to_string(list(src_bytes) over (order by seq rows 9 preceding), ',') end
  as sequence from seqd"""))
def flow_sequences(spark, sf_dir):
    numbered = connections.number_flows(flow_table(spark, sf_dir))
    listed = baseline.last_sequences(numbered, F.col("src_bytes"))
    return listed.select("seq", F.array_join(F.col("sequence").cast("array<string>"), ",").alias("sequence"))


# --- scaling and thresholds on a wide table ------------------------------------


@query("\nunion all\n".join(
    f"select '{c}' as feature, round(avg({c}), 6) as mean, round(stddev_pop({c}), 6) as std from lineitem"
    for c in SCALED))
def fit_scaler(spark, sf_dir):
    stats = baseline.scaler_stats(fx.table(spark, sf_dir, "lineitem"), SCALED)
    return stats.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("select l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - (select avg({c}) from lineitem)) / (select stddev_pop({c}) from lineitem), 5) as {c}"
    for c in SCALED) + " from lineitem")
def scale_features(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *SCALED)
    scaled = scale(lines, baseline.collect_stats(baseline.scaler_stats(lines, SCALED)))
    return scaled.select("l_orderkey", "l_linenumber", *[F.round(c, 5).alias(c) for c in SCALED])


@query("\nunion all\n".join(
    f"select '{c}' as feature, count(*) as n, round(avg({c}), 6) as mean, "
    f"round(var_pop({c}) * count(*) / 1e3, 3) as m2_thousands from lineitem where l_returnflag = 'N'" for c in SCALED))
def baseline_stats(spark, sf_dir):
    normal = fx.table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'")
    stats = baseline.baseline_stats(normal, SCALED)
    return stats.select(
        "feature", "n", F.round("mean", 6).alias("mean"), F.round(F.col("m2") / 1e3, 3).alias("m2_thousands")
    )


@query("""
with s as (select """ + ", ".join(
    f"avg({c}) as m_{c}, stddev_pop({c}) + 1e-9 as s_{c}" for c in SCALED) + """ from lineitem where l_returnflag = 'N'),
r as (select l_orderkey, l_linenumber, greatest(""" + ", ".join(f"abs(({c} - m_{c}) / s_{c})" for c in SCALED) + """) as raw
  from lineitem, s)
select l_orderkey, l_linenumber, round(least(raw / (select quantile_cont(raw, 0.99) from r), 1), 5) as score from r""")
def zscore_batch(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *SCALED)
    scored = baseline.batch_zscore(lines, F.col("l_returnflag") == "N", SCALED)
    return scored.select("l_orderkey", "l_linenumber", F.round("score", 5).alias("score"))


@query("\nunion all\n".join(
    f"select {p}::double as fraction, round(greatest(quantile_cont(value, {p}), 1e-6), 6) as threshold from events"
    for p in (0.9, 0.95, 0.99)))
def calibrate_threshold(spark, sf_dir):
    thresholds = baseline.calibrated_thresholds(fx.table(spark, sf_dir, "events"), "value", [0.9, 0.95, 0.99])
    return thresholds.select("fraction", F.round("threshold", 6).alias("threshold"))


@query("""
select l_orderkey, l_linenumber, round(1 - (l_extendedprice - lo) / (hi - lo + 1e-9), 6) as score
from lineitem, (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem)""")
def minmax_score(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    scored = baseline.inverted_minmax(lines, "l_extendedprice")
    return scored.select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))


# --- throughput ------------------------------------------------------------------

_TICKS = f"""
ticks as (select ts_us // {fx.HOUR_US} as tick, count(*) as packets, cast(sum(length) as bigint) as bytes
  from packets group by 1)"""


def _ticks(spark, sf_dir):
    return ticks.throughput(packets(spark, sf_dir), fx.HOUR_US)


@query(fx.oracle(["packets"], f"with {_TICKS} select tick, packets, bytes from ticks"))
def throughput(spark, sf_dir):
    return _ticks(spark, sf_dir)


@query(fx.oracle(["packets"], f"""
with {_TICKS}
select (tick - o.i) * {fx.HOUR_US} as start_us, cast(sum(packets) as bigint) as packets, cast(sum(bytes) as bigint) as bytes
from ticks, range(6) o(i) group by 1"""))
def throughput_sliding(spark, sf_dir):
    return ticks.sliding(packets(spark, sf_dir), 6 * fx.HOUR_US, fx.HOUR_US)


@query(fx.oracle(["packets"], f"""
with {_TICKS}
select t.tick, round(t.packets / 3600e0, 6) as rate, greatest(t.packets - coalesce(b.packets, 0), 0) as growth
from ticks t left join ticks b on b.tick = t.tick - 1"""))
def tick_delta(spark, sf_dir):
    return ticks.deltas(_ticks(spark, sf_dir), width_us=fx.HOUR_US).select("tick", F.round("rate", 6).alias("rate"), "growth")


@query(fx.oracle(["packets"], f"""
with {_TICKS}
select tick, packets, max(packets) over (order by tick range between 63 preceding and current row) as peak from ticks"""))
def rolling_peak(spark, sf_dir):
    return ticks.rolling_peak(_ticks(spark, sf_dir)).select("tick", "packets", "peak")


@query(fx.oracle(["packets"], """
with m as (select ts_us // 60000000 as tick, count(*) as packets from packets group by 1)
select tick, packets, round(avg(packets) over (order by tick rows unbounded preceding), 6) as running_avg from m"""))
def packets_per_minute(spark, sf_dir):
    minutes = ticks.throughput(packets(spark, sf_dir), 60_000_000).select("tick", "packets")
    return ticks.against_average(minutes).select("tick", "packets", F.round("running_avg", 6).alias("running_avg"))
