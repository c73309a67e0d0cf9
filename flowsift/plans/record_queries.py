"""Record shaping, dataset preparation and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsift.functions import labels as L
from flowsift.functions import packets as P
from flowsift.functions.vectors import assemble, clip01, finite
from flowsift.operators import alerts as A
from flowsift.operators import baseline, connections, ensemble, evaluate, flows, similar
from flowsift.plans import fixtures as fx
from flowsift.plans.flow_queries import TIMEOUT, flow_oracle, flow_table, packets
from flowsift.plans.registry import query
from flowsift.sources import tables


def _alerts(spark, sf_dir):
    return fx.view(spark, sf_dir, "alerts")


# --- packets and flows ---------------------------------------------------------------


@query(fx.oracle(["packets"], """
select packet_id, case protocol when 6 then 0 when 17 then 1 when 1 then 2 else 3 end as code from packets"""))
def protocol_code(spark, sf_dir):
    return packets(spark, sf_dir).select("packet_id", P.protocol_code().alias("code"))


@query(flow_oracle(f"""
select flow_id, end_us from flows
where close_reason = 'flush' and (select max(ts_us) from packets) - end_us > {TIMEOUT}"""))
def expired_flows(spark, sf_dir):
    source = packets(spark, sf_dir)
    now = source.agg(F.max("ts_us")).first()[0]
    still_open = flows.assemble_flows(source, TIMEOUT).where("close_reason = 'flush'")
    return flows.expired_flows(still_open, now, TIMEOUT).select("flow_id", "end_us")


@query(fx.oracle(["packets"], """
select packet_id, case when packet_id % 13 = 0 then 'flagged' when packet_id % 101 / 100e0 >= 0.5e0 then 'suspicious'
  else 'normal' end as band from packets"""))
def packet_risk(spark, sf_dir):
    band = P.risk_band(F.col("packet_id") % 13 == 0, F.col("packet_id") % 101 / F.lit(100.0))
    return packets(spark, sf_dir).select("packet_id", band.alias("band"))


@query(fx.oracle(["packets"], """
select 'packet_event' as type, ts_us / 1e6 as ts, src_ip as src, dst_ip as dst, protocol as proto, length, flags,
  round(packet_id % 1013 / 1013e0, 3) as flow_score, packet_id % 13 = 0 as flagged from packets"""))
def packet_events(spark, sf_dir):
    scored = packets(spark, sf_dir).withColumns({
        "flow_score": F.col("packet_id") % 1013 / F.lit(1013.0), "flagged": F.col("packet_id") % 13 == 0,
    })
    return tables.packet_events(scored)


@query(flow_oracle("""
select (seq - 1) // 10 * 10 as start, array_to_string(list(packet_count order by seq), ',') as sequence
from seqd where (seq - 1) // 10 * 10 < (select count(*) from seqd) - 10 group by 1"""))
def training_sequences(spark, sf_dir):
    numbered = connections.number_flows(flow_table(spark, sf_dir))
    listed = baseline.training_sequences(numbered, F.col("packet_count"), numbered.count())
    return listed.select("start", F.array_join(F.col("sequence").cast("array<string>"), ",").alias("sequence"))


# --- dataset preparation -----------------------------------------------------------------


@query("""
select l_orderkey, l_linenumber, i, round(case i when 0 then l_quantity when 1 then l_extendedprice when 2 then l_discount
  else l_tax end::float::double, 6) as value from lineitem, range(4) r(i)""")
def feature_vector(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem")
    vector = assemble(["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    rows = lines.select("l_orderkey", "l_linenumber", F.posexplode(vector).alias("i", "value"))
    return rows.withColumns({"i": F.col("i").cast("bigint"), "value": F.round(F.col("value").cast("double"), 6)})


@query("""
select event_id, case when event_id % 3 = 0 or event_id % 3 = 1 then 0e0 else value end as value from events""")
def sanitised(spark, sf_dir):
    odd = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 == 1, F.lit(float("inf")))
    rows = fx.table(spark, sf_dir, "events").withColumn("_x", odd.otherwise(F.col("value")))
    return rows.select("event_id", finite(F.col("_x")).alias("value"))


@query("""
select event_id, coalesce(try_cast(case when event_id % 5 = 0 then props else user_id::varchar end as double), 0) as number
from events""")
def safe_number(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 == 0, F.col("props")).otherwise(F.col("user_id").cast("string"))
    return fx.table(spark, sf_dir, "events").select("event_id", L.number_or_zero(text).alias("number"))


@query("""select event_id, case when event_type = 'view' then 0 else 1 end as y from events""")
def binary_labels(spark, sf_dir):
    label = F.concat(F.lit(" "), F.upper("event_type"))
    return fx.table(spark, sf_dir, "events").select("event_id", L.binary_label(label, "view").alias("y"))


@query("select event_id, cast('0x' || substring(md5(event_type), 1, 8) as bigint) % 1000 as code from events")
def hashed_categories(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", L.hashed(F.col("event_type")).alias("code"))


@query("select event_id from events order by md5('42|' || event_id::varchar), event_id limit 200")
def row_sample(spark, sf_dir):
    return L.deterministic_sample(fx.table(spark, sf_dir, "events"), "event_id", 200, 42).select("event_id")


@query("""
select event_id, 0 as label from events where event_type in ('view', 'click')
union all select event_id, 1 from events where event_type = 'error'""")
def scenario_union(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("event_id", "event_type")
    normal = events.where(F.col("event_type").isin("view", "click")).select("event_id", F.lit(0).alias("label"))
    return normal.unionByName(events.where("event_type = 'error'").select("event_id", F.lit(1).alias("label")))


@query("select event_id, least(greatest(value / 100 - 0.25, 0), 1) as score from events")
def clipped(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", clip01(F.col("value") / 100 - F.lit(0.25)).alias("score"))


@query(fx.oracle(["eval_scores"], """
with f as (select doc_id % 5 as fold, avg(((y_score > 0.5e0)::int = y_true)::int) as accuracy from eval_scores group by 1)
select round(avg(accuracy), 6) as mean, round(stddev_pop(accuracy), 6) as std from f"""))
def cross_validation(spark, sf_dir):
    scored = fx.view(spark, sf_dir, "eval_scores")
    right = ((F.col("y_score") > 0.5).cast("int") == F.col("y_true")).cast("int")
    folds = scored.groupBy((F.col("doc_id") % 5).alias("fold")).agg(F.avg(right).alias("accuracy"))
    return evaluate.cross_validated(folds, "accuracy").select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


# --- alert records and tables ------------------------------------------------------------------


@query(fx.oracle(["alerts"], """
select alert_id, case when dst_port % 2 = 0 then dst_port else 0 end as dst_port,
  case when confidence > 0.3e0 then confidence else 0 end as confidence,
  case when severity = 'HIGH' then 'LOW' else severity end as severity,
  case when alert_id like '%7' then 0 else ts_us / 1e6 end as seconds from alerts"""))
def alert_records(spark, sf_dir):
    gaps = _alerts(spark, sf_dir).withColumns({
        "dst_port": F.when(F.col("dst_port") % 2 == 0, F.col("dst_port")),
        "confidence": F.when(F.col("confidence") > 0.3, F.col("confidence")),
        "severity": F.nullif("severity", F.lit("HIGH")),
        "ts_us": F.when(~F.col("alert_id").endswith("7"), F.col("ts_us")),
    })
    return A.alert_defaults(gaps).select(
        "alert_id", "dst_port", "confidence", "severity", A.epoch_seconds(F.col("ts_us")).alias("seconds")
    )


@query(fx.oracle(["alerts"], """
select 'alert_event' as type, alert_id as id, rule, severity, round(confidence, 3) as confidence, src_ip, dst_ip,
  dst_port as port, ts_us // 1000000 as ts from alerts"""))
def alert_events(spark, sf_dir):
    return tables.alert_events(_alerts(spark, sf_dir)).drop("detectors", "shap")


@query(fx.oracle(["alerts"], """
select '{"alert_id":"' || alert_id || '","src_ip":"' || src_ip || '","dst_port":' || dst_port || ',"severity":"'
  || severity || '"}' as value from alerts"""))
def alert_json_lines(spark, sf_dir):
    return tables.json_lines(_alerts(spark, sf_dir).select("alert_id", "src_ip", "dst_port", "severity"))


@query(fx.oracle(["alerts"], """
select alert_id, '{"top_features":["duration","count"],"summary":"' || rule || '"}' as explanation from alerts"""))
def explanation_json(spark, sf_dir):
    built = A.explanation_json(F.array(F.lit("duration"), F.lit("count")), F.col("rule"))
    return _alerts(spark, sf_dir).select("alert_id", built.alias("explanation"))


@query(fx.oracle(["alerts"], """
with incoming as (select src_ip || '-' || dst_ip as alert_id, ts_us, dst_port from alerts),
stored as (select distinct src_ip || '-' || dst_ip as alert_id from alerts where dst_port = 22)
select alert_id, min(ts_us) as ts_us from incoming where alert_id not in (select alert_id from stored) group by alert_id"""))
def new_alerts(spark, sf_dir):
    incoming = _alerts(spark, sf_dir).select(
        F.concat_ws("-", "src_ip", "dst_ip").alias("alert_id"), "ts_us", "dst_port"
    )
    stored = incoming.where("dst_port = 22").distinct()
    return tables.unseen_alerts(incoming, stored).select("alert_id", "ts_us")


@query("select i, embedding[i]::double as value from embeddings, range(1, 65) r(i) where vec_id = 7")
def embedding_lookup(spark, sf_dir):
    found = similar.stored(fx.table(spark, sf_dir, "embeddings"), 7)
    rows = found.select(F.posexplode("embedding").alias("pos", "value"))
    return rows.select((F.col("pos") + 1).cast("bigint").alias("i"), F.col("value").cast("double").alias("value"))


@query(fx.oracle(["feedback"], """
select detector, round(count(*) / (select count(*) from feedback)::double, 3) as weight from feedback group by detector"""))
def normalised_weights(spark, sf_dir):
    counts = fx.view(spark, sf_dir, "feedback").groupBy("detector").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return ensemble.normalised(counts)


@query(fx.oracle(["alerts"], "select alert_id, ts_us, severity from alerts order by ts_us desc, alert_id limit 500"))
def newest_500(spark, sf_dir):
    return A.recent(_alerts(spark, sf_dir), 500).select("alert_id", "ts_us", "severity")
