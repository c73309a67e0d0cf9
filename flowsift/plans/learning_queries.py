"""Learnt detectors.

SQL cannot fit them.  It states what a fitted detector must show on the tables
and a constant or arbitrary score does not: counts beyond a fitted percentile,
areas under the curve, the order of outlier bands, additivity, moments of a
projection.  Such a query returns one row per check with a number that SQL works
out from the tables (1 where it states that a bound holds).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowsift.operators import evaluate, explain, forest, learn, neighbours, refit
from flowsift.plans import fixtures as fx
from flowsift.plans.flow_queries import flow_oracle, numbered_flows
from flowsift.plans.registry import query
from flowsift.session import cut_lineage

WIDTH = 64
_FLOW_VECTOR = ["duration", "src_bytes", "dst_bytes", "packet_count", "avg_packet_size", "serror_rate"]


def _labelled(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings")
    return rows.withColumn("y", (F.col("label") == 3).cast("int"))


def _vectors(spark, sf_dir):
    values = F.array(*[F.col(c).cast("double") for c in _FLOW_VECTOR])
    return numbered_flows(spark, sf_dir).withColumn("vec", values)


def _checks(spark, values):
    return spark.createDataFrame([(name, int(value)) for name, value in values.items()], "check string, value long")


def _auc(scored, score):
    return evaluate.roc_auc(scored, "y", score).first()[0] or 0.0


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_BANDS = f"""
with m as (select {", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in _LINE)} from lineitem),
b as (select {" + ".join(f"(abs({c} - m_{c}) > 1.4 * s_{c})::int" for c in _LINE)} as band from lineitem, m)
select band, count(*) as rows, true as above from b group by 1"""


@query(_BANDS)
def isolation_forest(spark, sf_dir):
    """Rows by how many columns are far out; each band's mean score is above that of the band before."""
    lines = fx.table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_id"), "l_returnflag", *_LINE)
    lines = lines.withColumn("vec", F.array(*_LINE))
    model = forest.fit_isolation_forest(lines.where("l_returnflag = 'N'"), "row_id", "vec")
    at = lines.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in _LINE]).first()
    band = sum(((F.abs(F.col(c) - at[c]["m"]) > 1.4 * at[c]["s"]).cast("int") for c in _LINE), F.lit(0))
    bands = lines.select(band.alias("band"), model.score(F.col("vec")).alias("score")).groupBy("band").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("score").alias("mean"))
    in_order = Window.orderBy("band")  # at most five rows
    return bands.select("band", "rows", F.coalesce(F.col("mean") > F.lag("mean").over(in_order), F.lit(True)).alias("above"))


_FLAGGED = "select 'flagged' as \"check\", (count(*) - 1 - floor(0.95 * (count(*) - 1)))::bigint as value from lineitem where l_returnflag = 'N'"


@query(_FLAGGED)
def isolation_forest_calibration(spark, sf_dir):
    """Rows of the fit that the contamination percentile leaves on the anomalous side (each row once)."""
    lines = fx.table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_id"), F.array(*_LINE).alias("vec"))
    model = forest.fit_isolation_forest(lines, "row_id", "vec")
    rows, flagged = lines.agg(F.count(F.lit(1)), F.count_if(model.decision(F.col("vec")) < 0)).first()
    expected = rows - 1 - int(0.95 * (rows - 1))
    # scores tie: a tie at the percentile may take or leave some rows
    return _checks(spark, {"flagged": expected if abs(flagged - expected) <= max(2, rows // 1000) else flagged})


_RANKED = """
select 'positives' as "check", count(*) filter (label = 3) as value from embeddings union all select 'negatives', count(*) filter (label <> 3) from embeddings
union all select 'area over 0.9', 1 union all select 'means apart', 1"""


def _ranking(spark, scored, score):
    scored = cut_lineage(scored)
    n = {r["y"]: r["count"] for r in scored.groupBy("y").count().collect()}
    means = {r["y"]: r["m"] for r in scored.groupBy("y").agg(F.avg(score).alias("m")).collect()}
    return _checks(spark, {
        "positives": n.get(1, 0), "negatives": n.get(0, 0), "area over 0.9": _auc(scored, score) > 0.9, "means apart": means[1] > means[0] + 0.1})


@query(_RANKED)
def random_forest_scores(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    model = learn.random_forest(trees=40, depth=6).fit(learn.training_frame(rows, "embedding", "y"))
    return _ranking(spark, learn.attack_probability(model, rows, "embedding", "random_forest").select("vec_id", "y", "random_forest"), "random_forest")


@query(_RANKED)
def boosted_tree_scores(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    model = learn.boosted_trees(rounds=10, depth=3).fit(learn.training_frame(rows, "embedding", "y"))
    return _ranking(spark, learn.attack_probability(model, rows, "embedding", "xgboost").select("vec_id", "y", "xgboost"), "xgboost")


@query("select vec_id, 0.0::double as residual, 5::bigint as features, true as by_size, true as informed from embeddings")
def tree_attribution(spark, sf_dir):
    """Attributions add up to score minus mean score (``residual``), are ordered by size, and say something of every row."""
    rows = _labelled(spark, sf_dir)
    model = learn.random_forest(trees=10, depth=4).fit(learn.training_frame(rows, "embedding", "y"))
    scored = learn.attack_probability(model, rows, "embedding", "score")
    explained = scored.withColumn("shap", explain.attribution(model, F.col("embedding"), WIDTH))
    top = explain.top_features(explained, "shap", [f"e{i}" for i in range(WIDTH)], 5)
    sizes = F.transform("top_features", lambda f: F.abs(f["value"]))
    total = F.aggregate("shap", F.lit(0.0), lambda a, x: a + x)
    return top.select(
        "vec_id", F.abs(F.round(total + F.lit(explain.mean_score(model)) - F.col("score"), 9)).alias("residual"),
        F.size("top_features").cast("long").alias("features"), (sizes == F.sort_array(sizes, asc=False)).alias("by_size"),
        (F.get(sizes, F.lit(0)) > 1e-6).alias("informed"))


@query(flow_oracle("""
select seq, seq <= 2000 as silent, seq > 2000 as scored,
  case when seq = 1 then (select n - 1 - floor(0.9 * (n - 1)) from (select count(*) as n from seqd where seq < least(2000, (select max(seq) from seqd)) and seq % 10 = 0))::bigint end as beyond
from seqd"""))
def temporal_scores(spark, sf_dir):
    """Silent in warm-up, above 0 after it; ``beyond`` counts training sequences over the fitted 90th percentile."""
    numbered = _vectors(spark, sf_dir)
    model = learn.fit_temporal(numbered, "vec", warmup=2000, k=16)
    found = cut_lineage(learn.flat_sequences(numbered, "vec").select("seq", model.error(F.col("sequence")).alias("error"), model.score(F.col("sequence")).alias("raw")))
    last = min(2000, found.agg(F.max("seq")).first()[0])
    beyond = found.where((F.col("seq") < last) & (F.col("seq") % 10 == 0) & (F.col("error") > model.threshold)).count()
    score = F.when(F.col("seq") <= 2000, 0.0).otherwise(F.col("raw"))
    return found.select(
        "seq", (F.col("seq") <= 2000).alias("silent"), (score > 0).alias("scored"), F.when(F.col("seq") == 1, F.lit(beyond)).cast("long").alias("beyond"))


@query(flow_oracle("""
select 'unit' as "check", count(*) filter (seq >= 10) as value from seqd union all select 'axes that spread', 16::bigint
union all select 'more alike than chance', 1::bigint"""))
def sequence_embeddings(spark, sf_dir):
    """Unit length, all axes in use, and alike where the sequences themselves are alike."""
    numbered = _vectors(spark, sf_dir)
    model = learn.fit_temporal(numbered, "vec", warmup=2000, k=16)
    sequences = learn.flat_sequences(numbered, "vec").where("sequence is not null")
    standard = F.transform("sequence", lambda x, i: (x - F.get(F.lit(model.mean.tolist()), i)) / F.get(F.lit(model.std.tolist()), i))
    found = cut_lineage(learn.sequence_embedding(sequences, model).select("seq", "embedding", standard.alias("sequence")))

    def product(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    later = found.select((F.col("seq") - 37).alias("seq"), F.col("embedding").alias("e"), F.col("sequence").alias("s"))
    size = F.sqrt(product(F.col("sequence"), F.col("sequence")) * product(F.col("s"), F.col("s")))
    agree = found.join(later, "seq").agg(F.corr(product(F.col("embedding"), F.col("e")), product(F.col("sequence"), F.col("s")) / size)).first()[0]
    spread = found.agg(*[F.stddev(F.get("embedding", F.lit(i))) for i in range(16)]).first()
    unit = found.where(F.abs(product(F.col("embedding"), F.col("embedding")) - 1) < 1e-6).count()
    return _checks(spark, {"unit": unit, "axes that spread": sum(x > 1e-3 for x in spread), "more alike than chance": (agree or 0.0) > 0.3})


@query(flow_oracle("""
select 'hosts' as "check", count(*) as value from hosts
union all select 'beyond', count(*) - 1 - floor(0.95 * (count(*) - 1))::bigint from hosts union all select 'flows', (select count(*) from seqd)
union all select 'flows above 0', (select count(*) from seqd)""".replace("from hosts", "from (select src_ip as ip from seqd union select dst_ip from seqd) hosts")))
def topology_scores(spark, sf_dir):
    """Hosts beyond the fitted 95th percentile, and flows whose hosts are not rebuilt exactly."""
    columns = ["duration", "src_bytes", "dst_bytes", "packet_count"]
    numbered = cut_lineage(numbered_flows(spark, sf_dir))
    errors, threshold = learn.host_errors(numbered, columns)
    hosts, beyond = errors.agg(F.count(F.lit(1)), F.count_if(F.col("_error") > threshold)).first()
    scored = learn.topology_scores(numbered, columns)
    flows, above = scored.agg(F.count(F.lit(1)), F.count_if(F.col("gnn_detector").between(1e-12, 1))).first()
    return _checks(spark, {"hosts": hosts, "beyond": beyond, "flows": flows, "flows above 0": above})


@query("""
select vec_id, label, embedding is not null as placed, true as centred, true as uncorrelated, true as first_axis_longest,
  true as longer_than_a_column, true as principal from embeddings""")
def class_plane(spark, sf_dir):
    """Every row's principal coordinates, fitted on all rows: centred, uncorrelated, the first axis longest; each axis is that of its own covariances."""
    rows = _labelled(spark, sf_dir).drop("y")
    placed = cut_lineage(learn.plane(rows, "embedding", "vec_id").select("vec_id", "label", "embedding", "x", "y"))
    m = placed.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.corr("x", "y").alias("c")).first()
    columns = [F.get("embedding", F.lit(i)).cast("double") for i in range(WIDTH)]
    s = placed.where("x is not null").agg(*[
        f(c) for c in columns for f in (F.avg, F.stddev, lambda v: F.covar_samp(v, "x"), lambda v: F.covar_samp(v, "y"))]).first()
    found = F.lit(True)
    for at, axis in ((2, "x"), (3, "y")):
        # a principal axis is an eigenvector: its coordinates' covariances with the columns point along it
        along = [s[4 * i + at] / s[4 * i + 1] if s[4 * i + 1] else 0.0 for i in range(WIDTH)]
        size = sum(a * a for a in along) ** 0.5 or 1.0
        own = sum(((c - s[4 * i]) * (along[i] / size / (s[4 * i + 1] or 1.0)) for i, c in enumerate(columns)), F.lit(0.0))
        found &= F.abs(F.abs(own) - F.abs(axis)) < 1e-5
    return placed.select(
        "vec_id", "label", (F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")).alias("placed"),
        F.lit(abs(m["x"]) < 1e-9 and abs(m["y"]) < 1e-9).alias("centred"), F.lit(abs(m["c"]) < 1e-9).alias("uncorrelated"),
        F.lit(m["vx"] >= m["vy"]).alias("first_axis_longest"), F.lit(m["vy"] > 1.0 + 1e-9).alias("longer_than_a_column"),
        F.coalesce(found, F.lit(True)).alias("principal"))


_Z = ", ".join(f"coalesce(abs(f.{c} - avg(w.{c})) / nullif(stddev_pop(w.{c}), 0), 0)" for c in _FLOW_VECTOR)


@query(flow_oracle(f"""
select f.seq, (f.seq - 1) // 250 as epoch, round(least(greatest({_Z}) / 10, 1), 6) as score
from basic f join basic w on w.seq > (f.seq - 1) // 250 * 250 - 1000 and w.seq <= (f.seq - 1) // 250 * 250 where f.seq > 500
group by f.seq, {", ".join("f." + c for c in _FLOW_VECTOR)} union all select seq, (seq - 1) // 250, 0 from seqd where seq <= 500"""))
def refitted_zscore(spark, sf_dir):
    """Distance from the means of the 1000 flows before the newest version, which is due every 250 flows."""
    model = refit.zscore_model()
    scored = refit.refitted_scores(_vectors(spark, sf_dir), F.col("vec"), model, "score", every=250, window=1000, warmup=500)
    return scored.select("seq", F.floor((F.col("seq") - 1) / 250).alias("epoch"), F.round("score", 6).alias("score"))


_SEARCH = {"maxDepth": [2, 4], "numTrees": [3, 8], "minInstancesPerNode": [1, 20]}


@query("""select 'points' as "check", 8::bigint as value union all select 'folds of a finalist', 4 union all select 'fits saved', 1 union all select 'near the full grid', 1""")
def model_search(spark, sf_dir):
    """Successive halving over folds against every point on every fold: the winner is within a fold's spread of the best."""
    rows = learn.training_frame(_labelled(spark, sf_dir), "embedding", "y").select("vec_id", "_features", "_label", "_weight")
    folded = cut_lineage(learn.stratified_folds(rows, "_label", "vec_id", folds=4))
    estimator = learn.random_forest(trees=3, depth=2)
    grid = learn.random_grid(_SEARCH, 8)
    found = learn.halving_search(estimator, folded, grid, folds=4)
    seen = {(k, f): area for k, areas in found.areas.items() for f, area in enumerate(areas)}
    every = learn.fold_areas(estimator, folded, grid, range(4), known=seen)
    mean = {k: sum(every[k, f] for f in range(4)) / 4 for k in range(len(grid))}
    spread = max(abs(every[found.best, f] - mean[found.best]) for f in range(4))
    return _checks(spark, {
        "points": len(grid), "folds of a finalist": len(found.areas[found.best]), "fits saved": found.fits < 4 * len(grid),
        "near the full grid": mean[found.best] >= max(mean.values()) - max(spread, 0.01)})


@query("""
select 1::int as y, count(*) filter (label <> 3) - count(*) filter (label = 3) as rows from embeddings""")
def smote_rows(spark, sf_dir):
    made = neighbours.oversample(_labelled(spark, sf_dir), "embedding", "y", 1)
    return made.groupBy("y").agg(F.count(F.lit(1)).alias("rows"))


_NEAREST_SQL = """
with m as (select vec_id, embedding::double[] as e from embeddings where label = 3),
d as (select a.vec_id, b.vec_id as other, list_distance(a.e, b.e) as distance from m a join m b on a.vec_id <> b.vec_id)
select vec_id, other, round(distance, 5) as distance from (
  select *, row_number() over (partition by vec_id order by distance, other) as rn from d) where rn <= 5"""


@query(_NEAREST_SQL)
def minority_neighbours(spark, sf_dir):
    minority = _labelled(spark, sf_dir).where("y = 1").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    near = neighbours.nearest_neighbours(minority, 5, row_id="vec_id", cell_rows=1000)
    rows = near.select(F.col("id").alias("vec_id"), F.explode("near").alias("n"))
    return rows.select("vec_id", F.col("n.id").alias("other"), F.round("n.distance", 5).alias("distance"))
