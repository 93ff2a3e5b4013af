"""Bootstrap and regression queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.statistics import add_arrays, analysis, bootstrap_means, cluster_sums, content_only, draws, draws_by_count, interval, normal_sums, solved, two_sided_p
from .base import query, table

B, SEED = 200, 20260913
HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"
# paired differences of two arms by part, clustered by supplier nation
PAIRS = """WITH g AS (SELECT l_partkey, l_returnflag, avg(l_discount) AS v, min(l_suppkey) AS sk FROM lineitem GROUP BY 1, 2),
p AS (SELECT a.l_partkey, a.v - b.v AS delta, a.v AS va, b.v AS vb, a.l_partkey % 25 AS cluster FROM g a JOIN g b ON a.l_partkey = b.l_partkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R'),
c AS (SELECT cluster, sum(delta) AS s, count(*) AS n, sum(va) AS sa, sum(vb) AS sb, dense_rank() OVER (ORDER BY cluster) - 1 AS index FROM p GROUP BY 1),
d AS (SELECT r AS resample, """ + HASH.format(f"'{SEED}:' || r || ':' || k") + f""" % 25 AS index FROM range({B}) t(r), range(25) u(k)),
m AS (SELECT resample, sum(s) / sum(n) AS mean, sum(sa) / sum(n) AS mean_a FROM d JOIN c USING (index) GROUP BY 1)"""


def paired(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.avg("l_discount").alias("v"))
    a = g.filter("l_returnflag = 'A'").select("l_partkey", F.col("v").alias("va"))
    b = g.filter("l_returnflag = 'R'").select("l_partkey", F.col("v").alias("vb"))
    return a.join(b, "l_partkey").select("l_partkey", (F.col("va") - F.col("vb")).alias("delta"), "va", "vb", (F.col("l_partkey") % 25).alias("cluster"))


def resampled(spark, d, value="delta"):
    return bootstrap_means(cluster_sums(paired(spark, d), "cluster", F.col(value)), draws(spark, B, 25, SEED))


@query("b1_draws", "WITH d AS (SELECT r AS resample, " + HASH.format(f"'{SEED}:' || r || ':' || k") + f" % 25 AS index FROM range({B}) t(r), range(25) u(k)) SELECT resample, CAST(index AS INTEGER) AS index, count(*) AS times FROM d GROUP BY 1, 2")
def b1(spark, d):
    return draws(spark, B, 25, SEED)


@query("b1_seeded_matrix")
def b1_matrix(spark, d):
    """The draws of a seeded generator, as a frame: the same on every run."""
    picked = np.random.default_rng(SEED).integers(0, 25, size=(B, 25))
    rows = [(r, int(c), int(n)) for r in range(B) for c, n in zip(*np.unique(picked[r], return_counts=True))]
    return spark.createDataFrame(rows, "resample long, index int, times long")


@query("b2_cluster_bootstrap", PAIRS + " SELECT resample, round(mean, 9) AS mean FROM m")
def b2(spark, d):
    return resampled(spark, d).withColumn("mean", F.round("mean", 9))


@query("b3_interval", PAIRS + f" SELECT round(quantile_cont(mean, 0.025), 8) AS lo, round(quantile_cont(mean, 0.975), 8) AS hi, count(mean) AS n_valid, {B} - count(mean) AS n_empty, min(mean) = max(mean) AS degenerate FROM m")
def b3(spark, d):
    return interval(resampled(spark, d)).withColumns({"lo": F.round("lo", 8), "hi": F.round("hi", 8)})


@query("b4_p_value", PAIRS + " SELECT round(least(1, greatest(2 * least(avg((mean <= 0)::INT), avg((mean >= 0)::INT)), 1 / count(*))), 8) AS p FROM m")
def b4(spark, d):
    return two_sided_p(resampled(spark, d)).withColumn("p", F.round("p", 8))


@query("b5_paired_delta", PAIRS + " SELECT round((SELECT avg(delta) FROM p), 8) AS delta, round(quantile_cont(mean, 0.025), 8) AS lo, round(quantile_cont(mean, 0.975), 8) AS hi, quantile_cont(mean, 0.025) > 0 OR quantile_cont(mean, 0.975) < 0 AS excludes_zero, round(quantile_cont(mean_a, 0.025), 8) AS lo_a FROM m")
def b5(spark, d):
    point = paired(spark, d).agg(F.round(F.avg("delta"), 8).alias("delta"))
    ci = interval(resampled(spark, d)).select("lo", "hi")
    arm = interval(resampled(spark, d, "va")).select(F.round("lo", 8).alias("lo_a"))
    out = point.crossJoin(ci).crossJoin(arm)  # single rows
    return out.select("delta", F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"), ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("excludes_zero"), "lo_a")


@query("b6_crossed_bootstrap", PAIRS.split("c AS (")[0] + "x AS (SELECT cluster AS a, l_partkey % 7 AS b, sum(delta) AS s, count(*) AS n FROM p GROUP BY 1, 2), da AS (SELECT r AS resample, " + HASH.format(f"'{SEED}:' || r || ':' || k") + f" % 25 AS a, count(*) AS ta FROM range({B}) t(r), range(25) u(k) GROUP BY 1, 2), db AS (SELECT r AS resample, " + HASH.format(f"'{SEED + 1}:' || r || ':' || k") + f" % 7 AS b, count(*) AS tb FROM range({B}) t(r), range(7) u(k) GROUP BY 1, 2) SELECT resample, round(sum(s * ta * tb) / sum(n * ta * tb), 9) AS mean FROM x JOIN da USING (a) JOIN db USING (resample, b) GROUP BY 1")
def b6(spark, d):
    x = paired(spark, d).groupBy(F.col("cluster").cast("int").alias("a"), (F.col("l_partkey") % 7).cast("int").alias("b")).agg(F.sum("delta").alias("s"), F.count("*").alias("n"))
    da = draws(spark, B, 25, SEED).select("resample", F.col("index").alias("a"), F.col("times").alias("ta"))
    db = draws(spark, B, 7, SEED + 1).select("resample", F.col("index").alias("b"), F.col("times").alias("tb"))
    w = F.col("ta") * F.col("tb")
    return da.join(x, "a").join(db, ["resample", "b"]).groupBy("resample").agg(F.round(F.sum(F.col("s") * w) / F.sum(F.col("n") * w), 9).alias("mean"))


@query("b7_least_squares", "SELECT round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def b7(spark, d):
    sums = normal_sums(table(spark, d, "lineitem"), "l_suppkey", [F.col("l_quantity")], F.col("l_extendedprice"))
    one = sums.agg(add_arrays("xx", 3).alias("xx"), add_arrays("xy", 2).alias("xy"))
    return one.select(solved("xx", "xy").alias("w")).select(F.round(F.col("w")[1], 5).alias("slope"), F.round(F.col("w")[0], 4).alias("intercept"))


@query("b8_interaction_model")
def b8(spark, d):
    """Discount on arm, centred log price and their product, with cluster resamples."""
    lines = table(spark, d, "lineitem").filter("l_returnflag in ('A', 'R')")
    centre = lines.agg(F.avg(F.log("l_extendedprice")).alias("m"))  # one row
    lines = lines.crossJoin(F.broadcast(centre)).withColumn("z", F.log("l_extendedprice") - F.col("m")).withColumn("arm", (F.col("l_returnflag") == "A").cast("double"))
    sums = normal_sums(lines.withColumn("cluster", F.col("l_suppkey") % 25), "cluster", [F.col("arm"), F.col("z"), F.col("arm") * F.col("z")], F.col("l_discount"))
    sums = sums.withColumn("index", F.dense_rank().over(Window.orderBy("cluster")) - 1)  # 25 clusters
    drawn = draws(spark, B, 25, SEED).join(F.broadcast(sums), "index")
    fits = drawn.groupBy("resample").agg(add_arrays("xx", 10, F.col("times")).alias("xx"), add_arrays("xy", 4, F.col("times")).alias("xy"))
    return fits.select("resample", solved("xx", "xy").alias("w")).select("resample", F.posexplode("w").alias("term", "coefficient"))


@query("b9_metric_grid", """WITH v AS (SELECT l_linestatus AS cell, 'discount' AS metric, l_suppkey % 25 AS c, l_discount AS x FROM lineitem UNION ALL SELECT l_linestatus, 'tax', l_suppkey % 25, l_tax FROM lineitem),
s AS (SELECT cell, metric, c AS index, sum(x) AS s, count(*) AS n FROM v GROUP BY ALL), d AS (SELECT r AS resample, """ + HASH.format(f"'{SEED}:' || r || ':' || k") + f""" % 25 AS index FROM range({B}) t(r), range(25) u(k)), m AS (SELECT cell, metric, resample, sum(s) / sum(n) AS mean FROM d JOIN s USING (index) GROUP BY ALL)
SELECT cell, metric, round(quantile_cont(mean, 0.025), 8) AS lo, round(quantile_cont(mean, 0.975), 8) AS hi FROM m GROUP BY 1, 2""")
def b9(spark, d):
    melted = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("cell"), (F.col("l_suppkey") % 25).alias("c"), F.expr("stack(2, 'discount', l_discount, 'tax', l_tax) as (metric, x)"))
    keys = ("cell", "metric")
    ci = interval(bootstrap_means(cluster_sums(melted, "c", F.col("x"), keys), draws(spark, B, 25, SEED), keys), keys)
    return ci.select(*keys, F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"))


@query("b11_stratified", """WITH c AS (SELECT l_returnflag AS stratum, l_suppkey % 20 AS index, sum(l_discount) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT stratum, ord FROM (VALUES ('A', 1), ('N', 2), ('R', 3)) v(stratum, ord)),
d AS (SELECT stratum, r AS resample, """ + HASH.format("(100 + ord) || ':' || r || ':' || k") + f""" % 20 AS index FROM t, range({B}) a(r), range(20) b(k))
SELECT resample, round(sum(s) / sum(n), 9) AS mean FROM d JOIN c USING (stratum, index) GROUP BY 1""")
def b11(spark, d):
    sums = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("stratum"), (F.col("l_suppkey") % 20).cast("int").alias("index")).agg(F.sum("l_discount").alias("s"), F.count("*").alias("n"))
    drawn = None
    for order, stratum in enumerate("ANR", 1):
        own = draws(spark, B, 20, 100 + order).withColumn("stratum", F.lit(stratum))
        drawn = own if drawn is None else drawn.unionByName(own)
    rows = drawn.join(F.broadcast(sums), ["stratum", "index"])
    return rows.groupBy("resample").agg(F.round(F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times")), 9).alias("mean"))


@query("b12_remapped_keys", PAIRS.split("c AS (")[0].rstrip().rstrip(",") + " SELECT 'k' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS key, round(delta, 8) + 0.0 AS delta FROM p")
def b12(spark, d):
    return paired(spark, d).select(F.concat(F.lit("k"), F.lpad(F.col("l_partkey").cast("string"), 6, "0")).alias("key"), (F.round("delta", 8) + 0.0).alias("delta"))


@query("b15_delta_of_deltas", PAIRS + " SELECT round(avg(mean - mean_a), 9) AS second_difference FROM m")
def b15(spark, d):
    a, b = resampled(spark, d), resampled(spark, d, "va").withColumnRenamed("mean", "mean_a")
    return a.join(b, "resample").agg(F.round(F.avg(F.col("mean") - F.col("mean_a")), 9).alias("second_difference"))


@query("z56_dense_index", "SELECT source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS index FROM (SELECT DISTINCT source FROM documents)")
def z56(spark, d):
    names = table(spark, d, "documents").select("source").distinct()
    return names.select("source", (F.dense_rank().over(Window.orderBy("source")) - 1).alias("index"))


@query("b10_draws_by_count", """WITH c AS (SELECT (l_suppkey % 25) % 3 AS cell, l_suppkey % 25 AS c, sum(l_discount) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2),
i AS (SELECT *, dense_rank() OVER (PARTITION BY cell ORDER BY c) - 1 AS index, count(*) OVER (PARTITION BY cell) AS k FROM c),
d AS (SELECT k, r AS resample, """ + HASH.format(f"'{SEED}:' || r || ':' || u") + f""" % k AS index FROM (SELECT DISTINCT k FROM i), range({B}) a(r), range(25) b(u) WHERE u < k),
m AS (SELECT cell, k, resample, sum(s) / sum(n) AS mean FROM d JOIN i USING (k, index) GROUP BY ALL)
SELECT cell, k AS clusters, round(quantile_cont(mean, 0.025), 8) AS lo, round(quantile_cont(mean, 0.975), 8) AS hi FROM m GROUP BY 1, 2""")
def b10(spark, d):
    rows = table(spark, d, "lineitem").withColumns({"c": F.col("l_suppkey") % 25, "cell": F.col("l_suppkey") % 25 % 3})
    sums = cluster_sums(rows, "c", F.col("l_discount"), ("cell",))
    sums = sums.withColumn("clusters", F.count("*").over(Window.partitionBy("cell")).cast("int"))
    rows = sums.join(draws_by_count(sums, B, SEED), ["clusters", "index"])
    means = rows.groupBy("cell", "clusters", "resample").agg(F.try_divide(F.sum(F.col("s") * F.col("times")), F.sum(F.col("n") * F.col("times"))).alias("mean"))
    return interval(means, ("cell", "clusters")).select("cell", "clusters", F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"))


ANALYSIS = """WITH g AS (SELECT l_partkey AS p, l_returnflag AS arm, avg(l_discount) AS discount, avg(l_tax) AS tax, (avg(l_quantity) >= 25)::INT::DOUBLE AS complete FROM lineitem GROUP BY 1, 2),
e AS (SELECT * FROM g WHERE p IN (SELECT p FROM g GROUP BY 1 HAVING count(*) = 3)), u AS (UNPIVOT e ON discount, tax, complete INTO NAME metric VALUE x),
v AS (SELECT unnest(['B' || p % 3, 'ALL']) AS cell, arm, metric, p % 25 AS a, p % 7 AS b, x FROM u), s AS (SELECT cell, arm, metric, a, b, sum(x) AS s, count(*) AS n FROM v GROUP BY ALL),
da AS (SELECT r AS resample, """ + HASH.format(f"'{SEED}:' || r || ':' || k") + f""" % 25 AS a, count(*) AS ta FROM range({B}) t(r), range(25) q(k) GROUP BY 1, 2),
db AS (SELECT r AS resample, """ + HASH.format(f"'{SEED + 1}:' || r || ':' || k") + f""" % 7 AS b, count(*) AS tb FROM range({B}) t(r), range(7) q(k) GROUP BY 1, 2),
j AS (SELECT s.*, resample, ta, coalesce(tb, 0) AS tb FROM s JOIN da USING (a) LEFT JOIN db USING (resample, b)),
m AS (SELECT cell, metric, arm, 'source' AS method, resample, sum(s * ta) / nullif(sum(n * ta), 0) AS mean FROM j GROUP BY ALL UNION ALL SELECT cell, metric, arm, 'crossed', resample, sum(s * ta * tb) / nullif(sum(n * ta * tb), 0) FROM j GROUP BY ALL),
pt AS (SELECT cell, metric, arm, sum(s) / sum(n) AS estimate, CAST(sum(n) AS BIGINT) AS n_attempts FROM s GROUP BY ALL),
ct AS (SELECT * FROM (VALUES ('A', 'N'), ('A', 'R')) c(arm_a, arm_b)),
x AS (SELECT cell, metric, method, arm AS arm_a, NULL::VARCHAR AS arm_b, mean FROM m UNION ALL SELECT l.cell, l.metric, l.method, arm_a, arm_b, l.mean - r.mean FROM ct JOIN m l ON l.arm = arm_a JOIN m r ON r.arm = arm_b AND r.cell = l.cell AND r.metric = l.metric AND r.method = l.method AND r.resample = l.resample),
iv AS (SELECT cell, metric, method, arm_a, arm_b, round(quantile_cont(mean, 0.025), 8) + 0.0 AS lo, round(quantile_cont(mean, 0.975), 8) + 0.0 AS hi, count(mean) AS n_valid, count(*) - count(mean) AS n_empty FROM x GROUP BY ALL),
pay AS (SELECT iv.*, round(l.estimate - coalesce(r.estimate, 0), 8) + 0.0 AS estimate, l.n_attempts FROM iv JOIN pt l ON l.cell = iv.cell AND l.metric = iv.metric AND l.arm = iv.arm_a LEFT JOIN pt r ON r.cell = iv.cell AND r.metric = iv.metric AND r.arm = iv.arm_b)"""


def payload(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("arm"))
    items = lines.agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), (F.avg("l_quantity") >= 25).cast("double").alias("complete"))
    paired_items = items.groupBy("p").agg(F.count("*").alias("arms")).filter("arms = 3").select("p")
    items = items.join(paired_items, "p", "left_semi")
    cells = F.explode(F.array(F.concat(F.lit("B"), (F.col("p") % 3).cast("string")), F.lit("ALL"))).alias("cell")
    melted = items.select(cells, "p", "arm", F.expr("stack(3, 'discount', discount, 'tax', tax, 'complete', complete) as (metric, x)"))
    values = melted.groupBy("cell", "arm", "metric", (F.col("p") % 25).cast("int").alias("a"), (F.col("p") % 7).cast("int").alias("b")).agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    out = analysis(values, draws(spark, B, 25, SEED), draws(spark, B, 7, SEED + 1), [("A", "N"), ("A", "R")])
    return out.select("cell", "metric", "method", "arm_a", "arm_b", *((F.round(c, 8) + 0.0).alias(c) for c in ("estimate", "lo", "hi")), "n_valid", "n_empty", "n_attempts")


@query("b13_analysis_payload", ANALYSIS + " SELECT * FROM pay")
def b13(spark, d):
    return payload(spark, d)


@query("b14_content_only", ANALYSIS + " SELECT * EXCLUDE (n_attempts) FROM pay WHERE metric <> 'complete'")
def b14(spark, d):
    return content_only(payload(spark, d), ("complete",))
