"""Aggregation queries: rollups, missing and infinite values, medians, histograms, comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.aggregates import compare_tables, finite_mean, histogram, macro_micro, order_statistic, upper_median, with_all
from .base import query, table


@query("a1_group_rollup", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT lang) AS n_langs, count(DISTINCT text) AS n_texts FROM documents GROUP BY source")
def a1(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_distinct("lang").alias("n_langs"), F.count_distinct("text").alias("n_texts"))


@query("a2_channel_profile", """
SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars, count_if(n_chars >= 1000) AS n_long, count(DISTINCT CASE WHEN quality = 1 THEN lang END) AS good_langs,
  array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def a2(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    langs = F.array_join(F.sort_array(F.collect_set("lang")), ",")
    return df.groupBy("source").agg(F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") >= 1000).alias("n_long"), F.count_distinct(F.when(F.col("quality") == 1, F.col("lang"))).alias("good_langs"), langs.alias("langs"))


DIRTY = "CASE WHEN l_orderkey % 13 = 0 THEN 'Infinity'::DOUBLE WHEN l_orderkey % 17 = 0 THEN 'NaN'::DOUBLE WHEN l_orderkey % 19 = 0 THEN NULL ELSE l_discount END"


def dirty():
    k = F.col("l_orderkey")
    return F.when(k % 13 == 0, F.lit(float("inf"))).when(k % 17 == 0, F.lit(float("nan"))).when(k % 19 == 0, F.lit(None)).otherwise(F.col("l_discount"))


@query("a3_finite_mean", f"""
WITH x AS (SELECT l_returnflag, l_orderkey % 13 = 0 AND l_linenumber = 7 AS only_inf, {DIRTY} AS v FROM lineitem)
SELECT l_returnflag, only_inf, round(CASE WHEN count_if(isfinite(v)) > 0 THEN avg(v) FILTER (WHERE isfinite(v)) WHEN count_if(isinf(v)) > 0 THEN 'Infinity'::DOUBLE END, 6) AS v_mean,
  count_if(isfinite(v)) AS v_mean_n_finite, count_if(isinf(v)) AS v_mean_n_inf, count_if(v IS NULL OR isnan(v)) AS v_mean_n_missing FROM x GROUP BY 1, 2""")
def a3(spark, d):
    only = (F.col("l_orderkey") % 13 == 0) & (F.col("l_linenumber") == 7)
    out = table(spark, d, "lineitem").groupBy("l_returnflag", only.alias("only_inf")).agg(*finite_mean(dirty(), "v_mean"))
    return out.withColumn("v_mean", F.round("v_mean", 6))


@query("a4_macro_micro", """
WITH x AS (SELECT l_returnflag, CAST(l_quantity AS BIGINT) - 1 AS e, CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS n FROM lineitem),
r AS (SELECT *, CASE WHEN n > 0 THEN e / n WHEN e > 0 THEN 'Infinity'::DOUBLE ELSE 0 END AS rate FROM x)
SELECT l_returnflag, round(avg(rate) FILTER (WHERE isfinite(rate)), 6) AS macro, count_if(isfinite(rate)) AS macro_n_finite, count_if(isinf(rate)) AS macro_n_inf, 0 AS macro_n_missing, round(sum(e) / sum(n), 6) AS micro FROM r GROUP BY 1""")
def a4(spark, d):
    q = F.col("l_quantity").cast("long")
    out = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*macro_micro(q - 1, F.when(F.col("l_linenumber") == 7, 0).otherwise(q)))
    return out.withColumns({"macro": F.round("macro", 6), "micro": F.round("micro", 6)})


@query("a5_group_bucket_all", """
SELECT l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN 'ALL' ELSE l_linestatus END AS l_linestatus, count(*) AS n, round(avg(l_discount), 6) AS mean_discount
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))""")
def a5(spark, d):
    return with_all(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("mean_discount"))


STATUSES = ["click", "view", "purchase", "refund"]


@query("a6_status_histogram", "SELECT user_id, count_if(event_type = 'click') AS click, count_if(event_type = 'view') AS view, count_if(event_type = 'purchase') AS purchase, count_if(event_type = 'refund') AS refund FROM events GROUP BY user_id")
def a6(spark, d):
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", STATUSES).count().fillna(0)


@query("a7_median", "SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS median_price FROM lineitem GROUP BY 1, 2")
def a7(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.median("l_extendedprice").alias("median_price"))


@query("a7b_upper_median", "SELECT o_custkey, list_sort(list(o_totalprice))[len(list(o_totalprice)) // 2 + 1] AS upper_median FROM orders GROUP BY 1")
def a7b(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(upper_median(F.col("o_totalprice")).alias("upper_median"))


@query("a8_percentiles", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0) AS p0, quantile_cont(l_extendedprice, 0.05) AS p5, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95, quantile_cont(l_extendedprice, 1) AS p100 FROM lineitem GROUP BY 1")
def a8(spark, d):
    p = F.percentile("l_extendedprice", F.array(*map(F.lit, (0.0, 0.05, 0.5, 0.95, 1.0))))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(p.alias("p")).select("l_returnflag", *(F.col("p")[k].alias(f"p{q}") for k, q in enumerate((0, 5, 50, 95, 100))))


@query("a9_order_statistics", """
WITH s AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY 1)
SELECT o_custkey, v[CAST(floor((len(v) - 1) * 0.9) AS BIGINT) + 1] AS p90_inner, v[CAST(least(len(v) - 1, floor(len(v) * 0.9)) AS BIGINT) + 1] AS p90_outer FROM s""")
def a9(spark, d):
    x = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy("o_custkey").agg(order_statistic(x, 0.9).alias("p90_inner"), order_statistic(x, 0.9, True).alias("p90_outer"))


@query("a10_summary", "SELECT event_type, count(*) AS n, min(value) AS low, median(value) AS middle, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a10(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.median("value").alias("middle"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))


@query("a11_step_log", "SELECT user_id, count(*) AS steps, round(avg(value), 6) AS mean, median(value) AS middle, round(stddev_pop(value), 6) AS sd, round(sum(value), 4) AS total FROM events GROUP BY 1")
def a11(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("steps"), F.round(F.avg("value"), 6).alias("mean"), F.median("value").alias("middle"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.round(F.sum("value"), 4).alias("total"))


@query("a12_histogram", """
WITH b AS (SELECT * FROM (VALUES (0, 0.0, 500.0), (1, 500.0, 1000.0), (2, 1000.0, 5000.0), (3, 5000.0, 20000.0), (4, 20000.0, 200000.0)) t(bin, low, high)),
g AS (SELECT DISTINCT lang FROM documents)
SELECT lang, bin, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, (SELECT count(*) FROM documents x WHERE x.lang = g.lang AND n_chars >= low AND (n_chars < high OR (bin = 4 AND n_chars = high))) AS n FROM g, b""")
def a12(spark, d):
    return histogram(table(spark, d, "documents"), F.col("n_chars"), [0, 500, 1000, 5000, 20000, 200000], "lang")


@query("a13_source_rollup", "SELECT source, lang, count(*) AS n, count(DISTINCT doc_id // 10) AS n_parents, round(sum(n_chars) / 1000.0, 3) AS kchars FROM documents GROUP BY 1, 2")
def a13(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_distinct(F.floor(F.col("doc_id") / 10)).alias("n_parents"), F.round(F.sum("n_chars") / 1000.0, 3).alias("kchars"))


@query("a14_reconciliation", """
SELECT count(*) AS n, count_if(n_chars < 500) AS n_short, count_if(lang <> 'en') AS n_foreign, count_if(n_chars < 500 AND lang <> 'en') AS n_both FROM documents d ANTI JOIN labels l USING (doc_id)""")
def a14(spark, d):
    rest = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti")
    short, foreign = F.col("n_chars") < 500, F.col("lang") != "en"
    return rest.agg(F.count("*").alias("n"), F.count_if(short).alias("n_short"), F.count_if(foreign).alias("n_foreign"), F.count_if(short & foreign).alias("n_both"))


@query("a15_tails", """
WITH t AS (SELECT unnest([500, 1000, 5000, 20000]) AS threshold)
SELECT threshold, count_if(n_chars > threshold) AS n_over, round(count_if(n_chars > threshold) / count(*), 6) AS share_rows, round(coalesce(sum(n_chars) FILTER (WHERE n_chars > threshold), 0) / sum(n_chars), 6) AS share_chars FROM documents, t GROUP BY 1""")
def a15(spark, d):
    levels = [500, 1000, 5000, 20000]
    n = F.col("n_chars")
    one = table(spark, d, "documents").agg(F.count("*").alias("rows"), F.sum(n).alias("chars"), *(F.count_if(n > t).alias(f"n{t}") for t in levels), *(F.coalesce(F.sum(F.when(n > t, n)), F.lit(0)).alias(f"s{t}") for t in levels))
    cells = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{t}").alias("n_over"), F.round(F.col(f"n{t}") / F.col("rows"), 6).alias("share_rows"), F.round(F.col(f"s{t}") / F.col("chars"), 6).alias("share_chars")) for t in levels))
    return one.select(F.inline(cells))


@query("a16_perf_rollup", "SELECT event_type, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.9) AS p90, max(value) AS top, round(avg(value / 24.0), 6) AS rate FROM events GROUP BY 1")
def a16(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("med"), F.percentile("value", F.lit(0.9)).alias("p90"), F.max("value").alias("top"), F.round(F.avg(F.col("value") / 24.0), 6).alias("rate"))


@query("a17_denominators", """
WITH x AS (SELECT l_extendedprice AS v, l_quantity * 1000 AS a, l_quantity * 1400 AS b, l_partkey * 1.0 AS c FROM lineitem)
SELECT count(*) AS n, count_if(abs(v - a) / v < 0.01) AS by_a, count_if(abs(v - b) / v < 0.01) AS by_b, count_if(abs(v - c) / v < 0.01) AS by_c FROM x""")
def a17(spark, d):
    v, q = F.col("l_extendedprice"), F.col("l_quantity")
    near = lambda c: F.count_if(F.abs(v - c) / v < 0.01)
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), near(q * 1000).alias("by_a"), near(q * 1400).alias("by_b"), near(F.col("l_partkey") * 1.0).alias("by_c"))


@query("a18_ratio_of_totals", "SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 6) AS ratio_of_totals, round(median(l_extendedprice / l_quantity), 6) AS median_of_ratios FROM lineitem GROUP BY 1")
def a18(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("ratio_of_totals"), F.round(F.median(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("median_of_ratios"))


@query("a19_paired_difference", """
WITH g AS (SELECT l_partkey, avg(l_discount) FILTER (WHERE l_returnflag = 'A') AS a, avg(l_discount) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem GROUP BY 1)
SELECT count(*) AS n_keys, count_if(a IS NOT NULL AND b IS NOT NULL) AS n_paired, round(avg(a - b), 6) AS mean_delta FROM g""")
def a19(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey").pivot("l_returnflag", ["A", "R"]).agg(F.avg("l_discount"))
    return g.agg(F.count("*").alias("n_keys"), F.count_if(F.col("A").isNotNull() & F.col("R").isNotNull()).alias("n_paired"), F.round(F.avg(F.col("A") - F.col("R")), 6).alias("mean_delta"))


@query("a20_transitions", "SELECT a.event_type AS before, b.event_type AS after, count(*) AS n FROM events a JOIN events b ON b.event_id = a.event_id + 1 GROUP BY 1, 2")
def a20(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    nxt = e.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("after"))
    return e.join(nxt, "event_id").groupBy(F.col("event_type").alias("before"), "after").agg(F.count("*").alias("n"))


@query("a21_non_inferiority", """
WITH g AS (SELECT l_suppkey, avg(l_discount) AS m FROM lineitem GROUP BY 1), b AS (SELECT m AS base FROM g WHERE l_suppkey = 1)
SELECT l_suppkey, round(m - base, 8) AS gap, m - base <= 0.002 AS non_inferior FROM g, b WHERE l_suppkey <> 1""")
def a21(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("m"))
    base = g.filter("l_suppkey = 1").select(F.col("m").alias("base"))  # one row
    gap = F.col("m") - F.col("base")
    return g.filter("l_suppkey <> 1").crossJoin(F.broadcast(base)).select("l_suppkey", F.round(gap, 8).alias("gap"), (gap <= 0.002).alias("non_inferior"))


@query("a22_table_equality", """
WITH a AS (SELECT l_suppkey, round(avg(l_discount), 9) AS m, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, m + CASE WHEN l_suppkey % 10 = 0 THEN 1e-3 ELSE 0 END AS m, n FROM a WHERE l_suppkey <> 5),
c AS (SELECT l_suppkey, 'm' AS field, a.m AS l, b.m AS r FROM a FULL JOIN b USING (l_suppkey) UNION ALL SELECT l_suppkey, 'n', a.n, b.n FROM a FULL JOIN b USING (l_suppkey))
SELECT l_suppkey, field, round(l, 6) AS left, round(r, 6) AS right FROM c WHERE l IS NULL <> r IS NULL OR abs(l - r) > 1e-9""")
def a22(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 9).alias("m"), F.count("*").alias("n"))
    b = a.filter("l_suppkey <> 5").withColumn("m", F.col("m") + F.when(F.col("l_suppkey") % 10 == 0, 1e-3).otherwise(0.0))
    return compare_tables(a, b, ["l_suppkey"], ["m", "n"]).withColumns({"left": F.round("left", 6), "right": F.round("right", 6)})


@query("a23_macro_micro_gap", """
WITH g AS (SELECT l_suppkey, l_linestatus, abs(avg(l_discount / l_quantity) - sum(l_discount) / sum(l_quantity)) AS gap FROM lineitem GROUP BY 1, 2)
SELECT l_linestatus, round(max(gap), 8) AS widest, arg_max(l_suppkey, gap) AS at FROM g GROUP BY 1""")
def a23(spark, d):
    gap = F.abs(F.avg(F.col("l_discount") / F.col("l_quantity")) - F.sum("l_discount") / F.sum("l_quantity"))
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(gap.alias("gap"))
    return g.groupBy("l_linestatus").agg(F.round(F.max("gap"), 8).alias("widest"), F.max_by("l_suppkey", "gap").alias("at"))


@query("a24_design_support", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS clusters, count(DISTINCT l_orderkey) AS roots, count(DISTINCT l_partkey) AS texts, count(*) AS attempts FROM lineitem GROUP BY 1")
def a24(spark, d):
    n = lambda c, a: F.count_distinct(c).alias(a)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(n("l_suppkey", "clusters"), n("l_orderkey", "roots"), n("l_partkey", "texts"), F.count("*").alias("attempts"))


@query("a25_budget_match", """
WITH g AS (SELECT l_suppkey, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem GROUP BY 1)
SELECT round(avg(a / b), 6) AS mean_ratio, round(avg(abs(a / b - 1)), 6) AS deviation, count_if(abs(a / b - 1) <= 0.1) AS n_within FROM g""")
def a25(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "R"]).agg(F.sum("l_quantity"))
    ratio = F.col("A") / F.col("R")
    return g.agg(F.round(F.avg(ratio), 6).alias("mean_ratio"), F.round(F.avg(F.abs(ratio - 1)), 6).alias("deviation"), F.count_if(F.abs(ratio - 1) <= 0.1).alias("n_within"))


@query("a26_epochs", """
WITH x AS (SELECT user_id, event_id, sum(1 + event_id % 3) OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM events), y AS (SELECT user_id, (seen - 1) // 24 AS epoch, max(seen) AS last FROM x GROUP BY ALL)
SELECT user_id, CAST(epoch AS BIGINT) AS epoch, CAST(last AS BIGINT) AS seen, last % 24 = 0 AS exact FROM y""")
def a26(spark, d):
    seen = F.sum(1 + F.col("event_id") % 3).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    x = table(spark, d, "events").select("user_id", seen.alias("seen"))
    return x.groupBy("user_id", F.floor((F.col("seen") - 1) / 24).alias("epoch")).agg(F.max("seen").alias("seen")).withColumn("exact", F.col("seen") % 24 == 0)


@query("a27_punctuation_density", "SELECT lang, round(sum(len(regexp_extract_all(text, '[.,;:!?]'))) / sum(len(string_split_regex(trim(text), '[ \\t\\n\\r]+'))), 6) AS density FROM documents GROUP BY 1")
def a27(spark, d):
    words = F.size(F.split(F.trim("text"), r"[ \t\n\r]+"))
    return table(spark, d, "documents").groupBy("lang").agg(F.round(F.sum(F.regexp_count("text", F.lit("[.,;:!?]"))) / F.sum(words), 6).alias("density"))
