"""Analysis and integrity queries that compose the other operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import BLANK, words
from ..operators.aggregates import finite_mean, upper_median
from ..operators.funnel import violations
from ..operators.sequences import top_per_group
from .base import query, table


@query("z1_guarded_ratios", "SELECT l_returnflag, round(sum(l_extendedprice) / nullif(sum(CASE WHEN l_linenumber > 8 THEN 1 ELSE 0 END), 0), 6) AS ratio, count_if(l_quantity >= 50) AS cap_hits, round(avg(l_extendedprice / nullif(l_quantity - 1, 0)), 4) AS rate FROM lineitem GROUP BY 1")
def z1(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.try_divide(F.sum("l_extendedprice"), F.sum((F.col("l_linenumber") > 8).cast("long"))), 6).alias("ratio"), F.count_if(q >= 50).alias("cap_hits"), F.round(F.avg(F.try_divide(F.col("l_extendedprice"), q - 1)), 4).alias("rate"))


@query("z2_system_rollup", "SELECT user_id % 10 AS system, round(sum(value), 4) AS wall, count_if(event_type = 'error') AS n_error, count_if(event_type = 'click') AS n_click, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY 1")
def z2(spark, d):
    e = table(spark, d, "events")
    g = e.groupBy((F.col("user_id") % 10).alias("system")).agg(F.sum("value").alias("wall"), F.count_if(F.col("event_type") == "error").alias("n_error"), F.count_if(F.col("event_type") == "click").alias("n_click"))
    total = e.agg(F.sum("value").alias("total"))  # one row
    return g.crossJoin(F.broadcast(total)).select("system", F.round("wall", 4).alias("wall"), "n_error", "n_click", F.round(F.col("wall") / F.col("total"), 6).alias("share"))


@query("z3_finite_rollup", "SELECT user_id % 5 AS cell, round(avg(value / nullif(event_id % 3, 0)), 6) AS v, count(value / nullif(event_id % 3, 0)) AS v_n_finite, 0 AS v_n_inf, count_if(event_id % 3 = 0) AS v_n_missing FROM events GROUP BY 1")
def z3(spark, d):
    x = F.try_divide(F.col("value"), F.col("event_id") % 3)
    return table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("cell")).agg(*finite_mean(x, "v")).withColumn("v", F.round("v", 6))


@query("z4_voice_rollup", "WITH g AS (SELECT l_partkey, avg(l_tax) FILTER (WHERE l_linestatus = 'O') AS o, avg(l_tax) FILTER (WHERE l_linestatus = 'F') AS f FROM lineitem GROUP BY 1) SELECT count(o) AS n_o, count(f) AS n_f, count(o - f) AS n_both, round(avg(o - f), 8) AS difference, round(median(o - f), 8) AS middle FROM g")
def z4(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey").pivot("l_linestatus", ["O", "F"]).agg(F.avg("l_tax"))
    delta = F.col("O") - F.col("F")
    return g.agg(F.count("O").alias("n_o"), F.count("F").alias("n_f"), F.count(delta).alias("n_both"), F.round(F.avg(delta), 8).alias("difference"), F.round(F.median(delta), 8).alias("middle"))


@query("z5_split_context", "SELECT round(sum(n_chars) FILTER (WHERE source = 'src0') / sum(n_chars), 6) AS catalogue_share, CAST(sum(n_chars) FILTER (WHERE doc_id % 10 = 0) AS BIGINT) AS held_chars, CAST(sum(n_chars) FILTER (WHERE doc_id % 10 > 0) AS BIGINT) AS train_chars FROM documents")
def z5(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").agg(F.round(F.sum(F.when(F.col("source") == "src0", n)) / F.sum(n), 6).alias("catalogue_share"), F.sum(F.when(F.col("doc_id") % 10 == 0, n)).alias("held_chars"), F.sum(F.when(F.col("doc_id") % 10 > 0, n)).alias("train_chars"))


@query("z6_named_cases", "SELECT lang, arg_max(doc_id, n_chars * 1000000 - doc_id) AS longest, arg_min(doc_id, n_chars * 1000000 + doc_id) AS shortest FROM documents GROUP BY 1")
def z6(spark, d):
    n, i = F.col("n_chars") * 1000000, F.col("doc_id")
    return table(spark, d, "documents").groupBy("lang").agg(F.max_by("doc_id", n - i).alias("longest"), F.min_by("doc_id", n + i).alias("shortest"))


@query("z8_exposure", "SELECT event_type, count_if(value > 90) AS n_over, count_if(event_id % 4 = 0) AS n_no_floor, count_if(value > 90 AND event_type <> 'error') AS n_bad_complete, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE value > 99.5), '') AS listed FROM events GROUP BY 1")
def z8(spark, d):
    over = F.col("value") > 90
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("value") > 99.5, F.col("event_id")))), lambda x: x.cast("string")), ",")
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(over).alias("n_over"), F.count_if(F.col("event_id") % 4 == 0).alias("n_no_floor"), F.count_if(over & (F.col("event_type") != "error")).alias("n_bad_complete"), listed.alias("listed"))


@query("z9_detail_listing", "SELECT source, doc_id, n_chars FROM documents WHERE source IN ('src1', 'src2') ORDER BY source, n_chars DESC, doc_id")
def z9(spark, d):
    return table(spark, d, "documents").filter(F.col("source").isin("src1", "src2")).select("source", "doc_id", "n_chars").orderBy("source", F.desc("n_chars"), "doc_id")


@query("z10_run_comparison", "WITH p AS (SELECT a.event_type = b.event_type AS same, a.event_type <> 'click' AND b.event_type <> 'click' AS both_incomplete, b.value - a.value AS delta FROM events a JOIN events b ON b.event_id = a.event_id + 1) SELECT count(*) AS n, count_if(same) AS n_same, count_if(both_incomplete) AS n_incomplete, median(delta) AS middle, min(delta) AS low, max(delta) AS high FROM p")
def z10(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    b = e.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("t2"), F.col("value").alias("v2"))
    delta = F.col("v2") - F.col("value")
    return e.join(b, "event_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == F.col("t2")).alias("n_same"), F.count_if((F.col("event_type") != "click") & (F.col("t2") != "click")).alias("n_incomplete"), F.median(delta).alias("middle"), F.min(delta).alias("low"), F.max(delta).alias("high"))


@query("z11_snapshot_gap", "SELECT l_suppkey, round(avg(l_tax) FILTER (WHERE l_linenumber >= 4) - avg(l_tax) FILTER (WHERE l_linenumber < 4), 8) AS gap FROM lineitem GROUP BY 1")
def z11(spark, d):
    late = F.col("l_linenumber") >= 4
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(F.when(late, F.col("l_tax"))) - F.avg(F.when(~late, F.col("l_tax"))), 8).alias("gap"))


@query("z12_log_span", r"""SELECT user_id, CAST(sum(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS k_total, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS span_hours FROM events GROUP BY 1""")
def z12(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("long")).alias("k_total"), F.round((F.max(us) - F.min(us)) / 3.6e9, 6).alias("span_hours"))


@query("z13_budget_summary", "SELECT user_id % 20 AS run, count(*) AS steps, arg_min(event_id, value * 1e6 + event_id) AS best_step, min(value) AS best_value, count(DISTINCT md5(event_type)) = 5 AS all_types FROM events GROUP BY 1")
def z13(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("run")).agg(F.count("*").alias("steps"), F.min_by("event_id", F.col("value") * 1e6 + F.col("event_id")).alias("best_step"), F.min("value").alias("best_value"), (F.count_distinct("event_type") == 5).alias("all_types"))


@query("z15_paired_onset", "WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events WHERE value < 20 GROUP BY 1, 2) SELECT a.user_id, b.event_type, b.first - a.first AS onset FROM f a JOIN f b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type <> 'click'")
def z15(spark, d):
    f = table(spark, d, "events").filter("value < 20").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    a = f.filter("event_type = 'click'").select("user_id", F.col("first").alias("zero"))
    return f.filter("event_type <> 'click'").join(a, "user_id").select("user_id", "event_type", (F.col("first") - F.col("zero")).alias("onset"))


@query("z17_matched_grid", "WITH g AS (SELECT l_suppkey % 10 AS item, l_linenumber AS seed, l_returnflag AS arm, count(*) AS n, avg(l_tax) AS m FROM lineitem GROUP BY ALL) SELECT item, seed, count(*) AS n_arms, CAST(sum(n) AS BIGINT) AS n, round(max(m) - min(m), 8) AS spread FROM g GROUP BY 1, 2 HAVING count(*) = 3")
def z17(spark, d):
    g = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("item"), F.col("l_linenumber").alias("seed"), F.col("l_returnflag").alias("arm")).agg(F.count("*").alias("n"), F.avg("l_tax").alias("m"))
    return g.groupBy("item", "seed").agg(F.count("*").alias("n_arms"), F.sum("n").alias("n"), F.round(F.max("m") - F.min("m"), 8).alias("spread")).filter("n_arms = 3")


@query("z18_complete_grid", "WITH g AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 90), f AS (SELECT * FROM (SELECT DISTINCT user_id FROM g), (SELECT DISTINCT event_type FROM g)) SELECT user_id, event_type, 'missing' AS problem FROM (SELECT * FROM f EXCEPT SELECT * FROM g)")
def z18(spark, d):
    g = table(spark, d, "events").filter("value > 90").select("user_id", "event_type").distinct()
    design = g.select("user_id").distinct().crossJoin(g.select("event_type").distinct())  # the grid is what is asked for
    return design.exceptAll(g).withColumn("problem", F.lit("missing"))


@query("z19_available_n", "WITH i AS (SELECT user_id, median(value) FILTER (WHERE event_type = 'click' AND value > 50) AS m FROM events GROUP BY 1) SELECT median(m) AS middle, count(m) AS n_available, count(*) - count(m) AS n_missing FROM i")
def z19(spark, d):
    i = table(spark, d, "events").groupBy("user_id").agg(F.median(F.when((F.col("event_type") == "click") & (F.col("value") > 50), F.col("value"))).alias("m"))
    return i.agg(F.median("m").alias("middle"), F.count("m").alias("n_available"), (F.count("*") - F.count("m")).alias("n_missing"))


@query("z21_joined_view_check", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE abs(l_extendedprice - l_quantity * p_retailprice) > 25")
def z21(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.filter(F.abs(F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice")) > 25).select("l_orderkey", "l_linenumber")


@query("z22_task_list", "SELECT source, 'rate' AS kind, count(*) AS expected FROM documents GROUP BY 1 UNION ALL SELECT 'human', 'anchor', count(*) FROM benchmark")
def z22(spark, d):
    rate = table(spark, d, "documents").groupBy("source").agg(F.lit("rate").alias("kind"), F.count("*").alias("expected"))
    return rate.unionByName(table(spark, d, "benchmark").agg(F.lit("human").alias("source"), F.lit("anchor").alias("kind"), F.count("*").alias("expected")))


@query("z23_overfit_set", "WITH f AS (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 32) SELECT doc_id, source FROM documents SEMI JOIN f USING (doc_id)")
def z23(spark, d):
    docs = table(spark, d, "documents")
    return docs.join(docs.orderBy(F.desc("n_chars"), "doc_id").limit(32).select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")


@query("z25_text_substitution", "WITH n AS (SELECT item_id AS doc_id, CASE WHEN item_id % 3 = 0 THEN ' ' ELSE text END AS t FROM benchmark) SELECT count(*) AS n, count_if(nullif(trim(t), '') IS NOT NULL) AS n_new, count_if(n.doc_id IS NOT NULL AND nullif(trim(t), '') IS NULL) AS n_fallback, count_if(n.doc_id IS NULL) AS n_missing, CAST(sum(length(coalesce(nullif(trim(t), ''), text))) AS BIGINT) AS chars FROM documents LEFT JOIN n USING (doc_id)")
def z25(spark, d):
    new = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.when(F.col("item_id") % 3 == 0, " ").otherwise(F.col("text")).alias("t"), F.lit(True).alias("has"))
    j = table(spark, d, "documents").join(new, "doc_id", "left")
    good = F.nullif(F.trim("t"), F.lit(""))
    return j.agg(F.count("*").alias("n"), F.count(good).alias("n_new"), F.count_if(F.col("has").isNotNull() & good.isNull()).alias("n_fallback"), F.count_if(F.col("has").isNull()).alias("n_missing"), F.sum(F.length(F.coalesce(good, F.col("text")))).alias("chars"))


@query("z26_expected_observed", "WITH e AS (SELECT * FROM (VALUES ('en', 600), ('fr', 145), ('xx', 1)) t(lang, expected)), o AS (SELECT lang, count(*) AS observed FROM documents GROUP BY 1) SELECT lang, expected, observed FROM e FULL JOIN o USING (lang) WHERE expected IS DISTINCT FROM observed")
def z26(spark, d):
    e = spark.createDataFrame([("en", 600), ("fr", 145), ("xx", 1)], "lang string, expected int")
    o = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("observed"))
    return e.join(o, "lang", "full").filter(~F.col("expected").eqNullSafe(F.col("observed"))).select("lang", "expected", "observed")


@query("z27_freshness_diff", "WITH a AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT source, CASE WHEN source = 'src3' THEN n + 1 ELSE n END AS n FROM a) SELECT 'stale' AS side, source, n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT 'fresh', source, n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)")
def z27(spark, d):
    a = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    b = a.withColumn("n", F.when(F.col("source") == "src3", F.col("n") + 1).otherwise(F.col("n")))
    return b.exceptAll(a).select(F.lit("stale").alias("side"), "source", "n").unionByName(a.exceptAll(b).select(F.lit("fresh").alias("side"), "source", "n"))


@query("z28_packing_ratio", "SELECT source, CAST(sum(n_chars) AS BIGINT) AS tokens, count(*) * max(n_chars) AS padded, round(sum(n_chars) / (count(*) * max(n_chars)), 6) AS ratio FROM documents GROUP BY 1")
def z28(spark, d):
    padded = F.count("*") * F.max("n_chars")
    return table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("tokens"), padded.alias("padded"), F.round(F.sum("n_chars") / padded, 6).alias("ratio"))


@query("z32_prefix_contract", "WITH c AS (SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS t FROM conversations), n AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c) SELECT count(*) AS n, count_if(p IS NOT NULL AND NOT starts_with(t, p)) AS n_broken, max(length(t)) AS longest FROM n")
def z32(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("text").over(w.rowsBetween(Window.unboundedPreceding, 0)), " ").alias("t"))
    n = c.withColumn("p", F.lag("t").over(w))
    return n.agg(F.count("*").alias("n"), F.count_if(F.col("p").isNotNull() & ~F.startswith("t", F.col("p"))).alias("n_broken"), F.max(F.length("t")).alias("longest"))


@query("z33_seal", "SELECT doc_id, sha256(text) AS seal, sha256(text) = sha256(CASE WHEN doc_id = 3 THEN text || '.' ELSE text END) AS intact FROM documents")
def z33(spark, d):
    changed = F.when(F.col("doc_id") == 3, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("seal"), (F.sha2("text", 256) == F.sha2(changed, 256)).alias("intact"))


@query("z37_support_gate", "WITH x AS (SELECT user_id, event_id, row_number() OVER w AS k, sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS support FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, CAST(support AS BIGINT) AS support FROM x WHERE k % 10 = 0 AND support >= 7")
def z37(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    x = table(spark, d, "events").select("event_id", F.row_number().over(w).alias("k"), F.sum((F.col("value") > 30).cast("long")).over(w.rowsBetween(-9, 0)).alias("support"))
    return x.filter("k % 10 = 0 and support >= 7").select("event_id", "support")


@query("z40_binding_cap", "SELECT doc_id, least(4096, n_chars * 2 + 50) AS cap, CASE WHEN n_chars * 2 + 50 < 4096 THEN 'operational' ELSE 'context' END AS bound_by FROM documents")
def z40(spark, d):
    own = F.col("n_chars") * 2 + 50
    return table(spark, d, "documents").select("doc_id", F.least(F.lit(4096), own).alias("cap"), F.when(own < 4096, "operational").otherwise("context").alias("bound_by"))


@query("z41_provisional_status", "SELECT event_id, CASE WHEN event_type = 'error' AND value > 50 THEN 'oom' WHEN event_type = 'error' THEN 'exception' WHEN value > 95 THEN 'cap_reached' WHEN value < 5 THEN 'invalid_audio' ELSE 'complete' END AS status FROM events")
def z41(spark, d):
    v, error = F.col("value"), F.col("event_type") == "error"
    return table(spark, d, "events").select("event_id", F.when(error & (v > 50), "oom").when(error, "exception").when(v > 95, "cap_reached").when(v < 5, "invalid_audio").otherwise("complete").alias("status"))


@query("z44_work_grid", "WITH t AS (SELECT item_id FROM benchmark WHERE regexp_matches(CAST(item_id AS VARCHAR), '^1')), v AS (SELECT n_name FROM nation WHERE regexp_matches(n_name, '1$')), s AS (SELECT unnest([11, 12]) AS seed) SELECT item_id, n_name, seed FROM t, v, s WHERE NOT (item_id = 10 AND seed = 11)")
def z44(spark, d):
    t = table(spark, d, "benchmark").filter(F.col("item_id").cast("string").rlike("^1")).select("item_id")
    v = table(spark, d, "nation").filter(F.col("n_name").rlike("1$")).select("n_name")
    grid = t.crossJoin(v).withColumn("seed", F.explode(F.array(F.lit(11), F.lit(12))))  # a design of items, voices and seeds
    done = spark.createDataFrame([(10, 11)], "item_id long, seed int")
    return grid.join(done, ["item_id", "seed"], "left_anti").select("item_id", "n_name", "seed")


@query("z45_rate_tolerance", "SELECT source, count(*) AS n, count_if(abs(n_chars - doc_id * 5) > 1300) AS n_off FROM documents GROUP BY 1")
def z45(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("n_chars") - F.col("doc_id") * 5) > 1300).alias("n_off"))


@query("z46_deviation", "SELECT max(abs(length(text) - n_chars)) AS worst, avg(length(text) - n_chars) AS mean, count(*) AS n FROM documents")
def z46(spark, d):
    gap = F.length("text") - F.col("n_chars")
    return table(spark, d, "documents").agg(F.max(F.abs(gap)).alias("worst"), F.avg(gap).alias("mean"), F.count("*").alias("n"))


@query("z49_row_validation", r"""SELECT rule, CAST(doc_id AS VARCHAR) AS key FROM (SELECT doc_id, unnest(list_filter([CASE WHEN NOT regexp_matches(text, '[^ \t\n\x0B\f\r]') THEN 'text' END, CASE WHEN NOT (n_chars > 60 AND n_chars < 30000) THEN 'duration' END], lambda x: x IS NOT NULL)) AS rule FROM documents)""")
def z49(spark, d):
    return violations(table(spark, d, "documents"), F.col("doc_id"), {"text": F.trim(F.regexp_replace("text", BLANK, " ")) != "", "duration": (F.col("n_chars") > 60) & (F.col("n_chars") < 30000)})


@query("z50_ordered_children", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def z50(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("c")).select("conv_id", F.array_join("c.role", ">").alias("roles"))


@query("z51_end_repair", "WITH x AS (SELECT doc_id, n_chars / 100.0 AS stop, n_chars / 100.0 + (doc_id % 7) / 1000.0 AS e FROM documents) SELECT doc_id, round(CASE WHEN e - stop <= 0.005 THEN least(e, stop) ELSE e END, 6) AS e, round(greatest(0, e - stop), 6) AS overrun FROM x")
def z51(spark, d):
    stop = F.col("n_chars") / 100.0
    end = stop + (F.col("doc_id") % 7) / 1000.0
    return table(spark, d, "documents").select("doc_id", F.round(F.when(end - stop <= 0.005, F.least(end, stop)).otherwise(end), 6).alias("e"), F.round(F.greatest(F.lit(0.0), end - stop), 6).alias("overrun"))


@query("z53_effective_config", "WITH e AS (SELECT * FROM (VALUES ('lr', 0.1), ('steps', 200.0), ('seed', NULL), ('cap', 5.0)) t(k, want)), f AS (SELECT * FROM (VALUES ('lr', 0.1000000000001), ('steps', 100.0), ('seed', 7.0)) t(k, got)) SELECT k, CASE WHEN want IS NULL THEN 'skipped' WHEN got IS NULL THEN 'unreadable' WHEN abs(want - got) <= 1e-9 THEN 'matched' ELSE 'mismatched' END AS verdict FROM e LEFT JOIN f USING (k)")
def z53(spark, d):
    e = spark.createDataFrame([("lr", 0.1), ("steps", 200.0), ("seed", None), ("cap", 5.0)], "k string, want double")
    f = spark.createDataFrame([("lr", 0.1000000000001), ("steps", 100.0), ("seed", 7.0)], "k string, got double")
    verdict = F.when(F.col("want").isNull(), "skipped").when(F.col("got").isNull(), "unreadable").when(F.abs(F.col("want") - F.col("got")) <= 1e-9, "matched").otherwise("mismatched")
    return e.join(f, "k", "left").select("k", verdict.alias("verdict"))


@query("z54_status_coalesce", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, event_type) AS status FROM events")
def z54(spark, d):
    a, b = F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.col("event_type")
    checked = F.when(a.isNotNull() & b.isNotNull() & (a != b), F.raise_error(F.lit("two statuses differ")).cast("string")).when(a.isNull() & b.isNull(), F.raise_error(F.lit("no status")).cast("string")).otherwise(F.coalesce(a, b))
    return table(spark, d, "events").select("event_id", checked.alias("status"))


@query("z55_duplicate_keys", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 2")
def z55(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).filter("n > 2")


@query("z57_stratum_prefix", "WITH r AS (SELECT source, row_number() OVER (ORDER BY source) AS k FROM (SELECT DISTINCT source FROM documents)) SELECT substr(source, 1, 4) AS stratum, count(*) AS n, max(k) - min(k) + 1 = count(*) AS contiguous FROM r GROUP BY 1")
def z57(spark, d):
    r = table(spark, d, "documents").select("source").distinct().withColumn("k", F.row_number().over(Window.orderBy("source")))
    return r.groupBy(F.substring("source", 1, 4).alias("stratum")).agg(F.count("*").alias("n"), (F.max("k") - F.min("k") + 1 == F.count("*")).alias("contiguous"))


@query("z58_runtime_summary", "SELECT user_id, max(value) AS top, list_sort(list(value))[len(list(value)) // 2 + 1] AS upper_median, round(avg(value), 6) AS mean, round(sum(value), 4) AS total FROM events GROUP BY 1")
def z58(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("top"), upper_median(F.col("value")).alias("upper_median"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("total"))


@query("z59_single_match", r"SELECT page_id, CASE WHEN len(regexp_extract_all(html, '<title>([^<]*)</title>')) = 1 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title FROM pages")
def z59(spark, d):
    found = F.regexp_extract_all("html", F.lit("<title>([^<]*)</title>"), 1)
    return table(spark, d, "pages").select("page_id", F.when(F.size(found) == 1, found[0]).alias("title"))


@query("z60_source_share", "SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY 1")
def z60(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return g.select("lang", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))  # one row per language


@query("z61_sections", "WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM l WHERE length(line) > 200) SELECT l.doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM l JOIN m a ON a.doc_id = l.doc_id AND a.r = 1 JOIN m b ON b.doc_id = l.doc_id AND b.r = 2 WHERE l.k > a.k AND l.k < b.k GROUP BY 1")
def z61(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    heads = lines.filter(F.length("line") > 200).withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("k"))).filter("r <= 2")
    bounds = heads.groupBy("doc_id").agg(F.max(F.when(F.col("r") == 1, F.col("k"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("k"))).alias("b")).filter("b is not null")
    inside = lines.join(bounds, "doc_id").filter("k > a and k < b")
    return inside.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"))


@query("z62_token_words", r"WITH t AS (SELECT conv_id, turn, generate_subscripts(string_split(text, ' '), 1) AS k, unnest(string_split(text, ' ')) AS tok FROM conversations), w AS (SELECT conv_id, turn, k, len(list_filter(string_split_regex(lower(tok), '[^a-z0-9]+'), lambda x: x <> '')) AS n FROM t) SELECT conv_id, turn, CAST(sum(n) AS BIGINT) AS n_words, max(n) AS most, count_if(n = 0) AS n_empty FROM w GROUP BY 1, 2")
def z62(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("tok"))
    n = F.size(F.filter(F.split(F.lower("tok"), "[^a-z0-9]+"), lambda x: x != ""))
    return t.select("conv_id", "turn", n.alias("n")).groupBy("conv_id", "turn").agg(F.sum("n").alias("n_words"), F.max("n").alias("most"), F.count_if(F.col("n") == 0).alias("n_empty"))


@query("z65_edits_in_range", "WITH p AS (SELECT doc_id, n_chars, unnest(range(0, 5)) * 100 AS a FROM documents) SELECT doc_id, count_if(a >= 100 AND a + 10 <= n_chars) AS n_inside FROM p GROUP BY 1")
def z65(spark, d):
    p = table(spark, d, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(400), F.lit(100))).alias("a"))
    return p.groupBy("doc_id").agg(F.count_if((F.col("a") >= 100) & (F.col("a") + 10 <= F.col("n_chars"))).alias("n_inside"))


@query("z66_bucket_parameters", "WITH b AS (SELECT * FROM (VALUES ('S0', 0, 500), ('S1', 500, 2000), ('S2', 2000, 100000)) t(bucket, low, high)) SELECT bucket, count(doc_id) AS n FROM b LEFT JOIN documents ON n_chars >= low AND n_chars < high GROUP BY 1")
def z66(spark, d):
    b = spark.createDataFrame([("S0", 0, 500), ("S1", 500, 2000), ("S2", 2000, 100000)], "bucket string, low int, high int")
    docs = table(spark, d, "documents")
    counted = docs.join(F.broadcast(b), (F.col("n_chars") >= F.col("low")) & (F.col("n_chars") < F.col("high"))).groupBy("bucket").agg(F.count("*").alias("n"))  # three buckets
    return b.select("bucket").join(counted, "bucket", "left").fillna(0, ["n"])


@query("z67_half_open_bins", "SELECT CASE WHEN n_chars < 100 THEN 'a' WHEN n_chars < 300 THEN 'b' WHEN n_chars < 1000 THEN 'c' WHEN n_chars < 3000 THEN 'd' WHEN n_chars < 10000 THEN 'e' WHEN n_chars < 30000 THEN 'f' ELSE 'g' END AS bin, count(*) AS n FROM documents GROUP BY 1")
def z67(spark, d):
    n = F.col("n_chars")
    label = F.when(n < 100, "a").when(n < 300, "b").when(n < 1000, "c").when(n < 3000, "d").when(n < 10000, "e").when(n < 30000, "f").otherwise("g")
    return table(spark, d, "documents").groupBy(label.alias("bin")).agg(F.count("*").alias("n"))


@query("z68_largest_context", "SELECT source, arg_max(doc_id, n_chars * 1000000 - doc_id) AS doc_id, max(n_chars) AS n_chars, max(n_chars) * 2 * 24 * 128 AS cache_bytes FROM documents GROUP BY 1")
def z68(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.col("n_chars") * 1000000 - F.col("doc_id")).alias("doc_id"), F.max("n_chars").alias("n_chars"), (F.max("n_chars") * 2 * 24 * 128).alias("cache_bytes"))


@query("z69_fingerprint", """SELECT doc_id, substr(sha256('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}'), 1, 16) AS fingerprint FROM documents""")
def z69(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.to_json(F.struct("lang", "n_chars", "source")), 256), 1, 16).alias("fingerprint"))


@query("z70_fallback", "SELECT doc_id, coalesce(CASE WHEN n_chars >= 500 THEN n_chars / 100.0 END, 0.5) AS value, n_chars < 500 AS fallback FROM documents")
def z70(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.when(n >= 500, n / 100.0), F.lit(0.5)).alias("value"), (n < 500).alias("fallback"))


@query("z72_differential", r"""SELECT count(*) AS n, count(*) FILTER (WHERE trim(regexp_replace(strip_accents(translate(lower(text), '''’‘`´ʼ', '')), '[^a-z0-9]+', ' ', 'g')) <> trim(regexp_replace(replace(lower(text), 'ё', 'е'), '[^а-яa-z0-9]+', ' ', 'g'))) AS n_mismatch FROM documents""")
def z72(spark, d):
    """How many texts two normalisations tell apart."""
    from ..functions.text import normalise_english, normalise_plain

    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.count_if(~normalise_english("text").eqNullSafe(normalise_plain(F.col("text")))).alias("n_mismatch"))


@query("z73_artifact_presence", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id) WHERE lang = 'de'")
def z73(spark, d):
    return table(spark, d, "documents").filter("lang = 'de'").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("z29_prefix_records", "WITH m AS (SELECT quantile_cont(n_chars / 6.0, 0.5) AS rate FROM documents) SELECT doc_id, round(n_chars / rate, 6) AS estimate FROM documents, m")
def z29(spark, d):
    docs = table(spark, d, "documents")
    rate = docs.agg(F.percentile(F.col("n_chars") / 6.0, F.lit(0.5)).alias("rate"))  # one row
    return docs.crossJoin(F.broadcast(rate)).select("doc_id", F.round(F.col("n_chars") / F.col("rate"), 6).alias("estimate"))


@query("z31_size_fields", r"SELECT doc_id, len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS tokens, round(len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) / 8192.0, 6) AS occupancy FROM documents")
def z31(spark, d):
    n = F.size(words(F.col("text")))
    return table(spark, d, "documents").select("doc_id", n.alias("tokens"), F.round(n / 8192.0, 6).alias("occupancy"))


@query("z35_nearest_held_out", """WITH e AS (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS v FROM embeddings), x AS (SELECT label, generate_subscripts(v, 1) AS k, unnest(v) AS x FROM e WHERE label % 2 = 1),
m AS (SELECT label, k, avg(x) AS x FROM x GROUP BY 1, 2), u AS (SELECT label, list(x ORDER BY k) AS v FROM m GROUP BY 1), n AS (SELECT label, [y / sqrt(list_inner_product(v, v)) for y in v] AS v FROM u)
SELECT vec_id, arg_max(n.label, list_inner_product(e.v, n.v)) AS nearest FROM e, n WHERE e.label % 2 = 0 GROUP BY 1""")
def z35(spark, d):
    """The held-out group (odd labels) whose centroid is nearest to each vector of the others; a centroid of few vectors is an error."""
    from ..operators.leakage import dot, mean_vectors

    e = table(spark, d, "embeddings")
    held = e.filter("label % 2 = 1")
    thin = held.groupBy("label").agg(F.count("*").alias("n")).filter("n < 2").count()
    if thin:
        raise ValueError(f"{thin} held-out groups have too few vectors")
    centroids = mean_vectors(held, "label", "embedding").select(F.col("label").alias("h"), F.col("mean").alias("u"))
    rows = e.filter("label % 2 = 0").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rows.crossJoin(centroids).groupBy("vec_id").agg(F.max_by("h", dot(F.col("v"), F.col("u"))).alias("nearest"))


@query("z38_evidence_gate", "WITH v AS (SELECT user_id, max(ts) AS checked FROM events WHERE event_type = 'view' GROUP BY 1), i AS (SELECT user_id, max(ts) AS changed FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT user_id, coalesce(checked > changed, false) AS admitted FROM i LEFT JOIN v USING (user_id)")
def z38(spark, d):
    e = table(spark, d, "events")
    v = e.filter("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("checked"))
    i = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("changed"))
    return i.join(v, "user_id", "left").select("user_id", F.coalesce(F.col("checked") > F.col("changed"), F.lit(False)).alias("admitted"))


@query("z16_attached_rows", "WITH a AS (SELECT source, count(*) AS attempts FROM documents GROUP BY 1), f AS (SELECT source, count(*) AS rows FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT source, attempts, coalesce(rows, 0) AS rows, coalesce(rows, 0) <= attempts AS sound FROM a LEFT JOIN f USING (source)")
def z16(spark, d):
    docs = table(spark, d, "documents")
    a = docs.groupBy("source").agg(F.count("*").alias("attempts"))
    f = docs.join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("rows"))
    rows = F.coalesce("rows", F.lit(0))
    return a.join(f, "source", "left").select("source", "attempts", rows.alias("rows"), (rows <= F.col("attempts")).alias("sound"))


@query("z20_descriptive_snapshot", "SELECT lang, count(*) AS n, count(quality) AS n_scored, round(avg(quality), 6) AS mean_quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def z20(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("n_scored"), F.round(F.avg("quality"), 6).alias("mean_quality"))


@query("z24_selection_schema", "SELECT 'sel_' || doc_id AS sample_id, source AS channel_id, n_chars / 15.0 AS duration_sec FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def z24(spark, d):
    picked = top_per_group(table(spark, d, "documents"), ["source"], [F.col("doc_id")], 5)
    return picked.select(F.concat(F.lit("sel_"), F.col("doc_id")).alias("sample_id"), F.col("source").alias("channel_id"), (F.col("n_chars") / 15.0).alias("duration_sec"))


@query("z7_failure_anatomy", """
WITH x AS (SELECT user_id, event_type, lead(event_type) OVER w AS b, row_number() OVER w AS pos FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT user_id, pos, count(*) OVER (PARTITION BY user_id, event_type, b ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM x WHERE b IS NOT NULL), f AS (SELECT user_id, min(pos) AS first FROM c WHERE n > 3 GROUP BY 1), t AS (SELECT user_id, count(*) AS total FROM events GROUP BY 1)
SELECT user_id, first, round(first / total, 6) AS share, first IS NULL AS sound FROM t LEFT JOIN f USING (user_id)""")
def z7(spark, d):
    from .sequences import w19

    total = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"))
    j = total.join(w19(spark, d).withColumnRenamed("position", "first"), "user_id", "left")
    return j.select("user_id", "first", F.round(F.col("first") / F.col("total"), 6).alias("share"), F.col("first").isNull().alias("sound"))


@query("z14_packing_comparison", "SELECT lang, count(*) AS rows, CAST(sum(ceil(n_chars / 1000.0)) AS BIGINT) AS windows, round(sum(ceil(n_chars / 1000.0)) / count(*), 6) AS ratio FROM documents GROUP BY 1")
def z14(spark, d):
    windows = F.sum(F.ceil(F.col("n_chars") / 1000.0))
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("rows"), windows.cast("long").alias("windows"), F.round(windows / F.count("*"), 6).alias("ratio"))


@query("z36_own_and_other", """
WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, list(x ORDER BY k) AS v FROM (SELECT label, k, avg(x) AS x FROM e GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT a.vec_id, a.label = m.label AS own, list_inner_product(a.embedding::DOUBLE[], m.v) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(m.v, m.v)) AS c FROM embeddings a, m)
SELECT vec_id, round(max(c) FILTER (WHERE own), 5) AS own, round(max(c) FILTER (WHERE NOT own), 5) AS other FROM s GROUP BY 1""")
def z36(spark, d):
    from ..operators.leakage import dot, mean_vectors, unit

    e = table(spark, d, "embeddings")
    means = mean_vectors(e, "label", "embedding").select(F.col("label").alias("l"), "mean")  # one row per label
    rows = e.select("vec_id", "label", unit(F.transform("embedding", lambda x: x.cast("double"))).alias("v")).crossJoin(means)
    c = dot(F.col("v"), F.col("mean"))
    rows = rows.select("vec_id", (F.col("label") == F.col("l")).alias("same"), c.alias("c"))
    return rows.groupBy("vec_id").agg(F.round(F.max(F.when(F.col("same"), F.col("c"))), 5).alias("own"), F.round(F.max(F.when(~F.col("same"), F.col("c"))), 5).alias("other"))


@query("z39_mix_sources", "WITH s AS (SELECT * FROM (VALUES ('src1', 3), ('src2', 5), ('nowhere', 1)) t(source, cap)), n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, cap, CASE WHEN n IS NOT NULL THEN least(cap, n) END AS used, n IS NULL AS unknown FROM s LEFT JOIN n USING (source)")
def z39(spark, d):
    s = spark.createDataFrame([("src1", 3), ("src2", 5), ("nowhere", 1)], "source string, cap int")
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    used = F.when(F.col("n").isNotNull(), F.least(F.col("cap").cast("long"), F.col("n")))
    return s.join(n, "source", "left").select("source", "cap", used.alias("used"), F.col("n").isNull().alias("unknown"))


@query("z47_identity_windows", "SELECT conv_id FROM conversations WHERE role <> 'system' GROUP BY 1 HAVING min(turn) <> 0 OR max(turn) + 1 <> count(*)")
def z47(spark, d):
    g = table(spark, d, "conversations").filter("role <> 'system'").groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("*").alias("n"))
    return g.filter((F.col("low") != 0) | (F.col("high") + 1 != F.col("n"))).select("conv_id")


@query("z48_required_columns", "SELECT doc_id, text, source, 'row' || doc_id AS sample_id FROM documents")
def z48(spark, d):
    docs = table(spark, d, "documents")
    lacking = {"doc_id", "text", "source"} - set(docs.columns)
    if lacking:
        raise ValueError(f"columns are missing: {sorted(lacking)}")
    own = F.col("sample_id") if "sample_id" in docs.columns else F.concat(F.lit("row"), F.col("doc_id"))
    return docs.select("doc_id", "text", "source", own.alias("sample_id"))
