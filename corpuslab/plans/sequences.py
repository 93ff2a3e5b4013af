"""Window, sequence, ordering and set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.sequences import islands, merge_intervals, smoothed, spearman, theil_sen, top_per_group, voiced_windows, window_grid
from .base import query, table
from .joins import SPANS, event_spans


@query("w1_top_per_group", "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3")
def w1(spark, d):
    return top_per_group(table(spark, d, "documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3).select("source", "doc_id", "n_chars")


@query("w2_best_then_top_up", """
WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents)
SELECT doc_id, source, CAST(row_number() OVER (ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, n_chars DESC, doc_id) AS INTEGER) AS place FROM r QUALIFY place <= 30""")
def w2(spark, d):
    r = table(spark, d, "documents").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")))
    picked = r.orderBy(F.when(F.col("k") == 1, 0).otherwise(1), F.desc("n_chars"), "doc_id").limit(30)  # the feature: a budget of 30
    place = F.row_number().over(Window.orderBy(F.when(F.col("k") == 1, 0).otherwise(1), F.desc("n_chars"), "doc_id"))
    return picked.select("doc_id", "source", place.alias("place"))


@query("w3_last_record", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def w3(spark, d):
    return top_per_group(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("event_id")], 1).select("user_id", "event_type", "event_id", "value")


@query("w4_cumulative_words", r"""
SELECT conv_id, turn, CAST(sum(len(string_split_regex(trim(text), '[ \t\n\r]+'))) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS words FROM conversations""")
def w4(spark, d):
    n = F.size(F.split(F.trim("text"), r"[ \t\n\r]+"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.sum(n).over(w).alias("words"))


ISLANDS = """WITH x AS (SELECT user_id, event_id, value < 50 AS hit, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
i AS (SELECT user_id, event_id, rn, rn - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM x WHERE hit),
r AS (SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM i GROUP BY user_id, island)"""


@query("w5_runs", ISLANDS + " SELECT user_id, max(length) AS longest, max(last) FILTER (WHERE length >= 3) AS last_long, min(first) AS first_low FROM r GROUP BY 1")
def w5(spark, d):
    r = islands(table(spark, d, "events"), "user_id", "event_id", F.col("value") < 50)
    return r.groupBy("user_id").agg(F.max("length").alias("longest"), F.max(F.when(F.col("length") >= 3, F.col("last"))).alias("last_long"), F.min("first").alias("first_low"))


@query("w6_merged_intervals", SPANS + """, m AS (SELECT *, CASE WHEN start > coalesce(max(e) OVER (PARTITION BY user_id ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) THEN 1 ELSE 0 END AS n FROM t),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, round(min(start), 3) AS start, round(max(e), 3) AS "end", count(*) AS n FROM s GROUP BY user_id, g""")
def w6(spark, d):
    return merge_intervals(event_spans(spark, d), "user_id").select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


@query("w7_window_grid", """
WITH x AS (SELECT doc_id, n_chars / 100.0 AS t FROM documents), y AS (SELECT *, CASE WHEN t >= 5 THEN CAST(floor((t - 5) / 2.5 + 1e-9) AS BIGINT) + 1 ELSE 0 END AS k FROM x)
SELECT doc_id, round(i * 2.5, 4) AS start, round(i * 2.5 + 5, 4) AS "end" FROM (SELECT doc_id, unnest(range(k)) AS i FROM y)
UNION ALL SELECT doc_id, round(k * 2.5, 4), round(t, 4) FROM y WHERE t - k * 2.5 >= 2.5 AND t < k * 2.5 + 5""")
def w7(spark, d):
    t = (F.col("n_chars") / 100.0).alias("t")
    x = table(spark, d, "documents").select("doc_id", t).select("doc_id", F.inline(window_grid(F.col("t"), 5.0, 2.5, 2.5)))
    return x.select("doc_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


BINNED = """WITH t AS (SELECT event_type, user_id, event_id % 60 + 1.25 AS t, value FROM events),
i AS (SELECT event_type, user_id, floor((t - 1.25 + 1e-9) / 2.5) * 2.5 + 2.5 AS bin, avg(value) AS v FROM t GROUP BY ALL),
s AS (SELECT event_type, bin, avg(v) AS v, count(*) AS support FROM i GROUP BY 1, 2)"""


def binned(spark, d):
    t = F.col("event_id") % 60 + 1.25
    rows = table(spark, d, "events").select("event_type", "user_id", "value", (F.floor((t - 1.25 + 1e-9) / 2.5) * 2.5 + 2.5).alias("bin"))
    items = rows.groupBy("event_type", "user_id", "bin").agg(F.avg("value").alias("v"))
    return items.groupBy("event_type", "bin").agg(F.avg("v").alias("v"), F.count("*").alias("support"))


@query("w9_two_level_bins", BINNED + " SELECT event_type, CAST(bin AS DOUBLE) AS bin, round(v, 6) AS v, support FROM s")
def w9(spark, d):
    return binned(spark, d).withColumn("v", F.round("v", 6))


@query("w10_smoothing", "WITH RECURSIVE" + BINNED[4:] + """, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bin) AS k FROM s),
e AS (SELECT event_type, bin, k, v AS ema FROM n WHERE k = 1 UNION ALL SELECT n.event_type, n.bin, n.k, 0.3 * n.v + 0.7 * e.ema FROM e JOIN n ON n.event_type = e.event_type AND n.k = e.k + 1)
SELECT event_type, CAST(bin AS DOUBLE) AS bin, round(CAST(ema AS DOUBLE), 5) AS ema FROM e""")
def w10(spark, d):
    track = binned(spark, d).groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("bin", "v"))).alias("p"))
    states = F.transform("p", lambda _, k: smoothed(F.slice("p.v", F.lit(1), k + 1), 0.3))
    return track.select("event_type", F.inline(F.arrays_zip(F.col("p.bin").alias("bin"), states.alias("ema")))).withColumn("ema", F.round("ema", 5))


@query("w11_head_and_late_means", """
SELECT user_id, round(avg(value) FILTER (WHERE k < 30), 6) AS head, round(avg(value) FILTER (WHERE k >= 60), 6) AS late FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) GROUP BY 1""")
def w11(spark, d):
    k = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("k")
    x = table(spark, d, "events").select("user_id", "value", k)
    return x.groupBy("user_id").agg(F.round(F.avg(F.when(F.col("k") < 30, F.col("value"))), 6).alias("head"), F.round(F.avg(F.when(F.col("k") >= 60, F.col("value"))), 6).alias("late"))


@query("w12_head_tail_drift", """
WITH x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, median(value) FILTER (WHERE k <= 10) AS head, median(value) FILTER (WHERE k > n - 10) AS tail, quantile_cont(value, 0.05) AS p05, count_if(value < 20) AS n_low FROM x GROUP BY 1""")
def w12(spark, d):
    w = Window.partitionBy("user_id")
    x = table(spark, d, "events").select("user_id", "value", F.row_number().over(w.orderBy("event_id")).alias("k"), F.count("*").over(w).alias("n"))
    return x.groupBy("user_id").agg(F.median(F.when(F.col("k") <= 10, F.col("value"))).alias("head"), F.median(F.when(F.col("k") > F.col("n") - 10, F.col("value"))).alias("tail"), F.percentile("value", F.lit(0.05)).alias("p05"), F.count_if(F.col("value") < 20).alias("n_low"))


@query("w13_theil_sen", """
WITH x AS (SELECT user_id, CAST(event_id % 97 AS DOUBLE) AS x, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 97, value) AS k FROM events)
SELECT a.user_id, round(median((b.y - a.y) / (b.x - a.x)) FILTER (WHERE abs(b.x - a.x) > 1e-12), 6) AS slope FROM x a JOIN x b ON a.user_id = b.user_id AND a.k < b.k GROUP BY 1""")
def w13(spark, d):
    x = table(spark, d, "events").select("user_id", (F.col("event_id") % 97).alias("x"), F.col("value").alias("y"))
    return theil_sen(x, "user_id", "x", "y").withColumn("slope", F.round("slope", 6))


@query("w14_spearman", """
WITH x AS (SELECT user_id, event_id % 10 AS x, value AS y FROM events),
r AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY x) + (count(*) OVER (PARTITION BY user_id, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY user_id ORDER BY y) + (count(*) OVER (PARTITION BY user_id, y) - 1) / 2.0 AS ry FROM x)
SELECT user_id, round(CASE WHEN count(*) >= 3 THEN corr(rx, ry) END, 6) AS rho FROM r GROUP BY 1""")
def w14(spark, d):
    x = table(spark, d, "events").select("user_id", (F.col("event_id") % 10).alias("x"), F.col("value").alias("y"))
    return spearman(x, "user_id", "x", "y").withColumn("rho", F.round("rho", 6))


@query("w15_chain_monotonicity", """
WITH c AS (SELECT conv_id, list(length(text) ORDER BY turn) AS v, arg_max(turn, length(text) * 1000 - turn) AS top_turn FROM conversations GROUP BY 1)
SELECT conv_id, top_turn AS argmax_turn, v = list_sort(v) AS rising, v[len(v)] < v[1] AS last_below_first FROM c""")
def w15(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("p"), F.max_by("turn", F.length("text") * 1000 - F.col("turn")).alias("argmax_turn"))
    v = F.col("p.n")
    return c.select("conv_id", "argmax_turn", (v == F.sort_array(v)).alias("rising"), (F.element_at(v, -1) < F.element_at(v, 1)).alias("last_below_first"))


@query("w16_bucket_drift", """
WITH x AS (SELECT user_id, event_type, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2)
SELECT event_type, median(high - low) FILTER (WHERE high - low >= 10) AS drift, count_if(high - low >= 10) AS n FROM x GROUP BY 1""")
def w16(spark, d):
    x = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.max("value") - F.min("value")).alias("span"))
    return x.groupBy("event_type").agg(F.median(F.when(F.col("span") >= 10, F.col("span"))).alias("drift"), F.count_if(F.col("span") >= 10).alias("n"))


@query("w17_median_filter", """
WITH x AS (SELECT user_id, event_id, CASE WHEN value < 50 THEN 1 ELSE 0 END AS hit FROM events)
SELECT event_id, sum(hit) OVER w * 2 > count(*) OVER w AS smooth FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def w17(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 2)
    hit = (F.col("value") < 50).cast("int")
    return table(spark, d, "events").select("event_id", (F.sum(hit).over(w) * 2 > F.count("*").over(w)).alias("smooth"))


@query("w18_z_scores", """
SELECT doc_id, round((n_chars - avg(n_chars) OVER (PARTITION BY lang)) / CASE WHEN stddev_pop(n_chars) OVER (PARTITION BY lang) = 0 THEN 1 ELSE stddev_pop(n_chars) OVER (PARTITION BY lang) END, 6) AS z FROM documents""")
def w18(spark, d):
    docs = table(spark, d, "documents")
    stats = docs.groupBy("lang").agg(F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("s"))
    z = (F.col("n_chars") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    return docs.join(stats, "lang").select("doc_id", F.round(z, 6).alias("z"))


@query("w19_first_excess_gram", """
WITH x AS (SELECT user_id, event_id, event_type, lead(event_type) OVER w AS b, row_number() OVER w AS pos FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT user_id, pos, count(*) OVER (PARTITION BY user_id, event_type, b ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM x WHERE b IS NOT NULL)
SELECT user_id, min(pos) AS position FROM c WHERE n > 3 GROUP BY 1""")
def w19(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    x = table(spark, d, "events").select("user_id", "event_type", F.lead("event_type").over(w).alias("b"), F.row_number().over(w).alias("pos")).filter("b is not null")
    n = F.count("*").over(Window.partitionBy("user_id", "event_type", "b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return x.select("user_id", "pos", n.alias("n")).filter("n > 3").groupBy("user_id").agg(F.min("pos").alias("position"))


@query("w20_word_times", r"""
WITH x AS (SELECT conv_id, turn, turn * 10.0 AS s, turn * 10.0 + 8 AS e, string_split_regex(trim(text), '[ \t\n\r]+') AS w FROM conversations),
y AS (SELECT *, unnest(range(len(w))) AS k FROM x)
SELECT conv_id, turn, k AS pos, w[k + 1] AS word, round(s + (e - s) * (k + 0.5) / len(w), 6) AS at FROM y""")
def w20(spark, d):
    x = table(spark, d, "conversations").select("conv_id", "turn", F.split(F.trim("text"), r"[ \t\n\r]+").alias("w"))
    y = x.select("conv_id", "turn", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
    return y.select("conv_id", "turn", "pos", "word", F.round(F.col("turn") * 10.0 + 8.0 * (F.col("pos") + 0.5) / F.col("n"), 6).alias("at"))


@query("t1_total_order", "SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INTEGER) AS place FROM documents ORDER BY place LIMIT 100")
def t1(spark, d):
    first = table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(100)  # the feature: a top-k report
    return first.select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("place"))


@query("t2_top_fraction", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= greatest(3, round_even(count(*) OVER (PARTITION BY source) * 0.05, 0))")
def t2(spark, d):
    w = Window.partitionBy("source")
    docs = table(spark, d, "documents").select("source", "doc_id", F.row_number().over(w.orderBy(F.desc("n_chars"), "doc_id")).alias("k"), F.count("*").over(w).alias("n"))
    return docs.filter(F.col("k") <= F.greatest(F.lit(3), F.bround(F.col("n") * 0.05))).select("source", "doc_id")


@query("t3_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def t3(spark, d):
    return table(spark, d, "documents").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").select("doc_id").limit(50)


@query("t4_even_picks", """
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id FROM r WHERE k IN (SELECT DISTINCT i * (n - 1) // 11 FROM range(12) t(i))""")
def t4(spark, d):
    w = Window.partitionBy("source")
    r = table(spark, d, "documents").select("source", "doc_id", (F.row_number().over(w.orderBy("n_chars", "doc_id")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.floor(i * (F.col("n") - 1) / 11).cast("int"))
    return r.filter(F.array_contains(picks, F.col("k"))).select("source", "doc_id")


@query("t5_buffer_sort", "WITH r AS (SELECT doc_id, n_chars, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS buffer FROM documents) SELECT source, doc_id, CAST(buffer AS BIGINT) AS buffer, row_number() OVER (PARTITION BY source, buffer ORDER BY n_chars, doc_id) AS place FROM r")
def t5(spark, d):
    k = F.floor((F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1) / 10)
    r = table(spark, d, "documents").select("source", "doc_id", "n_chars", k.alias("buffer"))
    return r.select("source", "doc_id", "buffer", F.row_number().over(Window.partitionBy("source", "buffer").orderBy("n_chars", "doc_id")).alias("place"))


@query("t6_epoch_shuffle", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('3:1:' || CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents")
def t6(spark, d):
    key = F.md5(F.concat(F.lit("3:1:"), F.col("doc_id").cast("string")).cast("binary"))
    return table(spark, d, "documents").select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy(key, "doc_id")).alias("place"))


@query("u1_tagged_union", "SELECT 'documents' AS tag, doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark")
def u1(spark, d):
    a = table(spark, d, "documents").select(F.lit("documents").alias("tag"), F.col("doc_id").alias("id"), F.length("text").alias("n"))
    return a.unionByName(table(spark, d, "benchmark").select(F.lit("benchmark").alias("tag"), F.col("item_id").alias("id"), F.length("text").alias("n")))


@query("u2_differences", "SELECT 'only_labels' AS side, doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE n_chars > 1000) UNION ALL SELECT 'only_long', doc_id FROM (SELECT doc_id FROM documents WHERE n_chars > 1000 EXCEPT SELECT doc_id FROM labels)")
def u2(spark, d):
    a, b = table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").filter("n_chars > 1000").select("doc_id")
    return a.subtract(b).select(F.lit("only_labels").alias("side"), "doc_id").unionByName(b.subtract(a).select(F.lit("only_long").alias("side"), "doc_id"))


@query("u3_split_overlap", "SELECT text FROM documents WHERE doc_id % 5 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 5 <> 0")
def u3(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter("doc_id % 5 = 0").select("text").intersect(docs.filter("doc_id % 5 <> 0").select("text"))


@query("w8_voiced_windows", SPANS + """, o AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t),
s AS (SELECT *, sum((start > coalesce(reach, '-infinity'::DOUBLE))::INT) OVER (PARTITION BY user_id ORDER BY start, e) AS k FROM o), m AS (SELECT user_id, k, min(start) AS start, max(e) - min(start) AS length FROM s GROUP BY 1, 2),
a AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM m), n AS (SELECT user_id, max(off + length) AS total FROM a GROUP BY 1),
w AS (SELECT user_id, unnest([x * 300.0::DOUBLE for x in range(CAST(floor((total - 600) / 300) AS BIGINT) + 1)] || CASE WHEN total - (floor((total - 600) / 300) * 300 + 600) > 60 THEN [total - 600] ELSE [] END) AS p FROM n WHERE total >= 600)
SELECT w.user_id, round(p, 3) AS voiced_start, round(b.start + p - b.off, 3) AS t_start, round(c.start + p + 600 - c.off, 3) AS t_end FROM w JOIN a b ON w.user_id = b.user_id AND b.off <= p AND p < b.off + b.length
JOIN a c ON w.user_id = c.user_id AND c.off < p + 600 AND p + 600 <= c.off + c.length + 1e-6 QUALIFY row_number() OVER (PARTITION BY w.user_id, p ORDER BY c.off DESC) = 1""")
def w8(spark, d):
    w = voiced_windows(event_spans(spark, d), "user_id", "start", "end", 600.0, 300.0, 60.0)
    thousandths = lambda c: F.round(F.col(c) * 1000) / 1000  # noqa: E731  the product is rounded, as in SQL: it can be a tie where the decimals are none
    return w.select("user_id", thousandths("voiced_start").alias("voiced_start"), thousandths("start").alias("t_start"), thousandths("end").alias("t_end"))
