"""Join queries: star with precedence, guards, paired arms, ranges, containment, grids, nearest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.paired import free_of, interpolate, unmatched
from .base import query, table


@query("j1_star_precedence", """
SELECT o_orderkey, coalesce(nullif(c_mktsegment, 'BUILDING'), r_name, 'none') AS label, n_name, r_name,
  array_to_string(list_filter([CASE WHEN c_nationkey <> s_nationkey THEN 'nation' END, CASE WHEN c_acctbal < 0 THEN 'balance' END], lambda x: x IS NOT NULL), ',') AS conflicts
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_suppkey = o_orderkey % 50""")
def j1(spark, d):
    t = {n: table(spark, d, n) for n in ("orders", "customer", "nation", "region", "supplier")}
    df = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"), "left").join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"), "left")
    df = df.join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"), "left").join(t["supplier"], F.col("s_suppkey") == F.col("o_orderkey") % 50, "left")
    conflicts = F.array_compact(F.array(F.when(F.col("c_nationkey") != F.col("s_nationkey"), F.lit("nation")), F.when(F.col("c_acctbal") < 0, F.lit("balance"))))
    label = F.coalesce(F.expr("nullif(c_mktsegment, 'BUILDING')"), "r_name", F.lit("none"))
    return df.select("o_orderkey", label.alias("label"), "n_name", "r_name", F.array_join(conflicts, ",").alias("conflicts"))


@query("j2_checked_inner_join", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j2(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    unknown = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("n_unknown"))
    checked = F.assert_true(F.col("n_unknown") == 0, "a line item of an unknown order").isNull()
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).crossJoin(F.broadcast(unknown)).filter(checked).select("l_orderkey", "l_linenumber", "o_orderpriority")


@query("j3_composite_key_floor", """
WITH f AS (SELECT l_returnflag || '|' || l_linestatus || '|' || CAST(l_linenumber AS VARCHAR) AS k, min(l_discount) AS floor FROM lineitem WHERE l_linenumber < 6 GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_discount - floor AS over_floor, floor IS NOT NULL AS floor_available FROM lineitem LEFT JOIN f ON k = l_returnflag || '|' || l_linestatus || '|' || CAST(l_linenumber AS VARCHAR)""")
def j3(spark, d):
    key = F.concat_ws("|", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("k")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", key)
    floors = lines.filter("l_linenumber < 6").groupBy("k").agg(F.min("l_discount").alias("floor"))
    return lines.join(floors, "k", "left").select("l_orderkey", "l_linenumber", (F.col("l_discount") - F.col("floor")).alias("over_floor"), F.col("floor").isNotNull().alias("floor_available"))


def arms(spark, d):
    """Two arms of scores with the same pairing keys, out of line items."""
    keys = ["l_suppkey", "l_linenumber", "digit"]
    lines = table(spark, d, "lineitem").withColumn("digit", (F.col("l_quantity") % 10).cast("int")).groupBy(*keys, "l_returnflag").agg(F.avg("l_discount").alias("score"))
    a = lines.filter("l_returnflag = 'A'").select(*keys, F.col("score").alias("score_a"))
    b = lines.filter("l_returnflag = 'R'").select(*keys, F.col("score").alias("score_b"))
    return a, b, keys


ARMS = """WITH g AS (SELECT l_suppkey, l_linenumber, CAST(l_quantity % 10 AS INTEGER) AS digit, l_returnflag, avg(l_discount) AS score FROM lineitem GROUP BY ALL),
a AS (SELECT l_suppkey, l_linenumber, digit, score AS score_a FROM g WHERE l_returnflag = 'A'), b AS (SELECT l_suppkey, l_linenumber, digit, score AS score_b FROM g WHERE l_returnflag = 'R')"""


@query("j4_paired_arms", ARMS + " SELECT l_suppkey, l_linenumber, digit, round(score_a - score_b, 8) AS delta FROM a JOIN b USING (l_suppkey, l_linenumber, digit)")
def j4(spark, d):
    a, b, keys = arms(spark, d)
    return a.join(b, keys).select(*keys, F.round(F.col("score_a") - F.col("score_b"), 8).alias("delta"))


@query("j4_unmatched_pairs", ARMS + """ SELECT l_suppkey, l_linenumber, digit, 'left' AS side FROM a ANTI JOIN b USING (l_suppkey, l_linenumber, digit)
UNION ALL SELECT l_suppkey, l_linenumber, digit, 'right' FROM b ANTI JOIN a USING (l_suppkey, l_linenumber, digit)""")
def j4_unmatched(spark, d):
    return unmatched(*arms(spark, d))


@query("j5_anti_membership", "SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') ON c_custkey = o_custkey")
def j5(spark, d):
    banned = table(spark, d, "orders").filter("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(banned, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j6_common_parents", """
WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'),
x AS (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'), y AS (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)
SELECT o_orderkey, (SELECT count(*) FROM x WHERE x.l_orderkey = o_orderkey) AS n_a FROM p WHERE o_orderkey IN (SELECT l_orderkey FROM x) AND o_orderkey IN (SELECT l_orderkey FROM y)""")
def j6(spark, d):
    lines = table(spark, d, "lineitem")
    parents = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    a = lines.filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_a"))
    b = lines.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return parents.join(b, "o_orderkey", "left_semi").join(a, "o_orderkey")


SPANS = """WITH t AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + 60 + value AS e, event_type FROM events)"""


def event_spans(spark, d):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").select("user_id", "event_id", "event_type", start.alias("start"), (start + 60 + F.col("value")).alias("end"))


@query("j8_overlap_guard", SPANS + """ SELECT a.event_id FROM t a WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM t b WHERE b.event_type <> 'view' AND a.user_id = b.user_id AND a.start < b.e AND b.start < a.e)""")
def j8(spark, d):
    t = event_spans(spark, d)
    return free_of(t.filter("event_type = 'view'"), t.filter("event_type <> 'view'"), "user_id").select("event_id")


@query("j9_containment", SPANS + """, w AS (SELECT user_id, min(start) AS a, min(start) + 86400 AS b FROM t GROUP BY user_id)
SELECT t.user_id, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY start, event_id) AS ids FROM t JOIN w USING (user_id) WHERE start >= a - 0.02 AND e <= b + 0.02 GROUP BY t.user_id""")
def j9(spark, d):
    t = event_spans(spark, d)
    w = t.groupBy("user_id").agg(F.min("start").alias("a")).withColumn("b", F.col("a") + 86400)
    inside = t.join(w, "user_id").filter((F.col("start") >= F.col("a") - 0.02) & (F.col("end") <= F.col("b") + 0.02))
    items = F.sort_array(F.collect_list(F.struct("start", "event_id")))
    return inside.groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.transform(items, lambda x: x["event_id"].cast("string")), " ").alias("ids"))


@query("j11_grid", """
WITH t AS (SELECT item_id FROM benchmark), v AS (SELECT n_nationkey AS voice FROM nation WHERE n_regionkey = 1)
SELECT item_id, voice, 'primary' AS role FROM t, v WHERE item_id % 2 = 0 UNION ALL SELECT item_id, CAST(item_id % 25 AS INTEGER), 'own' FROM t WHERE item_id % 2 = 1""")
def j11(spark, d):
    t = table(spark, d, "benchmark").select("item_id")
    v = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("voice"))
    grid = t.filter("item_id % 2 = 0").crossJoin(v).withColumn("role", F.lit("primary"))  # the grid is what is asked for
    return grid.unionByName(t.filter("item_id % 2 = 1").select("item_id", (F.col("item_id") % 25).cast("int").alias("voice"), F.lit("own").alias("role")))


@query("j12_disjoint_pairs", """
WITH s AS (SELECT s_nationkey AS k, list_sort(list_distinct(list(CAST(floor(s_acctbal / 1000) AS BIGINT)))) AS g FROM supplier GROUP BY 1)
SELECT a.k AS left_key, b.k AS right_key FROM s a JOIN s b ON a.k < b.k WHERE NOT list_has_any(a.g, b.g)""")
def j12(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.collect_set(F.floor(F.col("s_acctbal") / 1000)).alias("g"))
    a, b = s.select(F.col("k").alias("left_key"), F.col("g").alias("ga")), s.select(F.col("k").alias("right_key"), F.col("g").alias("gb"))
    return a.join(b, (F.col("left_key") < F.col("right_key")) & ~F.arrays_overlap("ga", "gb")).select("left_key", "right_key")


@query("j13_pinned_subdesign", "SELECT o_orderkey, o_totalprice FROM orders SEMI JOIN (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_tax > 0.07) USING (o_orderkey)")
def j13(spark, d):
    design = table(spark, d, "lineitem").filter("l_tax > 0.07").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(design, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("j14_second_recognizer", """
WITH g AS (SELECT l_suppkey, l_returnflag, round(avg(l_tax), 8) AS p, round(avg(l_discount), 8) AS s FROM lineitem GROUP BY 1, 2)
SELECT a.l_suppkey, round((a.p - b.p) - (a.s - b.s), 7) AS delta_of_deltas FROM g a JOIN g b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R'""")
def j14(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_tax"), 8).alias("p"), F.round(F.avg("l_discount"), 8).alias("s"))
    a, b = (g.filter(F.col("l_returnflag") == f).select("l_suppkey", F.col("p").alias(f"p{f}"), F.col("s").alias(f"s{f}")) for f in "AR")
    return a.join(b, "l_suppkey").select("l_suppkey", F.round((F.col("pA") - F.col("pR")) - (F.col("sA") - F.col("sR")), 7).alias("delta_of_deltas"))


@query("j15_disagreement", "SELECT doc_id, quality, toxic, (quality = 1) = (toxic = 0) AS agree FROM documents JOIN labels USING (doc_id) WHERE (quality = 1) <> (toxic = 0)")
def j15(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    agree = (F.col("quality") == 1) == (F.col("toxic") == 0)
    return rows.filter(~agree).select("doc_id", "quality", "toxic", agree.alias("agree"))


@query("j16_nearest_interpolation", """
WITH x AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events),
y AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER b AS x0, last_value(v IGNORE NULLS) OVER b AS y0,
  first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER a AS x1, first_value(v IGNORE NULLS) OVER a AS y1 FROM x
  WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v, CASE WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (event_id - x0) / (x1 - x0) END, y0, y1), 6) AS filled FROM y""")
def j16(spark, d):
    x = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return interpolate(x, "user_id", "event_id", "v", "filled").select("event_id", F.round("filled", 6).alias("filled"))


@query("j16_as_of", """
SELECT e.event_id, p.event_id AS purchase_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.event_id >= p.event_id""")
def j16_as_of(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), True).over(w)
    return table(spark, d, "events").select("event_id", at.alias("purchase_id"))
