"""Leakage and similarity queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.text import NOT_BLANK, words
from ..operators.clustering import average_linkage
from ..operators.leakage import dot, gram_sets, gram_table, group_similarity, max_jaccard, mean_vectors, shared_grams, shingles
from ..operators.sequences import top_per_group
from .base import query, spread, table

GRAMS = r"""WITH toks AS (SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(lower(text), '[ \t\n\r]+'), lambda w: w <> '') AS w FROM documents UNION ALL SELECT 'b', item_id, list_filter(string_split_regex(lower(text), '[ \t\n\r]+'), lambda w: w <> '') FROM benchmark),
sets AS (SELECT side, id, CASE WHEN len(w) >= 8 THEN list_distinct([array_to_string(w[i:i+7], ' ') for i in range(1, len(w) - 6)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM toks),
grams AS (SELECT side, id, len(g) AS size, unnest(g) AS gram FROM sets),
pairs AS (SELECT b.id AS item_id, d.id AS doc_id, count(*) AS n_shared, count(*) / (any_value(b.size) + any_value(d.size) - count(*)) AS jaccard FROM grams b JOIN grams d ON b.gram = d.gram AND b.side = 'b' AND d.side = 'd' GROUP BY 1, 2)"""


def pairs(spark, d):
    docs, items = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), table(spark, d, "benchmark")
    tokens = words(F.lower("text"))
    return items, shared_grams(gram_table(items, "item_id", tokens, 8), gram_sets(docs, "doc_id", tokens, 8), "item_id", "doc_id")


@query("l1_max_shingle_jaccard", GRAMS + """, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY jaccard DESC, doc_id DESC) AS k FROM pairs)
SELECT item_id, round(coalesce(max(jaccard), 0), 6) AS max_jaccard, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k <= 3), '') AS nearest FROM benchmark LEFT JOIN r USING (item_id) GROUP BY item_id""")
def l1(spark, d):
    items, found = pairs(spark, d)
    out = max_jaccard(items, found, "item_id", "doc_id")
    return out.select("item_id", F.round("jaccard", 6).alias("max_jaccard"), F.coalesce(F.array_join(F.transform("nearest", lambda x: x.cast("string")), ","), F.lit("")).alias("nearest"))


@query("j7_shared_grams", GRAMS + " SELECT item_id, doc_id, n_shared, round(jaccard, 6) AS jaccard FROM pairs")
def j7(spark, d):
    return pairs(spark, d)[1].withColumn("jaccard", F.round("jaccard", 6))


@query("l1_shingle_counts", GRAMS + " SELECT id AS doc_id, count(*) AS n_grams FROM grams WHERE side = 'd' GROUP BY 1")
def l1_counts(spark, d):
    # those without words go first: a filter on the counts would be moved below the exchange, and count all texts once more
    worded = table(spark, d, "documents").select("doc_id", "text").filter(F.col("text").rlike(NOT_BLANK))
    return spread(worded, "doc_id").select("doc_id", F.size(shingles(words(F.lower("text")), 8)).alias("n_grams"))


@query("l2_exact_copies", """
WITH s AS (SELECT sha256(text) AS h, doc_id FROM documents), h AS (SELECT h, list_sort(list(doc_id)) AS ids FROM s GROUP BY h HAVING count(*) > 1)
SELECT h AS text_hash, len(ids) AS n, array_to_string(ids[1:5], ',') AS examples FROM h""")
def l2(spark, d):
    s = table(spark, d, "documents").select(F.sha2("text", 256).alias("text_hash"), "doc_id")
    groups = s.groupBy("text_hash").agg(F.count("*").cast("int").alias("n")).filter("n > 1")
    first = top_per_group(s, ["text_hash"], [F.col("doc_id")], 5)  # cut to five rows of a group before the shuffle
    examples = first.groupBy("text_hash").agg(F.array_join(F.sort_array(F.collect_list("doc_id")).cast("array<string>"), ",").alias("examples"))
    return groups.join(examples, "text_hash")


@query("l3_leakage_contract", GRAMS + """ SELECT (SELECT count(*) FROM benchmark b JOIN documents d ON b.text = d.text) AS n_exact, round((SELECT max(jaccard) FROM pairs), 6) AS worst, (SELECT count(DISTINCT item_id) FROM pairs WHERE jaccard > 0.05) AS n_over, (SELECT coalesce(max(jaccard), 0) FROM pairs) <= 0.05 AS passed""")
def l3(spark, d):
    items, found = pairs(spark, d)
    exact = items.join(table(spark, d, "documents").select("text"), "text").agg(F.count("*").alias("n_exact"))
    worst = found.agg(F.round(F.max("jaccard"), 6).alias("worst"), F.count_distinct(F.when(F.col("jaccard") > 0.05, F.col("item_id"))).alias("n_over"), (F.coalesce(F.max("jaccard"), F.lit(0.0)) <= 0.05).alias("passed"))
    return exact.crossJoin(worst)  # one row by one row


MEANS = """WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, k, avg(x) AS x FROM e GROUP BY 1, 2),
u AS (SELECT label, list(x ORDER BY k) AS v FROM m GROUP BY 1), n AS (SELECT label, [x / sqrt(list_inner_product(v, v)) for x in v] AS v FROM u),
s AS (SELECT a.label AS l, b.label AS r, list_inner_product(a.v, b.v) AS c FROM n a JOIN n b ON a.label <> b.label)"""


@query("l4_group_means", MEANS + " SELECT label, round(v[1], 5) AS first, round(list_sum(v), 4) AS total FROM n")
def l4(spark, d):
    m = mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    return m.select("label", F.round(F.col("mean")[0], 5).alias("first"), F.round(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("l4_unit_means", """
WITH e AS (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS v FROM embeddings), n AS (SELECT label, [x / sqrt(list_inner_product(v, v)) for x in v] AS v FROM e),
x AS (SELECT label, generate_subscripts(v, 1) AS k, unnest(v) AS x FROM n), m AS (SELECT label, k, avg(x) AS x FROM x GROUP BY 1, 2), u AS (SELECT label, list(x ORDER BY k) AS v FROM m GROUP BY 1)
SELECT label, round(v[1] / sqrt(list_inner_product(v, v)), 5) AS first FROM u""")
def l4_units(spark, d):
    return mean_vectors(table(spark, d, "embeddings"), "label", "embedding", of_units=True).select("label", F.round(F.col("mean")[0], 5).alias("first"))


@query("l5_max_cosine", MEANS + ", t AS (SELECT l, max(c) AS top FROM s GROUP BY 1) SELECT l AS label, round(top, 5) AS top, round((SELECT quantile_cont(top, 0.95) FROM t), 5) AS tau, top > (SELECT quantile_cont(top, 0.95) FROM t) AS flagged FROM t")
def l5(spark, d):
    s = group_similarity(mean_vectors(table(spark, d, "embeddings"), "label", "embedding"), "label")
    top = s.groupBy(F.col("left").alias("label")).agg(F.max("cosine").alias("top"))
    tau = top.agg(F.percentile("top", F.lit(0.95)).alias("tau"))  # one row
    return top.crossJoin(F.broadcast(tau)).select("label", F.round("top", 5).alias("top"), F.round("tau", 5).alias("tau"), (F.col("top") > F.col("tau")).alias("flagged"))


@query("j10_top_neighbours", MEANS + ", r AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY c DESC, r) AS k FROM s) SELECT l AS label, k AS place, r AS neighbour, round(c, 5) AS cosine FROM r WHERE k <= 3")
def j10(spark, d):
    s = group_similarity(mean_vectors(table(spark, d, "embeddings"), "label", "embedding"), "label")
    top = top_per_group(s, ["left"], [F.desc("cosine"), F.col("right")], 3)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("left").orderBy(F.desc("cosine"), "right"))
    return top.select(F.col("left").alias("label"), place.alias("place"), F.col("right").alias("neighbour"), F.round("cosine", 5).alias("cosine"))


@query("l6_split_half", """
WITH h AS (SELECT label, md5(CAST(vec_id AS VARCHAR)) < '8' AS half, embedding FROM embeddings), e AS (SELECT label, half, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM h),
m AS (SELECT label, half, k, avg(x) AS x FROM e GROUP BY ALL), u AS (SELECT label, half, list(x ORDER BY k) AS v FROM m GROUP BY 1, 2)
SELECT a.label, round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), 5) AS cosine FROM u a JOIN u b ON a.label = b.label AND a.half AND NOT b.half""")
def l6(spark, d):
    e = table(spark, d, "embeddings").withColumn("key", F.struct("label", (F.md5(F.col("vec_id").cast("string").cast("binary")) < "8").alias("half")))
    m = mean_vectors(e, "key", "embedding").select("key.label", "key.half", "mean")
    a, b = m.filter("half").select("label", F.col("mean").alias("u")), m.filter("not half").select("label", F.col("mean").alias("v"))
    return a.join(b, "label").select("label", F.round(dot(F.col("u"), F.col("v")), 5).alias("cosine"))


@query("l7_watch_list", MEANS + " SELECT l AS left, r AS right, CASE WHEN c > 0.3 THEN 'move' ELSE 'watch' END AS verdict FROM s WHERE c > 0.1 AND l < r")
def l7(spark, d):
    s = group_similarity(mean_vectors(table(spark, d, "embeddings"), "label", "embedding"), "label")
    return s.filter("cosine > 0.1 and left < right").select("left", "right", F.when(F.col("cosine") > 0.3, "move").otherwise("watch").alias("verdict"))


@query("l8_average_linkage")
def l8(spark, d):
    """Clusters of the labels' mean vectors, cut at a distance of 0.8."""
    return average_linkage(mean_vectors(table(spark, d, "embeddings"), "label", "embedding"), "label", "mean", 0.8)


@query("l9_cluster_report")
def l9(spark, d):
    clusters = average_linkage(mean_vectors(table(spark, d, "embeddings"), "label", "embedding"), "label", "mean", 0.8)
    sizes = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return clusters.join(sizes, "label").groupBy("cluster").agg(F.count("*").alias("n_labels"), F.sum("n").alias("n_vectors"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"))


@query("l10_iterative_gate")
def l10(spark, d):
    """Labels banned until no kept pair of means is nearer than a cosine of 0.12."""
    s = group_similarity(mean_vectors(table(spark, d, "embeddings"), "label", "embedding"), "label")
    rows = sorted((-r["cosine"], r["left"], r["right"]) for r in s.filter("left < right").collect())  # pairs of a few labels
    banned: set = set()
    while True:
        worst = next(((l, r) for c, l, r in rows if -c > 0.12 and not {l, r} & banned), None)
        if worst is None:
            break
        banned.add(max(worst))
    labels = table(spark, d, "embeddings").select("label").distinct()
    return labels.withColumn("banned", F.col("label").isin([int(np.int64(b)) for b in banned]))
