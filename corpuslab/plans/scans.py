"""Scan, source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import inverse_map, parent_shards, refreshed_cache, round_robin, still_to_do, word_track
from .base import query, table


@query("s1_parquet_scan", "SELECT * FROM nation")
def s1(spark, d):
    return table(spark, d, "nation")


@query("s2_projected_scan", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 1000 AND lang = 'en'")
def s2(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars", "lang").filter("n_chars > 1000 and lang = 'en'").drop("lang")


@query("s3_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s3(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("s4_dimension", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def s4(spark, d):
    once = F.when(F.count_distinct("r_name") > 1, F.raise_error(F.lit("conflicting names")).cast("string")).otherwise(F.first("r_name"))
    regions = table(spark, d, "region").groupBy(F.col("r_regionkey").alias("n_regionkey")).agg(once.alias("r_name"))
    return table(spark, d, "nation").join(regions, "n_regionkey").select("n_nationkey", "n_name", "r_name")


@query("s5_coalesced_fields", "SELECT event_id, coalesce(CAST(json_extract(props, '$.missing') AS BIGINT), CAST(json_extract(props, '$.k') AS BIGINT), -1) AS v FROM events")
def s5(spark, d):
    parsed = F.from_json("props", "missing long, k long", {"mode": "PERMISSIVE"})
    return table(spark, d, "events").select("event_id", F.coalesce(parsed["missing"], parsed["k"], F.lit(-1)).alias("v"))


@query("s6_sidecar_join", "SELECT doc_id, quality, quality IS NULL AS missing FROM documents LEFT JOIN labels USING (doc_id)")
def s6(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", F.col("quality").isNull().alias("missing"))


@query("s7_word_track", """
WITH t AS (SELECT conv_id, string_agg(turn || chr(9) || CASE WHEN turn % 5 = 4 THEN 'bad' ELSE CAST(turn + 1 AS VARCHAR) END || chr(9) || role, chr(10) ORDER BY turn) AS ts FROM conversations GROUP BY 1), l AS (SELECT conv_id, unnest(string_split(ts, chr(10))) AS line FROM t), p AS (SELECT conv_id, string_split(line, chr(9)) AS p FROM l)
SELECT conv_id, CAST(p[1] AS DOUBLE) AS start, TRY_CAST(p[2] AS DOUBLE) AS "end", trim(p[3]) AS text FROM p WHERE len(p) = 3 AND TRY_CAST(p[2] AS DOUBLE) IS NOT NULL""")
def s7(spark, d):
    stop = F.when(F.col("turn") % 5 == 4, "bad").otherwise((F.col("turn") + 1).cast("string"))
    line = F.concat_ws("\t", F.col("turn").cast("string"), stop, "role")
    tracks = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("ts"))
    return tracks.select("conv_id", F.inline(word_track(F.col("ts"))))


@query("s8_key_values", "SELECT 'c' || conv_id AS key, string_agg(text, ' ' ORDER BY turn) AS value FROM conversations GROUP BY 1")
def s8(spark, d):
    lines = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("t"))
    parts = F.split(F.concat(F.lit("c"), F.col("conv_id"), F.lit(" "), F.col("t")), " ", 2)
    return lines.select(parts[0].alias("key"), parts[1].alias("value"))


@query("s9_cache_refresh", "SELECT 'keep' AS side, doc_id FROM labels SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') USING (doc_id) UNION ALL SELECT 'compute', doc_id FROM documents ANTI JOIN labels USING (doc_id) WHERE lang = 'en'")
def s9(spark, d):
    keep, compute = refreshed_cache(table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").filter("lang = 'en'"), "doc_id")
    return keep.select(F.lit("keep").alias("side"), "doc_id").unionByName(compute.select(F.lit("compute").alias("side"), "doc_id"))


@query("k4_parent_shards", "WITH p AS (SELECT conv_id, (row_number() OVER (ORDER BY conv_id) - 1) // 16 AS shard FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT CAST(shard AS BIGINT) AS shard, count(*) AS n, count(DISTINCT conv_id) AS n_parents FROM conversations JOIN p USING (conv_id) GROUP BY 1")
def k4(spark, d):
    rows = parent_shards(table(spark, d, "conversations"), "conv_id", 16)
    return rows.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("n_parents"))


@query("k5_round_robin", "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 8 AS INTEGER) AS shard FROM documents WHERE doc_id >= 32 UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id < 32")
def k5(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return round_robin(docs.filter("doc_id >= 32"), "doc_id", 8, 0, docs.filter("doc_id < 32"))


@query("k6_inverse_map", "SELECT source, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY CAST(doc_id AS VARCHAR)) AS keys FROM documents GROUP BY 1")
def k6(spark, d):
    return inverse_map(table(spark, d, "documents").withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "source")


@query("k8_resume", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def k8(spark, d):
    return still_to_do(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]).select("doc_id")
