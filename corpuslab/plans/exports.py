"""Queries that write and read back: archives, line formats, typed tables, reports, counters."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words
from ..operators.content import restricted_words
from ..sources.tables import latex, markdown, read_jsonl, stable, tar_members, unverified, write_csv, write_parquet, write_sorted_jsonl, write_tar_shards
from ..streaming.windows import state_folder
from .base import query, table

PAGES = "SELECT 'page-' || page_id || '.html' AS member, octet_length(encode(html)) AS size, sha256(html) AS sha256 FROM pages"


@query("s10_tar_restore", PAGES)
def s10(spark, d):
    """Pages packed into tar shards and read back; a member that is missing or differs is an error."""
    folder = state_folder(spark, "tar")
    pages = table(spark, d, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("member"), "html")
    packed = write_tar_shards(pages, "member", "html", f"{folder}/shards", 1 << 20)
    packed.write.parquet(f"{folder}/index")
    members = tar_members(spark, f"{folder}/shards")
    lost = unverified(members, spark.read.parquet(f"{folder}/index")).count()
    if lost:
        raise ValueError(f"{lost} members are missing or differ")
    return members.select("member", "size", "sha256")


@query("s11_gzip_lines", "SELECT conv_id, turn, role, text FROM conversations")
def s11(spark, d):
    folder = state_folder(spark, "lines")
    table(spark, d, "conversations").select("conv_id", "turn", "role", "text").write.option("compression", "gzip").json(folder)
    return read_jsonl(spark, folder, "conv_id long, turn long, role string, text string").drop("_file")


@query("s12_stable_read", "SELECT n_nationkey, n_name FROM nation")
def s12(spark, d):
    folder = state_folder(spark, "stable")
    table(spark, d, "nation").select("n_nationkey", "n_name").write.parquet(folder)
    return stable(spark, folder, lambda: spark.read.parquet(folder))


@query("k1_sorted_lines", "SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents")
def k1(spark, d):
    """Lines sorted over all files; files whose keys overlap are an error."""
    from ..operators.ranks import numbered

    folder = state_folder(spark, "sorted")
    write_sorted_jsonl(table(spark, d, "documents").select("doc_id", "source"), "doc_id", folder)
    rows = read_jsonl(spark, folder, "doc_id long, source string")
    sorted_files = rows.groupBy("_file").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    overlaps = sorted_files.alias("a").join(sorted_files.alias("b"), F.expr("a._file < b._file and a.high >= b.low")).count()
    if overlaps:
        raise ValueError("the files are not in the order of the key")
    return numbered(rows.drop("_file"), F.col("doc_id"), "place")


@query("k2_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def k2(spark, d):
    folder = state_folder(spark, "csv")
    write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), folder)
    return spark.read.option("header", True).schema("c_custkey long, c_name string, c_acctbal double").csv(folder)


@query("k3_typed_parquet", "SELECT CAST(p_partkey AS INTEGER) AS p_partkey, CAST(p_retailprice AS FLOAT) AS p_retailprice, p_brand FROM part")
def k3(spark, d):
    folder = state_folder(spark, "typed")
    schema = T.StructType([T.StructField("p_partkey", T.IntegerType()), T.StructField("p_retailprice", T.FloatType()), T.StructField("p_brand", T.StringType())])
    write_parquet(table(spark, d, "part"), schema, folder)
    return spark.read.parquet(folder)


REPORT = """WITH n AS (SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY r_name) AS k FROM n)"""


@query("k7_reports", REPORT + r"""
SELECT 'markdown' AS kind, 0 AS line, '| r_name | nations |' AS text UNION ALL SELECT 'markdown', 1, '| --- | --- |' UNION ALL SELECT 'markdown', k + 1, '| ' || r_name || ' | ' || nations || ' |' FROM r
UNION ALL SELECT 'latex', 0, '\begin{tabular}{ll}' UNION ALL SELECT 'latex', 1, '\toprule' UNION ALL SELECT 'latex', 2, 'r\_name & nations \\' UNION ALL SELECT 'latex', 3, '\midrule'
UNION ALL SELECT 'latex', k + 3, r_name || ' & ' || nations || ' \\' FROM r UNION ALL SELECT 'latex', (SELECT count(*) FROM r) + 4, '\bottomrule' UNION ALL SELECT 'latex', (SELECT count(*) FROM r) + 5, '\end{tabular}'""")
def k7(spark, d):
    counts = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("nations")).orderBy("r_name")
    lines = [(kind, k, text) for kind, report in (("markdown", markdown), ("latex", latex)) for k, text in enumerate(report(counts).split("\n"))]
    return spark.createDataFrame(lines, "kind string, line long, text string")


@query("g5_counters", "SELECT count(*) AS n_rows, sum(n_chars) AS n_chars, count(*) FILTER (WHERE lang = 'en') AS n_english FROM documents")
def g5(spark, d):
    """Counters that rows pass by on their way to a sink."""
    seen = Observation("rows")
    docs = table(spark, d, "documents").observe(seen, F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_chars"), F.count_if(F.col("lang") == "en").alias("n_english"))
    docs.select("doc_id").write.parquet(state_folder(spark, "counted"))
    return spark.createDataFrame([seen.get], "n_rows long, n_chars long, n_english long")


STABLE = r"""WITH s AS (SELECT conv_id, turn, role, len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS n FROM conversations), t AS (SELECT *, least(40, n) AS stable, n >= 40 AS censored FROM s)"""


def stable_words(spark, d):
    n = F.size(words(F.col("text")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", n.alias("n"))
    return rows.select("*", restricted_words(F.col("n"), 40).alias("stable"), (F.col("n") >= 40).alias("censored"))


@query("z43_stable_words_csv", STABLE + " SELECT conv_id, turn, role, n, stable, censored FROM t")
def z43_rows(spark, d):
    folder = state_folder(spark, "stable-words")
    write_csv(stable_words(spark, d), folder)
    return spark.read.option("header", True).schema("conv_id long, turn long, role string, n int, stable int, censored boolean").csv(folder)


@query("z43_restricted_means_csv", STABLE + " SELECT role, count(*) AS n_items, round(avg(stable), 8) AS mean_words, round(avg(stable / 40.0), 8) AS mean_share, median(stable) AS median_words, count(*) FILTER (WHERE censored) AS n_censored FROM t GROUP BY 1")
def z43_means(spark, d):
    folder = state_folder(spark, "restricted-means")
    g = stable_words(spark, d).groupBy("role").agg(F.count("*").alias("n_items"), F.round(F.avg("stable"), 8).alias("mean_words"), F.round(F.avg(F.col("stable") / 40), 8).alias("mean_share"), F.median("stable").alias("median_words"), F.count_if("censored").alias("n_censored"))
    write_csv(g, folder)
    return spark.read.option("header", True).schema("role string, n_items long, mean_words double, mean_share double, median_words double, n_censored long").csv(folder)
