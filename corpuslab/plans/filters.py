"""Filter queries: eligibility, funnels, rejection, labels, gates, sampling, contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.disfluency import TOKEN
from ..functions.numbers import cardinal_words
from ..operators.funnel import first_reason, funnel, hash_share, reason_counts, reject_reasons, violations
from .base import query, table


def _labelled(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")


def eligible():
    return (F.coalesce(F.col("quality"), F.lit(-1)) >= 1) & (F.coalesce(F.col("toxic"), F.lit(1)) == 0) & (F.length(F.trim("text")) > 0)


@query("f1_eligible", "SELECT d.doc_id, d.source, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(quality, -1) >= 1 AND coalesce(toxic, 1) = 0 AND length(trim(text)) > 0")
def f1(spark, d):
    return _labelled(spark, d).filter(eligible()).select("doc_id", "source", "n_chars")


@query("f2_funnel", """
WITH x AS (SELECT n_chars, quality IS NOT NULL AS a, coalesce(quality = 1, false) AS b, coalesce(toxic = 0, false) AS c, n_chars >= 500 AS e
           FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT 1 AS stage_no, 'labelled' AS stage, true AS i, a AS o, n_chars FROM x UNION ALL SELECT 2, 'good', a, a AND b, n_chars FROM x
      UNION ALL SELECT 3, 'clean', a AND b, a AND b AND c, n_chars FROM x UNION ALL SELECT 4, 'long', a AND b AND c, a AND b AND c AND e, n_chars FROM x)
SELECT stage_no, stage, count_if(i) AS rows_in, count_if(o) AS rows_out, count_if(i) - count_if(o) AS rows_removed,
  CAST(coalesce(sum(n_chars) FILTER (WHERE i), 0) AS BIGINT) AS size_in, CAST(coalesce(sum(n_chars) FILTER (WHERE o), 0) AS BIGINT) AS size_out
FROM s GROUP BY stage_no, stage""")
def f2(spark, d):
    stages = [("labelled", F.col("quality").isNotNull()), ("good", F.col("quality") == 1), ("clean", F.col("toxic") == 0), ("long", F.col("n_chars") >= 500)]
    return funnel(_labelled(spark, d), stages, F.col("n_chars"))


@query("f3_nan_defaults", """
SELECT doc_id FROM (SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 'NaN'::DOUBLE WHEN n_chars % 11 = 0 THEN NULL ELSE n_chars / 100.0 END AS v FROM documents)
WHERE CASE WHEN v IS NULL OR isnan(v) THEN -1 ELSE v END >= 5""")
def f3(spark, d):
    v = F.when(F.col("n_chars") % 7 == 0, F.lit(float("nan"))).when(F.col("n_chars") % 11 == 0, F.lit(None)).otherwise(F.col("n_chars") / 100.0)
    docs = table(spark, d, "documents").select("doc_id", v.alias("v"))
    return docs.filter(F.coalesce(F.nanvl("v", F.lit(-1.0)), F.lit(-1.0)) >= 5).select("doc_id")


def license_class(raw):
    """An enumeration of license statements; unknown text is kept as ``other:``."""
    low = F.lower(F.trim(raw))
    return (
        F.when(raw.isNull() | (low == ""), "unknown")
        .when(low.isin("true", "1", "yes"), "creative_commons")
        .when(low.isin("false", "0", "no"), "standard")
        .when(low.contains("creative commons") | low.startswith("cc"), "creative_commons")
        .when(low.contains("standard"), "standard")
        .otherwise(F.concat(F.lit("other:"), low))
    )


@query("f4_license_classes", """
WITH r AS (SELECT CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'True' WHEN 2 THEN 'no' WHEN 3 THEN 'CC-BY 4.0' WHEN 4 THEN ' Standard License ' ELSE source END AS raw FROM documents),
l AS (SELECT raw, lower(trim(raw)) AS low FROM r)
SELECT CASE WHEN raw IS NULL OR low = '' THEN 'unknown' WHEN low IN ('true', '1', 'yes') THEN 'creative_commons' WHEN low IN ('false', '0', 'no') THEN 'standard'
  WHEN contains(low, 'creative commons') OR starts_with(low, 'cc') THEN 'creative_commons' WHEN contains(low, 'standard') THEN 'standard' ELSE 'other:' || low END AS license, count(*) AS n
FROM l GROUP BY 1""")
def f4(spark, d):
    k = F.col("doc_id") % 6
    raw = F.when(k == 0, F.lit(None)).when(k == 1, "True").when(k == 2, "no").when(k == 3, "CC-BY 4.0").when(k == 4, " Standard License ").otherwise(F.col("source"))
    return table(spark, d, "documents").select(license_class(raw).alias("license")).groupBy("license").agg(F.count("*").alias("n"))


@query("f5_regex_fields", r"SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)/', 2) AS host, regexp_matches(url, '^(https?)://([^/]+)/') AS matched FROM pages")
def f5(spark, d):
    pattern = r"^(https?)://([^/]+)/"
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", pattern, 1).alias("scheme"), F.regexp_extract("url", pattern, 2).alias("host"), F.col("url").rlike(pattern).alias("matched"))


def reasons():
    return {"short": F.col("n_chars") < 500, "foreign": F.col("lang") != "en", "toxic": F.coalesce(F.col("toxic") == 1, F.lit(False)), "unlabelled": F.col("quality").isNull()}


@query("f6_reject_reasons", """
WITH r AS (SELECT list_filter([CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality IS NULL THEN 'unlabelled' END], lambda x: x IS NOT NULL) AS rs
  FROM documents LEFT JOIN labels USING (doc_id)),
e AS (SELECT unnest(rs) AS reason, len(rs) = 1 AS sole FROM r)
SELECT reason, count(*) AS n_any, count_if(sole) AS n_sole FROM e GROUP BY reason""")
def f6(spark, d):
    return reason_counts(_labelled(spark, d), reject_reasons(reasons()))


@query("f7_reject_ladder", """
SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN lang <> 'en' THEN 'foreign' WHEN coalesce(toxic = 1, false) THEN 'toxic' WHEN quality IS NULL THEN 'unlabelled' ELSE 'accepted' END AS reason, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def f7(spark, d):
    return _labelled(spark, d).groupBy(first_reason(reasons()).alias("reason")).agg(F.count("*").alias("n"))


@query("f8_charset_ladder", r"""
WITH v AS (SELECT regexp_matches(text, '[0-9]') AS g, regexp_matches(text, '[#*$%&|<>]') AS s, regexp_matches(text, '[^\x00-\x7F]') AS u, n_chars FROM documents),
x AS (SELECT 'strict' AS variant, NOT g AND NOT s AND NOT u AS ok, n_chars FROM v UNION ALL SELECT 'digits', NOT s AND NOT u, n_chars FROM v
  UNION ALL SELECT 'symbols', NOT u, n_chars FROM v UNION ALL SELECT 'letters', NOT g AND NOT s, n_chars FROM v UNION ALL SELECT 'all', true, n_chars FROM v)
SELECT variant, count(*) AS n, count_if(ok) AS n_ok, CAST(coalesce(sum(n_chars) FILTER (WHERE ok), 0) AS BIGINT) AS chars_ok FROM x GROUP BY variant""")
def f8(spark, d):
    g, s, u = (F.col("text").rlike(p) for p in ("[0-9]", "[#*$%&|<>]", r"[^\x00-\x7F]"))
    docs = table(spark, d, "documents").select("n_chars", (~g & ~s & ~u).alias("strict"), (~s & ~u).alias("digits"), (~u).alias("symbols"), (~g & ~s).alias("letters"), F.lit(True).alias("all"))
    long = docs.select("n_chars", F.expr("stack(5, 'strict', strict, 'digits', digits, 'symbols', symbols, 'letters', letters, 'all', `all`) AS (variant, ok)"))
    return long.groupBy("variant").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("n_chars"))), F.lit(0)).alias("chars_ok"))


@query("f10_genre_rules", """
SELECT CASE WHEN regexp_matches(lower(text), '(license|copyright)') THEN 'legal' WHEN regexp_matches(lower(text), '(https?://|www[.])') THEN 'web' WHEN regexp_matches(text, '[|]') THEN 'table' ELSE 'prose' END AS genre, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents GROUP BY 1""")
def f10(spark, d):
    low = F.lower("text")
    genre = F.when(low.rlike("(license|copyright)"), "legal").when(low.rlike("(https?://|www[.])"), "web").when(F.col("text").rlike("[|]"), "table").otherwise("prose")
    return table(spark, d, "documents").groupBy(genre.alias("genre")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("f11_label_mapping", "SELECT CASE WHEN starts_with(source, 'src1') THEN 'one' WHEN source IN ('src2', 'src3') THEN 'two' ELSE 'rest' END AS system, split_part('L=' || source, '=', 2) AS path, count(*) AS n FROM documents GROUP BY 1, 2")
def f11(spark, d):
    system = F.when(F.col("source").startswith("src1"), "one").when(F.col("source").isin("src2", "src3"), "two").otherwise("rest")
    return table(spark, d, "documents").groupBy(system.alias("system"), F.split_part(F.concat(F.lit("L="), "source"), F.lit("="), F.lit(2)).alias("path")).agg(F.count("*").alias("n"))


@query("f12_gated_score", """
WITH x AS (SELECT l_orderkey, l_linenumber, least(1, greatest(0, (l_quantity - 5) / 40)) AS a, least(1, greatest(0, 1 - l_discount / 0.1)) AS b, l_tax, l_quantity, l_extendedprice FROM lineitem)
SELECT l_orderkey, l_linenumber, round(0.6 * a + 0.4 * b, 6) AS score,
  array_to_string(list_filter([CASE WHEN l_tax > 0.06 THEN 'tax' END, CASE WHEN l_quantity < 3 THEN 'quantity' END, CASE WHEN l_extendedprice > 90000 THEN 'price' END], lambda v: v IS NOT NULL), ',') AS failures
FROM x""")
def f12(spark, d):
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    gates = {"tax": F.col("l_tax") > 0.06, "quantity": F.col("l_quantity") < 3, "price": F.col("l_extendedprice") > 90000}
    score = 0.6 * clamp((F.col("l_quantity") - 5) / 40) + 0.4 * clamp(1 - F.col("l_discount") / 0.1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"), F.array_join(reject_reasons(gates), ",").alias("failures"))


@query("f13_band_classes", "SELECT event_id, CASE WHEN value IS NULL THEN 'unknown' WHEN value < 40 THEN 'low' WHEN value > 60 THEN 'high' ELSE 'ambiguous' END AS band FROM events")
def f13(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.when(v.isNull(), "unknown").when(v < 40, "low").when(v > 60, "high").otherwise("ambiguous").alias("band"))


@query("f14_length_filter", """
SELECT source, count(*) AS n, count_if(n_chars < 300) AS n_short, count_if(n_chars > 5000) AS n_long, count_if(n_chars BETWEEN 300 AND 5000) AS n_kept,
  CAST(coalesce(sum(n_chars) FILTER (WHERE n_chars NOT BETWEEN 300 AND 5000), 0) AS BIGINT) AS chars_dropped FROM documents GROUP BY source""")
def f14(spark, d):
    n = F.coalesce(F.col("n_chars"), F.raise_error(F.lit("a document of unknown length")).cast("long"))
    docs = table(spark, d, "documents").withColumn("n_chars", n)
    inside = F.col("n_chars").between(300, 5000)
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 300).alias("n_short"), F.count_if(F.col("n_chars") > 5000).alias("n_long"), F.count_if(inside).alias("n_kept"), F.coalesce(F.sum(F.when(~inside, F.col("n_chars"))), F.lit(0)).alias("chars_dropped"))


@query("f15_context_budget", """
WITH t AS (SELECT doc_id, source, len(string_split_regex(trim(text), '[ \\t\\n\\r]+')) AS text_tokens FROM documents),
u AS (SELECT *, text_tokens + text_tokens // 5 + 2 AS used FROM t)
SELECT source, count(*) AS n, count_if(used <= 1024) AS n_fit, max(used) AS max_used, round(avg(used / 1024.0), 6) AS mean_occupancy FROM u GROUP BY source""")
def f15(spark, d):
    tokens = F.size(F.split(F.trim("text"), r"[ \t\n\r]+"))
    used = (tokens + F.floor(tokens / 5) + 2).alias("used")  # one fill token for each group of five
    return table(spark, d, "documents").select("source", used).groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("used") <= 1024).alias("n_fit"), F.max("used").alias("max_used"), F.round(F.avg(F.col("used") / 1024.0), 6).alias("mean_occupancy")
    )


@query("f16_hash_sample", "SELECT doc_id FROM documents WHERE (('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 10000) / 10000.0 < 0.1")
def f16(spark, d):
    return table(spark, d, "documents").filter(hash_share(F.col("doc_id")) < 0.1).select("doc_id")


@query("f17_contract_violations", """
SELECT rule, CAST(doc_id AS VARCHAR) AS key FROM (
  SELECT doc_id, unnest(list_filter([CASE WHEN NOT (n_chars BETWEEN 100 AND 10000) THEN 'length' END, CASE WHEN NOT (lang IN ('en', 'fr', 'de')) THEN 'language' END, CASE WHEN NOT coalesce(quality = 1, false) THEN 'quality' END], lambda x: x IS NOT NULL)) AS rule
  FROM documents LEFT JOIN labels USING (doc_id))""")
def f17(spark, d):
    rules = {"length": F.col("n_chars").between(100, 10000), "language": F.col("lang").isin("en", "fr", "de"), "quality": F.col("quality") == 1}
    return violations(_labelled(spark, d), F.col("doc_id"), rules)


@query("f18_partition_check", """
WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS n, CAST(l_quantity AS BIGINT) // 2 AS hits, CAST(l_quantity AS BIGINT) // 3 AS subs FROM lineitem),
y AS (SELECT *, CASE WHEN l_linenumber = 7 THEN 0 ELSE n - hits - subs END AS dels FROM x)
SELECT l_orderkey, l_linenumber, n, hits + subs + dels AS total FROM y WHERE NOT (hits + subs + dels = n AND n > 0 AND abs((subs + dels) / n - (n - hits) / n) <= 1e-10)""")
def f18(spark, d):
    n = F.col("l_quantity").cast("long")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n"), F.floor(n / 2).alias("hits"), F.floor(n / 3).alias("subs"))
    rows = rows.withColumn("dels", F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("n") - F.col("hits") - F.col("subs")))
    total = F.col("hits") + F.col("subs") + F.col("dels")
    rate = (F.col("subs") + F.col("dels")) / F.col("n")
    sound = (total == F.col("n")) & (F.col("n") > 0) & (F.abs(rate - (F.col("n") - F.col("hits")) / F.col("n")) <= 1e-10)
    return rows.filter(~sound).select("l_orderkey", "l_linenumber", "n", total.alias("total"))


@query("f9_numeral_cost", r"""
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS run FROM documents), z AS (SELECT doc_id, regexp_replace(run, '^0+([0-9])', '\1') AS z FROM r),
g AS (SELECT doc_id, z, CAST(ceil(length(z) / 3.0) AS BIGINT) AS k, lpad(z, CAST(ceil(length(z) / 3.0) * 3 AS INTEGER), '0') AS p FROM z),
n AS (SELECT doc_id, z, k, [CAST(substr(p, CAST(3 * i + 1 AS BIGINT), 3) AS INTEGER) for i in range(k)] AS n FROM g),
w AS (SELECT doc_id, CASE WHEN k > 9 THEN length(z) ELSE greatest(1, list_sum([(x >= 100)::INT + (x % 100 > 0)::INT + (x % 100 > 20 AND x % 10 > 0)::INT for x in n]) + list_sum([(x > 0)::INT for x in n]) - (n[-1] > 0)::INT) END AS w FROM n),
t AS (SELECT doc_id, sum(w) AS produced FROM w GROUP BY 1),
c AS (SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '[0-9]+', ' ', 'g'), '[А-Яа-яЁёA-Za-z]+(?:[-’''][А-Яа-яЁёA-Za-z]+)*')) AS others FROM documents)
SELECT doc_id, CAST(coalesce(produced, 0) AS BIGINT) AS produced, CAST(coalesce(produced, 0) + others AS BIGINT) AS total, round(coalesce(produced, 0) / greatest(1, coalesce(produced, 0) + others), 6) AS share FROM c LEFT JOIN t USING (doc_id)""")
def f9(spark, d):
    """Words that reading out all digit runs adds, and their share."""
    produced = F.aggregate(F.regexp_extract_all("text", F.lit("([0-9]+)")), F.lit(0).cast("long"), lambda s, run: s + cardinal_words(run))
    others = F.regexp_count(F.regexp_replace("text", "[0-9]+", " "), F.lit(TOKEN.pattern))
    counts = table(spark, d, "documents").select("doc_id", produced.alias("produced"), others.alias("others"))
    total = F.col("produced") + F.col("others")
    return counts.select("doc_id", "produced", total.alias("total"), F.round(F.col("produced") / F.greatest(F.lit(1), total), 6).alias("share"))
