"""Text function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.disfluency import disfluencies, fluent
from ..functions.numbers import FEMININE, HUNDREDS, TENS, THOUSAND, UNITS, cardinals
from ..functions.text import byte_chunks, duration_frames, normalise_english, normalise_lenient, normalise_plain, normalise_strict, rate_per_hundred, sentence_count, transliterated, words
from .base import query, spread, table

WORDS = r"list_filter(string_split_regex({}, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"


@query("x1_strict_normalise", r"SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ё', 'е'), '[^а-яa-z0-9]+', ' ', 'g')) AS norm FROM documents")
def x1(spark, d):
    return table(spark, d, "documents").select("doc_id", normalise_plain(F.col("text")).alias("norm"))


@query("x1_strict_normalise_unicode", r"SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ё', 'е'), '[^а-яa-z0-9]+', ' ', 'g')) AS norm FROM documents")
def x1_unicode(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", normalise_strict("text").alias("norm"))


@query("x2_lenient_normalise")
def x2(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", normalise_lenient("text").alias("norm"))


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql_group(n: str, feminine: bool) -> str:
    """The words of a number below a thousand, each with a blank before it."""
    low = ["", *UNITS[1:]]
    for k, v in FEMININE.items() if feminine else ():
        low[k] = v
    hundreds = f"{_sql_list(['', *(' ' + w for w in HUNDREDS)])}[{n} // 100 + 1]"
    tens = f"CASE WHEN {n} % 100 >= 20 THEN {_sql_list(' ' + w for w in TENS)}[{n} % 100 // 10 - 1] ELSE '' END"
    units = f"{_sql_list(' ' + w if w else '' for w in low)}[CASE WHEN {n} % 100 >= 20 THEN {n} % 10 ELSE {n} % 100 END + 1]"
    return f"({hundreds} || {tens} || {units})"


_FORM = f"CASE WHEN t = 0 THEN '' WHEN t % 100 // 10 = 1 THEN ' {THOUSAND[2]}' WHEN t % 10 = 1 THEN ' {THOUSAND[0]}' WHEN t % 10 BETWEEN 2 AND 4 THEN ' {THOUSAND[1]}' ELSE ' {THOUSAND[2]}' END"


@query("x3_cardinals", "WITH n AS (SELECT p_partkey, p_partkey * 4721 % 1000000 AS n FROM part), g AS (SELECT p_partkey, n, n // 1000 AS t, n % 1000 AS u FROM n) SELECT p_partkey, n, CASE WHEN n = 0 THEN 'ноль' ELSE trim(" + _sql_group("t", True) + " || " + _FORM + " || " + _sql_group("u", False) + ") END AS words FROM g")
def x3(spark, d):
    n = (F.col("p_partkey") * 4721 % 1000000).alias("n")
    return table(spark, d, "part").select("p_partkey", n).withColumn("words", cardinals("n"))


@query("x4_english_normalise", r"""SELECT doc_id, trim(regexp_replace(strip_accents(translate(lower(text), '''’‘`´ʼ', '')), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents""")
def x4(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", normalise_english("text").alias("norm"))


@query("x5_reference_words", r"SELECT doc_id, regexp_replace(lower(text), '-', ' ', 'g') AS spaced, regexp_replace(lower(text), '-', '', 'g') AS joined FROM documents")
def x5(spark, d):
    low = F.lower("text")
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(low, "-", " ").alias("spaced"), F.regexp_replace(low, "-", "").alias("joined"))


@query("x6_tokens", r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+(?:[-''][A-Za-z]+)*')) AS n, regexp_extract(text, '[A-Za-z]+(?:[-''][A-Za-z]+)*') AS first FROM documents")
def x6(spark, d):
    pattern = r"[A-Za-z]+(?:[-'][A-Za-z]+)*"
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(pattern)).alias("n"), F.regexp_extract("text", pattern, 0).alias("first"))


@query("x7_disfluencies")
def x7(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", disfluencies("text").alias("edits"))
    return rows.select("conv_id", "turn", F.inline("edits"))


@query("x8_fluent_text")
def x8(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", fluent("text").alias("text"))


@query("x9_charset_tidy", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[#*$%&|<>]+', ' ', 'g'), ' +([,.;:!?])', '\1', 'g'), '[ \t]+', ' ', 'g')) AS tidy FROM documents")
def x9(spark, d):
    kept = F.regexp_replace("text", r"[#*$%&|<>]+", " ")
    return table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace(F.regexp_replace(kept, r" +([,.;:!?])", "$1"), r"[ \t]+", " ")).alias("tidy"))


@query("x10_case_evidence", """
WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM documents WHERE lang = 'en'), l AS (SELECT DISTINCT doc_id, w FROM w WHERE w = lower(w) AND w <> '')
SELECT w.doc_id, count(*) AS n_lowered FROM w SEMI JOIN l ON w.doc_id = l.doc_id AND lower(w.w) = l.w WHERE w.w <> lower(w.w) GROUP BY 1""")
def x10(spark, d):
    docs = spread(table(spark, d, "documents").filter("lang = 'en'").select("doc_id", "text"), "doc_id")
    w = docs.select("doc_id", F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).filter("w <> ''")
    low = w.filter(F.col("w") == F.lower("w")).select("doc_id", F.col("w").alias("l")).distinct()
    raised = w.filter(F.col("w") != F.lower("w")).withColumn("l", F.lower("w"))
    return raised.join(low, ["doc_id", "l"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_lowered"))


@query("x11_filler_density", r"SELECT doc_id, round(100.0 * len(regexp_extract_all(lower(text), '\b(the|and|of)\b')) / greatest(1, len(" + WORDS.format("text") + ")), 6) AS density FROM documents")
def x11(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(rate_per_hundred(F.lower("text"), r"\b(the|and|of)\b"), 6).alias("density"))


# a whole Latin word; each pass misses one that shares its border with a word replaced before
LATIN_THE = "regexp_replace({}, '(^|[^A-Za-z]){}[hH][eE]($|[^A-Za-z])', '\\1{}\\2', 'g')"


@query("x12_transliterate", "SELECT conv_id, turn, " + LATIN_THE.format(LATIN_THE.format(LATIN_THE.format(LATIN_THE.format("text", "t", "зе"), "t", "зе"), "T", "Зе"), "T", "Зе") + " AS text FROM conversations")
def x12(spark, d):
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", transliterated(F.col("text"), {"the": "зе"}).alias("text"))


@query("x13_sentences", r"SELECT doc_id, len(list_filter(string_split_regex(text, '[.!?…]+'), lambda s: regexp_matches(s, '[^ \t\n\x0B\f\r]'))) AS n FROM documents")
def x13(spark, d):
    return table(spark, d, "documents").select("doc_id", sentence_count(F.col("text")).alias("n"))


@query("x14_style_rates", r"""
WITH n AS (SELECT doc_id, text, lower(text) AS low, greatest(1, len(""" + WORDS.format("text") + r""")) AS n FROM documents)
SELECT doc_id, round(100.0 * len(regexp_extract_all(text, '[?]')) / n, 6) AS questions, round(100.0 * len(regexp_extract_all(text, '[«"]')) / n, 6) AS quotes, round(100.0 * len(regexp_extract_all(low, 'must|shall')) / n, 6) AS norms FROM n""")
def x14(spark, d):
    rate = lambda c, p, a: F.round(rate_per_hundred(c, p), 6).alias(a)
    return table(spark, d, "documents").select("doc_id", rate(F.col("text"), "[?]", "questions"), rate(F.col("text"), '[«"]', "quotes"), rate(F.lower("text"), "must|shall", "norms"))


@query("x15_opening_patterns", "SELECT conv_id, min(turn) AS first_question FROM conversations WHERE regexp_matches(text, '^[A-Z][a-z]+ th') GROUP BY 1")
def x15(spark, d):
    return table(spark, d, "conversations").filter(F.col("text").rlike("^[A-Z][a-z]+ th")).groupBy("conv_id").agg(F.min("turn").alias("first_question"))


@query("x16_byte_chunks")
def x16(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(byte_chunks("text")).alias("k", "chunk"))
    return rows.withColumn("n_bytes", F.octet_length("chunk"))


@query("x17_counts", "SELECT doc_id, len(" + WORDS.format("text") + ") AS words, length(text) AS chars, sha256(text) AS hash, round(len(" + WORDS.format("text") + ") / (n_chars / 900.0), 6) AS per_minute FROM documents WHERE n_chars > 0")
def x17(spark, d):
    n = F.size(words(F.col("text")))
    return table(spark, d, "documents").filter("n_chars > 0").select("doc_id", n.alias("words"), F.length("text").alias("chars"), F.sha2("text", 256).alias("hash"), F.round(n / (F.col("n_chars") / 900.0), 6).alias("per_minute"))


@query("x18_source_cleanup", r"SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g') AS text, len(regexp_extract_all(html, '<[^>]*>')) AS n_tags, len(regexp_extract_all(html, '&[a-z]+;')) AS n_entities FROM pages")
def x18(spark, d):
    text = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " ")
    return table(spark, d, "pages").select("page_id", text.alias("text"), F.regexp_count("html", F.lit("<[^>]*>")).alias("n_tags"), F.regexp_count("html", F.lit("&[a-z]+;")).alias("n_entities"))


@query("x19_word_ratio", "WITH p AS (SELECT conv_id, turn, len(" + WORDS.format("text") + ") AS n, lag(len(" + WORDS.format("text") + ")) OVER (PARTITION BY conv_id ORDER BY turn) AS m FROM conversations) SELECT conv_id, turn, round(n / m, 6) AS ratio, n / m BETWEEN 0.8 AND 1.25 AS near FROM p WHERE m > 0")
def x19(spark, d):
    from pyspark.sql import Window

    n = F.size(words(F.col("text")))
    p = table(spark, d, "conversations").select("conv_id", "turn", n.alias("n")).withColumn("m", F.lag("n").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("m > 0")
    ratio = F.col("n") / F.col("m")
    return p.select("conv_id", "turn", F.round(ratio, 6).alias("ratio"), ratio.between(0.8, 1.25).alias("near"))


@query("z52_duration_frames", "WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) SELECT conv_id, turn, 200 + CAST(trunc(200.0 / greatest(1, octet_length(encode(r))) * octet_length(encode(text)) / CASE WHEN octet_length(encode(text)) < 10 THEN 0.3 ELSE 1.0 END) AS BIGINT) AS frames FROM p WHERE r IS NOT NULL")
def z52(spark, d):
    from pyspark.sql import Window

    p = table(spark, d, "conversations").withColumn("r", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("r is not null")
    return p.select("conv_id", "turn", duration_frames(F.col("r"), F.col("text"), F.lit(200).cast("long")).alias("frames"))
