"""Alignment and content metric queries, on adjacent turns as reference and hypothesis."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.alignment import similarity_ratio, word_alignment, word_metrics
from ..functions.roots import prepared_roots
from ..functions.text import normalise_english, normalise_lenient, normalise_plain, words
from ..operators.content import excess_repetition, final_status, flow_status, restricted_words
from .base import query, spread, table
from .joins import SPANS, event_spans

PAIRS = r"""WITH p AS (SELECT conv_id, turn, text AS hyp, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations), q AS (SELECT * FROM p WHERE ref IS NOT NULL)"""


def turn_pairs(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("hyp"), F.lag("text").over(w).alias("ref")).filter("ref is not null")


def scored(spark, d):
    pairs = spread(turn_pairs(spark, d), "conv_id", "turn").withColumns({"ref": normalise_plain(F.col("ref")), "hyp": normalise_plain(F.col("hyp"))})
    return pairs.select("conv_id", "turn", word_metrics("ref", "hyp").alias("m")).select("conv_id", "turn", "m.*")


@query("m1_alignment")
def m1(spark, d):
    pairs = turn_pairs(spark, d)
    ops = word_alignment(normalise_plain(F.col("ref")), normalise_plain(F.col("hyp")))
    return pairs.select("conv_id", "turn", ops.alias("ops")).select("conv_id", "turn", F.inline("ops"))


@query("m2_alignment_masks")
def m2(spark, d):
    ops = word_alignment(normalise_plain(F.col("ref")), normalise_plain(F.col("hyp")))
    rows = turn_pairs(spark, d).select("conv_id", "turn", ops.alias("ops"))
    aligned = F.filter("ops", lambda o: o["op"].isin("equal", "substitute"))
    size = lambda kind: F.aggregate(F.filter("ops", lambda o: o["op"] == kind), F.lit(0), lambda s, o: s + o["ref_end"] - o["ref_start"])
    return rows.select("conv_id", "turn", size("equal").alias("hits"), size("delete").alias("deleted"), F.array_max(F.transform(aligned, lambda o: o["ref_end"] - 1)).alias("last_aligned"))


@query("m3_content_metrics")
def m3(spark, d):
    return scored(spark, d)


@query("m4_char_error_rate")
def m4(spark, d):
    """No SQL: DuckDB's distance counts bytes."""
    pairs = turn_pairs(spark, d)
    return pairs.select("conv_id", "turn", F.round(F.levenshtein("hyp", "ref") / F.length("ref"), 6).alias("cer"))


@query("m5_excess_repetition", PAIRS + r""", w AS (SELECT conv_id, turn, list_filter(string_split_regex(ref, '[ \t\n\r]+'), lambda x: x <> '') AS r, list_filter(string_split_regex(hyp, '[ \t\n\r]+'), lambda x: x <> '') AS h FROM q),
n AS (SELECT unnest(range(3, 9)) AS n), hg AS (SELECT conv_id, turn, n, unnest([array_to_string(h[i:i+n-1], ' ') for i in range(1, len(h) - n + 2)]) AS g FROM w, n), rg AS (SELECT conv_id, turn, n, unnest([array_to_string(r[i:i+n-1], ' ') for i in range(1, len(r) - n + 2)]) AS g FROM w, n),
hc AS (SELECT conv_id, turn, n, g, count(*) AS c FROM hg GROUP BY ALL), rc AS (SELECT conv_id, turn, n, g, count(*) AS k FROM rg GROUP BY ALL),
x AS (SELECT conv_id, turn, n, sum(greatest(0, (c - 1) - greatest(0, coalesce(k, 0) - 1))) / sum(c) AS rate FROM hc LEFT JOIN rc USING (conv_id, turn, n, g) GROUP BY ALL)
SELECT conv_id, turn, round(avg(rate), 6) AS excess_repetition FROM x GROUP BY 1, 2""")
def m5(spark, d):
    return excess_repetition(spread(turn_pairs(spark, d), "conv_id", "turn"), ["conv_id", "turn"], "ref", "hyp").withColumn("excess_repetition", F.round("excess_repetition", 6))


@query("m6_run_extremes")
def m6(spark, d):
    return scored(spark, d).select("conv_id", "turn", "max_run", "max_excess")


@query("m7_covered_region")
def m7(spark, d):
    return scored(spark, d).select("conv_id", "turn", "wer_covered", "covered_words", "covered_errors")


@query("m8_duration_metrics", SPANS + """, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t)
SELECT user_id, round(sum(e - greatest(start, coalesce(reach, start))) FILTER (WHERE e > coalesce(reach, start)), 3) AS voiced, round(max(start - reach), 3) AS longest_gap, round(sum(e - greatest(start, coalesce(reach, start))) FILTER (WHERE e > coalesce(reach, start)) / (max(e) - min(start)), 6) AS voiced_ratio FROM m GROUP BY 1""")
def m8(spark, d):
    before = Window.partitionBy("user_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    m = event_spans(spark, d).withColumn("reach", F.max("end").over(before))
    zero = F.coalesce("reach", "start")
    new = F.sum(F.when(F.col("end") > zero, F.col("end") - F.greatest("start", zero)))
    return m.groupBy("user_id").agg(F.round(new, 3).alias("voiced"), F.round(F.max(F.col("start") - F.col("reach")), 3).alias("longest_gap"), F.round(new / (F.max("end") - F.min("start")), 6).alias("voiced_ratio"))


STATUS = """WITH x AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'oom' ELSE 'complete' END AS gen, value > 3 AS usable, 0.9 + value / 1000 * 2 AS cov, value / 200 AS over, event_id % 4 > 0 AS fl, (event_id % 50) / 200.0 AS ex, event_id % 9 // 2 AS run, CASE WHEN event_type = 'view' THEN 'flow' ELSE 'ar' END AS family FROM events),
s AS (SELECT event_id, family, CASE WHEN gen <> 'complete' THEN gen WHEN NOT usable THEN 'invalid_audio' WHEN cov < 0.95 THEN 'early_eos' WHEN (fl AND over >= 0.3) OR ex >= 0.2 OR run >= 3 THEN 'degraded' ELSE 'complete' END AS status FROM x)"""


def statuses(spark, d):
    v, k = F.col("value"), F.col("event_id")
    e = table(spark, d, "events")
    gen = F.when(F.col("event_type") == "error", "oom").otherwise("complete")
    status = final_status(gen, F.lit("eos"), v > 3, 0.9 + v / 1000 * 2, v / 200, k % 4 > 0, (k % 50) / 200.0, F.floor(k % 9 / 2))
    return e.select("event_id", F.when(F.col("event_type") == "view", "flow").otherwise("ar").alias("family"), status.alias("status"))


@query("m9_final_status", STATUS + " SELECT status, count(*) AS n FROM s GROUP BY 1")
def m9(spark, d):
    return statuses(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("m10_flow_status", STATUS + " SELECT family, CASE WHEN family = 'flow' AND status = 'early_eos' THEN 'incomplete_text' ELSE status END AS status, count(*) AS n FROM s GROUP BY 1, 2")
def m10(spark, d):
    s = statuses(spark, d)
    return s.groupBy("family", flow_status(F.col("family"), F.col("status")).alias("status")).agg(F.count("*").alias("n"))


@query("m11_stop_distance", r"""WITH s AS (SELECT conv_id, turn, sum(len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS words FROM conversations), x AS (SELECT conv_id, max(words) AS total, max(words) * 2 // 3 AS stop FROM s GROUP BY 1)
SELECT conv_id, CAST(min(abs(words - stop)) AS BIGINT) AS distance, round(count(DISTINCT words) / any_value(total), 6) AS chance FROM s JOIN x USING (conv_id) GROUP BY 1""")
def m11(spark, d):
    from .selection import sentence_ends

    s = sentence_ends(spark, d)
    x = s.groupBy("conv_id").agg(F.max("words").alias("total"), F.floor(F.max("words") * 2 / 3).alias("stop"))
    return s.join(x, "conv_id").groupBy("conv_id").agg(F.min(F.abs(F.col("words") - F.col("stop"))).alias("distance"), F.round(F.count_distinct("words") / F.first("total"), 6).alias("chance"))


@query("m12_recomputed_metrics")
def m12(spark, d):
    """Stored errors of each pair against their recount by another way: a distance of strings with a letter for each word.

    A pair of more different words than there are letters for has no recount.
    """
    texts = spread(turn_pairs(spark, d), "conv_id", "turn").withColumns({"ref": normalise_plain(F.col("ref")), "hyp": normalise_plain(F.col("hyp"))})
    stored = texts.select("conv_id", "turn", "ref", "hyp", word_metrics("ref", "hyp").alias("m"))
    rows = stored.select("*", words(F.col("ref")).alias("r"), words(F.col("hyp")).alias("h")).withColumn("known", F.array_distinct(F.concat("r", "h")))
    letter = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position("known", w) + 0xFF), 4, "0")), "UTF-16BE")
    coded = [F.array_join(F.transform(c, letter), "") for c in ("r", "h")]
    recount = F.when(F.size("known") < 0xD000, F.levenshtein(*coded))
    out = rows.select("conv_id", "turn", (F.col("m.substitutions") + F.col("m.deletions") + F.col("m.insertions")).alias("errors"), recount.alias("recounted"), "m")
    sound = (F.col("m.hits") + F.col("m.substitutions") + F.col("m.deletions") == F.col("m.n_ref")) & (F.col("m.hits") + F.col("m.substitutions") + F.col("m.insertions") == F.col("m.n_hyp"))
    return out.select("conv_id", "turn", "errors", "recounted", (sound & F.col("errors").eqNullSafe(F.col("recounted"))).alias("agrees"))


@query("m13_window_agreement")
def m13(spark, d):
    ratios = spread(turn_pairs(spark, d), "conv_id", "turn").select("conv_id", similarity_ratio("ref", "hyp").alias("ratio"))
    return ratios.groupBy("conv_id").agg(F.round(F.median("ratio"), 6).alias("median_ratio"))


@query("m15_stable_words", r"SELECT conv_id, CAST(sum(least(40, len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')))) AS BIGINT) AS stable FROM conversations GROUP BY 1")
def m15(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(restricted_words(F.size(words(F.col("text"))), 40)).alias("stable"))


@query("z34_english_metrics")
def z34(spark, d):
    """Content metrics under English normalisation on both sides."""
    pairs = spread(turn_pairs(spark, d), "conv_id", "turn").withColumns({"ref": normalise_english("ref"), "hyp": normalise_english("hyp")})
    return pairs.select("conv_id", "turn", word_metrics("ref", "hyp").alias("m")).select("conv_id", "turn", "m.*")


@query("z71_covered_from_texts")
def z71(spark, d):
    """The covered region's errors, from texts as they are: normalised leniently, aligned, counted."""
    pairs = spread(turn_pairs(spark, d), "conv_id", "turn").withColumns({"ref": normalise_lenient("ref"), "hyp": normalise_lenient("hyp")})
    m = pairs.select("conv_id", "turn", word_metrics("ref", "hyp").alias("m"))
    return m.select("conv_id", "turn", "m.wer_covered", "m.covered_words", "m.covered_errors", F.try_divide("m.covered_words", "m.n_ref").alias("covered_share"))


@query("z42_cache_bytes", r"""SELECT doc_id, 2 * 24 * 8 * 128 * 2 * CAST(len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS BIGINT) AS cache_bytes FROM documents""")
def z42(spark, d):
    """Bytes of keys and values that a text's positions take: two of each layer, head and dimension."""
    layers, heads, width, number_bytes = 24, 8, 128, 2
    return table(spark, d, "documents").select("doc_id", (F.size(words(F.col("text"))).cast("long") * (2 * layers * heads * width * number_bytes)).alias("cache_bytes"))


@query("z30_prepared_roots")
def z30(spark, d):
    """Conversations as roots, a turn a group of ten seconds: windowed, rejected or cleaned."""
    groups = table(spark, d, "conversations").select("conv_id", (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 9).alias("end"), "text")
    return prepared_roots(spread(groups, "conv_id"), "conv_id", window=60.0, look=20.0, latest=30.0, opening=r"\b(hello|welcome)\b", forbid_latin=False)
