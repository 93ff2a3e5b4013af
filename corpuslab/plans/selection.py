"""Selection queries: greedy choice, cuts, candidates, batches, mixes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.paired import free_of
from ..operators.selection import batched, best_disjoint_pair, capped_greedy, nested_cuts, pattern_mix, segmented
from .base import query, table
from .joins import SPANS, event_spans

WORDS = r"len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))"


@query("p1_segmentation")
def p1(spark, d):
    t = event_spans(spark, d)
    first = t.groupBy("user_id").agg(F.min("start").alias("zero"))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("start", "event_id")) - 1
    lines = t.join(first, "user_id").select("user_id", (k * 4.0).alias("start"), (k * 4.0 + 2 + F.col("end") % 2).alias("end"))
    return segmented(lines, "user_id", "start", "end", 10.0, 30.0, 20.0)


@query("p2_split_search")
def p2(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.groupBy("source").agg(F.sum("n_chars").alias("size"), F.collect_set((F.col("doc_id") % 40).cast("string")).alias("clusters")).collect()  # one row per source
    profiles = [{"name": r["source"], "size": float(r["size"]), "clusters": [c for c in r["clusters"] if int(c) % 20 == len(r["source"])]} for r in rows]
    total = sum(p["size"] for p in profiles)
    pair = best_disjoint_pair(profiles, 0.05 * total, 0.12 * total, 2) or ((), ())
    split = F.when(F.col("source").isin(*pair[0]), "validation").when(F.col("source").isin(*pair[1]), "test").otherwise("train")
    return docs.select("doc_id", "source", split.alias("split"))


@query("p3_capped_greedy", """
WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents WHERE n_chars < 20000),
f AS (SELECT source, doc_id, n_chars, k, n_chars <= 20000 AS taken, CASE WHEN n_chars <= 20000 THEN n_chars ELSE 0 END AS used FROM o WHERE k = 1
  UNION ALL SELECT o.source, o.doc_id, o.n_chars, o.k, f.used + o.n_chars <= 20000, f.used + CASE WHEN f.used + o.n_chars <= 20000 THEN o.n_chars ELSE 0 END FROM f JOIN o ON o.source = f.source AND o.k = f.k + 1),
t AS (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f WHERE taken)
SELECT source, doc_id, n_chars FROM t WHERE before < 300000""")
def p3(spark, d):
    docs = table(spark, d, "documents").filter("n_chars < 20000").select("source", "doc_id", "n_chars")
    return capped_greedy(docs, "source", -F.col("n_chars"), F.col("doc_id"), "n_chars", 20000.0, 300000)


ENDS = "WITH s AS (SELECT conv_id, turn, sum(" + WORDS + ") OVER (PARTITION BY conv_id ORDER BY turn) AS words FROM conversations), b AS (SELECT unnest([50, 150, 300]) AS centre)"


def sentence_ends(spark, d):
    from ..functions.text import words

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.size(words(F.col("text")))).over(w).alias("words"))


@query("p4_bucket_cuts", ENDS + " SELECT conv_id, centre, turn FROM s, b QUALIFY row_number() OVER (PARTITION BY conv_id, centre ORDER BY abs(words - centre), turn) = 1")
def p4(spark, d):
    s = sentence_ends(spark, d).withColumn("centre", F.explode(F.array(*map(F.lit, (50, 150, 300)))))
    return s.groupBy("conv_id", "centre").agg(F.min(F.struct(F.abs(F.col("words") - F.col("centre")), "turn")).alias("b")).select("conv_id", "centre", "b.turn")


def _cuts(spark, d, skip_empty):
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        found = nested_cuts(pdf["words"].to_numpy(), [50.0, 100.0, 150.0, 300.0, 600.0], skip_empty)
        rows = [(pdf["conv_id"].iloc[0], k, int(pdf["turn"].iloc[c])) for k, c in enumerate(found) if c is not None]
        return pd.DataFrame(rows, columns=["conv_id", "bucket", "turn"]).astype({"conv_id": np.int64, "bucket": np.int32, "turn": np.int64})

    return sentence_ends(spark, d).groupBy("conv_id").applyInPandas(run, "conv_id long, bucket int, turn long")


@query("p4_nested_cuts")
def p4_nested(spark, d):
    return _cuts(spark, d, False)


@query("z63_skipping_cuts")
def z63(spark, d):
    return _cuts(spark, d, True)


@query("p5_balanced_genres", """
WITH f AS (SELECT source, avg(len(regexp_extract_all(text, '[?!]'))) AS q, avg(n_chars) AS n FROM documents GROUP BY 1), z AS (SELECT source, (q - avg(q) OVER ()) / stddev_pop(q) OVER () AS zq, (n - avg(n) OVER ()) / stddev_pop(n) OVER () AS zn FROM f)
SELECT source, CASE WHEN row_number() OVER (ORDER BY zq - zn DESC, source) <= 10 THEN 'lively' ELSE 'long' END AS genre FROM z""")
def p5(spark, d):
    f = table(spark, d, "documents").groupBy("source").agg(F.avg(F.regexp_count("text", F.lit("[?!]"))).alias("q"), F.avg("n_chars").alias("n"))
    everything = Window.partitionBy()  # one row per source
    z = lambda c: (F.col(c) - F.avg(c).over(everything)) / F.stddev_pop(c).over(everything)
    f = f.select("source", (z("q") - z("n")).alias("lead"))
    rank = F.row_number().over(Window.orderBy(F.desc("lead"), "source"))
    return f.select("source", F.when(rank <= 10, "lively").otherwise("long").alias("genre"))


CANDIDATES = """ SELECT a.user_id, a.event_id AS first, b.event_id AS last, b.e - a.start AS length FROM t a JOIN t b ON a.user_id = b.user_id AND a.start <= b.start AND b.e - a.start BETWEEN 3600 AND 86400"""


@query("p6_span_candidates", SPANS + ", c AS (" + CANDIDATES + ") SELECT user_id, first, last FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(length - 40000), first, last) = 1")
def p6(spark, d):
    t = event_spans(spark, d)
    a, b = t.select("user_id", F.col("event_id").alias("first"), "start"), t.select("user_id", F.col("event_id").alias("last"), F.col("start").alias("s2"), "end")
    length = F.col("end") - F.col("start")
    # a partner begins on the same day or the next one: an equi-join on days keeps the pairs near the candidates
    a, b = a.withColumn("day", F.floor(F.col("start") / 86400)), b.withColumn("day", F.explode(F.array(F.floor(F.col("s2") / 86400), F.floor(F.col("s2") / 86400) - 1)))
    c = a.join(b, (a["user_id"] == b["user_id"]) & (a["day"] == b["day"]) & (F.col("start") <= F.col("s2")) & length.between(3600, 86400)).select(a["user_id"], "first", "last", F.abs(length - 40000).alias("off"))
    return c.groupBy("user_id").agg(F.min(F.struct("off", "first", "last")).alias("best")).select("user_id", "best.first", "best.last")


@query("p7_reference_unit", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, arg_max(lang, n * 1000 - ascii(lang)) AS unit, max(n) AS n FROM c GROUP BY 1")
def p7(spark, d):
    c = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(F.max_by("lang", F.col("n") * 1000 - F.ascii("lang")).alias("unit"), F.max("n").alias("n"))


@query("p8_gated_windows", SPANS + ", g AS (SELECT *, start - lag(e) OVER (PARTITION BY user_id ORDER BY start, event_id) AS gap FROM t) SELECT event_id, round(gap, 3) AS gap FROM g WHERE gap BETWEEN 60 AND 600 AND e - start BETWEEN 61 AND 200")
def p8(spark, d):
    gap = F.col("start") - F.lag("end").over(Window.partitionBy("user_id").orderBy("start", "event_id"))
    t = event_spans(spark, d).withColumn("gap", gap)
    return t.filter(F.col("gap").between(60, 600) & (F.col("end") - F.col("start")).between(61, 200)).select("event_id", F.round("gap", 3).alias("gap"))


@query("z64_reference_after", SPANS + ", l AS (SELECT user_id, max(e) AS stop FROM t WHERE event_type = 'purchase' GROUP BY 1) SELECT t.user_id, event_id FROM t JOIN l USING (user_id) WHERE start >= stop + 1 QUALIFY row_number() OVER (PARTITION BY t.user_id ORDER BY start, event_id) = 1")
def z64(spark, d):
    t = event_spans(spark, d)
    stop = t.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("end").alias("stop"))
    after = t.join(stop, "user_id").filter(F.col("start") >= F.col("stop") + 1)
    return after.groupBy("user_id").agg(F.min(F.struct("start", "event_id")).alias("m")).select("user_id", "m.event_id")


@query("p6_free_spans", SPANS + " SELECT a.event_id FROM t a WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM t b WHERE b.event_type = 'error' AND a.user_id = b.user_id AND a.start < b.e AND b.start < a.e)")
def p6_free(spark, d):
    t = event_spans(spark, d)
    return free_of(t.filter("event_type = 'click'"), t.filter("event_type = 'error'"), "user_id").select("event_id")


@query("g1_token_batches")
def g1(spark, d):
    return batched(table(spark, d, "documents"), "source", "doc_id", "n_chars", 20000, 40000)


@query("g2_collated_batches")
def g2(spark, d):
    return g1(spark, d).groupBy("source", "batch").agg(F.count("*").alias("n"), F.sum("n_chars").alias("tokens"), (F.max("n_chars") * F.count("*")).alias("padded"))


@query("g3_pattern_mix", """
WITH i AS (SELECT CASE WHEN lang = 'en' THEN 'S' ELSE 'L' END AS s, doc_id FROM documents), r AS (SELECT s, doc_id, row_number() OVER (PARTITION BY s ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY s) AS n FROM i),
z AS (SELECT s, any_value(n) AS n FROM r GROUP BY 1), t AS (SELECT x AS slot, CASE WHEN x % 4 = 3 THEN 'L' ELSE 'S' END AS s, CASE WHEN x % 4 = 3 THEN x // 4 ELSE x // 4 * 3 + x % 4 END AS k FROM range(3000) u(x))
SELECT slot, t.s AS source, doc_id AS item FROM t JOIN z ON t.s = z.s JOIN r ON r.s = t.s AND r.rn = k % z.n""")
def g3(spark, d):
    docs = table(spark, d, "documents").select(F.when(F.col("lang") == "en", "S").otherwise("L").alias("kind"), "doc_id")
    return pattern_mix(docs, "kind", "doc_id", ["S", "S", "S", "L"], 3000)
