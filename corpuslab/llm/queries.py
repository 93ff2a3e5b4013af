"""The registered queries of this subpackage: thin digests of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode
from .chat import format_chat, loss_text, read_back
from .jaccard_join import jaccard_components
from .packing import pack_documents
from .pseudo_likelihood import pseudo_likelihood
from .quality import quality_scores
from .repetition import repetition_rules
from .shared import table
from .topk import quantised, top_k
from .toxicity import toxicity_scores
from .warc import read_records, write_bundles


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, ended by id 2."""
    return pack_documents(table(spark, sf_dir, "documents"), size=1024, end_id=2)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted, and what is read back from that."""
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{probe}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_chat(rows)
    turns, loss = read_back(F.col("formatted")), loss_text(F.col("formatted"), F.col("loss_spans"))
    out = out.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP2_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)
), sized AS (
  SELECT *, len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\])'))
          + len(regexp_extract_all(role, '[<\[]\\*(\||/?s>|/?INST\])')) AS escapes
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + escapes + 23) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op3_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for each embedding whose id 20 divides."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("vector"))
    return top_k(vectors.filter("vec_id % 20 = 0"), vectors, k=20)


OP3_SQL = r"""
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at a similarity of 0.9 on three-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"), shingle_words=3, num=90, den=100)


OP4_SQL = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM toks
), grams AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS root FROM sets UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.doc_id
), low AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, len(g) AS n_shingles, component_id FROM sets JOIN low USING (doc_id)
"""


def op5_suffix_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of repetition for all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition_rules(docs).drop("spans")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for all documents."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score, and toxic spans, for all documents."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to bundles and read back."""
    index = write_bundles(table(spark, sf_dir, "pages"), least_bytes=0)
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), b AS (
  SELECT *, CAST(unhex(x) AS BIT)::VARCHAR AS bits, max(page_id) OVER (PARTITION BY x) AS keeper FROM p
)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
      + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT AS BIGINT), 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM b
"""


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo-likelihood of all documents under a network trained on them."""
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    decoded = bpe_decode(bpe_encode(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_maxscore_topk": op3_maxscore_topk,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_suffix_repetition_rules": op5_suffix_repetition_rules,
    "op7_warc_bundles": op7_warc_bundles,
    "op8_pseudo_likelihood": op8_pseudo_likelihood,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op6_quality_classifier": op6_quality_classifier,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": OP2_SQL,
    "op3_maxscore_topk": OP3_SQL,
    "op4_ngram_jaccard_join": OP4_SQL,
    "op7_warc_bundles": OP7_SQL,
}
