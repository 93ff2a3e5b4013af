"""A training-data pipeline in stages, each one of the operators at work.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept.  All but the last return the columns of documents; the last
one returns the places of the pieces in packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.jaccard_join import jaccard_components
from corpuslab.llm.packing import pack_documents
from corpuslab.llm.quality import quality_scores
from corpuslab.llm.shared import table, with_private_names, written
from corpuslab.llm.toxicity import toxicity_scores


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good.

    Null and empty texts are scored too, and stay or go by their scores; rows
    without an id and repeated rows are kept or dropped each by its own text; an
    empty table stays empty; columns of any other name come through as they are.
    """
    scored = quality_scores(docs, table(spark, sf_dir, "labels"), whole_rows=True)
    return scored.filter("predicted = 1").select("document.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic.

    Null and empty texts hold no toxic token and stay; rows without an id and
    repeated rows are judged each by its own text; an empty table stays empty;
    columns of any other name come through as they are.
    """
    scored = toxicity_scores(docs, table(spark, sf_dir, "labels"), whole_rows=True)
    return scored.filter("predicted = 0").select("document.*")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, then of the smallest hash of its text.

    Rows are told apart by id and text; without an id, or beside another text of
    the same id, a row that is a copy of nothing stays.  Of rows equal in both,
    one stays.  So does every row without words.  No rows give none; columns of
    any other name come through as they are.  The keys are written first, so
    that the join meets plain shuffles, whose skewed partitions Spark can split.
    """
    source, names = with_private_names(docs, "doc_id", "text")
    rows = jaccard_components(source, "__id", "__text", shingle_words=5, num=4, den=5, row_keys=True).filter("group is not null")
    first = F.min(F.struct(F.col("__id").isNull().alias("no_id"), F.coalesce("__id", F.lit(0)).alias("row_id"), "text_hash"))
    keys = ["no_id", "row_id", "text_hash"]
    kept = written(rows.groupBy("group").agg(first.alias("row")).select("row.*"), "pipeline-kept")
    worded = F.coalesce(F.col("__text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = source.filter(worded).select("*", F.col("__id").isNull().alias("no_id"), F.coalesce(F.col("__id").cast("long"), F.lit(0)).alias("row_id"), F.xxhash64("__text").alias("text_hash"))
    one = keyed.join(kept, keys, "left_semi").dropDuplicates(keys)
    return one.select(source.columns).unionByName(source.filter(~worded)).select(*(F.col(own).alias(c) for c, own in names.items()))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 1024 tokens.

    Null and empty texts have a piece of one token; rows without an id and
    repeated rows are packed each on its own; no rows give none.
    """
    return pack_documents(docs, size=1024, end_id=2)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("best-fit packing", packing_stage),
]

# classifiers and packing are not to be had in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "pipeline-stage")
    return docs
