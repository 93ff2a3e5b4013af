"""Shingle leakage between sets of texts, and similarity of embeddings between groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELD_BITS = 1 << 20  # of the map that tells which grams the held-out side may have
HELD_WORDS = 1 << 20  # whose shingles a task makes at a time
MIX = np.uint64(0x9E3779B97F4A7C15)


def distinct_shingles(words: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts given as one array of word hashes and their lengths: distinct shingles, text after text, and how many each has."""
    starts = np.cumsum(lengths) - lengths
    many, short = words, {}
    for k in range(n):  # each shingle's hash takes in the word k places on
        if k:
            many = (many[:-1] ^ (many[:-1] >> np.uint64(32))) * MIX + words[k:]
        if k < n - 1:
            ended = np.flatnonzero(lengths == k + 1)
            short |= zip(ended.tolist(), many[starts[ended]])
    own = [np.unique(many[s : s + c - n + 1]) if c >= n else np.array([short[i]] if c else [], np.uint64) for i, (s, c) in enumerate(zip(starts.tolist(), lengths.tolist()))]
    return np.concatenate([np.zeros(0, np.uint64), *own]), np.array([len(x) for x in own], np.int64)


def shingles(tokens: Column, n: int) -> Column:
    """Distinct n-word shingles as 64-bit hashes; a shorter text is one shingle, an empty one has none.

    Word hashes go to numpy, which holds a bounded number of them besides the batch.
    """

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def of(rows: pa.Array) -> pa.Array:
        lengths = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        words, ends = rows.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(lengths)
        parts, at = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        while at < len(lengths):
            begin = ends[at] - lengths[at]
            stop = max(at + 1, int(np.searchsorted(ends, begin + HELD_WORDS, "right")))
            parts.append(distinct_shingles(words[begin : ends[stop - 1]], lengths[at:stop], n))
            at = stop
        found, counts = (np.concatenate(x) for x in zip(*parts))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(found.view(np.int64)))

    return of(F.transform(tokens, lambda w: F.xxhash64(w)))


def gram_sets(df: DataFrame, key: str, tokens: Column, n: int) -> DataFrame:
    """(key, size, grams) with the distinct shingles of each text."""
    sets = df.select(F.col(key), shingles(tokens, n).alias("grams"))
    return sets.select(key, F.size("grams").alias("size"), "grams")


def gram_table(df: DataFrame, key: str, tokens: Column, n: int) -> DataFrame:
    """(key, size, gram) with one row per distinct shingle."""
    return gram_sets(df, key, tokens, n).select(key, "size", F.explode("grams").alias("gram"))


def shared_grams(held: DataFrame, train: DataFrame, held_key: str, train_key: str) -> DataFrame:
    """Pairs with a common shingle, of a gram table and of gram sets: their count and Jaccard similarity.

    A map of fixed size over the held-out side's grams thins the sets of the
    other side before they are exploded; the join decides.
    """
    place = lambda g: F.pmod(g, F.lit(HELD_BITS)).cast("int")
    spots = held.select(F.floor(place(F.col("gram")) / 64).cast("int").alias("w"), (place(F.col("gram")) % 64).alias("b")).distinct()
    words = np.zeros(HELD_BITS // 64, np.int64)
    for w, bits in spots.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)"))).collect():  # HELD_BITS / 64 rows at most
        words[w] = bits
    held_map = F.lit(np.unpackbits(words.view(np.uint8), bitorder="little").tobytes())
    some = F.filter("grams", lambda g: F.substr(held_map, place(g) + 1, F.lit(1)) == F.lit(b"\x01"))
    t = train.select(train_key, F.col("size").alias("train_size"), F.explode(some).alias("gram"))
    pairs = held.join(t, "gram").groupBy(held_key, train_key).agg(F.count("*").alias("n_shared"), F.first("size").alias("a"), F.first("train_size").alias("b"))
    return pairs.select(held_key, train_key, "n_shared", (F.col("n_shared") / (F.col("a") + F.col("b") - F.col("n_shared"))).alias("jaccard"))


def max_jaccard(held_docs: DataFrame, pairs: DataFrame, held_key: str, train_key: str, k: int = 3) -> DataFrame:
    """Per held-out text: its largest similarity (0 without any) and its k nearest texts."""
    w = Window.partitionBy(held_key).orderBy(F.desc("jaccard"), F.desc(train_key))
    near = pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    near = near.groupBy(held_key).agg(F.max("jaccard").alias("jaccard"), F.transform(F.sort_array(F.collect_list(F.struct("place", train_key))), lambda x: x[train_key]).alias("nearest"))
    return held_docs.select(held_key).join(near, held_key, "left").withColumn("jaccard", F.coalesce("jaccard", F.lit(0.0)))


def unit(vector: Column) -> Column:
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: x / F.nullif(length, F.lit(0.0)))


def mean_vectors(df: DataFrame, group: str, vector: str, of_units: bool = False) -> DataFrame:
    """Mean vector per group, scaled to length 1; ``of_units`` averages scaled vectors."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(group, F.posexplode(unit(v) if of_units else v).alias("k", "x"))
    means = rows.groupBy(group, "k").agg(F.avg("x").alias("x")).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("p"))
    return means.select(group, unit(F.col("p.x")).alias("mean"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def group_similarity(means: DataFrame, group: str) -> DataFrame:
    """Cosine of each pair of different groups; there are few groups."""
    a = means.select(F.col(group).alias("left"), F.col("mean").alias("u"))
    b = means.select(F.col(group).alias("right"), F.col("mean").alias("v"))
    return a.join(b, F.col("left") != F.col("right")).select("left", "right", dot(F.col("u"), F.col("v")).alias("cosine"))
