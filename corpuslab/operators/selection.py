"""Order-dependent selections: capped greedy choice, cuts, segmentation, splits, batching."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running_sum


def capped_greedy(df: DataFrame, group: str, key: Column, tie: Column, size: str, cap: float, budget: float) -> DataFrame:
    """Rows taken in order of ``key``, then ``tie``, while their group has room, until the budget is met.

    A row that its group has no room for is skipped and frees the budget for later
    ones.  The cap looks at the row's own group alone, so each group is walked
    through by a task, its sizes as one array; the budget only ends the walk, so a
    running sum over the accepted rows of all groups cuts it: a row stays if those
    before it have not met the budget.
    """
    schema = df.schema
    rows = df.withColumns({"__key": key, "__tie": tie})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__key", "__tie"], kind="stable")
        sizes, taken, used, at = pdf[size].to_numpy(float), [], 0.0, 0
        sums = np.concatenate([[0.0], np.cumsum(sizes)])
        while at < len(sizes):
            # all that fit one after the other, then on to the next row that is small enough
            stop = max(at, int(np.searchsorted(sums, sums[at] + cap - used, "right")) - 1)
            taken += range(at, stop)
            used += float(sums[stop] - sums[at])
            later = np.flatnonzero(sizes[stop:] <= cap - used)
            at = stop + int(later[0]) if len(later) else len(sizes)
        return pdf.iloc[taken][schema.names]

    taken = rows.groupBy(group).applyInPandas(walk, schema)
    return running_sum(taken, key, F.col(size), "__before", tie).filter(F.col("__before") < budget).drop("__before")


def segment(lines: list[tuple[float, float]], least: float, most: float, ideal: float) -> list[tuple[int, int]]:
    """Cut a track of timed lines into pieces near an ideal duration, by dynamic programming.

    Pieces last from least to most; the last one may be shorter, and a single
    line longer than the most is kept as it is.
    """
    n = len(lines)
    best, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for begin in range(end - 1, -1, -1):
            length = lines[end - 1][1] - lines[begin][0]
            if length > most and end - begin > 1:
                break
            if (length >= least or end == n or end - begin == 1 and length > most) and best[begin] + (length - ideal) ** 2 < best[end]:
                best[end], back[end] = best[begin] + (length - ideal) ** 2, begin
    if best[n] == float("inf"):
        return [(0, n)] if n else []
    cuts, at = [], n
    while at:
        cuts.append((back[at], at))
        at = back[at]
    return cuts[::-1]


def segmented(df: DataFrame, parent: str, start: str, end: str, least: float, most: float, ideal: float) -> DataFrame:
    """(parent, piece, first_line, last_line, start, end) of every track."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([start, end])
        lines = list(zip(pdf[start], pdf[end]))
        rows = [(pdf[parent].iloc[0], k, b, e - 1, lines[b][0], lines[e - 1][1]) for k, (b, e) in enumerate(segment(lines, least, most, ideal))]
        return pd.DataFrame(rows, columns=[parent, "piece", "first_line", "last_line", "start", "end"])

    kind = df.schema[parent].dataType.simpleString()
    return df.select(parent, start, end).groupBy(parent).applyInPandas(run, f"`{parent}` {kind}, piece int, first_line int, last_line int, start double, end double")


def best_disjoint_pair(profiles: list[dict], low: float, high: float, largest: int = 4) -> tuple[tuple, tuple] | None:
    """Two sets of groups that share no cluster and whose sizes lie in a range; the most even pair.

    Profiles are group summaries, of which there are few; ties go to the first
    sets by name.
    """
    sets = []
    for k in range(1, largest + 1):
        for picked in itertools.combinations(sorted(profiles, key=lambda p: p["name"]), k):
            size = sum(p["size"] for p in picked)
            if low <= size <= high:
                clusters = frozenset(c for p in picked for c in p["clusters"])
                sets.append((tuple(p["name"] for p in picked), size, clusters))
    pairs = ((abs(a[1] - b[1]), len(a[0]) + len(b[0]), a[0], b[0]) for a, b in itertools.combinations(sets, 2) if not set(a[0]) & set(b[0]) and not a[2] & b[2])
    best = min(pairs, default=None)
    return (best[2], best[3]) if best else None


def nested_cuts(ends: np.ndarray, centres: list[float], skip_empty: bool = False) -> list[int | None]:
    """For each bucket centre the nearest end, strictly later than the one before.

    A bucket without a later end ends the chain with null, or, with
    ``skip_empty``, is skipped alone.
    """
    out: list[int | None] = []
    last = -1
    for c in centres:
        later = np.arange(last + 1, len(ends))
        if not len(later):
            out.append(None)
            if not skip_empty:
                break
            continue
        last = int(later[np.argmin(np.abs(ends[later] - c))])
        out.append(last)
    return out + [None] * (len(centres) - len(out))


def token_batches(lengths: list[int], most_tokens: int, most_padded: int) -> list[int]:
    """Batch number of each row: a batch closes before its tokens or its padded area would exceed the limits."""
    out, batch, tokens, longest, n = [], 0, 0, 0, 0
    for length in lengths:
        if n and (tokens + length > most_tokens or max(longest, length) * (n + 1) > most_padded):
            batch, tokens, longest, n = batch + 1, 0, 0, 0
        tokens, longest, n = tokens + length, max(longest, length), n + 1
        out.append(batch)
    return out


def batched(df: DataFrame, shard: str, order: str, length: str, most_tokens: int, most_padded: int) -> DataFrame:
    """Rows of every shard in order, with batch numbers."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(batch=np.array(token_batches(pdf[length].tolist(), most_tokens, most_padded), np.int32))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(shard, order, length).schema)
    return df.select(shard, order, length).groupBy(shard).applyInPandas(run, schema + ", batch int")


def pattern_mix(df: DataFrame, source: str, order: str, pattern: list[str], slots: int) -> DataFrame:
    """Slots filled by a repeating pattern of sources; a source that runs out starts again."""
    spark = df.sparkSession
    per = {s: pattern.count(s) for s in pattern}
    rows = [(k, s, pattern[:k].count(s)) for k, s in enumerate(pattern)]
    places = F.broadcast(spark.createDataFrame(rows, "place int, __s string, seen int"))  # the pattern
    counts = F.create_map(*(F.lit(x) for s in per for x in (s, per[s])))
    slot = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") % len(pattern)).cast("int").alias("place"), F.floor(F.col("id") / len(pattern)).alias("cycle"))
    slot = slot.join(places, "place").select("slot", "__s", (F.col("cycle") * counts[F.col("__s")] + F.col("seen")).alias("k"))
    w = Window.partitionBy(source)
    items = df.select(F.col(source).alias("__s"), F.col(order).alias("item"), (F.row_number().over(w.orderBy(order)) - 1).alias("rn"), F.count("*").over(w).alias("n"))
    sizes = items.groupBy("__s").agg(F.first("n").alias("n"))
    return slot.join(F.broadcast(sizes), "__s").withColumn("rn", (F.col("k") % F.col("n")).cast("int")).join(items.drop("n"), ["__s", "rn"]).select("slot", F.col("__s").alias("source"), "item")
