"""Cluster bootstrap, paired contrasts, least squares.

Draws come from a hash of (seed, resample, draw), so that any engine, order and
partitioning gives the same ones; rows are first summed to clusters, so the
resamples never multiply rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hash_int(*parts: Column) -> Column:
    """32 bits of the md5 of the parts joined by colons."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def cluster_sums(df: DataFrame, cluster: str, value: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums and counts of finite values per cluster, and clusters numbered from 0 by name."""
    ok = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value)
    sums = df.groupBy(*keys, cluster).agg(F.sum(ok).alias("s"), F.count(ok).alias("n"))
    # numbered over clusters, of which there are few compared with rows
    return sums.withColumn("index", F.dense_rank().over(Window.partitionBy(*keys).orderBy(cluster)) - 1)


def draws(spark, resamples: int, clusters: int, seed: int) -> DataFrame:
    """(resample, index, times): how often each cluster is drawn, with replacement."""
    grid = spark.range(resamples).select(F.col("id").alias("resample"), F.explode(F.sequence(F.lit(0), F.lit(clusters - 1))).alias("draw"))
    index = (hash_int(F.lit(seed), F.col("resample"), F.col("draw")) % clusters).cast("int")
    return grid.select("resample", index.alias("index")).groupBy("resample", "index").agg(F.count("*").alias("times"))


def draws_by_count(counts: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(clusters, resample, index, times): one set of draws for each number of clusters in ``counts``."""
    grid = counts.select("clusters").distinct().withColumn("resample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
    grid = grid.withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("clusters") - 1)))
    index = (hash_int(F.lit(seed), F.col("resample"), F.col("draw")) % F.col("clusters")).cast("int")
    return grid.select("clusters", "resample", index.alias("index")).groupBy("clusters", "resample", "index").agg(F.count("*").alias("times"))


def analysis(values: DataFrame, drawn: DataFrame, crossed: DataFrame, contrasts: list[tuple[str, str]], alpha: float = 0.05) -> DataFrame:
    """Estimates and intervals of all cells, arms, contrasts, metrics and methods, a row each.

    ``values`` has sums ``s`` and counts ``n`` by cell, arm, metric and the two
    numbered levels ``a`` (sources) and ``b`` (voices); ``drawn`` and ``crossed``
    tell how often a resample draws each source and each voice.  The method
    ``source`` keeps the voices, ``crossed`` multiplies both.
    """
    keys = ["cell", "metric", "arm"]
    rows = values.join(drawn.select("resample", F.col("index").alias("a"), F.col("times").alias("ta")), "a")
    rows = rows.join(crossed.select("resample", F.col("index").alias("b"), F.col("times").alias("tb")), ["resample", "b"], "left")
    weights = F.explode(F.create_map(F.lit("source"), F.col("ta"), F.lit("crossed"), F.col("ta") * F.coalesce("tb", F.lit(0)))).alias("method", "w")
    rows = rows.select("resample", *keys, "s", "n", weights)
    means = rows.groupBy(*keys, "method", "resample").agg(F.try_divide(F.sum(F.col("s") * F.col("w")), F.sum(F.col("n") * F.col("w"))).alias("mean"))
    points = values.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("estimate"), F.sum("n").alias("n_attempts"))
    out = interval(means, (*keys, "method"), alpha).join(points, keys).withColumnRenamed("arm", "arm_a").withColumn("arm_b", F.lit(None).cast("string"))
    for a, b in contrasts:
        left, right = (df.filter(F.col("arm") == arm).drop("arm") for df, arm in ((means, a), (means, b)))
        on = ["cell", "metric", "method", "resample"]
        delta = left.join(right.withColumnRenamed("mean", "other"), on).select(*on, (F.col("mean") - F.col("other")).alias("mean"))
        left, right = (points.filter(F.col("arm") == arm).drop("arm") for arm in (a, b))
        point = left.join(right.select("cell", "metric", F.col("estimate").alias("other")), ["cell", "metric"])
        point = point.select("cell", "metric", (F.col("estimate") - F.col("other")).alias("estimate"), "n_attempts")
        own = interval(delta, ("cell", "metric", "method"), alpha).join(point, ["cell", "metric"])
        out = out.unionByName(own.withColumns({"arm_a": F.lit(a), "arm_b": F.lit(b)}))
    return out


def content_only(payload: DataFrame, dependent: tuple[str, ...]) -> DataFrame:
    """An analysis without the metrics, and the counts, that depend on a floor."""
    return payload.filter(~F.col("metric").isin(*dependent)).drop("n_attempts")


def bootstrap_means(sums: DataFrame, drawn: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of each resample: drawn cluster sums over drawn counts; null if nothing is drawn."""
    rows = drawn.join(F.broadcast(sums), "index")  # one row per cluster and cell
    return rows.groupBy(*keys, "resample").agg(F.try_divide(F.sum(F.col("s") * F.col("times")), F.sum(F.col("n") * F.col("times"))).alias("mean"))


def interval(means: DataFrame, keys: tuple[str, ...] = (), alpha: float = 0.05, value: str = "mean") -> DataFrame:
    """Percentile interval of finite resample values, and how many there are and are not."""
    v = F.col(value)
    ok = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return means.groupBy(*keys).agg(
        F.percentile(ok, F.lit(alpha / 2)).alias("lo"), F.percentile(ok, F.lit(1 - alpha / 2)).alias("hi"),
        F.count(ok).alias("n_valid"), (F.count("*") - F.count(ok)).alias("n_empty"), (F.min(ok) == F.max(ok)).alias("degenerate"),
    )


def two_sided_p(means: DataFrame, value: str = "mean") -> DataFrame:
    """Twice the smaller tail at zero, at least one resample's share, at most 1."""
    low, high = F.avg((F.col(value) <= 0).cast("double")), F.avg((F.col(value) >= 0).cast("double"))
    return means.agg(F.least(F.lit(1.0), F.greatest(2 * F.least(low, high), 1 / F.count("*"))).alias("p"))


def normal_sums(df: DataFrame, cluster: str, x: list[Column], y: Column) -> DataFrame:
    """The sums of products of each cluster that least squares needs."""
    columns = [F.lit(1.0), *(c.cast("double") for c in x)]
    products = [F.sum(a * b) for i, a in enumerate(columns) for b in columns[i:]]
    return df.groupBy(cluster).agg(F.array(*products).alias("xx"), F.array(*(F.sum(a * y) for a in columns)).alias("xy"))


def _solve(xx: np.ndarray, xy: np.ndarray) -> np.ndarray | None:
    size = len(xy)
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = xx
    full = full + np.triu(full, 1).T
    return np.linalg.solve(full, xy) if np.linalg.matrix_rank(full) == size else None


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solved(xx: pd.Series, xy: pd.Series) -> pd.Series:
    """Coefficients from summed products; null where they are not determined."""
    return pd.Series([_solve(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(xx, xy)])


def add_arrays(column: str, size: int, times: Column | None = None) -> Column:
    """Elementwise sums of an array column over a group."""
    weight = times if times is not None else F.lit(1)
    return F.array(*(F.sum(F.col(column)[k] * weight) for k in range(size)))
