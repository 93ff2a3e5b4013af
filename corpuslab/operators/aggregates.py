"""Aggregates with explicit rules for missing and infinite values, and group rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def finite(x: Column) -> Column:
    """x if it is a finite number, else null."""
    return F.when(~missing(x) & (F.abs(x) != INF), x)


def finite_mean(x: Column, name: str) -> list[Column]:
    """Mean of finite values, and how many are finite, infinite and missing.

    Infinite values alone give infinity, no values at all give null.
    """
    ok = finite(x)
    n_inf = F.count_if(~missing(x) & (F.abs(x) == INF))
    mean = F.when(F.count(ok) > 0, F.avg(ok)).when(n_inf > 0, F.lit(INF))
    return [mean.alias(name), F.count(ok).alias(f"{name}_n_finite"), n_inf.alias(f"{name}_n_inf"), F.count_if(missing(x)).alias(f"{name}_n_missing")]


def macro_micro(errors: Column, length: Column) -> list[Column]:
    """Mean of the rows' rates and rate of the rows' totals; empty references are infinite rates."""
    rate = F.when(length > 0, errors / length).when(errors > 0, F.lit(INF)).otherwise(F.lit(0.0))
    return [*finite_mean(rate, "macro"), F.try_divide(F.sum(errors), F.sum(length)).alias("micro")]


def upper_median(x: Column) -> Column:
    """The element at n // 2 of the sorted values: for an even count the upper of the middle two.

    Values are collected for each group; use it on groups of bounded size.
    """
    values = F.sort_array(F.collect_list(x))
    return F.try_element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def order_statistic(x: Column, q: float, clamp_to_n: bool = False) -> Column:
    """The element at int(q * (n - 1)), or at min(n - 1, int(q * n)), of the sorted values."""
    values = F.sort_array(F.collect_list(x))
    n = F.size(values)
    at = F.least(n - 1, F.floor(n * q)) if clamp_to_n else F.floor((n - 1) * q)
    return F.try_element_at(values, (at + 1).cast("int"))


def with_all(df: DataFrame, group: str, bucket: str, *aggregates: Column, label: str = "ALL") -> DataFrame:
    """Aggregates by group and bucket, and by group alone under the bucket ``label``."""
    out = df.groupingSets([[F.col(group), F.col(bucket)], [F.col(group)]], F.col(group), F.col(bucket)).agg(F.grouping(bucket).alias("__all"), *aggregates)
    return out.withColumn(bucket, F.when(F.col("__all") == 1, F.lit(label)).otherwise(F.col(bucket).cast("string"))).drop("__all")


def histogram(df: DataFrame, x: Column, edges: list[float], group: str | None = None) -> DataFrame:
    """Counts in [edge, next edge), the last bin closed; bins without values count 0."""
    spark = df.sparkSession
    last = len(edges) - 2
    bin_no = F.when(x == edges[-1], last).otherwise(F.coalesce(*(F.when((x >= a) & (x < b), k) for k, (a, b) in enumerate(zip(edges, edges[1:])))))
    keys = [group] if group else []
    counts = df.select(*keys, bin_no.alias("bin")).filter("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    bins = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, low double, high double")
    frame = df.select(*keys).distinct().crossJoin(F.broadcast(bins)) if group else bins  # a fixed number of bins
    return frame.join(counts, [*keys, "bin"], "left").fillna(0, ["n"])


def compare_tables(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Cells that differ by more than a tolerance, or that one side lacks."""
    a = left.select(*keys, F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(F.col(v).cast("double") for v in values))).alias("a"))
    b = right.select(*keys, F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(F.col(v).cast("double") for v in values))).alias("b"))
    cells = a.join(b, keys, "full").select(*keys, F.explode(F.array(*map(F.lit, values))).alias("field"), "a", "b")
    cells = cells.select(*keys, "field", F.try_element_at("a", F.col("field")).alias("left"), F.try_element_at("b", F.col("field")).alias("right"))
    return cells.filter(~(F.col("left").eqNullSafe(F.col("right")) | (F.coalesce(F.abs(F.col("left") - F.col("right")), F.lit(INF)) <= tolerance)))
