"""Joins whose mismatches are errors, and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with the side's name."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def paired_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two sides that must have the same keys, each once."""
    for name, side in (("left", left), ("right", right)):
        if side.groupBy(*keys).count().filter("count > 1").limit(1).count():
            raise ValueError(f"the {name} side has a key twice")
    if unmatched(left, right, keys).limit(1).count():
        raise ValueError("the sides differ in their keys")
    return left.join(right, keys)


def overlapping(spans: DataFrame, blocked: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Spans that overlap a blocked one of the same key; touching is no overlap."""
    b = blocked.select(F.col(key).alias("__k"), F.col(start).alias("__s"), F.col(end).alias("__e"))
    return spans.join(b, (F.col(key) == F.col("__k")) & (F.col(start) < F.col("__e")) & (F.col("__s") < F.col(end)), "left_semi")


def free_of(spans: DataFrame, blocked: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Spans that overlap no blocked one of the same key."""
    b = blocked.select(F.col(key).alias("__k"), F.col(start).alias("__s"), F.col(end).alias("__e"))
    return spans.join(b, (F.col(key) == F.col("__k")) & (F.col(start) < F.col("__e")) & (F.col("__s") < F.col(end)), "left_anti")


def interpolate(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Fill null values linearly between the nearest known ones before and after."""
    w = Window.partitionBy(key).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(order))
    x0, y0 = F.last(known, True).over(back), F.last(value, True).over(back)
    x1, y1 = F.first(known, True).over(ahead), F.first(value, True).over(ahead)
    blend = F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (F.col(order) - x0) / (x1 - x0))
    return df.withColumn(out, F.coalesce(F.col(value), blend, y0, y1))
