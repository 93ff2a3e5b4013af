"""Order-dependent operators on windows: ranks, islands, intervals, grids, smoothing, slopes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__rn") <= k).drop("__rn")


def islands(df: DataFrame, group: str, order: str, hit: Column) -> DataFrame:
    """Maximal runs of rows where ``hit`` is true: first, last, length.

    Within a run, the row number among all rows less that among hits is constant.
    """
    w = Window.partitionBy(group).orderBy(order)
    rows = df.select(group, order, F.coalesce(hit, F.lit(False)).alias("hit"), F.row_number().over(w).alias("rn"))
    rows = rows.filter("hit").withColumn("island", F.col("rn") - F.row_number().over(w))
    return rows.groupBy(group, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"), F.min("rn").alias("at")).drop("island")


def merge_intervals(df: DataFrame, group: str, start: str = "start", end: str = "end") -> DataFrame:
    """Union of overlapping or touching intervals of a group."""
    before = Window.partitionBy(group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy(group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__new", (F.col(start) > F.coalesce(F.max(end).over(before), F.lit(float("-inf")))).cast("int"))
    rows = rows.withColumn("__set", F.sum("__new").over(running))
    return rows.groupBy(group, "__set").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__set")


def window_grid(length: Column, size: float, hop: float, least: float) -> Column:
    """Overlapping windows of a duration; a last partial one is kept if it is long enough."""
    whole = F.when(length >= size, F.floor((length - size) / hop + 1e-9) + 1).otherwise(0)
    tail = whole * hop
    full = F.transform(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0)).cast("int")), lambda k: F.struct((k * F.lit(hop)).alias("start"), (k * F.lit(hop) + F.lit(size)).alias("end")))
    rest = F.when((length - tail >= least) & (length < tail + size), F.array(F.struct(tail.cast("double").alias("start"), length.cast("double").alias("end")))).otherwise(F.array().cast("array<struct<start:double,end:double>>"))
    return F.concat(F.when(whole > 0, full).otherwise(F.array().cast("array<struct<start:double,end:double>>")), rest)


def smoothed(values: Column, alpha: float) -> Column:
    """Exponential smoothing of an array: the first value, then alpha of each new one."""
    step = lambda s, x: F.when(s.isNull(), x).otherwise(F.lit(alpha) * x + F.lit(1 - alpha) * s)
    return F.aggregate(values, F.lit(None).cast("double"), step)


def median_slope(x: np.ndarray, y: np.ndarray, hold: int = 1 << 21) -> float | None:
    """Median of the slopes of all pairs of points with different x, holding ``hold`` slopes at most.

    With more pairs, walks over them count the slopes up to a value, which
    bisection moves to the middle one.
    """
    n = len(x)
    step = max(1, hold // (2 * max(n, 1)))

    def blocks():
        for b in range(0, n, step):
            dx, dy = x[None, :] - x[b : b + step, None], y[None, :] - y[b : b + step, None]
            use = (np.arange(n)[None, :] > np.arange(b, min(b + step, n))[:, None]) & (np.abs(dx) > 1e-12)
            yield dy[use] / dx[use]

    sizes = [(len(s), s.min(), s.max()) for s in blocks() if len(s)]
    total = sum(n for n, _, _ in sizes)
    if not total:
        return None
    if total <= hold:
        return float(np.median(np.concatenate(list(blocks()))))
    # whole numbers in the order of the floats they stand for
    order = lambda v: (lambda i: i ^ (i >> 63 & (1 << 63) - 1))(int(np.float64(v).view(np.int64)))
    value = lambda i: np.int64(i ^ (i >> 63 & (1 << 63) - 1)).view(np.float64)
    low, high = order(min(m for _, m, _ in sizes)), order(max(m for _, _, m in sizes))
    while low < high:  # the least value that enough slopes do not exceed
        middle = (low + high) // 2
        if sum(int((s <= value(middle)).sum()) for s in blocks()) > (total - 1) // 2:
            high = middle
        else:
            low = middle + 1
    first = float(value(low))
    if sum(int((s <= first).sum()) for s in blocks()) > total // 2:
        return first
    return (first + float(min(s[s > first].min(initial=np.inf) for s in blocks()))) / 2


def theil_sen(df: DataFrame, group: str, x: str, y: str, out: str = "slope") -> DataFrame:
    """Median of the slopes of all pairs in a group; pairs of equal x are left out.

    A task holds one group's points and a bounded number of slopes, whatever the
    length of the track; a group without a usable pair has a null slope, and
    points with a null coordinate take no part.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf.dropna(subset=["__x", "__y"]).sort_values(["__x", "__y"])
        return pd.DataFrame({group: pdf[group].iloc[:1], out: [median_slope(points["__x"].to_numpy(float), points["__y"].to_numpy(float))]})

    rows = df.select(group, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    return rows.groupBy(group).applyInPandas(run, f"`{group}` {df.schema[group].dataType.simpleString()}, `{out}` double")


def spearman(df: DataFrame, group: str, x: str, y: str, out: str = "rho") -> DataFrame:
    """Correlation of average ranks; groups of fewer than three rows, or of equal values, have none."""

    def rank(c):
        by = Window.partitionBy(group)
        return F.rank().over(by.orderBy(c)) + (F.count("*").over(Window.partitionBy(group, c)) - 1) / 2.0

    ranked = df.select(group, rank(x).alias("rx"), rank(y).alias("ry"))
    return ranked.groupBy(group).agg(F.when(F.count("*") >= 3, F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))).alias(out))


def voiced_windows(df: DataFrame, group: str, start: str, end: str, size: float, hop: float, tail: float) -> DataFrame:
    """Windows of ``size`` on the timeline of a group's merged intervals alone, every ``hop``.

    A last window that ends with the timeline is added where more than ``tail``
    of it would be left out.  Each window has its place on that timeline and the
    times it lies between; a group with less than ``size`` in all has none.
    Each merged interval makes the beginnings and the ends of windows that lie in
    it: no window is compared with all intervals, and a group's rows are sorted
    once.  Rows without a group, a start or an end take no part.
    """
    rows = df.select(F.col(group).alias("group"), F.col(start).alias("start"), F.col(end).alias("end")).filter("group is not null and start is not null and end is not null")
    by, every = Window.partitionBy("group").orderBy("start", "end"), Window.partitionBy("group")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("reach", F.max("end").over(before)).withColumn("until", F.max("end").over(every))
    # an interval begins past all ends before it, and ends with the last of those that the next one is past
    spans = rows.filter("reach is null or start > reach").withColumn("length", F.coalesce(F.lead("reach").over(by), "until") - F.col("start"))
    spans = spans.withColumn("at", F.coalesce(F.sum("length").over(before), F.lit(0.0)))
    spans = spans.withColumn("next", F.coalesce(F.lead("at").over(by), F.lit(float("inf")))).withColumn("total", F.max(F.col("at") + F.col("length")).over(every))
    spans = spans.filter(F.col("total") >= size).withColumn("last", F.floor((F.col("total") - size) / hop))

    def inside(ahead: float, of: Callable[[Column], Column]) -> Column:
        """Windows with the place ``ahead`` of their beginnings in the interval, as ``of`` tells exactly."""
        none = F.array().cast("array<double>")
        near = lambda at: F.floor((at - ahead) / hop)
        first, to = F.greatest(near(F.col("at")) - 1, F.lit(0)), F.when(F.col("next") == float("inf"), F.col("last")).otherwise(F.least(near(F.col("next")) + 1, F.col("last")))
        regular = F.when(first <= to, F.transform(F.sequence(first, to), lambda k: k * F.lit(float(hop)))).otherwise(none)
        rest = F.when(F.col("total") - (F.col("last") * F.lit(float(hop)) + size) > tail, F.array(F.col("total") - size)).otherwise(none)
        return F.filter(F.concat(regular, rest), lambda p: of(p + F.lit(float(ahead))))

    begun = inside(0.0, lambda p: (p >= F.col("at")) & (p < F.col("next")))
    # at one place, a window ends before the next interval begins, and another window begins in it
    ended = inside(float(size), lambda p: (p > F.col("at")) & (p <= F.col("next")))
    timed = lambda places, ahead, kind: F.transform(places, lambda p: F.struct(p.alias("voiced_start"), F.lit(kind).alias("kind"), (F.col("start") + p + F.lit(float(ahead)) - F.col("at")).alias("time")))
    marks = timed(F.col("begun"), 0.0, 1), timed(F.col("ended"), size, -1)
    times = spans.select("group", "start", "at", begun.alias("begun"), ended.alias("ended")).select("group", F.inline(F.concat(*marks)))
    side = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("time")))
    return times.groupBy("group", "voiced_start").agg(side(1).alias(start), side(-1).alias(end)).withColumnRenamed("group", group)
