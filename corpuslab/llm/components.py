"""Connected components by alternating star contraction, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import collected, dropped, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node that an edge touches; comp is its smallest node.

    Each round links every node's larger neighbours, then its smaller ones, to
    the smallest known neighbour, until all edges make stars.  Rounds grow with
    the logarithm of a component's width, edges never outnumber the given ones,
    and a round is one query whose result is written to the shared folder, so
    that lineage stays short and no node list reaches the driver.  Null ends and
    loops are passed over; no edges give no rows.
    """
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "cc")
    while not _stars(e):
        # large star: larger neighbours of a node go to its smallest neighbour or itself
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours of a node, and itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        dropped(old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )


def _stars(e: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, or larger ones only."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not collected(ends.filter("up > 1 or (up > 0 and down > 0)").agg(F.count("*")))[0][0]
