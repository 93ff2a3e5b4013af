"""Filters that count what they drop: funnels, reject reasons, contract checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def funnel(df: DataFrame, stages: list[tuple[str, Column]], size: Column) -> DataFrame:
    """Rows and size that enter and leave each stage, in one pass.

    A row reaches stage k if all earlier conditions are true; a null condition
    counts as false.  Returns stage_no, stage, rows_in, rows_out, rows_removed,
    size_in, size_out.
    """
    passed = [F.lit(True)]
    for _, condition in stages:
        passed.append(passed[-1] & F.coalesce(condition, F.lit(False)))
    one = df.agg(
        *(F.count_if(p).alias(f"n{k}") for k, p in enumerate(passed)),
        *(F.coalesce(F.sum(F.when(p, size)), F.lit(0)).alias(f"s{k}") for k, p in enumerate(passed)),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(k + 1).alias("stage_no"), F.lit(name).alias("stage"),
                F.col(f"n{k}").alias("rows_in"), F.col(f"n{k + 1}").alias("rows_out"), (F.col(f"n{k}") - F.col(f"n{k + 1}")).alias("rows_removed"),
                F.col(f"s{k}").alias("size_in"), F.col(f"s{k + 1}").alias("size_out"),
            )
            for k, (name, _) in enumerate(stages)
        )
    )
    return one.select(F.inline(rows))


def reject_reasons(conditions: dict[str, Column]) -> Column:
    """All reasons that hold for a row, in the given order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in conditions.items())))


def first_reason(conditions: dict[str, Column], otherwise: str = "accepted") -> Column:
    """The first reason of a ladder that holds."""
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in conditions.items()), F.lit(otherwise))


def reason_counts(df: DataFrame, reasons: Column) -> DataFrame:
    """reason, n_any (rows it is among the reasons of), n_sole (rows it is the only one of)."""
    rows = df.select(reasons.alias("reasons")).select(F.explode("reasons").alias("reason"), (F.size("reasons") == 1).alias("sole"))
    return rows.groupBy("reason").agg(F.count("*").alias("n_any"), F.count_if("sole").alias("n_sole"))


def violations(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """rule, key of each broken rule of each row; a null condition is broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items())))
    return df.select(F.explode(broken).alias("rule"), key.cast("string").alias("key"))


def require(violating: DataFrame, what: str, limit: int = 20) -> None:
    """Raise one error that names up to ``limit`` broken rules; pass if there are none."""
    found = violating.limit(limit + 1).collect()
    if found:
        lines = [f"{r['rule']}: {r['key']}" for r in found[:limit]]
        raise ValueError(f"{what}: rules are broken\n" + "\n".join(lines) + ("\n..." if len(found) > limit else ""))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def hash_share(key: Column, modulus: int = 10_000) -> Column:
    """A fixed share in [0, 1) of a key, by the first 32 bits of its md5."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % modulus) / modulus
