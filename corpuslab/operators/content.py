"""Scores of transcripts against references: pairs, status, stop analysis."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from itertools import chain
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import BLANK

WORD = re.compile(BLANK.replace("[", "[^"))


def excess_rate(refs: list[str], hyps: list[str], sizes: range) -> float | None:
    """Mean over n of the share of repeats in the hypothesis beyond the reference's own; null without any n-gram."""
    given, own = ([WORD.findall(t) for t in side] for side in (refs, hyps))
    count = lambda texts, n: Counter(chain.from_iterable(zip(*(t[k:] for k in range(n))) for t in texts))
    rates, last = [], None
    for n in sorted(sizes):
        positions = sum(max(0, len(t) - n + 1) for t in own)
        if not positions:
            break
        beyond = 0
        if last is None or last:  # where no shorter gram is repeated, no longer one is
            last = {g: c for g, c in count(own, n).items() if c > 1}
            theirs = count(given, n) if last else {}
            beyond = sum(max(0, c - max(1, theirs.get(g, 0))) for g, c in last.items())
        rates.append(beyond / positions)
    return sum(rates) / len(rates) if rates else None


def excess_repetition(df: DataFrame, key: list[str], ref: str, hyp: str, sizes: range = range(3, 9)) -> DataFrame:
    """Repeats in the hypothesis beyond the reference's own, by n and on average over n with positions.

    The texts of a key meet, and not their n-grams, which are many times as large:
    these are counted for a key at a time and go to no shuffle, join or broadcast.
    """

    @F.arrow_udf(T.DoubleType())
    def rate(refs: pa.Array, hyps: pa.Array) -> pa.Array:
        return pa.array([excess_rate(r.as_py(), h.as_py(), sizes) for r, h in zip(refs, hyps)], pa.float64())

    known = reduce(and_, (F.col(c).isNotNull() for c in key))  # rows of no key have no reference in common
    texts = df.groupBy(*key).agg(F.collect_list(F.when(known, F.col(ref))).alias("refs"), F.collect_list(hyp).alias("hyps"))
    return texts.select(*key, rate("refs", "hyps").alias("excess_repetition")).filter("excess_repetition is not null")


def final_status(gen_status: Column, stop_reason: Column, usable: Column, end_coverage: Column, over_floor: Column, floor_available: Column, excess: Column, run: Column, coverage_min=0.95, margin=0.30, excess_min=0.20, run_min=3) -> Column:
    """Outcome of one attempt: only attempts that ended as complete are refined further.

    A complete attempt that did not end by itself, or has no coverage, is an
    error.  The margin over the floor counts only where a floor is available.
    """
    loops = (F.coalesce(excess, F.lit(0.0)) >= excess_min) | (F.coalesce(run, F.lit(0)) >= run_min)
    worse = F.coalesce(floor_available & (over_floor >= margin), F.lit(False))
    return (
        F.when(gen_status != "complete", gen_status)
        .when(~stop_reason.eqNullSafe(F.lit("eos")), F.raise_error(F.lit("a complete attempt must have ended by itself")).cast("string"))
        .when(~usable, "invalid_audio")
        .when(end_coverage.isNull(), F.raise_error(F.lit("a complete attempt needs its end coverage")).cast("string"))
        .when(end_coverage < coverage_min, "early_eos")
        .when(worse | loops, "degraded")
        .otherwise("complete")
    )


def flow_status(family: Column, status: Column) -> Column:
    """Flow models have no early end of sequence: their short outputs are incomplete texts."""
    return F.when((family == "flow") & (status == "early_eos"), "incomplete_text").otherwise(status)


def restricted_words(n_words: Column, horizon: int) -> Column:
    """Stable words, censored at a horizon."""
    return F.least(n_words, F.lit(horizon))
