"""Global word alignment and what follows from it, in Arrow batches.

A row of the distance table is a running minimum over a shifted array, so the
table is filled a row at a time in numpy.  On ties the way back prefers a match,
then a substitution, a deletion, an insertion.
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import in_pieces

_PLACES = ("ref_start", "ref_end", "hyp_start", "hyp_end")
OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in _PLACES)]))
_COUNTS = ("n_ref", "n_hyp", "hits", "substitutions", "deletions", "insertions", "longest_deletion_run", "covered_words", "covered_errors", "max_run", "max_excess")
_RATES = ("wer", "coverage", "end_coverage", "robust_end_coverage", "tail_deletion", "wer_covered", "excess_repetition")
METRICS = T.StructType([*(T.StructField(c, T.IntegerType()) for c in _COUNTS), *(T.StructField(c, T.DoubleType()) for c in _RATES)])


def distances(ref: list[str], hyp: list[str]) -> np.ndarray:
    codes: dict[str, int] = {}
    r, h = (np.array([codes.setdefault(w, len(codes)) for w in side], np.int64) for side in (ref, hyp))
    table = np.zeros((len(r) + 1, len(h) + 1), np.int32)
    steps = np.arange(len(h) + 1, dtype=np.int32)
    table[0] = steps
    for i in range(1, len(r) + 1):
        best = np.minimum(table[i - 1][1:] + 1, table[i - 1][:-1] + (h != r[i - 1]))
        row = np.concatenate([[i], best]) - steps
        table[i] = np.minimum.accumulate(row) + steps
    return table


def alignment(ref: list[str], hyp: list[str]) -> list[dict]:
    """Runs of equal, substitute, delete and insert operations, in order."""
    table = distances(ref, hyp)
    i, j, steps = len(ref), len(hyp), []
    while i or j:
        here = table[i, j]
        if i and j and ref[i - 1] == hyp[j - 1] and table[i - 1, j - 1] == here:
            op, di, dj = "equal", 1, 1
        elif i and j and table[i - 1, j - 1] + 1 == here:
            op, di, dj = "substitute", 1, 1
        elif i and table[i - 1, j] + 1 == here:
            op, di, dj = "delete", 1, 0
        else:
            op, di, dj = "insert", 0, 1
        i, j = i - di, j - dj
        steps.append((op, i, i + di, j, j + dj))
    out: list[dict] = []
    for op, a, b, c, e in reversed(steps):
        if out and out[-1]["op"] == op:
            out[-1] |= {"ref_end": b, "hyp_end": e}
        else:
            out.append({"op": op, "ref_start": a, "ref_end": b, "hyp_start": c, "hyp_end": e})
    return out


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the maximal runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def grams(words: list[str], n: int) -> Counter:
    return Counter(zip(*(words[k:] for k in range(n))))


def _same_later(words: list[str], n: int) -> np.ndarray:
    """For each place, over how many words the text goes on with period ``n``."""
    codes = np.unique(words, return_inverse=True)[1] if words else np.zeros(0, int)
    left = np.zeros(len(words) + 1, np.int64)
    for begin, end in runs(codes[n:] == codes[:-n]) if len(words) > n else ():
        left[begin:end] = np.arange(end - begin, 0, -1)
    return left


def repeated(words: list[str], n: int) -> list[tuple[tuple, int]]:
    """(n-gram, times) of immediate repetitions, from left to right without overlap."""
    left, out, free = _same_later(words, n), [], 0
    for begin in np.flatnonzero(left >= n).tolist():
        if begin >= free:  # the first place of a stretch that no earlier repetition covers
            times = int(left[begin]) // n + 1
            out.append((tuple(words[begin : begin + n]), times))
            free = begin + times * n
    return out


def longest_run(words: list[str], gram: tuple) -> int:
    """How often ``gram`` follows itself at most; 0 where it is not found."""
    n = len(gram)
    left = _same_later(words, n)
    return max((int(left[k]) // n + 1 for k in range(len(words) - n + 1) if tuple(words[k : k + n]) == gram), default=0)


def repetition(ref: list[str], hyp: list[str], sizes=range(3, 9)) -> tuple[float, int, int]:
    """(excess rate, longest discounted run, largest excess count) of n-grams in the hypothesis."""
    rates, longest, most = [], 1, 0
    for n in sizes:
        own, given, positions = grams(hyp, n), grams(ref, n), len(hyp) - n + 1
        if positions > 0:
            rates.append(sum(max(0, (c - 1) - max(0, given[g] - 1)) for g, c in own.items()) / positions)
        most = max([most, *(c - max(1, given[g]) for g, c in own.items())])
        longest = max([longest, *(times - max(1, longest_run(ref, gram)) + 1 for gram, times in repeated(hyp, n) if times > longest)])
    return (sum(rates) / len(rates) if rates else 0.0), longest, most


def content_metrics(ref: list[str], hyp: list[str], robust: int = 3, tail: float = 0.10) -> dict:
    """Error rates and coverage of a hypothesis; an empty reference with words to hold against it is infinitely wrong."""
    ops, n = alignment(ref, hyp), len(ref)
    size = lambda op, side: sum(o[f"{side}_end"] - o[f"{side}_start"] for o in ops if o["op"] == op)
    hits, subs, dels, ins = size("equal", "ref"), size("substitute", "ref"), size("delete", "ref"), size("insert", "hyp")
    aligned, equal = np.zeros(n, bool), np.zeros(n, bool)
    for o in ops:
        if o["op"] in ("equal", "substitute"):
            aligned[o["ref_start"] : o["ref_end"]] = True
            equal[o["ref_start"] : o["ref_end"]] = o["op"] == "equal"
    blocks = runs(aligned)
    long = [b for b in blocks if b[1] - b[0] >= robust]
    last = math.ceil(tail * n)
    out = {
        "n_ref": n, "n_hyp": len(hyp), "hits": hits, "substitutions": subs, "deletions": dels, "insertions": ins,
        "wer": (subs + dels + ins) / n if n else (math.inf if hyp else 0.0),
        "coverage": aligned.sum() / n if n else 0.0,
        "end_coverage": blocks[-1][1] / n if blocks else 0.0,
        "robust_end_coverage": long[-1][1] / n if long else 0.0,
        "tail_deletion": float((~aligned[n - last :]).mean()) if last else 0.0,
        "longest_deletion_run": max((e - b for b, e in runs(~aligned)), default=0),
        "wer_covered": None, "covered_words": 0, "covered_errors": 0,
    }
    if blocks:
        first, end = blocks[0][0], blocks[-1][1]
        inside = sum(o["hyp_end"] - o["hyp_start"] for o in ops if o["op"] == "insert" and first < o["ref_start"] < end)
        errors = int((~equal[first:end]).sum()) + inside
        out |= {"wer_covered": errors / (end - first), "covered_words": end - first, "covered_errors": errors}
    rate, run, most = repetition(ref, hyp)
    return out | {"excess_repetition": rate, "max_run": run, "max_excess": most}


@F.pandas_udf(METRICS)
def word_metrics(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Content metrics of two texts that are normalised already."""
    return pd.DataFrame([content_metrics((r or "").split(), (h or "").split()) for r, h in zip(ref, hyp)], columns=METRICS.names)


@F.arrow_udf(OPS)
def word_alignment(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return in_pieces(lambda r, h: alignment((r or "").split(), (h or "").split()), OPS, ref, hyp)


def agreement_words(text: str | None) -> list[str]:
    """Words in lower case, hyphens as spaces, no other punctuation."""
    return re.sub(r"[^\w\s]", " ", (text or "").lower().replace("ё", "е").replace("-", " ")).split()


def words_ratio(a: list[str], b: list[str]) -> float | None:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else None


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched words over all, by longest matching blocks; null where a side has no words."""
    return pd.Series([words_ratio(agreement_words(x), agreement_words(y)) for x, y in zip(a, b)], dtype="float64")
