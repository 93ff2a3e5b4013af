"""Quality rules on repetition inside a text, from word suffix arrays.

All texts of a slice share one suffix array over their words, in which suffixes
of different texts never compare equal.  It is built by doubling: only suffixes
still tied with another one are sorted again, so the work follows what repeats.
The rank tables of the doublings then give the longest common prefix of
neighbouring suffixes.  An interval of that array, within which no value is under
its length, is a maximal repeated run of words; the deepest interval that a
suffix lies in has the larger of its two neighbouring values as its length, so
the spans of all intervals and their union come from array operations alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frugal
from .textkernel import SPACE, Words, slices

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = "row long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, repeat_share double, longest_repeat long, spans array<struct<first:int,last:int>>"


def suffix_ranks(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray):
    """(order, tables): suffixes in order, and classes of windows of 2 ** k words.

    ``ends[doc]`` is where a document's words end.  Two positions hold the same
    class in tables[k] only if their next 2 ** k words are equal and lie in one
    document.  A position without that many words left has a class of its own.
    """
    n = len(ids)
    stop = ends[doc]
    order = np.lexsort((ids, doc))
    new = np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (doc[order][1:] != doc[order][:-1])])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    tables = [rank.copy()]
    size = np.diff(np.concatenate([np.flatnonzero(new), [n]]))
    tied = np.flatnonzero(np.repeat(size > 1, size))  # places in order
    k = 1
    while len(tied):
        at = order[tied]
        nxt = at + k
        key = np.where(nxt < stop[at], rank[np.minimum(nxt, n - 1)], -1)
        s = np.lexsort((key, rank[at]))
        at, key, old = at[s], key[s], rank[at[s]]
        order[tied] = at
        # a suffix that ends here is alone: nothing equals its window
        new = np.concatenate([[True], (old[1:] != old[:-1]) | (key[1:] != key[:-1]) | (key[1:] < 0)])
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        tables.append(rank.copy())
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(at)]]))
        tied = tied[np.repeat(size > 1, size)]
        k *= 2
    return order, tables


def common_prefixes(order: np.ndarray, tables: list[np.ndarray], stop: np.ndarray) -> np.ndarray:
    """Words that a suffix shares with the one before it in order."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    live = np.flatnonzero(tables[0][a] == tables[0][b])
    a, b, got = a[live], b[live], np.zeros(len(live), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        t, w = tables[k], 1 << k
        fits = (a + w <= stop[order[live]]) & (b + w <= stop[order[live]])
        same = fits & (t[np.minimum(a, n - 1)] == t[np.minimum(b, n - 1)])
        got += same * w
        a, b = a + same * w, b + same * w
    lcp[live + 1] = got
    return lcp


def union_spans(starts: np.ndarray, ends: np.ndarray):
    """Overlapping or touching [start, end) spans, joined; starts must ascend."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return starts[at], np.concatenate([reach[at[1:] - 1], reach[-1:]])


def _slice(data, offs, min_words: int, window: int):
    w = Words(data, offs)
    docs, n = w.n_docs, len(w.starts)
    tail = (data & 0xC0) == 0x80
    chars = np.concatenate([[0], np.cumsum(~tail & ~SPACE[data])])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    out = {"n_words": w.counts, "word_chars": chars[offs[1:]] - chars[offs[:-1]], "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]]}

    # lines with a word, equal to an earlier one of the same text
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    end = np.minimum(np.concatenate([begin[1:], [len(data)]]), len(data))
    doc = np.searchsorted(offs[1:], begin, "right")
    end = np.minimum(end, offs[doc + 1])
    end = end - (data[np.maximum(end - 1, 0)] == 10) * (end > begin)
    solid = np.concatenate([[0], np.cumsum(~SPACE[data])])
    has = solid[end] > solid[begin]
    lines = w.range_hash(begin[has], end[has])
    s = np.lexsort((lines, doc[has]))
    again = (lines[s][1:] == lines[s][:-1]) & (doc[has][s][1:] == doc[has][s][:-1])
    out["n_dup_lines"] = np.bincount(doc[has][s][1:][again], minlength=docs) if len(s) else np.zeros(docs, np.int64)

    repeat = np.zeros(docs, np.int64)
    share, longest, spans = np.zeros(docs), np.zeros(docs, np.int64), [[] for _ in range(docs)]
    if n:
        ids = np.unique(w.hashes(), return_inverse=True)[1]
        stop = w.first[1:][w.doc]
        order, tables = suffix_ranks(ids, w.doc, w.first[1:])
        lcp = common_prefixes(order, tables, stop)
        most = np.zeros(n, np.int64)  # longest repeat that starts at a word: the deepest interval it lies in
        most[order] = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))
        np.maximum.at(longest, w.doc, most)
        for least, kind in ((window, "window"), (min_words, "share")):
            at = np.flatnonzero(most >= least)
            first, last = union_spans(at, at + most[at])
            # spans of neighbouring texts may touch, but never cross a border
            marks = np.zeros(n + 1, np.int64)
            marks[first] += 1
            np.add.at(marks, last, -1)
            covered = np.bincount(w.doc[np.cumsum(marks[:-1]) > 0], minlength=docs)
            if kind == "window":
                repeat = covered
            else:
                share = covered / np.maximum(w.counts, 1)
                inside = np.cumsum(marks[:-1]) > 0
                edge = np.concatenate([[True], w.doc[1:] != w.doc[:-1]])
                begin = np.flatnonzero(inside & (edge | ~np.concatenate([[False], inside[:-1]])))
                close = np.flatnonzero(inside & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([inside[1:], [False]])))
                for b, e in zip(begin.tolist(), close.tolist()):
                    d = int(w.doc[b])
                    spans[d].append({"first": b - int(w.first[d]), "last": e - int(w.first[d])})
    return out | {"n_repeat_words": repeat, "repeat_share": share, "longest_repeat": longest, "spans": spans}


def repetition_rules(docs: DataFrame, text_col: str = "text", min_words: int = 5, window: int = 8, max_share: float = 0.4, max_longest: int = 100, base_share: int = 30, base_words: int = 20) -> DataFrame:
    """``docs`` without its text, plus counts, spans and verdicts of repetition.

    A maximal repeated run of ``min_words`` words or more is cover: the spans
    (word positions, both ends inside) are their union.  A text is kept if it
    passes the base rules, at most ``max_share`` of its words are covered, and
    no run of over ``max_longest`` words repeats.  Base rules: ``base_words``
    words at least, and at most ``base_share`` percent of them in ``window``-word
    windows that occur twice.  A null text counts as one without words: all
    counts are 0, and the base rules fail it.  Whole texts are read; equal rows
    give equal results; further columns are passed through, except that the
    names of the results replace those of the input.
    """
    names = [f.split(" ")[0].split(":")[0] for f in SCHEMA.replace("struct<first:int,last:int>", "x").split(", ")][1:]
    kept = [c for c in docs.columns if c != text_col and c not in {*names, "base_failed", "kept"}]
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(F.col(f"`{c}`") for c in kept)).schema)
    schema = ", ".join(x for x in (rest, SCHEMA.partition(", ")[2]) if x)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i, j, data, offs in slices(batch.column(len(kept))):
                got = _slice(data, offs, min_words, window)
                spans = pa.array(got.pop("spans"), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
                arrays = [batch.column(c).slice(i, j - i) for c in range(len(kept))]
                arrays += [pa.array(got[c], pa.float64() if c == "repeat_share" else pa.int64()) for c in names[:-1]]
                yield pa.RecordBatch.from_arrays([*arrays, spans], [*kept, *names])

    out = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).alias("__text")).mapInArrow(frugal(run), schema)
    failed = (F.col("n_words") < base_words) | (100 * F.col("n_repeat_words") > base_share * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("repeat_share") <= max_share) & (F.col("longest_repeat") <= max_longest))
