"""Best-fit packing of token sequences by non-negative least squares over patterns.

Only the histogram of piece lengths, of fixed size, reaches the driver.  There,
patterns of two or three lengths that fill a sequence exactly are enumerated;
repeat counts that reproduce the histogram best are fitted by non-negative
least squares, rounded, and what they leave over is packed by best fit, longest
first, also on counts.  The plan is a list of (pattern, repeats); the k-th piece
of a length, by a rank that is local to a task plus the task's base, then finds
its place in the plan by a search in small arrays.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_path, tokenizer
from .shared import frugal, written
from .textkernel import slices


def patterns(histogram: np.ndarray) -> np.ndarray:
    """Ascending length triples that sum to the capacity; a leading 0 makes a pair.

    ``histogram[n]`` counts the pieces of n tokens; its last index is the
    capacity.  Only lengths that occur take part.
    """
    size = len(histogram) - 1
    has = histogram > 0
    has[0] = True
    step = max(1, size // 1024)
    found = []
    for a in [0, *range(1, size // 3 + 1, step)]:
        if has[a]:
            b = np.arange(max(a, 1), (size - a) // 2 + 1)
            c = size - a - b
            ok = has[b] & has[c]
            found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def least_squares(table: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeats x >= 0 of the patterns whose piece counts come closest to the histogram."""
    if not len(table):
        return np.zeros(0)
    size, target = len(histogram), histogram.astype(float)

    def forward(x):
        y = sum(np.bincount(table[:, k], x, size) for k in range(3))
        y[0] = 0
        return y

    def backward(r):
        r = r.copy()
        r[0] = 0
        return r[table].sum(axis=1)

    v = np.ones(len(table))
    for _ in range(30):
        v = backward(forward(v / np.linalg.norm(v)))
    rate = 1 / max(np.linalg.norm(v), 1e-9)
    goal = target.copy()
    goal[0] = goal[-1] = 0
    x = z = np.zeros(len(table))
    t = 1.0
    for _ in range(steps):  # accelerated projected gradient
        new = np.maximum(0, z - rate * backward(forward(z) - goal))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use each piece shorter than the capacity exactly once."""
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = left[size] = 0
    out = []
    table = patterns(left)
    x = least_squares(table, left)
    # rounding along the list keeps sums, so that small repeats do not all vanish
    whole = np.diff(np.floor(np.concatenate([[0], np.cumsum(x)]) + 0.5)).astype(np.int64)
    for k in np.argsort(-whole, kind="stable"):
        n = int(whole[k])
        if n <= 0:
            break
        own = [int(v) for v in table[k] if v]
        n = min([n, *(int(left[v]) // own.count(v) for v in own)])
        if n:
            out.append((tuple(own), n))
            for v in own:
                left[v] -= n
    # best fit, longest first, on groups of equal sequences
    free: dict[int, list] = {}
    spaces: list[int] = []

    def add(room, lengths, n):
        if room == 0:
            out.append((lengths, n))
            return
        if room not in free:
            free[room] = []
            bisect.insort(spaces, room)
        free[room].append((lengths, n))

    for v in range(size - 1, 0, -1):
        n = int(left[v])
        while n:
            at = bisect.bisect_left(spaces, v)
            if at == len(spaces):
                per = size // v
                if n // per:
                    add(size - per * v, (v,) * per, n // per)
                if n % per:
                    add(size - n % per * v, (v,) * (n % per), 1)
                break
            room = spaces[at]
            lengths, have = free[room].pop()
            used = min(n, have)
            if used < have:
                free[room].append((lengths, have - used))
            if not free[room]:
                del free[room]
                spaces.pop(at)
            add(room - v, (*lengths, v), used)
            n -= used
    return out + [g for groups in free.values() for g in groups]


def slots(groups: list[tuple[tuple[int, ...], int]], size: int):
    """Arrays by length, then rank: where each length's slots begin, and of each slot
    the first rank, the first sequence and the offset."""
    rows, base = [], 0
    for lengths, n in groups:
        offset = 0
        for v in lengths:
            rows.append((v, n, base, offset))
            offset += v
        base += n
    rows = np.array(sorted(rows), np.int64).reshape(-1, 4)
    before = np.cumsum(rows[:, 1]) - rows[:, 1]
    begin = np.searchsorted(rows[:, 0], np.arange(size + 2))
    first = before - before[np.minimum(begin[rows[:, 0]], max(len(rows) - 1, 0))] if len(rows) else before
    return begin, first, rows[:, 2], rows[:, 3], base


def pack_documents(docs: DataFrame, size: int = 1024, end_id: int = 2, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its text's ids, then ``end_id``; a null text is empty, so that
    each row has at least one token.  Longer ones than ``size`` are cut: all
    pieces but the first are full.  Sequences hold at most ``size`` tokens and
    are gapless from 0.  Rows with equal ids or texts are packed each on its own;
    a null id is kept; other columns are ignored; no rows give none.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.dtypes[0][1]
    path = tokenizer_path or default_path()
    extra = ", ids binary" if keep_ids else ""
    names = ["id", "piece", "start", "length", "ids_crc32", "part", "rank", *["ids"] * keep_ids]

    def cut(batches: Iterator[pa.RecordBatch]):
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64).tolist()
        tail, bpe = np.array([end_id], "<u4").tobytes(), tokenizer(path)
        for batch in batches:
            for i, j, data, offs in slices(batch.column("text")):
                rows = [[] for _ in names]
                for k, ids in enumerate(bpe.encode_slice(data, offs)):
                    ids += tail
                    total = len(ids) // 4
                    edges = [0, *range(total % size or size, total + 1, size)]
                    for piece, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                        own = ids[4 * a : 4 * b]
                        row = (k, piece, a, b - a, zlib.crc32(own), part, seen[b - a], own)
                        seen[b - a] += 1
                        for column, value in zip(rows, row):
                            column.append(value)
                arrays = [batch.column("id").slice(i, j - i).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32())]
                arrays += [pa.array(c, pa.int64()) for c in rows[2:7]] + [pa.array(c, pa.binary()) for c in rows[7:]]
                yield pa.RecordBatch.from_arrays(arrays, names)

    pieces = written(source.mapInArrow(frugal(cut), f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, rank long{extra}"), "packing-pieces")
    counts = written(pieces.filter(F.col("length") < size).groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    histogram = np.zeros(size + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # fewer than ``size`` rows
        histogram[length] = n
    begin, first, sequence, offset, _ = slots(plan(histogram), size)
    base = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(base, F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("at").to_numpy()
            # the last slot of the length that begins at or before the rank
            at = np.zeros(len(length), np.int64)
            if len(first):
                key = first + np.repeat(np.arange(size + 1), np.diff(begin)) * (1 << 44)
                at = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
            arrays = {"sequence_id": pa.array(sequence[at] + rank - first[at]), "offset": pa.array(offset[at])}
            keep = [c for c in batch.schema.names if c != "at"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays.values()], [*keep, *arrays])

    columns = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    short = pieces.filter(F.col("length") < size).join(bases, ["part", "length"]).select(*columns, (F.col("rank") + F.col("base")).alias("at"))
    short = short.mapInArrow(frugal(place), f"id {kind}, piece int, start long, length long, ids_crc32 long{extra}, sequence_id long, offset long")
    alone = (-1 - F.col("part") * F.lit(1 << 36) - F.col("rank")).alias("sequence_id")
    full = pieces.filter(F.col("length") == size).select(*columns, alone, F.lit(0).cast("long").alias("offset"))
    out = short.unionByName(full).withColumnRenamed("id", id_col)
    return out.select(*[c for c in out.columns if c != "ids"], *["ids"] * keep_ids)
