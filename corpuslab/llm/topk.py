"""Exact top-k search by inner product with MaxScore.

Dimensions are terms, rows are documents.  A query's terms are ordered by the
size of their weights, and a group of terms adds to a score at most the product
of the two sides' lengths in these terms, or the sum of each term's largest
contribution in a block of like documents.  The non-essential terms are the
longest tail of which the bounds say that it alone lifts no document of the block
to the query's k-th best score so far; the postings of the essential ones, the
others, are traversed for all documents of the block.  Non-essential terms are
probed, a few at a time, only where the partial score and the bound of the rest
can still compete, and blocks that cannot are passed over.  The k-th best score
rises from block to block.  A first pass holds each query against one shard; its
k-th score goes along to all other shards, whose results are merged by score,
then id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BLOCK = 256  # documents of a block, which has bounds of its own
CHUNK = 512  # queries looked at together
PROBE = 8  # terms probed between two looks at the bound


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as a double; null if any is null or not finite."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), whole)


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to a common width."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _alike(values: np.ndarray, seed: int = 5) -> np.ndarray:
    """An order of the rows in which like ones follow each other: by the nearest of some rows."""
    n = len(values)
    if n <= BLOCK:
        return np.arange(n)
    pivots = values[np.random.default_rng(seed).choice(n, n // BLOCK, replace=False)]
    near = np.concatenate([(values[b : b + 4096] @ pivots.T - (pivots * pivots).sum(axis=1) / 2).argmax(axis=1) for b in range(0, n, 4096)])
    return np.argsort(near, kind="stable")


class Shard:
    """Documents of one shard in blocks, with bounds of each term in each block."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = _alike(values)
        self.ids, self.rows = ids[order], values[order]
        self.begins = np.arange(0, len(ids), BLOCK)
        self.low, self.high = np.minimum.reduceat(self.rows, self.begins, axis=0), np.maximum.reduceat(self.rows, self.begins, axis=0)
        self.squares = self.rows * self.rows
        self.norms = self.squares.sum(axis=1)
        self.longest = (np.sqrt(np.maximum.reduceat(self.norms, self.begins)) * (1 + 1e-5)).astype(values.dtype)
        # sums of squares may be rounded: what bounds add for that, as a share of a document's sum
        self.slack = values.shape[1] * 2.0 * np.finfo(values.dtype).eps
        self.made = self.all = 0  # products of a query's weight and a posting: made, and in whole inner products

    def search(self, own: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int):
        """(query's place, id, score) of the k best documents of each query among those that score ``least`` or more.

        The document with the query's own id is none.  Also returned: the k-th
        best score of each query, or ``least`` where that is more.
        """
        found, bars = [], []
        for c in range(0, len(own), CHUNK):
            place, row, score, bar = self._chunk(own[c : c + CHUNK], queries[c : c + CHUNK], least[c : c + CHUNK], k)
            found.append((place + c, self.ids[row], score)), bars.append(bar)
        joined = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return *joined, np.concatenate(bars) if bars else least

    def _chunk(self, own, queries, least, k):
        n = len(queries)
        order = np.argsort(-np.abs(queries), axis=1, kind="stable")
        ranked = np.take_along_axis(queries, order, axis=1)
        squares = np.concatenate([ranked.astype(float) ** 2, np.zeros((n, 1))], axis=1)
        lengths = (np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-5)).astype(self.rows.dtype)  # of the terms from each place on
        asks = {"own": own, "queries": queries, "order": order, "ranked": ranked, "lengths": lengths, "best": np.full((n, k), -np.inf, self.rows.dtype), "bar": least.astype(self.rows.dtype)}
        asks |= {"plus": np.maximum(queries, 0), "minus": np.minimum(queries, 0), "found": []}
        # of each query in each block
        bound = np.minimum(asks["plus"] @ self.high.T + asks["minus"] @ self.low.T, lengths[:, :1] * self.longest)
        # each query's most promising block first: it gives a k-th score to begin with
        first = bound.argmax(axis=1)
        for b in np.unique(first).tolist():
            self._block(b, np.flatnonzero(first == b), asks)
        for b in np.argsort(-bound.max(axis=0), kind="stable").tolist():
            self._block(b, np.flatnonzero((bound[:, b] >= asks["bar"]) & (first != b)), asks)
        self.all += queries.size * len(self.ids)
        place, row, score = (np.concatenate(x) for x in zip(*asks["found"])) if asks["found"] else (np.zeros(0, np.int64),) * 3
        good = score >= asks["bar"][place]
        place, row, score = place[good], row[good], score[good]
        best = np.lexsort((self.ids[row], -score, place))
        place, row, score = place[best], row[best], score[best]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        return place[rank < k], row[rank < k], score[rank < k], asks["bar"]

    def _block(self, b: int, some: np.ndarray, asks: dict) -> None:
        """Hold the queries ``some`` against block ``b``; raises their best scores and bars."""
        if not len(some):
            return
        at, width = self.begins[b], self.rows.shape[1]
        docs, ids, norms = (x[at : at + BLOCK] for x in (self.rows, self.ids, self.norms))
        need, order = asks["bar"][some], asks["order"][some]
        # bounds of the terms from each place on, for any document of the block
        upper = np.take_along_axis(asks["plus"][some] * self.high[b] + asks["minus"][some] * self.low[b], order, axis=1)
        upper = np.concatenate([np.cumsum(upper[:, ::-1], axis=1)[:, ::-1], np.zeros((len(some), 1), docs.dtype)], axis=1)
        tail = np.minimum(upper, asks["lengths"][some] * self.longest[b])
        # essential: the terms up to the last place from which on the rest could do alone
        alone = tail >= need[:, None]
        essential = np.where(alone.any(axis=1), width + 1 - alone[:, ::-1].argmax(axis=1), 1)
        essential = np.minimum(essential, width)
        heads = np.arange(width) < essential[:, None]
        use = np.zeros(heads.shape, bool)
        np.put_along_axis(use, order, heads, axis=1)
        score = np.where(use, asks["queries"][some], 0) @ docs.T
        left = norms - use.astype(docs.dtype) @ self.squares[at : at + BLOCK].T  # squares of the rest
        self.made += int(essential.sum()) * len(docs)
        rows = np.arange(len(some))
        most = self._rest(upper[rows, essential][:, None], asks["lengths"][some, essential][:, None], left, norms)
        x, y = np.nonzero((score + most >= need[:, None]) & (ids != asks["own"][some][:, None]))
        got, rest, done = score[x, y], left[x, y], essential[x]
        # a few terms at a time are probed for the documents that can still compete
        full = []
        while len(x):
            over = done >= width
            full.append((x[over], y[over], got[over]))
            x, y, got, rest, done = (v[~over] for v in (x, y, got, rest, done))
            if not len(x):
                break
            take = np.minimum(done[:, None] + np.arange(PROBE), width - 1)
            real = done[:, None] + np.arange(PROBE) < width
            values = np.where(real, docs[y[:, None], order[x[:, None], take]], 0)
            self.made += int(real.sum())
            got = got + (values * asks["ranked"][some[x][:, None], take]).sum(axis=1)
            rest = rest - (values * values).sum(axis=1)
            done = np.minimum(done + PROBE, width)
            hope = got + self._rest(upper[x, done], asks["lengths"][some[x], done], rest, norms[y]) >= need[x]
            x, y, got, rest, done = (v[hope] for v in (x, y, got, rest, done))
        x, y, got = (np.concatenate(v) for v in zip(*full)) if full else (x, y, got)
        good = got >= need[x]
        x, y, got = x[good], y[good], got[good]
        if not len(x):
            return
        asks["found"].append((some[x], at + y, got))
        hit, line = np.unique(x, return_inverse=True)
        k = asks["best"].shape[1]
        both = np.full((len(hit), k + len(docs)), -np.inf, docs.dtype)
        both[:, :k] = asks["best"][some[hit]]
        both[line, k + y] = got
        asks["best"][some[hit]] = top = -np.partition(-both, k - 1, axis=1)[:, :k]
        asks["bar"][some[hit]] = np.maximum(asks["bar"][some[hit]], top.min(axis=1))

    def _rest(self, upper, length, squares, norms):
        """The most that the rest of the terms can add."""
        return np.minimum(upper, length * np.sqrt(np.maximum(squares, 0) + self.slack * norms))


def _plain(own, queries, ids, values, k):
    """(place, id, score) by whole products: for numbers too large for floating point."""
    out = []
    for place, (mine, query) in enumerate(zip(own.tolist(), queries)):
        ranked = sorted((-sum(a * b for a, b in zip(query, row)), i) for i, row in zip(ids.tolist(), values) if i != mine)
        out += [(place, i, max(min(-s, 2**63 - 1), -(2**63))) for s, i in ranked[:k]]
    return tuple(np.array(c, np.int64) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _search_group(group: pa.Table, k: int):
    """(ids of queries, their vectors as in the table, place, id, score, bar) of one group's queries against its documents."""
    ask, ids = group.column("ask").to_numpy(), group.column("id").to_numpy()
    vectors = group.column("vector").combine_chunks()
    values = _matrix(vectors, int(np.diff(vectors.offsets.to_numpy()).max(initial=0)))
    least = group.column("least").fill_null(-math.inf).to_numpy()[ask]
    own, asks, ids, values = ids[ask], values[ask], ids[~ask], values[~ask]
    # sums of products stay whole in the type that is wide enough for them
    most = float(np.abs(asks).max(initial=0)) * float(np.abs(values).max(initial=0)) * max(values.shape[1], 1)
    if not len(own) or not len(ids):
        found, bar = (np.zeros(0, np.int64),) * 3, least
    elif 4 * most >= 2**53:
        whole = lambda m: [[int(v) for v in row] for row in m]
        found, bar = _plain(own, whole(asks), ids, whole(values), k), least
    else:
        kind = np.float32 if 4 * most < 2**24 else np.float64
        *found, bar = Shard(ids, values.astype(kind)).search(own, asks.astype(kind), least, k)
    return own, group.filter(pa.array(ask)).column("vector"), *found, bar


def top_k(queries: DataFrame, documents: DataFrame, id_col: str = "vec_id", vector_col: str = "vector", k: int = 20, shard_rows: int = 8192, query_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), id and score of each query's k best documents.

    Both frames have an id and an array of whole numbers as doubles.  A document
    with the query's own id is no candidate; ties go to the smaller id.  A query
    with fewer candidates gets them all.  Rows with a null id or vector take no
    part; shorter vectors, empty ones too, are filled up with zeros.  Documents of
    equal ids are each candidates; queries of equal ids share k places.  Without
    queries or documents there are no rows; other columns are ignored.  Rows are
    dealt evenly, whatever their ids, to shards of about ``shard_rows`` documents
    and blocks of about ``query_rows`` queries; a task holds one shard against
    one block.
    """
    ok = F.col("id").isNotNull() & F.col("vector").isNotNull()
    rows = [d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(ok) for d in (documents, queries)]
    shards, blocks = (max(1, math.ceil(d.count() / n)) for d, n in zip(rows, (shard_rows, query_rows)))
    dealt = lambda n, seed: F.floor(F.rand(seed) * n).cast("int")
    # written, so that both passes find a row where it was dealt to
    docs = written(rows[0].select(F.lit(False).alias("ask"), "id", "vector", dealt(shards, 3).alias("shard")), "topk-documents")
    asks = rows[1].select(F.lit(True).alias("ask"), "id", "vector", dealt(shards, 4).alias("shard"), dealt(blocks, 5).alias("block"))
    nothing = F.lit(None).cast("double").alias("least")
    schema = "query_id long, id long, score long, vector array<double>, least double, shard int, block int"

    def first(key, group):
        """Results, and the queries with the score that they have to reach elsewhere."""
        own, vectors, place, ids, score, bar = _search_group(group, k)
        n, m = len(place), len(own)
        block = group.filter(group.column("ask")).column("block")
        columns = [
            pa.array(np.concatenate([own[place], own]).astype(np.int64)), pa.array([*ids.tolist(), *[None] * m], pa.int64()), pa.array([*map(int, score.tolist()), *[None] * m], pa.int64()),
            pa.concat_arrays([pa.nulls(n, vectors.type), *vectors.chunks]), pa.array(np.concatenate([np.zeros(n), bar.astype(float)]), mask=np.arange(n + m) < n),
            pa.array(np.full(n + m, key[0].as_py(), np.int32)), pa.concat_arrays([pa.nulls(n, pa.int32()), *block.chunks]),
        ]
        return pa.table(columns, names=[x.split(" ")[0] for x in schema.split(", ")])

    def others(group):
        own, _, place, ids, score, _ = _search_group(group, k)
        return pa.table([pa.array(x.astype(np.int64)) for x in (own[place], ids, score)], names=["query_id", "id", "score"])

    both = docs.select("*", F.lit(None).cast("int").alias("block"), nothing).unionByName(asks.select("*", nothing))
    begun = written(both.groupBy("shard").applyInArrow(first, schema), "topk-first")
    found = begun.filter("score is not null").select("query_id", "id", "score")
    if shards > 1:
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asks = begun.filter("score is null").select(F.lit(True).alias("ask"), F.col("query_id").alias("id"), "vector", "least", "block", F.col("shard").alias("home"), every(shards).alias("shard"))
        both = docs.select("ask", "id", "vector", nothing, "shard", every(blocks).alias("block")).unionByName(asks.filter("shard <> home").drop("home"))
        found = found.unionByName(both.groupBy("shard", "block").applyInArrow(others, "query_id long, id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")
