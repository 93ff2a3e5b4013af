"""Exact similarity self-join of word-shingle sets with signature trees.

Plan, each step a distributed pass over all documents:

1. Count sketch.  Every shingle of every set adds to one of ``2 ** sketch_bits``
   counters; the summed sketch (fixed size) gives all tasks one global order of
   shingles in which frequent ones come last.
2. Prefixes.  Two sets of similarity t share l of the first ``n - ceil(t * n) + l``
   shingles of either (n: the set's size) under any global order, so these
   prefixes deal sets out to buckets, one for each shingle, without loss.  Sets
   are named by a fingerprint, so copies meet as one node.  A node of which fewer
   than l shingles occur in other nodes' prefixes has no partner; of the others'
   shingles the l - 1 most frequent ones can go, as a pair's rarest shared one stays.
3. Whole sets.  The nodes that still lie in a bucket have their texts read once
   more, and their whole sets and token bitmaps written to one table.
4. Stars.  Within a bucket and a size band each node is compared with the
   smallest node; verified links make first components.  A group of thousands of
   near copies is thereby joined with a linear number of comparisons.
5. Signature trees.  What is left are pairs of nodes of one bucket in different
   components.  The bucket's nodes form a tree whose nodes hold the OR of token
   bitmaps, the range of set sizes and the range of components; a dual traversal
   drops node pairs whose largest possible overlap cannot reach t, whose sizes
   cannot, or which lie in one component already.  A first walk takes a few
   partners of each node, so that groups grow together; the second takes all.
6. All candidates are verified on the whole sets, and components taken.

Hot keys: a task deals out each set once, however many copies it reads, and
copies are counted with map-side aggregation.  Buckets are counted likewise and
joined back by plain sort-merge joins, which Spark splits where they are skewed.
Large buckets are dealt out to trees in blocks, each pair of blocks to a task of
its own, but for pairs of blocks that hold one component alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import collected, dropped, frugal, written
from .textkernel import HASH_BITS, HASH_MASK, Words, mix, shingle_keys, slices

NARROW, WIDE = 128, 1 << 14  # bits of a token bitmap
BLOCK = 1024  # members of one block of a large bucket
FEW = 2  # partners of a node, in each part of a bucket, in the first walk through the trees
FAN = 8  # children of a tree's node
SKETCH_PARTS = 64
KEY_BITS = 1 << 27  # of the array that tells which texts are read again, at most
PIECE = 1 << 10  # bytes of it that are gathered together


def _sets(batch: pa.RecordBatch, size: int):
    """Per slice: first row, documents' set sizes, where their keys begin, keys."""
    for i, j, data, offs in slices(batch.column("text")):
        keys = shingle_keys(Words(data, offs, lower=True), size)
        at = np.searchsorted(keys, np.arange(j - i + 1, dtype=np.uint64) << np.uint64(HASH_BITS))
        yield i, np.diff(at), at, keys & HASH_MASK


def _fingerprints(sizes, at, hashes) -> np.ndarray:
    """One signed 64-bit name per set; the order of shingles does not matter."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + np.uint64(0x1234567)), out=total[1:])
    return mix(total[at[1:]] - total[at[:-1]] + mix(sizes.astype(np.uint64))).view(np.int64)


def _bitmaps(sizes, at, hashes) -> list[bytes]:
    """A token bitmap per set, of a power of two bits: eight and more a token for small sets, two for large ones."""
    wanted = np.maximum(np.minimum(sizes * 8, 2048), sizes * 2)
    widths = np.clip(2 ** np.ceil(np.log2(np.maximum(wanted, 2))).astype(np.int64), NARROW, WIDE)
    ends = np.cumsum(widths // 8)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    bit = (hashes & np.repeat(widths - 1, sizes).astype(np.uint64)).astype(np.int64)
    np.bitwise_or.at(out, np.repeat(ends - widths // 8, sizes) + (bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    raw = out.tobytes()
    return [raw[e - w : e] for e, w in zip(ends.tolist(), (widths // 8).tolist())]


def _folded(bitmaps: list[bytes], widths: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps as rows of ``width`` bits; wider ones are folded by OR."""
    out = np.zeros((len(bitmaps), width // 64), np.uint64)
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        m = np.frombuffer(b"".join([bitmaps[k] for k in rows]), np.uint64).reshape(len(rows), -1, width // 64)
        out[rows] = np.bitwise_or.reduce(m, axis=1)
    return out


def count_sketch(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """How rare shingles are, by counter: 0 for counters at or under the mean."""

    def emit(batches: Iterator[pa.RecordBatch]):
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, _, hashes in _sets(batch, size):
                counts += np.bincount((hashes & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        parts = np.minimum(counts, 0xFFFF).astype("<u2").reshape(SKETCH_PARTS, -1)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(SKETCH_PARTS), pa.int32()), "counts": pa.array([x.tobytes() for x in parts], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
                got = np.frombuffer(counts.as_buffer(), "<u2").astype(np.int64)
                sums[part] = sums[part] + got if part in sums else got
        if sums:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "counts": pa.array([np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes() for x in sums.values()], pa.binary())})

    rows = docs.select("text").mapInArrow(frugal(emit), "part int, counts binary")
    rows = rows.repartition(SKETCH_PARTS, "part").mapInArrow(frugal(add), "part int, counts binary")
    total = np.zeros((SKETCH_PARTS, (1 << bits) // SKETCH_PARTS), np.float64)
    for part, counts in collected(rows):  # SKETCH_PARTS rows, 2 ** bits counters in all
        total[part] += np.frombuffer(counts, "<u4")
    total = total.ravel() / max(total.mean(), 1e-9)
    return np.clip(np.ceil(8 * np.log2(np.maximum(total, 1))), 0, 255).astype(np.uint8)


def shared_least(n, num: int, den: int):
    """Shingles of its prefix that a set of n must share with any partner of its own size or more."""
    return 1 + (n - -(-n * num // den)) // 2


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles to look at, so that sets of similarity num/den share ``shared_least`` of them."""
    return np.where(n > 0, n - -(-n * num // den) + shared_least(n, num, den), 0)


def tree_pairs(sizes, slack, bitmaps, comps, first, second, num: int, den: int):
    """Index pairs that may reach the similarity, by dual traversal of signature trees.

    ``first`` and ``second`` are (begin, end) ranges of the arrays per bucket
    block; equal ranges stand for a self-join.  Members should be sorted by size
    within a range.  Returns two index arrays.
    """
    lo, hi, slk, bm, clo, chi = sizes.copy(), sizes.copy(), slack.copy(), bitmaps, comps.copy(), comps.copy()
    kids = [(np.arange(len(sizes)), np.arange(1, len(sizes) + 1))]
    levels = [(lo, hi, slk, bm, clo, chi)]
    ranges = sorted({*map(tuple, first), *map(tuple, second)})
    where = {r: r for r in ranges}  # a block's nodes on the present level
    while any(e - b > 1 for b, e in where.values()):
        begin, end, now, n = [], [], {}, 0
        for r in ranges:
            b, e = where[r]
            cut = list(range(b, e, FAN if e - b > 1 else 1))
            begin += cut
            end += [min(x + (FAN if e - b > 1 else 1), e) for x in cut]
            now[r] = (n, n + len(cut))
            n += len(cut)
        begin, end = np.array(begin), np.array(end)
        lo, hi, slk, bm, clo, chi = levels[-1]
        levels.append((np.minimum.reduceat(lo, begin), np.maximum.reduceat(hi, begin), np.maximum.reduceat(slk, begin), np.bitwise_or.reduceat(bm, begin, axis=0), np.minimum.reduceat(clo, begin), np.maximum.reduceat(chi, begin)))
        kids.append((begin, end))
        where = now
    x = np.array([where[tuple(r)][0] for r in first], np.int64)
    y = np.array([where[tuple(r)][0] for r in second], np.int64)
    same = x == y
    for depth in range(len(levels) - 1, -1, -1):
        lo, hi, slk, bm, clo, chi = levels[depth]
        keep = np.zeros(len(x), bool)
        for s in range(0, len(x), 1 << 16):
            p, q = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
            ok = (hi[p] * den >= lo[q] * num) & (hi[q] * den >= lo[p] * num)
            ok &= ~((clo[p] == chi[p]) & (clo[q] == chi[q]) & (clo[p] == clo[q]))
            t = np.flatnonzero(ok)
            shared = np.bitwise_count(bm[p[t]] & bm[q[t]]).sum(axis=1, dtype=np.int64) + np.minimum(slk[p[t]], slk[q[t]])
            shared = np.minimum(shared, np.minimum(hi[p[t]], hi[q[t]]))
            keep[s + t] = shared * (num + den) >= num * (lo[p[t]] + lo[q[t]])
        x, y, same = x[keep], y[keep], same[keep]
        if depth == 0:
            real = x != y
            return x[real], y[real]
        begin, end = kids[depth]
        nx, ny = end[x] - begin[x], end[y] - begin[y]
        k = np.repeat(np.arange(len(x)), nx * ny)
        at = np.arange(len(k)) - np.repeat(np.cumsum(nx * ny) - nx * ny, nx * ny)
        cx, cy = begin[x][k] + at // ny[k], begin[y][k] + at % ny[k]
        own = same[k]
        ok = ~own | (cx <= cy)
        x, y, same = cx[ok], cy[ok], own[ok] & (cx[ok] == cy[ok])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, num: int = 4, den: int = 5, sketch_bits: int = 20, row_keys: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles`` and ``component_id``.

    Two texts link when |A n B| / |A u B| >= num / den over their sets of
    ``shingle_words``-word shingles (A-Z lower-cased, words split at ASCII white
    space; fewer words: the whole sequence is the one shingle).  component_id is
    the smallest id reachable by links.  Null or wordless texts have no
    shingles, link with nothing and keep their own id.  Rows with equal ids are
    kept and treated as copies of their texts; a null id is never the smallest,
    unless nothing else is linked.  Shingles are compared by 52-bit hashes and
    sets named by 64-bit ones.  Other columns of ``docs`` are ignored; no rows
    give none.

    With ``row_keys``, rows also bear ``text_hash``, the xxhash64 of the text, and
    ``group``, equal for the rows of a component whatever their ids, and null for
    wordless texts.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("key", F.coalesce("id", F.xxhash64("text")))  # rows without an id are found by their text
    docs = docs.withColumn("mark", F.xxhash64("text") if row_keys else F.lit(0).cast("long"))
    levels = count_sketch(docs, shingle_words, sketch_bits)
    mask = np.uint64((1 << sketch_bits) - 1)

    def prefixes(batches: Iterator[pa.RecordBatch]):
        seen: set[int] = set()  # a task deals out each set once, however many copies it meets
        for batch in batches:
            for i, sizes, at, hashes in _sets(batch, shingle_words):
                names = _fingerprints(sizes, at, hashes)
                new = np.zeros(len(sizes), bool)
                for k in np.unique(names, return_index=True)[1].tolist():
                    if sizes[k] and (name := int(names[k])) not in seen:
                        new[k] = True
                        seen.add(name)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                level = levels[(hashes & mask).astype(np.int64)].astype(np.uint64)
                order = np.argsort(doc.astype(np.uint64) << np.uint64(52) | level << np.uint64(44) | hashes >> np.uint64(8), kind="stable")
                rank = np.arange(len(hashes)) - np.repeat(at[:-1], sizes)
                take = rank < np.repeat(prefix_length(sizes, num, den) * new, sizes)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[take], minlength=len(sizes)))])
                tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes[order][take].astype(np.int64)))
                own = (batch.column(c).slice(i, len(sizes)) for c in ("id", "key", "mark"))
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes.astype(np.int64)), pa.array(names), tokens], ["id", "key", "mark", "n", "node", "tokens"])

    sets = written(docs.mapInArrow(frugal(prefixes), "id long, key long, mark long, n long, node long, tokens array<long>"), "jaccard-sets")
    deal = _buckets(sets, num, den)
    nodes = _whole_sets(docs, sets, deal, shingle_words)

    # stars: each node of a bucket and size band against the smallest one
    banded = deal.select("token", "node", F.floor(F.log("n") / math.log(den / num)).alias("band"))
    star = banded.groupBy("token", "band").agg(F.min("node").alias("a"))
    stars = banded.join(star, ["token", "band"]).filter(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()
    links = written(_verified(_possible(stars, nodes, num, den), nodes, num, den), "jaccard-links")
    known = components(links)
    dropped(links)
    # buckets that still hold nodes of different components, at first with a few partners for each node: most
    # of a large group is one component after that, and the walk for all partners passes it over
    for partners in (FEW, None):
        more = written(_tree_candidates(deal, nodes, known, num, den, partners), "jaccard-more")
        links = written(_verified(more, nodes, num, den), "jaccard-links")
        # what is known already goes on as stars
        old, known = known, components(links.unionByName(known.select(F.col("node").alias("a"), F.col("comp").alias("b"))))
        dropped(more, links, old)
    dropped(deal, nodes)

    # smallest id of each component; nodes without links only matter if several rows share them
    copies = sets.filter("n > 0").groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("rows"))
    named = copies.join(known, "node", "left").filter("comp is not null or rows > 1").select("node", "low", F.coalesce("comp", "node").alias("comp"))
    named = written(named, "jaccard-named")
    lows = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = written(named.join(lows, "comp").select("node", "component_id", "comp"), "jaccard-names")
    empty = F.xxhash64(F.col("id"), F.rand(7))  # wordless rows are dealt out evenly and match nothing
    out = sets.select("id", "mark", "n", F.when(F.col("n") > 0, F.col("node")).otherwise(empty).alias("node"))
    out = out.join(named, "node", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"),
        *([F.col("mark").alias("text_hash"), F.when(F.col("n") > 0, F.coalesce("comp", "node")).alias("group")] if row_keys else []),
    )


def _buckets(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(token, node, n): the buckets that sets have to meet in, as the module's head says."""
    deal = sets.select("node", "n", F.explode("tokens").alias("token"))
    met = written(_shared_tokens(deal), "jaccard-met")
    smallest = F.expr(f"(n * {num} + {den - 1}) div {den}")  # of a partner
    least = 1 + F.floor((smallest - F.expr(f"(((n * {num} + {den - 1}) div {den}) * {num} + {den - 1}) div {den}")) / 2)
    own = Window.partitionBy("node")
    held = deal.join(met, "token").select("token", "node", "n").distinct()
    held = written(held.withColumn("held", F.count("*").over(own)).filter(F.col("held") >= least).drop("held"), "jaccard-held")
    dropped(met)
    ranked = held.join(_shared_tokens(held), "token")
    ranked = ranked.withColumn("held", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("df", "token")))
    deal = written(ranked.filter((F.col("held") >= least) & (F.col("place") <= F.col("held") - least + 1)).select("token", "node", "n"), "jaccard-buckets")
    dropped(held)
    return deal


def _tree_candidates(deal: DataFrame, nodes: DataFrame, known: DataFrame, num: int, den: int, partners: int | None) -> DataFrame:
    """Pairs of nodes of one bucket and different components that may be similar.

    With ``partners`` set, a node meets that many others at most in each part of
    a bucket; a later call without it finds the rest.  A large bucket is dealt out
    in blocks, each pair of blocks a part of its own.  A component with more
    members in a bucket than a block holds has blocks of its own, which are never
    held against each other; all other members go by their component's hash.
    """
    spark = deal.sparkSession
    marked = written(deal.join(known, "node", "left").select("token", "node", "n", F.coalesce("comp", "node").alias("comp")), "jaccard-marked")
    held = marked.groupBy("token", "comp").agg(F.count("*").alias("members"))
    large = F.ceil(F.col("members") / BLOCK).cast("int")
    buckets = held.groupBy("token").agg(F.count("*").alias("comps"), F.sum(F.when(F.col("members") <= BLOCK, F.col("members")).otherwise(0)).alias("loose"))
    buckets = written(buckets.filter("comps > 1").select("token", F.ceil(F.col("loose") / BLOCK).cast("int").alias("loose")), "jaccard-mixed")
    # blocks of large components follow the loose ones; a bucket has few of them
    before = F.sum(large).over(Window.partitionBy("token").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1))
    solid = held.filter(F.col("members") > BLOCK).select("token", "comp", large.alias("solid"), F.coalesce(before, F.lit(0)).cast("int").alias("base"))
    solid = written(solid, "jaccard-solid")
    extent = solid.groupBy("token").agg(F.sum("solid").cast("int").alias("all_solid"))
    rest = marked.join(buckets.join(extent, "token", "left"), "token").join(solid, ["token", "comp"], "left")
    spread = lambda c, k: F.pmod(F.xxhash64(c), F.greatest(k, F.lit(1))).cast("int")
    begin = F.col("loose") + F.col("base")
    own = F.when(F.col("solid").isNull(), spread("comp", F.col("loose"))).otherwise(begin + spread("node", F.col("solid")))
    total = F.col("loose") + F.coalesce("all_solid", F.lit(0))
    others = F.filter(F.sequence(F.lit(0), total - 1), lambda k: F.col("solid").isNull() | (k < begin) | (k >= begin + F.col("solid")))
    # loose blocks meet themselves too
    pairs_of = F.transform(others, lambda k: F.struct(F.least(own, k).alias("p"), F.greatest(own, k).alias("q")))
    rest = rest.select("token", "node", "n", "comp", own.alias("own"), F.explode(pairs_of).alias("pair"))
    rest = rest.join(nodes.select("node", "bitmap"), "node")
    rest = rest.select("token", F.col("pair.p").alias("p"), F.col("pair.q").alias("q"), "own", "n", "node", "comp", "bitmap")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12)
    rest = rest.repartition(parts, "token", "p", "q").sortWithinPartitions("token", "p", "q", "own", "n", "node")

    def trees(batches: Iterator[pa.RecordBatch]):
        carry = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([carry, t]) if carry is not None else t
            key = np.stack([t.column(c).to_numpy() for c in ("token", "p", "q")])
            new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            cut = int(new[-1]) if len(new) else 0
            carry = t.slice(cut)
            if cut:
                yield from _tree_batch(t.slice(0, cut), num, den, partners)
        if carry is not None and len(carry):
            yield from _tree_batch(carry, num, den, partners)

    return rest.mapInArrow(frugal(trees), "a long, b long").distinct()


def _shared_tokens(deal: DataFrame) -> DataFrame:
    """(token, df) of shingles that lie in the prefixes of two nodes or more."""
    met = deal.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count("*").alias("df"))
    return met.filter("x <> y").select("token", "df")


def _tree_batch(t: pa.Table, num: int, den: int, partners: int | None):
    token, p, q, own, n, node, comp = (t.column(c).to_numpy() for c in ("token", "p", "q", "own", "n", "node", "comp"))
    raw = t.column("bitmap").to_pylist()
    widths = np.array([8 * len(x) for x in raw])
    key = np.stack([token, p, q])
    groups = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(t)]])
    comp = np.unique(comp, return_inverse=True)[1]
    parts = []  # ranges of rows to hold against each other, equal ones against themselves
    for b, e in zip(groups[:-1].tolist(), groups[1:].tolist()):
        if p[b] == q[b]:
            parts.append(((b, e), (b, e)))
        else:
            m = b + int(np.searchsorted(own[b:e], q[b]))
            if b < m < e:
                parts.append(((b, m), (m, e)))
    start = 0
    while start < len(parts):
        stop, size = start, 0
        while stop < len(parts) and (size < 4096 or stop == start):
            size += parts[stop][1][1] - parts[stop][0][0]
            stop += 1
        some, start = parts[start:stop], stop
        lo, hi = some[0][0][0], some[-1][1][1]
        # sizes of a pair differ too little for their bitmaps to be more than one step apart
        for width in np.unique(widths[lo:hi]).tolist():
            rows = lo + np.flatnonzero((widths[lo:hi] == width) | (widths[lo:hi] == 2 * width))
            small = np.concatenate([[0], np.cumsum(widths[rows] == width)])
            first, second = [], []
            for r, s in some:
                (b, e), (c, f) = np.searchsorted(rows, r), np.searchsorted(rows, s)
                m, k = b + small[e] - small[b], c + small[f] - small[c]  # wider ones follow, as rows ascend by size
                pairs = [((b, m), (c, k)), ((b, m), (k, f))] + ([((m, e), (c, k))] if r != s else [])
                for x, y in pairs:
                    if x[0] < x[1] and y[0] < y[1]:
                        first.append(tuple(map(int, x))), second.append(tuple(map(int, y)))
            if not first:
                continue
            bitmaps = _folded([raw[k] for k in rows], widths[rows], width)
            slack = n[rows] - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
            x, y = tree_pairs(n[rows], slack, bitmaps, comp[rows], first, second, num, den)
            x, y = rows[x], rows[y]
            real = comp[x] != comp[y]
            if partners is not None:  # the first few of each node, in an order that differs by node
                spot = np.lexsort((mix(node[x].view(np.uint64) ^ node[y].view(np.uint64)), x))
                x, y, real = x[spot], y[spot], real[spot]
                x, y = x[real], y[real]
                begin = np.searchsorted(x, x)
                few = np.arange(len(x)) - begin < partners
                x, y, real = x[few], y[few], np.ones(int(few.sum()), bool)
            a, b = np.minimum(node[x], node[y])[real], np.maximum(node[x], node[y])[real]
            found = np.unique(np.stack([a, b]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])


def _possible(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sizes and bitmaps leave the similarity possible."""

    def check(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            p, q = batch.column("p").to_pylist(), batch.column("q").to_pylist()
            widths = np.array([(len(x) * 8, len(y) * 8) for x, y in zip(p, q)], np.int64).reshape(-1, 2)
            ok = np.zeros(len(batch), bool)
            for width in np.unique(widths.min(axis=1)).tolist():
                rows = np.flatnonzero(widths.min(axis=1) == width)
                x, y = _folded([p[k] for k in rows], widths[rows, 0], width), _folded([q[k] for k in rows], widths[rows, 1], width)
                slack = np.minimum(n[rows] - np.bitwise_count(x).sum(axis=1, dtype=np.int64), m[rows] - np.bitwise_count(y).sum(axis=1, dtype=np.int64))
                shared = np.minimum(np.bitwise_count(x & y).sum(axis=1, dtype=np.int64) + slack, np.minimum(n[rows], m[rows]))
                ok[rows] = shared * (num + den) >= num * (n[rows] + m[rows])
            yield batch.filter(pa.array(ok)).select(["a", "b"])

    left = pairs.join(nodes.select(F.col("node").alias("b"), "n", F.col("bitmap").alias("p")), "b")
    left = left.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("bitmap").alias("q")), "a")
    return left.filter((F.col("n") * den >= F.col("m") * num) & (F.col("m") * den >= F.col("n") * num)).mapInArrow(frugal(check), "a long, b long")


def _whole_sets(docs: DataFrame, sets: DataFrame, deal: DataFrame, size: int) -> DataFrame:
    """(node, n, bitmap, hashes) of the nodes in ``deal``, one document's text read for each.

    A bit array of the wanted documents' keys, of some eight bits each and of
    ``KEY_BITS`` bits at most, spares the other texts the hashing; the join after
    it is what decides.
    """
    rows = sets.filter("size(tokens) > 0").select("node", "key")
    wanted = written(rows.join(deal.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("key").alias("key")), "jaccard-wanted")
    bits = 1 << min(max(8 * wanted.count(), 1 << 16).bit_length(), KEY_BITS.bit_length() - 1)
    spot = F.pmod(F.xxhash64("key"), F.lit(bits)).cast("long")

    def marks(batches: Iterator[pa.RecordBatch]):
        array = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = batch.column("spot").to_numpy()
            np.bitwise_or.at(array, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k in range(0, len(array), PIECE):
            if array[k : k + PIECE].any():
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "bits": pa.array([array[k : k + PIECE].tobytes()], pa.binary())})

    # an executor's partitions by ranges of the array: each piece comes from one of them, so KEY_BITS / 8 bytes in all
    pieces = wanted.select(spot.alias("spot")).repartition(F.expr(f"spot div {8 * PIECE}")).mapInArrow(frugal(marks), "k long, bits binary")
    array = np.zeros(bits // 8, np.uint8)
    for k, part in collected(pieces):
        array[k : k + PIECE] |= np.frombuffer(part, np.uint8)

    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at = batch.column("spot").to_numpy()
            batch = batch.filter(pa.array((array[at >> 3] >> (at & 7)) & 1 == 1))
            for i, sizes, at, hashes in _sets(batch, size):
                keep = np.flatnonzero(sizes > 0)
                if not len(keep):
                    continue
                maps = _bitmaps(sizes, at, hashes)
                columns = {
                    "key": batch.column("key").slice(i, len(sizes)).take(pa.array(keep)),
                    "node": pa.array(_fingerprints(sizes, at, hashes)[keep]),
                    "n": pa.array(sizes[keep].astype(np.int64)),
                    "bitmap": pa.array([maps[k] for k in keep], pa.binary()),
                    "hashes": pa.array([hashes[at[k] : at[k + 1]].tobytes() for k in keep], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    found = docs.select("key", "text", spot.alias("spot")).mapInArrow(frugal(emit), "key long, node long, n long, bitmap binary, hashes binary")
    full = found.join(wanted.withColumnRenamed("key", "own_key"), "node").filter("key = own_key").drop("key", "own_key")
    # rows that share a key and a text give a node twice
    full = written(full.dropDuplicates(["node"]), "jaccard-nodes")
    dropped(wanted)
    return full


def _verified(pairs: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""

    def check(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for k, (p, q) in enumerate(zip(batch.column("p"), batch.column("q"))):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]))
                shared = int((both[1:] == both[:-1]).sum())
                ok[k] = den * shared >= num * (len(p) + len(q) - shared)
            yield batch.filter(pa.array(ok)).select(["a", "b"])

    sets = full.select("node", "hashes")
    left = pairs.join(sets.withColumnsRenamed({"node": "b", "hashes": "q"}), "b")
    left = left.join(sets.withColumnsRenamed({"node": "a", "hashes": "p"}), "a").select("a", "b", "p", "q")
    return left.mapInArrow(frugal(check), "a long, b long")
