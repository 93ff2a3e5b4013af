"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word of every text is predicted from the words at both sides of it.  The
vocabulary are the most frequent words of the corpus, counted over all texts;
all other words fall into classes by hash, and have their class's chance times
their own share of its count, which a distributed join with the counts of all
words brings.  Vocabulary, classes and network grow with the corpus.  A network
of one hidden layer reads the words of the window, each through a table of its
position, and gives the word's chance as that of its group times that inside the
group.  It is trained in numpy on all texts, each once: every task walks through
its texts from a shared start, and the tasks' parameters are averaged, weighted
by their words, after each round.  A document's score is the sum of the
logarithms of its words' chances.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import collected, frugal, written
from .textkernel import Words, slices

CLASSES = 1024  # of the smallest network
HIDDEN, REACH = 16, 2
BATCH = 16384
BLOCKS = 16


def class_count(tokens: int) -> int:
    """Classes for a corpus of so many words: a power of two, as the root of the words."""
    return max(CLASSES, 1 << max(math.isqrt(tokens) // 4, 1).bit_length() - 1)


def rare_count(classes: int) -> int:
    """Of the classes, those that words get by hash; a power of two too."""
    return classes // 4


def shapes(classes: int) -> dict[str, tuple[int, ...]]:
    groups = 1 << classes.bit_length() // 2
    members = classes // groups
    return {
        "tables": (2 * REACH, classes + 1, HIDDEN),
        "bias": (HIDDEN,),
        "groups": (HIDDEN, groups),
        "group_bias": (groups,),
        "members": (groups, HIDDEN, members),
        "member_bias": (groups, members),
    }


def start(counts: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Small random tables, and biases that give each class its share of the corpus."""
    rng = np.random.default_rng(seed)
    net = {k: (rng.normal(size=s) * 0.1).astype(np.float32) for k, s in shapes(len(counts)).items()}
    share = (counts + 1.0).reshape(net["member_bias"].shape[::-1]).T  # class = member * groups + group
    net["bias"][:] = 0
    net["group_bias"] = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
    net["member_bias"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    return net


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def forward(net, context, classes, learn: bool = False):
    """Log chances of ``classes`` given ``context`` (2 * REACH, n), and gradients of their sum."""
    groups, border = net["groups"].shape[1], net["tables"].shape[1] - 1
    group, member = classes % groups, classes // groups
    order = np.argsort(group, kind="stable")
    group, member, context = group[order], member[order], context[:, order]
    n = len(group)
    h = net["tables"][0][context[0]]
    for k in range(1, 2 * REACH):
        h += net["tables"][k][context[k]]
    h += net["bias"]
    np.tanh(h, out=h)
    p = _softmax(h @ net["groups"] + net["group_bias"])
    at = np.arange(n)
    logs = np.log(np.maximum(p[at, group], 1e-30))
    edges = np.searchsorted(group, np.arange(groups + 1))
    if learn:
        np.negative(p, out=p)
        p[at, group] += 1
        grads = {"groups": h.T @ p, "group_bias": p.sum(axis=0), "members": np.zeros_like(net["members"]), "member_bias": np.zeros_like(net["member_bias"])}
        dh = p @ net["groups"].T
    for g in range(groups):
        b, e = edges[g], edges[g + 1]
        if b == e:
            continue
        q = _softmax(h[b:e] @ net["members"][g] + net["member_bias"][g])
        own = np.arange(e - b), member[b:e]
        logs[b:e] += np.log(np.maximum(q[own], 1e-30))
        if learn:
            np.negative(q, out=q)
            q[own] += 1
            grads["members"][g] = h[b:e].T @ q
            grads["member_bias"][g] = q.sum(axis=0)
            dh[b:e] += q @ net["members"][g].T
    if learn:
        dh *= 1 - h * h
        grads["bias"] = dh.sum(axis=0)
        grads["tables"] = np.empty_like(net["tables"])
        columns = np.ascontiguousarray(dh.T)
        for k in range(2 * REACH):
            for j in range(HIDDEN):
                grads["tables"][k, :, j] = np.bincount(context[k], columns[j], border + 1)
        return logs.sum(), grads
    out = np.empty(n)
    out[order] = logs
    return out


class Vocabulary:
    """Class of each word: its rank if frequent, else one by hash."""

    def __init__(self, hashes: np.ndarray, classes: int):
        self.size, self.rare = classes, rare_count(classes)
        self.order = np.argsort(hashes)
        self.keys = hashes[self.order]

    def classes(self, words: np.ndarray) -> np.ndarray:
        out = (self.size - self.rare + (words % np.uint64(self.rare)).astype(np.int64)).astype(np.int32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
            hit = self.keys[at] == words
            out[hit] = self.order[at[hit]]
        return out


def windows(words: Words, hashes: np.ndarray, vocabulary: Vocabulary):
    """(context, classes) of all words of a slice; the number of classes stands for a text's border."""
    own = vocabulary.classes(hashes)
    n = len(own)
    context = np.full((2 * REACH, n), vocabulary.size, np.int32)
    for k, shift in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        a, b = max(0, -shift), n - max(0, shift)
        if b > a:
            same = words.doc[a:b] == words.doc[a + shift : b + shift]
            context[k, a:b] = np.where(same, own[a + shift : b + shift], vocabulary.size)
    return context, own


def _batches(column, vocabulary):
    """Windows in whole slices, joined to batches of some thousands of words."""
    for _, _, data, offs in slices(column):
        words = Words(data, offs, lower=True)
        context, own = windows(words, words.hashes(), vocabulary)
        for b in range(0, len(own), BATCH):
            yield context[:, b : b + BATCH], own[b : b + BATCH]


def _flat(net) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in net])


def _unflat(flat, classes: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(classes).items():
        size = int(np.prod(s))
        out[k] = np.ascontiguousarray(flat[at : at + size].reshape(s), np.float32)
        at += size
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): occurrences of each word, by its hash, in all texts."""

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            held, size = [], 0
            for i, j, data, offs in slices(batch.column("text")):
                held.append(Words(data, offs, lower=True).hashes())
                size += len(held[-1])
                if size > 2_000_000 or j == len(batch):
                    words, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"word": pa.array(words.view(np.int64)), "n": pa.array(n.astype(np.int64))})
                    held, size = [], 0

    return docs.select("text").mapInArrow(frugal(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train_round(docs: DataFrame, vocabulary: Vocabulary, net: dict, rate: float) -> dict:
    """The tasks' networks after one walk through their texts, averaged by words."""
    total = len(_flat(net))
    size = -(-total // BLOCKS)
    schema = "block int, branch int, weight double, part binary"

    def learn(batches: Iterator[pa.RecordBatch]):
        own = {k: v.copy() for k, v in net.items()}
        squares = {k: np.full_like(v, 1e-3) for k, v in own.items()}
        words = 0
        for batch in batches:
            for context, classes in _batches(batch.column("text"), vocabulary):
                _, grads = forward(own, context, classes, learn=True)
                words += len(classes)
                for k, g in grads.items():
                    g = (g / len(classes)).astype(np.float32)
                    squares[k] += g * g
                    own[k] += rate * g / np.sqrt(squares[k])
        if words:
            flat = (_flat(own) * float(words)).astype(np.float64)
            parts = [flat[b * size : (b + 1) * size].tobytes() for b in range(BLOCKS)]
            branch = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(BLOCKS), pa.int32()), "branch": pa.array([branch] * BLOCKS, pa.int32()), "weight": pa.array([float(words)] * BLOCKS), "part": pa.array(parts, pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]):
        sums: dict = {}
        for batch in batches:
            for block, branch, weight, part in zip(*(batch.column(c).to_pylist() for c in ("block", "branch", "weight", "part"))):
                got = np.frombuffer(part, np.float64)
                if (block, branch) in sums:
                    sums[block, branch][0] += weight
                    sums[block, branch][1] += got
                else:
                    sums[block, branch] = [weight, got.copy()]
        if sums:
            yield pa.RecordBatch.from_pydict({"block": pa.array([k[0] for k in sums], pa.int32()), "branch": pa.array([k[1] for k in sums], pa.int32()), "weight": pa.array([v[0] for v in sums.values()]), "part": pa.array([v[1].tobytes() for v in sums.values()], pa.binary())})

    rows = docs.select("text").mapInArrow(frugal(learn), schema)
    rows = rows.repartition(8 * BLOCKS, "block", "branch").mapInArrow(frugal(add), schema).withColumn("branch", F.lit(0))
    rows = rows.repartition(BLOCKS, "block").mapInArrow(frugal(add), schema)
    flat, weight = np.zeros(size * BLOCKS), 0.0
    for block, _, own_weight, part in collected(rows):  # BLOCKS rows, the network's size in all
        part = np.frombuffer(part, np.float64)
        flat[block * size : block * size + len(part)] = part
        weight = own_weight
    return _unflat(flat[:total] / weight, vocabulary.size) if weight else net


def fit_network(docs: DataFrame, rounds: int = 2, rate: float = 1.0):
    """(counts of all words, vocabulary, network, counts by class) of a corpus with ``id`` and ``text``."""
    counted = written(word_counts(docs), "likelihood-words")
    tokens = counted.agg(F.sum("n")).first()[0] or 0
    classes = class_count(tokens)
    rare = rare_count(classes)
    top = collected(counted.orderBy(F.desc("n"), "word").limit(classes - rare))  # as the root of the corpus
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    counts = np.zeros(classes)
    counts[: len(top)] = [r["n"] for r in top]
    spread = collected(counted.groupBy(F.expr(f"pmod(word, {rare})").cast("int").alias("k")).agg(F.sum("n").alias("n")))
    for r in spread:  # one row a class; the frequent words of a class are taken off again
        counts[classes - rare + r["k"]] = r["n"]
    for h, r in zip(hashes.tolist(), top):
        counts[classes - rare + h % rare] -= r["n"]
    vocabulary, net = Vocabulary(hashes, classes), start(counts)
    for k in range(rounds):
        part = docs.filter(F.pmod(F.xxhash64("id", "text"), F.lit(rounds)) == k) if rounds > 1 else docs
        net = train_round(part, vocabulary, net, rate)
    return counted, vocabulary, net, counts


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, rate: float = 1.0) -> DataFrame:
    """id, n_tokens, log_likelihood, mean_log_likelihood of each row.

    The network is trained on the texts of ``docs`` itself, all of them, dealt to
    ``rounds`` rounds by a hash.  Words are split at ASCII white space and A-Z
    lower-cased.  A null or wordless text has a sum of 0 and a null mean.  Equal
    texts score alike and train once each; other columns are ignored; without any
    words the network keeps its start.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted, vocabulary, net, counts = fit_network(source, rounds, rate)
    classes, rare = vocabulary.size, vocabulary.rare
    within = np.where(np.arange(classes) < classes - rare, 0, -np.log(np.maximum(counts, 1)))

    def score(batches: Iterator[pa.RecordBatch]):
        # a row for each text, with its sum but for the counts of hashed words, and one for each hashed word
        for batch in batches:
            for i, j, data, offs in slices(batch.column("text")):
                words = Words(data, offs, lower=True)
                codes = words.hashes()
                context, own = windows(words, codes, vocabulary)
                logs = [forward(net, context[:, b : b + BATCH], own[b : b + BATCH]) for b in range(0, len(own), BATCH)]
                total = np.bincount(words.doc, np.concatenate(logs) + within[own], words.n_docs) if len(own) else np.zeros(j - i)
                keys, none = batch.column("key").slice(i, j - i), batch.column("id").slice(0, 0)
                at = np.flatnonzero(own >= classes - rare)
                texts, held = pa.nulls(j - i, pa.bool_()).fill_null(False), pa.nulls(len(at), pa.bool_()).fill_null(True)
                own_keys = keys.to_numpy()[words.doc[at]]
                yield pa.RecordBatch.from_arrays([keys, keys, texts, batch.column("id").slice(i, j - i), pa.array(words.counts.astype(np.int64)), pa.array(total)], names)
                yield pa.RecordBatch.from_arrays([pa.array(own_keys), pa.array(codes[at].view(np.int64)), held, pa.nulls(len(at), none.type), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.float64())], names)

    names = ["key", "word", "hashed", "id", "n_tokens", "base"]
    rows = source.withColumn("key", F.xxhash64("id", "text")).mapInArrow(frugal(score), f"key long, word long, hashed boolean, id {source.dtypes[0][1]}, n_tokens long, base double")
    # a word met once adds log 1; texts bear their key as word, which deals them out evenly, and join nothing
    known = counted.filter("n > 1").select("word", F.lit(True).alias("hashed"), F.log("n").alias("log_n"))
    rows = rows.join(known.hint("shuffle_hash"), ["word", "hashed"], "left")
    sums = rows.groupBy("key").agg(F.max("id").alias("id"), F.max("n_tokens").alias("n_tokens"), F.count("n_tokens").alias("copies"), (F.coalesce(F.sum("base"), F.lit(0.0)) + F.coalesce(F.sum("log_n"), F.lit(0.0))).alias("total"))
    sums = sums.withColumn("log_likelihood", F.col("total") / F.col("copies"))  # rows of equal id and text share a key
    out = sums.select("id", "n_tokens", "log_likelihood", F.explode(F.expr("array_repeat(0, cast(copies as int))")))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.select(F.col("id").alias(id_col), "n_tokens", "log_likelihood", mean.alias("mean_log_likelihood"))
