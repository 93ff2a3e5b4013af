"""Toxic spans by a linear-chain conditional random field.

Labels come per document, so tokens are labelled first: a word, or a word's
beginning, that significantly many of the toxic fitting documents hold and
hardly any of the others marks its tokens in toxic documents as toxic; all other
tokens are not.  A two-state chain over each sentence is then fitted to those
token labels, with weights for words, word beginnings and transitions.  Marginals
come from the forward-backward algorithm, taken as a product of 2 x 2 matrices
over all tokens of a slice at once, with a restart where a sentence begins.  All
marginals of a document enter its score: the expected number of tokens that two
independent taggings by the chain would both mark, calibrated on the fitting
documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fitted, frugal, held_out, labelled_sample, with_private_names
from .textkernel import Words, mix, slices

BITS = 20  # of the table that tells which features may have a weight
STEP = 64  # tokens of a block in the scan
_PUNCT = np.zeros(256, bool)
_PUNCT[list(range(33, 48)) + list(range(58, 65)) + list(range(91, 97)) + list(range(123, 127))] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


class Tokens:
    """Words of a slice with their feature slots and where sentences begin."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        w = self.words = Words(data, offs, lower=True)
        a, b = w.starts.copy(), w.ends.copy()
        for _ in range(3):
            a += _PUNCT[w.data[np.minimum(a, len(w.data) - 1)]] & (a < b - 1) if len(a) else 0
            b -= _PUNCT[w.data[b - 1]] & (b > a + 1) if len(b) else 0
        self.begin, self.end = a, b
        # beginnings of 4, 5 and 6 bytes, and the word itself, as 64-bit hashes
        self.features = [w.range_hash(a, np.minimum(b, a + k)) + np.uint64(k) for k in (4, 5, 6)] + [w.range_hash(a, b)]
        self.restart = np.ones(len(a), bool)
        if len(a):
            gap = np.add.reduceat(np.concatenate([w.data == 10, [False]]), w.ends)[: len(a) - 1] if len(a) > 1 else np.zeros(0)
            self.restart[1:] = (w.doc[1:] != w.doc[:-1]) | _STOP[w.data[w.ends[:-1] - 1]] | (gap > 0)


def _scan(m: np.ndarray) -> np.ndarray:
    """Running products of row vectors with the matrices ``m`` (n, 2, 2), from (1, 1), each scaled to sum 1."""
    n = len(m)
    if n <= STEP:
        out, v = np.empty((n, 2)), np.ones(2)
        for t in range(n):
            v = v @ m[t]
            v = v / v.sum()
            out[t] = v
        return out
    blocks = -(-n // STEP)
    pad = np.tile(np.eye(2), (blocks * STEP - n, 1, 1))
    x = np.concatenate([m, pad]).reshape(blocks, STEP, 2, 2)
    p00, p01, p10, p11 = (np.ascontiguousarray(x[:, :, i, j].T) for i in (0, 1) for j in (0, 1))
    for t in range(1, STEP):
        a, b, c, d = p00[t - 1], p01[t - 1], p10[t - 1], p11[t - 1]
        e, f, g, h = p00[t], p01[t], p10[t], p11[t]
        q00, q01, q10, q11 = a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h
        s = 1 / (q00 + q01 + q10 + q11)
        p00[t], p01[t], p10[t], p11[t] = q00 * s, q01 * s, q10 * s, q11 * s
    ends = np.stack([p00[-1], p01[-1], p10[-1], p11[-1]], axis=1).reshape(blocks, 2, 2)
    start = np.concatenate([np.ones((1, 2)), _scan(ends)[:-1]])
    v0 = start[:, 0] * p00 + start[:, 1] * p10
    v1 = start[:, 0] * p01 + start[:, 1] * p11
    s = v0 + v1
    return np.stack([(v0 / s).T.ravel()[:n], (v1 / s).T.ravel()[:n]], axis=1)


def marginals(score: np.ndarray, restart: np.ndarray, trans: np.ndarray, first: np.ndarray):
    """(p, pair): each token's chance of state 1, and expected transitions between states.

    ``score`` is the log weight of state 1 against state 0, ``trans`` and
    ``first`` log weights of transitions and of a sentence's first state.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    e = np.stack([np.zeros(n), np.clip(score, -30, 30)], axis=1)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    m = np.exp(trans)[None] * e[:, None, :]
    m[restart] = (np.exp(first) * e[restart])[:, None, :]
    alpha = _scan(m)
    back = m.copy()
    back[restart] = 0.25
    beta = np.ones((n, 2)) * 0.5
    if n > 1:
        beta[:-1] = _scan(back[:0:-1].transpose(0, 2, 1))[::-1]
    p = alpha * beta
    p = p[:, 1] / p.sum(axis=1)
    inner = np.flatnonzero(~restart)
    joint = alpha[inner - 1][:, :, None] * m[inner] * beta[inner][:, None, :]
    joint = joint / joint.sum(axis=(1, 2), keepdims=True)
    return p, joint.sum(axis=0)


class Weights:
    """Weights by feature hash, 0 for all others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[(keys & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True

    def of(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros(len(features))
        at = np.flatnonzero(self.maybe[(features & np.uint64((1 << BITS) - 1)).astype(np.int64)])
        if len(at) and len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, features[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[place] == features[at], self.values[place], 0)
        return out


def _score(tokens: Tokens, model: dict) -> np.ndarray:
    got = np.full(len(tokens.begin), model["bias"])
    for weights, features in zip(model["weights"], tokens.features):
        got += weights.of(features)
    return got


def _fresh(w: Words, labels: np.ndarray, seen: dict[tuple, int]) -> np.ndarray:
    """Which texts of a slice are no near copies of earlier ones of their label.

    A near copy shares three or all of four minima over five-word runs with one
    earlier text; ``seen`` maps label, minimum and its number to the first text that had it.
    """
    h = w.hashes()
    fresh = np.zeros(w.n_docs, bool)
    for d in range(w.n_docs):
        own = h[w.first[d] : w.first[d + 1]]
        if not len(own):
            continue
        run = own if len(own) < 5 else own[:-4] + own[1:-3] * np.uint64(3) + own[2:-2] * np.uint64(5) + own[3:-1] * np.uint64(7) + own[4:] * np.uint64(11)
        marks = [(int(labels[d]), k, int(mix(run + np.uint64(k)).min())) for k in range(4)]
        earlier, votes = Counter(seen[m] for m in marks if m in seen).most_common(1)[0] if any(m in seen for m in marks) else (None, 0)
        fresh[d] = votes < 3
        name = len(seen) if fresh[d] else earlier
        for m in marks:
            seen.setdefault(m, name)
    return fresh


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    joined, n = np.concatenate(keys), np.concatenate(counts)
    out, place = np.unique(joined, return_inverse=True)
    return out, np.bincount(place, n, len(out)).astype(np.int64)


def fit_crf(column, toxic: np.ndarray, steps: int = 100, significance: float = 14.0, ridge: float = 0.05, folds: int = 25) -> dict:
    """Weights, transitions and calibration from labelled texts, an Arrow column.

    Near copies of a text count once in the token labels' statistics.  The
    chain learns from all sentences: each step from those with a word that looks
    toxic and from one of ``folds`` parts of the others, part after part.  With
    no toxic text, or no other one, every score is 0.
    """
    none = np.zeros(0, np.uint64)
    model = {"weights": [Weights(none, np.zeros(0))] * 4, "bias": -8.0, "trans": np.zeros((2, 2)), "first": np.zeros(2), "slope": 1.0, "offset": -8.0}

    def each():
        """Slices of the texts, made anew for each walk: tokens take far more room than texts."""
        for i, j, data, offs in slices(column):
            yield toxic[i:j], Tokens(data, offs)

    seen: dict[tuple, int] = {}
    held = [[([none], [np.zeros(0, np.int64)]) for _ in range(4)] for _ in range(2)]  # by label and kind: features, documents
    size = np.zeros(2)
    for own_labels, t in each():
        fresh = _fresh(t.words, own_labels, seen)
        for y in (0, 1):
            docs = fresh & (own_labels == y)
            size[y] += docs.sum()
            use = docs[t.words.doc]
            for k, f in enumerate(t.features):
                o = np.lexsort((t.words.doc[use], f[use]))
                f, d = f[use][o], t.words.doc[use][o]
                once = np.concatenate([[True], (f[1:] != f[:-1]) | (d[1:] != d[:-1])])[: len(f)]
                keys, n = np.unique(f[once], return_counts=True)
                held[y][k][0].append(keys), held[y][k][1].append(n)
    if not size.all():
        return model
    rate = size[1] / size.sum()
    marked = []
    for k in range(4):
        (others, good), (keys, bad) = (_summed(*held[y][k]) for y in (0, 1))
        held[0][k] = held[1][k] = None
        place = np.minimum(np.searchsorted(others, keys), max(len(others) - 1, 0))
        n = bad + np.where(others[place] == keys, good[place], 0) if len(others) else bad
        q = np.clip(bad / n, 1e-9, 1 - 1e-9)
        gain = n * (q * np.log(q / rate) + (1 - q) * np.log((1 - q) / (1 - rate)))
        use = (gain >= significance) & (q >= 0.95)
        marked.append(Weights(keys[use], np.ones(use.sum())))
    kinds, labels, restart, part = [[] for _ in range(4)], [], [], []
    rng = np.random.default_rng(11)
    for own_labels, t in each():
        if not len(t.begin):
            continue
        bad = own_labels[t.words.doc] == 1
        looks = np.any([m.of(f) > 0 for m, f in zip(marked, t.features)], axis=0)
        sent = np.cumsum(t.restart) - 1
        own_part = rng.integers(1, folds + 1, sent[-1] + 1)
        own_part[sent[looks]] = 0  # also those of other documents that look alike
        part.append(own_part[sent].astype(np.int8))
        for k in range(4):
            kinds[k].append(t.features[k])
        labels.append(looks & bad)
        restart.append(t.restart)
    if not any(x.any() for x in labels):
        return model
    part, labels, restart = np.concatenate(part), np.concatenate(labels).astype(float), np.concatenate(restart)
    keys, slots = [], []
    for x in kinds:
        own, place = np.unique(np.concatenate(x), return_inverse=True)
        keys.append(own), slots.append(place.astype(np.int32))
        x.clear()
    rows_of = [np.flatnonzero(part == k) for k in range(folds + 1)]
    theta = [np.array(-6.0), np.zeros((2, 2)), np.zeros(2), *(np.zeros(len(x)) for x in keys)]
    mean = [np.zeros_like(x) for x in theta]
    square = [np.zeros_like(x) for x in theta]
    for step in range(1, steps + 1):
        rows = np.concatenate([rows_of[0], rows_of[1 + step % folds]])
        begins, own = restart[rows], [x[rows] for x in slots]
        inner = np.flatnonzero(~begins)
        y = labels[rows]
        seen_pairs = np.bincount((2 * y[inner - 1] + y[inner]).astype(int), minlength=4).reshape(2, 2)
        score = theta[0] + sum(theta[3 + k][own[k]] for k in range(4))
        p, pair = marginals(score, begins, theta[1], theta[2])
        miss = y - p
        grads = [np.array(miss.sum()), seen_pairs - pair, np.array([-miss[begins].sum(), miss[begins].sum()])]
        grads += [np.bincount(s, miss, len(x)) for s, x in zip(own, keys)]
        for k, (x, g, m, s) in enumerate(zip(theta, grads, mean, square)):
            g = g - ridge * x * (k > 0)
            m += 0.1 * (g - m)
            s += 0.02 * (g * g - s)
            x += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.98**step)) + 1e-3)
    weights = [Weights(k[np.abs(x) > 0.02], x[np.abs(x) > 0.02]) for k, x in zip(keys, theta[3:])]
    model |= {"weights": weights, "bias": float(theta[0]), "trans": theta[1], "first": theta[2]}
    x = np.concatenate([document_evidence(t, model)[0] for _, t in each()])
    model["slope"], model["offset"] = _calibrate(x, toxic[: len(x)] == 1)
    return model


def _calibrate(x: np.ndarray, y: np.ndarray, slope: float = 2.0, chance: float = 0.7) -> tuple[float, float]:
    """Slope and offset of the logistic function from evidence to score.

    The score is ``chance`` where the two kinds of fitting documents part best:
    in the middle, by expected toxic tokens, of the range of cuts with the best
    balanced accuracy.
    """
    values = np.unique(x)
    cuts = np.concatenate([values, [values[-1] + 1]]) if len(values) else np.zeros(1)
    good = [(x[y] >= c).mean() + (x[~y] < c).mean() for c in cuts]
    k = int(np.argmax(good))
    cut = np.log((np.exp(cuts[k]) + np.exp(cuts[max(k - 1, 0)])) / 2)
    return slope, float(np.log(chance / (1 - chance)) - slope * cut)


def document_evidence(tokens: Tokens, model: dict):
    """(log of the tokens per document that two independent taggings both mark, token marginals)."""
    w = tokens.words
    p, _ = marginals(_score(tokens, model), tokens.restart, model["trans"], model["first"])
    return np.log(np.bincount(w.doc, p * p, w.n_docs) + 1e-3), p


def toxicity_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 2_000, max_bytes: int = 1 << 24) -> dict:
    """The fitted model; ``toxicity_scores`` says from which rows."""
    source, _ = with_private_names(docs.select(id_col, text_col), id_col, text_col)
    sample = labelled_sample(source, labels, label_col, id_col, max_rows, max_bytes)
    return fitted(sample, lambda rows: fit_crf(rows.column("__text"), rows.column("y").to_numpy())) or fit_crf(pa.array([], pa.string()), np.zeros(0, int))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, max_rows: int = 2_000, max_bytes: int = 1 << 24, span_chance: float = 0.5, whole_rows: bool = False, model: dict | None = None) -> DataFrame:
    """(id, held_out, score, predicted, spans) for each row of ``docs``.

    Spans are code point ranges [start, end) of tokens whose chance of being
    toxic is ``span_chance`` or more, with the largest chance; neighbouring
    tokens of a sentence make one span.  Labels are learnt only from rows that are
    not held out: of the toxic and of the other ones at most ``max_rows`` ids,
    with ``max_bytes`` bytes of text, those with the smallest hashes.  Whole
    texts and nothing else enter the scores.  Null and wordless texts get the
    score of no evidence; null labels and ids are not learnt from; rows with
    equal ids are each scored, and learnt from once (by the smallest text); equal
    rows are scored alike; no rows give none.  With ``whole_rows``, the id's
    place is taken by ``document``, a struct of all columns of ``docs``, so that
    no name of theirs can clash with the results'.  A ``model`` of
    ``toxicity_model`` may be given in place of the one that is learnt here.
    """
    source, names = with_private_names(docs if whole_rows else docs.select(id_col, text_col), id_col, text_col)
    kept = [f for f in source.schema if whole_rows or f.name == "__id"]
    model = model or toxicity_model(docs, labels, id_col, text_col, label_col, max_rows, max_bytes)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", __score double, __spans array<struct<start:int,end:int,chance:double>>"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i, j, data, offs in slices(batch.column("__text")):
                t = Tokens(data, offs)
                x, p = document_evidence(t, model)
                score = 1 / (1 + np.exp(-np.clip(model["slope"] * x + model["offset"], -30, 30)))
                own = [batch.column(f.name).slice(i, j - i) for f in kept]
                spans = pa.array(toxic_spans(t, p, data, offs, span_chance), span_type)
                yield pa.RecordBatch.from_arrays([*own, pa.array(score), spans], [*(f.name for f in kept), "__score", "__spans"])

    out = source.mapInArrow(frugal(run), schema)
    first = F.struct(*(F.col(own).alias(c) for c, own in names.items())).alias("document") if whole_rows else F.col("__id").alias(id_col)
    return out.select(
        first, F.coalesce(held_out("__id"), F.lit(False)).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= threshold).cast("int").alias("predicted"), F.col("__spans").alias("spans"),
    )


def toxic_spans(tokens: Tokens, p: np.ndarray, data: np.ndarray, offs: np.ndarray, least: float) -> list[list[dict]]:
    """The spans of each document: runs of tokens of one sentence with a chance of ``least`` or more."""
    w = tokens.words
    spans: list[list[dict]] = [[] for _ in range(w.n_docs)]
    hit = p >= least
    if not hit.any():
        return spans
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    goes_on = np.concatenate([[False], hit[:-1]]) & hit & ~tokens.restart
    first = np.flatnonzero(hit & ~goes_on)
    last = np.flatnonzero(hit & ~np.concatenate([goes_on[1:], [False]]))
    chance = np.maximum.reduceat(np.where(hit, p, 0), first)
    zero = chars[offs[w.doc[first]]]
    rows = zip(w.doc[first].tolist(), (chars[tokens.begin[first]] - zero).tolist(), (chars[tokens.end[last]] - zero).tolist(), chance.tolist())
    for d, start, end, most in rows:
        spans[d].append({"start": start, "end": end, "chance": most})
    return spans
