"""Document quality by pairwise ranking.

A Bradley-Terry model gives each text a strength, linear in surface features of
the whole text: the probability that one text is preferred to another is the
logistic function of the difference of their strengths.  It is fitted to pairs of
a preferred (label 1) and another (label 0) text by the logistic loss on their
feature differences; the decision threshold is a quantile of the strengths of
the fitting rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fitted, frugal, held_out, labelled_sample, with_private_names
from .textkernel import SPACE, Words, slices

FEATURES = (
    "log_words", "symbol_share", "upper_share", "digit_share", "type_token", "echo_share", "odd_words", "mean_length",
    "long_words", "punctuation", "non_ascii", "breaks", "bangs", "short_words", "same_trigrams", "top_word", "sentence_words", "lone_symbols",
)


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _lut(b"#*$%&|<>@^~_=+\\{}[]/")
_UPPER, _DIGIT, _PUNCT, _BANG = _lut(bytes(range(65, 91))), _lut(b"0123456789"), _lut(b".,;:?!"), _lut(b"!")
_ALNUM = _lut(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_STOP = _lut(b".!?")


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a slice; all zero without words."""
    w = Words(data, offs)
    n, docs = len(w.starts), w.n_docs
    x = np.zeros((docs, len(FEATURES)), np.float64)
    if not n:
        return x

    def summed(mask):
        c = np.concatenate([[0], np.cumsum(mask)])
        return c

    def per_doc(c):
        return (c[offs[1:]] - c[offs[:-1]]).astype(float)

    chars = summed((data & 0xC0) != 0x80)
    sym, up, dig, alnum, bang = (summed(t[data]) for t in (_SYMBOL, _UPPER, _DIGIT, _ALNUM, _BANG))
    solid = np.maximum(per_doc(summed(~SPACE[data])), 1)
    words = np.maximum(w.counts, 1)
    length = chars[w.ends] - chars[w.starts]

    def share(mask):
        return np.bincount(w.doc, mask, docs) / words

    h = w.hashes()
    s = np.lexsort((h, w.doc))
    new = np.concatenate([[True], (h[s][1:] != h[s][:-1]) | (w.doc[s][1:] != w.doc[s][:-1])])
    at = np.flatnonzero(new)
    runs = np.diff(np.concatenate([at, [n]]))
    top = np.zeros(docs)
    np.maximum.at(top, w.doc[s][at], runs)
    echo = np.zeros(n)
    echo[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    same = np.zeros(docs)
    if n > 2:
        ok = w.doc[:-2] == w.doc[2:]
        tri = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)
        tri, d = tri[ok], w.doc[:-2][ok]
        o = np.lexsort((tri, d))
        again = (tri[o][1:] == tri[o][:-1]) & (d[o][1:] == d[o][:-1])
        same = np.bincount(d[o][1:][again], minlength=docs)
    ends = np.bincount(w.doc, _STOP[data[w.ends - 1]], docs)
    columns = (
        np.log1p(w.counts), per_doc(sym) / solid, per_doc(up) / solid, per_doc(dig) / solid,
        np.bincount(w.doc[s][at], minlength=docs) / words, share(echo), share(sym[w.ends] > sym[w.starts]), np.bincount(w.doc, length, docs) / words,
        share(length > 15), per_doc(summed(_PUNCT[data])) / words, per_doc(summed(data >= 0xC0)) / solid, per_doc(summed(data == 10)) / words,
        per_doc(bang) / words, share(length <= 3), same / words, top / words, np.log1p(words / (ends + 1)), share(alnum[w.ends] == alnum[w.starts]),
    )
    x[:] = np.stack(columns, axis=1)
    x[w.counts == 0] = 0
    return x


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, and their squares: both ends of a scale can be bad.

    A text of few words says little, so its features are drawn to the mean.
    """
    n = np.expm1(x[:, :1])
    z = np.clip((x - mean) / scale, -6, 6) * (n + 0.5) / (n + 10)
    return np.concatenate([z, z * z / 6], axis=1)


def fit_bradley_terry(x: np.ndarray, y: np.ndarray, batch: int = 8192, ridge: float = 1e-3, steps: int = 400, seed: int = 5) -> dict:
    """Weights from preference pairs, ``batch`` new ones a step, and the threshold's quantile and value.

    Without rows of both labels every text has the same strength; the score is
    then 1 or 0 as the only label says, and 0.5 without any row.
    """
    x = np.asarray(x, float).reshape(-1, len(FEATURES))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    mean = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES))
    scale = x.std(axis=0) + 1e-6 if len(x) else np.ones(len(FEATURES))
    model = {"mean": mean, "scale": scale, "weights": np.zeros(2 * len(FEATURES)), "cut": 0.0, "quantile": 0.5, "slope": 1.0}
    if not len(good) or not len(bad):
        model["cut"] = 0.0 if not len(y) else (-30.0 if len(good) else 30.0)
        return model
    rng = np.random.default_rng(seed)
    z = expand(x, mean, scale)
    w, m, v = model["weights"], np.zeros(2 * len(FEATURES)), np.zeros(2 * len(FEATURES))
    for t in range(1, steps + 1):
        part = z[rng.choice(good, batch)] - z[rng.choice(bad, batch)]
        g = -(part * (1 / (1 + np.exp(np.clip(part @ w, -60, 60))))[:, None]).mean(axis=0) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    strength = z @ w
    # the quantile that parts the labels best, balanced between them
    order = np.sort(strength)
    cuts = np.unique(np.quantile(order, np.linspace(0, 1, 401)))
    balance = [(strength[good] >= c).mean() + (strength[bad] < c).mean() for c in cuts]
    best = np.flatnonzero(np.asarray(balance) >= max(balance) - 1e-9)
    cut = (cuts[best[0]] + cuts[best[-1]]) / 2
    return model | {"weights": w, "cut": float(cut), "quantile": float((order < cut).mean())}


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 8_000, max_bytes: int = 1 << 26) -> dict:
    """The fitted model; ``quality_scores`` says from which rows."""
    source, _ = with_private_names(docs.select(id_col, text_col), id_col, text_col)
    sample = labelled_sample(source, labels, label_col, id_col, max_rows, max_bytes)

    def measure(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i, j, data, offs in slices(batch.column("__text")):
                x = features(data, offs)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("__id", "y")), flat], ["__id", "y", "x"])

    def fit(rows: pa.Table) -> dict:
        return fit_bradley_terry(rows.column("x").combine_chunks().flatten().to_numpy(), rows.column("y").to_numpy())

    sample = sample.select("__id", "y", "__text").mapInArrow(frugal(measure), f"__id {source.schema['__id'].dataType.simpleString()}, y int, x array<double>")
    return fitted(sample, fit) or fit_bradley_terry(np.zeros((0, len(FEATURES))), np.zeros(0))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, max_rows: int = 8_000, max_bytes: int = 1 << 26, whole_rows: bool = False, model: dict | None = None) -> DataFrame:
    """(id, held_out, score, predicted) for each row of ``docs``.

    The score is the logistic function of a text's strength less the cut.
    Labels are learnt only from rows that are not held out: of each label at
    most ``max_rows`` ids, with ``max_bytes`` bytes of text, those smallest by a
    hash; statistics of the cut come from the same rows.  The whole text, and
    nothing else of a row, enters its score; null and wordless texts have all
    features 0.  Rows with equal ids are each scored, and learnt from once (by
    the smallest text); rows without an id are scored, never learnt from, and
    not held out.  Null labels are not learnt from; no rows give none.  With
    ``whole_rows``, the id's place is taken by ``document``, a struct of all
    columns of ``docs``, so that no name of theirs can clash with the results'.
    A ``model`` of ``quality_model`` may be given in place of the one that is
    learnt here.
    """
    source, names = with_private_names(docs if whole_rows else docs.select(id_col, text_col), id_col, text_col)
    kept = [f for f in source.schema if whole_rows or f.name == "__id"]
    model = model or quality_model(docs, labels, id_col, text_col, label_col, max_rows, max_bytes)

    def score(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i, j, data, offs in slices(batch.column("__text")):
                s = expand(features(data, offs), model["mean"], model["scale"]) @ model["weights"] - model["cut"]
                own = [batch.column(f.name).slice(i, j - i) for f in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(1 / (1 + np.exp(-np.clip(s, -40, 40))))], [*(f.name for f in kept), "__score"])

    out = source.mapInArrow(frugal(score), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", __score double")
    first = F.struct(*(F.col(own).alias(c) for c, own in names.items())).alias("document") if whole_rows else F.col("__id").alias(id_col)
    return out.select(first, F.coalesce(held_out("__id"), F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))
