"""Byte-level BPE by forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary can never be
merged over, so a cut between them is certain.  Together with the cuts of the
pre-tokeniser (found on arrays of character classes, not by a regular
expression) they split a slice of texts into short fragments.  Each distinct
fragment of a slice is encoded once and on its own; the ids of all fragments,
laid one after another, are the ids of the texts.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frugal
from .textkernel import Words, slices

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
CACHE = 100_000  # fragments whose ids a task keeps

# fixed values: code points with the Unicode property White_Space
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# fixed values: endings that the pre-tokeniser sets apart after an apostrophe
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[_WHITE] = BLANK
    return out


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pair_ranks(vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> dict:
    """(rank, id of the whole) of each pair of ids that merges; the first listing counts."""
    out: dict = {}
    for rank, (a, b) in enumerate(merges):
        out.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    return out


class ByteBpe:
    """Encoder and decoder of one tokenizer file; texts come as Arrow arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        step = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or step["type"] != "ByteLevel" or step["add_prefix_space"] or not step["use_regex"]:
            raise ValueError("only plain byte-level BPE files are supported")
        if any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens must be plain strings")
        alphabet = _byte_alphabet()
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t.encode() not in self.special or all(c in alphabet for c in t) and i not in self.special.values()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        merges = [tuple(bytes(alphabet[c] for c in x) for x in m) for m in merges]
        del spec
        self.bytes_of = [vocab.get(bytes([b]), -1) for b in range(256)]
        self._fast = self._library(vocab) if self.ranks_decide(vocab, merges) else None
        self.ranks = {} if self._fast else pair_ranks(vocab, merges)
        self.forced = np.ones((256, 256), bool)
        for token in vocab:
            for a, b in zip(token, token[1:]):
                self.forced[a, b] = False
        size = max([*vocab.values(), *self.special.values()]) + 1
        table = [b""] * size
        for text, i in [*vocab.items(), *self.special.items()]:
            table[i] = text
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.token_ends = np.cumsum([len(t) for t in table])
        self.classes = _classes()
        self.cache: dict[int, bytes] = {}

    def ranks_decide(self, vocab, merges) -> bool:
        """Whether merging any neighbours that make a token, lowest id first, does the same as the listed merges.

        It does if ids ascend with the merges and each merged token, put together
        by lower merges of either kind alone, ends as the two parts of its listed
        merge: no lower merge ever crossed the token's borders, so in a longer
        text its bytes go through the same states, and no other two parts can
        stand side by side when the token's turn comes.
        """
        order = [vocab[a + b] for a, b in merges]
        if len(set(order)) < len(order) or order != sorted(order) or min(order, default=256) < 256 or sorted(self.bytes_of) != list(range(256)):
            return False
        merged = set(order)
        for a, b in merges:
            parts, own = [bytes([x]) for x in a + b], vocab[a + b]
            while len(parts) > 2:
                ids = [vocab.get(x + y, own) for x, y in zip(parts, parts[1:])]
                low = min(ids)
                if low >= own or low not in merged:
                    return False
                k = ids.index(low)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if parts != [a, b]:
                return False
        return True

    def _library(self, vocab):
        """A merge loop in native code, which goes by the ids of tokens."""
        try:
            import tiktoken
        except ImportError:
            return None
        return tiktoken.Encoding("fragments", pat_str=r"[\s\S]+", mergeable_ranks=vocab, special_tokens={})._core_bpe

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one fragment: the pair of lowest rank merges first, leftmost on ties.

        Pairs wait in a heap and tokens in a linked list, so that long fragments
        take little more than linear time.
        """
        ids = [self.bytes_of[b] for b in piece]
        after, before, n = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), len(ids)

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n and (found := self.ranks.get((ids[k], ids[after[k]]))):
                heapq.heappush(heap, (found[0], k, ids[k], ids[after[k]], found[1]))

        heap: list = []
        for k in range(n):
            offer(k)
        while heap:
            _, k, left, right, whole = heapq.heappop(heap)
            gone = after[k]
            if ids[k] != left or gone >= n or ids[gone] != right:  # one of the two has merged since
                continue
            ids[k], ids[gone], after[k] = whole, None, after[gone]
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [i for i in ids if i is not None]

    def _fragment(self, piece: bytes) -> bytes:
        ids = self._fast.encode_single_piece(piece) if self._fast else self.merge(piece)
        return np.array(ids, "<u4").tobytes()

    def cuts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where fragments begin; ``begins`` are the borders of independent texts."""
        head = (data & 0xC0) != 0x80
        at = np.flatnonzero(head)
        # code points from their bytes
        lead = data[at].astype(np.int64)
        extra = (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
        code = np.where(extra == 0, lead, lead & (0x3F >> np.minimum(extra, 3)))
        for k in range(1, int(extra.max(initial=0)) + 1):
            more = np.flatnonzero(extra >= k)
            code[more] = (code[more] << 6) | (data[at[more] + k] & 0x3F)
        kind = self.classes[code]
        n = len(at)
        border = np.zeros(n + 1, bool)
        border[np.searchsorted(at, begins)] = True
        border[[0, n]] = True
        cut = border[:-1].copy()
        cut[1:] |= kind[1:] != kind[:-1]
        # of a blank run before a word, the last blank goes to the word if it is a space, else stands alone
        blank = kind == BLANK
        word_next = np.zeros(n, bool)
        word_next[:-1] = blank[:-1] & ~blank[1:] & ~border[1:-1]
        joins = word_next & (code == 0x20)
        cut[word_next] = True
        cut[np.flatnonzero(joins) + 1] = False
        # an apostrophe that begins a piece and one of the endings after it
        quote = np.flatnonzero((code == 0x27) & cut & (kind == OTHER))
        quote = quote[quote + 1 < n]
        if len(quote):
            for ending in _ENDINGS:
                ok = np.ones(len(quote), bool)
                for k, c in enumerate(ending, 1):
                    place = np.minimum(quote + k, n - 1)
                    ok &= (quote + k < n) & (code[place] == ord(c)) & ~border[place]
                hit = quote[ok]
                cut[hit + 1] = False
                after = hit + 1 + len(ending)
                cut[after[after < n]] = True
        out = np.zeros(len(data), bool)
        out[at[cut]] = True
        out[1:] |= self.forced[data[:-1], data[1:]]
        return np.flatnonzero(out)

    def encode_slice(self, data: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text."""
        docs = len(offs) - 1
        if not len(data):
            return [b""] * docs
        marks = self._specials(data, offs)
        begins = self.cuts(data, np.unique(np.concatenate([offs[:-1], *([m, e] for m, e, _ in marks)]).astype(np.int64)))
        if marks:  # a special string is one fragment
            first, last = np.array([m for m, _, _ in marks]), np.array([e for _, e, _ in marks])
            own = np.maximum(np.searchsorted(first, begins, "right") - 1, 0)
            begins = begins[(begins <= first[own]) | (begins >= last[own])]
        begins = begins[begins < len(data)]
        ends = np.concatenate([begins[1:], [len(data)]])
        w = Words.__new__(Words)
        w.data, w._prefix = data, None
        keys, sample, inverse = np.unique(w.range_hash(begins, ends), return_index=True, return_inverse=True)
        raw, found = data.tobytes(), []
        if len(self.cache) > CACHE:
            self.cache.clear()
        for key, b, e in zip(keys.tolist(), begins[sample].tolist(), ends[sample].tolist()):
            ids = self.cache.get(key)
            if ids is None:
                ids = self.cache[key] = self._fragment(raw[b:e])
            found.append(ids)
        if marks:
            kinds, kind = np.unique([i for _, _, i in marks], return_inverse=True)
            inverse[np.searchsorted(begins, first)] = len(found) + kind
            found += [np.array([i], "<u4").tobytes() for i in kinds.tolist()]
        sizes = np.fromiter((len(x) // 4 for x in found), np.int64, len(found))
        table = np.frombuffer(b"".join(found), "<u4")
        at = np.concatenate([[0], np.cumsum(sizes)])
        count = sizes[inverse]
        done = np.concatenate([[0], np.cumsum(count)])
        ids = table[np.repeat(at[:-1][inverse] - done[:-1], count) + np.arange(done[-1])]
        edge = done[np.searchsorted(begins, offs)]
        packed = ids.tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]

    def _specials(self, data, offs):
        """(begin, end, id) of the special strings in the texts, the longest at each place, without overlap."""
        raw, marks = data.tobytes(), []
        for text, i in self.special.items():
            at = raw.find(text)
            while at >= 0:
                marks.append((at, -len(text), i))
                at = raw.find(text, at + 1)
        if not marks:
            return []
        marks.sort()
        d = np.searchsorted(offs, [at for at, _, _ in marks], "right") - 1
        out, free = [], 0
        for (at, size, i), stop in zip(marks, offs[d + 1].tolist()):
            if at >= free and at - size <= stop:
                out.append((at, at - size, i))
                free = at - size
        return out

    def encode(self, column) -> list[bytes]:
        out = []
        for _, _, data, offs in slices(column):
            out += self.encode_slice(data, offs)
        return out

    def decode(self, packed: list[bytes]) -> list[str]:
        """Texts of packed ids; bytes that are no UTF-8 become the replacement character."""
        out = []
        for k in range(0, len(packed), 256):
            part = packed[k : k + 256]
            ids = np.frombuffer(b"".join(part), "<u4").astype(np.int64)
            end = self.token_ends[ids]
            size = end - np.where(ids > 0, self.token_ends[np.maximum(ids - 1, 0)], 0)
            done = np.concatenate([[0], np.cumsum(size)])
            data = self.token_bytes[np.repeat(end - size - done[:-1], size) + np.arange(done[-1])].tobytes()
            edge = done[np.concatenate([[0], np.cumsum([len(x) // 4 for x in part])])].tolist()
            out += [data[a:b].decode("utf-8", "replace") for a, b in zip(edge[:-1], edge[1:])]
        return out


_loaded: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """The tokenizer of a file, read once in each process."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row: ids packed as little-endian unsigned 32-bit integers.

    Strings of special tokens in a text become their ids, nothing is added.  A
    null or empty text has no ids; other columns are ignored; equal rows give
    equal results.  ``path`` must name the file on every executor.
    """
    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]):
        bpe = tokenizer(path)
        for batch in batches:
            for i, j, data, offs in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(bpe.encode_slice(data, offs), pa.binary())], [id_col, "ids"])

    return source.mapInArrow(frugal(run), f"`{id_col}` {source.dtypes[0][1]}, ids binary")


def bpe_decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its packed ids as ``text_col``; null ids give an empty text."""
    path = path or default_path()
    names = [c for c in encoded.columns if c != text_col]
    source = encoded.select(*(F.col(f"`{c}`") for c in names))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + f", `{text_col}` string"

    def run(batches: Iterator[pa.RecordBatch]):
        bpe = tokenizer(path)
        for batch in batches:
            packed = [x or b"" for x in batch.column(names.index(ids_col)).to_pylist()]
            for k in range(0, max(len(packed), 1), 1000):
                part = batch.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bpe.decode(packed[k : k + 1000]), pa.string())], [*names, text_col])

    return source.mapInArrow(frugal(run), schema)
