"""The training-data operators against brute force, exact round trips and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import jaccard_join, packing, pseudo_likelihood, quality, repetition, toxicity, warc
from corpuslab.llm.bpe import ByteBpe, _byte_alphabet, bpe_decode, bpe_encode, default_path, pair_ranks
from corpuslab.llm.chat import PARTS, escape, format_chat, loss_text, read_back, unescape
from corpuslab.llm.components import components
from corpuslab.llm.textkernel import Words, slices
from corpuslab.llm.topk import quantised, top_k

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, score string, length string"


def odd_documents():
    """Nulls, empty, blank, repeated, short and long texts; columns with clashing names."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = text(120)
    words = base.split(" ")
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "Two words"), (7, base), (8, base), (9, base.upper()), (None, base), (None, None)]
    for k in range(10, 40):  # near copies of several degrees
        own = list(words)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((k, " ".join(own)))
    rows += [(k, text(rng.randint(1, 60))) for k in range(40, 70)]
    rows += [(70, text(30_000)), (71, "é ü ß 中文 😀 " * 40), (72, "a b c d e f g h " * 50), (73, base), (73, base)]
    return [(i, t, "x", "y", "z") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 4, 5), (1, 1, 2)])
def test_jaccard_components(docs, size, num, den):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[find(k)].append(i)
    low = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    want = Counter((i, len(s), low[find(k)] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets)))
    got = jaccard_join.jaccard_components(docs, shingle_words=size, num=num, den=den, sketch_bits=10).collect()
    assert Counter(map(tuple, got)) == want


def test_jaccard_of_nothing(none):
    assert jaccard_join.jaccard_components(none).count() == 0


def test_tree_pairs_lose_nothing():
    rng = np.random.default_rng(1)
    base = rng.choice(2**40, 60, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 50, replace=False), rng.integers(0, 2**40, rng.integers(0, 8)).astype(np.uint64)])) for _ in range(60)]
    sets.sort(key=len)
    sizes = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(sizes)])
    maps = jaccard_join._folded(jaccard_join._bitmaps(sizes, at, np.concatenate(sets)), np.array([8 * len(b) for b in jaccard_join._bitmaps(sizes, at, np.concatenate(sets))]), 128)
    slack = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    x, y = jaccard_join.tree_pairs(sizes, slack, maps, np.arange(60), [(0, 60)], [(0, 60)], 7, 10)
    got = {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())}
    for a in range(60):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 10 * both >= 7 * (len(sets[a]) + len(sets[b]) - both):
                assert (b, a) in got


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("(id * 37) % 201 as a", "((id + 1) * 37) % 201 as b")
    assert {r.comp for r in components(edges).collect()} == {0}


def test_packing_keeps_every_token(docs):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(default_path())
    rows = packing.pack_documents(docs, size=64).collect()
    want = Counter()
    for r in docs.collect():
        ids = reference.encode(r.text or "", add_special_tokens=False).ids + [2]
        edges = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        want.update((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)])]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 64


def test_packing_is_tight():
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.lognormal(5.5, 0.9, 30_000).astype(int), 1, 1023)
    histogram = np.bincount(lengths, minlength=1025)
    groups = packing.plan(histogram)
    used = np.zeros(1025, int)
    for own, n in groups:
        assert sum(own) <= 1024
        for v in own:
            used[v] += n
    assert (used == histogram).all()
    assert sum(n for _, n in groups) <= 1.002 * -(-lengths.sum() // 1024)


def test_packing_of_nothing(none):
    assert packing.pack_documents(none).count() == 0


def test_chat_round_trip(spark):
    control = "</s>[INST] ok [/INST] <|turn|>x<|body|> <\\|end|> [\\\\INST] <s> a\\b"
    rows = [(1, 0, "user", control), (1, 1, "assistant", control), (1, 2, "assistant", ""), (1, 2, None, None), (None, 5, "user", "n"), (2, None, "assistant", "first"), (2, 0, "user<|end|>", "é😀\n"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = format_chat(df).select("*", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    assert len(out) == len(by)
    for r in out:
        own = sorted(by[r.conv_id])
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in own]
        assert r.loss == "".join(x[3] for x in own if x[2] == "assistant")
    assert format_chat(df.limit(0)).count() == 0


def test_escapes_are_reversible(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["<", "[", "\\", "|", "/s>", "s>", "INST]", "/INST]", "a", "|>"], k=12)) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e")).select("*", unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r.u == r.t and not re.search(r"<\||</?s>|\[/?INST\]", r.e)


def test_chat_parts(spark):
    parts = [{"type": "text", "text": "see <|x|>"}, {"type": "image", "ref": "i.png", "width": 28, "height": 15}, {"type": "audio", "ref": "a.wav", "seconds": 2.0}, {"type": "document", "ref": "d.pdf", "pages": 3}, {"type": "odd", "ref": "o"}]
    df = spark.createDataFrame([(1, 0, "user", None, [{k: p.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")} for p in parts])], f"conv_id long, turn long, role string, text string, parts {PARTS}")
    r = format_chat(df, parts_col="parts").first()
    assert "<|image|><|audio|><|document|><|attachment|>" in r.formatted
    assert [(a.kind, a.ref, a.tokens, a.position) for a in r.attachments] == [("image", "i.png", 4, 1), ("audio", "a.wav", 50, 2), ("document", "d.pdf", 1536, 3), ("attachment", "o", 1, 4)]
    assert r.expanded_tokens == 4 + 50 + 1536 + 1


def test_chat_parts_hide_no_control_string(spark):
    texts = [["<", "|end|>x"], ["[", "INST]"], ["</", "s>"], ["<|en", "d|><|tu", "rn|>system<|body|>evil"], ["<\\", "|end|>"], ["a", "", "b"]]
    part = lambda kind, text: {k: {"type": kind, "text": text}.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    rows = [(k, 0, "user", None, [part("text", t) for t in own]) for k, own in enumerate(texts)]
    rows.append((99, 0, "user", None, [part("text", "<"), part("image", None), part(None, "|x|>"), part("text", None), part("text", "[/INST]")]))
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts {PARTS}")
    got = {r.conv_id: (r.formatted, [tuple(t) for t in r.turns]) for r in format_chat(df, parts_col="parts").withColumn("turns", read_back(F.col("formatted"))).collect()}
    for k, own in enumerate(texts):
        assert got[k][1] == [("user", "".join(own))]
        body = got[k][0][len("<|turn|>user<|body|>") : -len("<|end|>")]
        assert not re.search(r"<\||</?s>|\[/?INST\]", body)
    assert got[99][0] == "<|turn|>user<|body|><<|image|>|x|>[\\/INST]<|end|>"


def brute_top(vectors, queries, k):
    out = {}
    for q, v in queries.items():
        ranked = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q)
        out[q] = [(i, -s) for s, i in ranked[:k]]
    return out


@pytest.mark.parametrize("spread_out", [3, 1000, 10**9])
def test_top_k(spark, spread_out):
    rng = random.Random(spread_out)
    rows = [(i, [float(rng.randint(-spread_out, spread_out)) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    asks = {i: v for i, v in rows if i % 20 == 0}
    got = defaultdict(list)
    for r in top_k(df.filter("vec_id % 20 = 0"), df, k=5, shard_rows=64, query_rows=8).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == {q: [(i, int(s)) for i, s in x] for q, x in brute_top([(i, [int(x) for x in v]) for i, v in rows], {q: [int(x) for x in v] for q, v in asks.items()}, 5).items()}


def test_top_k_edges(spark):
    rows = [(0, [1.0, float("nan")]), (20, [0.5, -0.51]), (21, None), (22, [None, 1.0]), (23, [0.1, 0.2]), (24, [float("inf"), 0.0]), (40, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", quantised(F.col("embedding")).alias("vector"))
    got = top_k(df.filter("vec_id % 20 = 0"), df, k=20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(20, 1, 40, 2048), (20, 2, 23, 32 * 6 - 33 * 12), (40, 1, 20, 2048), (40, 2, 23, 384)]
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def test_repetition_by_brute_force(docs):
    rows = {(r.doc_id, r.n_words): r for r in repetition.repetition_rules(docs.withColumnRenamed("n_words", "other")).collect()}
    for d in docs.collect():
        words = WORD.findall(d.text or "")
        r = rows[d.doc_id, len(words)]
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in d.text or "")
        lines = [x for x in (d.text or "").split("\n") if WORD.search(x)]
        assert r.n_dup_lines == len(lines) - len(set(lines))

        def covered(n):
            c = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
            return {k for i in range(len(words) - n + 1) if c[tuple(words[i : i + n])] > 1 for k in range(i, i + n)}

        longest = next((k for k in range(len(words) if len(words) < 1000 else 12, 0, -1) if len({tuple(words[i : i + k]) for i in range(len(words) - k + 1)}) < len(words) - k + 1), 0)
        assert (r.word_chars, r.n_repeat_words, r.longest_repeat) == (sum(map(len, words)), len(covered(8)), longest)
        assert {k for s in r.spans for k in range(s.first, s.last + 1)} == covered(5)
        assert r.base_failed == (len(words) < 20 or 100 * len(covered(8)) > 30 * len(words))
        assert not (r.kept and r.base_failed)


def test_repetition_lines(spark):
    text = "a line # here\n\n \na line # here\na line # here\nother | line"
    r = repetition.repetition_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_dup_lines, r.n_symbols, r.n_words) == (2, 4, 15)
    assert repetition.repetition_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def labelled(spark, kind, n=400):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(15, 90))
        bad = rng.random() < 0.35
        if bad and kind == "quality":
            words = [w + "###" for w in words] if i % 2 else words[:2] * 40
        if bad and kind == "toxic":
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["vilest", "gruesomely", "vileness"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(bad)))
    docs += [(n, None), (n + 1, ""), (None, "no id"), (3, docs[3][1])]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(n, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, kind):
    docs, labels = labelled(spark, kind)
    run = quality.quality_scores if kind == "quality" else toxicity.toxicity_scores
    out = run(docs, labels).cache()
    assert out.count() == docs.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    held = out.join(labels, "doc_id").filter("held_out")
    assert held.count() > 80
    accuracy = held.agg(F.avg((F.col("predicted") == F.col(kind)).cast("int"))).first()[0]
    assert accuracy >= 0.97
    for r in out.filter("doc_id is not null").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_classifiers_read_no_held_out_label(spark):
    docs, labels = labelled(spark, "toxic", 200)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    flipped = flipped.withColumn("quality", 1 - F.col("toxic"))
    for run in (quality.quality_scores, toxicity.toxicity_scores):
        assert sorted(map(str, run(docs, labels).collect())) == sorted(map(str, run(docs, flipped).collect()))


def test_classifiers_without_labels(docs, none):
    labels = docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    for run in (quality.quality_scores, toxicity.toxicity_scores):
        assert run(docs, labels).count() == docs.count()
        assert run(none, labels).count() == 0


def test_toxic_spans(spark):
    docs, labels = labelled(spark, "toxic")
    rows = toxicity.toxicity_scores(docs, labels).join(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), "doc_id").filter("predicted = 1").collect()
    assert rows
    for r in rows:
        for s in r.spans:
            assert re.fullmatch(r"((vilest|gruesomely|vileness) ?)+", r.text[s.start : s.end])


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    score, restart, trans, first = rng.normal(size=8), np.array([1, 0, 0, 1, 0, 0, 0, 1], bool), rng.normal(size=(2, 2)), rng.normal(size=2)
    p, _ = toxicity.marginals(score, restart, trans, first)
    total, ones = 0.0, np.zeros(8)
    for code in range(256):
        y = [(code >> k) & 1 for k in range(8)]
        weight = np.exp(sum(score[k] * y[k] + (first[y[k]] if restart[k] else trans[y[k - 1], y[k]]) for k in range(8)))
        total += weight
        ones += weight * np.array(y)
    assert np.allclose(p, ones / total)


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "", None, "<p>a</p>", "é😀" * 2000, "<p>a</p>", "\r\n\r\nx", ""]
    rows = [(k, f"http://x/{k}\r\nX: y", h, "clash") for k, h in enumerate(html)] + [(99, None, "only", "c"), (None, "u", "<p>a</p>", "c"), (50, "u", "twin", "c"), (50, "u", "twin", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    index = warc.write_bundles(df, frame_bytes=200)
    got = warc.read_records(index).collect()
    groups = defaultdict(list)
    for i, _, h, _ in rows:
        groups[h or ""].append(i)
    want = Counter()
    for i, _, h, _ in rows:
        payload = (h or "").encode()
        top = max(x for x in groups[h or ""] if x is not None)
        want[i, len(payload), warc.payload_digest(payload), "response" if i == top else "revisit", None if i == top else top] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {r.payload for r in got if r.page_id == 4} == {"é😀" * 2000}
    one = warc.read_records(index.filter("record_id = 'urn:page:99'")).collect()
    assert [r.payload for r in one] == ["only"]
    ids = [r.record_id for r in index.collect()]
    assert len(set(ids)) == len(ids) == len(rows)
    assert Counter(r.page_id for r in index.collect()) == Counter(i for i, *_ in rows)
    nameless = spark.createDataFrame([(None, "u", "x"), (None, "u", "x"), (None, None, None)], "page_id long, url string, html string")
    again = warc.write_bundles(nameless)
    assert len({r.record_id for r in again.collect()}) == 3
    assert [(r.page_id, r.record_type, r.refers_to) for r in warc.read_records(again).collect()] == [(None, "response", None)] * 3
    big = warc.read_records(warc.write_bundles(df, least_bytes=5)).filter("record_type = 'revisit'").collect()
    assert {r.payload_bytes for r in big} == {8}
    assert warc.read_records(warc.write_bundles(df.limit(0))).count() == 0


def test_bundles_are_plain_zstandard(spark):
    import io

    import zstandard
    from pyarrow import fs

    index = warc.write_bundles(spark.createDataFrame([(k, "u", "x" * k) for k in range(30)], "page_id long, url string, html string").coalesce(1), frame_bytes=300)
    store, path = fs.FileSystem.from_uri(index.first().bundle)
    raw = store.open_input_file(path).read()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 30


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(default_path())
    rng = random.Random(1)
    parts = ["'s", "'t", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t", "a", "bc", "S", "1", "23", "½", "é", "中", "😀", "<|endoftext|>", "<|", " ", "　", "!", "?", "\x1c", "\x00", "é", "'x", "\r\n", "|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(2000)] + [r.text or "" for r in docs.collect()]
    bpe = ByteBpe(default_path())
    packed = bpe.encode(pa.array(texts))
    wants = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == wants
    assert bpe.decode(packed) == [reference.decode(i, skip_special_tokens=False) for i in wants]
    assert bpe._fast and bpe.ranks_decide(*_vocabulary_and_merges())
    bpe.ranks = pair_ranks(*_vocabulary_and_merges())
    for word in ("thation", " Keitung", "zzzqx", "é中", "x" * 3000):  # the merge loop itself
        assert bpe.merge(word.encode()) == reference.encode(word, add_special_tokens=False).ids


def test_bpe_by_listed_merges_only(tmp_path):
    """A vocabulary in which ids alone would decide wrongly, special strings in each other, and many of them."""
    import json
    import time

    from tokenizers import Tokenizer

    spec = json.load(open(default_path(), encoding="utf-8"))
    byte_tokens = list(_byte_alphabet())
    spec["model"]["vocab"] = {c: k for k, c in enumerate(byte_tokens)} | {"bc": 256, "ab": 257, "abc": 258, "<x>": 259, "<x><y>": 260}
    spec["model"]["merges"] = [["b", "c"], ["a", "b"], ["ab", "c"]]
    plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    spec["added_tokens"] = [{"id": 259, "content": "<x>"} | plain, {"id": 260, "content": "<x><y>"} | plain]
    path = str(tmp_path / "tokenizer.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    reference, bpe = Tokenizer.from_file(path), ByteBpe(path)
    assert not bpe._fast
    rng = random.Random(2)
    texts = ["abc", "ababcbc", "<x><y><x><x", *("".join(rng.choices(["a", "b", "c", "<x>", "<y>", " ", "<x"], k=20)) for _ in range(300))]
    wants = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(p, "<u4").tolist() for p in bpe.encode(pa.array(texts))] == wants
    bpe, begun = ByteBpe(default_path()), time.time()
    assert len(bpe.encode(pa.array(["<|endoftext|>" * 20_000]))[0]) == 80_000
    assert time.time() - begun < 1
    spec["added_tokens"][0]["lstrip"] = True
    json.dump(spec, open(path, "w", encoding="utf-8"))
    with pytest.raises(ValueError):
        ByteBpe(path)


def _vocabulary_and_merges():
    import json

    alphabet = _byte_alphabet()
    spec = json.load(open(default_path(), encoding="utf-8"))["model"]
    to_bytes = lambda t: bytes(alphabet[c] for c in t)
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["merges"]]
    return {to_bytes(t): i for t, i in spec["vocab"].items() if all(c in alphabet for c in t)}, [tuple(map(to_bytes, m)) for m in merges]


def test_forced_cuts_are_certain():
    bpe = ByteBpe(default_path())
    ends = bpe.token_ends
    starts = np.concatenate([[0], ends[:-1]])
    inner = np.ones(len(bpe.token_bytes), bool)
    inner[starts[starts < len(inner)]] = False
    k = np.flatnonzero(inner)
    ordinary = k[k < starts[50256]]
    assert not bpe.forced[bpe.token_bytes[ordinary - 1], bpe.token_bytes[ordinary]].any()


def test_bpe_frames(docs, none):
    out = bpe_decode(bpe_encode(docs)).collect()
    want = Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert Counter((r.doc_id, r.decoded) for r in out) == want
    assert bpe_decode(bpe_encode(none)).count() == 0


def test_pseudo_likelihood(docs, none):
    rows = pseudo_likelihood.pseudo_likelihood(docs, rounds=1).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_tokens == 0) == (r.mean_log_likelihood is None)
        assert r.log_likelihood <= 0
    assert pseudo_likelihood.pseudo_likelihood(none).count() == 0


def test_pseudo_likelihood_gradients():
    rng = np.random.default_rng(0)
    net = {k: v.astype(float) for k, v in pseudo_likelihood.start(rng.random(pseudo_likelihood.CLASSES)).items()}
    context, classes = rng.integers(0, pseudo_likelihood.CLASSES + 1, (4, 30)), rng.integers(0, pseudo_likelihood.CLASSES, 30)
    _, grads = pseudo_likelihood.forward(net, context, classes, learn=True)
    for name, at in (("bias", (3,)), ("groups", (2, 5)), ("member_bias", (int(classes[0] % 32), 4)), ("tables", (1, int(context[1][0]), 7))):
        sums = []
        for step in (1e-5, -1e-5):
            net[name][at] += step
            sums.append(pseudo_likelihood.forward(net, context, classes).sum())
            net[name][at] -= step
        assert abs((sums[0] - sums[1]) / 2e-5 - grads[name][at]) < 1e-5


def test_pseudo_likelihood_learns_order(spark):
    rng = random.Random(4)
    chain = [f"w{k}" for k in range(40)]
    ordered = [" ".join(chain[(s + k) % 40] for k in range(60)) for s in rng.choices(range(40), k=1500)]
    shuffled = [" ".join(rng.sample(chain, 40)) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(ordered + shuffled)]
    out = pseudo_likelihood.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string")).groupBy((F.col("doc_id") >= 1500).alias("shuffled")).agg(F.avg("mean_log_likelihood").alias("m")).collect()
    means = {r.shuffled: r.m for r in out}
    assert means[False] > means[True] + 0.5


def test_pseudo_likelihood_counts_every_word(spark):
    by_class = {}
    for k in range(3000):
        word = f"rare{k}"
        for _, _, data, offs in slices(pa.array([word])):
            by_class.setdefault(int(Words(data, offs, lower=True).hashes()[0] % 256), []).append(word)
    common, seldom = next(v for v in by_class.values() if len(v) > 1)[:2]
    texts = [" ".join(f"often{k}" for k in range(900))] * 30 + [f"{common} often1"] * 6 + [common, seldom, f"{common} {seldom}"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(38, f"{common} {seldom}")]
    out = pseudo_likelihood.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in out) == sorted(k for k, _ in rows)
    score = {r.doc_id: r.log_likelihood for r in out}
    assert abs(score[36] - score[37] - np.log(9 / 3)) < 1e-4


def test_pseudo_likelihood_grows():
    assert [pseudo_likelihood.class_count(n) for n in (0, 10**6, 10**8, 10**10)] == [1024, 1024, 2048, 16384]
    for classes in (1024, 2048, 16384):
        shapes = pseudo_likelihood.shapes(classes)
        assert shapes["member_bias"][0] * shapes["member_bias"][1] == classes


def test_kernel_words():
    texts = ["a  b\tc", None, "", " lead", "é x y", "tail "]
    for _, _, data, offs in slices(pa.array(texts)):
        w = Words(data, offs)
        got = [[bytes(data[s:e]).decode() for s, e, k in zip(w.starts, w.ends, w.doc) if k == d] for d in range(len(texts))]
        assert got == [WORD.findall(t or "") for t in texts]
        assert len(set(w.hashes().tolist())) == len({x for g in got for x in g})


def test_digest_columns(spark):
    from tokenizers import Tokenizer

    from corpuslab.llm import queries

    d, reference = "/root/testdata/sf0.001", Tokenizer.from_file(default_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in queries.QUERIES["op9_bpe_round_trip"](spark, d).collect():
        ids = reference.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_against_sql(spark):
    import os

    import duckdb

    from corpuslab.llm import queries

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in os.listdir(d):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{d}/{name}'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, d).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
        assert [x.replace(".0", "") for x in rows(got)] == [x.replace(".0", "") for x in rows(want)], name


def test_quality_scores_by_hand(spark):
    """The score of each text from its own features and the fitted weights, one text at a time."""
    docs, labels = labelled(spark, "quality", 200)
    model = quality.quality_model(docs, labels)
    got = quality.quality_scores(docs, labels, model=model).filter("doc_id is not null and doc_id <> 3").collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        words = WORD.findall(texts[r.doc_id])
        if not words:
            continue
        n, solid, low = len(words), sum(map(len, words)), texts[r.doc_id]
        counts = Counter(words)
        triples = Counter(zip(words, words[1:], words[2:]))
        marked = lambda chars: sum(c in chars for c in low)
        symbols = "#*$%&|<>@^~_=+\\{}[]/"
        values = {
            "log_words": np.log1p(n), "symbol_share": marked(symbols) / solid, "upper_share": sum("A" <= c <= "Z" for c in low) / solid, "digit_share": sum("0" <= c <= "9" for c in low) / solid,
            "type_token": len(counts) / n, "echo_share": sum(a == b for a, b in zip(words, words[1:])) / n, "odd_words": sum(any(c in symbols for c in w) for w in words) / n,
            "mean_length": solid / n, "long_words": sum(len(w) > 15 for w in words) / n, "punctuation": marked(".,;:?!") / n, "non_ascii": 0.0, "breaks": low.count("\n") / n,
            "bangs": low.count("!") / n, "short_words": sum(len(w) <= 3 for w in words) / n, "same_trigrams": sum(c - 1 for c in triples.values()) / n, "top_word": max(counts.values()) / n,
            "sentence_words": np.log1p(n / (sum(w[-1] in ".!?" for w in words) + 1)), "lone_symbols": sum(not any(c.isalnum() for c in w) for w in words) / n,
        }
        z = np.clip((np.array([values[f] for f in quality.FEATURES]) - model["mean"]) / model["scale"], -6, 6) * (n + 0.5) / (n + 10)
        strength = np.concatenate([z, z * z / 6]) @ model["weights"] - model["cut"]
        assert abs(r.score - 1 / (1 + np.exp(-strength))) < 1e-9


def test_toxicity_scores_by_hand(spark):
    """Marginals by plain forward and backward sums, one sentence at a time."""
    docs, labels = labelled(spark, "toxic", 200)
    model = toxicity.toxicity_model(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels, model=model).filter("doc_id <> 3").collect()}
    for r in docs.filter("doc_id % 7 = 0").collect():
        evidence = 0.0
        for _, _, data, offs in slices(pa.array([r.text])):
            t = toxicity.Tokens(data, offs)
            score = toxicity._score(t, model)
            begins = [*np.flatnonzero(t.restart), len(score)]
            for b, e in zip(begins, begins[1:]):
                weight = lambda k, y: np.exp(score[k] * y)  # noqa: E731, B023
                ahead = [[np.exp(model["first"][y]) * weight(b, y) for y in (0, 1)]]
                for k in range(b + 1, e):
                    ahead.append([weight(k, y) * sum(ahead[-1][x] * np.exp(model["trans"][x, y]) for x in (0, 1)) for y in (0, 1)])
                back = [[1.0, 1.0]]
                for k in range(e - 1, b, -1):
                    back.insert(0, [sum(np.exp(model["trans"][x, y]) * weight(k, y) * back[0][y] for y in (0, 1)) for x in (0, 1)])
                for f, g in zip(ahead, back):
                    evidence += (f[1] * g[1] / (f[0] * g[0] + f[1] * g[1])) ** 2
        x = model["slope"] * np.log(evidence + 1e-3) + model["offset"]
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-x))) < 1e-6


def test_classifiers_bear_any_columns(spark):
    docs, labels = labelled(spark, "toxic", 120)
    names = ["score", "predicted", "held_out", "spans", "__text", "__id", "__score", "__c2", "y", "x", "document"]
    wide = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    for run in (quality.quality_scores, toxicity.toxicity_scores):
        plain = Counter((r.doc_id, r.score) for r in run(docs, labels).collect())
        out = run(wide, labels, whole_rows=True)
        assert out.select("document.*").columns == wide.columns
        assert Counter((r.document.doc_id, r.score) for r in out.collect()) == plain
        assert all([r.document[c] for c in names] == list(range(len(names))) for r in out.collect())
        assert Counter((r.doc_id, r.score) for r in run(wide, labels).collect()) == plain


def test_copies_of_an_id_crowd_out_no_other(spark):
    docs, labels = labelled(spark, "toxic", 60)
    many = docs.unionByName(docs.filter("doc_id = 1").select("doc_id", F.concat("text", F.lit(" x")).alias("text"), F.explode(F.sequence(F.lit(0), F.lit(3000)))).drop("col"))
    for run in (quality.quality_scores, toxicity.toxicity_scores):
        assert {r.doc_id: r.score for r in run(many, labels).filter("doc_id > 3").collect()} == {r.doc_id: r.score for r in run(docs, labels).filter("doc_id > 3").collect()}


def test_pseudo_likelihood_by_hand(spark):
    """Each word's chance by the network written out, for one text, and better than a unigram model's."""
    rng = random.Random(6)
    chain = [f"w{k}" for k in range(30)]
    texts = [" ".join(chain[(s + k) % 30] for k in range(50)) for s in rng.choices(range(30), k=800)] + ["w1 unseen w2 w3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    counted, vocabulary, net, counts = pseudo_likelihood.fit_network(docs)
    words = Counter(w for t in texts for w in t.split())
    scores = {r.id: r.log_likelihood for r in pseudo_likelihood.pseudo_likelihood(docs, "id").collect()}
    unigram = sum(n * np.log(n / sum(words.values())) for n in words.values())
    assert sum(scores.values()) > unigram * 0.8
    hashed = lambda w: next(Words(data, offs, lower=True).hashes() for _, _, data, offs in slices(pa.array([w])))
    groups, border = net["groups"].shape[1], vocabulary.size
    for k in (0, len(texts) - 1):
        own = [int(vocabulary.classes(hashed(w))[0]) for w in texts[k].split()]
        total = 0.0
        for i, (c, w) in enumerate(zip(own, texts[k].split())):
            near = [own[i + s] if 0 <= i + s < len(own) else border for s in (-2, -1, 1, 2)]
            h = np.tanh(sum(net["tables"][p][x] for p, x in enumerate(near)) + net["bias"])
            for logits, at in ((h @ net["groups"] + net["group_bias"], c % groups), (h @ net["members"][c % groups] + net["member_bias"][c % groups], c // groups)):
                total += float(logits[at] - np.log(np.exp(logits).sum()))
            if c >= vocabulary.size - vocabulary.rare:
                total += np.log(words[w] / counts[c])
        assert abs(total - scores[k]) < 1e-3 * len(own)


def test_pipeline_stages_bear_odd_rows(spark, none):
    """Every row of a stage's input is accounted for: nulls, copies, long texts, clashing columns, no rows."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    names = ["score", "predicted", "held_out", "spans", "__text", "__id", "group", "n_words", "node", "no_id", "row_id", "text_hash", "id", "key", "part", "length"]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in odd_documents()], "doc_id long, text string")
    docs = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names))).repartition(3).cache()
    every = Counter(docs.select("doc_id", "text").collect())
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = Counter(map(tuple, out.select("doc_id", "text").collect()))
        assert not rows - Counter(map(tuple, every.elements())), name
        assert out.filter(" or ".join(f"`{c}` <> {k}" for k, c in enumerate(names))).count() == 0
        if name == "n-gram Jaccard join":
            sets = {t: shingle_set(t, 5) for _, t, *_ in odd_documents()}
            kept = [sets[t] for _, t in rows.elements() if sets[t]]
            near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
            assert all(any(near(s, k) for k in kept) or any(near(s, o) and any(near(o, k) for k in kept) for o in sets.values() if o) for s in sets.values() if s)
            assert sum(not sets[t] for _, t in rows.elements()) == sum(not sets[t] for _, t, *_ in odd_documents())
        assert stage(spark, docs.limit(0), folder).count() == 0
    packed = corpus_pipeline.packing_stage(spark, docs, folder)
    assert packed.filter("piece = 0").count() == docs.count()
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), folder).count() == 0


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name == corpus_pipeline.STAGES[-1][0]:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
            break
        assert out.columns == docs.columns
        now = {r.doc_id for r in out.collect()}
        assert now < before or name == "toxicity" and now <= before
        docs, before = out.cache(), now


def test_jaccard_stage_loses_no_unique_text(spark):
    import corpus_pipeline

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = text(0) + " end"
    rows = [(1, text(0)), (5, near), (5, text(1)), (6, text(2)), (6, text(3)), (7, text(4)), (7, text(4))]
    rows += [(None, text(5)), (None, near), (None, text(6)), (None, text(6)), (None, ""), (None, None), (8, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, corpus_pipeline.jaccard_stage(spark, docs, "").collect()))
    want = [(1, text(0)), (5, text(1)), (6, text(2)), (6, text(3)), (7, text(4)), (None, text(5)), (None, text(6)), (None, ""), (None, None), (8, " ")]
    assert got == Counter(want)
