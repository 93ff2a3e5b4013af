"""Known answers for the text, number, alignment and disfluency functions."""

import itertools
import random

import numpy as np
import pytest

from corpuslab.functions.alignment import alignment, content_metrics, distances, repetition
from corpuslab.functions.disfluency import clean, clean_pieces, density, finished, lowered, scan
from corpuslab.functions.numbers import cardinal, spoken
from corpuslab.functions.roots import prepare, prepared_roots
from corpuslab.functions.text import _english, _lenient, _strict, chunks

W = "one two three four five six seven eight nine ten".split()


def test_truncated_hypothesis():
    m = content_metrics(W, W[:6])
    assert (m["wer"], m["coverage"], m["end_coverage"], m["tail_deletion"], m["longest_deletion_run"]) == (0.4, 0.6, 0.6, 1.0, 4)
    assert m["wer_covered"] == 0.0


def test_repeated_phrase():
    phrase = "a b c d e f".split()
    m = content_metrics(phrase, phrase * 5)
    assert (m["wer"], m["insertions"], m["max_run"]) == (4.0, 24, 5)


def test_empty_sides():
    assert content_metrics([], [])["wer"] == 0.0
    assert content_metrics([], ["x"])["wer"] == float("inf")
    m = content_metrics(W, [])
    assert (m["wer"], m["end_coverage"], m["wer_covered"]) == (1.0, 0.0, None)


def test_source_repetition_is_paid_for():
    text = "x y z x y z".split()
    rate, run, _ = repetition(text, text)
    assert rate == 0.0 and run == 1
    assert repetition(text, text + text)[1] == 3


def test_single_coincidence_does_not_move_the_robust_end():
    m = content_metrics(W, [*W[:3], W[8]])
    assert m["end_coverage"] > 0.3 and m["robust_end_coverage"] == 0.3


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_is_minimal_and_tiles_both_sides():
    rng = random.Random(0)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 9)) for _ in range(2))
        ops = alignment(a, b)
        assert distances(a, b)[-1, -1] == edit_distance(a, b)
        assert sum(max(o["ref_end"] - o["ref_start"], o["hyp_end"] - o["hyp_start"]) for o in ops if o["op"] != "equal") == edit_distance(a, b)
        at = [0, 0]
        for o in ops:
            assert [o["ref_start"], o["hyp_start"]] == at
            at = [o["ref_end"], o["hyp_end"]]
        assert at == [len(a), len(b)]
        m = content_metrics(a, b)
        assert m["covered_errors"] <= m["substitutions"] + m["deletions"] + m["insertions"]
        assert m["hits"] + m["substitutions"] + m["deletions"] == len(a)


@pytest.mark.parametrize(
    "value,words",
    [(0, "ноль"), (21, "двадцать один"), (1990, "одна тысяча девятьсот девяносто"), (2000, "две тысячи"), (11_000, "одиннадцать тысяч"), (1_000_000, "один миллион"), (3_000_001, "три миллиона один"), (5_000_000_000, "пять миллиардов"), (112, "сто двенадцать"), (-7, "минус семь")],
)
def test_cardinals(value, words):
    assert cardinal(value) == words


def test_cardinals_are_distinct():
    names = [cardinal(n) for n in itertools.chain(range(3000), (10**k for k in range(4, 24)))]
    assert len(set(names)) == len(names)


def test_digit_runs():
    assert spoken("007") == "ноль ноль семь"
    assert spoken("000") == "ноль"
    assert spoken("1" * 25) == " ".join(["один"] * 25)


def test_normalisers():
    assert _strict("Ёлка — «Ж», №5 ½ x") == "елка ж no5 1 2 x"
    assert _lenient("дом 21, кв. 007") == "дом двадцать один кв ноль ноль семь"
    assert _english("Don’t fold Adèle’s café!") == "dont fold adeles cafe"
    assert (_strict(None), _lenient(""), _english(None)) == ("", "", "")
    for text in ("Ёлка 5", "a-b_c", "  x\t"):
        assert _strict(_strict(text)) == _strict(text)


def test_byte_chunks():
    text = "One, two; three. " * 30
    pieces = chunks(text)
    assert all(len(p.encode()) <= 136 for p in pieces)
    assert " ".join(pieces).split() == text.split()
    assert chunks("x" * 500) == ["x" * 500] and chunks("") == [] and chunks(None) == []


@pytest.mark.parametrize(
    "text,kinds",
    [("э-э ну вот", ["hesitation", "discourse", "discourse"]), ("как бы да", ["multiword"]), ("вот почему", []), ("это значит много", []), ("прос простите", ["truncated"]), ("да да", ["repeat"]), ("очень очень", []), ("Ррусская", ["stutter"]), ("вверх", []), ("прос- простите", ["truncated"]), ("так такая", ["restart"])],
)
def test_disfluency_rules(text, kinds):
    assert [e.kind for e in scan(text)] == kinds


def test_cleaning_reaches_a_fixed_point():
    rng = random.Random(2)
    words = "ну вот как бы да да прос простите Ррусская э-э логика, так такая короче говоря дом. это".split()
    for _ in range(200):
        text = " ".join(rng.choices(words, k=12))
        once = clean(text)
        assert clean(once) == once and not scan(once)
        edits = scan(text)
        assert all(a.end <= b.start for a, b in itertools.pairwise(edits))
        assert all(text[e.start : e.end] == e.surface for e in edits)


def test_distance_table_shape():
    assert distances([], ["a"]).tolist() == [[0, 1]] and isinstance(distances(["a"], ["a"]), np.ndarray)


def test_window_agreement_of_whole_turns(spark, tmp_path):
    from corpuslab.plans.registry import QUERIES

    same = "word " * 100
    rows = [(1, 0, same + "a " * 100), (1, 1, same + "b " * 100), (2, 0, "Well-known, yes!"), (2, 1, "well known YES"), (3, 0, "..."), (3, 1, "one")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.median_ratio for r in QUERIES["m13_window_agreement"](spark, str(tmp_path)).collect()}
    assert got == {1: 0.5, 2: 1.0, 3: None}


def test_edit_expansion_and_joint_cleaning():
    assert clean("Ну, это дом. Угу. Дальше как бы лес.") == "Это дом. Дальше лес."
    pieces, edits = clean_pieces(["Вот как", "бы дом и прос", "простите"])
    assert pieces == [" ", " дом и ", "простите"] and [e.kind for e in edits] == ["multiword", "truncated", "discourse"]  # the first word goes once what follows it has gone
    assert density("ну дом, как бы лес") == (60.0, 3, 5)
    assert density("") == (0.0, 0, 0)
    assert lowered("Так, рак вы меня Видите? Видите Пушкин видите", {"видите", "рак"}) == ("Так, рак вы меня видите? Видите Пушкин видите", 1)
    assert finished("ага -- да...Нет ,, «что»") == "Ага — да. Нет, что"


def test_roots():
    groups = [(0.0, 4.0, "Привет всем"), (5.0, 9.0, "Ну, это Дом и дом"), (10.0, 14.0, "как бы Jazz лес"), (70.0, 75.0, "потом 5")]
    options = {"opening": "привет", "window": 20.0, "look": 30.0, "latest": 60.0, "table": {"jazz": "джаз"}, "forbid_digits": True, "forbid_latin": True}
    got = prepare(groups, **options)
    assert (got["reason"], got["first_group"], got["n_groups"], got["n_transliterated"], got["n_case"]) == ("", 1, 2, 1, 1)
    assert got["text"] == "Это дом и дом Джаз лес"
    assert prepare([], **options)["reason"] == "no_timestamps"
    assert prepare(groups[:1], **options)["reason"] == "no_clean_prefix_start"
    assert prepare(groups, **options | {"window": 100.0})["reason"] == "digits"
    assert prepare(groups, **options | {"table": {}})["reason"] == "unknown_latin"
    assert prepare(groups, **options | {"window": 1.0})["reason"] == "empty_selection_window"


def test_char_error_rate_of_any_letters(spark, tmp_path):
    from corpuslab.plans.registry import QUERIES

    rows = [(1, 0, "día"), (1, 1, "dia"), (1, 2, "日本語"), (2, 0, "Größe"), (2, 1, "große")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.cer for r in QUERIES["m4_char_error_rate"](spark, str(tmp_path)).collect()}
    want = {(c, t): round(edit_distance(list(h), list(r)) / len(r), 6) for (c, _, r), (_, t, h) in zip(rows, rows[1:]) if c == _}
    assert got == want


def test_stored_metrics_agree_with_their_recount(spark):
    from corpuslab.plans.registry import QUERIES

    rows = QUERIES["m12_recomputed_metrics"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.agrees for r in rows) and any(r.errors > 3 for r in rows)


def test_long_texts_take_linear_time():
    import time

    began, n = time.process_time(), 20_000
    text, count = lowered("Рак рак " * n, {"рак"})
    assert (text, count) == ("Рак рак " + "рак рак " * (n - 1), n - 1)
    pieces, edits = clean_pieces(["5 гм " * n])
    assert len(edits) == n and "гм" not in pieces[0]
    assert time.process_time() - began < 15  # a look back over all the text, for each word, was quadratic


def test_prepared_roots_rows(spark):
    rows = [(1, 5.0, 9.0, "Ну, это дом"), (1, 0.0, 4.0, "Привет"), (1, None, 4.0, "нет"), (1, float("nan"), 4.0, "нет"), (2, None, 1.0, "дом"), (3, 0.0, 4.0, None), (None, 0.0, 4.0, "дом")]
    out = prepared_roots(spark.createDataFrame(rows, "k int, start double, end double, text string"), "k", window=20.0, look=30.0, latest=60.0, opening="привет")
    got = {r.k: (r.reason, r.first_group, r.n_groups, r.text) for r in out.collect()}
    assert got == {1: ("", 1, 1, "Это дом"), 2: ("no_timestamps", None, None, None), 3: ("", 0, 1, ""), None: ("", 0, 1, "Дом")}
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()  # it handed over one key at a time


def test_rows_of_a_batch_are_turned_a_few_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from corpuslab.functions.alignment import word_alignment
    from corpuslab.functions.disfluency import disfluencies

    n = 3_000
    a, b = pa.array(["a b " * 20, None] * (n // 2)), pa.array(["a x " * 20] * n)
    text = pa.array(["ну " * 20, None, "дом"] * (n // 3))
    for of, columns, want in ((word_alignment.func, (a, b), [40, 1]), (disfluencies.func, (text,), [20, 0, 0])):
        tracemalloc.start()
        out = of(*columns)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [len(x) for x in out.to_pylist()] == want * (n // len(want))
        assert most < 4e6  # not the dictionaries of all rows at once
