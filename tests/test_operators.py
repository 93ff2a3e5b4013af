"""Invariants and edge cases of the engine's operators, on small frames."""

import gzip
import io
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import aggregates as A
from corpuslab.operators import paired, ranks, selection, sequences
from corpuslab.operators import statistics as S
from corpuslab.operators.clustering import average_linkage
from corpuslab.operators.content import excess_repetition, final_status, flow_status
from corpuslab.operators.funnel import require, violations
from corpuslab.operators.leakage import distinct_shingles, gram_sets, gram_table, max_jaccard, shared_grams, shingles
from corpuslab.sources import tables
from corpuslab.streaming.windows import run_to_end, sessions, state_folder, tumbling, with_event_time


def test_finite_mean_keeps_infinity_apart(spark):
    rows = [("a", 1.0), ("a", float("inf")), ("a", None), ("a", float("nan")), ("b", float("inf")), ("c", None)]
    out = {r.g: r for r in spark.createDataFrame(rows, "g string, x double").groupBy("g").agg(*A.finite_mean(F.col("x"), "m")).collect()}
    assert (out["a"].m, out["a"].m_n_finite, out["a"].m_n_inf, out["a"].m_n_missing) == (1.0, 1, 1, 2)
    assert out["b"].m == float("inf") and out["c"].m is None


def test_medians_differ_for_even_counts(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "x double")
    r = df.agg(A.upper_median(F.col("x")).alias("u"), F.median("x").alias("m"), A.order_statistic(F.col("x"), 0.9).alias("a"), A.order_statistic(F.col("x"), 0.9, True).alias("b")).first()
    assert tuple(r) == (3.0, 2.5, 3.0, 10.0)
    assert df.limit(0).agg(A.upper_median(F.col("x")).alias("u")).first().u is None


def test_compare_tables(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12), (3, 2.0)], "k int, v double")
    assert sorted(r.k for r in A.compare_tables(a, b, ["k"], ["v"]).collect()) == [2, 3]


def test_paired_join_refuses_mismatches(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (2, "q")], "k int, b string")
    assert paired.paired_join(a, b, ["k"]).count() == 2
    for bad in (b.filter("k = 1"), b.union(b.limit(1)), b.union(spark.createDataFrame([(3, "r")], "k int, b string"))):
        with pytest.raises(ValueError):
            paired.paired_join(a, bad, ["k"])


def test_violations_are_collected(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "k int, v int")
    broken = violations(df, F.col("k"), {"range": F.col("v") < 10, "given": F.col("v").isNotNull()})
    assert sorted((r.rule, r.key) for r in broken.collect()) == [("given", "2"), ("range", "2"), ("range", "3")]
    with pytest.raises(ValueError, match="range: 3"):
        require(broken, "test")
    require(broken.limit(0), "test")


def test_intervals_and_islands(spark):
    df = spark.createDataFrame([("a", 0.0, 2.0), ("a", 1.0, 1.5), ("a", 2.0, 3.0), ("a", 4.0, 5.0)], "g string, start double, end double")
    assert sorted((r.start, r.end) for r in sequences.merge_intervals(df, "g").collect()) == [(0.0, 3.0), (4.0, 5.0)]
    hits = spark.createDataFrame([("a", k, h) for k, h in enumerate([1, 1, 0, 1, None, 1, 1, 1])], "g string, k int, h int")
    assert sorted((r["first"], r["last"], r["length"]) for r in sequences.islands(hits, "g", "k", F.col("h") == 1).collect()) == [(0, 1, 2), (3, 3, 1), (5, 7, 3)]


@pytest.mark.parametrize("length,want", [(2.0, 0), (2.5, 1), (4.9, 1), (5.0, 2), (7.5, 3), (7.4, 2), (12.0, 4)])
def test_window_grid(spark, length, want):
    rows = spark.range(1).select(F.inline(sequences.window_grid(F.lit(length), 5.0, 2.5, 2.5))).collect()
    assert len(rows) == want and all(r.end <= length and r.end - r.start >= 2.5 for r in rows)


def test_slopes_and_ranks(spark):
    df = spark.createDataFrame([("a", float(k), 3.0 * k) for k in range(6)] + [("b", 1.0, 2.0), ("b", 1.0, 5.0)], "g string, x double, y double")
    slopes = {r.g: r.slope for r in sequences.theil_sen(df, "g", "x", "y").collect()}
    assert slopes == {"a": 3.0, "b": None}
    rho = {r.g: r.rho for r in sequences.spearman(df, "g", "x", "y").collect()}
    assert rho["a"] == pytest.approx(1.0) and rho["b"] is None


def greedy(rows, cap, budget):
    used, total, out = {}, 0, []
    for g, i, n in sorted(rows, key=lambda r: (-r[2], r[1])):
        if total >= budget:
            break
        if used.get(g, 0) + n <= cap:
            used[g] = used.get(g, 0) + n
            total += n
            out.append((g, i))
    return sorted(out)


def test_capped_greedy_equals_the_sequential_walk(spark):
    rng = random.Random(1)
    for _ in range(3):
        rows = [(rng.choice("abc"), i, rng.randint(1, 30)) for i in range(60)]
        df = spark.createDataFrame(rows, "g string, i long, n long")
        got = selection.capped_greedy(df, "g", -F.col("n"), F.col("i"), "n", 90.0, 200)
        assert sorted((r.g, r.i) for r in got.collect()) == greedy(rows, 90, 200)


def test_segments_tile_the_track():
    rng = random.Random(3)
    for _ in range(50):
        lines, at = [], 0.0
        for _ in range(rng.randint(1, 40)):
            end = at + rng.uniform(0.5, 8)
            lines.append((at, end))
            at = end
        cuts = selection.segment(lines, 10, 30, 20)
        assert [c[0] for c in cuts] == [0, *[c[1] for c in cuts[:-1]]] and cuts[-1][1] == len(lines)
        for b, e in cuts[:-1]:
            assert lines[e - 1][1] - lines[b][0] >= 10 or len(cuts) == 1
    assert selection.segment([], 10, 30, 20) == []


def test_token_batches():
    batches = selection.token_batches([5, 5, 20, 1, 1, 1], 10, 12)
    assert batches == [0, 0, 1, 2, 2, 2]
    assert selection.token_batches([], 10, 10) == []


def test_nested_cuts():
    import numpy as np

    ends = np.array([10, 20, 30])
    assert selection.nested_cuts(ends, [12, 11, 50, 60]) == [0, 1, 2, None]
    assert selection.nested_cuts(ends, [30, 40, 50], skip_empty=True) == [2, None, None]


def test_split_search():
    profiles = [{"name": n, "size": s, "clusters": c} for n, s, c in (("a", 5, ["x"]), ("b", 5, ["x"]), ("c", 6, ["y"]), ("d", 50, ["z"]))]
    assert selection.best_disjoint_pair(profiles, 5, 7, 2) == (("a",), ("c",))
    assert selection.best_disjoint_pair(profiles[:2], 5, 7, 2) is None


def test_pattern_mix_restarts(spark):
    df = spark.createDataFrame([("S", 1), ("S", 2), ("L", 9)], "kind string, i long")
    out = selection.pattern_mix(df, "kind", "i", ["S", "S", "S", "L"], 8).orderBy("slot").collect()
    assert [(r.source, r["item"]) for r in out] == [("S", 1), ("S", 2), ("S", 1), ("L", 9), ("S", 2), ("S", 1), ("S", 2), ("L", 9)]


def test_constant_effect_has_no_width(spark):
    df = spark.createDataFrame([(k % 5, 2.0) for k in range(40)], "c int, v double")
    means = S.bootstrap_means(S.cluster_sums(df, "c", F.col("v")), S.draws(spark, 50, 5, 1))
    r = S.interval(means).first()
    assert (r.lo, r.hi, r.degenerate, r.n_valid, r.n_empty) == (2.0, 2.0, True, 50, 0)
    assert S.two_sided_p(means).first().p == pytest.approx(1 / 50)


def test_bootstrap_does_not_depend_on_order(spark):
    df = spark.createDataFrame([(k % 7, float(k * k % 13)) for k in range(100)], "c int, v double")
    runs = [sorted(map(tuple, S.bootstrap_means(S.cluster_sums(x, "c", F.col("v")), S.draws(spark, 30, 7, 5)).collect())) for x in (df, df.orderBy(F.rand(1)).repartition(3))]
    assert all(a[0] == b[0] and a[1] == pytest.approx(b[1]) for a, b in zip(*runs))


def test_least_squares(spark):
    df = spark.createDataFrame([(k % 3, float(k), 2.0 + 3.0 * k) for k in range(10)], "c int, x double, y double")
    sums = S.normal_sums(df, "c", [F.col("x")], F.col("y"))
    w = sums.agg(S.add_arrays("xx", 3).alias("xx"), S.add_arrays("xy", 2).alias("xy")).select(S.solved("xx", "xy").alias("w")).first().w
    assert w == pytest.approx([2.0, 3.0])


def test_average_linkage(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("d", [-1.0, 0.0])]
    out = {r.k: r.cluster for r in average_linkage(spark.createDataFrame(rows, "k string, v array<double>"), "k", "v", 0.5).collect()}
    assert out == {"a": 0, "b": 0, "c": 1, "d": 2}


def test_short_and_empty_texts_in_leakage(spark):
    items = spark.createDataFrame([(1, "a b"), (2, ""), (3, "x y z w")], "item_id int, text string")
    docs = spark.createDataFrame([(7, "a b"), (8, "x y z w v"), (9, "")], "doc_id int, text string")
    tokens = F.filter(F.split("text", " "), lambda w: w != "")
    found = shared_grams(gram_table(items, "item_id", tokens, 3), gram_sets(docs, "doc_id", tokens, 3), "item_id", "doc_id")
    out = {r.item_id: (round(r.jaccard, 4), r.nearest) for r in max_jaccard(items, found, "item_id", "doc_id").collect()}
    assert out == {1: (1.0, [7]), 2: (0.0, None), 3: (0.6667, [8])}


@pytest.mark.parametrize("args,want", [(("oom", "x", True, None, None, False, None, None), "oom"), (("complete", "eos", False, None, None, False, None, None), "invalid_audio"), (("complete", "eos", True, 0.94, 0.0, True, 0.0, 1), "early_eos"), (("complete", "eos", True, 0.95, 0.30, True, 0.0, 1), "degraded"), (("complete", "eos", True, 0.95, 0.30, False, 0.0, 1), "complete"), (("complete", "eos", True, 1.0, None, True, 0.2, 1), "degraded"), (("complete", "eos", True, 1.0, None, True, 0.0, 3), "degraded")])
def test_status_table(spark, args, want):
    kinds = ("string", "string", "boolean", "double", "double", "boolean", "double", "int")
    assert spark.range(1).select(final_status(*(F.lit(a).cast(k) for a, k in zip(args, kinds))).alias("s")).first().s == want


def test_contradicting_status_is_an_error(spark):
    lit = lambda v, k: F.lit(v).cast(k)
    status = final_status(lit("complete", "string"), lit("cap", "string"), lit(True, "boolean"), lit(1.0, "double"), lit(None, "double"), lit(False, "boolean"), lit(0.0, "double"), lit(1, "int"))
    with pytest.raises(Exception, match="ended by itself"):
        spark.range(1).select(status).collect()
    assert spark.range(1).select(flow_status(F.lit("flow"), F.lit("early_eos")).alias("s")).first().s == "incomplete_text"


def test_key_value_files(spark, tmp_path):
    (tmp_path / "m").write_text("a one two\nb\n\nc x\n")
    assert {r.key: r.value for r in tables.read_key_values(spark, str(tmp_path / "m")).collect()} == {"a": "one two", "b": "", "c": "x"}
    (tmp_path / "d").write_text("a 1\na 2\n")
    assert tables.read_key_values(spark, str(tmp_path / "d"), strict=False).first().value == "2"
    with pytest.raises(Exception, match="key given twice"):
        tables.read_key_values(spark, str(tmp_path / "d")).collect()
    df = spark.createDataFrame([("u2", "s"), ("u1", "s")], "utt string, spk string")
    tables.write_key_values(df, "utt", {"utt2spk": "spk"}, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out/utt2spk")).collect()] == ["u1 s", "u2 s"]
    assert tables.inverse_map(df, "utt", "spk").first()["keys"] == "u1 u2"


def test_json_lines(spark, tmp_path):
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in tables.read_jsonl(spark, str(tmp_path / "x.jsonl.gz"), "a int").collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{oops\n')
    with pytest.raises(Exception):
        tables.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    kept = tables.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int", strict=False).collect()
    assert [r._bad for r in kept if r._bad] == ["{oops"]
    tables.write_sorted_jsonl(spark.range(50), "id", str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 50


def test_conflicting_dimension(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "v", "channel": "x"}')
    (tmp_path / "b.json").write_text('{"id": "v", "channel": "x"}')
    assert tables.dimension(spark, str(tmp_path / "*.json"), "id string, channel string", "id", "channel").first().channel == "x"
    (tmp_path / "c.json").write_text('{"id": "v", "channel": "y"}')
    with pytest.raises(Exception, match="conflicting labels"):
        tables.dimension(spark, str(tmp_path / "*.json"), "id string, channel string", "id", "channel").collect()


def test_word_tracks(spark):
    df = spark.createDataFrame([("0\t1\t a \n1\tx\tb\n1\t2\t \n3",), (None,)], "t string")
    loose = df.select(tables.word_track(F.col("t")).alias("w")).collect()
    assert [[(r.start, r.end, r.text) for r in x.w] for x in loose] == [[(0.0, 1.0, "a")], []]
    kept = df.select(tables.word_track(F.col("t"), keep_blank=True, strip=False).alias("w")).first().w
    assert [r.text for r in kept] == [" a ", " "]
    with pytest.raises(Exception):
        df.select(tables.word_track(F.col("t"), strict=True)).collect()


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "s.tar", "w") as tar:
        for name, data in (("a.txt", b"alpha"), ("b.txt", b"beta")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    members = tables.tar_members(spark, str(tmp_path / "s.tar"))
    rows = {r.member: bytes(r.content) for r in members.collect()}
    assert rows == {"a.txt": b"alpha", "b.txt": b"beta"}
    expected = members.select("member", "sha256").union(spark.createDataFrame([("c.txt", "00")], "member string, sha256 string"))
    assert [r.member for r in tables.unverified(members, expected).collect()] == ["c.txt"]


def test_stable_reads(spark, tmp_path):
    (tmp_path / "f").write_text("x")
    assert tables.stable(spark, str(tmp_path / "f"), lambda: 5) == 5
    with pytest.raises(RuntimeError):
        tables.stable(spark, str(tmp_path / "f"), lambda: (tmp_path / "f").write_text("longer"))


def test_markdown(spark):
    assert tables.markdown(spark.createDataFrame([(1, 0.5, None)], "a int, b double, c string")) == "| a | b | c |\n| --- | --- | --- |\n| 1 | 0.5000 |  |"
    with pytest.raises(ValueError):
        tables.markdown(spark.range(10), limit=5)


def test_streams_agree_with_batch(spark, tmp_path):
    events = spark.range(200).selectExpr("id", "timestamp_seconds(id * 600) as ts", "cast(id as double) as value", "id % 3 as user_id")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = with_event_time(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), delay="1 minute")
    batch = {(r.start, r.n) for r in tumbling(events, "ts", "1 hour").collect()}
    folder = state_folder(spark, "test")
    got = {(r.start, r.n) for r in run_to_end(tumbling(stream, "ts", "1 hour"), folder).collect()}
    assert got <= batch and len(batch) - len(got) <= 2
    assert {(r.start, r.n) for r in run_to_end(tumbling(stream, "ts", "1 hour"), folder).collect()} >= got
    assert sessions(events, "user_id", "ts", "10 minutes").count() == 200


def test_median_slope_of_many_pairs():
    rng = np.random.default_rng(4)
    for n in (2, 3, 7, 40, 41):
        for spread_out in (3, 1000):
            x, y = np.sort(rng.integers(0, n, n)).astype(float), rng.integers(-spread_out, spread_out, n).astype(float)
            slopes = [(y[j] - y[i]) / (x[j] - x[i]) for i in range(n) for j in range(i + 1, n) if x[j] != x[i]]
            for hold in (5, 1 << 20):
                got = sequences.median_slope(x, y, hold)
                assert got is None if not slopes else abs(got - np.median(slopes)) < 1e-12


def test_numbers_and_running_sums(spark):
    rows = [(k * 7 % 500, k % 5 + 1) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = sorted((r.k, r.n, r.s) for r in ranks.running_sum(ranks.numbered(df, F.col("k"), "n"), F.col("k"), F.col("v"), "s").collect())
    done = 0
    for n, ((k, v), (key, place, before)) in enumerate(zip(sorted(rows), got)):
        assert (key, place, before) == (k, n, done)
        done += v
    assert ranks.numbered(df.limit(0), F.col("k"), "n").count() == 0
    assert sorted(r.n for r in ranks.numbered(df, -F.col("k"), "n").collect()) == list(range(500))


def test_excess_repetition_brings_no_grams_together(spark):
    rows = [(1, 1, "a b c", "a b c a b c a b c"), (1, 1, "a b c\ta b c", "x"), (1, 2, None, "a b c a b c"), (2, 1, "a", "a b"), (None, 1, "a b c a b c", "a b c a b c")]
    out = excess_repetition(spark.createDataFrame(rows, "k int, t int, r string, h string"), ["k", "t"], "r", "h")
    got = {(r.k, r.t): r.excess_repetition for r in out.collect()}
    # (1, 1): "a b c" is there three times, and three times in both references; twice or once more with other n-grams
    three, four, five, six = (2 - 2 + 1 - 0 + 1 - 0) / 7, (1 + 1 + 1) / 6, (1 + 1) / 5, 1 / 4
    assert got == {(1, 1): pytest.approx((three + four + five + six) / 6), (1, 2): pytest.approx(1 / 16), (None, 1): pytest.approx(1 / 16)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # neither side's n-grams go to a join or the driver


def test_shingles_of_many_texts_at_once(spark, monkeypatch):
    random.seed(5)
    texts = [[random.choice("abc") for _ in range(random.choice([0, 1, 2, 3, 4, 30]))] for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(200, None)], "i int, t array<string>")
    got = {r.i: r.g for r in df.select("i", shingles(F.col("t"), 3).alias("g")).collect()}
    want = [{tuple(t[k : k + 3]) for k in range(max(1, len(t) - 2))} - {()} for t in texts] + [set()]
    assert [len(got[i]) for i in range(201)] == [len(x) for x in want]
    named = {(g, tuple(sorted(got[i]))) for i, g in enumerate(map(frozenset, want))}
    assert len(named) == len({g for g, _ in named}) == len({h for _, h in named})  # equal sets, equal hashes
    words, counts = distinct_shingles(np.zeros(0, np.uint64), np.zeros(3, np.int64), 8)
    assert len(words) == 0 and counts.tolist() == [0, 0, 0]


def test_shingle_counts_are_made_once(spark):
    from corpuslab.plans.registry import QUERIES

    plan = QUERIES["l1_shingle_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("xxhash64(") == 1  # they were also made below the exchange, for a filter, and word hashes anew for each place


def test_voiced_windows_sort_a_group_once(spark):
    random.seed(3)
    spans = [(g, s := random.uniform(0, 900), s + random.uniform(0, 40)) for g in range(6) for _ in range(40)] + [(9, 0.0, 50.0), (9, 5.0, None), (9, None, 7.0), (9, 60.0, 110.0), (None, 0.0, 500.0), (7, 0.0, 99.0)]
    out = sequences.voiced_windows(spark.createDataFrame(spans, "g int, start double, end double"), "g", "start", "end", 100.0, 50.0, 20.0)
    want = {}
    for g in (0, 1, 2, 3, 4, 5, 9):
        merged = []
        for s, e in sorted((s, e) for h, s, e in spans if h == g and s is not None and e is not None):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        offs = np.concatenate([[0.0], np.cumsum([e - s for s, e in merged])])
        last = int((offs[-1] - 100) // 50)
        for p in [50.0 * k for k in range(last + 1)] + [offs[-1] - 100] * bool(offs[-1] - (last * 50 + 100) > 20):
            a, b = np.searchsorted(offs[1:-1], p, "right"), np.searchsorted(offs[1:-1], p + 100, "left")
            want[g, round(p, 6)] = (round(merged[a][0] + p - offs[a], 6), round(merged[b][0] + p + 100 - offs[b], 6))
    assert {(r.g, round(r.voiced_start, 6)): (round(r.start, 6), round(r.end, 6)) for r in out.collect()} == want
    assert want[9, 0.0] == (0.0, 110.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Sort [") == 1 and "Union" not in plan  # a task held its rows once for each of four sorts
