import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrybed.operators import evidence as E
from quarrybed.operators import features as T
from quarrybed.operators import graph as G
from quarrybed.operators import matching as M
from quarrybed.operators import ordered as O
from quarrybed.operators import segmentation as S


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_two_level_operators_equal_plain_windows(spark):
    rng = random.Random(3)
    data = [(i, rng.choice(["a", "b"]), rng.choice([None, i]), rng.randrange(-3, 4)) for i in range(200)]
    df = spark.createDataFrame(data, "pos bigint, k string, v bigint, d bigint")
    got = {r.pos: (r.o, r.s) for r in O.two_level_sum(O.two_level_last(df, "v", ["pos"], F.floor(F.col("pos") / 7), "o", ("k",)), "d", ["pos"], F.floor(F.col("pos") / 11), "s").collect()}
    last, total = {}, 0
    for p, k, v, d in data:
        last[k] = v if v is not None else last.get(k)
        total += d
        assert got[p] == (last.get(k), total)


def test_owner_span_gaps_and_contiguity(spark):
    s = spark.createDataFrame([(10, "f"), (20, "g")], "pos bigint, name string")
    p = spark.createDataFrame([(5, 1), (10, 2), (19, 3), (500, 4)], "pos bigint, id int")
    got = O.owner_asof(s, p, pos="pos", owner="name", bucket=F.floor(F.col("pos") / 8))
    assert [(r.id, r.owner, r.owner_start) for r in got.orderBy("id").collect()] == [(1, None, None), (2, "f", 10), (3, "f", 10), (4, "g", 20)]
    i = spark.createDataFrame([("x", 0, 5), ("x", 3, 9), ("x", 12, 15), ("x", 14, 20)], "k string, s int, e int")
    assert rows(O.gaps(i, F.col("s"), F.col("e"), ["k"]), "gap_start") == [("x", 9, 12)]
    assert rows(O.contiguity(i, "s", "e", ["k"]), "s") == [("x", 0, 3, -2), ("x", 3, 12, 3), ("x", 12, 14, -1)]


def test_reach_roots_and_descent(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("x", "y")], "src string, dst string")
    r = G.reach(e)
    assert rows(r, "node") == [("a", 4), ("b", 3), ("c", 3), ("x", 2)]
    assert rows(G.roots(e), "node") == [("a",), ("x",)]
    assert G.descend(e, r, "x") == "y"
    assert rows(G.inverted(e), "dst")[0] == ("b", 2, ["a", "c"])


def test_greedy_equals_scan_with_ties(spark):
    rng = random.Random(5)
    for _ in range(3):
        pairs = [(a, b, rng.randrange(4) / 4) for a in range(8) for b in range(7) if rng.random() < 0.7]
        got = {tuple(r) for r in M.greedy_assignment(spark.createDataFrame(pairs, "a int, b int, score double"), "a", "b").collect()}
        ua, ub, want = set(), set(), set()
        for s, a, b in sorted(((s, a, b) for a, b, s in pairs), reverse=True):
            if a not in ua and b not in ub:
                ua.add(a), ub.add(b), want.add((a, b, s))
        assert got == want


def naive_alignment(score, gap=-0.25, floor=0.25, below=-0.05):
    n, m = score.shape
    best = np.zeros((n + 1, m + 1))
    best[1:, 0], best[0, 1:] = gap * np.arange(1, n + 1), gap * np.arange(1, m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s = score[i - 1, j - 1] if score[i - 1, j - 1] >= floor else below
            best[i, j] = max(best[i - 1, j - 1] + s, best[i - 1, j] + gap, best[i, j - 1] + gap)
    return best[n, m]


def test_alignment_is_optimal_and_self_alignment_whole():
    rng = np.random.default_rng(1)
    for _ in range(20):
        score = np.round(rng.random((rng.integers(1, 12), rng.integers(1, 12))), 2)
        pairs = M.align_scores(score)
        assert all(a < b and c < d for (a, c), (b, d) in zip(pairs, pairs[1:]))
        use = np.where(score >= 0.25, score, -0.05)
        total = sum(use[i, j] for i, j in pairs) - 0.25 * (sum(score.shape) - 2 * len(pairs))
        assert total == pytest.approx(naive_alignment(score), abs=0.05 * 12)
    same = np.eye(9)
    assert M.align_scores(same) == [(i, i) for i in range(9)]


def test_feedback_rounds_stop_when_idle(spark):
    p = spark.createDataFrame([(1, 1, 0.9), (2, 2, 0.5)], "a int, b int, score double")
    got = M.rounds_of_matching(lambda mapping, w: p, "a", "b")
    assert sorted(r.a for r in got.collect()) == [1]
    got = M.rounds_of_matching(lambda mapping, w: p, "a", "b", stop_when_idle=False)
    assert sorted(r.a for r in got.collect()) == [1, 2]
    weights = []
    seed = spark.createDataFrame([(7, 7)], "a int, b int")
    got = M.rounds_of_matching(lambda mapping, w: weights.append(w) or p, "a", "b", seed=seed)
    assert sorted((r.a, r.score) for r in got.collect()) == [(1, 0.9), (7, 1.0)] and weights == [0.6, 1.2]
    assert M.round_settings(0, 0.45, False) == (0.81, 0.0) and M.round_settings(5, 0.45, False) == (0.45, 2.0)


def test_greedy_assignment_of_a_chain_ends_by_itself(spark):
    pairs = [(i // 2 + i % 2, i // 2, 1.0 - i / 100) for i in range(16)]
    got = {(r.a, r.b) for r in M.greedy_assignment(spark.createDataFrame(pairs, "a int, b int, score double"), "a", "b").collect()}
    ua, ub, want = set(), set(), set()
    for s, a, b in sorted(((s, a, b) for a, b, s in pairs), reverse=True):
        if a not in ua and b not in ub:
            ua.add(a), ub.add(b), want.add((a, b))
    assert got == want and len(got) == 8


def test_alignment_in_blocks_equals_the_whole_table():
    rng = np.random.default_rng(5)
    for n, m in ((1, 9), (9, 1), (25, 30), (70, 40)):
        score = np.round(rng.random((n, m)), 2)
        plain = M.Alignment(n, m, score.__getitem__)
        plain.step = n + 1
        assert M.align_scores(score) == plain.pairs()


def test_neighbours_and_order(spark):
    m = spark.createDataFrame([("f", "F"), ("g", "G")], "a string, b string")
    ea = spark.createDataFrame([("h", "f"), ("h", "g")], "src string, dst string")
    eb = spark.createDataFrame([("H", "F"), ("K", "Z")], "src string, dst string")
    p = spark.createDataFrame([("h", "H"), ("h", "K"), ("q", "H")], "a string, b string")
    # q has no mapped callee while H has callees: 0; f is called by none that is mapped, nor is Z by any but K
    assert rows(M.neighbour_score(m, ea, eb, p, "a", "b"), "a", "b") == [("h", "H", 0.5), ("h", "K", 0.0), ("q", "H", 0.0)]
    both = spark.createDataFrame([("h", "H"), ("f", "F")], "a string, b string")
    ea = spark.createDataFrame([("h", "f"), ("k", "h")], "src string, dst string")
    eb = spark.createDataFrame([("H", "F")], "src string, dst string")
    q = spark.createDataFrame([("h", "H"), ("f", "F"), ("k", "K")], "a string, b string")
    assert rows(M.neighbour_score(both, ea, eb, q, "a", "b"), "a") == [("f", "F", 1.0), ("h", "H", 1.0), ("k", "K", 0.0)]
    anchors = spark.createDataFrame([("x", 9), ("y", 1), ("y", 5), ("y", 7), ("y", 8)], "f string, pos int")
    items = spark.createDataFrame([("x",), ("y",), ("z",)], "f string")
    assert rows(M.infer_order(anchors, items, "f", "pos").select("f", "rank"), "rank") == [("y", 1), ("x", 2), ("z", 3)]
    assert tuple(M.evaluate_mapping(m, spark.createDataFrame([("f", "F"), ("g", "X"), ("k", "K")], "a string, b string"), "a", "b").first()) == (1, 1, 1)


def test_edge_cut_equals_nested_loop(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(60)]
    pos = spark.createDataFrame([(i,) for i in range(30)], "pos bigint")
    got = dict(rows(S.edge_cut(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b", pos, "pos", block=4), "pos"))
    assert got == {g: sum(min(e) < g <= max(e) for e in edges) for g in range(30)}


def test_votes_cuts_and_names(spark):
    v = spark.createDataFrame([("s", "b", 1), ("s", "a", 2), ("s", "a", 3), ("s", "b", 4), ("t", None, 5)], "s string, m string, o int")
    assert rows(S.majority_vote(v, "s", "m", "o"), "s") == [("s", "b", 2)]
    sc = spark.createDataFrame([("k", p, float(s)) for p, s in enumerate([9, 9, 1, 2, 9, 9, 0, 9, 9, 9])], "k string, pos bigint, score double")
    assert rows(S.spaced_cuts(sc, "k", "pos", "score", 3), "pos") == [("k", 2), ("k", 6)]
    n = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id int, n string")
    assert [r[2] for r in rows(E.suffixed(n, "n", "id"), "id")] == ["x", "y", "x_2"]


def test_evidence(spark):
    e = spark.createDataFrame([(1, "string", 0.9, 1), (1, "port", 0.9, 0), (2, "port", 0.9, 0), (3, "a", 0.5, 0), (3, "b", 0.68, 1)], "f int, kind string, s double, o int")
    assert rows(E.corroborated(e, ["f"], "kind", "s", "o"), "f") == [(1, 2, "port", 0.9), (2, 1, "port", 0.65), (3, 2, "b", 0.83)]
    assert rows(E.name_diff(spark.createDataFrame([("a",), ("b",)], "n string"), spark.createDataFrame([("b",), ("c",)], "n string"), "n"), "n") == [("a", "only_in_a"), ("b", "common"), ("c", "only_in_b")]
    f = spark.createDataFrame([("x", "blocker", "overlaid"), ("y", "warn", "few frames"), ("z", "info", "compiled")], "path string, level string, code string")
    assert [(r.path, r.in_scope, r.confidence) for r in E.triage_verdict(f).orderBy("path").collect()] == [("x", False, "high"), ("y", True, "low"), ("z", True, "high")]


def test_passages_refuse_what_only_looks_alike(spark):
    p = spark.createDataFrame([(1, "one two three four five six"), (2, "short"), (3, "seven eight nine ten eleven twelve")], "i int, text string")
    d = spark.createDataFrame([(1, "xone two three four five sixy"), (2, "one two three four five seven"), (3, "a short b"), (4, None)], "d int, text string")
    assert rows(T.passage_hits(p, d, "i", "d"), "i", "d") == [(1, 1), (2, 3)]
    assert [r.kind for r in T.ambiguity(T.passage_hits(p, d, "i", "d"), p, "i").orderBy("i").collect()] == ["unique", "unique", "none"]


def test_weighted_jaccard_equals_all_pairs(spark):
    rng = random.Random(9)
    a = {i: set(rng.sample("abcdefghij", rng.randrange(1, 6))) for i in range(12)}
    b = {i: set(rng.sample("abcdefghij", rng.randrange(1, 6))) for i in range(15)}
    df = lambda x, k: spark.createDataFrame([(i, t) for i, s in x.items() for t in s], f"{k} int, token string")
    w = {t: 1 + ord(t) % 5 for t in "abcdefghij"}
    wd = spark.createDataFrame([(t, float(x)) for t, x in w.items()], "token string, weight double")
    got = {(r.a, r.b): round(r.score, 9) for r in T.weighted_jaccard(df(a, "a"), df(b, "b"), wd, "a", "b", 0.4).collect()}
    sim = lambda s, t: sum(w[x] for x in s & t) / sum(w[x] for x in s | t)
    assert got == {(i, j): round(sim(s, t), 9) for i, s in a.items() for j, t in b.items() if sim(s, t) >= 0.4}


def test_reach_counts_equal_a_search():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (12, 9), (40, 36), (40, 60), (90, 85), (400, 380)):
        e = rng.integers(0, n, (2, m))
        for words in (1, 1 << 24):
            got = G.reach_counts(n, e[0], e[1], words)
            for v in range(n):
                seen, todo = {v}, [v]
                while todo:
                    at = todo.pop()
                    new = set(e[1][e[0] == at].tolist()) - seen
                    seen |= new
                    todo += new
                assert got[v] == len(seen)


def test_reach_makes_no_row_a_pair(spark):
    n = 3000  # one ring: 9,000,000 pairs
    ring = spark.range(n).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), (F.col("id") + 1) % n).alias("dst"))
    edges = ring.unionByName(spark.createDataFrame([("a", "n0"), ("b", "a"), ("x", None), ("n5", "end")], "src string, dst string"))
    got = {r.node: r.reach for r in G.reach(edges).collect()}
    assert got["n0"] == got["n7"] == n + 1 and got["a"] == n + 2 and got["b"] == n + 3 and len(got) == n + 2
    few = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 1), (4, 2), (1, 2)], "src bigint, dst bigint")
    assert sorted(G.reach(few).collect()) == sorted(G.reach(few, most_edges=0).collect())
