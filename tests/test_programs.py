"""Operators that SQL cannot express, against plain scans; and the parts that no query shows."""

import math
import random
import struct
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import rows_of, rows_of_sql
from quarrybed.operators import evidence as E
from quarrybed.operators import features as T
from quarrybed.operators import identify as D
from quarrybed.operators import instructions as N
from quarrybed.operators import intervals as I
from quarrybed.operators import pairs as Q
from quarrybed.plans import catalog, programs
from quarrybed.sources import binary as B
from quarrybed.sources import omf
from quarrybed.sources import pascal as P
from quarrybed.sources import signatures as G


# ---------------------------------------------------------------- identification


class Scan:
    """Every pair scored in plain Python, round by round."""

    def __init__(self, src, binary):
        clean = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
        self.src, self.bin = {r.name: r for r in src}, {r.entry: r for r in binary}
        self.tokens = [
            ({n: {v for v in r.constants or () if v not in D.NOISE} for n, r in self.src.items()}, {n: {v for v in r.scalars or () if v not in D.NOISE} for n, r in self.bin.items()}),
            tuple({n: {clean(s) for s in r.strings or ()} for n, r in side.items()} for side in (self.src, self.bin)),
        ]
        total = len(self.src) + len(self.bin)
        self.weights = []
        for pair in self.tokens:
            df = Counter(t for side in pair for s in side.values() for t in s)
            self.weights.append({t: math.log(1 + total / n) for t, n in df.items()})
        self.calls = [{n: {x for x in r.calls or () if x in side} for n, r in side.items()} for side in (self.src, self.bin)]
        self.callers = []
        for calls in self.calls:
            back = {n: set() for n in calls}
            for n, out in calls.items():
                for x in out:
                    back[x].add(n)
            self.callers.append(back)

    def similar(self, k, a, b):
        x, y, w = self.tokens[k][0][a], self.tokens[k][1][b], self.weights[k]
        return sum(w[t] for t in x & y) / sum(w[t] for t in x | y) if x and y else 0.0

    def beside(self, mapping, a, b):
        parts = []
        for mine, theirs in ((self.calls[0][a], self.calls[1][b]), (self.callers[0][a], self.callers[1][b])):
            image = {mapping[x] for x in mine if x in mapping}
            if image:
                parts.append(len(image & theirs) / len(image))
            elif theirs:
                parts.append(0.0)
        return sum(parts) / len(parts) if parts else 0.0

    def score(self, mapping, weight, a, b):
        s, r = self.src[a], self.bin[b]
        ratio = r.instruction_count / s.body_lines
        size = 1 - abs(math.log(ratio / 2.5)) / math.log(6) if 1 <= ratio <= 6 else 0.0
        x, y = len(self.calls[0][a]), len(self.calls[1][b])
        degree = 1 - abs(x - y) / max(x, y) if max(x, y) else 0.5
        shape = [0.0 if min(p, q) <= 0 else min(p, q) / max(p, q) for p, q in ((s.cyclomatic, r.cyclomatic), (s.loops, r.loops), (s.returns, r.returns)) if max(p, q) > 0]
        told = bool(self.tokens[1][0][a] and self.tokens[1][1][b])
        up = self.similar(0, a, b) + weight * self.beside(mapping, a, b) + 0.35 * size + 0.35 * degree + 1.2 * (sum(shape) / len(shape) if shape else 0.0) + (2.5 * self.similar(1, a, b) if told else 0.0)
        return up / (1 + weight + 0.35 + 0.35 + 1.2 + (2.5 if told else 0.0))

    def run(self, threshold=0.45, rounds=8):
        mapping, scores = {}, {}
        for r in range(rounds):
            weight, floor = (0.0 if r == 0 else min(2.0, 0.6 * r + 0.6)), threshold + max(0.0, 0.18 * (2 - r))
            free = [b for b in self.bin if b not in set(mapping.values())]
            found = sorted(((v, a, b) for a in self.src if a not in mapping for b in free if (v := self.score(mapping, weight, a, b)) >= floor), reverse=True)
            taken = set()
            new = {}
            for v, a, b in found:
                if a not in new and b not in taken:
                    new[a], scores[a] = b, v
                    taken.add(b)
            if not new:
                break
            mapping |= new
        return {(a, b, round(scores[a], 9)) for a, b in mapping.items()}


@pytest.fixture(scope="module")
def builds(spark, sf_dir):
    return programs._two_builds(spark, sf_dir)


def test_identification_equals_scoring_every_pair(builds, spark, sf_dir):
    src, binary = (df.collect() for df in builds)
    want = Scan([r for r in src if r.file.lower() != "brand#1"], binary).run()
    got = {(r.source, r.binary, r.score) for r in catalog.QUERIES["identify_functions"](spark, sf_dir).collect()}
    assert {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in want} and len(got) > 100
    assert all(abs(s - next(x for a, b, x in want if a == g)) < 1e-6 for g, _, s in got)


def test_identification_refuses_what_it_would_lose(builds):
    ev = D.gathered(*builds)
    with pytest.raises(ValueError, match="every pair"):
        D.identify(ev, threshold=0.3)


def test_identification_keeps_no_table_of_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    held, put = [], D.persist_shared
    for module in (D, Q):
        monkeypatch.setattr(module, "persist_shared", lambda df, name: held.append((out := put(df, name)).count()) or out)
    monkeypatch.setattr(Q, "BLOCK", 16)
    counts = [[rng.randrange(6) for _ in range(3)] for _ in range(50)]
    own = [[999, 1000 + i % 30, *(2000 + rng.randrange(9) for _ in range(i % 3))] for i in range(50)]
    calls = [[rng.randrange(50) for _ in range(4)] for _ in range(50)]
    fields = "constants array<bigint>, strings array<string>, calls array<string>, cyclomatic int, loops int, returns int"
    src = spark.createDataFrame([(f"f{i}", "m", i, 4 + i % 9, own[i], [f"t {i}"] if i % 4 == 0 else [], [f"f{x}" for x in calls[i]], *counts[i]) for i in range(50)], f"name string, file string, line int, body_lines int, {fields}")
    binary = spark.createDataFrame([(str(i), 11 + 2 * i % 18, own[i][: 1 + i % 3], [f"t {i}"] if i % 4 == 0 else None, [str(x) for x in calls[i][:3]], *counts[i]) for i in range(50)], "entry string, instruction_count int, " + fields.replace("constants", "scalars"))
    got = {(r.source, r.binary): r.score for r in D.identify(D.gathered(src, binary)).collect()}
    want = {(a, b): s for a, b, s in Scan(src.collect(), binary.collect()).run()}
    assert set(got) == set(want) and len(want) > 30 and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert max(held) < 50 * 50 / 2  # every pair shares 999


def test_shared_amounts_equal_counting():
    rng = random.Random(4)
    for few in (2, 2000):  # many cells share something, or next to none
        sides = [[sorted({rng.randrange(few) for _ in range(rng.randrange(3))}) for _ in range(n)] for n in (40, 60)]
        lists = [Q.Lists(np.cumsum([0, *map(len, s)]), np.array([t for x in s for t in x], np.int64), np.array([t + 0.5 for x in s for t in x])) for s in sides]
        a, b = (Q.Block(None, np.zeros((1, 6)), np.zeros(len(s), int), None, {}, {"c": x}, {"c": x.inverted()}, {}) for s, x in zip(sides, lists, strict=True))
        for every in (False, True):
            got = {}
            for lo, _, at, amounts in Q.Tile(a, b, 1.0).shared(("c",), every):
                got |= {(int(k) // 60 + lo, int(k) % 60): v for k, v in zip(at, amounts.get("c", np.zeros(len(at))), strict=True)}
            want = {(i, j): sum(t + 0.5 for t in set(x) & set(y)) for i, x in enumerate(sides[0]) for j, y in enumerate(sides[1]) if every or set(x) & set(y)}
            assert got == want


def plain_alignment(score, floor=0.25, gap=-0.25):
    n, m = len(score), len(score[0])
    use = [[v if v >= floor else -0.05 for v in row] for row in score]
    best = [[gap * (i + j) if not i or not j else 0.0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = max(best[i - 1][j - 1] + use[i - 1][j - 1], best[i - 1][j] + gap, best[i][j - 1] + gap)
    out, i, j = set(), n, m
    while i and j:
        if abs(best[i][j] - best[i - 1][j - 1] - use[i - 1][j - 1]) < 1e-9:
            if use[i - 1][j - 1] > 0:
                out.add((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif abs(best[i][j] - best[i - 1][j] - gap) < 1e-9:
            i -= 1
        else:
            j -= 1
    return out


def test_alignment_along_the_module_order(builds, spark):
    src, binary = (df.where(cond) for df, cond in zip(builds, ("line < 40", "cast(entry as int) < 640"), strict=True))
    ev = D.gathered(src, binary)
    anchors = D.identify(ev, rounds=1)
    order = D.module_order(ev, anchors)
    got = {(r.source, r.binary): r.score for r in D.align(ev, anchors, order).collect()}
    scan = Scan(src.collect(), binary.collect())
    pins = {(r.source, r.binary) for r in anchors.collect()}
    ranks = {r.file: r["rank"] for r in order.collect()}
    xs = sorted(scan.src, key=lambda n: (ranks[scan.src[n].file], scan.src[n].line, n))
    ys = sorted(scan.bin, key=int)
    table = [[1.0 if (a, b) in pins else scan.score({}, 0.0, a, b) for b in ys] for a in xs]
    want = {(xs[i], ys[j]) for i, j in plain_alignment(table)}
    assert set(got) == want and len(want) > 10
    assert all(abs(v - scan.score({}, 0.0, a, b)) < 1e-6 for (a, b), v in got.items())
    again = D.align_passes(ev, anchors, passes=2)
    assert again.columns == ["source", "binary", "score"] and again.count() > 10


def test_alignment_in_tiles(builds, spark, monkeypatch):
    monkeypatch.setattr(D, "MOST_CELLS", 100, raising=False)  # there is no such limit any more
    src, binary = (df.where(cond) for df, cond in zip(builds, ("line < 90", "cast(entry as int) < 1400"), strict=True))
    ev = D.gathered(src, binary)
    anchors = D.identify(ev, rounds=1)
    order = D.module_order(ev, anchors)
    whole = {tuple(r) for r in D.align(ev, anchors, order).collect()}
    monkeypatch.setattr(Q, "BLOCK", 16)
    assert {tuple(r) for r in D.align(ev, anchors, order).collect()} == whole and len(whole) > 40


# ---------------------------------------------------------------- Pascal images


def plain_cover(piece, lib, width=16):
    covered = longest = i = 0
    while i < len(piece) - width:
        n = 0
        if lib.find(piece[i : i + width]) >= 0:
            n = width
            while i + n < len(piece) and lib.find(piece[i : i + n + 1]) >= 0:
                n += 1
        covered, longest, i = covered + n, max(longest, n), i + (n or 1)
    return covered, longest


def test_verbatim_runs_equal_a_search():
    rng = random.Random(6)
    for _ in range(30):
        lib = bytes(rng.randrange(3) for _ in range(400))
        piece = b"".join(lib[(a := rng.randrange(380)) : a + rng.randrange(2, 60)] + bytes([rng.randrange(5)]) for _ in range(8))
        assert P.Library(lib, 8).cover(piece) == plain_cover(piece, lib, 8)


def test_registered_cover_equals_a_search(spark, sf_dir):
    docs = [(str(r.doc_id), (r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = sorted((r.item_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect())
    want = set()
    for k in (0, 1):
        lib = "".join(t + "\x00" for i, t in items if i % 2 == k).encode()
        want |= {(d, str(k), *c) for d, t in docs if (c := plain_cover(t, lib))[0]}
    assert {tuple(r) for r in catalog.QUERIES["verbatim_cover"](spark, sf_dir).select("path", "library", "covered", "longest").collect()} == want


def test_segments_that_contradict_each_other():
    calls, entries = Counter({0: 5, 10: 1, 20: 4, 30: 2}), {0: {0, 200}, 10: {3}, 20: {400}, 30: {0}}
    # 0 is entered behind the start of 10 (called once, not at its start: no candidate); 20 behind that of 30, which is weaker
    assert P.fitting_segments(calls, entries, 60) == [0, 20]
    assert P.fitting_segments(Counter({0: 2, 4: 2}), {0: {100}, 4: {0}}, 60) == [0]


def test_a_segment_comes_back_by_its_strings():
    image = bytearray(b"\x90" * 4096)
    at = 1024
    for i in range(10):  # references in segment 64 (byte 1024) to strings at its start
        image[at + 600 + 8 * i : at + 605 + 8 * i] = b"\xbf" + struct.pack("<H", 4 + 8 * i) + b"\x0e\x57"
        image[at + 4 + 8 * i : at + 12 + 8 * i] = b"\x06ABCDEF\x00"
    assert P.string_score(bytes(image), 1024, 1024, 4096) == (10, 10) and P.string_score(bytes(image), 0, 1024, 4096) == (0, 10)
    assert P.rescued_segments(bytes(image), Counter({64: 1}), [], 256) == [(64, 10, 10, 0)]
    image[0x10:0x15] = b"\x9a" + struct.pack("<HH", 9, 64)
    assert P.far_targets(bytes(image)) == (Counter({64: 1}), {64: {9}})


# ---------------------------------------------------------------- signatures and objects


def plain_places(image, data, mask, limit=8):
    out = []
    for i in range(len(image) - len(mask) + 1):
        if all(m == "0" or image[i + k] == data[k] for k, m in enumerate(mask)):
            out.append(i)
    return out[:limit]


def test_masked_search_equals_trying_every_place():
    rng = random.Random(2)
    for _ in range(40):
        image = bytes(rng.randrange(3) for _ in range(300))
        rows = []
        for k in range(6):
            a, n = rng.randrange(280), rng.randrange(6, 18)
            mask = "1111" + "".join(rng.choice("110") for _ in range(n - 4))
            rows.append((f"s{k}", "m", image[a : a + n].ljust(n, b"\2"), mask[:n]))
        got = dict(G.Index(rows).places(image, 8))
        assert got == {i: p for i, r in enumerate(rows) if (p := plain_places(image, r[2], r[3]))}
    assert list(G.Index([("a", "m", b"\1\2\3", "101")]).places(b"\1\2\3\4\5", 8)) == []


def test_entries_take_the_most_fixed_bytes():
    table = G.Entries([("a", "m", bytes(range(10)), "1" * 10), ("b", "m", bytes(range(12)), "0" + "1" * 11), ("c", "m", bytes([9] * 10), "1" * 10)])
    assert table.best(bytes(range(20)), 8) == (1, 11) and table.best(bytes(range(10)), 8) == (0, 10)
    assert table.best(b"\xff" + bytes(range(1, 12)), 8) == (1, 11) and table.best(bytes(range(5)), 8) is None and table.best(b"", 8) is None


def test_fixups_of_iterated_data_and_explicit_frames():
    from quarrybed.plans.render import counted_name, record

    head = record(omf.THEADR, counted_name("m")) + record(omf.LNAMES, b"\0" + counted_name("_TEXT") + counted_name("CODE")) + record(omf.SEGDEF, b"\x28" + struct.pack("<H", 16) + b"\x02\x03\x01")
    iterated = record(omf.LIDATA, b"\x01\0\0" + struct.pack("<HH", 8, 0) + b"\x02\x90\x91")
    # a frame thread with an explicit frame number, then two fixups, the first with an explicit frame number
    thread = bytes([0x4C, 0x34, 0x12])
    fixups = [bytes([0xC4, 2, 0x34, 0x78, 0x56, 1, 0, 0]), bytes([0xC4, 8, 0x56, 1])]
    (m,) = omf.modules(head + iterated + record(omf.FIXUPP, thread + b"".join(fixups)) + record(omf.MODEND, b"\0"))
    _, _, data, mask = m.segments[1]
    assert bytes(data) == b"\x90\x91" * 8 and "".join(map(str, mask)) == "1100111100111111"


def test_truncated_rasters_are_refused():
    head = bytearray(128)
    struct.pack_into("<BBBB4H", head, 0, 0x0A, 5, 1, 8, 0, 0, 3, 1)
    head[65] = 1
    struct.pack_into("<H", head, 66, 4)
    assert B.parse_pcx(bytes(head) + b"\x01" * 8)[0][4] == [[1] * 4] * 2
    assert B.parse_pcx(bytes(head) + b"\x01" * 7) == [] and B.parse_pcx(bytes(head) + b"\x01" * 7 + b"\xc4") == []


# ---------------------------------------------------------------- rules


def test_kinds_of_files_and_models(spark):
    rows = [("a.ovl", b"MZ" + bytes(24) + b"\1\0"), ("b.ovl", b"MZ" + bytes(26)), ("c.Com", b"x"), ("d.DAT", None), ("e", b""), ("f.hlp", b"ZM")]
    df = spark.createDataFrame([(n, None if b is None else bytearray(b)) for n, b in rows], "n string, b binary")
    assert [r.k for r in df.select(E.kind_of_file(F.col("n"), F.col("b")).alias("k")).collect()] == ["overlay-module", "executable", "com", "overlay-or-data", "data", "executable"]


def test_entry_points_keep_their_score(spark):
    f = spark.createDataFrame(
        [("1", "entry", "certain", "C runtime startup (program entry point)", 0), ("1", "interrupt", "high", "BIOS video", 1), ("2", "entry", "medium", "main", 0), ("2", "port", "medium", "PIC mask", 1), ("3", "interrupt", "high", "BIOS video", 0), ("4", "string", "high", "main", 0)],
        "address string, kind string, confidence string, claim string, n int",
    )
    got = {r.address: (r.name, r.score) for r in E.proposed_names(f).collect()}
    assert got == {"1": ("crt_startup", 0.95), "2": ("main", 0.6), "3": ("bios_video", 0.65)}
    ev = spark.createDataFrame([(1, "entry", 0.95, 0, True), (1, "port", 0.68, 1, False), (2, "entry", 0.6, 0, True)], "a int, k string, s double, o int, f boolean")
    assert sorted((r.a, r.confidence) for r in E.corroborated(ev, ["a"], "k", "s", "o", "f").collect()) == [(1, 0.95), (2, 0.6)]


def test_interval_join_equals_a_scan(spark):
    rng = random.Random(4)
    spans = [(i, a := rng.randrange(-500, 500), a + rng.choice([0, 1, 3, 64, 700])) for i in range(60)]
    probes = [(i, rng.randrange(-600, 1300)) for i in range(200)] + [(999, None)]
    got = I.interval_join(spark.createDataFrame(probes, "p int, pos bigint"), spark.createDataFrame(spans, "s int, a bigint, z bigint"), "pos", "a", "z")
    assert sorted((r.p, r.s) for r in got.collect()) == sorted((p, s) for p, x in probes if x is not None for s, a, z in spans if a <= x < z)


def test_winner_of_margin_and_passages_with_hot_keys(spark):
    rows = [("k", f"i{j}", j) for j in range(50)] + [("one", "x", 3), ("tie", "a", 4), ("tie", "b", 4)]
    got = {r.k: (r.winner, r.best, r.runner_up) for r in T.margin_winner(spark.createDataFrame(rows, "k string, i string, s int"), "k", "i", "s").collect()}
    assert got == {"k": (None, 49, 48), "one": ("x", 3, 0), "tie": (None, 4, 4)}


def test_conflicts_and_descent(spark, sf_dir):
    items = {r.p_partkey: r.p_size for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity < 3").collect()
    fights = {(r.l_partkey, (r.l_partkey * 7 + r.l_suppkey) % 2000) for r in li}
    beats = {}
    for a, b in {*fights, *((b, a) for a, b in fights)}:
        if a in items and b in items and a != b:
            beats.setdefault(a, set()).add(b)
    live, kept = set(items), set()
    for k in sorted(items, key=lambda k: (-items[k], k)):
        if k in live:
            kept.add(k)
            live -= beats.get(k, set())
    assert {r.k for r in catalog.QUERIES["conflict_free"](spark, sf_dir).collect()} == kept
    assert catalog.QUERIES["descend_to_main"](spark, sf_dir).first().main == 0


def test_labels_beyond_a_megabyte_are_renamed(spark):
    lines = spark.createDataFrame([("L_100004: call L_00010",), ("L_FFFFF: nop",)], "line string")
    routines = spark.createDataFrame([(0x100004, "far"), (0x10000, "wrong"), (0x10, "near")], "address bigint, name string")
    got = {(r.line, r.routine_hits) for r in N.renamed_lines(lines, routines, spark.createDataFrame([], "segment string, address bigint, name string")).collect()}
    assert got == {("far: call near", 2), ("L_FFFFF: nop", 0)}


def test_audit_reads_labels_beyond_a_megabyte(spark):
    text = ["L_100004:", "  jmp L_100024", "  call L_100014", "L_100014:", "  ret"]
    lines = spark.createDataFrame(list(enumerate(text)), "n bigint, line string")
    routines = spark.createDataFrame([(0x100004, "a"), (0x100020, "b")], "address bigint, name string")
    none = spark.createDataFrame([], "segment string, address bigint, name string")
    got = {(r.kind, r.address) for r in N.name_audit(lines, routines, none).collect()}
    assert got == {("unnamed call", 0x100014), ("ghost", 0x100020), ("tail", 0x100024)}


def _audit_equals_sql(spark, folder, keys):
    spark.createDataFrame([(k,) for k in keys], "p_partkey bigint").coalesce(1).write.parquet(f"{folder}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    df = catalog.QUERIES["name_audit"](spark, str(folder))
    assert rows_of(df) == rows_of_sql(con, catalog.ORACLE_SQL["name_audit"])
    return df


def test_audit_equals_sql_beyond_a_megabyte(spark, tmp_path):
    kinds = {r.kind for r in _audit_equals_sql(spark, tmp_path, [*range(300), *range(0x100000 - 150, 0x100000 + 150), None]).collect()}
    assert kinds == {"unnamed call", "ghost", "named", "settled", "unnamed", "tail"}


def test_audit_of_repeated_keys_equals_sql(spark, tmp_path):
    ghosts = [r.address for r in _audit_equals_sql(spark, tmp_path, [*range(100), *range(50)]).where("kind = 'ghost'").collect()]
    assert sorted(ghosts) == [0, 0, 20, 20, 40, 40, 60, 80]


def test_audit_of_negative_keys_equals_sql(spark, tmp_path):
    _audit_equals_sql(spark, tmp_path, range(-300, 300))


def test_entries_by_join_equal_the_table(spark):
    rng = random.Random(5)
    word = lambda n: bytes(rng.choice(b"\1\2") for _ in range(n))
    sigs = [(f"s{i % 40}", f"m{i % 3}", word(n), "".join(rng.choice("01111") for _ in range(n))) for i in range(300) for n in (rng.randint(2, 9),)]
    codes = [word(rng.randint(0, 11)) for _ in range(200)]
    df = spark.createDataFrame([(a, b, d.hex(), m) for a, b, d, m in sigs], "name string, module string, bytes string, mask string")
    entries = spark.createDataFrame([("x", i, bytearray(code)) for i, code in enumerate(codes)], "path string, at int, code binary")
    kept = sorted((s for s in sigs if s[3].count("1") >= 4), key=lambda s: (s[0], s[1], s[2]))
    held = G.Entries(kept)
    want = {(i, kept[f[0]][0], kept[f[0]][1], f[1]) for i, code in enumerate(codes) if (f := held.best(code, 4))}
    assert {(r.at, r.name, r.module, r.fixed_bytes) for r in G.match_entries(entries, df, 4).collect()} == want and len(want) > 50
    plan = G.match_entries(entries, df, 4)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan  # no code meets a table of all signatures


def test_signatures_are_cut_from_pieces_of_an_image(spark):
    rng = random.Random(6)
    image = bytes(rng.randrange(256) for _ in range(3 * G.PIECE + 50))
    places = sorted(rng.sample(range(len(image) + 5), 150) + [G.PIECE - 5, G.PIECE - 1, 2 * G.PIECE])
    stretches = [(a, rng.choice((0, 1, 2, 2, 2, 3, 40))) for a in rng.sample(range(len(image)), 200)] + [(5000, 900)]
    symbols = spark.createDataFrame([("p", a, f"f{i}", "x.lib(m)") for i, a in enumerate(places)], "path string, offset bigint, name string, module string")
    images = spark.createDataFrame([("p", bytearray(image))], "path string, image binary")
    wild = spark.createDataFrame([("p", *s) for s in stretches], "path string, at bigint, n int")
    hit = {a + j for a, n in stretches for j in range(n)}
    want = set()
    for i, a in enumerate(places):
        end = places[i + 1] if i + 1 < len(places) else a + 32
        code = image[a : min(end, a + 32)]
        mask = "".join("0" if a + j in hit else "1" for j in range(len(code)))
        if len(code) >= 8 and mask.count("1") >= 8:
            want.add((f"f{i}", end - a, code.hex(), mask))
    got = G.build_signatures(symbols, images, wild)
    assert {(r.name, r.length, r.bytes, r.mask) for r in got.collect()} == want and len(want) > 20
    assert "_cell" in got._jdf.queryExecution().analyzed().toString()  # stretches are joined by cells, not all with all
