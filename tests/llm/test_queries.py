"""The registered queries against their SQL, and against brute force where SQL can't express them."""

import collections
import html as H
import re
import zlib

import numpy as np
import pytest
from oracle import connect, rows_of, rows_of_sql

from quarrybed.llm import queries as Q


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    assert rows_of(Q.QUERIES[name](spark, sf_dir)) == rows_of_sql(con, Q.ORACLE_SQL[name])


def accuracy_of_held_out(got, truth):
    pairs = [(p, truth[i]) for i, held, p in got if held and i in truth]
    assert pairs
    return sum(p == t for p, t in pairs) / len(pairs)


def test_quality_on_held_out_rows(spark, con, sf_dir):
    got = Q.op2_quality_classifier(spark, sf_dir).collect()
    held = {i for (i,) in con.execute("SELECT doc_id FROM documents").fetchall() if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {r.doc_id for r in got if r.held_out} == held and len(got) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert accuracy_of_held_out([(r.doc_id, r.held_out, r.predicted) for r in got], dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())) >= 0.9


def test_language_on_held_out_rows(spark, con, sf_dir):
    got = Q.op3_language_id(spark, sf_dir).collect()
    assert accuracy_of_held_out([(r.doc_id, r.held_out, r.lang_pred) for r in got], dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())) >= 0.95


def test_shards(spark, con, sf_dir):
    got = Q.op6_sharding(spark, sf_dir).collect()
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    slots = collections.defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 0 < sum(r.grown_shard == 16 for r in got) < len(got) / 5


def test_packing_against_the_tokenizer(spark, con, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_file())
    tok.encode_special_tokens = True
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}
    got = Q.op7_packing(spark, sf_dir).collect()
    parts, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        whole = ids[r.doc_id]
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())
        parts[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces, total in [*((p, len(ids[d])) for d, p in parts.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at <= 4096 if total is None else at == total
    assert set(parts) == set(ids) and sorted(sequences) == list(range(len(sequences)))
    assert sum(map(len, ids.values())) / (4096 * len(sequences)) > 0.95


def test_extraction_of_whole_articles(spark, con, sf_dir):
    got = {r.page_id: r for r in Q.op9_html_extraction(spark, sf_dir).collect()}
    for page, url, raw in con.execute("SELECT page_id, url, html FROM pages").fetchall():
        body = re.search(r"<article>(.*?)</article>", raw, re.S)[1]
        want = " ".join(H.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", body))).split())
        assert (got[page].text, got[page].url, got[page].n_chars) == (want, url, len(want))


def brute_components(rows, n, num, den):
    sets = []
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        k = min(n, len(w))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()))
    inverted = collections.defaultdict(list)
    for x, (_, s) in enumerate(sets):
        for g in s:
            inverted[g].append(x)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, s) in enumerate(sets):
        for y, o in collections.Counter(y for g in s for y in inverted[g] if y < x).items():
            if den * o >= num * (len(s) + len(sets[y][1]) - o):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(least.get(find(x), i), i)
    return sorted((i, len(s), least[find(x)]) for x, (i, s) in enumerate(sets))


def test_jaccard_against_all_pairs(spark, con, sf_dir):
    want = brute_components(con.execute("SELECT doc_id, text FROM documents").fetchall(), 4, 85, 100)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in Q.op10_ngram_jaccard_join(spark, sf_dir).collect()) == want


def test_pipeline_stages(spark, con, sf_dir):
    import corpus_pipeline as C
    from quarrybed.llm.common import scratch_path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in C.STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r.doc_id for r in docs.select("doc_id").distinct().collect()})
        assert docs.columns == columns or name == "packing"
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] == kept[4] and kept[4]
    good = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    assert not any(good.get(i) == 0 for i in kept[0])
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    comps = brute_components([(i, texts[i]) for i in sorted(kept[1])], 5, 4, 5)
    assert kept[2] == {c for _, _, c in comps}
    bad = {r.doc_id for r in Q.op1_decontamination(spark, sf_dir).collect() if r.contaminated}
    assert kept[3] == kept[2] - bad
