"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrybed.llm import chat, decontamination, html, jaccard, language, packing, quality, rules, sharding, warc
from quarrybed.llm.queries import tokenizer_file

TEXTS = [None, "", " \n ", "one", "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p", "Ünï 日本 \U0001f600 x", "the cat sat " * 30_000, "\x00\x1f!"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "a b c d e f g h i j k l m n o p", None, None, None)], DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    names = "n_words n_hit hit_spans hit_items score label fail_bits kept _row _m lang_pred rejected k component_id contaminated sequence_id".split()
    return docs.select("*", *[F.lit(7).alias(n) for n in names])


def test_decontamination(spark, docs, clashing):
    bench = spark.createDataFrame([("x", "a b c d e f g h i j k l m"), ("y", None), ("z", "THE CAT"), ("w", "")], "item_id string, text string")
    found = decontamination.with_verdict(decontamination.find_contamination(docs, bench))
    got = {r.doc_id: r for r in found.collect()}
    assert (got[0].n_words, got[0].n_hit, got[0].contaminated) == (0, 0, False) and got[4].n_hit == 13 and got[4].hit_items == ["x"]
    assert (got[7].n_hit, got[7].n_words, got[7].contaminated, got[7].hit_items) == (60_000, 90_000, True, ["z"])
    kept = decontamination.remove_contaminated(clashing, bench)
    assert kept.columns == clashing.columns and kept.count() == docs.count() - 5
    few = decontamination.find_contamination(docs, bench, block_bytes=40)
    key = lambda df: sorted((str(r.doc_id), r.n_words, r.n_hit, str(r.hit_items)) for r in df.collect())
    assert key(few) == key(found)
    assert decontamination.remove_contaminated(docs, bench.limit(0)).count() == docs.count()
    assert decontamination.find_contamination(docs.limit(0), bench).count() == 0


def test_longest_matches_against_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab c d".split()) for _ in range(rng.randrange(30))) for _ in range(20)]
    item = [rng.choice("ab c d".split()) for _ in range(15)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.item_pos: (r.length, r.doc_id, r.doc_pos) for r in decontamination.longest_matches(df, spark.createDataFrame([("i", " ".join(item))], "item_id string, text string")).collect()}
    for p in range(len(item)):
        best = (0,)
        for d, t in enumerate(texts):
            w = t.split()
            for q in range(len(w)):
                n = 0
                while p + n < len(item) and q + n < len(w) and item[p + n] == w[q + n]:
                    n += 1
                best = max(best, (n, -d, -q))
        assert got[p][0] == best[0]
        w = texts[got[p][1]].split()
        assert w[got[p][2] : got[p][2] + best[0]] == item[p : p + best[0]]


def test_rules(spark, docs, clashing):
    got = {r.doc_id: r for r in rules.apply_policy(rules.ledger(docs), rules.POLICIES[-1]).collect()}
    assert (got[0].n_words, got[0].kept, got[7].n_words, got[7].n_repeat_words) == (0, False, 90_000, 90_000)
    assert rules.ledger(clashing).columns.count("n_words") == 1
    kept = rules.keep_good(clashing.unionByName(clashing.limit(1).withColumn("text", F.lit(" ".join(f"word{i}" for i in range(60))))))
    assert kept.columns == clashing.columns and kept.count() == 1
    assert rules.ledger(docs.limit(0)).count() == 0
    a = {(r.policy, r.version, r.rule): (r.n_failed, r.n_only) for r in rules.ablations(rules.ledger(docs)).collect()}
    assert a["base", 1, "min_words"][0] == docs.count() - 1 and a["base", 1, "repeated_windows"] == (1, 1)
    assert rules.ablations(rules.ledger(docs.limit(0))).agg(F.sum("n_failed")).first()[0] == 0


def test_quality(spark, docs, clashing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(3, None, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        out = quality.score(clashing, quality.fit(docs, known))
        assert out.count() == docs.count() and out.where("score between 0 and 1").count() == docs.count()
    assert quality.keep_good(clashing, labels.where("quality = 1")).columns == clashing.columns
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_language(spark, docs, clashing):
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.identify(clashing, model, reject=False).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 8)] == ["und"] * 4 and got[0].score == 0 and got[3].lang_pred == "en"
    assert language.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    odd = language.Model(["a", "b"], np.zeros((language.BUCKETS, 2), dtype=np.float32), np.zeros(2), threshold=0.9)
    assert {r.lang_pred for r in language.identify(docs, odd, reject=True).collect()} == {"und"}


def test_sharding_confines_movement(spark, docs):
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    base = sharding.topology(16)
    heavier = [sharding.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in base]
    both = sharding.assign(sharding.assign(ids, base), heavier, out="after").where("shard <> after")
    # weight went to rack 1 of region 0: nothing moves between the shards of region 1, nor out of shard 5
    assert both.where("shard >= 8 and after >= 8").count() == 0 and both.where("shard = 5").count() == 0
    assert both.where("shard < 4 and after < 4").count() == 0 and both.where("after = 5").count() > 0
    got = sharding.shard_documents(docs).collect()
    assert len(got) == docs.count() and len({(r.shard, r.slot) for r in got}) == len(got)
    null = next(r for r in got if r.doc_id == 0)
    assert (null.size, null.text_crc32) == (1, 0)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def pack_one_by_one(lengths, top):
    packs = []
    for n in sorted(lengths, reverse=True):
        fits = [p for p in packs if sum(p) + n <= top]
        if fits:
            min(fits, key=sum).append(n)
        else:
            packs.append([n])
    return len(packs)


def test_patterns_equal_packing_one_by_one():
    rng = random.Random(8)
    for _ in range(50):
        top = rng.choice([10, 50, 64])
        lengths = [rng.randrange(1, top + 1) for _ in range(rng.randrange(1, 120))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        patterns = packing.shortest_pack_first(histogram, top)
        back = {}
        for runs, packs in patterns:
            assert sum(n * t for n, t in runs) <= top and packs > 0
            for n, t in runs:
                back[n] = back.get(n, 0) + t * packs
        assert back == histogram
        assert abs(sum(p for _, p in patterns) - pack_one_by_one(lengths, top)) <= 1
    assert packing.shortest_pack_first({1: 10**9}, 4096) == [(((1, 4096),), 244140), (((1, 2560),), 1)]


def test_packing(spark, docs):
    got = packing.pack_documents(docs.select("doc_id", "text"), tokenizer_file()).collect()
    end = np.array([2], dtype="<u4").tobytes()
    for i in (0, 1, 2):
        assert [(r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == i] == [(1, zlib.crc32(end), 1)]
    long = [r for r in got if r.doc_id == 7]
    assert sum(r.length for r in long) == long[0].doc_tokens == 90_001
    assert packing.pack_documents(docs.limit(0), tokenizer_file()).count() == 0


@pytest.mark.parametrize("text", ["a\x1cb", "don't Σ ΑΣ <|endoftext|> x</w> a_b\x7f\x00z", "日本 語", "İé é é", "it's ok ª º µ ²³½ 12½", "naïve café_x'll ÿ", " x"])
def test_word_tokenizer_equals_the_whole(text):
    tok = packing.WordTokenizer(tokenizer_file())
    want = np.array(tok.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert tok.encode(text) == want


def test_added_tokens_are_found(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file())
    tok = packing.WordTokenizer(tokenizer_file())
    for text in ("a <|endoftext|> b", "a<|endoftext|>b", "<|startoftext|>", "<|ENDOFTEXT|> <| endoftext |>", "日<|endoftext|>", "plain"):
        want = np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert tok.encode(text) == want
    assert np.frombuffer(tok.encode("a <|endoftext|> b"), dtype="<u4").tolist() == [320, 49407, 321]


PAGES = "page_id bigint, url string, html string"


def test_warc_round_trip_and_splits(spark):
    rng = random.Random(1)
    big = [bytes(rng.randrange(32, 127) for _ in range(3000)).decode() for _ in range(3)]
    rows = [(1, "http://a/x y\r\n", big[0]), (2, None, big[0]), (9, "http://a", big[0]), (9, "http://a", big[0]), (3, "u", "tiny"), (4, "u", "tiny"), (5, "u", None), (6, "u", ""), (None, "u", big[1]), (7, "u", "é" * 600)]
    pages = spark.createDataFrame(rows, PAGES)
    want = sorted((str(i), len((h or "").encode()), "revisit" if i in (1, 2) else "response", 9 if i in (1, 2) else None) for i, _, h in rows)
    for split in (100, 1777, 8 << 20):
        got = warc.round_trip(pages, split_bytes=split, payloads=True).collect()
        assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got) == want
        assert {bytes(r.payload) for r in got if r.page_id == 7} == {("é" * 600).encode()}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_refuses_magic_inside_a_member():
    import io

    inner = warc.record(1, "u", b"x", "0" * 40, "revisit", 2)
    junk = warc.MAGIC + b"\x00" * 20
    data = junk + inner + junk + inner
    f = io.BytesIO(data)
    assert [r["page_id"] for r in warc.records_of(f, 0, len(data), len(data))] == [1, 1]
    assert [r["page_id"] for r in warc.records_of(f, len(junk) + 1, len(data), len(data))] == [1]


def test_chat(spark):
    rows = [
        (1, 0, "user", "How are you?\nTell me more"), (1, 1, "assistant", "Fine."), (1, 2, "user", "> tell  me MORE\nwhat?"), (1, 3, "assistant", ">> how are you?\n> what?\n> unknown\nanswer"),
        (2, 0, None, None), (2, 5, "user", "> x"), (None, 1, "user", "hi"), (3, 1, "a", "t"), (3, 1, "b", "t"), (3, 2, "b", "r"), (3, 2, "b", "r"),
    ]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {(r.conv_id, r.turn, r.role): r for r in out.collect()}
    x = got[1, 2, "user"]
    assert (x.text, x.reply_to, x.n_quoted, x.n_linked, x.depth) == ("what?", 0, 1, 1, 1)
    y = got[1, 3, "assistant"]
    # two passages: the nested one comes from turn 0 through turn 2, which quotes that; the other is nowhere said as a whole
    assert (y.text, y.reply_to, y.n_quoted, y.n_linked, y.depth) == ("answer", 2, 2, 1, 2)
    assert got[2, 0, None].text == "" and (got[2, 5, "user"].reply_to, got[2, 5, "user"].text) == (0, "")
    assert out.count() == len(rows)
    for c in (1, 2, 3, None):
        assert sorted(r.position for r in out.collect() if r.conv_id == c) == list(range(sum(r[0] == c for r in rows)))
    t = chat.transcripts(out).where("conv_id = 1").first()
    assert t.transcript.startswith("<|user|>\nHow are you?\nTell me more\n<|assistant|>\nFine.\n")
    assert chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_html(spark):
    made = [(i, f"http://h/{i}", f"<html><body><div class=top>Site of {i % 2}</div><div>Always here</div><div><p>Own {i} text<p>More &lt;{i}&gt;</div><div>Bye now</div></body>") for i in range(6)]
    rows = [*made, (6, None, None), (7, "http://other/", "<header><h1>Site</h1></header><div>x&nbsp;y <b>b</b>old</div><section id=comments>no</section><script>1<2</script>"), made[0]]
    pages = spark.createDataFrame(rows, PAGES)
    got = {r.page_id: r.text for r in html.extract(pages.withColumn("text", F.lit("old"))).collect()}
    assert got[3] == "Site of 1 Own 3 text More <3>" and got[6] == "" and got[7] == "x y bold"
    assert html.extract(pages.limit(0)).count() == 0
    assert html.extract(pages).count() == len(rows)


def test_html_of_copies(spark):
    page = "<html><body><div>Menu</div><div><p>{0} one<p>{0} two</div><div>Bye</div></body></html>"
    for copies in (3, 40):
        rows = [(i, f"http://h/{i}", page.format("Copy")) for i in range(copies)] + [(100 + i, f"http://h/{100 + i}", page.format(f"Own {i}")) for i in range(2)]
        got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
        assert len(got) == len(rows) and all(got[i] == "Copy one Copy two" for i in range(copies))
        assert got[100] == "Own 0 one Own 0 two"


def test_html_template_inside_articles(spark):
    page = "<html><body><article><h1>Title {0}</h1><p>Subscribers read more<p>Long own text of page {0}<div class=zz>Terms</div></article></body></html>"
    rows = [(i, f"http://h/{i}", page.format(i)) for i in range(6)]
    near = "<html><body><article><h1>One</h1><p>A long text that many pages share<p>And some more of it<p>{0}</article></body></html>"
    rows += [(10 + i, f"http://near/{i}", near.format(i)) for i in range(6)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[2] == "Title 2 Long own text of page 2"
    assert got[13] == "One A long text that many pages share And some more of it 3"


def test_html_classes_are_ordered_and_nested(spark):
    member = {1: (1, 0), 2: (1, 1), 3: (1, 2), 7: (7, 0), 8: (7, 1)}
    assert html.class_faults([1, 9, 2, 7, 8, 2, 3], member) == html.class_faults([1, 2, 3, 7, 8], member) == html.class_faults([7, 1, 2, 3, 8], member) == []
    assert html.class_faults([1, 7, 2, 8, 3], member) == [(1, 7)] == html.class_faults([7, 1, 8, 2], member)
    assert html.class_faults([2, 3, 1], member) == [(1, 1)]
    classes = [(5, [7, 8]), (9, [1, 2, 3])]
    assert html.valid_tokens(classes, {(3, 3): 4}, 2, 0.1) == [1, 2, 7, 8]
    assert html.valid_tokens(classes, {(1, 7): 1}, 2, 0.1) == [1, 2, 3]
    page = "<html><body><div>Menu</div><div>{0}</div><div>{1}</div><div>Bye</div></body></html>"
    rows = [(i, f"http://h/{i}", page.format(*(("Left", f"Own {i}") if i % 2 else (f"Own {i}", "Left")))) for i in range(6)]
    rows += [(10 + i, f"http://moved/{i}", (page if i % 2 else page.replace("<div>Bye</div>", "").replace("<div>Menu", "<div>Bye</div><div>Menu")).format("Fixed", f"Own {i}")) for i in range(6)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[0] == "Own 0" and got[1] == "Own 1"
    assert {got[10], got[11]} == {"Bye Own 0", "Own 1 Bye"}


def test_jaccard(spark, docs, clashing):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, n=4, t=(85, 100)).collect()}
    assert got == {(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 13, 4), (5, 13, 4), (None, 13, 4), (6, 1, 6), (7, 3, 7), (8, 1, 8)}
    kept = jaccard.keep_first(clashing, n=4, t=(85, 100))
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 4, 6, 7, 8}
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0
    assert jaccard.keep_first(docs.limit(0)).count() == 0


def test_keep_first_keeps_one_row_of_each_group(spark):
    a, b, c = "one two three four five six", "other words are here in this text", "nothing like the rest of them all"
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (None, c), (3, c), (1, "quite another document with the same id"), (4, c), (5, ""), (5, ""), (2, "a text of its own under a taken id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = [(1, a), (None, b), (3, c), (1, rows[8][1]), (5, ""), (5, ""), (2, rows[12][1]), (None, None)]
    got = [tuple(r) for r in jaccard.keep_first(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    alone = [(1, a), (2, a), (3, b)]
    assert sorted(map(tuple, jaccard.keep_first(spark.createDataFrame(alone, "doc_id bigint, text string")).collect())) == [(1, a), (3, b)]


def test_jaccard_of_chains_and_mixed_lists(spark):
    from test_queries import brute_components

    rng = random.Random(3)
    rows, words = [], [f"w{i}" for i in range(400)]
    for g in range(4):
        base = [rng.choice(words) for _ in range(60)]
        for c in range(25):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(60)] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
            base = t if c % 3 == 0 else base
    shared = [rng.choice(words) for _ in range(50)]
    rows += [(len(rows) + i, " ".join(shared + [rng.choice(words) for _ in range(rng.randrange(30))])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for n, t in ((4, (85, 100)), (5, (4, 5))):
        got = jaccard.near_duplicates(df, n=n, t=t, fragment_shingles=1500)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, n, *t)


def test_jaccard_with_shared_keys_and_two_levels(spark):
    from test_queries import brute_components

    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(120)]
    rows += [(200 + i, rows[i % 60][1] + (" extra" if i % 2 else "")) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    # 64 keys for some 180 sets, a fragment for 20 shingles, dealt in two levels from 4 fragments on
    got = jaccard.near_duplicates(df, n=4, t=(85, 100), key_bits=6, fragment_shingles=20, wide=4)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, 4, 85, 100)


def test_frequent_shingles_leave_early():
    heavy = jaccard.HEAVY
    k = np.sort(np.random.default_rng(1).integers(1, 1 << 62, heavy + 5).astype(np.uint64))
    sets = {int(x): np.unique(np.array([7 << 40, 9 << 45, 1000 + i], dtype=np.uint64)) for i, x in enumerate(k.tolist())}
    size = np.full(len(k), 3, dtype=np.uint64)
    shingle = np.concatenate(list(sets.values()))
    owner = np.repeat(np.arange(len(k)), 3)
    order = np.argsort(shingle, kind="stable")
    cuts = np.array([0, 1 << 44, 1 << 56], dtype=np.uint64)
    rows = list(jaccard._fragment_rows(k, size, shingle[order], owner[order], np.zeros(0, np.uint64), cuts, 0, 2, 2))
    back = [r for r in rows if r[0] >= 2]
    entries = sum(len(jaccard.unpack_arrays(b, 5)[2]) for _, b in back)
    assert entries == 2 * len(k) and all((jaccard.unpack_arrays(b, 5)[4] == heavy).all() for _, b in back)
    for f, name in ((0, 7 << 40), (1, 9 << 45)):
        raws = [b for g, b in rows if g == f]
        assert len(raws) == 1 and jaccard._merged(raws)[4].tolist() == [name]
    assert len(jaccard._merged([b for f, b in rows if f == 0])[2]) == len(k)


def test_jaccard_of_a_passage_that_most_texts_share(spark):
    from test_queries import brute_components

    rng = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    passage = " ".join(rng.choice(words) for _ in range(6))
    rows = [(i, f"{passage} " + " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(1500)]
    rows += [(2000 + i, rows[i][1] + f" {words[i]}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = jaccard.near_duplicates(df, n=4, t=(85, 100))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, 4, 85, 100)


def test_longest_match_of_each_document_against_brute_force(spark):
    rng = random.Random(14)
    words = "ab c d e".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(25))) for _ in range(40)] + ["zzz", ""]
    items = [(f"i{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for i in range(8)]
    docs = spark.createDataFrame([(i, t, {"k": i}) for i, t in enumerate(texts)], "doc_id bigint, text string, m map<string,int>")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (1 << 20, 60):
        got = {r.doc_id: r for r in decontamination.find_contamination(docs, bench, window=5, block_bytes=block).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            w, best = t.split(), 0
            covered, hit = set(), set()
            for name, text in items:
                v = text.split()
                k = min(5, len(v))
                for p in range(len(w)):
                    for q in range(len(v)):
                        n = 0
                        while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                            n += 1
                        best = max(best, n)
                        if n >= k and q + k <= len(v):
                            covered |= set(range(p, p + k))
                            hit.add(name)
            x = got[i].longest
            assert (x.words if x else 0) == best and got[i].n_hit == len(covered) and got[i].hit_items == sorted(hit)
            if x:
                item = dict(items)[x.item_id].split()
                assert w[x.doc_pos : x.doc_pos + best] == item[x.item_pos : x.item_pos + best]


def test_items_that_share_their_windows_are_searched_once():
    items = [(f"i{i:03d}", b"same words") for i in range(400)] + [("other", b"same words and more")]
    test = decontamination.TestSet(items, 13)
    assert len(test.window_start) == 2
    n, spans, names, longest = decontamination._scan_texts([b"same words " * 20_000, None, b"x same words and more"], test)
    assert n == [40_000, 0, 5] and spans[0] == [{"start": 0, "end": 40_000}] and len(names[0]) == 400 and longest[0]["words"] == 2
    assert names[2] == [*sorted(i for i, _ in items)] and longest[2] == {"words": 4, "item_id": "other", "item_pos": 0, "doc_pos": 1} and longest[1] is None


def test_every_language_is_learnt(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 30, f"l{i % 300:03d}", 7, 7.0) for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, _lang int, _share double")
    model = language.fit(docs, sample=600)
    assert len(model.languages) == 300
    with pytest.raises(ValueError, match="languages"):
        language.fit(docs.withColumn("lang", F.concat("lang", F.col("doc_id").cast("string"))).crossJoin(spark.range(3)).withColumn("lang", F.concat("lang", F.col("id").cast("string"))), sample=10)


def test_hostile_pages_take_linear_time():
    import time

    def took(text):
        began = time.process_time()
        page = html.Page(text)
        return time.process_time() - began, page

    for text in ("<a '" * 100_000, "<a '" * 50_000 + ">" * 50_000, "<a \">" * 100_000, "<div>" * 100_000, "</div><p>x" * 50_000, "<!--" * 100_000, "<" * 300_000, "<div>" * 50_000 + "</section>" * 50_000, "<b '" + "\"'" * 100_000 + ">x"):
        spent, page = took(text)
        assert spent < 5, text[:20]
    assert [b[1] for b in html.Page("<script>if (a<b) x = '</b>'; y = \"'</script><p>one 'two'<style>p>a{'</style><p>three 'four'").blocks] == ["one 'two'", "three 'four'"]
    assert [b[1] for b in html.Page("<div>one</div><!-- no --><a title='x > y'>two</a><p class=\"a\">three<?php x ?> four<div open 'x>five</div> 1 < 2").blocks] == ["one", "two", "three four", "five", "1 < 2"]


def test_warc_of_long_payloads_hot_digests_and_other_columns(spark):
    rng = random.Random(3)
    long = "".join(chr(rng.randrange(33, 1000)) for _ in range(700_000))
    rows = [(i, "u", "e" * 1500) for i in range(40)] + [(100, "u", long), (101, None, long + "x")] + [(200 + i, "u", "short") for i in range(5)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit(1)).withColumn("_salt", F.lit(2)).withColumn("digest", F.lit(3))
    want = sorted((i, len(h.encode()), "revisit" if i < 39 else "response", 39 if i < 39 else None) for i, _, h in rows)
    before = warc.BROADCAST_DIGESTS
    try:
        for warc.BROADCAST_DIGESTS in (before, 0):
            got = warc.round_trip(pages, split_bytes=100_000, payloads=True).collect()
            assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == want
            assert {bytes(r.payload) for r in got if r.page_id == 100} == {long.encode()}
    finally:
        warc.BROADCAST_DIGESTS = before


def brute_replies(rows):
    """conv, turn -> (reply_to, n_quoted, n_linked, depth), message by message."""
    import re

    def lines(text):
        for x in re.split("\r?\n", text or ""):
            marks = re.match(r"[ \t]*((?:>[ \t]?)*)", x)
            level = marks[1].count(">")
            yield level, " ".join((x[marks.end():] if level else x).lower().split())

    says, quotes = {}, {}
    for conv, turn, _, text in rows:
        says.setdefault((conv, turn), []).append(" ".join(s for lv, s in lines(text) if lv == 0 and s))
        run = None
        for lv, s in lines(text):
            if lv and s and run and run[0] == lv:
                run[1] += f" {s}"
            elif lv and s:
                run = [lv, s]
                quotes.setdefault((conv, turn), []).append(run)
            else:
                run = None
    places = {}
    for conv, turn, *_ in rows:
        places.setdefault(conv, set()).add(turn)
    out, direct = {}, {}
    for conv, turns in places.items():
        before = None
        for turn in sorted(turns):
            votes, linked = {}, 0
            for lv, s in quotes.get((conv, turn), ()):
                origin = min((t for t in turns if t < turn and any(f" {s} " in f" {x} " for x in says[conv, t])), default=None)
                if origin is not None:
                    linked += 1
                    votes[lv, origin] = votes.get((lv, origin), 0) + len(s.split())
            to = before
            if votes:
                lv, origin = max(votes, key=lambda k: (-k[0], votes[k], k[1]))
                if lv == 1:
                    direct[conv, turn] = to = origin
                else:
                    to = max((t for t in turns if t < turn and direct.get((conv, t)) == origin), default=origin)
            out[conv, turn] = (to, len(quotes.get((conv, turn), ())), linked, 0 if to is None else out[conv, to][3] + 1)
            before = turn
    return out


def test_quoted_mail_against_brute_force_and_sql(spark):
    import duckdb
    from oracle import rows_of, rows_of_sql

    from quarrybed.llm.queries import ORACLE_SQL

    rng = random.Random(21)
    words = [f"w{i}" for i in range(25)]
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rng.randrange(1, 9)):
            text = []
            for _ in range(rng.randrange(0, 3) if said else 0):
                t = rng.choice(said)
                a = rng.randrange(len(t))
                piece = t[a : a + rng.randrange(1, 9)]
                if rng.random() < 0.15:
                    piece = [*piece, "changed"]
                level, cut = rng.choice([1, 1, 1, 2, 3]), rng.randrange(1, 5)
                text += ["> " * level + " ".join(piece[i : i + cut]).upper() for i in range(0, len(piece), cut)] + rng.choice([[], [">"], [""], ["  "]])
            own = [rng.choice(words) for _ in range(rng.randrange(0, 14))]
            said.append(own or ["none"])
            text += [" ".join(own[i : i + 5]) for i in range(0, len(own), 5)]
            rows.append((conv if conv else None, turn * 2, rng.choice(["user", "assistant"]), rng.choice(["\n", "\r\n"]).join(text) or None))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("n_quoted", F.lit(5)).withColumn("_c", F.lit(1))
    out = chat.format_conversations(df)
    want = brute_replies(rows)
    got = {(r.conv_id, r.turn): (r.reply_to, r.n_quoted, r.n_linked, r.depth) for r in out.collect()}
    assert got == want and sum(w[2] for w in want.values()) > 20 and any(w[0] is not None and w[0] < t - 2 for (_, t), w in want.items())
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert rows_of(out) == rows_of_sql(con, ORACLE_SQL["op8_chat_formatting"])


def test_chat_with_null_turns(spark):
    rows = [(1, None, "a", "x"), (1, 0, "b", "y"), (1, 1, "a", "> y\nz"), (2, None, None, None)]
    got = {(r.conv_id, r.turn): (r.reply_to, r.depth, r.position) for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got == {(1, None): (None, 0, 0), (1, 0): (None, 0, 1), (1, 1): (0, 1, 2), (2, None): (None, 0, 0)}


def test_pipeline_stages_with_nulls_repeats_and_empty_tables(spark, sf_dir):
    import corpus_pipeline as C

    good = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id"), "doc_id").where("length(text) between 600 and 3000").limit(3)
    rows = [tuple(r) for r in good.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    made = [*rows, rows[0], rows[0], (None, rows[1][1], None, None, None), (None, None, None, None, None), (7, "", None, None, 0), (8, "x", None, None, 1), (9, "word " * 30_000, None, None, 1)]
    docs = spark.createDataFrame(made, DOCS).select("*", F.lit(1).alias("score"), F.lit(2).alias("k"), F.lit(3).alias("longest"), F.lit(4).alias("fail_bits"))
    for name, stage in C.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert len(docs.columns) == 9, name
    kept = docs.collect()
    assert len({r.text for r in kept}) == len(kept) <= 3 and all(r.text in {x[1] for x in rows} for r in kept) and kept
    pieces = C.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in kept}
    empty = docs.limit(0)
    for name, stage in C.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name


def test_calibration_of_classes_that_hardly_overlap():
    rng = np.random.default_rng(3)
    for gap, n in ((0.05, 200), (1.0, 5000), (8.0, 100_000), (8.0, 40)):
        at = np.concatenate([rng.normal(-gap, 1, n), rng.normal(gap, 1, 6 * n)])
        y = np.repeat([0.0, 1.0], [n, 6 * n])
        bins, index = np.unique(np.stack([np.round(at, 1), y]), axis=1, return_inverse=True)
        c = np.bincount(index.ravel()).astype(float)
        w = quality.logistic_line(bins[0], bins[1], c)
        loss = lambda w: (c * (np.logaddexp(0, bins[0] * w[0] + w[1]) - bins[1] * (bins[0] * w[0] + w[1]))).sum() + 5e-4 * (w @ w)  # noqa: E731, B023
        assert w[0] > 0 and all(loss(w) <= loss(w + d) + 1e-6 for d in rng.normal(0, 0.2, (300, 2)))
        if gap == 8.0:
            p = 1 / (1 + np.exp(-(bins[0] * w[0] + w[1])))
            assert ((p >= 0.3) == bins[1]).all()


def test_dealing_keeps_no_words(monkeypatch):
    class Rows:  # a table that runs its function here
        sparkSession = columns = None

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run
            return self

    import pyarrow as pa

    rows = Rows()
    monkeypatch.setattr(jaccard, "small_batches", lambda spark: None)
    monkeypatch.setattr(jaccard.F, "col", lambda c: rows)
    monkeypatch.setattr(Rows, "alias", lambda self, _: self, raising=False)
    jaccard._dealt(rows, 2, jaccard.Keys(), 1, 1, "text")
    batch = pa.RecordBatch.from_arrays([pa.array(["one two three", "four five"], pa.string())], names=["text"])
    assert len(list(rows.run(iter([batch])))) == 1 and len(jaccard._hashes) == 0
