"""Benchmark decontamination with suffix arrays over the training text.

Each task cuts its documents into shards of a few MB and builds a word-level suffix array per shard (prefix
doubling in numpy). Every test suffix is binary-searched in every shard. Its place in the array tells, for the training
suffixes around it, the longest verbatim match and where it is; the range of training suffixes that start with a whole
window gives all occurrences of that window. Windows that several items share are searched once.
The array is sparse: only positions whose word some test text holds can start a match, and any other word
ends a suffix, so nothing that could match is left out.

The training text is never shuffled. The test set is broadcast in blocks of at most BLOCK_BYTES of text, read one at a
time; with several blocks the documents pass through one scan after the other, which adds its hits to those before.

Edge cases: null and empty texts have no words (n_words 0, no hits); repeated rows each get their own result; an
item without words has no windows; an item shorter than the window is one window; an empty test set hits nothing; very
long texts are a shard of their own, and what a shard needs grows with its words, however many items share its windows;
input columns named like an output are replaced by it, and filters return rows as they were, maps and nested columns too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, map_texts, persist_shared, restored, sheltered, texts_of, without

BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
DOC_END = b"\x01"

#: ASCII letters are lower-cased; all other ASCII characters but digits separate words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class TestSet:
    """The packed suffixes of one block of test items. Word 0 ends a text."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.window = window
        vocab: dict[bytes, int] = {}
        ids, starts, self.names = [], [], []
        for name, text in items:
            found = words_of(text)
            if not found:
                continue
            starts.append((len(ids), len(found)))
            self.names.append(name)
            ids.extend(vocab.setdefault(w, len(vocab) + 1) for w in found)
            ids.append(0)
        self.vocab = vocab
        self.bits = max(1, len(vocab).bit_length())
        self.k = max(1, 63 // self.bits)
        self.ids = np.array(ids, dtype=np.int64)
        self.keys = packed(self.ids, self.bits, self.k)
        # every suffix of every item: where it starts, its item and its length
        self.suffix = np.flatnonzero(self.ids > 0)
        self.item = np.concatenate([np.full(n, i) for i, (_, n) in enumerate(starts)]) if starts else np.zeros(0, int)
        self.left = np.concatenate([np.arange(n, 0, -1) for _, n in starts]) if starts else np.zeros(0, int)
        lengths = np.array([n for _, n in starts], dtype=np.int64)
        full = np.minimum(lengths[self.item], window) if starts else np.zeros(0, int)
        self._windows(full)
        self.first = np.array([at for at, _ in starts], dtype=np.int64)
        # the test suffixes in order
        self.order = Shard(self.ids, self).sa if len(self.ids) else np.zeros(0, dtype=np.int64)
        self.item_at = np.full(len(self.ids), -1, dtype=np.int64)
        self.item_at[self.suffix] = self.item

    def _windows(self, full: np.ndarray) -> None:
        """The distinct windows: where one of each starts, its length, and the items that hold it."""
        found: dict[bytes, int] = {}
        start, length, items = [], [], []
        for i in np.flatnonzero(self.left >= full).tolist():
            at, n = int(self.suffix[i]), int(full[i])
            key = self.ids[at : at + n].tobytes()
            w = found.setdefault(key, len(found))
            if w == len(start):
                start.append(at)
                length.append(n)
                items.append([])
            if not items[w] or items[w][-1] != self.item[i]:
                items[w].append(int(self.item[i]))
        self.window_start, self.window_length = np.array(start, dtype=np.int64), np.array(length, dtype=np.int64)
        self.window_items = items


def packed(ids: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The next k words at each position in one integer; words after the end of a text count as 0."""
    padded = np.concatenate([ids, np.zeros(k, dtype=np.int64)])
    n, out, word = len(ids), np.zeros(len(ids), dtype=np.int64), None
    for j in range(k):
        step = padded[j : j + n]
        word = step if word is None else np.where(word > 0, step, 0)
        out = (out << bits) | word
    return out


class Shard:
    """A sparse suffix array over the word ids of some documents."""

    def __init__(self, ids: np.ndarray, test: TestSet):
        self.bits, self.k = test.bits, test.k
        self.keys = packed(ids, self.bits, self.k)
        at = np.flatnonzero(ids > 0)
        order = at[np.argsort(self.keys[at], kind="stable")]
        self.sa = self._refined(order, len(ids))
        self.first = self.keys[self.sa]

    def _refined(self, sa: np.ndarray, n: int) -> np.ndarray:
        """Prefix doubling: tied suffixes that go on are ordered by the rank of what follows."""
        if not len(sa):
            return sa
        rank = np.zeros(n + 1, dtype=np.int64)
        key = self.keys[sa]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.maximum.accumulate(np.where(head, np.arange(len(sa)), 0))
        rank[sa] = start + 1
        last = (1 << self.bits) - 1
        tied = np.zeros(len(sa), dtype=bool)
        tied[1:] |= ~head[1:]
        tied[:-1] |= ~head[1:]
        slots = np.flatnonzero(tied & ((key & last) > 0))
        h = self.k
        while len(slots):
            pos = sa[slots]
            group, after = rank[pos], rank[np.minimum(pos + h, n)]
            by = np.lexsort((after, group))
            pos, group, after = pos[by], group[by], after[by]
            sa[slots] = pos
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
            head = np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))
            rank[pos] = slots[head] + 1
            same = np.zeros(len(pos), dtype=bool)
            same[1:] |= ~new[1:]
            same[:-1] |= ~new[1:]
            slots = slots[same & (after > 0)]
            h *= 2
        return sa

    def _bound(self, lo, hi, depth, key, mask, right: bool):
        """Vectorised bisection in [lo, hi) on the packed words `depth` further on."""
        lo, hi = lo.copy(), hi.copy()
        last = len(self.keys) - 1
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            at = self.sa[mid] + depth
            there = np.where(at <= last, self.keys[np.minimum(at, last)], 0) & mask[open_]
            go = there <= key[open_] if right else there < key[open_]
            lo[open_[go]] = mid[go] + 1
            hi[open_[~go]] = mid[~go]

    def ranges(self, test: TestSet, suffix: np.ndarray, length: np.ndarray):
        """For each test suffix the range of training suffixes that share its first `length` words."""
        lo, hi = np.zeros(len(suffix), dtype=np.int64), np.full(len(suffix), len(self.sa), dtype=np.int64)
        depth, live = 0, np.arange(len(suffix))
        while len(live):
            words = np.minimum(length[live] - depth, self.k)
            mask = ~((np.int64(1) << ((self.k - words) * self.bits)) - 1)
            key = test.keys[np.minimum(suffix[live] + depth, len(test.keys) - 1)] & mask
            a = self._bound(lo[live], hi[live], depth, key, mask, False)
            hi[live] = self._bound(a, hi[live], depth, key, mask, True)
            lo[live] = a
            depth += self.k
            live = live[(lo[live] < hi[live]) & (length[live] > depth)]
        return lo, hi

    def insertion(self, test: TestSet) -> np.ndarray:
        """How many training suffixes come before each test suffix, in the order of these."""
        n = len(test.order)
        out, lo, hi = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.full(n, len(self.sa), dtype=np.int64)
        depth, live, every = 0, np.arange(n), np.int64(-1)
        while len(live):
            key = test.keys[test.order[live] + depth]
            mask = np.full(len(live), every)
            a = self._bound(lo[live], hi[live], depth, key, mask, False)
            b = self._bound(a, hi[live], depth, key, mask, True)
            out[live], lo[live], hi[live] = a, a, b
            goes_on = (key & ((1 << self.bits) - 1)) > 0
            live = live[(a < b) & goes_on]
            depth += self.k
            live = live[test.order[live] + depth < len(test.keys)]
        return out

    def common(self, test: TestSet, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Words that the training suffixes at `mine` and the test suffixes at `theirs` have in common."""
        out, live, depth = np.zeros(len(mine), dtype=np.int64), np.arange(len(mine)), 0
        field = (1 << self.bits) - 1
        while len(live):
            x, y = mine[live] + depth, theirs[live] + depth
            a = np.where(x < len(self.keys), self.keys[np.minimum(x, len(self.keys) - 1)], 0)
            b = np.where(y < len(test.keys), test.keys[np.minimum(y, len(test.keys) - 1)], 0)
            diff, still, shared = a ^ b, np.ones(len(live), dtype=bool), np.zeros(len(live), dtype=np.int64)
            for j in range(self.k):
                shift = (self.k - 1 - j) * self.bits
                still &= (((diff >> shift) & field) == 0) & (((a >> shift) & field) > 0)
                shared += still
            out[live] += shared
            depth += self.k
            live = live[still]
        return out

    def nearest(self, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
        """For each training suffix, in the array's order, the words of its longest match with any test suffix and where
        that starts: the best match of a suffix is one of its two neighbours among the test suffixes."""
        n = len(self.sa)
        best, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        if not n or not len(test.order):
            return best, place
        after = np.searchsorted(self.insertion(test), np.arange(n), side="right")
        for neighbour in (after - 1, after):
            ok = np.flatnonzero((neighbour >= 0) & (neighbour < len(test.order)))
            theirs = test.order[neighbour[ok]]
            length = self.common(test, self.sa[ok], theirs)
            more = length > best[ok]
            best[ok[more]], place[ok[more]] = length[more], theirs[more]
        return best, place

    def longest(self, test: TestSet):
        """(length, place) of the longest verbatim match of every test suffix in this shard."""
        n = len(test.suffix)
        best, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        if not len(self.sa) or not n:
            return best, place
        lo, hi = np.zeros(n, dtype=np.int64), np.full(n, len(self.sa), dtype=np.int64)
        depth, live = 0, np.arange(n)
        whole = lambda m: np.full(m, -1, dtype=np.int64)
        while len(live):
            key = test.keys[np.minimum(test.suffix[live] + depth, len(test.keys) - 1)]
            a = self._bound(lo[live], hi[live], depth, key, whole(len(live)), False)
            for cand in (a - 1, a):
                ok = np.flatnonzero((cand >= lo[live]) & (cand < hi[live]))
                pos = self.sa[cand[ok]]
                at = np.minimum(pos + depth, len(self.keys) - 1)
                there = np.where(pos + depth < len(self.keys), self.keys[at], 0)
                diff = there ^ key[ok]
                shared = np.zeros(len(ok), dtype=np.int64)
                still = np.ones(len(ok), dtype=bool)
                for j in range(self.k):
                    shift = (self.k - 1 - j) * self.bits
                    field = (1 << self.bits) - 1
                    still &= (((diff >> shift) & field) == 0) & (((key[ok] >> shift) & field) > 0)
                    shared += still
                better = depth + shared > best[live[ok]]
                best[live[ok][better]] = depth + shared[better]
                place[live[ok][better]] = pos[better]
            b = self._bound(a, hi[live], depth, key, whole(len(live)), True)
            lo[live], hi[live] = a, b
            depth += self.k
            live = live[(a < b) & (test.left[live] > depth)]
        return best, place


def _shard_ids(texts: list[bytes | None], test: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """Word ids with a 0 after each document, and where the documents end."""
    glue = b" " + DOC_END + b" "
    words = (glue.join([t.translate(FOLD) if t else b"" for t in texts]) + glue).split()
    lookup = dict(test.vocab)
    lookup[DOC_END] = -1
    ids = np.fromiter(map(lookup.get, words, repeat(0)), dtype=np.int64, count=len(words))
    ends = np.flatnonzero(ids < 0)
    ids[ends] = 0
    return ids, ends


def _scan_texts(texts: list[bytes | None], test: TestSet):
    """Per document: words, merged hit spans [start, end), the items hit, and its longest match."""
    ids, ends = _shard_ids(texts, test)
    begins = np.concatenate([[0], ends[:-1] + 1])
    spans: list[list[dict]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    longest: list[dict | None] = [None] * len(texts)
    shard = Shard(ids, test)
    if len(test.window_start) and len(shard.sa):
        lo, hi = shard.ranges(test, test.window_start, test.window_length)
        found = np.flatnonzero(lo < hi)
        count = (hi - lo)[found]
        if len(found):
            # a place starts one window of each length at most
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            pos = shard.sa[np.repeat(lo[found], count) + offset]
            width = np.repeat(test.window_length[found], count)
            doc = np.searchsorted(ends, pos)
            edge = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(edge, pos, 1)
            np.add.at(edge, pos + width, -1)
            inside = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
            ups, downs = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
            for d, a, b in zip(np.searchsorted(ends, ups).tolist(), ups.tolist(), downs.tolist(), strict=True):
                base = int(begins[d])
                spans[d].append({"start": a - base, "end": b - base})
            held: dict[int, set[int]] = {}
            pairs = np.unique(doc * np.int64(len(test.window_start)) + np.repeat(found, count))
            for d, w in zip((pairs // len(test.window_start)).tolist(), (pairs % len(test.window_start)).tolist(), strict=True):
                held.setdefault(d, set()).update(test.window_items[w])
            for d, codes in held.items():
                items[d] = [test.names[c] for c in sorted(codes)]
        _longest_of(shard, test, begins, ends, longest)
    return (ends - begins).tolist(), spans, items, longest


def _longest_of(shard: Shard, test: TestSet, begins: np.ndarray, ends: np.ndarray, out: list) -> None:
    """Each document's longest match; of equal ones the first."""
    length, place = shard.nearest(test)
    doc = np.searchsorted(ends, shard.sa)
    order = np.lexsort((shard.sa, -length, doc))
    first = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])] if len(order) else order
    for r in first[length[first] > 0].tolist():
        d, at = int(doc[r]), int(place[r])
        item = int(test.item_at[at])
        out[d] = {"words": int(length[r]), "item_id": test.names[item], "item_pos": at - int(test.first[item]), "doc_pos": int(shard.sa[r] - begins[d])}


def test_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """The test items in blocks of bounded size, one at a time."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t") + 32)).first()[0] or 0
    n = -(-size // block_bytes) or 1
    part = lambda b: rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
    for b in range(n):
        yield [(r.i, r.t.encode() if r.t is not None else None) for r in part(b).collect()]


test_blocks.__test__ = False

SPANS = "array<struct<start:bigint,end:bigint>>"
LONGEST = "struct<words:bigint,item_id:string,item_pos:bigint,doc_pos:bigint>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
LONGEST_TYPE = pa.struct([("words", pa.int64()), ("item_id", pa.string()), ("item_pos", pa.int64()), ("doc_pos", pa.int64())])
#: Scans that follow each other without the rows being written in between.
SCANS = 4


def joined_spans(spans: list[dict]) -> list[dict]:
    """Spans in order, those that overlap or touch made one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if out and out[-1]["end"] >= s["start"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], s["end"])}
        else:
            out.append(s)
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (merged word ranges), hit_items (sorted item ids) and longest: the words of the
    longest verbatim match with any item, that item, and where it starts in both (null without a common word)."""
    spark = docs.sparkSession
    docs = without(docs, "n_words", "n_hit", "hit_spans", "hit_items", "longest")
    width = len(docs.columns)
    schema = extended(docs.schema, ("n_words", "bigint"), ("hit_spans", SPANS), ("hit_items", "array<string>"), ("longest", LONGEST))

    def scan(rows: DataFrame, items, first: bool) -> DataFrame:
        held = spark.sparkContext.broadcast(TestSet(items, window))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, spans, names, longest = _scan_texts(texts_of(batch, text), held.value)
            if not first:
                before = [batch.column(width + i).to_pylist() for i in (1, 2, 3)]
                spans = [joined_spans([*x, *y]) if x and y else x or y for x, y in zip(before[0], spans, strict=True)]
                names = [sorted({*x, *y}) for x, y in zip(before[1], names, strict=True)]
                longest = [y if x is None or (y is not None and y["words"] > x["words"]) else x for x, y in zip(before[2], longest, strict=True)]
            cols = [pa.array(n, pa.int64()), pa.array(spans, SPAN_TYPE), pa.array(names, pa.list_(pa.string())), pa.array(longest, LONGEST_TYPE)]
            return pa.RecordBatch.from_arrays([*batch.columns[:width], *cols], names=schema.names)

        return map_texts(rows, text, schema, work, SHARD_BYTES)

    out = docs
    for i, items in enumerate(test_blocks(benchmark, item_id, item_text, block_bytes)):
        if i and i % SCANS == 0:
            out = persist_shared(out, "scanned")
        out = scan(out, items, i == 0)
    return out.withColumns(
        {
            "n_hit": F.expr("aggregate(hit_spans, 0L, (s, x) -> s + x.end - x.start)"),
            "hit_items": F.array_sort(F.array_distinct("hit_items")),
        }
    )


def with_verdict(found: DataFrame, ratio: int = 20) -> DataFrame:
    """contaminated: some word is hit and at least one in `ratio` words is."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * ratio >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """docs without the contaminated ones, columns unchanged."""
    found = with_verdict(find_contamination(sheltered(docs, text=text), benchmark, **options))
    return restored(found.where(~F.col("contaminated")))


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """For every test suffix its longest verbatim match over all shards: item_id, item_pos, length, doc_id, doc_pos.

    Ties go to the smallest (doc_id, doc_pos). Suffixes without any match are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    parts = None
    for items in test_blocks(benchmark, item_id, item_text, block_bytes):
        held = spark.sparkContext.broadcast(TestSet(items, 13))

        def work(batch, held=held):
            test, ids_col = held.value, batch.column(0).to_pylist()
            ids, ends = _shard_ids(texts_of(batch, "text"), test)
            length, place = Shard(ids, test).longest(test)
            hit = np.flatnonzero(length > 0)
            doc = np.searchsorted(ends, place[hit])
            begins = np.concatenate([[0], ends[:-1] + 1])
            first = np.concatenate([[0], np.flatnonzero(np.diff(test.item)) + 1]) if len(test.item) else np.zeros(0, int)
            pos = np.arange(len(test.item)) - first[test.item] if len(first) else np.zeros(0, int)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([test.names[i] for i in test.item[hit].tolist()], pa.string()),
                    pa.array(pos[hit], pa.int64()),
                    pa.array(length[hit], pa.int64()),
                    pa.array([ids_col[d] for d in doc.tolist()], pa.int64()),
                    pa.array(place[hit] - begins[doc], pa.int64()),
                ],
                names=["item_id", "item_pos", "length", "doc_id", "doc_pos"],
            )

        one = map_texts(rows, "text", _matches_schema(), work, SHARD_BYTES)
        parts = one if parts is None else parts.unionByName(one)
    best = F.min(F.struct((-F.col("length")).alias("n"), "doc_id", "doc_pos")).alias("b")
    return parts.groupBy("item_id", "item_pos").agg(best).select("item_id", "item_pos", (-F.col("b.n")).alias("length"), "b.doc_id", "b.doc_pos")


def _matches_schema():
    from pyspark.sql import types as T

    return T._parse_datatype_string("item_id string, item_pos bigint, length bigint, doc_id bigint, doc_pos bigint")
