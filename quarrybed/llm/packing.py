"""Packing by shortest-pack-first over the length histogram.

Executors tokenise each text once and cut it at multiples of the sequence length, which gives pieces with their
lengths and checksums. Only the histogram of lengths (at most max_tokens rows) reaches the driver: lengths are placed
longest first, each into the shortest packs that still take it, by pattern (a list of lengths and how many packs
look like that). Patterns then go back to the documents by rank: pieces of one length are numbered without gaps, and
an interval table says in which sequence, and where, number r of that length lies.

Edge cases: null and empty texts are one piece that holds the end id only; a very long text is cut into full
sequences and a rest; repeated rows are packed each; a null doc_id stays null; pieces of equal length are ordered by
(doc_id, start, crc), within buckets where they are many; an empty table gives no pieces; other columns, whatever their
names, are left out of the pieces.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, persist_shared, texts_of

#: How the vocabulary's pre-tokenizer cuts plain text, that is lower-cased characters up to U+024F without some
#: that it or the lower case treats in other ways.
CUT = re.compile(r"[a-zªµºÀ-ÖØ-öø-ʯⱥⱦ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9²³¹¼½¾]|[^a-z0-9\sªµºÀ-ÖØ-öø-ʯⱥⱦ²³¹¼½¾]+")
ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u012f\u0131-\u024f]")
CACHE = 600_000


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes are themselves, the
    others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    rest = (b for b in range(256) if b not in out)
    return out | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """The word tokenizer of a tokenizers file, with a bounded cache of words and of words with their signs.

    Words of plain characters go straight to the merges; a text with others, or with the content of an added token,
    goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = self.whole.get_added_tokens_decoder().values()
        names = [r"\s+".join(map(re.escape, t.content.split())) for t in added if t.content.strip()]
        self.added = re.compile("|".join(names), re.I if any(t.normalized for t in added) else 0) if names else None
        self.model = self.whole.model
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}

    def _kept(self, key: str, ids: bytes) -> bytes:
        if len(self.words) >= CACHE:
            # the older half goes: entries come in order of their first use
            for old in list(islice(self.words, CACHE // 2)):
                del self.words[old]
        self.words[key] = ids
        return ids

    def _word(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()
        ids = [t.id for t in self.model.tokenize(word if plain else "".join(map(self.letters.__getitem__, word.encode())))]
        return self._kept(word, struct.pack(f"<{len(ids)}I", *ids))

    def _chunk(self, chunk: str) -> bytes:
        """A stretch without white space: a word, or words and signs."""
        parts = CUT.findall(chunk)
        if len(parts) == 1:
            return self._word(chunk)
        get, make = self.words.get, self._word
        ids = b"".join([get(w) or make(w) for w in parts])
        return self._kept(chunk, ids) if len(chunk) < 64 else ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if ODD.search(text) or (self.added and self.added.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        get, make = self.words.get, self._chunk
        return b"".join([get(c) or make(c) for c in text.lower().split()])


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def token_pieces(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, max_tokens: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids with the end id, cut at multiples of max_tokens."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tok = tokenizer(tokenizer_path)
        out: list[tuple] = []
        for key, raw in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
            ids = (tok.encode(raw.decode()) if raw else b"") + end
            n, step = len(ids) // 4, max_tokens * 4
            out += [(key, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at : at + step]), n) for at in range(0, len(ids), step)]
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_texts(rows, "text", T._parse_datatype_string(PIECES), work, 2 << 20)


def shortest_pack_first(histogram: dict[int, int], max_tokens: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order of placement, packs that look like that).

    Equal to placing pieces one by one, longest first, each into the shortest pack that takes it, and opening a pack
    only if none does; a pattern stands for all its packs, so the work follows the lengths, not the pieces.
    """
    open_: list[tuple[int, int, tuple, int]] = []  # (tokens, order of entry, runs of (length, times), packs)
    done: list[tuple[tuple, int]] = []
    entered = 0

    def push(tokens: int, runs: tuple, packs: int, smallest: int) -> None:
        nonlocal entered
        if packs <= 0:
            return
        entered += 1
        if tokens + smallest > max_tokens:
            done.append((runs, packs))
        else:
            heapq.heappush(open_, (tokens, entered, runs, packs))

    def grown(runs: tuple, length: int, times: int) -> tuple:
        if runs and runs[-1][0] == length:
            return (*runs[:-1], (length, runs[-1][1] + times))
        return (*runs, (length, times))

    smallest = min(histogram, default=1)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_ and open_[0][0] + length <= max_tokens:
                tokens, _, runs, packs = heapq.heappop(open_)
                nxt = open_[0][0] if open_ else max_tokens
                # rounds in which these packs stay the shortest that fit
                fit = (max_tokens - tokens) // length
                rounds = max(1, min(fit, -(-(nxt - tokens) // length) if nxt > tokens else 1))
                full = min(rounds, left // packs)
                if full:
                    left -= full * packs
                    push(tokens + full * length, grown(runs, length, full), packs, smallest)
                else:
                    push(tokens + length, grown(runs, length, 1), left, smallest)
                    push(tokens, runs, packs - left, smallest)
                    left = 0
            else:
                fit = max_tokens // length
                push(fit * length, ((length, fit),), left // fit, smallest)
                if left % fit:
                    push(left % fit * length, ((length, left % fit),), 1, smallest)
                left = 0
    done += [(runs, packs) for _, _, runs, packs in open_]
    return done


def intervals(patterns: list[tuple[tuple, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: (first rank, packs, first sequence, offset, times in a row) of its places, by rank.

    Ranks [first, first + packs * times) of a length go to sequences first_sequence + (r - first) // times.
    """
    used: dict[int, int] = defaultdict(int)
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    sequence = 0
    for runs, packs in patterns:
        offset = 0
        for length, times in runs:
            rows[length].append((used[length], sequence, offset, times))
            used[length] += packs * times
            offset += length * times
        sequence += packs
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}


#: Pieces of one length that a task ranks at a time, about.
BUCKET_ROWS = 500_000


def pack(pieces: DataFrame, *, max_tokens: int = 4096, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """pieces with sequence_id and offset; sequence ids and the offsets in a sequence have no gaps."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # max_tokens rows at most
    places = spark.sparkContext.broadcast(intervals(shortest_pack_first({r.length: r.n for r in counts}, max_tokens)))
    # ranks without gaps within a length: ranked in hash buckets, as many as its pieces ask for, shifted by the buckets before
    asked = {r.length: max(-(-r.n // bucket_rows), min(256, -(-r.n // 16))) for r in counts}
    buckets = F.element_at(F.create_map(*[F.lit(x) for pair in asked.items() for x in pair]), F.col("length")) if asked else F.lit(1)
    keyed = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), buckets.cast("bigint")))
    rank = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "start", "ids_crc32")) - 1
    sizes = keyed.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("length").alias("_l"), F.col("_b").alias("_lb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    ranked = keyed.withColumn("_r", rank).join(starts, (F.col("length") == F.col("_l")) & (F.col("_b") == F.col("_lb")))
    ranked = ranked.select(*pieces.columns, (F.col("_at") + F.col("_r")).cast("bigint").alias("_rank"))
    width = len(pieces.columns)
    schema = T.StructType(list(pieces.schema.fields)).add("sequence_id", T.LongType()).add("offset", T.LongType())

    names = schema.names

    def place(batches):
        table = places.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            r = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            seq, off = np.zeros(len(r), dtype=np.int64), np.zeros(len(r), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(length[order])) + 1, [len(order)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows = order[a:b]
                n = int(length[rows[0]])
                first, sequence, offset, times = table[n]
                i = np.searchsorted(first, r[rows], side="right") - 1
                within = r[rows] - first[i]
                seq[rows] = sequence[i] + within // times[i]
                off[rows] = offset[i] + within % times[i] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(seq), pa.array(off)], names=names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, max_tokens: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    pieces = token_pieces(docs, tokenizer_path, end_id=end_id, max_tokens=max_tokens, doc_id=doc_id, text=text)
    # two consumers, the histogram and the ranks: tokenise once
    return pack(persist_shared(pieces, "pieces"), max_tokens=max_tokens)
