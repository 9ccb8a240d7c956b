"""N-gram Jaccard join by vertical partitioning.

Equal sets are one class, keyed by a hash of the set. The shingles are put in a global order, rare ones first, and
the order is cut into fragments:

1. Each task deals its classes' shingles to fragments of the hash range, as sorted, compressed blocks; beyond `wide`
   fragments in two levels of about their root, so the number of blocks stays in proportion to the shingles. A
   fragment counts in how many classes each shingle occurs and keeps those of two or more. A shingle that HEAVY classes of
   one block share is frequent for sure: its entries go straight back to their classes and only its name goes on, so no
   fragment gathers a shingle that a large part of all texts share. Frequencies of HEAVY and more count the same.
2. Classes get their kept shingles back, in the global order (frequency, then place or hash). Shingles of one class only
   come first in that order, so a class whose prefix they fill can have no partner and leaves: most documents do.
3. Classes that share a prefix shingle are candidates. In each shingle's list the most central class (the one
   with the smallest share of own shingles) is paired with the others, a few rounds long; lists whose classes
   are by then in one component need no more pairs. What is left crosses components and is paired in full,
   so no link between components is lost and no list of near copies is expanded into all its pairs. Lists, hubs and
   labels are joined under SALTS salts, so one of them doesn't end up in one task.
4. The overlap of a pair is counted for each vertical fragment separately and summed per pair; links give components by
   smallest label, with pointers that double.

Blocks hold 56-bit shingle hashes. Class keys are 64-bit and checked against a second hash: of sets that share a key, all but
one get a new key, which is checked again; the table of these is tiny (one in 2^64 pairs of sets) and travels with the code.

Edge cases: null and empty texts, or texts without words, have an empty set (n_shingles 0) and link with nothing; a
text of fewer words than a shingle is one shingle of its own length; very long texts are one set like any other; repeated
rows are one class; ties in centrality go to the larger key; a null doc_id takes part and is ignored as smallest id; an
empty table gives an empty result; other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_texts, persist_shared, restored, sheltered, small_batches, texts_of

#: ASCII letters are lower-cased; ASCII white space separates words.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CACHE = 200_000
BLOCK_SHINGLES = 1_500_000
FRAGMENT_SHINGLES = 2_000_000
SEGMENTS = 4
ROUNDS = 2
BROADCAST_PAIRS = 250_000
MASK56 = np.uint64((1 << 56) - 1)
#: A code is the frequency, up to HEAVY, and 52 bits: fragment and place, or the shingle's hash where it is frequent.
HEAVY, CODE_BITS, PLACE_BITS = 1024, 52, 26
WIDE = 1024
SALTS = 64
#: Classes that get another key, at most; twice as many sets give four times as many, and 10^12 sets some 30,000.
REKEYED = 1_000_000


class _Hashes(dict):
    """Word to 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def forget() -> None:
    """A worker stays for later stages; the words it held and memory it has free do not."""
    _hashes.clear()
    pa.default_memory_pool().release_unused()


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_set(raw: bytes | None, n: int) -> np.ndarray:
    """The sorted distinct 56-bit hashes of a text's shingles."""
    words = raw.translate(LOWER).split() if raw else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + len(h)])
    return np.unique(h & MASK56)


def set_keys(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    import xxhash

    raw = s.tobytes()
    return (xxhash.xxh3_64_intdigest(raw) >> (64 - bits)) - (1 << 63), xxhash.xxh64_intdigest(raw, seed=1) - (1 << 63)


class Keys:
    """The key of a set: the first hash, or another one where two sets share it."""

    def __init__(self, bits: int = 64):
        self.bits, self.renamed = bits, {}

    def of(self, s: np.ndarray) -> int:
        k = set_keys(s, self.bits)
        return self.renamed.get(k, k[0]) if self.renamed else k[0]


def _planes(a: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, compressed; the planes that are all zero are left out."""
    import zstandard

    a = np.ascontiguousarray(a, dtype="<u8")
    used = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
    body = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :used].T).tobytes())
    return struct.pack("<IBI", len(a), used, len(body)) + body


def _unplanes(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    import zstandard

    n, used, size = struct.unpack_from("<IBI", raw, at)
    at += 9
    out = np.zeros((n, 8), dtype=np.uint8)
    if n and used:
        body = zstandard.ZstdDecompressor().decompress(raw[at : at + size], max_output_size=n * used)
        out[:, :used] = np.frombuffer(body, dtype=np.uint8).reshape(used, n).T
    return out.reshape(-1).view("<u8"), at + size


def pack_arrays(*arrays: np.ndarray) -> bytes:
    return b"".join(map(_planes, arrays))


def unpack_arrays(raw: bytes, count: int) -> list[np.ndarray]:
    out, at = [], 0
    for _ in range(count):
        a, at = _unplanes(raw, at)
        out.append(a)
    return out


def deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=np.zeros(1, dtype=a.dtype))


def class_table(docs: DataFrame, n: int, *, doc_id: str = "doc_id", text: str = "text", key_bits: int = 64) -> tuple[DataFrame, Keys]:
    """doc_id, k (class), n_shingles of each row, and the keys of sets."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("k bigint, k2 bigint, n_shingles bigint").fields])

    def work(batch):
        sets = [shingle_set(t, n) for t in texts_of(batch, "text")]
        found = [set_keys(s, key_bits) for s in sets]
        cols = [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "k", "k2", "n_shingles"])

    first = persist_shared(map_texts(rows, "text", fields, work), "classes")
    keys = Keys(key_bits)
    named, turn = first.withColumn("key", F.col("k")), 0
    while True:
        shared = named.groupBy("key").agg(F.min("k2").alias("_a"), F.max("k2").alias("_b")).where("_a <> _b")
        if not turn and shared.isEmpty():
            return first.drop("k2"), keys
        # of the sets under one key the one with the smallest second hash keeps it
        other = named.join(shared.select(F.col("key").alias("_k"), "_a"), F.col("key") == F.col("_k")).where("k2 <> _a").select("k", "k2").distinct()
        found = other.limit(REKEYED + 1).collect()
        if not found:
            return (first if not keys.renamed else persist_shared(named.drop("k").withColumnRenamed("key", "k"), "classes")).select("doc_id", "k", "n_shingles"), keys
        turn += 1
        if len(keys.renamed) + len(found) > REKEYED:
            raise ValueError("more sets share a key than the table of new keys may hold")
        keys.renamed |= {(r.k, r.k2): _other_key(r.k, r.k2, turn) for r in found}
        table = docs.sparkSession.createDataFrame([(k, k2, v) for (k, k2), v in keys.renamed.items()], "_k bigint, _k2 bigint, _new bigint")
        named = first.join(F.broadcast(table), (F.col("k") == F.col("_k")) & (F.col("k2") == F.col("_k2")), "left").withColumn("key", F.coalesce("_new", "k")).drop("_k", "_k2", "_new")


def _other_key(k: int, k2: int, turn: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(struct.pack("<qqq", k, k2, turn)) - (1 << 63)


# ---------------------------------------------------------------- fragments


def _edges(a: np.ndarray) -> list[int]:
    """Where runs of equal values start, and the end."""
    return [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)] if len(a) else [0]


def _bucket_rows(k: np.ndarray, size: np.ndarray, owner: np.ndarray, place: np.ndarray, df: np.ndarray, buckets: int, first: int):
    """(first + bucket, block) of entries that go back to their classes: owner indexes k and size."""
    bucket = (mixed(k) % np.uint64(buckets)).astype(np.int64)[owner]
    order = np.lexsort((owner, bucket))
    owner, place, df, bucket = owner[order], place[order], df[order], bucket[order]
    edges = _edges(bucket)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own, index = np.unique(owner[a:b], return_inverse=True)
        yield first + int(bucket[a]), pack_arrays(deltas(k[own]), size[own], index, place[a:b], df[a:b])


def _fragment_rows(k: np.ndarray, size: np.ndarray, shingle: np.ndarray, owner: np.ndarray, heavy: np.ndarray, cuts: np.ndarray, first: int, buckets: int, end: int):
    """(fragment, block) of distinct entries in order of their shingles; owner indexes k (sorted) and size.

    Fragments start at `cuts` and are numbered from `first`. The entries of shingles that HEAVY classes share here, or that
    `heavy` names, leave for their classes' buckets (numbered from `end`); their names go on, so that what other blocks
    hold of them is known to be frequent.
    """
    runs = _edges(shingle)
    starts, counts = np.array(runs[:-1], dtype=np.int64), np.diff(runs)
    many = shingle[starts[counts >= HEAVY]] if len(starts) else shingle[:0]
    heavy = np.union1d(heavy, many)
    if len(heavy):
        out = np.isin(shingle, heavy)
        yield from _bucket_rows(k, size, owner[out], (shingle[out] >> np.uint64(4)), np.full(int(out.sum()), HEAVY, dtype=np.uint64), buckets, end)
        shingle, owner = shingle[~out], owner[~out]
    at, named = np.searchsorted(shingle, cuts), np.searchsorted(heavy, cuts)
    for f in range(len(cuts) - 1):
        a, b = int(at[f]), int(at[f + 1])
        names = heavy[int(named[f]) : int(named[f + 1])]
        if a == b and not len(names):
            continue
        own, index = np.unique(owner[a:b], return_inverse=True)
        yield first + f, pack_arrays(deltas(k[own]), size[own], deltas(shingle[a:b]), index, deltas(names))


def _row(frag: int, block: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([frag], pa.int32()), pa.array([block], pa.binary())], names=["frag", "block"])


def _merged(raws: list[bytes]):
    """k (sorted), size, shingle, owner of the distinct entries of some blocks in order of their shingles, and the names of
    heavy ones."""
    ks, sizes, shingles, owners, heavies, base = [], [], [], [], [np.zeros(0, dtype=np.uint64)], 0
    for raw in raws:
        k, size, shingle, index, heavy = unpack_arrays(raw, 5)
        ks.append(np.cumsum(k, dtype=np.uint64))
        sizes.append(size)
        shingles.append(np.cumsum(shingle, dtype=np.uint64))
        owners.append(index.astype(np.uint32) + np.uint32(base))
        heavies.append(np.cumsum(heavy, dtype=np.uint64))
        base += len(k)
    k, first, inverse = np.unique(np.concatenate(ks), return_index=True, return_inverse=True)
    size, inverse = np.concatenate(sizes)[first], inverse.astype(np.uint32)
    del ks, sizes, first
    # each list goes before the next array is made
    owner = inverse[np.concatenate(owners)]
    del owners, inverse
    shingle = np.concatenate(shingles)
    del shingles
    order = np.lexsort((owner, shingle))
    shingle, owner = shingle[order], owner[order]
    del order
    new = np.ones(len(shingle), dtype=bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return k, size, shingle[new], owner[new], np.unique(np.concatenate(heavies))


def _dealt(docs: DataFrame, n: int, keys: Keys, fragments: int, least: int, text: str, wide: int = WIDE) -> DataFrame:
    """frag, block: shingles by fragment, with the classes they come from; from `fragments` on, entries that go straight to
    their classes' bucket. Sets under `least` are left out."""
    rows = docs.select(F.col(text).alias("text"))
    inner = 1 if fragments <= wide else -(-fragments // int(fragments**0.5))
    outer = -(-fragments // inner)
    width = (1 << 56) // (outer * inner) + 1
    coarse = np.minimum(np.arange(outer + 1, dtype=object) * (width * inner), 1 << 56).astype(np.uint64)

    def run(batches):
        from .common import pieces

        held: dict[int, np.ndarray] = {}
        size = 0
        for part in pieces(batches, "text", 4 << 20):
            for raw in texts_of(part, "text"):
                s = shingle_set(raw, n)
                if len(s) < least:
                    continue
                k = keys.of(s)
                if k in held:
                    continue
                held[k] = s
                size += len(s)
                if size >= BLOCK_SHINGLES:
                    yield from blocks(held)
                    held, size = {}, 0
        if held:
            yield from blocks(held)
        forget()

    def blocks(held):
        k = np.array(list(held), dtype=np.int64).view(np.uint64)
        by = np.argsort(k)
        sets = list(held.values())
        held.clear()
        sizes = np.array([len(sets[i]) for i in by], dtype=np.uint64)
        shingle = np.concatenate([sets[i] for i in by])
        del sets
        owner = np.repeat(np.arange(len(by), dtype=np.uint32), sizes.astype(np.int64))
        order = np.argsort(shingle)
        shingle, owner = shingle[order], owner[order]
        del order
        none = np.zeros(0, dtype=np.uint64)
        for f, block in _fragment_rows(k[by], sizes, shingle, owner, none, coarse, 0, outer * inner, outer * inner):
            yield _row(f, block)

    small_batches(docs.sparkSession)
    dealt = rows.mapInArrow(run, "frag int, block binary")
    if inner == 1:
        return dealt

    def again(batches):
        """Blocks of one coarse fragment at a time, merged up to a block's size and dealt to the fragments inside."""
        group, held, size = -1, [], 0
        for batch in batches:
            for f, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if f >= outer * inner:
                    yield _row(f, raw)
                    continue
                if held and (f != group or size >= BLOCK_SHINGLES * 9):
                    yield from finer(group, held)
                    held, size = [], 0
                group = f
                held.append(raw)
                size += len(raw)
        if held:
            yield from finer(group, held)

    def finer(group, held):
        cuts = np.minimum(np.arange(group * inner, (group + 1) * inner + 1, dtype=object) * width, 1 << 56).astype(np.uint64)
        for f, block in _fragment_rows(*_merged(held), cuts, group * inner, outer * inner, outer * inner):
            yield _row(f, block)

    # a coarse fragment is shared by several tasks, each of about 20 million entries
    shares = max(1, -(-fragments * FRAGMENT_SHINGLES // (outer * 20_000_000)))
    dealt = dealt.withColumn("_share", F.pmod(F.xxhash64("block"), F.lit(shares))).repartition(min(outer * shares, 100_000), "frag", "_share")
    return dealt.sortWithinPartitions("frag").select("frag", "block").mapInArrow(again, "frag int, block binary")


def _shared(dealt: DataFrame, fragments: int) -> DataFrame:
    """bucket, block: each class's shingles that other classes have too, as codes with their frequency."""

    def count(key, group):
        frag = key[0].as_py()
        raws = group.column("block").to_pylist()
        if frag >= fragments:
            out = [(frag - fragments, raw) for raw in raws]
        else:
            del group
            k, size, shingle, owner, heavy = _merged(raws)
            del raws
            runs = _edges(shingle)
            freq = np.diff(runs).astype(np.int64)
            unique = shingle[np.array(runs[:-1], dtype=np.int64)] if len(shingle) else shingle
            freq[np.isin(unique, heavy)] = HEAVY
            df = np.repeat(np.minimum(freq, HEAVY), np.diff(runs))
            place = np.repeat(np.arange(len(freq)), np.diff(runs)).astype(np.uint64) | np.uint64(frag << PLACE_BITS)
            place = np.where(df >= HEAVY, shingle >> np.uint64(4), place)
            del shingle
            keep = df > 1
            owner, place, df = owner[keep], place[keep], df[keep].astype(np.uint64)
            out = list(_bucket_rows(k, size, owner, place, df, fragments, 0))
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "block": pa.array([x for _, x in out], pa.binary())})

    return dealt.groupBy("frag").applyInArrow(count, "bucket int, block binary")


CLASS_FIELDS = "k bigint, size bigint, own bigint, seg int, codes binary"


def _survivors(shared: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Classes that can have partners: their prefix (seg -1) and their shared shingles by vertical segment.

    Codes in numeric order are in the global order.
    """
    num, den = t

    def gather(key, group):
        ks, sizes, owners, codes, base = [], [], [], [], 0
        for raw in group.column("block").to_pylist():
            k, size, index, place, df = unpack_arrays(raw, 5)
            ks.append(np.cumsum(k, dtype=np.uint64))
            sizes.append(size)
            owners.append(index.astype(np.int64) + base)
            codes.append((df << np.uint64(CODE_BITS)) | place)
            base += len(k)
        k, first, inverse = np.unique(np.concatenate(ks), return_index=True, return_inverse=True)
        size = np.concatenate(sizes)[first].astype(np.int64)
        owner, code = inverse[np.concatenate(owners)], np.concatenate(codes)
        order = np.lexsort((code, owner))
        owner, code = owner[order], code[order]
        # a class that came in several blocks got its frequent shingles from each
        new = np.ones(len(code), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
        owner, code = owner[new], code[new]
        have = np.bincount(owner, minlength=len(k))
        prefix = size - (-(-num * size // den)) + 1
        own = size - have
        ends = np.cumsum(have)
        out: list[tuple] = []
        for i in np.flatnonzero(own < prefix).tolist():
            mine = code[ends[i] - have[i] : ends[i]]
            kk = int(k[i : i + 1].view(np.int64)[0])
            out.append((kk, int(size[i]), int(own[i]), -1, mine[: prefix[i] - own[i]].tobytes()))
            seg = (mine >> np.uint64(PLACE_BITS)) % np.uint64(SEGMENTS)
            for g in range(SEGMENTS):
                part = mine[seg == g]
                if len(part):
                    out.append((kk, int(size[i]), int(own[i]), g, pack_arrays(deltas(part))))
        cols = list(zip(*out, strict=True)) or [[], [], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.table({n: pa.array(c, kind) for n, c, kind in zip(("k", "size", "own", "seg", "codes"), cols, kinds, strict=True)})

    return shared.groupBy("bucket").applyInArrow(gather, CLASS_FIELDS)


def _prefix_rows(classes: DataFrame) -> DataFrame:
    """shingle, k, size, own, pos: the lists of the prefix shingles. Own shingles come first in the order, so the place of
    the i-th shared one is own + i."""

    def run(batches):
        for batch in batches:
            codes = [np.frombuffer(x, dtype=np.int64) for x in batch.column(3).to_pylist()]
            if not codes:
                continue
            n = [len(c) for c in codes]
            rows = np.repeat(np.arange(len(n)), n)
            pos = np.concatenate([np.arange(x) for x in n]) + batch.column(2).to_numpy()[rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(codes)), *(batch.column(i).take(pa.array(rows)) for i in range(3)), pa.array(pos)],
                names=["shingle", "k", "size", "own", "pos"],
            )

    rows = classes.where(F.col("seg") == -1).select("k", "size", "own", "codes")
    return rows.mapInArrow(run, "shingle bigint, k bigint, size bigint, own bigint, pos bigint")


def _fits(t: tuple[int, int]):
    """The pair can reach the similarity, if this shingle is the first it shares: all it shares lies from here on in both
    orders. At a later shingle the bound is lower and may refuse the pair, which then came up at the first one."""
    most = F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb"))
    return (most * (t[0] + t[1]) >= (F.col("sa") + F.col("sb")) * t[0]) & (F.col("a") != F.col("b"))


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct unordered pairs a < b with both sizes."""
    turn = F.col("a") < F.col("b")
    pick = lambda x, y: F.when(turn, F.col(x)).otherwise(F.col(y))
    return rows.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("sa", "sb").alias("sa"), pick("sb", "sa").alias("sb")).dropDuplicates(["a", "b"])


def _salt(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")


def _used(salt: Column) -> Column:
    """The salts that occur, as bits of a number: a plain aggregate of fixed size."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), salt))


def _each_used(bits: str) -> Column:
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.col(bits).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != 0))


def _with_list(lists: DataFrame, *aggregates: Column, having: str) -> DataFrame:
    """lists with aggregates over each shingle's list, for the lists that `having` keeps.

    The aggregates come back once for each salt that a list uses, so the rows of a long list are joined in many tasks.
    """
    salted = lists.withColumn("_salt", _salt("k"))
    per = salted.groupBy("shingle").agg(*aggregates, _used(F.col("_salt")).alias("_bits")).where(having)
    names = [c for c in per.columns if c not in ("shingle", "_bits")]
    per = per.select(F.col("shingle").alias("_s"), *names, _each_used("_bits").alias("_z"))
    return salted.join(per, (F.col("shingle") == F.col("_s")) & (F.col("_salt") == F.col("_z"))).drop("_s", "_z", "_salt")


def _star_pairs(lists: DataFrame, t: tuple[int, int], by) -> DataFrame:
    """Each list's class of largest `by` with every other of the list."""
    centre = F.max(F.struct(by.alias("o"), F.col("k"), F.col("size"), F.col("pos"))).alias("c")
    rows = _with_list(lists, centre, F.count(F.lit(1)).alias("n"), having="n > 1")
    rows = rows.select(F.col("k").alias("a"), F.col("size").alias("sa"), F.col("pos").alias("pa"), F.col("c.k").alias("b"), F.col("c.size").alias("sb"), F.col("c.pos").alias("pb"))
    return _pairs(rows.where(_fits(t)))


def _cross_pairs(lists: DataFrame, t: tuple[int, int]) -> DataFrame:
    """All pairs of a list whose labels differ: classes outside the list's largest label with all classes."""
    counts = lists.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n"))
    major = counts.groupBy("shingle").agg(F.max(F.struct("n", "label"))["label"].alias("_major"))
    salted = lists.withColumn("_salt", _salt("k"))
    used = salted.groupBy("shingle").agg(_used(F.col("_salt")).alias("_bits"))
    per = used.join(major, "shingle").select(F.col("shingle").alias("_s"), "_major", "_bits", _each_used("_bits").alias("_z"))
    marked = salted.join(per, (F.col("shingle") == F.col("_s")) & (F.col("_salt") == F.col("_z")))
    minor = marked.where(F.col("label") != F.col("_major")).select("shingle", F.col("k").alias("a"), F.col("size").alias("sa"), F.col("pos").alias("pa"), F.col("label").alias("la"), _each_used("_bits").alias("_z"))
    every = salted.select(F.col("shingle").alias("_s"), F.col("k").alias("b"), F.col("size").alias("sb"), F.col("pos").alias("pb"), F.col("label").alias("lb"), "_salt")
    same = (F.col("shingle") == F.col("_s")) & (F.col("_z") == F.col("_salt"))
    return _pairs(minor.join(every, same & (F.col("la") != F.col("lb")) & _fits(t)))


def _verified(pairs: DataFrame, classes: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The pairs that link. Overlaps are counted by segment and summed per pair."""
    segments = classes.where(F.col("seg") >= 0).select("k", "seg", "codes")
    few = pairs.count() <= BROADCAST_PAIRS
    side = F.broadcast(pairs) if few else pairs

    def half(end: str) -> DataFrame:
        return segments.join(side, F.col("k") == F.col(end)).select("a", "b", "sa", "sb", "seg", F.col("codes").alias(f"codes_{end}"))

    right = half("b").select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("seg").alias("_seg"), "codes_b")
    both = half("a").join(right, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("seg") == F.col("_seg")))

    def overlap(batches):
        for batch in batches:
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            n = [len(np.intersect1d(codes_of(p), codes_of(q), assume_unique=True)) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64())], names=["a", "b", "sa", "sb", "part"])

    parts = both.select("a", "b", "sa", "sb", "codes_a", "codes_b").mapInArrow(overlap, "a bigint, b bigint, sa bigint, sb bigint, part bigint")
    total = parts.groupBy("a", "b", "sa", "sb").agg(F.sum("part").alias("n"))
    return total.where(F.col("n") * t[1] >= (F.col("sa") + F.col("sb") - F.col("n")) * t[0]).select("a", "b")


def codes_of(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_arrays(raw, 1)[0], dtype=np.uint64)


def components(links: DataFrame, scratch: Scratch | None = None, known: DataFrame | None = None) -> DataFrame:
    """k, label (the smallest k reachable) of every class with a link: in each round the smallest of its own label, its
    neighbours' labels and its label's label, until nothing changes.

    A hub's label goes to its neighbours once for each salt they use, and so does a label's own label to its members. `known`
    (k, label) are the labels of an earlier part of the links, from which the rounds go on.
    """
    scratch = scratch or Scratch(links.sparkSession)
    both = scratch.put(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).withColumn("_salt", _salt("x")), "edges")
    # one row for each node; a node is beside others, so it occurs on both sides
    state = both.groupBy("y").agg(F.min("x").alias("m"), _used(F.col("_salt")).alias("_bits")).select(F.col("y").alias("k"), F.least("y", "m").alias("label"), "_bits")
    if known is not None:
        state = state.join(known.select(F.col("k").alias("_k"), F.col("label").alias("_known")), F.col("k") == F.col("_k"), "left").select("k", F.least("label", "_known").alias("label"), "_bits")
    written = [scratch.put(state, "labels")]
    state = written[0]
    while True:
        told = state.select(F.col("k").alias("_y"), F.col("label").alias("l"), _each_used("_bits").alias("_z"))
        near = both.join(told, (F.col("y") == F.col("_y")) & (F.col("_salt") == F.col("_z"))).groupBy(F.col("x").alias("_x")).agg(F.min("l").alias("l"))
        salted = state.withColumn("_own", _salt("k"))
        used = salted.groupBy(F.col("label").alias("_l")).agg(_used(F.col("_own")).alias("_u"))
        up = used.join(state.select(F.col("k").alias("_k"), F.col("label").alias("up")), F.col("_l") == F.col("_k")).select("_l", "up", _each_used("_u").alias("_z"))
        step = salted.join(up, (F.col("label") == F.col("_l")) & (F.col("_own") == F.col("_z"))).join(near, F.col("k") == F.col("_x"))
        nxt = scratch.put(step.select("k", F.col("label").alias("old"), F.least("label", "l", "up").alias("label"), "_bits"), "labels")
        written.append(nxt)
        if len(written) > 2:
            scratch.drop(written.pop(0))
        if not nxt.where("label <> old").limit(1).count():
            return nxt.select("k", "label")
        state = nxt.select("k", "label", "_bits")


def near_duplicate_links(
    docs: DataFrame, n: int, t: tuple[int, int], keys: Keys, shingles: int, *, text: str = "text", fragment_shingles: int = FRAGMENT_SHINGLES, rounds: int = ROUNDS, wide: int = WIDE, scratch: Scratch | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Links (a, b) between classes, enough to connect every component; and the labels of those but the last (k, label)."""
    scratch = scratch or Scratch(docs.sparkSession)
    num, den = t
    # a code has room for 2^26 fragments; beyond 10^14 shingles they grow instead
    fragments = min(max(1, -(-shingles // fragment_shingles)), (1 << PLACE_BITS) - (1 << 14))
    # a smaller set has no partner but its equal
    least = max(1, num // (den - num))
    dealt = _dealt(docs, n, keys, fragments, least, text, wide)
    inner = 1 if fragments <= wide else -(-fragments // int(fragments**0.5))
    fragments = -(-fragments // inner) * inner
    dealt = dealt.repartition(min(fragments, 20_000), "frag")
    classes = scratch.put(_survivors(_shared(dealt, fragments), t), "survivors")
    lists = scratch.put(_prefix_rows(classes), "lists")
    links = scratch.put(_verified(scratch.put(_star_pairs(lists, t, -F.col("own") / F.col("size")), "pairs"), classes, t), "links")
    labels = None
    for r in range(rounds):
        labels = components(links, scratch, labels)
        labelled = lists.join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))
        mixed_lists = _with_list(labelled, F.min("label").alias("_lo"), F.max("label").alias("_hi"), having="_lo <> _hi")
        lists = scratch.put(mixed_lists.drop("_lo", "_hi"), "lists")
        last = r == rounds - 1
        pairs = _cross_pairs(lists, t) if last else _star_pairs(lists, t, F.xxhash64("k", F.lit(r)))
        found = _verified(scratch.put(pairs, "pairs"), classes, t)
        links = scratch.put(links.unionByName(found).distinct(), "links")
        lists = lists.drop("label")
    return links, labels


def components_of(docs: DataFrame, *, n: int = 5, t: tuple[int, int] = (4, 5), doc_id: str = "doc_id", text: str = "text", key_bits: int = 64, **options) -> tuple[DataFrame, DataFrame, Keys]:
    """doc_id, k (class) and n_shingles of every row; k, label and component_id of every class; the keys of sets."""
    scratch = Scratch(docs.sparkSession)
    table, keys = class_table(docs, n, doc_id=doc_id, text=text, key_bits=key_bits)
    classes = table.where("n_shingles > 0").groupBy("k").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"))
    shingles = classes.agg(F.sum("n")).first()[0] or 0
    if shingles:
        links, labels = near_duplicate_links(docs, n, t, keys, shingles, text=text, scratch=scratch, **options)
        label = components(links, scratch, labels)
        named = classes.join(label, "k", "left").select("k", "first", F.coalesce("label", "k").alias("label"))
    else:
        named = classes.select("k", "first", F.col("k").alias("label"))
    by_class = persist_shared(_named_components(named), "components")
    scratch.drop()
    return table, by_class, keys


def _named_components(named: DataFrame) -> DataFrame:
    """k, label, component_id: the smallest id of the label's classes, told once for each salt these use."""
    salted = named.withColumn("_salt", _salt("k"))
    per = salted.groupBy("label").agg(F.min("first").alias("component_id"), _used(F.col("_salt")).alias("_bits"))
    per = per.select(F.col("label").alias("_l"), "component_id", _each_used("_bits").alias("_z"))
    return salted.join(per, (F.col("label") == F.col("_l")) & (F.col("_salt") == F.col("_z"))).select("k", "label", "component_id")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    table, by_class, _ = components_of(docs, **options)
    linked = table.where("n_shingles > 0").join(by_class.drop("label"), "k").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(table.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, *, n: int = 5, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without near duplicates: of each component one row with the smallest doc_id stays (all rows of an empty
    set do), columns unchanged.

    A doc_id of one row names its row. Rows that share their doc_id, or have none, are told apart by their class, and of
    equal ones any one stays.
    """
    table, by_class, keys = components_of(docs, n=n, doc_id=doc_id, text=text, **options)
    least = table.where("n_shingles > 0").join(by_class, "k").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = persist_shared(least.groupBy("label").agg(F.min(F.struct("doc_id", "k")).alias("f")).select("f.doc_id", "f.k"), "first")
    keep = first.select("doc_id").unionByName(table.where("n_shingles = 0").select("doc_id")).where(F.col("doc_id").isNotNull())
    keep = keep.select(F.col("doc_id").alias("_keep")).distinct()
    rows = sheltered(docs, doc_id=doc_id, text=text)
    shared = persist_shared(table.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("_shared")), "shared_ids")
    if not shared.limit(1).count():
        return restored(rows.join(keep, F.col("doc_id") == F.col("_keep"), "left_semi"))
    alone = rows.join(keep.join(shared, F.col("_keep") == F.col("_shared"), "left_anti"), F.col("doc_id") == F.col("_keep"), "left_semi")
    among = rows.where(F.col("doc_id").isNotNull()).join(shared, F.col("doc_id") == F.col("_shared"), "left_semi").unionByName(rows.where(F.col("doc_id").isNull()))
    schema = T.StructType([*among.schema.fields[:2], *T._parse_datatype_string("k bigint, n_shingles bigint").fields])

    def work(batch):
        sets = [shingle_set(x, n) for x in texts_of(batch, "text")]
        cols = [pa.array([keys.of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=schema.names)

    classed = map_texts(among, "text", schema, work)
    f = first.select(F.col("doc_id").alias("_d"), F.col("k").alias("_k"))
    one = classed.where("n_shingles > 0").groupBy("doc_id", "k").agg(F.first("_row").alias("_row"))
    one = one.join(f, (F.col("k") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    empty = classed.where("n_shingles = 0")
    return restored(alone.select("_row").unionByName(one.select("_row")).unionByName(empty.select("_row")))
