"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A document descends region, rack and shard. At each level every child draws -ln(u)/weight with u hashed from
(doc_id, child); the smallest draw wins, so a child is chosen in proportion to its weight and a change of one
weight only moves documents into or out of that child's subtree. A new shard comes as a region of its own, whose
draw is independent of the others: a document either stays where it was or moves into the new shard.

Edge cases: a null doc_id hashes as the empty string; null text has no bytes (size 1, crc 0); repeated rows share
a shard and get different slots; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int, per_rack: int = 4, racks: int = 2, base: int = 16) -> list[Shard]:
    """The first `base` shards in racks and regions; each later one is a region of its own."""
    out = []
    for i in range(shards):
        if i < base:
            rack = i // per_rack
            out.append(Shard(f"r{rack // racks}", f"r{rack // racks}k{rack % racks}", i))
        else:
            out.append(Shard(f"s{i}", f"s{i}k0", i))
    return out


def _draw(key: Column, node: str, weight: float) -> Column:
    """-ln(u)/weight, u in (0, 1) from 52 bits of an MD5 hash."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{node}"))), 1, 13), 16, 10).cast("bigint")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _descend(key: Column, shards: list[Shard], level: int = 0) -> Column:
    """The shard number chosen under these shards, which agree on the levels above."""
    names = ("region", "rack")
    if level == 2:
        groups = {f"shard{s.shard}": [s] for s in shards}
    else:
        groups = {}
        for s in shards:
            groups.setdefault(getattr(s, names[level]), []).append(s)
    below = [(n, g, F.lit(g[0].shard) if level == 2 or len(g) == 1 else _descend(key, g, level + 1)) for n, g in groups.items()]
    if len(below) == 1:
        return below[0][2]
    draws = F.array(*[F.struct(_draw(key, n, sum(s.weight for s in g)).alias("d"), F.lit(i).alias("i")) for i, (n, g, _) in enumerate(below)])
    won = F.array_min(draws)["i"]
    return reduce(lambda otherwise, x: F.when(won == x[0], x[1][2]).otherwise(otherwise), list(enumerate(below))[1:], below[0][2])


def assign(docs: DataFrame, shards: list[Shard], *, doc_id: str = "doc_id", out: str = "shard") -> DataFrame:
    """docs with the shard that each document's id leads to."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return docs.withColumn(out, _descend(key, shards).cast("int"))


def with_slots(rows: DataFrame, *order: str, shard: str = "shard", buckets: int = 4096, out: str = "slot") -> DataFrame:
    """A gapless number from 0 within each shard.

    Rows are ranked within hash buckets of a shard and shifted by the counts of the buckets before, so no task
    holds a whole shard.
    """
    keyed = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(shard, "_b").orderBy(*order)) - 1)
    counts = keyed.groupBy(shard, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(shard).alias("_s"), F.col("_b").alias("_sb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    joined = ranked.join(starts, (F.col(shard) == F.col("_s")) & (F.col("_b") == F.col("_sb")))
    return joined.withColumn(out, (F.col("_at") + F.col("_r")).cast("bigint")).drop("_b", "_r", "_s", "_sb", "_at")


def shard_documents(docs: DataFrame, shards: int = 16, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard after one more shard has come."""
    bytes_ = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("bigint").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
    )
    placed = assign(assign(rows, topology(shards), doc_id="doc_id"), topology(shards + 1), doc_id="doc_id", out="grown_shard")
    slotted = with_slots(placed, "doc_id", "size", "text_crc32")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
