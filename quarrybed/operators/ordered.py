"""Ordered operators: forward fill, as-of ownership, spans, gaps and islands, running sums.

Operators over one long order work in two levels: within a bucket of the position, then over the buckets, so a
table with a single order does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _upto(*by) -> Window:
    return Window.partitionBy(*by)


def two_level_last(df: DataFrame, value: str, order: list[str], bucket: Column, out: str, partition: tuple[str, ...] = (), inclusive: bool = True) -> DataFrame:
    """df with the last non-null `value` at or before each row (before it, if not inclusive)."""
    end = 0 if inclusive else -1
    rows = df.withColumn("_b", bucket)
    local = F.last(value, ignorenulls=True).over(_upto(*partition, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, end))
    key = F.struct(*order)
    last = rows.where(F.col(value).isNotNull()).groupBy(*partition, "_b").agg(F.max_by(value, key).alias("_v"))
    buckets = rows.select(*partition, "_b").distinct().join(last, [*partition, "_b"], "left")
    before = _upto(*partition).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*partition, "_b", F.last("_v", ignorenulls=True).over(before).alias("_carry"))
    return rows.withColumn("_local", local).join(carried, [*partition, "_b"]).withColumn(out, F.coalesce("_local", "_carry")).drop("_b", "_local", "_carry")


def two_level_sum(df: DataFrame, value: str, order: list[str], bucket: Column, out: str, partition: tuple[str, ...] = ()) -> DataFrame:
    """df with the running sum of `value`; equal orders are ranked as rows."""
    rows = df.withColumn("_b", bucket)
    local = F.sum(value).over(_upto(*partition, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy(*partition, "_b").agg(F.sum(value).alias("_s"))
    before = _upto(*partition).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*partition, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_carry"))
    return rows.withColumn("_local", local).join(carried, [*partition, "_b"]).withColumn(out, F.col("_local") + F.col("_carry")).drop("_b", "_local", "_carry")


def two_level_lead(df: DataFrame, value: str, order: list[str], bucket: Column, out: str) -> DataFrame:
    """df with the next row's `value` in one order over the whole table."""
    rows = df.withColumn("_b", bucket)
    local = F.lead(F.struct(value)).over(_upto("_b").orderBy(*order))
    firsts = rows.groupBy("_b").agg(F.min_by(value, F.struct(*order)).alias("_f"))
    nxt = firsts.select("_b", F.lead("_f").over(_upto(F.lit(1)).orderBy("_b")).alias("_carry"))
    joined = rows.withColumn("_local", local).join(nxt, "_b")
    return joined.withColumn(out, F.when(F.col("_local").isNotNull(), F.col("_local")[value]).otherwise(F.col("_carry"))).drop("_b", "_local", "_carry")


def owner_asof(starts: DataFrame, probes: DataFrame, *, pos: str, owner: str, bucket: Column, out: str = "owner") -> DataFrame:
    """probes with the owner of the largest start at or before their position, and the position it starts at."""
    a = starts.select(F.col(pos), F.lit(0).alias("_kind"), F.struct(F.col(owner).alias("o"), F.col(pos).alias("p")).alias("_owner"))
    cols = [c for c in probes.columns if c != pos]
    b = probes.select(F.col(pos), F.lit(1).alias("_kind"), F.struct(*cols).alias("_probe"))
    both = a.unionByName(b, allowMissingColumns=True)
    filled = two_level_last(both, "_owner", [pos, "_kind"], bucket, "_hit").where("_kind = 1")
    return filled.select(pos, "_probe.*", F.col("_hit.o").alias(out), F.col("_hit.p").alias(f"{out}_start"))


def next_start_span(df: DataFrame, start: str, by: list[str], order: list[str], default: int = 4096) -> DataFrame:
    """df with `end`: the next start of the same key, else start + default."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("end", F.coalesce(F.lead(start).over(w), F.col(start) + default))


def gaps(df: DataFrame, start: Column, end: Column, by: list[str], least: Column | int = 0) -> DataFrame:
    """Uncovered stretches between intervals of a key: gap_start, gap_end, longer than `least`."""
    rows = df.select(*by, start.alias("_s"), end.alias("_e"))
    covered = F.max("_e").over(Window.partitionBy(*by).orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1))
    least = least if isinstance(least, Column) else F.lit(least)
    return rows.withColumn("gap_start", covered).where(F.col("_s") - F.col("gap_start") > least).select(*by, "gap_start", F.col("_s").alias("gap_end"))


def runs(df: DataFrame, kind: str, by: list[str], order: list[str]) -> DataFrame:
    """Maximal runs of equal kind: by, kind, run_start (first of the first order column) and n."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = Window.partitionBy(*by, kind).orderBy(*order)
    rows = df.withColumn("_g", F.row_number().over(w) - F.row_number().over(same))
    return rows.groupBy(*by, kind, "_g").agg(F.min(order[0]).alias("run_start"), F.count(F.lit(1)).alias("n")).drop("_g")


def contiguity(df: DataFrame, start: str, end: str, by: list[str]) -> DataFrame:
    """Where an interval does not start at the end of the one before: by, start, next_start and gap (negative: overlap)."""
    nxt = F.lead(start).over(Window.partitionBy(*by).orderBy(start, end))
    rows = df.select(*by, start, end, nxt.alias("next_start"))
    return rows.withColumn("gap", F.col("next_start") - F.col(end)).where("gap <> 0").select(*by, start, "next_start", "gap")


def monotone(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """by, is_monotone (never falls) and n_falls."""
    falls = F.col(value) < F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    rows = df.withColumn("_f", F.coalesce(falls, F.lit(False)))
    return rows.groupBy(*by).agg((~F.bool_or("_f")).alias("is_monotone"), F.count_if("_f").alias("n_falls"))


def index_of(words: Column, size: Column) -> Column:
    """entries and stride of an array of 16-bit words read as an index into a file of `size` bytes; null where it is none.

    Entries of two words (key, offset) are tried before entries of one (offset); the index ends with the key 0xFFFF, whose
    offset still counts. Three offsets at least, none falls, and the last lies in the file.
    """

    def read(step: int, at: int) -> Column:
        n = F.floor(F.size(words) / step).cast("int")
        entry = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(words, i * step).alias("key"), F.get(words, i * step + at).alias("off")))
        entries = F.when(n > 0, entry).otherwise(F.array().cast("array<struct<key:int,off:int>>"))
        stop = F.array_position(F.transform(entries, lambda e: e["key"] == 0xFFFF), F.lit(True)).cast("int")
        offs = F.transform(F.when(stop > 0, F.slice(entries, 1, stop)).otherwise(entries), lambda e: e["off"])
        rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(offs) - 1, F.lit(1))), lambda i: F.get(offs, i - 1) <= F.get(offs, i))
        fits = (F.size(offs) >= 3) & rising & (F.get(offs, F.size(offs) - 1) <= size)
        return F.when(fits, F.struct((F.size(offs) - 1).alias("entries"), F.lit(2 * step).alias("stride")))

    return F.coalesce(read(2, 1), read(1, 0))


def first_divergence(a: DataFrame, b: DataFrame, key: list[str], idx: str, value: str) -> DataFrame:
    """key and first_diff: the first index where two sequences differ or one ends; null if they are equal."""
    x = a.select(*key, idx, F.col(value).alias("_x"), F.lit(True).alias("_in_a"))
    y = b.select(*key, idx, F.col(value).alias("_y"), F.lit(True).alias("_in_b"))
    both = x.join(y, [*key, idx], "full_outer")
    differs = ~F.col("_x").eqNullSafe(F.col("_y")) | F.col("_in_a").isNull() | F.col("_in_b").isNull()
    return both.groupBy(*key).agg(F.min(F.when(differs, F.col(idx))).alias("first_diff"))


def quiet_after(df: DataFrame, by: list[str], order: str, id_col: str, gap: Column) -> DataFrame:
    """Per key the last row before the first gap longer than `gap`, else the last row: by, id, at, quiet."""
    w = Window.partitionBy(*by).orderBy(order, id_col)
    rows = df.select(*by, order, id_col, F.lead(order).over(w).alias("_next"))
    first = rows.where(F.col("_next") - F.col(order) > gap).groupBy(*by).agg(F.min(F.struct(order, id_col)).alias("_g"))
    last = rows.groupBy(*by).agg(F.max(F.struct(order, id_col)).alias("_l"))
    pick = F.coalesce("_g", "_l")
    return last.join(first, by, "left").select(*by, pick[id_col].alias(id_col), pick[order].alias("at"), F.col("_g").isNotNull().alias("quiet"))
