"""Operators over program artifacts: siblings, far names, dispatch variables, graph counters, histories, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sibling_pairs(files: DataFrame, stem: str, name: str) -> DataFrame:
    """stem, a, b for stems that exactly two names share, in both orders."""
    pair = files.select(stem, name).distinct().groupBy(stem).agg(F.min(name).alias("x"), F.max(name).alias("y"), F.count(F.lit(1)).alias("n")).where("n = 2")
    both = F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b"))))
    return pair.select(stem, both.alias("p")).select(stem, "p.*")


def far_names(calls: DataFrame, units: DataFrame, symbols: DataFrame, bias: int = 0) -> DataFrame:
    """calls (segment, offset) with target: unit.symbol, else unit+offset, else the bare address."""
    u = units.select(F.col("segment").alias("_s"), F.col("unit").alias("_u"))
    s = symbols.select(F.col("unit").alias("_su"), F.col("offset").alias("_so"), F.col("symbol").alias("_n"))
    j = calls.join(u, F.col("segment") - bias == F.col("_s"), "left").join(s, (F.col("_u") == F.col("_su")) & (F.col("offset") == F.col("_so")), "left")
    at = F.format_string("%04X", "offset")
    name = F.when(F.col("_n").isNotNull(), F.concat_ws(".", "_u", "_n")).when(F.col("_u").isNotNull(), F.concat_ws("+", "_u", at))
    return j.select(*calls.columns, F.coalesce(name, F.concat_ws(":", F.format_string("%04X", "segment"), at)).alias("target"))


#: How an indirect branch through a variable and a store of a constant to it are written.
DISPATCH, STORE = r"^(?:jmp|call)\s+word\s*\[(\w+)\]", r"^mov\s+word\s*\[(\w+)\],\s*(0x[0-9A-Fa-f]+|\d+)"


def dispatch_targets(instructions: DataFrame, text: str = "text") -> DataFrame:
    """variable, target of the constants stored to variables that something branches through."""
    branch = instructions.select(F.regexp_extract(text, DISPATCH, 1).alias("variable")).where("variable <> ''").distinct()
    value = F.regexp_extract(text, STORE, 2)
    number = F.when(F.substring(value, 1, 2) == "0x", F.conv(F.substr(value, F.lit(3)), 16, 10)).otherwise(value).cast("bigint")
    stores = instructions.where(F.col(text).rlike(STORE)).select(F.regexp_extract(text, STORE, 1).alias("variable"), number.alias("target")).distinct()
    return stores.join(branch, "variable", "left_semi")


def flow_counters(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """function, blocks, edges, loops (edges back to the same place or before), returns, indirect and cyclomatic = edges -
    blocks + 2, 0 at least; blocks (function, start, and where it is known how they end: return, indirect, ...), edges
    (function, src, dst)."""
    ends = F.col("ends") if "ends" in blocks.columns else F.lit(None).cast("string")
    b = blocks.select("function", "start", ends.alias("ends")).groupBy("function").agg(
        F.countDistinct("start").alias("blocks"),
        F.countDistinct(F.when(F.col("ends") == "return", F.col("start"))).alias("returns"),
        F.countDistinct(F.when(F.col("ends") == "indirect", F.col("start"))).alias("indirect"),
    )
    e = edges.distinct().groupBy("function").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("dst") <= F.col("src")).alias("loops"))
    counted = [F.coalesce(c, F.lit(0)).alias(c) for c in ("edges", "loops")]
    j = b.join(e, "function", "left").select("function", "blocks", *counted, "returns", "indirect")
    return j.withColumn("cyclomatic", F.greatest(F.lit(0), F.col("edges") - F.col("blocks") + 2))


def concatenated(libraries: dict[str, DataFrame]) -> DataFrame:
    """The rows of several libraries one after the other, with the library each is from (origin)."""
    out = None
    for name, df in libraries.items():
        one = df.withColumn("origin", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def last_k(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The last k rows of each key, with age (0: the last)."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("age", F.row_number().over(w) - 1).where(F.col("age") < k)


def multiset_compare(found: DataFrame, expected: DataFrame, columns: list[str]) -> DataFrame:
    """columns, n_found and n_expected of the rows whose counts differ; empty if both are the same multiset."""
    count = lambda df, n: df.groupBy(*columns).agg(F.count(F.lit(1)).alias(n))
    a, b = count(found, "n_found"), count(expected, "n_expected")
    right = b.select(*[F.col(c).alias(f"_{c}") for c in columns], "n_expected")
    same = None
    for c in columns:
        test = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = test if same is None else same & test
    j = a.join(right, same, "full_outer")
    x, y = F.coalesce("n_found", F.lit(0)), F.coalesce("n_expected", F.lit(0))
    return j.where(x != y).select(*[F.coalesce(c, f"_{c}").alias(c) for c in columns], x.alias("n_found"), y.alias("n_expected"))


def conflict_free(items: DataFrame, conflicts: DataFrame, key: str, score: str) -> DataFrame:
    """items without those that lose a conflict (a, b): the stronger stays, ties go to the smaller key; an item that
    only lost to one that itself went is kept."""
    from ..shared import persist_shared

    live, gone = persist_shared(items.select(key, score), "items"), None
    both = conflicts.select("a", "b").unionByName(conflicts.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    kept = None
    while True:
        a = live.select(F.col(key).alias("a"), F.col(score).alias("sa"))
        b = live.select(F.col(key).alias("b"), F.col(score).alias("sb"))
        fights = both.join(a, "a").join(b, "b")
        lose = (F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") > F.col("b")))
        beaten = fights.where(lose).select(F.col("a").alias(key)).distinct()
        won = persist_shared(live.join(beaten, key, "left_anti"), "won")
        kept = won if kept is None else kept.unionByName(won)
        out = both.join(won.select(F.col(key).alias("a")), "a", "left_semi").select(F.col("b").alias(key)).distinct()
        gone = out if gone is None else gone.unionByName(out)
        live = persist_shared(live.join(won.select(key), key, "left_anti").join(out, key, "left_anti"), "live")
        if not live.limit(1).count():
            return items.join(kept.select(key), key, "left_semi")


def body_bounds(gaps: DataFrame, size: int, share: float = 0.15, least: int = 256) -> Column:
    """The code body (lo, hi) of a file of `size` bytes once large gaps at its edges are cut off."""
    large = (F.col("gap_end") - F.col("gap_start") > size * share) & (F.col("gap_end") - F.col("gap_start") >= least)
    lo = F.coalesce(F.max(F.when(large & (F.col("gap_start") == 0), F.col("gap_end"))), F.lit(0))
    hi = F.coalesce(F.min(F.when(large & (F.col("gap_end") == size), F.col("gap_start"))), F.lit(size))
    return F.struct(lo.alias("lo"), hi.alias("hi"))
