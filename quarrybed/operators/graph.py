"""Graph operators over edge lists (src, dst)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Rounds, persist_shared


def inverted(edges: DataFrame) -> DataFrame:
    """dst, n_callers and callers (sorted)."""
    return edges.groupBy("dst").agg(F.countDistinct("src").alias("n_callers"), F.array_sort(F.collect_set("src")).alias("callers"))


def roots(edges: DataFrame) -> DataFrame:
    """Nodes that point at others and that nothing points at."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def closure(edges: DataFrame) -> DataFrame:
    """root, node: what each source node reaches, itself included.

    Paths double in each round, so a chain of n steps takes log n rounds; each round is written to the shared folder and
    the loop ends when nothing is new. The result has as many rows as there are reachable pairs, so for graphs whose
    parts reach each other it is the square of a part.
    """
    spark = edges.sparkSession
    e = edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    own = F.explode(F.array("src", "dst")).alias("node")
    state = Rounds(spark, "reach")
    closed = state.put(e.select(F.col("src").alias("root"), own).distinct())
    n = closed.count()
    while True:
        on = closed.select(F.col("root").alias("node"), F.col("node").alias("next"))
        # every root reaches itself, so the join holds the old pairs as well
        closed = state.put(closed.join(on, "node").select("root", F.col("next").alias("node")).unionByName(closed.select("root", "node")).distinct())
        before, n = n, closed.count()
        if n == before:
            return closed


#: Distinct edges up to which sizes are counted in one task, and the words of a table of bits there.
MOST_EDGES, BIT_WORDS = 1 << 20, 1 << 24


def strong_parts(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The part of each node 0..n-1 whose nodes reach each other; a part has a larger number than those it points at."""
    order = np.argsort(src, kind="stable")
    ends = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    to = dst[order].tolist()
    index, low, part, stack = [-1] * n, [0] * n, [-1] * n, []
    at, seen, parts = ends[:n], 0, 0
    for start in range(n):
        if index[start] >= 0:
            continue
        path = [start]
        while path:
            v = path[-1]
            if index[v] < 0:
                index[v] = low[v] = seen
                seen += 1
                stack.append(v)
            if at[v] < ends[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if index[w] < 0:
                    path.append(w)
                elif part[w] < 0:
                    low[v] = min(low[v], index[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == index[v]:
                while part[v] < 0:
                    part[stack.pop()] = parts
                parts += 1
    return np.array(part, dtype=np.int64)


def reach_counts(n: int, src: np.ndarray, dst: np.ndarray, words: int = BIT_WORDS) -> np.ndarray:
    """How many nodes each node 0..n-1 reaches, itself included: sets of bits over the strong parts, in blocks of columns."""
    part = strong_parts(n, src, dst)
    sizes = np.bincount(part)
    k = len(sizes)
    links = np.unique(np.stack([part[src], part[dst]]), axis=1)
    links = links[:, links[0] != links[1]]
    ends = np.searchsorted(links[0], np.arange(k + 1)).tolist()
    total = np.zeros(k, dtype=np.int64)
    width = min(-(-k // 8), max(8, words * 8 // k)) if k else 1
    for lo in range(0, k, width * 8):
        hi = min(k, lo + width * 8)
        bits = np.zeros((k, width), dtype=np.uint8)
        own = np.arange(hi - lo)
        bits[lo + own, own >> 3] = 1 << (7 - (own & 7))
        # parts before `lo` reach nothing from there on
        for v in range(lo, k):
            if ends[v] < ends[v + 1]:
                bits[v] |= np.bitwise_or.reduce(bits[links[1, ends[v] : ends[v + 1]]], axis=0)
        for row in range(lo, k, 4096):
            some = np.unpackbits(bits[row : row + 4096], axis=1)[:, : hi - lo]
            total[row : row + 4096] += some @ sizes[lo:hi]
    return total[part]


def reach(edges: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """node, reach: the size of what each source node reaches, itself included.

    Up to `most_edges` distinct edges one task finds the parts whose nodes reach each other and counts over those, without
    a row a pair; beyond that the pairs of `closure` are made.
    """
    e = persist_shared(edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct(), "edges")
    if e.count() > most_edges:
        return closure(e).groupBy("root").agg(F.count(F.lit(1)).alias("reach")).withColumnRenamed("root", "node")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(pd.concat([pdf["src"], pdf["dst"]], ignore_index=True))
        src, dst = codes[: len(pdf)], codes[len(pdf) :]
        sizes = reach_counts(len(names), src, dst)
        own = np.unique(src)
        return pd.DataFrame({"node": names[own], "reach": sizes[own]})

    return e.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, f"node {dict(e.dtypes)['src']}, reach bigint")


def top_roots(edges: DataFrame, k: int = 3, least: int = 10, reached: DataFrame | None = None) -> DataFrame:
    """node, reach of the k roots that reach most (ties: the larger name), of these the ones that reach `least` or more."""
    sizes = reach(edges) if reached is None else reached
    return roots(edges).join(sizes, "node").orderBy(F.desc("reach"), F.desc("node")).limit(k).where(F.col("reach") >= least)


def known_edges(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """The edges whose target is a known node."""
    return edges.join(nodes.select(F.col(node).alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns)


def descend(edges: DataFrame, reach_sizes: DataFrame, entry, depth: int = 12, fan_out: int = 3, drop: int = 3):
    """Follow the callee of largest reach from `entry` until a node has many callees or reach falls off; one small
    lookup a step, `depth` steps at most."""
    at = entry
    for _ in range(depth):
        rows = (
            edges.where(F.col("src") == F.lit(at)).select(F.col("dst").alias("node")).distinct().join(reach_sizes, "node", "left")
            .select("node", F.coalesce("reach", F.lit(1)).alias("reach")).orderBy(F.desc("reach"), "node").limit(fan_out + 1).collect()
        )
        here = reach_sizes.where(F.col("node") == F.lit(at)).first()
        if not rows or len(rows) > fan_out or (here and here["reach"] - rows[0]["reach"] > drop):
            return at
        at = rows[0]["node"]
    return at
