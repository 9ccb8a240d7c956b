"""Token features: document frequencies, rarity-weighted similarity, passage search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import persist_shared


def tokens(text: Column, pattern: str = "[A-Za-z]+") -> Column:
    """Distinct lower-cased tokens."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def long_features(df: DataFrame, key: str, values: Column, name: str = "token", unique: bool = False) -> DataFrame:
    """One row for each distinct (key, value). `values` holds no value twice, so where keys are unique nothing is shuffled."""
    rows = df.select(key, F.explode(values).alias(name))
    return rows if unique else rows.distinct()


def is_unique(df: DataFrame, key: str) -> tuple[int, bool]:
    """The number of distinct keys, and whether each has one row."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("k"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
    return r.k, r.n == r.k and not r.nulls


def idf(features: DataFrame, n_sets: int, name: str = "token") -> DataFrame:
    """token, df and weight ln(1 + n/df); n counts all sets, empty ones too."""
    return features.groupBy(name).agg(F.count(F.lit(1)).alias("df")).withColumn("weight", F.log(1 + F.lit(n_sets) / F.col("df")))


def _searched(features: DataFrame, weights: DataFrame, key: str, least: float, token: str) -> DataFrame:
    """key, token, weight, total (of the key's weights) and search: the token is among those a pair must share one of."""
    by = Window.partitionBy(key)
    rows = features.select(key, token).join(weights.select(token, "weight"), token)
    lighter = F.sum("weight").over(by.orderBy("weight", token).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("total", F.sum("weight").over(by)).withColumn("search", lighter >= F.col("total") * least * (1 - 1e-9))
    return persist_shared(rows, "features")


def weighted_jaccard(left: DataFrame, right: DataFrame, weights: DataFrame, lk: str, rk: str, least: float, token: str = "token") -> DataFrame:
    """Pairs with weighted Jaccard of `least` or more: lk, rk, score.

    In the order from rare to common, the first token a pair shares has all the rest of what it shares behind it; so it
    lies, in both sets, before the last tokens that weigh less than `least` of the set. Only these leading tokens are joined,
    and only sets whose weights can reach the similarity at all; scores then use all tokens.
    """
    x = _searched(left, weights, lk, least, token).withColumnRenamed("total", "_ls")
    y = _searched(right, weights, rk, least, token).withColumnRenamed("total", "_rs")
    near = (F.col("_ls") >= F.col("_rs") * least * (1 - 1e-9)) & (F.col("_rs") >= F.col("_ls") * least * (1 - 1e-9))
    found = x.where("search").select(token, lk, "_ls").join(y.where("search").select(token, rk, "_rs"), token).where(near)
    candidates = found.select(lk, rk, "_ls", "_rs").distinct()
    shared = candidates.join(x.select(lk, token, "weight"), lk).join(y.select(rk, token), [rk, token]).groupBy(lk, rk, "_ls", "_rs").agg(F.sum("weight").alias("_i"))
    scored = shared.withColumn("score", F.col("_i") / (F.col("_ls") + F.col("_rs") - F.col("_i")))
    return scored.where(F.col("score") >= least).select(lk, rk, "score")


def mutual_best(pairs: DataFrame, a: str, b: str, score: str = "score") -> DataFrame:
    """Pairs that are the best of both sides under the total order (score, a, b), all descending."""
    best = F.max(F.struct(score, a, b)).alias("_m")
    for_a = pairs.groupBy(a).agg(best).select("_m.*")
    for_b = pairs.groupBy(b).agg(best).select("_m.*")
    return for_a.join(for_b.select(a, b), [a, b], "left_semi")


#: What the short passages that are compared with every document may take.
SHORT_BYTES = 8 << 20


def window_hashes(words: Column, width: int) -> Column:
    """Hashes of all windows of `width` words, by place; none if there are fewer words."""
    n = F.size(words)
    hashed = F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(n >= width, hashed).otherwise(F.array().cast("array<bigint>"))


def passage_hits(passages: DataFrame, docs: DataFrame, pid: str, did: str, ptext: str = "text", dtext: str = "text", width: int = 4) -> DataFrame:
    """pid, did of every document that holds a passage verbatim.

    The needle is the passage's words 2 to width + 1, whole words between blanks in any text that holds the
    passage. Hashes of the documents' word windows are joined to the needles', which gives pairs of ids; the texts come back
    for these alone and are compared. Passages of fewer words than that are compared with every document, as a
    broadcast set of checked size; keys are unique on both sides.
    """
    p = passages.select(pid, F.col(ptext).alias("_p")).where(F.length("_p") > 0)
    words = F.split("_p", " ", -1)
    p = p.withColumn("_n", F.size(words)).withColumn("_h", F.xxhash64(F.slice(words, 2, width)))
    d = docs.select(did, F.col(dtext).alias("_d"))
    # the words are a column of their own: inside the windows' lambda they would be cut anew for each window
    probes = d.select(did, F.split("_d", " ", -1).alias("_w")).where(F.size("_w") >= width).select(did, F.explode(F.array_distinct(window_hashes(F.col("_w"), width))).alias("_h"))
    long = p.where(F.col("_n") >= width + 2)
    pairs = probes.join(long.select(pid, "_h"), "_h").select(pid, did).distinct()
    found = pairs.join(long.select(pid, "_p"), pid).join(d, did).where(F.contains("_d", "_p")).select(pid, did)
    short = p.where(F.col("_n") < width + 2).select(pid, "_p")
    if (short.agg(F.sum(F.octet_length("_p") + 16)).first()[0] or 0) > SHORT_BYTES:
        raise ValueError("more short passages than what is broadcast; search them in parts")
    return found.unionByName(d.join(F.broadcast(short), F.contains("_d", "_p")).select(pid, did))


def ambiguity(hits: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """key, n_hits and kind: none, unique or ambiguous."""
    n = candidates.select(key).join(hits.groupBy(key).agg(F.count(F.lit(1)).alias("n_hits")), key, "left")
    n = n.select(key, F.coalesce("n_hits", F.lit(0)).cast("bigint").alias("n_hits"))
    return n.withColumn("kind", F.when(F.col("n_hits") == 0, "none").when(F.col("n_hits") == 1, "unique").otherwise("ambiguous"))


def collisions(df: DataFrame, key: Column, member: str) -> DataFrame:
    """Groups of equal keys with more than one member: key, n, kept (smallest member)."""
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("kept")).where("n > 1")


def verbatim_coverage(docs: DataFrame, sources: DataFrame, did: str, width: int = 8, text: str = "text") -> DataFrame:
    """did, covered (words in windows that some source holds) and longest (words of the longest stretch of such windows).

    Windows may come from several sources, so this bounds from above what runs taken one after the other from one source
    cover; sources.pascal.verbatim_cover gives these. Windows are compared by two 64-bit hashes.
    """

    def windows(df: DataFrame, *keep: str) -> DataFrame:
        words = F.filter(F.split(F.col(text), r"[ \n]+"), lambda x: x != "")
        w = df.select(*keep, words.alias("_w")).where(F.size("_w") >= width)
        pair = lambda i: F.struct(F.xxhash64(F.slice("_w", i, width)).alias("a"), F.xxhash64(F.lit(1), F.slice("_w", i, width)).alias("b"))
        grams = F.transform(F.sequence(F.lit(1), F.size("_w") - (width - 1)), pair)
        return w.select(*keep, F.posexplode(grams).alias("_p", "_g")).select(*keep, "_p", "_g.a", "_g.b")

    known = windows(sources).select("a", "b").distinct()
    hits = windows(docs, did).join(known, ["a", "b"], "left_semi").select(did, "_p")
    new = F.coalesce(F.col("_p") - F.lag("_p").over(Window.partitionBy(did).orderBy("_p")) > width, F.lit(True))
    islands = hits.withColumn("_i", F.sum(new.cast("int")).over(Window.partitionBy(did).orderBy("_p")))
    spans = islands.groupBy(did, "_i").agg((F.max("_p") - F.min("_p") + width).cast("bigint").alias("_n"))
    return spans.groupBy(did).agg(F.sum("_n").alias("covered"), F.max("_n").alias("longest"))


def margin_winner(counts: DataFrame, key: str, item: str, score: str, margin: float = 1.5) -> DataFrame:
    """key, winner (null unless it leads the runner-up by the factor), best and runner_up.

    Two partial aggregates, the second without each key's best, so no key's items meet in one place.
    """
    pair = F.struct(F.col(score).alias("s"), F.col(item).alias("i"))
    first = counts.groupBy(key).agg(F.max(pair).alias("_b"))
    other = first.select(F.col(key).alias("_k"), F.col("_b").alias("_o"))
    second = counts.join(other, F.col(key) == F.col("_k")).where(pair != F.col("_o")).groupBy(key).agg(F.max(score).alias("_s"))
    ranked = first.join(second, key, "left").withColumn("_r", F.coalesce("_s", F.lit(0)))
    return ranked.select(key, F.when(F.col("_b.s") >= margin * F.col("_r"), F.col("_b.i")).alias("winner"), F.col("_b.s").alias("best"), F.col("_r").alias("runner_up"))


def informative(observations: DataFrame, key: str, least_touched: int = 4) -> DataFrame:
    """The keys whose behaviour can be told from others'. observations: key, partial, ax, dx, calls, writes and reads (arrays).

    A routine that did not return must have touched `least_touched` different places; any other must have written or read
    something, or given more than one result.
    """
    none = F.array().cast("array<string>")
    of = lambda c: F.coalesce(F.transform(c, lambda x: x.cast("string")), none)
    o = observations.select(key, F.coalesce("partial", F.lit(False)).alias("_p"), F.struct("ax", "dx", "calls").alias("_o"), F.array_union(of("writes"), of("reads")).alias("_t"))
    touched = o.select(key, F.explode("_t").alias("_x")).groupBy(key).agg(F.countDistinct("_x").alias("_n"))
    g = o.groupBy(key).agg(F.bool_or("_p").alias("_p"), F.countDistinct("_o").alias("_d")).join(touched, key, "left")
    n = F.coalesce("_n", F.lit(0))
    return g.where(F.when(F.col("_p"), n >= least_touched).otherwise((n > 0) | (F.col("_d") > 1))).select(key)


def behaviour_match(a: DataFrame, b: DataFrame, ak: str, bk: str, signature: str = "signature") -> DataFrame:
    """ak, status (match, ambiguous or none by the number of equal signatures on the other side) and bk of a match."""
    n = b.groupBy(signature).agg(F.count(F.lit(1)).alias("_n"), F.min(bk).alias("_b"))
    j = a.join(n, signature, "left")
    status = F.when(F.col("_n").isNull(), "none").when(F.col("_n") == 1, "match").otherwise("ambiguous")
    return j.select(ak, status.alias("status"), F.when(F.col("_n") == 1, F.col("_b")).alias(bk))
