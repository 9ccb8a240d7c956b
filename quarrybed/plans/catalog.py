"""Registered queries over the reference tables and the SQL each one equals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import artifacts as A
from ..operators import evidence as E
from ..operators import features as T
from ..operators import graph as G
from ..operators import matching as M
from ..operators import ordered as O
from ..operators import segmentation as S
from ..session import table
from ..shared import persist_shared
from .registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]


# ---------------------------------------------------------------- features and similarity

TOKENS_SQL = """tok AS (SELECT DISTINCT doc_id, lower(t) AS token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t FROM documents)),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents)"""


def _doc_tokens(docs, unique):
    return T.long_features(docs.select("doc_id", "text"), "doc_id", T.tokens(F.col("text")), unique=unique)


@query(f"WITH {TOKENS_SQL} SELECT token, count(*) AS df, round(ln(1 + any_value(n.n) / count(*)), 6) AS idf FROM tok, n GROUP BY token")
def idf_tokens(spark, d):
    docs = table(spark, d, "documents")
    n, unique = T.is_unique(docs, "doc_id")
    return T.idf(_doc_tokens(docs, unique), n).select("token", "df", F.round("weight", 6).alias("idf"))


STOP = ("the", "and", "of", "to", "in", "that", "is", "it", "for", "with", "on", "be", "was", "as", "by", "are")


@query(f"WITH {TOKENS_SQL} SELECT doc_id, count(*) AS n_kept, md5(string_agg(token, ' ' ORDER BY token)) AS kept_md5 FROM tok WHERE token NOT IN {STOP} GROUP BY doc_id")
def noise_filtered_tokens(spark, d):
    kept = F.array_except(T.tokens(F.col("text")), F.array(*map(F.lit, STOP)))
    rows = table(spark, d, "documents").select("doc_id", F.array_sort(kept).alias("k")).where(F.size("k") > 0)
    return rows.select("doc_id", F.size("k").cast("bigint").alias("n_kept"), F.md5(F.array_join("k", " ")).alias("kept_md5"))


@query(r"""SELECT md5(k) AS key_md5, count(*) AS n, min(doc_id) AS kept FROM
(SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS k FROM documents) GROUP BY k HAVING count(*) > 1""")
def normalized_text_groups(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.md5(X.normalize_string(F.col("text"))).alias("key_md5"))
    return T.collisions(rows, F.col("key_md5"), "doc_id").select(F.col("key").alias("key_md5"), "n", "kept")


PAIRS_SQL = """a AS (SELECT DISTINCT item_id, lower(t) AS token FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t FROM benchmark)),
b AS (SELECT DISTINCT doc_id, lower(t) AS token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t FROM documents)),
nn AS (SELECT (SELECT count(*) FROM benchmark) + (SELECT count(*) FROM documents) AS n),
w AS (SELECT token, ln(1 + any_value(nn.n) / count(*)) AS weight FROM (SELECT token FROM a UNION ALL SELECT token FROM b), nn GROUP BY token),
sa AS (SELECT item_id, sum(weight) AS s FROM a JOIN w USING (token) GROUP BY item_id),
sb AS (SELECT doc_id, sum(weight) AS s FROM b JOIN w USING (token) GROUP BY doc_id),
i AS (SELECT item_id, doc_id, sum(weight) AS i FROM a JOIN b USING (token) JOIN w USING (token) GROUP BY item_id, doc_id),
p AS (SELECT item_id, doc_id, round(i / (sa.s + sb.s - i), 6) AS score FROM i JOIN sa USING (item_id) JOIN sb USING (doc_id) WHERE i / (sa.s + sb.s - i) >= 0.2)"""


def _pairs(spark, d):
    items, docs = table(spark, d, "benchmark").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text")
    (n, one), (m, each) = T.is_unique(items, "item_id"), T.is_unique(docs, "doc_id")
    a = persist_shared(T.long_features(items, "item_id", T.tokens(F.col("text")), unique=one), "tokens")
    b = persist_shared(T.long_features(docs, "doc_id", T.tokens(F.col("text")), unique=each), "tokens")
    weights = T.idf(a.select("token").unionByName(b.select("token")), n + m)
    return T.weighted_jaccard(a, b, weights, "item_id", "doc_id", 0.2).withColumn("score", F.round("score", 6))


@query(f"WITH {PAIRS_SQL} SELECT item_id, doc_id, score FROM p")
def weighted_jaccard(spark, d):
    return _pairs(spark, d)


@query(f"""WITH {PAIRS_SQL} SELECT item_id, doc_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) = 1 AND row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id DESC) = 1""")
def mutual_best(spark, d):
    return T.mutual_best(_pairs(spark, d), "item_id", "doc_id")


@query()
def greedy_assignment(spark, d):
    return M.greedy_assignment(_pairs(spark, d), "item_id", "doc_id")


@query("""SELECT doc_id, CASE WHEN w > 0 AND n / w BETWEEN 1 AND 6 THEN round(1 - abs(ln((n / w) / 2.5)) / ln(6), 6) ELSE 0 END AS size_score
FROM (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '[^ \\n]+')) AS w FROM documents)""".replace("\\\\", "\\"))
def size_band(spark, d):
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0)))
    return table(spark, d, "documents").select("doc_id", F.round(X.size_similarity(F.length("text"), words), 6).alias("size_score"))


@query("""SELECT l_orderkey, n_lines, n_parts, round(least(n_lines, n_parts) / greatest(n_lines, n_parts), 6) AS ratio,
round(1 - abs(n_lines - n_parts) / greatest(n_lines, n_parts), 6) AS agreement
FROM (SELECT l_orderkey, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_orderkey)""")
def shape_ratio(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("l_partkey").alias("n_parts"))
    n, p = F.col("n_lines"), F.col("n_parts")
    return g.select("l_orderkey", "n_lines", "n_parts", F.round(X.ratio(n, p), 6).alias("ratio"), F.round(X.degree_agreement(n, p), 6).alias("agreement"))


@query("""WITH c AS (SELECT row_number() OVER () AS r, coalesce(p, false) AS p, coalesce(t, false) AS t FROM
(SELECT len(regexp_extract_all(text, '[^ ]+')) >= 50 AS p, quality = 1 AS t FROM documents JOIN labels USING (doc_id))),
s AS (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM c)
SELECT tp, fp, fn, round_even(tp / greatest(1, tp + fp), 6) AS precision, round_even(tp / greatest(1, tp + fn), 6) AS recall FROM s""")
def evaluate_labels(spark, d):
    words = F.size(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)))
    rows = table(spark, d, "documents").select("doc_id", (words >= 50).alias("p")).join(table(spark, d, "labels"), "doc_id")
    return M.evaluate(F.col("p"), F.col("quality") == 1, rows)


# ---------------------------------------------------------------- passages and signatures


def _hits(spark, d):
    return T.passage_hits(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0")
def passage_contains(spark, d):
    return _hits(spark, d)


@query("""SELECT item_id, count(doc_id) AS n_hits, CASE WHEN count(doc_id) = 0 THEN 'none' WHEN count(doc_id) = 1 THEN 'unique' ELSE 'ambiguous' END AS kind
FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) AND length(b.text) > 0 GROUP BY item_id""")
def passage_unique_or_ambiguous(spark, d):
    return T.ambiguity(_hits(spark, d), table(spark, d, "benchmark"), "item_id")


@query("SELECT sha256(text) AS text_sha256, count(*) AS n, min(doc_id) AS kept FROM documents GROUP BY text HAVING count(*) > 1")
def hit_collisions(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return T.collisions(rows, F.col("h"), "doc_id").withColumnRenamed("key", "text_sha256")


@query("SELECT sha256(text) AS text_sha256, count(*) AS n FROM documents GROUP BY text")
def hash_identity(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH g AS (SELECT DISTINCT array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 6)) AS p FROM
(SELECT regexp_extract_all(text, '[^ \n]+') AS w FROM benchmark) WHERE len(w) >= 8)),
h AS (SELECT doc_id, p FROM (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM
(SELECT doc_id, regexp_extract_all(text, '[^ \n]+') AS w FROM documents) WHERE len(w) >= 8)) SEMI JOIN g USING (g)),
i AS (SELECT doc_id, p, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS i
FROM (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 8, true) AS s FROM h))
SELECT doc_id, CAST(sum(n) AS BIGINT) AS covered, CAST(max(n) AS BIGINT) AS longest FROM (SELECT doc_id, max(p) - min(p) + 8 AS n FROM i GROUP BY doc_id, i) GROUP BY doc_id""")
def verbatim_coverage(spark, d):
    return T.verbatim_coverage(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("text"), "doc_id")


@query("""WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) AS r FROM k),
f AS (SELECT user_id, max(n) FILTER (r = 1) AS best, max(event_type) FILTER (r = 1) AS e, coalesce(max(n) FILTER (r = 2), 0) AS runner_up FROM c GROUP BY user_id)
SELECT user_id, CASE WHEN best >= 1.5 * runner_up THEN e END AS winner, best, runner_up FROM f""")
def margin_winner(spark, d):
    return T.margin_winner(table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")), "user_id", "event_type", "n")


def _first_types(spark, d, n):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", "event_type", F.row_number().over(w).alias("r")).where(F.col("r") <= n)
    return rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "event_type"))), lambda x: x["event_type"]), ",").alias("signature"))


FIRST_SQL = "(SELECT user_id, string_agg(event_type, ',' ORDER BY r) AS signature FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= {} GROUP BY user_id)"


@query(f"""WITH s AS {FIRST_SQL.format(3)}, b AS (SELECT signature, count(*) AS n, min(user_id) AS u FROM s WHERE user_id % 2 = 1 GROUP BY signature)
SELECT s.user_id AS a_user, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'match' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN u END AS b_user
FROM s LEFT JOIN b USING (signature) WHERE s.user_id % 2 = 0""")
def behaviour_match(spark, d):
    s = _first_types(spark, d, 3)
    side = lambda k, name: s.where(F.col("user_id") % 2 == k).select(F.col("user_id").alias(name), "signature")
    return T.behaviour_match(side(0, "a_user"), side(1, "b_user"), "a_user", "b_user")


@query(f"WITH s AS {FIRST_SQL.format(2)} SELECT user_id, signature FROM s WHERE string_split(signature, ',')[1] <> string_split(signature, ',')[2]")
def informative_filter(spark, d):
    kinds = F.split("signature", ",")
    return _first_types(spark, d, 2).where(F.size(F.array_distinct(kinds)) > 1)


# ---------------------------------------------------------------- intervals and order


def _events(spark, d):
    """events with micros, the time as a number."""
    return table(spark, d, "events").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))


DAY = 86_400_000_000


def _day():
    return F.floor(F.col("micros") / DAY)


@query("""SELECT e.event_id, s.event_id AS owner, epoch_us(e.ts) - epoch_us(s.ts) AS remainder FROM events e
ASOF LEFT JOIN (SELECT event_id, ts FROM events WHERE event_type = 'signup') s ON e.ts >= s.ts""")
def owner_asof(spark, d):
    e = _events(spark, d).select("event_id", "event_type", "micros")
    hit = O.owner_asof(e.where("event_type = 'signup'"), e.select("event_id", "micros"), pos="micros", owner="event_id", bucket=_day())
    return hit.select("event_id", "owner", (F.col("micros") - F.col("owner_start")).alias("remainder"))


@query("""SELECT o_orderkey, d AS start_day, coalesce(lead(d) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey), d + 4096) AS end_day
FROM (SELECT o_orderkey, o_custkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS d FROM orders)""")
def next_start_span(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.unix_date(F.to_date("o_orderdate")).cast("bigint").alias("start_day"))
    return O.next_start_span(o, "start_day", ["o_custkey"], ["start_day", "o_orderkey"]).select("o_orderkey", "start_day", F.col("end").alias("end_day"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY""")
def interval_contains(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    j = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    inside = F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return j.where(inside).select("l_orderkey", "l_linenumber", "l_partkey", F.date_diff("l_shipdate", "o_orderdate").alias("days"))


@query(f"""SELECT user_id, p AS gap_start, m AS gap_end FROM (SELECT user_id, epoch_us(ts) AS m, max(epoch_us(ts)) OVER
(PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM events) WHERE m - p > {DAY}""")
def gaps_islands(spark, d):
    return O.gaps(_events(spark, d), F.col("micros"), F.col("micros"), ["user_id"], DAY)


@query("""WITH g AS (SELECT user_id, event_type, epoch_us(ts) AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
- row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, event_type, min(m) AS run_start, count(*) AS n FROM g GROUP BY user_id, event_type, g""")
def region_runs(spark, d):
    return O.runs(_events(spark, d), "event_type", ["user_id"], ["micros", "event_id"])


@query("""SELECT l_orderkey, l_linenumber, next_start, next_start - l_linenumber - 1 AS gap FROM
(SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS next_start FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
WHERE next_start - l_linenumber - 1 <> 0""")
def partition_contiguity(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumn("end", F.col("l_linenumber") + 1)
    return O.contiguity(rows, "l_linenumber", "end", ["l_orderkey"])


@query("""SELECT user_id, count(*) FILTER (value < p) = 0 AS is_monotone, count(*) FILTER (value < p) AS n_falls FROM
(SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY user_id""")
def monotone_offsets(spark, d):
    return O.monotone(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"])


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS signup_id FROM events""")
def forward_fill(spark, d):
    e = _events(spark, d).withColumn("s", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return O.two_level_last(e, "s", ["micros", "event_id"], _day(), "signup_id", ("user_id",)).select("event_id", "signup_id")


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events),
a AS (SELECT user_id AS pair, idx, event_type FROM r WHERE user_id % 2 = 0), b AS (SELECT user_id - 1 AS pair, idx, event_type FROM r WHERE user_id % 2 = 1)
SELECT pair, min(idx) FILTER (a.event_type IS DISTINCT FROM b.event_type) AS first_diff FROM a FULL JOIN b USING (pair, idx) GROUP BY pair""")
def first_divergence(spark, d):
    return O.first_divergence(*_user_pairs(spark, d), ["pair"], "idx", "event_type")


def _user_pairs(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    r = table(spark, d, "events").select("user_id", "event_type", F.row_number().over(w).cast("bigint").alias("idx"))
    u = F.col("user_id")
    return [r.where(u % 2 == k).select((u - k).alias("pair"), "idx", "event_type") for k in (0, 1)]


@query()
def align_sequences(spark, d):
    return M.align_sequences(*_user_pairs(spark, d), "pair", "idx", "event_type")


QUIET = 43_200_000_000


def _quiet(spark, d):
    return O.quiet_after(_events(spark, d), ["user_id"], "micros", "event_id", F.lit(QUIET))


QUIET_SQL = f"""n AS (SELECT user_id, event_id, epoch_us(ts) AS m, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events),
q AS (SELECT user_id, min(m) AS m FROM n WHERE nx - m > {QUIET} GROUP BY user_id), l AS (SELECT user_id, max(m) AS m FROM n GROUP BY user_id)"""


@query(f"WITH {QUIET_SQL} SELECT user_id, m AS quiet_start FROM q")
def quiet_period(spark, d):
    return _quiet(spark, d).where("quiet").select("user_id", F.col("at").alias("quiet_start"))


@query(f"WITH {QUIET_SQL} SELECT l.user_id, n.event_id, q.m IS NOT NULL AS quiet FROM l LEFT JOIN q USING (user_id) JOIN n ON n.user_id = l.user_id AND n.m = coalesce(q.m, l.m)")
def last_before_quiet(spark, d):
    return _quiet(spark, d).select("user_id", "event_id", "quiet")


# ---------------------------------------------------------------- segmentation

CUT_SQL = """pos AS (SELECT DISTINCT p_partkey AS pos FROM part),
e AS (SELECT least(l_suppkey, l_partkey) AS lo, greatest(l_suppkey, l_partkey) AS hi FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) WHERE l_suppkey <> l_partkey),
st AS (SELECT pos, sum(d) AS d FROM (SELECT lo + 1 AS pos, 1 AS d FROM e UNION ALL SELECT hi + 1, -1 FROM e) GROUP BY pos),
c AS (SELECT pos, CAST(sum(coalesce(d, 0)) OVER (ORDER BY pos) AS BIGINT) AS cut FROM pos LEFT JOIN st USING (pos)),
k AS (SELECT pos, cut, avg(cut) OVER (ORDER BY pos ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS local_mean FROM c)"""


def _cuts(spark, d):
    edges = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return S.edge_cut(edges, "l_suppkey", "l_partkey", table(spark, d, "part").select(F.col("p_partkey").alias("pos")), "pos")


@query(f"WITH {CUT_SQL} SELECT pos, cut FROM c")
def edge_cut(spark, d):
    return _cuts(spark, d)


@query(f"WITH {CUT_SQL} SELECT pos, cut, round(local_mean, 6) AS local_mean, round(CASE WHEN local_mean = 0 THEN 1 ELSE cut / local_mean END, 6) AS dip FROM k")
def local_dip(spark, d):
    rows = S.local_dip(_cuts(spark, d), "pos", 50)
    return rows.select("pos", "cut", F.round("local_mean", 6).alias("local_mean"), F.round("dip", 6).alias("dip"))


@query("""WITH i AS (SELECT o_custkey, o_orderkey, any_value(o_orderdate) AS o_orderdate, list_distinct(list(p_brand)) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey
JOIN part ON p_partkey = l_partkey GROUP BY o_custkey, o_orderkey),
w AS (SELECT brand, ln(1 + (SELECT count(*) FROM i) / count(*)) AS weight FROM (SELECT unnest(items) AS brand FROM i) GROUP BY brand),
s AS (SELECT o_custkey, row_number() OVER c AS pos, list_distinct(flatten(list(items) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))) AS l,
list_distinct(flatten(list(items) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))) AS r
FROM i WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
x AS (SELECT o_custkey, pos, l, r, unnest(list_distinct(list_concat(l, r))) AS brand FROM s WHERE len(r) > 0)
SELECT o_custkey, CAST(pos AS INTEGER) AS pos, round(sum(CASE WHEN list_contains(l, brand) AND list_contains(r, brand) THEN weight ELSE 0 END) / sum(weight), 6) AS cohesion FROM x JOIN w USING (brand) GROUP BY o_custkey, pos""")
def set_cohesion(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    sets = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("p_brand").alias("items"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(sets, "o_orderkey")
    weights = T.idf(rows.select("o_orderkey", F.explode("items").alias("brand")), rows.count(), "brand")
    out = S.set_cohesion(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "items", weights, "brand")
    return out.withColumn("cohesion", F.round("cohesion", 6))


@query()
def spaced_cuts(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), "value")
    return S.spaced_cuts(rows, "user_id", "pos", "value", 4)


@query("SELECT event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS segment FROM events")
def segments_by_cuts(spark, d):
    return S.segment_ids(table(spark, d, "events"), F.col("event_type") == "signup", ["user_id"], ["ts", "event_id"]).select("event_id", "segment")


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)
SELECT a.user_id, CAST(a.pos AS INTEGER) AS pos FROM r a WHERE event_type = 'signup' AND EXISTS (SELECT 1 FROM r b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND abs(b.pos - a.pos) <= 1)""")
def boundary_tolerance(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    r = table(spark, d, "events").select("user_id", "event_type", F.row_number().over(w).alias("pos"))
    side = lambda t: r.where(F.col("event_type") == t).select("user_id", "pos")
    return S.near_boundaries(side("signup"), side("purchase"), ["user_id"], "pos")


@query("""SELECT source, lang AS winner, n AS votes FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents WHERE lang IS NOT NULL GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, f) = 1""")
def majority_vote(spark, d):
    return S.majority_vote(table(spark, d, "documents").select("source", "lang", "doc_id"), "source", "lang", "doc_id")


@query("SELECT l_suppkey, len(v) AS n, v[len(v) // 2 + 1] AS median FROM (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY l_suppkey)")
def upper_median(spark, d):
    return M.upper_median(table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice")


# ---------------------------------------------------------------- graphs

EDGE_SQL = """(SELECT DISTINCT user_id AS src, nx AS dst FROM (SELECT user_id, lead(user_id) OVER (ORDER BY ts) AS nx FROM events WHERE event_type = 'purchase' AND value > 200) WHERE nx <> user_id)"""


def _edges(spark, d):
    e = _events(spark, d).where((F.col("event_type") == "purchase") & (F.col("value") > 200)).select("user_id", "micros")
    nxt = O.two_level_lead(e, "user_id", ["micros"], _day(), "dst")
    return nxt.where(F.col("dst") != F.col("user_id")).select(F.col("user_id").alias("src"), "dst").distinct()


@query(f"SELECT dst, count(DISTINCT src) AS n_callers, string_agg(DISTINCT CAST(src AS VARCHAR), ',' ORDER BY CAST(src AS VARCHAR)) AS callers FROM {EDGE_SQL} GROUP BY dst")
def call_graph_inverted(spark, d):
    text = F.array_join(F.array_sort(F.transform("callers", lambda x: x.cast("string"))), ",")
    return G.inverted(_edges(spark, d)).select("dst", "n_callers", text.alias("callers"))


@query(f"WITH e AS {EDGE_SQL} SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e)")
def graph_roots(spark, d):
    return G.roots(_edges(spark, d))


@query(f"""WITH RECURSIVE e AS {EDGE_SQL}, r AS (SELECT DISTINCT src AS root, src AS node FROM e UNION SELECT root, dst FROM r JOIN e ON node = src)
SELECT root AS node, count(*) AS reach FROM r GROUP BY root""")
def reach_sizes(spark, d):
    return G.reach(_edges(spark, d))


# ---------------------------------------------------------------- evidence and rules


@query("""SELECT c_custkey, coalesce(n_name, printf('N%03X', c_nationkey)) AS label, CASE WHEN n_name IS NULL THEN 'medium' ELSE 'high' END AS confidence
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey""")
def code_dictionary(spark, d):
    known = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return E.enriched(rows, known, "c_nationkey", "n_name", F.format_string("N%03X", "c_nationkey")).drop("c_nationkey")


@query("""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, event_id, CASE event_type WHEN 'purchase' THEN 0.9 WHEN 'signup' THEN 0.68 ELSE 0.5 END AS s FROM events),
g AS (SELECT user_id, d, count(DISTINCT event_type) AS n_kinds, arg_max(event_type, {'a': s, 'b': -event_id}) AS best_kind, max(s) AS s FROM s GROUP BY user_id, d)
SELECT user_id, CAST(d AS VARCHAR) AS day, n_kinds, best_kind, round(CASE WHEN n_kinds >= 2 THEN least(0.9, s + 0.15) ELSE least(s, 0.65) END, 6)::DOUBLE AS confidence FROM g""")
def evidence_corroboration(spark, d):
    score = F.when(F.col("event_type") == "purchase", 0.9).when(F.col("event_type") == "signup", 0.68).otherwise(0.5)
    rows = table(spark, d, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type", "event_id", score.alias("s"))
    return E.corroborated(rows, ["user_id", "day"], "event_type", "s", "event_id")


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '_' || n END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def name_suffixes(spark, d):
    return E.suffixed(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "unique_name")


@query("""SELECT name, CASE WHEN b.name2 IS NULL THEN 'only_in_a' WHEN a.name1 IS NULL THEN 'only_in_b' ELSE 'common' END AS status
FROM (SELECT DISTINCT p_name AS name1, p_name AS name FROM part WHERE p_size = 1) a FULL JOIN (SELECT DISTINCT p_name AS name2, p_name AS name FROM part WHERE p_size = 2) b USING (name)""")
def name_diff(spark, d):
    part = table(spark, d, "part")
    side = lambda n: part.where(F.col("p_size") == n).select(F.col("p_name").alias("name"))
    return E.name_diff(side(1), side(2), "name")


@query("SELECT source, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY source")
def ext_rollup(spark, d):
    return E.extension_rollup(table(spark, d, "documents").select("source", F.octet_length("text").alias("size")), "source", "size")


@query("""WITH c AS (SELECT lang, source, CAST(sum(length(text)) AS BIGINT) AS size FROM documents GROUP BY lang, source),
f AS (SELECT *, source LIKE 'src1%' AND size % 2 = 0 AS named, source = 'src' || ascii(lang) % 20 AS expected FROM c),
p AS (SELECT *, CASE WHEN named AND count(*) FILTER (named) OVER (PARTITION BY lang) = 1 THEN 1 WHEN expected AND count(*) FILTER (expected) OVER (PARTITION BY lang) = 1 THEN 2 WHEN named THEN 3 ELSE 4 END AS p FROM f)
SELECT lang, source AS picked, CASE p WHEN 1 THEN 'only named' WHEN 2 THEN 'expected name' WHEN 3 THEN 'largest named' ELSE 'largest' END AS reason
FROM p QUALIFY row_number() OVER (PARTITION BY lang ORDER BY p, size DESC, source) = 1""")
def pick_main(spark, d):
    c = table(spark, d, "documents").groupBy("lang", "source").agg(F.sum(F.length("text")).alias("size"))
    c = c.withColumn("named", F.col("source").startswith("src1") & (F.col("size") % 2 == 0)).withColumn("expected", F.concat(F.lit("src"), (F.ascii("lang") % 20).cast("string")))
    return E.pick_one(c, "lang", "source", "size", "named", "expected")


MAGIC = [('<!DOCTYPE html><html lang="en"', "english page"), ('<!DOCTYPE html><html lang="fr"', "french page"), ("<!DOCTYPE", "document"), ("<html", "page")]


@query("SELECT page_id, CASE " + " ".join(f"WHEN starts_with(html, '{p}') THEN '{v}'" for p, v in MAGIC) + " ELSE 'data' END AS kind FROM pages")
def magic_classify(spark, d):
    return table(spark, d, "pages").select("page_id", E.classify_prefix(F.col("html"), MAGIC).alias("kind"))


MARKERS = ["<article", "<footer", "</body>", "<table", "&amp;"]


@query(f"SELECT page_id, marker, CAST(position(marker IN html) - 1 AS INTEGER) AS position FROM pages, (SELECT unnest({MARKERS}) AS marker) WHERE position(marker IN html) > 0")
def marker_position(spark, d):
    return E.marker_positions(table(spark, d, "pages").select("page_id", "html"), "page_id", "html", MARKERS)


@query("""SELECT page_id, p, br, li, a, 1 + p + br + li AS cyclomatic FROM (SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS p, CAST(len(regexp_extract_all(html, '<br>')) AS INTEGER) AS br,
CAST(len(regexp_extract_all(html, '<li>')) AS INTEGER) AS li, CAST(len(regexp_extract_all(html, '<a[ >]')) AS INTEGER) AS a FROM pages)""")
def control_counts(spark, d):
    n = lambda x: F.regexp_count("html", F.lit(x))
    rows = table(spark, d, "pages").select("page_id", n("<p>").alias("p"), n("<br>").alias("br"), n("<li>").alias("li"), n("<a[ >]").alias("a"))
    return rows.withColumn("cyclomatic", 1 + F.col("p") + F.col("br") + F.col("li"))


@query(r"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '(0[xX][0-9A-Fa-f]+|[0-9]+)')) AS x FROM documents),
g AS (SELECT doc_id, lower(x) AS x, CASE WHEN lower(x) LIKE '0x%' THEN regexp_replace(lower(x), '^0x0*', '') ELSE regexp_replace(x, '^0+([0-9])', '\1') END AS d FROM f),
h AS (SELECT DISTINCT doc_id, CASE WHEN x NOT LIKE '0x%' THEN d WHEN length(d) > 16 THEN '0x' || d ELSE CAST(CAST('0x0' || d AS UHUGEINT) AS VARCHAR) END AS v FROM g)
SELECT doc_id, count(*) AS n_literals, string_agg(v, ',' ORDER BY length(v), v) AS literals FROM h WHERE length(v) > 9 OR TRY_CAST(v AS BIGINT) >= 16 GROUP BY doc_id""")
def literal_extract(spark, d):
    rows = table(spark, d, "documents").select("doc_id", X.literals(F.col("text")).alias("v")).where(F.size("v") > 0)
    return rows.select("doc_id", F.size("v").cast("bigint").alias("n_literals"), F.array_join("v", ",").alias("literals"))


@query(r"""SELECT DISTINCT doc_id, CAST(line_no AS INTEGER) AS line_no, m AS match FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(lines[line_no], '[0-9]+(?:\.[0-9]+)?%?')) AS m
FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))""")
def doc_audit(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    found = F.explode(F.regexp_extract_all("line", F.lit(r"[0-9]+(?:\.[0-9]+)?%?"), F.lit(0)))
    return lines.select("doc_id", (F.col("n") + 1).alias("line_no"), found.alias("match")).distinct()


@query("""SELECT p_partkey, CASE WHEN starts_with(s, '_') THEN s[2:] WHEN ends_with(s, '_') AND NOT ends_with(s, '__') THEN s[:-2] ELSE s END AS name FROM (SELECT p_partkey,
CASE p_partkey % 4 WHEN 0 THEN '__' || p_name WHEN 1 THEN '_' || p_name WHEN 2 THEN p_name || '_' ELSE p_name || '__' END AS s FROM part)""")
def undecorate(spark, d):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    s = F.when(k == 0, F.concat(F.lit("__"), n)).when(k == 1, F.concat(F.lit("_"), n)).when(k == 2, F.concat(n, F.lit("_"))).otherwise(F.concat(n, F.lit("__")))
    return table(spark, d, "part").select("p_partkey", X.undecorate(s).alias("name"))


@query("""SELECT doc_id, CASE WHEN d >= 2 THEN 'high' WHEN d >= 0.5 THEN 'medium' ELSE 'low' END AS density FROM
(SELECT doc_id, ((length(text) - length(replace(text, ' the ', ''))) / 5) / greatest(1, length(text) / 1024) AS d FROM documents)""")
def density_rule(spark, d):
    hits = (F.length("text") - F.length(F.replace(F.col("text"), F.lit(" the "), F.lit("")))) / 5
    return table(spark, d, "documents").select("doc_id", E.density_class(hits, F.length("text")).alias("density"))


@query("SELECT p_name, arg_min(p_brand, p_partkey) AS p_brand, count(DISTINCT p_brand) AS n_values FROM part GROUP BY p_name")
def truth_first_wins(spark, d):
    return E.first_wins(table(spark, d, "part"), "p_name", "p_brand", ["p_partkey"])


@query("SELECT user_id, event_type, count(*) AS n_cases, bool_and(value > 0.5 AND value < 200) AS agrees FROM events GROUP BY user_id, event_type")
def probe_battery(spark, d):
    return E.all_cases_agree(table(spark, d, "events"), ["user_id", "event_type"], (F.col("value") > 0.5) & (F.col("value") < 200))


# ---------------------------------------------------------------- artifacts


@query("""SELECT user_id, event_id, CAST(age AS INTEGER) AS age FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age FROM events) WHERE age < 8""")
def last_k_history(spark, d):
    return A.last_k(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], 8).select("user_id", "event_id", "age")


@query("""WITH n AS (SELECT DISTINCT p_name || '/' || p_size AS stem, p_brand FROM part), k AS (SELECT stem FROM n GROUP BY stem HAVING count(*) = 2)
SELECT a.stem, a.p_brand AS a, b.p_brand AS b FROM n a JOIN n b ON a.stem = b.stem AND a.p_brand <> b.p_brand JOIN k ON k.stem = a.stem""")
def sibling_pairs(spark, d):
    stem = F.concat_ws("/", "p_name", F.col("p_size").cast("string"))
    return A.sibling_pairs(table(spark, d, "part").withColumn("stem", stem), "stem", "p_brand")


@query("""WITH f AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity < 25 GROUP BY ALL),
e AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity >= 25 GROUP BY ALL)
SELECT l_returnflag, l_linestatus, l_linenumber, coalesce(f.n, 0) AS n_found, coalesce(e.n, 0) AS n_expected FROM f FULL JOIN e USING (l_returnflag, l_linestatus, l_linenumber)
WHERE coalesce(f.n, 0) <> coalesce(e.n, 0)""")
def multiset_compare(spark, d):
    li = table(spark, d, "lineitem")
    return A.multiset_compare(li.where("l_quantity < 25"), li.where("l_quantity >= 25"), ["l_returnflag", "l_linestatus", "l_linenumber"])


# the other modules add their queries to the same registry
from . import formats, programs  # noqa: E402, F401
