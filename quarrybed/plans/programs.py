"""Queries over program analysis: scalars, rules, intervals, instructions, names, identification."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..functions import tables
from ..operators import artifacts as A
from ..operators import evidence as E
from ..operators import features as T
from ..operators import graph as G
from ..operators import identify as D
from ..operators import instructions as N
from ..operators import intervals as I
from ..operators import matching as M
from ..operators import ordered as O
from ..operators import segmentation as S
from ..session import table
from ..sources import text as L
from . import render as R
from .registry import query

c = F.col

# ---------------------------------------------------------------- scalars


@query("""SELECT p_partkey, p_partkey % 65536 * 16 + p_size AS linear, CAST(CASE WHEN p_partkey * 97 % 65536 >= 32768 THEN p_partkey * 97 % 65536 - 65536 ELSE p_partkey * 97 % 65536 END AS INTEGER) AS signed,
CAST((p_size % 50) * 512 + (1 + p_partkey % 12) * 32 + 1 + p_partkey % 28 AS INTEGER) AS packed_date, make_date(CAST(1980 + p_size % 50 AS BIGINT), 1 + p_partkey % 12, 1 + p_partkey % 28) AS date,
CAST(p_partkey % 2 * 8192 + p_partkey % 200 // 2 * 80 AS INTEGER) AS row_address, concat_ws(',', p_partkey % 256 // 64, p_partkey % 64 // 16, p_partkey % 16 // 4, p_partkey % 4) AS pixels,
CAST(p_partkey % 65536 AS INTEGER) AS word FROM part""")
def packed_values(spark, d):
    k, s = c("p_partkey"), c("p_size")
    packed = X.dos_date(1980 + s % 50, (1 + k % 12).cast("int"), (1 + k % 28).cast("int"))
    return table(spark, d, "part").select(
        "p_partkey", X.linear_address(F.format_string("%04x:%04x", k % 65536, s)).alias("linear"), X.sign16((k * 97 % 65536).cast("int")).alias("signed"),
        packed.cast("int").alias("packed_date"), X.dos_date_to_date(packed.cast("int")).alias("date"), X.framebuffer_address((k % 200).cast("int")).alias("row_address"),
        F.array_join(F.transform(X.unpack_2bpp((k % 256).cast("int")), lambda x: x.cast("string")), ",").alias("pixels"), X.le16(F.unhex(F.concat(F.lit("FF"), R.le16(k % 65536))), 1).alias("word"),
    )


@query("""SELECT doc_id, round(CASE WHEN octet_length(encode(text)) > 0 THEN length(regexp_replace(text, '[^\\x20-\\x7E]', '', 'g')) / octet_length(encode(text)) ELSE 0 END, 6) AS printable,
CAST(0 AS DOUBLE) AS zero, CASE WHEN octet_length(encode(text)) > 3 THEN position('1111' IN '10' || repeat('1', CAST(octet_length(encode(text)) AS INTEGER) - 2)) - 1 END AS needle_at FROM documents WHERE length(text) > 5""")
def byte_shares(spark, d):
    docs = table(spark, d, "documents").where(F.length("text") > 5)
    raw = F.encode("text", "UTF-8")
    mask = F.concat(F.lit("10"), F.repeat(F.lit("1"), F.length(raw) - 2))
    return docs.select("doc_id", F.round(X.printable_share(raw), 6).alias("printable"), F.round(X.zero_share(raw), 6).alias("zero"), (F.locate("1111", mask) - 1).cast("bigint").alias("needle_at"))


@query("SELECT p_partkey, p_partkey % 3 > 0 AS matches FROM part")
def mask_matches(spark, d):
    raw = F.md5(c("p_partkey").cast("string").cast("binary"))
    # a byte under the mask differs for every third row, another that is wild for the next third
    image = F.concat(F.lit("0000"), F.substring(raw, 1, 6), F.when(c("p_partkey") % 3 == 0, F.lit("0G")).otherwise(F.substring(raw, 7, 2)), F.when(c("p_partkey") % 3 == 1, F.lit("!!")).otherwise(F.substring(raw, 9, 2)), F.substring(raw, 11, 22), F.lit("zz"))
    data = F.encode(raw, "UTF-8")
    mask = F.lit("1" * 8 + "00" + "1" * 22)
    return table(spark, d, "part").select("p_partkey", X.mask_matches(data, mask, F.lit(4), F.encode(image, "UTF-8")).alias("matches"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'mov ax, bx' WHEN l_suppkey >= 40 AND l_suppkey < 60 THEN 'jmp rel+' || (l_suppkey - 40) ELSE 'jmp f' || (l_partkey % 7) || '+' || l_linenumber END AS norm FROM lineitem""")
def normalized_instructions(spark, d):
    plain = c("l_partkey") % 3 == 0
    text = F.when(plain, "mov ax, bx").otherwise(F.concat(F.lit("jmp 0x"), F.hex("l_suppkey")))
    target = F.when(plain, F.lit(None)).otherwise(c("l_suppkey"))
    callee = F.concat(F.lit("f"), (c("l_partkey") % 7).cast("string"))
    norm = X.normalized_instruction(text, target, F.lit(40), F.lit(60), callee, c("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", norm.alias("norm"))


@query("""SELECT o_orderkey, round(((CASE WHEN c > 0 THEN c ELSE 0 END) + 0.6 * n + 2.5 * coalesce(s, 0) + 0.35 * 0.5 + 0.35 * n + 1.2 * 0) / (1 + 0.6 + 0.35 + 0.35 + 1.2 + CASE WHEN s IS NULL THEN 0 ELSE 2.5 END), 6)::DOUBLE AS score
FROM (SELECT o_orderkey, o_orderkey % 7 / 7 AS c, o_custkey % 5 / 5 AS n, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 3 / 3 END AS s FROM orders)""")
def pair_scores(spark, d):
    k, u = c("o_orderkey"), c("o_custkey")
    none = F.lit(None).cast("double")
    score = X.pair_score(k % 7 / 7, F.when(k % 2 == 0, u % 3 / 3), u % 5 / 5, F.lit(0.5), u % 5 / 5, none, 0.6)
    return table(spark, d, "orders").select("o_orderkey", F.round(score, 6).alias("score"))


# ---------------------------------------------------------------- files and rules

NAMES = ("GAME.EXE", "play.com", "go.BAT", "level.ovl", "read.me", "art.zip", "score.bin", "x.cmd")
NAME_SQL = f"{list(NAMES)}[1 + p_partkey % {len(NAMES)}]"


def _named_files(spark, d):
    k = c("p_partkey")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (k % len(NAMES) + 1).cast("int"))
    number = F.when(k % 5 == 0, "0200").otherwise("0000")
    content = F.when(k % 3 == 0, F.unhex(F.concat(R.text("MZ"), R.filled(24), number))).otherwise(F.unhex(R.text(c("p_name"))))
    return table(spark, d, "part").select("p_partkey", name.alias("name"), content.alias("content"), "p_size", "p_brand")


KIND_SQL = f"""(SELECT p_partkey, p_size, p_brand, CASE WHEN p_partkey % 15 = 0 THEN 'overlay-module' WHEN p_partkey % 3 = 0 THEN 'executable' ELSE ['data', 'com', 'batch', 'overlay-or-data', 'doc', 'archive', 'data', 'batch'][1 + p_partkey % 8] END AS kind FROM part)"""


@query(f"SELECT p_partkey, kind FROM {KIND_SQL}")
def file_kinds(spark, d):
    f = _named_files(spark, d)
    return f.select("p_partkey", E.kind_of_file(c("name"), c("content")).alias("kind"))


@query(f"SELECT kind, count(*) AS n FROM {KIND_SQL} GROUP BY kind")
def kind_histogram(spark, d):
    f = _named_files(spark, d)
    return E.kind_histogram(f.select(E.kind_of_file(c("name"), c("content")).alias("kind")))


@query("""SELECT p_partkey, CASE WHEN n = 0 THEN 'tiny or packed' WHEN n <= 8 AND near >= n - 1 THEN 'small' WHEN n / greatest(1.0, p_retailprice / 100) < 0.5 THEN 'small or medium' ELSE 'compact, large or huge' END AS model
FROM (SELECT *, p_size % 12 AS n, p_partkey % 9 AS near FROM part)""")
def memory_models(spark, d):
    return table(spark, d, "part").select("p_partkey", E.memory_model(c("p_size") % 12, c("p_partkey") % 9, c("p_retailprice") / 100).alias("model"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN abs(pos - 4096) < 1024 OR p_size <= 2 OR p_retailprice / 1000 < 0.2 THEN 'blocker' ELSE 'warn' END AS level FROM (SELECT *, p_partkey * 7 % 9000 AS pos FROM part) WHERE p_partkey % 4 > 0""")
def mark_levels(spark, d):
    pos = F.when(c("p_partkey") % 4 > 0, c("p_partkey") * 7 % 9000)
    level = E.mark_level(pos, F.lit(4096), c("p_size"), c("p_retailprice") / 1000)
    return table(spark, d, "part").select(c("p_partkey").cast("string").alias("path"), level.alias("level")).where("level is not null")


TRIAGE_SQL = """t AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_partkey, p_size, p_partkey % 5 > 0 AS prog, p_partkey % 2 = 0 AS com, p_size % 12 AS n, p_partkey % 9 AS near, p_size * 600 AS img, CASE WHEN p_size % 3 = 0 THEN 2000 ELSE 10 END AS tr,
CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END AS ov, p_size / 20 AS den, p_partkey % 13 = 0 AS lz, p_partkey % 19 = 0 AS scumm, p_partkey % 11 = 0 AS rb, p_partkey * 1000 AS sib FROM part),
m AS (SELECT *, CASE WHEN n = 0 THEN 'tiny or packed' WHEN n <= 8 AND near >= n - 1 THEN 'small' WHEN n / greatest(1.0, img / 1024) < 0.5 THEN 'small or medium' ELSE 'compact, large or huge' END AS model FROM t),
f AS (SELECT path, 'route' AS level, 'raw image' AS code FROM m WHERE NOT prog AND com UNION ALL SELECT path, 'blocker', 'not an executable' FROM m WHERE NOT prog AND NOT com
UNION ALL SELECT path, 'blocker', 'packed: EXEPACK' FROM m WHERE prog AND rb UNION ALL SELECT path, 'blocker', 'packed: LZ91' FROM m WHERE prog AND lz
UNION ALL SELECT path, CASE WHEN ov <> 0 THEN 'blocker' ELSE 'warn' END, CASE WHEN ov <> 0 THEN 'overlaid' ELSE 'trailing data' END FROM m WHERE prog AND (ov <> 0 OR tr > 1024)
UNION ALL SELECT path, CASE WHEN model = 'small' THEN 'info' ELSE 'warn' END, 'model: ' || model FROM m WHERE prog UNION ALL SELECT path, 'warn', 'far data' FROM m WHERE prog AND model IN ('small or medium', 'compact, large or huge')
UNION ALL SELECT path, CASE WHEN den >= 2 THEN 'info' ELSE 'warn' END, CASE WHEN den >= 2 THEN 'compiled' WHEN den >= 0.5 THEN 'mixed frames' ELSE 'few frames' END FROM m WHERE prog
UNION ALL SELECT path, CASE WHEN scumm THEN 'blocker' ELSE 'warn' END, CASE WHEN scumm THEN 'interpreter' ELSE 'large data beside' END FROM m WHERE prog AND (scumm OR sib > 4 * greatest(1, img)))"""


def _triaged(spark, d):
    k, s = c("p_partkey"), c("p_size")
    content = F.concat(F.lit("00" * 30), F.when(k % 11 == 0, R.text("RB")).otherwise("0000"), F.lit("90" * 8), F.when(k % 13 == 0, R.text("LZ91")).otherwise(""), F.when(k % 19 == 0, R.text("SCUMM")).otherwise(""))
    rows = table(spark, d, "part").select(
        k.cast("string").alias("path"), F.when(k % 2 == 0, "a.COM").otherwise("a.exe").alias("name"), (k % 5 > 0).alias("is_program"), F.unhex(content).alias("content"), F.lit(32).alias("entry"),
        (s % 12).alias("relocations"), (k % 9).alias("near_relocations"), (s * 600).alias("image_bytes"), F.when(s % 3 == 0, 2000).otherwise(10).alias("trailing"),
        F.when(k % 17 == 0, 1).otherwise(0).alias("overlay_number"), (s / 20).alias("density"), (k * 1000).alias("largest_sibling"),
    )
    return E.triage_findings(rows)


@query(f"WITH {TRIAGE_SQL} SELECT * FROM f")
def triage_findings(spark, d):
    return _triaged(spark, d)


@query(f"WITH {TRIAGE_SQL} SELECT path, NOT bool_or(level = 'blocker') AS in_scope, CASE WHEN bool_or(code IN ('far data', 'few frames')) THEN 'low' ELSE 'high' END AS confidence, count(*) AS n_findings FROM f GROUP BY path")
def triage_verdicts(spark, d):
    return E.triage_verdict(_triaged(spark, d))


@query("""SELECT sum(CASE WHEN p_retailprice * 20 >= 16384 THEN 1 ELSE 0 END)::BIGINT AS n_notable, round(sum(CASE WHEN p_retailprice * 20 >= 16384 THEN p_retailprice * 20 ELSE 0 END), 2) AS bytes,
count(*) FILTER (p_retailprice * 20 >= 16384) >= 2 AND sum(CASE WHEN p_retailprice * 20 >= 16384 THEN p_retailprice * 20 ELSE 0 END) / 100000 > 4 AS is_engine FROM part""")
def engine_ratio(spark, d):
    out = E.engine_ratio(table(spark, d, "part").withColumn("size", c("p_retailprice") * 20), F.lit(100000), "size")
    return out.withColumn("bytes", F.round("bytes", 2))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_partkey % 2 = 0 AS is_library, CASE WHEN p_partkey % 3 = 0 THEN 'M' || p_partkey || '.LIB(x)' ELSE 'm.' || CASE WHEN p_partkey % 2 = 0 THEN 'lib' ELSE 'obj' END END AS short FROM part WHERE p_partkey % 3 > 0 OR p_partkey % 2 = 0")
def library_modules(spark, d):
    from ..sources import signatures as Z

    k = c("p_partkey")
    module = F.when(k % 3 == 0, F.concat(F.lit("C:\\a/b\\M"), k.cast("string"), F.lit(".LIB(x)"))).when(k % 2 == 0, "lib/m.lib").otherwise("m.obj")
    rows = table(spark, d, "part").where((k % 3 > 0) | (k % 2 == 0))
    return rows.select(k.cast("string").alias("path"), Z.is_library(module).alias("is_library"), Z.short_module(module).alias("short"))


# ---------------------------------------------------------------- evidence and names

WORDS = tuple(tables.INTERRUPTS) + tuple(tables.PORTS)


def _table_sql(values: dict) -> str:
    return "(VALUES " + ", ".join(f"({k}, '{v.replace(chr(39), chr(39) * 2)}')" for k, v in values.items()) + ")"


EVIDENCE_SQL = f"""fn AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS address, p_partkey % 64 AS i, 32 + p_partkey % 1000 AS p, CASE p_partkey % 4 WHEN 0 THEN 47104 WHEN 1 THEN 320 ELSE 7 END AS s FROM part),
ev AS (SELECT address, 'interrupt' AS kind, CASE WHEN t IS NULL THEN 'medium' ELSE 'high' END AS confidence, coalesce(t, printf('uses INT %02Xh', i)) AS claim, 0 AS n FROM fn LEFT JOIN {_table_sql(tables.INTERRUPTS)} x(k, t) ON k = i
UNION ALL SELECT address, 'port', CASE WHEN t IS NULL THEN 'medium' ELSE 'high' END, coalesce(t, printf('talks to port %03Xh', p)), 1 FROM fn LEFT JOIN {_table_sql(tables.PORTS)} x(k, t) ON k = p
UNION ALL SELECT address, 'constant', 'medium', t, 2 FROM fn JOIN {_table_sql(tables.CONSTANTS)} x(k, t) ON k = s)"""


def _evidence(spark, d):
    k = c("p_partkey")
    fn = table(spark, d, "part").select(k.cast("string").alias("entry"), F.array(k % 64).alias("interrupts"), F.array(32 + k % 1000).alias("io_ports"), F.array(F.when(k % 4 == 0, 47104).when(k % 4 == 1, 320).otherwise(7)).alias("scalars"))
    return E.machine_evidence(fn)


@query(f"WITH {EVIDENCE_SQL} SELECT address, kind, confidence, claim FROM ev")
def machine_evidence(spark, d):
    return _evidence(spark, d).drop("n")


ROLE_SQL = "(VALUES " + ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', '{v}')" for k, v in tables.ROLES.items()) + ")"


@query(f"""WITH {EVIDENCE_SQL}, kinds AS (SELECT address, count(DISTINCT kind) AS n_kinds FROM ev GROUP BY address),
named AS (SELECT address, base, CASE confidence WHEN 'high' THEN 0.68 ELSE 0.5 END AS s, n FROM ev JOIN {ROLE_SQL} r(c, base) ON claim = c),
best AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY address ORDER BY s DESC, n) = 1),
sc AS (SELECT address, base, round(CASE WHEN n_kinds >= 2 THEN least(0.9, s + 0.15) ELSE least(s, 0.65) END, 3)::DOUBLE AS score, n_kinds FROM best JOIN kinds USING (address))
SELECT address, base || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '_' || row_number() OVER w END AS name, score, n_kinds, n_kinds >= 2 AS corroborated FROM sc WINDOW w AS (PARTITION BY base ORDER BY address)""")
def proposed_names(spark, d):
    return E.proposed_names(_evidence(spark, d))


@query("""WITH e AS (SELECT user_id, event_type, CAST(floor(value) AS INTEGER) % 4 AS claim, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS rank, event_id FROM events),
o AS (SELECT user_id, event_type, claim, min(rank) AS r, min(event_id) AS o, count(*) AS n FROM e GROUP BY ALL),
g AS (SELECT user_id, min(r) AS best_rank, sum(n)::BIGINT AS n_found, min(o) AS first, count(*) AS n_claims FROM o GROUP BY user_id)
SELECT user_id, best_rank, n_found, n_claims, row_number() OVER (ORDER BY best_rank, n_found DESC, first, user_id) AS place FROM g""")
def summarised_evidence(spark, d):
    rank = F.when(c("event_type") == "purchase", 0).when(c("event_type") == "signup", 1).otherwise(2)
    rows = table(spark, d, "events").select("user_id", "event_type", (F.floor("value").cast("int") % 4).alias("claim"), rank.alias("rank"), "event_id")
    out = E.summarised(rows, "user_id", "event_type", "claim", "rank", "event_id")
    return out.select("user_id", "best_rank", "n_found", F.size("claims").cast("bigint").alias("n_claims"), "place")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS entry, CASE WHEN st = 'applied' THEN p_name || CASE WHEN sc < 0.7 THEN '__maybe' ELSE '' END END AS applied, st AS status, st = 'applied' AND p_size * 10 >= 200 AS long_routine
FROM (SELECT *, p_partkey % 100 / 100 AS sc, CASE WHEN p_partkey % 100 / 100 < 0.45 THEN 'refused' WHEN p_partkey % 7 = 0 THEN 'missing' ELSE 'applied' END AS st FROM part)""")
def written_names(spark, d):
    part, k = table(spark, d, "part"), c("p_partkey")
    mapping = part.select(c("p_name").alias("source"), k.cast("string").alias("binary"), (k % 100 / 100).alias("score"))
    return E.written_names(mapping, part.where(k % 7 > 0).select(k.cast("string").alias("entry"), (c("p_size") * 10).alias("size")))


@query("SELECT p_name, count(DISTINCT p_brand) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def name_clashes(spark, d):
    return E.clashes(table(spark, d, "part"), "p_name", "p_brand")


# ---------------------------------------------------------------- intervals


@query("""SELECT e.event_id, s.event_id AS session FROM events e JOIN (SELECT event_id, ts, ts + (CAST(floor(value) AS BIGINT) + 1) * INTERVAL 30 SECOND AS until FROM events WHERE event_type = 'signup') s ON e.ts >= s.ts AND e.ts < s.until""")
def interval_join(spark, d):
    e = table(spark, d, "events").withColumn("pos", F.unix_micros(c("ts").cast("timestamp")))
    s = e.where("event_type = 'signup'").select(c("event_id").alias("session"), c("pos").alias("a"), (c("pos") + (F.floor("value") + 1) * 30_000_000).alias("z"))
    return I.interval_join(e.select("event_id", "pos"), s, "pos", "a", "z").select("event_id", "session")


@query("""WITH i AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + 7200000000 AS z FROM events WHERE event_type = 'signup')
SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM events e WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.user_id = e.user_id AND epoch_us(e.ts) >= a AND epoch_us(e.ts) < z)""")
def outside_intervals(spark, d):
    e = table(spark, d, "events").withColumn("pos", F.unix_micros(c("ts").cast("timestamp")))
    i = e.where("event_type = 'signup'").select("user_id", c("pos").alias("a"), (c("pos") + 7_200_000_000).alias("z"))
    return I.outside(e, i, "event_id", "pos", "a", "z", ["user_id"]).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def _segments_sql():
    return "(SELECT o_custkey, o_orderstatus AS kind, o_orderkey * 10 AS a, o_orderkey * 10 + 1 + o_custkey % 9 AS z FROM orders)"


@query(f"""SELECT o_custkey, kind, sum(greatest(0, least(z, 100000) - greatest(a, 500)))::BIGINT AS bytes, round(sum(greatest(0, least(z, 100000) - greatest(a, 500))) / 99500, 9) AS share FROM {_segments_sql()} GROUP BY o_custkey, kind""")
def coverage_totals(spark, d):
    o = table(spark, d, "orders")
    rows = o.select("o_custkey", c("o_orderstatus").alias("kind"), (c("o_orderkey") * 10).alias("start"), (c("o_orderkey") * 10 + 1 + c("o_custkey") % 9).alias("end"))
    regions = o.select("o_custkey").distinct().select("o_custkey", F.lit(500).alias("lo"), F.lit(100000).alias("hi"))
    return I.coverage_totals(rows, regions, "o_custkey", "kind").withColumn("share", F.round("share", 9))


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase' AND value > 10) AS explained, count(*) FILTER (event_type IN ('purchase', 'click')) AS reached, round(CASE WHEN count(*) FILTER (event_type IN ('purchase', 'click')) > 0 THEN count(*) FILTER (event_type = 'purchase' AND value > 10) / count(*) FILTER (event_type IN ('purchase', 'click')) ELSE 0 END, 9) AS fraction FROM events GROUP BY user_id")
def explained_fraction(spark, d):
    out = I.explained_fraction(table(spark, d, "events"), (c("event_type") == "purchase") & (c("value") > 10), c("event_type").isin("purchase", "click"), ["user_id"])
    return out.withColumn("fraction", F.round("fraction", 9))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, ['zero', 'text', 'table', 'other'][1 + p_partkey % 4] AS kind, p_size + 8 AS n FROM part""")
def residue_kinds(spark, d):
    k, n = c("p_partkey"), c("p_size") + 8
    half = F.ceil(n / 2).cast("int")
    bytes_ = (
        F.when(k % 4 == 0, R.filled(n)).when(k % 4 == 1, R.filled(n, "41")).when(k % 4 == 2, F.substr(F.repeat(R.le16(256 + 32 + k % 40), half), F.lit(1), n * 2)).otherwise(R.filled(n, "F7"))
    )
    images = R.files(table(spark, d, "part"), k, R.filled(16, "90"), bytes_, R.filled(200, "90")).withColumnRenamed("content", "image")
    images = images.select("path", "image", F.lit(10).alias("lo"), F.length("image").alias("hi"), F.lit(256).alias("base"))
    gaps = table(spark, d, "part").select(k.cast("string").alias("path"), F.lit(16).alias("start"), (16 + n).alias("end"))
    return I.residue(gaps, images).select("path", "kind", (c("end") - c("start")).cast("int").alias("n"))


@query("""SELECT p_partkey, unnest(range(p_size, -1, -3)) AS i FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, unnest(range(0, p_size + 1, 1)) FROM part WHERE p_partkey % 2 = 1""")
def counted_loops(spark, d):
    k, s = c("p_partkey"), c("p_size")
    return I.counted(table(spark, d, "part").select("p_partkey", "p_size"), F.when(k % 2 == 0, s).otherwise(0), F.when(k % 2 == 0, 0).otherwise(s), F.when(k % 2 == 0, -3).otherwise(1)).select("p_partkey", "i")


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 3 = 1 THEN p_size + 10 ELSE 0 END AS INTEGER) AS entries FROM part")
def terminated_tables(spark, d):
    k, s = c("p_partkey"), c("p_size")
    image = F.concat(R.filled(8), R.filled(s, "11"), F.when(k % 3 == 0, "FF").otherwise(""), F.when(k % 3 == 2, R.filled(200, "22")).otherwise(R.filled(10, "33")))
    return table(spark, d, "part").select("p_partkey", I.terminated_length(F.unhex(image), F.lit(8)).cast("int").alias("entries"))


@query("""SELECT o_custkey, min(a) AS a, max(z) AS z FROM (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS run FROM
(SELECT *, coalesce(a > max(z) OVER (PARTITION BY o_custkey ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM
(SELECT o_custkey, o_orderkey AS a, o_orderkey + CAST(floor(o_totalprice / 200) AS BIGINT) AS z FROM orders) WHERE z > a)) GROUP BY o_custkey, run""")
def merged_intervals(spark, d):
    o = table(spark, d, "orders").select("o_custkey", c("o_orderkey").alias("a"), (c("o_orderkey") + F.floor(c("o_totalprice") / 200)).alias("z"))
    return I.merged(o, "a", "z", ["o_custkey"])


@query("""WITH g AS (SELECT o_custkey, o_orderkey % 3 AS k, o_totalprice AS p FROM orders), x AS (SELECT o_custkey, k, CAST(floor(p / 1000) AS BIGINT) AS n FROM g),
b AS (SELECT o_custkey, CASE k WHEN 0 THEN 0 WHEN 1 THEN 500 ELSE 2000 - n END AS s, CASE k WHEN 0 THEN n WHEN 1 THEN 500 + n ELSE 2000 END AS e FROM x)
SELECT o_custkey, coalesce(max(e) FILTER (e - s > 300 AND e - s >= 256 AND s = 0), 0)::BIGINT AS lo, coalesce(min(s) FILTER (e - s > 300 AND e - s >= 256 AND e = 2000), 2000)::BIGINT AS hi FROM b GROUP BY o_custkey""")
def body_bounds(spark, d):
    n, k = F.floor(c("o_totalprice") / 1000), c("o_orderkey") % 3
    start, end = F.when(k == 0, 0).when(k == 1, 500).otherwise(2000 - n), F.when(k == 0, n).when(k == 1, 500 + n).otherwise(2000)
    gaps = table(spark, d, "orders").select("o_custkey", start.alias("gap_start"), end.alias("gap_end"))
    return gaps.groupBy("o_custkey").agg(A.body_bounds(gaps, 2000).alias("b")).select("o_custkey", c("b.lo").cast("bigint").alias("lo"), c("b.hi").cast("bigint").alias("hi"))


@query("""WITH w AS (SELECT p_partkey, p_partkey % 4 AS k, [p_size, p_size + 5, p_size + 9] AS o FROM part)
SELECT p_partkey, CAST(CASE k WHEN 0 THEN 3 WHEN 1 THEN 2 END AS INTEGER) AS entries, CAST(CASE k WHEN 0 THEN 4 WHEN 1 THEN 2 END AS INTEGER) AS stride FROM w""")
def index_files(spark, d):
    k, s = c("p_partkey"), c("p_size")
    # pairs of (key, offset) with a terminator; offsets alone; offsets that fall; offsets beyond the file
    words = F.when(k % 4 == 0, F.array(F.lit(7), s, F.lit(1), s + 5, F.lit(3), s + 9, F.lit(0xFFFF), s + 9, F.lit(0), F.lit(0)))
    words = words.when(k % 4 == 1, F.array(s, s + 5, s + 9)).when(k % 4 == 2, F.array(s + 9, s + 5, s, s + 9, s + 1, s)).otherwise(F.array(s, s + 5, s + 9, s + 9000))
    out = O.index_of(words, F.lit(100))
    return table(spark, d, "part").select("p_partkey", out["entries"].alias("entries"), out["stride"].alias("stride"))


# ---------------------------------------------------------------- order and segments


@query("""SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type, false) AS is_boundary FROM events""")
def boundary_flags(spark, d):
    return S.boundary_flags(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "is_boundary")


@query("SELECT user_id, event_type, count(DISTINCT CAST(floor(value) AS BIGINT)) AS n_distinct FROM events GROUP BY user_id, event_type")
def distinct_per_segment(spark, d):
    return S.distinct_per_segment(table(spark, d, "events").withColumn("v", F.floor("value")), ["user_id", "event_type"], "v")


@query("""SELECT p_partkey AS pos FROM (SELECT p_partkey, 0.65 * least(p_size / 20, 2.0) / 2 + 0.35 * (p_retailprice % 100) / 100 AS s FROM part) WHERE s < 0.2""")
def threshold_cuts(spark, d):
    score = S.gap_score(c("p_size") / 20, (c("p_retailprice") % 100) / 100)
    return S.threshold_cuts(table(spark, d, "part").select(c("p_partkey").alias("pos"), score.alias("score")), "pos", "score", 0.2)


@query("""SELECT path, name, CAST(row_number() OVER (ORDER BY coalesce(r, 1000000), line, name) AS BIGINT) AS place FROM (SELECT p_brand AS path, p_name || p_partkey AS name, p_size AS line, CASE WHEN p_brand < 'Brand#2' THEN CAST(p_brand[7:] AS INTEGER) END AS r FROM part)""")
def source_order(spark, d):
    part = table(spark, d, "part").select(c("p_brand").alias("path"), F.concat("p_name", c("p_partkey").cast("string")).alias("name"), c("p_size").alias("line"))
    ranks = part.select("path").distinct().where("path < 'Brand#2'").select("path", F.substring("path", 7, 9).cast("int").alias("rank"))
    return M.source_order(part, ranks, "path", "line", "name").select("path", "name", "place")


@query("""WITH a AS (SELECT p_brand AS f, p_partkey AS pos FROM part WHERE p_size % 5 = 0), m AS (SELECT f, list_sort(list(pos))[count(*) // 2 + 1] AS m FROM a GROUP BY f)
SELECT p_brand AS f, CAST(row_number() OVER (ORDER BY m.m NULLS LAST, p_brand) AS INTEGER) AS rank FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN m ON m.f = p_brand""")
def inferred_order(spark, d):
    part = table(spark, d, "part").select(c("p_brand").alias("f"), c("p_partkey").alias("pos"), "p_size")
    return M.infer_order(part.where("p_size % 5 = 0"), part, "f", "pos").select("f", "rank")


@query("""SELECT count(*) FILTER (m = t) AS correct, count(*) FILTER (m IS NOT NULL AND m <> t) AS wrong, count(*) FILTER (m IS NULL) AS missing
FROM (SELECT p_partkey % 50 AS t, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS m FROM part)""")
def mapping_truth(spark, d):
    part, k = table(spark, d, "part"), c("p_partkey")
    mapping = part.where(k % 3 > 0).select(k.alias("a"), c("p_size").cast("bigint").alias("b"))
    return M.evaluate_mapping(mapping, part.select(k.alias("a"), (k % 50).alias("b")), "a", "b")


@query("""WITH m AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_partkey % 3 = 0), e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_linenumber <= 2), g AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_linenumber % 2 = 0),
n AS (SELECT s, count(*) AS mapped FROM e JOIN m USING (p) GROUP BY s), h AS (SELECT s, count(*) AS hits FROM e JOIN m USING (p) JOIN g USING (s, p) GROUP BY s)
SELECT s AS a, round(CASE WHEN mapped > 0 THEN coalesce(hits, 0) / mapped ELSE 0 END, 9) AS neighbours FROM (SELECT DISTINCT s FROM g) LEFT JOIN n USING (s) LEFT JOIN h USING (s)""")
def neighbour_scores(spark, d):
    li = table(spark, d, "lineitem")
    name = lambda p, x: F.concat(F.lit(p), c(x).cast("string"))
    edges = lambda where: li.where(where).select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst")).distinct()
    b = edges("l_linenumber % 2 = 0")
    mapping = li.where("l_partkey % 3 = 0").select(name("p", "l_partkey").alias("a"), name("p", "l_partkey").alias("b")).distinct()
    pairs = b.select(c("src").alias("a"), c("src").alias("b")).distinct()
    got = M.neighbour_score(mapping, edges("l_linenumber <= 2"), b, pairs, "a", "b")
    return got.select(F.substring("a", 2, 20).cast("bigint").alias("a"), F.round("neighbours", 9).alias("neighbours"))


# ---------------------------------------------------------------- graphs

CALL_SQL = "e AS (SELECT DISTINCT o_custkey % 40 AS src, o_custkey % 40 * 2 + 1 + o_orderkey % 2 AS dst FROM orders WHERE o_custkey % 40 < 20)"


def _calls(spark, d):
    k = c("o_custkey") % 40
    return table(spark, d, "orders").where(k < 20).select(k.alias("src"), (k * 2 + 1 + c("o_orderkey") % 2).alias("dst")).distinct()


@query(f"WITH {CALL_SQL} SELECT src, dst FROM e WHERE dst IN (SELECT src FROM e)")
def known_edges(spark, d):
    e = _calls(spark, d)
    return G.known_edges(e, e.select("src").distinct(), "src")


@query(f"""WITH RECURSIVE {CALL_SQL}, r AS (SELECT DISTINCT src AS root, src AS node FROM e UNION SELECT root, dst FROM r JOIN e ON node = src), z AS (SELECT root AS node, count(*) AS reach FROM r GROUP BY root)
SELECT * FROM (SELECT node, reach FROM z WHERE node NOT IN (SELECT dst FROM e) ORDER BY reach DESC, node DESC LIMIT 3) WHERE reach >= 10""")
def top_roots(spark, d):
    return G.top_roots(_calls(spark, d))


@query()
def descend_to_main(spark, d):
    e = _calls(spark, d)
    return spark.createDataFrame([(G.descend(e, G.reach(e), 0),)], "main bigint")


@query("""WITH b AS (SELECT l_orderkey AS f, l_partkey % 50 AS s, l_returnflag AS t FROM lineitem), e AS (SELECT DISTINCT l_orderkey AS f, l_partkey % 50 AS s, l_suppkey % 50 AS d FROM lineitem)
SELECT f AS function, blocks, coalesce(edges, 0) AS edges, coalesce(loops, 0) AS loops, returns, indirect, greatest(0, coalesce(edges, 0) - blocks + 2) AS cyclomatic FROM
(SELECT f, count(DISTINCT s) AS blocks, count(DISTINCT s) FILTER (t = 'R') AS returns, count(DISTINCT s) FILTER (t = 'A') AS indirect FROM b GROUP BY f) LEFT JOIN (SELECT f, count(*) AS edges, count(*) FILTER (d <= s) AS loops FROM e GROUP BY f) USING (f)""")
def flow_counters(spark, d):
    li = table(spark, d, "lineitem")
    ends = F.when(c("l_returnflag") == "R", "return").when(c("l_returnflag") == "A", "indirect").otherwise("jump")
    blocks = li.select(c("l_orderkey").alias("function"), (c("l_partkey") % 50).alias("start"), ends.alias("ends"))
    return A.flow_counters(blocks, li.select(c("l_orderkey").alias("function"), (c("l_partkey") % 50).alias("src"), (c("l_suppkey") % 50).alias("dst")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s < 3 THEN CASE WHEN o % 2 = 0 THEN 'Unit' || s || '.Proc' || o ELSE 'Unit' || s || '+' || printf('%04X', o) END ELSE printf('%04X', s + 16) || ':' || printf('%04X', o) END AS target
FROM (SELECT *, l_suppkey % 5 AS s, l_partkey % 100 AS o FROM lineitem)""")
def far_names(spark, d):
    calls = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (c("l_suppkey") % 5 + 16).alias("segment"), (c("l_partkey") % 100).alias("offset"))
    unit = lambda x: F.concat(F.lit("Unit"), x.cast("string"))
    units = spark.range(3).select(c("id").alias("segment"), unit(c("id")).alias("unit"))
    symbols = spark.range(3).select(unit(c("id")).alias("unit"), F.explode(F.sequence(F.lit(0), F.lit(98), F.lit(2))).alias("offset")).withColumn("symbol", F.concat(F.lit("Proc"), c("offset").cast("string")))
    return A.far_names(calls, units, symbols, 16).select("l_orderkey", "l_linenumber", "l_partkey", "target")


@query("""SELECT DISTINCT 'v' || (l_suppkey % 50) AS variable, l_partkey AS target FROM lineitem WHERE l_linenumber > 1 AND l_suppkey % 50 IN (SELECT l_suppkey % 50 FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 2)""")
def dispatch_targets(spark, d):
    v = F.concat(F.lit("[v"), (c("l_suppkey") % 50).cast("string"), F.lit("]"))
    jump = F.when(c("l_quantity") < 2, F.concat(F.lit("call word "), v)).otherwise("nop")
    store = F.concat(F.lit("mov word "), v, F.lit(", "), F.when(c("l_partkey") % 2 == 0, c("l_partkey").cast("string")).otherwise(F.concat(F.lit("0x"), F.lower(F.hex("l_partkey")))))
    return A.dispatch_targets(table(spark, d, "lineitem").select(F.when(c("l_linenumber") == 1, jump).otherwise(store).alias("text")))


# ---------------------------------------------------------------- instructions


def _instructions(spark, d):
    """One listing a customer, an instruction an order: loads of bx, jumps through it, compares and carry flips."""
    k = c("o_orderkey") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("mov bx, 0x"), F.lower(F.hex(c("o_orderkey"))))).when(k == 1, "add si, 4").when(k == 2, "jmp [cs:bx + 0x10]").when(k == 3, "cmp ax, bx").when(k == 4, "cmc").otherwise("jmp word [si]")
    )
    return table(spark, d, "orders").select(c("o_custkey").cast("string").alias("path"), c("o_orderkey").alias("off"), text.alias("text"))


@query("""WITH i AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS off, o_orderkey % 6 AS k FROM orders),
w AS (SELECT *, last_value(CASE WHEN k = 0 THEN off END IGNORE NULLS) OVER p AS bx, last_value(CASE WHEN k = 1 THEN 4 END IGNORE NULLS) OVER p AS si FROM i WINDOW p AS (PARTITION BY path ORDER BY off ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING))
SELECT path, off, 'bx' AS register, CAST(16 AS BIGINT) AS displacement, 'mov' AS op, bx AS value, bx + 16 AS "table" FROM w WHERE k = 2 AND bx IS NOT NULL
UNION ALL SELECT path, off, 'si', 0, 'add', si, si FROM w WHERE k = 5 AND si IS NOT NULL""")
def jump_tables(spark, d):
    return N.jump_tables(_instructions(spark, d))


@query("""WITH i AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS off, o_orderkey % 6 AS k, lag(o_orderkey % 6) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders),
g AS (SELECT path, count(*) FILTER (k = 4) AS n_cmc, count(*) FILTER (k = 4 AND b = 3) AS a, count(*) FILTER (k = 3) AS m FROM i GROUP BY path)
SELECT path, n_cmc, round(CASE WHEN n_cmc > 0 THEN a / n_cmc ELSE 0 END, 9) AS share, round(CASE WHEN m > 0 THEN a / m ELSE 0 END, 9) AS covered, n_cmc >= 20 AND a / n_cmc > 0.85 AND a / m > 0.5 AS translated FROM g""")
def provenance(spark, d):
    return N.provenance(_instructions(spark, d)).withColumn("share", F.round("share", 9)).withColumn("covered", F.round("covered", 9))


def _symbols(spark, d):
    part, k = table(spark, d, "part"), c("p_partkey")
    name = F.concat(F.lit("n"), k.cast("string"))
    return part.where(k % 4 == 0).select(k.alias("address"), name.alias("name")), part.where(k % 3 == 0).select(F.when(k % 2 == 0, "cs").alias("segment"), k.alias("address"), name.alias("name"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'n' || p_partkey ELSE printf('L_%05X', p_partkey) END || ': mov ax, [' || CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'cs:n' || p_partkey ELSE printf('cs:0x%04x', p_partkey) END
|| '] [bp + ' || printf('0x%04x', p_partkey) || '] [bx + ' || CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 1 THEN 'n' || p_partkey ELSE printf('0x%04x', p_partkey) END || ']' AS line,
CAST(CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS routine_hits, CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS variable_hits FROM part""")
def renamed_lines(spark, d):
    k = c("p_partkey")
    line = F.concat(F.format_string("L_%05X", k), F.format_string(": mov ax, [cs:0x%04x] [bp + 0x%04x] [bx + 0x%04x]", k, k, k))
    return N.renamed_lines(table(spark, d, "part").select("p_partkey", line.alias("line")), *_symbols(spark, d))


@query("""WITH p AS (SELECT p_partkey AS k FROM part), l AS (SELECT k FROM p WHERE k % 5 > 0), calls AS (SELECT DISTINCT k * 3 % (SELECT max(k) + 1 FROM p) AS k FROM p WHERE k % 7 = 0), r AS (SELECT k FROM p WHERE k % 4 = 0),
ref AS (SELECT DISTINCT CASE WHEN k % 2 = 0 THEN 'cs' END AS s, k FROM p WHERE k % 2 = 0 OR k % 5 = 1), v AS (SELECT k FROM p WHERE k % 3 = 0),
j AS (SELECT DISTINCT k AS here, (k + 9) AS t FROM l WHERE k % 11 = 0), o AS (SELECT here, t, (SELECT max(k) FROM r WHERE r.k <= here) AS ho, (SELECT max(k) FROM r WHERE r.k <= t) AS o FROM j)
SELECT 'unnamed call' AS kind, NULL AS segment, k AS address FROM calls WHERE k NOT IN (SELECT k FROM r) UNION ALL SELECT 'ghost', NULL, k FROM r WHERE k NOT IN (SELECT k FROM l)
UNION ALL SELECT CASE WHEN k % 3 = 0 THEN 'named' WHEN k % 10 = 2 THEN 'settled' ELSE 'unnamed' END, s, k FROM ref
UNION ALL SELECT DISTINCT 'tail', NULL, t FROM o WHERE ho IS DISTINCT FROM o AND t NOT IN (SELECT k FROM r) AND t NOT IN (SELECT k FROM calls)""")
def name_audit(spark, d):
    part, k = table(spark, d, "part"), c("p_partkey")
    top = part.agg(F.max("p_partkey") + 1).first()[0]
    routines, variables = _symbols(spark, d)
    # each part writes: its label, then a call, a bracketed constant and a jump under it
    label = F.when(k % 5 > 0, F.format_string("L_%05X:", k)).otherwise("; none")
    call = F.when(k % 7 == 0, F.format_string("  call L_%05X", k * 3 % F.lit(top))).otherwise("  nop")
    ref = F.when(k % 2 == 0, F.format_string("  mov ax, [cs:0x%04x]", k)).when(k % 5 == 1, F.format_string("  mov [bx + 0x%04x], al", k)).otherwise("  nop")
    jump = F.when((k % 11 == 0) & (k % 5 > 0), F.format_string("  jmp strict near L_%05X", k + 9)).otherwise("  ret")
    lines = part.select(k, F.posexplode(F.array(label, call, ref, jump)).alias("i", "line")).select((k * 4 + c("i")).alias("n"), "line")
    # variables of this listing: the segment is given where the reference gives one
    variables = variables.select(F.when(c("address") % 2 == 0, "cs").alias("segment"), "address", "name")
    return N.name_audit(lines, routines, variables, part.where(k % 10 == 2).select(k.alias("address")))


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey % 3 > 0 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def unreferenced(spark, d):
    part = table(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_size")
    return N.unreferenced(part.where("p_size < 25"), table(spark, d, "lineitem"), part.where("l_partkey % 3 = 0"), "l_partkey")


@query("SELECT s_suppkey AS k, 'supplier' AS origin FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer UNION ALL SELECT p_partkey, 'part' FROM part")
def concatenated_libraries(spark, d):
    return A.concatenated({n: table(spark, d, n).select(c(k).alias("k")) for n, k in (("supplier", "s_suppkey"), ("customer", "c_custkey"), ("part", "p_partkey"))})


@query("""WITH f AS (SELECT p_brand AS path, p_partkey * 100 AS entry, p_partkey * 100 + p_size AS stop FROM part), called AS (SELECT p_brand AS path, p_partkey * 100 + 20 AS e FROM part WHERE p_partkey % 3 = 0),
b AS (SELECT path, min(entry) AS lo, max(stop) + 100 AS hi FROM f GROUP BY path), ptr AS (SELECT DISTINCT p_brand AS path, lo + p_size * 7 AS e FROM part JOIN b ON b.path = p_brand WHERE p_size * 7 BETWEEN 16 AND 65535 AND p_size * 7 < hi - lo),
pro AS (SELECT p_brand AS path, p_partkey * 100 + 10 AS e FROM part WHERE p_partkey % 2 = 0),
every AS (SELECT path, entry AS e, 0 AS p, 'known' AS origin FROM f UNION ALL SELECT path, e, 1, 'call' FROM called
UNION ALL SELECT path, e, 2, 'pointer' FROM ptr WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.path = ptr.path AND ptr.e >= entry AND ptr.e < stop)
UNION ALL SELECT path, e, 3, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.path = pro.path AND pro.e >= entry AND pro.e < stop) THEN 'split' ELSE 'prologue' END FROM pro)
SELECT path, e AS entry, arg_min(origin, p) AS origin FROM every GROUP BY path, e""")
def recovered_functions(spark, d):
    part, k = table(spark, d, "part"), c("p_partkey")
    f = part.select(c("p_brand").alias("path"), (k * 100).alias("entry"), (k * 100 + c("p_size")).alias("stop"))
    blocks = f.groupBy("path").agg(F.min("entry").alias("block_start"), (F.max("stop") + 100).alias("block_end"))
    calls = part.where(k % 3 == 0).select(c("p_brand").alias("path"), (k * 100 + 20).alias("target"))
    pointers = part.select(c("p_brand").alias("path"), (c("p_size") * 7).alias("value"))
    starts = part.where(k % 2 == 0).select(c("p_brand").alias("path"), (k * 100 + 10).alias("at"))
    return N.recovered_functions(f, calls, pointers, starts, blocks)


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_size + 0 AS at FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_size + 8 FROM part WHERE p_partkey % 2 = 0")
def prologue_places(spark, d):
    k, s = c("p_partkey"), c("p_size")
    image = [R.filled(s, "90"), F.lit("558BEC9090909090"), F.when(k % 2 == 0, "C8100200").otherwise("C8100201"), R.filled(5, "90")]
    return N.prologues(R.files(table(spark, d, "part"), k, *image).withColumnRenamed("content", "image"))


@query("""WITH o AS (SELECT user_id, event_type, CAST(floor(value) AS BIGINT) % 5 AS v FROM events), t AS (SELECT user_id, count(DISTINCT v) FILTER (event_type = 'error') AS n, bool_or(event_type = 'signup') AND user_id % 2 = 0 AS part, count(DISTINCT event_type) AS kinds FROM o GROUP BY user_id)
SELECT user_id FROM t WHERE CASE WHEN part THEN n >= 4 ELSE n > 0 OR kinds > 1 END""")
def informative_observations(spark, d):
    e = table(spark, d, "events")
    v = (F.floor("value") % 5).cast("string")
    none = F.array().cast("array<string>")
    rows = e.select(
        "user_id", ((c("event_type") == "signup") & (c("user_id") % 2 == 0)).alias("partial"), c("event_type").alias("ax"), F.lit(0).alias("dx"), F.lit(0).alias("calls"),
        F.when(c("event_type") == "error", F.array(v)).otherwise(none).alias("writes"), none.alias("reads"),
    )
    return T.informative(rows, "user_id")


# ---------------------------------------------------------------- conflicts and identification


@query()
def conflict_free(spark, d):
    items = table(spark, d, "part").select(c("p_partkey").alias("k"), c("p_size").alias("s"))
    conflicts = table(spark, d, "lineitem").where("l_quantity < 3").select(c("l_partkey").alias("a"), ((c("l_partkey") * 7 + c("l_suppkey")) % 2000).alias("b")).where("a <> b").distinct()
    return A.conflict_free(items, conflicts, "k", "s")


def _two_builds(spark, d):
    """Two builds of one program, after a fashion: a function a part, its constants are its suppliers, it calls other parts. The
    second build loses some constants and calls, and names nothing."""
    part, li = table(spark, d, "part"), table(spark, d, "lineitem")
    k = c("p_partkey")
    name = lambda x: F.concat(F.lit("f"), x.cast("string"))
    entry = lambda x: (x * 16 + x % 7).cast("string")
    facts = li.groupBy("l_partkey").agg(
        F.array_sort(F.collect_set(c("l_suppkey") * 100 + c("l_linenumber"))).alias("all"), F.array_sort(F.collect_set(F.when(c("l_linenumber") < 6, c("l_suppkey") * 100 + c("l_linenumber")))).alias("some"),
        F.array_sort(F.collect_set(c("l_orderkey") % F.lit(200))).alias("to"),
    )
    rows = part.join(facts, k == c("l_partkey"), "left")
    text = F.when(k % 3 == 0, F.array(F.concat("p_name", F.lit(" "), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    src = rows.select(
        name(k).alias("name"), c("p_brand").alias("file"), k.cast("int").alias("line"), (4 + c("p_size")).alias("body_lines"), c("all").alias("constants"), text.alias("strings"), F.transform("to", name).alias("calls"),
        (1 + c("p_size") % 7).alias("cyclomatic"), (c("p_size") % 3).alias("loops"), (c("p_size") % 2).alias("returns"),
    )
    binary = rows.select(
        entry(k).alias("entry"), ((4 + c("p_size")) * 2).alias("instruction_count"), c("some").alias("scalars"), text.alias("strings"), F.transform(F.filter("to", lambda x: x % 5 > 0), entry).alias("calls"),
        (1 + c("p_size") % 7).alias("cyclomatic"), (c("p_size") % 3).alias("loops"), (c("p_size") % 4).alias("returns"),
    )
    return src, binary


@query()
def identify_functions(spark, d):
    found = D.identify(D.gathered(*_two_builds(spark, d), exclude_files=("brand#1",)))
    return found.select("source", "binary", F.round("score", 9).alias("score"))


@query()
def aligned_functions(spark, d):
    ev = D.gathered(*_two_builds(spark, d))
    anchors = D.identify(ev, rounds=1)
    return D.align(ev, anchors, D.module_order(ev, anchors)).withColumn("score", F.round("score", 9))
