"""Queries over the sources: rows are written in a format and read back, and SQL says from the rows what must come out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..session import table
from ..shared import scratch_path
from ..sources import binary as B
from ..sources import omf, sinks
from ..sources import pascal as P
from ..sources import signatures as G
from ..sources import text as S
from . import render as R
from .registry import query

c = F.col

# ---------------------------------------------------------------- executables

MZ_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS path, 'MZ' AS magic, CAST(p_partkey % 512 AS INTEGER) AS last_page, CAST(p_size % 4 AS INTEGER) AS pages, CAST(p_partkey % 7 AS INTEGER) AS n_reloc,
2 AS header_paras, CAST(p_size AS INTEGER) AS min_alloc, CAST(65535 - p_size AS INTEGER) AS max_alloc, CAST(p_partkey % 96 AS INTEGER) AS ss, 256 AS sp, 0 AS checksum, CAST(p_size * 3 AS INTEGER) AS ip,
CAST(p_partkey % 100 AS INTEGER) AS cs, 28 AS reloc_off, CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS overlay, CAST(32 AS BIGINT) AS image_start,
CAST(CASE WHEN p_size % 4 = 0 THEN 32 + p_partkey % 2048 ELSE (p_size % 4) * 512 - CASE WHEN p_partkey % 512 > 0 THEN 512 - p_partkey % 512 ELSE 0 END END AS BIGINT) AS image_end,
CAST(32 + p_partkey % 2048 AS BIGINT) AS file_size FROM part"""


def _programs(spark, d):
    k, s = c("p_partkey"), c("p_size")
    words = (k % 512, s % 4, k % 7, F.lit(2), s, 65535 - s, k % 96, F.lit(256), F.lit(0), s * 3, k % 100, F.lit(28), F.when(k % 3 == 0, 1).otherwise(0))
    return R.files(table(spark, d, "part"), k, R.text("MZ"), *map(R.le16, words), R.filled(4), R.filled(k % 2048))


@query(MZ_SQL)
def mz_headers(spark, d):
    return B.mz_headers(_programs(spark, d))


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN octet_length(encode(coalesce(text, ''))) < 28 THEN 'shorter than a header' ELSE 'no MZ magic' END AS error
FROM documents WHERE NOT starts_with(coalesce(text, ''), 'MZ') AND NOT starts_with(coalesce(text, ''), 'ZM') OR octet_length(encode(coalesce(text, ''))) < 28""")
def mz_errors(spark, d):
    return B.mz_errors(R.files(table(spark, d, "documents"), c("doc_id"), R.text(F.coalesce(c("text"), F.lit("")))))


@query(f"SELECT path, greatest(0, least(image_end, file_size) - 32) AS image_bytes, CAST(cs * 16 + ip AS BIGINT) AS entry, true AS is_mz FROM ({MZ_SQL})")
def load_images(spark, d):
    return B.load_images(_programs(spark, d)).select("path", F.length("image").cast("bigint").alias("image_bytes"), "entry", "is_mz")


@query(f"""SELECT path, greatest(0, e - 32) AS image_bytes, CAST(cs * 16 + ip AS BIGINT) AS entry FROM (SELECT *, (pages - 1) * 512 + CASE WHEN last_page = 0 THEN 512 ELSE last_page END AS e FROM ({MZ_SQL}))
WHERE file_size >= 64 AND e <= file_size AND n_reloc <= 4""")
def single_segments(spark, d):
    return B.single_segments(_programs(spark, d), 4).select("path", F.length("image").cast("bigint").alias("image_bytes"), "entry")


@query(f"""WITH m AS ({MZ_SQL}) SELECT path, 'info' AS level, 'trailing-data' AS code FROM m WHERE file_size > image_end UNION ALL SELECT path, 'warn', 'truncated' FROM m WHERE file_size < image_end
UNION ALL SELECT path, 'warn', 'stack-above-image' FROM m WHERE ss * 16 + sp > image_end - image_start + min_alloc * 16 UNION ALL SELECT path, 'info', 'no-relocations' FROM m WHERE n_reloc = 0
UNION ALL SELECT path, 'warn', 'overlay-number' FROM m WHERE overlay <> 0""")
def header_findings(spark, d):
    return B.header_findings(B.mz_headers(_programs(spark, d)))


RELOC_SQL = """(SELECT CAST(l_orderkey AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS idx,
CAST(l_suppkey % 8 AS INTEGER) AS seg, CAST(l_partkey % 600 AS INTEGER) AS off, l_suppkey % 8 * 16 + l_partkey % 600 AS linear,
CAST(CASE WHEN l_suppkey % 8 * 16 + l_partkey % 600 + 2 <= 640 THEN (l_suppkey % 8 * 16 + l_partkey % 600) % 251 + 256 * ((l_suppkey % 8 * 16 + l_partkey % 600 + 1) % 251) END AS INTEGER) AS value FROM lineitem)"""


def _relocations(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), R.in_order([c("l_linenumber"), c("l_partkey"), c("l_suppkey")], F.concat(R.le16(c("l_partkey") % 600), R.le16(c("l_suppkey") % 8))).alias("t")
    )
    zero = F.lit(0)
    words = (zero, zero, c("n"), F.lit(32), zero, zero, zero, zero, zero, zero, zero, F.lit(28), zero)
    body = "".join(f"{i % 251:02X}" for i in range(640))
    return B.relocations(R.files(g, c("l_orderkey"), R.text("MZ"), *map(R.le16, words), c("t"), R.filled(512 - 28 - 4 * c("n")), F.lit(body)))


@query(f"SELECT * FROM {RELOC_SQL}")
def relocations(spark, d):
    return _relocations(spark, d)


@query(f"SELECT path, value, count(*) AS n FROM {RELOC_SQL} WHERE value IS NOT NULL GROUP BY path, value")
def segment_references(spark, d):
    return B.segment_references(_relocations(spark, d))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 3 = 0 THEN 'EXEPACK' ELSE 'LZEXE' END AS packer, CAST(p_partkey % 60000 AS INTEGER) AS ip, CAST(p_size AS INTEGER) AS cs,
CAST(p_size + 1 AS INTEGER) AS sp, CAST(p_size + 2 AS INTEGER) AS ss, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size + 3 END AS INTEGER) AS dest_paragraphs FROM part WHERE p_partkey % 3 < 2""")
def packers(spark, d):
    k, s, zero = c("p_partkey"), c("p_size"), F.lit(0)
    head = lambda ip, cs: [R.text("MZ"), *map(R.le16, (zero, zero, zero, F.lit(2), *[zero] * 5, F.lit(ip), F.lit(cs), F.lit(28), zero))]
    exepack = F.concat(*head(0, 1), R.filled(4), *map(R.le16, (k % 60000, s, zero, zero, s + 1, s + 2, s + 3)), R.text("RB"), R.filled(20))
    block = lambda check: [*map(R.le16, (k % 60000, s, s + 1, s + 2, F.lit(check), zero, zero, zero))]
    lzexe, other = (F.concat(*head(14, 3), R.text("LZ91"), R.filled(48), *block(x)) for x in (3, 4))
    return B.packers(R.files(table(spark, d, "part"), k, F.when(k % 3 == 0, exepack).when(k % 3 == 1, lzexe).otherwise(other)))


# ---------------------------------------------------------------- strings

STRING_SQL = """s AS (SELECT o_custkey, o_orderkey, o_orderpriority AS t, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS sep FROM orders),
p AS (SELECT *, coalesce(sum(sep + 1 + length(t)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sep AS "at" FROM s),
h AS (SELECT CAST(o_custkey AS VARCHAR) AS path, CAST("at" AS BIGINT) AS "at", t AS text FROM p WHERE length(t) >= 6)"""


def _strings(spark, d):
    piece = F.concat(F.when(c("o_orderkey") % 3 == 0, "00").otherwise(""), F.format_string("%02X", F.length("o_orderpriority")), R.text(c("o_orderpriority")))
    g = table(spark, d, "orders").groupBy("o_custkey").agg(R.in_order([c("o_orderkey")], piece).alias("h"))
    return B.pascal_strings(R.files(g, c("o_custkey"), c("h")))


@query(f"WITH {STRING_SQL} SELECT * FROM h")
def pascal_strings(spark, d):
    return _strings(spark, d)


@query(f"""WITH {STRING_SQL}, n AS (SELECT *, "at" + 1 + length(text) AS e, coalesce(lag("at" + 1 + length(text)) OVER (PARTITION BY path ORDER BY "at") <> "at", true) AS new FROM h),
r AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY "at") AS run FROM n)
SELECT path, min("at") AS run_start, max(e) AS run_end, count(*) AS n FROM r GROUP BY path, run HAVING count(*) >= 2 AND max(e) - min("at") >= 24""")
def string_runs(spark, d):
    return B.string_runs(_strings(spark, d))


# ---------------------------------------------------------------- rasters, containers, volumes


@query("""SELECT CAST(c_custkey AS VARCHAR) AS path, CAST(4 + c_custkey % 5 AS INTEGER) AS width, 3 AS height, 8 AS bits, 1 AS planes,
CAST(list_sum([(c_custkey + 7 * x) % 192 + (c_custkey + 7 * x + 6) % 192 FOR x IN range(0, 4 + c_custkey % 5)]) + (4 + c_custkey % 5) * (c_custkey % 192) AS BIGINT) AS pixel_sum FROM customer""")
def pcx_images(spark, d):
    k = c("c_custkey")
    w = (4 + k % 5).cast("int")
    row = lambda y: F.array_join(F.transform(F.sequence(F.lit(0), w - 1), lambda x: F.format_string("%02X", (k + x * 7 + y * 3) % 192)), "")
    head = [F.lit("0A050108"), *map(R.le16, (F.lit(0), F.lit(0), w - 1, F.lit(2))), R.filled(65 - 12), F.lit("01"), R.le16(w), R.filled(128 - 68)]
    run = F.concat(F.format_string("%02X", 0xC0 + w), F.format_string("%02X", k % 192))
    got = B.pcx_images(R.files(table(spark, d, "customer"), k, *head, row(0), run, row(2)))
    total = F.aggregate(F.flatten("pixels"), F.lit(0).cast("bigint"), lambda n, v: n + v)
    return got.select("path", "width", "height", "bits", "planes", total.alias("pixel_sum"))


@query("""SELECT p_brand AS path, 'P' || p_partkey || '.PCX' AS name, CAST(122 + 84 + coalesce(sum(84 + p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "at",
CAST(p_size AS BIGINT) AS size FROM part""")
def container_members(spark, d):
    name = F.concat(F.lit("P"), c("p_partkey").cast("string"), F.lit(".PCX"))
    entry = F.concat(F.lit("01"), R.text(name), R.filled(17 - F.length(name)), R.le32(c("p_size")), R.filled(62), R.filled(c("p_size"), "41"))
    g = table(spark, d, "part").groupBy("p_brand").agg(R.in_order([c("p_partkey")], entry).alias("h"))
    return B.container_members(R.files(g, c("p_brand"), R.text("pcxLib"), R.filled(0x7A - 6), c("h"), R.filled(100)))


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS path, CASE WHEN s_suppkey % 2 = 1 THEN 'SUB/' ELSE '' END || 'S' || s_suppkey || '.TXT' AS name, CAST(40 * length(s_name) AS BIGINT) AS size, false AS is_dir,
md5(repeat(s_name, 40)) AS data_md5 FROM supplier UNION ALL SELECT DISTINCT CAST(s_nationkey AS VARCHAR), 'SUB', 0, true, NULL FROM supplier""")
def fat12_files(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("rows")

    def volume(v):
        both = [[(f"S{r['s_suppkey']}.TXT", r["s_name"].encode() * 40) for r in v["rows"] if r["s_suppkey"] % 2 == k] for k in (0, 1)]
        return R.fat12_volume(both[0], "SUB", both[1])

    # a volume numbers 4,078 clusters at most, so a nation has as many volumes as its files need; its folder is one
    volumes = table(spark, d, "supplier").groupBy("s_nationkey", F.floor(c("s_suppkey") / 1000)).agg(rows)
    got = B.fat12_files(R.encoded(volumes, c("s_nationkey"), ["rows"], volume)).select("path", "name", "size", "is_dir", F.md5("data").alias("data_md5"))
    return got.where(~c("is_dir")).unionByName(got.where("is_dir").distinct())


# ---------------------------------------------------------------- object modules and signatures

CODE_SQL = "(SELECT *, 8 + p_size AS n, p_size % 6 AS \"at\" FROM part)"


def _modules(spark, d):
    def module(v):
        k, n = v["p_partkey"], 8 + v["p_size"]
        return R.object_module(f"m{k}", bytes((k + i) % 256 for i in range(n)), v["p_size"] % 6, f"_f{k}", k % 8)

    return R.encoded(table(spark, d, "part"), c("p_partkey"), ["p_partkey", "p_size"], module)


@query(f"""SELECT CAST(p_partkey AS VARCHAR) AS path, 'm' || p_partkey AS module, 1 AS segment, '_TEXT' AS name, 'CODE' AS class, CAST(n AS INTEGER) AS size, CAST(n - 2 AS INTEGER) AS fixed_bytes,
repeat('1', CAST("at" AS INTEGER)) || '00' || repeat('1', CAST(n - "at" - 2 AS INTEGER)) AS mask FROM {CODE_SQL}""")
def omf_segments(spark, d):
    return omf.segments(_modules(spark, d)).drop("data")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 'm' || p_partkey AS module, 1 AS segment, p_partkey % 8 AS off, '_f' || p_partkey AS name FROM part")
def omf_publics(spark, d):
    return omf.publics(_modules(spark, d))


HIT_SQL = """h AS (SELECT CAST(d.doc_id AS VARCHAR) AS path, 'item ' || item_id AS name, len(string_split(d.text, b.text)) - 1 AS n, octet_length(encode(b.text)) AS length,
octet_length(encode(string_split(d.text, b.text)[1])) AS "at" FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE octet_length(encode(b.text)) >= 16)"""


def _signature_hits(spark, d):
    docs = table(spark, d, "documents").where(c("text").isNotNull())
    b = table(spark, d, "benchmark").where(c("text").isNotNull())
    raw = F.encode("text", "UTF-8")
    sigs = b.select(F.concat(F.lit("item "), c("item_id").cast("string")).alias("name"), F.concat(F.lit("lib"), (c("item_id") % 3).cast("string")).alias("module"), F.lower(F.hex(raw)).alias("bytes"), F.repeat(F.lit("1"), F.length(raw)).alias("mask"))
    return G.signature_hits(docs.select(c("doc_id").cast("string").alias("path"), raw.alias("content")), sigs)


@query(f"WITH {HIT_SQL} SELECT path, name, CAST(least(n, 8) AS BIGINT) AS n, CAST(\"at\" AS BIGINT) AS \"at\", CAST(length AS INTEGER) AS length FROM h")
def signature_hits(spark, d):
    return _signature_hits(spark, d).groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"), F.max("length").alias("length"))


@query(f"""WITH {HIT_SQL}, u AS (SELECT path, "at", arg_max(name, {{'a': length, 'b': name}}) AS name, count(*) AS n_sharing FROM h WHERE n = 1 GROUP BY path, "at")
SELECT path, CAST("at" AS BIGINT) AS "at", name, n_sharing, CAST(n_sharing - 1 AS INTEGER) AS n_also FROM u""")
def placed_signatures(spark, d):
    return G.placed(_signature_hits(spark, d)).select("path", "at", "name", "n_sharing", F.size("also_matches").alias("n_also"))


ENTRY_SQL = "(SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR)) AS h, p_partkey % 4 = 0 AS wild FROM part)"


@query(f"""SELECT 'x' AS path, p_partkey AS "at", 'f' || p_partkey AS name, 'm' AS module, CAST(CASE WHEN wild THEN 14 ELSE 15 END AS INTEGER) AS fixed_bytes FROM {ENTRY_SQL}""")
def match_entries(spark, d):
    part = table(spark, d, "part")
    raw = F.md5(c("p_partkey").cast("string").cast("binary"))
    wild = c("p_partkey") % 4 == 0
    mask = F.concat(F.when(wild, "0").otherwise("1"), F.lit("111110"), F.repeat(F.lit("1"), F.lit(9)))
    sigs = part.select(F.concat(F.lit("f"), c("p_partkey").cast("string")).alias("name"), F.lit("m").alias("module"), raw.alias("bytes"), mask.alias("mask"))
    # in the image the wild bytes differ, and code goes on behind the signature
    code = F.concat(F.when(wild, "EE").otherwise(F.substring(raw, 1, 2)), F.substring(raw, 3, 10), F.lit("DD"), F.substring(raw, 15, 18), F.lit("9090"))
    return G.match_entries(part.select(F.lit("x").alias("path"), c("p_partkey").alias("at"), F.unhex(code).alias("code")), sigs)


@query("""WITH s AS (SELECT p_brand AS path, p_partkey * 16 AS off, 'f' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'C:\\lib\\clib.lib(m' || p_partkey || ')' ELSE 'main.obj' END AS module FROM part),
e AS (SELECT *, coalesce(lead(off) OVER (PARTITION BY path ORDER BY off, name), off + 32) - off AS len FROM s)
SELECT name, 'clib.lib(m' || name[2:] || ')' AS module, CAST(len AS BIGINT) AS length, CAST(least(len, 32) AS INTEGER) AS n_bytes, CAST(least(len, 32) - 2 AS INTEGER) AS n_fixed FROM e WHERE module <> 'main.obj'""")
def build_signatures(spark, d):
    part = table(spark, d, "part")
    module = F.when(c("p_partkey") % 2 == 0, F.concat(F.lit("C:\\lib\\clib.lib(m"), c("p_partkey").cast("string"), F.lit(")"))).otherwise("main.obj")
    symbols = part.select(c("p_brand").alias("path"), (c("p_partkey") * 16).alias("offset"), F.concat(F.lit("f"), c("p_partkey").cast("string")).alias("name"), module.alias("module"))
    images = symbols.groupBy("path").agg(F.max("offset").alias("m")).select("path", F.unhex(F.repeat(F.lit("90"), (c("m") + 32).cast("int"))).alias("image"))
    wild = symbols.select("path", (c("offset") + 3).alias("at"), F.lit(2).alias("n"))
    got = G.build_signatures(symbols, images, wild)
    return got.select("name", "module", "length", (F.length("bytes") / 2).cast("int").alias("n_bytes"), F.length(F.replace(c("mask"), F.lit("0"), F.lit(""))).alias("n_fixed"))


@query("""WITH s AS (SELECT CAST(p_size AS VARCHAR) AS path, p_brand AS module, 's' || p_partkey AS name, CAST(floor(p_retailprice) AS INTEGER) AS fixed, p_partkey % 3 AS n FROM part)
SELECT path, module, arg_max(name, {'f': fixed, 'a': -CAST(name[2:] AS BIGINT)}) AS name, CAST(arg_max(CAST(name[2:] AS BIGINT), {'f': fixed, 'a': -CAST(name[2:] AS BIGINT)}) AS BIGINT) AS "at"
FROM s WHERE n < 2 GROUP BY path, module""")
def first_placeable(spark, d):
    part = table(spark, d, "part")
    name = F.concat(F.lit("s"), c("p_partkey").cast("string"))
    segments = part.select(c("p_brand").alias("module"), name.alias("name"), c("p_retailprice").cast("int").alias("fixed_bytes"))
    places = F.when(c("p_partkey") % 3 == 2, F.array(c("p_partkey"), c("p_partkey") + 1)).otherwise(F.array("p_partkey"))
    hits = part.select(c("p_size").cast("string").alias("path"), c("p_brand").alias("module"), name.alias("name"), F.explode(places).alias("at"))
    return G.first_placeable(hits, segments)


@query("""WITH p AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), t AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linestatus = 'O'),
s AS (SELECT (SELECT count(*) FROM p JOIN t USING (l_partkey)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM t) AS nt)
SELECT tp, np - tp AS fp, nt - tp AS fn, round_even(tp / greatest(1, np), 6) AS precision, round_even(tp / greatest(1, nt), 6) AS recall FROM s""")
def detection(spark, d):
    li = table(spark, d, "lineitem")
    return G.detection(li.where("l_returnflag = 'R'"), li.where("l_linestatus = 'O'"), ["l_partkey"])


# ---------------------------------------------------------------- Pascal images


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS path, CAST(l_linenumber % 4 AS INTEGER) AS segment, count(*) AS n_calls, count(DISTINCT l_partkey % 16) AS n_entries, CAST(min(l_partkey % 16) AS INTEGER) AS first_entry
FROM lineitem GROUP BY l_suppkey, l_linenumber % 4""")
def far_calls(spark, d):
    call = F.concat(F.lit("9A"), R.le16(c("l_partkey") % 16), R.le16(c("l_linenumber") % 4 + 16))
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(R.in_order([c("l_orderkey"), c("l_linenumber"), c("l_partkey")], call).alias("h"))
    return P.far_calls(R.files(g, c("l_suppkey"), R.filled(64, "90"), c("h"), R.filled(16, "90")), 16)


@query("""WITH r AS (SELECT l_suppkey, l_linenumber % 3 AS k FROM lineitem), b AS (SELECT unnest([0, 16]) AS base)
SELECT CAST(l_suppkey AS VARCHAR) AS path, CAST(base AS BIGINT) AS base, CAST(count(*) FILTER (k = 0 AND base = 0 OR k = 1 AND base = 16) AS INTEGER) AS resolved, CAST(count(*) AS INTEGER) AS total
FROM r, b GROUP BY l_suppkey, base""")
def string_scores(spark, d):
    # a string at 4, another at 4 + 16 + 20: reached by offset 4 from base 0, by offset 24 from base 16, or by none
    k = c("l_linenumber") % 3
    ref = F.concat(F.lit("BF"), R.le16(F.when(k == 0, 4).when(k == 1, 24).otherwise(60)), F.lit("0E57"))
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(R.in_order([c("l_orderkey"), c("l_linenumber"), c("l_partkey")], ref).alias("h"))
    head = [R.filled(4), F.lit("06"), R.text("FIRST!"), R.filled(29), F.lit("07"), R.text("ANOTHER"), R.filled(52)]
    images = R.files(g, c("l_suppkey"), *head, c("h"), R.filled(8))
    bases = images.select("path", F.explode(F.array(F.lit(0), F.lit(16))).alias("base"))
    return P.string_scores(images, bases)


@query()
def verbatim_cover(spark, d):
    docs = table(spark, d, "documents").where(c("text").isNotNull()).select(c("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    b = table(spark, d, "benchmark").where(c("text").isNotNull())
    libraries = b.groupBy((c("item_id") % 2).cast("string").alias("library")).agg(F.encode(R.in_order([c("item_id")], F.concat("text", F.lit("\x00"))), "UTF-8").alias("data"))
    return P.verbatim_cover(docs, libraries).where("covered > 0")


@query()
def pascal_units(spark, d):
    call = F.concat(F.lit("9A"), R.le16(c("l_quantity").cast("int")), R.le16(c("l_linenumber") * 4))
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(R.in_order([c("l_orderkey"), c("l_linenumber"), c("l_partkey")], call).alias("h"))
    return P.units(R.files(g, c("l_suppkey"), R.filled(600, "90"), c("h"), R.filled(16, "90")))


# ---------------------------------------------------------------- linker maps

MAP_SQL = """s AS (SELECT p_brand AS path, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS seg, p_partkey % 60000 AS off, CASE p_partkey % 4 WHEN 0 THEN '_' || 'f' || p_partkey WHEN 1 THEN 'f' || p_partkey || '_' ELSE 'f' || p_partkey END AS symbol,
last_value(CASE WHEN p_partkey % 5 = 0 THEN 'lib' || p_size || '.lib(m)' END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS module FROM part),
m AS (SELECT path, p_partkey, symbol, 'f' || p_partkey AS name, printf('%04x:%04x', seg, off) AS address, seg * 16 + off AS linear, module, seg FROM s)"""


def _maps(spark, d):
    k = c("p_partkey")
    n = F.concat(F.lit("f"), k.cast("string"))
    symbol = F.when(k % 4 == 0, F.concat(F.lit("_"), n)).when(k % 4 == 1, F.concat(n, F.lit("_"))).otherwise(n)
    line = F.concat(
        F.when(k % 5 == 0, F.format_string("Module: lib%d.lib(m)\n", "p_size")).otherwise(""),
        F.format_string(" %04X:%04X  ", F.when(k % 3 == 0, 1).otherwise(0), k % 60000), symbol, F.lit("\n"),
    )
    g = table(spark, d, "part").groupBy("p_brand").agg(R.in_order([k], line).alias("t"), F.count(F.lit(1)).alias("n"))
    return R.text_files(g, c("p_brand"), F.format_string(" _TEXT  CODE  DGROUP 0000:0000 %08X\n junk  OTHER  X 0000:0000 10\n _DATA  data  DGROUP 0001:0000 20\n\n", "n"), c("t"))


@query(f"WITH {MAP_SQL} SELECT path, symbol, name, address, linear, module FROM m")
def map_symbols(spark, d):
    return S.map_symbols(_maps(spark, d)).drop("n")


@query("SELECT p_brand AS path, '_TEXT' AS name, 'CODE' AS class, '0000:0000' AS address, count(*) AS size FROM part GROUP BY p_brand UNION ALL SELECT DISTINCT p_brand, '_DATA', 'data', '0001:0000', 32 FROM part")
def map_segments(spark, d):
    return S.map_segments(_maps(spark, d)).select("path", "name", "class", "address", "size")


@query(f"WITH {MAP_SQL} SELECT path, name, address, CAST(0 AS BIGINT) AS collisions FROM m")
def truth_map(spark, d):
    return S.truth_map(S.map_symbols(_maps(spark, d)))


@query(f"WITH {MAP_SQL} SELECT path, name, linear AS \"offset\", module FROM m WHERE seg = 0")
def code_symbols(spark, d):
    return S.code_symbols(S.map_symbols(_maps(spark, d)))


@query(f"WITH {MAP_SQL} SELECT path, 1 AS paragraph FROM m WHERE seg = 1 GROUP BY path")
def data_group(spark, d):
    return S.data_group(S.map_symbols(_maps(spark, d)))


# ---------------------------------------------------------------- JSON documents, trees, sinks


def _written(df, name: str, by: str):
    """One text file a row of (by, value) below a scratch folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(by).text(path)
    return path


@query("""SELECT p_brand AS program, 'f' || p_partkey AS name, printf('%04x:%04x', 4096, p_partkey % 65536) AS entry, CAST(p_size AS BIGINT) AS size, CAST(p_size AS INTEGER) AS instruction_count,
'f' || (p_partkey + 1) || ',' || 'f' || (p_partkey + 2) AS calls FROM part WHERE p_partkey % 10 <> 0""")
def exported_functions(spark, d):
    k, n = c("p_partkey"), lambda i: F.concat(F.lit("f"), (c("p_partkey") + i).cast("string"))
    fields = [n(0).alias("name"), F.format_string("%04x:%04x", F.lit(4096), k % 65536).alias("entry"), c("p_size").alias("size"), (k % 10 == 0).alias("thunk"), c("p_size").alias("instruction_count"), F.array(n(1), n(2)).alias("calls")]
    g = table(spark, d, "part").groupBy("p_brand").agg(F.collect_list(F.struct(*fields)).alias("functions"))
    path = _written(g.select("p_brand", F.to_json(F.struct(c("p_brand").alias("program"), "functions")).alias("value")), "functions", "p_brand")
    return S.read_functions(spark, path + "/*").select("program", "name", "entry", "size", "instruction_count", F.array_join("calls", ",").alias("calls"))


def _symbols(spark, d):
    k = c("p_partkey")
    entry = lambda test, key, *v: F.map_from_entries(F.collect_list(F.when(test, F.struct(key.alias("k"), F.array(*v).alias("v")))))
    g = table(spark, d, "part").groupBy("p_brand").agg(
        entry(k % 4 == 0, F.format_string("%05X", k), c("p_name"), F.lit("why")).alias("routines"),
        entry(k % 4 == 1, F.concat(F.when(k % 8 == 1, "cs:").otherwise(""), F.format_string("0x%04X", k)), c("p_name"), F.lit("seen")).alias("globals"),
        entry(k % 4 == 2, F.format_string("0x%05X", k), F.lit("a table"), c("p_size").cast("string")).alias("_data_spans"),
        entry(k % 4 == 3, F.format_string("0x%04X", k), F.lit("an offset")).alias("_displacements"),
    )
    return _written(g.select("p_brand", F.to_json(F.struct("routines", "globals", "_data_spans", "_displacements")).alias("value")), "symbols", "p_brand")


@query("SELECT p_partkey AS address, p_name AS name, 'why' AS why FROM part WHERE p_partkey % 4 = 0")
def symbol_routines(spark, d):
    return S.symbol_file(spark, _symbols(spark, d))["routines"]


@query("SELECT p_partkey AS start, CAST(p_size AS BIGINT) AS length FROM part WHERE p_partkey % 4 = 2")
def symbol_spans(spark, d):
    return S.symbol_file(spark, _symbols(spark, d))["spans"]


@query("SELECT p_partkey AS address FROM part WHERE p_partkey % 4 = 3")
def symbol_decided(spark, d):
    return S.symbol_file(spark, _symbols(spark, d))["decided"]


@query("""SELECT 'p_brand=' || replace(p_brand, '#', '%23') AS program, count(*) FILTER (p_partkey % 4 = 0) AS routines, count(*) FILTER (p_partkey % 4 = 1) AS globals, count(*) FILTER (p_partkey % 4 = 2) AS spans,
CAST(coalesce(sum(p_size) FILTER (p_partkey % 4 = 2), 0) AS BIGINT) AS span_bytes FROM part GROUP BY p_brand""")
def symbol_counts(spark, d):
    path = _symbols(spark, d)
    return S.symbol_counts(spark, path).withColumn("program", F.regexp_replace("program", "%2523", "%23"))


@query("SELECT p_brand, CAST(sum(length(p_name) + 1) AS BIGINT) AS bytes FROM part GROUP BY p_brand")
def tree_files(spark, d):
    path = _written(table(spark, d, "part").select("p_brand", c("p_name").alias("value")), "tree", "p_brand")
    got = B.read_tree(spark, path, "*.txt")
    brand = F.regexp_replace(F.regexp_extract("path", r"p_brand=([^/]*)/", 1), "%(25)?23", "#")
    return got.groupBy(brand.alias("p_brand")).agg(F.sum("length").alias("bytes"))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def written_result(spark, d):
    path = scratch_path(spark, "result")
    sinks.write_result(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path, "json")
    return spark.read.schema("s_suppkey bigint, s_name string, s_nationkey int").json(path)


@query("SELECT printf('%06x-%06x %s', o_orderkey, o_orderkey + 9, o_orderpriority) AS line FROM orders")
def name_list(spark, d):
    path = scratch_path(spark, "names")
    rows = table(spark, d, "orders").select(c("o_orderkey").alias("start"), (c("o_orderkey") + 9).alias("end"), c("o_orderpriority").alias("module"))
    sinks.write_name_list(rows, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM t),
y AS (SELECT doc_id, i, l[i] AS line, octet_length(encode(l[i])) AS n FROM x)
SELECT CAST(doc_id AS VARCHAR) AS path, coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, CAST(n AS BIGINT) AS length,
round(CASE WHEN n > 0 THEN length(regexp_replace(line, '[^\\x20-\\x7E]', '', 'g')) / n ELSE 0 END, 6) AS printable_share FROM y""")
def region_map(spark, d):
    docs = table(spark, d, "documents").where(c("text").isNotNull()).select(c("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("image"), "text")
    lines = docs.select("path", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("path", "i", F.octet_length("line").cast("bigint").alias("n"))
    before = F.coalesce(F.sum(c("n") + 1).over(Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    regions = lines.withColumn("start", before).select("path", F.lit("line").alias("kind"), "start", (c("start") + c("n")).alias("end"))
    return I.region_map(regions, docs).select("path", "start", "length", F.round("printable_share", 6).alias("printable_share"))


# ---------------------------------------------------------------- sources and listings


def _c_sources(spark, d):
    k, s, n = c("p_partkey"), c("p_size"), c("p_partkey").cast("string")
    return R.text_files(
        table(spark, d, "part"), F.concat(F.lit("p"), n, F.lit(".c")),
        F.concat(F.lit("/* part "), n, F.lit(" if (x) */\n#define LIM_"), n, F.lit(" ("), n, F.lit(" + 16)\nextern int v"), n, F.lit(";\nchar buf"), n, F.lit("[10];\ntypedef unsigned T"), n, F.lit(";\nstatic int f"), n, F.lit("(a, b)\nint a;\nint b;\n{\n")),
        F.repeat(F.lit("    if (a) { b = b + 20; }\n"), s % 4), F.repeat(F.lit("    while (b) b--;\n"), s % 3),
        F.concat(F.lit("    g"), (k % 10).cast("string"), F.lit("(LIM_"), n, F.lit(', "'), c("p_name"), F.lit('");\n    return a;\n}\n')),
    )


@query("""SELECT 'p' || p_partkey || '.c' AS path, 'f' || p_partkey AS name, 6 AS line, 'knr' AS style, 2 AS param_count, 'static int' AS return_hint, CAST(4 + p_size % 4 + p_size % 3 AS INTEGER) AS body_lines, 'g' || (p_partkey % 10) AS calls,
array_to_string(list_sort(list_distinct(CASE WHEN p_size % 4 > 0 THEN [20, p_partkey + 16] ELSE [p_partkey + 16] END)), ',') AS constants, p_name AS strings, CAST(p_size % 4 AS INTEGER) AS ifs, CAST(p_size % 3 AS INTEGER) AS loops,
CAST(1 + p_size % 4 + p_size % 3 AS INTEGER) AS cyclomatic, CAST(CASE WHEN p_size % 4 > 0 THEN 2 ELSE 1 END AS INTEGER) AS max_depth FROM part""")
def source_inventory(spark, d):
    got = S.source_inventory(_c_sources(spark, d))
    joined = [F.array_join(F.transform(x, lambda v: v.cast("string")), ",").alias(x) for x in ("calls", "constants", "strings")]
    return got.select("path", "name", "line", "style", "param_count", "return_hint", "body_lines", *joined, "shape.ifs", "shape.loops", "shape.cyclomatic", "shape.max_depth")


@query("""SELECT 'p' || p_partkey || '.c' AS path, 'v' || p_partkey AS name, 'extern int' AS type, 3 AS line, true AS extern, false AS array FROM part
UNION ALL SELECT 'p' || p_partkey || '.c', 'buf' || p_partkey, 'char', 4, false, true FROM part""")
def source_globals(spark, d):
    return S.source_globals(_c_sources(spark, d))


@query("SELECT 'p' || p_partkey || '.c' AS path, 'T' || p_partkey AS name, 5 AS line FROM part")
def source_types(spark, d):
    return S.source_types(_c_sources(spark, d))


@query("SELECT 'LIM_' || p_partkey AS name, CAST(p_partkey + 16 AS BIGINT) AS value FROM part")
def resolved_macros(spark, d):
    return spark.createDataFrame(sorted(S.known_macros(_c_sources(spark, d)).items()), "name string, value bigint")


@query("""SELECT 'p' || p_partkey || '.c' AS path, md5(chr(10) || '#x' || p_partkey || ' ' || p_name || chr(10) || chr(10) || 'y') AS text_md5 FROM part""")
def comment_free(spark, d):
    n = c("p_partkey").cast("string")
    f = R.text_files(table(spark, d, "part"), F.concat(F.lit("p"), n, F.lit(".c")), F.lit("/* a\n* b */#x"), n, F.lit("/**/"), c("p_name"), F.lit("\n/* open \"\n*/y"))
    return S.comment_free(f).select("path", F.md5(c("text").cast("binary")).alias("text_md5"))


def _asm_sources(spark, d):
    k, n = c("p_partkey"), c("p_partkey").cast("string")
    return R.text_files(
        table(spark, d, "part"), F.concat(F.lit("p"), n, F.lit(".asm")),
        F.concat(F.lit("_T"), n, F.lit(" SEGMENT word ; code\n EXTRN x"), n, F.lit(":near\n PUBLIC a"), n, F.lit(", q"), n, F.lit("\na"), n, F.lit(" PROC near\n call near ptr g"), (k % 10).cast("string"), F.lit("\n int 21h\n mov ax, "), (k + 16).cast("string")),
        F.repeat(F.lit("\n nop"), c("p_size") % 5), F.concat(F.lit("\na"), n, F.lit(" ENDP\n")),
    )


@query("""SELECT 'p' || p_partkey || '.asm' AS path, 'a' || p_partkey AS name, 4 AS line, 'proc' AS style, CAST(3 + p_size % 5 AS INTEGER) AS body_lines, 'g' || (p_partkey % 10) AS calls,
array_to_string(list_sort(list_distinct([33, p_partkey + 16])), ',') AS constants, '33' AS interrupts FROM part UNION ALL SELECT 'p' || p_partkey || '.asm', 'q' || p_partkey, NULL, 'public-label', 0, '', '', '' FROM part""")
def asm_inventory(spark, d):
    got = S.source_inventory(_asm_sources(spark, d))
    joined = [F.array_join(F.transform(x, lambda v: v.cast("string")), ",").alias(x) for x in ("calls", "constants", "interrupts")]
    return got.select("path", "name", "line", "style", "body_lines", *joined)


@query("""SELECT 'p' || p_partkey || '.asm' AS path, unnest(['external', 'public', 'public', 'segment']) AS role, unnest(['x' || p_partkey, 'a' || p_partkey, 'q' || p_partkey, '_T' || p_partkey]) AS name FROM part""")
def asm_names(spark, d):
    return S.asm_names(_asm_sources(spark, d))


@query("""SELECT o_custkey || '.lst' AS path, CAST(o_orderkey AS INTEGER) AS source_line, repeat(printf('%04X', o_orderkey % 65536), CAST(1 + o_orderkey % 3 AS INTEGER)) AS hex FROM orders""")
def listing_bytes(spark, d):
    k = c("o_orderkey")
    row = lambda more: F.concat(F.format_string("%6d %08X %04X%s", k, k, k % 65536, more), F.lit("  db\n"))
    piece = F.concat(F.lit("; comment\n"), F.when(k % 3 == 0, row(F.lit(""))).otherwise(F.concat(row(F.lit("-")), F.repeat(row(F.lit("")), (k % 3).cast("int")))))
    g = table(spark, d, "orders").groupBy("o_custkey").agg(R.in_order([k], piece).alias("t"))
    return S.listing_bytes(R.text_files(g, F.concat(c("o_custkey").cast("string"), F.lit(".lst")), c("t")))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, 'tool' || p_partkey % 1000 AS program FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'prg' || p_size FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'menu' FROM part WHERE p_partkey % 3 = 0""")
def batch_programs(spark, d):
    k = c("p_partkey")
    return S.batch_programs(R.text_files(
        table(spark, d, "part"), k,
        F.concat(F.lit("@echo off\r\nprompt $p\r\nXCOPY\r\ncall TOOL"), (k % 1000).cast("string"), F.lit("\r\n")),
        F.when(k % 2 == 0, F.format_string("Prg%d.EXE /x\r\n", "p_size")).otherwise("if exist a goto b\r\n"),
        F.when(k % 3 == 0, "menu\r\nmenu\r\n").otherwise("sort\r\n"),
    ))
