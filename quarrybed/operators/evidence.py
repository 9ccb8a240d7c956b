"""Evidence: dictionaries, corroboration, naming, rule-based triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables


def lookup(spark, values: dict, key: str, value: str) -> DataFrame:
    """A small dictionary as a table."""
    kind = "bigint" if all(isinstance(k, int) for k in values) else "string"
    return spark.createDataFrame(list(values.items()), f"{key} {kind}, {value} string")


def enriched(df: DataFrame, dictionary: DataFrame, code: str, text: str, fallback: Column, out: str = "label") -> DataFrame:
    """df with the dictionary's text and confidence high, or the fallback and medium."""
    d = dictionary.select(F.col(code).alias("_code"), F.col(text).alias("_text"))
    j = df.join(d, F.col(code) == F.col("_code"), "left")
    return j.select(*df.columns, F.coalesce("_text", fallback).alias(out), F.when(F.col("_text").isNotNull(), "high").otherwise("medium").alias("confidence"))


#: Corroboration of claims by kinds of evidence.
CORROBORATED_BONUS, CORROBORATED_TOP, SINGLE_TOP = 0.15, 0.9, 0.65


def corroborated(evidence: DataFrame, by: list[str], kind: str, score: str, order: str, fixed: str | None = None) -> DataFrame:
    """by, n_kinds, best_kind and confidence; of equal scores the first claim leads.

    Two kinds raise a confidence, one alone is kept low. Claims that are `fixed` (a header's entry point) keep their score
    where they lead: they need no second kind, and a weak one isn't raised by it.
    """
    sure = F.coalesce(F.col(fixed), F.lit(False)) if fixed else F.lit(False)
    best = F.max_by(F.struct(F.col(kind).alias("k"), F.col(score).alias("s"), sure.alias("f")), F.struct(F.col(score), (-F.col(order)).alias("o"))).alias("_b")
    g = evidence.groupBy(*by).agg(F.countDistinct(kind).alias("n_kinds"), best)
    s = F.col("_b.s")
    raised = F.when(F.col("n_kinds") >= 2, F.least(F.lit(CORROBORATED_TOP), s + CORROBORATED_BONUS)).otherwise(F.least(s, F.lit(SINGLE_TOP)))
    return g.select(*by, "n_kinds", F.col("_b.k").alias("best_kind"), F.bround(F.when(F.col("_b.f"), s).otherwise(raised), 6).alias("confidence"))


#: The kinds of evidence that may name a function, and the scores of what they say.
NAMING_KINDS = ("interrupt", "port", "entry", "constant")
CLAIM_SCORES = {"certain": 0.9, "high": 0.68, "medium": 0.5}
ENTRY_SCORES = {"certain": 0.95}
OTHER_ENTRY = 0.6


def machine_evidence(functions: DataFrame) -> DataFrame:
    """address, kind, confidence, claim and n (its place) for what functions (entry, interrupts, io_ports, scalars) do to the
    machine: known interrupts, ports and constants with their text, others by number."""
    spark = functions.sparkSession
    out = None
    sources = (
        ("interrupt", "interrupts", tables.INTERRUPTS, lambda c: F.format_string("uses INT %02Xh", c), None),
        ("port", "io_ports", tables.PORTS, lambda c: F.format_string("talks to port %03Xh", c), None),
        ("constant", "scalars", tables.CONSTANTS, None, "medium"),
    )
    for place, (kind, column, known, fallback, level) in enumerate(sources):
        rows = functions.select(F.col("entry").alias("address"), F.posexplode(F.col(column).cast("array<bigint>")).alias("_i", "code"))
        rows = rows.withColumn("n", F.lit(place) * (1 << 32) + F.col("_i")).drop("_i")
        d = lookup(spark, known, "code", "text")
        if fallback is None:
            found = rows.join(F.broadcast(d), "code").select("address", "n", F.col("text").alias("label"), F.lit(level).alias("confidence"))
        else:
            found = enriched(rows, F.broadcast(d), "code", "text", fallback(F.col("code"))).select("address", "n", "label", "confidence")
        found = found.select("address", F.lit(kind).alias("kind"), "confidence", F.col("label").alias("claim"), "n")
        out = found if out is None else out.unionByName(found)
    return out


def with_roles(findings: DataFrame, claim: str = "claim") -> DataFrame:
    """The findings whose claim gives a base name, with it."""
    roles = lookup(findings.sparkSession, tables.ROLES, "_claim", "base")
    return findings.join(F.broadcast(roles), F.col(claim) == F.col("_claim")).drop("_claim")


def proposed_names(findings: DataFrame) -> DataFrame:
    """address, name, score, n_kinds and corroborated from findings (address, kind, confidence, claim, n).

    Kinds are counted over all findings that may name; the claim of highest score with a base name gives it, the first of
    equals. Repeated names get _2, _3 ... in order of address.
    """
    f = findings.where(F.col("kind").isin(*NAMING_KINDS))
    kinds = f.groupBy(F.col("address").alias("_a")).agg(F.countDistinct("kind").alias("n_kinds"))
    pick = lambda scores, other: F.coalesce(*[F.when(F.col("confidence") == k, F.lit(v)) for k, v in scores.items()], F.lit(other))
    entry = F.col("kind") == "entry"
    named = with_roles(f).withColumn("s", F.when(entry, pick(ENTRY_SCORES, OTHER_ENTRY)).otherwise(pick(CLAIM_SCORES, None))).withColumn("f", entry)
    best = named.groupBy("address").agg(F.max_by(F.struct("base", "s", "f"), F.struct("s", (-F.col("n")).alias("o"))).alias("b")).join(kinds, F.col("address") == F.col("_a"))
    s = F.col("b.s")
    raised = F.when(F.col("n_kinds") >= 2, F.least(F.lit(CORROBORATED_TOP), s + CORROBORATED_BONUS)).otherwise(F.least(s, F.lit(SINGLE_TOP)))
    rows = best.select("address", F.col("b.base").alias("base"), F.bround(F.when(F.col("b.f"), s).otherwise(raised), 3).alias("score"), "n_kinds", (F.col("n_kinds") >= 2).alias("corroborated"))
    return suffixed(rows, "base", "address", "name").select("address", "name", "score", "n_kinds", "corroborated")


def summarised(evidence: DataFrame, by: str, kind: str, claim: str, rank: str, order: str) -> DataFrame:
    """by, best_rank, n_found, claims (distinct (kind, claim), as first seen) and place: best rank first, then the most
    found, then the one seen first."""
    once = evidence.groupBy(by, kind, claim).agg(F.min(rank).alias("_r"), F.min(order).alias("_o"), F.count(F.lit(1)).alias("_n"))
    claims = F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(kind).alias("kind"), F.col(claim).alias("claim")))), lambda x: F.struct(x["kind"].alias("kind"), x["claim"].alias("claim")))
    rows = once.groupBy(by).agg(F.min("_r").alias("best_rank"), F.sum("_n").alias("n_found"), F.min("_o").alias("_first"), claims.alias("claims"))
    # ranks are few: number within a rank by counts per (rank, n_found), so no task sorts all rows
    cells = rows.groupBy("best_rank", "n_found").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("best_rank", F.desc("n_found")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cells.select(F.col("best_rank").alias("_br"), F.col("n_found").alias("_nf"), before.alias("_s"))
    placed = rows.join(starts, (F.col("best_rank") == F.col("_br")) & (F.col("n_found") == F.col("_nf")))
    within = F.row_number().over(Window.partitionBy("best_rank", "n_found").orderBy("_first", by))
    return placed.withColumn("place", F.col("_s") + within).select(by, "best_rank", "n_found", "claims", "place")


def suffixed(df: DataFrame, base: str, order: str, out: str = "unique_name") -> DataFrame:
    """df with base, base_2, base_3 ... in order."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return df.withColumn(out, F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), n.cast("string"))))


def first_wins(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """key, value (of the first row) and n_values (distinct ones; over 1 is a collision)."""
    return df.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value), F.countDistinct(value).alias("n_values"))


def name_diff(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """name and status: common, only_in_a or only_in_b."""
    x, y = a.select(name).distinct().withColumn("_a", F.lit(1)), b.select(name).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, name, "full_outer")
    return j.select(name, F.when(F.col("_b").isNull(), "only_in_a").when(F.col("_a").isNull(), "only_in_b").otherwise("common").alias("status"))


def pick_one(candidates: DataFrame, by: str, name: str, size: str, named: str, expected: str) -> DataFrame:
    """by, picked and reason: the only named one, else the only one of the expected name, else the largest named, else the
    largest. Ties in size go to the smaller name."""
    w = Window.partitionBy(by)
    c = candidates.withColumn("_nn", F.count_if(F.col(named)).over(w)).withColumn("_ne", F.count_if(F.col(name) == F.col(expected)).over(w))
    reason = (
        F.when(F.col(named) & (F.col("_nn") == 1), 1).when((F.col(name) == F.col(expected)) & (F.col("_ne") == 1), 2).when(F.col(named), 3).otherwise(4)
    )
    ranked = c.withColumn("_p", reason).withColumn("_r", F.row_number().over(w.orderBy("_p", F.desc(size), name)))
    label = F.element_at(F.array(*[F.lit(x) for x in ("only named", "expected name", "largest named", "largest")]), F.col("_p"))
    return ranked.where("_r = 1").select(by, F.col(name).alias("picked"), label.alias("reason"))


def classify_prefix(value: Column, table: list[tuple[str, str]], default: str = "data") -> Column:
    """The label of the first prefix in the list that the value starts with."""
    out = None
    for prefix, label in table:
        test = F.startswith(value, F.lit(prefix))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def marker_positions(df: DataFrame, key: str, value: str, markers: list[str]) -> DataFrame:
    """key, marker, position (from 0) of the first occurrence of each marker found."""
    found = F.array(*[F.struct(F.lit(m).alias("marker"), (F.locate(m, F.col(value)) - 1).alias("position")) for m in markers])
    return df.select(key, F.inline(F.filter(found, lambda x: x["position"] >= 0)))


def density_class(hits: Column, length: Column, high: float = 2.0, medium: float = 0.5) -> Column:
    """Hits per KB of 1 KB or more: high, medium or low."""
    d = hits / F.greatest(F.lit(1.0), length / 1024)
    return F.when(d >= high, "high").when(d >= medium, "medium").otherwise("low")


def memory_model(relocations: Column, near: Column, kilobytes: Column) -> Column:
    """The memory model a program's relocations speak for; `near` of them lie beside the entry point. First rule that holds."""
    density = relocations / F.greatest(F.lit(1.0), kilobytes)
    return F.when(relocations == 0, "tiny or packed").when((relocations <= 8) & (near >= relocations - 1), "small").when(density < 0.5, "small or medium").otherwise("compact, large or huge")


#: What the ending of a file's name says of its kind.
ENDINGS = (
    ("com", ("com",)),
    ("batch", ("bat", "cmd")),
    ("overlay-or-data", ("ovl", "ovr", "ov1", "ov2", "dat")),
    ("doc", ("txt", "doc", "me", "1st", "nfo", "diz", "hlp")),
    ("archive", ("zip", "arj", "lzh", "arc", "rar", "7z", "gz")),
)


def kind_of_file(name: Column, content: Column) -> Column:
    """The kind of a file: by its header where it has one, where an overlay number tells a module from a program, else by
    the ending of its name."""
    low = F.regexp_extract(F.lower(name), r"\.([^./\\]+)$", 1)
    program = F.coalesce(F.substring(content, 1, 2).isin(F.lit(b"MZ"), F.lit(b"ZM")), F.lit(False))
    number = F.when(F.length(content) >= 28, F.hex(F.substring(content, 27, 2)) != "0000").otherwise(False)
    out = F.when(program & number, "overlay-module").when(program, "executable")
    for kind, endings in ENDINGS:
        out = out.when(low.isin(*endings), kind)
    return out.otherwise("data")


def kind_histogram(files: DataFrame, kind: str = "kind") -> DataFrame:
    """kind and n, the commonest first."""
    return files.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), kind)


def extension_rollup(df: DataFrame, key: str, size: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))


def engine_ratio(data: DataFrame, main_size: Column, size: str, notable: int = 16384, ratio: float = 4.0) -> DataFrame:
    """is_engine: two or more notable data files that together are `ratio` times the program or more."""
    big = F.col(size) >= notable
    return data.agg(F.count_if(big).alias("n_notable"), F.sum(F.when(big, F.col(size)).otherwise(0)).alias("bytes")).withColumn(
        "is_engine", (F.col("n_notable") >= 2) & (F.col("bytes") / F.greatest(F.lit(1), main_size) > ratio)
    )


#: Marks of packers and of interpreters in a program file.
PACKER_MARKS = ("LZ91", "LZ09", "PKLITE", "diet", "UPX!", "aPLib", "Packed file is corrupt")
ENGINE_MARKS = ("SCUMM", "scumm", "LFL", "RESOURCE.MAP", "RESOURCE.000", "VOL.0", "LOGDIR", "DAAD", "ZORK", "Inform")
OVERLAY_MARK = "FBOV"


def mark_level(position: Column, entry: Column, relocations: Column, density: Column, near: int = 0x400) -> Column:
    """A packer's mark blocks beside the entry point, or in a program stripped of relocations and frames; else it warns."""
    beside = F.abs(position - entry) < near
    stripped = (relocations <= 2) | (density < 0.2)
    return F.when(position.isNull() | (position < 0), None).when(beside | stripped, "blocker").otherwise("warn")


def triage_findings(programs: DataFrame) -> DataFrame:
    """path, level and code of what speaks about a program's fitness for analysis.

    programs: path, name, is_program, content, entry (file offset), relocations, near_relocations, image_bytes, trailing,
    overlay_number, density (frame set-ups a KB), largest_sibling (bytes of the largest other data file).
    """
    c = F.col
    at = lambda mark: F.instr(F.decode("content", "ISO-8859-1"), F.lit(mark)) - 1
    finding = lambda level, code: F.struct((F.lit(level) if isinstance(level, str) else level).alias("level"), F.lit(code).alias("code"))
    program, com = F.coalesce(c("is_program"), F.lit(False)), F.lower("name").endswith(".com")
    model = memory_model(c("relocations"), c("near_relocations"), c("image_bytes") / 1024)
    rules = [F.when(~program & com, finding("route", "raw image")), F.when(~program & ~com, finding("blocker", "not an executable"))]
    own = [F.when(F.substr("content", c("entry").cast("int") - 1, F.lit(2)) == F.lit(b"RB"), finding("blocker", "packed: EXEPACK"))]
    for mark in PACKER_MARKS:
        level = mark_level(at(mark), c("entry"), c("relocations"), c("density"))
        own.append(F.when(level.isNotNull(), finding(level, f"packed: {mark}")))
    overlaid = (at(OVERLAY_MARK) >= 0) | (c("overlay_number") != 0)
    engine = F.lit(False)
    for mark in ENGINE_MARKS:
        engine = engine | (at(mark) >= 0)
    own += [
        F.when(overlaid, finding("blocker", "overlaid")).when(c("trailing") > 1024, finding("warn", "trailing data")),
        F.struct(F.when(model == "small", "info").otherwise("warn").alias("level"), F.concat(F.lit("model: "), model).alias("code")),
        F.when(model.isin("small or medium", "compact, large or huge"), finding("warn", "far data")),
        F.when(c("density") >= 2, finding("info", "compiled")).when(c("density") >= 0.5, finding("warn", "mixed frames")).otherwise(finding("warn", "few frames")),
        F.when(engine, finding("blocker", "interpreter")).when(c("largest_sibling") > 4 * F.greatest(F.lit(1), c("image_bytes")), finding("warn", "large data beside")),
    ]
    both = F.array_compact(F.concat(F.array(*rules), F.when(program, F.array(*own)).otherwise(F.array().cast("array<struct<level:string,code:string>>"))))
    return programs.select("path", F.inline(both))


def triage_verdict(findings: DataFrame, by: str = "path") -> DataFrame:
    """by, in_scope (no blocker), confidence (low where data is far or frames are few) and the number of findings."""
    low = F.bool_or(F.col("code").isin("far data", "few frames"))
    return findings.groupBy(by).agg((~F.bool_or(F.col("level") == "blocker")).alias("in_scope"), F.when(low, "low").otherwise("high").alias("confidence"), F.count(F.lit(1)).alias("n_findings"))


def written_names(mapping: DataFrame, functions: DataFrame, floor: float = 0.45, certain: float = 0.70, long: int = 200) -> DataFrame:
    """entry, applied (the name, with __maybe where it is not certain), status and long_routine for each mapped function.

    mapping: source, binary, score; functions: entry, size. Status is applied, refused (score under the floor) or missing (no
    such function).
    """
    f = functions.select("entry", "size").withColumn("_there", F.lit(True))
    j = mapping.join(f, F.col("binary") == F.col("entry"), "left")
    flags = name_flags(F.col("score"), F.col("size"), floor, certain, long)
    status = F.when(F.col("score") < floor, "refused").when(F.col("_there").isNull(), "missing").otherwise("applied")
    rows = j.select(F.col("binary").alias("entry"), "source", status.alias("status"), flags.alias("f"))
    done = F.col("status") == "applied"
    return rows.select("entry", F.when(done, F.concat("source", "f.suffix")).alias("applied"), "status", (done & F.coalesce("f.long_routine", F.lit(False))).alias("long_routine"))


def name_flags(score: Column, size: Column, floor: float = 0.45, certain: float = 0.70, long: int = 200) -> Column:
    """What a proposed name carries: refused, `__maybe` between floor and certain, and a warning for long routines."""
    suffix = F.when(score < floor, "refused").when(score < certain, "__maybe").otherwise("")
    return F.struct(suffix.alias("suffix"), ((size >= long) & (score >= floor)).alias("long_routine"))


def all_cases_agree(cases: DataFrame, by: list[str], agrees: Column) -> DataFrame:
    """by, n_cases and agrees: every case of the battery does."""
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cases"), F.bool_and(agrees).alias("agrees"))


def clashes(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value: an assertion that should return no row."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n")).where("n > 1")
