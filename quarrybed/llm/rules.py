"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit a rule.
A policy is a named, versioned mask over the rules: a document is kept if no bit of the mask is set, so new
policies and ablations (what one rule alone removes) are bitwise aggregations over the ledger, without
another look at a text.

Edge cases: null and empty texts have no words and fail min_words; very long texts are measured whole (sorts and
hash sets inside the row, no quadratic step); repeated rows each have their own ledger row; an empty table gives
an empty ledger; input columns named like an output are replaced by it, and keep_good returns rows as they were.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import restored, sheltered, without

#: What separates words, and the symbols that count.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_exclaim")


@dataclass(frozen=True)
class Rule:
    """fails is a SQL condition over the measurements."""

    name: str
    fails: str


#: Bit i of a ledger row is rule i. Append only: policies of earlier versions refer to these places.
RULES = (
    Rule("min_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 6 * n_lines"),
    Rule("mean_word_length", "word_chars < 2 * n_words or word_chars > 16 * n_words"),
    Rule("no_letters", "2 * n_letters < word_chars"),
    Rule("shouting", "10 * n_upper > 4 * n_letters"),
    Rule("exclamations", "10 * n_exclaim > 2 * n_words"),
)


def mask_of(*names: str, rules: tuple[Rule, ...] = RULES) -> int:
    places = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << places[n] for n in names)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    mask: int


BASE = Policy("base", 1, mask_of("min_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("web", 1, mask_of("min_words", "repeated_windows", "symbols", "duplicate_lines")),
    Policy("web", 2, mask_of(*(r.name for r in RULES))),
)


def _length_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _covered(ordered: Column) -> Column:
    """Places covered by the windows whose hash equals a neighbour's."""
    same = F.filter(
        ordered,
        lambda g, i: (F.get(ordered, i - 1)["h"] == g["h"]) | (F.get(ordered, i + 1)["h"] == g["h"]),
    )
    places = F.flatten(F.transform(same, lambda g: F.array(g["p"], g["p"] + 1, g["p"] + 2)))
    return F.size(F.array_distinct(places))


def _evaluated(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with the columns, each evaluated once: a filter on what is derived from them is not pushed below the
    generator, where it would repeat their expressions many times over."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_m")
    return rows.select("*", made).select(*rows.columns, *[F.col(f"_m.{n}").alias(n) for n in columns])


def ledger(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the measurements and fail_bits (bit i: rule i failed)."""
    docs = without(docs, *MEASURES, "fail_bits", "_words", "_lines", "_grams", "_m")
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, SPACE), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    count = lambda chars: (F.length(body) - _length_without(body, chars)).cast("bigint")
    out = _evaluated(docs, {"_words": words, "_lines": lines})
    out = _evaluated(out, {"_grams": _ordered_windows(F.col("_words"))})
    out = _evaluated(
        out,
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": _length_without(body, SPACE_CHARS).cast("bigint"),
            "n_symbols": count(SYMBOLS),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": F.when(F.size("_grams") == 0, F.lit(0)).otherwise(_covered(F.col("_grams"))).cast("bigint"),
            "n_letters": F.length(F.regexp_replace(body, r"\P{L}+", "")).cast("bigint"),
            "n_upper": F.length(F.regexp_replace(body, r"\P{Lu}+", "")).cast("bigint"),
            "n_exclaim": count("!"),
        },
    ).drop("_words", "_grams", "_lines")
    bits = None
    for i, r in enumerate(rules):
        bit = F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return out.withColumn("fail_bits", bits)


def _ordered_windows(words: Column) -> Column:
    n = F.size(words)
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))),
        lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("p")),
    )
    return F.when(n < 3, F.array().cast("array<struct<h:bigint,p:int>>")).otherwise(F.sort_array(grams))


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """base_failed and kept under the policy; the base rules always count."""
    failed = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0
    return rows.withColumn("base_failed", failed(BASE.mask)).withColumn("kept", ~failed(BASE.mask | policy.mask))


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule: documents that fail it, and those that only this rule removes.

    One pass: documents are counted by their bit pattern (2^rules rows at most), the rest reads those counts.
    """
    spark = rows.sparkSession
    counts = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame(
        [(p.name, p.version, p.mask, r.name, 1 << i) for p in policies for i, r in enumerate(rules) if p.mask >> i & 1],
        "policy string, version int, mask bigint, rule string, bit bigint",
    )
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (
        counts.join(F.broadcast(grid), hit.bitwiseAND(F.col("bit")) != 0, "right")
        .groupBy("policy", "version", "rule")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_failed"), F.coalesce(F.sum(F.when(hit == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"))
    )


def keep_good(docs: DataFrame, policy: Policy = POLICIES[-1], *, text: str = "text") -> DataFrame:
    """docs that the policy keeps, columns unchanged."""
    return restored(apply_policy(ledger(sheltered(docs, text=text)), policy).where("kept"))
