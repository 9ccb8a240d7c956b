"""Scalar expressions: names, addresses, similarity scores, packed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_string(s: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", "")


def undecorate(s: Column) -> Column:
    """Compiler decoration off: `__x` keeps one underscore, `_x` and `x_` lose it, `x__` stays."""
    lead2, lead1 = F.startswith(s, F.lit("__")), F.startswith(s, F.lit("_"))
    tail1 = F.endswith(s, F.lit("_")) & ~F.endswith(s, F.lit("__"))
    n = F.length(s)
    return F.when(lead2 | lead1, F.substring(s, F.lit(2), n)).when(tail1, F.substring(s, F.lit(1), n - 1)).otherwise(s)


def linear_address(a: Column) -> Column:
    """`seg:off` in hex to seg * 16 + off."""
    parts = F.split(a, ":")
    return F.conv(F.get(parts, F.lit(0)), 16, 10).cast("bigint") * 16 + F.conv(F.get(parts, F.lit(1)), 16, 10).cast("bigint")


def size_similarity(units: Column, lines: Column, low: float = 1.0, high: float = 6.0, centre: float = 2.5) -> Column:
    """1 at `centre` units a line, falling with the logarithm, 0 outside [low, high]."""
    ratio = units / lines
    return F.when((lines > 0) & ratio.between(low, high), 1 - F.abs(F.log(ratio / centre)) / F.log(F.lit(high))).otherwise(0.0)


def ratio(a: Column, b: Column) -> Column:
    """Smaller over larger; null if both are 0 or less, 0 if one is."""
    return F.when((a <= 0) & (b <= 0), None).when((a <= 0) | (b <= 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def mean_of_known(*scores: Column) -> Column:
    """The mean of the scores that are not null; null without any."""
    known = sum((F.when(s.isNotNull(), 1).otherwise(0) for s in scores), F.lit(0))
    total = sum((F.coalesce(s, F.lit(0.0)) for s in scores), F.lit(0.0))
    return F.when(known > 0, total / known)


def degree_agreement(a: Column, b: Column) -> Column:
    """1 minus the relative difference of two degrees; 0.5 if both are 0."""
    top = F.greatest(a, b)
    return F.when(top == 0, 0.5).otherwise(1 - F.abs(a - b) / top)


#: The weights of the parts of a pair's score.
PAIR_WEIGHTS = {"constants": 1.0, "strings": 2.5, "size": 0.35, "degree": 0.35, "shape": 1.2}


def pair_score(
    constants: Column, strings: Column, neighbours: Column, size: Column, degree: Column, shape: Column, neighbour_weight: Column | float, shape_weight: float = PAIR_WEIGHTS["shape"]
) -> Column:
    """Weighted mean of the parts. Strings (null unless both sides have some) weigh in only where they are known; every
    other part always does, as 0 where it is unknown."""
    w = PAIR_WEIGHTS | {"shape": shape_weight}
    nw = neighbour_weight if isinstance(neighbour_weight, Column) else F.lit(float(neighbour_weight))
    known = F.coalesce(constants, F.lit(0.0)) * w["constants"] + F.coalesce(neighbours, F.lit(0.0)) * nw
    for part, name in ((size, "size"), (degree, "degree"), (shape, "shape")):
        known = known + F.coalesce(part, F.lit(0.0)) * w[name]
    fixed = w["constants"] + w["size"] + w["degree"] + w["shape"]
    return (known + F.coalesce(strings, F.lit(0.0)) * w["strings"]) / (F.lit(fixed) + nw + F.when(strings.isNotNull(), w["strings"]).otherwise(0.0))


def printable_share(b: Column) -> Column:
    """Share of bytes in 0x20..0x7E."""
    return _share(b, r"[^\x20-\x7E]")


def zero_share(b: Column) -> Column:
    return _share(b, r"[^\x00]")


def byte_array(b: Column) -> Column:
    """The bytes of a binary column as integers 0..255."""
    pairs = F.regexp_extract_all(F.hex(b), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def _share(b: Column, others: str) -> Column:
    """Share of the bytes that are left once `others` (a character class) are taken out."""
    kept = F.length(F.regexp_replace(F.decode(b, "ISO-8859-1"), others, ""))
    return F.when(F.length(b) > 0, kept / F.length(b)).otherwise(0.0)


def le16(b: Column, at: int | Column) -> Column:
    """Unsigned little-endian 16-bit value at a byte offset; null past the end."""
    at = at if isinstance(at, Column) else F.lit(at)
    raw = F.hex(F.substr(b, at + 1, F.lit(2)))
    return F.when(F.length(raw) == 4, F.conv(F.concat(F.substr(raw, F.lit(3), F.lit(2)), F.substr(raw, F.lit(1), F.lit(2))), 16, 10).cast("int"))


def sign16(x: Column) -> Column:
    """A 16-bit value as signed."""
    v = x.cast("int").bitwiseAND(0xFFFF)
    return F.when(v >= 0x8000, v - 0x10000).otherwise(v)


def dos_date(year: Column, month: Column, day: Column) -> Column:
    return F.shiftleft(year - 1980, 9).bitwiseOR(F.shiftleft(month, 5)).bitwiseOR(day)


def dos_date_to_date(packed: Column) -> Column:
    return F.make_date(F.shiftright(packed, 9) + 1980, F.shiftright(packed, 5).bitwiseAND(15), packed.bitwiseAND(31))


def framebuffer_address(row: Column, stride: int = 80, bank: int = 0x2000) -> Column:
    """Byte address of a row in a framebuffer of two interleaved banks."""
    return row.bitwiseAND(1) * bank + F.shiftright(row, 1) * stride


def unpack_2bpp(byte: Column) -> Column:
    """Four 2-bit pixels of a byte, left to right."""
    return F.array(*[F.shiftright(byte, s).bitwiseAND(3) for s in (6, 4, 2, 0)])


def literals(text: Column, least: int = 16) -> Column:
    """Distinct integers of `least` or more in decimal or 0x notation, as decimal digits in order of value.

    Runs of digits are taken whole, however long. A hexadecimal run of more than 16 digits stays as 0x and its digits, and
    comes before the decimal ones of as many characters.
    """
    found = F.regexp_extract_all(text, F.lit(r"(0[xX][0-9A-Fa-f]+|[0-9]+)"), F.lit(1))
    bare = lambda x, lead: F.regexp_replace(F.lower(x), lead, "")
    hexed = lambda x: F.lower(F.substring(x, 1, 2)) == "0x"
    short = lambda h: F.conv(F.when(h == "", "0").otherwise(h), 16, 10)
    of_hex = lambda h: F.when(F.length(h) <= 16, short(h)).otherwise(F.concat(F.lit("0x"), h))
    value = lambda x: F.when(hexed(x), of_hex(bare(x, "^0x0*"))).otherwise(bare(x, "^0+(?=[0-9])"))
    large = lambda v: (F.length(v) > 9) | (v.try_cast("bigint") >= least)
    kept = F.array_distinct(F.filter(F.transform(found, value), large))
    keyed = F.array_sort(F.transform(kept, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))
    return F.transform(keyed, lambda s: s["v"])


def mask_matches(data: Column, mask: Column, at: Column, image: Column) -> Column:
    """Every byte of `data` whose mask character is '1' equals the image's byte at `at` and on."""
    n = F.length(mask)
    byte = lambda b, i: F.hex(F.substr(b, i, F.lit(1)))
    same = lambda i: (F.substr(mask, i + 1, F.lit(1)) == "0") | (byte(data, i + 1) == byte(image, at + i + 1))
    return (F.length(image) >= at + n) & F.forall(F.sequence(F.lit(0), n - 1), same)


def normalized_instruction(text: Column, target: Column, start: Column, end: Column, callee: Column, callee_offset: Column) -> Column:
    """A relative branch becomes `rel±n` inside its own span, else callee+offset; other text stays."""
    op = F.regexp_extract(text, r"^(\S+)", 1)
    delta = target - start
    inside = F.concat(op, F.lit(" rel"), F.when(delta < 0, F.lit("-")).otherwise(F.lit("+")), F.abs(delta).cast("string"))
    outside = F.concat(op, F.lit(" "), F.coalesce(callee, F.lit("?")), F.lit("+"), callee_offset.cast("string"))
    return F.when(target.isNull(), text).when((target >= start) & (target < end), inside).otherwise(outside)
