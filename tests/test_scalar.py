import datetime
import math

import pytest
from pyspark.sql import functions as F

from quarrybed.functions import scalar as X


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("x", "y"), [("__intsetup", "_intsetup"), ("_move", "move"), ("main_", "main"), ("x__", "x__"), ("plain", "plain"), ("", "")])
def test_undecorate(spark, x, y):
    assert one(spark, x, X.undecorate) == y


def test_addresses_and_words(spark):
    assert one(spark, "1000:0010", X.linear_address) == 0x10010
    assert one(spark, bytes([1, 2, 3]), lambda c: X.le16(c, 1), "binary") == 0x0302
    assert one(spark, bytes([1, 2, 3]), lambda c: X.le16(c, 2), "binary") is None
    assert one(spark, 0xFFFF, X.sign16, "int") == -1
    assert one(spark, b"A\x00\xffB", X.byte_array, "binary") == [65, 0, 255, 66]
    assert one(spark, b"", X.byte_array, "binary") == []
    assert one(spark, b"A\x00\xffB", X.printable_share, "binary") == 0.5 and one(spark, b"A\x00\xffB", X.zero_share, "binary") == 0.25
    assert one(spark, 0b11100100, X.unpack_2bpp, "int") == [3, 2, 1, 0]
    assert [one(spark, r, X.framebuffer_address, "int") for r in (0, 1, 2, 3)] == [0, 0x2000, 80, 0x2050]
    packed = one(spark, 5, lambda c: X.dos_date(F.lit(1990), c, F.lit(17)), "int")
    assert packed == (10 << 9) | (5 << 5) | 17 and one(spark, packed, X.dos_date_to_date, "int") == datetime.date(1990, 5, 17)


def test_similarities(spark):
    assert one(spark, 5, lambda c: X.size_similarity(c, F.lit(2)), "int") == 1.0
    assert one(spark, 30, lambda c: X.size_similarity(c, F.lit(2)), "int") == 0.0
    assert one(spark, 12, lambda c: X.size_similarity(c, F.lit(2)), "int") == pytest.approx(1 - math.log(6 / 2.5) / math.log(6))
    assert one(spark, 0, lambda c: X.ratio(c, F.lit(0)), "int") is None and one(spark, 0, lambda c: X.ratio(c, F.lit(3)), "int") == 0
    assert one(spark, 2, lambda c: X.mean_of_known(X.ratio(c, F.lit(4)), F.lit(None).cast("double")), "int") == 0.5
    assert one(spark, 0, lambda c: X.degree_agreement(c, F.lit(0)), "int") == 0.5
    none = F.lit(None).cast("double")
    # only unknown strings drop out of the weights: 1 + 0.6 + 0.35 + 0.35 + 1.2
    assert one(spark, 1.0, lambda c: X.pair_score(c, none, none, none, none, F.lit(0.0), 0.6), "double") == pytest.approx(1 / 3.5)
    assert one(spark, 1.0, lambda c: X.pair_score(c, F.lit(0.0), none, none, none, F.lit(1.0), 0.0), "double") == pytest.approx(2.2 / 5.4)


def test_text(spark):
    assert one(spark, "Ab-c Ü 9!", X.normalize_string) == "abcü9"
    assert one(spark, "x 0x1F 7 16 0x10 31 007", X.literals) == ["16", "31"]
    # digit runs are taken whole
    text = "12345678901234567890123 0xFFFFFFFFFFFFFFFF 0x1FFFFFFFFFFFFFFFFF 0000000000000000012 9007199254740993"
    assert one(spark, text, X.literals) == ["9007199254740993", "0x1fffffffffffffffff", str(2**64 - 1), "12345678901234567890123"]


def test_mask(spark):
    df = spark.createDataFrame([(bytes([1, 2, 3]), "101", bytes([9, 1, 7, 3]), 1), (bytes([1, 2, 3]), "111", bytes([9, 1, 7, 3]), 1), (bytes([1]), "1", bytes([1]), 1)], "d binary, m string, i binary, a int")
    assert [r.y for r in df.select(X.mask_matches(F.col("d"), F.col("m"), F.col("a"), F.col("i")).alias("y")).collect()] == [True, False, False]
