import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dealwright.functions import hashing, parsing, scoring


def test_whole_price(one):
    texts = ["$12,500", "Asking price $12,500.50", "POA", None, "", "$,"]
    assert one(parsing.whole_price, texts) == [12500, 12500, None, None, None, None]


def test_loose_int(one):
    texts = ["$12,500.90", "2,400", "abc", "-3.9", "1e3", "nan", "12d", None, "9" * 30]
    assert one(parsing.loose_int, texts) == [12500, 2400, None, -3, 1000, None, None, None, None]


def test_litres(one):
    assert one(parsing.litres_to_cc, ["2.4L", "1.8 l", "2400cc", None]) == [2400, 1800, None, None]


def test_flag(one):
    assert one(parsing.flag, ["Yes", "1", "no", "TRUE"]) == [True, True, False, True]


def test_fuel(one):
    assert one(parsing.fuel, ["gas", " EV ", "phev", "lpg", None]) == ["Petrol", "Electric", "Hybrid", "Petrol", "Petrol"]


def test_transmission(one):
    texts = ["5 speed manual", "MT", "cvt", None]
    assert one(parsing.transmission, texts) == ["Manual", "Manual", "Automatic", "Automatic"]


def test_engine_cc(one):
    assert one(parsing.engine_cc, ["2.5L", "2500cc", "2500", "2,400 cc", "x"]) == [2500, 2500, 2500, None, None]


def test_number_with_units(one):
    def engine(c):
        return parsing.number_with_units(c, [("l", 1000), ("cc", 1)])

    assert one(engine, ["1.2L", "1200cc", "1,200", "1,2l"]) == [1200, 1200, 1200, None]


def test_segment_part(one):
    def part(k):
        return lambda c: parsing.segment_part(c, "_data.json", k)

    assert one(part(0), ["Toyota_Rav4_x_data.json", "odd_data.json"]) == ["Toyota", "odd"]
    assert one(part(1), ["Toyota_Rav4_x_data.json", "odd_data.json"]) == ["Rav4_x", None]


def test_canonical_category(one):
    assert one(lambda c: parsing.canonical_category(c, True), [4.0, 4.5, None], "double") == ["4", "4.5", "nan"]


def test_blend_weight(one):
    weights = one(scoring.blend_weight, [49, 50, 51, 125, 199, 200, None], "int")
    assert [round(w, 5) for w in weights] == [0, 0, 0.00667, 0.5, 0.99333, 1, 0]


@pytest.mark.parametrize(
    "specific, general, n, expected",
    [(10000.0, 14000.0, 125, 12000.0), (None, 14000.0, 125, 14000.0), (10000.0, None, 10, 10000.0), (None, None, 1, None)],
)
def test_blended(spark, specific, general, n, expected):
    df = spark.createDataFrame([(specific, general, n)], "s double, g double, n int")
    assert df.select(scoring.blended(F.col("s"), F.col("g"), F.col("n"))).first()[0] == expected


@pytest.mark.parametrize(
    "estimate, q25, low, q75, high, expected",
    [
        (8000.0, 9000.0, 7000.0, 20000.0, None, (7500.0, "low")),
        (9000.0, 9000.0, 7000.0, 20000.0, None, (9000.0, None)),
        (8000.0, 9000.0, None, 20000.0, None, (8000.0, None)),
        (30000.0, 9000.0, None, 20000.0, 40000.0, (35000.0, "high")),
    ],
)
def test_tail(spark, estimate, q25, low, q75, high, expected):
    df = spark.createDataFrame([(estimate, q25, low, q75, high)], "e double, q25 double, lo double, q75 double, hi double")
    side = scoring.tail_side(F.col("e"), F.col("q25"), F.col("q75"), F.col("lo"), F.col("hi"))
    row = df.withColumn("side", side)
    value = scoring.tail_adjusted(F.col("e"), F.col("side"), F.col("lo"), F.col("hi"))
    assert tuple(row.select(value, "side").first()) == expected


def test_discount(spark):
    df = spark.createDataFrame([(10000.0, 9000), (20000.0, 11000), (0.0, 5)], "p double, a int")
    got = [r[0] for r in df.select(scoring.discount_pct(F.col("p"), F.col("a"))).collect()]
    assert got[0] == pytest.approx(10.0) and got[1] == pytest.approx(45.0) and got[2] is None


def test_bin_number(spark):
    df = spark.createDataFrame([(0.0, 0.0, 40.0), (40.0, 0.0, 40.0), (39.9, 0.0, 40.0), (7.0, 7.0, 7.0)], "v double, lo double, hi double")
    assert [r[0] for r in df.select(scoring.bin_number(F.col("v"), F.col("lo"), F.col("hi"), 40)).collect()] == [1, 40, 40, 1]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(1, 1e6), min_size=1, max_size=5), st.integers(0, 400))
def test_blend_stays_between(values, n):
    low, high = min(values), max(values)
    w = 0 if n < 50 else 1 if n >= 200 else (n - 50) / 150
    assert low - 1e-6 <= w * low + (1 - w) * high <= high + 1e-6


def test_digest_number_matches_python(one):
    import hashlib

    expected = int(hashlib.md5(b"42|abc").hexdigest()[:8], 16)
    assert one(lambda c: hashing.digest_number(hashing.seeded_digest(42, c)), ["abc"]) == [expected]


def test_sequence_ratio_example():
    assert round(difflib.SequenceMatcher(None, "toyota corola", "toyota corolla").ratio(), 3) == 0.963
