import math

import pytest
from pyspark.sql import functions as F

from selenite.functions import numeric, text


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize("value,want", [("  a \t b  c ", "a b c"), ("", ""), (None, None)])
def test_clean(spark, value, want):
    assert one(spark, value, text.clean) == want


@pytest.mark.parametrize("value,want", [("12.5", 12.5), (" 1e3 ", 1000.0), ("1d", None), ("1_0", None), ("inf", None), ("nan", None), ("", None), (None, None), ("-.5", -0.5)])
def test_number(spark, value, want):
    assert one(spark, value, text.number) == want


def test_strict_number(spark):
    assert one(spark, "3", lambda c: text.strict_number(c, F.lit("row 1"))) == 3.0
    with pytest.raises(Exception, match="not a finite number: x in row 1"):
        one(spark, "x", lambda c: text.strict_number(c, F.lit("row 1")))


@pytest.mark.parametrize("value,a,b,c", [("yes", True, True, False), ("", False, False, False), ("No ", False, False, True), ("maybe", True, False, False), (None, False, False, False)])
def test_truth(spark, value, a, b, c):
    assert (one(spark, value, text.not_false), one(spark, value, text.is_true), one(spark, value, text.says_no)) == (a, b, c)


@pytest.mark.parametrize(
    "name,want",
    [
        ("10084", ("known", "10084", "10084", False)), ("79221 bulk 125-250 um", ("known", "79221", "79221", True)), ("15531.22 <150 um", ("known", "15531", "15531,22", True)),
        ("10,003,173", ("known", "10003", "10003,173", True)), ("Luna 24, 24160", ("outside", None, None, False)), ("14003,96", ("known", "14003", "14003,96", True)), ("14003,96 Respirable", ("known", "14003", "14003,96", True)), ("10 , 003 , A-1", ("known", "10003", "10003,A-1", True)), ("11500", ("unparsed", None, None, False)), ("13001", ("unparsed", None, None, False)), ("24160", ("unparsed", None, None, False)), ("Lunokhod 15041", ("outside", None, None, False)), ("glass", ("unparsed", None, None, False)), (None, ("unparsed", None, None, False)),
    ],
)
def test_sample_reference(spark, name, want):
    assert tuple(one(spark, name, text.sample_reference)) == want


def test_small_text_functions(spark):
    assert one(spark, "123.0", text.canonical_id) == "123" and one(spark, "15,041 and 15041 and 10072A", text.catalogue_ids) == ["15041", "10072A"]
    assert tuple(one(spark, "<0.5", text.qualified)) == ("<", 0.5) and tuple(one(spark, "7", text.qualified)) == (None, 7.0)
    assert one(spark, "76535", text.mission_of) == "Apollo 17" and one(spark, "11500", text.mission_of) is None
    assert one(spark, "technique: (c) XRF, (d) semi micro XRF, (e) INAA", text.legend_codes) == {"c": "XRF", "d": "semi micro XRF", "e": "INAA"}
    assert one(spark, "see Notes. Method: ( A ) wet, in two steps; , (b) probe (a) 2., (a) titration", text.legend_codes) == {"a": "titration", "b": "probe (a) 2"}
    assert tuple(one(spark, "FeO 11.08", lambda c: text.matched_once(c, r"FeO ([0-9.]+)"))) == ("11.08", "found")
    assert one(spark, "in 1970 sample 10084 had index = 48 and 250", lambda c: text.numbers_near(c, "index")) == ["48"]
    assert one(spark, ["a", "A", "b", " "], text.distinct_folded, "array<string>") == ["a", "b"]
    keys = spark.createDataFrame([("12b",), ("",), ("x",), ("2",)], "c string").orderBy(text.child_key(F.col("c"))).collect()
    assert [r.c for r in keys] == ["", "2", "12b", "x"]
    assert one(spark, "http://h/a%20b/x.pdf?q", lambda c: text.document_id(c, F.lit("pdf"))).startswith("x__pdf__")


def test_numeric(spark):
    f = spark.createDataFrame([(0.2, 1.0)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    got = f.select(numeric.principal_angle(x, y, 0.08, 1.19).alias("p"), numeric.full_angle(x, y, 0.08, 1.19).alias("q"), numeric.principal_angle(x, y, 0.2, 1.19).alias("r"), numeric.safe_ratio(x, x - x).alias("z")).first()
    assert got.p == pytest.approx(-math.atan(-0.19 / 0.12)) and got.q == pytest.approx((-math.atan2(-0.19, 0.12)) % (2 * math.pi))
    assert got.r == pytest.approx(math.pi / 2) and got.z is None
    assert one(spark, 1.5, lambda c: numeric.to_nanometres(c, F.lit(" UM ")), "double") == 1500.0
    with pytest.raises(Exception, match="unknown unit"):
        one(spark, 1.5, lambda c: numeric.to_nanometres(c, F.lit("inch")), "double")
    c = one(spark, 1.0, lambda c: numeric.consensus([c, c + 1, c + 5, F.lit(None)]), "double")
    assert (c.mean, c.median, c.least, c.most) == (3.0, 2.0, 1.0, 6.0) and c.sd == pytest.approx(math.sqrt(7))
    cover = lambda a, b: one(spark, a, lambda c: numeric.suitability(c, F.lit(b), 461, 2497), "double")
    assert [cover(400.0, 2600.0), cover(1300.0, 2000.0), cover(500.0, 2000.0), cover(500.0, 2600.0), cover(400.0, 2000.0), cover(None, 1.0)] == ["full", "long_only", "partial_both", "starts_late", "ends_early", "missing"]
    assert one(spark, 1.0, lambda c: numeric.flag_mask(invalid=c > 0, negative=c < 0, excessive=c > 0, distance=F.lit(None).cast("boolean")), "double") == 33


def test_numbers_near_every_hit(spark):
    words = "index " + "x" * 250 + " index " + "y" * 200
    got = spark.createDataFrame([(words + " 48 " + "z" * 200 + " 77",), ("nothing 48",), (None,)], "t string").select(text.numbers_near(F.col("t"), "index").alias("n")).collect()
    assert [r.n for r in got] == [["48"], [], None]


@pytest.mark.parametrize("value", [0.0, 1.0, -1.5, 123456.0, 1234567.0, 1e-4, 1.25e-5, 1e16, 1e-300, 100.0, 0.1, 123.456, -0.00012345678, 1e100, 99999.96])
@pytest.mark.parametrize("digits", [3, 6, 10, 17])
def test_general_format(spark, value, digits):
    if digits == 17 and value not in (0.0, 1.0, 100.0, -1.5):
        return  # Java has no more digits than the shortest form
    assert one(spark, value, lambda c: numeric.general_format(c, digits), "double") == f"{value:.{digits}g}"


def test_location_decides_the_scope(spark):
    got = spark.createDataFrame([("15041", "Luna 24"), ("15041", "Apollo 15"), ("15041", None)], "n string, w string").select(text.sample_reference(F.col("n"), F.col("w")).alias("s")).collect()
    assert [r.s.scope for r in got] == ["outside", "known", "known"]
