"""Conversions, form functions, formulas, masks and ranges on small tables of cases."""

import pytest
from paperloom.functions import coerce, formcalc, text
from paperloom.plans.formula import FormulaError, compile_formula
from paperloom.plans.ranges import RangeError, select_pages
from pyspark.sql import functions as F


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(column).collect()]


def test_numbers_from_text(spark):
    cases = [("12abc", 12.0), (" -3.5e2x", -350.0), (".5", 0.5), ("abc", 0.0), ("", 0.0), (None, 0.0), ("1e", 1.0), ("+7.", 7.0)]
    assert values(spark, [(c,) for c, _ in cases], "v string", coerce.to_num(F.col("v"))) == [x for _, x in cases]


def test_number_text(spark):
    cases = [(1.5, "1.5"), (12.0, "12"), (-0.25, "-0.25"), (1e15, "1000000000000000"), (0.1 + 0.2, "0.3"), (float("inf"), "Infinity"), (float("nan"), "NaN")]
    assert values(spark, [(c,) for c, _ in cases], "v double", coerce.num_text(F.col("v"))) == [x for _, x in cases]


def test_typed_numbers(spark):
    cases = [("$1,234.56", 1234.56), ("1.234,56 €", 1234.56), ("(12)", -12.0), ("12,5", 12.5), ("1,234", 1234.0), ("", None), ("abc", None), ("50%", 50.0), (None, None)]
    assert values(spark, [(c,) for c, _ in cases], "v string", coerce.make_number(F.col("v"))) == [x for _, x in cases]


@pytest.mark.parametrize(
    ("op", "a", "b", "want"),
    [("==", None, "", 1), ("<>", None, "a", 1), ("<", None, "a", 0), ("==", "1.0", "1", 1), ("<", "10", "9", 0), ("<", "10", "9a", 1), (">=", "b", "a", 1), ("<=", "", None, 1)],
)
def test_compare(spark, op, a, b, want):
    assert values(spark, [(a, b)], "a string, b string", coerce.compare(op, F.col("a"), F.col("b"))) == [want]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("1 + 2 * 3", 7.0), ("(1 + 2) * 3", 9.0), ("-2 + 5", 3.0), ('"12" + 3', 15.0), ("null + 1", 1.0), ("null + null", None), ('Concat("a", 1.50, null, "b")', "a1.5b"),
        ("Round(2.675, 2)", 2.68), ("Round(-2.5)", -3.0), ("Mod(-7, 3)", -1.0), ('At("hello", "l")', 3.0), ('At("hello", "")', 0.0), ('Substr("hello", 0, 2)', "he"), ('Stuff("abcdef", 2, 3, "X")', "aXef"),
        ('Left("abc", -1)', ""), ("Str(3.14159, 8, 2)", "    3.14"), ("Str(123456, 3)", "***"), ("WordNum(1234)", "One Thousand Two Hundred Thirty-Four"),
        ("WordNum(21.05, 2)", "Twenty-One Dollars And 05 Cents"), ('Encode("a b&c~", "url")', "a%20b%26c~"), ('Decode("a%20b+c%zz", "url")', "a b+c%zz"), ('Encode("<a>", "html")', "&lt;a&gt;"),
        ('Date2Num("Jan 1, 1900")', 1.0), ('Date2Num("19960315", "YYYYMMDD")', 35138.0), ("Num2Date(1)", "Jan 1, 1900"), ('Num2Date(35138, "DD/MM/YYYY")', "15/03/1996"), ('IsoDate2Num("none")', 0.0),
        ('Format("$9,999.99", 1234.5)', "$1,234.50"), ('Parse("$9,999.99", "$1,234.50")', "1234.5"), ('UnitValue("1in", "mm")', 25.4), ('UnitType("3 pica")', "pc"), ("Sum(1, null, 3)", 4.0), ("Avg(null)", None), ("Count(1, null, 2)", 2.0),
        ("Choose(2, 4, 5, 6)", "5"), ("Choose(9, 4)", None), ("Oneof(3, 1, 3)", 1.0), ("Within(5, 1, 9)", 1.0), ('If(1 < 2, "yes", "no")', "yes"), ("Not 0 and 1", 1.0), ("NPV(0.1, 110, 121)", 200.0), ("Time2Num(\"01:00:00\")", 3600000.0), ("Num2Time(3600000)", "01:00:00"),
    ],
)
def test_formula(spark, source, want):
    got = spark.range(1).select(compile_formula(source, {})).first()[0]
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


@pytest.mark.parametrize("source", ["1 +", "nosuch(1)", "missing", "(1", "1 2", "a b", "x = = 2", "("*200])
def test_bad_formula(source):
    with pytest.raises(FormulaError):
        compile_formula(source, {})


def test_money(spark):
    row = spark.range(1).select(
        formcalc.fv(F.lit(100.0), F.lit(0.0), F.lit(12.0)), formcalc.pmt(F.lit(1200.0), F.lit(0.0), F.lit(12.0)), formcalc.apr(F.lit(35000.0), F.lit(269.5), F.lit(360.0)), formcalc.cterm(F.lit(0.01), F.lit(200.0), F.lit(100.0))
    ).first()
    assert row[0] == 1200 and row[1] == 100 and row[2] == pytest.approx(0.085, abs=1e-3) and row[3] == pytest.approx(69.66, abs=0.01)
    with pytest.raises(Exception, match="periods must be positive"):
        spark.range(1).select(formcalc.pmt(F.lit(1.0), F.lit(0.1), F.lit(0.0))).collect()


@pytest.mark.parametrize(
    ("kind", "sample", "want"),
    [
        ("email", "mail ada@example.com, or x.y+z@sub.örnek.com.tr!", ["ada@example.com", "x.y+z@sub.örnek.com.tr"]), ("email", "no@tld a@b.c", []),
        ("card", "card 4111 1111 1111 1111 and 4111 1111 1111 1112", ["4111 1111 1111 1111"]), ("ssn", "078-05-1120 000-12-3456 912-11-1111 1078-05-1120", ["078-05-1120"]),
        ("phone", "call +49 2151 123456 or (555) 123-4567 or 0211 123456", ["+49 2151 123456", "(555) 123-4567", "0211 123456"]), ("phone", "5551234567 and 01.10.2026 and 0.1234567", []),
        ("date", "on 5 January 2024, 2024-03-01 and Jan. 5, 2024; 1/2/99", ["5 January 2024", "2024-03-01", "Jan. 5, 2024", "1/2/99"]), ("date", "5/1-2024", []),
    ],
)
def test_personal_data(spark, kind, sample, want):
    assert values(spark, [(sample,)], "v string", text.PATTERNS[kind](F.col("v"))) == [want]


def test_find(spark):
    rows = [("The  the\nTHE then",), ("İSTANBUL ıI",), ("",), (None,)]
    assert values(spark, rows, "v string", text.find_count(F.col("v"), "the")) == [4, 0, 0, None]
    assert values(spark, rows, "v string", text.find_count(F.col("v"), "the", whole_words=True)) == [3, 0, 0, None]
    assert values(spark, rows, "v string", text.find_count(F.col("v"), "istanbul")) == [0, 1, 0, None]
    assert values(spark, rows, "v string", text.find_count(F.col("v"), " ")) == [0, 0, 0, 0]


def test_masks_and_labels(spark):
    assert values(spark, [("12345",), ("a",), (None,)], "v string", text.special_format("zip", F.col("v"))) == ["12345", "a", None]
    assert values(spark, [("A1-x",), ("11-x",)], "v string", text.mask_fits("A9-X", F.col("v"))) == [True, False]
    assert values(spark, [(1,), (4,), (1994,)], "v int", text.roman(F.col("v"))) == ["i", "iv", "mcmxciv"]
    assert values(spark, [(1,), (26,), (27,), (53,)], "v int", text.alpha(F.col("v"))) == ["a", "z", "aa", "aaa"]
    assert values(spark, [("=1+1",), (" -2",), ("x",)], "v string", text.csv_safe(F.col("v"))) == ["'=1+1", "' -2", "x"]
    assert values(spark, [(-1234.5,), (0.0,)], "v double", text.number_format(F.col("v"), 2, 2, 2, "€", False)) == ["(1.234,50€)", "0,00€"]


@pytest.mark.parametrize(
    ("count", "range_", "more", "want"),
    [
        (5, None, {}, [0, 1, 2, 3, 4]), (5, "2-3, 5", {}, [1, 2, 4]), (5, "4-", {}, [3, 4]), (5, "-2", {}, [0, 1]), (5, "5-3", {}, [4, 3, 2]), (5, "ii;1", {"labels": ["i", "ii"]}, [1, 0]),
        (5, "A-1", {"labels": ["x", "A-1"]}, [1]), (5, "1-5", {"subset": "even"}, [1, 3]), (5, "2-5", {"subset": "odd", "reverse": True}, [3, 1]),
    ],
)
def test_ranges(count, range_, more, want):
    assert select_pages(count, range_, **more) == want


@pytest.mark.parametrize("bad", ["6", "0", "x", "1-9", ","])
def test_bad_ranges(bad):
    with pytest.raises(RangeError):
        select_pages(5, bad)
