"""Scripts with statements, field formats, names into trees, moved bookmarks."""

import pytest
from paperloom.functions.fields import NotationError, notation, parse_date, printf, printx, recognise
from paperloom.operators.trees import bookmark_move, som_pattern
from paperloom.plans.script import Script, ScriptError, run_script
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("1 + 2 * 3", 7.0), ("var x = 2\nx = x * 4\nx", 8.0), ("if (1 > 2) then\n1\nelseif (2 > 1) then\n2\nelse\n3\nendif", 2.0), ("var s = 0\nwhile (s < 10) do\ns = s + 3\nendwhile\ns", 12.0),
        ("var s = 0\nfor i = 5 downto 1 step 2 do\ns = s + i\nendfor\ns", 9.0), ('var s = ""\nforeach x in ("a", 1.50, null) do\ns = Concat(s, x)\nendfor\ns', "a1.5"), ("func f(a) do\nif (a <= 1) then\nreturn 1\nendif\nreturn a * f(a - 1)\nendfunc\nf(5)", 120.0),
        ("for i = 1 upto 9 do\nif (i == 3) then\nexit i\nendif\nendfor", 3.0), ("null + null", None), ('"12" + 3', 15.0), ("Sum(1, null, 3) ; note\n", 4.0), ("not 0 and 2 > 1", 1.0), ("", None),
    ],
)
def test_script(source, want):
    assert Script(source).run({}) == want


@pytest.mark.parametrize("source", ["while (1) do\n1\nendwhile", "1 / 0", 'throw "no"', "x", "nosuch(1)", "func f(a) do\nf(a)\nendfunc\nf(1)", "for i = 1 upto 2 step 0 do\nendfor"])
def test_failing_script(source):
    with pytest.raises(ScriptError):
        Script(source).run({})


@pytest.mark.parametrize("source", ["if (1) then", "1 2", "endif", "(", "a[0]"])
def test_broken_script(source):
    with pytest.raises(ScriptError):
        Script(source)


def test_scripts_on_rows(spark):
    df = spark.createDataFrame([(0, 2.0, "x"), (1, 0.0, "y"), (2, None, None)], "i int, n double, s string")
    got = df.orderBy("i").select(run_script("Concat(s, 10 / n)", n=F.col("n"), s=F.col("s")).alias("r")).collect()
    assert got[0].r.value == "x5" and got[1].r.value is None and got[1].r.error and got[2].r.error


@pytest.mark.parametrize(
    ("text", "picture", "want"),
    [
        ("3/15/96", "mm/dd/yy", "1996-03-15 00:00:00"), ("15 March 2020", "d mmm yyyy", "2020-03-15 00:00:00"), ("5Mar20", "d-mmm-yy", "2020-03-05 00:00:00"), ("2/30/2020", "m/d/yyyy", None), ("3:05 pm", "h:MM tt", "2000-01-01 15:05:00"),
        ("12:05 am", "h:MM tt", "2000-01-01 00:05:00"), ("", "m/d", None), ("1/2/3/4", "m/d/yy", None), ("1", "m/d", None), (None, "m/d", None),
    ],
)
def test_field_dates(spark, text, picture, want):
    got = spark.createDataFrame([(text,)], "v string").select(F.date_format(parse_date(F.col("v"), picture), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert got == want


@pytest.mark.parametrize(("picture", "value", "want"), [("%,0.2f!", 1234.5, "1,234.50!"), ("%08.1f", -3.14, "-00003.1"), ("%5d|%%", 7.9, "    7|%"), ("%x", 255.0, "FF"), ("% d", 3.0, " 3"), ("%,2.1f", 1234.5, "1.234,5")])
def test_printf(spark, picture, value, want):
    assert spark.createDataFrame([(value,)], "v double").select(printf(picture, F.col("v"))).first()[0] == want


def test_printx(spark):
    df = spark.createDataFrame([("a1b2c3 rest",), (None,)], "v string")
    assert [r[0] for r in df.select(printx(r">A-99\*=*", F.col("v"))).collect()] == ["A-12*c3 rest", None]


def test_notation(spark):
    df = spark.createDataFrame([("$1,000", "2", "")], "a string, `b c` string, d string")
    f = {"a": F.col("a"), "b c": F.col("`b c`"), "d": F.col("d")}
    assert [df.select(notation(s, f)).first()[0] for s in (r"a * b\ c - 1", "(a + 1) / d", "-a + missing")] == [1999.0, None, -1000.0]
    for bad in ("a +", "(a", "a a", ")"):
        with pytest.raises(NotationError):
            notation(bad, f)


def test_recognised_scripts():
    assert recognise('AFNumber_Format(2, 0, 0, 0, "$", true);') == ("AFNumber_Format", [2.0, 0.0, 0.0, 0.0, "$", True])
    assert recognise('AFSimple_Calculate("SUM", new Array ("a", "b.c"));') == ("AFSimple_Calculate", ["SUM", ["a", "b.c"]])
    assert recognise("app.alert(1)") is None


def test_som():
    import re

    hit = lambda e, p, here="": bool(re.match(som_pattern(e, here), p))
    assert hit("a.b", "a[0].b[0]") and not hit("a.b", "a[0].b[1]") and hit("a.b[*]", "a[0].b[7]") and hit("a..c", "a[0].b[2].c[0]") and hit("a.b[+1]", "a[0].b[3]", "a[0].b[2]") and not hit("a", "ab[0]")


def test_bookmark_move(spark):
    df = spark.createDataFrame([([1], "a"), ([1, 1], "a1"), ([2], "b"), ([2, 1], "b1"), ([3], "c")], "path array<int>, title string")
    got = {r.title: r.path for r in bookmark_move(df, [1], [3]).collect()}
    assert got == {"b": [1], "b1": [1, 1], "a": [2], "a1": [2, 1], "c": [3]}
    got = {r.title: r.path for r in bookmark_move(df, [3], [1, 1]).collect()}
    assert got == {"a": [1], "c": [1, 1], "a1": [1, 2], "b": [2], "b1": [2, 1]}
    with pytest.raises(ValueError, match="itself"):
        bookmark_move(df, [1], [1, 1])
