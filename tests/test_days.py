"""Dates in patterns and languages."""

import datetime

import pytest
from paperloom.functions import days
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()[0]


@pytest.mark.parametrize("lang", days.LANGUAGES)
def test_round_trip(spark, lang):
    said = days.names(spark, lang)
    df = spark.sql("select explode(sequence(date'1999-12-25', date'2001-01-05')) d")
    for pattern in ("dddd d mmmm yyyy", "mmmm yyyy/dd", "ddd, dd.mmm.yyyy", "m|d|yy", r"\yyyymmdd", "yyyy\\"):
        shown = df.select("d", days.format_day(F.col("d"), pattern, said).alias("s"))
        bad = shown.where(~F.col("d").eqNullSafe(days.parse_day(F.col("s"), pattern, said)))
        assert bad.count() == (0 if pattern != "yyyy\\" else df.count())


def test_names_and_cases(spark):
    day = F.lit(datetime.date(2024, 10, 8))
    say = lambda lang, pattern: one(spark, days.format_day(day, pattern, days.names(spark, lang)))
    assert say("en", "dddd, mmmm d") == "Tuesday, October 8" and say("de", "d. mmm yy") == "8. Okt 24"
    assert say("cs", "d. mmmm") == "8. října" and say("cs", "mmmm yyyy") == "říjen 2024"
    assert say("ru", "d mmmm") == "8 октября" and say("ru", "mmmm") == "октябрь"
    assert say("ja", r"yyyy\年mmmmd\日") == "2024年10月8日" and say("pt-br", "ddd") == "ter"
    with pytest.raises(ValueError):
        days.names(spark, "xx")


def test_reading_refuses(spark):
    said = days.names(spark, "en")
    read = lambda text, pattern: one(spark, days.parse_iso(F.lit(text), pattern, said))
    assert read(" 3/4/49 ", "m/d/yy") == "2049-03-04" and read("3/4/50", "m/d/yy") == "1950-03-04"
    assert [read(t, "mm/dd/yyyy") for t in ("1/02/2020", "13/01/2020", "01/32/2020", "01/02/2020x", "", None)] == [None] * 6
    assert read("02/31/2020", "mm/dd/yyyy") == "2020-02-31" and one(spark, days.parse_day(F.lit("02/31/2020"), "mm/dd/yyyy", said)) is None
    assert read("May 2020", "mmmm yyyy") is None


def test_patterns(spark):
    wrong = {"yyyy": None, "  ": "empty", None: "empty", "d" * 65: "too long", "t d": "time letter", r"\t d": None, "xx": "no date letter", "yyyyy": "no such code", "ddddd": "no such code", "yy yyyy": None, "\\": "no date letter"}
    for pattern, error in wrong.items():
        assert one(spark, days.pattern_error(F.lit(pattern).cast("string"))) == error, pattern


def test_iso(spark):
    show = lambda text, pattern: one(spark, days.iso_to_pattern(F.lit(text), pattern))
    assert show("2001-2-3", "mm/dd/yyyy") == "02/03/2001" and show("2001-02-03", "d.m.yy mmm") == "3.2.01 mmm" and show("soon", "mm") == "soon"
