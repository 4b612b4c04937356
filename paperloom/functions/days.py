"""Days written in patterns of y, m and d, with names in seventeen languages, and read back."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.coerce import let

#: Languages of month and day names (fixed values), longest pattern (fixed value), first year of two digits that is of the last century.
LANGUAGES = ("en", "ja", "zh-hans", "zh-hant", "cs", "pt-br", "de", "es", "fr", "ru", "bg", "te", "hu", "uk", "it", "ar", "pl")
LONGEST, CENTURY = 64, 50


@dataclass(frozen=True)
class Names:
    """Months from January, as they stand alone, behind a day, and short; days from Sunday, in full and short."""

    months: tuple[str, ...]
    months_with_day: tuple[str, ...]
    months_short: tuple[str, ...]
    days: tuple[str, ...]
    days_short: tuple[str, ...]


def names(spark: SparkSession, language: str) -> Names:
    """The platform's names in a language, short ones without a period."""
    if language not in LANGUAGES:
        raise ValueError(f"unknown date language {language!r} (one of {', '.join(LANGUAGES)})")
    java = spark._jvm.java
    locale, style = java.util.Locale.forLanguageTag(language), java.time.format.TextStyle

    def all_of(kind, order, s) -> tuple[str, ...]:
        return tuple(kind.of(i).getDisplayName(s, locale).rstrip(".") for i in order)

    months, days = java.time.Month, java.time.DayOfWeek
    year, week = range(1, 13), (7, 1, 2, 3, 4, 5, 6)
    return Names(all_of(months, year, style.FULL_STANDALONE), all_of(months, year, style.FULL), all_of(months, year, style.SHORT_STANDALONE), all_of(days, week, style.FULL_STANDALONE), all_of(days, week, style.SHORT_STANDALONE))


def _runs(pattern: str) -> list[str]:
    """Codes and literals in order; a literal starts with a backslash."""
    return [m[0] if m[0][0] in "ymd" else "\\" + m[0].removeprefix("\\") if m[0] != "\\" else "\\\\" for m in re.finditer(r"y+|m+|d+|\\.|.", pattern, re.DOTALL)]


def pattern_error(pattern: Column) -> Column:
    """Why a date pattern cannot be used, or null: empty, too long, time letters that are not escaped, no date letter, or a code that does not exist."""
    trimmed = F.regexp_replace(pattern, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    plain = F.regexp_replace(trimmed, r"(?s)\\.", "\u0001")
    odd = r"(?<!y)(?:y|yyy|y{5,})(?!y)|m{5,}|d{5,}"
    return (
        F.when(F.coalesce(trimmed, F.lit("")) == "", "empty")
        .when(F.length(trimmed) > LONGEST, "too long")
        .when(plain.rlike("[HhMst]"), "time letter")
        .when(~plain.rlike("[ymd]"), "no date letter")
        .when(plain.rlike(odd), "no such code")
    )


def format_day(day: Column, pattern: str, said: Names) -> Column:
    """A date in a pattern; a month's name takes the form it has behind a day where the pattern shows the day's number."""
    runs = _runs(pattern)
    with_day = any(r in ("d", "dd") for r in runs)
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), n)
    number = lambda c, width: F.lpad(c.cast("string"), width, "0")
    year, month, date, week = F.year(day), F.month(day), F.dayofmonth(day), F.dayofweek(day)
    parts = []
    for r in runs:
        kind, n = r[0], len(r)
        if kind == "\\":
            parts.append(F.lit(r[1:]))
        elif kind == "y":
            parts.append(number(year, 4) if n >= 4 else number(year % 100, 2))
        elif n <= 2:
            parts.append(number(month if kind == "m" else date, 2) if n == 2 else (month if kind == "m" else date).cast("string"))
        elif kind == "m":
            parts.append(pick(said.months_short if n == 3 else said.months_with_day if with_day else said.months, month))
        else:
            parts.append(pick(said.days_short if n == 3 else said.days, week))
    return F.concat(*parts)


def parse_iso(text: Column, pattern: str, said: Names) -> Column:
    """yyyy-mm-dd of a text in a pattern, null if it does not fit or lacks a part; the longest name that fits is meant."""
    runs, regex, at = _runs(pattern), "", {}
    with_day = any(r in ("d", "dd") for r in runs)
    longest = lambda values: "|".join(f"\\Q{v}\\E" for v in sorted(set(values), key=len, reverse=True))
    for r in runs:
        kind, n = r[0], len(r)
        if kind == "\\":
            regex += f"\\Q{r[1:]}\\E"
        elif kind == "d" and n > 2:
            regex += f"(?:{longest(said.days_short if n == 3 else said.days)})"
        else:
            values = (said.months_short if n == 3 else said.months_with_day if with_day else said.months) if kind == "m" and n > 2 else None
            regex += f"({longest(values)})" if values else r"(\d{4})" if kind == "y" and n >= 4 else r"(\d{2})" if n == 2 else r"(\d{1,2})"
            at[kind] = (len(at) + 1, n, values)
    if set(at) != {"y", "m", "d"}:
        return F.lit(None).cast("string")

    def read(seen: Column) -> Column:
        fits = seen.rlike(f"^(?:{regex})$")
        part = lambda kind: F.regexp_extract(seen, f"^(?:{regex})$", at[kind][0])
        year = part("y").try_cast("int")
        if at["y"][1] < 4:
            year = let(year, lambda y: F.when(y < CENTURY, y + 2000).otherwise(y + 1900))
        values = at["m"][2]
        month = F.array_position(F.array(*map(F.lit, values)), part("m")).cast("int") if values else part("m").try_cast("int")
        parts = F.struct(month.alias("month"), part("d").try_cast("int").alias("date"))
        shown = let(parts, lambda p: F.when(p["month"].between(1, 12) & p["date"].between(1, 31), F.format_string("%04d-%02d-%02d", year, p["month"], p["date"])))
        return F.when(fits, shown)

    return let(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), read)


def parse_day(text: Column, pattern: str, said: Names) -> Column:
    """The date of a text in a pattern; null if there is no such day."""
    return F.try_to_date(parse_iso(text, pattern, said), "yyyy-MM-dd")


def iso_to_pattern(iso: Column, pattern: str) -> Column:
    """A text yyyy-mm-dd shown by the numbers of a pattern; other texts stay as they are."""
    shape = r"^\s*(\d+)-(\d+)-(\d+)\s*$"
    part = lambda i: F.regexp_extract(iso, shape, i).try_cast("int")
    number = {"yyyy": lambda: F.format_string("%04d", part(1)), "yy": lambda: F.format_string("%02d", part(1) % 100), "mm": lambda: F.format_string("%02d", part(2)), "m": lambda: part(2).cast("string"), "dd": lambda: F.format_string("%02d", part(3)), "d": lambda: part(3).cast("string")}
    shown = [number[r]() if r in number else F.lit(r[1:] if r[0] == "\\" else r) for r in _runs(pattern)]
    return F.when(iso.rlike(shape), F.concat(*shown)).otherwise(iso)
