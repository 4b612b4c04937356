"""Field dates and times, print formats, calculation notation and recognised field scripts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.coerce import let, make_number, num_text, strip
from paperloom.functions.formcalc import MONTHS

# The numbered date and time presets, and the days' names.
DATE_PRESETS = ["m/d", "m/d/yy", "mm/dd/yy", "mm/yy", "d-mmm", "d-mmm-yy", "dd-mmm-yy", "yy-mm-dd", "mmm-yy", "mmmm-yy", "mmm d, yyyy", "mmmm d, yyyy", "m/d/yy h:MM tt", "m/d/yy HH:MM"]
TIME_PRESETS = ["HH:MM", "h:MM tt", "HH:MM:ss", "h:MM:ss tt"]
DAYS = "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()
NUMBERED_PRINTS = {0: "D:yyyymmddHHMMss", 1: "yyyy.mm.dd HH:MM:ss", 2: "m/d/yy h:MM:ss tt"}


def _runs(picture: str) -> list[str]:
    return [m[0] for m in re.finditer(r"(.)\1*", picture, re.S)]


def parse_date(text: Column, picture: str) -> Column:
    """An instant from typed text: its numbers in the picture's order, whatever stands between; a month may be named; am and pm count.

    Null for blank text, numbers too many or missing, and days that do not exist.  Two-digit years turn at 50, a missing year is 2000.
    """
    months = F.array(*(F.lit(m.lower()) for m in MONTHS))
    kinds = list(dict.fromkeys(r[0].replace("h", "H") for r in _runs(picture) if r[0] in "ymdHhMs"))

    def parts(t: Column) -> Column:
        names = F.filter(F.regexp_extract_all(t, F.lit(r"\p{L}{3,}"), F.lit(0)), lambda w: F.exists(months, lambda m: F.startswith(m, w)))
        month = let(F.get(names, F.lit(0)), lambda named: F.when(named.isNotNull(), F.array_position(F.transform(months, lambda m: F.startswith(m, named)), True).cast("int")))
        return F.struct(F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)).alias("numbers"), month.alias("month"), t.alias("t"))

    def read(p: Column) -> Column:
        numbers, month, t = p["numbers"], p["month"], p["t"]
        at, found, needed = F.lit(0), {}, F.lit(True)
        for k in kinds:
            value = F.get(numbers, at).try_cast("int")
            if k == "m":
                found[k] = F.coalesce(month, value)
                at = at + F.when(month.isNotNull(), 0).otherwise(1)
            else:
                found[k] = value
                at = at + 1
            if k in "ymd":
                needed &= found[k].isNotNull()
        year = let(found.get("y", F.lit(2000)), lambda y: F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y))
        pm, am = t.contains("pm") | t.endswith("p"), t.contains("am")
        hour = let(F.coalesce(found.get("H", F.lit(0)), F.lit(0)), lambda h: F.when(pm & (h < 12), h + 12).when(am & (h == 12), 0).otherwise(h))
        shown = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, found.get("m", F.lit(1)), found.get("d", F.lit(1)), hour, F.coalesce(found.get("M", F.lit(0)), F.lit(0)), F.coalesce(found.get("s", F.lit(0)), F.lit(0)))
        return F.when((t != "") & needed & (F.size(numbers) <= at), F.try_to_timestamp(shown, F.lit("yyyy-MM-dd HH:mm:ss")))

    return let(F.lower(strip(text)), lambda t: let(parts(t), read))


def format_date(ts: Column, picture: str) -> Column:
    """An instant by y, m, d, H, h, M, s and t runs; a backslash takes the next character as it is."""
    return let(ts, lambda at: _shown(at, picture))


def _shown(ts: Column, picture: str) -> Column:
    parts, i = [], 0
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    by_size = lambda c, n: two(c) if n == 2 else c.cast("string")
    h12 = F.when(F.hour(ts) % 12 == 0, 12).otherwise(F.hour(ts) % 12)
    while i < len(picture):
        c = picture[i]
        if c == "\\" and i + 1 < len(picture):
            parts.append(F.lit(picture[i + 1]))
            i += 2
            continue
        n = len(re.match(re.escape(c) + "+", picture[i:])[0])
        i += n
        month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(ts))
        day = F.element_at(F.array(*map(F.lit, DAYS)), F.dayofweek(ts))
        if c == "y":
            parts.append(F.lpad(F.year(ts).cast("string"), 4, "0") if n >= 4 else two(F.year(ts) % 100))
        elif c == "m":
            parts.append(month if n >= 4 else F.left(month, F.lit(3)) if n == 3 else by_size(F.month(ts), n))
        elif c == "d":
            parts.append(day if n >= 4 else F.left(day, F.lit(3)) if n == 3 else by_size(F.day(ts), n))
        elif c in "HhMs":
            parts.append(by_size({"H": F.hour(ts), "h": h12, "M": F.minute(ts), "s": F.second(ts)}[c], n))
        elif c == "t":
            half = F.when(F.hour(ts) < 12, "am").otherwise("pm")
            parts.append(half if n >= 2 else F.left(half, F.lit(1)))
        else:
            parts.append(F.lit(c * n))
    return F.concat(*parts) if parts else F.lit("")


def reformat_date(text: Column, picture: str) -> Column:
    """What a date field shows for typed text, the text itself where it is no date."""
    return F.coalesce(format_date(parse_date(text, picture), picture), text)


def keystroke(text: Column, kind: str, picture: str = "", field: str = "") -> Column:
    """struct(value, error): the value a field keeps, or why not; blank is always kept as empty."""
    number = let(make_number(text), lambda n: F.when(n.isNotNull(), num_text(n)))
    kept = {"number": number, "percent": number, "date": F.when(parse_date(text, picture).isNotNull(), strip(text))}.get(kind, text)
    blank = F.coalesce(strip(text) == "", F.lit(True))
    unfit = F.lit(f"the value does not fit the format of {field or 'the field'}")
    return let(F.when(blank, "").otherwise(kept), lambda value: F.struct(value.alias("value"), F.when(value.isNull(), unfit).alias("error")))


_PRINT = re.compile(r"%%|%(?:,(\d))?([+ 0#]*)(\d*)(?:\.(\d+))?([a-zA-Z])")


def printf(picture: str, *args: Column) -> Column:
    """%[,separators][flags][width][.places] of d, f, s and x; separators as of number formats, without thousands by default."""
    parts, at, used = [], 0, 0
    for m in _PRINT.finditer(picture):
        parts.append(F.lit(picture[at : m.start()]))
        at = m.end()
        if m[0] == "%%":
            parts.append(F.lit("%"))
            continue
        separators, flags, width, places, kind = int(m[1] or 1), m[2], int(m[3] or 0), m[4], m[5]
        if max(width, int(places or 0)) > 1000:
            raise ValueError("a width or precision is too large")
        arg = args[used] if used < len(args) else F.lit("")
        used += 1
        if kind in "df":
            n = arg.cast("double")
            n = n if kind == "f" else F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("double")
            digits = F.format_number(F.abs(n), int(places or 6) if kind == "f" else 0)
            digits = F.replace(F.translate(digits, ",.", {0: ",.", 1: "\0.", 2: ".,", 3: "\0,", 4: "'."}[separators]), F.lit("\0"), F.lit(""))
            sign = F.when(n < 0, "-").otherwise("+" if "+" in flags else " " if " " in flags else "")
            if "0" in flags:
                body = F.concat(sign, F.when(F.length(digits) + F.length(sign) < width, F.lpad(digits, F.lit(width) - F.length(sign), F.lit("0"))).otherwise(digits))
            else:
                body = F.concat(sign, digits)
        elif kind == "x":
            body = F.hex(arg.cast("long"))
        else:
            body = arg.cast("string") if places is None else F.left(arg.cast("string"), F.lit(int(places)))
        parts.append(F.when(F.length(body) < width, F.lpad(body, width, " ")).otherwise(body) if width else body)
    return F.concat(*parts, F.lit(picture[at:]))


def printd(picture: str | int, ts: Column) -> Column:
    return format_date(ts, NUMBERED_PRINTS.get(picture, NUMBERED_PRINTS[2]) if isinstance(picture, int) else picture)


def printx(picture: str, text: Column) -> Column:
    """? any character, X letter or digit, A letter, 9 digit, * the rest, \\ the next as it is, > < = upper, lower, as is."""
    wanted = {"?": lambda c: True, "X": str.isalnum, "A": str.isalpha, "9": lambda c: c in "0123456789"}

    def one(source: str) -> str:
        rest, out, case, marks = iter(source), [], str, iter(picture)
        for mark in marks:
            if mark in wanted:
                out.append(case(next((c for c in rest if wanted[mark](c)), "")))
            elif mark == "*":
                out.append(case("".join(rest)))
            elif mark in "><=":
                case = {">": str.upper, "<": str.lower, "=": str}[mark]
            else:
                out.append(next(marks, "\\") if mark == "\\" else mark)
        return "".join(out)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return run(text)


class NotationError(ValueError):
    """A calculation that is no notation."""


_NOTATION = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|([-+*/()])|((?:\\.|[^\s\\+\-*/()])+))")


def notation(source: str, fields: dict[str, Column]) -> Column:
    """Field arithmetic with + - * / and parentheses; a backslash quotes a character of a name.

    Typed text counts as its number or 0; a division by zero, like anything not finite, has no value.
    """
    toks, at, end = [], 0, len(source.rstrip())
    while at < end:
        m = _NOTATION.match(source, at)
        if not m or m.end() == at:
            raise NotationError(f"unexpected {source[at : at + 5]!r}")
        toks.append(m)
        at = m.end()
    place = 0

    def peek() -> str | None:
        return toks[place][2] if place < len(toks) else None

    def atom(depth: int) -> Column:
        nonlocal place
        if depth > 64 or place >= len(toks):
            raise NotationError("the calculation ends early or nests too deeply")
        m = toks[place]
        place += 1
        if m[1]:
            return F.lit(float(m[1]))
        if m[3]:
            name = re.sub(r"\\(.)", r"\1", m[3])
            return F.coalesce(make_number(fields[name].cast("string")), F.lit(0.0)) if name in fields else F.lit(0.0)
        if m[2] in "+-":
            inner = atom(depth + 1)
            return -inner if m[2] == "-" else inner
        if m[2] == "(":
            inner = level(0, depth + 1)
            if peek() != ")":
                raise NotationError("')' expected")
            place += 1
            return inner
        raise NotationError(f"unexpected {m[2]!r}")

    def level(k: int, depth: int) -> Column:
        nonlocal place
        if k == 2:
            return atom(depth)
        left = level(k + 1, depth)
        while (op := peek()) in (("+", "-"), ("*", "/"))[k] and op is not None:
            place += 1
            right = level(k + 1, depth)
            left = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b)}[op](left, right)
        return left

    value = level(0, 0)
    if place != len(toks):
        raise NotationError("text behind the calculation")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


_CALL = re.compile(r"\b(AF(?:Number|Percent|Date|Time|Special|Range|Simple)_(?:Format|FormatEx|Validate|Calculate|Keystroke|KeystrokeEx))\s*\((.*?)\)\s*;?\s*$", re.S)
_ARGUMENT = re.compile(r'\s*(?:"((?:\\.|[^"\\])*)"|(true|false)|(-?\d+\.?\d*)|new Array\s*\((.*?)\)|\[(.*?)\])\s*(?:,|$)', re.S)


def recognise(script: str) -> tuple[str, list] | None:
    """(function, arguments) of a field script that is one known call, else None."""
    m = _CALL.search(script)
    if not m:
        return None

    def arguments(text: str) -> list:
        out, at = [], 0
        while at < len(text.rstrip()):
            a = _ARGUMENT.match(text, at)
            if not a:
                return out
            quoted, flag, number, array, bracket = a.groups()
            inner = array if array is not None else bracket
            out.append(arguments(inner) if inner is not None else flag == "true" if flag else float(number) if number else re.sub(r"\\(.)", r"\1", quoted))
            at = a.end()
        return out

    return m[1], arguments(m[2])


