"""The form language's built-in functions, as functions from columns to a column.

Text arguments are strings, numbers doubles; :data:`FUNCTIONS` names them for the compiler in
:mod:`paperloom.plans.formula`, with the kind of each argument and of the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.coerce import compare, is_blank, leading_number, num_text, numeric_text, round_half_away, strip, to_num

DAY_ZERO = "1899-12-31"
# English number and month names, and the date pictures by style.
ONES = "Zero One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Thirteen Fourteen Fifteen Sixteen Seventeen Eighteen Nineteen".split()
TENS = "Zero Ten Twenty Thirty Forty Fifty Sixty Seventy Eighty Ninety".split()
MONTHS = "January February March April May June July August September October November December".split()
DATE_STYLES = {0: "MMM D, YYYY", 1: "MM/DD/YY", 2: "MMM D, YYYY", 3: "MMMM D, YYYY", 4: "MMMM D, YYYY"}
TIME_STYLES = {0: "h:MM:SS A", 1: "h:MM A", 2: "h:MM:SS A", 3: "h:MM:SS A Z", 4: "h:MM:SS A Z"}


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# -- numbers

def mod(a: Column, b: Column) -> Column:
    """Sign of ``a``; b = 0 raises."""
    return a % b


def ceil(a: Column) -> Column:
    return F.ceil(a).cast("double")


def floor(a: Column) -> Column:
    return F.floor(a).cast("double")


def round_(a: Column, n: Column | int = 0) -> Column:
    return round_half_away(a, F.least(F.greatest(lit(n).cast("double"), F.lit(0.0)), F.lit(12.0)).cast("int"))


def sum_(*a: Column) -> Column:
    """Of the values that are not null; nothing sums to 0."""
    return F.aggregate(F.array_compact(F.array(*a)), F.lit(0.0), lambda s, x: s + x)


def avg(*a: Column) -> Column:
    some = F.array_compact(F.array(*a))
    return F.when(F.size(some) > 0, sum_(*a) / F.size(some))


def max_(*a: Column) -> Column:
    return F.array_max(F.array(*a))


def min_(*a: Column) -> Column:
    return F.array_min(F.array(*a))


def count(*a: Column) -> Column:
    return F.size(F.filter(F.array(*a), lambda x: x.isNotNull() & (x != ""))).cast("double")


# -- logic

def choose(i: Column, *a: Column) -> Column:
    return F.get(F.array(*a), F.when(i.between(-1e9, 1e9), F.floor(i)).cast("int") - 1)


def exists(a: Column) -> Column:
    return a.isNotNull().cast("double")


def has_value(a: Column) -> Column:
    return F.coalesce(strip(a) != "", F.lit(False)).cast("double")


def one_of(v: Column, *a: Column) -> Column:
    hits = F.lit(0)
    for x in a:
        hits = F.greatest(hits, compare("==", v, x))
    return hits.cast("double")


def within(v: Column, low: Column, high: Column) -> Column:
    return F.least(compare(">=", v, low), compare("<=", v, high)).cast("double")


# -- text

def at(s: Column, part: Column) -> Column:
    """1-based place of ``part``, 0 where it is not or is empty."""
    return F.when(part == "", 0).otherwise(F.position(part, s)).cast("double")


def concat(*a: Column) -> Column:
    return F.concat_ws("", *a)


def left(s: Column, n: Column) -> Column:
    return F.left(s, n.cast("int"))


def right(s: Column, n: Column) -> Column:
    return F.right(s, n.cast("int"))


def len_(s: Column) -> Column:
    return F.char_length(s).cast("double")


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, r"^[\s\x{85}\p{Z}]+", "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, r"[\s\x{85}\p{Z}]+$", "")


def space(n: Column) -> Column:
    return F.repeat(F.lit(" "), F.greatest(n.cast("int"), F.lit(0)))


def str_(v: Column, width: Column | int = 10, places: int = 0) -> Column:
    """Right-aligned with fixed places; too long makes asterisks."""
    shown = F.format_string(f"%.{places}f", round_half_away(v, places))
    width = lit(width).cast("int")
    return F.when(F.length(shown) > width, F.repeat(F.lit("*"), width)).otherwise(F.lpad(shown, width, F.lit(" ")))


def substr(s: Column, start: Column, n: Column) -> Column:
    return F.substring(s, F.greatest(lit(start).cast("int"), F.lit(1)), F.greatest(lit(n).cast("int"), F.lit(0)))


def stuff(s: Column, start: Column, gone: Column, put: Column | str = "") -> Column:
    a = F.greatest(lit(start).cast("int"), F.lit(1)) - 1
    n = F.greatest(lit(gone).cast("int"), F.lit(0))
    return F.concat(F.left(s, a), lit(put), F.substring(s, a + n + 1, F.length(s)))


def replace(s: Column, old: Column, new: Column | str = "") -> Column:
    return F.when(old == "", s).otherwise(F.replace(s, old, lit(new)))


def _below_1000(n: int) -> str:
    hundreds, rest = divmod(n, 100)
    said = [f"{ONES[hundreds]} Hundred"] if hundreds else []
    if rest >= 20:
        said.append(TENS[rest // 10] + (f"-{ONES[rest % 10]}" if rest % 10 else ""))
    elif rest or not n:
        said.append(ONES[rest])
    return " ".join(said)


def in_words(n: int) -> str:
    said = []
    for power, name in ((9, "Billion"), (6, "Million"), (3, "Thousand")):
        group, n = divmod(n, 10**power)
        if group:
            said.append(f"{_below_1000(group)} {name}")
    return " ".join([*said, *([_below_1000(n)] if n or not said else [])])


def word_num(v: Column, kind: int = 0) -> Column:
    """English words of a number in [0, 1e12), else ""; kind 2 adds dollars and cents."""

    @F.pandas_udf("string")
    def said(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None or not 0 <= x < 1e12:
                return None if x is None else ""
            if kind != 2:
                return in_words(int(x))
            cents = int(x * 100 + 0.5)
            whole, rest = divmod(cents, 100)
            return f"{in_words(whole)} {'Dollar' if whole == 1 else 'Dollars'} And {rest:02d} {'Cent' if rest == 1 else 'Cents'}"

        return s.map(one, na_action="ignore")

    return said(v)


def encode(s: Column, kind: str = "url") -> Column:
    if kind in ("html", "xml"):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            s = F.replace(s, F.lit(a), F.lit(b))
        return s
    out = F.url_encode(s)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def decode(s: Column, kind: str = "url") -> Column:
    """A plus sign and a stray % stay as they are."""
    if kind in ("html", "xml"):
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
            s = F.replace(s, F.lit(a), F.lit(b))
        return s
    return F.url_decode(F.regexp_replace(F.replace(s, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))


# -- pictures

def format_number(picture: str, v: Column) -> Column:
    places = sum(c in "9zZ" for c in picture.partition(".")[2])
    size = F.abs(v)
    shown = F.format_number(round_half_away(size, places), places) if "," in picture else F.format_string(f"%.{places}f", round_half_away(size, places))
    shown = F.concat(F.lit("$"), shown) if "$" in picture else shown
    return F.when(v < 0, F.concat(F.lit("-"), shown)).otherwise(shown)


def parse_number(s: Column) -> Column:
    return leading_number(F.regexp_replace(s, "[^0-9.-]", ""))


def _runs(picture: str) -> list[str]:
    out: list[str] = []
    for c in picture:
        if out and c.upper() in "YMD" and out[-1][0].upper() == c.upper():
            out[-1] += c
        else:
            out.append(c)
    return out


def date_text(day: Column, picture: str = "MMM D, YYYY") -> Column:
    """A date by a picture of Y, M and D runs; other characters stand for themselves."""
    parts = []
    for run in _runs(picture):
        kind, n = run[0].upper(), len(run)
        name = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))
        parts.append(
            {
                "Y": F.lpad(F.pmod(F.year(day), F.lit(100)).cast("string"), 2, "0") if n <= 2 else F.lpad(F.year(day).cast("string"), 4, "0"),
                "M": F.month(day).cast("string") if n == 1 else F.lpad(F.month(day).cast("string"), 2, "0") if n == 2 else F.left(name, F.lit(3)) if n == 3 else name,
                "D": F.day(day).cast("string") if n == 1 else F.lpad(F.day(day).cast("string"), 2, "0"),
            }.get(kind, F.lit(run))
        )
    return F.concat(*parts)


def parse_date(s: Column, picture: str) -> Column:
    """A date by a picture, null where the text does not fit; two-digit years turn at 50."""
    pattern, groups = "", {}
    for run in _runs(picture):
        kind, n = run[0].upper(), len(run)
        if kind not in "YMD":
            pattern += "\\Q" + run + "\\E"
            continue
        groups[kind] = (len(groups) + 1, n)
        pattern += "((?i:" + "|".join(f"{m}|{m[:3]}" for m in MONTHS) + "))" if kind == "M" and n >= 3 else "([0-9]{1,%d})" % max(2, n)
    text = strip(s)

    def part(kind: str):
        if kind not in groups:
            return F.lit(1) if kind != "Y" else F.lit(None).cast("int")
        g, n = groups[kind]
        found = F.regexp_extract(text, "^" + pattern, g)
        if kind == "M" and n >= 3:
            return F.nullif(F.array_position(F.array(*(F.lit(m[:3].lower()) for m in MONTHS)), F.lower(F.left(found, F.lit(3)))).cast("int"), F.lit(0))
        value = found.try_cast("int")
        return F.when(value < 50, value + 2000).otherwise(value + 1900) if kind == "Y" and n <= 2 else value

    iso = F.format_string("%04d-%02d-%02d", part("Y"), part("M"), part("D"))
    return F.when(text.rlike("^" + pattern), F.try_to_date(iso, "yyyy-MM-dd"))


# -- dates and times: days from 1900-01-01 = 1, milliseconds of the day

def date2num(s: Column, picture: str = "MMM D, YYYY") -> Column:
    """Day number by the picture, else YYYYMMDD, else ISO; 0 where none fits."""
    day = F.coalesce(parse_date(s, picture), parse_date(s, "YYYYMMDD"), parse_date(s, "YYYY-MM-DD"))
    return F.coalesce(F.datediff(day, F.lit(DAY_ZERO).cast("date")), F.lit(0)).cast("double")


def num2date(n: Column, picture: str = "MMM D, YYYY") -> Column:
    return date_text(F.date_add(F.lit(DAY_ZERO).cast("date"), F.floor(n).cast("int")), picture)


def today() -> Column:
    return F.datediff(F.to_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())), F.lit(DAY_ZERO).cast("date")).cast("double")


def now() -> Column:
    return F.pmod(F.unix_millis(F.current_timestamp()), F.lit(86_400_000)).cast("double")


def date_fmt(style: int = 0) -> Column:
    return F.lit(DATE_STYLES.get(style, DATE_STYLES[0]))


def time_fmt(style: int = 0) -> Column:
    return F.lit(TIME_STYLES.get(style, TIME_STYLES[0]))


def num2time(ms: Column) -> Column:
    seconds = F.floor(F.pmod(ms, F.lit(86_400_000.0)) / 1000).cast("long")
    shown = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)
    return F.when(ms >= 0, shown)


def time2num(s: Column) -> Column:
    """h:m:s as milliseconds; what is missing counts as 0."""
    parts = F.split(strip(s), ":")
    piece = lambda i: F.coalesce(leading_number(F.get(parts, F.lit(i))), F.lit(0.0))
    return (piece(0) * 3600 + piece(1) * 60 + piece(2)) * 1000


# -- money

def fv(p: Column, r: Column, n: Column) -> Column:
    return F.when(r == 0, p * n).otherwise(p * ((F.pow(1 + r, n) - 1) / r))


def pv(p: Column, r: Column, n: Column) -> Column:
    return F.when(r == 0, p * n).otherwise(p * ((1 - F.pow(1 + r, -n)) / r))


def _positive(value: Column, message: str, *needed: Column) -> Column:
    ok = F.lit(True)
    for c in needed:
        ok &= c > 0
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def pmt(v: Column, r: Column, n: Column) -> Column:
    return _positive(F.when(r == 0, v / n).otherwise(v * r / (1 - F.pow(1 + r, -n))), "Pmt: periods must be positive", n)


def term(p: Column, r: Column, v: Column) -> Column:
    return _positive(F.ln(v * r / p + 1) / F.ln(1 + r), "Term: arguments must be positive", p, r, v)


def cterm(r: Column, v: Column, p: Column) -> Column:
    return _positive(F.ln(v / p) / F.ln(1 + r), "CTerm: arguments must be positive", r, v, p)


def rate(v: Column, p: Column, n: Column) -> Column:
    return _positive(F.pow(v / p, 1 / n) - 1, "Rate: arguments must be positive", v, p, n)


def npv(r: Column, flows: Column) -> Column:
    return F.aggregate(F.transform(flows, lambda x, i: x / F.pow(1 + r, i + 1)), F.lit(0.0), lambda s, x: s + x)


def _paid(v: Column, r: Column, p: Column, first: Column, n: Column) -> Column:
    """Interest and principal of ``n`` payments from the ``first``, of a balance that may run out early."""
    start = F.struct(v.cast("double").alias("left"), F.lit(0.0).alias("interest"), F.lit(0.0).alias("principal"))

    def pay(s: Column, k: Column) -> Column:
        interest = s["left"] * r
        part = F.least(p - interest, s["left"])
        counts = (k >= first) & (s["left"] > 0)
        return F.struct(
            F.when(s["left"] > 0, s["left"] - part).otherwise(s["left"]).alias("left"),
            (s["interest"] + F.when(counts, interest).otherwise(0.0)).alias("interest"),
            (s["principal"] + F.when(counts, part).otherwise(0.0)).alias("principal"),
        )

    last = F.least(first + n - 1, F.lit(10_000)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), start, pay)


def ipmt(v: Column, r: Column, p: Column, first: Column, n: Column) -> Column:
    return _paid(v, r, p, F.greatest(first, F.lit(1)), F.greatest(n, F.lit(1)))["interest"]


def ppmt(v: Column, r: Column, p: Column, first: Column, n: Column) -> Column:
    return _paid(v, r, p, F.greatest(first, F.lit(1)), F.greatest(n, F.lit(1)))["principal"]


def apr(v: Column, p: Column, n: Column) -> Column:
    """Yearly rate of a loan: Newton's steps down to the monthly one, by bisection below one payment.

    What a rate costs is convex in it, and at p / v is more than p: from there each step stays above the rate that is
    looked for, and eight are more than doubles can tell apart.  Rates go from 0 to 1 a month.
    """
    return _positive(F.when(n < 1, _halved(v, p, n)).otherwise(_stepped(v, p, n)) * 12, "Apr: arguments must be positive", v, p, n)


def _halved(v: Column, p: Column, n: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def halve(s: Column, _) -> Column:
        mid = (s["low"] + s["high"]) / 2
        cost = F.when(mid == 0, v / n).otherwise(v * mid / (1 - F.pow(1 + mid, -n)))
        return F.struct(F.when(cost > p, s["low"]).otherwise(mid).alias("low"), F.when(cost > p, mid).otherwise(s["high"]).alias("high"))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, halve)
    return (ends["low"] + ends["high"]) / 2


#: Newton's steps: six are enough for payments of 1 to 50 times the loan (fixed value).
STEPS = 8


def _stepped(v: Column, p: Column, n: Column) -> Column:
    once = lambda of, fn: F.get(F.transform(F.array(of), fn), F.lit(0))

    def step(r: Column, _) -> Column:
        def better(paid: Column) -> Column:
            slope = paid - r * n * (1 - paid) / (1 + r)
            return F.when((r > 0) & (slope > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), r - (r - p / v * paid) * paid / slope))).otherwise(r)

        return once(-F.expm1(-n * F.log1p(r)), better)

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.least(p / v, F.lit(1.0)), step)


# -- units

def _unit(s: Column) -> Column:
    return F.lower(strip(F.regexp_replace(strip(s), "^[0-9.+-]+", "")))


def unit_type(s: Column) -> Column:
    u = _unit(s)
    return F.when(u.isin("mm", "millimeter", "millimeters"), "mm").when(u.isin("cm", "centimeter", "centimeters"), "cm").when(u.isin("pt", "point", "points"), "pt").when(u.isin("pc", "pica"), "pc").otherwise("in")


def unit_value(s: Column, to: Column | str = "") -> Column:
    inch = lambda u: F.when(u == "mm", 25.4).when(u == "cm", 2.54).when(u == "pt", 72.0).when(u == "pc", 6.0).otherwise(1.0)
    own = _unit(s)
    target = F.lower(strip(lit(to)))
    return to_num(s) / inch(own) * inch(F.when(target == "", own).otherwise(target))


@dataclass(frozen=True)
class Function:
    """A built-in: kinds of its arguments (n, s, or * repeating the one before) and of the result; ``literals`` are plain values."""

    apply: Callable
    kinds: str
    result: str
    literals: tuple[int, ...] = ()


def _refused(*_):
    return F.raise_error(F.lit("network access is refused")).cast("string")


FUNCTIONS: dict[str, Function] = {
    "abs": Function(F.abs, "n", "n"), "ceil": Function(ceil, "n", "n"), "floor": Function(floor, "n", "n"), "mod": Function(mod, "nn", "n"), "round": Function(round_, "nn", "n"),
    "sum": Function(sum_, "n*", "n"), "avg": Function(avg, "n*", "n"), "max": Function(max_, "n*", "n"), "min": Function(min_, "n*", "n"), "count": Function(count, "s*", "n"),
    "choose": Function(choose, "ns*", "s"), "exists": Function(exists, "s", "n"), "hasvalue": Function(has_value, "s", "n"), "oneof": Function(one_of, "ss*", "n"), "within": Function(within, "sss", "n"),
    "at": Function(at, "ss", "n"), "concat": Function(concat, "s*", "s"), "left": Function(left, "sn", "s"), "right": Function(right, "sn", "s"), "len": Function(len_, "s", "n"),
    "lower": Function(F.lower, "s", "s"), "upper": Function(F.upper, "s", "s"), "ltrim": Function(ltrim, "s", "s"), "rtrim": Function(rtrim, "s", "s"), "space": Function(space, "n", "s"),
    "str": Function(str_, "nnn", "s", (2,)), "substr": Function(substr, "snn", "s"), "stuff": Function(stuff, "snns", "s"), "replace": Function(replace, "sss", "s"), "wordnum": Function(word_num, "nn", "s", (1,)),
    "uuid": Function(lambda *_: F.uuid(), "n", "s"), "encode": Function(encode, "ss", "s", (1,)), "decode": Function(decode, "ss", "s", (1,)),
    "date": Function(today, "", "n"), "time": Function(now, "", "n"), "date2num": Function(date2num, "ss", "n", (1,)), "isodate2num": Function(lambda s: date2num(s, "YYYY-MM-DD"), "s", "n"), "num2date": Function(num2date, "ns", "s", (1,)),
    "datefmt": Function(date_fmt, "n", "s", (0,)), "localdatefmt": Function(date_fmt, "n", "s", (0,)), "timefmt": Function(time_fmt, "n", "s", (0,)), "localtimefmt": Function(time_fmt, "n", "s", (0,)),
    "num2time": Function(num2time, "n", "s"), "num2gmtime": Function(num2time, "n", "s"), "time2num": Function(time2num, "s", "n"), "isotime2num": Function(time2num, "s", "n"),
    "fv": Function(fv, "nnn", "n"), "pv": Function(pv, "nnn", "n"), "pmt": Function(pmt, "nnn", "n"), "term": Function(term, "nnn", "n"), "cterm": Function(cterm, "nnn", "n"), "rate": Function(rate, "nnn", "n"),
    "npv": Function(lambda r, *flows: npv(r, F.array(*flows)), "nn*", "n"), "ipmt": Function(ipmt, "nnnnn", "n"), "ppmt": Function(ppmt, "nnnnn", "n"), "apr": Function(apr, "nnn", "n"),
    "unittype": Function(unit_type, "s", "s"), "unitvalue": Function(unit_value, "ss", "n"), "format": Function(lambda p, v: format_value(p, v), "ss", "s", (0,)), "parse": Function(lambda p, s: parse_value(p, s), "ss", "s", (0,)),
    "get": Function(_refused, "s", "s"), "post": Function(_refused, "s*", "s"), "put": Function(_refused, "s*", "s"),
}


def format_value(picture: str, v: Column) -> Column:
    """Text by a number or date picture; a date is a day number or ISO text, else the text itself."""
    if any(k in picture.upper() for k in ("YY", "DD")):
        number = F.when(numeric_text(v), leading_number(v))
        return F.when(number.isNotNull(), num2date(number, picture)).otherwise(F.coalesce(date_text(parse_date(v, "YYYY-MM-DD"), picture), v))
    return format_number(picture, to_num(v))


def parse_value(picture: str, s: Column) -> Column:
    return date_text(parse_date(s, picture), "YYYY-MM-DD") if "YY" in picture.upper() else num_text(parse_number(s))


__all__ = ["FUNCTIONS", "Function", "is_blank"]
