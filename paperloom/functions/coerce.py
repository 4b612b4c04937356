"""Implicit conversions of the form language, as columns: numbers from text, text from numbers, nulls, order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading numeric part of a trimmed text.
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
UNICODE_SPACE = r"[\s\x{85}\p{Z}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often it is used there: columns alone would repeat it at each use, and what is nested multiplies."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, f"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$", "")


def leading_number(text: Column) -> Column:
    """The number a text begins with, null without one ("12abc" is 12)."""
    return F.regexp_extract(strip(text), NUMBER, 0).try_cast("double")


def to_num(text: Column) -> Column:
    """A text as a number: its leading number, else 0; null counts as 0."""
    return F.coalesce(leading_number(text), F.lit(0.0))


def num_text(number: Column) -> Column:
    """A number as printed: whole numbers without a fraction, else up to 12 decimals without trailing zeros."""

    def shown(n: Column) -> Column:
        whole = (F.floor(n) == n) & (F.abs(n) < 1e15)
        decimals = let(F.regexp_replace(F.format_string("%.12f", n), r"\.?0+$", ""), lambda d: F.when(d.isin("", "-0"), "0").otherwise(d))
        return F.when(F.isnan(n), "NaN").when(F.abs(n) == float("inf"), F.when(n > 0, "Infinity").otherwise("-Infinity")).when(whole, n.cast("long").cast("string")).otherwise(decimals)

    return let(number, shown)


def is_blank(text: Column) -> Column:
    """An absent or empty value is null in the language."""
    return text.isNull() | (text == "")


def numeric_text(text: Column) -> Column:
    """The whole trimmed text is a number."""
    return F.coalesce(strip(text).rlike(NUMBER + "$"), F.lit(False))


def compare(op: str, a: Column, b: Column) -> Column:
    """1 or 0 for ``a op b`` on text values: nulls equal each other and differ from all else; two numbers compare as such, other text by code unit."""
    x, y = leading_number(a), leading_number(b)
    numbers = numeric_text(a) & numeric_text(b)
    by_op = {"==": lambda p, q: p == q, "<>": lambda p, q: p != q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}[op]
    both_null = F.lit(1 if op in ("==", "<=", ">=") else 0)
    one_null = F.lit(1 if op == "<>" else 0)
    return F.when(is_blank(a) & is_blank(b), both_null).when(is_blank(a) | is_blank(b), one_null).otherwise(F.when(numbers, by_op(x, y)).otherwise(by_op(a, b)).cast("int"))


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """``a op b`` on nullable numbers: null only where both are, else null counts as 0; division by 0 raises."""
    x, y = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    value = {"+": x + y, "-": x - y, "*": x * y, "/": x / y}[op]
    return F.when(a.isNull() & b.isNull(), F.lit(None).cast("double")).otherwise(value)


def truthy(text: Column) -> Column:
    return F.coalesce(to_num(text) != 0, F.lit(False))


def both(a: Column, b: Column) -> Column:
    """1 or 0 without evaluating ``b`` where ``a`` is false."""
    return F.when(a, F.when(b, 1).otherwise(0)).otherwise(0)


def either(a: Column, b: Column) -> Column:
    return F.when(a, 1).otherwise(F.when(b, 1).otherwise(0))


def make_number(text: Column) -> Column:
    """A number from typed text, null for none: currency signs, spaces and % fall away, parentheses negate, a last comma may be the decimal sign."""

    def plain(inner: Column) -> Column:
        comma = F.length(inner) - F.instr(F.reverse(inner), ",") + 1
        point = F.length(inner) - F.instr(F.reverse(inner), ".") + 1
        has_comma, has_point = F.instr(inner, ",") > 0, F.instr(inner, ".") > 0
        return (
            F.when(has_comma & has_point & (comma > point), F.translate(F.translate(inner, ".", ""), ",", "."))
            .when(has_comma & ~has_point & (F.length(inner) - comma != 3), F.translate(inner, ",", "."))
            .otherwise(F.translate(inner, ",", ""))
        )

    def signed(bare: Column) -> Column:
        negative = bare.startswith("(") & bare.endswith(")")
        digits = let(F.regexp_replace(bare, r"^\(+|\)+$", ""), plain)
        value = let(digits, lambda d: F.when(d.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), d.try_cast("double")))
        return let(value, lambda v: F.when(F.abs(v) == float("inf"), None).when(negative, -v).otherwise(v))

    return let(F.regexp_replace(text, r"[\s\x{85}\p{Z}$€£¥'%]", ""), signed)


def round_half_away(number: Column, places: int | Column) -> Column:
    """Half away from zero on the binary product, not on the decimal text."""
    scale = F.pow(F.lit(10.0), F.lit(places) if isinstance(places, int) else places)
    return F.signum(number) * F.floor(F.abs(number * scale) + 0.5) / scale
