"""The form language's expressions, compiled to one column: names are fields, built-ins are functions.

Precedence, loosest first: or, and, equality, order, sum, product, unary.  Statements, loops and
user functions are outside the compiled subset and raise :class:`FormulaError`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.coerce import arithmetic, both, compare, either, leading_number, num_text
from paperloom.functions.formcalc import FUNCTIONS

MAX_DEPTH = 64
_TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>"(?:[^"]|"")*")|(?P<name>[A-Za-z_$][\w.$]*(?:\[\d+\])?)|(?P<op><>|<=|>=|==|[-+*/()<>=,&|!]))""",
    re.X,
)
_WORDS = {"and": "&", "or": "|", "not": "!", "eq": "==", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
_LEVELS = (("|",), ("&",), ("==", "<>", "="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/"))


class FormulaError(ValueError):
    """A formula outside the compiled language."""


@dataclass
class Value:
    """A column of the language with its kind: n(umber) or s(tring); literals keep their Python value."""

    column: Column
    kind: str
    literal: object = None

    def number(self) -> Column:
        return self.column if self.kind == "n" else leading_number(self.column)

    def nullable(self) -> Column:
        """A number, null where the value is; other text counts from its leading number, else 0."""
        return self.column if self.kind == "n" else F.when(self.column.isNotNull() & (self.column != ""), F.coalesce(leading_number(self.column), F.lit(0.0)))

    def text(self) -> Column:
        return self.column if self.kind == "s" else num_text(self.column)

    def true(self) -> Column:
        return F.coalesce(self.number() != 0, F.lit(False))


def tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise FormulaError(f"unexpected {source[at : at + 10]!r}")
        kind = m.lastgroup
        text = m[kind]
        if kind == "name" and text.lower() in _WORDS:
            kind, text = "op", _WORDS[text.lower()]
        out.append((kind, text))
        at = m.end()
    return out


class _Parser:
    def __init__(self, source: str, fields: dict[str, str]):
        self.toks, self.at, self.fields = tokens(source), 0, fields

    def peek(self) -> str | None:
        return self.toks[self.at][1] if self.at < len(self.toks) and self.toks[self.at][0] == "op" else None

    def take(self, op: str) -> bool:
        if self.peek() == op:
            self.at += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise FormulaError(f"{op!r} expected")

    def level(self, k: int, depth: int) -> Value:
        if depth > MAX_DEPTH:
            raise FormulaError("nested too deeply")
        if k == len(_LEVELS):
            return self.unary(depth)
        left = self.level(k + 1, depth)
        while (op := self.peek()) in _LEVELS[k] and op is not None:
            self.at += 1
            left = self.binary(op, left, self.level(k + 1, depth))
        return left

    @staticmethod
    def binary(op: str, a: Value, b: Value) -> Value:
        if op in "+-*/":
            return Value(arithmetic(op, a.nullable(), b.nullable()), "n")
        if op == "&":
            return Value(both(a.true(), b.true()).cast("double"), "n")
        if op == "|":
            return Value(either(a.true(), b.true()).cast("double"), "n")
        return Value(compare("==" if op == "=" else op, a.text(), b.text()).cast("double"), "n")

    def unary(self, depth: int) -> Value:
        if self.take("-"):
            return Value(-self.unary(depth + 1).nullable(), "n")
        if self.take("+"):
            return Value(self.unary(depth + 1).nullable(), "n")
        if self.take("!"):
            return Value(F.when(self.unary(depth + 1).true(), 0.0).otherwise(1.0), "n")
        return self.primary(depth)

    def primary(self, depth: int) -> Value:
        if self.at >= len(self.toks):
            raise FormulaError("the formula ends early")
        kind, text = self.toks[self.at]
        self.at += 1
        if kind == "num":
            return Value(F.lit(float(text)), "n", float(text))
        if kind == "str":
            value = text[1:-1].replace('""', '"')
            return Value(F.lit(value), "s", value)
        if kind == "name":
            if self.take("("):
                return self.call(text, depth)
            if text.lower() == "null":
                return Value(F.lit(None).cast("string"), "s")
            if text not in self.fields:
                raise FormulaError(f"no field {text!r}")
            number = self.fields[text] in ("double", "float", "int", "bigint", "smallint", "tinyint") or self.fields[text].startswith("decimal")
            return Value(F.col(f"`{text}`").cast("double" if number else "string"), "n" if number else "s")
        if text == "(":
            inner = self.level(0, depth + 1)
            self.need(")")
            return inner
        raise FormulaError(f"unexpected {text!r}")

    def call(self, name: str, depth: int) -> Value:
        args: list[Value] = []
        while not self.take(")"):
            if args:
                self.need(",")
            args.append(self.level(0, depth + 1))
        if name.lower() == "if":
            if len(args) != 3:
                raise FormulaError("If takes three arguments")
            kind = "n" if args[1].kind == args[2].kind == "n" else "s"
            pick = (lambda v: v.column) if kind == "n" else (lambda v: v.text())
            return Value(F.when(args[0].true(), pick(args[1])).otherwise(pick(args[2])), kind)
        f = FUNCTIONS.get(name.lower())
        if f is None:
            raise FormulaError(f"no function {name!r}")
        given = []
        for i, a in enumerate(args):
            kinds = f.kinds.rstrip("*")
            if i >= len(kinds) and not f.kinds.endswith("*"):
                raise FormulaError(f"{name} takes at most {len(kinds)} arguments")
            if i in f.literals:
                if a.literal is None:
                    raise FormulaError(f"argument {i + 1} of {name} must be a literal")
                given.append(int(a.literal) if isinstance(a.literal, float) else a.literal)
            elif kinds[min(i, len(kinds) - 1)] == "n":
                given.append(a.nullable() if f.kinds.endswith("*") else F.coalesce(a.nullable(), F.lit(0.0)))
            else:
                given.append(a.text())
        return Value(f.apply(*given).cast("double" if f.result == "n" else "string"), f.result)


def compile_formula(source: str, fields: dict[str, str]) -> Column:
    """One column for the formula; ``fields`` are names with Spark type names."""
    parser = _Parser(source, fields)
    value = parser.level(0, 0)
    if parser.at != len(parser.toks):
        raise FormulaError(f"unexpected {parser.toks[parser.at][1]!r}")
    return value.column


def with_formulas(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """Adds one column a formula, in order: each sees the results before it."""
    for name, source in formulas.items():
        df = df.withColumn(name, compile_formula(source, dict(df.dtypes)))
    return df


def uses(source: str) -> list[str]:
    """Names that a formula reads: those that are not called."""
    found = tokens(source)
    return list(dict.fromkeys(word for (kind, word), (_, after) in zip(found, [*found[1:], ("", "")], strict=True) if kind == "name" and after != "(" and word.lower() not in ("null", "if", "then", "else", "endif", *_WORDS)))


def levels(formulas: dict[str, str]) -> list[list[str]]:
    """Formulas in the order of calculation: each level uses only fields and levels before it.  A cycle raises with its names."""
    left = {name: {u for u in uses(source) if u in formulas} for name, source in formulas.items()}
    out = []
    while left:
        free = [n for n, needs in left.items() if not needs & left.keys()]
        if not free:
            raise FormulaError("formulas use each other: " + ", ".join(sorted(left)))
        out.append(free)
        left = {n: needs for n, needs in left.items() if n not in free}
    return out


def recalculated(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """Adds one column a formula in whatever order they are given: a projection a level, so what several formulas use is computed once."""
    for level in levels(formulas):
        types = dict(df.dtypes)
        df = df.withColumns({name: compile_formula(formulas[name], types) for name in level})
    return df
