"""Quality rules: a table of thresholds compiled into one projection, without user functions.

A rule bounds a ratio of two counts by whole hundredths, so verdicts are exact in any engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has have he in is it its of on or that the this to was were which will with you "
    "au aux ce ces dans de des du en est et il je la le les mais ne nous ou par pas pour qui que sa se son sur un une vous "
    "als am auch auf aus bei das dem den der des die ein eine er es für ich im ist mit nicht sich sie sind und von zu "
    "al como con del el ella era esta lo los las más mi muy no o para pero por su sus una y"
).split()


@dataclass(frozen=True)
class Rule:
    """100 * numerator lies within [low, high] * denominator; a bound may be missing."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None


RULES = (
    Rule("mean word length", "word_chars", "n_words", 200, 1500),
    Rule("symbols a word", "n_symbols", "n_words", high=20),
    Rule("exclamation marks a word", "n_exclaims", "n_words", high=50),
    Rule("stop words", "n_stop_words", "n_words", low=1),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=60),
    Rule("bullet lines", "n_bullet_lines", "n_lines", high=90),
    Rule("lines with an ellipsis at the end", "n_ellipsis_lines", "n_lines", high=50),
)


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more."""

    def positions(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = F.transform(s, lambda e, j: F.when((F.get(s, j - 1)["x"] == e["x"]) | (F.get(s, j + 1)["x"] == e["x"]), e["i"]))
        return F.sort_array(F.filter(same, lambda x: x.isNotNull()))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda v, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - v, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bound(bound(positions(h), twice), covered))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return bound(words, lambda w: F.when(F.size(w) < 3, 0).otherwise(bound(windows(w), counted)))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def measures(text: Column) -> dict[str, Column]:
    """The counts that rules compare, by name; each is a long."""
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    words = _words(text)
    trimmed = lambda x: F.regexp_replace(x, "^[ \\t\\x0B\\f\\r]+|[ \\t\\x0B\\f\\r]+$", "")
    stripped = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    columns = {
        "n_words": F.size(words),
        "word_chars": F.length(bare),
        "n_symbols": stripped(SYMBOLS),
        "n_exclaims": stripped("!"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))),
        "n_lines": F.size(lines),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: trimmed(x).rlike("^[-*•]"))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: trimmed(x).rlike("(\\.\\.\\.|…)$"))),
        "n_repeat_words": _repeated(words),
    }
    return {k: v.cast("long") for k, v in columns.items()}


def compiled(rules: tuple[Rule, ...], column=F.col) -> Column:
    """One boolean of all rules."""
    verdict = F.lit(True)
    for r in rules:
        part, whole = column(r.numerator) * 100, column(r.denominator)
        if r.low is not None:
            verdict &= part >= whole * r.low
        if r.high is not None:
            verdict &= part <= whole * r.high
    return verdict


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    A null text has no words and fails.  Under 50 words, or with over half of the words in
    repeated 3-word windows, ``base_failed``; ``kept`` needs that to be false and every rule to hold.
    Null doc_ids and repeated rows keep their rows; extra columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", *(c.alias(k) for k, c in measures(text).items()))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & compiled(rules)).alias("kept")
    )


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB's SQL, with 3-word windows counted as text."""
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    verdict = " AND ".join(
        f"100 * {r.numerator} {op} {limit} * {r.denominator}" for r in rules for op, limit in ((">=", r.low), ("<=", r.high)) if limit is not None
    )
    trimmed = rf"trim(x, {space})"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split(translate(text, {space}, repeat(chr(32), 6)), ' '), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: translate(x, {space}, '') <> '') AS lines FROM t),
i AS (SELECT rn, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
g AS (SELECT rn, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM i),
r AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM g) WHERE c > 1),
p AS (SELECT rn, count(DISTINCT j) AS n FROM (SELECT rn, i + unnest([0, 1, 2]) AS j FROM r) GROUP BY rn),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(translate(text, {space}, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(length(text) - length(translate(text, '!', '')) AS BIGINT) AS n_exclaims,
  CAST(len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(len(list_filter(lines, lambda x: regexp_matches({trimmed}, '^[-*•]'))) AS BIGINT) AS n_bullet_lines,
  CAST(len(list_filter(lines, lambda x: regexp_matches({trimmed}, '(\.\.\.|…)$'))) AS BIGINT) AS n_ellipsis_lines,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN p USING (rn)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {verdict} AS kept FROM b
"""


def kept_by_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with all their columns, in one pass."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [f"__{k}" for k in measures(text)]
    counted = docs.select("*", *(c.alias(f"__{k}") for k, c in measures(text).items()))
    failed = (F.col("__n_words") < 50) | (F.col("__n_repeat_words") * 100 > F.col("__n_words") * 50)
    return counted.where(~failed & compiled(rules, lambda c: F.col(f"__{c}"))).drop(*names)
