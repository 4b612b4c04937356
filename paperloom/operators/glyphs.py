"""Plain text set on pages: a place for every line and every character that shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.sources.storage import dealt

#: Characters of a line, lines of a column, and columns of a page.
WIDTH, LINES, COLUMNS = 44, 20, 2
#: Points: the first line's corner, a character's pitch and width, a line's pitch and height, and the columns' distance.
LEFT, TOP, PITCH, BROAD, LEADING, HIGH, APART = 36.0, 40.0, 6.0, 5.0, 14.0, 10.0, 280.0


def _split(docs: DataFrame, key: str) -> DataFrame:
    """(key, page, n, text): pieces of lines, and the page that each stands on."""
    lines = docs.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(rf"[^\n]{{1,{WIDTH}}}"), F.lit(0))).alias("n", "text"))
    return lines.select(key, F.floor(F.col("n") / (LINES * COLUMNS)).alias("page"), "n", "text")


def _put(lines: DataFrame, key: str) -> DataFrame:
    slot = F.col("n") % (LINES * COLUMNS)
    x0, y0 = LEFT + F.floor(slot / LINES) * APART, TOP + (slot % LINES) * LEADING
    return lines.select(key, "page", slot.cast("long").alias("line"), "text", x0.alias("x0"), y0.alias("y0"), (x0 + (F.length("text") - 1) * PITCH + BROAD).alias("x1"), (y0 + HIGH).alias("y1"))


def typeset_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, line, text, x0, y0, x1, y1): lines that are not empty, broken after WIDTH characters, down the columns of each page.

    A null or empty text has no lines.  Everything is a projection: a text's lines know their places.
    """
    return _put(_split(docs, key), key)


def dealt_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """:func:`typeset_lines` dealt by page."""
    # Parts by the stored size of the texts, of which a line's characters take a hundred times as much.
    return _put(dealt(_split(docs, key), key, "page", size_of=docs), key)


def typeset(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, i, text, x0, y0, x1, y1): the characters of :func:`typeset_lines` but blanks, ``i`` in reading order.

    Lines are dealt by page before they fall apart: one shuffle of the text, none of its characters.
    """
    lines = dealt_lines(docs, key)
    chars = lines.select(key, "page", "line", "x0", "y0", F.posexplode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("k", "text"))
    x0 = F.col("x0") + F.col("k") * PITCH
    return chars.where(~F.col("text").isin(" ", "\t", "\r")).select(key, "page", (F.col("line") * WIDTH + F.col("k")).alias("i"), "text", x0.alias("x0"), "y0", (x0 + BROAD).alias("x1"), (F.col("y0") + HIGH).alias("y1"))


def sql(key: str = "doc_id", table: str = "documents") -> str:
    """The same as common table expressions ``ls`` and ``gs`` of DuckDB's SQL."""
    slot = f"(n % {LINES * COLUMNS})"
    return rf"""
lx AS (SELECT {key}, n - 1 AS n, w[n] AS text FROM (SELECT {key}, w, unnest(range(1, len(w) + 1)) AS n FROM (SELECT {key}, regexp_extract_all(text, '[^\n]{{1,{WIDTH}}}') AS w FROM {table}))),
ls AS (SELECT {key}, n // {LINES * COLUMNS} AS page, {slot} AS line, text, {LEFT} + {slot} // {LINES} * {APART} AS x0, {TOP} + {slot} % {LINES} * {LEADING} AS y0,
  {LEFT} + {slot} // {LINES} * {APART} + (length(text) - 1) * {PITCH} + {BROAD} AS x1, {TOP} + {slot} % {LINES} * {LEADING} + {HIGH} AS y1 FROM lx),
gx AS (SELECT {key}, page, line, x0, y0, k, substr(text, CAST(k + 1 AS INT), 1) AS text FROM (SELECT *, unnest(range(0, length(text))) AS k FROM ls)),
gs AS (SELECT {key}, page, line * {WIDTH} + k AS i, text, x0 + k * {PITCH} AS x0, y0, x0 + k * {PITCH} + {BROAD} AS x1, y0 + {HIGH} AS y1 FROM gx WHERE text NOT IN (' ', chr(9), chr(13)))"""
