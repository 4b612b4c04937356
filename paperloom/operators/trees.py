"""Trees by path: bookmarks, data nodes, and names that point into them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outline(headings: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, path, title): bookmarks of headings (level 1 or 2, text): a second level counts within the first before it."""
    w = Window.partitionBy(doc).orderBy(order)
    ones = F.sum((F.col("level") == 1).cast("int")).over(w)
    counted = headings.withColumn("a", F.greatest(ones, F.lit(1)))
    second = F.sum((F.col("level") == 2).cast("int")).over(Window.partitionBy(doc, "a").orderBy(order))
    return counted.select(doc, F.when(F.col("level") == 1, F.array("a")).otherwise(F.array(F.col("a"), second)).alias("path"), F.col("text").alias("title"))


def bookmark_list(bookmarks: DataFrame, offset: int = 0, limit: int = 100, *then: str) -> DataFrame:
    """A page of bookmarks in tree order (equal paths by ``then``), with their depth; the limit is the feature."""
    return bookmarks.withColumn("depth", F.size("path") - 1).orderBy("path", *then).offset(offset).limit(limit)


def bookmark_move(bookmarks: DataFrame, source: list[int], target: list[int]) -> DataFrame:
    """The bookmark at ``source`` and all below it go before ``target``'s place; brothers close up and make room.

    Places are 1-based paths; a target inside the moved tree raises.
    """
    if target[: len(source)] == source:
        raise ValueError("a bookmark cannot move into itself")
    path = F.col("path")

    def under(p: list[int]) -> Column:
        return F.slice(path, 1, len(p)) == F.array(*map(F.lit, p))

    def shifted(col: Column, place: list[int], by: int) -> Column:
        """Paths of brothers at or behind a place, and what is below them, move by ``by``."""
        depth = len(place)
        brother = (F.size(col) >= depth) & (F.slice(col, 1, depth - 1) == F.array(*map(F.lit, place[:-1])).cast("array<int>") if depth > 1 else F.size(col) >= depth)
        behind = brother & (F.get(col, F.lit(depth - 1)) >= place[-1])
        return F.when(behind, F.transform(col, lambda x, i: F.when(i == depth - 1, x + by).otherwise(x))).otherwise(col)

    gone = [*source[:-1], source[-1] + 1]
    to = list(target)
    if len(to) >= len(source) and to[: len(source) - 1] == source[:-1] and to[len(source) - 1] > source[-1]:
        to[len(source) - 1] -= 1
    rest = shifted(shifted(path, gone, -1), to, 1)
    moved = F.concat(F.array(*map(F.lit, to)), F.slice(path, len(source) + 1, F.greatest(F.size(path) - len(source), F.lit(0))))
    return bookmarks.withColumn("path", F.when(under(source), moved).otherwise(rest))


def sibling_index(nodes: DataFrame, parent: str = "parent", name: str = "name", order: str = "pos") -> DataFrame:
    """Adds ``index``: the place among brothers of one name, from 0."""
    return nodes.withColumn("index", F.row_number().over(Window.partitionBy(parent, name).orderBy(order)) - 1)


def by_path(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Nodes at the wanted paths (arrays of name and index)."""
    return nodes.join(wanted.select("path").distinct(), "path")


def path_text(path: Column) -> Column:
    """``a[0].b[2]`` of an array of (name, index)."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["name"], F.lit("["), p["index"].cast("string"), F.lit("]"))), ".")


_STEP = re.compile(r"(\.\.|\.)?(\*|[^.\[\]]+)(?:\[(\*|[+-]?\d+)\])?")


def som_pattern(expression: str, here: str = "") -> str:
    """A regular expression over path texts for ``a.b``, ``a..b``, ``[n]``, ``[*]``; [+n] and [-n] go from the place of ``here``'s last node."""
    out, at = "", 0
    own = re.search(r"\[(\d+)\]$", here)
    while at < len(expression):
        m = _STEP.match(expression, at)
        if not m or m.end() == at:
            raise ValueError(f"unexpected {expression[at:]!r}")
        far, name, index = m.groups()
        out += r"\.(?:.*\.)?" if far == ".." else r"\." if out else ""
        out += r"[^.\[]+" if name == "*" else re.escape(name)
        if index == "*" or (index is None and name == "*"):
            out += r"\[\d+\]"
        elif index is None:
            out += r"\[0\]"
        elif index[0] in "+-":
            out += rf"\[{int(own[1]) + int(index) if own else int(index)}\]"
        else:
            out += rf"\[{index}\]"
        at = m.end()
    return "^" + out + "$"


def som_resolve(nodes: DataFrame, expression: str, here: str = "") -> DataFrame:
    """Nodes whose path an expression names."""
    return nodes.where(path_text(F.col("path")).rlike(som_pattern(expression, here)))


def combined_bookmarks(bookmarks: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, title, pos) of page sets that follow each other: one bookmark a source at its first page, the source's own below it.

    ``bookmarks`` has source_no, path (places from 1), title and pos (a page of the source, from 0), ``sources`` source_no,
    title and pages, in order of source_no.  A source without pages has no bookmark, and its places close up; a bookmark of a page
    that its source does not have points nowhere (null).
    """
    order = Window.orderBy("source_no")
    real = sources.where("pages > 0")
    placed = real.select("source_no", "title", "pages", F.row_number().over(order).alias("place"), (F.sum("pages").over(order) - F.col("pages")).cast("long").alias("before"))
    tops = placed.select(F.array("place").alias("path"), "title", F.col("before").alias("pos"))
    there = F.col("pos").between(0, F.col("pages") - 1)
    below = bookmarks.join(placed.select("source_no", "pages", "place", "before"), "source_no").select(F.concat(F.array("place"), "path").alias("path"), "title", F.when(there, F.col("pos") + F.col("before")).cast("long").alias("pos"))
    return tops.unionByName(below)
