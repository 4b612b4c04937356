"""Lines, words, paragraphs, orders and fields from positioned text (y grows downwards)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from paperloom.operators.boxes import CORNERS, met


def in_rectangle(x0: Column, y0: Column, x1: Column, y1: Column, box: tuple[float, float, float, float]) -> Column:
    """Glyphs whose centre lies in the box."""
    return ((x0 + x1) / 2).between(box[0], box[2]) & ((y0 + y1) / 2).between(box[1], box[3])


def line_segments(glyphs: DataFrame, *page: str) -> DataFrame:
    """Adds ``line``: consecutive glyphs (by i) go on while their centre is within half the height, the gap under three and the step back at most two heights."""
    w = Window.partitionBy(*page).orderBy("i")
    height = F.col("y1") - F.col("y0")
    before = lambda c: F.lag(c).over(w)
    mid = (F.col("y0") + F.col("y1")) / 2
    off = F.abs(mid - (before("y0") + before("y1")) / 2)
    gap = F.col("x0") - before("x1")
    broken = before("i").isNotNull() & ((off >= height / 2) | (gap >= 3 * height) | (gap < -2 * height))
    return glyphs.withColumn("__b", broken.cast("int")).withColumn("line", F.sum("__b").over(w).cast("long")).drop("__b")


#: Scripts by code points (fixed values): written without spaces, with signs apart from their letters, from right to left.
SPACELESS = r"[\x{1100}-\x{11FF}\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{3134F}]"
CLUSTERED = r"[\x{0300}-\x{036F}\x{0900}-\x{0DFF}\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}]"
RIGHT_TO_LEFT = r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}\x{10800}-\x{10FFF}\x{1E800}-\x{1EFFF}]"
#: In heights: a word's gap beyond the typical one, and below what no gap parts two spaceless characters or a cluster.
WORD, TIGHT, CLUSTER = 0.15, 0.5, 0.6


def _beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) > F.length(text)


def _written(text: Column, script: str) -> Column:
    return _beyond_ascii(text) & text.rlike(script)


def _blank(text: Column) -> Column:
    return (F.btrim(text, F.lit(" \t\n\x0b\f\r")) == "") | (_beyond_ascii(text) & ~text.rlike(r"[^\s\p{Z}]"))


def word_breaks(glyphs: DataFrame, *line: str) -> DataFrame:
    """Adds ``space_before``: from left to right, the gap exceeds the line's typical one (at a third of the sorted gaps) by 0.15 heights.

    Characters of scripts without spaces are parted from half a height only, signs of clusters from 0.6, blanks never.  The
    space stands before the one of the two that is drawn later (by i), which in text from right to left is the left one.
    """
    w = Window.partitionBy(*line).orderBy("x0", "i")
    text, height = F.col("text"), F.col("y1") - F.col("y0")
    gap = F.col("x0") - F.lag("x1").over(w)
    both = lambda c: c & F.lag(c).over(w)
    either = lambda c: c | F.lag(c).over(w)
    spaceless, clustered, blank = _written(text, SPACELESS), _written(text, CLUSTERED), _blank(text)
    tight = (both(spaceless) & (gap < TIGHT * height)) | (either(clustered) & (gap < CLUSTER * height)) | either(blank)
    gaps = glyphs.withColumn("__g", gap).withColumn("__c", tight)
    # A third and a little: the value at n // 3 of the n sorted gaps.
    typical = F.expr("percentile_disc(0.3333334) WITHIN GROUP (ORDER BY __g)").over(Window.partitionBy(*line))
    told = gaps.withColumn("__t", F.coalesce(typical, F.lit(0.0)))
    wide = (F.col("__g") > F.greatest(F.col("__t"), F.lit(0.0)) + WORD * height) & ~F.col("__c")
    told = told.withColumn("__w", F.coalesce(wide, F.lit(False)))
    own = F.col("__w") & (F.col("i") > F.lag("i").over(w))
    left = F.lead("__w").over(w) & (F.col("i") > F.lead("i").over(w))
    return told.withColumn("space_before", F.coalesce(own, F.lit(False)) | F.coalesce(left, F.lit(False))).drop("__g", "__c", "__t", "__w")


def logical_order(glyphs: DataFrame, *line: str) -> DataFrame:
    """Adds ``at``, a glyph's place in its line as it is read, from 0: from left to right, but runs of right-to-left script (single blanks inside included) turned around."""
    w = Window.partitionBy(*line).orderBy("x0", "i")
    strong = _written(F.col("text"), RIGHT_TO_LEFT)
    placed = glyphs.withColumn("__n", F.row_number().over(w) - 1).withColumn("__s", strong)
    inside = F.col("__s") | (_blank(F.col("text")) & F.coalesce(F.lag("__s").over(w) & F.lead("__s").over(w), F.lit(False)))
    turned = placed.withColumn("__r", inside)
    runs = turned.withColumn("__k", F.sum(F.coalesce((F.col("__r") != F.lag("__r").over(w)).cast("int"), F.lit(0))).over(w))
    run = Window.partitionBy(*line, "__k")
    at = F.when(F.col("__r"), F.min("__n").over(run) + F.max("__n").over(run) - F.col("__n")).otherwise(F.col("__n"))
    return runs.withColumn("at", at.cast("long")).drop("__n", "__s", "__r", "__k")


def arrow_types(df: DataFrame, page: list[str], schema: str) -> pa.Schema:
    """The Arrow schema of (page…, schema)."""
    return to_arrow_schema(StructType([*(df.schema[p] for p in page), *_parse_datatype_string(schema).fields]))


def _page_tables(df: DataFrame, page: list[str], order: list[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """(page…, schema) of ``fn`` over whole pages in order, with the places where pages begin: what it tells depends on the page's order.

    A window sorts the pages where they are, so rows that are dealt by page are not shuffled; a task holds
    a batch and what it has seen of one page.
    """
    types = StructType([*(df.schema[p] for p in page), *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(types)
    marked = df.withColumn("__first", F.row_number().over(Window.partitionBy(*page).orderBy(*order)) == 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            if not whole.num_rows:
                return []
            first = whole["__first"].to_numpy()
            return fn(whole.drop_columns("__first"), np.flatnonzero(first)).select(arrow.names).cast(arrow).to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            first = np.flatnonzero(batch.column(batch.schema.get_field_index("__first")).to_numpy(zero_copy_only=False))
            if len(first):
                yield from told([*held, batch.slice(0, int(first[-1]))])
                held = [batch.slice(int(first[-1]))]
            else:
                held.append(batch)
        if held:
            yield from told(held)

    return marked.mapInArrow(run, types)


def _each_page(df: DataFrame, page: list[str], order: list[str], fn: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """:func:`_page_tables` of ``fn`` over the rows of one page after the other."""
    types = arrow_types(df, page, schema)

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        rows, out = table.to_pylist(), []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
            head = tuple(rows[a][p] for p in page)
            out += [(*head, *r) for r in fn(rows[a:b])]
        columns = zip(*out, strict=True) if out else [()] * len(types)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    return _page_tables(df, page, order, run, schema)


def paragraphs(lines: DataFrame, page: list[str]) -> DataFrame:
    """(page…, para, text): lines (line, text, x0, y0, size, style) of one look go on while left-aligned, with a leading of 0.8 to 2.5 sizes that stays within a fifth of the first; a hyphen at a line's end goes."""

    def run(rows: list[dict]) -> list[tuple]:
        out, first_gap, last = [], None, None
        for r in rows:
            gap = r["y0"] - last["y0"] if last else None
            goes_on = (
                last is not None
                and (r["size"], r["style"]) == (last["size"], last["style"])
                and abs(r["x0"] - last["x0"]) <= r["size"]
                and 0.8 * r["size"] <= gap <= 2.5 * r["size"]
                and (first_gap is None or abs(gap - first_gap) <= 0.2 * first_gap)
            )
            if goes_on:
                first_gap = first_gap or gap
                text = out[-1]
                out[-1] = text[:-1] + r["text"] if text.endswith("-") and len(text) > 1 and text[-2].isalpha() else text + " " + r["text"]
            else:
                out.append(r["text"])
                first_gap = None
            last = r
        return list(enumerate(out))

    return _each_page(lines, page, ["line"], run, "para long, text string")


#: How many characters back a redrawn one is looked for, and how far it may be off, in heights (fixed values).
BACK, OFF = 4, 0.2


def undoubled(text: np.ndarray, x0: np.ndarray, y0: np.ndarray, y1: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which glyphs stay, see :func:`without_doubles`; equal texts are equal numbers, pages begin at ``starts``."""
    n = len(text)
    here = np.arange(n)
    begun = np.repeat(starts, np.diff(np.r_[starts, n]))
    near = np.maximum(y1 - y0, 0.1) * OFF
    pairs = []
    for back in range(1, BACK + 1):
        at = np.flatnonzero((text[back:] == text[:-back]) & (np.abs(x0[back:] - x0[:-back]) < near[back:]) & (np.abs(y0[back:] - y0[:-back]) < near[back:])) + back
        at = at[here[at] - back >= begun[at]]
        pairs.append((at, at - back))
    at, was = (np.concatenate(p) for p in zip(*pairs, strict=True))
    # What stays is told from the front: each turn settles those whose doubles are settled.
    stays = np.ones(n, bool)
    while True:
        now = np.ones(n, bool)
        now[at[stays[was]]] = False
        if (now == stays).all():
            return stays
        stays = now


def without_doubles(glyphs: DataFrame, page: list[str]) -> DataFrame:
    """(page…, i, text, x0, y0, x1, y1) of the glyphs that are not drawn a second time to look bold: the same text, close to one of the last four before it that stays."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        text = table["text"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        return table.filter(pa.array(undoubled(text, *(table[c].to_numpy() for c in ("x0", "y0", "y1")), starts)))

    return _page_tables(glyphs, page, ["i"], run, "i long, text string, x0 double, y0 double, x1 double, y1 double")


def headings(lines: DataFrame, body: DataFrame, key: str) -> DataFrame:
    """Adds ``level``: 1 from 1.6 times the body size, 2 from 1.25 or for a short bold line, else null."""
    joined = lines.join(body.withColumnRenamed("size", "__body"), key)
    ratio = F.col("size") / F.col("__body")
    level = F.when(ratio >= 1.6, 1).when((ratio >= 1.25) | (F.col("bold") & (F.length("text") <= 80)), 2)
    return joined.withColumn("level", level).drop("__body")


def tab_order(fields: DataFrame, page: list[str], mode: str = "row") -> DataFrame:
    """(page…, name, rank): rows group by the top edge within half the height of their first member (2 points at least), columns by the left edge."""
    major, minor, far = ("y0", "x0", "y1") if mode == "row" else ("x0", "y0", "x1")

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        top, side, end = (table[c].to_numpy() for c in (major, minor, far))
        sizes = np.diff(np.r_[starts, table.num_rows])
        longest = np.argsort(-sizes, kind="stable")
        starts, waiting = starts[longest], np.searchsorted(-sizes[longest], -np.arange(sizes.max()), side="left")
        group, lead = np.zeros(table.num_rows, np.int64), starts.copy()
        for k, n in enumerate(waiting.tolist()):  # the fields at one place of all pages that have so many
            at, led = starts[:n] + k, lead[:n]
            fresh = top[at] - top[led] > np.maximum(2.0, (end[led] - top[led]) / 2)
            group[at] = fresh
            led[fresh] = at[fresh]
        first = np.zeros(table.num_rows, np.int64)
        first[starts] = 1
        group = np.cumsum(group | first)
        order = np.lexsort((side, group))
        rank = np.arange(table.num_rows) - np.maximum.accumulate(np.where(first == 1, np.arange(table.num_rows), 0))
        return table.take(pa.array(order)).append_column("rank", pa.array(rank))

    return _page_tables(fields, page, [major, minor], run, "name string, rank long")


def reading_order(blocks: DataFrame, page: list[str]) -> DataFrame:
    """(page…, block, rank): the topmost block left, or a left neighbour that overlaps it by over half its height."""

    def run(rows: list[dict]) -> list[tuple]:
        left, order = rows, []
        while left:
            pick = left[0]
            while beside := [r for r in left if r["x1"] <= pick["x0"] and min(r["y1"], pick["y1"]) - max(r["y0"], pick["y0"]) > 0.5 * min(r["y1"] - r["y0"], pick["y1"] - pick["y0"])]:
                pick = min(beside, key=itemgetter("x0", "y0"))
            order.append(pick["block"])
            left.remove(pick)
        return [(b, i) for i, b in enumerate(order)]

    return _each_page(blocks, page, ["y0", "x0"], run, "block long, rank long")


#: How far to the left and above a label is looked for (fixed values).
REACH, RISE = 250.0, 24.0


def field_labels(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """(page, box, label): words on the box's line to its left (within 250, gaps up to 24), else the line above (under 24).

    Words meet the area around a box by cells of the page, not all of its words.
    """
    around = boxes.select("page", "box", *(F.col(c).alias("b" + c) for c in CORNERS), (F.col("x0") - REACH - 1).alias("x0"), (F.col("y0") - RISE - 1).alias("y0"), (F.greatest("x1", F.col("x0") + 1) + 1).alias("x1"), (F.col("y1") + RISE).alias("y1"))
    near = met(around, words.select("page", "text", *CORNERS), ["page"]).select("page", "box", F.col("r_text").alias("text"), *(F.col("b" + c).alias(c) for c in CORNERS), *(F.col("r_" + c).alias("w" + c) for c in CORNERS))
    middle = (F.col("wy0") + F.col("wy1")) / 2
    left = near.where(middle.between(F.col("y0"), F.col("y1")) & (F.col("wx1") <= F.col("x0") + 1) & (F.col("x0") - F.col("wx0") <= REACH))
    order = Window.partitionBy("page", "box").orderBy(F.col("wx1").desc())
    gap = F.coalesce(F.lag("wx0").over(order), F.col("x0")) - F.col("wx1")
    chain = left.withColumn("far", (gap > RISE).cast("int")).withColumn("off", F.sum("far").over(order)).where("off = 0")
    by_left = chain.groupBy("page", "box").agg(F.array_join(F.array_sort(F.collect_list(F.struct("wx0", "text")))["text"], " ").alias("left"))
    above = near.where((F.col("wy1") <= F.col("y0")) & (F.col("y0") - F.col("wy1") < RISE) & (F.col("wx0") < F.col("x1")) & (F.col("wx1") > F.col("x0")))
    by_above = above.groupBy("page", "box").agg(F.array_join(F.array_sort(F.collect_list(F.struct("wy0", "wx0", "text")))["text"], " ").alias("above"))
    return boxes.select("page", "box").join(by_left.hint("merge"), ["page", "box"], "left").join(by_above.hint("merge"), ["page", "box"], "left").select("page", "box", F.coalesce("left", "above").alias("label"))


def words(glyphs: DataFrame, *line: str, order: str = "i") -> DataFrame:
    """(line…, word, text, x0, y0, x1, y1) of glyphs with ``space_before``; runs of underscores are words of their own."""
    w = Window.partitionBy(*line).orderBy(order)
    rule = F.col("text") == "_"
    starts = F.col("space_before") | (rule != F.lag(rule).over(w))
    numbered = glyphs.withColumn("word", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w).cast("long"))
    joined = F.array_join(F.array_sort(F.collect_list(F.struct(order, "text")))["text"], "")
    return numbered.groupBy(*line, "word").agg(joined.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


#: How many times more a distance up or down counts, so that a point's own line is preferred (fixed value).
STEEP = 3.0


def nearest_glyph(glyphs: DataFrame, points: DataFrame, page: list[str] | None = None) -> DataFrame:
    """(page…, point, i): the glyph whose box is nearest to each point (page…, point, x, y), across plus three times up or down; the first of equals."""
    page = page or ["page"]
    near = glyphs.join(points.hint("merge"), page)
    outside = lambda low, p, high: F.greatest(F.col(low) - F.col(p), F.col(p) - F.col(high), F.lit(0.0))
    away = outside("x0", "x", "x1") + STEEP * outside("y0", "y", "y1")
    return near.groupBy(*page, "point").agg(F.min_by("i", F.struct(away.alias("d"), F.col("i"))).alias("i"))


def around_glyph(words_of: DataFrame, picks: DataFrame, page: list[str]) -> DataFrame:
    """(page…, pick, word_first, word_last, line_first, line_last): the word and the line around picked glyphs (page…, pick, i), as first and last glyph.

    ``words_of`` has page…, i, text, line and space_before of every glyph.  A word stops at blanks, too; around a blank are the words that touch it.
    """
    order = Window.partitionBy(*page, "line").orderBy("i")
    blank, before = _blank(F.col("text")), F.lag(_blank(F.col("text"))).over(order)
    parted = F.col("space_before") | F.coalesce(blank | before, F.lit(False))
    numbered = words_of.select(*page, "i", "line", "space_before", blank.alias("blank"), F.sum(parted.cast("int")).over(order).alias("word"))
    line, word = Window.partitionBy(*page, "line"), Window.partitionBy(*page, "line", "word")
    told = numbered.select(*page, "i", "line", "space_before", "blank", *(f("i").over(w).alias(f"{n}_{e}") for n, w in (("word", word), ("line", line)) for e, f in (("first", F.min), ("last", F.max))))
    joins_left = F.col("blank") & ~F.col("space_before") & ~F.lag("blank").over(order)
    joins_right = F.col("blank") & ~F.lead("space_before").over(order) & ~F.lead("blank").over(order)
    first = F.when(joins_left, F.lag("word_first").over(order)).otherwise(F.col("word_first")).alias("word_first")
    last = F.when(joins_right, F.lead("word_last").over(order)).otherwise(F.col("word_last")).alias("word_last")
    return picks.select(*page, "pick", "i").hint("merge").join(told.select(*page, "i", first, last, "line_first", "line_last"), [*page, "i"]).drop("i")


def picked_boxes(glyphs: DataFrame, picks: DataFrame, page: list[str]) -> DataFrame:
    """(page…, pick, line, first, last, x0, y0, x1, y1): one box for each run of picked glyphs (page…, pick, i) that follow one another on a line; a glyph picked twice counts once.

    ``glyphs`` has page…, i, line and the corners; ``i`` counts without holes over those that a run goes over.
    """
    chosen = glyphs.select(*page, "i", "line", *CORNERS).join(picks.select(*page, "pick", "i").distinct().hint("merge"), [*page, "i"])
    key = [*page, "pick", "line"]
    run = (F.col("i") - F.row_number().over(Window.partitionBy(*key).orderBy("i"))).alias("run")
    union = [F.min("i").alias("first"), F.max("i").alias("last"), *(f(c).alias(c) for c, f in zip(CORNERS, (F.min, F.min, F.max, F.max), strict=True))]
    return chosen.select("*", run).groupBy(*key, "run").agg(*union).drop("run")
