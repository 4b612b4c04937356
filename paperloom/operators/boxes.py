"""Boxes on pages: which overlap, what lies inside, and choices that leave no overlap.

Boxes meet by equi-joins on (page, cell of a grid); a pair that shares several cells counts in the cell
of its common corner only.  No page is compared all with all, and no page is gathered but for the
boxes of it that do overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Side of a cell in points, and how far from the origin a page can reach (fixed value of the format: 200 inches).
SIDE, FAR = 72.0, 14_400.0

CORNERS = ("x0", "y0", "x1", "y1")


def _cell(c: Column, side: float) -> Column:
    return F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), c)) / side).cast("int")


def _cells(box: DataFrame, side: float, prefix: str = "") -> DataFrame:
    """Every cell that a box touches, as ``__cx`` and ``__cy``."""
    x0, y0, x1, y1 = (F.col(prefix + c) for c in CORNERS)
    across = box.withColumn("__cx", F.explode(F.sequence(_cell(x0, side), _cell(x1, side))))
    return across.withColumn("__cy", F.explode(F.sequence(_cell(y0, side), _cell(y1, side))))


def _sound(boxes: DataFrame) -> DataFrame:
    """Boxes with four numbers, the lower corner first."""
    return boxes.where(" and ".join(f"{c} is not null and not isnan({c})" for c in CORNERS) + " and x0 <= x1 and y0 <= y1")


def met(left: DataFrame, right: DataFrame, page: list[str], slack: float = 0.0, side: float = SIDE) -> DataFrame:
    """Rows of both sides whose boxes share more than ``slack`` either way; the right side's other columns get the prefix ``r_``."""
    a = _cells(_sound(left), side)
    b = _sound(right).select(*page, *(F.col(c).alias("r_" + c) for c in right.columns if c not in page))
    # What falls apart into cells is larger than its size check says, so neither side is sent whole.
    both = a.hint("merge").join(_cells(b, side, "r_"), [*page, "__cx", "__cy"])
    low = {c: F.greatest(F.col(c), F.col("r_" + c)) for c in ("x0", "y0")}
    high = {c: F.least(F.col(c), F.col("r_" + c)) for c in ("x1", "y1")}
    shared = (high["x1"] - low["x0"] > slack) & (high["y1"] - low["y0"] > slack)
    owned = (F.col("__cx") == _cell(low["x0"], side)) & (F.col("__cy") == _cell(low["y0"], side))
    return both.where(shared & owned).drop("__cx", "__cy")


def overlapping(left: DataFrame, right: DataFrame, page: list[str], slack: float = 0.0, side: float = SIDE) -> DataFrame:
    """(page…, left, right): ids of boxes (page…, id, x0, y0, x1, y1) that share more than ``slack`` either way.

    Boxes with a missing corner or corners in the wrong order overlap nothing.  Pages that are null meet no page.
    """
    found = met(left.select(*page, "id", *CORNERS), right.select(*page, "id", *CORNERS), page, slack, side)
    return found.select(*page, F.col("id").alias("left"), F.col("r_id").alias("right"))


def centred_in(glyphs: DataFrame, boxes: DataFrame, page: list[str], side: float = SIDE) -> DataFrame:
    """The glyphs (page…, x0, y0, x1, y1, …) whose centre lies in a box (page…, id, corners), edges included, with the box's id as ``box``."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    placed = glyphs.withColumn("__cx", _cell(x, side)).withColumn("__cy", _cell(y, side))
    cells = _cells(_sound(boxes).select(*page, F.col("id").alias("box"), *(F.col(c).alias("b" + c) for c in CORNERS)), side, "b")
    met = placed.join(cells.hint("merge"), [*page, "__cx", "__cy"])
    return met.where(x.between(F.col("bx0"), F.col("bx1")) & y.between(F.col("by0"), F.col("by1"))).select(*glyphs.columns, "box")


def box_texts(glyphs: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """(page…, box, text) of boxes with glyphs (page…, i, line, text, space_before, corners): a row of text for each visual line, side-by-side lines parted by tabs.

    Glyphs of a line that do not follow each other by ``i`` are parted by a space, like words.  A line
    goes into the row whose first line its middle falls in.
    """
    inside = centred_in(glyphs, boxes, page)
    order = Window.partitionBy(*page, "box", "line").orderBy("i")
    before = F.lag("i").over(order)
    part = F.when(before.isNotNull() & (F.col("space_before") | (F.col("i") - before > 1)), F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    lines = (
        inside.withColumn("part", part)
        .groupBy(*page, "box", "line")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "part")))["part"], "").alias("piece"), F.min("x0").alias("x"), F.min("y0").alias("top"), F.max("y1").alias("bottom"))
    )
    row = F.struct(((F.col("top") + F.col("bottom")) / 2).alias("middle"), "x", "line", "top", "bottom", "piece")
    listed = lines.groupBy(*page, "box").agg(F.array_sort(F.collect_list(row)).alias("lines"))
    numbered = F.expr("""aggregate(lines, named_struct('top', cast(null as double), 'bottom', cast(null as double), 'row', 0, 'out', cast(array() as array<struct<row:int,x:double,line:bigint,piece:string>>)),
        (s, l) -> if(l.middle between s.top and s.bottom,
            named_struct('top', s.top, 'bottom', s.bottom, 'row', s.row, 'out', array_append(s.out, named_struct('row', s.row, 'x', l.x, 'line', cast(l.line as bigint), 'piece', l.piece))),
            named_struct('top', l.top, 'bottom', l.bottom, 'row', s.row + 1, 'out', array_append(s.out, named_struct('row', s.row + 1, 'x', l.x, 'line', cast(l.line as bigint), 'piece', l.piece)))),
        s -> array_sort(s.out))""")
    joined = F.expr("array_join(transform(cells, (c, k) -> concat(case when k = 0 then '' when cells[k - 1].row = c.row then '\\t' else '\\n' end, c.piece)), '')")
    return listed.withColumn("cells", numbered).select(*page, "box", joined.alias("text"))


def without_overlaps(candidates: DataFrame, taken: DataFrame, page: list[str], order: str = "id", slack: float = 0.0) -> DataFrame:
    """Candidates (page…, id, corners, …) that overlap no taken box and no candidate kept before them by ``order``; ids differ on a page.

    Only candidates that overlap another one are gathered, by page, and decided in order.
    """
    ids = candidates.select(*page, "id")
    blocked = overlapping(candidates, taken, page, slack).select(*page, F.col("left").alias("id")).distinct()
    open_ = candidates.join(blocked, [*page, "id"], "left_anti")
    rank = open_.select(*page, F.col("id").alias("right"), F.col(order).alias("__first"))
    later = open_.select(*page, F.col("id").alias("left"), F.col(order).alias("__then"))
    met = overlapping(open_, open_, page, slack).where("left <> right").join(rank, [*page, "right"]).join(later, [*page, "left"])
    before = met.where(F.struct("__first", "right") < F.struct("__then", "left"))
    crowds = before.groupBy(*page, "left", "__then").agg(F.collect_set("right").alias("earlier"))
    listed = crowds.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("__then", "left", "earlier"))).alias("waiting"))
    # A candidate falls if one that came before it stands: those not waiting stand, so do those that none of theirs has felled.
    kind = ids.schema["id"].dataType.simpleString()
    felled = F.expr(f"aggregate(waiting, cast(array() as array<{kind}>), (gone, w) -> if(exists(w.earlier, e -> not array_contains(gone, e)), array_append(gone, w.left), gone))")
    gone = listed.select(*page, F.explode(felled).alias("id"))
    return open_.join(gone, [*page, "id"], "left_anti")
