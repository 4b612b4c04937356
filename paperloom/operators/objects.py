"""Objects that refer to each other: newest revisions, chains of references, attributes that pages inherit.

Pointers are followed by doubling: each round joins every pointer with the one it has reached, so a chain
costs as many joins as its length has bits.  Rounds are written; a plan holds one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.sources.storage import written

#: Points of a page whose box is missing or without area (fixed value).
SHEET = (612.0, 792.0)


def newest(objects: DataFrame, doc: str = "doc") -> DataFrame:
    """The object of each number with the latest revision (the highest generation among equals), unless that one frees the number.

    ``objects`` has num, rev, gen and free.  Rows without a document or a number are left out; of rows equal in all of these one stays.
    """
    rest = [c for c in objects.columns if c not in (doc, "num")]
    latest = objects.where(F.col(doc).isNotNull() & F.col("num").isNotNull()).groupBy(doc, "num").agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("rev", F.lit(-1)), F.coalesce("gen", F.lit(-1)))).alias("o"))
    return latest.select(doc, "num", *(F.col(f"o.{c}").alias(c) for c in rest)).where("not coalesce(free, false)")


def _rounds(nodes: DataFrame, doc: str) -> int:
    """Rounds after which every chain without a cycle has ended: the bits of the largest document."""
    most = nodes.groupBy(doc).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return int(most).bit_length()


def resolved(objects: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, num, end, hops, state, value): where the references of every newest object lead.

    ``objects`` has num, rev, gen, free, to and to_gen (what it refers to) and value (of those that refer to
    nothing).  state is "value" at an object that refers to nothing, "dangling" where the next object is
    missing, freed or of another generation (``end`` is its number), else "cycle" without end and hops.
    """
    live = written(newest(objects, doc).select(doc, "num", "gen", "to", F.coalesce("to_gen", F.lit(0)).alias("to_gen"), "value"), "objects")
    there = live.select(F.col(doc).alias("__d"), F.col("num").alias("__n"), F.coalesce("gen", F.lit(0)).alias("__g"))
    first = live.join(there, (F.col(doc) == F.col("__d")) & (F.col("to") == F.col("__n")) & (F.col("to_gen") == F.col("__g")), "left")
    kind = F.when(F.col("to").isNull(), "value").when(F.col("__n").isNull(), "dangling")
    state = written(first.select(doc, "num", F.coalesce("__n", "num").alias("at"), F.col("__n").isNotNull().cast("long").alias("hops"), kind.alias("state"), F.when(F.col("__n").isNull(), F.col("to")).alias("miss"), "value"), "reach")
    for _ in range(_rounds(live, doc)):
        if state.where("state is null").isEmpty():
            break
        ends = state.select(F.col(doc).alias("__d"), F.col("num").alias("__n"), *(F.col(c).alias("__" + c) for c in ("at", "hops", "state", "miss", "value")))
        going = state.where("state is null").join(ends, (F.col(doc) == F.col("__d")) & (F.col("at") == F.col("__n")))
        onward = going.select(doc, "num", F.col("__at").alias("at"), (F.col("hops") + F.col("__hops")).alias("hops"), F.col("__state").alias("state"), F.col("__miss").alias("miss"), F.col("__value").alias("value"))
        state = written(state.where("state is not null").unionByName(onward), "reach")
    open_ = F.col("state").isNull()
    dangling = F.col("state") == "dangling"
    return state.select(
        doc, "num", F.when(dangling, F.coalesce("miss", "at")).when(~open_, F.col("at")).alias("end"), F.when(~open_, F.col("hops")).alias("hops"), F.coalesce("state", F.lit("cycle")).alias("state"), F.when(F.col("state") == "value", F.col("value")).alias("value")
    )


def inherited(nodes: DataFrame, attributes: list[str], doc: str = "doc") -> DataFrame:
    """(doc, num, path, attributes…) of the nodes (num, parent, pos, attributes…) of trees: each attribute as the nearest node above, or the node itself, sets it.

    ``path`` holds the places (pos) from the root down.  A node is in a tree if its chain of parents ends at
    a node without a parent; those below a missing node or in a cycle are left out.
    """
    state = written(nodes.select(doc, "num", F.col("parent").alias("up"), F.array("pos").alias("path"), *attributes), "tree")
    for _ in range(_rounds(nodes, doc)):
        if state.where("up is not null").isEmpty():
            break
        above = state.select(F.col(doc).alias("__d"), F.col("num").alias("__n"), F.col("up").alias("__up"), F.col("path").alias("__path"), *(F.col(a).alias("__" + a) for a in attributes))
        going = state.where("up is not null").join(above, (F.col(doc) == F.col("__d")) & (F.col("up") == F.col("__n")))
        onward = going.select(doc, "num", F.col("__up").alias("up"), F.concat("__path", "path").alias("path"), *(F.coalesce(F.col(a), F.col("__" + a)).alias(a) for a in attributes))
        state = written(state.where("up is null").unionByName(onward), "tree")
    return state.where("up is null").drop("up")


def turned(rotate: Column) -> Column:
    """Quarter turns as 0, 90, 180 or 270; what is no quarter turn is none."""
    return F.when(F.coalesce(rotate, F.lit(0)) % 90 == 0, F.pmod(F.coalesce(rotate, F.lit(0)), F.lit(360))).otherwise(0)


def page_table(nodes: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, page, num, x0, y0, x1, y1, rotation, width, height) of the pages of trees, numbered from 1 in tree order.

    ``nodes`` has num, parent, pos, leaf, and what may be inherited: media and crop (boxes of four numbers,
    corners in any order) and rotate.  The visible box is the crop's part of the medium; without area it is a
    plain sheet.  Width and height are those of the turned page.
    """
    found = inherited(nodes, ["media", "crop", "rotate"], doc).join(nodes.where("leaf").select(F.col(doc).alias("__d"), F.col("num").alias("__n")), (F.col(doc) == F.col("__d")) & (F.col("num") == F.col("__n")))
    sheet = F.array(F.lit(0.0), F.lit(0.0), *map(F.lit, SHEET))
    ordered = lambda b: F.array(F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3]))
    media = ordered(F.coalesce("media", sheet))
    crop = ordered(F.coalesce("crop", "media", sheet))
    shown = F.array(F.greatest(media[0], crop[0]), F.greatest(media[1], crop[1]), F.least(media[2], crop[2]), F.least(media[3], crop[3]))
    boxed = found.withColumn("b", shown).withColumn("b", F.when((F.col("b")[2] - F.col("b")[0] >= 1) & (F.col("b")[3] - F.col("b")[1] >= 1), F.col("b")).otherwise(sheet)).withColumn("rotation", turned(F.col("rotate")).cast("long"))
    wide, high, aside = F.col("b")[2] - F.col("b")[0], F.col("b")[3] - F.col("b")[1], F.col("rotation") % 180 == 90
    page = F.row_number().over(Window.partitionBy(doc).orderBy("path", "num")).cast("long")
    return boxed.select(doc, page.alias("page"), "num", *(F.col("b")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))), "rotation", F.when(aside, high).otherwise(wide).alias("width"), F.when(aside, wide).otherwise(high).alias("height"))
