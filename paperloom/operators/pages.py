"""Page sets: select, extract, combine, split, reorder, label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import numeral
from paperloom.plans.ranges import select_pages


def extract(pages: DataFrame, chosen: list[int]) -> DataFrame:
    """The pages at the given positions, in that order, repeats and all; ``pos`` is the new place.  The list is a user's, the pages may be many."""
    spark = pages.sparkSession
    wanted = spark.createDataFrame([(i, p) for i, p in enumerate(chosen)], "new long, pos long")
    return pages.join(wanted, "pos").drop("pos").withColumnRenamed("new", "pos")


def page_select(pages: DataFrame, text: str, subset: str = "all", reverse: bool = False, labels: list[str] | None = None) -> DataFrame:
    return extract(pages, select_pages(pages.count(), text, labels, subset, reverse))


def combine(*sources: DataFrame) -> DataFrame:
    """One page set after the other; ``source_no`` tells them apart and ``pos`` runs through."""
    tagged = [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    sizes = out.groupBy("source_no").agg((F.max("pos") + 1).alias("n"))
    before = sizes.select("source_no", (F.sum("n").over(Window.orderBy("source_no")) - F.col("n")).alias("before"))
    return out.join(F.broadcast(before), "source_no").withColumn("pos", F.col("pos") + F.col("before")).drop("before")


def split_every(pos: Column, n: int) -> Column:
    return F.floor(pos / n)


def split_before(pos: Column, cuts: list[int], count: int) -> Column:
    """The part a page is in, by cuts before given pages; those outside and repeats count once or not at all."""
    real = sorted({c for c in cuts if 0 < c < count})
    return sum(((pos >= c).cast("int") for c in real), F.lit(0)).cast("long")


def move(pages: DataFrame, moved: list[int], to: int) -> DataFrame:
    """The moved pages, in their order, go before the page that was at ``to``; positions are 0, 1, 2 ... and each new one is arithmetic."""
    there = {r["pos"] for r in pages.where(F.col("pos").isin(moved)).select("pos").distinct().collect()}
    gone = [p for p in dict.fromkeys(moved) if p in there]
    stays = F.col("pos") - sum(((F.col("pos") > g).cast("long") for g in gone), F.lit(0)) + F.when(F.col("pos") >= to, len(gone)).otherwise(0)
    begin, new = to - sum(g < to for g in gone), F.when(F.lit(False), F.lit(0))
    for turn, g in enumerate(gone):
        new = new.when(F.col("pos") == g, begin + turn)
    return pages.withColumn("pos", new.otherwise(stays).cast("long"))


def reverse(pages: DataFrame) -> DataFrame:
    last = pages.agg(F.max("pos").alias("last"))
    return pages.crossJoin(F.broadcast(last)).withColumn("pos", F.col("last") - F.col("pos")).drop("last")


def delete(pages: DataFrame, gone: list[int]) -> DataFrame:
    """Without the pages; the others close up."""
    before = sum(((F.col("pos") > g).cast("long") for g in sorted(set(gone))), F.lit(0))
    return pages.where(~F.col("pos").isin(gone)).withColumn("pos", F.col("pos") - before)


def insert(pages: DataFrame, new: DataFrame, at: int) -> DataFrame:
    n = new.count()
    shifted = pages.withColumn("pos", F.col("pos") + F.when(F.col("pos") >= at, n).otherwise(0))
    return shifted.unionByName(new.withColumn("pos", F.col("pos") + at), allowMissingColumns=True)


def replace(pages: DataFrame, new: DataFrame, at: int) -> DataFrame:
    """Pages from ``at`` on become the new ones, as many as those are."""
    fresh = new.withColumn("pos", F.col("pos") + at)
    return pages.join(fresh.select("pos"), "pos", "left_anti").unionByName(fresh, allowMissingColumns=True)


def rotate_filter(page_no: Column, width: Column, height: Column, subset: str = "all", orientation: str = "all") -> Column:
    """Even or odd page numbers (1-based), landscape or portrait."""
    keep = F.lit(True)
    if subset != "all":
        keep &= page_no % 2 == (0 if subset == "even" else 1)
    if orientation != "all":
        keep &= (width > height) if orientation == "landscape" else (width <= height)
    return keep


def page_labels(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds ``label``: prefix and numeral of the last range (start, style, prefix, first) at or before the page; without one, or empty, the page number."""
    rules = F.broadcast(ranges.withColumnRenamed("start", "range_start"))
    hit = pages.join(rules, F.col("pos") >= F.col("range_start"), "left")
    last = hit.groupBy("pos").agg(F.max_by(F.struct("range_start", "style", "prefix", "first"), "range_start").alias("r"))
    number = F.col("r.first") + F.col("pos") - F.col("r.range_start")
    text = F.concat(F.coalesce(F.col("r.prefix"), F.lit("")), numeral(F.col("r.style"), number))
    label = F.when(F.col("r").isNull() | (text == "") | (F.length(text) > 1024), (F.col("pos") + 1).cast("string")).otherwise(text)
    return pages.join(last.select("pos", label.alias("label")), "pos")
