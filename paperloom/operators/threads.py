"""Comments: trees of replies, their status, numbers and summaries, and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.sources.storage import written

MAX_HOPS = 64


def thread_tree(comments: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, root, name, depth) of every reply under a comment that replies to none.

    ``comments`` has name and in_reply_to.  Parents are followed at most MAX_HOPS times, doubling
    the reach of every comment's pointer in each of a few rounds, so a chain costs no more rounds than
    its depth has bits; each round is written, so its plan holds one join.  A reply whose chain ends
    nowhere has no root.
    """
    up = comments.where("name is not null").select(F.col(doc), "name", F.col("in_reply_to").alias("parent"))
    reach = up.select(doc, "name", F.coalesce("parent", "name").alias("to"), F.col("parent").isNotNull().cast("int").alias("depth"))
    for _ in range(MAX_HOPS.bit_length() - 1):
        reach = written(reach, "reach")
        far = reach.select(F.col(doc).alias("__d"), F.col("name").alias("__n"), F.col("to").alias("__t"), F.col("depth").alias("__h"))
        reach = reach.join(far, F.col(doc).eqNullSafe(F.col("__d")) & (F.col("to") == F.col("__n")), "left").select(doc, "name", F.coalesce("__t", "to").alias("to"), (F.col("depth") + F.coalesce("__h", F.lit(0))).alias("depth"))
    roots = up.where("parent is null").select(F.col(doc).alias("__d"), F.col("name").alias("root"))
    return reach.where("depth > 0").join(roots, F.col(doc).eqNullSafe(F.col("__d")) & (F.col("to") == F.col("root"))).select(doc, "root", "name", F.col("depth").cast("long").alias("depth"))


def thread_status(threads: DataFrame, marks: tuple[str, ...] = ("Marked", "Unmarked")) -> DataFrame:
    """(doc, root, status, marked, replies) of (doc, root, ord, state) rows: the last state that is no check mark, the last check mark, and replies without a state."""
    mark = F.col("state").isin(*marks)
    return threads.groupBy("doc", "root").agg(
        F.max_by(F.when(~mark, F.col("state")), F.when(~mark, F.col("ord"))).alias("status"),
        F.coalesce(F.max_by(F.when(mark, F.col("state")), F.when(mark, F.col("ord"))) == "Marked", F.lit(False)).alias("marked"),
        F.count_if(F.col("state").isNull()).alias("replies"),
    )


def comment_number(comments: DataFrame, doc: str = "doc", page: str = "page", order: str = "idx") -> DataFrame:
    """Adds ``number``, from 1 on every page."""
    return comments.withColumn("number", F.row_number().over(Window.partitionBy(doc, page).orderBy(order)).cast("long"))


def comment_summary(comments: DataFrame, by: str, page: str = "page", order: str = "idx") -> DataFrame:
    """Comments by page, author, date or type; equals by page and index, missing first."""
    return comments.orderBy(by, page, order)


def upsert(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("page", "name")) -> DataFrame:
    """Incoming comments replace those of their name on the page, pop-ups (named by ``popup_of``) too; unnamed ones append."""
    named = incoming.where("name is not null").select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    same = lambda c: F.col("page").eqNullSafe(F.col("__page")) & (F.col(c) == F.col("__name"))
    kept = existing.join(named, same("name"), "left_anti")
    if "popup_of" in existing.columns:
        kept = kept.join(named, same("popup_of"), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def reply_parents(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds ``parent``: the id of the comment replied to, in the same file first, else in the document by name."""
    own = incoming.where("name is not null").groupBy("file", "name").agg(F.min("id").alias("own")).withColumnsRenamed({"file": "__f", "name": "__n"})
    old = existing.where("name is not null").groupBy("name").agg(F.min("id").alias("old")).withColumnRenamed("name", "__o")
    joined = incoming.join(own, (F.col("file") == F.col("__f")) & (F.col("in_reply_to") == F.col("__n")), "left").join(old, F.col("in_reply_to") == F.col("__o"), "left")
    return joined.withColumn("parent", F.coalesce("own", "old")).drop("__f", "__n", "__o", "own", "old")


def summary_text(comments: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, summary): one line a comment, by page and number."""
    line = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" #"), F.col("number").cast("string"), F.lit(" "), F.coalesce("author", F.lit("")), F.lit(": "), F.coalesce("contents", F.lit("")))
    rows = comment_number(comments, doc).select(doc, "page", "number", line.alias("line"))
    return rows.groupBy(doc).agg(F.array_join(F.array_sort(F.collect_list(F.struct("page", "number", "line")))["line"], "\n").alias("summary"))
