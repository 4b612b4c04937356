"""Redaction: where personal data stand in a text, what covers them, and a report of what went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.coerce import UNICODE_SPACE, let
from paperloom.functions.text import PATTERNS, candidates, collapsed, pieces, real

MARK = "█"


_FOUND = "array<struct<kind:string,start:bigint,end:bigint,hit:string>>"


def _placed(cut: Column, runs: Column, kind: str) -> Column:
    """The hits among the pieces of a text with single spaces, with their places in the text as it is; ``runs`` has what each space stands for beyond one character."""

    def onward(s: Column, p: Column) -> Column:
        chars, blanks = F.length(p["text"]), F.length(p["text"]) - F.length(F.replace(p["text"], F.lit(" "), F.lit("")))
        step = F.struct((s["at"] + chars + F.aggregate(F.slice(runs, s["k"] + 1, blanks), F.lit(0), lambda n, x: n + x)).alias("at"), (s["k"] + blanks).alias("k"))
        hit = lambda e: F.struct(F.lit(kind).alias("kind"), s["at"].alias("start"), e["at"].alias("end"), p["text"].alias("hit"))
        return let(step, lambda e: F.struct(e["at"].alias("at"), e["k"].alias("k"), F.when(p["hit"], F.array_append(s["out"], hit(e))).otherwise(s["out"]).alias("out")))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("k"), F.array().cast(_FOUND).alias("out"))
    return F.aggregate(cut, begin, onward, lambda s: s["out"])


def spans(docs: DataFrame, kinds: tuple[str, ...] = tuple(PATTERNS), key: str = "doc_id") -> DataFrame:
    """(key, kind, start, end, hit) of personal data in (key, text) rows, in characters of the text as it is.

    Patterns see white space as one space, as they do in :func:`pii_hits`; places are those of the whole
    text.  A null text has none.  Everything is a projection: a text is read once for each pattern, and
    cut only where it has hits.
    """

    def of_kind(seen: Column, kind: str) -> Column:
        runs = F.when(F.length(seen) < F.length("text"), F.transform(F.regexp_extract_all("text", F.lit(f"{UNICODE_SPACE}+"), F.lit(0)), lambda x: F.length(x) - 1)).otherwise(F.array().cast("array<int>"))
        placed = lambda found: let(runs, lambda r: _placed(pieces(seen, kind, found), r, kind))
        return let(candidates(seen, kind), lambda found: F.when(F.exists(found, lambda x: real(kind, x)), placed(found)).otherwise(F.array().cast(_FOUND)))

    found = let(collapsed(F.col("text")), lambda seen: F.concat(*(of_kind(seen, kind) for kind in kinds)))
    # An outer explode, so that no filter on what it takes searches the texts a second time.
    each = docs.where("text is not null").select(key, F.explode_outer(found).alias("__f")).where("__f is not null")
    return each.select(key, "__f.kind", "__f.start", "__f.end", "__f.hit")


def marks(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end): the union of spans (key, start, end); spans that only touch stay two."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = found.select(key, "start", "end", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int").alias("__new"))
    numbered = begun.withColumn("__nr", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "__nr").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__nr")


def redacted(docs: DataFrame, found: DataFrame, key: str = "doc_id", mark: str = MARK) -> DataFrame:
    """``docs`` with the marked characters of ``text`` covered, one mark each, and all others as they were."""
    listed = marks(found, key).groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__marks"))
    covered = F.expr(f"""aggregate(__marks, named_struct('at', 0L, 'out', ''),
        (s, m) -> named_struct('at', m.end, 'out', concat(s.out, substr(text, cast(s.at + 1 as int), cast(m.start - s.at as int)), repeat('{mark}', cast(m.end - m.start as int)))),
        s -> concat(s.out, substr(text, cast(s.at + 1 as int))))""")
    return docs.join(listed, F.col(key) == F.col("__key"), "left").withColumn("text", F.when(F.col("__marks").isNull(), F.col("text")).otherwise(covered)).select(*docs.columns)


def redaction_report(found: DataFrame, key: str = "doc_id", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """(key, one count a kind, marks, chars) of texts with spans: hits by kind, marks after their union, characters covered."""
    hits = found.groupBy(key).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    gone = marks(found, key).groupBy(key).agg(F.count("*").alias("marks"), F.sum(F.col("end") - F.col("start")).alias("chars"))
    return hits.join(gone, key)


def redaction_totals(report: DataFrame, kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """One row: texts with marks, marks, characters, and hits by kind."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("marks", "chars", *kinds)]
    return report.agg(F.count("*").alias("texts"), *sums)
