"""Form data: long (doc, name, value) tables, imports onto fields, merges into spreadsheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.coerce import let
from paperloom.functions.text import truth
from paperloom.sources.storage import written


def from_json(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, name, pos, value) of the members of a JSON object, in the order of the text."""
    entries = F.map_entries(F.from_json(column, "map<string,string>"))
    return rows.select(key, F.posexplode(entries).alias("pos", "e")).select(key, F.col("e.key").alias("name"), "pos", F.col("e.value").alias("value"))


def form_apply(fields: DataFrame, data: DataFrame) -> DataFrame:
    """(doc, name, kind, value, applied) of imported values on fields of their full name.

    Unknown names are skipped.  A check box takes a true value as Yes and any other as Off; radios
    and choices take what their options hold (``options`` null holds all), else nothing is applied; buttons
    and signatures take nothing; read-only fields still take the data.
    """
    joined = fields.join(data.select(F.col("doc").alias("__d"), F.col("name").alias("__n"), F.col("value").alias("new")), F.col("doc").eqNullSafe(F.col("__d")) & (F.col("name") == F.col("__n")))
    listed = F.col("options").isNull() | F.array_contains("options", F.col("new"))
    value = F.when(F.col("kind") == "check", F.when(truth(F.col("new")), "Yes").otherwise("Off")).when(F.col("kind").isin("radio", "choice"), F.when(listed, F.col("new"))).when(F.col("kind") == "text", F.col("new"))
    return joined.select("doc", "name", "kind", value.alias("value"), value.isNotNull().alias("applied"))


def group_lookup(fields: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc, wanted, name, value): a name stands for its field or, for a group, all below it.

    Every field offers its dotted ancestors, so the lookup is an equi-join.
    """
    parts = F.split("name", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    offered = fields.select("doc", "name", "value", F.explode(above).alias("wanted"))
    return offered.join(groups.select("wanted").distinct(), "wanted").select("doc", "wanted", "name", "value")


def exportable(kind: Column) -> Column:
    return ~kind.isin("button", "signature")


def flag(flags: Column, bit: int) -> Column:
    """Whether a field's flag (1-based bit) is set."""
    return flags.bitwiseAND(1 << (bit - 1)) != 0


def export_values(fields: DataFrame) -> DataFrame:
    """(doc, name, pos, text): exportable fields as text; several values join by ", ", a box without one is Off."""
    text = F.when(F.col("kind").isin("check", "radio") & (F.coalesce(F.size("value"), F.lit(0)) == 0), "Off").otherwise(F.coalesce(F.array_join("value", ", "), F.lit("")))
    return fields.where(exportable(F.col("kind"))).select("doc", "name", "pos", text.alias("text"))


def column_order(long: DataFrame, file: str = "file") -> list[str]:
    """Field names by where they are first seen: the header of a spreadsheet, as many as forms have fields."""
    first = long.groupBy("name").agg(F.min(F.struct(file, "pos")).alias("at")).orderBy("at", "name")
    return [r["name"] for r in first.collect()]


def form_merge(long: DataFrame, file: str = "file", names: list[str] | None = None) -> DataFrame:
    """One row a file, one column a name in first-seen order; the first of repeated names, "" where missing."""
    names = column_order(long, file) if names is None else names
    first = long.groupBy(file, "name").agg(F.min_by("value", "pos").alias("value"))
    wide = first.groupBy(file).pivot("name", names).agg(F.first("value"))
    return wide.fillna("", subset=names)


def tsv_text(text: Column) -> Column:
    return F.regexp_replace(text, r"[\t\r\n]", " ")


#: Fields of a document at most that are put in order in its own row (fixed value); larger documents are peeled in rounds.
TOGETHER = 64


def calculation_levels(fields: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, name, level) of fields (doc, name, uses: names): those of level 0 use no field, others come after the last of theirs.

    A field in a cycle, or that needs one that is, has no level.  Names that are no field of the document, and a null
    ``uses``, count for nothing.  Documents of TOGETHER rows at most are gathered once, each in a row; of larger ones
    nothing is gathered.
    """
    large = written(fields.groupBy(F.col(doc).alias("__doc")).agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER).select("__doc"), "large")
    if large.isEmpty():
        return _levels_in_rows(fields, doc)
    at = F.col(doc).eqNullSafe(F.col("__doc"))
    return _levels_in_rows(fields.join(large, at, "left_anti"), doc).unionByName(_levels_in_rounds(fields.join(large, at, "left_semi"), doc))


def _levels_in_rows(fields: DataFrame, doc: str) -> DataFrame:
    """Levels within arrays: each step takes away the names that no use holds back."""
    name = lambda x: F.struct(x["name"].alias("name"))
    level = lambda x, n: F.struct(x["name"].alias("name"), n.cast("long").alias("level"))
    uses = F.when(F.col(doc).isNotNull(), F.col("uses"))
    field = F.struct("name", F.filter(F.coalesce(uses, F.array().cast("array<string>")), lambda u: u.isNotNull()).alias("uses"))
    start = F.struct(F.lit(0).cast("long").alias("level"), F.array().cast(f"array<struct<name:{fields.schema['name'].dataType.simpleString()},level:bigint>>").alias("done"), F.col("rest"))

    def step(s: Column, _: Column) -> Column:
        held = let(s["rest"]["name"], lambda names: F.transform(F.filter(s["rest"], lambda x: F.arrays_overlap(x["uses"], names)), name))
        return let(held, lambda h: F.struct(
            (s["level"] + 1).alias("level"),
            F.concat(s["done"], F.transform(F.filter(s["rest"], lambda x: ~F.array_contains(h, name(x))), lambda x: level(x, s["level"]))).alias("done"),
            F.filter(s["rest"], lambda x: F.array_contains(h, name(x))).alias("rest"),
        ))

    told = F.aggregate("rest", start, step, lambda s: F.array_distinct(F.concat(s["done"], F.transform(s["rest"], lambda x: level(x, F.lit(None))))))
    rows = fields.groupBy(doc).agg(F.collect_list(field).alias("rest")).select(doc, F.explode(told).alias("f"))
    return rows.select(doc, "f.name", "f.level")


def _levels_in_rounds(fields: DataFrame, doc: str) -> DataFrame:
    """Levels are peeled off one after the other, each written, so there are as many rounds as levels and a plan holds two joins."""
    left = written(fields.select(doc, "name").distinct(), "fields")
    known = left.withColumnRenamed("name", "use")
    needs = written(fields.select(doc, "name", F.explode("uses").alias("use")).distinct().join(known, [doc, "use"]), "needs")
    out, level = None, 0
    while True:
        waiting = needs.select(doc, "name").distinct()
        free = written(left.join(waiting, [doc, "name"], "left_anti"), "free")
        if free.isEmpty():
            break
        told = free.withColumn("level", F.lit(level).cast("long"))
        out = told if out is None else out.unionByName(told)
        left = written(waiting, "fields")
        needs = written(needs.join(free.withColumnRenamed("name", "use"), [doc, "use"], "left_anti").select(doc, "name", "use"), "needs")
        level += 1
    none = left.withColumn("level", F.lit(None).cast("long"))
    return none if out is None else out.unionByName(none)
