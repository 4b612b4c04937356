"""Elements of tagged pages and the rules of their structure: headings, lists, tables, figures.

Nesting comes from running sums over the order of the tags, a parent from the last element opened one level
up; both are windows, no page is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAG = r"""</?[A-Za-z][A-Za-z0-9]*(?:[^>"']|"[^"]*"|'[^']*')*>"""
HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Tags whose ends may be left out in running text: they open nothing here.
LOOSE = ("p", "b", "i", "html", "head", "body")
GROUPS = ("table", "thead", "tbody", "tfoot")
#: The most columns or rows that a cell covers (fixed value).
WIDEST = 10_000


def elements(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, kind, attributes, depth, parent) of the elements that nest, in order; ``parent`` is the position of the element around, null at the top.

    Comments, scripts, styles and loose tags are passed over; a closing tag without an opening one makes what follows
    one level higher, as it stands.
    """
    tags = pages.select(key, F.posexplode(F.regexp_extract_all(F.regexp_replace(html, HIDDEN, ""), F.lit(TAG), F.lit(0))).alias("pos", "tag"))
    kind = F.lower(F.regexp_extract("tag", r"^</?([A-Za-z0-9]+)", 1))
    named = tags.withColumn("kind", kind).where(~F.col("kind").isin(*LOOSE))
    closes = F.col("tag").startswith("</")
    alone = F.col("kind").isin(*VOID) | F.col("tag").endswith("/>")
    order = Window.partitionBy(key).orderBy("pos")
    step = F.when(alone, 0).when(closes, -1).otherwise(1)
    deep = named.withColumn("level", F.sum(step).over(order)).where(~closes).withColumn("depth", F.col("level") + alone.cast("int"))
    roles = F.array(F.struct(F.col("depth").alias("at"), F.lit(True).alias("opens")), F.struct((F.col("depth") - 1).alias("at"), F.lit(False).alias("opens")))
    met = deep.withColumn("role", F.explode(roles)).withColumn("opened", F.when(F.col("role.opens") & ~alone, F.col("pos")))
    around = F.last("opened", ignorenulls=True).over(Window.partitionBy(key, "role.at").orderBy("pos"))
    attributes = F.btrim(F.regexp_extract("tag", r"(?s)^<[A-Za-z0-9]+(.*?)/?>$", 1))
    return met.withColumn("parent", around).where("not role.opens").select(key, F.col("pos").cast("long").alias("pos"), "kind", attributes.alias("attributes"), F.col("depth").cast("long").alias("depth"), F.col("parent").cast("long").alias("parent"))


def attribute(attributes: Column, name: str) -> Column:
    """An attribute's value, null where it is not given."""
    shape = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.when(attributes.rlike(shape), F.concat(*(F.coalesce(F.regexp_extract(attributes, shape, i), F.lit("")) for i in (1, 2, 3))))


def _spanned(attributes: Column, name: str) -> Column:
    n = attribute(attributes, name).try_cast("int")
    return F.when(n >= 1, F.least(n, F.lit(WIDEST))).otherwise(1)


def structure_findings(found: DataFrame, key: str) -> DataFrame:
    """(key, rule, pos, message) of elements (as :func:`elements` gives them) that break a rule.

    list_items, table_rows, table_cells: an item, row or cell stands where it belongs; table_headers: a table has a
    header cell; table_regularity: its rows are equally wide, with the columns and rows that cells span;
    heading_nesting: no level is skipped; figures_alt_text: a picture has a text, or is marked as empty by one.
    """
    up = found.select(F.col(key).alias("__k"), F.col("pos").alias("__p"), F.col("kind").alias("above"))
    rows = found.join(up, (F.col(key) == F.col("__k")) & (F.col("parent") == F.col("__p")), "left").drop("__k", "__p")
    order = Window.partitionBy(key).orderBy("pos")
    level = F.when(F.col("kind").rlike("^h[1-6]$"), F.substring("kind", 2, 1).cast("int"))
    before = F.coalesce(F.last(level, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("level", level).withColumn("before", F.when(level.isNotNull(), before))
    inside = lambda *kinds: F.coalesce(F.col("above").isin(*kinds), F.lit(False))
    skipped = F.when(F.col("before") == 0, F.format_string("the first heading is of level %d", "level")).otherwise(F.format_string("level %d follows level %d", "level", "before"))
    verdicts = {
        "list_items": (F.col("kind") == "li", ~inside("ul", "ol", "menu"), F.lit("not in a list")),
        "table_rows": (F.col("kind") == "tr", ~inside(*GROUPS), F.lit("not in a table")),
        "table_cells": (F.col("kind").isin("td", "th"), ~inside("tr"), F.lit("not in a row")),
        "heading_nesting": (F.col("level").isNotNull(), F.col("level") > F.col("before") + 1, skipped),
        "figures_alt_text": (F.col("kind") == "img", attribute(F.col("attributes"), "alt").isNull(), F.lit("no alternate text")),
    }
    told = [F.when(of & broken, F.struct(F.lit(rule).alias("rule"), F.col("pos"), message.alias("message"))) for rule, (of, broken, message) in verdicts.items()]
    single = rows.select(key, F.explode(F.array_compact(F.array(*told))).alias("f")).select(key, "f.rule", "f.pos", "f.message")

    # Tables: rows belong to the table itself or to a group of it, cells to a row.
    owner = rows.where(F.col("kind").isin(*GROUPS)).select(F.col(key).alias("__k"), F.col("pos").alias("__p"), F.when(F.col("kind") == "table", F.col("pos")).when(F.col("above") == "table", F.col("parent")).alias("table"))
    lines = rows.where("kind = 'tr'").join(owner, (F.col(key) == F.col("__k")) & (F.col("parent") == F.col("__p"))).where("table is not null").select(F.col(key).alias("__k"), F.col("pos").alias("__p"), "table")
    lines = lines.withColumn("row", F.row_number().over(Window.partitionBy("__k", "table").orderBy("__p"))).withColumn("rows", F.count("*").over(Window.partitionBy("__k", "table")))
    cells = rows.where("kind in ('td', 'th')").select(key, "kind", "parent", _spanned(F.col("attributes"), "colspan").alias("wide"), _spanned(F.col("attributes"), "rowspan").alias("high"))
    placed = lines.join(cells, (F.col(key) == F.col("__k")) & (F.col("parent") == F.col("__p")), "left")
    covered = placed.withColumn("at", F.explode(F.sequence(F.col("row"), F.least(F.col("rows"), F.col("row") + F.coalesce("high", F.lit(1)) - 1))))
    widths = covered.groupBy("__k", "table", "at").agg(F.sum(F.coalesce("wide", F.lit(0))).alias("width")).groupBy("__k", "table").agg(F.min("width").alias("least"), F.max("width").alias("most"))
    uneven = widths.where("least <> most").select(F.col("__k").alias(key), F.lit("table_regularity").alias("rule"), F.col("table").alias("pos"), F.format_string("rows of %d to %d columns", "least", "most").alias("message"))
    headed = placed.where("kind = 'th'").select("__k", "table").distinct()
    tables = rows.where("kind = 'table'").select(F.col(key).alias("__k"), F.col("pos").alias("table"))
    bare = tables.join(headed, ["__k", "table"], "left_anti").select(F.col("__k").alias(key), F.lit("table_headers").alias("rule"), F.col("table").alias("pos"), F.lit("no header cells").alias("message"))
    return single.unionByName(uneven).unionByName(bare)
