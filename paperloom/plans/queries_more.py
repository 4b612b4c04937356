"""Queries over field formats, scripts, trees and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions.fields import format_date, keystroke, notation, parse_date, printd, printf, printx
from paperloom.operators.compare import compare_report, word_diff
from paperloom.operators.layout import headings as with_levels
from paperloom.operators.measure import box_union
from paperloom.operators.trees import bookmark_list, outline, path_text, sibling_index, som_resolve
from paperloom.plans.register import Register
from paperloom.plans.script import run_script
from paperloom.sources.html import blocks_html, report_html, tables_html
from paperloom.sources.storage import dealt

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.oracles


@query("SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS ts, strftime(o_orderdate, '%A %-d %B %Y') AS long, strftime(o_orderdate, '%-m/%-d/%y') AS short FROM orders")
def field_dates(t):
    typed = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.concat(F.date_format("o_orderdate", "MMMM"), F.lit(" "), F.date_format("o_orderdate", "d"), F.lit(" '"), F.date_format("o_orderdate", "yy")))
    read = t("orders").select("o_orderkey", parse_date(typed, "m/d/yyyy").alias("ts"))
    return read.select("o_orderkey", "ts", format_date(F.col("ts"), "dddd d mmmm yyyy").alias("long"), format_date(F.col("ts"), "m/d/yy").alias("short"))


@query("SELECT s_suppkey, (CASE WHEN x < 0 THEN '-' ELSE '+' END) || format('{:,.2f}', abs(x)) || ' of ' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS shown FROM (SELECT s_suppkey, CAST(s_acctbal AS DOUBLE) AS x FROM supplier)")
def printed(t):
    return t("supplier").select("s_suppkey", printf("%,0+.2f of %05d", F.col("s_acctbal"), F.col("s_suppkey")).alias("shown"))


@query("SELECT event_id, strftime(ts, 'D:%Y%m%d%H%M%S') AS stamp FROM events")
def printed_dates(t):
    return t("events").select("event_id", printd(0, F.col("ts")).alias("stamp"))


@query("SELECT c_custkey, upper(c_name[1:2]) || '-' || right(c_name, 9)[1:3] AS code FROM customer")
def printed_masks(t):
    return t("customer").select("c_custkey", printx(">AA-999", F.col("c_name")).alias("code"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice / nullif(l_linenumber - 1, 0) AS v FROM lineitem")
def af_notation(t):
    cols = {"unit price": F.col("l_extendedprice"), "qty": F.col("l_quantity"), "n": F.col("l_linenumber")}
    return t("lineitem").select("l_orderkey", "l_linenumber", notation(r"qty * unit\ price / (n - 1)", cols).alias("v"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS value FROM part")
def keystrokes(t):
    typed = F.concat(F.lit("$ "), F.format_number(F.col("p_size").cast("double"), 2))
    return t("part").select("p_partkey", keystroke(typed, "number")["value"].alias("value"))


@query("SELECT p_partkey, CAST((p_size * (p_size + 1)) // 2 - CASE WHEN p_size >= 7 THEN 7 ELSE 0 END AS VARCHAR) AS total FROM part")
def scripts(t):
    source = "func add(a, b) do\n return a + b\nendfunc\nvar s = 0\nfor i = 1 upto size do\n if (i == 7) then\n  continue\n endif\n s = add(s, i)\nendfor\ns"
    # A row may take long, and a table of many rows be one small file.
    return dealt(t("part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", run_script(source, size=F.col("p_size"))["value"].alias("total"))


_LINES = "SELECT doc_id, i - 1 AS line, CASE WHEN (i - 1) % 5 = 0 THEN 1 WHEN (i - 1) % 2 = 0 THEN 2 END AS level, t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


def _lines(t):
    rows = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    size = F.when(F.col("line") % 5 == 0, 20.0).when(F.col("line") % 2 == 0, 13.0).otherwise(10.0)
    body = t("documents").select("doc_id", F.lit(10.0).alias("size"))
    return with_levels(rows.withColumn("size", size).withColumn("bold", F.lit(False)), body, "doc_id")


@query(f"SELECT doc_id, line, level FROM ({_LINES})")
def headings(t):
    return _lines(t).select("doc_id", "line", "level")


@query(
    f"""WITH h AS (SELECT doc_id, line, level, t AS title, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS a FROM ({_LINES}) WHERE level IS NOT NULL)
    SELECT doc_id, CASE WHEN level = 1 THEN CAST(a AS VARCHAR) ELSE a || '.' || sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, a ORDER BY line) END AS path, title FROM h""",
)
def bookmarks(t):
    found = outline(_lines(t).where("level is not null"), "doc_id", "line")
    return found.select("doc_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"), "title")


@query(f"WITH h AS (SELECT doc_id, line, level, t AS title, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS a FROM ({_LINES}) WHERE level IS NOT NULL), s AS (SELECT *, CASE WHEN level = 2 THEN row_number() OVER (PARTITION BY doc_id, a, level ORDER BY line) ELSE 0 END AS b FROM h) SELECT title, CAST(level - 1 AS INT) AS depth FROM s ORDER BY a, b, doc_id LIMIT 100 OFFSET 1")
def bookmark_page(t):
    found = outline(_lines(t).where("level is not null"), "doc_id", "line")
    return bookmark_list(found, 1, 100, "doc_id").select("title", "depth")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS index FROM conversations", name="sibling_index")
def _sibling_index(t):
    return sibling_index(t("conversations"), "conv_id", "role", "turn").select("conv_id", "turn", "index")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS i FROM conversations) WHERE role = 'user' AND i = 1", name="som_resolve")
def _som_resolve(t):
    indexed = sibling_index(t("conversations"), "conv_id", "role", "turn")
    path = F.array(F.struct(F.lit("talk").alias("name"), F.lit(0).alias("index")), F.struct(F.col("role").alias("name"), F.col("index")))
    return som_resolve(indexed.withColumn("path", path), "talk..user[1]").select("conv_id", "turn")


@query("SELECT conv_id, turn, 'talk[0].' || role || '[' || i || ']' AS path FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS i FROM conversations)", name="data_paths")
def _data_paths(t):
    indexed = sibling_index(t("conversations"), "conv_id", "role", "turn")
    path = F.array(F.struct(F.lit("talk").alias("name"), F.lit(0).alias("index")), F.struct(F.col("role").alias("name"), F.col("index")))
    return indexed.select("conv_id", "turn", path_text(path).alias("path"))


@query(f"SELECT doc_id, '<!DOCTYPE html>' || chr(10) || '<html><body>' || chr(10) || string_agg(CASE WHEN level = 1 THEN '<h1>' ELSE '<p>' END || line || CASE WHEN level = 1 THEN '</h1>' ELSE '</p>' END, chr(10) ORDER BY line) || chr(10) || '</body></html>' || chr(10) AS html FROM (SELECT doc_id, line, CASE WHEN level = 1 THEN 1 END AS level FROM ({_LINES})) GROUP BY doc_id")
def html_export(t):
    rows = _lines(t).select("doc_id", "line", F.col("line").cast("string").alias("text"), F.when(F.col("level") == 1, 1).alias("level"), F.lit(False).alias("bold"), F.lit(False).alias("italic"))
    return blocks_html(rows, "doc_id", "line")


@query("SELECT l_orderkey, '<table>' || string_agg('<tr><td>' || l_linenumber || '</td></tr>', '' ORDER BY l_linenumber) || '</table>' AS html FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey")
def html_tables(t):
    cells = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("row"), F.lit(0).alias("col"), F.col("l_linenumber").cast("string").alias("text")).distinct()
    return tables_html(cells, "l_orderkey")


@query("SELECT '<html><head><title>Report</title></head><body><table>' || chr(10) || string_agg('<tr><td>' || n_regionkey || '</td><td>' || n_name || '</td><td>Passed</td><td>' || n_nationkey || '</td></tr>', chr(10) ORDER BY CAST(n_regionkey AS VARCHAR), n_name) || chr(10) || '</table></body></html>' || chr(10) AS html FROM nation")
def html_report(t):
    report = t("nation").select(F.col("n_regionkey").cast("string").alias("category"), F.col("n_name").alias("rule"), F.lit("Passed").alias("status"), F.col("n_nationkey").alias("n"))
    return report_html(report)


@query("SELECT l_returnflag, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity) AS x1, max(l_discount) AS y1 FROM lineitem GROUP BY l_returnflag", name="box_union")
def _box_union(t):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return box_union(t("lineitem").select("l_returnflag", q.alias("x0"), d.alias("y0"), q.alias("x1"), d.alias("y1")), "l_returnflag")


@query("SELECT item_id AS pair, '1 inserted, 0 deleted, 0 replaced' || chr(10) || 'Inserted:  -> §§' AS report FROM benchmark", name="compare_report")
def _compare_report(t):
    b = t("benchmark")
    pairs = b.select(F.col("item_id").alias("pair"), F.col("text").alias("old"), F.concat(F.lit("§§ "), F.col("text")).alias("new"))
    return compare_report(word_diff(pairs))


@query("SELECT conv_id, turn FROM conversations WHERE turn = 0", name="comment_roots")
def _comment_roots(t):
    c = t("conversations").withColumn("in_reply_to", F.when(F.col("turn") > 0, F.col("turn") - 1))
    return c.where("in_reply_to is null").select("conv_id", "turn")
