"""HTML of blocks, tables and reports, as one string a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import html_escape


def blocks_html(blocks: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, html) of blocks with text, level (1, 2 or null), bold and italic."""
    text = html_escape(F.col("text"))
    text = F.when(F.col("bold"), F.concat(F.lit("<b>"), text, F.lit("</b>"))).otherwise(text)
    text = F.when(F.col("italic"), F.concat(F.lit("<i>"), text, F.lit("</i>"))).otherwise(text)
    tag = F.when(F.col("level") == 1, "h1").when(F.col("level") == 2, "h2").otherwise("p")
    line = F.concat(F.lit("<"), tag, F.lit(">"), text, F.lit("</"), tag, F.lit(">"))
    body = F.array_join(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), line.alias("__h"))))["__h"], "\n")
    return blocks.groupBy(doc).agg(F.concat(F.lit("<!DOCTYPE html>\n<html><body>\n"), body, F.lit("\n</body></html>\n")).alias("html"))


def tables_html(cells: DataFrame, *table: str) -> DataFrame:
    """(table…, html) of (row, col, text) cells."""
    cell = F.concat(F.lit("<td>"), html_escape(F.col("text")), F.lit("</td>"))
    rows = cells.groupBy(*table, "row").agg(F.array_join(F.array_sort(F.collect_list(F.struct("col", cell.alias("c"))))["c"], "").alias("r"))
    line = F.concat(F.lit("<tr>"), F.col("r"), F.lit("</tr>"))
    return rows.groupBy(*table).agg(F.concat(F.lit("<table>"), F.array_join(F.array_sort(F.collect_list(F.struct("row", line.alias("l"))))["l"], ""), F.lit("</table>")).alias("html"))


def report_html(report: DataFrame, title: str = "Report") -> DataFrame:
    """(html) of a rule report: a row a rule, in order of category and name; as long as there are rules."""
    row = F.concat(F.lit("<tr><td>"), html_escape(F.col("category")), F.lit("</td><td>"), html_escape(F.col("rule")), F.lit("</td><td>"), F.col("status"), F.lit("</td><td>"), F.col("n").cast("string"), F.lit("</td></tr>"))
    body = F.array_join(F.array_sort(F.collect_list(F.struct("category", "rule", row.alias("r"))))["r"], "\n")
    return report.agg(F.concat(F.lit(f"<html><head><title>{title}</title></head><body><table>\n"), body, F.lit("\n</table></body></html>\n")).alias("html"))
