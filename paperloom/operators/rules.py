"""Rule engines: findings of declared rules, their report, and overflow rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHOWN = 200


@dataclass(frozen=True)
class Rule:
    """``fails`` is true where a row breaks the rule; ``manual`` rules are for people."""

    name: str
    category: str
    fails: Column | None
    message: str = ""
    manual: bool = False


def findings(rows: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """(rule, key, message) in one scan: every rule's verdict is an element of an array."""
    checked = [F.when(r.fails, F.struct(F.lit(r.name).alias("rule"), F.lit(r.message).alias("message"))) for r in rules if r.fails is not None and not r.manual]
    return rows.select(key, F.explode(F.array_compact(F.array(*checked))).alias("f")).select("f.rule", key, "f.message")


def rule_report(rows: DataFrame, rules: list[Rule], key: str, skipped: tuple[str, ...] = ()) -> DataFrame:
    """(rule, category, status, n): Passed, Failed, Manual or Skipped for each rule."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(r.name, r.category, r.manual, r.name in skipped) for r in rules], "rule string, category string, manual boolean, skipped boolean")
    counts = findings(rows, [r for r in rules if r.name not in skipped], key).groupBy("rule").agg(F.count("*").alias("n"))
    status = F.when(F.col("skipped"), "Skipped").when(F.col("manual"), "Manual").when(F.coalesce("n", F.lit(0)) > 0, "Failed").otherwise("Passed")
    return table.join(counts, "rule", "left").select("rule", "category", status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def shown_findings(found: DataFrame, key: str, shown: int = SHOWN) -> DataFrame:
    """(rule, key, message): at most ``shown`` findings a rule, then a row that counts the others."""
    order = Window.partitionBy("rule").orderBy(key)
    ranked = found.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= shown).drop("__r")
    totals = found.groupBy("rule").agg(F.count("*").alias("n")).where(F.col("n") > shown)
    more = totals.select("rule", F.lit(None).cast(found.schema[key].dataType).alias(key), F.concat(F.lit("… and "), (F.col("n") - shown).cast("string"), F.lit(" more")).alias("message"))
    return ranked.select("rule", key, "message").unionByName(more)


def category_counts(rows: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """(category, n) of every category, from one pass."""
    counted = rows.agg(*(F.count_if(c).alias(n) for n, c in categories.items()))
    entries = F.array(*(F.struct(F.lit(n).alias("category"), F.col(f"`{n}`").alias("n")) for n in categories))
    return counted.select(F.explode(entries).alias("e")).select("e.category", "e.n")


def status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("n"))
