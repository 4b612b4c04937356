"""Aggregations of form values: the form language drops nulls, calculation fields take blanks as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.coerce import is_blank, leading_number, make_number


def fc_value(text: Column) -> Column:
    """The number that the form language's aggregates see in a text: null where it is blank.  Compute it once, ahead of them."""
    return F.when(~is_blank(text), F.coalesce(leading_number(text), F.lit(0.0)))


def fc_sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def fc_avg(value: Column) -> Column:
    return F.avg(value)


def fc_min(value: Column) -> Column:
    return F.min(value)


def fc_max(value: Column) -> Column:
    return F.max(value)


def fc_count(value: Column) -> Column:
    return F.count(value)


def af_value(text: Column) -> Column:
    """The number that calculation fields see in a text: 0 where it has none.  Compute it once, ahead of the aggregates."""
    return F.coalesce(make_number(text), F.lit(0.0))


def _finite(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def af_sum(value: Column) -> Column:
    return _finite(F.sum(value))


def af_product(value: Column) -> Column:
    return _finite(F.product(value))


def af_avg(value: Column) -> Column:
    return _finite(F.avg(value))


def af_min(value: Column) -> Column:
    return _finite(F.min(value))


def af_max(value: Column) -> Column:
    return _finite(F.max(value))


def body_size(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, size): the half-point font size that carries most characters; the larger of equals."""
    bins = runs.select(key, (F.floor(F.col("size") * 2 + 0.5) / 2).alias("size"), F.length("text").alias("n"))
    total = bins.groupBy(key, "size").agg(F.sum("n").alias("n"))
    return total.groupBy(key).agg(F.max_by("size", F.struct("n", "size")).alias("size"))


def space_audit(parts: DataFrame, categories: list[str], total: int | None = None) -> DataFrame:
    """(category, bytes, percent) of every category, zero ones too; ``total`` or what was counted, if more, is the whole, and the rest is overhead."""
    spark = parts.sparkSession
    named = spark.createDataFrame([(c,) for c in categories], "category string")
    used = parts.groupBy("category").agg(F.sum("bytes").alias("bytes"))
    known = named.join(used, "category", "left").select("category", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    counted = known.agg(F.sum("bytes").alias("counted")).select("counted", F.greatest(F.col("counted"), F.lit(total or 0)).alias("whole"))
    rest = counted.select(F.lit("overhead").alias("category"), (F.col("whole") - F.col("counted")).cast("long").alias("bytes"))
    rows = known.unionByName(rest).crossJoin(F.broadcast(counted))
    return rows.select("category", "bytes", F.when(F.col("whole") > 0, F.col("bytes") * 100.0 / F.col("whole")).otherwise(0.0).alias("percent"))


def word_f1(pairs: DataFrame) -> DataFrame:
    """(pair, f1) of (pair, got, want) texts: F1 of their words as multisets; two empty texts agree."""
    words = lambda c: F.explode(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != ""))
    a = pairs.select("pair", words(F.col("got")).alias("w")).groupBy("pair", "w").agg(F.count("*").alias("a"))
    b = pairs.select("pair", words(F.col("want")).alias("w")).groupBy("pair", "w").agg(F.count("*").alias("b"))
    both = a.join(b, ["pair", "w"], "full").fillna(0, ["a", "b"]).groupBy("pair").agg(F.sum(F.least("a", "b")).alias("i"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return pairs.select("pair").distinct().join(both, "pair", "left").select("pair", F.coalesce(F.col("i") * 2 / (F.col("a") + F.col("b")), F.lit(1.0)).alias("f1"))


def f1_summary(scores: DataFrame) -> DataFrame:
    """(n, mean, median, p10) of the column f1: the element at n/2, and at n/10, of the sorted scores."""
    n = scores.count()
    at = lambda i: f"percentile_disc({(i + 1) / n if n else 0.5!r}) within group (order by f1)"
    return scores.agg(F.count("*").alias("n"), F.avg("f1").alias("mean"), F.expr(at(n // 2)).alias("median"), F.expr(at(n // 10)).alias("p10"))


def lowest(scores: DataFrame, key: str, most: int = 12) -> DataFrame:
    """The ``most`` lowest scores; the limit is the feature."""
    return scores.orderBy("f1", key).limit(most)
