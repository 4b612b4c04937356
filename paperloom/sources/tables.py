"""Driver tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def newest(spark: SparkSession, folder: str, pattern: str = "*.pdf", limit: int = 100) -> DataFrame:
    """(path, modificationTime, length) of the newest files; the limit is the feature."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "modificationTime", "length").orderBy(F.col("modificationTime").desc_nulls_last(), "path").limit(limit)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(value, path) of text files, one row a file."""
    from pyspark.sql import functions as F

    return spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("path"))
