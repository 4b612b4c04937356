"""Cutting lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


#: Stored bytes of a table, as the optimizer takes them, for each part that one task sorts (fixed value).
PART_BYTES = 1 << 20


def dealt(df: DataFrame, *key: str, size_of: DataFrame | None = None, each: int = PART_BYTES) -> DataFrame:
    """``df`` by hash of ``key`` in parts of a bounded size (of ``size_of``, where what is dealt hides its size), as many as a shuffle has at least: what is made of it later stays where it is.

    Windows, groups and joins by ``key`` and more columns then need no shuffle of their own.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    size = int((df if size_of is None else size_of)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(60_000, max(least, -(-size // each) if size < 1 << 60 else 0)), *key)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as Parquet in the folder that ``spark.checkpoint.dir`` names, read again; a folder of our own only in one process."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        folder = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
