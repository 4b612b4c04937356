"""Session helpers of the training-data operators: shared storage, Arrow passes.

Intermediate tables that cut lineage are written as Parquet into the folder that the
cluster names in ``spark.checkpoint.dir``; executors may be lost at any time and any
other executor can read those files again.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one Arrow batch; with whole texts this bounds a Python worker's memory.
BATCH_ROWS = 1000
#: Texts of one block at most, so that places in a block fit 16 bits.
BLOCK_DOCS = 60_000
#: Bytes of input, as it is stored, for each part that one task holds.
PART_BYTES = 32 << 20


def prepare(spark: SparkSession) -> None:
    """Makes the package importable on executors and bounds Arrow batches."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, path)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  One of our own only where none is named and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` with its rows in the same order at every read: itself where it is a projection of files, else written."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    steps = [line.lstrip(" +-:") for line in plan.strip().split("\n")]
    return df if all(x.startswith(("Project", "Relation")) for x in steps) else materialize(df, "stored")


ROW = "__paperloom_row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as stored, with a number for each row in the column ROW."""
    return stored(docs).withColumn(ROW, F.monotonically_increasing_id())


def parts(df: DataFrame, least: int | None = None) -> int:
    """Parts to deal a table over: one for each PART_BYTES of its files, as many as partitions of a shuffle (or ``least``) at least."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(60_000, max(least or partitions(df.sparkSession), -(-size // PART_BYTES) if size < 1 << 60 else 0))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a DataFrame that reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_kinds(df: DataFrame, name: str, kinds: int) -> list[DataFrame]:
    """Writes ``df`` by its column ``kind`` in one pass; a DataFrame for each kind, which can be forgotten apart."""
    spark = df.sparkSession
    path, writers = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers, "0")
    spark.conf.set(writers, str(kinds + 1))
    try:
        df.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    finally:
        spark.conf.set(writers, before)
    schema = StructType([f for f in df.schema.fields if f.name != "kind"])
    empty = spark.createDataFrame([], schema)
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f"{path}/kind={k}" for k in range(kinds)]
    return [spark.read.schema(schema).parquet(f) if there.exists(jvm.org.apache.hadoop.fs.Path(f)) else empty for f in folders]


def forget(*tables: DataFrame) -> None:
    """Deletes tables written by :func:`materialize` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is the empty text."""
    binary = column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())
    return [x or b"" for x in binary.to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], limit_bytes: int = 6_000_000) -> Iterator[tuple[list, list[bytes]]]:
    """Groups (doc_id, text) rows into blocks of about ``limit_bytes``; a longer text is a block of its own."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            if size and (size + len(text) > limit_bytes or len(ids) >= BLOCK_DOCS):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc)
            texts.append(text)
            size += len(text) + 16
    if ids:
        yield ids, texts


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)
