"""Distributed union-find: connected components of an edge table by local forests and star contraction."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from paperloom.llm.shared import arrow_map, forget, materialize

#: Edges that one worker joins at once.
RUN = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of some edges in order, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while ((up := root[root]) != root).any():
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars, RUN at a time, with a name for each run."""

    def done() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1))
        nodes, roots = stars(u, v)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64()), pa.array([uuid.uuid4().hex] * len(nodes), pa.string())], names=["node", "component", "run"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= RUN:
            yield done()
            held, size = [], 0
    if size:
        yield done()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge, whose ends are longs; ``component`` is its smallest node.

    Each partition first joins its own edges to stars; if one had them all, that is the result, in a
    single job.  Else large-star and small-star steps alternate until the edges no longer change.
    Edges with a null end are ignored, loops and repeated edges do no harm, an empty table gives an empty one.
    Each round is written to the shared folder, so lineage stays short and lost executors are
    made up for; the last one is what is returned; minima are pre-aggregated before their shuffle.
    """
    clean = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    joined = arrow_map(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), _forest, "node long, component long, run string")
    runs = Observation()
    local = materialize(joined.observe(runs, F.min("run").alias("first"), F.max("run").alias("last")).drop("run"), "components")
    if runs.get["first"] == runs.get["last"]:
        return local

    def round_of(d: DataFrame) -> tuple[DataFrame, tuple]:
        """``d`` written, and its print, which is taken as it is written."""
        seen = Observation()
        e = materialize(d.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")), "edges")
        return e, (seen.get["n"], seen.get["x"])

    e, seen = round_of(local.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).distinct())
    while seen[0]:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lead = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lead.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following, now = round_of(small.union(lead.select("u", F.col("m").alias("v"))).distinct())
        forget(e)
        e = following
        if now == seen:
            break
        seen = now
    named = materialize(local.select("node").distinct().join(e, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component")), "components")
    forget(e, local)
    return named
