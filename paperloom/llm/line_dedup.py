"""Line dedup by MinHash: one line of each group of fuzzy copies stays.

Equal lines (trimmed, lower-cased) are one key.  One pass over the texts signs each distinct line of
a block (:mod:`line_signatures`) and deals its band buckets, packed, over parts of the bucket space; a
bucket of one key goes no further.  Members of the others are compared with the most typical ones (whose
shingles other candidates have, too); those elected, compared with all, leave, and what is not yet
connected elects once more.  Lines that are then still apart in some bucket (a passage that strangers
share fills it) are banded anew, by shingles and with more rows, and elect in those buckets; whatever
stays apart there is compared, each with each.  An exact Jaccard of 3/4 of 5-character shingles
links, and distributed union-find makes components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.components import connected_components
from paperloom.llm.line_signatures import alike, banded, crowded, shingle_hashes
from paperloom.llm.shared import ROW, arrow_map, arrow_rows, blocks, forget, materialize, materialize_kinds, numbered, parts
from paperloom.llm.word_blocks import pack, unpack

#: Members of a bucket that are elected at a time, and how often.
ELECTED, ELECTIONS = 4, 2
#: Texts that are signed at once, so a worker stays small.
BLOCK_BYTES = 3_000_000
#: Pairs of one line that are verified in one place.
CROWD = 1000


def norm(line: str) -> str:
    return line.strip(" \t\r\x0b\f").lower()


def _key(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _packed(places: np.ndarray, buckets: np.ndarray, keys: np.ndarray, n: int) -> list[tuple[int, bytes]]:
    """(part, bucket hashes in order as differences, keys) of a block."""
    order = np.argsort(buckets, kind="stable")
    buckets, keys = buckets[order], keys[places[order]]
    part = ((buckets >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(part, np.arange(n + 1))
    return [(p, pack(np.diff(buckets[a:b], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), keys[a:b].tobytes())) for p in np.flatnonzero(np.diff(cuts)).tolist() for a, b in [(cuts[p], cuts[p + 1])]]


def _shared(table: pa.Table) -> pa.Table:
    """(bucket, key) of the buckets of one part that have two keys or more."""
    buckets, keys = [], []
    for blob in table["packed"].to_pylist():
        steps, found = unpack(blob)
        buckets.append(np.cumsum(np.frombuffer(steps, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64))
        keys.append(np.frombuffer(found, np.int64))
    bucket, key = np.concatenate(buckets), np.concatenate(keys)
    order = np.lexsort((key, bucket))
    bucket, key = bucket[order], key[order]
    fresh = np.r_[True, (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])]
    bucket, key = bucket[fresh], key[fresh]
    again = bucket[1:] == bucket[:-1]
    keep = np.r_[again, False] | np.r_[False, again]
    return pa.table({"bucket": pa.array(bucket[keep].view(np.int64)), "key": pa.array(key[keep])})


def signed(docs: DataFrame) -> list[DataFrame]:
    """Three stored tables from one pass: lines of a text (row, doc_id, keys), a block's buckets (part, packed), its distinct lines (key, norm).

    ``keys`` has a null for each blank line.
    """
    n = parts(docs)
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("doc_id", {"int": pa.int32(), "string": pa.string()}.get(doc_type, pa.int64())), ("keys", pa.list_(pa.int64())), ("part", pa.int32()), ("packed", pa.binary()), ("key", pa.int64()), ("norm", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, columns: dict[str, list]) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            columns["kind"] = [kind] * size
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

        for ids, texts in blocks((pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column(0), b.column(1)], names=["row", "doc_id"]), b.column(2)], names=["id", "text"]) for b in batches), BLOCK_BYTES):
            known: dict[str, int] = {}
            found = []
            for t in texts:
                here = []
                for line in map(norm, t.decode("utf-8", "replace").split("\n")):
                    if line and line not in known:
                        known[line] = _key(line)
                    here.append(known.get(line))
                found.append(here)
            yield rows(0, {"row": [i["row"] for i in ids], "doc_id": [i["doc_id"] for i in ids], "keys": found})
            lines, keys = list(known), np.fromiter(known.values(), np.int64, len(known))
            packed = _packed(*banded(lines), keys, n)
            yield rows(1, {"part": [p for p, _ in packed], "packed": [b for _, b in packed]})
            for at in range(0, len(lines), 5000):
                yield rows(2, {"key": keys[at : at + 5000].tolist(), "norm": lines[at : at + 5000]})

    ddl = f"kind int, row long, doc_id {doc_type}, keys array<long>, part int, packed binary, key long, norm string"
    lines, packed, texts = materialize_kinds(arrow_map(docs.select(ROW, "doc_id", "text"), run, ddl), "signed", 3)
    return [lines.select("row", "doc_id", "keys"), packed.select("part", "packed"), texts.select("key", "norm")]


def _probably(texts: DataFrame, wanted: DataFrame, count: int) -> DataFrame:
    """``texts`` without most rows of other keys: a bitmap over hashed keys, of 16 MB at most, filters before any shuffle."""
    bits = 1 << min(27, max(20, (16 * count).bit_length()))
    chunk, place = F.expr(f"cast(floor(pmod(xxhash64(key, 7), {bits}) / 32768) as int)"), F.expr(f"cast(pmod(pmod(xxhash64(key, 7), {bits}), 32768) as int)")
    maps = wanted.select(chunk.alias("chunk"), place.alias("place")).groupBy("chunk").agg(F.call_function("bitmap_construct_agg", F.col("place").cast("long")).alias("bits"))
    marked = texts.withColumn("chunk", chunk).withColumn("place", place).join(F.broadcast(maps), "chunk")
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return marked.where(F.getbit(byte, F.col("place") % 8) == 1).select(*texts.columns)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose lines are alike.  A line of many pairs is copied for each CROWD of them."""

    def check(batches):
        for b in batches:
            yield b.select(["a", "b"]).filter(pa.array(alike(b.column(2).to_pylist(), b.column(3).to_pylist())))

    crowds = pairs.groupBy("a").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("s"))
    left = texts.select(F.col("key").alias("a"), F.col("norm").alias("na")).join(crowds, "a").withColumn("salt", F.explode(F.expr("sequence(0, s - 1)"))).drop("s")
    salted = pairs.join(crowds, "a").select("a", "b", F.expr("cast(pmod(xxhash64(b), s) as int)").alias("salt"))
    both = salted.join(left, ["a", "salt"]).join(texts.select(F.col("key").alias("b"), F.col("norm").alias("nb")), "b")
    return arrow_map(both.select("a", "b", "na", "nb"), check, "a long, b long")


def _sketch(texts: DataFrame, bits: int) -> np.ndarray:
    """In how many lines each shingle is, up to 255, counted by the lowest bits of its hash: 2 ** bits bytes whatever the data."""
    size, step = 1 << bits, 1 << 18
    schema = pa.schema([("range", pa.int32()), ("counts", pa.binary())])

    def count(batches):
        seen = np.zeros(size, np.uint8)
        for b in batches:
            for s in shingle_hashes(b.column(0).to_pylist()):
                at = s & (size - 1)
                seen[at] += seen[at] < 255
        yield arrow_rows(schema, [(i, pack(part.tobytes())) for i in range(size // step) if (part := seen[i * step : (i + 1) * step]).any()])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(unpack(b)[0], np.uint8).astype(np.uint32) for b in table["counts"].to_pylist())
        return pa.Table.from_batches([arrow_rows(schema, [(table["range"][0].as_py(), pack(np.minimum(total, 255).astype(np.uint8).tobytes()))])])

    out = np.zeros(size, np.uint8)
    for r in arrow_map(texts.select("norm"), count, "range int, counts binary").groupBy("range").applyInArrow(add, "range int, counts binary").toLocalIterator():
        out[r["range"] * step : (r["range"] + 1) * step] = np.frombuffer(unpack(r["counts"])[0], np.uint8)
    return out


def line_links(packed: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, b): keys of fuzzy copies among the lines of :func:`signed`, whose tables are forgotten here; of pairs that others connect, not all."""
    members = materialize(packed.groupBy("part").applyInArrow(_shared, "bucket long, key long"), "members")
    forget(packed)
    wanted = materialize(members.select("key").distinct(), "wanted")
    count = wanted.count()
    near = materialize(_probably(lines, wanted, count), "near")
    forget(lines)
    one = materialize(near.groupBy("key").agg(F.first("norm").alias("norm")).join(wanted, "key", "left_semi"), "one")
    forget(near, wanted)
    sketch = packed.sparkSession.sparkContext.broadcast(_sketch(one, min(24, max(20, (64 * count).bit_length()))))

    def sized(batches):
        for b in batches:
            sets = shingle_hashes(b.column(1).to_pylist())
            often = [float(np.log2(np.maximum(sketch.value[s & (len(sketch.value) - 1)], 1)).mean()) for s in sets]
            yield b.append_column("n", pa.array(list(map(len, sets)), pa.int64())).append_column("typical", pa.array(often, pa.float64()))

    def again(batches):
        for b in batches:
            found = crowded(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(len(found)), found.shape[1])))], names=["bucket", "key"])

    texts = materialize(arrow_map(one, sized, "key long, norm string, n long, typical double"), "texts")
    forget(one)
    linked, apart = _elected(members, texts, None)
    forget(members)
    left = materialize(apart.select("key").distinct(), "left")
    forget(apart)
    finer = materialize(arrow_map(texts.join(left, "key", "left_semi").select("key", "norm"), again, "bucket long, key long"), "finer")
    several = finer.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    linked, apart = _elected(finer.join(several, "bucket"), texts, linked)
    forget(finer, left)
    return _linked(apart.join(apart.select("bucket", F.col("key").alias("head"), F.col("n").alias("m"), F.col("component").alias("other")), "bucket").where("key < head"), texts, linked)


def _elected(members: DataFrame, texts: DataFrame, linked: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Components (node, component) by links between members (bucket, key) and the elected of their buckets and by those before; and who is left in buckets that are not one component."""
    apart, done = members.join(texts.select("key", "n", "typical"), "key"), []
    for turn in range(ELECTIONS + 1):
        if linked is None:
            apart = apart.withColumn("component", F.col("key"))
        else:
            apart = apart.join(linked, F.col("key") == F.col("node"), "left").select("bucket", "key", "n", "typical", F.coalesce("component", "key").alias("component"))
            split = apart.groupBy("bucket").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("bucket")
            apart = apart.join(split, "bucket")
        if turn < ELECTIONS:
            apart = apart.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("typical").desc(), F.xxhash64("key"), "key")))
        apart = materialize(apart, "apart")
        forget(*done)
        if turn < ELECTIONS:
            heads = apart.where(F.col("rank") <= ELECTED).select("bucket", F.col("key").alias("head"), F.col("n").alias("m"), F.col("component").alias("other"))
            links = _linked(apart.join(heads, "bucket"), texts, linked)
            done = [apart] if linked is None else [apart, linked]
            linked = connected_components(links)
            apart = apart.where(F.col("rank") > ELECTED).drop("component", "rank")
    return linked, apart


def _linked(candidates: DataFrame, texts: DataFrame, linked: DataFrame | None) -> DataFrame:
    """(a, b): those candidates (key, head) of different components that are alike, and each node of ``linked`` with its component."""
    pairs = candidates.where("component <> other and 4 * n >= 3 * m and 4 * m >= 3 * n")
    pairs = materialize(pairs.select(F.least("key", "head").alias("a"), F.greatest("key", "head").alias("b")).distinct(), "pairs")
    found = materialize(_verified(pairs, texts), "links")
    forget(pairs)
    return found if linked is None else linked.where("node <> component").toDF("a", "b").union(found)


def line_verdicts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, line_no, component, kept) of every line of every row of a stored table with row numbers."""
    rows, packed, texts = signed(docs)
    found = rows.select("row", "doc_id", F.posexplode("keys").alias("line_no", "key"))
    linked = connected_components(line_links(packed, texts))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row", "line_no")
    firsts = found.where("key is not null").groupBy("key").agg(F.min(place).alias("first"))
    named = materialize(firsts.join(linked, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("component", "key").alias("component")), "named")
    lowest = named.groupBy("component").agg(F.min("first").alias("stays"))
    decided = named.join(lowest, "component").select(F.col("key").alias("k"), "component", "stays")
    lines = found.where("key is not null").join(decided, F.col("key") == F.col("k")).select("row", "doc_id", "line_no", "component", (place == F.col("stays")).alias("kept"))
    blank = found.where("key is null").select("row", "doc_id", "line_no", F.lit(None).cast("long").alias("component"), F.lit(True).alias("kept"))
    return lines.unionByName(blank)


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, component, kept) of every line of every row of ``docs``.

    Of each component the first line stays, by doc_id, row and line number; blank lines always stay
    and have a null component.  A null text is one blank line.  A null doc_id comes after all
    others; rows of an equal doc_id are texts of their own.  Extra columns are not read; an empty
    table gives an empty one.
    """
    return line_verdicts(numbered(docs)).drop("row")


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with only the lines that stay, in order; a text that had words and loses them all goes.

    All columns are kept; ``n_chars``, where there is one, follows the new text.
    """
    rows = numbered(docs)
    lost = line_verdicts(rows).where("not kept").groupBy(F.col("row").alias(ROW)).agg(F.collect_set("line_no").alias(f"{ROW}_gone"))
    joined, gone = rows.join(lost, ROW, "left"), F.col(f"{ROW}_gone")
    stay = F.array_join(F.filter(F.split(F.col("text"), "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    new = F.when(gone.isNull(), F.col("text")).otherwise(stay)
    out = joined.withColumn(f"{ROW}_new", new).where(gone.isNull() | F.col(f"{ROW}_new").rlike(r"[^\s]")).withColumn("text", F.col(f"{ROW}_new"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(gone.isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
