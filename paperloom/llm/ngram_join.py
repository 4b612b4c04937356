"""N-gram Jaccard join: word-shingle sets that overlap by 3/4, found by signature trees.

1. Every text becomes a set of shingle hashes.  Equal sets are one class from here on, named by
   a hash of the set, so a hot group of copies costs one posting a block.
2. Blocks of texts deal their (shingle, class) postings, packed, over buckets of the shingle
   space.  Each bucket counts in how many classes a shingle is; a shingle of one class can be in
   no overlap and goes no further.
3. Postings come together again by class.  With shingles in order of frequency, two sets that
   link share one among the first n - ceil(3n/4) + 1 of each; a class whose first ones are all
   its own has no links.  The others (a few) carry their set and an anchor class for each such
   shingle.
4. Anchors make families (distributed union-find).  Within a family a signature tree holds
   OR-combined token bitmaps and size ranges; its dual traversal prunes node pairs by the largest
   possible overlap and skips pairs that are connected already, and exact overlaps decide.
   A family over FAMILY classes is dealt over pairs of parts, so no task holds all of it.
5. Union-find over the links gives the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.components import connected_components
from paperloom.llm.shared import ROW, arrow_map, arrow_rows, blocks, materialize, numbered
from paperloom.llm.shared import parts as parts_of
from paperloom.llm.words import shingle_sets

#: Classes of one part of a family.
FAMILY = 4096
BITS = 2048
LEAF, FAN = 64, 8


def set_key(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams) - (1 << 63)


def _pack(h: np.ndarray) -> bytes:
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (h >> np.uint64(32)).astype(np.uint16).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    n = len(b) // 6
    return np.frombuffer(b, np.uint32, n).astype(np.uint64) | np.frombuffer(b, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)


_BUCKET = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("at", pa.binary()), ("grams", pa.binary())])


def _deal(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in blocks(batches):
            distinct = {set_key(s): s for s in shingle_sets(texts) if len(s)}
            if not distinct:
                continue
            keys = np.fromiter(distinct, np.int64, len(distinct))
            sizes = np.fromiter(map(len, distinct.values()), np.uint32, len(distinct))
            grams = np.concatenate(list(distinct.values()))
            at = np.repeat(np.arange(len(keys), dtype=np.uint16), sizes)
            bucket = (grams % np.uint64(n_buckets)).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")
            grams, at, bucket = grams[order], at[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[k], cuts[k + 1])
                used, place = np.unique(at[part], return_inverse=True)
                rows.append((k, keys[used].tobytes(), sizes[used].tobytes(), place.astype(np.uint16).tobytes(), _pack(grams[part])))
            yield arrow_rows(_BUCKET, rows)

    return run


_SHARED = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary()), ("df", pa.binary()), ("anchors", pa.binary())])


def _count(n_buckets: int):
    """Of one bucket: shingles of two classes or more, packed by the classes' part."""

    def run(table: pa.Table) -> pa.Table:
        key, size, gram = [], [], []
        for r in table.to_pylist():
            at = np.frombuffer(r["at"], np.uint16)
            key.append(np.frombuffer(r["keys"], np.int64)[at])
            size.append(np.frombuffer(r["sizes"], np.uint32)[at])
            gram.append(_unpack(r["grams"]))
        key, size, gram = map(np.concatenate, (key, size, gram))
        s = np.sort(gram)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if not len(twice):
            return _SHARED.empty_table()
        keep = twice[np.minimum(np.searchsorted(twice, gram), len(twice) - 1)] == gram
        key, size, gram = key[keep], size[keep], gram[keep]
        order = np.lexsort((key, gram))
        key, size, gram = key[order], size[order], gram[order]
        fresh = np.r_[True, (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])]
        key, size, gram = key[fresh], size[fresh], gram[fresh]
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        n = np.diff(np.r_[first, len(gram)])
        df, anchor = np.repeat(n, n), np.repeat(key[first], n)
        keep = df > 1
        if not keep.any():
            return _SHARED.empty_table()
        key, size, gram, df, anchor = key[keep], size[keep], gram[keep], np.minimum(df[keep], 65535), anchor[keep]
        order = np.argsort(key, kind="stable")
        key, size, gram, df, anchor = key[order], size[order], gram[order], df[order], anchor[order]
        part = ((key >> 32) + (1 << 31)) * n_buckets >> 32
        cuts = np.searchsorted(part, np.arange(n_buckets + 1))
        rows = []
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[p], cuts[p + 1]
            first = np.flatnonzero(np.r_[True, key[a + 1 : b] != key[a : b - 1]]) + a
            counts = np.diff(np.r_[first, b])
            rows.append((p, key[first].tobytes(), size[first].tobytes(), counts.astype(np.uint32).tobytes(), _pack(gram[a:b]), df[a:b].astype(np.uint16).tobytes(), anchor[a:b].tobytes()))
        return pa.Table.from_batches([arrow_rows(_SHARED, rows)])

    return run


_CLASS = pa.schema([("key", pa.int64()), ("size", pa.int64()), ("grams", pa.binary()), ("anchors", pa.list_(pa.int64()))])


def _prefixes(table: pa.Table) -> pa.Table:
    """Classes of one part whose rarest shingles are shared."""
    key, size, gram, df, anchor = [], [], [], [], []
    for r in table.to_pylist():
        counts = np.frombuffer(r["counts"], np.uint32)
        key.append(np.repeat(np.frombuffer(r["keys"], np.int64), counts))
        size.append(np.repeat(np.frombuffer(r["sizes"], np.uint32), counts))
        gram.append(_unpack(r["grams"]))
        df.append(np.frombuffer(r["df"], np.uint16))
        anchor.append(np.frombuffer(r["anchors"], np.int64))
    key, size, gram, df, anchor = map(np.concatenate, (key, size, gram, df, anchor))
    order = np.lexsort((gram, df, key))
    key, size, gram, anchor = key[order], size[order].astype(np.int64), gram[order], anchor[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[first, len(key)])
    n = size[first]
    lead = n - (3 * n + 3) // 4 + 1 - (n - count)
    rows = []
    for i in np.flatnonzero(lead > 0).tolist():
        a = first[i]
        near = np.unique(anchor[a : a + lead[i]])
        rows.append((int(key[a]), int(n[i]), np.sort(gram[a : a + count[i]]).tobytes(), near.tolist()))
    return pa.Table.from_batches([arrow_rows(_CLASS, rows)])


class SignatureTree:
    """Bitmaps and size ranges over token sets: leaves of LEAF sets, nodes of FAN children."""

    def __init__(self, sizes: np.ndarray, grams: list[np.ndarray], side: np.ndarray):
        self.order = np.lexsort((sizes, [int((g * np.uint64(0x9E3779B97F4A7C15)).min()) if len(g) else 0 for g in grams], side))
        self.sizes, self.grams, self.side = sizes[self.order], [grams[i] for i in self.order], side[self.order]
        lengths = np.array([len(g) for g in self.grams])
        bits = np.zeros((len(sizes), BITS), bool)
        if lengths.sum():
            bits[np.repeat(np.arange(len(sizes)), lengths), (np.concatenate(self.grams) % np.uint64(BITS)).astype(np.int64)] = True
        self.maps = np.packbits(bits, axis=1).view(np.uint64)
        self.excess = lengths - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        starts = np.arange(0, len(sizes), LEAF)
        up = (np.bitwise_or.reduceat(self.maps, starts, axis=0), np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts), np.maximum.reduceat(self.excess, starts))
        self.levels = [up]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, excess = self.levels[-1]
            starts = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, starts, axis=0), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(excess, starts)))

    def possible(self, level: int, a: int, b: int) -> bool:
        maps, low, high, excess = self.levels[level]
        if 4 * high[a] < 3 * low[b] or 4 * high[b] < 3 * low[a]:
            return False
        most = int(np.bitwise_count(maps[a] & maps[b]).sum()) + min(excess[a], excess[b])
        return bool(7 * most >= 3 * (low[a] + low[b]))

    def links(self) -> list[tuple[int, int]]:
        """Pairs that link, enough of them to connect whatever links connect."""
        n = len(self.sizes)
        comp = np.arange(n)
        members = {i: [i] for i in range(n)}
        found: list[tuple[int, int]] = []
        two_sided = self.side[0] != self.side[-1]
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, a, b = todo.pop()
            width = LEAF * FAN**level
            ra, rb = slice(a * width, min(n, (a + 1) * width)), slice(b * width, min(n, (b + 1) * width))
            ca, cb = comp[ra], comp[rb]
            if (a != b or len(ca) > 1) and ca.min() == ca.max() == cb.min() == cb.max():
                continue
            if two_sided and self.side[ra.start] == self.side[rb.stop - 1]:
                continue
            if not self.possible(level, a, b):
                continue
            if level:
                top = len(self.levels[level - 1][1])
                cross = [(level - 1, x, y) for x in range(a * FAN, min(top, (a + 1) * FAN)) for y in range(max(x, b * FAN), min(top, (b + 1) * FAN))]
                todo += sorted(cross, key=lambda t: t[1] == t[2])
                continue
            na, nb = self.sizes[ra, None], self.sizes[None, rb]
            most = np.bitwise_count(self.maps[ra, None] & self.maps[None, rb]).sum(2, dtype=np.int64) + np.minimum(self.excess[ra, None], self.excess[None, rb])
            ok = (7 * most >= 3 * (na + nb)) & (4 * na >= 3 * nb) & (4 * nb >= 3 * na)
            if a == b:
                ok &= np.tri(len(ca), k=-1, dtype=bool).T
            if two_sided:
                ok &= self.side[ra, None] != self.side[None, rb]
            for x, y in zip(*np.nonzero(ok), strict=True):
                i, j = ra.start + int(x), rb.start + int(y)
                ci, cj = comp[i], comp[j]
                if ci == cj:
                    continue
                g, h = self.grams[i], self.grams[j]
                both = len(np.intersect1d(g, h, assume_unique=True))
                if 100 * both >= 75 * (self.sizes[i] + self.sizes[j] - both):
                    found.append((i, j))
                    if len(members[ci]) < len(members[cj]):
                        ci, cj = cj, ci
                    moved = members.pop(cj)
                    comp[moved] = ci
                    members[ci] += moved
        return [(int(self.order[i]), int(self.order[j])) for i, j in found]


def _unit_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of rows of one unit; rows are sorted by it."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    unit, rows = None, []

    def done():
        if len(rows) < 2:
            return []
        tree = SignatureTree(np.array([r["size"] for r in rows]), [np.frombuffer(r["grams"], np.uint64) for r in rows], np.array([r["side"] for r in rows]))
        return [(rows[i]["key"], rows[j]["key"]) for i, j in tree.links()]

    out: list[tuple[int, int]] = []
    for batch in batches:
        for r in batch.to_pylist():
            if (here := (r["family"], r["i"], r["j"])) != unit:
                out += done()
                unit, rows = here, []
            rows.append(r)
        yield arrow_rows(schema, out)
        out = []
    yield arrow_rows(schema, out + done())


def set_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, key): each text's number of distinct shingles and its set's class; null for no shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for ids, texts in blocks(batches):
            sets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch_type), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())],
                names=["doc_id", "n_shingles", "key"],
            )

    batch_type = pa.int32() if kind == "int" else pa.string() if kind == "string" else pa.int64()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_shingles long, key long")


def class_links(docs: DataFrame) -> DataFrame:
    """(a, b): linked classes of different sets, enough of the links to connect all that links connect."""
    n = parts_of(docs)
    dealt = arrow_map(docs.select("doc_id", "text"), _deal(n), "bucket int, keys binary, sizes binary, at binary, grams binary")
    shared = dealt.groupBy("bucket").applyInArrow(_count(n), "part int, keys binary, sizes binary, counts binary, grams binary, df binary, anchors binary")
    classes = materialize(shared.groupBy("part").applyInArrow(_prefixes, "key long, size long, grams binary, anchors array<long>"), "classes")
    families = connected_components(classes.select(F.col("key").alias("a"), F.explode("anchors").alias("b"))).withColumnRenamed("component", "family")
    placed = classes.join(families, F.col("key") == F.col("node")).select("key", "size", "grams", "family")
    parts = placed.groupBy("family").agg(F.count("*").alias("n")).where("n > 1").select("family", F.ceil(F.col("n") / FAMILY).cast("int").alias("s"))
    units = (
        placed.join(parts, "family")
        .withColumn("own", F.expr("cast(pmod(xxhash64(key), s) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, s - 1)")))
        .select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.expr("cast(own > other as int)").alias("side"), "key", "size", "grams")
    )
    dealt = units.repartition(n, "family", "i", "j").sortWithinPartitions("family", "i", "j", "side")
    return arrow_map(dealt, _unit_links, "a long, b long")


def ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text, ...).

    Two texts link when their sets of five-word shingles overlap by 3/4 of the union; shorter
    texts are one shingle.  ``component_id`` is the smallest doc_id reachable by links.  A null
    or wordless text has no shingles and is alone.  Repeated rows stay repeated; a null doc_id
    keeps its row and never names a component (null where no other could).  Extra columns are
    not read.  An empty table gives an empty one.
    """
    members = materialize(set_classes(docs), "members")
    linked = connected_components(materialize(class_links(docs), "links"))
    firsts = members.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"))
    named = firsts.join(linked, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("component", "key").alias("class"))
    lowest = named.groupBy("class").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    merged = named.join(lowest.where("n > 1").drop("n"), "class", "left").select(F.col("key").alias("k"), F.coalesce("component_id", "first").alias("component_id"))
    return members.join(merged, F.col("key") == F.col("k"), "left").select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the lowest doc_id, a null one last.

    Rows count, not doc_ids: of two rows with one doc_id each stays unless it is in a component with
    a row that comes before it.  All columns are kept; rows without shingles stay.
    """
    rows = numbered(docs)
    groups = ngram_jaccard_join(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group"))
    placed = materialize(groups.join(rows.select(ROW, "doc_id"), ROW).select("group", F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", ROW).alias("place")), "placed")
    firsts = placed.groupBy("group").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = placed.join(firsts, "group").where("place <> first").select(F.col(f"place.{ROW}").alias(ROW))
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)
