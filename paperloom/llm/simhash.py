"""SimHash near-dedup: fingerprints that differ in few bits, found by vantage-point trees.

1. A text's fingerprint is the majority, bit by bit, of the 64-bit hashes of its word shingles.
   Equal fingerprints are one point from here on.
2. A tree of vantage points, built on the driver from a bounded sample of points, parts the space of
   fingerprints by Hamming distance: within a radius of the vantage point, or beyond.  Its leaves are
   shards.  Each point lives in one; as a query it also visits every shard that the triangle
   inequality does not rule out, so each pair within reach meets in a shard.
3. In a shard a vantage-point tree of its own points answers the queries, batch by batch: distances to
   vantage points prune branches by the same bounds, leaves are compared exactly.  Points of one
   shard are linked as they are found, and a branch that is one component already is not searched
   again by its own points, so a crowd of near copies costs no square.
4. Union-find over the links gives the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.components import connected_components
from paperloom.llm.shared import arrow_map, arrow_rows, blocks, materialize, partitions

#: Words of a shingle, the hash's seed, and bits in which linked fingerprints differ at most.
K, SEED, REACH = 3, 42, 2
#: Points of a shard as far as the sample tells, sampled points of each, and the most that are sampled.
HOME, SAMPLED, SAMPLE = 16_384, 64, 262_144
#: Points of a leaf, vantage points that are tried for a node, and points they are tried on.
LEAF, TRIED, PROBE = 32, 6, 256
#: Bytes of text, points and (query, node) pairs that are handled at once.
BLOCK_BYTES, POINTS, FRONT = 2_000_000, 500_000, 1_000_000


def fingerprint(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each run of ``counts`` hashes, the bits that over half of them have; no hashes, no bits."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = (np.cumsum(counts) - counts)[some]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > counts[some, None], axis=1).view(">u8").ravel()
    return out


def shingle_hashes(text: bytes, k: int = K) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    return [digest(joined[a:z], SEED) for a, z in zip([0, *(ends[:-k] + 1).tolist()], ends[k - 1 :].tolist(), strict=True)]


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, fingerprint long) of every row; a null or wordless text has 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = {"int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches, BLOCK_BYTES):
            found = np.zeros(len(texts), np.uint64)
            at = 0
            while at < len(texts):
                hashes, counts, n = [], [], 0
                while at + len(counts) < len(texts) and n < 400_000:
                    h = shingle_hashes(texts[at + len(counts)], k)
                    hashes.append(np.array(h, np.uint64))
                    counts.append(len(h))
                    n += len(h)
                found[at : at + len(counts)] = fingerprint(np.concatenate(hashes), np.array(counts))
                at += len(counts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, fingerprint long")


class VantageTree:
    """Vantage points over distinct points: a node's inner branch is within ``radius`` of its vantage point, its outer one beyond."""

    def __init__(self, points: np.ndarray, leaf: int, reach: int):
        self.points, self.reach = points.copy(), reach
        vantage, radius, inner, outer, first, last = [], [], [], [], [], []

        def node(a: int, b: int) -> int:
            for column, x in zip((vantage, radius, inner, outer, first, last), (0, -1, -1, -1, a, b), strict=True):
                column.append(x)
            return len(first) - 1

        todo = [node(0, len(points))]
        while todo:
            at = todo.pop()
            a, b = first[at], last[at]
            if b - a <= leaf or (found := self._split(self.points[a:b])) is None:
                continue
            vantage[at], radius[at] = found
            here = self.points[a:b]
            within = np.bitwise_count(here ^ np.uint64(vantage[at])) <= radius[at]
            self.points[a:b] = np.concatenate([here[within], here[~within]])
            middle = a + int(within.sum())
            inner[at], outer[at] = node(a, middle), node(middle, b)
            todo += [inner[at], outer[at]]
        self.vantage = np.array(vantage, np.uint64)
        self.radius, self.inner, self.outer, self.first, self.last = (np.array(x, np.int64) for x in (radius, inner, outer, first, last))
        self.leaf = self.inner < 0

    def _split(self, points: np.ndarray) -> tuple[int, int] | None:
        """The vantage point and radius that fewest queries have to cross, of some, with a quarter of the points on either side where that can be."""
        probe = points[:: max(1, len(points) // PROBE)]
        best = None
        for v in points[:: max(1, len(points) // TRIED)][:TRIED].tolist():
            seen = np.cumsum(np.bincount(np.bitwise_count(probe ^ np.uint64(v)), minlength=65 + self.reach))
            r = np.arange(64)
            near = seen[r]
            crossing = seen[np.minimum(r + self.reach, 64)] - np.where(r >= self.reach, seen[r - self.reach], 0)
            cost = crossing + np.maximum(0, len(probe) // 4 - np.minimum(near, len(probe) - near)) * 8 + np.where((near == 0) | (near == len(probe)), 1 << 30, 0)
            k = int(cost.argmin())
            if cost[k] < 1 << 30 and (best is None or cost[k] < best[0]):
                best = (cost[k], v, k)
        return None if best is None else best[1:]

    def homes(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point belongs to."""
        at = np.zeros(len(points), np.int64)
        while (deeper := np.flatnonzero(~self.leaf[at])).size:
            n = at[deeper]
            within = np.bitwise_count(points[deeper] ^ self.vantage[n]) <= self.radius[n]
            at[deeper] = np.where(within, self.inner[n], self.outer[n])
        return at

    def reached(self, points: np.ndarray, skipped=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, leaf) of each leaf that may hold a point within reach of a query; ``skipped(query, node)`` rules pairs out."""
        todo = [(np.arange(len(points)), np.zeros(len(points), np.int64))]
        while todo:
            query, at = todo.pop()
            if len(query) > FRONT:
                half = len(query) // 2
                todo += [(query[:half], at[:half]), (query[half:], at[half:])]
                continue
            if skipped is not None and len(query):
                keep = ~skipped(query, at)
                query, at = query[keep], at[keep]
            done = self.leaf[at]
            if done.any():
                yield query[done], at[done]
            query, at = query[~done], at[~done]
            if len(query):
                far = np.bitwise_count(points[query] ^ self.vantage[at]).astype(np.int64)
                inside, outside = far - self.reach <= self.radius[at], far + self.reach > self.radius[at]
                todo.append((np.r_[query[inside], query[outside]], np.r_[self.inner[at[inside]], self.outer[at[outside]]]))

    def matches(self, points: np.ndarray, skipped=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, place in self.points) of everything within reach."""
        for query, at in self.reached(points, skipped):
            sizes = self.last[at] - self.first[at]
            ends = np.cumsum(sizes)
            start = 0
            while start < len(at):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + FRONT)))
                n = sizes[start:stop]
                q = np.repeat(query[start:stop], n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[at[start:stop]], n)
                near = np.bitwise_count(points[q] ^ self.points[place]) <= self.reach
                yield q[near], place[near]
                start = stop


class Home:
    """The points of one shard, their tree and what is known of their components."""

    def __init__(self, points: np.ndarray, reach: int):
        self.tree = VantageTree(points, LEAF, reach)
        self.component = np.arange(len(points))

    def _merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.component[a], self.component[b]
            apart = x != y
            if not apart.any():
                return
            root = np.arange(len(self.component))
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(up := root[root], root):
                root = up
            self.component = root[self.component]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Each point of a component with the component's first one."""
        points, size, at = self.tree.points, 64, 0
        while at < len(points):
            batch = np.arange(at, min(len(points), at + size))
            own = self.component
            turns = np.r_[0, np.cumsum(own[1:] != own[:-1])]
            whole = turns[self.tree.first] == turns[np.maximum(self.tree.last - 1, self.tree.first)]
            kind = own[np.minimum(self.tree.first, len(own) - 1)]
            found = list(self.tree.matches(points[batch], lambda q, n, whole=whole, kind=kind, own=own, batch=batch: whole[n] & (kind[n] == own[batch[q]])))
            for q, place in found:
                self._merge(batch[q], place)
            at, size = at + size, min(4096, 2 * size)
        more = np.flatnonzero(self.component != np.arange(len(points)))
        return points[more], points[self.component[more]]

    def visited(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each visiting point with the first one of every component that it links with."""
        pairs = [np.zeros((0, 2), np.int64)]
        for q, place in self.tree.matches(points):
            pairs.append(np.unique(np.stack([q, self.component[place]], 1), axis=0))
        both = np.unique(np.concatenate(pairs), axis=0)
        return points[both[:, 0]], self.tree.points[both[:, 1]]


_DEALT = pa.schema([("shard", pa.int32()), ("visit", pa.int32()), ("points", pa.binary())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _deal(tree: VantageTree):
    """Points, packed, to the shard they live in and to those they visit."""
    shard = np.cumsum(tree.leaf) - 1

    def rows(points: np.ndarray) -> pa.RecordBatch:
        home = tree.homes(points)
        query, leaf = (np.concatenate(x) for x in zip(*tree.reached(points), strict=True))
        away = leaf != home[query]
        out = []
        for visit, which, where in ((0, points, home), (1, points[query[away]], leaf[away])):
            order = np.argsort(where, kind="stable")
            which, where = which[order], shard[where[order]]
            cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True]) if len(where) else [0]
            out += [(int(where[a]), visit, which[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return arrow_rows(_DEALT, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy().view(np.uint64))
            n += len(held[-1])
            if n >= POINTS:
                yield rows(np.concatenate(held))
                held, n = [], 0
        if n:
            yield rows(np.concatenate(held))

    return run


def _shard_links(reach: int):
    """Links of each shard of a task; its rows come together, those that live there first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=_LINK)

        shard, held, home = None, [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    if held and home is None:
                        yield from found(*Home(np.concatenate(held), reach).links())
                    shard, held, home = r["shard"], [], None
                points = np.frombuffer(r["points"], np.uint64)
                if not r["visit"]:
                    held.append(points)
                elif held:
                    if home is None:
                        home = Home(np.concatenate(held), reach)
                        yield from found(*home.links())
                    for at in range(0, len(points), 8192):
                        yield from found(*home.visited(points[at : at + 8192]))
        if held and home is None:
            yield from found(*Home(np.concatenate(held), reach).links())

    return run


def fingerprint_links(points: DataFrame, reach: int = REACH) -> DataFrame:
    """(a, b): of a stored table of distinct fingerprints, pairs within ``reach`` bits, enough of them to connect all that are."""
    count = points.count()
    shards = min(max(16, -(-count // HOME)), SAMPLE // SAMPLED)
    every = max(1, -(-count // (shards * SAMPLED)))
    sample = points.where(F.expr(f"pmod(xxhash64(fingerprint, 7), {every}) = 0")).limit(2 * SAMPLE)
    seen = np.sort(np.array([r[0] for r in sample.collect()], np.int64)).view(np.uint64)
    tree = VantageTree(seen, max(1, len(seen) // shards), reach)
    n = max(partitions(points.sparkSession), -(-int(tree.leaf.sum()) // 2))
    dealt = arrow_map(points.select("fingerprint"), _deal(tree), "shard int, visit int, points binary")
    return arrow_map(dealt.repartition(n, "shard").sortWithinPartitions("shard", "visit"), _shard_links(reach), "a long, b long")


def simhash_components(docs: DataFrame, k: int = K, reach: int = REACH) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    ``fingerprint`` is 16 hex digits, ``component_id`` the smallest doc_id reachable over fingerprints
    that differ in ``reach`` bits at most.  A null or wordless text has fingerprint zero and links like
    any other.  Repeated rows stay repeated; a null doc_id keeps its row and never names a component
    (null where no other could).  Extra columns are not read.  An empty table gives an empty one.
    """
    members = materialize(fingerprints(docs, k), "fingerprints")
    firsts = materialize(members.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "firsts")
    linked = connected_components(materialize(fingerprint_links(firsts, reach), "links"))
    named = firsts.join(linked, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("class"))
    lowest = named.groupBy("class").agg(F.min("first").alias("lowest"), F.count("*").alias("n")).where("n > 1").drop("n")
    merged = named.join(lowest, "class", "left").select(F.col("fingerprint").alias("k"), F.coalesce("lowest", "first").alias("component_id"))
    both = members.join(merged, F.col("fingerprint") == F.col("k"))
    return both.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
