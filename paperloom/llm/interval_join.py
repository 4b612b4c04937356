"""Interval overlap join: sales meet the click sessions whose intervals share a slot of time.

1. Clicks shrink, before they travel, to one piece for each client and half hour (clicks of one half
   hour are at most 30 minutes apart, so they are one session).  Pieces of four days become sessions
   by a window; only sessions that touch the end of such a stretch meet across it.  A client that has a
   third of all clicks is so dealt over its stretches of time, and what one task holds of it is
   bounded by time, not by rows.
2. Sessions of a client with equal slots are one interval with a count and a sum.
3. Clients with many sales are dealt over several shards, each with a copy of the client's intervals.
   At most HOT clients can have more than 1/HOT of the sales, which bounds the broadcast list of them.
4. A shard sorts its intervals by (client, start) into one implicit tree: a node's subtree is a run of
   the array around it, and carries the latest end of that run.  Sales go past it in Arrow
   batches; one descent answers a batch.  Open ends are a sentinel beyond all slots of the client.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from paperloom.llm.shared import arrow_map, parts

MICROS = 1_000_000
#: A longer pause begins another session.
PAUSE = 30 * 60 * MICROS
#: Stretch of time in which sessions are made at once.
STRETCH = 192 * PAUSE
SLOT = 6 * 3600 * MICROS
#: More than total / HOT rows are of HOT keys at most; fewer than SHARD rows are never split.
HOT, SHARD = 16_384, 2_000
#: Slots of one client span less than this; the largest stands for an open end.
SPAN = 1 << 31
#: Intervals that may answer the queries of one descent, so that its arrays stay small.
DESCENT = 1_000_000
#: Names by 3 * (start against start) + (end against end), both 0, 1, 2 for earlier, equal, later.
RELATIONS = ("overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone counts as UTC, whatever the session's zone."""
    c = F.col(name)
    if not isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.unix_micros(c)
    seconds = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * MICROS + (F.expr(f"extract(SECOND FROM `{name}`)") * MICROS).cast("long")


def floored(c: Column, unit: int) -> Column:
    """``c`` in whole units, rounded down, in integers."""
    return F.call_function("div", c - F.pmod(c, F.lit(unit).cast("long")), F.lit(unit).cast("long"))


def sessions(clicks: DataFrame) -> DataFrame:
    """(client_id, first, last, open) of every session, in microseconds; ``open``: a click at ``last`` is an error."""
    known = clicks.where("client_id is not null and ts is not null").select("client_id", micros(clicks, "ts").alias("us"), F.coalesce(F.col("kind") == "error", F.lit(False)).alias("failed"))
    pieces = known.groupBy("client_id", floored(F.col("us"), PAUSE).alias("half")).agg(F.min("us").alias("first"), F.max(F.struct("us", "failed")).alias("end"))
    stretch = floored(F.col("half"), STRETCH // PAUSE)

    def joined(rows: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("first")
        late = F.col("first") - F.lag("end.us").over(order) > PAUSE
        named = rows.withColumn("begins", F.coalesce(late, F.lit(True)).cast("int")).withColumn("nr", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return named.groupBy(*keys, "nr").agg(F.min("first").alias("first"), F.max("end").alias("end")).drop("nr")

    within = joined(pieces.withColumn("stretch", stretch), "client_id", "stretch")
    near = (F.col("first") < F.col("stretch") * STRETCH + PAUSE) | (F.col("end.us") >= (F.col("stretch") + 1) * STRETCH - PAUSE)
    across = joined(within.where(near).drop("stretch"), "client_id")
    whole = within.where(~near).select("client_id", "first", "end").unionByName(across)
    return whole.select("client_id", "first", F.col("end.us").alias("last"), F.col("end.failed").alias("open"))


class IntervalTree:
    """An implicit augmented tree over intervals sorted by start, both ends inclusive.

    Node ``x`` of level ``k`` stands in the middle of the run of 2^(k+1) - 1 places that is its subtree,
    its children 2^(k-1) places to either side; ``latest[x]`` is the largest end in the run.
    """

    def __init__(self, start: np.ndarray, end: np.ndarray):
        self.n = len(start)
        self.top = max(0, self.n.bit_length() - 1)
        size = (2 << self.top) - 1
        self.start = np.full(size, np.iinfo(np.int64).max)
        self.end = np.full(size, np.iinfo(np.int64).min)
        self.start[: self.n], self.end[: self.n] = start, end
        self.latest = self.end.copy()
        for k in range(1, self.top + 1):
            x = np.arange((1 << k) - 1, size, 2 << k)
            side = 1 << (k - 1)
            self.latest[x] = np.maximum(self.end[x], np.maximum(self.latest[x - side], self.latest[x + side]))

    def overlapping(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of every overlap."""
        query = np.arange(len(start) if self.n else 0)
        node = np.full(len(query), (1 << self.top) - 1)
        queries, places = [], []
        for k in range(self.top, -1, -1):
            s, e = start[query], end[query]
            alive = (self.latest[node] >= s) & (self.start[node - ((1 << k) - 1)] <= e)
            query, node, s, e = query[alive], node[alive], s[alive], e[alive]
            before = self.start[node] <= e
            hit = before & (self.end[node] >= s)
            queries.append(query[hit])
            places.append(node[hit])
            if k:
                side = 1 << (k - 1)
                query, node = np.r_[query, query[before]], np.r_[node - side, node[before] + side]
        return np.concatenate(queries), np.concatenate(places)


class Shard:
    """The intervals (key, start, end or none, n, total) of some keys in one tree."""

    def __init__(self, table: pa.Table):
        key, start, end = (table[c].to_numpy() for c in ("key", "start", "end"))
        self.keys = np.unique(key)
        rank = np.searchsorted(self.keys, key)
        low, high = self._placed(rank, start), self._placed(rank, end)
        order = np.lexsort((high, low))
        order = order[np.r_[True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])]] if len(order) else order
        self.low, self.high = low[order], high[order]
        self.n, self.total = table["n"].to_numpy()[order], table["total"].to_numpy()[order]
        self.tree = IntervalTree(self.low, self.high)
        self.sizes = np.bincount(rank[order], minlength=len(self.keys))

    @staticmethod
    def _placed(rank: np.ndarray, slot: np.ndarray) -> np.ndarray:
        return rank * SPAN + np.minimum(slot + (SPAN >> 1), SPAN - 1)

    def answers(self, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of the query, relation, place) of every overlap, some queries at a time."""
        rank = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        found = np.flatnonzero(self.keys[rank] == key) if len(self.keys) else np.zeros(0, np.int64)
        low, high = self._placed(rank[found], start[found]), self._placed(rank[found], end[found])
        cost = np.cumsum(self.sizes[rank[found]])
        at = 0
        while at < len(found):
            stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + DESCENT)))
            query, place = self.tree.overlapping(low[at:stop], high[at:stop])
            query += at
            code = 3 * (np.sign(low[query] - self.low[place]) + 1) + np.sign(high[query] - self.high[place]) + 1
            yield found[query], code, place
            at = stop

    def shared(self, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots shared with the interval at each place, and whether they are endless."""
        base = (SPAN >> 1) - 1
        a, b = start, self.low[place] % SPAN - base - 1
        c, d = np.minimum(end, base), self.high[place] % SPAN - base - 1
        return np.minimum(c, d) - np.maximum(a, b) + 1, (c == base) & (d == base)


#: In place of an end that is not there.
OPEN = SPAN


def _dealt(queries: DataFrame, intervals: DataFrame, keys: DataFrame | None) -> DataFrame:
    """Intervals and queries by shard of their key, intervals first; ``keys``: a cheaper table with the keys of the queries."""
    counts = (queries if keys is None else keys).groupBy("key").agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    least = max(SHARD, -(-total // HOT))
    hot = F.broadcast(counts.where(F.col("rows") > least).select("key", F.ceil(F.col("rows") / least).cast("int").alias("shards")))
    kind = queries.schema["id"].dataType
    held = intervals.join(hot, "key", "left").withColumn("shard", F.explode(F.expr("sequence(0, coalesce(shards, 1) - 1)")))
    asked = queries.join(hot, "key", "left").withColumn("shard", F.expr("cast(pmod(xxhash64(id, start, end), coalesce(shards, 1)) as int)"))
    rows = held.select(F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("id"), "key", "shard", "start", "end", "n", "total").unionByName(
        asked.select(F.lit(1).alias("kind"), "id", "key", "shard", "start", "end", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"))
    )
    rows = rows.withColumn("end", F.coalesce("end", F.lit(OPEN).cast("long")))
    return rows.repartition(parts(queries), "key", "shard").sortWithinPartitions("kind")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Shard, pa.RecordBatch]]:
    """The shard of a task, which comes first, with each batch of queries."""
    held, shard = [], None
    for batch in batches:
        split = int(np.searchsorted(batch["kind"].to_numpy(), 1))
        if split:
            held.append(batch.slice(0, split))
        if split < batch.num_rows and held:
            shard = shard or Shard(pa.Table.from_batches(held))
            yield shard, batch.slice(split)


def interval_pairs(queries: DataFrame, intervals: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(id, key, relation, start, end, n, total): each query (id, key, start, end) with each interval (key, start, end, n, total) that shares a slot with it.

    Keys and slots are long, ends inclusive and null if open; intervals of one key differ in start or end.
    """
    kind = queries.schema["id"].dataType.simpleString()

    def run(batches):
        for shard, b in _asked(batches):
            key, start, end = (b[c].to_numpy() for c in ("key", "start", "end"))
            for row, code, place in shard.answers(key, start, end):
                low, high = shard.low[place] % SPAN - (SPAN >> 1), shard.high[place] % SPAN
                yield pa.RecordBatch.from_arrays(
                    [b["id"].take(pa.array(row)), pa.array(key[row]), pa.array(np.array(RELATIONS, object)[code], pa.string()), pa.array(low), pa.array(high - (SPAN >> 1), mask=high == SPAN - 1), pa.array(shard.n[place]), pa.array(shard.total[place])],
                    names=["id", "key", "relation", "start", "end", "n", "total"],
                )

    return arrow_map(_dealt(queries, intervals, keys), run, f"id {kind}, key long, relation string, start long, end long, n long, total long")


def interval_relations(queries: DataFrame, intervals: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(id, relation, n, shared, total) by query id and relation: intervals, slots shared and the intervals' totals, summed.

    ``shared`` is null where both are open at their ends.  As in :func:`interval_pairs`, but pairs are
    summed where they are found; rows with equal id are summed, too.
    """
    kind = queries.schema["id"].dataType.simpleString()

    def run(batches):
        for shard, b in _asked(batches):
            key, start, end = (b[c].to_numpy() for c in ("key", "start", "end"))
            ids = b["id"]
            for row, code, place in shard.answers(key, start, end):
                slots, endless = shard.shared(start[row], end[row], place)
                group, which = np.unique(row * 9 + code, return_inverse=True)
                sums = [np.zeros(len(group), np.int64) for _ in range(4)]
                n = shard.n[place]
                for out, x in zip(sums, (n, np.where(endless, 0, slots * n), shard.total[place], ~endless * n), strict=True):
                    np.add.at(out, which, x)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(group // 9)), pa.array((group % 9).astype(np.int8)), pa.array(sums[0]), pa.array(sums[1], mask=sums[3] == 0), pa.array(sums[2])], names=["id", "code", "n", "shared", "total"])

    found = arrow_map(_dealt(queries, intervals, keys), run, f"id {kind}, code byte, n long, shared long, total long")
    name = F.element_at(F.array(*map(F.lit, RELATIONS)), F.col("code").cast("int") + 1)
    return found.groupBy("id", "code").agg(F.sum("n").alias("n"), F.sum("shared").alias("shared"), F.sum("total").alias("total")).select("id", name.alias("relation"), "n", "shared", "total")


def session_overlaps(sales: DataFrame, clicks: DataFrame, sale_lines: DataFrame) -> DataFrame:
    """(sale_id, relation, n_pairs, overlap_slots, sessions_crc) of sales and their client's click sessions.

    Rows without client or time are ignored, as are lines without a sale or a time; a sale without lines ends when
    it is sold.  Rows of an equal (or null) sale_id are summed.  Extra columns are not read; empty tables give an
    empty one.
    """
    shipped = sale_lines.where("sale_id is not null and shipped_at is not null").select("sale_id", micros(sale_lines, "shipped_at").alias("us")).groupBy("sale_id").agg(F.max("us").alias("shipped"))
    sold = sales.where("client_id is not null and sold_at is not null").select("sale_id", "client_id", (F.coalesce(F.col("status") == "open", F.lit(False))).alias("open"), micros(sales, "sold_at").alias("sold"))
    ends = F.greatest("sold", "shipped")
    queries = sold.join(shipped, "sale_id", "left").select(
        F.col("sale_id").alias("id"), F.col("client_id").cast("long").alias("key"), floored(F.col("sold"), SLOT).alias("start"), F.when(~F.col("open"), floored(ends, SLOT)).alias("end")
    )
    made = sessions(clicks).select(
        F.col("client_id").cast("long").alias("key"), floored(F.col("first"), SLOT).alias("start"), F.when(~F.col("open"), floored(F.col("last"), SLOT)).alias("end"), F.crc32(F.col("first").cast("string").cast("binary")).alias("crc")
    )
    intervals = made.groupBy("key", "start", "end").agg(F.count("*").alias("n"), F.sum("crc").alias("total"))
    found = interval_relations(queries, intervals, sold.select(F.col("client_id").cast("long").alias("key")))
    return found.select(F.col("id").alias("sale_id"), "relation", F.col("n").alias("n_pairs"), F.col("shared").alias("overlap_slots"), F.col("total").alias("sessions_crc"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL, pair by pair; CRC-32 by its table of 256 remainders."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS c FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, k + 1, {step} FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
c AS (SELECT client_id, epoch_us(ts) AS us, coalesce(kind = 'error', false) AS failed FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY client_id ORDER BY us) <= {PAUSE} THEN 0 ELSE 1 END AS fresh FROM c),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY client_id ORDER BY us, fresh DESC ROWS UNBOUNDED PRECEDING) AS nr FROM b),
e AS (SELECT *, max(us) OVER (PARTITION BY client_id, nr) AS last FROM n),
s AS (SELECT client_id, min(us) AS first, last, bool_or(failed AND us = last) AS open FROM e GROUP BY client_id, nr, last),
sessions AS (SELECT client_id, first // {SLOT} AS a, CASE WHEN open THEN {OPEN} ELSE last // {SLOT} END AS z,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(first AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda x, y: xor(x >> 8, t[CAST(xor(x, y) & 255 AS INTEGER) + 1])), 4294967295) AS crc
  FROM s, crcs),
ships AS (SELECT sale_id, max(epoch_us(shipped_at)) AS shipped FROM sale_lines GROUP BY sale_id),
sold AS (SELECT sale_id, client_id, epoch_us(sold_at) // {SLOT} AS a, CASE WHEN status = 'open' THEN {OPEN} ELSE greatest(epoch_us(sold_at), ships.shipped) // {SLOT} END AS z
  FROM sales LEFT JOIN ships USING (sale_id) WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
p AS (SELECT sale_id, CASE WHEN l.a < r.a THEN CASE WHEN l.z < r.z THEN 'overlaps' WHEN l.z = r.z THEN 'finished_by' ELSE 'contains' END
  WHEN l.a = r.a THEN CASE WHEN l.z < r.z THEN 'starts' WHEN l.z = r.z THEN 'equals' ELSE 'started_by' END
  ELSE CASE WHEN l.z < r.z THEN 'during' WHEN l.z = r.z THEN 'finishes' ELSE 'overlapped_by' END END AS relation,
  CASE WHEN l.z < {OPEN} OR r.z < {OPEN} THEN least(l.z, r.z) - greatest(l.a, r.a) + 1 END AS shared, crc
  FROM sold l JOIN sessions r ON l.client_id = r.client_id AND l.a <= r.z AND r.a <= l.z)
SELECT sale_id, relation, count(*) AS n_pairs, CAST(sum(shared) AS BIGINT) AS overlap_slots, CAST(sum(crc) AS BIGINT) AS sessions_crc FROM p GROUP BY sale_id, relation
"""
