"""Best-fit packing: training sequences from documents, by a configuration program.

Documents become pieces of at most ``capacity`` tokens.  Only the histogram of piece lengths
(``capacity`` numbers at most) goes to the driver, where a linear program over configurations
(what fills one sequence) is solved by multiplicative weights, its columns priced by a knapsack
dynamic program over length classes, and rounded down; what rounding leaves is priced and solved
again.  The last few pieces go through best fit, still by length and count.  Pieces then take their
places by their rank among those of equal length, in one join on unique keys.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.encoding import SpacedEncoder
from paperloom.llm.shared import arrow_map, materialize, partitions

#: Ranks of one length that one plan row covers; longer runs are cut so that no task expands one alone.
RUN = 5000
#: Parts of one length's pieces that are ranked apart, for each shuffle partition.
SALTS = 4
#: Configurations that one solution of the program buys, at most.
ROUNDS = 500
#: More distinct lengths than these are put into classes of capacity / 512.
FEW = 64
#: Of so many sequences that the program bought, one may be packed anew with what is left.
REOPENED = 8


def _by_items(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, (size, value) in enumerate(zip(sizes.tolist(), values.tolist(), strict=True)):
        # rooms with the same rest, down the columns: each row has room for one item more
        rows = -(-(capacity + 1) // size)
        grid = np.full(rows * size, -np.inf)
        grid[: capacity + 1] = best
        rise = np.arange(rows)[:, None] * value
        found = (np.maximum.accumulate(grid.reshape(rows, size) - rise) + rise).ravel()[: capacity + 1]
        better = found > best * (1 + 1e-12)
        best[better], taken[better] = found[better], i
    return taken


def _by_rooms(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fitting[c]:
            gains = best[c - sizes[:k]] + values[:k]
            i = int(gains.argmax())
            if gains[i] > best[c]:
                best[c], taken[c] = gains[i], i
    return taken


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> Counter:
    """The most valuable multiset of items that fits; sizes ascend, values are positive.  Returns item -> count.

    Item by item for all rooms at once, or, where there are many items, room by room for all items.
    """
    taken = (_by_items if 4 * len(sizes) < capacity else _by_rooms)(sizes, values, capacity)
    out, c = Counter(), capacity
    while c > 0:
        if (i := int(taken[c])) < 0:
            c -= 1
        else:
            out[i] += 1
            c -= int(sizes[i])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = 6.0) -> list[tuple[Counter, float]]:
    """A fractional cover of the demand: (configuration, times), by multiplicative weights.

    Prices start at the sizes (the volume dual) and fall as a class is covered ahead of the
    others; each round buys the configuration that the knapsack finds most valuable.
    """
    step = float((sizes * demand).sum()) / capacity / rounds
    covered, bought = np.zeros(len(sizes)), defaultdict(float)
    for t in range(rounds):
        price = sizes * np.exp(np.clip(-rate * (covered / demand - t / rounds), -60, 60))
        chosen = knapsack(sizes, price, capacity)
        bought[tuple(sorted(chosen.items()))] += step
        for i, n in chosen.items():
            covered[i] += n * step
    return [(Counter(dict(c)), x) for c, x in bought.items()]


def best_fit(bins: list[tuple[tuple[int, ...], int]], left: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Puts the lengths left over, longest first, where the least room remains, else into new bins.

    Bins are (lengths inside, how many such bins); equal bins move together.
    """
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for inside, n in bins:
        by_room[capacity - sum(inside)].append((inside, n))
    rooms = sorted(by_room)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(n, each)
                new = [((length,) * each, full), ((length,) * rest, 1)]
                n = 0
            else:
                inside, count = by_room[rooms[at]].pop()
                took = min(n, count)
                if took < count:
                    by_room[rooms[at]].append((inside, count - took))
                if not by_room[rooms[at]]:
                    del by_room[rooms.pop(at)]
                new = [((*inside, length), took)]
                n -= took
            for inside, count in new:
                if count and inside:
                    room = capacity - sum(inside)
                    if room not in by_room:
                        insort(rooms, room)
                    by_room[room].append((inside, count))
    return [b for room in rooms for b in by_room[room]]


def realised(chosen: list[tuple[list[int], int]], free: dict[int, int], capacity: int, unit: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for (classes, times), as far as ``free`` (length -> count, reduced here) has pieces for them.

    Each class gives its longest piece that is free; from the shortest on, a piece is then changed for
    the longest that the sequence still has room for, so little of it stays empty.
    """
    lengths = sorted(free)
    bins: list[tuple[tuple[int, ...], int]] = []
    for classes, todo in chosen:
        while todo:
            inside: Counter = Counter()
            for c in sorted(classes, reverse=True):
                at = bisect_right(lengths, c * unit) - 1
                while at >= 0 and lengths[at] > (c - 1) * unit and free[lengths[at]] <= inside[lengths[at]]:
                    at -= 1
                if at < 0 or lengths[at] <= (c - 1) * unit:
                    break
                inside[lengths[at]] += 1
            else:
                room = capacity - sum(x * n for x, n in inside.items())
                for short in sorted(inside):
                    if not room:
                        break
                    inside[short] -= 1
                    at = bisect_right(lengths, short + room) - 1
                    while free[lengths[at]] <= inside[lengths[at]]:
                        at -= 1
                    inside[lengths[at]] += 1
                    room -= lengths[at] - short
                n = min(todo, *(free[x] // k for x, k in inside.items() if k))
                bins.append((tuple(sorted(inside.elements(), reverse=True)), n))
                for x, k in inside.items():
                    if k:
                        free[x] -= k * n
                        if not free[x]:
                            del free[x], lengths[bisect_left(lengths, x)]
                todo -= n
                continue
            break
    return bins


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences) for all lengths of the histogram.

    The program is solved and rounded down; it is solved again, with new prices, on the pieces that
    rounding leaves, until a solution places none.  What then remains (a few pieces that no configuration
    holds in whole numbers) goes through best fit; where that needs more sequences than the volume does,
    the last bought sequences, one in REOPENED at most, are packed anew together with it.
    """
    free = {length: n for length, n in histogram.items() if n}
    unit = max(1, capacity // 512) if len(free) > FEW else 1
    bins: list[tuple[tuple[int, ...], int]] = []
    while free:
        demand: Counter = Counter()
        for length, n in free.items():
            demand[-(-length // unit)] += n
        sizes = np.array(sorted(demand))
        wanted = np.array([demand[s] for s in sizes.tolist()], float)
        rounds = min(ROUNDS, max(1, int((sizes * wanted).sum() * unit // capacity)))
        solved = sorted(configurations(sizes, wanted, capacity // unit, rounds), key=lambda x: (-x[1], sorted(x[0].items())))
        more = realised([([int(sizes[i]) for i, n in chosen.items() for _ in range(n)], int(times + 1e-9)) for chosen, times in solved], free, capacity, unit)
        if not more:
            break
        bins += more
    total = sum(n for _, n in bins)
    least = -(-sum(x * n for x, n in histogram.items()) // capacity)
    best = best_fit(bins, Counter(free), capacity)
    opened = 1
    while sum(n for _, n in best) > least and opened <= total // REOPENED:
        kept, pieces, todo = list(bins), Counter(free), opened
        while todo:
            inside, n = kept.pop()
            took = min(n, todo)
            if took < n:
                kept.append((inside, n - took))
            for x in inside:
                pieces[x] += took
            todo -= took
        again = best_fit(kept, pieces, capacity)
        best = min(best, again, key=lambda b: sum(n for _, n in b))
        opened *= 2
    return best


def plan_rows(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): the rank-th piece of a length goes to a place."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for inside, n in bins:
        offset = 0
        for length in inside:
            for at in range(0, n, RUN):
                rows.append((length, taken[length] + at, min(RUN, n - at), sequence + at, offset))
            taken[length] += n
            offset += length
        sequence += n
    return rows


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each text's ids followed by ``end_id``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = SpacedEncoder.of(tokenizer_path)
        for batch in batches:
            take, piece, start, length, crc = [], [], [], [], []
            for i, found in enumerate(encoder.encode_batch([t or "" for t in batch.column(1).to_pylist()])):
                ids = np.append(found.astype("<u4"), np.uint32(end_id)).astype("<u4")
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    take.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of ``docs`` is packed.

    A null text is empty and makes one piece, the end id alone.  Only texts of more than
    ``capacity`` ids are cut.  Repeated rows are packed as often as they come, null doc_ids too;
    extra columns are not read; an empty table gives an empty one.  Offsets of a sequence have no gaps.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    salted = pieces.withColumn("salt", F.expr(f"cast(pmod(xxhash64(doc_id, piece, ids_crc32), {SALTS * partitions(spark)}) as int)"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan_rows(plan(histogram, capacity))
    schema = "length long, first long, ranks long, sequence long, offset long"
    runs = spark.createDataFrame(pa.table(list(map(pa.array, zip(*rows, strict=True))), names=["length", "first", "ranks", "sequence", "offset"]).to_pandas(), schema) if rows else spark.createDataFrame([], schema)
    places = runs.withColumn("i", F.explode(F.expr("sequence(0L, ranks - 1)"))).select("length", (F.col("first") + F.col("i")).alias("rank"), (F.col("sequence") + F.col("i")).alias("sequence_id"), "offset")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("r", F.row_number().over(within)).join(before, ["length", "salt"]).withColumn("rank", F.col("r") - 1 + F.col("before"))
    return ranked.join(places, ["length", "rank"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
