"""The interval overlap join against plain loops, with nulls, ties, repeats, hot clients, empty tables and clashing columns."""

import random
import zlib
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from paperloom.llm import interval_join
from paperloom.llm.interval_join import RELATIONS, IntervalTree
from pyspark.sql import functions as F

CLICKS = "click_id long, ts timestamp_ntz, client_id long, kind string, key long, half long, open boolean"
SALES = "sale_id long, client_id long, status string, sold_at timestamp_ntz, shipped timestamp_ntz, key long"
LINES = "sale_id long, line_no int, shipped_at timestamp_ntz, status string"
T0 = datetime(2024, 1, 3)
EPOCH = datetime(1970, 1, 1)


def us(t):
    return (t - EPOCH) // timedelta(microseconds=1)


@pytest.fixture(scope="module")
def data():
    r = random.Random(3)
    clicks = [(None, None, 1, "view"), (1, T0, None, "error"), (2, EPOCH - timedelta(days=1, microseconds=1), 1, "error"), (3, T0, 1, None), (4, T0 + timedelta(minutes=30), 1, "error"), (5, T0 + timedelta(minutes=60, microseconds=1), 1, "view")]
    for client, n, step in ((1, 900, 40), (2, 60, 400), (3, 5, 3000), (9, 700, 20)):
        t = T0
        for i in range(n):
            t += timedelta(seconds=r.choice([0, 1, 600, 1800, 1801, step * 60]), microseconds=r.choice([0, 0, 1]))
            clicks += [(i, t, client, r.choice(["view", "error", "click", None]))] * r.choice([1, 1, 2])
    sales, lines = [(None, 1, "done", T0), (1, None, "done", T0), (2, 1, "open", None), (3, 77, "open", T0), (4, 1, None, EPOCH - timedelta(days=2)), (4, 1, "open", T0)], [(None, 1, T0), (4, 1, None)]
    for i in range(10, 260):
        t = T0 + timedelta(hours=r.randrange(900), seconds=r.randrange(3))
        sales += [(i, r.choice([1, 1, 1, 2, 3, 9]), r.choice(["open", "done", "held"]), t)] * (2 if i % 50 == 0 else 1)
        lines += [(i, j, t + timedelta(hours=r.choice([-30, 0, 6, 50, 300]))) for j in range(r.randrange(3))]
    return clicks, sales, lines


def plain_sessions(clicks):
    by = {}
    for _, t, client, kind in clicks:
        if t is not None and client is not None:
            by.setdefault(client, []).append((us(t), kind == "error"))
    for client, found in by.items():
        runs = []
        for t, bad in sorted(found):
            if runs and t - runs[-1][1] <= interval_join.PAUSE:
                runs[-1] = [runs[-1][0], t, bad or (t == runs[-1][1] and runs[-1][2])]
            else:
                runs.append([t, t, bad])
        yield from ((client, *x) for x in runs)


def plain(clicks, sales, lines):
    made = [(c, a // interval_join.SLOT, None if o else z // interval_join.SLOT, zlib.crc32(str(a).encode())) for c, a, z, o in plain_sessions(clicks)]
    out = {}
    far = 10**9
    for sale, client, status, sold in sales:
        if client is None or sold is None:
            continue
        ends = [us(sold), *(us(t) for s, _, t in lines if s is not None and s == sale and t is not None)]
        a, z = us(sold) // interval_join.SLOT, far if status == "open" else max(ends) // interval_join.SLOT
        for c, b, y, crc in made:
            y = far if y is None else y
            if c == client and a <= y and b <= z:
                name = RELATIONS[3 * ((a > b) - (a < b) + 1) + (z > y) - (z < y) + 1]
                n, slots, total = out.get((sale, name), (0, None, 0))
                if min(z, y) < far:
                    slots = (slots or 0) + min(z, y) - max(a, b) + 1
                out[sale, name] = (n + 1, slots, total + crc)
    return {(s, r, *v) for (s, r), v in out.items()}


@pytest.fixture(scope="module")
def tables(spark, data):
    clicks, sales, lines = data
    return (
        spark.createDataFrame([(*s, T0, 5) for s in sales], SALES).repartition(3),
        spark.createDataFrame([(*c, 4, 4, True) for c in clicks], CLICKS).repartition(3),
        spark.createDataFrame([(*x, "open") for x in lines], LINES),
    )


def test_sessions(tables, data):
    got = [tuple(r) for r in interval_join.sessions(tables[1]).collect()]
    assert len(got) == len(set(got)) and set(got) == set(plain_sessions(data[0]))


def test_overlaps(tables, data):
    got = interval_join.session_overlaps(*tables)
    assert got.columns == ["sale_id", "relation", "n_pairs", "overlap_slots", "sessions_crc"]
    rows = [tuple(r) for r in got.collect()]
    want = plain(*data)
    assert len(rows) == len(want) and set(rows) == want and {r[1] for r in want} == set(RELATIONS)


def test_hot_clients_are_dealt(tables, data, monkeypatch):
    monkeypatch.setattr(interval_join, "SHARD", 7)
    monkeypatch.setattr(interval_join, "DESCENT", 50)
    assert {tuple(r) for r in interval_join.session_overlaps(*tables).collect()} == plain(*data)


def test_other_session_zone(spark, tables, data):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert {tuple(r) for r in interval_join.session_overlaps(*tables).collect()} == plain(*data)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_empty_tables(tables):
    none = [t.where("false") for t in tables]
    for k in range(3):
        assert interval_join.session_overlaps(*(none[i] if i == k else tables[i] for i in range(3))).count() == (0 if k < 2 else interval_join.session_overlaps(tables[0], tables[1], none[2]).count())
    assert interval_join.session_overlaps(*none).count() == 0


def test_sql_agrees(tables, data):
    db = duckdb.connect()
    for name, t in zip(("sales", "clicks", "sale_lines"), tables, strict=True):
        pandas = t.toPandas()  # noqa: F841
        db.execute(f"CREATE TABLE {name} AS SELECT * FROM pandas")
    want = plain(*data)
    got = db.sql(interval_join.oracle_sql()).fetchall()
    assert len(got) == len(want) and {(None if s is None else int(s), *x) for s, *x in got} == want


def test_pairs(tables, data):
    sales, clicks, _ = tables
    queries = sales.where("client_id is not null and sold_at is not null").select(F.col("sale_id").alias("id"), F.col("client_id").alias("key"), interval_join.floored(interval_join.micros(sales, "sold_at"), interval_join.SLOT).alias("start"), F.lit(None).cast("long").alias("end"))
    spans = interval_join.sessions(clicks).select(F.col("client_id").alias("key"), interval_join.floored(F.col("first"), interval_join.SLOT).alias("start"), F.when(~F.col("open"), interval_join.floored(F.col("last"), interval_join.SLOT)).alias("end"))
    spans = spans.groupBy("key", "start", "end").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("total"))
    got = sorted(map(tuple, interval_join.interval_pairs(queries, spans).select("id", "key", "start", "end", "n").collect()), key=str)
    both = queries.alias("q").join(spans.alias("s"), (F.col("q.key") == F.col("s.key")) & (F.col("s.end").isNull() | (F.col("s.end") >= F.col("q.start"))))
    assert got and got == sorted(map(tuple, both.select("q.id", "q.key", "s.start", "s.end", "s.n").collect()), key=str)


def test_tree():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 8, 100, 1000):
        start = np.sort(r.integers(0, 500, n))
        end = start + r.integers(0, 90, n) * r.integers(0, 2, n)
        a = r.integers(-5, 510, 200)
        z = a + r.integers(0, 30, 200)
        q, p = IntervalTree(start, end).overlapping(a, z)
        want = {(i, j) for i in range(200) for j in range(n) if start[j] <= z[i] and end[j] >= a[i]}
        assert len(q) == len(want) and set(zip(q.tolist(), p.tolist(), strict=True)) == want
