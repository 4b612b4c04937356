"""SimHash near-dedup against all pairs, with nulls, empty and long texts, ties, repeats, crowds, empty tables and clashing columns."""

import random

import brute
import numpy as np
import pytest
import xxhash
from paperloom.llm import simhash
from paperloom.llm.registry import QUERIES
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, fingerprint string, k long, first long, component_id long, n long"


def plain_fingerprint(text):
    words = brute.WORDS.findall(brute.lowered(text))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    values = np.array(prints, np.uint64)
    links = [(i, j) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 2) + i + 1]
    comp = brute.union_find(len(rows), links)
    lowest = {}
    for (doc, _), c in zip(rows, comp, strict=True):
        if doc is not None:
            lowest[c] = min(doc, lowest.get(c, doc))
    return [(doc, f"{p:016x}", lowest.get(c)) for (doc, _), p, c in zip(rows, prints, comp, strict=True)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdeéß", k=r.randint(1, 6)))
    texts = [None, "", " \n\t\x0b\x0c\r", "one", "ONE", "two words", "a b c", "A  b\nc", "\x1c a\x1fb\x85c　d", "日本語 の 文", "x" * 5000, "x " * 3000, "É é"]
    for _ in range(12):
        base = [word() for _ in range(r.choice([40, 400, 2000]))]
        for _ in range(r.choice([1, 3, 12])):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
            texts += [" ".join(w)] * r.choice([1, 1, 2])
    found = list(enumerate(texts))
    return [*found, (3, "one"), (None, "one"), (None, "only here " + " ".join(word() for _ in range(50))), (9_000, texts[20])]


def order(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def test_components(spark, rows):
    docs = spark.createDataFrame([(*r, "f", 1, 2, 3, 4) for r in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, simhash.simhash_components(docs).collect()), key=order)
    assert got == sorted(plain(rows), key=order)
    assert any(c is not None and c != d for d, _, c in got if d is not None)
    assert simhash.simhash_components(docs.where("false")).count() == 0


def test_fingerprints_agree_with_sparks_hash(spark):
    """A text of one shingle has that shingle's hash, which is the engine's own of a string."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["one", "two words", "a b c", "日本語 の 文", "é" * 100])], "doc_id long, text string")
    assert sorted(map(tuple, simhash.fingerprints(df).collect())) == sorted(map(tuple, df.select("doc_id", F.xxhash64("text")).collect()))


def points(n, seed):
    """Strangers, pairs within and just beyond reach, and a crowd around one point."""
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**64, n, dtype=np.uint64)
    flip = lambda p, bits: p ^ np.bitwise_or.reduce(np.uint64(1) << r.choice(64, bits, replace=False).astype(np.uint64))
    near = [flip(p, int(r.integers(1, 5))) for p in base[: n // 3]]
    crowd = [flip(base[0], int(r.integers(1, 6))) for _ in range(n // 3)]
    return np.unique(np.concatenate([base, near, crowd, np.zeros(1, np.uint64)]).astype(np.uint64))


def components(values, links):
    at = {int(v): i for i, v in enumerate(values)}
    return brute.union_find(len(values), [(at[int(a)], at[int(b)]) for a, b in links])


@pytest.mark.parametrize(("shape", "home"), [(1500, 16_384), (900, 20)])
def test_links_over_shards(spark, monkeypatch, shape, home):
    """However many shards the points are dealt over, the components are those of all pairs."""
    monkeypatch.setattr(simhash, "HOME", home)
    values = points(shape, home)
    want = [(values[i], values[j]) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 2) + i + 1]
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint long").repartition(3)
    got = np.array([tuple(r) for r in simhash.fingerprint_links(df).collect()], np.int64).view(np.uint64)
    assert components(values, got) == components(values, want)


def test_tree_finds_all(monkeypatch):
    values = points(3000, 9)
    tree = simhash.VantageTree(values, 16, 2)
    monkeypatch.setattr(simhash, "FRONT", 5000)
    found = set()
    asked = values[::7]
    for q, place in tree.matches(asked):
        found |= set(zip(asked[q].tolist(), tree.points[place].tolist(), strict=True))
    want = {(int(a), int(values[j])) for a in asked for j in np.flatnonzero(np.bitwise_count(values ^ a) <= 2)}
    assert found == want


def test_query_over_whole_table(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_simhash_dedup"](spark, path).collect())) == sorted(plain(rows))
