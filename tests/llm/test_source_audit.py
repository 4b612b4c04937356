"""The source divergence audit against plain integer loops, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import random
import re

import duckdb
import pytest
from paperloom.llm import source_audit

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, shard int, item string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    words = ["Alpha", "beta", "Ünï", "É", "é", "日本", "x_y", "a1b", "　", "don't", "zz", "Rare", "\x7f", "😀q"]
    out = [(1, None, None, None), (2, "", "xx", "only"), (3, "--- 123", "xx", "other"), (4, "a A a", "yy", "one"), (5, "é" * 70_000 + " alpha" * 30_000, "en", "long")]
    for i in range(240):
        lang, source = r.choice(["en", "de", "", None]), r.choice(["a", "a", "a", "b", "Ä", "", None, "zz"])
        out.append((i, r.choice([" ", "\n", "-"]).join(r.choices(words[: 5 if source == "a" else 14], k=r.randrange(30))), lang, source))
    return [*out, out[-1], out[-1], (None, "alpha beta", "en", "late")]


def plain(rows, least, top):
    uses, docs, groups = collections.defaultdict(collections.Counter), collections.Counter(), set()
    for _, text, lang, source in rows:
        found = [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        group = (lang or "", source or "")
        groups.add(group)
        uses[group].update(found)
        docs.update((group[0], t) for t in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for k, t in docs if k == lang and docs[k, t] >= least)
        sources = sorted(s for k, s in groups if k == lang)
        total = collections.Counter()
        for s in sources:
            total.update(uses[lang, s])

        def p(counts):
            n = sum(counts[t] for t in kept)
            return [1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept]

        f = lambda a, b: (a - b) ** 2 // (a + b)
        own, q = {s: p(uses[lang, s]) for s in sources}, p(total)
        for s in sources:
            pairs = sorted((-sum(map(f, own[s], own[x])), x.encode()) for x in sources if x != s)
            terms = sorted((-f(a, b), t.encode()) for t, a, b in zip(kept, own[s], q, strict=True) if uses[lang, s][t] and a > b)[:top]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, x.decode(), -v, i + 1) for i, (v, x) in enumerate(ranked)]
    return sorted(out)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2, "i") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("least", "top"), [(10, 10), (1, 3), (10_000, 10)])
def test_divergence(docs, rows, least, top):
    got = source_audit.source_divergence(docs, least, top)
    assert [f"{k} {t}" for k, t in got.dtypes] == ["lang string", "source string", "part string", "item string", "value bigint", "rank int"]
    assert sorted(map(tuple, got.collect())) == plain(rows, least, top)


def test_blocks(docs, rows, monkeypatch):
    """Blocks of one text each give the same; run in this process, as workers don't see the patch."""
    monkeypatch.setattr(source_audit, "BLOCK_BYTES", 1)
    batches = docs.select("lang", "source", "text").na.fill("").toArrow().to_batches()
    found = collections.Counter()
    for b in source_audit._counts(iter(batches)):
        for r in b.to_pylist():
            found[r["lang"], r["source"], r["term"]] += r["n"]
    want = collections.Counter()
    for _, text, lang, source in rows:
        want.update((lang or "", source or "", t) for t in TERM.findall((text or "").encode().lower().decode()))
    assert found == want


def test_empty(docs):
    assert source_audit.source_divergence(docs.where("false")).count() == 0


def test_sql_agrees(docs, rows):
    pandas = docs.toPandas()  # noqa: F841
    db = duckdb.connect()
    db.execute("CREATE TABLE documents AS SELECT * FROM pandas")
    assert sorted(db.sql(source_audit.oracle_sql(10, 10)).fetchall()) == plain(rows, 10, 10)
