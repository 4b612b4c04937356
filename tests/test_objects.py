"""Reference chains and inherited attributes against plain walks, with cycles, dangling ends, freed numbers, nulls and empty tables."""

import random

from paperloom.operators import objects

OBJECT = "doc int, num long, rev int, gen int, free boolean, to long, to_gen int, value string"


def walk(live, doc, num):
    seen, at = [num], num
    while True:
        gen, to, to_gen, value = live[doc, at]
        if to is None:
            return at, len(seen) - 1, "value", value
        if (doc, to) not in live or (live[doc, to][0] or 0) != (to_gen or 0):
            return to, len(seen) - 1, "dangling", None
        if to in seen:
            return None, None, "cycle", None
        seen.append(to)
        at = to


def test_chains(spark):
    r = random.Random(4)
    rows = [(None, 1, 0, 0, False, 2, 0, None), (1, None, 0, 0, False, 2, 0, None)]
    for doc, n in ((1, 1), (2, 200), (3, 40), (4, 7)):
        for num in range(n):
            to = num + 1 if doc == 2 else r.choice([None, r.randrange(n + 2), r.randrange(n)])
            rows.append((doc, num, 0, r.choice([0, None]), None, to if num < 199 else None, r.choice([0, None]), f"v{num}"))
            if doc == 3 and num % 4 == 0:
                rows.append((doc, num, 1, num % 8 // 4, num % 16 == 8, r.randrange(n), 0, f"w{num}"))
    live = {}
    for doc, num, rev, gen, free, to, to_gen, value in rows:
        if doc is not None and num is not None and (doc, num) not in live or (doc, num) in live and rev:
            live[doc, num] = (gen, to, to_gen, value, free)
    live = {k: v[:4] for k, v in live.items() if not v[4]}
    got = {(x["doc"], x["num"]): (x["end"], x["hops"], x["state"], x["value"]) for x in objects.resolved(spark.createDataFrame(rows, OBJECT)).collect()}
    assert got == {k: walk(live, *k) for k in live}
    assert got[2, 0] == (199, 199, "value", "v199") and {v[2] for v in got.values()} == {"value", "dangling", "cycle"}
    assert objects.resolved(spark.createDataFrame([], OBJECT)).count() == 0


def test_inherited(spark):
    schema = "doc int, num long, parent long, pos int, a string, b string"
    rows = [(1, 0, None, 0, "root", None), (1, 1, 0, 1, None, "one"), (1, 2, 1, 0, None, None), (1, 3, 2, 5, "deep", None), (1, 7, 99, 0, "lost", None), (1, 8, 9, 0, None, None), (1, 9, 8, 0, None, None), (2, 0, None, 3, None, None)]
    rows += [(3, i, i - 1 if i else None, 0, "top" if i == 0 else None, str(i) if i == 20 else None) for i in range(70)]
    got = {(x["doc"], x["num"]): (x["path"], x["a"], x["b"]) for x in objects.inherited(spark.createDataFrame(rows, schema), ["a", "b"]).collect()}
    assert got[1, 3] == ([0, 1, 0, 5], "deep", "one") and got[1, 2] == ([0, 1, 0], "root", "one") and got[2, 0] == ([3], None, None)
    assert (1, 7) not in got and (1, 8) not in got and len(got) == 4 + 1 + 70
    assert got[3, 69] == ([0] * 70, "top", "20") and got[3, 19][2] is None


def test_page_table(spark):
    schema = "doc int, num long, parent long, pos int, leaf boolean, media array<double>, crop array<double>, rotate int"
    rows = [(1, 0, None, 0, False, [0.0, 0.0, 200.0, 100.0], None, 90), (1, 1, 0, 1, True, None, [10.0, 90.0, 500.0, -5.0], None), (1, 2, 0, 0, True, None, [300.0, 0.0, 400.0, 50.0], -90), (1, 3, 0, 2, True, [9.0, 9.0, 0.0, 0.0], None, 45), (2, 5, None, 0, True, None, None, None)]
    got = [tuple(x) for x in objects.page_table(spark.createDataFrame(rows, schema)).orderBy("doc", "page").collect()]
    assert got == [
        (1, 1, 2, 0.0, 0.0, 612.0, 792.0, 270, 792.0, 612.0),
        (1, 2, 1, 10.0, 0.0, 200.0, 90.0, 90, 90.0, 190.0),
        (1, 3, 3, 0.0, 0.0, 9.0, 9.0, 0, 9.0, 9.0),
        (2, 1, 5, 0.0, 0.0, 612.0, 792.0, 0, 612.0, 792.0),
    ]
