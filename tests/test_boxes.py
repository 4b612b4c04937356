"""Boxes, rectangles of text, spanning tables and redaction, against plain loops."""

import random

import pytest
from paperloom.functions.text import masked
from paperloom.operators import boxes, redact
from paperloom.operators.tables import spanning_tables
from paperloom.operators.text import pattern_spans
from pyspark.sql import functions as F

BOX = "doc int, page int, id int, x0 double, y0 double, x1 double, y1 double"


@pytest.fixture(scope="module")
def places(spark):
    r = random.Random(6)
    rows = []
    for i in range(260):
        x, y = r.choice([-50.0, 0.0, 71.5, 72.0, 144.0, r.uniform(-100, 600)]), r.choice([0.0, 36.0, 72.0, r.uniform(-100, 700)])
        rows.append((1, r.randrange(3), i, x, y, x + r.choice([0.0, 1.0, 72.0, 300.0]), y + r.choice([0.0, 12.0, 72.0, 90.0])))
    rows += [(1, 0, 900, 20_000.0, 0.0, 20_010.0, 10.0), (1, 0, 901, 20_005.0, 5.0, 20_020.0, 20.0), (1, 0, 902, None, 0.0, 1.0, 1.0), (1, 0, 903, float("nan"), 0.0, 1.0, 1.0), (1, 0, 904, 50.0, 50.0, 0.0, 0.0), (1, None, 905, 0.0, 0.0, 600.0, 600.0)]
    return rows, spark.createDataFrame(rows, BOX)


def sound(r):
    return r[1] is not None and all(v is not None and v == v for v in r[3:]) and r[3] <= r[5] and r[4] <= r[6]


def over(a, b, slack):
    return a[1] == b[1] and min(a[5], b[5]) - max(a[3], b[3]) > slack and min(a[6], b[6]) - max(a[4], b[4]) > slack


@pytest.mark.parametrize("slack", [0.0, 1.0])
def test_overlapping(places, slack):
    rows, df = places
    got = [tuple(r)[2:] for r in boxes.overlapping(df, df, ["doc", "page"], slack).collect()]
    good = [r for r in rows if sound(r)]
    assert len(got) == len(set(got)) and set(got) == {(a[2], b[2]) for a in good for b in good if over(a, b, slack)}


def test_greedy_choice(places, spark):
    rows, df = places
    taken = [(1, p, 0, 300.0, 0.0, 330.0, 700.0) for p in range(3)]
    kept, out = [], []
    for r in rows:
        if r[1] is None or not sound(r):
            out.append(r[2])  # overlaps nothing
        elif not any(over(r, k, 0.0) for k in [*taken, *kept]):
            kept.append(r)
            out.append(r[2])
    got = boxes.without_overlaps(df, spark.createDataFrame(taken, BOX), ["doc", "page"])
    assert sorted(r["id"] for r in got.collect()) == sorted(out)
    empty = df.where("false")
    assert boxes.without_overlaps(df, df, ["doc", "page"]).where("id < 900 and x1 > x0 and y1 > y0").count() == 0
    assert boxes.without_overlaps(empty, df, ["doc", "page"]).count() == 0


def test_rectangle_text(spark):
    glyph = "page int, i long, line long, text string, space_before boolean, x0 double, y0 double, x1 double, y1 double"
    lines = [(0, "Name Age", 0.0, 0.0), (1, "Total", 300.0, 1.0), (2, "far", 0.0, 40.0)]
    rows = [(1, 100 * n + k, n, c, k > 0 and s[k - 1] == " ", x + 6 * k, y, x + 6 * k + 5, y + 10) for n, s, x, y in lines for k, c in enumerate(s) if c != " "]
    areas = [(1, 7, -5.0, -5.0, 500.0, 60.0), (1, 8, 8.0, -5.0, 500.0, 20.0), (1, 9, 900.0, 0.0, 950.0, 9.0)]
    got = boxes.box_texts(spark.createDataFrame(rows, glyph), spark.createDataFrame(areas, "page int, id int, x0 double, y0 double, x1 double, y1 double"), ["page"])
    assert {r["box"]: r["text"] for r in got.collect()} == {7: "Name Age\tTotal\nfar", 8: "ame Age\tTotal"}


def test_spanning_tables(spark):
    def block(text, x, y, wide=40.0, high=10.0, page=1):
        return page, text, float(x), float(y), float(x + wide), float(y + high)

    rows = [block("caption", 500, 0, 90)]
    rows += [block("head", 100, 10, 150)]
    rows += [block(f"{r}{c}", 100 * c + (r % 2) * 1.5, 30 + 20 * r) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    rows += [block("again", 30, 71), block("foot", 0, 90, 130), block("prose", 0, 120, 10), block(" ", 100, 120), (1, "lost", None, 0.0, 1.0, 1.0)]
    rows += [block("two", 0, 0, page=2), block("cols", 100, 0, page=2), block("few", 0, 20, page=2), block("rows", 100, 20, page=2)]
    got = spanning_tables(spark.createDataFrame(rows, "page int, text string, x0 double, y0 double, x1 double, y1 double"), ["page"])
    want = {(1, 0, 0, 1, 2, "head"), (1, 0, 1, 0, 1, "00"), (1, 0, 1, 1, 1, "01"), (1, 0, 1, 2, 1, "02"), (1, 0, 2, 0, 1, "10"), (1, 0, 2, 2, 1, "12"), (1, 0, 3, 0, 1, "20"), (1, 0, 3, 1, 1, "21"), (1, 0, 3, 2, 1, "22"), (1, 0, 4, 0, 2, "foot")}
    assert {tuple(r) for r in got.collect()} == want  # two columns of two rows are no table


TEXTS = {
    1: "212-555-0100 or ref 99212-555-010077",
    2: "a  b\n\n mail x.y@z.org,\t 212-555-0100 and 4111 1111\n1111  1111 é 2020-01-02",
    3: None,
    4: "nothing here 1234",
    5: "",
    6: "123-45-6789 123-45-6789, 000-12-3456",
    7: "  x@y.de  ",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in TEXTS.items()], "doc_id int, text string, kind string, start int")


def test_spans_and_report(docs):
    found = redact.spans(docs)
    got = {(r["doc_id"], r["kind"], TEXTS[r["doc_id"]][r["start"] : r["end"]]) for r in found.collect()}
    assert got == {(1, "phone", "212-555-0100"), (2, "email", "x.y@z.org"), (2, "phone", "212-555-0100"), (2, "card", "4111 1111\n1111  1111"), (2, "date", "2020-01-02"), (6, "ssn", "123-45-6789"), (6, "card", "123-45-6789 123-45-6789"), (7, "email", "x@y.de")}
    report = {r["doc_id"]: r.asDict() for r in redact.redaction_report(found).collect()}
    assert report[6]["ssn"] == 2 and report[6]["marks"] == 1 and report[6]["chars"] == 23 and set(report) == {1, 2, 6, 7}
    total = redact.redaction_totals(redact.redaction_report(found)).first()
    assert (total["texts"], total["marks"], total["email"], total["card"]) == (4, 7, 2, 2)
    assert redact.redaction_totals(redact.redaction_report(found.where("false"))).first()["chars"] == 0


def test_redacted(docs):
    got = {r["doc_id"]: r["text"] for r in redact.redacted(docs, redact.spans(docs)).collect()}
    assert got[1] == "█" * 12 + " or ref 99212-555-010077"
    for k, t in TEXTS.items():
        assert (got[k] is None) == (t is None) and len(got[k] or "") == len(t or "") and all(a in (b, "█") for a, b in zip(got[k] or "", t or "", strict=True))
    assert got[7] == "  ██████  " and got[4] == TEXTS[4]


def test_marks_unite(spark):
    found = spark.createDataFrame([(1, 0, 5), (1, 3, 9), (1, 9, 12), (1, 20, 21), (2, 4, 6), (2, 4, 6)], "doc_id int, start long, end long")
    assert sorted(map(tuple, redact.marks(found).collect())) == [(1, 0, 9), (1, 9, 12), (1, 20, 21), (2, 4, 6)]


def test_masked_keeps_the_rest(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS.values()], "text string")
    got = [r[0] for r in df.select(masked(F.col("text"), ("phone", "email"))).collect()]
    assert got[0] == "█ or ref 99212-555-010077" and got[2] is None and got[6] == "  █  "


def test_pattern_spans(spark):
    df = spark.createDataFrame([(1, "the end. The"), (2, None), (3, ""), (4, "x"), (5, "thethe")], "doc_id int, text string")
    assert sorted(map(tuple, pattern_spans(df, "(?i)the").collect())) == [(1, 0, 3), (1, 9, 12), (5, 0, 3), (5, 3, 6)]


def test_text_at(spark):
    from paperloom.operators.text import text_at

    text = "ab  cd\n\n é日 x" + "\n" + "w" * 3000 + " z"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    picks = [(1, k, at) for k, at in enumerate([0, 1, 2, 5, 6, 7, 9, 12, 13, 2000, len(text) - 1, len(text), len(text) + 1, -1])] + [(2, 0, 0), (3, 0, 0), (4, 0, 0)]
    got = {(r["doc_id"], r["pick"]): tuple(r)[2:] for r in text_at(docs, spark.createDataFrame(picks, "doc_id int, pick int, at long")).collect()}
    starts = [0, 7, 8, 14]
    want = {}
    for k, (_, _, at) in enumerate(picks[:14]):
        if 0 <= at <= len(text):
            n = max(i for i, s in enumerate(starts) if s <= at)
            end = (text + "\n").index("\n", starts[n])
            a = z = at
            while a > starts[n] and not text[a - 1].isspace():
                a -= 1
            while z < end and not text[z].isspace():
                z += 1
            want[1, k] = (n, starts[n], end, *((text[a:z], a, z) if z > at else (None, None, None)))
    want[3, 0] = (0, 0, 0, None, None, None)
    assert got == want


def test_combined_bookmarks(spark):
    from paperloom.operators.trees import combined_bookmarks

    marks = spark.createDataFrame([(1, [1], "a", 0), (1, [1, 2], "b", 4), (2, [1], "none", 0), (3, [2], "c", 1)], "source_no int, path array<int>, title string, pos long")
    sources = spark.createDataFrame([(3, "third", 2), (1, "first", 4), (2, "empty", 0)], "source_no int, title string, pages long")
    got = sorted((tuple(r["path"]), r["title"], r["pos"]) for r in combined_bookmarks(marks, sources).collect())
    assert got == [((1,), "first", 0), ((1, 1), "a", 0), ((1, 1, 2), "b", None), ((2,), "third", 4), ((2, 2), "c", 5)]


def test_tables_stay_on_their_pages(spark):
    """pages are told together, each as if alone: no join and one shuffle; a line between two tables is the foot of one and the head of the other."""
    import random

    corners = "text string, x0 double, y0 double, x1 double, y1 double"
    grid = lambda top, n: [(f"{r}{c}", 100.0 * c, top + 20.0 * r, 100.0 * c + 60, top + 20.0 * r + 10) for r in range(n) for c in range(3)]
    middle = [("both", 0.0, 60.0, 160.0, 70.0)]
    pages = {0: grid(0, 3) + middle + grid(80, 2), 1: grid(0, 1), 2: grid(0, 2) + [("z", 100.0, 0.0, 130.0, 10.0), ("a", 100.0, 0.0, 140.0, 10.0)], 3: [], 4: grid(500, 2)}
    rows = [(p, *b) for p, some in pages.items() for b in some] + [(5, "lost", None, 0.0, 1.0, 1.0), (None, "n", float("nan"), 0.0, 1.0, 1.0)]
    random.Random(7).shuffle(rows)
    out = spanning_tables(spark.createDataFrame(rows, f"page int, {corners}").repartition(3), ["page"])
    got = {tuple(r) for r in out.collect()}
    assert {r[:4] for r in got if r[5] == "both"} == {(0, 0, 3, 0), (0, 1, 0, 0)}
    assert {r[4] for r in got if r[5] == "both"} == {2}
    assert (2, 0, 0, 1, 1, "01 a z") in got
    assert {r[0] for r in got} == {0, 2, 4}
    assert len([r for r in got if r[0] == 0]) == 17 and len([r for r in got if r[0] == 4]) == 6
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
