"""Queries and operators on inputs that a review found wrong, slow or too large."""

import random
import re

import duckdb
import pandas as pd
import pytest
from paperloom.functions import fields, formcalc
from paperloom.operators import compare, layout, redact
from paperloom.plans import catalog, queries_text, script
from pyspark.sql import functions as F


@pytest.fixture()
def same(spark, tmp_path):
    """Whether a query over tables of its own gives what its SQL gives."""

    def check(name: str, **tables: pd.DataFrame) -> None:
        con = duckdb.connect()
        for t, rows in tables.items():
            rows.to_parquet(tmp_path / f"{t}.parquet", coerce_timestamps="us")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        got = catalog.QUERIES[name](spark, str(tmp_path))
        want = con.execute(catalog.ORACLE_SQL[name])
        order = [c[0] for c in want.description]
        plain = lambda rows: sorted((tuple(r) for r in rows), key=repr)
        assert plain(got.select(*order).collect()) == plain(want.fetchall())

    return check


def test_percentages_round_as_they_stand(same):
    same("percents", supplier=pd.DataFrame({"s_suppkey": range(6), "s_acctbal": [7267.65, 3698.75, 3805.75, 7661.45, -0.05, 0.0]}))


def test_negative_zero_is_no_formula(same):
    same("csv_cells", customer=pd.DataFrame({"c_custkey": range(4), "c_acctbal": [-0.0, 0.0, -0.01, 12.5]}))


def test_apr_in_few_steps(spark):
    r = random.Random(3)
    loans = [(v, v / n * r.choice([1.0, 1.0 + 1e-6, 1.3, 3.0, 60.0]) * r.uniform(1, 2), float(n)) for n in (1, 2, 12, 360, 5000) for v in (r.uniform(1, 1e6) for _ in range(20))]
    loans += [(100.0, 5.0, 12.0), (100.0, 100.0 / 12, 12.0), (100.0, 500.0, 3.0), (100.0, 250.0, 0.5)]

    def cost(v, rate, n):
        return v / n if rate == 0 else v * rate / (1 - (1 + rate) ** -n)

    df = spark.createDataFrame(loans, "v double, p double, n double")
    apr = formcalc.apr(F.col("v"), F.col("p"), F.col("n"))
    assert "200" not in apr._jc.toString().split("ELSE")[1]  # no bisection of 200 steps for whole payments
    for v, p, n, rate in df.select("v", "p", "n", (apr / 12).alias("r")).collect():
        if p <= v / n:
            assert rate < 1e-12
        elif cost(v, 1.0, n) < p:
            assert rate == pytest.approx(1.0)
        else:
            assert cost(v, rate, n) == pytest.approx(p, rel=1e-9)


def _plan(spark, name: str) -> str:
    return catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def _above(plan: str) -> list[str]:
    """Exchanges that move what a line was split into: those with a split of characters below them."""
    lines, out = plan.split("\n"), []
    deep = lambda x: len(x) - len(x.lstrip(" :+-"))
    for at, line in enumerate(lines):
        if "Exchange" in line:
            below = []
            for x in lines[at + 1 :]:
                if deep(x) <= deep(line):
                    break
                below.append(x)
            if any("(?s)., 0" in x for x in below) and not any("Aggregate" in x for x in below):
                out.append(line.strip()[:120])
    return out


@pytest.mark.parametrize("name", ["line_segments", "words_of_glyphs", "script_words", "without_doubles", "around_glyph", "picked_boxes", "nearest_glyph", "rectangle_text"])
def test_characters_are_not_shuffled(spark, name):
    plan = _plan(spark, name)
    assert _above(plan) == [] and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("name", ["field_labels", "rectangle_text", "box_pairs"])
def test_cells_are_not_sent_whole(spark, name):
    assert "BroadcastExchange" not in _plan(spark, name)


@pytest.mark.parametrize("name", ["reading_order", "table_cells"])
def test_rows_of_a_page_are_shuffled_once(spark, name):
    plan = _plan(spark, name)
    assert plan.count("REPARTITION_BY_NUM") == plan.count("Scan parquet") and "ENSURE_REQUIREMENTS" not in plan


def test_pages_in_batches(spark):
    r = random.Random(8)
    glyph = "page int, i long, text string, x0 double, y0 double, x1 double, y1 double"
    rows = [(p, i, r.choice("ab"), r.choice([0.0, 1.0, 1.5, 30.0]), 0.0, 5.0, 10.0) for p in range(40) for i in range(r.choice([1, 3, 90]))]
    want = []
    for p in range(40):
        last = []
        for g in sorted(x for x in rows if x[0] == p):
            again = any(stays and q[2] == g[2] and abs(q[3] - g[3]) < 2.0 for q, stays in last[-4:])
            last.append((g, not again))
        want += [g for g, stays in last if stays]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = layout.without_doubles(spark.createDataFrame(rows, glyph).repartition(3), ["page"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", ["keystrokes", "field_dates", "make_numbers"])
def test_values_are_worked_out_once(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") + plan.count("regexp_extract_all(") <= 12 and len(plan) < 20_000


def test_typed_dates_and_numbers(spark):
    typed = ["March 5 '49", "5 '49", "13/1/2000", "", None, "xyz 4 1999", "2/30/2001", "12/31/50 "]
    seen = spark.createDataFrame(list(enumerate(typed)), "i int, v string").orderBy("i").select(fields.format_date(fields.parse_date(F.col("v"), "m/d/yyyy"), "yyyy-mm-dd").alias("d"), fields.keystroke(F.col("v"), "number")["value"].alias("n"))
    assert [tuple(r) for r in seen.collect()] == [("2049-03-05", None), (None, "549"), (None, None), (None, ""), (None, ""), (None, None), (None, None), ("1950-12-31", None)]


def test_days_are_told_once(spark, same):
    assert "Union" not in _plan(spark, "date_languages")
    same("date_languages", orders=pd.DataFrame({"o_orderkey": range(6), "o_orderdate": pd.to_datetime(["1999-05-01", "1999-05-01", None, "2024-02-29", "1996-12-31", None])}))


def test_scripts_are_dealt(spark):
    assert "REPARTITION_BY_NUM" in _plan(spark, "scripts")
    df = spark.createDataFrame([(1.0, "a"), (None, "a"), (1.0, "a"), (-0.0, "b"), (0.0, "b")], "x double, s string").coalesce(1)
    got = [tuple(r["r"]) for r in df.select(script.run_script('if (s == "b") then\n x / x\nelse\n concat(s, x)\nendif', x=F.col("x"), s=F.col("s")).alias("r")).collect()]
    assert got[:3] == [("a1", None), ("a", None), ("a1", None)] and got[3] == got[4] and got[3][0] is None


@pytest.mark.parametrize("name", ["redact_spans", "redact_text"])
def test_texts_are_searched_in_place(spark, name):
    plan = _plan(spark, name)
    assert plan.count("Scan parquet") <= (1 if name == "redact_spans" else 2) and "Union" not in plan
    assert name != "redact_spans" or "Exchange" not in plan


def test_spans_of_odd_texts(spark, same):
    gap = "  \n"
    texts = ["", None, " ", f"{gap}a@b.de{gap}{gap}+49 30 1234567{gap}x", f"12/03/2001{gap}ann@x.org 219-09-9999,219-09-9999", "4111 1111\n\n1111   1111 a@b.de", "x@y no digit", "219 09\t\t9999", "1-2-3 (212) 555-0100" * 3, "é 5  May 2020 \U0001f600 a@b.de"]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    spaced = spark.createDataFrame(docs.astype(object).where(docs.notna(), None).values.tolist(), "doc_id long, text string")
    found = redact.spans(spaced).collect()
    assert {r["kind"] for r in found} == {"email", "card", "ssn", "date", "phone"}
    for r in found:
        assert re.sub(r"[\s ]+", " ", texts[r["doc_id"]][r["start"] : r["end"]]) == r["hit"]
    plain = docs[~docs.text.fillna("").str.contains(" |12/03|4111|212")]
    same("redact_spans", documents=plain)


def test_ids_alone_are_ordered_by_source(spark, same):
    table = lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet")
    plan = queries_text._neighbours(table)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(plan) if "Window" in x)
    assert "Relation" in plan[at + 2] and not any("text#" in x for x in plan[at : at + 2])
    same("word_diff_rebuilt", documents=pd.DataFrame({"doc_id": range(6), "source": ["a", "a", "b", "a", "b", "a"], "text": ["x y z", "", "p q", None, "q  p q", "x z  x"]}))


def test_words_of_one_side_cut_nothing():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.choice("abcdef" + only) for _ in range(r.randrange(30))] for only in ("uvw", "xyz"))
        kept = compare._kept(a, b)
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, v in enumerate(a):
            for j, w in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if v == w else max(rows[i][j + 1], rows[i + 1][j])
        assert len(kept) == rows[-1][-1] and all(a[i] == b[j] for i, j in kept) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(kept, kept[1:], strict=False))


def test_rebuilt_texts_across_blocks(same, spark, monkeypatch):
    """F8: neighbours of one source stand in blocks, whose parts follow the texts' size and not a join's estimate; nothing is written between."""
    monkeypatch.setattr(queries_text, "written", None, raising=False)
    n = 150
    texts = [None if k % 11 == 0 else " ".join(f"w{(k * j) % 17}" for j in range(k % 23)) for k in range(n)]
    documents = pd.DataFrame({"doc_id": pd.array([*range(n - 1), None], "Int64"), "source": [None if k % 50 == 49 else "a" if k % 10 else "b" for k in range(n)], "text": texts})
    same("word_diff_rebuilt", documents=documents)
    plan = catalog.QUERIES["word_diff_rebuilt"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert all(int(k) <= 64 for k in re.findall(r"RepartitionByExpression .*, (\d+)", plan))
    assert "RepartitionByExpression" in plan
