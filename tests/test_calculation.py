"""The order of calculation: of formulas on the driver, of fields in tables; phrases against plain counts."""

import random

import pytest
from paperloom.operators.forms import calculation_levels
from paperloom.operators.text import phrase_counts
from paperloom.plans.formula import FormulaError, levels, recalculated, uses


def test_levels_of_formulas():
    assert uses('if(a > 1, Concat(b, "c"), null) + a') == ["a", "b"]
    assert levels({"c": "b + 1", "a": "x", "b": "a * a", "d": "2"}) == [["a", "d"], ["b"], ["c"]]
    with pytest.raises(FormulaError, match="a, b"):
        levels({"a": "b", "b": "a + 1", "c": "1"})
    with pytest.raises(FormulaError):
        levels({"a": "a + 1"})


def test_recalculated(spark):
    """A chain in which each formula uses the one before twice keeps a plan that grows with its length."""
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    chain = {f"f{i}": f"f{i - 1} + f{i - 1} * 0" if i else "x * 1" for i in reversed(range(25))}
    out = recalculated(df, chain)
    assert [r["f24"] for r in out.orderBy("x").collect()][-1] == 1.0
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_levels_of_fields(spark):
    rows = [(1, "a", ["b", "gone"]), (1, "b", None), (1, "c", ["a", "b"]), (1, "x", ["y"]), (1, "y", ["x"]), (1, "z", ["x", "b"]), (1, "s", ["s"]), (2, "b", ["a"]), (3, "n", [])]
    got = {(r["doc"], r["name"]): r["level"] for r in calculation_levels(spark.createDataFrame(rows, "doc int, name string, uses array<string>")).collect()}
    assert got == {(1, "a"): 1, (1, "b"): 0, (1, "c"): 2, (1, "x"): None, (1, "y"): None, (1, "z"): None, (1, "s"): None, (2, "b"): 0, (3, "n"): 0}
    assert calculation_levels(spark.createDataFrame([], "doc int, name string, uses array<string>")).count() == 0


@pytest.mark.parametrize("together", [64, 2])
def test_levels_of_fields_in_rows_and_in_rounds(spark, monkeypatch, together):
    """what documents hold in a row and what is peeled in rounds have the same levels, and the former writes one table whatever the levels."""
    from paperloom.operators import forms

    written = []
    monkeypatch.setattr(forms, "TOGETHER", together)
    monkeypatch.setattr(forms, "written", lambda df, name, f=forms.written: written.append(name) or f(df, name))
    rows = [(1, f"f{i}", [f"f{i - 1}", "gone", None]) for i in range(6)] + [(1, "f3", ["f0"]), (2, "b", ["a"]), (2, "a", None), (3, "x", ["y"]), (3, "y", ["x"]), (3, "z", ["x"]), (3, "n", []), (None, "q", ["r"]), (None, "r", None)]
    got = {(r["doc"], r["name"]): r["level"] for r in calculation_levels(spark.createDataFrame(rows, "doc int, name string, uses array<string>")).collect()}
    assert got == {(1, f"f{i}"): i for i in range(6)} | {(2, "a"): 0, (2, "b"): 1, (3, "x"): None, (3, "y"): None, (3, "z"): None, (3, "n"): 0, (None, "q"): 0, (None, "r"): 0}
    assert (len(written) == 1) == (together == 64)


def test_phrases(spark):
    r = random.Random(1)
    texts = [(i, " ".join(r.choices(["the", "of", "İx", "and", "zebra", "ab"], k=r.randrange(12))), r.choice("ab")) for i in range(60)] + [(99, None, "a"), (98, "", "b")]
    phrases = ["the of and", "OF", "zebra  the", "of and zebra the", "", "  ", "heof", "the", None, "the of and"]
    docs = spark.createDataFrame(texts, "doc_id int, text string, phrase string")
    got = {(r["phrase"], r["lang"]): r["docs"] for r in phrase_counts(docs.withColumnRenamed("phrase", "lang"), spark.createDataFrame([(p,) for p in phrases], "phrase string"), "lang").collect()}
    want = {}
    for p in {" ".join((p or "").lower().split()) for p in phrases} - {""}:
        for _, t, lang in texts:
            if p in (t or "").lower():
                want[p, lang] = want.get((p, lang), 0) + 1
    assert got == want
    assert phrase_counts(docs.withColumnRenamed("phrase", "lang"), spark.createDataFrame([], "phrase string"), "lang").count() == 0
