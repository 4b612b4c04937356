"""Characters of pages as arrays against the operators over rows of characters, on texts of many scripts."""

import random

import pytest
from paperloom.operators import boxes, glyphs, layout
from paperloom.plans import catalog
from paperloom.plans.queries_layout import _LETTERS, _SCRIPTS, PAGE
from pyspark.sql import functions as F

ODD = "ab c_d__ e\t\r\n  กั́אב ג一丁가\U0001f600\U00020000é-é"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    chance = random.Random(5)
    texts = ["".join(chance.choices(ODD, k=chance.choice([0, 1, 3, 90, 2500]))) for _ in range(40)] + [None, "", " \t ", "_", "x" * 5000, "\n\na\n"]
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def _documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def _broken(spark, folder):
    return layout.word_breaks(layout.line_segments(glyphs.typeset(_documents(spark, folder)), *PAGE), *PAGE, "line")


def words_of_glyphs(spark, folder):
    return layout.words(_broken(spark, folder), *PAGE, "line")


def script_words(spark, folder):
    right, text = F.col("doc_id") % 4 == 3, F.col("text")
    for k, to in _SCRIPTS.items():
        text = F.when(F.col("doc_id") % 4 == k, F.translate("text", _LETTERS, to)).otherwise(text)
    squeezed, line = F.col("x1") - F.col("i") % 5, [*PAGE, "line"]
    put = glyphs.typeset(_documents(spark, folder).select("doc_id", text.alias("text"))).select(
        *PAGE, "i", "text", F.expr(f"i div {glyphs.WIDTH}").alias("line"), F.when(right, 600 - squeezed).otherwise(F.col("x0")).alias("x0"), "y0", F.when(right, 600 - F.col("x0")).otherwise(squeezed).alias("x1"), "y1"
    )
    return layout.words(layout.logical_order(layout.word_breaks(put, *line), *line), *line, order="at").drop("y0", "y1")


def without_doubles(spark, folder):
    single = glyphs.typeset(_documents(spark, folder))
    twice = single.where("i % 3 = 0").withColumn("x0", F.col("x0") + 0.5).withColumn("x1", F.col("x1") + 0.5)
    drawn = single.withColumn("i", F.col("i") * 2).unionByName(twice.withColumn("i", F.col("i") * 2 + 1))
    return layout.without_doubles(drawn, PAGE).groupBy(*PAGE).agg(F.count("*").alias("n"), F.sum(F.expr("i div 2")).alias("places"))


def around_glyph(spark, folder):
    drawn = glyphs.typeset(_documents(spark, folder))
    first = drawn.groupBy(*PAGE).agg(F.min("i").alias("i")).withColumn("pick", F.lit(0))
    seventh = drawn.where("i % 7 = 3").groupBy(*PAGE).agg(F.max("i").alias("i")).withColumn("pick", F.lit(1))
    return layout.around_glyph(_broken(spark, folder), first.unionByName(seventh), PAGE)


def rectangle_text(spark, folder):
    k, p, b = F.col("doc_id"), F.col("page"), F.col("id")
    areas = glyphs.typeset_lines(_documents(spark, folder)).select(*PAGE).distinct().withColumn("id", F.explode(F.array(F.lit(0), F.lit(1))))
    areas = areas.select(*PAGE, "id", (30.0 + k % 50 + b * 120).alias("x0"), (45.0 + b * 20).alias("y0"), (250.0 + k % 90 + b * 170).alias("x1"), (130.0 + p % 5 * 14 + b * 30).alias("y1"))
    return boxes.box_texts(_broken(spark, folder), areas, PAGE)


@pytest.mark.parametrize("plain", [words_of_glyphs, script_words, without_doubles, around_glyph, rectangle_text], ids=lambda f: f.__name__)
def test_pages_as_arrays(spark, folder, plain):
    """only lines of text are dealt and ordered; what their characters make is the same."""
    got, want = catalog.QUERIES[plain.__name__](spark, folder), plain(spark, folder)
    rows = lambda df: sorted(map(repr, df.select(*want.columns).collect()))
    assert rows(got) == rows(want) and got.count()
    assert [(f.name, f.dataType) for f in got.select(*want.columns).schema] == [(f.name, f.dataType) for f in want.schema]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("Window ["), plan.count("Generate "), plan.count("Join ")) == (1, 1, 0)
