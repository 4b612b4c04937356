"""Operators on small literal tables: layout, threads, forms, files, filters, streams."""

import base64
import random
import zlib

import pytest
from paperloom.operators import boxes as boxes_of
from paperloom.operators import compare, layout, threads
from paperloom.operators.forms import column_order, form_merge
from paperloom.operators.pages import combine
from paperloom.sources import filters, formdata
from paperloom.streaming import events
from pyspark.sql import functions as F


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_lines_and_words(spark):
    g = [(1, i, "x", *b) for i, b in enumerate([(0, 0, 5, 10), (5.5, 0, 10, 10), (20, 1, 25, 11), (0, 20, 5, 30), (6, 20, 10, 30)])]
    df = spark.createDataFrame([(p, i, t, *map(float, b)) for p, i, t, *b in g], "page int, i int, text string, x0 double, y0 double, x1 double, y1 double")
    lines = layout.line_segments(df, "page")
    assert [r[-1] for r in rows(lines.select("i", "line"), "i")] == [0, 0, 0, 1, 1]
    assert [r[-1] for r in rows(layout.word_breaks(lines, "page", "line").select("i", "space_before"), "i")] == [False, False, True, False, False]


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, 0, "one para-", 0.0, 0.0, 10.0, "r"), (1, 1, "graph here", 0.0, 12.0, 10.0, "r"), (1, 2, "another", 0.0, 40.0, 10.0, "r"), (1, 3, "bold", 0.0, 52.0, 10.0, "b")], "page int, line int, text string, x0 double, y0 double, size double, style string")
    assert rows(layout.paragraphs(df, ["page"]), "para") == [(1, 0, "one paragraph here"), (1, 1, "another"), (1, 2, "bold")]


def test_orders_and_labels(spark):
    boxes = [("b", 100.0, 1.0, 120.0, 11.0), ("a", 0.0, 0.0, 20.0, 10.0), ("c", 0.0, 30.0, 20.0, 40.0)]
    df = spark.createDataFrame([(1, *b) for b in boxes], "page int, name string, x0 double, y0 double, x1 double, y1 double")
    assert [r[1] for r in rows(layout.tab_order(df, ["page"]), "rank")] == ["a", "b", "c"]
    assert [r[1] for r in rows(layout.tab_order(df, ["page"], "column"), "rank")] == ["a", "c", "b"]
    blocks = df.withColumn("block", F.expr("cast(ascii(name) as long)"))
    assert [r[1] for r in rows(layout.reading_order(blocks, ["page"]), "rank")] == [97, 98, 99]
    fields = spark.createDataFrame([(1, 7, 100.0, 0.0, 150.0, 10.0)], "page int, box int, x0 double, y0 double, x1 double, y1 double")
    words = spark.createDataFrame([(1, "First", 40.0, 0.0, 60.0, 10.0), (1, "name", 65.0, 0.0, 95.0, 10.0), (1, "far", 0.0, 0.0, 5.0, 10.0)], "page int, text string, x0 double, y0 double, x1 double, y1 double")
    assert rows(layout.field_labels(fields, words), "box") == [(1, 7, "First name")]
    numbered = fields.withColumnRenamed("box", "id")
    assert boxes_of.without_overlaps(numbered, numbered, ["page"]).count() == 0


def test_threads(spark):
    df = spark.createDataFrame([(1, str(i), str(i - 1) if i else None) for i in range(40)] + [(1, "x", "gone"), (2, "0", None)], "doc int, name string, in_reply_to string")
    got = {(n): d for _, r, n, d in rows(threads.thread_tree(df), "name") if r == "0"}
    assert got == {str(i): i for i in range(1, 40)}


def test_word_diff_applies(spark):
    r = random.Random(3)
    pairs = [(i, " ".join(r.choices("abcd", k=r.randint(0, 12))), " ".join(r.choices("abcd", k=r.randint(0, 12)))) for i in range(60)]
    got = compare.word_diff(spark.createDataFrame(pairs, "pair int, old string, new string")).toPandas()
    for i, old, new in pairs:
        changes = got[got.pair == i]
        gone, put = [w for c in changes.old for w in c.split()], [w for c in changes.new for w in c.split()]
        assert len(old.split()) - len(gone) == len(new.split()) - len(put)
        assert sorted(old.split() + put) == sorted(new.split() + gone)
    assert compare.word_diff(spark.createDataFrame([(1, None, "a")], "pair int, old string, new string")).first()["kind"] == "Inserted"


def test_long_texts_compare():
    """Scattered edits of long texts are found; texts with nothing in common, and hard mixes, finish with little memory."""
    old = [f"w{i}" for i in range(20_000)]
    new = [f"new{i}" if i in (100, 5000, 12_000, 19_000) else w for i, w in enumerate(old)]
    del new[8000]
    got = compare._runs(old, new)
    assert [k for k, *_ in got] == ["Replaced", "Replaced", "Deleted", "Replaced", "Replaced"]
    assert [k for k, *_ in compare._runs([f"a{i}" for i in range(30_000)], [f"b{i}" for i in range(30_000)])] == ["Replaced"]
    r = random.Random(5)
    for size in (0, 1, 5, 40, 300, 1400, 5000):
        a = r.choices("abcdefgh" if size < 2000 else [f"w{i}" for i in range(9000)], k=size)
        b = [w for w in a if r.random() > 0.2]
        for _ in range(size // 10):
            b.insert(r.randrange(len(b) + 1), r.choice("abcdefghXYZ"))
        kept = compare._kept(a, b)
        assert kept == sorted(set(kept)) and all(a[i] == b[j] for i, j in kept) and all(p < i and q < j for (p, q), (i, j) in zip(kept, kept[1:]))
        if size < 400:
            import difflib

            assert len(kept) >= sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_most_words_stay():
    """The words kept are as many as can be, with rare and with frequent words; long texts without a unique word keep theirs."""
    r = random.Random(9)
    for n, m, words in ((0, 5, 3), (1, 1, 1), (40, 60, 2), (200, 150, 5), (300, 300, 100), (130, 129, 1)):
        a, b = ([f"w{r.randrange(words)}" for _ in range(k)] for k in (n, m))
        kept = compare._kept(a, b)
        assert all(a[i] == b[j] for i, j in kept) and all(p < i and q < j for (p, q), (i, j) in zip(kept, kept[1:]))
        assert len(kept) == longest(a, b)
    old = [f"w{r.randrange(50)}" for _ in range(30_000)]
    new = list(old)
    for i in r.sample(range(30_000), 33):
        new[i] = f"w{r.randrange(50)}"
    assert len(compare._kept(old, new)) >= 30_000 - 33
    old = [w for w in (f"v{i % 800}" for i in range(1600))]
    new = [("x" if i % 50 == 7 else w) for i, w in enumerate(old)]
    assert len(compare._kept(old, new)) > 1500


def test_patches(spark):
    r = random.Random(2)
    pairs = [(i, *(None if r.random() < 0.1 else r.choice([" ", "\n", "\u2003"]).join(r.choices("abcde", k=r.choice([0, 3, 30]))) for _ in range(2))) for i in range(80)]
    df = spark.createDataFrame(pairs, "pair int, old string, new string")
    changes = compare.word_changes(df)
    plain = lambda t: " ".join((t or "").split())
    assert {r[0]: r[1] for r in compare.patched(df.selectExpr("pair", "old as text"), changes).collect()} == {i: plain(n) for i, _, n in pairs}
    assert {r[0]: r[1] for r in compare.patched(df.selectExpr("pair", "new as text"), changes, back=True).collect()} == {i: plain(o) for i, o, _ in pairs}


def test_reference_duplicates(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    df = spark.createDataFrame([(1, "leaf", []), (2, "leaf", []), (3, "node", [1]), (4, "node", [2]), (5, "node", [3])], "id int, content string, refs array<int>")
    assert rows(compare.dedupe_references(df), "id") == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]


def test_reference_duplicates_to_the_fixpoint(spark, monkeypatch):
    """a chain of any length merges (16 rounds were the end before), an object is compared once where no cycle is near, cycles merge by what refers to them."""
    compared = []
    monkeypatch.setattr(compare, "_keepers", lambda df, f=compare._keepers: compared.append(df.count()) or f(df))
    chain = [(2 * k + t, "c", [2 * k - 2 + t, 900 + k] if k else None) for k in range(19) for t in (0, 1)]
    df = spark.createDataFrame(chain, "id int, content string, refs array<int>")
    assert rows(compare.dedupe_references(df), "id") == [(2 * k + t, 2 * k) for k in range(19) for t in (0, 1)]
    assert sum(compared) == 38
    ring = [(1, "a", [2]), (2, "b", [1]), (3, "a", [2]), (4, "a", [3]), (5, None, [9, 3]), (6, None, [9, 1]), (7, None, [8, 1]), (8, "l", []), (9, "l", [None]), (10, "l", [99]), (11, "l", [99])]
    df = spark.createDataFrame(ring, "id int, content string, refs array<int>")
    assert rows(compare.dedupe_references(df), "id") == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 5), (6, 5), (7, 5), (8, 8), (9, 8), (10, 10), (11, 10)]


def test_merge_and_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,note\n"Ada, L","two\nlines"\nnever,read\n')
    (tmp_path / "b.csv").write_text("note,extra\nx,=1\n")
    long = formdata.read_delimited(spark, f"{tmp_path}/*.csv")
    assert column_order(long) == ["name", "note", "extra"]
    assert [r[1:] for r in rows(form_merge(long), "file")] == [("Ada, L", "two\nlines", ""), ("", "x", "=1")]
    formdata.write_delimited(form_merge(long).drop("file"), str(tmp_path / "out"))
    assert any("'=1" in p.read_text() for p in (tmp_path / "out").glob("*.csv"))


def test_form_files_round_trip(spark, tmp_path):
    long = spark.createDataFrame([("f", 0, "a.b", 'x<&">'), ("f", 1, "ü", "(y)\\z"), ("f", 2, "n", None)], formdata.LONG)
    want = [("a.b", 'x<&">'), ("ü", "(y)\\z"), ("n", "")]
    (tmp_path / "f.xfdf").write_text(formdata.to_xfdf(long).first()["xfdf"], encoding="utf-8")
    (tmp_path / "f.fdf").write_text(formdata.to_fdf(long).first()["fdf"])
    for name in ("f.xfdf", "f.fdf"):
        assert [r[1:] for r in rows(formdata.read_values(spark, str(tmp_path / name)).select("pos", "name", "value"), "pos")] == want
    (tmp_path / "bad.xml").write_text("<a><b>1</b")
    (tmp_path / "kids.fdf").write_bytes(b"%FDF-1.2\n1 0 obj<</FDF<</Fields[<</T(p)/Kids[<</T(k)/V(a\\051\\n)>><</T(m)/V[(1)(2)]>>]>>]>>>>endobj")
    assert formdata.read_values(spark, str(tmp_path / "bad.xml")).count() == 0
    assert rows(formdata.read_values(spark, str(tmp_path / "kids.fdf")).select("name", "value"), "value") == [("p.m", "1"), ("p.m", "2"), ("p.k", "a)\n")]


def _lzw(data: bytes) -> bytes:
    table, width, bits, n, out, now = {bytes([i]): i for i in range(256)}, 9, 0, 0, bytearray(), b""
    size = 258

    def put(code):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)

    put(256)
    for c in data:
        if now + bytes([c]) in table:
            now += bytes([c])
            continue
        put(table[now])
        table[now + bytes([c])] = size
        size += 1
        width = min(12, max(9, size.bit_length()))
        now = bytes([c])
        if size >= 4094:
            put(table[now])
            put(256)
            table, size, width, now = {bytes([i]): i for i in range(256)}, 258, 9, b""
    if now:
        put(table[now])
    put(257)
    out.append(bits << (8 - n) & 255)
    return bytes(out)


@pytest.mark.parametrize("seed", range(6))
def test_filters(seed):
    r = random.Random(seed)
    data = bytes(r.choices(range(3 + 50 * seed), k=r.randint(0, 600)))
    assert filters.ascii_hex(data.hex().encode() + b">") == data
    assert filters.ascii85(base64.a85encode(data) + b"~>") == data
    assert filters.flate(zlib.compress(data)) == data
    assert filters.flate(zlib.compress(data)[:-5], strict=False)[: len(data) // 2] == data[: len(data) // 2]
    assert filters.lzw(_lzw(data)) == data
    assert filters.run_length(b"".join(bytes([0, b]) for b in data) + b"\x80") == data
    with pytest.raises(filters.FilterError):
        filters.ascii_hex(b"zz>")
    with pytest.raises(filters.FilterError):
        filters.decode(b"", ["Nope"])


def test_predictors():
    assert filters.predict(bytes([1, 1, 1, 5, 1, 1]), 2, columns=3) == bytes([1, 2, 3, 5, 6, 7])
    assert filters.predict(bytes([1, 1, 1, 1, 2, 1, 1, 1, 4, 1, 0, 0]), 15, columns=3) == bytes([1, 2, 3, 2, 3, 4, 3, 3, 4])


def test_decoded_column(spark):
    df = spark.createDataFrame([(b"6162>", ["AHx"]), (b"zz", ["Fl"]), (None, ["Fl"]), (b"x", ["?"])], "d binary, n array<string>")
    got = [None if r[0] is None else bytes(r[0]) for r in df.select(filters.decoded(F.col("d"), F.col("n"))).collect()]
    assert got == [b"ab", b"", None, None]


def test_streams(spark, tmp_path):
    from conftest import SF

    source = spark.read.parquet(f"{SF}/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    query = events.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == source.count()
    once = events.once(stream.union(stream)).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == source.count()


def test_combine(spark):
    a, b = spark.range(2).toDF("pos"), spark.range(3).toDF("pos")
    assert rows(combine(a, b), "pos") == [(0, 0), (0, 1), (1, 2), (1, 3), (1, 4)]


def test_pdf_objects(spark, tmp_path):
    from paperloom.sources.pdf import read_objects

    packed = zlib.compress(b"7 0 8 21 << /Type /Catalog >> << /A 1 >>")
    body = b"BT (hello) Tj ET"
    data = b"%%PDF-1.7\n1 0 obj << /Type /Page >> endobj\n2 0 obj << /Length %d /Filter /FlateDecode >>\nstream\n" % len(zlib.compress(body)) + zlib.compress(body)
    data += b"\nendstream endobj\n3 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode /Length %d >>\nstream\n" % len(packed) + packed + b"\nendstream endobj\n"
    (tmp_path / "a.pdf").write_bytes(data)
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    got = read_objects(spark, f"{tmp_path}/*.pdf").orderBy("file", "num").collect()
    assert [(r.num, r.type) for r in got] == [(1, "Page"), (2, None), (3, "ObjStm"), (7, "Catalog"), (8, None), (None, None)]
    assert bytes(got[1].stream) == body and got[-1].error == "no objects"


def test_newest(spark, tmp_path):
    from paperloom.sources.tables import newest, whole_texts

    for i in range(3):
        (tmp_path / f"{i}.txt").write_text(f"t{i}\nx")
    assert newest(spark, str(tmp_path), "*.txt", 2).count() == 2
    assert {r.value for r in whole_texts(spark, str(tmp_path)).collect()} == {f"t{i}\nx" for i in range(3)}


def test_words_and_points(spark):
    g = spark.createDataFrame([(1, 0, i, c, float(i), 0.0, i + 1.0, 5.0, b) for i, (c, b) in enumerate([("a", False), ("b", False), ("_", False), ("_", False), ("c", True)])], "page int, line int, i int, text string, x0 double, y0 double, x1 double, y1 double, space_before boolean")
    assert [r[3] for r in rows(layout.words(g, "page", "line"), "word")] == ["ab", "__", "c"]
    p = spark.createDataFrame([(1, 7, 2.5, 9.0), (1, 8, 99.0, 0.0)], "page int, point int, x double, y double")
    assert rows(layout.nearest_glyph(g, p), "point") == [(1, 7, 2), (1, 8, 4)]


def drawn(spark, *texts):
    """Characters as (page, line 0, i, text, corners), each text given as (characters, x of each)."""
    got = [(p, 0, i, c, float(x), 0.0, x + 6.0, 10.0) for p, (chars, xs) in enumerate(texts) for i, (c, x) in enumerate(zip(chars, xs, strict=True))]
    return spark.createDataFrame(got, "page int, line int, i int, text string, x0 double, y0 double, x1 double, y1 double")


def test_nearest_prefers_its_own_line(spark):
    g = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 5.0, 10.0), (1, 1, "b", 30.0, 12.0, 35.0, 22.0)], "page int, i int, text string, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame([(1, 0, 32.0, 8.0), (1, 1, 24.0, 8.0)], "page int, point int, x double, y double")
    assert rows(layout.nearest_glyph(g, p), "point") == [(1, 0, 1), (1, 1, 1)]
    low = spark.createDataFrame([(1, 0, 16.0, 6.0)], "page int, point int, x double, y double")
    assert rows(layout.nearest_glyph(g, low), "point") == [(1, 0, 0)]


def script_words(df):
    line = ["page", "line"]
    return [(r[0], r[3]) for r in rows(layout.words(layout.logical_order(layout.word_breaks(df, *line), *line), *line, order="at"), "page", "word")]


def test_words_by_script(spark):
    from itertools import accumulate

    at = lambda *gaps: list(accumulate(gaps, lambda x, g: x + 6 + g, initial=0))
    df = drawn(
        spark,
        ("abcd", at(0, 4, 0)),  # a gap of 0.4 heights parts letters
        ("\u6bcf\u4e2a\u5b57\u6bcf", at(0, 4, 0)),  # but not ideographs
        ("\u6bcf\u4e2a\u5b57\u6bcf", at(0, 5, 0)),  # from half a height on it does
        ("\u6bcf\u4e2ab\u6bcf", at(0, 4, 0)),  # nor beside a letter
        ("\u0e01\u0e34b\u0e02", at(0, 5, 0)),  # signs of a cluster may stand 0.6 apart
        ("\u0e01\u0e34b\u0e02", at(0, 6, 0)),
        ("ab cd", at(0, 4, 4, 0)),  # a blank parts nothing by itself
        ("\u05dd\u05d5\u05dc\u05e9", at(0, 0, 0)),  # drawn by eye, read from right to left
    )
    assert script_words(df) == [(0, "ab"), (0, "cd"), (1, "\u6bcf\u4e2a\u5b57\u6bcf"), (2, "\u6bcf\u4e2a"), (2, "\u5b57\u6bcf"), (3, "\u6bcf\u4e2a"), (3, "b\u6bcf"), (4, "\u0e01\u0e34b\u0e02"), (5, "\u0e01\u0e34"), (5, "b\u0e02"), (6, "ab cd"), (7, "\u05e9\u05dc\u05d5\u05dd")]


def test_right_to_left_words_in_drawing_order(spark):
    """Two words drawn from the right; a blank between letters of one run; Latin before them, where the space stands before the glyph drawn later, the last one read."""
    df = drawn(spark, ("\u05d0\u05d1\u05d2\u05d3", [60, 54, 40, 34]), ("\u05d0 \u05d1", [20, 14, 8]), ("ab\u05d0\u05d1", [0, 6, 60, 54]))
    assert script_words(df) == [(0, "\u05d0\u05d1"), (0, "\u05d2\u05d3"), (1, "\u05d0 \u05d1"), (2, "ab\u05d0"), (2, "\u05d1")]


def test_words_and_lines_around_glyphs(spark):
    """Two lines, "ab cd" and "e fg": words stop at blanks, gaps and the ends of lines."""
    g = [(0, i, c, int(i > 4), i == 6) for i, c in enumerate("ab cdefg")]
    df = spark.createDataFrame(g, "page int, i int, text string, line int, space_before boolean")
    picks = df.select("page", "i", F.col("i").alias("pick"))
    got = rows(layout.around_glyph(df, picks, ["page"]), "pick")
    assert [r[2:4] for r in got] == [(0, 1), (0, 1), (0, 4), (3, 4), (3, 4), (5, 5), (6, 7), (6, 7)]
    assert [r[4:] for r in got] == [(0, 4)] * 5 + [(5, 7)] * 3


def test_picked_boxes(spark):
    df = drawn(spark, ("abcdef", [0, 6, 12, 18, 24, 30])).withColumn("line", (F.col("i") >= 4).cast("int"))
    picks = spark.createDataFrame([(0, 9, i) for i in (0, 1, 1, 3, 4, 5)], "page int, pick int, i int")
    assert rows(layout.picked_boxes(df, picks, ["page"]), "first") == [(0, 9, 0, 0, 1, 0.0, 0.0, 12.0, 10.0), (0, 9, 0, 3, 3, 18.0, 0.0, 24.0, 10.0), (0, 9, 1, 4, 5, 24.0, 0.0, 36.0, 10.0)]


def test_unlinked(spark):
    from paperloom.operators.text import unlinked

    hits = spark.createDataFrame([(1, 0, 5), (1, 10, 20), (2, 0, 5)], "doc_id int, start int, end int")
    links = spark.createDataFrame([(1, 4, 6)], "doc_id int, start int, end int")
    assert rows(unlinked(hits, links), "doc_id", "start") == [(1, 10, 20), (2, 0, 5)]
