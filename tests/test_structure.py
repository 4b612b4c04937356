"""Page structure and command batches on small cases."""

import pytest
from paperloom.operators import commands, structure

HTML = """<!-- <h6> --><script>var x = "<h5>";</script><h2>A</h2><H3 class='a>b'>B</H3><h1>C</h1><h3>D</h3>
<ul><li>x<ol><li>y</li></ol></li></ul><li>lost</li><img src=a><IMG alt="" src="b"><img alt='t'/>
<table><thead><tr><th colspan=2>h</th></tr></thead><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></table>
<table><tr><td>1</td><td>2<table><tr><th>in</th></tr></table></td></tr><tr><td colspan="0">3</td></tr></table><td>out</td><div><tr></tr></div>"""


@pytest.fixture(scope="module")
def found(spark):
    return structure.elements(spark.createDataFrame([(1, HTML), (2, None), (3, ""), (4, "no tags < here >")], "page int, html string"), "page")


def test_elements(found):
    rows = {r["pos"]: r for r in found.collect()}
    assert {r["page"] for r in rows.values()} == {1}
    kinds = [(r["kind"], r["depth"], rows[r["parent"]]["kind"] if r["parent"] is not None else None) for _, r in sorted(rows.items())]
    assert kinds[:9] == [("h2", 1, None), ("h3", 1, None), ("h1", 1, None), ("h3", 1, None), ("ul", 1, None), ("li", 2, "ul"), ("ol", 3, "li"), ("li", 4, "ol"), ("li", 1, None)]
    assert ("th", 4, "tr") in kinds and kinds[9][0] == "img" and ("tr", 3, "thead") in kinds
    assert kinds[-3:] == [("td", 1, None), ("div", 1, None), ("tr", 2, "div")]


def test_findings(found):
    got = sorted((r["rule"], r["message"]) for r in structure.structure_findings(found, "page").collect())
    assert got == [
        ("figures_alt_text", "no alternate text"),
        ("heading_nesting", "level 3 follows level 1"),
        ("heading_nesting", "the first heading is of level 2"),
        ("list_items", "not in a list"),
        ("table_cells", "not in a row"),
        ("table_headers", "no header cells"),
        ("table_regularity", "rows of 1 to 2 columns"),
        ("table_rows", "not in a table"),
    ]
    assert structure.structure_findings(found.where("false"), "page").count() == 0


STEP = "batch int, step long, id string, params string"


def test_batches(spark):
    tools = spark.createDataFrame([("open", ["path", "page"], ["path"]), ("close", [], [])], "command string, known array<string>, required array<string>")
    rows = [(1, 1, "open", '{"path": "a"}'), (1, 2, "close", None), (1, 3, "open", '{"page": 1}'), (1, 4, "close", "null"), (1, 5, "print", "{}")]
    rows += [(2, 1, "close", "{}"), (2, 2, None, "{}"), (3, 1, "close", "[]"), (4, 1, "open", '{"z": 1, "a": 2}'), (5, 1, "open", '{"path": null}'), (6, 1, "close", "not json")]
    rows += [(7, i, "close", None) for i in range(4)]
    steps = spark.createDataFrame(rows, STEP)
    run = sorted(map(tuple, commands.batch_results(steps, tools, most=3).where("batch > 3").select("batch", "step", "error").collect()))
    assert run == [(4, 1, "open: unknown argument z"), (5, 1, "open: missing argument path")]
    run = sorted((r["batch"], r["step"], r["error"]) for r in commands.batch_results(steps, tools).where("batch = 1").collect())
    assert run == [(1, 1, None), (1, 2, None), (1, 3, "open: missing argument path")]
    on = sorted((r["step"], r["ok"]) for r in commands.batch_results(steps, tools, stop_on_error=False).where("batch = 1").collect())
    assert on == [(1, True), (2, True), (3, False), (4, True), (5, False)]
    told = {r["batch"]: tuple(r)[1:] for r in commands.batch_summary(steps, tools, most=5).collect()}
    assert told == {1: (2, 1, None), 2: (0, 0, "a step needs an id"), 3: (0, 0, "step params must be an object"), 4: (0, 1, None), 5: (0, 1, None), 6: (0, 0, "step params must be an object"), 7: (4, 0, None)}
    on = {r["batch"]: tuple(r)[1:] for r in commands.batch_summary(steps, tools, stop_on_error=False, most=4).collect()}
    assert on[1] == (0, 0, "a batch has at most 4 steps (5 given)") and on[7] == (4, 0, None)
    assert commands.batch_summary(steps.where("false"), tools).count() == 0


def test_command_list(spark):
    df = spark.createDataFrame([("a.b", "Save As", True), ("c", "save", False)], "id string, title string, enabled boolean")
    assert [r["id"] for r in commands.command_list(df, " SAVE ").orderBy("id").collect()] == ["a.b", "c"]
    assert commands.command_list(df, "", enabled_only=True).count() == 1 and commands.command_list(df, "save zz").count() == 0


OBJECT = "doc int, type string, subtype string, keys array<string>, flags int, rect array<double>, filters array<string>, claims string, page int"


def test_archive_rules(spark):
    from paperloom.operators.archive import FORBIDDEN_ACTIONS, FORBIDDEN_ANNOTATIONS, archive_findings, archive_status

    good = [(1, "Catalog", None, ["Metadata"], None, None, None, "2B", None), (1, "Annot", "Text", ["AP"], 4, [0.0] * 4, None, None, 0), (1, "Annot", "Popup", None, None, None, None, None, 0), (1, "Annot", "Stamp", [], 4, [3.0] * 4, None, None, 1), (1, None, None, None, None, None, None, None, None), (1, "Stream", "Image", [], None, None, ["FlateDecode"], None, None)]
    bad = [(2, "Catalog", None, None, None, None, None, None, None), (2, "Annot", "Text", ["AP"], 6, None, None, None, 3), (2, "Annot", "Text", ["AP"], 6, None, None, None, 3), (2, "Annot", "Text", ["AP"], 6, None, None, None, 4), (3, "Filespec", None, ["EF", "AFRelationship"], None, None, None, None, None)]
    actions = [(4, "Action", s, [], None, None, None, None, None) for s in (*FORBIDDEN_ACTIONS, "GoTo", "URI")] + [(4, "Annot", s, ["AP", "AA"], 4, None, None, None, 1) for s in FORBIDDEN_ANNOTATIONS]
    df = spark.createDataFrame([*good, *bad, *actions], OBJECT)
    found = archive_findings(df, 2)
    rows = [tuple(r) for r in found.collect()]
    assert {r[0] for r in rows} == {2, 3, 4}
    assert sorted(r[1:] for r in rows if r[0] == 2) == [("6.3.2", "not printed or hidden: Text", 3, True), ("6.3.2", "not printed or hidden: Text", 4, True), ("6.6.2.1", "no metadata", None, True)]
    assert len([r for r in rows if r[0] == 4]) == len(FORBIDDEN_ACTIONS) + len(FORBIDDEN_ANNOTATIONS)
    status = {r["doc"]: r["status"] for r in archive_status(df, found).collect()}
    assert status == {1: "conforms", 2: "can be converted", 3: "fails", 4: "can be converted"}
    assert archive_findings(df, 3).where("doc = 3").count() == 0 and archive_findings(df.where("false"), 2).count() == 0
    with pytest.raises(ValueError):
        archive_findings(df, 1)


def test_without_doubles(spark):
    from paperloom.operators.layout import without_doubles

    glyph = "page int, i long, text string, x0 double, y0 double, x1 double, y1 double"
    put = lambda i, c, x, y=0.0, page=1: (page, i, c, x, y, x + 5.0, y + 10.0)
    rows = [put(0, "a", 0.0), put(1, "a", 1.9), put(2, "a", 3.5), put(3, "b", 3.5), put(4, "c", 9.0), put(5, "d", 15.0), put(6, "e", 20.0), put(7, "a", 0.1), put(8, "e", 20.0, 1.0), put(9, "e", 20.0, 2.5), put(0, "a", 0.0, page=2)]
    got = sorted((r["page"], r["i"]) for r in without_doubles(spark.createDataFrame(rows, glyph).repartition(3), ["page"]).collect())
    assert got == [(1, 0), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (1, 9), (2, 0)]
