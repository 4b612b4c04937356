"""Queries of archive-format rules over objects derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators import archive
from paperloom.plans.register import Register

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.oracles

# A user's events are the objects of a document; kinds, keys and flags follow from the numbers.
_OBJECTS = """SELECT user_id AS doc, event_id AS num, CASE event_id % 8 WHEN 0 THEN 'Annot' WHEN 1 THEN 'Action' WHEN 2 THEN 'Stream' WHEN 3 THEN 'Filespec' WHEN 4 THEN 'Page' WHEN 5 THEN 'Font' WHEN 6 THEN CASE WHEN event_id % 16 = 6 THEN 'Catalog' ELSE 'Trailer' END ELSE 'Field' END AS type,
 CASE event_id % 8 WHEN 0 THEN CASE event_id % 5 WHEN 0 THEN 'Movie' WHEN 1 THEN 'Popup' WHEN 2 THEN 'Link' ELSE 'Text' END WHEN 1 THEN CASE event_id % 3 WHEN 0 THEN 'Launch' WHEN 1 THEN 'GoTo' ELSE 'Hide' END WHEN 2 THEN CASE event_id % 7 WHEN 0 THEN 'PS' WHEN 1 THEN 'Form' ELSE 'Image' END WHEN 5 THEN CASE WHEN event_id % 3 = 0 THEN 'Type3' ELSE 'TrueType' END END AS subtype,
 event_id % 9 AS a, event_id % 11 AS b, event_id % 13 AS c, CASE WHEN event_id % 8 IN (0, 4) THEN event_id % 40 END AS page FROM events"""


def _objects(t) -> DataFrame:
    t("events").createOrReplaceTempView("paperloom_events")
    rows = t("events").sparkSession.sql(_OBJECTS.replace("FROM events", "FROM paperloom_events"))
    key = lambda name, on: F.when(on, name)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    keys = F.array_compact(F.array(
        key("AP", (a % 2 == 0) & (F.col("type") == "Annot")), key("AA", b == 0), key("Metadata", a > 1), key("Encrypt", b == 1), key("JavaScript", b == 2), key("NeedAppearances", b == 3), key("FontFile", a > 2),
        key("F", c == 0), key("FFilter", c == 1), key("Interpolate", c == 2), key("Alternates", c == 3), key("OPI", c == 4), key("EF", a > 3), key("AFRelationship", b > 4),
    ))
    rect = F.when(c == 5, F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))).when(c == 6, F.lit(None)).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(9.0)))
    return rows.select("doc", "num", "type", "subtype", keys.alias("keys"), F.when(c == 7, None).otherwise(b + 1).cast("int").alias("flags"), rect.alias("rect"), F.when(c % 2 == 0, F.array(F.lit("FlateDecode"), F.when(c == 8, "LZWDecode"))).alias("filters"), F.when(a > 4, F.concat((a % 2 + 2).cast("string"), F.lit("B"))).alias("claims"), "page")


def _rules(part: int) -> str:
    def one(clause: str, fails: str, message: str, fixable: bool) -> str:
        return f"SELECT doc, '{clause}' AS clause, {message} AS message, page, {fixable} AS fixable FROM o WHERE {fails}"

    sub, flags = "coalesce(subtype, '')", "CASE WHEN c = 7 THEN 0 ELSE b + 1 END"
    stands = "type = 'Annot' AND subtype <> 'Movie'"
    rules = [
        one("6.6.2.1", "type = 'Catalog' AND a <= 1", "'no metadata'", True),
        one("6.6.4", f"type = 'Catalog' AND a > 1 AND NOT (a > 4 AND a % 2 + 2 = {part})", f"'the metadata does not claim part {part}, level B'", True),
        one("6.1.3", "type = 'Trailer' AND b = 1", "'encrypted'", True),
        one("6.5.2", "type = 'Catalog' AND b = 0", "'the document has additional actions'", True),
        one("6.5.1", "type = 'Catalog' AND b = 2", "'the document has scripts'", True),
        one("6.4.1", "type = 'Catalog' AND b = 3", "'the form asks for appearances'", True),
        one("6.5.2", "type = 'Page' AND b = 0", "'the page has additional actions'", True),
        one("6.5.1", "type = 'Action' AND subtype IN ('Launch', 'Hide')", "'action ' || subtype", True),
        one("6.3.1", "type = 'Annot' AND subtype = 'Movie'", "'annotation Movie'", True),
        one("6.3.2", f"{stands} AND subtype <> 'Popup' AND (({flags}) & 4 = 0 OR ({flags}) & 35 <> 0)", "'not printed or hidden: ' || subtype", True),
        one("6.3.3", f"{stands} AND a % 2 = 1 AND subtype NOT IN ('Popup', 'Link') AND c <> 5", "'no appearance: ' || subtype", False),
        one("6.5.2", f"{stands} AND b = 0", "'additional actions: ' || subtype", True),
        one("6.5.2", "type = 'Field' AND b = 0", "'a field has additional actions'", True),
        one("6.2.11.4.1", f"type = 'Font' AND a <= 2 AND {sub} <> 'Type3'", "'a font is not embedded'", False),
        one("6.1.7.2", "type = 'Stream' AND c = 8", "'LZW compression'", False),
        one("6.1.7.1", "type = 'Stream' AND c IN (0, 1)", "'a stream in another file'", False),
        one("6.2.8", "type = 'Stream' AND subtype = 'Image' AND c = 2", "'an interpolated image'", True),
        one("6.2.8", "type = 'Stream' AND subtype = 'Image' AND c IN (3, 4)", "'an image with alternates'", True),
        one("6.2.9", "type = 'Stream' AND subtype = 'PS'", "'PostScript'", False),
        one("6.8", "type = 'Filespec' AND a > 3", "'an embedded file'", False) if part == 2 else one("6.8", "type = 'Filespec' AND a > 3 AND b <= 4", "'an embedded file without a relationship'", True),
    ]
    return f"o AS ({_OBJECTS}), f AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(rules)}))"


@query(f"WITH {_rules(2)} SELECT * FROM f", name="archive_rules")
def _archive_rules(t):
    return archive.archive_findings(_objects(t), 2)


@query(f"WITH {_rules(3)} SELECT * FROM f", name="archive_rules_3")
def _archive_rules_3(t):
    return archive.archive_findings(_objects(t), 3)


@query(
    f"""WITH {_rules(3)}, n AS (SELECT doc, count(f.clause) AS issues, count(*) FILTER (WHERE fixable) AS fixable FROM (SELECT DISTINCT user_id AS doc FROM events) LEFT JOIN f USING (doc) GROUP BY doc)
    SELECT doc, CASE WHEN issues = 0 THEN 'conforms' WHEN issues = fixable THEN 'can be converted' ELSE 'fails' END AS status, issues, fixable FROM n""",
    name="archive_status",
)
def _archive_status(t):
    objects = _objects(t)
    return archive.archive_status(objects, archive.archive_findings(objects, 3))
