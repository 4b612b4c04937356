"""Queries of redaction over documents: spans of personal data, covered texts, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import redact
from paperloom.plans.queries_cases import _MONTHS
from paperloom.plans.register import Register
from paperloom.sources.storage import written

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.oracles

_DIGITS = "regexp_replace(h, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INT) ELSE (2 * CAST(reverse({_DIGITS})[i] AS INT)) // 10 + (2 * CAST(reverse({_DIGITS})[i] AS INT)) % 10 END)) % 10 = 0"
_PHONE = rf"""regexp_matches(ltrim(h, '+'), '[^0-9]') AND CASE WHEN h[1] = '+' THEN length({_DIGITS}) BETWEEN 8 AND 15 ELSE length({_DIGITS}) BETWEEN 10 AND 11
    OR ({_DIGITS}[1] = '0' AND length({_DIGITS}) BETWEEN 7 AND 15 AND length(regexp_extract(h, '[0-9]+')) >= 2 AND NOT regexp_matches(h, '^[0-9]{{1,4}}(/[0-9]{{1,2}}/|[.][0-9]{{1,2}}[.]|-[0-9]{{1,2}}-)[0-9]{{1,4}}$')) END"""
#: Context before, pattern and context behind, as RE2 has no look-around; and what a pattern cannot say.
_KINDS = {
    "email": (r"(^|[^\p{L}\p{N}._%+-])", r"([\p{L}\p{N}][\p{L}\p{N}._%+-]*@(?:[\p{L}\p{N}-]|\.[\p{L}\p{N}])*\.\p{L}{2,})", "()", "true"),
    "card": (r"(\b|[^0-9])", "([0-9](?:[ -]?[0-9]){12,18})", "([^0-9]|$)", _LUHN),
    "ssn": ("(^|[^0-9])", "([0-9]{3}[- ][0-9]{2}[- ][0-9]{4})", "([^0-9]|$)", "h[1:3] NOT IN ('000', '666') AND h[1] <> '9'"),
    "phone": (r"(^|[^\p{L}\p{N}+])", r"((?:\+[0-9]|\([0-9]|[0-9])[0-9 .()-]*[0-9])", "()", _PHONE),
    "date": (
        r"(^|[^\p{L}\p{N}])",
        rf"([0-9]{{4}}(?:/[0-9]{{1,2}}/|[.][0-9]{{1,2}}[.]|-[0-9]{{1,2}}-)[0-9]{{1,2}}|[0-9]{{1,2}}(?:/[0-9]{{1,2}}/|[.][0-9]{{1,2}}[.]|-[0-9]{{1,2}}-)[0-9]{{2,4}}|[0-9]{{1,2}}[.]? +(?:{_MONTHS})[.]? *[0-9]{{4}}|(?:{_MONTHS})[.]? *[0-9]{{1,2}},? *[0-9]{{4}})",
        "([^0-9]|$)",
        "true",
    ),
}


def _kind_sql(kind: str) -> str:
    """Spans of one kind: cut at marks put round the matches, places counted in the text as it is by its words' ends."""
    before, pattern, behind, check = _KINDS[kind]
    marked = rf"string_split(regexp_replace(t, '(?i){before}{pattern}{behind}', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g'), chr(1))"
    size = lambda n: f"CAST(coalesce(list_sum(list_transform(p[1:{n}], lambda q: length(q))), 0) AS INT)"
    return f"SELECT doc_id, runs, t, '{kind}' AS kind, {size('i - 1')} AS a, {size('i')} AS z, h FROM (SELECT *, p[i] AS h FROM (SELECT doc_id, runs, t, p, unnest(range(2, len(p) + 1, 2)) AS i FROM (SELECT doc_id, runs, t, {marked} AS p FROM c))) WHERE {check}"


def _far(n: str) -> str:
    """A place in the text with single spaces, in the text as it is."""
    return f"{n} + CAST(coalesce(list_sum(runs[1:length(t[1:{n}]) - length(replace(t[1:{n}], ' ', ''))]), 0) AS BIGINT)"


_SPANS = rf"""c AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t, list_transform(regexp_extract_all(text, '\s+'), lambda x: length(x) - 1) AS runs FROM documents WHERE text IS NOT NULL),
f AS ({" UNION ALL ".join(map(_kind_sql, _KINDS))}),
s AS (SELECT doc_id, kind, CASE WHEN a = 0 THEN 0 ELSE {_far("a")} END AS a, {_far("z")} AS z, h FROM f)"""
_MARKS = """m AS (SELECT doc_id, min(a) AS a, max(z) AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS nr FROM (SELECT doc_id, a, z, CASE WHEN a < max(z) OVER (PARTITION BY doc_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s)) GROUP BY doc_id, nr)"""
_COUNTS = f"""r AS (SELECT * FROM (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in _KINDS)} FROM s GROUP BY doc_id) JOIN (SELECT doc_id, count(*) AS marks, CAST(sum(z - a) AS BIGINT) AS chars FROM m GROUP BY doc_id) USING (doc_id))"""


@query(f'WITH {_SPANS} SELECT doc_id, kind, a AS start, z AS "end", h AS hit FROM s', name="redact_spans")
def _redact_spans(t):
    return redact.spans(t("documents"))


@query(f"WITH {_SPANS}, {_MARKS}, {_COUNTS} SELECT * FROM r", name="redact_report")
def _redact_report(t):
    return redact.redaction_report(written(redact.spans(t("documents")), "spans"))


@query(f"WITH {_SPANS}, {_MARKS}, {_COUNTS} SELECT count(*) AS texts, {', '.join(f'CAST(sum({k}) AS BIGINT) AS {k}' for k in ('marks', 'chars', *_KINDS))} FROM r", name="redact_totals")
def _redact_totals(t):
    return redact.redaction_totals(redact.redaction_report(written(redact.spans(t("documents")), "spans")))


@query(
    f"""WITH {_SPANS}, {_MARKS}, g AS (SELECT doc_id, text, m.a, m.z, lead(m.a) OVER (PARTITION BY doc_id ORDER BY m.a) AS b, lag(m.a) OVER (PARTITION BY doc_id ORDER BY m.a) IS NULL AS head FROM documents JOIN m USING (doc_id)),
    x AS (SELECT doc_id, string_agg(CASE WHEN head THEN text[1:a] ELSE '' END || repeat('█', z - a) || text[z + 1:coalesce(b, length(text))], '' ORDER BY a) AS text FROM g GROUP BY doc_id)
    SELECT doc_id, coalesce(x.text, d.text) AS text FROM documents d LEFT JOIN x USING (doc_id)""",
    name="redact_text",
)
def _redact_text(t):
    docs = t("documents").select("doc_id", "text")
    return redact.redacted(docs, redact.spans(docs))
