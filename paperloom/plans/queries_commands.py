"""Queries of page structure and of commands over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators import commands, structure
from paperloom.plans.register import Register

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.oracles

# Pages whose list of links becomes a table of links, a table with heads, or loose items, by turns.
_TURNS = {1: {"ul": "table", "li": "tr", "a": "td"}, 2: {"ul": "table", "li": "tr", "a": "th", "nav": "tr", "h1": "h3"}, 3: {"ul": "div", "a": "td", "footer": "h2"}}


def _changed(names: dict[str, str], sql: bool) -> str:
    out = "html"
    for a, b in names.items():
        flags = ", 'g'" if sql else ""
        out = f"regexp_replace({out}, '<(/?){a}([ >])', '<{'\\1' if sql else '$1'}{b}{'\\2' if sql else '$2'}'{flags})"
    return out


def _case(sql: bool) -> str:
    return "CASE page_id % 4 " + " ".join(f"WHEN {k} THEN {_changed(names, sql)}" for k, names in _TURNS.items()) + " ELSE html END"


def _pages(t) -> DataFrame:
    return t("pages").select("page_id", F.expr(_case(False)).alias("html"))


_ELEMENTS = rf"""h AS (SELECT page_id, regexp_replace(regexp_replace({_case(True)}, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS html FROM pages),
g AS (SELECT page_id, i - 1 AS pos, w[i] AS tag, lower(regexp_extract(w[i], '^</?([A-Za-z0-9]+)', 1)) AS kind FROM (SELECT page_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '</?[A-Za-z][A-Za-z0-9]*(?:[^>"'']|"[^"]*"|''[^'']*'')*>') AS w FROM h))),
s AS (SELECT *, tag LIKE '</%' AS closes, kind IN ('br', 'meta', 'img') OR tag LIKE '%/>' AS alone FROM g WHERE kind NOT IN ('p', 'b', 'i', 'html', 'head', 'body')),
d AS (SELECT *, sum(CASE WHEN alone THEN 0 WHEN closes THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) + CASE WHEN alone THEN 1 ELSE 0 END AS depth FROM s),
e AS (SELECT page_id, pos, kind, CAST(depth AS BIGINT) AS depth, (SELECT max(o.pos) FROM d o WHERE o.page_id = d.page_id AND o.pos < d.pos AND o.depth = d.depth - 1 AND NOT o.closes AND NOT o.alone) AS parent FROM d WHERE NOT closes)"""
_FINDINGS = """u AS (SELECT e.*, p.kind AS above, CASE WHEN regexp_matches(e.kind, '^h[1-6]$') THEN CAST(e.kind[2:2] AS INT) END AS level FROM e LEFT JOIN e p ON p.page_id = e.page_id AND p.pos = e.parent),
hd AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY page_id ORDER BY pos), 0) AS before FROM u WHERE level IS NOT NULL),
tr AS (SELECT page_id, pos, parent AS tbl FROM u WHERE kind = 'tr' AND above = 'table'),
cl AS (SELECT page_id, tbl, tr.pos, count(c.pos) AS n, count(c.pos) FILTER (WHERE c.kind = 'th') AS heads FROM tr LEFT JOIN u c USING (page_id) WHERE c.parent = tr.pos AND c.kind IN ('td', 'th') GROUP BY ALL),
f AS (SELECT page_id, 'list_items' AS rule, pos, 'not in a list' AS message FROM u WHERE kind = 'li' AND coalesce(above NOT IN ('ul', 'ol', 'menu'), true)
  UNION ALL SELECT page_id, 'table_rows', pos, 'not in a table' FROM u WHERE kind = 'tr' AND coalesce(above NOT IN ('table', 'thead', 'tbody', 'tfoot'), true)
  UNION ALL SELECT page_id, 'table_cells', pos, 'not in a row' FROM u WHERE kind IN ('td', 'th') AND coalesce(above <> 'tr', true)
  UNION ALL SELECT page_id, 'heading_nesting', pos, CASE WHEN before = 0 THEN 'the first heading is of level ' || level ELSE 'level ' || level || ' follows level ' || before END FROM hd WHERE level > before + 1
  UNION ALL SELECT page_id, 'table_headers', pos, 'no header cells' FROM u WHERE kind = 'table' AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.page_id = u.page_id AND cl.tbl = u.pos AND heads > 0)
  UNION ALL SELECT page_id, 'table_regularity', tbl, 'rows of ' || min(n) || ' to ' || max(n) || ' columns' FROM cl GROUP BY page_id, tbl HAVING min(n) <> max(n))"""


@query(f"WITH {_ELEMENTS} SELECT page_id, pos, kind, depth, parent FROM e", name="page_elements")
def _page_elements(t):
    return structure.elements(_pages(t), "page_id").drop("attributes")


@query(f"WITH {_ELEMENTS}, {_FINDINGS} SELECT * FROM f", name="structure_rules")
def _structure_rules(t):
    return structure.structure_findings(structure.elements(_pages(t), "page_id"), "page_id")


# Events of a user are a batch; some have arguments that are not known, none, or no object.
_PARAMS = """CASE WHEN event_id % 97 = 0 AND user_id % 3 = 0 THEN '[1, 2]' WHEN event_id % 31 = 0 THEN replace(props, '"k"', '"kk"') WHEN event_id % 37 = 0 THEN '{}' WHEN event_id % 41 = 0 THEN '{"k": null, "note": "x"}' WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 3 = 0 THEN '{"note": "n", "k": 5}' ELSE props END"""
_TOOLS = {"click": (["k", "note"], ["k"]), "view": (["k", "note"], []), "error": (["k"], ["k"]), "signup": (["k", "note"], ["k"])}
_CHECKED = f"""s AS (SELECT user_id AS batch, event_id AS step, event_type AS id, {_PARAMS} AS params FROM events),
t AS (SELECT unnest([{", ".join(f"'{k}'" for k in _TOOLS)}]) AS command, unnest([{", ".join(str(k) for k, _ in _TOOLS.values())}]) AS known, unnest([{", ".join(f"CAST({r} AS VARCHAR[])" for _, r in _TOOLS.values())}]) AS required),
k AS (SELECT *, coalesce(json_type(coalesce(params, '{{}}')) = 'OBJECT', false) AS object, CASE WHEN json_type(coalesce(params, '{{}}')) = 'OBJECT' THEN json_keys(coalesce(params, '{{}}')) END AS given FROM s LEFT JOIN t ON id = command),
c AS (SELECT *, CASE WHEN NOT object THEN 'step params must be an object' WHEN command IS NULL THEN 'no command ' || id WHEN len(list_filter(given, lambda x: NOT list_contains(known, x))) > 0 THEN id || ': unknown argument ' || list_filter(given, lambda x: NOT list_contains(known, x))[1]
  WHEN len(list_filter(required, lambda x: NOT list_contains(given, x) OR json_extract_string(params, '$.' || x) IS NULL)) > 0 THEN id || ': missing argument ' || required[1] END AS error FROM k),
b AS (SELECT batch, count(*) AS n, min(step) FILTER (WHERE NOT object) AS broken, min(step) FILTER (WHERE error IS NOT NULL) AS first FROM c GROUP BY batch)"""


def _steps(t) -> tuple[DataFrame, DataFrame]:
    events = t("events")
    steps = events.select(F.col("user_id").alias("batch"), F.col("event_id").alias("step"), F.col("event_type").alias("id"), F.expr(_PARAMS).alias("params"))
    return steps, events.sparkSession.createDataFrame([(c, *v) for c, v in _TOOLS.items()], "command string, known array<string>, required array<string>")


@query(f"WITH {_CHECKED} SELECT batch, step, id, error IS NULL AS ok, error FROM c JOIN b USING (batch) WHERE broken IS NULL AND n <= 1000 AND (first IS NULL OR step <= first)", name="command_batch")
def _command_batch(t):
    return commands.batch_results(*_steps(t))


@query(
    f"""WITH {_CHECKED} SELECT batch, count(*) FILTER (WHERE broken IS NULL AND (first IS NULL OR step < first)) AS completed, CAST(max(CASE WHEN broken IS NULL AND first IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS failed,
    CASE WHEN max(broken) IS NOT NULL THEN 'step params must be an object' END AS rejected FROM c JOIN b USING (batch) GROUP BY batch""",
    name="command_summary",
)
def _command_summary(t):
    return commands.batch_summary(*_steps(t))


@query(f"WITH {_CHECKED} SELECT batch, step, error FROM c WHERE error IS NOT NULL", name="command_arguments")
def _command_arguments(t):
    return commands.checked(*_steps(t)).where("error is not null").select("batch", "step", "error")


@query("SELECT p_partkey AS id, p_name AS title FROM part WHERE p_size > 25 AND contains(lower(concat_ws(' ', p_partkey, p_name)), 'a') AND contains(lower(concat_ws(' ', p_partkey, p_name)), '1')", name="command_list")
def _command_list(t):
    rows = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), (F.col("p_size") > 25).alias("enabled"))
    return commands.command_list(rows, " A  1", enabled_only=True).select("id", "title")
