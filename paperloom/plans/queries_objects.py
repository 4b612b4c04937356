"""Queries of objects: chains of references over revisions, pages with what they inherit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators import objects
from paperloom.plans.register import Register

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.oracles

# Twenty conversations are a document; a turn refers to the next one, or to the next conversation, or to nothing.  Every third has a later revision.
_OBJECTS = """c AS (SELECT conv_id // 20 AS doc, conv_id % 20 * 100 + turn AS num, conv_id % 20 AS k, turn, max(length(coalesce(text, ''))) AS n FROM conversations GROUP BY ALL),
o AS (SELECT doc, num, 0 AS rev, 0 AS gen, false AS free, CASE WHEN n % 13 > 0 THEN CASE WHEN n % 7 > 0 THEN num + 1 ELSE (k + 1) % 20 * 100 END END AS nxt, CASE WHEN n % 13 = 0 THEN n END AS value FROM c
  UNION ALL SELECT doc, num, 1, n % 4 // 3, n % 19 = 0, CASE WHEN n % 5 > 0 THEN (k + n % 3) % 20 * 100 + n % 2 END, CASE WHEN n % 5 = 0 THEN -n END FROM c WHERE (k + turn) % 3 = 0),
live AS (SELECT * FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc, num ORDER BY rev DESC, gen DESC) = 1) WHERE NOT free)"""


def _objects(t) -> DataFrame:
    c = t("conversations").groupBy(F.expr("conv_id div 20").alias("doc"), F.expr("conv_id % 20 * 100 + turn").alias("num"), F.expr("conv_id % 20").alias("k"), "turn").agg(F.max(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("n"))
    first = c.selectExpr("doc", "num", "0 as rev", "0 as gen", "false as free", "case when n % 13 > 0 then case when n % 7 > 0 then num + 1 else (k + 1) % 20 * 100 end end as to", "0 as to_gen", "case when n % 13 = 0 then n end as value")
    then = c.where("(k + turn) % 3 = 0").selectExpr("doc", "num", "1 as rev", "cast(n % 4 div 3 as int) as gen", "n % 19 = 0 as free", "case when n % 5 > 0 then (k + n % 3) % 20 * 100 + n % 2 end as to", "0 as to_gen", "case when n % 5 = 0 then -n end as value")
    return first.unionByName(then)


@query(
    f"""WITH RECURSIVE {_OBJECTS}, w AS (SELECT doc, num, num AS cur, 0 AS hops, [num] AS seen, 'go' AS state FROM live
      UNION ALL SELECT w.doc, w.num, CASE WHEN l.nxt IS NULL THEN w.cur ELSE l.nxt END, CASE WHEN l.nxt IS NULL OR n.num IS NULL THEN hops ELSE hops + 1 END, list_append(seen, l.nxt),
        CASE WHEN l.nxt IS NULL THEN 'value' WHEN n.num IS NULL THEN 'dangling' WHEN list_contains(seen, l.nxt) THEN 'cycle' ELSE 'go' END
      FROM w JOIN live l ON l.doc = w.doc AND l.num = w.cur LEFT JOIN live n ON n.doc = w.doc AND n.num = l.nxt AND n.gen = 0 WHERE w.state = 'go')
    SELECT w.doc, w.num, CASE WHEN state <> 'cycle' THEN cur END AS "end", CASE WHEN state <> 'cycle' THEN CAST(hops AS BIGINT) END AS hops, state, CASE WHEN state = 'value' THEN l.value END AS value
    FROM w LEFT JOIN live l ON l.doc = w.doc AND l.num = w.cur WHERE state <> 'go'""",
    name="object_chains",
)
def _object_chains(t):
    return objects.resolved(_objects(t))


@query(f"WITH {_OBJECTS} SELECT doc, num, rev, gen, nxt AS \"to\", value FROM live", name="object_newest")
def _object_newest(t):
    return objects.newest(_objects(t)).select("doc", "num", "rev", "gen", "to", "value")


# The documents of a source make a tree with three branches a node, in order of their ids.
_NODES = """n AS (SELECT source AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS num, n_chars AS c FROM documents),
t AS (SELECT *, CASE WHEN num > 0 THEN (num - 1) // 3 END AS parent, (num + 2) % 3 AS pos, CASE WHEN c % 3 = 0 OR num = 0 THEN [0.0, 100.0 + c % 90, 400.0 + c % 211, 0.0] END AS media, CASE WHEN c % 11 = 0 THEN [50.0, 20.0, 300.0 - c % 260, 500.0] END AS crop,
  CASE WHEN c % 5 = 0 THEN c % 7 * 90 - 180 WHEN c % 17 = 0 THEN 45 END AS rotate FROM n),
w AS (SELECT doc, num, [pos] AS path, media, crop, rotate FROM t WHERE parent IS NULL
  UNION ALL SELECT t.doc, t.num, list_append(path, t.pos), coalesce(t.media, w.media), coalesce(t.crop, w.crop), coalesce(t.rotate, w.rotate) FROM t JOIN w ON t.doc = w.doc AND t.parent = w.num)"""


@query(
    f"""WITH RECURSIVE {_NODES},
    l AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY path, num) AS page FROM w WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc = w.doc AND t.parent = w.num)),
    b AS (SELECT *, greatest(least(media[1], media[3]), least(c[1], c[3])) AS a, greatest(least(media[2], media[4]), least(c[2], c[4])) AS b, least(greatest(media[1], media[3]), greatest(c[1], c[3])) AS e, least(greatest(media[2], media[4]), greatest(c[2], c[4])) AS f,
      CASE WHEN coalesce(rotate, 0) % 90 = 0 THEN ((coalesce(rotate, 0) % 360) + 360) % 360 ELSE 0 END AS rotation FROM (SELECT *, coalesce(crop, media) AS c FROM l)),
    g AS (SELECT doc, page, num, rotation, CASE WHEN e - a >= 1 AND f - b >= 1 THEN [a, b, e, f] ELSE [0.0, 0.0, 612.0, 792.0] END AS x FROM b)
    SELECT doc, page, num, x[1] AS x0, x[2] AS y0, x[3] AS x1, x[4] AS y1, CAST(rotation AS BIGINT) AS rotation, CASE WHEN rotation % 180 = 90 THEN x[4] - x[2] ELSE x[3] - x[1] END AS width, CASE WHEN rotation % 180 = 90 THEN x[3] - x[1] ELSE x[4] - x[2] END AS height FROM g""",
    name="page_inspect",
)
def _page_inspect(t):
    num = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    n = t("documents").select(F.col("source").alias("doc"), num.cast("long").alias("num"), F.col("n_chars").alias("c"))
    n = n.withColumn("last", F.max("num").over(Window.partitionBy("doc")))
    nodes = n.selectExpr(
        "doc", "num", "case when num > 0 then (num - 1) div 3 end as parent", "(num + 2) % 3 as pos", "num * 3 + 1 > last as leaf",
        "case when c % 3 = 0 or num = 0 then array(0d, 100d + c % 90, 400d + c % 211, 0d) end as media", "case when c % 11 = 0 then array(50d, 20d, 300d - c % 260, 500d) end as crop", "case when c % 5 = 0 then c % 7 * 90 - 180 when c % 17 = 0 then 45 end as rotate",
    )
    return objects.page_table(nodes)
