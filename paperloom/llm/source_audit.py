"""Source divergence audit: how far the words of each source are from those of the others and of their language.

1. Blocks of texts are counted by DuckDB inside the tasks; Spark sums those counts by (lang, source,
   term) with partial sums on either side of the shuffle, so neither a hot source nor a hot term
   comes together before it is small.
2. Counts go to shards by a hash of (lang, term); in each, DuckDB keeps the terms of enough documents.
3. Spark sums tokens by source and terms by language.  Every shard gets those sums (a row a source:
   the result has a row for each two of them) and DuckDB makes its part of every pair's divergence,
   and of every source its own first terms.
4. Spark sums the parts and ranks.

A probability is an integer, in units of 1e-9, and so is all that follows from it: sums do not depend
on shards.  A source with no use of a term still has a probability for it, so a shard works on all
sources of a language for each of its terms.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import cache

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import arrow_map, materialize, parts, utf8

#: Runs of letters; every character beyond ASCII is one.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that have to use a term, terms a source is told by, and the unit of probabilities.
LEAST_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Text that DuckDB counts at once.
BLOCK_BYTES = 12_000_000

COUNTED = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, source string, term string, n long, fresh int"
PARTIAL = "part string, lang string, source string, item string, value decimal(38,0)"


@cache
def _db() -> duckdb.DuckDBPyConnection:
    """This worker's connection: one thread, bounded memory, spilling into the task's own scratch folder."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": tempfile.gettempdir(), "preserve_insertion_order": False})


def _sql(query: str, **tables: pa.Table) -> pa.Table:
    db = _db()
    for name, t in tables.items():
        db.register(name, t)
    try:
        return db.sql(query).to_arrow_table()
    finally:
        for name in tables:
            db.unregister(name)


def _shaped(table: pa.Table, schema: pa.Schema) -> pa.Table:
    return table.select(schema.names).cast(schema)


def _schema(**types: pa.DataType) -> pa.Schema:
    return pa.schema(list(types.items()))


_COUNTED = _schema(lang=pa.string(), source=pa.string(), term=pa.string(), n=pa.int64(), docs=pa.int64())
_KEPT = _schema(lang=pa.string(), source=pa.string(), term=pa.string(), n=pa.int64(), fresh=pa.int32())
_PARTIAL = _schema(part=pa.string(), lang=pa.string(), source=pa.string(), item=pa.string(), value=pa.decimal128(38, 0))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, source, text) rows: each term's uses and texts by language and source, block by block."""
    held: list[tuple[str, str, str]] = []
    size = 0

    def counted() -> Iterator[pa.RecordBatch]:
        langs, sources, texts = (pa.array(c, pa.string()) for c in zip(*held, strict=True))
        table = pa.table({"doc": pa.array(range(len(held)), pa.int32()), "lang": langs, "source": sources, "text": texts})
        found = _sql(
            f"""
            WITH t AS (SELECT doc, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM texts),
            d AS (SELECT doc, term, count(*) AS n FROM t GROUP BY doc, term)
            SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS docs FROM d JOIN texts USING (doc) GROUP BY lang, source, term
            """,
            texts=table,
        )
        yield from _shaped(found, _COUNTED).to_batches()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), strict=True):
            if size and size + len(text) > BLOCK_BYTES:
                yield from counted()
                held, size = [], 0
            held.append((lang, source, text.lower().decode("utf-8", "replace")))
            size += len(text) + 64
    if held:
        yield from counted()


def _kept(least: int):
    """Of one shard: terms in ``least`` documents of their language, ``fresh`` in one row of each."""

    def run(table: pa.Table) -> pa.Table:
        return _shaped(
            _sql(
                f"""
                SELECT lang, source, term, n, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::INTEGER AS fresh
                FROM counts QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {least}
                """,
                counts=table,
            ),
            _KEPT,
        )

    return run


def _probability(n: str, tokens: str, terms: str) -> str:
    return f"(1 + ({UNIT}::HUGEINT * ({n} + 2)) // ({tokens}::HUGEINT + 2 * {terms}))"


def _divergence(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) // ({p} + {q})"


def _partial(top: int):
    """Of one shard, its kept terms and (rows without a term) all sources: sums for each two sources (once), and each source's first terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):
            return
        found = _shaped(
            _sql(
                f"""
                WITH kept AS (SELECT lang, source, term, n FROM shard WHERE term IS NOT NULL),
                sources AS (SELECT lang, source, tokens, terms FROM shard WHERE term IS NULL),
                langs AS (SELECT lang, any_value(terms) AS terms, sum(tokens)::HUGEINT AS tokens FROM sources GROUP BY lang),
                terms AS (SELECT lang, term, {_probability("sum(n)::HUGEINT", "any_value(tokens)", "any_value(terms)")} AS q FROM kept JOIN langs USING (lang) GROUP BY lang, term),
                dense AS (SELECT lang, term, source, coalesce(n, 0) AS n, {_probability("coalesce(n, 0)", "tokens", "s.terms")} AS p, q
                  FROM terms JOIN sources s USING (lang) LEFT JOIN kept USING (lang, term, source)),
                pairs AS (SELECT lang, a.source, b.source AS item, sum({_divergence("a.p", "b.p")}) AS value FROM dense a JOIN dense b USING (lang, term) WHERE a.source < b.source GROUP BY ALL),
                firsts AS (SELECT lang, source, term AS item, {_divergence("p", "q")} AS value FROM dense WHERE n > 0 AND p > q
                  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top})
                SELECT 'pair' AS part, lang, source, item, value::DECIMAL(38, 0) AS value FROM pairs
                UNION ALL SELECT 'term', lang, source, item, value::DECIMAL(38, 0) FROM firsts
                """,
                shard=pa.Table.from_batches(held),
            ),
            _PARTIAL,
        )
        yield from found.to_batches()

    return run


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, fresh): uses of the terms that ``least_docs`` documents of their language have."""
    n = parts(docs)
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    counted = arrow_map(texts, _counts, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    shard = F.expr(f"cast(pmod(xxhash64(lang, term), {n}) as int)")
    return counted.groupBy(shard.alias("shard")).applyInArrow(_kept(least_docs), KEPT)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): every source against each other of its language, and its own first terms.

    Null lang, source or text is ''.  A source without terms is compared like any other; where a
    language keeps no term all its pairs are 0.  Repeated rows and doc_ids count as documents of
    their own.  Extra columns are not read; an empty table gives an empty one.
    """
    kept = materialize(term_counts(docs, least_docs), "terms")
    tokens = kept.groupBy("lang", "source").agg(F.sum("n").alias("tokens"))
    terms = kept.groupBy("lang").agg(F.sum("fresh").alias("terms"))
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sources = groups.join(tokens, ["lang", "source"], "left").join(terms, "lang", "left").select("lang", "source", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("terms", F.lit(0)).alias("terms"))
    sources = materialize(sources, "sources")
    n = parts(docs)
    none = F.lit(None).cast("long")
    held = kept.select(F.expr(f"cast(pmod(xxhash64(lang, term), {n}) as int)").alias("shard"), "lang", "source", "term", "n", none.alias("tokens"), none.alias("terms"))
    everywhere = sources.where("terms > 0").select(F.explode(F.expr(f"sequence(0, {n} - 1)")).alias("shard"), "lang", "source", F.lit(None).cast("string").alias("term"), none.alias("n"), "tokens", "terms")
    partial = materialize(arrow_map(held.unionByName(everywhere).repartitionById(n, "shard"), _partial(top), PARTIAL), "partial")
    half = partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    both = sources.select("lang", "source").join(sources.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = both.join(sums, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0))).withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    firsts = partial.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(firsts)
    return ranked.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


def oracle_sql(least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    """The same in DuckDB's SQL, over whole tables at once."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    p = f"1 + ({UNIT}::HUGEINT * (n + 2)) // (tokens + 2 * terms)"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{lower}') AS text FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM t),
v AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= {least_docs}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN v USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM t),
size AS (SELECT lang, count(*) AS terms FROM v GROUP BY lang),
full_counts AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
dense AS (SELECT *, {p} AS p FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source)::HUGEINT AS tokens FROM full_counts) JOIN size USING (lang)),
whole AS (SELECT lang, term, {p} AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n, any_value(terms) AS terms FROM dense GROUP BY lang, term)
  JOIN (SELECT lang, sum(n)::HUGEINT AS tokens FROM dense GROUP BY lang) USING (lang)),
sums AS (SELECT lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM dense a JOIN dense b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b USING (lang) LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source WHERE a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM dense JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {top}
"""
