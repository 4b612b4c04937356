"""Chat formatting: logged snapshots of one conversation collapse to the longest, which is rendered.

Every turn's hash takes in its place, so the running exclusive-or over a conversation is a hash
of each turn prefix.  A conversation whose whole hash is a proper prefix of another's goes (an
anti-join on distinct hashes); equal ones keep the lowest id.  Orders, running hashes and
rendering work on parts of PART turns, so no conversation has to fit one task.  DataFrame
operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import materialize

PART = 256


def escaped(x: Column) -> Column:
    """One backslash more in every ``<|``, ``<\\|`` ..., so that no text can pose as a mark."""
    return F.regexp_replace(x, r"<(\\*)\|", r"<\\$1|")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), escaped(role), F.lit("|>\n"), escaped(text), F.lit("<|end|>\n"))


def _ranked(turns: DataFrame) -> DataFrame:
    """(conv_id, rank, role, text): the place of each turn in its conversation, from 1.

    Rows are sorted within stretches of PART turn numbers; stretches are then counted up.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("stretch", F.floor(F.col("turn") / PART))
    placed = clean.withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "text")))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = clean.groupBy("conv_id", "stretch").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    same = F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")) & F.col("p.stretch").eqNullSafe(F.col("s.stretch"))
    return placed.alias("p").join(sizes.alias("s"), same).select("p.conv_id", (F.col("r") + F.col("before")).cast("long").alias("rank"), "role", "text")


def _prefixes(ranked: DataFrame) -> DataFrame:
    """(conv_id, rank, x, y): 128 bits of hash of each conversation's first ``rank`` turns."""
    keyed = ranked.select("conv_id", "rank", F.floor((F.col("rank") - 1) / PART).alias("part"), F.xxhash64("rank", "role", F.lit(0), "text").alias("x"), F.xxhash64(F.lit(1), "text", "rank", "role").alias("y"))
    running = Window.partitionBy("conv_id", "part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.select("conv_id", "part", "rank", *(F.bit_xor(c).over(running).alias(c) for c in ("x", "y")))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy("conv_id", "part").agg(F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty"))
    totals = totals.select("conv_id", "part", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("tx", "ty")))
    same = F.col("l.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("l.part") == F.col("t.part"))
    return local.alias("l").join(totals.alias("t"), same).select("l.conv_id", "rank", F.col("x").bitwiseXOR(F.col("tx")).alias("x"), F.col("y").bitwiseXOR(F.col("ty")).alias("y"))


def chat_format(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, n_logged, rendered) of the maximal conversations of (conv_id, turn, role, text) rows.

    ``rendered`` is the text of turns PART * part + 1 to PART * part + PART by their place in the
    conversation; ``n_turns`` counts the whole conversation and ``n_logged`` the conversations equal
    to it.  Turns sort by number, equal numbers by role and text, null numbers first; repeated rows
    are turns of their own.  A null role or text is empty; the rows of a null conv_id are one
    conversation.  Marks inside roles and texts are escaped.  Extra columns are not read; an empty
    table gives an empty one.
    """
    ranked = materialize(_ranked(turns), "turns")
    prefixes = _prefixes(ranked)
    wholes = prefixes.groupBy("conv_id").agg(F.max(F.struct("rank", "x", "y")).alias("w")).select("conv_id", "w.*")
    distinct = wholes.groupBy("rank", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    lengths = wholes.select(F.col("conv_id").alias("id"), F.col("rank").alias("whole"))
    proper = prefixes.join(lengths, F.col("conv_id").eqNullSafe(F.col("id"))).where("rank < whole").select("rank", "x", "y").distinct()
    maximal = distinct.join(proper, ["rank", "x", "y"], "left_anti").select(F.col("conv_id").alias("id"), F.col("rank").alias("n_turns"), "n_logged")
    kept = ranked.join(maximal, F.col("conv_id").eqNullSafe(F.col("id"))).withColumn("part", F.floor((F.col("rank") - 1) / PART))
    parts = kept.groupBy("conv_id", "part", "n_turns", "n_logged").agg(F.sort_array(F.collect_list(F.struct("rank", "role", "text"))).alias("rows"))
    rendered = F.array_join(F.transform("rows", lambda r: render(r["role"], r["text"])), "")
    return parts.select("conv_id", "part", "n_turns", "n_logged", rendered.alias("rendered"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL, with prefixes as text."""
    clean = r"regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g')"
    return rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rank FROM conversations),
p AS (SELECT conv_id, rank, string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY rank) AS prefix FROM t),
w AS (SELECT conv_id, max(rank) AS n_turns FROM p GROUP BY conv_id),
d AS (SELECT p.prefix, w.n_turns, min(p.conv_id) AS conv_id, count(*) AS n_logged FROM p JOIN w ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.rank = w.n_turns GROUP BY p.prefix, w.n_turns),
s AS (SELECT DISTINCT prefix FROM p JOIN w ON p.conv_id IS NOT DISTINCT FROM w.conv_id WHERE p.rank < w.n_turns),
k AS (SELECT * FROM d WHERE prefix NOT IN (SELECT prefix FROM s))
SELECT t.conv_id, CAST((t.rank - 1) // {PART} AS BIGINT) AS part, CAST(any_value(k.n_turns) AS BIGINT) AS n_turns, CAST(any_value(k.n_logged) AS BIGINT) AS n_logged,
  string_agg('<|' || {clean.format("t.role")} || '|>' || chr(10) || {clean.format("t.text")} || '<|end|>' || chr(10), '' ORDER BY t.rank) AS rendered
FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY t.conv_id, (t.rank - 1) // {PART}
"""
