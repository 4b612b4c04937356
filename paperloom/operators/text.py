"""Search, personal data and word lists over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import PATTERNS, collapsed, find_count, fold, phrase


def text_find(docs: DataFrame, needle: str, key: str = "doc_id", case_sensitive: bool = False, whole_words: bool = False) -> DataFrame:
    """(key, hits) of the texts with the phrase."""
    return docs.select(key, find_count(F.col("text"), needle, case_sensitive, whole_words).cast("long").alias("hits")).where("hits > 0")


def text_find_limit(docs: DataFrame, needle: str, limit: int = 500, key: str = "doc_id") -> DataFrame:
    """(key, pos): the first ``limit`` hits, by text and place of the match in the folded text."""
    wanted = phrase(needle)
    pieces = F.split(collapsed(fold(F.col("text"))), "\\Q" + wanted + "\\E")
    hits = docs.select(key, F.posexplode(F.slice(pieces, 1, F.size(pieces) - 1)).alias("i", "piece"))
    before = F.sum(F.length("piece")).over(Window.partitionBy(key).orderBy("i"))
    return hits.select(key, (before + F.col("i") * len(wanted)).cast("long").alias("pos")).orderBy(key, "pos").limit(limit)


def phrase_counts(docs: DataFrame, phrases: DataFrame, by: str, most: int = 1000) -> DataFrame:
    """(phrase, by, docs): texts that hold each phrase; phrases are distinct, folded and at most ``most`` (the feature's limit).

    All phrases are one row beside each text.  A phrase of three words or more has its longest inner word in any text
    that holds it, so only those whose word is among the text's are looked for; shorter ones are looked for in every text.
    No text is copied.
    """
    folded = phrases.select(F.btrim(collapsed(fold(F.col("phrase")))).alias("phrase")).where("phrase <> ''").distinct().orderBy("phrase").limit(most)
    inner = folded.withColumn("words", F.split("phrase", " ")).withColumn("inner", F.expr("slice(words, 2, greatest(size(words) - 2, 0))"))
    rare = inner.select("phrase", F.expr("try_element_at(array_sort(inner, (x, y) -> case when length(x) <> length(y) then length(y) - length(x) when x < y then -1 when x > y then 1 else 0 end), 1)").alias("word"))
    by_word = rare.groupBy("word").agg(F.collect_list("phrase").alias("phrases"))
    wanted = by_word.agg(F.map_from_entries(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "phrases")))).alias("long"), F.flatten(F.collect_list(F.when(F.col("word").isNull(), F.col("phrases")))).alias("short"))
    seen = docs.select(by, collapsed(fold(F.col("text"))).alias("t")).crossJoin(F.broadcast(wanted))
    likely = F.flatten(F.transform(F.array_intersect(F.array_distinct(F.split("t", " ")), F.map_keys("long")), lambda w: F.element_at("long", w)))
    hits = F.filter(F.concat(likely, "short"), lambda p: F.col("t").contains(p))
    return seen.select(by, F.explode(hits).alias("phrase")).groupBy("phrase", by).agg(F.count("*").alias("docs"))


def pii_hits(docs: DataFrame, kind: str, key: str = "doc_id") -> DataFrame:
    """(key, hit) of a personal-data pattern, one row a match."""
    return docs.select(key, F.explode(PATTERNS[kind](collapsed(F.col("text")))).alias("hit"))


def word_list(docs: DataFrame, key: str = "doc_id", entries: int = 1000, chars: int = 256) -> DataFrame:
    """(entry): trimmed, non-empty lines in order of first occurrence, each once, at most ``entries``."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    clean = lines.select(key, "pos", F.btrim("line", F.lit(" \t\r")).alias("entry")).where(f"entry <> '' and char_length(entry) <= {chars}")
    first = clean.groupBy("entry").agg(F.min(F.struct(key, "pos")).alias("at"))
    return first.orderBy("at", "entry").limit(entries).select("entry")


def catalog_search(tools: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows whose joined columns hold every word of the query."""
    hay = F.lower(F.concat_ws(" ", *columns))
    return tools.where(F.forall(F.split(F.lit(" ".join(query.lower().split())), " "), lambda w: F.contains(hay, w)))


def text_extract(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): each page's lines joined, right-trimmed, a newline behind, form feeds between pages."""
    pages = lines.groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    shown = pages.select(key, "page", F.concat(F.rtrim(F.array_join(F.col("l.text"), "\n")), F.lit("\n")).alias("t"))
    return shown.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("page", "t")))["t"], "\f").alias("text"))


def unlinked(hits: DataFrame, links: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits (key, start, end) that overlap no span already under a link."""
    taken = links.select(F.col(key).alias("__k"), F.col("start").alias("__a"), F.col("end").alias("__b"))
    return hits.join(taken, (F.col(key) == F.col("__k")) & (F.col("start") < F.col("__b")) & (F.col("end") > F.col("__a")), "left_anti")


def pattern_spans(docs: DataFrame, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, start, end) of every match of a pattern in (key, text) rows; ``key`` is unique, matches are not empty."""
    between, found = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    cut = docs.select(key, between.alias("b"), found.alias("f")).where(F.size("f") > 0).select(key, F.posexplode(F.arrays_zip("b", "f")).alias("i", "z"))
    long = F.coalesce(F.length("z.f"), F.lit(0))
    ends = F.sum(F.length("z.b") + long).over(Window.partitionBy(key).orderBy("i"))
    return cut.withColumn("end", ends.cast("long")).where("z.f is not null").select(key, (F.col("end") - long).alias("start"), "end")


#: Characters of a stretch in which offsets and lines meet.
STRETCH = 1024


def text_at(docs: DataFrame, picks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pick, line, first, last, word, word_first, word_last) of offsets (key, pick, at) into texts (key, text), all in characters, ends exclusive.

    ``line`` counts from 0; an offset at a line's end belongs to that line.  ``word`` is the run of what is not white
    space around the offset, null on white space and at a line's end.  Offsets outside of the text, and of null texts,
    have no row.  Lines know their places by prefix sums, and meet offsets by equal stretches of the text.
    """
    lines = docs.where("text is not null").select(key, F.posexplode(F.split("text", "\n")).alias("line", "l"))
    order = Window.partitionBy(key).orderBy("line")
    placed = lines.withColumn("last", (F.sum(F.length("l")).over(order) + F.col("line")).cast("long")).withColumn("first", F.col("last") - F.length("l"))
    cut = placed.withColumn("__s", F.explode(F.sequence(F.expr(f"first div {STRETCH}"), F.expr(f"last div {STRETCH}"))))
    asked = picks.where("at >= 0").select(key, "pick", "at", F.expr(f"at div {STRETCH}").alias("__s"))
    met = cut.join(asked, [key, "__s"]).where(F.col("at").between(F.col("first"), F.col("last")))
    inside = (F.col("at") - F.col("first")).cast("int")
    head, tail = F.regexp_extract(F.substr("l", F.lit(1), inside), r"(\S*)$", 1), F.regexp_extract(F.substr("l", inside + 1), r"^(\S*)", 1)
    word = F.when(tail != "", F.concat(head, tail))
    begin = F.when(tail != "", F.col("at") - F.length(head))
    return met.select(key, "pick", F.col("line").cast("long").alias("line"), "first", "last", word.alias("word"), begin.alias("word_first"), (begin + F.length(word)).alias("word_last"))
