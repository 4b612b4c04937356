"""Queries over texts: search, personal data, word lists, duplicates, rules, comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions.text import allowed_url, file_name, fold, host_display, html_escape, masked, urls
from paperloom.operators.aggregates import body_size, f1_summary, lowest, space_audit, word_f1
from paperloom.operators.compare import change_counts, changed, dedupe, with_changes, word_diff
from paperloom.operators.rules import Rule, category_counts, findings, rule_report, shown_findings, status_counts
from paperloom.operators.text import catalog_search, phrase_counts as count_phrases, pii_hits, text_extract, text_find, text_find_limit, word_list
from paperloom.plans.register import Register
from paperloom.sources.storage import dealt

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.oracles

PHRASE = "The of"
_FOLD = "regexp_replace(lower(translate(coalesce(text, ''), 'Iİı', 'iii')), '\\s+', ' ', 'g')"


@query(f"SELECT doc_id, CAST((length(t) - length(replace(t, 'the of', ''))) / 6 AS BIGINT) AS hits FROM (SELECT doc_id, {_FOLD} AS t FROM documents) WHERE contains(t, 'the of')", name="text_find")
def _text_find(t):
    return text_find(t("documents"), PHRASE)


@query(
    "SELECT doc_id, CAST((length(t) - length(replace(t, 'The', ''))) / 3 AS BIGINT) AS hits FROM (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM documents) WHERE contains(t, 'The')",
    name="text_find_case",
)
def _text_find_case(t):
    return text_find(t("documents"), "The", case_sensitive=True)


@query(
    f"""SELECT doc_id, CAST((length(t) - length(replace(t, ' the ', ''))) / 5 AS BIGINT) AS hits FROM (SELECT doc_id, ' ' || regexp_replace({_FOLD}, '([^\\p{{L}}\\p{{N}}])', ' \\1 ', 'g') || ' ' AS t FROM documents) WHERE contains(t, ' the ')""",
    name="text_find_words",
)
def _text_find_words(t):
    return text_find(t("documents"), "the", whole_words=True)


@query(
    f"""WITH RECURSIVE s AS (SELECT doc_id, {_FOLD} AS t FROM documents), h(doc_id, rest, base, pos) AS (
    SELECT doc_id, substr(t, strpos(t, 'the of') + 6), strpos(t, 'the of') + 5, strpos(t, 'the of') - 1 FROM s WHERE strpos(t, 'the of') > 0
    UNION ALL SELECT doc_id, substr(rest, strpos(rest, 'the of') + 6), base + strpos(rest, 'the of') + 5, base + strpos(rest, 'the of') - 1 FROM h WHERE strpos(rest, 'the of') > 0)
    SELECT doc_id, CAST(pos AS BIGINT) AS pos FROM h ORDER BY doc_id, pos LIMIT 500""",
    name="text_find_limit",
)
def _text_find_limit(t):
    return text_find_limit(t("documents"), PHRASE)


@query(
    f"""WITH p AS (SELECT DISTINCT trim(regexp_replace(lower(translate(array_to_string(string_split(text, ' ')[1:4], ' '), 'Iİı', 'iii')), '\\s+', ' ', 'g')) AS phrase FROM benchmark),
    d AS (SELECT lang, {_FOLD} AS t FROM documents)
    SELECT phrase, lang, count(*) AS docs FROM d JOIN (SELECT phrase FROM p WHERE phrase <> '' ORDER BY phrase LIMIT 1000) p ON contains(t, phrase) GROUP BY phrase, lang""",
    name="phrase_counts",
)
def _phrase_counts(t):
    phrases = t("benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("phrase"))
    return count_phrases(t("documents"), phrases, "lang")


@query("SELECT lang, count(*) AS docs, CAST(sum(length(lower(translate(text, 'Iİı', 'iii')))) AS BIGINT) AS chars FROM documents GROUP BY lang", name="text_fold")
def _text_fold(t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length(fold(F.col("text")))).alias("chars"))


@query(
    r"""SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '\s+', ' ', 'g'), '[\p{L}\p{N}][\p{L}\p{N}._%+-]*@(?:[\p{L}\p{N}-]|\.[\p{L}\p{N}])*\.\p{L}{2,}')) AS hit FROM documents""",
    name="pii_email",
)
def _pii_email(t):
    return pii_hits(t("documents"), "email")


@query(
    r"""SELECT doc_id, length(m) AS chars, length(m) - length(replace(m, '█', '')) AS marks FROM (SELECT doc_id,
    regexp_replace(text, '[\p{L}\p{N}][\p{L}\p{N}._%+-]*@(?:[\p{L}\p{N}-]|\.[\p{L}\p{N}])*\.\p{L}{2,}', '█', 'g') AS m FROM documents)""",
    name="redact_mask",
)
def _redact_mask(t):
    m = t("documents").select("doc_id", masked(F.col("text"), ("email",)).alias("m"))
    return m.select("doc_id", F.length("m").cast("long").alias("chars"), (F.length("m") - F.length(F.replace("m", F.lit("█"), F.lit("")))).cast("long").alias("marks"))


@query(
    r"""SELECT page_id, rtrim(u, '.,;:!?') AS url FROM (SELECT page_id, unnest(regexp_extract_all(url, '(?:https?://|www\.)[^\s<>"''()\[\]{}]*')) AS u FROM pages)""",
    name="url_extract",
)
def _url_extract(t):
    return t("pages").select("page_id", F.explode(urls(F.col("url"))).alias("url"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^\\s]+$') AND length(url) <= 2048 AS allowed, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages", name="url_rules")
def _url_rules(t):
    return t("pages").select("page_id", allowed_url(F.col("url")).alias("allowed"), host_display(F.col("url")).alias("host"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    c AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS entry FROM l), f AS (SELECT entry, min((doc_id, pos)) AS seen FROM c WHERE entry <> '' AND length(entry) <= 256 GROUP BY entry)
    SELECT entry FROM f ORDER BY seen, entry LIMIT 1000""",
    name="word_list",
)
def _word_list(t):
    return word_list(t("documents"))


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#2')", name="catalog_search")
def _catalog_search(t):
    return catalog_search(t("part").select("p_partkey", "p_name", "p_brand", "p_type"), "Ring brand#2", ["p_name", "p_brand", "p_type"])


@query("SELECT source, count(*) AS docs, count(*) FILTER (WHERE doc_id <> keeper) AS copies FROM (SELECT source, doc_id, min(doc_id) OVER (PARTITION BY text) AS keeper FROM documents) GROUP BY source", name="dedupe_by_source")
def _dedupe_by_source(t):
    d = t("documents")
    kept = dedupe(d, "doc_id", "text")
    return d.select("doc_id", "source").join(kept, "doc_id").groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("doc_id") != F.col("keeper")).alias("copies"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keeper FROM documents", name="dedupe")
def _dedupe(t):
    return dedupe(t("documents"), "doc_id", "text")


_RULE_SQL = """SELECT * FROM (VALUES ('title length', 'document'), ('language', 'document'), ('long lines', 'page'), ('contacts', 'content'), ('reading order', 'page'), ('contrast', 'page')) r(rule, category)"""


def _rules() -> list[Rule]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [
        Rule("title length", "document", F.length(F.substring_index(text, "\n", 1)) > 500, "the first line is too long"),
        Rule("language", "document", ~F.coalesce(F.col("lang").isin("en", "de", "fr", "es"), F.lit(False)), "the language is not known"),
        Rule("long lines", "page", F.length(text) > 50_000, "the text is too long"),
        Rule("contacts", "content", text.contains("@"), "the text holds an address"),
        Rule("reading order", "page", None, manual=True),
        Rule("contrast", "page", F.lit(False)),
    ]


_COUNT_SQL = """f AS (SELECT doc_id, 'title length' AS rule FROM documents WHERE length(string_split(text, chr(10))[1]) > 500 UNION ALL SELECT doc_id, 'language' FROM documents WHERE lang NOT IN ('en', 'de', 'fr', 'es')
    UNION ALL SELECT doc_id, 'long lines' FROM documents WHERE length(text) > 50000 UNION ALL SELECT doc_id, 'contacts' FROM documents WHERE contains(text, '@'))"""


@query(
    f"""WITH {_COUNT_SQL}, n AS (SELECT rule, count(*) AS n FROM f GROUP BY rule)
    SELECT rule, category, CASE WHEN rule = 'contrast' THEN 'Skipped' WHEN rule = 'reading order' THEN 'Manual' WHEN coalesce(n, 0) > 0 THEN 'Failed' ELSE 'Passed' END AS status, coalesce(n, 0) AS n
    FROM ({_RULE_SQL}) LEFT JOIN n USING (rule)""",
    name="rule_report",
)
def _rule_report(t):
    return rule_report(t("documents"), _rules(), "doc_id", skipped=("contrast",))


@query(
    f"""WITH {_COUNT_SQL}, n AS (SELECT rule, count(*) AS n FROM f GROUP BY rule), r AS (SELECT CASE WHEN rule = 'contrast' THEN 'Skipped' WHEN rule = 'reading order' THEN 'Manual'
    WHEN coalesce(n, 0) > 0 THEN 'Failed' ELSE 'Passed' END AS status FROM ({_RULE_SQL}) LEFT JOIN n USING (rule)) SELECT status, count(*) AS n FROM r GROUP BY status""",
    name="rule_status_counts",
)
def _rule_status_counts(t):
    return status_counts(rule_report(t("documents"), _rules(), "doc_id", skipped=("contrast",)))


@query(
    f"""WITH {_COUNT_SQL}, r AS (SELECT rule, doc_id, row_number() OVER (PARTITION BY rule ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY rule) AS n FROM f)
    SELECT rule, doc_id, CASE rule WHEN 'title length' THEN 'the first line is too long' WHEN 'language' THEN 'the language is not known' WHEN 'long lines' THEN 'the text is too long' ELSE 'the text holds an address' END AS message FROM r WHERE k <= 20
    UNION ALL SELECT DISTINCT rule, NULL, '… and ' || (n - 20) || ' more' FROM r WHERE n > 20""",
    name="rule_findings",
)
def _rule_findings(t):
    return shown_findings(findings(t("documents"), _rules(), "doc_id"), "doc_id", 20)


@query(
    """SELECT unnest(['metadata', 'comments', 'scripts', 'links', 'hidden text']) AS category, unnest([count(*) FILTER (WHERE contains(html, '<meta')), count(*) FILTER (WHERE contains(html, '<!--')),
    count(*) FILTER (WHERE contains(html, '<script')), count(*) FILTER (WHERE contains(html, 'href=')), count(*) FILTER (WHERE contains(html, 'display:none'))]) AS n FROM pages""",
    name="hidden_scan",
)
def _hidden_scan(t):
    has = lambda s: F.col("html").contains(s)
    return category_counts(t("pages"), {"metadata": has("<meta"), "comments": has("<!--"), "scripts": has("<script"), "links": has("href="), "hidden text": has("display:none")})


@query(
    """WITH c AS (SELECT unnest(['src0', 'src1', 'src2', 'none']) AS category), u AS (SELECT source AS category, sum(n_chars) AS b FROM documents GROUP BY source),
    k AS (SELECT category, CAST(coalesce(b, 0) AS BIGINT) AS bytes FROM c LEFT JOIN u USING (category)), s AS (SELECT sum(bytes) AS s, greatest(sum(bytes), 1000000000) AS w FROM k)
    SELECT category, bytes, bytes * 100.0::DOUBLE / w AS percent FROM k, s UNION ALL SELECT 'overhead', CAST(w - s AS BIGINT), (w - s) * 100.0::DOUBLE / w FROM s""",
    name="space_audit",
)
def _space_audit(t):
    return space_audit(t("documents").select(F.col("source").alias("category"), F.col("n_chars").alias("bytes")), ["src0", "src1", "src2", "none"], 1_000_000_000)


_PAIRS_SQL = """p AS (SELECT a.item_id AS pair, a.text AS got, b.text AS want FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"""


def _benchmark_pairs(t, got: str, want: str):
    b = t("benchmark")
    following = b.select((F.col("item_id") - 1).alias("pair"), F.col("text").alias(want))
    return b.select(F.col("item_id").alias("pair"), F.col("text").alias(got)).join(following, "pair")


@query(
    f"""WITH {_PAIRS_SQL}, a AS (SELECT pair, w, count(*) AS n FROM (SELECT pair, unnest(string_split(regexp_replace(lower(got), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')) AS w FROM p) WHERE w <> '' GROUP BY ALL),
    b AS (SELECT pair, w, count(*) AS n FROM (SELECT pair, unnest(string_split(regexp_replace(lower(want), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')) AS w FROM p) WHERE w <> '' GROUP BY ALL)
    SELECT pair, sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) * 2.0::DOUBLE / (sum(coalesce(a.n, 0)) + sum(coalesce(b.n, 0))) AS f1 FROM a FULL JOIN b USING (pair, w) GROUP BY pair""",
    name="word_f1",
)
def _word_f1(t):
    return word_f1(_benchmark_pairs(t, "got", "want"))


_F1_SQL = ORACLE_SQL["word_f1"]


@query(f"WITH s AS (SELECT f1, row_number() OVER (ORDER BY f1) - 1 AS i, count(*) OVER () AS n FROM ({_F1_SQL})) SELECT count(*) AS n, avg(f1) AS mean, max(f1) FILTER (WHERE i = n // 2) AS median, max(f1) FILTER (WHERE i = n // 10) AS p10 FROM s", name="f1_summary")
def _f1_summary(t):
    return f1_summary(word_f1(_benchmark_pairs(t, "got", "want")))


@query(f"SELECT pair, f1 FROM ({_F1_SQL}) ORDER BY f1, pair LIMIT 12", name="f1_lowest")
def _f1_lowest(t):
    return lowest(word_f1(_benchmark_pairs(t, "got", "want")), "pair")


# Each text loses its third word, has its fifth replaced by one that no text has, and gets another behind the eighth.
_EDITS_SQL = """e AS (SELECT item_id AS pair, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM benchmark), l AS (SELECT * FROM e WHERE len(w) >= 10 AND w[3] <> w[4] AND w[3] <> w[2])"""


def _edited_pairs(t):
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    rows = t("benchmark").select(F.col("item_id").alias("pair"), F.col("text").alias("old"), words.alias("w")).where("size(w) >= 10 and w[2] <> w[3] and w[2] <> w[1]")
    new = F.concat(F.slice("w", 1, 2), F.slice("w", 4, 1), F.array(F.lit("§§")), F.slice("w", 6, 3), F.array(F.lit("¶¶")), F.expr("slice(w, 9, size(w))"))
    return rows.select("pair", "old", F.array_join(new, " ").alias("new"))


@query(
    f"""WITH {_EDITS_SQL} SELECT pair, CAST(0 AS BIGINT) AS seq, 'Deleted' AS kind, w[3] AS old, '' AS new FROM l UNION ALL SELECT pair, 1, 'Replaced', w[5], '§§' FROM l UNION ALL SELECT pair, 2, 'Inserted', '', '¶¶' FROM l""",
    name="word_diff",
)
def _word_diff(t):
    return word_diff(_edited_pairs(t))


#: Documents of a source that one block holds (fixed value).
BLOCK = 64


def _neighbours(t):
    """Each document and the one before it from the same source, by id: whole texts.

    Ids alone are ordered by source and cut into blocks; a text goes to its block, the last of a block to the next one, too.
    """
    docs = t("documents")
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.asc_nulls_last("doc_id"))) - 1
    # A key without nulls, by which both sides are dealt; null ids are one more id.
    key = lambda d: d.withColumn("key", F.coalesce("doc_id", F.lit(-1)))
    ids = key(docs).select("key", F.col("source").alias("__source"), F.col("doc_id").alias("__id"), F.floor(place / BLOCK).alias("block"), (place % BLOCK == BLOCK - 1).alias("last"))
    own = dealt(key(docs.select("source", "doc_id", "text")), "key", size_of=docs, each=8 << 20)
    own = own.join(ids.hint("merge"), (own["key"] == ids["key"]) & F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")))
    put = own.withColumn("shift", F.explode(F.when(F.col("last"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    blocks = dealt(put.select("source", (F.col("block") + F.col("shift")).alias("block"), "doc_id", "text", "shift"), "source", "block", size_of=docs, each=8 << 20)
    old = F.lag("text").over(Window.partitionBy("source", "block").orderBy(F.desc("shift"), F.asc_nulls_last("doc_id")))
    return blocks.select(F.col("doc_id").alias("pair"), old.alias("old"), F.col("text").alias("new"), "shift").where("shift = 0").drop("shift")


_WORDS = "array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+'), lambda w: w <> ''), ' ')"


@query(f"SELECT doc_id AS pair, {_WORDS} AS forth, lag({_WORDS}, 1, '') OVER (PARTITION BY source ORDER BY doc_id) AS back FROM documents", name="word_diff_rebuilt")
def _word_diff_rebuilt(t):
    """The changes between long texts make either side out of the other."""
    pairs = with_changes(_neighbours(t))
    return changed(changed(pairs, "old", "forth"), "new", "back", back=True).select("pair", "forth", "back")


@query(name="word_diff_pairs")
def _word_diff_pairs(t):
    return word_diff(_benchmark_pairs(t, "old", "new"))


@query(f"WITH {_EDITS_SQL} SELECT pair, CAST(1 AS BIGINT) AS inserted, CAST(1 AS BIGINT) AS deleted, CAST(1 AS BIGINT) AS replaced FROM l", name="change_counts")
def _change_counts(t):
    return change_counts(word_diff(_edited_pairs(t)))


@query(
    """WITH l AS (SELECT source, CAST(floor(n_chars % 7 + 9.2 * 2 + 0.5) / 2 AS DOUBLE) AS size, CAST(sum(length(text)) AS BIGINT) AS n FROM documents GROUP BY ALL)
    SELECT source, arg_max(size, n * 1000 + size) AS size FROM l GROUP BY source""",
    name="body_size",
)
def _body_size(t):
    runs = t("documents").select("source", "text", ((F.col("n_chars") % 7) / 2 + 9.2).alias("size"))
    return body_size(runs, "source")


@query(
    """SELECT doc_id, string_agg(t, chr(12) ORDER BY page) AS text FROM (SELECT doc_id, CAST((i - 1) // 3 AS BIGINT) AS page, rtrim(string_agg(line, chr(10) ORDER BY i), ' ') || chr(10) AS t
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY ALL) GROUP BY doc_id""",
    name="text_extract",
)
def _text_extract(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("page", F.floor(F.col("line") / 3))
    return text_extract(lines)


@query("SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html, regexp_replace(url, '[\\\\/:*?\"<>|]', '_', 'g') AS file FROM pages", name="escapes")
def _escapes(t):
    return t("pages").select("page_id", html_escape(F.col("url")).alias("html"), file_name(F.col("url")).alias("file"))


