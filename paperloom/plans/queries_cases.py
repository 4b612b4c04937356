"""Queries of single functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import formcalc as fc
from paperloom.functions.coerce import num_text
from paperloom.operators.text import pii_hits
from paperloom.plans.formula import compile_formula
from paperloom.plans.register import Register
from paperloom.sources.filters import decoded

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.oracles

# -- the form language over whole tables


@query("SELECT c_custkey, c_name AS l, c_name AS r, repeat(' ', CAST(c_custkey % 5 AS INT)) AS s, lower(c_name) AS low FROM customer")
def fc_trims(t):
    blank = F.lit(" \t  ")
    return t("customer").select("c_custkey", fc.ltrim(F.concat(blank, "c_name")).alias("l"), fc.rtrim(F.concat("c_name", blank)).alias("r"), fc.space(F.col("c_custkey") % 5).alias("s"), F.lower("c_name").alias("low"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN o_orderstatus WHEN 2 THEN o_orderpriority END AS picked, CAST(o_totalprice BETWEEN 1000 AND 100000 AS DOUBLE) AS inside, CAST(o_orderstatus IN ('F', 'P') AS DOUBLE) AS listed, CAST(o_orderkey % 3 <> 0 AS DOUBLE) AS there, CAST(o_orderkey % 3 = 1 AS DOUBLE) AS filled FROM orders")
def fc_logic(t):
    key = F.col("o_orderkey")
    some = F.when(key % 3 == 1, "x").when(key % 3 == 2, " \t")
    return t("orders").select(
        "o_orderkey", fc.choose(key % 4, F.col("o_orderstatus"), F.col("o_orderpriority")).alias("picked"), fc.within(F.col("o_totalprice").cast("string"), F.lit("1000"), F.lit("100000")).alias("inside"),
        fc.one_of(F.col("o_orderstatus"), F.lit("F"), F.lit("P")).alias("listed"), fc.exists(some).alias("there"), fc.has_value(some).alias("filled"),
    )


@query("SELECT l_orderkey, l_linenumber, CASE WHEN length(s) > 9 THEN repeat('*', 9) ELSE lpad(s, 9, ' ') END AS shown FROM (SELECT l_orderkey, l_linenumber, printf('%.1f', floor(l_extendedprice * 10 + 0.5) / 10) AS s FROM lineitem)")
def fc_str(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", fc.str_(F.col("l_extendedprice"), 9, 1).alias("shown"))


@query("SELECT page_id, url_encode(url) AS encoded, url AS back, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html, html AS html_back FROM pages")
def fc_codecs(t):
    u, h = F.col("url"), F.col("html")
    return t("pages").select("page_id", fc.encode(u).alias("encoded"), fc.decode(fc.encode(u)).alias("back"), fc.encode(u, "html").alias("html"), fc.decode(fc.encode(h, "html"), "html").alias("html_back"))


@query("SELECT o_orderkey, ln(2.0::DOUBLE + o_orderkey % 7) / ln(1.01::DOUBLE) AS periods, o_totalprice / 100 AS paid FROM orders")
def fc_loans(t):
    """CTerm in closed form; Apr by what a payment at that rate comes to."""
    v, n = F.col("o_totalprice"), F.lit(360.0)
    rate = fc.apr(v, v / 100, n) / 12
    return t("orders").select("o_orderkey", fc.cterm(F.lit(0.01), (F.col("o_orderkey") % 7 + 2).cast("double"), F.lit(1.0)).alias("periods"), F.round(fc.pmt(v, rate, n), 4).alias("paid"))


ORACLE_SQL["fc_loans"] = ORACLE_SQL["fc_loans"].replace("o_totalprice / 100 AS paid", "round(o_totalprice / 100, 4) AS paid")


@query("SELECT o_orderkey, '$' || format('{:,.2f}', x) AS shown, x AS parsed, strftime(o_orderdate, '%d/%m/%Y') AS day, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM (SELECT *, floor(o_totalprice * 100 + 0.5) / 100 AS x FROM orders)")
def fc_pictures(t):
    shown = fc.format_value("$9,999.99", F.col("o_totalprice").cast("string"))
    day = fc.format_value("DD/MM/YYYY", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t("orders").select("o_orderkey", shown.alias("shown"), fc.parse_value("$9,999.99", shown).cast("double").alias("parsed"), day.alias("day"), fc.parse_value("DD/MM/YYYY", day).alias("iso"))


@query("SELECT s_suppkey, CAST(5 - (s_suppkey % 2) AS DOUBLE) AS n, s_suppkey + 6.0::DOUBLE AS total, greatest(s_suppkey, 3)::DOUBLE AS most, least(s_suppkey, 1)::DOUBLE AS least, (s_suppkey + 6.0::DOUBLE) / 4 AS mean FROM supplier")
def fc_lists(t):
    k = F.col("s_suppkey").cast("double")
    values = [F.lit(1.0), F.lit(2.0), F.lit(None).cast("double"), F.lit(3.0), k]
    texts = [F.lit("a"), F.lit("b"), F.lit(""), F.lit(None).cast("string"), F.lit("c"), F.lit("d"), F.when(k % 2 == 0, "e")]
    return t("supplier").select("s_suppkey", fc.count(*texts).alias("n"), fc.sum_(*values).alias("total"), fc.max_(*values).alias("most"), fc.min_(*values).alias("least"), fc.avg(*values).alias("mean"))


_SAID = """u AS (SELECT unnest(range(0, 20)) AS i, unnest(['Zero', 'One', 'Two', 'Three', 'Four', 'Five', 'Six', 'Seven', 'Eight', 'Nine', 'Ten', 'Eleven', 'Twelve', 'Thirteen', 'Fourteen', 'Fifteen', 'Sixteen', 'Seventeen', 'Eighteen', 'Nineteen']) AS w),
    z AS (SELECT unnest(range(2, 10)) AS i, unnest(['Twenty', 'Thirty', 'Forty', 'Fifty', 'Sixty', 'Seventy', 'Eighty', 'Ninety']) AS w),
    c AS (SELECT i, w FROM u UNION ALL SELECT z.i * 10 + u.i, z.w || CASE WHEN u.i > 0 THEN '-' || u.w ELSE '' END FROM z, u WHERE u.i < 10),
    m AS (SELECT i, w FROM c UNION ALL SELECT h.i * 100 + c.i, h.w || ' Hundred' || CASE WHEN c.i > 0 THEN ' ' || c.w ELSE '' END FROM u h, c WHERE h.i BETWEEN 1 AND 9)"""


@query(
    f"""WITH {_SAID}, o AS (SELECT o_orderkey, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents FROM orders), p AS (SELECT *, cents // 100 AS d, cents % 100 AS r FROM o)
    SELECT o_orderkey, CASE WHEN d < 1000 THEN b.w WHEN d % 1000 = 0 THEN a.w || ' Thousand' ELSE a.w || ' Thousand ' || b.w END || CASE WHEN d = 1 THEN ' Dollar' ELSE ' Dollars' END || ' And ' || lpad(CAST(r AS VARCHAR), 2, '0') || CASE WHEN r = 1 THEN ' Cent' ELSE ' Cents' END AS said
    FROM p JOIN m a ON a.i = d // 1000 JOIN m b ON b.i = d % 1000""",
    name="word_num",
)
def _word_num(t):
    return t("orders").select("o_orderkey", fc.word_num(F.col("o_totalprice"), 2).alias("said"))


# -- personal data


@query(
    r"""SELECT doc_id, hit FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '\s+', ' ', 'g'), '(?:\b|[^0-9])([0-9](?:[ -]?[0-9]){12,18})(?:[^0-9]|$)', 1)) AS hit FROM documents)
    WHERE list_sum(list_transform(range(1, length(regexp_replace(hit, '[^0-9]', '', 'g')) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(regexp_replace(hit, '[^0-9]', '', 'g'))[i] AS INT)
    ELSE (2 * CAST(reverse(regexp_replace(hit, '[^0-9]', '', 'g'))[i] AS INT)) // 10 + (2 * CAST(reverse(regexp_replace(hit, '[^0-9]', '', 'g'))[i] AS INT)) % 10 END)) % 10 = 0""",
    name="pii_card",
)
def _pii_card(t):
    return pii_hits(t("documents"), "card")


@query(
    r"""SELECT doc_id, hit FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '\s+', ' ', 'g'), '(?:^|[^\p{L}\p{N}+])((?:\+[0-9]|\([0-9]|[0-9])[0-9 .()-]*[0-9])', 1)) AS hit FROM documents)
    WHERE regexp_matches(ltrim(hit, '+'), '[^0-9]') AND CASE WHEN hit[1] = '+' THEN length(regexp_replace(hit, '[^0-9]', '', 'g')) BETWEEN 8 AND 15 ELSE length(regexp_replace(hit, '[^0-9]', '', 'g')) BETWEEN 10 AND 11
    OR (regexp_replace(hit, '[^0-9]', '', 'g')[1] = '0' AND length(regexp_replace(hit, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AND length(regexp_extract(hit, '[0-9]+')) >= 2
    AND NOT regexp_matches(hit, '^[0-9]{1,4}(/[0-9]{1,2}/|[.][0-9]{1,2}[.]|-[0-9]{1,2}-)[0-9]{1,4}$')) END""",
    name="pii_phone",
)
def _pii_phone(t):
    return pii_hits(t("documents"), "phone")


_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"


@query(
    rf"""SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '\s+', ' ', 'g') || ' ', '(?i)(?:^|[^\p{{L}}\p{{N}}])([0-9]{{4}}(?:/[0-9]{{1,2}}/|[.][0-9]{{1,2}}[.]|-[0-9]{{1,2}}-)[0-9]{{1,2}}|[0-9]{{1,2}}(?:/[0-9]{{1,2}}/|[.][0-9]{{1,2}}[.]|-[0-9]{{1,2}}-)[0-9]{{2,4}}|[0-9]{{1,2}}[.]? +(?:{_MONTHS})[.]? *[0-9]{{4}}|(?:{_MONTHS})[.]? *[0-9]{{1,2}},? *[0-9]{{4}})[^0-9]', 1)) AS hit FROM documents""",
    name="pii_date",
)
def _pii_date(t):
    return pii_hits(t("documents"), "date")


@query("SELECT c_custkey AS doc_id, s AS hit FROM (SELECT c_custkey, printf('%03d-%02d-%04d', CAST(c_custkey * 37 % 1000 AS INT), CAST(10 + c_custkey % 90 AS INT), CAST(c_custkey * 7 % 10000 AS INT)) AS s FROM customer) WHERE s[1:3] NOT IN ('000', '666') AND s[1] <> '9'", name="pii_ssn")
def _pii_ssn(t):
    k = F.col("c_custkey")
    number = F.format_string("%03d-%02d-%04d", k * 37 % 1000, 10 + k % 90, k * 7 % 10000)
    return pii_hits(t("customer").select(k.alias("doc_id"), F.concat(F.lit("no. "), number, F.lit(", not 1"), number, F.lit(".")).alias("text")), "ssn")


# -- stream filters


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents", name="filter_hex")
def _filter_hex(t):
    coded = F.encode(F.concat(F.regexp_replace(F.hex(F.encode(F.coalesce("text", F.lit("")), "utf-8")), "(.{64})", "$1\n"), F.lit(">")), "utf-8")
    return t("documents").select("doc_id", F.decode(decoded(coded, F.array(F.lit("ASCIIHexDecode"))), "utf-8").alias("text"))


# -- formulas over a table: each must come to the text beside it, in which § is the supplier's name


_FORMULAS = {
    'Concat(s, 1 + 2 * 3)': "§7", "Concat((1 + 2) * 3, s)": "9§", 'Concat("12" + 3, s)': "15§", 'Concat("a", 1.50, null, s)': "a1.5§", "Concat(s, Round(2.675, 2))": "§2.68", "Concat(s, Mod(-7, 3))": "§-1", 'Stuff("abcdef", 2, 3, s)': "a§ef",
    "Substr(Concat(s, s), 1, Len(s))": "§", "Concat(s, Str(123456, 3))": "§***", "Concat(WordNum(1234), s)": "One Thousand Two Hundred Thirty-Four§", 'Decode(Concat("a%20b+c%zz", s), "url")': "a b+c%zz§", 'Concat(s, Num2Date(35138, "DD/MM/YYYY"))': "§15/03/1996",
    'Concat(Format("$9,999.99", 1234.5), s)': "$1,234.50§", 'Concat(Parse("$9,999.99", "$1,234.50"), s)': "1234.5§", 'Concat(s, UnitType("3 pica"))': "§pc", "Choose(2, 4, s, 6)": "§", "Concat(Oneof(s, 1, s), s)": "1§", "Concat(Within(5, 1, 9), s)": "1§",
    "Concat(Exists(null), s)": "0§", "HasValue(s)": "1", "Concat(DateFmt(1), s)": "MM/DD/YY§", "Concat(s, Len(Space(3)))": "§3", 'Ltrim(Concat("  ", s))': "§", 'Rtrim(Concat(s, "  "))': "§", 'Concat(Lower("ABC"), s)': "abc§", 'Replace("aXbX", "X", s)': "a§b§",
    'At(Concat("hello", s), "l")': "3", "Concat(NPV(0.1, 110, 121), s)": "200§", 'Concat(s, Time2Num("01:00:00"))': "§3600000",
}


@query("SELECT s_suppkey, formula, replace(want, '§', s_name) AS value FROM supplier, (VALUES " + ", ".join("('" + k.replace("'", "''") + "', '" + v + "')" for k, v in _FORMULAS.items()) + ") v(formula, want)", name="formula_cases")
def _formula_cases(t):
    named = t("supplier").select("s_suppkey", F.col("s_name").alias("s"))
    compiled = ((k, compile_formula(k, {"s": "string"})) for k in _FORMULAS)
    rows = [F.struct(F.lit(k).alias("formula"), (num_text(c) if dict(named.select(c.alias("c")).dtypes)["c"] == "double" else c.cast("string")).alias("value")) for k, c in compiled]
    return named.select("s_suppkey", F.inline(F.array(*rows)))
