"""Queries of dates in many languages over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import days
from paperloom.plans.register import Register
from paperloom.sources.storage import dealt

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.oracles

LONG, SHORT = "dddd, d. mmmm yyyy", r"\day ddd dd-mmm-yyyy"
#: Months behind a day in one language that changes them (fixed values).
_CZECH = ["ledna", "února", "března", "dubna", "května", "června", "července", "srpna", "září", "října", "listopadu", "prosince"]


@query(
    f"""WITH l AS (SELECT unnest([{", ".join(f"'{c}'" for c in days.LANGUAGES)}]) AS lang) SELECT o_orderkey, lang, strftime(o_orderdate, '%Y-%m-%d') AS long_back, strftime(o_orderdate, '%Y-%m-%d') AS short_back,
    CASE lang WHEN 'en' THEN strftime(o_orderdate, '%A, %-d. %B %Y') WHEN 'cs' THEN ['neděle', 'pondělí', 'úterý', 'středa', 'čtvrtek', 'pátek', 'sobota'][CAST(dayofweek(o_orderdate) AS INT) + 1] || strftime(o_orderdate, ', %-d. ')
      || [{", ".join(f"'{m}'" for m in _CZECH)}][CAST(month(o_orderdate) AS INT)] || strftime(o_orderdate, ' %Y') END AS shown FROM orders, l""",
    name="date_languages",
)
def _date_languages(t):
    """Every order's date written out in every language, and read again: each day once, then joined with the orders of that day."""
    orders = t("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))

    def one(lang: str):
        said = days.names(orders.sparkSession, lang)
        long, short = days.format_day(F.col("day"), LONG, said), days.format_day(F.col("day"), SHORT, said)
        shown = long if lang in ("en", "cs") else F.lit(None).cast("string")
        return F.struct(F.lit(lang).alias("lang"), days.parse_iso(long, LONG, said).alias("long_back"), days.parse_day(short, SHORT, said).cast("string").alias("short_back"), shown.alias("shown"))

    told = dealt(orders.select("day").distinct(), "day").select(F.col("day").alias("__day"), F.array(*map(one, days.LANGUAGES)).alias("said"))
    return orders.join(told, F.col("day").eqNullSafe(F.col("__day"))).select("o_orderkey", F.explode_outer("said").alias("s")).select("o_orderkey", "s.*")


#: Patterns and what is wrong with them.
_PATTERNS = [("yyyy-mm-dd", None), ("", "empty"), ("d. mmmm yyyy", None), ("hh:mm", "time letter"), (r"\hh", "time letter"), (r"\h\h dd", None), ("---", "no date letter"), ("yyy", "no such code"), ("mmmmm d", "no such code"), ("y", "no such code"), ("dddd d", None), (r"\y\m\d", "no date letter")]


@query(
    f"WITH p AS (SELECT unnest([{', '.join(f"'{p}'" for p, _ in _PATTERNS)}]) AS p, unnest([{', '.join(f"'{e}'" if e else 'NULL' for _, e in _PATTERNS)}]) AS e, unnest(range({len(_PATTERNS)})) AS i) SELECT c_custkey, CASE WHEN length(p) > 0 AND c_custkey % 5 = 0 THEN 'too long' ELSE e END AS error FROM customer JOIN p ON i = c_custkey % {len(_PATTERNS)}",
    name="date_patterns",
)
def _date_patterns(t):
    pattern = F.element_at(F.array(*(F.lit(p) for p, _ in _PATTERNS)), (F.col("c_custkey") % len(_PATTERNS) + 1).cast("int"))
    longer = F.when(F.col("c_custkey") % 5 == 0, F.repeat(pattern, 70)).otherwise(F.concat(F.lit("  "), pattern, F.lit("\n")))
    return t("customer").select("c_custkey", days.pattern_error(longer).alias("error"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%y') AS shown, strftime(o_orderdate, '%Y-%m-%d') AS iso, 'no date ' || o_orderkey AS same FROM orders", name="data_dates")
def _data_dates(t):
    said = days.names(t("orders").sparkSession, "en")
    shown = days.iso_to_pattern(F.date_format("o_orderdate", "yyyy-M-d"), "dd/mm/yy")
    return t("orders").select("o_orderkey", shown.alias("shown"), days.parse_iso(shown, "dd/mm/yy", said).alias("iso"), days.iso_to_pattern(F.concat(F.lit("no date "), "o_orderkey"), "dd/mm/yy").alias("same"))
