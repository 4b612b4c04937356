"""Search text, personal-data patterns, masks, labels and escapes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.coerce import UNICODE_SPACE, make_number, round_half_away


def fold(text: Column) -> Column:
    """Case-folded one character for one; the four letters i with and without dots are one."""
    return F.lower(F.translate(text, "Iİı", "iii"))


def collapsed(text: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(text, f"{UNICODE_SPACE}+", " ")


def phrase(needle: str, case_sensitive: bool = False) -> str:
    out = " ".join(needle.split())
    return out if case_sensitive else out.translate(str.maketrans("Iİı", "iii")).lower()


def find_count(text: Column, needle: str, case_sensitive: bool = False, whole_words: bool = False) -> Column:
    """Non-overlapping hits from the left; an empty phrase has none."""
    wanted = phrase(needle, case_sensitive)
    if not wanted:
        return F.lit(0)
    seen = collapsed(text if case_sensitive else fold(text))
    if whole_words:
        quoted = "\\Q" + wanted.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        return F.regexp_count(seen, F.lit(rf"(?<![\p{{L}}\p{{N}}]){quoted}(?![\p{{L}}\p{{N}}])"))
    return ((F.length(seen) - F.length(F.replace(seen, F.lit(wanted), F.lit("")))) / len(wanted)).cast("int")


# Java patterns of personal data; what a pattern cannot say is checked on the candidate.
_WORD = r"[\p{L}\p{N}]"
EMAIL = rf"(?<![\p{{L}}\p{{N}}._%+-]){_WORD}[\p{{L}}\p{{N}}._%+-]*@(?:[\p{{L}}\p{{N}}-]|\.(?={_WORD}))*\.\p{{L}}{{2,}}(?![\p{{L}}\p{{N}}-])"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
SSN = r"(?<!\d)(?!000|666|9)\d{3}[- ]\d{2}[- ]\d{4}(?!\d)"
PHONE = rf"(?<![\p{{L}}\p{{N}}+])(?:\+\d|\(\d|\d)[\d .()-]*\d(?!\d)"
_MONTH = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
    r"|januar|februar|märz|mai|juni|juli|oktober|dezember|janvier|février|mars|avril|juin|juillet|août|septembre|octobre|novembre|décembre"
    r"|gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|dicembre|ocak|şubat|nisan|mayıs|haziran|temmuz|ağustos|eylül|ekim|kasım|aralık)\.?"
)
DATE = (
    rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:\d{{4}}([/.-])\d{{1,2}}\1\d{{1,2}}(?!\d)|\d{{1,2}}([/.-])\d{{1,2}}\2\d{{2,4}}(?!\d)|\d{{1,2}}\.? +{_MONTH} *\d{{4}}(?!\d)|{_MONTH} *\d{{1,2}},? *\d{{4}}(?!\d))"
)
URL = r"(?i)(?<![\p{L}\p{N}])(?:https?://|www\.)[^\s\p{Z}<>\"'()\[\]{}]*"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def cards(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(CARD), F.lit(0)), lambda x: F.call_function("luhn_check", _digits(x)))


def ssns(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SSN), F.lit(0))


def dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DATE), F.lit(0))


def phone_like(x: Column) -> Column:
    """International 8-15 digits, North American 10-11, or national with a trunk 0 and a first group of two digits; always grouped, never a date."""
    n = F.length(_digits(x))
    first = F.length(F.regexp_extract(x, r"\d+", 0))
    body = F.regexp_replace(x, r"^\+", "")
    trunk = _digits(x).startswith("0") & n.between(7, 15) & (first >= 2) & ~x.rlike("^" + r"\d{1,4}([/.-])\d{1,2}\1\d{1,4}$")
    return body.rlike(r"\D") & F.when(x.startswith("+"), n.between(8, 15)).otherwise(n.between(10, 11) | trunk)


def phones(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), phone_like)


PATTERNS = {"email": emails, "card": cards, "ssn": ssns, "date": dates, "phone": phones}
_REGEX = {"email": EMAIL, "card": CARD, "ssn": SSN, "date": DATE, "phone": PHONE}
#: What a pattern cannot say of a candidate.
_CHECKS = {"card": lambda x: F.call_function("luhn_check", _digits(x)), "phone": phone_like}


def candidates(text: Column, kind: str) -> Column:
    """Every match of a kind's pattern; a text without the sign that all of its matches have is not searched."""
    found = F.regexp_extract_all(text, F.lit(_REGEX[kind]), F.lit(0))
    return F.when(text.contains("@") if kind == "email" else text.rlike("[0-9]"), found).otherwise(F.array().cast("array<string>"))


def real(kind: str, candidate: Column) -> Column:
    """Whether a match of a kind's pattern is personal data."""
    return F.coalesce(_CHECKS.get(kind, lambda x: F.lit(True))(candidate), F.lit(False))


def pieces(text: Column, kind: str, found: Column | None = None) -> Column:
    """The text cut at every match of a pattern (``found``, if they are known): (text, hit) in order, so that all of them joined are the text; ``hit`` is personal data."""
    between, found = F.split(text, _REGEX[kind], -1), candidates(text, kind) if found is None else found
    pair = F.transform(F.arrays_zip(between.alias("b"), found.alias("f")), lambda z: F.array(F.struct(z["b"].alias("text"), F.lit(False).alias("hit")), F.struct(z["f"].alias("text"), real(kind, z["f"]).alias("hit"))))
    return F.filter(F.flatten(pair), lambda p: F.coalesce(p["text"], F.lit("")) != "")


def masked(text: Column, kinds: tuple[str, ...] = ("email", "ssn"), mark: str = "█") -> Column:
    """The text with one mark in place of every hit of the patterns, kind after kind, and everything else as it was."""
    for k in kinds:
        text = F.array_join(F.transform(pieces(text, k), lambda p: F.when(p["hit"], F.lit(mark)).otherwise(p["text"])), "")
    return text


def urls(text: Column) -> Column:
    """Web addresses without the sentence's marks behind them; www. gets a scheme."""
    found = F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda x: F.rtrim(x, F.lit(".,;:!?")))
    real = F.filter(found, lambda x: (F.octet_length(x) > 6) & x.contains("."))
    return F.transform(real, lambda x: F.when(F.lower(F.left(x, F.lit(4))) == "www.", F.concat(F.lit("http://"), x)).otherwise(x))


def allowed_url(url: Column) -> Column:
    """Web and mail links of at most 2048 characters without white space or control characters."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    body = F.regexp_extract(url, r"^[A-Za-z]+:(?://)?(.*)$", 1)
    return F.coalesce(scheme.isin("http", "https", "mailto") & (F.length(url) <= 2048) & (body != "") & ~url.rlike(r"[\s\p{Cntrl}]"), F.lit(False))


def host_display(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


# -- numerals, escapes, names

def roman(n: Column) -> Column:
    """Lower-case Roman numeral of a positive number."""
    out, rest = F.lit(""), n.cast("long")
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return out


def alpha(n: Column) -> Column:
    """a to z, then aa to zz, each letter repeated."""
    return F.repeat(F.char((n - 1) % 26 + 97), (F.floor((n - 1) / 26) + 1).cast("int"))


def numeral(style: Column, n: Column) -> Column:
    return (
        F.when(style == "D", n.cast("string")).when(style == "r", roman(n)).when(style == "R", F.upper(roman(n))).when(style == "a", alpha(n)).when(style == "A", F.upper(alpha(n))).otherwise("")
    )


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def xml_name(text: Column) -> Column:
    """A text as an XML element name."""
    clean = F.regexp_replace(text, r"[^\p{L}\p{N}_.-]", "_")
    return F.when(clean.rlike(r"^[\p{L}_]"), clean).otherwise(F.concat(F.lit("_"), clean))


def file_name(text: Column) -> Column:
    safe = F.btrim(F.regexp_replace(text, r'[\\/:*?"<>|\p{Cntrl}]', "_"), F.lit(" ."))
    return F.when(safe == "", "document").otherwise(safe)


def csv_safe(text: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets an apostrophe."""
    return F.when(F.ltrim(text).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def truth(text: Column) -> Column:
    """A checked value as data has it."""
    return F.coalesce(~F.lower(F.btrim(text)).isin("", "0", "off", "false", "no", "n"), F.lit(False))


# -- typed fields

def mask_fits(mask: str, text: Column) -> Column:
    """9 a digit, A a letter, O either, X any; the rest stands for itself."""
    kinds = {"9": r"\d", "A": r"\p{L}", "O": r"[\p{L}\d]", "X": "."}
    return text.rlike("^(?s:" + "".join(kinds.get(c, "\\Q" + c + "\\E") for c in mask) + ")$")


def special_format(kind: str, text: Column) -> Column:
    """Zip, zip+4, phone and social security numbers from their digits; other lengths stay as typed."""
    digits = _digits(text)
    wanted, pattern, put = {
        "zip": (5, r"^(\d{5})$", "$1"),
        "zip4": (9, r"^(\d{5})(\d{4})$", "$1-$2"),
        "phone": (10, r"^(\d{3})(\d{3})(\d{4})$", "($1) $2-$3"),
        "phone7": (7, r"^(\d{3})(\d{4})$", "$1-$2"),
        "ssn": (9, r"^(\d{3})(\d{2})(\d{4})$", "$1-$2-$3"),
    }[kind]
    return F.when(F.length(digits) == wanted, F.regexp_replace(digits, pattern, put)).otherwise(text)


def number_format(v: Column, places: int, separators: int = 0, negative: int = 0, currency: str = "", prepend: bool = True) -> Column:
    """Separators 0 1,234.56; 1 1234.56; 2 1.234,56; 3 1234,56; 4 1'234.56.  Negative 0 a minus, 1 red (as 0), 2 and 3 parentheses."""
    size = round_half_away(F.abs(v), places)
    shown = F.format_number(size, places)
    shown = F.translate(shown, ",.", {0: ",.", 1: "\0.", 2: ".,", 3: "\0,", 4: "'."}[separators])
    shown = F.replace(shown, F.lit("\0"), F.lit(""))
    if currency:
        shown = F.concat(F.lit(currency), shown) if prepend else F.concat(shown, F.lit(currency))
    minus = F.concat(F.lit("("), shown, F.lit(")")) if negative in (2, 3) else F.concat(F.lit("-"), shown)
    return F.when((v < 0) & (size > 0), minus).otherwise(shown)


def percent_format(v: Column, places: int, separators: int = 0, whole: float = 1.0) -> Column:
    """``v`` as a share of ``whole``; a percentage (of 100) is rounded as it stands, not on its way through a hundredth."""
    return F.concat(number_format(v * (100 / whole), places, separators), F.lit("%"))


def range_error(text: Column, low: float | None, high: float | None) -> Column:
    """Null where the typed number fits or is none, else what is asked."""
    v = make_number(text)
    bad = F.lit(False)
    if low is not None:
        bad |= v < low
    if high is not None:
        bad |= v > high
    asked = "between %s and %s" % (low, high) if low is not None and high is not None else f"at least {low}" if low is not None else f"at most {high}"
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(f"the value must be {asked}"))
