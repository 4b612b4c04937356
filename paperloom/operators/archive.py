"""Archive-format rules: one set over all objects of documents, in one pass, with clause and page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: actions and annotations that an archive may not have.
FORBIDDEN_ACTIONS = ("JavaScript", "Launch", "Sound", "Movie", "ResetForm", "ImportData", "Hide", "SetOCGState", "Rendition", "Trans", "GoTo3DView")
FORBIDDEN_ANNOTATIONS = ("Sound", "Movie", "Screen", "3D", "RichMedia")


@dataclass(frozen=True)
class Clause:
    """``fails`` is true for an object that breaks the clause; ``fixable``: a conversion can mend it."""

    clause: str
    fails: Column
    message: Column
    fixable: bool


def _has(key: str) -> Column:
    return F.array_contains("keys", key)


def _is(*kinds: str) -> Column:
    return F.col("type").isin(*kinds)


def clauses(part: int) -> list[Clause]:
    """The rules of part 2 or 3 of the format, for objects as :func:`archive_findings` takes them."""
    say, name = F.lit, F.coalesce("subtype", F.lit(""))
    annotation, flags = _is("Annot"), F.coalesce("flags", F.lit(0))
    shown = (flags.bitwiseAND(4) == 0) | (flags.bitwiseAND(1 | 2 | 32) != 0)
    banned = annotation & name.isin(*FORBIDDEN_ANNOTATIONS)
    stands = annotation & ~banned
    flat = F.coalesce((F.abs(F.col("rect")[2] - F.col("rect")[0]) < 1e-6) & (F.abs(F.col("rect")[3] - F.col("rect")[1]) < 1e-6), F.lit(False))
    stream, catalog, filespec = _is("Stream"), _is("Catalog"), _is("Filespec")
    found = [
        Clause("6.6.2.1", catalog & ~_has("Metadata"), say("no metadata"), True),
        Clause("6.6.4", catalog & _has("Metadata") & ~F.coalesce(F.col("claims") == f"{part}B", F.lit(False)), say(f"the metadata does not claim part {part}, level B"), True),
        Clause("6.1.3", _is("Trailer") & _has("Encrypt"), say("encrypted"), True),
        Clause("6.5.2", catalog & _has("AA"), say("the document has additional actions"), True),
        Clause("6.5.1", catalog & _has("JavaScript"), say("the document has scripts"), True),
        Clause("6.4.1", catalog & _has("NeedAppearances"), say("the form asks for appearances"), True),
        Clause("6.5.2", _is("Page") & _has("AA"), say("the page has additional actions"), True),
        Clause("6.5.1", _is("Action") & name.isin(*FORBIDDEN_ACTIONS), F.concat(say("action "), name), True),
        Clause("6.3.1", banned, F.concat(say("annotation "), name), True),
        Clause("6.3.2", stands & (name != "Popup") & shown, F.concat(say("not printed or hidden: "), name), True),
        Clause("6.3.3", stands & ~_has("AP") & ~name.isin("Popup", "Link") & ~flat, F.concat(say("no appearance: "), name), False),
        Clause("6.5.2", stands & _has("AA"), F.concat(say("additional actions: "), name), True),
        Clause("6.5.2", _is("Field") & _has("AA"), say("a field has additional actions"), True),
        Clause("6.2.11.4.1", _is("Font") & ~_has("FontFile") & (name != "Type3"), say("a font is not embedded"), False),
        Clause("6.1.7.2", stream & F.coalesce(F.array_contains("filters", "LZWDecode"), F.lit(False)), say("LZW compression"), False),
        Clause("6.1.7.1", stream & (_has("F") | _has("FFilter")), say("a stream in another file"), False),
        Clause("6.2.8", stream & (name == "Image") & _has("Interpolate"), say("an interpolated image"), True),
        Clause("6.2.8", stream & (name == "Image") & (_has("Alternates") | _has("OPI")), say("an image with alternates"), True),
        Clause("6.2.9", stream & (name == "PS"), say("PostScript"), False),
    ]
    if part == 2:
        return [*found, Clause("6.8", filespec & _has("EF"), say("an embedded file"), False)]
    return [*found, Clause("6.8", filespec & _has("EF") & ~_has("AFRelationship"), say("an embedded file without a relationship"), True)]


def archive_findings(objects: DataFrame, part: int = 2, doc: str = "doc") -> DataFrame:
    """(doc, clause, message, page, fixable) of objects that break a clause, each once a document and page.

    ``objects`` has type, subtype, keys (names the object has set; true ones, where they are yes or no), flags and rect of
    annotations, filters of streams, claims of a catalog's metadata ("2B"), and page (null where it is on none).  All clauses
    are one projection.
    """
    if part not in (2, 3):
        raise ValueError("archive rules are of part 2 or 3")
    rows = objects.withColumn("keys", F.coalesce("keys", F.array().cast("array<string>"))).withColumn("type", F.coalesce("type", F.lit("")))
    told = [F.when(c.fails, F.struct(F.lit(c.clause).alias("clause"), c.message.alias("message"), F.lit(c.fixable).alias("fixable"))) for c in clauses(part)]
    return rows.select(doc, "page", F.explode(F.array_compact(F.array(*told))).alias("f")).select(doc, "f.clause", "f.message", "page", "f.fixable").distinct()


def archive_status(objects: DataFrame, found: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, status, issues, fixable) of every document: "conforms", "can be converted" if all its issues can be mended, else "fails"."""
    counted = found.groupBy(doc).agg(F.count("*").alias("issues"), F.count_if("fixable").alias("fixable"))
    all_of = objects.select(doc).distinct().join(counted, doc, "left").na.fill(0, ["issues", "fixable"])
    status = F.when(F.col("issues") == 0, "conforms").when(F.col("issues") == F.col("fixable"), "can be converted").otherwise("fails")
    return all_of.select(doc, status.alias("status"), "issues", "fixable")
