"""Form data files (CSV, TSV, XML, XFDF, FDF) to and from long (file, pos, name, value) tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import csv_safe
from paperloom.operators.forms import tsv_text

LONG = "file string, pos int, name string, value string"
MAX_DEPTH = 32


def kind_of(path: str, head: bytes = b"") -> str:
    """By extension, else by what the file begins with."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("csv", "tsv", "xml", "xfdf", "fdf", "pdf"):
        return ending
    if ending == "txt" or b"\t" in head.split(b"\n", 1)[0]:
        return "tsv"
    if head.startswith(b"%FDF"):
        return "fdf"
    if head.startswith(b"%PDF"):
        return "pdf"
    if head.lstrip().startswith(b"<"):
        return "xfdf" if b"<xfdf" in head else "xml"
    return "csv"


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The header and the first row of values of each file, zipped; quotes may span lines."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(batches: Iterator[pa.RecordBatch]):
        import csv
        import io

        for b in batches:
            out = []
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = csv.reader(io.StringIO((text or "").lstrip("﻿"), newline=""), delimiter=sep)
                head, values = next(lines, []), next(lines, [])
                out += [(file, i, n, v) for i, (n, v) in enumerate(zip(head, values, strict=False)) if n]
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "pos", "name", "value"), r, strict=True)) for r in out], schema=_SCHEMA)

    return rows.mapInArrow(run, LONG)


_SCHEMA = pa.schema([("file", pa.string()), ("pos", pa.int32()), ("name", pa.string()), ("value", pa.string())])


def _xml_values(text: str) -> list[tuple[str, str]]:
    """(dotted name, value) of XFDF fields or of the leaves of plain XML, in document order."""
    import xml.etree.ElementTree as ET

    if "<!ENTITY" in text or "<!DOCTYPE" in text:
        return []
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return []
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    out: list[tuple[str, str]] = []

    def fields(node, above: str, depth: int) -> None:
        for f in node if depth <= MAX_DEPTH else ():
            if local(f) != "field":
                continue
            name = f"{above}.{f.get('name', '')}" if above else f.get("name", "")
            out.extend((name, v.text or "") for v in f if local(v) == "value")
            fields(f, name, depth + 1)

    def leaves(node, depth: int) -> None:
        for e in node if depth <= MAX_DEPTH else ():
            if len(e):
                leaves(e, depth + 1)
            else:
                out.append((local(e), e.text or ""))

    holders = [e for e in root.iter() if local(e) == "fields"]
    if local(root) == "xfdf" or holders:
        for h in holders:
            fields(h, "", 1)
    else:
        leaves(root, 1)
    return out


_FDF = re.compile(rb"<<|>>|\[|\]|/[^\s/<>\[\]()]+|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|[^\s<>\[\]()/]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _fdf_text(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    elif token[:1] == b"(":
        def escape(m):
            e = m[1]
            return bytes([int(e, 8) & 255]) if e[:1].isdigit() else b"" if e == b"\n" else _ESCAPES.get(e, e)

        raw = re.sub(rb"\\([0-7]{1,3}|.)", escape, token[1:-1], flags=re.S)
    else:
        return token.lstrip(b"/").decode("latin-1")
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def _fdf_values(data: bytes) -> list[tuple[str, str]]:
    """(dotted name, value) of an FDF file's fields; kids add to their parent's name."""
    tokens, at = _FDF.findall(data), 0

    def value(depth: int):
        nonlocal at
        token = tokens[at]
        at += 1
        if depth > 4 * MAX_DEPTH:
            raise ValueError("nested too deeply")
        if token == b"<<":
            d = {}
            while tokens[at] != b">>":
                key = tokens[at]
                at += 1
                d[key] = value(depth + 1)
            at += 1
            return d
        if token == b"[":
            items = []
            while tokens[at] != b"]":
                items.append(value(depth + 1))
            at += 1
            return items
        return token

    out: list[tuple[str, str]] = []

    def fields(items, above: str, depth: int) -> None:
        for f in items if isinstance(items, list) and depth <= MAX_DEPTH else ():
            if not isinstance(f, dict):
                continue
            own = _fdf_text(f[b"/T"]) if b"/T" in f else ""
            name = f"{above}.{own}" if above and own else above or own
            v = f.get(b"/V")
            if v is not None:
                out.extend((name, _fdf_text(x)) for x in (v if isinstance(v, list) else [v]))
            fields(f.get(b"/Kids"), name, depth + 1)

    try:
        while at < len(tokens):
            if tokens[at] != b"/Fields":
                at += 1
                continue
            at += 1
            fields(value(0), "", 1)
    except (IndexError, ValueError):
        pass
    return out


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """Long rows of XFDF, XML and FDF files; a broken file has what was read before the break, a repeated name a row a value."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out = []
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                kind = kind_of(file, data[:1024])
                found = _fdf_values(data) if kind == "fdf" else _xml_values(data.decode("utf-8", "replace")) if kind in ("xml", "xfdf") else []
                out += [{"file": file, "pos": i, "name": n, "value": v} for i, (n, v) in enumerate(found)]
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return files.mapInArrow(run, LONG)


def write_delimited(wide: DataFrame, path: str, sep: str = ",", formula_safe: bool = True) -> None:
    """A header and one row a file; TSV has no tabs or line ends in cells."""
    cells = [F.col(f"`{c}`").cast("string") for c in wide.columns]
    if sep == "\t":
        cells = [tsv_text(c) for c in cells]
    elif formula_safe:
        cells = [csv_safe(c) for c in cells]
    wide.select(*(c.alias(n) for c, n in zip(cells, wide.columns, strict=True))).write.option("header", True).option("sep", sep).option("escape", '"').option("emptyValue", "").csv(path)


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def to_xfdf(long: DataFrame) -> DataFrame:
    """(file, xfdf): each file's fields as one XFDF text; dotted names stay whole."""
    field = F.concat(F.lit('<field name="'), _escaped(F.col("name")), F.lit('"><value>'), _escaped(F.coalesce("value", F.lit(""))), F.lit("</value></field>"))
    body = F.array_join(F.array_sort(F.collect_list(F.struct("pos", field.alias("f"))))["f"], "")
    head, tail = '<?xml version="1.0" encoding="UTF-8"?><xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve"><fields>', "</fields></xfdf>"
    return long.groupBy("file").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("xfdf"))


def to_fdf(long: DataFrame) -> DataFrame:
    """(file, fdf): each file's fields as one FDF text, strings as UTF-16 in hexadecimal."""
    hexed = lambda c: F.concat(F.lit("<FEFF"), F.hex(F.encode(c, "UTF-16BE")), F.lit(">"))
    field = F.concat(F.lit("<</T"), hexed(F.col("name")), F.lit("/V"), hexed(F.coalesce("value", F.lit(""))), F.lit(">>"))
    body = F.array_join(F.array_sort(F.collect_list(F.struct("pos", field.alias("f"))))["f"], "")
    return long.groupBy("file").agg(F.concat(F.lit("%FDF-1.2\n1 0 obj\n<</FDF<</Fields["), body, F.lit("]>>>>\nendobj\ntrailer\n<</Root 1 0 R>>\n%%EOF\n")).alias("fdf"))
