"""Objects of PDF files as rows: a scan for object headers, so files with a broken cross-reference table read the same way."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from paperloom.sources.filters import FilterError, decode

SCHEMA = "file string, num int, gen int, type string, dict string, stream binary, error string"
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")
_NAME = re.compile(rb"/(?:Filter|F)\s*(?:\[([^\]]*)\]|(/[A-Za-z0-9]+))")
_SETTING = re.compile(rb"/(Predictor|Colors|BitsPerComponent|Columns)\s+(\d+)")


def objects(data: bytes) -> Iterator[tuple[int, int, str | None, str, bytes | None, str | None]]:
    """(number, generation, type, dictionary text, decoded stream, error); the last of a number is the newest.

    Streams of encrypted files stay as their filters leave them.  Objects packed in object streams follow that stream.
    """
    heads = list(_OBJECT.finditer(data))
    for k, m in enumerate(heads):
        end = heads[k + 1].start() if k + 1 < len(heads) else len(data)
        body = data[m.end() : end]
        cut = body.find(b"endobj")
        start = body.find(b"stream")
        head = body[: min(x for x in (cut, start, len(body)) if x >= 0)]
        stream, error = None, None
        if start >= 0 and (cut < 0 or start < cut or b"endstream" in body):
            at = start + 6
            at += 2 if body[at : at + 2] == b"\r\n" else 1
            stop = body.rfind(b"endstream")
            raw = body[at : stop if stop >= 0 else len(body)]
            length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
            raw = raw[: int(length[1])] if length and int(length[1]) <= len(raw) else raw.rstrip(b"\r\n")
            found = _NAME.search(head)
            names = [n.decode() for n in re.findall(rb"/([A-Za-z0-9]+)", (found[1] or found[2]) if found else b"")]
            settings = {a.decode(): int(b) for a, b in _SETTING.findall(head)}
            try:
                stream = decode(raw, names, [settings] if settings else None, strict=False)
            except FilterError as e:
                stream, error = raw, str(e)
        kind = re.search(rb"/Type\s*/([A-Za-z0-9]+)", head)
        text = head.strip().decode("latin-1")
        yield int(m[1]), int(m[2]), kind[1].decode() if kind else None, text, stream, error
        if kind and kind[1] == b"ObjStm" and stream is not None and error is None:
            count, first = (re.search(rb"/%s\s+(\d+)" % k, head) for k in (b"N", b"First"))
            if count and first:
                index = [int(x) for x in re.findall(rb"\d+", stream[: int(first[1])])][: 2 * int(count[1])]
                places = [*index[1::2], len(stream) - int(first[1])]
                for number, a, b in zip(index[::2], places[:-1], places[1:], strict=False):
                    inner = stream[int(first[1]) + a : int(first[1]) + b]
                    own = re.search(rb"/Type\s*/([A-Za-z0-9]+)", inner)
                    yield number, 0, own[1].decode() if own else None, inner.strip().decode("latin-1"), None, None


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """One row an object of the files; a file without objects has one row that says so."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]):
        names = ["file", "num", "gen", "type", "dict", "stream", "error"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.string()]
        for b in batches:
            rows = []
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(file, *o) for o in objects(data)] or [(file, None, None, None, None, None, "no objects")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.mapInArrow(run, SCHEMA)
