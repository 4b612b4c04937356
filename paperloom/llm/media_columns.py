"""Media columns: ISO base media files, stored, walked and described without decoding.

``write_media`` stores bytes as 8-bit PCM samples in a file of nested boxes; ``describe``
walks the boxes, decodes each track's sample tables and movie fragments, and reports codec,
duration and the byte ranges of sync samples.  Counts are held against their boxes before
anything is made of them; malformed boxes give a described error, never an exception.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.llm.shared import arrow_map, utf8

RATE = 8000
#: Bytes of one stored sample, and samples from one in sync to the next (a second and a half), so long texts keep short tables.
FRAME = 192
SYNC_EVERY = 64
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"mvex", b"udta", b"moof", b"traf", b"mfra"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body) + 8
    return struct.pack(">I4s", size, kind) + body if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of 192 bytes."""
    return text + b" " * (-len(text) % FRAME if text else FRAME)


def write_media(payload: bytes) -> bytes:
    """An ISO media file that holds the payload as unsigned 8-bit mono samples, FRAME of them in a table entry."""
    frames = len(payload) // FRAME
    if frames * FRAME != len(payload) or not frames:
        raise ValueError("the payload is a positive multiple of the frame")
    per_chunk = min(frames, SYNC_EVERY)
    chunks, rest = divmod(frames, per_chunk)
    stsc = [(1, per_chunk, 1)] + ([(chunks + 1, rest, 1)] if rest else [])
    sync = range(1, frames + 1, SYNC_EVERY)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def moov(base: int) -> bytes:
        entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
        offsets = [base + i * per_chunk * FRAME for i in range(chunks + bool(rest))]
        table = full(b"co64", struct.pack(f">I{len(offsets)}Q", len(offsets), *offsets))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, FRAME)),
            full(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">III", *x) for x in stsc)),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            table,
            full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
        )
        dref = full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", dref), stbl)
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, len(payload), 0x55C4, 0), version=1)
        mdia = box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, len(payload), 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    base = len(ftyp) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return ftyp + moov(base) + box(b"mdat", payload)


def walk(data: bytes) -> Iterator[tuple[int, bytes, int, int]]:
    """(depth, kind, body start, body end) of each box, depth first; a broken size raises ValueError.

    Open boxes wait in a list, so no nesting is too deep.
    """
    at, ends = 0, [len(data)]
    while ends:
        if at == ends[-1]:
            ends.pop()
            continue
        end = ends[-1]
        if end - at < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise ValueError("a box header is cut off")
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError("a box is longer than its parent")
        yield len(ends) - 1, kind, at + head, at + size
        if kind in CONTAINERS:
            ends.append(at + size)
            at += head
        else:
            at += size


class _Track:
    """The boxes of one track, decoded: samples as (start, end, ticks, sync)."""

    def __init__(self, data: bytes):
        self.data, self.found = data, {}
        self.samples: list[tuple[int, int, int, bool]] = []

    def body(self, kind: bytes, least: int) -> tuple[int, int]:
        if kind not in self.found:
            raise ValueError(f"no {kind.decode('latin-1')} box")
        a, b = self.found[kind]
        if b - a < least:
            raise ValueError(f"the {kind.decode('latin-1')} box is cut off")
        return a, b

    def rows(self, kind: bytes, form: str, skip: int = 8) -> list[tuple]:
        """A counted table, after its count has been held against the box."""
        a, b = self.body(kind, skip)
        (n,) = struct.unpack_from(">I", self.data, a + skip - 4)
        width = struct.calcsize(">" + form)
        if n * width > b - a - skip:
            raise ValueError("a sample table is cut off")
        return list(struct.iter_unpack(">" + form, self.data[a + skip : a + skip + n * width]))

    def header(self) -> None:
        a, _ = self.body(b"tkhd", 24)
        (self.id,) = struct.unpack_from(">I", self.data, a + (20 if self.data[a] else 12))
        a, _ = self.body(b"mdhd", 32 if self.data[self.body(b"mdhd", 1)[0]] else 20)
        self.scale, self.duration = struct.unpack_from(">IQ", self.data, a + 20) if self.data[a] else struct.unpack_from(">II", self.data, a + 12)
        a, _ = self.body(b"hdlr", 12)
        self.kind = self.data[a + 8 : a + 12].decode("latin-1")
        a, _ = self.body(b"stsd", 16)
        self.codec = self.data[a + 12 : a + 16].decode("latin-1")

    def sizes(self) -> list[int]:
        if b"stz2" in self.found:
            a, b = self.body(b"stz2", 12)
            width, n = self.data[a + 7], struct.unpack_from(">I", self.data, a + 8)[0]
            if width not in (4, 8, 16) or (n * width + 7) // 8 > b - a - 12:
                raise ValueError("a sample table is cut off")
            packed = self.data[a + 12 : b]
            if width == 4:
                return [packed[i // 2] >> (0 if i % 2 else 4) & 15 for i in range(n)]
            return list(packed[:n]) if width == 8 else [x for (x,) in struct.iter_unpack(">H", packed[: 2 * n])]
        a, _ = self.body(b"stsz", 12)
        fixed, n = struct.unpack_from(">II", self.data, a + 4)
        if not fixed:
            return [x for (x,) in self.rows(b"stsz", "I", 12)]
        if n * fixed > len(self.data):
            raise ValueError("samples are missing")
        return [fixed] * n

    def table_samples(self) -> None:
        """Samples by the tables: sizes, the chunks they run through, their times and which are in sync."""
        sizes = self.sizes()
        starts = [x for (x,) in (self.rows(b"co64", "Q") if b"co64" in self.found else self.rows(b"stco", "I"))] if sizes else []
        runs = self.rows(b"stsc", "III") if sizes else []
        ends = [first for first, _, _ in runs[1:]] + [len(starts) + 1] * bool(runs)
        if any(not 1 <= first < end <= len(starts) + 1 for (first, _, _), end in zip(runs, ends, strict=True)):
            raise ValueError("chunks out of order")
        places: list[tuple[int, int]] = []
        for (first, per, _), end in zip(runs, ends, strict=True):
            for at in starts[first - 1 : end - 1]:
                for size in sizes[len(places) : len(places) + per]:
                    places.append((at, at + size))
                    at += size
        times = self.rows(b"stts", "II") if sizes else []
        if len(places) != len(sizes) or sum(n for n, _ in times) < len(sizes):
            raise ValueError("samples are missing")
        sync = {x for (x,) in self.rows(b"stss", "I")} if b"stss" in self.found else None
        if sync and not (min(sync) >= 1 and max(sync) <= len(sizes)):
            raise ValueError("a sync sample is missing")
        each = itertools.chain.from_iterable(itertools.repeat(ticks, min(n, len(sizes))) for n, ticks in times)
        self.samples += [(a, b, t, sync is None or i in sync) for i, ((a, b), t) in enumerate(zip(places, each), 1)]


def _runs_of(data: bytes, a: int, b: int, at: int, fixed: tuple[int, int, int]) -> tuple[list[tuple[int, int, int, bool]], int]:
    """Samples of one trun box from ``at`` on, and where they end; ``fixed`` has the ticks, size and flags of those that say none."""
    if b - a < 8:
        raise ValueError("a run is cut off")
    flags, n = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF, struct.unpack_from(">I", data, a + 4)[0]
    place = a + 8 + 4 * bool(flags & 1)
    first = struct.unpack_from(">I", data, place)[0] if flags & 4 and place + 4 <= b else None
    place += 4 * bool(flags & 4)
    fields = [i for i, bit in enumerate((0x100, 0x200, 0x400, 0x800)) if flags & bit]
    if place + 4 * n * len(fields) > b or (not fields and n * fixed[1] > len(data)):
        raise ValueError("a run is cut off")
    out = []
    for i in range(n):
        said = dict(zip(fields, struct.unpack_from(f">{len(fields)}I", data, place + 4 * i * len(fields)), strict=True))
        ticks, size = said.get(0, fixed[0]), said.get(1, fixed[1])
        kind = said.get(2, fixed[2] if i or first is None else first)
        out.append((at, at + size, ticks, not kind & 0x10000))
        at += size
    return out, at


def _fragments(data: bytes, boxes: list[tuple[int, bytes, int, int]], tracks: dict[int, _Track]) -> None:
    """Adds the samples of movie fragments to their tracks."""
    defaults: dict[int, tuple[int, int, int]] = {}
    for _, kind, a, b in boxes:
        if kind == b"trex" and b - a >= 24:
            track, _, ticks, size, flags = struct.unpack_from(">5I", data, a + 4)
            defaults[track] = (ticks, size, flags)
    moof, track, base, fixed, at = 0, None, 0, (0, 0, 0), 0
    for _, kind, a, b in boxes:
        if kind == b"moof":
            moof = at = a - 8
        elif kind == b"tfhd":
            if b - a < 8:
                raise ValueError("a fragment is cut off")
            flags, number = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF, struct.unpack_from(">I", data, a + 4)[0]
            track, fixed, place, base = tracks.get(number), list(defaults.get(number, (0, 0, 0))), a + 8, moof
            for bit, width, slot in ((1, 8, None), (2, 4, None), (8, 4, 0), (16, 4, 1), (32, 4, 2)):
                if flags & bit:
                    if place + width > b:
                        raise ValueError("a fragment is cut off")
                    (value,) = struct.unpack_from(">Q" if width == 8 else ">I", data, place)
                    if slot is not None:
                        fixed[slot] = value
                    elif bit == 1:
                        base = value
                    place += width
            at = base
        elif kind == b"trun" and track is not None:
            if b - a >= 12 and struct.unpack_from(">I", data, a)[0] & 1:
                at = base + struct.unpack_from(">i", data, a + 8)[0]
            found, at = _runs_of(data, a, b, at, tuple(fixed))
            track.samples += found


def tracks_of(data: bytes) -> list[_Track]:
    """The tracks of a file in their order, with the samples of tables and of fragments; what is broken raises ValueError or struct.error."""
    boxes = list(walk(data))
    out: list[_Track] = []
    inside = None
    for depth, kind, a, b in boxes:
        if inside is not None and depth <= inside:
            inside = None
        if kind == b"trak":
            out.append(_Track(data))
            inside = depth
        elif inside is not None:
            out[-1].found.setdefault(kind, (a, b))
    for track in out:
        track.header()
        track.table_samples()
    if any(kind == b"moof" for _, kind, _, _ in boxes):
        _fragments(data, boxes, {t.id: t for t in out})
    if any(b > len(data) or a < 0 for t in out for a, b, _, _ in t.samples):
        raise ValueError("samples are missing")
    return out


def describe(data: bytes) -> dict:
    """Codec, duration and byte ranges of the main track (the first of pictures, else the first), from boxes and tables alone.

    Keys: codec, kind, tracks (their number), timescale, duration, ticks, samples, ranges [(start, end)] of all
    samples merged, keyframes [(start, end)].  An unreadable file has only the key error.
    """
    try:
        found = tracks_of(data)
        if not found:
            raise ValueError("no track")
    except (ValueError, struct.error) as e:
        return {"error": str(e) or type(e).__name__}
    main = next((t for t in found if t.kind == "vide"), found[0])
    merged: list[list[int]] = []
    for a, b, _, _ in main.samples:
        if merged and merged[-1][1] == a:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    ticks = sum(t for _, _, t, _ in main.samples)
    return {
        "codec": main.codec, "kind": main.kind, "tracks": len(found), "timescale": main.scale, "duration": main.duration or ticks, "ticks": ticks, "samples": len(main.samples),
        "ranges": [tuple(x) for x in merged], "keyframes": [(a, b) for a, b, _, sync in main.samples if sync],
    }


def read_payload(data: bytes) -> bytes:
    """The stored sample bytes, by the sample tables."""
    seen = describe(data)
    if "error" in seen:
        raise ValueError(seen["error"])
    return b"".join(data[a:b] for a, b in seen["ranges"])


def encode_media(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media): each text's media file.  A null text is the empty one; extra columns are not carried."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            media = [write_media(padded(t)) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["k", "media"])

    return arrow_map(texts.select(texts[key].alias("k"), texts[text].alias("t")), run, f"k {kind}, media binary").withColumnRenamed("k", key)


def media_columns(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, codec, duration_s, n_samples, keyframes, error) of media files.

    ``keyframes`` is an array of (start, end) byte ranges.  A null or unreadable file has null
    columns and the reason in ``error``.
    """
    kind = media.schema[key].dataType.simpleString()
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows = [describe(x) if x is not None else {"error": "no file"} for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r.get("codec") for r in rows], pa.string()),
                    pa.array([r["duration"] / r["timescale"] if r.get("timescale") else None for r in rows], pa.float64()),
                    pa.array([r.get("samples") for r in rows], pa.int64()),
                    pa.array([None if "error" in r else [{"start": a, "end": b} for a, b in r["keyframes"]] for r in rows], ranges),
                    pa.array([r.get("error") for r in rows], pa.string()),
                ],
                names=["k", "codec", "duration_s", "n_samples", "keyframes", "error"],
            )

    schema = f"k {kind}, codec string, duration_s double, n_samples long, keyframes array<struct<start:long,end:long>>, error string"
    return arrow_map(media.select(media[key].alias("k"), media[column].alias("m")), run, schema).withColumnRenamed("k", key)


def media_digest(texts: DataFrame) -> DataFrame:
    """One row a document: its text stored as a media file, read back through the tables, and digests of both."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def row(text: bytes) -> tuple:
        media = write_media(padded(text))
        seen = describe(media)
        back = b"".join(media[a:b] for a, b in seen["ranges"])
        keys = seen["keyframes"]
        feature = f"{seen['codec'].strip()}:{seen['timescale']}:{seen['duration']}:{seen['samples']}:{len(keys)}:{keys[0][0]}-{keys[0][1]}:{keys[-1][0]}-{keys[-1][1]}"
        return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches):
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            columns = list(zip(*map(row, utf8(batch.column(1))), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(texts.select("doc_id", "text"), run, schema)
