"""Blocks of texts that ask for their distinct words by bucket, and get the answers back by block.

A block names itself by a hash of its rows, so passes over the same table agree on blocks
whatever executor runs them.  Rows that travel are packed and compressed: a block's words once a
bucket, the answers in the same order, and the block's texts once.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

BLOCK_BYTES = 3_000_000


def pack(*parts: bytes) -> bytes:
    sizes = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(parts))


def unpack(blob: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ends = np.cumsum(np.frombuffer(data, np.int64, n, 8)) + 8 * (n + 1)
    starts = np.r_[8 * (n + 1), ends[:-1]] if n else []
    return [data[a:b] for a, b in zip(starts, ends, strict=True)]


def pack_words(words: list[bytes], *more: bytes) -> bytes:
    return pack(np.fromiter(map(len, words), np.uint32, len(words)).tobytes(), b"".join(words), *more)


def split_words(lengths: bytes, joined: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(lengths, np.uint32), dtype=np.int64).tolist()
    if not ends:
        return []
    return [joined[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def block_id(ids: list, texts: list[bytes]) -> int:
    h = xxhash.xxh3_64(json.dumps(ids).encode())
    for t in texts:
        h.update(len(t).to_bytes(8, "little"))
        h.update(t)
    return h.intdigest() - (1 << 63)


def payload(ids: list, texts: list[bytes]) -> bytes:
    return pack(json.dumps(ids).encode(), np.fromiter(map(len, texts), np.uint32, len(texts)).tobytes(), b"".join(texts))


def from_payload(blob: bytes) -> tuple[list, list[bytes]]:
    ids, lengths, joined = unpack(blob)
    return json.loads(ids), split_words(lengths, joined)


def dealt(words: list[bytes], n_buckets: int) -> list[tuple[int, list[bytes]]]:
    """Distinct words by bucket, sorted within it, so that any pass has them in one order."""
    out: dict[int, list[bytes]] = {}
    digest = xxhash.xxh3_64_intdigest
    for w in sorted(words):
        out.setdefault(digest(w) % n_buckets, []).append(w)
    return sorted(out.items())


REQUEST = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary())])
ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("answer", pa.binary())])
PAYLOAD = pa.schema([("block", pa.int64()), ("texts", pa.binary())])
REQUEST_DDL, ANSWER_DDL, PAYLOAD_DDL = "bucket int, block long, words binary", "block long, bucket int, answer binary", "block long, texts binary"
