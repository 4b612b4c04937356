"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Each block of texts deals its distinct pre-tokens over buckets; a bucket's requests stream past one
worker, which encodes each distinct one once for all blocks; ids come back to the block, where
positions put them in order again.  Decoding joins ids with the token-byte table.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.llm.encoding import _Numbers, pretoken_pattern, ragged
from paperloom.llm.shared import arrow_map, arrow_rows, blocks, partitions
from paperloom.llm.word_blocks import ANSWER, ANSWER_DDL, BLOCK_BYTES, PAYLOAD, PAYLOAD_DDL, REQUEST, REQUEST_DDL, block_id, dealt, from_payload, pack, pack_words, payload, split_words, unpack

#: Encoded words that a worker remembers at a time; whatever comes again later is encoded again.
MEMO = 1_000_000
#: Bytes of one batch of answers.
ANSWER_BYTES = 16 << 20


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file, read once a worker."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def piece_encoder(path: str):
    """The ids of one pre-token, which the library takes whole; built once a worker."""
    import tiktoken

    whole = tiktoken.Encoding("ranks", pat_str="(?s:.+)", mergeable_ranks=load_ranks(path), special_tokens={}).encode_ordinary
    return lambda word: whole(word.decode())


class TokenBytes:
    """The token-byte table: ids to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = sorted((i, b) for b, i in ranks.items())
        lengths = np.zeros(by_id[-1][0] + 2, np.int64)
        for i, b in by_id:
            lengths[i] = len(b)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(b for _, b in by_id), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged(self.flat, self.starts[ids], self.lengths[ids]).tobytes()


@cache
def token_bytes(path: str) -> TokenBytes:
    return TokenBytes(load_ranks(path))


def _answer(words: list[bytes], encode) -> tuple[np.ndarray, np.ndarray]:
    ids = [encode(w) for w in words]
    return np.fromiter(map(len, ids), np.uint32, len(ids)), np.fromiter((x for e in ids for x in e), np.uint32)


def encode_blocks(docs: DataFrame, ranks_path: str, pattern: str, finish, schema: str) -> DataFrame:
    """Runs ``finish(ids of docs, token ids of each text)`` on every block; it returns a record batch of ``schema``."""
    n = partitions(docs.sparkSession)
    rows = docs.select("doc_id", "text")

    def ask(batches):
        find = pretoken_pattern(pattern).findall
        for ids, texts in blocks(batches, BLOCK_BYTES):
            words = {w for t in texts for w in find(t.decode())}
            here = block_id(ids, texts)
            yield arrow_rows(REQUEST, [(b, here, pack_words(part)) for b, part in dealt([w.encode() for w in words], n)])

    def answer(batches):
        encode = piece_encoder(ranks_path)
        seen: dict[bytes, list[int]] = {}
        rows, size = [], 0
        for batch in batches:
            for bucket, block, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = []
                for w in split_words(*unpack(blob)):
                    if (found := seen.get(w)) is None:
                        if len(seen) >= MEMO:
                            seen.clear()
                        found = seen[w] = encode(w)
                    ids.append(found)
                rows.append((block, bucket, pack(np.fromiter(map(len, ids), np.uint32, len(ids)).tobytes(), np.fromiter((x for e in ids for x in e), np.uint32).tobytes())))
                size += len(rows[-1][2])
                if size >= ANSWER_BYTES:
                    yield arrow_rows(ANSWER, rows)
                    rows, size = [], 0
        if rows:
            yield arrow_rows(ANSWER, rows)

    def hold(batches):
        for ids, texts in blocks(batches, BLOCK_BYTES):
            yield arrow_rows(PAYLOAD, [(block_id(ids, texts), payload(ids, texts))])

    def assemble(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        got = dict(zip(answers["bucket"].to_pylist(), answers["answer"].to_pylist(), strict=True))
        find = pretoken_pattern(pattern).findall
        for blob in texts["texts"].to_pylist():
            ids, texts_ = from_payload(blob)
            numbers = _Numbers()
            at = []
            for t in texts_:
                found = find(t.decode())
                at.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
            place = np.zeros(len(numbers), np.int64)
            counts, flat, done = [], [], 0
            for bucket, words in dealt([w.encode() for w in numbers.new], n):
                place[[numbers[w.decode()] for w in words]] = np.arange(done, done + len(words))
                done += len(words)
                c, f = (np.frombuffer(x, np.uint32) for x in unpack(got[bucket])) if bucket in got else (np.zeros(0, np.uint32),) * 2
                if len(c) != len(words):  # rows in another order than when the block asked
                    c, f = _answer(words, piece_encoder(ranks_path))
                counts.append(c)
                flat.append(f)
            counts = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
            flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
            starts = np.cumsum(counts) - counts
            out.append(finish(ids, [ragged(flat, starts[place[a]], counts[place[a]]) for a in at]))
        return pa.Table.from_batches(out)

    asked = arrow_map(arrow_map(rows, ask, REQUEST_DDL).repartition("bucket"), answer, ANSWER_DDL)
    held = arrow_map(rows, hold, PAYLOAD_DDL)
    return held.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(assemble, schema)


def _doc_type(docs: DataFrame) -> tuple[str, pa.DataType]:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return kind, {"int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row; a null text has no ids.  Null doc_ids and repeated rows stay, extra columns are not read."""
    kind, arrow = _doc_type(docs)

    def finish(ids, tokens):
        return pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array([t.astype(np.int32) for t in tokens], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return encode_blocks(docs, ranks_path, pattern, finish, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids) rows; bytes that are not UTF-8 become U+FFFD, null ids a null text."""
    kind, _ = _doc_type(encoded)

    def run(batches):
        table = token_bytes(ranks_path)
        for batch in batches:
            texts = [None if x is None else table.decode(np.array(x, np.int64)).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of the bytes they decode to."""
    kind, arrow = _doc_type(docs)

    def finish(ids, tokens):
        table = token_bytes(ranks_path)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, arrow),
                pa.array(list(map(len, tokens)), pa.int64()),
                pa.array([hashlib.sha256(t.astype("<u4").tobytes()).hexdigest() for t in tokens], pa.string()),
                pa.array([hashlib.sha256(table.decode(t.astype(np.int64))).hexdigest() for t in tokens], pa.string()),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return encode_blocks(docs, ranks_path, pattern, finish, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
