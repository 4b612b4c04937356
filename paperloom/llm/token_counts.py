"""Token counts by rank-synchronous merging of byte-pair ranks on ragged numpy arrays.

All new pre-tokens of a block are one flat array of symbols.  In each round every sequence
applies its lowest-ranked pair at all places at once (a later merge never ranks below the one
that made its parts, so this equals merging one by one); sequences without pairs retire with
the number of their symbols.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.llm.encoding import _Numbers, pretoken_pattern
from paperloom.llm.shared import arrow_map, blocks

_NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class MergeCounter:
    """Counts symbols that survive all merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.base = max(vocab.values()) + 1
        self.byte_id = np.array([vocab[c] for c in byte_symbols()], np.int64)
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], _NONE)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """The number of symbols left in each pre-token (one byte or more each)."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        result = lengths.copy()
        who = np.arange(len(tokens))
        ids = self.byte_id[np.frombuffer(b"".join(tokens), np.uint8)]
        ranks = np.full(len(ids), _NONE, np.int32)
        if len(ids) > 1:
            ranks[:-1] = self._ranks(ids[:-1], ids[1:])
        if len(ids):
            ranks[np.cumsum(lengths) - 1] = _NONE
        while len(ids):
            lowest = np.minimum.reduceat(ranks, np.cumsum(lengths) - lengths)
            alive = lowest < _NONE
            if not alive.all():
                result[who[~alive]] = lengths[~alive]
                stay = np.repeat(alive, lengths)
                who, lengths, lowest, ids, ranks = who[alive], lengths[alive], lowest[alive], ids[stay], ranks[stay]
                if not len(ids):
                    break
            owner = np.repeat(np.arange(len(who)), lengths)
            hits = np.flatnonzero(ranks == lowest[owner])
            begins = np.r_[True, np.diff(hits) != 1]
            nth = np.arange(len(hits)) - np.maximum.accumulate(np.where(begins, np.arange(len(hits)), 0))
            hits = hits[nth % 2 == 0]
            ids[hits] = self.made[ranks[hits]]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            ranks[hits] = ranks[hits + 1]
            lengths -= np.bincount(owner[hits], minlength=len(who))
            hits -= np.arange(len(hits))
            ids, ranks, owner = ids[keep], ranks[keep], owner[keep]
            stale = np.unique(np.r_[hits, hits[hits > 0] - 1])
            stale = stale[stale < len(ids) - 1]
            inside = owner[stale] == owner[stale + 1]
            stale, ends = stale[inside], stale[~inside]
            ranks[stale] = self._ranks(ids[stale], ids[stale + 1])
            ranks[ends] = _NONE
            ranks[-1] = _NONE
        return result


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, limit: int = 512, remembered: int = 300_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    A null text is empty: no bytes, no tokens.  Strings of special tokens inside a text count as
    one token, as the library has it.  Repeated rows and null doc_ids keep their rows; extra columns are not
    read.  A worker remembers the counts of at most ``remembered`` pre-tokens and a block's more.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counter, find = MergeCounter(tokenizer_path), pretoken_pattern(pattern).findall
        import regex

        split = regex.compile("|".join(map(regex.escape, counter.specials))).split if counter.specials else None
        numbers, known = _Numbers(), np.zeros(0, np.int64)
        for ids, texts in blocks(batches):
            if len(numbers) > remembered:
                numbers, known = _Numbers(), known[:0]
            at, extra = [], []
            for t in texts:
                text = t.decode()
                parts = split(text) if split else [text]
                extra.append(len(parts) - 1)
                found = [w for p in parts for w in find(p)] if len(parts) > 1 else find(text)
                at.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
            if numbers.new:
                known = np.r_[known, counter.count([w.encode() for w in numbers.new])]
                numbers.new = []
            n = [int(known[a].sum()) + e for a, e in zip(at, extra, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
