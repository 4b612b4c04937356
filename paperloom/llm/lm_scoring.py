"""LM scoring by online logistic context mixing.

A text is its words and one end.  Each token is told by a chain of bits: is it what followed the word
before it earlier in this text; what followed the two words before in the corpus; what followed the
word before; a word of this text; a word of the corpus; else it is spelled.  A bit's probability comes
from several predictors in the logistic domain (how often the context was seen, how often it has told
the token in this text so far, how long it has told each, and the corpus-wide rate), combined by
weights that the context's count gates; the weights are refined along the text, CHUNK tokens at a
time, by the bit that the token turned out to have.  With the context's own counts behind each
bit, a token's probability sums over its chains, and all tokens together share one unit.

Spelling is bit by bit: each bit of a byte is predicted by hashed contexts of one to four bytes back
in the word, mixed by gated weights, and an adaptive map refines the mix.

What is gathered grows with the corpus: counts of every word, pair and triple of words, by hash, over
parts of the hash space.  Blocks of texts ask for the counts of what they hold and get them back in
the order they asked.  Parts are by the size of the table, never by the number of partitions, and
sums are of whole numbers or in the order of parts, so scores do not depend on how Spark deals tasks.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import arrow_map, arrow_rows, blocks, materialize, parts, stored
from paperloom.llm.word_blocks import PAYLOAD, PAYLOAD_DDL, block_id, from_payload, pack, payload, split_words, unpack

BLOCK_BYTES = 4_000_000
#: Parts of the hash space at least.
PARTS = 96
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BEFORE = np.uint64(0x632BE59BD9B4E019)

# -- spelling ---------------------------------------------------------------------------------

#: log2 of the counters of each spelling context, one to four bytes back.
TABLES = (16, 18, 20, 22)
STARTS = np.cumsum([0, *(1 << b for b in TABLES)])
RANGES = 32
WORDS_AT_ONCE = 50_000
INPUTS, GATES, BINS = len(TABLES) + 1, 64, 33


class Spelled:
    """The bytes of words, their contexts, and the word each belongs to."""

    def __init__(self, words: list[bytes]):
        text = [w + b" " if w else b"\n" for w in words]
        lengths = np.fromiter(map(len, text), np.int64, len(text))
        self.starts = np.cumsum(lengths) - lengths
        self.owner = np.repeat(np.arange(len(text)), lengths)
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        place = np.arange(len(self.bytes)) - self.starts[self.owner]
        b = self.bytes.astype(np.uint64)
        run = np.zeros(len(b), np.uint64)
        self.contexts = []
        for k in (1, 2, 3, 4):
            p = np.zeros(len(b), np.uint64)
            p[k:] = b[:-k] + np.uint64(1)
            run = run * np.uint64(257) + np.where(place >= k, p, np.uint64(0))
            self.contexts.append(run)

    def bits(self):
        """For each of the eight bits: the bit, and its counter in every context's table."""
        with np.errstate(over="ignore"):
            for j in range(8):
                node = (np.uint64(1) << np.uint64(j)) | (self.bytes >> np.uint8(8 - j)).astype(np.uint64) if j else np.ones(len(self.bytes), np.uint64)
                slots = []
                for k, c in enumerate(self.contexts):
                    h = (c * np.uint64(512) + node + np.uint64(k)) * _MIX
                    h ^= h >> np.uint64(29)
                    slots.append(((h * _MIX) >> np.uint64(64 - TABLES[k])).astype(np.int64) + STARTS[k])
                yield j, (self.bytes >> np.uint8(7 - j)) & np.uint8(1), slots


def counters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of the zeros and ones that the words leave in all counters: place 2 * slot + bit."""
    counts = np.zeros(2 * STARTS[-1] if words else 0, np.int64)
    for at in range(0, len(words), WORDS_AT_ONCE):
        for _, bit, slots in Spelled(words[at : at + WORDS_AT_ONCE]).bits():
            for s in slots:
                np.add.at(counts, 2 * s + bit, 1)
    places = np.flatnonzero(counts)
    return places, counts[places]


class Mixer:
    """Stretched predictions and confidences of the counters, weights by gate, and the refining map."""

    def __init__(self, stretched: np.ndarray, confidence: np.ndarray):
        self.stretched, self.confidence = stretched, confidence
        self.weights = np.full((GATES, INPUTS), 0.3)
        self.weights[:, -1] = 0
        self.map = np.zeros((2, 8 * BINS))

    @classmethod
    def of(cls, zeros: np.ndarray, ones: np.ndarray) -> Mixer:
        stretched = np.log((ones + 0.05) / (zeros + 0.05))
        return cls((np.clip(stretched, -15, 15) * 2048).astype(np.int16), np.minimum(np.log2(zeros + ones + 1) / 1.5, 15).astype(np.uint8))

    def _inputs(self, slots):
        x = np.stack([self.stretched[s] for s in slots] + [np.full(len(slots[0]), 614, np.int16)]).astype(np.float32) / 2048
        deep, near = self.confidence[slots[-1]], self.confidence[slots[-2]]
        return x, deep.astype(np.int64) * 4 + np.minimum(near // 3, 3)

    @staticmethod
    def _bin(j: int, z: np.ndarray) -> np.ndarray:
        return j * BINS + np.clip(np.rint(z * 2) + BINS // 2, 0, BINS - 1).astype(np.int64)

    def learn(self, words: list[bytes], batch: int = 1000, rate: float = 0.3) -> None:
        """One online pass over distinct words, which also fills the map with what the weights of the time said."""
        for at in range(0, len(words), batch):
            part = Spelled(words[at : at + batch])
            for j, bit, slots in part.bits():
                x, gate = self._inputs(slots)
                z = np.einsum("kn,nk->n", x, self.weights[gate])
                here = self._bin(j, z)
                self.map[0] += np.bincount(here, minlength=8 * BINS)
                self.map[1] += np.bincount(here, weights=bit, minlength=8 * BINS)
                off = bit - 1 / (1 + np.exp(-np.clip(z, -20, 20)))
                total = np.bincount(gate, minlength=GATES) + 20
                step = np.stack([np.bincount(gate, weights=off * x[k], minlength=GATES) for k in range(INPUTS)], 1)
                self.weights += rate / (1 + 10 * at / max(1, len(words))) * step / total[:, None]

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of the probability of each word with its space, or of the end."""
        out = np.zeros(len(words))
        middle = 1 / (1 + np.exp(-(np.arange(8 * BINS) % BINS - BINS // 2) / 2))
        refined = (self.map[1] + 20 * middle) / (self.map[0] + 20)
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = Spelled(words[at : at + WORDS_AT_ONCE])
            total = np.zeros(len(part.bytes))
            for j, bit, slots in part.bits():
                x, gate = self._inputs(slots)
                z = np.einsum("kn,nk->n", x, self.weights[gate])
                p = (1 / (1 + np.exp(-np.clip(z, -20, 20))) + refined[self._bin(j, z)]) / 2
                total += np.log10(np.where(bit == 1, p, 1 - p))
            out[at : at + WORDS_AT_ONCE] = np.add.reduceat(total, part.starts)
        return out


# -- words in their contexts ------------------------------------------------------------------


def tokens(text: bytes) -> list[bytes]:
    """The words, A-Z lower-cased, and the empty word for the end."""
    return [*text.lower().split(), b""]


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _after(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(context) + token)


END = np.uint64(xxhash.xxh3_64_intdigest(b""))
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def numbered_tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct tokens, the number of each token of all texts among them, how many tokens a text has): :func:`tokens` of many texts at once."""
    joined = np.frombuffer(b"".join(x + b"\n" for x in texts).lower(), np.uint8)
    word = ~_BLANK[joined]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1 if len(word) else np.zeros(0, np.int64)
    edges = np.r_[0, edges] if len(word) and word[0] else edges
    first, sizes = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    before = np.searchsorted(first, ends)
    offsets = np.concatenate([[0], np.cumsum(np.insert(sizes, before, 0))]).astype(np.int64)
    every = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(joined[word])]).dictionary_encode()
    return every.dictionary.to_pylist(), every.indices.to_numpy().astype(np.int64), np.diff(before, prepend=0) + 1


class Block:
    """Texts as numbers: words in order of their hash, and the places of words, pairs and triples of every token."""

    def __init__(self, texts: list[bytes]):
        distinct, at, self.lengths = numbered_tokens(texts)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
        order = np.argsort(h, kind="stable")
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        self.distinct, self.order, self.word_hashes = distinct, order, h[order]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        self.place = np.arange(len(self.doc)) - self.starts[self.doc]
        self.word = rank[at]
        token = self.word_hashes[self.word]
        one, two = (np.where(self.place >= k, np.r_[np.zeros(k, np.uint64), token[:-k]][: len(token)], _BEFORE) for k in (1, 2))
        self.pair_hashes, self.pair = np.unique(_after(one, token), return_inverse=True)
        self.triple_hashes, self.triple = np.unique(_after(_after(two, one), token), return_inverse=True)

    @cached_property
    def words(self) -> list[bytes]:
        return self.spelled_out(np.arange(len(self.order)))

    def spelled_out(self, places: np.ndarray) -> list[bytes]:
        return [self.distinct[i] for i in self.order[places].tolist()]

    def hashes(self) -> tuple[np.ndarray, ...]:
        return self.word_hashes, self.pair_hashes, self.triple_hashes

    def places(self) -> tuple[np.ndarray, ...]:
        return self.word, self.pair, self.triple


def cuts(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n parts of the hash space begins among sorted hashes, and the end."""
    part = ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    return np.searchsorted(part, np.arange(n + 1))


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers, all first bytes, all second bytes ...: what is small packs well."""
    return x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()


def _runs(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many equal codes come before each in its text, and how many its text has; codes are whole numbers from 0, texts come in order."""
    order = np.argsort((code & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, int(code.max(initial=0)).bit_length(), 16):
        order = order[np.argsort(((code >> shift) & 0xFFFF).astype(np.uint16)[order], kind="stable")]
    k, d = code[order], doc[order]
    first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])][: len(k)])
    sizes = np.diff(np.r_[first, len(k)])
    earlier, uses = np.empty(len(code), np.int64), np.empty(len(code), np.int64)
    earlier[order] = np.arange(len(k)) - np.repeat(first, sizes)
    uses[order] = np.repeat(sizes, sizes)
    return earlier, uses


def _earlier(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return _runs(code, doc)[0]


def _uses(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each code is in its text."""
    return _runs(code, doc)[1]


#: Tokens after which a text's weights are refined, the step, and what steadies it.
CHUNK, STEP, STEADY = 32, 0.4, 12.0
LEVELS, GATED = 5, 4
#: The weights that the fit starts from and is drawn to: a bit is as likely as its own rate in the text so far.
NEUTRAL = np.tile(np.array([0.0, 0.0, 1.0, 0.0, 0.0]), (LEVELS, GATED, 1))
#: Turns of the fit, each over all training texts, and how many tokens the neutral weights count for.
TURNS, DRAWN = 1, 50.0


class Tokens:
    """What chances are made of, for every token of some texts: its counts by word, pair and triple, how often word and pair came earlier in the text, how its word is spelled, and how often its text has word, pair and triple (if asked)."""

    def __init__(self, lengths: np.ndarray, counts: tuple[np.ndarray, ...], earlier: tuple[np.ndarray, ...], spelled: np.ndarray, uses: tuple[np.ndarray, ...] = ()):
        self.lengths, self.counts, self.earlier, self.spelled, self.uses = lengths, counts, earlier, spelled, uses
        self.starts = np.cumsum(lengths) - lengths

    @classmethod
    def of(cls, block: Block, counts: tuple[np.ndarray, ...], uses: bool) -> Tokens:
        """``counts`` by word, pair and triple of the block; how words are spelled is to be filled in."""
        runs = [_runs(x, block.doc) for x in (block.word, block.pair)]
        own = (runs[0][1], runs[1][1], _uses(block.triple, block.doc)) if uses else ()
        return cls(block.lengths, tuple(c[x] for c, x in zip(counts, block.places(), strict=True)), (runs[0][0], runs[1][0]), np.ones(len(block.word)), own)

    def part(self, at: int, end: int) -> Tokens:
        """Those of the texts from ``at`` to ``end``."""
        lengths, a = self.lengths[at:end], int(self.starts[at])
        here = slice(a, a + int(lengths.sum()))
        return Tokens(lengths, tuple(x[here] for x in self.counts), tuple(x[here] for x in self.earlier), self.spelled[here], tuple(x[here] for x in self.uses))

    def slices(self, limit: int = 250_000):
        """(from, to) of runs of texts that have about ``limit`` tokens together."""
        at = 0
        while at < len(self.lengths):
            end = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + limit)))
            yield at, end
            at = end

    def packed(self) -> bytes:
        """Of words of the corpus, no spelling is kept."""
        numbers = [x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (self.lengths, *self.counts, *self.earlier)]
        return pack("".join(x.dtype.char for x in numbers).encode(), *(x.tobytes() for x in numbers), self.spelled[self.counts[0] == 0].tobytes())

    @classmethod
    def unpacked(cls, blob: bytes) -> Tokens:
        kinds, *numbers, new = unpack(blob)
        lengths, *rest = (np.frombuffer(x, c).astype(np.int64) for c, x in zip(kinds.decode(), numbers, strict=True))
        spelled = np.zeros(len(rest[0]))
        spelled[rest[0] == 0] = np.frombuffer(new, float)
        return cls(lengths, tuple(rest[:3]), tuple(rest[3:]), spelled)


class Chances:
    """What each level gives every token of some texts: its probability of the token, and the signs for the level's bit."""

    def __init__(self, block: Block, at: int, end: int, counts: tuple[np.ndarray, ...], total: int, ends: int, rates: np.ndarray, spelled: np.ndarray, first_weights: np.ndarray = NEUTRAL, left_out: bool | np.ndarray = False):
        """Of the texts from ``at`` to ``end``; ``counts`` by word, pair and triple, ``spelled`` by word: 0 for words of the corpus.

        ``left_out``: the own counts of each text (or of those marked) are taken off, as if it had not been learned from.
        """
        tokens = Tokens.of(block, counts, bool(np.any(left_out)))
        tokens.spelled = spelled[block.word]
        self._told(tokens.part(at, end), total, ends, rates, first_weights, left_out)

    @classmethod
    def of(cls, tokens: Tokens, *more) -> Chances:
        """Of some texts' tokens; ``more``: total, ends, rates, first weights and what is left out."""
        out = cls.__new__(cls)
        out._told(tokens, *more)
        return out

    def _told(self, tokens: Tokens, total: int, ends: int, rates: np.ndarray, first_weights: np.ndarray = NEUTRAL, left_out: bool | np.ndarray = False) -> None:
        self.lengths, self.starts = tokens.lengths, tokens.starts
        n_tokens = int(self.lengths.sum())
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        starts, index = self.starts[doc], np.arange(n_tokens)
        place = index - starts
        first = place == 0
        c0, c1, c2 = (c.astype(float) for c in tokens.counts)
        word_earlier, pair_earlier = (x.astype(float) for x in tokens.earlier)
        fit = np.any(left_out)
        if fit:
            self.own = np.broadcast_to(left_out, len(self.lengths))[doc]
            c0, c1, c2 = (c - u * self.own for c, u in zip((c0, c1, c2), tokens.uses, strict=True))
            ends, total = ends - self.own, total - self.lengths[doc] * self.own.astype(float)
        before = lambda x: np.r_[0.0, x[:-1]]
        given = [
            (pair_earlier, np.where(first, 0.0, before(word_earlier))),
            (c2, np.where(first, ends, before(c1))),
            (c1, np.where(first, ends, before(c0))),
            (word_earlier, place.astype(float)),
            (c0, total if fit else np.full(n_tokens, float(total))),
        ]
        self.spelled = np.where(c0 > 0, 0, tokens.spelled) if fit else tokens.spelled
        self.p = np.empty((LEVELS, n_tokens))
        self.known = np.empty((LEVELS, n_tokens), bool)
        self.rate, self.run, self.start = (np.empty((LEVELS, n_tokens), np.float32) for _ in range(3))
        if fit:
            self.size, self.gate = np.empty((LEVELS, n_tokens), np.float32), np.empty((LEVELS, n_tokens), np.int8)
        for k in (1, 0, 2, 3, 4):
            c, n = given[k]
            self.known[k] = n > 0
            self.p[k] = np.where(self.known[k], c, 0) / np.where(self.known[k], n, 1)
            hit = c * self.known[k] > 0
            hits, tried = (np.cumsum(x, dtype=np.int64) - x for x in (hit, self.known[k]))
            rate = ((hits - hits[starts] + 3 * rates[k]) / (tried - tried[starts] + 3)).astype(np.float32)
            self.rate[k] = np.log(rate / (1 - rate) + 1e-9).clip(-6, 6)
            last = np.maximum.accumulate(np.where(hit, -1, index))
            self.run[k] = np.log2((index - np.maximum(np.r_[-1, last[:-1]], starts - 1)).astype(np.float32)) / 2
            size = np.log2((1 + n).astype(np.float32)) / 4 if k < 4 else np.zeros(n_tokens, np.float32)
            gate = (np.log2(np.maximum(n, 1)) / 2 if k < 4 else np.log2(place + 1.0) / 3).clip(0, GATED - 1).astype(np.int64)
            one, by_size, by_rate, by_run, by_first = np.ascontiguousarray(first_weights[k].T, np.float32)
            self.start[k] = one[gate] + by_size[gate] * size + by_rate[gate] * self.rate[k] + by_run[gate] * self.run[k] + by_first[gate] * self.run[1]
            if fit:
                self.size[k], self.gate[k] = size, gate

    def signs(self, k: int) -> list[np.ndarray]:
        """What weighs on level k's bit: one, the context's count, the rate and the run in the text, and the run of the level told first."""
        return [np.ones_like(self.size[k]), self.size[k], self.rate[k], self.run[k], self.run[1]]

    def bits(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How likely each level told the token, and how likely the chain came to it, given the levels' chances."""
        rest, bit, reached = self.spelled.astype(float), np.empty_like(s), np.empty_like(s)
        for k in range(LEVELS - 1, -1, -1):
            own = s[k] * self.p[k]
            rest = own + (1 - s[k]) * rest
            bit[k] = np.where(rest > 0, own / np.where(rest > 0, rest, 1), s[k])
        left = np.ones(s.shape[1])
        for k in range(LEVELS):
            reached[k] = left * self.known[k]
            left = left * (1 - bit[k])
        return bit, reached


    def sums(self) -> np.ndarray:
        """Slope (first) and bend of the likelihood of the bits of texts that were left out, by level and gate, at the weights they start from."""
        s = np.where(self.known, 1 / (1 + np.exp(-self.start.clip(-12, 12).astype(float))), 0)
        bit, reached = self.bits(s)
        out = np.zeros((LEVELS, GATED, NEUTRAL.shape[-1], NEUTRAL.shape[-1] + 1))
        for k in range(LEVELS):
            r = reached[k] * self.own
            here = np.flatnonzero(r > 0)
            here = here[np.argsort(self.gate[k][here], kind="stable")]
            edges = np.searchsorted(self.gate[k][here], np.arange(GATED + 1))
            x, r, p = np.stack([y[here] for y in self.signs(k)]).astype(float), r[here], s[k][here]
            slope, bend = r * (bit[k][here] - p), r * p * (1 - p)
            for g, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                f = x[:, a:b]
                out[k, g, :, 0] = f @ slope[a:b]
                out[k, g, :, 1:] = (f * bend[a:b]) @ f.T
        return out


def stepped(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Weights by level and gate after a logistic step, given :meth:`Chances.sums` of all texts at them."""
    out, n = weights.copy(), weights.shape[-1]
    for k in range(LEVELS):
        for g in range(GATED):
            slope = sums[k, g, :, 0] - DRAWN * (weights[k, g] - NEUTRAL[k, g])
            out[k, g] += np.linalg.solve(sums[k, g, :, 1:] + DRAWN * np.eye(n), slope).clip(-1, 1)
    return out


def token_logs(chances: Chances) -> np.ndarray:
    """log10 of each token's probability; every text starts from the first weights and refines them as it goes."""
    out = np.zeros(chances.p.shape[1])
    order = np.argsort(-chances.lengths, kind="stable")
    lengths, starts = chances.lengths[order], chances.starts[order]
    bias, by_rate, by_run = np.zeros((3, LEVELS, len(order), 1), np.float32)
    for at in range(0, int(lengths[0]) if len(lengths) else 0, CHUNK):
        n = int(np.searchsorted(-lengths, -at, "left"))
        place = at + np.arange(min(CHUNK, int(lengths[0]) - at))
        inside = place < lengths[:n, None]
        token = np.where(inside, starts[:n, None] + place, 0)
        rate, run, known, p = chances.rate[:, token], chances.run[:, token], chances.known[:, token] & inside, chances.p[:, token]
        z = chances.start[:, token] + bias[:, :n] + by_rate[:, :n] * rate + by_run[:, :n] * run
        s = np.where(known, 1 / (1 + np.exp(-z.clip(-12, 12))), 0).astype(float)
        rest = chances.spelled[token]
        bit = np.empty_like(s)
        for k in range(LEVELS - 1, -1, -1):
            own = s[k] * p[k]
            rest = own + (1 - s[k]) * rest
            bit[k] = np.where(rest > 0, own / np.where(rest > 0, rest, 1), s[k])
        out[token[inside]] = np.log10(np.maximum(rest[inside], 1e-300))
        reached = np.ones_like(rest)
        for k in range(LEVELS):
            weight = reached * known[k]
            off = (weight * (bit[k] - s[k])).astype(np.float32)
            step = (STEP / (weight.sum(1, keepdims=True) + STEADY)).astype(np.float32)
            bias[k, :n] += step * off.sum(1, keepdims=True)
            by_rate[k, :n] += step * (off * rate[k]).sum(1, keepdims=True)
            by_run[k, :n] += step * (off * run[k]).sum(1, keepdims=True)
            reached *= 1 - bit[k]
    return out


# -- Spark ------------------------------------------------------------------------------------

_REQUEST = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("asked", pa.binary())])
_COUNTED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("answer", pa.binary()), ("totals", pa.list_(pa.int64())), ("words", pa.binary()), ("spelling", pa.binary())])
_GATHERED = pa.schema([("sums", pa.list_(pa.float64())), ("ends", pa.int64()), ("tokens", pa.binary())])
_COUNTED_DDL = "part int, block long, answer binary, totals array<long>, words binary, spelling binary"


#: Hashes that are merged at a time, about (fixed value).
MERGED_AT_ONCE = 1_000_000


def _merged(asked: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[slice]]]:
    """Of (sorted hashes, counts) by block, range after range of the hashes: distinct hashes, their counts in all blocks, the place of each asked one, and what was asked of each block."""
    ends = [(int(h[0]), int(h[-1])) for h, _ in asked if len(h)]
    if not ends:
        return
    low, high = min(e[0] for e in ends), max(e[1] for e in ends) + 1
    n = -(-sum(len(h) for h, _ in asked) // MERGED_AT_ONCE)
    edges = np.array([low + (high - low) * k // n for k in range(1, n)], np.uint64)
    bounds = np.stack([np.r_[0, np.searchsorted(h, edges), len(h)] for h, _ in asked])
    for k in range(n):
        here = [slice(*b) for b in bounds[:, k : k + 2].tolist()]
        found, place = np.unique(np.concatenate([h[x] for (h, _), x in zip(asked, here, strict=True)]), return_inverse=True)
        counts = np.zeros(len(found), np.int64)
        np.add.at(counts, place, np.concatenate([c[x] for (_, c), x in zip(asked, here, strict=True)]).astype(np.int64))
        yield found, counts, place, here


def _count_part(table: pa.Table) -> pa.Table:
    """Answers to the blocks that asked one part, and a row of what the part has in all: totals, words, spelling counters.

    Words, pairs and triples are taken one after the other, and merged by ranges of their hashes: what is held grows with
    the part by the hashes asked for and their counts, not by copies of these.
    """
    blocks_, blobs = table["block"].to_pylist(), table["asked"]
    narrow = lambda c: c.astype(np.uint32) if c.max(initial=0) < 1 << 32 else c
    answers: list[list[np.ndarray]] = [[] for _ in blocks_]
    learned: list[bytes] = []
    totals = []
    for k in range(3):
        asked, texts = [], []
        for blob in blobs:
            parts_ = unpack(blob.as_py())
            if k == 0:
                own = split_words(*parts_[:2]) if parts_[0] else []
                hashes, seen = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)), parts_[2]
                texts.append((np.cumsum([0, *map(len, own)]), parts_[1]))
            else:
                hashes, seen = np.cumsum(_from_planes(parts_[2 * k + 1]), dtype=np.uint64), parts_[2 * k + 2]
            asked.append((hashes, narrow(_from_planes(seen))))
        told = [[np.zeros(0, np.uint32)] for _ in blocks_]
        sums = np.zeros(3, np.int64)
        for found, counts, place, here in _merged(asked):
            sizes = np.array([x.stop - x.start for x in here])
            ends = np.cumsum([0, *sizes])
            each = narrow(counts)[place]
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                told[i].append(each[a:b].copy())
            sums += [counts.sum(), (counts > 0).sum(), (counts == 1).sum()]
            if k == 0:
                first = np.full(len(found), len(place))
                np.minimum.at(first, place, np.arange(len(place)))
                first = first[counts > 0]
                block = np.searchsorted(ends, first, side="right") - 1
                for i, j in zip(block.tolist(), (first - ends[block]).tolist(), strict=True):
                    at, joined = texts[i]
                    j += here[i].start
                    learned.append(joined[at[j] : at[j + 1]])
        for own_answers, t in zip(answers, told, strict=True):
            own_answers.append(np.concatenate(t))
        totals += sums.tolist()
    del asked, texts, told
    part = table["part"][0].as_py()
    rows = [(part, b, pack(*map(_planes, a)), None, None, None) for b, a in zip(blocks_, answers, strict=True)]
    answers.clear()
    places, n = counters(learned)
    spelling = pack(_planes(np.diff(places, prepend=0)), _planes(n))
    rows.append((part, None, None, totals, pack(np.fromiter(map(len, learned), np.uint32, len(learned)).tobytes(), b"".join(learned)), spelling))
    return pa.Table.from_batches([arrow_rows(_COUNTED, rows)])


def _spelling(counted: DataFrame) -> np.ndarray:
    """Zeros and ones of all spelling counters, (2, STARTS[-1]): summed by range, RANGES rows come to the driver."""
    edges = np.linspace(0, 2 * STARTS[-1], RANGES + 1).astype(np.int64)
    schema = pa.schema([("range", pa.int32()), ("counters", pa.binary())])

    def deal(batches):
        for batch in batches:
            for blob in batch.column(0):
                steps, n = map(_from_planes, unpack(blob.as_py()))
                places = np.cumsum(steps, dtype=np.uint64)
                at = np.searchsorted(places.astype(np.int64), edges)
                yield arrow_rows(schema, [(i, pack(_planes(np.diff(places[a:b], prepend=np.uint64(0))), _planes(n[a:b]))) for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if b > a])

    def add(table: pa.Table) -> pa.Table:
        i = table["range"][0].as_py()
        total = np.zeros(int(edges[i + 1] - edges[i]), np.int64)
        for blob in table["counters"]:
            steps, n = map(_from_planes, unpack(blob.as_py()))
            total[np.cumsum(steps, dtype=np.uint64).astype(np.int64) - edges[i]] += n.astype(np.int64)
        return pa.Table.from_batches([arrow_rows(schema, [(i, pack(_planes(total)))])])

    ddl = "range int, counters binary"
    dealt = arrow_map(counted.where("spelling is not null").select("spelling"), deal, ddl)
    flat = np.zeros(2 * STARTS[-1], np.int64)
    for r in dealt.groupBy("range").applyInArrow(add, ddl).toLocalIterator():
        flat[edges[r["range"]] : edges[r["range"] + 1]] = _from_planes(unpack(r["counters"])[0]).view(np.int64)
    return flat.reshape(-1, 2).T


def lm_scores(docs: DataFrame, first_weights: np.ndarray | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    A null text is empty: one token, its end.  Texts whose doc_id has crc32 mod 7 = 2 are scored
    but not learned from; a null doc_id counts as the empty text there.  Repeated rows are learned
    from and scored as often as they come; extra columns are not read; an empty table gives an
    empty one.  ``first_weights`` are those that every text starts from; without them they are fitted here, on all
    training texts, each seen as if it had not been learned from.  ``base_score`` is the add-one unigram's log10 probability, ``score`` the model's.
    """
    spark = docs.sparkSession
    rows = stored(docs.select("doc_id", "text"))
    n = parts(rows, PARTS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    doc_type = {"int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())

    def requests(block: Block, here: int, seen: list[np.ndarray]) -> pa.RecordBatch:
        at = [cuts(h, n).tolist() for h in block.hashes()]
        out = []
        for part in range(n):
            (wa, wb), *others = ((c[part], c[part + 1]) for c in at)
            words = block.words[wa:wb]
            asked = [np.fromiter(map(len, words), np.uint32, len(words)).tobytes(), b"".join(words), _planes(seen[0][wa:wb])]
            for (a, b), h, s in zip(others, block.hashes()[1:], seen[1:], strict=True):
                asked += [_planes(np.diff(h[a:b], prepend=np.uint64(0))), _planes(s[a:b])]
            out.append((part, here, pack(*asked)))
        return arrow_rows(_REQUEST, out)

    def ask(batches):
        for ids, texts in blocks(batches, BLOCK_BYTES):
            block, here = Block(texts), block_id(ids, texts)
            learned = np.array([not held_out(i) for i in ids])[block.doc]
            yield requests(block, here, [np.bincount(p[learned], minlength=len(h)) for p, h in zip(block.places(), block.hashes(), strict=True)])

    request = "part int, block long, asked binary"
    asked = arrow_map(rows, ask, request)
    counted = materialize(asked.groupBy("part").applyInArrow(_count_part, _COUNTED_DDL), "counted")
    sums = counted.where("totals is not null").select(F.posexplode("totals").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    totals = np.zeros(9, np.int64)
    for r in sums:
        totals[r["i"]] = r["x"]
    total, kinds = int(totals[0]), int(totals[1])
    again = [float(np.clip(1 - once / max(1, total), 0.01, 0.99)) for once in totals[2::3]]
    rates = np.array([0.3, again[2], again[1], 0.2, again[0]])
    zeros, ones = _spelling(counted).astype(float)
    fresh = Mixer.of(zeros, ones)
    tables = spark.sparkContext.broadcast((fresh.stretched, fresh.confidence))

    def learn(table: pa.Table) -> pa.Table:
        mixer = Mixer(*tables.value)
        words = [w for _, blob in sorted(zip(table["part"].to_pylist(), table["words"].to_pylist(), strict=True)) for w in split_words(*unpack(blob))]
        mixer.learn(words)
        return pa.table({"learner": table["learner"][:1], "n": pa.array([len(words)], pa.int64()), "weights": pa.array([mixer.weights.ravel().tolist()]), "seen": pa.array([mixer.map.ravel().tolist()])})

    vocabulary = counted.where("words is not null").select(F.expr(f"cast(floor(part * {PARTS} / {n}) as int)").alias("learner"), "part", "words")
    found = sorted(vocabulary.groupBy("learner").applyInArrow(learn, "learner int, n long, weights array<double>, seen array<double>").collect(), key=lambda r: r["learner"])
    weights, seen = fresh.weights, fresh.map
    if kinds:
        weights = np.average([r["weights"] for r in found], axis=0, weights=[r["n"] for r in found]).reshape(weights.shape)
        seen = np.sum([r["seen"] for r in found], axis=0).reshape(seen.shape)

    def hold(batches):
        for ids, texts in blocks(batches, BLOCK_BYTES):
            yield arrow_rows(PAYLOAD, [(block_id(ids, texts), payload(ids, texts))])

    def answered(held: pa.Table, answers: pa.Table) -> Iterator[tuple[list, list[bytes], Block, tuple[np.ndarray, ...]]]:
        if not held.num_rows:
            return
        # Blocks of the same rows asked the same and were answered the same.
        got = [unpack(a) for _, a in sorted(dict(zip(answers["part"].to_pylist(), answers["answer"].to_pylist(), strict=True)).items())]
        for blob in held["texts"]:
            ids, texts = from_payload(blob.as_py())
            block = Block(texts)
            counts = tuple(np.concatenate([_from_planes(a[k]) for a in got]).view(np.int64) for k in range(3))
            if any(len(c) != len(h) for c, h in zip(counts, block.hashes(), strict=True)):
                raise RuntimeError("a block was asked for and not answered in whole")
            yield ids, texts, block, counts

    def gather(at_first: np.ndarray | None, keep: bool):
        """Of each block: the sums of a fit at some weights, and its tokens packed for :func:`assemble`."""

        def run(held: pa.Table, answers: pa.Table) -> pa.Table:
            mixer = Mixer(*tables.value)
            mixer.weights, mixer.map = weights, seen
            rows_out = []
            for ids, texts, block, counts in answered(held, answers):
                tokens, spelled = Tokens.of(block, counts, True), np.ones(len(block.words))
                # Spelling tells the bits of new words and of words that one text alone has, and more than once; any chance does for others.
                needed = counts[0] == 0
                needed[block.word[(tokens.uses[0] > 1) & (tokens.counts[0] == tokens.uses[0])]] = True
                needed = np.flatnonzero(needed)
                spelled[needed] = 10.0 ** mixer.log10(block.spelled_out(needed))
                tokens.spelled = spelled[block.word]
                ends, own = int(counts[0][np.searchsorted(block.word_hashes, END)]), np.array([not held_out(i) for i in ids])
                out = np.zeros((*NEUTRAL.shape, NEUTRAL.shape[-1] + 1))
                for at, end in tokens.slices() if at_first is not None else ():
                    if own[at:end].any():
                        out += Chances.of(tokens.part(at, end), total, ends, rates, at_first, own[at:end]).sums()
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                rows_out.append((out.ravel().tolist(), ends, pack(json.dumps(ids).encode(), sizes.tobytes(), tokens.packed()) if keep else None))
            return pa.Table.from_batches([arrow_rows(_GATHERED, rows_out)])

        return arrow_map(rows, hold, PAYLOAD_DDL).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "sums array<double>, ends long, tokens binary")

    def assemble(batches):
        for batch in batches:
            for ends, blob in zip(batch.column(0), batch.column(1), strict=True):
                ends, (ids, sizes, packed) = ends.as_py(), unpack(blob.as_py())
                ids, sizes, tokens, out = json.loads(ids), np.frombuffer(sizes, np.int64).tolist(), Tokens.unpacked(packed), []
                for at, end in tokens.slices():
                    part = tokens.part(at, end)
                    chances = Chances.of(part, total, ends, rates, first_weights)
                    base = np.log10(part.counts[0] + 1.0) - np.log10(total + kinds + 1)
                    sums = [np.add.reduceat(x, part.starts).tolist() for x in (token_logs(chances), base, (part.counts[0] > 0).astype(np.int64))]
                    for doc, length, size, score, plain, known in zip(ids[at:end], sizes[at:end], part.lengths.tolist(), *sums, strict=True):
                        out.append((doc, held_out(doc), size, known, total, plain, score, -score / np.log10(2) / (length + 1)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    types = [doc_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    answers = counted.where("answer is not null").select("part", "block", "answer")
    held: DataFrame | None = None
    if first_weights is None:
        first_weights = NEUTRAL
        for turn in range(TURNS):
            found = materialize(gather(first_weights, turn == 0), "gathered")
            held = found if turn == 0 else held
            sums = np.zeros(NEUTRAL.size * (NEUTRAL.shape[-1] + 1))
            for r in found.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
                sums[r["i"]] = r["x"]
            first_weights = stepped(first_weights, sums.reshape(*NEUTRAL.shape, -1))
    if held is None:
        held = materialize(gather(None, True), "gathered")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return arrow_map(held.select("ends", "tokens"), assemble, schema)
