"""Quality classifier from weak labels: heuristics vote, EM weighs them, a hashed linear scorer generalises.

1. Every document gets the votes of overlapping heuristic labellers (good, bad, abstain).
   The number of vote patterns has a fixed bound, so their counts over the whole corpus are small.
2. Expectation-maximisation over those counts estimates each labeller's accuracy and the
   probability that a document with a pattern is good (Dawid-Skene).
3. On a sample of at most SAMPLE documents, posterior labels train a logistic scorer of hashed
   features: character-class trigrams, words and bucketed ratios.
4. The scorer reads every whole document.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.quality_rules import STOP_WORDS
from paperloom.llm.shared import arrow_map, blocks, utf8
from paperloom.llm.words import mixed, word_hashes

#: Documents that train the scorer, at most.
SAMPLE = 4000
#: Words without which a labeller has too little to go by and abstains.
VOTING = 10
#: Places of hashed trigrams and words, of twelve steps for each labeller's ratio, and of the length in powers of two.
TRIGRAMS, WORDS, RATIOS, LENGTHS = 4096, 4096, 108, 12
_CLASS = np.full(256, 13, np.uint8)
for _k, _chars in enumerate((" \t\r\x0b\f", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",;:", "!", "?", "'\"-", "|", "#*$%&<>", "()[]{}")):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 15, 14
SIZE = TRIGRAMS + WORDS + RATIOS + LENGTHS + 1
LABELLERS = ("symbols", "bars", "exclamations", "capitals", "repeats", "stop words", "variety", "pairs", "word length")


def _classes(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    c = _CLASS[data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))
    c[upper] = 3
    return c


def _stop_hashes() -> np.ndarray:
    return np.unique(word_hashes([w.encode() for w in STOP_WORDS])[0])


def ratios(classes: np.ndarray, words: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """What the labellers look at, of a text with words."""
    n = len(words)
    by = np.bincount(classes, minlength=16)
    letters = max(1, by[2] + by[3] + by[14])
    at = np.minimum(np.searchsorted(stop, words), len(stop) - 1)
    return np.array([
        by[11] / n, by[10] / n, by[7] / n, by[3] / letters, (words[1:] == words[:-1]).sum() / n,
        (stop[at] == words).sum() / n, len(np.unique(words)) / n**0.5, len(np.unique(words[1:] ^ (words[:-1] << np.uint64(1)))) / n, (len(classes) - by[0] - by[1] - by[15]) / n,
    ])


# (bad when above, good when below) or, with a leading minus, (bad when below, good when above).
_CUTS = ((0.15, 0.01), (0.2, 0.01), (0.3, 0.02), (0.5, 0.15), (0.3, 0.03), (-0.02, -0.08), (-1.0, -3.0), (-0.4, -0.6), (12.0, 8.0))


def votes(r: np.ndarray, n_words: int) -> str:
    """One character a labeller: g(ood), b(ad) or - (abstains, as all do under VOTING words)."""
    out = []
    for (bad, good), x in zip(_CUTS, r, strict=True):
        x, bad, good = (-x, bad, good) if bad < 0 else (x, bad, good)
        out.append("b" if x > bad else "g" if x < good else "-")
    return "".join(out) if n_words >= VOTING else "-" * len(out)


def estimate(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """(probability of good by pattern, P(vote | class, not abstaining) as [labeller, class, bad or good])."""
    keys = list(patterns)
    n = np.array([patterns[k] for k in keys], float)
    onehot = np.array([[[v == c for c in "bg"] for v in k] for k in keys], float)
    good = np.array([(k.count("g") + 1) / (k.count("g") + 6 * k.count("b") + 2) for k in keys])
    table = np.zeros((len(LABELLERS), 2, 2))
    for _ in range(rounds):
        share = np.stack([1 - good, good])
        for c in (0, 1):
            seen = np.einsum("p,plv->lv", n * share[c], onehot) + 1
            table[:, c] = seen / seen.sum(1, keepdims=True)
        prior = (n * share).sum(1) + 1
        score = np.log(prior / prior.sum())[:, None] + np.einsum("plv,lcv->cp", onehot, np.log(table))
        now = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    return dict(zip(keys, good.tolist(), strict=True)), table


def features(text: bytes, words: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse hashed features of one text with words: places and values."""
    c = _classes(text).astype(np.int32)
    tri = np.bincount(c[:-2] * 256 + c[1:-1] * 16 + c[2:], minlength=TRIGRAMS) if len(c) > 2 else np.zeros(TRIGRAMS)
    tf = np.bincount((words % np.uint64(WORDS)).astype(np.int64), minlength=WORDS)
    a, b = np.flatnonzero(tri), np.flatnonzero(tf)
    r = ratios(c, words, stop)
    scale = np.array([10, 10, 5, 10, 10, 10, 1, 10, 1])
    place = np.minimum((r * scale).astype(np.int64), 11) + 12 * np.arange(9)
    values = np.r_[np.sqrt(tri[a] / max(1, tri.sum())), tf[b] / len(words), np.ones(10)]
    length = TRIGRAMS + WORDS + RATIOS + min(len(words).bit_length() - 1, LENGTHS - 1)
    return np.r_[a, TRIGRAMS + b, TRIGRAMS + WORDS + place, length], values


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, steps: int = 150, rate: float = 0.05, shrink: float = 1e-4) -> np.ndarray:
    """Logistic weights (the bias last) by full-batch Adam on soft labels."""
    size = SIZE
    starts = np.cumsum([0, *(len(p) + 1 for p, _ in rows)])[:-1]
    place = np.concatenate([np.r_[p, size - 1] for p, _ in rows]).astype(np.int32)
    value = np.concatenate([np.r_[v, 1.0] for _, v in rows]).astype(np.float32)
    owner = np.repeat(np.arange(len(rows)), np.diff(np.r_[starts, len(place)]))
    w, m, s = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        z = np.add.reduceat(w[place] * value, starts)
        off = 1 / (1 + np.exp(-z)) - target
        g = np.bincount(place, weights=value * off[owner], minlength=size) / len(rows) + shrink * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


def _per_text(batches: Iterator[pa.RecordBatch]):
    for ids, texts in blocks(batches):
        hashes, offsets = word_hashes(texts)
        yield ids, texts, [hashes[a:b] for a, b in itertools.pairwise(offsets.tolist())]


def vote_table(docs: DataFrame) -> DataFrame:
    """(doc_id, votes) of every row; a text under VOTING words has only abstentions."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        stop = _stop_hashes()
        for ids, texts, words in _per_text(batches):
            found = [votes(ratios(_classes(t), w, stop), len(w)) if len(w) else "-" * len(LABELLERS) for t, w in zip(texts, words, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, _arrow(kind)), pa.array(found, pa.string())], names=["doc_id", "votes"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind.simpleString()}, votes string")


def _arrow(kind) -> pa.DataType:
    return {"int": pa.int32(), "string": pa.string()}.get(kind.simpleString(), pa.int64())


def fit(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The scorer's weights.  Votes are counted over all documents; ``sample`` bounds only the scorer's training rows."""
    counts = {r["votes"]: r["count"] for r in vote_table(docs).groupBy("votes").count().collect()}
    total = sum(counts.values())
    if not total:
        return np.zeros(SIZE)
    posterior, _ = estimate(counts)
    chosen = docs.select("doc_id", "text").where(F.expr(f"pmod(xxhash64(doc_id, text), 1000003) < {1000003 * min(1.0, 0.9 * sample / total)}"))

    def rows(batches):
        stop = _stop_hashes()
        schema = pa.schema([("place", pa.binary()), ("value", pa.binary()), ("good", pa.float64())])
        for _, texts, words in _per_text(batches):
            out = []
            for t, w in zip(texts, words, strict=True):
                if len(w):
                    p, v = features(t, w, stop)
                    out.append((p.astype(np.uint16).tobytes(), v.astype(np.float32).tobytes(), posterior.get(votes(ratios(_classes(t), w, stop), len(w)), 0.5)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * 3, schema, strict=True)], schema=schema)

    def learn(table: pa.Table) -> pa.Table:
        sparse = [(np.frombuffer(p, np.uint16), np.frombuffer(v, np.float32)) for p, v in zip(table["place"].to_pylist(), table["value"].to_pylist(), strict=True)]
        return pa.table({"w": pa.array([train(sparse, np.array(table["good"].to_pylist())).tobytes()], pa.binary())})

    learned = arrow_map(chosen, rows, "place binary, value binary, good double").limit(sample).groupBy(F.lit(1).alias("all")).applyInArrow(lambda t: learn(t.select(["place", "value", "good"])), "w binary").collect()
    return np.frombuffer(learned[0]["w"]) if learned else np.zeros(SIZE)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, quality, kept) of every row: the probability of good, and whether it is 1/2 or more."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        stop = _stop_hashes()
        for ids, texts, words in _per_text(batches):
            out = []
            for t, w in zip(texts, words, strict=True):
                if len(w):
                    p, v = features(t, w, stop)
                    out.append(float(1 / (1 + np.exp(-np.clip(weights[p] @ v + weights[-1], -500, 500)))))
                else:
                    out.append(0.0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, _arrow(kind)), pa.array(out, pa.float64()), pa.array([x >= 0.5 for x in out], pa.bool_())], names=["doc_id", "quality", "kept"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind.simpleString()}, quality double, kept boolean")


def quality_classifier(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality, kept) of every row of ``docs``, by a scorer fitted on ``docs`` itself.

    A null or wordless text has quality 0 and is not kept.  Repeated rows and null doc_ids keep
    their rows; extra columns are not read; an empty table gives an empty one.
    """
    return score(docs, fit(docs, sample))


def kept_by_classifier(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns, in one more pass."""
    weights = fit(docs, sample)
    at = docs.columns.index("text")

    def run(batches):
        stop = _stop_hashes()
        for batch in batches:
            texts = utf8(batch.column(at))
            hashes, offsets = word_hashes(texts)
            keep = []
            for t, (a, b) in zip(texts, itertools.pairwise(offsets.tolist()), strict=True):
                w = hashes[a:b]
                if len(w):
                    p, v = features(t, w, stop)
                    keep.append(bool(weights[p] @ v + weights[-1] >= 0))
                else:
                    keep.append(False)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return arrow_map(docs, run, docs.schema)
