"""Whole texts to ids by a ``tokenizers`` file, each distinct stretch between white space encoded once a worker."""

from __future__ import annotations

import itertools
import os

import numpy as np
import regex

#: White space by Unicode; str.split() also takes four separators that are not.
SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_GAPS = regex.compile(f"[{SPACE}]+")
_EXTRA = "\x1c\x1d\x1e\x1f"


def ragged(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches flat[start : start + count] one after another."""
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


class _Numbers(dict):
    """Numbers keys as they come and remembers the new ones."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, key):
        n = self[key] = len(self)
        self.new.append(key)
        return n


def pretoken_pattern(pattern: str):
    """The pattern with Unicode white space spelled out: this module takes four characters more as such."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


#: A worker's encoders live as long as it does, so tasks that follow find words known.
_encoders: dict[str, SpacedEncoder] = {}
#: Pieces that the library gets at once.
ROW = 1000
_LETTERS = "a-z\xdf-\xf6\xf8-\u012f\u0131-\u0148\u014a-\u017e"
#: Letters that are composed already and whose lower case is one such letter, and ASCII: here lower-casing before the library's normal form changes nothing.
_STABLE = regex.compile("[\x21-\x7e\xc0-\u012f\u0131-\u0148\u014a-\u017e]+")
# What the library takes for one piece, for lower-case stretches of such characters.
_PIECES = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


def learned_as(stretch: str) -> list[str]:
    """What the library gets for a stretch, one after another.

    Only a stretch of _STABLE characters without the beginning of a special token is lower-cased
    and parted, as the library parts it; any other goes whole and as it is.
    """
    return _PIECES.findall(stretch.lower()) if _STABLE.fullmatch(stretch) and "<|" not in stretch else [stretch]


class SpacedEncoder:
    """Encodes texts by a tokenizer that lower-cases and whose pieces never cross or hold white space.

    Each distinct stretch is learned once, and each distinct piece of one (:func:`learned_as`).  At
    most ``remembered`` stretches and a batch's more are known at a time.
    """

    def __init__(self, path: str, remembered: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._fresh()

    @classmethod
    def of(cls, path: str) -> SpacedEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _fresh(self) -> None:
        self.numbers, self.pieces = _Numbers(), _Numbers()
        self.flat, self.used = np.zeros(1 << 20, np.uint16), 0
        #: Starts and counts of the ids of each stretch, and of each piece.
        self.stretch, self.piece = np.zeros((2, 1 << 18), np.int32), np.zeros((2, 1 << 18), np.int32)

    def _append(self, found: list[list[int]], counts: np.ndarray) -> np.ndarray:
        """Puts ids at the end of the store; starts and counts of what ``counts`` parts them into."""
        total = int(counts.sum())
        while len(self.flat) < self.used + total:
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(found), np.uint16, total)
        starts = self.used + np.cumsum(counts, dtype=np.int64) - counts
        self.used += total
        return np.stack([starts, counts]).astype(np.int32)

    def _encoded(self, todo: list[str]) -> np.ndarray:
        """Starts and counts of the ids of each text.

        Those that are one piece to the library go to it in rows, a space between; a piece ends with
        the id of a token that ends a word.  A row with another number of ends goes piece by piece.
        """
        out = np.zeros((2, len(todo)), np.int32)
        alone = np.fromiter((_PIECES.fullmatch(p) is None or "<|" in p for p in todo), bool, len(todo))
        single = np.flatnonzero(~alone)
        rows = [single[at : at + ROW] for at in range(0, len(single), ROW)]
        for row, e in zip(rows, self.tokenizer.encode_batch_fast([" ".join(map(todo.__getitem__, row.tolist())) for row in rows], add_special_tokens=False), strict=True):
            ids = e.ids
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(row) and ends[-1] == len(ids) - 1:
                out[:, row] = self._append([ids], np.diff(ends, prepend=-1))
            else:
                alone[row] = True
        whole = np.flatnonzero(alone)
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(list(map(todo.__getitem__, whole.tolist())), add_special_tokens=False)]
        out[:, whole] = self._append(ids, np.fromiter(map(len, ids), np.int64, len(ids)))
        return out

    @staticmethod
    def _put(table: np.ndarray, places: np.ndarray, at: int) -> np.ndarray:
        while table.shape[1] < at + places.shape[1]:
            table = np.concatenate([table, np.zeros_like(table)], 1)
        table[:, at : at + places.shape[1]] = places
        return table

    def _learn(self) -> None:
        """Encodes the pieces that are new; a stretch of one piece shares its ids, others get their own."""
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        parted = [[w.lower()] if w.isascii() and w.isalpha() else learned_as(w) for w in new]
        several = [i for i, parts in enumerate(parted) if len(parts) > 1]
        number = self.pieces.__getitem__
        first = np.fromiter((number(parts[0]) for parts in parted), np.int64, len(parted))
        rest = [[number(p) for p in parted[i]] for i in several]
        todo, self.pieces.new = self.pieces.new, []
        if todo:
            self.piece = self._put(self.piece, self._encoded(todo), len(self.pieces) - len(todo))
        places = self.piece[:, first]
        if several:
            starts, counts = self.piece.tolist() if len(several) > len(self.pieces) else self.piece
            ids = [[x for p in parts for x in self.flat[starts[p] : starts[p] + counts[p]].tolist()] for parts in rest]
            places[:, several] = self._append(ids, np.fromiter(map(len, ids), np.int64, len(ids)))
        self.stretch = self._put(self.stretch, places, len(self.numbers) - len(new))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts, without added special tokens."""
        if len(self.numbers) > self.remembered:
            self._fresh()
        ats = []
        for text in texts:
            parts = [p for p in _GAPS.split(text) if p] if any(c in text for c in _EXTRA) else text.split()
            ats.append(np.fromiter(map(self.numbers.__getitem__, parts), np.int32, len(parts)))
        self._learn()
        starts, counts = self.stretch
        return [ragged(self.flat, starts[at], counts[at].astype(np.int64)) for at in ats]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]
