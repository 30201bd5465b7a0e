"""Tokenizing whole texts with a public word-level BPE, each distinct unit once.

The tokenizer of ``word_bpe_49k.json`` never joins characters across white space, nor an ASCII
letter with an ASCII digit or sign (contractions after an apostrophe aside), and it lower-cases.
So a text's ids are those of such units one after another. A task looks units up by hash and
sends only new ones to the library. Units of letters alone go straight to its BPE model, as the
library's own normalisation and splitting leave them whole. The table of known units is bounded
and starts again when it is full. Units are told apart by a 64-bit hash of their bytes: two of a
table's at most ``KNOWN`` units share one with a chance of about 7 in 10**9.
"""

from __future__ import annotations

import itertools
import os
import unicodedata

import numpy as np

from . import buffers as B
from .workers import KeyTable, kept

WORD_BPE = "word_bpe_49k.json"
KNOWN = 500_000
_KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 ASCII letter, 2 other ASCII, 3 beyond
_KIND[:128] = 2
_KIND[~B.NOT_SPACE] = 0
_KIND[65:91] = _KIND[97:123] = 1


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte: the byte's own, or one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordEncoder:
    def __init__(self, path: str, known: int = KNOWN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.characters = byte_characters()
        self.index = KeyTable(known)
        self._reset()

    def _reset(self) -> None:
        self.index.clear()
        self.ids = np.zeros(1 << 20, np.uint16)
        self.used = 0
        self.start, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def _new_ids(self, texts: list[str]) -> list[list[int]]:
        found: list = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if t.isalpha() and (t.isascii() or max(t) < "ƀ" and "İ" not in t):
                if not t.isascii():
                    t = "".join(self.characters[b] for b in unicodedata.normalize("NFC", t).lower().encode())
                found[i] = [x.id for x in self.model.tokenize(t)]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = e.ids
        return found

    def _add(self, keys: np.ndarray, texts: list[str]) -> np.ndarray:
        found = self._new_ids(texts)
        lens = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint16, int(lens.sum()))
        at = self.index.add(keys)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.index) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[at] = self.used + np.cumsum(lens) - lens
        self.size[at] = lens
        self.used += len(flat)
        return at

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> B.Words:
        words = B.Words(data, offsets, B.NOT_SPACE)
        whole = np.zeros(len(words.start), bool)
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|" may begin a special token, which has its case
        words.data = B.LOWER[data]
        for w in np.unique(np.searchsorted(words.start, special, "right") - 1):
            words.data[words.start[w] : words.end[w]] = data[words.start[w] : words.end[w]]
            whole[w] = True
        whole[np.searchsorted(words.start, np.flatnonzero(data == 39), "right") - 1] = True
        kind = _KIND[data]
        cut = np.flatnonzero(kind[:-1] + kind[1:] == 3) + 1
        cut = cut[(kind[cut] == 1) | (kind[cut] == 2)]  # a letter meets another ASCII character
        if len(cut):
            cut = cut[~whole[np.searchsorted(words.start, cut, "right") - 1] & (words.start[np.searchsorted(words.start, cut, "right") - 1] != cut)]
            words.start, words.end = np.sort(np.concatenate([words.start, cut])), np.sort(np.concatenate([words.end, cut]))
            words.first = np.searchsorted(words.start, offsets)
        return words

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and the number of ids of each row."""
        ids, size, words = self.encode_units(data, offsets)
        return ids, B.row_sums(size, words.first)

    def encode_units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, B.Words]:
        """All ids of the rows, the number of ids of each unit, and the units."""
        words = self._units(data, offsets)
        hashes = words.hashes()
        order = np.argsort(hashes)
        ordered = hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        keys, one = ordered[new], order[new]
        known = self.index.find(keys)
        if (known < 0).any():
            if len(self.index) + int((known < 0).sum()) > self.index.most:
                self._reset()
                known[:] = -1
            raw = words.data.tobytes()
            at = np.flatnonzero(known < 0)
            if len(at) > self.index.most:  # more units in one slice than the table holds: a table for this slice
                self.index = KeyTable(len(at))
            start, end = words.start[one[at]].tolist(), words.end[one[at]].tolist()
            known[at] = self._add(keys[at], [raw[a:b].decode() for a, b in zip(start, end, strict=True)])
        rows = np.empty(len(order), np.int64)
        rows[order] = known[np.cumsum(new) - 1]
        size = self.size[rows]
        return self.ids[B.ragged(self.start[rows], size)], size, words


def encoder(path: str) -> WordEncoder:
    """One for each worker process; workers live over many tasks."""
    return kept(("encoder", path), lambda: WordEncoder(path))
