"""Exact encoding with the tokenizers library, each distinct chunk of a worker's texts encoded once.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the chunks' ids joined are
the text's ids:

* ``"words"`` (lower case, white space dropped by the tokenizer): at ASCII white space;
* ``"spaced"`` (byte-level patterns that attach one leading space): before a run of white space, where
  the character before is no white space at all;
* both: between an ASCII letter and ASCII punctuation (the apostrophe aside, which starts contractions);
* both: around the literals of the tokenizer's added tokens (``<|endoftext|>``), which the library takes
  out of the text before anything else.  A literal is one chunk, never cut and never case-folded.

Chunks are told apart by 64-bit hashes.  A worker keeps the ids of about ``KEEP`` distinct chunks in
sorted arrays; beyond that it keeps those that the latest slice used, so memory is bounded.
"""

from __future__ import annotations

import itertools
import os

import numpy as np

from reachkit.llm import common as c
from reachkit.llm.repeats import ranges

KEEP = 600_000
YOUNG = 100_000  # new chunks that are kept apart before they are merged
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[i for i in range(0x21, 0x7F) if not chr(i).isalnum() and chr(i) != "'"]] = True
_CACHE: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, style: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    if (path, style) not in _CACHE:
        _CACHE[path, style] = Encoder(path, style)
    return _CACHE[path, style]


class Encoder:
    def __init__(self, path: str, style: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.style = style
        self.literals = []
        for token in self.tokenizer.get_added_tokens_decoder().values():
            if token.normalized or token.lstrip or token.rstrip or token.single_word:
                raise ValueError(f"{path}: added token {token.content!r} is not matched as plain bytes")
            self.literals.append(token.content.encode())
        self._reset()

    def _reset(self) -> None:
        # hashes in order, with the number of their chunk: the bulk, and the latest
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]
        self.ids = np.zeros(0, np.uint32)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)

    def _find(self, value: np.ndarray) -> np.ndarray:
        """Number of every chunk, -1 for unknown ones."""
        place = np.full(len(value), -1, np.int64)
        for hashes, numbers in self.known:
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
                same = hashes[at] == value
                place[same] = numbers[at[same]]
        return place

    def _shrink(self, needed: np.ndarray) -> None:
        """Keep the chunks of the present slice only."""
        place = self._find(needed)
        held = place >= 0
        place, size = place[held], self.size[place[held]]
        self.ids = self.ids[ranges(self.begin[place], size.astype(np.int64))]
        self.size, self.begin = size, np.cumsum(size, dtype=np.int64) - size
        self.known = [(needed[held], np.arange(len(place), dtype=np.int32)), self.known[1]]
        self.known[1] = (np.zeros(0, np.uint64), np.zeros(0, np.int32))

    @staticmethod
    def _merged(one, two):
        hashes, numbers = (np.concatenate(x) for x in zip(one, two, strict=True))
        order = np.argsort(hashes)
        return hashes[order], numbers[order]

    def special(self, buf, start, end):
        """(first byte, byte after the last) of the added tokens' literals inside the rows: the leftmost
        ones, of those the longest."""
        raw, found = buf.tobytes(), []
        for literal in self.literals:
            at = raw.find(literal)
            while at >= 0:
                row = int(np.searchsorted(start, at, "right")) - 1
                if at + len(literal) <= end[row]:  # not over the edge of two rows
                    found.append((at, -len(literal)))
                at = raw.find(literal, at + 1)
        begin, stop = [], []
        for at, size in sorted(found):
            if not stop or at >= stop[-1]:
                begin.append(at)
                stop.append(at - size)
        return np.array(begin, np.int64), np.array(stop, np.int64)

    def chunks(self, buf, start, end, begin, stop):
        """(first byte, byte after the last, row) of every chunk; literals lie at ``begin`` to ``stop``."""
        n = len(buf)
        if n == 0:
            return (np.zeros(0, np.int64),) * 3
        letter, mark = _LETTER[buf], _PUNCTUATION[buf]
        inner = np.zeros(n, bool)
        inner[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        inner[ranges(begin, stop - begin)] = False
        inner[begin] = True
        inner[stop[stop < n]] = True
        if self.style == "words":
            return c.words(buf, start, end, cut=inner)
        space = c.SPACE[buf]
        cut = np.zeros(n + 1, bool)
        # a chunk starts at white space behind a character that is none
        cut[1:n] = space[1:] & ~space[:-1]
        two = np.flatnonzero((buf[1:] == 0x85) | (buf[1:] == 0xA0)) + 1
        cut[two[buf[two - 1] == 0xC2] + 1] = False  # U+0085, U+00A0
        lead = np.flatnonzero((buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3))
        cut[np.minimum(lead + 3, n)] = False  # the blocks that hold the other white space: no cut behind
        some = start < end
        cut[start[some]] = True
        cut = cut[:n] | inner
        first = np.flatnonzero(cut)
        last = np.append(first[1:], n)
        return first, last, np.searchsorted(start, first, "right") - 1

    def __call__(self, buf, start, end):
        """(ids of all rows in order, number of ids of every row)."""
        begin, stop = self.special(buf, start, end)
        if self.style == "words":
            literal = ranges(begin, stop - begin)
            raw, buf = buf, c.LOWER[buf]  # the tokenizer does so too: fewer distinct chunks
            buf[literal] = raw[literal]
        first, last, row = self.chunks(buf, start, end, begin, stop)
        if len(first) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(start), np.int64)
        value, at, which = np.unique(c.word_hashes(buf, first, last), return_index=True, return_inverse=True)
        if len(self.size) > KEEP:
            self._shrink(value)
        place = self._find(value)
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = buf.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(first[at[new]].tolist(), last[at[new]].tolist(), strict=True)]
            coded = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            size = np.fromiter(map(len, coded), np.int32, len(coded))
            flat = np.fromiter(itertools.chain.from_iterable(coded), np.uint32, int(size.sum()))
            place[new] = np.arange(len(self.size), len(self.size) + len(size))
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size, dtype=np.int64) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, flat])
            self.known[1] = self._merged(self.known[1], (value[new], place[new].astype(np.int32)))
            if len(self.known[1][0]) > YOUNG:
                self.known = [self._merged(*self.known), (np.zeros(0, np.uint64), np.zeros(0, np.int32))]
        chunk = place[which]
        size = self.size[chunk].astype(np.int64)
        out = self.ids[ranges(self.begin[chunk], size)]
        return out, np.bincount(row, weights=size, minlength=len(start)).astype(np.int64)
