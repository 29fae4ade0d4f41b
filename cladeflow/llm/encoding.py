"""Encoding of texts by a public tokenizer file, each distinct word once per Python worker.

Both vocabularies merge inside pre-tokens only, so a text may be cut at any place that is surely a
pre-token boundary and the pieces encoded apart: before a space or line feed between other characters,
after such a line feed, and before a full stop or comma that ends a word after an ASCII letter or digit.
What has been encoded is kept, up to a bound, for the worker's later tasks, found by a 64-bit hash and compared byte by
byte: a piece whose hash another one has is encoded by itself. Texts with white space beyond single spaces and line feeds are encoded whole where white
space counts.
"""

from __future__ import annotations

import os
import re

import numpy as np

from . import kernels as K

HELD = 1_000_000  # pieces that a worker keeps
HELD_BYTES = 64 << 20  # of their text
TOGETHER = 2000  # new pieces encoded by one call

_encoders: dict[tuple[str, str], Encoder] = {}
_CLASS = bytes(120 if b < 32 and b != 10 or b == 127 else 32 if b in (10, 32) else 121 if b in (0xC2, 0xE1, 0xE2, 0xE3) else 97 for b in range(256))
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
BARE, SPACED, NEW_LINE = 0, 1, 2  # what goes before a piece


def encoder(path: str, kind: str) -> Encoder:
    """kind "bytes": a byte-level file that keeps white space; "words": one that drops it and lower-cases."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


class Memory:
    """Ids and bytes of pieces, found by the piece's hash."""

    def __init__(self):
        self.keys, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")
        self.text, self.begin, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, -1 where it isn't held."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, ids: np.ndarray, length: np.ndarray, text: np.ndarray, size: np.ndarray) -> None:
        """New keys, ascending, their ids one after the other, and their bytes."""
        if len(self.keys) + len(keys) > HELD or len(self.text) + len(text) > HELD_BYTES:
            self.__init__()
        at = np.searchsorted(self.keys, keys)
        start, begin = len(self.ids) + np.cumsum(length) - length, len(self.text) + np.cumsum(size) - size
        mine = (self.keys, keys), (self.start, start), (self.length, length), (self.begin, begin), (self.size, size)
        self.keys, self.start, self.length, self.begin, self.size = (np.insert(a, at, b) for a, b in mine)
        self.ids, self.text = np.concatenate([self.ids, ids]), np.concatenate([self.text, text])

    def same(self, place: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the pieces at `start` have the bytes of those held in each place."""
        out = self.size[place] == size
        some = np.flatnonzero(out)
        mine, theirs, at, left = K.lanes(self.text), K.lanes(flat), 0, size[some]
        while len(some):
            x = mine[self.begin[place[some]] + at] ^ theirs[start[some] + at]
            equal = (x & K._KEEP[np.minimum(left, 8)]) == 0
            out[some[~equal]] = False
            on = equal & (left > 8)
            some, left, at = some[on], left[on] - 8, at + 8
        return out


class Encoder:
    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = kind
        self.mark = b"\n" if kind == "bytes" else b"\x01"
        self.mark_id = int(self._ids(self.mark)[0])
        self.memory = Memory()

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.model.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")

    def _new(self, pieces: list[bytes], lead: bytes) -> list[np.ndarray]:
        """Ids of each piece with the lead before it; marks between pieces tell where each ends."""
        out: list[np.ndarray] = []
        between = self.mark + lead if self.kind == "bytes" else b" " + self.mark + b" "
        for i in range(0, len(pieces), TOGETHER):
            part = pieces[i : i + TOGETHER]
            if self.kind == "words" and any(self.mark in p for p in part):
                out += [self._ids(p) for p in part]
                continue
            ids = self._ids(lead + between.join(part))
            cut = np.flatnonzero(ids == self.mark_id)
            begin, end = np.r_[0, cut + 1], np.r_[cut, len(ids)]
            out += [ids[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        return out

    def _learn(self, keys: np.ndarray, flat: bytes, start: np.ndarray, end: np.ndarray, lead: np.ndarray) -> None:
        """Hold the ids of new pieces."""
        made: list = [None] * len(keys)
        for spaced in (False, True):
            which = np.flatnonzero((lead == SPACED) == spaced)
            found = self._new([flat[a:b] for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)], b" " if spaced else b"")
            for i, ids in zip(which.tolist(), found, strict=True):
                made[i] = ids
        for i in np.flatnonzero(lead == NEW_LINE).tolist():
            made[i] = np.r_[np.uint32(self.mark_id), made[i]]
        text = np.frombuffer(flat, np.uint8)[K.ranges(start, end - start)]
        self.memory.add(keys, np.concatenate(made).astype("<u4"), np.array([len(m) for m in made], np.int64), text, end - start)

    def _plain(self, text: bytes) -> bool:
        """Only single spaces and line feeds, between other characters."""
        seen = text.translate(_CLASS)
        return bool(seen) and b"x" not in seen and b"  " not in seen and seen[0] != 32 and seen[-1] != 32 and not (b"y" in seen and _WIDE_SPACE.search(text))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if self.kind == "words":
            return self._pieces(texts)
        plain = [self._plain(t) for t in texts]
        found = iter(self._pieces([t for t, p in zip(texts, plain, strict=True) if p]))
        return [next(found) if p else self._ids(t).tobytes() for t, p in zip(texts, plain, strict=True)]

    def _pieces(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        flat, begins = K.join_texts(texts, lower=self.kind == "words")
        start, end, _ = K.words(flat, begins)
        point = (end - start > 1) & ((flat[end - 1] == 46) | (flat[end - 1] == 44))
        point[point] = _ALNUM[flat[end[point] - 2]]
        at = np.flatnonzero(point) + 1
        cut = end[point] - 1
        end = end.copy()
        end[point] = cut
        start, end = np.insert(start, at, cut), np.insert(end, at, cut + 1)
        lead = np.zeros(len(start), np.int64)
        if self.kind == "bytes":
            before = flat[start - 1]
            lead = np.where(before == 32, SPACED, np.where(before == 10, NEW_LINE, BARE))
            lead[np.searchsorted(start, begins[:-1])] = BARE
        codes = K.stretches(flat, start, end)
        keys, first, inverse = np.unique(K.mix(codes + lead.astype(np.uint64)), return_index=True, return_inverse=True)
        place = self.memory.find(keys)
        if (place < 0).any():
            raw = flat.tobytes()
            new = np.flatnonzero(place < 0)
            kept = len(self.memory.keys)
            self._learn(keys[new], raw, start[first[new]], end[first[new]], lead[first[new]])
            if len(self.memory.keys) != kept + len(new):  # it was emptied first
                again = np.flatnonzero(self.memory.find(keys) < 0)
                self._learn(keys[again], raw, start[first[again]], end[first[again]], lead[first[again]])
            place = self.memory.find(keys)
        m, place = self.memory, place[inverse]
        length, source, where = m.length[place], m.ids, m.start[place]
        other = np.flatnonzero(~m.same(place, flat, start, end - start))
        if len(other):  # pieces whose hash another one has
            made = [np.r_[np.uint32(self.mark_id), self._ids(p)] if k == NEW_LINE else self._ids(b" " + p if k == SPACED else p) for k, p in zip(lead[other].tolist(), (flat[a:b].tobytes() for a, b in zip(start[other], end[other], strict=True)), strict=True)]
            length[other] = [len(x) for x in made]
            where[other] = len(source) + np.cumsum(length[other]) - length[other]
            source = np.concatenate([source, *made])
        ids = source[K.ranges(where, length)]
        upto = np.r_[0, np.cumsum(length)][np.searchsorted(start, begins)]
        return [ids[a:b].tobytes() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
