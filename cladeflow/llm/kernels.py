"""Numpy kernels that run inside Spark tasks: words, hashes of stretches and content-chosen runs of windows.

Hashes mix 8 bytes (or one code) at a time through `mix`, so that each step scrambles all that came before it; no
sums of powers are used, whose collisions follow from patterns in a text. A word is a maximal run of bytes
other than space and the control characters 9 to 13.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 1024  # bytes of a stretch beyond which it is hashed by itself

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit of x moves about half of all bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A code for a followed by b."""
    return mix(a * _ODD + mix(b + _STEP))


def lanes(flat: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number; the last ones run over into zeros."""
    padded = np.zeros(len(flat) + 8, np.uint8)
    padded[: len(flat)] = flat
    return np.ndarray((len(flat) + 1,), "<u8", padded, strides=(1,))


def stretches(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit code for the bytes of each stretch [start, end)."""
    size = end - start
    code, lane = mix(size.astype(np.uint64) + _STEP), lanes(flat)
    todo, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(todo):
        left = size[todo] - at
        code[todo] = mix(code[todo] + (lane[start[todo] + at] & _KEEP[np.minimum(left, 8)]) * _ODD)
        todo, at = todo[left > 8], at + 8
    for i in np.flatnonzero(size > LONG).tolist():
        code[i] = int.from_bytes(hashlib.blake2b(flat[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return code


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """A code for each k codes in a row."""
    return next(grams_of(codes, (k,)))


def grams_of(codes: np.ndarray, lengths: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Codes for each so many codes in a row, for ascending lengths, from those of ever longer stretches; the last two overlap where the
    length is no power of two."""
    span, h = 1, codes
    for k in lengths:
        n = len(codes) - k + 1
        if n <= 0:
            yield np.zeros(0, np.uint64)
            continue
        while 2 * span <= k:
            h, span = pair(h[:-span], h[span:]), 2 * span
        yield h[:n] if span == k else pair(h[:n], h[k - span : k - span + n])


def byte_grams(flat: np.ndarray, k: int) -> np.ndarray:
    """A code for each k bytes in a row, 8 at a time; the last 8 overlap those before where k is no multiple."""
    n = len(flat) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    lane = lanes(flat)
    if k < 8:
        return mix((lane[:n] & _KEEP[k]) + np.uint64(k) * _STEP)
    code = mix(lane[:n] + _STEP)
    for at in (*range(8, k - 7, 8), *([k - 8] if k % 8 else [])):
        code = mix(code + lane[at : at + n] * _ODD)
    return code


def codes_at(lane: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """A code for the k bytes from each of the positions on."""
    if k < 8:
        return mix((lane[begin] & _KEEP[k]) + np.uint64(k) * _STEP)
    code = mix(lane[begin] + _STEP)
    for at in (*range(8, k - 7, 8), *([k - 8] if k % 8 else [])):
        code = mix(code + lane[begin + at] * _ODD)
    return code


def join_texts(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, a line feed after each; where each begins (and the end)."""
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
    return (LOWER[flat] if lower else flat), np.r_[0, ends]


def words(flat: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the index of each text's first word (and the end)."""
    inside = ~_SPACE[flat]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1 if len(flat) else np.zeros(0, np.int64)
    if len(flat) and inside[0]:
        edge = np.r_[0, edge]
    start, end = edge[0::2], edge[1::2]
    return start, end, np.searchsorted(start, begins)


def word_codes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code for each word of the texts, and the index of each text's first word (and the end)."""
    flat, begins = join_texts(texts, lower)
    start, end, first = words(flat, begins)
    return stretches(flat, start, end), first


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span, m = 1, x
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    n = len(x) - w + 1
    return np.minimum(m[:n], m[w - span : w - span + n])


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then the same for the next."""
    if not len(start):
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(ends[-1]) + np.repeat(start - (ends - length), length)


def window_runs(gram_codes: np.ndarray, n_units: int, first: np.ndarray, window: int, gram: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Cut the windows of each text into runs that share an anchor.

    A window's anchor is the gram of smallest code, the first of equals, in its first `prefix` units; it depends on the window's
    own units alone, so equal windows have equal anchors wherever they stand. Returns for each run
    its text, first window (a position among all units), number of windows and anchor code.
    """
    empty = np.zeros(0, np.int64)
    n = n_units - window + 1
    if n <= 0:
        return empty, empty, empty, empty.astype(np.uint64)
    keys = (gram_codes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram_codes), dtype=np.uint64)
    anchor = (sliding_min(keys, prefix - gram + 1)[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(first)
    full = size >= window
    change = np.ones(n, bool)
    np.not_equal(anchor[1:], anchor[:-1], out=change[1:])
    begin, stop = first[:-1][full], first[1:][full] - window + 1
    change[begin] = True
    change[stop[stop < n]] = True
    start = np.flatnonzero(change)
    length = np.diff(np.r_[start, n])
    # A stretch between the last window of a text and the next text holds no window.
    text = np.searchsorted(first, start, "right") - 1
    ok = start + window <= first[text + 1]
    text, start, length = text[ok], start[ok], length[ok]
    # Anchors are small codes by choice; mixed again they are even over hash space.
    return text, start, length, mix(gram_codes[anchor[start]] + np.uint64(1))


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n units lie in a stretch [start, end)."""
    steps = np.bincount(start, minlength=n + 1)[: n + 1].astype(np.int64)
    steps -= np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(steps[:n]) > 0
