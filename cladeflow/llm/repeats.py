"""Passages of one document that an earlier document has too, over words or bytes.

Whole copies of a document's text go first, told by a fingerprint of 128 bits. What is left is cut into stretches that share an anchor,
the gram of smallest code in a window's first units. Equal windows have equal anchors wherever they stand, so all suffixes that share a
window's length are sent to one part, and neighbours in a text, which mostly share their anchor, travel together as one stretch.
Stretches of a crowded anchor are taken apart and travel by their whole windows.

One question between blocks (see `blocks`) counts each anchor's stretches. Those of an anchor that no other document has can't be
repeated and stay where they are; that leaves out, and decides no removal. The others are sent as they are, words or
bytes. A part takes every suffix of its stretches, each up to its stretch's end: `SuffixTrees` splits them by prefixes of words that lengthen
until a group fits memory, and reads maximal repeats off each subtree's deep internal nodes; `PreviousFactors` puts them
in suffix order and reads the longest earlier match of each off its previous and next smaller positions. Removed passages are
as long as those matches. A document's rank is its block's, then its id's. Documents without an id neither lose text nor make
others lose it; documents that share an id do not remove each other's text. A text longer than a chunk is
taken in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from . import blocks as B
from . import kernels as K

COPY = np.dtype([("key", "<u8"), ("more", "<u8")])
ANCHOR = np.dtype([("key", "<u8"), ("runs", "<u4"), ("here", "u1")])
UNIQUE, SHARED, CROWDED = 0, 1, 2
LONG_WORD = 64  # bytes beyond which a word travels as its 256-bit digest


class Plan:
    """Units, window, length of the prefixes that groups are made by, and of their anchors."""

    def __init__(self, unit: str, window: int, prefix: int, gram: int, crowd: int):
        self.unit, self.window, self.prefix, self.gram, self.crowd = unit, window, prefix, gram, crowd
        if prefix - gram + 1 > 64:
            raise ValueError("a run's windows must fit a mask of 64 bits")

    def chunks(self, block: B.Block, use: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """Documents, numbers of the first unit, and pieces of their texts, of about a chunk together."""
        docs, offsets, texts, size = [], [], [], 0
        for i in np.flatnonzero(use).tolist():
            for offset, piece in B.pieces(B.expand(block.packed[i]), self.unit, self.window - 1):
                if texts and size + len(piece) > B.CHUNK_BYTES:
                    yield np.array(docs), np.array(offsets), texts
                    docs, offsets, texts, size = [], [], [], 0
                docs.append(i)
                offsets.append(offset)
                texts.append(piece)
                size += len(piece)
        if texts:
            yield np.array(docs), np.array(offsets), texts

    def codes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word codes, or bytes, of all texts, and where each text's begin (and the end)."""
        if self.unit == "word":
            return K.word_codes(texts)
        return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]

    def grams(self, codes: np.ndarray, k: int) -> np.ndarray:
        return K.grams(codes, k) if self.unit == "word" else K.byte_grams(codes, k)


class Copies:
    """Documents whose text a document with a smaller id has, whole."""

    def __init__(self, block: B.Block):
        self.doc = np.array([i for i in range(block.known) if block.packed[i]], np.int64)
        prints = b"".join(hashlib.blake2b(B.expand(block.packed[i]), digest_size=16).digest() for i in self.doc)
        mark = np.frombuffer(prints, COPY)
        order = np.lexsort((block.ids[self.doc], mark["more"], mark["key"]))
        new = B.first_of_runs(mark["key"][order], mark["more"][order])
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        self.keys, self.first_id = mark[order[new]], block.ids[self.doc[order[new]]]

    def split(self, block: B.Block, got: dict) -> tuple[np.ndarray, np.ndarray]:
        """Which documents are copies, and which others have text."""
        later = np.frombuffer(got.get("copies", b""), np.uint8) == 1
        copy, use = np.zeros(block.known, bool), np.zeros(block.known, bool)
        copy[self.doc] = (block.ids[self.doc] > self.first_id[self.kind]) | later[self.kind]
        use[self.doc] = ~copy[self.doc]
        return copy, use


def _later_copies(held: list) -> list[np.ndarray]:
    keys, rank = B.stacked(held)
    order = np.lexsort((rank, keys["more"], keys["key"]))
    out = np.empty(len(order), np.uint8)
    out[order] = ~B.first_of_runs(keys["key"][order], keys["more"][order])
    return B.unstack(out, held)


class Runs:
    """All runs of a block's documents, piece by piece, and the distinct anchors among them."""

    def __init__(self, block: B.Block, plan: Plan, use: np.ndarray):
        found = []
        for c, (docs, offsets, texts) in enumerate(plan.chunks(block, use)):
            codes, first = plan.codes(texts)
            text, start, length, anchor = K.window_runs(plan.grams(codes, plan.gram), len(codes), first, plan.window, plan.gram, plan.prefix)
            found.append((np.full(len(text), c), docs[text], start, start - first[text] + offsets[text], length, anchor & np.uint64(0xFFFFFFFFFFFF0000)))
        z = np.zeros(0, np.int64)
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [z, z, z, z, z, z.astype(np.uint64)]
        self.chunk, self.doc, self.local, self.start, self.length, self.anchor = cols
        self.id = block.ids[self.doc]
        found, self.kind, runs = np.unique(self.anchor, return_inverse=True, return_counts=True)
        self.keys = np.empty(len(found), ANCHOR)
        self.keys["key"], self.keys["runs"], self.keys["here"] = found, runs, differ(self.kind, self.id, len(found))

    def status(self, got: dict) -> np.ndarray:
        return np.frombuffer(got.get("anchors", b""), np.uint8)[self.kind]


def differ(kind: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Which of n kinds have more than one value."""
    least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, kind, value)
    np.maximum.at(most, kind, value)
    return most > least


def _shared_anchors(crowd: int):
    def answer(held: list) -> list[np.ndarray]:
        keys, _ = B.stacked(held)
        _, inverse, blocks = np.unique(keys["key"], return_inverse=True, return_counts=True)
        runs = np.bincount(inverse, keys["runs"])[inverse]
        return B.unstack(np.where((blocks[inverse] < 2) & (keys["here"] == 0), UNIQUE, np.where(runs > crowd, CROWDED, SHARED)).astype(np.uint8), held)

    return answer


class Kinds:
    """Distinct contents in a block in order of first appearance, and the id of each one's first document."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.first: list[int] = []
        self.route: list[int] = []
        self.which: list[int] = []  # the kind of every content that was added

    def add(self, text: bytes, begin: np.ndarray, end: np.ndarray, ids: np.ndarray, route: np.ndarray) -> None:
        """Contents of stretches of a text, in documents of these ids, and where they are to be sent."""
        at, first = self.at, self.first
        for a, b, i, r in zip(begin.tolist(), end.tolist(), ids.tolist(), route.tolist(), strict=True):
            content = text[a:b]
            k = at.get(content)
            if k is None:
                k = at[content] = len(first)
                first.append(i)
                self.route.append(r)
            self.which.append(k)

    def order(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Parts of the kinds, ascending, and the kinds in that order."""
        part = B.part_of(np.array(self.route, np.uint64), parts)
        order = np.argsort(part, kind="stable")
        return part[order], order

    def packed(self, parts: int) -> Iterator[tuple[int, bytes]]:
        """For each part: the contents with their documents' ranks, in order of appearance."""
        part, order = self.order(parts)
        contents, head = list(self.at), np.empty(len(order), HEAD)
        head["doc"] = np.unique(np.array(self.first, np.int64), return_inverse=True)[1]
        head["size"] = np.fromiter(map(len, contents), np.uint32, len(contents))
        head = head[order]
        for lo, hi in zip(*_cuts(part), strict=True):
            yield int(part[lo]), B.squeeze(np.array([hi - lo], "<u4").tobytes() + B.in_planes(head[lo:hi]) + b"".join([contents[k] for k in order[lo:hi].tolist()]))

    def answered(self, parts: int, raw: bytes, dtype) -> np.ndarray:
        """Each kind's answer, of answers in the order of `packed`."""
        out = np.zeros(len(self.first), dtype)
        out[self.order(parts)[1]] = np.frombuffer(raw, dtype)
        return out


def _cuts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of equal keys."""
    at = np.flatnonzero(B.first_of_runs(*keys))
    return at, np.r_[at[1:], len(keys[0])][: len(at)]


HEAD = np.dtype([("doc", "<u4"), ("size", "<u4")])


class Leaves:
    """The contents that all blocks sent to a part, each once, for the earliest document that has it."""

    def __init__(self, held: list[tuple[int, bytes]]):
        heads, message, flat = [], [], bytearray()
        for m, (_, raw) in enumerate(held):
            raw = B.expand(raw)
            n = int(np.frombuffer(raw, "<u4", 1)[0])
            heads.append(B.out_of_planes(raw[4 : 4 + n * HEAD.itemsize], HEAD))
            flat += memoryview(raw)[4 + n * HEAD.itemsize :]
            message.append(np.full(n, m))
        self.counts = [len(h) for h in heads]
        head, message, self.flat = np.concatenate(heads), np.concatenate(message), bytes(flat)
        size = head["size"].astype(np.int64)
        begin = np.cumsum(size) - size
        at: dict[bytes, int] = {}
        self.kind = np.fromiter((at.setdefault(self.flat[a : a + n], len(at)) for a, n in zip(begin.tolist(), size.tolist(), strict=True)), np.int64, len(head))
        # Messages come by rank, and a message has a content once, so the first that has it is the earliest.
        self.earliest = np.full(len(at), len(head))
        np.minimum.at(self.earliest, self.kind, np.arange(len(head)))
        self.begin, self.size = begin[self.earliest], size[self.earliest]
        self.rank = ((message << 32) | head["doc"])[self.earliest]

    def answers(self, masks: np.ndarray, windows: np.ndarray) -> list[tuple[int, bytes, int]]:
        """For each message the windows that go: those in masks for a content's earliest document, all of them for others."""
        out = np.empty(len(self.kind), Resolver.MASKS)
        every = (~np.uint64(0) >> (64 - windows).astype(np.uint64))[self.kind]
        out["first"] = out["rest"] = every
        out["first"][self.earliest] = masks
        return [(0, B.squeeze(a.tobytes()), 0) for a in np.split(out, np.cumsum(self.counts)[:-1])]


def windows_of(content: np.ndarray, by: np.ndarray, length: np.ndarray, window: int, n: int) -> np.ndarray:
    """For each of n contents, a mask of the windows that lie in matches of a length from a place of it on."""
    masks, hit = np.zeros(n, np.uint64), np.flatnonzero(length >= window)
    reach = (~np.uint64(0) >> (63 - (length[hit] - window)).astype(np.uint64)) << by[hit].astype(np.uint64)
    np.bitwise_or.at(masks, content[hit], reach)
    return masks


class Resolver:
    """Sends runs of suffixes that may be repeated to parts, and reads which of their windows go."""

    MASKS = np.dtype([("first", "<u8"), ("rest", "<u8")])  # of a run's windows, for a block's first document that has it, and its others

    def __init__(self, plan: Plan):
        self.plan = plan

    def contents(self, block: B.Block, got: dict) -> tuple[Kinds, Runs, np.ndarray, np.ndarray]:
        """Distinct contents of runs that may be repeated; the run and first window of every one."""
        _, use = Copies(block).split(block, got)
        runs, window = Runs(block, self.plan, use), self.plan.window
        status = runs.status(got)
        whole, single = np.flatnonzero(status == SHARED), np.flatnonzero(status == CROWDED)
        run = np.r_[whole, np.repeat(single, runs.length[single])]
        at = np.r_[np.zeros(len(whole), np.int64), K.ranges(np.zeros(len(single), np.int64), runs.length[single])]
        length = np.r_[runs.length[whole], np.ones(len(run) - len(whole), np.int64)]
        order = np.argsort(run, kind="stable")
        run, at, length = run[order], at[order], length[order]
        kinds = Kinds()
        for c, (_, _, texts) in enumerate(self.plan.chunks(block, use)) if len(run) else ():
            lo, hi = np.searchsorted(runs.chunk[run], [c, c + 1])
            if hi > lo:
                begin, route = runs.local[run[lo:hi]] + at[lo:hi], runs.anchor[run[lo:hi]].copy()
                crowded = status[run[lo:hi]] == CROWDED
                if crowded.any():
                    route[crowded] = K.mix(self.plan.grams(self.plan.codes(texts)[0], window)[begin[crowded]])
                end = begin + length[lo:hi] + window - 1
                if self.plan.unit == "word":
                    text, place = spaced_words(b"\n".join(texts))
                    begin, end = place[begin], place[end]
                else:
                    text = b"".join(texts)
                kinds.add(text, begin, end, runs.id[run[lo:hi]], route)
        return kinds, runs, run, at

    def find(self, corpus: B.Corpus, kind: str = "masks") -> tuple[B.Corpus, int]:
        def contents(block, got, n):
            yield from self.contents(block, got)[0].packed(n)

        parts = corpus.parts(corpus.hits() * 10 * self.plan.window)  # what a part holds of a stretch, with its suffixes
        return corpus.ask(kind, parts, contents, self.answer), parts

    def gone(self, block: B.Block, got: dict, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which documents are whole copies; document and first unit of the other windows that go."""
        kinds, runs, run, at = self.contents(block, got)
        told, which = kinds.answered(parts, got.get("masks", b""), self.MASKS), np.array(kinds.which, np.int64)
        first = runs.id[run] == np.array(kinds.first, np.int64)[which]
        mask = np.where(first, told["first"][which], told["rest"][which])
        some = np.flatnonzero(mask)
        docs, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for bit in range(self.plan.prefix - self.plan.gram + 1) if len(some) else ():
            hit = some[(mask[some] >> np.uint64(bit)) & np.uint64(1) == 1]
            docs.append(runs.doc[run[hit]])
            starts.append(runs.start[run[hit]] + at[hit] + bit)
        return Copies(block).split(block, got)[0], np.concatenate(docs), np.concatenate(starts)


class SuffixTrees(Resolver):
    """Suffix trees over words, one for each group of prefixes (or several small ones together).

    Suffixes are split by their first word, and groups that don't fit by ever longer prefixes. Each group's suffixes make a
    subtree; its branching nodes as deep as a window are maximal repeats. A suffix loses as many words as the deepest node has below which
    there is a leaf of an earlier document.
    """

    TOGETHER = 50_000  # suffixes of a subtree, or of several small ones

    def answer(self, held: list) -> list[tuple[int, bytes, int]]:
        leaves, w = Leaves(held), self.plan.window
        flat = np.frombuffer(leaves.flat, np.uint8)
        begin = np.r_[0, np.flatnonzero(flat == 32) + 1]  # of each word, and the end
        first, end = (np.searchsorted(begin, x) for x in (leaves.begin, leaves.begin + leaves.size))
        windows = end - first - w + 1
        content, by = np.repeat(np.arange(len(first)), windows), K.ranges(np.zeros(len(first), np.int64), windows)
        at, length = first[content] + by, np.zeros(len(content), np.int64)
        for some in prefix_groups(K.stretches(flat, begin[:-1], begin[1:] - 1), at, w, self.TOGETHER):
            tree = Subtree(leaves.flat, begin[at[some]], begin[end[content[some]]] - begin[at[some]])
            length[some] = tree.earlier(leaves.rank[content[some]], w)
        return leaves.answers(windows_of(content, by, length, w, len(first)), windows)


def prefix_groups(words: np.ndarray, at: np.ndarray, most: int, together: int) -> Iterator[np.ndarray]:
    """Suffixes (given by their first word) in groups of common prefixes, of about `together`, small ones joined.

    Prefixes grow from one word until their group fits, up to `most` words; a suffix that shares its prefix with none is no group.
    """
    todo, group, lengths, ready, held = np.arange(len(at)), np.zeros(len(at), np.int64), [], [], 0
    n = 1
    while n < most:
        lengths.append(n)
        n *= 2
    for code in K.grams_of(words, (*lengths, most)):
        order = np.lexsort((code[at[todo]], group))
        todo, group, key = todo[order], group[order], code[at[todo[order]]]
        lo, hi = _cuts(group, key)
        large = np.repeat(hi - lo > together, hi - lo)
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            if 1 < b - a <= together:
                if held + b - a > together:
                    yield np.concatenate(ready)
                    ready, held = [], 0
                ready.append(todo[a:b])
                held += b - a
        group = np.repeat(np.arange(len(lo)), hi - lo)[large]
        todo = todo[large]
        if not len(todo):
            break
    if ready:
        yield np.concatenate(ready)
    for a, b in zip(*_cuts(group), strict=True):  # of one prefix as long as a window: all alike so far
        yield todo[a:b]


def spaced_words(text: bytes) -> tuple[bytes, np.ndarray]:
    """The words of a text, each with a space after it, and where each begins (and the end). Of a long word its digest stands."""
    found = text.split()
    size = np.fromiter(map(len, found), np.int64, len(found))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        found[i] = b"\v" + hashlib.blake2b(found[i], digest_size=32).hexdigest().encode()
        size[i] = len(found[i])
    return b" ".join([*found, b""]), np.r_[0, np.cumsum(size + 1)]


class Subtree:
    """The suffix tree of some word sequences, each word ended by a space: their order, longest common prefixes and internal nodes."""

    def __init__(self, flat: bytes, begin: np.ndarray, size: np.ndarray):
        texts = [flat[a : a + n] for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
        self.order = np.array(sorted(range(len(texts)), key=texts.__getitem__), np.int64)
        text = np.frombuffer(b"".join(texts[i] for i in self.order), np.uint8)
        size = size[self.order]
        start = np.cumsum(size) - size
        common = common_bytes(K.lanes(text), start[:-1], start[1:], np.minimum(size[:-1], size[1:]))
        words = np.r_[0, np.cumsum(text == 32, dtype=np.int32)]
        self.depth = np.r_[0, words[start[:-1] + common] - words[start[:-1]]] if len(size) else np.zeros(0, np.int64)  # shared with the one before

    def nodes(self, rank: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Internal nodes of at least a depth: for each boundary between leaves its node, and of each node the depth, the smallest rank below it and the parent.

        A node is an interval of leaves; it is known by its first boundary. -1 stands for what is less deep.
        """
        d = np.where(self.depth >= least, self.depth, 0)
        left = smaller(d, d)[0]  # the nearest boundary before that is less deep
        right = len(d) - 1 - smaller(d[::-1], d[::-1])[0][::-1]
        deep = np.flatnonzero(d)
        key = left[deep] * (len(d) + 1) + right[deep]
        _, one, of = np.unique(key, return_index=True, return_inverse=True)
        node = np.full(len(d) + 1, -1)
        node[deep] = of
        lo, hi, depth = left[deep][one], right[deep][one], d[deep][one]  # leaves lo .. hi - 1
        up = np.where(d[lo] >= np.r_[d, 0][hi], node[lo], node[hi])
        return node, depth, range_least(rank[self.order], lo, hi), up

    def earlier(self, rank: np.ndarray, least: int) -> np.ndarray:
        """Of each leaf: the depth of the deepest node (of at least `least`) below which there is a leaf of smaller rank; 0 if there is none."""
        out = np.zeros(len(rank), np.int64)
        if not len(rank) or self.depth.max() < least:
            return out
        node, depth, lowest, up = self.nodes(rank, least)
        d = np.r_[self.depth, 0]
        at = np.where(d[:-1] >= d[1:], node[:-1], node[1:])  # the deepest node above each leaf
        todo, r = np.flatnonzero(at >= 0), rank[self.order]
        while len(todo := todo[at[todo] >= 0]):
            found = lowest[at[todo]] < r[todo]
            out[self.order[todo[found]]] = depth[at[todo[found]]]
            todo = todo[~found]
            at[todo] = up[at[todo]]
        return out


def range_least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of x[lo:hi] for each non-empty range."""
    out, span = np.empty(len(lo), x.dtype), np.frexp((hi - lo).astype(float))[1] - 1  # 2 ** span fits
    level, k = x, 0
    while len(lo):
        now = np.flatnonzero(span == k)
        out[now] = np.minimum(level[lo[now]], level[hi[now] - (1 << k)])
        if k >= span.max():
            break
        level, k = np.minimum(level[: -(1 << k)], level[1 << k :]), k + 1
    return out


def common_bytes(lane: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes from a and from b on are equal, up to `most`."""
    out, todo, at = most.astype(np.int64), np.arange(len(a)), 0
    while len(todo := todo[most[todo] > at]):
        x = lane[a[todo] + at] ^ lane[b[todo] + at]
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8)
        stop = same < 8
        out[todo[stop]] = np.minimum(out[todo[stop]], at + same[stop])
        todo, at = todo[~stop], at + 8
    return out


class PreviousFactors(Resolver):
    """Longest-previous-factor arrays over bytes, part by part.

    The suffixes that a part holds, each up to its stretch's end, are put in suffix order with the bytes that neighbours share. For each, the
    nearest suffixes on either side that come from an earlier document are its previous and next smaller positions; the more that it
    shares with either is its longest previous factor. A factor as long as a window or longer goes whole.
    """

    def answer(self, held: list) -> list[tuple[int, bytes, int]]:
        leaves, w = Leaves(held), self.plan.window
        windows = leaves.size - w + 1
        content, by = np.repeat(np.arange(len(windows)), windows), K.ranges(np.zeros(len(windows), np.int64), windows)
        order, common = suffix_order(K.lanes(np.frombuffer(leaves.flat, np.uint8)), leaves.begin[content] + by, leaves.size[content] - by)
        length = np.empty(len(order), np.int64)
        length[order] = previous_factor(leaves.rank[content[order]], common)
        return leaves.answers(windows_of(content, by, length, w, len(windows)), windows)


def suffix_order(lane: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes of these sizes, and how many bytes each shares with the one before it.

    Sixteen bytes at a time; only suffixes that are still tied are looked at again.
    """
    order, common = np.arange(len(begin)), np.zeros(len(begin), np.int64)
    todo, group, at = np.arange(len(begin)), np.zeros(len(begin), np.int64), 0
    while len(todo):
        mine = order[todo]
        left = size[mine] - at
        x, y = ((lane[np.minimum(begin[mine] + at + d, len(lane) - 1)] & K._KEEP[np.clip(left - d, 0, 8)]).byteswap() for d in (0, 8))
        k = np.lexsort((y, x, group) if at else (y, x))
        order[todo], x, y = mine[k], x[k], y[k]
        new, tied = B.first_of_runs(group, x, y), ~B.first_of_runs(group)
        parted = np.flatnonzero(new & tied)
        fore = x[parted] ^ x[parted - 1]
        common[todo[parted]] = at + np.where(fore != 0, 64 - _bit_length(fore), 128 - _bit_length(y[parted] ^ y[parted - 1])) // 8
        over = np.flatnonzero(~new & (size[order[todo]] <= at + 16))  # ended, and as the one before so far
        common[todo[over]] = size[order[todo[over]]]
        group = np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))
        stay = ~(new & np.r_[new[1:], True])
        ended = np.add.reduceat(size[order[todo]] > at + 16, np.flatnonzero(new)) == 0  # groups in which nothing is left to compare
        stay &= ~np.repeat(ended, np.diff(np.r_[np.flatnonzero(new), len(todo)]))
        todo, group, at = todo[stay], group[stay], at + 16
    if len(order):
        common[1:] = np.minimum(common[1:], np.minimum(size[order[1:]], size[order[:-1]]))
    return order, common


def _bit_length(x: np.ndarray) -> np.ndarray:
    for shift in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(shift))
    return np.bitwise_count(x).astype(np.int64)


def previous_factor(rank: np.ndarray, common: np.ndarray) -> np.ndarray:
    """In suffix order: the most that each shares with its previous or next smaller position."""
    before = smaller(rank, common)[1]
    after = smaller(rank[::-1], np.r_[common[1:], 0][::-1])[1][::-1] if len(rank) else before
    return np.maximum(before, after)


def smaller(x: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one before it that holds a smaller value (-1: none), and the least of `common` on the way (0: none)."""
    near, least = np.arange(len(x)) - 1, common.copy()
    todo = np.flatnonzero(near >= 0)
    while len(todo := todo[x[near[todo]] >= x[todo]]):
        # All between are no smaller than x there, so no smaller than x here.
        least[todo], near[todo] = np.minimum(least[todo], least[near[todo]]), near[near[todo]]
        todo = todo[near[todo] >= 0]
    least[near < 0] = 0
    return near, least


def find(corpus: B.Corpus, plan: Plan, resolver) -> tuple[B.Corpus, int]:
    """The corpus with the answers that `removed` needs, and the number of parts of the last question."""

    def copies(block, got, n):
        keys = Copies(block).keys
        return B.part_of(keys["key"], n), keys

    def anchors(block, got, n):
        keys = Runs(block, plan, Copies(block).split(block, got)[1]).keys
        return B.part_of(keys["key"], n), keys

    corpus = corpus.ask_keys("copies", corpus.parts(), COPY, copies, _later_copies)
    return resolver.find(corpus.ask_keys("anchors", corpus.parts(), ANCHOR, anchors, _shared_anchors(plan.crowd), weight="runs"))
