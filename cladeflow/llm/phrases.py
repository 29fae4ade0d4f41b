"""Collocations of each language by dynamic itemset counting (operator 13)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import kernels as K
from . import repeats as R

THRESHOLD, LONGEST, SHARDS, TOP = 30, 4, 2, 2000
SLOTS = 1 << 24  # of the tables of codes that reached the threshold; one byte each, broadcast at every size
SMALL = 2_000_000  # frequent phrases up to which they are broadcast
CHUNK = 4 << 20  # bytes of text that are counted together
PART_BYTES = 32 << 20  # text whose phrases a part counts
NEVER = 255
COUNT = np.dtype([("key", "<u8"), ("n", "<u4"), ("since", "u1"), ("at", "u1")])  # of phrases with a code
CODE = np.uint64(0xFFFFFFFFFF000000)  # bits of codes that are counted by; phrases that share them are told apart when they are named

_PIECE = re.compile(rb"[.,;:!?\x0a-\x0d]")
_set = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
_CUTS, _GAPS = _set(b".,;:!?\n\v\f\r"), _set(b".,;:!?\n\v\f\r \t")
NAMED = "lang string, phrase string, len int, n long"


def phrase_codes(phrases: list[bytes], langs: list[str]) -> np.ndarray:
    """A code for each phrase (words with single spaces) of a language, the same that `Words.phrases` has."""
    flat, begins = K.join_texts(phrases)
    start, end, first = K.words(flat, begins)
    known = {x: lang_code(x) for x in set(langs)}
    words = K.pair(np.repeat(np.array([known[x] for x in langs], np.uint64), np.diff(first)), K.stretches(flat, start, end))
    out, length = np.zeros(len(phrases), np.uint64), np.diff(first)
    for n in np.unique(length).tolist():
        here = np.flatnonzero(length == n)
        out[here] = K.grams(words, n)[first[here]]
    return out


def lang_code(lang: str) -> int:
    raw = np.frombuffer(lang.encode(), np.uint8)
    return int(K.stretches(raw, np.array([0]), np.array([len(raw)]))[0])


class Words:
    """The words of some texts, lower-case: where they stand, their piece and language, and codes that tell both word and language."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.flat, begins = K.join_texts(texts, lower=True)
        edge = np.flatnonzero(np.diff(_GAPS[self.flat], prepend=True, append=True))
        self.start, self.end = edge[0::2], edge[1::2]
        self.names = sorted(set(langs))
        at = {x: i for i, x in enumerate(self.names)}
        self.lang = np.repeat(np.array([at[x] for x in langs], np.int64), np.diff(np.searchsorted(self.start, begins)))
        self.piece = np.cumsum(_CUTS[self.flat], dtype=np.int32)[self.start] if len(self.start) else self.start
        self.codes = K.pair(np.array([lang_code(x) for x in self.names], np.uint64)[self.lang], K.stretches(self.flat, self.start, self.end))

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: a code for the phrase from each word on, and whether it is within a piece."""
        for n, code in zip(range(1, longest + 1), K.grams_of(self.codes, tuple(range(1, longest + 1))), strict=True):
            yield n, code, self.piece[: len(code)] == self.piece[n - 1 :][: len(code)]


class Names(Words):
    """Words with exact numbers, so that phrases are told apart by content and can be written out."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        super().__init__(texts, langs)
        self.size = self.end - self.start
        # Words with one space after each, so that a phrase is a stretch of them.
        self.begin = np.cumsum(self.size + 1) - self.size - 1
        self.flat = self.flat[K.ranges(self.start, self.size + 1)]
        self.flat[self.begin + self.size] = 32
        self.id, self.n_ids = self._numbers()

    def _numbers(self) -> tuple[np.ndarray, int]:
        """A number for each different word of a language: words of one code are compared, and told apart by content if they differ."""
        if not len(self.codes):
            return np.zeros(0, np.int64), 0
        order = np.argsort(self.codes)
        new = B.first_of_runs(self.codes[order])
        of, head = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        head[order] = order[np.flatnonzero(new)][of[order]]
        alike = (self.size[head] == self.size) & (self.lang[head] == self.lang)
        alike &= R.common_bytes(K.lanes(self.flat), self.begin, self.begin[head], np.where(alike, self.size, 0)) == self.size
        if alike.all():
            return of, int(new.sum())
        known: dict = {}
        word = lambda i: (int(self.lang[i]), self.flat[self.begin[i] : self.begin[i] + self.size[i]].tobytes())
        return np.array([known.setdefault(word(i), len(known)) for i in range(len(of))], np.int64), len(known)

    def different(self, at: np.ndarray, n: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of phrases of n words that begin at these words and have these codes: the first place of each different one, and how often it is there."""
        order = np.argsort(code)
        new = B.first_of_runs(code[order])
        head = at[order[np.flatnonzero(new)]][np.cumsum(new) - 1]
        if all((self.id[head + k] == self.id[at[order] + k]).all() for k in range(n)):
            first = np.flatnonzero(new)
            return at[order[first]], np.diff(np.r_[first, len(at)])
        key = self.id[at]  # phrases of one code that differ
        for k in range(1, n):
            key = np.unique(key, return_inverse=True)[1] * self.n_ids + self.id[at + k]
        _, one, count = np.unique(key, return_index=True, return_counts=True)
        return at[one], count

    def packed(self, at: np.ndarray, n: int, count: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
        """For each part, chosen by a phrase's first two words: phrases with their language and counts. Those that begin alike stand together, for the sake of size."""
        second = at + min(1, n - 1)
        part = B.part_of(K.pair(self.codes[at], self.codes[second]), parts)
        order = np.lexsort((*(self.id[at + k] for k in range(n - 1, -1, -1)), self.lang[at], part))
        at, count, part = at[order], count[order], part[order]
        size = self.begin[at + n - 1] + self.size[at + n - 1] - self.begin[at] + 1  # with the space after it
        text = self.flat[K.ranges(self.begin[at], size)]
        ends = np.cumsum(size)
        text[ends - 1] = 10
        lo = np.flatnonzero(B.first_of_runs(part, self.lang[at]))
        for a, b in zip(lo.tolist(), np.r_[lo[1:], len(at)].tolist(), strict=True):
            name = self.names[self.lang[at[a]]].encode()
            head = np.array([len(name), b - a], "<u4").tobytes() + name + count[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            yield int(part[a]), B.squeeze(head + text[ends[a] - size[a] : ends[b - 1]].tobytes())


def unpacked(raw: bytes) -> tuple[bytes, list[bytes], list[int]]:
    """Language, phrases and counts of a message of `Names.packed`."""
    raw = B.expand(raw)
    size, n = np.frombuffer(raw, "<u4", 2).tolist()
    count = np.frombuffer(raw, np.uint8, 4 * n, 8 + size).reshape(4, -1).T.copy().view("<u4").ravel()
    return raw[8 : 8 + size], raw[8 + size + 4 * n :].split(b"\n")[:n], count.tolist()


def slots_of(code: np.ndarray, table: np.ndarray | range) -> np.ndarray:
    """The place of each code in a table (or range) whose length is a power of two."""
    return ((code >> np.uint64(24)) & np.uint64(len(table) - 1)).astype(np.int64)


def scanned(words: Words, step: int, shards: int, longest: int, reached: np.ndarray) -> np.ndarray:
    """Counts of the codes of phrases of all lengths that are being counted in this step, by ascending code.

    Words are counted from the first step on. A longer phrase is counted from the step after that in which the later of its two
    subphrases reached the threshold, and for one cycle. `reached` tells the step by slot; where two codes share a slot the
    earlier step holds, so a phrase may be counted that needn't, but each for exactly one cycle.
    """
    out, known = [np.zeros(0, COUNT)], None
    for n, code, whole in words.phrases(longest):
        if n == 1:
            active = [(0, code)] if step < shards else []
        else:
            since = np.maximum(known[:-1], known[1:])[: len(code)].astype(np.int64) + 1
            active = [(t, code[whole & (since == t)]) for t in range(max(1, step - shards + 1), step + 1)]
        for t, some in active:
            some = np.sort(some & CODE)
            first = np.flatnonzero(B.first_of_runs(some))
            made = np.zeros(len(first), COUNT)
            made["key"], made["n"], made["since"], made["at"] = some[first], np.diff(np.r_[first, len(some)]), t, NEVER
            out.append(made)
        known = reached[slots_of(code, reached)]
        if (known == NEVER).all():
            break
    out = np.concatenate(out)
    return out[np.argsort(out["key"])]


def merged(messages: list[np.ndarray], step: int, threshold: int) -> np.ndarray:
    """The counts of all messages together, with the step in which each code reached the threshold."""
    rows = np.concatenate(messages)
    rows = rows[np.argsort(rows["key"], kind="stable")]
    first = np.flatnonzero(B.first_of_runs(rows["key"]))
    out = rows[first]
    if len(first):
        n = np.add.reduceat(rows["n"].astype(np.int64), first)
        out["since"], out["at"] = np.maximum.reduceat(rows["since"], first), np.minimum.reduceat(rows["at"], first)
        out["at"][(out["at"] == NEVER) & (n >= threshold)] = step
        out["n"] = np.minimum(n, 2**32 - 1)  # beyond the threshold all is one here; phrases are counted by their words
    return out


def chunks(batches) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts and languages of about CHUNK bytes together; longer texts are cut between pieces, which no phrase crosses."""
    texts, langs, size = [], [], 0
    for b in batches:
        for lang, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            while raw:
                cut = _PIECE.search(raw, CHUNK) if len(raw) > CHUNK else None
                part, raw = (raw[: cut.end()], raw[cut.end() :]) if cut else (raw, b"")
                if texts and size + len(part) > CHUNK:
                    yield texts, langs
                    texts, langs, size = [], [], 0
                texts.append(part)
                langs.append(lang)
                size += len(part)
    if texts:
        yield texts, langs


def count_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, len, n) of all phrases of up to `longest` words with at least `threshold` occurrences, and (lang, n) of all words.

    Dynamic itemset counting: the corpus is written once in shards, which are scanned in turn, over and over. All lengths are counted in the same
    scans; a phrase is taken up once both its subphrases (without the last word, without the first) have reached the threshold in
    what was read so far, and is counted until the scan comes to the shard where it was taken up. Scans end one cycle after the last
    phrase reached the threshold. Scans count 64-bit codes of phrases, packed by parts of code space; a last one writes out those that were found
    often and counts them by their words, so that phrases of one code don't count as one.

    Which codes reached the threshold, and when, travels as a table of `slots` bytes (a power of two), whatever the size of the corpus. Where it
    fills up more phrases are counted than need be, and results stay the same. Texts are lower-cased A to Z, cut into pieces at
    .,;:!? and line ends, and those at spaces and tabs. A null text is empty, a null language `und`; an empty table gives
    no rows; other columns may have any names.
    """
    if slots & (slots - 1):
        raise ValueError("slots is a power of two")
    spark = docs.sparkSession
    B.shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/phrases-{uuid.uuid4().hex}"
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")).write.partitionBy("shard").parquet(f"{folder}/shards")
    table = spark.read.schema("lang string, text binary, shard int").parquet(f"{folder}/shards")
    size = table.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    parts = int(max(2 * spark.sparkContext.defaultParallelism if size > PART_BYTES else 1, size // PART_BYTES + 1))

    def scan(step: int, told) -> DataFrame:
        def run(batches):
            for texts, langs in chunks(batches):
                counts = scanned(Words(texts, langs), step, shards, longest, told.value)
                part = B.part_of(counts["key"], parts)
                cut = np.flatnonzero(B.first_of_runs(part))
                if len(cut):
                    packed = [B.by_planes(c, "key") for c in np.split(counts, cut[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array(packed, pa.binary())], ["part", "counts"])
                B.give_back()

        return table.filter(F.col("shard") == step % shards).select("lang", "text").mapInArrow(run, "part int, counts binary")

    def count(step: int):
        """Of each part: codes that are still being counted, slots of those that reached the threshold now, and of those that ended above it."""

        def reply(part: int, held: list[np.ndarray]) -> pa.RecordBatch:
            found = merged(held, step, threshold)
            place = lambda which: np.unique(slots_of(found["key"][which], range(slots))).astype("<i4").tobytes()
            ended = found["since"].astype(np.int64) + shards - 1 <= step
            out = [b"" if ended.all() else B.by_planes(found[~ended], "key"), place(found["at"] == step), place(ended & (found["at"] != NEVER))]
            B.give_back()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in out)], ["part", "counts", "new", "ended"])

        def run(batches):
            part, held = None, []
            for b in batches:
                for p, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if p != part and held:
                        yield reply(part, held)
                        held = []
                    part = p
                    held.append(B.from_planes(raw, COUNT, "key") if raw else np.zeros(0, COUNT))
            if held:
                yield reply(part, held)

        return run

    def places(made: DataFrame, column: str) -> np.ndarray:
        found = np.zeros(slots, bool)  # what comes to the driver is told by slots
        for r in made.select(column).toLocalIterator():
            found[np.frombuffer(r[column], "<i4")] = True
        return np.flatnonzero(found)

    each = -(-parts // B.MOST_TASKS)  # a reducer takes several parts in a row, one after the other
    reached, often, made, step, last = np.full(slots, NEVER, np.uint8), np.zeros(slots, bool), None, 0, -1
    while step <= last + shards:
        told = spark.sparkContext.broadcast(reached)
        sent = scan(step, told)
        sent = sent if made is None else sent.unionByName(made.select("part", "counts"))
        dealt = sent.repartitionById(-(-parts // each), F.expr(f"part div {each}").cast("int")).sortWithinPartitions("part")
        dealt.mapInArrow(count(step), "part int, counts binary, new binary, ended binary").write.parquet(f"{folder}/step-{step}")
        made = spark.read.parquet(f"{folder}/step-{step}")
        if step:
            B.remove(spark, f"{folder}/step-{step - 1}")  # this step's counts hold it
        place, reached = places(made, "new"), reached.copy()
        if len(place):
            reached[place], last = np.minimum(reached[place], step), step
        often[places(made, "ended")] = True
        told.unpersist()
        step += 1
    told = spark.sparkContext.broadcast(np.packbits(often, bitorder="little"))

    def named(batches):
        for texts, langs in chunks(batches):
            words, out = Names(texts, langs), []
            for name, total in zip(words.names, np.bincount(words.lang, minlength=len(words.names)).tolist(), strict=True):
                head = np.array([len(name.encode()), 1], "<u4").tobytes() + name.encode() + np.array([min(total, 2**32 - 1)], "<u4").tobytes()
                out.append((lang_code(name) % parts, B.squeeze(head + b"\n")))  # all words of a language are its empty phrase
            for n, code, whole in words.phrases(longest):
                slot = slots_of(code, range(slots))
                at = np.flatnonzero(whole & (told.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1))
                if not len(at):
                    break
                first, count = words.different(at, n, code[at])
                out += words.packed(first, n, count, parts)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["part", "names"])
            B.give_back()

    def counted(batches):
        part, held = None, {}

        def rows():
            for lang, found in held.items():
                often = [(p, c) for p, c in found.items() if c >= threshold or not p]
                for at in range(0, len(often), 100_000):
                    some = often[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(some)), pa.array([p.decode() for p, _ in some], pa.string()), pa.array([p.count(b" ") + 1 if p else 0 for p, _ in some], pa.int32()), pa.array([c for _, c in some], pa.int64())], ["lang", "phrase", "len", "n"])

        for b in batches:
            for p, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    yield from rows()
                    part, held = p, {}
                lang, phrases, counts = unpacked(raw)
                found = held.setdefault(lang, {})
                for x, c in zip(phrases, counts, strict=True):
                    found[x] = found.get(x, 0) + c
        yield from rows()

    sent = table.select("lang", "text").mapInArrow(named, "part int, names binary")
    dealt = sent.repartitionById(-(-parts // each), F.expr(f"part div {each}").cast("int")).sortWithinPartitions("part")
    counts = dealt.mapInArrow(counted, NAMED).checkpoint()
    B.remove(spark, folder)
    return counts.filter("len > 0"), counts.filter("len = 0 and n > 0").select("lang", "n")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP, inside: int = 80, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language whose words belong together.

    a is a phrase's number of occurrences, l and r those of its parts at the cut where floor(2000000 a / (l + r)) is lowest, the first of
    equals; n is the number of the language's words. A phrase is left out that a longer one holds with at least `inside` percent of its
    occurrences. Ranks go by falling score, then falling a, then phrase in order of its bytes. Sums and products are decimals, so exact. For
    nulls, empty texts and tables see `count_phrases`.
    """
    found, words = count_phrases(docs, lang_col, text_col, threshold, longest, shards, slots)
    found = found.withColumnRenamed("n", "a")
    small = found.limit(SMALL + 1).count() <= SMALL
    known = lambda name, part: (lambda t: F.broadcast(t) if small else t)(found.select("lang", F.col("phrase").alias(part), F.col("a").alias(name)))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    phrases = found.filter("len > 1").withColumn("words", F.split("phrase", " "))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1)))
    cuts = cuts.withColumn("fore", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice("words", F.col("k") + 1, F.col("len") - F.col("k")), " "))
    cuts = cuts.join(known("l", "fore"), ["lang", "fore"]).join(known("r", "rest"), ["lang", "rest"])
    cuts = cuts.withColumns({"wide_a": exact("a"), "wide": exact("l") + exact("r")}).withColumn("score", F.expr("(cast(2000000 as decimal(7,0)) * wide_a) div wide"))
    scored = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("best"))
    spans = [(i, m) for m in range(2, longest) for i in range(longest - m + 1)]  # parts of longer phrases
    parts = F.filter(F.array(*[F.when(F.col("len") >= i + m, F.array_join(F.slice("words", i + 1, m), " ")) for i, m in spans]), lambda x: x.isNotNull() & (x != F.col("phrase"))) if spans else F.array().cast("array<string>")
    longer = phrases.select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * inside))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = F.broadcast(words) if words.limit(SMALL + 1).count() <= SMALL else words
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


SQL = f"""WITH w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, m, g, count(*) AS a FROM (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, {LONGEST + 1}) t(m) WHERE len(w) >= m)) GROUP BY ALL HAVING count(*) >= {THRESHOLD}),
c AS (SELECT lang, g, m, a, string_split(g, ' ') AS w FROM f WHERE m > 1),
cuts AS (SELECT c.lang, c.g, c.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS s FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.g = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.g = array_to_string(w[k + 1:c.m], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY s, k) AS o FROM cuts) WHERE o = 1),
parts AS (SELECT lang, g, max(a) AS b FROM (SELECT lang, a, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, m - n + 2)) AS i FROM c, range(2, {LONGEST}) t(n) WHERE n < m)) GROUP BY ALL),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY s DESC, a DESC, g) AS rank, g, a, l, r, s FROM best LEFT JOIN parts USING (lang, g) WHERE b IS NULL OR 100::HUGEINT * b < 80::HUGEINT * a)
SELECT lang, rank, g AS phrase, a, l, r, n, s::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}"""
