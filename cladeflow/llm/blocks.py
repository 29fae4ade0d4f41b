"""Blocks of documents and questions that blocks put to each other.

A `Corpus` deals documents once into blocks of neighbouring ids, one row each, written to the shared
checkpoint folder and laid out by block number, so that later joins on that number move no text.

`Corpus.ask` is one round of "has any other block this too?": each block sends every part (a range of hash
space) one packed array of its *distinct* keys, the part answers with as many answers in the same
order, and the answers are laid out beside the block, once. A key leaves a block once however often it
occurs there, so that a key that a third of all rows hold makes no part larger than the number of
blocks. There are as many parts as the keys fill, far fewer than blocks. Nothing is collected on the driver but
one row of totals and the limits between blocks (8 bytes for BLOCK_BYTES of text).
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

BLOCK_BYTES = 8 << 20  # text in a block, at any size of the corpus
PART_BYTES = 16 << 20  # text whose keys a part answers for
MOST_TASKS = 20_000  # partitions that blocks are dealt to, and reducers of a question
AT_ONCE = 10_000  # limits between blocks found by one aggregate
ANSWER = "pid int, kind string, part int, ans binary, hits long"
CHUNK_BYTES = 1 << 20  # text that a kernel takes at a time
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def shared_checkpoints(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder; choose one only where none is set and all runs on this machine (tests)."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that the input doesn't have."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Hand freed memory back to the machine; a worker that serves many stages would keep its largest blocks of each."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_press, _unpress = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()  # a Python worker runs one task at a time


def squeeze(raw: bytes) -> bytes:
    return _press.compress(raw)


def expand(raw: bytes) -> bytes:
    return _unpress.decompress(raw)


def in_planes(records: np.ndarray) -> bytes:
    """Packed records with the first bytes of all together, then the second ..."""
    return np.ascontiguousarray(records.view(np.uint8).reshape(len(records), -1).T).tobytes()


def out_of_planes(raw: bytes, dtype) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T.copy().reshape(-1).view(dtype)


def by_planes(records: np.ndarray, ascending: str | None = None) -> bytes:
    """Records by planes of bytes, squeezed; a field that ascends as its steps."""
    if ascending:
        records = records.copy()
        records[ascending][1:] = np.diff(records[ascending])
    return squeeze(in_planes(records))


def from_planes(raw: bytes, dtype, ascending: str | None = None) -> np.ndarray:
    records = out_of_planes(expand(raw), dtype)
    if ascending:
        records[ascending] = np.cumsum(records[ascending], dtype=records[ascending].dtype)
    return records


class Block:
    """One block's documents in order of id (those without an id last), texts compressed until asked for."""

    def __init__(self, pid: int, ids: list, packed: list, order: list[int]):
        self.pid, self.order = pid, order
        self.raw_ids = [ids[i] for i in order]
        self.known = sum(i is not None for i in self.raw_ids)  # those without an id come last
        self.ids = np.array(self.raw_ids[: self.known], np.int64)
        self.packed = [packed[i] for i in order]

    def text(self, i: int) -> bytes:
        """A document's text, empty for null."""
        return expand(self.packed[i]) if self.packed[i] is not None else b""

    def chunks(self, all_rows: bool = False) -> Iterator[tuple[int, list[bytes]]]:
        """Index of the first document, and texts, of about CHUNK_BYTES together."""
        n = len(self.packed) if all_rows else self.known
        begin, texts, size = 0, [], 0
        for i in range(n):
            if i == self.known and texts:
                yield begin, texts
                begin, texts, size = i, [], 0
            text = self.text(i)
            if texts and size + len(text) > CHUNK_BYTES:
                yield begin, texts
                begin, texts, size = i, [], 0
            texts.append(text)
            size += len(text)
        if texts:
            yield begin, texts


def pieces(text: bytes, unit: str, overlap: int, most: int = CHUNK_BYTES) -> Iterator[tuple[int, bytes]]:
    """A long text in pieces of about `most` bytes, each with its first unit's number and the last `overlap` units of the one before."""
    at, done, size = 0, 0, most
    while True:
        if unit == "byte":
            stop = min(len(text), at + size + overlap)
            yield at, text[at:stop]
            at = stop - overlap
            if stop == len(text):
                return
            continue
        gap = _GAP.search(text, at + size) if at + size < len(text) else None
        stop = gap.start() if gap else len(text)
        if stop == len(text):
            yield done, text[at:]
            return
        start, _, _ = K.words(*K.join_texts([text[at:stop]]))
        if len(start) <= overlap:  # of very long words
            size *= 2
            continue
        yield done, text[at:stop]
        done += len(start) - overlap
        at += int(start[len(start) - overlap]) if overlap else stop - at


def block_count(spark: SparkSession, total: int) -> int:
    """Blocks of about BLOCK_BYTES; smaller ones where a small corpus wouldn't fill the cores."""
    return int(max(total // BLOCK_BYTES + 1, min(spark.sparkContext.defaultParallelism, total // CHUNK_BYTES + 1)))


def spread(text: bytes | None, n: int) -> int:
    """A block for a row without an id."""
    return zlib.crc32(text or b"") % n


def measured(rows: DataFrame) -> tuple[DataFrame, int]:
    """The ids of rows (id, z), a row of usual length once and a longer one as many times as it is longer, for `limits_between`; and the bytes of all texts."""
    shared_checkpoints(rows.sparkSession)
    sizes = rows.select("id", F.coalesce(F.octet_length("z"), F.lit(0)).alias("b")).checkpoint()  # so that texts are read once for both
    whole = sizes.agg(F.sum("b").alias("b"), F.count("*").alias("n")).head()
    total = whole["b"] or 0
    usual = max(1, total // max(1, whole["n"]))
    return sizes.select(F.explode(F.expr(f"array_repeat(id, cast(1 + b div {usual} as int))")).alias("id")), total


def limits_between(rows: DataFrame, n: int) -> np.ndarray:
    """The largest id of each of n ranges of about as many rows but the last; beyond AT_ONCE of ranges of ranges."""
    quantiles = lambda k: F.expr(f"percentile_approx(id, array({', '.join(f'{i / k:.9f}D' for i in range(1, k))}), {max(10_000, 10 * k)})").alias("q")
    if n <= 1:
        return np.zeros(0, np.int64)
    if n <= AT_ONCE:
        return np.unique(np.array(rows.agg(quantiles(n)).head()["q"] or [], np.int64))
    coarse = -(-n // AT_ONCE)
    outer = limits_between(rows, coarse)

    def place(batches):
        for b in batches:
            ids = b.column(0).drop_null()
            at = np.searchsorted(outer, ids.to_numpy(zero_copy_only=False), "left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), ids], ["range", "id"])

    # One row a range, each of at most AT_ONCE numbers.
    inner = rows.select("id").mapInArrow(place, "range int, id long").groupBy("range").agg(quantiles(AT_ONCE)).toLocalIterator()
    return np.unique(np.concatenate([outer, *(np.array(r["q"] or [], np.int64) for r in inner)]))


def _laid_out(made: DataFrame) -> DataFrame:
    """A checkpoint that still says how its rows are dealt; an adaptive plan doesn't, and each later join would move all text."""
    conf, name = made.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return made.checkpoint()
    finally:
        conf.set(name, before)


def _blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[Block, pa.StructArray, dict]]:
    for i in range(batch.num_rows):
        inner = batch.column(1)[i].values
        ids, z = inner.field("id").to_pylist(), inner.field("z").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, z[k] or b""))
        answers: dict[str, dict[int, bytes]] = {}
        for column in batch.columns[2:]:
            for a in column[i].as_py() or []:
                kind, _, width = a["kind"].partition("/")  # with a width, records of so many bytes lie by planes
                answers.setdefault(kind, {})[a["part"]] = from_planes(a["ans"], f"V{width}").tobytes() if width else expand(a["ans"])
        block = Block(batch.column(0)[i].as_py(), ids, z, order)
        yield block, inner, {k: b"".join(v[p] for p in sorted(v)) for k, v in answers.items()}
        give_back()


class Corpus:
    """Documents in blocks, and the answers that each block has had so far."""

    def __init__(self, table: DataFrame, tasks: int, limits: np.ndarray, total: int, answers: tuple[DataFrame, ...] = ()):
        self.table, self.tasks, self.limits, self.total, self.answers = table, tasks, limits, total, answers

    @classmethod
    def deal(cls, docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> Corpus:
        """Blocks of rows, in ranges of id.

        carry keeps the other columns of each row beside its text, as a struct `rest`. The input is read twice (lengths,
        texts); write it first where it is dear. Ranges follow lengths as well as numbers of rows, so that neighbours of very long
        texts don't fill one block. Rows that share an id share a block; rows without one are spread.
        """
        spark = docs.sparkSession
        other = [c for c in docs.columns if c not in (id_col, text_col)]
        rest = F.struct(*[F.col(f"`{c}`") for c in other]) if carry and other else F.lit(None).cast("string")
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("z"), rest.alias("rest"))
        lengths, total = measured(rows)
        n = block_count(spark, total)
        limits = limits_between(lengths, n)
        schema = T.StructType([T.StructField("pid", T.IntegerType()), *rows.schema.fields])

        def pack(batches):
            for b in batches:
                ids, texts = b.column(0), b.column(1).to_pylist()
                pid = np.searchsorted(limits, ids.fill_null(0).to_numpy(zero_copy_only=False), "left").astype(np.int32)
                for i in np.flatnonzero(np.asarray(ids.is_null())):
                    pid[i] = spread(texts[i], len(limits) + 1)
                z = pa.array([None if t is None else squeeze(t) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(pid), ids, z, b.column(2)], schema.names)

        tasks = min(n, MOST_TASKS)
        dealt = rows.mapInArrow(pack, schema).repartition(tasks, "pid")
        made = dealt.groupBy("pid").agg(F.collect_list(F.struct("id", "z", "rest")).alias("docs"))
        return cls(_laid_out(made), tasks, limits, total)

    def parts(self, text: int | None = None) -> int:
        """Parts for the keys of so many bytes of text, by default of all."""
        least = min(2 * self.table.sparkSession.sparkContext.defaultParallelism, self.tasks)
        return int(max(least, (self.total if text is None else text) // PART_BYTES + 1))

    def knowing(self, rows: DataFrame) -> Corpus:
        """The corpus with more answers, rows of (pid, kind, part, ans, hits), beside its blocks."""
        told = rows.repartition(self.tasks, "pid").groupBy("pid").agg(F.collect_list(F.struct("kind", "part", "ans", "hits")).alias(f"answers{len(self.answers)}"))
        return Corpus(self.table, self.tasks, self.limits, self.total, (*self.answers, _laid_out(told)))

    def knowing_ids(self, rows: DataFrame, kind: str) -> Corpus:
        """The corpus with the ids of rows of (pid, ids) as an answer to each block, ascending."""

        def packed(batches):
            for b in batches:
                raw = [squeeze(np.sort(np.asarray(x.values)).astype("<i8").tobytes()) for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([kind] * b.num_rows), pa.array([0] * b.num_rows, pa.int32()), pa.array(raw, pa.binary()), pa.array([0] * b.num_rows, pa.int64())], ["pid", "kind", "part", "ans", "hits"])

        return self.knowing(rows.select("pid", "ids").mapInArrow(packed, ANSWER))

    def hits(self) -> int:
        """Keys that the last question found to be of use, with their weights."""
        return self.answers[-1].select(F.explode(self.answers[-1].columns[1]).alias("a")).agg(F.sum("a.hits").alias("n")).head()["n"] or 0

    def _rows(self) -> DataFrame:
        out = self.table.select("pid", "docs")
        for a in self.answers:
            out = out.join(a.hint("shuffle_hash"), "pid", "left")
        return out

    def visit(self, schema: T.StructType | str, rows: Callable) -> DataFrame:
        """rows(block, inner, answers) yields record batches of the schema, for each block."""

        def run(batches):
            for b in batches:
                for block, inner, got in _blocks_of(b):
                    yield from rows(block, inner, got)

        return self._rows().mapInArrow(run, schema)

    def ask(self, kind: str, parts: int, entries: Callable, answer: Callable) -> Corpus:
        """One round; entries(block, answers, parts) yields (part, packed keys), answer([(pid, packed keys)]) of one part gives
        for each block (width, packed answers, how many are of use), width 0 where they are squeezed and else that of records by planes."""

        def send(batches):
            for b in batches:
                for block, _, got in _blocks_of(b):
                    found = list(entries(block, got, parts))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([block.pid] * len(found), pa.int32()), pa.array([p for p, _ in found], pa.int32()), pa.array([k for _, k in found], pa.binary())], ["pid", "part", "keys"])

        def reply(part: int, held: list[tuple[int, bytes]]):
            out = answer(held)
            give_back()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.int32()), pa.array([f"{kind}/{w}" if w else kind for w, _, _ in out]), pa.array([part] * len(held), pa.int32()), pa.array([a for _, a, _ in out], pa.binary()), pa.array([n for _, _, n in out], pa.int64())], ["pid", "kind", "part", "ans", "hits"])

        def receive(batches):
            part, held = None, []
            for b in batches:
                for pid, p, keys in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if p != part and held:
                        yield reply(part, held)
                        held = []
                    part = p
                    held.append((pid, keys))
            if held:
                yield reply(part, held)

        sent = self._rows().mapInArrow(send, "pid int, part int, keys binary")
        each = -(-parts // MOST_TASKS)  # a reducer takes several parts in a row, one after the other
        dealt = sent.repartitionById(-(-parts // each), F.expr(f"part div {each}").cast("int"))
        return self.knowing(dealt.sortWithinPartitions("part", "pid").mapInArrow(receive, ANSWER))

    def ask_keys(self, kind: str, parts: int, dtype, entries: Callable, answer: Callable, planes: bool = False, weight: str | None = None) -> Corpus:
        """A round of records: entries(block, answers, parts) gives (part of each, records of dtype whose field `key` ascends), answer([(pid, records)])
        gives one array for each block, as long as its records; with planes, answers travel by planes of bytes. Keys with an answer above 0 are counted, by the field `weight` if given."""

        def send(block, got, parts):
            part, keys = entries(block, got, parts)
            if len(part):
                cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                yield from zip(part[cut].tolist(), (by_planes(k, "key") for k in np.split(keys, cut[1:])), strict=True)

        def reply(held):
            keys = [(p, from_planes(k, dtype, "key")) for p, k in held]
            found = []
            for (_, k), a in zip(keys, answer(keys), strict=True):
                n = 0 if planes else int(k[weight][a > 0].sum(dtype=np.int64)) if weight else int(np.count_nonzero(a))
                found.append((a.itemsize, by_planes(a), n) if planes else (0, squeeze(a.tobytes()), n))
            return found

        return self.ask(kind, parts, send, reply)


def restored_schema(corpus: Corpus) -> T.StructType:
    return corpus.table.schema["docs"].dataType.elementType


def restored(block: Block, inner: pa.StructArray, which: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a block made with carry, text as it was."""
    for at in range(0, len(which), 500):
        some = which[at : at + 500]
        ids, texts = [block.raw_ids[i] for i in some], [None if block.packed[i] is None else expand(block.packed[i]) for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()), inner.field("rest").take(pa.array([block.order[i] for i in some], pa.int64()))], names)


def as_before(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of (id, z, rest) under the names, types and order of the columns of docs."""
    at = {id_col: F.col("id"), text_col: F.decode("z", "utf-8")}
    return rows.select(*[(at[f.name] if f.name in at else F.col(f"rest.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema.fields])


def part_of(key: np.ndarray, n: int) -> np.ndarray:
    """The part that answers for a 64-bit key; ascending in the key."""
    return (((key >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def stacked(held: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a part, and which block in turn sent each."""
    return np.concatenate([k for _, k in held]), np.repeat(np.arange(len(held)), [len(k) for _, k in held])


def unstack(values: np.ndarray, held: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    return np.split(values, np.cumsum([len(k) for _, k in held])[:-1])


def first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """Where, in sorted keys, a new combination begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new
