"""Token-id files with a minimal perfect hash index (operator 10).

A file set is a Parquet folder of one row a shard: documents of neighbouring ids, in order.
  shard     its number; shards ascend with the ids, rows without an id come last
  first     the smallest and the largest of its documents' ids (null: rows without ids); a keyed read finds
  last      its shard by them
  keys      the ids of its documents, ascending, little-endian 64-bit, compressed; for scans alone (null: rows without ids)
  index     where each key's ids are, found in constant time without the list of keys (see `Index`)
  payload   all token ids of its documents, little-endian unsigned 32-bit
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import kernels as K
from .encoding import encoder

LEVELS = 24
KEYED = 10_000  # shards up to which a keyed read names them to the scan
FILES = "shard int, first long, last long, keys binary, index binary, payload binary, n_docs long, n_tokens long"
ENTRY = np.dtype([("print", "<u4"), ("at", "<u8"), ("length", "<u4")])


def key_codes(ids: np.ndarray, copy: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit key for each of ascending ids; equal ids are told apart by their order, or by the number given."""
    copy = np.arange(len(ids)) - np.searchsorted(ids, ids) if copy is None else copy
    return K.mix(K.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(1)) + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Index:
    """Minimal perfect hash by levels of bit tables: a key's slot is the rank of its bit.

    At each level the keys still without a place hash into a table of twice their number; those alone
    in their place keep it, the rest go on. Keys left after all levels, which for different keys
    takes a chance of about 2**-LEVELS each, stand in a short sorted list. Each slot has a fingerprint
    of its key, so that a key that isn't there is refused but for one in 2**32.
    """

    def __init__(self, tables: list[np.ndarray], rest: np.ndarray, entries: np.ndarray):
        self.tables, self.rest, self.entries = tables, rest, entries
        self.ranks = [np.cumsum(t) - t for t in tables]
        self.before = np.r_[0, np.cumsum([int(t.sum()) for t in tables])]

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (K.mix(keys + np.uint64((level + 1) * 0xA0761D6478BD642F % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, at: np.ndarray, length: np.ndarray) -> Index:
        tables, left = [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            place = cls.place(left, level, 2 * len(left))
            alone = np.bincount(place, minlength=2 * len(left)) == 1
            tables.append(alone)
            left = left[~alone[place]]
        index = cls(tables, np.sort(left), np.zeros(len(keys), ENTRY))
        slot = index.slots(keys)
        index.entries["print"][slot], index.entries["at"][slot], index.entries["length"][slot] = K.mix(keys) >> np.uint64(32), at, length
        return index

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, table in enumerate(self.tables):
            place = self.place(keys[todo], level, len(table))
            hit = table[place]
            out[todo[hit]] = self.before[level] + self.ranks[level][place[hit]]
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            place = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[place] == keys[todo]
            out[todo[hit]] = self.before[-1] + place[hit]
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is there, and its payload's first byte and length."""
        slot = self.slots(keys)
        hit = slot >= 0
        entry = self.entries[np.where(hit, slot, 0)] if len(self.entries) else np.zeros(len(keys), ENTRY)
        return hit & (entry["print"] == (K.mix(keys) >> np.uint64(32))), entry["at"], entry["length"]

    def dump(self) -> bytes:
        sizes = np.array([len(self.entries), len(self.rest), len(self.tables), *(len(t) for t in self.tables)], "<u4")
        return sizes[:3].tobytes() + sizes[3:].tobytes() + b"".join(np.packbits(t).tobytes() for t in self.tables) + self.rest.astype("<u8").tobytes() + self.entries.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Index:
        n, rest, levels = np.frombuffer(raw, "<u4", 3).tolist()
        sizes, at, tables = np.frombuffer(raw, "<u4", levels, 12).tolist(), 12 + 4 * levels, []
        for s in sizes:
            tables.append(np.unpackbits(np.frombuffer(raw, np.uint8, (s + 7) // 8, at), count=s).astype(bool))
            at += (s + 7) // 8
        return cls(tables, np.frombuffer(raw, "<u8", rest, at), np.frombuffer(raw, ENTRY, n, at + 8 * rest))


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1, kind: str = "words", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, end it with end_id and write the file set `out`, in ascending order of id.

    A null or empty text has the end id alone. Rows that share an id are ordered by text; rows without
    an id come last, in an order of their own. An empty table gives an empty file set; other columns don't matter. A shard holds
    about blocks.BLOCK_BYTES of text, and working memory follows that and the longest single text.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("z"))
    lengths, total = B.measured(rows)
    n = B.block_count(docs.sparkSession, total)
    limits = B.limits_between(lengths, n)
    end = np.array([end_id], "<u4").tobytes()

    def deal(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            shard = np.searchsorted(limits, ids.fill_null(0).to_numpy(zero_copy_only=False), "left").astype(np.int32)
            for i in np.flatnonzero(np.asarray(ids.is_null())):
                shard[i] = len(limits) + 1 + B.spread(texts[i], n)
            yield pa.RecordBatch.from_arrays([pa.array(shard), ids, pa.array([B.squeeze(t) for t in texts], pa.binary())], ["shard", "id", "z"])

    def row(shard: int, ids: list, packed: list):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] or 0, B.expand(packed[i])))
        code, made, texts, size = encoder(tokenizer, kind), [], [], 0
        for k, i in enumerate(order, 1):
            texts.append(B.expand(packed[i]))
            size += len(texts[-1])
            if size >= B.CHUNK_BYTES or k == len(order):
                made += code.encode(texts)
                texts, size = [], 0
        length = np.array([len(m) + 4 for m in made], np.int64)
        keys = np.array([ids[i] or 0 for i in order], np.int64)
        index = Index.build(key_codes(keys), np.cumsum(length) - length, length)
        named = None if None in ids else B.squeeze(keys.astype("<i8").tobytes())  # a shard has ids, or is that of the rows without
        limits = (None, None) if None in ids else (int(keys[0]), int(keys[-1]))
        return shard, *limits, named, index.dump(), b"".join(x for m in made for x in (m, end)), len(made), int(length.sum()) // 4

    def write(batches):
        shard, ids, packed = None, [], []
        names, kinds = ["shard", "first", "last", "keys", "index", "payload", "n_docs", "n_tokens"], [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        made = lambda: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row(shard, ids, packed), kinds, strict=True)], names)
        for b in batches:
            for s, i, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != shard and ids:
                    yield made()
                    ids, packed = [], []
                    B.give_back()
                shard = s
                ids.append(i)
                packed.append(z)
        if ids:
            yield made()

    dealt = rows.mapInArrow(deal, "shard int, id long, z binary").repartition(min(n, B.MOST_TASKS), "shard").sortWithinPartitions("shard")
    dealt.mapInArrow(write, FILES).write.option("compression", "zstd").parquet(out)


def _starts(files: DataFrame) -> DataFrame:
    """Token ids before each shard; one row of 12 bytes for about blocks.BLOCK_BYTES of text."""
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("shard", "n_tokens").withColumn("before", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).select("shard", "before")


def scan_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of every document, each found by its key in the index."""
    files = spark.read.schema(FILES).parquet(path)
    # A row of 12 bytes a shard is broadcast, some millionth of the text.
    placed = files.join(F.broadcast(_starts(files)), "shard").select("shard", "before", "keys", "index", "payload", "n_docs")
    last = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"

    def run(batches):
        for b in batches:
            for shard, before, keys, index, payload, n in zip(*(c for c in b.columns), strict=True):
                named = keys.is_valid
                ids = np.frombuffer(B.expand(keys.as_py()), "<i8") if named else np.zeros(n.as_py(), np.int64)
                there, at, length = Index.load(index.as_py()).find(key_codes(ids))
                if not there.all():
                    raise ValueError(f"shard {shard.as_py()}: its index lacks {int((~there).sum())} of its keys")
                data = memoryview(payload.as_buffer())
                crc = [zlib.crc32(data[a : a + m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=np.full(len(ids), not named)), pa.array(before.as_py() + at.astype(np.int64) // 4), pa.array(length.astype(np.int64) // 4), pa.array(crc, pa.int64()), pa.array([shard.as_py()] * len(ids), pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return placed.mapInArrow(run, last)


def read_documents(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The documents of the given ids (one column): doc_id, copy (0, 1, ... of documents that share an id), n_tokens, ids (little-endian 32-bit).

    A key's shard is found by the shards' limits, its slot by the shard's perfect hash, and the slot's fingerprint
    says whether it is that key's: ids that the files lack give no row. Only shards that are asked for are read where they
    are at most KEYED, by a filter that the scan gets. Nulls and repeated ids count once or not at all.
    """
    files = spark.read.schema(FILES).parquet(path)
    limits = files.filter("first is not null").select("shard", "first", "last").orderBy("first").toPandas()  # 20 bytes a shard
    shard, first, last = (limits[c].to_numpy(np.int64) for c in limits.columns)

    def place(batches):
        for b in batches:
            found = b.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(first, found, "right") - 1
            some = np.flatnonzero((at >= 0) & (found <= last[np.maximum(at, 0)])) if len(first) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard[at[some]].astype(np.int32)), pa.array(found[some])], ["shard", "id"])

    wanted = ids.select(F.col(f"`{ids.columns[0]}`").cast("long").alias("id")).dropna().mapInArrow(place, "shard int, id long").groupBy("shard").agg(F.collect_set("id").alias("ids"))
    few = wanted.select("shard").limit(KEYED + 1).collect()
    held = files.select("shard", "index", "payload")
    if len(few) <= KEYED:
        held = held.filter(F.col("shard").isin([r["shard"] for r in few]))

    def run(batches):
        for b in batches:
            for ids, index, payload in zip(b.column(0), b.column(1), b.column(2), strict=True):
                index, data, left, copy = Index.load(index.as_py()), memoryview(payload.as_buffer()), np.sort(np.asarray(ids.values)), 0
                while len(left):
                    there, at, length = index.find(key_codes(left, np.full(len(left), copy)))
                    left, at, length = left[there], at[there].tolist(), length[there].tolist()
                    tokens = [bytes(data[a : a + m]) for a, m in zip(at, length, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(left), pa.array([copy] * len(left), pa.int32()), pa.array([m // 4 for m in length], pa.int64()), pa.array(tokens, pa.binary())], ["doc_id", "copy", "n_tokens", "ids"])
                    copy += 1

    return held.join(wanted, "shard").select("ids", "index", "payload").mapInArrow(run, "doc_id long, copy int, n_tokens long, ids binary")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    B.shared_checkpoints(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/token-files-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), out, public_tokenizers.path("word_bpe_49k.json"))
    return scan_token_files(spark, out).drop("shard")
