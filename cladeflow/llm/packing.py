"""Hierarchical multi-length packing (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encoding import encoder
from .quality import chunked

POOL_BYTES = 2 << 20  # text whose documents are packed together
TIERS = (1024, 512, 256, 128)  # powers of two, so that a full window of any tier needs no padding


class Tiers:
    """Pieces (document, start, length) waiting in the tier of the smallest window that holds them."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        self.waiting: dict[int, list] = {t: [] for t in tiers}

    def route(self, doc: int, start: int, length: int) -> None:
        """Queue a piece shorter than the longest window."""
        if length:
            self.waiting[min(t for t in self.tiers if t >= length)].append((doc, start, length))

    def take(self, most: int, below: int) -> tuple[int, int, int] | None:
        """A piece of at most `most` tokens: whole from the longest tier that fits, else cut from the shortest that waits."""
        whole = next((t for t in self.tiers if t <= most and self.waiting[t]), None)
        if whole:
            return self.waiting[whole].pop()
        other = next((t for t in reversed(self.tiers) if t <= below and self.waiting[t]), None)
        if other is None:
            return None
        doc, start, length = self.waiting[other].pop()
        if length > most:
            self.route(doc, start + most, length - most)
        return doc, start, min(length, most)

    def windows(self) -> Iterator[tuple[int, list]]:
        """Pack each tier, longest first; gaps are filled from shorter tiers, then from the tier itself."""
        for tier in self.tiers:
            while self.waiting[tier]:
                held = [self.waiting[tier].pop()]
                gap = tier - held[0][2]
                while gap and (piece := self.take(gap, tier)):
                    held.append(piece)
                    gap -= piece[2]
                if gap:
                    yield from self.halves(held)  # nothing is left to fill it
                else:
                    yield tier, held

    @staticmethod
    def halves(held: list) -> Iterator[tuple[int, list]]:
        """Cut a last, unfilled window into windows of powers of two."""
        left = sum(p[2] for p in held)
        while left:
            size = 1 << (left.bit_length() - 1)
            out, need = [], size
            while need:
                doc, start, length = held.pop(0)
                if length > need:
                    held.insert(0, (doc, start + need, length - need))
                out.append((doc, start, min(length, need)))
                need -= out[-1][2]
            yield size, out
            left -= size


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, tiers: tuple[int, ...] = TIERS, step_tokens: int = 8192, kind: str = "bytes", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, end each with end_id, and pack them into sequences that need no padding.

    A document's whole windows of the longest tier are sequences of their own; what remains is routed to
    the shortest tier that holds it, and each tier is packed with gaps filled from shorter ones. Work is
    done on POOL_BYTES of text at a time within a task, so that memory is bounded and nothing is shuffled;
    the last window of each is cut into powers of two.

    Returns one row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset, tier (the sequence's length), step (groups of
    sequences of one tier that together hold step_tokens). A null or empty text is the end id alone;
    repeated rows and rows without an id are documents of their own; an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("z"))
    schema = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("tier", T.IntegerType()), ("step", T.LongType()))])
    end, longest = np.array([end_id], "<u4").tobytes(), tiers[0]

    def run(batches):
        base, number, groups = TaskContext.get().partitionId() << 40, 0, {}
        code = encoder(tokenizer, kind)
        for begin, texts, b in ((i, t, b) for b in batches for i, t in chunked(b, 1, POOL_BYTES)):
            ids, queue, out = b.column(0).slice(begin, len(texts)).to_pylist(), Tiers(tiers), []
            data = [p + end for p in code.encode(texts)]

            def put(size, pieces, out=out, ids=ids, data=data):
                nonlocal number
                tier_step = groups.get(size, 0)
                groups[size], at = tier_step + 1, 0
                step = base + (size.bit_length() << 34) + tier_step // max(1, step_tokens // size)
                for doc, start, length in pieces:
                    out.append((ids[doc], start, length, data[doc][4 * start : 4 * (start + length)], len(data[doc]) // 4, base + number, at, size, step))
                    at += length
                number += 1

            for doc, d in enumerate(data):
                n = len(d) // 4
                for start in range(0, n - n % longest, longest):
                    put(longest, [(doc, start, longest)])
                queue.route(doc, n - n % longest, n % longest)
            for size, pieces in queue.windows():
                put(size, pieces)
            for i in range(0, len(out), 20_000):
                cols = zip(*out[i : i + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], schema.names)

    return rows.mapInArrow(run, schema)


def op8_multi_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step")
