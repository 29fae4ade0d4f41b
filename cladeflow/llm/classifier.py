"""Supervised subword embeddings: a quality classifier trained by numpy stochastic gradient descent (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from . import kernels as K
from .quality import chunked, labelled

ROWS = 3000  # training documents of each label, at most
BUCKETS, SIZE = 1 << 17, 12
GRAMS = (3, 4)  # characters
AGAIN = np.uint64(0xA6A1)
EPOCHS, RATE = 8, 0.4
CUT = 0.7


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all words and character n-grams of the texts, and each one's text, kind by kind and piece by piece.

    A word that repeats the one before it gives one more feature, the same for all words, as a mean over
    n-grams says nothing of their order.
    """
    codes, first = K.word_codes(texts)
    n = len(texts)
    text = np.repeat(np.arange(n), np.diff(first))
    again = np.flatnonzero((codes[1:] == codes[:-1]) & (text[1:] == text[:-1]))
    yield (codes % np.uint64(BUCKETS)).astype(np.int32), text
    yield np.full(len(again), AGAIN % np.uint64(BUCKETS), np.int32), text[again]
    del codes, text, again
    chars, owner, size = [], [], 0
    for i, t in enumerate(texts):
        for _, piece in B.pieces(t, "byte", 0):
            chars.append(piece)
            owner.append(i)
            size += len(piece)
            if size >= B.CHUNK_BYTES:
                yield from _char_grams(texts, chars, owner)
                chars, owner, size = [], [], 0
    if chars:
        yield from _char_grams(texts, chars, owner)


def _char_grams(texts: list[bytes], pieces: list[bytes], owner: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams of pieces of texts. A piece that begins inside a character gives that character as unreadable bytes, as a piece's end does."""
    chars = [np.frombuffer(p.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for p in pieces]
    size = np.array([len(c) for c in chars])
    code, begin = K.mix(np.concatenate(chars).astype(np.uint64) + np.uint64(0x1F123BB5)), np.cumsum(size) - size
    for g in GRAMS:
        count = np.maximum(size - g + 1, 0)
        at = K.ranges(begin, count)
        yield (K.grams(code, g)[at] % np.uint64(BUCKETS)).astype(np.int32), np.repeat(np.array(owner), count)


class Model:
    """Vectors of hashed features, averaged per document, and a softmax layer over the two labels."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
        self.layer, self.bias = rng.normal(0, 0.5, (2, SIZE)).astype(np.float32), np.zeros(2, np.float32)
        count = np.bincount([y for _, _, y in docs], minlength=2)
        weight = len(docs) / np.maximum(2 * count, 1)
        steps, done = EPOCHS * len(docs), 0
        for _ in range(EPOCHS):
            for i in rng.permutation(len(docs)):
                bucket, share, y = docs[i]
                rate, done = RATE * (1 - done / steps), done + 1
                hidden = share @ self.vectors[bucket]
                score = self.layer @ hidden + self.bias
                p = np.exp(score - score.max())
                p /= p.sum()
                p[y] -= 1
                p *= np.float32(rate * weight[y])
                back = p @ self.layer
                self.layer -= np.outer(p, hidden)
                self.bias -= p
                # A document's mean moves as a whole; its features share the step by their weight in it.
                self.vectors[bucket] -= np.outer(share / max(float(share @ share), 1e-6), back) * np.float32(0.5)
        self.gain = (self.vectors @ (self.layer[1] - self.layer[0])).astype(np.float64)
        self.base = float(self.bias[1] - self.bias[0])


def scores(gain: np.ndarray, base: float, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1. As the layer is linear, a document's margin is the mean of its features' margins."""
    margin, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for bucket, text in features(texts):
        margin += np.bincount(text, gain[bucket], minlength=len(texts))
        count += np.bincount(text, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(margin / np.maximum(count, 1) + base, -50, 50)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = ROWS) -> Model | None:
    """Fit on at most `rows` documents of each label that aren't held out; None without any. Of rows that share an id one is taken."""
    known = labels.filter(~held_out(F.col(f"`{id_col}`")))

    def run(batches):
        for b in batches:
            for begin, texts in chunked(b, 2):
                key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for bucket, text in features(texts):
                    more, times = np.unique(text.astype(np.int64) * BUCKETS + bucket, return_counts=True)
                    key, inverse = np.unique(np.r_[key, more], return_inverse=True)
                    count = np.bincount(inverse, np.r_[count, times]).astype(np.int64)
                cut = np.searchsorted(key, np.arange(1, len(texts)) * BUCKETS)
                part = b.slice(begin, len(texts))
                pieces = [x.tobytes() for x in np.split((key % BUCKETS).astype("<i4"), cut)], [x.tobytes() for x in np.split(count.astype("<f4"), cut)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(p, pa.binary()) for p in pieces)], ["id", "y", "bucket", "count"])

    # At most 2 * rows documents' distinct features, no more than BUCKETS each, come to the driver one partition after the other.
    found = labelled(docs, known, id_col, text_col, label_col, rows).mapInArrow(run, "id long, y int, bucket binary, count binary").dropDuplicates(["id"]).toLocalIterator()
    kept = sorted(((r["id"], np.frombuffer(r["bucket"], "<i4"), np.frombuffer(r["count"], "<f4"), r["y"]) for r in found), key=lambda r: r[0])
    docs_ = [(b, c / c.sum(), y) for _, b, c, y in kept if len(b)]
    return Model(docs_) if docs_ else None


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", into: str = "quality") -> DataFrame:
    """Score every whole text: the struct column `into` (held_out, score, predicted) beside the input's.

    The model sees texts alone: vectors of hashed words and character n-grams (3 and 4), averaged over the
    document, under a softmax layer. It is trained on at most ROWS documents of each label whose
    crc32(id) mod 4 isn't 2 (labels as `quality.labelled` reads them). A null or empty text has no features and gets the model's base rate;
    without labels every score is 0.5; a row without an id isn't held out; repeated rows score alike; an
    input column of the name `into` is replaced, others may have any names; an empty table gives no rows. One pass, nothing
    shuffled; a long text is taken in pieces, and working memory is some 8 times the longest single text.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    gain, base = (model.gain, model.base) if model else (np.zeros(BUCKETS), 0.0)
    docs = docs.drop(into)
    at, score = docs.columns.index(text_col), B.fresh("_score", docs.columns)
    names = [*docs.columns, score]

    def run(batches):
        for b in batches:
            for begin, texts in chunked(b, at):
                yield pa.RecordBatch.from_arrays([*b.slice(begin, len(texts)).columns, pa.array(scores(gain, base, texts))], names)

    scored = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))
    given = F.struct(F.coalesce(held_out(F.col(f"`{id_col}`")), F.lit(False)).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= CUT).cast("int").alias("predicted"))
    return scored.withColumn(into, given).drop(score)


def op2_subword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify_quality(docs.select("doc_id", "text"), labels).select("doc_id", "quality.*")
