"""Cross-entropy difference between a target's and a background's n-gram model (operator 6)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from . import kernels as K

PAIR, SINGLE, FLOOR = 0.7, 0.29, 0.01 / 2**20  # weights of bigram and unigram shares, and what any word gets
LEAST = 2  # times that the corpus has a word of the vocabulary, whatever its size; the vocabulary grows with the corpus
OTHER, BEGIN = np.uint64(0x0DDBA11), np.uint64(0x57A27)  # codes of words outside the vocabulary and of a text's begin
COUNTED = np.dtype([("key", "<u8"), ("all", "<u4"), ("target", "<u4")])
BOTH = np.dtype([("all", "<u8"), ("target", "<u8")])


def pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return K.pair(before, word)


class Words:
    """Codes of all words of a block's documents, where each document's begin, and which are of the target."""

    def __init__(self, block: B.Block, got: dict):
        codes, sizes = [], []
        for _, texts in block.chunks(all_rows=True):
            c, first = K.word_codes(texts)
            codes.append(c)
            sizes.append(np.diff(first))
        self.code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        self.size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        ids = np.frombuffer(got.get("target", b""), "<i8")
        self.target = np.r_[np.isin(block.ids, ids), np.zeros(len(self.size) - block.known, bool)]
        self.known = np.arange(len(self.size)) < block.known
        self.doc = np.repeat(np.arange(len(self.size)), self.size)

    def counts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct codes, packed with their counts in documents with an id, and each position's place among them."""
        key, inverse = np.unique(codes, return_inverse=True)
        out = np.empty(len(key), COUNTED)
        out["key"] = key
        for column, which in (("all", self.known), ("target", self.target)):
            out[column] = np.bincount(inverse, which[self.doc], minlength=len(key))
        return key, out, inverse

    def in_vocabulary(self, got: dict) -> np.ndarray:
        """Codes, with words that the corpus has too seldom as one."""
        _, _, place = self.counts(self.code)
        common = np.frombuffer(got.get("words", b""), BOTH)["all"] >= LEAST
        return np.where(common[place], self.code, OTHER)

    def bigrams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word before each, and the hash of both."""
        before = np.r_[BEGIN, words[:-1]] if len(words) else words
        first = np.cumsum(self.size) - self.size
        before[first[self.size > 0]] = BEGIN
        return before, pairs(before, words)


def _sum(held: list) -> list[np.ndarray]:
    keys, _ = B.stacked(held)
    _, inverse = np.unique(keys["key"], return_inverse=True)
    out = np.empty(len(keys), BOTH)
    for c in ("all", "target"):
        out[c] = np.bincount(inverse, keys[c].astype(np.float64))[inverse]
    return B.unstack(out, held)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every document by how much better a model of the target predicts its words than one of the whole corpus.

    Words are split at ASCII white space. Both models are bigram models interpolated with unigrams, on one
    vocabulary: the words that the whole corpus has at least LEAST times, whatever its size; other
    words are one. The target is the documents whose id is in target_ids (one column; nulls and repetitions
    don't count), the background all documents. Returns per document doc_id,
    n_tokens, ce_target, ce_background (nats a word) and ce_difference (target less background: the lower, the closer to the
    target). A null or blank text has no words and scores 0; rows without an id are scored but train
    neither model; rows that share an id are all of the target or all not; with no target its model
    is the floor alone; an empty table gives no rows.

    Counts of all distinct words, then of all distinct word pairs, are summed over the corpus in parts
    of hash space; each block gets back the sums of its own (see `blocks`).
    """
    corpus = B.Corpus.deal(docs, id_col, text_col)
    limits = corpus.limits
    only = target_ids.columns[0]

    def flag(batches):
        for b in batches:
            ids = b.column(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(limits, ids.to_numpy(zero_copy_only=False), "left").astype(np.int32)), ids], ["pid", "id"])

    ids = target_ids.select(F.col(f"`{only}`").cast("long").alias("id")).dropna().mapInArrow(flag, "pid int, id long")
    # A block's target ids are no more than its documents, give or take ids without a document.
    corpus = corpus.knowing_ids(ids.groupBy("pid").agg(F.collect_set("id").alias("ids")), "target")

    def words(block, got, n):
        w = Words(block, got)
        key, out, _ = w.counts(w.code)
        return B.part_of(key, n), out

    def bigrams(block, got, n):
        w = Words(block, got)
        key, out, _ = w.counts(w.bigrams(w.in_vocabulary(got))[1])
        return B.part_of(key, n), out

    def tally(block, inner, got):
        w = Words(block, got)
        other, t, use = w.in_vocabulary(got) == OTHER, w.target[w.doc], w.known[w.doc]
        sums = [use.sum(), t.sum(), (other & use).sum(), (other & t).sum(), (w.known & (w.size > 0)).sum(), (w.target & (w.size > 0)).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([int(s)]) for s in sums], list("abcdef"))

    corpus = corpus.ask_keys("words", corpus.parts(), COUNTED, words, _sum, planes=True)
    sums = corpus.visit(", ".join(f"{c} long" for c in "abcdef"), tally).agg(*(F.sum(c).alias(c) for c in "abcdef")).head()  # six numbers
    size = [(sums[c] or 0) for c in "abcdef"]
    corpus = corpus.ask_keys("pairs", corpus.parts(), COUNTED, bigrams, _sum, planes=True)

    def score(block, inner, got):
        w = Words(block, got)
        _, _, place = w.counts(w.code)
        sums = np.frombuffer(got.get("words", b""), BOTH)
        rare = (sums["all"] < LEAST)[place]
        words = np.where(rare, OTHER, w.code)
        before, both = w.bigrams(words)
        _, _, pair = w.counts(both)
        pair_sums = np.frombuffer(got.get("pairs", b""), BOTH)
        loss = []
        for m, column in enumerate(("all", "target")):
            count = np.where(rare, size[2 + m], sums[column][place]).astype(np.float64)
            history = np.r_[0.0, count[:-1]] if len(count) else count
            history[before == BEGIN] = size[4 + m]
            p = PAIR * pair_sums[column][pair] / np.maximum(history, 1) + SINGLE * count / max(size[m], 1) + FLOOR
            loss.append(np.bincount(w.doc, -np.log(p), minlength=len(w.size)) / np.maximum(w.size, 1))
        out = [pa.array(block.raw_ids, pa.int64()), pa.array(w.size), pa.array(loss[1]), pa.array(loss[0]), pa.array(loss[1] - loss[0])]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ce_target", "ce_background", "ce_difference"])

    return corpus.visit("doc_id long, n_tokens long, ce_target double, ce_background double, ce_difference double", score)


def op6_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to nine decimals, as sums of logarithms taken in another order differ in the last places."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = cross_entropy_difference(docs.select("doc_id", "text"), labels.filter("quality = 1").select("doc_id"))
    return scored.select("doc_id", "n_tokens", *[F.round(c, 9).alias(c) for c in scored.columns[2:]])


def _loss_sql(counts: str, whole: str, firsts: str, both: str) -> str:
    """Mean loss of a document's words; the first word's history is the number of texts with words."""
    return f"""coalesce(avg(-ln({PAIR}e0 * {both} / greatest(CASE WHEN z.before = ' ' THEN {firsts} ELSE {counts.replace("u.", "h.")} END, 1)
    + {SINGLE}e0 * {counts} / greatest({whole}, 1) + {FLOOR!r}::DOUBLE)) FILTER (u.word IS NOT NULL), 0)"""


SQL = f"""WITH t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
d AS (SELECT doc_id, t.doc_id IS NOT NULL AS aimed, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents LEFT JOIN t USING (doc_id)),
x AS (SELECT doc_id, aimed, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
seldom AS (SELECT word FROM x GROUP BY word HAVING count(*) < {LEAST}),
y AS (SELECT doc_id, aimed, i, CASE WHEN seldom.word IS NULL THEN x.word ELSE '' END AS word FROM x LEFT JOIN seldom USING (word)),
z AS (SELECT doc_id, aimed, word, lag(word, 1, ' ') OVER (PARTITION BY doc_id ORDER BY i) AS before FROM y),
u AS (SELECT word, count(*) AS a, count(*) FILTER (aimed) AS t FROM z GROUP BY word),
p AS (SELECT before, word, count(*) AS a, count(*) FILTER (aimed) AS t FROM z GROUP BY before, word),
n AS (SELECT count(*) AS words_a, count(*) FILTER (aimed) AS words_t, count(*) FILTER (before = ' ') AS texts_a, count(*) FILTER (before = ' ' AND aimed) AS texts_t FROM z),
s AS (SELECT d.doc_id, count(u.word) AS n_tokens, {_loss_sql("u.t", "words_t", "texts_t", "p.t")} AS b, {_loss_sql("u.a", "words_a", "texts_a", "p.a")} AS g
  FROM d LEFT JOIN z USING (doc_id) LEFT JOIN u ON u.word = z.word LEFT JOIN u h ON h.word = z.before LEFT JOIN p ON p.before = z.before AND p.word = z.word CROSS JOIN n
  GROUP BY d.doc_id)
SELECT doc_id, n_tokens, round(b, 9) AS ce_target, round(g, 9) AS ce_background, round(b - g, 9) AS ce_difference FROM s"""
