"""Exact removal of repeated passages, by words (operator 4) and by bytes (operator 5)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from . import kernels as K
from . import repeats as R


CROWD = 200_000  # stretches of one anchor beyond which they travel by whole windows


def _strip(docs: DataFrame, id_col: str, text_col: str, plan: R.Plan, resolver, keep, carry: bool) -> DataFrame:
    """keep(text, first units of removed windows, window) gives (units, removed, stretches, kept bytes, changed)."""
    corpus, parts = R.find(B.Corpus.deal(docs, id_col, text_col, carry), plan, resolver)
    rest = B.restored_schema(corpus)["rest"].dataType
    schema = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.LongType()) for c in ("n_units", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType()), T.StructField("changed", T.BooleanType()), T.StructField("kept_sha256", T.StringType()), T.StructField("rest", rest)])

    def rows(block, inner, got):
        copy, doc, start = resolver.gone(block, got, parts)
        order = np.argsort(doc, kind="stable")
        doc, start = doc[order], start[order]
        for begin, texts in block.chunks(all_rows=True):
            out = []
            for i, t in enumerate(texts, begin):
                lo, hi = np.searchsorted(doc, [i, i + 1])
                units, gone, spans, kept, changed = keep(t, start[lo:hi], plan.window, i < block.known and bool(copy[i]))
                null = block.packed[i] is None
                out.append((block.raw_ids[i], units, gone, spans, (None if null else kept if changed else t) if carry else None, changed, hashlib.sha256(kept).hexdigest()))
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, inner.field("rest").take(pa.array(block.order[begin : begin + len(texts)]))], schema.names)

    return corpus.visit(schema, rows)


def _keep_words(text: bytes, start: np.ndarray, window: int, copy: bool) -> tuple:
    found = text.split()
    if copy and len(found) >= window:
        return len(found), len(found), 1, b"", True
    if not len(start):
        return len(found), 0, 0, b" ".join(found), False
    gone = K.covered(len(found), start, start + window)
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
    return len(found), int(gone.sum()), spans, b" ".join([found[i] for i in np.flatnonzero(~gone)]), True


def _keep_bytes(text: bytes, start: np.ndarray, window: int, copy: bool) -> tuple:
    if copy and len(text) >= window:
        return len(text), len(text), 1, b"", True
    if not len(start):
        return len(text), 0, 0, text, False
    gone = K.covered(len(text), start, start + window)
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
    return len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes(), True


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, carry: bool = False, crowd: int = CROWD) -> DataFrame:
    """Remove each word that a window of `window` words covers whose words also start in a document with a smaller id.

    Words are split at ASCII white space and taken unchanged. Returns doc_id, n_units (words), n_removed,
    n_spans (removed stretches), changed, kept_sha256 (of the kept words joined by a space) and, if carry,
    kept (those bytes; the text as it was where nothing went) and rest (the other columns). A null or blank text has no
    words; a document shorter than the window loses nothing; rows that share an id don't affect each
    other; a row without an id neither loses nor takes text; an empty table gives no rows; columns of the input may have any
    names. A long text is taken in overlapping pieces of about blocks.CHUNK_BYTES, so working memory
    follows the block size, and the longest single text only by that text itself.
    """
    plan = R.Plan("word", window, max(1, window // 2), max(1, window // 6), crowd)
    return _strip(docs, id_col, text_col, plan, R.SuffixTrees(plan), _keep_words, carry)


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, carry: bool = False, crowd: int = CROWD) -> DataFrame:
    """Remove each byte that a `window`-byte string covers which also starts in a document with a smaller id.

    As `substring_dedup`, over UTF-8 bytes; a null text is empty. kept may split a multi-byte character.
    """
    plan = R.Plan("byte", window, window, max(1, window // 3), crowd)
    return _strip(docs, id_col, text_col, plan, R.PreviousFactors(plan), _keep_bytes, carry)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_array_dedup(docs).select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
SQL_WORDS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM s) WHERE f < doc_id),
cut AS (SELECT DISTINCT doc_id, i + k AS p FROM gone, range(50) t(k)),
x AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, count(cut.p) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (cut.p IS NULL) AS kept FROM x LEFT JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
SQL_BYTES = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM s) WHERE f < doc_id),
runs AS (SELECT doc_id, i, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS b FROM gone)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, r),
pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS o FROM spans),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * o + 1, 2 * (a - o)), '' ORDER BY a) || substr(first(h), 2 * max(b) + 1) AS kept FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
