"""A training-corpus pipeline: each stage takes and gives documents, written between stages.

Documents of low quality go, one document of each group of near duplicates stays, passages that an earlier
document has are cut out, sources are mixed to target weights, and what is left is encoded and packed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.llm import blocks, dedup, jaccard, mixing, packing, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the isolation forest keep, as they were.

    Null and blank texts fail the rules; repeated rows are judged alike, and a row without an id like any other; an empty table
    stays empty; more columns, of any names, are carried.
    """
    into = blocks.fresh("_rules", docs.columns)
    return quality.quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), into=into).filter(F.col(f"{into}.kept")).drop(into)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their 5-word shingles, directly or through others, that of the smallest id.

    Null and blank texts are like no other and stay, as do rows without an id; of rows that share an id one stays, that of the
    smallest text; an empty table stays empty; more columns, of any names, are carried.
    """
    return jaccard.near_duplicates_removed(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word passages that an earlier one has; what is left of those is joined by single spaces.

    A document whose words all go stays, with an empty text; null, blank and short texts stay as they are, as do rows without an id; rows
    that share an id don't cut each other; an empty table stays empty. n_chars, where there is such a column, follows the text; more
    columns, of any names, are carried.
    """
    cut = dedup.substring_dedup(docs, carry=True).select(F.col("doc_id").alias("id"), F.col("kept").alias("z"), "rest", "changed")
    out = blocks.as_before(cut, docs, "doc_id", "text") if "n_chars" not in docs.columns else blocks.as_before(
        cut.withColumn("rest", cut["rest"].withField("n_chars", F.when(cut["changed"], F.char_length(F.decode("z", "utf-8")).cast("long")).otherwise(cut["rest.n_chars"]))), docs, "doc_id", "text")
    return out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as there are, shared out by flattened source weights over whole and part epochs.

    Null sources and languages are leaves of their own; rows that share an id go together; leaves without words give nothing; an empty
    table stays empty; more columns, of any names, are carried.
    """
    given = {c: blocks.fresh("_given", docs.columns) for c in docs.columns if c == "mix_epoch"}  # a column of that name is kept as it was
    mixed = mixing.mix_sources(docs.withColumnsRenamed(given)).drop("mix_epoch")
    return mixed.withColumnsRenamed({v: k for k, v in given.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of token ids. A null or empty text is the end id alone; repeated rows and rows without an id are documents of
    their own; an empty table gives no pieces; more columns don't matter."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

ORACLE_SQL = None  # shingle sets, whole-text hashes and token ids have no SQL; tests/llm holds a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared checkpoint folder and read again; what the next one has read goes."""
    blocks.shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            blocks.remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
