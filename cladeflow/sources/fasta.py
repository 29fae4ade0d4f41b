"""FASTA files: a name line that starts with '>' and one or more sequence lines; empty lines don't count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.sources import lines as L


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry: name, seq_lines, whether it is well formed, and where it stands.

    Files are split between entries, wherever their parts begin. Reading by "\\n>" leaves a '>' at the front of a file's first entry alone (a
    name may start with one).
    """
    rows = L.numbered(spark, path, "\n>")
    whole = F.transform(F.split("value", "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    first = (F.col("block") == 0) & (F.col("at") == 0)
    e = rows.withColumn("_whole", whole).withColumn("_first", first).withColumn("_full", F.filter("_whole", lambda x: x != ""))
    e = e.filter(~(F.col("_first") & (F.size("_full") == 0)))  # blank lines before the first entry, whose '>' the separator took
    e = e.withColumn("_blank", F.when(F.col("_first"), F.array_position("_whole", F.col("_full")[0]) - 1).otherwise(0))
    marked = F.when(F.col("_first"), F.col("_full")[0].startswith(">")).otherwise(True)
    name = F.when(F.col("_first"), F.regexp_replace(F.col("_full")[0], "^>", "")).otherwise(F.col("_whole")[0])
    after = F.slice("_whole", F.col("_blank").cast("int") + 2, F.size("_whole"))
    return e.select("file", "block", F.col("breaks") + F.col("_blank"), marked.alias("_marked"), name.alias("name"), F.filter(after, lambda x: x != "").alias("seq_lines")).toDF("file", "block", "_line", "_marked", "name", "seq_lines")


def fasta_errors(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, error, text): a file that doesn't start with '>', names without a sequence. Lines count from 1, blank ones too; that of a missing
    sequence is the one after its name."""
    kind = F.when(~F.col("_marked"), "expected name line").when(F.size("seq_lines") == 0, "expected sequence line")
    bad = _entries(spark, path).withColumn("error", kind).filter("error is not null")
    at = F.col("lines") + F.col("_line") + F.when(F.col("_marked"), 2).otherwise(1)
    return bad.join(L.lines_before(L.numbered(spark, path, "\n>")), ["file", "block"]).select("file", at.alias("line"), "error", F.col("name").alias("text"))


def read_fasta(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(name, seq_lines, file). Strict: an entry that isn't well formed fails the job; else such entries are left out.

    Nothing is shuffled, so the error of a strict reader names the part of the file that it is in; `fasta_errors` has all of them by line.
    """
    e = _entries(spark, path)
    good = F.col("_marked") & (F.size("seq_lines") > 0)
    if not strict:
        return e.filter(good).select("name", "seq_lines", "file")
    at = F.concat(F.lit(" (line "), (F.col("_line") + 1).cast("string"), F.when(F.col("block") == 0, "").otherwise(F.concat(F.lit(" from byte "), F.col("block").cast("string"))), F.lit(")"))
    told = F.raise_error(F.concat(F.col("file"), F.lit(": no well-formed FASTA entry: "), F.col("name"), at)).cast("boolean")
    return e.filter(F.when(good, True).otherwise(told)).select("name", "seq_lines", "file")


def write_fasta(fasta: DataFrame, path: str) -> None:
    """Name lines and sequence lines as they were."""
    fasta.select(F.concat_ws("\n", F.concat(F.lit(">"), F.col("name")), "seq_lines").alias("value")).write.text(path)
