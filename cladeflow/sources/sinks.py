"""Writers. Spark's committer publishes a folder whole, with a _SUCCESS mark."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow.sources.files import Folder


def _csv(sep: str, header: bool, compression: str = "none") -> dict:
    """Options under which values come out as they are; those that hold a separator or a quote stand in quotes, with quotes doubled. Gzip takes its fastest level."""
    return {"compression": compression, "zlib.compress.level": "BEST_SPEED", "sep": sep, "header": header, "comment": "\u0001", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _one_line(df: DataFrame) -> DataFrame:
    """Texts with a line break fail: no line of delimited text can hold one."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    check = lambda c: F.when(F.col(f"`{c}`").contains("\n") | F.col(f"`{c}`").contains("\r"), F.raise_error(F.concat(F.lit(f"column {c}: a line can't hold "), F.col(f"`{c}`"))).cast("string")).otherwise(F.col(f"`{c}`")).alias(c)
    return df.select(*(check(c) if c in texts else F.col(f"`{c}`") for c in df.columns))


def write_dsv(df: DataFrame, path: str, sep: str = "\t", header: bool = True, compression: str = "none") -> None:
    """Delimited text that `tables.read_dsv` gives back as it was. Nulls are written as empty texts; a text with a line break fails the job.

    Compressed files (such as "gzip") are read as plain ones are, each by one task.
    """
    _one_line(df).write.options(**_csv(sep, header, compression)).csv(path)


def dsv_lines(df: DataFrame, sep: str = "\t") -> DataFrame:
    """Each row as the line of text that `write_dsv` writes."""
    return df.select(F.concat_ws(sep, *(_token(F.col(f"`{c}`").cast("string"), sep) for c in df.columns)).alias("line"))


def _token(value: Column, sep: str) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.isNull(), "").when(value.contains(sep) | value.contains('"'), quoted).otherwise(value)


def dsv_header(df: DataFrame, sep: str = "\t") -> str:
    return sep.join(df.columns)


def write_levels(predictions: DataFrame, path: str, levels: Sequence[str], compression: str = "none") -> None:
    """A folder <class_key>.tsv for each level, its header even where it has no rows; folders of those names are replaced.

    One write deals all levels out, whatever their number, and its folders then get their names. Rows of other levels are left out. Compression is `write_dsv`'s.
    """
    folder, aside, number = Folder(predictions.sparkSession, path), f"{path}/_levels-{uuid.uuid4().hex}", "_level"
    while number in predictions.columns:
        number = f"_{number}"
    key = F.array_position(F.array(*(F.lit(k) for k in levels)).cast("array<string>"), F.col("class_key"))
    _one_line(predictions).withColumn(number, key).filter(F.col(number) > 0).drop("class_key").write.partitionBy(number).options(**_csv("\t", True, compression)).csv(aside)
    for i, k in enumerate(levels, 1):
        made, named = f"{aside}/{number}={i}", f"{path}/{k}.tsv"
        folder.remove(named)
        if folder.exists(made):
            folder.move(made, named)
        else:
            folder.make(named)
            folder.write(f"{named}/part-header.csv", dsv_header(predictions.drop("class_key")) + "\n")
        folder.write(f"{named}/_SUCCESS", "")
    folder.remove(aside)


def write_levels_partitioned(predictions: DataFrame, path: str) -> None:
    _one_line(predictions).write.partitionBy("class_key").options(**_csv("\t", True)).csv(path)


def write_text(df: DataFrame, path: str) -> None:
    df.select(F.col(df.columns[0]).cast("string").alias("value")).write.text(path)
