"""Text records that know where they stand: their file, the part of it that was read together, and their number in that part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBERED = "value string, file string, block long, at long, breaks long"


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, at, breaks = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        value, file, block = b.columns
        place = block.to_numpy(zero_copy_only=False)
        new = np.r_[(file[0].as_py(), int(place[0])) != last, (place[1:] != place[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)]
        step = pc.add(pc.count_substring(value, "\n"), 1).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.cumsum(step) - step
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        number = np.arange(len(new)) - first
        line = before - before[np.maximum(first, 0)]
        goes_on = first < 0  # rows of the part that the batch before ended in
        number[goes_on], line[goes_on] = at + np.arange(goes_on.sum()), breaks + before[goes_on]
        last, at, breaks = (file[-1].as_py(), int(place[-1])), int(number[-1]) + 1, int(line[-1] + step[-1])
        yield pa.RecordBatch.from_arrays([value, file, block, pa.array(number), pa.array(line)], ["value", "file", "block", "at", "breaks"])


def numbered(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(value, file, block, at, breaks): records, the byte where their part of the file begins, and how many records and line breaks of that part stand before each.

    Rows are numbered as they are read; nothing is shuffled. A file's first record is that of block 0 and number 0.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    raw = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return raw.mapInArrow(_numbers, NUMBERED)


def lines_before(rows: DataFrame) -> DataFrame:
    """(file, block, lines): the line breaks of a file before each of its parts, a row a part."""
    parts = rows.groupBy("file", "block").agg(F.max(F.col("breaks") + F.length("value") - F.length(F.replace("value", F.lit("\n"))) + 1).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines"))
