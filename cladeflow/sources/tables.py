"""Delimiter-separated text, hit tables, class tables and the index that names them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow import schemas
from cladeflow.functions.columns import accession
from cladeflow.sources import lines

# How numbers are written.
NUMBERS = {
    T.IntegerType: r"^[+-]?[0-9]+$", T.LongType: r"^[+-]?[0-9]+$",
    T.DoubleType: r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^(NaN|[+-]?Infinity)$",
}


def _typed(token: Column, kind: T.DataType) -> Column:
    """A token's value, null if it has none of that type; no text is null, the empty one neither."""
    if isinstance(kind, T.StringType):
        return F.coalesce(token, F.lit(""))
    written = NUMBERS.get(type(kind))
    return (F.when(token.rlike(written), token) if written else token).try_cast(kind)


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """The rows with a value that is worked out once a row. As a plain column it would be worked out again for every condition and column that is made
    from it; what is made of a generator's rows isn't."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _parsed(spark: SparkSession, path: str, schema: T.StructType, sep: str, header: bool, comment: str | None) -> DataFrame:
    """(file, row, good, typed columns as a struct) of each line but headers and comments.

    A line is split at separators outside quotes; a quote inside quotes is doubled. It is good if it has as many tokens as there
    are columns and each is written as its column's type. Lines are read whole, blank ones too.
    """
    if header:
        rows = lines.numbered(spark, path).filter("not (block = 0 and at = 0)").select("value", "file")
    else:
        rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    if comment:
        rows = rows.filter(~F.col("value").startswith(comment))
    names = [f"c{i}" for i in range(len(schema.fields))]
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    tokens = F.from_csv("value", ", ".join(f"{n} string" for n in [*names, "bad"]), options)
    values = [_typed(F.col(f"t.{n}"), f.dataType).alias(f.name) for n, f in zip(names, schema.fields, strict=True)]
    typed = _once(_once(rows, tokens, "t"), F.struct(*values), "v").select("file", F.col("value").alias("row"), F.col("t.bad").alias("bad"), "v")
    alone = len(names) == 1 and isinstance(schema.fields[0].dataType, T.StringType)  # a blank line is its one, empty text
    whole = reduce(lambda a, f: a & F.col(f"v.`{f.name}`").isNotNull(), schema.fields, F.lit(alone) | (F.length("row") > 0) & F.col("bad").isNull())
    return typed.select("file", "row", whole.alias("good"), "v")


def read_dsv(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t", header: bool = True, comment: str | None = None) -> DataFrame:
    """Typed columns by position; header names are skipped, and the first bad row fails the job, also where a query uses no column.

    Bad are blank lines, lines of too few or too many values, and values that aren't written as their type, such as empty numbers.
    """
    rows = _parsed(spark, path, schema, sep, header, comment)
    told = F.concat(F.col("file"), F.lit(f": bad row (expected columns {', '.join(schema.names)}, separated by {sep!r}): "), F.col("row"))
    return rows.filter(F.when(F.col("good"), True).otherwise(F.raise_error(told).cast("boolean"))).select("v.*")


def read_dsv_either(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t", header: bool = True, comment: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows, and (file, row, expected, sep) of the bad ones (see `read_dsv`)."""
    rows = _parsed(spark, path, schema, sep, header, comment)
    bad = rows.filter(~F.col("good")).select("file", "row", F.lit(", ".join(schema.names)).alias("expected"), F.lit(sep).alias("sep"))
    return rows.filter("good").select("v.*"), bad


def read_tokens(spark: SparkSession, path: str, schema: T.StructType, tokens: Callable[[Column], Column], is_comment: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad rows (file, row) of a text whose lines `tokens` splits into an array of texts."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    if is_comment is not None:
        rows = rows.filter(~is_comment(F.col("value")))
    values = F.struct(*(F.try_element_at("t", F.lit(i + 1)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)))
    split = _once(_once(rows, tokens(F.col("value")), "t"), values, "v")
    whole = reduce(lambda a, f: a & F.col(f"v.`{f.name}`").isNotNull(), schema.fields, F.size("t") >= len(schema.fields))
    return split.filter(whole).select("v.*"), split.filter(~whole).select("file", F.col("value").alias("row"))


def read_tblout(spark: SparkSession, path: str, description: str = "first_word") -> tuple[DataFrame, DataFrame]:
    """Hits and bad rows of profile-search tables: '#' lines are comments, columns stand apart by runs of spaces.

    description "first_word" ends the last column at its first space; "full" keeps it whole. A line that
    begins with a space is a bad row.
    """
    n = len(schemas.HITS)
    split = lambda v: F.when(v.startswith(" "), F.array().cast("array<string>")).otherwise(F.split(v, " +", n if description == "full" else -1))
    good, bad = read_tokens(spark, path, schemas.HITS, split, lambda v: v.startswith("#"))
    return good.withColumns({c: accession(F.col(c)) for c in ("target_accession", "query_accession")}), bad


def read_classification(spark: SparkSession, path: str) -> DataFrame:
    return read_dsv(spark, path, schemas.MODEL_CLASSES)


def read_score_samples(spark: SparkSession, path: str) -> DataFrame:
    return read_dsv(spark, path, schemas.SCORE_SAMPLES, header=False)


def read_levels(spark: SparkSession, index: Sequence[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Model classes and score samples of all levels (class_key, classes path, samples path), with their class_key."""
    level = lambda df, key: df.select(F.lit(key).alias("class_key"), "*")
    classes = [level(read_classification(spark, c), key) for key, c, _ in index]
    samples = [level(read_score_samples(spark, s), key) for key, _, s in index]
    return reduce(DataFrame.unionByName, classes), reduce(DataFrame.unionByName, samples)


class IndexFormatError(ValueError):
    """A data index that can't be understood."""


def load_index(spark: SparkSession, path: str) -> tuple[list[tuple[str, str, str]], str | None]:
    """Levels (class_key, classes path, samples path) and the model file that a YAML data index names.

    Only nested mappings of plain texts are understood. Paths are relative to the index's own folder.
    """
    text = [r["value"] for r in spark.read.text(path, wholetext=True).limit(1).collect()]
    found: dict = {}
    open_maps: list[tuple[int, dict]] = [(-1, found)]
    for line in "".join(text).splitlines():
        told = line.split(" #")[0].rstrip()
        if not told.strip() or told.lstrip().startswith("#") or told.strip() == "---":
            continue
        key, colon, value = told.strip().partition(":")
        indent = len(told) - len(told.lstrip())
        if not colon or "\t" in told[:indent]:
            raise IndexFormatError(f"{path}: not understood: {line!r}")
        while open_maps[-1][0] >= indent:
            open_maps.pop()
        value = value.strip().strip("'\"")
        open_maps[-1][1][key.strip("'\"")] = value if value else (inner := {})
        if not value:
            open_maps.append((indent, inner))
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    at = lambda p: p if p.startswith("/") or "://" in p else f"{folder}/{p}"
    try:
        levels = [(key, at(v["modelClassesFile"]), at(v["scoreSamplesFile"])) for key, v in found["classificationFiles"].items()]
    except (KeyError, TypeError, AttributeError) as e:
        raise IndexFormatError(f"{path}: no classification files: {e}") from e
    return levels, at(found["vpfsFile"]) if isinstance(found.get("vpfsFile"), str) else None
