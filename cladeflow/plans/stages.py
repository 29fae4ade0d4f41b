"""Stage tables and chunk ledgers: what was finished is read again, if it was made from the same inputs."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow.sources.files import Folder

STAGES = ("genomes", "proteins", "search", "processed")
LEAF = 4096  # entry digests that one digest is made of, about
MANIFEST = "_manifest.json"
SPREAD = 8  # tasks that write one share of a ledger's work


class StageError(RuntimeError):
    """A stage's records can't be read or don't fit it."""


class ChunkError(RuntimeError):
    """Some chunks failed; the others are kept."""


# Content keys


def entry_digest(*columns: str) -> Column:
    """A SHA-256 of a row's columns, by name; nulls differ from empty texts, and no two rows are written alike."""
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns))), 256)


def entry_keys(df: DataFrame, *columns: str) -> DataFrame:
    """The rows with a SHA-256 of the chosen columns."""
    return df.withColumn("entry_key", entry_digest(*columns))


def content_key(df: DataFrame, *columns: str) -> str:
    """A key of the rows' content, whatever their order: their number and the root of a tree of SHA-256.

    Leaves are the sorted digests of rows that share their first hexadecimal digits, each once with how often it is there; digests of
    leaves are joined by ever fewer digits. How many digits follows from the number of different rows, so the tree is the same however rows are dealt,
    and no leaf grows with the table.
    """
    names = list(columns or df.columns)
    packed = df.select(F.unhex(entry_digest(*names)).alias("d")).groupBy("d").agg(F.count("*").alias("n"))  # dealt and kept in half the bytes
    rows = kept(packed).withColumn("d", F.lower(F.hex("d")))
    size = rows.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()
    digits = 0
    while size["kinds"] > LEAF * 16**digits:
        digits += 1
    of = lambda parts: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda p: F.concat_ws(":", p["d"], p["n"].cast("string"))), ","), 256)
    level = rows.groupBy(F.substring("d", 1, digits).alias("p")).agg(of(F.struct("d", "n")).alias("h"))
    while digits:
        digits = max(0, digits - 2)
        level = level.groupBy(F.substring("p", 1, digits).alias("p")).agg(of(F.struct(F.col("p").alias("d"), F.col("h").alias("n"))).alias("h"))
    root = level.head()
    return f"{size['n']:x}-{root['h'] if root else hashlib.sha256().hexdigest()}"


def digest(made_of: dict) -> str:
    """A short key of a manifest."""
    return hashlib.sha256(json.dumps(made_of, sort_keys=True).encode()).hexdigest()[:24]


# Stages


def finished(spark: SparkSession, path: str) -> bool:
    return Folder(spark, path).exists(f"{path}/_SUCCESS")


def stage(spark: SparkSession, work_dir: str, key: str, name: str, build: Callable[[], DataFrame], made_of: dict | None = None) -> DataFrame:
    """The stage's table: read if it was finished, else built and written whole.

    made_of is the stage's manifest: what it is made from, such as content keys of its inputs and its parameters. Each manifest has a folder of
    its own, so that a table is only ever read by those who would build the same, and one that was given out stays as it was. A stage that
    broke off has no _SUCCESS mark, or no manifest yet, and is built again over what it left.
    """
    path = f"{work_dir}/{key}/{name}" + (f"/{digest(made_of)}" if made_of is not None else "")
    if not finished(spark, path) or not (made_of is None or _was_made_of(spark, path, made_of)):
        build().write.mode("overwrite").parquet(path)
        if made_of is not None:
            Folder(spark, path).write(f"{path}/{MANIFEST}", json.dumps(made_of, sort_keys=True, indent=1))
    return spark.read.parquet(path)


def _was_made_of(spark: SparkSession, path: str, made_of: dict) -> bool:
    """Whether the manifest is there; an error if it can't be read or is another's."""
    folder, file = Folder(spark, path), f"{path}/{MANIFEST}"
    if not folder.exists(file):
        return False
    try:
        found = json.loads(folder.read(file))
    except ValueError as e:
        raise StageError(f"{file} can't be read ({e}); delete {path} and run again") from e
    if found != json.loads(json.dumps(made_of)):
        raise StageError(f"{file} isn't the manifest of this stage; delete {path} and run again")
    return True


# Ledgers of chunks


def remaining(chunks: DataFrame, done: DataFrame, key: str = "chunk_key") -> DataFrame:
    """Chunks whose key isn't among those done."""
    return chunks.join(done.select(key).distinct(), key, "left_anti")


@contextmanager
def _dealt(rows: DataFrame, key: str, count: int) -> Iterator[list[DataFrame]]:
    """The rows in `count` shares, by the hash of their key. They are worked out and written once, so that each share is read by itself
    and not found again among all."""
    if count < 2:
        yield [rows][:count]
        return
    spark, path, share = rows.sparkSession, scratch_folder(rows.sparkSession), fresh("_share", rows.columns)
    code = F.xxhash64(key)
    shared = rows.withColumn(share, F.pmod(code, F.lit(count)).cast("int"))
    shared.repartition(share, F.pmod(F.shiftright(code, 32), F.lit(SPREAD))).write.partitionBy(share).parquet(path)
    folder = Folder(spark, path)
    try:
        yield [spark.read.schema(rows.schema).parquet(f"{path}/{share}={i}") for i in range(count) if folder.exists(f"{path}/{share}={i}")]
    finally:
        folder.remove(path)


class Ledger:
    """Results of chunks in a folder, added in waves, with a record of the chunks that each wave finished.

    A wave is one write of rows (key, data columns, kind, note): kind `row` is a chunk's result, `done` says that a chunk was finished,
    `failed` that it wasn't, and why. Spark's committer publishes a wave whole, results and record together, so a chunk is done if and only if its
    results are there. Waves that broke off are never read.
    """

    def __init__(self, spark: SparkSession, path: str, data: T.StructType, key: str = "chunk_key"):
        self.spark, self.path, self.key, self.data = spark, path, key, data
        self.schema = T.StructType([T.StructField(key, T.StringType()), *data.fields, T.StructField("note", T.StringType()), T.StructField("wave", T.StringType()), T.StructField("kind", T.StringType())])

    def waves(self) -> list[str]:
        folder = Folder(self.spark, self.path)
        return [f"{self.path}/{w}" for w in folder.names(self.path) if w.startswith("wave=") and folder.exists(f"{self.path}/{w}/_SUCCESS")]

    def _read(self, waves: Sequence[str], kind: str) -> DataFrame:
        if not waves:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*waves).filter(F.col("kind") == kind)

    def done(self) -> DataFrame:
        return self._read(self.waves(), "done").select(self.key)

    def rows(self) -> DataFrame:
        """Results of all finished chunks."""
        return self._read(self.waves(), "row").select(self.key, *self.data.names)

    def run(self, chunks: DataFrame, work: Callable[[DataFrame], DataFrame], each: int = 10_000) -> DataFrame:
        """Work on the chunks that aren't done, `each` at a time, and give the results of all of these chunks.

        work takes rows of chunks and gives rows of the ledger without `wave`. A wave with failed chunks keeps its others; after the last
        wave the failed ones are told in one error, and the next run takes up those alone.
        """
        todo = remaining(chunks, self.done(), self.key)
        n = todo.select(self.key).distinct().count()
        count, waves = -(-n // each), []
        with _dealt(todo, self.key, count) as some:
            for rows in some:
                waves.append(f"{self.path}/wave={uuid.uuid4().hex}")
                work(rows).select(self.key, *self.data.names, "note", "kind").write.partitionBy("kind").parquet(waves[-1])
        failed = self._read(waves, "failed").select(self.key, "note").orderBy(self.key).limit(6).collect()
        if failed:
            more = " and more" if len(failed) > 5 else ""
            raise ChunkError(f"chunks failed: {'; '.join(f'{r[0]}: {r[1]}' for r in failed[:5])}{more}")
        return self.rows().join(chunks.select(self.key).distinct(), self.key, "left_semi")


# Indexes


def write_index(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write rows bucketed and sorted by keys, for joins, groups and windows on those keys that move nothing; the table as `open_index` gives it.

    Rows are dealt once, by the hash that buckets go by, so a bucket is one file.
    """
    name = f"index_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    Folder(df.sparkSession, path).write(f"{path}/_index.json", json.dumps({"keys": list(keys), "buckets": buckets, "schema": df.schema.jsonValue()}))
    return df.sparkSession.table(name)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """A table that `write_index` wrote, in any session."""
    try:
        told = json.loads(Folder(spark, path).read(f"{path}/_index.json"))
        keys, buckets, schema = told["keys"], int(told["buckets"]), T.StructType.fromJson(told["schema"])
    except (ValueError, KeyError) as e:
        raise StageError(f"{path}/_index.json can't be read: {e}") from e
    name, by = f"index_{uuid.uuid4().hex}", ", ".join(f"`{k}`" for k in keys)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


# Folders


@contextmanager
def work_directory(spark: SparkSession, path: str | None = None) -> Iterator[str]:
    """A work directory with its folders; without a path a new one beside the checkpoints, removed at the end."""
    made = path or f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
    folder = Folder(spark, made)
    for name in STAGES:
        folder.make(f"{made}/{name}")
    try:
        yield made
    finally:
        if path is None:
            folder.remove(made)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share; one is chosen only where none is set and all runs on this machine."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a write or count in it has dealt out goes from the disks as soon as it is done; else that stays until the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def kept(df: DataFrame) -> DataFrame:
    """The rows as they are now, written to the shared folder: for what several later steps read, or what must not be drawn anew."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh(name: str, *taken: Sequence[str]) -> str:
    """A column name that none of the inputs has."""
    names = {c.lower() for t in taken for c in t}
    while name.lower() in names:
        name = f"_{name}"
    return name
