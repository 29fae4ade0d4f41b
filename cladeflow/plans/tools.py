"""External sequence tools over chunks of sequences, one process a task."""

from __future__ import annotations

import hashlib
import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow import schemas
from cladeflow.plans.stages import Ledger, digest, entry_digest, fresh, kept, shared_folder
from cladeflow.sources.files import Folder

Argv = Callable[[str, str], Sequence[str]]


class ToolError(RuntimeError):
    """A tool is missing or has failed."""


def find_tool(name: str) -> str:
    """The executable's path on this machine."""
    found = shutil.which(name)
    if found is None:
        raise ToolError(f"executable not found: {name}")
    return found


def probe_tool(spark: SparkSession, name: str) -> str:
    """A digest of an executable as an executor has it; an error before any work starts if there is none."""

    def look(batches):
        for _ in batches:
            path = shutil.which(name)
            told = hashlib.sha256()
            if path:
                with open(path, "rb") as f:
                    while block := f.read(1 << 20):
                        told.update(block)
            yield pd.DataFrame({"sha": [told.hexdigest() if path else None]})

    (row,) = spark.range(1, numPartitions=1).mapInPandas(look, "sha string").collect()
    if row["sha"] is None:
        raise ToolError(f"executable not found: {name}")
    return row["sha"]


def chunk_sequences(sequences: DataFrame, size: int, order: Sequence[str], within: Sequence[str] = ("file",)) -> DataFrame:
    """Number each file's sequences in order and give every `size` of them a chunk_id.

    Files are taken apart. No task sorts a whole file: rows are sorted over ranges of file and order, and each
    range counts on from those before it. The order should leave no ties.
    """
    if size < 1:
        raise ValueError("a chunk has at least one sequence")
    if "chunk_id" in sequences.columns:
        raise ValueError("sequences have a column chunk_id already")
    taken = sequences.columns
    part, n, before, own = fresh("_range", taken), fresh("_n", taken), fresh("_before", taken), [fresh(f"_in{i}", taken) for i in range(len(within))]
    ranged = sequences.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order).withColumn(part, F.spark_partition_id())
    ranged = kept(ranged)  # ranges are drawn anew whenever they are run
    so_far = Window.partitionBy(*within).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a range and file
    starts = ranged.groupBy(*within, part).agg(F.count("*").alias(n)).withColumn(before, F.coalesce(F.sum(n).over(so_far), F.lit(0)))
    starts = starts.select(F.col(part).alias(n), before, *(F.col(c).alias(o) for c, o in zip(within, own, strict=True)))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(o)) for c, o in zip(within, own, strict=True)), F.col(part) == F.col(n))
    number = F.col(before) + F.row_number().over(Window.partitionBy(part, *within).orderBy(*order)) - 1
    return ranged.join(starts, same).withColumn("chunk_id", F.floor(number / size).cast("long")).select(*(F.col(f"`{c}`") for c in taken), "chunk_id")


def chunk_keys(chunks: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, chunk_key, n): a SHA-256 of each chunk's sorted entry digests, so whatever its order, and its number of entries. A chunk fits one task."""
    made = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(entry_digest(*columns))).alias("chunk_key"), F.count("*").alias("n"))
    return made.withColumn("chunk_key", F.sha2(F.array_join("chunk_key", ","), 256))


def write_chunk_files(chunks: DataFrame, path: str, keys: Sequence[str] = ("file", "chunk_id")) -> DataFrame:
    """Write each chunk as FASTA text in a folder chunk_key=<key of its content> of its own; (keys, chunk_key, n). Chunks of equal
    content share a folder and are written once."""
    named = kept(chunk_keys(chunks, keys, ["name", "seq_lines"]))
    one = named.groupBy("chunk_key").agg(F.min(F.struct(*keys)).alias("_one")).select("chunk_key", "_one.*")
    entry = F.concat_ws("\n", F.concat(F.lit(">"), F.col("name")), "seq_lines").alias("value")
    chunks.join(one, list(keys)).select("chunk_key", entry).repartition("chunk_key").write.partitionBy("chunk_key").text(path)
    return named


def fasta_text(rows: pd.DataFrame) -> str:
    return "".join(f">{n}\n" + "\n".join(s) + "\n" for n, s in zip(rows["name"], rows["seq_lines"], strict=True))


def run_tool(argv: Argv, text: str, also: Sequence[str] = ()) -> list[str]:
    """Run a command on a file with the text; the texts of the file it wrote and of those with the endings in also. Files are the task's
    own and go with it; a file that isn't there is empty."""
    if not text:
        return [""] * (1 + len(also))  # a chunk without sequences has no results
    with tempfile.TemporaryDirectory() as folder:
        source, out = os.path.join(folder, "in"), os.path.join(folder, "out")
        with open(source, "w") as f:
            f.write(text)
        command = list(argv(source, out))
        command[0] = find_tool(command[0])
        try:
            done = subprocess.run(command, capture_output=True, text=True, check=False)
        except OSError as e:
            raise ToolError(f"{command[0]}: {e}") from e
        if done.returncode:
            raise ToolError(f"{' '.join(command)}: exit code {done.returncode}: {done.stderr[-2000:]}")
        found = []
        for path in (out, *(out + ending for ending in also)):
            if os.path.exists(path):
                with open(path) as f:
                    found.append(f.read())
            else:
                found.append("")
        return found


def pipe_tool(chunks: DataFrame, argv: Argv, parse: Callable[..., pd.DataFrame], schema: T.StructType | str, keys: Sequence[str] = ("chunk_id",), to_input: Callable[[pd.DataFrame], str] = fasta_text, also: Sequence[str] = (), told: bool = False) -> DataFrame:
    """Run a command once per chunk; rows that parse makes of its output, and of the files beside it with the endings in also, with the
    chunk's keys in front. Chunks bound what a task holds.

    With told, rows are those of a ledger (see `stages.Ledger`): each chunk ends in a row that says it is done, or failed and why, and a failed
    tool fails no job.
    """
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    more = [T.StructField("note", T.StringType()), T.StructField("kind", T.StringType())] if told else []
    whole = T.StructType([*(chunks.schema[k] for k in keys), *kinds.fields, *more])

    def last(kind: str, note: str | None) -> pd.DataFrame:
        return pd.DataFrame([{**dict.fromkeys(kinds.names), "note": note, "kind": kind}])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        try:
            out = parse(*run_tool(argv, to_input(rows), also))[kinds.names]
            if told:
                done = last("done", None)
                out = pd.concat([out.assign(note=None, kind="row").astype(object), done.astype(object)], ignore_index=True) if len(out) else done
        except ToolError as e:
            if not told:
                raise
            out = last("failed", str(e))
        for i, (name, value) in enumerate(zip(keys, key, strict=True)):
            out.insert(i, name, value)
        return out

    # Dealt to all cores: chunks are short and runs of a tool long, so tasks that bytes decide would be far too few.
    return chunks.repartition(_tasks(chunks), *keys).groupBy(*keys).applyInPandas(run, whole)


def _tasks(chunks: DataFrame) -> int:
    """How many tasks run tools: some for each core, so that none waits long for the slowest."""
    return 4 * chunks.sparkSession.sparkContext.defaultParallelism


def run_on_chunks(chunks: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType | str, workers: int | None = None, key: str = "chunk_id") -> DataFrame:
    """A user's function over whole partitions of chunks; workers is the number of partitions, some for each core unless it is given."""
    return chunks.repartition(workers or _tasks(chunks), key).mapInPandas(f, schema)


def parse_fasta(text: str) -> pd.DataFrame:
    names, lines = [], []
    for line in filter(None, (x.rstrip("\r") for x in text.split("\n"))):
        if line.startswith(">"):
            names.append(line[1:])
            lines.append([])
        elif not names:
            raise ToolError(f"output doesn't begin with a name line: {line[:80]!r}")
        else:
            lines[-1].append(line)
    return pd.DataFrame({"name": pd.Series(names, dtype=str), "seq_lines": pd.Series(lines, dtype=object)})


def parse_tblout(text: str) -> pd.DataFrame:
    """Hits of a profile-search table, by the rule of `tables.read_tblout`; a line that it calls bad is an error here."""
    whole = {"IntegerType": int, "LongType": int, "DoubleType": float}
    rows = []
    for line in text.split("\n"):
        if line and not line.startswith("#"):
            t = [x for x in line.split(" ") if x]
            if line.startswith(" ") or len(t) < len(schemas.HITS):
                raise ToolError(f"no line of a hit table: {line[:200]!r}")
            rows.append([None if f.name.endswith("accession") and v == "-" else whole.get(type(f.dataType).__name__, str)(v) for f, v in zip(schemas.HITS.fields, t, strict=False)])
    return pd.DataFrame(rows, columns=schemas.HITS.names)


HIT_ROWS = T.StructType([*schemas.HITS.fields, T.StructField("line", T.LongType())])


def predict_genes(chunks: DataFrame, keys: Sequence[str] = ("chunk_id",), executable: str = "prodigal", procedure: str = "meta", mask: bool = False, genbank: bool = False, told: bool = False) -> DataFrame:
    """Proteins (keys, name, seq_lines) that gene prediction finds in each chunk of genomes.

    With genbank there is a column of that name, and for each chunk one more row with the tool's GenBank text in it and no name.
    """
    options = ["-p", procedure, *(["-m"] if mask else [])]
    if not genbank:
        return pipe_tool(chunks, lambda source, out: [executable, *options, "-i", source, "-a", out], parse_fasta, schemas.FASTA, keys, told=told)

    def both(proteins: str, text: str) -> pd.DataFrame:
        found = parse_fasta(proteins)
        found["genbank"] = None
        return pd.concat([found, pd.DataFrame({"name": [None], "seq_lines": [None], "genbank": [text]})], ignore_index=True)

    return pipe_tool(chunks, lambda source, out: [executable, *options, "-i", source, "-a", out, "-o", out + ".gbk"], both, gene_rows(True), keys, also=(".gbk",), told=told)


def gene_rows(genbank: bool) -> T.StructType:
    return T.StructType([*schemas.FASTA.fields, *([T.StructField("genbank", T.StringType())] if genbank else [])])


def search_profiles(proteins: DataFrame, models: str, keys: Sequence[str] = ("chunk_id",), executable: str = "hmmsearch", told: bool = False) -> DataFrame:
    """Hits of each chunk's proteins against a model file, with their line among the chunk's hits. The file is shipped to every executor once, under a name that its content
    gives, so that a changed one is shipped anew."""
    from pyspark import SparkFiles

    spark = proteins.sparkSession
    folder = Folder(spark, models)
    name = f"models-{folder.sha256(models)}"
    shipped = f"{shared_folder(spark)}/{name}"
    if not Folder(spark, shipped).exists(shipped):
        folder.copy(models, shipped)
    spark.sparkContext.addFile(shipped)

    def hits(text: str) -> pd.DataFrame:
        return parse_tblout(text).reset_index(names="line")

    return pipe_tool(proteins, lambda source, out: [executable, "--tformat", "FASTA", "--cpu", "1", "--tblout", out, SparkFiles.get(name), source], hits, HIT_ROWS, keys, told=told)


def search_genome_hits(spark: SparkSession, genomes: DataFrame, models: str, work_dir: str, size: int = 1, order: Sequence[str] = ("name",), prodigal: str = "prodigal", hmmsearch: str = "hmmsearch", procedure: str = "meta", mask: bool = False, genbank: bool = False, each: int = 10_000) -> tuple[DataFrame, DataFrame, dict]:
    """(proteins, hits, what they were made from) of all genomes, both with the chunk_key of their chunk.

    Gene prediction and search each keep a ledger of chunks, by content, below the work directory: one for each tool, set of options and model file. Chunks
    that a ledger has are not run again, in this run or any later one, whatever genomes they came with. Chunks of the same content are one. With
    genbank, the ledger of proteins holds the GenBank texts too (see `predict_genes`).
    """
    genes = {"tool": probe_tool(spark, prodigal), "procedure": procedure, "mask": mask, "genbank": genbank}
    search = {"genes": genes, "tool": probe_tool(spark, hmmsearch), "models": Folder(spark, models).sha256(models)}
    chunks = chunk_sequences(genomes, size, order)
    named = chunk_keys(chunks, ("file", "chunk_id"), ["name", "seq_lines"])
    one = named.groupBy("chunk_key").agg(F.min(F.struct("file", "chunk_id")).alias("one")).select("chunk_key", "one.*")
    ready = kept(chunks.join(one, ["file", "chunk_id"]).select("chunk_key", "name", "seq_lines"))
    proteins = Ledger(spark, f"{work_dir}/proteins/{digest(genes)}", gene_rows(genbank)).run(ready, lambda some: predict_genes(some, ("chunk_key",), prodigal, procedure, mask, genbank, told=True), each)
    proteins = proteins.filter("name is not null").drop("genbank")
    hits = Ledger(spark, f"{work_dir}/search/{digest(search)}", HIT_ROWS).run(proteins, lambda some: search_profiles(some, models, ("chunk_key",), hmmsearch, told=True), each)
    return proteins, hits, {"size": size, "order": list(order), "search": search}
