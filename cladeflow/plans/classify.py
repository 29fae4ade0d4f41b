"""The whole classification, from hits or from genomes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from cladeflow.functions.columns import virus_name
from cladeflow.plans import scoring, stages, tools
from cladeflow.sources import fasta, tables


def classify_hits(hits: DataFrame, proteins: DataFrame, classes: DataFrame, samples: DataFrame, pos: Sequence[str], threshold: float = scoring.E_VALUE, virus: Callable[[Column], Column] = virus_name, unit: Sequence[str] = ()) -> DataFrame:
    """Predictions of all levels from hits and protein sizes; needs no external tool."""
    return scoring.predict_membership(scoring.aggregate_hits(hits, proteins, pos, threshold, virus, unit), classes, samples, unit)


class DuplicateProteins(ValueError):
    """Protein names aren't unique, so scores would count twice."""


def classify(spark: SparkSession, genomes: str, index: str, work_dir: str, threshold: float = scoring.E_VALUE, pattern: str | None = None, size: int = 1, models: str | None = None, prodigal: str = "prodigal", hmmsearch: str = "hmmsearch", procedure: str = "meta", mask: bool = False, genbank: bool = False) -> DataFrame:
    """Predictions for a genomes FASTA file, going on from what earlier runs left in work_dir.

    Chunks of genomes that were searched before, with the same tools, options and models, aren't searched again. Aggregated hits and predictions are
    stages, each with a manifest of all that it was made from: content of genomes, tools and models, options, threshold, pattern, classes and samples.
    Where any of these has changed, they are made anew; where none has, they are read. procedure, mask and genbank are those of gene prediction.
    """
    levels, named = tables.load_index(spark, index)
    models = models or named
    if models is None:
        raise tables.IndexFormatError(f"{index}: names no model file, and none is given")
    entries = fasta.read_fasta(spark, genomes)
    proteins, hits, found = tools.search_genome_hits(spark, entries, models, work_dir, size, ("name",), prodigal, hmmsearch, procedure, mask, genbank)
    virus = (lambda c: virus_name(c, pattern, strict=True)) if pattern else (lambda c: virus_name(c, strict=True))

    def aggregated() -> DataFrame:
        sizes = scoring.protein_sizes(proteins)
        twice = scoring.duplicate_proteins(sizes).limit(5).collect()
        if twice:
            raise DuplicateProteins(f"{genomes}: protein names that aren't unique: {', '.join(r['protein_name'] for r in twice)}")
        return scoring.aggregate_hits(hits, sizes, ("chunk_key", "line"), threshold, virus)

    made_of = {"genomes": stages.content_key(entries, "name", "seq_lines"), "found": found, "threshold": threshold, "pattern": pattern}
    made = stages.stage(spark, work_dir, "processed", "aggregated", aggregated, made_of)
    classes, samples = tables.read_levels(spark, levels)
    made_of = {"aggregated": made_of, "classes": stages.content_key(classes), "samples": stages.content_key(samples)}
    return stages.stage(spark, work_dir, "processed", "predictions", lambda: scoring.predict_membership(made, classes, samples), made_of)
