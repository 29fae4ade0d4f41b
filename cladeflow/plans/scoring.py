"""From hits to class memberships."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow.functions import columns as X
from cladeflow.operators import verbs
from cladeflow.plans.stages import fresh, kept

SMALL_CLASSES = 1_000_000  # class rows up to which the class table is broadcast
SMALL_SAMPLES = 1_000_000  # different samples up to which they are broadcast
E_VALUE = 1e-3


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows, told without counting further."""
    return df.limit(rows + 1).count() <= rows


def protein_sizes(fasta: DataFrame) -> DataFrame:
    """(protein_name, k_base_size) of FASTA entries (name, seq_lines)."""
    return fasta.select(X.strip_name_comments(F.col("name")).alias("protein_name"), X.k_base_size(F.concat_ws("", "seq_lines")).alias("k_base_size"))


def name_hits(hits: DataFrame, threshold: float = E_VALUE, virus: Callable[[Column], Column] = X.virus_name, extra: Sequence[str] = ()) -> DataFrame:
    """Hits up to the e-value, inclusive, with their virus; four columns and those in extra are kept."""
    kept = hits.filter(F.col("sequence_e_value") <= threshold)
    more = [c for c in dict.fromkeys(extra) if c not in ("virus_name", "target_name", "query_name", "sequence_score")]
    return kept.select(virus(F.col("target_name")).alias("virus_name"), "target_name", "query_name", "sequence_score", *more)


def best_hits(named: DataFrame, pos: Sequence[str], unit: Sequence[str] = ()) -> DataFrame:
    """The best model of each protein, the first in pos of equals. Scores that are null or NaN don't compete."""
    return verbs.best_per_group(_competing(named), [*unit, "virus_name", "target_name"], "sequence_score", pos)


def _competing(hits: DataFrame) -> DataFrame:
    return hits.filter(F.col("sequence_score").isNotNull() & ~F.isnan("sequence_score"))


def aggregate_hits(
    hits: DataFrame, proteins: DataFrame, pos: Sequence[str], threshold: float = E_VALUE,
    virus: Callable[[Column], Column] = X.virus_name, unit: Sequence[str] = (),
) -> DataFrame:
    """(virus_name, model_name, protein_hit_score): best hits, normalised by their protein's size and summed.

    unit names columns of both tables that keep parts of the input apart (such as a chunk's key); without them
    a virus has one result, and protein names must be unique (see `duplicate_proteins`).

    A protein's name tells its virus, so best hits are found, and joined with sizes, by protein alone: hits are dealt out once for both, without names of viruses.
    """
    best = verbs.best_per_group(_competing(hits.filter(F.col("sequence_e_value") <= threshold)), [*unit, "target_name"], "sequence_score", pos, ["query_name", "sequence_score"])
    sized = best.select(*unit, virus(F.col("target_name")).alias("virus_name"), "target_name", "query_name", "sequence_score").join(proteins.withColumnRenamed("protein_name", "target_name"), [*unit, "target_name"])
    score = F.sum(X.normalised_score(F.col("sequence_score"), F.col("k_base_size"))).alias("protein_hit_score")
    return sized.groupBy(*unit, "virus_name", F.col("query_name").alias("model_name")).agg(score)


def duplicate_proteins(proteins: DataFrame) -> DataFrame:
    """(protein_name, n) of names that more than one protein has."""
    return proteins.groupBy("protein_name").agg(F.count("*").alias("n")).filter("n > 1")


def class_scores(aggregated: DataFrame, classes: DataFrame, unit: Sequence[str] = ()) -> DataFrame:
    """(class_key, virus_name, class_name, class_score), all levels at once.

    With a class table that is broadcast, hits are dealt out once, by virus and before each becomes a row of every class of its model; sums stay where they are. A virus has
    a row for each model there, and parts are as many as the session says, whatever their size, so that no task's sums grow by parts that are put together.
    """
    if small_enough(classes, SMALL_CLASSES):
        side = F.broadcast(classes)
        aggregated = aggregated.repartition(int(aggregated.sparkSession.conf.get("spark.sql.shuffle.partitions")), *unit, "virus_name")
    else:
        side = classes
    level = ["class_key"] if "class_key" in classes.columns else []
    hit = X.weighted_hit(F.col("protein_hit_score"), F.col("class_percent"), F.col("class_cat"))
    return aggregated.join(side, "model_name").groupBy(*unit, *level, "virus_name", "class_name").agg(F.sum(hit).alias("class_score"))


def percentile_rank(scores: DataFrame, samples: DataFrame, score: str, keys: Sequence[str] = (), into: str = "confidence_score", small: int = SMALL_SAMPLES) -> DataFrame:
    """Mean percentile rank (below + equal / 2) / n of a column among samples (keys, virus_hit_score).

    A true rank, whatever order the samples stand in; without samples it is NaN. Null keys are a key, nulls rank as null. Up to `small` different
    samples are broadcast, sorted, with their running counts, and each score is searched for; beyond that scores and samples are sorted over ranges.
    """
    keys = list(keys)
    x, n, level = (fresh(c, keys) for c in ("_x", "_n", "_level"))
    counted = samples.filter(F.col("virus_hit_score").isNotNull()).groupBy(*keys, F.col("virus_hit_score").cast("double").alias(x)).agg(F.count("*").alias(n))
    plain = len(keys) == 1 and isinstance(scores.schema[keys[0]].dataType, T.StringType)  # a text is its own name, and a null one is a level too
    of = F.col(f"`{keys[0]}`") if plain else F.to_json(F.struct(*(F.col(f"`{k}`") for k in keys))) if keys else F.lit("")
    few = counted.select(of.alias(level), F.col(x), F.col(n)).limit(small + 1).toArrow()
    return _searched(scores, few, score, of, into) if few.num_rows <= small else _ranged(scores, counted, score, keys, x, n, into)


def _searched(scores: DataFrame, few: pa.Table, score: str, of: Column, into: str) -> DataFrame:
    """Ranks by binary search in sorted samples of each level."""
    tables: dict[str, tuple] = {}
    for level, rows in few.to_pandas().set_axis(["level", "x", "n"], axis=1).groupby("level", dropna=False):
        x, n = rows["x"].to_numpy(), rows["n"].to_numpy()
        order = np.argsort(x)  # NaN comes last, as in Spark
        tables[None if pd.isna(level) else level] = (x[order], np.r_[0, np.cumsum(n[order])])
    held = scores.sparkSession.sparkContext.broadcast(tables)

    @F.arrow_udf("double")
    def rank(value: pa.Array, level: pa.Array) -> pa.Array:
        v, out = value.to_numpy(zero_copy_only=False), np.full(len(value), np.nan)
        coded = level.dictionary_encode(null_encoding="encode")
        number = coded.indices.to_numpy(zero_copy_only=False)
        for i, name in enumerate(coded.dictionary.to_pylist()):
            if name in held.value:
                x, below = held.value[name]
                at = np.flatnonzero(number == i)
                out[at] = (below[np.searchsorted(x, v[at], "left")] + below[np.searchsorted(x, v[at], "right")]) / 2 / below[-1]
        return pa.array(out)

    given = F.col(f"`{score}`").cast("double")
    return scores.select(*(F.col(f"`{c}`") for c in scores.columns if c != into), F.when(given.isNotNull(), rank(given, of)).alias(into))


def _ranged(scores: DataFrame, counted: DataFrame, score: str, keys: list[str], x: str, n: str, into: str) -> DataFrame:
    """Ranks by sorting different values of scores and samples together over ranges, each of which counts on from those before it.

    No task sorts them all, and a value that very many rows have is one row.
    """
    scores = kept(scores)  # read twice
    taken = [*keys, x, n, *scores.columns, into]
    part, m, before, whole = (fresh(c, taken) for c in ("_range", "_m", "_before", "_all"))
    own = {c: fresh(f"_own{i}", taken) for i, c in enumerate([*keys, x])}
    over = lambda *by: Window.partitionBy(*(keys or [F.lit(0)]), *by)
    asked = scores.filter(F.col(f"`{score}`").isNotNull()).select(*keys, F.col(f"`{score}`").cast("double").alias(x)).distinct().withColumn(n, F.lit(0).cast("long"))
    both = counted.unionByName(asked).groupBy(*keys, x).agg(F.sum(n).alias(n))
    ranged = kept(both.repartitionByRange(*keys, x).withColumn(part, F.spark_partition_id()))  # ranges are drawn anew whenever they are run
    sums = ranged.groupBy(*keys, part).agg(F.sum(n).alias(m))
    sums = sums.withColumn(before, F.coalesce(F.sum(m).over(over().orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(whole, F.sum(m).over(over())).drop(m)
    sums = sums.withColumnsRenamed({k: own[k] for k in keys}).withColumnRenamed(part, own[x])
    below = F.col(before) + F.sum(n).over(over(part).orderBy(x)) - F.col(n)
    # A row for each range and level.
    here = ranged.join(F.broadcast(sums), _equal(ranged, sums, [*((k, own[k]) for k in keys), (part, own[x])]))
    ranks = here.select(*(F.col(f"`{k}`").alias(own[k]) for k in keys), F.col(x).alias(own[x]), X.ieee_div(below + F.lit(0.5) * F.col(n), F.col(whole)).alias(m))
    joined = scores.join(ranks, _equal(scores, ranks, [*((k, own[k]) for k in keys), (score, own[x])]), "left")
    return joined.select(*(F.col(f"`{c}`") for c in scores.columns if c != into), F.col(m).alias(into))


def _equal(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (left[f"`{a}`"].eqNullSafe(right[b]) for a, b in pairs))


def predict_membership(aggregated: DataFrame, classes: DataFrame, samples: DataFrame, unit: Sequence[str] = ()) -> DataFrame:
    """(class_key, virus_name, class_name, membership_ratio, virus_hit_score, confidence_score, rank_in_virus).

    Viruses without a classified model vanish. Totals are rounded to six digits before they are ranked among the
    samples, so that equal totals are equal whatever order they were summed in. Total and rank are of one window, which holds a virus's classes of one level, a row
    each.
    """
    level = ["class_key"] if "class_key" in classes.columns else []
    virus = [*unit, *level, "virus_name"]
    best_first = Window.partitionBy(*virus).orderBy(F.desc("class_score"), "class_name")
    whole = best_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = class_scores(aggregated, classes, unit).select("*", F.sum("class_score").over(whole).alias("virus_hit_score"), F.row_number().over(best_first).alias("rank_in_virus"))
    ranked = ranked.withColumn("membership_ratio", X.membership_ratio(F.col("class_score"), F.col("virus_hit_score"))).withColumn("virus_hit_score", F.round("virus_hit_score", 6))
    given = percentile_rank(ranked.drop("class_score"), samples, "virus_hit_score", level)  # what ranks over ranges keep
    return given.select(*virus, "class_name", "membership_ratio", "virus_hit_score", "confidence_score", "rank_in_virus")
