"""Declared tables. No reader infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(**columns: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "l": T.LongType()}
    return T.StructType([T.StructField(name, kinds[k]) for name, k in columns.items()])


HITS = _table(
    target_name="s", target_accession="s", query_name="s", query_accession="s",
    sequence_e_value="d", sequence_score="d", sequence_bias="d", domain_e_value="d", domain_score="d", domain_bias="d",
    exp_estimation="d", reg_estimation="i", clu_estimation="i", ov_estimation="i", env_estimation="i", dom_estimation="i", rep_estimation="i", inc_estimation="i",
    description="s",
)
AGGREGATED_HITS = _table(virus_name="s", model_name="s", protein_hit_score="d")
PROTEIN_SIZES = _table(protein_name="s", k_base_size="d")
MODEL_CLASSES = _table(model_name="s", class_name="s", class_percent="d", class_cat="i")
SCORE_SAMPLES = _table(virus_hit_score="d")
PREDICTIONS = _table(virus_name="s", class_name="s", membership_ratio="d", virus_hit_score="d", confidence_score="d")
FASTA = T.StructType([T.StructField("name", T.StringType()), T.StructField("seq_lines", T.ArrayType(T.StringType()))])
