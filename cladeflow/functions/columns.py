"""Scalar functions, Column to Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_VIRUS_PATTERN = r"(.*)(?=_\d+)"  # fixed value: the text before the last underscore and digit


def ieee_div(a: Column, b: Column, null_on_zero: bool = False) -> Column:
    """a / b as IEEE doubles have it: x / 0 is infinite, 0 / 0 is NaN; or null on zero."""
    a, b = a.cast("double"), b.cast("double")
    if null_on_zero:
        return F.when(b != 0, a / b)
    zero = F.when(a.isNull(), F.lit(None)).when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(b == 0, zero).otherwise(a / b)


def virus_name(protein_name: Column, pattern: str = DEFAULT_VIRUS_PATTERN, strict: bool = False) -> Column:
    """The whole match of the pattern at the start of a protein's name; without a match an error, or null if not strict."""
    if "(?P<" in pattern or "(?R)" in pattern or re.search(r"\(\?\d+\)", pattern):
        raise ValueError(f"pattern {pattern!r} uses syntax that Java's regular expressions lack")
    anchored = f"^(?:{pattern})"
    missing = F.raise_error(F.concat(F.lit("no virus name in protein name: "), protein_name)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(protein_name.rlike(anchored), F.regexp_extract(protein_name, anchored, 0)).when(protein_name.isNotNull(), missing)


def strip_name_comments(name: Column) -> Column:
    """Text before the first ' #', without white space at either end."""
    return F.regexp_replace(F.split_part(name, F.lit(" #"), F.lit(1)), r"^\s+|\s+$", "")


def known_residues(sequence: Column) -> Column:
    """Letters other than upper-case X."""
    return F.length(F.regexp_replace(sequence, r"[^\p{L}]|X", ""))


def k_base_size(sequence: Column) -> Column:
    return known_residues(sequence) / F.lit(1000.0)


def normalised_score(score: Column, size: Column) -> Column:
    return ieee_div(score, size)


def category_weight(cat: Column) -> Column:
    """1 for category 1 down to 0 for category 5; other categories aren't checked."""
    return (F.lit(5) - cat) / F.lit(4.0)


def weighted_hit(score: Column, percent: Column, cat: Column) -> Column:
    return score * percent / F.lit(100.0) * category_weight(cat)


def membership_ratio(class_score: Column, total: Column) -> Column:
    return ieee_div(class_score, total)


def accession(text: Column) -> Column:
    """'-' stands for none."""
    return F.nullif(text, F.lit("-"))
