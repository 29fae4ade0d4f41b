"""Folds whose partial results merge."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 1000  # partial results merged by one task


def fold(df: DataFrame, one: Callable[[pd.DataFrame], pd.DataFrame], merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Fold each partition's batches to a row, then merge rows in two steps, FAN_IN partitions' and then all that are left.

    merge takes rows of the schema and gives one row; it must be associative. For sums and the like
    df.agg does the same in the JVM.
    """

    def partial(batches):
        made = [one(b) for b in batches]
        if made:
            yield merge(pd.concat(made))

    parts = df.mapInPandas(partial, schema)
    some = parts.groupBy(F.floor(F.spark_partition_id() / FAN_IN).alias("_to")).applyInPandas(lambda rows: merge(rows.drop(columns="_to", errors="ignore")), schema)
    return some.groupBy().applyInPandas(merge, schema)
