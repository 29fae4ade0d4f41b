"""Dataframe verbs where they pin semantics that DataFrame methods lack; use with df.transform(verb, ...).

Rows of a DataFrame have no order. A verb that depends on one takes columns `pos` that order the rows.
select, drop, filter, withColumnRenamed and unionByName are used as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import groupby, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.conversion import ArrowTableToRowsConversion
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from cladeflow.plans.stages import fresh, kept

Names = Sequence[str]


def _rest(df: DataFrame, names: Names) -> list[str]:
    return [c for c in df.columns if c not in names]


# Columns


def mutate(df: DataFrame, **new: Column) -> DataFrame:
    """Computed columns in front of the present ones."""
    return df.select(*(e.alias(c) for c, e in new.items()), "*")


def replace(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A new value, maybe of a new type, for a column in its place."""
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return df.withColumn(name, value)


def map_column(df: DataFrame, name: str, f: Callable[[Column], Column]) -> DataFrame:
    return replace(df, name, f(F.col(name)))


def replace_columns(df: DataFrame, names: Names, new: dict[str, Column]) -> DataFrame:
    """New columns where the first of a run of columns stood; the run goes."""
    out: list = []
    for c in df.columns:
        if c == names[0]:
            out += [e.alias(n) for n, e in new.items()]
        elif c not in names:
            out.append(F.col(c))
    return df.select(*out)


def subset_front(df: DataFrame, names: Names, f: Callable[[DataFrame], dict[str, Column]]) -> DataFrame:
    """Transform some columns; the result moves to the front."""
    return df.select(*(e.alias(c) for c, e in f(df.select(*names)).items()), *_rest(df, names))


def split_columns(df: DataFrame, names: Names) -> tuple[DataFrame, DataFrame]:
    """The chosen columns, and the others."""
    return df.select(*names), df.select(*_rest(df, names))


def rename(df: DataFrame, **new_names: str) -> DataFrame:
    """rename(df, old="new")."""
    return df.withColumnsRenamed(new_names)


def reorder(df: DataFrame, names: Names) -> DataFrame:
    """The same columns in another order."""
    if sorted(names) != sorted(df.columns):
        raise ValueError("reorder takes the same set of columns")
    return df.select(*names)


def map_rows(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """Any function of row batches, for what columns can't express."""
    return df.mapInPandas(lambda batches: map(f, batches), schema)


def take_rows(df: DataFrame, positions: DataFrame, pos: Names) -> DataFrame:
    """Rows by number (from 0, in the order of pos), repeats allowed; positions has the columns out_pos and pos.

    Columns: out_pos (a new name, if the rows have that one), then those of the rows. Numbers are given without gathering all rows in one task:
    rows are sorted over partitions, and each counts on from the partitions before it.
    """
    at, out = fresh("pos", df.columns), fresh("out_pos", df.columns)
    asked = positions.select(F.col("pos").alias(at), F.col("out_pos").alias(out))
    return number_rows(df, pos, at).join(asked, at).select(out, *(F.col(f"`{c}`") for c in df.columns))


def number_rows(df: DataFrame, pos: Names, name: str) -> DataFrame:
    """Number rows from 0 in the order of pos. The rows of each range of the order are counted, then numbered within."""
    part, before, within = (fresh(c, df.columns, [name]) for c in ("_range", "_before", "_within"))
    ranged = kept(df.repartitionByRange(*pos).sortWithinPartitions(*pos).withColumn(part, F.spark_partition_id()))
    so_far = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = ranged.groupBy(part).agg(F.count("*").alias(within)).select(part, F.coalesce(F.sum(within).over(so_far), F.lit(0)).alias(before))
    numbered = ranged.withColumn(within, F.row_number().over(Window.partitionBy(part).orderBy(*pos)))
    return numbered.join(F.broadcast(starts), part).withColumn(name, F.col(before) + F.col(within) - 1).drop(part, before, within)


# Filters and nesting


def drop_nothings(df: DataFrame, name: str) -> DataFrame:
    return df.dropna(subset=[name])


def unnest(df: DataFrame, name: str) -> DataFrame:
    """One row per element of a list column, in its place; an empty list drops the row."""
    return df.select(*(F.explode(c).alias(c) if c == name else F.col(c) for c in df.columns))


def unnest_frame(df: DataFrame, name: str) -> DataFrame:
    """One row per struct of a list column, its fields in the column's place."""
    fields = df.schema[name].dataType.elementType.names
    return unnest(df, name).select(*(x for c in df.columns for x in ([F.col(f"{name}.{f}").alias(f) for f in fields] if c == name else [F.col(c)])))


def zip_columns(df: DataFrame, names: Names, into: str) -> DataFrame:
    """Several columns as one struct column, in front."""
    return df.select(F.struct(*names).alias(into), *_rest(df, names))


def unzip_column(df: DataFrame, name: str) -> DataFrame:
    """A struct column's fields, in front."""
    return df.select(f"{name}.*", *_rest(df, [name]))


def nest_classes(classes: DataFrame, pos: Names = ("class_name",)) -> DataFrame:
    """Per model a map from class name to (percent, category); of a class named twice the later in pos wins.

    A model of one class is homogeneous, and its percent is forgotten (100).
    """
    last = classes.groupBy("model_name", "class_name").agg(F.max_by(F.struct("class_percent", "class_cat"), F.struct(*pos)).alias("v"))
    nested = last.groupBy("model_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_name", "v")))).alias("classes"))
    alone = F.transform_values("classes", lambda _, v: v.withField("class_percent", F.lit(100.0)))
    return nested.withColumn("classes", F.when(F.size("classes") == 1, alone).otherwise(F.col("classes")))


def unnest_classes(nested: DataFrame) -> DataFrame:
    return nested.select("model_name", F.explode("classes").alias("class_name", "v")).select("model_name", "class_name", "v.*")


# Joins


def inner_join(left: DataFrame, right: DataFrame, keys: Names) -> DataFrame:
    """Equal keys; columns: keys, the right's others, the left's others."""
    r, x = _rest(right, keys), _rest(left, keys)
    return left.join(right, list(keys)).select(*keys, *(right[c] for c in r), *(left[c] for c in x))


def inner_join_with(left: DataFrame, right: DataFrame, keys: Names, f: Callable[[DataFrame, DataFrame], dict[str, Column]]) -> DataFrame:
    return left.join(right, list(keys)).select(*keys, *(e.alias(c) for c, e in f(left, right).items()))


def product_with(left: DataFrame, right: DataFrame, f: Callable[[DataFrame, DataFrame], dict[str, Column]]) -> DataFrame:
    """Every pair of rows. The result has the product of the sizes; meant for small tables."""
    return left.crossJoin(right).select(*(e.alias(c) for c, e in f(left, right).items()))


# Groups and indexes


def summarizing(df: DataFrame, keys: Names, **aggregates: Column) -> DataFrame:
    """One row per group, keys in front."""
    return df.groupBy(*keys).agg(*(e.alias(c) for c, e in aggregates.items()))


def fixed_groups(df: DataFrame, keys: Names, f: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """Any number of rows per group, keys put back in front. A group must fit one task; use a window where one can say it."""
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*(df.schema[k] for k in keys), *kinds.fields])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = f(rows.drop(columns=list(keys)))
        for i, name in enumerate(keys):
            out.insert(i, name, rows[name].to_numpy()[:1].repeat(len(out)))
        return out

    return _each_group(df, keys, run, whole)


def grouped(df: DataFrame, keys: Names, f: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """Per group a frame to a frame; keys aren't put back."""
    return _each_group(df, keys, f, T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def _each_group(df: DataFrame, keys: Names, f: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """f on each group's rows. Groups come and go many to a batch, as one that is sent by itself costs far more than what is done with it.

    Rows of a group stand together, and Spark marks where one begins. Numbers and truth values that are null come with a mark of their own, so that a group without nulls has the
    types that it would have alone.
    """
    first, gaps = fresh("_first", df.columns), {}
    for i, c in enumerate(df.schema.fields):
        if isinstance(c.dataType, (T.IntegralType, T.BooleanType)):
            gaps[c.name] = fresh(f"_null{i}", df.columns)
    begins = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) == 1
    whole = [F.coalesce(F.col(f"`{c.name}`"), F.lit(0).cast(c.dataType)).alias(c.name) if c.name in gaps else F.col(f"`{c.name}`") for c in df.schema.fields]
    marked = df.select("*", begins.alias(first)).select(*whole, first, *(F.col(f"`{c}`").isNull().alias(g) for c, g in gaps.items()))
    columns, names, kinds = df.columns, schema.names, {c.name: c.dataType for c in df.schema.fields}

    def one(own: pd.DataFrame, gone: dict[str, np.ndarray]) -> pd.DataFrame:
        own.index = pd.RangeIndex(len(own))
        for c, gap in gone.items():
            if gap.any():
                own[c] = own[c].astype(object if isinstance(kinds[c], T.BooleanType) else float).mask(gap, None)
        out = f(own)
        return out[names] if list(out.columns) != names and set(names) <= set(out.columns) else out

    def batch(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        gone = {c: gap for c, g in gaps.items() if (gap := rows[g].to_numpy()).any()}
        at = [*np.flatnonzero(rows[first].to_numpy()).tolist(), len(rows)]
        rows = rows[columns]
        made = [out for a, b in pairwise(at) if len(out := one(rows.iloc[a:b], {c: gap[a:b] for c, gap in gone.items()}))]
        for _, alike in groupby(made, lambda out: tuple(out.dtypes)):  # frames of other types would change each other's
            yield pd.concat(alike, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            start = np.flatnonzero(rows[first].to_numpy())
            if len(start):  # what comes before the last group's begin is whole
                held.append(rows.iloc[: start[-1]])
                yield from batch(pd.concat(held, ignore_index=True))
                held = [rows.iloc[start[-1] :]]
            else:
                held.append(rows)
        if held:
            yield from batch(pd.concat(held, ignore_index=True))

    return marked.mapInPandas(run, schema)


def table_function(spark: SparkSession, name: str, f: Callable[[pd.DataFrame], pd.DataFrame], columns: Sequence[str], schema: str) -> None:
    """Make f, a frame to a frame, a function of tables in SQL: SELECT * FROM name(TABLE(t) PARTITION BY k ORDER BY o).

    columns are those that f takes, in any order in t; leave others out of t, as all are sent. f is called for each partition with its rows in the order asked for; a partition
    must fit one task. A call without PARTITION BY passes the whole table to one task.
    """
    names, kinds = list(columns), T.StructType.fromDDL(schema)
    made = to_arrow_schema(kinds)

    @F.arrow_udtf(returnType=kinds)
    class Of:
        def __init__(self):
            self.parts = []

        def eval(self, rows):
            self.parts.append(rows)  # a partition may span batches

        def terminate(self):
            if self.parts:
                rows = self.parts[0] if len(self.parts) == 1 else pa.Table.from_batches(self.parts).combine_chunks().to_batches()[0]
                out = f(_frame(rows, names))
                yield pa.RecordBatch.from_arrays([pa.array(out[c.name].to_numpy(), c.type, from_pandas=True) for c in made], schema=made)

    spark.udtf.register(name, Of)


def _frame(rows: pa.RecordBatch, names: Names) -> pd.DataFrame:
    """A frame of the values that rows of a DataFrame have in Python; numbers without nulls are taken as they are."""
    values = [rows.column(n) for n in names]
    if all(v.null_count == 0 and (pa.types.is_integer(v.type) or pa.types.is_floating(v.type)) for v in values):
        return pd.DataFrame({n: v.to_numpy() for n, v in zip(names, values, strict=True)})
    some = pa.Table.from_arrays(values, names=list(names))
    return pd.DataFrame(list(map(tuple, ArrowTableToRowsConversion.convert(some, from_arrow_schema(some.schema)))), columns=list(names))


def split_groups(df: DataFrame, keys: Names, pos: Names) -> DataFrame:
    """A table of groups: keys, and the other columns of its rows as a list in the order of pos."""
    other = [c for c in _rest(df, keys) if c not in pos]
    rows = F.array_sort(F.collect_list(F.struct(*pos, *other)))
    return df.groupBy(*keys).agg(rows.alias("rows"))


def set_index(df: DataFrame, keys: Names, reuse: bool = False) -> DataFrame:
    """Keys in front; dealt out by them if several steps will use them."""
    out = df.select(*keys, *_rest(df, keys))
    return out.repartition(*keys) if reuse else out


def reindex_by(df: DataFrame, **keys: Column) -> DataFrame:
    """Computed keys in front of all columns."""
    return mutate(df, **keys)


reset_index = set_index


def drop_index(df: DataFrame, keys: Names) -> DataFrame:
    return df.drop(*keys)


def reindexed(df: DataFrame, keys: Names, f: Callable[[DataFrame], DataFrame], new_keys: dict[str, str] | None = None) -> DataFrame:
    """Run a block with keys in front, then put the keys, maybe under new names, back where they stood."""
    names, done = new_keys or {}, f(set_index(df, keys))
    back = [names.get(c, c) for c in df.columns]
    return done.select(*(c for c in back if c in done.columns), *(c for c in done.columns if c not in back))


def map_index(df: DataFrame, key: str, f: Callable[[Column], Column]) -> DataFrame:
    """Change keys by an order-preserving function; groups aren't merged."""
    return df.withColumn(key, f(F.col(key)))


# Order


def arrange(df: DataFrame, by: Sequence[Column], pos: Names) -> DataFrame:
    """Sort; rows that are equal keep the order of pos."""
    return df.orderBy(*by, *pos)


def top(df: DataFrame, by: Sequence[Column], n: int, pos: Names) -> DataFrame:
    """The first n rows of a stable sort."""
    if n < 0:
        raise ValueError("n must not be negative")
    return df.orderBy(*by, *pos).limit(n)


def top_n_per_group(df: DataFrame, keys: Names, by: Sequence[Column], n: int, pos: Names) -> DataFrame:
    """The first n rows of each group; ties in the order of pos."""
    if n < 0:
        raise ValueError("n must not be negative")
    w, at = Window.partitionBy(*keys).orderBy(*by, *pos), fresh("_at", df.columns)
    return df.withColumn(at, F.row_number().over(w)).filter(F.col(at) <= n).drop(at)


def best_per_group(df: DataFrame, keys: Names, highest: str, pos: Names, columns: Names | None = None) -> DataFrame:
    """The one row of each group with the highest value, the first of equals in pos; an aggregate that combines before the shuffle.

    A row whose value is null is the best only of a group without others. Only the keys and what columns names are kept, or all columns.
    """
    rest, one = _rest(df, keys) if columns is None else _rest(df.select(*columns), keys), fresh("_best", df.columns)
    best = F.min_by(F.struct(*rest), F.struct(F.col(highest).isNull(), -F.col(highest), *pos))
    return df.groupBy(*keys).agg(best.alias(one)).select(*keys, *(F.col(f"{one}.`{c}`").alias(c) for c in rest))


FEW_TOTALS = 1_000_000  # totals up to which they are broadcast
HOT_PART = 200  # a key with more than one in so many of the rows is hot
SALTS = 64


def group_total(df: DataFrame, keys: Names, value: str, name: str, few: int = FEW_TOTALS) -> DataFrame:
    """A group's total on each of its rows.

    Totals are summed before the shuffle and joined back: broadcast while there are few groups, and else by key, where the rows of hot keys, of which there are
    fewer than HOT_PART, are dealt over SALTS places. So no task holds a group. df is read twice; keep it first where it is dear.
    """
    taken = [*df.columns, name]
    total, n, hot, salt = (fresh(c, taken) for c in ("_total", "_n", "_hot", "_salt"))
    own = {k: fresh(f"_key{i}", taken) for i, k in enumerate(keys)}
    totals = kept(df.groupBy(*keys).agg(F.sum(value).alias(total), F.count("*").alias(n)).withColumnsRenamed(own))
    same = lambda left, right: reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[o]) for k, o in own.items()), F.lit(True))
    out = [F.col(f"`{c}`") for c in df.columns if c != name] + [F.col(total).alias(name)]
    if totals.limit(few + 1).count() <= few:
        return df.join(F.broadcast(totals), same(df, totals)).select(*out)
    rows = totals.agg(F.sum(n).alias("n")).head()["n"]
    totals = totals.withColumn(hot, F.col(n) > rows / HOT_PART)
    warm = F.broadcast(totals.filter(hot).select(*own.values(), F.lit(True).alias(hot)))  # fewer than HOT_PART
    dealt = df.join(warm, same(df, warm), "left").withColumn(salt, F.when(F.col(hot), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0)).drop(hot, *own.values())
    sides = totals.withColumn(salt, F.explode(F.when(F.col(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop(hot, n)
    return dealt.join(sides, same(dealt, sides) & (dealt[salt] == sides[salt])).select(*out)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
