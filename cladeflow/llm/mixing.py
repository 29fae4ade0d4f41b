"""Hierarchical budgeting: mixing sources to target weights (operator 7), with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import shared_checkpoints

BUCKET_ROWS = 1000  # documents of a leaf between two marks of its seeded order, about
SMALL_TREE = 100_000  # leaves up to which the leaf table is broadcast; beyond, rows meet it by leaf and one of SALTS
SALTS = 64
WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The sources' domains: their trailing number modulo 4; "other" without one."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("long") % 4).cast("string"))).otherwise("other")


def budgets(leaves: DataFrame, levels: tuple[str, ...], total: float | None, max_epochs: int, flatten: float, weights: dict[tuple, float] | None = None) -> DataFrame:
    """Token budget of each leaf (columns: levels, tokens, docs), top down through the tree.

    A node's weight among its siblings is its tokens to the power `flatten`, or the one given for its
    path. No node gets more than its leaves hold over max_epochs; what it can't take goes to its siblings
    by weight, and only what a whole family can't take is shared one level higher.
    """
    held = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    if total is None:
        given = held.withColumn("budget", F.sum("tokens").over(Window.partitionBy(F.lit(0))).cast("double"))
    else:
        given = held.withColumn("budget", F.lit(float(total)))
    for depth, level in enumerate(levels, 1):
        path, parent = list(levels[:depth]), list(levels[: depth - 1])
        node = given.groupBy(*path).agg(F.sum("tokens").cast("double").alias("t"), F.sum("cap").cast("double").alias("c"), F.first("budget").alias("b"))
        w = F.sqrt("t") if flatten == 0.5 else F.sqrt("t") * F.sqrt(F.sqrt("t")) if flatten == 0.75 else F.pow("t", F.lit(float(flatten)))
        for at, value in (weights or {}).items():
            if len(at) == depth:
                same = F.lit(True)
                for c, v in zip(path, at, strict=True):
                    same &= F.col(c) == v
                w = F.when(same, float(value)).otherwise(w)
        node = node.withColumn("w", w).filter("w > 0")
        family = Window.partitionBy(*(parent or [F.lit(0)]))
        rising = family.orderBy(F.col("c") / F.col("w"), level)
        node = node.withColumn("left", F.col("b") - F.coalesce(F.sum("c").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        node = node.withColumn("share", F.col("left") / F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        node = node.withColumn("give", F.least("c", F.max("share").over(family) * F.col("w")))
        given = given.drop("budget").join(node.select(*path, F.col("give").alias("budget")), path)
    return given


def mix_sources(
    docs: DataFrame, levels: dict[str, Column] | None = None, total: float | None = None, max_epochs: int = 4, flatten: float = 0.75,
    weights: dict[tuple, float] | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Take of each leaf (domain, language, source) the documents that fill its budget.

    Tokens are words of the whole text. A leaf's budget runs through whole epochs of its documents, and
    in the last epoch through the documents in seeded order until the budget is reached; the one that
    reaches it is taken whole. Returns the input's rows, once for each epoch they are taken in, with the
    column mix_epoch (from 0) after them; any column of that name is replaced, others may have any names. Null labels form leaves of
    their own (''), rows without an id count as id ''; rows of one leaf that share an id go together;
    documents without words come with the epochs' order but use no budget, and a leaf of only such
    documents, or of no budget, gives nothing; an empty table gives no rows. A long text is split by the JVM as one row.

    Leaves are summed, the budgets worked out on the leaves, and each leaf's last
    epoch is cut at one key of its seeded order, found from the sums of its key ranges and the rows
    of the one range that holds the cut. A hot leaf has more ranges, not larger ones. Up to SMALL_TREE leaves no text is shuffled.
    """
    levels = levels or {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    docs = docs.drop("mix_epoch")
    own = "_mix"  # before all names made here, and of no column of the input
    while any(c.lower().startswith(own) for c in docs.columns):
        own = f"_{own}"
    names = tuple(f"{own}_{k}" for k in levels)
    n, doc, salt, whole, last, epochs = (f"{own}__{c}" for c in ("n", "doc", "salt", "whole", "last", "epochs"))
    n_words = F.size(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(WORD), F.lit(0)))
    marked = docs.withColumns({c: F.coalesce(e.cast("string"), F.lit("")) for c, e in zip(names, levels.values(), strict=True)})
    marked = marked.withColumn(doc, F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    # Words are counted once; what follows reads these few columns, without text.
    narrow = marked.select(*names, F.coalesce(F.greatest(n_words, F.lit(0)), F.lit(0)).cast("long").alias(n), doc)
    shared_checkpoints(docs.sparkSession)
    narrow = narrow.checkpoint()
    leaves = narrow.groupBy(*names).agg(F.sum(n).alias("tokens"), F.count("*").alias("docs"))
    budget = budgets(leaves, names, total, max_epochs, flatten, weights).filter("budget > 0")
    turns = F.floor(F.col("budget") / F.col("tokens"))
    plan = budget.select(*names, turns.alias(whole), (F.col("budget") - turns * F.col("tokens")).alias("part"), F.ceil(F.col("docs") / BUCKET_ROWS).alias("ranges")).checkpoint()
    small = plan.count() <= SMALL_TREE

    def with_leaf(rows: DataFrame, tree: DataFrame) -> DataFrame:
        if small:
            return rows.join(F.broadcast(tree), list(names))
        salted = tree.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn(salt, F.pmod(F.xxhash64(doc), F.lit(SALTS)).cast("int")).join(salted, [*names, salt]).drop(salt)

    def key(epoch: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc).cast("binary"))

    keyed = with_leaf(narrow, plan).withColumn("key", key(F.col(whole)))
    keyed = keyed.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges"), 32))
    sums = keyed.groupBy(*names, "range").agg(F.sum(n).alias("n"), F.first("part").alias("part"))
    sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*names).orderBy("range")))  # a row for BUCKET_ROWS documents
    cut = sums.filter("part > 0 and upto >= part and upto - n < part").groupBy(*names).agg(F.min("range").alias("range"), F.min_by(F.col("upto") - F.col("n"), "range").alias("before"))
    near = keyed.join(F.broadcast(cut) if small else cut, [*names, "range"]).groupBy(*names, "key").agg(F.sum(n).alias("n"), F.first("before").alias("before"), F.first("part").alias("part"))
    near = near.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*names).orderBy("key")))  # about BUCKET_ROWS rows a leaf
    ends = near.filter("upto >= part").groupBy(*names).agg(F.min("key").alias(last))
    final = plan.join(ends, list(names), "left").select(*names, whole, F.coalesce(last, F.lit("")).alias(last)).checkpoint()
    taken = with_leaf(marked, final).withColumn(epochs, (F.col(whole) + F.when(key(F.col(whole)) <= F.col(last), 1).otherwise(0)).cast("int")).filter(F.col(epochs) > 0)
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(0), F.col(epochs) - 1)).alias("mix_epoch"))


def op7_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "lang", "source", "mix_epoch")


def _budget_sql() -> str:
    """The levels of the tree one after the other, as DuckDB SQL."""
    parts, given = [], "g0"
    for depth, level in enumerate(LEVELS, 1):
        path, parent = ", ".join(LEVELS[:depth]), ", ".join(LEVELS[: depth - 1]) or "0"
        parts.append(f"""n{depth} AS (SELECT {path}, sum(tokens)::DOUBLE AS t, sum(cap)::DOUBLE AS c, first(budget) AS b FROM {given} GROUP BY {path}),
w{depth} AS (SELECT *, sqrt(t) * sqrt(sqrt(t)) AS w FROM n{depth} WHERE t > 0),
s{depth} AS (SELECT *, (b - coalesce(sum(c) OVER (PARTITION BY {parent} ORDER BY c / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (PARTITION BY {parent} ORDER BY c / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w{depth}),
b{depth} AS (SELECT {path}, least(c, max(share) OVER (PARTITION BY {parent}) * w) AS give FROM s{depth}),
g{depth} AS (SELECT {", ".join(f"g.{c}" for c in LEVELS)}, g.tokens, g.docs, g.cap, give AS budget FROM {given} g JOIN b{depth} b ON {" AND ".join(f"g.{c} = b.{c}" for c in LEVELS[:depth])})""")
        given = f"g{depth}"
    return ",\n".join(parts)


SQL = f"""WITH d AS (SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(doc_id::VARCHAR, '') AS id,
  coalesce(CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> '' THEN concat('d', regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 4) ELSE 'other' END, '') AS domain,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n FROM documents),
g0 AS (SELECT domain, lang, source, sum(n) AS tokens, count(*) AS docs, sum(n) * 4 AS cap, (sum(sum(n)) OVER ())::DOUBLE AS budget FROM d GROUP BY domain, lang, source),
{_budget_sql()},
p AS (SELECT domain, lang, source, floor(budget / tokens)::BIGINT AS whole, budget - floor(budget / tokens) * tokens AS part FROM g3 WHERE budget > 0),
k AS (SELECT d.*, whole, part, md5(concat('17:', whole, ':', id)) AS key FROM d JOIN p USING (domain, lang, source)),
c AS (SELECT domain, lang, source, key, first(part) AS part, sum(n) AS n FROM k GROUP BY domain, lang, source, key),
u AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM c),
l AS (SELECT domain, lang, source, min(key) AS last FROM u WHERE upto >= part AND part > 0 GROUP BY domain, lang, source),
e AS (SELECT k.*, whole + CASE WHEN key <= coalesce(last, '') THEN 1 ELSE 0 END AS epochs FROM k LEFT JOIN l USING (domain, lang, source))
SELECT doc_id, lang0 AS lang, source0 AS source, unnest(range(epochs))::INTEGER AS mix_epoch FROM e WHERE epochs > 0"""
