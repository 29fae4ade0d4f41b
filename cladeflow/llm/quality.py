"""Quality rules with an isolation forest on their statistics (operator 1)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from . import kernels as K

TREES, TREE_ROWS, DEPTH = 100, 256, 8
ODD_SHARE = 0.06  # of a tree's rows, those with label 0
BAND = 0.005  # of good rows on either side of a statistic's usual range
SHIFTS = (53, 42, 31, 20, 10, 0)  # bits below those that each look for a rank tells apart

SYMBOLS = b"#*$%&|<>"
_set = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
_IS = {
    "symbol": _set(SYMBOLS), "upper": _set(bytes(range(65, 91))), "letter": _set(bytes([*range(65, 91), *range(97, 123)])) | (np.arange(256) >= 0xC0),
    "loud": _set(b"!?|~^_=+{}\\@/"), "digit": _set(b"0123456789"), "char": (np.arange(256) & 0xC0) != 0x80, "space": _set(b" \t\n\x0b\x0c\r"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = ("log of words", "word length", "symbols", "duplicate lines", "words of repeated windows", "distinct words", "words that repeat the one before", "upper case", "digits", "loud characters")


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the five counts of COUNTS, and the numbers of STATISTICS that the forest looks at."""
    flat, begins = K.join_texts(texts)
    n = len(texts)
    start, end, first = K.words(flat, begins)
    words = np.diff(first)
    per_text = lambda name: np.add.reduceat(_IS[name][flat], begins[:-1], dtype=np.int64)

    stop = np.flatnonzero(flat == 10)  # each text ends with one that join_texts added
    line = np.r_[0, stop[:-1] + 1]
    text = np.searchsorted(begins, line, "right") - 1
    full = np.searchsorted(start, stop) > np.searchsorted(start, line)
    lines = np.bincount(text[full], minlength=n)
    dup_lines = lines - _distinct(text[full], K.stretches(flat, line[full], stop[full]), n)

    code = K.stretches(flat, start, end)
    owner = np.repeat(np.arange(n), np.maximum(words - 4, 0))
    at = K.ranges(first[:-1], np.maximum(words - 4, 0))
    five = K.grams(code, 5)[at]
    order = np.lexsort((five, owner))
    new = B.first_of_runs(owner[order], five[order])
    often = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1 if len(order) else np.zeros(0, bool)
    hit = np.sort(at[order][often])
    repeat = np.diff(np.r_[0, np.cumsum(K.covered(len(start), hit, hit + 5))][first])

    # A character starts with the byte that isn't a continuation; those outside words are white space.
    chars = per_text("char") - per_text("space")
    symbols = per_text("symbol")
    counts = np.stack([words, chars, symbols, dup_lines, repeat], 1)
    same = np.r_[False, code[1:] == code[:-1]] if len(code) else np.zeros(0, bool)
    same[first[:-1][words > 0]] = False
    share = lambda a, b: a / np.maximum(b, 1)
    found = [
        np.log1p(words), share(chars, words), share(symbols, chars), share(dup_lines, lines), share(repeat, words), share(_distinct(np.repeat(np.arange(n), words), code, n), np.sqrt(words)),
        share(np.diff(np.r_[0, np.cumsum(same)][first]), words), share(per_text("upper"), per_text("letter")), share(per_text("digit"), chars), share(per_text("loud"), chars),
    ]
    return counts, np.stack(found, 1)


def _distinct(owner: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """How many different codes each of n owners has."""
    order = np.lexsort((code, owner))
    return np.bincount(owner[order][B.first_of_runs(owner[order], code[order])], minlength=n)


def chunked(batch: pa.RecordBatch, column: int, most: int = B.CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """First row, and texts (null: empty), of about `most` bytes together."""
    begin, texts, size = 0, [], 0
    for i, t in enumerate(batch.column(column).cast(pa.binary())):
        texts.append(t.as_py() or b"")
        size += len(texts[-1])
        if size >= most:
            yield begin, texts
            begin, texts, size = i + 1, [], 0
    if texts:
        yield begin, texts
    B.give_back()


class IsolationForest:
    """Trees of random splits over small samples; rows that end near the root are anomalous.

    Each statistic is taken as how far it lies outside the range that good rows usually have, so that rows which are
    usual in all of them stay together, however many statistics there are.
    """

    def __init__(self, good: np.ndarray, odd: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        g, k = rows_of_a_tree(len(good), len(odd))
        ends = np.quantile(good if len(good) else odd, [BAND, 1 - BAND], axis=0)
        self._fit(*ends, (np.concatenate([good[rng.choice(len(good), g, False)], odd[rng.choice(len(odd), k, False)]]) for _ in range(TREES)), rng)

    @classmethod
    def of(cls, low: np.ndarray, high: np.ndarray, drawn: Iterable[np.ndarray], seed: int = 7) -> IsolationForest:
        """The forest of given ranges and of the rows drawn for each tree."""
        forest = cls.__new__(cls)
        forest._fit(low, high, drawn, np.random.default_rng(seed))
        return forest

    def _fit(self, low: np.ndarray, high: np.ndarray, drawn: Iterable[np.ndarray], rng) -> None:
        self.low, self.high = low, high
        self.scale = np.maximum(self.high - self.low, 1e-3)
        nodes = 2 ** (DEPTH + 1) - 1
        self.feature = np.full((TREES, nodes), -1, np.int16)
        self.cut, self.path = np.zeros((TREES, nodes)), np.zeros((TREES, nodes))
        for t, rows in enumerate(drawn):
            self._grow(t, 0, 0, self.beyond(rows), rng)
        self.size = TREE_ROWS

    def _grow(self, t: int, node: int, depth: int, rows: np.ndarray, rng) -> None:
        spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 and depth < DEPTH else ()
        if not len(spread):
            self.path[t, node] = depth + _expected(len(rows))
            return
        f = int(rng.choice(spread))
        cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
        self.feature[t, node], self.cut[t, node] = f, cut
        below = rows[:, f] < cut
        self._grow(t, 2 * node + 1, depth + 1, rows[below], rng)
        self._grow(t, 2 * node + 2, depth + 1, rows[~below], rng)

    def beyond(self, rows: np.ndarray) -> np.ndarray:
        return np.log1p(np.maximum(np.maximum(rows - self.high, self.low - rows), 0) / self.scale)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; near 1 for rows that are isolated soon."""
        rows = self.beyond(rows)
        node, tree = np.zeros((len(rows), TREES), np.int64), np.arange(TREES)
        for _ in range(DEPTH):
            f = self.feature[tree, node]
            inner = f >= 0
            right = np.take_along_axis(rows, np.maximum(f, 0).astype(np.int64), 1) >= self.cut[tree, node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return 2.0 ** (-self.path[tree, node].mean(1) / _expected(self.size))


def rows_of_a_tree(good: int, odd: int) -> tuple[int, int]:
    """How many rows of each label a tree is grown on."""
    k = min(odd, int(TREE_ROWS * ODD_SHARE) if good else TREE_ROWS)
    return min(good, TREE_ROWS - k), k


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The score that best tells the labels apart: share of bad rows above it less three times that of good rows."""
    if not len(scores) or good.all() or not good.any():
        return np.inf
    order = np.argsort(-scores, kind="stable")
    s, g = scores[order], good[order]
    gain = np.cumsum(~g) / (~g).sum() - 3 * np.cumsum(g) / g.sum()
    ends = np.flatnonzero(np.r_[s[1:] != s[:-1], True])
    best = ends[np.argmax(gain[ends])]
    return np.inf if gain[best] <= 0 else (s[best] + s[best + 1]) / 2 if best + 1 < len(s) else s[best]


def _known(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(_of, _y): an id with several labels has the lowest; labels other than 0 and 1 and rows without id or label are passed over."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("_of"), F.col(f"`{label_col}`").cast("int").alias("_y"))
    return known.filter("_of is not null and _y in (0, 1)").groupBy("_of").agg(F.min("_y").alias("_y"))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(_id, _y, _text) of at most `rows` labelled documents of each label, in an order that hashes decide; labels as `_known` says."""
    known = _known(labels, id_col, label_col)
    some = [known.filter(F.col("_y") == y).orderBy(F.xxhash64("_of"), "_of").limit(rows) for y in (0, 1)]
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    # At most 2 * rows pairs of numbers are broadcast.
    return texts.join(F.broadcast(some[0].unionByName(some[1])), F.col("_id") == F.col("_of")).select("_id", "_y", "_text")


def labelled_statistics(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, y, x) of every labelled document, x its statistics; of rows that share an id one is taken. Statistics are what is joined; texts stay where they are."""

    def run(batches):
        for b in batches:
            for begin, texts in chunked(b, 1):
                _, shares = statistics(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, len(texts)), pa.array(list(shares), pa.list_(pa.float64()))], ["id", "x"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).filter("id is not null")
    found = texts.mapInArrow(run, "id long, x array<double>").join(_known(labels, id_col, label_col), F.col("id") == F.col("_of"))
    B.shared_checkpoints(docs.sparkSession)
    return found.groupBy("id", F.col("_y").alias("y")).agg(F.min("x").alias("x")).checkpoint()


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Codes of numbers, in the numbers' order."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _numbers(code: np.ndarray) -> np.ndarray:
    return np.where(code >> np.uint64(63) == 1, code & np.uint64((1 << 63) - 1), ~code).view(np.float64)


def quantiles(rows: DataFrame, n: int, shares: tuple[float, ...]) -> np.ndarray:
    """Exact quantiles of the columns of x, as np.quantile has them; n is the number of rows.

    The values of the ranks asked for are found a few bits at a time: each pass counts the next bits of the values that begin as theirs do. A pass sends the
    driver at most 2048 counts for each value looked for, and moves and sorts no values.
    """
    place = (n - 1) * np.array(shares)
    rank = np.repeat(np.c_[np.floor(place), np.minimum(np.floor(place) + 1, n - 1)].astype(np.int64).reshape(1, -1), len(STATISTICS), 0)
    begin, done = np.zeros(rank.shape, np.uint64), 64
    for shift in SHIFTS:

        def run(batches, begin=begin, done=done, shift=shift):
            counts: dict[tuple[int, int], int] = {}
            for b in batches:
                for f, code in enumerate(_ordered(_matrix(b)).T):
                    own = code if done == 64 else code[np.isin(code >> np.uint64(done), begin[f])]
                    for v, c in zip(*(a.tolist() for a in np.unique(own >> np.uint64(shift), return_counts=True)), strict=True):
                        counts[f, v] = counts.get((f, v), 0) + c
            f, v = zip(*counts, strict=True) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(np.array(v, np.uint64).view(np.int64)), pa.array(counts.values(), pa.int64())], ["f", "v", "n"])

        told = rows.select("x").mapInArrow(run, "f int, v long, n long").groupBy("f", "v").agg(F.sum("n").alias("n")).toPandas()
        value, count, of = told["v"].to_numpy(np.int64).view(np.uint64), told["n"].to_numpy(), told["f"].to_numpy()
        found = np.zeros_like(begin)
        for f, i in np.ndindex(rank.shape):
            mine = np.flatnonzero((of == f) & ((done == 64) | (value >> np.uint64(min(done - shift, 63)) == begin[f, i])))
            mine = mine[np.argsort(value[mine])]
            so_far = np.cumsum(count[mine])
            at = np.searchsorted(so_far, rank[f, i], "right")
            found[f, i] = value[mine[at]]
            rank[f, i] -= so_far[at] - count[mine[at]]
        begin, done = found, shift
    ends = _numbers(begin).reshape(len(STATISTICS), -1, 2)
    a, b, t = ends[..., 0], ends[..., 1], place - np.floor(place)
    return np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t).T


def draws(rows: DataFrame, sizes: tuple[int, int], seed: int = 7) -> list[np.ndarray]:
    """The rows that each tree is grown on, drawn from all labelled rows: those of the smallest codes of id and tree; sizes are the numbers of rows of labels 1 and 0.

    A share of rows that nearly surely holds enough is looked at, whatever the number of rows; if it doesn't, a larger one.
    """
    wanted, more = rows_of_a_tree(*sizes), 1
    while True:
        share = [min(1.0, more * (k + 8 * k**0.5 + 16) / max(n, 1)) for k, n in zip(wanted, sizes, strict=True)]
        limit = np.array([int(s * (2**64 - 1025)) for s in share[::-1]], np.uint64)  # by label
        limit[np.array(share[::-1]) >= 1] = 2**64 - 1
        asked = np.array(wanted[::-1]) > 0

        def run(batches, limit=limit, asked=asked):
            trees = K.mix(np.arange(1, TREES + 1, dtype=np.uint64) + np.uint64(seed << 32))
            for b in batches:
                y = b.column("y").to_numpy()
                code = K.pair(b.column("id").to_numpy().astype(np.int64).view(np.uint64)[:, None], trees[None, :])
                row, tree = np.nonzero((code <= limit[y][:, None]) & asked[y][:, None])
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array((code[row, tree] ^ np.uint64(1 << 63)).view(np.int64)), *(b.column(c).take(pa.array(row)) for c in ("id", "y", "x"))], ["tree", "code", "id", "y", "x"])

        found = rows.select("id", "y", "x").mapInArrow(run, "tree long, code long, id long, y int, x array<double>").toPandas().sort_values(["tree", "code", "id"])  # at most some 500 short rows a tree
        x, tree, y = np.array(found["x"].tolist()), found["tree"].to_numpy(), found["y"].to_numpy()
        chosen = [[np.flatnonzero((tree == t) & (y == label))[:k] for label, k in zip((1, 0), wanted, strict=True)] for t in range(TREES)]
        if all(len(at) == k for of in chosen for at, k in zip(of, wanted, strict=True)):
            return [x[np.concatenate(of)] for of in chosen]
        more *= 2


def threshold_of_rows(rows: DataFrame, score: Callable[[np.ndarray], np.ndarray], sizes: tuple[int, int]) -> float:
    """What `threshold` finds for the scores of all rows. Scores are sorted over ranges, and each range counts on from those before it."""
    if not all(sizes):
        return np.inf

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(score(_matrix(b))), b.column("y")], ["s", "y"])

    scored = rows.select("x", "y").mapInArrow(run, "s double, y int").groupBy("s").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("odd"))
    ranged = scored.repartitionByRange(F.desc("s")).withColumn("part", F.spark_partition_id()).checkpoint()  # ranges are drawn anew whenever they are run
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ranged.groupBy("part").agg(F.sum("good").alias("g"), F.sum("odd").alias("o")).select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "go"))
    own = Window.partitionBy("part").orderBy(F.desc("s"))
    gain = (F.col("o_before") + F.sum("odd").over(own)) / F.lit(sizes[1]) - 3 * (F.col("g_before") + F.sum("good").over(own)) / F.lit(sizes[0])
    best = ranged.join(F.broadcast(starts), "part").select(gain.alias("gain"), "s").agg(F.max(F.struct("gain", "s")).alias("best")).head()["best"]
    if best["gain"] <= 0:
        return np.inf
    below = ranged.filter(F.col("s") < best["s"]).agg(F.max("s")).head()[0]
    return best["s"] if below is None else (best["s"] + below) / 2


def fit_forest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[IsolationForest, float] | None:
    """Forest and threshold from every labelled document; None without any. Ranges and threshold are exact; each tree's rows are drawn from all of them."""
    rows = labelled_statistics(docs, labels, id_col, text_col, label_col)
    n = dict(map(tuple, rows.groupBy("y").count().collect()))
    sizes = n.get(1, 0), n.get(0, 0)
    if not any(sizes):
        return None
    low, high = quantiles(rows.filter(F.col("y") == (1 if sizes[0] else 0)), sizes[0] or sizes[1], (BAND, 1 - BAND))
    forest = IsolationForest.of(low, high, draws(rows, sizes))
    return forest, threshold_of_rows(rows, forest.scores, sizes)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", into: str = "rules") -> DataFrame:
    """Rule statistics of every whole text and whether to keep it, as the struct column `into` beside the input's.

    It holds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than 10
    words, or over a fifth of them in 5-word windows that occur twice), anomaly (the forest's score)
    and kept. The base rules come first; what passes them is kept unless the isolation forest isolates it
    sooner than the threshold calibrated on labelled rows. Without rows of both labels only the base
    rules decide. A null or blank text has no words and fails; an input column of the name `into` is
    replaced, others may have any names; repeated rows are judged alike; labels are read as `_known` says; an empty
    table gives no rows. One pass to fit, of which statistics alone are shuffled, and one to judge; working memory is some 15 times the longest single text.
    """
    model = fit_forest(docs, labels, id_col, text_col, label_col)
    docs = docs.drop(into)
    kind = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    at, names = docs.columns.index(text_col), [*docs.columns, into]

    def run(batches):
        for b in batches:
            for begin, texts in chunked(b, at):
                counts, shares = statistics(texts)
                n, repeat = counts[:, 0], counts[:, 4]
                failed = (n < 10) | (100 * repeat > 20 * n)
                score = model[0].scores(shares) if model else np.zeros(len(n))
                kept = ~failed & (score < (model[1] if model else np.inf))
                rules = pa.StructArray.from_arrays([*(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(kept)], kind.names)
                yield pa.RecordBatch.from_arrays([*b.slice(begin, len(texts)).columns, rules], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, kind)]))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_rules(docs.select("doc_id", "text"), labels).select("doc_id", "rules.*")


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of operator 1 SQL can say: the counts and the base rules, without the forest's verdict."""
    return op1_quality_rules(spark, sf_dir).drop("anomaly", "kept")


SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM f), range(5) t(k) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n, 0) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, (len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w)) AS base_failed FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)"""
