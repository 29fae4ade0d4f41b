"""N-gram Jaccard join (operator 9): which documents' word shingles overlap enough, and what they form together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from . import kernels as K
from .graph import components

CLASS = np.dtype([("key", "<u8"), ("more", "<u8"), ("id", "<i8")])
COUNT = np.dtype([("key", "<u8"), ("count", "u1")])
RANGES = 16  # of hash space, for the suffix filter
CELL = 256  # sets of a shingle's list that a task pairs with as many others
ROW = "pid int, id long, n long, rep long, again boolean, tokens array<long>, places array<int>, spread array<int>"


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and code of each distinct shingle, in that order; a text of fewer words is one shingle."""
    codes, first = K.word_codes(texts, lower=True)
    size = np.diff(first)
    grams, at = K.grams(codes, k), K.ranges(first[:-1], np.maximum(size - k + 1, 0))
    text, found = [np.repeat(np.arange(len(size)), np.maximum(size - k + 1, 0))], [grams[at]]
    for m in range(1, k):
        short = np.flatnonzero(size == m)
        text.append(short)
        found.append(K.grams(codes, m)[first[short]] + np.uint64(m))
    text, found = np.concatenate(text), np.concatenate(found)
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = B.first_of_runs(text, found)
    return text[new], found[new]


class Sets:
    """The shingle sets of a block's documents, their fingerprints, and classes of equal sets."""

    def __init__(self, block: B.Block, k: int, got: dict):
        chunks = [(begin, len(t), *shingle_sets(t, k)) for begin, t in block.chunks(all_rows=True)]
        self.doc = np.concatenate([text + begin for begin, _, text, _ in chunks] or [np.zeros(0, np.int64)])
        self.code = np.concatenate([h for *_, h in chunks] or [np.zeros(0, np.uint64)])
        self.size = np.bincount(self.doc, minlength=len(block.packed))
        self.end = np.cumsum(self.size)
        f1, f2 = (np.zeros(len(self.size), np.uint64) for _ in range(2))
        np.add.at(f1, self.doc, K.mix(self.code))
        np.add.at(f2, self.doc, K.mix(self.code ^ np.uint64(0x5DEECE66D)))
        some = np.flatnonzero(self.size[: block.known] > 0)
        order = some[np.lexsort((block.ids[some], f2[some], f1[some]))]
        new = B.first_of_runs(f1[order], f2[order])
        heads = order[new]
        self.keys = np.empty(len(heads), CLASS)
        self.keys["key"], self.keys["more"], self.keys["id"] = f1[heads], f2[heads], block.ids[heads]
        self.rep = block.ids.copy()  # of documents without words themselves
        least = np.frombuffer(got.get("classes", b""), "<i8")
        if len(least):
            self.rep[order] = least[np.cumsum(new) - 1]
        self.is_rep = np.zeros(len(self.size), bool)
        self.is_rep[heads] = self.rep[heads] == block.ids[heads]

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of the sets that stand for their classes, and in how many of those each is."""
        return np.unique(self.code[self.is_rep[self.doc]], return_counts=True)


def _first_ids(held: list) -> list[np.ndarray]:
    keys, _ = B.stacked(held)
    order = np.lexsort((keys["id"], keys["more"], keys["key"]))
    new = B.first_of_runs(keys["key"][order], keys["more"][order])
    out = np.empty(len(order), "<i8")
    out[order] = keys["id"][order][new][np.cumsum(new) - 1]
    return B.unstack(out, held)


def _rarities(held: list) -> list[np.ndarray]:
    keys, _ = B.stacked(held)
    _, inverse = np.unique(keys["key"], return_inverse=True)
    total = np.bincount(inverse, keys["count"])
    rarity = np.where(total <= 1, 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(total, 2))))).astype(np.uint8)
    return B.unstack(rarity[inverse], held)


def _prefixes(k: int, percent: int):
    """Each document's class and size; of those that stand for a class, the shared shingles of the rare-first prefix."""

    def rows(block, inner, got):
        sets = Sets(block, k, got)
        rarity, (found, _) = np.frombuffer(got.get("frequency", b""), np.uint8), sets.counted()
        use = sets.is_rep[sets.doc]
        doc, code = sets.doc[use], sets.code[use]
        size = np.bincount(doc, minlength=len(sets.size))
        rare = rarity[np.searchsorted(found, code)] if len(found) else np.zeros(0, np.uint8)
        order = np.lexsort((code, rare, doc))
        end = np.cumsum(size)
        place = np.arange(len(code)) - np.repeat(end - size, size)
        inside = np.flatnonzero((place < (size - (percent * size + 99) // 100 + 1)[doc]) & (rare[order] > 0))
        cut = np.searchsorted(doc[inside], np.arange(len(size) + 1))
        tokens, places = code[order[inside]].view(np.int64), place[inside].astype(np.int32)
        spread = np.bincount(doc * RANGES + (code >> np.uint64(60)).astype(np.int64), minlength=len(size) * RANGES).reshape(len(size), RANGES).astype(np.int32)
        again = np.r_[False, block.ids[1:] == block.ids[:-1]] if block.known else np.zeros(0, bool)
        again |= np.r_[again[1:], False] if block.known else again
        nulls = len(size) - block.known
        for a in range(0, len(size), 2000):
            b = min(a + 2000, len(size))
            lists = lambda x: pa.ListArray.from_arrays(pa.array((cut[a : b + 1] - cut[a]).astype(np.int32)), pa.array(x[cut[a] : cut[b]]))  # noqa: B023, E731
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * RANGES, RANGES, dtype=np.int32)), pa.array(spread[a:b].reshape(-1)))
            pad = np.zeros(nulls, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(b - a, block.pid, np.int32)), pa.array(block.raw_ids[a:b], pa.int64()), pa.array(sets.size[a:b]), pa.array(np.r_[sets.rep, pad][a:b], mask=np.arange(a, b) >= block.known),
                 pa.array(np.r_[again, pad.astype(bool)][a:b]), lists(tokens), lists(places), flat],
                ["pid", "id", "n", "rep", "again", "tokens", "places", "spread"],
            )

    return rows


def _whole_sets(corpus: B.Corpus, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, shingles): the whole sets of the documents (pid, rep) wanted."""

    def rows(block, inner, got):
        ids = np.frombuffer(got.get("wanted", b""), "<i8")
        some = np.flatnonzero(np.isin(block.ids, ids))
        for i in range(0, len(some), 200):
            part = some[i : i + 200]
            text, h = shingle_sets([B.expand(block.packed[j]) if block.packed[j] is not None else b"" for j in part], k)
            cut = np.searchsorted(text, np.arange(1, len(part)))
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[part]), pa.array([x.tobytes() for x in np.split(h, cut)], pa.binary())], ["rep", "shingles"])

    return corpus.knowing_ids(wanted.groupBy("pid").agg(F.collect_set("rep").alias("ids")), "wanted").visit("rep long, shingles binary", rows)


def _possible(x: str, y: str, percent: int) -> Column:
    """Length, positional and suffix filters; each holds for every pair that is similar enough."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    least = percent * (nx + ny)  # an overlap o is enough when (100 + percent) * o >= least
    left = F.least(nx - F.col(f"{x}.place"), ny - F.col(f"{y}.place"))
    within = F.aggregate(F.zip_with(f"{x}.spread", f"{y}.spread", lambda a, b: F.least(a, b)), F.lit(0), lambda s, v: s + v)
    return (100 * nx >= percent * ny) & (100 * ny >= percent * nx) & ((100 + percent) * left >= least) & ((100 + percent) * within >= least)


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * common >= percent * (len(p) + len(q) - common)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets are similar enough."""
    both = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")

    def run(batches):
        for t in batches:
            hit = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                hit.append(_similar(p, q, percent))
            yield t.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Link documents whose sets of k-word shingles have 100 * intersection >= percent * union.

    Words are split at ASCII white space, A to Z lower-cased; a text of fewer than k words is one
    shingle, one without words has none and links with nothing. Returns one row per document: doc_id,
    n_shingles, class_id (smallest id of the documents with exactly its set), component_id (smallest id
    that links reach). A null text has no words; rows without an id stay alone, with no class and no
    component; rows that share an id are one document; an empty table gives no rows.

    Shingles are ordered rare first, by exact counts up to a fine logarithmic step. Only the prefix that
    two similar sets must share is looked at, and of that only shingles of two documents or more, once
    per distinct set. Within each shingle's list every set is first paired with one hub, the one that has
    the shingle earliest; then pairs that are not yet in one component are paired exhaustively, so
    that groups of copies cost their number, not its square, and no link between components is missed.
    """
    return _joined(B.Corpus.deal(docs, id_col, text_col), k, percent).drop("pid")


def _lists(corpus: B.Corpus, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All documents, each with the smallest id that has its set (equal sets are found block by block, so that a hot one is a row a
    block), and each prefix shingle of the sets of those with the set."""

    def classes(block, got, n):
        keys = Sets(block, k, got).keys
        return B.part_of(keys["key"], n), keys

    def shingles(block, got, n):
        found, count = Sets(block, k, got).counted()
        # 48 bits, so that steps are short: where two shingles agree in them both count as more frequent, which changes only the order.
        short, inverse = np.unique(found & np.uint64(0xFFFFFFFFFFFF0000), return_inverse=True)
        keys = np.empty(len(found), COUNT)
        keys["key"], keys["count"] = short[inverse], np.minimum(count, 255)
        return B.part_of(keys["key"], n), keys

    told = corpus.ask_keys("classes", corpus.parts(), CLASS, classes, _first_ids)
    told = told.ask_keys("frequency", told.parts(), COUNT, shingles, _rarities)
    rows = told.visit(ROW, _prefixes(k, percent)).checkpoint()
    reps = rows.filter(F.size("tokens") > 0).select("pid", "rep", "n", "spread", F.explode(F.arrays_zip("tokens", "places")).alias("t"))
    return rows, reps.select("pid", F.col("t.tokens").alias("token"), F.struct("rep", "n", F.col("t.places").alias("place"), "spread").alias("x"))


def _joined(corpus: B.Corpus, k: int, percent: int) -> DataFrame:
    rows, listed = _lists(corpus, k, percent)
    hub = F.struct("x.place", "x.n", "x.rep", "x.spread")
    # A shingle of very many sets is a row a block where its hub is found and told.
    here = listed.groupBy("pid", "token").agg(F.min(hub).alias("y"), F.count("*").alias("c"))
    hubs = here.groupBy("token").agg(F.min("y").alias("y"), F.sum("c").alias("c")).filter("c > 1").select("token", "y")
    listed = listed.join(here.select("pid", "token").join(hubs, "token"), ["pid", "token"]).checkpoint()
    sets = _whole_sets(corpus, listed.select("pid", "x.rep").distinct(), k).checkpoint()
    order = [F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")]
    tried = listed.filter(F.col("x.rep") != F.col("y.rep")).filter(_possible("x", "y", percent)).select(*order).distinct().checkpoint()
    linked = _verified(tried, sets, percent).checkpoint()

    label = components(linked)
    labelled = listed.withColumn("rep", F.col("x.rep")).join(label.withColumnRenamed("node", "rep"), "rep", "left").select("token", "x", F.coalesce("component", "rep").alias("c"))
    sizes = labelled.groupBy("token", "c").agg(F.count("*").alias("m"))
    cells = lambda n: F.ceil(n / CELL).cast("int")
    main = sizes.groupBy("token").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("parts"), F.sum("m").alias("all"), F.max("m").alias("most")).filter("parts > 1")
    main = main.select("token", "main", cells(F.col("all")).alias("all"), cells(F.col("all") - F.col("most")).alias("few"))
    open_lists = labelled.join(main, "token").checkpoint()
    # What isn't of a list's largest component meets all of the list, in cells of about CELL sets by CELL sets.
    own = lambda n: F.pmod(F.xxhash64("x.rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    whole = open_lists.select("token", "main", "x", "c", own("all").alias("i"), every("few").alias("j"))
    rest = open_lists.filter("c <> main").select("token", F.col("x").alias("y"), F.col("c").alias("d"), own("few").alias("j"), every("all").alias("i"))
    pairs = whole.join(rest, ["token", "i", "j"]).filter((F.col("c") != F.col("d")) & ((F.col("c") == F.col("main")) | (F.col("x.rep") < F.col("y.rep")))).filter(_possible("x", "y", percent))
    more = _verified(pairs.select(*order).distinct().join(tried, ["a", "b"], "left_anti"), sets, percent)

    same_id = rows.filter("again and n > 0 and id is not null").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    label = components(linked.unionByName(more).unionByName(same_id)).withColumnRenamed("node", "rep")
    told = rows.filter("rep is not null").select("pid", "rep").distinct().join(label, "rep")  # a hot class is a row a block
    return rows.select("pid", "id", "n", "rep").join(told, ["pid", "rep"], "left").select("pid", F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """All links between classes, as (a, b) with a < b: both are a class_id of `jaccard_join`, and each pair is there once.

    The whole join that `jaccard_join` needs no more of than its components: a group of m different near
    copies gives up to m * (m - 1) / 2 links. Members of one class all link with each other and aren't listed. Texts
    of one id are one document, which links with what any of them links with.

    Lists are paired in cells of about CELL sets by CELL sets, so that a shingle of very many sets is
    many tasks' work; a pair is verified once, in one of its cells, which gets each of its sets once.
    """
    corpus = B.Corpus.deal(docs, id_col, text_col)
    _, listed = _lists(corpus, k, percent)
    cells = F.ceil(F.col("c") / CELL).cast("int")
    sizes = listed.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token", cells.alias("cells"))
    listed = listed.join(sizes, "token").withColumn("own", F.pmod(F.xxhash64("x.rep"), "cells").cast("int")).checkpoint()
    left = listed.select("token", F.col("own").alias("i"), F.explode(F.expr("sequence(own, cells - 1)")).alias("j"), "x")
    right = listed.select("token", F.explode(F.expr("sequence(0, own)")).alias("i"), F.col("own").alias("j"), F.col("x").alias("y"))
    tried = left.join(right, ["token", "i", "j"]).filter((F.col("i") < F.col("j")) | (F.col("x.rep") < F.col("y.rep"))).filter(F.col("x.rep") != F.col("y.rep")).filter(_possible("x", "y", percent))
    pairs = tried.groupBy(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).agg(F.min(F.struct("token", "i", "j")).alias("cell")).checkpoint()
    sets = _whole_sets(corpus, listed.select("pid", "x.rep").distinct(), k).checkpoint()
    needed = pairs.select(F.col("cell").alias("at"), F.explode(F.array("a", "b")).alias("rep")).distinct().join(sets, "rep")

    def run(pairs, sets):
        have = {}
        for rep, x in zip(sets["rep"].to_pylist(), sets["shingles"].to_pylist(), strict=True):
            have.setdefault(rep, []).append(np.frombuffer(x, np.uint64))
        hit = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
            hit.append(any(_similar(p, q, percent) for p in have[a] for q in have[b]))
        return pairs.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return pairs.groupBy("cell").cogroup(needed.groupBy("at")).applyInArrow(run, "a long, b long")


def near_duplicates_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Of each group that links reach, the document with the smallest id, with all its columns as they were.

    As `jaccard_join`. Rows without an id stay; of rows that share an id, which are one document, one
    stays, that of the smallest text. The text is moved once, into its block.
    """
    corpus = B.Corpus.deal(docs, id_col, text_col, carry=True)
    less = _joined(corpus, k, percent).filter("doc_id <> component_id").groupBy("pid").agg(F.collect_set("doc_id").alias("ids"))

    def rows(block, inner, got):
        keep = ~np.isin(block.ids, np.frombuffer(got.get("less", b""), "<i8")) & B.first_of_runs(block.ids)
        keep = np.r_[keep, np.ones(len(block.order) - block.known, bool)]
        yield from B.restored(block, inner, np.flatnonzero(keep), ["id", "z", "rest"])

    found = corpus.knowing_ids(less, "less").visit(B.restored_schema(corpus), rows)
    return B.as_before(found, docs, id_col, text_col)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_join(docs, k=3, percent=90).drop("class_id")


def all_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_links(docs, k=3, percent=90)


_SETS = """d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3) UNION ALL SELECT doc_id, w FROM d WHERE len(w) IN (1, 2)),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(g, ' ')) AS g FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),"""
_LINKS = """links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*)))"""
SQL = f"""WITH RECURSIVE {_SETS}
t AS (SELECT doc_id, g, n FROM s JOIN n USING (doc_id)),
{_LINKS},
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT r.a, links.b FROM r JOIN links ON r.c = links.a),
k AS (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN k USING (doc_id)"""


SQL_LINKS = f"""WITH {_SETS}
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM (SELECT doc_id, md5(string_agg(g, '' ORDER BY g)) AS h FROM s GROUP BY doc_id)),
t AS (SELECT doc_id, g, n FROM s JOIN n USING (doc_id) JOIN c USING (doc_id) WHERE doc_id = class_id),
{_LINKS}
SELECT a, b FROM links WHERE a < b"""
