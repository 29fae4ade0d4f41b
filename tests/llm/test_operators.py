"""The operators against plain Python on small documents, with nulls, ties, repetition, long texts, empty tables and clashing names."""

from __future__ import annotations

import collections
import math
import os
import random
import sys
import zlib

import numpy as np
import pytest
from conftest import oracle, same
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from cladeflow.llm import blocks, classifier, dedup, graph, jaccard, kernels, lm_score, mixing, packing, quality, queries, repeats, token_files, topk  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, kept string, rest int, pid string, rules string, quality int, n_chars long"


def make(n: int, seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    voc = [*"abcdefghij", "Wörd", "née", "x.y", "it's", "日本", "a b", "THE", "of,", "#tag"]
    rows: list[tuple] = []
    for d in range(n):
        t = " ".join(r.choice(voc) for _ in range(r.choice([0, 1, 2, 5, 11, 30, 80])))
        if rows and r.random() < 0.6:
            o = r.choice(rows)[1] or ""
            a, b = sorted((r.randrange(len(o) + 1), r.randrange(len(o) + 1)))
            t = t[:15] + o[a:b] + r.choice(["", "\n", "  ", "\t"]) + t[15:]
        if rows and r.random() < 0.15:
            t = r.choice(rows)[1] or ""
        rows.append((d, t))
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n\t "), (3, rows[5][1]), (4, rows[4][1]), (None, rows[6][1]), (None, None), (n + 3, "long " * 3000 + "tail"), (n + 4, "y" * 70_000)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make(70)


@pytest.fixture(scope="module")
def docs(spark, rows):
    more = [(d, t, ["en", "de", None][i % 3], f"src{i % 4}" if i % 7 else None, "k", i, "p", "r", 1, None if t is None else len(t)) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(more, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)


@pytest.mark.parametrize(("unit", "window", "crowd"), [("word", 6, 50_000), ("word", 12, 50_000), ("word", 12, 2), ("byte", 9, 50_000), ("byte", 20, 50_000), ("byte", 9, 1), ("byte", 20, 3)])
def test_repeats(spark, docs, rows, small_blocks, unit, window, crowd):
    if unit == "word":
        found = dedup.substring_dedup(docs, window=window, crowd=crowd)
    else:
        found = dedup.suffix_array_dedup(docs, window=window, crowd=crowd)
    got = collections.defaultdict(list)
    for r in found.collect():
        got[r.doc_id].append((r.n_units, r.n_removed, r.n_spans, r.kept_sha256))
    want = brute.repeats(rows, unit, window)
    assert {d: sorted(v) for d, v in got.items()} == want
    assert sum(x[1] for v in want.values() for x in v) > 100


def test_small_trees(spark, docs, rows, small_blocks):
    """Groups of suffixes taken one by one give the same result as many together."""

    class OneByOne(repeats.SuffixTrees):
        TOGETHER = 1

    got = collections.defaultdict(list)
    plan = repeats.Plan("word", 8, 4, 1, 50)
    for r in dedup._strip(docs, "doc_id", "text", plan, OneByOne(plan), dedup._keep_words, False).collect():
        got[r.doc_id].append((r.n_units, r.n_removed, r.n_spans, r.kept_sha256))
    assert {d: sorted(v) for d, v in got.items()} == brute.repeats(rows, "word", 8)


@pytest.mark.parametrize(("unit", "resolver"), [("word", "SuffixTrees"), ("byte", "PreviousFactors")])
def test_removals_come_from_the_method(spark, docs, unit, resolver):
    """Without the trees' or arrays' answers only whole copies go."""

    class Silent(getattr(repeats, resolver)):
        def answer(self, held):
            leaves = repeats.Leaves(held)
            return [(0, blocks.squeeze(bytes(n * self.MASKS.itemsize)), 0) for n in leaves.counts]

    plan = repeats.Plan(unit, 8, 8, 3, 50)
    keep = dedup._keep_words if unit == "word" else dedup._keep_bytes
    left = dedup._strip(docs, "doc_id", "text", plan, Silent(plan), keep, False).collect()
    assert all(r.n_removed in (0, r.n_units) for r in left)
    strip = dedup.substring_dedup if unit == "word" else dedup.suffix_array_dedup
    assert sum(r.n_removed for r in strip(docs, window=8).collect()) > sum(r.n_removed for r in left)


def _thue_morse(n: int) -> tuple[str, str]:
    """Two different words that sums of powers modulo 2**64 can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_words_of_patterns_differ(spark, n, tmp_path):
    a, b = _thue_morse(n)
    codes, _ = kernels.word_codes([f"{a} {b}".encode()])
    assert codes[0] != codes[1]
    head = " ".join(f"w{i}" for i in range(30))
    rows = [(0, f"{head} {a} {head}"), (1, f"{head} {b} {head}"), (2, f"{head} {a} {head}!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in dedup.substring_dedup(df, window=31).collect()} == {d: v[0][1] for d, v in brute.repeats(rows, "word", 31).items()}
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_join(df, k=3, percent=95).collect()} == brute.linked(rows, 3, 95)
    counts, _ = quality.statistics([f"{a}\n{b}\n{a}".encode(), f"{a} x y z {b} x y z {b} x y z {b}".encode()])
    assert [tuple(c) for c in counts] == [tuple(np.array(brute.rules(t))[[0, 1, 2, 3, 4]]) for t in (f"{a}\n{b}\n{a}", f"{a} x y z {b} x y z {b} x y z {b}")]
    for name, kind in (("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")):
        from cladeflow.llm.encoding import Encoder

        path, t = _tokenizer(name)
        for x, g in zip([a, b], Encoder(path, kind).encode([a.encode(), b.encode()]), strict=True):
            assert np.frombuffer(g, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_encoder_tells_equal_hashes_apart(monkeypatch):
    """Pieces whose hashes are all the same few numbers."""
    from cladeflow.llm import encoding

    monkeypatch.setattr(encoding.K, "mix", lambda x: x % np.uint64(3))
    path, t = _tokenizer("byte_bpe_50k.json")
    code = encoding.Encoder(path, "bytes")
    for text in ("one two three.\nfour five, one two", "six two\none three. one", "one two"):
        assert np.frombuffer(code.encode([text.encode()])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("k", "percent"), [(1, 50), (2, 60), (3, 90), (5, 80)])
def test_jaccard(spark, docs, rows, small_blocks, k, percent):
    got = jaccard.jaccard_join(docs, k=k, percent=percent).collect()
    want = brute.linked(rows, k, percent)
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((d or -1, len(brute.shingles(t, k))) for d, t in rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert len(set(want.values())) < len(want)


def test_jaccard_chain_and_hub(spark, small_blocks):
    """Many near copies of one text, none of them the text itself, and chains of edits."""
    r, base = random.Random(1), [f"w{i}" for i in range(60)]
    rows = []
    for d in range(120):
        t = list(base)
        for _ in range(r.choice([1, 1, 2, 2, 3])):
            t[r.randrange(60)] = f"n{r.randrange(10_000)}"
        rows.append((d, " ".join(t)))
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=80)
    assert {x.doc_id: x.component_id for x in got.collect()} == brute.linked(rows, 3, 80)


@pytest.mark.parametrize(("k", "percent", "cell"), [(1, 50, 256), (2, 60, 2), (1, 70, 3)])
def test_jaccard_links(spark, docs, rows, small_blocks, monkeypatch, k, percent, cell):
    """All pairs, also those within a component, whatever the size of cells."""
    monkeypatch.setattr(jaccard, "CELL", cell)
    got = [(r.a, r.b) for r in jaccard.jaccard_links(docs, k=k, percent=percent).collect()]
    assert got
    assert sorted(got) == brute.links(rows, k, percent)


def test_near_duplicates_removed(spark, docs, rows, small_blocks):
    got = jaccard.near_duplicates_removed(docs, k=2, percent=60)
    assert got.schema == docs.schema
    comp = brute.linked(rows, 2, 60)
    found = got.collect()
    assert sorted(r.doc_id for r in found if r.doc_id is not None) == sorted(d for d in comp if comp[d] == d)
    assert sum(r.doc_id is None for r in found) == 2
    before = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in before for r in found)


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 40)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent if n in got}
    assert set(got) == {n for e in edges for n in e if e[0] != e[1]}


def test_quality_rules(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(docs, labels)
    assert got.columns == [c for c in docs.columns if c != "rules"] + ["rules"]
    found = got.select("doc_id", "text", "rules.*").collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.rules(r.text)
        assert not (r.base_failed and r.kept)
    unlabelled = quality.quality_rules(docs, labels.filter("false")).select("rules.*").collect()
    assert all(r.kept != r.base_failed for r in unlabelled)


def test_isolation_forest_finds_outliers():
    rng = np.random.default_rng(0)
    good, odd = rng.normal(0, 0.1, (2000, 4)), rng.normal(2, 0.3, (100, 4))
    forest = quality.IsolationForest(good, odd)
    cut = quality.threshold(forest.scores(np.r_[good, odd]), np.r_[np.ones(2000, bool), np.zeros(100, bool)])
    assert (forest.scores(odd) >= cut).mean() > 0.95
    assert (forest.scores(good) >= cut).mean() < 0.02
    assert quality.threshold(np.ones(5), np.ones(5, bool)) == np.inf


def test_classifier(spark, sf, docs):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = classifier.classify_quality(d.select("doc_id", "text"), labels).join(labels.select("doc_id", F_quality()), "doc_id").select("quality.*", "y").collect()
    known = [r for r in got if not r.held_out]
    assert np.mean([r.predicted == r.y for r in known]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    plain = classifier.classify_quality(docs, labels.filter("false")).select("quality.*").collect()
    assert {r.score for r in plain} == {0.5}


def test_classifier_on_unseen_documents(spark, sf):
    """Rows that training never sees, told as the classifier's training tells them."""
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = classifier.classify_quality(d.select("doc_id", "text"), labels).join(labels.select("doc_id", F_quality()), "doc_id").select("doc_id", "quality.*", "y").collect()
    unseen = [r for r in got if r.held_out]
    assert {r.doc_id for r in unseen} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert len({r.y for r in unseen}) == 2
    assert np.mean([r.predicted == r.y for r in unseen]) > 0.95
    assert all(np.mean([r.predicted == y for r in unseen if r.y == y]) > 0.9 for y in (0, 1))


def F_quality():
    from pyspark.sql import functions as F

    return F.col("quality").alias("y")


def test_held_out_is_crc32(spark):
    got = spark.range(200).select("id", classifier.held_out(F_col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_cross_entropy(spark, docs, rows, small_blocks):
    target = spark.createDataFrame([(i,) for i in range(0, 70, 3)] + [(None,), (3,), (999,)], "doc_id long")
    t = set(range(0, 70, 3))
    texts = [(d, (x or "").encode().split()) for d, x in rows]
    count = collections.Counter(w for d, x in texts if d is not None for w in x)
    texts = [(d, [w if count[w] >= 2 else None for w in x]) for d, x in texts]
    one, two, n, s = [collections.Counter() for _ in range(2)], [collections.Counter() for _ in range(2)], [0, 0], [0, 0]
    for d, x in texts:
        for m in (() if d is None else (0, 1) if d in t else (0,)):
            one[m].update(x)
            two[m].update(zip(["<s>", *x], x, strict=False))
            n[m] += len(x)
            s[m] += bool(x)
    want = []
    for d, x in texts:
        loss = []
        for m in (0, 1):
            p = [0.7 * two[m][v, w] / max(s[m] if v == "<s>" else one[m][v], 1) + 0.29 * one[m][w] / max(n[m], 1) + 0.01 / 2**20 for v, w in zip(["<s>", *x], x, strict=False)]
            loss.append(-sum(map(math.log, p)) / max(len(x), 1))
        want.append((d if d is not None else -1, len(x), loss[1], loss[0]))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ce_target, r.ce_background) for r in lm_score.cross_entropy_difference(docs, target).collect())
    assert np.allclose(np.array(got), np.array(sorted(want)), atol=1e-9)


def test_cross_entropy_of_a_larger_corpus(spark):
    """Words of three occurrences stay words of their own, and scores apart, however large the rest of the corpus is."""
    rows = [(i, "alpha beta" if i < 3 else "gamma delta") for i in range(6)]
    large = spark.range(10, 14).select(F_col("id").alias("doc_id"), F_expr("repeat('y', 7000000)").alias("text"))
    target = spark.createDataFrame([(0,), (1,)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string").unionByName(large), target).collect()}
    floor = 0.01 / 2**20
    begun = [-math.log(0.7 * 3 / 10 + 0.29 * 3 / 16 + floor), -math.log(0.7 + 0.29 * 3 / 16 + floor)]
    assert got[2].ce_background == pytest.approx(sum(begun) / 2)
    assert got[2].ce_target == pytest.approx((-math.log(0.7 + 0.29 * 2 / 4 + floor)))
    assert got[5].ce_target == pytest.approx(-math.log(floor))
    assert got[2].ce_difference < 0 < got[5].ce_difference


def F_expr(text):
    from pyspark.sql import functions as F

    return F.expr(text)


def test_planes():
    r = np.random.default_rng(5)
    for n in (1, 2, 1000):
        x = np.zeros(n, lm_score.COUNTED)
        x["key"], x["all"], x["target"] = np.sort(r.integers(0, 2**64, n, dtype=np.uint64)), r.integers(0, 2**32, n), r.integers(0, 3, n)
        assert (blocks.from_planes(blocks.by_planes(x, "key"), x.dtype, "key") == x).all()
        assert (blocks.from_planes(blocks.by_planes(x), x.dtype) == x).all()


@pytest.mark.parametrize("query", list(queries.SQL))
def test_sql(spark, sf, query):
    assert not (found := same(queries.QUERIES[query](spark, sf).toPandas(), oracle(queries.SQL[query], sf))), found


def test_top_k_edges(spark):
    r = random.Random(4)
    v = [(i, [r.choice([-0.5, 0.0, 0.25, 0.1]) for _ in range(5)]) for i in range(300)]
    v += [(300, None), (301, [0.1, None, 0.1, 0.1, 0.1]), (302, [float("nan")] * 5), (303, [float("inf")] * 5), (None, [0.1] * 5), (304, [0.5, 0.5]), (400, [0.25, -0.5]), (500, []), (7, v[8][1])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F_col("vec_id") % 100 == 0, 10).collect()
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in v if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q, a in whole:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(b) == len(a))[:10]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [3.0, 2.0e9])], "vec_id long, embedding array<double>")
    assert [(x.vec_id, x.score) for x in sorted(topk.top_k(huge, F_col("vec_id") == 0, 2).collect())] == [(1, 2**63 - 1), (2, 2**63 - 1)]


def test_mixing_redistributes(spark):
    """A domain whose leaves can't take its share leaves it to its siblings, languages first."""
    leaves = [("a", "en", "s0", 1000, 10), ("a", "en", "s1", 10, 1), ("a", "de", "s2", 10, 1), ("b", "en", "s3", 5000, 50)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, docs long")
    w = {("a",): 1.0, ("b",): 1.0, ("a", "en"): 1.0, ("a", "de"): 1.0, ("a", "en", "s0"): 1.0, ("a", "en", "s1"): 1.0}
    got = {r.source: r.budget for r in mixing.budgets(df, ("domain", "lang", "source"), 2000.0, 2, 1.0, w).collect()}
    assert got == pytest.approx({"s2": 20.0, "s1": 20.0, "s0": 960.0, "s3": 1000.0})
    more = {r.source: r.budget for r in mixing.budgets(df, ("domain", "lang", "source"), 8000.0, 2, 1.0, w).collect()}
    assert more == pytest.approx({"s2": 20.0, "s1": 20.0, "s0": 2000.0, "s3": 5960.0})


def test_mix_edges(spark, docs, rows):
    got = mixing.mix_sources(docs)
    assert got.columns == [*docs.columns, "mix_epoch"]
    again = mixing.mix_sources(docs.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.rest, r.mix_epoch)
    found = got.collect()
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert sum(len(brute.words(r.text)) for r in found) >= 0.9 * sum(len(brute.words(t)) for _, t in rows)


def _tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return public_tokenizers.path(name), t


def test_packing(spark, docs, rows):
    path, t = _tokenizer("byte_bpe_50k.json")
    want = collections.Counter((d, np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for d, x in rows)
    pieces = packing.pack_documents(docs, path).toPandas()
    size = pieces.groupby("sequence_id").agg(n=("length", "sum"), tier=("tier", "max"))
    assert (size.n == size.tier).all()
    assert all(s & (s - 1) == 0 and s <= 1024 for s in size.n)
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.r_[0, np.cumsum(s.length)[:-1]]).all()
    ids = sum((sorted(map(bytes, g.ids)) for _, g in pieces.groupby(["sequence_id"])), [])
    assert sum(map(len, ids)) == sum(len(b) * n for (_, b), n in want.items())
    # Rows of their own id are put together again exactly.
    single = [d for d, n in collections.Counter(d for d, _ in rows).items() if n == 1 and d is not None]
    for d in single:
        p = pieces[pieces.doc_id == d].sort_values("start")
        assert (d, b"".join(map(bytes, p.ids))) in want
        assert (p.doc_tokens == p.length.sum()).all()


def test_tiers_fill_gaps():
    t = packing.Tiers((8, 4, 2))
    for d, n in enumerate([5, 7, 3, 2, 1, 6]):
        t.route(d, 0, n)
    out = list(t.windows())
    assert sum(size for size, _ in out) == 24
    assert all(sum(p[2] for p in pieces) == size for size, pieces in out)


def test_token_files(spark, docs, rows, small_blocks, tmp_path):
    path, t = _tokenizer("word_bpe_49k.json")
    token_files.write_token_files(docs, str(tmp_path / "files"), path)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.scan_token_files(spark, str(tmp_path / "files")).collect())
    at = 0
    for d, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode())):
        if d is None:
            break
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        assert got.pop(0) == (at, d, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    last = sorted((r[2], r[3]) for r in got)
    want = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for d, x in rows if d is None]
    assert last == sorted((len(w), zlib.crc32(w.tobytes())) for w in want)
    assert [r[0] for r in got] == [at, at + got[0][2]]
    assert {r[1] for r in got} == {None}


def test_minimal_perfect_hash():
    ids = np.sort(np.r_[np.arange(0, 20_000, 3), [9, 9, 9]])
    keys = token_files.key_codes(ids)
    at = np.arange(len(ids)) * 8
    index = token_files.Index.load(token_files.Index.build(keys, at, np.full(len(ids), 8)).dump())
    assert sorted(index.slots(keys)) == list(range(len(ids)))
    there, found, _ = index.find(keys)
    assert there.all()
    assert (found == at).all()
    absent, _, _ = index.find(token_files.key_codes(np.arange(1, 20_000, 3)))
    assert absent.mean() < 0.001
    assert not token_files.Index.load(token_files.Index.build(keys[:0], at[:0], at[:0]).dump()).find(keys[:3])[0].any()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_tokenizer(name):
    from cladeflow.llm.encoding import Encoder

    path, t = _tokenizer(name)
    r = random.Random(6)
    parts = ["a", "The", "don't", "x.", "y,", "..", ",", "né", "é", "日本語", " ", " ", "\n", "\t", "\x01", "\x1c", "<|endoftext|>", "12", "3.5.", " ", "!!", "é.", "A.", "'s", "\u0085", "\r", "Ç,"]
    texts = ["", " ", "\n", *("".join(r.choice(parts) + r.choice(["", " ", " ", "\n"]) for _ in range(r.randrange(1, 14))) for _ in range(3000))]
    code = Encoder(path, "bytes" if name.startswith("byte") else "words")
    for i in range(0, len(texts), 500):
        got = code.encode([x.encode() for x in texts[i : i + 500]])
        for x, g in zip(texts[i : i + 500], got, strict=True):
            assert np.frombuffer(g, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_empty_tables(spark, none, sf, tmp_path):
    path, _ = _tokenizer("byte_bpe_50k.json")
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("false")
    assert dedup.substring_dedup(none).count() == dedup.suffix_array_dedup(none).count() == 0
    assert jaccard.jaccard_join(none).count() == jaccard.near_duplicates_removed(none).count() == 0
    assert quality.quality_rules(none, labels).count() == classifier.classify_quality(none, labels).count() == 0
    assert mixing.mix_sources(none).count() == packing.pack_documents(none, path).count() == 0
    assert lm_score.cross_entropy_difference(none, labels.select("doc_id")).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F_col("vec_id") == 0).count() == 0
    token_files.write_token_files(none, str(tmp_path / "none"), path)
    assert token_files.scan_token_files(spark, str(tmp_path / "none")).count() == 0


def test_forest_by_definition_and_on_held_out_rows(spark):
    """Scores are 2 ** -(mean path / expected path), walked here row by row; fitted on half of the labelled rows, the verdict tells the labels of the other half."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest, cut = quality.fit_forest(docs, labels.filter("doc_id % 2 = 0"))
    held = docs.join(labels.filter("doc_id % 2 = 1"), "doc_id").select("text", "quality").collect()
    shares = quality.statistics([r.text.encode() for r in held])[1]
    depth = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    for row, score in zip(shares[:40], forest.scores(shares[:40]), strict=True):
        x = [math.log1p(max(v - h, lo - v, 0) / s) for v, h, lo, s in zip(row, forest.high, forest.low, forest.scale, strict=True)]
        paths = []
        for t in range(quality.TREES):
            node = 0
            while forest.feature[t, node] >= 0:
                node = 2 * node + (2 if x[forest.feature[t, node]] >= forest.cut[t, node] else 1)
            paths.append(forest.path[t, node])
        assert score == pytest.approx(2 ** -(sum(paths) / len(paths) / depth(quality.TREE_ROWS)))
    kept = [not brute.rules(r.text)[5] and s < cut for r, s in zip(held, forest.scores(shares), strict=True)]
    rate = lambda y: sum(k for k, r in zip(kept, held, strict=True) if r.quality == y) / sum(r.quality == y for r in held)
    assert rate(1) > 0.9 and rate(0) < 0.05


def test_smaller_positions():
    r = random.Random(8)
    for _ in range(50):
        n = r.randrange(1, 40)
        x, common = (np.array([r.randrange(m) for _ in range(n)]) for m in (6, 60))
        near, least = repeats.smaller(x, common)
        want = [next((j for j in range(i - 1, -1, -1) if x[j] < x[i]), -1) for i in range(n)]
        assert near.tolist() == want
        assert least.tolist() == [min(common[j + 1 : i + 1]) if j >= 0 else 0 for i, j in enumerate(want)]


def test_previous_factors_by_definition():
    """Suffix order, shared bytes and factors against their definitions; suffixes end where their text does."""
    r = random.Random(9)
    for longest in [30, 70] * 20:
        texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(3, longest))) for _ in range(5)]
        texts.append(texts[0][2:] + b"a" * 20)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.array([sum(map(len, texts[:d])) + i for d, t in enumerate(texts) for i in range(len(t))], np.int64)
        doc = np.array([d for d, t in enumerate(texts) for i in range(len(t))])
        suffix = [t[i:] for t in texts for i in range(len(t))]
        order, common = repeats.suffix_order(kernels.lanes(flat), begin, np.array([len(x) for x in suffix]))
        assert [suffix[i] for i in order] == sorted(suffix)
        shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common.tolist() == [0 if k == 0 else shared(suffix[order[k]], suffix[order[k - 1]]) for k in range(len(order))]
        factor = repeats.previous_factor(doc[order], common)
        assert factor.tolist() == [max([shared(suffix[i], suffix[j]) for j in range(len(doc)) if doc[j] < doc[i]], default=0) for i in order]


def test_prefix_groups():
    """Every two suffixes with a common window of words are in one group, and groups beyond the bound share a whole window."""
    r = random.Random(11)
    for together in (1, 5, 40):
        word = np.array([r.choice([1, 1, 1, 2, 3]) for _ in range(300)], np.uint64)
        at, w = np.arange(280), 9
        found = list(repeats.prefix_groups(word, at, w, together))
        of = {int(i): k for k, g in enumerate(found) for i in g}
        assert sum(map(len, found)) == len(of)
        same = collections.defaultdict(set)
        for i in at.tolist():
            same[tuple(word[i : i + w])].add(of.get(i, -1 - i))
        assert all(len(s) == 1 for s in same.values())
        assert all(len(g) <= together or len({tuple(word[i : i + w]) for i in g}) == 1 for g in found)


def test_subtrees_by_definition():
    r = random.Random(10)
    head = b"".join(b"word%d " % i for i in range(100))  # longer than a byte can count
    seqs = [(head if r.random() < 0.5 else b"") + b"".join(r.choice([b"a ", b"ab ", b"b "]) for _ in range(r.randrange(1, 9))) for _ in range(60)]
    size = np.array([len(s) for s in seqs])
    tree = repeats.Subtree(b"".join(seqs), np.cumsum(size) - size, size)
    done = [seqs[i].split() for i in tree.order]
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert tree.depth.tolist() == [0, *(shared(a, b) for a, b in zip(done, done[1:], strict=False))]
    rank = np.array([r.randrange(20) for _ in seqs])
    for depth in (1, 2, 4, 103):
        want = [max([n for j in range(60) if rank[j] < rank[i] and (n := shared(seqs[i].split(), seqs[j].split())) >= depth], default=0) for i in range(60)]
        assert tree.earlier(rank, depth).tolist() == want
        node, deep, least, up = tree.nodes(rank, depth)
        assert all(up[k] < 0 or deep[up[k]] < deep[k] and least[up[k]] <= least[k] for k in range(len(deep)))


def test_one_anchor_of_many_different_stretches(spark, small_blocks):
    """Records with one tag give one anchor far more stretches than a byte counts, in several blocks; crowded or not, results are exact."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(d, " ".join(f"TAG {word()} {word()}" for _ in range(150))) for d in range(12)]
    rows += [(20 + d, " ".join(rows[d][1].split()[100:160] + [word()] + rows[d + 1][1].split()[40:90])) for d in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: v[0] for d, v in brute.repeats(rows, "word", 6).items()}
    for crowd in (100, 10**6):
        got = {x.doc_id: (x.n_units, x.n_removed, x.n_spans, x.kept_sha256) for x in dedup.substring_dedup(df, window=6, crowd=crowd).collect()}
        assert got == want
    plan = repeats.Plan("word", 6, 3, 1, 10**6)
    block = blocks.Block(0, [d for d, _ in rows], [blocks.squeeze(t.encode()) for _, t in rows], list(range(len(rows))))
    assert repeats.Runs(block, plan, np.ones(len(rows), bool)).keys["runs"].max() > 255


def test_words_are_ascii_split():
    texts = ["a b c", "\x1cx\ty\r\nz", "", " ", "é"]
    _, first = kernels.word_codes([t.encode() for t in texts])
    assert np.diff(first).tolist() == [len(brute.words(t)) for t in texts]


def test_clashing_names(spark):
    """Columns named as any that the operators make, and ids named id."""
    rows = [(i, f"word{i} and some more words that make a text of ten words or so", "x", 1, "y", "z", 0.5, "w", "v", "u") for i in range(12)] + [(None, None, "x", 1, "y", "z", 0.5, "w", "v", "u")]
    df = spark.createDataFrame(rows, "id long, text string, rules string, _score int, whole string, last string, mix_epoch double, source string, lang string, _text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, 0), (None, 1), (5, None)], "id long, quality int")
    assert quality.quality_rules(df, labels, id_col="id").count() == classifier.classify_quality(df, labels, id_col="id").count() == 13
    assert quality.quality_rules(df, labels, id_col="id", into="r").select("rules").distinct().collect()[0].rules == "x"
    mixed = mixing.mix_sources(df, id_col="id")
    assert mixed.columns == [*[c for c in df.columns if c != "mix_epoch"], "mix_epoch"]
    assert {r["whole"] for r in mixed.collect()} == {"y"}
    assert dedup.substring_dedup(df, id_col="id").count() == jaccard.jaccard_join(df, id_col="id").count() == lm_score.cross_entropy_difference(df, labels.select("id"), id_col="id").count() == 13


def test_read_documents(spark, docs, rows, small_blocks, tmp_path):
    """Keyed reads give what the scan has, and nothing for absent ids."""
    path, t = _tokenizer("word_bpe_49k.json")
    token_files.write_token_files(docs, str(tmp_path / "files"), path)
    asked = [0, 3, 4, 17, 69, 73, -5, 10_000, None, 3]
    got = token_files.read_documents(spark, str(tmp_path / "files"), spark.createDataFrame([(i,) for i in asked], "key long")).collect()
    want = sorted((d, np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, x in rows if d is not None and d in asked)
    assert sorted((r.doc_id, bytes(r.ids)) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)


def test_pivots_eliminate(spark):
    """Where vectors lie in clusters, most candidates need no evaluation."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (20, 8))
    v = [(i, (centres[i % 20] + rng.normal(0, 0.02, 8)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    found = topk.elimination(df, F_col("vec_id") % 400 == 0).collect()
    assert np.mean([r.met for r in found]) < 1000  # whole blocks are ruled out by their ranges of distances
    assert np.mean([r.evaluated for r in found]) < 1000


@pytest.mark.parametrize("spread", [0.02, 5.0])
def test_blocks_are_ruled_out_exactly(spark, monkeypatch, spread):
    """Small blocks of vectors and of queries, one cell with most of both: the best are those of brute force, whatever was left out."""
    monkeypatch.setattr(topk, "BLOCK", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "PIVOTS", 12)
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (9, 6))
    v = [(2 * i, (centres[i % 9 if i % 3 else 0] + rng.normal(0, spread, 6)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    w = np.floor(1024 * np.array([x for _, x in v])).astype(np.int64)
    want = []
    for q in range(0, 1500, 50):
        s = w @ w[q]
        best = [j for j in np.lexsort((np.arange(1500), -s)).tolist() if j != q][:5]
        want += [(2 * q, k + 1, 2 * j, int(s[j])) for k, j in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(df, F_col("vec_id") % 100 == 0, 5).collect())) == sorted(want)
    cells = [topk.Cell(q=n) for n in (3, 0, 9, 1, 4, 2)]
    assert topk.query_blocks(cells, 4) == [(0, 1), (0, 1), (1, 3), (4, 1), (5, 1), (6, 1)]


def test_blocks_follow_lengths(spark, small_blocks):
    """Neighbours of long texts are dealt to more blocks than as many short ones."""
    rows = [(i, "x" * (20 if i < 300 else 1000)) for i in range(330)] + [(330, None), (None, "y" * 50)]
    corpus = blocks.Corpus.deal(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    held = [[blocks.expand(d.z) if d.z is not None else b"" for d in r.docs] for r in corpus.table.collect()]
    assert sum(map(len, held)) == len(rows)
    assert corpus.total == sum(len(x) for b in held for x in b) == 36_050
    assert max(sum(map(len, b)) for b in held) <= 2.5 * blocks.BLOCK_BYTES


def test_long_text_in_pieces(spark):
    """A text of many chunks, whose end stands in another document."""
    tail = " ".join(f"t{i}" for i in range(80))
    text = " ".join(f"w{i}" for i in range(500_000)) + " " + tail
    got = {r.doc_id: r for r in dedup.substring_dedup(spark.createDataFrame([(1, text), (2, tail + " more"), (3, text + " x")], "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 80, 500_080]
    assert got[3].n_units == 500_081


def test_forest_is_fitted_on_every_labelled_row(spark):
    """Ranges and threshold of more than 10 000 rows of a label are those of all of them; trees draw from all, and quantiles have no sample's error."""
    r = np.random.default_rng(5)
    x = np.r_[r.normal(0, 1, (21_000, 10)), r.normal(3, 1, (11_000, 10))]
    x[:, 3], x[:50, 4] = np.floor(x[:, 3]), -0.0
    y = np.r_[np.ones(21_000, int), np.zeros(11_000, int)]
    rows = spark.createDataFrame([*zip(range(32_000), y.tolist(), x.tolist(), strict=True)], "id long, y int, x array<double>").repartition(5).localCheckpoint()
    low, high = quality.quantiles(rows.filter("y = 1"), 21_000, (quality.BAND, 1 - quality.BAND))
    assert np.array_equal([low, high], np.quantile(x[y == 1], [quality.BAND, 1 - quality.BAND], axis=0))
    assert quality.quantiles(rows.filter("id = 7"), 1, (0.1, 0.9)).tolist() == [x[7].tolist()] * 2
    drawn = quality.draws(rows, (21_000, 11_000))
    place = {tuple(v): i for i, v in enumerate(x.tolist())}
    at = np.array([[place[tuple(v)] for v in d.tolist()] for d in drawn])
    assert at.shape == (quality.TREES, quality.TREE_ROWS) and all(len(set(d)) == len(d) for d in at.tolist()) and ((at >= 21_000).sum(1) == 15).all()
    assert len(np.unique(at[:, :241])) > 10_000 and abs(at[:, :241].mean() - 10_500) < 250
    forest = quality.IsolationForest.of(low, high, drawn)
    assert quality.threshold_of_rows(rows, forest.scores, (21_000, 11_000)) == quality.threshold(forest.scores(x), y == 1)


def test_a_forest_sees_all_labelled_documents(spark):
    docs = spark.range(10_400).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c "), F.repeat(F.lit("word "), (F.col("id") % 97).cast("int"))).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    rows = quality.labelled_statistics(docs, labels, "doc_id", "text", "quality")
    assert rows.count() == 10_400
    forest, cut = quality.fit_forest(docs, labels)
    assert cut == np.inf and np.array_equal([forest.low, forest.high], np.quantile(np.array([r.x for r in rows.collect()]), [quality.BAND, 1 - quality.BAND], axis=0))
