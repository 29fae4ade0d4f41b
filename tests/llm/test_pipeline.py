"""Each stage of the pipeline against plain Python, on what the stage before it kept."""

from __future__ import annotations

import collections
import os
import sys

import numpy as np
import pytest
from conftest import oracle

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from cladeflow.llm import mixing, quality, queries  # noqa: E402


@pytest.fixture(scope="module")
def kept(spark, sf, tmp_path_factory):
    """The rows of documents and of every stage."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns
        made.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
    return out


def test_quality_stage(spark, sf, kept):
    forest, cut = quality.fit_forest(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    want = [r for r in kept[0] if not brute.rules(r.text)[5] and forest.scores(quality.statistics([r.text.encode()])[1])[0] < cut]
    assert sorted(kept[1]) == sorted(want)


def test_near_duplicate_stage(kept):
    comp = brute.linked([(r.doc_id, r.text) for r in kept[1]], 5, 80)
    assert sorted(kept[2]) == sorted(r for r in kept[1] if comp[r.doc_id] == r.doc_id)


def test_substring_stage(kept):
    first: dict = {}
    for r in kept[2]:
        w = r.text.encode().split()
        for i in range(len(w) - 49):
            first[tuple(w[i : i + 50])] = min(first.get(tuple(w[i : i + 50]), r.doc_id), r.doc_id)
    after = {r.doc_id: r for r in kept[3]}
    assert len(after) == len(kept[2])
    for r in kept[2]:
        w = r.text.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < r.doc_id:
                gone[i : i + 50] = [True] * 50
        left = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode() if any(gone) else r.text
        got = after[r.doc_id]
        assert (got.text, got.lang, got.source, got.n_chars) == (left, r.lang, r.source, len(left) if any(gone) else r.n_chars)


def test_mixing_stage(spark, kept, tmp_path):
    spark.createDataFrame(kept[3]).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    os.rename(tmp_path / "documents.parquet", tmp_path / "d")
    (part,) = (x for x in os.listdir(tmp_path / "d") if x.startswith("part-"))
    os.rename(tmp_path / "d" / part, tmp_path / "documents.parquet")
    os.rename(tmp_path / "d", f"{tmp_path}-d")
    want = oracle(mixing.SQL, str(tmp_path)).groupby("doc_id").size().to_dict()
    assert collections.Counter(r.doc_id for r in kept[4]) == want
    assert set(kept[4]) <= set(kept[3])


def test_packing_stage(kept):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept[4])
    assert sum(r.length for r in kept[5]) == n
    whole = collections.defaultdict(list)
    for r in kept[5]:
        whole[r.sequence_id].append((r.offset, r.length, r.tier))
    for pieces in whole.values():
        assert [p[0] for p in sorted(pieces)] == np.r_[0, np.cumsum([p[1] for p in sorted(pieces)])[:-1]].tolist()
        assert sum(p[1] for p in pieces) == pieces[0][2]


def test_run_and_queries(spark, sf, kept):
    assert corpus_pipeline.run(spark, sf).agg({"length": "sum"}).head()[0] == sum(r.length for r in kept[5])
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules"
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES if q.startswith("op")) == list(range(1, 14))


ODD = "doc_id long, text string, lang string, source string, n_chars long, rules string, kept int, rest string, pid int, mix_epoch int, id long, z string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows and ids, empty texts, and columns with names that stages use themselves."""
    word = lambda i, k: " ".join(f"w{(i * 7 + j * j) % (50 + k)}x{j}" for j in range(120))
    rows = [(1, word(1, 0), "en", "s1"), (2, word(2, 1), None, "s2"), (3, word(3, 2), "de", None), (None, word(1, 0), "en", "s1"), (None, None, None, None), (4, None, "en", "s1"), (5, "", "en", "s2"), (5, " \n", "en", "s2"),
            (6, word(1, 0) + " tail", "en", "s1"), (7, word(2, 1), "en", "s1"), (7, word(4, 4), "en", "s1"), (8, word(5, 3) + " " + word(3, 2)[:600], None, None), (2, word(2, 1), None, "s2")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "r", i, None, 3, 9, i, "z") for i, r in enumerate(rows)], ODD).repartition(3)


def test_stages_on_odd_rows(spark, sf, odd):
    """Each stage keeps the columns as they are and treats nulls, repeats and empty texts as its docstring says; empty tables stay empty."""
    mark = lambda df: sorted(r["kept"] for r in df.collect())
    rows = {r["kept"]: r for r in odd.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, odd, sf)
        assert made.columns == odd.columns and [f.dataType for f in made.schema.fields] == [f.dataType for f in odd.schema.fields]
        assert stage(spark, odd.limit(0), sf).count() == 0
    fails = {k for k, r in rows.items() if not (r.text or "").strip()}
    assert not fails & set(mark(corpus_pipeline.keep_quality(spark, odd, sf)))
    near = mark(corpus_pipeline.drop_near_duplicates(spark, odd, sf))
    assert {3, 4, 5} <= set(near)  # no id, or no text: like no other
    assert 8 not in near and sum(k in near for k in (1, 12)) == 1 and not {9, 10} & set(near)  # 7 is a copy of 2, whichever of its rows is
    cut = {r["kept"]: r for r in corpus_pipeline.cut_repeats(spark, odd, sf).collect()}
    assert set(cut) == set(rows)
    for k in (0, 1, 2, 3, 4, 5, 6, 7, 12):
        assert cut[k] == rows[k]
    assert (cut[8].text, cut[8].n_chars) == ("tail", 4) and cut[9].text == ""
    mixed = corpus_pipeline.mix(spark, odd, sf).collect()
    assert {r["kept"] for r in mixed} <= set(rows) and all(rows[r["kept"]] == r for r in mixed)
    pieces = corpus_pipeline.pack(spark, odd, sf).collect()
    assert sum(r.length for r in pieces if r.doc_id == 4) == 1 and sum(r.length for r in pieces if r.doc_id == 5) > 1
    assert corpus_pipeline.pack(spark, odd.limit(0), sf).count() == 0
