"""Scalar functions, scoring, verbs, stages, tools and streaming on small frames."""

from __future__ import annotations

import math
import os
import stat

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cladeflow import schemas
from cladeflow.functions import columns as X
from cladeflow.operators import verbs
from cladeflow.plans import catalog, classify, scoring, stages, tools
from cladeflow.sources import fasta
from cladeflow.streaming import predict


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def test_ieee_division(spark):
    lit = F.lit
    assert one(spark, X.ieee_div(lit(1.0), lit(0.0))) == math.inf
    assert one(spark, X.ieee_div(lit(-1), lit(0))) == -math.inf
    assert math.isnan(one(spark, X.ieee_div(lit(0.0), lit(0.0))))
    assert math.isnan(one(spark, X.ieee_div(lit(float("nan")), lit(0.0))))
    assert one(spark, X.ieee_div(lit(3), lit(2))) == 1.5
    assert one(spark, X.ieee_div(lit(None).cast("double"), lit(0.0))) is None
    assert one(spark, X.ieee_div(lit(1.0), lit(0.0), null_on_zero=True)) is None


def test_names_and_residues(spark):
    assert one(spark, X.virus_name(F.lit("contig_1_23"))) == "contig_1"
    assert one(spark, X.virus_name(F.lit("none"))) is None
    with pytest.raises(Exception, match="no virus name"):
        one(spark, X.virus_name(F.lit("none"), strict=True))
    with pytest.raises(ValueError, match="syntax"):
        X.virus_name(F.lit("x"), "(?P<a>x)")
    assert one(spark, X.strip_name_comments(F.lit(" \tp_1  # 1 # 2"))) == "p_1"
    assert one(spark, X.known_residues(F.lit("MKXx*AB-1é"))) == 6
    assert [one(spark, X.category_weight(F.lit(c))) for c in (1, 5, 3)] == [1.0, 0.0, 0.5]


def hits(spark, rows):
    return spark.createDataFrame(rows, "target_name string, query_name string, sequence_e_value double, sequence_score double, pos int")


def test_aggregate_hits_quirks(spark):
    h = hits(spark, [("v_1", "a", 1e-3, 10.0, 1), ("v_1", "b", 1e-9, 10.0, 2), ("v_1", "c", 2e-3, 99.0, 3), ("v_2", "a", 0.0, 5.0, 4), ("v_3", "a", 0.0, 5.0, 5), ("v_4", "a", 0.0, float("nan"), 6), ("w_1", "a", float("nan"), 1.0, 7)])
    p = spark.createDataFrame([("v_1", 2.0), ("v_2", 0.0), ("v_4", 1.0)], "protein_name string, k_base_size double")
    got = {(r[0], r[1]): r[2] for r in scoring.aggregate_hits(h, p, ["pos"]).collect()}
    assert got == {("v", "a"): math.inf}  # the first in order wins the tie; size 0 is infinite; v_3 has no size
    assert {(r[0], r[1]): r[2] for r in scoring.aggregate_hits(h.filter("target_name = 'v_1'"), p, ["pos"]).collect()} == {("v", "a"): 5.0}


def test_predictions(spark):
    a = spark.createDataFrame([("v", "m1", 10.0), ("v", "m2", 30.0), ("z", "m3", 1.0), ("u", "none", 1.0)], "virus_name string, model_name string, protein_hit_score double")
    c = spark.createDataFrame([("m1", "A", 100.0, 1), ("m2", "A", 50.0, 3), ("m2", "B", 50.0, 1), ("m3", "C", 100.0, 5)], "model_name string, class_name string, class_percent double, class_cat int")
    s = spark.createDataFrame([(40.0,), (10.0,), (32.5,), (32.5,)], "virus_hit_score double")
    got = {(r.virus_name, r.class_name): r for r in scoring.predict_membership(a, c, s).collect()}
    assert set(got) == {("v", "A"), ("v", "B"), ("z", "C")}
    assert got["v", "A"].membership_ratio == pytest.approx(17.5 / 32.5)
    assert (got["v", "A"].virus_hit_score, got["v", "A"].confidence_score, got["v", "A"].rank_in_virus) == (32.5, 0.5, 1)
    assert math.isnan(got["z", "C"].membership_ratio)
    none = scoring.predict_membership(a, c, s.filter("false")).collect()
    assert all(math.isnan(r.confidence_score) for r in none)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 12), min_size=1, max_size=60), st.lists(st.integers(-2, 14), min_size=1, max_size=20))
def test_percentile_rank_property(spark, samples, scores):
    s = spark.createDataFrame([(float(x),) for x in samples], "virus_hit_score double")
    got = sorted((r.score, r.confidence_score) for r in scoring.percentile_rank(spark.createDataFrame([(float(x),) for x in scores], "score double"), s, "score").collect())
    v = np.sort(samples)
    want = sorted((float(x), (np.searchsorted(v, x, "left") + 0.5 * (np.searchsorted(v, x, "right") - np.searchsorted(v, x, "left"))) / len(v)) for x in scores)
    assert np.allclose(got, want)
    assert all(0 <= c <= 1 for _, c in got)


def test_classes_nest_and_unnest(spark):
    c = spark.createDataFrame([("m1", "A", 40.0, 1, 1), ("m2", "A", 30.0, 1, 2), ("m2", "B", 70.0, 2, 3), ("m2", "B", 60.0, 4, 4)], "model_name string, class_name string, class_percent double, class_cat int, pos int")
    got = sorted(map(tuple, verbs.unnest_classes(verbs.nest_classes(c, ["pos"])).collect()))
    assert got == [("m1", "A", 100.0, 1), ("m2", "A", 30.0, 1), ("m2", "B", 60.0, 4)]


def test_verbs(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (2, "b", 1.0), (3, "a", 3.0)], "k int, g string, x double")
    assert verbs.mutate(df, y=F.col("x") + 1).columns == ["y", "k", "g", "x"]
    assert verbs.replace_columns(df, ["k", "g"], {"kg": F.concat("k", "g")}).columns == ["kg", "x"]
    assert verbs.subset_front(df, ["x"], lambda d: {"z": d["x"]}).columns == ["z", "k", "g"]
    assert [c.columns for c in verbs.split_columns(df, ["g"])] == [["g"], ["k", "x"]]
    assert [r.k for r in verbs.arrange(df, [F.desc("x")], ["k"]).collect()] == [1, 3, 2]
    assert [r.k for r in verbs.top(df, [F.desc("x")], 2, ["k"]).collect()] == [1, 3]
    assert sorted(r.k for r in verbs.top_n_per_group(df, ["g"], [F.desc("x")], 1, ["k"]).collect()) == [1, 2]
    assert verbs.inner_join(df, df.select("k", F.col("g").alias("h")), ["k"]).columns == ["k", "h", "g", "x"]
    assert sorted(tuple(r) for r in verbs.number_rows(df, ["x", "k"], "n").select("k", "n").collect()) == [(1, 1), (2, 0), (3, 2)]
    assert verbs.unnest(spark.createDataFrame([(1, []), (2, [5, 6])], "a int, b array<int>"), "b").collect() == [(2, 5), (2, 6)]
    assert verbs.drop_nothings(spark.createDataFrame([(1, None), (2, 3)], "a int, b int"), "b").count() == 1
    assert verbs.set_index(df, ["g"]).columns == ["g", "k", "x"]
    for bad in (lambda: verbs.top(df, [], -1, ["k"]), lambda: verbs.replace(df, "none", F.lit(1)), lambda: verbs.reorder(df, ["k"])):
        with pytest.raises(ValueError):
            bad()


def test_content_key_and_stages(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, g string")
    assert stages.content_key(df) == stages.content_key(df.orderBy(F.desc("k")).repartition(3))
    assert stages.content_key(df) != stages.content_key(df.union(df))
    built = []
    build = lambda: built.append(1) or df
    for _ in range(2):
        assert stages.stage(spark, str(tmp_path), "key", "hits", build).count() == 2
    assert len(built) == 1
    os.remove(tmp_path / "key/hits/_SUCCESS")  # as a run that broke off leaves it
    assert stages.stage(spark, str(tmp_path), "key", "hits", build).count() == 2
    assert len(built) == 2
    assert stages.remaining(df.withColumnRenamed("g", "chunk_key"), spark.createDataFrame([("a",)], "chunk_key string")).count() == 1
    with stages.work_directory(spark, str(tmp_path / "w")) as w:
        assert sorted(os.listdir(w)) == sorted(stages.STAGES)
    with stages.work_directory(spark) as w:
        pass
    assert not os.path.exists(w.removeprefix("file:"))


def script(folder, name: str, body: str) -> str:
    path = folder / name
    path.write_text("#!/bin/sh\n" + body)
    path.chmod(path.stat().st_mode | stat.S_IXUSR)
    return str(path)


def test_tools(spark, tmp_path):
    with pytest.raises(tools.ToolError, match="not found"):
        tools.find_tool("no-such-tool")
    seqs = spark.createDataFrame([("f", f"s{i}", ["AC"]) for i in range(5)], "file string, name string, seq_lines array<string>")
    chunks = tools.chunk_sequences(seqs, 2, ["name"])
    assert {r["chunk_id"]: r["n"] for r in tools.chunk_keys(chunks, ["chunk_id"], ["name"]).collect()} == {0: 2, 1: 2, 2: 1}
    fail = script(tmp_path, "fail", "echo broken >&2; exit 3\n")
    with pytest.raises(Exception, match="exit code 3.*broken"):
        tools.pipe_tool(chunks, lambda s, o: [fail, s, o], tools.parse_fasta, "name string, seq_lines array<string>").collect()
    assert tools.run_tool(lambda s, o: ["/nonexistent"], "") == [""]  # nothing to do, nothing run


def test_chunk_files(spark, tmp_path):
    seqs = spark.createDataFrame([(f, f"s{i}", ["AC", "GT"]) for f in "fg" for i in range(3)], "file string, name string, seq_lines array<string>")
    named = tools.write_chunk_files(tools.chunk_sequences(seqs, 2, ["name"]), str(tmp_path / "chunks")).collect()
    assert len(named) == 4
    assert len({r.chunk_key for r in named}) == 2  # both files hold the same chunks
    for key, n in {(r.chunk_key, r.n) for r in named}:
        assert fasta.read_fasta(spark, str(tmp_path / "chunks" / f"chunk_key={key}")).count() == n


def test_gene_options(spark, tmp_path):
    """Options reach the tool; the GenBank text comes beside the proteins."""
    tool = script(tmp_path, "genes", 'while [ $# -gt 0 ]; do case $1 in -a) aa=$2; shift;; -o) gbk=$2; shift;; -p) p=$2; shift;; -m) m=masked;; esac; shift; done\necho ">p_1 $p $m" > $aa; echo MA >> $aa; [ -z "$gbk" ] || echo "LOCUS $p" > $gbk\n')
    chunks = spark.createDataFrame([(0, "g", ["AC"])], "chunk_id long, name string, seq_lines array<string>")
    plain = tools.predict_genes(chunks, executable=tool).collect()
    assert [(r.name, r.seq_lines) for r in plain] == [("p_1 meta ", ["MA"])]
    rows = tools.predict_genes(chunks, executable=tool, procedure="single", mask=True, genbank=True).collect()
    assert sorted((r.name or "", r.genbank or "") for r in rows) == [("", "LOCUS single\n"), ("p_1 single masked", "")]
    for bad in (" a - b", "a - b c"):
        with pytest.raises(tools.ToolError, match="hit table"):
            tools.parse_tblout(bad)


def test_null_scores_do_not_win(spark):
    from cladeflow.plans import scoring

    rows = [("v", "t", "a", None), ("v", "t", "b", 2.0), ("v", "t", "c", float("nan")), ("v", "u", "a", None)]
    df = spark.createDataFrame(rows, "virus_name string, target_name string, query_name string, sequence_score double")
    assert [(r.target_name, r.query_name) for r in scoring.best_hits(df, ["query_name"]).collect()] == [("t", "b")]
    best = verbs.best_per_group(df.filter("sequence_score is null or sequence_score = 2"), ["target_name"], "sequence_score", ["query_name"])
    assert sorted((r.target_name, r.query_name) for r in best.collect()) == [("t", "b"), ("u", "a")]


def test_whole_classification(spark, tmp_path):
    """Genomes to predictions with stand-ins for both tools, run twice over one work directory."""
    # Gene prediction: every sequence becomes one protein, its name with _1.
    prodigal = script(tmp_path, "prodigal", 'while [ $# -gt 0 ]; do case "$1" in -i) in=$2;; -a) out=$2;; esac; shift; done\nsed "/^>/s/$/_1 # 1 # 9/" "$in" > "$out"\n')
    # Search: every protein hits the model that the model file names.
    hmmsearch = script(tmp_path, "hmmsearch", 'while [ $# -gt 2 ]; do [ "$1" = --tblout ] && out=$2; shift; done\nm=$(cat "$1"); echo "# head" > "$out"\ngrep "^>" "$2" | sed "s/^>\\([^ ]*\\).*/\\1 - $m - 1e-9 8.0 0 1e-9 8.0 0 1.0 1 1 1 1 1 1 1 -/" >> "$out"\n')
    (tmp_path / "g.fasta").write_text(">v1\nACGT\n>v2\nACGTACGT\n")
    (tmp_path / "models").write_text("m1")
    (tmp_path / "c.tsv").write_text("a\tb\tc\td\nm1\tA\t100\t1\n")
    (tmp_path / "s.tsv").write_text("1000\n1500\n3000\n")
    (tmp_path / "i.yaml").write_text("classificationFiles:\n  family:\n    modelClassesFile: c.tsv\n    scoreSamplesFile: s.tsv\nvpfsFile: models\n")
    run = lambda tool: {r.virus_name: r for r in classify.classify(spark, str(tmp_path / "g.fasta"), str(tmp_path / "i.yaml"), str(tmp_path / "work"), prodigal=tool, hmmsearch=hmmsearch).collect()}
    got = run(prodigal)
    assert {v: (r.class_key, r.class_name, r.membership_ratio, r.virus_hit_score) for v, r in got.items()} == {"v1": ("family", "A", 1.0, 2000.0), "v2": ("family", "A", 1.0, 1000.0)}
    assert got["v1"].confidence_score == pytest.approx(2 / 3)
    assert got["v2"].confidence_score == pytest.approx(0.5 / 3)


@pytest.fixture
def lab(spark, tmp_path):
    """Genomes, an index and stand-ins for both tools, which note what they ran."""

    class Lab:
        folder = tmp_path
        genes = script(tmp_path, "prodigal", f'echo g >> {tmp_path}/ran; while [ $# -gt 0 ]; do case "$1" in -i) in=$2;; -a) out=$2;; esac; shift; done\nif grep -q bad "$in"; then echo no genes >&2; exit 4; fi\nsed "/^>/s/$/_1 # 1 # 9/" "$in" > "$out"\n')
        search = script(tmp_path, "hmmsearch", f'echo s >> {tmp_path}/ran; while [ $# -gt 2 ]; do [ "$1" = --tblout ] && out=$2; shift; done\nm=$(cat "$1"); grep "^>" "$2" | sed "s/^>\\([^ ]*\\).*/\\1 - $m - 1e-9 8.0 0 1e-9 8.0 0 1.0 1 1 1 1 1 1 1 -/" > "$out"\n')

        def put(self, name: str, text: str) -> None:
            (tmp_path / name).write_text(text)

        def ran(self) -> tuple[int, int]:
            """How often each tool ran since the last call."""
            lines = (tmp_path / "ran").read_text().split() if (tmp_path / "ran").exists() else []
            (tmp_path / "ran").write_text("")
            return lines.count("g"), lines.count("s")

        def run(self, **more) -> dict:
            more = {"prodigal": self.genes, "hmmsearch": self.search, **more}
            found = classify.classify(spark, str(tmp_path / "g.fasta"), str(tmp_path / "i.yaml"), str(tmp_path / "work"), **more)
            return {r.virus_name: (r.class_name, r.virus_hit_score, r.confidence_score) for r in found.collect()}

    made = Lab()
    made.put("g.fasta", ">v1\nACGT\n>v2\nACGTACGT\n")
    made.put("models", "m1")
    made.put("c.tsv", "a\tb\tc\td\nm1\tA\t100\t1\nm2\tB\t100\t1\n")
    made.put("s.tsv", "1000\n1500\n")
    made.put("i.yaml", "classificationFiles:\n  family:\n    modelClassesFile: c.tsv\n    scoreSamplesFile: s.tsv\nvpfsFile: models\n")
    return made


def test_each_input_of_a_classification_counts(lab):
    """After a change of any input the answer is that of the new input; what the change doesn't touch isn't run again."""
    first = lab.run()
    assert first == {"v1": ("A", 2000.0, 1.0), "v2": ("A", 1000.0, 0.25)} and lab.ran() == (2, 2)
    assert lab.run() == first and lab.ran() == (0, 0)
    assert lab.run(threshold=1e-30) == {} and lab.ran() == (0, 0)  # no hit qualifies
    lab.put("c.tsv", "a\tb\tc\td\nm1\tOTHER\t100\t1\n")
    assert {v[0] for v in lab.run().values()} == {"OTHER"} and lab.ran() == (0, 0)
    lab.put("s.tsv", "3000\n1500\n")
    assert lab.run()["v1"] == ("OTHER", 2000.0, 0.5) and lab.ran() == (0, 0)
    lab.put("c.tsv", "a\tb\tc\td\nm1\tA\t100\t1\nm2\tB\t100\t1\n")
    lab.put("models", "m2")
    assert {v[0] for v in lab.run().values()} == {"B"} and lab.ran() == (0, 2)  # searched again with other models
    lab.put("models", "m1")
    lab.put("s.tsv", "1000\n1500\n")
    assert lab.run() == first and lab.ran() == (0, 0)  # as at first, and still there
    assert lab.run(procedure="single") == first and lab.ran() == (2, 2)
    with pytest.raises(Exception, match="no virus name"):
        lab.run(pattern="w.*")
    lab.put("g.fasta", ">v1\nACGT\n>v2\nACGTACGT\n>v3\nAC\n")
    assert set(lab.run()) == {"v1", "v2", "v3"} and lab.ran() == (1, 1)  # one chunk is new
    lab.put("g.fasta", ">v1\nACGT\n>v1\nACGG\n")
    with pytest.raises(classify.DuplicateProteins, match="v1_1"):
        lab.run()
    with pytest.raises(tools.ToolError, match="not found"):
        lab.run(prodigal="no-such-tool")


def test_a_tool_that_fails_costs_its_chunk_alone(lab):
    lab.put("g.fasta", "".join(f">{'bad' if i == 7 else f'v{i}'}\n{'ACGT' * (i + 1)}\n" for i in range(10)))
    with pytest.raises(stages.ChunkError, match="exit code 4: no genes"):
        lab.run()
    assert lab.ran() == (10, 0)
    lab.genes = lab.genes  # the same tool again: only what isn't done is run
    with pytest.raises(stages.ChunkError):
        lab.run()
    assert lab.ran() == (1, 0)
    lab.put("g.fasta", "".join(f">{'good' if i == 7 else f'v{i}'}\n{'ACGT' * (i + 1)}\n" for i in range(10)))
    assert len(lab.run()) == 10 and lab.ran() == (1, 10)


def test_ledger(spark, tmp_path):
    chunks = spark.createDataFrame([(f"k{i % 9}", i) for i in range(30)], "chunk_key string, x long")
    calls, data = [], schemas._table(x="l")

    def work(fail):
        def of(some):
            calls.append(some.select("chunk_key").distinct().count())
            failed = F.col("chunk_key").isin(fail)
            rows = some.filter(~failed).select("chunk_key", "x", F.lit(None).cast("string").alias("note"), F.lit("row").alias("kind"))
            ends = some.select("chunk_key").distinct().select("chunk_key", F.lit(None).cast("long").alias("x"), F.when(failed, "why").alias("note"), F.when(failed, "failed").otherwise("done").alias("kind"))
            return rows.union(ends)

        return of

    ledger = stages.Ledger(spark, str(tmp_path / "l"), data)
    assert ledger.rows().count() == 0
    with pytest.raises(stages.ChunkError, match="k3: why; k5: why"):
        ledger.run(chunks, work(["k3", "k5"]), each=4)
    assert sum(calls) == 9 and len(calls) == 3
    calls.clear()
    os.makedirs(tmp_path / "l/wave=broken/kind=row")  # of a wave that broke off
    got = ledger.run(chunks, work([]), each=4)
    assert calls == [2] and sorted(r.x for r in got.collect()) == list(range(30))
    assert sorted(r.x for r in ledger.run(chunks.filter("chunk_key = 'k1'"), work([])).collect()) == [1, 10, 19, 28]


def test_manifests(spark, tmp_path):
    build = lambda x: lambda: spark.range(x)
    at = lambda x, n: stages.stage(spark, str(tmp_path), "key", "s", build(n), {"x": x, "more": [1, None]}).count()
    assert (at(1, 3), at(2, 5), at(1, 9)) == (3, 5, 3)
    (path,) = [p for p in (tmp_path / "key/s").iterdir() if p.name == stages.digest({"x": 1, "more": [1, None]})]
    (path / stages.MANIFEST).unlink()  # as a run that broke off before it
    assert at(1, 9) == 9
    (path / stages.MANIFEST).write_text("{")
    (path / f".{stages.MANIFEST}.crc").unlink(missing_ok=True)
    with pytest.raises(stages.StageError, match=f"{stages.MANIFEST}.*delete"):
        at(1, 9)
    (path / stages.MANIFEST).write_text('{"x": 7}')
    with pytest.raises(stages.StageError, match="isn't the manifest"):
        at(1, 9)


def test_content_keys(spark, monkeypatch):
    """A key follows the rows and nothing else; sums of hashes that agree don't make keys agree."""
    rows = [(i % 40, f"t{i % 7}", None if i % 5 else float(i)) for i in range(300)]
    schema = "a long, b string, c double"
    for leaf in (4096, 3):
        monkeypatch.setattr(stages, "LEAF", leaf)
        key = stages.content_key(spark.createDataFrame(rows, schema))
        assert key == stages.content_key(spark.createDataFrame(rows[::-1], schema).repartition(7))
        others = [rows[:-1], [*rows, rows[0]], [(0, None, None), *rows[1:]], [(0, "", 0.0), *rows[1:]], [*rows[:-1], rows[0]]]
        assert len({key, *(stages.content_key(spark.createDataFrame(r, schema)) for r in others)}) == len(others) + 1
    assert stages.content_key(spark.createDataFrame([], schema)).startswith("0-")
    # Two hashes swap their parts: all sums over rows of a hash for each column agree, contents don't.
    a, b = [("x", "1"), ("y", "2")], [("x", "2"), ("y", "1")]
    assert stages.content_key(spark.createDataFrame(a, "k string, v string")) != stages.content_key(spark.createDataFrame(b, "k string, v string"))
    assert stages.content_key(spark.createDataFrame([("a", "b\x1fc")], "k string, v string")) != stages.content_key(spark.createDataFrame([("a\x1fb", "c")], "k string, v string"))


def test_index_moves_nothing(spark, tmp_path):
    """An opened index is joined, grouped and ranked by its key without an exchange."""
    left = spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").alias("x"))
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    stages.write_index(left, str(tmp_path / "l"), ["k"], 4)
    stages.write_index(right, str(tmp_path / "r"), ["k"], 4)
    opened = stages.open_index(spark, str(tmp_path / "l"))
    joined = opened.hint("merge").join(stages.open_index(spark, str(tmp_path / "r")), "k")
    ranked = verbs.top_n_per_group(joined, ["k"], [F.desc("x")], 2, ["y"])
    summed = verbs.summarizing(joined, ["k"], n=F.count("*"), s=F.sum("y"))
    for df, n in ((joined, 1000), (ranked, 100), (summed, 50)):
        assert df.count() == n
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert {r.k: (r.n, r.s) for r in summed.collect()} == {k: (20, 40 * k) for k in range(50)}
    (tmp_path / "l/_index.json").write_text("{}")
    (tmp_path / "l/._index.json.crc").unlink(missing_ok=True)
    with pytest.raises(stages.StageError):
        stages.open_index(spark, str(tmp_path / "l"))


def test_totals_of_a_hot_key(spark):
    """A key with most of the rows is dealt over many tasks; a null key is a key."""
    rows = [("hot" if i % 10 else (None if i % 20 else f"k{i % 700}"), i) for i in range(8000)]
    df = spark.createDataFrame(rows, "_key0 string, _total long").repartition(8)
    want = {}
    for k, x in rows:
        want[k] = want.get(k, 0) + x
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few in (10**6, 3):
            got = verbs.group_total(df, ["_key0"], "_total", "t", few)
            assert got.columns == ["_key0", "_total", "t"]
            tasks = got.withColumn("task", F.spark_partition_id()).collect()
            assert sorted((r._total, r.t) for r in tasks) == sorted((x, want[k]) for k, x in rows)
        sizes = sorted((sum(r.task == t for r in tasks) for t in range(16)), reverse=True)
        assert sizes[0] < 3 * np.median(sizes) and sizes[0] < 1500
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("small", [scoring.SMALL_SAMPLES, 0])
def test_ranks_of_levels(spark, small):
    """Both ways of ranking, with keys of clashing names, null keys, nulls, NaN, ties and levels without samples."""
    nan = float("nan")
    samples = [("a", 1, x) for x in (3.0, 1.0, 1.0, nan, None, 7.0)] + [(None, 1, x) for x in (2.0, 5.0)] + [("b", None, 4.0)]
    scores = [("a", 1, x) for x in (0.0, 1.0, 2.0, 7.0, 9.0, nan, None)] + [(None, 1, 2.0), ("b", None, 4.0), ("c", 1, 1.0), ("a", 1, 1.0)]
    s = spark.createDataFrame(samples, "x string, range int, virus_hit_score double")
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(scores)], "x string, range int, score double, before int")
    got = {r.before: r.confidence_score for r in scoring.percentile_rank(df, s, "score", ["x", "range"], small=small).collect()}
    want = [0.0, 0.2, 0.4, 0.7, 0.8, 0.9, None, 0.25, 0.5, nan, 0.2]
    assert len(got) == len(want)
    for i, w in enumerate(want):
        assert got[i] is None if w is None else (math.isnan(got[i]) if math.isnan(w) else got[i] == pytest.approx(w)), (i, got[i], w)


def test_small_samples_are_searched(spark):
    """No join and no range sort where samples are few."""
    df = spark.range(100).select(F.col("id").cast("double").alias("score"))
    ranked = scoring.percentile_rank(df, df.withColumnRenamed("score", "virus_hit_score"), "score")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert ranked.filter("score = 10").head()["confidence_score"] == pytest.approx(0.105)


def test_columns_keep_their_names(spark):
    """Helper columns take no name that the rows have."""
    df = spark.createDataFrame([(1, "a", 3.0, 7), (2, "b", 1.0, 8), (3, "a", 3.0, 9)], "_at int, pos string, _range double, _n int")
    assert verbs.top_n_per_group(df, ["pos"], [F.desc("_range")], 1, ["_at"]).columns == df.columns
    assert sorted(map(tuple, verbs.best_per_group(df.withColumnRenamed("_n", "_best"), ["pos"], "_range", ["_at"]).collect())) == [("a", 1, 3.0, 7), ("b", 2, 1.0, 8)]
    taken = verbs.take_rows(df, spark.createDataFrame([(0, 1), (1, 1)], "out_pos long, pos long"), ["_at"])
    assert taken.columns == ["out_pos", *df.columns] and sorted(map(tuple, taken.collect())) == [(0, 2, "b", 1.0, 8), (1, 2, "b", 1.0, 8)]
    chunks = tools.chunk_sequences(df, 2, ["_at"], ["pos"])
    assert chunks.columns == [*df.columns, "chunk_id"] and {(r._at, r._range) for r in chunks.collect()} == {(1, 3.0), (2, 1.0), (3, 3.0)}
    with pytest.raises(ValueError, match="chunk_id"):
        tools.chunk_sequences(chunks, 2, ["_at"], ["pos"])


def test_table_functions(spark):
    spark.createDataFrame([("b", 2, None), ("a", 1, 5), ("b", 1, 4), ("a", 3, 6)], "k string, o int, x int").createOrReplaceTempView("rows_of_k")
    verbs.table_function(spark, "numbered_rows", lambda g: g.assign(n=range(len(g)), all=len(g)), ["k", "x"], "k string, n long, x int, all int")
    got = spark.sql("SELECT * FROM numbered_rows(TABLE(rows_of_k) PARTITION BY k ORDER BY o DESC) ORDER BY k, n").collect()
    assert list(map(tuple, got)) == [("a", 0, 6, 2), ("a", 1, 5, 2), ("b", 0, None, 2), ("b", 1, 4, 2)]


@pytest.mark.parametrize("at_once", [None, 1])
def test_stream(spark, tmp_path, at_once):
    """Each file is predicted by itself, whether it comes alone or with others, and counts once when its batch is run again."""
    c = spark.createDataFrame([("m1", "A", 100.0, 1)], "model_name string, class_name string, class_percent double, class_cat int")
    s = spark.createDataFrame([(1.0,)], "virus_hit_score double")
    (tmp_path / "in").mkdir()
    start = lambda state: predict.stream_predictions(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / state), c, s, files_at_once=at_once).awaitTermination()
    put = lambda name, score: (tmp_path / "in" / name).write_text(f"virus_name\tmodel_name\tprotein_hit_score\nv\tm1\t{score}\n")
    put("a.tsv", 2.0)
    put("b.tsv", 0.5)
    (tmp_path / "in/empty.tsv").write_text("virus_name\tmodel_name\tprotein_hit_score\n")
    start("state")
    put("c.tsv", 1.0)
    start("state")
    rows = lambda: sorted((r.file[-5:], r.virus_name, r.virus_hit_score, r.confidence_score) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = [("a.tsv", "v", 2.0, 1.0), ("b.tsv", "v", 0.5, 0.0), ("c.tsv", "v", 1.0, 0.5)]
    assert rows() == want
    start("another state")  # all files once more, in other batches
    assert rows() == want


def test_a_file_is_numbered_by_many_tasks(spark):
    """One file with most of the sequences doesn't go to one task; chunks are those of its order."""
    rows = [("hot" if i % 10 else None, f"n{i:05d}", i) for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = tools.chunk_sequences(spark.createDataFrame(rows, "file string, name string, x int"), 7, ["name"]).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {}
    for file in ("hot", None):
        for at, name in enumerate(sorted(n for f, n, _ in rows if f == file)):
            want[name] = at // 7
    assert {r["name"]: r["chunk_id"] for r in got} == want
    assert len(got) == len(rows)
    assert len({r["task"] for r in got if r["file"] == "hot"}) > 1


def test_a_product_grows_with_the_input(spark, sf):
    found = catalog.QUERIES["product_join_suppliers"](spark, sf)
    assert found.count() == 5 * spark.read.parquet(f"{sf}/supplier.parquet").count()
    assert "broadcast" in found._jdf.queryExecution().optimizedPlan().toString()
