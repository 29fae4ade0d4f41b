"""File formats, with the edges that each must hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cladeflow import schemas
from cladeflow.plans import scoring
from cladeflow.sources import fasta, sinks, tables


def put(folder, name: str, text: str) -> str:
    (folder / name).write_bytes(text.encode())
    return str(folder / name)


def test_fasta_entries(spark, tmp_path):
    path = put(tmp_path, "a.fasta", "\n\n>one # a comment\nMKX\n\nx*A\n>>two\nAB\r\n>three\r\nAC\r\n")
    got = {r["name"]: r["seq_lines"] for r in fasta.read_fasta(spark, path).collect()}
    assert got == {"one # a comment": ["MKX", "x*A"], ">two": ["AB"], "three": ["AC"]}
    sizes = {r[0]: r[1] for r in scoring.protein_sizes(fasta.read_fasta(spark, path)).collect()}
    assert sizes == {"one": 0.004, ">two": 0.002, "three": 0.002}
    assert fasta.fasta_errors(spark, path).count() == 0


def test_fasta_errors(spark, tmp_path):
    put(tmp_path, "a.fasta", ">x\n>y\nAB\n>z\n")
    put(tmp_path, "b.fasta", "text before\n>ok\nAB\n")
    put(tmp_path, "c.fasta", "")
    put(tmp_path, "d.fasta", "\n\r\n\nlate text\n")
    put(tmp_path, "e.fasta", "\n>\n\nAB\n>\n>w\n\n")
    bad = {(r["file"][-7:], r["line"], r["error"], r["text"]) for r in fasta.fasta_errors(spark, str(tmp_path)).collect()}
    assert bad == {
        ("a.fasta", 2, "expected sequence line", "x"), ("a.fasta", 5, "expected sequence line", "z"), ("b.fasta", 1, "expected name line", "text before"),
        ("d.fasta", 4, "expected name line", "late text"), ("e.fasta", 6, "expected sequence line", ""), ("e.fasta", 7, "expected sequence line", "w"),
    }
    (tmp_path / "d.fasta").unlink()
    assert [tuple(r["seq_lines"]) for r in fasta.read_fasta(spark, str(tmp_path / "e.fasta"), strict=False).collect()] == [("AB",)]
    (tmp_path / "e.fasta").unlink()
    assert sorted(r["name"] for r in fasta.read_fasta(spark, str(tmp_path), strict=False).collect()) == ["ok", "y"]
    with pytest.raises(Exception, match="no well-formed FASTA entry"):
        fasta.read_fasta(spark, str(tmp_path)).collect()


def test_fasta_many_splits(spark, tmp_path):
    path = put(tmp_path, "a.fasta", "".join(f">s{i}\n{'ACGT' * (i % 9 + 1)}\nAC\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        read = fasta.read_fasta(spark, path)
        assert read.rdd.getNumPartitions() > 1
        got = {r["name"]: "".join(r["seq_lines"]) for r in read.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"s{i}": "ACGT" * (i % 9 + 1) + "AC" for i in range(3000)}


def test_fasta_lines_of_many_splits(spark, tmp_path):
    """Errors have the line numbers of the whole file wherever it is split, and nothing is shuffled to read entries."""
    text, want, line = "\n", {}, 2
    for i in range(2000):
        body = "" if i % 97 == 5 else "AC\n" * (i % 4 + 1) + ("\n" if i % 3 else "")
        if not body:
            want[f"s{i}"] = line + 1
        text += f">s{i}\n{body}"
        line += 1 + body.count("\n")
    path = put(tmp_path, "a.fasta", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1500)
    try:
        assert {r["text"]: r["line"] for r in fasta.fasta_errors(spark, path).collect()} == want
        read = fasta.read_fasta(spark, path, strict=False)
        assert read.count() == 2000 - len(want)
        assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in fasta.read_fasta(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fasta_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", ["AB", "CD"]), (">b", ["E"])], schemas.FASTA)
    fasta.write_fasta(df.coalesce(1), str(tmp_path / "out"))
    assert sorted(map(tuple, [(r["name"], tuple(r["seq_lines"])) for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()])) == [(">b", ("E",)), ("a", ("AB", "CD"))]


def line(name: str, tail: str = "first second") -> str:
    return f"{name}  -   m1 PF2 1e-5 10.5 0.1 1e-4 9.5 0.2 1.5 1 2 3 4 5 6 7 {tail}"


def test_tblout(spark, tmp_path):
    path = put(tmp_path, "hits", "\n".join(["# top", line("p_1"), " " + line("p_2"), line("p\t3", "one"), "p_4 - m1", line("p_5").replace("10.5", "x"), "# end"]) + "\n")
    good, bad = tables.read_tblout(spark, path)
    rows = {r["target_name"]: r for r in good.collect()}
    assert set(rows) == {"p_1", "p\t3"}
    assert (rows["p_1"]["target_accession"], rows["p_1"]["query_accession"], rows["p_1"]["inc_estimation"], rows["p_1"]["description"]) == (None, "PF2", 7, "first")
    assert bad.count() == 3
    whole, _ = tables.read_tblout(spark, path, "full")
    assert whole.filter("target_name = 'p_1'").head()["description"] == "first second"


def test_dsv(spark, tmp_path):
    path = put(tmp_path, "c.tsv", "other\tnames\tthan\tours\nm1\tc1\t50.5\t1\nm2\tc2\t100\t5\n")
    assert sorted(map(tuple, tables.read_classification(spark, path).collect())) == [("m1", "c1", 50.5, 1), ("m2", "c2", 100.0, 5)]
    bad = put(tmp_path, "bad.tsv", "a\tb\tc\td\nm1\tc1\tmany\t1\nm2\tc2\t100\t5\textra\nm3\tc3\t1\t1\n")
    with pytest.raises(Exception, match="bad row"):
        tables.read_classification(spark, bad).collect()
    with pytest.raises(Exception, match="bad row"):
        tables.read_classification(spark, bad).select("model_name").collect()  # the bad column isn't asked for
    with pytest.raises(Exception, match="bad row"):
        tables.read_classification(spark, bad).count()  # no column is asked for
    good, wrong = tables.read_dsv_either(spark, bad, schemas.MODEL_CLASSES)
    assert [r["model_name"] for r in good.collect()] == ["m3"]
    assert {r["row"].split("\t")[0] for r in wrong.collect()} == {"m1", "m2"}
    assert tables.read_score_samples(spark, put(tmp_path, "s.tsv", "1.5\n2\n")).count() == 2
    assert tables.read_classification(spark, put(tmp_path, "none.tsv", "a\tb\tc\td\n")).count() == 0
    commented = put(tmp_path, "x.tsv", "h\n#c\n1.5\n")
    assert tables.read_dsv(spark, commented, schemas.SCORE_SAMPLES, comment="#").count() == 1


BAD_ROWS = ["", "m1\tc1\t\t1", "m1\tc1\t1.5", "m1\tc1\t1.5\t", "m1\tc1\t1.5\t1\t", "m1\tc1\t 1.5\t1", "m1\tc1\t1d\t1", "m1\tc1\t1\t1.0", "m1\tc1\t1\t99999999999", "one"]


@pytest.mark.parametrize("row", BAD_ROWS)
def test_bad_rows(spark, tmp_path, row):
    """Each fails the strict reader, with its file, the columns and the separator, and is listed by the other."""
    path = put(tmp_path, "c.tsv", f"h\nm0\tc0\t1\t2\n{row}\nm9\tc9\t.5e1\t-3\n")
    with pytest.raises(Exception, match=r"c\.tsv: bad row \(expected columns model_name, class_name, class_percent, class_cat, separated by '\\t'\)"):
        tables.read_classification(spark, path).select("model_name").collect()
    good, bad = tables.read_dsv_either(spark, path, schemas.MODEL_CLASSES)
    assert sorted(map(tuple, good.collect())) == [("m0", "c0", 1.0, 2), ("m9", "c9", 5.0, -3)]
    assert [(r["row"], r["sep"], r["file"][-5:]) for r in bad.collect()] == [(row, "\t", "c.tsv")]


ODD = [" lead", "trail ", 'a"b', '"', '""', "", "tab\there", "#x", "a,b", "'", "\\", 'x"\ty', "\u00a0", "é日本", "null", "NaN"]


def test_values_come_back_as_they_were(spark, tmp_path):
    rows = [(t, float(i) if i % 3 else float("inf"), i) for i, t in enumerate(ODD)] + [("nan", float("nan"), -1)]
    schema = schemas._table(t="s", x="d", i="i")
    df = spark.createDataFrame(rows, schema)
    for sep in ("\t", ",", "|"):
        at = str(tmp_path / f"out{ord(sep)}")
        sinks.write_dsv(df, at, sep)
        assert sorted(map(repr, map(tuple, tables.read_dsv(spark, at, schema, sep).collect()))) == sorted(map(repr, rows))
        told = [r["value"] for r in spark.read.text(at).collect() if r["value"] != sep.join(df.columns)]
        assert sorted(told) == sorted(r["line"] for r in sinks.dsv_lines(df, sep).collect())
    with pytest.raises(Exception, match="can't hold"):
        sinks.write_dsv(spark.createDataFrame([("a\nb",)], "t string"), str(tmp_path / "broken"))
    assert [r["t"] for r in tables.read_dsv(spark, put(tmp_path, "one", "h\n\nx\n"), schemas._table(t="s")).collect()] == ["", "x"]


def test_headers_of_many_files_and_parts(spark, tmp_path):
    """Each file's first line is its header, however files are split and put together."""
    for k in range(3):
        put(tmp_path, f"{k}.tsv", "h\n" + "".join(f"{k}{i:04d}\n" for i in range(400)))
    put(tmp_path, "none.tsv", "")
    for size in (300, 1 << 27):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = tables.read_dsv(spark, str(tmp_path), schemas._table(n="l")).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(r["n"] for r in got) == sorted(10_000 * k + i for k in range(3) for i in range(400))


def test_dsv_sink_and_lines(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None)], "x string, y double, z int")
    assert [r["line"] for r in sinks.dsv_lines(df, ";").collect()] == ["a;1.5;"]
    assert sinks.dsv_header(df, ";") == "x;y;z"
    levels = spark.createDataFrame([("k", "v", "c", 1.0, 2.0, 0.5)], "class_key string, virus_name string, class_name string, membership_ratio double, virus_hit_score double, confidence_score double")
    sinks.write_levels(levels, str(tmp_path / "out"), ["k", "empty"])
    assert tables.read_dsv(spark, str(tmp_path / "out/k.tsv"), schemas.PREDICTIONS).count() == 1
    text = "".join(r["value"] for r in spark.read.text(str(tmp_path / "out/empty.tsv")).collect())
    assert text == "virus_name\tclass_name\tmembership_ratio\tvirus_hit_score\tconfidence_score"
    sinks.write_levels(levels.withColumn("class_name", F.lit("again")), str(tmp_path / "out"), ["k"])  # replaced
    assert [r["class_name"] for r in tables.read_dsv(spark, str(tmp_path / "out/k.tsv"), schemas.PREDICTIONS).collect()] == ["again"]
    sinks.write_levels_partitioned(levels, str(tmp_path / "parts"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "parts")).head()["class_key"] == "k"
    sinks.write_text(df.select("x"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).head()["value"] == "a"


def test_levels_are_written_by_one_run(spark, tmp_path):
    """The predictions' plan runs once for any number of levels."""
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    keys = [f"level {i}/x" if i == 3 else f"l{i}" for i in range(9)]
    rows = spark.createDataFrame([(k, f"v{i}") for k in ["l0", "l1", "l2"] for i in range(10)], "class_key string, virus_name string").mapInArrow(note, "class_key string, virus_name string")
    sinks.write_levels(rows, str(tmp_path / "out"), keys)
    assert seen.value == 30
    assert [len(tables.read_dsv(spark, str(tmp_path / f"out/l{i}.tsv"), schemas._table(v="s")).collect()) for i in (0, 1, 2, 8)] == [10, 10, 10, 0]


def test_index(spark, tmp_path):
    text = "# levels\nclassificationFiles:\n  family:\n    modelClassesFile: f/c.tsv\n    scoreSamplesFile: /abs/s.tsv\nvpfsFile: 'models.hmm'\n"
    levels, models = tables.load_index(spark, put(tmp_path, "index.yaml", text))
    assert levels == [("family", f"{tmp_path}/f/c.tsv", "/abs/s.tsv")]
    assert models == f"{tmp_path}/models.hmm"
    for broken in ("nothing here", "classificationFiles: 3\n", "classificationFiles:\n  a:\n    modelClassesFile: x\n"):
        with pytest.raises(tables.IndexFormatError):
            tables.load_index(spark, put(tmp_path, "broken.yaml", broken))


def test_tokens_with_own_predicate(spark, tmp_path):
    path = put(tmp_path, "t", "1|2.5\nskip\nx|1\n3\n")
    good, bad = tables.read_tokens(spark, path, schemas._table(a="l", b="d"), lambda v: F.split(v, r"\|"), lambda v: v == "skip")
    assert [tuple(r) for r in good.collect()] == [(1, 2.5)]
    assert {r["row"] for r in bad.collect()} == {"x|1", "3"}
