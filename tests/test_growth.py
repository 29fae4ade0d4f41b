"""What larger tables showed: work that grew faster than its input, or was done again for each column or group."""

from __future__ import annotations

import datetime
import gzip
from decimal import Decimal
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cladeflow import schemas
from cladeflow.operators import verbs
from cladeflow.plans import catalog, scoring, stages, tools
from cladeflow.sources import sinks, tables
from cladeflow.sources.files import Folder
from cladeflow.streaming import predict

CLASSES = "model_name string, class_name string, class_percent double, class_cat int"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hits_are_dealt_once(spark):
    """Scores, totals and ranks of viruses need one exchange of hits, with levels too, in as many parts as the session says."""
    a = spark.range(400).select(F.concat(F.lit("v"), (F.col("id") % 50).cast("string")).alias("virus_name"), F.lit("m").alias("model_name"), F.lit(1.0).alias("protein_hit_score"))
    c, s = spark.createDataFrame([("m", "A", 50.0, 1), ("m", "B", 50.0, 1)], CLASSES), spark.createDataFrame([(1.0,)], "virus_hit_score double")
    for one, keys in ((scoring.predict_membership(a, c, s), []), (scoring.predict_membership(a, c.withColumn("class_key", F.lit("k")), s.withColumn("class_key", F.lit("k"))), ["k"])):
        assert plan(one).count("Exchange hashpartitioning") == 1
        assert {(r.virus_hit_score, r.membership_ratio, r.confidence_score) for r in one.collect()} == {(8.0, 0.5, 1.0)} and one.count() == 100, keys
    assert scoring.class_scores(a, c).rdd.getNumPartitions() == 4


def test_a_file_of_the_stream_is_written_once(spark, tmp_path):
    """Tasks don't each write a file for every arriving file."""
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / "in" / name).write_text("virus_name\tmodel_name\tprotein_hit_score\n" + "".join(f"v{i}\tm\t1.0\n" for i in range(200)))
    c, s = spark.createDataFrame([("m", "A", 100.0, 1)], CLASSES), spark.createDataFrame([(1.0,)], "virus_hit_score double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        predict.stream_predictions(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), c, s).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [len(list(d.glob("*.parquet"))) for d in (tmp_path / "out").glob("file_key=*")] == [1, 1]
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == 400 and "file_parts" not in found.columns


def test_tokens_are_split_once(spark, tmp_path):
    """A line is split once, however many columns and conditions are made of its tokens."""
    (tmp_path / "t").write_text("1|2.5|x\n2|y|z\n")
    good, bad = tables.read_tokens(spark, str(tmp_path / "t"), schemas._table(a="l", b="d", c="s"), lambda v: F.split(v, r"\|"))
    assert plan(good).count("split(value") == 1 and plan(bad).count("split(value") == 1
    assert list(map(tuple, good.collect())) == [(1, 2.5, "x")] and [r.row for r in bad.collect()] == ["2|y|z"]
    assert plan(tables.read_dsv(spark, str(tmp_path / "t"), schemas._table(a="l", b="s", c="s"), "|", False)).count("from_csv(") == 1


def test_groups_come_many_to_a_batch(spark):
    """Groups, also those that span batches, have the types that they would have alone; frames aren't sent one by one."""
    big = 2**60 + 1
    rows = [("a", big, True, 1), ("a", big + 2, None, 2), (None, None, True, 3), (None, 5, False, 4), ("c", 7, False, 5)] + [("hot", i, True, i) for i in range(10, 30)]
    df = spark.createDataFrame(rows, "k string, x long, t boolean, o int")
    told = lambda g: pd.DataFrame({"most": [int(g["x"].max())], "n": [len(g)], "kinds": [f"{g['x'].dtype} {g['t'].dtype} {g['o'].dtype} {g.index[-1]}"]})
    kinds = "most long, n long, kinds string"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = verbs.fixed_groups(df, ["k"], told, kinds)
        got = {r.k: tuple(r)[1:] for r in made.collect()}
        bare = sorted(map(tuple, verbs.grouped(df, ["k"], told, kinds).collect()))
        want = sorted(map(tuple, df.groupBy("k").applyInPandas(told, kinds).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert bare == want == sorted(got.values())
    assert got["a"][0] == big + 2 and got["hot"][:2] == (29, 20) and got[None][1] == 2 and got["c"][0] == 7
    assert "FlatMapGroupsInPandas" not in plan(made)
    empty = verbs.fixed_groups(df, ["k", "o"], lambda g: g.iloc[:0][["x"]], "x long")
    assert empty.columns == ["k", "o", "x"] and empty.count() == 0


def test_content_is_dealt_packed(spark, monkeypatch):
    """Digests are dealt out and kept as bytes, half as long as their digits."""
    seen = []
    monkeypatch.setattr(stages, "kept", lambda df: seen.append(dict(df.dtypes)) or df)
    key = stages.content_key(spark.range(5))
    assert seen[0]["d"] == "binary" and key.startswith("5-")


def test_tools_run_on_all_cores(spark):
    """Chunks of few bytes aren't run one after the other by one task."""
    rows = spark.range(64).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.array(F.lit("AC")).alias("seq_lines"), (F.col("id") % 16).alias("chunk_id"))
    back = tools.pipe_tool(rows, lambda source, out: ["cp", source, out], tools.parse_fasta, schemas.FASTA)
    got = back.withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 64 and len({r.task for r in got}) > 4
    assert tools.run_on_chunks(rows, lambda batches: batches, rows.schema).rdd.getNumPartitions() > 4


def test_waves_don_t_look_for_chunks_again(spark, tmp_path):
    """Rows of chunks are worked out as often for many waves as for two, and shares are gone afterwards."""

    def made(each: int) -> int:
        seen = spark.sparkContext.accumulator(0)

        def count(batches):
            for b in batches:
                seen.add(len(b))
                yield b

        rows = spark.range(40).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.array(F.lit("AC")).alias("seq_lines"), (F.col("id") % 20).cast("string").alias("chunk_key"))
        ledger = stages.Ledger(spark, f"{tmp_path}/{each}", schemas.FASTA)
        run = lambda some: tools.pipe_tool(some, lambda source, out: ["cp", source, out], tools.parse_fasta, schemas.FASTA, ["chunk_key"], told=True)
        back = ledger.run(rows.mapInPandas(count, rows.schema), run, each)
        worked_out = seen.value
        assert back.count() == 40 and len(ledger.waves()) > 1
        return worked_out

    before = set(Folder(spark, str(tmp_path)).names(stages.shared_folder(spark)))
    assert made(10) == made(2)
    assert not [n for n in set(Folder(spark, str(tmp_path)).names(stages.shared_folder(spark))) - before if n.startswith("scratch-")]


def test_table_functions_take_batches(spark):
    """Rows of a table function's partitions don't go to Python and back one by one; partitions that span batches are whole, and values have the kinds that rows have."""
    rows = [(i // 7, i, 2**60 + i, None if i % 5 == 0 else i, datetime.date(2020, 1, 1 + i % 9), datetime.datetime(2021, 2, 3, 4, i), Decimal("1.50"), [i]) for i in range(40)]
    spark.createDataFrame(rows, "k int, o int, big long, gap int, day date, at timestamp, price decimal(9,2), all array<int>").createOrReplaceTempView("rows_of_kinds")
    told = lambda g: pd.DataFrame({"n": [len(g)], "most": [int(g["big"].max())] if "big" in g else [0], "told": [" ".join(repr(g[c].iloc[0]) for c in g)]})
    for name, columns in (("of_numbers", ["big", "o"]), ("of_kinds", ["o", "gap", "day", "at", "price", "all"])):
        verbs.table_function(spark, name, told, columns, "n int, most long, told string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        numbers = spark.sql("SELECT * FROM of_numbers(TABLE(rows_of_kinds) PARTITION BY k ORDER BY o)")
        kinds = {r.told for r in spark.sql("SELECT * FROM of_kinds(TABLE(rows_of_kinds) PARTITION BY k ORDER BY o DESC)").collect()}
        assert "ArrowEvalPythonUDTF" in plan(numbers)
        assert sorted((r.n, r.most - 2**60) for r in numbers.collect()) == [(5, 39), (7, 6), (7, 13), (7, 20), (7, 27), (7, 34)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = pd.DataFrame([r[1:2] + r[3:] for r in rows[6::-1]], columns=list("abcdef"))
    assert " ".join(repr(last[c].iloc[0]) for c in last) in kinds and len(kinds) == 6


def test_levels_take_little_disk(spark, sf, tmp_path, monkeypatch):
    """Class, sample and prediction files of the round trip are compressed, and what a write of it dealt out is gone when the next one begins."""
    work, shuffled, write = tmp_path / "work", [], sinks.write_levels
    files = lambda: {f for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for f in Path(d).rglob("shuffle_*.data")}
    monkeypatch.setattr(stages, "scratch_folder", lambda _: str(work))
    monkeypatch.setattr(sinks, "write_levels", lambda *a: shuffled.extend([files(), write(*a), files()]))
    before = files()
    assert catalog.levels_roundtrip(spark, sf).count() > 0
    assert len(shuffled) == 3 and not (shuffled[0] | shuffled[2]) - before
    told = [f for f in work.rglob("part-*") if "aggregated" not in f.parts and "index" not in f.parts]
    assert told and all(f.name.endswith(".gz") for f in told)
    out = [f for f in told if "out" in f.parts]
    assert sum(f.stat().st_size for f in out) * 2.5 < sum(len(gzip.decompress(f.read_bytes())) for f in out)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_compressed_text_comes_back(spark, tmp_path):
    """Each compressed file has a header of its own, and a level without rows is read too."""
    rows = [("a" if i % 3 else "b", f"v{i}", "c\t1", i / 7) for i in range(500)]
    df = spark.createDataFrame(rows, "class_key string, virus_name string, class_name string, x double").repartition(3)
    schema = schemas._table(virus_name="s", class_name="s", x="d")
    sinks.write_levels(df, str(tmp_path / "out"), ["a", "b", "none"], "gzip")
    sinks.write_dsv(df.drop("class_key"), str(tmp_path / "all"), compression="gzip")
    assert len(list((tmp_path / "out/a.tsv").glob("*.gz"))) == 3
    for name, want in (("out/a.tsv", [r[1:] for r in rows if r[0] == "a"]), ("out/b.tsv", [r[1:] for r in rows if r[0] == "b"]), ("out/none.tsv", []), ("all", [r[1:] for r in rows])):
        assert sorted(map(tuple, tables.read_dsv(spark, str(tmp_path / name), schema).collect())) == sorted(want)
    for broken in ("a\nb", "a\rb"):
        with pytest.raises(Exception, match="can't hold"):
            sinks.write_dsv(spark.createDataFrame([(broken,)], "t string"), str(tmp_path / f"broken{ord(broken[1])}"), compression="gzip")


def test_best_hits_are_dealt_by_protein(spark):
    """Hits are dealt once for the best of a protein and for its size, and only what scores need travels; ties and units are as before."""
    rows = [("u", "v_1", "a", 0.0, 10.0, 2), ("u", "v_1", "b", 0.0, 10.0, 1), ("w", "v_1", "c", 0.0, 4.0, 3), ("w", "x", "c", 0.0, 4.0, 4), ("w", "v_2", "c", 0.0, None, 5)]
    h = spark.createDataFrame(rows, "unit string, target_name string, query_name string, sequence_e_value double, sequence_score double, pos int")
    p = spark.createDataFrame([("u", "v_1", 2.0), ("w", "v_1", 4.0), ("w", "x", 1.0), ("w", "v_2", 1.0)], "unit string, protein_name string, k_base_size double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = scoring.aggregate_hits(h, p, ["pos", "unit"], unit=["unit"])
        assert plan(made).count("Exchange hashpartitioning") == 3
        assert sorted(map(tuple, made.collect()), key=str) == [("u", "v", "b", 5.0), ("w", "v", "c", 1.0), ("w", None, "c", 4.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert verbs.best_per_group(h, ["target_name"], "sequence_score", ["pos"], ["query_name"]).columns == ["target_name", "query_name"]


def test_ranks_over_ranges_keep_what_is_returned(spark, monkeypatch):
    """Predictions are kept without the scores that only ratios are made of."""
    seen, keep, rank = [], scoring.kept, scoring.percentile_rank
    monkeypatch.setattr(scoring, "kept", lambda df: seen.append(df.columns) or keep(df))
    monkeypatch.setattr(scoring, "percentile_rank", lambda *a: rank(*a, small=1))
    a = spark.createDataFrame([("v", "m", 4.0), ("w", "m", 8.0)], "virus_name string, model_name string, protein_hit_score double")
    c, s = spark.createDataFrame([("m", "A", 25.0, 1), ("m", "B", 75.0, 1)], CLASSES), spark.createDataFrame([(1.0,), (4.0,), (9.0,)], "virus_hit_score double")
    got = {(r.virus_name, r.class_name): (r.membership_ratio, r.virus_hit_score, r.confidence_score, r.rank_in_virus) for r in scoring.predict_membership(a, c, s).collect()}
    assert got == {("v", "A"): (0.25, 4.0, 0.5, 2), ("v", "B"): (0.75, 4.0, 0.5, 1), ("w", "A"): (0.25, 8.0, 2 / 3, 2), ("w", "B"): (0.75, 8.0, 2 / 3, 1)}
    assert sorted(seen[0]) == ["class_name", "membership_ratio", "rank_in_virus", "virus_hit_score", "virus_name"]
