"""Round trips of readers and sinks, and the stream."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyframe.sources import readers, writers
from tallyframe.streaming import monitor


def test_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿condition,query_dataset,rank,model_name\nA,d,1,"m ""x"", y"\nB,d,,m2\n', encoding="utf-8")
    df = readers.read_conditions(spark, str(tmp_path / "c.csv"))
    assert [tuple(r) for r in df.collect()] == [("A", "d", "1", 'm "x", y'), ("B", "d", None, "m2")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_conditions(spark, str(tmp_path / "bad.csv"))
    writers.write_csv(df.withColumn("n", F.lit("3/5")), str(tmp_path / "out"), ["model_name", "n", "nothing"], ("n",))
    assert [tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).collect()] == [('m "x", y', "'3/5", None), ("m2", "'3/5", None)]


def test_discover(spark, tmp_path):
    for i in (1, 12):
        (tmp_path / f"task_{i:03d}").mkdir()
        (tmp_path / f"task_{i:03d}" / "results.csv").write_text(f"dataset,score\nd{i},0.5\n")
        (tmp_path / f"task_{i:03d}" / "other.csv").write_text("dataset,score\nno,0\n")
    rows = readers.discover(spark, str(tmp_path), ("results.csv", "batch_results.csv")).collect()
    assert sorted((r.dataset, r.task_index) for r in rows) == [("d1", 1), ("d12", 12)]


def test_discover_files_of_unlike_headers(spark, tmp_path):
    (tmp_path / "task_1").mkdir()
    (tmp_path / "task_2 x").mkdir()
    (tmp_path / "task_1" / "results.csv").write_text('dataset,model,score\nd1,"m ""1"",\nx",0.5\nd2, ,\n')
    (tmp_path / "task_2 x" / "results.csv").write_text("\ufeffmodel,dataset,status,score\nm2,d1,ok,0.25\n", encoding="utf-8")
    rows = {(r.dataset, r.model, r.status, r.score, r.task_index) for r in readers.discover(spark, str(tmp_path), ("results.csv",)).collect()}
    assert rows == {("d1", 'm "1",\nx', None, "0.5", 1), ("d2", None, None, None, 1), ("d1", "m2", "ok", "0.25", None)}
    assert readers.discover(spark, str(tmp_path), ("none.csv",)).collect() == []


def test_allow_list(spark, tmp_path):
    (tmp_path / "l").write_text("b # two\n\n# none\na\nb\n")
    assert [r.name for r in readers.read_allow_list(spark, str(tmp_path / "l")).orderBy("ordinal").collect()] == ["b", "a"]
    (tmp_path / "e").write_text("# nothing\n")
    with pytest.raises(ValueError):
        readers.read_allow_list(spark, str(tmp_path / "e"))


def test_json(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a long").collect()) == [1, 2]
    (tmp_path / "plans").mkdir()
    (tmp_path / "plans" / "round_3").mkdir()
    (tmp_path / "plans" / "round_3" / "plans.json").write_text(json.dumps({"plans": [{"dataset": "d", "model": "m", "metric": "accuracy"}]}))
    assert [(r.round, r.model) for r in readers.read_plans(spark, str(tmp_path / "plans")).collect()] == [(3, "m")]
    (tmp_path / "h.json").write_text(json.dumps({"dataset": "d", "split": "s", "round": 1, "candidates": [{"model": "m", "rank": 1}, {"model": "n", "rank": 2}]}, indent=1))
    assert [(r.ordinal, r.model) for r in readers.read_handoff(spark, str(tmp_path / "h.json")).collect()] == [(0, "m"), (1, "n")]
    assert readers.last_json_object('x {"a": 1} y {bad} {"b": {"c": 2}} z') == '{"b": {"c": 2}}'
    assert readers.last_json_object(None) is None
    df = spark.createDataFrame([('a {"k": 1}',), (None,)], "t string").select(readers.embedded_object("t"))
    assert [r[0] for r in df.collect()] == ['{"k": 1}', None]


def test_ranking_export(spark):
    exported = spark.createDataFrame([("d", ["x", "y"])], "dataset_id string, ranked_model_ids array<string>")
    meta = spark.createDataFrame([("x", "name")], "model_id string, name string")
    assert sorted((r.rank, r.score, r.name) for r in readers.read_ranking(exported, meta).collect()) == [(1, 1.0, "name"), (2, 0.5, None)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.5), (None, 2.0)], "name string, score double")
    assert writers.markdown(df).splitlines()[2:] == ["| a\\|b | 1.5 |", "|  | 2.0 |"]
    writers.write_xlsx(df, str(tmp_path / "r.xlsx"))
    assert [tuple(r) for r in readers.read_xlsx(spark, str(tmp_path / "r.xlsx")).collect()] == [("a|b", "1.5"), (None, "2.0")]
    sheet = zipfile.ZipFile(tmp_path / "r.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert "<v>1.5</v>" in sheet and "a|b" in sheet
    docs = writers.handoffs(spark.createDataFrame([("d", 2, "n", 0.1), ("d", 1, "m", 0.2)], "dataset string, final_rank int, model string, score double")).collect()
    assert [x["model"] for x in json.loads(docs[0].candidates)] == ["m", "n"]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("d", "ok", 0.5, 1, f"2024-01-01 0{h}:10:00") for h in (1, 1, 2, 9)], "dataset string, status string, score double, labeled_total int, t string").selectExpr("dataset", "status", "score", "labeled_total", "timestamp(t) as ts")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = monitor.to_table(monitor.windowed_outcomes(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r.window_start.hour: r.results for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 2, 2: 1}  # the last window stays open until the watermark passes it
    assert {r.window_start.hour: r.results for r in monitor.windowed_outcomes(rows).collect()} == {1: 2, 2: 1, 9: 1}
