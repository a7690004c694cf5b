"""Gold answers, paths, audits, named conversations and frozen hand-overs."""

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.operators import aggregates as agg
from tallyframe.operators import contracts, dialogue, joins
from tallyframe.sources import readers, task_folders, writers


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.x for r in df.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_target_answers(spark):
    f = lambda c: text.target_answer(c, r"answer:\s*(\w+)", labels={"b": "Bee"})
    assert column(spark, f, ["x answer:\n b end", "answer: c", "b", " ", None, "none"]) == ["Bee", "c", "Bee", " ", None, "none"]
    assert column(spark, lambda c: text.target_answer(c, threshold=0.5, labels={"1": "yes"}), ["0.5", "0.4", "x"]) == ["yes", "0.4", "x"]
    assert column(spark, lambda c: text.target_answers(c, labels={"1": "one"}), [["1", "", None, "2"], [], None], "array<string>") == [["one", "2"], [], None]


def test_paths(spark):
    names = F.array(F.lit("a"), F.lit("b[]"))
    assert column(spark, lambda c: text.path_in_columns(c, names), ["a", "a.b", "a[].b", "b", "b[][]", "", None]) == [True, True, True, False, True, False, False]


def test_later_source(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, 4)], "dataset string, n int")
    b = spark.createDataFrame([("x", 5), (None, 6), (None, 7)], "dataset string, n int")
    assert sorted(r.n for r in joins.later_source_wins(a, b, a.limit(0)).collect()) == [3, 5, 6, 7]


def test_audit(spark):
    p = spark.createDataFrame([("m", i, "A" if i else "zz") for i in range(40)] + [("n", 0, None), ("q", 0, "b"), ("q", 1, "a")], "model string, idx int, prediction string")
    rows = [("m", 0.5, 9, None, 2, ["A"]), ("n", 0.5, 9, None, None, []), ("o", 0.5, 9, "", 0, None), ("q", None, 9, None, 0, ["c"]), ("r", 0.5, 9, "why", 0, [])]
    s = spark.createDataFrame(rows, "model string, score double, labeled_total int, unsupported_reason string, tag_parse_failures int, label_values array<string>")
    got = {r.model: r for r in agg.run_audit(p, s, ["model"]).collect()}
    assert {k: r.status for k, r in got.items()} == {"m": "ok", "n": "failed", "o": "failed", "q": "unmeasured", "r": "unsupported"}
    assert got["m"].warnings == ["Tagged-answer parsing failed for 2 examples.", "Predictions outside label map values: zz", "Degenerate prediction distribution: A"]
    assert got["r"].issue == "why" and got["o"].issue.startswith("predictions.jsonl is empty") and got["q"].prediction_rows is None


def test_adapters(spark):
    turns = spark.createDataFrame([("c", 1, " hi ", "sad", "s"), ("c", 2, "", "sad", "s"), ("c", 3, "there", None, "s"), ("d", 1, "alone", "x", "y")], "conv_id string, turn int, utterance string, context string, prompt string")
    got = dialogue.adapted("facebook/empathetic_dialogues", turns).collect()
    assert [(r._dialogue_prompt, r._dialogue_response) for r in got] == [("Emotion: \nSituation: s\n\nConversation:\nhi", "there")]
    assert dialogue.adapted("unknown", turns).collect() == turns.collect()


COLUMNS = "dataset string, final_rank string, candidate_id string, model string, retrieval_score string, source string, intended_use string, reason string, score string, metric string, evaluation_protocol string"


def test_frozen_handoffs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    sources = writers.file_checksums(spark, [str(tmp_path / "a.csv")])
    assert sources[0]["checksum"] == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    rows = [("d", "10", "c2", "n", "0.5", None, None, None, "0.1", "accuracy", None), ("d", "9", "c1", "m", None, "s", "direct_inference", "r", None, None, None), ("d", "11", "c3", "o", "0.4", None, None, None, None, None, None)]
    splits = spark.createDataFrame([("d", "test"), ("e", "test")], "dataset string, split string")
    docs = writers.frozen_handoffs(spark.createDataFrame(rows, COLUMNS), splits, 2, sources)
    (doc,) = [json.loads(r.handoff) for r in docs.collect()]
    assert [(c["rank"], c["candidate_id"], c["score"], c["source"], c["preflight_score"]) for c in doc["candidates"]] == [(1, "c1", 0.0, "s", ""), (2, "c2", 0.5, "preflight_selection", "0.1")]
    assert docs.select(contracts.handoff_error(F.col("handoff"), F.col("dataset"), F.lit("test"), F.lit(1)).alias("e")).first().e == ""
    bad = spark.createDataFrame([(*rows[0][:4], "nan", *rows[0][5:])], COLUMNS)
    with pytest.raises(Exception, match="no finite retrieval score"):
        writers.frozen_handoffs(bad, splits, 2, sources).collect()


def test_task_folders(spark, tmp_path):
    for i, body in ((1, "a,b\n1,2\n3,4\n"), (12, "﻿b,a\n\"x\ny\",\n"), (3, "a,b\n")):
        (tmp_path / f"task_{i:03d}").mkdir()
        (tmp_path / f"task_{i:03d}" / "batch_results.csv").write_text(body, encoding="utf-8")
    (tmp_path / "task_012" / "batch_failures.json").write_text('[{"model": "é"}, {"model": "m"}]', encoding="utf-8")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "batch_results.csv").write_text("a,b\n9,9\n")
    root = str(tmp_path)
    assert sorted(tuple(r) for r in task_folders.read_tasks(spark, root, "batch_results.csv", ["a", "b", "c"]).collect()) == [(1, "1", "2", None), (12, None, "x\ny", None)]
    assert task_folders.read_tasks(spark, root, "batch_results.csv", ["a"], "rows").count() == 3
    assert sorted(r.failure for r in task_folders.read_tasks(spark, root, "batch_failures.json", [], "failures").collect()) == ['{"model": "m"}', '{"model": "é"}']
    assert task_folders.read_tasks(spark, f"{root}/none", "x", ["a"]).collect() == []


def test_load_dataset(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "new" / "sub" / "test"))
    load = lambda name, **kw: readers.load_dataset(spark, str(tmp_path), name, split="test", **kw)
    assert load("new", subset="sub").count() == 5
    assert load("Old", fallbacks={"old": ("new", "sub")}, flatten={"Old": lambda d: d.where("id > 1")}).count() == 3
    assert sorted(r.sample_index for r in load("new", subset="sub", limit=2, seed=3, key="id").collect()) == [0, 1]
    with pytest.raises(Exception, match="old"):
        load("old")
    with pytest.raises(Exception, match="gone"):
        load("old", fallbacks={"old": ("gone", "")})
