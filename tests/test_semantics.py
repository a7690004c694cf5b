"""Hand-computed cases for the rules that are easy to get wrong."""

import math
import random
import re
import string
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions import contract, metrics, text, vectors
from tallyframe.operators import aggregates, compare, dialogue, joins, loop, ranking, recovery, scoring, text_metrics


def one(spark, *columns):
    return list(spark.range(1).select(*columns).collect()[0])


def lit(x):
    return F.lit(x).cast("string")


def plain_normal(x):
    x = re.sub(r"\b(a|an|the)\b", " ", ("" if x is None else x).strip().lower())
    return " ".join(x.translate(str.maketrans("", "", string.punctuation)).split())


@pytest.mark.parametrize("x", [None, "", "  ", "The cat, a dog!", "x-a-y", "an apple's", "théâtre a été", "A.B.C", "the the", "éa the é"])
def test_normalize(spark, x):
    assert one(spark, text.normalize_answer(lit(x))) == [plain_normal(x)]


def test_numbers(spark):
    cases = ["1.5", "", "nan", "inf", "abc", None, "-2e1"]
    assert one(spark, *[contract.number(lit(x)) for x in cases]) == [1.5, None, None, None, None, None, -20.0]
    assert one(spark, *[contract.integer(lit(x)) for x in ["3", "3.0", "", None, " 7 "]]) == [3, 0, 0, 0, 7]


def test_four_success_rules(spark):
    s = lambda st, sc, n: [contract.measured_success(lit(st), lit(sc), lit(n)), contract.is_measurement(lit(st), lit(sc), lit(n), F.lit(False)), contract.is_loop_measurement(lit(st), lit(sc), lit(n)), contract.is_array_success(lit(st))]
    assert one(spark, *s("OK", "0.5", "3")) == [True, True, True, True]
    assert one(spark, *s("warn", "0.5", None)) == [False, True, False, False]
    assert one(spark, *s("complete", "0.5", "3")) == [False, False, True, False]
    assert one(spark, *s("ok", "nan", "3")) == [False, False, False, True]
    assert one(spark, *s("ok", "0.5", "0")) == [False, False, False, True]
    assert one(spark, contract.is_smoke(lit("a/_smoke/b"), lit("x")), contract.is_smoke(lit(None), lit("the_SMOKE.csv")), contract.is_smoke(lit("a"), lit("b"))) == [True, True, False]


def test_empty_sides(spark):
    for name in ("qa_f1", "rouge_l", "set_f1"):
        got = one(spark, *[metrics.metric(name, lit(a), lit(b)) for a, b in (("", ""), ("the", "a"), ("x", ""), ("", "x"), ("x y", "y x"))])
        assert got[:4] == [1.0, 1.0, 0.0, 0.0]
        assert got[4] == {"qa_f1": 1.0, "rouge_l": 0.5, "set_f1": 0.0}[name]


@pytest.mark.parametrize(("a", "b", "want"), [
    ("about 1,234", "1234.0", 1.0), ("50%", "1/2", 1.0), ("1:4", "0.25", 1.0), ("1/0", "1/0", 1.0), ("1/2%", "0.005", 0.0), ("seven", "Seven.", 1.0), ("x 3 then 4", "4", 1.0), ("v2", "2", 0.0), ("-.5", "-0.50", 1.0), ("", "", 1.0),
    ("0.000001", "0.000002", 0.0), ("0.0000010", ".000001", 1.0), ("1234567890123456", "1234567890123456.0", 1.0), ("1234567890123456", "1234567890123457", 0.0), ("9" * 60, "+" + "9" * 60 + ".000", 1.0), ("9" * 60, "9" * 59 + "8", 0.0),
    ("1/3", "2/6", 1.0), ("1/3", "0.3333333333", 0.0), ("-0", "0.00%", 1.0), ("1000", "1e3", 0.0), ("3:0.5", "600%", 1.0), ("-1/4", "1/-4", 1.0), ("100", "1", 0.0), ("\t7\n", "7", 1.0), ("1000/10", "100", 1.0),
])
def test_numeric_match(spark, a, b, want):
    assert one(spark, metrics.numeric_match(lit(a), lit(b))) == [want]


@pytest.mark.parametrize(("raw", "labels", "many", "want"), [
    ("<answer> A </answer><ANSWER>\nB\n</ANSWER>", [], False, ("B", "ok")), ("<answer></answer>", [], False, ("", "empty_answer")), ("  ", [], False, ("", "empty_generation")), (None, [], False, ("", "empty_generation")),
    ('"Yes."', ["yes", "no"], False, ("yes", "untagged_label")), ("yes or no", ["yes", "no"], False, ("yes or no", "untagged_fallback")), ("nothing", ["no"], False, ("nothing", "untagged_fallback")),
    ("A good one", ["A", "B"], False, ("A good one", "untagged_fallback")), ("the answer is: B", ["A", "B"], False, ("the answer is: B", "untagged_fallback")), ("the answer is B", ["A", "B"], False, ("B", "untagged_label")),
    ('so [1] or ["YES"]', ["yes", "no"], True, ('["yes"]', "untagged_json")), ("[]", ["yes"], True, ("[]", "untagged_json")), ("no yes", ["yes", "no"], True, ('["yes","no"]', "untagged_labels")),
])
def test_tagged(spark, raw, labels, many, want):
    assert tuple(one(spark, text.tagged_answer(lit(raw), labels, many))[0]) == want


words = st.lists(st.sampled_from(["x", "y", "z", "é", "the", "w-w"]), max_size=7).map(" ".join)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(words, words), min_size=1, max_size=20))
def test_metrics_against_definitions(spark, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, prediction string, reference string")
    f1 = {r.i: r.score for r in text_metrics.score_rows(rows, "qa_f1").collect()}
    rl = {r.i: r.score for r in text_metrics.score_rows(rows, "rouge_l").collect()}
    for i, (a, b) in enumerate(pairs):
        p, r = plain_normal(a).split(), plain_normal(b).split()
        table = [[0] * (len(r) + 1) for _ in range(len(p) + 1)]
        for x in range(len(p)):
            for y in range(len(r)):
                table[x + 1][y + 1] = table[x][y] + 1 if p[x] == r[y] else max(table[x][y + 1], table[x + 1][y])
        assert text_metrics.lcs_lists(p, r) == table[-1][-1]
        for got, o in ((f1[i], sum((Counter(p) & Counter(r)).values())), (rl[i], table[-1][-1])):
            want = float(p == r) if not p or not r else 2 * (o / len(p)) * (o / len(r)) / (o / len(p) + o / len(r)) if o else 0.0
            assert got == pytest.approx(want)


def test_blank_is_any_white_space(spark):
    white = "\n\t \u3000"
    got = one(spark, text.has_gold(lit(white)), text.stringify(lit(white)), contract.blank_to_null(lit(white)), text.has_gold_list(F.array(lit(white), lit(None))), text.has_gold_list(F.array(lit(white), lit("x"))), metrics.best_of(F.array(lit(white)), lambda r: metrics.exact_match(lit("x"), r)), text.stripped(lit("\t a b\n")))
    assert got == [False, "<blank>", None, False, True, None, "a b"]


@pytest.mark.parametrize(("p", "r", "want"), [
    ('[{"type":"chem","text":"Aspirin"}]', '[{"text":"aspirin","type":"chemical"}]', 1.0), ('[{"mention":["a b","c"],"type":"x y"}]', '[{"text":"c","type":"X-Y"},{"type":"x y","text":"b"}]', 1.0), ('{"text":"x"}', '[{"text":"X","type":"entity"}]', 1.0),
    ('[["x","y"],["z, w"]]', "w;z\ny, x", 1.0), ('["a, x", "[\\"y\\"]"]', "x,y", 1.0), ('{"k":"v","b":1}', '{"b": 1, "k": "V"}', 1.0), ("['x']", "x", 1.0), ('["x"] and y', '["x"]', 0.0), ("[1, 2]", "2,1", 1.0), ('[null, ""]', "", 1.0), ("[[[\"p\"]]]", "p", 1.0),
    ('[{"type":"drug","text":"x"}]', '[{"type":"gene","text":"x"}]', 0.0), ('{"text":""}', '{"text":""}', 1.0),
])
def test_sets(spark, p, r, want):
    assert one(spark, metrics.metric("set_f1", lit(p), lit(r))) == [want]


def test_labels_in_arrays_are_texts(spark):
    assert one(spark, text.embedded_label_array(lit('[1] then ["1"]'), ["1"]), text.embedded_label_array(lit("[1]"), ["1"])) == [["1"], None]


def test_merge_pairs_keeps_the_fullest_row(spark):
    rows = [(0, "d", "m", "x", None, "c1"), (1, "d", "m", "y", "1", "c2"), (2, "d", "m", "z", "2", "c1"), (3, "e", "m", None, None, "\t")]
    got = aggregates.merge_pairs(spark.createDataFrame(rows, "ordinal int, dataset string, model string, status string, score string, condition string"), ["condition"]).orderBy("dataset").collect()
    assert [(r.status, r.score, r.condition, r.n_rows) for r in got] == [("y", "1", "c1; c2", 3), (None, None, "", 1)]


def test_modes_of_results(spark):
    p = spark.createDataFrame([(1, "m", "x", "x"), (2, "m", "y", "\t"), (3, "m", "y", "z"), (4, "m", "y", "x")], "idx int, model string, target_answer string, prediction string")
    r = spark.createDataFrame([("m", "ok", 0.2, 4, True), ("n", "failed", None, 0, False), ("o", "ok", 0.1, 0, None)], "model string, status string, score double, labeled_total int, has_summary boolean")
    got = {(x.model, x["mode"], x.n) for x in aggregates.failure_modes(p, ["model"], r).collect()}
    assert got == {("m", "blank_outputs", 1), ("m", "invalid_outputs", 2), ("m", "weak_target_label", 1), ("n", "evaluation_failed", 1), ("o", "missing_summary", 1), ("o", "missing_predictions", 1), ("o", "unlabeled_split", 1)}


def test_loop_resumes_and_ends(spark, tmp_path):
    done = []

    def evaluate(found):
        done.append(found.count())
        return found.selectExpr("dataset", "model", "ordinal", "'ok' as status", "0.5D as score", "'3' as labeled_total", "'accuracy' as metric", "'label_generation_accuracy' as evaluation_protocol")

    def candidates(r, seen):
        return spark.createDataFrame([("d", f"m{r}", 0), ("d", "m1", 1)], "dataset string, model string, ordinal int")

    none = spark.createDataFrame([], "dataset string, model string")
    run = lambda **k: (x := loop.SelectionLoop(candidates, evaluate, str(tmp_path), **k), x.run(none))
    first, rows = run(rounds=2)
    again, same = run(rounds=2)
    assert done == [1, 1] and again.reused == 2 and sorted(rows.collect()) == sorted(same.collect()) and first.reason == "max_rounds_reached"
    assert run(rounds=3, target=2)[0].reason == "target_reached" and len(done) == 4
    assert run(rounds=3, target=1, review=lambda df: True)[0].reason == "reviewed_stop" and run(rounds=2, minimum=0.1)[0].reason == "no_improvement"
    assert run(rounds=3, static={1: candidates(1, none)})[0].reason == "static_rounds_finished"
    assert loop.SelectionLoop(lambda r, s: none.selectExpr("*", "0 as ordinal"), evaluate, str(tmp_path)).run(none) is None
    bad = loop.SelectionLoop(candidates, lambda f: evaluate(f).withColumn("status", F.lit("failed")), str(tmp_path / "b"))
    assert bad.run(none).count() == 1 and bad.reason == "all_candidates_failed"
    with pytest.raises(ValueError):
        loop.validate_capacity(2, 3, 7)
    reviews = spark.createDataFrame([(2, ["stop", "STOP"], 2), (2, ["stop"], 2), (2, ["stop", "go"], 2), (2, None, 0), (1, None, 0)], "successes int, decisions array<string>, votes_needed int")
    assert [r.stop for r in loop.reviewed_stop(reviews, 2).collect()] == [True, False, False, True, False]


def test_long_rouge(spark):
    rng = random.Random(5)
    a, b = ([rng.choice("uvwxyz") for _ in range(500)] for _ in "ab")
    df = spark.createDataFrame([(a, b)], "p array<string>, r array<string>")
    short, long = df.select(metrics.lcs_length(F.slice("p", 1, 60), F.slice("r", 1, 60)), text_metrics.rouge_l_rows(F.col("p"), F.col("r"))).collect()[0]
    assert short == text_metrics.lcs_lists(a[:60], b[:60])
    assert long == pytest.approx(text_metrics.lcs_lists(a, b) / 500)


RESULTS = "ordinal long, dataset string, model string, rank int, round int, status string, score double, labeled_total int, metric string, evaluation_protocol string"


def results(spark, rows):
    return ranking.annotate_comparability(ranking.with_outcome(spark.createDataFrame(rows, RESULTS)))


def test_ranks_and_winners_differ_on_ties(spark):
    p = "label_generation_accuracy"
    df = results(spark, [(0, "d", "late", 3, 1, "ok", 0.5, 1, "accuracy", p), (1, "d", "norank", None, 1, "ok", 0.5, 1, "accuracy", "tagged_" + p), (2, "d", "other", 1, 1, "ok", 0.9, 1, "macro_f1", p), (3, "e", "plan", 2, 1, "planned", None, 0, "", ""), (4, "e", "plan0", None, 1, "planned", None, 0, "", ""), (5, "f", "bad", None, 1, "failed", None, 0, "", "")])
    assert [(r.dataset, r.final_rank, r.model) for r in ranking.rank_models(df, 5).orderBy("dataset", "final_rank").collect()] == [("d", 1, "norank"), ("d", 2, "late"), ("e", 1, "plan"), ("e", 2, "plan0")]
    assert {r.dataset: r.model for r in ranking.select_winners(df).collect()} == {"d": "late", "e": "plan", "f": "bad"}
    assert {r.model: r.outcome for r in df.collect()}["other"] == "non_comparable"
    kept = df.withColumn("comparable", F.lit(None).cast("boolean")).withColumn("outcome", F.lit("success"))
    assert ranking.rank_models(kept.where("score is not null"), 9).count() == 3


def test_null_gold(spark):
    p = spark.createDataFrame([(1, "m", None, ""), (2, "m", None, "x"), (3, "m", "x", "X.")], "idx int, model string, target_answer string, prediction string")
    assert aggregates.scoreboard(p, ["model"]).collect()[0].asDict() == {"model": "m", "total": 3, "labeled_total": 3, "correct": 2, "accuracy": round(2 / 3, 9)}
    assert aggregates.scoreboard_with_gold(p, ["model"]).collect()[0].asDict() == {"model": "m", "total": 3, "labeled_total": 1, "accuracy": 1.0}
    assert aggregates.scoreboard_with_gold(p.where("idx < 3"), ["model"]).collect()[0].accuracy is None
    assert aggregates.macro_f1(p, ["model"]).collect()[0].labels == 2
    assert aggregates.macro_f1(p, ["model"], raw=True).collect()[0].labels == 2


def test_perfect_predictions(spark):
    p = spark.createDataFrame([(i, "m", x, x) for i, x in enumerate("xyzx")], "idx int, model string, target_answer string, prediction string")
    assert aggregates.macro_f1(p, ["model"]).collect()[0].macro_f1 == 1.0


def test_all_failed_needs_every_model(spark):
    p = spark.createDataFrame([(1, "a", "x", "y"), (1, "b", "x", "x")], "idx int, model string, target_answer string, prediction string")
    assert aggregates.failed_by_all(p).count() == 0


def test_winner(spark):
    df = spark.createDataFrame([(0.5, 0.5 + 1e-13, "accuracy", None), (0.5, 0.6, "accuracy", "f1"), (0.5, 0.6, "", "f1"), (None, 0.1, "", "")], "a_score double, b_score double, a_metric string, b_metric string")
    assert [r[0] for r in df.select(compare.winner(["a", "b"])).collect()] == ["tie", "incomplete", "b", "incomplete"]


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "ordinal int, k string")
    right = spark.createDataFrame([(1, "a", "ok"), (2, "a", "failed")], "ordinal int, k string, status string")
    assert {r.k: r.status for r in joins.join_last(left, right, ["k"]).collect()} == {"a": "failed", "b": "missing"}
    assert [(r.k, r.status) for r in joins.join_first(left, right, ["k"]).collect()] == [("a", "ok")]
    with pytest.raises(Exception, match="repeated"):
        joins.strict_pairs(left, right.drop("ordinal"), "k").collect()
    with pytest.raises(Exception, match="ordinal differs"):
        joins.strict_pairs(left, left.selectExpr("k", "ordinal + 1 as other"), "k", {"ordinal": "other"}).collect()
    with pytest.raises(Exception, match="one side"):
        joins.strict_pairs(left, right.where("ordinal = 1").select("k", "status"), "k").collect()
    assert joins.strict_pairs(left.where("k = 'a'"), right.where("ordinal = 1").select("k", "status"), "k").count() == 1


def test_recovery_tables(spark):
    c = lambda s, r: recovery.failure_category(lit(s), lit(r))
    assert one(spark, c("untried", ""), c("unsupported", "x no direct adapter exists y"), c("unsupported", None), c("failed", "")) == ["never_attempted", "stale_adapter", "incompatible", "runtime_failure"]
    lane = lambda k, r: recovery.salvage_lane(lit(k), lit(r))
    assert one(spark, lane("runtime_failure", "generic_retry"), lane("incompatible", "generic_retry"), lane("missing_output", "blocked_remote_code"), lane("never_attempted", "active_coverage_run")) == ["generic", "deferred", "blocked", "explicit"]


def test_dialogue(spark):
    flat = spark.createDataFrame([(1, 0, " hi "), (1, 1, ""), (1, 2, "yo"), (2, 0, "alone"), (1, 3, None)], "conv_id int, turn int, text string")
    assert [(r.turn, r.history, r.response) for r in dialogue.next_turns(flat).collect()] == [(2, "hi", "yo")]
    seeded = spark.createDataFrame([(1, ["p"], ["m1", " ", "m2"], ["likes x"])], "k int, previous_utterance array<string>, free_messages array<string>, personas array<string>")
    assert [(r.history, r.response) for r in dialogue.seeded_turns(seeded, "k").orderBy("pos").collect()] == [("p", "m1"), ("p\nm1", "m2")]


def test_prompts(spark):
    say = lambda u, s: text.dialogue_text(F.array(*map(F.lit, u)), F.array(*map(F.lit, s)))
    assert one(spark, say(["a", "b"], [0, 1]), say(["a", "b"], [0])) == ["User: a\nAssistant: b", "Turn 1: a\nTurn 2: b"]
    assert one(spark, text.threshold_label(F.lit(0.5), 0.5), text.regex_answer(lit("so #### 42"), r"#### (\d+)"), text.regex_answer(lit("none"), r"#### (\d+)")) == ["1", "42", "none"]
    assert one(spark, text.safe_name(lit("/a b/c/")), text.unsafe_model_name(lit("org_m_x")), text.one_line(lit("a\n b  c"), 5)) == ["a_b_c", "org/m_x", "a;..."]


def test_vectors(spark):
    a = lambda *x: F.array(*map(F.lit, map(float, x)))
    got = one(spark, vectors.cosine(a(1, 0), a(1, 1)), vectors.argmax(a(1, 3, 3)), vectors.sigmoid_labels(a(-1, -2)), vectors.sigmoid_labels(a(0, 2)), vectors.best_span(a(0, 5), a(9, 1), 4), vectors.best_span(a(1, 0), a(1, 9), 1), vectors.cosine(a(0, 0), a(1, 1)))
    assert got[0] == pytest.approx(0.5**0.5) and got[1:4] == [1, [0], [0, 1]] and tuple(got[4]) == (9.0, 0, 0) and tuple(got[5]) == (9.0, 1, 1) and got[6] == 0.0


def test_loop(spark, tmp_path):
    def candidates(r, seen):
        return spark.createDataFrame([("d", f"m{r}", 1), ("d", "M0", 2)], "dataset string, model string, ordinal long")

    def evaluate(df):
        return df.selectExpr("*", "'ok' as status", "0.5D as score", "1 as labeled_total", "'accuracy' as metric", "'p' as evaluation_protocol")

    seen = spark.createDataFrame([("d", "m0")], "dataset string, model string")
    out = loop.SelectionLoop(candidates, evaluate, str(tmp_path), rounds=5, minimum=0.01).run(seen)
    assert sorted((r["round"], r.model) for r in out.collect()) == [(1, "m1"), (2, "m2")]


def test_selection(spark):
    from tallyframe.operators import selection as sel

    close = lambda x: sel.closest_label(lit(x), F.array(F.lit("World"), F.lit("Sci/Tech"), F.lit("Sports")))
    assert one(spark, close("sports"), close("TECH"), close("World News"), close("cooking")) == ["Sports", "Sci/Tech", "World", ""]
    assert one(spark, sel.error_line(lit("x\nValueError: a\nOSError: b\nTypeError: c")), sel.error_line(lit("fine")), sel.error_line(lit("y" * 20), 10)) == ["TypeError: c", "fine", "y" * 7 + "..."]
    files = F.array(*map(F.lit, ["m-Q8_0.gguf", "m-Q4_K_M-00002-of-00002.gguf", "m-Q4_K_M-00001-of-00002.gguf", "mmproj-q4_k_m.gguf", "read.me"]))
    assert one(spark, sel.weight_file(files), sel.missing_shards(lit("m-00001-of-00002.gguf"), F.array(F.lit("m-00001-of-00002.gguf"))), sel.missing_shards(lit("m.gguf"), files)) == ["m-Q4_K_M-00001-of-00002.gguf", ["m-00002-of-00002.gguf"], []]
    df = spark.createDataFrame([(i, "abc"[i % 3], None if i % 4 else "x", "y") for i in range(12)], "ordinal long, dataset string, a string, b string")
    assert sel.answer_column(df, ["none", "a", "b"], 8) == "b" and sel.answer_column(df, ["none"], 8) == ""
    assert [r.ordinal for r in sel.first_pairs_then_datasets(df, 5, 2).orderBy("ordinal").collect()] == [0, 1, 3, 4]
    a, b = (sel.hashed_sample(df.repartition(n), "ordinal", 5, 7).orderBy("sample_index").collect() for n in (1, 4))
    assert [r.ordinal for r in a] == [r.ordinal for r in b] and [r.sample_index for r in a] == list(range(5)) and sel.hashed_sample(df, "ordinal", 0, 7).count() == 12
    tasks, audit = sel.task_and_audit(df, F.expr("ordinal % 5 = 1"))
    assert [(r.ordinal, r.task_index) for r in tasks.collect()] == [(1, 0), (6, 1), (11, 2)] and audit.count() == 12
    cache = spark.createDataFrame([("s", " s ", [1.0, 0.0]), ("s", "t", [1.0, 0.0]), ("s", "s", [0.0, 0.0]), ("s", "s", [float("nan"), 1.0]), ("s", None, None)], "summary string, cached_summary string, vector array<double>")
    assert [r.current for r in sel.current_cache(cache, 2).collect()] == [True, False, False, False, False]
    over = sel.overlay(spark.createDataFrame([("d", "x", "y")], "k string, p string, q string"), spark.createDataFrame([("d", None, "z")], "k string, p string, q string"), "k")
    assert [tuple(r) for r in over.collect()] == [("d", "x", "z")]


def test_paths_and_values(spark):
    from tallyframe.sources.readers import parse_choices

    df = spark.createDataFrame([([("u1", ["i", None]), (None, ["j"])],)], "turns array<struct<utterance:string, acts:array<string>>>")
    assert df.select(text.path_value("turns[].utterance"), text.path_value("turns.acts", 1)).collect()[0][:] == (["u1"], ["i", "j"])
    assert one(spark, text.prompt_value(F.array(F.lit("a"), lit(None), F.lit("b")), "array<string>"), text.prompt_value(lit(None), "string"), text.prompt_value(F.struct(F.lit(1).alias("x")), "struct<x:int>")) == ["a\nb", "", '{"x":1}']
    assert one(spark, text.tagged_prompt(lit("Q \n"), ["a", "b"]))[0] == text.CONTRACT_HEAD + 'Choose exactly one of these answers: "a", "b".\n' + text.CONTRACT_FORM + "Input:\nQ" + text.CONTRACT_END and parse_choices("['x', 1]") == ["x", "1"] and parse_choices('{"text": ["t"]}') == ["t"] and parse_choices("no") is None


def test_planning_tables(spark):
    from tallyframe.operators import planning as pl

    kinds = [("x-gguf", "auto", "", [], False, False, False, "gguf"), ("m", "gguf", "", [], False, False, False, "gguf"), ("m", "auto", "voxtral", [], False, False, False, "voxtral"), ("m", "auto", "z", ["XChatModel"], True, True, False, "vlm_chat"),
             ("m", "auto", "llava", ["LlavaForConditionalGeneration"], True, True, False, "vlm_processor"), ("m", "causal_lm", "clip", ["CLIPModel"], False, False, False, "causal_lm"), ("m", "auto", "clip", [], False, False, False, "zero_shot_image"),
             ("sentence-t5-x", "auto", "t5", ["T5ForSequenceClassification"], False, False, True, "sentence_encoder"), ("m", "auto", "t5", ["T5Model"], False, False, True, "seq2seq_lm"), ("m", "auto", "gpt", [], False, False, False, "causal_lm")]
    df = spark.createDataFrame(kinds, "name string, explicit string, config string, architectures array<string>, vision boolean, text_part boolean, encoder_decoder boolean, want string")
    assert all(r[0] == r.want for r in df.select(pl.loaded_model_type().alias("kind"), "want").collect())
    p = lambda t, k, n: pl.default_protocol(F.lit(t), F.lit(k), F.lit(n))
    assert one(spark, p("qa", "extractive_qa", False), p("x", "extractive_qa", True), p("multiple_choice", "causal_lm", False), p("multilabel_classification", "causal_lm", True), p("x", "masked_lm", False), p("x", "sequence_classifier", True), p("x", "causal_lm", True), p("x", "gguf", False)) == [
        "extractive_qa", "unsupported", "tagged_multiple_choice_accuracy", "tagged_set_generation", "unsupported", "unsupported", "tagged_label_generation_accuracy", "tagged_answer_exact_match"]
    m = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    cols = lambda *c: F.array(*[F.lit(x) for x in c])
    t = lambda task, lm, c: pl.refined_task(F.lit(task), lm, c, F.lit("image"), F.lit("choices"))
    assert one(spark, t("generation", m("0", "False", "1", "true"), cols("passage", "question")), t("generation", m("0", "a", "1", "b"), cols("text")), t("generation", m("0", "a", "1", "b"), cols("image")), t("qa", m("0", "a", "1", "b"), cols("text"))) == ["boolean_qa", "classification", "generation", "qa"]
    assert len(one(spark, pl.next_steps(cols("invalid_outputs", "weak_target_label"), F.lit("boolean_qa")))[0]) == 3 and len(one(spark, pl.next_steps(cols("none"), F.lit("qa")))[0]) == 1
    rows = [("k", False, "", "causal_lm", True, "", [], [], "missing_plan"), ("k", True, "Gated repo x", "causal_lm", True, "", [], [], "gated_or_inaccessible_model"), ("k", True, None, "causal_lm", False, "", [], [], "known_dataset_contract"), ("d", True, "", "causal_lm", False, "", [], [], "no_validated_gold_contract"),
            ("q", True, "", "extractive_qa", True, "", [], [], "extractive_qa_adapter"), ("v", True, "", "vlm_chat", True, "", [], [], "standard_vlm_adapter"), ("d", True, "", "sequence_classifier", True, "multilabel_classification", ["entailment"], [], "zero_shot_nli_multilabel_adapter"),
            ("d", True, "", "causal_lm", True, "", [], ["GptForCausalLM"], "causal_architecture_routing"), ("d", True, "", "causal_lm", True, "", [], [], "still_incompatible")]
    df = spark.createDataFrame(rows, "dataset string, has_plan boolean, notes string, kind string, has_gold boolean, task string, labels array<string>, architectures array<string>, want string")
    got = pl.unsupported_recovery(df, ("k",), ("q",), ("v",)).collect()
    assert all(r.recovery_reason == r.want for r in got) and sum(r.selected for r in got) == 5


def test_answer_windows_and_offsets(spark):
    from tallyframe.operators import sequences as sq

    w = [(1, 0, [5.0, 1.0, 3.0], [1.0, 0.0, 2.0]), (1, 1, [0.0, 9.0, 0.0], [0.0, 0.0, 1.0]), (2, 0, [9.0, 0.0], [9.0, 0.0])]
    got = {r.k: r for r in sq.answer_or_null(spark.createDataFrame(w, "k int, window int, start array<double>, end array<double>"), "k").collect()}
    assert tuple(got[1])[1:] == (10.0, 6.0, 1, 1, 2) and got[2].window is None and got[2].span_score == got[2].null_score == 18.0
    found = one(spark, sq.piece_offsets(lit("The cat, the dog"), F.array(*map(F.lit, [" the", "CAT", "", "bird", "the", "g"]))))[0]
    assert [tuple(x) for x in found] == [(0, 3), (4, 7), (0, 0), (0, 0), (9, 12), (15, 16)]


def test_option_scores(spark):
    rows = [(1, 0, "a", 2, [[9.0, 0.0], [0.0, 1.0], [1.0, 0.0]], [1]), (1, 1, "b", 2, [[9.0, 0.0], [0.0, 1.0], [1.0, 0.0]], [1, 0]), (1, 2, "c", 2, [[0.0, 0.0]], []), (2, 0, "x", 1, [[0.0, 0.0]], [0]), (2, 1, "y", 1, [[0.0, 0.0]], [1])]
    df = spark.createDataFrame(rows, "key int, ordinal int, label string, prompt_length int, logits array<array<double>>, ids array<int>")
    lp = -math.log(1 + math.exp(-1))
    for mean, want in ((False, "a"), (True, "a")):
        got = {r.key: r for r in scoring.option_scores(df, "key", mean).collect()}
        assert (got[1].prediction, got[2].prediction, got[1].options) == (want, "x", 3) and got[1].score == pytest.approx(lp) and got[2].score == pytest.approx(math.log(0.5))
    score = df.where("label = 'b'").select(scoring.sequence_logprob(F.col("logits"), F.col("ids"), 1)).collect()[0][0]
    assert score == pytest.approx(2 * lp)


def test_resize():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (5, 9, 3)).astype(np.uint8)
    assert (scoring.resized(np.full((7, 3, 3), 200, np.uint8), 4) == 200).all() and scoring.resized(x, 6).shape == (6, 6, 3)
    assert (scoring.resized(x[:5, :5], 5) == x[:5, :5]).all()
    ramp = np.tile(np.arange(0, 160, 10, dtype=np.uint8)[None, :, None], (16, 1, 3))
    assert (np.diff(scoring.resized(ramp, 8)[0, :, 0].astype(int)) > 0).all()


def test_vertices_are_checked(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "id long, v array<double>")
    assert sorted(scoring.append_vertex(df, df.where("id = 1"), "v", "id").collect())[-1] == (2, [3.0, 4.0])
    for bad, new in ((df.selectExpr("id * 2 as id", "v"), df), (df, df.selectExpr("id", "slice(v, 1, 1) as v"))):
        with pytest.raises(Exception, match="aligned|dimension"):
            scoring.append_vertex(bad, new, "v", "id").collect()


@pytest.mark.parametrize("x", [0.0, -0.0, 1.0, -2.5, 123456789.0, 1234567890.0, 0.0001, 0.00001234567891, 1 / 3, 1e22, 1.5e-300, 99999999.95, 100.0, 0.1 + 0.2])
def test_score_text(spark, x):
    assert one(spark, text.score_text(F.lit(x))) == ["%.9g" % x]


def test_configs():
    import json

    from tallyframe.operators.contracts import rewritten_config

    deep = {"a": [{"b": {"use_cache": None, "c": [None, {"use_cache": None}]}}], "rope_type": "r", "architectures": ["TinyBertX"]}
    got = json.loads(rewritten_config(json.dumps(deep)))
    assert got == {"a": [{"b": {"use_cache": True, "c": [None, {"use_cache": True}]}}], "rope_type": "r", "type": "r", "model_type": "bert", "architectures": ["TinyBertX"]}
    assert json.loads(rewritten_config('{"use_cache": null, "rope_type": "x"}', False)) == {"use_cache": True, "rope_type": "x"} and rewritten_config("no") is None and rewritten_config(None) is None


def test_providers():
    asked = []

    def provider(request):
        asked.append(request)
        if len(asked) == 1:
            raise OSError("down")
        return {"request_checksum": request["checksum"] if len(asked) > 2 else "other", "candidates": []}

    got = loop.call_provider(provider, {"round": 1})
    assert len(asked) == 3 and got["request_checksum"] == loop.checksum({"round": 1}) and "OSError: down" in asked[1]["previous_error"] and "another request" in asked[2]["previous_error"]
    with pytest.raises(RuntimeError, match="2 attempts"):
        loop.call_provider(lambda r: {}, {}, 1)
