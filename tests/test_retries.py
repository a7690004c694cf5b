"""Hand-overs that are topped up, and feedback."""

import pytest

from tallyframe.operators import joins, loop, selection


def provider_of(answers):
    calls = []

    def provider(request):
        calls.append(request)
        answer = answers[min(len(calls), len(answers)) - 1]
        if isinstance(answer, Exception):
            raise answer
        return {"request_checksum": request["checksum"], "candidates": [{"model": m} for m in answer]}

    return provider, calls


def test_topped_up():
    provider, calls = provider_of([["a", "A", "seen"], ["b", "a"], ["c", "d"]])
    got, reason = loop.retrieve_with_retries(provider, {"x": 1, "seen_models": ["Seen"]}, {"SEEN"}, 3)
    assert reason == "provider" and [(c["model"], c["rank"]) for c in got["candidates"]] == [("a", 1), ("b", 2), ("c", 3)] and got["provider_attempt_count"] == 3
    assert calls[1]["seen_models"] == ["Seen", "a"] and calls[2]["retrieval_retry"]["previous_rejections"][0]["detail"] == "Collected 1 of 3 requested candidates."
    assert got["provider_input_checksum"] == loop.checksum({"x": 1, "seen_models": ["Seen"]})


def test_too_few_and_none():
    assert [c["model"] for c in loop.retrieve_with_retries(provider_of([["a"]])[0], {}, set(), 5, 1)[0]["candidates"]] == ["a"]
    assert loop.retrieve_with_retries(provider_of([["a"]])[0], {}, {"a"}, 1) == (None, "no_new_candidates")
    assert loop.retrieve_with_retries(provider_of([[]])[0], {}, set(), 1) == (None, "no_valid_candidates")
    got, _ = loop.retrieve_with_retries(provider_of([ValueError("down"), ["a"]])[0], {}, set(), 1)
    assert got["candidates"][0]["model"] == "a" and got["retrieval_rejections"][0]["reason"] == "provider_error"
    with pytest.raises(RuntimeError, match="down"):
        loop.retrieve_with_retries(provider_of([ValueError("down")])[0], {}, set(), 1)


def test_feedback_without_success(spark):
    rows = [("d", 1, "m", 0, "failed", None, 0, "accuracy", "p"), ("d", 1, "m", 1, "ok", 0.25, 3, "accuracy", "p"), ("d", 1, "n", 2, "ok", 0.25, 3, "macro_f1", "p"), ("e", 2, "q", 3, "failed", None, 0, None, None)]
    df = spark.createDataFrame(rows, "dataset string, round int, model string, ordinal int, status string, score double, labeled_total int, metric string, evaluation_protocol string")
    got = {r.dataset: r for r in loop.feedback(df).collect()}
    assert (got["d"].best_model, got["d"].baseline_models, got["d"].candidate_exclusions) == ("m", ["m"], ["m", "n"])
    assert got["d"].observations == ["Best comparable model in this round was m with score 0.2500.", "Exclude n: expected accuracy/p, got macro_f1/p."]
    assert got["e"].best_model is None and got["e"].observations == [] and got["e"].candidate_exclusions == ["q"]


def test_names(spark):
    logs = spark.createDataFrame([(1, "org_a_b_smoke.stderr.txt"), (1, "x_y_full.stderr.txt"), (2, "org_a_b_full.stderr.txt")], "run int, name string")
    found = joins.models_of_logs(logs, spark.createDataFrame([(1, "org/a_b"), (1, None)], "run int, model string"))
    assert sorted((r.run, r.model) for r in found.collect()) == [(1, "org/a_b"), (1, "x/y"), (2, "org/a_b")]
    rows = spark.createDataFrame([("d", None, "", "m", "failure", 0), ("d", "ok", "x", None, "failure", 1), (None, None, "x", None, "failure", 2)], "dataset string, status string, model_name string, model string, outcome string, ordinal int")
    assert [(r.dataset, r.models) for r in selection.failed_models(rows).collect()] == [("d", ["m", "x"])]
