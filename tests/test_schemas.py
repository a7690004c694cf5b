"""Compiled contracts: the first error and its path."""

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import schemas as S
from tallyframe.operators import contracts

SCHEMA = S.Record(
    {"a": S.Text(one_of=("x", "y")), "n": S.Number(low=0, high=1), "l": S.Items(S.Record({"id": S.Number(whole=True)}), 1, ("id",))}, {"m": S.Map(S.Text()), "o": S.Optional(S.Flag())},
    rules=(("a and m clash", lambda get: (get("a") == "y") & get("m").isNotNull()),),
)
GOOD = {"a": "x", "n": 0.5, "l": [{"id": 1}, {"id": 2}]}


@pytest.mark.parametrize(("change", "want"), [
    ({}, ""), ({"a": "z"}, "$.a: not one of 'x', 'y'"), ({"a": 1}, "$.a: not a text"), ({"n": True}, "$.n: not a number"), ({"n": 2}, "$.n: more than 1"), ({"n": -1e-9}, "$.n: less than 0"), ({"n": None}, "$.n: not a number"), ({"l": {}}, "$.l: not an array"), ({"l": []}, "$.l: fewer than 1"),
    ({"l": [{"id": 1}, {"id": 1.5}]}, "$.l[1].id: not a whole number"), ({"l": [{"id": 1}, {"id": 1}]}, "$.l: repeated id"), ({"l": [{"id": 1}, 5]}, "$.l[1]: not an object"), ({"l": [{"id": 1, "z": 0}]}, "$.l[0]: unknown z"), ({"m": {"k": "v", "j": 2}}, "$.m.j: not a text"), ({"m": []}, "$.m: not an object"),
    ({"o": None}, ""), ({"o": False}, ""), ({"o": 0}, "$.o: not a truth value"), ({"z": 1, "b": 2}, "$: unknown b, z"), ({"a": "y"}, ""), ({"a": "y", "m": {}}, "$: a and m clash"),
])
def test_first_error(spark, change, want):
    df = spark.createDataFrame([(json.dumps(GOOD | change),)], "j string")
    assert df.select(S.first_error(F.col("j"), SCHEMA).alias("e")).first().e == want


@pytest.mark.parametrize(("text", "want"), [(None, "$: not JSON"), ("", "$: not JSON"), ("{", "$: not JSON"), ("[]", "$: not an object"), ("null", "$: not an object"), ("{}", "$: missing a, l, n")])
def test_no_document(spark, text, want):
    df = spark.createDataFrame([(text,)], "j string")
    assert df.select(S.first_error(F.col("j"), SCHEMA).alias("e")).first().e == want


def test_review_as_before(spark):
    """The compiled review contract rejects what the plain one rejects."""
    base = {"required": True, "consensus": False, "decision": "stop", "orchestrator": {"decision": "continue", "confidence": 1, "reasoning": "r"}}
    base |= {k: {"improvement_probable": True, "confidence": 0.5, "reasoning": "r"} for k in ("retrieval", "critic")}
    cases = [base, base | {"decision": "go"}, base | {"required": 1}, base | {"critic": {}}, base | {"critic": base["critic"] | {"confidence": True}}, base | {"retrieval": base["retrieval"] | {"reasoning": " "}}, {k: v for k, v in base.items() if k != "consensus"}]
    df = spark.createDataFrame([(json.dumps(c),) for c in cases], "j string")
    for r in df.select(contracts.review_error(F.col("j")).alias("a"), S.first_error(F.col("j"), contracts.REVIEW).alias("b")).collect():
        assert (r.a == "") == (r.b == ""), r
