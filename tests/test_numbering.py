"""Dense numbers against a sort, without a window over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import selection
from tallyframe.operators.numbering import numbered


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_over_all_rows(spark, n):
    rows = [(i, random.Random(i).random(), "clash") for i in range(n)]
    df = spark.createDataFrame(rows, "i long, x double, _n string").repartition(7)
    got = numbered(df, ["x"], "place")
    assert got.columns == ["i", "x", "_n", "place"]
    assert [r.i for r in sorted(got.collect(), key=lambda r: r.place)] == [r[0] for r in sorted(rows, key=lambda r: r[1])]
    assert sorted(r.place for r in got.collect()) == list(range(n))


def test_within_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), i) for i in range(900)]
    got = numbered(spark.createDataFrame(rows, "g string, i long").repartition(5), ["i"], "place", ("g",)).collect()
    want = {}
    for g, i in sorted(rows, key=lambda r: r[1]):
        want[i] = sum(1 for h, j in rows if h == g and j < i)
    assert {r.i: r.place for r in got} == want


def test_descending_and_plan(spark):
    df = spark.range(50)
    got = numbered(df, [F.desc("id")], "place")
    assert [r.id for r in sorted(got.collect(), key=lambda r: r.place)] == list(range(49, -1, -1))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_candidates_up_to_the_limit(spark):
    """The record that fills the limit is the last one looked at."""
    rows = [(i, f"m{i % 6}", i % 4 == 1) for i in range(12)]
    df = spark.createDataFrame(rows, "ordinal long, model_name string, gated boolean").selectExpr("*", "'' as model", "cast(null as long) as rank", "0.5d as score", "0.1d as link_probability", "'' as access_status")
    none = spark.createDataFrame([("m2",)], "model string")
    for limit in (0, 1, 2, 50):
        taken, want, seen = 0, [], set()
        for i, m, gated in rows:
            if taken == limit:
                break
            reason = "gated_model" if gated else "already_evaluated_or_excluded" if m == "m2" else "duplicate_model" if m in seen else None
            if reason is None:
                seen.add(m)
                taken += 1
            want.append((i, reason))
        assert sorted((r.ordinal, r.reason) for r in selection.convert_candidates(df, none, limit).collect()) == want
