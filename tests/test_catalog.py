"""Every query against its oracle SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tallyframe.plans import catalog
from tallyframe.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = df.collect()
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = found.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    assert sorted(tuple(cell(r[c]) for c in order) for r in got) == sorted(tuple(cell(r[names.index(c)]) for c in order) for r in want)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"rouge_l_documents"}


def test_rouge_of_documents(spark):
    """Against the table of cells, for the pairs of short texts."""
    from test_semantics import plain_normal

    from tallyframe.plans.cycles import TEXT_PAIRS, derived

    pairs = {r.pair_id: r for r in derived(spark, SF, TEXT_PAIRS, "documents").collect()}
    got = {r.pair_id: r.score for r in catalog.queries()["rouge_l_documents"](spark, SF).collect()}
    assert got.keys() == pairs.keys()
    for i, r in pairs.items():
        a, b = plain_normal(r.prediction).split(), plain_normal(r.reference).split()
        if len(a) * len(b) > 60_000:
            continue
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for y in range(len(b)):
                new.append(row[y] + 1 if x == b[y] else max(row[y + 1], new[y]))
            row = new
        o = row[-1]
        want = float(a == b) if not a or not b else 2 * (o / len(a)) * (o / len(b)) / (o / len(a) + o / len(b)) if o else 0.0
        assert got[i] == pytest.approx(want, abs=1e-8), i


@pytest.mark.parametrize("name", ["rank_models", "macro_f1", "qa_f1", "exact_numbers", "tagged_answer", "method_pools", "span_search", "bio_decode"])
def test_native_plan(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "CartesianProduct"))
