"""Mixing: the fit against numpy, targets, and the copies."""

import numpy as np
import pytest

from tallyframe.llm import mixing

LABELS = "doc_id long, quality int, toxic int"


def model_docs(spark, make, n=60):
    langs = ["en", "fr"]
    rows = [(i, " ".join(f"{langs[i % 2]}{(i * 7 + k) % 11}" for k in range(10 + i % 13)) + (" shared words" if i % 5 == 0 else "")) for i in range(n)]
    docs = make(rows).selectExpr("doc_id", "text", "case when doc_id % 2 = 0 then 'en' else 'fr' end as lang", "source", "n_chars")
    return rows, docs, spark.createDataFrame([(i, 1 if i % 9 else 0, 0) for i in range(n)], LABELS)


def test_posteriors_against_brute_force(spark, make):
    rows, docs, labels = model_docs(spark, make)
    domains, table, priors = mixing.fit(mixing.labelled_documents(docs, labels))
    assert domains == ["en", "fr", "poor"]
    logs = np.zeros((mixing.BUCKETS, len(domains)))
    for r in table.collect():
        logs[r.bucket] = r[1:]
    assert np.allclose(np.exp(logs).sum(0), 1)
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in {w for _, t in rows for w in t.split()}], "w string").selectExpr("w", f"pmod(xxhash64(w), {mixing.BUCKETS}) as b").collect()}
    got = {r.doc_id: r for r in mixing.posteriors(docs, (domains, table, priors)).collect()}
    for i, t in rows:
        w = t.split()
        e = np.array(priors) + logs[[bucket[x] for x in w]].sum(0) * min(len(w), mixing.EVIDENCE) / len(w)
        p = np.exp(e - e.max())
        assert got[i].tokens == len(w) and np.allclose([got[i][f"p{k}"] for k in range(3)], p / p.sum())


@pytest.mark.parametrize("goal", [None, {"en": 1100.0, "fr": 500.0}, {"en": 0.0, "fr": 900.0}])
def test_rates_against_projected_gradient(spark, goal):
    rng = np.random.default_rng(2)
    p, t = rng.dirichlet([0.3, 0.3], 80), rng.integers(0, 40, 80)
    df = spark.createDataFrame([(i, int(t[i]), float(p[i, 0]), float(p[i, 1])) for i in range(80)], "doc_id long, tokens long, p0 double, p1 double")
    got = {r.doc_id: r.rate for r in mixing.fit_rates(df, ["en", "fr"], goal).collect()}
    total = (p * t[:, None]).sum(0)
    want = np.array([goal[d] for d in ("en", "fr")]) if goal else np.array(mixing.default_targets(["en", "fr"], total.tolist()))
    x = np.ones(80)
    for _ in range(mixing.ITERATIONS):
        now = (x * t) @ p
        if (abs(now - want) <= mixing.TOLERANCE * np.maximum(want, total)).all():
            break
        x = np.maximum(0, x - p @ ((now - want) / total))
    assert np.allclose([got[i] for i in range(80)], x, atol=2e-6) and min(got.values()) >= 0
    if not (goal and goal["en"] == 0):
        assert np.allclose((x * t) @ p, want, rtol=1e-3)


def test_default_targets_shrink_no_language():
    assert mixing.default_targets(["en", "fr", "poor"], [900.0, 90.0, 10.0])[0] == pytest.approx(900) and mixing.default_targets(["en", "fr", "poor"], [900.0, 90.0, 10.0])[1] > 90
    assert mixing.default_targets(["en"], [0.0]) == [0.0]


def test_copies_follow_rates(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "1.3D as rate").select(mixing.copies(mixing.F.col("rate"), mixing.F.col("doc_id")).alias("c"))
    n = {r.c: r.n for r in df.groupBy("c").count().withColumnRenamed("count", "n").collect()}
    assert set(n) == {1, 2} and n[2] == pytest.approx(6000, rel=0.05)


def test_awkward(spark, make, awkward):
    docs = make(awkward, extra=True)
    labels = spark.createDataFrame([(1, 1, None), (6, 0, 0), (None, 1, 0), (9, None, 0), (77, 1, 0)], LABELS)
    got = mixing.rates(docs, labels).collect()
    assert sorted({r.doc_id for r in got if r.doc_id is not None}) == sorted({i for i, _ in awkward if i is not None}) and len(got) == len({i for i, _ in awkward})
    assert all(r.rate >= 0 and r.copies >= 0 and r.domain in ("en", "poor") for r in got)
    out = mixing.mixed(docs, labels)
    assert out.columns == docs.columns
    n = {r.doc_id: r.copies for r in got}
    assert out.count() == sum(n[i] for i, _ in awkward)


def test_no_labels_no_documents(spark, make):
    none = spark.createDataFrame([], LABELS)
    assert {(r.domain, r.rate, r.copies) for r in mixing.rates(make([(1, "a b"), (2, None)]), none).collect()} == {("all", 1.0, 1)}
    assert mixing.rates(make([]), none).collect() == [] and mixing.mixed(make([]), none).collect() == []


def test_native(spark, make):
    rows, docs, labels = model_docs(spark, make, 20)
    plan = mixing.mixed(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_query(spark):
    rows = mixing.op3_soft_mixing(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs)
    named = [r for r in rows if r.domain != "poor"]
    assert sum(docs[r.doc_id] == r.domain for r in named) > 0.9 * len(named)


def test_clashing_columns_and_repeated_rows(spark, make):
    _, docs, labels = model_docs(spark, make)
    docs = docs.union(docs.limit(1)).selectExpr("*", "1 as _mix_id", "2 as _mix_copies", "3 as _mix_copy", "4 as copies", "5 as rate", "6 as id", "7 as row")
    got = mixing.mixed(docs, labels)
    assert got.columns == docs.columns and got.count() > 0 and {(r._mix_id, r.row) for r in got.collect()} == {(1, 7)}


def test_missed_targets_warn(spark):
    p = spark.createDataFrame([(1, 10, 0.5, 0.5)], "doc_id long, tokens long, p0 double, p1 double")
    with pytest.warns(UserWarning, match="off their targets"):
        mixing.fit_rates(p, ["a", "b"], {"a": 100.0, "b": 1.0})
