"""Quality cascade: statistics against a plain count, the SQL, and the order of rules."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import quality_rules as qr

SPACE = r"[\x20\x09-\x0D]+"


def plain(t):
    t = t or ""
    w = [x for x in re.split(SPACE, t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    n, chars = len(w), sum(map(len, w))
    symbols = len(re.findall(r"[#*$%&|<>]", t))
    dup = len(lines) - len(set(lines))
    base = n < 20 or 100 * len(covered) > 30 * n
    junk = 4 * symbols > n or 100 * len(re.findall("[A-ZÀ-Þ]", t)) > 40 * chars or 2 * dup > len(lines) or chars > 20 * n
    return (n, chars, symbols, dup, len(covered), base, not base and not junk)


EXTRA = [
    (20, "a b c d e f g h " * 9), (21, " ".join(f"u{i}" for i in range(40)) + " " + " ".join(f"u{i}" for i in range(9))), (22, "\n".join(["same line of words here"] * 30 + [f"other {i}" for i in range(9)])),
    (23, " ".join(f"w{i}$$$" for i in range(60))), (24, " ".join(f"WORD{chr(65 + i)}" for i in range(25))), (25, "é" * 30 + " " + " ".join(f"n{i}" for i in range(30))),
]


def test_statistics(make, awkward):
    rows = awkward + EXTRA
    got = sorted([tuple(r) for r in qr.quality(make(rows, extra=True)).collect()], key=str)
    assert got == sorted([(i, *plain(t)) for i, t in rows], key=str)


def test_keep_good_keeps_what_quality_keeps(make, awkward):
    rows = awkward + EXTRA
    df = make(rows, extra=True)
    kept = qr.keep_good(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted((str(i), t) for i, t in rows if plain(t)[-1])


def test_empty(make):
    assert qr.quality(make([])).collect() == [] and qr.keep_good(make([])).collect() == []


def test_order_is_rejection_per_cost(make):
    rules = [qr.Rule("never", F.lit(False)), qr.Rule("half", F.expr("_n_words < 3"))]
    df = make([(i, "a b c" if i % 2 else "a") for i in range(60)]).withColumn("_t", F.col("text"))
    assert [r.name for r in qr.measured(df, rules)] == ["half", "never"]
    by = qr.cascade(make([(1, "a")]), [qr.Rule("x", F.lit(True)), qr.Rule("y", F.raise_error(F.lit("a row already rejected was judged")).isNotNull())][:1]).collect()
    assert by[0]._rejected_by == "x"


def test_native(make):
    plan = qr.keep_good(make(EXTRA))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    got = qr.op7_quality_rules(spark, f"/root/testdata/{sf}")
    cur = con.execute(qr.SQL["op7_quality_rules"])
    names = [d[0] for d in cur.description]
    assert names == got.columns
    assert sorted(cur.fetchall()) == sorted(tuple(r) for r in got.collect())


def test_labelled_good_is_kept(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    both = qr.op7_quality_rules(spark, sf).join(labels, "doc_id").where("not base_failed")
    good, bad = both.where("quality = 1"), both.where("quality = 0")
    assert good.where("not kept").count() == 0 and bad.where("kept").count() <= 0.05 * bad.count()
