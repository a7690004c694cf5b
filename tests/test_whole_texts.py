"""Steps that whole texts go through: each is done once for a row, and as for short ones."""

from collections import Counter

from pyspark.sql import functions as F

from tallyframe.functions import metrics, text
from tallyframe.operators import text_metrics
from tallyframe.plans import cycles

TEXTS = [None, "", "the", " a b  b\n", "x\x1cy x\x1cy", "b b b a-b", "é É é", "w " * 3000 + "v", "v " * 5 + "w " * 2500]


def test_the_overlap_is_made_once(spark):
    df = spark.createDataFrame([("x y", "y")], "prediction string, reference string")
    plan = text_metrics.score_rows(df, "qa_f1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and "array_sort" not in plan


def test_texts_are_normalised_before_they_meet(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(3, "b"), (9, "z"), (None, "z")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    df = cycles.qa_f1_documents(spark, str(tmp_path))
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, x in enumerate(lines) if "Join" in x)
    assert [i > join for i, x in enumerate(lines) if "regexp_replace" in x] == [True, True]
    pairs = spark.sql(cycles.TEXT_PAIRS, documents=docs)
    want = text_metrics.score_rows(pairs, "qa_f1").select("pair_id", F.round("score", 9).alias("score"))
    key = lambda rows: sorted(map(tuple, rows))
    assert key(df.collect()) == key(want.collect()) and df.schema == want.schema


def test_counts_of_texts(spark):
    pairs = [(a, b) for a in TEXTS for b in TEXTS]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    n = lambda c: text.normalize_answer(F.col(c))
    rows = df.select("i", text.tokens(F.col("a")).alias("p"), text.tokens(F.col("b")).alias("r"), text_metrics.token_f1_texts(n("a"), n("b")).alias("s"), metrics.metric("qa_f1", F.col("a"), F.col("b")).alias("t"))
    for x in rows.collect():
        o = sum((Counter(x.p) & Counter(x.r)).values())
        assert text_metrics.token_counts(" ".join(x.p), " ".join(x.r)) == (o, len(x.p), len(x.r))
        assert x.s == x.t, x.i
