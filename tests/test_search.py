"""Top-k search against all products, offsets and entities against the plain walks."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import search, sequences


def vectors(n, clusters, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, 8)) * 5
    x = middle[rng.integers(clusters, size=n)] + rng.normal(size=(n, 8)) * 0.1
    x[:: max(1, n // 7)] = x[0]  # ties
    return x


def plain(x, q, k):
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-8)
    s = np.round(unit(x[q]) @ unit(x).T, search.PLACES)
    return {i: sorted((-s[j, m], m) for m in range(len(x)))[:k] for j, i in enumerate(q)}


@pytest.mark.parametrize(("n", "clusters", "block"), [(600, 12, 16 << 20), (600, 1, 200), (3, 2, 16 << 20)])
def test_top_rows(spark, n, clusters, block):
    x = vectors(n, clusters)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(5)
    q = list(range(0, n, 37))
    got = search.top_rows(rows, rows.where(F.col("id") % 37 == 0), 10, block).collect()
    want = plain(x, q, 10)
    assert len(got) == len(q) * min(10, n)
    for r in got:
        assert want[r.query_id][r.rank - 1] == pytest.approx((-r.score, r.id))


def test_balls_out_of_reach_are_skipped():
    x = vectors(4000, 8)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = search.BestRows(u[:1], 10)
    near = np.argsort(-(u @ u[0]))
    for at in np.array_split(near, 40):
        best.add(at, u[at])
    assert best.skipped > 10
    assert best.score[0].tolist() == np.sort(np.round(u @ u[0], search.PLACES))[::-1][:10].tolist()


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, x array<double>")
    assert search.top_rows(none, none, 3).collect() == []


def test_piece_offsets(spark):
    long = "word and more " * 70000
    rows = [("Groß STRASSE x", ["gross", "straße", "", None, "x", "y"]), ("abab", ["b", "a", "b", "b"]), (None, ["a"]), ("a", None), (long, long.split())]
    got = [r.o for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, p array<string>").orderBy("i").select(sequences.piece_offsets("t", "p").alias("o")).collect()]
    assert [tuple(x) for x in got[0]] == [(0, 5), (6, 12), (0, 0), (0, 0), (14, 15), (0, 0)]
    assert [tuple(x) for x in got[1]] == [(1, 2), (2, 3), (3, 4), (0, 0)]
    assert got[2] is None and got[3] is None
    assert [tuple(x) for x in got[4]] == [m.span() for m in re.finditer(r"\S+", long)]


def test_entities_by_offsets(spark):
    text = "Alpha Beta, the gamma  delta ALPHA beta."
    words = [m.span() for m in re.finditer(r"\w+", text)]
    labels = ["B-chem", "I-chem", "O", "loc", "I-loc", "B-chemical", "i-CHEM"]
    rows = [(1, 0, i, lab, s, e) for i, (lab, (s, e)) in enumerate(zip(labels, words, strict=True))] + [(1, 1, 0, "B-chem", *words[5]), (1, 1, 1, "I-chem", 5, 5), (1, 1, 2, "I-chem", *words[6]), (1, 1, 3, "I-x/y", *words[0])]
    tokens = spark.createDataFrame(rows, "seq int, window int, pos int, label string, start int, end int")
    got = sequences.bio_entities(tokens, spark.createDataFrame([(1, text)], "seq int, text string")).collect()
    assert sorted((r.type, r.start, r.end, r.text, r.first_window) for r in got) == [("chemical", 29, 39, "ALPHA beta", 0), ("loc", 16, 28, "gamma  delta", 0), ("x y", 0, 5, "Alpha", 1)]
