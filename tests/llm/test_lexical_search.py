"""Lexical search: a plain scorer, and the SQL."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tallyframe.llm import lexical_search as ls


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, k=10):
    rows = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(rows), sum(sum(c.values()) for _, c in rows)
    out = []
    for item, text in items:
        score = Counter()
        for w in set(terms(text)):
            df = sum(w in c for _, c in rows)
            weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
            for j, (_, c) in enumerate(rows):
                if w in c:
                    m = 10 + 90 * sum(c.values()) * n // total
                    score[j] += weight * (10**9 * c[w] // (1000 * c[w] + 8 * m))
        best = sorted(((-s, rows[j][0] is not None, rows[j][0] or 0) for j, s in score.items() if s > 0))[:k]
        out += [(item, r + 1, i if real else None, -s) for r, (s, real, i) in enumerate(best)]
    return sorted(out, key=str)


def result(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in df.collect()], key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "item_id long, text string, q string, score int")


ITEMS = [(1, "the QUICK brown fox"), (2, "lazy dog dog dog"), (3, None), (4, ""), (5, "nowhere"), (6, "w7 w29999 seven"), (7, "é ß ．"), (8, "the"), (2, "quick")]


@pytest.mark.parametrize("block", [5000, 2])
def test_against_plain(spark, make, awkward, monkeypatch, block):
    monkeypatch.setattr(ls, "BLOCK_QUERIES", block)
    monkeypatch.setattr(ls, "WINDOW", 4)
    monkeypatch.setattr(ls, "PLACES", 3)
    docs = awkward + [(i % 40, f"the fox number {i % 7} saw {'dog ' * (i % 5)}") for i in range(120)] + [(17, "same words the dog")] * 15 + [(-(1 << 62), "the dog"), (1 << 62, "the dog")]
    assert result(ls.search(make(docs, extra=True), items_of(spark, ITEMS))) == plain(docs, ITEMS)


def test_none(spark, make):
    assert ls.search(make([]), items_of(spark, ITEMS)).collect() == []
    assert ls.search(make([(1, "the")]), items_of(spark, [])).collect() == []
    assert ls.search(make([(1, None), (2, "- -")]), items_of(spark, ITEMS)).collect() == []


def test_long_products():
    """m where 90 * n * N passes 64 bits."""
    s = ls.WindowScorer([[0]], np.array([1]), 1 << 40, 1 << 50, 1)
    assert s._norms(np.array([1 << 30])).tolist() == [8 * (10 + 90 * (1 << 30) * (1 << 40) // (1 << 50))]


def test_query_against_sql(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert result(ls.QUERIES["op13_lexical_search"](spark, sf)) == sorted(con.execute(ls.SQL["op13_lexical_search"]).fetchall(), key=str)
