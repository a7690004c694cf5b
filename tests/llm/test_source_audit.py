"""Divergence of sources: the SQL, and a plain count for cases that the tables lack."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tallyframe.llm import source_audit as sa

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def plain(rows, top=200):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(x or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))) for x, s, t in rows]
    df = Counter((x, w) for x, _, ts in docs for w in set(ts))
    kept = defaultdict(list)
    for (x, w), n in df.items():
        if n >= 3:
            kept[x].append(w)
    count = defaultdict(Counter)
    for x, s, ts in docs:
        count[x, s].update(w for w in ts if df[x, w] >= 3)
    out = []
    for lang in {x for x, *_ in docs}:
        words, sources = kept[lang], sorted({s for x, s, _ in docs if x == lang})
        whole = sum((count[lang, s] for s in sources), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(words)) for w in words}
        p, q = {s: share(count[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in words)) for o in sources if o != s]
            terms = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in words if count[lang, s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(found) if part == "pair" or r < top]
    return sorted(out)


def table(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, x, s) for i, (x, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "'clash' as term", "1 as n", "'clash' as p", "'clash' as total", "'clash' as shard", "'clash' as rank", "'clash' as a") if extra else df


def result(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


ROWS = (
    [("en", f"s{i % 3}", "The cat saw the DOG; cat's-eye é9ü Ünder ÜNDER") for i in range(6)] + [("en", "s0", "dog dog dog cat_tail"), ("en", "s1", "the the the"), ("en", "s2", None), ("en", "s9", "")]
    + [("de", "s0", "eins zwei drei")] * 2 + [("de", "s1", "1 2 3"), ("de", None, "zwei"), (None, None, "alpha beta"), (None, "s1", "beta alpha alpha"), (None, "", "alpha"), ("fr", "only", "un deux"), ("en", "s1", "x" * 100000), ("en", "s0", "dog " * 30000)]
    + [("it", f"k{i}", f"uno due {chr(97 + i)}") for i in range(5)]
)


@pytest.mark.parametrize(("chars", "sources"), [(5 << 20, 1000), (12, 2)])
def test_against_plain(spark, monkeypatch, chars, sources):
    monkeypatch.setattr(sa, "AUTOMATON_CHARS", chars)  # 12: several shards, and texts dealt out to them
    monkeypatch.setattr(sa, "SCAN_CHARS", 1000)
    monkeypatch.setattr(sa, "SOURCES", sources)  # 2: several blocks of pairs
    assert result(sa.audit(table(spark, ROWS, extra=True))) == plain(ROWS)


def test_top_terms(spark, monkeypatch):
    monkeypatch.setattr(sa, "TOP_TERMS", 1)
    assert result(sa.audit(table(spark, ROWS))) == plain(ROWS, 1)


def test_none_and_no_terms(spark):
    assert sa.audit(table(spark, [])).collect() == []
    rows = [("en", "a", "one"), ("en", "b", "two"), ("en", "b", None)]
    assert result(sa.audit(table(spark, rows))) == plain(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_share_of_large_counts(spark):
    big = 9_000_000_000_000
    row = spark.sql(f"select {sa.share(f'{big}L', f'{7 * big}L', '1000L')} as p").first()
    assert row.p == 1 + 10**9 * (big + 1) // (7 * big + 1000)


def test_query_against_sql(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(sa.SQL["op12_source_divergence"]).fetchall()
    assert result(sa.QUERIES["op12_source_divergence"](spark, sf)) == sorted(want)
