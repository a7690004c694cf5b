"""n-gram join: against brute force, and its exactness arguments."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from tallyframe.llm import ngram_join as nj
from tallyframe.llm.common import word_hashes


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(df, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None}
    assert got == brute(rows)


def corpus(seed, n, size):
    rng = random.Random(seed)
    base = [[f"v{rng.randrange(3000)}" for _ in range(rng.randrange(3, size))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(3000)}"
        if rng.random() < 0.2:
            w = w[: max(1, int(len(w) * rng.uniform(0.8, 1)))]
        rows.append((i * 3 + 1, rng.choice([" ", "\n", "  "]).join(w)))
    return rows


@pytest.mark.parametrize(("seed", "n", "size"), [(1, 240, 60), (2, 150, 300), (3, 200, 12)])
def test_brute_force(make, seed, n, size):
    rows = corpus(seed, n, size)
    check(nj.jaccard_components(make(rows)), rows)


def test_small_tiles_and_stars(make, monkeypatch):
    monkeypatch.setattr(nj, "STAR", 3)
    rows = corpus(4, 120, 80)
    check(nj.jaccard_components(make(rows)), rows)


def test_awkward(make, awkward):
    got = nj.jaccard_components(make(awkward, extra=True)).collect()
    assert len(got) == len(awkward)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].component_id == by[2].component_id == by[-5].component_id == -5
    assert [by[i].component_id for i in (3, 4, 5)] == [3, 4, 5] and by[4].n_shingles == 0
    assert by[7].component_id == 6 and by[6].n_shingles == 1
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in nj.one_per_component(make(awkward, extra=True)).collect())
    assert [i for none, i in kept if not none] == [-5, 3, 4, 5, 6, 8, 9, 10, 11, 12]


def test_empty(make):
    assert nj.jaccard_components(make([])).collect() == []
    assert nj.one_per_component(make([])).collect() == []


def test_linked_sets_share_a_tile():
    rng = np.random.default_rng(3)
    for n in [6, 7, 8, 11, 13, 20, 27, 40, 61, 90, 300, 2000]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64))
            drop = rng.integers(0, n // 7 + 2)
            keep = np.delete(a, rng.choice(len(a), min(drop, len(a) - 1), replace=False))
            b = np.union1d(keep, rng.integers(0, 2**63, rng.integers(0, n // 10 + 2), dtype=np.uint64))
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= 85 * (len(a) + len(b) - inter) and len(a) + len(b) > 2 * inter:
                assert np.intersect1d(nj.tile_keys(a), nj.tile_keys(b)).size, (n, len(a), len(b), inter)


@pytest.mark.parametrize("groups", [nj.GROUPS, 8 * nj.GROUPS])
def test_tree_returns_all_that_the_bound_leaves(groups):
    rng = np.random.default_rng(1)
    points = rng.poisson(2, (500, groups)).astype("<u4")
    points[100:200] = points[:100] + rng.integers(0, 2, (100, groups)).astype("<u4")
    sizes = points.sum(1).astype(np.int64)
    tree = nj.CountRTree(list(points), sizes)
    for i in range(0, 200, 7):
        want = np.flatnonzero(np.minimum(points, points[i]).sum(1) * 37 >= 17 * (sizes + sizes[i]))
        assert sorted(tree.probe(i)) == want.tolist()
    for own in (points, points[90:110]):
        n = own.sum(1).astype(np.int64)
        got = {(min(x, y), max(x, y)) for i, j, _ in nj.CountRTree(list(own), n).pairs(lambda x, y: (x + y) % 3 > 0) for x, y in zip(i.tolist(), j.tolist())}
        assert got == {(x, y) for x in range(len(own)) for y in range(x + 1, len(own)) if (x + y) % 3 and np.minimum(own[x], own[y]).sum() * 37 >= 17 * (n[x] + n[y])}


def near_misses(seed, members, words, changes, other=0):
    """One text's variants: each has `changes` words of its own, far apart, so that two of them share most shingles."""
    rng = random.Random(seed)
    base = [f"b{seed}_{i}" for i in range(words)]
    rows = []
    for k in range(members):
        w = list(base)
        for at in rng.sample(range(0, words, 13), changes):
            w[at] = f"m{k}_{at}"
        rows.append((other + 2 * k, " ".join(w)))
    return rows


def test_a_family_below_the_limit_emits_few_rows(spark, make, monkeypatch):
    """Members share tiles and reach 0.80 to 0.85, but few link: pairs must not grow with the square of the family, and
    whole sets are moved for a part of the tiles' members only."""
    made: list[tuple[str, int]] = []
    real = nj.written
    monkeypatch.setattr(nj, "written", lambda df, tag: (out := real(df, tag), made.append((tag, out.count())) if tag in ("ngram-candidates", "ngram-contested", "ngram-tiles") else None)[0])
    figures = []
    for members in (60, 300):
        made.clear()
        rows = near_misses(1, members, 400, 6)
        check(nj.jaccard_components(make(rows)), rows)
        figures.append(dict(made))
    small, large = figures
    assert 0 < large["ngram-candidates"] <= 6 * max(small["ngram-candidates"], 60), figures
    assert large.get("ngram-contested", 0) <= large["ngram-tiles"] / 2, figures


def test_forest():
    rng = np.random.default_rng(4)
    for _ in range(50):
        i, j = rng.integers(0, 30, (2, 60))
        i, j = i[i != j], j[i != j]
        comp = rng.integers(0, 25, 30)
        keep = nj.forest(i, j, comp, rng.permutation(len(i)).astype(np.uint64))

        def groups(edges):
            own = {int(c): {int(c)} for c in comp}
            for x, y in edges:
                a, b = own[int(comp[x])], own[int(comp[y])]
                if a is not b:
                    a |= b
                    own.update(dict.fromkeys(b, a))
            return {c: min(g) for c, g in own.items()}

        every = groups(zip(i, j))
        assert groups(zip(i[keep], j[keep])) == every and len(keep) == len(every) - len(set(every.values()))


def test_hot_tiles_and_parts(make, monkeypatch):
    """Every tile is dealt out by fingerprint, and every tile of more than four members is cut into parts."""
    for k, v in (("TILE", 4), ("HEAT", 1), ("HOT", 2), ("STAR", 3)):
        monkeypatch.setattr(nj, k, v)
    rows = corpus(9, 150, 80) + near_misses(2, 30, 200, 3, 1001)
    check(nj.jaccard_components(make(rows)), rows)


def test_rows_of_one_document_belong_together(make):
    one, two = "a b c d e f g h", "i j k l m n o p"
    rows = [(5, one), (5, two), (9, one), (3, two), (7, "q r s t u")]
    got = {(r.doc_id, r.component_id) for r in nj.jaccard_components(make(rows)).collect()}
    assert got == {(5, 3), (9, 3), (3, 3), (7, 7)}
    kept = nj.one_per_component(make([(5, one), (5, two), (6, "q r s t u"), (6, "q r s t u")])).collect()
    assert sorted(r.doc_id for r in kept) == [5, 6] and kept == sorted(kept, key=kept.index)


def test_fingerprints_tell_sets_apart():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(1, 9), dtype=np.uint64)) for _ in range(2000)]
    assert len({nj.fingerprint(s) for s in sets}) == len({tuple(s.tolist()) for s in sets})
    assert nj.fingerprint(sets[0]) == nj.fingerprint(sets[0].copy())


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    from tallyframe.llm import common

    text = (" ".join(f"Word{i % 97}é" for i in range(5000)) + "\n").encode()
    raw, offsets = np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)])
    whole, cuts = word_hashes(raw, offsets)
    monkeypatch.setattr(common, "CHUNK", 777)
    parts, cuts2 = word_hashes(raw, offsets)
    assert (whole == parts).all() and (cuts == cuts2).all() and cuts.tolist() == [0, 5000, 10000]
    assert len(set(whole.tolist())) == 97


def test_shared_tiles_stream():
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted({(rng.randrange(40) if rng.random() < 0.5 else 7, rng.randrange(6000)) for _ in range(9000)})
    batches = [pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows[i : i + 333]], pa.int64()), pa.array([f for _, f in rows[i : i + 333]], pa.int64())], names=["tile", "fp"]) for i in range(0, len(rows), 333)]
    groups = {}
    for b in nj._shared_tiles(iter(batches)):
        for t, c, f in zip(*(x.to_pylist() for x in b.columns), strict=True):
            groups.setdefault(t, []).append((c, f))
    want = {}
    for t, f in rows:
        want.setdefault(t, []).append(f)
    assert sorted(sorted(f for _, f in g) for g in groups.values()) == sorted(sorted(g) for g in want.values() if len(g) > 1)
    big = max(groups.values(), key=len)
    assert len(big) > nj.TILE and {c for c, _ in big} == set(range(-(-len(big) // nj.TILE)))


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(con.execute(nj.SQL["op10_ngram_jaccard"]).fetchall()) == sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.op10_ngram_jaccard(spark, sf).collect())


def other_brute(rows, shingle, percent):
    """brute() with a shingle and a similarity of its own."""
    cut = {i: words(t) for i, t in rows}
    sets = {i: {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set() for i, w in cut.items()}
    comp = {i: {i} for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b) and comp[i] is not comp[j]:
            comp[i] |= comp[j]
            for k in comp[j]:
                comp[k] = comp[i]
    return {i: (len(sets[i]), min(comp[i])) for i in sets}


@pytest.mark.parametrize(("seed", "shingle", "percent"), [(5, 5, 80), (6, 5, 80), (7, 3, 60), (8, 9, 95)])
def test_other_links(make, seed, shingle, percent):
    rows = corpus(seed, 150, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(make(rows), shingle, percent / 100).collect()}
    assert got == other_brute(rows, shingle, percent)


@pytest.mark.parametrize("percent", [50, 60, 75, 80, 85, 95])
def test_linked_sets_share_a_tile_at_any_similarity(percent):
    rng, link, seen = np.random.default_rng(percent), nj.Link(5, percent / 100), 0
    for n in [2, 3, 4, 5, 6, 8, 9, 12, 13, 18, 19, 27, 28, 40, 61, 90, 300, 2000]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            less, more = rng.integers(0, n * (100 - percent) // 100 + 1, 2) * rng.integers(0, 2, 2)
            b = np.union1d(np.delete(a, rng.choice(n, min(less, n - 1), replace=False)), rng.integers(0, 2**63, more, dtype=np.uint64))
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= percent * (len(a) + len(b) - inter) and len(a) + len(b) > 2 * inter:
                seen += 1
                assert np.intersect1d(nj.tile_keys(a, link), nj.tile_keys(b, link)).size, (n, len(a), len(b), inter)
    assert seen > 100


@pytest.mark.parametrize("percent", [80, 85])
def test_the_bound_passes_over_no_link(percent):
    rng, link, dropped = np.random.default_rng(percent), nj.Link(5, percent / 100), 0
    for n in [1, 2, 3, 5, 9, 33, 130, 1000, 5000, 40000]:
        for _ in range(30 if n < 10000 else 3):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            b = np.union1d(np.delete(a, rng.choice(n, rng.integers(0, n), replace=False)), rng.integers(0, 2**63, rng.integers(0, n), dtype=np.uint64))
            own = [nj._read_point(nj.point(x))[0] for x in (a, b)]
            assert [int(x.sum()) for x in own] == [len(a), len(b)] and all(np.array_equal(x, nj.counts(y)) for x, y in zip(own, (a, b)))
            kept = 1 in nj.CountRTree(own, np.array([len(a), len(b)]), link).probe(0)
            inter = len(np.intersect1d(a, b))
            assert nj.shared(a, b) == nj.shared(b, a) == inter
            assert kept or not link.holds(inter, len(a) + len(b))
            dropped += not kept
    assert dropped > 100
    many = np.arange(1000, dtype=np.uint64)
    assert nj.counts(many).dtype == np.uint32 and nj._read_point(nj.point(many))[0].max() == 1000
