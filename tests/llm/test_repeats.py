"""Repeated passages: the index and the pieces against plain counts, the operator against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import repeats as rp


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[j : j + length] for t in texts for j in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if count[t[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        kept = bytes(x for x, y in zip(t, gone, strict=True) if not y)
        spans = sum(1 for j, y in enumerate(gone) if y and not (j and gone[j - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()], key=str)


@pytest.mark.parametrize("seed", range(40))
def test_index(seed):
    rng = random.Random(seed)
    alphabet = rng.choice([b"ab", b"\x00\x01", b"\xff\x00a", b"abcdefgh"])
    strings = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 6))]
    strings += [strings[0][3:] + b"zz", b"a" * rng.randint(1, 50), b"ab" * 20]
    length = rng.choice([1, 2, 5, 8, 14, 20])
    index = rp.RunLengthIndex(strings)
    hit = index.repeated(length)
    count = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    for s, at in zip(strings, index.starts, strict=True):
        assert [bool(hit[at + i]) for i in range(len(s) - length + 1)] == [count[s[i : i + length]] > 1 for i in range(len(s) - length + 1)]
    # The statistics themselves: the longest match with any other suffix.
    suffixes = {at + i: s[i:] for s, at in zip(strings, index.starts, strict=True) for i in range(len(s))}
    longest = np.zeros(index.size, np.int64)
    for begin, end, match in index.statistics():
        for b, e, m in zip(begin.tolist(), end.tolist(), match.tolist(), strict=True):
            for p in range(b, e):
                longest[p] = max(longest[p], m - (p - b))
    same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: E731, B905
    for p, s in list(suffixes.items())[::7]:
        assert longest[p] == max(same(s, o) for q, o in suffixes.items() if q != p)
    assert len(index.run_starts) <= index.size


@pytest.mark.parametrize("length", [16, 20, 64])
def test_pieces_depend_on_windows_alone(length):
    rng = random.Random(length)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 200))) for _ in range(60)] + [b"a" * 150]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    text, at, n, off, g = rp.cut_pieces(raw, offsets, length)
    covered = sorted(a + i for a, k in zip(at, n, strict=True) for i in range(k))
    assert covered == [o + i for o, t in zip(offsets, texts, strict=False) for i in range(len(t) - length + 1)]
    name = {}
    for a, k, d, h in zip(at.tolist(), n.tolist(), off.tolist(), g.tolist(), strict=True):
        for i in range(k):
            assert name.setdefault(raw[a + i : a + i + length].tobytes(), (h, d - i)) == (h, d - i)


@pytest.mark.parametrize("seed", range(20))
def test_members_are_trimmed_to_what_can_repeat(seed):
    """No window that two members share is lost, and of a pair only what both have is indexed."""
    rng = random.Random(seed)
    alphabet, length, anchor = rng.choice([b"ab", b"\x00a", b"abcd"]), 20, b"##"
    some = lambda n: bytes(rng.choice(alphabet) for _ in range(n))
    rows = []
    for g in range(12):
        left, right = some(18), some(18)
        for k in range(rng.randint(1, 6)):
            a, z = rng.randint(0, 18), rng.randint(0, 18)
            side = some(rng.randint(0, 18 - a)) + left[18 - a :], right[:z] + some(rng.randint(0, 18 - z))
            rows.append((g, g, k, 100 * k, 1, len(side[0]), anchor.join(side)))
    kept = rp.trimmed(rows, length)
    count = Counter((g, i - off, c[i : i + length]) for g, *_, off, c in rows for i in range(len(c) - length + 1))
    left = {(k1, k2, at + i): c[i : i + length] for _, k1, k2, at, _, c in kept for i in range(len(c) - length + 1)}
    for g, k1, k2, at, _, off, c in rows:
        for i in range(len(c) - length + 1):
            if count[g, i - off, c[i : i + length]] > 1:
                assert left[k1, k2, at + i] == c[i : i + length]
    members = Counter(r[0] for r in rows)
    for g in (g for g, n in members.items() if n < 3):
        parts = [c.rstrip(b"\0") for h, *_, c in kept if h == g]
        assert len(set(parts)) < 2 and len(parts) in (0, members[g]) and (members[g] > 1 or not parts)


def test_index_beyond_keys_of_three_ranks():
    """Two ranks are a key where three do not fit; the result is that of three."""
    rng = random.Random(3)
    half = bytes(rng.choice(b"ab") for _ in range(1 << 20))
    hit = rp.RunLengthIndex([half, half[5000:6000] + b"c", half[::-1]]).repeated(400)
    assert list(np.flatnonzero(hit)) == [*range(5000, 5601), *range(len(half) + 1, len(half) + 602)]


def corpus():
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 999)}" for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(40)
    rows = [(i, text(rng.randint(1, 80))) for i in range(60)]
    rows += [(100 + i, text(rng.randint(5, 20)) + " " + passage[rng.randint(0, 20) : rng.randint(60, 200)] + " " + text(8)) for i in range(80)]
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(7, rows[3][1]), (300, passage * 3), (301, "abc" * 400), (302, "x" * 5000 + passage), (303, "é" * 100), (304, passage[:30])]
    return rows


@pytest.mark.parametrize("group", [256, 3])
def test_against_brute_force(make, awkward, monkeypatch, group):
    monkeypatch.setattr(rp, "GROUP_MAX", group)  # 3: nearly every group is dealt out, to single windows if need be
    monkeypatch.setattr(rp, "INDEX_BYTES", 4096)
    rows = corpus() + awkward
    got = rp.without_repeats(make(rows, extra=True), 48)
    assert {"score", "lang", "kept", "spans"} <= set(got.columns)
    assert digests(got) == plain(rows, 48)
    whole = {(r.doc_id, r.text): r for r in got.collect()}
    for (_, t), r in whole.items():
        data = (t or "").encode()
        assert bytes(r.kept) == b"".join(data[a:z] for a, z in zip([0, *(s.end for s in r.spans)], [*(s.start for s in r.spans), len(data)], strict=True))


def test_production_length(make):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared, edge = text(900), text(399)
    rows = [(1, text(500) + shared), (2, shared[100:800] + text(300)), (3, text(450)), (4, "q" + edge + "r"), (5, "s" + edge + "t"), (6, edge), (7, text(3000)), (8, "z" * 801), (9, None)]
    assert digests(rp.without_repeats(make(rows))) == plain(rows, 400)


def test_none_and_short(make):
    assert rp.without_repeats(make([])).collect() == []
    assert digests(rp.without_repeats(make([(1, None), (1, None), (None, "short"), (None, "short")]))) == plain([(1, None), (1, None), (None, "short"), (None, "short")], 400)
    with pytest.raises(ValueError):
        rp.without_repeats(make([]), 8)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert digests(rp.QUERIES["op11_run_length_index"](spark, sf)) == plain(rows, 400)
