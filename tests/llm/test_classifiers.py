"""Quality and language models: the algebra, held-out accuracy, and awkward input."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np

from tallyframe.llm import language_id as li
from tallyframe.llm import quality_model as qm

SF = "/root/testdata/sf0.01"


def out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def test_sum_of_squares_is_the_pairwise_sum():
    m = qm.Machine()
    m.w[:] = np.random.default_rng(0).normal(size=len(m.w))
    idx, val = np.array([3, 9, 77, 8200, 5]), np.array([0.5, 1, 2, 1, 0.25], np.float32)
    got = m.raw_scores(np.array([0, 5]), idx, val)[0]
    want = m.w0 + (m.w[idx] * val).sum() + sum(m.v[a] @ m.v[b] * x * y for (a, x), (b, y) in itertools.combinations(zip(idx, val, strict=True), 2))
    assert abs(got - want) < 1e-4


def test_interactions_are_learned():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(400):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([a, 10 + b]), np.ones(2, np.float32)))
        y.append(float(a == b))
    m = qm.Machine().fit(rows, np.array(y))
    s = m.scores(np.arange(0, 2 * len(rows) + 1, 2), np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
    assert ((s > 0.5) == np.array(y)).mean() > 0.98


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = qm.op1_factorisation_machine(spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) > 0.95 * len(held)
    assert sum(r.predicted for r in held if r.quality) > 0.97 * sum(r.quality for r in held)


def test_quality_does_not_learn_from_held_out_rows(spark, make):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    a, b = qm.fitted(docs, labels), qm.fitted(docs, flipped)
    assert a.w0 == b.w0 and np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)


def test_quality_awkward(spark, make, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = make(awkward, extra=True)
    got = qm.scored(df, qm.fitted(df, none)).collect()
    assert len(got) == len(awkward) and {r.score for r in got} == {0.5} and all(r.held_out == out(r.doc_id) for r in got)
    odd = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 0, 0), (None, 1, 0), (9, None, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    got = qm.scored(df, qm.fitted(df, odd)).collect()
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    assert qm.scored(make([]), qm.fitted(make([]), none)).collect() == []


def plain_logs(n, window):
    """The network with loops: embed, slide each filter, keep its maximum, softmax."""
    e, pooled = n.p["e"].astype(float), []
    for w in li.WIDTHS:
        for f in range(li.FILTERS):
            best = -np.inf
            for at in range(len(window) - w + 1):
                best = max(best, sum(e[window[at + k], d] * n.p[f"c{w}"][k * li.EMBED + d, f] for k in range(w) for d in range(li.EMBED)))
            pooled.append(best)
    h = np.maximum(np.array(pooled) + n.p["b"], 0)
    z = h @ n.p["o"].astype(float) + n.p["ob"]
    return z - np.log(np.exp(z - z.max()).sum()) - z.max()


def test_convolution_against_loops():
    rng = np.random.default_rng(3)
    n = li.Network(["a", "b", "c"])
    n.p["b"] = rng.normal(0, 0.3, len(n.p["b"])).astype(np.float32)
    x = rng.integers(0, 256, (3, li.WINDOW)).astype(np.uint8)
    assert np.allclose(n.forward(x), [plain_logs(n, w) for w in x], atol=1e-4)


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    n = li.Network(["a", "b", "c"])
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    n.p["b"] = n.p["b"] + 0.1
    x, y = rng.integers(97, 105, (6, li.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    loss = lambda: -n.forward(x)[np.arange(6), y].mean()
    g = n.gradient(x, y)
    for k, v in n.p.items():
        flat = v.reshape(-1)
        for at in rng.choice(len(flat), min(25, len(flat)), replace=False) if k != "e" else [e * li.EMBED + d for e in range(97, 105) for d in range(li.EMBED)]:
            old, step = flat[at], 1e-6
            flat[at] = old + step
            up = loss()
            flat[at] = old - step
            down = loss()
            flat[at] = old
            assert abs((up - down) / (2 * step) - np.asarray(g[k]).reshape(-1)[at]) < 1e-5, (k, at)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 105, (8, li.WINDOW)).astype(np.uint8), np.array([0, 1] * 4)
    n = li.Network(["a", "b"])
    loss = lambda: -n.forward(x)[np.arange(8), y].mean()
    before = loss()
    n.fit(np.concatenate([x] * 80), np.concatenate([y] * 80))
    assert loss() < before / 3


def test_short_and_long_texts_are_learned(make):
    rows = [(1, "ab"), (2, " ".join(["zu"] * 3000)), (2, "other"), (3, "ab ab"), (4, "123")]
    docs = make(rows).selectExpr("doc_id", "text", "case doc_id when 2 then 'long' when 4 then 'none' else 'short' end as lang")
    got = li.training_windows(docs)
    own = {i for i, _ in rows if not out(i)}
    assert {lang for lang, _ in got} == {n for n, ids in (("long", {2}), ("short", {1, 3})) if ids & own}
    assert 2 not in own or sum(lang == "long" for lang, _ in got) in (1, -(-9000 // li.WINDOW))


def plain_features(text):
    """Word shares by bucket and the bins of the statistics, counted one by one."""
    b = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", b) if w]
    n, size = max(1, len(words)), max(1, len(b))
    full = max(1, sum(map(len, words)))
    lines = b.split(b"\n")
    k = max(1, len(lines))
    count = lambda chars: sum(b.count(bytes([c])) for c in chars)
    top = lambda x: min(qm.BINS - 1, int(x))
    share = lambda x, scale: top(x * scale * qm.BINS)
    lower = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    stats = [top(np.log2(1 + len(words))), top(full // n), share(count(b"#*$%&|<>") / n, 0.5), share(count(range(65, 91)) / full, 1.2), share(count(range(48, 58)) / full, 2), top(np.log2(1 + size / k)),
        share((len(lines) - len(set(lines))) / k, 1), share(len(set(lower)) / n, 0.999), share(count(b".,;:?") / n, 1.5), share(count(b"!") / n, 1), share(count(range(128, 256)) / size, 2)]
    return sorted(Counter(lower).values()), stats, len(words)


def test_features_against_counts():
    rng = random.Random(2)
    texts = ["", " \n", "One two, two!", "É#1 * $\nÉ#1 * $\n\nA B", "x" * 5000] + [" ".join(rng.choice(["the", "THE", "a1", "#", "né", "end.\n", "z!"]) for _ in range(rng.randrange(1, 200))) for _ in range(30)]
    data = [t.encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    ends, idx, val = qm.featurise(raw, offsets, data)
    for t, lo, hi in zip(texts, ends[:-1], ends[1:], strict=True):
        words, stats, n = plain_features(t)
        k = len(qm.STATISTICS)
        assert [i - qm.BUCKETS - qm.BINS * j for j, i in enumerate(idx[lo : lo + k])] == stats and (val[lo : lo + k] == 1).all()
        assert (idx[lo + k : hi] < qm.BUCKETS).all() and len(set(idx[lo + k : hi])) == hi - lo - k
        shares = sorted(np.rint(val[lo + k : hi] / 4 * max(1, n)).astype(int))
        assert sum(shares) == n and (shares == words or len(shares) < len(words))  # words can share a bucket


def test_a_document_with_both_labels(spark, make):
    docs = make([(i, f"text {i} of words") for i in range(1, 9)])
    labels = spark.createDataFrame([(i, q, 0) for i in range(1, 9) for q in ((0, 1) if i % 2 else (1,))], "doc_id long, quality int, toxic int")
    rows, quality = qm.labelled_sample(docs, labels)
    ids = [i for i in range(1, 9) if not out(i)]
    assert quality.tolist() == [0.0 if i % 2 else 1.0 for i in ids] and len(rows) == len(ids)
    assert all(len(i) == len(qm.STATISTICS) + 4 for i, _ in rows)


def test_windows_cover_whole_texts():
    t = np.frombuffer(b"ab" * 500, np.uint8)
    w = li.windows(t)
    assert w.shape == (8, li.WINDOW) and w.ravel()[:1000].tobytes() == b"ab" * 500 and (w.ravel()[1000:] == 32).all()
    assert li.folded(np.frombuffer("AbÉ9,".encode(), np.uint8)).tobytes() == "abé  ".encode()


def test_language(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = li.op2_byte_cnn(spark, SF).collect()
    assert len(got) == len(docs) and all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) > 0.97 * len(held)


def test_language_awkward(spark, make, awkward):
    df = make([*awkward, (30, "123 !!"), (31, "…"), (32, "中")], extra=True)
    net = li.fitted(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.identified(df, net).collect()}
    assert net.languages == ["en"]
    assert all(got[i] == ("und", 0.0) for i in (3, 4, 5, 8, 30, 31)) and got[1] == ("en", 1.0) and got[32][0] == "en"
    assert [r.lang_pred for r in li.identified(df, li.fitted(make([]))).collect()] == ["und"] * (len(awkward) + 3)
    assert li.identified(make([]), net).collect() == []
