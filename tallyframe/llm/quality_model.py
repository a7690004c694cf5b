"""Quality classifier: a factorisation machine in numpy.

Features of a text: its hashed words (share of the text's words), structure statistics and text metadata, cut into bins
(one-hot). The score is the sigmoid of w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j; the pairwise part is computed in
linear time as half of (sum v_i x_i)^2 - sum (v_i x_i)^2, summed over the factors. It is fitted on a bounded sample of
labelled rows with Adam, and applied to whole texts in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import _IS_SPACE, fold, mix, one_each, prepare, table, text_column, word_hashes
from tallyframe.llm.tokens import slices

#: Buckets of hashed words, and factors.
BUCKETS, FACTORS = 1 << 13, 6
#: Labelled rows that the model is fitted on, at most; chosen by a hash of the id.
SAMPLE_ROWS = 4000
EPOCHS, RATE, BATCH, L2 = 30, 0.02, 64, 1e-5
THRESHOLD = 0.3
#: Structure statistics, each cut into BINS bins at these limits.
BINS = 16
STATISTICS = ("words", "word_length", "symbols", "upper", "digits", "lines", "repeated_lines", "distinct", "punctuation", "marks", "high")
_CLASS = np.zeros((6, 256), bool)
_CLASS[0][[ord(c) for c in "#*$%&|<>"]] = True
_CLASS[1][65:91] = True
_CLASS[2][48:58] = True
_CLASS[3][[ord(c) for c in ".,;:?"]] = True
_CLASS[4][ord("!")] = True
_CLASS[5][128:] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(raw: np.ndarray, offsets: np.ndarray, texts: list[bytes], hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bin numbers, one row a text and one column a statistic."""
    n = np.maximum(1, np.diff(cuts))
    size = np.maximum(1, np.diff(offsets))
    filled = np.maximum(1, _sums(~_IS_SPACE[raw], offsets))
    own = [_sums(c[raw], offsets) for c in _CLASS]
    lines = np.maximum(1, _sums(raw == 10, offsets) + 1)
    again = np.array([len(x) - len(set(x)) for x in (t.split(b"\n") for t in texts)])
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    share = lambda x, scale: np.minimum(BINS - 1, (x * scale * BINS)).astype(np.int64)
    log = lambda x: np.minimum(BINS - 1, np.log2(1 + x)).astype(np.int64)
    return np.stack([
        log(np.diff(cuts)), np.minimum(BINS - 1, filled // n), share(own[0] / n, 0.5), share(own[1] / filled, 1.2), share(own[2] / filled, 2), log(size / lines),
        share(again / lines, 1), share(distinct / n, 0.999), share(own[3] / n, 1.5), share(own[4] / n, 1), share(own[5] / size, 2),
    ], 1)


DIMENSION = BUCKETS + BINS * len(STATISTICS)
_OFFSETS = BUCKETS + BINS * np.arange(len(STATISTICS))


def featurise(raw: np.ndarray, offsets: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, indices, values): sparse rows. A word bucket's value is its share of the words, scaled; a text without
    words has its statistics alone."""
    hashes, cuts = word_hashes(raw, offsets)
    bins = statistics(raw, offsets, texts, hashes, cuts) + _OFFSETS
    row = np.repeat(np.arange(len(texts)), np.diff(cuts))
    keys, counts = np.unique(row * BUCKETS + (mix(hashes) % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    at = np.searchsorted(keys, np.arange(len(texts) + 1) * BUCKETS)
    of = keys // BUCKETS
    k = len(STATISTICS)
    ends = at + k * np.arange(len(texts) + 1)
    indices, values = np.empty(ends[-1], np.int64), np.ones(ends[-1], np.float32)
    word_at = np.arange(len(keys)) + k * (of + 1)
    indices[word_at] = keys % BUCKETS
    values[word_at] = 4.0 * counts / np.maximum(1, np.diff(cuts))[of]
    indices[(ends[:-1, None] + np.arange(k)).ravel()] = bins.ravel()
    return ends, indices, values


class Machine:
    """w0, w (DIMENSION) and v (DIMENSION x FACTORS)."""

    def __init__(self, seed: int = 7):
        self.w0, self.w = 0.0, np.zeros(DIMENSION, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (DIMENSION, FACTORS)).astype(np.float32)

    def raw_scores(self, ends: np.ndarray, indices: np.ndarray, values: np.ndarray) -> np.ndarray:
        x = values[:, None]
        vx = self.v[indices] * x
        linear = np.add.reduceat(self.w[indices] * values, ends[:-1])
        summed, squares = np.add.reduceat(vx, ends[:-1]), np.add.reduceat(vx * vx, ends[:-1])
        return self.w0 + linear + 0.5 * (summed * summed - squares).sum(1)

    def scores(self, ends, indices, values) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw_scores(ends, indices, values), -30, 30).astype(np.float64)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> "Machine":
        """Adam on the log loss. Without both labels, the constant score is the labels' mean, or 0.5."""
        if len(rows) == 0 or labels.min() == labels.max():
            mean = (labels.sum() + 0.5) / (len(labels) + 1)
            self.w0, self.v[:] = float(np.log(mean / (1 - mean))), 0
            return self
        rng = np.random.default_rng(seed)
        self.w0 = float(np.log(labels.mean() / (1 - labels.mean())))
        state = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in (("w", self.w), ("v", self.v))}
        step, b0 = 0, [0.0, 0.0]
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), BATCH):
                part = order[lo : lo + BATCH]
                step += 1
                idx = np.concatenate([rows[i][0] for i in part])
                val = np.concatenate([rows[i][1] for i in part])
                ends = np.r_[0, np.cumsum([len(rows[i][0]) for i in part])]
                vx = self.v[idx] * val[:, None]
                summed = np.add.reduceat(vx, ends[:-1])
                z = self.raw_scores(ends, idx, val)
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]).astype(np.float32) / len(part)
                each = np.repeat(err, np.diff(ends))
                gw = each * val
                gv = gw[:, None] * (np.repeat(summed, np.diff(ends), 0) - vx)
                used, slot = np.unique(idx, return_inverse=True)
                grad_w, grad_v = np.zeros(len(used), np.float32), np.zeros((len(used), FACTORS), np.float32)
                np.add.at(grad_w, slot, gw)
                np.add.at(grad_v, slot, gv)
                for key, array, grad in (("w", self.w, grad_w), ("v", self.v, grad_v)):
                    m, s = state[key]
                    grad = grad + L2 * array[used]
                    m[used] = 0.9 * m[used] + 0.1 * grad
                    s[used] = 0.999 * s[used] + 0.001 * grad * grad
                    array[used] -= RATE * (m[used] / (1 - 0.9**step)) / (np.sqrt(s[used] / (1 - 0.999**step)) + 1e-8)
                g0 = float(err.sum())
                b0 = [0.9 * b0[0] + 0.1 * g0, 0.999 * b0[1] + 0.001 * g0 * g0]
                self.w0 -= RATE * (b0[0] / (1 - 0.9**step)) / ((b0[1] / (1 - 0.999**step)) ** 0.5 + 1e-8)
        return self


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features of the whole texts and labels of at most `rows` labelled documents that are not held out, in the order of
    the id. A document with both labels counts as 0; of rows that share an id, one text is used."""
    chosen = labels.where("doc_id is not null and quality in (0, 1)").where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = one_each(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_column(b)
            for i, part in slices(raw, offsets):
                k = len(part)
                ends, idx, val = featurise(raw[offsets[i] : offsets[i + k]], offsets[i : i + k + 1] - offsets[i], part)
                out = [(idx[lo:hi].astype("<i4").tobytes(), val[lo:hi].astype("<f4").tobytes()) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
                cols = [b.column(0).slice(i, k).cast(pa.int64()), b.column(1).slice(i, k).cast(pa.int32()), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "quality", "i", "x"])

    # At most `rows` rows, each of at most BUCKETS words.
    found = texts.mapInArrow(run, "doc_id long, quality int, i binary, x binary").collect()
    found.sort(key=lambda r: (r[0], bytes(r[2])))
    return [(np.frombuffer(r[2], "<i4").astype(np.int64), np.frombuffer(r[3], "<f4")) for r in found], np.array([r[1] for r in found], np.float64)


def fitted(docs: DataFrame, labels: DataFrame) -> Machine:
    prepare(docs.sparkSession)
    rows, quality = labelled_sample(docs, labels)
    return Machine().fit(rows, quality)


def scored(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; a null text is scored as an empty one, by its statistics
    alone. Other columns are not read; repeated rows get equal scores, a null id is held out. A very long text is one row of
    sparse features (at most BUCKETS words). No documents, no rows. A score at the threshold counts as 1."""
    prepare(docs.sparkSession)
    packed = (model.w0, model.w, model.v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine()
        m.w0, m.w, m.v = packed
        for b in batches:
            raw, offsets = text_column(b)
            for i, part in slices(raw, offsets):
                k = len(part)
                s = m.scores(*featurise(raw[offsets[i] : offsets[i + k]], offsets[i : i + k + 1] - offsets[i], part))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, k).cast(pa.int64()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def op1_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents, learned from the folds 1 to 4 of `labels`. Nulls, empty and
    very long texts, repeated rows and empty tables: see scored(). Without labels every score is the same."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_factorisation_machine": op1_factorisation_machine}
SQL: dict[str, str] = {}
