"""Language ID: a byte convolutional network in numpy.

Bytes (letters lower-cased, digits and ASCII punctuation folded) are embedded, filters of several widths slide over a
window, each filter's maximum over the window is kept, and a softmax over these maxima gives the languages. Windows
have a fixed length and cover the whole text; their log probabilities are averaged by the letters they hold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import fold, one_each, prepare, table, text_column
from tallyframe.llm.tokens import slices

#: Bytes of a window; a text's last one is padded with spaces.
WINDOW = 128
EMBED, WIDTHS, FILTERS = 6, (2, 3, 4), 12
#: Rows the network is fitted on, at most, chosen by a hash of the id; and windows of each, chosen by a hash from all windows
#: of its whole text. So at most 51,200 windows (6.5 MB) go to the driver, whatever the texts' lengths.
SAMPLE_ROWS, SAMPLE_WINDOWS = 1600, 32
EPOCHS, RATE, BATCH = 3, 0.01, 64
#: Windows scored at a time.
CHUNK = 256
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def folded(raw: np.ndarray) -> np.ndarray:
    """Lower-case bytes, everything in ASCII but letters as a space; Latin-1 capitals in UTF-8 (C3 80 to C3 9E) too."""
    x = _FOLD[raw]
    high = np.flatnonzero(raw[:-1] == 0xC3) + 1
    up = high[(raw[high] >= 0x80) & (raw[high] <= 0x9E) & (raw[high] != 0x97)]
    x[up] += 0x20
    return x


def windows(text: np.ndarray) -> np.ndarray:
    """The folded text as rows of WINDOW bytes; at least one row."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.full(n * WINDOW, 32, np.uint8)
    out[: len(text)] = text
    return out.reshape(n, WINDOW)


class Network:
    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"c{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
        self.p["b"] = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.p["o"] = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.p["ob"] = np.zeros(len(languages), np.float32)

    def _views(self, x: np.ndarray) -> dict[int, np.ndarray]:
        """Rows of w consecutive embeddings, by width; views of one array."""
        e = self.p["e"][x]
        return {w: np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), w * EMBED, 1)[:, ::EMBED] for w in WIDTHS}

    def forward(self, x: np.ndarray, keep: bool = False):
        pooled, at, views = [], [], self._views(x)
        for w in WIDTHS:
            flat = np.ascontiguousarray(views[w]).reshape(-1, w * EMBED)
            out = (flat @ self.p[f"c{w}"]).reshape(len(x), -1, FILTERS)
            if keep:
                at.append(out.argmax(1))
                pooled.append(np.take_along_axis(out, at[-1][:, None], 1)[:, 0])
            else:
                pooled.append(out.max(1))
        h = np.concatenate(pooled, 1) + self.p["b"]
        a = np.maximum(h, 0)
        z = a @ self.p["o"] + self.p["ob"]
        z = z - z.max(1, keepdims=True)
        logs = z - np.log(np.exp(z).sum(1, keepdims=True))
        return (logs, h, a, at, views) if keep else logs

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log probability of the languages y, by parameter."""
        logs, h, a, at, views = self.forward(x, True)
        d = np.exp(logs)
        d[np.arange(len(x)), y] -= 1
        d /= len(x)
        g = {"o": a.T @ d, "ob": d.sum(0)}
        dh = (d @ self.p["o"].T) * (h > 0)
        g["b"] = dh.sum(0)
        g["e"] = np.zeros_like(self.p["e"])
        for i, w in enumerate(WIDTHS):
            dp = dh[:, i * FILTERS : (i + 1) * FILTERS]
            rows = np.arange(len(x))[:, None]
            seen = views[w][rows, at[i]]
            g[f"c{w}"] = np.einsum("nfk,nf->kf", seen, dp)
            back = (dp[:, :, None] * self.p[f"c{w}"].T).reshape(-1, w, EMBED)
            bytes_at = x[rows[:, :, None], at[i][:, :, None] + np.arange(w)].reshape(-1, w)
            np.add.at(g["e"], bytes_at, back)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> "Network":
        rng, step = np.random.default_rng(seed), 0
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for _ in range(EPOCHS if len(x) else 0):
            order = rng.permutation(len(x))
            for lo in range(0, len(order), BATCH):
                part = order[lo : lo + BATCH]
                step += 1
                g = self.gradient(x[part], y[part])
                for k, v in self.p.items():
                    m, s = state[k]
                    m += 0.1 * (g[k] - m)
                    s += 0.001 * (g[k] * g[k] - s)
                    v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(net: Network, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    if not net.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    rows = [windows(folded(np.frombuffer(t, np.uint8))) for t in texts]
    ends = np.cumsum([0, *map(len, rows)])
    every = np.concatenate(rows)
    logs = np.concatenate([net.forward(every[i : i + CHUNK]) for i in range(0, len(every), CHUNK)])
    letters = _LETTER[every].sum(1).astype(np.float64)
    weight = np.add.reduceat(letters, ends[:-1])
    mean = np.add.reduceat(logs * letters[:, None], ends[:-1]) / np.maximum(1, weight)[:, None]
    p = np.exp(mean - mean.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    known = (weight > 0) & np.array([bool(w == 0 or t.isascii() or has_letter(t)) for t, w in zip(texts, weight, strict=True)])
    return [net.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, p.max(1), 0.0)


def training_windows(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, bytes]]:
    """(language, window): of the windows with a letter of at most `rows` documents that are not held out, SAMPLE_WINDOWS a
    document by the smallest hashes; as many documents of each language as there are, up to an equal share; sorted. Of rows
    that share an id, one text is used."""
    known = docs.where("doc_id is not null and lang is not null").where(fold(F.col("doc_id")) != 0)
    ids = known.select("doc_id", "lang")
    languages = ids.select("lang").distinct().count()
    share = max(1, rows // max(1, languages))
    own = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # The limit is pushed below the shuffle: a task sends at most `share` rows of a language.
    chosen = ids.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= share).select("doc_id").distinct()
    texts = one_each(known.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id"), "doc_id").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_column(b)
            for lang, lo, hi in zip(b.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
                w = windows(folded(raw[lo:hi]))
                w = sorted((x.tobytes() for x in w[_LETTER[w].any(1)]), key=lambda x: (zlib.crc32(x), x))[:SAMPLE_WINDOWS]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(w), pa.string()), pa.array(w, pa.binary())], names=["lang", "w"])

    # At most `rows` times SAMPLE_WINDOWS rows.
    return sorted((r[0], bytes(r[1])) for r in texts.mapInArrow(run, "lang string, w binary").collect())


def fitted(docs: DataFrame) -> Network:
    prepare(docs.sparkSession)
    found = training_windows(docs)
    languages = sorted({x for x, _ in found})
    x = np.frombuffer(b"".join(w for _, w in found), np.uint8).reshape(-1, WINDOW)
    return Network(languages).fit(x, np.array([languages.index(a) for a, _ in found], np.int64))


def identified(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs. A text that is null or has no letter is 'und' with
    score 0. Other columns are not read; repeated rows get equal results, a null id is held out. A very long text is cut
    into windows, which are scored CHUNK at a time. No documents, no rows; no language learned, 'und'. Ties go to the first
    language by name."""
    prepare(docs.sparkSession)
    packed = (net.languages, net.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Network(packed[0])
        n.p = packed[1]
        for b in batches:
            raw, offsets = text_column(b)
            for i, part in slices(raw, offsets, 1 << 19):
                lang, score = predict(n, part)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op2_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of all documents, learned from the folds 1 to 4. Nulls, texts without a letter,
    very long texts, repeated rows and empty tables: see identified()."""
    docs = table(spark, sf_dir, "documents")
    return identified(docs, fitted(docs))


QUERIES = {"op2_byte_cnn": op2_byte_cnn}
SQL: dict[str, str] = {}
