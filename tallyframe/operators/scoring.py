"""Reductions over log probabilities, image tensors, and tables of vertices: the numeric side of the model boundary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.vectors import log_sum_exp

#: Mean and deviation of the colour channels.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


def sequence_logprob(logits: Column, ids: Column, start: Column | int = 0, mean: bool = False) -> Column:
    """Sum (or mean) of the log probabilities of ids (array<int>) in logits (array<array<double>>), of which the one at
    place `start` predicts the first id. No ids: minus infinity."""
    own = F.slice(logits, F.lit(start) + 1 if isinstance(start, int) else start + 1, F.greatest(F.size(ids), F.lit(1)))
    each = F.zip_with(F.slice(own, 1, F.size(ids)), ids, lambda row, i: F.get(row, i) - log_sum_exp(row))
    total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(ids) == 0, F.lit(float("-inf"))).otherwise(total / F.size(ids) if mean else total)


def option_scores(options: DataFrame, key: str, mean: bool = False) -> DataFrame:
    """options (key, ordinal, label, prompt_length, logits, ids): one row a key with the label of the best continuation
    (the first of equals), its score, and the number of options. The place before the first id predicts it."""
    score = sequence_logprob(F.col("logits"), F.col("ids"), F.greatest(F.col("prompt_length") - 1, F.lit(0)), mean)
    scored = options.withColumn("score", score)
    return scored.groupBy(key).agg(F.max_by("label", F.struct("score", -F.col("ordinal"))).alias("prediction"), F.max("score").alias("score"), F.count(F.lit(1)).alias("options"))


def masked_scores(positions: DataFrame, key: str) -> DataFrame:
    """positions (key, ordinal, label, position, logits, id): the pseudo log likelihood of each candidate is the mean over
    its masked positions; one row a key with the best (the first of equals), its score and its positions. A candidate
    without a position has none."""
    each = positions.withColumn("lp", F.get("logits", F.col("id")) - log_sum_exp(F.col("logits")))
    scores = each.groupBy(key, "ordinal", "label").agg(F.avg("lp").alias("score"), F.count("lp").alias("n"))
    best = scores.groupBy(key).agg(F.max_by(F.struct("label", "score", "n"), F.struct("score", -F.col("ordinal"))).alias("b"))
    return best.select(key, F.col("b.label").alias("prediction"), "b.score", F.col("b.n").alias("positions"))


def channels(pixels: Column, n: int) -> Column:
    """RGB bytes in rows (array<int> of 3 n) as three normalised planes of n doubles."""
    plane = lambda c: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.get(pixels, i * 3 + c) / 255.0 - CHANNEL_MEAN[c]) / CHANNEL_STD[c])
    return F.array(*[plane(c) for c in range(3)])


def _weights(size: int, out: int) -> np.ndarray:
    """Rows of an out x size matrix in fixed point (22 bits): the cubic kernel (a = -1/2), widened where an image shrinks, over
    the pixels within its reach, each row of sum 1 before it is rounded."""
    scale = size / out
    wide = max(scale, 1.0)
    centre = (np.arange(out)[:, None] + 0.5) * scale
    at = np.arange(size)[None]
    x = np.abs((at - centre + 0.5) / wide)
    w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))
    w[(at < np.trunc(centre - 2 * wide + 0.5)) | (at >= np.trunc(centre + 2 * wide + 0.5))] = 0
    w /= w.sum(1, keepdims=True)
    return np.trunc(w * (1 << 22) + np.where(w < 0, -0.5, 0.5)).astype(np.int64)


def _pass(weights: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """One direction: weighted sums over the first axis, rounded to bytes."""
    return np.clip((np.tensordot(weights, lines.astype(np.int64), 1) + (1 << 21)) >> 22, 0, 255)


def resized(image: np.ndarray, size: int) -> np.ndarray:
    """height x width x 3 bytes as size x size x 3 bytes, bicubic: rows first, then columns, each pass rounded to bytes, as common
    image libraries do it. A direction of the right size is not touched."""
    x = image.swapaxes(0, 1)
    x = x if x.shape[0] == size else _pass(_weights(x.shape[0], size), x)
    x = x.swapaxes(0, 1)
    return (x if x.shape[0] == size else _pass(_weights(x.shape[0], size), x)).astype(np.uint8)


def resize(pixels: Column, height: Column, width: Column, size: int) -> Column:
    """RGB bytes in rows as array<int> of a size x size image; a null image is white."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, h, w in rows:
            yield pd.Series([np.full(size * size * 3, 255) if x is None else resized(np.asarray(x, np.uint8).reshape(int(a), int(b), 3), size).ravel() for x, a, b in zip(p, h, w, strict=True)])

    return run(pixels, height, width)


def append_vertex(vertices: DataFrame, new: DataFrame, vector: str, key: str) -> DataFrame:
    """vertices (key, vector, ...) with one more row: the vector of `new`, its key the number of rows. Raises when it runs
    if dimensions differ, or keys are not 0 to n - 1."""
    facts = vertices.agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("last"), F.countDistinct(key).alias("keys"), F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high"))
    checked = new.select(F.col(vector).alias("_v")).limit(1).join(facts)  # one row and one row
    ok = F.when((F.col("last") + 1 != F.col("n")) | (F.col("keys") != F.col("n")), F.raise_error(F.lit("keys are not aligned with the rows")).cast("long"))
    ok = ok.when((F.col("low") != F.col("high")) | (F.size("_v") != F.col("low")), F.raise_error(F.lit("the vector's dimension differs")).cast("long")).otherwise(F.col("n"))
    row = checked.select(ok.alias(key), F.col("_v").alias(vector))
    return vertices.unionByName(row, allowMissingColumns=True)
