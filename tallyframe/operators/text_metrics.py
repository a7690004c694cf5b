"""Metrics over whole columns, with a path for long texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.metrics import _f1, canonical_set, lcs_length, metric, set_f1, token_f1
from tallyframe.functions.text import tokens

#: Up to this many cells the table of the subsequence is filled in expressions, above in a pandas UDF.
LONG_CELLS = 400


def lcs_lists(a: list, b: list) -> int:
    """Bit-parallel: a word of bits is a row of the table (Crochemore and others, 2001)."""
    places: dict = {}
    for i, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << i
    row, full = (1 << len(b)) - 1, (1 << len(b)) - 1
    for x in a:
        m = places.get(x, 0)
        row = ((row + (row & m)) | (row & ~m)) & full
    return len(b) - bin(row).count("1")


@F.pandas_udf(T.IntegerType())
def _lcs_long(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in rows:
        yield pd.Series([None if x is None or y is None else lcs_lists(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


def rouge_l_rows(p: Column, r: Column) -> Column:
    """rouge_l of token arrays of any length: short pairs by expressions, longer ones bit-parallel in Arrow batches. The
    other path gets null for a row, so that no token is moved for it."""
    long = F.size(p).cast("long") * F.size(r) > LONG_CELLS
    none = F.lit(None).cast("array<string>")
    lcs = F.coalesce(_lcs_long(F.when(long, p).otherwise(none), F.when(long, r).otherwise(none)), F.when(~long, lcs_length(p, r)))
    return _f1(lcs, F.size(p), F.size(r))


def token_counts(a: str, b: str) -> tuple[int, int, int]:
    """(multiset overlap, tokens, tokens) of two normalised texts. Their blanks are single ones; str.split() would also cut at others."""
    x, y = ([t for t in c.split(" ") if t] for c in (a, b))
    p, r = Counter(x), Counter(y)
    return sum(min(p[t], r[t]) for t in p.keys() & r.keys()), len(x), len(y)


@F.pandas_udf(T.StructType([T.StructField(x, T.IntegerType()) for x in "onm"]))
def _token_counts(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for a, b in rows:
        yield pd.DataFrame([token_counts(x, y) for x, y in zip(a, b, strict=True)], columns=["o", "n", "m"])


def token_f1_texts(p: Column, r: Column) -> Column:
    """token_f1 of normalised answers of any length, counted in Arrow batches, which takes less time than a sort by expressions.
    Batches have at most spark.sql.execution.arrow.maxBytesPerBatch bytes, or a row."""
    c = _token_counts(p, r)
    return _f1(c["o"], c["n"], c["m"])


def score_rows(df: DataFrame, name: str, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """df with `score` by the metric's name. Token arrays and sets are columns of their own, so that they are made once."""
    made = {"qa_f1": (tokens, token_f1), "rouge_l": (tokens, rouge_l_rows), "set_f1": (canonical_set, set_f1)}.get(name)
    if made is None:
        return df.withColumn("score", metric(name, F.col(prediction), F.col(reference)))
    df = df.withColumns({"_p": made[0](F.col(prediction)), "_r": made[0](F.col(reference))})
    return df.withColumn("score", made[1](F.col("_p"), F.col("_r"))).drop("_p", "_r")
