"""Ordered decoding: spans of labelled tokens, offsets of pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.text import normalize_answer, normalize_entity_type


def _bio(label: str) -> tuple[Column, Column]:
    """B, I or O, and the entity type, of a label. One without a prefix is a B."""
    has = F.col(label).rlike("^[BIbi]-")
    prefix = F.when(F.upper(label) == "O", "O").when(has, F.upper(F.left(label, F.lit(1)))).otherwise("B")
    return prefix, normalize_entity_type(F.when(has, F.substring(label, 3, 10**6)).otherwise(F.col(label)))


def bio_spans(tokens: DataFrame, key: str = "seq", pos: str = "pos", label: str = "label", token: str = "token") -> DataFrame:
    """(key, type, first_pos, last_pos, text): runs of B-/I- labels. O closes; B or another type opens; a label without
    a prefix opens too."""
    prefix, kind = _bio(label)
    w = Window.partitionBy(key).orderBy(pos)
    rows = tokens.withColumns({"_p": prefix, "_t": kind}).withColumns({"_lp": F.lag("_p").over(w), "_lt": F.lag("_t").over(w)})
    opens = (F.col("_p") == "B") | F.col("_lp").isNull() | (F.col("_lp") == "O") | (F.col("_lt") != F.col("_t"))
    rows = rows.withColumn("_span", F.sum(F.when((F.col("_p") != "O") & opens, 1).otherwise(0)).over(w)).where("_p <> 'O'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, token))), lambda x: x[token]), " ")
    return rows.groupBy(key, "_span").agg(F.first("_t").alias("type"), F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), text.alias("text")).drop("_span")


def overlapping(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """tokens (key, left, right) that overlap spans (key, start, end): an equi join on the key with the range condition."""
    hit = (F.col("left") < F.col("end")) & (F.col("right") > F.col("start")) & (F.col("right") > F.col("left"))
    return tokens.join(spans, key).where(hit)


def answer_or_null(windows: DataFrame, key: str, max_tokens: int = 64) -> DataFrame:
    """windows (key, window, start, end: logits): the best span over the windows of a key, the first of equals, and the
    best null score (place 0 of both); answered only if the span's score is strictly greater."""
    from tallyframe.functions.vectors import best_span

    w = windows.withColumns({"_b": best_span(F.col("start"), F.col("end"), max_tokens), "_null": F.get("start", F.lit(0)) + F.get("end", F.lit(0))})
    best = w.groupBy(key).agg(F.max(F.when(F.col("_b").isNotNull(), F.struct(F.col("_b.score").alias("score"), (-F.col("window")).alias("w"), F.col("_b.s").alias("s"), F.col("_b.e").alias("e")))).alias("b"), F.max("_null").alias("null_score"))
    ok = F.coalesce(F.col("b.score") > F.col("null_score"), F.lit(False))
    return best.select(key, F.col("b.score").alias("span_score"), "null_score", F.when(ok, -F.col("b.w")).alias("window"), F.when(ok, F.col("b.s")).alias("s"), F.when(ok, F.col("b.e")).alias("e"))


def bio_entities(tokens: DataFrame, texts: DataFrame, key: str = "seq", window: str = "window", pos: str = "pos") -> DataFrame:
    """(key, type, start, end, text): labelled tokens (key, window, pos, label, start, end) as slices of the text (key, text) by
    their offsets. Tokens without characters are passed over. Entities of one type and normalised text in a key are one,
    whichever of its overlapping windows they come from: at the place of the first, with the slice of the last."""
    prefix, kind = _bio("label")
    w = Window.partitionBy(key, window).orderBy(pos)
    rows = tokens.where(F.col("end") > F.col("start")).withColumns({"_p": prefix, "_t": kind}).withColumns({"_lp": F.lag("_p").over(w), "_lt": F.lag("_t").over(w)})
    opens = (F.col("_p") == "B") | F.col("_lp").isNull() | (F.col("_lp") == "O") | (F.col("_lt") != F.col("_t"))
    rows = rows.withColumn("_span", F.sum(F.when((F.col("_p") != "O") & opens, 1).otherwise(0)).over(w)).where("_p <> 'O'")
    spans = rows.groupBy(key, window, "_span").agg(F.first("_t").alias("type"), F.min_by("start", pos).alias("start"), F.max("end").alias("end"))
    cut = spans.join(texts.select(key, "text"), key).withColumn("text", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    place = F.struct(window, "_span")
    one = cut.groupBy(key, "type", normalize_answer(F.col("text")).alias("_n")).agg(F.min(place).alias("_first"), F.max_by(F.struct("start", "end", "text"), place).alias("_e"))
    return one.select(key, "type", "_e.*", F.col(f"_first.{window}").alias("first_window"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])))
def piece_offsets(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(text, pieces) -> array<struct<s, e>> of pieces found one after another in a text, case-folded; (0, 0) for one that isn't
    there. Each search goes on where the last one ended, so the work of the pieces that are found is that of one pass."""
    for texts, pieces in parts:
        out = []
        for text, own in zip(texts, pieces, strict=True):
            if text is None or own is None:
                out.append(None)
                continue
            folded, at, found = text.casefold(), 0, []
            for piece in own:
                piece = (piece or "").strip()
                start = folded.find(piece.casefold(), at) if piece else -1
                if start < 0:
                    found.append({"s": 0, "e": 0})
                    continue
                at = start + len(piece)
                found.append({"s": start, "e": at})
            out.append(found)
        yield pd.Series(out, dtype=object)
