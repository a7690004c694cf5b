"""Concatenate and cut: documents' ids in one stream, cut into fixed windows.

Pass 1 encodes each partition once and writes (partition, running start in it, ids). The totals of the partitions,
one number each, are prefix-summed; a document's place in the stream is its partition's base plus its running start.
Pass 2 cuts each document at the window borders that fall inside it; every piece is a boundary record (document, start,
length, sequence, offset). Neither pass orders or moves the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import prepare, table, text_column, written
from tallyframe.llm.tokens import encoder, slices

VOCABULARY, END_ID, WINDOW = "word_bpe_49k.json", 1, 2048
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("pid", pa.int64()), ("local", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, pid, local, n, ids): ids with the end id, and their place in the partition pid. A null text is empty: it
    has the end id alone."""
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for b in batches:
            raw, offsets = text_column(b)
            for i, texts in slices(raw, offsets):
                ids = [x + end for x in enc.encode(texts)]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                local = at + np.r_[0, np.cumsum(n)[:-1]]
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(ids)).cast(pa.int64()), pa.array(np.full(len(ids), pid, np.int64)), pa.array(local), pa.array(n), pa.array(ids, pa.binary())], schema=_SCHEMA)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, pid long, local long, n long, ids binary"), "packed-ids")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, the piece's ids
    as little-endian unsigned 32-bit integers). Repeated rows are documents of their own; a null doc_id stays null; no
    documents, no rows. A null or empty text has the end id alone, a very long one spans many sequences. Only the last
    sequence has fewer than `window` ids. Other columns are ignored."""
    spark = docs.sparkSession
    enc = encoded(docs, vocabulary, end_id)
    # One row a partition: bounded by the number of input splits.
    totals = sorted(enc.groupBy("pid").agg(F.sum("n")).collect())
    bases = [0, *accumulate(t for _, t in totals)][:-1]
    base = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, bases, strict=True)], "pid long, base long")
    placed = enc.join(F.broadcast(base), "pid").withColumn("g", F.col("base") + F.col("local"))

    def piece(w):
        start = F.greatest(F.lit(0), w * window - F.col("g"))
        length = F.least(F.col("n"), (w + 1) * window - F.col("g")) - start
        ids = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (length * 4).cast("int"))
        out = [start.alias("start"), length.alias("length"), F.crc32(ids).alias("ids_crc32"), w.alias("sequence_id"), (F.col("g") + start - w * window).alias("offset")]
        return F.struct(*out, *([ids.alias("ids")] if with_ids else []))

    windows = F.sequence((F.col("g") / window).cast("long"), ((F.col("g") + F.col("n") - 1) / window).cast("long"))
    cut = placed.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.transform(windows, piece)).alias("p"))
    names = ["p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset"]
    return cut.select("doc_id", *names, *(["p.ids"] if with_ids else []))


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_pad, documents) from pieces with ids: the windows themselves. ids is padded to the window,
    unless its length is a power of two; documents lists the boundary records in order."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(own.alias("p")).select("sequence_id", "p", F.expr("aggregate(p, 0L, (s, x) -> s + x.length)").alias("n"))
    whole = F.expr(f"n = {window} or bit_count(n) = 1")
    pad = F.when(whole, F.lit(0)).otherwise(window - F.col("n")).cast("int")
    blob = F.expr("aggregate(p, cast('' as binary), (s, x) -> concat(s, x.ids))")
    filler = F.unhex(F.repeat(F.lit(np.array([pad_id], "<u4").tobytes().hex()), pad))
    return rows.select("sequence_id", F.concat(blob, filler).alias("ids"), pad.alias("n_pad"), F.transform("p", lambda x: x.dropFields("ids")).alias("documents"))


def op4_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids. Nulls, repeated rows, very long texts, clashing columns and
    empty tables: see pack()."""
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_concat_and_cut": op4_concat_and_cut}
SQL: dict[str, str] = {}
