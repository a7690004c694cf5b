"""Exact top-k search by cosine similarity: blocks of rows against blocks of queries, with ball bounds.

Rows are brought near to each other first: each goes with the nearest of a bounded number of rows taken as centres, and a
batch of neighbours is a ball. No row of a ball has a product with a query above that of its centre plus its radius, so a
task skips a ball for all queries whose k-th score is out of its reach, and multiplies the rest as matrices. A task keeps k
rows a query; a row for each pair never exists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.sources.scratch import scratch

#: Rows that serve as centres, and bytes of the vectors of a block of queries.
CENTRES, BLOCK_BYTES = 256, 16 << 20
#: Scores are rounded to this many places, and equal ones ordered by id.
PLACES = 6


def _units(column: pa.Array) -> np.ndarray:
    """Vectors of one size as rows of norm 1; a zero vector stays zero."""
    if not len(column):
        return np.zeros((0, 0))
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-8)


def neighbourhoods(rows: DataFrame, centres: int = CENTRES) -> DataFrame:
    """rows (id, x) in a written table, neighbours together: dealt out by ranges of (nearest centre, hash), so that a frequent
    centre is no one task. The centres are those rows whose ids have the smallest hashes."""
    spark = rows.sparkSession
    sample = [r.x for r in rows.orderBy(F.xxhash64("id"), "id").limit(centres).collect()]
    middle = _units(pa.array(sample, pa.list_(pa.float64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = (_units(b.column(1)) @ middle.T).argmax(axis=1) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best.astype(np.int32))], names=["id", "x", "centre"])

    path = scratch(spark, "neighbourhoods")
    placed = rows.select("id", "x").mapInArrow(run, "id long, x array<double>, centre int")
    placed.repartitionByRange("centre", F.xxhash64("id")).sortWithinPartitions("centre").write.parquet(path)
    return spark.read.parquet(path)


class BestRows:
    """The k best rows of each query, by rounded score and then the smaller id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.score = np.full((len(queries), k), -np.inf)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.skipped = 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        middle = x.mean(axis=0)
        radius = np.sqrt(((x - middle) ** 2).sum(axis=1).max())
        # What rounding may add, and a little for the sums' own rounding.
        near = np.flatnonzero(self.queries @ middle + radius + 10.0**-PLACES >= self.score[:, -1])
        self.skipped += len(self.queries) - len(near)
        if not len(near):
            return
        found = np.round(self.queries[near] @ x.T, PLACES)
        score = np.hstack([self.score[near], found])
        id_ = np.hstack([self.id[near], np.broadcast_to(ids, found.shape)])
        best = np.lexsort((id_, -score), axis=1)[:, : self.k]
        self.score[near], self.id[near] = np.take_along_axis(score, best, 1), np.take_along_axis(id_, best, 1)


def _blocks(queries: DataFrame, block_bytes: int) -> Iterator[tuple[list, np.ndarray]]:
    ids, rows, size = [], [], 0
    for r in queries.select("id", "x").toLocalIterator():
        ids.append(r.id)
        rows.append(r.x)
        size += 8 * len(r.x)
        if size >= block_bytes:
            yield ids, _units(pa.array(rows, pa.list_(pa.float64())))
            ids, rows, size = [], [], 0
    if ids:
        yield ids, _units(pa.array(rows, pa.list_(pa.float64())))


def top_rows(rows: DataFrame, queries: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, id, score, rank): for each query the k most similar rows. rows and queries: (id long, x array<double>), the
    queries with distinct ids. Queries go to the tasks in blocks of block_bytes; a block is one pass over the rows."""
    spark, near, out = rows.sparkSession, neighbourhoods(rows), None
    for ids, vectors in _blocks(queries, block_bytes):
        shared = spark.sparkContext.broadcast((np.array(ids, np.int64), vectors))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            best = BestRows(q, k)
            for b in batches:
                if b.num_rows:
                    own, x = b.column(0).to_numpy(), _units(b.column(1))
                    cuts = np.flatnonzero(np.diff(b.column(2).to_numpy())) + 1
                    for i in np.split(np.arange(b.num_rows), cuts):
                        best.add(own[i], x[i])
            real = best.score > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(names[:, None], real.shape)[real]), pa.array(best.id[real]), pa.array(best.score[real])], names=["query_id", "id", "score"])

        part = near.select("id", "x", "centre").mapInArrow(run, "query_id long, id long, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        part = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "query_id long, id long, score double, rank int") if out is None else out
