"""Ranked lexical search by windows of doc_ids.

Pass 1 turns each whole text into its length and its postings of the queries' terms (term number, occurrences), and counts the
corpus statistics. Pass 2 deals these rows out by ranges of doc_id, sorted, and goes through them in windows of fixed width:
the rows of a window get places in arrays that fit a core's cache, its postings are sorted by term, and for each query
the terms' contributions are added to its array at their places; a bitset notes the occupied ones. What is harvested goes
into the query's heap of the best k, and heaps are emitted once a task, so k rows a query and task are left to rank.

A window's rows are bounded: one id that is frequent is cut into several windows, and ids are dealt out by a hash of their
rows, too. All sums are 64-bit integers, so the order of additions does not matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import prepare, table, text_column, written

TOP = 10
#: Ids of a window, and the most rows that share one set of arrays: 64 KB a query's sums.
WINDOW, PLACES = 1 << 13, 1 << 13
#: Queries that one pass over the postings serves: their terms are sent to the tasks, so they are bounded in number and bytes.
BLOCK_QUERIES, BLOCK_BYTES = 5000, 8 << 20
#: Delimiters are the ASCII characters but digits and letters; only A-Z are lower-cased.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:0x30] = _PLAIN[0x3A:0x41] = _PLAIN[0x5B:0x61] = _PLAIN[0x7B:0x80] = 0x20
_PLAIN[0x41:0x5B] += 0x20


def terms_of(text: str | None) -> list[bytes]:
    return _PLAIN[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split()


def query_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Blocks of (item_id, sorted distinct terms) in ascending item_id. Rows come to the driver one after the other, a block
    of bounded size is held. A query of BLOCK_BYTES or more is a block of its own."""
    block, size = [], 0
    for row in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        found = sorted(set(terms_of(row.text)))
        if block and (len(block) >= BLOCK_QUERIES or size + sum(map(len, found)) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((row.item_id, found))
        size += sum(map(len, found))
    if block:
        yield block


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): all terms of a text with repeats, and its postings of the vocabulary, as little-endian unsigned
    32-bit integers. Only rows with a term."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for b in batches:
            raw, offsets = text_column(b)
            data, at = _PLAIN[raw].tobytes(), offsets.tolist()
            rows, lengths, terms, counts = [], [], [], []
            for i in range(b.num_rows):
                words = data[at[i] : at[i + 1]].split()
                if not words:
                    continue
                ids, k = np.unique(np.fromiter((number.get(w, -1) for w in words), np.int64, len(words)), return_counts=True)
                known = ids >= 0
                rows.append(i)
                lengths.append(len(words))
                terms.append(ids[known].astype("<u4").tobytes())
                counts.append(k[known].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms binary, counts binary")


def frequencies(found: DataFrame, size: int) -> np.ndarray:
    """In how many rows each of the `size` terms occurs: one array a task, added up on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            raw, _ = text_column(b, "terms")
            df += np.bincount(raw.view("<u4"), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for term, df in found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class WindowScorer:
    """Scores one window after the other for all queries of a block, and keeps each query's best k."""

    def __init__(self, queries: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.weights, self.n_docs, self.n_terms, self.k = weights, n_docs, n_terms, k
        self.queries = [np.array(q, np.int64) for q in queries]
        self.heaps: list[list[tuple]] = [[] for _ in queries]
        self.sums = np.zeros(PLACES, np.int64)

    def _norms(self, n: np.ndarray) -> np.ndarray:
        """8 times m of each row; in Python's integers where the product may pass 64 bits."""
        if 90 * self.n_docs * int(n.max()) < 1 << 62:
            m = 10 + 90 * n * self.n_docs // self.n_terms
        else:
            m = np.array([10 + 90 * x * self.n_docs // self.n_terms for x in n.tolist()], np.int64)
        return 8 * m

    def window(self, ids: list, n: np.ndarray, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> None:
        """ids in ascending order; terms and counts: the rows' postings in a row, `sizes` of each."""
        place = np.repeat(np.arange(len(ids)), sizes)
        tf = counts.astype(np.int64)
        add = self.weights[terms] * (1_000_000_000 * tf // (1000 * tf + self._norms(n)[place]))
        order = np.argsort(terms, kind="stable")
        terms, place, add = terms[order], place[order], add[order]
        begin = np.searchsorted(terms, np.arange(len(self.weights) + 1))
        occupied = np.zeros(-(-len(ids) // 8) * 8, bool)
        sums = self.sums[: len(ids)]
        for q, heap in zip(self.queries, self.heaps, strict=True):
            for t in q.tolist():
                a, z = begin[t], begin[t + 1]
                if a < z:
                    at = place[a:z]  # a term is once in a row: no place is twice in a list
                    sums[at] += add[a:z]
                    occupied[at] = True
            bits = np.packbits(occupied)
            if not bits.any():
                continue
            at = np.flatnonzero(occupied[: len(ids)])
            self._harvest(heap, ids, at, sums[at])
            sums[at] = 0
            occupied[:] = False

    def _harvest(self, heap: list[tuple], ids: list, at: np.ndarray, score: np.ndarray) -> None:
        floor = heap[0][0] if len(heap) == self.k else 1
        at, score = at[score >= floor], score[score >= floor]
        if len(at) > self.k:  # the k-th best of the window, with its ties
            some = score >= np.partition(score, -self.k)[-self.k]
            at, score = at[some], score[some]
        for i, s in zip(at.tolist(), score.tolist(), strict=True):
            entry = (s, ids[i] is None, -(ids[i] or 0))  # a null id comes first among equal scores, as in ascending order
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def scored(found: DataFrame, block: list[tuple], vocabulary: dict[bytes, int], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(q, doc_id, score): at most k rows a query and task."""
    queries = found.sparkSession.sparkContext.broadcast([[vocabulary[t] for t in terms] for _, terms in block])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = WindowScorer(queries.value, weights, n_docs, n_terms, k)
        held: list[tuple] = []

        def close() -> None:
            sizes = np.array([len(x[2]) // 4 for x in held], np.int64)
            terms, counts = (np.frombuffer(b"".join(x[c] for x in held), "<u4").astype(np.int64) for c in (2, 3))
            scorer.window([x[0] for x in held], np.array([x[1] for x in held], np.int64), terms, counts, sizes)
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (len(held) == PLACES or (row[0] is None) != (held[0][0] is None) or row[0] is not None and row[0] // WINDOW != held[0][0] // WINDOW):
                    close()
                held.append(row)
        if held:
            close()
        best = [(q, None if null else -i, s) for q, heap in enumerate(scorer.heaps) for s, null, i in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in best], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["q", "doc_id", "score"])

    rows = found.withColumn("_h", F.xxhash64("terms")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id").drop("_h")
    return rows.mapInArrow(run, "q int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score: the k documents of the highest score above 0 for each row of items, equal scores by
    ascending doc_id. A null text has no terms: such a document is not counted, such an item has no rows. Repeated
    documents are documents of their own (equal scores of one id have consecutive ranks), repeated items have rows each;
    a null doc_id comes first among equal scores. Very long texts are one posting list. Without documents or items, no rows.
    Other columns are ignored."""
    spark, out = docs.sparkSession, None
    for block in query_blocks(items):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        if not vocabulary:
            continue
        found = written(vectors(docs, vocabulary), "search-vectors")
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        weights = np.array([weight(n_docs, int(x)) for x in frequencies(found, len(vocabulary))], np.int64)
        best = scored(found, block, vocabulary, weights, n_docs, n_terms, k)
        order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], "q int, item_id long")
        part = written(ranked.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"), "search-best")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of all for every benchmark item. Nulls, repeated rows, long and empty texts, clashing columns and empty
    tables: see search()."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_lexical_search": op13_lexical_search}
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = {
    "op13_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT rid, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
z AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM s),
i AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), z),
c AS (SELECT p.rid, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * s.n * z.nd) // z.l))) AS c FROM p JOIN w ON p.term = w.term JOIN s ON s.rid = p.rid, z),
t AS (SELECT i.item_id, s.rid, s.doc_id, sum(c.c)::BIGINT AS score FROM i JOIN c ON i.term = c.term JOIN s ON s.rid = c.rid GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM t WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
""",
}
