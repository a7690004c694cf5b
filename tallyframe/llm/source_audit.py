"""How far the sources of a language diverge, by exact counts of its vocabulary.

Pass 1 counts exact document frequencies; a language keeps the terms of at least MIN_DOCS of its documents. Pass 2 recounts
them in the whole texts with an Aho-Corasick automaton a language, whose words are the kept terms between delimiters, so
that a term never matches inside another; texts are brought to one delimiter first. The counts are sparse postings
(language, source, term, count). Smoothed shares follow in integers. The postings of some terms fill a matrix of terms by
sources, whose empty cells have the share of a count of 0, and each pair of its columns adds to that pair's divergence;
no row for a term and a pair exists. Sources beyond SOURCES go in blocks, so matrices are bounded, too.

Automata have a bounded size: a language's vocabulary beyond AUTOMATON_CHARS is cut into shards by a hash of the term, and
its texts are then dealt out, term by term, to the shards' tasks, so that the work stays in proportion to the texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import discard, filesystem, prepare, table, text_column, work_path, written

MIN_DOCS, TOP_TERMS, SCALE = 3, 200, 1_000_000_000
#: Characters of the terms of an automaton (about 40 bytes of memory each), entries of a task's partial counts, characters
#: scanned at a time, and sources in a block of a matrix.
AUTOMATON_CHARS, HELD, SCAN_CHARS, SOURCES = 5 << 20, 300_000, 1 << 20, 1000
#: Delimiters are 00-40, 5B-60 and 7B-7F; only A-Z are lower-cased.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:0x41] = _PLAIN[0x5B:0x61] = _PLAIN[0x7B:0x80] = 0x20
_PLAIN[0x41:0x5B] += 0x20
_automata: dict[tuple, tuple] = {}


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _plain(b: pa.RecordBatch) -> tuple[bytes, list[int]]:
    """The batch's texts, delimiters as blanks and A-Z lower-cased, and their offsets."""
    raw, offsets = text_column(b)
    return _PLAIN[raw].tobytes(), offsets.tolist()


def _strings(values: list) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, df): in how many documents of its language a term occurs."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, c in found.items():
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), _strings(list(c)), pa.array(list(c.values()), pa.int64())], names=["lang", "term", "n"])
            found.clear()

        for b in batches:
            data, at = _plain(b)
            for i, lang in enumerate(b.column(0).to_pylist()):
                found.setdefault(lang, Counter()).update(set(data[at[i] : at[i + 1]].split()))
            if sum(map(len, found.values())) > HELD:
                yield from flushed()
        yield from flushed()

    counted = docs.select("lang", "source", "text").mapInArrow(run, "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("df"))


def _automaton(path: str, lang: str, lang_hash: int, shard: int) -> tuple:
    """(automaton over padded terms, the terms) of one shard of a language; a worker keeps shards of AUTOMATON_CHARS in all."""
    import ahocorasick
    import pyarrow.dataset as ds

    key = (path, lang, shard)
    if key not in _automata:
        fs, root = filesystem(path)
        folder, words = f"{root}/lang_hash={lang_hash}/shard={shard}", []
        if fs.get_file_info(folder).type.name == "Directory":  # else no kept term has this hash
            words = ds.dataset(folder, filesystem=fs, format="parquet").to_table(columns=["term"], filter=ds.field("lang") == lang).column(0).to_pylist()
        size = sum(map(len, words))
        if size + sum(x[2] for x in _automata.values()) > AUTOMATON_CHARS:
            _automata.clear()
        found = ahocorasick.Automaton()
        for i, w in enumerate(words):
            found.add_word(f" {w} ", i)
        found.make_automaton()
        _automata[key] = found, words, size
    return _automata[key][:2]


def _windows(plain: bytes) -> Iterator[str]:
    """A text in stretches of about SCAN_CHARS bytes, cut at delimiters and with one at either end."""
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + SCAN_CHARS)
        end = len(plain) if end < 0 else end
        yield f" {plain[at:end].decode()} "
        at = end


def shard_of(term: bytes, shards: int) -> int:
    return zlib.crc32(term) % shards


def postings(docs: DataFrame, sizes: DataFrame, path: str) -> DataFrame:
    """(lang, source, term, n): occurrences of the kept terms, recounted by the automata in path. sizes: lang, lang_hash, shards.
    Texts of a source meet in few tasks (a large source in several, by a hash), so that few partial counts are left."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(batches):
            data, at = _plain(b)
            out: dict[tuple, list[bytes]] = {}
            for i, (lang, source, h, shards) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True)):
                for term in data[at[i] : at[i + 1]].split():
                    out.setdefault((lang, source, h, shard_of(term, shards)), []).append(term)
            keys = list(out)
            columns = [pa.array([x[c] for x in keys], t) for c, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns[:2], _strings([b" ".join(v) for v in out.values()]), *columns[2:], pa.array([k % 97] * len(keys), pa.int64())], names=["lang", "source", "text", "lang_hash", "shard", "salt"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, np.ndarray] = {}

        def flushed(lang: str, h: int, shard: int) -> Iterator[pa.RecordBatch]:
            words = _automaton(path, lang, h, shard)[1]
            for source, c in counts.items():
                some = np.flatnonzero(c)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array([words[i] for i in some.tolist()]), pa.array(c[some])], names=["lang", "source", "term", "n"])
            counts.clear()

        last = None
        for b in batches:
            data, at = _plain(b)
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 3, 4, 1)), strict=True)):
                groups.setdefault(key, []).append(i)
            for (*of, source), rows in groups.items():
                if last is not None and (of != last or sum(map(len, counts.values())) > 8 << 20):
                    yield from flushed(*last)
                last = of
                automaton, words = _automaton(path, *of)
                if not words:
                    continue
                c = counts.setdefault(source, np.zeros(len(words), np.int64))
                for text in _windows(b" ".join(data[at[i] : at[i + 1]] for i in rows)):
                    c += np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=len(words))
        if last is not None:
            yield from flushed(*last)

    rows = docs.join(sizes, "lang")
    order = ("lang", "lang_hash", "shard", "source")
    whole = rows.where("shards = 1").select("lang", "source", "text", "lang_hash", F.lit(0).alias("shard"), F.xxhash64("text").alias("salt"))
    found = whole.repartitionByRange(*order, "salt").sortWithinPartitions("lang", "shard").drop("salt").mapInArrow(scan, _POSTING)
    if (sizes.agg(F.max("shards")).first()[0] or 0) > 1:
        cut = rows.where("shards > 1").select("lang", "source", "text", "lang_hash", "shards").mapInArrow(deal, "lang string, source string, text string, lang_hash long, shard int, salt long")
        found = found.union(cut.repartition(*order, "salt").sortWithinPartitions("lang", "shard").drop("salt").mapInArrow(scan, _POSTING))
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


_POSTING = "lang string, source string, term string, n long"


def pair_sums(shares: DataFrame, groups_path: str) -> DataFrame:
    """(lang, a, b, value): the sum of f over the language's terms, for each pair of its sources. shares: lang, term, place (the
    source's number in its language), blocks (of SOURCES sources), p. groups_path: a table of lang, source, place, p0."""
    own = F.col("place") / SOURCES
    i, every = F.floor(own).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    cell = lambda a, b: F.struct(a.alias("i"), b.alias("j"))
    # A posting goes to each block of pairs that its source is on a side of; with up to SOURCES sources, to one.
    cells = F.array_distinct(F.concat(F.transform(every, lambda j: cell(i, j)), F.transform(every, lambda j: cell(j, i))))
    rows = shares.select("lang", "term", "place", "p", F.explode(cells).alias("c")).groupBy("lang", "c", "term")
    rows = rows.agg(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), "p")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        last, names, p0, sums = None, [], None, None

        def closed() -> pa.RecordBatch:
            (lang, i, j), (m, n) = last, sums.shape
            a, b = np.repeat(np.arange(m), n) + i * SOURCES, np.tile(np.arange(n), m) + j * SOURCES
            real = np.flatnonzero(a != b)
            text = lambda x: pa.array([names[k] for k in x.tolist()], pa.string())
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(real), pa.string()), text(a[real]), text(b[real]), pa.array(sums.ravel()[real])], names=["lang", "a", "b", "value"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), strict=True))
            lists = batch.column(3)
            edge = lists.offsets.to_numpy()
            flat = lists.values
            place, p = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if keys[lo] != last:
                    if last is not None:
                        yield closed()
                    if last is None or keys[lo][0] != last[0]:
                        fs, root = filesystem(groups_path)
                        t = ds.dataset(root, filesystem=fs, format="parquet").to_table(columns=["source", "place", "p0"], filter=ds.field("lang") == keys[lo][0]).sort_by("place")
                        names, p0 = t.column("source").to_pylist(), t.column("p0").to_numpy()
                    last = keys[lo]
                    sums = np.zeros(tuple(len(p0[x * SOURCES : (x + 1) * SOURCES]) for x in last[1:]), np.int64)
                row, at, q = np.repeat(np.arange(hi - lo), np.diff(edge[lo : hi + 1])), place[edge[lo] : edge[hi]], p[edge[lo] : edge[hi]]
                sides = []
                for x in last[1:]:
                    side = np.tile(p0[x * SOURCES : (x + 1) * SOURCES], (hi - lo, 1))
                    mine = at // SOURCES == x
                    side[row[mine], at[mine] - x * SOURCES] = q[mine]
                    sides.append(side)
                for k in range(sums.shape[0]):
                    d = sides[0][:, k : k + 1] - sides[1]
                    sums[k] += (d * d // sides[1]).sum(axis=0)
        if last is not None:
            yield closed()

    flat = rows.select("lang", F.col("c.i").alias("i"), F.col("c.j").alias("j"), "own").sortWithinPartitions("lang", "i", "j")
    return flat.mapInArrow(run, "lang string, a string, b string, value long")


def share(count: str, total: str, terms: str) -> str:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for any count."""
    small = f"{SCALE}L * ({count} + 1L) div ({total} + {terms})"
    large = f"(cast({SCALE} as decimal(38, 0)) * ({count} + 1L)) div cast({total} + {terms} as decimal(20, 0))"
    return f"1 + case when {count} < 9000000000 then {small} else {large} end"


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank. Part 'pair': a row for each other source of the language, by their divergence over all
    kept terms; part 'term': the terms that a source has more of than its language, to rank TOP_TERMS. A null text, lang or
    source is an empty string; a document without terms still names its source; a language without kept terms has pairs
    of value 0 and no terms. Repeated rows are documents of their own. A very long text is scanned in stretches. No
    documents, no rows. Other columns are ignored."""
    spark, rows = docs.sparkSession, _rows(docs)
    kept = written(document_frequencies(rows).where(F.col("df") >= MIN_DOCS).select("lang", "term"), "audit-terms")
    size = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.ceil(F.sum(F.length("term") + 2) / AUTOMATON_CHARS).cast("int").alias("shards"))
    size = written(size.withColumn("lang_hash", F.xxhash64("lang")), "audit-languages")
    path, groups_path = work_path(spark, "audit-automata"), work_path(spark, "audit-groups")
    by_shard = kept.join(size, "lang").select("lang", "term", "lang_hash", (F.crc32(F.col("term").cast("binary")) % F.col("shards")).cast("int").alias("shard"))
    by_shard.repartition("lang_hash", "shard").write.partitionBy("lang_hash", "shard").parquet(path)
    counts = written(postings(rows, size.select("lang", "lang_hash", "shards"), path), "audit-postings")
    # Groups, and what each needs: its total, its language's number of terms, and its number in the language.
    total = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(total, ["lang", "source"], "left").join(size, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.coalesce("terms", F.lit(0).cast("long")).alias("terms")).withColumn("p0", F.expr(f"case when terms > 0 then {share('0L', 'total', 'terms')} end"))
    groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).write.parquet(groups_path)
    groups = spark.read.parquet(groups_path)
    blocks = groups.groupBy("lang").agg((F.floor((F.count("*") - 1) / SOURCES) + 1).cast("int").alias("blocks"))
    shares = counts.join(groups.join(blocks, "lang"), ["lang", "source"]).select("lang", "source", "term", "place", "blocks", F.expr(share("n", "total", "terms")).alias("p"))

    f = lambda p, q: f"(({p} - {q}) * ({p} - {q}) div {q})"
    a, b = (groups.select("lang", F.col("source").alias(x)) for x in "ab")
    none = a.join(b, "lang").where("a <> b").select("lang", "a", "b", F.lit(0).cast("long").alias("value"))
    pairs = none.union(pair_sums(shares, groups_path)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")

    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(of_lang, "lang").select("lang", "term", F.expr(share("n", "total", "terms")).alias("q"))
    terms = shares.join(whole, ["lang", "term"]).where("p > q").selectExpr("lang", "source", "'term' as part", "term as item", f"{f('p', 'q')} as value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, terms)]
    discard(kept)
    return ranked[0].union(ranked[1].where(F.col("rank") <= TOP_TERMS))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents. Nulls, long and empty texts, repeated rows, clashing columns and empty tables: see audit()."""
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op12_source_divergence": op12_source_divergence}
SQL = {
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
o AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM e),
w AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM e GROUP BY lang, term),
v AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
p AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
t AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, ((s.p - w.q) * (s.p - w.q) // w.q)::BIGINT AS value FROM s JOIN w ON s.lang = w.lang AND s.term = w.term WHERE s.n > 0 AND s.p > w.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM p UNION ALL SELECT * FROM t))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
""",
}
