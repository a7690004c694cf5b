"""Token-id files with a shared zstandard dictionary.

Documents are range-partitioned by doc_id and sorted, so shard after shard holds ascending ids. A dictionary is trained
once on the serialized ids of a bounded sample; every document is a zstandard frame of its own under that dictionary,
so a short document can be read alone: the index names its shard, offset and length.

Shard file: magic, dictionary SHA-256, then per document a frame; at the end the index (doc_id, null flag, offset,
length, number of ids) and a footer with the index's place. Integers are little-endian. A shard appears under its name
when it is complete, and a repeated task writes the same bytes again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import AtomicFile, filesystem, one_each, prepare, table, text_column, work_path, written
from tallyframe.llm.tokens import encoder, slices

VOCABULARY, END_ID = "byte_bpe_50k.json", 0
MAGIC = b"TFIDS\x01\x00\x00"
_ENTRY = np.dtype([("doc_id", "<i8"), ("null", "<i8"), ("offset", "<i8"), ("length", "<i8"), ("n", "<i8")])
_FOOTER = "<qq8s"
#: The dictionary's size, and the bounds of the sample that it is trained on: documents, and bytes of ids of each.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_BYTES = 64 << 10, 1000, 8 << 10
LEVEL = 3
#: A task begins another shard when one has this many bytes or documents; the index in memory is bounded by it.
SHARD_BYTES, SHARD_DOCS = 256 << 20, 1 << 20


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary, or the samples themselves where the trainer refuses them: where they are fewer than it needs."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def sample_ids(docs: DataFrame, vocabulary: str, end_id: int) -> list[bytes]:
    """Ids of at most SAMPLE_DOCS documents, chosen by a hash of the id, at most SAMPLE_BYTES of each; sorted. Of rows that
    share an id, one text is used."""
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()
    texts = one_each(docs.join(F.broadcast(chosen), "doc_id"), "doc_id").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for b in batches:
            for _, part in slices(*text_column(b)):
                yield pa.RecordBatch.from_arrays([pa.array([(x + end)[:SAMPLE_BYTES] for x in enc.encode(part)], pa.binary())], names=["ids"])

    return sorted(bytes(r[0]) for r in texts.mapInArrow(run, "ids binary").collect())


def write_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Writes the shards and returns their manifest: (pid, part, path, docs, tokens, dictionary). A null text is empty: it has
    the end id alone. Null ids come first; repeated rows are documents of their own, and rows that share an id are in the
    order of a hash of their texts, by which a frequent id is dealt out, too. A very long text is one frame. No documents, no
    shards. Other columns are ignored."""
    import zstandard

    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    content = train_dictionary(sample_ids(docs, vocabulary, end_id))
    name = hashlib.sha256(content).hexdigest()
    out = AtomicFile(folder, f"{name}.dict")
    out.write(content)
    out.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, pid = encoder(vocabulary), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        z, file, rows, total, part = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(content)), None, [], 0, 0

        def closed() -> pa.RecordBatch:
            index = np.array(rows, _ENTRY).tobytes()
            at = file.write(index)
            file.write(struct.pack(_FOOTER, at, len(rows), MAGIC))
            file.close()
            one = [pa.array([x], pa.int64()) for x in (pid, part, len(rows), total)]
            return pa.RecordBatch.from_arrays([*one[:2], pa.array([file.path]), *one[2:], pa.array([name])], names=["pid", "part", "path", "docs", "tokens", "dictionary"])

        for b in batches:
            raw, offsets = text_column(b)
            ids = b.column(0).to_pylist()
            for i, texts in slices(raw, offsets):
                if file is not None and (file.size > SHARD_BYTES or len(rows) >= SHARD_DOCS):
                    yield closed()
                    file, rows, total, part = None, [], 0, part + 1
                if file is None:
                    file = AtomicFile(folder, f"shard-{pid:08d}-{part:04d}.tfids")
                    file.write(MAGIC + bytes.fromhex(name))
                for d, x in zip(ids[i : i + len(texts)], enc.encode(texts), strict=True):
                    x += end
                    frame = z.compress(x)
                    rows.append((d or 0, d is None, file.write(frame), len(frame), len(x) // 4))
                    total += len(x) // 4
        if file is not None:
            yield closed()

    ordered = docs.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").drop("_h")
    return written(ordered.mapInArrow(run, "pid long, part long, path string, docs long, tokens long, dictionary string"), "token-manifest")


class Shard:
    """Random access to one shard file."""

    def __init__(self, folder: str, path: str):
        import zstandard

        self.fs, root = filesystem(folder)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        at, n, magic = struct.unpack(_FOOTER, self.file.read_at(struct.calcsize(_FOOTER), size - struct.calcsize(_FOOTER)))
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is no token-id shard")
        self.dictionary = head[len(MAGIC) :].hex()
        with self.fs.open_input_stream(f"{root}/{self.dictionary}.dict") as f:
            content = f.read()
        if hashlib.sha256(content).hexdigest() != self.dictionary:
            raise ValueError(f"the dictionary of {path} has changed")
        self.index = np.frombuffer(self.file.read_at(n * _ENTRY.itemsize, at), _ENTRY)
        self.z = zstandard.ZstdDecompressor(dict_data=_dictionary(content))

    def ids(self, i: int) -> bytes:
        e = self.index[i]
        return self.z.decompress(self.file.read_at(int(e["length"]), int(e["offset"])), max_output_size=int(e["n"]) * 4)


def read_files(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files of a manifest, read from the files."""
    spark = manifest.sparkSession
    prepare(spark)
    # One row a shard: bounded by the number of partitions and of SHARD_BYTES.
    shards = sorted((r["pid"], r["part"], r["path"], r["tokens"]) for r in manifest.collect())
    bases = [0, *accumulate(t for *_, t in shards)][:-1]
    plan = spark.createDataFrame([(p, b) for (_, _, p, _), b in zip(shards, bases, strict=True)], "path string, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(folder, path)
                starts = base + np.r_[0, np.cumsum(shard.index["n"])[:-1]]
                for at in range(0, len(starts), 512):
                    part = shard.index[at : at + 512]
                    data = [shard.ids(i) for i in range(at, at + len(part))]
                    cols = [pa.array(part["doc_id"].astype(np.int64), mask=part["null"] == 1), pa.array(starts[at : at + 512]), pa.array(part["n"].astype(np.int64)), pa.array([zlib.crc32(x) for x in data], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    yield pa.RecordBatch.from_arrays(cols + ([pa.array(data, pa.binary())] if with_ids else []), names=names + (["ids"] if with_ids else []))

    plan = plan.repartition(max(1, len(shards)), "path") if shards else plan
    return plan.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def op8_zstd_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all documents, from their files. Nulls, repeated rows, very long texts,
    clashing columns and empty tables: see write_files()."""
    folder = work_path(spark, "token-files")
    return read_files(write_files(table(spark, sf_dir, "documents"), folder), folder)


QUERIES = {"op8_zstd_token_files": op8_zstd_token_files}
SQL: dict[str, str] = {}
