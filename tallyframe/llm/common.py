"""Shared pieces of the training-data operators: the shared folder, written tables and byte-level word hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of characters outside [\x20\x09-\x0D].
SPACE = r"[\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch that a Python stage holds at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tallyframe-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tallyframe/{tag}-{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Deletes all written tables and files below the shared folder; results that read them are gone, too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tallyframe")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: cuts lineage and survives lost executors. The shuffles of
    the write go with its end, as nothing reads them any more."""
    spark, path = df.sparkSession, work_path(df.sparkSession, tag)
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the table of a DataFrame that written() returned, which must not be read any more."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_tallyframe_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="tallyframe-"), "tallyframe_package.zip")
    atexit.register(shutil.rmtree, out.parent, ignore_errors=True)
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path(root.name) / f.relative_to(root)))
    sc.addPyFile(str(out))
    sc._tallyframe_shipped = True


def prepare(spark: SparkSession) -> None:
    """For Python stages: the package on every executor, and Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES
    bytes, so that a worker's memory has a bound. The settings stay with the session: plans are lazy, and read them when
    they run."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out. A null id falls in fold 0: it is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def one_each(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row for each value of key: that whose text has the smallest hash, of equal hashes the smallest text."""
    order = Window.partitionBy(key).orderBy(F.xxhash64(text), text)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder in the shared store."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name only when it is complete; a second attempt replaces the first one's."""

    def __init__(self, folder: str, name: str):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.tmp = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out, self.size = self.fs.open_output_stream(self.tmp), 0

    def write(self, data: bytes) -> int:
        at, self.size = self.size, self.size + len(data)
        self.out.write(data)
        return at

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.path)


def text_column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_rng = np.random.default_rng(20240817)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE[_IS_SPACE] = 0
_TABLE_LOWER = _TABLE.copy()
_TABLE_LOWER[65:91] = _TABLE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {"n": 0}
#: Bytes of text hashed at a time; a longer text is cut at white space.
CHUNK = 1 << 20


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, CHUNK)
        for key, base in (("pow", _BASE), ("inv", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=np.uint64)
        _powers["n"] = size
    return _powers["pow"], _powers["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; takes and returns uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash_block(raw: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    space = _IS_SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    at = cuts[cuts < len(raw)]
    first[at] = ~space[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    powers, inverse = _power_tables(len(raw))
    values = (_TABLE_LOWER if lower else _TABLE)[raw] * powers[: len(raw)]
    return starts, mix(np.add.reduceat(values, starts) * inverse[starts])


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of consecutive texts, and each text's offsets into them. A-Z count as a-z if lower."""
    parts, starts, at, n = [], [], 0, len(raw)
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:  # cut after white space, so that no word is in two blocks
            back = np.flatnonzero(_IS_SPACE[raw[at:end]])
            while not len(back) and end < n:
                end = min(n, end + CHUNK)
                back = np.flatnonzero(_IS_SPACE[raw[at:end]])
            if end < n:
                end = at + int(back[-1]) + 1
        lo, hi = np.searchsorted(offsets, [at, end])
        s, h = _hash_block(raw[at:end], offsets[lo:hi] - at, lower)
        starts.append(s + at)
        parts.append(h)
        at = end
    every = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.searchsorted(every, offsets)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
