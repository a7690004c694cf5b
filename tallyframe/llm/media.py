"""Interleaved document sequences.

HTML becomes an ordered array of structs: text, and media references with their captions. Payloads live in blob shards
of a content-addressed store; an index (digest, shard, offset, length) is joined to the references by digest, so that
payloads are read where they lie and are never shuffled. Positions and captions stay with their reference.

A payload is stored as an 8-bit greyscale PNG, 64 samples wide: lossless, one sample a byte.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import AtomicFile, filesystem, prepare, table, text_column, work_path, written

WIDTH = 64
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
SEQUENCE_DDL = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"
#: Stored bytes that one task reads back, about.
READ_BYTES = 16 << 20
#: Digests that a task remembers, so as to store equal payloads once; beyond it forgets, and the index keeps one copy.
SEEN = 1 << 18


class _Sequence(HTMLParser):
    """Text blocks and media elements in document order. A caption is the figcaption of the media's figure, else alt."""

    BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "figcaption", "blockquote", "pre", "nav", "header", "footer", "main", "aside", "title", "body", "head", "html"}
    MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "media", "embed": "media"}
    SKIP = {"script", "style", "template", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.skip, self.figure, self.caption = 0, None, None

    def end_block(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if not text:
            return
        if self.caption is not None:
            self.caption.append(text)
        else:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        if tag in self.BLOCKS or tag in self.MEDIA:
            self.end_block()
        if tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.caption = []
        elif tag in self.MEDIA:
            a = dict(attrs)
            ref = a.get("src") or a.get("data-src")
            if ref:
                self.items.append({"kind": self.MEDIA[tag], "text": None, "ref": ref, "caption": a.get("alt") or None})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in self.SKIP:
            self.skip -= 1

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        if tag in self.BLOCKS:
            self.end_block()
        if tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join(self.caption), None
            for x in self.items[self.figure or 0 :] if self.figure is not None and text else []:
                if x["ref"] is not None:
                    x["caption"] = text
        elif tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def parse_sequence(html: str | None) -> list[dict]:
    """The ordered items of a page; an empty list for a null or empty page."""
    if not html:
        return []
    p = _Sequence()
    p.feed(html)
    p.close()
    p.caption = None
    p.end_block()
    return [{"pos": i, **x} for i, x in enumerate(p.items)]


def sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, items): the interleaved sequence of each row's HTML."""
    prepare(pages.sparkSession)
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse_sequence(x) for x in b.column(1).to_pylist()], kind)], names=[key, "items"])

    rows = pages.select(key, F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, items {SEQUENCE_DDL}")


def png(samples: bytes) -> bytes:
    """A greyscale PNG of a positive multiple of WIDTH samples."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_HEAD + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def samples(image: bytes) -> bytes:
    """The samples of a PNG that png() wrote; checks every chunk's checksum."""
    if image[:8] != PNG_HEAD:
        raise ValueError("no PNG")
    at, data, shape = 8, [], None
    while at < len(image):
        n, name = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(name + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a PNG chunk is damaged")
        if name == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif name == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    return rows[:, 1:].tobytes()


def payload(text: bytes) -> bytes:
    """text with zero bytes up to a positive multiple of WIDTH."""
    return text + b"\0" * (-len(text) % WIDTH if text else WIDTH)


def page(text: bytes, digest: str, rows: int) -> str:
    """A page with the structure of the text: a paragraph for each line that is not blank (its number and length), and the
    figure of the payload where half of these lines are over."""
    lines = [len(x) for x in text.split(b"\n") if x.strip()]
    blocks = [f"<p>line {i}: {n} bytes</p>" for i, n in enumerate(lines)]
    blocks.insert(len(lines) // 2, f'<figure><img src="sha256:{digest}" alt="text"><figcaption>{len(text)} bytes as {rows} rows</figcaption></figure>')
    return f"<article>{''.join(blocks)}</article>"


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Stores each text's payload and returns (doc_id, n_bytes, html, digest, shard, offset, length): html refers to the
    payload by its digest; shard, offset and length are null where this task had stored an equal payload before."""
    prepare(docs.sparkSession)
    names = ["doc_id", "n_bytes", "html", "digest", "shard", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, seen, pid = None, set(), TaskContext.get().partitionId()
        for b in batches:
            raw, offsets = text_column(b)
            data, out = raw.tobytes(), []
            for doc_id, lo, hi in zip(b.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
                body = payload(data[lo:hi])
                digest = hashlib.sha256(body).hexdigest()
                place = (None, None, None)
                if digest not in seen:
                    seen.add(digest)
                    if len(seen) > SEEN:
                        seen.clear()
                    image = png(body)
                    file = file or AtomicFile(folder, f"blobs-{pid:08d}.bin")
                    place = (file.path, file.write(image), len(image))
                n = int(hi - lo)
                html = page(data[lo:hi], digest, len(body) // WIDTH)
                out.append((doc_id, n, html, digest, *place))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if file is not None:
            file.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ddl = "doc_id long, n_bytes long, html string, digest string, shard string, offset long, length long"
    return written(rows.mapInArrow(run, ddl), "media-store")


def resolve(refs: DataFrame, index: DataFrame) -> DataFrame:
    """refs (digest, ...) with the place of their payload: shard, offset, length. An unknown digest has nulls."""
    one = index.where("shard is not null").groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p"))
    return refs.join(one.select("digest", "p.shard", "p.offset", "p.length"), "digest", "left")


_FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(index: DataFrame, folder: str) -> DataFrame:
    """One row for each stored digest, computed from the bytes read back."""
    prepare(index.sparkSession)
    names = [x.split()[0] for x in _FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        path, file = None, None
        for b in batches:
            out = []
            for digest, shard, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != path:
                    path, file = shard, fs.open_input_file(shard)
                image = file.read_at(length, offset)
                body = samples(image)
                x = np.frombuffer(body, np.uint8)
                high = np.bincount(x >> 5, minlength=8)
                rows = x.reshape(-1, WIDTH)
                text = f"{WIDTH}x{len(rows)};mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};hist={','.join(map(str, high))};edges={int((rows[:, 1:] != rows[:, :-1]).sum())}"
                out.append((digest, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(image), hashlib.sha256(image).hexdigest(), text))
            if out:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    one = index.where("shard is not null").groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p"))
    # What is shuffled is small, the work is in the files: as many tasks as the stored bytes ask for.
    stored = index.agg(F.sum("length")).collect()[0][0] or 0
    places = one.select("digest", "p.shard", "p.offset", "p.length").repartitionByRange(stored // READ_BYTES + 1, "shard", "offset").sortWithinPartitions("shard", "offset")
    return written(places.mapInArrow(run, _FEATURES), "media-features")


def text_media(docs: DataFrame, folder: str) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, and the reference's pos and caption in its interleaved sequence. Equal texts share one stored payload and
    have equal values. A null text is empty: 64 zero bytes. Null ids and repeated rows are rows like others. A very long
    text is one payload, held in memory by the task that stores or reads it. No documents, no rows. Other columns are
    ignored."""
    kept = store(docs, folder)
    parsed = _parsed(kept)
    refs = parsed.select("doc_id", "n_bytes", F.explode("items").alias("item")).where("item.ref like 'sha256:%'")
    refs = refs.select("doc_id", "n_bytes", F.substring_index("item.ref", ":", -1).alias("digest"), F.col("item.pos").alias("pos"), F.col("item.caption").alias("caption"))
    found = features(kept.select("digest", "shard", "offset", "length"), folder)
    return refs.join(found, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")


def _parsed(kept: DataFrame) -> DataFrame:
    """kept with its items; the key of sequences() is a struct, so that rows keep their own columns."""
    rows = kept.select(F.struct("doc_id", "n_bytes").alias("row"), "html")
    return sequences(rows, "row").select("row.doc_id", "row.n_bytes", "items")


def op6_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, digests and feature of the stored payload of every document, and the place and caption of its reference. Nulls,
    repeated rows, very long texts, clashing columns and empty tables: see text_media()."""
    return text_media(table(spark, sf_dir, "documents"), work_path(spark, "media"))


QUERIES = {"op6_interleaved_media": op6_interleaved_media}
SQL: dict[str, str] = {}
