"""Legacy archive converter: ARC files of version 1 and 2 into WARC.

An ARC file starts with a version block (filedesc://...) whose second line gives the version and whose third line names
the fields of the record lines; every record is such a line, then as many bytes as the line declares. A converted
record gets a WARC-Record-ID, WARC-Date, WARC-Type and digests. Records with equal payloads of at least 1000 bytes are
stored once: the largest id is the response, all others revisit it.

Flow: pages become ARC shards (they stand for an existing legacy collection); pass 1 parses the shards into an index
(page_id, digest, shard, offset); the index decides on types by digest; pass 2 converts shard by shard, and the WARC
files are read back. Payloads move only inside the files; what is shuffled is the index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import AtomicFile, filesystem, prepare, table, work_path, written

#: Record lines by version. Fixed by the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Payloads shorter than this are always stored.
DEDUPE_BYTES = 1000
EPOCH = datetime(2001, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(data: bytes) -> bytes:
    """One gzip member, the same for the same data."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def clean_url(url: str | None) -> str:
    """A URL for a space-separated line: white space and control characters escaped; a null one becomes urn:unknown."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "") or "urn:unknown"


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 Legacy\n{ARC_FIELDS[version]}\n".encode()
    if version == 1:
        line = f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n"
    else:
        line = f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n"
    return line.encode() + body + b"\n"


def arc_record(name: str, version: int, page_id: int | None, url: str | None, html: bytes, offset: int) -> bytes:
    date = (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y%m%d%H%M%S")
    own = "-" if page_id is None else str(page_id)
    block = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\nX-Page-Id: {own}\r\n\r\n".encode() + html
    if version == 1:
        line = f"{clean_url(url)} 0.0.0.0 {date} text/html {len(block)}\n"
    else:
        line = f"{clean_url(url)} 0.0.0.0 {date} text/html 200 {hashlib.md5(block).hexdigest()} - {offset} {name} {len(block)}\n"
    return line.encode() + block + b"\n"


def write_arc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) as ARC shards, versions 1 and 2 in turn. Returns (shard)."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, file = TaskContext.get().partitionId(), None
        version = 1 + pid % 2
        name = f"legacy-{pid:08d}.arc.gz"
        for b in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file is None:
                    file = AtomicFile(folder, name)
                    file.write(member(arc_version_block(name, version, EPOCH.strftime("%Y%m%d%H%M%S"))))
                file.write(member(arc_record(name, version, page_id, url, (html or "").encode(), file.size)))
        if file is not None:
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([file.path])], names=["shard"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return written(rows.mapInArrow(run, "shard string"), "arc-shards")


class _Reader(io.BufferedReader):
    """A gzipped archive as one stream of bytes; members follow each other."""

    def __init__(self, fs, path: str):
        super().__init__(gzip.GzipFile(fileobj=fs.open_input_file(path)), 1 << 20)


def read_arc(stream: io.BufferedReader) -> Iterator[dict]:
    """Records of an ARC stream: fields by the names of its version block, the block, and the record's number."""
    first = stream.readline().decode("utf-8", "replace").split()
    if not first or not first[0].startswith("filedesc://"):
        raise ValueError("an ARC file begins with a filedesc record")
    block = stream.read(int(first[-1])).decode("utf-8", "replace").splitlines()
    version, names = int(block[0].split()[0]), block[1].split()
    if version not in ARC_FIELDS or names[-1] != "Archive-length":
        raise ValueError(f"unknown ARC version {block[0]!r}")
    number = 0
    while line := stream.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        # A field too many is a space in the URL, which some writers left there.
        parts = [" ".join(parts[: len(parts) - len(names) + 1]), *parts[len(parts) - len(names) + 1 :]]
        fields = dict(zip(names, parts, strict=True))
        length = int(fields["Archive-length"])
        body = stream.read(length)
        if len(body) != length:
            raise ValueError(f"record {number} is shorter than declared")
        yield {"version": version, "fields": fields, "block": body, "number": number}
        number += 1


def split_http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """(header with its blank line, payload, fields by lower-case name); a block without a header is all payload."""
    head, gap, rest = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return b"", block, {}
    fields = dict(re.findall(r"(?m)^([^:\r\n]+):[ \t]*([^\r\n]*)", head.decode("latin-1")))
    return head + gap, rest, {k.lower(): v for k, v in fields.items()}


def record_id(page_id: int | None, digest: str) -> str:
    """A version 8 UUID: 48 bits of the digest, then the page id, so that the id can be read from a reference."""
    v = (page_id or 0) & ((1 << 64) - 1)
    n = int(digest[:12], 16) << 80 | 8 << 76 | (v >> 62) << 64 | (page_id is None) << 66 | 2 << 62 | v & ((1 << 62) - 1)
    h = f"{n:032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_of(record: str) -> int | None:
    n = int(re.sub(r"^<urn:uuid:|[->]", "", record), 16)
    v = (n >> 64 & 3) << 62 | n & ((1 << 62) - 1)
    return None if n >> 66 & 1 else v - (1 << 64) if v >> 63 else v


def _base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def convert_record(record: dict, kind: str, refers_to: int | None) -> bytes:
    """The WARC record of an ARC record. A revisit keeps the HTTP header alone."""
    head, body, http = split_http(record["block"])
    f = record["fields"]
    page_id = None if http.get("x-page-id", "-") == "-" else int(http["x-page-id"])
    digest = hashlib.sha1(body).hexdigest()
    date = datetime.strptime(f["Archive-date"][:14].ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    block = record["block"] if kind == "response" else head
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", f["URL"]),
        ("WARC-IP-Address", f["IP-address"]),
        ("WARC-Payload-Digest", f"sha1:{_base32(digest)}"),
        ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).hexdigest())}"),
        ("Content-Type", "application/http; msgtype=response" if head else f["Content-type"]),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    return warc_record(fields, block)


def read_warc(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError("a WARC record begins with its version")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        block = stream.read(int(fields["content-length"]))
        digest = fields.get("warc-block-digest", "")
        if digest and digest != f"sha1:{_base32(hashlib.sha1(block).hexdigest())}":
            raise ValueError(f"{fields.get('warc-record-id')} is damaged")
        yield fields, block


_INDEX = pa.schema([("shard", pa.string()), ("number", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("size", pa.int64())])


def index_arc(shards: DataFrame, folder: str) -> DataFrame:
    """(shard, number, page_id, digest, size) of every record of the ARC shards, by parsing them."""
    prepare(shards.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for b in batches:
            for shard in b.column(0).to_pylist():
                out = []
                for r in read_arc(_Reader(fs, shard)):
                    _, body, http = split_http(r["block"])
                    own = http.get("x-page-id", "-")
                    out.append((shard, r["number"], None if own == "-" else int(own), hashlib.sha1(body).hexdigest(), len(body)))
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _INDEX, strict=True)], schema=_INDEX)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _INDEX, strict=True)], schema=_INDEX)

    return written(_spread(shards).mapInArrow(run, "shard string, number long, page_id long, digest string, size long"), "arc-index")


def _spread(shards: DataFrame) -> DataFrame:
    """One task a shard, near enough; there is one row a shard."""
    return shards.repartition(max(1, shards.count()), "shard")


def decide(index: DataFrame) -> DataFrame:
    """index with record_type and refers_to. Of equal payloads of DEDUPE_BYTES or more, the largest page_id is the
    response (a null one only if all are), the first of its records if it is repeated."""
    large = index.where(F.col("size") >= DEDUPE_BYTES)
    key = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("p"), "shard", "number")
    best = large.groupBy("digest").agg(F.max(key).alias("best"), F.count(F.lit(1)).alias("k")).where("k > 1").select("digest", "best")
    joined = index.join(best, "digest", "left")
    other = F.col("best").isNotNull() & (F.col("size") >= DEDUPE_BYTES) & ((F.col("best.shard") != F.col("shard")) | (F.col("best.number") != F.col("number")))
    back = F.when(other & (F.col("best.p") != -(1 << 63)), F.col("best.p"))
    return joined.select("shard", "number", F.when(other, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), back.alias("refers_to"))


def convert(plan: DataFrame, folder: str, shards: int) -> DataFrame:
    """Converts the ARC shards of plan (shard, number, record_type, refers_to) to WARC shards. Returns (warc). shards: how
    many there are; what is shuffled is small, the work is in the files, so there is a task for each."""
    prepare(plan.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        shard, records, file = None, None, None
        for b in batches:
            done = []
            for own, number, kind, back in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != shard:
                    if file is not None:
                        file.close()
                        done.append(file.path)
                    shard, records = own, read_arc(_Reader(fs, own))
                    name = own.rpartition("/")[2].removesuffix(".arc.gz")
                    file = AtomicFile(folder, f"{name}.warc.gz")
                    info = f"software: legacy archive converter\r\nformat: WARC File Format 1.1\r\nsource: {name}.arc.gz\r\n".encode()
                    first = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, hashlib.sha1(name.encode()).hexdigest())), ("WARC-Date", EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ")), ("Content-Type", "application/warc-fields")]
                    file.write(member(warc_record(first, info)))
                r = next(records)
                if r["number"] != number:
                    raise ValueError(f"{shard} has changed")
                file.write(member(convert_record(r, kind, back)))
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["warc"])
        if file is not None:
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([file.path])], names=["warc"])

    rows = plan.select("shard", "number", "record_type", "refers_to").repartition(max(1, shards), "shard").sortWithinPartitions("shard", "number")
    return written(rows.mapInArrow(run, "warc string"), "warc-shards")


def read_back(shards: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records in WARC shards (warc)."""
    prepare(shards.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                out = []
                for f, block in read_warc(_Reader(fs, path)):
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    _, body, http = split_http(block)
                    digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                    revisit = f["warc-type"] == "revisit"
                    size = int(http["content-length"]) if revisit else len(body)
                    if not revisit and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"the payload of {f['warc-record-id']} is damaged")
                    out.append((page_of(f["warc-record-id"]), size, digest, f["warc-type"], page_of(f["warc-refers-to"]) if revisit else None))
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    rows = shards.select(F.col("warc").alias("shard"))
    return _spread(rows).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def convert_pages(pages: DataFrame, folder: str) -> DataFrame:
    """pages (page_id, url, html) through ARC and WARC, as read_back() has them. A null html is an empty payload, a null url
    urn:unknown; null ids and repeated rows are records like others (of equal ids the first record is the response). A very
    long html is one record, held in memory. No pages, no rows. Other columns are ignored."""
    arc = write_arc(pages, folder)
    return read_back(convert(decide(index_arc(arc, folder)), folder, arc.count()), folder)


def op9_legacy_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of all pages, read back from the archives. Nulls,
    repeated rows, very long pages, clashing columns and empty tables: see convert_pages()."""
    return convert_pages(table(spark, sf_dir, "pages"), work_path(spark, "warc"))


QUERIES = {"op9_legacy_warc": op9_legacy_warc}
SQL = {
    "op9_legacy_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h FROM p),
w AS (SELECT h, max(page_id) AS best FROM d WHERE n >= 1000 GROUP BY h)
SELECT d.page_id, d.n AS payload_bytes, d.h AS payload_digest,
  CASE WHEN d.n >= 1000 AND w.best <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.n >= 1000 AND w.best <> d.page_id THEN w.best END AS refers_to
FROM d LEFT JOIN w ON d.h = w.h
""",
}
