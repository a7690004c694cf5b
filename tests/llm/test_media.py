"""Interleaved sequences, PNG payloads, and resolution by digest."""

import hashlib
import zlib

import numpy as np
import pytest

from tallyframe.llm import media
from tallyframe.llm.common import work_path

PAGE = """<html><head><title>T</title><script>var x = "<img src=no>";</script></head><body><p>One <b>two</b><br>three</p>
<figure><img src="a.png" alt="alt a"><figcaption>Cap &amp; tion</figcaption></figure><p>mid<img src='b.png' alt='alt b'/>dle</p><video src="v.mp4"></video><img alt="no source"><p>end"""


def test_sequence():
    got = [(x["pos"], x["kind"], x["text"], x["ref"], x["caption"]) for x in media.parse_sequence(PAGE)]
    assert got == [
        (0, "text", "T", None, None), (1, "text", "One two", None, None), (2, "text", "three", None, None), (3, "image", None, "a.png", "Cap & tion"), (4, "text", "mid", None, None),
        (5, "image", None, "b.png", "alt b"), (6, "text", "dle", None, None), (7, "video", None, "v.mp4", None), (8, "text", "end", None, None),
    ]
    assert media.parse_sequence(None) == media.parse_sequence("") == [] and media.parse_sequence("<p></p>") == []
    assert [x["text"] for x in media.parse_sequence("<figcaption>kept")] == ["kept"]


def test_sequences_of_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (None, None), (2, "")], "page_id long, html string")
    got = {r.page_id: r["items"] for r in media.sequences(pages, "page_id").collect()}
    assert len(got[1]) == 9 and got[None] == [] and got[2] == []
    real = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert media.sequences(real, "page_id").where("size(items) > 3").count() > 0


@pytest.mark.parametrize("text", [b"", b"x", b"y" * 64, bytes(range(256)) * 5, "é".encode() * 33])
def test_png(text):
    body = media.payload(text)
    assert len(body) % 64 == 0 and len(body) >= 64 and body.startswith(text) and not body[len(text) :].strip(b"\0")
    image = media.png(body)
    assert media.samples(image) == body
    broken = bytearray(image)
    broken[45] ^= 1
    with pytest.raises(ValueError):
        media.samples(bytes(broken))


def want(text):
    body = media.payload((text or "").encode())
    image = media.png(body)
    return (len((text or "").encode()), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(image), hashlib.sha256(image).hexdigest())


def test_text_media(spark, make, awkward):
    got = media.text_media(make(awkward, extra=True).repartition(3), work_path(spark, "test-media")).collect()
    key = lambda r: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256)
    assert sorted(((r.doc_id, *key(r)) for r in got), key=str) == sorted(((i, *want(t)) for i, t in awkward), key=str)
    assert len({r.feature for r in got}) == len({t or "" for _, t in awkward}) and all(r.caption == f"{r.n_bytes} bytes as {r.payload_bytes // 64} rows" for r in got)
    place = lambda t: sum(1 for x in (t or "").encode().split(b"\n") if x.strip()) // 2
    assert sorted(((r.doc_id, r.pos) for r in got), key=str) == sorted(((i, place(t)) for i, t in awkward), key=str)
    lines = media.text_media(make([(1, "a\n\nb <b>\n \nc\nd\ne"), (2, "\n\n"), (3, "x" * 200 + "\n" * 3000 + "y")]), work_path(spark, "test-media")).collect()
    assert {(r.doc_id, r.pos) for r in lines} == {(1, 2), (2, 0), (3, 1)}
    x = np.frombuffer(media.payload(b"ab"), np.uint8)
    assert f"mean={int(x.sum()) * 1000 // 64}" in media.text_media(make([(1, "ab")]), work_path(spark, "test-media")).collect()[0].feature
    assert media.text_media(make([]), work_path(spark, "test-media")).collect() == []


def test_unknown_digest(spark):
    refs = spark.createDataFrame([("d1",), ("d2",)], "digest string")
    index = spark.createDataFrame([("d1", "s", 0, 9), ("d1", "r", 5, 9), ("d1", None, None, None)], "digest string, shard string, offset long, length long")
    assert {r.digest: r.shard for r in media.resolve(refs, index).collect()} == {"d1": "r", "d2": None}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = media.op6_interleaved_media(spark, sf).collect()
    assert len(got) == len(texts) and all((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == want(texts[r.doc_id]) for r in got)
