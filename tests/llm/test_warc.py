"""ARC parsing, conversion, and the archives read back."""

import glob
import gzip
import hashlib
import io

import duckdb
import pytest

from tallyframe.llm import warc
from tallyframe.llm.common import work_path

BIG = "<p>" + "x" * 1500


def stream(data):
    return io.BufferedReader(io.BytesIO(data))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    data = warc.arc_version_block("n", version, "20010101000000") + warc.arc_record("n", version, 7, "http://a b/c\n", b"\n<p>\r\n\r\nx", 0) + warc.arc_record("n", version, None, None, b"", 9)
    got = list(warc.read_arc(stream(data)))
    assert [r["version"] for r in got] == [version] * 2 and [r["number"] for r in got] == [0, 1]
    assert got[0]["fields"]["URL"] == "http://a%20b/c%0A" and got[1]["fields"]["URL"] == "urn:unknown"
    assert [warc.split_http(r["block"])[1] for r in got] == [b"\n<p>\r\n\r\nx", b""]
    assert ("Checksum" in got[0]["fields"]) == (version == 2)


def test_odd_arcs():
    head = warc.arc_version_block("n", 1, "20010101000000")
    spaced = head + b"http://a b c 1.2.3.4 19990102 text/plain 5\nhello\n"
    r = next(warc.read_arc(stream(spaced)))
    assert r["fields"]["URL"] == "http://a b c" and warc.split_http(r["block"]) == (b"", b"hello", {})
    assert b"WARC-Date: 1999-01-02T00:00:00Z" in warc.convert_record(r, "response", None) and b"Content-Type: text/plain" in warc.convert_record(r, "response", None)
    with pytest.raises(ValueError, match="shorter"):
        list(warc.read_arc(stream(head + b"http://a 1.2.3.4 1999 text/plain 50\nhello\n")))
    with pytest.raises(ValueError, match="filedesc"):
        list(warc.read_arc(stream(b"http://a 1.2.3.4 1999 text/plain 5\nhello\n")))


@pytest.mark.parametrize("i", [0, 1, -1, 2**62, 2**63 - 1, -(2**63), None])
def test_record_ids(i):
    rid = warc.record_id(i, hashlib.sha1(b"x").hexdigest())
    assert warc.page_of(rid) == i and rid[24] == "8" and rid[29] in "89ab"


def want(rows):
    size = {}
    for i, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            size[b] = max(size.get(b, i), i)
    out = []
    for i, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and i is not None and size[b] != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", size[b] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(1, BIG), (5, BIG), (3, BIG), (2, "small"), (4, "small"), (6, None), (7, ""), (8, "é" * 600), (9, "é" * 600), (10, "a\r\n\r\nb" * 300), (-4, BIG), (None, "none")]
    pages = spark.createDataFrame([(i, f"http://h/{i}" if i != 2 else None, h, "clash", 1) for i, h in rows], "page_id long, url string, html string, record_type string, shard int")
    folder = work_path(spark, "test-warc")
    assert sorted((tuple(r) for r in warc.convert_pages(pages.repartition(3), folder).collect()), key=str) == want(rows)
    root = folder.removeprefix("file://")
    kinds = []
    for f in glob.glob(f"{root}/*.warc.gz"):
        for fields, block in warc.read_warc(stream(gzip.open(f).read())):
            kinds.append(fields["warc-type"])
            if fields["warc-type"] == "revisit":
                assert fields["warc-profile"] == warc.PROFILE and block.endswith(b"\r\n\r\n") and len(block) < 200
    assert kinds.count("revisit") == 4 and kinds.count("response") == len(rows) - 4 and "warcinfo" in kinds
    assert len(glob.glob(f"{root}/*.arc.gz")) >= 2 and not glob.glob(f"{root}/.*")


def test_repeated_rows_and_nulls(spark):
    rows = [(5, BIG), (5, BIG), (3, BIG), (None, BIG + "y"), (None, BIG + "y")]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.convert_pages(pages, work_path(spark, "test-warc")).collect()), key=str)
    assert got == sorted([(3, "revisit", 5), (5, "response", None), (5, "revisit", 5), (None, "response", None), (None, "revisit", None)], key=str)
    assert warc.convert_pages(pages.limit(0), work_path(spark, "test-warc")).collect() == []


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert sorted(con.execute(warc.SQL["op9_legacy_warc"]).fetchall(), key=str) == sorted((tuple(r) for r in warc.op9_legacy_warc(spark, sf).collect()), key=str)
