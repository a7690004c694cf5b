"""Token ids, packing and token files: against direct encoding, and round trips."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import packing, token_files, tokens
from tallyframe.llm.common import work_path

ODD = [
    "", " ", "\n", "a\n", " a", "a  b", "\n\n x\t\ty ", "a  b  c", "x <|endoftext|> y  <|endoftext|>z", "<|STARTOFTEXT|> <|startoftext|>", "İstanbul ΣΑΣ é ́x don't I'll", "foo\r\n  bar ", "\na b\nc", "a … ,x…, y", "é  b", "it's a\n's",
    "tab\tend\x1c x", "é e ́", "12 3.5, (x)!! $$$ a|b", "　wide space", "a\x00b", "名前 は", "line sep", "'s 've x's", "word word, word. word,. x. x, 9 9, é é, word\nword,\nx,y x", "a\xffb ÿ",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_the_whole_text(name, monkeypatch):
    rng = random.Random(3)
    alphabet = ["a", "The", "word", " ", "  ", "\n", "é", "'", "'s", ",", "!", "9", "<|", "|>", "<|endoftext|>", "…", " ", "ß", "\t", "Ü", "́"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(600)]
    monkeypatch.setattr(tokens, "CACHE_PIECES", 300)
    e = tokens.Encoder(tokens.vocabulary_path(name))
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    got = [x for i in range(0, len(texts), 50) for x in e.encode([t.encode() for t in texts[i : i + 50]])]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def direct(name, text, end):
    return np.array(tokens.encoder(name).tok.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def check_pieces(rows, pieces, window=2048):
    """rows: (doc_id, text) with distinct ids."""
    ids = {i: direct("word_bpe_49k.json", t, 1) for i, t in rows}
    seen = {i: 0 for i in ids}
    for p in sorted(pieces, key=lambda p: (str(p.doc_id), p.start)):
        assert p.start == seen[p.doc_id] and p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        seen[p.doc_id] += p.length
    assert seen == {i: len(x) for i, x in ids.items()}
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(by) == list(range(len(by)))
    for k, own in by.items():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) == window or k == len(by) - 1


def test_packing(make, awkward):
    rows = [(i, t) for i, t in dict(awkward).items()]
    check_pieces(rows, packing.pack(make(rows, extra=True).repartition(3)).collect())
    assert packing.pack(make([])).collect() == []
    twice = packing.pack(make([(1, "a b"), (1, "a b"), (None, None)])).collect()
    assert sorted((str(p.doc_id), p.offset, p.length) for p in twice) == [("1", 0, 3), ("1", 3, 3), ("None", 6, 1)] or len(twice) == 3


def test_sequences_hold_the_windows(make):
    rows = [(i, " ".join(f"word{j}" for j in range(i))) for i in range(40)]
    pieces = packing.pack(make(rows), window=64, with_ids=True)
    check_pieces(rows, pieces.collect(), 64)
    out = packing.sequences(pieces, 64).orderBy("sequence_id").collect()
    assert all(len(r.ids) in (4, 8, 16, 32, 64, 128, 256) or len(r.ids) == 64 * 4 for r in out)
    assert sum(len(r.ids) // 4 - r.n_pad for r in out) == sum(len(direct("word_bpe_49k.json", t, 1)) for _, t in rows)
    by = {i: direct("word_bpe_49k.json", t, 1) for i, t in rows}
    for r in out:
        for d in r.documents:
            assert np.array_equal(np.frombuffer(r.ids, "<u4")[d.offset : d.offset + d.length], by[d.doc_id][d.start : d.start + d.length])


def check_files(rows, got):
    ordered, at = sorted(rows), 0
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.start, r.doc_id))] == [i for i, _ in ordered]
    by = {r.doc_id: r for r in got}
    for i, t in ordered:
        x = direct("byte_bpe_50k.json", t, 0)
        assert (by[i].start, by[i].n_tokens, by[i].ids_crc32) == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)


def test_token_files(spark, make, awkward):
    rows = [(i, t) for i, t in dict(awkward).items() if i is not None]
    folder = work_path(spark, "test-files")
    manifest = token_files.write_files(make(rows, extra=True), folder)
    check_files(rows, token_files.read_files(manifest, folder).collect())
    with_ids = {r.doc_id: bytes(r.ids) for r in token_files.read_files(manifest, folder, with_ids=True).collect()}
    assert with_ids == {i: direct("byte_bpe_50k.json", t, 0).tobytes() for i, t in rows}
    shard = token_files.Shard(folder, manifest.collect()[0].path)
    assert shard.ids(0) == with_ids[int(shard.index["doc_id"][0])] and len(shard.dictionary) == 64


def test_token_files_edges(spark, make):
    folder = work_path(spark, "test-files")
    got = token_files.read_files(token_files.write_files(make([(None, "x"), (2, "b"), (2, "b"), (1, None)]), folder), folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 2] and [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]]))
    folder = work_path(spark, "test-files")
    assert token_files.read_files(token_files.write_files(make([]), folder), folder).collect() == []


def test_changed_dictionary_is_noticed(spark, make):
    folder = work_path(spark, "test-files")
    manifest = token_files.write_files(make([(1, "some text")]), folder).collect()
    root = folder.removeprefix("file://")
    import glob

    with open(glob.glob(f"{root}/*.dict")[0], "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError, match="dictionary"):
        token_files.Shard(folder, manifest[0].path)


def test_queries(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text")).collect()]
    check_pieces(rows, packing.op4_concat_and_cut(spark, sf).collect())
    check_files(rows, token_files.op8_zstd_token_files(spark, sf).collect())
