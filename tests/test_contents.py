"""JSON texts of unknown shape against the plain walks."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import json_text, metrics

TEXTS = ['{"b":1,"a":[{"text":"x","y":"no"},{"z":"q","w":["r","  "]}]}', '{"a":[{"y":"no","text":"x"},{"z":"q","w":["r","  "]}],"b":1}', "[" * 400 + '"deep"' + "]" * 400, "[" * 200000, "plain", "", "  ", '"s"', "5", "null", '{"text":null,"a":"b"}', '{"text":{"c":"d"}}', "{broken", '{"é":"\\u00e9 \\ud83d\\ude00"}', None]


def run(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in sorted(rows.select("i", f(F.col("t")).alias("x")).collect())]


def walk(v):
    if isinstance(v, str):
        return [v] if v.strip() else []
    if isinstance(v, dict):
        return walk(v["text"]) if "text" in v else [y for x in v.values() for y in walk(x)]
    return [y for x in v for y in walk(x)] if isinstance(v, list) else []


def read(t):
    try:
        return json.loads(t)
    except (ValueError, RecursionError):
        return t


def test_text_leaves(spark):
    assert run(spark, json_text.text_leaves, TEXTS) == [None if t is None else walk(read(t)) for t in TEXTS]


def test_digests(spark):
    got = run(spark, json_text.json_digest, TEXTS)
    assert got[0] == got[1] == hashlib.sha256('{"a":[{"text":"x","y":"no"},{"w":["r","  "],"z":"q"}],"b":1}'.encode()).hexdigest()
    assert [x is None for x in got] == [t is None or read(t) is t for t in TEXTS]


@pytest.mark.parametrize(("text", "want"), [
    ('[[[[[[{"type":"chem","text":"xyz"}]]]]]]', ["chemical::xyz"]), ('["a, b; the c", "[\\"d\\"]"]', ["b", "c", "d"]), ('{"text":null,"mention":"m"}', ["mention m text null"]), ('{"mention":["The","m"],"type":null}', ["none::m"]),
    ("[1.50, true, null, 1e3]", ["15", "true", "10000"]), ('{"b":{"z":1,"y":2},"a":0}', ["0 b y 2 z 1"]), ("x;;the;y\nx", ["x", "y"]), (None, []), ("", []), ("[not json, at all", ["not json", "at all"]), ('{"text":["",null]}', ["text null"]), (' ["q"]', ["q"]),
])
def test_sets(spark, text, want):
    assert sorted(run(spark, metrics.canonical_set, [text])[0]) == sorted(want)
