"""Readers of run artefacts. CSV values are text, and '' is a null."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that a conditions file must have.
CONDITION_COLUMNS = ("condition", "query_dataset", "rank", "model_name")


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """All columns as text, blanks as nulls, a byte-order mark dropped; raises if a required column is missing."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_conditions(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path, CONDITION_COLUMNS)
    if not df.head(1):
        raise ValueError("the conditions file has no rows")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones raise."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A whole JSON document a file; a broken one has nulls and its text in _corrupt_record."""
    own = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([*own.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").option("multiLine", True).json(path)


def discover(spark: SparkSession, root: str, names: tuple[str, ...]) -> DataFrame:
    """All rows of the CSV files of these names below root, all columns as text and blanks as nulls, with source_file,
    modified and task_index (from a folder task_<n>, else null). Files need not have the same header: files of one header
    are read together, and columns that a file lacks are null. The list of files and headers goes to the driver."""
    glob = "{" + ",".join(names) + "}"
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    # A file's first split begins with its header; ids grow within a split.
    first = lines.where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    heads = first.groupBy("file").agg(F.min_by("value", "at").alias("head")).groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("head").collect()
    parts = []
    for head, files in heads:
        df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("inferSchema", False).csv([_path(f) for f in files])
        df = df.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("modified"))
        own = df.columns[:-2]
        parts.append(df.select(*[F.when(F.col(f"`{c}`").rlike(r"(?U)\S"), F.col(f"`{c}`")).alias(c.lstrip("\ufeff")) for c in own], "source_file", "modified", F.regexp_extract("source_file", r"/task_(\d+)/", 1).try_cast("int").alias("task_index")))
    if not parts:
        return spark.createDataFrame([], "source_file string, modified timestamp, task_index int")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _path(uri: str) -> str:
    """A file's path as a reader takes it: metadata has it escaped."""
    from urllib.parse import unquote

    return unquote(uri)


def read_allow_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, ordinal): '#' comments and blanks dropped, the first of repeats; raises if nothing is left."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("ordinal", "line"))
    names = lines.select(F.trim(F.split_part("line", F.lit("#"), F.lit(1))).alias("name"), "ordinal").where("name <> ''").groupBy("name").agg(F.min("ordinal").alias("ordinal"))
    if not names.head(1):
        raise ValueError("the list is empty")
    return names


def read_handoff(spark: SparkSession, path: str) -> DataFrame:
    """Candidate hand-overs as one row a candidate."""
    schema = "dataset string, split string, round int, candidates array<struct<candidate_id:string,condition:string,model:string,rank:int,score:double,source:string,intended_use:string,reason:string>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return doc.select("dataset", "split", "round", F.posexplode("candidates").alias("ordinal", "c")).select("dataset", "split", "round", "ordinal", "c.*")


def read_ranking(exported: DataFrame, metadata: DataFrame) -> DataFrame:
    """(dataset_id, ranked_model_ids) expanded to (dataset_id, model_id, rank, score = 1 / rank) with the metadata of the
    ids (model_id, ...)."""
    rows = exported.select("dataset_id", F.posexplode("ranked_model_ids").alias("pos", "model_id"))
    return rows.select("dataset_id", "model_id", (F.col("pos") + 1).alias("rank"), (1.0 / (F.col("pos") + 1)).alias("score")).join(metadata, "model_id", "left")


def read_plans(spark: SparkSession, root: str) -> DataFrame:
    """plans.json files below root, one row a plan, with the round from a folder round_<n>."""
    schema = "plans array<struct<dataset:string,model:string,evaluation_protocol:string,metric:string,args:map<string,string>>>"
    doc = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "plans.json").option("multiLine", True).json(root)
    file = F.col("_metadata.file_path")
    return doc.select(file.alias("plan_file"), F.regexp_extract(file, r"round_(\d+)", 1).try_cast("int").alias("round"), F.explode("plans").alias("p")).select("plan_file", "round", "p.*")


def last_json_object(text: str | None) -> str | None:
    """The last JSON object inside free text."""
    import json

    found, decoder, at = None, json.JSONDecoder(), 0
    while text and (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            found, at = json.dumps(value, sort_keys=True), end
        except ValueError:
            at += 1
    return found


@F.pandas_udf(T.StringType())
def embedded_object(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column form of last_json_object; there is no native incremental decoder."""
    for s in rows:
        yield s.map(last_json_object, na_action="ignore")


def parse_choices(text: str | None) -> list[str] | None:
    """A list of choices from JSON or a Python literal: a list, or a dict with 'text'."""
    import ast
    import json

    for parser in (json.loads, ast.literal_eval):
        try:
            found = parser((text or "").strip())
        except (ValueError, SyntaxError):
            continue
        found = found.get("text") if isinstance(found, dict) else found
        if isinstance(found, list):
            return [str(x) for x in found]
    return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def choices(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column form of parse_choices; Python literals have no native parser."""
    for s in rows:
        yield s.map(parse_choices)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a small workbook as text columns, blanks as nulls; the first row names them."""
    import re
    import zipfile
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    rows = []
    for row in sheet.iter(f"{space}row"):
        cells: dict[int, str] = {}
        for i, c in enumerate(row):
            letters = re.match("[A-Z]+", c.get("r") or "")
            at = i
            if letters:
                at = 0
                for ch in letters.group():
                    at = at * 26 + ord(ch) - 64
                at -= 1
            value = "".join(t.text or "" for t in c.iter(f"{space}t")) or (c.findtext(f"{space}v") or "")
            cells[at] = shared[int(value)] if c.get("t") == "s" and value else value
        rows.append(cells)
    names = [rows[0][i] for i in sorted(rows[0])] if rows else []
    data = [tuple(r.get(i) or None for i in range(len(names))) for r in rows[1:]]
    return spark.createDataFrame(data, T.StructType([T.StructField(n, T.StringType()) for n in names]))


#: Named sources: name -> (spark, location) -> DataFrame.
SOURCES = {"parquet": lambda s, p: s.read.parquet(p), "csv": read_csv, "jsonl": read_jsonl, "conditions": read_conditions}


def load(spark: SparkSession, kind: str, location: str) -> DataFrame:
    return SOURCES[kind](spark, location)


def load_dataset(spark: SparkSession, root: str, dataset: str, subset: str = "", split: str = "", fallbacks: dict[str, tuple[str, str]] | None = None, flatten: dict | None = None, limit: int = 0, seed: int = 0, key: str = "") -> DataFrame:
    """A split of a stored dataset (root/<dataset>/<subset>/<split>, Parquet; levels that are '' are left out). Where it isn't
    there, the dataset's fallback (dataset, subset) is read, under its lower-cased name; the error is the first one if that
    fails, too. flatten: a function for the dataset's name that makes examples of its rows. limit: so many rows, by a
    hash of the seed and the key, in that order (sample_index)."""
    from pyspark.errors import AnalysisException

    from tallyframe.operators.selection import hashed_sample

    def stored(name: str, part: str) -> DataFrame:
        return spark.read.parquet("/".join(x for x in (root, name, part, split) if x))

    try:
        df = stored(dataset, subset)
    except AnalysisException as first:
        other = (fallbacks or {}).get(dataset.lower())
        if other is None:
            raise
        try:
            df = stored(*other)
        except AnalysisException as second:
            raise second from first
    df = (flatten or {}).get(dataset, lambda x: x)(df)
    return hashed_sample(df, key, limit, seed) if limit else df


def tasks_with_line(spark: SparkSession, root: str, files: str = "*smoke.stderr.txt", text: str = "CUDA out of memory") -> DataFrame:
    """(task_index): tasks below root that have a log of this name with the text in a line, at any depth of their folders."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files).text(root)
    found = lines.where(F.contains("value", F.lit(text))).select(F.regexp_extract(F.col("_metadata.file_path"), r"/task[_=](\d+)/", 1).try_cast("int").alias("task_index"))
    return found.where("task_index is not null").distinct()
