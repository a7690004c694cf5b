"""Sinks. Tables are written by Spark; reports render results that are small by their nature (one row a dataset)."""

from __future__ import annotations

import hashlib
import json
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import filled

#: Rows of a report, at most; a report of more is an error, not a cut.
REPORT_ROWS = 10_000


def write_csv(df: DataFrame, path: str, columns: list[str], text_counts: tuple[str, ...] = ()) -> None:
    """Fixed columns in order, a missing one empty, nulls as ''; counts such as 3/5 get a leading apostrophe, so that
    spreadsheets keep them as text."""
    have = set(df.columns)
    cell = lambda c: F.col(f"`{c}`") if c in have else F.lit(None).cast("string")
    cols = [(F.concat(F.lit("'"), cell(c)) if c in text_counts else cell(c)).alias(c) for c in columns]
    df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


#: The header of a ranked file, and the method it names.
SIMILARITY_COLUMNS = ("method", "rank", "query_dataset", "dataset_node_id", "dataset_name", "cosine_similarity")
SIMILARITY_METHOD = "method1_cosine_retrieval"


def write_similarities(ranked: DataFrame, path: str, query: Column, name: Column) -> None:
    """Ranked rows (query_id, id, score, rank) as a ranked file, with the query's and the found dataset's names."""
    rows = ranked.select(F.lit(SIMILARITY_METHOD).alias("method"), "rank", query.alias("query_dataset"), F.col("id").alias("dataset_node_id"), name.alias("dataset_name"), F.col("score").alias("cosine_similarity"))
    write_csv(rows, path, list(SIMILARITY_COLUMNS))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def handoffs(df: DataFrame) -> DataFrame:
    """One JSON document a dataset from candidate rows (dataset, final_rank, model, score), with a checksum."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "model", "score"))), lambda x: x)
    doc = df.groupBy("dataset").agg(F.to_json(rows).alias("candidates"))
    return doc.withColumn("checksum", F.sha2("candidates", 256))


#: What a frozen hand-over names as its owner, and the defaults of its candidates.
FROZEN_OWNER, FROZEN_SOURCE, FROZEN_USE, FROZEN_REASON = "frozen_measured_preflight", "preflight_selection", "direct_inference", "Selected by measured preflight."


def file_checksums(spark: SparkSession, paths: list[str]) -> list[dict[str, str]]:
    """(path, checksum) of each source, in order: SHA-256 of a file, of a folder that of its files' digests in the order of
    their names."""
    out = []
    for path in paths:
        files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("c")).where("path not like '%/_SUCCESS'")
        digests = [r.c for r in files.orderBy("path").collect()]  # one row a file
        out.append({"path": path, "checksum": digests[0] if len(digests) == 1 else hashlib.sha256("".join(digests).encode()).hexdigest()})
    return out


def frozen_handoffs(ranked: DataFrame, splits: DataFrame, target: int, sources: list[dict[str, str]]) -> DataFrame:
    """(dataset, handoff): a JSON hand-over for each dataset of splits (dataset, split) that has ranked rows: its first `target`
    by final_rank, numbered from 1 without gaps. ranked: dataset, final_rank, candidate_id, model, retrieval_score, source,
    intended_use, reason, score, metric, evaluation_protocol, as text. A score that is no finite number is an error when the
    result is read. The hand-over names its sources and their joint checksum."""
    checksum = hashlib.sha256(json.dumps(sources, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    place = F.row_number().over(Window.partitionBy("dataset").orderBy(F.col("final_rank").cast("long"), "candidate_id"))
    rows = ranked.withColumn("_rank", place).where(F.col("_rank") <= target)
    score = F.when(filled(F.col("retrieval_score")), F.col("retrieval_score").try_cast("double")).otherwise(0.0)
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    sound = F.when(finite, score).otherwise(F.raise_error(F.concat(F.lit("no finite retrieval score for "), F.coalesce("model", F.lit("")))).cast("double"))
    own = lambda c, default: F.when(filled(F.col(c)), F.col(c)).otherwise(default).alias(c)
    candidate = F.struct(
        "candidate_id", F.lit(FROZEN_OWNER).alias("condition"), "model", F.col("_rank").alias("rank"), sound.alias("score"), own("source", FROZEN_SOURCE), own("intended_use", FROZEN_USE), own("reason", FROZEN_REASON),
        *[F.coalesce(c, F.lit("")).alias(f"preflight_{n}") for c, n in (("score", "score"), ("metric", "metric"), ("evaluation_protocol", "protocol"))],
    )
    lists = rows.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct(F.col("_rank"), candidate.alias("c")))).alias("l"))
    frozen = F.struct(F.array(*[F.struct(F.lit(x["path"]).alias("path"), F.lit(x["checksum"]).alias("checksum")) for x in sources]).alias("ranked_models_sources"), F.lit(checksum).alias("combined_checksum"))
    doc = F.struct(
        F.lit(1).alias("handoff_version"), F.lit(FROZEN_OWNER).alias("owner"), F.lit(False).alias("mock"), F.lit(f"frozen-preflight@{checksum[:12]}").alias("retrieval_agent"), "dataset", F.coalesce("split", F.lit("auto")).alias("split"),
        F.lit(1).alias("round"), frozen.alias("frozen_from"), F.transform("l", lambda x: x["c"]).alias("candidates"),
    )
    return splits.join(lists, "dataset").select("dataset", F.to_json(doc).alias("handoff"))


def _rows(df: DataFrame) -> list[list[str]]:
    found = df.limit(REPORT_ROWS + 1).collect()
    if len(found) > REPORT_ROWS:
        raise ValueError("too many rows for a report")
    return [["" if x is None else str(x) for x in r] for r in found]


def markdown(df: DataFrame) -> str:
    clean = lambda x: x.replace("|", "\\|").replace("\n", "<br>")
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(map(clean, r)) + " |" for r in _rows(df)]) + "\n"


def write_xlsx(df: DataFrame, path: str) -> None:
    """One sheet with inline strings and numbers; no library needed."""
    numeric = {c for c, t in df.dtypes if t in ("int", "bigint", "double", "float")}

    def cell(c: str, x: str) -> str:
        if c in numeric and x:
            return f"<c><v>{x}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>'

    rows = ["<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in df.columns) + "</row>"]
    rows += ["<row>" + "".join(cell(c, x) for c, x in zip(df.columns, r, strict=True)) + "</row>" for r in _rows(df)]
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="report" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(rows)}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(Path(path), "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + body)
