"""Result folders of array tasks as a registered source: spark.read.format("task_folders").

Options: path (the root), file (a name or glob below each task_<n> or task=<n> folder), and what: 'first' (the first row of
each CSV file, the columns of the option columns), 'rows' (all of them) or 'failures' (the items of each JSON array, with
their task_index). A partition is some files; a folder without the file has no rows. Rows carry task_index.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files of one partition.
FILES = 64


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri))


class _Files(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.root, self.file, self.what, self.columns = options["path"], options.get("file", "batch_results.csv"), options.get("what", "first"), columns

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _filesystem(self.root)
        found = []
        for x in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            task = re.search(r"/task[_=](\d+)/[^/]+$", x.path)
            if x.is_file and task and fnmatch.fnmatch(x.base_name, self.file):
                found.append((int(task[1]), x.path))
        found.sort()
        return [_Files(found[i : i + FILES]) for i in range(0, len(found), FILES)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, _ = _filesystem(self.root)
        for task, path in partition.files:
            with store.open_input_stream(path) as f:
                text = f.read().decode("utf-8-sig")
            if self.what == "failures":
                for item in json.loads(text) if text.strip() else []:
                    yield task, json.dumps(item, ensure_ascii=False)
                continue
            for row in csv.DictReader(io.StringIO(text, newline="")):
                yield (task, *(row.get(c) or None for c in self.columns))
                if self.what == "first":
                    break


class TaskFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "task_folders"

    def _columns(self) -> list[str]:
        return [c for c in self.options.get("columns", "").split(",") if c]

    def schema(self) -> str:
        if self.options.get("what") == "failures":
            return "task_index int, failure string"
        return ", ".join(["task_index int", *(f"`{c}` string" for c in self._columns())])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), self._columns())


def read_tasks(spark: SparkSession, root: str, file: str, columns: list[str], what: str = "first") -> DataFrame:
    """(task_index, columns): what the tasks below root have written."""
    spark.dataSource.register(TaskFolders)
    return spark.read.format("task_folders").option("file", file).option("what", what).option("columns", ",".join(columns)).load(root)


def task_results(selected: DataFrame, results: DataFrame, columns: list[str], status: str) -> DataFrame:
    """selected (task_index, ...) with its task's result columns; the status of a task without a result is
    'missing_task_result'."""
    found = results.withColumn("_found", F.lit(True))
    out = selected.join(found, "task_index", "left")
    return out.withColumn(status, F.when(F.col("_found"), F.col(status)).otherwise("missing_task_result")).select(*selected.columns, *columns)
