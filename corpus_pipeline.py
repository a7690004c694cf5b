"""A corpus pipeline in five stages: quality rules, near duplicates, pseudonyms, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the shared folder and
gives it to the next one, read back. The stages keep the columns of docs, whatever their names, until packing. Nulls in any
column, empty and very long texts, repeated rows and empty tables are taken as the docstrings of the operators say; the
lines below name the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import mixing, ngram_join, packing, pii, quality_rules
from tallyframe.llm.common import discard, table, written

#: Near copies: words of a shingle, and the Jaccard similarity from which on two documents are one.
SHINGLE, SIMILARITY = 5, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects. A null or empty text is rejected, repeated rows are judged each for itself."""
    return quality_rules.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; one row of a repeated id. Rows without an id, and empty texts, all stay."""
    return ngram_join.one_per_component(docs, SHINGLE, SIMILARITY)


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in place of personal data; a null text stays null. n_chars follows the text."""
    return pii.pseudonymise(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, by the rates that bring token totals to the default targets; rows that share an id share a rate."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids: doc_id and the piece's place, no other columns. A null text has its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("pseudonyms", pseudonym_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`. A stage's table goes when the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        last, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            discard(last)
    return docs


#: Pseudonyms and token ids have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None
