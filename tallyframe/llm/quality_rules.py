"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule has steps (columns to compute) and a reject condition on them. The cost of each rule and the share that it
rejects are measured on a bounded sample; rules then run in the order of rejection per cost, and the steps of a rule
are computed only for rows that no earlier rule rejected. The order changes the time, never which rows are kept.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import SPACE, table

#: Words of a window; a repeated window is one found twice or more in its text.
WINDOW = 8
#: Rows of the sample that costs and selectivities are measured on, and characters of each; it decides the order of
#: rules alone.
SAMPLE_ROWS, SAMPLE_CHARS = 256, 1 << 16


@dataclass(frozen=True)
class Rule:
    """steps: dicts of column name to expression, each over earlier columns; reject: true for rows to reject."""

    name: str
    reject: Column
    steps: tuple = ()
    cost: float = field(default=0.0, compare=False)
    rejected: float = field(default=0.0, compare=False)


def base_steps() -> tuple:
    """Columns of a text column _t: words and what is cheap to count."""
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        {"_words": F.array_remove(F.split("_t", SPACE), ""), "_lines": lines},
        {
            "_n_words": F.size("_words").cast("long"),
            "_word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
            "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        },
    )


def symbol_steps() -> tuple:
    return ({"_n_symbols": F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long")},)


def upper_steps() -> tuple:
    return ({"_n_upper": F.length(F.regexp_replace("_t", "[^A-ZÀ-Þ]+", "")).cast("long")},)


def repeat_steps() -> tuple:
    """_n_repeat_words: words inside windows of WINDOW words that occur twice or more. Windows are 64-bit hashes, made
    by doubling (1, 2, 4, 8 words); only texts with a repeated window sort theirs. O(n log n) for n words."""
    pair = lambda a, k: F.zip_with(a, F.slice(a, k + 1, F.greatest(F.size("_words"), F.lit(1))), lambda x, y: F.xxhash64(x, y))
    none = F.array().cast("array<bigint>")
    same = F.zip_with("_sorted", F.slice("_sorted", 2, F.greatest(F.size("_sorted"), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    gap = F.zip_with("_starts", F.slice("_starts", 2, F.greatest(F.size("_starts"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return (
        {"_h1": F.transform("_words", lambda w: F.xxhash64(w))},
        {"_h2": pair("_h1", 1)},
        {"_h4": pair("_h2", 2)},
        {"_h8": F.when(F.size("_words") >= WINDOW, F.slice(pair("_h4", 4), 1, F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0)))).otherwise(none)},
        {"_again": F.size(F.array_distinct("_h8")) < F.size("_h8")},
        {"_sorted": F.when(F.col("_again"), F.array_sort(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))},
        {"_starts": F.when(F.col("_again"), F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))},
        {"_n_repeat_words": F.when(F.col("_again"), F.aggregate(gap, F.lit(0), lambda s, x: s + x)).otherwise(F.lit(0)).cast("long")},
    )


def base_rules() -> list[Rule]:
    """The rules of base_failed."""
    return [Rule("few_words", F.expr("_n_words < 20")), Rule("repeated_words", F.expr("100 * _n_repeat_words > 30 * _n_words"), repeat_steps())]


def content_rules() -> list[Rule]:
    """Junk: symbol tails or cell bars, shouting, repeated lines, glued words."""
    return [
        Rule("symbols", F.expr("4 * _n_symbols > _n_words"), symbol_steps()),
        Rule("shouting", F.expr("100 * _n_upper > 40 * _word_chars"), upper_steps()),
        Rule("repeated_lines", F.expr("2 * _n_dup_lines > _n_lines")),
        Rule("long_words", F.expr("_word_chars > 20 * _n_words")),
    ]


def with_steps(df: DataFrame, steps: tuple, gate: Column | None = None) -> DataFrame:
    for step in steps:
        df = df.withColumns({k: c if gate is None else F.when(gate, c) for k, c in step.items()})
    return df


def measured(df: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules with cost (seconds a row) and rejected (share of rows) on at most sample_rows rows of df, ordered by
    rejection per cost. df holds _t and the base columns. Without rows, the given order."""
    spark = df.sparkSession
    # Chosen by a hash over all rows, so that no partition is preferred; kept as a local relation of the plan. Rows that are
    # likely to be among the first by their hash are kept before any are ordered, else each task would send sample_rows texts.
    likely = min(1.0, 4 * sample_rows / max(1, df.count()))
    bound = -(1 << 63) + int(likely * (1 << 64)) - 1
    hashed = df.select(F.left("_t", F.lit(SAMPLE_CHARS)).alias("_t"), F.xxhash64("_t").alias("_h")).where(F.col("_h") <= F.lit(bound))
    some = hashed.orderBy("_h", "_t").limit(sample_rows).select("_t")._jdf
    taken = some.collectAsList()
    rows = taken.size()
    if not rows:
        return list(rules)
    base = with_steps(DataFrame(spark._jsparkSession.createDataFrame(taken, some.schema()), spark), base_steps())

    def seconds(query: DataFrame) -> tuple[float, object]:
        query.collect()  # compiles
        began = time.perf_counter()
        row = query.collect()[0]
        return time.perf_counter() - began, row

    floor, _ = seconds(base.agg(F.sum("_n_words"), F.sum("_n_dup_lines")))
    out = []
    for r in rules:
        took, row = seconds(with_steps(base, r.steps).agg(F.sum("_n_words"), F.sum("_n_dup_lines"), F.count_if(r.reject)))
        out.append(Rule(r.name, r.reject, r.steps, max(took - floor, 1e-4) / rows, row[2] / rows))
    return sorted(out, key=lambda r: (-r.rejected / r.cost, r.cost))


def cascade(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the columns _rejected_by (name of the first rule in cost order that rejects the row, else null) and
    the rules' own working columns, all of which start with an underscore. A null text is an empty one."""
    df = with_steps(docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit(""))), base_steps())
    df = df.withColumn("_rejected_by", F.lit(None).cast("string"))
    for r in measured(docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t")), rules, sample_rows):
        alive = F.col("_rejected_by").isNull()
        df = with_steps(df, r.steps, alive)
        df = df.withColumn("_rejected_by", F.when(alive & F.coalesce(r.reject, F.lit(False)), F.lit(r.name)).otherwise(F.col("_rejected_by")))
    return df


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that no rule rejects, with its columns as they are. A null or empty text is rejected (it has
    under 20 words); repeated rows are judged each for itself."""
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    judged = cascade(plain, base_rules() + content_rules(), "_text")
    # A filter on _rejected_by itself would be pushed below the steps, with their expressions copied into it again and
    # again; through a random number it isn't, and the steps are computed once.
    kept = judged.select("_row", F.when(F.isnull("_rejected_by"), F.rand(0)).alias("_pass"))
    return kept.where("_pass is not null").select("_row.*")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of every row of docs.
    The statistics are returned, so they are computed for all rows; the content rules run only on rows that pass the
    base. A null text counts as empty: no words, base_failed. Repeated rows are judged each for itself; a very long text is
    one row's arrays. No documents, no rows. Other columns are ignored."""
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    df = with_steps(plain, base_steps() + symbol_steps() + repeat_steps())
    df = df.withColumn("base_failed", F.expr("_n_words < 20 or 100 * _n_repeat_words > 30 * _n_words"))
    df = df.withColumn("_rejected_by", F.when(F.col("base_failed"), F.lit("base")))
    for r in measured(plain.select("_t"), content_rules()):
        alive = F.col("_rejected_by").isNull()
        df = with_steps(df, () if r.name == "symbols" else r.steps, alive)
        df = df.withColumn("_rejected_by", F.when(alive & F.coalesce(r.reject, F.lit(False)), F.lit(r.name)).otherwise(F.col("_rejected_by")))
    stats = [F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return df.select("doc_id", *stats, "base_failed", F.isnull("_rejected_by").alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document. Nulls, empty and very long texts, repeated rows and clashing columns: see
    quality(); an empty table has no rows."""
    return quality(table(spark, sf_dir, "documents"))


QUERIES = {"op7_quality_rules": op7_quality_rules}
SQL = {
    "op7_quality_rules": r"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS w FROM a WHERE len(ws) >= 8),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT p) AS covered FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM v WHERE n > 1) GROUP BY doc_id),
s AS (SELECT a.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.covered, 0)::BIGINT AS n_repeat_words,
    len(ls) AS n_lines, length(regexp_replace(t, '[^A-ZÀ-Þ]+', '', 'g')) AS n_upper
  FROM a LEFT JOIN c ON a.doc_id = c.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (4 * n_symbols > n_words OR 100 * n_upper > 40 * word_chars OR 2 * n_dup_lines > n_lines OR word_chars > 20 * n_words) AS kept
FROM b
""",
}
