"""Run artefacts derived from the star schema, in SQL that both engines run ({S} is the engine's text type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RESULTS = """
SELECT event_id AS ordinal, event_type AS dataset, concat('m', cast(user_id % 12 AS {S})) AS model,
  CASE event_id % 4 WHEN 0 THEN 'A_merged' WHEN 1 THEN 'B_method1_only' WHEN 2 THEN 'C_method2_only' ELSE 'D_baseline' END AS "condition",
  cast(1 + floor(event_id / 4) % 7 AS bigint) AS "rank", cast(1 + floor(event_id / 100) % 5 AS bigint) AS "round",
  CASE event_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'planned' WHEN 2 THEN 'unsupported' ELSE 'ok' END AS status,
  CASE WHEN event_id % 9 = 0 THEN 'macro_f1' ELSE 'accuracy' END AS metric,
  CASE event_id % 3 WHEN 0 THEN 'label_generation_accuracy' WHEN 1 THEN 'tagged_label_generation_accuracy' ELSE 'tagged_multiple_choice_accuracy' END AS evaluation_protocol,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE cast(least(floor(value / 50), 9) AS double) / cast(10 AS double) END AS score,
  cast(event_id % 5 AS bigint) AS labeled_total, ts
FROM {events}
"""
PREDICTIONS = """
SELECT l.doc_id AS idx, concat('m', cast(k.k AS {S})) AS model, d.lang AS dataset,
  CASE WHEN l.doc_id % 29 = 0 THEN NULL WHEN l.quality = 1 AND l.toxic = 1 THEN 'good toxic' WHEN l.quality = 1 THEN 'Good' WHEN l.toxic = 1 THEN 'bad toxic' ELSE 'bad' END AS target_answer,
  CASE WHEN (l.doc_id + k.k) % 37 = 0 THEN '' WHEN (l.doc_id * 7 + k.k * 3) % (4 + k.k) = 0 THEN 'good' WHEN l.quality = 1 THEN 'the good.' ELSE 'bad' END AS prediction
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id CROSS JOIN (VALUES (0), (1), (2)) AS k(k)
"""
PAIRS = """
SELECT a.item_id AS pair_id, a.text AS prediction, b.text AS reference FROM {benchmark} a JOIN {benchmark} b ON b.item_id = a.item_id + 1
"""
NUMBERS = """
SELECT o_orderkey AS pair_id,
  CASE o_orderkey % 6 WHEN 0 THEN concat('It is ', cast(o_orderkey AS {S})) WHEN 1 THEN concat(cast(o_orderkey AS {S}), '/100') WHEN 2 THEN concat(cast(o_orderkey AS {S}), '%')
    WHEN 3 THEN concat('1,', cast(100 + o_orderkey % 900 AS {S}), ' in all') WHEN 4 THEN 'no number here' ELSE concat('first 7, then ', cast(o_orderkey AS {S}), '.50') END AS prediction,
  CASE o_orderkey % 6 WHEN 0 THEN cast(o_orderkey AS {S}) WHEN 1 THEN concat(cast(o_orderkey AS {S}), '%') WHEN 2 THEN concat(cast(o_orderkey AS {S}), '/50')
    WHEN 3 THEN cast(1100 + o_orderkey % 900 AS {S}) WHEN 4 THEN 'No  number, here!' ELSE concat(cast(o_orderkey AS {S}), '.5') END AS reference
FROM {orders}
"""
GENERATIONS = """
SELECT conv_id, turn, (conv_id + turn) % 7 AS kind,
  CASE (conv_id + turn) % 7 WHEN 0 THEN concat('<answer>yes</answer> ', text) WHEN 1 THEN concat(text, '<ANSWER>', chr(10), 'no </ANSWER>')
    WHEN 2 THEN '<answer>maybe</answer> then <answer> yes </answer>' WHEN 3 THEN '<answer>  </answer>' WHEN 4 THEN concat('I pick ["No", "YES"] since ', cast(turn AS {S}))
    WHEN 5 THEN 'Surely the answer must be yes, truly' ELSE '   ' END AS generation
FROM {conversations}
"""
FIXTURES = {"results": RESULTS, "predictions": PREDICTIONS, "pairs": PAIRS, "numbers": NUMBERS, "generations": GENERATIONS}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FIXTURES[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    for name in ("condition", "rank", "round"):
        sql = sql.replace(f'"{name}"', f"`{name}`")
    return spark.sql(sql.replace("{S}", "string"), **used)


def duck(name: str) -> str:
    """The fixture as the body of a CTE."""
    sql = FIXTURES[name].replace("{S}", "varchar")
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def with_fixtures(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({duck(n)})" for n in names)
