"""Queries that write artefacts and read them back through the sources, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.operators import ranking
from tallyframe.plans.fixtures import fixture, table, with_fixtures
from tallyframe.sources import readers, writers
from tallyframe.sources.scratch import scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(with_fixtures("results") + """ SELECT ordinal, dataset, model, status, CASE WHEN "round" <= 2 THEN round(score, 9) END AS score, CASE WHEN "round" > 2 THEN labeled_total END AS labeled_total, CASE WHEN "round" <= 2 THEN 1 ELSE 2 END AS task_index FROM results""")
def discovered_results(spark, sf_dir):
    """Two kinds of result files, with unlike headers in unlike orders, found below one root."""
    root, rows = scratch(spark, "results"), fixture(spark, sf_dir, "results")
    writers.write_csv(rows.where("round <= 2"), f"{root}/task_1", ["ordinal", "dataset", "model", "score", "status"])
    writers.write_csv(rows.where("round > 2"), f"{root}/task_2", ["model", "labeled_total", "dataset", "status", "ordinal"])
    found = readers.discover(spark, root, ("part-*.csv",))
    return found.select(F.col("ordinal").cast("long"), "dataset", "model", "status", F.round(F.col("score").cast("double"), 9).alias("score"), F.col("labeled_total").cast("long"), "task_index")


@query("SELECT event_id::VARCHAR AS \"rank\", event_type AS \"condition\", concat(event_type, ', \"', chr(10), user_id, '\"') AS model_name, concat('''', user_id, '/', event_id) AS counts, CASE WHEN event_id % 3 > 0 THEN 'd' || event_id END AS query_dataset FROM events")
def conditions_file(spark, sf_dir):
    """Quotes, commas and line ends in cells, blanks as nulls, counts kept as text."""
    e, path = table(spark, sf_dir, "events"), scratch(spark, "conditions")
    rows = e.select(F.col("event_type").alias("condition"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("d"), F.col("event_id").cast("string"))).otherwise("").alias("query_dataset"), F.col("event_id").alias("rank"),
        F.concat("event_type", F.lit(', "\n'), F.col("user_id").cast("string"), F.lit('"')).alias("model_name"), F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string")).alias("counts"))
    writers.write_csv(rows, path, ["condition", "query_dataset", "rank", "model_name", "counts"], ("counts",))
    return readers.read_conditions(spark, path).select("rank", "condition", "model_name", "counts", "query_dataset")


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def jsonl_rows(spark, sf_dir):
    c, path = table(spark, sf_dir, "conversations"), scratch(spark, "rows")
    writers.write_jsonl(c, path)
    back = readers.read_jsonl(spark, path, c.schema)
    return back.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(with_fixtures("results") + """, p AS (SELECT dataset, model, max(score) AS score FROM results WHERE status = 'ok' AND score IS NOT NULL AND labeled_total > 0 GROUP BY 1, 2) SELECT dataset, count(*) AS candidates, round(sum(score), 6) AS total, true AS intact FROM p GROUP BY 1""")
def handoff_files(spark, sf_dir):
    """One document a dataset, written, read and checked against its checksum."""
    rows = ranking.with_outcome(fixture(spark, sf_dir, "results")).where("outcome = 'success'").groupBy("dataset", "model").agg(F.max("score").alias("score"))
    path = scratch(spark, "handoffs")
    writers.write_jsonl(writers.handoffs(rows.withColumn("final_rank", F.xxhash64("model"))), path)
    doc = readers.read_jsonl(spark, path, "dataset string, candidates string, checksum string")
    c = F.from_json("candidates", "array<struct<final_rank:bigint,model:string,score:double>>")
    return doc.select("dataset", F.size(c).cast("long").alias("candidates"), F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x["score"]), 6).alias("total"), (F.sha2("candidates", 256) == F.col("checksum")).alias("intact"))


LOGS = """SELECT event_id, concat('start {{"a":', cast(event_id AS {S}), '}} ', event_type, CASE event_id % 4 WHEN 0 THEN ' {{broken' WHEN 1 THEN concat(chr(10), '{{"k":[', cast(user_id AS {S}), ',{{"z":1}}],"b":"}}{{"}} end') WHEN 2 THEN '' ELSE ' {{}} tail' END) AS log FROM {events}"""


@query("SELECT event_id, CASE event_id % 4 WHEN 1 THEN concat('{\"b\": \"}{\", \"k\": [', user_id, ', {\"z\": 1}]}') WHEN 3 THEN '{}' ELSE concat('{\"a\": ', event_id, '}') END AS summary FROM events")
def embedded_objects(spark, sf_dir):
    logs = spark.sql(LOGS.replace("{S}", "string"), events=table(spark, sf_dir, "events"))
    return logs.select("event_id", readers.embedded_object("log").alias("summary"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE concat_ws('|', p_name, p_brand, CASE WHEN p_partkey % 4 = 2 THEN NULL ELSE p_size::VARCHAR END) END AS choices, CASE p_partkey % 4 WHEN 3 THEN '' ELSE concat('Q', chr(10), 'A. ', p_name, chr(10), 'B. ', p_brand, CASE WHEN p_partkey % 4 = 2 THEN '' ELSE concat(chr(10), 'C. ', p_size) END) END AS prompt FROM part")
def parsed_choices(spark, sf_dir):
    """Choices as a JSON list, a Python list, a struct of texts and a text that is no list; and the prompt they make."""
    name, brand, size = F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 4
    raw = F.when(kind == 0, F.concat(F.lit('["'), name, F.lit('", "'), brand, F.lit('", '), size, F.lit("]"))).when(kind == 1, F.concat(F.lit("['"), name, F.lit("', '"), brand, F.lit("', "), size, F.lit("]"))).when(kind == 2, F.concat(F.lit('{"text": ["'), name, F.lit('", "'), brand, F.lit('"]}'))).otherwise(name)
    parsed = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", readers.choices("raw").alias("c"))
    prompt = F.when(F.col("c").isNull(), "").otherwise(text.choices_prompt(F.lit("Q"), F.col("c")))
    return parsed.select("p_partkey", F.when(F.col("c").isNotNull(), F.array_join("c", "|")).alias("choices"), prompt.alias("prompt"))
