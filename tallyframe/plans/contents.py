"""Queries over JSON texts of unknown shape, with their oracle SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tallyframe.functions import json_text
from tallyframe.operators import contracts, search, sequences
from tallyframe.operators.text_metrics import score_rows
from tallyframe.plans.cycles import derived, duck
from tallyframe.plans.fixtures import fixture, table, with_fixtures
from tallyframe.plans.runs import norm
from tallyframe.sources import readers, task_folders, writers
from tallyframe.sources.scratch import scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


#: Objects, arrays and texts at depths 1 to 9, in three shapes; one row in five is no JSON.
NESTED = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('{{"b": [1, {{"y": "', event_type, '", "x": null}}], "a": ', cast(user_id AS {S}), '}}')
  WHEN 1 THEN concat('{{"text": ["', event_type, '", {{"deep": [[[["u', cast(user_id AS {S}), '"]]]]}}], "other": "hidden"}}')
  WHEN 2 THEN concat('[[[[[[[["', event_type, '", "  ", 7.50, true]]]]]]], {{"z": {{"text": "t', cast(user_id AS {S}), '", "w": "hidden"}}, "a": "last"}}]')
  WHEN 3 THEN concat('  "\\\\u00e9 ', event_type, '" ') ELSE concat('plain ', event_type) END AS body FROM {events}"""
NESTED_SQL = duck(NESTED.replace("{{", "{").replace("}}", "}").replace("\\\\", "\\"), "events")


@query(f"""WITH n AS ({NESTED_SQL}) SELECT n.event_id, array_to_string(CASE n.event_id % 5 WHEN 0 THEN [event_type] WHEN 1 THEN [event_type, 'u' || user_id] WHEN 2 THEN [event_type, 't' || user_id, 'last'] WHEN 3 THEN ['é ' || event_type] ELSE [n.body] END, '|') AS leaves
FROM n JOIN events ON n.event_id = events.event_id""")
def text_leaves(spark, sf_dir):
    rows = derived(spark, sf_dir, NESTED, "events")
    return rows.select("event_id", F.array_join(json_text.text_leaves(F.col("body")), "|").alias("leaves"))


@query(f"""WITH n AS ({NESTED_SQL}) SELECT n.event_id, sha256(CASE n.event_id % 5 WHEN 0 THEN '{{"a":' || user_id || ',"b":[1,{{"x":null,"y":"' || event_type || '"}}]}}' WHEN 1 THEN '{{"other":"hidden","text":["' || event_type || '",{{"deep":[[[["u' || user_id || '"]]]]}}]}}'
  WHEN 2 THEN '[[[[[[[["' || event_type || '","  ",7.5,true]]]]]]],{{"a":"last","z":{{"text":"t' || user_id || '","w":"hidden"}}}}]' WHEN 3 THEN '"é ' || event_type || '"' END) AS digest FROM n JOIN events ON n.event_id = events.event_id""")
def json_digests(spark, sf_dir):
    rows = derived(spark, sf_dir, NESTED, "events")
    return rows.select("event_id", json_text.json_digest(F.col("body")).alias("digest"))


DEEP_SETS = """SELECT event_id AS pair_id, concat('[[[[[[{{"type":"chem","text":["', event_type, '", "The"]}}, "u', cast(user_id AS {S}), '; the ', event_type, '"]]]]], 1.50, null, true, {{"b": 1, "a": [2]}}]') AS prediction,
  CASE event_id % 3 WHEN 0 THEN concat('[{{"mention":"', event_type, '","type":"Chemical"}}]') WHEN 1 THEN concat('U', cast(user_id AS {S}), ', 15;true') ELSE '{{"a": [2], "b": 1}}' END AS reference FROM {events}"""


@query("""WITH s AS (SELECT event_id AS pair_id, replace(event_type, '_', '') AS t, user_id AS u, event_id % 3 AS k FROM events), n AS (SELECT pair_id, list_distinct(['chemical::' || t, 'u' || u, t, '15', 'true', '2 b 1']) AS p,
  CASE k WHEN 0 THEN ['chemical::' || t] WHEN 1 THEN ['u' || u, '15', 'true'] ELSE ['2 b 1'] END AS r FROM s) SELECT pair_id, round(2.0::DOUBLE * len(list_intersect(p, r)) / (len(p) + len(r)), 9) AS score FROM n""")
def deep_sets(spark, sf_dir):
    return score_rows(derived(spark, sf_dir, DEEP_SETS, "events"), "set_f1").select("pair_id", F.round("score", 9).alias("score"))


#: The words of every message as tokens, in windows of eight that overlap by four; every ninth token is without characters.
OFFSETS = """SELECT seq, cast(pos div 4 - z AS bigint) AS `window`, pos, label, start, `end` FROM (SELECT conv_id * 1000 + turn AS seq, cast(w.i AS bigint) AS pos, w.s AS start, w.s + CASE WHEN w.i % 9 = 8 THEN 0 ELSE w.n END AS `end`,
  element_at(array('B-chem', 'I-chem', 'I-x/y', 'O', 'loc', 'i-loc', 'o'), cast(w.i % 7 AS int) + 1) AS label
  FROM {conversations} LATERAL VIEW inline(transform(aggregate(split(text, ' '), named_struct('at', 0, 'out', cast(array() AS array<struct<s: int, n: int>>)), (a, x) -> named_struct('at', a.at + length(x) + 1, 'out', concat(a.out, array(named_struct('s', a.at, 'n', length(x)))))).out, (x, i) -> named_struct('i', i, 's', x.s, 'n', x.n))) w) t
  CROSS JOIN (VALUES (0), (1)) AS g(z) WHERE pos div 4 >= z"""


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS seq, text, string_split(text, ' ') AS ws FROM conversations WHERE text IS NOT NULL),
u AS (SELECT seq, text, unnest(range(len(ws))) AS pos, unnest(list_transform(range(len(ws)), lambda i: coalesce(list_sum(list_transform(ws[:i], lambda w: length(w) + 1)), 0)))::INT AS s, unnest(ws) AS w FROM c),
t AS (SELECT seq, text, pos, s, s + CASE WHEN pos % 9 = 8 THEN 0 ELSE length(w) END AS e, ['B', 'I', 'I', 'O', 'B', 'I', 'O'][pos % 7 + 1] AS pre, ['chemical', 'chemical', 'x y', '', 'loc', 'loc', ''][pos % 7 + 1] AS kind, pos // 4 - z AS win FROM u CROSS JOIN (VALUES (0), (1)) AS g(z) WHERE pos // 4 >= z),
l AS (SELECT *, lag(pre) OVER w AS lp, lag(kind) OVER w AS lk FROM t WHERE e > s WINDOW w AS (PARTITION BY seq, win ORDER BY pos)),
n AS (SELECT *, sum(CASE WHEN pre <> 'O' AND (pre = 'B' OR lp IS NULL OR lp = 'O' OR lk <> kind) THEN 1 ELSE 0 END) OVER (PARTITION BY seq, win ORDER BY pos) AS span FROM l),
x AS (SELECT seq, win, span, first(kind) AS kind, arg_min(s, pos) AS s, max(e) AS e, first(text) AS text FROM n WHERE pre <> 'O' GROUP BY 1, 2, 3),
y AS (SELECT *, text[s + 1:e] AS cut FROM x)
SELECT seq, kind AS type, arg_max(s, struct_pack(a := win, b := span)) AS start, md5(arg_max(cut, struct_pack(a := win, b := span))) AS digest, min(win)::BIGINT AS first_window FROM y GROUP BY seq, kind, """ + norm("cut"))
def offset_entities(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text")
    e = sequences.bio_entities(derived(spark, sf_dir, OFFSETS, "conversations"), texts)
    return e.select("seq", "type", "start", F.md5(F.col("text").cast("binary")).alias("digest"), "first_window")


@query("""WITH c AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), q AS (SELECT label, arg_min(x, vec_id) AS y, min(vec_id) AS own FROM c GROUP BY 1),
s AS (SELECT 'dataset' || q.label AS query_dataset, vec_id, round(list_sum(list_transform(list_zip(x, y), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(x, lambda z: z * z))) * sqrt(list_sum(list_transform(y, lambda z: z * z)))), 6) AS score FROM c CROSS JOIN q)
SELECT query_dataset, rank::INT AS rank, vec_id AS dataset_node_id, score AS cosine_similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_dataset ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 25""")
def ranked_similarities(spark, sf_dir):
    """The ranking of a query vector a label, written as a ranked file and read back."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label"), F.col("embedding").cast("array<double>").alias("x"))
    queries = e.groupBy("label").agg(F.min_by("x", "id").alias("x")).select(F.col("label").cast("long").alias("id"), "x")
    ranked = search.top_rows(e.select("id", "x"), queries, 25)
    path = scratch(spark, "ranked")
    writers.write_similarities(ranked, path, F.concat(F.lit("dataset"), F.col("query_id").cast("string")), F.concat(F.lit("node"), F.col("id").cast("string")))
    back = readers.read_csv(spark, path)
    return back.select("query_dataset", F.col("rank").cast("int").alias("rank"), F.col("dataset_node_id").cast("long").alias("dataset_node_id"), F.col("cosine_similarity").cast("double").alias("cosine_similarity"))


#: Hand-overs with one fault in most of them.
HANDOFFS = """SELECT event_id, concat('{{"handoff_version": ', CASE event_id % 13 WHEN 1 THEN '2' ELSE '1' END, ', "mock": ', CASE event_id % 13 WHEN 2 THEN '"no"' ELSE 'false' END, ', "owner": "', CASE event_id % 13 WHEN 3 THEN '  ' ELSE event_type END,
  '", "retrieval_agent": "a", "dataset": "', event_type, '", "split": "test", ', CASE event_id % 13 WHEN 4 THEN '' ELSE concat('"round": ', cast(user_id % 3 AS {S}), ', ') END,
  '"candidates": [', CASE event_id % 13 WHEN 5 THEN '' ELSE concat('{{"candidate_id": "c1", "condition": "x", "model": "m', cast(user_id AS {S}), '", "source": "s", "intended_use": "', CASE event_id % 13 WHEN 6 THEN 'other' ELSE 'direct_inference' END, '", "reason": "r", "rank": ', CASE event_id % 13 WHEN 7 THEN '1.5' ELSE '1' END, ', "score": 0.5}},',
    '{{"candidate_id": "', CASE event_id % 13 WHEN 8 THEN 'c1' ELSE 'c2' END, '", "condition": "x", "model": "m", "source": "s", "intended_use": "direct_inference", "reason": "r", "rank": 2, "score": ', CASE event_id % 13 WHEN 9 THEN 'true' ELSE '1e3' END, '}}') END, ']',
  CASE event_id % 13 WHEN 10 THEN ', "provider_input_checksum": "xyz"' WHEN 11 THEN ', "continuation_review": {{"required": true, "consensus": true, "decision": "stop", "retrieval": {{"improvement_probable": true, "confidence": 1.5, "reasoning": "r"}}, "critic": {{}}, "orchestrator": {{}}}}' ELSE '' END, CASE event_id % 13 WHEN 12 THEN '' ELSE '}}' END) AS handoff FROM {events}"""


@query("""SELECT event_id, CASE event_id % 13 WHEN 1 THEN '$.handoff_version: not 1' WHEN 2 THEN '$.mock: not a truth value' WHEN 3 THEN '$.owner: blank' WHEN 4 THEN '$: missing round' WHEN 5 THEN '$.candidates: fewer than 1' WHEN 6 THEN '$.candidates[0].intended_use: not one of ''direct_inference'''
  WHEN 7 THEN '$.candidates[0].rank: not a whole number' WHEN 8 THEN '$.candidates: repeated candidate_id' WHEN 9 THEN '$.candidates[1].score: not a number' WHEN 10 THEN '$.provider_input_checksum: not of its form' WHEN 11 THEN '$.continuation_review.retrieval.confidence: more than 1'
  WHEN 12 THEN '$: not JSON' ELSE CASE WHEN user_id % 3 <> 1 THEN '$.round: not the expected one' ELSE '' END END AS error FROM events""")
def handoff_contract(spark, sf_dir):
    rows = derived(spark, sf_dir, HANDOFFS, "events").join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    return rows.select("event_id", contracts.handoff_error(F.col("handoff"), F.col("event_type"), F.lit("test"), F.lit(1)).alias("error"))


CONTEXTS = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('{{"dataset": "', CASE event_id % 11 WHEN 1 THEN 'other' ELSE event_type END, '", "models": ["m1", ', CASE event_id % 11 WHEN 2 THEN '2' ELSE concat('"m', cast(user_id % 2 AS {S}), '"') END, '], "confidence": "', CASE event_id % 11 WHEN 3 THEN 'sure' ELSE 'high' END,
  '", "model_context": {{"notes": ""', CASE event_id % 11 WHEN 4 THEN ', "zeta": 1, "eta": 2' ELSE '' END, '}}, "dataset_context": {{"question_column": "q", "answer_column": "a", "choices_column": "", "image_column": "", "task": "qa", "label_map": {{"0": ', CASE event_id % 11 WHEN 5 THEN '7' ELSE '"no"' END, ', "1": "yes"}}, "prompt_template": "", "notes": ""',
  CASE event_id % 11 WHEN 6 THEN ', "evaluation_method": "rouge_l"' WHEN 7 THEN ', "label_threshold": true' WHEN 8 THEN ', "label_threshold": null, "evaluation_method": "qa_f1"' WHEN 9 THEN ', "choices_columns": ["a", ["b"]]' ELSE '' END, '}}}}') END AS context FROM {events}"""


@query("""WITH k AS (SELECT event_id, event_type, user_id, event_id % 11 AS k FROM events), e AS (SELECT *, CASE k WHEN 0 THEN 'evaluation_context is missing' WHEN 1 THEN '$.dataset: not the expected one' WHEN 2 THEN '$.models[1]: not a text' WHEN 3 THEN '$.confidence: not one of ''high'', ''low'', ''medium''' WHEN 4 THEN '$.model_context: unknown eta, zeta'
  WHEN 5 THEN '$.dataset_context.label_map.0: not a text' WHEN 6 THEN '$.dataset_context: evaluation_method does not fit the task' WHEN 7 THEN '$.dataset_context.label_threshold: not a number' WHEN 9 THEN '$.dataset_context.choices_columns[1]: not a text' ELSE CASE WHEN user_id % 2 = 0 THEN '$.models: not the expected ones' ELSE '' END END AS error FROM k)
SELECT event_id, event_type AS dataset, CASE WHEN error = '' THEN 'ready' ELSE 'failed' END AS status, CASE WHEN error = '' THEN 'auto' END AS split, CASE WHEN error = '' THEN 'qa' END AS task, CASE WHEN error = '' THEN CASE WHEN k = 8 THEN 'qa_f1' ELSE 'auto' END END AS metric, CASE WHEN error = '' THEN 'high' END AS confidence, error AS errors FROM e""")
def context_readiness(spark, sf_dir):
    """A spec an event: its context is read, checked and reported on."""
    rows = derived(spark, sf_dir, CONTEXTS, "events").join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    specs = rows.select(F.concat_ws("#", "event_type", F.col("event_id").cast("string")).alias("key"), F.col("event_type").alias("dataset"), F.lit(None).cast("string").alias("split"), F.array(F.lit("m1"), F.lit("m1")).alias("models"), "context", "event_id")
    report = contracts.readiness(specs, ("event_id",))
    return report.withColumn("errors", F.array_join("errors", "; "))


@query(with_fixtures("results") + """, t AS (SELECT *, ordinal % 37 AS task_index FROM results), f AS (SELECT task_index, arg_min(dataset, ordinal) AS dataset, arg_min(status, ordinal) AS eval_status, arg_min(model, ordinal) AS model FROM t WHERE task_index % 6 <> 5 GROUP BY 1),
b AS (SELECT task_index, count(*) AS failures FROM t WHERE status = 'failed' AND task_index % 4 = 0 GROUP BY 1)
SELECT s.task_index, f.dataset, f.model, coalesce(f.eval_status, 'missing_task_result') AS eval_status, coalesce(b.failures, 0) AS failures FROM (SELECT DISTINCT task_index::INT AS task_index FROM t) s LEFT JOIN f ON s.task_index = f.task_index LEFT JOIN b ON s.task_index = b.task_index""")
def task_folder_results(spark, sf_dir):
    """37 task folders, of which some have no result and some an array of failures, read through the registered source."""
    root = scratch(spark, "tasks")
    t = fixture(spark, sf_dir, "results").withColumn("task", F.col("ordinal") % 37)
    rows = t.where("task % 6 <> 5").repartition("task").sortWithinPartitions("task", "ordinal")
    rows.select("task", "dataset", "model", F.col("status").alias("eval_status")).write.partitionBy("task").option("header", True).csv(f"{root}/results")
    failed = t.where("status = 'failed' and task % 4 = 0").groupBy("task").agg(F.to_json(F.collect_list(F.struct("dataset", "model"))).alias("value"))
    failed.write.partitionBy("task").text(f"{root}/failures")
    results = task_folders.read_tasks(spark, f"{root}/results", "part-*.csv", ["dataset", "model", "eval_status"])
    failures = task_folders.read_tasks(spark, f"{root}/failures", "part-*.txt", [], "failures").groupBy("task_index").agg(F.count_if(F.get_json_object("failure", "$.model").isNotNull()).alias("failures"))
    merged = task_folders.task_results(t.select(F.col("task").cast("int").alias("task_index")).distinct(), results, ["dataset", "model", "eval_status"], "eval_status")
    return merged.join(failures, "task_index", "left").select("task_index", "dataset", "model", "eval_status", F.coalesce("failures", F.lit(0).cast("long")).alias("failures"))


@query("SELECT event_type AS source, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE event_type <> 'view' GROUP BY 1")
def stored_datasets(spark, sf_dir):
    """A dataset a type, stored by subset and split; the clicks lie under their fallback's name, the purchases are flattened."""
    root, e = scratch(spark, "datasets"), table(spark, sf_dir, "events").where("event_type <> 'view'")
    e.withColumn("d", F.when(F.col("event_type") == "click", "old-clicks").otherwise(F.col("event_type"))).write.partitionBy("d").parquet(f"{root}/all")
    names = [r.event_type for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # a few types
    parts = [readers.load_dataset(spark, f"{root}/all", f"d={n}", fallbacks={"d=click": ("d=old-clicks", "")}, flatten={"d=purchase": lambda x: x.select("event_id", F.lit("purchase").alias("event_type"))}) for n in names]
    rows = reduce(lambda a, b: a.unionByName(b), [p.select("event_id", "event_type") for p in parts])
    return rows.groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
