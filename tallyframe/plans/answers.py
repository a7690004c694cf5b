"""Queries over gold answers, audits of runs and named conversations, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.functions import vectors as v
from tallyframe.operators import aggregates as agg
from tallyframe.operators import compare, contracts, dialogue, joins, loop, ranking, selection
from tallyframe.operators.contracts import SUMMARY_METRICS
from tallyframe.operators.numbering import numbered
from tallyframe.plans.fixtures import fixture, table, with_fixtures
from tallyframe.plans.runs import C as RUNS_C
from tallyframe.plans.runs import SQL as RUNS_SQL
from tallyframe.sources import readers, writers
from tallyframe.sources.scratch import scratch
from tallyframe.streaming import loop_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' ELSE CASE WHEN event_type LIKE '%u%' THEN substr(event_type, strpos(event_type, 'u')) ELSE event_type END END AS by_pattern,
  CASE WHEN value >= 50 THEN 'high' ELSE value::VARCHAR END AS by_threshold, array_to_string(list_filter([CASE WHEN event_id % 3 > 0 THEN CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' ELSE event_type END END, 'V'], lambda x: x IS NOT NULL), '|') AS listed FROM events""")
def target_answers(spark, sf_dir):
    e, kinds = table(spark, sf_dir, "events"), {"click": "C", "view": "V"}
    listed = F.array(F.when(F.expr("event_id % 3 > 0"), F.col("event_type")).otherwise(" \t"), F.lit(None).cast("string"), F.lit("view"))
    return e.select(
        "event_id", text.target_answer(F.col("event_type"), "u.*", labels=kinds).alias("by_pattern"), text.target_answer(F.col("value"), threshold=50, labels={"1": "high"}).alias("by_threshold"),
        F.array_join(text.target_answers(listed, labels=kinds), "|").alias("listed"),
    )


@query("""SELECT event_id, event_type IN ('click', 'view', 'error') AS found, event_id % 2 = 0 AS nested FROM events""")
def context_paths(spark, sf_dir):
    columns = F.array(F.lit("click"), F.lit("view"), F.lit("error"))
    e = table(spark, sf_dir, "events")
    nested = F.when(F.expr("event_id % 2 = 0"), "view[].x.y").otherwise("x.view")
    return e.select("event_id", text.path_in_columns(F.concat("event_type", F.lit("[].text")), columns).alias("found"), text.path_in_columns(nested, columns).alias("nested"))


TAGGED = ("tagged_label_generation_accuracy", "tagged_multiple_choice_accuracy", "tagged_set_generation", "tagged_answer_exact_match")
_metric = "['accuracy', 'macro_f1', 'exact_match', 'qa_f1', 'rouge_l', 'numeric_match', 'set_f1'][ordinal % 7 + 1]"


@query(with_fixtures("results") + f", m AS (SELECT ordinal, {_metric} AS metric, score, evaluation_protocol AS p, labeled_total AS t FROM results) SELECT ordinal, metric, " + ", ".join(f"CASE WHEN metric = '{m}' THEN score END AS {m}" for m in SUMMARY_METRICS) + ", CASE WHEN p LIKE 'tagged%' THEN t END AS tag_parse_failures FROM m")
def summary_rows(spark, sf_dir):
    names = F.array(*[F.lit(m) for m in SUMMARY_METRICS])
    rows = fixture(spark, sf_dir, "results").select("ordinal", F.element_at(names, (F.col("ordinal") % 7 + 1).cast("int")).alias("metric"), "score", "evaluation_protocol", F.col("labeled_total").alias("tag_parse_failures"))
    return agg.with_metric_columns(rows, SUMMARY_METRICS, F.col("evaluation_protocol").isin(*TAGGED)).select("ordinal", "metric", *SUMMARY_METRICS, "tag_parse_failures")


@query(with_fixtures("results") + """, p AS (SELECT dataset, model, ordinal AS idx, CASE WHEN model = 'm3' THEN ' ' WHEN model = 'm4' AND ordinal % 50 > 0 THEN 'same' ELSE coalesce("condition", '') END AS prediction FROM results WHERE model <> 'm5'),
r AS (SELECT dataset, model, CASE WHEN model = 'm6' THEN NULL ELSE 0.5 END AS score, CASE WHEN model = 'm7' THEN 0 ELSE 9 END AS labeled_total, CASE WHEN model = 'm8' THEN 'no adapter' END AS reason, CASE WHEN model = 'm9' THEN 3 ELSE 0 END AS bad, CASE WHEN model = 'm10' THEN ['A_merged', 'D_baseline'] ELSE [] END AS labels FROM (SELECT DISTINCT dataset, model FROM results)),
c AS (SELECT dataset, model, prediction, count(*) AS n, min(idx) AS i FROM p GROUP BY 1, 2, 3), t AS (SELECT dataset, model, sum(n)::BIGINT AS rows, coalesce(sum(CASE WHEN trim(prediction) = '' THEN n END), 0)::BIGINT AS blanks, count(*) AS kinds, arg_max(prediction, struct_pack(a := n, b := -i)) AS top, max(n) AS m FROM c GROUP BY 1, 2),
o AS (SELECT c.dataset, c.model, string_agg(c.prediction, ', ' ORDER BY c.prediction) AS names FROM c JOIN r ON r.dataset = c.dataset AND r.model = c.model WHERE len(r.labels) > 0 AND c.prediction <> '' AND NOT list_contains(r.labels, c.prediction) GROUP BY 1, 2),
x AS (SELECT r.*, t.*, o.names, r.reason IS NULL AND r.score IS NOT NULL AND r.labeled_total > 0 AS looked FROM r LEFT JOIN t ON t.dataset = r.dataset AND t.model = r.model LEFT JOIN o ON o.dataset = r.dataset AND o.model = r.model)
SELECT dataset, model, CASE WHEN reason IS NOT NULL THEN 'unsupported' WHEN NOT looked THEN 'unmeasured' WHEN coalesce(rows, 0) = 0 OR blanks = rows THEN 'failed' ELSE 'ok' END AS status,
  coalesce(reason, CASE WHEN NOT looked THEN 'No labeled score was produced.' WHEN coalesce(rows, 0) = 0 THEN 'predictions.jsonl is empty despite a labeled score.' WHEN blanks = rows THEN 'All predictions are blank.' END) AS issue,
  concat_ws('; ', CASE WHEN looked AND bad <> 0 THEN 'Tagged-answer parsing failed for 3 examples.' END, CASE WHEN looked AND names IS NOT NULL THEN 'Predictions outside label map values: ' || names END, CASE WHEN looked AND rows >= 10 AND m >= 0.95 * rows THEN 'Degenerate prediction distribution: ' || top END) AS warnings,
  CASE WHEN looked THEN rows END AS prediction_rows, CASE WHEN looked THEN top END AS top_prediction FROM x""")
def run_audits(spark, sf_dir):
    rows = fixture(spark, sf_dir, "results")
    m = F.col("model")
    p = rows.where(m != "m5").select("dataset", "model", F.col("ordinal").alias("idx"), F.when(m == "m3", " ").when((m == "m4") & F.expr("ordinal % 50 > 0"), "same").otherwise(F.coalesce("condition", F.lit(""))).alias("prediction"))
    summaries = rows.select("dataset", "model").distinct().select(
        "dataset", "model", F.when(m != "m6", 0.5).alias("score"), F.when(m == "m7", 0).otherwise(9).alias("labeled_total"), F.when(m == "m8", "no adapter").alias("unsupported_reason"), F.when(m == "m9", 3).otherwise(0).alias("tag_parse_failures"),
        F.when(m == "m10", F.array(F.lit("A_merged"), F.lit("D_baseline"))).otherwise(F.array().cast("array<string>")).alias("label_values"),
    )
    a = agg.run_audit(p, summaries, ["dataset", "model"])
    return a.select("dataset", "model", "status", "issue", F.array_join("warnings", "; ").alias("warnings"), "prediction_rows", "top_prediction")


@query(with_fixtures("predictions") + """, c AS (SELECT dataset, idx % 40 AS value, count(*) AS n, min(idx) AS i FROM predictions GROUP BY 1, 2) SELECT dataset, value::VARCHAR AS value, n, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, i) AS place FROM c) WHERE place <= 20""")
def top_predictions(spark, sf_dir):
    rows = fixture(spark, sf_dir, "predictions").withColumn("prediction", (F.col("idx") % 40).cast("string"))
    return agg.prediction_distribution(rows, ["dataset"])


@query("""WITH b AS (SELECT conv_id, turn, role, trim(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE trim(coalesce(text, '')) <> ''),
h AS (SELECT conv_id, turn, role, pos, t, string_agg(t, chr(10)) OVER w AS plain, string_agg(role || ': ' || t, chr(10)) OVER w AS named, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT 'empathetic' AS kind, conv_id, md5('Emotion: ' || role || chr(10) || 'Situation: s' || conv_id || chr(10) || chr(10) || 'Conversation:' || chr(10) || plain) AS prompt, md5(t) AS response FROM h WHERE n > 0
UNION ALL SELECT 'taskmaster', conv_id, md5('Task instruction: i' || conv_id || chr(10) || chr(10) || 'Conversation:' || chr(10) || named), md5(t) FROM h WHERE n > 0
UNION ALL SELECT 'blended', conv_id, md5('Personas: p | q' || chr(10) || 'Context: c' || conv_id || chr(10) || 'Additional context:' || chr(10) || chr(10) || 'Conversation:' || chr(10) || 'seed' || coalesce(chr(10) || plain, '')), md5(t) FROM h
UNION ALL SELECT 'other', conv_id, md5(text), NULL FROM conversations""")
def adapted_dialogues(spark, sf_dir):
    """The conversations as three known datasets and an unknown one, each adapted by its name."""
    c = table(spark, sf_dir, "conversations")
    grouped = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text"))).alias("u"))
    own = lambda prefix: F.concat(F.lit(prefix), F.col("conv_id").cast("string"))
    flat = c.select("conv_id", "turn", F.col("text").alias("utterance"), F.col("role").alias("context"), own("s").alias("prompt"))
    task = grouped.select(F.col("conv_id").alias("conversation"), own("i").alias("instruction_id"), F.col("u").alias("utterances"))
    blended = grouped.select(F.col("conv_id").alias("conversation"), F.array(F.lit("seed")).alias("previous_utterance"), F.transform("u", lambda x: x["text"]).alias("free_messages"), F.array(F.lit("p"), F.lit("q")).alias("personas"), own("c").alias("context"), F.lit(None).cast("string").alias("additional_context"))
    digest = lambda x: F.md5(F.col(x).cast("binary"))
    parts = [dialogue.adapted(n, d).select(F.lit(k).alias("kind"), F.col(i).alias("conv_id"), digest("_dialogue_prompt").alias("prompt"), digest("_dialogue_response").alias("response")) for k, n, d, i in (
        ("empathetic", "facebook/empathetic_dialogues", flat, "conv_id"), ("taskmaster", "google-research-datasets/taskmaster1", task, "conversation"), ("blended", "ParlAI/blended_skill_talk", blended, "conversation"))]
    other = dialogue.adapted("some/other", c).select(F.lit("other").alias("kind"), "conv_id", digest("text").alias("prompt"), F.lit(None).cast("string").alias("response"))
    return parts[0].union(parts[1]).union(parts[2]).union(other)


@query(with_fixtures("results") + """, p AS (SELECT dataset, model, max(score) AS score, min(ordinal) AS o FROM results WHERE status = 'ok' AND score IS NOT NULL AND labeled_total > 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, o) * 3 AS final_rank FROM p) SELECT dataset, (final_rank // 3)::BIGINT AS rank, model, round(CASE WHEN final_rank = 3 THEN 0.0 ELSE score END, 9) AS score, CASE WHEN final_rank = 6 THEN 'own' ELSE 'Selected by measured preflight.' END AS reason, '' AS error FROM r WHERE final_rank <= 15""")
def frozen_handoffs(spark, sf_dir):
    """Rankings with gaps, written as two source files, frozen, written, read back and held against the contract."""
    root = scratch(spark, "frozen")
    rows = ranking.with_outcome(fixture(spark, sf_dir, "results")).where("outcome = 'success'").groupBy("dataset", "model").agg(F.max("score").alias("score"), F.min("ordinal").alias("at"))
    rows = numbered(rows, [F.desc("score"), "at"], "place", ("dataset",)).withColumn("final_rank", (F.col("place") + 1) * 3)
    rows = rows.select(
        "dataset", "final_rank", F.concat_ws("-", "dataset", "model").alias("candidate_id"), "model", F.when(F.col("final_rank") > 3, F.col("score")).alias("retrieval_score"), F.lit("").alias("source"), F.lit("").alias("intended_use"),
        F.when(F.col("final_rank") == 6, "own").alias("reason"), "score", F.lit("accuracy").alias("metric"), F.lit("").alias("evaluation_protocol"),
    )
    paths = [f"{root}/old", f"{root}/new"]
    writers.write_csv(rows.where("dataset <> 'view'").withColumn("final_rank", F.lit(1)), paths[0], rows.columns)  # replaced by the later source, but for one dataset
    writers.write_csv(rows, paths[1], rows.columns)
    ranked = joins.later_source_wins(*[readers.read_csv(spark, p) for p in paths])
    splits = rows.select("dataset", F.lit("test").alias("split")).distinct()
    docs = writers.frozen_handoffs(ranked, splits, 5, writers.file_checksums(spark, paths))
    docs.write.parquet(f"{root}/handoffs")
    back = spark.read.parquet(f"{root}/handoffs").withColumn("error", contracts.handoff_error(F.col("handoff"), F.col("dataset"), F.lit("test"), F.lit(1)))
    each = back.select("dataset", "error", F.explode(F.from_json(F.get_json_object("handoff", "$.candidates"), "array<struct<rank: bigint, model: string, score: double, reason: string>>")).alias("c"))
    return each.select("dataset", "c.rank", "c.model", F.round("c.score", 9).alias("score"), "c.reason", "error")


@query(RUNS_SQL["selection_loop"])
def streamed_loop(spark, sf_dir):
    """selection_loop over a stream: the results in files of no set order, two to a micro-batch."""
    root, rows = scratch(spark, "loop-stream"), fixture(spark, sf_dir, "results")
    rows.repartition(6, "ordinal").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    loop_stream.run(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return loop.until_stop(loop_stream.rounds_so_far(spark, f"{root}/out", target=100, minimum=0.05)).drop("seen_models")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), m AS (SELECT vec_id, list_transform(range(8), lambda d: list_sum(list_transform(range(8), lambda r: CASE WHEN (r + vec_id) % 3 <> 0 THEN x[r * 8 + d + 1] ELSE 0 END))) AS s, len(list_filter(range(8), lambda r: (r + vec_id) % 3 <> 0)) AS n FROM e),
p AS (SELECT vec_id, list_transform(s, lambda z: z / n) AS p FROM m), q AS (SELECT vec_id, p, greatest(sqrt(list_sum(list_transform(p, lambda z: z * z))), 1e-8) AS l FROM p) SELECT vec_id, round(p[1] / l, 6) AS first, round(list_sum(p) / l, 6) AS total FROM q""")
def masked_mean(spark, sf_dir):
    """An embedding as eight token rows of eight dimensions, of which a mask leaves two in three."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.doubles(F.col("embedding")).alias("x"))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("x", r * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: ((r + F.col("vec_id")) % 3 != 0).cast("int"))
    p = e.select("vec_id", v.mean_pool(tokens, mask).alias("p"))
    return p.select("vec_id", F.round(F.get("p", F.lit(0)), 6).alias("first"), F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_WIDE = 12
_own = {"model": "model", "conditions": "conditions", "status": "status", "protocol": "evaluation_protocol", "metric": "metric", "score": "score::VARCHAR", "eval_labeled_total": "labeled_total::VARCHAR"}


@query(with_fixtures("results") + """, d AS (SELECT *, row_number() OVER (PARTITION BY dataset, model ORDER BY ordinal DESC) AS rn, string_agg("condition", '; ') OVER (PARTITION BY dataset, model ORDER BY ordinal) AS cs FROM results),
p AS (SELECT dataset, model, "condition" AS conditions, CASE WHEN ordinal % 4 = 0 THEN 'missing_task_result' ELSE status END AS status, evaluation_protocol, metric, score, labeled_total, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN ordinal % 3 = 0 THEN 1000000000 ELSE ordinal END, model) AS place FROM d WHERE rn = 1)
SELECT dataset, count(*) AS model_count, count_if(status IN ('ok', 'success')) AS success_count, count_if(status = 'failed') AS failed_count, count_if(status = 'unsupported') AS unsupported_count, count_if(status LIKE 'missing%') AS missing_count, """
       + ", ".join(f"coalesce(max(CASE WHEN place = {i} THEN {_own.get(c, chr(39) * 2)} END), '') AS model_{i}_{c}" for i in range(1, _WIDE + 1) for c in agg.REPORT_FIELDS) + " FROM p GROUP BY 1")
def dataset_report(spark, sf_dir):
    """The last result of each pair, wide, with all fields."""
    rows = fixture(spark, sf_dir, "results")
    last = rows.groupBy("dataset", "model").agg(F.max_by(F.struct("ordinal", F.col("condition").alias("conditions"), "status", F.col("evaluation_protocol").alias("protocol"), "metric", "score", F.col("labeled_total").alias("eval_labeled_total")), "ordinal").alias("r")).select("dataset", "model", "r.*")
    pairs = last.withColumns({"task_index": F.when(F.expr("ordinal % 3 <> 0"), F.col("ordinal")), "status": F.when(F.expr("ordinal % 4 = 0"), "missing_task_result").otherwise(F.col("status"))})
    return agg.dataset_report(pairs, _WIDE)


@query(RUNS_C + """, b AS (SELECT dataset, "round", arg_max(model, struct_pack(s := score, o := -ordinal)) AS best_model, max(score) AS best_score FROM c WHERE outcome = 'success' AND comparable GROUP BY 1, 2),
l AS (SELECT dataset, "round", string_agg(model, '|' ORDER BY o) AS baseline FROM (SELECT dataset, "round", model, min(ordinal) AS o FROM c WHERE outcome = 'success' AND comparable GROUP BY 1, 2, 3) GROUP BY 1, 2),
x AS (SELECT dataset, "round", string_agg(model, '|' ORDER BY o) AS excluded FROM (SELECT dataset, "round", model, min(ordinal) AS o FROM c WHERE NOT (outcome = 'success' AND comparable) GROUP BY 1, 2, 3) GROUP BY 1, 2), r AS (SELECT DISTINCT dataset, "round" FROM c)
SELECT r.dataset, r.round, best_model, best_score, coalesce(baseline, '') AS baseline, coalesce(excluded, '') AS excluded, CASE WHEN best_model IS NULL THEN '' ELSE 'Best comparable model in this round was ' || best_model || ' with score ' || printf('%.4f', best_score) || '.' END AS first_note
FROM r LEFT JOIN b ON b.dataset = r.dataset AND b.round = r.round LEFT JOIN l ON l.dataset = r.dataset AND l.round = r.round LEFT JOIN x ON x.dataset = r.dataset AND x.round = r.round""")
def aligned_feedback(spark, sf_dir):
    f = loop.feedback(fixture(spark, sf_dir, "results"))
    first = F.coalesce(F.get("observations", F.lit(0)), F.lit(""))
    return f.select("dataset", "round", "best_model", "best_score", F.array_join("baseline_models", "|").alias("baseline"), F.array_join("candidate_exclusions", "|").alias("excluded"), F.when(F.startswith(first, F.lit("Best")), first).otherwise("").alias("first_note"))


@query(with_fixtures("results") + """, f AS (SELECT dataset, model, min(ordinal) AS o FROM results WHERE CASE WHEN ordinal % 5 = 0 THEN ordinal % 2 = 0 ELSE NOT (status = 'planned' OR status = 'ok' AND score IS NOT NULL AND labeled_total > 0) END GROUP BY 1, 2) SELECT dataset, string_agg(model, '|' ORDER BY o) AS models FROM f GROUP BY 1""")
def failed_models(spark, sf_dir):
    """Rows of two naming schemes; every fifth has an outcome instead of a status."""
    r = fixture(spark, sf_dir, "results")
    rows = r.select("ordinal", F.when(F.expr("ordinal % 2 = 0"), F.col("dataset")).alias("query_dataset"), F.when(F.expr("ordinal % 2 = 1"), F.col("dataset")).alias("dataset"), F.when(F.expr("ordinal % 3 = 0"), F.col("model")).otherwise("").alias("model_name"), "model",
        F.when(F.expr("ordinal % 5 <> 0"), F.col("status")).alias("eval_status"), "score", F.col("labeled_total").alias("eval_labeled_total"), F.when(F.expr("ordinal % 2 = 0"), "Failure").otherwise("success").alias("outcome"))
    return selection.failed_models(rows).select("dataset", F.array_join("models", "|").alias("models"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'org' || p_partkey || '/a_b' ELSE 'x' || p_partkey || '/y_z' END AS model FROM part""")
def log_models(spark, sf_dir):
    """Logs of a run; a third of the models are among its candidates, the others are read off the names."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    known = F.expr("p_partkey % 3 = 0")
    logs = p.select("p_partkey", (F.col("p_partkey") % 7).alias("run"), F.concat(F.when(known, F.concat(F.lit("org"), key, F.lit("_a_b"))).otherwise(F.concat(F.lit("x"), key, F.lit("_y_z"))), F.when(F.expr("p_partkey % 2 = 0"), "_smoke.stderr.txt").otherwise("_full.stderr.txt")).alias("name"))
    return joins.models_of_logs(logs, p.where(known).select((F.col("p_partkey") % 7).alias("run"), F.concat(F.lit("org"), key, F.lit("/a_b")).alias("model"))).select("p_partkey", "model")


@query("SELECT DISTINCT (event_id % 23)::INT AS task_index FROM events WHERE event_id % 23 % 4 = 1")
def out_of_memory_tasks(spark, sf_dir):
    root = scratch(spark, "logs")
    e = table(spark, sf_dir, "events").withColumn("task", F.col("event_id") % 23)
    line = F.when(F.expr("task % 4 = 1 and event_id % 3 = 0"), "x CUDA out of memory y").otherwise(F.col("event_type"))
    e.select("task", F.lit("m").alias("model"), line.alias("value")).write.partitionBy("task", "model").text(root)
    return readers.tasks_with_line(spark, root, "part-*.txt")


@query("""SELECT event_id, event_type AS dataset, 0::BIGINT AS total, CASE WHEN event_id % 2 = 0 THEN 'Unsupported evaluation: ' || event_type ELSE 'first note' END AS unsupported_reason FROM events WHERE event_id % 3 = 0""")
def unsupported_rows(spark, sf_dir):
    notes = F.when(F.expr("event_id % 2 = 0"), F.array(F.lit("first note"), F.concat(F.lit("Unsupported evaluation: "), F.col("event_type")), F.lit("Unsupported evaluation: later"))).otherwise(F.array(F.lit("first note")))
    none = F.lit("")
    plans = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("model"), F.col("event_type").alias("dataset"), none.alias("split"), none.alias("task"), F.when(F.expr("event_id % 3 = 0"), "unsupported").otherwise("x").alias("protocol"), none.alias("metric"), notes.alias("notes"))
    return selection.unsupported_rows(plans).select(F.col("model").cast("long").alias("event_id"), "dataset", "total", "unsupported_reason")


@query("SELECT event_type AS dataset, count_if(event_id % 4 = 0) AS ours, count_if(event_id % 4 = 1) AS tie, 0::BIGINT AS incomplete FROM events GROUP BY 1")
def winner_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset"), F.when(F.expr("event_id % 4 = 0"), "ours").when(F.expr("event_id % 4 = 1"), "tie").otherwise("theirs").alias("winner"))
    return compare.winner_counts(rows, ("ours", "tie", "incomplete"), ("dataset",))
