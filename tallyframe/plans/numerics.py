"""Queries over vectors, logits, sequences, plans and streams, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.functions import vectors as v
from tallyframe.operators import planning, selection, search, sequences
from tallyframe.plans.fixtures import fixture, table, with_fixtures
from tallyframe.streaming import monitor

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", v.doubles(F.col("embedding")).alias("x"))


E = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"
N = "greatest(sqrt(list_sum(list_transform({x}, lambda z: z * z))), 1e-8)"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def _dot(a: str, b: str) -> str:
    return DOT.replace("{a}", a).replace("{b}", b)


def _norm(x: str) -> str:
    return N.replace("{x}", x)


@query(E + f""", q AS (SELECT vec_id AS query_id, x AS y FROM e WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round({_dot('x', 'y')} / ({_norm('x')} * {_norm('y')}), 6) AS score FROM q CROSS JOIN e)
SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def cosine_topk(spark, sf_dir):
    """Every row whose id is divisible by 50 against all rows. A task keeps ten rows a query."""
    return vector_search(embeddings(spark, sf_dir), 50, 10)


def vector_search(e, every: int, top: int):
    """(query_id, vec_id, score, rank): the `top` most similar rows (vec_id, x) of each query, of equals the first."""
    rows = e.select(F.col("vec_id").cast("long").alias("id"), "x")
    found = search.top_rows(rows, rows.where(F.col("id") % every == 0), top)
    return found.select("query_id", F.col("id").alias("vec_id"), "score", "rank")


CENTRES = """, u AS (SELECT label, generate_subscripts(x, 1) AS d, unnest(x) AS z FROM e), m AS (SELECT label, d, avg(z) AS z FROM u GROUP BY 1, 2), c AS (SELECT label, list(z ORDER BY d) AS y FROM m GROUP BY 1)"""


def centres(e):
    dims = e.select("label", F.posexplode("x").alias("d", "z")).groupBy("label", "d").agg(F.avg("z").alias("z"))
    return dims.groupBy("label").agg(v.unit(F.transform(F.array_sort(F.collect_list(F.struct("d", "z"))), lambda x: x["z"])).alias("y"))


@query(E + CENTRES + f" SELECT label, round(list_sum(list_transform(y, lambda z: z / {_norm('y')})), 6) AS total, round(list_max(y) / {_norm('y')}, 6) AS top FROM c")
def mean_pool(spark, sf_dir):
    """Averages by place, with a partial step: no array of a label's vectors. v.mean_pool() is for the rows of one text."""
    p = centres(embeddings(spark, sf_dir)).select("label", F.col("y").alias("p"))
    return p.select("label", F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.array_max("p"), 6).alias("top"))


@query(E + CENTRES + f""", s AS (SELECT e.vec_id, c.label, round({_dot('e.x', 'c.y')} / {_norm('c.y')}, 6) AS score FROM e CROSS JOIN c)
SELECT vec_id, label AS predicted, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rn FROM s) WHERE rn = 1""")
def embedding_label(spark, sf_dir):
    """One row with all label vectors meets every row; Spark broadcasts it if it is small enough."""
    e = embeddings(spark, sf_dir)
    every = centres(e).agg(F.array_sort(F.collect_list(F.struct("label", "y"))).alias("labels"))
    scored = e.crossJoin(every).select("vec_id", F.transform("labels", lambda c: F.struct(F.round(v.dot(F.col("x"), c["y"]), 6).alias("score"), (-c["label"]).alias("neg"))).alias("s"))
    best = scored.select("vec_id", F.array_max("s").alias("b"))
    return best.select("vec_id", (-F.col("b.neg")).alias("predicted"), F.col("b.score").alias("score"))


LSE = "(list_max(x) + ln(list_sum(list_transform(x, lambda z: exp(z - list_max(x))))))"


@query(E + f" SELECT vec_id, round(x[label + 1] - {LSE}, 6) AS logprob, list_position(x, list_max(x))::INT - 1 AS predicted FROM e")
def label_logprob(spark, sf_dir):
    x = F.col("x")
    return embeddings(spark, sf_dir).select("vec_id", F.round(v.token_logprob(x, F.col("label")), 6).alias("logprob"), v.argmax(x).alias("predicted"))


@query(E + """, h AS (SELECT vec_id, x, list_filter(range(64), lambda i: x[i + 1] >= 0.35) AS hits FROM e) SELECT vec_id, array_to_string(CASE WHEN len(hits) > 0 THEN hits ELSE [list_position(x, list_max(x)) - 1] END, ',') AS labels FROM h""")
def sigmoid_multilabel(spark, sf_dir):
    shifted = F.transform("x", lambda z: z - 0.35)
    e = embeddings(spark, sf_dir).select("vec_id", shifted.alias("x"))
    return e.select("vec_id", F.array_join(v.sigmoid_labels(F.col("x")).cast("array<string>"), ",").alias("labels"))


@query(E + """, p AS (SELECT a.vec_id, a.x AS s, b.x AS t FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
u AS (SELECT vec_id, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS sv, unnest(t) AS tv FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sv DESC, i) AS sr, row_number() OVER (PARTITION BY vec_id ORDER BY tv DESC, i) AS tr FROM u),
c AS (SELECT a.vec_id, a.i AS s, b.i AS e, a.sv + b.tv AS score, a.sr, b.tr FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.sr <= 20 AND b.tr <= 20 AND b.i >= a.i AND b.i - a.i + 1 <= 16),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, sr, tr) AS rn FROM c)
SELECT vec_id, s::INT AS s, e::INT AS e, round(score, 6) AS score FROM k WHERE rn = 1""")
def span_search(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    b = e.join(nxt, "vec_id").select("vec_id", v.best_span(F.col("x"), F.col("y"), 16).alias("b")).where("b is not null")
    return b.select("vec_id", "b.s", "b.e", F.round("b.score", 6).alias("score"))


LABELLED = """SELECT event_id // 40 AS seq, event_id AS pos, CASE event_id % 7 WHEN 0 THEN 'B-per' WHEN 1 THEN 'I-per' WHEN 2 THEN 'I-loc' WHEN 3 THEN 'O' WHEN 4 THEN 'loc' WHEN 5 THEN 'I-loc' ELSE 'O' END AS label, event_type AS token FROM events"""


@query(f"""WITH t AS ({LABELLED}), p AS (SELECT *, CASE WHEN label = 'O' THEN 'O' WHEN label[2] = '-' THEN label[1] ELSE 'B' END AS pre, CASE WHEN label[2] = '-' THEN label[3:] ELSE label END AS kind FROM t),
l AS (SELECT *, lag(pre) OVER w AS lp, lag(kind) OVER w AS lk FROM p WINDOW w AS (PARTITION BY seq ORDER BY pos)),
s AS (SELECT *, sum(CASE WHEN pre <> 'O' AND (pre = 'B' OR lp IS NULL OR lp = 'O' OR lk <> kind) THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY pos) AS span FROM l)
SELECT seq, first(kind) AS type, min(pos) AS first_pos, max(pos) AS last_pos, string_agg(token, ' ' ORDER BY pos) AS text FROM s WHERE pre <> 'O' GROUP BY seq, span""")
def bio_decode(spark, sf_dir):
    rows = spark.sql(LABELLED.replace("event_id // 40", "event_id div 40").replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    return sequences.bio_spans(rows)


@query("""WITH b AS (SELECT doc_id, list_transform(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> ''), lambda w: length(w)::BIGINT) AS ids FROM documents), k AS (SELECT *, doc_id // 16 AS batch FROM b), m AS (SELECT batch, max(len(ids)) AS n FROM k GROUP BY 1)
SELECT doc_id, md5(array_to_string(list_concat(ids, list_transform(range(n - len(ids)), lambda i: 0::BIGINT)), ',')) AS ids, len(ids)::INT AS n_real, n::INT AS n FROM k JOIN m ON k.batch = m.batch""")
def pad_rows(spark, sf_dir):
    """Rows of numbers of whole texts (the lengths of their words), padded to the longest of their batch of sixteen."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 16).alias("batch"), F.transform(words, lambda w: F.length(w).cast("bigint")).alias("ids"))
    rows = rows.join(rows.groupBy("batch").agg(F.max(F.size("ids")).alias("n")), "batch")
    return rows.select("doc_id", F.md5(F.array_join(v.pad(F.col("ids"), F.col("n")).cast("array<string>"), ",").cast("binary")).alias("ids"), F.size("ids").alias("n_real"), "n")


@query("SELECT vec_id, array_to_string(list_concat(x[1:4], x[-12:]), ',') AS kept FROM (SELECT vec_id, list_transform(range(64), lambda i: vec_id + i) AS x FROM embeddings)")
def context_budget(spark, sf_dir):
    ids = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("vec_id") + i)
    return table(spark, sf_dir, "embeddings").select("vec_id", ids.alias("x")).select("vec_id", F.array_join(v.head_and_tail(F.col("x"), 16).cast("array<string>"), ",").alias("kept"))


@query("""WITH t AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS left_at, l_quantity + 3 AS right_at FROM lineitem), s AS (SELECT o_orderkey AS k, 10.0::DOUBLE AS a, 20.0::DOUBLE AS b FROM orders)
SELECT t.k AS l_orderkey, count(*) AS tokens FROM t JOIN s ON t.k = s.k AND t.left_at < s.b AND t.right_at > s.a GROUP BY 1""")
def offset_overlap(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("left"), (F.col("l_quantity") + 3).alias("right"))
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(10.0).alias("start"), F.lit(20.0).alias("end"))
    return sequences.overlapping(t, s, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("tokens"))


# --- planning ------------------------------------------------------------------------------------------------------

TASKS = ("classification", "image_classification", "multiple_choice", "multilabel_classification", "qa", "numeric_qa", "summarization", "token_classification", "relation_extraction", "generation", "unknown")
METRICS = ("accuracy", "macro_f1", "set_f1", "exact_match", "qa_f1", "numeric_match", "rouge_l")
_fits = " ".join(f"WHEN '{t}' THEN metric IN ({', '.join(repr(m) for m in ms)})" for t, ms in planning.TASK_METRICS.items())


@query(f"SELECT event_id, {list(TASKS)}[event_id % 11 + 1] AS task, {list(METRICS)}[user_id % 7 + 1] AS metric, CASE task {_fits} ELSE false END AS fits FROM events")
def method_matches_task(spark, sf_dir):
    pick = lambda xs, at: F.element_at(F.array(*[F.lit(x) for x in xs]), at.cast("int") + 1)
    rows = table(spark, sf_dir, "events").select("event_id", pick(TASKS, F.col("event_id") % 11).alias("task"), pick(METRICS, F.col("user_id") % 7).alias("metric"))
    return rows.withColumn("fits", planning.metric_fits(F.col("task"), F.col("metric")))


#: (name, config type, architecture, pipeline, library, kind)
MODELS = (
    ("org/bert-base", "bert", "BertForSequenceClassification", "", "", "sequence_classifier"),
    ("org/all-mini", "bert", "BertModel", "sentence-similarity", "", "sentence_encoder"),
    ("org/x-gguf", "", "", "", "", "gguf"),
    ("org/ner", "bert", "BertForTokenClassification", "", "", "token_classifier"),
    ("org/mlm", "roberta", "RobertaForMaskedLM", "", "", "masked_lm"),
    ("org/squad", "bert", "BertForQuestionAnswering", "", "", "extractive_qa"),
    ("org/picture", "clip", "CLIPModel", "", "", "zero_shot_image"),
    ("org/paligemma-3b", "", "", "", "", "paligemma"),
    ("org/q", "qwen2_vl", "", "", "", "vlm_processor"),
    ("org/chatty", "internvl_chat", "InternVLChatModel", "", "", "vlm_chat"),
    ("org/kimi-vl-a3b", "", "KimiForCausalLM", "", "", "unsupported_model"),
    ("org/gpt", "gpt2", "GPT2LMHeadForCausalLM", "", "", "causal_lm"),
    ("org/model-awq", "", "", "", "", "unsupported_model"),
    ("org/vit-b", "vit", "ViTModel", "", "timm", "unsupported_image"),
    ("org/enc", "electra", "ElectraModel", "", "", "sentence_encoder"),
    ("org/flan-t5-xl", "", "", "", "", "seq2seq_lm"),
    ("org/deberta-x", "", "", "", "", "sequence_classifier"),
    ("org/plain", "", "", "", "", "causal_lm"),
)


@query("WITH m(k, name, kind) AS (VALUES " + ", ".join(f"({i}, '{m[0]}', '{m[5]}')" for i, m in enumerate(MODELS)) + f") SELECT p_partkey, name || '-' || p_partkey AS name, kind FROM part JOIN m ON k = p_partkey % {len(MODELS)}")
def model_type(spark, sf_dir):
    """Every part as a model whose metadata is one of the kinds above."""
    known = spark.createDataFrame([(i, *m[:5]) for i, m in enumerate(MODELS)], "k int, base string, config string, arch string, tag string, lib string")
    df = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(MODELS)).cast("int").alias("k")).join(known, "k").withColumn("name", F.concat_ws("-", "base", F.col("p_partkey").cast("string")))
    kind = planning.model_type(F.col("name"), F.col("config"), F.array(F.col("arch")), F.col("tag"), F.col("lib"))
    return df.select("p_partkey", "name", kind.alias("kind"))


#: (id, has_gold, task, method, image?, label map?, model type, labels, problem type, protocol, metric)
PLANS = (
    (1, True, "classification", "auto", False, True, "causal_lm", [], "", "tagged_label_generation_accuracy", "accuracy"),
    (2, False, "classification", "auto", False, True, "causal_lm", [], "", "unsupported", None),
    (3, True, "classification", "rouge_l", False, True, "causal_lm", [], "", "unsupported", None),
    (4, True, "classification", "macro_f1", False, True, "sequence_classifier", ["Positive", "Negative", "LABEL_3"], "", "classifier_label_accuracy", "macro_f1"),
    (5, True, "classification", "", False, True, "sequence_classifier", ["entailment", "neutral"], "", "zero_shot_nli_accuracy", "accuracy"),
    (6, True, "classification", "", False, True, "sequence_classifier", ["LABEL_0", "LABEL_1"], "", "unsupported", None),
    (7, True, "multiple_choice", "", False, False, "causal_lm", [], "", "tagged_multiple_choice_accuracy", "accuracy"),
    (8, True, "multiple_choice", "", False, False, "masked_lm", [], "", "masked_choice_likelihood", "accuracy"),
    (9, True, "multilabel_classification", "", False, True, "sequence_classifier", ["positive", "negative"], "multi_label_classification", "multilabel_classifier_set_f1", "set_f1"),
    (10, True, "multilabel_classification", "", False, True, "causal_lm", [], "", "tagged_set_generation", "set_f1"),
    (11, True, "qa", "", False, False, "extractive_qa", [], "", "extractive_qa", "qa_f1"),
    (12, True, "numeric_qa", "", False, False, "causal_lm", [], "", "tagged_answer_exact_match", "numeric_match"),
    (13, True, "summarization", "auto", False, False, "sentence_encoder", [], "", "unsupported", None),
    (14, True, "token_classification", "", False, True, "token_classifier", [], "", "token_entity_set_f1", "set_f1"),
    (15, True, "image_classification", "", True, True, "zero_shot_image", [], "", "zero_shot_image_accuracy", "accuracy"),
    (16, True, "image_classification", "", True, True, "causal_lm", [], "", "unsupported", None),
    (17, True, "generation", "", False, False, "seq2seq_lm", [], "", "tagged_answer_exact_match", "exact_match"),
    (18, True, "classification", "", False, True, "sentence_encoder", [], "", "embedding_label_similarity", "accuracy"),
    (19, True, "classification", "", False, True, "masked_lm", [], "", "masked_label_likelihood", "accuracy"),
)


@query("WITH p(k, protocol, metric) AS (VALUES " + ", ".join(f"({p[0]}, '{p[9]}', {('NULL' if p[10] is None else repr(p[10]))})" for p in PLANS) + f") SELECT event_id, protocol, metric FROM events JOIN p ON k = event_id % {len(PLANS)} + 1")
def protocol_choice(spark, sf_dir):
    """Every event as a pair of a model and a dataset, of the pairs above."""
    known = spark.createDataFrame([p[:9] for p in PLANS], "k int, has_gold boolean, task string, method string, image boolean, named boolean, model_type string, labels array<string>, problem_type string")
    df = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % len(PLANS) + 1).cast("int").alias("k")).join(known, "k")
    named = F.create_map(F.lit("0"), F.lit("Positive"), F.lit("1"), F.lit("negative"), F.lit("-1"), F.lit("other"))
    df = df.withColumns({"label_map": F.when(F.col("named"), named).otherwise(F.create_map().cast("map<string,string>")), "image_column": F.lit("picture"), "context_column": F.lit("para[].text")})
    df = df.withColumn("columns", F.when(F.col("image"), F.array(F.lit("picture"), F.lit("label"))).otherwise(F.array(F.lit("question"), F.lit("para"))))
    return planning.choose_protocol(df).select("event_id", "protocol", "metric")


@query(with_fixtures("results") + """ SELECT ordinal, concat_ws(',', CASE WHEN "rank" IS NULL OR "rank" < 2 THEN 'rank' END, CASE WHEN score IS NULL THEN 'score' END, CASE WHEN ordinal % 5 = 0 THEN 'checksum' END) AS violations FROM results""")
def handoff_validation(spark, sf_dir):
    rows = fixture(spark, sf_dir, "results").select("ordinal", F.concat("condition", F.lit("-1")).alias("candidate_id"), "model", (F.col("rank") - 1).alias("rank"), "score")
    rows = rows.withColumn("checksum", F.when(F.expr("ordinal % 5 = 0"), "xyz").otherwise(F.sha2(F.col("model"), 256)))
    return rows.select("ordinal", F.array_join(planning.violations(planning.candidate_rules()), ",").alias("violations"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'missing task' WHEN event_id % 3 = 1 THEN 'unknown zeta' ELSE '' END AS error FROM events")
def context_validation(spark, sf_dir):
    doc = F.expr("""case event_id % 3 when 0 then '{"dataset": "a"}' when 1 then '{"dataset": "a", "task": "qa", "zeta": 1}' else '{"dataset": "a", "task": "qa", "notes": ""}' end""")
    return table(spark, sf_dir, "events").select("event_id", planning.closed_world(doc, ("dataset", "task"), ("notes",)).alias("error"))


# --- selection -----------------------------------------------------------------------------------------------------


@query(with_fixtures("results") + """, n AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ordinal) AS n FROM results), p AS (SELECT * FROM n WHERE n <= 9 ORDER BY ordinal LIMIT 30), d AS (SELECT dataset FROM p GROUP BY 1 ORDER BY min(ordinal) LIMIT 3)
SELECT ordinal, dataset, model FROM p WHERE dataset IN (SELECT dataset FROM d)""")
def cycle_selection(spark, sf_dir):
    """A limit is what this operator does."""
    return selection.cycle_selection(fixture(spark, sf_dir, "results"), 9, 30, 3).select("ordinal", "dataset", "model")


@query(with_fixtures("results") + """, e AS (SELECT DISTINCT model FROM results WHERE status = 'failed' AND dataset = 'error' AND "rank" = 1),
r AS (SELECT o.ordinal, o.model, o."rank" - 1 AS r, o.score, CASE WHEN o.status = 'unsupported' THEN 'gated_model' WHEN o."rank" < 2 THEN 'invalid_rank' WHEN o.score IS NULL THEN 'non_finite_or_missing_score' WHEN e.model IS NOT NULL THEN 'already_evaluated_or_excluded' END AS own,
  CASE WHEN o."rank" = 1 THEN o.ordinal + 1 ELSE o."rank" - 1 END AS place FROM results o LEFT JOIN e ON o.model = e.model WHERE dataset = 'view'),
d AS (SELECT *, CASE WHEN own IS NULL AND row_number() OVER (PARTITION BY model, own IS NULL ORDER BY place, ordinal) > 1 THEN 'duplicate_model' ELSE own END AS reason FROM r),
t AS (SELECT *, coalesce(sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY place, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM d)
SELECT ordinal, model, r AS rank, score, reason FROM t WHERE taken < 4""")
def convert_candidates(spark, sf_dir):
    rows = fixture(spark, sf_dir, "results")
    records = rows.where("dataset = 'view'").select("ordinal", F.lit("").alias("model_name"), "model", (F.col("rank") - 1).alias("rank"), "score", F.lit(None).cast("double").alias("link_probability"), F.lit(False).alias("gated"), F.when(F.col("status") == "unsupported", "Gated").alias("access_status"))
    return selection.convert_candidates(records, rows.where("status = 'failed' and dataset = 'error' and rank = 1"), 4)


@query(with_fixtures("results") + """ SELECT dataset, model, 'result_audit' AS stage, status FROM results WHERE status <> 'planned' AND NOT (status = 'ok' AND score IS NOT NULL AND labeled_total > 0)
UNION ALL SELECT dataset, model, 'result_audit', 'missing' FROM (SELECT DISTINCT dataset, model FROM results EXCEPT SELECT dataset, model FROM results WHERE "condition" = 'A_merged' AND "rank" = 1 AND "round" = 1)""")
def failure_rows(spark, sf_dir):
    rows = fixture(spark, sf_dir, "results")
    return selection.failure_rows(rows).unionByName(selection.missing_rows(rows, rows.where("condition = 'A_merged' and rank = 1 and round = 1")))


@query(with_fixtures("results") + """, m AS (SELECT 0 AS s, ordinal, dataset, model, 'status ' || status AS message FROM results WHERE status IN ('failed', 'unsupported') UNION ALL SELECT 1, ordinal, dataset, model, 'no score in ' || metric FROM results WHERE score IS NULL),
d AS (SELECT dataset, model, message, min(struct_pack(s, ordinal)) AS f FROM m GROUP BY 1, 2, 3) SELECT dataset, model, string_agg(message, ' | ' ORDER BY f) AS reasons FROM d GROUP BY 1, 2""")
def failure_reasons(spark, sf_dir):
    rows = fixture(spark, sf_dir, "results")
    a = rows.where("status in ('failed', 'unsupported')").select("dataset", "model", "ordinal", F.concat(F.lit("status "), "status").alias("message"))
    b = rows.where("score is null").select("dataset", "model", "ordinal", F.concat(F.lit("no score in "), "metric").alias("message"))
    return selection.failure_reasons(a, b)


@query("SELECT source AS label, (row_number() OVER (ORDER BY source) - 1)::INT AS label_id FROM (SELECT DISTINCT source FROM documents)")
def label_ids(spark, sf_dir):
    return selection.label_map(table(spark, sf_dir, "documents"), "source")


# --- streams, run over a bounded table -----------------------------------------------------------------------------


@query(with_fixtures("results") + """ SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, dataset, count(*) AS results, count_if(status = 'ok' AND score IS NOT NULL AND labeled_total > 0) AS successes,
  max(CASE WHEN status = 'ok' AND score IS NOT NULL AND labeled_total > 0 THEN score END) AS best_score FROM results GROUP BY 1, 2""")
def windowed_outcomes(spark, sf_dir):
    return monitor.windowed_outcomes(fixture(spark, sf_dir, "results")).drop("window_end")


@query(with_fixtures("results") + """, g AS (SELECT model, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY model ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM results),
s AS (SELECT *, sum(opens) OVER (PARTITION BY model ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT model, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS results FROM s GROUP BY model, k""")
def model_sessions(spark, sf_dir):
    return monitor.sessions(fixture(spark, sf_dir, "results"))
