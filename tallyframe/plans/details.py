"""Queries over the smaller operators: texts, labels, joins, caches, configurations of files, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.functions import vectors as v
from tallyframe.operators import dialogue, joins, planning, prediction, selection, sequences
from tallyframe.operators.numbering import numbered
from tallyframe.plans.fixtures import fixture, table, with_fixtures
from tallyframe.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- texts ----------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, string_agg(CASE turn % 3 WHEN 0 THEN 'User' WHEN 1 THEN 'Assistant' ELSE 'Turn ' || (pos + 1) END || ': ' || text, chr(10) ORDER BY pos) AS dialogue, string_agg('Turn ' || (pos + 1) || ': ' || text, chr(10) ORDER BY pos) AS plain FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE text IS NOT NULL) GROUP BY 1")
def dialogue_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    said, who = F.transform("t", lambda x: x["text"]), F.transform("t", lambda x: (x["turn"] % 3).cast("int"))
    return c.select("conv_id", text.dialogue_text(said, who).alias("dialogue"), text.dialogue_text(said, F.slice(who, 1, 0)).alias("plain"))


@query("SELECT event_id, concat('a', chr(10), event_type) AS list, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, '') AS one, concat('{\"k\":', user_id, '}') AS pair FROM events")
def prompt_values(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    values = {"array<string>": F.array(F.lit("a"), F.lit(None), F.col("event_type")), "string": F.when(F.col("event_id") % 2 == 0, F.col("event_type")), "struct<k:int>": F.struct(F.col("user_id").alias("k"))}
    return e.select("event_id", *[text.prompt_value(c, kind).alias(n) for n, (kind, c) in zip(("list", "one", "pair"), values.items(), strict=True)])


@query("""SELECT doc_id, CASE WHEN length(x) > 60 THEN rtrim(x[1:57], ' ') || '...' ELSE x END AS line FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '\\s*\\n\\s*', '; ', 'g'), '[ \\t]+', ' ', 'g'), ' ') AS x FROM documents)""")
def one_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.one_line(F.col("text"), 60).alias("line"))


@query("SELECT page_id, concat(CASE WHEN strpos(name, '_') > 0 THEN concat(name[1:strpos(name, '_') - 1], '/', name[strpos(name, '_') + 1:]) ELSE name END) AS model FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^/+|/+$', '', 'g'), '[^A-Za-z0-9_.-]+', '_', 'g') AS name FROM pages)")
def model_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.unsafe_model_name(text.safe_name(F.col("url"))).alias("model"))


@query("SELECT event_id, concat(' ', CASE event_id % 2 WHEN 0 THEN 'A' ELSE event_type END, '|', ' ', CASE event_id % 2 WHEN 0 THEN 'B' ELSE 'x' || user_id END) AS texts FROM events")
def option_texts(spark, sf_dir):
    labels, texts = F.array(F.lit("A"), F.lit("B")), F.array(F.col("event_type"), F.concat(F.lit("x"), F.col("user_id").cast("string")))
    made = F.when(F.col("event_id") % 2 == 0, text.continuations(labels, texts, True)).otherwise(text.continuations(labels, texts, False))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(made, "|").alias("texts"))


@query(r"""SELECT item_id, md5(concat('Task and response contract:', chr(10), 'Choose exactly one of these answers: "yes", "n\"o".', chr(10), 'Do not explain your answer. Return exactly one XML element named answer:', chr(10), '<answer>...</answer>', chr(10),
  'Replace ... with the final answer.', chr(10), chr(10), 'Input:', chr(10), rtrim(text), chr(10), chr(10), 'Output only: <answer>...</answer>')) AS prompt FROM benchmark""")
def tagged_prompts(spark, sf_dir):
    p = text.tagged_prompt(F.concat("text", F.lit(" \n\t")), ["yes", 'n"o'])
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(p.cast("binary")).alias("prompt"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('x', chr(10), 'OSError: disk ', user_id, chr(10), 'KeyError: first', chr(10), 'KeyError: ', event_type, chr(10), 'end') WHEN 1 THEN concat('KeyError: k', chr(10), 'ValueError: v', user_id) WHEN 2 THEN repeat('long ', 200) ELSE event_type END AS log FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN regexp_extract(log, 'KeyError: [^f\\n][^\\n]*') WHEN 1 THEN 'KeyError: k' WHEN 2 THEN log[1:497] || '...' ELSE log END AS line FROM e""")
def log_errors(spark, sf_dir):
    i, user = F.col("event_id") % 5, F.col("user_id").cast("string")
    log = F.when(i == 0, F.concat(F.lit("x\nOSError: disk "), user, F.lit("\nKeyError: first\nKeyError: "), "event_type", F.lit("\nend"))).when(i == 1, F.concat(F.lit("KeyError: k\nValueError: v"), user)).when(i == 2, F.repeat(F.lit("long "), 200)).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", selection.error_line(log).alias("line"))


@query("""SELECT conv_id, pos::INT AS pos, history, response FROM (SELECT conv_id, pos, t AS response, string_agg(t, chr(10)) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h, 'hello' || chr(10) || conv_id AS seed FROM (SELECT conv_id, trim(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE trim(coalesce(text, '')) <> '')) CROSS JOIN LATERAL (SELECT seed || coalesce(chr(10) || h, '') AS history)""")
def dialogue_seeded(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: text.stripped(x["text"])).alias("free_messages"))
    rows = c.withColumn("previous_utterance", F.array(F.lit("hello"), F.lit(" "), F.col("conv_id").cast("string"))).withColumn("personas", F.array(F.lit("p")))
    return dialogue.seeded_turns(rows, "conv_id").select("conv_id", "pos", "history", "response")


# --- joins and selections --------------------------------------------------------------------------------------------


@query(with_fixtures("results") + """, p AS (SELECT DISTINCT dataset, model FROM results), f AS (SELECT dataset, model, arg_min("condition", ordinal) AS first_condition FROM results WHERE status = 'ok' GROUP BY 1, 2) SELECT p.dataset, p.model, f.first_condition FROM p JOIN f ON p.dataset = f.dataset AND p.model = f.model""")
def join_results_first_wins(spark, sf_dir):
    rows = fixture(spark, sf_dir, "results")
    right = rows.where("status = 'ok'").select("dataset", "model", "ordinal", F.col("condition").alias("first_condition"))
    return joins.join_first(rows.select("dataset", "model").distinct(), right, ["dataset", "model"])


@query(with_fixtures("results") + """, s AS (SELECT *, CASE WHEN "round" <= 2 THEN 0 WHEN "round" <= 4 THEN 1 ELSE 2 END AS src FROM results WHERE "round" <= 2 OR dataset <> 'click' AND ("round" <= 4 OR dataset = 'purchase')), l AS (SELECT dataset, max(src) AS src FROM s GROUP BY 1)
SELECT s.dataset, s.model, s.ordinal, row_number() OVER (PARTITION BY s.dataset ORDER BY s."rank", s.ordinal) AS place FROM s JOIN l ON s.dataset = l.dataset AND s.src = l.src""")
def later_round_replaces(spark, sf_dir):
    """Three ranked sources; the second lacks the clicks, the third has the purchases alone."""
    rows = fixture(spark, sf_dir, "results")
    first, second, third = rows.where("round <= 2"), rows.where("round in (3, 4) and dataset <> 'click'"), rows.where("round > 4 and dataset = 'purchase'")
    kept = joins.later_source_wins(first, second, third)
    placed = numbered(kept, ["rank", "ordinal"], "place", ("dataset",))
    return placed.select("dataset", "model", "ordinal", (F.col("place") + 1).alias("place"))


@query(with_fixtures("results") + """, t AS (SELECT ordinal, dataset, status IN ('ok', 'failed') AS run FROM results) SELECT dataset, count_if(run) AS run, count_if(NOT run) AS skipped FROM t GROUP BY 1""")
def audited_tasks(spark, sf_dir):
    _, audit = selection.task_and_audit(fixture(spark, sf_dir, "results"), F.col("status").isin("ok", "failed"))
    return audit.groupBy("dataset").agg(F.count_if(F.col("decision") == "run").alias("run"), F.count_if(F.col("decision") == "skip").alias("skipped"))


@query("""WITH d AS (SELECT c_custkey AS k, c_mktsegment AS segment, c_nationkey AS nation FROM customer), s AS (SELECT c_custkey + 1 AS k, CASE WHEN c_custkey % 3 = 0 THEN 'own' END AS segment, CASE WHEN c_custkey % 2 = 0 THEN -1 END AS nation FROM customer WHERE c_custkey % 5 < 3)
SELECT coalesce(d.k, s.k) AS k, coalesce(s.segment, d.segment) AS segment, coalesce(s.nation, d.nation)::BIGINT AS nation FROM d FULL JOIN s ON d.k = s.k""")
def overlaid_defaults(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    base = c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("nation"))
    own = c.where("c_custkey % 5 < 3").select((F.col("c_custkey") + 1).alias("k"), F.when(F.col("c_custkey") % 3 == 0, "own").alias("segment"), F.when(F.col("c_custkey") % 2 == 0, F.lit(-1).cast("long")).alias("nation"))
    return selection.overlay(base, own, "k")


@query("""SELECT vec_id, vec_id % 3 <> 1 AND vec_id % 7 > 0 AND vec_id % 4 <> 3 AS current FROM embeddings""")
def current_caches(spark, sf_dir):
    """Current: the same summary but for white space, and a finite vector of the right size that is not zero."""
    i, x = F.col("vec_id"), v.doubles(F.col("embedding"))
    summary = F.concat(F.lit("s"), i.cast("string"))
    vector = F.when(i % 7 == 0, F.transform(x, lambda z: z * 0)).when(i % 4 == 3, F.slice(x, 1, 63)).otherwise(x)
    cached = F.concat(F.lit("\n\t"), F.when(i % 3 == 1, "other").otherwise(summary))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", summary.alias("summary"), cached.alias("cached_summary"), vector.alias("vector"))
    return selection.current_cache(rows, 64).select("vec_id", "current")


@query("""WITH f AS (SELECT p_partkey, p_name AS n, p_partkey % 4 AS k FROM part) SELECT p_partkey, CASE k WHEN 0 THEN concat(n, '/x-Q4_K_M.gguf') WHEN 1 THEN concat(n, '-00001-of-00003.gguf') WHEN 2 THEN 'b-odd.gguf' END AS file, CASE WHEN k = 1 THEN concat(n, '-00002-of-00003.gguf') ELSE '' END AS missing FROM f""")
def weight_files(spark, sf_dir):
    n, k = F.col("p_name"), F.col("p_partkey") % 4
    add = lambda s: F.concat(n, F.lit(s))
    files = (
        F.when(k == 0, F.array(add("/x-Q8_0.gguf"), add("/x-Q4_K_M.gguf"), add("/mmproj-Q4_K_M.gguf"), F.lit("readme")))
        .when(k == 1, F.array(add("-00003-of-00003.gguf"), add("-00001-of-00003.gguf")))
        .when(k == 2, F.array(F.lit("c-odd.gguf"), F.lit("b-odd.gguf")))
        .otherwise(F.array(F.lit("none.bin")))
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", files.alias("files")).withColumn("file", selection.weight_file(F.col("files")))
    return rows.select("p_partkey", "file", F.coalesce(F.array_join(selection.missing_shards(F.col("file"), F.col("files")), ","), F.lit("")).alias("missing"))


@query("""WITH l AS (SELECT DISTINCT event_type AS name FROM events) SELECT dataset, rank::INT AS rank, model, round(1.0::DOUBLE / rank, 9) AS score, CASE WHEN rank <= 2 THEN 'known' END AS note FROM (SELECT event_type AS dataset, u AS model, row_number() OVER (PARTITION BY event_type ORDER BY f) AS rank FROM (SELECT event_type, user_id AS u, min(event_id) AS f FROM events GROUP BY 1, 2))""")
def exported_rankings(spark, sf_dir):
    first = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("f"))
    exported = first.groupBy(F.col("event_type").alias("dataset_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "user_id"))), lambda x: x["user_id"]).alias("ranked_model_ids"))
    top = exported.select(F.explode(F.slice("ranked_model_ids", 1, 2)).alias("model_id"), "dataset_id").select(F.col("dataset_id").alias("_d"), F.col("model_id").alias("_m"))
    rows = readers.read_ranking(exported, table(spark, sf_dir, "events").select(F.col("user_id").alias("model_id")).distinct())
    rows = rows.join(top, (F.col("dataset_id") == F.col("_d")) & (F.col("model_id") == F.col("_m")), "left")
    return rows.select(F.col("dataset_id").alias("dataset"), "rank", F.col("model_id").alias("model"), F.round("score", 9).alias("score"), F.when(F.col("_d").isNotNull(), "known").alias("note"))


# --- planning --------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, event_type, event_id % 4 AS t, list_filter([CASE WHEN event_id % 2 = 0 THEN 'prediction_collapse' END, CASE WHEN event_id % 3 = 0 THEN 'invalid_outputs' END, CASE WHEN event_id % 5 = 0 THEN 'weak_target_label' END], lambda x: x IS NOT NULL) AS m FROM events)
SELECT event_id, greatest(1, len(m) + (t IN (1, 2, 3))::INT)::INT AS n, CASE WHEN len(m) = 0 AND t = 0 THEN 'Use' WHEN m[1] = 'prediction_collapse' THEN 'Prefer' WHEN m[1] = 'invalid_outputs' THEN 'Retrieve models' WHEN m[1] = 'weak_target_label' THEN 'Ask' WHEN t = 1 THEN 'Retrieve vision-language' ELSE 'Include' END AS first FROM e""")
def next_steps(spark, sf_dir):
    i = F.col("event_id")
    modes = F.array(*[F.when(i % k == 0, m) for k, m in ((2, "prediction_collapse"), (3, "invalid_outputs"), (5, "weak_target_label"))])
    task = F.when(i % 4 == 1, "image_qa").when(i % 4 == 2, "classification").when(i % 4 == 3, "boolean_qa").otherwise("qa")
    said = table(spark, sf_dir, "events").select("event_id", planning.next_steps(modes, task).alias("s"))
    head = F.regexp_extract(F.get("s", F.lit(0)), "^(Use|Prefer|Retrieve models|Ask|Retrieve vision-language|Include)", 1)
    return said.select("event_id", F.size("s").alias("n"), head.alias("first"))


@query("""SELECT event_id, CASE WHEN event_id % 4 > 0 THEN 'qa' WHEN event_id % 3 = 0 THEN 'boolean_qa' WHEN event_id % 3 = 1 THEN 'classification' ELSE 'generation' END AS task FROM events""")
def refined_tasks(spark, sf_dir):
    i = F.col("event_id")
    labels = F.when(i % 3 == 0, F.create_map(F.lit("0"), F.lit("False"), F.lit("1"), F.lit("TRUE"))).when(i % 3 == 1, F.create_map(F.lit("0"), F.lit("a"), F.lit("1"), F.lit("b"))).otherwise(F.create_map(F.lit("0"), F.lit("only")))
    columns = F.when(i % 3 == 0, F.array(F.lit("question"), F.lit("passage"))).otherwise(F.array(F.lit("text")))
    task = F.when(i % 4 == 0, "generation").otherwise("qa")
    return table(spark, sf_dir, "events").select("event_id", planning.refined_task(task, labels, columns, F.lit("image"), F.lit("choices")).alias("task"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE event_id % 5 WHEN 0 THEN 'gguf' WHEN 1 THEN 'extractive_qa' WHEN 2 THEN 'masked_lm' WHEN 3 THEN 'seq2seq_lm' ELSE 'causal_lm' END ELSE 'sequence_classifier' END AS kind FROM events""")
def loaded_model_types(spark, sf_dir):
    """By architecture where the kind is 'auto', else as asked for."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(i % 5 == 0, "my-GGUF").otherwise("plain").alias("name"), F.when(i % 2 == 0, "auto").otherwise("sequence_classifier").alias("explicit"), F.lit("any").alias("config"),
        F.when(i % 5 == 1, F.array(F.lit("XForQuestionAnswering"))).when(i % 5 == 2, F.array(F.lit("XForMaskedLM"))).otherwise(F.array(F.lit("X"))).alias("architectures"), F.lit(False).alias("vision"), F.lit(False).alias("text_part"), (i % 5 == 3).alias("encoder_decoder"))
    return rows.select("event_id", planning.loaded_model_type().alias("kind"))


# --- vectors, spans and predictions -------------------------------------------------------------------------------------


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT vec_id, x, list_sum(list_transform(x, lambda z: exp(z - list_max(x)))) AS total FROM e) SELECT vec_id, round(1 / total, 6) AS top, round(list_sum(list_transform(x, lambda z: exp(z - list_max(x)) / total)), 6) AS whole, (list_position(x, list_max(x)) - 1)::INT AS label FROM s")
def class_probabilities(spark, sf_dir):
    x = v.doubles(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.softmax(x).alias("p"), v.argmax(x).alias("label"))
    return rows.select("vec_id", F.round(F.array_max("p"), 6).alias("top"), F.round(F.aggregate("p", F.lit(0.0), lambda s, z: s + z), 6).alias("whole"), "label")


@query("""WITH e AS (SELECT vec_id, vec_id // 3 AS k, list_transform(embedding::DOUBLE[], lambda z: round(z, 3))[1:8] AS x FROM embeddings),
u AS (SELECT k, vec_id, i - 1 AS s, j - 1 AS e, x[i] + x[9 - j] AS score FROM e CROSS JOIN range(1, 9) AS a(i) CROSS JOIN range(1, 9) AS b(j) WHERE j >= i AND j - i + 1 <= 4),
best AS (SELECT k, max(score) AS span_score FROM u GROUP BY 1), n AS (SELECT k, max(x[1] + x[8]) AS null_score FROM e GROUP BY 1)
SELECT best.k, round(span_score, 6) AS span_score, round(null_score, 6) AS null_score, span_score > null_score AS answered FROM best JOIN n ON best.k = n.k""")
def answers_or_null(spark, sf_dir):
    x = F.slice(F.transform(v.doubles(F.col("embedding")), lambda z: F.round(z, 3)), 1, 8)
    w = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("k"), F.col("vec_id").alias("window"), x.alias("start"), F.reverse(x).alias("end"))
    a = sequences.answer_or_null(w, "k", 4)
    return a.select("k", F.round("span_score", 6).alias("span_score"), F.round("null_score", 6).alias("null_score"), F.col("s").isNotNull().alias("answered"))


@query("""WITH p AS (SELECT conv_id AS model, turn AS idx, text AS prompt FROM conversations WHERE text IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY idx) AS n, coalesce(string_split_regex(trim(regexp_replace(prompt, '\\s+', ' ', 'g')), ' ')[1], '') AS w FROM p), g AS (SELECT model FROM f WHERE n <= 2 GROUP BY 1 HAVING min(length(w)) >= 4) SELECT f.model, f.idx, f.w AS prediction FROM f JOIN g ON f.model = g.model""")
def smoke_then_full(spark, sf_dir):
    """All rows of the models whose first two predictions are four letters long or more."""
    p = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("model"), F.col("turn").alias("idx"), F.col("text").alias("prompt"))
    passes = lambda smoke: smoke.groupBy("model").agg(F.min(F.length("prediction")).alias("n")).where("n >= 4")
    return prediction.smoke_then_full(p, "echo_first_word", passes, smoke_rows=2).select("model", "idx", "prediction")
