"""Queries over texts, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import metrics, text
from tallyframe.operators import dialogue, prediction
from tallyframe.operators.aggregates import scoreboard_with_gold
from tallyframe.operators.text_metrics import score_rows
from tallyframe.plans.fixtures import fixture, table, with_fixtures
from tallyframe.plans.runs import norm

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"SELECT doc_id, md5({norm('text')}) AS normal, length({norm('text')})::INT AS length FROM documents")
def normalize_answer(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("doc_id", text.normalize_answer(F.col("text")).alias("n"))
    return n.select("doc_id", F.md5(F.col("n").cast("binary")).alias("normal"), F.length("n").alias("length"))


PAIR = with_fixtures("pairs") + f""", t AS (SELECT pair_id, list_filter(string_split({norm('prediction')}, ' '), lambda x: x <> '') AS p, list_filter(string_split({norm('reference')}, ' '), lambda x: x <> '') AS r FROM pairs)"""
F1 = "CASE WHEN n = 0 OR m = 0 THEN (n = m)::INT::DOUBLE WHEN o = 0 THEN 0.0::DOUBLE ELSE round(2 * (o / n) * (o / m) / (o / n + o / m), 9) END"


@query(with_fixtures("pairs") + f" SELECT pair_id, ({norm('prediction')} = {norm('reference')})::INT::DOUBLE AS score FROM pairs")
def exact_match(spark, sf_dir):
    return score_rows(fixture(spark, sf_dir, "pairs"), "exact_match").select("pair_id", "score")


@query(PAIR + f""", a AS (SELECT pair_id, x, count(*) AS k FROM (SELECT pair_id, unnest(p) AS x FROM t) GROUP BY 1, 2), b AS (SELECT pair_id, x, count(*) AS k FROM (SELECT pair_id, unnest(r) AS x FROM t) GROUP BY 1, 2),
c AS (SELECT t.pair_id, len(p) AS n, len(r) AS m, coalesce((SELECT sum(least(a.k, b.k)) FROM a JOIN b ON a.pair_id = b.pair_id AND a.x = b.x WHERE a.pair_id = t.pair_id), 0)::DOUBLE AS o FROM t)
SELECT pair_id, {F1} AS score FROM c""")
def qa_f1(spark, sf_dir):
    return score_rows(fixture(spark, sf_dir, "pairs"), "qa_f1").select("pair_id", F.round("score", 9).alias("score"))


@query(PAIR.replace("WITH ", "WITH RECURSIVE ", 1) + f""", d(pair_id, i, last) AS (SELECT pair_id, 0, list_transform(range(len(r) + 1), lambda x: 0) FROM t
  UNION ALL SELECT d.pair_id, d.i + 1, list_reduce(list_prepend([0], list_transform(range(1, len(t.r) + 1), lambda j: [(t.p[d.i + 1] = t.r[j])::INT, d.last[j], d.last[j + 1]])), lambda acc, c: list_append(acc, CASE WHEN c[1] = 1 THEN c[2] + 1 ELSE greatest(acc[-1], c[3]) END))
  FROM d JOIN t ON d.pair_id = t.pair_id WHERE d.i < len(t.p)),
c AS (SELECT t.pair_id, len(t.p) AS n, len(t.r) AS m, (CASE WHEN len(t.p) = 0 OR len(t.r) = 0 THEN 0 ELSE d.last[-1] END)::DOUBLE AS o FROM t JOIN d ON t.pair_id = d.pair_id AND d.i = len(t.p))
SELECT pair_id, {F1} AS score FROM c""")
def rouge_l(spark, sf_dir):
    return score_rows(fixture(spark, sf_dir, "pairs"), "rouge_l").select("pair_id", F.round("score", 9).alias("score"))


def _set(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(string_split_regex({x}, '[,;\\n]+'), lambda y: {norm('y')}), lambda y: y <> ''))"


@query(with_fixtures("pairs") + f""", t AS (SELECT pair_id, {_set('prediction')} AS p, {_set('reference')} AS r FROM pairs)
SELECT pair_id, round(CASE WHEN len(p) = 0 OR len(r) = 0 THEN (len(p) = len(r))::INT::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(p, r)) / (len(p) + len(r)) END, 9) AS score FROM t""")
def set_f1(spark, sf_dir):
    return score_rows(fixture(spark, sf_dir, "pairs"), "set_f1").select("pair_id", F.round("score", 9).alias("score"))


# Of the six kinds of pairs, the kinds 0, 3, 4 and 5 are equal; a number over 100 equals the same number of per cent, and
# a number of per cent is not that number over 50.
@query("SELECT o_orderkey AS pair_id, (o_orderkey % 6 <> 2)::INT::DOUBLE AS score FROM orders")
def numeric_match(spark, sf_dir):
    return score_rows(fixture(spark, sf_dir, "numbers"), "numeric_match").select("pair_id", "score")


@query(with_fixtures("pairs") + f""" SELECT pair_id, greatest(({norm('prediction')} = {norm('reference')})::INT, (pair_id % 3 = 0)::INT)::DOUBLE AS score FROM pairs""")
def best_of_references(spark, sf_dir):
    rows = fixture(spark, sf_dir, "pairs").withColumn("refs", F.array(F.lit("  "), F.col("reference"), F.when(F.expr("pair_id % 3 = 0"), F.concat("prediction", F.lit("!"))).otherwise("")))
    return rows.select("pair_id", metrics.best_of(F.col("refs"), lambda r: metrics.exact_match(F.col("prediction"), r)).alias("score"))


@query("SELECT page_id, trim(regexp_replace(replace(replace(lower(url), '&', ' and '), '/', ' '), '[^a-z0-9]+', ' ', 'g')) AS label, regexp_replace(regexp_replace(url, '^/+|/+$', '', 'g'), '[^A-Za-z0-9_.-]+', '_', 'g') AS name FROM pages")
def label_and_file_names(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_label_text(u).alias("label"), text.safe_name(u).alias("name"))


LABELS = ["yes", "no", "maybe"]


@query(with_fixtures("generations") + """ SELECT conv_id, turn, CASE WHEN kind IN (0, 1, 2) THEN 'ok' WHEN kind = 3 THEN 'empty_answer' WHEN kind = 6 THEN 'empty_generation' WHEN kind = 5 THEN 'untagged_label' ELSE 'untagged_fallback' END AS status,
  CASE kind WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' WHEN 5 THEN 'yes' WHEN 4 THEN generation ELSE '' END AS answer FROM generations""")
def tagged_answer(spark, sf_dir):
    g = fixture(spark, sf_dir, "generations")
    return g.select("conv_id", "turn", text.tagged_answer(F.col("generation"), LABELS).alias("t")).select("conv_id", "turn", "t.status", "t.answer")


@query(with_fixtures("generations") + """ SELECT conv_id, turn, CASE WHEN kind IN (0, 1, 2) THEN 'ok' WHEN kind = 3 THEN 'empty_answer' WHEN kind = 6 THEN 'empty_generation' WHEN kind = 5 THEN 'untagged_labels' ELSE 'untagged_json' END AS status,
  CASE kind WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' WHEN 5 THEN '["yes"]' WHEN 4 THEN '["no","yes"]' ELSE '' END AS answer FROM generations""")
def embedded_array(spark, sf_dir):
    g = fixture(spark, sf_dir, "generations")
    return g.select("conv_id", "turn", text.tagged_answer(F.col("generation"), LABELS, True).alias("t")).select("conv_id", "turn", "t.status", "t.answer")


@query("SELECT doc_id, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])the($|[^\\p{L}\\p{N}_])') AS en, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])que($|[^\\p{L}\\p{N}_])') AS es, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])der($|[^\\p{L}\\p{N}_])') AS de FROM documents")
def label_mentions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[text.mentions(F.col("text"), w).alias(n) for n, w in (("en", "the"), ("es", "que"), ("de", "der"))])


@query(with_fixtures("generations") + """, r AS (SELECT *, kind IN (4, 5) AS changed, CASE kind WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' WHEN 5 THEN 'yes' WHEN 4 THEN 'no' ELSE '' END AS prediction FROM generations)
SELECT turn % 2 AS part, count_if(kind = 5) AS recovered, count(*) AS total, count_if(kind <> 6) AS labeled_total, round(avg(CASE WHEN kind <> 6 THEN (kind IN (0, 2, 5))::INT::DOUBLE END), 9) AS accuracy FROM r GROUP BY 1""")
def recover_tagged(spark, sf_dir):
    g = fixture(spark, sf_dir, "generations")
    g = g.select((F.col("turn") % 2).alias("part"), text.tagged_answer(F.col("generation"), LABELS).alias("t"), F.when(F.col("kind") != 6, "yes").alias("target_answer"))
    rows = g.select("part", F.col("t.answer").alias("prediction"), "target_answer", (F.col("t.status").isin("untagged_label", "untagged_labels", "untagged_json")).alias("new"))
    return scoreboard_with_gold(rows, ["part"]).join(rows.groupBy("part").agg(F.count_if("new").alias("recovered")), "part")


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, CASE WHEN value >= 50 THEN '1' ELSE '0' END AS label, CASE WHEN regexp_matches(event_type, '^(c\\w+)') THEN regexp_extract(event_type, '^(c\\w+)', 1) ELSE event_type END AS answer FROM events")
def paths_and_thresholds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parsed = F.from_json("props", "k bigint")
    return e.select("event_id", parsed["k"].alias("k"), text.threshold_label(F.col("value"), 50).alias("label"), text.regex_answer(F.col("event_type"), r"^(c\w+)").alias("answer"))


@query("""WITH b AS (SELECT conv_id, turn, trim(text) AS t FROM conversations WHERE trim(coalesce(text, '')) <> ''),
h AS (SELECT conv_id, turn, t AS response, string_agg(t, chr(10)) OVER w AS history, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, md5(history) AS history, n::INT AS n_history, md5(response) AS response FROM h WHERE n > 0""")
def dialogue_prefix(spark, sf_dir):
    d = dialogue.next_turns(table(spark, sf_dir, "conversations"))
    return d.select("conv_id", "turn", F.md5(F.col("history").cast("binary")).alias("history"), "n_history", F.md5(F.col("response").cast("binary")).alias("response"))


@query("""WITH b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role || ': ' || trim(text) AS l, trim(text) AS t FROM conversations WHERE trim(coalesce(text, '')) <> ''),
h AS (SELECT conv_id, n - 1 AS pos, t, string_agg(l, chr(10)) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history FROM b)
SELECT conv_id, pos::INT AS pos, md5(history) AS history, md5(t) AS response FROM h WHERE pos > 0""")
def dialogue_nested(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text"))).alias("utterances"))
    d = dialogue.nested_turns(turns, "conv_id")
    return d.select("conv_id", "pos", F.md5(F.col("history").cast("binary")).alias("history"), F.md5(F.col("response").cast("binary")).alias("response"))


@query("SELECT item_id, md5('Question: ' || text || chr(10) || 'Options: A. yes' || chr(10) || 'B. no') AS prompt FROM benchmark")
def prompts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    options = text.choices_prompt(F.lit(None).cast("string"), F.array(F.lit("yes"), F.lit("no")))
    p = text.prompt("Question: {text}\nOptions: {options}{none}", {"text": F.col("text"), "options": options})
    return b.select("item_id", F.md5(p.cast("binary")).alias("prompt"))


@query("SELECT item_id, coalesce(string_split_regex(trim(text), '\\s+')[1], '') AS prediction FROM benchmark")
def stub_prediction(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("prompt"))
    return prediction.predict(rows, "echo_first_word").select("item_id", "prediction")


@query("SELECT item_id, sha256(text) AS checksum, left(sha256(item_id || chr(1) || text), 16) AS candidate_id FROM benchmark")
def provenance(spark, sf_dir):
    key = F.concat(F.col("item_id").cast("string"), F.lit("\u0001"), F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"), F.left(F.sha2(key.cast("binary"), 256), F.lit(16)).alias("candidate_id"))
