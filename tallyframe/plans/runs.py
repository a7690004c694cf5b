"""Queries over run results and predictions, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.contract import is_loop_measurement, is_measurement, is_smoke
from tallyframe.operators import aggregates as agg
from tallyframe.operators import compare, joins, loop, ranking, recovery
from tallyframe.plans.fixtures import fixture, table, with_fixtures

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.with_outcome(fixture(spark, sf_dir, "results"))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.annotate_comparability(outcomes(spark, sf_dir))


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


FAMILY = "CASE WHEN evaluation_protocol IN ('label_generation_accuracy', 'tagged_label_generation_accuracy') THEN 'label_accuracy' ELSE evaluation_protocol END"
O = with_fixtures("results") + """, o AS (SELECT *, CASE WHEN status = 'planned' THEN 'planned' WHEN status = 'ok' AND score IS NOT NULL AND labeled_total > 0 THEN 'success' ELSE 'failure' END AS outcome FROM results)"""  # noqa: E741
C = O + f""", k AS (SELECT *, metric || '/' || {FAMILY} AS ck FROM o),
f AS (SELECT dataset, arg_min(ck, ordinal) AS canon FROM k WHERE outcome = 'success' GROUP BY dataset),
c AS (SELECT k.* EXCLUDE (outcome), k.outcome = 'success' AND ck = canon AS comparable,
  CASE WHEN k.outcome = 'success' AND ck <> canon THEN 'non_comparable' ELSE k.outcome END AS outcome,
  CASE WHEN k.outcome = 'success' AND ck = canon THEN '' WHEN k.outcome = 'success' THEN 'expected ' || canon || ', got ' || ck ELSE 'not_a_valid_measured_result' END AS non_comparable_reason
  FROM k LEFT JOIN f ON k.dataset = f.dataset)"""


@query(O + " SELECT ordinal, outcome FROM o")
def result_outcome(spark, sf_dir):
    return outcomes(spark, sf_dir).select("ordinal", "outcome")


@query(C + " SELECT ordinal, outcome, comparable, non_comparable_reason FROM c")
def comparability(spark, sf_dir):
    return compared(spark, sf_dir).select("ordinal", "outcome", "comparable", "non_comparable_reason")


@query(C + """, t AS (SELECT *, CASE WHEN outcome = 'success' AND comparable THEN 0 WHEN outcome = 'planned' THEN 1 END AS tier FROM c),
b AS (SELECT *, min(tier) OVER (PARTITION BY dataset) AS best FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN tier = 0 THEN -score END, "rank", "round", model, ordinal) AS final_rank FROM b WHERE tier = best)
SELECT dataset, final_rank::INT AS final_rank, model, score, ordinal FROM r WHERE final_rank <= 5""")
def rank_models(spark, sf_dir):
    return ranking.rank_models(compared(spark, sf_dir), 5).select("dataset", "final_rank", "model", "score", "ordinal")


@query(C + """, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN outcome = 'success' THEN 0 WHEN outcome = 'planned' THEN 1 ELSE 2 END,
  CASE WHEN outcome = 'success' THEN -score END, CASE WHEN outcome <> 'success' THEN "rank" END, ordinal) AS rn FROM c)
SELECT dataset, model, outcome, score, ordinal FROM r WHERE rn = 1""")
def select_winners(spark, sf_dir):
    return ranking.select_winners(compared(spark, sf_dir)).select("dataset", "model", "outcome", "score", "ordinal")


@query(O + """, s AS (SELECT * FROM o WHERE outcome = 'success'),
a AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, ordinal) AS hi, row_number() OVER (PARTITION BY dataset ORDER BY score, ordinal) AS lo FROM s)
SELECT dataset, max(CASE WHEN hi = 1 THEN model END) AS best_model, max(score) AS best_score, max(CASE WHEN lo = 1 THEN model END) AS worst_model, min(score) AS worst_score, round(max(score) - min(score), 6) AS gap FROM a GROUP BY dataset""")
def model_gap(spark, sf_dir):
    return ranking.model_gap(outcomes(spark, sf_dir))


@query(O + """, l AS (SELECT dataset, model, status AS st, score, row_number() OVER (PARTITION BY dataset, model ORDER BY ordinal DESC) AS rn FROM o WHERE "condition" = 'D_baseline' AND "rank" <= 2)
SELECT a.ordinal, a.dataset, a.model, coalesce(l.st, 'missing') AS status, l.score FROM o a LEFT JOIN l ON l.rn = 1 AND a.dataset = l.dataset AND a.model = l.model WHERE a."condition" = 'A_merged'""")
def join_results_last_wins(spark, sf_dir):
    rows = fixture(spark, sf_dir, "results")
    left = rows.where("condition = 'A_merged'").select("ordinal", "dataset", "model")
    right = rows.where("condition = 'D_baseline' and rank <= 2").select("ordinal", "dataset", "model", "status", "score")
    return joins.join_last(left, right, ["dataset", "model"]).select("ordinal", "dataset", "model", "status", "score")


@query(O + """ SELECT DISTINCT dataset, model FROM o EXCEPT SELECT dataset, model FROM o WHERE outcome = 'success' AND score >= 0.2 AND metric = 'macro_f1'""")
def expected_missing(spark, sf_dir):
    rows = outcomes(spark, sf_dir)
    return joins.missing_pairs(rows.select("dataset", "model").distinct(), rows.where("outcome = 'success' and score >= 0.2 and metric = 'macro_f1'"), ["dataset", "model"])


@query(O + """, n AS (SELECT dataset, model, "condition" || '#' || "rank" AS c, min(ordinal) AS first FROM o GROUP BY ALL),
s AS (SELECT dataset, model, string_agg(c, '; ' ORDER BY first) AS conditions FROM n GROUP BY ALL),
r AS (SELECT dataset, model, outcome, row_number() OVER (PARTITION BY dataset, model ORDER BY CASE outcome WHEN 'success' THEN 0 WHEN 'planned' THEN 1 ELSE 2 END, ordinal) AS rn, count(*) OVER (PARTITION BY dataset, model) AS n_rows FROM o)
SELECT r.dataset, r.model, r.outcome, s.conditions, r.n_rows FROM r JOIN s ON r.dataset = s.dataset AND r.model = s.model WHERE rn = 1""")
def dedupe_pairs(spark, sf_dir):
    return agg.dedupe_pairs(outcomes(spark, sf_dir))


@query(O + """, m AS (SELECT *, CASE WHEN status = 'ok' AND score IS NOT NULL AND labeled_total > 0 THEN 1 ELSE 0 END AS measured FROM o WHERE "condition" <> 'A_merged'),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, model ORDER BY measured DESC, ts DESC, ordinal) AS rn FROM m)
SELECT dataset, model, ordinal, measured, score FROM r WHERE rn = 1""")
def best_result_per_pair(spark, sf_dir):
    rows = fixture(spark, sf_dir, "results").withColumn("output_dir", F.when(F.col("condition") == "A_merged", "runs/_smoke/x").otherwise("runs/x"))
    smoke = is_smoke(F.col("output_dir"), F.lit("results.csv"))
    rows = rows.where(~smoke).withColumn("measured", is_measurement(F.col("status"), F.col("score"), F.col("labeled_total"), smoke).cast("int"))
    return joins.one_per_key(rows, ["dataset", "model"], [F.desc("measured"), F.desc("ts"), F.col("ordinal")]).select("dataset", "model", "ordinal", "measured", "score")


# --- predictions ---------------------------------------------------------------------------------------------------

NORM = r"trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(lower(trim(coalesce({x}, ''))), '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(2), 'g'), chr(1) || '(a|an|the)' || chr(2), ' ', 'g'), chr(1), ''), chr(2), ''), '[!-/:-@\[-`{-~]+', '', 'g'), '\s+', ' ', 'g'))"


def norm(x: str) -> str:
    return NORM.replace("{x}", x)


P = with_fixtures("predictions") + f", s AS (SELECT *, ({norm('prediction')} = {norm('target_answer')})::INT::DOUBLE AS score FROM predictions)"
STR = "CASE WHEN trim(coalesce({x}, '')) = '' THEN '<blank>' ELSE {x} END"


@query(P + " SELECT model, dataset, count(*) AS total, count(score) AS labeled_total, count_if(score = 1) AS correct, round(avg(score), 9) AS accuracy FROM s GROUP BY model, dataset")
def scoreboard(spark, sf_dir):
    return agg.scoreboard(fixture(spark, sf_dir, "predictions"), ["model", "dataset"])


@query(P + " SELECT model, count(*) AS total, count(target_answer) AS labeled_total, round(avg(CASE WHEN target_answer IS NOT NULL THEN score END), 9) AS accuracy FROM s GROUP BY model")
def scoreboard_recovery(spark, sf_dir):
    return agg.scoreboard_with_gold(fixture(spark, sf_dir, "predictions"), ["model"])


@query(P + " SELECT model, 'accuracy' AS metric, round(avg(score), 9) AS score, count(*) AS total, round(avg(score), 9) AS accuracy, NULL::DOUBLE AS macro_f1, NULL::DOUBLE AS qa_f1 FROM s GROUP BY model")
def run_summary(spark, sf_dir):
    board = agg.scoreboard(fixture(spark, sf_dir, "predictions"), ["model"])
    own = lambda m: F.when(F.col("metric") == m, F.col("score")).alias(m)
    return board.select("model", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("score"), "total").select("*", own("accuracy"), own("macro_f1"), own("qa_f1"))


@query(P + """, n AS (SELECT model, coalesce(prediction, '') AS v, count(*) AS n, min(idx) AS i FROM s GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, i) AS rn FROM n)
SELECT model, sum(n)::BIGINT AS prediction_rows, coalesce(sum(CASE WHEN trim(v) = '' THEN n END), 0)::BIGINT AS blank_predictions, count(*) AS distinct_predictions, max(CASE WHEN rn = 1 THEN v END) AS top_prediction,
  max(n) AS top_count, round(max(n) / sum(n), 9) AS top_fraction, sum(n) >= 10 AND max(n) / sum(n) >= 0.95 AS degenerate, CASE WHEN coalesce(sum(CASE WHEN trim(v) = '' THEN n END), 0) = sum(n) THEN 'failed' ELSE 'ok' END AS status FROM t GROUP BY model""")
def audit_distribution(spark, sf_dir):
    return agg.prediction_audit(fixture(spark, sf_dir, "predictions"), ["model"])


@query(P + f" SELECT model, {STR.replace('{x}', 'target_answer')} AS value, count(*) AS n FROM s GROUP BY 1, 2")
def target_histogram(spark, sf_dir):
    return agg.histogram(fixture(spark, sf_dir, "predictions"), ["model"], "target_answer")


@query(P + f" SELECT model, {STR.replace('{x}', 'target_answer')} AS target, count_if(score = 1) AS correct, count(*) AS total, round(avg(score), 9) AS accuracy FROM s GROUP BY 1, 2")
def per_target_accuracy(spark, sf_dir):
    return agg.per_target_accuracy(fixture(spark, sf_dir, "predictions"), ["model"])


@query(P + f""", n AS (SELECT model, {STR.replace('{x}', 'target_answer')} AS target, {STR.replace('{x}', 'prediction')} AS wrong, count(*) AS n, min(idx) AS first_idx FROM s WHERE score < 1 GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, first_idx)::INT AS place FROM n) WHERE place <= 10""")
def confusions_topk(spark, sf_dir):
    return agg.confusions(fixture(spark, sf_dir, "predictions"), ["model"])


@query(P + f""", k AS (SELECT DISTINCT model, dataset, lower(trim(target_answer)) AS t FROM s WHERE target_answer IS NOT NULL),
r AS (SELECT s.*, {STR.replace('{x}', 'prediction')} = '<blank>' AS blank, k.t IS NULL AS invalid FROM s LEFT JOIN k ON s.model = k.model AND s.dataset = k.dataset AND lower(trim(coalesce(s.prediction, 'none'))) = k.t),
t AS (SELECT model, dataset, count(*) AS total, count_if(blank) AS blank, count_if(invalid) AS invalid, avg(score) AS score FROM r GROUP BY 1, 2),
h AS (SELECT model, dataset, max(n) AS top FROM (SELECT model, dataset, {STR.replace('{x}', 'prediction')} AS v, count(*) AS n FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2),
w AS (SELECT model, dataset, {STR.replace('{x}', 'target_answer')} AS target, count(*) AS total, avg(score) AS acc FROM s GROUP BY 1, 2, 3)
SELECT model, dataset, 'blank_outputs' AS mode, CASE WHEN blank / total >= 0.25 THEN 'high' ELSE 'medium' END AS severity, blank AS n FROM t WHERE blank > 0
UNION ALL SELECT model, dataset, 'invalid_outputs', CASE WHEN invalid / total >= 0.25 THEN 'high' ELSE 'medium' END, invalid FROM t WHERE invalid > 0
UNION ALL SELECT t.model, t.dataset, 'prediction_collapse', 'high', h.top FROM t JOIN h ON t.model = h.model AND t.dataset = h.dataset WHERE h.top / t.total >= 0.8
UNION ALL SELECT w.model, w.dataset, 'weak_target_label', 'medium', count(*) FROM w JOIN t ON w.model = t.model AND w.dataset = t.dataset WHERE w.total >= 3 AND w.acc < 0.5 AND round(w.acc, 9) + 0.2 < t.score GROUP BY 1, 2""")
def failure_modes(spark, sf_dir):
    return agg.failure_modes(fixture(spark, sf_dir, "predictions"), ["model", "dataset"])


@query(P + """, f AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY idx) AS place FROM s WHERE score < 1)
SELECT idx::VARCHAR AS example, count(DISTINCT model) AS models, arg_max(target_answer, model) AS target_answer, arg_max(prediction, model) AS prediction FROM f WHERE place <= 60 GROUP BY 1 HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM s) ORDER BY 1 LIMIT 20""")
def all_failed(spark, sf_dir):
    return agg.failed_by_all(fixture(spark, sf_dir, "predictions"), first=60)


MACRO = """, l AS (SELECT model, dataset, p AS label FROM n UNION SELECT model, dataset, t FROM n),
f AS (SELECT l.model, l.dataset, l.label, count_if(n.p = l.label AND n.t = l.label) AS tp, count_if(n.p = l.label) + count_if(n.t = l.label) AS d FROM l JOIN n ON l.model = n.model AND l.dataset = n.dataset {w} GROUP BY 1, 2, 3)
SELECT model, dataset, count(*) AS labels, round(avg(2.0::DOUBLE * tp / d), 9) AS macro_f1 FROM f GROUP BY 1, 2"""


@query(P + f", n AS (SELECT model, dataset, {norm('prediction')} AS p, {norm('target_answer')} AS t FROM s)" + MACRO.replace("{w}", ""))
def macro_f1(spark, sf_dir):
    return agg.macro_f1(fixture(spark, sf_dir, "predictions"), ["model", "dataset"])


@query(P + ", n AS (SELECT model, dataset, coalesce(prediction, '') AS p, coalesce(target_answer, '') AS t FROM s)" + MACRO.replace("{w}", "WHERE l.label <> ''"))
def macro_f1_raw(spark, sf_dir):
    return agg.macro_f1(fixture(spark, sf_dir, "predictions"), ["model", "dataset"], raw=True)


@query(P + """, r AS (SELECT model, round(avg(CASE WHEN prediction = target_answer OR (prediction IS NULL AND target_answer IS NULL) THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy, count(*) AS total FROM s GROUP BY model)
, results AS (SELECT concat('m', cast(user_id % 12 AS varchar)) AS model, event_id AS ordinal, value FROM events)
SELECT e.ordinal, e.model, CASE WHEN r.model IS NULL THEN 'unchanged' ELSE 'rescored' END AS provenance, r.accuracy AS new_score, r.total AS labeled_total FROM results e LEFT JOIN r ON e.model = r.model""")
def rescore(spark, sf_dir):
    p = fixture(spark, sf_dir, "predictions")
    fresh = p.groupBy("model").agg(F.round(F.avg(F.expr("cast(prediction <=> target_answer as double)")), 9).alias("new_score"), F.count(F.lit(1)).alias("labeled_total"))
    rows = fixture(spark, sf_dir, "results").select("ordinal", "model")
    return rows.join(fresh, "model", "left").select("ordinal", "model", F.when(F.col("new_score").isNull(), "unchanged").otherwise("rescored").alias("provenance"), "new_score", "labeled_total")


@query(P + """, a AS (SELECT * FROM s WHERE model = 'm0'), b AS (SELECT * FROM s WHERE model = 'm1')
SELECT count(*) AS examples, count_if(a.score = 1 AND b.score = 1) AS both_correct, count_if(a.score = 1 AND b.score < 1) AS only_first, count_if(a.score < 1 AND b.score = 1) AS only_second, count_if(a.score < 1 AND b.score < 1) AS both_wrong,
  round(avg((a.prediction IS NOT DISTINCT FROM b.prediction)::INT::DOUBLE), 9) AS agreement, round(avg(b.score) - avg(a.score), 9) AS delta FROM a JOIN b ON a.idx = b.idx""")
def pair_protocols(spark, sf_dir):
    p = fixture(spark, sf_dir, "predictions")
    return agg.contingency(p.where("model = 'm0'"), p.where("model = 'm1'"))


# --- comparison ----------------------------------------------------------------------------------------------------

METHODS = {"method1": ("B_method1_only",), "method2": ("C_method2_only",), "baseline": ("D_baseline",)}
POOL = O + """, g AS (SELECT dataset, model, "condition" || '#' || "rank" AS c, "condition" AS cn, "rank" AS ck, CASE WHEN outcome = 'success' THEN score END AS score, metric, ordinal FROM o),
x AS (SELECT g.*, k.k AS max_rank FROM g CROSS JOIN (VALUES (1), (5)) AS k(k)),
i AS (SELECT dataset, model, ordinal, metric, max_rank, ck <= max_rank AND cn = 'B_method1_only' AS i1, ck <= max_rank AND cn = 'C_method2_only' AS i2, ck <= max_rank AND cn = 'D_baseline' AS i3, score FROM x),
b AS (SELECT dataset, max_rank, {cols} FROM i GROUP BY dataset, max_rank)"""
_cols = ", ".join(
    f"arg_max(model, struct_pack(s := score, o := -ordinal)) FILTER (WHERE i{n} AND score IS NOT NULL) AS {m}_model, max(score) FILTER (WHERE i{n}) AS {m}_score, "
    f"arg_max(metric, struct_pack(s := score, o := -ordinal)) FILTER (WHERE i{n} AND score IS NOT NULL) AS {m}_metric, count(score) FILTER (WHERE i{n}) || '/' || count(*) FILTER (WHERE i{n}) AS {m}_coverage"
    for n, m in ((1, "method1"), (2, "method2"), (3, "baseline"))
)
POOL = POOL.replace("{cols}", _cols)


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcomes(spark, sf_dir).withColumn("conditions", F.concat("condition", F.lit("#"), F.col("rank").cast("string")))
    return compare.pools(rows.withColumn("score", F.when(F.col("outcome") == "success", F.col("score"))), METHODS)


@query(POOL + " SELECT * FROM b")
def method_pools(spark, sf_dir):
    return pooled(spark, sf_dir)


def _winner_sql(names: list[str]) -> str:
    top = "greatest(" + ", ".join(f"{m}_score" for m in names) + ")"
    some_null = " OR ".join(f"{m}_score IS NULL" for m in names)
    metrics = "len(list_distinct([" + ", ".join(f"{m}_metric" for m in names) + "])) > 1"
    at_top = "list_filter([" + ", ".join(f"CASE WHEN abs({m}_score - {top}) <= 1e-9 THEN '{m}' END" for m in names) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN {some_null} OR {metrics} THEN 'incomplete' WHEN len({at_top}) = 1 THEN {at_top}[1] ELSE 'tie' END"


@query(POOL + f" SELECT dataset, max_rank, {_winner_sql(['method1', 'baseline'])} AS winner FROM b")
def two_way(spark, sf_dir):
    return pooled(spark, sf_dir).select("dataset", "max_rank", compare.winner(["method1", "baseline"]).alias("winner"))


@query(POOL + f" SELECT dataset, max_rank, {_winner_sql(['method1', 'method2', 'baseline'])} AS winner FROM b")
def three_way(spark, sf_dir):
    return pooled(spark, sf_dir).select("dataset", "max_rank", compare.winner(["method1", "method2", "baseline"]).alias("winner"))


LOOP = """, lp AS (SELECT o.*, k.k AS max_rank FROM o CROSS JOIN (VALUES (1), (5)) AS k(k) WHERE "rank" <= k.k AND outcome = 'success'),
lb AS (SELECT dataset, max_rank, arg_max(model, struct_pack(s := score, o := -ordinal)) AS loop_model, max(score) AS loop_score, arg_max(metric, struct_pack(s := score, o := -ordinal)) AS loop_metric, count(*) || '/' || max_rank AS loop_count FROM lp GROUP BY dataset, max_rank)"""


@query(POOL + LOOP + f" SELECT b.dataset, b.max_rank, loop_model, loop_score, loop_count, {_winner_sql(['method1', 'method2', 'baseline', 'loop'])} AS winner FROM b LEFT JOIN lb ON b.dataset = lb.dataset AND b.max_rank = lb.max_rank")
def four_way(spark, sf_dir):
    rows = fixture(spark, sf_dir, "results").withColumn("max_rank", F.explode(F.array(F.lit(1), F.lit(5))))
    own = rows.where((F.coalesce("rank", F.lit(0)) <= F.col("max_rank")) & is_loop_measurement(F.col("status"), F.col("score"), F.col("labeled_total")))
    best = own.groupBy("dataset", "max_rank").agg(ranking.first_best("model").alias("loop_model"), F.max("score").alias("loop_score"), ranking.first_best("metric").alias("loop_metric"), F.count(F.lit(1)).alias("n"))
    best = best.withColumn("loop_count", F.concat(F.col("n").cast("string"), F.lit("/"), F.col("max_rank").cast("string"))).drop("n")
    j = pooled(spark, sf_dir).join(best, ["dataset", "max_rank"], "left")
    return j.select("dataset", "max_rank", "loop_model", "loop_score", "loop_count", compare.winner(["method1", "method2", "baseline", "loop"]).alias("winner"))


# --- windows, loop and recovery --------------------------------------------------------------------------------------


@query(O + """, d AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ordinal) AS depth, min(ordinal) OVER (PARTITION BY dataset) AS f FROM o)
SELECT ordinal, dataset, model, depth::INT AS depth FROM d ORDER BY depth, f LIMIT 23""")
def round_robin(spark, sf_dir):
    return ranking.round_robin(fixture(spark, sf_dir, "results"), 23).select("ordinal", "dataset", "model", "depth")


@query(O + ", p AS (SELECT dataset, model, min(ordinal) AS first_ordinal, count(*) AS n_rows FROM o GROUP BY 1, 2) SELECT *, (row_number() OVER (ORDER BY first_ordinal) - 1)::INT AS task_index FROM p")
def task_ids(spark, sf_dir):
    return ranking.task_ids(fixture(spark, sf_dir, "results"))


ROUNDS = C + """, r AS (SELECT dataset, "round", count(*) AS candidates, count_if(outcome = 'success' AND comparable) AS successes, max(CASE WHEN outcome = 'success' AND comparable THEN score END) AS score FROM c GROUP BY 1, 2),
p AS (SELECT *, max(score) OVER (PARTITION BY dataset ORDER BY "round" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_best, sum(successes) OVER (PARTITION BY dataset ORDER BY "round")::BIGINT AS total_successes FROM r),
q AS (SELECT *, CASE WHEN total_successes >= {t} THEN 'target_reached' WHEN previous_best IS NOT NULL AND (score IS NULL OR round(score - previous_best, 9) < 0.05) THEN 'no_improvement' END AS stop_reason FROM p)"""


@query(ROUNDS.replace("{t}", "100000") + " SELECT dataset, round, score, previous_best, stop_reason IS NOT NULL AS stop FROM q")
def stop_rules(spark, sf_dir):
    rounds = loop.replay(fixture(spark, sf_dir, "results")).select("dataset", "round", "score")
    return ranking.improvement_stops(rounds, 0.05)


@query(ROUNDS.replace("{t}", "100") + """, z AS (SELECT *, coalesce(max(stop_reason IS NOT NULL) OVER (PARTITION BY dataset ORDER BY "round" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM q)
SELECT dataset, round, candidates, successes, score, previous_best, total_successes, stop_reason FROM z WHERE NOT done""")
def selection_loop(spark, sf_dir):
    return loop.until_stop(loop.replay(fixture(spark, sf_dir, "results"), target=100, minimum=0.05))


@query(O + """, m AS (SELECT dataset, "round", model, min(ordinal) AS f FROM o GROUP BY 1, 2, 3), n AS (SELECT dataset, model, min("round") AS r0, min(f) AS f FROM m GROUP BY 1, 2),
b AS (SELECT dataset, "round", max(CASE WHEN outcome = 'success' THEN score END) AS s FROM o GROUP BY 1, 2)
SELECT b.dataset, b.round, max(b.s) OVER (PARTITION BY b.dataset ORDER BY b.round) AS best_score, (SELECT count(*) FROM n WHERE n.dataset = b.dataset AND n.r0 <= b.round) AS seen_models FROM b""")
def feedback_history(spark, sf_dir):
    from pyspark.sql import Window

    rows = outcomes(spark, sf_dir)
    w = Window.partitionBy("dataset").orderBy("round")
    first = rows.groupBy("dataset", "model").agg(F.min("round").alias("round")).groupBy("dataset", "round").agg(F.count(F.lit(1)).alias("new"))
    best = rows.groupBy("dataset", "round").agg(F.max(F.when(F.col("outcome") == "success", F.col("score"))).alias("s")).join(first, ["dataset", "round"], "left")
    return best.select("dataset", "round", F.max("s").over(w).alias("best_score"), F.sum(F.coalesce("new", F.lit(0))).over(w).alias("seen_models"))


@query(O + """, b AS (SELECT dataset, model, min(ordinal) AS f, max(CASE WHEN outcome = 'success' THEN score END) AS score, max(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) AS ok FROM o GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (ORDER BY f) - 1 AS task_index FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY task_index, model) AS n FROM t)
SELECT dataset, count(*) AS models, count_if(ok = 1) AS successes, max(CASE WHEN n = 1 THEN model END) AS model_1, max(CASE WHEN n = 1 THEN score END) AS score_1, max(CASE WHEN n = 2 THEN model END) AS model_2, max(CASE WHEN n = 2 THEN score END) AS score_2,
  max(CASE WHEN n = 3 THEN model END) AS model_3, max(CASE WHEN n = 3 THEN score END) AS score_3 FROM p GROUP BY dataset""")
def pivot_models(spark, sf_dir):
    rows = outcomes(spark, sf_dir)
    best = rows.groupBy("dataset", "model").agg(F.max(F.when(F.col("outcome") == "success", F.col("score"))).alias("score"), F.max(F.when(F.col("outcome") == "success", "success").otherwise("failure")).alias("outcome"))
    return agg.pivot_models(best.join(ranking.task_ids(rows).select("dataset", "model", "task_index"), ["dataset", "model"]), 3)


@query(O + """, d AS (SELECT DISTINCT dataset, model FROM o WHERE outcome = 'success' AND score >= 0.2 AND labeled_total = 4), p AS (SELECT dataset, model, min(ordinal) AS first_ordinal FROM o GROUP BY 1, 2)
SELECT p.*, (row_number() OVER (ORDER BY first_ordinal) - 1)::INT AS task_index FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.dataset = p.dataset AND d.model = p.model) AND NOT (dataset = 'click' AND model = 'm3')""")
def retry_manifest(spark, sf_dir):
    rows = outcomes(spark, sf_dir)
    done = rows.withColumn("outcome", F.when(F.expr("score >= 0.2 and labeled_total = 4"), F.col("outcome")))
    excluded = rows.where("dataset = 'click' and model = 'm3'").select("dataset", "model").distinct()
    return recovery.untried_or_failed(rows, done, excluded, ["dataset", "model"])


ROUTES = O + """, u AS (SELECT ordinal, dataset, model, CASE WHEN status = 'ok' AND outcome = 'failure' THEN 'missing' ELSE status END AS st, CASE WHEN ordinal % 4 = 0 THEN 'no direct adapter exists' WHEN ordinal % 4 = 2 THEN 'no detected gold labels' ELSE '' END AS reason FROM o WHERE outcome <> 'success'),
k AS (SELECT *, CASE WHEN st = 'planned' THEN 'planned_only' WHEN st = 'missing' THEN 'missing_output' WHEN st = 'failed' THEN 'runtime_failure' WHEN st = 'unsupported' AND reason LIKE '%no direct adapter exists%' THEN 'stale_adapter' WHEN st = 'unsupported' AND reason LIKE '%no detected gold labels%' THEN 'dataset_context' ELSE 'incompatible' END AS category FROM u),
r AS (SELECT *, CASE WHEN dataset = 'error' THEN 'blocked_remote_code' WHEN category = 'incompatible' THEN 'skip_incompatible' WHEN dataset = 'view' AND model = 'm1' THEN 'active_coverage_run' WHEN dataset = 'view' THEN 'explicit_source_override' ELSE 'generic_retry' END AS route FROM k)"""


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcomes(spark, sf_dir).where("outcome <> 'success'")
    status = F.when(F.expr("status = 'ok'"), "missing").otherwise(F.col("status"))
    reason = F.expr("case when ordinal % 4 = 0 then 'no direct adapter exists' when ordinal % 4 = 2 then 'no detected gold labels' else '' end")
    rows = rows.withColumn("category", recovery.failure_category(status, reason))
    template = F.when(F.col("dataset") == "view", "m1")
    return rows.withColumn("route", recovery.recovery_route(F.col("dataset"), F.col("model"), F.col("category"), ("error",), template))


@query(ROUTES + " SELECT ordinal, category, route FROM r")
def recovery_routes(spark, sf_dir):
    return routed(spark, sf_dir).select("ordinal", "category", "route")


@query(ROUTES + """, l AS (SELECT *, CASE WHEN category NOT IN ('dataset_context', 'missing_output', 'never_attempted', 'runtime_failure') THEN 'deferred' WHEN route = 'blocked_remote_code' THEN 'blocked' WHEN route IN ('explicit_source_override', 'active_coverage_run') THEN 'explicit' WHEN route = 'generic_retry' THEN 'generic' ELSE 'deferred' END AS lane FROM r)
SELECT ordinal, lane, (row_number() OVER (PARTITION BY lane ORDER BY ordinal) - 1)::INT AS task_index FROM l""")
def salvage_lanes(spark, sf_dir):
    rows = routed(spark, sf_dir).withColumn("lane", recovery.salvage_lane(F.col("category"), F.col("route")))
    return recovery.number_lanes(rows, "lane", ["ordinal"]).select("ordinal", "lane", "task_index")


@query(O + """, g AS (SELECT DISTINCT model FROM o WHERE "round" = 1 AND outcome = 'success' AND score >= 0.2 AND dataset = 'click')
SELECT ordinal, o.model, g.model IS NOT NULL AS passed FROM o LEFT JOIN g ON o.model = g.model WHERE "round" = 2""")
def smoke_gate(spark, sf_dir):
    rows = outcomes(spark, sf_dir)
    passing = rows.where("round = 1 and outcome = 'success' and score >= 0.2 and dataset = 'click'")
    return joins.gate(rows.where("round = 2"), passing, "model").select("ordinal", "model", "passed")


@query(O + """, e AS (SELECT DISTINCT model FROM o WHERE dataset = 'view' AND "rank" <= 3 AND score >= 0.2), f AS (SELECT DISTINCT model FROM o WHERE dataset = 'click' AND "rank" >= 6 AND score >= 0.2)
SELECT coalesce(e.model, f.model) AS model, CASE WHEN f.model IS NULL THEN 'missing' WHEN e.model IS NULL THEN 'unexpected' ELSE 'covered' END AS state FROM e FULL JOIN f ON e.model = f.model""")
def coverage_audit(spark, sf_dir):
    rows = fixture(spark, sf_dir, "results")
    return recovery.coverage(rows.where("dataset = 'view' and rank <= 3 and score >= 0.2"), rows.where("dataset = 'click' and rank >= 6 and score >= 0.2"), "model")


@query(O + """, p AS (SELECT dataset, model, "round" AS r, ordinal FROM o WHERE "condition" = 'B_method1_only' AND "rank" = 1), n AS (SELECT dataset, model, r, count(*) AS k, min(ordinal) AS first_plan FROM p GROUP BY 1, 2, 3),
q AS (SELECT DISTINCT dataset, model, "round" AS r FROM o) SELECT q.dataset, q.model, q.r AS round, coalesce(n.k, 0) AS matches, CASE WHEN n.k = 1 THEN 'run' ELSE 'skip' END AS decision, CASE WHEN n.k = 1 THEN first_plan END AS plan FROM q LEFT JOIN n ON q.dataset = n.dataset AND q.model = n.model AND q.r = n.r""")
def exactly_one_plan(spark, sf_dir):
    rows = fixture(spark, sf_dir, "results")
    plans = rows.where("condition = 'B_method1_only' and rank = 1").select("dataset", "model", "round", F.col("ordinal").alias("plan"))
    return joins.exactly_one(rows.select("dataset", "model", "round").distinct(), plans, ["dataset", "model", "round"], "plan")


USERS = "u AS (SELECT event_id AS ordinal, event_type AS role, value, concat(CASE WHEN event_id % 2 = 0 THEN 'U' ELSE 'u' END, user_id) AS model FROM events)"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as candidates: one model a user, spelled in two ways."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("ordinal"), F.col("event_type").alias("role"), "value", F.concat(F.when(F.col("event_id") % 2 == 0, "U").otherwise("u"), F.col("user_id").cast("string")).alias("model"))


@query(f"""WITH {USERS}, k AS (SELECT lower(model) AS key, min(ordinal) AS ordinal FROM u WHERE role = 'click' AND lower(model) IN (SELECT lower(model) FROM u WHERE role = 'view' AND value < 40) AND lower(model) NOT IN (SELECT lower(model) FROM u WHERE role = 'error' AND value > 60) GROUP BY 1)
SELECT u.model, k.ordinal, row_number() OVER (ORDER BY k.ordinal)::INT AS new_rank FROM k JOIN u ON u.ordinal = k.ordinal QUALIFY new_rank <= 5""")
def allowed_candidates(spark, sf_dir):
    """The first five are what this operator returns."""
    u = users(spark, sf_dir)
    got = joins.allowed_candidates(u.where("role = 'click'"), u.where("role = 'view' and value < 40"), u.where("role = 'error' and value > 60"), "model", 5)
    return got.select("model", "ordinal", "new_rank")


@query(f"""WITH {USERS}, s AS (SELECT DISTINCT lower(model) AS key FROM u WHERE role = 'purchase' AND value > 60), b AS (SELECT ordinal, model, s.key IS NOT NULL AS seen, row_number() OVER (PARTITION BY lower(model) ORDER BY ordinal) AS n FROM u LEFT JOIN s ON lower(u.model) = s.key WHERE role <> 'purchase')
SELECT ordinal, model, CASE WHEN seen THEN 'already_seen' WHEN n > 1 THEN 'duplicate_in_batch' END AS reason FROM b""")
def handoff_dedup(spark, sf_dir):
    u = users(spark, sf_dir)
    return loop.new_candidates(u.where("role <> 'purchase'"), u.where("role = 'purchase' and value > 60")).select("ordinal", "model", "reason")
