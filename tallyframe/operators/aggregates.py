"""Scoreboards, audits and failure analysis over prediction rows (model, dataset, idx, target_answer, prediction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.contract import integer
from tallyframe.functions.metrics import exact_match
from tallyframe.functions.text import filled, has_gold, normalize_answer, stringify, stripped
from tallyframe.operators.joins import strict_pairs


def scored(p: DataFrame) -> DataFrame:
    """With score and correct. A scalar null target counts as '' and is scored."""
    return p.withColumn("score", exact_match(F.col("prediction"), F.col("target_answer"))).withColumn("correct", F.col("score") == 1.0)


def scoreboard(p: DataFrame, keys: list[str]) -> DataFrame:
    return scored(p).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count("score").alias("labeled_total"), F.count_if("correct").alias("correct"), F.round(F.avg("score"), 9).alias("accuracy"),
    )


def scoreboard_with_gold(p: DataFrame, keys: list[str]) -> DataFrame:
    """The recovery rule: rows without a target aren't scored; without any, the accuracy is null."""
    own = scored(p).withColumn("score", F.when(has_gold(F.col("target_answer")), F.col("score")))
    return own.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count("score").alias("labeled_total"), F.round(F.avg("score"), 9).alias("accuracy"))


def macro_f1(p: DataFrame, keys: list[str], raw: bool = False) -> DataFrame:
    """Unweighted mean over labels of 2 tp / (predicted + true). Labels are normalised and '' is one of them; raw=True
    takes them as they are and leaves out blanks. O(rows): one grouping of exploded labels, none over pairs."""
    label = (lambda c: F.coalesce(c, F.lit(""))) if raw else normalize_answer
    rows = p.select(*keys, label(F.col("prediction")).alias("p"), label(F.col("target_answer")).alias("t"))
    sides = F.when(F.col("p") == F.col("t"), F.array(F.struct(F.col("p").alias("label"), F.lit(1).alias("tp"), F.lit(2).alias("n")))).otherwise(
        F.array(F.struct(F.col("p").alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("n")), F.struct(F.col("t").alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("n")))
    )
    each = rows.select(*keys, F.inline(sides))
    if raw:
        each = each.where("label <> ''")
    by_label = each.groupBy(*keys, "label").agg((2.0 * F.sum("tp") / F.sum("n")).alias("f1"))
    return by_label.groupBy(*keys).agg(F.count(F.lit(1)).alias("labels"), F.round(F.avg("f1"), 9).alias("macro_f1"))


def prediction_audit(p: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, blanks, the top prediction (first encountered of equals) and a status: failed if all are blank, a warning
    if one prediction has 95 % of ten or more rows."""
    text = F.coalesce("prediction", F.lit(""))
    counts = p.groupBy(*keys, text.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"))
    out = counts.groupBy(*keys).agg(
        F.sum("n").alias("prediction_rows"), F.coalesce(F.sum(F.when(~filled(F.col("value")), F.col("n"))), F.lit(0)).alias("blank_predictions"),
        F.count(F.lit(1)).alias("distinct_predictions"), F.max_by("value", F.struct("n", -F.col("first_idx"))).alias("top_prediction"), F.max("n").alias("top_count"),
    )
    share = F.col("top_count") / F.col("prediction_rows")
    return out.withColumns({
        "top_fraction": F.round(share, 9),
        "degenerate": (F.col("prediction_rows") >= 10) & (share >= 0.95),
        "status": F.when(F.col("blank_predictions") == F.col("prediction_rows"), "failed").otherwise("ok"),
    })


def prediction_distribution(p: DataFrame, keys: list[str], limit: int = 20) -> DataFrame:
    """(keys, value, n, place): the most frequent predictions, the first encountered of equals; a null is ''."""
    n = p.groupBy(*keys, F.coalesce("prediction", F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first_idx")
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).drop("first_idx")


def run_audit(p: DataFrame, summaries: DataFrame, keys: list[str], shown: int = 10) -> DataFrame:
    """summaries (keys, score, labeled_total, unsupported_reason, tag_parse_failures, label_values) with the audit of their runs:
    status, issues and warnings in order, and what prediction_audit() says. A run whose score was not measured is not looked
    into; predictions outside the label values are named in order, `shown` of them."""
    a = prediction_audit(p, keys).drop("status", "degenerate")
    values = p.select(*keys, F.col("prediction").alias("value")).where("value <> ''").distinct()
    # Only values outside the labels are gathered, each run's least `shown`.
    known = summaries.select(*keys, F.explode("label_values").alias("value"))
    outside = values.join(summaries.where(F.size("label_values") > 0).select(*keys), keys, "left_semi").join(known, [*keys, "value"], "left_anti")
    least = outside.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("value"))).where(F.col("_n") <= shown)
    least = least.groupBy(*keys).agg(F.array_sort(F.collect_list("value")).alias("_outside"))
    rows = summaries.join(a, keys, "left").join(least, keys, "left")
    unsupported, unmeasured = filled(F.col("unsupported_reason")), F.col("score").isNull() | (F.coalesce("labeled_total", F.lit(0)) == 0)
    none, blank = F.coalesce("prediction_rows", F.lit(0)) == 0, F.col("blank_predictions") == F.col("prediction_rows")
    looked = ~unsupported & ~unmeasured
    when = lambda cond, text: F.when(cond, F.lit(text) if isinstance(text, str) else text)
    issue = (
        when(unsupported, F.col("unsupported_reason").cast("string")).when(unmeasured, "No labeled score was produced.")
        .when(none, "predictions.jsonl is empty despite a labeled score.").when(blank, "All predictions are blank.")
    )
    failures = F.coalesce("tag_parse_failures", F.lit(0))
    warnings = F.array(
        when(looked & (failures != 0), F.concat(F.lit("Tagged-answer parsing failed for "), failures.cast("string"), F.lit(" examples."))),
        when(looked & F.col("_outside").isNotNull(), F.concat(F.lit("Predictions outside label map values: "), F.array_join("_outside", ", "))),
        when(looked & (F.col("prediction_rows") >= 10) & (F.col("top_count") >= 0.95 * F.col("prediction_rows")), F.concat(F.lit("Degenerate prediction distribution: "), F.col("top_prediction"))),
    )
    status = when(unsupported, "unsupported").when(unmeasured, "unmeasured").when(none | blank, "failed").otherwise("ok")
    counted = [F.when(looked, F.col(c)).alias(c) for c in ("prediction_rows", "blank_predictions", "distinct_predictions", "top_prediction", "top_count", "top_fraction")]
    return rows.select(*keys, status.alias("status"), issue.alias("issue"), F.filter(warnings, lambda x: x.isNotNull()).alias("warnings"), *counted)


def with_metric_columns(df: DataFrame, metrics: tuple[str, ...], tagged: Column) -> DataFrame:
    """df (metric, score, tag_parse_failures) as summaries have it: a column for each metric, the score in that of the row's
    own, and tag_parse_failures only for tagged protocols."""
    return df.withColumns({**{m: F.when(F.col("metric") == m, F.col("score")) for m in metrics}, "tag_parse_failures": F.when(tagged, F.col("tag_parse_failures"))})


def histogram(p: DataFrame, keys: list[str], column: str) -> DataFrame:
    return p.groupBy(*keys, stringify(F.col(column)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def per_target_accuracy(p: DataFrame, keys: list[str]) -> DataFrame:
    s = scored(p).where("correct is not null").groupBy(*keys, stringify(F.col("target_answer")).alias("target"))
    return s.agg(F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total"), F.round(F.avg(F.col("correct").cast("double")), 9).alias("accuracy"))


def confusions(p: DataFrame, keys: list[str], limit: int = 10) -> DataFrame:
    """The most frequent wrong (target, prediction) pairs; the first encountered of equals."""
    wrong = scored(p).where("correct = false").groupBy(*keys, stringify(F.col("target_answer")).alias("target"), stringify(F.col("prediction")).alias("wrong"))
    n = wrong.agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first_idx")
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def severity(share: Column) -> Column:
    return F.when(share >= 0.25, "high").otherwise("medium")


def failure_modes(p: DataFrame, keys: list[str], results: DataFrame | None = None) -> DataFrame:
    """(keys, mode, severity, n): blank, invalid (outside the observed targets) and collapsed outputs, and weak labels
    (three rows or more, accuracy under 0.5 and 0.2 below the model's, or below 0.5 without a score). With results (keys,
    status, score, labeled_total, has_summary) also evaluation_failed, missing_summary, missing_predictions and
    unlabeled_split. Predictions are grouped once to (target, prediction) pairs; all modes are read from these."""
    text = lambda c: F.lower(stripped(F.coalesce(c, F.lit("none"))))
    rows = scored(p).groupBy(*keys, stringify(F.col("prediction")).alias("value"), stringify(F.col("target_answer")).alias("target"), text(F.col("prediction")).alias("p"),
        F.when(F.col("target_answer").isNotNull(), text(F.col("target_answer"))).alias("t"), "correct").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("points"), F.count("score").alias("n_scored"))
    known = rows.where("t is not null").select(*keys, F.col("t").alias("p"), F.lit(True).alias("known")).distinct()
    any_known = known.select(*keys, F.lit(True).alias("targets")).distinct()
    rows = rows.join(known, [*keys, "p"], "left").join(any_known, keys, "left")
    invalid = F.col("targets").isNotNull() & F.col("known").isNull()
    values = rows.groupBy(*keys, "value").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(invalid, F.col("n"))), F.lit(0)).alias("invalid"), F.sum("points").alias("points"), F.sum("n_scored").alias("n_scored"))
    t = values.groupBy(*keys).agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("value") == "<blank>", F.col("n"))), F.lit(0)).alias("blank"), F.sum("invalid").alias("invalid"), F.max("n").alias("top"), (F.sum("points") / F.sum("n_scored")).alias("score"))
    flag = lambda cond, name, sev, n: F.when(cond, F.struct(F.lit(name).alias("mode"), sev.alias("severity"), n.cast("bigint").alias("n")))
    general = t.select(*keys, F.inline(F.filter(F.array(
        flag(F.col("blank") > 0, "blank_outputs", severity(F.col("blank") / F.col("total")), F.col("blank")),
        flag(F.col("invalid") > 0, "invalid_outputs", severity(F.col("invalid") / F.col("total")), F.col("invalid")),
        flag(F.col("top") / F.col("total") >= 0.8, "prediction_collapse", F.lit("high"), F.col("top")),
    ), lambda x: x.isNotNull())))
    by_target = rows.where("correct is not null").groupBy(*keys, "target").agg(F.sum("n").alias("total"), F.round(F.sum("points") / F.sum("n_scored"), 9).alias("accuracy"))
    weak = by_target.join(t.select(*keys, "score"), keys).where("total >= 3 and accuracy < 0.5 and accuracy + 0.2 < coalesce(score, 0.5)")
    out = general.unionByName(weak.groupBy(*keys).agg(F.lit("weak_target_label").alias("mode"), F.lit("medium").alias("severity"), F.count(F.lit(1)).alias("n")))
    if results is None:
        return out
    seen = t.select(*keys, F.lit(True).alias("_seen"))
    failed = F.coalesce(F.lower("status"), F.lit("")) != "ok"
    state = results.join(seen, keys, "left").select(*keys, F.inline(F.filter(F.array(
        flag(failed, "evaluation_failed", F.lit("high"), F.lit(1)),
        flag(~failed & ~F.coalesce("has_summary", F.lit(False)), "missing_summary", F.lit("high"), F.lit(1)),
        flag(~failed & F.col("_seen").isNull(), "missing_predictions", F.lit("high"), F.lit(1)),
        flag(~failed & (integer(F.col("labeled_total")) == 0), "unlabeled_split", F.lit("high"), F.lit(1)),
    ), lambda x: x.isNotNull())))
    return out.unionByName(state)


def failed_by_all(p: DataFrame, first: int = 20, limit: int = 20) -> DataFrame:
    """Examples in every model's first `first` failures, with the last model's target and prediction; a model without failures
    empties the result. Sorted as text."""
    models = p.select("model").distinct().count()
    failed = scored(p).where("correct = false").withColumn("place", F.row_number().over(Window.partitionBy("model").orderBy("idx"))).where(F.col("place") <= first)
    common = failed.groupBy(F.col("idx").cast("string").alias("example")).agg(F.countDistinct("model").alias("models"), F.max_by(F.struct("target_answer", "prediction"), "model").alias("last")).where(F.col("models") == models)
    return common.orderBy("example").limit(limit).select("example", "models", "last.*")


def dedupe_pairs(df: DataFrame) -> DataFrame:
    """One row a pair: the representative's outcome by priority, and all conditions in order."""
    priority = F.when(F.col("outcome") == "success", 0).when(F.col("outcome") == "planned", 1).otherwise(2)
    name = F.concat("condition", F.lit("#"), F.col("rank").cast("string"))
    # A name's first ordinal before the pair's list: the list holds distinct names, whatever the number of rows.
    own = df.groupBy("dataset", "model", name.alias("c")).agg(F.min("ordinal").alias("ordinal"), F.min_by(F.struct("outcome", "ordinal"), F.struct(priority, "ordinal")).alias("best"), F.min(F.struct(priority, "ordinal")).alias("order"), F.count(F.lit(1)).alias("n"))
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("ordinal", "c")))), lambda x: x["c"])
    return own.groupBy("dataset", "model").agg(F.min_by("best.outcome", "order").alias("outcome"), F.array_join(names, "; ").alias("conditions"), F.sum("n").alias("n_rows"))


def completeness(df: DataFrame, columns: list[str]) -> Column:
    """How many of the columns are filled."""
    return sum((filled(F.col(c)).cast("int") for c in columns), F.lit(0))


def merge_pairs(df: DataFrame, joined: list[str], order: str = "ordinal") -> DataFrame:
    """One row a (dataset, model): the row with the most filled columns (the first of equals), the columns in `joined` as
    their distinct filled values over all rows, in order, with '; ' between them."""
    columns = [c for c in df.columns if c not in ("dataset", "model", order)]
    best = df.groupBy("dataset", "model").agg(F.max_by(F.struct(*[c for c in columns if c not in joined]), F.struct(completeness(df, columns), -F.col(order))).alias("_row"), F.count(F.lit(1)).alias("n_rows"))
    each = df.select("dataset", "model", order, F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in joined])).alias("x")).where(filled(F.col("x.v")))
    first = each.groupBy("dataset", "model", "x.k", "x.v").agg(F.min(order).alias("at"))
    lists = first.groupBy("dataset", "model").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == c, F.struct("at", "v")))), lambda x: x["v"]), "; ").alias(c) for c in joined])
    out = best.join(lists, ["dataset", "model"], "left").select("dataset", "model", "_row.*", *[F.coalesce(c, F.lit("")).alias(c) for c in joined], "n_rows")
    return out


def pivot_models(pairs: DataFrame, n: int) -> DataFrame:
    """Wide: the first n models of a dataset, by task index (null last), as model_i and score_i, with status counts."""
    placed = pairs.withColumn("_place", F.row_number().over(Window.partitionBy("dataset").orderBy(F.coalesce("task_index", F.lit(10**9)), "model")))
    cells = [F.max(F.when(F.col("_place") == i, F.col(c))).alias(f"{c}_{i}") for i in range(1, n + 1) for c in ("model", "score")]
    return placed.groupBy("dataset").agg(F.count(F.lit(1)).alias("models"), F.count_if(F.col("outcome") == "success").alias("successes"), *cells)


#: The statuses that a report counts as successes, and the fields that it has for each model.
REPORT_SUCCESS = ("ok", "success")
REPORT_FIELDS = (
    "model", "conditions", "source_methods", "recommendation_scores", "recommendation_reasoning", "status", "protocol", "metric", "score", "eval_total", "eval_labeled_total",
    "codex_prompt", "codex_context", "model_context", "eval_notes", "failure_reason", "eval_output_dir",
)


def dataset_report(pairs: DataFrame, n: int = 0) -> DataFrame:
    """A row for each dataset: its models counted in all and by status, and for its models in the order of their task index (a
    missing one last) all of REPORT_FIELDS as model_<i>_<field>, text, '' where pairs has no such column or value. n: models
    to have columns for; 0 for as many as the largest dataset has. pairs: one row a pair (dataset, task_index, status, ...)."""
    have = set(pairs.columns)
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    one = F.struct(F.coalesce(F.col("task_index").cast("long"), F.lit(10**9)).alias("_at"), cell("model").alias("_m"), *[cell(c).alias(c) for c in REPORT_FIELDS])
    status = F.when(filled(F.col("status")), F.col("status")).otherwise("missing")
    # The models of a dataset are distinct: a row's array is as long as the report is wide.
    rows = pairs.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("model_count"), F.count_if(status.isin(*REPORT_SUCCESS)).alias("success_count"), F.count_if(status == "failed").alias("failed_count"), F.count_if(status == "unsupported").alias("unsupported_count"),
        F.count_if(F.startswith(status, F.lit("missing"))).alias("missing_count"), F.array_sort(F.collect_list(one)).alias("_models"),
    )
    n = n or rows.agg(F.max("model_count")).first()[0] or 0
    counts = [c for c in rows.columns if c != "_models"]
    return rows.select(*counts, *[F.coalesce(F.get("_models", F.lit(i))[c], F.lit("")).alias(f"model_{i + 1}_{c}") for i in range(n) for c in REPORT_FIELDS])


def contingency(a: DataFrame, b: DataFrame, key: str = "idx") -> DataFrame:
    """Two runs over the same examples: who was right, how often they agree, and the difference of their scores. Raises if
    an example is repeated, in one run only, or has another target there."""
    x = scored(a).select(key, F.col("correct").alias("ca"), F.col("prediction").alias("pa"), F.col("score").alias("sa"), F.col("target_answer").alias("ta"))
    y = scored(b).select(key, F.col("correct").alias("cb"), F.col("prediction").alias("pb"), F.col("score").alias("sb"), F.col("target_answer").alias("tb"))
    j = strict_pairs(x, y, key, {"ta": "tb"})
    return j.agg(
        F.count(F.lit(1)).alias("examples"), F.count_if(F.expr("ca and cb")).alias("both_correct"), F.count_if(F.expr("ca and not cb")).alias("only_first"), F.count_if(F.expr("cb and not ca")).alias("only_second"),
        F.count_if(F.expr("not ca and not cb")).alias("both_wrong"), F.round(F.avg(F.expr("cast(pa <=> pb as double)")), 9).alias("agreement"), F.round(F.avg("sb") - F.avg("sa"), 9).alias("delta"),
    )
