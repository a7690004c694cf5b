"""Contracts of reviews and configurations, and the planning rules of the data cycle around an evaluation."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import schemas as S
from tallyframe.functions.text import filled, safe_name
from tallyframe.operators.planning import metric_fits

#: Fields of a review, its roles and decisions.
REVIEW_FIELDS = ("consensus", "critic", "decision", "orchestrator", "required", "retrieval")
REVIEW_FLAGS = ("required", "consensus")
ASSESSING_ROLES, DECIDING_ROLE = ("retrieval", "critic"), "orchestrator"
DECISIONS = ("continue", "stop")
#: Messages of a dataset that this version can't read.
VERSION_INCOMPATIBLE = ("Dataset scripts are no longer supported", "requires a different version of datasets")
#: Metrics that a summary may hold under their names.
SUMMARY_METRICS = ("accuracy", "macro_f1", "exact_match", "qa_f1", "rouge_l", "numeric_match", "set_f1")


#: The version of a hand-over, what its candidates may be for, confidences, tasks and methods of a context.
HANDOFF_VERSION, INTENDED_USES, CONFIDENCES = 1, ("direct_inference",), ("high", "low", "medium")
CONTEXT_TASKS = ("", "classification", "generation", "image_classification", "multilabel_classification", "multiple_choice", "numeric_qa", "qa", "relation_extraction", "summarization", "token_classification")
CONTEXT_METHODS = ("", "accuracy", "auto", "exact_match", "macro_f1", "numeric_match", "qa_f1", "rouge_l", "set_f1")

_words = S.Text(filled=True)
_decision = S.Text(one_of=DECISIONS)
_judged = {"confidence": S.Number(low=0, high=1), "reasoning": _words}
_assessed = S.Record({"improvement_probable": S.Flag(), **_judged}, open=True)
#: A review, a candidate and a hand-over; a reader checks the dataset, split and round that it expects besides.
REVIEW = S.Record({"required": S.Flag(), "consensus": S.Flag(), "decision": _decision, "retrieval": _assessed, "critic": _assessed, "orchestrator": S.Record({"decision": _decision, **_judged}, open=True)}, open=True)
CANDIDATE = S.Record(
    {"candidate_id": _words, "condition": _words, "model": _words, "source": _words, "intended_use": S.Text(one_of=INTENDED_USES), "reason": _words, "rank": S.Number(whole=True), "score": S.Number()}, open=True
)
HANDOFF = S.Record(
    {"handoff_version": S.Equals(HANDOFF_VERSION), "mock": S.Flag(), "owner": _words, "retrieval_agent": _words, "dataset": S.Text(), "split": S.Text(), "round": S.Number(whole=True), "candidates": S.Items(CANDIDATE, 1, ("candidate_id",))},
    {"continuation_review": REVIEW, "provider_input_checksum": S.Text(pattern="^[0-9a-f]{64}$")}, open=True,
)


def _method_misfits(get: Callable[[str], Column]) -> Column:
    method = F.coalesce(get("evaluation_method"), F.lit("auto"))
    return (get("task") != "") & ~method.isin("", "auto") & ~metric_fits(get("task"), method)


#: A context of a dataset and the models that are to be run on it.
DATASET_CONTEXT = S.Record(
    {**dict.fromkeys(("answer_column", "choices_column", "image_column", "notes", "prompt_template", "question_column"), S.Text()), "task": S.Text(one_of=CONTEXT_TASKS), "label_map": S.Map(S.Text())},
    {**dict.fromkeys(("subset", "split", "context_column", "dataset_source", "answer_regex"), S.Text()), "dataset_kwargs": S.Map(), "label_threshold": S.Optional(S.Number()), "evaluation_method": S.Text(one_of=CONTEXT_METHODS), "choices_columns": S.Items(S.Text())},
    rules=(("evaluation_method does not fit the task", _method_misfits),),
)
CONTEXT = S.Record({"dataset": S.Text(), "models": S.Items(S.Text()), "confidence": S.Text(one_of=CONFIDENCES), "dataset_context": DATASET_CONTEXT, "model_context": S.Record({"notes": S.Text()})})


def handoff_error(handoff: Column, dataset: Column, split: Column, round_number: Column) -> Column:
    """The first error of a hand-over (JSON text) for a round of a dataset's split; '' if there is none."""
    own = lambda name: F.get_json_object(handoff, f"$.{name}")
    expected = [F.when(~own(n).eqNullSafe(x.cast("string")), F.lit(f"$.{n}: not the expected one")) for n, x in (("dataset", dataset), ("split", split), ("round", round_number))]
    error = S.first_error(handoff, HANDOFF)
    return F.when(error != "", error).otherwise(F.coalesce(*expected, F.lit("")))


def context_error(context: Column, dataset: Column, models: Column) -> Column:
    """The first error of a context (JSON text) for a dataset and its models, in order; '' if there is none."""
    named = F.from_json(context, "dataset string, models array<string>")
    error = S.first_error(context, CONTEXT)
    return F.when(error != "", error).when(~named["dataset"].eqNullSafe(dataset), "$.dataset: not the expected one").when(~named["models"].eqNullSafe(models), "$.models: not the expected ones").otherwise("")


def readiness(specs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each spec (dataset, split, models, context: JSON text or null): the columns to keep, dataset, status, split, task,
    metric, confidence and errors. A spec is ready if its context is there and valid."""
    error = F.when(~filled(F.col("context")), "evaluation_context is missing").otherwise(context_error(F.col("context"), F.col("dataset"), F.col("models")))
    rows = specs.withColumn("_error", error)
    ready = F.col("_error") == ""
    value = lambda path, default=None: F.when(ready, F.coalesce(F.get_json_object("context", path), F.lit(default)))
    return rows.select(
        *keep, "dataset", F.when(ready, "ready").otherwise("failed").alias("status"), F.when(ready, F.coalesce("split", F.lit("auto"))).alias("split"), value("$.dataset_context.task").alias("task"),
        value("$.dataset_context.evaluation_method", "auto").alias("metric"), value("$.confidence").alias("confidence"), F.when(ready, F.array().cast("array<string>")).otherwise(F.array("_error")).alias("errors"),
    )


def review_error(review: Column) -> Column:
    """The first breach of the contract by a review (JSON text), '' if there is none: an object with all fields, boolean
    flags, known decisions, a boolean probability flag in each assessment, confidences in [0, 1] and reasons."""
    v = F.try_parse_json(review)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    keys = F.coalesce(F.json_object_keys(review), F.array().cast("array<string>"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(x) for x in REVIEW_FIELDS]), keys))
    is_object = lambda path: F.startswith(kind(path), F.lit("OBJECT"))
    decides = lambda path: F.coalesce((kind(path) == "STRING") & F.try_variant_get(v, path, "string").isin(*DECISIONS), F.lit(False))

    def judged(role: str) -> list[tuple[Column, str]]:
        score = F.try_variant_get(v, f"$.{role}.confidence", "double")
        number = kind(f"$.{role}.confidence").rlike("^(BIGINT|DOUBLE|DECIMAL)")
        reason = f"$.{role}.reasoning"
        return [
            (~F.coalesce(number & (score >= 0) & (score <= 1), F.lit(False)), f"{role} confidence"),
            (~((kind(reason) == "STRING") & filled(F.try_variant_get(v, reason, "string"))), f"{role} reasoning"),
        ]

    rules: list[tuple[Column, str | Column]] = [(~F.coalesce(is_object("$"), F.lit(False)), "not an object"), (F.size(missing) > 0, F.concat(F.lit("missing "), F.get(missing, F.lit(0))))]
    rules += [(kind(f"$.{x}") != "BOOLEAN", f"{x} flag") for x in REVIEW_FLAGS]
    rules += [(~decides("$.decision"), "decision")]
    rules += [(~is_object(f"$.{x}"), f"{x} object") for x in (*ASSESSING_ROLES, DECIDING_ROLE)]
    for role in ASSESSING_ROLES:
        rules += [(kind(f"$.{role}.improvement_probable") != "BOOLEAN", f"{role} improvement_probable"), *judged(role)]
    rules += [(~decides(f"$.{DECIDING_ROLE}.decision"), f"{DECIDING_ROLE} decision"), *judged(DECIDING_ROLE)]
    out = F.lit("")
    for broken, name in reversed(rules):
        out = F.when(broken, name if isinstance(name, Column) else F.lit(name)).otherwise(out)
    return out


def rewritten_config(text: str | None, evaluator: bool = True) -> str | None:
    """A configuration with a null use_cache as true, at any depth; as the evaluator writes it, also with the model type of
    its architectures and the type of its rope."""

    def walk(x: object) -> object:
        if isinstance(x, list):
            return [walk(y) for y in x]
        if not isinstance(x, dict):
            return x
        own = dict(x)
        if evaluator:
            if "model_type" not in own and any("Bert" in str(n) for n in own.get("architectures") or []):
                own["model_type"] = "bert"
            if "rope_type" in own and "type" not in own:
                own["type"] = own["rope_type"]
        return {k: True if k == "use_cache" and y is None else walk(y) for k, y in own.items()}

    try:
        return json.dumps(walk(json.loads(text or "")), sort_keys=True)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def rewrite_config(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column form of rewritten_config(); the depth of a configuration has no bound, so there is no native form."""
    for s in rows:
        yield s.map(rewritten_config, na_action="ignore")


def cache_names(dataset: Column) -> Column:
    """The names under which caches hold a dataset."""
    return F.array_sort(F.array_distinct(F.array(dataset, F.replace(dataset, F.lit("/"), F.lit("___")), safe_name(dataset), F.replace(dataset, F.lit("/"), F.lit("--")), F.element_at(F.split(dataset, "/"), -1))))


def cached_paths(paths: DataFrame, datasets: DataFrame) -> DataFrame:
    """The rows of paths (path) whose last part is a cache name of a dataset (dataset), with that dataset."""
    names = datasets.select("dataset", F.explode(cache_names(F.col("dataset"))).alias("name"))
    return paths.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(names, "name").select("path", "dataset").distinct()


def download_status(splits: DataFrame, go_on: bool = True) -> DataFrame:
    """splits (dataset, ordinal, rows, error): one row a dataset with its status and counts. A message of VERSION_INCOMPATIBLE
    skips the dataset and ends it there; another error fails it, and ends it unless go_on. Later splits aren't counted."""
    message = F.coalesce("error", F.lit(""))
    bad = filled(F.col("error"))
    old = F.exists(F.array(*[F.lit(x) for x in VERSION_INCOMPATIBLE]), lambda x: F.contains(message, x))
    ends = splits.where(bad & (old | F.lit(not go_on))).groupBy("dataset").agg(F.min("ordinal").alias("_end"))
    rows = splits.join(ends, "dataset", "left").where(F.col("_end").isNull() | (F.col("ordinal") <= F.col("_end")))
    skipped = F.coalesce(F.max(bad & old), F.lit(False))
    return rows.groupBy("dataset").agg(
        F.when(skipped, "skipped").when(F.max(bad), "failed").otherwise("ok").alias("status"), F.count_if(~bad).alias("splits"), F.count_if(bad).alias("failures"), F.coalesce(F.sum(F.when(~bad, F.col("rows"))), F.lit(0)).alias("rows"),
    )


def cycle(steps: DataFrame, go_on: bool = False) -> DataFrame:
    """steps (dataset, ordinal of the dataset, name, returncode, failures, skipped): one row a dataset that is run, with its
    status: skipped if a step skipped it; failed if a step returned an error, or an evaluation reported failures; else ok.
    Without go_on, the first failed dataset is the last."""
    ok = (F.col("returncode") == 0) & ~((F.col("name") == "evaluate") & (F.coalesce("failures", F.lit(0)) > 0))
    each = steps.groupBy("dataset", "ordinal").agg(F.when(F.max(F.coalesce("skipped", F.lit(0))) > 0, "skipped").when(F.min(ok), "ok").otherwise("failed").alias("status"), F.count(F.lit(1)).alias("steps"))
    if go_on:
        return each
    first = each.where("status = 'failed'").agg(F.min("ordinal").alias("_stop"))  # one row
    return each.join(F.broadcast(first)).where("_stop is null or ordinal <= _stop").drop("_stop")


def obtained(rounds: DataFrame, static: DataFrame, cached: DataFrame) -> DataFrame:
    """rounds (dataset, round, request) with the source of their candidates: 'static' if given for the round, else 'cache' if
    an earlier answer is to the same request, else 'provider'."""
    given = static.select("dataset", "round", F.lit(True).alias("_static")).distinct()
    held = cached.select("dataset", "round", "request", F.lit(True).alias("_cached")).distinct()
    out = rounds.join(given, ["dataset", "round"], "left").join(held, ["dataset", "round", "request"], "left")
    return out.withColumn("source", F.when(F.col("_static"), "static").when(F.col("_cached"), "cache").otherwise("provider")).drop("_static", "_cached")


def summary_metric(declared: Column, score: Column, summary: Column) -> Column:
    """The metric of a run: as declared, else the only one of SUMMARY_METRICS whose value in summary (map<string, double>) is
    the score, within tolerance; '' without exactly one."""
    close = lambda x: F.coalesce(F.abs(x - score) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(x), F.abs(score)), F.lit(1e-12)), F.lit(False))
    hits = F.filter(F.array(*[F.lit(m) for m in SUMMARY_METRICS]), lambda m: close(F.try_element_at(summary, m)))
    return F.when(filled(declared), declared).when(F.size(hits) == 1, F.get(hits, F.lit(0))).otherwise("")


def merged_labels(file: Column, inline: Column) -> Column:
    """Two label maps (map<string, string>) as one; inline wins."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(file, none), F.coalesce(inline, none)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def usable_labels(labels: Column) -> Column:
    """The distinct texts of a label map in key order: not for the key -1, no blanks, nothing that begins with 'missing'."""
    own = F.filter(F.array_sort(F.map_entries(labels)), lambda e: (e["key"] != "-1") & filled(e["value"]) & ~F.startswith(F.lower(F.trim(e["value"])), F.lit("missing")))
    return F.array_distinct(F.transform(own, lambda e: e["value"]))


def first_models(df: DataFrame, n: int = 2) -> DataFrame:
    """df (dataset, ordinal, model): the first n distinct models of each dataset, joined with '; '."""
    first = df.where(filled(F.col("model"))).groupBy("dataset", "model").agg(F.min("ordinal").alias("at"))
    placed = first.withColumn("_n", F.row_number().over(Window.partitionBy("dataset").orderBy("at"))).where(F.col("_n") <= n)
    return placed.groupBy("dataset").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "model"))), lambda x: x["model"]), "; ").alias("models"))
