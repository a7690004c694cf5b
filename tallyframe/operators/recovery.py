"""Retry and recovery planning: decision tables over run results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.numbering import numbered

#: Fixed values of the decision tables.
ACTIONABLE = ("dataset_context", "missing_output", "never_attempted", "planned_only", "runtime_failure", "stale_adapter")
SALVAGE = ("dataset_context", "missing_output", "never_attempted", "runtime_failure")
EXPLICIT_ROUTES = ("active_coverage_run", "explicit_source_override")


def failure_category(status: Column, reason: Column) -> Column:
    has = lambda s: F.contains(F.coalesce(reason, F.lit("")), F.lit(s))
    return (
        F.when(status == "untried", "never_attempted").when(status == "planned", "planned_only").when(status == "missing", "missing_output").when(status == "failed", "runtime_failure")
        .when((status == "unsupported") & has("no direct adapter exists"), "stale_adapter").when((status == "unsupported") & has("no detected gold labels"), "dataset_context").otherwise("incompatible")
    )


def recovery_route(dataset: Column, model: Column, category: Column, blocked: tuple[str, ...], template_model: Column) -> Column:
    """template_model: the model of the dataset's template, null without one."""
    return (
        F.when(dataset.isin(*blocked), "blocked_remote_code").when(~category.isin(*ACTIONABLE), "skip_incompatible")
        .when(template_model.isNotNull() & (model == template_model), "active_coverage_run").when(template_model.isNotNull(), "explicit_source_override").otherwise("generic_retry")
    )


def salvage_lane(category: Column, route: Column) -> Column:
    return F.when(~category.isin(*SALVAGE), "deferred").when(route == "blocked_remote_code", "blocked").when(route.isin(*EXPLICIT_ROUTES), "explicit").when(route == "generic_retry", "generic").otherwise("deferred")


def number_lanes(df: DataFrame, lane: str, order: list[str]) -> DataFrame:
    """df with task_index: dense ids within each lane. A lane is dealt out to as many tasks as it has ranges of the order."""
    return numbered(df, order, "task_index", (lane,))


def untried_or_failed(conditions: DataFrame, results: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs without a successful result and not excluded, with a dense task id in the order of the first condition."""
    done = results.where("outcome = 'success'").select(*keys).union(excluded.select(*keys)).distinct()
    pairs = conditions.groupBy(*keys).agg(F.min("ordinal").alias("first_ordinal")).join(done, keys, "left_anti")
    return numbered(pairs, ["first_ordinal"], "task_index")


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, state): missing, unexpected or covered."""
    a, b = (x.select(key).distinct().withColumn(n, F.lit(True)) for x, n in ((expected, "_e"), (found, "_f")))
    state = F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("covered")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))
