"""Outcomes, comparability, ranks and winners per dataset. Ties follow the encounter order, which `ordinal` carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.contract import result_outcome
from tallyframe.operators.numbering import numbered

#: Protocols whose accuracies are comparable with each other.
ACCURACY_PROTOCOLS = (
    "multiple_choice_accuracy",
    "label_generation_accuracy",
    "label_logprob_accuracy",
    "tagged_label_generation_accuracy",
    "classifier_label_accuracy",
    "zero_shot_nli_accuracy",
)


def with_outcome(df: DataFrame) -> DataFrame:
    return df.withColumn("outcome", result_outcome(F.col("status"), F.col("score"), F.col("labeled_total")))


def protocol_family(protocol: Column) -> Column:
    return F.when(protocol.isin(*ACCURACY_PROTOCOLS), "label_accuracy").otherwise(F.coalesce(protocol, F.lit("")))


def comparability_key() -> Column:
    """Metric and protocol family of a row (metric, evaluation_protocol): rows of one key can be compared."""
    return F.concat_ws("\u0001", F.coalesce("metric", F.lit("")), protocol_family(F.col("evaluation_protocol")))


def annotate_comparability(df: DataFrame) -> DataFrame:
    """The first success of a dataset fixes metric and protocol family; later ones that differ are non_comparable."""
    key = comparability_key()
    ok = F.col("outcome") == "success"
    first = F.col("_first")
    same = ok & (key == first)
    # One row a dataset, by an aggregate with a partial step: no task sorts a dataset's rows.
    of = df.where(ok).groupBy(F.col("dataset").alias("_of")).agg(F.min_by(key, "ordinal").alias("_first"))
    joined = df.join(of, df["dataset"].eqNullSafe(of["_of"]), "left")
    return joined.withColumns({
        "comparable": same,
        "outcome": F.when(ok & ~same, "non_comparable").otherwise(F.col("outcome")),
        "non_comparable_reason": F.when(same, "").when(ok, F.concat(F.lit("expected "), F.replace(first, F.lit("\u0001"), F.lit("/")), F.lit(", got "), F.replace(key, F.lit("\u0001"), F.lit("/")))).otherwise("not_a_valid_measured_result"),
    }).drop("_of", "_first")


def is_comparable(c: Column) -> Column:
    """Three-valued: only a literal false excludes."""
    return F.coalesce(c, F.lit(True))


def rank_models(df: DataFrame, limit: int) -> DataFrame:
    """Ranks 1..limit within a dataset: comparable successes by score, retrieval rank (a missing one first), round and
    model; datasets without a success rank their planned rows, those without a rank last."""
    success = (F.col("outcome") == "success") & is_comparable(F.col("comparable"))
    df = df.withColumn("_tier", F.when(success, 0).when(F.col("outcome") == "planned", 1))
    best = df.groupBy(F.col("dataset").alias("_of")).agg(F.min("_tier").alias("_best"))
    df = df.join(best, df["dataset"].eqNullSafe(best["_of"]) & (df["_tier"] == best["_best"])).drop("_of")
    order = [
        F.when(success, -F.col("score")),
        F.when(success, F.coalesce("rank", F.lit(0))).otherwise(F.when(F.col("rank").isNull(), 1).otherwise(0)),
        F.when(success, F.coalesce("round", F.lit(0))).otherwise(F.coalesce("rank", F.lit(0))),
        F.when(success, F.coalesce("model", F.lit(""))),
        F.col("ordinal"),
    ]
    ranked = df.withColumn("final_rank", F.row_number().over(Window.partitionBy("dataset").orderBy(*order)))
    return ranked.where(F.col("final_rank") <= limit).drop("_tier", "_best")


def select_winners(df: DataFrame) -> DataFrame:
    """One row a dataset: the best success (first of equals), else the planned, else the failed row of best rank."""
    success = (F.col("outcome") == "success") & is_comparable(F.col("comparable"))
    tier = F.when(success, 0).when(F.col("outcome") == "planned", 1).otherwise(2)
    order = [tier, F.when(success, -F.col("score")), F.when(~success, F.when(F.col("rank").isNull(), 1).otherwise(0)), F.when(~success, F.coalesce("rank", F.lit(0))), F.col("ordinal")]
    best = df.groupBy("dataset").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def first_best(value: str, score: str = "score", ordinal: str = "ordinal") -> Column:
    """Aggregate: the value at the largest score, the first of equals."""
    return F.max_by(value, F.when(F.col(score).isNotNull(), F.struct(F.col(score), -F.col(ordinal))))


def model_gap(df: DataFrame) -> DataFrame:
    """Best and worst success of a dataset and the gap between them."""
    ok = df.where("outcome = 'success'")
    return ok.groupBy("dataset").agg(
        first_best("model").alias("best_model"),
        F.max("score").alias("best_score"),
        F.min_by("model", F.struct("score", "ordinal")).alias("worst_model"),
        F.min("score").alias("worst_score"),
    ).withColumn("gap", F.round(F.col("best_score") - F.col("worst_score"), 6))


def round_robin(df: DataFrame, limit: int) -> DataFrame:
    """The first `limit` rows taken in turn from each dataset, datasets in the order of their first row."""
    first = df.groupBy(F.col("dataset").alias("_of")).agg(F.min("ordinal").alias("_first"))
    # Only row numbers up to the limit are asked for, so tasks cut their datasets before the shuffle.
    placed = df.withColumn("depth", F.row_number().over(Window.partitionBy("dataset").orderBy("ordinal"))).where(F.col("depth") <= limit)
    return placed.join(first, placed["dataset"].eqNullSafe(first["_of"])).orderBy("depth", "_first").limit(limit).drop("_first", "_of")


def task_ids(df: DataFrame, keys: tuple[str, ...] = ("dataset", "model")) -> DataFrame:
    """(keys, task_index, rows): dense 0-based ids by first occurrence."""
    pairs = df.groupBy(*keys).agg(F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("n_rows"))
    return numbered(pairs, ["first_ordinal"], "task_index")


def improvement_stops(rounds: DataFrame, minimum: float) -> DataFrame:
    """rounds (dataset, round, score) with the best score before, and whether the round's gain is too small to go on."""
    before = F.max("score").over(Window.partitionBy("dataset").orderBy("round").rowsBetween(Window.unboundedPreceding, -1))
    stop = F.lit(minimum > 0) & F.col("previous_best").isNotNull() & (F.col("score").isNull() | (F.round(F.col("score") - F.col("previous_best"), 9) < minimum))
    return rounds.withColumn("previous_best", before).withColumn("stop", F.coalesce(stop, F.lit(False)))
