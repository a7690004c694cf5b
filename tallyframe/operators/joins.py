"""Joins with a stated policy for repeated build keys. No side is assumed to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import safe_name, unsafe_model_name


def one_per_key(df: DataFrame, keys: list[str], order: list, name: str = "_rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) == 1).drop(name)


def later_source_wins(*sources: DataFrame, key: str = "dataset") -> DataFrame:
    """The rows of the sources, in order: of a key that several have, those of the last source alone, all of them. The rows
    keep their columns; a null key is a key."""
    rows = sources[0].withColumn("_source", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.withColumn("_source", F.lit(i)))
    # Keys are few beside rows: partial maxima, then a join.
    last = rows.groupBy(F.col(key).alias("_key")).agg(F.max("_source").alias("_last"))
    return rows.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_source") == F.col("_last"))).drop("_key", "_last", "_source")


def join_last(left: DataFrame, right: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Left join to the last row of each key; rows without one get the status 'missing'."""
    last = one_per_key(right, keys, [F.col(ordinal).desc()]).drop(ordinal)
    return left.join(last, keys, "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def join_first(left: DataFrame, right: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Inner join to the first row of each key."""
    return left.join(one_per_key(right, keys, [F.col(ordinal)]).drop(ordinal), keys)


def missing_pairs(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(found.select(*keys).distinct(), keys, "left_anti")


def models_of_logs(logs: DataFrame, candidates: DataFrame) -> DataFrame:
    """logs (run, name) with model: the candidate (run, model) of the run whose safe name the log has, the last of equals by
    name; else the name turned back, as well as that goes."""
    stem = F.regexp_replace(F.regexp_replace("name", r"_smoke\.stderr\.txt$", ""), r"_full\.stderr\.txt$", "")
    own = candidates.groupBy("run", safe_name(F.col("model")).alias("_stem")).agg(F.max("model").alias("_model"))
    return logs.withColumn("_stem", stem).join(own, ["run", "_stem"], "left").withColumn("model", F.coalesce("_model", unsafe_model_name(F.col("_stem")))).drop("_stem", "_model")


def strict_pairs(a: DataFrame, b: DataFrame, key: str, same: dict[str, str] | None = None) -> DataFrame:
    """1:1 join that raises, when it runs, on a repeated key, a key of one side only, or columns of a that differ from those
    of b that `same` names. The other columns must differ in name. One shuffle: both sides are grouped by the key."""
    rows = a.select(key, F.struct(*[c for c in a.columns if c != key]).alias("_a")).unionByName(b.select(key, F.struct(*[c for c in b.columns if c != key]).alias("_b")), allowMissingColumns=True)
    own = rows.groupBy(key).agg(*[F.count(s).alias(f"_n{s}") for s in ("_a", "_b")], *[F.first(s, ignorenulls=True).alias(s) for s in ("_a", "_b")])
    wrong = lambda text: F.raise_error(F.lit(text)).cast("int")
    ok = F.when((F.col("_n_a") > 1) | (F.col("_n_b") > 1), wrong("a key is repeated")).when((F.col("_n_a") == 0) | (F.col("_n_b") == 0), wrong("a key is on one side only"))
    for x, y in (same or {}).items():
        ok = ok.when(~F.col(f"_a.{x}").eqNullSafe(F.col(f"_b.{y}")), wrong(f"{x} differs"))
    return own.withColumn("_ok", ok.otherwise(F.lit(1))).where("_ok = 1").select(key, "_a.*", "_b.*")


def exactly_one(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """left with matches and decision: 'run' where exactly one right row matches, and then its value."""
    counted = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"), F.min(value).alias(value))
    out = left.join(counted, keys, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    one = F.col("matches") == 1
    return out.withColumns({"decision": F.when(one, "run").otherwise("skip"), value: F.when(one, F.col(value))})


def gate(candidates: DataFrame, passing: DataFrame, key: str) -> DataFrame:
    """All candidates with passed; those that failed the first stage don't enter the second."""
    ok = passing.select(key).distinct().withColumn("_ok", F.lit(True))
    return candidates.join(ok, key, "left").withColumn("passed", F.coalesce("_ok", F.lit(False))).drop("_ok")


def allowed_candidates(rows: DataFrame, allowed: DataFrame, excluded: DataFrame, key: str, limit: int, ordinal: str = "ordinal") -> DataFrame:
    """Case-folded semi join to the allowed, anti join to the excluded, first of repeats, re-ranked, the first `limit`."""
    low = lambda df: df.select(F.lower(key).alias("_key")).distinct()
    kept = rows.withColumn("_key", F.lower(key)).join(low(allowed), "_key", "left_semi").join(low(excluded), "_key", "left_anti")
    first = one_per_key(kept, ["_key"], [F.col(ordinal)]).drop("_key")
    # The window sees at most `limit` rows.
    return first.orderBy(ordinal).limit(limit).withColumn("new_rank", F.row_number().over(Window.orderBy(ordinal)))
