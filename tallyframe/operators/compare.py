"""Head-to-head comparison of candidate pools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.contract import is_close
from tallyframe.functions.text import best_rank, condition_names
from tallyframe.operators.ranking import first_best


def pools(pairs: DataFrame, methods: dict[str, tuple[str, ...]], ranks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """pairs (dataset, model, ordinal, conditions, score, metric): one row for each dataset and rank limit, with the best
    model of each method's pool, its score and metric, and measured/pool counts. Pools are one conditional aggregation."""
    # Memberships are parsed once a pair; a method needs its best rank alone.
    own = pairs.withColumn("_m", condition_names(F.col("conditions")))
    own = own.withColumns({f"_r_{name}": best_rank(F.col("_m"), conditions) for name, conditions in methods.items()}).drop("_m")
    wide = own.withColumn("max_rank", F.explode(F.array(*[F.lit(k) for k in ranks])))
    for name in methods:
        inside = F.coalesce(F.col(f"_r_{name}") <= F.col("max_rank"), F.lit(False))
        wide = wide.withColumns({f"_in_{name}": inside, f"_s_{name}": F.when(inside, F.col("score"))})
    cells = []
    for name in methods:
        cells += [first_best("model", f"_s_{name}").alias(f"{name}_model"), F.max(f"_s_{name}").alias(f"{name}_score"), first_best("metric", f"_s_{name}").alias(f"{name}_metric")]
        cells += [F.concat(F.count(f"_s_{name}").cast("string"), F.lit("/"), F.count_if(f"_in_{name}").cast("string")).alias(f"{name}_coverage")]
    return wide.groupBy("dataset", "max_rank").agg(*cells)


def winner(methods: list[str], tie: str = "tie") -> Column:
    """The one best method; 'tie' within tolerance; 'incomplete' if a pool is empty or known metrics differ."""
    scores = [F.col(f"{m}_score") for m in methods]
    metrics = F.array_distinct(F.filter(F.array(*[F.col(f"{m}_metric") for m in methods]), lambda x: F.coalesce(x != "", F.lit(False))))
    top = F.greatest(*scores)
    at_top = F.filter(F.array(*[F.when(is_close(s, top), F.lit(m)) for m, s in zip(methods, scores, strict=True)]), lambda x: x.isNotNull())
    empty = reduce(lambda a, b: a | b, [s.isNull() for s in scores])
    return F.when(empty | (F.size(metrics) > 1), "incomplete").when(F.size(at_top) == 1, F.get(at_top, F.lit(0))).otherwise(tie)


def winner_counts(df: DataFrame, winners: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """How often each of the winners won: a column for each, by keys or in all."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col("winner") == w).alias(w) for w in winners])
