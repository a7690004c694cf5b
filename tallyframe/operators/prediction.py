"""Model inference behind an Arrow boundary: a predictor is a function of pandas batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Predictor = Callable[[pd.DataFrame], pd.Series]
_predictors: dict[str, Callable[[], Predictor]] = {}


def register(name: str, factory: Callable[[], Predictor]) -> None:
    """factory() loads a model, once in each task, and returns its predictor."""
    _predictors[name] = factory


def predict(prompts: DataFrame, name: str, column: str = "prediction") -> DataFrame:
    """prompts with a string column of predictions. Filters belong before this call: nothing is pushed through it."""
    factory = _predictors[name]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            yield b.assign(**{column: model(b)})

    return prompts.mapInPandas(run, f"{fields}, `{column}` string")


def smoke_then_full(prompts: DataFrame, name: str, passes: Callable[[DataFrame], DataFrame], key: str = "model", smoke_rows: int = 3) -> DataFrame:
    """Predicts the first rows of every key, and all rows of the keys that passes(smoke) returns."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    first = F.row_number().over(Window.partitionBy(key).orderBy("idx")) <= smoke_rows
    smoke = predict(prompts.withColumn("_first", first).where("_first").drop("_first"), name)
    return predict(prompts.join(passes(smoke).select(key).distinct(), key, "left_semi"), name)


register("echo_first_word", lambda: lambda b: b["prompt"].fillna("").str.split().str[0].fillna(""))
