"""Extension: the selection loop over a stream of results, with its state kept by dataset.

A dataset's state is the key (metric and protocol family) of its first success, and for each round and key how many
candidates there were, how many succeeded, and the best score; and the models seen. All parts merge in any order, so
micro-batches of any cut, also with late rows, end in the rows that the whole table gives. Each batch puts out the rounds
of the datasets it touched; the last row of a round counts. Rounds bound the state, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyframe.operators.loop import stop_reasons
from tallyframe.operators.ranking import comparability_key, with_outcome

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROUNDS = "dataset string, round long, candidates long, successes long, score double, seen_models long"


class LoopState(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "ordinal long, key string")
        self.rounds = handle.getMapState("rounds", "round long, key string", "candidates long, successes long, best double")
        self.models = handle.getMapState("models", "model string", "seen boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for m in batch["model"].dropna().unique():
                self.models.updateValue((m,), (True,))
            good = batch[batch["success"]]
            if len(good):
                top = good.loc[good["ordinal"].idxmin()]
                if not self.first.exists() or int(top["ordinal"]) < self.first.get()[0]:
                    self.first.update((int(top["ordinal"]), top["key"]))
            for (r, k), part in batch.groupby(["round", "key"]):
                won = part.loc[part["success"], "score"]
                own = (int(r), k)
                old = self.rounds.getValue(own) if self.rounds.containsKey(own) else (0, 0, None)
                best = [x for x in (old[2], float(won.max()) if len(won) else None) if x is not None]
                self.rounds.updateValue(own, (old[0] + len(part), old[1] + len(won), max(best) if best else None))
        canonical = self.first.get()[1] if self.first.exists() else None
        found: dict[int, list] = {}
        for (r, k), (candidates, successes, best) in self.rounds.iterator():
            row = found.setdefault(r, [0, 0, None])
            row[0] += candidates
            if k == canonical:
                row[1:] = [successes, best]
        seen = sum(1 for _ in self.models.keys())
        out = pd.DataFrame([(key[0], r, *x, seen) for r, x in found.items()], columns=["dataset", "round", "candidates", "successes", "score", "seen_models"])
        yield out.astype({"score": "float64"})

    def close(self) -> None:
        pass


def loop_rounds(results: DataFrame) -> DataFrame:
    """A stream of results (dataset, model, round, ordinal, status, score, labeled_total, metric, evaluation_protocol) as a stream
    of the rounds of the datasets that a batch touched. Rows without a round are not taken."""
    rows = with_outcome(results).where("round is not null").select("dataset", "model", F.col("round").cast("long").alias("round"), F.col("ordinal").cast("long").alias("ordinal"), (F.col("outcome") == "success").alias("success"), F.col("score").cast("double").alias("score"), comparability_key().alias("key"))
    return rows.groupBy("dataset").transformWithStateInPandas(statefulProcessor=LoopState(), outputStructType=_ROUNDS, outputMode="Update", timeMode="None")


def run(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query over what is there, which ends: rounds go to path, with the number of their batch. A rerun goes on from the
    checkpoint, and a batch that is repeated replaces itself."""
    conf, name = results.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    before = conf.get(name)
    conf.set(name, PROVIDER)  # a query keeps the one that it starts with
    try:
        return loop_rounds(results).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    finally:
        conf.set(name, before)


def rounds_so_far(spark: SparkSession, path: str, target: int = 0, minimum: float = 0.0) -> DataFrame:
    """The rows of replay() by what the stream has put out so far, with seen_models."""
    rows = spark.read.schema(f"{_ROUNDS}, batch long").option("basePath", path).parquet(path)
    last = rows.groupBy("dataset", "round").agg(F.max_by(F.struct("candidates", "successes", "score", "seen_models"), "batch").alias("r"))
    return stop_reasons(last.select("dataset", "round", "r.*"), target, minimum)
