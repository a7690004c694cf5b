"""The loop over a stream: micro-batches of any cut give the rows of the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import loop
from tallyframe.streaming import loop_stream


def table(spark, seed, n=120):
    rng = random.Random(seed)
    rows = [
        (rng.choice(["d", "e", "f"]), f"m{rng.randint(0, 9)}", rng.randint(1, 4), i, rng.choice(["ok", "ok", "failed"]), rng.choice([None, 0.1, 0.5, 0.9]), rng.choice([0, 3]), rng.choice(["accuracy", "macro_f1"]), rng.choice(["label_generation_accuracy", "tagged_label_generation_accuracy", "x"]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "dataset string, model string, round long, ordinal long, status string, score double, labeled_total long, metric string, evaluation_protocol string")


def streamed(spark, folder, out):
    stream = spark.readStream.schema(table(spark, 0, 1).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    loop_stream.run(stream, f"{out}/rounds", f"{out}/state").awaitTermination()
    return loop_stream.rounds_so_far(spark, f"{out}/rounds", 5, 0.05)


@pytest.mark.parametrize(("seed", "order"), [(1, "ordinal"), (2, "shuffled")])
def test_any_cut(spark, tmp_path, seed, order):
    rows, folder = table(spark, seed), str(tmp_path / "in")
    parts = rows.repartition(3) if order == "shuffled" else rows.repartitionByRange(3, "ordinal")
    parts.where("ordinal % 5 <> 0").write.parquet(folder)
    streamed(spark, folder, str(tmp_path))
    parts.where("ordinal % 5 = 0").write.mode("append").parquet(folder)  # late rows, taken by a second run from the checkpoint
    got = streamed(spark, folder, str(tmp_path))
    want = loop.replay(rows, 5, 0.05)
    assert sorted(map(str, got.drop("seen_models").select(*want.columns).collect())) == sorted(map(str, want.collect()))
    models = {r.dataset: r.n for r in rows.groupBy("dataset").agg(F.countDistinct("model").alias("n")).collect()}
    assert {r.dataset: r.n for r in got.groupBy("dataset").agg(F.max("seen_models").alias("n")).collect()} == models
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != loop_stream.PROVIDER
