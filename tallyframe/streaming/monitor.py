"""Extension: run results as a stream. Late rows are taken up to the watermark; windows are aggregated with state that
the watermark bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyframe.functions.contract import measured_success


def windowed_outcomes(results: DataFrame, time: str = "ts", window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """results (dataset, status, score, labeled_total, time), streaming or not: counts and the best score by window."""
    ok = measured_success(F.col("status"), F.col("score"), F.col("labeled_total"))
    w = F.window(time, window, slide) if slide else F.window(time, window)
    rows = results.withWatermark(time, late) if results.isStreaming else results
    agg = rows.groupBy(w.alias("w"), "dataset").agg(F.count(F.lit(1)).alias("results"), F.count_if(ok).alias("successes"), F.max(F.when(ok, F.col("score"))).alias("best_score"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "dataset", "results", "successes", "best_score")


def sessions(results: DataFrame, key: str = "model", time: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Activity sessions of a key."""
    rows = results.withWatermark(time, late) if results.isStreaming else results
    agg = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("results"))
    return agg.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "results")


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over what is there and stops; a rerun goes on from the checkpoint."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
