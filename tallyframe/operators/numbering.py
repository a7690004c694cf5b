"""Dense numbers in a total order, without one task that sees all rows.

Rows are dealt out by ranges of the order and sorted within their partition, once, into a written table. A partition's
rows have consecutive ids, so a row's number is its distance to its partition's first id plus the rows of the partitions
before: one total a partition (and group) is all that is gathered.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.sources.scratch import scratch


def numbered(df: DataFrame, order: list[str | Column], name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """df with `name`: the 0-based place of a row in the order, among all rows or those that agree in the `within` columns
    (nulls agree). Rows that are equal in the order are numbered in no set order, as by row_number()."""
    spark, keys = df.sparkSession, [*within, *order]
    path = scratch(spark, "numbered")
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_pid", F.shiftright("_at", 33))
    totals = rows.groupBy("_pid", *within).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    if within:
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*within).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bases = totals.select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], "_first", before.alias("_base"))
        same = F.col("_pid") == F.col("_p")
        for i, c in enumerate(within):
            same &= F.col(c).eqNullSafe(F.col(f"_w{i}"))
        placed = rows.join(bases, same)
    else:
        # One row a partition.
        found = sorted(totals.collect(), key=lambda r: r["_pid"])
        starts = accumulate((r["_n"] for r in found), initial=0)
        bases = spark.createDataFrame([(r["_pid"], r["_first"], b) for r, b in zip(found, starts, strict=False)], "_p long, _first long, _base long")
        placed = rows.join(F.broadcast(bases), F.col("_pid") == F.col("_p"))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_at") - F.col("_first") + F.col("_base")).alias(name))
