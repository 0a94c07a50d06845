"""Ranks within keys by range partitions and prefix sums: no task sorts a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breakweave.llm.common import hot_join, materialise, release


def ranked(frame: DataFrame, key: str, order: list[str], tag: str) -> DataFrame:
    """`frame` with rank (from 0, within `key`) and total (rows of the key), both long, as a written table.

    Rows are dealt by ranges of (key, order) and a number a row, so that rows that repeat each other can part too;
    a range then knows its rows' places, and sums over the ranges before it turn them into ranks. Nulls in `order`
    come first, equal rows come in any order, `key` must not be null. Columns named rank, total and those that begin
    with _r_ are taken.
    """
    spark = frame.sparkSession
    by = [F.col(c).asc_nulls_first() for c in (key, *order, "_r_tie")]
    numbered = frame.withColumn("_r_tie", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(*by).sortWithinPartitions(*by).drop("_r_tie").withColumn("_r_at", F.monotonically_increasing_id())
    placed = materialise(dealt, spark, f"{tag}-placed").withColumn("_r_part", F.shiftright("_r_at", 33))
    ranges = placed.groupBy("_r_part", key).agg(F.min("_r_at").alias("_r_first"), F.count(F.lit(1)).alias("_r_n"))
    earlier = Window.partitionBy(key).orderBy("_r_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_r_part", key, "_r_first", F.coalesce(F.sum("_r_n").over(earlier), F.lit(0)).alias("_r_before"), F.sum("_r_n").over(Window.partitionBy(key)).alias("total"))
    joined = hot_join(placed, materialise(starts, spark, f"{tag}-ranges"), ["_r_part", key])
    out = joined.withColumn("rank", F.col("_r_at") - F.col("_r_first") + F.col("_r_before")).select(*frame.columns, "rank", "total")
    ranks = materialise(out, spark, f"{tag}-ranks")
    release(placed)
    return ranks
