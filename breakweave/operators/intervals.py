"""Interval joins by tiles: an equality on (chr, tile), then the exact test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE = 4096


def _tiled(rows: DataFrame, start: str, end: str, size: int) -> DataFrame:
    """Every tile that [start, end) touches; an empty interval has the tile of its start."""
    last = F.greatest(F.col(end) - 1, F.col(start))
    return rows.withColumn("tile", F.explode(F.sequence((F.col(start) / size).cast("long"), (last / size).cast("long"))))


def merged(intervals: DataFrame, size: int = TILE) -> DataFrame:
    """Disjoint intervals: overlapping and touching ones of a chromosome become one.

    Of the intervals that start at one base the longest counts, so a tile has `size` rows at most; within a tile ends
    are carried along in order, and from tile to tile by one row each. Null chromosomes are one of their own.
    """
    longest = intervals.groupBy("chr", "start").agg(F.max("end").alias("end")).withColumn("tile", F.floor(F.col("start") / size))
    earlier_tiles = Window.partitionBy("chr").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("chr", "tile").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = longest.groupBy("chr", "tile").agg(F.max("end").alias("end")).select(F.col("chr").alias("c"), F.col("tile").alias("t"), F.max("end").over(earlier_tiles).alias("carried"))
    same = F.col("chr").eqNullSafe(F.col("c")) & (F.col("tile") == F.col("t"))
    reach = F.greatest(F.max("end").over(earlier), F.col("carried"))
    marked = longest.join(ends, same).withColumn("first", F.when(F.coalesce(F.col("start") > reach, F.lit(True)), F.col("start"))).drop("c", "t", "carried")
    # An island is named by its first base: the last one up to a row, in its tile or before.
    firsts = marked.groupBy("chr", "tile").agg(F.max("first").alias("first")).select(F.col("chr").alias("c"), F.col("tile").alias("t"), F.max("first").over(earlier_tiles).alias("carried"))
    island = F.coalesce(F.max("first").over(earlier.rowsBetween(Window.unboundedPreceding, 0)), F.col("carried"))
    named = marked.join(firsts, same).withColumn("island", island)
    return named.groupBy("chr", "island").agg(F.max("end").alias("end")).select("chr", F.col("island").alias("start"), "end")


def contained(rows: DataFrame, intervals: DataFrame, size: int = TILE) -> DataFrame:
    """Rows (chr, start, end) that lie wholly inside an interval, once for each such interval (b_start, b_end).

    A row is looked up in the tile of its start alone: any interval that holds it touches that tile.
    """
    b = _tiled(intervals.select("chr", F.col("start").alias("b_start"), F.col("end").alias("b_end")), "b_start", "b_end", size)
    a = rows.withColumn("tile", (F.col("start") / size).cast("long"))
    return a.join(b, ["chr", "tile"]).where("start >= b_start and end <= b_end").drop("tile")


def inside(rows: DataFrame, intervals: DataFrame, size: int = TILE) -> DataFrame:
    """Rows wholly inside some interval, each once."""
    return _semi(rows, intervals, size, "left_semi")


def outside(rows: DataFrame, intervals: DataFrame, size: int = TILE) -> DataFrame:
    """Rows wholly inside no interval."""
    return _semi(rows, intervals, size, "left_anti")


def _semi(rows: DataFrame, intervals: DataFrame, size: int, how: str) -> DataFrame:
    b = _tiled(intervals.select(F.col("chr").alias("b_chr"), F.col("start").alias("b_start"), F.col("end").alias("b_end")), "b_start", "b_end", size)
    a = rows.withColumn("a_tile", (F.col("start") / size).cast("long"))
    on = (F.col("chr") == F.col("b_chr")) & (F.col("a_tile") == F.col("tile")) & (F.col("start") >= F.col("b_start")) & (F.col("end") <= F.col("b_end"))
    return a.join(b, on, how).drop("a_tile")


def overlapping(rows: DataFrame, intervals: DataFrame, size: int = TILE) -> DataFrame:
    """Pairs that share a base; a pair is kept in the first tile that both touch."""
    a = _tiled(rows, "start", "end", size)
    b = _tiled(intervals.select("chr", F.col("start").alias("b_start"), F.col("end").alias("b_end")), "b_start", "b_end", size)
    first = (F.greatest("start", "b_start") / size).cast("long")
    return a.join(b, ["chr", "tile"]).where((F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")) & (F.col("tile") == first)).drop("tile")
