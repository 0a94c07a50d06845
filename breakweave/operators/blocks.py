"""Block statistics, block bootstrap and the summaries built on them.

A bootstrap is a column, not a job: draws are a small table (draw, slot, block) joined with per-block sums. Draws come
from a hash of seed, draw and slot, so that every engine and every run draws the same blocks.
"""

from __future__ import annotations

import math

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breakweave.sources.scratch import written


def block_id(pos: Column, size: int) -> Column:
    """Nearest multiple of the block size, halves to even."""
    return F.bround(pos / size).cast("long")


def hashed_number(below: Column | int, *parts: Column | int | str) -> Column:
    """A number in [0, below) hashed from the parts (the first 7 hex digits of an MD5)."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") % (below if isinstance(below, Column) else F.lit(below))


def least_of_each(rows: DataFrame, by: list[str], bin_: Column, order: list[Column], quota: Column) -> DataFrame:
    """The `quota` first rows of each group in the given order; null keys are a group, a quota is one number a group.

    `bin_` must rise with the order, such as a hash's first digits. Rows are counted by bin; the bins below the one
    that a quota ends in are taken whole and only bins are ranked, so that no task sorts a group. Groups are few: one
    number a group is broadcast.
    """
    binned = rows.withColumns({"_bin": bin_, "_quota": quota})
    counts = binned.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("n"), F.max("_quota").alias("q"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*by).orderBy("_bin")) - F.col("n"))
    edge = counts.where("before < q").groupBy(*[F.col(k).alias(f"_by_{k}") for k in by]).agg(F.max(F.struct("_bin", (F.col("q") - F.col("before")).alias("rest"))).alias("_edge"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by])
    near = binned.join(F.broadcast(edge), same).where(F.col("_bin") <= F.col("_edge._bin"))
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_bin").orderBy(*order)))
    taken = ranked.where((F.col("_bin") < F.col("_edge._bin")) | (F.col("_rank") <= F.col("_edge.rest")))
    return taken.select(*rows.columns)


def draws(spark: SparkSession, n_draws: int, n_blocks: int, seed: int) -> DataFrame:
    """draw, slot, block: each draw takes n_blocks blocks with replacement."""
    grid = spark.range(n_draws * n_blocks).select((F.col("id") / n_blocks).cast("long").alias("draw"), (F.col("id") % n_blocks).alias("slot"))
    return grid.withColumn("block", hashed_number(n_blocks, seed, F.col("draw"), F.col("slot")))


def block_counts(rows: DataFrame, condition: Column, n_blocks: int | None = None) -> DataFrame:
    """block, n_true, n_false for every block from 0 to the last, zeros filled in. Rows carry block."""
    sums = rows.groupBy("block").agg(F.count_if(condition).alias("n_true"), F.count_if(~condition).alias("n_false"))
    if n_blocks is None:
        sums = written(sums, "blocks")  # a row a block; the rows are read once
        n_blocks = (sums.agg(F.max("block").alias("m")).first()["m"] or 0) + 1
    dense = rows.sparkSession.range(n_blocks).withColumnRenamed("id", "block").join(sums, "block", "left")
    return dense.select("block", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_true", "n_false")])


def normalise(counts: DataFrame, by_true: float, by_false: float) -> DataFrame:
    return counts.withColumn("n_true", F.col("n_true") / by_true).withColumn("n_false", F.col("n_false") / by_false)


def sampled_sums(counts: DataFrame, drawn: DataFrame, columns: list[str]) -> DataFrame:
    """The columns summed over the blocks of each draw."""
    return drawn.join(counts, "block").groupBy("draw").agg(*[F.sum(c).alias(c) for c in columns])


def compare_draws(sums: DataFrame) -> DataFrame:
    """ratio, and less: 1 where the sum under the condition is below the rest."""
    ratio = F.when(F.col("n_false") != 0, F.col("n_true") / F.col("n_false"))
    return sums.withColumn("ratio", ratio).withColumn("less", (F.col("n_true") < F.col("n_false")).cast("int"))


def quantile_interval(rows: DataFrame, column: str, level: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """mean, low, high with linear interpolation."""
    tail = (1 - level) / 2
    q = lambda p: F.expr(f"percentile({column}, {p})")
    return rows.groupBy(*(by or [])).agg(F.avg(column).alias("mean"), q(tail).alias("low"), q(1 - tail).alias("high"))


def half_widths(interval: DataFrame) -> DataFrame:
    return interval.withColumn("below", F.col("mean") - F.col("low")).withColumn("above", F.col("high") - F.col("mean"))


def share_against(sums: DataFrame, zero_based: bool) -> DataFrame:
    """zero_based: the share of draws not below. Else the share of draws below, and 1 if none is not."""
    ones = F.avg("less")
    return sums.agg((1 - ones if zero_based else F.when(F.count_if(F.col("less") == 0) == 0, 1.0).otherwise(ones)).alias("share_cond_lt_rest"))


def adjusted(share: DataFrame, tests: int) -> DataFrame:
    """Bonferroni: times the number of tests, 1 at most."""
    return share.withColumn("share_cond_lt_rest", F.least(F.col("share_cond_lt_rest") * tests, F.lit(1.0)))


def density(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Counts over each block's size; blocks without size have none."""
    return counts.join(sizes, "block").withColumn("density", F.when(F.col("size") > 0, F.col("n_true") / F.col("size")))


def resampled_variants(rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """The rows of the drawn blocks, once for each slot, with ids of their own: id_block_slot."""
    out = drawn.join(rows, "block")
    return out.withColumn("variant_id", F.concat_ws("_", "variant_id", "block", "slot")).withColumnRenamed("draw", "boot_n")


def insertion_shares(rows: DataFrame, snap_cutoff: float = 0.005, loop_cutoff: float = 0.003, by: list[str] | None = None) -> DataFrame:
    """Shares of distinct insertion variants: snap only, loop only, both (SDMMEJ), and the rest.

    A pattern counts if its p-value is below the cutoff over the variant's number of rows. Null without insertions.
    """
    by = by or []
    ins = rows.where("indel_type = 'INS'")
    hit = lambda c, cut: F.coalesce(F.bool_or(F.col(c) < F.lit(cut) / F.col("variant_id_N")), F.lit(False))
    each = ins.groupBy(*by, "variant_id").agg(hit("snap_p_val", snap_cutoff).alias("s"), hit("loop_p_val", loop_cutoff).alias("l"))
    share = lambda c: F.avg(c.cast("double"))
    s, l = F.col("s"), F.col("l")  # noqa: E741
    out = each.groupBy(*by).agg(share(s & ~l).alias("snap"), share(l & ~s).alias("loop"), share(s & l).alias("SDMMEJ"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("unclassified_ins", 1 - F.col("snap") - F.col("loop") - F.col("SDMMEJ"))


def bootstrap_summary(deletions: DataFrame, insertions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Deletion and insertion results of each draw side by side; with bins, either side may miss one."""
    by = by or ["boot_n"]
    return deletions.join(insertions, by, "inner" if by == ["boot_n"] else "full")


def best_realignments(rows: DataFrame, probabilities: list[str], mode: str = "max") -> DataFrame:
    """max: the rows with their variant's largest probability, ties kept. mean: variants' mean probabilities on all rows."""
    w = Window.partitionBy("chr", "original_pos")
    if mode == "mean":
        return rows.withColumns({f"mean_{p}": F.avg(p).over(w) for p in probabilities})
    top = F.greatest(*probabilities) if len(probabilities) > 1 else F.col(probabilities[0])
    ranked = rows.withColumn("_top", top).withColumn("_rank", F.rank().over(w.orderBy(F.col("_top").desc_nulls_last())))
    return ranked.where("_rank = 1").drop("_top", "_rank")


def likeliest_mechanism(rows: DataFrame, mechanisms: list[str]) -> DataFrame:
    """variant_id, mechanism, lk: of the rows with a pattern if there are any, the largest likelihood; ties go to the first named."""
    long = rows.select("variant_id", F.explode(F.array(*[F.struct(F.lit(m).alias("mechanism"), F.col(m).alias("lk"), F.lit(-k).alias("o")) for k, m in enumerate(mechanisms)])).alias("x"), "has_pattern")
    best = F.max_by(F.struct("x.mechanism", "x.lk"), F.struct("has_pattern", "x.lk", "x.o"))
    return long.where("x.lk is not null").groupBy("variant_id").agg(best.alias("b")).select("variant_id", "b.mechanism", "b.lk")


def wald_interval(p: Column, n: Column) -> Column:
    return 1.96 * F.sqrt(p * (1 - p) / n)


def binned_mean(rows: DataFrame, bin_: Column, value: str, n_bins: int) -> DataFrame:
    """bin, mean, n, share_total (of all rows), for every bin; empty ones have n 0 and no mean."""
    sums = written(rows.groupBy(bin_.cast("long").alias("bin")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")), "bins")  # a row a bin; the rows are read once
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one number
    dense = rows.sparkSession.range(n_bins).withColumnRenamed("id", "bin").join(sums, "bin", "left").join(F.broadcast(total))
    return dense.select("bin", "mean", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share_total"))


def moments(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(F.var_pop(x).alias("var_x"), F.var_pop(y).alias("var_y"), F.corr(x, y).alias("r"), F.pow(F.corr(x, y), 2).alias("r2"))


def length_distribution(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct variants of each length and their share. A row a length, so the share's window is small."""
    by = by or []
    counts = rows.groupBy(*by, "indel_len").agg(F.count_distinct("variant_id").alias("n_variants"))
    total = counts.groupBy(*by).agg(F.sum("n_variants").alias("total"))
    joined = counts.join(total, by) if by else counts.join(F.broadcast(total))
    return joined.withColumn("share", F.col("n_variants") / F.col("total")).drop("total")


def mh_lengths(found: DataFrame) -> DataFrame:
    return found.groupBy("k_max").agg(F.count(F.lit(1)).alias("n"))


def mh_tail(found: DataFrame, cut: int = 4) -> DataFrame:
    return found.agg(F.count_if(F.col("k_max") >= cut).alias("n_long"), F.count_if((F.col("k_max") > 0) & (F.col("k_max") < cut)).alias("n_short"))


def exceedance(a: DataFrame, b: DataFrame, column: str, tests: int = 1) -> DataFrame:
    """Over paired bootstraps (boot_n): the share in which a exceeds b, times the tests, and its stars."""
    pair = a.select("boot_n", F.col(column).alias("x")).join(b.select("boot_n", F.col(column).alias("y")), "boot_n")
    out = pair.agg(F.least(F.avg((F.col("x") > F.col("y")).cast("double")) * tests, F.lit(1.0)).alias("p"))
    return out.withColumn("stars", F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise("ns"))


#: Differences up to which the null distribution is counted out, if none are tied.
EXACT_PAIRS = 50


def rank_sum_chance(w: float, n: int) -> float:
    """The two-sided chance of a signed-rank statistic of n untied differences: signs are counted out by their rank sums."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for total in range(len(ways) - 1, rank - 1, -1):
            ways[total] += ways[total - rank]
    return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)


def wilcoxon(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """w, n, z, p of the signed-rank test: zero differences go, ties share their mean rank.

    p is exact for up to EXACT_PAIRS differences without ties, else from the normal approximation (z); without any
    difference, w is 0 and z and p are null. Ranks come from counts of each absolute difference; those are dealt by
    ranges, ranked within, and lifted by the counts of the ranges before.
    """
    d = pairs.select((F.col(x) - F.col(y)).alias("d")).where("d is not null and d <> 0").withColumn("a", F.abs("d"))
    counts = d.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    placed = written(counts.repartitionByRange("a").withColumn("part", F.spark_partition_id()), "differences")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lifts = placed.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("lift"))  # a row a range
    ranked = placed.withColumn("inside", before(Window.partitionBy("part").orderBy("a"))).join(F.broadcast(lifts), "part").withColumn("rank", F.col("lift") + F.col("inside") + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("up") * F.col("rank")).alias("plus"), F.sum((F.col("n") - F.col("up")) * F.col("rank")).alias("minus"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties")).first()
    n, w, z, p = sums["n"], min(sums["plus"] or 0.0, sums["minus"] or 0.0), None, None
    if n:
        spread = (n * (n + 1) * (2 * n + 1) / 24 - sums["ties"] / 48) ** 0.5
        z = (w - n * (n + 1) / 4) / spread if spread else None
        p = rank_sum_chance(w, n) if n <= EXACT_PAIRS and not sums["ties"] else math.erfc(abs(z) / 2**0.5) if z is not None else None
    return pairs.sparkSession.createDataFrame([(w, n, z, p)], "w double, n long, z double, p double")


def melted(rows: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return rows.unpivot(ids, values, "variable", "value")
