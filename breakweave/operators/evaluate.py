"""Evaluation against known labels: confusion counts, ROC curves, mixtures, tool comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breakweave.operators.blocks import hashed_number, least_of_each


def confusion(score: Column, positive: Column, cutoff: Column) -> dict[str, Column]:
    """True positives lie above the cutoff, false ones at or above; true negatives below, false ones at or below."""
    return {
        "tp": F.count_if(positive & (score > cutoff)),
        "fp": F.count_if(~positive & (score >= cutoff)),
        "tn": F.count_if(~positive & (score < cutoff)),
        "fn": F.count_if(positive & (score <= cutoff)),
    }


def rates(counts: DataFrame) -> DataFrame:
    part = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return counts.withColumn("tpr", part("tp", "fn")).withColumn("fpr", part("fp", "tn")).withColumn("precision", part("tp", "fp"))


def cutoff_table(spark: SparkSession, cutoffs: list[float]) -> DataFrame:
    return spark.createDataFrame([(float(c),) for c in cutoffs], "cutoff double")


def grid(fine: int = 100) -> list[float]:
    """Cutoffs dense near 0 and near 1."""
    low = [k / fine / 100 for k in range(fine)]
    middle = [0.01 + k * 0.98 / fine for k in range(fine)]
    high = [0.99 + k / fine / 100 for k in range(fine + 1)]
    return low + middle + high


def roc(rows: DataFrame, cutoffs: list[float], score: str, positive: Column) -> DataFrame:
    """cutoff, counts and rates; the least cutoff is put at (1, 1). Rows meet a short list of cutoffs, aggregated before the shuffle."""
    each = rows.select(F.col(score).alias("score"), positive.alias("positive")).where("score is not null and positive is not null")
    met = each.withColumn("cutoff", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs])))
    counts = met.groupBy("cutoff").agg(*[c.alias(k) for k, c in confusion(F.col("score"), F.col("positive"), F.col("cutoff")).items()])
    first = F.col("cutoff") == min(cutoffs)
    out = rates(counts)
    return out.withColumns({c: F.when(first, 1.0).otherwise(F.col(c)) for c in ("tpr", "fpr")})


def significant_cutoff(curve: DataFrame, most_fpr: float) -> DataFrame:
    return curve.where((F.col("fpr") <= most_fpr) & (F.col("tpr") > 0)).agg(F.min("cutoff").alias("cutoff"))


def bootstrapped_roc(rows: DataFrame, cutoffs: list[float], draws: int, per_class: int, seed: int = 0, p_value: str = "p_val") -> DataFrame:
    """cutoff, mean_tpr, mean_fpr over draws of `per_class` variants of each label, counted by variant.

    Rows: variant_id, positive, p_val, variant_id_N. A variant is called if a row's p-value is below the cutoff over
    the variant's rows. A variant's smallest p-value times its rows decides, so draws join one row a variant.
    """
    best = rows.groupBy("variant_id").agg(F.bool_or("positive").alias("positive"), F.min(F.col(p_value) * F.col("variant_id_N")).alias("p"))
    spark = rows.sparkSession
    numbered = best.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    numbered = numbered.withColumn("h", hashed_number(1 << 28, seed, F.col("draw"), F.col("variant_id")))
    drawn = least_of_each(numbered, ["draw", "positive"], F.shiftright("h", 16), [F.col("h"), F.col("variant_id")], F.lit(per_class))
    met = drawn.join(F.broadcast(cutoff_table(spark, cutoffs)))  # a short list
    called = F.coalesce(F.col("p") < F.col("cutoff"), F.lit(False))
    each = met.groupBy("draw", "cutoff").agg(
        F.avg(F.when(F.col("positive"), called.cast("double"))).alias("tpr"), F.avg(F.when(~F.col("positive"), called.cast("double"))).alias("fpr")
    )
    return each.groupBy("cutoff").agg(F.avg("tpr").alias("mean_tpr"), F.avg("fpr").alias("mean_fpr"))


def chosen_cutoff(curve: DataFrame, most_fpr: float = 0.05) -> DataFrame:
    return curve.where((F.col("mean_fpr") > 0) & (F.col("mean_fpr") < most_fpr)).agg(F.max("cutoff").alias("cutoff"))


def mixture_evaluation(rows: DataFrame, size: int, cutoff: float, seed: int = 0, steps: int = 10, zero_for_none: bool = False) -> DataFrame:
    """ratio, share_called, fpr, fnr, acc for mixtures of positives and negatives from 0 to 1.

    Undefined rates (no row of a class) are null, or 0 if asked.
    """
    best = rows.groupBy("variant_id").agg(F.bool_or("positive").alias("positive"), F.min(F.col("p_val") * F.col("variant_id_N")).alias("p"))
    each = best.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    each = each.withColumn("h", hashed_number(1 << 28, seed, F.col("step"), F.col("variant_id")))
    wanted = F.round(F.when(F.col("positive"), F.col("step")).otherwise(steps - F.col("step")) * size / steps)
    drawn = least_of_each(each, ["step", "positive"], F.shiftright("h", 16), [F.col("h"), F.col("variant_id")], wanted)
    called = F.coalesce(F.col("p") < cutoff, F.lit(False))
    good = F.col("positive")
    none = F.lit(0.0) if zero_for_none else F.lit(None).cast("double")
    return drawn.groupBy((F.col("step") / steps).alias("ratio")).agg(
        F.avg(called.cast("double")).alias("share_called"),
        F.coalesce(F.avg(F.when(~good, called.cast("double"))), none).alias("fpr"),
        F.coalesce(F.avg(F.when(good, (~called).cast("double"))), none).alias("fnr"),
        F.avg((called == good).cast("double")).alias("acc"),
    )


def pattern_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """only_a, only_b, both and the share of shared variants whose patterns agree (equal, inside each other, or reversed)."""
    met = a.select("variant_id", F.col("pattern").alias("x")).join(b.select("variant_id", F.col("pattern").alias("y")), "variant_id", "full")
    same = F.contains("x", F.col("y")) | F.contains("y", F.col("x")) | (F.reverse("x") == F.col("y"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return met.agg(
        F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"), F.count_if(both).alias("both"), F.avg(F.when(both, same.cast("double"))).alias("matched")
    )


def proportions(rows: DataFrame, mechanism: str, likelihood: str, p_value: str, cutoff: float) -> DataFrame:
    """A mechanism's share of variants by pattern count, by likelihood sum and by the corrected cutoff."""
    each = rows.groupBy("variant_id").agg(F.max(F.coalesce(likelihood, F.lit(0.0))).alias("lk"), F.min(F.col(p_value) * F.col("variant_id_N")).alias("p"))
    return each.agg(
        F.lit(mechanism).alias("mechanism"), F.avg((F.col("lk") > 0).cast("double")).alias("by_count"), F.avg("lk").alias("by_likelihood"), F.avg(F.coalesce(F.col("p") < cutoff, F.lit(False)).cast("double")).alias("by_cutoff")
    )
