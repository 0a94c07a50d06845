"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the mixture over its share of the corpus. Each row's count
is the Poisson quantile at a uniform number hashed from seed and row, the row is exploded by its count, and the
copies are dealt to partitions and sorted by another hash: a global shuffle that comes out the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources up to which the table of rates is broadcast; it has one row of two numbers a source.
BROADCAST_SOURCES = 10_000
#: Above this mean the count is split into independent Poisson parts of at most this mean each.
LARGEST_MEAN = 16.0
#: Terms of one part's distribution; at a mean of 16 the rest of the mass is below 1e-17.
TERMS = 80


def uniform(*parts: Column | str) -> Column:
    """A uniform number in [0, 1) with 52 bits, hashed from the parts."""
    cast = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("~")) for p in parts]
    digest = F.md5(F.concat_ws("|", *cast))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def distribution(mean: Column) -> Column:
    """The Poisson distribution function at 0, 1, ... as an array, as far as it stays below 1, for a mean of at most LARGEST_MEAN."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["p"] * mean / k
        c = acc["c"] + term
        # Sums that no longer grow can't tell more counts apart.
        return F.struct(term.alias("p"), c.alias("c"), F.when(c > acc["c"], F.concat(acc["all"], F.array(c))).otherwise(acc["all"]).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda acc: acc["all"])


def poisson_count(u: Column, sums: Column) -> Column:
    """The least k whose distribution function exceeds u: Poisson inversion."""
    return F.size(F.filter(sums, lambda c: c <= u))


def rates(docs: DataFrame, weights: dict[str, float] | None, alpha: float, source: str, size: Column) -> tuple[DataFrame, bool]:
    """mix_source, mix_rate, mix_parts, mix_sums: the mean number of copies of a source's rows and its distribution; the mixture keeps the corpus's size.

    `weights` are target shares by source; sources it leaves out get none. Without it a source's share is its size
    to the power alpha, as usual for flattening a mixture. The second result tells whether there are so few
    sources that the rates can be broadcast.
    """
    spark = docs.sparkSession
    by = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("mix_source")).agg(F.sum(size).cast("double").alias("mix_size"))
    first = by.limit(BROADCAST_SOURCES + 1).collect()
    if few := len(first) <= BROADCAST_SOURCES:
        by = spark.createDataFrame(first, by.schema).coalesce(1)
    if weights is None:
        wanted = by.withColumn("mix_weight", F.pow("mix_size", F.lit(alpha)))
    else:
        pairs = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))])
        wanted = by.withColumn("mix_weight", F.coalesce(pairs[F.col("mix_source")], F.lit(0.0)))
    # One row: sums over the sources that have rows to repeat.
    total = wanted.where("mix_size > 0").agg(F.sum("mix_weight").alias("all_weight"), F.sum("mix_size").alias("all_size"))
    rate = F.when(
        (F.col("mix_size") > 0) & (F.col("all_weight") > 0), F.col("mix_weight") / F.col("all_weight") * F.col("all_size") / F.col("mix_size")
    ).otherwise(0.0)
    # The total is one row; a source's distribution is worked out once, not for every row.
    rated = wanted.join(F.broadcast(total)).select("mix_source", rate.alias("mix_rate"))
    # Poisson(a + b) = Poisson(a) + Poisson(b): a large mean is split into equal parts with their own uniforms.
    rated = rated.withColumn("mix_parts", F.greatest(F.ceil(F.col("mix_rate") / LARGEST_MEAN), F.lit(1)).cast("long"))
    return rated.withColumn("mix_sums", distribution(F.col("mix_rate") / F.col("mix_parts"))), few


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    seed: int = 42,
    source: str = "source",
    key: str = "doc_id",
    shuffle: bool = True,
) -> DataFrame:
    """Replicate rows so that sources reach their target shares, then shuffle the copies globally.

    Adds mix_rate, mix_copy (0 for a row's first copy) and mix_order, the shuffle's sort key; columns of these names
    in the input are replaced, all others pass through unread, whatever their names. Sizes are characters of text; a
    null source is the source ''. Null texts have size 0. A row's count hangs on its key, or on its text where the
    key is null: rows with the same key share their count, and so do rows without key that have the same text. An
    empty table stays empty.
    """
    plain = docs.drop("mix_rate", "mix_copy", "mix_order")
    others = F.struct(*[F.col(f"`{c}`") for c in plain.columns])
    named = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    held = plain.select(
        F.coalesce(F.col(source), F.lit("")).alias("mix_source"), F.coalesce(F.length("text"), F.lit(0)).alias("mix_length"), named.alias("mix_key"), others.alias("mix_row")
    )
    by_source, few = rates(held, weights, alpha, "mix_source", F.col("mix_length"))
    rated = held.drop("mix_length").join(F.broadcast(by_source) if few else by_source, "mix_source")
    count = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.col("mix_parts")),
        F.lit(0),
        lambda acc, k: acc + poisson_count(uniform(F.lit(seed), F.col("mix_key"), k), F.col("mix_sums")),
    )
    copies = (
        rated.withColumn("mix_count", F.when(F.col("mix_rate") > 0, count).otherwise(0))
        .where("mix_count > 0")
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_count") - 1)))
        .withColumn("mix_order", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), "mix_key", "mix_copy")))
        .select("mix_row.*", "mix_rate", "mix_copy", "mix_order")
    )
    # mix_order is uniform: dealing the copies by its hash and sorting each part by it is a global shuffle.
    return copies.repartition("mix_order").sortWithinPartitions("mix_order", "mix_copy") if shuffle else copies
