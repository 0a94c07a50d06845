"""Connected components of a link table by alternating large and small stars, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakweave.llm.common import ensure_checkpoint_dir

#: Rounds grow with the logarithm of the longest path; far more than any table needs.
MOST_ROUNDS = 60
#: Links up to which a round runs in one task, without shuffles; more links are dealt out as usual.
ONE_TASK = 20_000


def _star(links: DataFrame, large: bool, few: bool) -> DataFrame:
    """One step: nodes point their larger (large) or smaller (small) neighbours at the least node they know."""
    if large:
        seen = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    seen = seen.coalesce(1) if few else seen
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = seen.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return (out.coalesce(1) if few else out).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of `links` (a, b: long): root is the least node of its component.

    Links to itself and repeated links don't matter; rows with a null end are no links; no links give no rows.
    Each round ends in a checkpoint, so lineage stays short and a lost executor costs one round at most.
    """
    ensure_checkpoint_dir(links.sparkSession)
    now = links.where("a is not null and b is not null and a <> b").select("a", "b").distinct().checkpoint()
    mark = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (state["n"], state["x"]) == mark or not state["n"]:
            break
        mark = (state["n"], state["x"])
        few = state["n"] <= ONE_TASK
        now = _star(_star(now, True, few), False, few).checkpoint()
    else:
        raise RuntimeError("components did not settle")
    pointed = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pointed.unionByName(pointed.select(F.col("root").alias("node"), "root").distinct())
