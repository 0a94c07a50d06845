"""URL filter: rules by host and path, and link-graph propagation for what no rule covers.

Hosts are nodes, links between pages of different hosts are weighted edges. Trust is a personalised PageRank from
the hosts of allowed pages along the links; distrust is one from the hosts of blocked pages along the reversed
links. A page that no rule covers is blocked if its host's share of distrust reaches the threshold.
Everything runs as DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakweave.llm.common import ensure_checkpoint_dir, hot_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Scheme, host and path, as far as the host; both engines know this form.
URL = r"://([^/?#]*)([^?#]*)"
#: Absolute and protocol-relative links; relative ones stay on their host and carry nothing over.
LINKED = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)"""


def lowered(column: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(column, UPPER, LOWER)


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """Adds host and path; both are empty where the url is null or has no `://`."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.withColumn("host", lowered(F.regexp_extract(url, URL, 1))).withColumn("path", F.regexp_extract(url, URL, 2))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: of each host that has any, its rules from the longest to the shortest.

    A host of n labels looks up its n suffixes, so the join is an equality on hosts.
    """
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    looked_up = hosts.where("host <> ''").select("host", F.explode(suffix).alias("rule_host"))
    fits = looked_up.join(rules, "rule_host")
    text = F.concat("rule_host", "rule_path")
    one = F.struct((-F.length(text)).alias("order"), text.alias("rule"), F.col("rule_path"), F.col("rule_verdict"))
    return fits.groupBy("host").agg(F.sort_array(F.collect_set(one)).alias("rules"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int, damping: float) -> DataFrame:
    """host, rank: personalised PageRank after `rounds` rounds; what seeds and dangling hosts don't pass on returns to the seeds.

    edges: src, dst, p with the p of a src adding up to 1. seeds: host, rank adding up to 1 (or none: no ranks).
    """
    rank = seeds
    for _ in range(rounds):
        moved = (
            hot_join(edges, rank.withColumnRenamed("host", "src"), ["src"])
            .groupBy("dst")
            .agg((F.sum(F.col("rank") * F.col("p")) * damping).alias("rank"))
            .select(F.col("dst").alias("host"), "rank")
            .checkpoint()
        )
        passed = moved.agg(F.sum("rank").alias("s")).first()["s"]  # one number
        if passed is None:
            return rank
        back = seeds.select("host", (F.col("rank") * (1.0 - passed)).alias("rank"))
        rank = back.unionByName(moved).groupBy("host").agg(F.sum("rank").alias("rank")).checkpoint()
    return rank


def normalised(edges: DataFrame) -> DataFrame:
    """src, dst, p: each host's links as shares."""
    total = edges.groupBy("src").agg(F.sum("w").alias("all_w"))
    return hot_join(edges, total, ["src"]).select("src", "dst", (F.col("w") / F.col("all_w")).alias("p")).checkpoint()


def judge_pages(pages: DataFrame, rules: DataFrame, rounds: int = 10, damping: float = 0.85, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    rules: rule_host, rule_path, rule_verdict (allow or block). A rule fits its host and all subdomains, if the
    path starts with the rule's; the longest wins. Pages without rule: block if distrust / (trust + distrust) of
    the host is at least `threshold`, else allow; hosts that neither reaches are allowed, as are empty hosts.
    Null urls and html count as empty, repeated rows and ids are judged row by row, an empty table gives an empty
    result, other columns are not read.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    read = with_host_and_path(pages.select(F.col("page_id").cast("long"), "url", "html"))
    placed = read.select("page_id", "host", "path")
    by_host = host_rules(placed.select("host").distinct(), rules).checkpoint()
    first = F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    ruled = hot_join(placed, by_host, ["host"], "left").withColumn("fit", F.get(first, F.lit(0)))
    ruled = ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.rule_verdict").alias("ruled")).checkpoint()

    links = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINKED), 1), lowered))
    edges = (
        read.select(F.col("host").alias("src"), F.explode(links).alias("dst"))
        .where("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
        .checkpoint()
    )

    counted = ruled.where("ruled is not null and host <> ''").groupBy("host").agg(
        F.count_if(F.col("ruled") == "allow").cast("double").alias("allowed"), F.count_if(F.col("ruled") == "block").cast("double").alias("blocked")
    )
    total = counted.agg(F.sum("allowed").alias("all_allowed"), F.sum("blocked").alias("all_blocked"))
    seeds = counted.join(F.broadcast(total)).checkpoint()  # total is one row
    trusted = seeds.where("allowed > 0").select("host", (F.col("allowed") / F.col("all_allowed")).alias("rank"))
    blocked = seeds.where("blocked > 0").select("host", (F.col("blocked") / F.col("all_blocked")).alias("rank"))
    trust, distrust = trusted, blocked
    if edges.limit(1).count():
        trust = propagate(normalised(edges), trusted, rounds, damping)
        reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        distrust = propagate(normalised(reverse), blocked, rounds, damping)
    both = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(
        distrust.select("host", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust"))
    )
    host = both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    bad = host.where(F.col("distrust") > 0).where(F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust"))).select("host", F.lit("block").alias("found")).checkpoint()
    return hot_join(ruled, bad, ["host"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "found", F.lit("allow")).alias("verdict")
    )
