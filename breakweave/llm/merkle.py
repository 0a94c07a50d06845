"""Merkle manifest of a dataset by nested-interval labels.

Rows are the leaves of one tree a group. Every node carries the interval of leaf ranks that it covers, so that
ancestry is containment and nothing follows pointers. A level is built by bucketing intervals by their first rank:
the nodes of a bucket of the next width are the children of one parent. Going down again, a join of each level's
runs with the intervals a level above that contain them attaches the ancestors' steps; within a run, the parent's
interval less a child's own leaves the siblings. The groups' roots are the leaves of one tree more.

Levels shrink by the fan-out, a bucket never holds more nodes than that, and ranks come from range partitions, so
neither a large group nor many groups load one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakweave.llm.common import hot_join, materialise
from breakweave.llm.ranking import ranked

#: Groups up to which roots and the steps above them are broadcast, some kB each; beyond, groups are dealt over so many tasks.
BROADCAST_GROUPS = 2_000
GROUP_SALTS = 64
STEPS = "array<struct<level: int, left: binary, right: binary>>"


def field(value: Column) -> Column:
    """A value as it is hashed: `-` for null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """The digest of a row's values, binary."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def as_text(digests: Column) -> Column:
    """Binary digests, one or more in a row, as lower-case text."""
    return F.lower(F.hex(digests))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's digest and the steps above it lead to, binary."""
    return F.aggregate(steps, leaf, lambda low, s: F.unhex(F.sha2(F.concat(as_text(s["left"]), as_text(low), as_text(s["right"])), 256)))


def proof_text(steps: Column) -> Column:
    """All siblings' digests, from the leaf's up to the root's, left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(as_text(s["left"]), as_text(s["right"]))), "")


@dataclass
class Forest:
    """Trees over ranked leaves. runs[k]: tree, lo, hi, digest, n_above, kids - the level-k children of a level-k+1 node, whose level has n_above nodes."""

    leaves: DataFrame
    runs: list[DataFrame]
    fan: int

    def nodes(self) -> DataFrame:
        """tree, level, lo, hi, digest for all nodes: each covers the leaf ranks lo to hi - 1."""
        out = self.leaves.select("tree", F.lit(0).alias("level"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest")
        for k, runs in enumerate(self.runs):
            out = out.unionByName(runs.select("tree", F.lit(k + 1).alias("level"), "lo", "hi", "digest"))
        return out

    def roots(self) -> DataFrame:
        """tree, digest: one row a tree."""
        out = self.leaves.where("total = 1").select("tree", "digest")
        for runs in self.runs:
            out = out.unionByName(runs.where("n_above = 1").select("tree", "digest"))
        return out

    def steps(self) -> DataFrame:
        """tree, load, digest, steps a leaf: its siblings and those of its ancestors, lowest first."""
        above = None
        for k in range(len(self.runs) - 1, -1, -1):
            runs = self.runs[k].withColumn("bucket", _bucket(F.col("lo"), self.fan ** (k + 1)))
            if above is None:
                met = runs.withColumn("steps", F.lit(None).cast(STEPS))
            else:
                # A run lies within its parent's interval: same bucket at this width, and contained.
                up = above.select(F.col("tree").alias("up_tree"), F.col("bucket").alias("up_bucket"), F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"), "steps")
                within = (F.col("tree") == F.col("up_tree")) & (F.col("bucket") == F.col("up_bucket")) & (F.col("up_lo") <= F.col("lo")) & (F.col("hi") <= F.col("up_hi"))
                met = runs.join(up, within, "left")
            kid = met.select("tree", "kids", F.coalesce("steps", F.array().cast(STEPS)).alias("steps"), F.explode("kids").alias("kid"))
            beside = lambda keep: F.unhex(F.array_join(F.transform(F.filter("kids", keep), lambda x: F.hex(x["digest"])), ""))
            own = F.struct(F.lit(k).alias("level"), beside(lambda x: x["hi"] <= F.col("kid.lo")).alias("left"), beside(lambda x: x["lo"] >= F.col("kid.hi")).alias("right"))
            above = kid.select("tree", "kid.*", F.concat(F.array(own), "steps").alias("steps")).withColumn("bucket", _bucket(F.col("lo"), self.fan**k))
        alone = self.leaves.where("total = 1").select("tree", "load", "digest", F.array().cast(STEPS).alias("steps"))
        return alone if above is None else above.select("tree", "load", "digest", "steps").unionByName(alone)


def _bucket(lo: Column, width: int) -> Column:
    """The first rank of the interval of `width` ranks that `lo` is in."""
    return lo - lo % F.lit(width)


def forest(leaves: DataFrame, fan: int, tag: str) -> Forest:
    """Trees over `leaves` (tree, rank, total, digest, load), level by level; each level is written once and read for the next one."""
    spark, runs = leaves.sparkSession, []
    most = leaves.agg(F.max("total")).first()[0] or 0
    level = leaves.select("tree", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", F.col("total").alias("n"), "load")
    width = 1
    while width < most:
        width *= fan
        kid = F.struct(*[c for c in ("lo", "hi", "digest", "load") if c in level.columns])
        bucket = _bucket(F.col("lo"), width)
        run = level.where("n > 1").groupBy("tree", bucket.alias("bucket")).agg(F.sort_array(F.collect_list(kid)).alias("kids"), F.first("n").alias("n"))
        joined = F.array_join(F.transform("kids", lambda k: as_text(k["digest"])), "")
        above = F.ceil(F.col("n") / F.lit(fan)).cast("long")
        built = run.select("tree", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), F.unhex(F.sha2(joined, 256)).alias("digest"), above.alias("n_above"), "kids")
        runs.append(materialise(built, spark, f"{tag}-level-{len(runs)}"))
        level = runs[-1].select("tree", "lo", "hi", "digest", F.col("n_above").alias("n"))
    return Forest(leaves, runs, fan)


@dataclass
class Manifest:
    """A dataset's trees: one over each group's rows, one over the groups' roots."""

    groups: Forest
    top: Forest

    def proofs(self) -> DataFrame:
        """tree, load, leaf, subroot, root (binary) and steps (lowest first, through the group's root to the top) a row of the dataset."""
        tops = self.top.steps().select(F.col("load.group").alias("tree"), F.col("digest").alias("subroot"), F.col("steps").alias("top_steps"))
        root = self.top.roots().first()  # one row, none if the dataset is empty
        tops = tops.withColumn("root", F.lit(bytes(root["digest"]) if root else None).cast("binary"))
        joined = hot_join(self.groups.steps().withColumnRenamed("digest", "leaf"), tops, ["tree"], limit=BROADCAST_GROUPS, salts=GROUP_SALTS)
        return joined.select("tree", "load", "leaf", "subroot", "root", F.concat("steps", "top_steps").alias("steps"))


def manifest(rows: DataFrame, group: Column, order: Column, leaf: Column, load: dict[str, Column], fan: int = 3) -> Manifest:
    """Trees over all `rows`: leaves of a group ascend by `order`, groups by `group` (null first, then by UTF-8 bytes).

    `leaf` is a row's digest (binary), `load` holds columns that travel with it, or else its order does. Null orders come first; rows of equal
    order ascend by their digests, and rows that repeat each other are leaves of their own. A group of one row is its
    own root. An empty table has no node. Columns of `rows` that nothing names stay unread.
    """
    spark = rows.sparkSession
    tree = F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), group.cast("string")))
    picked = rows.select(tree.alias("tree"), order.alias("_order"), leaf.alias("digest"), F.struct(*[c.alias(n) for n, c in (load or {"order": order}).items()]).alias("load"))
    leaves = ranked(materialise(picked, spark, "merkle-leaves"), "tree", ["_order", "digest"], "merkle")
    groups = forest(leaves.drop("_order"), fan, "merkle")
    tops = groups.roots().select(F.lit("").alias("tree"), F.col("tree").alias("_order"), "digest", F.struct(F.col("tree").alias("group")).alias("load"))
    top = forest(ranked(materialise(tops, spark, "merkle-groups"), "tree", ["_order"], "merkle-top").drop("_order"), fan, "merkle-top")
    return Manifest(groups, top)


#: The fields of a documents row, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def verified_documents(docs: DataFrame, tampered: Column, altered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, steps, folded (binary), a row a document, folded from the tampered text where `tampered`.

    `altered` is the text that a tampered row is found with. Null fields are hashed as such, null ids come first and
    count as untouched; of documents that repeat each other each is a leaf; an empty table gives no rows.
    """
    changed = [altered if c == "text" else F.col(c) for c in FIELDS]
    load = {"doc_id": F.col("doc_id"), "altered": F.when(tampered & ~altered.eqNullSafe(F.col("text")), leaf_digest(*changed))}
    proofs = manifest(docs, F.col("source"), F.col("doc_id"), leaf_digest(*map(F.col, FIELDS)), load).proofs()
    out = proofs.select("load.doc_id", "leaf", "subroot", "root", "steps", F.coalesce("load.altered", "leaf").alias("found"))
    return out.select("doc_id", "leaf", "subroot", "root", "steps", fold(F.col("found"), F.col("steps")).alias("folded"))
