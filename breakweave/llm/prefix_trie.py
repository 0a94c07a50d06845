"""Prefix trie of conversations, from ternary search trees over range shards.

Turns are dictionary-encoded, so that a conversation is a sequence of numbers. Sequences are cut into segments of a
fixed number of turns; a segment's trie hangs below the node that the turns before it lead to. Equal segments under
one node are one item with a count. Items are dealt to shards by ranges of their order; a shard inserts its items,
medians first, into one ternary search tree for each node that segments hang from, and walks it without recursion to
add up members, leaves and savings. What lies wholly inside a shard is final. Boundary nodes - those that an edge of
a shard, another segment or another shard's part can add to - are merged by their keys, and sums run up the merged
nodes by pointer doubling, in as many rounds as the longest chain has digits.

A node's key is its depth and two exclusive-or sums of hashes of (position, turn): 128 bits, the same in all shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breakweave.llm.common import bounded_batches, hot_join, materialise, release
from breakweave.llm.ranking import ranked

#: Turns in a segment, different segments in a shard (about), ids in a piece of a node's list of ends.
SEGMENT = 64
SHARD_ITEMS = 8192
PIECE = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@dataclass
class Trie:
    """nodes: see `prefix_trie`. dictionary: turn_id, role, text, points, digest (a row a different turn)."""

    nodes: DataFrame
    dictionary: DataFrame


def turn_digest(role: Column, text: Column) -> Column:
    """What tells turns apart: sha256 of the role's length, a colon, the role and the text."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def encoded(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """conv_id, pos (from 0), turn_id, points a turn, and the dictionary of all turns.

    Turns ascend by number, null first; turns that share one, by their digests; repeated rows are turns of their own.
    Null roles and texts are empty. Rows without a conversation belong to none.
    """
    spark = rows.sparkSession
    picked = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = picked.select("role", "text").distinct().withColumn("turn_id", F.monotonically_increasing_id())
    dictionary = materialise(known.select("turn_id", "role", "text", F.length("text").cast("long").alias("points"), turn_digest(F.col("role"), F.col("text")).alias("digest")), spark, "trie-dictionary")
    short = materialise(picked.select("conv_id", "turn", turn_digest(F.col("role"), F.col("text")).alias("digest")), spark, "trie-turns")
    placed = ranked(short, "conv_id", ["turn", "digest"], "trie")
    turns = placed.join(dictionary.select("digest", "turn_id", "points"), "digest").select("conv_id", F.col("rank").alias("pos"), "turn_id", "points")
    out = materialise(turns, spark, "trie-encoded")
    release(short, placed)
    return out, dictionary


def rebuilt(turns: DataFrame, every: int = 100, kinds: int = 6) -> tuple[DataFrame, DataFrame]:
    """Sequences that begin with turns of a conversation they share, and the ids of all conversations, even without turns.

    Conversation c takes the first h turns of conversation c - c % every (all if there are fewer, none if it is absent)
    and its own after its first h, where h is crc32(c) % kinds.
    """
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < kinds - 1)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn_id", "points"))).alias("head"))
    convs = turns.where("pos = 0").select("conv_id", (F.crc32(F.col("conv_id").cast("string")) % kinds).alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    begun = convs.join(heads, "base", "left").select("conv_id", "h", F.coalesce(F.slice("head", 1, F.col("h").cast("int")), F.array()).alias("head"))
    begun = materialise(begun, turns.sparkSession, "trie-begun")
    first = begun.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.turn_id", "t.points")
    own = turns.join(begun.select("conv_id", "h", F.size("head").alias("n")), "conv_id").where("pos >= h")
    return first.unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "turn_id", "points")), begun.select("conv_id")


def _segments(sequences: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, segment, k1, k2 (key of the node it hangs from), ids, points, last, e1, e2 (key of its end)."""
    cut = sequences.withColumn("segment", F.floor(F.col("pos") / SEGMENT)).groupBy("conv_id", "segment").agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn_id", "points"))).alias("turns"),
        F.bit_xor(_mixed(1)).alias("x1"),
        F.bit_xor(_mixed(2)).alias("x2"),
    )
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    above = lambda x: F.coalesce(F.bit_xor(x).over(before), F.lit(0).cast("long"))
    keyed = cut.withColumns({"k1": above("x1"), "k2": above("x2"), "last": F.lead("segment").over(Window.partitionBy("conv_id").orderBy("segment")).isNull()})
    out = keyed.select("conv_id", "segment", "k1", "k2", F.transform("turns", lambda t: t["turn_id"]).alias("ids"), F.transform("turns", lambda t: t["points"]).alias("points"), "last", F.col("k1").bitwiseXOR(F.col("x1")).alias("e1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("e2"))
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<long>")
    without = convs.join(sequences.where("pos = 0").select("conv_id"), "conv_id", "left_anti")
    return out.unionByName(without.select("conv_id", zero.alias("segment"), zero.alias("k1"), zero.alias("k2"), none.alias("ids"), none.alias("points"), F.lit(True).alias("last"), zero.alias("e1"), zero.alias("e2")))


def _mixed(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("pos").cast("long"), F.col("turn_id"))


class TernaryTree:
    """Sequences of numbers; node 0 is the empty prefix. A search node's low and high are siblings, its equal is the first child."""

    def __init__(self) -> None:
        self.turn, self.points, self.low, self.equal, self.high = [None], [0], [-1], [-1], [-1]
        self.ended: list[tuple[int, int, bool] | None] = [None]
        self.edge = [True]

    def _new(self, turn: int, points: int) -> int:
        for column, value in ((self.turn, turn), (self.points, points), (self.low, -1), (self.equal, -1), (self.high, -1), (self.ended, None), (self.edge, False)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, turns: list[int], points: list[int], count: int, least: int, open_end: bool, edge: bool) -> None:
        """A sequence that `count` conversations share, `least` their least id; open_end: some of them go on below."""
        at = 0
        for turn, size in zip(turns, points, strict=True):
            came, column = at, self.equal
            now = self.equal[at]
            while now >= 0 and self.turn[now] != turn:
                came, column = now, self.low if turn < self.turn[now] else self.high
                now = column[now]
            if now < 0:
                now = column[came] = self._new(turn, size)
            at = now
            self.edge[at] |= edge
        self.ended[at] = (count, least, open_end)

    def nodes(self) -> list[tuple[int, int, int]]:
        """(node, parent, depth) of all nodes, parents first."""
        found, stack = [(0, -1, 0)], [(self.equal[0], 0, 1)]
        while stack:
            node, parent, depth = stack.pop()
            if node >= 0:
                found.append((node, parent, depth))
                stack += [(self.low[node], parent, depth), (self.high[node], parent, depth), (self.equal[node], node, depth + 1)]
        return found


def medians_first(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every stretch before its halves: the order that keeps a search tree balanced."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            yield (mid := (a + b) // 2)
            stack += [(a, mid), (mid + 1, b)]


KEY = pa.struct([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])
NODE = pa.schema([("node", KEY), ("up", KEY), ("turn_id", pa.int64()), ("points", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("open", pa.bool_()), ("up_least", pa.int64())])
NODE_TYPE = "node struct<depth: long, k1: long, k2: long>, up struct<depth: long, k1: long, k2: long>, turn_id long, points long, n long, least long, n_children long, n_leaves long, saved long, open boolean, up_least long"


def summed(tree: TernaryTree, start: int, hashes: dict[tuple[int, int], tuple[int, int]], k1: int, k2: int) -> list[dict]:
    """The nodes of a tree whose root has depth `start`, as rows of NODE; of an open node, children, leaves and savings count what hangs from closed children only."""
    order = tree.nodes()
    size = len(tree.turn)
    n, least, children, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    is_open, up = list(tree.edge), [-1] * size
    for node, parent, _ in reversed(order):
        if tree.ended[node]:
            count, smallest, goes_on = tree.ended[node]
            n[node] += count
            least[node] = smallest if least[node] is None else min(least[node], smallest)
            is_open[node] |= goes_on
        if not is_open[node]:
            leaves[node] += not children[node]
            saved[node] += (n[node] - 1) * tree.points[node]
        if parent >= 0:
            up[node] = parent
            n[parent] += n[node]
            least[parent] = least[node] if least[parent] is None else min(least[parent], least[node])
            is_open[parent] |= is_open[node]
            if not is_open[node]:
                children[parent] += 1
                leaves[parent] += leaves[node]
                saved[parent] += saved[node]
    keys: list = [None] * size
    rows = []
    for node, parent, depth in order:
        at = start + depth
        if parent < 0:
            keys[node] = {"depth": at, "k1": k1, "k2": k2}
        else:
            a, b = hashes[at - 1, tree.turn[node]]
            keys[node] = {"depth": at, "k1": keys[parent]["k1"] ^ a, "k2": keys[parent]["k2"] ^ b}
        below = parent < 0 and start > 0  # its members are counted where the segment above ends
        rows.append({
            "node": keys[node], "up": None if parent < 0 else keys[parent], "turn_id": tree.turn[node], "points": None if parent < 0 else tree.points[node], "n": 0 if below else n[node], "least": None if below else least[node],
            "n_children": children[node], "n_leaves": leaves[node], "saved": saved[node], "open": is_open[node], "up_least": None if parent < 0 or is_open[parent] else least[parent],
        })
    return rows


def _shard(length: int):
    """One shard's items, in order, to rows of NODE; segments have `length` turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [row for batch in batches for row in batch.to_pylist()]
        at = 0
        while at < len(items):
            key = (items[at]["segment"], items[at]["k1"], items[at]["k2"])
            end = at
            while end < len(items) and (items[end]["segment"], items[end]["k1"], items[end]["k2"]) == key:
                end += 1
            tree, hashes, start = TernaryTree(), {}, key[0] * length
            for k in medians_first(end - at):
                item = items[at + k]
                tree.insert(item["ids"], item["points"], item["n"], item["least"], item["goes_on"], at + k in (0, len(items) - 1))
                for pos, (turn, a, b) in enumerate(zip(item["ids"], item["h1"], item["h2"], strict=True), start):
                    hashes[pos, turn] = (a, b)
            rows = summed(tree, start, hashes, key[1], key[2])
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_pylist(rows[k : k + 4096], NODE)
            at = end

    return run


def _climbed(own: DataFrame) -> DataFrame:
    """node, n_leaves, saved summed over all nodes below, by pointer doubling over `own` (node, up, n_leaves, saved)."""
    spark = own.sparkSession
    now = materialise(own.select("node", F.col("up").alias("jump"), "n_leaves", "saved"), spark, "trie-climb-0")
    for k in range(1, 64):
        if not now.where("jump is not null").limit(1).count():
            return now.drop("jump")
        gained = now.where("jump is not null").groupBy(F.col("jump").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = now.where("jump is not null").select(F.col("node").alias("jump"), F.col("jump").alias("next"))
        # Whoever has reached the root goes no further and needs no join: many do.
        going, still = now.where("jump.depth > 0"), now.where("jump is null or jump.depth = 0").withColumn("jump", F.lit(None).cast("struct<depth: long, k1: long, k2: long>"))
        moved = going.join(further, "jump", "left").select("node", F.col("next").alias("jump"), "n_leaves", "saved").unionByName(still)
        added = moved.join(gained, "node", "left").select("node", "jump", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        now, old = materialise(added, spark, f"trie-climb-{k}"), now
        release(old)
    raise RuntimeError("sums did not reach the root")


def _pieces(most: int):
    """Runs of a node's ids, sorted, as comma-joined texts of at most `most` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", KEY), ("first", pa.int64()), ("text", pa.string())])
        node, ids = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if ids and (row["node"] != node or len(ids) >= most):
                    out.append({"node": node, "first": ids[0], "text": ",".join(map(str, ids))})
                    ids = []
                node = row["node"]
                ids.append(row["conv_id"])
            yield pa.RecordBatch.from_pylist(out, schema)
        if ids:
            yield pa.RecordBatch.from_pylist([{"node": node, "first": ids[0], "text": ",".join(map(str, ids))}], schema)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sha256 of every node's pieces, which come in order; one piece is held at a time."""
    schema = pa.schema([("node", KEY), ("ends_sha256", pa.string())])
    node, state = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if state is not None and row["node"] == node:
                state.update(b",")
            else:
                if state is not None:
                    out.append({"node": node, "ends_sha256": state.hexdigest()})
                node, state = row["node"], hashlib.sha256()
            state.update(row["text"].encode())
        yield pa.RecordBatch.from_pylist(out, schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": state.hexdigest()}], schema)


def _ends(ended: DataFrame) -> DataFrame:
    """node, ends_sha256: of the ids of conversations that end there, ascending. A crowded node's ids are joined where its ranges lie."""
    order = ["node", "conv_id"]
    pieces = ended.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces(PIECE), "node struct<depth: long, k1: long, k2: long>, first long, text string")
    dealt = pieces.repartition("node").sortWithinPartitions("node", "first")
    return dealt.mapInArrow(_hashed, "node struct<depth: long, k1: long, k2: long>, ends_sha256 string")


def prefix_trie(sequences: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of `sequences` (conv_id, pos from 0 without gaps, turn_id, points); `convs` holds every conv_id, also those without turns.

    A row a node: conv_id (least member), depth, parent_conv_id (null at the root), turn_id and points of its last turn
    (null and 0 at the root), n_convs, n_children, n_leaves, saved_tokens (of its subtree), ends_sha256. No conversations
    give no rows. A conversation's segments are numbered in one window, 64 turns a row; its turns are never in one task.
    """
    spark = sequences.sparkSession
    bounded_batches(spark)
    segments = materialise(_segments(sequences, convs), spark, "trie-segments")
    grouped = segments.groupBy("segment", "k1", "k2", "ids").agg(F.first("points").alias("points"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.bool_or(~F.col("last")).alias("goes_on"))
    hashed = lambda seed: F.transform("ids", lambda turn, k: F.xxhash64(F.lit(seed), F.col("segment") * SEGMENT + k.cast("long"), turn))
    items = materialise(grouped.select("*", hashed(1).alias("h1"), hashed(2).alias("h2")), spark, "trie-items")
    order = ["segment", "k1", "k2", "ids"]
    shards = -(-items.count() // SHARD_ITEMS) or 1
    sharded = items.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    parts = materialise(sharded.mapInArrow(_shard(SEGMENT), NODE_TYPE), spark, "trie-parts")
    merged = parts.where("open").groupBy("node").agg(*[F.max(c).alias(c) for c in ("up", "turn_id", "points")], *[F.sum(c).alias(c) for c in ("n", "n_children", "n_leaves", "saved")], F.min("least").alias("least"))
    merged = materialise(merged, spark, "trie-merged")
    kids = merged.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("open_kids"))
    counted = merged.join(kids, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_kids", F.lit(0))).drop("open_kids")
    counted = materialise(counted, spark, "trie-counted")
    own = counted.select("node", "up", (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * F.coalesce("points", F.lit(0))).alias("saved"))
    whole = counted.drop("n_leaves", "saved").join(_climbed(own), "node").withColumn("up_least", F.lit(None).cast("long"))
    columns = ["node", "up", "turn_id", "points", "n", "least", "n_children", "n_leaves", "saved", "up_least"]
    everything = parts.where("not open").select(*columns).unionByName(whole.select(*columns))
    # Below a closed node the parent's least member is known; below a merged one it is looked up.
    told = everything.where("up is null or up_least is not null")
    asked = hot_join(everything.where("up is not null and up_least is null").drop("up_least"), merged.select(F.col("node").alias("up"), F.col("least").alias("up_least")), ["up"])
    ended = segments.where("last").select("conv_id", F.struct((F.col("segment") * SEGMENT + F.size("ids")).alias("depth"), F.col("e1").alias("k1"), F.col("e2").alias("k2")).alias("node"))
    out = told.unionByName(asked.select(*columns)).join(_ends(ended), "node", "left")
    return out.select(
        F.col("least").alias("conv_id"), F.col("node.depth").alias("depth"), F.col("up_least").alias("parent_conv_id"), "turn_id", F.coalesce("points", F.lit(0)).alias("points"),
        F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame, every: int = 100, kinds: int = 6) -> Trie:
    """The trie of rebuilt conversations (see `rebuilt`) and the dictionary of their turns."""
    turns, dictionary = encoded(rows)
    return Trie(prefix_trie(*rebuilt(turns, every, kinds)), dictionary)
