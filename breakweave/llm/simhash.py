"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints within `radius` bits share all bits of at least one of 2^(radius+1) - 1 structured masks: bit
position i carries a vector m(i) of radius + 1 bits, and mask v keeps the bits with odd <m(i), v>. For any set of
at most `radius` differing bits some v is orthogonal to all their vectors, and that mask hides the difference.

Distinct fingerprints are dealt to one bucket a mask. A task verifies a bucket's distances block by block and
returns one link a member, to the least fingerprint it is connected with in there. A bucket above `bucket` members
is not held: its members go to the exact way for crowded buckets, where each fingerprint names all points within
half the radius of it. Two fingerprints are within the radius exactly if they share a point, and a point has a
bounded number of fingerprints around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breakweave.llm.common import bounded_batches, hot_join, materialise
from breakweave.llm.components import components

BITS = 64
SEED = 42
#: Shingles whose bits are summed at once.
BLOCK = 1 << 15
#: Members of a bucket that a task compares with each other.
BUCKET = 4096


def fingerprint(text: str | None, words: int = 4) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    k = min(words, len(found))
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    a, b = starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(a), BLOCK):
        part = zip(a[at : at + BLOCK], b[at : at + BLOCK], strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in part], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(a), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row."""
    bounded_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(text, words) for text in batch.column("text").to_pylist()], np.uint64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(made.view(np.int64))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(hashed, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """The masks, each with about half of the bits."""
    size = 1 << (radius + 1)
    vector = [1 + i % (size - 1) for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() & 1) for v in range(1, size)]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def close_roots(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the least one that it is connected with by steps of at most `radius` bits."""
    order = np.sort(fps)
    bits = order.view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
    root = np.arange(len(order))
    rows = max(1, (1 << 22) // len(order))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in range(0, len(order), rows):
        near = np.bitwise_count(bits[at : at + rows, None] ^ bits[None, :]) <= radius
        least = near.argmax(1)  # of each row the first neighbour; others are joined through it
        for i, j in enumerate(least.tolist()):
            a, b = top(at + i), top(j)
            root[max(a, b)] = min(a, b)
        # Members whose first neighbours differ can still be neighbours of each other.
        firsts = np.array([top(i) for i in range(len(order))])
        for i, j in zip(*np.nonzero(near & (firsts[at : at + len(near), None] != firsts[None, :])), strict=True):
            a, b = top(at + int(i)), top(int(j))
            root[max(a, b)] = min(a, b)
    return np.stack([order, order[[top(i) for i in range(len(order))]]])


def bucket_links(distinct: DataFrame, radius: int, bucket: int) -> DataFrame:
    """a, b, mask: links of fingerprints, or with a mask number a member of a crowded bucket."""
    masks = covering_masks(radius)
    keys = F.array(*[F.struct(F.lit(n).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for n, m in enumerate(masks)])
    dealt = distinct.select("fp", F.explode(keys).alias("k")).select("k.mask", "k.key", "fp")
    dealt = dealt.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, crowded = [], None, False

        def rows(a: np.ndarray, b: np.ndarray, mask: int | None) -> pa.RecordBatch:
            marks = pa.nulls(len(a), pa.int32()) if mask is None else pa.array(np.full(len(a), mask, np.int32))
            return pa.record_batch({"a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64)), "mask": marks})

        def close() -> Iterator[pa.RecordBatch]:
            fps = np.concatenate(held) if held else np.empty(0, np.int64)
            if crowded:
                if len(fps):
                    yield rows(fps, fps, last[0])
            elif len(fps) > 1:
                found, root = close_roots(fps, radius)
                if (linked := found != root).any():
                    yield rows(found[linked], root[linked], None)

        for batch in batches:
            mask, key, fp = (batch.column(k).to_numpy() for k in range(3))
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            cuts = [0, *new.tolist(), len(fp)]
            singles = np.diff(cuts) == 1
            for n, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if s == e or (singles[n] and 0 < n < len(singles) - 1):
                    if n and held:
                        yield from close()
                        held, last, crowded = [], None, False
                    continue
                if (bucket_key := (int(mask[s]), int(key[s]))) != last:
                    yield from close()
                    held, last, crowded = [], bucket_key, False
                held.append(fp[s:e])
                if crowded or sum(map(len, held)) > bucket:
                    crowded = True
                    yield from close()
                    held = []
        yield from close()

    return dealt.mapInArrow(verify, "a long, b long, mask int")


def crowded_links(members: DataFrame, radius: int) -> DataFrame:
    """a, b: links among the members (fp, mask) of crowded buckets, through the points that they share."""
    masks = covering_masks(radius)
    half = radius // 2
    balls = []
    for m in masks:
        free = [i for i in range(BITS) if not m >> i & 1]
        balls.append(np.array([sum(1 << i for i in c) for k in range(half + 1) for c in combinations(free, k)], np.uint64))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, mask in zip(batch.column("fp").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                around = (np.uint64(fp & (1 << BITS) - 1) ^ balls[mask]).view(np.int64)
                yield pa.record_batch({"fp": pa.array(np.full(len(around), fp, np.int64)), "point": pa.array(around)})

    near = members.select("fp", "mask").mapInArrow(points, "fp long, point long").distinct()
    if radius % 2:
        raise ValueError("the crowded way takes an even radius")
    # A point has at most as many fingerprints around it as a ball has points.
    least = near.withColumn("b", F.min("fp").over(Window.partitionBy("point")))
    return least.where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id that links lead to.

    Texts without words (null, empty, blank) have fingerprint zero and link like any other. Equal fingerprints
    link at distance 0. Rows that repeat a doc_id each return; a null doc_id is never the least of a component,
    and a component of nothing else has a null id. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    each = materialise(fingerprints(docs, words), spark, "fingerprints")
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    found = materialise(bucket_links(distinct.select("fp"), radius, bucket), spark, "links")
    links = found.where("mask is null").select("a", "b")
    crowded = found.where("mask is not null").select(F.col("a").alias("fp"), "mask")
    if crowded.limit(1).count():
        links = links.unionByName(crowded_links(crowded, radius))
    roots = components(links)
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, spark, "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = materialise(hot_join(rooted, least, ["root"]).select("fp", "component_id"), spark, "labels")
    return hot_join(each, labels, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
