"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors are dealt to blocks by hash. Each block keeps, for every dimension, its vectors in the order of that
component. A query walks all lists of a block in parallel, from the end that its component's sign prefers; every
vector it meets is scored at once (the random access), and the walk stops when the sum of the components it has
reached, each times the query's, falls below the kth best score: nothing that it has not met can reach that score.
The first block of each length gives every query a kth score to begin with, so that the others stop earlier.

Equal vectors are one entry with their least ids only, so a vector that fills a third of the table costs one entry.
Queries come in chunks of bounded size that meet blocks of bounded size; a task holds one of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breakweave.llm.common import bounded_batches, materialise

#: Different vectors in a block and queries in a chunk, about: they are dealt by hash.
BLOCK_ROWS = 4096
CHUNK_ROWS = 512
#: Bytes of packed queries up to which all chunks are broadcast; beyond, blocks and chunks meet in a shuffle.
BROADCAST_BYTES = 8 << 20
#: The share of a block's lists that one step of the walk goes down.
STRIDE = 1 / 32


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) for every component as array<long>; null where the vector is null or has a null or non-finite component."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(F.coalesce(finite, F.lit(False)), whole)


def exact_type(values: np.ndarray, others: np.ndarray) -> type:
    """A type in which every inner product of rows of both, and every sum on the way, is exact: floats are the fastest."""
    most = int(max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0)))))
    most *= int(max(abs(int(others.max(initial=0))), abs(int(others.min(initial=0))))) * max(values.shape[1], 1)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


class Lists:
    """A block: its vectors and, by dimension, their places in ascending order of the component."""

    def __init__(self, vectors: np.ndarray, places: np.ndarray):
        self.vectors, self.places = vectors, places

    def walk(self, query: np.ndarray, need: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all vectors that may be among the `need` best, ties included, given that the needth best of all scores `floor` at least."""
        n = len(self.vectors)
        used = np.flatnonzero(query)  # a component of zero adds nothing: its list tells nothing
        kind = self.vectors.dtype
        scores, met = np.zeros(n, kind), np.zeros(n, bool)
        up = used[query[used] > 0]
        down = used[query[used] < 0]
        step, depth, kth = max(1, int(n * STRIDE)), 0, floor
        while depth < n:
            end = min(n, depth + step)
            new = np.zeros(n, bool)
            new[self.places[n - end : n - depth, up]] = True
            new[self.places[depth:end, down]] = True
            new &= ~met
            if not len(used):
                new[:] = True
            if new.any():
                at = np.flatnonzero(new)
                scores[at] = self.vectors[at] @ query
                met |= new
                known = scores[met]
                if len(known) >= need:
                    place = len(known) - need
                    kth = max(kth, (np.sort(known) if kind == object else np.partition(known, place))[place])
            if met.all():
                break
            depth = end
            edge = self.vectors[self.places[n - end, up], up] @ query[up] + self.vectors[self.places[end - 1, down], down] @ query[down]
            if edge < kth:
                break
        at = np.flatnonzero(met & (scores >= kth))
        return at, scores[at]


def _matrix(column: pa.ChunkedArray | pa.Array, row: int, dims: int) -> np.ndarray:
    return np.frombuffer(column[row].as_py(), "<i8").reshape(-1, dims)


def _sorted_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dims, block, vectors, places, ids: packed blocks of rows (dims, block, entries)."""
    for batch in batches:
        for row in batch.to_pylist():
            vectors = np.array([e["vector"] for e in row["entries"]], "<i8").reshape(len(row["entries"]), row["dims"])
            places = np.argsort(vectors, axis=0, kind="stable").astype("<i4")
            yield pa.RecordBatch.from_pylist([{"dims": row["dims"], "block": row["block"], "vectors": vectors.tobytes(), "places": places.tobytes(), "ids": [e["ids"] for e in row["entries"]]}], LISTS)


LISTS = pa.schema([("dims", pa.int32()), ("block", pa.int64()), ("vectors", pa.binary()), ("places", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))])
FOUND = pa.schema([("query_id", pa.int64()), ("query_hash", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dims = batch["dims"][row].as_py()
                vectors, ids = _matrix(batch["vectors"], row, dims) if dims else np.zeros((len(batch["ids"][row]), 0), "<i8"), batch["ids"][row].as_py()
                asked = batch["asked"][row].as_py()
                queries = np.array([a["vector"] for a in asked], "<i8").reshape(len(asked), dims)
                kind = exact_type(vectors, queries)
                lists = Lists(vectors.astype(kind), np.frombuffer(batch["places"][row].as_py(), "<i4").reshape(len(vectors), dims))
                out: dict[str, list[int]] = {name: [] for name in FOUND.names}
                for a, query in zip(asked, queries.astype(kind), strict=True):
                    # One of the k + 1 best different vectors may be the query itself.
                    at, scores = lists.walk(query, k + 1, -np.inf if a["floor"] is None else a["floor"])
                    best = sorted((-int(s), i) for p, s in zip(at, scores, strict=True) for i in ids[p] if i != a["query_id"])[:k]
                    out["query_id"] += [a["query_id"]] * len(best)
                    out["query_hash"] += [a["query_hash"]] * len(best)
                    out["vec_id"] += [i for _, i in best]
                    out["score"] += [-s for s, _ in best]
                yield pa.RecordBatch.from_pydict(out, FOUND)

    return run


def _meet(blocks: DataFrame, chunks: DataFrame, n_blocks: int, n_chunks: int, small: bool) -> DataFrame:
    """Every block with every chunk of its dims."""
    if small:
        return blocks.repartition(2 * n_blocks, "dims", "block").join(F.broadcast(chunks.drop("chunk")), "dims")
    dealt = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_chunks - 1).cast("long"))))
    return dealt.join(chunks, ["dims", "chunk"])


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long): the k best of all other rows for every row where `is_query` holds.

    Scores are inner products of floor(scale * component), in whole numbers; those beyond 64 bits are an error. Ties go
    to the lesser id. Rows without id and vectors that are null or hold null or non-finite components take no part.
    Vectors of different lengths don't meet; of length zero, all score zero. Rows equal in id and vector are one row;
    an id that has several vectors is a candidate with each, and a query with each. Fewer than k others give as many
    rows as there are; an empty table gives none.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    whole = rows.select(F.col(row_id).cast("long").alias("id"), quantised(F.col(vector), scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    whole = materialise(whole.where("id is not null and vector is not null"), spark, "top-k-rows")
    # Of equal vectors, the k + 1 least ids can be results; the window's limit is applied before its shuffle.
    least = Window.partitionBy("vector").orderBy("id")
    kept = whole.select("vector", "id").distinct().withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1)
    entries = materialise(kept.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), spark, "top-k-entries")
    asked = whole.where("asks").select(F.size("vector").alias("dims"), F.col("id").alias("query_id"), F.xxhash64("vector").alias("query_hash"), "vector").distinct()
    asked = materialise(asked, spark, "top-k-queries")
    n_entries = entries.count()
    n_asked, n_bytes = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("dims") * 8 + 64), F.lit(0))).first()
    n_blocks, n_chunks = -(-n_entries // BLOCK_ROWS) or 1, -(-n_asked // CHUNK_ROWS) or 1
    block = F.pmod(F.xxhash64("vector"), F.lit(n_blocks)).alias("block")
    packed = entries.groupBy(F.size("vector").alias("dims"), block).agg(F.collect_list(F.struct("ids", "vector")).alias("entries"))
    lists = materialise(packed.mapInArrow(_sorted_lists, "dims int, block long, vectors binary, places binary, ids array<array<long>>"), spark, "top-k-lists")

    def found(blocks: DataFrame, floors: DataFrame | None) -> DataFrame:
        known = asked.withColumn("floor", F.lit(None).cast("long")) if floors is None else asked.join(floors, ["query_id", "query_hash"], "left")
        chunk = F.pmod(F.xxhash64("query_id", "query_hash"), F.lit(n_chunks)).alias("chunk")
        chunks = known.groupBy("dims", chunk).agg(F.collect_list(F.struct("query_id", "query_hash", "vector", "floor")).alias("asked"))
        met = _meet(blocks, chunks, n_blocks, n_chunks, n_bytes <= BROADCAST_BYTES)
        return met.select("dims", "block", "vectors", "places", "ids", "asked").mapInArrow(_search(k), "query_id long, query_hash long, vec_id long, score long")

    first = materialise(found(lists.where("block = 0"), None), spark, "top-k-first")
    floors = first.groupBy("query_id", "query_hash").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).drop("n")
    rest = found(lists.where("block > 0"), floors)
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
