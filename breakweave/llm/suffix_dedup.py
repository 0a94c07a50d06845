"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

Every byte covered by a string of SPAN bytes that also starts earlier is removed. Suffixes only matter up to SPAN
bytes, so a suffix array here is the sorted list of the SPAN-byte strings that start in its texts, with the place
of each; neighbours with a common prefix of SPAN are a repeat.

1. Each SPAN-byte window names the least-hashed GRAM inside it; windows that follow each other and name the same
   one form a segment. Equal windows name equal grams, so only grams that occur twice or more can take part.
2. Of equal segments Spark keeps the first; the others are repeats as a whole.
3. What is left under a gram is dealt to buckets by the gram. A task takes its bucket's segments in text order, in
   batches: a batch gets its suffix array, is merge-scanned against the levels that exist, and becomes a level;
   levels of the same size are merged, so a bucket of n batches has about log2(n) levels.
   A gram with more than HOT different segments is dealt by the window itself instead.
4. The windows found are united to spans in the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakweave.llm.common import bounded_batches, materialise

SPAN = 100
GRAM = 32
#: Bytes that the gram finder takes at once; its positions fit in POSITION_BITS.
BLOCK = 1 << 21
POSITION_BITS = 22
#: Segments of a batch of the index, and about of a bucket.
BATCH_SEGMENTS = 1024
BUCKET_SEGMENTS = 16_384
#: Different segments under one gram above which its windows are dealt one by one.
HOT = 50_000
#: Stands for a null doc_id, which comes before all others.
NO_ID = -(1 << 63)


def gram_values(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the GRAM bytes that start at each position."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        step, factor = 1, np.uint64(0xD6E8FEB86659FD93)
        while step < GRAM:
            h = h[:-step] * factor + h[step:]
            factor = factor * factor + np.uint64(2)
            step *= 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and gram of the segments of texts laid end to end, each ending at one of `ends`.

    At most BLOCK + SPAN bytes; windows never cross the end of a text.
    """
    none = np.empty(0, np.int64)
    if len(data) < SPAN:
        return none, none, none
    grams = gram_values(data)
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    reach, width = 1, SPAN - GRAM + 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    at = (least & low).astype(np.int64)
    n = len(at)  # windows
    text = np.searchsorted(ends, np.arange(n), side="right")
    whole = np.arange(n) + SPAN <= ends[np.minimum(text, len(ends) - 1)]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
    new &= whole
    starts = np.flatnonzero(new)
    stop = np.flatnonzero(np.append(new, True) | np.append(~whole, True))
    length = stop[np.searchsorted(stop, starts, side="right")] - starts
    return starts, length, grams[at[starts]].view(np.int64)


def laid_out(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of whole texts (or of slices of long ones): bytes, ends, index of each text, offset in it."""
    held, size = [], 0
    for n, text in enumerate(texts):
        for at in range(0, max(len(text) - SPAN + 1, 0), BLOCK - SPAN):
            part = text[at : at + BLOCK - 1]
            if held and size + len(part) > BLOCK:
                yield from block(held)
                held, size = [], 0
            held.append((n, at, part))
            size += len(part)
    if held:
        yield from block(held)


def block(held: list[tuple[int, int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    ends = np.cumsum([len(x[2]) for x in held])
    yield np.frombuffer(b"".join(x[2] for x in held), np.uint8), ends, np.array([x[0] for x in held]), np.array([x[1] for x in held])


def all_segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, number of windows and gram of every segment, in order of text and start.

    Slices of a long text overlap by less than a window, so each window is in one segment.
    """
    out = []
    for data, ends, index, offset in laid_out(texts):
        start, length, gram = segments(data, ends)
        which = np.searchsorted(ends, start, side="right")
        begin = np.concatenate([[0], ends[:-1]])
        out.append((index[which], start - begin[which] + offset[which], length, gram))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class SuffixFamily:
    """Suffix arrays over batches of text in order; a level is (sorted strings, no string twice)."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, windows: np.ndarray) -> np.ndarray:
        """Which of the batch's windows (strings of SPAN bytes, in text order) occurred before."""
        order = np.argsort(windows, kind="stable")  # the batch's suffix array
        ranked = windows[order]
        again = np.zeros(len(ranked), bool)
        again[1:] = ranked[1:] == ranked[:-1]  # a common prefix of SPAN with the neighbour
        seen = np.zeros(len(windows), bool)
        seen[order[again]] = True
        first = ~again
        fresh, place = ranked[first], order[first]
        known = np.zeros(len(fresh), bool)
        for level in self.levels:
            k = np.searchsorted(level, fresh)
            known |= level[np.minimum(k, len(level) - 1)] == fresh
        seen[place[known]] = True
        self.push(fresh[~known])
        return seen

    def push(self, level: np.ndarray) -> None:
        if not len(level):
            return
        while self.levels and len(self.levels[-1]) <= len(level):
            older = self.levels.pop()
            level = np.insert(older, np.searchsorted(older, level), level)  # both are sorted and share no string
        self.levels.append(level)


def windows_of(bodies: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The strings of SPAN bytes that start in each body; bytes are raised by 1, so none ends in a zero.

    UTF-8 has no byte above 0xF4, so raised bytes still fit.
    """
    data = np.frombuffer(b"".join(bodies), np.uint8) + np.uint8(1)
    begin = np.concatenate([[0], np.cumsum([len(b) for b in bodies])[:-1]])
    at = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    view = np.lib.stride_tricks.sliding_window_view(data, SPAN)
    return np.ascontiguousarray(view[at]).view(f"S{SPAN}").ravel()


def grams_of(docs: DataFrame) -> DataFrame:
    """ord, text_hash, gram, times: the grams that the windows of each text name."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, _, _, gram = all_segments([t.encode() for t in batch.column("text").to_pylist()])
            order = np.lexsort((gram, text))
            text, gram = text[order], gram[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
            first = np.flatnonzero(new)
            take = pa.array(text[first])
            yield pa.record_batch(
                {
                    "ord": batch.column("ord").take(take),
                    "text_hash": batch.column("text_hash").take(take),
                    "gram": pa.array(gram[first]),
                    "times": pa.array(np.minimum(np.diff(np.append(first, len(text))), 2), pa.int32()),
                }
            )

    return docs.mapInArrow(named, "ord long, text_hash long, gram long, times int")


def segment_rows(wanted: DataFrame) -> DataFrame:
    """The segments of texts (ord, text_hash, text) under their wanted grams, with digest and bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            index, start, length, gram = all_segments(texts)
            lists = batch.column("grams")
            keep = np.zeros(len(index), bool)
            edges = np.searchsorted(index, np.arange(len(texts) + 1))
            for n in range(len(texts)):
                part = slice(edges[n], edges[n + 1])
                keep[part] = np.isin(gram[part], lists[n].values.to_numpy(zero_copy_only=False))
            index, start, length, gram = index[keep], start[keep], length[keep], gram[keep]
            bodies = [texts[n][s : s + k + SPAN - 1] for n, s, k in zip(index.tolist(), start.tolist(), length.tolist(), strict=True)]
            take = pa.array(index)
            yield pa.record_batch(
                {
                    "ord": batch.column("ord").take(take),
                    "text_hash": batch.column("text_hash").take(take),
                    "start": pa.array(start, pa.int64()),
                    "n": pa.array(length, pa.int32()),
                    "gram": pa.array(gram, pa.int64()),
                    "digest": pa.array([xxhash.xxh3_128_digest(b) for b in bodies], pa.binary()),
                    "body": pa.array(bodies, pa.binary()),
                }
            )

    return wanted.mapInArrow(cut, "ord long, text_hash long, start long, n int, gram long, digest binary, body binary")


def scanned_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """ord, text_hash, first, last (window starts): runs of windows that occur earlier, by bucket of grams."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    dealt = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "ord", "text_hash", "start")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, bucket = SuffixFamily(), None
        for batch in batches:
            numbers = batch.column("bucket").to_numpy()
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(numbers)) + 1, np.arange(0, len(numbers), BATCH_SEGMENTS), [len(numbers)]]))
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                if numbers[a] != bucket:
                    family, bucket = SuffixFamily(), numbers[a]
                part = batch.slice(a, b - a)
                counts = part.column("n").to_numpy().astype(np.int64)
                seen = family.add(windows_of(part.column("body").to_pylist(), counts))
                owner = np.repeat(np.arange(b - a), counts)
                at = np.arange(len(seen)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(part.column("start").to_numpy(), counts)
                hit = np.flatnonzero(seen)
                if not len(hit):
                    continue
                new = np.ones(len(hit), bool)
                new[1:] = (np.diff(hit) > 1) | (owner[hit[1:]] != owner[hit[:-1]])
                first = hit[new]
                last = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1]
                take = pa.array(owner[first])
                yield pa.record_batch(
                    {"ord": part.column("ord").take(take), "text_hash": part.column("text_hash").take(take), "first": pa.array(at[first]), "last": pa.array(at[last])}
                )

    return dealt.select("bucket", "ord", "text_hash", "start", "n", "body").mapInArrow(scan, "ord long, text_hash long, first long, last long")


def scanned_windows(rows: DataFrame) -> DataFrame:
    """The same for grams with very many segments: each window is dealt by its own bytes."""
    each = rows.select("ord", "text_hash", "start", "body", F.posexplode(F.sequence(F.lit(1), F.col("n"))).alias("k", "_"))
    each = each.select("ord", "text_hash", (F.col("start") + F.col("k")).alias("first"), F.substring("body", F.col("k") + 1, F.lit(SPAN)).alias("window"))
    place = F.struct("ord", "text_hash", "first")
    least = each.groupBy("window").agg(F.min(place).alias("least"))
    return each.join(least, "window").where(place > F.col("least")).select("ord", "text_hash", "first", F.col("first").alias("last"))


def cleaned(texts: DataFrame) -> DataFrame:
    """ord, text_hash, n_removed, n_spans, kept_sha256 of texts with the runs found in them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs"), strict=True):
                data = text.encode()
                a = runs.values.field("first").to_numpy()
                b = runs.values.field("last").to_numpy() + SPAN
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.ones(len(a), bool)
                new[1:] = a[1:] > b[:-1]
                first = np.flatnonzero(new)
                s, e = a[first], b[np.append(first[1:], len(a)) - 1]
                digest, at = hashlib.sha256(), 0
                for x, y in zip(s.tolist(), e.tolist(), strict=True):
                    digest.update(data[at:x])
                    at = y
                digest.update(data[at:])
                removed.append(int((e - s).sum()))
                spans.append(len(s))
                kept.append(digest.hexdigest())
            yield pa.record_batch(
                {"ord": batch.column("ord"), "text_hash": batch.column("text_hash"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(kept)}
            )

    return texts.mapInArrow(cut, "ord long, text_hash long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, bucket_segments: int = BUCKET_SEGMENTS, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document.

    Documents are ordered by doc_id, null ids first; documents that share an id are ordered by a hash of their
    text, and of rows equal in both one comes first. Texts shorter than SPAN bytes lose nothing; null texts are
    empty. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("ord"), text.alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    base = materialise(
        rows.select("doc_id", "ord", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), spark, "repeat-base"
    )
    # Equal texts: the first stands for all, the others are repeats of it as a whole.
    firsts = base.groupBy("sha").agg(F.min(F.struct("ord", "text_hash")).alias("f")).select("sha", "f.ord", "f.text_hash")

    full = rows.where(F.octet_length("text") >= SPAN).select("ord", "text_hash", "text")
    named = grams_of(full)
    often = named.groupBy("gram").agg(F.sum("times").alias("times")).where("times > 1").select("gram")
    wanted = named.select("ord", "text_hash", "gram").join(often, "gram").groupBy("ord", "text_hash").agg(F.collect_set("gram").alias("grams"))
    wanted = wanted.join(firsts.select("ord", "text_hash"), ["ord", "text_hash"], "left_semi")
    found = materialise(segment_rows(full.join(wanted, ["ord", "text_hash"]).select("ord", "text_hash", "text", "grams")), spark, "segments")

    place = F.struct("ord", "text_hash", "start")
    first = materialise(
        found.groupBy("digest").agg(F.min(place).alias("least"), F.min("gram").alias("gram"), F.count(F.lit(1)).alias("times")), spark, "first-segments"
    )
    repeated = found.select("digest", "ord", "text_hash", "start", "n").join(first.where("times > 1").select("digest", "least"), "digest")
    repeated = repeated.where(place > F.col("least")).select("ord", "text_hash", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last"))

    many = first.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    open_ = first.join(many, "gram").select("least.*", "kinds")
    bodies = materialise(found.select("ord", "text_hash", "start", "n", "gram", "body").join(open_, ["ord", "text_hash", "start"]).distinct(), spark, "open-segments")
    counts = bodies.agg(F.count(F.lit(1)).alias("n"), F.max("kinds").alias("most")).first()
    runs = repeated.unionByName(scanned_buckets(bodies.where(F.col("kinds") <= hot), max(1, -(-counts["n"] // bucket_segments))))
    if (counts["most"] or 0) > hot:
        runs = runs.unionByName(scanned_windows(bodies.where(F.col("kinds") > hot)))

    # One list a text: its own runs.
    listed = runs.groupBy("ord", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    cut = cleaned(full.join(listed, ["ord", "text_hash"]).select("ord", "text_hash", "text", "runs"))
    cut = cut.groupBy("ord", "text_hash").agg(*[F.min(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256")])

    # Copies share a text; rows equal in id and text as well are counted, and the first of them stays.
    same = base.groupBy("doc_id", "ord", "text_hash", "sha", "n_bytes").agg(F.count(F.lit(1)).alias("times"))
    same = same.join(firsts.select("sha", F.col("ord").alias("f_ord"), F.col("text_hash").alias("f_hash")), "sha")
    each = same.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    each = each.withColumn("leads", (F.col("ord") == F.col("f_ord")) & (F.col("text_hash") == F.col("f_hash")) & (F.col("copy") == 1))
    out = each.join(cut, ["ord", "text_hash"], "left")
    gone = ~F.col("leads") & (F.col("n_bytes") >= SPAN)
    own = F.col("leads") & F.col("n_removed").isNotNull()
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).when(own, F.col("n_removed")).otherwise(0).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).when(own, F.col("n_spans")).otherwise(0).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).when(own, F.col("kept_sha256")).otherwise(F.col("sha")).alias("kept_sha256"),
    )
