"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good in the training folds; unlabelled text is every document of those folds.
A first classifier of positives against unlabelled text gives the class prior (the least ratio of unlabelled to
positive mass above a score); the model then minimises the non-negative unbiased risk
    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)).

Features of all documents are written once. The unlabelled rows are dealt to parts by a hash; in a round each part
takes small steps through its rows from the common model, and the parts' models are averaged by their sizes, so that
every row takes part in every round whatever the corpus's size. Only the labelled positives are a bounded sample.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breakweave.llm.common import bounded_batches, materialise

#: Labelled rows that fitting uses at most, those with the least hashes; unlabelled rows are all used.
SAMPLE = 8000
HIDDEN = 16
BATCH = 1024
#: Rounds over all rows for the prior's classifier and for the model, and steps of a part in a round at least.
PRIOR_ROUNDS, ROUNDS, LEAST_STEPS = 6, 12, 25
#: Unlabelled rows of a part, about.
PART_ROWS = 20_000
#: Partial sums that reach the driver at most.
SUMS = 16
#: Bins of the scores' histogram, on the logit scale from -30 to 30.
BINS = 1200
SEED = 4
#: Bytes that are no marks: letters, digits, white space, full stop and comma, and all of non-ASCII letters.
PLAIN = bytes(b for b in range(256) if b > 127 or chr(b).isalnum() or chr(b) in " \t\r\n.,")
N_FEATURES = 256 + 14


def remainder(doc_id: Column) -> Column:
    """The fold of a row: crc32 of the id's text, modulo 3; null ids are in fold 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def features(text: str | None) -> np.ndarray:
    """Shares of byte values, words and lines, how far the text compresses, and its oddest line; the empty text has zeros."""
    out = np.zeros(N_FEATURES, np.float32)
    data = (text or "").encode()
    if not data:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    out[:256] = np.sqrt(counts / n)
    words, lines = data.split(), [line for line in data.split(b"\n") if line.strip()]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    some = max(1, len(words))
    variety, marks, repeats, odd = 1.0, 0.0, 0, 0
    for line in lines:
        own = line.split()
        repeats += sum(map(bytes.__eq__, own, own[1:]))
        odd += (share := len(line.translate(None, PLAIN)) / len(line)) > 0.1
        if len(own) >= 5:
            variety = min(variety, len(set(own)) / len(own))
            marks = max(marks, share)
    out[256:] = (
        math.log1p(n),
        math.log1p(len(words)),
        lengths.mean() / 10 if len(words) else 0,
        lengths.std() / 10 if len(words) else 0,
        len(set(words)) / some,
        len(set(lines)) / max(1, len(lines)),
        counts[65:91].sum() / n,
        counts[48:58].sum() / n,
        (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / n,
        len(zlib.compress(data, 1)) / n,
        variety,
        marks,
        repeats / some,
        odd / max(1, len(lines)),
    )
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Net:
    """One hidden layer of ReLU units on standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, rng: np.random.Generator) -> None:
        self.mean, self.scale = mean, scale
        d = len(mean)
        self.p = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.maximum(0, x @ self.p[0] + self.p[1])
        return x, h, h @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(x)[2])

    def step(self, x: np.ndarray, h: np.ndarray, grad: np.ndarray, rate: float = 3e-3, decay: float = 1e-4) -> None:
        back = np.outer(grad, self.p[2]) * (h > 0)
        grads = [x.T @ back, back.sum(0), h.T @ grad, np.array([grad.sum()])]
        self.t += 1
        for k, g in enumerate(grads):
            g = g + decay * self.p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


    def params(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p])

    def with_params(self, flat: np.ndarray) -> Net:
        """A net of the same shape and standardisation with these parameters."""
        new = Net(self.mean, self.scale, np.random.default_rng(0))
        cuts = np.cumsum([x.size for x in self.p])[:-1]
        new.p = [part.reshape(x.shape).copy() for part, x in zip(np.split(flat, cuts), self.p, strict=True)]
        return new


def walk(net: Net, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, rng: np.random.Generator) -> None:
    """Small steps through all rows of `unlabelled`, at least LEAST_STEPS; without a prior the two are simply told apart."""
    some = len(unlabelled)
    for _ in range(-(-LEAST_STEPS // max(1, -(-some // BATCH)))):
        order = rng.permutation(some)
        for at in range(0, some, BATCH):
            u, p = unlabelled[order[at : at + BATCH]], positive[rng.integers(0, len(positive), min(BATCH, 4 * len(positive)))]
            k = len(p)
            x, h, z = net.forward(np.concatenate([p, u]).astype(np.float64))
            s = sigmoid(z)
            grad = np.zeros_like(z)
            if prior is None:
                grad[:k], grad[k:] = (s[:k] - 1) * 0.5 / k, s[k:] * 0.5 / len(u)
            else:
                # Sigmoid loss: l(z, +1) = 1 - s, l(z, -1) = s, with slope s (1 - s).
                slope = s * (1 - s)
                if s[k:].mean() - prior * s[:k].mean() >= 0:
                    grad[:k], grad[k:] = -2 * prior * slope[:k] / k, slope[k:] / len(u)
                else:  # the negative part is over-fitted: step back along it
                    grad[:k], grad[k:] = prior * slope[:k] / k, -slope[k:] / len(u)
            net.step(x, h, grad)


def featured(rows: DataFrame, *keep: str) -> DataFrame:
    """keep and f, the features as 16-bit floats."""

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            blobs = [features(text).astype(np.float16).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.record_batch({k: batch.column(k) for k in keep} | {"f": pa.array(blobs, pa.binary())})

    kept = rows.select(*keep)
    return rows.select(*keep, "text").mapInArrow(made, T.StructType([*kept.schema.fields, T.StructField("f", T.BinaryType())]))


def matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float16).reshape(-1, N_FEATURES).astype(np.float32)


def summed(vectors: DataFrame) -> np.ndarray:
    """The sum of the vectors v (64-bit floats) of rows (part, v), in an order that the parts fix; a few rows reach the driver."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in it:
            for blob in batch.column("v").to_pylist():
                v = np.frombuffer(blob)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.record_batch({"v": pa.array([total.tobytes()], pa.binary())})

    few = vectors.withColumn("lot", (F.col("part") % SUMS).cast("int")).repartition(SUMS, "lot").sortWithinPartitions("lot", "part", "v")
    partial = sorted(r["v"] for r in few.mapInArrow(add, "v binary").collect())
    return np.sum([np.frombuffer(v) for v in partial], axis=0)


def by_part(dealt: DataFrame, work: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """part, v: what `work` makes of each part's rows. A part lies in one file, so its rows come in one piece."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def close() -> pa.RecordBatch:
            v = work(part, matrix(held)).astype(np.float64)
            return pa.record_batch({"part": pa.array([part], pa.int64()), "v": pa.array([v.tobytes()], pa.binary())})

        for batch in it:
            numbers, blobs = batch.column("part").to_numpy(), batch.column("f").to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and numbers[a] != part:
                    yield close()
                    held = []
                part = int(numbers[a])
                held += blobs[a:b]
        if held:
            yield close()

    return dealt.select("part", "f").mapInArrow(each, "part long, v binary")


def fit(positive: np.ndarray, dealt: DataFrame, mean: np.ndarray, scale: np.ndarray, rounds: int, prior: float | None) -> Net:
    """The average of the parts' models after each round, over all unlabelled rows (part, f)."""
    net = Net(mean, scale, np.random.Generator(np.random.PCG64(SEED)))
    for k in range(rounds):

        def step(part: int, rows: np.ndarray, k: int = k, start: Net = net) -> np.ndarray:
            own = start.with_params(start.params())
            walk(own, positive, rows, prior, np.random.Generator(np.random.PCG64([SEED, k, part])))
            return np.append(own.params(), 1.0) * len(rows)

        total = summed(by_part(dealt, step))
        net = net.with_params(total[:-1] / total[-1])
    return net


def estimate_prior(net: Net, positive: np.ndarray, dealt: DataFrame) -> float:
    """The share of positives in unlabelled text, from the scores of rows that the net has not seen."""
    edges = np.linspace(-30, 30, BINS + 1)
    bins = lambda x: np.bincount(np.clip(np.searchsorted(edges, net.forward(x.astype(np.float64))[2]) - 1, 0, BINS - 1), minlength=BINS)
    u, p = summed(by_part(dealt, lambda _, x: bins(x))), bins(positive)
    above_u, above_p = u[::-1].cumsum()[::-1] / u.sum(), p[::-1].cumsum()[::-1] / p.sum()
    # Small tails say little: the bound allows for the spread of both shares.
    slack = np.sqrt(math.log(20) / 2) * (1 / math.sqrt(u.sum()) + 1 / math.sqrt(p.sum()))
    some = above_p > 0
    best = np.argmin((above_u[some] + slack) / above_p[some])
    return float(np.clip(above_u[some][best] / above_p[some][best], 0.05, 0.98))


def train(feats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Net | None, float]:
    """Fit on the rows (doc_id, f) of folds 0 and 2; None if there is no labelled positive or no document among them."""
    spark = feats.sparkSession
    inside = remainder(F.col("doc_id")) != 1
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long")).where(inside).distinct()
    chosen = feats.select("doc_id").join(ids, "doc_id", "left_semi").distinct().orderBy(F.xxhash64(F.lit("positive"), "doc_id"), "doc_id").limit(sample)
    # At most `sample` ids are broadcast; the rows that come back are one a chosen id.
    blobs = feats.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("f").toArrow().column("f").to_pylist()
    positive = matrix(sorted(blobs))
    rows = feats.where(inside)
    n = rows.count()
    if not len(positive) or not n:
        return None, float("nan")
    parts = -(-n // PART_ROWS)
    # Each part is two: one half fits the prior's classifier, the other is scored by it.
    number = F.pmod(F.xxhash64(F.lit("part"), "doc_id", "f"), F.lit(2 * parts)).cast("int")
    dealt = rows.select(number.alias("part"), "f").repartitionById(2 * parts, F.col("part")).sortWithinPartitions("part", "f")
    dealt = materialise(dealt, spark, "quality-parts")
    moments = summed(by_part(dealt, lambda _, x: np.concatenate([[len(x)], x.sum(0, np.float64), (x.astype(np.float64) ** 2).sum(0)])))
    mean = moments[1 : 1 + N_FEATURES] / moments[0]
    scale = np.sqrt(np.maximum(moments[1 + N_FEATURES :] / moments[0] - mean**2, 0)) + 1e-3
    one, other = (positive[0::2], positive[1::2]) if len(positive) > 1 else (positive, positive)
    seen, unseen = (dealt.where("part % 2 = 0"), dealt.where("part % 2 = 1")) if n > 1 else (dealt, dealt)
    if not (seen.limit(1).count() and unseen.limit(1).count()):
        seen = unseen = dealt
    prior = estimate_prior(fit(one, seen, mean, scale, PRIOR_ROUNDS, None), other, unseen)
    return fit(positive, dealt, mean, scale, ROUNDS, prior), prior


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null and empty texts are scored on zero features. Null ids count as fold 0. Repeated ids are scored row by
    row; labels of unknown documents and null labels teach nothing. Without any trusted positive nothing can be
    learnt and every score is 1: nothing speaks against a text. An empty table gives an empty result; other
    columns, labels, lang and source are not inputs.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    feats = materialise(featured(rows, "doc_id"), docs.sparkSession, "quality-features")
    net, _ = train(feats, labels, sample)

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = matrix(batch.column("f").to_pylist()).astype(np.float64)
            s = net.score(x) if net else np.ones(len(x))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(s, pa.float64())})

    out = feats.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns; one map after fitting.

    Nulls, repeats and small tables as in score_quality: each row is judged by its own text, and without any trusted
    positive all rows stay.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    inside = remainder(F.col("doc_id")) != 1
    net, _ = train(materialise(featured(rows.where(inside), "doc_id"), docs.sparkSession, "quality-features"), labels, sample)

    def kept(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if net and len(batch):
                x = matrix([features(text).astype(np.float16).tobytes() for text in batch.column("text").to_pylist()])
                batch = batch.filter(pa.array(net.score(x.astype(np.float64)) >= 0.5))
            yield batch

    return docs.mapInArrow(kept, docs.schema)
