"""Second-order Markov scoring: how likely a motif is to come up by chance at its distance from the break.

The recurrences run over whole Arrow batches: every row of a batch moves one state at a time, so a step costs a few
array operations whatever the number of rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breakweave.functions import sequence as S
from breakweave.operators.cleaning import TILE, cut_evenly, tiles

BASES = "ACGT"
EPSILON = 1e-6
SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("lk", "p_val", "p_chance", "freq_eq")])
CODE = np.full(256, -1, np.int64)
CODE[[ord(b) for b in BASES]] = range(4)
FIVE = np.where(CODE < 0, 4, CODE).astype(np.int16)
#: Letters of contexts, about, that are counted at once.
LETTERS = 1 << 19
#: Rows that take a step together: their tables stay in the processor's cache.
ROWS = 1 << 11


def trimer_counts(contexts: DataFrame, key: str = "id") -> DataFrame:
    """key, dimer, base, n: how often each base follows each dimer; windows with other letters don't count.

    Contexts of any length are cut into tiles that overlap by two bases; counts add up.
    """
    cut = contexts.select(key, cut_evenly(F.col("context"), TILE).alias("cut"))
    overlapped = F.transform("cut", lambda c, k: F.concat(c, F.coalesce(F.left(F.get("cut", k + 1), F.lit(2)), F.lit(""))))
    return _counted(cut.select(key, F.explode(overlapped).alias("tile")), key)


def genome_trimers(genome: DataFrame, size: int = TILE) -> DataFrame:
    """chr, dimer, base, n of whole contigs, which may come in pieces."""
    own = F.substring("tile_seq", (F.col("tile") * size - F.col("base") + 1).cast("int"), F.lit(size + 2))
    return _counted(tiles(genome, 2, size).select("chr", own.alias("tile")), "chr")


def _counted(tiled: DataFrame, key: str) -> DataFrame:
    # A look-ahead finds overlapping trimers in one walk.
    each = tiled.select(key, F.explode(F.regexp_extract_all("tile", F.lit("(?=([ACGT]{3}))"), F.lit(1))).alias("g"))
    grams = each.groupBy(key, "g").agg(F.count(F.lit(1)).alias("n"))
    return grams.select(key, F.left("g", F.lit(2)).alias("dimer"), F.right("g", F.lit(1)).alias("base"), "n")


def transition_table(contexts: DataFrame, key: str = "id") -> DataFrame:
    """key, dimer, base, p for all 64 pairs of each key: counts plus EPSILON, as shares of the dimer's row."""
    return shares(trimer_counts(contexts, key), contexts.select(key).distinct(), key)


def shares(counts: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Counts (key, dimer, base, n) as `transition_table` gives them, for all `keys`."""
    spark = keys.sparkSession
    pairs = spark.range(64).select(
        F.concat(F.get(F.array(*map(F.lit, BASES)), (F.col("id") / 16).cast("int")), F.get(F.array(*map(F.lit, BASES)), (F.col("id") / 4 % 4).cast("int"))).alias("dimer"),
        F.get(F.array(*map(F.lit, BASES)), (F.col("id") % 4).cast("int")).alias("base"),
    )
    grid = keys.join(F.broadcast(pairs))  # 64 rows are broadcast
    full = grid.join(counts, [key, "dimer", "base"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + EPSILON)
    return full.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(key, "dimer"))).select(key, "dimer", "base", "p")


def _tables(contexts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Transition probabilities (rows, 4, 4, 4) and dimer frequencies (rows, 4, 4), counted over many rows at once."""
    m, f = np.full((len(contexts), 64), EPSILON), np.zeros((len(contexts), 16))
    texts = [text.encode("ascii", "replace") for text in contexts]
    lengths = np.array([len(x) for x in texts])
    part = (np.cumsum(lengths) - lengths) // LETTERS
    for first, last in zip(*(np.searchsorted(part, np.unique(part), side) for side in ("left", "right")), strict=True):
        # Rows are set apart by a letter that is no base; all such are a fifth letter, so every dimer begins a trimer.
        c = FIVE[np.frombuffer(b"-".join(texts[first:last]) + b"---", np.uint8)]
        row = np.repeat(np.arange(0, 125 * (last - first), 125), lengths[first:last] + 1)
        n = np.bincount(row + (25 * c[:-2] + 5 * c[1:-1] + c[2:]), minlength=125 * (last - first))
        n = n.reshape(-1, 5, 5, 5)[:, :4, :4]
        m[first:last] += n[..., :4].reshape(-1, 64)
        f[first:last] = n.sum(3).reshape(-1, 16)
    f = f / np.maximum(lengths - 1, 1)[:, None] + EPSILON
    m = m.reshape(-1, 4, 4, 4)
    return m / m.sum(3, keepdims=True), f.reshape(-1, 4, 4)


def markov_scores(context: list[str], motif: list[str], distance: list[int], memory: list[str]) -> np.ndarray:
    """lk, p_val, p_chance, freq_eq of each row; NaN where the motif is empty, the distance negative or a letter unknown."""
    out = np.full((len(context), 4), np.nan)
    x, sizes, last, good = _scorable(motif, distance, memory)
    if len(good):
        m, freq = _tables([context[r] or "" for r in good])
        out[good] = _walked(m, freq, x[good], sizes[good], np.asarray(distance)[good], last[good])
    return out


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of texts from the first letter on, rows filled up with zeros, and their lengths."""
    sizes = np.array([len(t or "") for t in texts], np.int64)
    x = np.zeros((len(texts), max(3, int(sizes.max(initial=0)))), np.int64)
    rows = np.repeat(np.arange(len(texts)), sizes)
    x[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = CODE[np.frombuffer("".join(t or "" for t in texts).encode("ascii", "replace"), np.uint8)]
    return x, sizes


def _scorable(motif: list[str], distance: list[int], memory: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The motifs' codes and lengths, the codes of the memories' last two letters, and the rows that have scores."""
    x, sizes = _coded(motif)
    last, known = _coded([(t or "")[-2:] for t in memory])
    last = last[:, :2]
    good = (sizes > 0) & (known == 2) & (np.asarray(distance) >= 0) & (x.min(1) >= 0) & (last.min(1) >= 0)
    return x, sizes, last, np.flatnonzero(good)


def _walked(m: np.ndarray, freq: np.ndarray, x: np.ndarray, sizes: np.ndarray, distance: np.ndarray, start: np.ndarray) -> np.ndarray:
    """markov_scores from tables: those with the farthest motifs first, so that a step is taken by the rows that still need it."""
    order = np.argsort(-distance, kind="stable")
    out = np.empty((len(order), 4))
    for first in range(0, len(order), ROWS):
        part = order[first : first + ROWS]
        out[part] = _walked_part(m[part], freq[part], x[part], sizes[part], distance[part] + 2, start[part])
    return out


def _walked_part(m: np.ndarray, freq: np.ndarray, x: np.ndarray, sizes: np.ndarray, d: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The scores of rows by descending number of states, d."""
    k, rows = len(d), np.arange(len(d))
    tail = np.ones(k)
    for j in range(int(sizes.max()) - 2):
        longer = np.flatnonzero(sizes > j + 2)
        tail[longer] *= m[longer, x[longer, j], x[longer, j + 1], x[longer, j + 2]]
    single, first, second = sizes == 1, x[:, 0], np.where(sizes > 1, x[:, 1], 0)
    any_single = single.any()
    # Rows are the last axis, so that a step is sixteen sums over whole columns.
    m = np.ascontiguousarray(m.transpose(1, 2, 3, 0))

    def begun(state: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
        """The motif's probability at a state; of one base, at the state before it."""
        p = state[first[:n], second[:n], rows[:n]]
        if any_single:
            p = np.where(single[:n], before.sum(0)[first[:n], rows[:n]], p)
        return p * tail[:n]

    def first_step(state: np.ndarray) -> np.ndarray:
        """Only dimers that begin with the memory's last base are reached."""
        follow = sum(state[a, b] * m[a, b] for a in range(4) for b in range(4))
        new = np.zeros((4, 4, k))
        new[start[:, 1], :, rows] = follow.T
        return new

    def walk(state: np.ndarray, n: int) -> np.ndarray:
        return sum(state[a, :, None, :n] * m[a, :, :, :n] for a in range(4))

    s0 = np.zeros((4, 4, k))
    s0[start[:, 0], start[:, 1], rows] = 1
    before, now = s0, first_step(s0)
    q = np.ones(k)  # product of 1 - p over states 2 .. t
    q_first = np.ones(k)
    out = np.zeros((k, 4))
    for t in range(2, int(d[0]) + 1):
        n = int(np.searchsorted(-d, -t, "right"))  # rows with t states at least
        before, now = now[..., :n], walk(now, n)
        p = begun(now, before, n)
        factor = np.abs(1 - p)
        done = int(np.searchsorted(-d, -t, "left"))  # from here on rows end at this state
        grown = q[:n] * factor
        out[done:n, 0] = q[done:n] * (1 - factor[done:])
        # The sum of the prefixes' likelihoods telescopes: the first factor minus the product of all.
        out[done:n, 1] = q_first[done:n] - grown[done:] if t > 2 else 0.0
        out[done:n, 2] = p[done:]
        q[:n] = grown
        if t == 2:
            q_first = q.copy()
    e1 = first_step(np.ascontiguousarray(freq.transpose(1, 2, 0)))
    out[:, 3] = begun(walk(e1, k), e1, k)
    return out


class Tile:
    """What stands in parts of a tile."""

    def __init__(self, text: str) -> None:
        self.text, self.found = text, {}
        c = CODE[np.frombuffer(text.encode("ascii", "replace") + b"---", np.uint8)]
        self.codes = [c[:-2]]  # of the one, two and three letters from each on; below 0 if they are not all known
        for w in (1, 2):
            self.codes.append(np.where((self.codes[-1] < 0) | (c[w : len(c) - 2 + w] < 0), -1, 4 * self.codes[-1] + c[w : len(c) - 2 + w]))

    def grams(self, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
        """How often each base, dimer and trimer stands in the parts [lo, hi), which are told apart by sums up to their ends: letters are walked once."""
        out = []
        for w, codes in enumerate(self.codes):
            ends, at = np.unique(np.concatenate([lo, np.maximum(hi - w, lo)]), return_inverse=True)
            part = np.repeat(np.arange(len(ends)), np.diff(ends, append=len(codes)))
            known = codes[ends[0] :] >= 0
            each = np.bincount(part[known] * 4 ** (w + 1) + codes[ends[0] :][known], minlength=len(ends) * 4 ** (w + 1)).reshape(len(ends), -1)
            sums = np.concatenate([np.zeros((1, each.shape[1]), np.int64), np.cumsum(each, axis=0)])
            out.append(sums[at[len(lo) :]] - sums[at[: len(lo)]])
        return out

    def count(self, motif: str, lo: int, hi: int) -> int:
        """Occurrences of a motif in the part, overlapping ones too; none of an empty one."""
        if motif not in self.found:
            at, places = self.text.find(motif) if motif else -1, []
            while at >= 0:
                places.append(at)
                at = self.text.find(motif, at + 1)
            self.found[motif] = places
        places = self.found[motif]
        return max(0, bisect_right(places, hi - len(motif)) - bisect_left(places, lo))


def _near(batch: pa.RecordBatch, last: tuple, slots: int, scores: bool) -> tuple[list[pa.Array], tuple]:
    """The columns that `scored_in_tiles` adds to a batch, and the last tile, which the next batch may begin with."""
    n, motifs = batch.num_rows, [batch.column(f"motif{k}").to_pylist() for k in range(slots)]
    jobs = [batch.column(f"motif{k}").is_valid().to_numpy(zero_copy_only=False) for k in range(slots)]
    coded = [_coded(m) for m in motifs]
    short = [jobs[k] & (coded[k][1] > 0) & (coded[k][1] <= 3) & (coded[k][0][:, :3].min(1) >= 0) for k in range(slots)]
    long = [jobs[k] & ~short[k] for k in range(slots)]
    counts, grams = [np.zeros(n, np.int32) for _ in range(slots)], [np.zeros((n, 4**w), np.int32) for w in (1, 2, 3)]
    pos, some = batch.column("pos").to_numpy(), np.flatnonzero(np.logical_or.reduce(jobs))
    base, seqs = batch.column("base").to_numpy(), batch.column("tile_seq")
    lo = np.maximum(pos - S.LARGE_WINDOW - base, 0)
    hi = np.maximum(pos + S.LARGE_WINDOW - base, lo)
    # Contig, first base and length tell which bases a tile has.
    named = batch.column("chr").dictionary_encode()
    size = pc.fill_null(pc.binary_length(seqs), 0).to_numpy()
    marks = np.stack([named.indices.to_numpy(), base, size])[:, some]
    cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1
    for rows in np.split(some, cuts) if len(some) else []:
        first = int(rows[0])
        if last[:3] != (mark := (named[first].as_py(), base[first], size[first])):
            last = (*mark, Tile(seqs[first].as_py()))
        tile = last[3]
        lo[rows], hi[rows] = np.minimum(lo[rows], len(tile.text)), np.minimum(hi[rows], len(tile.text))
        for all_, found in zip(grams, tile.grams(lo[rows], hi[rows]), strict=True):
            all_[rows] = found
        for k in range(slots):
            for r in rows[long[k][rows]].tolist():
                counts[k][r] = tile.count(motifs[k][r], lo[r], hi[r])
    out = []
    for k in range(slots):
        x, sizes = coded[k]
        for w in (1, 2, 3):
            at = np.flatnonzero(short[k] & (sizes == w))
            counts[k][at] = grams[w - 1][at, sum(x[at, j] * 4 ** (w - 1 - j) for j in range(w))]
        if scores:
            at, distance = np.flatnonzero(jobs[k]), batch.column(f"dist{k}").fill_null(-1).to_numpy()
            memory = batch.column(f"memory{k}").to_pylist()
            x, sizes, before, good = _scorable([motifs[k][r] for r in at], distance[at], [memory[r] for r in at])
            rows, values = at[good], np.full((n, 4), np.nan)
            if len(rows):
                m = (grams[2][rows] + EPSILON).reshape(-1, 4, 4, 4)
                f = grams[1][rows] / np.maximum((hi - lo)[rows] - 1, 1)[:, None] + EPSILON
                values[rows] = _walked(m / m.sum(3, keepdims=True), f.reshape(-1, 4, 4), x[good], sizes[good], distance[rows], before[good])
            out += [pa.array(values[:, j], mask=np.isnan(values[:, j])) for j in range(4)]
        out.append(pa.array(counts[k], mask=~jobs[k]))
    return out, last


def scored_in_tiles(rows: DataFrame, slots: int, scores: bool = True) -> DataFrame:
    """Adds, for each slot k, s{k}_lk, s{k}_p_val, s{k}_p_chance, s{k}_freq_eq and s{k}_count of a motif in the bases around pos.

    Rows have chr, pos, base, tile_seq (see `with_tile`; these two go; rows without a motif need no tile_seq) and for each slot motif{k}, dist{k} and memory{k},
    or motif{k} alone if only counts are asked for; a null motif has nulls. Rows of a tile should follow each other:
    its letters are counted once for all of them.
    """
    given = [F.col(c) for c in rows.columns if c not in ("base", "tile_seq") and c[:-1] not in ("motif", "dist", "memory")]
    names = [c for c in rows.columns if c not in ("base", "tile_seq") and c[:-1] not in ("motif", "dist", "memory")]
    added = [f"s{k}_{c}" for k in range(slots) for c in ([*SCORES.names, "count"] if scores else ["count"])]
    schema = T.StructType([*rows.select(*given).schema.fields, *[T.StructField(c, T.IntegerType() if c.endswith("_count") else T.DoubleType()) for c in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None, None, None)
        for batch in batches:
            if batch.num_rows:
                made, last = _near(batch, last, slots, scores)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *made], names=[*names, *added])

    some = reduce(or_, [F.col(f"motif{k}").isNotNull() for k in range(slots)])
    return rows.withColumn("tile_seq", F.when(some, F.col("tile_seq"))).mapInArrow(run, schema)


def total_probability(context: list[str], motif: list[str], length: list[int], memory: list[str]) -> np.ndarray:
    """How likely a motif is to end at any of the states 0 to length - 1, in the older model.

    One less the product, over all states, of one less the state's probability of the motif's last dimer (the memory, for
    a motif of one base) times the motif's own, whose first two factors come from that dimer and from its last and first
    base. States are biased by EPSILON. NaN where the motif is empty, the length below 1 or a letter unknown.
    """
    out = np.full(len(context), np.nan)
    codes, last = ([CODE[np.frombuffer((x or "").encode("ascii", "replace"), np.uint8)] for x in xs] for xs in (motif, memory))
    good = [r for r in range(len(context)) if len(codes[r]) and len(last[r]) >= 2 and length[r] >= 1 and (codes[r] >= 0).all() and (last[r][-2:] >= 0).all()]
    if not good:
        return out
    m, _ = _tables([context[r] or "" for r in good])
    k, rows = len(good), np.arange(len(good))
    n = np.array([length[r] for r in good])
    start = np.array([last[r][-2:] for r in good])
    ends = np.array([codes[r][-2:] if len(codes[r]) > 1 else last[r][-2:] for r in good])
    sizes = np.array([len(codes[r]) for r in good])
    x = np.zeros((k, max(2, int(sizes.max()))), np.int64)
    for i, r in enumerate(good):
        x[i, : sizes[i]] = codes[r]
    own = m[rows, ends[:, 0], ends[:, 1], x[:, 0]]
    for j in range(1, int(sizes.max())):
        before = (x[rows, sizes - 1], x[:, 0]) if j == 1 else (x[:, j - 2], x[:, j - 1])
        own = np.where(sizes > j, own * m[rows, *before, x[:, j]], own)
    # Rows are the last axis, so that a step is sixteen sums over whole columns.
    m = np.ascontiguousarray(m.transpose(1, 2, 3, 0))
    state = np.zeros((4, 4, k))
    state[start[:, 0], start[:, 1], rows] = 1
    missed = np.ones(k)
    for t in range(int(n.max())):
        if t:
            state = sum(state[a][:, None] * m[a] for a in range(4))
        missed = np.where(t < n, missed * (1 - (state[ends[:, 0], ends[:, 1], rows] + EPSILON) * own), missed)
    out[good] = 1 - missed
    return out


@F.pandas_udf(T.DoubleType())
def total_probability_udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for context, motif, length, memory in batches:
        yield pd.Series(total_probability(context.tolist(), motif.tolist(), [0 if pd.isna(x) else int(x) for x in length], memory.tolist()))


@F.pandas_udf(SCORES)
def markov_udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for context, motif, distance, memory in batches:
        yield pd.DataFrame(markov_scores(context.tolist(), motif.tolist(), [-1 if pd.isna(x) else int(x) for x in distance], memory.tolist()), columns=SCORES.names)


def score_deletions(found: DataFrame, mh2: bool = True) -> DataFrame:
    """Adds the scores of each deletion's longest candidate (del_mmej_*), and assuming a 2 bp homology (mh2_*)."""
    top = F.get(F.filter("del", lambda m: m["len"] > 0), F.lit(0))
    rows = found.withColumn("best", top)
    some = F.col("best").isNotNull()
    around = F.when(some, F.col("around"))  # only the surroundings of rows with a candidate reach Python
    scored = rows.withColumn("s", F.when(some, markov_udf(around, "best.cand", "best.dist", F.right("up", F.lit(2)))))
    out = scored.withColumns(
        {
            "del_mmej_cand": F.col("best.cand"),
            "del_mmej_cand_len": F.col("best.len"),
            "del_lk": F.nanvl("s.lk", F.lit(None)),
            "del_p_val": F.nanvl("s.p_val", F.lit(None)),
            "del_p_chance": F.nanvl("s.p_chance", F.lit(None)),
            "del_freq_eq": F.nanvl("s.freq_eq", F.lit(None)),
            "del_motif_count": F.when(some, S.motif_count(around, F.col("best.cand"))),
        }
    ).drop("s")
    if mh2:
        two = F.when(some & (F.col("indel_len") >= 2), markov_udf(around, "best.last_dimer", F.col("indel_len") - 2, F.right("up", F.lit(2))))
        out = out.withColumn("s", two).withColumns({"mh2_lk": F.nanvl("s.lk", F.lit(None)), "mh2_p_chance": F.nanvl("s.p_chance", F.lit(None))}).drop("s")
    return out.drop("best")


def combine(scored: DataFrame) -> DataFrame:
    """Likelihood and p-value columns of all mechanisms from the raw scores of deletions and insertions.

    Raw columns that are null mean: no pattern. indel_len becomes negative for deletions.
    """
    deleted, inserted = F.col("indel_type") == "DEL", F.col("indel_type") == "INS"
    snap_bc, loop_bc = F.coalesce("snap_bc", F.lit(1.0)), F.coalesce("loop_bc", F.lit(1.0))
    rows = scored.withColumns({"_snap": snap_bc, "_loop": loop_bc})
    rows = rows.withColumn("unclassified_ins_lk", F.when(inserted, F.col("_snap") * F.col("_loop")))
    rows = rows.withColumn("SDMMEJ_lk", F.when(inserted, 1 - F.col("unclassified_ins_lk")).otherwise(0.0))

    def share(name: str) -> Column:
        value = (1 - F.col(f"_{name}") + 0.5e-10) / (2 - F.col("_snap") - F.col("_loop")) * F.col("SDMMEJ_lk") + 1e-10
        return F.when(F.col(f"{name}_bc").isNotNull() & (F.col("_snap") + F.col("_loop") < 2), value).otherwise(0.0)

    rows = rows.withColumns({"SD_snap_lk": share("snap"), "SD_loop_lk": share("loop")})
    rows = rows.withColumn("del_mmej_lk", F.coalesce(1 - F.col("del_lk"), F.lit(0.0)))
    filled = {c: F.coalesce(c, F.lit(1.0)) for c in ("del_p_val", "del_p_chance", "snap_p_val", "snap_p_chance", "loop_p_val", "loop_p_chance")}
    rows = rows.withColumns(filled)
    rows = rows.withColumns(
        {
            "NHEJ_lk": F.when(deleted, 1 - F.col("del_mmej_lk")).otherwise(0.0),
            "NHEJ_p_val": F.when(deleted, 1 - F.col("del_p_val")).otherwise(1.0),
            "unclassified_ins_p_val": F.when(inserted, 1 - F.greatest("snap_p_val", "loop_p_val")).otherwise(1.0),
            "unclassified_ins": inserted & F.col("snap_bc").isNull() & F.col("loop_bc").isNull(),
            "NHEJ": deleted & F.col("del_lk").isNull(),
            "indel_len": S.signed_length(F.col("indel_type"), F.col("indel_len")),
        }
    )
    return rows.withColumn("variant_id_N", F.count(F.lit(1)).over(Window.partitionBy("variant_id"))).drop("_snap", "_loop")


def geometric_chance(rows: DataFrame, window: int = 2000) -> DataFrame:
    """Adds geo_lk and geo_p of a deletion's longest homology by a geometric model; both 1 without homology.

    The chance of the motif is its count in the window over the places it could start at. Rows may come with geo_count.
    """
    n = F.col("indel_len") - 1
    p = F.col("geo_count") / (2 * window - F.col("k_max") + 1)
    count = S.motif_count(F.when(F.col("k_max") > 0, F.col("around")), F.right("indel", F.col("k_max")))
    base = rows if "geo_count" in rows.columns else rows.withColumn("geo_count", count)
    scored = base.withColumn("_p", F.when(F.col("k_max") > 0, p)).withColumn("geo_lk", F.pow(1 - F.col("_p"), n) * F.col("_p"))
    scored = scored.withColumn("geo_p", (1 - F.pow(1 - F.col("geo_lk"), n)) * F.col("geo_lk"))
    return scored.withColumns({c: F.coalesce(c, F.lit(1.0)) for c in ("geo_lk", "geo_p")}).drop("_p", "geo_count")
