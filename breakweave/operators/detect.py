"""Repair-pattern detection around each indel.

Deletions: microhomology and polymerase slippage. Insertions: slippage, snap-back and loop-out. `up` ends at the
anchor base, `down` starts with the inserted (or deleted) bases. Direction 1 reads both sides reversed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from breakweave.functions import sequence as S
from breakweave.operators.cleaning import describe, with_tile

#: Longest microhomology that the synthesis-dependent patterns extend to.
MH_REACH = 19


def with_context(variants: DataFrame, genome: DataFrame, window: int = 50, longest: int | None = None, far: bool = False, tile: bool = False) -> DataFrame:
    """Adds up, down, indel and around (1000 bases on both sides). Keys and lengths come from `describe`.

    With far=True also around_far: the same about the other end of the bases that the reference has at the break. With
    tile=True base and tile_seq stay, and rows of a tile follow each other.
    `longest`: the longest indel, if known, see `with_tile`.
    """
    near = with_tile(describe(variants), genome, max(S.LARGE_WINDOW, window + 1), F.col("indel_len"), longest, deal=True)
    base, seq, pos, n = F.col("base"), F.col("tile_seq"), F.col("pos"), F.col("indel_len")
    wide = F.lit(window) + n
    deleted = F.col("indel_type") == "DEL"
    up = S.fetch(seq, pos - F.when(deleted, wide).otherwise(F.lit(window)), pos, base)
    rest = S.fetch(seq, pos, pos + F.when(deleted, wide + 1).otherwise(F.lit(window) + n + 1), base)
    indel = F.when(deleted, F.substring("anc", 2, 1 << 30)).otherwise(F.substring("der", 2, 1 << 30))
    end = pos + F.when(deleted, n).otherwise(0)
    return near.select(
        *[c for c in near.columns if tile or c not in ("base", "tile_seq")],
        *[S.fetch(seq, end - S.LARGE_WINDOW, end + S.LARGE_WINDOW, base).alias("around_far")] * far,
        indel.alias("indel"),
        up.alias("up"),
        F.when(deleted, rest).otherwise(F.concat(indel, rest)).alias("down"),
        S.fetch(seq, pos - S.LARGE_WINDOW, pos + S.LARGE_WINDOW, base).alias("around"),
        wide.alias("small_window"),
    ).withColumn("direction", F.lit(0))


def both_directions(rows: DataFrame, crispr: bool = False) -> DataFrame:
    """The rows and their reversed reading: of insertions only, or in CRISPR mode of all, with ids of their own.

    Read from the other side, a deletion's surroundings are those of its other end: around_far, reversed, where it is there.
    """
    # Both readings of a row are made from the row, whose surroundings are thus looked up once.
    read = F.array(F.lit(0), F.lit(1)) if crispr else F.when(F.col("indel_type") == "INS", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both = rows.withColumn("direction", F.explode(read))
    turned = F.col("direction") == 1
    tail = F.substring("down", F.col("indel_len") + 1, F.lit(1 << 30))
    sides = {
        "up": F.when(turned, F.reverse(tail)).otherwise(F.col("up")),
        "indel": F.when(turned, F.reverse("indel")).otherwise(F.col("indel")),
        "down": F.when(turned, F.concat(F.reverse("indel"), F.reverse("up"))).otherwise(F.col("down")),
    }
    if "around_far" in rows.columns:
        sides["around"] = F.when(turned & (F.col("indel_type") == "DEL"), F.reverse("around_far")).otherwise(F.col("around"))
    both = both.withColumns(sides).drop("around_far")
    return both.withColumn("variant_id", F.concat_ws(".", "variant_id", "direction")) if crispr else both


def longest_mh(rows: DataFrame) -> Column:
    return S.longest_common_suffix(F.col("indel"), F.col("up"))


def mh_candidates(lengths: list[int]) -> Column:
    """One struct for each asked length, longest first; 0 stands for the longest one beyond the others, and comes first.

    Needs k_max. A length that does not match has an empty candidate.
    """
    listed = sorted((k for k in lengths if k), reverse=True)
    most = max(listed, default=0)
    slots = ([F.when(F.col("k_max") > most, F.col("k_max")).otherwise(0)] if 0 in lengths else []) + [F.when(F.col("k_max") >= k, k).otherwise(0) for k in listed]
    asked = ([0] if 0 in lengths else []) + listed

    def one(want: int, k: Column) -> Column:
        cand = F.right(F.col("indel"), k)
        dimer = F.when(k == 1, F.concat(F.substring("up", -2, 1), cand)).otherwise(F.right(cand, F.lit(2)))
        return F.struct(
            F.lit(want).alias("asked"),
            F.when(k > 0, cand).otherwise("").alias("cand"),
            k.cast("int").alias("len"),
            F.when(k > 0, dimer).alias("last_dimer"),
            F.when(k > 0, F.col("indel_len") - k).cast("int").alias("dist"),
        )

    return F.array(*[one(a, k) for a, k in zip(asked, slots, strict=True)])


def deletion_candidates(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds k_max and mh (candidates) to deletions; nothing is looked for around the break."""
    return rows.where("indel_type = 'DEL'").withColumn("k_max", longest_mh(rows)).withColumn("mh", mh_candidates(lengths))


def detect_deletions(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds k_max and del (candidates with positions and frequencies of the motif around the break)."""
    found = deletion_candidates(rows, lengths)
    cands = F.transform("mh", lambda m: F.when(m["len"] > 0, m["cand"]))
    ends = found.withColumn("ends", S.all_motif_ends(F.col("around"), cands))
    small, around = F.col("small_window"), F.arrays_zip("mh", "ends")

    def filled(z: Column) -> Column:
        m, e = z["mh"], z["ends"]
        inside = F.size(F.filter(e, lambda p: (p - S.LARGE_WINDOW > -small) & (p - S.LARGE_WINDOW < small)))
        return F.struct(
            m["asked"].alias("asked"),
            m["cand"].alias("cand"),
            m["len"].alias("len"),
            m["last_dimer"].alias("last_dimer"),
            m["dist"].alias("dist"),
            S.motif_positions(e, small).alias("positions"),
            F.when(m["len"] > 0, S.motif_frequency(inside, small, m["cand"])).alias("freq_small"),
            F.when(m["len"] > 0, S.motif_frequency(F.size(e), S.LARGE_WINDOW, m["cand"])).alias("freq_large"),
        )

    return ends.withColumn("del", F.transform(around, filled)).drop("mh", "ends")


def detect_slippage(rows: DataFrame) -> DataFrame:
    """Adds slip: whether the indel's repeat unit ends `up`, the unit, and how often it follows in `down`."""
    unit = rows.withColumn("_unit", S.repeat_unit(F.col("indel")))
    k = F.length("_unit")
    steps = F.sequence(F.lit(1), F.greatest((F.length("down") / k).cast("int"), F.lit(1)))
    # Repeats at the start of `down` are nested: if j copies stand there, so do fewer.
    repeats = F.size(F.filter(steps, lambda j: F.left(F.col("down"), (j * k).cast("int")) == F.repeat(F.col("_unit"), j)))
    slips = (k > 0) & F.endswith(F.col("up"), F.col("_unit"))
    reach = k * repeats
    span = F.substring("around", F.lit(S.LARGE_WINDOW) - reach + 1, 2 * reach)
    places = F.transform(S.motif_ends(span, F.col("_unit")), lambda e: e - reach - 1)
    return unit.withColumn(
        "slip",
        F.struct(
            slips.alias("found"),
            F.when(slips, F.col("_unit")).alias("unit"),
            F.when(slips, repeats).alias("repeats"),
            F.when(slips & (repeats > 0), places).otherwise(F.array().cast("array<int>")).alias("positions"),
        ),
    ).drop("_unit")


def _snap(up: str, down: str, ins: str) -> dict | None:
    """Snap-back: the reverse complement of (MH2, insertion, P2) stands further down. Grown greedily, MH2 first, then P2."""
    turn = str.maketrans("ACGT", "TGCA")
    rc = lambda s: s.translate(turn)[::-1]
    n = len(ins)
    seed = up[-1:] + ins + down[n : n + 1]
    target = rc(seed)
    if len(seed) < n + 2 or target not in down[len(seed) :]:
        return None
    ground = down[len(seed) :]
    grown = 1
    for i in range(1, min(MH_REACH, len(up)) + 1):
        if target[:-1] + rc(up[-i:]) not in ground:
            break
        grown = i
    mh2 = up[-grown:]
    reach = 1
    for i in range(1, len(down) - n):
        if rc(mh2 + ins + down[n : n + i]) not in down[n + i :]:
            break
        reach = i
    p2 = down[n : n + reach]
    pattern = mh2 + ins + p2
    place = down[n + reach :].find(rc(pattern))
    if place < 0:  # the seed lies so near that the grown pattern has no room: the seed stands
        place, pattern, mh2, p2 = down[n + 1 :].find(target), seed, up[-1:], down[n : n + 1]
    return {"p1": rc(p2), "p2": p2, "mh1": rc(mh2), "mh2": mh2, "pattern": rc(pattern), "inv_comp_pattern": pattern, "last_dimer": pattern[-2:], "dist": place}


def _loop(up: str, down: str, ins: str) -> dict | None:
    """Loop-out: (MH2, insertion, P2) stands again further down. MH2 grows first, then P2, inside the gap between the two."""
    n = len(ins)
    mh2, p2 = up[-1:], down[n : n + 1]
    seed = mh2 + ins + p2
    if len(seed) < n + 2 or seed not in down[n + 2 :]:
        return None
    ground = down[n + 1 :]
    gap = ground.find(seed)
    pattern, at = seed, gap
    if gap > 1:
        for i in range(1, min(gap, len(up) + 1)):
            longer = up[-i:] + seed[1:]
            place = ground.find(longer)
            if place < 0:
                break
            mh2, pattern, at = up[-i:], longer, place
            if place < n + 1:
                break
        for i in range(1, min(gap, at + 1)):
            longer = mh2 + ins + down[n : n + i]
            if longer not in ground:
                break
            p2, pattern = down[n : n + i], longer
    place = down[n + len(p2) :].find(pattern)
    return {"p2": p2, "mh2": mh2, "pattern": pattern, "last_dimer": pattern[-2:], "dist": max(place, 0)}


def _fields(*names: str) -> T.StructType:
    return T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("dist", T.IntegerType())])


SNAP = _fields("p1", "p2", "mh1", "mh2", "pattern", "inv_comp_pattern", "last_dimer")
LOOP = _fields("p2", "mh2", "pattern", "last_dimer")


def _each(find, kind: T.StructType):
    """A pattern's function over columns (up, down, indel); null for nulls."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sides in batches:
            yield pa.array([None if x[0] is None else find(*x) for x in zip(*(c.to_pylist() for c in sides), strict=True)], to_arrow_type(kind))

    return run


snap_udf, loop_udf = _each(_snap, SNAP), _each(_loop, LOOP)


def seed_of() -> Column:
    """The base before the insertion, the insertion, and the base after it."""
    return F.concat(F.right("up", F.lit(1)), F.col("indel"), F.substring("down", F.col("indel_len") + 1, F.lit(1)))


def snap_seed() -> Column:
    n = F.col("indel_len")
    return F.contains(F.substring("down", n + 3, F.lit(1 << 30)), S.reverse_complement(seed_of()))


def loop_seed() -> Column:
    n = F.col("indel_len")
    return F.contains(F.substring("down", n + 3, F.lit(1 << 30)), seed_of())


def detect_insertions(rows: DataFrame) -> DataFrame:
    """Adds snap and loop (null if there is none). Of rows without a seed, which is a built-in test, nulls reach Python."""
    ins = rows.where("indel_type = 'INS'").withColumn("_snap", snap_seed()).withColumn("_loop", loop_seed())
    sides = lambda seed: [F.when(F.col(seed), F.col(c)) for c in ("up", "down", "indel")]
    return ins.withColumns({"snap": snap_udf(*sides("_snap")), "loop": loop_udf(*sides("_loop"))}).drop("_snap", "_loop")


def marked(up: Column, mh: Column, down: Column, width: int = 10) -> Column:
    """Display string: the sides of a break with the homology in brackets."""
    return F.concat(F.right(up, F.lit(width)), F.lit("["), mh, F.lit("]"), F.left(down, F.lit(width)))
