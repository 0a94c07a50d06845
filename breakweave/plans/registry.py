"""Registered queries of the indel operators, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breakweave.functions import sequence as S
from breakweave.operators import blocks, cleaning, detect, em, emq, evaluate, intervals, markov, reads, realign, simulate
from breakweave.plans import pipeline
from breakweave.sources import readers, scratch, world

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


CLEANED = world.SQL + """, polarised AS (
  SELECT *, CASE ancestral WHEN 0 THEN ref WHEN 1 THEN alt END AS anc, CASE ancestral WHEN 0 THEN alt WHEN 1 THEN ref END AS der FROM variants
), cleaned AS (
  SELECT p.*, seq, CASE WHEN length(anc) > length(der) THEN 'DEL' WHEN length(anc) < length(der) THEN 'INS' END AS indel_type,
    abs(length(anc) - length(der)) AS indel_len, p.chr || '_' || pos AS variant_id
  FROM polarised p JOIN genome g ON p.chr = g.chr
  WHERE anc IS NOT NULL AND length(ref) <> length(alt) AND pos > 1000 AND NOT contains(anc, 'N')
    AND NOT regexp_matches(substr(seq, pos - 999, 2000), '[^ACGT]')
)"""
DELETIONS = CLEANED + """, placed_up AS (
  SELECT *, substr(anc, 2) AS indel, substr(seq, pos - (50 + indel_len) + 1, 50 + indel_len) AS up,
    substr(seq, pos - 999, 2000) AS around FROM cleaned WHERE indel_type = 'DEL'
), deletions AS (
  SELECT *, len(list_filter(range(1, least(indel_len, length(up)) + 1), lambda k: right(indel, CAST(k AS INTEGER)) = right(up, CAST(k AS INTEGER)))) AS k_max FROM placed_up
)"""
INSERTIONS = CLEANED + """, insertions AS (
  SELECT *, substr(der, 2) AS indel, substr(seq, pos - 49, 50) AS up, substr(der, 2) || substr(seq, pos + 1, 51 + indel_len) AS down
  FROM cleaned WHERE indel_type = 'INS'
)"""


def cleaned(spark: SparkSession, d: str, contigs: DataFrame | None = None) -> DataFrame:
    contigs = world.genome(spark, d) if contigs is None else contigs
    return cleaning.clean(world.variants(spark, d, contigs), contigs)


def contexts(spark: SparkSession, d: str) -> DataFrame:
    contigs = world.genome(spark, d)
    return detect.with_context(cleaned(spark, d, contigs), contigs, longest=world.LONGEST)


def deletions(spark: SparkSession, d: str) -> DataFrame:
    rows = contexts(spark, d).where("indel_type = 'DEL'")
    return rows.withColumn("k_max", detect.longest_mh(rows))


# Sources and cleaning


@query(world.SQL + " SELECT chr, length(seq) AS n, length(seq) - length(replace(seq, 'N', '')) AS n_unknown, md5(seq) AS digest FROM genome")
def s6_genome(spark: SparkSession, d: str) -> DataFrame:
    return world.genome(spark, d).select("chr", F.length("seq").cast("long").alias("n"), F.length(F.regexp_replace("seq", "[^N]", "")).cast("long").alias("n_unknown"), F.md5("seq").alias("digest"))


@query(CLEANED + " SELECT chr, pos, anc, der, indel_type, CAST(indel_len AS BIGINT) AS indel_len, variant_id FROM cleaned")
def f1_f4_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = cleaning.describe(cleaned(spark, d))
    return rows.select("chr", "pos", "anc", "der", "indel_type", F.col("indel_len").cast("long").alias("indel_len"), "variant_id")


@query(CLEANED + " SELECT DISTINCT chr, pos, anc, der FROM cleaned")
def f5_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.dedupe(cleaned(spark, d)).select("chr", "pos", "anc", "der")


@query(CLEANED + " SELECT indel_type, CAST(count(*) AS BIGINT) AS n FROM cleaned WHERE indel_len <> 1 GROUP BY indel_type")
def f6_f7_by_type(spark: SparkSession, d: str) -> DataFrame:
    rows = cleaning.describe(cleaned(spark, d))
    signed = rows.withColumn("indel_len", S.signed_length(F.col("indel_type"), F.col("indel_len")))
    return cleaning.drop_single_base(signed).groupBy("indel_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT CASE l_returnflag WHEN 'A' THEN 'chr1' ELSE 'chr2' END AS chr, CAST(count(*) AS BIGINT) AS n
    FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1"""
)
def f8_chromosomes(spark: SparkSession, d: str) -> DataFrame:
    rows = world.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("chr"))
    return cleaning.rename_chromosomes(rows, {"A": "chr1", "N": "chr2"}).groupBy("chr").agg(F.count(F.lit(1)).alias("n"))


# Scalars


@query(
    CLEANED
    + """, s AS (SELECT variant_id, CASE WHEN length(anc) > length(der) THEN substr(anc, 2) ELSE substr(der, 2) END AS x, indel_len, indel_type FROM cleaned)
    SELECT variant_id, x, reverse(translate(x, 'ACTG', 'TGAC')) AS rc, CAST(CASE indel_type WHEN 'DEL' THEN -indel_len ELSE indel_len END AS BIGINT) AS signed_len,
      CASE WHEN indel_len < 10 THEN CAST(indel_len AS VARCHAR) WHEN indel_len < 15 THEN '10<=Indel<15' WHEN indel_len < 30 THEN '15<=Indel<30' ELSE '30<=Indel' END AS bin,
      CASE WHEN indel_type = 'DEL' AND indel_len > 10 THEN '[inf:-11]' WHEN indel_len > 10 THEN '[11:inf]' WHEN indel_type = 'DEL' THEN '-' || indel_len ELSE CAST(indel_len AS VARCHAR) END AS signed_bin,
      round(length(regexp_replace(x, '[^GC]', '', 'g')) / length(x), 6) AS gc,
      substr(x, 1, CAST(list_filter(range(1, length(x) + 1), lambda i: length(x) % i = 0 AND repeat(substr(x, 1, CAST(i AS INTEGER)), length(x) // i) = x)[1] AS INTEGER)) AS unit
    FROM s"""
)
def p5_p22_scalars(spark: SparkSession, d: str) -> DataFrame:
    rows = cleaning.describe(cleaned(spark, d))
    x = F.when(F.col("indel_type") == "DEL", F.substring("anc", 2, 1 << 30)).otherwise(F.substring("der", 2, 1 << 30))
    rows = rows.withColumn("x", x).withColumn("signed_len", S.signed_length(F.col("indel_type"), F.col("indel_len")).cast("long"))
    return rows.select(
        "variant_id",
        "x",
        S.reverse_complement(F.col("x")).alias("rc"),
        "signed_len",
        S.length_bin(F.col("indel_len")).alias("bin"),
        S.signed_length_bin(F.col("signed_len")).alias("signed_bin"),
        F.round(S.gc_content(F.col("x")), 6).alias("gc"),
        S.repeat_unit(F.col("x")).alias("unit"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN 1 - l_tax > l_tax + l_discount THEN 0 WHEN l_tax + l_discount > 1 - l_tax THEN 1 ELSE 2 END AS ancestral
    FROM lineitem"""
)
def p2_ancestral_state(spark: SparkSession, d: str) -> DataFrame:
    rows = world.read(spark, d, "lineitem")
    ref = F.concat(F.lit("A:"), 1 - F.col("l_tax"))
    return rows.select("l_orderkey", "l_linenumber", S.ancestral_state(S.frequency_value(ref), F.col("l_tax") + F.col("l_discount")).alias("ancestral"))


@query(
    CLEANED
    + """ SELECT variant_id, md5(substr(seq, pos - 49, 101 + length(ref) - 1)) AS reference,
    md5(substr(substr(seq, pos - 49, 100 + length(ref)), 1, 49) || alt || substr(substr(seq, pos - 49, 100 + length(ref)), 50 + length(ref))) AS mutant FROM cleaned"""
)
def p10_p11_contexts(spark: SparkSession, d: str) -> DataFrame:
    contigs = world.genome(spark, d)
    near = cleaning.with_tile(cleaning.describe(cleaned(spark, d, contigs)), contigs, 256)
    context = S.fetch(F.col("tile_seq"), F.col("pos") - 50, F.col("pos") + 50 + F.length("ref"), F.col("base"))
    return near.select("variant_id", F.md5(context).alias("reference"), F.md5(S.spliced(context, 49, F.col("ref"), F.col("alt"))).alias("mutant"))


@query(
    CLEANED
    + """ SELECT variant_id, translate(regexp_replace(upper(alt || 'nx'), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA') AS complement, '>' || chr || ':' || (pos - 50) || '-' || (pos + 50) AS key,
    CASE WHEN indel_len / 30.0 > 0.2 AND length(alt) > 1 THEN 'DEL' ELSE 'INS' END AS kind, indel_len / 30.0 >= 0.5 AND indel_len / 60.0 >= 0.3 AS certain FROM cleaned"""
)
def p9_p26_scalars(spark: SparkSession, d: str) -> DataFrame:
    rows = cleaning.describe(cleaned(spark, d))
    pos, n = F.col("pos"), F.col("indel_len")
    return rows.select(
        "variant_id",
        S.complement(F.concat("alt", F.lit("nx"))).alias("complement"),
        S.context_key(F.col("chr"), (pos - 50).cast("string"), (pos + 50).cast("string")).alias("key"),
        S.type_by_frequency(F.col("alt"), n / 30.0, 0.2).alias("kind"),
        S.certain(n / 30.0, n / 60.0, 0.5, 0.3).alias("certain"),
    )


MOTIF = DELETIONS + """, hits AS (
  SELECT variant_id, indel, indel_len, right(indel, 2) AS motif, list_transform(list_filter(list_zip(letters, letters[2:], range(1, length(around) + 1)), lambda t: t[1] = right(indel, 2)[1] AND t[2] = right(indel, 2)[2]), lambda t: t[3] + 1 - 1000) AS p
  FROM (SELECT *, string_split(around, '') AS letters FROM deletions) WHERE indel_len >= 2
)"""


@query(
    MOTIF
    + """ SELECT variant_id, motif, array_to_string(list_transform(list_filter(p, lambda x: abs(x) < 50 + indel_len), lambda x: x - 1), ',') AS positions,
    round(len(p) / (1000 - 2), 5) AS freq_large, round(len(list_filter(p, lambda x: abs(x) < 50 + indel_len)) / (50 + indel_len - 2), 5) AS freq_small FROM hits"""
)
def p13_p14_motifs(spark: SparkSession, d: str) -> DataFrame:
    rows = deletions(spark, d).where("indel_len >= 2").withColumn("motif", F.right("indel", F.lit(2)))
    rows = rows.withColumn("ends", S.motif_ends(F.col("around"), F.col("motif")))
    small = F.col("small_window")
    inside = F.size(F.filter("ends", lambda e: F.abs(e - S.LARGE_WINDOW) < small))
    return rows.select(
        "variant_id",
        "motif",
        F.array_join(S.motif_positions(F.col("ends"), small).cast("array<string>"), ",").alias("positions"),
        S.motif_frequency(F.size("ends"), S.LARGE_WINDOW, F.col("motif")).alias("freq_large"),
        S.motif_frequency(inside, small, F.col("motif")).alias("freq_small"),
    )


#: Enthalpy and entropy of a stack in SQL, from the fixed values of both strands.
STACK_SQL = [
    "CASE substr(x, CAST(i AS INTEGER), 2) " + " ".join(f"WHEN '{p}' THEN {v[k]}" for pair, v in S.STACKS.items() for p in {pair, pair[::-1].translate(str.maketrans("ACGT", "TGCA"))}) + " END"
    for k in (0, 1)
]


@query(
    MOTIF
    + f""", t AS (SELECT variant_id, p, indel AS x FROM hits),
    s AS (SELECT variant_id, p, x, CAST(left(x, 1) IN ('A', 'T') AS INTEGER) + CAST(right(x, 1) IN ('A', 'T') AS INTEGER) AS weak,
      list_sum(list_transform(range(1, length(x)), lambda i: {STACK_SQL[0]})) AS h, list_sum(list_transform(range(1, length(x)), lambda i: {STACK_SQL[1]})) AS s FROM t)
    SELECT variant_id, coalesce(array_to_string(list_filter(list_transform(p, lambda e: list_filter(p, lambda y: y >= e + 2)[1] - 2 - e), lambda g: g IS NOT NULL), ','), '') AS gaps,
      round(1000 * (h + 2.3 * weak + 0.1 * (2 - weak)) / (s + 4.1 * weak - 2.8 * (2 - weak) + 0.368 * (length(x) - 1) * ln(0.05) + 1.987 * ln(1.25e-8)) - 273.15, 6) AS tm FROM s"""
)
def p16_p20_gaps_and_melting(spark: SparkSession, d: str) -> DataFrame:
    rows = deletions(spark, d).where("indel_len >= 2").withColumn("motif", F.right("indel", F.lit(2)))
    ends = S.motif_ends(F.col("around"), F.col("motif"))
    return rows.withColumn("ends", ends).select(
        "variant_id", F.array_join(S.motif_gaps(F.col("ends"), F.col("motif")).cast("array<string>"), ",").alias("gaps"), F.round(S.melting_temperature(F.col("indel")), 6).alias("tm")
    )


# Realignment and detection


@query(
    CLEANED
    + """, affix AS (
      SELECT variant_id, pos, anc, der, substr(seq, pos - 149, 150) AS up, CASE WHEN length(ref) > length(alt) THEN substr(ref, 2) ELSE substr(alt, 2) END AS x,
        substr(seq, pos + length(ref), 150) AS down FROM cleaned
    ), runs AS (
      SELECT *, length(x) AS n,
        len(list_filter(range(1, length(up)), lambda k: right(up, CAST(k AS INTEGER)) = right(up || x, CAST(k AS INTEGER)))) AS l,
        len(list_filter(range(1, length(down)), lambda k: left(down, CAST(k AS INTEGER)) = left(x || down, CAST(k AS INTEGER)))) AS r FROM affix
    ), shifts AS (SELECT *, unnest(range(-CAST(l AS BIGINT), CAST(r AS BIGINT) + 1)) AS s FROM runs)
    SELECT variant_id, CAST(pos + s AS BIGINT) AS pos, CAST(s + l + 1 AS BIGINT) AS realign_idx,
      CASE WHEN length(anc) > length(der) THEN substr(up || x || down, CAST(length(up) + s AS INTEGER), CAST(n + 1 AS INTEGER)) ELSE substr(up || x || down, CAST(length(up) + s AS INTEGER), 1) END AS anc,
      CASE WHEN length(anc) > length(der) THEN substr(up || x || down, CAST(length(up) + s AS INTEGER), 1) ELSE substr(up || x || down, CAST(length(up) + s AS INTEGER), CAST(n + 1 AS INTEGER)) END AS der
    FROM shifts"""
)
def r1_realign(spark: SparkSession, d: str) -> DataFrame:
    contigs = world.genome(spark, d)
    rows = realign.realign(cleaned(spark, d, contigs), contigs, longest=world.LONGEST)
    return rows.select(S.variant_id(F.col("chr"), F.col("original_pos")).alias("variant_id"), "pos", F.col("realign_idx").cast("long").alias("realign_idx"), "anc", "der")


@query(None)
def r1_r2_complex_rows(spark: SparkSession, d: str) -> DataFrame:
    """Alleles that share no anchor, placed by both modes of the aligner."""
    contigs = world.genome(spark, d)
    rows = cleaned(spark, d, contigs).where(F.length("anc") > 2)
    turned = rows.withColumn("der", F.reverse(F.substring("anc", 2, 2))).withColumns({"ref": F.col("anc"), "alt": F.col("der")}).distinct()
    turned = scratch.written(turned, "complex")
    both = None
    for mode in ("local", "global"):
        placed = realign.realign(turned, contigs, flank=40, longest=world.LONGEST, mode=mode).withColumn("mode", F.lit(mode))
        both = placed if both is None else both.unionByName(placed)
    return both.select(S.variant_id(F.col("chr"), F.col("original_pos")).alias("variant_id"), "mode", "realign_mode", "realign_idx", "pos", "anc", "der")


@query(DELETIONS + " SELECT CAST(k_max AS BIGINT) AS k_max, CAST(count(*) AS BIGINT) AS n FROM deletions GROUP BY k_max")
def a19_mh_length_distribution(spark: SparkSession, d: str) -> DataFrame:
    return blocks.mh_lengths(deletions(spark, d)).select(F.col("k_max").cast("long").alias("k_max"), "n")


@query(DELETIONS + " SELECT CAST(count_if(k_max >= 4) AS BIGINT) AS n_long, CAST(count_if(k_max > 0 AND k_max < 4) AS BIGINT) AS n_short FROM deletions")
def a19_mh_tail(spark: SparkSession, d: str) -> DataFrame:
    return blocks.mh_tail(deletions(spark, d))


@query(
    DELETIONS
    + """, slots AS (SELECT *, unnest([0, 4, 3, 2, 1]) AS asked FROM deletions), sized AS (
      SELECT *, CASE WHEN asked = 0 THEN CASE WHEN k_max > 4 THEN k_max ELSE 0 END WHEN k_max >= asked THEN asked ELSE 0 END AS k FROM slots)
    SELECT variant_id, CAST(asked AS INTEGER) AS asked, right(indel, CAST(k AS INTEGER)) AS cand, CAST(k AS BIGINT) AS len,
      CASE WHEN k = 1 THEN substr(up, length(up) - 1, 1) || right(indel, 1) WHEN k > 0 THEN right(right(indel, CAST(k AS INTEGER)), 2) END AS last_dimer,
      CAST(CASE WHEN k > 0 THEN indel_len - k ELSE -1 END AS BIGINT) AS dist FROM sized"""
)
def m1_deletion_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = detect.detect_deletions(contexts(spark, d), [4, 3, 2, 1, 0]).select("variant_id", F.explode_outer("del").alias("m"))
    return found.select("variant_id", "m.asked", "m.cand", F.col("m.len").cast("long").alias("len"), "m.last_dimer", F.coalesce("m.dist", F.lit(-1)).cast("long").alias("dist"))


@query(
    DELETIONS
    + """, units AS (
      SELECT *, substr(indel, 1, CAST(list_filter(range(1, length(indel) + 1), lambda i: length(indel) % i = 0 AND repeat(substr(indel, 1, CAST(i AS INTEGER)), length(indel) // i) = indel)[1] AS INTEGER)) AS unit,
        substr(seq, pos + 1, 51 + indel_len) AS down FROM deletions)
    SELECT variant_id, ends_with(up, unit) AS found, CASE WHEN ends_with(up, unit) THEN unit END AS unit,
      CAST(CASE WHEN ends_with(up, unit) THEN len(list_filter(range(1, length(down) // length(unit) + 1), lambda j: left(down, CAST(j * length(unit) AS INTEGER)) = repeat(unit, CAST(j AS INTEGER)))) ELSE 0 END AS BIGINT) AS repeats
    FROM units"""
)
def m2_slippage(spark: SparkSession, d: str) -> DataFrame:
    found = detect.detect_slippage(contexts(spark, d).where("indel_type = 'DEL'"))
    return found.select("variant_id", "slip.found", "slip.unit", F.coalesce("slip.repeats", F.lit(0)).cast("long").alias("repeats"))


@query(
    INSERTIONS
    + """, seeds AS (SELECT *, right(up, 1) || indel || substr(down, indel_len + 1, 1) AS seed, substr(down, indel_len + 3) AS ground FROM insertions)
    SELECT variant_id, contains(ground, reverse(translate(seed, 'ACTG', 'TGAC'))) AS snap, contains(ground, seed) AS loop_out FROM seeds"""
)
def m3_m4_seeds(spark: SparkSession, d: str) -> DataFrame:
    rows = contexts(spark, d).where("indel_type = 'INS'")
    return rows.select("variant_id", detect.snap_seed().alias("snap"), detect.loop_seed().alias("loop_out"))


@query(None)
def m3_m4_patterns(spark: SparkSession, d: str) -> DataFrame:
    found = detect.detect_insertions(detect.both_directions(contexts(spark, d)))
    return found.where("snap is not null or loop is not null").select("variant_id", "direction", "snap", "loop")


def turned_sql(text: str) -> str:
    return f"reverse(translate({text}, 'ACTG', 'TGAC'))"


#: Greedy growth step by step is a count here: a pattern that is found holds the shorter ones, which are found as well.
PATTERNS = INSERTIONS + f""", sides AS (
  SELECT variant_id, 0 AS direction, CAST(indel_len AS BIGINT) AS n, up, indel AS ins, down FROM insertions
  UNION ALL SELECT variant_id, 1, CAST(indel_len AS BIGINT), reverse(substr(down, CAST(indel_len + 1 AS BIGINT))), reverse(indel), reverse(indel) || reverse(up) FROM insertions
), seeds AS (SELECT *, right(up, 1) || ins || substr(down, n + 1, 1) AS seed, substr(down, n + 3) AS ground, substr(down, n + 2) AS lower_ground FROM sides
), seeded AS (SELECT *, {turned_sql("seed")} AS target, strpos(lower_ground, seed) - 1 AS gap FROM seeds WHERE length(seed) = n + 2
), snaps AS (SELECT *, right(up, CAST(greatest(1, len(list_filter(range(1, least(19, length(up)) + 1), lambda i: contains(ground, left(target, length(target) - 1) || {turned_sql("right(up, CAST(i AS INTEGER))")})))) AS INTEGER)) AS mh2 FROM seeded WHERE contains(ground, target)
), snap_reach AS (SELECT *, CAST(greatest(1, len(list_filter(range(1, CAST(length(down) - n AS BIGINT)), lambda i: contains(substr(down, CAST(n + i + 1 AS BIGINT)), {turned_sql("mh2 || ins || substr(down, n + 1, CAST(i AS BIGINT))")})))) AS BIGINT) AS reach FROM snaps
), snap_grown AS (SELECT *, mh2 || ins || substr(down, n + 1, reach) AS grown, strpos(substr(down, n + reach + 1), {turned_sql("mh2 || ins || substr(down, n + 1, reach)")}) - 1 AS place FROM snap_reach
), snap AS (SELECT variant_id, direction, up, ins, down, CASE WHEN place < 0 THEN right(up, 1) ELSE mh2 END AS mh2, substr(down, n + 1, CASE WHEN place < 0 THEN 1 ELSE reach END) AS p2,
    {turned_sql("CASE WHEN place < 0 THEN seed ELSE grown END")} AS pattern, CASE WHEN place < 0 THEN strpos(lower_ground, target) - 1 ELSE place END AS dist FROM snap_grown
), loops AS (SELECT *, list_transform(range(1, CASE WHEN gap > 1 THEN least(gap, length(up) + 1) ELSE 1 END), lambda i: strpos(lower_ground, right(up, CAST(i AS INTEGER)) || substr(seed, 2)) - 1) AS found FROM seeded WHERE contains(substr(down, n + 3), seed)
), loop_steps AS (SELECT *, len(list_filter(found, lambda x: x >= 0)) AS all_found, list_position(list_transform(found, lambda x: x >= 0 AND x < n + 1), true) AS near FROM loops
), loop_mh AS (SELECT *, CASE WHEN all_found = 0 THEN 1 WHEN near > 0 THEN least(near, all_found) ELSE all_found END AS taken FROM loop_steps
), loop_at AS (SELECT *, right(up, CAST(taken AS INTEGER)) AS mh2, CASE WHEN len(found) = 0 OR all_found = 0 THEN gap ELSE found[taken] END AS spot FROM loop_mh
), loop_reach AS (SELECT *, CAST(CASE WHEN gap > 1 THEN greatest(1, len(list_filter(range(1, least(gap, spot + 1)), lambda i: contains(lower_ground, mh2 || ins || substr(down, n + 1, CAST(i AS BIGINT)))))) ELSE 1 END AS BIGINT) AS reach FROM loop_at
), loop AS (SELECT variant_id, direction, up, ins, down, mh2, substr(down, n + 1, reach) AS p2, mh2 || ins || substr(down, n + 1, reach) AS pattern, greatest(strpos(substr(down, n + reach + 1), mh2 || ins || substr(down, n + 1, reach)) - 1, 0) AS dist FROM loop_reach)
SELECT 'snap' AS kind, variant_id, direction, ins, mh2, p2, pattern, CAST(dist AS BIGINT) AS dist FROM snap UNION ALL SELECT 'loop', variant_id, direction, ins, mh2, p2, pattern, CAST(dist AS BIGINT) FROM loop"""


@query(PATTERNS)
def m3_m4_pattern_fields(spark: SparkSession, d: str) -> DataFrame:
    """A row a snap-back or loop-out pattern."""
    found = scratch.written(detect.detect_insertions(detect.both_directions(contexts(spark, d))).select("variant_id", "direction", "indel", "snap", "loop"), "patterns")
    kinds = []
    for kind in ("snap", "loop"):
        p = F.col(kind)
        kinds.append(found.where(p.isNotNull()).select(F.lit(kind).alias("kind"), "variant_id", "direction", F.col("indel").alias("ins"), p["mh2"].alias("mh2"), p["p2"].alias("p2"), p["pattern"].alias("pattern"), p["dist"].cast("long").alias("dist")))
    return kinds[0].unionByName(kinds[1])


@query(CLEANED + " SELECT indel_type, CAST(count(*) * CASE indel_type WHEN 'INS' THEN 2 ELSE 1 END AS BIGINT) AS n FROM cleaned GROUP BY indel_type")
def m7_directions(spark: SparkSession, d: str) -> DataFrame:
    return detect.both_directions(contexts(spark, d)).groupBy("indel_type").agg(F.count(F.lit(1)).alias("n"))


@query(DELETIONS + " SELECT variant_id, right(up, 10) || '[' || right(indel, CAST(k_max AS INTEGER)) || ']' || left(substr(seq, pos + 1, 51 + indel_len), 10) AS shown FROM deletions")
def m6_display(spark: SparkSession, d: str) -> DataFrame:
    return deletions(spark, d).select("variant_id", detect.marked(F.col("up"), F.right("indel", F.col("k_max")), F.col("down")).alias("shown"))


# Markov model


@query(
    world.SQL
    + """, grams AS (SELECT chr AS id, unnest(list_transform(range(1, length(seq) - 1), lambda i: substr(seq, CAST(i AS INTEGER), 3))) AS g FROM genome)
    SELECT id, left(g, 2) AS dimer, right(g, 1) AS base, CAST(count(*) AS BIGINT) AS n FROM grams WHERE NOT contains(g, 'N') GROUP BY ALL"""
)
def k2_trimer_counts(spark: SparkSession, d: str) -> DataFrame:
    return markov.genome_trimers(world.genome(spark, d)).withColumnRenamed("chr", "id")


@query(
    world.SQL
    + """, grams AS (SELECT chr AS id, unnest(list_transform(range(1, length(seq) - 1), lambda i: substr(seq, CAST(i AS INTEGER), 3))) AS g FROM genome),
    counts AS (SELECT id, g, count(*) AS n FROM grams WHERE NOT contains(g, 'N') GROUP BY ALL),
    bases AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b),
    grid AS (SELECT chr AS id, x.b || y.b AS dimer, z.b AS base FROM genome, bases x, bases y, bases z),
    filled AS (SELECT grid.*, coalesce(n, 0) + 1e-6 AS n FROM grid LEFT JOIN counts c ON c.id = grid.id AND c.g = dimer || base)
    SELECT id, dimer, base, round(n / sum(n) OVER (PARTITION BY id, dimer), 9) AS p FROM filled"""
)
def k3_transition_table(spark: SparkSession, d: str) -> DataFrame:
    contigs = world.genome(spark, d)
    table = markov.shares(markov.genome_trimers(contigs), contigs.select("chr").distinct(), "chr")
    return table.select(F.col("chr").alias("id"), "dimer", "base", F.round("p", 9).alias("p"))


def recursive(sql: str) -> str:
    return "WITH RECURSIVE" + sql.lstrip().removeprefix("WITH")


def state_sql(state: str, m: str) -> str:
    """The next state: sixteen sums over the base that falls out of memory. Lists are from 1, codes from 0."""
    terms = " + ".join(f"{state}[CAST({4 * a} + i // 4 + 1 AS BIGINT)] * {m}[CAST({16 * a} + i + 1 AS BIGINT)]" for a in range(4))
    return f"list_transform(range(0, 16), lambda i: {terms})"


def code_sql(text: str, at: str) -> str:
    return f"(strpos('ACGT', substr({text}, CAST({at} AS BIGINT), 1)) - 1)"


#: picked: deletions with their best homology; tables: the 64 transition probabilities of a row and its 16 dimer frequencies.
MARKOV = recursive(DELETIONS) + f""", picked AS MATERIALIZED (SELECT row_number() OVER () AS rid, variant_id, indel, indel_len, up, around, k_max, right(indel, CAST(k_max AS INTEGER)) AS cand FROM deletions WHERE k_max >= 2),
grid AS (SELECT CAST(i AS BIGINT) AS code, substr('ACGT', CAST(i // 16 + 1 AS BIGINT), 1) || substr('ACGT', CAST(i // 4 % 4 + 1 AS BIGINT), 1) || substr('ACGT', CAST(i % 4 + 1 AS BIGINT), 1) AS g FROM range(64) t(i)),
grams AS MATERIALIZED (SELECT rid, g, count(*) AS n FROM (SELECT rid, unnest(list_transform(range(1, length(around) - 1), lambda i: substr(around, CAST(i AS BIGINT), 3))) AS g FROM picked) GROUP BY ALL),
shares AS (SELECT p.rid, code, coalesce(n, 0) AS n, (coalesce(n, 0) + 1e-6) / sum(coalesce(n, 0) + 1e-6) OVER (PARTITION BY p.rid, code // 4) AS p FROM picked p CROSS JOIN grid LEFT JOIN grams c ON c.rid = p.rid AND c.g = grid.g),
dimers AS (SELECT s.rid, code // 4 AS ab, sum(n) AS n FROM shares s GROUP BY ALL),
frequencies AS (SELECT d.rid, list((n + CASE WHEN ab = 4 * {code_sql("around", "length(around) - 1")} + {code_sql("around", "length(around)")} THEN 1 ELSE 0 END) / (length(around) - 1) + 1e-6 ORDER BY ab) AS f FROM dimers d JOIN picked USING (rid) GROUP BY d.rid),
tables AS MATERIALIZED (SELECT rid, list(p ORDER BY code) AS m FROM shares GROUP BY rid),
jobs AS (SELECT rid, 1 AS kind, cand AS motif, indel_len - k_max AS dist FROM picked UNION ALL SELECT rid, 2, right(indel, 2), indel_len - 2 FROM picked),
job AS MATERIALIZED (SELECT j.*, m, {code_sql("right(up, 2)", "1")} AS a, {code_sql("right(up, 2)", "2")} AS b, 4 * {code_sql("motif", "1")} + {code_sql("motif", "2")} + 1 AS spot,
  coalesce(list_product(list_transform(range(1, length(motif) - 1), lambda i: m[CAST(16 * {code_sql("motif", "i")} + 4 * {code_sql("motif", "i + 1")} + {code_sql("motif", "i + 2")} + 1 AS BIGINT)])), 1.0) AS tail
  FROM jobs j JOIN tables USING (rid) JOIN picked p ON p.rid = j.rid)"""
WALK = f""", walk AS (
  SELECT rid, kind, 1 AS t, list_transform(range(0, 16), lambda i: CASE WHEN i // 4 = b THEN m[CAST(16 * a + 4 * b + i % 4 + 1 AS BIGINT)] ELSE 0.0 END) AS s, CAST(1 AS DOUBLE) AS q, CAST(1 AS DOUBLE) AS q_first, CAST(0 AS DOUBLE) AS lk, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS p_val FROM job
  UNION ALL
  SELECT rid, kind, t + 1, s2, q * abs(1 - p2), CASE WHEN t = 1 THEN q * abs(1 - p2) ELSE q_first END, q * (1 - abs(1 - p2)), p2, CASE WHEN t > 1 THEN q_first - q * abs(1 - p2) ELSE 0 END
  FROM (SELECT *, s2[spot] * tail AS p2 FROM (SELECT w.*, spot, tail, {state_sql("s", "m")} AS s2 FROM walk w JOIN job j ON w.rid = j.rid AND w.kind = j.kind WHERE t < dist + 2))
), ended AS (SELECT w.* FROM walk w JOIN job j ON w.rid = j.rid AND w.kind = j.kind WHERE t = dist + 2),
far AS (SELECT rid, {state_sql("e", "m")}[spot] * tail AS freq_eq FROM (
  SELECT j.*, list_transform(range(0, 16), lambda i: CASE WHEN i // 4 = b THEN list_sum(list_transform(range(0, 16), lambda x: f[x + 1] * m[CAST(4 * x + i % 4 + 1 AS BIGINT)])) ELSE 0.0 END) AS e FROM job j JOIN frequencies USING (rid) WHERE kind = 1))"""


@query(
    MARKOV
    + WALK
    + """ SELECT d.variant_id, cand AS del_mmej_cand, round(x.lk, 9) AS del_lk, round(x.p_val, 9) AS del_p_val, round(x.p, 9) AS del_p_chance, round(freq_eq, 9) AS del_freq_eq, round(y.lk, 9) AS mh2_lk
    FROM picked d JOIN ended x ON x.rid = d.rid AND x.kind = 1 JOIN ended y ON y.rid = d.rid AND y.kind = 2 JOIN far ON far.rid = d.rid
    UNION ALL SELECT variant_id, NULL, NULL, NULL, NULL, NULL, NULL FROM deletions WHERE k_max < 2"""
)
def k10_markov_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = detect.detect_deletions(contexts(spark, d), [0, 2])
    return markov.score_deletions(rows).select("variant_id", "del_mmej_cand", *[F.round(c, 9).alias(c) for c in ("del_lk", "del_p_val", "del_p_chance", "del_freq_eq", "mh2_lk")])


@query(
    MARKOV
    + f""", own AS (SELECT j.*, indel_len, 4 * {code_sql("motif", "length(motif) - 1")} + {code_sql("motif", "length(motif)")} AS final,
      m[CAST(4 * (4 * {code_sql("motif", "length(motif) - 1")} + {code_sql("motif", "length(motif)")}) + {code_sql("motif", "1")} + 1 AS BIGINT)]
      * m[CAST(16 * {code_sql("motif", "length(motif)")} + 4 * {code_sql("motif", "1")} + {code_sql("motif", "2")} + 1 AS BIGINT)] * tail AS pm FROM job j JOIN picked USING (rid) WHERE kind = 1
    ), walk AS (
      SELECT rid, 0 AS t, list_transform(range(0, 16), lambda i: CASE WHEN i = 4 * a + b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS s, 1 - (CASE WHEN final = 4 * a + b THEN 1 ELSE 0 END + 1e-6::DOUBLE) * pm AS missed FROM own
      UNION ALL
      SELECT rid, t + 1, s2, missed * (1 - (s2[final + 1] + 1e-6) * pm) FROM (SELECT w.*, final, pm, {state_sql("s", "m")} AS s2 FROM walk w JOIN own o ON w.rid = o.rid WHERE t < indel_len - 1)
    ) SELECT variant_id, cand, round(1 - missed, 9) AS total FROM walk w JOIN picked p ON w.rid = p.rid WHERE t = indel_len - 1"""
)
def k11_total_probability(spark: SparkSession, d: str) -> DataFrame:
    rows = deletions(spark, d).where("k_max >= 2").withColumn("cand", F.right("indel", F.col("k_max")))
    return rows.select("variant_id", "cand", F.round(markov.total_probability_udf("around", "cand", "indel_len", F.right("up", F.lit(2))), 9).alias("total"))


@query(None)
def k_combined_scores(spark: SparkSession, d: str) -> DataFrame:
    contigs = world.genome(spark, d)
    return pipeline.scored(world.variants(spark, d, contigs), contigs, longest=world.LONGEST)


GEOMETRIC = DELETIONS + """, g AS (
  SELECT variant_id, k_max, indel_len - 1 AS n, right(indel, CAST(k_max AS INTEGER)) AS mh, len(list_filter(range(1, 2000 - k_max + 2), lambda i: substr(around, CAST(i AS INTEGER), CAST(k_max AS INTEGER)) = right(indel, CAST(k_max AS INTEGER)))) AS c FROM deletions
), p AS (SELECT *, c / (4000 - k_max + 1) AS p FROM g), lk AS (SELECT *, pow(1 - p, n) * p AS l FROM p)"""


@query(GEOMETRIC + " SELECT variant_id, round(CASE WHEN k_max > 0 THEN l ELSE 1.0 END, 11) AS geo_lk, round(CASE WHEN k_max > 0 THEN (1 - pow(1 - l, n)) * l ELSE 1.0 END, 11) AS geo_p FROM lk")
def k12_geometric(spark: SparkSession, d: str) -> DataFrame:
    return markov.geometric_chance(deletions(spark, d)).select("variant_id", F.round("geo_lk", 11).alias("geo_lk"), F.round("geo_p", 11).alias("geo_p"))


# Expectation-maximisation

REALIGNED = CLEANED + """, affix AS (
  SELECT chr, seq, pos, anc, der, substr(seq, pos - 149, 150) AS aup, CASE WHEN length(ref) > length(alt) THEN substr(ref, 2) ELSE substr(alt, 2) END AS x, substr(seq, pos + length(ref), 150) AS adown FROM cleaned
), runs AS (
  SELECT *, length(x) AS n,
    len(list_filter(range(1, length(aup)), lambda k: right(aup, CAST(k AS INTEGER)) = right(aup || x, CAST(k AS INTEGER)))) AS l,
    len(list_filter(range(1, length(adown)), lambda k: left(adown, CAST(k AS INTEGER)) = left(x || adown, CAST(k AS INTEGER)))) AS r FROM affix
), shifts AS (SELECT *, unnest(range(-CAST(l AS BIGINT), CAST(r AS BIGINT) + 1)) AS s, aup || x || adown AS whole FROM runs
), moved AS (
  SELECT chr, seq, pos + s AS pos, pos AS original_pos, s + l + 1 AS realign_idx, length(anc) > length(der) AS deletes, substr(whole, CAST(length(aup) + s AS INTEGER), CAST(n + 1 AS INTEGER)) AS wide, substr(whole, CAST(length(aup) + s AS INTEGER), 1) AS one FROM shifts
), realigned AS (
  SELECT chr, seq, pos, original_pos, realign_idx, CASE WHEN deletes THEN wide ELSE one END AS anc, CASE WHEN deletes THEN one ELSE wide END AS der,
    CASE WHEN deletes THEN 'DEL' ELSE 'INS' END AS indel_type, length(wide) - 1 AS indel_len, chr || '_' || original_pos AS variant_id
  FROM moved QUALIFY row_number() OVER (PARTITION BY chr, pos, deletes, wide, one ORDER BY original_pos, realign_idx) = 1
)"""
REALIGNED_DELETIONS = REALIGNED + """, placed_up AS (
  SELECT *, substr(anc, 2) AS indel, substr(seq, greatest(pos - (50 + indel_len) + 1, 1), 50 + indel_len) AS up, substr(seq, greatest(pos - 999, 1), 1000 + least(pos, 1000)) AS around FROM realigned WHERE indel_type = 'DEL'
), deletions AS (
  SELECT *, len(list_filter(range(1, least(indel_len, length(up)) + 1), lambda k: right(indel, CAST(k AS INTEGER)) = right(up, CAST(k AS INTEGER)))) AS k_max FROM placed_up
)"""


def realigned_deletions(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct placement of every deletion, with its contexts and longest homology."""
    contigs = world.genome(spark, d)
    # All line items are pure indels, whose placements keep their type; they move once to be deduplicated and to meet their tiles.
    moved = realign.realign(cleaned(spark, d, contigs).where("length(anc) > length(der)"), contigs, longest=world.LONGEST)
    rows = cleaning.dedupe(cleaning.dealt(moved.select("chr", "pos", "anc", "der", "original_pos", "realign_idx")))
    rows = detect.with_context(rows, contigs, longest=world.LONGEST, tile=True)
    return rows.withColumn("k_max", detect.longest_mh(rows))


#: Formula 3 over the geometric p-value of every placement.
P_ROWS = REALIGNED_DELETIONS + """, g AS (
  SELECT variant_id, pos, indel_len, k_max, indel_len - 1 AS n, right(indel, CAST(k_max AS INTEGER)) AS mh, len(list_filter(range(1, length(around) - k_max + 2), lambda i: substr(around, CAST(i AS INTEGER), CAST(k_max AS INTEGER)) = right(indel, CAST(k_max AS INTEGER)))) AS c FROM deletions
), lk AS (SELECT *, pow(1 - c / (4000 - k_max + 1), n) * (c / (4000 - k_max + 1)) AS l FROM g
), chance AS (SELECT *, CASE WHEN k_max > 0 THEN (1 - pow(1 - l, n)) * l ELSE 1.0 END AS x, CASE WHEN k_max > 0 THEN 1.0 ELSE 0.0 END AS h FROM lk
), p AS MATERIALIZED (SELECT variant_id, pos, indel_len, round(x / (x + h + 1e-16), 16) AS p FROM chance)"""


def p_rows(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    some = F.col("k_max") > 0
    cand = F.when(some, F.right("indel", F.col("k_max")))
    found = realigned_deletions(spark, d).select("chr", "original_pos", "pos", "indel_len", "k_max", "base", "tile_seq", cand.alias("del_mmej_cand"), cand.alias("motif0"))
    counted = markov.scored_in_tiles(found, 1, scores=False).withColumnRenamed("s0_count", "geo_count").withColumn("variant_id", S.variant_id(F.col("chr"), F.col("original_pos")))
    rows = markov.geometric_chance(counted).withColumns({"del_p_val": F.col("geo_p"), "del_mmej_lk": F.lit(0.0), "del_p_chance": F.lit(None).cast("double")})
    # The deal by variant serves the groupings that follow, and ends the expressions that they would each repeat.
    return rows.select("variant_id", *columns, em.nhej_probability(3).alias("p")).repartition("variant_id")


def em_sql(source: str, by: str) -> str:
    """SQL that takes each draw of `source` (by, variant_id, p) to the tolerance: rounds is a row a draw and round."""
    named = ", ".join(f"r.{c.strip()}" for c in by.split(","))
    return f""", rounds AS (
      SELECT DISTINCT {by}, 0 AS k, CAST(0.9 AS DOUBLE) AS theta, FALSE AS done FROM {source}
      UNION ALL
      SELECT {by}, k + 1, avg(part), pow(avg(part) - theta, 2) < 1e-7 FROM (
        SELECT {named}, k, theta, variant_id, sum((p * theta + (1 - p) * (1 - theta)) * p) / sum(p * theta + (1 - p) * (1 - theta)) AS part
        FROM rounds r JOIN {source} USING ({by}) WHERE NOT done GROUP BY ALL) GROUP BY {by}, k, theta
    )"""


@query(recursive(P_ROWS) + ", d AS MATERIALIZED (SELECT 0 AS boot_n, variant_id, p FROM p)" + em_sql("d", "boot_n") + " SELECT round(theta, 9) AS nhej, round(1 - theta, 9) AS mmej, k AS rounds FROM rounds WHERE done")
def e1_em(spark: SparkSession, d: str) -> DataFrame:
    theta, history = em.em(p_rows(spark, d))
    return spark.createDataFrame([(round(theta, 9), round(1 - theta, 9), len(history) - 1)], "nhej double, mmej double, rounds int")


@query(P_ROWS + " SELECT variant_id, round(p, 9) AS p, round((p * 0.3 + (1 - p) * 0.7) / sum(p * 0.3 + (1 - p) * 0.7) OVER (PARTITION BY variant_id), 9) AS weight FROM p")
def e2_posterior(spark: SparkSession, d: str) -> DataFrame:
    return em.posterior(p_rows(spark, d), 0.3).select("variant_id", F.round("p", 9).alias("p"), F.round("weight", 9).alias("weight"))


@query(P_ROWS + ", ids AS (SELECT variant_id FROM (SELECT DISTINCT variant_id FROM p) ORDER BY md5('7|' || variant_id), variant_id LIMIT 300) SELECT variant_id, round(p, 9) AS p FROM p WHERE variant_id IN (SELECT variant_id FROM ids)")
def e3_variant_draw(spark: SparkSession, d: str) -> DataFrame:
    return em.draw_variants(p_rows(spark, d), 300, 7).withColumn("p", F.round("p", 9))


BOOT_SQL = (
    recursive(P_ROWS)
    + """, ids AS (SELECT variant_id, CAST(b AS BIGINT) AS boot_n FROM (SELECT DISTINCT variant_id FROM p), (SELECT unnest(range(0, 10)) AS b)
      QUALIFY row_number() OVER (PARTITION BY b ORDER BY md5('0|' || b || '|' || variant_id), variant_id) <= 200),
    drawn AS MATERIALIZED (SELECT boot_n, variant_id, p FROM ids JOIN p USING (variant_id))"""
    + em_sql("drawn", "boot_n")
)


@query(BOOT_SQL + " SELECT boot_n, round(theta, 9) AS NHEJ, round(1 - theta, 9) AS MMEJ FROM rounds WHERE done")
def e3_bootstrap_em(spark: SparkSession, d: str) -> DataFrame:
    out = em.bootstrap_em(p_rows(spark, d), draws=10, size=200)
    return out.select("boot_n", *[F.round(c, 9).alias(c) for c in ("NHEJ", "MMEJ")])


@query(BOOT_SQL + " SELECT boot_n, k AS round, round(theta, 9) AS NHEJ, done AS last FROM rounds WHERE k > 0")
def s13_em_log(spark: SparkSession, d: str) -> DataFrame:
    log = em.em_log(em.drawn_variants(p_rows(spark, d), draws=10, size=200))
    return log.select("boot_n", "round", F.round("NHEJ", 9).alias("NHEJ"), "last")


MECHANISMS = ["nhej", "mmej3", "mmej2", "slip"]


def mechanism_rows(spark: SparkSession, d: str) -> DataFrame:
    """Deletions read from both sides, each with the lengths that a mechanism would explain."""
    contigs = world.genome(spark, d)
    near = detect.with_context(cleaned(spark, d, contigs), contigs, longest=world.LONGEST, far=True).where("indel_type = 'DEL'")
    found = detect.detect_slippage(detect.detect_deletions(detect.both_directions(near, crispr=True), [3, 2]))
    three, two = F.get("del", F.lit(0)), F.get("del", F.lit(1))
    none = F.array().cast("array<int>")
    return found.select(
        "variant_id",
        "direction",
        F.col("indel_len").alias("len"),
        F.coalesce(three["positions"], none).alias("mmej3"),
        F.coalesce(two["positions"], none).alias("mmej2"),
        F.col("slip.positions").alias("slip"),
    )


def places_sql(k: int) -> str:
    """Where, from the break, the last k bases of the indel end in the window about it, one less; none unless they are homologous."""
    motif = f"right(indel, {k})"
    return f"""CASE WHEN k_max >= {k} THEN list_transform(list_filter(range({k}, 2001), lambda e: abs(e - 1000) < 50 + indel_len AND substr(around, CAST(e - {k - 1} AS BIGINT), {k}) = {motif}), lambda e: e - 1001) ELSE [] END"""


@query(
    CLEANED
    + f""", sides AS (
      SELECT variant_id || '.0' AS variant_id, 0 AS direction, indel_len, substr(anc, 2) AS indel, substr(seq, pos - (50 + indel_len) + 1, 50 + indel_len) AS up, substr(seq, pos - 999, 2000) AS around FROM cleaned WHERE indel_type = 'DEL'
      UNION ALL
      SELECT variant_id || '.1', 1, indel_len, reverse(substr(anc, 2)), reverse(substr(seq, pos + 1 + indel_len, 51)), reverse(substr(seq, pos + indel_len - 999, 2000)) FROM cleaned WHERE indel_type = 'DEL'
    ), homologous AS (SELECT *, len(list_filter(range(1, least(indel_len, length(up)) + 1), lambda k: right(indel, CAST(k AS INTEGER)) = right(up, CAST(k AS INTEGER)))) AS k_max FROM sides)
    SELECT variant_id, direction, CAST(indel_len AS BIGINT) AS len, array_to_string({places_sql(3)}, ',') AS mmej3, array_to_string({places_sql(2)}, ',') AS mmej2 FROM homologous"""
)
def q6_both_directions(spark: SparkSession, d: str) -> DataFrame:
    rows = mechanism_rows(spark, d)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return rows.select("variant_id", "direction", F.col("len").cast("long").alias("len"), text("mmej3"), text("mmej2"))


@query(None)
def q1_q6_mechanism_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Proportions by all smoothings, over both directions, to tolerance."""
    rows = scratch.written(mechanism_rows(spark, d), "mechanisms")
    out = []
    for mode in ("full", "uniform", "savitzky_golay"):
        theta, _, log = emq.fit(rows, MECHANISMS, mode=mode, rounds=60)
        out += [(mode, n, float(t), len(log)) for n, t in zip(MECHANISMS, theta, strict=True)]
    return spark.createDataFrame(out, "mode string, mechanism string, theta double, rounds int")


EM_TYPES = [2, 3, 4, 6, 7, 8, 9, 10, 11, 12]
TYPES_SQL = GEOMETRIC + """, g1 AS (SELECT variant_id, k_max, length(mh) AS lm, c, CASE WHEN k_max > 0 THEN l ELSE 1.0 END AS x, CASE WHEN k_max > 0 THEN (1 - pow(1 - l, n)) * l ELSE 1.0 END AS p FROM lk),
b AS (SELECT *, 1 - x AS lk, CASE WHEN k_max > 0 THEN 1.0 ELSE 0.0 END AS h, CASE WHEN k_max > 0 THEN x ELSE 1.0 END AS chance, CASE WHEN k_max > 1 THEN p END AS two,
  CASE WHEN 1 - (1 - x) < 0.5 THEN pow(1 - (1 - x), 2) WHEN 1 - (1 - x) > 0.5 THEN 1 - pow(1 - x, 2) ELSE 1 - (1 - x) END AS bent, CASE WHEN k_max > 0 THEN (c + 1) / (50 - lm + 1) ELSE 1.0 END AS often,
  (1 - (1 - x)) * CASE WHEN k_max > 0 THEN x ELSE 1.0 END AS z FROM g1)
SELECT variant_id, round(CASE WHEN p < 0.49 THEN p + 1e-10 WHEN p > 0.51 THEN p - 1e-10 ELSE p END, 9) AS p2, round(p / (p + h + 1e-16), 9) AS p3, round((1 - lk) / (1 - lk + h + 1e-16), 9) AS p4,
  round(chance / (chance + h + 1e-16), 9) AS p6, round(1 - chance, 9) AS p7, round(coalesce(two, 1.0) / (coalesce(two, 1.0) + CASE WHEN two IS NULL THEN 0 ELSE 1 END + 1e-16), 9) AS p8,
  round((lk + 1e-16) / ((lk + 1e-16) + (lk + 1e-16) / (p + 1e-16)), 9) AS p9, round(bent / (bent + h + 1e-16), 9) AS p10, round((1 - lk) * often, 9) AS p11,
  round((z / (z + h + 1e-16)) / (z / (z + h + 1e-16) + h + 1e-16), 9) AS p12 FROM b"""


@query(TYPES_SQL)
def e_types_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """All formulas but the fifth (see e1_em), over geometric scores."""
    some = F.col("k_max") > 0
    rows = markov.geometric_chance(deletions(spark, d)).withColumns({"del_mmej_cand": F.when(some, F.right("indel", F.col("k_max"))), "del_p_val": F.col("geo_p"), "del_mmej_lk": 1 - F.col("geo_lk")})
    rows = rows.withColumns({"del_p_chance": F.when(some, F.col("geo_lk")), "del_freq_eq": F.when(some, F.col("geo_lk")), "mh2_p_chance": F.when(F.col("k_max") > 1, F.col("geo_p"))})
    rows = rows.withColumn("del_motif_count", F.when(some, S.motif_count(F.col("around"), F.col("del_mmej_cand"))))
    return rows.select("variant_id", *[F.round(em.nhej_probability(k), 9).alias(f"p{k}") for k in EM_TYPES])


BIN_SQL = (
    recursive(P_ROWS)
    + """, binned AS MATERIALIZED (SELECT variant_id, p, CASE WHEN indel_len < 10 THEN CAST(indel_len AS VARCHAR) WHEN indel_len < 15 THEN '10<=Indel<15' WHEN indel_len < 30 THEN '15<=Indel<30' ELSE '30<=Indel' END AS length_bin,
      CAST(round_even(pos / 500.0, 0) AS BIGINT) % 5 AS boot_n FROM p)"""
    + em_sql("binned", "boot_n, length_bin")
)


@query(BIN_SQL + " SELECT boot_n, length_bin, round(theta, 9) AS NHEJ, round(1 - theta, 9) AS MMEJ FROM rounds WHERE done")
def a8_em_by_length_bin(spark: SparkSession, d: str) -> DataFrame:
    rows = p_rows(spark, d, "pos", "indel_len")
    rows = rows.withColumn("boot_n", blocks.block_id(F.col("pos"), 500) % 5).withColumn("length_bin", S.length_bin(F.col("indel_len")))
    out = em.em_by_draw(rows.select("boot_n", "length_bin", "variant_id", "p"), by=["boot_n", "length_bin"])
    return out.select("boot_n", "length_bin", *[F.round(c, 9).alias(c) for c in ("NHEJ", "MMEJ")])


@query(
    P_ROWS
    + """, first AS (SELECT DISTINCT variant_id FROM p WHERE p < 0.5), second AS (SELECT DISTINCT variant_id FROM p WHERE p >= 0.5),
    a AS (SELECT variant_id FROM first ORDER BY md5('3|' || variant_id), variant_id LIMIT 120), b AS (SELECT variant_id FROM second ORDER BY md5('4|' || variant_id), variant_id LIMIT 80)
    SELECT variant_id, round(p, 9) AS p FROM p WHERE (p < 0.5 AND variant_id IN (SELECT variant_id FROM a)) OR (p >= 0.5 AND variant_id IN (SELECT variant_id FROM b))"""
)
def e4_two_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = scratch.written(p_rows(spark, d), "p-rows")
    return em.draw_mixture(rows.where("p < 0.5"), rows.where("p >= 0.5"), 120, 80, 3).withColumn("p", F.round("p", 9))


@query(
    CLEANED
    + """, a AS (SELECT variant_id FROM cleaned WHERE indel_type = 'DEL'), b AS (SELECT variant_id FROM cleaned WHERE indel_type = 'INS')
    SELECT variant_id, variant_id IN (SELECT variant_id FROM b) AS shared FROM a"""
)
def u2_shared_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = scratch.written(cleaning.describe(cleaned(spark, d)).select("variant_id", "indel_type"), "ids")
    a, b = (rows.where(F.col("indel_type") == kind).select("variant_id") for kind in ("DEL", "INS"))
    return cleaning.in_both(a, b, ["variant_id"]).withColumn("shared", F.lit(True)).unionByName(cleaning.only_first(a, b, ["variant_id"]).withColumn("shared", F.lit(False)))


# Blocks, aggregates, statistics

BLOCKS = CLEANED + ", blocked AS (SELECT *, CAST(round_even(pos / 500.0, 0) AS BIGINT) AS block FROM cleaned)"


def blocked(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.describe(cleaned(spark, d)).withColumn("block", blocks.block_id(F.col("pos"), 500))


@query(
    BLOCKS
    + """, n AS (SELECT unnest(range(0, (SELECT max(block) + 1 FROM blocked))) AS block)
    SELECT n.block, CAST(coalesce(count_if(indel_type = 'DEL'), 0) AS BIGINT) AS n_true, CAST(coalesce(count_if(indel_type <> 'DEL'), 0) AS BIGINT) AS n_false FROM n LEFT JOIN blocked b ON b.block = n.block GROUP BY n.block"""
)
def a1_a2_block_counts(spark: SparkSession, d: str) -> DataFrame:
    return blocks.block_counts(blocked(spark, d), F.col("indel_type") == "DEL")


DRAWN = BLOCKS + """, c AS (SELECT block, count_if(indel_type = 'DEL') AS t, count_if(indel_type <> 'DEL') AS f FROM blocked GROUP BY block),
n AS (SELECT max(block) + 1 AS n FROM blocked),
d AS (SELECT draw, slot, ('0x' || substr(md5('11|' || draw || '|' || slot), 1, 7))::BIGINT % n AS block FROM n, (SELECT unnest(range(0, 50)) AS draw), (SELECT unnest(range(0, 100000)) AS slot) WHERE slot < n),
sums AS (SELECT draw, CAST(coalesce(sum(t), 0) AS BIGINT) AS n_true, CAST(coalesce(sum(f), 0) AS BIGINT) AS n_false FROM d LEFT JOIN c ON c.block = d.block GROUP BY draw)"""


def drawn_sums(spark: SparkSession, d: str) -> DataFrame:
    counts = blocks.block_counts(blocked(spark, d), F.col("indel_type") == "DEL").persist()
    return blocks.compare_draws(blocks.sampled_sums(counts, blocks.draws(spark, 50, counts.count(), 11), ["n_true", "n_false"]))


@query(
    BLOCKS
    + """, n AS (SELECT unnest(range(0, (SELECT max(block) + 1 FROM blocked))) AS block)
    SELECT n.block, coalesce(count_if(indel_type = 'DEL'), 0) / 4.0 AS n_true, coalesce(count_if(indel_type <> 'DEL'), 0) / 8.0 AS n_false FROM n LEFT JOIN blocked b ON b.block = n.block GROUP BY n.block"""
)
def a3_normalised_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.normalise(blocks.block_counts(blocked(spark, d), F.col("indel_type") == "DEL"), 4.0, 8.0)


@query(DRAWN + ", r AS (SELECT n_true / n_false AS ratio FROM sums) SELECT round(avg(ratio) - quantile_cont(ratio, 0.025), 9) AS below, round(quantile_cont(ratio, 0.975) - avg(ratio), 9) AS above FROM r")
def a23_half_widths(spark: SparkSession, d: str) -> DataFrame:
    return blocks.half_widths(blocks.quantile_interval(drawn_sums(spark, d), "ratio")).select(F.round("below", 9).alias("below"), F.round("above", 9).alias("above"))


@query(DRAWN + " SELECT draw, n_true, n_false, round(n_true / n_false, 9) AS ratio, CAST(n_true < n_false AS INTEGER) AS less FROM sums")
def a4_a5_block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return drawn_sums(spark, d).withColumn("ratio", F.round("ratio", 9))


@query(DRAWN + ", r AS (SELECT n_true / n_false AS ratio FROM sums) SELECT round(avg(ratio), 9) AS mean, round(quantile_cont(ratio, 0.025), 9) AS low, round(quantile_cont(ratio, 0.975), 9) AS high FROM r")
def a20_quantile_interval(spark: SparkSession, d: str) -> DataFrame:
    out = blocks.quantile_interval(drawn_sums(spark, d), "ratio")
    return out.select(*[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query(DRAWN + " SELECT least((1 - avg(CAST(n_true < n_false AS INTEGER))) * 3, 1.0) AS share_cond_lt_rest FROM sums")
def a6_share_against(spark: SparkSession, d: str) -> DataFrame:
    return blocks.adjusted(blocks.share_against(drawn_sums(spark, d), zero_based=True), 3)


@query(None)
def a7_a11_bootstrap_summary(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.bootstrapped(k_combined_scores(spark, d), 500, 5)


HASHED = "('0x' || substr(md5({0}), 1, 7))::BIGINT % 1000000 / 1000000.0"
PATTERNED = CLEANED + f""", n AS (SELECT variant_id, indel_type, count(*) OVER (PARTITION BY variant_id) AS k, {HASHED.format("'s|' || variant_id")} AS s, {HASHED.format("'l|' || variant_id")} AS l FROM cleaned),
v AS (SELECT variant_id, bool_or(s < 0.3 / k) AS s, bool_or(l < 0.2 / k) AS l FROM n WHERE indel_type = 'INS' GROUP BY variant_id)"""


def patterned(spark: SparkSession, d: str) -> DataFrame:
    rows = cleaning.describe(cleaned(spark, d))
    p = lambda tag: blocks.hashed_number(1000000, tag, F.col("variant_id")) / 1000000
    return rows.withColumn("snap_p_val", p("s")).withColumn("loop_p_val", p("l")).withColumn("variant_id_N", F.count(F.lit(1)).over(Window.partitionBy("variant_id")))


@query(PATTERNED + " SELECT round(avg(CAST(s AND NOT l AS INTEGER)), 9) AS snap, round(avg(CAST(l AND NOT s AS INTEGER)), 9) AS loop, round(avg(CAST(s AND l AS INTEGER)), 9) AS SDMMEJ, round(avg(CAST(NOT s AND NOT l AS INTEGER)), 9) AS unclassified_ins, CAST(count(*) AS BIGINT) AS n FROM v")
def a9_insertion_shares(spark: SparkSession, d: str) -> DataFrame:
    out = blocks.insertion_shares(patterned(spark, d), 0.3, 0.2)
    return out.select(*[F.round(c, 9).alias(c) for c in ("snap", "loop", "SDMMEJ", "unclassified_ins")], "n")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) = 1")
def a12_best_realignments(spark: SparkSession, d: str) -> DataFrame:
    rows = world.read(spark, d, "lineitem").withColumn("chr", F.lit("c")).withColumn("original_pos", F.col("l_orderkey"))
    return blocks.best_realignments(rows, ["l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, round(avg(l_discount) OVER (PARTITION BY l_orderkey), 9) AS mean FROM lineitem")
def a13_mean_realignments(spark: SparkSession, d: str) -> DataFrame:
    rows = world.read(spark, d, "lineitem").withColumn("chr", F.lit("c")).withColumn("original_pos", F.col("l_orderkey"))
    return blocks.best_realignments(rows, ["l_discount"], "mean").select("l_orderkey", "l_linenumber", F.round("mean_l_discount", 9).alias("mean"))


@query(
    """WITH x AS (SELECT CAST(l_orderkey AS VARCHAR) AS variant_id, l_returnflag = 'R' AS has_pattern, unnest([{'m': 'tax', 'lk': l_tax, 'o': 0}, {'m': 'discount', 'lk': l_discount, 'o': -1}]) AS u FROM lineitem)
    SELECT variant_id, u.m AS mechanism, u.lk AS lk FROM x QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY has_pattern DESC, u.lk DESC, u.o DESC) = 1"""
)
def a14_likeliest_mechanism(spark: SparkSession, d: str) -> DataFrame:
    rows = world.read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("variant_id"), (F.col("l_returnflag") == "R").alias("has_pattern"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"))
    return blocks.likeliest_mechanism(rows, ["tax", "discount"])


@query("SELECT l_returnflag, round(1.96 * sqrt(avg(l_discount) * (1 - avg(l_discount)) / count(*)), 9) AS half FROM lineitem GROUP BY l_returnflag")
def a15_wald_interval(spark: SparkSession, d: str) -> DataFrame:
    rows = world.read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("p"), F.count(F.lit(1)).alias("n"))
    return rows.select("l_returnflag", F.round(blocks.wald_interval(F.col("p"), F.col("n")), 9).alias("half"))


@query(
    CLEANED
    + """, b AS (SELECT pos // 1000 AS bin, avg(indel_len) AS mean, count(*) AS n FROM cleaned GROUP BY 1)
    SELECT x.bin, round(mean, 9) AS mean, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM cleaned), 9) AS share_total FROM (SELECT unnest(range(0, 30)) AS bin) x LEFT JOIN b ON b.bin = x.bin"""
)
def a16_binned_mean(spark: SparkSession, d: str) -> DataFrame:
    out = blocks.binned_mean(cleaning.describe(cleaned(spark, d)), F.col("pos") / 1000, "indel_len", 30)
    return out.select("bin", F.round("mean", 9).alias("mean"), "n", F.round("share_total", 9).alias("share_total"))


@query("SELECT round(var_pop(l_tax), 9) AS var_x, round(var_pop(l_discount), 9) AS var_y, round(corr(l_tax, l_discount), 9) AS r, round(pow(corr(l_tax, l_discount), 2), 9) AS r2 FROM lineitem")
def a17_moments(spark: SparkSession, d: str) -> DataFrame:
    out = blocks.moments(world.read(spark, d, "lineitem"), "l_tax", "l_discount")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(CLEANED + ", c AS (SELECT indel_type, CAST(indel_len AS BIGINT) AS indel_len, CAST(count(DISTINCT variant_id) AS BIGINT) AS n_variants FROM cleaned GROUP BY ALL) SELECT *, round(n_variants / sum(n_variants) OVER (PARTITION BY indel_type), 9) AS share FROM c")
def a18_length_distribution(spark: SparkSession, d: str) -> DataFrame:
    out = blocks.length_distribution(cleaning.describe(cleaned(spark, d)), ["indel_type"])
    return out.select("indel_type", F.col("indel_len").cast("long").alias("indel_len"), "n_variants", F.round("share", 9).alias("share"))


@query(
    """WITH x AS (SELECT l_linenumber AS boot_n, avg(l_tax) AS a, avg(l_discount) AS b FROM lineitem GROUP BY 1), p AS (SELECT least(avg(CAST(a > b AS INTEGER)) * 2, 1.0) AS p FROM x)
    SELECT round(p, 9) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM p"""
)
def a21_exceedance(spark: SparkSession, d: str) -> DataFrame:
    rows = world.read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("boot_n")).agg(F.avg("l_tax").alias("a"), F.avg("l_discount").alias("b"))
    return blocks.exceedance(rows.select("boot_n", F.col("a").alias("v")), rows.select("boot_n", F.col("b").alias("v")), "v", 2).withColumn("p", F.round("p", 9))


@query(
    """WITH d AS (SELECT round(l_tax * 100) - round(l_discount * 100) AS d FROM lineitem), n AS (SELECT abs(d) AS a, count(*) AS n, count_if(d > 0) AS up FROM d WHERE d <> 0 GROUP BY 1),
    r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM n),
    s AS (SELECT sum(up * rank) AS wp, sum((n - up) * rank) AS wm, sum(n) AS n, sum(pow(n, 3) - n) AS ties FROM r)
    SELECT round(least(wp, wm), 6) AS w, CAST(n AS BIGINT) AS n, round((least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM s"""
)
def a22_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    rows = world.read(spark, d, "lineitem").select(F.round(F.col("l_tax") * 100).alias("x"), F.round(F.col("l_discount") * 100).alias("y"))
    return blocks.wilcoxon(rows, "x", "y").select(F.round("w", 6).alias("w"), "n", F.round("z", 6).alias("z"))


#: Twelve untied differences of line numbers' means: all 4096 signs are listed.
@query(
    """WITH RECURSIVE m AS (SELECT l_suppkey % 12 AS g, round(avg(l_extendedprice) - avg(l_quantity * 1500), 4) AS d FROM lineitem GROUP BY 1), r AS (SELECT d, row_number() OVER (ORDER BY abs(d)) AS k, count(*) OVER () AS n FROM m),
    w AS (SELECT least(sum(CASE WHEN d > 0 THEN k ELSE 0 END), sum(CASE WHEN d < 0 THEN k ELSE 0 END)) AS w, max(n) AS n FROM r),
    ways AS (SELECT 0 AS k, 0::BIGINT AS total, 1::DOUBLE AS n UNION ALL SELECT k + 1, total + s * (k + 1), sum(n) FROM ways, (SELECT unnest([0, 1]) AS s) WHERE k < (SELECT n FROM w) GROUP BY ALL)
    SELECT CAST(w AS DOUBLE) AS w, round(least(1.0, 2 * (SELECT sum(x.n) FROM ways x WHERE x.k = w.n AND x.total <= w.w) / pow(2, n)), 9) AS p FROM w"""
)
def a22_exact_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    rows = world.read(spark, d, "lineitem").groupBy(F.col("l_suppkey") % 12).agg(F.round(F.avg("l_extendedprice") - F.avg(F.col("l_quantity") * 1500), 4).alias("x")).withColumn("y", F.lit(0.0))
    return blocks.wilcoxon(rows, "x", "y").select("w", F.round("p", 9).alias("p"))


@query("SELECT l_orderkey, l_linenumber, u.k AS variable, u.v AS value FROM (SELECT l_orderkey, l_linenumber, unnest([{'k': 'l_tax', 'v': l_tax}, {'k': 'l_discount', 'v': l_discount}]) AS u FROM lineitem)")
def a24_melt(spark: SparkSession, d: str) -> DataFrame:
    return blocks.melted(world.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"])


# Evaluation

CUTOFFS = [0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08]


@query(
    f"""WITH c AS (SELECT unnest({CUTOFFS}) AS cutoff), k AS (SELECT CAST(cutoff AS DOUBLE) AS cutoff, count_if(pos AND s > cutoff) AS tp, count_if(NOT pos AND s >= cutoff) AS fp, count_if(NOT pos AND s < cutoff) AS tn, count_if(pos AND s <= cutoff) AS fn
      FROM (SELECT l_returnflag = 'R' AS pos, l_tax AS s FROM lineitem), c GROUP BY 1)
    SELECT cutoff, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, round(CASE WHEN cutoff = 0 THEN 1.0 ELSE tp / (tp + fn) END, 9) AS tpr, round(CASE WHEN cutoff = 0 THEN 1.0 ELSE fp / (fp + tn) END, 9) AS fpr,
      CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 9) END AS precision FROM k"""
)
def v1_v3_roc(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.roc(world.read(spark, d, "lineitem"), CUTOFFS, "l_tax", F.col("l_returnflag") == "R")
    return out.select("cutoff", "tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("tpr", "fpr", "precision")])


@query(
    f"""WITH c AS (SELECT CAST(unnest({CUTOFFS}) AS DOUBLE) AS cutoff), k AS (SELECT cutoff, count_if(NOT pos AND s >= cutoff) / count_if(NOT pos) AS fpr, count_if(pos AND s > cutoff) AS tp FROM (SELECT l_returnflag = 'R' AS pos, l_tax AS s FROM lineitem), c GROUP BY 1)
    SELECT min(cutoff) AS cutoff FROM k WHERE fpr <= 0.4 AND tp > 0 AND cutoff > 0"""
)
def v4_significant_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.significant_cutoff(evaluate.roc(world.read(spark, d, "lineitem"), CUTOFFS, "l_tax", F.col("l_returnflag") == "R"), 0.4)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = world.read(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey")
    return rows.select(F.col("l_orderkey").alias("variant_id"), (F.col("l_orderkey") % 2 == 0).alias("positive"), F.col("l_tax").alias("p_val"), F.count(F.lit(1)).over(w).alias("variant_id_N"))


VARIANT_P = "v AS (SELECT variant_id, bool_or(positive) AS positive, min(p * n) AS p FROM (SELECT l_orderkey AS variant_id, l_orderkey % 2 = 0 AS positive, l_tax AS p, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY variant_id)"


@query(
    f"""WITH {VARIANT_P}, r AS (SELECT draw, positive, p, row_number() OVER (PARTITION BY draw, positive ORDER BY ('0x' || substr(md5('0|' || draw || '|' || variant_id), 1, 7))::BIGINT % 268435456, variant_id) AS r FROM v, (SELECT unnest(range(0, 10)) AS draw)),
    e AS (SELECT draw, cutoff, avg(CASE WHEN positive THEN CAST(p < cutoff AS INTEGER) END) AS tpr, avg(CASE WHEN NOT positive THEN CAST(p < cutoff AS INTEGER) END) AS fpr FROM r, (SELECT CAST(unnest([0.05, 0.1, 0.2]) AS DOUBLE) AS cutoff) WHERE r <= 200 GROUP BY ALL)
    SELECT cutoff, round(avg(tpr), 9) AS mean_tpr, round(avg(fpr), 9) AS mean_fpr FROM e GROUP BY cutoff"""
)
def v5_bootstrapped_roc(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.bootstrapped_roc(labelled(spark, d), [0.05, 0.1, 0.2], 10, 200)
    return out.select("cutoff", F.round("mean_tpr", 9).alias("mean_tpr"), F.round("mean_fpr", 9).alias("mean_fpr"))


@query(
    f"""WITH {VARIANT_P}, r AS (SELECT step, positive, p < 0.1 AS called, row_number() OVER (PARTITION BY step, positive ORDER BY ('0x' || substr(md5('0|' || step || '|' || variant_id), 1, 7))::BIGINT % 268435456, variant_id) AS r FROM v, (SELECT unnest(range(0, 11)) AS step))
    SELECT step / 10 AS ratio, round(avg(CAST(called AS INTEGER)), 9) AS share_called, round(avg(CASE WHEN NOT positive THEN CAST(called AS INTEGER) END), 9) AS fpr,
      round(avg(CASE WHEN positive THEN CAST(NOT called AS INTEGER) END), 9) AS fnr, round(avg(CAST(called = positive AS INTEGER)), 9) AS acc
    FROM r WHERE r <= round(CASE WHEN positive THEN step ELSE 10 - step END * 300 / 10) GROUP BY step"""
)
def v6_mixtures(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.mixture_evaluation(labelled(spark, d), 300, 0.1)
    return out.select("ratio", *[F.round(c, 9).alias(c) for c in ("share_called", "fpr", "fnr", "acc")])


@query(
    DELETIONS
    + """, a AS (SELECT variant_id, min(right(indel, 6)) AS x FROM deletions WHERE k_max > 0 GROUP BY 1), b AS (SELECT variant_id, min(right(indel, 3)) AS y FROM deletions WHERE indel_len > 5 GROUP BY 1)
    SELECT CAST(count_if(y IS NULL) AS BIGINT) AS only_a, CAST(count_if(x IS NULL) AS BIGINT) AS only_b, CAST(count_if(x IS NOT NULL AND y IS NOT NULL) AS BIGINT) AS both,
      round(avg(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN CAST(contains(x, y) OR contains(y, x) OR reverse(x) = y AS INTEGER) END), 9) AS matched FROM a FULL JOIN b ON a.variant_id = b.variant_id"""
)
def v7_pattern_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = scratch.written(deletions(spark, d).select("variant_id", "indel_len", "k_max", F.right("indel", F.lit(6)).alias("end")), "ends")
    a = rows.where("k_max > 0").groupBy("variant_id").agg(F.min("end").alias("pattern"))
    b = rows.where("indel_len > 5").groupBy("variant_id").agg(F.min(F.right("end", F.lit(3))).alias("pattern"))
    return evaluate.pattern_agreement(a, b).withColumn("matched", F.round("matched", 9))


@query(None)
def v8_mechanism_proportions(spark: SparkSession, d: str) -> DataFrame:
    scores = scratch.written(k_combined_scores(spark, d).select("variant_id", "variant_id_N", "del_mmej_lk", "del_p_val", "SD_snap_lk", "snap_p_val"), "scores")
    return evaluate.proportions(scores, "mmej", "del_mmej_lk", "del_p_val", 0.05).unionByName(evaluate.proportions(scores, "snap", "SD_snap_lk", "snap_p_val", 0.05))


# Intervals

ANNOTATED = CLEANED + f""", annot AS (SELECT CAST(o_orderkey % (SELECT max(doc_id) + 1 FROM documents) // {world.DOCS} AS VARCHAR) AS chr, o_custkey * 7 % 6000 AS s, o_custkey * 7 % 6000 + 40 + o_orderkey % 400 AS e FROM orders),
spans AS (SELECT variant_id, chr, pos - 1 AS s, pos - 1 + length(ref) AS e FROM cleaned)"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.describe(cleaned(spark, d)).select("variant_id", "chr", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.length("ref")).alias("end"))


def annotations(spark: SparkSession, d: str) -> DataFrame:
    rows = world.contig_of(spark, d, world.read(spark, d, "orders"), "o_orderkey")
    start = F.col("o_custkey") * 7 % 6000
    return rows.select("chr", start.alias("start"), (start + 40 + F.col("o_orderkey") % 400).alias("end"))


@query(
    ANNOTATED
    + """, ordered AS (SELECT chr, s, e, max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM annot),
    islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM ordered)
    SELECT chr, min(s) AS start, max(e) AS "end" FROM islands GROUP BY chr, g"""
)
def j6_merged(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merged(annotations(spark, d))


@query(ANNOTATED + " SELECT a.variant_id, a.s AS start, a.e AS \"end\", b.s AS b_start, b.e AS b_end FROM spans a JOIN annot b ON a.chr = b.chr AND a.s >= b.s AND a.e <= b.e")
def j6_contained(spark: SparkSession, d: str) -> DataFrame:
    return intervals.contained(spans(spark, d), annotations(spark, d)).drop("chr")


@query(ANNOTATED + " SELECT variant_id FROM spans a WHERE NOT EXISTS (SELECT 1 FROM annot b WHERE a.chr = b.chr AND a.s >= b.s AND a.e <= b.e)")
def j6_outside(spark: SparkSession, d: str) -> DataFrame:
    return intervals.outside(spans(spark, d), annotations(spark, d)).select("variant_id")


@query(ANNOTATED + " SELECT a.variant_id, b.s AS b_start, b.e AS b_end FROM spans a JOIN annot b ON a.chr = b.chr AND a.s < b.e AND b.s < a.e")
def j8_overlapping(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlapping(spans(spark, d), annotations(spark, d)).select("variant_id", "b_start", "b_end")


# Reads

AMPLICON = "ACGTTGCATCGGATTACAGGCTTAACCGATATCGGCTAAGCTTCCGGATCAATGCCGTATTGCACGGATCTTAGCCATGGCATTCGAACGGTTACCAGTGCATAGGCTTGACCTA"
LEFT, RIGHT = 55, len(AMPLICON) - 55


def amplicon_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads spelt from events: a match, a deletion of 0-8, an insertion of 0-4 and a match; some bases are wrong."""
    e = world.read(spark, d, "events").select("event_id", "user_id")
    e = e.withColumn("m", (45 + F.col("event_id") % 12).cast("int")).withColumn("x", (F.col("user_id") % 9).cast("int")).withColumn("i", (F.col("event_id") % 5).cast("int"))
    ref = F.lit(AMPLICON)
    ins = F.substring(ref, (F.col("user_id") % 90).cast("int") + 1, F.col("i"))
    rest = F.substring(ref, F.col("m") + F.col("x") + 1, F.lit(1 << 20))
    read = F.concat(F.left(ref, F.col("m")), ins, rest)
    read = F.when(F.col("event_id") % 7 == 0, F.overlay(read, F.lit("A"), F.lit(20))).otherwise(read)
    part = lambda n, op: F.when(n > 0, F.concat(n, F.lit(op))).otherwise("")
    same = (F.col("x") == 0) & (F.col("i") == 0)
    cigar = F.when(same, F.lit(f"{len(AMPLICON)}M")).otherwise(
        F.concat(part(F.col("m"), "M"), part(F.col("x"), "D"), part(F.col("i"), "I"), part(F.lit(len(AMPLICON)) - F.col("m") - F.col("x"), "M"))
    )
    return e.select("event_id", F.lit("amp").alias("chr"), read.alias("read"), F.repeat(F.lit("I"), F.length(read)).alias("qual"), cigar.alias("cigar"))


READS = f"""WITH e AS (SELECT event_id, user_id, CAST(45 + event_id % 12 AS INTEGER) AS m, CAST(user_id % 9 AS INTEGER) AS x, CAST(event_id % 5 AS INTEGER) AS i, '{AMPLICON}' AS ref FROM events),
r0 AS (SELECT *, left(ref, m) || substr(ref, CAST(user_id % 90 AS INTEGER) + 1, i) || substr(ref, m + x + 1) AS r FROM e),
r AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN substr(r, 1, 19) || 'A' || substr(r, 21) ELSE r END AS read FROM r0)"""


def read_chain_sql(window: int) -> str:
    """READS with the whole chain of a read: classified (and mh) as of `reads.classify` and `junction_microhomology`."""
    size = len(AMPLICON)
    prefix = lambda a, b: f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda k: left({a}, CAST(k AS INTEGER)) = left({b}, CAST(k AS INTEGER))))"
    suffix = lambda a, b: f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda k: right({a}, CAST(k AS INTEGER)) = right({b}, CAST(k AS INTEGER))))"
    report = lambda n: f"""reported{n} AS (SELECT *, least(ml - {LEFT}, 0) AS dl, least(mr - {RIGHT}, 0) AS dr, CAST(greatest(length(read) - least(ml, {LEFT}) - least(mr, {RIGHT}), 0) AS INTEGER) AS il FROM matched{n}),
spelt{n} AS (SELECT *, substr(read, CAST(least(ml, {LEFT}) + 1 AS INTEGER), il) AS ins FROM reported{n})"""  # noqa: E731
    return READS + f""", matched1 AS (SELECT event_id, read, ref, x, i, x = 0 AND i = 0 AS one, CASE WHEN x = 0 AND i = 0 THEN {size} ELSE m END AS ml, CASE WHEN x = 0 AND i = 0 THEN {size} ELSE {size} - m - x END AS mr FROM r),
{report(1)}, lost AS (SELECT *, substr(ref, {LEFT} + dl + 1, greatest({size} - {RIGHT} - dr - {LEFT} - dl, 0)) AS lost, x > 0 AND i > 0 AS four, dl + dr < 0 AND il > 0 AS applies FROM spelt1),
grown AS (SELECT event_id, read, ref, one, ml + CASE WHEN applies AND (four OR dl < 0) THEN {prefix("lost", "ins")} ELSE 0 END AS ml, mr + CASE WHEN applies AND NOT four AND dr < 0 THEN {suffix("lost", "ins")} ELSE 0 END AS mr FROM lost),
ab AS (SELECT *, CASE WHEN one THEN {LEFT} ELSE ml END AS a, CASE WHEN one THEN {RIGHT} ELSE mr END AS b FROM grown),
cut AS (SELECT *, a - coalesce(list_max(list_filter(range(1, {window} + 1), lambda c: c <= a AND substr(read, a - c + 1, 1) <> substr(ref, a - c + 1, 1))), 0) AS l,
  b - coalesce(list_max(list_filter(range(0, {window}), lambda c: c < b AND substr(read, length(read) - (b - c) + 1, 1) <> substr(ref, length(ref) - (b - c) + 1, 1))) + 1, 0) AS r FROM ab),
matched2 AS (SELECT event_id, read, ref, CASE WHEN keep THEN ml ELSE l END AS ml, CASE WHEN keep THEN mr ELSE r END AS mr FROM (SELECT *, one AND ({size} > length(read) OR l + r = {size}) AS keep FROM cut)),
{report(2)}, classed AS (SELECT *, CASE WHEN dl + dr = 0 AND il = 0 THEN 'exact' WHEN dl + dr = 0 THEN 'insertion' WHEN il = 0 THEN 'deletion' ELSE 'complex' END AS class FROM spelt2),
rebuilt AS (SELECT *, CASE WHEN class <> 'exact' THEN left(ref, {LEFT} + dl) || ins || right(ref, {RIGHT} + dr) WHEN length(read) = {size} THEN ref ELSE read END AS working FROM classed),
kept AS (SELECT *, left(working, ml) AS wl, right(working, mr) AS wr, left(ref, greatest({size} - mr, 0)) AS rl, substr(ref, ml + 1) AS rr FROM rebuilt WHERE length(working) = length(read)),
classified AS (SELECT *, CASE WHEN class = 'deletion' THEN
  right(wl, CASE WHEN mr < {RIGHT} THEN {suffix("wl", "rl")} ELSE 0 END) || left(wr, CASE WHEN ml < {LEFT} THEN {prefix("wr", "rr")} ELSE 0 END) ELSE '' END AS mh FROM kept)"""


@query(
    read_chain_sql(3)
    + """ SELECT event_id, CAST(ml AS INTEGER) AS m_left, CAST(mr AS INTEGER) AS m_right, CAST(dl AS INTEGER) AS del_left, CAST(dr AS INTEGER) AS del_right, CAST(il AS INTEGER) AS insert_length,
    ins AS insert_seq, class, working, mh FROM classified"""
)
def h1_h7_read_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = reads.classify(amplicon_reads(spark, d), AMPLICON, LEFT, RIGHT, 3, 3)
    out = reads.junction_microhomology(rows, AMPLICON, LEFT, RIGHT)
    return out.select("event_id", "m_left", "m_right", "del_left", "del_right", "insert_length", "insert_seq", "class", "working", "mh")


@query(
    read_chain_sql(0)
    + """, spots AS (SELECT working, read, CAST(unnest(range(1, length(read) + 1)) AS INTEGER) AS position FROM kept)
    SELECT working, position, CAST(count(*) AS BIGINT) AS errors FROM spots WHERE substr(read, position, 1) <> substr(working, position, 1) GROUP BY ALL"""
)
def h8_read_errors(spark: SparkSession, d: str) -> DataFrame:
    return reads.read_errors(reads.classify(amplicon_reads(spark, d), AMPLICON, LEFT, RIGHT))


@query(read_chain_sql(0) + " SELECT working, class, CAST(count(*) AS BIGINT) AS reads, round(avg(CAST(read <> working AS INTEGER)) * 100, 9) AS error_percent FROM kept GROUP BY working, class")
def a25_read_counts(spark: SparkSession, d: str) -> DataFrame:
    return reads.read_counts(reads.classify(amplicon_reads(spark, d), AMPLICON, LEFT, RIGHT)).withColumn("error_percent", F.round("error_percent", 9))


@query(
    READS
    + """, p AS (SELECT event_id, read, strpos(read, 'CGTT') AS a, CASE WHEN strpos(reverse(read), 'TTCG') > 0 THEN length(read) - strpos(reverse(read), 'TTCG') - 4 + 2 ELSE 0 END AS b FROM r)
    SELECT event_id, a > 0 AND b > a AS matched, CASE WHEN a > 0 AND b > a THEN 'NN' || substr(read, a, b - a + 4) || 'NNN' ELSE read END AS read FROM p"""
)
def h10_trim_and_pad(spark: SparkSession, d: str) -> DataFrame:
    return reads.trim_and_pad(amplicon_reads(spark, d), "CGTT", "GCTT", "NN", "NNN").select("event_id", "matched", "read")


@query(
    READS
    + """ SELECT CAST(m AS INTEGER) AS pos, CASE WHEN i = 0 THEN substr(ref, m + 1, x + 1) ELSE substr(ref, m, 1) END AS ref, CASE WHEN i = 0 THEN substr(read, m + 1, 1) ELSE substr(read, m, i + 1) END AS alt
    FROM r WHERE (x > 0) <> (i > 0)"""
)
def h11_sam_to_variants(spark: SparkSession, d: str) -> DataFrame:
    return reads.sam_to_variants(amplicon_reads(spark, d), AMPLICON).drop("chr")


# Simulation

SITES = world.SQL + """, room AS (SELECT chr, seq, length(seq) - 2200 AS room FROM genome WHERE length(seq) > 2200),
sites AS (SELECT chr, seq, unnest(range(1, CAST(ceil(room * 0.01) AS BIGINT) + 1)) AS site, room FROM room),
placed_sites AS (SELECT chr, seq, site, 1100 + ('0x' || substr(md5('3|' || chr || '|' || site), 1, 7))::BIGINT % room AS pos FROM sites)"""


def placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sites, and the genome that they lie on."""
    contigs = world.genome(spark, d)
    return simulate.sites(contigs, 0.01, 3, 1100), contigs


@query(
    SITES
    + """, n AS (SELECT *, 1 + ('0x' || substr(md5('5|length|' || chr || '|' || pos), 1, 7))::BIGINT % 20 AS n FROM placed_sites)
    SELECT chr, pos, substr(seq, pos, n + 1) AS ref, substr(seq, pos, 1) AS alt, CAST(n AS INTEGER) AS indel_length FROM n WHERE NOT regexp_matches(substr(seq, pos, n + 1), '[^ACGT]')"""
)
def g1_nhej_deletions(spark: SparkSession, d: str) -> DataFrame:
    return simulate.nhej_deletions(*placed(spark, d), 1, 20, 5)


@query(
    SITES
    + """, i AS (SELECT *, strpos(substr(seq, pos + 1, 54), substr(seq, pos - 3, 4)) AS i FROM placed_sites)
    SELECT chr, pos, substr(seq, pos, i + 4) AS ref, substr(seq, pos, 1) AS alt, CAST(i + 3 AS INTEGER) AS indel_length FROM i WHERE i > 0 AND NOT regexp_matches(substr(seq, pos, i + 4), '[^ACGT]')"""
)
def g2_mmej_deletions(spark: SparkSession, d: str) -> DataFrame:
    return simulate.mmej_deletions(*placed(spark, d), 4, 50)


@query(
    SITES
    + """, n AS (SELECT *, 1 + ('0x' || substr(md5('5|length|' || chr || '|' || pos), 1, 7))::BIGINT % 20 AS n, 500 + ('0x' || substr(md5('5|from|' || chr || '|' || pos), 1, 7))::BIGINT % 1400 AS f FROM placed_sites),
    r AS (SELECT chr, pos, substr(seq, pos, 1) AS ref, substr(seq, pos, 1) || substr(left(seq, 1920), f + 1, n) AS alt FROM n)
    SELECT *, CAST(length(alt) - 1 AS INTEGER) AS indel_length FROM r WHERE length(alt) > 1 AND NOT regexp_matches(ref || alt, '[^ACGT]')"""
)
def g3_copied_insertions(spark: SparkSession, d: str) -> DataFrame:
    return simulate.copied_insertions(*placed(spark, d), 1, 20, 5)


@query(
    SITES
    + """, a AS (SELECT *, strpos(substr(seq, pos + 4, 56), substr(seq, pos - 2, 3)) + 2 AS a FROM placed_sites WHERE contains(substr(seq, pos + 4, 56), substr(seq, pos - 2, 3))),
    b AS (SELECT *, substr(seq, pos + a + 4, 57 - a) AS room, strpos(substr(seq, pos + a + 4, 57 - a), substr(seq, pos + 1, 3)) AS b FROM a),
    r AS (SELECT chr, pos, substr(seq, pos, 1) AS ref, substr(seq, pos, 1) || left(room, b - 1) AS alt FROM b WHERE b > 1)
    SELECT *, CAST(length(alt) - 1 AS INTEGER) AS indel_length FROM r WHERE NOT regexp_matches(ref || alt, '[^ACGT]')"""
)
def g4_loop_out_insertions(spark: SparkSession, d: str) -> DataFrame:
    return simulate.loop_out_insertions(*placed(spark, d), 3, 3, 60)


@query(
    SITES
    + """, m AS (SELECT *, reverse(translate(substr(seq, pos - 2, 3), 'ACTG', 'TGAC')) AS mh, reverse(translate(substr(seq, pos + 1, 3), 'ACTG', 'TGAC')) AS sd FROM placed_sites),
    a AS (SELECT *, strpos(substr(seq, pos + 4, 56), sd) + 2 AS a FROM m WHERE contains(substr(seq, pos + 4, 56), sd)),
    b AS (SELECT *, substr(seq, pos + a + 4, 57 - a) AS room, strpos(substr(seq, pos + a + 4, 57 - a), mh) AS b FROM a),
    r AS (SELECT chr, pos, substr(seq, pos, 1) AS ref, substr(seq, pos, 1) || reverse(translate(left(room, b - 1), 'ACTG', 'TGAC')) AS alt FROM b WHERE b > 1)
    SELECT *, CAST(length(alt) - 1 AS INTEGER) AS indel_length FROM r WHERE NOT regexp_matches(ref || alt, '[^ACGT]')"""
)
def g5_snap_back_insertions(spark: SparkSession, d: str) -> DataFrame:
    return simulate.snap_back_insertions(*placed(spark, d), 3, 3, 60)


@query(
    SITES
    + """, d AS (SELECT *, strpos(substr(seq, pos + 1, 53), substr(seq, pos - 2, 3)) + 2 AS d FROM placed_sites WHERE contains(substr(seq, pos + 1, 53), substr(seq, pos - 2, 3))),
    j AS (SELECT *, strpos(substr(seq, pos + d + 1, 12), substr(seq, pos + d + 13, 3)) AS j FROM d),
    r AS (SELECT chr, pos, substr(seq, pos, d + 16) AS ref,
      substr(seq, pos, 1) || substr(seq, pos, 1) || substr(seq, pos + d + 1, j + 14) || substr(seq, pos + d + 1, 15) AS alt, CAST(d AS INTEGER) AS deleted, 12 AS inserted FROM j WHERE j > 0)
    SELECT * FROM r WHERE NOT regexp_matches(ref || alt, '[^ACGT]')"""
)
def g6_trans_mmej(spark: SparkSession, d: str) -> DataFrame:
    return simulate.trans_mmej(*placed(spark, d), 3, 3, 50, 12)


@query(
    SITES
    + """, n AS (SELECT *, 1 + ('0x' || substr(md5('5|length|' || chr || '|' || pos), 1, 7))::BIGINT % 20 AS n FROM placed_sites),
    made AS (SELECT chr, pos, substr(seq, pos, n + 1) AS ref, substr(seq, pos, 1) AS alt, CAST(n AS INTEGER) AS indel_length FROM n WHERE NOT regexp_matches(substr(seq, pos, n + 1), '[^ACGT]')),
    quota AS (SELECT indel_length, count(*) // 2 AS quota FROM made WHERE indel_length < 10 GROUP BY 1)
    SELECT made.* FROM made JOIN quota USING (indel_length) QUALIFY row_number() OVER (PARTITION BY indel_length ORDER BY md5('1|' || chr || '|' || pos), chr, pos) <= quota"""
)
def g8_g9_matched_lengths(spark: SparkSession, d: str) -> DataFrame:
    made = simulate.nhej_deletions(*placed(spark, d), 1, 20, 5)
    wanted = simulate.length_histogram(made, 10).select("indel_length", (F.col("n") / 2).cast("int").alias("quota"))
    return simulate.match_lengths(made, wanted, 1)


def drawn_sql(rounds: int) -> str:
    """MMEJ deletions of several rounds of sites."""
    each = " UNION ALL ".join(f"SELECT {k} AS round, chr, seq, 1100 + ('0x' || substr(md5('{3 + k}|' || chr || '|' || site), 1, 7))::BIGINT % room AS pos FROM sites" for k in range(rounds))
    return f""", drawn AS ({each}), i AS (SELECT DISTINCT *, strpos(substr(seq, pos + 1, 54), substr(seq, pos - 3, 4)) AS i FROM drawn),
    made AS (SELECT round, chr, pos, substr(seq, pos, i + 4) AS ref, substr(seq, pos, 1) AS alt, CAST(i + 3 AS INTEGER) AS indel_length FROM i WHERE i > 0 AND NOT regexp_matches(substr(seq, pos, i + 4), '[^ACGT]')
      QUALIFY row_number() OVER (PARTITION BY chr, pos ORDER BY round) = 1)"""


@query(
    SITES
    + drawn_sql(6)
    + """ SELECT chr, pos, ref, alt, indel_length, CAST(round AS INTEGER) AS round FROM made
    QUALIFY row_number() OVER (ORDER BY round, md5((9 + round) || '|' || chr || '|' || pos), chr, pos) <= (SELECT count(*) // 2 FROM placed_sites)"""
)
def g7_target_size(spark: SparkSession, d: str) -> DataFrame:
    """Valid deletions in a given number, half as many as a round has sites, over as many rounds as it takes."""
    contigs = world.genome(spark, d)
    draw = lambda k: simulate.mmej_deletions(simulate.sites(contigs, 0.01, 3 + k, 1100), contigs, 4, 50)
    return simulate.until_valid(draw, simulate.sites(contigs, 0.01, 3, 1100).count() // 2, 9)


def load() -> None:
    """The queries that stand in modules of their own."""
    from breakweave.plans import file_queries  # noqa: F401


def queries() -> dict[str, Query]:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLES)
