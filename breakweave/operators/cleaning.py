"""Filters and preparation of variant tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breakweave.functions import sequence as S

#: Bases of a genome tile; a tile also carries `pad` bases on both sides. Every variant has its tile copied next to it
#: and is cut from it by walking from the tile's start, so tiles are about as short as their pads.
TILE = 1024
#: Bases that alleles may have beyond the flank to be cut from one tile; longer ones have their pieces put together.
SHORT_ALLELE = 64


def cut_evenly(seq: Column, size: int) -> Column:
    """A sequence as an array of pieces of `size` bases, in time that grows with its length alone."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def pieces(genome: DataFrame, size: int = TILE) -> DataFrame:
    """chr, piece, seq: contigs cut into pieces of `size` bases; a genome that comes in pieces of that size stays as it is."""
    if "piece" in genome.columns:
        return genome.select("chr", "piece", "seq")
    cut = genome.select("chr", F.posexplode(cut_evenly(F.col("seq"), size)).alias("piece", "seq"))
    return cut.select("chr", F.col("piece").cast("long").alias("piece"), "seq")


def tiles(genome: DataFrame, pad: int, size: int = TILE) -> DataFrame:
    """chr, tile, base, tile_seq: each piece of `size` bases with `pad` bases of its neighbours on both sides.

    A genome is either (chr, seq), whose rows are cut where they are, or (chr, piece, seq) with pieces of `size` bases,
    of which each sends its neighbours the bases that they need: then no row ever holds a contig. Both take time and
    space in proportion to the contigs' lengths.
    """
    reach = -(-pad // size)
    base = F.greatest(F.col("tile") * size - pad, F.lit(0))
    if "piece" not in genome.columns:
        cut = genome.select("chr", cut_evenly(F.col("seq"), size).alias("cut"))

        def beside(c: Column, t: Column) -> Column:
            first = F.greatest(t - reach, F.lit(0))
            before = F.right(F.array_join(F.slice("cut", first + 1, t - first), ""), F.lit(pad))
            return F.concat(before, c, F.left(F.array_join(F.slice("cut", t + 2, F.lit(reach)), ""), F.lit(pad)))

        each = cut.select("chr", F.posexplode(F.transform("cut", beside)).alias("tile", "tile_seq"))
        return each.select("chr", F.col("tile").cast("long").alias("tile"), "tile_seq").select("chr", "tile", base.alias("base"), "tile_seq")
    sent = genome.select("chr", "piece", "seq", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("off")).where("piece + off >= 0")
    room = F.lit(pad) - (F.abs("off") - 1) * size
    part = F.when(F.col("off") == 0, F.col("seq")).when(F.col("off") > 0, F.right("seq", F.least(room, F.lit(size)))).otherwise(F.left("seq", F.least(room, F.lit(size))))
    parts = sent.where("off = 0 or length(seq) > 0").select("chr", (F.col("piece") + F.col("off")).alias("tile"), F.struct((-F.col("off")).alias("at"), part.alias("seq")).alias("part"))
    joined = parts.groupBy("chr", "tile").agg(F.sort_array(F.collect_list("part")).alias("parts")).where(F.exists("parts", lambda x: x["at"] == 0))
    return joined.select("chr", "tile", base.alias("base"), F.array_join(F.transform("parts", lambda x: x["seq"]), "").alias("tile_seq"))


def with_tile(variants: DataFrame, genome: DataFrame, flank: int, span: Column | None = None, longest: int | None = None, size: int = TILE, deal: bool = False) -> DataFrame:
    """Variants with the bases around them: tile_seq, which starts at base number `base` of the contig (from 0).

    It holds `flank` + `span` bases at least on both sides of pos, as far as the contig goes; `span` is the row's
    allele length (0 if not given). Rows are joined with the tile that pos lies in, by chr and tile; those whose span is
    above SHORT_ALLELE have all pieces that they reach put together instead. Where the caller knows the longest span,
    that second way is left out, tiles are padded accordingly, and a row above it is an error, never cut short.
    Rows off their contig go.

    Variants that have a column tile, of tiles of this size, are dealt by it already (see `dealt`); the column goes.

    With deal=True the variants are dealt by chr and tile first, so that those of a few files make use of all tasks. The
    number of parts is given: rows are narrow before the join and wide after it, so their size must not decide.
    """
    tile = F.col("tile") if "tile" in variants.columns else (F.col("pos") / size).cast("long")
    if span is not None and longest is not None and "tile" in variants.columns:
        variants = variants.where(F.when(span > longest, F.raise_error(F.lit(f"an allele is longer than {longest}")).cast("boolean")).otherwise(True))
    elif span is not None and longest is not None:
        tile = F.when(span > longest, F.raise_error(F.lit(f"an allele is longer than {longest}")).cast("long")).otherwise(tile)
    placed = variants.withColumn("tile", tile)
    pad = flank if span is None else flank + (SHORT_ALLELE if longest is None else longest)
    far = None
    if span is not None and longest is None:
        far = _put_together(variants.where(span > SHORT_ALLELE), genome, F.lit(flank) + span, size)
        placed = placed.where(F.coalesce(span <= SHORT_ALLELE, F.lit(True)))
    if deal and "tile" not in variants.columns:
        parts = int(variants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = placed.repartition(parts, "chr", "tile").sortWithinPartitions("chr", "tile")  # whichever join follows, rows of a tile stay together
    near = placed.join(tiles(genome, pad, size), ["chr", "tile"]).drop("tile")
    return near if far is None else near.unionByName(far.select(*near.columns))


def dealt(rows: DataFrame, size: int = TILE) -> DataFrame:
    """The rows with the tile that they lie in, dealt by it: `dedupe` and `with_tile` then move them no more."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("tile", (F.col("pos") / size).cast("long")).repartition(parts, "chr", "tile")


def odd_runs(genome: DataFrame, pad: int, size: int = TILE) -> DataFrame:
    """chr, tile, odd: runs (first, last: bases of the contig, from 0) of other letters than ACGT in a piece and `pad` bases beside it; null if there are none."""
    runs = F.aggregate(
        F.regexp_extract_all("tile_seq", F.lit("[ACGT]+|[^ACGT]+"), F.lit(0)),
        F.struct(F.col("base").cast("long").alias("at"), F.array().cast("array<struct<first: bigint, last: bigint>>").alias("runs")),
        lambda a, part: F.struct(
            (a["at"] + F.length(part)).alias("at"),
            F.when(part.rlike("[^ACGT]"), F.concat(a["runs"], F.array(F.struct(a["at"].alias("first"), (a["at"] + F.length(part) - 1).alias("last"))))).otherwise(a["runs"]).alias("runs"),
        ),
        lambda a: a["runs"],
    )
    return tiles(genome, pad, size).select("chr", "tile", F.when(F.col("tile_seq").rlike("[^ACGT]"), runs).alias("odd"))


def contig_lengths(genome: DataFrame) -> DataFrame:
    """chr, length of a genome in contigs or in pieces."""
    return genome.groupBy("chr").agg(F.sum(F.length("seq").cast("long")).alias("length"))


def contig_heads(genome: DataFrame, n: int, size: int = TILE) -> DataFrame:
    """chr, head: the first n bases of every contig of a genome in contigs or in pieces."""
    if "piece" not in genome.columns:
        return genome.select("chr", F.left("seq", F.lit(n)).alias("head"))
    parts = genome.where(F.col("piece") * size < n).groupBy("chr").agg(F.sort_array(F.collect_list(F.struct("piece", "seq"))).alias("parts"))
    return parts.select("chr", F.left(F.array_join(F.transform("parts", lambda p: p["seq"]), ""), F.lit(n)).alias("head"))


def _put_together(rows: DataFrame, genome: DataFrame, reach: Column, size: int) -> DataFrame:
    """base and tile_seq of rows that reach over many pieces; a row gathers no more than it asks for."""
    columns = rows.columns
    first = F.greatest(((F.col("pos") - reach) / size).cast("long"), F.lit(0).cast("long"))
    each = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("piece", F.explode(F.sequence(first, ((F.col("pos") + reach) / size).cast("long"))))
    met = each.join(pieces(genome, size), ["chr", "piece"])
    whole = met.groupBy("_row", "chr", *[c for c in columns if c != "chr"]).agg(F.sort_array(F.collect_list(F.struct("piece", "seq"))).alias("_pieces"))
    on_contig = whole.where((F.col("pos") / size).cast("long") <= F.element_at("_pieces", -1)["piece"])
    return on_contig.withColumn("base", F.col("_pieces")[0]["piece"] * size).withColumn("tile_seq", F.array_join(F.transform("_pieces", lambda x: x["seq"]), "")).drop("_row", "_pieces")


def drop_snps(variants: DataFrame, a: str = "ref", b: str = "alt") -> DataFrame:
    return variants.where(F.length(a) != F.length(b))


def drop_near_start(variants: DataFrame, least: int = 1000) -> DataFrame:
    return variants.where(F.col("pos") > least)


def split_multiallelic(variants: DataFrame) -> DataFrame:
    """One row for each alternative allele.

    Where there are `calls` (allele numbers as files have them, null if missing), `genotypes` tells for each call whether
    it is the row's allele: the calls of a site's other alleles count as reference.
    """
    own = lambda k: [F.transform("calls", lambda g: (g == k + 1).cast("int")).alias("genotypes")] if "calls" in variants.columns else []
    # Made inside the generator, genotypes are made once; outside, each of their uses would make them again.
    each = variants.withColumn("_one", F.explode_outer(F.transform(F.split("alt", ","), lambda a, k: F.struct(a.alias("alt"), *own(k))))).where("_one is not null")
    made = {"alt": F.col("_one.alt")} | ({"genotypes": F.col("_one.genotypes")} if "calls" in variants.columns else {})
    return each.withColumns(made).drop("_one")


def population_filter(variants: DataFrame, max_missing: float = 0.5, least_minor: int = 1) -> DataFrame:
    """Indels whose calls (or genotypes: 0, 1 or null) are complete and varied enough, a row an alternative allele.

    At most `max_missing` of the calls are missing, and the rarer of allele and rest is called `least_minor` times.
    """
    rows = split_multiallelic(variants)
    called = F.filter("genotypes", lambda g: g.isNotNull())
    ones = F.aggregate(called, F.lit(0), lambda a, g: a + g)
    complete = F.size(called) >= (1 - max_missing) * F.size("genotypes")
    return drop_snps(rows).where(complete & (F.least(ones, F.size(called) - ones) >= least_minor))


def rename_chromosomes(variants: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the named chromosomes, under their new names."""
    lookup = F.create_map(*[x for k, v in sorted(names.items()) for x in (F.lit(k), F.lit(v))])
    return variants.where(F.col("chr").isin(*names)).withColumn("chr", lookup[F.col("chr")])


def drop_single_base(variants: DataFrame, deletions_only: bool = False) -> DataFrame:
    return variants.where(F.col("indel_len") != -1) if deletions_only else variants.where(~F.col("indel_len").isin(1, -1))


def context_matches(variants: DataFrame, window: int) -> DataFrame:
    """Rows whose context is as long as the window and the indel ask for."""
    return variants.where(F.length("context") == 2 * window + 1 + F.length("ref"))


def polarise(variants: DataFrame) -> DataFrame:
    """Adds anc and der; rows whose ancestral state is undecided go."""
    out = variants.withColumn("anc", S.ancestral_allele(F.col("ref"), F.col("alt"), F.col("ancestral")))
    return out.withColumn("der", S.derived_allele(F.col("ref"), F.col("alt"), F.col("ancestral"))).where("anc is not null and der is not null")


def dedupe(variants: DataFrame) -> DataFrame:
    """The first row, by original position and realignment, of each (chr, pos, anc, der)."""
    order = [c for c in ("original_pos", "realign_idx") if c in variants.columns] or ["pos"]
    w = Window.partitionBy("chr", *["tile"] * ("tile" in variants.columns), "pos", "anc", "der").orderBy(*order)
    return variants.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def clean(variants: DataFrame, genome: DataFrame, window: int = 1000) -> DataFrame:
    """Polarised indels whose context of `window` bases on both sides holds ACGT only. Undecided, odd and edge rows go.

    Other letters are looked for once a tile, not once a row: rows meet the tiles' odd runs, no bases. Rows off their contig go.
    """
    kept = drop_near_start(drop_snps(polarise(variants)), window).where(~F.col("anc").contains("N"))
    placed = kept.withColumn("tile", (F.col("pos") / TILE).cast("long"))
    near = placed.join(odd_runs(genome, window + 1), ["chr", "tile"])
    touched = F.exists("odd", lambda r: (r["first"] < F.col("pos") + window) & (r["last"] >= F.col("pos") - window))
    return near.where(F.col("odd").isNull() | ~touched).drop("tile", "odd")


def describe(variants: DataFrame) -> DataFrame:
    """Adds indel_type, indel_len (unsigned), variant_id."""
    original = F.col("original_pos") if "original_pos" in variants.columns else F.col("pos")
    return (
        variants.withColumn("indel_type", S.indel_type(F.col("anc"), F.col("der")))
        .withColumn("indel_len", S.indel_length(F.col("anc"), F.col("der")))
        .withColumn("variant_id", S.variant_id(F.col("chr"), original))
    )


def in_both(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys the other table has too; repeated rows stay, null keys match nothing."""
    return rows.join(others.select(*keys).distinct(), keys, "left_semi")


def only_first(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys the other table lacks; repeated rows and null keys stay."""
    return rows.join(others.select(*keys).distinct(), keys, "left_anti")
