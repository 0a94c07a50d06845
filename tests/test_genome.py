"""The genome layer against plain strings: tiles, long alleles, files read by splits."""

import random

import pytest
from pyspark.sql import functions as F

from breakweave.operators import cleaning, detect, markov, realign
from breakweave.sources import readers

GENOME = "chr string, seq string"


def dna(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def in_pieces(spark, contigs, size):
    rows = [(c, k, s[k * size : (k + 1) * size]) for c, s in contigs for k in range(-(-len(s) // size))]
    return spark.createDataFrame(rows, "chr string, piece long, seq string")


@pytest.mark.parametrize("pad,size", [(0, 8), (3, 8), (20, 8), (5, 64)])
@pytest.mark.parametrize("cut", [False, True])
def test_tiles_are_the_bases_around(spark, pad, size, cut):
    contigs = [("a", dna(200, 1)), ("b", dna(8, 2)), ("c", dna(17, 3)), ("d", "")]
    genome = in_pieces(spark, contigs, size) if cut else spark.createDataFrame(contigs, GENOME)
    got = {(r["chr"], r["tile"]): (r["base"], r["tile_seq"]) for r in cleaning.tiles(genome, pad, size).collect()}
    want = {(c, t): (max(t * size - pad, 0), s[max(t * size - pad, 0) : (t + 1) * size + pad]) for c, s in contigs for t in range(-(-len(s) // size))}
    assert got == want


@pytest.mark.parametrize("longest", [None, 3001])
@pytest.mark.parametrize("cut", [False, True])
def test_alleles_over_many_tiles(spark, longest, cut):
    """Deletions of 1 to 3000 bp of a tandem copy at all offsets of a tile: placements and homology as plain code has them."""
    unit = dna(3000, 5)
    seq = dna(1990, 4) + unit + unit[:1200] + dna(5000, 6)
    genome = in_pieces(spark, [("c", seq)], cleaning.TILE) if cut else spark.createDataFrame([("c", seq)], GENOME)
    rows = [("c", pos, seq[pos - 1 : pos + n], seq[pos - 1]) for pos in range(1500, 2700, 97) for n in (1, 60, 70, 300, 1100, 1500, 3000)]
    variants = spark.createDataFrame([(c, p, r, a, r, a) for c, p, r, a in rows], "chr string, pos long, ref string, alt string, anc string, der string")
    placed = realign.realign(variants, genome, longest=longest).groupBy("original_pos", F.length("ref").alias("n")).agg(F.count(F.lit(1)).alias("k"), F.max("anc").alias("anc")).collect()

    def placements(pos, n):
        up, x, down = seq[pos - 150 : pos], seq[pos : pos + n], seq[pos + n : pos + n + 150]
        left = next((k - 1 for k in range(1, len(up)) if up[-k:] != (up + x)[-k:]), len(up) - 1)
        right = next((k - 1 for k in range(1, len(down)) if down[:k] != (x + down)[:k]), len(down) - 1)
        return left + right + 1

    assert {(r["original_pos"], r["n"] - 1): r["k"] for r in placed} == {(p, len(r) - 1): placements(p, len(r) - 1) for _, p, r, _ in rows}
    found = detect.with_context(variants, genome, longest=longest).withColumn("k_max", detect.longest_mh(variants))
    for r in found.collect():
        pos, n = r["pos"], r["indel_len"]
        assert r["up"] == seq[max(pos - 50 - n, 0) : pos] and r["down"] == seq[pos : pos + 50 + n + 1] and r["around"] == seq[pos - 1000 : pos + 1000]
        assert r["k_max"] == next((k - 1 for k in range(1, n + 1) if r["up"][-k:] != r["indel"][-k:]), n)


def test_an_allele_above_the_stated_length_is_an_error(spark):
    genome = spark.createDataFrame([("c", dna(4000, 1))], GENOME)
    rows = spark.createDataFrame([("c", 1500, "A" * 40, "A", "A" * 40, "A")], "chr string, pos long, ref string, alt string, anc string, der string")
    with pytest.raises(Exception, match="longer than 31"):
        realign.realign(rows, genome, longest=31).collect()


def test_trimers_of_contigs_and_pieces(spark):
    contigs = [("a", dna(5000, 1)), ("b", dna(1500, 2) + "N" + dna(700, 3)), ("c", "AC"), ("d", dna(1024, 4)), ("e", dna(1026, 5))]
    want = {}
    for c, s in contigs:
        for k in range(len(s) - 2):
            if "N" not in s[k : k + 3]:
                want[c, s[k : k + 2], s[k + 2]] = want.get((c, s[k : k + 2], s[k + 2]), 0) + 1
    whole = spark.createDataFrame(contigs, GENOME)
    for counts in (markov.genome_trimers(whole), markov.genome_trimers(in_pieces(spark, contigs, cleaning.TILE)), markov.trimer_counts(whole.withColumnRenamed("seq", "context"), "chr")):
        assert {(r["chr"], r["dimer"], r["base"]): r["n"] for r in counts.collect()} == want


@pytest.fixture
def split_finely(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("width", [7, 60, 5000])
def test_fasta_by_splits(spark, split_finely, tmp_path, width):
    contigs = [("one", dna(3100, 1)), ("two", dna(5, 2)), ("none", ""), ("three", dna(2048, 3).lower()), ("four", dna(1023, 4))]
    for k, part in enumerate((contigs[:3], contigs[3:])):
        text = "".join(f">{c} some words\n" + "".join(s[i : i + width] + ("\r\n" if k else "\n") for i in range(0, len(s), width)) for c, s in part)
        (tmp_path / f"{k}.fa").write_text(text, newline="")
    pieces = readers.fasta_pieces(spark, str(tmp_path))
    got = {(r["chr"], r["piece"]): r["seq"] for r in pieces.collect()}
    assert got == {(c, k): s.upper()[k * 1024 : (k + 1) * 1024] for c, s in contigs for k in range(-(-len(s) // 1024))}
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    n = {r["chr"]: r["length"] for r in cleaning.contig_lengths(pieces).collect()}
    assert n == {c: len(s) for c, s in contigs if s}
    heads = {r["chr"]: r["head"] for r in cleaning.contig_heads(pieces, 1500).collect()}
    assert heads == {c: s.upper()[:1500] for c, s in contigs if s}


def test_fastq_by_splits(spark, split_finely, tmp_path):
    rng = random.Random(1)
    records = [(f"r{k} x", dna(rng.randint(1, 40), k), "".join(rng.choice("@+>!I#") for _ in range(9))) for k in range(300)]
    for f in range(2):
        (tmp_path / f"{f}.fq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records[f::2]) + ("@cut\nACG\n" if f else ""))
    got = readers.fastq(spark, str(tmp_path))
    assert sorted((r["name"], r["read"], r["qual"]) for r in got.collect()) == sorted(records)


def test_empty_alleles_get_their_anchor(spark):
    seq = dna(3000, 9)
    genome = spark.createDataFrame([("c", seq)], GENOME)
    rows = [("c", 1025, seq[1024:1027], "-"), ("c", 2049, ".", "GG"), ("c", 100, seq[99:101], seq[99])]
    got = readers.anchored_alleles(spark.createDataFrame(rows, "chr string, pos long, ref string, alt string"), genome)
    assert sorted(map(tuple, got.collect())) == sorted([("c", 1024, seq[1023:1027], seq[1023]), ("c", 2048, seq[2047], seq[2047] + "GG"), rows[2]])
