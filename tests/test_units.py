"""Hand-worked cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from breakweave.functions import sequence as S
from breakweave.operators import blocks, cleaning, detect, em, emq, evaluate, intervals, markov, reads, realign


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def test_microhomology_run_and_slots(spark):
    row = one(spark, up="GGTTGACG", indel="TTACG", indel_len=5)
    row = row.withColumn("k_max", detect.longest_mh(row))
    assert row.first()["k_max"] == 3
    got = lambda lengths: [m["cand"] for m in row.select(detect.mh_candidates(lengths).alias("m")).first()["m"]]
    assert got([4, 3, 2, 1]) == ["", "ACG", "CG", "G"]
    assert got([0, 2]) == ["ACG", "CG"]


def test_repeat_unit_and_motifs(spark):
    row = one(spark, a="ATATAT", b="ACG", c="AAAA", m="AA")
    r = row.select(S.repeat_unit(F.col("a")).alias("a"), S.repeat_unit(F.col("b")).alias("b"), S.motif_ends(F.col("c"), F.col("m")).alias("e")).first()
    assert (r["a"], r["b"], r["e"]) == ("AT", "ACG", [2, 3, 4])


def test_seeds():
    assert "TCCGA" in detect._snap("GT", "CCG" + "AGTTTTCGGAC", "CCG")["inv_comp_pattern"]
    assert detect._loop("GT", "CCG" + "AGTTTTCCGAC", "CCG")["pattern"] == "TCCGA"
    assert detect._snap("GT", "CCGAGGGGGGG", "CCG") is None
    assert detect._loop("", "", "") is None


def test_realignment_rebuilds_the_mutant(spark):
    genome = spark.createDataFrame([("c", "GCACACAT")], "chr string, seq string")
    variant = spark.createDataFrame([("c", 1, "GCA", "G", 0)], "chr string, pos long, ref string, alt string, ancestral int")
    rows = realign.realign(cleaning.polarise(variant), genome).orderBy("realign_idx").collect()
    seq = "GCACACAT"
    made = {seq[: r["pos"] - 1] + r["der"] + seq[r["pos"] - 1 + len(r["anc"]) :] for r in rows}
    assert made == {"GCACAT"}
    assert [r["pos"] for r in rows] == [1, 2, 3, 4, 5]
    assert all(seq[r["pos"] - 1 :].startswith(r["anc"]) for r in rows)


def test_transition_row(spark):
    table = markov.transition_table(spark.createDataFrame([("x", "ACGTACGT")], "id string, context string"))
    p = table.where("dimer = 'AC' and base = 'G'").first()["p"]
    assert abs(p - (2 + 1e-6) / (2 + 4e-6)) < 1e-12
    assert all(abs(r["s"] - 1) < 1e-9 for r in table.groupBy("dimer").agg(F.sum("p").alias("s")).collect())


def plain_markov(context, motif, distance, memory):
    """The model spelt out state by state."""
    bases = "ACGT"
    count = {a + b: {c: 1e-6 for c in bases} for a in bases for b in bases}
    for i in range(len(context) - 2):
        if set(context[i : i + 3]) <= set(bases):
            count[context[i : i + 2]][context[i + 2]] += 1
    m = {d: {c: n / sum(row.values()) for c, n in row.items()} for d, row in count.items()}
    states = [{d: float(d == memory[-2:]) for d in m}]
    states.append({d: (sum(states[0][x] * m[x][d[1]] for x in m) if d[0] == memory[-1] else 0.0) for d in m})
    d = distance + 2
    while len(states) <= d:
        states.append({x: sum(states[-1][a + x[0]] * m[a + x[0]][x[1]] for a in bases) for x in m})

    def p(t):
        if len(motif) == 1:
            return sum(v for k, v in states[t - 1].items() if k[1] == motif)
        out = states[t][motif[:2]]
        for k in range(len(motif) - 2):
            out *= m[motif[k : k + 2]][motif[k + 2]]
        return out

    q = [abs(1 - p(t)) for t in range(2, d + 1)]
    lk = float(np.prod(q[:-1]) * (1 - q[-1]))
    p_val = sum(float(np.prod(q[: i - 1]) * (1 - q[i - 1])) for i in range(d - 1, 1, -1))
    return lk, p_val, p(d)


def test_markov_scores_equal_the_long_way():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(30):
        context = "".join(rng.choice(list("ACGTN"), 300, p=[0.3, 0.2, 0.2, 0.29, 0.01]))
        motif = "".join(rng.choice(list("ACGT"), rng.integers(1, 5)))
        rows.append((context, motif, int(rng.integers(0, 25)), "".join(rng.choice(list("ACGT"), 2))))
    got = markov.markov_scores(*map(list, zip(*rows, strict=True)))
    for row, g in zip(rows, got, strict=True):
        assert np.allclose(g[:3], plain_markov(*row), rtol=1e-9, atol=1e-12)


def test_p_value_closed_form():
    q = [0.9, 0.8, 0.7, 0.6]
    assert abs(q[0] - np.prod(q) - 0.5976) < 1e-12


def test_em_step(spark):
    rows = spark.createDataFrame([("v1", 0.2), ("v1", 0.8), ("v2", 0.5)], "variant_id string, p double")
    assert abs(em.em_round(em.gathered(rows), 0.9) - 0.572) < 1e-12
    assert em.em(rows)[0] is None  # too few rows


def test_block_and_quantile(spark):
    row = one(spark, pos=5, x=1.0)
    assert row.select(blocks.block_id(F.col("pos"), 2)).first()[0] == 2
    rows = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    assert abs(blocks.quantile_interval(rows, "x", 0.9).first()["high"] - 3.8) < 1e-12


def test_confusion_counts_ties_as_errors(spark):
    rows = spark.createDataFrame([(0.5, True), (0.5, False)], "s double, g boolean")
    r = rows.agg(*[c.alias(k) for k, c in evaluate.confusion(F.col("s"), F.col("g"), F.lit(0.5)).items()]).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (0, 1, 0, 1)


def test_intervals(spark):
    a = spark.createDataFrame([("c", 5, 10, 1), ("c", 4090, 4100, 2), ("d", 5, 6, 3)], "chr string, start long, end long, id int")
    b = spark.createDataFrame([("c", 0, 10), ("c", 4000, 4099), ("c", 4000, 9000)], "chr string, start long, end long")
    ids = lambda f: sorted(r["id"] for r in f.collect())
    assert ids(intervals.inside(a, b)) == [1, 2]
    assert ids(intervals.outside(a, b)) == [3]
    assert ids(intervals.overlapping(a, b)) == [1, 2, 2]
    assert intervals.merged(b).orderBy("start").collect()[1]["end"] == 9000


def test_smoothing_keeps_lines_and_mass():
    line = np.linspace(1, 2, 120)
    out = emq.smooth(line / line.sum(), "savitzky_golay")
    assert abs(out.sum() - 1) < 1e-12
    assert np.allclose(np.diff(out)[:20], np.diff(out)[0])


def test_reads(spark):
    ref = "ACGTACGTAA" + "TTGCATGCAT"
    rows = spark.createDataFrame(
        [("a", ref, "20M"), ("b", ref[:8] + ref[12:], "8M4D8M"), ("c", ref[:10] + "CC" + ref[10:], "10M2I10M"), ("d", ref, "5S15M")], "name string, read string, cigar string"
    )
    got = {r["name"]: r["class"] for r in reads.classify(rows, ref, 10, 10).collect()}
    assert got == {"a": "exact", "b": "deletion", "c": "insertion"}
    trimmed = reads.trim_and_pad(rows.withColumn("qual", F.repeat(F.lit("I"), F.length("read"))), "CGTA", "GCAT", "N", "").where("name = 'a'").first()
    assert trimmed["read"] == "N" + ref[1:]


def test_readers(spark, tmp_path):
    from breakweave.sources import readers

    (tmp_path / "v.tsv").write_text("#c\nchr1\t5\tA\tAT\t0\nchr1\t9\tAT\tA\t1\n")
    assert readers.variants_tsv(spark, str(tmp_path / "v.tsv")).count() == 2
    (tmp_path / "g.fa").write_text(">chr1 x\nacgt\nAC\n>chr2\nGG\n")
    assert {r["chr"]: r["seq"] for r in readers.fasta(spark, str(tmp_path / "g.fa")).collect()} == {"chr1": "ACGTAC", "chr2": "GG"}
    (tmp_path / "r.fastq").write_text("@r1\nACGT\n+\nIIII\n@r2\nGG\n+\n@@\n")
    assert [(r["name"], r["read"], r["qual"]) for r in readers.fastq(spark, str(tmp_path / "r.fastq")).collect()] == [("r1", "ACGT", "IIII"), ("r2", "GG", "@@")]


def test_motif_score_and_accession_context(spark):
    row = one(spark, s="AAAAACGTAC", m="AC", ctx="AACCGGTT", r="CG", a="TT")
    got = row.select(
        S.motif_score(F.col("s"), F.col("m"), 5, F.lit(3)).alias("q"),
        S.accession_context(F.col("ctx"), 4, F.lit("DEL"), F.col("r"), F.col("a")).alias("d"),
        S.accession_context(F.col("ctx"), 4, F.lit("INS"), F.col("r"), F.col("a")).alias("i"),
    ).first()
    assert abs(got["q"] - 1 / (1 + 1 / 4 / 5)) < 1e-12
    assert (got["d"], got["i"]) == ("AACGTT", "AACCGTTGTT"[:5] + "TT" + "GTT")


def test_other_tools_calls(spark):
    calls = spark.createDataFrame([(0, 3, 5)], "id int, left int, right int")
    r = reads.called_deletions(calls, "ACGTACGT", "d").first()
    assert (r["chr"], r["pos"], r["ref"], r["alt"]) == ("d0", 3, "GTA", "G")
    calls = spark.createDataFrame([(0, 3, 6, "ACGTTTACGT")], "id int, left int, right int, reconstructed string")
    r = reads.called_insertions(calls, "i").first()
    assert (r["ref"], r["alt"]) == ("G", "GTT")


def test_least_of_each_is_the_plain_rank(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("kind"), F.md5(F.col("id").cast("string")).alias("h"))
    for size in (0, 7, 1500):
        got = blocks.least_of_each(rows, ["kind"], F.left("h", F.lit(1)), [F.col("h"), F.col("id")], F.lit(size)).collect()
        every = rows.collect()
        want = {r["id"] for kind in (None, 1, 2) for r in sorted((x for x in every if x["kind"] == kind), key=lambda x: x["h"])[:size]}
        assert sorted(r["id"] for r in got) == sorted(want)
    assert blocks.least_of_each(rows.limit(0), ["kind"], F.left("h", F.lit(1)), [F.col("h")], F.lit(5)).count() == 0


def test_rows_by_their_keys(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("x",), ("x",), (None,)], "k string")
    assert [r["k"] for r in cleaning.in_both(a, b, ["k"]).collect()] == ["x", "x"]
    assert {r["k"] for r in cleaning.only_first(a, b, ["k"]).collect()} == {"y", None}


def test_lengths_that_do_not_fit_are_an_error(spark):
    rows = spark.createDataFrame([("a", 3, [2]), ("b", 50, [1])], "variant_id string, len int, mmej array<int>")
    with pytest.raises(ValueError, match="50 does not fit"):
        emq.fit(rows, ["nhej", "mmej"], window=50)
    theta, dists, log = emq.fit(rows.where("len < 50"), ["nhej", "mmej"], window=50)
    assert abs(theta.sum() - 1) < 1e-12 and emq.length_log(spark, ["nhej", "mmej"], log).count() == 2 * 50 * len(log)
