"""Plans whose cost must not grow faster than their input."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from breakweave.operators import aligner, cleaning, detect, markov, realign, simulate
from breakweave.sources import readers, world

DATA = "/root/testdata/sf0.001"


def nodes(plan):
    """All nodes of an executed plan, stages of adaptive execution included."""
    yield plan
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    name = plan.getClass().getSimpleName()
    children += [plan.plan()] if name.endswith("QueryStageExec") else []
    children += [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else []
    for c in children:
        yield from nodes(c)


def test_sites_are_not_broadcast(spark):
    """Sites look as small to the planner as the contigs that they are exploded from."""
    rng = random.Random(1)
    contigs = spark.createDataFrame([(f"c{k}", "".join(rng.choices("ACGT", k=20000))) for k in range(20)], "chr string, seq string").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        sites = simulate.sites(contigs, 0.05, 3, 1100)
        for made in (simulate.nhej_deletions(sites, contigs, 1, 20, 5), simulate.copied_insertions(sites, contigs, 1, 20, 5)):
            run = made._jdf.queryExecution()
            assert run.toRdd().count() > 15000
            assert not [n for n in nodes(run.executedPlan()) if n.getClass().getSimpleName() == "BroadcastExchangeExec"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sites_are_made_in_many_tasks(spark):
    """The lengths that sites are exploded from are too small to tell how many sites there are."""
    contigs = spark.createDataFrame([(f"c{k}", "ACGT" * 1000) for k in range(40)], "chr string, seq string")
    sites = simulate.sites(contigs, 0.05, 3, 1100)
    assert sites.count() == 40 * 90
    assert sites.select(F.spark_partition_id().alias("part")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_small_files_do_not_tempt_the_planner_to_broadcast_sites(spark, tmp_path):
    """Places, and what is known of them, come from files of a few bytes, below every threshold, but neither they nor their tiles are broadcast."""
    rng = random.Random(4)
    rows = [(f"c{k}", "".join(rng.choices("ACGT", k=5000))) for k in range(4)]
    spark.createDataFrame(rows, "chr string, seq string").write.parquet(str(tmp_path / "genome"))
    contigs = spark.read.parquet(str(tmp_path / "genome"))
    sites = simulate.sites(contigs, 0.05, 3, 1100)
    made = {
        "g2": simulate.mmej_deletions(sites, contigs, 4, 50),
        "g3": simulate.copied_insertions(sites, contigs, 1, 20, 5),
        "g4": simulate.loop_out_insertions(sites, contigs, 3, 3, 60),
        "g5": simulate.snap_back_insertions(sites, contigs, 3, 3, 60),
        "g6": simulate.trans_mmej(sites, contigs, 3, 3, 50, 12),
    }
    for name, records in made.items():
        run = records._jdf.queryExecution()
        assert run.toRdd().count() > 0, name
        assert not [n for n in nodes(run.executedPlan()) if n.getClass().getSimpleName() == "BroadcastExchangeExec"], name


def test_clean_meets_no_bases(spark):
    """Contexts are judged by their tiles' odd runs, as a plain program judges them by their letters; no row carries a tile."""
    rng = random.Random(2)
    seq = list("".join(rng.choices("ACGT", k=9000)))
    seq[2500], seq[6000:6040] = "N", "nNRY" * 10
    seq = "".join(seq)
    places = range(900, 8999, 7)
    variants = spark.createDataFrame([*(("c", p, seq[p - 1 : p + 2], seq[p - 1], 0) for p in places), ("c", 20000, "ACG", "A", 0)], "chr string, pos long, ref string, alt string, ancestral int")
    contigs = spark.createDataFrame([("c", seq)], "chr string, seq string")
    pieces = cleaning.pieces(contigs)
    want = [p for p in places if p > 1000 and not set(seq[p - 1000 : p + 1000]) - set("ACGT") and "N" not in seq[p - 1 : p + 2]]
    for genome in (contigs, pieces):
        out = cleaning.clean(variants, genome)
        assert sorted(r["pos"] for r in out.select("pos").collect()) == want
        run = cleaning.clean(variants, genome).agg(F.count(F.lit(1)))._jdf.queryExecution()
        run.toRdd().count()
        joins = [n for n in nodes(run.executedPlan()) if n.getClass().getSimpleName().endswith("JoinExec")]
        assert joins and not [n for n in joins if "tile_seq" in n.output().toString()]


def test_both_readings_come_from_one_row(spark):
    """The reversed reading is made beside the given one: the table is read once."""
    schema = "variant_id string, indel_type string, indel_len int, up string, indel string, down string, around string, around_far string, direction int"
    rows = spark.createDataFrame([("i", "INS", 2, "AAC", "GT", "GTCCA", "x", "yz", 0), ("d", "DEL", 2, "AAC", "GT", "GTCCA", "x", "yz", 0)], schema)
    pick = lambda frame: {(r["variant_id"], r["direction"]): (r["up"], r["indel"], r["down"], r["around"]) for r in frame.collect()}
    given, turned = ("AAC", "GT", "GTCCA"), ("ACC", "TG", "TGCAA")
    both = detect.both_directions(rows)
    assert pick(both) == {("i", 0): (*given, "x"), ("i", 1): (*turned, "x"), ("d", 0): (*given, "x")}
    every = detect.both_directions(rows, crispr=True)
    assert pick(every) == {("i.0", 0): (*given, "x"), ("i.1", 1): (*turned, "x"), ("d.0", 0): (*given, "x"), ("d.1", 1): (*turned, "zy")}
    for frame in (both, every):
        frame._jdf.queryExecution().toRdd().count()
        assert not [n for n in nodes(frame._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "UnionExec"]


def test_pairs_of_the_same_lengths_are_aligned_together(monkeypatch):
    """A batch takes one pass for each two lengths, not one for each pair, and gives each pair what it has alone."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("AC", k=n))
    pairs = [(up + word(n) + down, up + word(2) + down) for n in (3, 7) for up, down in ((word(12), word(12)) for _ in range(100))] + [("", "A"), ("AC", "AC")]
    for scores in (aligner.LOCAL, aligner.GLOBAL):
        alone = [aligner.first_records(*p, scores) for p in pairs]
        passes = []
        with monkeypatch.context() as m:
            plain = aligner.suffix_scores
            m.setattr(aligner, "suffix_scores", lambda *a: passes.append(1) or plain(*a))
            assert aligner.first_records_of(pairs, scores) == alone
            assert len(passes) == 3
            m.setattr(aligner, "CELLS", 1000)
            assert aligner.first_records_of(pairs, scores) == alone


def test_trimers_of_many_contexts_are_counted_at_once(monkeypatch):
    """Contexts are counted together, odd letters and short ones among them, as each is alone; not a call a context."""
    rng = random.Random(6)
    contexts = ["".join(rng.choices("ACGTN", (9, 9, 9, 9, 1), k=rng.choice((0, 1, 2, 3, 50, 300)))) for _ in range(200)] + ["", "A", "AC", "ACG", "é" * 5]
    calls = []
    plain = np.bincount
    monkeypatch.setattr(markov.np, "bincount", lambda *a, **k: calls.append(1) or plain(*a, **k))
    m, f = markov._tables(contexts)
    assert len(calls) == 1
    monkeypatch.setattr(markov, "LETTERS", 1000)
    again = markov._tables(contexts)
    assert (again[0] == m).all() and (again[1] == f).all() and len(calls) > 3
    for r, text in enumerate(contexts):
        grams = lambda w: [text[i : i + w] for i in range(len(text) - w + 1)]  # noqa: E731, B023
        n = np.array([[[grams(3).count(a + b + c) for c in "ACGT"] for b in "ACGT"] for a in "ACGT"]) + markov.EPSILON
        assert np.allclose(m[r], n / n.sum(2, keepdims=True), rtol=1e-12, atol=0)
        assert np.allclose(f[r], np.array([[grams(2).count(a + b) for b in "ACGT"] for a in "ACGT"]) / max(len(text) - 1, 1) + markov.EPSILON, rtol=1e-12, atol=0)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_variants_are_spelt_from_short_tiles(spark, monkeypatch):
    """Each variant has its tile copied next to it: no more than 512 bases, which spell the same alleles as longer ones."""
    met, plain = [], world.with_tile
    monkeypatch.setattr(world, "with_tile", lambda *a, **k: met.append(plain(*a, **k)) or met[-1])
    contigs = world.genome(spark, DATA)
    short = world.variants(spark, DATA, contigs)
    assert met[0].agg(F.max(F.length("tile_seq"))).first()[0] <= 512
    monkeypatch.setattr(world, "with_tile", lambda *a, size, **k: plain(*a, **k))
    assert sorted(short.collect()) == sorted(world.variants(spark, DATA, contigs).collect())


def test_letters_of_a_tile_are_counted_once(spark, monkeypatch):
    """Scores and counts of motifs in a tile are those of each row's own surroundings; a tile is read once, not once a row."""
    rng = random.Random(7)
    seq = "".join(rng.choices("ACGTN", (99, 99, 99, 99, 1), k=6000))
    places = sorted(rng.choices(range(900, 5900), k=400))
    motif = lambda p: rng.choice((None, "", seq[p : p + rng.randrange(1, 9)]))
    rows = [("c", p, motif(p), rng.randrange(-1, 30), seq[p - 2 : p], motif(p), rng.randrange(30), seq[p : p + 2]) for p in places]
    names = ["chr", "pos", "motif0", "dist0", "memory0", "motif1", "dist1", "memory1"]
    variants = spark.createDataFrame(rows, "chr string, pos long, motif0 string, dist0 int, memory0 string, motif1 string, dist1 int, memory1 string")
    near = cleaning.with_tile(variants, spark.createDataFrame([("c", seq)], "chr string, seq string"), 1000, deal=True)
    found = markov.scored_in_tiles(near, 2)
    assert found.columns[:2] == ["chr", "pos"] and found.count() == len(rows)
    batch = near.select(*names, "base", "tile_seq").toArrow().combine_chunks().to_batches()[0]
    made, plain = [], markov.Tile
    monkeypatch.setattr(markov, "Tile", lambda text: made.append(1) or plain(text))
    got, _ = markov._near(batch, (None,) * 4, 2, True)
    assert 0 < len(made) <= 6
    got = [c.to_pylist() for c in got]
    given = batch.to_pylist()
    around = [seq[max(r["pos"] - 1000, 0) : r["pos"] + 1000] for r in given]
    for k in (0, 1):
        want = markov.markov_scores(around, [r[f"motif{k}"] for r in given], [r[f"dist{k}"] for r in given], [r[f"memory{k}"] for r in given])
        for j in range(4):
            assert [x if x is not None else "-" for x in got[5 * k + j]] == [x if x == x else "-" for x in want[:, j].tolist()]
        times = lambda text, m: sum(text.startswith(m, i) for i in range(len(text) - len(m) + 1)) if m else 0
        assert got[5 * k + 4] == [None if r[f"motif{k}"] is None else times(a, r[f"motif{k}"]) for r, a in zip(given, around, strict=True)]
    assert sorted(map(str, zip(*got, strict=True))) == sorted(str(tuple(r)[2:]) for r in found.collect())


def test_only_rows_for_the_aligner_are_on_the_way_to_it(spark):
    """Pure indels are slid by built-in expressions alone: their branch has no Python step."""
    rows = spark.createDataFrame([("c", 50, "AC", "A", "AC", "A"), ("c", 60, "ACG", "TT", "ACG", "TT")], "chr string, pos long, ref string, alt string, anc string, der string")
    genome = spark.createDataFrame([("c", "ACGT" * 100)], "chr string, seq string")
    found = realign.realign(rows, genome, flank=20, longest=3)
    assert {r["realign_mode"] for r in found.collect()} == {"pure", "complex"}
    plan = found.where("realign_mode = 'pure'")._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan


def test_placements_move_once(spark):
    """Rows dealt by tile are deduplicated and meet their tiles where they lie; the result is that of the plain way."""
    rng = random.Random(8)
    seq = "".join(rng.choices("ACGT", k=5000))
    rows = [("c", p, seq[p - 1 : p + 2], seq[p - 1], p - rng.randrange(3), 1 + rng.randrange(3)) for p in rng.choices(range(100, 4900), k=3000)]
    placed = spark.createDataFrame(rows, "chr string, pos long, anc string, der string, original_pos long, realign_idx int")
    genome = spark.createDataFrame([("c", seq)], "chr string, seq string")
    plain = detect.with_context(cleaning.dedupe(placed), genome, longest=4)
    once = detect.with_context(cleaning.dedupe(cleaning.dealt(placed)), genome, longest=4)
    assert sorted(once.select(*plain.columns).collect()) == sorted(plain.collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moves = []
        for frame in (plain, once):
            run = frame._jdf.queryExecution()
            run.toRdd().count()
            moves.append(len([n for n in nodes(run.executedPlan()) if n.getClass().getSimpleName() == "ShuffleExchangeExec"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moves == [3, 2]
    with pytest.raises(Exception, match="longer than 1"):
        detect.with_context(cleaning.dealt(placed), genome, longest=1).collect()


def test_filters_do_not_parse_calls_again(spark, tmp_path):
    """Calls are parsed where alternatives are told apart, not in each filter; odd calls are read as before."""
    lines = ["##x", "c\t5\t.\tA\tAC,ACC\t.\t.\t.\tGT:DP\t0|1:3\t./2:4\t1/1\t.:1\tx|2", "c\t6\t.\tA\tAC\t.\t.\t.\tGT"]
    (tmp_path / "v.vcf").write_text("\n".join(lines) + "\n")
    rows = readers.vcf_genotypes(spark, str(tmp_path / "v.vcf"))
    assert [r["calls"] for r in rows.orderBy("pos").collect()] == [[0, 1, None, 2, 1, 1, None, None, 2], []]
    split = {(r["pos"], r["alt"]): r["genotypes"] for r in cleaning.split_multiallelic(rows).collect()}
    assert split == {(5, "AC"): [0, 1, None, 0, 1, 1, None, None, 0], (5, "ACC"): [0, 0, None, 1, 0, 0, None, None, 1], (6, "AC"): []}
    kept = cleaning.population_filter(rows, 0.5, 2)
    assert sorted(r["alt"] for r in kept.collect()) == ["AC", "ACC"]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring_index(") == 1
