"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from breakweave.plans import registry

DATA = "/root/testdata/sf0.001"
QUICK = ["s6_genome", "f1_f4_clean", "p5_p22_scalars", "r1_realign", "a19_mh_length_distribution", "m2_slippage", "m3_m4_seeds", "e2_posterior", "a4_a5_block_bootstrap", "v1_v3_roc", "j6_contained", "h11_sam_to_variants", "g2_mmej_deletions",
    "p9_p26_scalars", "p16_p20_gaps_and_melting", "e_types_probabilities", "e3_bootstrap_em", "a8_em_by_length_bin", "u2_shared_ids", "v5_bootstrapped_roc", "v6_mixtures", "h1_h7_read_classes", "h8_read_errors",
    "a25_read_counts", "g3_copied_insertions", "g4_loop_out_insertions", "g5_snap_back_insertions", "g6_trans_mmej", "g8_g9_matched_lengths",
    "s1_variant_files", "s4_p3_p4_vcf_alleles", "s6_fasta_pieces", "s8_sam_files", "s9_fastq_files", "s12_block_files", "f10_population_filters", "k2_trimer_counts", "k10_markov_scores", "k11_total_probability",
    "e1_em", "s13_em_log", "j6_merged", "a22_exact_wilcoxon", "g7_target_size", "q6_both_directions", "m3_m4_pattern_fields"]
TABLES = [t.removesuffix(".parquet") for t in os.listdir(DATA)] if os.path.isdir(DATA) else []


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    text = lambda v: "~" if v is None or v != v else f"{v:.8f}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[k]) for k in order) for r in found)


@pytest.mark.skipif(not TABLES, reason="no tables here")
@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = registry.queries()[name](spark, DATA)
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
