"""Merged intervals and the signed-rank test against plain code."""

import itertools
import random

import pytest

from breakweave.operators import blocks, intervals


@pytest.mark.parametrize("size", [4, 64, 4096])
def test_merged_intervals(spark, size):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), s := rng.randint(0, 900), s + rng.choice([0, 1, 3, 40])) for _ in range(200)] + [("a", 100, 700), ("b", 5, 5)] + [("hot", 7, 9 + k % 3) for k in range(100)]
    got = sorted((r["chr"] or "", r["start"], r["end"]) for r in intervals.merged(spark.createDataFrame(rows, "chr string, start long, end long"), size).collect())
    want = []
    for c in {r[0] for r in rows}:
        for _, s, e in sorted(r for r in rows if r[0] == c):
            if want and want[-1][0] == (c or "") and s <= want[-1][2]:
                want[-1][2] = max(want[-1][2], e)
            else:
                want.append([c or "", s, e])
    assert got == sorted(map(tuple, want))


def test_exact_chance_lists_all_signs():
    for n in (1, 3, 7):
        sums = [sum(k for k, s in enumerate(signs, 1) if s) for signs in itertools.product([0, 1], repeat=n)]
        for w in range(n * (n + 1) // 4 + 1):
            assert blocks.rank_sum_chance(w, n) == min(1, 2 * sum(x <= w for x in sums) / 2**n)


def test_wilcoxon_of_few_and_many(spark):
    some = spark.createDataFrame([(float(k), 0.0) for k in (1, -2, 3, 4, 5, -6, 7)], "x double, y double")
    r = blocks.wilcoxon(some, "x", "y").first()
    assert (r["w"], r["n"]) == (8.0, 7) and abs(r["p"] - blocks.rank_sum_chance(8, 7)) < 1e-12
    none = blocks.wilcoxon(some.where("x = y"), "x", "y").first()
    assert (none["w"], none["n"], none["z"], none["p"]) == (0.0, 0, None, None)
    tied = blocks.wilcoxon(spark.createDataFrame([(float(k % 9) - 3, 0.0) for k in range(900)], "x double, y double"), "x", "y").first()
    assert tied["n"] == 800 and 0 < tied["p"] < 0.05
