"""Resampling by a tree of draws."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.operators import ranking as K
from casebook.operators import resampling as R


@pytest.mark.parametrize("n", [1, 5, 128, 129, 1_000, 5_003])
def test_counts_are_whole_and_even(n):
    m = -(-n // 128)
    stream = R._stream(400, 7, 0)
    counts = np.concatenate([R.leaf_counts(n, m, leaf, stream) for leaf in range(m)], 1)
    assert counts.shape == (400, n) and (counts.sum(1) == n).all()
    if n > 100:  # multinomial: each case about once, with a variance of nearly 1, neighbours hardly related
        assert abs(counts.var() - (1 - 1 / n)) < 0.05
        assert np.abs(counts.mean(0) - 1).max() < 6 / np.sqrt(400)
        halves = counts[:, : n // 2].sum(1)
        assert abs(halves.mean() - n // 2) < 4 * np.sqrt(n / 4 / 400) + 1 and 0.8 < halves.std() / np.sqrt(n * (n // 2 / n) * (1 - n // 2 / n)) < 1.2


def test_leaf_of_place():
    for n in range(1, 700):
        m = -(-n // 128)
        for i in range(n):
            r = ((i + 1) * m - 1) // n
            assert r * n // m <= i < (r + 1) * n // m


def test_intervals_and_repeats(spark):
    g = np.random.default_rng(1)
    cases = spark.createDataFrame([(i, "ab"[i % 2], float(x), None if i % 3 else float(x)) for i, x in enumerate(g.normal(5, 2, 4_000))], "uid long, cls string, v double, w double")
    a = K.bootstrap_mean_ci(cases, "v", 1_000, 3).first()
    b = K.bootstrap_mean_ci(cases.repartition(5), "v", 1_000, 3).first()
    assert a.n == b.n and np.allclose([a.mean, a.low, a.high], [b.mean, b.low, b.high], atol=1e-12)  # whatever the partitions, up to the order of sums
    half = 1.96 * 2 / np.sqrt(4_000)
    assert abs((a.high - a.low) / 2 - half) < 0.15 * half and a.low < a.mean < a.high
    gaps = K.bootstrap_mean_ci(cases, "w", 1_000, 3).first()
    half = 1.96 * 2 / np.sqrt(4_000 / 3)
    assert abs((gaps.high - gaps.low) / 2 - half) < 0.2 * half
    macro = K.bootstrap_stratified_macro(cases, "v", "cls", 1_000, 3).first()
    assert abs((macro.high - macro.low) / (a.high - a.low) - 1) < 0.15
    assert K.bootstrap_mean_ci(cases, "v", 1_000, 4).first() != a
    sums = R.resampled_sums(cases, ["v"], 50, 3, ["cls"])
    assert sums.where("drawn <> 2000").count() == 0 and sums.count() == 100
    assert R.resampled_sums(cases.limit(0), ["v"], 50, 3).count() == 0


def test_a_million_cases(spark):
    """No row per case and replicate: what is shuffled is sums of tasks."""
    cases = spark.range(1_000_000).select(F.col("id").alias("uid"), (F.col("id") % 1000).cast("double").alias("v"))
    began = time.time()
    got = K.bootstrap_mean_ci(cases, "v", 200, 5).first()
    half = 1.96 * 288.7 / 1_000
    assert got.n == 1_000_000 and abs(got.mean - 499.5) < 1e-6 and abs((got.high - got.low) / 2 - half) < 0.2 * half
    assert time.time() - began < 300
