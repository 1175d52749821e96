"""All of the reference's replicates, against draws made the plain way."""

import hashlib

import numpy as np
import pytest

from vocalith.operators import metrics as S
from vocalith.plans.score_queries import SAMPLES


def macro(rows):
    f1 = []
    for c in range(3):
        n = sum((t == c) + (p == c) for t, p in rows)
        f1.append(2 * sum(t == c == p for t, p in rows) / n if n else 0.0)
    return sum(f1) / 3


def drawn(r, n):
    return [int(hashlib.md5(f"b:{r}:{j // 4}".encode()).hexdigest()[8 * (j % 4) :][:8], 16) % n for j in range(n)]


@pytest.mark.parametrize("group", [None, "uid"])
def test_all_replicates(spark, group):
    """So few rows are all drawn one by one; groups of one row are the same as rows."""
    assert SAMPLES == 10_000
    rows = [(0, 0), (0, 1), (1, 1), (2, 0), (2, 1)]
    df = spark.createDataFrame([(k, t, p) for k, (t, p) in enumerate(rows)], "uid long, label int, prediction int")
    scores = [macro([rows[i] for i in drawn(r, 5)]) for r in range(SAMPLES)]
    got = S.bootstrap_ci(df, 3, SAMPLES, group=group).first()
    low, high = np.quantile(scores, [0.025, 0.975])
    assert (got.replicates, got.units) == (SAMPLES, 5)
    assert np.allclose([got.low, got.high, got.se, got["mean"]], [low, high, np.std(scores, ddof=1), np.mean(scores)], atol=2e-6)


def test_pooled_draws_are_multinomial(spark):
    """Of many rows most are drawn at once: every replicate has n draws, and cells' means, variances and covariances are those of n single draws."""
    sizes = {(0, 0): 900, (0, 1): 300, (1, 1): 500, (2, 0): 200, (2, 2): 80, (1, 7): 20}
    df = spark.createDataFrame([(t, p) for (t, p), n in sizes.items() for _ in range(n)], "label int, prediction int")
    w = np.array([r.w for r in S.row_replicates(df, 3, 4000).collect()], float)
    n = sum(sizes.values())
    assert (w.sum(1) == n).all()
    place = {k: k[0] * 4 + min(k[1], 3) for k in sizes}
    share = np.zeros(12)
    for k, c in sizes.items():
        share[place[k]] = c / n
    assert np.allclose(w.mean(0), n * share, atol=4 * np.sqrt(n * share / 4000) + 1e-9)
    want = n * (np.diag(share) - np.outer(share, share))
    assert np.abs(np.cov(w.T) - want).max() < 0.1 * n * share.max()


def test_exact_means(spark):
    df = spark.createDataFrame([(0.0000005,), (0.0000025,), (None,)], "x double")
    from pyspark.sql import functions as F

    row = df.agg(S.exact_mean(F.col("x")).alias("a"), S.exact_mean(-F.col("x")).alias("b"), S.exact_mean(F.lit(None).cast("double")).alias("c")).first()
    assert (row.a, row.b, row.c) == (0.000002, -0.000002, None)


def test_words_are_mixed_alike_in_numbers_and_columns(spark):
    from pyspark.sql import functions as F

    r = np.arange(1000)
    got = [x[0] for x in spark.range(1000).select(S.mix32(F.col("id"), 123456789, 4294967295)).collect()]
    assert got == S.mix32(r, 123456789, 4294967295).tolist()
    assert abs(np.mean(got) / 2**32 - 0.5) < 0.05 and len(set(got)) == 1000


def test_poisson_steps():
    for rate in (0.0, 0.3, 2.0, 400.0):
        steps = S.poisson_steps(rate)
        u = (np.arange(200_000) + 0.5) / 200_000
        k = np.searchsorted(steps, u, side="right")
        assert abs(k.mean() - rate) < 1e-3 * (1 + rate) and abs(k.var() - rate) < 2e-3 * (1 + rate)


def test_grouped_draws_are_multinomial(spark):
    """Of many groups most are drawn at once: sums over a replicate's groups have the mean and variance of n single draws, and scores their distribution."""
    rng = np.random.default_rng(5)
    kinds = [[(0, 0), (0, 1)], [(1, 1)], [(2, 0), (2, 2), (2, 2)], [(1, 2), (1, 1)], [(0, 0)], [(2, 1)]]
    groups = [kinds[k] for k in rng.integers(0, len(kinds), 400)] + [[(0, int(p)) for p in rng.integers(0, 3, 9)] for _ in range(20)]
    df = spark.createDataFrame([(g, t, p) for g, rows in enumerate(groups) for t, p in rows], "uid long, label int, prediction int")
    units = S.resampling_units(df, 3, "uid")
    got = np.sort([r.macro_f1 for r in S.group_replicates(units, 3, 4000).collect()])
    one = np.array([[*(sum(t == c == p for t, p in g) for c in range(3)), *(sum((t == c) + (p == c) for t, p in g) for c in range(3))] for g in groups], float)
    sums = np.array([one[rng.integers(0, len(groups), len(groups))].sum(0) for _ in range(4000)])
    want = np.sort((2 * sums[:, :3] / sums[:, 3:]).mean(1))
    assert len(got) == 4000
    assert abs(got.mean() - want.mean()) < 4 * want.std() / np.sqrt(2000) and abs(got.std() / want.std() - 1) < 0.06
    both = np.concatenate([got, want])
    gap = np.abs(np.searchsorted(got, both, side="right") - np.searchsorted(want, both, side="right")).max() / 4000
    assert gap < 1.63 * np.sqrt(2 / 4000)  # Kolmogorov-Smirnov at 1 %
