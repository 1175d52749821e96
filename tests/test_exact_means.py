"""Means that fall halfway between two results are rounded by their exact value: neither the order of a sum nor its binary noise decides."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from vocalith.operators import intervals as I
from vocalith.operators import vectors as V

DIM = 64


def rounded(x):
    return float(x.quantize(Decimal("0.000001"), ROUND_HALF_UP))


def halfway(n, digits=6, seed=3):
    """n vectors of decimals for which each mean has a 5 behind its last digit, and these means."""
    draw = random.Random(seed)
    columns = []
    for _ in range(DIM):
        x = [draw.randrange(1, 900_000) for _ in range(n)]
        x[-1] += (n // 2 - sum(x)) % n
        columns.append([Decimal(k).scaleb(-digits) for k in x])
    return [[float(c[k]) for c in columns] for k in range(n)], [rounded(sum(c) / n) for c in columns]


def vectors(spark, rows):
    return spark.createDataFrame([(1, k, v, True, k % 2) for k, v in enumerate(rows)], "uid long, pos long, vec array<double>, valid boolean, layer long").withColumns({"word_id": F.lit(0), "unknown": F.lit(False)})


POOLS = {
    "masked": lambda df: V.masked_mean_pool(df, DIM),
    "subword": lambda df: V.subword_mean_pool(df, DIM),
    "summary": lambda df: V.recording_summary_vector(df, DIM),
    "attention": lambda df: V.attention_pool(df, [0.0] * DIM),
}


@pytest.mark.parametrize("name", POOLS)
def test_pools(spark, name):
    rows, means = halfway(4)
    for order in (rows, rows[::-1]):
        assert POOLS[name](vectors(spark, order)).first().vec == means


def test_layers(spark):
    rows, means = halfway(2)
    assert V.layer_mix(vectors(spark, rows).withColumn("pos", F.lit(0)), [0.0, 0.0], DIM).first().vec == means


@pytest.mark.parametrize("tile", [1, 3, 512])
def test_self_attention(spark, tile):
    """The first row is zero, so it weighs all rows alike."""
    rows, _ = halfway(3)
    rows = [[0.0] * DIM, *rows]
    for i in range(DIM):
        rows[3][i] = round(rows[3][i] + (2 - sum(round(r[i] * 1e6) for r in rows)) % 4 / 1e6, 6)
    means = [rounded(sum(Decimal(repr(r[i])) for r in rows) / 4) for i in range(DIM)]
    out = {r.pos: r.vec for r in V.self_attention(vectors(spark, rows), DIM, tile).collect()}
    assert len(out) == 4 and out[0] == means


def test_wild_values(spark):
    """What has no exact sum still has a mean."""
    rows = [[1e12] * DIM, [3e12] * (DIM - 1) + [float("nan")]]
    pooled = V.masked_mean_pool(vectors(spark, rows), DIM).first().vec
    assert pooled[:-1] == [2e12] * (DIM - 1) and pooled[-1] != pooled[-1]
    attended = V.self_attention(vectors(spark, [[1e4] * DIM, [0.0] * DIM]), DIM).orderBy("pos").collect()
    assert attended[0].vec == [1e4] * DIM and attended[1].vec == [5e3] * DIM


def test_disagreement(spark):
    """Deltas in ms, 16 of them, the sum of which ends in 1."""
    draw = random.Random(5)
    rows, want = [], {}
    for uid in range(200):
        ms = [draw.randrange(1, 400) for _ in range(16)]
        ms[-1] += (1 - sum(ms)) % 16
        rows += [(uid, k, m / 1000.0, m / 1000.0, False) for k, m in enumerate(ms)]
        want[uid] = rounded(Decimal(sum(ms)) / 16000)
    got = I.disagreement_summary(spark.createDataFrame(rows, "uid long, word_id int, start_delta double, end_delta double, flagged boolean")).collect()
    assert {r.uid: r.mean_start for r in got} == {r.uid: r.mean_end for r in got} == want
