"""Selection, sweep and tiles against the plain ways they take the place of."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.operators import intervals as I
from vocalith.operators import metrics as S
from vocalith.operators import vectors as V


def column(spark, values):
    return spark.createDataFrame([(float(x),) for x in values], "v double").repartition(5)


CASES = {
    "spread": lambda rng: [rng.gauss(0, 1) for _ in range(999)],
    "ties": lambda rng: [rng.choice([0.5, 0.5, 0.5, 2.0, -3.0]) for _ in range(500)],
    "one": lambda rng: [7.25] * 100,
    "single": lambda rng: [3.0],
    "scales": lambda rng: [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 308) for _ in range(300)],
    "near": lambda rng: [1.0 + k * 2**-52 for k in range(200)],
}


@pytest.mark.parametrize("case", CASES)
def test_selected_ranks(spark, monkeypatch, case):
    """Every refinement is used: parts are few, and only single values are sorted."""
    monkeypatch.setattr(S, "PARTS", 64)
    monkeypatch.setattr(S, "SORTED_AT_ONCE", 3)
    values = CASES[case](random.Random(5))
    n = len(values)
    ranks = sorted({0, n // 4, n // 2, n - 1})
    assert S.select_ranks(column(spark, values), ranks) == {r: sorted(values)[r] for r in ranks}


def test_quartiles(spark):
    rng = random.Random(6)
    values = [round(rng.expovariate(0.1), 3) for _ in range(1001)]
    df = spark.createDataFrame([(x,) for x in [*values, None, -1.0, float("nan"), float("inf")]], "x double")
    row = S.describe_durations(df, "x").first()
    q = np.quantile(values, [0.25, 0.5, 0.75])
    assert (row.rows, row.missing, row.unreadable) == (1005, 1, 3)
    assert np.allclose([row.q25, row.median, row.q75], q, atol=1e-6) and row["mean"] == pytest.approx(statistics.mean(values), abs=1e-6) and row.std == pytest.approx(statistics.stdev(values), abs=1e-6)
    empty = S.describe_durations(df.where("1 = 0"), "x").first()
    assert (empty.rows, empty.median, empty.q25) == (0, None, None)


def test_swept_words(spark):
    rng = random.Random(7)
    words = [(u, i, s, None if i == 5 else s + rng.choice([0, 1, 3, 20])) for u in (1, 2, None) for i, s in enumerate(rng.sample(range(200), 40))]
    spans = [(u, b, b + rng.choice([0, 1, 5, 40])) for u in (1, 1, 1, 3, None) for b in rng.sample(range(200), 3)] + [(2, 10, 300), (2, 20, 30), (2, None, 40), (2, 400, 500)]
    w = spark.createDataFrame([(*x, 1.5) for x in words], "uid long, word_id int, start_ms long, end_ms long, begin_ms double")
    s = spark.createDataFrame(spans, "uid long, begin_ms long, stop_ms long")
    touches = lambda x: x[0] is not None and x[3] is not None and any(u == x[0] and b is not None and x[3] >= b and x[2] < e for u, b, e in spans)
    out = I.exclude_overlaps(w, s)
    assert out.columns == w.columns
    assert sorted(map(str, (tuple(r)[:4] for r in out.collect()))) == sorted(str(x) for x in words if not touches(x))
    assert I.exclude_overlaps(w, s.where("1 = 0")).count() == len(words) and I.exclude_overlaps(w.where("1 = 0"), s).count() == 0


@pytest.mark.parametrize("tile", [1, 3, 512])
def test_attention_by_tiles(spark, tile):
    rng = np.random.default_rng(8)
    vecs = {u: rng.normal(size=(n, 4)).astype(np.float32) * 3 for u, n in ((1, 1), (2, 7), (3, 11))}
    df = spark.createDataFrame([(u, p, v.tolist()) for u, x in vecs.items() for p, v in enumerate(x)], "uid long, pos int, vec array<float>").repartition(3)
    got = {(r.uid, r.pos): r.vec for r in V.self_attention(df, 4, tile).collect()}
    assert len(got) == 19
    for u, x in vecs.items():
        x = x.astype(float)
        s = x @ x.T
        w = np.exp(s - s.max(1, keepdims=True))
        want = (w / w.sum(1, keepdims=True)) @ x
        assert np.allclose([got[u, p] for p in range(len(x))], want, atol=2e-6)


def test_a_long_recording(spark):
    """8,000 positions: 64 million pairs, none of which is a row."""
    df = spark.range(8000).select(F.lit(1).alias("uid"), F.col("id").alias("pos"), F.array((F.col("id") % 7).cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    out = V.self_attention(df, 2).where("pos IN (0, 6)").orderBy("pos").collect()
    w = np.exp(6.0 * np.arange(7) - 36)
    n = np.array([len(range(k, 8000, 7)) for k in range(7)])
    assert out[1].vec[0] == pytest.approx((n * w * np.arange(7)).sum() / (n * w).sum(), abs=2e-6) and out[0].vec[0] == pytest.approx((n * np.arange(7)).sum() / 8000, abs=2e-6)


def test_unions_are_shuffled(spark):
    """Sums over a union of two inputs that are both partitioned by the key, and derived in several branches, come out alike every time."""
    spark.conf.unset("spark.sql.unionOutputPartitioning")
    words = spark.range(3000).select((F.col("id") % 60).alias("uid"), F.col("id").alias("start_ms"), (F.col("id") + 40).alias("end_ms"))
    spans = words.groupBy("uid").agg(F.min("start_ms").alias("begin_ms"), (F.min("start_ms") + 1).alias("stop_ms"))
    out = I.exclude_overlaps(words.join(spans.select("uid"), "uid", "left_semi"), spans)
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
    assert {out.count() for _ in range(4)} == {3000 - 60}
