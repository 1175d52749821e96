"""Frames are pooled by stretches between the ends of words: they are made by block where they are summed, not shuffled or sorted."""

import random
import re

import pytest
from test_joins import plan

from vocalith.functions.timing import Grid
from vocalith.operators import intervals as I
from vocalith.plans.registry import all_queries

#: The queries that join or pool the frames of the word intervals.
POOLED = ["frames_in_interval", "interval_mean_pool", "interval_mean_pool_context", "interval_mean_pool_inclusive", "interval_mean_pool_short"]


@pytest.mark.parametrize("name", POOLED)
def test_frames_are_not_moved(spark, sf_dir, name):
    """Below the join frames are dealt out as blocks, before they are made; the other exchange by block is of words or their ends."""
    text = plan(all_queries()[name](spark, sf_dir))
    dealt = re.findall(r"Exchange hashpartitioning\(uid#\d+L?, block#\d+L?, \d+\), (\w+)", text)
    assert sorted(dealt) == ["ENSURE_REQUIREMENTS", "REPARTITION_BY_NUM"] and "ShuffledHashJoin" in text


def test_frames_of_overlapping_words(spark):
    """Words over several blocks, that share frames, with frames missing and twice; columns and their order."""
    frames = [("a", f, f % 7) for f in range(300) if f % 11] + [("a", 65, 9), ("b", 3, 1)]
    words = [("a", 0, 0, 6000), ("a", 1, 1200, 1300), ("a", 2, 1270, 2600), ("a", 3, 1303, 1304), ("b", 0, 0, 90), ("a", 4, None, None), (None, 0, 0, 90)]
    fr = spark.createDataFrame(frames, "uid string, frame long, x int")
    w = spark.createDataFrame(words, "uid string, word_id int, start_ms int, end_ms int")
    out = I.frames_in_interval(w, fr, Grid(20.0, 25.0, 12.5, 300))
    assert out.columns == ["uid", "frame", "word_id", "start_ms", "end_ms", "method", "x"]
    want = []
    for u, k, s, e in words:
        inside = [f for f in range(300) if s is not None and s <= 20 * f + 12.5 < e]
        span = inside or ([] if s is None else [int(((s + e) / 2 - 12.5) / 20 + 0.5)])
        want += [(u, k, f, "frame_centers_in_interval" if inside else "nearest_center_fallback", x) for uid, f, x in frames if u == uid and f in span]
    assert sorted((r.uid, r.word_id, r.frame, r.method, r.x) for r in out.collect()) == sorted(want) and want


@pytest.fixture(scope="module")
def odd():
    """Recordings of many blocks with frames missing, twice and without values; words that overlap, that lie beyond the frames, that are one frame or whole recordings, and one without a recording."""
    rng = random.Random(5)
    frames = [(u, f, [rng.randrange(50) / 4.0, rng.choice([None, 1.5, -2000.0, 3.0])]) for u in ("a", "b") for f in range(400) if rng.random() > 0.1 for _ in range(1 + (f % 97 == 0))]
    words = [("a", 0, 0, 8000), ("a", 1, 1270, 1290), ("b", 0, 1280, 2560), ("b", 1, 7990, 9999), ("b", 2, None, None), ("c", 0, 0, 100), (None, 0, 0, 500)]
    words += [(u, k, s, s + rng.randrange(0, 3000)) for u in ("a", "b") for k, s in enumerate((rng.randrange(0, 8000) for _ in range(60)), 10)]
    return frames, words


@pytest.mark.parametrize("dealt", [True, False])
@pytest.mark.parametrize("policy", ["inclusive", "short_expand"])
def test_pooling_of_odd_tables(spark, odd, policy, dealt):
    frames, words = odd
    fr = spark.createDataFrame(frames, "uid string, frame int, vec array<double>").repartition(3)
    fr = I.with_blocks(fr).repartition(5, "uid", "block") if dealt else fr
    w = spark.createDataFrame(words, "uid string, word_id int, start_ms int, end_ms int")
    got = {(r.uid, r.word_id): (r.vec, r.n_frames, r.valid) for r in I.interval_mean_pool(w, fr, Grid(20.0, 25.0, 12.5, 400), 2, policy).collect()}
    assert len(got) == len(words)
    for u, k, s, e in words:
        span = None if s is None or s >= e or u is None else (s // 20, min(400, e // 20 + 1))
        if span and policy == "short_expand" and span[1] - span[0] < 3:
            span = max(0, span[0] - 2), min(400, span[1] + 2)
        mine = [v for uid, f, v in frames if span and uid == u and span[0] <= f < span[1]]
        clip = (lambda x: min(1000.0, max(-1000.0, x))) if policy == "short_expand" else (lambda x: x)
        # a missing value comes to the least one where values are clipped: Spark's greatest and least pass over nulls
        value = lambda x: clip(x) if x is not None else -1000.0 if policy == "short_expand" else 0.0
        vec, n, valid = got[(u, k)]
        assert n == len(mine) and valid == bool(mine)
        assert vec == pytest.approx([sum(value(v[i]) for v in mine) / len(mine) for i in (0, 1)] if mine else [0.0, 0.0], abs=1e-6)
