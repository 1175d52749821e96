"""The trie of rebuilt conversations against a plain walk, with ties, nulls, hot prefixes and a full sketch."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from vocalith.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth int, a string"


def walk(rows):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        by[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    by = {c: [(role, text) for *_, role, text in sorted(v)] for c, v in by.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in by.items():
        if c is None:
            seq = turns
        else:
            h = zlib.crc32(str(c).encode()) % 6
            seq = by.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    low = {k: min((c for c in v if c is not None), default=None) for k, v in members.items()}
    n_children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, v in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += n_children[k] == 0
            saved[k[:d]] += (len(v) - 1) * (len(k[-1][1]) if k else 0)
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(c for c in ends[k] if c is not None)).encode()).hexdigest()
    return Counter((low[k], len(k), low[k[:-1]] if k else None, len(v), n_children[k], leaves[k], saved[k], sha(k)) for k, v in members.items())


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(parts)


def got(df):
    return Counter(tuple(r) for r in df.collect())


def many(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 9])):
            rows.append((c, t, rng.choice(["user", "user", "system", None]), rng.choice(["hi", "hi", "ö" * 3, "", None, f"own {c}"])))
    return rows


ODD = [
    (None, 0, "user", "hi"), (None, None, "user", "hi"), (5, None, None, None), (5, None, "", ""), (5, 1, "b", "same turn"), (5, 1, "a", "same turn"), (5, 1, "a", "same turn"),
    (-7, 0, "user", "negative"), (100, 0, "u", "base"), (100, 1, "u", "b2"), (100, 2, "u", "b3"), (100, 3, "u", "b4"), (100, 4, "u", "b5"), (100, 5, "u", "b6"), (101, 0, "u", "x"), (103, 9, "u", "y" * 100_000), (104, 0, "a,b", "1:x"), (104, 1, "", "a,b1:x"),
]


@pytest.mark.parametrize("rows", [many(1), many(2), ODD, many(3) + ODD], ids=["one", "two", "odd", "mixed"])
def test_trie(spark, rows):
    assert got(pt.prefix_trie(frame(spark, rows))) == walk(rows)


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(pt, "LEAST_CELLS", 16)
    monkeypatch.setattr(pt, "MOST_CELLS", 16)
    monkeypatch.setattr(pt, "BLOCK_CELLS", 8)
    assert got(pt.prefix_trie(frame(spark, many(4)))) == walk(many(4))


def test_hot_conversation_hot_node_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(pt, "LIST_BYTES", 30)
    rows = [(17, t, "user", f"t{t % 5}") for t in range(400)] + [(c, t, "system", "the same") for c in range(1000, 1300) for t in range(7)]
    assert got(pt.prefix_trie(frame(spark, rows, 5))) == walk(rows)


def test_given_and_empty_conversations(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert got(pt.op12_prefix_trie(spark, sf_dir)) == walk(rows)
    assert got(pt.prefix_trie(frame(spark, many(1)).where("1 = 0"))) == Counter()


def test_the_sketch_never_calls_a_shared_prefix_single(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 3000))
    twice = rng.integers(0, 3000, 500)
    rows = [(int(a[k]), int(b[k])) for k in [*range(3000), *twice]]
    df = spark.createDataFrame(rows, "a long, b long").repartition(4)
    sketch = pt.shared_cells(df, pt.LEAST_CELLS)
    flagged = df.select("a", "b", pt.possibly_shared(F.lit(1).cast("long"), F.col("a"), F.col("b"), sketch, pt.LEAST_CELLS).alias("shared")).distinct().collect()
    counts = Counter(rows)
    assert all(r.shared for r in flagged if counts[(r.a, r.b)] > 1)
    assert sum(r.shared for r in flagged if counts[(r.a, r.b)] == 1) < 60
