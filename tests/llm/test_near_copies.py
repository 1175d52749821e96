"""Near copies by the Jaccard similarity of five-word shingles, against all pairs compared the plain way."""

import random

import numpy as np
import pyarrow as pa
import pytest

from vocalith.llm import simhash
from vocalith.llm.components import connected_components


def shingles(text):
    w = (text or "").lower().encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups_of(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]


def near_texts():
    """Copies with a few words changed, at similarities on both sides of 0.8, and one large group."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for k in range(40):
        base = [word() for _ in range(rng.randrange(30, 400))]
        texts.append(" ".join(base))
        for _ in range(60 if k == 0 else 4):
            copy = list(base)
            for _ in range(rng.randrange(1, 2 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if k % 2 else "  ".join(copy))
    rng.shuffle(texts)
    return [*texts, None, "", " \n", "a b c", "A  b c", "a b d"]


@pytest.mark.parametrize("weight", [1 << 18, 3000])
def test_near_copies_by_jaccard(spark, monkeypatch, weight):
    """Also with groups cut into parts."""
    monkeypatch.setattr(simhash, "PART_WEIGHT", weight)
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_copies(df).collect()} == set(groups_of(texts))


def test_near_copies_of_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(400)
    rows = [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]
    want = {rows[k][0] for k in groups_of([t for _, t in rows])}
    assert {r.doc_id for r in simhash.drop_near_copies(df).collect()} == want


def test_rows_that_share_an_id_keep_their_groups(spark):
    rows = [(8, "one text", 1), (8, "quite another text", 2), (None, "a third", 3), (None, "the fourth of them", 4), (9, "A third", 5), (7, "z", 6), (7, "z", 7), (7, "z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(4)
    got = [(r.doc_id, r.text) for r in simhash.drop_near_copies(df).collect()]
    assert sorted(got, key=str) == sorted([(8, "one text"), (8, "quite another text"), (None, "the fourth of them"), (9, "A third"), (7, "z")], key=str)


def prints_and_sizes(n=900):
    """Random 256-bit fingerprints and copies of them with some bits turned, on both sides of each limit."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(n // 6):
        base = rng.integers(0, 2, 256, np.uint8)
        size = int(rng.integers(20, 400))
        rows.append((size, base))
        for _ in range(5):
            copy = base.copy()
            copy[rng.choice(256, int(rng.integers(0, 100)), replace=False)] ^= 1
            rows.append((max(1, int(size * rng.uniform(0.7, 1.3))), copy))
    return rows


def near(a, b):
    differ = np.cumsum(a[1] ^ b[1])
    return 5 * min(a[0], b[0]) >= 4 * max(a[0], b[0]) and all(differ[64 * k + 63] <= m for k, m in enumerate((22, 38, 53, 66)))


def partition_of(n, links):
    root = list(range(n))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_bit_sliced_links_of_simhashes():
    """The links of `link_near` span what a plain comparison of all pairs links."""
    rows = prints_and_sizes()
    rows = sorted(((k % 3, *r) for k, r in enumerate(rows)), key=lambda r: r[:2])
    words = np.stack([np.packbits(r[2], bitorder="little").view(np.uint64) for r in rows], axis=1)
    i, j = simhash.link_near(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), list(words))
    want = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][0] == rows[b][0] and near(rows[a][1:], rows[b][1:])]
    assert len(want) > 100
    assert partition_of(len(rows), zip(i.tolist(), j.tolist())) == partition_of(len(rows), want)


@pytest.mark.parametrize("limit, block", [(1 << 16, 1 << 18), (100, 150), (100, 5000)])
def test_links_of_long_files(spark, limit, block):
    """Also with the one file of so few rows cut into parts: every near pair is linked."""
    rows = prints_and_sizes()
    made = [(k, s, *np.packbits(b, bitorder="little").view(np.int64).tolist()) for k, (s, b) in enumerate(rows)]
    sets = spark.createDataFrame(made, "same long, size long, f0 long, f1 long, f2 long, f3 long").repartition(4)
    found = {r.node: r.root for r in connected_components(simhash.near_links(sets, len(rows), limit, block)).collect()}
    want = partition_of(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if near(rows[a], rows[b])])
    assert [found.get(k, k) for k in range(len(rows))] == want


def test_simhashes_of_near_copies_meet():
    """At a similarity of 0.8, by the filing of a million rows: nearly all pairs share a file and stay within the limits."""
    rng = np.random.default_rng(4)
    bits, files = simhash.near_filing(1_000_000)
    pairs, sets = 2000, []
    for _ in range(pairs):
        a = rng.integers(0, 1 << 64, 90, np.uint64)
        sets += [a, np.r_[a[:80], rng.integers(0, 1 << 64, 10, np.uint64)]]
    prints = np.array([simhash.near_fingerprint(s) for s in sets]).view(np.int64)
    n = len(sets)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([90] * n, pa.int64()), *[pa.array(np.ascontiguousarray(c)) for c in prints.T]], names=["same", "size", *simhash.PRINT])
    keys = np.array([b.column("key").to_numpy() for b in simhash._file_near(bits, files)([batch])])
    filed = (keys[:, ::2] == keys[:, 1::2]).any(axis=0)
    ones = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    met = sum(filed[k] and near((90, ones[2 * k]), (90, ones[2 * k + 1])) for k in range(pairs))
    assert bits == 8 and met >= 0.998 * pairs
