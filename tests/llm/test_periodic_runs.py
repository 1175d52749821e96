"""Runs of words against every period tried at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from brute import split
from test_operators import alike, by_text, docs_of, pairs, table_of

from vocalith.llm import periodic_runs as pr


def plain_runs(c, least=12):
    out = {}
    for q in range(1, len(c) // 2 + 1):
        i = 0
        while i < len(c) - q:
            j = i
            while j < len(c) - q and c[j] == c[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_report(doc_id, text, change=True):
    words = split(text)
    n = len(words)
    h = None if doc_id is None or not change else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha(listed), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_runs_of_short_sequences():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randrange(90), rng.choice([1, 2, 2, 3, 5])
        c = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.6 and n:
            a, p = rng.randrange(n), rng.randrange(1, 12)
            c = c[:a] + [c[min(a + (i - a) % p, n - 1)] for i in range(a, n)]
        assert pr.find_runs(np.array(c, np.int64)) == plain_runs(c), c


@pytest.mark.parametrize("unit,times", [([0], 5000), ([0, 1], 3000), ([0, 1, 0, 0], 2000), (list(range(19)), 900)])
def test_long_runs(unit, times):
    c = unit * times
    assert pr.find_runs(np.array(c, np.int64)) == [(0, len(c), len(unit))]


def test_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    assert pr.find_runs(np.array(b, np.int64)) == plain_runs(b)


def test_lists_joined_in_the_middle():
    """Places of one node that come from lists in turn."""
    rng = random.Random(2)
    phrase = list(range(8))
    c = [x for k in range(400) for x in [*phrase, 100 + rng.randrange(3), 100 + rng.randrange(3)]]
    assert pr.find_runs(np.array(c, np.int64)) == plain_runs(c)


@pytest.mark.parametrize("which", ["given", "tricky", "nothing"])
def test_documents(spark, sf_dir, tricky, nothing, which):
    df = {"given": docs_of(spark, sf_dir), "tricky": tricky.where("doc_id IS NULL OR doc_id <> 6"), "nothing": nothing}[which]
    docs = [(i, t) for i, t in pairs(df) if len(t or "") < 20_000]
    got = table_of(pr.collapse_runs(df.where("text IS NULL OR length(text) < 20000"), tail_hash=pr.decimal_crc32))
    alike(got, by_text(docs, [plain_report(i, t) for i, t in docs]))


def test_very_long_text_and_no_tail(spark, tricky):
    row = pr.collapse_runs(tricky.where("doc_id = 6")).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 0, 57_000, 19, 3_000_000)
    from conftest import LONG

    assert row.collapsed_sha256 == hashlib.sha256(LONG.strip().encode()).hexdigest()
    df = tricky.where("doc_id = 7")
    alike(table_of(pr.collapse_runs(df)), by_text(pairs(df), [plain_report(i, t, False) for i, t in pairs(df)]))
