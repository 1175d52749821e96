"""The automaton's traversal: pieces side by side, blocks of any size, states and failure arcs."""

import math
import random

import pytest
from brute import language_model

from vocalith.llm import lm_scores as L


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    word = lambda: f"w{int(rng.paretovariate(0.8)) % 60}"
    return [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 30, 400])))) for i in range(80)] + [(80, None), (None, "w1 w2 w3")]


@pytest.mark.parametrize("lane,block", [(1024, 4 << 20), (2, 300), (3, 1500), (50, 4 << 20)])
def test_scores(spark, docs, lane, block):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {str(r.doc_id): (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in L.score_texts(df, block_bytes=block, lane=lane).collect()}
    want = {str(i): (*x[:4], round(x[4], 6), round(x[5], 6)) for (i, _), x in zip(docs, language_model(docs))}
    assert got == want


def test_longer_histories_fit_better(spark, sf_dir):
    """Held-out texts are likelier under the trigram model than under the base."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r for r in L.score_texts(df).collect() if r.held_out and r.n_tokens > 50]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(math.isfinite(r.score) for r in rows)
