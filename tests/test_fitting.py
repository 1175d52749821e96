"""Fold models against a plain fit of each fold's rows."""

import numpy as np
import pytest

from vocalith.operators import fitting


def plain_fit(x, y, classes, penalty=0.01):
    """Weights of the same loss by damped Newton steps with numerical care only for the flat direction (all intercepts together)."""
    n = np.array([(y == c).sum() for c in range(classes)], float)
    w = (n.sum() / n)[y]
    x = np.column_stack([np.ones(len(x)), x])
    held = np.r_[0, np.full(x.shape[1] - 1, penalty)]
    theta = np.zeros((classes, x.shape[1]))
    hot = np.eye(classes)[y]
    for _ in range(60):
        p = np.exp(x @ theta.T)
        p /= p.sum(1, keepdims=True)
        g = ((p - hot) * w[:, None]).T @ x / w.sum() + held * theta
        h = np.einsum("i,ia,iab,ij,ik->ajbk", w, p, np.eye(classes)[None] - p[:, None, :], x, x, optimize=True) / w.sum()
        h = h.reshape(theta.size, theta.size) + np.diag(np.tile(held, classes))
        theta = theta - (np.linalg.pinv(h, rcond=1e-12) @ g.reshape(-1)).reshape(theta.shape)
    return theta


@pytest.fixture
def rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = np.argmax(x[:, :3] + 0.8 * rng.normal(size=(400, 3)) + [0.0, 0.5, -0.6], axis=1)
    return x, y, rng.integers(0, 4, 400)


def test_weights_and_probabilities(spark, rows):
    x, y, fold = rows
    data = [(i, x[i].tolist(), int(y[i]), int(fold[i])) for i in range(400)]
    odd = [(1000, None, 1, 0), (1001, x[0].tolist(), None, 1), (1002, x[1].tolist(), -1, 2), (1003, [float("nan")] * 5, 0, 0), (1004, [1.0, 2.0], 0, 3), (1005, x[2].tolist(), 0, None)]
    df = spark.createDataFrame(data + odd, "uid long, v array<float>, label int, fold int").repartition(7)
    labels, weights = fitting.fit_folds(df, "v")
    assert labels == [0, 1, 2] and sorted(weights) == [0, 1, 2, 3]
    got = {r.uid: r for r in fitting.fit_score_cv(df, "v").collect()}
    assert len(got) == 406
    for k in range(4):
        theta = plain_fit(x[fold != k].astype(float), y[fold != k], 3)
        centred = lambda t: t - np.r_[1, np.zeros(5)] * t[:, :1].mean()
        assert np.abs(centred(weights[k]) - centred(theta)).max() < 1e-6
        for i in np.flatnonzero(fold == k):
            p = np.exp(theta @ np.r_[1, x[i]].astype(float))
            p /= p.sum()
            assert np.abs(np.array(got[int(i)].proba) - p).max() < 2e-6
            assert got[int(i)].prediction == int(np.argmax(got[int(i)].proba))
    assert [got[i].proba is None for i in range(1000, 1006)] == [True, False, False, True, True, True]


def test_binary_separable_and_empty(spark):
    data = [(i, [float(i % 2) * 2 - 1, 0.5], i % 2, i % 3) for i in range(60)]
    df = spark.createDataFrame(data, "uid long, v array<double>, label int, fold int")
    out = fitting.fit_score_cv(df, "v").collect()
    assert all(r.prediction == r.label for r in out) and out[0].asDict().keys() == {"uid", "label", "fold", "proba", "prediction"}
    assert fitting.fit_score_cv(df.where("1 = 0"), "v").count() == 0


def test_partial_sums_as_a_tree(spark, rows, monkeypatch):
    monkeypatch.setattr(fitting, "FAN_IN", 2)
    x, y, fold = rows
    df = spark.createDataFrame([(x[i].tolist(), int(y[i]), int(fold[i])) for i in range(400)], "v array<float>, label int, fold int")
    a, b = (fitting.fit_folds(df.repartition(n), "v")[1] for n in (1, 9))
    assert all(np.abs(a[k] - b[k]).max() < 1e-9 for k in range(4))
