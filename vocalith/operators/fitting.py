"""Fitting a linear classifier by folds, and scoring partitions with a user's model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Partial sums of so many tasks are added up at a time.
FAN_IN = 64


def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a finite vector of `dim` numbers, those vectors with a 1 in front)."""
    plain = [v is not None and len(v) == dim and None not in v for v in vectors.to_pylist()]
    good = np.flatnonzero(plain)
    x = vectors.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(good), dim)
    finite = np.isfinite(x).all(axis=1)
    return good[finite], np.column_stack([np.ones(finite.sum()), x[finite]])


def probabilities(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Softmax of x (rows with a 1 in front) under weights [class, 1 + dim]."""
    z = x @ weights.T
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _derivatives(models: dict[int, np.ndarray], class_weights: dict[int, np.ndarray], labels: list[int], dim: int):
    """(vector, label, fold) -> for each fold's model this task's part of (loss, gradient, curvature), over the rows of the other folds."""
    c, width = len(labels), 1 + dim
    place = {k: i for i, k in enumerate(labels)}

    def over(batches):
        parts = {k: np.zeros(1 + c * width + (c * width) ** 2) for k in models}
        for batch in batches:
            good, x = _matrix(batch.column(0), dim)
            label, fold = (batch.column(j).take(pa.array(good)).to_pylist() for j in (1, 2))
            y = np.array([place.get(k, -1) for k in label], np.int64)
            fold = np.array([np.nan if k is None else k for k in fold], float)
            for k, weights in models.items():
                some = (fold != k) & ~np.isnan(fold) & (y >= 0)
                if not some.any():
                    continue
                xs, ys = x[some], y[some]
                p, w = probabilities(xs, weights), class_weights[k][ys]
                error = p.copy()
                error[np.arange(len(ys)), ys] -= 1
                part = parts[k]
                part[0] -= (w * np.log(np.maximum(p[np.arange(len(ys)), ys], 1e-300))).sum()
                part[1 : 1 + c * width] += ((error * w[:, None]).T @ xs).reshape(-1)
                curve = part[1 + c * width :].reshape(c, width, c, width)
                for a in range(c):
                    for b in range(a, c):
                        block = (xs * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ xs
                        curve[a, :, b, :] += block
                        if a != b:
                            curve[b, :, a, :] += block.T
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([v.tobytes() for v in parts.values()], pa.binary())], names=["fold", "part"])

    return over


def _added(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, float) for x in group.column("part").to_pylist())
    return pa.table({"fold": group.column("fold").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})


def _sums(parts: DataFrame) -> dict[int, np.ndarray]:
    """Parts added up as a tree: first those of FAN_IN tasks each, then by fold."""
    some = parts.withColumn("__at", F.floor(F.spark_partition_id() / FAN_IN)).groupBy("fold", "__at").applyInArrow(lambda key, t: _added(t), "fold int, part binary")
    return {r["fold"]: np.frombuffer(r["part"], float) for r in some.groupBy("fold").applyInArrow(_added, "fold int, part binary").collect()}


def fit_folds(features: DataFrame, vec: str, label: str = "label", fold: str = "fold", penalty: float = 0.01, max_iter: int = 30, tolerance: float = 1e-9) -> tuple[list[int], dict[int, np.ndarray]]:
    """(labels, {fold: weights [label, 1 + dim]}): for each fold a multinomial logistic regression fitted on the others by Newton's method.

    Classes weigh alike (all rows / rows of the class); the loss is the weighted mean plus penalty / 2 times the squared weights, intercepts left out. All folds
    are fitted at once: each iteration is one pass over the rows, from which a task sends one gradient and one matrix of second derivatives for each fold. The driver
    holds one such matrix, (labels x (1 + dim)) squared, for each fold. Rows without label, fold or a finite vector of the usual length are not fitted; label -1 stands for none.
    """
    rows = features.select(F.col(vec).cast("array<double>").alias("v"), F.col(label).cast("int").alias("y"), F.col(fold).cast("int").alias("k"))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    usable = (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    counted = {(r.y, r.k): r.n for r in rows.where("y >= 0 AND k IS NOT NULL").where(usable).groupBy("y", "k").agg(F.count("*").alias("n")).collect()}
    labels, folds = sorted({y for y, _ in counted}), sorted({r.k for r in rows.where("k IS NOT NULL").select("k").distinct().collect()})
    if not labels:
        return [], {}
    c, width = len(labels), 1 + dim
    sizes = {k: np.array([sum(n for (y, f), n in counted.items() if y == label and f != k) for label in labels], float) for k in folds}
    class_weights = {k: np.where(n > 0, n.sum() / np.maximum(n, 1), 0.0) for k, n in sizes.items()}
    mass = {k: max((class_weights[k] * sizes[k]).sum(), 1.0) for k in folds}
    weights = {k: np.zeros((c, width)) for k in folds}
    held = np.tile(np.r_[0.0, np.full(dim, penalty)], c)
    step, reached = {}, {k: np.inf for k in folds}
    open_folds = set(folds)
    for _ in range(max_iter):
        sums = _sums(rows.mapInArrow(_derivatives({k: weights[k] for k in open_folds}, class_weights, labels, dim), "fold int, part binary"))
        for k in sorted(open_folds):
            s = sums[k] / mass[k]
            flat = weights[k].reshape(-1)
            loss = s[0] + 0.5 * (held * flat**2).sum()
            if loss > reached[k] + 1e-12 and np.abs(step[k]).max() > tolerance:  # too far: half the way back
                step[k] = step[k] / 2
                weights[k] = weights[k] - step[k].reshape(c, width)
                continue
            reached[k] = loss
            gradient = s[1 : 1 + c * width] + held * flat
            curvature = s[1 + c * width :].reshape(c * width, c * width) + np.diag(held)
            step[k] = -np.linalg.lstsq(curvature, gradient, rcond=1e-12)[0]  # all intercepts may move together: the least such step
            weights[k] = weights[k] + step[k].reshape(c, width)
            if np.abs(step[k]).max() <= tolerance:
                open_folds.discard(k)
        if not open_folds:
            break
    return labels, weights


def fit_score_cv(features: DataFrame, vec: str, label: str = "label", fold: str = "fold", penalty: float = 0.01, max_iter: int = 30) -> DataFrame:
    """Out-of-fold predictions: features without vec, with the probabilities (rounded to 6 digits) and the class that the model of the row's fold, fitted on all other
    folds, gives it; both are null where the row has no fold or usable vector."""
    labels, weights = fit_folds(features, vec, label, fold, penalty, max_iter)
    dim = next(iter(weights.values())).shape[1] - 1 if weights else 0

    def score(vectors: pa.Array, folds: pa.Array) -> pa.Array:
        good, x = _matrix(vectors, dim)
        out: list = [None] * len(vectors)
        for i, row, k in zip(good.tolist(), x, folds.take(pa.array(good)).to_pylist()):
            if k in weights:
                out[i] = probabilities(row[None, :], weights[k])[0].tolist()
        return pa.array(out, pa.list_(pa.float64()))

    proba = F.arrow_udf(score, "array<double>")(F.col(vec).cast("array<double>"), F.col(fold).cast("int"))
    scored = features.withColumn("proba", F.transform(proba, lambda x: F.round(x, 6)))
    first = F.array_position("proba", F.array_max("proba")).cast("int")
    return scored.withColumn("prediction", F.element_at(F.array(*map(F.lit, labels)).cast("array<int>"), first) if labels else F.lit(None).cast("int")).drop(vec)


def score_partitions(df: DataFrame, load_model: Callable[[], Callable], schema: str) -> DataFrame:
    """load_model() is called once in each task, on its first batch; the model it returns takes and gives pandas frames."""

    def score(batches):
        model = None
        for batch in batches:
            model = load_model() if model is None else model
            yield model(batch)

    return df.mapInPandas(score, schema)


#: Column types that pandas and Arrow convert in one way only.
_PLAIN = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_()}


def _recordings(batches, key: int):
    """Arrow batches in the order of the column `key` -> a pandas frame for each of its values, in lists: those that end in one batch."""
    held = []  # what there is of a recording that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(key).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        start = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        goes_on = bool(held) and held[-1].column(key)[-1].equals(batch.column(key)[0])
        done = []
        if held and not goes_on:
            done.append(pa.Table.from_batches(held).to_pandas())
            held = []
        if len(start) > 2:
            if held:
                done.append(pa.Table.from_batches([*held, batch.slice(0, start[1])]).to_pandas())
            first, last = (1 if held else 0), start[-2]
            # a whole number is no longer one in a pandas column with nulls, so only batches without any are converted at once
            whole = None if any(c.null_count for c in batch.columns) else batch.slice(0, last).to_pandas()
            for a, b in zip(start[first:-2], start[first + 1 : -1]):
                done.append(batch.slice(a, b - a).to_pandas() if whole is None else whole.iloc[a:b].reset_index(drop=True))
            held = []
        held.append(batch.slice(start[-2]))
        if done:
            yield done
    if held:
        yield [pa.Table.from_batches(held).to_pandas()]


def apply_per_recording(df: DataFrame, fn: Callable, schema: str, key: str = "uid") -> DataFrame:
    """Only for work that is sequential in a recording: fn gets all its rows as one pandas frame.

    Recordings go to Python and back many at a time, not each in a stream of its own; with columns other than numbers and strings, one by one.
    """
    fields = StructType.fromDDL(schema).fields
    if any(kind not in _PLAIN for _, kind in df.dtypes) or any(f.dataType.simpleString() not in _PLAIN for f in fields):
        return df.groupBy(key).applyInPandas(fn, schema)
    target = pa.schema([(f.name, _PLAIN[f.dataType.simpleString()]) for f in fields])
    at = df.columns.index(key)

    def over(batches):
        for frames in _recordings(batches, at):
            made = [fn(frame) for frame in frames]
            if len({tuple(frame.dtypes) for frame in made}) == 1:  # else whole numbers would become floats where another recording has nulls
                made = [pd.concat(made, ignore_index=True)]
            for frame in made:
                yield pa.RecordBatch.from_arrays([pa.array(frame[f.name], f.type, from_pandas=True) for f in target], schema=target)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(over, schema)
