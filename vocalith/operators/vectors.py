"""Vectors in long format: one row for each (uid, pos), with a validity mask beside the vector. Sums are taken in DOUBLE."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalith.operators.exact import rounded as rounded_ratio

DIGITS = 6


def _doubles(v) -> Column:
    return F.transform(F.col(v) if isinstance(v, str) else v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def softmax(scores: Column) -> Column:
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda s, y: s + y))


def log_sum_exp(scores: Column) -> Column:
    top = F.array_max(scores)
    return top + F.log(F.aggregate(F.transform(scores, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, y: s + y))


def log_softmax(scores: Column) -> Column:
    total = log_sum_exp(scores)
    return F.transform(scores, lambda x: x - total)


def rounded(v: Column, digits: int = DIGITS) -> Column:
    return F.transform(v, lambda x: F.round(x, digits))


def argmax_class(scores: Column) -> Column:
    """The index of the largest score, the first on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def thresholded_argmax(log_probs: Column, thresholds: list[float]) -> Column:
    """The top class if its log-probability reaches its threshold, else the second best."""
    top = argmax_class(log_probs)
    rest = F.transform(log_probs, lambda x, i: F.when(i == top, F.lit(float("-inf"))).otherwise(x))
    limit = F.element_at(F.array(*map(F.lit, thresholds)), top + 1)
    return F.when(F.array_max(log_probs) >= limit, top).otherwise(argmax_class(rest))


def normalised(log_probs: Column, tolerance: float = 1e-4) -> Column:
    return F.abs(log_sum_exp(log_probs)) <= tolerance


def position_encoding(pos, dim: int) -> Column:
    """Sines at even places and cosines at odd ones."""
    p = (F.col(pos) if isinstance(pos, str) else pos).cast("double")
    rate = lambda i: F.exp(-F.log(F.lit(10000.0)) * (i - i % 2).cast("double") / float(dim))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i % 2 == 0, F.sin(p * rate(i))).otherwise(F.cos(p * rate(i))))


def pad_or_crop(v: Column, n: int, mode: str = "zero_pad") -> Column:
    """Exactly n values: cut, or filled up with zeros or with repetitions of the array (zeros if it is empty)."""
    zeros = F.concat(v, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda _: F.lit(0.0).cast("float")))
    if mode == "zero_pad":
        return F.slice(zeros, 1, n)
    if mode == "repetition_pad":
        times = F.ceil(F.lit(float(n)) / F.greatest(F.size(v), F.lit(1))).cast("int")
        return F.when(F.size(v) == 0, F.slice(zeros, 1, n)).otherwise(F.slice(F.flatten(F.array_repeat(v, times)), 1, n))
    raise ValueError(f"unknown mode {mode}")


def zero_invalid(df: DataFrame, vec: str = "vec", valid: str = "valid") -> DataFrame:
    """Invalid rows carry zeros; was_nonzero reports those whose placeholder was not."""
    zeros = F.transform(vec, lambda x: F.lit(0.0).cast("float"))
    return df.withColumn("was_nonzero", ~F.col(valid) & F.exists(vec, lambda x: x != 0)).withColumn(vec, F.when(F.col(valid), F.col(vec)).otherwise(zeros))


def feature_violations(df: DataFrame, key: str = "uid", vec: str = "vec") -> DataFrame:
    """(uid, rows, width_min, width_max, not_finite, problem) of every recording."""
    bad = F.exists(vec, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    out = df.groupBy(key).agg(F.count("*").alias("rows"), F.min(F.size(vec)).alias("width_min"), F.max(F.size(vec)).alias("width_max"), F.count_if(bad).alias("not_finite"))
    return out.withColumn("problem", F.when(F.col("width_min") != F.col("width_max"), "width").when(F.col("not_finite") > 0, "not finite").when(F.col("width_min") == 0, "empty"))


#: Values from here on, infinite ones and NaN have no exact sums; a group that holds one gets its mean from plain sums of doubles.
WILD = 1e9


def _wild(x: Column) -> Column:
    return F.coalesce(~(F.abs(x.cast("double")) < WILD), F.lit(False))


def _whole(x: Column) -> Column:
    """A value to 12 digits, as a whole number of units; null if it is wild."""
    return F.when(F.abs(x.cast("double")) < WILD, F.round(x.cast("double") * 1e12).cast("decimal(22,0)"))


def _whole_weight(w: Column) -> Column:
    return F.round(w * 1e12).cast("decimal(13,0)")


def _means(df: DataFrame, keys: list[str], dim: int, weight: Column, least: int = 0) -> DataFrame:
    """Weighted means, rounded once. weight: a whole number; values count to 12 digits, so sums are exact and no order of summing changes them."""
    rows = df.withColumns({"__weight": weight, "__wild": F.exists("vec", _wild)})
    w = F.col("__weight").cast("decimal(13,0)")
    n = F.coalesce(F.sum(w).cast("decimal(28,0)"), F.lit(0).cast("decimal(28,0)"))
    n = F.greatest(n, F.lit(least).cast("decimal(28,0)")) if least else n
    taken = lambda e: F.coalesce(F.sum(F.when(w > 0, e)), F.lit(0))
    exact = [rounded_ratio(taken(w * _whole(F.col("vec")[i])), n * 10**6, DIGITS) for i in range(dim)]
    plain = [F.round(F.try_divide(taken(w.cast("double") * F.col("vec")[i].cast("double")), n.cast("double")), DIGITS) for i in range(dim)]
    return rows.groupBy(*keys).agg(F.when(F.max("__wild"), F.array(*plain)).otherwise(F.array(*exact)).alias("vec"))


def masked_mean_pool(df: DataFrame, dim: int) -> DataFrame:
    """(uid, vec): the mean over a recording's valid positions, divided by 1 at least."""
    return _means(df, ["uid"], dim, F.when(F.col("valid"), 1).otherwise(0), 1)


def subword_mean_pool(df: DataFrame, dim: int) -> DataFrame:
    """(uid, word_id, vec, subwords, unknowns): means of the subwords of each word; rows without a word are special tokens."""
    rows = df.where("word_id IS NOT NULL")
    return _means(rows, ["uid", "word_id"], dim, F.lit(1)).join(rows.groupBy("uid", "word_id").agg(F.count("*").alias("subwords"), F.count_if("unknown").alias("unknowns")), ["uid", "word_id"])


def recording_summary_vector(df: DataFrame, dim: int) -> DataFrame:
    """(uid, pos, vec): the whole recording's mean at position 0."""
    return _means(df, ["uid"], dim, F.lit(1)).select("uid", F.lit(0).alias("pos"), "vec")


def attention_pool(df: DataFrame, query: list[float]) -> DataFrame:
    """(uid, vec): the mean of valid positions weighted by softmax(query . vec); zeros where none is valid. Products and weights count to 12 digits, so that no order of summing changes them."""
    dim = len(query)
    weights = F.array(*map(F.lit, query))
    products = F.zip_with(_doubles("vec"), weights, lambda x, y: x * y)
    exact = F.aggregate(F.transform(products, lambda y: F.round(y * 1e12).cast("long")), F.lit(0).cast("long"), lambda s, y: s + y) / 1e12
    score = F.when(F.exists(products, lambda y: F.coalesce(~(F.abs(y) < 1e3), F.lit(True))), dot(_doubles("vec"), weights)).otherwise(exact)
    scored = df.withColumn("__s", F.when(F.col("valid"), score))
    top = scored.groupBy("uid").agg(F.max("__s").alias("__m"))
    share = F.exp(F.col("__s") - F.col("__m"))
    weight = F.when(F.isnan(share), F.lit(1).cast("decimal(13,0)")).otherwise(F.coalesce(_whole_weight(share), F.lit(0)))
    weighted = scored.join(top, "uid").withColumn("__w", weight)
    out = _means(weighted, ["uid"], dim, F.col("__w"))
    return out.withColumn("vec", F.transform("vec", lambda x: F.coalesce(x, F.lit(0.0))))


def layer_mix(df: DataFrame, weights: list[float], dim: int, layer: str = "layer") -> DataFrame:
    """(uid, pos, vec): layers' vectors summed with softmax weights, which count to 12 digits like the values; sums are exact and rounded once."""
    w = F.element_at(softmax(F.array(*map(F.lit, weights))), (F.col(layer) + 1).cast("int"))
    rows = df.withColumns({"__w": w, "__wild": F.exists("vec", _wild)})
    exact = [rounded_ratio(F.sum(_whole_weight(F.col("__w")) * _whole(F.col("vec")[i])), F.lit(10**18).cast("decimal(19,0)"), DIGITS) for i in range(dim)]
    plain = [F.round(F.sum(F.col("__w") * F.col("vec")[i].cast("double")), DIGITS) for i in range(dim)]
    return rows.groupBy("uid", "pos").agg(F.when(F.max("__wild"), F.array(*plain)).otherwise(F.array(*exact)).alias("vec"))


#: Positions of a tile of queries, and of one of values.
TILE = 512


#: Fixed value: rows of a squared norm below it have products below it too, which fit 12 digits and 64 bits.
NORM = 9e6


def _digits(v: np.ndarray) -> list[np.ndarray]:
    """Values to 12 digits as three numbers each, in units of 1, 1e-6 and 1e-12; they are whole, and sums of their products too, so matrices of them multiply without rounding."""
    y = v * 1e12
    n = (np.sign(y) * np.floor(np.abs(y) + 0.5)).astype(np.int64)
    return [x.astype(np.float64) for x in (n // 10**12, n // 10**6 % 10**6, n % 10**6)]


def _scores(q: list[np.ndarray], v: list[np.ndarray]) -> np.ndarray:
    """Products of queries and values in units of 1e-12, rounded once (halves up)."""
    at = lambda *pairs: sum((q[a] @ v[b].T).astype(np.int64) for a, b in pairs)
    rest = at((1, 2), (2, 1)) + at((2, 2)) // 10**6
    return at((0, 0)) * 10**12 + at((0, 1), (1, 0)) * 10**6 + at((0, 2), (1, 1), (2, 0)) + (rest + 500_000) // 10**6


def self_attention(df: DataFrame, dim: int, tile: int = TILE) -> DataFrame:
    """(uid, pos, vec): for each position, the recording's vectors weighted by softmax of their products with its own.

    A recording's rows are put into tiles, and each tile of queries meets each tile of values as two matrices: once for every query's greatest product, and once more for the sum of its weights
    relative to it and the weighted sum. So no row stands for a pair of positions, and a task holds two tiles, however long the recording is. Values, products and weights count to 12 digits, so that
    sums are exact. Recordings with values that are not finite, or rows of a squared norm from `NORM` on, go by plain doubles.
    """
    vec = _doubles("vec")
    norm = F.aggregate(F.transform(vec, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    line = W.partitionBy("uid")
    wild = F.max(F.coalesce(~(norm < NORM), F.lit(True))).over(line)
    numbered = df.select("uid", "pos", vec.alias("vec"), wild.alias("wild"), F.floor((F.row_number().over(line.orderBy("pos")) - 1) / tile).cast("int").alias("tile"))
    kinds = dict(df.dtypes)

    def met_of(rows: DataFrame) -> DataFrame:
        tiles = rows.groupBy("uid", "tile").agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in ("uid", "tile", "wild")])).alias("rows"))  # `tile` rows at most
        n = tiles.groupBy("uid").agg((F.max("tile") + 1).alias("tiles"))
        asked = tiles.join(n, "uid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return asked.join(tiles.select("uid", F.col("tile").alias("other"), F.col("rows").alias("values")), ["uid", "other"]).select("uid", "rows", "values")

    def pairs(batches):
        for batch in batches:
            for uid, queries, values in zip(*(batch.column(c) for c in ("uid", "rows", "values"))):
                q, v = (np.array(x.values.field("vec").flatten().to_numpy(zero_copy_only=False)).reshape(len(x.values), dim) for x in (queries, values))
                yield pa.array([uid.as_py()] * len(q), batch.column("uid").type), queries.values, q, v

    def listed(m: np.ndarray) -> pa.Array:
        flat = pa.array(np.ascontiguousarray(m).reshape(-1))
        return pa.FixedSizeListArray.from_arrays(flat, dim).cast(pa.list_(flat.type))

    def tops(batches):
        for uid, queries, q, v in pairs(batches):
            yield pa.RecordBatch.from_arrays([uid, queries.field("pos"), pa.array(_scores(_digits(q), _digits(v)).max(axis=1))], names=["uid", "pos", "top"])

    def sums(batches):
        for uid, queries, q, v in pairs(batches):
            x = _digits(v)
            below = _scores(_digits(q), x) - queries.field("top").to_numpy()[:, None]
            w = np.floor(np.exp(below / 1e12) * 1e12 + 0.5).astype(np.int64)
            w = [(w // 10**6).astype(np.float64), (w % 10**6).astype(np.float64)]
            at = lambda *terms: sum((w[a] @ x[b]).astype(np.int64) for a, b in terms)  # noqa: E731, B023
            low = at((1, 2))
            mid = at((0, 2), (1, 1)) + low // 10**6
            high = at((0, 0)) * 10**6 + at((0, 1), (1, 0)) + mid // 10**6
            mass = (w[0].sum(axis=1) * 1e6 + w[1].sum(axis=1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([uid, queries.field("pos"), pa.array(mass), listed(high), listed(mid % 10**6 * 10**6 + low % 10**6)], names=["uid", "pos", "mass", "high", "low"])

    def plain(batches):
        for uid, queries, q, v in pairs(batches):
            s = q @ v.T
            top = s.max(axis=1)
            w = np.exp(s - top[:, None])
            yield pa.RecordBatch.from_arrays([uid, queries.field("pos"), pa.array(top), pa.array(w.sum(axis=1)), listed(w @ v)], names=["uid", "pos", "top", "mass", "total"])

    key = f"uid {kinds['uid']}, pos {kinds['pos']}"
    tame = numbered.where("NOT wild")
    top = met_of(tame).mapInArrow(tops, f"{key}, top long").groupBy("uid", "pos").agg(F.max("top").alias("top"))
    parts = met_of(tame.join(top.hint("merge"), ["uid", "pos"])).mapInArrow(sums, f"{key}, mass long, high array<long>, low array<long>")
    total = lambda i: F.sum(F.col("high")[i].cast("decimal(20,0)")) * 10**12 + F.sum(F.col("low")[i].cast("decimal(20,0)"))
    exact = parts.groupBy("uid", "pos").agg(F.array(*[rounded_ratio(total(i), F.sum(F.col("mass").cast("decimal(20,0)")) * 10**6, DIGITS) for i in range(dim)]).alias("vec"))
    rest = met_of(numbered.where("wild")).mapInArrow(plain, f"{key}, top double, mass double, total array<double>")
    scaled = rest.withColumn("scale", F.exp(F.col("top") - F.max("top").over(W.partitionBy("uid", "pos"))))
    of_rest = scaled.groupBy("uid", "pos").agg(F.array(*[F.round(F.sum(F.col("scale") * F.col("total")[i]) / F.sum(F.col("scale") * F.col("mass")), DIGITS) for i in range(dim)]).alias("vec"))
    return exact.unionByName(of_rest)
