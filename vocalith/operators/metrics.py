"""Scores of predictions, their uncertainty, and descriptive statistics."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalith.functions.hashing import hash32
from vocalith.operators.exact import exact_mean, exact_sum, rounded  # noqa: F401
from vocalith.operators.ordering import global_index
from vocalith.operators.vectors import argmax_class
from vocalith.sources.storage import sound_unions

#: Resampling units (some 200 bytes each) that may be broadcast; more are shuffled.
BROADCAST_UNITS = 200_000


def r6(c) -> Column:
    return F.round(c, 6)


# --- reusable aggregate expressions


def f1_expr(label: Column, prediction: Column, c: int, weight: Column | None = None) -> Column:
    """F1 of class c as an aggregate: 2 TP / (actual + predicted), 0 if there are none."""
    w = F.lit(1) if weight is None else weight
    total = lambda cond: F.coalesce(F.sum(F.when(cond, w)), F.lit(0))
    n = total(label == c) + total(prediction == c)
    return F.when(n == 0, 0.0).otherwise(2.0 * total((label == c) & (prediction == c)) / n)


def macro_f1_expr(label: Column, prediction: Column, classes: int, weight: Column | None = None) -> Column:
    """The mean of F1 over the declared classes, absent ones too."""
    return reduce(lambda a, b: a + b, [f1_expr(label, prediction, c, weight) for c in range(classes)]) / float(classes)


def _scored(df: DataFrame) -> DataFrame:
    """Rows of the test set carry label -1 and never enter a metric."""
    return df.where("label >= 0")


def confusion_matrix(preds: DataFrame, classes: int) -> DataFrame:
    """(label, prediction, n) of every pair of declared classes."""
    spark = preds.sparkSession
    axis = spark.range(classes).select(F.col("id").cast("int").alias("label"))
    cells = axis.crossJoin(axis.withColumnRenamed("label", "prediction"))
    n = _scored(preds).groupBy("label", "prediction").agg(F.count("*").alias("n"))
    return cells.join(n, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class_f1(preds: DataFrame, classes: int, by: list[str] = ()) -> DataFrame:
    wide = _scored(preds).groupBy(*by).agg(F.array(*[r6(f1_expr(F.col("label"), F.col("prediction"), c)) for c in range(classes)]).alias("f"))
    return wide.select(*by, F.posexplode("f").alias("class", "f1"))


def macro_f1(preds: DataFrame, classes: int, by: list[str] = ()) -> DataFrame:
    return _scored(preds).groupBy(*by).agg(r6(macro_f1_expr(F.col("label"), F.col("prediction"), classes)).alias("macro_f1"))


def accuracy(preds: DataFrame, by: list[str] = ()) -> DataFrame:
    return _scored(preds).groupBy(*by).agg(r6(F.avg((F.col("label") == F.col("prediction")).cast("int"))).alias("accuracy"))


def cv_summary(preds: DataFrame, classes: int, fold: str = "fold") -> DataFrame:
    """One row: folds, recordings, mean and sample sd of fold macro-F1, worst fold and its score, pooled out-of-fold macro-F1."""
    each = _scored(preds).groupBy(fold).agg(macro_f1_expr(F.col("label"), F.col("prediction"), classes).alias("m"), F.count("*").alias("n"))
    over = each.agg(F.count("*").alias("num_folds"), F.sum("n").alias("recordings"), r6(F.avg("m")).alias("mean_macro_f1"), r6(F.stddev_samp("m")).alias("std_macro_f1"), F.min_by(F.col(fold), F.struct("m", fold)).alias("worst_fold"), r6(F.min("m")).alias("worst_macro_f1"))
    return over.crossJoin(_scored(preds).agg(r6(macro_f1_expr(F.col("label"), F.col("prediction"), classes)).alias("out_of_fold_macro_f1")))


def bootstrap_draws(units: DataFrame, samples: int, seed: str = "b") -> DataFrame:
    """units(index 0..n-1, …) -> (replicate, index): n draws with replacement for each replicate, by hash; one md5 gives four draws.

    Draws are made in blocks that are spread over the tasks, so that no row holds a replicate's whole sequence.
    """
    spark = units.sparkSession
    n = units.agg(F.count("*").alias("n"))
    spread = spark.range(samples).select(F.col("id").cast("int").alias("replicate")).crossJoin(F.broadcast(n)).where("n > 0")
    return _drawn(spread.withColumn("draws", F.col("n")), seed)


def _drawn(spread: DataFrame, seed: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by…, replicate, n, draws) -> (by…, replicate, index): so many draws below n, the same for all `by`."""
    block = 1 << 14
    blocks = spread.where("draws > 0").select(*by, "replicate", "n", "draws", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("draws") - 1) / block))).alias("block"))
    blocks = blocks.repartition(4 * spread.sparkSession.sparkContext.defaultParallelism, "replicate", "block")
    fours = blocks.select(*by, "replicate", "n", "draws", F.explode(F.sequence(F.col("block") * (block // 4), F.floor((F.least(F.col("draws"), (F.col("block") + 1) * block) - 1) / 4))).alias("four"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("replicate").cast("string"), F.col("four").cast("string")))
    each = fours.select(*by, "replicate", "n", "draws", "four", digest.alias("md5")).select(*by, "replicate", "n", "draws", "four", "md5", F.explode(F.array(*map(F.lit, range(4)))).alias("k")).where("4 * four + k < draws")
    return each.select(*by, "replicate", F.pmod(F.conv(F.substring("md5", F.col("k") * 8 + 1, F.lit(8)), 16, 10).cast("long"), F.col("n")).alias("index"))


#: Up to so many units a task counts a replicate's draws by itself (8 bytes a unit); with more, draws are counted over a shuffle.
COUNTED_UNITS = 1 << 23
_MD5_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_MD5_PLACES = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_MD5_SUMMANDS = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def md5_words(prefix: bytes, first: int, last: int) -> np.ndarray:
    """[4, last - first]: the four groups of 8 hex digits of md5(prefix and the decimal j) for first <= j < last, as whole numbers."""
    m, longest = last - first, len(prefix) + len(str(last - 1))
    if longest > 55:
        raise ValueError("one block of md5 holds 55 bytes")
    block = np.zeros((m, 64), np.uint8)
    block[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
    at = first
    while at < last:  # numbers with the same number of digits
        upto = min(last, 10 ** len(str(at)))
        size, rows, j = len(prefix) + len(str(at)), block[at - first : upto - first], np.arange(at, upto, dtype=np.uint32 if upto < 1 << 32 else np.uint64)
        for d in range(size - 1, len(prefix) - 1, -1):
            tenth = j // 10
            rows[:, d] = j - 10 * tenth + 48
            j = tenth
        rows[:, size] = 128
        rows[:, 56:58] = np.frombuffer((8 * size).to_bytes(2, "little"), np.uint8)
        at = upto
    words = block.view("<u4")
    varies = [*range(len(prefix) // 4, longest // 4 + 1), 14]
    message = [np.ascontiguousarray(words[:, i]) if i in varies else int(words[0, i]) for i in range(16)]
    start = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    a, b, c, d = (np.full(m, x, np.uint32) for x in start)
    high = np.empty(m, np.uint32)
    for i in range(64):
        part = i // 16
        f = _md5_mix(part, b, c, d)
        word = message[_MD5_PLACES[part](i)]
        f += a
        if isinstance(word, int):
            f += np.uint32((word + _MD5_SUMMANDS[i]) % 2**32)
        else:
            f += word
            f += np.uint32(_MD5_SUMMANDS[i])
        by = _MD5_SHIFTS[part][i % 4]
        np.right_shift(f, np.uint32(32 - by), out=high)
        f <<= np.uint32(by)
        f |= high
        f += b
        a, b, c, d = d, f, b, c
    return np.stack([(x + np.uint32(s)).byteswap() for x, s in zip((a, b, c, d), start)])


def _md5_mix(part: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if part == 2:
        f = b ^ c
        f ^= d
    elif part == 3:
        f = ~d
        f |= b
        f ^= c
    else:
        x, y, z = (b, c, d) if part == 0 else (d, b, c)
        f = y ^ z
        f &= x
        f ^= z
    return f


def _own_counts(n: int, seed: str, chunk: int = 1 << 20, step: int = 1 << 15):
    """(replicate) -> (replicate, index, n): how often each unit is drawn, for those that are."""

    def draws(replicate: int):
        prefix, j, fours = f"{seed}:{replicate}:".encode(), 0, -(-n // 4)
        while j < fours:
            last = min(j + step, fours)
            four = md5_words(prefix, j, last)
            yield (four % np.uint32(n)).T.ravel()[: n - 4 * j]
            j = last

    def counts(replicate: int) -> np.ndarray:
        total, held, rows = np.zeros(n, np.int32), [], 0
        for some in draws(replicate):
            held.append(some)
            rows += len(some)
            if rows >= max(chunk, n // 4):
                total += np.bincount(np.concatenate(held), minlength=n).astype(np.int32)
                held, rows = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=n).astype(np.int32)
        return total

    def over(batches):
        for batch in batches:
            for replicate in batch.column(0).to_pylist():
                total = counts(replicate)
                index = np.flatnonzero(total)
                for at in range(0, len(index), 1 << 16):
                    some = index[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), replicate, np.int32)), pa.array(some, pa.int64()), pa.array(total[some].astype(np.int64))], names=["replicate", "index", "n"])

    return over


def bootstrap_counts(units: DataFrame, samples: int, seed: str = "b", limit: int = COUNTED_UNITS) -> DataFrame:
    """(replicate, index, n): how often each unit is drawn by `bootstrap_draws`; units that are not drawn have no row.

    A replicate is one task's work, which counts the draws as it makes them, so that they are neither rows nor shuffled.
    """
    spark = units.sparkSession
    n = units.count()
    if n > limit or len(seed) > 30:
        return bootstrap_draws(units, samples, seed).groupBy("replicate", "index").agg(F.count("*").alias("n"))
    replicates = spark.range(0, samples if n else 0, 1, 8 * spark.sparkContext.defaultParallelism).select(F.col("id").cast("int").alias("replicate"))
    return replicates.mapInArrow(_own_counts(n, seed), "replicate int, index long, n long")


def _macro_of(tp: list[Column], actual: list[Column], predicted: list[Column]) -> Column:
    each = [F.when(a + p == 0, 0.0).otherwise(2.0 * t / (a + p)) for t, a, p in zip(tp, actual, predicted)]
    return (reduce(lambda x, y: x + y, each) / float(len(each))).alias("macro_f1")


def mix32(x, *words):
    """32 mixed bits of x and further 32-bit words; on whole numbers, arrays of them, or Columns of longs. The same steps can be written in SQL."""
    column = isinstance(x, Column)
    xor = (lambda a, b: a.bitwiseXOR(b if isinstance(b, Column) else F.lit(b))) if column else (lambda a, b: a ^ b)
    half = (lambda a: F.shiftright(a, 16)) if column else (lambda a: a >> 16)
    for w in (None, *words):
        x = x if w is None else xor(x, w)
        for _ in range(2):
            x = xor(x, half(x)) * MIX_FACTOR % (1 << 32)
        x = xor(x, half(x))
    return x


#: Fixed value: the odd factor of `mix32`, below 2**27, so that products stay below 2**63.
MIX_FACTOR = 0x45D9F3B


def poisson_steps(rate: float) -> np.ndarray:
    """The distribution function of a Poisson number at 0, 1, 2, …: a uniform u draws as many as there are steps at or below it."""
    first, last = max(0, math.floor(rate - 9 * math.sqrt(rate) - 10)), math.ceil(rate + 9 * math.sqrt(rate) + 10)
    k = np.arange(first, last + 1)
    log_p = k * math.log(rate) - rate - np.array([math.lgamma(i + 1.0) for i in k]) if rate > 0 else np.where(k == 0, 0.0, -np.inf)
    return np.r_[np.zeros(first), np.cumsum(np.exp(log_p))]


def _pooled_groups(samples: int, columns: int):
    """(times, share, first word, second word, counts…) of alike groups -> (replicate, draws, sums…): what this task's groups add to each replicate."""

    def over(batches):
        replicate = np.arange(samples, dtype=np.int64)
        total = np.zeros((samples, 1 + columns), np.int64)
        steps: dict[float, np.ndarray] = {}
        for batch in batches:
            times, share, one, two, *counts = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            row = np.column_stack([np.ones(len(times), np.int64), *counts])
            for k in range(len(times)):
                rate = float(times[k] * share[k])
                if rate not in steps:
                    steps[rate] = poisson_steps(rate)
                u = (mix32(replicate, int(one[k]), int(two[k])) + 0.5) / 4294967296.0
                total += np.searchsorted(steps[rate], u, side="right")[:, None] * row[k]
        yield pa.RecordBatch.from_arrays([pa.array(replicate), *(pa.array(total[:, j]) for j in range(1 + columns))], names=["replicate", "pooled", *(f"s{j}" for j in range(columns))])

    return over


def group_replicates(units: DataFrame, classes: int, samples: int, seed: str = "b") -> DataFrame:
    """units(index, counts ARRAY of [class] STRUCT(tp, actual, predicted)) -> (replicate, macro_f1): whole groups are drawn, and their counts summed.

    Groups with the same counts are alike, so a replicate costs a draw for each distinct list of counts and some 6 sqrt(n) single ones, not n: as with rows
    (`row_replicates`), n - 6 sqrt(n) draws (in the mean) are made at once, as a Poisson number for each list; given their sum these are multinomial. Lists are spread
    over the tasks, and a task adds its lists up by replicate, so `samples` rows leave it however many there are. Up to 36 groups all draws are single.
    """
    spark = units.sparkSession
    names = {f"{part}{c}": F.col("counts")[c][part].cast("long") for part in ("tp", "actual", "predicted") for c in range(classes)}
    flat = units.select("index", *[v.alias(k) for k, v in names.items()])
    size = units.agg(F.count("*").alias("n"))
    n = size.first()["n"]
    share = max(0.0, n - 6 * math.sqrt(n)) / n if n else 0.0
    label = F.md5(F.concat_ws(":", F.lit(seed + "g"), *[F.col(k).cast("string") for k in names]))
    word = lambda at: F.conv(F.substring(label, at, 8), 16, 10).cast("long")
    alike = flat.groupBy(*names).agg(F.count("*").alias("times")).select("times", F.lit(share).alias("share"), word(1).alias("one"), word(9).alias("two"), *names)
    alike = alike.repartition(spark.sparkContext.defaultParallelism, "one")
    schema = "replicate long, pooled long, " + ", ".join(f"s{j} long" for j in range(len(names)))
    parts = alike.mapInArrow(_pooled_groups(samples, len(names)), schema)
    replicates = spark.range(samples).select(F.col("id").alias("replicate"))
    pooled = replicates.join(parts, "replicate", "left").groupBy("replicate").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["pooled", *(f"s{j}" for j in range(len(names)))]])
    pooled = pooled.withColumn("replicate", F.col("replicate").cast("int"))
    lacking = pooled.select("replicate", F.lit(n).cast("long").alias("n"), (n - F.col("pooled")).alias("draws"))
    few = n <= BROADCAST_UNITS  # the draws are far more, which Spark's estimate of an exploded side does not see
    singles = _drawn(lacking, seed).join(F.broadcast(flat) if few else flat.hint("shuffle_hash"), "index").groupBy("replicate").agg(*[F.sum(k).alias(k) for k in names])
    whole = pooled.join(singles, "replicate", "left").select("replicate", *[(F.col(f"s{j}") + F.coalesce(F.col(k), F.lit(0))).alias(k) for j, k in enumerate(names)])
    return whole.where(F.lit(n > 0)).select("replicate", _macro_of(*[[F.col(f"{part}{c}") for c in range(classes)] for part in ("tp", "actual", "predicted")]))


def log_factorial(k: Column) -> Column:
    """ln k! to 1e-10: Stirling's series at k + 9, less the eight factors above k."""
    z = k + 9.0
    shifted = reduce(lambda a, b: a * b, [k + float(i) for i in range(1, 9)])
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(shifted)


def row_replicates(preds: DataFrame, classes: int, samples: int, seed: str = "b", by: tuple[str, ...] = ()) -> DataFrame:
    """(by…, replicate, w ARRAY): how often each cell (label, prediction) is drawn when as many rows as there are, n, are drawn with replacement.

    Rows of one cell are alike, so n - 6 sqrt(n) draws (in the mean) are made at once, as a Poisson number for each cell; given their sum these are
    multinomial. The draws that are left to n, some 6 sqrt(n), are made one by one. So a replicate costs sqrt(n), and its counts are distributed
    as those of n single draws (but for one replicate in 10**9 whose Poisson numbers exceed n). Up to 36 rows all draws are single.
    Groups of rows by `by` (not null) are resampled each for itself, all with the same random numbers, so that they can be compared replicate by replicate. Cell `label * (classes + 1) + prediction`; a prediction that is no declared class counts as number `classes`.
    """
    spark, width = preds.sparkSession, classes + 1
    sound_unions(spark)
    cells = range(classes * width)
    place = F.col("label") * width + F.when(F.col("prediction").between(0, classes - 1), F.col("prediction")).otherwise(classes)
    sizes = _scored(preds).groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.count_if(place == c) for c in cells]).alias("sizes"))
    rate = F.greatest(F.lit(0.0), F.col("n") - 6 * F.sqrt("n"))
    each = sizes.select(*by, "n", F.posexplode("sizes").alias("cell", "size")).withColumn("rate", F.coalesce(rate * F.col("size") / F.col("n"), F.lit(0.0)))
    reach = 9 * F.sqrt("rate") + 10
    steps = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(F.col("rate") - reach)), F.ceil(F.col("rate") + reach))
    log_p = F.when(F.col("rate") == 0, F.when(F.col("k") == 0, 0.0).otherwise(-1e300)).otherwise(F.col("k") * F.log("rate") - F.col("rate") - log_factorial(F.col("k").cast("double")))
    by_cell = W.partitionBy(*by, "cell").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    table = each.select(*by, "cell", "rate", F.explode(steps).alias("k")).select(*by, "cell", "k", F.coalesce(F.sum(F.exp(log_p)).over(by_cell), F.lit(0.0)).alias("u"))
    replicates = spark.range(samples).select(F.col("id").cast("int").alias("replicate"))
    asked = replicates.select("replicate", F.explode(F.array(*map(F.lit, cells))).alias("cell")).withColumn("u", (hash32(F.concat_ws(":", F.lit(seed + "p"), F.col("replicate").cast("string"), F.col("cell").cast("string"))) + 0.5) / 4294967296.0)
    asked = asked.crossJoin(F.broadcast(sizes.select(*by))) if by else asked
    both = table.withColumn("replicate", F.lit(None).cast("int")).unionByName(asked.withColumn("k", F.lit(None).cast("long")))
    line = W.partitionBy(*by, "cell").orderBy("u", F.col("k").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    at_once = both.withColumn("k", F.last("k", ignorenulls=True).over(line)).where("replicate IS NOT NULL")
    pooled = at_once.groupBy(*by, "replicate").agg(*[F.sum(F.when(F.col("cell") == c, F.col("k")).otherwise(0)).alias(f"p{c}") for c in cells], F.sum("k").alias("pooled"))
    with_each = lambda df, other: df.join(F.broadcast(other), list(by)) if by else df.crossJoin(F.broadcast(other))
    singles = _drawn(with_each(pooled, sizes).select(*by, "replicate", "n", (F.col("n") - F.col("pooled")).alias("draws")), seed, by)
    upto = [sum((F.col("sizes")[i] for i in range(c)), F.lit(0)) for c in range(len(cells) + 1)]
    bounds = sizes.select(*by, *[b.alias(f"b{c}") for c, b in enumerate(upto)])
    counted = with_each(singles, bounds).groupBy(*by, "replicate").agg(*[F.count_if((F.col("index") >= F.col(f"b{c}")) & (F.col("index") < F.col(f"b{c + 1}"))).alias(f"s{c}") for c in cells])
    return pooled.join(counted, [*by, "replicate"], "left").select(*by, "replicate", F.array(*[F.col(f"p{c}") + F.coalesce(f"s{c}", F.lit(0)) for c in cells]).alias("w"))


def bootstrap_replicates(preds: DataFrame, classes: int, samples: int, seed: str = "b", by: tuple[str, ...] = ()) -> DataFrame:
    """(by…, replicate, macro_f1) of resampled rows."""
    w, width = F.col("w"), classes + 1
    actual = [sum((w[c * width + p] for p in range(width)), F.lit(0)) for c in range(classes)]
    predicted = [sum((w[a * width + c] for a in range(classes)), F.lit(0)) for c in range(classes)]
    return row_replicates(preds, classes, samples, seed, by).select(*by, "replicate", _macro_of([w[c * width + c] for c in range(classes)], actual, predicted))


def resampling_units(preds: DataFrame, classes: int, unit: str) -> DataFrame:
    """(index, counts): one unit for each value of `unit`, numbered in its order."""
    label, pred = F.col("label"), F.col("prediction")
    count = lambda cond: F.coalesce(F.sum(cond.cast("int")), F.lit(0))
    counts = F.array(*[F.struct(count((label == c) & (pred == c)).alias("tp"), count(label == c).alias("actual"), count(pred == c).alias("predicted")) for c in range(classes)])
    per = _scored(preds).groupBy(unit).agg(counts.alias("counts"))
    return global_index(per, unit).select(F.col("index").cast("long").alias("index"), "counts")


def bootstrap_ci(preds: DataFrame, classes: int, samples: int, level: float = 0.95, group: str | None = None, seed: str = "b") -> DataFrame:
    """One row: resampling units, replicates, quantile interval, standard error and mean of macro-F1. Rows are drawn, or whole groups."""
    units = _scored(preds) if group is None else resampling_units(preds, classes, group)
    reps = bootstrap_replicates(preds, classes, samples, seed) if group is None else group_replicates(units, classes, samples, seed)
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    q = F.percentile("macro_f1", F.array(F.lit(lo), F.lit(hi)))
    out = reps.agg(F.count("*").alias("replicates"), r6(q[0]).alias("low"), r6(q[1]).alias("high"), r6(F.stddev_samp("macro_f1")).alias("se"), r6(F.avg("macro_f1")).alias("mean"))
    return out.crossJoin(units.agg(F.count("*").alias("units")))


def ensemble_join(preds: DataFrame, k: int) -> DataFrame:
    """(uid, label, probas, problem): the k rows of each uid lined up by model, with what is wrong with them."""
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    good = F.forall("proba", lambda x: (x >= 0) & (x <= 1)) & (F.abs(total(F.col("proba")) - 1) <= 1e-6)
    by = preds.groupBy("uid").agg(F.count("*").alias("n"), F.min("label").alias("label"), F.max("label").alias("high"), F.bool_and(good).alias("good"), F.transform(F.array_sort(F.collect_list(F.struct("model", "proba"))), lambda x: x["proba"]).alias("probas"))
    return by.select("uid", "label", "probas", F.when(F.col("n") != k, "rows").when(F.col("label") != F.col("high"), "labels").when(~F.col("good"), "probabilities").alias("problem"))


def mean_of_shares(c: Column) -> Column:
    """As `exact_mean`, for values of 1 at most and fewer than 9 million of them: sums are longs of 12 digits."""
    total, parts = F.sum(F.round(c * 1e12).cast("long")), F.count(c) * 10**6
    whole = F.call_function("div", 2 * F.abs(total) + parts, F.when(parts > 0, 2 * parts))
    return F.when(total < 0, -whole).otherwise(whole) / 1e6


def ensemble_mean(preds: DataFrame, classes: int) -> DataFrame:
    """(uid, label, proba, prediction): mean probabilities (rounded once, to 6 digits) and their first largest class."""
    by = preds.groupBy("uid").agg(F.min("label").alias("label"), F.array(*[mean_of_shares(F.col("proba")[c]) for c in range(classes)]).alias("proba"))
    return by.withColumn("prediction", argmax_class(F.col("proba")))


# --- descriptive


#: Selection splits a range of values in so many parts at a time, and sorts ranges with no more values than this.
PARTS, SORTED_AT_ONCE = 1024, 10_000


def select_ranks(values: DataFrame, ranks: list[int]) -> dict[int, float]:
    """values(v DOUBLE, finite) -> the value at each rank from 0, exactly.

    A pass counts the values of the range that holds a rank in PARTS equal parts, for all ranks at once, and goes on within the part that holds it, between its least and
    greatest value, until these are one value or a few, which are sorted. A task and the driver hold counts, never the column.
    """
    ends = values.agg(F.min("v"), F.max("v")).first()
    v = F.col("v")
    open_ranges = {r: (ends[0], ends[1], r) for r in ranks}  # least, greatest, rank within
    found: dict[int, float] = {}
    while open_ranges:
        todo = sorted({(a, b) for a, b, _ in open_ranges.values()})  # equal or disjoint
        which, part = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (a, b) in enumerate(todo):
            inside = v.between(a, b)
            width = b / 2 - a / 2
            which = F.when(inside, i).otherwise(which)
            part = F.when(inside, F.least(F.lit(PARTS - 1), F.floor((v / 2 - a / 2) / width * PARTS)).cast("int") if width > 0 else F.lit(0)).otherwise(part)
        rows = values.select("v", which.alias("which"), part.alias("part")).where("which IS NOT NULL").groupBy("which", "part").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        counts = {i: sorted((x for x in rows if x.which == i), key=lambda x: x.part) for i in range(len(todo))}
        still = {}
        for r, (a, b, within) in open_ranges.items():
            for x in counts[todo.index((a, b))]:
                if within < x.n:
                    break
                within -= x.n
            if x.a == x.b:
                found[r] = x.a
            elif x.n <= SORTED_AT_ONCE:
                found[r] = sorted(y.v for y in values.where(v.between(x.a, x.b)).select("v").collect())[within]
            else:
                still[r] = (x.a, x.b, within)
        open_ranges = still
    return found


def quantiles(values: DataFrame, points: list[float]) -> dict[float, float | None]:
    """Linear interpolation between ranks, as `percentile` has it."""
    n = values.count()
    if not n:
        return dict.fromkeys(points)
    places = {q: q * (n - 1) for q in points}
    at = select_ranks(values, sorted({r for p in places.values() for r in (math.floor(p), math.ceil(p))}))
    return {q: at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for q, p in places.items()}


def describe_durations(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, missing and unreadable (not finite or negative) values, and moments and exact quartiles of the others."""
    c = F.col(column).cast("double")
    bad = F.isnan(c) | (F.abs(c) == float("inf")) | (c < 0)
    ok = F.when(c.isNotNull() & ~bad, c)
    q = quantiles(df.select(ok.alias("v")).where("v IS NOT NULL"), [0.25, 0.5, 0.75])
    value = lambda x: r6(F.lit(x).cast("double"))
    return df.agg(F.count("*").alias("rows"), F.count_if(c.isNull()).alias("missing"), F.count_if(bad).alias("unreadable"), r6(F.avg(ok)).alias("mean"), r6(F.stddev_samp(ok)).alias("std"), F.min(ok).alias("min"), value(q[0.25]).alias("q25"), value(q[0.5]).alias("median"), value(q[0.75]).alias("q75"), F.max(ok).alias("max"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, n) of equal widths between the least and largest value, the last bin closed; empty bins too."""
    c = F.col(column)
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((c - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))))
    n = df.where(c.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def population_stats(df: DataFrame, column: str) -> DataFrame:
    return df.agg(r6(F.avg(column)).alias("mean"), r6(F.stddev_pop(column)).alias("std"))


def weighted_mean(df: DataFrame, value: str, weight: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(r6(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))).alias("weighted_mean"))


def robustness_curve(preds: DataFrame, classes: int, systems: tuple[str, str]) -> DataFrame:
    """preds(system, rate, seed, label, prediction) -> (rate, one mean score a system, gain in points of the second over the first)."""
    each = macro_f1(preds, classes, ["system", "rate", "seed"])
    wide = each.groupBy("rate").pivot("system", list(systems)).agg(F.avg("macro_f1"))
    a, b = (F.col(s) for s in systems)
    return wide.select("rate", r6(a).alias(systems[0]), r6(b).alias(systems[1]), r6(100 * (b - a)).alias("gain"))
