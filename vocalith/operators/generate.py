"""Row generators: segments, crops and augmentation plans. Durations and offsets are integers (ms or samples)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalith.functions.hashing import draw, hash32


def sliding_segments(df: DataFrame, window_ms: int, stride_ms: int, duration: str = "duration_ms") -> DataFrame:
    """One row for each window that fits: start_ms = k * stride. Recordings shorter than a window have one row with a null start."""
    last = F.floor((F.col(duration) - window_ms) / stride_ms)
    starts = F.when(F.col(duration) >= window_ms, F.sequence(F.lit(0).cast("long"), last))
    return df.withColumn("__k", F.explode_outer(starts)).withColumn("start_ms", F.col("__k") * stride_ms).drop("__k")


def crop_starts(length: Column, window: int, crops: int, split: str) -> Column:
    """Evenly spaced distinct offsets, or the one in the middle if the split is not 'train'."""
    room = F.greatest(F.lit(0).cast("long"), length - window)
    if split != "train" or crops == 1:
        return F.array(F.floor(room / 2))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(crops - 1)), lambda i: F.floor(i.cast("long") * room / (crops - 1))))


def fixed_crops(df: DataFrame, window: int, crops: int, split: str, length: str = "duration_ms") -> DataFrame:
    return df.withColumn("crop_starts", crop_starts(F.col(length), window, crops, split))


def sample_crop(df: DataFrame, epoch: int, seed: int, starts: str = "crop_starts", key: str = "uid") -> DataFrame:
    """One crop of each recording and epoch, by hash."""
    place = draw(F.concat_ws(":", F.lit("crop"), F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")), F.size(starts).cast("long"))
    return df.withColumn("crop_start", F.element_at(starts, (place + 1).cast("int")))


#: Signal-to-noise ranges in dB by the kind of noise.
SNR_RANGES = {"noise": (15.0, 25.0), "speech": (15.0, 25.0), "music": (15.0, 20.0)}


def augmentation_plan(df: DataFrame, noises: DataFrame, probability: float, effects: list[str], seed: int, key: str = "uid") -> DataFrame:
    """(key, apply, effect, noise, kind, snr, crop): whether and how each training recording is augmented, all by hash. noises(index, path, type)."""
    k = lambda p: F.concat_ws(":", F.lit(p), F.lit(str(seed)), F.col(key).cast("string"))
    unit = lambda p: hash32(k(p)) / F.lit(float(1 << 32))
    n = F.broadcast(noises.agg(F.count("*").alias("__n")))
    drawn = df.crossJoin(n).select(key, (unit("apply") < probability).alias("apply"), F.element_at(F.array(*map(F.lit, effects)), (draw(k("effect"), len(effects)) + 1).cast("int")).alias("effect"), draw(k("noise"), F.col("__n")).alias("index"), unit("snr").alias("u"), F.round(unit("crop"), 6).alias("crop"))
    low, high = F.lit(SNR_RANGES["noise"][0]), F.lit(SNR_RANGES["noise"][1])
    for kind, (a, b) in SNR_RANGES.items():
        low, high = F.when(F.col("type") == kind, a).otherwise(low), F.when(F.col("type") == kind, b).otherwise(high)
    joined = drawn.join(noises, "index")
    used = F.col("apply")
    return joined.select(key, "apply", F.when(used, F.col("effect")).alias("effect"), F.when(used, F.col("path")).alias("noise"), F.when(used, F.col("type")).alias("kind"), F.when(used, F.round(low + F.col("u") * (high - low), 6)).alias("snr"), F.when(used, F.col("crop")).alias("crop"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """index 0.. in the order; for lists of bounded size."""
    return df.withColumn("index", (F.row_number().over(W.orderBy(order)) - 1).cast("long"))
