"""Reports put together from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.operators import metrics as S
from vocalith.operators.packages import package_rows
from vocalith.operators.stages import Batch
from vocalith.operators.vectors import argmax_class


def evaluation_report(preds: DataFrame, classes: int, sample: DataFrame | None = None, samples: int = 200, group: str | None = None) -> DataFrame:
    """One row: recordings, macro-F1, accuracy, F1 by class, and a bootstrap interval (over `sample`, or all rows).

    Without a label column only the number of recordings is known, and the metrics are null.
    """
    if "label" not in preds.columns:
        none = lambda n, t: F.lit(None).cast(t).alias(n)
        return preds.agg(F.count("*").alias("recordings"), none("macro_f1", "double"), none("accuracy", "double"), none("per_class_f1", "array<double>"))
    label, pred = F.col("label"), F.col("prediction")
    one = preds.where("label >= 0").agg(F.count("*").alias("recordings"), S.r6(S.macro_f1_expr(label, pred, classes)).alias("macro_f1"), S.r6(F.avg((label == pred).cast("int"))).alias("accuracy"), F.array(*[S.r6(S.f1_expr(label, pred, c)) for c in range(classes)]).alias("per_class_f1"))
    return one.crossJoin(S.bootstrap_ci(preds if sample is None else sample, classes, samples, group=group))


def test_sheet(preds: DataFrame, classes: int, samples: int = 10_000, level: float = 0.95) -> DataFrame:
    """The ensemble's row, then one for each model: recordings, macro-F1, accuracy, F1 by class, a bootstrap interval of macro-F1 (all systems on the same resamples), and for the ensemble the mean and
    sample sd of its models' macro-F1."""
    label, pred = F.col("label"), F.col("prediction")
    f1 = S.macro_f1_expr(label, pred, classes)
    whole = S.ensemble_mean(preds, classes).select(F.lit("ensemble").alias("system"), "label", "prediction")
    each = preds.select(F.concat(F.lit("model "), F.col("model").cast("string")).alias("system"), "label", argmax_class(F.col("proba")).alias("prediction"))
    systems = whole.unionByName(each)
    scores = systems.where("label >= 0").groupBy("system").agg(
        F.count("*").alias("recordings"), f1.alias("__f1"), S.r6(F.avg((label == pred).cast("int"))).alias("accuracy"), F.array(*[S.r6(S.f1_expr(label, pred, c)) for c in range(classes)]).alias("per_class_f1")
    )
    q = F.percentile("macro_f1", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    intervals = S.bootstrap_replicates(systems, classes, samples, by=("system",)).groupBy("system").agg(S.r6(q[0]).alias("low"), S.r6(q[1]).alias("high"))
    models = scores.where("system <> 'ensemble'").agg(S.r6(F.avg("__f1")).alias("m"), S.r6(F.stddev_samp("__f1")).alias("sd"))
    ensemble = F.col("system") == "ensemble"
    out = scores.join(intervals, "system").crossJoin(F.broadcast(models))
    return out.select("system", "recordings", S.r6("__f1").alias("macro_f1"), "accuracy", "per_class_f1", "low", "high", F.when(ensemble, F.col("m")).alias("fold_mean"), F.when(ensemble, F.col("sd")).alias("fold_sd"))


def encode_words(batch: Batch, records: DataFrame, words: DataFrame, audio_of: Callable, text_of: Callable, settings: dict[str, dict], after: tuple[str, ...] = (), keep_failed: bool = False) -> DataFrame:
    """The stages audio, text and package of a batch -> rows of the packages.

    audio_of and text_of give (uid, word_id, vec, valid, …) of some words. A change of text settings leaves the acoustic stage as it is. Recordings whose package has a problem are failures, and left
    out unless keep_failed.
    """
    only = lambda df, pending: df.join(pending.select("uid"), "uid", "left_semi")
    audio = batch.run("audio", records, lambda p: audio_of(only(words, p)), settings.get("audio"), after)
    text = batch.run("text", records, lambda p: text_of(only(words, p)), settings.get("text"), after)

    def package(pending: DataFrame) -> DataFrame:
        rows = package_rows(only(audio, pending), only(text, pending))
        return rows.withColumnRenamed("problem", "fault") if keep_failed else rows

    rows = batch.run("package", records, package, {"keep_failed": keep_failed}, (*after, "audio", "text"))
    return rows.withColumnRenamed("fault", "problem") if keep_failed else rows.withColumn("problem", F.lit(None).cast("string"))
