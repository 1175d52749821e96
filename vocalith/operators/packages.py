"""Packages of a recording's words: acoustic and text vectors, word by word, under one mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalith.sources.manifests import multiset_digest


def _not_finite(v: Column) -> Column:
    return F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def package_rows(audio: DataFrame, text: DataFrame) -> DataFrame:
    """audio(uid, word_id, vec, valid, …), text(uid, word_id, vec, valid[, paired]) -> one row for each word of either: audio, text, audio_valid, text_valid, valid (both), status, problem.

    status: paired, no_interval, no_text_tokens, or neither. problem: the recording's first by name, on all of its rows: a word that only one side has, vectors that are not finite, a row
    that is invalid and not zero, a given paired mask that is not the intersection, or no valid pair at all. Rows are never dropped.
    """
    a = audio.select("uid", "word_id", F.col("vec").alias("audio"), F.col("valid").alias("audio_valid"), *[c for c in audio.columns if c not in ("uid", "word_id", "vec", "valid")])
    b = text.select("uid", "word_id", F.col("vec").alias("text"), F.col("valid").alias("text_valid"), *(["paired"] if "paired" in text.columns else []))
    both = a.join(b, ["uid", "word_id"], "full_outer")
    valid = F.coalesce(F.col("audio_valid") & F.col("text_valid"), F.lit(False))
    nonzero = lambda v, ok: ~F.col(ok) & F.exists(v, lambda x: x != 0)
    found = F.array_compact(F.array(
        F.when(F.col("audio_valid").isNull() | F.col("text_valid").isNull(), "word ids"),
        F.when(_not_finite(F.col("audio")), "audio vectors"), F.when(_not_finite(F.col("text")), "text vectors"),
        F.when(nonzero("audio", "audio_valid") | nonzero("text", "text_valid"), "placeholder"),
        F.when(~F.col("paired").eqNullSafe(valid), "paired mask") if "paired" in text.columns else F.lit(None).cast("string"),
    ))
    rows = both.withColumn("valid", valid).withColumn("__found", F.array_min(found))
    status = F.when(F.col("valid"), "paired").when(F.coalesce("text_valid", F.lit(False)), "no_interval").when(F.coalesce("audio_valid", F.lit(False)), "no_text_tokens").otherwise("neither")
    recording = W.partitionBy("uid")
    problem = F.coalesce(F.min("__found").over(recording), F.when(~F.max("valid").over(recording), "no valid pair"))
    return rows.withColumn("status", status).withColumn("problem", problem).drop("__found", "paired")


def vector_line(vec: str, valid: str) -> Column:
    """A word's vector in thousandths, as a line of a content hash."""
    return F.concat_ws(":", F.col("word_id").cast("string"), F.col(valid).cast("string"), F.array_join(F.transform(vec, lambda x: F.round(x * 1000).cast("long")), "_"))


def package_summary(rows: DataFrame, measures: list[Column] = ()) -> DataFrame:
    """One row for each recording: words, valid words of each kind, words by status, hashes of both sides' contents, problem, and further measures."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.groupBy("uid").agg(
        F.count("*").alias("words"), F.count_if("audio_valid").alias("audio_valid"), F.count_if("text_valid").alias("text_valid"), *map(count, ("paired", "no_interval", "no_text_tokens", "neither")),
        multiset_digest(vector_line("audio", "audio_valid")).alias("audio_hash"), multiset_digest(vector_line("text", "text_valid")).alias("text_hash"), F.min("problem").alias("problem"), *measures,
    )
