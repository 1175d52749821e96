"""Nested documents made flat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def absolute_times(df: DataFrame) -> DataFrame:
    """(uid, window_start, segments ARRAY<ARRAY<STRUCT<word_id, word, start, end, probability>>>) -> one row a word with times in the recording and the probability
    as confidence."""
    words = F.transform(F.flatten("segments"), lambda w: F.struct(w["word_id"].alias("word_id"), w["word"].alias("word"), (w["start"] + F.col("window_start")).alias("start"), (w["end"] + F.col("window_start")).alias("end"), w["probability"].alias("confidence")))
    return df.select("uid", F.inline(words))
