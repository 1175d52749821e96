"""Operators that carry state along a recording's words. Words come sorted by (uid, word_id), so a task holds a batch and one state, never a whole recording."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.sources.storage import sound_unions

_LEXICAL = regex.compile(r"[\p{L}\p{N}]")


class Packer:
    """Whole words, greedily, into chunks of at most `capacity`; a word above it has no chunk."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.chunk, self.used = capacity, 0, 0

    def place(self, cost: int) -> int | None:
        if cost > self.capacity:
            return None
        if self.used + cost > self.capacity:
            self.chunk, self.used = self.chunk + 1, 0
        self.used += cost
        return self.chunk


class Matcher:
    """Finds words in a text one after another, without regard to case."""

    def __init__(self, text: str) -> None:
        self.text, self.low, self.cursor = text, text.lower(), 0

    def find(self, word: str) -> tuple[int, bool, bool]:
        """(place from 1, or 0 if it is missing; spelt in another case; letters or digits lie before it)."""
        at = self.low.find(word.lower(), self.cursor)
        if at < 0:
            return 0, False, False
        recased, skipped = self.text[at : at + len(word)] != word, _LEXICAL.search(self.text[self.cursor : at]) is not None
        self.cursor = at + len(word)
        return at + 1, recased, skipped


def _sorted(words: DataFrame) -> DataFrame:
    return words.repartition("uid").sortWithinPartitions("uid", "word_id")


def word_chunks(words: DataFrame, cost: str, capacity: int) -> DataFrame:
    """(uid, word_id, chunk): whole words packed greedily into chunks of at most `capacity`; chunk is null for a word above it (a violation)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uid = packer = None
        for batch in batches:
            chunks = []
            for u, c in zip(batch["uid"], batch["cost"]):
                if packer is None or u != uid:
                    uid, packer = u, Packer(capacity)
                chunks.append(packer.place(c))
            yield batch[["uid", "word_id"]].assign(chunk=pd.array(chunks, "Int32"))

    kinds = dict(words.dtypes)
    return _sorted(words.select("uid", "word_id", F.col(cost).cast("long").alias("cost"))).mapInPandas(pack, f"uid {kinds['uid']}, word_id {kinds['word_id']}, chunk int")


def match_words(transcripts: DataFrame, words: DataFrame) -> DataFrame:
    """(uid, word_id, at, recased, skipped): each word's place in its transcript, found in order without regard to case.

    at is 0 where it is missing; recased: the transcript spells it in another case; skipped: letters or digits lie between it and the word before.
    A transcript comes as one row before its words, so its text is not repeated for each of them.
    """

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uid = matcher = None
        for batch in batches:
            out = []
            for u, k, text in zip(batch["uid"], batch["word_id"], batch["text"]):
                if k < 0:
                    uid, matcher = u, Matcher(text or "")
                elif u == uid:
                    out.append((u, k, *matcher.find(text)))
            yield pd.DataFrame(out, columns=["uid", "word_id", "at", "recased", "skipped"])

    kinds = dict(words.dtypes)
    sound_unions(transcripts.sparkSession)
    both = transcripts.select("uid", F.lit(-1).cast(kinds["word_id"]).alias("word_id"), "text").unionByName(words.select("uid", "word_id", F.col("word").alias("text")))
    return _sorted(both).mapInPandas(match, f"uid {kinds['uid']}, word_id {kinds['word_id']}, at int, recased boolean, skipped boolean")
