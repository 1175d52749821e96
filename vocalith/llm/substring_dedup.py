"""Substring dedup by suffix automata of reference shards.

The reference of a text is every text of a smaller id. It is cut into shards by content, not by documents: what `repeats`
brings together for one bucket are all contexts whose windows can be equal, and they are the bucket's reference shard.
A suffix automaton is built of each shard, with the least id of every state; the shard's texts are streamed
through it for matching statistics, and where the match is at least a window long and its state was seen in a smaller id, the window
goes. Maximal spans above the threshold are the unions of such windows. The reference is the corpus itself, so the automata
are not broadcast (they have no bound): texts are sent to them instead.

Defined results: null, empty and blank texts have no words; ties of ids: rows that share an id do not repeat each other; a null id comes
last; repeated rows get the same result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm.automata import SuffixAutomaton
from vocalith.llm.common import table
from vocalith.llm.repeats import Scheme, merged, repeated_spans

WINDOW = 13


class _Codes(dict):
    """Word -> 64-bit code; emptied before it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_CODES = _Codes()


def word_units(raw: bytes) -> np.ndarray:
    words = raw.split()
    return np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))


def match_shard(docs: np.ndarray, starts: np.ndarray, codes: np.ndarray, ends: np.ndarray, window: int, by_position: bool) -> np.ndarray:
    """Which windows of the shard's contexts were seen in a smaller id."""
    _, dense = np.unique(codes, return_inverse=True)
    dense, begins = dense.tolist(), np.r_[0, ends[:-1]].tolist()
    auto = SuffixAutomaton()
    texts = [dense[a:b] for a, b in zip(begins, ends.tolist())]
    for text in dict.fromkeys(map(tuple, texts)):
        auto.add(text)
    least = [None] * len(auto.length)
    ids = docs.tolist()
    ways = []
    for doc, text in zip(ids, texts):
        way = [s for s, _ in auto.matching(text)]
        ways.append(way)
        for s in way[window - 1 :]:
            if least[s] is None or doc < least[s]:
                least[s] = doc
    link, length = auto.link, auto.length
    for s in reversed(auto.by_length()):
        p = link[s]
        if least[s] is not None and length[p] >= window and (least[p] is None or least[s] < least[p]):
            least[p] = least[s]
    flags = np.zeros(len(codes), bool)
    for doc, begin, way in zip(ids, begins, ways):
        for k in range(window - 1, len(way)):
            s = way[k]
            while length[link[s]] >= window:
                s = link[s]
            if least[s] < doc:
                flags[begin + k - window + 1] = True
    return flags


SCHEME = Scheme(window=WINDOW, gram=5, by_position=False, units=word_units, resolve=match_shard, batch=1 << 16)


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    rows = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist()):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        n, kept, end, gone = len(words), [], 0, 0
        for a, b in merged(found, n):
            kept += words[end:a]
            gone += b - a
            end = b
        kept += words[end:]
        rows.append((n, gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
    n, gone, digest = zip(*rows) if rows else ([], [], [])
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["n_words", "n_removed", "kept_sha256"])


def word_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text and spans (of words, to remove)."""
    return repeated_spans(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), SCHEME)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_repeats(table(spark, sf_dir, "documents"))
    cut = F.arrow_udf(_cut, "struct<n_words:long,n_removed:long,kept_sha256:string>")
    return found.select(F.col("id").alias("doc_id"), cut("text", "spans").alias("r")).select("doc_id", "r.*")


_ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY win) AS m FROM x) WHERE m < doc_id),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM f),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.p) AS t FROM words ANTI JOIN gone ON words.r = gone.r AND words.p = gone.p GROUP BY words.r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""
QUERIES = {"op9_substring_dedup": (op9_substring_dedup, _ORACLE)}
