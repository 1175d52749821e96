"""Suffix-array dedup by merging Burrows-Wheeler transforms.

What `repeats` brings together for one bucket are all contexts whose 100-byte strings can be equal. They are cut into shards; each
shard's suffixes are sorted once, which gives its transform. The transforms are merged by refining their interleave: at first
all rows of shard 0 come before those of shard 1 and so on; each round moves the rows in the order of the two symbols that
precede them, so after h rounds the interleave is sorted by 2 h symbols, while each shard's rows keep their own
order and no suffixes are sorted again. A round also carries the blocks of rows that are alike so far, so rows still in one
block after 50 rounds have a common prefix of 100 bytes: those blocks are the repeated intervals.

Defined results: null texts are empty; texts of under 100 bytes have no strings and stay whole; rows that share an id count as one document,
in which the earlier start wins; a null id comes last; repeated rows get the same result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm.common import table
from vocalith.llm.repeats import Scheme, merged, mix, repeated_spans

WINDOW = 100
SHARDS = 4
#: A code for each byte value.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def byte_units(raw: bytes) -> np.ndarray:
    return BYTE_CODES[np.frombuffer(raw, np.uint8)]


def shard_transform(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """symbols: strings one after another, each with its end mark 0 (ends: the places after the marks), below 256.

    -> (suffix array, transform of pairs: for each suffix the symbol before it, and 256 times the one before that, going round within
    the string). End marks are the least symbols, ordered by string, so all suffixes differ. Ranks are doubled from 7 symbols on.
    """
    n, strings = len(symbols), len(ends)
    begins = np.r_[0, ends[:-1]]
    string = np.repeat(np.arange(strings), ends - begins)
    at, stop = np.arange(n), ends[string]
    padded = np.r_[symbols, np.zeros(7, symbols.dtype)].astype(np.int64)
    rank, inside, size = np.zeros(n, np.int64), np.ones(n, bool), 7
    for j in range(size):
        inside &= at + j < stop
        rank = (rank << 8) + np.where(inside, padded[j : j + n], 0)
    order = np.argsort(rank)
    ranked = rank[order]
    rank[order] = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]])
    while True:
        # suffixes that end within `size` symbols and look alike end at the same place: their strings decide
        second = np.where(at + size < stop, rank[np.minimum(at + size, n - 1)] + strings, string + 1)
        both = rank * (n + strings + 1) + second
        order = np.argsort(both)
        ranked = both[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        rank[order] = np.cumsum(new)
        if new.all():
            break
        size *= 2
    back = np.where(at == begins[string], stop, at) - 1
    pair = symbols[back] + (symbols[back[back]].astype(np.int64) << 8)
    return order, pair[order].astype(np.uint16)


def merge_transforms(transforms: list[np.ndarray], lasts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Pair transforms of shards, and the last symbols of their strings -> (shard, block) of each row of the interleave, refined to `depth` (even)
    symbols.

    A round goes two symbols back at a time. Suffixes that are an end mark, or one symbol and an end mark, are in their final order, by string,
    from the start, and differ from each other.
    """
    if depth % 2:
        raise ValueError("depth must be even")
    flat, n = np.concatenate(transforms), sum(map(len, transforms))
    shard = np.repeat(np.arange(len(transforms)), [len(t) for t in transforms]).astype(np.uint8)
    marks = np.repeat(np.arange(len(lasts)), [len(x) for x in lasts]).astype(np.uint8)
    by_last = np.argsort(np.concatenate(lasts), kind="stable")
    m = len(marks)
    ends_first = marks[by_last]  # of "a$", by a and then by string
    block, row = np.zeros(n, np.int32), np.empty(n, np.int64)
    places = np.arange(n)
    new = np.empty(n, bool)
    fixed = None
    for _ in range(depth // 2):
        row[np.argsort(shard, kind="stable")] = places  # each shard's rows keep their own order
        pair = flat[row]
        move = np.argsort(pair, kind="stable")
        if fixed is None:
            ranked = pair[move]
            fixed = np.flatnonzero((ranked & 255 == 0) & (ranked > 255))
            fresh = np.r_[True, ranked[1:] != ranked[:-1]]
            fresh[: m + 1] = True
            fresh[fixed] = True
            fresh[np.minimum(fixed + 1, n - 1)] = True
        block, shard = block[move], shard[move]
        np.not_equal(block[1:], block[:-1], out=new[1:])
        new |= fresh
        shard[:m] = marks
        shard[fixed] = ends_first
        block = np.cumsum(new, dtype=np.int32)
        if int(block[-1]) == n:
            break
    return shard, block


def repeated_strings(docs: np.ndarray, starts: np.ndarray, codes: np.ndarray, ends: np.ndarray, window: int, by_position: bool) -> np.ndarray:
    """Which strings of `window` bytes of the contexts also start earlier."""
    # contexts are whole texts' bytes, of which UTF-8 has 243 values
    _, octets = np.unique(codes, return_inverse=True)
    begins = np.r_[0, ends[:-1]]
    count = len(ends)
    share = np.array_split(np.arange(count), min(SHARDS, count))
    arrays, transforms, lasts = [], [], []
    for part in share:
        a, b = begins[part[0]], ends[part[-1]]
        sizes = (ends - begins)[part]
        symbols = np.zeros(b - a + len(part), np.uint8)
        own_ends = np.cumsum(sizes + 1)
        text = np.ones(len(symbols), bool)
        text[own_ends - 1] = False
        symbols[text] = octets[a:b] + 1
        order, before = shard_transform(symbols, own_ends)
        back = np.full(len(symbols), -1, np.int64)  # the place in codes, or -1 of end marks
        back[text] = np.arange(a, b)
        arrays.append(back[order])
        transforms.append(before)
        lasts.append(symbols[own_ends - 2])
    shard, block = merge_transforms(transforms, lasts, window)
    place = np.empty(len(shard), np.int64)
    for s, own in enumerate(arrays):
        place[shard == s] = own
    edge = np.r_[True, block[1:] != block[:-1]]
    alike = np.r_[~edge[1:], False] | ~edge
    place, block = place[alike], block[alike]
    string = np.searchsorted(ends, place, side="right")
    start = starts[string] + place - begins[string]
    order = np.lexsort((start, docs[string], block))
    place, block, doc, start = place[order], block[order], docs[string][order], start[order]
    head = np.maximum.accumulate(np.where(np.r_[True, block[1:] != block[:-1]][: len(block)], np.arange(len(block)), 0)) if len(block) else block
    later = (doc > doc[head]) | ((doc == doc[head]) & (start > start[head]))
    flags = np.zeros(len(codes), bool)
    flags[place[later]] = True
    return flags


SCHEME = Scheme(window=WINDOW, gram=32, by_position=True, units=byte_units, resolve=repeated_strings, bytewise=True)


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    rows = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist()):
        raw = (text or "").encode("utf-8", "surrogatepass")
        cuts, end, kept = merged(found, len(raw)), 0, hashlib.sha256()
        for a, b in cuts:
            kept.update(raw[end:a])
            end = b
        kept.update(raw[end:])
        rows.append((len(raw), sum(b - a for a, b in cuts), len(cuts), kept.hexdigest()))
    cols = zip(*rows) if rows else [[]] * 4
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def byte_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text and spans (of bytes, to remove)."""
    return repeated_spans(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), SCHEME)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_repeats(table(spark, sf_dir, "documents"))
    cut = F.arrow_udf(_cut, "struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string>")
    return found.select(F.col("id").alias("doc_id"), cut("text", "spans").alias("r")).select("doc_id", "r.*")


_ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)),
f AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY md5_number(s) ORDER BY doc_id, i) AS k FROM x) WHERE k > 1),
j AS (SELECT r, i, i + 100 AS e, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 100 THEN 1 ELSE 0 END AS n FROM f),
g AS (SELECT r, min(i) AS a, max(e) AS b FROM (SELECT r, i, e, sum(n) OVER (PARTITION BY r ORDER BY i) AS k FROM j) GROUP BY r, k),
c AS (SELECT g.r, a, b, coalesce(lag(b) OVER (PARTITION BY g.r ORDER BY a), 0) AS p FROM g),
t AS (SELECT c.r, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept, sum(b - a) AS gone, count(*) AS n FROM c JOIN d ON d.r = c.r GROUP BY c.r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""
QUERIES = {"op7_suffix_array": (op7_suffix_array, _ORACLE)}
