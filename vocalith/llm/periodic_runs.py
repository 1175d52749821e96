"""Periodic runs of words by maximal pairs.

A run with period q that starts at word s and is n words long is a maximal pair of words' suffixes (s, s + q): they agree for exactly n - q
words, and the words before them differ. Each text's suffixes that share four words with another are sorted by doubled ranks; what neighbours in
that order have in common gives the LCP-interval tree, which is built bottom-up. A node keeps its places in text order, each with the word to
its left as its class. Where two lists of a node come together, each place of the shorter one is held against the places
of the longer one next to it: a pair of two classes is maximal, its common prefix is the node's depth, and if its distance q is no greater than that
(and distance and prefix make 12 words) it is a run; nothing has to be extended. No other pairs are needed: had the start of a run's second period a place of
the node between it and the run's start, the run would have a smaller period. Pairs at multiples of a period have the same
start and end; the least distance is the period.

Lists are joined shorter into longer, so a text of n words takes O(n log n) comparisons. A text is one task's; texts are not brought together, so nothing is shuffled.

Defined results: null and blank texts have no words and no runs; a null id has no h, so its words stay as they are; repeated rows give
repeated rows; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vocalith.llm.common import small_batches, table

LEAST_LENGTH = 12
#: Suffixes that share fewer words with every other can't be in a run: the common prefix is at least half of the least length.
SHARED = 4


def suffix_levels(codes: np.ndarray, shared: int = SHARED) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes that have `shared` words in common with another one, in order, and the ranks by which they were told apart.

    A level (h, rank) ranks suffixes by their first h words; equal ranks mean h equal words. Only suffixes that are still alike are sorted again.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    fresh = np.r_[True, codes[order][1:] != codes[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, h, kept = [(1, rank)], 1, None
    active = _alike(order, fresh)
    while len(active):
        second = np.zeros(len(active), np.int64)
        inside = active + h < n
        second[inside] = rank[active[inside] + h] + 1
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        first = rank[active]
        group = np.r_[True, first[1:] != first[:-1]]
        fresh = group | np.r_[True, second[1:] != second[:-1]]
        at = np.arange(len(active))
        rank = rank.copy()
        rank[active] = first + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        h *= 2
        levels.append((h, rank))
        active = _alike(active, fresh)
        if h == shared:
            kept = active
    if kept is None or not len(kept):
        return np.empty(0, np.int64), levels
    return kept[np.argsort(rank[kept], kind="stable")], levels


def _alike(order: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Those of `order` whose group, which begins where `fresh` is, has several members."""
    single = fresh & np.r_[fresh[1:], True]
    return order[~single]


def common_prefixes(order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """How many words each suffix of `order` has in common with the next one."""
    i, j = order[:-1].copy(), order[1:].copy()
    length = np.zeros(len(i), np.int64)
    for h, rank in reversed(levels):
        n = len(rank)
        inside = (i < n) & (j < n)
        same = inside & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
        i[same] += h
        j[same] += h
        length[same] += h
    return length


def find_runs(codes: np.ndarray, least: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `least` symbols and two periods, in that order."""
    if len(codes) < least:
        return []
    order, levels = suffix_levels(codes)
    if not len(order):
        return []
    prefix = common_prefixes(order, levels)
    ranks = np.flatnonzero(prefix >= (least + 1) // 2)
    if not len(ranks):
        return []
    left = np.r_[-1, codes[:-1]].tolist()
    places = order.tolist()
    # nodes from the deepest up; a node joins the lists on both sides of one gap of the order at a time
    depths = prefix[ranks]
    by_depth = np.argsort(-depths, kind="stable")
    parent: dict[int, int] = {}
    lists: dict[int, list[int]] = {}
    found: dict[tuple[int, int], int] = {}

    def list_of(k: int) -> int:
        root = k
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(k, k) != root:
            parent[k], k = root, parent[k]
        if root not in lists:
            lists[root] = [places[root]]
        return root

    for k, depth in zip(ranks[by_depth].tolist(), depths[by_depth].tolist()):
        a, b = list_of(k), list_of(k + 1)
        if len(lists[a]) < len(lists[b]):
            a, b = b, a
        large, small = lists[a], lists.pop(b)
        parent[b] = a
        for p in small:
            at = bisect_left(large, p)
            for q in large[max(at - 1, 0) : at + 1]:
                i, j = (p, q) if p < q else (q, p)
                distance = j - i
                if distance <= depth and distance + depth >= least and left[i] != left[j]:
                    run = (i, j + depth)
                    if found.get(run, distance) >= distance:
                        found[run] = distance
        # joined at the ends in one go, else one by one
        if small[0] > large[-1]:
            large.extend(small)
        else:
            for p in small:
                large.insert(bisect_left(large, p), p)
    return sorted((i, end - i, q) for (i, end), q in found.items())


def repeated_tail(n: int, h: int) -> tuple[int, int]:
    """(first word, period) of the tail that a document of n > 0 words gets under the contract."""
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def run_report(words: list[bytes]) -> tuple:
    """n_runs, the longest run's start, length, period and exponent_milli, and both digests."""
    numbers: dict[bytes, int] = {}
    runs = find_runs(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64))
    if not runs:
        return 0, None, None, None, None, _digest(b""), _digest(b" ".join(words))
    cover = np.zeros(len(words) + 1, np.int64)
    starts, lengths, periods = np.array(runs, np.int64).T
    np.add.at(cover, starts + periods, 1)
    np.add.at(cover, starts + lengths, -1)
    dropped = (np.cumsum(cover) > 0).tolist()
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return len(runs), start, length, period, 1000 * length // period, _digest(listed.encode()), _digest(b" ".join(w for w, d in zip(words, dropped) if not d))


RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def collapse_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail_hash=None) -> DataFrame:
    """One row per input row: id and what `run_report` says of its words.

    tail_hash: where given, maps an id to h, or to None; every tenth h makes the tail of the text periodic (`repeated_tail`) first. No shuffle; reads two columns.
    """
    small_batches(df.sparkSession)

    def over(batches):
        for batch in batches:
            ids = batch.column(0)
            rows = []
            for i, text in zip(ids.to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                h = tail_hash(i) if tail_hash and i is not None else None
                if h is not None and h % 10 == 0 and words:
                    a, p = repeated_tail(len(words), h)
                    words = words[:a] + [words[a + k % p] for k in range(len(words) - a)]
                rows.append(run_report(words))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[id_col, *(x.split()[0] for x in RESULT.split(", "))])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(over, f"`{id_col}` {kind}, {RESULT}")


def decimal_crc32(value: int) -> int:
    return zlib.crc32(str(value).encode())


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(table(spark, sf_dir, "documents"), tail_hash=decimal_crc32)


QUERIES = {"op13_periodic_runs": (op13_periodic_runs, None)}
