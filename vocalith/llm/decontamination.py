"""Benchmark decontamination by a generalised suffix automaton of the test items.

The normalised items go into automata of bounded size (larger benchmarks are cut into several by items), which are built in tasks
and broadcast a bounded number at a time. Each document's words are streamed through it, and the longest
matching length is tracked: wherever it reaches the window length, the last words are a window of the items whose ids the
state holds. Matched spans give the hit words; a document is contaminated if they cover enough of it.

Defined results: null, empty and punctuation-only texts have no words and are clean; null items and items without words
are skipped; items that repeat count by id; repeated rows give repeated rows; an empty
benchmark leaves every text clean; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm.automata import SuffixAutomaton
from vocalith.llm.common import fresh, materialize, small_batches, table

WINDOW = 13
#: Item words in one automaton; its broadcast is at most some 30 MB.
AUTOMATON_WORDS = 200_000
#: Automata that are broadcast, and held by a Python worker, at a time.
SHARDS_PER_PASS = 4
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


class ItemIndex:
    """The automaton of some items, with the items of each state's windows."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int) -> None:
        self.window, self.vocabulary, self.automaton = window, {}, SuffixAutomaton()
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for i, words in items if words]
        for _, seq in coded:
            self.automaton.add(seq)
        auto = self.automaton
        self.shortest = min([window, *(len(s) for _, s in coded)])
        #: whole items shorter than a window, by state: (length, item)
        self.whole: dict[int, list[tuple[int, str]]] = {}
        owners: dict[int, set[str]] = {}
        for item, seq in coded:
            for at, (s, n) in enumerate(auto.matching(seq)):
                if n >= window:
                    owners.setdefault(self._window_state(s), set()).add(item)
                elif at + 1 == len(seq) and len(seq) < window:
                    self.whole.setdefault(s, []).append((n, item))
        self.owners = {s: frozenset(x) for s, x in owners.items()}
        #: for each state, the short items that end there: its own and those of its suffix links
        self.ends: dict[int, list[tuple[int, str]]] = {}
        for s in auto.by_length() if self.whole else []:
            mine = self.whole.get(s, []) + self.ends.get(auto.link[s], [])
            if mine:
                self.ends[s] = mine

    def _window_state(self, s: int) -> int:
        """The state of the last `window` words of a longer match."""
        auto = self.automaton
        while auto.length[auto.link[s]] >= self.window:
            s = auto.link[s]
        return s

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans [start, end) in order of their ends, and the items with an occurring window."""
        codes = list(map(self.vocabulary.get, words))
        spans, items, n, window = [], set(), len(codes), self.window
        at = 0
        while at < n:
            if codes[at] is None:
                at += 1
                continue
            end = at + 1
            while end < n and codes[end] is not None:
                end += 1
            if end - at >= self.shortest:
                for k, (s, m) in enumerate(self.automaton.matching(codes[at:end]), at + 1):
                    if m >= window:
                        spans.append((k - window, k))
                        items |= self.owners[self._window_state(s)]
                    if self.ends:
                        for length, item in self.ends.get(s, ()):
                            if length <= m:
                                spans.append((k - length, k))
                                items.add(item)
            at = end
        return spans, items


@lru_cache(maxsize=SHARDS_PER_PASS)
def _index_of(built: bytes) -> ItemIndex:
    return pickle.loads(built)


def _covered(spans: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def built_shards(items: DataFrame, id_col: str, text_col: str, window: int, limit: int = AUTOMATON_WORDS) -> DataFrame:
    """One row for each group of some `limit` item words: the group's automaton, built in a task and pickled. Groups are by hash of the item's id and text."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    (words,) = rows.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))), F.lit(0))).first()
    groups = max(1, -(-int(words) // limit))

    def build(group: pa.Table) -> pa.Table:
        coded = sorted((i, words_of(t)) for i, t in zip(group.column("item").to_pylist(), group.column("text").to_pylist()))
        return pa.table({"built": pa.array([pickle.dumps(ItemIndex(coded, window), 5)], pa.binary())})

    grouped = rows.where("text IS NOT NULL").withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(groups)).cast("int"))
    return materialize(grouped.select("shard", "item", "text").groupBy("shard").applyInArrow(build, "built binary"), "automata")


def _passes(shards: DataFrame, size: int):
    """Groups of so many built automata, one group on the driver at a time."""
    held = []
    for (built,) in shards.toLocalIterator():
        held.append(bytes(built))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


VERDICT = "struct<n_words:long,n_hit:long,n_items:long,items_sha256:string,contaminated:boolean>"


def _verdict(words: list[int], spans: list[list], items: list[set], share: int) -> pa.Array:
    hit = [_covered(s) for s in spans]
    digest = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
    columns = [pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 and share * h >= n for h, n in zip(hit, words)], pa.bool_())]
    return pa.StructArray.from_arrays(columns, names=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _scan_all(texts: list[str | None], automata: list[bytes]) -> tuple[list[int], list[list], list[set]]:
    words = [words_of(t) for t in texts]
    spans, items = [[] for _ in words], [set() for _ in words]
    for built in automata:
        index = _index_of(built)
        for k, w in enumerate(words):
            s, i = index.scan(w)
            spans[k] += s
            items[k] |= i
    return [len(w) for w in words], spans, items


def _scanner(automata: list):
    """The UDF of one pass over broadcast automata."""

    @F.arrow_udf("struct<spans:array<struct<a:int,b:int>>,items:array<string>>")
    def scan(texts: pa.Array) -> pa.Array:
        _, spans, found = _scan_all(texts.to_pylist(), [a.value for a in automata])
        pairs = pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        return pa.StructArray.from_arrays([pairs, pa.array([sorted(i) for i in found], pa.list_(pa.string()))], names=["spans", "items"])

    return scan


def mark_contamination(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20, out: str = "found", limit: int = AUTOMATON_WORDS) -> DataFrame:
    """df with a struct column `out`: n_words, n_hit, n_items, items_sha256, contaminated.

    At most SHARDS_PER_PASS automata are broadcast at a time. A benchmark that fits them costs one pass and no shuffle. A larger one costs a pass for each group, which writes the
    spans and items of the texts that have any (by the text's hash); they are put together in the end.
    """
    small_batches(df.sparkSession)
    context = df.sparkSession.sparkContext
    shards = built_shards(items, item_id, item_text, window, limit)
    if shards.count() <= SHARDS_PER_PASS:
        automata = [context.broadcast(built) for group in _passes(shards, SHARDS_PER_PASS) for built in group]

        @F.arrow_udf(VERDICT)
        def mark(texts: pa.Array) -> pa.Array:
            return _verdict(*_scan_all(texts.to_pylist(), [a.value for a in automata]), share)

        return df.withColumn(out, mark(F.col(text_col)))

    parts = []
    keyed = df.select(F.sha2(F.col(text_col), 256).alias("key"), F.col(text_col).alias("text"))
    for group in _passes(shards, SHARDS_PER_PASS):
        sent = [context.broadcast(built) for built in group]

        hits = keyed.select("key", _scanner(sent).asNondeterministic()(F.col("text")).alias("h")).where(F.size("h.items") > 0)
        parts.append(materialize(hits.groupBy("key").agg(F.first("h").alias("h")), "hits"))
        for broadcast in sent:
            broadcast.unpersist()
    key, found, other = (fresh(df, stem) for stem in ("key__", "hits__", "other__"))
    every = reduce(DataFrame.unionByName, parts).groupBy(F.col("key").alias(other)).agg(F.flatten(F.collect_list("h.spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("h.items"))).alias("items"))

    @F.arrow_udf(VERDICT)
    def merge(texts: pa.Array, hits: pa.Array) -> pa.Array:
        rows = hits.to_pylist()
        return _verdict([len(words_of(t)) for t in texts.to_pylist()], [[(x["a"], x["b"]) for x in h["spans"] or []] if h else [] for h in rows], [set(h["items"] or []) if h else set() for h in rows], share)

    joined = df.withColumn(key, F.sha2(F.col(text_col), 256)).join(every.select(other, F.struct("spans", "items").alias(found)), F.col(key) == F.col(other), "left")
    return joined.withColumn(out, merge(F.col(text_col), F.col(found))).select(*df.columns, out)


def drop_contaminated(df: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that are not contaminated; same columns."""
    out = fresh(df, "found__")
    return mark_contamination(df, items, text_col, out=out).where(~F.col(out)["contaminated"]).select(*df.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "found.*")


_ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT r, i, dw.m AS m, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
hw AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM hit)) GROUP BY r),
hi AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(hi.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(hw.n, 0) > 0 AND 20 * coalesce(hw.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
QUERIES = {"op4_decontamination": (op4_decontamination, _ORACLE)}
