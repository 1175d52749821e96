"""LM scoring with a weighted backoff automaton.

The model is a trigram model over the training documents, smoothed recursively:

    p1(w) = (c(w) + 1) / (N + V + 1)
    p2(w | v) = (c(v w) + K p1(w)) / (c(v) + K)
    p3(w | u v) = (c(u v w) + K p2(w | v)) / (c(u v) + K)

As an automaton: states are the empty history, words (and the start of a text), and pairs of words that occur in training. A state has an arc for each
n-gram that continues it, with weight log10 p and the longest history that the arc's word ends as its target; and a failure arc to the history without
its first word, with weight log10(K / (c(history) + K)). A text is scored in one traversal from left to right which carries the state: the word's arc is taken, or
failure arcs are followed until there is one (the empty history has an arc for every word), and the weights are added up.

The model grows with the corpus, so it is neither broadcast nor collected. Documents are put in blocks of bounded size. A block
files the distinct n-grams it needs, with its own training counts, in pages by hash; a bucket adds up the counts of equal
n-grams over all blocks and answers each page with the totals in the page's order; the block's part of the automaton is
built from the answers, and its texts are traversed. Keys are hashes of n-grams, 64 bits for words and 54 for others (sorted within a page, so that their differences are
filed), so a frequent n-gram is one entry for each block, and a frequent history's n-grams are spread over the buckets. Long texts are traversed in pieces side
by side: a piece starts in the state that the two words before it lead to, which is all that a state remembers.

Buckets grow with the input but stop where a block's page would hold fewer than `PAGE_GRAMS` n-grams; beyond that (some TB) raise `block_bytes`.

Defined results: null, empty and blank texts are the end token alone; a null id counts as empty text for the held-out choice; repeated
rows each count and score; an empty training set leaves N = V = 0, and an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vocalith.llm.common import materialize, small_batches, table
from vocalith.llm.repeats import mix

BLOCK_BYTES = 4 << 20
PAGE_GRAMS = 64
ORDER = 3
#: Weight of the shorter history's distribution in a longer one's.
K = 4.0
#: Low bits that the hashes of pairs and triples go without in pages: of 10**10 n-grams one in a million then shares its key with another. Words keep all.
DROPPED_BITS = 10
#: Words that one lane of the traversal reads.
LANE = 1024
FOLDS, HELD_OUT = 7, 2
END, START = 0, 1  # local codes of the end token and the start of a text
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def _blocks(id_type: pa.DataType, block_bytes: int):
    """(id, text) -> (block, page): a block's rows as a compressed Arrow stream."""

    def page(ids: list, texts: list) -> bytes:
        sink = io.BytesIO()
        rows = pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(texts, pa.large_binary())], names=["id", "text"])
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(rows)
        return sink.getvalue()

    def over(batches):
        task, k, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass").translate(_LOWER)
                ids.append(i)
                texts.append(raw)
                size += len(raw) + 16
                if size >= block_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + k]), pa.array([page(ids, texts)], pa.binary())], names=["block", "page"])
                    k, ids, texts, size = k + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + k]), pa.array([page(ids, texts)], pa.binary())], names=["block", "page"])

    return over


class Block:
    """A block's tokens, and its distinct n-grams in the order of their hashes.

    `grams[n]` are the hashes and training counts of the (n + 1)-grams, `names[n]` their names: a word's code, or prefix * words + word with the prefix's place
    among the names of the n-grams (a pair's first word is a code).
    """

    def __init__(self, page: bytes) -> None:
        rows = pa.ipc.open_stream(page).read_all()
        self.ids = rows.column("id").to_pylist()
        self.test = np.array([held_out(i) for i in self.ids], bool)
        local: dict[bytes, int] = {}
        docs = []
        for raw in rows.column("text").to_pylist():
            codes = [local.setdefault(w, len(local) + 2) for w in raw.split()]
            codes.append(END)
            docs.append(np.array(codes, np.int64))
        self.length = np.array([len(d) for d in docs], np.int64)
        self.tokens = np.concatenate(docs)
        self.first = np.cumsum(self.length) - self.length
        before = np.r_[np.int64(START), self.tokens[:-1]]
        before[self.first] = START
        train = np.repeat(~self.test, self.length)
        # word codes in the order of their hashes; END and START have fixed ones
        hashes = np.array([1, 2, *(xxhash.xxh3_64_intdigest(w) for w in local)], np.uint64)
        self.words = len(hashes)
        count = np.bincount(self.tokens[train], minlength=self.words)
        count[START] = int((~self.test).sum())
        pairs, pair_of, pair_count = _counted(before * self.words + self.tokens, train)
        inner = np.ones(len(self.tokens), bool)
        inner[self.first] = False
        at = np.flatnonzero(inner)
        triples, _, triple_count = _counted(pair_of[at - 1] * self.words + self.tokens[at], train[at])
        self.names = [np.arange(self.words), pairs, triples]
        pair_hash = mix(hashes[pairs // self.words] * _ODD + mix(hashes[pairs % self.words] + np.uint64(7)))
        triple_hash = mix(pair_hash[triples // self.words] * _ODD + mix(hashes[triples % self.words] + np.uint64(11)))
        pair_hash, triple_hash = (h >> np.uint64(DROPPED_BITS) << np.uint64(DROPPED_BITS) for h in (pair_hash, triple_hash))
        self.orders = [np.argsort(h) for h in (hashes, pair_hash, triple_hash)]
        self.grams = [(h[o], c[o]) for h, o, c in zip((hashes, pair_hash, triple_hash), self.orders, (count, pair_count, triple_count))]

    def cuts(self, n: int, buckets: int) -> np.ndarray:
        """Where the buckets' ranges of hashes begin and end in the order of the n-grams."""
        bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
        return np.r_[0, np.searchsorted(self.grams[n][0], bounds), len(self.grams[n][0])]


def _counted(names: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names in order, each one's place, and how often they stand in training texts."""
    distinct, place = np.unique(names, return_inverse=True)
    return distinct, place, np.bincount(place[train], minlength=len(distinct))


_ZSTD = pa.Codec("zstd", compression_level=1)


def _squeeze(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers below 2**64, byte plane by byte plane."""
    raw = b"".join(np.ascontiguousarray(c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unsqueeze(page: bytes, sizes: list[int]) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(_ZSTD.decompress(page[8:], int.from_bytes(page[:8], "little"), asbytes=True), np.uint8), 0, []
    for n in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 8 * n].reshape(8, n).T).view(np.uint64).reshape(-1))
        at += 8 * n
    return out


def _file(buckets: int):
    """(block, page) -> (bucket, block, keys and counts of its n-grams)."""

    def over(batches):
        for batch in batches:
            for number, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = Block(page)
                cuts = [block.cuts(n, buckets) for n in range(ORDER)]
                keys, pages = [], []
                for b in range(buckets):
                    columns = []
                    for n in range(ORDER):
                        hashes, counts = (x[cuts[n][b] : cuts[n][b + 1]] for x in block.grams[n])
                        columns += [np.diff(hashes, prepend=np.uint64(0)) >> np.uint64(DROPPED_BITS if n else 0), counts]
                    sizes = np.array([len(c) for c in columns[::2]], np.int64)
                    if sizes.any():
                        keys.append(b)
                        pages.append(sizes.tobytes() + _squeeze(columns))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([number] * len(keys), pa.int64()), pa.array(pages, pa.binary())], names=["bucket", "block", "page"])

    return over


ANSWERS = "block long, bucket int, answer binary, tokens long, types long"


def _add_up(group: pa.Table) -> pa.Table:
    """A bucket's pages -> for each page the totals in its order; tokens and types of the bucket's unigrams, once."""
    read = []
    for page in group.column("page").to_pylist():
        sizes = np.frombuffer(page, np.int64, ORDER).tolist()
        read.append(_unsqueeze(page[8 * ORDER :], [n for n in sizes for _ in (0, 1)]))
    answers, tokens, types = [[] for _ in read], 0, 0
    for n in range(ORDER):
        every, which = np.unique(np.concatenate([np.cumsum(columns[2 * n], dtype=np.uint64) for columns in read]), return_inverse=True)
        total = np.bincount(which, np.concatenate([columns[2 * n + 1] for columns in read]).astype(np.int64), len(every)).astype(np.int64)
        if n == 0:
            real = total[every != START + 1]
            tokens, types = int(real.sum()), int((real > 0).sum())
        for answer, part in zip(answers, np.split(total[which], np.cumsum([len(columns[2 * n]) for columns in read])[:-1])):
            answer.append(part)
    once = [1] + [0] * (len(read) - 1)
    return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "answer": pa.array(list(map(_squeeze, answers)), pa.binary()), "tokens": pa.array([tokens * x for x in once], pa.int64()), "types": pa.array([types * x for x in once], pa.int64())})


class BackoffAutomaton:
    """States: 0 the empty history, 1 + code the words, then the pairs that occur in training. counts: totals of words, pairs and triples in the order of
    the block's names."""

    def __init__(self, block: Block, counts: list[np.ndarray], n: int, v: int) -> None:
        words = self.words = block.words
        count, pair_count, triple_count = counts
        pairs, triples = block.names[1], block.names[2]
        self.count = count
        unigram = (count + 1) / (n + v + 1)
        seen = pair_count > 0
        bigram = (pair_count + K * unigram[pairs % words]) / (count[pairs // words] + K)
        #: the state of each pair; a pair that never occurs in training is no history, and its last word, or nothing, is what is left
        word_state = np.where(count > 0, np.arange(1, words + 1), 0)
        state_of = word_state[pairs % words]
        state_of[seen] = 1 + words + np.arange(int(seen.sum()))
        # arcs, sorted by (state, word)
        kept = triple_count > 0
        prefix, last = triples[kept] // words, triples[kept] % words
        at = np.searchsorted(pairs, pairs[prefix] % words * words + last)  # the pair of the triple's last two words
        trigram = (triple_count[kept] + K * bigram[at]) / (pair_count[prefix] + K)
        self.arc_key = np.r_[(1 + pairs[seen] // words) * words + pairs[seen] % words, state_of[prefix] * words + last]
        self.arc_weight = np.log10(np.r_[bigram[seen], trigram])
        self.arc_target = np.r_[state_of[seen], state_of[at]]
        order = np.argsort(self.arc_key)
        self.arc_key, self.arc_weight, self.arc_target = self.arc_key[order], self.arc_weight[order], self.arc_target[order]
        self.root_weight, self.root_target = np.log10(unigram), word_state
        self.failure_weight = np.log10(K / (np.r_[0, count, pair_count[seen]] + K))
        self.failure = np.r_[0, np.zeros(words, np.int64), 1 + pairs[seen] % words]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word in each lane -> (weights, next states)."""
        weight, target = np.zeros(len(state)), np.empty(len(state), np.int64)
        lanes, at = np.arange(len(state)), state
        while len(lanes):
            key = at * self.words + word[lanes]
            place = np.minimum(np.searchsorted(self.arc_key, key), max(len(self.arc_key) - 1, 0))
            hit = (self.arc_key[place] == key) & (at > 0) if len(self.arc_key) else np.zeros(len(at), bool)
            weight[lanes[hit]] += self.arc_weight[place[hit]]
            target[lanes[hit]] = self.arc_target[place[hit]]
            root = at == 0
            weight[lanes[root]] += self.root_weight[word[lanes[root]]]
            target[lanes[root]] = self.root_target[word[lanes[root]]]
            left = ~hit & ~root
            weight[lanes[left]] += self.failure_weight[at[left]]
            lanes, at = lanes[left], self.failure[at[left]]
        return weight, target


def traverse(block: Block, automaton: BackoffAutomaton, lane: int) -> np.ndarray:
    """Log10 probabilities of the block's texts: all lanes read their next word together."""
    lanes_of = -(-block.length // lane)
    doc = np.repeat(np.arange(len(block.length)), lanes_of)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
    begin = block.first[doc] + piece * lane
    end = np.minimum(begin + lane, (block.first + block.length)[doc])
    start = 1 + START if automaton.count[START] else 0
    state = np.full(len(doc), start, np.int64)
    for back in (2, 1):  # a piece's state is what the two words before it lead to, from the start of the text or from the empty history
        some = np.flatnonzero(piece > 0)
        if back == 2:
            state[some] = np.where(begin[some] - 2 == block.first[doc[some]], start, 0)
        state[some] = automaton.step(state[some], block.tokens[begin[some] - back])[1] if len(some) else state[some]
    order = np.argsort(begin - end, kind="stable")  # the longest first
    begin, state, size = begin[order], state[order], (end - begin)[order]
    score = np.zeros(len(begin))
    for k in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -k, side="left"))
        weight, state[:live] = automaton.step(state[:live], block.tokens[begin[:live] + k])
        score[:live] += weight
    return np.bincount(doc[order], score, len(block.length))


SCORES = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(buckets: int, n: int, v: int, id_type: pa.DataType, lane: int):
    def over(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.column("page")[0].as_py())
        cuts = [block.cuts(k, buckets) for k in range(ORDER)]
        count = [np.zeros(len(g[0]), np.int64) for g in block.grams]
        for b, answer in zip(right.column("bucket").to_pylist(), right.column("answer").to_pylist()):
            spans = [slice(cuts[k][b], cuts[k][b + 1]) for k in range(ORDER)]
            for k, got in enumerate(_unsqueeze(answer, [s.stop - s.start for s in spans])):
                count[k][spans[k]] = got
        totals = [np.empty_like(c) for c in count]
        for k in range(ORDER):
            totals[k][block.orders[k]] = count[k]
        automaton = BackoffAutomaton(block, totals, n, v)
        known = np.add.reduceat((totals[0][block.tokens] > 0).astype(np.int64), block.first)
        base = np.add.reduceat(automaton.root_weight[block.tokens], block.first)
        m = len(block.ids)
        return pa.table({"id": pa.array(block.ids, id_type), "held_out": pa.array(block.test), "n_tokens": pa.array(block.length), "n_known": pa.array(known), "train_tokens": pa.array([n] * m, pa.int64()), "base_score": pa.array(base), "score": pa.array(traverse(block, automaton, lane))})

    return over


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, lane: int = LANE) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = df.sparkSession
    small_batches(spark)
    id_kind = df.schema[id_col].dataType
    arrow_kind = to_arrow_type(id_kind)
    cut = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    buckets = max(8, min(4 * df.rdd.getNumPartitions(), block_bytes // 4 // PAGE_GRAMS))  # some n-gram for every 4 bytes
    blocks = materialize(cut.mapInArrow(_blocks(arrow_kind, block_bytes), "block long, page binary"), "blocks")
    pages = blocks.mapInArrow(_file(buckets), "bucket int, block long, page binary")
    answers = materialize(pages.groupBy("bucket").applyInArrow(_add_up, ANSWERS), "answers")
    n, v = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(buckets, n, v, arrow_kind, lane), f"id {id_kind.simpleString()}, {SCORES}")
    return scored.withColumnRenamed("id", id_col)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op3_lm_scores": (op3_lm_scores, None)}
