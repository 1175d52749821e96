"""Finding repeated windows of a corpus: the distributed part that suffix-array and substring dedup share.

A window is W consecutive units (bytes or words) of one text. In every window one gram is the anchor: the
leftmost of those with the least hash. Consecutive windows with the same anchor form a context, and equal windows
have equal anchors, so all copies of a window meet where contexts are grouped by the hash of their anchor:

1. Contexts are filed by anchor, in pages (one packed row for each map task and bucket). Where an anchor has one context only,
   the context's copies need no look at the text: all but the earliest are repeats. Copies within a map task are
   settled there, so a passage in a third of all texts sends one context from each task.
2. Where an anchor has several contexts, one copy of each is fetched with its text, and the operator's own method (`resolve`)
   finds the windows that they share. Where an anchor has more than `hot` contexts (the edge of a very common passage), they are first cut to single windows,
   filed by the anchor and the grams at both ends of the window; what still differs there goes to the method, in a further pass.
3. Repeated spans are gathered by document and applied to the texts.

Page hashes are 48 + 64 bits. Documents are known by id; where ids are shared, and for null ids, also by a 63-bit hash of the text, whose seed is
changed until no two texts of one id share it, so that rows which share an id but not a text keep apart. Ids that are no whole numbers are numbered
in their order; null ids come last. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from vocalith.llm.common import materialize, small_batches
from vocalith.operators.ordering import global_index

CHUNK = 1 << 17  # units hashed at a time, to stay in the CPU's cache
FLUSH = 1 << 19  # contexts held by a map task
HOT = 2000
BATCH_UNITS = 1 << 19  # units that `resolve` gets at a time
NO_ID = np.iinfo(np.int64).max

_POSITION = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: size - width], x[width - size :]) if width > size else x


@dataclass(frozen=True)
class Scheme:
    """units: text -> uint64 codes, one for each unit, alike for equal units. by_position: a repeat may lie in one document, else
    only a document of a smaller id counts. resolve: see `_settle`. bytewise: units are the text's bytes; contexts travel as these, an eighth of their codes."""

    window: int
    gram: int
    by_position: bool
    units: Callable[[bytes], np.ndarray]
    resolve: Callable
    hot: int = HOT
    batch: int = BATCH_UNITS
    bytewise: bool = False


def contexts_of(codes: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """codes: pieces one after another, which end at `ends`. -> (first window, windows, anchor's offset, anchor hash, context hash)."""
    n = len(codes)
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    up, down = _powers(max(n + 1, CHUNK + 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * down[:n], out=sums[1:])
    hashes = mix((sums[gram:] - sums[:-gram]) * up[: n - gram + 1])
    keyed = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_min(keyed, window - gram + 1) & _POSITION).astype(np.int64)
    bad = np.zeros(n + 2, np.int32)
    np.add.at(bad, np.maximum(ends - window + 1, np.r_[0, ends[:-1]]), 1)
    np.add.at(bad, ends, -1)
    at = np.flatnonzero(np.cumsum(bad)[: len(anchor)] == 0)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    a = anchor[at]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (a[1:] != a[:-1])])
    first, last = at[new], at[np.r_[new[1:], len(at)] - 1]
    count = last - first + 1
    context = mix((sums[last + window] - sums[first]) * up[first] + count.astype(np.uint64))
    return first, count, a[new] - first, hashes[a[new]], context


#: A page's columns: id, discriminator, first window, windows, anchor hash, context hash.
_COLUMNS = [("doc", np.int64), ("tag", np.int64), ("start", np.int32), ("count", np.uint8), ("anchor", np.uint64), ("context", np.uint64)]


def _pack(rows: dict[str, np.ndarray]) -> bytes:
    """Column by column, each byte plane by itself: the shuffle's compression takes out the constant ones."""
    parts = []
    for name, kind in _COLUMNS:
        planes = np.ascontiguousarray(rows[name].astype(kind, copy=False)).view(np.uint8).reshape(len(rows["doc"]), -1)
        planes = planes[:, 2:] if name == "anchor" else planes
        parts.append(np.ascontiguousarray(planes.T).tobytes())
    return b"".join(parts)


def _unpack(pages: list[bytes]) -> dict[str, np.ndarray]:
    size = sum(np.dtype(k).itemsize for _, k in _COLUMNS) - 2
    out: dict[str, list] = {name: [] for name, _ in _COLUMNS}
    for page in pages:
        n, at = len(page) // size, 0
        for name, kind in _COLUMNS:
            width = np.dtype(kind).itemsize - 2 * (name == "anchor")
            planes = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
            planes[:, -width:] = np.frombuffer(page, np.uint8, n * width, at).reshape(width, n).T
            out[name].append(planes.reshape(-1).view(kind))
            at += n * width
    return {name: np.concatenate(x) if x else np.zeros(0, kind) for (name, kind), x in zip(_COLUMNS, out.values())}


def _take(rows: dict[str, np.ndarray], which) -> dict[str, np.ndarray]:
    return {k: v[which] for k, v in rows.items()}


def _ranked(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows by anchor, context, document and place; where contexts begin, and which copies come after another document or place."""
    order = np.lexsort((rows["start"], rows["tag"], rows["doc"], rows["context"], rows["anchor"]))
    rows = _take(rows, order)
    c, a = rows["context"], rows["anchor"]
    begin = np.r_[True, (c[1:] != c[:-1]) | (a[1:] != a[:-1])][: len(c)]
    return rows, begin, np.maximum.accumulate(np.where(begin, np.arange(len(c)), 0)) if len(c) else np.zeros(0, np.int64)


def _later(rows: dict[str, np.ndarray], head: np.ndarray, by_position: bool) -> np.ndarray:
    later = rows["doc"] > rows["doc"][head]
    return later | ((rows["doc"] == rows["doc"][head]) & (rows["start"] > rows["start"][head])) if by_position else later


def _spans(rows: dict[str, np.ndarray], window: int) -> tuple[np.ndarray, ...]:
    """(doc, tag, start, end) of the rows' windows, with those that touch put together."""
    order = np.lexsort((rows["start"], rows["tag"], rows["doc"]))
    doc, tag, start = rows["doc"][order], rows["tag"][order], rows["start"][order].astype(np.int64)
    end = start + rows["count"][order] + (window - 1)
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > end[:-1])][: len(doc)])
    return doc[new], tag[new], start[new], end[np.r_[new[1:], len(doc)] - 1] if len(doc) else end


#: What the stages pass on: spans (anchor null), or contexts whose text is wanted (anchor: what they are compared by; hot: they are too many).
FOUND = "doc long, tag long, start int, finish int, anchor long, hot boolean"


def _found(doc, tag, start, end, anchor=None, hot=None) -> pa.RecordBatch:
    n = len(doc)
    columns = [pa.array(doc, pa.int64()), pa.array(tag.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.nulls(n, pa.int64()) if anchor is None else pa.array(anchor.view(np.int64)), pa.nulls(n, pa.bool_()) if hot is None else pa.array(hot)]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "tag", "start", "finish", "anchor", "hot"])


PAGES = "bucket int, kind int, page binary"


def _pages(rows: dict[str, np.ndarray], buckets: int, by_position: bool, window: int) -> pa.RecordBatch:
    """Settles the copies within rows, and files the rest in pages (kind 0); the spans found go along (kind 1)."""
    rows, _, head = _ranked(rows)
    later = _later(rows, head, by_position)
    spans, rows = _spans(_take(rows, later), window), _take(rows, ~later)
    bucket = (rows["anchor"] >> np.uint64(44)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    rows, bucket = _take(rows, order), bucket[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    keys, kinds, pages = [], [], []
    for a, b in zip(cut, np.r_[cut[1:], len(bucket)]):
        keys.append(int(bucket[a]))
        kinds.append(0)
        pages.append(_pack(_take(rows, slice(a, b))))
    if len(spans[0]):
        doc, tag, start, end = spans
        keys.append((TaskContext.get().partitionId() if TaskContext.get() else 0) % buckets)
        kinds.append(1)
        pages.append(b"".join(x.tobytes() for x in (doc, start, end, tag)))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(kinds, pa.int32()), pa.array(pages, pa.binary())], names=["bucket", "kind", "page"])


def _ids(column) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in column.to_pylist()], np.int64)


def tag_of(raw: bytes, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(raw, seed) >> 1


@dataclass(frozen=True)
class Tags:
    """What tells texts of one id apart: nothing where ids are unique, else a hash of the text."""

    unique: bool
    seed: int = 0
    hash: Callable = tag_of

    def of(self, doc: int, raw: bytes) -> int:
        return 0 if self.unique and doc != NO_ID else self.hash(raw, self.seed)

    def column(self, number, text):
        def tags(numbers: pa.Array, texts: pa.Array) -> pa.Array:
            return pa.array([self.of(d, (t or "").encode("utf-8", "surrogatepass")) for d, t in zip(_ids(numbers).tolist(), texts.to_pylist())], pa.int64())

        return F.arrow_udf(tags, "long")(number, text)


def choose_tags(numbered: DataFrame, hash: Callable = tag_of) -> Tags:
    """numbered(number, text) -> tags by which no two texts of one id are alike."""
    n, distinct = numbered.agg(F.count("number"), F.count_distinct("number")).first()
    unique = n == distinct
    shared = numbered.where("number IS NULL") if unique else numbered
    for seed in range(10):
        tags = Tags(unique, seed, hash)
        alike = shared.select("number", tags.column(F.col("number"), F.col("text")).alias("tag"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole"))
        if alike.groupBy("number", "tag").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b").isEmpty():
            return tags
    raise RuntimeError("texts of one id can't be told apart")


def _file_contexts(scheme: Scheme, buckets: int, tags: Tags):
    """(id, text) -> pages."""

    def over(batches):
        held, n_held = [], 0
        for batch in batches:
            ids = _ids(batch.column(0))
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            pieces, size = [], 0

            def hashed():
                codes = np.concatenate([p[3] for p in pieces])
                ends = np.cumsum([len(p[3]) for p in pieces])
                first, count, _, anchor, context = contexts_of(codes, ends, scheme.window, scheme.gram)
                which = np.searchsorted(ends, first, side="right")
                doc, tag, base = (np.array([p[k] for p in pieces]) for k in range(3))
                begin = np.r_[0, ends[:-1]]
                return {"doc": doc[which], "tag": tag[which], "start": (first - begin[which] + base[which]).astype(np.int32), "count": count.astype(np.uint8), "anchor": anchor, "context": context}

            for doc, raw in zip(ids, texts):
                codes = scheme.units(raw)
                tag = tags.of(int(doc), raw)
                for base in range(0, max(len(codes) - scheme.window + 1, 0), CHUNK):
                    piece = codes[base : base + CHUNK + scheme.window - 1]
                    if size and size + len(piece) > CHUNK:
                        held.append(hashed())
                        n_held += len(held[-1]["doc"])
                        pieces, size = [], 0
                    pieces.append((doc, tag, base, piece))
                    size += len(piece)
            if pieces:
                held.append(hashed())
                n_held += len(held[-1]["doc"])
            if n_held >= FLUSH:
                yield _pages({k: np.concatenate([h[k] for h in held]) for k, _ in _COLUMNS}, buckets, scheme.by_position, scheme.window)
                held, n_held = [], 0
        if n_held:
            yield _pages({k: np.concatenate([h[k] for h in held]) for k, _ in _COLUMNS}, buckets, scheme.by_position, scheme.window)

    return over


def _read_pages(group: pa.Table, kind: int) -> list[bytes]:
    return [p for k, p in zip(group.column("kind").to_pylist(), group.column("page").to_pylist()) if k == kind]


def _passed_on(group: pa.Table) -> list[pa.RecordBatch]:
    out = []
    for page in _read_pages(group, 1):
        n = len(page) // 32
        doc, start, end, tag = np.frombuffer(page, np.int64, 4 * n).reshape(4, n)
        out.append(_found(doc, tag, start, end))
    return out


def _compared(scheme: Scheme, pages: list[bytes]) -> list[pa.RecordBatch]:
    """Spans of the copies, and the contexts to fetch: those of anchors that have several."""
    rows, begin, head = _ranked(_unpack(pages))
    if not len(begin):
        return []
    later = _later(rows, head, scheme.by_position)
    anchor = rows["anchor"]
    new = np.r_[True, anchor[1:] != anchor[:-1]]
    several = np.add.reduceat(begin.astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
    want = (several > 1) & ~later
    r = _take(rows, want)
    wanted = _found(r["doc"], r["tag"], r["start"], r["start"].astype(np.int64) + r["count"] + (scheme.window - 1), r["anchor"], several[want] > scheme.hot)
    return [_found(*_spans(_take(rows, later), scheme.window)), wanted]


_NONE = [np.zeros(0, np.int64)] * 4


def _compare_contexts(scheme: Scheme):
    """A bucket's pages -> spans of the copies, and the contexts to fetch."""

    def over(group: pa.Table) -> pa.Table:
        out = _passed_on(group) + _compared(scheme, _read_pages(group, 0))
        return pa.Table.from_batches(out, _found(*_NONE).schema)

    return over


def split_windows(codes: np.ndarray, anchor: int, window: int, gram: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """A crowded context's codes -> (key, hash) of each of its windows. Keys are of the anchor and the grams at both ends of the window; at level 2, of the whole window."""
    n = len(codes) - window + 1
    up, down = _powers(CHUNK + 1)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(codes * down[: len(codes)])]
    whole = mix((sums[window:] - sums[:n]) * up[:n])
    if level > 1:
        return mix(whole + np.uint64(1)), whole
    grams = mix((sums[gram:] - sums[:-gram]) * up[: len(codes) - gram + 1])
    key = mix(np.full(n, anchor, np.int64).view(np.uint64) * np.uint64(_BASE) + grams[:n])
    return mix(key * np.uint64(_BASE) + grams[window - gram : window - gram + n]), whole


def _fetch_contexts(scheme: Scheme, buckets: int, level: int, tags: Tags):
    """(id, text, wanted contexts) -> pages of kind 2: contexts with their codes; and of kind 0: the single windows of crowded contexts."""

    def page_of(docs, tags, starts, anchors, codes) -> bytes:
        sizes = np.array([len(c) for c in codes], np.int64)
        head = np.array([len(codes)], np.int64)
        return b"".join(x.tobytes() for x in (head, np.array(docs, np.int64), np.array(tags, np.int64), np.array(starts, np.int64), np.array(anchors, np.int64), sizes, np.concatenate(codes)))

    def over(batches):
        for batch in batches:
            by: dict[int, list] = {}
            windows = []
            for doc, text, wanted in zip(_ids(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                codes, tag = scheme.units(raw), tags.of(int(doc), raw)
                sent = np.frombuffer(raw, np.uint8) if scheme.bytewise else codes
                for w in wanted:
                    if not w["hot"]:
                        by.setdefault((w["anchor"] >> 20) % buckets, []).append((doc, tag, w["start"], w["anchor"], sent[w["start"] : w["finish"]]))
                        continue
                    part = codes[w["start"] : w["finish"]]
                    key, whole = split_windows(part, w["anchor"], scheme.window, scheme.gram, level)
                    n = len(key)
                    windows.append({"doc": np.full(n, doc), "tag": np.full(n, tag, np.int64), "start": np.arange(w["start"], w["start"] + n, dtype=np.int32), "count": np.ones(n, np.uint8), "anchor": key & ~np.uint64(0xFFFF), "context": whole})
            keys = list(by)
            pages = [page_of(*map(list, zip(*by[k]))) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([2] * len(keys), pa.int32()), pa.array(pages, pa.binary())], names=["bucket", "kind", "page"])
            if windows:
                yield _pages({k: np.concatenate([w[k] for w in windows]) for k, _ in _COLUMNS}, buckets, scheme.by_position, scheme.window)

    return over


def _settle(scheme: Scheme):
    """Contexts with codes -> spans; windows of crowded contexts -> spans of the copies, and those to fetch. `scheme.resolve(docs, starts, codes, ends, window, by_position)` gets whole anchors' contexts
    at a time and says, for every unit of `codes`, whether a window that begins there repeats an earlier one."""

    def over(group: pa.Table) -> pa.Table:
        out, heads, codes = _passed_on(group) + _compared(scheme, _read_pages(group, 0)), [], []
        for page in _read_pages(group, 2):
            n = int(np.frombuffer(page, np.int64, 1)[0])
            heads.append(np.frombuffer(page, np.int64, 5 * n, 8).reshape(5, n))
            codes.append(np.frombuffer(page, np.uint8 if scheme.bytewise else np.uint64, -1, 8 + 40 * n))
        if heads:
            doc, tag, start, anchor, size = np.concatenate(heads, axis=1)
            codes = np.concatenate(codes)
            begin = np.cumsum(size) - size
            order = np.lexsort((start, tag, doc, anchor))
            edge = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1]])
            upto = np.r_[0, np.cumsum(size[order])]
            batch = (upto[edge] - upto[edge[0]]) // scheme.batch  # anchors that begin within the same stretch go together
            cuts = edge[np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]])]
            for a, b in zip(cuts, np.r_[cuts[1:], len(order)]):
                some = order[a:b]
                ends = np.cumsum(size[some])
                flat = np.concatenate([codes[begin[k] : begin[k] + size[k]] for k in some])
                hit = np.flatnonzero(scheme.resolve(doc[some], start[some], flat, ends, scheme.window, scheme.by_position))
                which = np.searchsorted(ends, hit, side="right")
                where = start[some][which] + hit - (ends - size[some])[which]
                found = {"doc": doc[some][which], "tag": tag[some][which], "start": where, "count": np.ones(len(hit), np.int64)}
                out.append(_found(*_spans(found, scheme.window)))
        return pa.Table.from_batches(out, _found(*_NONE).schema)

    return over


def _numbered(df: DataFrame) -> DataFrame:
    """df(id, text) -> (id, text, number): whole numbers are their own, ids of other types are numbered in their order; a null id has none."""
    if isinstance(df.schema["id"].dataType, IntegralType):
        return df.select("id", "text", F.col("id").cast("long").alias("number"))
    places = global_index(df.select("id").where("id IS NOT NULL").distinct(), "id", name="number").select(F.col("id").alias("known"), F.col("number").cast("long").alias("number"))
    return df.join(places, df["id"] == places["known"], "left").select("id", "text", "number")


def repeated_spans(df: DataFrame, scheme: Scheme) -> DataFrame:
    """df(id, text) -> id, tag, text and spans (array of [start, finish) in units, null where there are none): the units in a
    window that an earlier one equals."""
    spark = df.sparkSession
    small_batches(spark)
    buckets = max(8, 4 * df.rdd.getNumPartitions())
    df = _numbered(df)
    tags = choose_tags(df)
    filed = df.select("number", "text").mapInArrow(_file_contexts(scheme, buckets, tags), PAGES)
    found = [materialize(filed.groupBy("bucket").applyInArrow(_compare_contexts(scheme), FOUND), "contexts")]
    tagged = df.select("id", "number", "text", F.coalesce("number", F.lit(NO_ID)).alias("doc"), tags.column(F.col("number"), F.col("text")).alias("tag"))
    # crowded contexts are cut to windows, of which some may be wanted in the next pass; mostly one pass does
    for level in range(1, 5):
        wanted = found[-1].where("anchor IS NOT NULL")
        if wanted.isEmpty():
            break
        wanted = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "finish", "anchor", "hot")).alias("wanted"))
        texts = tagged.join(wanted, ["doc", "tag"]).dropDuplicates(["doc", "tag"]).select("number", "text", "wanted")
        fetched = texts.mapInArrow(_fetch_contexts(scheme, buckets, level, tags), PAGES)
        found.append(materialize(fetched.groupBy("bucket").applyInArrow(_settle(scheme), FOUND), "windows"))
    else:
        raise RuntimeError("windows filed by their whole text stay apart")
    found = reduce(DataFrame.unionByName, found)
    spans = found.where("anchor IS NULL")
    spans = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "finish")).alias("spans"))
    return tagged.join(spans, ["doc", "tag"], "left").select("id", "tag", "text", "spans")


def merged(spans: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """Sorted, disjoint spans, clipped to n units; spans that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], min(s["finish"], n)) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]
