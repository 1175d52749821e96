"""SimHash near-duplicates by bit-sliced comparison.

Texts get 64-bit fingerprints of their word shingles. Two fingerprints that differ in at most 3 of 6
blocks' bits agree in 3 whole blocks, so each fingerprint is filed under its 20 choices of 3 blocks, and only
those filed alike are compared. They are compared bit-sliced: one bit plane holds bit b of 64 fingerprints in each word,
a fingerprint is compared with the one d places on for all places at once, and differing bits go into carry-save counters;
a word is abandoned once all of its 64 distances exceed the radius.

Copies are one fingerprint each before any comparison. A file of more than `RUN_LIMIT` fingerprints is filed again under four
parts of the remaining bits, one of which must agree, and so on until no file is longer, so that no task compares or holds an unbounded file.

Defined results: null, empty and blank texts have the fingerprint zero and link like any other; repeated rows get the same
component; an empty table gives no rows; other columns, whatever their names, are not read, and `drop_near_copies` carries them along.

`drop_near_copies` has parameters of its own: texts are near copies if the sets of their five-word shingles have a Jaccard similarity of
0.8 or more. A radius of 3 of 64 bits is far too small for that, so it takes SimHashes of 256 bits. At 0.8 two of them differ in a bit with probability
acos(8/9) / pi = 0.152, in 39 bits of 256 on average; unrelated ones differ in 128. They are filed by some of their bits, under so many choices that a pair at 0.8
is filed alike with probability 0.9996; those filed alike and of sizes within 4 : 5 are compared bit-sliced, as above, and abandoned where more than 22 of 64, 38 of 128,
53 of 192 or 66 of 256 bits differ (less than 0.0001 of the pairs at 0.8). What is found so is compared exactly. Texts without words are copies of each other.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm.common import fresh, materialize, small_batches, table
from vocalith.llm.components import connected_components

SHINGLE = 3
RADIUS = 3
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
RUN_LIMIT = 4096
BLOCK_ROWS = 1 << 16
NEAR_SHINGLE = 5
NEAR_JACCARD = 0.8
NEAR_WORDS = 4
#: Differing bits that near copies may have among the first 64, 128, 192 and 256.
NEAR_LIMITS = (22, 38, 53, 66)
#: The chance that a pair at NEAR_JACCARD is not filed alike.
NEAR_MISS = 4e-4
#: Rows that a file has on average; those beyond which one is compared part by part; rows compared at once.
NEAR_FILE, NEAR_LONG, NEAR_ROWS = 1 << 12, 1 << 16, 1 << 18
#: What one part of a group may weigh (shingles, and 256 for each text); larger groups are compared part by part, each with each.
PART_WEIGHT = 1 << 18
PRINT = [f"f{k}" for k in range(NEAR_WORDS)]
_WORDS: dict[bytes, int] = {}
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS, _OFFSETS = (np.random.default_rng(5).integers(0, 1 << 64, (2, NEAR_WORDS), np.uint64) | np.uint64(1))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = end - size
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(start[: 1 - shingle].tolist(), end[shingle - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64), pa.int64())


def fingerprints(text: Column) -> Column:
    return F.arrow_udf(_fingerprints, "long")(text)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """[64, words]: bit i of word w in plane b is bit b of values[64 * w + i]; a zero word is at the end."""
    n = -(-len(values) // 64) * 64 + 64
    padded = np.zeros(n, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _shifted(planes: np.ndarray, words: np.ndarray, d: int) -> np.ndarray:
    """Lane i of the chosen words holds what lane i + d of all lanes holds."""
    w, r = divmod(d, 64)
    last = planes.shape[1] - 1
    out = planes[:, np.minimum(words + w, last)] >> np.uint64(r)
    if r:
        out |= planes[:, np.minimum(words + w + 1, last)] << np.uint64(64 - r)
    return out


def close_pairs(planes: np.ndarray, same: np.ndarray, d: int) -> np.ndarray:
    """The lanes i, of those set in `same` (packed), that differ from lane i + d in at most 3 bits."""
    words = np.flatnonzero(same)
    alive = same[words]
    one, two = np.zeros_like(alive), np.zeros_like(alive)
    for b in range(0, 64, 8):
        part = planes[b : b + 8]
        for x in part[:, words] ^ _shifted(part, words, d):
            carry = one & x
            one ^= x
            alive &= ~(two & carry)  # a fourth differing bit
            two ^= carry
        live = alive != 0
        if not live.all():
            words, alive, one, two = words[live], alive[live], one[live], two[live]
        if not len(words):
            return words
    lanes = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(lanes)
    return words[row] * 64 + lane


def link_runs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """keys: sorted; values: fingerprints. Spanning links within runs of equal keys: (value, its component's first value)."""
    n = len(keys)
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[start, n])
    run_end = np.repeat(start + size, size)
    run_start = np.repeat(start, size)
    planes = bit_planes(values)
    root = np.arange(n)
    for d in range(1, int(size.max())):
        lanes = np.zeros(planes.shape[1] * 64, np.uint8)
        lanes[: n - d] = keys[d:] == keys[: n - d]
        same = np.packbits(lanes, bitorder="little").view(np.uint64)
        if not same.any():
            break
        i = close_pairs(planes, same, d)
        i = i[root[i] != root[i + d]] if len(i) else i
        for a in i.tolist():
            x, y = root[a], root[a + d]
            if x != y:
                own = root[run_start[a] : run_end[a]]
                own[own == max(x, y)] = min(x, y)
    linked = np.flatnonzero(root != np.arange(n))
    return values[linked], values[root[linked]]


FILED = "key long, fp long, rest long"


def _compare(limit: int, block: int = BLOCK_ROWS):
    """Sorted (key, fp, rest) rows -> links (u, v), and (u, null, key, rest) for the rows of files longer than the limit, which are passed on unread."""

    def out(u, v, key, rest):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, key, rest)], names=["u", "v", "key", "rest"])

    def passed(keys, values, rest):
        return out(values.view(np.int64), [None] * len(keys), keys, rest)

    def run(keys: np.ndarray, values: np.ndarray, rest: np.ndarray):
        if len(keys):
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[start, len(keys)])
            long = np.repeat(size > limit, size)
            if long.any():
                yield passed(keys[long], values[long], rest[long])
                keys, values = keys[~long], values[~long]
        if len(keys) > 1:
            u, v = link_runs(keys, values)
            if len(u):
                yield out(u.view(np.int64), v.view(np.int64), [None] * len(u), [None] * len(u))

    def over(batches):
        held, rows, long = [], 0, None
        for batch in batches:
            keys, values, rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if long is not None:  # a file that was longer than the block is still being read
                n = int(np.searchsorted(keys, long, side="right"))
                if n:
                    yield passed(keys[:n], values[:n], rest[:n])
                    keys, values, rest = keys[n:], values[n:], rest[n:]
                if not len(keys):
                    continue
                long = None
            held.append((keys, values.view(np.uint64), rest))
            rows += len(keys)
            if rows >= block:
                keys, values, rest = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(keys, keys[-1]))
                yield from run(keys[:cut], values[:cut], rest[:cut])
                if len(keys) - cut > limit:
                    yield passed(keys[cut:], values[cut:], rest[cut:])
                    held, rows, long = [], 0, keys[-1]
                else:
                    held, rows = [(keys[cut:], values[cut:], rest[cut:])], len(keys) - cut
        if held:
            yield from run(*(np.concatenate(x) for x in zip(*held)))

    return over


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _filed(fps: DataFrame) -> DataFrame:
    """Each fingerprint under its 20 choices of 3 blocks; rest: the bits that a file's fingerprints may differ in."""
    masks = [sum(((1 << n) - 1) << at for at, n in chosen) for chosen in combinations(BLOCKS, 3)]
    rows = [F.struct(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))).alias("key"), F.lit(_signed(~m & ((1 << 64) - 1))).cast("long").alias("rest")) for k, m in enumerate(masks)]
    return fps.select("fp", F.explode(F.array(*rows)).alias("f")).select("f.key", "fp", "f.rest")


def _parts(rest: int) -> list[int]:
    """The bits of a mask, dealt to four masks."""
    bits = [b for b in range(64) if rest >> b & 1]
    return [sum(1 << b for b in bits[j::4]) for j in range(4)]


def _file_again(batches):
    """(u, key, rest) -> (key, fp, rest): under four parts of the bits that are left, of which one has no differing bit where at most 3 differ."""
    for batch in batches:
        fp, key, rest = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
        for mask in np.unique(rest).tolist():
            own = rest == mask
            for j, part in enumerate(_parts(mask)):
                again = _mixed((_mixed(key[own] + np.uint64(j + 1)) * _ODD) + (fp[own] & np.uint64(part)))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (again, fp[own], np.full(len(again), mask & ~part, np.uint64))], names=["key", "fp", "rest"])


def fingerprint_links(fps: DataFrame, limit: int = RUN_LIMIT, block: int = BLOCK_ROWS) -> DataFrame:
    """fps(fp), distinct -> links (u, v) that span the components of "at most 3 bits differ".

    Files longer than the limit are filed again by fewer and fewer free bits until none is left: a file with r free bits has at most 2 ** r fingerprints, so
    that ends after five rounds at the latest.
    """
    if limit < 8:
        raise ValueError("files of 8 fingerprints, which have 3 free bits at least, must do")
    filed, found = _filed(fps), []
    while filed is not None:
        links = materialize(filed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_compare(limit, block), "u long, v long, key long, rest long"), "links")
        found.append(links.where("key IS NULL").select("u", "v"))
        long = links.where("key IS NOT NULL")
        filed = None if long.isEmpty() else long.select("u", "key", "rest").mapInArrow(_file_again, FILED)
    return reduce(DataFrame.unionByName, found).distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fp (long), component_id (the least id reachable)."""
    small_batches(df.sparkSession)
    docs = materialize(df.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col)).alias("fp")), "fingerprints")
    fps = docs.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(fingerprint_links(fps.select("fp")))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(named.join(of_root, "root").select(F.col("fp").alias("class_fp"), "component_id"), "classes")
    return docs.join(classes, docs["fp"] == classes["class_fp"]).select(F.col("id").alias(id_col), "fp", "component_id")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a text of fewer words is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > 1 << 17:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh64_intdigest(w, 42)
    codes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = _mixed(out * _ODD + codes[j : j + n])
    return np.unique(out)


def near_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles, 256 bits in four words: a bit is 1 if set in over half of the shingles' hashes."""
    ones = np.zeros(64 * NEAR_WORDS, np.int64)
    for at in range(0, len(shingles), 4096):
        hashes = _mixed(shingles[at : at + 4096, None] * _MULTIPLIERS + _OFFSETS)
        ones += np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)


def _sketches(texts: pa.Array) -> pa.Array:
    sets = [shingle_set(t) for t in texts.to_pylist()]
    same = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
    prints = np.array([near_fingerprint(s) for s in sets], np.uint64).reshape(-1, NEAR_WORDS).view(np.int64)
    return pa.StructArray.from_arrays([pa.array(same, pa.int64()), pa.array(list(map(len, sets)), pa.int64()), *[pa.array(np.ascontiguousarray(f), pa.int64()) for f in prints.T]], names=["same", "size", *PRINT])


def sketches(text: Column) -> Column:
    """same (hash of the whole shingle set), size, and the words of its SimHash."""
    return F.arrow_udf(_sketches, "struct<same:long,size:long," + ",".join(f"{f}:long" for f in PRINT) + ">").asNondeterministic()(text)


def near_filing(rows: int) -> tuple[int, int]:
    """(bits, files): by how many bits so many rows are filed, and how often, for a chance of NEAR_MISS at most that a pair at NEAR_JACCARD never meets."""
    bits = max(0, int(np.ceil(np.log2(max(1, rows) / NEAR_FILE))))
    n, p = 64 * NEAR_WORDS, np.arccos(2 * NEAR_JACCARD / (1 + NEAR_JACCARD)) / np.pi
    differ = np.arange(n + 1)
    logs = np.r_[0, np.cumsum(np.log(np.arange(1, n + 1)))]
    chance = np.exp(logs[n] - logs[differ] - logs[n - differ] + differ * np.log(p) + (n - differ) * np.log(1 - p))
    alike = np.prod([np.maximum(0, n - differ - k) / (n - k) for k in range(bits)], axis=0) if bits else np.ones(n + 1)
    files = 1
    while (chance * (1 - alike) ** files).sum() > NEAR_MISS:
        files += 1
    return bits, files


def _file_near(bits: int, files: int):
    """(same, size, f0..f3) -> a row for each file: its number and the chosen bits make the key."""
    rng, n = np.random.default_rng(9), 64 * NEAR_WORDS
    drawn = np.concatenate([rng.permutation(n) for _ in range(-(-bits * files // n) + 1)])
    chosen, at = [], 0
    for _ in range(files):  # whole permutations, so that all bits are used alike
        take = []
        while len(take) < bits:
            if drawn[at] not in take:
                take.append(drawn[at])
            at = (at + 1) % len(drawn)
        chosen.append(take)

    def over(batches):
        for batch in batches:
            prints = np.stack([batch.column(f).to_numpy() for f in PRINT], axis=1)
            ones = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
            for k, take in enumerate(chosen):
                key = np.full(len(prints), k, np.int64) << bits
                for j, b in enumerate(take):
                    key |= ones[:, b].astype(np.int64) << j
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *batch.columns], names=["key", "same", "size", *PRINT])

    return over


def _add(counts: list[np.ndarray], x: np.ndarray) -> None:
    """Eight planes more: counts[k] is bit k of each lane's number of ones, by carry-save adders."""

    def full(k, a, b):
        odd = counts[k] ^ a
        carry = (counts[k] & a) | (odd & b)
        counts[k] = odd ^ b
        return carry

    fours = [full(1, full(0, x[j], x[j + 1]), full(0, x[j + 2], x[j + 3])) for j in (0, 4)]
    carry = full(2, *fours)
    for k in range(3, len(counts)):
        counts[k], carry = counts[k] ^ carry, counts[k] & carry


def _above(counts: list[np.ndarray], limit: int) -> np.ndarray:
    """The lanes whose number is over the limit."""
    above, equal = np.zeros_like(counts[0]), ~np.zeros_like(counts[0])
    for k in range(len(counts) - 1, -1, -1):
        if limit >> k & 1:
            equal &= counts[k]
        else:
            above |= equal & counts[k]
            equal &= ~counts[k]
    return above


def near_lanes(planes: np.ndarray, same: np.ndarray, d: int) -> np.ndarray:
    """As `close_pairs`, for 256 planes and the limits of near copies."""
    words = np.flatnonzero(same)
    alive = same[words]
    counts = [np.zeros_like(alive) for _ in range((64 * NEAR_WORDS).bit_length())]
    for k, limit in enumerate(NEAR_LIMITS):
        for b in range(64 * k, 64 * k + 64, 8):
            part = planes[b : b + 8]
            _add(counts, part[:, words] ^ _shifted(part, words, d))
        alive &= ~_above(counts, limit)
        live = alive != 0
        if not live.all():
            words, alive, counts = words[live], alive[live], [c[live] for c in counts]
        if not len(words):
            return words
    row, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return words[row] * 64 + lane


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the links i - j; each is its component's least place."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while (root[root] != root).any():
            root = root[root]


def link_near(keys: np.ndarray, size: np.ndarray, prints: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key and size -> spanning links (place, place) of those of one key, of sizes within 4 : 5, whose fingerprints are within the limits."""
    n = len(keys)
    run = np.cumsum(np.r_[False, keys[1:] != keys[:-1]]) << 32
    most = np.floor(size / NEAR_JACCARD + 1e-6).astype(np.int64)
    span = np.searchsorted(run + size, run + most, side="right") - 1 - np.arange(n)
    planes = np.concatenate([bit_planes(p) for p in prints])
    root = np.arange(n)
    for d in range(1, int(span.max()) + 1):
        lanes = np.zeros(planes.shape[1] * 64, np.uint8)
        lanes[: n - d] = (span[: n - d] >= d) & (root[d:] != root[: n - d])  # what is linked already need not be compared
        same = np.packbits(lanes, bitorder="little").view(np.uint64)
        if same.any():
            i = near_lanes(planes, same, d)
            if len(i):
                root = _joined(root, i, i + d)
    linked = np.flatnonzero(root != np.arange(n))
    return linked, root[linked]


def _whole_files(batches, limit: float, block: int):
    """Sorted rows -> (columns, False) for blocks of whole files and (columns, True) for the rows of files longer than the limit."""

    def sorted_out(cols):
        length = np.unique(cols[0], return_counts=True)[1]
        over = np.repeat(length > limit, length)
        yield from (([c[own] for c in cols], kind) for own, kind in ((~over, False), (over, True)) if own.any())

    held, rows, long = [], 0, None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if long is not None:
            n = int(np.searchsorted(cols[0], long, side="right"))
            if n:
                yield [c[:n] for c in cols], True
                cols = [c[n:] for c in cols]
            if not len(cols[0]):
                continue
            long = None
        held.append(cols)
        rows += len(cols[0])
        if rows > block:
            cols = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut:
                yield from sorted_out([c[:cut] for c in cols])
            rest, rows = [c[cut:] for c in cols], rows - cut
            held = [rest]
            if rows > limit:
                yield rest, True
                held, rows, long = [], 0, rest[0][-1]
    if rows:
        yield from sorted_out([np.concatenate(x) for x in zip(*held)])


def _compare_near(limit: float, block: int):
    """Sorted (key, same, size, f0..f3) -> links (u, v); rows of files longer than the limit with u null, to be compared part by part."""
    names = ["u", "v", "key", "same", "size", *PRINT]

    def over(batches):
        for cols, long in _whole_files(batches, limit, block):
            if long:
                none = pa.nulls(len(cols[0]), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *[pa.array(c, pa.int64()) for c in cols]], names=names)
            elif len(cols[0]) > 1:
                i, j = link_near(cols[0], cols[2], [c.view(np.uint64) for c in cols[3:]])
                none = pa.nulls(len(i), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cols[1][i], pa.int64()), pa.array(cols[1][j], pa.int64()), *[none] * (len(names) - 2)], names=names)

    return over


def near_links(sets: DataFrame, rows: int, limit: int = NEAR_LONG, block: int = NEAR_ROWS) -> DataFrame:
    """sets(same, size, f0..f3), distinct -> links (u, v) that span the candidate groups: what is filed alike, of like size, and within the limits.

    A file longer than the limit is cut into parts of half of it, and each two of them are compared, so that no task holds a long file.
    """
    columns = "key long, same long, size long, " + ", ".join(f"{f} long" for f in PRINT)
    compared = lambda df, most: df.repartition("key").sortWithinPartitions("key", "size").mapInArrow(_compare_near(most, block), "u long, v long, " + columns)
    first = materialize(compared(sets.mapInArrow(_file_near(*near_filing(rows)), columns), limit), "near-links")
    links, long = first.where("u IS NOT NULL").select("u", "v"), first.where("u IS NULL").drop("u", "v")
    if not long.isEmpty():
        parts = long.groupBy("key").agg(F.ceil(2 * F.count("*") / limit).alias("parts"))
        cut = long.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("same"), F.col("parts")))
        paired = cut.withColumn("other", F.explode(F.expr("filter(sequence(0L, parts - 1), j -> j <> part)")))
        key = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
        links = links.unionByName(compared(paired.select(key.alias("key"), "same", "size", *PRINT), float("inf")).select("u", "v"))
    return links.distinct()


def _set_bytes(texts: pa.Array) -> pa.Array:
    return pa.array([shingle_set(t).tobytes() for t in texts.to_pylist()], pa.binary())


def link_sets(names: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning links of "Jaccard similarity at least 0.8". Sets are taken by size; what each has in common with all smaller ones is counted at once, from
    the places of its shingles."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[k]) for k in order])
    _, shingle = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    end_of_set = np.cumsum(size)
    owner = np.repeat(np.arange(len(order)), size)
    owners = owner[np.argsort(shingle, kind="stable")]  # of each shingle in turn, in order
    upto = np.cumsum(np.bincount(shingle))
    tenths = round(10 * NEAR_JACCARD)
    root, links = np.arange(len(order)), []
    for i in range(1, len(order)):
        low = int(np.searchsorted(size, NEAR_JACCARD * size[i] - 1e-6))
        if low == i:
            continue
        own = shingle[end_of_set[i] - size[i] : end_of_set[i]]
        stop = upto[own]
        start = np.r_[0, upto][own]
        n = stop - start
        places = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
        common = np.bincount(owners[places], minlength=len(order))[low:i]
        near = low + np.flatnonzero(10 * common >= tenths * (size[i] + size[low:i] - common))
        for j in near[np.unique(root[near], return_index=True)[1]].tolist():
            if root[j] != root[i]:
                links.append((names[order[i]], names[order[j]]))
                root[root == root[j]] = root[i]
    return links


def _verify(batches):
    """Rows (part, name, set), sorted by part -> links (u, v)."""
    part, held = None, {}

    def done():
        links = link_sets(np.array(list(held), np.int64), list(held.values())) if len(held) > 1 else []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["u", "v"])

    for batch in batches:
        for p, name, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part:
                yield from done()
                part, held = p, {}
            held[name] = np.frombuffer(raw, np.uint64)
    yield from done()


def row_key(df: DataFrame, text_col: str) -> list[Column]:
    """Hashes of the text and of the whole row (but maps)."""
    return [F.xxhash64(F.col(text_col)), F.xxhash64(*[F.col(c) for c, kind in df.dtypes if "map<" not in kind])]


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text_hash, row_hash, group. Groups are the components of "Jaccard similarity of the shingle sets at least 0.8".

    Sets whose SimHashes are filed alike and differ in few bits make candidate groups. Only the texts of candidate groups are read
    again and compared, one text for each set.
    """
    small_batches(df.sparkSession)
    hashes = [h.alias(c) for h, c in zip(row_key(df, text_col), ("text_hash", "row_hash"))]
    docs = df.select(F.col(id_col).alias("id"), *hashes, sketches(F.col(text_col)).alias("k"))
    docs = materialize(docs.select("id", "text_hash", "row_hash", "k.*"), "sketches")
    sets = docs.where("size > 0").select("same", "size", *PRINT).dropDuplicates(["same"])
    near = connected_components(near_links(sets, docs.count()))
    one = docs.groupBy("same").agg(F.min(F.struct("text_hash", "row_hash")).alias("row"), F.first("size").alias("size"))
    members = materialize(near.join(one, near["node"] == one["same"]).select("root", "same", "size", "row.text_hash", "row.row_hash"), "candidates")
    parts = members.groupBy("root").agg(F.ceil(F.sum(F.col("size") + 256) / PART_WEIGHT).alias("parts"))
    members = members.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("same"), F.col("parts")))
    texts = df.select(F.col(text_col).alias("text"), *hashes).join(members, ["text_hash", "row_hash"])
    sets = texts.select("root", "same", "part", "parts", F.arrow_udf(_set_bytes, "binary")(F.col("text")).alias("set"))
    others = F.expr("filter(sequence(0L, parts - 1), j -> parts = 1 OR j <> part)")
    paired = sets.select("root", "same", "part", "set", F.explode(others).alias("other")).select(F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "same", "set")
    links = paired.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "u long, v long")
    roots = connected_components(materialize(links.distinct(), "links"))
    return docs.join(roots, docs["same"] == roots["node"], "left").select("id", "text_hash", "row_hash", F.coalesce("root", "same").alias("group"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar texts: the one of the least id (null ids last; of rows that share it, the one of the least text hash); same columns."""
    found = materialize(similar_groups(df, id_col, text_col), "groups")
    kept = found.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "row_hash")).alias("row"))
    t, r, kept_t, kept_r = (fresh(df, stem) for stem in ("text_hash__", "row_hash__", "kept_text__", "kept_row__"))
    kept = kept.select(F.col("row.text_hash").alias(kept_t), F.col("row.row_hash").alias(kept_r))
    rows = df.select("*", *[h.alias(c) for h, c in zip(row_key(df, text_col), (t, r))])
    # the row's hash is of all columns, the id too, so only rows that are alike in all of them are left to drop
    return rows.join(kept, (F.col(t) == F.col(kept_t)) & (F.col(r) == F.col(kept_r)), "left_semi").dropDuplicates([t, r]).select(*df.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": (op10_simhash, None)}
