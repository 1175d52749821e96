"""The trie of conversation prefixes, screened by a count-min sketch.

Every turn of a conversation ends a prefix; its digest is the exclusive or of 128-bit hashes of (place, turn) up to it, so prefixes of any conversation are
running sums. A count-min sketch of all digests, with counts that stop at two, is built in the tasks and merged by blocks; its bits for "two or more" are broadcast
and have a bounded size. A digest with an estimate of one belongs to one conversation: the node and the tail below it are written where they are. Only possibly
shared prefixes, and the rows that hang from them, are shuffled and grouped by their exact digest. A sketch that is too full sends more rows there and changes no result.

Sums over subtrees need no walk through the tree. A subtree's tokens over all its conversations are the sum, over the members of its top, of what each has from there on; its distinct
tokens are the same sum with each node counted for its smallest member only, and once a member is the smallest it stays so further down. A leaf counts for its smallest member as well.

One conversation may hold a third of all turns: turns are range-sorted, and numbers and running digests are taken within ranges, then carried from range to range. One node may hold a third of all conversations: it is
grouped with map-side aggregation, and its list of members is put together from sorted pieces.

Defined results: null roles and texts are empty; turns of equal number are ordered by the md5 of role and text, repeated rows are repeated turns; rows without a
conversation are one conversation of its own, after all others, which takes no turns from another, is counted, and is left out of lists; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalith.llm.common import materialize, sha256_of, small_batches, table

GROUP, PREFIXES = 100, 6
SKETCH_ROWS = 2
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 24
BLOCK_CELLS = 1 << 16
LIST_BYTES = 1 << 20
NODE = ["depth", "a", "b"]
CONV = ["conv", "known"]


def borrowed_turns(conv):
    """How many first turns of the group's first conversation replace one's own."""
    return F.crc32(conv.cast("string")) % PREFIXES


# --- conversations as rows of (conv, known, part, depth, ...)


def rebuilt_turns(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, known, part, place, a, b, chars) of every rebuilt turn, and (conv, known) of every conversation, both written.

    Turns of a conversation in a greater part come later; part -1 holds those that are taken from another conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = df.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNotNull().alias("known"), "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("mark"), F.length(text).cast("long").alias("chars"),
    )
    order = [F.col("turn").asc_nulls_first(), "mark"]
    turns = materialize(turns.repartitionByRange(*CONV, *order).withColumn("part", F.spark_partition_id()), "turns")
    sizes = materialize(turns.groupBy(*CONV, "part").agg(F.count("*").alias("n")), "turn-counts")
    convs = sizes.groupBy(*CONV).agg(F.sum("n").alias("n"))
    h = F.when(F.col("known"), borrowed_turns(F.col("conv"))).otherwise(0)
    base = F.col("conv") - F.col("conv") % GROUP
    firsts = convs.where(F.col("known") & (F.col("conv") % GROUP == 0)).select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    plans = convs.select(*CONV, h.alias("h"), F.when(F.col("known"), base).alias("base")).join(firsts, "base", "left").select(*CONV, "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    plans = materialize(plans, "conversations")
    before = F.sum("n").over(W.partitionBy(*CONV).orderBy("part")) - F.col("n")
    parts = sizes.select(*CONV, "part", before.alias("before")).join(plans, CONV)
    place = F.row_number().over(W.partitionBy(*CONV, "part").orderBy(*order)) + F.col("before")
    numbered = turns.join(parts, [*CONV, "part"]).withColumn("place", place)
    own = numbered.where("place > h").select(*CONV, "part", (F.col("taken") + F.col("place") - F.col("h")).alias("place"), "mark", "chars")
    lent = numbered.where(F.col("known") & (F.col("conv") % GROUP == 0) & (F.col("place") < PREFIXES)).select(F.col("conv").alias("base"), "place", "mark", "chars")
    taken = plans.where("taken > 0").join(lent, "base").where("place <= taken").select(*CONV, F.lit(-1).alias("part"), "place", "mark", "chars")
    hashes = [F.xxhash64("place", "mark", F.lit(s)).alias(s) for s in ("a", "b")]
    return materialize(own.unionByName(taken).select(*CONV, "part", "place", *hashes, "chars"), "rebuilt-turns"), plans.select(*CONV)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, known, depth, a, b, pa, pb, chars, before, total, length), written: digests of the prefix and of the one above it, characters of the last turn, of those before it
    and of the whole conversation, and its number of turns."""
    sums = turns.groupBy(*CONV, "part").agg(F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"), F.sum("chars").alias("xc"), F.count("*").alias("n"))
    over = W.partitionBy(*CONV).orderBy("part")
    earlier, whole = over.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*CONV)
    carry = sums.select(
        *CONV, "part", *(F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(f"c{x[1]}") for x in ("xa", "xb")), F.coalesce(F.sum("xc").over(earlier), F.lit(0)).alias("cc"),
        F.sum("xc").over(whole).alias("total"), F.sum("n").over(whole).alias("length"),
    )
    run = W.partitionBy(*CONV, "part").orderBy("place")
    rows = turns.join(materialize(carry, "carried"), [*CONV, "part"])
    digests = {x: F.bit_xor(x).over(run).bitwiseXOR(F.col(f"c{x}")) for x in ("a", "b")}
    rows = rows.select(*CONV, F.col("place").cast("long").alias("depth"), *(d.alias(f"p{x}") for x, d in digests.items()), F.col("a").alias("la"), F.col("b").alias("lb"), "chars", (F.sum("chars").over(run) + F.col("cc") - F.col("chars")).alias("before"), "total", "length")
    return materialize(rows.select(*CONV, "depth", F.col("pa").alias("a"), F.col("pb").alias("b"), F.col("pa").bitwiseXOR(F.col("la")).alias("pa"), F.col("pb").bitwiseXOR(F.col("lb")).alias("pb"), "chars", "before", "total", "length"), "prefixes")


# --- the sketch


def _cells(a: np.ndarray, b: np.ndarray, row: int, cells: int) -> np.ndarray:
    mixed = (a.view(np.uint64) + np.uint64(2 * row + 1) * b.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) & np.uint64(cells - 1)).astype(np.int64)


def _count(cells: int):
    """Digests -> (row, block, seen, twice): bits of the cells that this task met, and met twice."""

    def over(batches):
        seen, twice = np.zeros((SKETCH_ROWS, cells), bool), np.zeros((SKETCH_ROWS, cells), bool)
        for batch in batches:
            a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for row in range(SKETCH_ROWS):
                at, n = np.unique(_cells(a, b, row, cells), return_counts=True)
                twice[row, at] |= seen[row, at] | (n > 1)
                seen[row, at] = True
        for row in range(SKETCH_ROWS):
            for block in range(cells // BLOCK_CELLS):
                part = slice(block * BLOCK_CELLS, (block + 1) * BLOCK_CELLS)
                if seen[row, part].any():
                    bits = [np.packbits(x[row, part], bitorder="little").tobytes() for x in (seen, twice)]
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in bits)], names=["row", "block", "seen", "twice"])

    return over


def _merge_blocks(batches):
    """Rows sorted by (row, block) -> each block's cells that were met twice in all, one block in memory at a time."""
    key = seen = twice = None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["row", "block", "twice"])
    for batch in batches:
        for row, block, s, t in zip(*(c.to_pylist() for c in batch.columns)):
            s, t = np.frombuffer(s, np.uint8), np.frombuffer(t, np.uint8)
            if key != (row, block):
                if key is not None:
                    yield done()
                key, seen, twice = (row, block), s.copy(), t.copy()
            else:
                twice |= t | (seen & s)
                seen |= s
    if key is not None:
        yield done()


def shared_cells(digests: DataFrame, cells: int):
    """A broadcast array [row, cells / 8] of the cells whose count is two or more."""
    spark = digests.sparkSession
    blocks = digests.select("a", "b").mapInArrow(_count(cells), "row int, block int, seen binary, twice binary")
    merged = blocks.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(_merge_blocks, "row int, block int, twice binary")
    bits = np.zeros((SKETCH_ROWS, cells // 8), np.uint8)
    for r in merged.collect():
        bits[r.row, r.block * (BLOCK_CELLS // 8) : (r.block + 1) * (BLOCK_CELLS // 8)] = np.frombuffer(r.twice, np.uint8)
    return spark.sparkContext.broadcast(bits)


def sketch_cells(n: int) -> int:
    """Four cells a prefix, within bounds."""
    return min(max(1 << max(4 * n - 1, 1).bit_length(), LEAST_CELLS), MOST_CELLS)


def possibly_shared(depth, a, b, sketch, cells: int):
    """Whether a prefix's estimate is above one. The root always counts as shared."""

    def estimate(depths: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        d, x, y = (c.to_numpy(zero_copy_only=False) for c in (depths, a, b))
        out = np.ones(len(d), bool)
        for row in range(SKETCH_ROWS):
            at = _cells(x, y, row, cells)
            out &= (sketch.value[row][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return pa.array(out | (d == 0))

    return F.arrow_udf(estimate, "boolean").asNondeterministic()(depth, a, b)


# --- lists of members


def _by_node(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _list_pieces(batches):
    """(depth, a, b, conv) in that order -> pieces of each node's list: ids with commas between them."""
    key, first, ids, size = None, None, [], 0
    piece = lambda: pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*key, first)), pa.array([",".join(ids)], pa.string())], names=[*NODE, "first", "ids"])
    held = []
    for *node, conv in _by_node(batches):
        if node != key or size > LIST_BYTES:
            if key is not None:
                held.append(piece())
                if len(held) >= 1000:
                    yield from _joined(held)
                    held = []
            key, first, ids, size = node, conv, [], 0
        ids.append(str(conv))
        size += len(ids[-1]) + 1
    if key is not None:
        held.append(piece())
    yield from _joined(held)


def _joined(batches: list):
    if batches:
        yield pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _list_digests(batches):
    """Pieces sorted by node and first id -> a digest for each node; one piece in memory at a time."""
    key, digest, out = None, None, []

    def rows():
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*(k for k, _ in out)))), pa.array([d for _, d in out], pa.string())], names=[*NODE, "ends_sha256"])

    for *node, _, ids in _by_node(batches):
        if node != key:
            if key is not None:
                out.append((key, digest.hexdigest()))
            key, digest = node, hashlib.sha256(ids.encode())
            if len(out) >= 10_000:
                yield rows()
                out = []
        else:
            digest.update(b"," + ids.encode())
    if key is not None:
        out.append((key, digest.hexdigest()))
        yield rows()


def member_lists(ends: DataFrame) -> DataFrame:
    """ends(depth, a, b, conv) -> depth, a, b, ends_sha256."""
    order = [*NODE, "conv"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_list_pieces, "depth long, a long, b long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_list_digests, "depth long, a long, b long, ends_sha256 string")


# --- the trie


def prefix_trie(df: DataFrame) -> DataFrame:
    """df(conv_id, turn, role, text) -> one row for each node of the trie of rebuilt conversations."""
    spark = df.sparkSession
    small_batches(spark, 10_000)
    turns, convs = rebuilt_turns(df)
    rows = prefixes(turns)
    cells = sketch_cells(rows.count())
    sketch = shared_cells(rows, cells)
    maybe = lambda d, a, b: possibly_shared(d, a, b, sketch, cells)
    rows = rows.withColumns({"shared": maybe(F.col("depth"), F.col("a"), F.col("b")), "above": maybe(F.col("depth") - 1, F.col("pa"), F.col("pb"))})
    single = rows.where("NOT shared")

    # exact groups of what may be shared, and of the root
    lengths = rows.where("depth = 1").select(*CONV, "total", "length")
    roots = convs.join(lengths, CONV, "left").select(*CONV, *(F.lit(0).cast("long").alias(c) for c in ("depth", "a", "b", "pa", "pb", "chars", "before")), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "length")))
    members = materialize(rows.where("shared").drop("shared", "above").unionByName(roots), "shared-prefixes")
    tails = materialize(single.where("above").select(*CONV, "depth", "a", "b", "pa", "pb", "before", "length"), "tails")
    nodes = materialize(members.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min(F.when(F.col("known"), F.col("conv"))).alias("owner"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("before").alias("before")), "nodes")
    upper = (F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")
    children = materialize(nodes.where("depth > 0").select(*upper).unionByName(tails.select(*upper)).groupBy(*NODE).agg(F.count("*").alias("n_children")), "children")

    # of each conversation: from where on it is the smallest member, and whether a leaf is its own
    owner = F.coalesce("owner", F.lit(0)).alias("conv"), F.col("owner").isNotNull().alias("known")
    start = F.struct("depth", "before")
    leaves = nodes.join(children, NODE, "left_anti")
    facts = nodes.select(*owner, start.alias("start"), F.lit(0).alias("leaf")).unionByName(tails.select(*CONV, start.alias("start"), F.lit(0).alias("leaf")))
    nowhere = F.lit(None).cast("struct<depth: bigint, before: bigint>").alias("start")
    facts = facts.unionByName(leaves.select(*owner, nowhere, F.lit(1).alias("leaf"))).unionByName(single.where("depth = length").select(*CONV, nowhere, F.lit(1).alias("leaf")))
    facts = materialize(facts.groupBy(*CONV).agg(F.min("start").alias("start"), F.max("leaf").alias("leaf")), "member-facts")
    rest = F.col("total") - F.col("before")
    own = F.when(F.col("start.depth") <= F.col("depth"), rest).when(F.col("start").isNotNull(), F.col("total") - F.col("start.before")).otherwise(0)
    sums = members.join(facts, CONV, "left").groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum(rest - own).alias("saved_tokens"))

    lists = member_lists(members.where("depth = length AND known"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("parent"))
    nothing = sha256_of(F.lit(""))
    shared = nodes.join(children, NODE, "left").join(sums, NODE).join(lists, NODE, "left").join(parents, ["depth", "pa", "pb"], "left").select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "owner")).alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )

    def alone(rows: DataFrame, parent) -> DataFrame:
        me = F.when(F.col("known"), F.col("conv"))
        one = lambda n: F.lit(n).cast("long")
        ends = F.when((F.col("depth") == F.col("length")) & F.col("known"), sha256_of(F.col("conv").cast("string"))).otherwise(nothing)
        return rows.select(me.alias("conv_id"), "depth", parent.alias("parent_conv_id"), one(1).alias("n_convs"), F.when(F.col("depth") < F.col("length"), one(1)).otherwise(one(0)).alias("n_children"), one(1).alias("n_leaves"), one(0).alias("saved_tokens"), ends.alias("ends_sha256"))

    hanging = alone(tails.join(parents, ["depth", "pa", "pb"], "left"), F.col("parent"))
    inner = alone(single.where("NOT above"), F.when(F.col("known"), F.col("conv")))
    return shared.unionByName(hanging).unionByName(inner)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


_ORACLE = """
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), 4294967295) % 6 END AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
taken AS (SELECT c.conv_id, t.i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.i <= c.h),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d FROM (SELECT conv_id, 0 AS part, i, role, text FROM taken UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id WHERE i > h)),
p AS (SELECT conv_id, d, list(struct_pack(role := role, text := text)) OVER (PARTITION BY conv_id ORDER BY d) AS seq, length(text) AS chars, count(*) OVER (PARTITION BY conv_id) AS m FROM r
  UNION ALL SELECT c.conv_id, 0, [], 0, (SELECT count(*) FROM r WHERE r.conv_id IS NOT DISTINCT FROM c.conv_id) FROM c),
n AS (SELECT d AS depth, seq, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = m), '') AS ends FROM p GROUP BY d, seq),
k AS (SELECT n.depth, n.seq, n.conv_id, n.n_convs, n.chars, n.ends, q.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.seq[1:n.depth] = n.seq) AS n_children FROM n LEFT JOIN n q ON q.depth = n.depth - 1 AND q.seq = n.seq[1:n.depth - 1])
SELECT k.conv_id, k.depth, k.parent_conv_id, k.n_convs, k.n_children, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.chars)::BIGINT AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN k x ON x.depth >= k.depth AND x.seq[1:k.depth] = k.seq GROUP BY k.conv_id, k.depth, k.seq, k.parent_conv_id, k.n_convs, k.n_children, k.ends
"""
QUERIES = {"op12_prefix_trie": (op12_prefix_trie, _ORACLE)}
