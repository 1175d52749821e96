"""Chat formatting by quotation linking.

Each message's lines are parsed into quote levels (leading ``>`` marks). What stands unquoted is the message's own
text; each run of lines of one level is a quoted passage. Passages are normalised and hashed, and joined to the messages of
the same conversation whose own text, or one of its unquoted runs, paragraphs or lines, has that hash. Of a passage without such a match the longest paragraph is
looked for as consecutive lines of own texts, by hash too; if there are more paragraphs, they must stand there in order. The latest earlier message is meant. A
message answers the latest message it quotes; it belongs to that message's thread, and the paths of turns from each thread's first message give the reply order.

Defined results: null and empty texts are messages with no text and no quotes; a quote that matches nothing, or only later
messages, links nothing; of messages that repeat a passage the latest one before the quote is meant; rows that repeat (conversation,
turn) keep their own text and share their place and their links; a null conversation is one of its own, and a null turn neither quotes nor is quoted; an empty table
gives no rows; other columns, whatever their names, are not read. A path is as long as the message's depth in its thread.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalith.llm.common import materialize, small_batches, table


def parse_quotes(text: str | None) -> list[tuple[int, str]]:
    """(level, passage) of each run of lines of one quote level; level 0 is the message's own text."""
    runs: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        level, rest = 0, line
        while (bare := rest.lstrip(" \t")).startswith(">"):
            level, rest = level + 1, bare[1:]
        rest = rest[1:] if level and rest.startswith(" ") else rest
        if runs and runs[-1][0] == level:
            runs[-1][1].append(rest)
        else:
            runs.append((level, [rest]))
    return [(level, "\n".join(lines)) for level, lines in runs]


def passage_hash(passage: str) -> str | None:
    words = passage.lower().split()
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()[:32] if words else None


def own_text(runs: list[tuple[int, str]]) -> str:
    return "\n".join(p.strip("\n") for level, p in runs if level == 0 and p.strip()).strip()


def own_hashes(own: str, runs: list[tuple[int, str]] = ()) -> list[str]:
    """Of the whole text, its unquoted runs, its paragraphs and its lines."""
    parts = [own, *(p for level, p in runs if level == 0), *own.split("\n\n"), *own.split("\n")]
    return sorted({h for p in parts if (h := passage_hash(p))})


def plain_lines(text: str) -> list[str]:
    return [" ".join(line.lower().split()) for line in text.split("\n")]


def paragraphs(text: str) -> list[list[str]]:
    """Runs of lines that are not blank, normalised."""
    return [list(group) for some, group in groupby(plain_lines(text), key=bool) if some]


def lines_hash(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()[:32]


def holds(own: str, passage: str) -> bool:
    """Whether the passage's paragraphs stand in order in the own text, each as consecutive lines (blank ones left out)."""
    lines, at = [x for x in plain_lines(own) if x], 0
    for part in paragraphs(passage):
        at = next((i + len(part) for i in range(at, len(lines) - len(part) + 1) if lines[i : i + len(part)] == part), 0)
        if not at:
            return False
    return at > 0


def _holds(own: pa.Array, passage: pa.Array) -> pa.Array:
    return pa.array(list(map(holds, own.to_pylist(), passage.to_pylist())), pa.bool_())


def run_hashes(own: str | None, sizes: list[int]) -> list[str]:
    """Of every run of so many consecutive lines."""
    lines = [x for x in plain_lines(own or "") if x]
    return sorted({lines_hash(lines[i : i + n]) for n in sizes for i in range(len(lines) - n + 1)})


def _run_hashes(own: pa.Array, sizes: pa.Array) -> pa.Array:
    return pa.array(list(map(run_hashes, own.to_pylist(), sizes.to_pylist())), pa.list_(pa.string()))


_PASSAGE = [("h", pa.string()), ("run", pa.string()), ("size", pa.int32()), ("parts", pa.int32()), ("passage", pa.string())]


def _passage(h: str, text: str) -> dict:
    """A quoted passage, with its longest paragraph's lines as a hash and a number, and the number of paragraphs."""
    parts = paragraphs(text)
    longest = max(parts, key=lambda p: (len(p), sum(map(len, p))))
    return {"h": h, "run": lines_hash(longest), "size": len(longest), "parts": len(parts), "passage": text}


def _parsed(batches):
    strings, passages = pa.list_(pa.string()), pa.list_(pa.struct(_PASSAGE))
    for batch in batches:
        own, quoted, hashes, deep = [], [], [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            runs = parse_quotes(text)
            own.append(own_text(runs))
            found = {h: p for level, p in reversed(runs) if level and (h := passage_hash(p))}
            quoted.append([_passage(h, found[h]) for h in sorted(found)])
            hashes.append(own_hashes(own[-1], runs))
            deep.append(max(level for level, _ in runs))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own, pa.string()), pa.array(quoted, passages), pa.array(hashes, strings), pa.array(deep, pa.int32())], names=["conv", "turn", "role", "own", "quoted", "hashes", "depth"])


def latest_before(quotes: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """quotes(conv, turn, h, key), sources(conv, turn, key) -> (conv, turn, h, source): the latest earlier turn with the key. Both sides meet in one window, so a
    key that many messages share costs its rows, not their pairs."""
    both = quotes.select("conv", "turn", "h", F.col(key).alias("k"), F.lit(None).cast(dict(sources.dtypes)["turn"]).alias("source"), F.lit(0).alias("side"))
    both = both.unionByName(sources.select("conv", "turn", F.lit(None).cast("string").alias("h"), F.col(key).alias("k"), F.col("turn").alias("source"), F.lit(1).alias("side")))
    line = W.partitionBy("conv", "k").orderBy("turn", "side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("source", F.last("source", ignorenulls=True).over(line)).where("side = 0 AND source IS NOT NULL").select("conv", "turn", "h", "source")


def _same(a: str, b: str, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(p) == F.col(q) for p, q in pairs], F.col(a).eqNullSafe(F.col(b)))


def link_quotes(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conversation, turn, role, thread_turn, parent_turn, reply_path, n_quotes, n_linked, quote_depth, text (own text only).

    reply_path are the turns from the thread's first message to this one. Within a conversation its order is the reply order: a message, then all
    that answers it, earlier answers first.
    """
    spark = df.sparkSession
    small_batches(spark)
    kinds = dict(df.dtypes)
    cut = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    parsed = materialize(cut.mapInArrow(_parsed, f"conv {kinds[conv_col]}, turn {kinds[turn_col]}, role {kinds[role_col]}, own string, quoted array<struct<h:string,run:string,size:int,parts:int,passage:string>>, hashes array<string>, depth int"), "messages")
    # one passage for each hash: rows that repeat (conversation, turn) may lay it out in other lines, and each layout counts
    quotes = parsed.where(F.size("quoted") > 0).select("conv", "turn", F.inline("quoted")).distinct()
    wanted = lambda q, k: q.select(F.col("conv").alias("c"), F.col(k).alias("g")).distinct()
    # only passages that their conversation quotes are kept, before the two sides meet
    sources = parsed.select("conv", "turn", F.explode("hashes").alias("h")).join(wanted(quotes, "h"), _same("conv", "c", ("h", "g")), "left_semi").distinct()
    whole = materialize(latest_before(quotes.select("conv", "turn", "h").distinct(), sources, "h"), "links")
    known = whole.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("h").alias("g"))
    rest = materialize(quotes.join(known, _same("conv", "c", ("turn", "t"), ("h", "g")), "left_anti"), "quotes")
    # of the others the longest paragraph must stand in the source: own texts' runs of so many lines are hashed
    sizes = rest.groupBy(F.col("conv").alias("c")).agg(F.collect_set("size").alias("sizes"))
    runs = parsed.select("conv", "turn", "own").join(sizes, _same("conv", "c")).select("conv", "turn", F.explode(F.arrow_udf(_run_hashes, "array<string>")(F.col("own"), F.col("sizes"))).alias("run"))
    runs = materialize(runs.join(wanted(rest, "run"), _same("conv", "c", ("run", "g")), "left_semi").distinct(), "runs")
    single = latest_before(rest.where("parts = 1"), runs, "run")
    other = runs.select(F.col("conv").alias("c"), F.col("turn").alias("source"), F.col("run").alias("g"))
    several = rest.where("parts > 1").join(other, _same("conv", "c", ("run", "g")) & (F.col("source") < F.col("turn"))).select("conv", "turn", "h", "passage", "source")
    several = several.join(parsed.select(F.col("conv").alias("c3"), F.col("turn").alias("t3"), "own"), _same("conv", "c3", ("source", "t3")))
    several = several.where(F.arrow_udf(_holds, "boolean")(F.col("own"), F.col("passage"))).select("conv", "turn", "h", "source")
    partly = single.unionByName(several).groupBy("conv", "turn", "h").agg(F.max("source").alias("source"))
    links = whole.unionByName(partly)
    parents = materialize(links.groupBy("conv", "turn").agg(F.max("source").alias("parent"), F.count_distinct("h").alias("linked")), "parents")
    # a message's thread is its parent's: halve the way to the root until nothing moves; path: the turns after `root`, up to the message
    up = parents.select("conv", "turn", F.col("parent").alias("root"), F.array("turn").alias("path"))
    while not up.isEmpty():
        far = up.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("far"), F.col("path").alias("head"))
        joined = up.join(far, _same("conv", "c", ("root", "t")), "left")
        up = materialize(joined.select("conv", "turn", F.coalesce("far", "root").alias("root"), F.when(F.col("far").isNull(), F.col("path")).otherwise(F.concat("head", "path")).alias("path"), F.col("far").isNotNull().alias("moved")), "threads")
        if up.where("moved").isEmpty():
            break
        up = up.drop("moved")
    roots = up.select(F.col("conv").alias("c2"), F.col("turn").alias("t2"), "root", "path")
    parents = parents.select(F.col("conv").alias("c1"), F.col("turn").alias("t1"), "parent", "linked")
    out = parsed.join(parents, _same("conv", "c1", ("turn", "t1")), "left").join(roots, _same("conv", "c2", ("turn", "t2")), "left")
    return out.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.coalesce("root", "turn").alias("thread_turn"), F.col("parent").alias("parent_turn"),
        F.when(F.col("root").isNull(), F.array("turn")).otherwise(F.concat(F.array("root"), F.col("path"))).alias("reply_path"),
        F.size("quoted").cast("long").alias("n_quotes"), F.coalesce("linked", F.lit(0)).cast("long").alias("n_linked"), F.col("depth").alias("quote_depth"), F.col("own").alias("text"),
    )


def reply_ordered(linked: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Conversations in reply order, range-partitioned so that a long one may span tasks."""
    return linked.orderBy(conv_col, "reply_path")


def op5_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(link_quotes(table(spark, sf_dir, "conversations")))


QUERIES = {"op5_quote_links": (op5_quote_links, None)}
