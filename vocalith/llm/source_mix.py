"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow whose share of the total budget (all words) is its target. Its documents are shuffled by hash
and served one after another, again from the start for up to three epochs; a copy's virtual finish time is the
words its source has served up to its end, divided by the source's target. Whole copies of all sources are ordered by virtual finish and taken until
the budget is spent; only the copy in which it ends is cut. At any virtual time all flows have had nearly the same share of their targets, so the mix ends near virtual time 1 and each source
has its target, but for less than a document.

Cumulative sums are in two levels (hash range, then within it), so that a source with a third of all rows
is spread over as many tasks as there are ranges. The end of the budget is found by summing words by ranges of virtual time; only the range in which it lies is put in order.

Defined results: a null or blank text has size 0 and nothing is taken from it; null is a source of its own, last; rows that share an id, or have none, are
shuffled by their texts as well; ties of the shuffle go by doc_id, size and text hash; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalith.llm.common import fresh, materialize, table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
RANGE_BITS = 12
DRAW_BITS = 60
#: Ranges of virtual time from 0 to 1.
RANGES = 1 << 16


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffle_draw(key, text, seed: int):
    """60 bits of the md5 of ``seed:key:md5 of the text``; a null key is left out."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.md5(F.coalesce(text, F.lit(""))))), 1, DRAW_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source_null, source_name, source_size) -> also target, and budget (all words). One row per source.

    Sharing by weight with a cap of max_epochs x size, and sharing the excess again until none is above, ends
    at target = min(cap, level x weight). In order of cap / weight the capped sources come first, and the level
    is that of the first source which is not above it.
    """
    cycle = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(W.orderBy(*SOURCE)) - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(max_epochs))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), *SOURCE)
    before, all_of = by_cap.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.sum("source_size").over(all_of) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    found = ranked.withColumn("level", level)
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), *SOURCE, "level"))).over(all_of)
    target = F.least(F.coalesce(F.col("line") * F.col("weight"), F.col("cap")), F.col("cap"))
    return found.withColumn("line", first["level"]).select(*SOURCE, "source_size", target.alias("target"), F.sum("source_size").over(all_of).alias("budget"))


#: A source as two columns without nulls, in the order of sources; joins and windows on them share one exchange.
SOURCE = ["source_null", "source_name"]


def _keyed(source: Column) -> list[Column]:
    return [source.isNull().alias("source_null"), F.coalesce(source.cast("string"), F.lit("")).alias("source_name")]


def _finish(epoch: int) -> Column:
    return F.try_divide(F.col("begin") + F.col("size") + F.col("source_size") * epoch, F.col("target"))


def budget_cut(copies: DataFrame) -> DataFrame:
    """copies(finish, source_null, source_name, words) and the budget, the sum of all first copies' words, as `budget` of each -> one row (cut_finish, cut_null, cut_name, cut_words): the copy in which the
    budget ends in the order of (finish, source), and how many of its words it reaches.

    Words are summed by ranges of virtual time, then by range up to the one in which the budget ends; only that range is put in order.
    """
    slot = F.least(F.floor(F.col("finish") * RANGES), F.lit(2 * RANGES)).cast("int")
    ranged = copies.withColumn("slot", slot)
    sums = ranged.groupBy("slot").agg(F.sum("words").alias("n"), F.max("budget").alias("budget")).withColumn("upto", F.sum("n").over(W.orderBy("slot")))
    last = sums.where("upto >= budget").orderBy("slot").limit(1).select(F.col("slot").alias("last"), (F.col("budget") - F.col("upto") + F.col("n")).alias("room"))
    inside = ranged.join(F.broadcast(last), F.col("slot") == F.col("last")).withColumn("upto", F.sum("words").over(W.orderBy("finish", *SOURCE).rowsBetween(W.unboundedPreceding, 0)))
    return inside.where("upto >= room").orderBy("upto").limit(1).select(F.col("finish").alias("cut_finish"), F.col("source_null").alias("cut_null"), F.col("source_name").alias("cut_name"), (F.col("room") - F.col("upto") + F.col("words")).alias("cut_words"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, virtual_finish (of the first copy), then `keep` columns."""
    numbers = [F.col(id_col).alias("id"), *_keyed(F.col(source_col)), word_count(F.col(text_col)).alias("size"), shuffle_draw(F.col(id_col), F.col(text_col), seed).alias("draw"), F.xxhash64(F.col(text_col)).alias("tie")]
    sizes = materialize(df.select(*numbers), "sizes")
    in_range = F.shiftrightunsigned("draw", DRAW_BITS - RANGE_BITS).alias("range")
    ranges = sizes.groupBy(*SOURCE, in_range).agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy(*SOURCE).agg(F.sum("range_size").alias("source_size")))
    starts = ranges.withColumn("before_range", F.sum("range_size").over(W.partitionBy(*SOURCE).orderBy("range")) - F.col("range_size"))
    starts = materialize(starts.join(targets, SOURCE).select(*SOURCE, "range", "before_range", "source_size", "target", "budget"), "starts")
    place = [*SOURCE, "range"]
    line = W.partitionBy(*place).orderBy("draw", "id", "size", "tie").rowsBetween(W.unboundedPreceding, 0)

    def served(rows: DataFrame) -> DataFrame:
        placed = rows.select("*", in_range).withColumn("upto", F.sum("size").over(line)).join(starts.hint("merge"), place)
        return placed.withColumn("begin", F.col("before_range") + F.col("upto") - F.col("size"))

    copies = served(sizes).where("size > 0").select(*SOURCE, F.col("size").alias("words"), "budget", F.explode(F.array(*map(_finish, range(MAX_EPOCHS)))).alias("finish"))
    cut = materialize(budget_cut(copies), "cut")
    rows = served(df.select(F.struct(*keep).alias("kept"), *numbers) if keep else sizes).join(F.broadcast(cut), F.lit(1) == F.lit(1), "left")
    source, cut_source = F.struct(*SOURCE), F.struct("cut_null", "cut_name")
    taken = F.lit(0).cast("long")
    for e in range(MAX_EPOCHS):
        f = _finish(e)
        whole = (f < F.col("cut_finish")) | ((f == F.col("cut_finish")) & (source < cut_source))
        ends = (f == F.col("cut_finish")) & (source == cut_source)
        taken = taken + F.when(F.col("size") == 0, 0).when(whole, F.col("size")).when(ends, F.col("cut_words")).otherwise(0)
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), F.when(F.col("target") > 0, _finish(0)).alias("virtual_finish"), *(["kept.*"] if keep else []))


def apply_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix in its order, range-sorted by virtual finish time: df's columns (id first), then size, taken and virtual_finish."""
    held = [c for c in df.columns if c != id_col]
    names = {n: fresh(df, n) for n in ("size", "taken", "virtual_finish")}
    plain = df.select(id_col, text_col, source_col, F.struct(*held).alias("held__") if held else F.lit(None).alias("held__"))
    mixed = mix_sources(plain, id_col, text_col, source_col, keep=("held__",))
    chosen = mixed.where("taken > 0").select(id_col, *[F.col("held__")[c].alias(c) for c in held], *[F.col(k).alias(v) for k, v in names.items()])
    return chosen.orderBy(names["virtual_finish"], id_col)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


_ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(concat_ws(':', '7', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w FROM d GROUP BY source),
l AS (SELECT *, source_size * 3.0::DOUBLE AS cap, (sum(source_size) OVER () - coalesce(sum(source_size * 3.0::DOUBLE) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(coalesce((SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1) * w, cap), cap) AS target FROM l),
p AS (SELECT d.*, source_size, target, (sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id NULLS FIRST, size))::BIGINT AS finish FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT r, size, sum(size) OVER (ORDER BY (finish + e * source_size) / target, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto FROM p, (SELECT unnest(range(3)) AS e) WHERE size > 0),
taken AS (SELECT r, sum(greatest(0, least(size, (SELECT sum(size) FROM d) - upto + size)))::BIGINT AS taken FROM copies GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, CASE WHEN target > 0 THEN finish / target END::DOUBLE AS virtual_finish FROM p LEFT JOIN taken ON p.r = taken.r
"""
QUERIES = {"op2_source_mix": (op2_source_mix, _ORACLE)}
