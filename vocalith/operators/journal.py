"""Checkpoint-decision journals: journal(run, step, metric, eligible), one row for each validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalith.operators.ordering import spread_scan


def by_step():
    return W.partitionBy("run").orderBy("step")


def running_best(journal: DataFrame, spread: bool = False) -> DataFrame:
    """previous_best, saved, reason: saved if eligible and strictly above the best eligible before it; the first eligible is saved. spread: for runs of any length, by `spread_scan`."""
    ok = F.col("eligible") & F.col("metric").isNotNull() & ~F.isnan("metric")
    best = F.max(F.when(ok, F.col("metric"))).over(by_step().rowsBetween(W.unboundedPreceding, -1))
    out = spread_scan(journal, ["run"], [F.col("step")], {"previous_best": ("max", F.when(ok, F.col("metric")))}) if spread else journal.withColumn("previous_best", best)
    saved = ok & (F.col("previous_best").isNull() | (F.col("metric") > F.col("previous_best")))
    reason = F.when(~ok, "ineligible").when(~F.col("saved"), "no_improvement").when(F.col("previous_best").isNull(), "first_eligible").otherwise("strict_improvement")
    return out.withColumn("saved", saved).withColumn("reason", reason)


def selected_checkpoint(journal: DataFrame) -> DataFrame:
    """(run, step, metric) of the last saved decision."""
    return running_best(journal).where("saved").groupBy("run").agg(F.max("step").alias("step"), F.max_by("metric", "step").alias("metric"))


def audit_journal(journal: DataFrame, selected: DataFrame, interval: int) -> DataFrame:
    """journal also with stored_best, stored_saved -> (run, step, problem): what the replay does not confirm. Steps must be multiples of the interval, but for
    the last one; selected(run, step, metric)."""
    replay = running_best(journal).withColumn("last", F.max("step").over(W.partitionBy("run")))
    problems = F.array_compact(F.array(
        F.when(~F.col("stored_best").eqNullSafe(F.col("previous_best")), "previous best"), F.when(F.col("stored_saved") != F.col("saved"), "saved"),
        F.when((F.col("step") % interval != 0) & (F.col("step") != F.col("last")), "schedule"),
    ))
    rows = replay.select("run", "step", F.explode(problems).alias("problem"))
    right = selected_checkpoint(journal).select("run", F.col("step").alias("s"), F.col("metric").alias("m"))
    wrong = selected.join(right, "run", "left").where(~(F.col("step").eqNullSafe(F.col("s")) & F.col("metric").eqNullSafe(F.col("m"))))
    return rows.unionByName(wrong.select("run", "step", F.lit("selected checkpoint").alias("problem")))


def since_saved(journal: DataFrame) -> DataFrame:
    """waited: validations since the last saved one (0 at it), counting from the start before any."""
    island = F.sum(F.col("saved").cast("int")).over(by_step().rowsBetween(W.unboundedPreceding, 0))
    marked = running_best(journal).withColumn("island", island)
    place = F.row_number().over(W.partitionBy("run", "island").orderBy("step"))
    return marked.withColumn("waited", F.when(F.col("island") == 0, place).otherwise(place - 1))


def patience(journal: DataFrame, n: int) -> DataFrame:
    """(run, stop_step): the first step at which n validations have passed since the last save; null if none."""
    return since_saved(journal).groupBy("run").agg(F.min(F.when(F.col("waited") >= n, F.col("step"))).alias("stop_step"))


def lr_schedule(journal: DataFrame, n: int, multiplier: float, base: float) -> DataFrame:
    """rate after each step: multiplied after every n validations without a save."""
    cut = ((F.col("waited") > 0) & (F.col("waited") % n == 0)).cast("int")
    cuts = F.sum(cut).over(by_step().rowsBetween(W.unboundedPreceding, 0))
    return since_saved(journal).withColumn("cuts", cuts).withColumn("rate", F.lit(base) * F.pow(F.lit(multiplier), F.col("cuts")))
