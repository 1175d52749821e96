"""Sweeps: runs(trial, fold, score, train_score) ranked, compared with a baseline, and reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalith.operators.metrics import exact_mean
from vocalith.operators.ordering import global_index

def r6(c):
    return F.round(c, 6)


def trial_summary(runs: DataFrame, folds: int = 5) -> DataFrame:
    """(trial, n_folds, mean, sd, complete); the sd of one fold is null. Means are exact and rounded once."""
    return runs.groupBy("trial").agg(F.count("*").alias("n_folds"), exact_mean(F.col("score")).alias("mean"), r6(F.stddev_samp("score")).alias("sd")).withColumn("complete", F.col("n_folds") == folds)


def rank_trials(summary: DataFrame) -> DataFrame:
    """rank: mean from the top, then sd from the bottom, then id; by ranges, so that no task gets all trials."""
    return global_index(summary, F.desc("mean"), F.asc_nulls_last("sd"), "trial", name="rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def baseline_delta(ranking: DataFrame, baseline: DataFrame, matched: bool = True) -> DataFrame:
    """delta to the baseline's mean, and beats: above it, or the baseline was not run alike (then it can't win). baseline: one row (mean)."""
    b = F.broadcast(baseline.select(F.col("mean").alias("baseline")))
    return ranking.crossJoin(b).withColumn("delta", r6(F.col("mean") - F.col("baseline"))).withColumn("beats", (F.col("mean") > F.col("baseline")) | F.lit(not matched))


def best_trial(summary: DataFrame, baseline: DataFrame, matched: bool = True) -> DataFrame:
    """One row: the winner ('baseline' if it is ahead and was run alike), or none unless all trials are complete."""
    whole = summary.agg(F.coalesce(F.bool_and("complete"), F.lit(False)).alias("whole"))
    first = summary.orderBy(F.desc("mean"), F.asc_nulls_last("sd"), "trial").limit(1)
    top = baseline_delta(first, baseline, matched).crossJoin(F.broadcast(whole)).where("whole")
    return top.select(F.when(F.col("beats"), F.col("trial").cast("string")).otherwise("baseline").alias("winner"), F.when(F.col("beats"), F.col("mean")).otherwise(F.col("baseline")).alias("mean"))


def winner_parameters(summary: DataFrame, baseline: DataFrame, parameters: DataFrame, fixed: dict[str, str], matched: bool = True) -> DataFrame:
    """(winner, mean, parameters MAP) of `best_trial`: the fixed settings with those of the winning trial, or of the baseline. parameters(trial STRING, parameters MAP<STRING, STRING>), the baseline's
    under 'baseline'."""
    best = best_trial(summary, baseline, matched)
    same = F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv]) if fixed else F.expr("CAST(map() AS MAP<STRING, STRING>)")
    own = F.coalesce("parameters", F.expr("CAST(map() AS MAP<STRING, STRING>)"))
    joined = best.join(parameters.select(F.col("trial").alias("winner"), "parameters"), "winner", "left")
    return joined.select("winner", "mean", F.map_concat(F.map_filter(same, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own).alias("parameters"))


def train_val_gap(runs: DataFrame, folds: int = 5) -> DataFrame:
    """Means and sample sds of training and validation scores, their gap, and completed folds as k/5."""
    return runs.groupBy("trial").agg(exact_mean(F.col("train_score")).alias("train_mean"), r6(F.stddev_samp("train_score")).alias("train_sd"), exact_mean(F.col("score")).alias("mean"), r6(F.stddev_samp("score")).alias("sd"), exact_mean(F.col("train_score") - F.col("score")).alias("gap"), F.concat(F.count("score").cast("string"), F.lit(f"/{folds}")).alias("completed"))


def four_digits(c) -> Column:
    """A score as text of four digits, rounded half up from its six."""
    return F.format_string("%.4f", F.floor((F.round(c * 1e6) + 50) / 100) / 1e4)


def attach_test_scores(report: DataFrame, tests: DataFrame, key: str = "trial") -> DataFrame:
    """test: the completed evaluation's score as text; 'Not included' where there is none, never 0."""
    return report.join(tests.select(key, F.col("test_score")), key, "left").withColumn("test", F.when(F.col("test_score").isNotNull(), four_digits(F.col("test_score"))).otherwise("Not included")).drop("test_score")


def leaderboard(runs: DataFrame, trials: DataFrame, baseline: DataFrame, folds: int = 5) -> DataFrame:
    """Every planned trial: rank, mean, sd and delta if complete; state complete, partial or pending."""
    s = trial_summary(runs, folds)
    ranked = baseline_delta(rank_trials(s.where("complete")), baseline).select("trial", "rank", "mean", "sd", "delta")
    out = trials.select("trial").join(s.select("trial", "n_folds", "complete"), "trial", "left").join(ranked, "trial", "left")
    return out.select("trial", F.when(F.col("complete"), "complete").when(F.col("n_folds") > 0, "partial").otherwise("pending").alias("state"), "rank", "mean", "sd", "delta")


def sweep_sheet(trials: DataFrame, runs: DataFrame, tests: DataFrame, failed: DataFrame, folds: int = 5) -> DataFrame:
    """One row a trial: status, completed, means, gap, the folds' scores as one text, and the test score."""
    gap = train_val_gap(runs, folds)
    each = runs.groupBy("trial").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fold", four_digits(F.col("score")).alias("s")))), lambda x: F.concat(x["fold"].cast("string"), F.lit(": "), x["s"])), "; ").alias("by_fold"), F.count("*").alias("n"))
    out = trials.select("trial").join(gap, "trial", "left").join(each, "trial", "left").join(failed.select("trial", F.lit(True).alias("bad")).distinct(), "trial", "left")
    status = F.when(F.col("bad"), "Failed").when(F.col("n") == folds, "Complete").when(F.col("n") > 0, "Running").otherwise("Queued")
    sheet = out.select("trial", status.alias("status"), F.coalesce("completed", F.lit(f"0/{folds}")).alias("completed"), "train_mean", "mean", "sd", "gap", "by_fold")
    return attach_test_scores(sheet, tests)
