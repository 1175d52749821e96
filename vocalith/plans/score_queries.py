"""Queries for metrics, journals, sweeps and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocalith.functions.hashing import hash32
from vocalith.operators import generate as G
from vocalith.operators import journal as J
from vocalith.operators import metrics as S
from vocalith.operators import trials as T
from vocalith.plans import fixtures as X
from vocalith.plans.registry import query

K = 3
_H = X.h_sql


def _f1(c: int, w: str = "1") -> str:
    n = f"(coalesce(sum({w}) FILTER (label = {c}), 0) + coalesce(sum({w}) FILTER (prediction = {c}), 0))"
    return f"(CASE WHEN {n} = 0 THEN 0.0 ELSE 2.0 * coalesce(sum({w}) FILTER (label = {c} AND prediction = {c}), 0) / {n} END)::DOUBLE"


_MACRO = "(" + " + ".join(_f1(c) for c in range(K)) + ") / 3"


@query("confusion_matrix", X.sql("preds", "SELECT a.label, b.prediction, count(uid) AS n FROM (VALUES (0), (1), (2), (3)) a(label) CROSS JOIN (VALUES (0), (1), (2), (3)) b(prediction) LEFT JOIN preds p ON p.label = a.label AND p.prediction = b.prediction GROUP BY ALL"))
def _(spark, d):
    """With a fourth declared class that never occurs."""
    return S.confusion_matrix(X.preds(spark, d), 4)


@query("per_class_f1", X.sql("preds", " UNION ALL ".join(f"SELECT fold, {c} AS class, round({_f1(c)}, 6) AS f1 FROM preds GROUP BY fold" for c in range(K))))
def _(spark, d):
    return S.per_class_f1(X.preds(spark, d), K, ["fold"])


@query("macro_f1", X.sql("preds", f"SELECT fold, round({_MACRO}, 6) AS macro_f1 FROM preds GROUP BY fold"))
def _(spark, d):
    return S.macro_f1(X.preds(spark, d), K, ["fold"])


@query("accuracy", X.sql("preds", "SELECT fold, round(avg((label = prediction)::INTEGER), 6) AS accuracy FROM preds GROUP BY fold"))
def _(spark, d):
    return S.accuracy(X.preds(spark, d), ["fold"])


_EACH = f"each AS (SELECT fold, {_MACRO} AS m, count(*) AS n FROM preds GROUP BY fold)"


@query("cv_summary", X.sql("preds", f"SELECT count(*) AS num_folds, sum(n)::BIGINT AS recordings, round(avg(m), 6) AS mean_macro_f1, round(stddev_samp(m), 6) AS std_macro_f1, arg_min(fold, m) AS worst_fold, round(min(m), 6) AS worst_macro_f1, (SELECT round({_MACRO}, 6) FROM preds) AS out_of_fold_macro_f1 FROM each", _EACH))
def _(spark, d):
    return S.cv_summary(X.preds(spark, d), K)


# --- bootstrap over all recordings

#: The reference's default number of replicates.
SAMPLES = 10_000


#: n draws below n for each replicate, four from each md5.
_DRAWS = f"draws AS (SELECT r, ('0x' || substr(md5, 8 * k + 1, 8))::BIGINT % n AS index FROM (SELECT r, n, j, md5('b:' || r || ':' || j) AS md5, unnest(range(4)) AS k FROM (SELECT unnest(range({SAMPLES}))::INTEGER AS r), (SELECT count(*) AS n FROM units), LATERAL (SELECT unnest(range((n + 3) // 4)) AS j)) WHERE 4 * j + k < n)"
_CI = "SELECT count(*) AS replicates, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(stddev_samp(m), 6) AS se, round(avg(m), 6) AS mean, (SELECT count(*) FROM units) AS units FROM reps"
_GROUPS = "groups AS (SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS index FROM (SELECT DISTINCT group_id FROM preds)), units AS (SELECT index FROM groups), members AS (SELECT index, label, prediction, count(*) AS c FROM preds JOIN groups USING (group_id) GROUP BY ALL)"
_LOG_FACTORIAL = "((k + 9.0::DOUBLE) - 0.5) * ln(k + 9.0::DOUBLE) - (k + 9.0::DOUBLE) + 0.9189385332046727::DOUBLE + 1 / (12 * (k + 9.0::DOUBLE)) - 1 / (360 * power(k + 9.0::DOUBLE, 3)) + 1 / (1260 * power(k + 9.0::DOUBLE, 5)) - ln(" + " * ".join(f"(k + {i}.0::DOUBLE)" for i in range(1, 9)) + ")"
#: Draws of rows by cells: Poisson numbers, then single draws up to n. w is a cell's number of draws.
_CELLS = f"""units AS (SELECT * FROM preds), total AS (SELECT count(*) AS n FROM preds),
cells AS (SELECT a.c AS cell, a.c // 4 AS label, a.c % 4 AS prediction, count(uid) AS size FROM (SELECT unnest(range(12)) AS c) a LEFT JOIN preds ON label * 4 + prediction = c GROUP BY a.c),
rated AS (SELECT *, sum(size) OVER (ORDER BY cell) - size AS low, greatest(0.0::DOUBLE, n - 6 * sqrt(n)) * size / n AS rate FROM cells, total),
steps AS (SELECT cell, rate, unnest(range(greatest(0, floor(rate - 9 * sqrt(rate) - 10))::BIGINT, ceil(rate + 9 * sqrt(rate) + 10)::BIGINT + 1)) AS k FROM rated),
masses AS (SELECT cell, k, coalesce(sum(p) OVER (PARTITION BY cell ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM (SELECT cell, k, CASE WHEN rate = 0 THEN (k = 0)::INTEGER ELSE exp(k * ln(rate) - rate - ({_LOG_FACTORIAL})) END::DOUBLE AS p FROM steps)),
asked AS (SELECT r, cell, ({_H("'bp:' || r || ':' || cell")} + 0.5::DOUBLE) / 4294967296 AS u FROM (SELECT unnest(range({SAMPLES}))::INTEGER AS r), (SELECT cell FROM cells)),
pooled AS (SELECT r, a.cell AS cell, k FROM asked a ASOF JOIN masses m ON a.cell = m.cell AND a.u >= m.u),
lacking AS (SELECT r, n, n - sum(k)::BIGINT AS lack FROM pooled, total GROUP BY r, n),
singles AS (SELECT r, ('0x' || substr(md5, 8 * k + 1, 8))::BIGINT % n AS index FROM (SELECT r, n, lack, j, md5('b:' || r || ':' || j) AS md5, unnest(range(4)) AS k FROM lacking, LATERAL (SELECT unnest(range((lack + 3) // 4)) AS j)) WHERE 4 * j + k < lack),
extra AS (SELECT r, cell, count(*) AS k FROM singles JOIN rated ON index >= low AND index < low + size GROUP BY ALL),
drawn AS (SELECT r, label, prediction, sum(k)::BIGINT AS w FROM (SELECT * FROM pooled UNION ALL SELECT * FROM extra) JOIN cells USING (cell) GROUP BY ALL),
reps AS (SELECT r, ({" + ".join(_f1(c, "w") for c in range(K))}) / 3 AS m FROM drawn GROUP BY r)"""


@query("bootstrap_draws", X.sql("preds", "SELECT replicate, sum(n)::BIGINT AS draws, count(*) AS units, max(n) AS most, sum(index * n)::BIGINT AS total FROM (SELECT r AS replicate, index, count(*) AS n FROM draws GROUP BY ALL) GROUP BY 1", f"{_GROUPS}, {_DRAWS}"))
def _(spark, d):
    """All groups are drawn in each replicate."""
    units = S.resampling_units(X.preds(spark, d), K, "group_id")
    drawn = S.bootstrap_counts(units, SAMPLES)
    return drawn.groupBy("replicate").agg(F.sum("n").alias("draws"), F.count("*").alias("units"), F.max("n").alias("most"), F.sum(F.col("index") * F.col("n")).alias("total"))


@query("bootstrap_ci", X.sql("preds", _CI, _CELLS))
def _(spark, d):
    return S.bootstrap_ci(X.preds(spark, d), K, SAMPLES)


_PARTS = [f"{part}{c}" for part in ("tp", "actual", "predicted") for c in range(K)]


def _mix_sql(source: str, name: str) -> str:
    """CTEs that mix r with the words one and two, step by step; the last is `name`(…, x)."""
    steps, last = [], source
    for i, (word, half) in enumerate([(w, k) for w in ("0", "one", "two") for k in range(3)]):
        x = f"xor(x, {word})" if half == 0 and word != "0" else "x"
        step = f"(xor(v, v >> 16) * {S.MIX_FACTOR}) % 4294967296" if half < 2 else "xor(v, v >> 16)"
        now = name if i == 8 else f"{name}{i}"
        steps.append(f"{now} AS (SELECT * EXCLUDE (x, v), {step} AS x FROM (SELECT *, {x} AS v FROM {last}))")
        last = now
    return ", ".join(steps)


#: Draws of groups by lists of counts: Poisson numbers, then single draws up to n.
_GROUP_CELLS = f"""per AS (SELECT group_id, {", ".join(f"count(*) FILTER ({cond})::BIGINT AS {part}{c}" for part, t in (("tp", "label = {c} AND prediction = {c}"), ("actual", "label = {c}"), ("predicted", "prediction = {c}")) for c in range(K) for cond in [t.format(c=c)])} FROM preds GROUP BY 1),
units AS (SELECT row_number() OVER (ORDER BY group_id) - 1 AS index, {", ".join(_PARTS)} FROM per), total AS (SELECT count(*) AS n FROM units),
alike AS (SELECT *, times * (greatest(0.0::DOUBLE, n - 6 * sqrt(n)) / n) AS rate, ('0x' || substr(md5, 1, 8))::BIGINT AS one, ('0x' || substr(md5, 9, 8))::BIGINT AS two FROM (
  SELECT {", ".join(_PARTS)}, count(*) AS times, md5('bg:' || {" || ':' || ".join(_PARTS)}) AS md5 FROM units GROUP BY ALL), total),
steps AS (SELECT rate, unnest(range(greatest(0, floor(rate - 9 * sqrt(rate) - 10))::BIGINT, ceil(rate + 9 * sqrt(rate) + 10)::BIGINT + 1)) AS k FROM (SELECT DISTINCT rate FROM alike)),
masses AS (SELECT rate, k, coalesce(sum(p) OVER (PARTITION BY rate ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM (SELECT rate, k, CASE WHEN rate = 0 THEN (k = 0)::INTEGER ELSE exp(k * ln(rate) - rate - lgamma(k + 1)) END::DOUBLE AS p FROM steps)),
asked AS (SELECT r, one, two, rate, {", ".join(_PARTS)}, r::BIGINT AS x FROM (SELECT unnest(range({SAMPLES}))::INTEGER AS r), alike),
{_mix_sql("asked", "mixed")},
pooled AS (SELECT r, sum(k)::BIGINT AS pooled, {", ".join(f"sum(k * {c})::BIGINT AS {c}" for c in _PARTS)} FROM (SELECT a.*, k FROM (SELECT *, (x + 0.5::DOUBLE) / 4294967296 AS w FROM mixed) a ASOF JOIN masses m ON a.rate = m.rate AND a.w >= m.u) GROUP BY r),
lacking AS (SELECT r, n, n - pooled AS lack FROM pooled, total),
singles AS (SELECT r, ('0x' || substr(md5, 8 * k + 1, 8))::BIGINT % n AS index FROM (SELECT r, n, lack, j, md5('b:' || r || ':' || j) AS md5, unnest(range(4)) AS k FROM lacking, LATERAL (SELECT unnest(range((lack + 3) // 4)) AS j)) WHERE 4 * j + k < lack),
sums AS (SELECT r, {", ".join(f"sum({c})::BIGINT AS {c}" for c in _PARTS)} FROM (SELECT r, {", ".join(_PARTS)} FROM pooled UNION ALL SELECT r, {", ".join(_PARTS)} FROM singles JOIN units USING (index)) GROUP BY r),
reps AS (SELECT r, ({" + ".join(f"CASE WHEN actual{c} + predicted{c} = 0 THEN 0.0 ELSE 2.0 * tp{c} / (actual{c} + predicted{c}) END::DOUBLE" for c in range(K))}) / 3 AS m FROM sums)"""


@query("bootstrap_ci_grouped", X.sql("preds", _CI, _GROUP_CELLS))
def _(spark, d):
    return S.bootstrap_ci(X.preds(spark, d), K, SAMPLES, group="group_id")


_REPORT_SQL = X.sql("preds", f"SELECT (SELECT count(*) FROM preds) AS recordings, (SELECT round({_MACRO}, 6) FROM preds) AS macro_f1, (SELECT round(avg((label = prediction)::INTEGER), 6) FROM preds) AS accuracy, (SELECT list(f1 ORDER BY c) FROM f) AS per_class_f1, ci.* FROM ({_CI}) ci", f"{_CELLS}, f AS (" + " UNION ALL ".join(f"SELECT {c} AS c, round({_f1(c)}, 6) AS f1 FROM preds" for c in range(K)) + ")")


@query("evaluation_report", _REPORT_SQL)
def _(spark, d):
    from vocalith.plans.reports import evaluation_report

    return evaluation_report(X.preds(spark, d), K, samples=SAMPLES)


@query("ensemble_join", X.sql("model_preds", "SELECT uid, label, count(*) AS n, CASE WHEN count(*) <> 5 THEN 'rows' WHEN max(abs(proba[1] + proba[2] + proba[3] - 1)) > 1e-6 THEN 'probabilities' END AS problem FROM (SELECT uid, model, label, CASE WHEN uid % 100 = 4 THEN [proba[1] / 2, proba[2], proba[3]] ELSE proba END AS proba FROM model_preds WHERE NOT (uid % 100 = 3 AND model = 2)) GROUP BY uid, label"))
def _(spark, d):
    """With planted faults: missing models and probabilities that do not sum to 1."""
    p = X.model_preds(spark, d).where("NOT (uid % 100 = 3 AND model = 2)")
    p = p.withColumn("proba", F.when(F.col("uid") % 100 == 4, F.transform("proba", lambda x, i: F.when(i == 0, x / 2).otherwise(x))).otherwise(F.col("proba")))
    return S.ensemble_join(p, 5).select("uid", "label", F.size("probas").cast("long").alias("n"), "problem")


_ENSEMBLE = "ens AS (SELECT uid, label, p, (list_position(p, list_max(p)) - 1)::INTEGER AS prediction FROM (SELECT uid, min(label) AS label, [" + ", ".join(X.mean_sql(f"proba[{c}]") for c in (1, 2, 3)) + "] AS p FROM model_preds GROUP BY uid))"


@query("ensemble_mean", X.sql("model_preds", "SELECT uid, label, p AS proba, prediction FROM ens", _ENSEMBLE))
def _(spark, d):
    return S.ensemble_mean(X.model_preds(spark, d), K).select("uid", "label", "proba", "prediction")


#: As _CELLS, for each system.
_SYSTEM_CELLS = f"""systems AS (SELECT 'ensemble' AS system, uid, label, prediction FROM ens UNION ALL SELECT 'model ' || model, uid, label, (list_position(proba, list_max(proba)) - 1)::INTEGER FROM model_preds),
total AS (SELECT system, count(*) AS n FROM systems GROUP BY 1),
cells AS (SELECT t.system, a.c AS cell, a.c // 4 AS label, a.c % 4 AS prediction, n, count(uid) AS size FROM total t CROSS JOIN (SELECT unnest(range(12)) AS c) a LEFT JOIN systems p ON p.system = t.system AND p.label * 4 + p.prediction = c GROUP BY ALL),
rated AS (SELECT *, sum(size) OVER (PARTITION BY system ORDER BY cell) - size AS low, greatest(0.0::DOUBLE, n - 6 * sqrt(n)) * size / n AS rate FROM cells),
steps AS (SELECT system, cell, rate, unnest(range(greatest(0, floor(rate - 9 * sqrt(rate) - 10))::BIGINT, ceil(rate + 9 * sqrt(rate) + 10)::BIGINT + 1)) AS k FROM rated),
masses AS (SELECT system, cell, k, coalesce(sum(p) OVER (PARTITION BY system, cell ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM (SELECT system, cell, k, CASE WHEN rate = 0 THEN (k = 0)::INTEGER ELSE exp(k * ln(rate) - rate - ({_LOG_FACTORIAL})) END::DOUBLE AS p FROM steps)),
asked AS (SELECT system, r, cell, ({_H("'bp:' || r || ':' || cell")} + 0.5::DOUBLE) / 4294967296 AS u FROM (SELECT unnest(range({SAMPLES}))::INTEGER AS r), (SELECT system, cell FROM cells)),
pooled AS (SELECT a.system, r, a.cell, k FROM asked a ASOF JOIN masses m ON a.system = m.system AND a.cell = m.cell AND a.u >= m.u),
lacking AS (SELECT system, r, n, n - sum(k)::BIGINT AS lack FROM pooled JOIN total USING (system) GROUP BY system, r, n),
singles AS (SELECT system, r, ('0x' || substr(md5, 8 * k + 1, 8))::BIGINT % n AS index FROM (SELECT system, r, n, lack, j, md5('b:' || r || ':' || j) AS md5, unnest(range(4)) AS k FROM lacking, LATERAL (SELECT unnest(range((lack + 3) // 4)) AS j)) WHERE 4 * j + k < lack),
extra AS (SELECT s.system, r, cell, count(*) AS k FROM singles s JOIN rated c ON s.system = c.system AND index >= low AND index < low + size GROUP BY ALL),
drawn AS (SELECT system, r, label, prediction, sum(k)::BIGINT AS w FROM (SELECT * FROM pooled UNION ALL SELECT * FROM extra) JOIN cells USING (system, cell) GROUP BY ALL),
reps AS (SELECT system, r, ({" + ".join(_f1(c, "w") for c in range(K))}) / 3 AS m FROM drawn GROUP BY ALL),
ci AS (SELECT system, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM reps GROUP BY 1),
scores AS (SELECT system, count(*) AS recordings, {_MACRO} AS f1, round(avg((label = prediction)::INTEGER), 6) AS accuracy, [{", ".join(f"round({_f1(c)}, 6)" for c in range(K))}] AS per_class_f1 FROM systems GROUP BY 1),
models AS (SELECT round(avg(f1), 6) AS m, round(stddev_samp(f1), 6) AS sd FROM scores WHERE system <> 'ensemble')"""


@query("test_sheet", X.sql("model_preds", "SELECT system, recordings, round(f1, 6) AS macro_f1, accuracy, per_class_f1, low, high, CASE WHEN system = 'ensemble' THEN m END AS fold_mean, CASE WHEN system = 'ensemble' THEN sd END AS fold_sd FROM scores JOIN ci USING (system) CROSS JOIN models", f"{_ENSEMBLE}, {_SYSTEM_CELLS}"))
def _(spark, d):
    from vocalith.plans.reports import test_sheet

    return test_sheet(X.stored(X.model_preds(spark, d), "model-preds"), K, SAMPLES)


@query("describe_durations", "SELECT count(*) AS rows, count_if(v IS NULL) AS missing, count_if(v < 0) AS unreadable, round(avg(v) FILTER (v >= 0), 6) AS mean, round(stddev_samp(v) FILTER (v >= 0), 6) AS std, min(v) FILTER (v >= 0) AS min, round(quantile_cont(v, 0.25) FILTER (v >= 0), 6) AS q25, round(median(v) FILTER (v >= 0), 6) AS median, round(quantile_cont(v, 0.75) FILTER (v >= 0), 6) AS q75, max(v) FILTER (v >= 0) AS max FROM (SELECT CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN -1 ELSE value END AS v FROM events)")
def _(spark, d):
    e = X.load(spark, d, "events").select(F.when(F.col("event_id") % 50 == 0, None).when(F.col("event_id") % 50 == 1, -1.0).otherwise(F.col("value")).alias("v"))
    return S.describe_durations(e, "v")


@query("histogram", "SELECT b.bin, count(e.bin) AS n FROM (SELECT unnest(range(30))::INTEGER AS bin) b LEFT JOIN (SELECT least(29, floor((value - lo) * 30 / (hi - lo)))::INTEGER AS bin FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)) e ON b.bin = e.bin GROUP BY b.bin")
def _(spark, d):
    return S.histogram(X.load(spark, d, "events"), "value")


@query("population_stats", "SELECT round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS std FROM lineitem")
def _(spark, d):
    return S.population_stats(X.load(spark, d, "lineitem"), "l_extendedprice")


@query("weighted_mean", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted_mean FROM lineitem GROUP BY 1")
def _(spark, d):
    return S.weighted_mean(X.load(spark, d, "lineitem"), "l_discount", "l_quantity", ["l_returnflag"])


_CURVE_PRED = f"CASE WHEN rate > 0 AND {_H("'rob:' || system || ':' || rate || ':' || seed || ':' || uid")} % 100 < rate * k THEN (prediction + 1) % 3 ELSE prediction END"


@query("robustness_curve", X.sql("preds", "SELECT rate, round(avg(m) FILTER (system = 'plain'), 6) AS plain, round(avg(m) FILTER (system = 'robust'), 6) AS robust, round(100 * (avg(m) FILTER (system = 'robust') - avg(m) FILTER (system = 'plain')), 6) AS gain FROM each GROUP BY rate", f"rows AS (SELECT system, rate, seed, label, {_CURVE_PRED} AS prediction FROM preds, (VALUES ('plain', 2), ('robust', 1)) s(system, k), (VALUES (0), (10), (20)) r(rate), (VALUES (1), (2), (3)) z(seed)), each AS (SELECT system, rate, seed, round({_MACRO}, 6) AS m FROM rows GROUP BY ALL)"))
def _(spark, d):
    """Two systems whose predictions are corrupted at three rates with three seeds."""
    plan = F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.lit(k).alias("k"), F.lit(r).alias("rate"), F.lit(z).alias("seed")) for s, k in (("plain", 2), ("robust", 1)) for r in (0, 10, 20) for z in (1, 2, 3)]))
    p = X.preds(spark, d).select("uid", "label", "prediction", plan.alias("p")).select("uid", "label", "prediction", "p.*")
    hit = (F.col("rate") > 0) & (F.pmod(hash32(X.key("rob", "system", "rate", "seed", "uid")), F.lit(100)) < F.col("rate") * F.col("k"))
    return S.robustness_curve(p.withColumn("prediction", F.when(hit, (F.col("prediction") + 1) % 3).otherwise(F.col("prediction"))), K, ("plain", "robust"))


@query("fit_score_cv")
def _(spark, d):
    """Out-of-fold predictions of a class-weighted linear classifier over all vectors."""
    from vocalith.operators.fitting import fit_score_cv

    v = X.load(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("int"), (F.pmod(hash32(X.key("cv", "vec_id")), F.lit(5))).cast("int").alias("fold"))
    return fit_score_cv(v, "embedding")


# --- journals

_BEST = "best AS (SELECT *, metric > coalesce(previous_best, metric - 1) AND eligible AS saved FROM (SELECT *, max(CASE WHEN eligible THEN metric END) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_best FROM journal))"
_ISLAND = "waits AS (SELECT *, CASE WHEN island = 0 THEN p ELSE p - 1 END AS waited FROM (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY step) AS p FROM (SELECT *, sum(saved::INTEGER) OVER (PARTITION BY run ORDER BY step) AS island FROM best)))"


@query("running_best", X.sql("journal", "SELECT run, step, previous_best, saved, CASE WHEN NOT eligible THEN 'ineligible' WHEN NOT saved THEN 'no_improvement' WHEN previous_best IS NULL THEN 'first_eligible' ELSE 'strict_improvement' END AS reason FROM best", _BEST))
def _(spark, d):
    return J.running_best(X.journal(spark, d)).select("run", "step", "previous_best", "saved", "reason")


_SELECTED = "picked AS (SELECT run, max(step) AS step, arg_max(metric, step) AS metric FROM best WHERE saved GROUP BY run)"


@query("selected_checkpoint", X.sql("journal", "SELECT * FROM picked", f"{_BEST}, {_SELECTED}"))
def _(spark, d):
    return J.selected_checkpoint(X.journal(spark, d))


@query("audit_journal", X.sql("journal", """SELECT run, step, 'previous best' AS problem FROM best WHERE step % 1700 = 0 AND previous_best IS NOT NULL UNION ALL SELECT run, step, 'saved' FROM best WHERE step % 2300 = 0
  UNION ALL SELECT run, step, 'schedule' FROM (SELECT run, step, max(step) OVER (PARTITION BY run) AS last FROM best) WHERE step % 200 <> 0 AND step <> last UNION ALL SELECT run, step + 100, 'selected checkpoint' FROM picked WHERE run % 10 = 3""", f"{_BEST}, {_SELECTED}"))
def _(spark, d):
    """With planted faults: wrong previous bests and decisions, an interval of twice the step, and a wrong selection in every tenth run."""
    j = X.journal(spark, d)
    stored = J.running_best(j).withColumn("stored_best", F.when(F.col("step") % 1700 == 0, F.col("previous_best") + 1).otherwise(F.col("previous_best"))).withColumn("stored_saved", F.when(F.col("step") % 2300 == 0, ~F.col("saved")).otherwise(F.col("saved")))
    chosen = J.selected_checkpoint(j).withColumn("step", F.when(F.col("run") % 10 == 3, F.col("step") + 100).otherwise(F.col("step")))
    return J.audit_journal(stored.select("run", "step", "metric", "eligible", "stored_best", "stored_saved"), chosen, 200)


@query("patience", X.sql("journal", "SELECT run, min(CASE WHEN waited >= 20 THEN step END) AS stop_step FROM waits GROUP BY run", f"{_BEST}, {_ISLAND}"))
def _(spark, d):
    return J.patience(X.journal(spark, d), 20)


@query("lr_schedule", X.sql("journal", "SELECT run, step, waited, round(0.1 * power(0.5, sum((waited > 0 AND waited % 8 = 0)::INTEGER) OVER (PARTITION BY run ORDER BY step)), 9)::DOUBLE AS rate FROM waits", f"{_BEST}, {_ISLAND}"))
def _(spark, d):
    return J.lr_schedule(X.journal(spark, d), 8, 0.5, 0.1).select("run", "step", F.col("waited").cast("long").alias("waited"), F.round("rate", 9).alias("rate"))


# --- sweeps

_SUMMARY = f"summary AS (SELECT trial, count(*) AS n_folds, {X.mean_sql('score')} AS mean, round(stddev_samp(score), 6) AS sd, count(*) = 5 AS complete FROM runs GROUP BY trial)"
_RANK = "row_number() OVER (ORDER BY mean DESC, sd ASC NULLS LAST, trial)"
_BASE = "base AS (SELECT mean AS baseline FROM summary WHERE trial = (SELECT min(trial) FROM summary))"


def _summary(spark, d):
    return T.trial_summary(X.runs(spark, d))


def _baseline(s):
    return s.groupBy().agg(F.min_by("mean", "trial").alias("mean"))


@query("rank_trials", X.sql("runs", f"SELECT *, {_RANK}::INTEGER AS rank FROM summary", _SUMMARY))
def _(spark, d):
    return T.rank_trials(_summary(spark, d))


@query("baseline_delta", X.sql("runs", f"SELECT trial, {_RANK}::INTEGER AS rank, round(mean - baseline, 6) AS delta, mean > baseline AS beats FROM summary, base", f"{_SUMMARY}, {_BASE}"))
def _(spark, d):
    s = _summary(spark, d)
    return T.baseline_delta(T.rank_trials(s), _baseline(s)).select("trial", "rank", "delta", "beats")


@query("best_trial", X.sql("runs", f"SELECT CASE WHEN mean > baseline THEN trial::VARCHAR ELSE 'baseline' END AS winner, greatest(mean, baseline) AS mean FROM (SELECT *, {_RANK} AS rank FROM summary), base WHERE rank = 1 AND (SELECT bool_and(complete) FROM summary)", f"{_SUMMARY}, {_BASE}"))
def _(spark, d):
    s = _summary(spark, d)
    return T.best_trial(s, _baseline(s))


@query("train_val_gap", X.sql("runs", f"SELECT trial, {X.mean_sql('train_score')} AS train_mean, round(stddev_samp(train_score), 6) AS train_sd, {X.mean_sql('score')} AS mean, round(stddev_samp(score), 6) AS sd, {X.mean_sql('(train_score - score)')} AS gap, count(score) || '/5' AS completed FROM runs GROUP BY trial"))
def _(spark, d):
    return T.train_val_gap(X.runs(spark, d))


def _four(x: str) -> str:
    return f"printf('%.4f', floor((round({x} * 1e6) + 50) / 100) / 1e4)"


_TESTS = "tests AS (SELECT trial, min(score) AS test_score FROM runs WHERE trial % 3 = 0 GROUP BY trial)"


def _tests(r):
    return r.where("trial % 3 = 0").groupBy("trial").agg(F.min("score").alias("test_score"))


@query("attach_test_scores", X.sql("runs", "SELECT trial, mean, coalesce(" + _four('test_score') + ", 'Not included') AS test FROM summary LEFT JOIN tests USING (trial)", f"{_SUMMARY}, {_TESTS}"))
def _(spark, d):
    r = X.runs(spark, d)
    return T.attach_test_scores(_summary(spark, d).select("trial", "mean"), _tests(r))


#: Runs with gaps: some trials have few folds, some none.
_GAPPY = "gappy AS (SELECT * FROM runs WHERE NOT (trial % 7 = 1 AND fold > 1) AND trial % 11 <> 2)"


def _gappy(spark, d):
    return X.runs(spark, d).where("NOT (trial % 7 = 1 AND fold > 1) AND trial % 11 <> 2")


@query("leaderboard", X.sql("runs", f"""SELECT t.trial, CASE WHEN n_folds = 5 THEN 'complete' WHEN n_folds > 0 THEN 'partial' ELSE 'pending' END AS state, rank, mean, sd, delta FROM (SELECT DISTINCT user_id AS trial FROM events) t LEFT JOIN (SELECT trial, count(*) AS n_folds FROM gappy GROUP BY 1) n USING (trial)
  LEFT JOIN (SELECT trial, {_RANK}::INTEGER AS rank, mean, sd, round(mean - baseline, 6) AS delta FROM s2, b2) r USING (trial)""", f"{_GAPPY}, s2 AS (SELECT trial, {X.mean_sql('score')} AS mean, round(stddev_samp(score), 6) AS sd FROM gappy GROUP BY trial HAVING count(*) = 5), b2 AS (SELECT mean AS baseline FROM s2 WHERE trial = (SELECT min(trial) FROM s2))"))
def _(spark, d):
    r = _gappy(spark, d)
    trials = X.load(spark, d, "events").select(F.col("user_id").alias("trial")).distinct()
    return T.leaderboard(r, trials, _baseline(T.trial_summary(r).where("complete")))


@query("sweep_sheet", X.sql("runs", f"""SELECT t.trial, CASE WHEN t.trial % 13 = 5 THEN 'Failed' WHEN n = 5 THEN 'Complete' WHEN n > 0 THEN 'Running' ELSE 'Queued' END AS status, coalesce(n, 0) || '/5' AS completed, train_mean, mean, sd, gap, by_fold, coalesce({_four("test_score")}, 'Not included') AS test FROM (SELECT DISTINCT user_id AS trial FROM events) t
  LEFT JOIN (SELECT trial, count(*) AS n, {X.mean_sql("train_score")} AS train_mean, {X.mean_sql("score")} AS mean, round(stddev_samp(score), 6) AS sd, {X.mean_sql("(train_score - score)")} AS gap, string_agg(fold || ': ' || {_four("score")}, '; ' ORDER BY fold) AS by_fold FROM gappy GROUP BY trial) g USING (trial) LEFT JOIN tests USING (trial)""", f"{_GAPPY}, {_TESTS}"))
def _(spark, d):
    trials = X.load(spark, d, "events").select(F.col("user_id").alias("trial")).distinct()
    return T.sweep_sheet(trials, _gappy(spark, d), _tests(X.runs(spark, d)), trials.where("trial % 13 = 5"))


# --- generators


@query("sliding_segments", "SELECT uid, CASE WHEN n >= 14000 THEN 7000 * k END AS start_ms FROM (SELECT o_orderkey AS uid, floor(o_totalprice)::BIGINT AS n, unnest(range(CASE WHEN floor(o_totalprice) < 14000 THEN 1 ELSE (floor(o_totalprice)::BIGINT - 14000) // 7000 + 1 END)) AS k FROM orders)")
def _(spark, d):
    return G.sliding_segments(X.cohort(spark, d), 14000, 7000).select("uid", "start_ms")


@query("fixed_crops", "SELECT o_orderkey AS uid, list_sort(list_distinct([i * room // 7 for i in range(8)])) AS crops, [room // 2] AS centre FROM (SELECT o_orderkey, greatest(0, floor(o_totalprice)::BIGINT - 14000) AS room FROM orders)")
def _(spark, d):
    c = X.cohort(spark, d)
    return c.select("uid", G.crop_starts(F.col("duration_ms"), 14000, 8, "train").alias("crops"), G.crop_starts(F.col("duration_ms"), 14000, 8, "validation").alias("centre"))


@query("sample_crop", f"SELECT uid, crops[({_H("'crop:3:2:' || uid")} % len(crops) + 1)::INTEGER] AS crop_start FROM (SELECT o_orderkey AS uid, list_sort(list_distinct([i * room // 7 for i in range(8)])) AS crops FROM (SELECT o_orderkey, greatest(0, floor(o_totalprice)::BIGINT - 14000) AS room FROM orders))")
def _(spark, d):
    return G.sample_crop(G.fixed_crops(X.cohort(spark, d), 14000, 8, "train"), 2, 3).select("uid", "crop_start")


@query("augmentation_plan", f"""WITH noises AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_name AS path, CASE p_partkey % 3 WHEN 0 THEN 'noise' WHEN 1 THEN 'speech' ELSE 'music' END AS type FROM part), n AS (SELECT count(*) AS n FROM noises)
SELECT uid, apply, CASE WHEN apply THEN effect END AS effect, CASE WHEN apply THEN path END AS noise, CASE WHEN apply THEN type END AS kind, CASE WHEN apply THEN round(15 + u * (CASE type WHEN 'music' THEN 5 ELSE 10 END), 6) END AS snr, CASE WHEN apply THEN crop END AS crop FROM (
  SELECT o_orderkey AS uid, {_H("'apply:9:' || o_orderkey")} / 4294967296.0::DOUBLE < 0.4 AS apply, ['noise', 'reverb', 'speed'][({_H("'effect:9:' || o_orderkey")} % 3 + 1)::INTEGER] AS effect, {_H("'noise:9:' || o_orderkey")} % n AS i, {_H("'snr:9:' || o_orderkey")} / 4294967296.0::DOUBLE AS u, round({_H("'crop:9:' || o_orderkey")} / 4294967296.0::DOUBLE, 6) AS crop FROM orders, n) JOIN noises USING (i)""")
def _(spark, d):
    kind = F.when(F.col("p_partkey") % 3 == 0, "noise").when(F.col("p_partkey") % 3 == 1, "speech").otherwise("music")
    noises = G.numbered(X.load(spark, d, "part").select("p_partkey", F.col("p_name").alias("path"), kind.alias("type")), "p_partkey").drop("p_partkey")
    return G.augmentation_plan(X.load(spark, d, "orders").select(F.col("o_orderkey").alias("uid")), noises, 0.4, ["noise", "reverb", "speed"], 9)
