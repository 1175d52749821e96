"""Queries for the cohort operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocalith.operators import cohort as C
from vocalith.plans import fixtures as X
from vocalith.plans.registry import query

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _labels(spark, d):
    return X.load(spark, d, "customer").select(F.col("c_name").alias("filename"), F.col("c_custkey").cast("string").alias("patient_id"), F.col("c_mktsegment").alias("diagnosis"))


_FOLDED = "folded AS (SELECT c.*, fold FROM cohort c JOIN (SELECT patient_id, diagnosis, ((row_number() OVER (PARTITION BY diagnosis ORDER BY md5('1234:' || patient_id), patient_id) - 1) % 5)::INTEGER AS fold FROM (SELECT DISTINCT patient_id, diagnosis FROM cohort)) f USING (patient_id, diagnosis))"


def _folded(spark, d):
    return C.assign_folds(X.cohort(spark, d), 5, 1234)


@query("cohort_filter", "SELECT c_name AS filename, c_custkey::VARCHAR AS patient_id, c_mktsegment AS diagnosis FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND trim(c_name) NOT IN ('', 'nan')")
def _(spark, d):
    return C.cohort_filter(_labels(spark, d), ["BUILDING", "MACHINERY", "FURNITURE"], ["FURNITURE"])


@query("encode_labels", "SELECT c_custkey::VARCHAR AS patient_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 END AS label FROM customer")
def _(spark, d):
    return C.encode_labels(_labels(spark, d), SEGMENTS[:4]).select("patient_id", "label")


@query("normalize_labels", "SELECT o_orderkey, CASE lower(o_orderpriority) WHEN '1-urgent' THEN 0 WHEN '2-high' THEN 1 WHEN '5-low' THEN 2 WHEN '3-medium' THEN 1 END AS label, lower(o_orderpriority) NOT IN ('1-urgent', '2-high', '5-low', '3-medium') AS violation FROM orders")
def _(spark, d):
    return C.normalize_labels(X.load(spark, d, "orders"), "o_orderpriority", ["1-Urgent", "2-High", "5-Low"], {"3-medium": 1}).select("o_orderkey", "label", "violation")


@query("null_fill_count", "SELECT count_if(event_type IS NULL) AS null_event_type, count_if(k IS NULL) AS null_k, count_if(coalesce(k, 'null_value') = 'null_value') AS n_filled FROM (SELECT event_type, CASE WHEN value < 5 THEN NULL ELSE props ->> '$.k' END AS k FROM events)")
def _(spark, d):
    e = X.load(spark, d, "events").select("event_type", F.when(F.col("value") >= 5, F.get_json_object("props", "$.k")).alias("k"))
    filled, counts = C.null_fill_count(e, {"event_type": "null_value", "k": "null_value"})
    return counts.crossJoin(filled.agg(F.count_if(F.col("k") == "null_value").alias("n_filled")))


@query("partition_filter", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderstatus = 'P'")
def _(spark, d):
    return C.partition_filter(X.load(spark, d, "orders"), ["1-URGENT", "2-HIGH"], "o_orderpriority", "o_orderstatus", "P").select("o_orderkey", "o_orderpriority")


@query("assign_folds", X.sql("cohort", "SELECT uid, patient_id, fold FROM folded", _FOLDED))
def _(spark, d):
    return _folded(spark, d).select("uid", "patient_id", "fold")


@query("holdout_80_20", X.sql("cohort", "SELECT CASE WHEN fold < 4 THEN 'train' ELSE 'validation' END AS split, count(*) AS n, count(DISTINCT patient_id) AS patients FROM folded GROUP BY 1", _FOLDED))
def _(spark, d):
    return C.holdout_80_20(_folded(spark, d), 5).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("patient_id").alias("patients"))


@query("select_split", X.sql("cohort", "SELECT uid, 'train' AS split FROM folded WHERE fold <> 2 UNION ALL SELECT uid, 'validation' FROM folded WHERE fold = 2", _FOLDED))
def _(spark, d):
    f = _folded(spark, d)
    c, folds = X.cohort(spark, d), f.select("patient_id", "fold").distinct()
    return C.select_split(c, folds, 2, "train").select("uid", F.lit("train").alias("split")).unionByName(C.select_split(c, folds, 2, "validation").select("uid", F.lit("validation").alias("split")))


@query("coverage_audit", X.sql("cohort", "SELECT 'held out several times' AS problem, uid::VARCHAR AS item FROM folded WHERE uid % 1000 = 7 UNION ALL SELECT 'never held out', uid::VARCHAR FROM folded WHERE uid % 1000 = 3 UNION ALL SELECT 'test unit in development', uid::VARCHAR FROM folded WHERE uid % 5000 = 1", _FOLDED))
def _(spark, d):
    """On a plan with planted faults: some units twice, some never, some of the test set."""
    f = _folded(spark, d)
    plan = f.where("uid % 1000 <> 3").unionByName(f.where("uid % 1000 = 7"))
    return C.coverage_audit(plan, X.cohort(spark, d), f.where("uid % 5000 = 1").select("uid"), SEGMENTS)


@query("partition_label_join", "SELECT d.doc_id, d.lang, l.quality, l.toxic, CASE WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, d):
    return C.partition_label_join(X.load(spark, d, "documents").select("doc_id", "lang"), X.load(spark, d, "labels"), "doc_id")


@query("exact_coverage", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS status FROM (SELECT doc_id FROM documents) d FULL JOIN (SELECT doc_id + 5 AS doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def _(spark, d):
    return C.exact_coverage(X.load(spark, d, "documents"), X.load(spark, d, "labels").select((F.col("doc_id") + 5).alias("doc_id")), "doc_id")


@query("class_counts", X.sql("cohort", "SELECT v.diagnosis, coalesce(n, 0) AS n FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('ABSENT')) v(diagnosis) LEFT JOIN (SELECT diagnosis, count(*) AS n FROM cohort GROUP BY 1) c USING (diagnosis)"))
def _(spark, d):
    return C.class_counts(X.cohort(spark, d), ["AUTOMOBILE", "BUILDING", "ABSENT"])


@query("class_weights", X.sql("cohort", "SELECT v.diagnosis, CASE WHEN n IS NULL THEN 0.0 ELSE round(sum(n) OVER () / n, 6) END::DOUBLE AS weight FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('ABSENT')) v(diagnosis) LEFT JOIN (SELECT diagnosis, count(*) AS n FROM cohort GROUP BY 1) c USING (diagnosis)"))
def _(spark, d):
    return C.class_weights(X.cohort(spark, d), ["AUTOMOBILE", "BUILDING", "ABSENT"])


@query("value_counts", "SELECT source, lang, n, round(100.0 * n / sum(n) OVER (PARTITION BY source), 6)::DOUBLE AS percent FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)")
def _(spark, d):
    return C.value_counts(X.load(spark, d, "documents"), "lang", ["source"])


@query("conflict_groups", "SELECT source, count(DISTINCT lang) AS n_values FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def _(spark, d):
    return C.conflict_groups(X.load(spark, d, "documents"), "source", "lang")


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return C.duplicate_keys(X.load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dataset_summary", X.sql("cohort", "SELECT fold, diagnosis, count(*) AS n, count(DISTINCT patient_id) AS patients, grouping(fold, diagnosis)::INTEGER AS level FROM folded GROUP BY ROLLUP (fold, diagnosis)", _FOLDED))
def _(spark, d):
    return C.dataset_summary(_folded(spark, d))


@query("batch_readiness", "SELECT count_if(o_orderstatus = 'F') AS completed, count_if(o_orderstatus = 'X') AS failed, count_if(o_orderstatus = 'O') AS pending, count_if(o_orderstatus = 'P') AS skipped, bool_and(o_orderstatus NOT IN ('X', 'O')) AS ready FROM orders")
def _(spark, d):
    return C.batch_readiness(X.load(spark, d, "orders"), "o_orderstatus", "F", "X", "O")


@query("concat_partitions", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'validation' ELSE 'test' END AS partition FROM orders")
def _(spark, d):
    o = X.load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    part = lambda s: o.where(F.col("o_orderstatus") == s).select("o_orderkey")
    return C.concat_partitions(train=part("F"), validation=part("O"), test=part("P"))


@query("dedup_recordings", "SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def _(spark, d):
    return C.dedup_recordings(X.load(spark, d, "documents").select("text", "doc_id", "source"), "text", "doc_id")


@query("set_difference", "SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id + 5 FROM labels) UNION ALL SELECT DISTINCT doc_id + 5, 'extra' FROM labels WHERE doc_id + 5 NOT IN (SELECT doc_id FROM documents)")
def _(spark, d):
    return C.set_difference(X.load(spark, d, "documents"), X.load(spark, d, "labels").select((F.col("doc_id") + 5).alias("doc_id")), "doc_id")


@query("set_overlap", X.sql("cohort", "SELECT DISTINCT patient_id FROM cohort WHERE uid % 2 = 0 INTERSECT SELECT patient_id FROM cohort WHERE uid % 3 = 0"))
def _(spark, d):
    c = X.cohort(spark, d)
    return C.set_overlap(c.where("uid % 2 = 0"), c.where("uid % 3 = 0"), "patient_id")


@query("held_out_union", X.sql("cohort", "SELECT count_if(fold <> 4) AS n_held_out, count(*) AS n_cohort, count_if(fold = 4) AS n_differ, count_if(fold = 4) = 0 AS equal FROM folded", _FOLDED))
def _(spark, d):
    return C.held_out_union(_folded(spark, d).where("fold <> 4"), X.cohort(spark, d))


@query("limit_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 3")
def _(spark, d):
    return C.limit_per_group(X.load(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 3)


@query("smoke_limit", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 7")
def _(spark, d):
    return C.smoke_limit(X.load(spark, d, "documents").select("doc_id", "source"), "doc_id", 7)


@query("stable_sort", "SELECT doc_id, source FROM documents ORDER BY doc_id")
def _(spark, d):
    return C.stable_sort(X.load(spark, d, "documents").select("doc_id", "source"), "doc_id")


_AXES = "segments AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)), states AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT o_orderstatus AS v FROM orders))"
_GRID = f"{_AXES}, grid AS (SELECT ((SELECT count(*) FROM states) * a.i + b.i)::INTEGER AS trial_index, 'segment-' || a.v || '_state-' || b.v AS trial_id, a.v AS segment, b.v AS state FROM segments a CROSS JOIN states b)"


def _grid(spark, d):
    """Axes: the market segments and the order states that occur."""
    axes = {"segment": X.load(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")), "state": X.load(spark, d, "orders").select(F.col("o_orderstatus").alias("state"))}
    return C.trial_grid(spark, axes)


@query("trial_grid", f"WITH {_GRID} SELECT * FROM grid")
def _(spark, d):
    return _grid(spark, d)


@query("config_diff", f"WITH {_GRID}, b AS (SELECT (SELECT min(v) FROM segments) AS s, (SELECT min(v) FROM states) AS t) SELECT trial_index, concat_ws(', ', CASE WHEN segment <> s THEN 'segment=' || segment END, CASE WHEN state <> t THEN 'state=' || state END) AS changed FROM grid, b")
def _(spark, d):
    """Each trial of the grid against the first value of each axis."""
    settings = F.create_map(F.lit("segment"), F.col("segment"), F.lit("state"), F.col("state"))
    (base,) = X.load(spark, d, "customer").agg(F.min("c_mktsegment")).first()
    (state,) = X.load(spark, d, "orders").agg(F.min("o_orderstatus")).first()
    return C.config_diff(_grid(spark, d).withColumn("settings", settings), {"segment": base, "state": state}).select("trial_index", "changed")


@query("experiment_matrix", f"WITH {_AXES} SELECT 'base' AS name, ['segment:segment=' || v, 'state:state=' || (SELECT v FROM states WHERE i = 0)] AS aliases FROM segments WHERE i = 0 UNION ALL SELECT 'segment:segment=' || v, []::VARCHAR[] FROM segments WHERE i > 0 UNION ALL SELECT 'state:state=' || v, []::VARCHAR[] FROM states WHERE i > 0")
def _(spark, d):
    """A family of variations for each axis; its values are the handful of segments and states that occur, the base has the first ones."""
    values = lambda t, c: [v for (v,) in X.load(spark, d, t).select(c).distinct().orderBy(c).collect()]
    axes = {"segment": values("customer", "c_mktsegment"), "state": values("orders", "o_orderstatus")}
    return C.experiment_matrix(spark, {k: v[0] for k, v in axes.items()}, {k: [{k: x} for x in v] for k, v in axes.items()}).select("name", "aliases")
