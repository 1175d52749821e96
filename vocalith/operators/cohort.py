"""Cohorts: filtering and encoding labels, folds by patient, key audits, set comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalith.functions.hashing import hash32


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- projections and filters


def cohort_filter(df: DataFrame, targets: list[str], ignore: list[str] = (), diagnosis: str = "diagnosis", required: tuple[str, ...] = ("filename", "patient_id")) -> DataFrame:
    """Rows of the target classes that are not ignored, with no blank or 'nan' in the required columns; text is trimmed."""
    names = [diagnosis, *required]
    out = df.withColumns({c: F.trim(c) for c in names})
    ok = F.col(diagnosis).isin([t for t in targets if t not in ignore])
    return out.where(reduce(lambda a, c: a & F.col(c).isNotNull() & ~F.col(c).isin("", "nan"), required, ok))


def encode_labels(df: DataFrame, classes: list[str], diagnosis: str = "diagnosis") -> DataFrame:
    """label: the place of the class in the declared order; null where it is not declared."""
    return df.withColumn("label", F.nullif(F.array_position(F.array(*map(F.lit, classes)), F.col(diagnosis)), F.lit(0)).cast("int") - 1)


def normalize_labels(df: DataFrame, column: str, classes: list[str], aliases: dict[str, int] | None = None) -> DataFrame:
    """label from a class name in any case, an id as text, or an alias; violation where nothing fits."""
    names = {**{c.lower(): i for i, c in enumerate(classes)}, **(aliases or {})}
    text = F.lower(F.trim(column))
    number = text.try_cast("int")
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    label = F.coalesce(F.element_at(table, text), F.when(number.between(0, len(classes) - 1), number))
    return df.withColumn("label", label).withColumn("violation", F.col("label").isNull())


def null_fill_count(df: DataFrame, fills: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """df with the sentinels filled in, and one row of null counts by column."""
    return df.fillna(fills), df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in fills])


def partition_filter(df: DataFrame, classes: list[str], column: str, partition: str, test: str = "test") -> DataFrame:
    """Rows of the classes, and all rows of the unlabelled test partition."""
    return df.where(F.col(column).isin(classes) | (F.col(partition) == test))


def config_diff(trials: DataFrame, base: dict[str, str], settings: str = "settings") -> DataFrame:
    """changed: the settings that differ from the base, as ``k=v, …`` by key."""
    standard = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])
    other = F.map_filter(settings, lambda k, v: ~v.eqNullSafe(F.try_element_at(standard, k)))
    return trials.withColumn("changed", F.array_join(F.transform(F.array_sort(F.map_entries(other)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "))


# --- folds


def assign_folds(df: DataFrame, k: int, seed: int, patient: str = "patient_id", diagnosis: str = "diagnosis") -> DataFrame:
    """fold: patients of each class in a seeded order, dealt out in turn; recordings follow their patient."""
    line = W.partitionBy(diagnosis).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(patient).cast("string"))), patient)
    folds = df.select(patient, diagnosis).distinct().withColumn("fold", ((F.row_number().over(line) - 1) % k).cast("int"))
    return df.join(folds, [patient, diagnosis])


def holdout_80_20(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """split: folds below max(1, int(0.8 k)) train, the others validate."""
    return df.withColumn("split", F.when(F.col(fold) < max(1, int(0.8 * k)), "train").otherwise("validation"))


def select_split(df: DataFrame, folds: DataFrame, k: int, split: str, patient: str = "patient_id") -> DataFrame:
    """Rows whose patient is in the held-out fold ('validation') or is not ('train')."""
    held = folds.where(F.col("fold") == k).select(patient).distinct()
    return df.join(held, patient, "left_semi" if split == "validation" else "left_anti")


def coverage_audit(folds: DataFrame, cohort: DataFrame, test: DataFrame, classes: list[str], key: str = "uid", patient: str = "patient_id", label: str = "diagnosis") -> DataFrame:
    """(problem, item): units not held out exactly once, patients in several folds, classes missing from a fold, test units in development."""
    item = lambda c: F.col(c).cast("string").alias("item")
    rows = lambda df, problem, c: df.select(F.lit(problem).alias("problem"), item(c))
    held = folds.groupBy(key).agg(F.count("*").alias("n"))
    every = folds.select("fold").distinct().crossJoin(cohort.sparkSession.createDataFrame([(c,) for c in classes], f"{label} string"))
    parts = [
        rows(held.where("n <> 1"), "held out several times", key),
        rows(cohort.join(folds, key, "left_anti"), "never held out", key),
        rows(folds.join(cohort, key, "left_anti"), "not in the cohort", key),
        rows(folds.groupBy(patient).agg(F.count_distinct("fold").alias("n")).where("n > 1"), "patient in several folds", patient),
        rows(every.join(folds.select(key, "fold").join(cohort.select(key, label), key).select("fold", label).distinct(), ["fold", label], "left_anti").withColumn("what", F.concat_ws(":", "fold", label)), "class missing from a fold", "what"),
        rows(test.join(folds, key, "left_semi"), "test unit in development", key),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- joins by key


def partition_label_join(parts: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """parts with the labels' columns (those that clash get the suffix _label) and status: both or left_only."""
    same = [c for c in labels.columns if c != key and c in parts.columns]
    right = labels.withColumnsRenamed({c: f"{c}_label" for c in same}).withColumn("__hit", F.lit(True))
    return parts.join(right, key, "left").withColumn("status", F.when(F.col("__hit"), "both").otherwise("left_only")).drop("__hit")


def exact_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, status): keys of one side only, as missing (not in left) or extra (not in right)."""
    a, b = left.select(key).distinct().withColumn("__a", F.lit(1)), right.select(key).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.where("__a IS NULL OR __b IS NULL").select(key, F.when(F.col("__a").isNull(), "missing").otherwise("extra").alias("status"))


# --- counts and audits


def _classes(df: DataFrame, classes: list[str], name: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], f"{name} string, class_index int")


def class_counts(df: DataFrame, classes: list[str], column: str = "diagnosis") -> DataFrame:
    """Rows of each declared class; 0 where there are none."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return _classes(df, classes, column).join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_weights(df: DataFrame, classes: list[str], column: str = "diagnosis") -> DataFrame:
    """All rows divided by the class's rows; 0 for an empty class."""
    n = class_counts(df, classes, column)
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(column, F.when(F.col("n") == 0, 0.0).otherwise(F.round(F.col("total") / F.col("n"), 6)).alias("weight"))


def value_counts(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Rows of each value (null too), and their percentage within `by`."""
    n = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy(*by)), 6))


def conflict_groups(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dataset_summary(df: DataFrame, first: str = "fold", second: str = "diagnosis") -> DataFrame:
    """Rows and patients by (fold, class), by fold, and in all; `level` is the grouping id."""
    return df.rollup(first, second).agg(F.count("*").alias("n"), F.count_distinct("patient_id").alias("patients"), F.grouping_id().cast("int").alias("level"))


def batch_readiness(df: DataFrame, status: str, completed: str, failed: str, pending: str) -> DataFrame:
    """One row: totals by state, and whether nothing failed or waits."""
    is_ = lambda v: F.col(status) == v
    known = F.col(status).isin(completed, failed, pending)
    return df.agg(F.count_if(is_(completed)).alias("completed"), F.count_if(is_(failed)).alias("failed"), F.count_if(is_(pending)).alias("pending"), F.count_if(~known | F.col(status).isNull()).alias("skipped"), F.coalesce(F.bool_and(~F.col(status).isin(failed, pending)), F.lit(True)).alias("ready"))


# --- sets, limits


def concat_partitions(**parts: DataFrame) -> DataFrame:
    """All rows of the named parts, duplicates too, with the part's name in `partition`."""
    return reduce(DataFrame.unionByName, [df.withColumn("partition", F.lit(name)) for name, df in parts.items()])


def dedup_recordings(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key. A minimum by key, so that copies meet pre-aggregated; df must have no column `__first`."""
    rest = [c for c in df.columns if c not in (key, order)]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__first"), F.min(order).alias(order)) if rest else df.groupBy(key).agg(F.min(order).alias(order))
    return first.select(*[F.col(c) if c in (key, order) else F.col("__first")[c].alias(c) for c in df.columns])


def set_difference(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): expected but not found ('missing'), found but not expected ('extra')."""
    a, b = expected.select(key), found.select(key)
    return a.subtract(b).withColumn("side", F.lit("missing")).unionByName(b.subtract(a).withColumn("side", F.lit("extra")))


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def held_out_union(folds: DataFrame, cohort: DataFrame, key: str = "uid") -> DataFrame:
    """One row: held-out units, cohort units, and whether the two sets are equal."""
    union = folds.select(key).distinct()
    diff = set_difference(cohort, union, key).agg(F.count("*").alias("n_differ"))
    counts = union.agg(F.count("*").alias("n_held_out")).crossJoin(cohort.select(key).distinct().agg(F.count("*").alias("n_cohort")))
    return counts.crossJoin(diff).withColumn("equal", F.col("n_differ") == 0)


def limit_per_group(df: DataFrame, group: str, order: str, n: int = -1) -> DataFrame:
    """At most n rows of each group, in order; all for -1."""
    if n < 0:
        return df
    return df.withColumn("__k", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("__k") <= n).drop("__k")


def smoke_limit(df: DataFrame, order: str, n: int) -> DataFrame:
    if n < 1:
        raise ValueError("n must be 1 or more")
    return df.orderBy(order).limit(n)


def stable_sort(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


def trial_grid(spark: SparkSession, axes: dict[str, list | DataFrame]) -> DataFrame:
    """The product of the axes, in order, with ids. An axis is a list, in its order, or a table's column of its name, whose distinct values are taken in theirs;
    a grid is as large as the product of its axes, so axes are short."""
    out, index = None, F.lit(0)
    for name, values in axes.items():
        if isinstance(values, DataFrame):
            axis = values.select(name).distinct().withColumn(f"__{name}", F.row_number().over(W.orderBy(name)) - 1)
        else:
            kind = "double" if isinstance(values[0], float) else "int" if isinstance(values[0], int) else "string"
            axis = spark.createDataFrame(list(enumerate(values)), f"__{name} int, {name} {kind}")
        axis = axis.crossJoin(F.broadcast(axis.agg(F.count("*").alias(f"__n_{name}"))))
        out = axis if out is None else out.crossJoin(axis)
        index = index * F.col(f"__n_{name}") + F.col(f"__{name}")
    return out.select(index.cast("int").alias("trial_index"), F.concat_ws("_", *[F.concat(F.lit(f"{n}-"), F.col(n).cast("string")) for n in axes]).alias("trial_id"), *axes)


def experiment_matrix(spark: SparkSession, base: dict[str, str], families: dict[str, list[dict[str, str]]]) -> DataFrame:
    """(name, settings, aliases): the base and each family's variations; settings that several families make are one row with aliases."""
    rows = [("base", base), *[(f"{family}:" + ",".join(f"{k}={v}" for k, v in change.items()), {**base, **change}) for family, changes in families.items() for change in changes]]
    frame = spark.createDataFrame([(i, n, dict(sorted(s.items()))) for i, (n, s) in enumerate(rows)], "place int, name string, settings map<string,string>")
    by = frame.groupBy(F.to_json("settings").alias("key")).agg(F.min_by("name", "place").alias("name"), F.min_by("settings", "place").alias("settings"), F.array_sort(F.collect_list("name")).alias("names"))
    return by.select("name", "settings", F.array_except("names", F.array("name")).alias("aliases"))


def scrambled(key: Column, seed: int) -> Column:
    return hash32(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
