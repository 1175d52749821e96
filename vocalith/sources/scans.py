"""Scans: files and tables into typed DataFrames. Problems are rows or a failed read, never silent repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.operators.ordering import carried_scan
from vocalith.operators.vectors import feature_violations
from vocalith.sources.folders import files_below, lines_below, opened
from vocalith.sources.storage import few_listing_tasks, shared_path, sound_unions

#: Names under which label tables carry their columns; exact matches go before matches in any case.
LABEL_ALIASES = {
    "filename": ["filename", "file", "ID", "audio"],
    "patient_id": ["patient_id", "NHC ID HSP", "patient", "subject"],
    "diagnosis": ["diagnosis", "DX_Pilar", "Dx", "label"],
}


def resolve_columns(df: DataFrame, aliases: dict[str, list[str]] = LABEL_ALIASES, default_first: str = "filename") -> DataFrame:
    """df's columns under their standard names; the first column stands for `default_first` if no alias fits."""
    plain = {c: c.lstrip("﻿") for c in df.columns}
    lower = {v.lower(): k for k, v in plain.items()}
    exact = {v: k for k, v in plain.items()}
    picked = {}
    for name, options in aliases.items():
        hit = next((exact[o] for o in options if o in exact), None) or next((lower[o.lower()] for o in options if o.lower() in lower), None)
        if hit is None and name == default_first:
            hit = df.columns[0]
        if hit is None:
            raise ValueError(f"no column for {name}")
        picked[name] = hit
    return df.select(*[F.col(f"`{c}`").cast("string").alias(n) for n, c in picked.items()])


def scan_labels(spark: SparkSession, path: str, aliases: dict[str, list[str]] = LABEL_ALIASES) -> DataFrame:
    return resolve_columns(spark.read.csv(path, header=True), aliases)


def scan_labels_strict(spark: SparkSession, path: str, mapping: dict[str, int], index: DataFrame) -> DataFrame:
    """(path, label, problem) of a tab file with exactly two columns; problem: unknown class, or no such path in `index`(path).

    A line with other columns fails the read.
    """
    rows = spark.read.csv(path, sep="\t", schema="path string, diagnosis string", mode="FAILFAST")
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    known = index.select("path", F.lit(True).alias("there")).distinct()
    out = rows.join(known, "path", "left").withColumn("label", F.try_element_at(table, F.col("diagnosis")))
    return out.select("path", "label", F.when(F.col("label").isNull(), "unknown class").when(F.col("there").isNull(), "missing path").alias("problem"))


def scan_partitions(spark: SparkSession, path: str) -> DataFrame:
    """(partition, filename) of a headerless ``;`` file, nulls filled, trimmed, partitions in lower case."""
    rows = spark.read.csv(path, sep=";", schema="partition string, filename string").fillna("null_value")
    return rows.select(F.lower(F.trim("partition")).alias("partition"), F.trim("filename").alias("filename"))


def scan_consensus(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Three columns of a label CSV, found by lower-case header and renamed; values trimmed and in lower case, nulls filled."""
    raw = spark.read.csv(path, header=True)
    low = raw.toDF(*[c.lower() for c in raw.columns]).fillna("null_value")
    return low.select(*[F.lower(F.trim(f"`{c.lower()}`")).alias(n) for c, n in columns.items()])


#: The stem of a path: the file name without its extension.
STEM = r"([^/]*?)(\.[^./]*)?$"


def below(spark: SparkSession, path: str, **options) -> DataFrame:
    """Text files at a path or a pattern; of a folder all files below it. Folders are listed by tasks, a pattern over them by the driver alone."""
    with few_listing_tasks(spark):
        return spark.read.option("recursiveFileLookup", "true").text(path, **options)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, before, value) of the lines of text files: a line's place in its file, from 0, and the lines before it that are not empty.

    Files are split like any text input. Lines come in order within a block of a file, and are numbered there; what a file's earlier blocks hold is carried over. So files
    may be of any size.
    """
    sound_unions(spark)
    if (lines := lines_below(spark, path)) is not None:
        return lines
    lines = below(spark, path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    stored = shared_path(spark, "lines")
    lines.write.parquet(stored)
    rows = spark.read.schema(lines.schema).parquet(stored)
    return carried_scan(rows, ["file"], "block", [F.col("at")], {"place": ("count", F.lit(1)), "before": ("sum", (F.col("value") != "").cast("int"))}).select("file", "place", "before", "value")


def scan_words(spark: SparkSession, path: str, uid_pattern: str = STEM) -> DataFrame:
    """(uid, word_id, word, start, end, probability) of word CSVs, one for each recording; the uid is the first group of a pattern over the path (the stem) and the row order the id.

    Files without the needed header or rows fail; files of no bytes at all are passed over by Spark's readers. Files are read in blocks, not whole (`numbered_lines`).
    """
    lines = numbered_lines(spark, path)
    uid = lambda c: F.regexp_extract(c, uid_pattern, 1)
    heads = lines.where("place = 0").select("file", F.col("value").alias("head"))
    filled = lines.where("place > 0 AND value <> ''").groupBy("file").agg(F.count("*").alias("n"))
    good = F.col("head").rlike(r"^\x{FEFF}?word,start,end") & F.col("n").isNotNull()
    bad = heads.join(filled, "file", "left").where(~good)
    body = lines.where("place > 0 AND value <> ''").select(uid(F.col("file")).alias("uid"), (F.col("before") - 1).cast("int").alias("word_id"), F.from_csv("value", F.lit("word STRING, start DOUBLE, end DOUBLE, probability DOUBLE")).alias("r"))
    rows = body.select("uid", "word_id", "r.*")
    fail = F.raise_error(F.concat(F.lit("bad word file "), uid(F.col("file"))))
    return rows.unionByName(bad.select(fail.cast("string").alias("uid")), allowMissingColumns=True)


#: How tables with free text are read: quoted fields may hold line ends, and a quote in one is doubled.
TEXT_CSV = {"header": "true", "multiLine": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def scan_transcripts(spark: SparkSession, path: str, pauses: bool = False) -> DataFrame:
    """(uid, text, problem) of a CSV (uid, transcription, transcription_pause): one usable row for each uid, else a problem and no text."""
    rows = spark.read.options(**TEXT_CSV).csv(path)
    text = F.col("transcription_pause" if pauses else "transcription")
    by = rows.groupBy("uid").agg(F.count("*").alias("n"), F.first(text).alias("text"))
    problem = F.when(F.col("n") > 1, "several rows").when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty")
    return by.select("uid", F.when(problem.isNull(), F.col("text")).alias("text"), problem.alias("problem"))


def scan_file_index(spark: SparkSession, root: str, glob: str = "*", stem: str = STEM) -> DataFrame:
    """(path, length, stem, folder, duplicate) of the files below root; contents are not read, and tasks list the folders (`folders.files_below`). The stem is the first group of a pattern over the path; duplicate: another file has it as well. Files of no bytes are passed over, as by Spark's readers."""
    files = files_below(spark, root, glob)
    if files is not None:
        files = files.where("length > 0").select(F.concat(F.lit(opened(root)[2]), "path").alias("path"), "length")
    else:
        with few_listing_tasks(spark):
            files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).select("path", "length")
    named = files.select("path", "length", F.regexp_extract("path", stem, 1).alias("stem"), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"))
    n = named.groupBy("stem").agg((F.count("*") > 1).alias("duplicate"))
    return named.join(n, "stem").select("path", "length", "stem", "folder", "duplicate")


def scan_splits(spark: SparkSession, path: str, num_folds: int) -> DataFrame:
    """(split, fold, uid, problem) of saved fold membership (CSV: split, fold, uid): blank uids, uids twice in a fold's split, folds beyond the declared
    ones; a declared fold that is missing is a row without uid."""
    rows = spark.read.csv(path, header=True, schema="split string, fold int, uid string")
    n = rows.groupBy("split", "fold", "uid").agg(F.count("*").alias("n"))
    bad = F.when(F.coalesce(F.trim("uid"), F.lit("")) == "", "blank").when(F.col("n") > 1, "duplicate").when(~F.col("fold").between(0, num_folds - 1), "fold")
    missing = spark.range(num_folds).select(F.col("id").cast("int").alias("fold")).join(rows.select("fold").distinct(), "fold", "left_anti")
    return n.select("split", "fold", "uid", bad.alias("problem")).unionByName(missing.select(F.lit(None).cast("string").alias("split"), "fold", F.lit(None).cast("string").alias("uid"), F.lit("missing fold").alias("problem")))


RUN_RESULT = "trial BIGINT, fold INT, training_macro_f1 DOUBLE, metrics STRUCT<macro_f1: DOUBLE, accuracy: DOUBLE>, predictions ARRAY<STRUCT<uid: BIGINT, label: INT, prediction: INT>>"


def scan_run_results(spark: SparkSession, root: str) -> DataFrame:
    """(trial, fold, training_macro_f1, macro_f1, accuracy, n_predictions) of result documents below root: one in a file, or an array of them."""
    docs = spark.read.schema(RUN_RESULT).option("multiLine", "true").option("recursiveFileLookup", "true").json(root)
    return docs.select("trial", "fold", "training_macro_f1", "metrics.macro_f1", "metrics.accuracy", F.size("predictions").alias("n_predictions"))


JOURNAL = "completed_steps BIGINT, validation_macro_f1 DOUBLE, previous_best_validation_macro_f1 DOUBLE, eligible BOOLEAN, saved BOOLEAN"


def scan_journal(spark: SparkSession, path: str, schema: str = JOURNAL) -> DataFrame:
    """Lines of a JSONL decision log; their order is completed_steps."""
    return spark.read.schema(schema).json(path)


def scan_predictions(spark: SparkSession, paths: list[str], pattern: str = r"fold=(\d+)") -> DataFrame:
    """Prediction CSVs of several folds as one long table; the fold comes from the path."""
    rows = spark.read.csv(paths, header=True, schema="uid BIGINT, label INT, probability_0 DOUBLE, probability_1 DOUBLE, probability_2 DOUBLE")
    return rows.select("uid", "label", F.array("probability_0", "probability_1", "probability_2").alias("proba"), F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).cast("int").alias("fold"))


def scan_segments(spark: SparkSession, path: str, speaker: str = "INV") -> DataFrame:
    """(uid, begin, stop) in seconds of one speaker's segments, from a CSV (uid, speaker, begin, end) in milliseconds."""
    rows = spark.read.csv(path, header=True, schema="uid bigint, speaker string, begin bigint, end bigint")
    return rows.where(F.col("speaker") == speaker).select("uid", (F.col("begin") / 1000.0).alias("begin"), (F.col("end") / 1000.0).alias("stop"))


def scan_noise_lists(spark: SparkSession, noises: str, rirs: str) -> DataFrame:
    """(path, type) of a tab file of background noises (path, type) and a list of room responses (path; type 'rir')."""
    a = spark.read.csv(noises, sep="\t", schema="path string, type string")
    return a.unionByName(spark.read.csv(rirs, sep="\t", schema="path string").withColumn("type", F.lit("rir")))


def scan_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, and each recording's `feature_violations`) of Parquet feature rows (uid, vec, …)."""
    rows = spark.read.parquet(path)
    return rows, feature_violations(rows)


def scan_text_files(spark: SparkSession, path: str, recordings: DataFrame, test: str = "test", uid_pattern: str = STEM) -> DataFrame:
    """recordings(uid, partition) with their transcript files: one line is the text, none is ``...`` (so are missing files and the test partition); more is a
    problem."""
    files = below(spark, path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), uid_pattern, 1).alias("uid"), F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    n = F.coalesce(F.size("lines"), F.lit(0))
    hidden = F.col("partition") == test
    return recordings.join(files, "uid", "left").select("uid", "partition", F.when(hidden | (n == 0), "...").when(n == 1, F.col("lines")[0]).alias("text"), F.when(~hidden & (n > 1), "several lines").alias("problem"))
