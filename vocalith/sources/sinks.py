"""Sinks: writes that refuse, replace or resume; manifests of what was written."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalith.functions.hashing import struct_signature


def write_partition_labels(df: DataFrame, path: str, test: str = "test") -> None:
    """One TSV folder for each partition; the test partition has no label column."""
    labelled = df.where(F.col("partition") != test)
    labelled.write.partitionBy("partition").csv(f"{path}/labelled", sep="\t", header=True)
    df.where(F.col("partition") == test).drop("label", "partition").write.csv(f"{path}/partition={test}", sep="\t", header=True)


def write_once(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Fails if the target exists."""
    writer = df.write.mode("errorifexists")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_atomic(df: DataFrame, root: str) -> int:
    """Writes a new version, and only then a pointer to it; readers of `read_current` never see part of a result.

    Versions are numbers, each one above the last. A pointer's folder is made with `errorifexists`, so of two writers that take the same number one fails.
    """
    spark = df.sparkSession
    version, name = (_latest(spark, root) or (0, ""))[0] + 1, uuid.uuid4().hex
    df.write.parquet(f"{root}/versions/{name}")
    spark.range(1).select(F.lit(name).alias("name")).coalesce(1).write.mode("errorifexists").json(f"{root}/pointers/version={version}")
    return version


def _latest(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """(version, folder's name) of the newest pointer, or None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return None
    row = spark.read.schema("name STRING, version BIGINT").json(f"{root}/pointers").agg(F.max(F.struct("version", "name")).alias("p")).first()["p"]
    return row and (row["version"], row["name"])


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/versions/{_latest(spark, root)[1]}")


def with_signature(records: DataFrame, *settings: str) -> DataFrame:
    return records.withColumn("signature", struct_signature(*settings))


def resume_pending(records: DataFrame, manifest: DataFrame, stage: str) -> DataFrame:
    """Records(uid, signature) whose stage is not in the manifest with the same signature."""
    done = manifest.where(F.col("stage") == stage).select("uid", "signature")
    return records.join(done, ["uid", "signature"], "left_anti")


def publish_once(new: DataFrame, existing: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(inserts, conflicts): rows whose key is new, and rows whose key exists with other content. The same content again is neither."""
    old = existing.select(F.col(key).alias("__k"), F.sha2(F.col(content), 256).alias("__h"))
    inserts = new.join(old, new[key] == old["__k"], "left_anti")
    conflicts = new.join(old, new[key] == old["__k"]).where(F.sha2(F.col(content), 256) != F.col("__h")).drop("__k", "__h")
    return inserts, conflicts


def verify_manifest(current: DataFrame, manifest: DataFrame, key: str, content: str) -> DataFrame:
    """(key, status): changed, missing (only in the manifest) or unexpected; manifest(key, content_hash)."""
    now = current.select(key, F.sha2(F.col(content), 256).alias("now"))
    both = now.join(manifest.select(key, "content_hash"), key, "full_outer")
    status = F.when(F.col("now").isNull(), "missing").when(F.col("content_hash").isNull(), "unexpected").when(F.col("now") != F.col("content_hash"), "changed")
    return both.select(key, status.alias("status")).where("status IS NOT NULL")


def write_text_per_record(df: DataFrame, path: str) -> None:
    """One folder with one text for each uid (columns uid, text)."""
    write_folders(df.select("uid", "text"), path, "uid")


#: Fixed value: characters that Spark writes as % and two hex digits in a folder's name.
ESCAPED = {chr(c) for c in range(1, 32)} | set("\"#%'*/:=?\\\x7f{[]^")


def folder_name(by: str, value: str | None) -> str:
    """The folder of a partition's value, as Spark names it."""
    return f"{by}=" + ("__HIVE_DEFAULT_PARTITION__" if not value else "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in value))


def write_folders(df: DataFrame, path: str, by: str) -> None:
    """Lines of text in one folder for each value of `by`, of which there may be as many as rows: the layout of Spark's partitioned text writer.

    Rows are dealt to all cores, and tasks write each folder's file under a name of its own and then give it its final one, so a task that runs again replaces what it wrote. Spark's writer takes several
    system calls by a shell for each file on a shared local folder, and its driver moves all folders one after another; it is used only where Arrow does not know the file system. Fails if the target exists; `_SUCCESS` is
    written last.
    """
    (content,) = [c for c in df.columns if c != by]
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    rows = df.select(F.expr(f"nullif(cast(`{by}` AS string), '')").alias("__by"), F.col(content).cast("string").alias("line"), F.col(by).alias(by)).repartition(tasks, "__by").sortWithinPartitions("__by")
    try:
        files, root = fs.FileSystem.from_uri(path)
    except (pa.ArrowException, ValueError, OSError):
        rows.select("line", by).write.partitionBy(by).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
        return
    if files.get_file_info(root).type != fs.FileType.NotFound:
        raise ValueError(f"{path} exists")
    files.create_dir(root, recursive=True)

    def write(batches):
        files, root = fs.FileSystem.from_uri(path)
        value, out, names = None, None, None
        done = 0

        def close():
            if out is not None:
                out.close()
                files.move(*names)

        try:
            for batch in batches:
                for v, line in zip(batch.column("__by").to_pylist(), batch.column("line").to_pylist()):
                    if out is None or v != value:
                        close()
                        folder = f"{root}/{folder_name(by, v)}"
                        files.create_dir(folder)
                        value, names = v, (f"{folder}/.{uuid.uuid4().hex}", f"{folder}/part-00000.txt")
                        out, done = files.open_output_stream(names[0]), done + 1
                    out.write(((line or "") + "\n").encode())
            close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            raise
        yield pa.RecordBatch.from_pydict({"n": [done]})

    rows.select("__by", "line").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    with files.open_output_stream(f"{root}/_SUCCESS"):
        pass


def write_leaderboard(ranked: DataFrame, path: str, winner: DataFrame | None = None) -> None:
    """The ranking as CSV and JSON, in part files that follow each other by rank, and the winner's row (winner, mean, parameters, see `trials.winner_parameters`).

    A manifest of the parts (format, part, first and last rank, rows) is written last; without it `read_leaderboard` refuses, so a ranking that was not finished is never read.
    """
    spark = ranked.sparkSession
    parts = ranked.repartitionByRange("rank").sortWithinPartitions("rank")
    parts.write.csv(f"{path}/leaderboard_csv", header=True)
    parts.write.json(f"{path}/leaderboard_json")
    if winner is not None:
        winner.write.json(f"{path}/winner")
    manifest = None
    for kind, rows in (("csv", spark.read.csv(f"{path}/leaderboard_csv", header=True)), ("json", spark.read.schema("rank INT").json(f"{path}/leaderboard_json"))):
        part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
        by = rows.groupBy(part.alias("part")).agg(F.min(F.col("rank").cast("int")).alias("first"), F.max(F.col("rank").cast("int")).alias("last"), F.count("*").alias("rows")).withColumn("format", F.lit(kind))
        manifest = by if manifest is None else manifest.unionByName(by)
    manifest.write.mode("errorifexists").json(f"{path}/manifest")


def read_leaderboard(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ranking of a finished leaderboard. Parts whose ranks overlap, or that hold other rows than the manifest says, raise ValueError."""
    said = spark.read.schema("format STRING, part INT, first INT, last INT, rows BIGINT").json(f"{path}/manifest").where("format = 'json'")
    total = said.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    # part by part, a row each; a ranking has far fewer parts than rows
    before = F.max("last").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    overlap = said.withColumn("before", before).where("before >= first").count()
    rows = spark.read.schema(schema).json(f"{path}/leaderboard_json")
    if overlap or rows.count() != total:
        raise ValueError("the leaderboard's parts are not those of its manifest")
    return rows


def write_path_list(df: DataFrame, path: str, kind: str | None = None) -> None:
    """A path in each line, with a tab and its type if `kind` names that column."""
    df.select(F.concat_ws("\t", "path", *([kind] if kind else [])).alias("value")).write.text(path)

