"""Structured Streaming twins of the windowed and stateful operators. A stream has a TIMESTAMP column `ts`; where a job runs both ways, the same
function takes a batch table."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from vocalith.streaming.state import PublishOnce, Quarantine, RunningBest, no_empty_batches, processed


def as_glob(path: str) -> str:
    """The path as a pattern that fits only itself: a stream takes a folder or a pattern, and a table may be one file."""
    return f"{path[:-1]}[{path[-1]}]"


def read_events(spark: SparkSession, path: str, stream: bool = True, files: int | None = None) -> DataFrame:
    """The events table as a stream of files (or a batch), with ts as a TIMESTAMP in the session's zone."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema) if stream else spark.read
    if stream and files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(as_glob(path) if stream else path).withColumn("ts", F.col("ts").cast("timestamp"))


def _marked(df: DataFrame, watermark: str) -> DataFrame:
    return df.withWatermark("ts", watermark) if df.isStreaming else df


def _measures() -> list:
    return [F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("value").alias("high")]


def stream_sliding(df: DataFrame, size: str = "14 seconds", slide: str = "7 seconds", watermark: str = "1 minute", key: str = "user_id") -> DataFrame:
    by = _marked(df, watermark).groupBy(F.window("ts", size, slide).alias("w"), key).agg(*_measures())
    return by.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total", "high")


def stream_tumbling(df: DataFrame, size: str = "1 hour", watermark: str = "1 minute", key: str = "event_type") -> DataFrame:
    by = _marked(df, watermark).groupBy(F.window("ts", size).alias("w"), key).agg(*_measures())
    return by.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total", "high")


def stream_sessions(df: DataFrame, gap: str = "30 minutes", watermark: str = "1 minute", key: str = "user_id") -> DataFrame:
    by = _marked(df, watermark).groupBy(F.session_window("ts", gap).alias("w"), key).agg(*_measures())
    return by.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total", "high")


DECISIONS = "run BIGINT, event_id BIGINT, metric DOUBLE, saved BOOLEAN, waited INT, stopped BOOLEAN, closed BOOLEAN"


def stream_running_best(df: DataFrame, key: str = "user_id", patience: int | None = None, ttl_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """Decisions for rows (key, ts, event_id, value, event_type): saved if eligible and strictly above the best so far, waited: rows since the last save, stopped: `patience`
    rows have passed without one, from then on rows are not judged.

    A key's state is its best and its counter; it lasts ttl_ms after it was last written (for ever if None), and idle_ms after its last row the run is closed by a row without event
    (closed). Rows of one trigger are taken in the order of (ts, event_id); those of a later trigger come later.
    """
    rows = df.select(F.col(key).cast("bigint").alias("run__"), "ts", "event_id", F.col("value").cast("double").alias("value"), "event_type")
    return processed(rows, "run__", RunningBest("run__", patience, ttl_ms, idle_ms), DECISIONS, ttl_ms is not None or idle_ms is not None)


def stream_dedup(df: DataFrame, key: str = "event_id", watermark: str = "1 hour") -> DataFrame:
    """Each key once; across restarts too, with a checkpoint folder."""
    return df.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def stream_label_join(df: DataFrame, labels: DataFrame, key: str, label_key: str) -> DataFrame:
    """The rows with their static labels; rows without one stay."""
    return df.join(labels, df[key] == labels[label_key], "left")


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append", empty_batches: bool = True) -> None:
    """Runs a stream over all there is into Parquet at path. empty_batches: whether it may end with a batch without rows, which closes windows; jobs with timers must not."""
    with nullcontext() if empty_batches else no_empty_batches(df.sparkSession):
        query = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_complete(df: DataFrame, path: str, checkpoint: str) -> None:
    """Runs an aggregation over all there is; the last complete result is at path."""

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    df.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _split(judged: DataFrame, targets: dict[str, str], checkpoint: str) -> StreamingQuery:
    """Rows by their `outcome__` to the folders of `targets`, each batch under its id, so that a batch which runs again replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.persist()
        for outcome, path in targets.items():
            batch.where(F.col("outcome__") == outcome).drop("outcome__").write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    with no_empty_batches(judged.sparkSession):
        return judged.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _with_outcome(df: DataFrame) -> StructType:
    return StructType([*df.schema.fields, StructField("outcome__", StringType())])


def stream_quarantine(df: DataFrame, accepted: str, problems: str, checkpoint: str, key: str = "user_id", order: str = "event_id", value: str = "ts", ttl_ms: int | None = None) -> StreamingQuery:
    """Rows whose time lies before their key's latest one go to `problems`; the rest, and nothing else, to `accepted`. A key's state is its latest time, for ttl_ms after it was last written."""
    kind = df.schema[value].dataType.simpleString()
    return _split(processed(df, key, Quarantine(kind, order, value, ttl_ms), _with_outcome(df), ttl_ms is not None), {"good": accepted, "late": problems}, checkpoint)


def stream_publish_once(df: DataFrame, target: str, conflicts: str, checkpoint: str, key: str = "doc_id", content: str = "text", ttl_ms: int | None = None) -> StreamingQuery:
    """New keys are added to target, and keys that come again with other content to conflicts. A key's state is the hash of its content, for ttl_ms after it was published; of several
    contents that come at once the one of the least hash is published."""
    hashed = df.withColumn("hash__", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
    judged = processed(hashed, key, PublishOnce(ttl_ms), _with_outcome(hashed), ttl_ms is not None, frames=False)
    return _split(judged.drop("hash__"), {"new": target, "conflict": conflicts}, checkpoint)
