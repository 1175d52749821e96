"""A batch of stages over recordings that resumes: what was done under the same signature is reused, what failed is reported, what was changed is refused.

A stage's rows and its manifest (uid, signature, content_hash) are written by attempts. The manifest comes last, so an interrupted attempt stays for inspection and counts
for nothing. A record's signature is of the stage, its settings, the record's sources and the contents of the stages before it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.sources.manifests import multiset_digest
from vocalith.sources.storage import sound_unions

MANIFEST = "uid bigint, signature string, content_hash string, attempt string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def joined_text(columns: list[Column]) -> Column:
    """Values as one text, nulls apart from empty ones."""
    return F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns])


def recording_contents(rows: DataFrame) -> DataFrame:
    """(uid, content_hash) of each recording's rows, in whatever order they are."""
    line = joined_text([F.col(c) for c in sorted(rows.columns) if c not in ("uid", "attempt", "problem")])
    return rows.groupBy("uid").agg(multiset_digest(line).alias("content_hash"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows, that plans are cut at."""
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", "))])


class Batch:
    """Stages under one root folder. `run` returns a stage's rows; `failed` collects (stage, uid, problem); `reused` and `built` count records by stage."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        sound_unions(spark)
        self.spark, self.root = spark, root
        self.failed: DataFrame = empty(spark, "stage string, uid bigint, problem string")
        self.reused: dict[str, int] = {}
        self.built: dict[str, int] = {}
        self.signatures: dict[str, DataFrame] = {}
        self.done: dict[str, DataFrame] = {}

    def manifest(self, stage: str) -> DataFrame:
        path = f"{self.root}/{stage}/manifest"
        return self.spark.read.schema(MANIFEST).parquet(path) if exists(self.spark, path) else empty(self.spark, MANIFEST)

    def _kept(self, stage: str, name: str, df: DataFrame) -> DataFrame:
        """df, a row for each record, written beside the stage's rows and read again: later steps read it several times, and stages after this one too."""
        path = f"{self.root}/{stage}/{name}/run={uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _current(self, stage: str) -> DataFrame:
        """(uid, content_hash, attempt) of the records that are done under the signature of this run; of several attempts the least."""
        done = self.manifest(stage).join(self.signatures[stage].select("uid", "signature"), ["uid", "signature"])
        return self._kept(stage, "done", done.groupBy("uid").agg(F.min(F.struct("attempt", "content_hash")).alias("m")).select("uid", "m.content_hash", "m.attempt"))

    def run(self, stage: str, records: DataFrame, build: Callable[[DataFrame], DataFrame], settings: dict | None = None, after: tuple[str, ...] = ()) -> DataFrame:
        """records(uid, sources…) -> the stage's rows of all records that are done.

        Records that a stage of `after` has not done are left out. build(pending records) gives rows with a uid; rows with a non-null `problem`, and a record without rows, are
        failures. Stored rows that no longer have the content their manifest says raise ValueError.
        """
        signed = records
        for name in after:
            signed = signed.join(self.done[name].select("uid", F.col("content_hash").alias(f"__{name}")), "uid")
        parts = [F.lit(stage), F.lit(json.dumps(settings or {}, sort_keys=True)), *[F.col(c) for c in sorted(signed.columns)]]
        self.signatures[stage] = self._kept(stage, "signatures", signed.select(*records.columns, F.sha2(joined_text(parts), 256).alias("signature")))
        self.done[stage] = self._current(stage)
        self.reused[stage] = self._verified(stage, self.done[stage])
        self.built[stage] = 0
        pending = self.signatures[stage].join(self.done[stage], "uid", "left_anti")
        if not pending.isEmpty():
            self._attempt(stage, pending, build)
            self.done[stage] = self._current(stage)
        return self._rows(stage, self.done[stage])

    def _rows(self, stage: str, current: DataFrame) -> DataFrame:
        path = f"{self.root}/{stage}/rows"
        if not exists(self.spark, path):
            raise ValueError(f"stage {stage} has no records")
        return self.spark.read.parquet(path).join(current.select("uid", "attempt"), ["uid", "attempt"]).drop("attempt", "problem")

    def _verified(self, stage: str, done: DataFrame) -> int:
        n = done.count()
        if n:
            now = recording_contents(self._rows(stage, done)).withColumnRenamed("content_hash", "now")
            changed = done.join(now, "uid", "left").where(~F.col("content_hash").eqNullSafe(F.col("now"))).select("uid").orderBy("uid").first()
            if changed:
                raise ValueError(f"stage {stage} was modified: recording {changed.uid}")
        return n

    def _attempt(self, stage: str, pending: DataFrame, build: Callable[[DataFrame], DataFrame]) -> None:
        name = f"a{uuid.uuid4().hex}"
        asked = f"{self.root}/{stage}/asked/attempt={name}"
        pending.write.parquet(asked)  # what the attempt is for; builders join it several times
        pending = self.spark.read.schema(pending.schema).parquet(asked)
        out = build(pending.drop("signature"))
        if "problem" not in out.columns:
            out = out.withColumn("problem", F.lit(None).cast("string"))
        path = f"{self.root}/{stage}/rows/attempt={name}"
        out.write.parquet(path)
        rows = self.spark.read.schema(out.schema).parquet(path)
        # one pass over the rows, and one over those with a problem: a least text among the sums would have all rows sorted
        problems = rows.where("problem IS NOT NULL").groupBy("uid").agg(F.min("problem").alias("problem"))
        found = recording_contents(rows).join(problems, "uid", "left").join(pending.select("uid", "signature"), "uid", "full_outer").withColumn("problem", F.coalesce("problem", F.when(F.col("content_hash").isNull(), "no rows")))
        found = self._kept(stage, "found", found)
        made = found.where("problem IS NULL AND signature IS NOT NULL").select("uid", "signature", "content_hash", F.lit(name).alias("attempt"))
        made.write.mode("append").parquet(f"{self.root}/{stage}/manifest")
        failed = found.where("problem IS NOT NULL").select(F.lit(stage).alias("stage"), "uid", "problem")
        failed.write.parquet(f"{self.root}/{stage}/failures/attempt={name}")
        self.failed = self.failed.unionByName(self.spark.read.schema(failed.schema).parquet(f"{self.root}/{stage}/failures/attempt={name}"))
        self.built[stage] = made.count()

    def readiness(self, records: DataFrame, last: str) -> DataFrame:
        """One row: total, completed (by the stage `last`), failed, pending, and ready: all completed and none failed."""
        total, completed = records.agg(F.count_distinct("uid").alias("total")), self.done[last].agg(F.count("*").alias("completed"))
        failed = self.failed.agg(F.count_distinct("uid").alias("failed"))
        one = total.crossJoin(completed).crossJoin(failed)
        return one.select("total", "completed", "failed", (F.col("total") - F.col("completed") - F.col("failed")).alias("pending"), ((F.col("total") == F.col("completed")) & (F.col("failed") == 0) & (F.col("total") > 0)).alias("ready"))
