"""Where intermediate tables go."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or the checkpoint folder of the context."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named}/{name}-{uuid.uuid4().hex}"


def sound_unions(spark: SparkSession) -> None:
    """Spark 4.1 may take a union of inputs that are partitioned alike to be partitioned so too, and then windows and groups over it go without a shuffle. With inputs that are derived in several branches this was seen to bring
    together partitions that do not belong together (3 of 14 runs of one plan lost all of one side). The setting stays off for the session."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """While files are looked up: folders are dealt to some tasks a core, not one task each, as Spark does it with up to 10,000 of them."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast. Rows that come out of texts, intervals or frames are estimated by the size of the file they are made from, and a few MB of it may be millions of rows."""
    return df.hint("merge")
