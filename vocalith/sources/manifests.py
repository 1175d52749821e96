"""Manifests of content as hash trees over ranges of key hashes.

A manifest is a folder with `rows` (key, content_hash), one subfolder for each leaf, and `tree`: for every node its digest and number of rows. A leaf holds the
keys whose md5 begins with its digits; a node above stands for a shorter beginning. Two manifests are compared from their roots down, and only into nodes that
differ, so equal ranges are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.sources.storage import shared_path

DEPTH = 2
TREE = "node string, digest string, n bigint, level int"
FAN_OUT_DIGITS = 1


def leaf_of(key: Column, depth: int = DEPTH) -> Column:
    return F.substring(F.md5(key.cast("string")), 1, depth * FAN_OUT_DIGITS)


def multiset_digest(line: Column) -> Column:
    """An aggregate that depends on the lines of a group and how often each comes, not on their order, and needs no list of them. Numbers of 60 bits are added up as two halves of 30, which fit longs for 8 billion lines."""
    half = F.lit((1 << 30) - 1).cast("long")
    number = lambda at: F.conv(F.substring(F.md5(line), at, 15), 16, 10).cast("long")
    total = lambda part: F.sum(part).cast("decimal(20,0)")
    word = lambda at: total(F.shiftright(number(at), 30)) * F.lit(1 << 30).cast("decimal(10,0)") + total(number(at).bitwiseAND(half))
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)), word(1), word(16)), 256)


def hashed(df: DataFrame, key: str, content: str, depth: int = DEPTH) -> DataFrame:
    """df -> (key, content_hash, leaf). A null content is hashed like an empty one, marked."""
    body = F.when(F.col(content).isNull(), F.lit("null")).otherwise(F.sha2(F.col(content), 256))
    return df.select(F.col(key).alias("key"), body.alias("content_hash"), leaf_of(F.col(key), depth).alias("leaf"))


def tree_of(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(level, node, digest, n) of rows(key, content_hash, leaf): leaves from their rows, nodes above from the digests below."""
    level = rows.groupBy(F.col("leaf").alias("node")).agg(multiset_digest(F.concat_ws(":", F.col("key").cast("string"), "content_hash")).alias("digest"), F.count("*").alias("n"))
    level = level.withColumn("level", F.lit(depth))
    tree = level
    for k in range(depth - 1, -1, -1):
        below = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"]), ",")  # at most 16 of them
        level = level.groupBy(F.substring("node", 1, k * FAN_OUT_DIGITS).alias("node")).agg(F.sha2(below, 256).alias("digest"), F.sum("n").alias("n")).withColumn("level", F.lit(k))
        tree = tree.unionByName(level)
    return tree


def write_manifest(df: DataFrame, path: str, key: str, content: str, depth: int = DEPTH) -> None:
    rows = hashed(df, key, content, depth)
    rows.repartition("leaf").write.partitionBy("leaf").parquet(f"{path}/rows")
    spark = df.sparkSession
    schema = f"key {dict(rows.dtypes)['key']}, content_hash string, leaf string"
    tree_of(spark.read.schema(schema).parquet(f"{path}/rows"), depth).write.partitionBy("level").parquet(f"{path}/tree")


def read_rows(spark: SparkSession, path: str, key_type: str) -> DataFrame:
    return spark.read.schema(f"key {key_type}, content_hash string, leaf string").parquet(f"{path}/rows")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TREE).parquet(f"{path}/tree")


def differing_leaves(left: DataFrame, right: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(leaf) of the leaves in which two trees differ: level by level, below nodes that differ."""
    nodes = left.sparkSession.range(1).select(F.lit("").alias("node"))
    for k in range(depth + 1):
        above = nodes.select(F.col("node").alias("above"))
        at = lambda t: t.where(F.col("level") == k).withColumn("above", F.substring("node", 1, max(k - 1, 0) * FAN_OUT_DIGITS)).join(F.broadcast(above), "above", "left_semi").select("node", "digest")
        both = at(left).withColumnRenamed("digest", "a").join(at(right).withColumnRenamed("digest", "b"), "node", "full_outer")
        nodes = both.where(~F.col("a").eqNullSafe(F.col("b"))).select("node")
    return nodes.select(F.col("node").alias("leaf"))


def _names(leaves: DataFrame) -> list[str]:
    """At most 16 ** DEPTH names."""
    return [r["leaf"] for r in leaves.collect()]


def _compared(now: DataFrame, then: DataFrame, leaves: DataFrame, key: str) -> DataFrame:
    few = F.col("leaf").isin(*_names(leaves))  # named in the filter, so that a stored manifest's other folders are not opened
    a = now.where(few).select("key", F.col("content_hash").alias("now"))
    b = then.where(few).select("key", F.col("content_hash").alias("then"))
    status = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "unexpected").when(F.col("now") != F.col("then"), "changed")
    return a.join(b, "key", "full_outer").select(F.col("key").alias(key), status.alias("status")).where("status IS NOT NULL")


def compare_manifests(spark: SparkSession, now: str, then: str, key: str, key_type: str = "bigint", depth: int = DEPTH) -> DataFrame:
    """(key, status: changed, missing or unexpected) between two stored manifests."""
    leaves = differing_leaves(read_tree(spark, now), read_tree(spark, then), depth)
    return _compared(read_rows(spark, now, key_type), read_rows(spark, then, key_type), leaves, key)


def verify_content(current: DataFrame, manifest: str, key: str, content: str, depth: int = DEPTH) -> DataFrame:
    """(key, status) of what in `current` a stored manifest does not confirm. Contents are hashed where they are; only nodes of the tree, and the rows of leaves that differ, move."""
    spark = current.sparkSession
    rows = hashed(current, key, content, depth)
    path = shared_path(spark, "tree")
    tree_of(rows, depth).write.partitionBy("level").parquet(path)
    leaves = differing_leaves(spark.read.schema(TREE).parquet(path), read_tree(spark, manifest), depth)
    return _compared(rows, read_rows(spark, manifest, dict(rows.dtypes)["key"]), leaves, key)


def publish_against(new: DataFrame, manifest: str, key: str, content: str, depth: int = DEPTH) -> DataFrame:
    """(key, outcome: insert or conflict) of new rows against a stored manifest; only the leaves that new keys fall into are read. The same content again has no row."""
    rows = hashed(new, key, content, depth).dropDuplicates()
    old = read_rows(new.sparkSession, manifest, dict(rows.dtypes)["key"])
    touched = old.where(F.col("leaf").isin(*_names(rows.select("leaf").distinct()))).select("key", F.col("content_hash").alias("old"))
    outcome = F.when(F.col("old").isNull(), "insert").when(F.col("old") != F.col("content_hash"), "conflict")
    return rows.join(touched, "key", "left").select(F.col("key").alias(key), outcome.alias("outcome")).where("outcome IS NOT NULL")
