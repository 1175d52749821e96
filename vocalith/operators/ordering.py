"""Numbering rows, and running values, in an order without passing all rows, or all rows of a key, through one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalith.sources.storage import shared_path


def global_index(df: DataFrame, *order, name: str = "index") -> DataFrame:
    """df with the place of each row, from 0, in the (unique) order.

    Rows are range-partitioned and written, so that their partitions stay as they are; a row's index is its place in its partition after the
    partitions before it, of which only the sizes meet.
    """
    spark = df.sparkSession
    path = shared_path(spark, "ordered")
    df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = sizes.withColumn("__start", F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).drop("__n")
    placed = rows.withColumn("__place", F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1)
    return placed.join(starts, "__part").withColumn(name, F.col("__start") + F.col("__place")).drop("__part", "__place", "__start")


def carried_scan(rows: DataFrame, keys: list[str], part: str, order: list, scans: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows with running values over all earlier rows of their key, of which no task has to hold more than a part.

    A part's rows come after those of its key's lesser parts; within a part `order` holds. scans: name -> (kind, column), where kind is count (of rows), sum, max or last (the last that is not null). Values are
    taken within parts, and what earlier parts come to is carried over; of these a key has one row for each part. Keys may be null.
    """
    within = W.partitionBy(*keys, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    local, totals, carries, joined = {}, [], [], {}
    for name, (kind, c) in scans.items():
        if kind in ("count", "sum"):
            c = F.lit(1) if kind == "count" else c
            local[name], total, carry = F.coalesce(F.sum(c).over(within), F.lit(0)), F.sum(c), F.coalesce(F.sum(f"__t_{name}").over(earlier), F.lit(0))
            joined[name] = F.col(name) + F.col(f"__c_{name}")
        elif kind == "max":
            local[name], total, carry = F.max(c).over(within), F.max(c), F.max(f"__t_{name}").over(earlier)
            joined[name] = F.greatest(F.col(name), F.col(f"__c_{name}"))
        elif kind == "last":
            local[name], total, carry = F.last(c, ignorenulls=True).over(within), F.max_by(c, F.when(c.isNotNull(), F.struct(*order))), F.last(f"__t_{name}", ignorenulls=True).over(earlier)
            joined[name] = F.coalesce(name, f"__c_{name}")
        else:
            raise ValueError(f"unknown scan {kind}")
        totals.append(total.alias(f"__t_{name}"))
        carries.append(carry.alias(f"__c_{name}"))
    sums = rows.groupBy(*keys, part).agg(*totals).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, part])], *carries)
    out = rows.withColumns(local)
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, part])]
    both = out.join(sums, reduce(lambda a, b: a & b, same))
    return both.withColumns(joined).drop(*[c for c in sums.columns])


def spread_scan(df: DataFrame, keys: list[str], order: list, scans: dict[str, tuple[str, Column]]) -> DataFrame:
    """`carried_scan` of rows in the order of (keys, order): ranges of that order are the parts, so a key with a third of all rows is spread over as many tasks as hold a third of them. Rows are written once."""
    path = shared_path(df.sparkSession, "spread")
    df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    return carried_scan(df.sparkSession.read.parquet(path), keys, "__part", order, scans).drop("__part")
