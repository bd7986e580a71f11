"""Global row numbers without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.session import Scratch


def numbered(rows: DataFrame, keys: list[Column], name: str = "pos") -> DataFrame:
    """Adds `name`, from 1, in the order of `keys`: ranks inside the ranges of a range-partitioned sort, plus the sizes of the ranges before.

    What meets in one task is a range, or one number for each range. Keys that many rows share
    need a last key that tells the rows apart, or those rows stay in one range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    placed = Scratch(rows.sparkSession, "sorted").table("rows", dealt)
    sizes = placed.groupBy("_part").count()
    before = F.sum("count").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*keys))
    return placed.withColumn("_own", own).join(F.broadcast(sizes), "_part").select(*rows.columns, (F.col("_own") + F.col("_before")).cast("long").alias(name))
