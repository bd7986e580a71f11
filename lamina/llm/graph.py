"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import Scratch

#: Above this many edges, minima go through a table, so that both sides of the join are shuffles whose hot keys Spark can split.
LARGE = 5_000_000


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest node of its component.

    Alternates large-star and small-star steps until the edges are stars around the roots.
    """
    now = scratch.table(f"{label}_0", edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark, step = None, 0
    while True:
        size, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (size, total) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark, step = (size, total), step + 1

        def with_minimum(df: DataFrame, name: str) -> DataFrame:
            low = df.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
            return df.join(scratch.table(f"{label}_{name}{step}", low) if size > LARGE else low, "u")  # noqa: B023

        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_minimum(both, "large").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        small = with_minimum(large, "small")
        kept = small.select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.greatest("v", "low").alias("u"), F.least("v", "low").alias("v")))).alias("e"))
        following = scratch.table(f"{label}_{step}", kept.select("e.u", "e.v").where("u <> v").distinct())
        scratch.drop(f"{label}_{step - 1}", f"{label}_large{step}", f"{label}_small{step}")
        now = following
