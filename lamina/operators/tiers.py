"""Tier migration and the cold store's partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_DAYS, WARM_DAYS = 28, 180


def older(ts: Column, now: Column, days: int) -> Column:
    return ts <= now - F.expr(f"interval {days} days")


def consolidated(events: DataFrame, now: Column, hot_days: int = HOT_DAYS, warm_days: int = WARM_DAYS) -> DataFrame:
    """Events with the tier after one pass: hot ones old enough go to warm, then warm ones (just promoted included) to cold.

    Adds `promoted` and `archived`; a row that goes all the way counts in both.
    """
    promoted = (F.col("tier") == "hot") & older(F.col("last_accessed"), now, hot_days)
    archived = ((F.col("tier") == "warm") | promoted) & older(F.col("last_accessed"), now, warm_days)
    rows = events.withColumns({"promoted": promoted, "archived": archived})
    return rows.withColumn("tier", F.when(F.col("archived"), "cold").when(F.col("promoted"), "warm").otherwise(F.col("tier")))


def report(pass_result: DataFrame) -> DataFrame:
    one = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(f"{c}_total")
    return pass_result.agg(one("promoted"), one("archived")).withColumnsRenamed({"promoted_total": "promoted_to_warm", "archived_total": "archived_to_cold"})


def with_quarter(rows: DataFrame, ts: str = "created_at") -> DataFrame:
    return rows.withColumns({"year": F.year(ts), "quarter": F.quarter(ts)})


def quarter_name(year: Column, quarter: Column) -> Column:
    return F.format_string("%04d-Q%d", year, quarter)


def cold_upsert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace stored ones of the same key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)
