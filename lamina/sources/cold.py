"""The cold store: Parquet partitioned by calendar quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import tiers
from lamina.session import Scratch


class ColdStore:
    """Rows with `id` and `created_at` under year=/quarter= folders, zstd, each file in (created_at, id) order."""

    def __init__(self, spark: SparkSession, path: str, file_rows: int = 5_000_000):
        self.spark, self.path, self.file_rows = spark, path, file_rows

    def _there(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def archive(self, rows: DataFrame) -> None:
        """Upsert by id into the quarters that the rows touch; other quarters aren't read or written."""
        new = tiers.with_quarter(rows)
        if self._there():
            touched = [(r["year"], r["quarter"]) for r in new.select("year", "quarter").distinct().collect()]  # four a year
            if not touched:
                return
            old = self.read().where(F.struct("year", "quarter").isin([F.struct(F.lit(y), F.lit(q)) for y, q in touched]))
            new = tiers.cold_upsert(old.select(*new.columns), new)
            # the folders being replaced are also being read: go through a table of its own first
            scratch = Scratch(self.spark, "upsert")
            new = scratch.table("rows", new)
        sizes = {(r["year"], r["quarter"]): r["count"] for r in new.groupBy("year", "quarter").count().collect()}  # four a year
        files = F.lit(1)
        for (y, q), n in sizes.items():
            if n > self.file_rows:
                files = F.when((F.col("year") == y) & (F.col("quarter") == q), -(-n // self.file_rows)).otherwise(files)
        salted = new.withColumn("_file", F.pmod(F.xxhash64("id"), files))  # a large quarter is written by many tasks
        ordered = salted.repartition("year", "quarter", "_file").sortWithinPartitions("year", "quarter", "_file", "created_at", "id").drop("_file")
        writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        writer.partitionBy("year", "quarter").parquet(self.path)

    def quarter(self, year: int, quarter: int) -> DataFrame:
        """One quarter by partition pruning; empty where there is none."""
        return self.read().where((F.col("year") == year) & (F.col("quarter") == quarter))

    def quarters(self) -> DataFrame:
        return self.read().select("year", "quarter").distinct().orderBy("year", "quarter")

    def find(self, event_id, created_at=None) -> DataFrame:
        """A row by id; with its creation time only that quarter is read."""
        rows = self.read()
        if created_at is not None:
            rows = rows.where((F.col("year") == F.year(created_at)) & (F.col("quarter") == F.quarter(created_at)))
        return rows.where(F.col("id") == event_id)
