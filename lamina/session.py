"""Session construction and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lamina", cpus: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine assumes (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local master, whose one process sees it; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lamina-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_SCRATCH: list[str] = []


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders that this process has made; results that still read them must be written before. Returns their number."""
    n = 0
    while _SCRATCH:
        where = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return n


class Scratch:
    """Named Parquet tables in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        _SCRATCH.append(self.root)

    def _folder(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            system, where = self._folder(self.path(name))
            system.delete(where, True)

    def size(self) -> int:
        """Bytes of all tables here."""
        system, where = self._folder(self.root)
        return system.getContentSummary(where).getLength() if system.exists(where) else 0


#: Rows of an Arrow batch where texts pass through Python: texts are wide rows.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from here on in this session, unless its user has chosen another number than Spark's own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def release(scratch: Scratch, pause: float = 0.4, least: int = 32 << 20) -> None:
    """Let Spark delete the shuffle files of plans that are done, which it does when the driver collects its garbage.

    Jobs whose tables are small have small shuffles, which can wait for the next collection.
    """
    if scratch.size() < least:
        return
    spark = scratch.spark
    for _ in range(2):  # what the first round frees may hold the last references of more
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(pause)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="lamina-package-"), "lamina.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("lamina", os.path.relpath(path, root)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
