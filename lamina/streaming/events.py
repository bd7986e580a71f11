"""Streams over the event table, run to the end of what is there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lamina.session import Scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
TURNS = "conv_id long, turn long, role string, text string"


def source(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """A table as a stream, `files` of its files a batch; a single file is found through its folder."""
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema)
    reader = reader if files is None else reader.option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all input there is, into a table in the shared folder, with its checkpoint beside it."""
    spark = stream.sparkSession
    scratch = Scratch(spark, "stream")
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", scratch.path("out"))
    writer.option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(scratch.path("out"))


def _timed(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    return source(spark, f"{sf_dir}/events.parquet", EVENTS, files).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(spark: SparkSession, sf_dir: str, lateness: str = "0 seconds", files: int | None = None) -> DataFrame:
    """Events per day and type; a day appears once the watermark, the latest time met less `lateness`, has passed it.

    Of a table of several files, which may arrive in several batches, rows later than that are
    left out; days that are still open at the end of the input don't appear.
    """
    rows = _timed(spark, sf_dir, files).withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return drained(rows.select(F.col("window.start").alias("day"), "event_type", "n", "total")).withColumn("total", F.round("total", 4))


def sessions(spark: SparkSession, sf_dir: str, gap: str = "6 hours", lateness: str = "0 seconds", files: int | None = None) -> DataFrame:
    """Activity sessions per user, closed by a gap that the watermark has passed; `lateness` as in `daily_counts`."""
    rows = _timed(spark, sf_dir, files).withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("last_event"), F.count("*").alias("n"))
    return drained(rows.select("user_id", "started", "last_event", "n"))


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (user, type) once, whatever the order of arrival and however far apart; the state has a row for each of them."""
    return drained(_timed(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))


def checkpointed_sessions(spark: SparkSession, sf_dir: str, every: int = 5) -> DataFrame:
    """Stateful checkpoint rule over the turn stream: a session is saved whenever `every` turns wait."""

    def save(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, saved, turns = state.get if state.exists else (0, 0, 0)
        for batch in batches:
            turns += len(batch)
            waiting += len(batch)
        saved += waiting // every
        waiting %= every
        state.update((waiting, saved, turns))
        yield pd.DataFrame({"session_id": [key[0]], "full_checkpoints": [saved], "turns": [turns]})

    rows = source(spark, f"{sf_dir}/conversations.parquet", TURNS).withColumnRenamed("conv_id", "session_id").groupBy("session_id")
    found = rows.applyInPandasWithState(save, "session_id long, full_checkpoints long, turns long", "waiting long, saved long, turns long", "append", GroupStateTimeout.NoTimeout)
    out = drained(found)
    return out.groupBy("session_id").agg(F.max("full_checkpoints").alias("full_checkpoints"), F.max("turns").alias("turns"))


def idle_ticks(events: DataFrame, minutes: int = 5) -> DataFrame:
    """Ticks between the first and last event in which nothing happened: when background work may run."""
    bucket = F.window("created_at", f"{minutes} minutes").start
    active = events.select(bucket.alias("tick")).distinct()
    span = active.agg(F.min("tick").alias("lo"), F.max("tick").alias("hi"))
    ticks = span.select(F.explode(F.sequence("lo", "hi", F.expr(f"interval {minutes} minutes"))).alias("tick"))
    return ticks.join(active, "tick", "left_anti")


def gate_runs(events: DataFrame, minutes: int = 60) -> DataFrame:
    """(ran, ticks): at how many of all ticks between the first and last event an idle gate lets background work run."""
    bucket = F.window("created_at", f"{minutes} minutes").start
    span = events.agg(F.min(bucket).alias("lo"), F.max(bucket).alias("hi"))
    whole = (F.unix_seconds("hi") - F.unix_seconds("lo")) / (60 * minutes) + 1
    ticks = span.select(F.explode(F.sequence("lo", "hi", F.expr(f"interval {minutes} minutes"))).alias("tick"), whole.cast("long").alias("ticks"))
    idle = ticks.join(events.select(bucket.alias("tick")).distinct().withColumn("busy", F.lit(True)), "tick", "left")
    return idle.agg(F.count(F.when(F.col("busy").isNull(), 1)).alias("ran"), F.max("ticks").alias("ticks"))
