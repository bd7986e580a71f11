"""Session turns: the last n, and where checkpoints fall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of every session, in their order."""
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("turn_idx")))
    return turns.withColumn("_back", rank).where(F.col("_back") <= n).drop("_back")


def timer_checkpoints(turns: DataFrame, seconds: int = 30) -> DataFrame:
    """(session_id, flushes): saves by a timer alone, which writes at its tick if any turn came since the last one."""
    tick = F.floor(F.unix_seconds("turn_at") / seconds)
    return turns.groupBy("session_id").agg(F.count_distinct(tick).alias("flushes"))


def turn_checkpoints(turns: DataFrame, every: int = 5) -> DataFrame:
    """Turns after which a session is saved: whenever `every` turns wait, and at its end (a clean close saves what is left)."""
    by_turn = W.partitionBy("session_id").orderBy("turn_idx")
    rows = turns.withColumns({"n": F.row_number().over(by_turn), "left": F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("turn_idx")))})
    saved = rows.where((F.col("n") % every == 0) | (F.col("left") == 1))
    return saved.select("session_id", "turn_idx", F.col("n").cast("long").alias("turns_saved"), F.ceil(F.col("n") / every).cast("long").alias("checkpoint"), (F.col("left") == 1).alias("final"))
