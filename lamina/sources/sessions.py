"""Working-session snapshots: one JSON file per session."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lamina.schemas import SESSION


def write(folder: str, session: dict) -> None:
    """Save a session atomically; last_checkpoint_at is part of what is written."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{session['id']}.snapshot")
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(session, f, ensure_ascii=False)
    os.replace(f"{path}.tmp", path)


def write_all(folder: str, rows: DataFrame) -> None:
    """Save the sessions of rows(id, turns) from the tasks, into a folder that all of them share; turns have role, content and at. None passes through the driver."""

    def save(part: Iterator[Row]) -> None:
        for r in part:
            turns = [{"role": x["role"], "content": x["content"], "at": x["at"]} for x in r["turns"]]
            write(folder, {"id": r["id"], "turns": turns, "started_at": None, "last_checkpoint_at": None, "clean_shutdown": False})

    os.makedirs(folder, exist_ok=True)
    rows.foreachPartition(save)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SESSION).option("pathGlobFilter", "*.snapshot").json(folder)


def turns(sessions: DataFrame) -> DataFrame:
    """One row per turn, in order."""
    rows = sessions.select(F.col("id").alias("session_id"), F.posexplode("turns").alias("turn_idx", "t"))
    return rows.select("session_id", "turn_idx", "t.role", "t.content", F.col("t.at").alias("turn_at"))


def unclean(sessions: DataFrame) -> DataFrame:
    """Sessions that didn't end with a clean shutdown."""
    return sessions.where(~F.coalesce("clean_shutdown", F.lit(False)))
