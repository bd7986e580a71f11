"""The human-edited JSON-lines file of pinned rules."""

from __future__ import annotations

import json
import os
import tempfile
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions import ulid
from lamina.schemas import PINNED_ITEM, TAGS

_LINE = T.StructType().add("id", "string").add("content", "string").add("tags", TAGS).add("scope", "string").add("created_at", "string").add("added_at", "string").add("_bad", "string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Pins in file order with `line_no`; blanks, # comments and malformed lines are left out, a missing file is empty.

    The file is small and edited by hand: numbering its lines needs one task. Never cached, so edits show at the next read.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], PINNED_ITEM).withColumn("line_no", F.lit(0).cast("long"))
    whole = spark.read.text(path, wholetext=True)
    broken = F.when(F.contains("value", F.lit("�")), F.raise_error(F.lit("pins aren't valid UTF-8")).cast("string")).otherwise(F.col("value"))
    lines = whole.select(F.posexplode(F.split(broken, "\r?\n")).alias("line_no", "line")).where("trim(line) <> '' and not ltrim(line) like '#%'")
    rows = lines.select((F.col("line_no") + 1).cast("long").alias("line_no"), F.from_json("line", _LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("line_no", "r.*")
    made = F.to_timestamp(F.coalesce("created_at", "added_at"))
    good = rows.where("_bad is null and id is not null and content is not null and scope is not null").withColumn("created_at", made).where("created_at is not null")
    return good.select("id", "content", F.coalesce("tags", F.array().cast(TAGS)).alias("tags"), "scope", "created_at", "line_no")


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank or comments, malformed ones included."""
    return spark.read.text(path).where("trim(value) <> '' and not ltrim(value) like '#%'").count()


def append(path: str, content: str, scope: str, tags: list[str] | None = None, now: datetime | None = None) -> str:
    """Pin a rule; returns its id."""
    content = content.strip()
    if not content:
        raise ValueError("content must not be blank")
    row = {"id": ulid.new(), "content": content, "tags": tags or [], "scope": scope, "created_at": (now or datetime.now(timezone.utc)).isoformat()}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(row, ensure_ascii=False) + "\n")
    return row["id"]


def remove(path: str, pin_id: str) -> bool:
    """Rewrite the file without a pin (comments stay), atomically; whether it was there."""
    if not os.path.exists(path):
        return False

    def holds(line: str) -> bool:
        try:
            return json.loads(line).get("id") == pin_id
        except (ValueError, AttributeError):
            return False

    with open(path, encoding="utf-8") as f:
        lines = f.readlines()
    kept = [line for line in lines if not holds(line)]
    if len(kept) == len(lines):
        return False
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.writelines(kept)
    os.replace(temporary, path)
    return True
