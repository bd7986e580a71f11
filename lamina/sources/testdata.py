"""The shared test tables as memory layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The projections, in SQL that DuckDB runs as well.
EPISODIC = """select event_id as id, event_type as kind,
  case user_id % 3 when 0 then 'personal' when 1 then 'work' else 'client' end as scope,
  props as payload,
  cast(case event_type when 'error' then 0.2 when 'view' then 0.4 when 'click' then 0.6 when 'signup' then 0.8 else 1.0 end as double) as retrieval_weight,
  cast(date_trunc('day', ts) + interval 1 day as timestamp) as last_accessed,
  cast(ts as timestamp) as created_at
from events"""
SEMANTIC = """select doc_id as id, text as content,
  case doc_id % 4 when 0 then 'fact' when 1 then 'decision' when 2 then 'preference' else 'conversation' end as kind,
  lang as scope, source,
  timestamp '2024-01-31 00:00:00' - (doc_id % 720) * interval 1 hour as created_at
from documents"""
TURNS = """select conv_id as session_id, turn as turn_idx, role, text as content,
  cast(timestamp '2024-01-31 12:00:00' + conv_id * interval 1 minute + turn * interval 1 second as timestamp) as turn_at
from conversations"""
PINS = """select item_id as id, text as content,
  case item_id % 2 when 0 then 'personal' else 'work' end as scope,
  timestamp '2024-01-01 00:00:00' + item_id * interval 1 hour as created_at,
  item_id as line_no
from benchmark"""
NOW = "2024-02-01 00:00:00"


class Layers:
    """The layers of one directory of tables; each access is a fresh plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _projected(self, sql: str, table: str) -> DataFrame:
        head, _, _ = sql.rpartition(f"from {table}")
        return self.spark.sql(head + "from {rows}", rows=self.table(table))

    @property
    def episodic(self) -> DataFrame:
        return self._projected(EPISODIC, "events")

    @property
    def semantic(self) -> DataFrame:
        return self._projected(SEMANTIC, "documents")

    @property
    def turns(self) -> DataFrame:
        return self._projected(TURNS, "conversations")

    @property
    def pins(self) -> DataFrame:
        return self._projected(PINS, "benchmark")

    @property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").selectExpr("vec_id as id", "embedding")

    def query_vector(self, vec_id: int = 7) -> list[float]:
        """One stored vector, by a point read."""
        row = self.vectors.where(f"id = {vec_id}").first()
        return [float(x) for x in row["embedding"]]
