"""The `events` table seen as one deterministic trace, so that trace operators run on any scale of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_of_events(events: DataFrame) -> DataFrame:
    """geid, thread_id, kind, path_id, line, function_id, value, content; all projections, so scans stay pruned."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = (
        F.when(F.col("event_type") == "signup", "Call").when(F.col("event_type") == "purchase", "Return")
        .when(F.col("event_type") == "view", "Step").when(F.col("event_type") == "click", "Value").otherwise("Event")
    )
    return events.select(
        F.col("event_id").alias("geid"), F.col("user_id").alias("thread_id"), kind.alias("kind"), (F.col("user_id") % 7).alias("path_id"),
        k.alias("line"), (k % 10).alias("function_id"), "value", F.col("props").alias("content"), "ts",
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_of_events(table(spark, sf_dir, "events"))


#: The same view in DuckDB.
TRACE_SQL = """trace AS (
  SELECT event_id AS geid, user_id AS thread_id,
         CASE event_type WHEN 'signup' THEN 'Call' WHEN 'purchase' THEN 'Return' WHEN 'view' THEN 'Step' WHEN 'click' THEN 'Value' ELSE 'Event' END AS kind,
         user_id % 7 AS path_id, (props->>'$.k')::BIGINT AS line, (props->>'$.k')::BIGINT % 10 AS function_id, value, props AS content, ts
  FROM events
)"""
