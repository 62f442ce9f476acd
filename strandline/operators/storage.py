"""Storage manifests: parsing and block resolution with failover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.schema import MANIFEST_SCHEMA


def parse(documents: DataFrame, column: str = "json") -> DataFrame:
    return documents.select(F.from_json(column, MANIFEST_SCHEMA).alias("m")).select("m.*")


def segments(manifests: DataFrame) -> DataFrame:
    """One row a segment; a single file is one segment."""
    listed = F.when(F.size("source.segments") > 0, F.col("source.segments"))
    return manifests.select("recording_id", F.explode_outer(listed).alias("s")).select("recording_id", "s.*")


def shards(manifests: DataFrame) -> DataFrame:
    return segments(manifests).select("recording_id", F.col("index").alias("segment"), F.explode("shards").alias("h")).select("recording_id", "segment", "h.*")


def resolve_blocks(shard_rows: DataFrame, asked: DataFrame, usable: Callable[[Column], Column] | None = None, keys: tuple[str, ...] = ("segment",)) -> DataFrame:
    """`asked` (keys, block) rows with the first shard that covers the block and its first usable replica.

    The keys are joined by equality and the shard's range is a residual condition; of several shards the lowest wins.
    """
    replicas = F.col("replicas") if usable is None else F.filter("replicas", usable)
    held = shard_rows.select(*keys, "shard_index", "block_start", "block_end", F.try_element_at(replicas, F.lit(1))["object_id"].alias("object_id"))
    hits = asked.join(held, list(keys)).where("block BETWEEN block_start AND block_end")
    first = hits.groupBy(*asked.columns).agg(F.min_by(F.struct("shard_index", "object_id"), "shard_index").alias("x"))
    return first.select(*asked.columns, "x.shard_index", "x.object_id")
