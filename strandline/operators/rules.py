"""Validation as tables: each rule is a name and a condition, and what breaks it becomes a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.schema import OBJECT

Rules = dict[str, Column]

CONFIG_SCHEMA = """schema string, tenant_id string, mode string, max_segment_bytes bigint, block_range_bytes bigint, shard_enabled boolean, shard_count int,
min_replicas int, target_replicas int, retained_for_days int, delete_after_days int, artifact_pool string,
lease struct<endpoint_url: string, organization_id: string, client_session_id: string, session_kind: string, credential: string>,
servers array<struct<id: string, base_url: string>>, pools array<struct<id: string, purpose: string, server_ids: array<string>>>"""
SCHEMA_NAME = "v1"
PURPOSES = ("ctfs", "materialized_artifact", "manifest")  # fixed values


def names(rules: Rules) -> Column:
    """The names of the rules whose condition holds; a null condition does not."""
    return F.array_compact(F.array(*(F.when(condition, name) for name, condition in rules.items())))


def broken(rows: DataFrame, rules: Rules, *keep: str) -> DataFrame:
    """(keep, rule) for every rule whose condition holds."""
    return rows.select(*keep, F.explode(names(rules)).alias("rule"))


def blank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c), F.lit("")) == ""


def config_rules() -> Rules:
    """A configuration on its own; the rules of direct storage apply to that mode only."""
    direct, lease = F.col("mode") == "direct_storage", F.col("lease").isNotNull()
    has_servers, listed = F.size("servers") > 0, F.transform("servers", lambda s: s["id"])
    leased = lambda condition: direct & lease & condition
    out = {
        "schema": F.col("schema") != SCHEMA_NAME, "tenant": blank("tenant_id"), "max_segment_bytes": F.col("max_segment_bytes") <= 0,
        "block_range_bytes": F.col("block_range_bytes") <= 0, "shard_count": F.col("shard_enabled") & (F.col("shard_count") == 0),
        "replicas": (F.col("min_replicas") == 0) | (F.col("target_replicas") < F.col("min_replicas")), "retention": F.col("delete_after_days") < F.col("retained_for_days"),
        "lease": direct & ~lease, "lease_endpoint": leased(blank("lease.endpoint_url")), "lease_organization": leased(blank("lease.organization_id")),
        "lease_session": leased(blank("lease.client_session_id")), "lease_session_kind": leased(~F.col("lease.session_kind").isin("recording", "replay")),
        "lease_credential": leased(blank("lease.credential")), "servers": direct & ~has_servers,
        "server_id": direct & F.exists("servers", lambda s: blank(s["id"])), "server_endpoint": direct & F.exists("servers", lambda s: blank(s["base_url"])),
        "pool_empty": direct & F.exists("pools", lambda p: F.size(p["server_ids"]) == 0),
        "pool_server": direct & F.exists("pools", lambda p: F.size(F.array_except(p["server_ids"], listed)) > 0),
        "artifact_pool": direct & ~F.exists("pools", lambda p: p["id"] == F.col("artifact_pool")),
    }
    has_pool = lambda purpose: F.exists("pools", lambda p: p["purpose"] == purpose)
    return out | {f"pool_for_{purpose}": direct & ~has_pool(purpose) for purpose in PURPOSES}


def first_servers(configs: DataFrame, *keep: str) -> DataFrame:
    """(keep, purpose, pool, server, base_url): the first pool of each purpose and its first server."""
    pool = lambda x: F.try_element_at(F.filter("pools", lambda p: p["purpose"] == x), F.lit(1))
    rows = configs.select(*keep, "servers", F.explode(F.array(*(F.struct(F.lit(x).alias("purpose"), pool(x).alias("p")) for x in PURPOSES))).alias("x"))
    rows = rows.where("x.p IS NOT NULL").select(*keep, "servers", "x.purpose", F.col("x.p.id").alias("pool"), F.try_element_at(F.col("x.p.server_ids"), F.lit(1)).alias("server"))
    found = F.try_element_at(F.filter("servers", lambda s: s["id"] == F.col("server")), F.lit(1))["base_url"]
    return rows.select(*keep, "purpose", "pool", "server", found.alias("base_url"))


def object_rules(o: Column) -> Rules:
    return {
        "object_id": blank(o["object_id"]), "uri": blank(o["uri"]), "size": F.coalesce(o["size_bytes"], F.lit(0)) <= 0, "sha256": blank(o["sha256"]),
        "upload": F.coalesce(o["upload"], F.lit("")) != "uploaded",
    }


#: One row a recording: kind, total_slices, file, artifacts and segments (with shards).
MANIFEST = f"""recording bigint, kind string, total_slices int, file {OBJECT}, artifacts array<{OBJECT}>,
segments array<struct<`index`: int, geid_start: bigint, geid_end: bigint, file: {OBJECT},
shards: array<struct<shard_index: int, block_start: bigint, block_end: bigint, replicas: array<{OBJECT}>>>>>"""


def segment_count() -> Column:
    return F.when(F.col("kind") == "single_ctfs", 1).when(F.col("kind").isin("split_ctfs", "sharded_split_ctfs"), F.size("segments")).otherwise(0)


def finalize_violations(manifests: DataFrame) -> DataFrame:
    """(recording, segment, rule) for what keeps a recording from being complete; segment is null for the recording itself.

    One pass: all breaches of a manifest are listed in its row, then exploded.
    """
    kind, n = F.col("kind"), F.size("segments")
    split, sharded, artifacts = kind.isin("split_ctfs", "sharded_split_ctfs"), kind == "sharded_split_ctfs", kind == "materialized_artifact"
    nothing = F.array().cast("array<string>")
    only = lambda condition, listed: F.when(condition, F.coalesce(listed, nothing)).otherwise(nothing)
    at = lambda segment, listed: F.transform(listed, lambda r: F.struct(segment.cast("int").alias("segment"), r.alias("rule")))
    of_objects = lambda listed: F.flatten(F.transform(listed, lambda o: names(object_rules(o))))

    def of_shard(h: Column) -> Column:
        own = names({"block_range": h["block_end"] < h["block_start"], "no_replicas": F.size(h["replicas"]) == 0})
        return F.concat(own, of_objects(h["replicas"]))

    def of_segment(s: Column, i: Column) -> Column:
        own = names({"index": s["index"] != i, "no_shards": sharded & (F.size(s["shards"]) == 0)})
        shards = only(sharded, F.flatten(F.transform(s["shards"], of_shard)))
        return at(i, F.concat(own, shards, only(~sharded, names(object_rules(s["file"])))))

    whole = names({
        "no_artifacts": artifacts & (F.size("artifacts") == 0), "one_slice": (kind == "single_ctfs") & (F.col("total_slices") != 1),
        "no_segments": split & ((F.col("total_slices") == 0) | (n == 0)), "slices": split & (F.col("total_slices") > 0) & (n > 0) & (n != F.col("total_slices")),
    })
    files = only(~split, F.concat(names(object_rules(F.col("file"))), only(artifacts, of_objects(F.col("artifacts")))))
    each = F.when(split, F.flatten(F.transform("segments", of_segment)))
    every = F.concat(at(F.lit(None), F.concat(whole, files)), F.coalesce(each, at(F.lit(None), nothing)))
    # outer: for a plain explode Spark adds a filter on the size of the list, which makes the list a second time
    return manifests.select("recording", F.explode_outer(every).alias("x")).where("x IS NOT NULL").select("recording", "x.segment", "x.rule")
