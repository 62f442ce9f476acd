"""Queries over storage configurations and manifests. Both are made of the tables, with breaches of every rule among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import scalars
from strandline.operators import rules, storage
from strandline.plans.adapter import table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _count(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON configuration for each supplier, read back by the schema."""
    k, nation = F.col("s_suppkey"), F.col("s_nationkey")
    server = lambda i: F.struct(F.when((k % 31 == 0) & (F.lit(i) == 1), " ").otherwise(f"srv{i}").alias("id"), F.when(k % 17 == i, "").otherwise(_text(f"https://h{i}.example/", k)).alias("base_url"))
    servers = F.when(k % 19 == 0, F.array().cast("array<struct<id:string,base_url:string>>")).otherwise(F.array(server(0), server(1)))
    pool = lambda i, purpose, ids: F.struct(F.lit(f"pool{i}").alias("id"), F.lit(purpose).alias("purpose"), ids.alias("server_ids"))
    known, unknown = F.array(F.lit("srv0")), F.array(F.lit("srv1"), F.lit("srv9"))
    pools = F.array_compact(F.array(
        F.when(k % 5 != 1, pool(0, "ctfs", F.when(k % 7 == 2, unknown).otherwise(known))), F.when(k % 5 != 2, pool(1, "manifest", F.array(F.lit("srv1"), F.lit("srv0")))),
        F.when(k % 5 != 3, pool(2, "materialized_artifact", F.when(k % 11 == 4, F.array().cast("array<string>")).otherwise(known))),
    ))
    lease = F.when(k % 6 != 0, F.struct(
        F.when(k % 13 == 1, "").otherwise("https://lease.example").alias("endpoint_url"), F.when(k % 13 == 2, " ").otherwise("org").alias("organization_id"),
        F.when(k % 13 == 3, "").otherwise(_text("session-", k)).alias("client_session_id"), F.when(k % 13 == 4, "other").when(k % 2 == 0, "recording").otherwise("replay").alias("session_kind"),
        F.when(k % 13 == 5, "").otherwise("key").alias("credential"),
    ))
    fields = F.struct(
        F.when(k % 11 == 0, "v0").otherwise("v1").alias("schema"), F.when(k % 7 == 0, "  ").otherwise(_text("tenant-", k)).alias("tenant_id"),
        F.when(k % 4 != 0, "direct_storage").otherwise("managed_upload").alias("mode"), (nation * 1000).cast("long").alias("max_segment_bytes"),
        F.when(k % 13 == 0, 0).otherwise(1 << 23).alias("block_range_bytes"), (k % 3 == 0).alias("shard_enabled"), (k % 4).alias("shard_count"),
        (k % 3).alias("min_replicas"), (k % 5).alias("target_replicas"), nation.alias("retained_for_days"), F.lit(12).alias("delete_after_days"),
        _text("pool", k % 4).alias("artifact_pool"), lease.alias("lease"), servers.alias("servers"), pools.alias("pools"),
    )
    texts = table(spark, sf_dir, "supplier").select(k.alias("config"), F.to_json(fields).alias("json"))
    return texts.select("config", F.from_json("json", rules.CONFIG_SCHEMA).alias("c")).select("config", "c.*")


@query
def config_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.broken(configs(spark, sf_dir), rules.config_rules(), "config")


@query
def first_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_servers(configs(spark, sf_dir).where("mode = 'direct_storage'"), "config")


def manifests(spark: SparkSession, sf_dir: str, objects: bool = True) -> DataFrame:
    """An order is a recording and its lines are its segments or artifacts, in a fixed order; see `rules.MANIFEST`.

    Lines are shuffled and sorted as the five numbers that they are made of; objects and shards are built from those afterwards,
    and are left out of the segments where `objects` is false: Spark does not prune fields of a transformed array.
    """
    columns = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")

    def named(x: Column, suffix: str) -> Column:
        p, s = x["l_partkey"], x["l_suppkey"]
        return F.struct(
            F.when(s % 19 == 0, " ").otherwise(_text("o", p, "-", s, suffix)).alias("object_id"), F.when(p % 23 == 0, "").otherwise(_text("s3://pool/", p, suffix)).alias("uri"),
            F.when(s % 7 == 0, 0).otherwise(x["l_quantity"]).cast("long").alias("size_bytes"), F.when(p % 29 == 0, "").otherwise(x["digest"]).alias("sha256"),
            F.struct(F.lit("pool0").alias("pool"), F.lit("srv0").alias("server_id")).alias("placement"), F.when(p % 31 == 0, "pending").otherwise("uploaded").alias("upload"), F.lit("hot").alias("data_state"),
        )

    def shards(x: Column) -> Column:
        p, both = x["l_partkey"], F.array(named(x, "-a"), named(x, "-b"))
        replicas = F.when(p % 41 == 0, F.slice(both, 1, 0)).otherwise(both)
        shard = lambda i, start, end: F.struct(F.lit(i).alias("shard_index"), F.lit(start).cast("long").alias("block_start"), end.cast("long").alias("block_end"), replicas.alias("replicas"))
        two = F.array(shard(0, 0, F.lit(63)), shard(1, 64, F.when(p % 37 == 0, 60).otherwise(63 + 10 * x["l_linenumber"])))
        return F.when(p % 43 == 0, F.slice(two, 1, 0)).otherwise(two)

    held = lambda x: (named(x, "").alias("file"), shards(x).alias("shards")) if objects else ()
    segment = lambda x, i: F.struct(
        (i + (x["l_partkey"] % 17 == 0).cast("int")).alias("index"), (100 * i + 1).cast("long").alias("geid_start"), (100 * i + 90 + x["l_linenumber"]).cast("long").alias("geid_end"),
        *held(x),
    )
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*columns).alias("x"))
    lines = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("numbers"))  # an order has at most a few lines
    kind = F.element_at(F.array(*map(F.lit, ("materialized_artifact", "single_ctfs", "split_ctfs", "sharded_split_ctfs"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    with_digest = lambda x: F.struct(*(x[c].alias(c) for c in columns), F.sha2(x["l_partkey"].cast("string"), 256).alias("digest"))
    n = F.col("n")
    rows = rows.select("o_orderkey", "kind", F.coalesce(F.size("numbers"), F.lit(0)).alias("n"), F.transform("numbers", with_digest).alias("lines"))
    claimed = F.when(F.col("kind") == "single_ctfs", F.when(F.col("o_orderkey") % 9 == 0, 2).otherwise(1)).otherwise(F.greatest(n, F.lit(0)) + (F.col("o_orderkey") % 9 == 0).cast("int"))
    files = F.transform("lines", lambda x: named(x, ""))
    split = F.col("kind").isin("split_ctfs", "sharded_split_ctfs")
    return rows.where((n > 0) | split | (F.col("kind") == "materialized_artifact")).select(
        F.col("o_orderkey").alias("recording"), "kind", claimed.cast("int").alias("total_slices"), F.try_element_at(F.transform(F.slice("lines", 1, 1), lambda x: named(x, "")), F.lit(1)).alias("file"),
        F.when(F.col("kind") == "materialized_artifact", F.coalesce(files, F.array())).alias("artifacts"),
        F.when(split, F.coalesce(F.transform("lines", segment), F.array())).alias("segments"),
    )


@query
def finalize_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.finalize_violations(manifests(spark, sf_dir)).groupBy("recording", "segment", "rule").agg(_count())


@query
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests(spark, sf_dir, objects=False).select("recording", "kind", rules.segment_count().cast("int").alias("segments"))


@query
def geid_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last geid of recordings in segments; events as stated (end less start) and as they are (one more)."""
    s = manifests(spark, sf_dir, objects=False).select("recording", F.explode("segments").alias("s")).select("recording", "s.*")
    stated = F.greatest(F.col("geid_end") - F.col("geid_start"), F.lit(0))
    return s.groupBy("recording").agg(F.min("geid_start").alias("geid_start"), F.max("geid_end").alias("geid_end"), F.sum(stated).alias("stated"), F.sum(stated + 1).alias("events"))


@query
def finalize_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = manifests(spark, sf_dir).where("kind = 'sharded_split_ctfs'").select("recording", F.explode("segments").alias("s")).select("recording", F.explode("s.shards").alias("h"))
    total = F.aggregate("h.replicas", F.lit(0).cast("long"), lambda acc, r: acc + r["size_bytes"])
    return shards.groupBy("recording").agg(F.sum(total).alias("bytes_written"), F.sum(F.size("h.replicas")).alias("replicas"), _count("shards"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of every segment of the sharded recordings."""
    rows = manifests(spark, sf_dir).where("kind = 'sharded_split_ctfs'")
    return rows.select("recording", F.posexplode("segments").alias("segment", "s")).select("recording", "segment", (F.col("recording") * 7 % 140).alias("block"))


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifests(spark, sf_dir).where("kind = 'sharded_split_ctfs'").select("recording", F.posexplode("segments").alias("segment", "s"))
    return rows.select("recording", "segment", F.explode("s.shards").alias("h")).select("recording", "segment", "h.*")


@query
def manifest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.resolve_blocks(_shards(spark, sf_dir), _asked(spark, sf_dir), keys=("recording", "segment"))


@query
def replica_failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first replica that can be read; here the first ones of every third object cannot."""
    usable = lambda r: ~(r["object_id"].endswith("-a") & (F.length(r["object_id"]) % 3 == 0))
    return storage.resolve_blocks(_shards(spark, sf_dir), _asked(spark, sf_dir), usable, keys=("recording", "segment")).select("recording", "segment", "object_id")


@query
def finalize_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with one key count as attempts of one; the first of them is the one that takes effect."""
    rows = table(spark, sf_dir, "lineitem").select(_text(F.col("l_suppkey"), "/", F.col("l_linenumber")).alias("key"), F.struct("l_shipdate", "l_orderkey", "l_partkey").alias("at"))
    first = rows.groupBy("key").agg(F.min("at").alias("first"), _count("attempts"))
    return first.select("key", F.col("first.l_orderkey").alias("recording"), "attempts")


@query
def upload_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upload's state after its attempts: uploaded and fatal ones end it, later attempts change nothing."""
    state = F.when(F.col("l_returnflag") == "A", "uploaded").when(F.col("l_returnflag") == "N", "retryable_failure").otherwise("fatal_failure")
    tries = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("object"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey").alias("at"), state.alias("state"))
    order = Window.partitionBy("object").orderBy("at")
    ended = F.max(F.when(F.col("state") != "retryable_failure", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    real = tries.withColumn("over", F.coalesce(ended, F.lit(0))).where("over = 0")
    return real.groupBy("object").agg(F.max_by("state", "at").alias("state"), _count("attempts"))


@query
def content_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content is empty or is not what their recorded digest says (every fiftieth was altered)."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.sha2(F.when(F.col("doc_id") % 50 == 7, F.concat(text, F.lit("x"))).otherwise(text), 256).alias("sha256"))
    return rules.broken(rows, {"digest": F.sha2("text", 256) != F.col("sha256"), "empty": F.col("text") == ""}, "doc_id")


@query
def object_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint and key of an object, the key encoded for a URL."""
    key = _text("rec ", F.col("p_partkey"), "/é&", F.col("p_partkey") % 7)
    encoded = F.regexp_replace(F.url_encode(key), r"\+", "%20")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("https://h.example/"), encoded).alias("uri"), F.url_decode(encoded).alias("key"))


@query
def manifest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests as JSON text and back by their schema: nothing that decides about a recording is lost."""
    rows = manifests(spark, sf_dir)
    texts = rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
    back = texts.select(F.from_json("json", rules.MANIFEST, {"mode": "FAILFAST"}).alias("m")).select("m.*")  # with an option, texts are never skipped
    return rules.finalize_violations(back).groupBy("recording", "rule").agg(_count())


@query
def next_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty objects to send again, in the order of their keys."""
    key = F.lpad(F.col("object").cast("string"), 12, "0")
    return upload_states(spark, sf_dir).where("state = 'retryable_failure'").select(key.alias("key"), "attempts").orderBy("key").limit(20)


@query
def first_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of version 7 sort by their time of creation: the ten first of them, and that time."""
    millis = 1700000000000 + F.col("c_custkey") * 7919 % 100003
    digits = F.lpad(F.lower(F.hex(millis)), 12, "0")
    uuid = F.concat(F.substring(digits, 1, 8), F.lit("-"), F.substring(digits, 9, 4), F.lit("-7000-8000-"), F.lpad(F.lower(F.hex("c_custkey")), 12, "0"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", uuid.alias("recording")).orderBy("recording").limit(10)
    return rows.select("c_custkey", "recording", scalars.uuid7_millis(F.col("recording")).alias("millis"), scalars.is_uuid7(F.col("recording")).alias("valid"))
