"""Queries that write the trace in a format and read it again."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import positions, records
from strandline.plans.adapter import table, trace
from strandline.plans.values import with_payload
from strandline.scratch import shared_folder
from strandline import importable_on_workers
from strandline.sources import chunked, json_trace, side_tables

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace as events of the recorded kinds, with each kind's fields and nothing else."""
    rows = with_payload(trace(spark, sf_dir))
    of = lambda kinds, value: F.when(F.col("kind").isin(*kinds), value)
    return rows.select(
        "geid", "kind", of(("Step",), F.col("path_id")).alias("path_id"), of(("Step",), F.col("line")).alias("line"), of(("Call",), F.col("function_id")).alias("function_id"),
        of(("Value",), F.col("function_id")).alias("variable_id"), of(("Event",), F.col("line") % 14).cast("int").alias("log_kind"), of(("Event",), F.lit("")).alias("metadata"),
        of(("Event",), F.col("content")).alias("content"), F.when(F.col("kind") == "Call", F.lit("[]")).when(F.col("kind").isin("Value", "Return"), F.col("payload")).alias("payload"),
    )


def _kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = f"{shared_folder(spark)}/strandline-chunks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _shown(events: DataFrame) -> DataFrame:
    return events.select("geid", "kind", "path_id", "line", "function_id", "variable_id", "log_kind", "content", records.rendered(F.col("payload")).alias("shown"))


@query
def binary_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(chunked.decode(_kept(spark, chunked.encode(recorded(spark, sf_dir), "split-binary"))))


@query
def cbor_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(chunked.decode(_kept(spark, chunked.encode(recorded(spark, sf_dir), "cbor"))))


@query
def stream_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred events across the edge of two chunks; the others stay compressed."""
    return _shown(chunked.decode(_kept(spark, chunked.encode(recorded(spark, sf_dir))), 4050, 100))


@query
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked.encode(recorded(spark, sf_dir)).select("chunk_id", "first_geid", "event_count")


@query
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps, values and returns as JSON objects, a line each, read back in order."""
    rows = recorded(spark, sf_dir).where("kind IN ('Step', 'Value')")
    step = F.to_json(F.struct("path_id", "line"))
    value = F.concat(F.lit('{"variable_id":'), F.col("variable_id").cast("string"), F.lit(',"value":'), F.col("payload"), F.lit("}"))
    path = f"{shared_folder(spark)}/strandline-json-{uuid.uuid4().hex}"
    json_trace.write(rows.select("geid", "kind", F.when(F.col("kind") == "Step", step).otherwise(value).alias("payload")), path)
    read = json_trace.read_lines(spark, path)
    return read.select("position", "kind", "path_id", "line", "variable_id", records.rendered(F.get_json_object("payload", "$.value")).alias("shown"))


@query
def detected_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all formats, and of none, told apart by their first bytes."""
    k = F.col("p_partkey") % 5
    head = F.when(k == 0, F.lit(chunked.BEGINNINGS["cbor-zstd"])).when(k == 1, F.lit(chunked.BEGINNINGS["binary-v0"])).when(k == 2, F.lit(chunked.MAGIC + bytes([3, 1, 0])))
    content = F.concat(head.when(k == 3, F.lit(b'\n [{"Step":')).otherwise(F.lit(b"other")), F.col("p_name").cast("binary"))
    return table(spark, sf_dir, "part").select("p_partkey", chunked.detected(content).alias("format"))


@query
def shortened_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalars.shortened(F.col("text")).alias("shown"))


@query
def labels_and_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % n + 1).cast("int"))
    label, name = pick((*scalars.VALUE_KINDS, "other"), 6), pick(("Python", "JS", " ruby ", "javascript", "go"), 5)
    kind = scalars.content_type(pick(("ctfs", "manifest", "json", "other"), 4))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.value_kind_number(label).alias("kind"), scalars.language(name).alias("language"), kind.alias("content_type"))


#: Regions in a part of a recording's table.
REGIONS_A_PART = 1 << 12


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapped regions of each nation, from its table: one region a supplier, in its own 128 KiB.

    A table is packed in parts of some thousand regions, each with the number of its first one, so that no task holds a nation.
    """
    importable_on_workers(spark)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        held = [(k << 17, 4096 * (1 + k % 30), scalars.base40_encode(f"bin{k % 5}"), 512 * k, k % 8) for k in rows["s_suppkey"].tolist()]
        return pd.DataFrame({"recording": rows["s_nationkey"].iloc[:1], "first": rows["at"].iloc[:1], "content": [side_tables.encode_regions(held)]})

    suppliers = positions.ordinals(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "at", "s_suppkey", ("s_nationkey",))
    parts = suppliers.groupBy("s_nationkey", F.floor(F.col("at") / REGIONS_A_PART).alias("part"))
    held = side_tables.regions(parts.applyInPandas(pack, "recording long, first long, content binary"), "recording", "first")
    return held.withColumn("region", (F.col("first") + F.col("region")).cast("int")).drop("first")


@query
def mapped_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir)


@query
def address_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which region, and so which binary, an address falls into."""
    suppliers = F.col("o_orderkey") % 120
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).cast("long").alias("recording"), (suppliers * (1 << 17) + F.col("o_orderkey") * 37 % 131072).cast("long").alias("address"))
    return side_tables.located(asked, _regions(spark, sf_dir), "recording").select("o_orderkey", "recording", "address", "region", "binary", "offset")


@query
def recorded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binaries, debug symbols and sources of each recording; symbols with the path of the binary that they belong to."""
    importable_on_workers(spark)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        entries = []
        for k in sorted(rows["p_partkey"].tolist()):
            one = {"name": scalars.base40_encode(f"f{k}"), "flags": k % 4, "build_id": bytes([k % 251]) * (k % 3), "path": f"/usr/é/{k}"}
            entries.append(one | {"kind": "binary"} if k % 3 == 0 else one | {"kind": "debug_symbol", "binary": scalars.base40_encode(f"f{k - k % 3}")} if k % 3 == 1
                           else one | {"kind": "source_file", "folder": f"/src/{k}" * (k % 40)})
        return pd.DataFrame({"recording": rows["recording"].iloc[:1], "content": [side_tables.encode_files(entries)]})

    parts = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 300).alias("recording"))
    held = side_tables.files(parts.groupBy("recording").applyInPandas(pack, "recording long, content binary"))
    binaries = held.where("kind = 'binary'").select("recording", F.col("name").alias("binary"), F.col("path").alias("binary_path"))
    return held.join(binaries, ["recording", "binary"], "left").select("recording", "name", "kind", "flags", "build_id", "path", "binary", "binary_path", F.length("folder").alias("folder_length"))


@query
def events_at_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose bytes begin in a range of the stream."""
    sized = trace(spark, sf_dir).select("geid", "kind", (F.octet_length("content") + 17).cast("long").alias("size"))
    return positions.running(sized, F.col("size"), "byte_offset").where("byte_offset >= 5000 AND byte_offset < 9000").select("geid", "kind", "byte_offset")


@query
def appended_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace after another one: a bag union, with the second one's geids moved behind the first one's."""
    rows = trace(spark, sf_dir).select("geid", "kind", "line")
    last = rows.agg((F.max("geid") + 1).alias("shift")).withColumn("second", F.lit(1))
    both = rows.withColumn("second", F.lit(0)).unionByName(rows.where("kind = 'Step'").withColumn("second", F.lit(1)))
    return both.join(F.broadcast(last), "second", "left").select((F.col("geid") + F.coalesce("shift", F.lit(0))).alias("geid"), "kind", "line")  # one row is sent
