"""Traces as JSON arrays: read and written with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, geid (position in the array), kind, payload (JSON text) and common scalars of every event."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "array<string>").alias("items"))
    rows = docs.select("path", F.posexplode("items").alias("geid", "item"))
    kind = F.coalesce(F.element_at(F.json_object_keys("item"), 1), F.regexp_replace("item", '"', ""))
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    return (
        rows.withColumn("kind", kind).withColumn("payload", F.map_values(F.from_json("item", "map<string,string>"))[0])
        .select(
            "path", F.col("geid").cast("long").alias("geid"), "kind", "payload", field("path_id").cast("long").alias("path_id"), field("line").cast("long").alias("line"),
            field("function_id").cast("long").alias("function_id"), field("variable_id").cast("long").alias("variable_id"), field("name").alias("name"),
            F.when(F.col("kind").isin("ThreadStart", "ThreadExit", "ThreadSwitch"), F.col("payload")).cast("long").alias("thread_id"),
        )
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """position, kind, payload and common scalars of a folder of JSON objects, a line each, as `write` leaves it.

    Lines are split over tasks wherever Spark splits files; part files and the places in them give the order.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.withColumn("part", F.regexp_extract("file", r"part-([0-9]+)", 1).cast("long"))
    item = F.col("value")
    kind = F.coalesce(F.element_at(F.json_object_keys(item), 1), F.regexp_replace(item, '"', ""))
    field = lambda name: F.get_json_object("payload", f"$.{name}").cast("long").alias(name)
    rows = lines.select("part", "at", kind.alias("kind"), F.map_values(F.from_json(item, "map<string,string>"))[0].alias("payload"))
    # a part file comes from one task and is read in one or more: its splits keep their order within it
    order = Window.partitionBy("part").orderBy("at")
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("r", F.row_number().over(order) - 1).join(sizes.select("part", before.alias("before")), "part")
    return placed.select((F.col("before") + F.col("r")).cast("long").alias("position"), "kind", "payload", *map(field, ("path_id", "line", "function_id", "variable_id")))


def write(events: DataFrame, path: str) -> None:
    """JSON objects of (geid, kind, payload) rows, one line each in the order of geid within and across part files."""
    quoted = F.to_json(F.array("payload"))
    shown = F.when(F.col("kind").isin("Path", "VariableName", "Variable"), F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(F.col("payload"))
    line = F.when(F.col("payload").isNull(), F.concat(F.lit('"'), "kind", F.lit('"'))).otherwise(F.concat(F.lit('{"'), "kind", F.lit('":'), shown, F.lit("}")))
    events.repartitionByRange("geid").sortWithinPartitions("geid").select(line.alias("value")).write.text(path)
