"""Value records: recursive JSON values of fifteen kinds, rendered and flattened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.scratch import checkpointed
from strandline.schema import TYPE_KINDS

# The type kind that each kind of value is shown with.
KIND_OF_TYPE = {
    "Int": "Int", "Float": "Float", "Bool": "Bool", "String": "String", "Raw": "Raw", "Error": "Error", "None": "None", "Char": "Char", "Sequence": "Seq",
    "Tuple": "Tuple", "Struct": "Struct", "Variant": "Variant", "Reference": "Pointer", "Cell": "Raw", "BigInt": "Int",
}


def _get(payload: Column, name: str) -> Column:
    return F.get_json_object(payload, f"$.{name}")


def rendered(payload: Column) -> Column:
    """A record as short text: scalars as they are, containers without their contents."""
    kind, get = _get(payload, "kind"), lambda name: _get(payload, name)
    plain = {"Int": "i", "Float": "f", "Bool": "b", "String": "text", "Raw": "r", "Error": "msg", "Char": "c", "Variant": "discriminator"}
    out = F.when(kind == "None", "None").when(kind == "Sequence", "[...]").when(kind == "Tuple", "(...)").when(kind == "Struct", "{...}")
    for name, field in plain.items():
        out = out.when(kind == name, get(field))
    return (
        out.when(kind == "Reference", F.concat(F.lit("0x"), F.lower(F.hex(get("address").cast("long"))))).when(kind == "Cell", F.concat(F.lit("place_"), get("place")))
        .when(kind == "BigInt", F.concat(F.when(get("negative") == "true", "-").otherwise(""), F.lit("(bigint)")))
    )


def type_kind(payload: Column) -> Column:
    """Number of the type kind that a record is shown with."""
    numbers = F.create_map(*(x for kind, name in KIND_OF_TYPE.items() for x in (F.lit(kind), F.lit(TYPE_KINDS.index(name)))))
    return F.try_element_at(numbers, _get(payload, "kind"))


def type_name(payload: Column) -> Column:
    return F.when(_get(payload, "kind") == "Cell", "Cell").otherwise(F.concat(F.lit("type_"), F.coalesce(_get(payload, "type_id"), F.lit("0"))))


def big_integer(payload: Column) -> Column:
    """The number of a BigInt record: big-endian bytes in base64, with a sign. Null for other kinds and beyond fifteen bytes."""
    raw = F.unbase64(_get(payload, "b"))
    digits = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(raw), F.lit(1))), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("decimal(38,0)"))
    # sums of parts are exact: 15 bytes are below 2^120 < 10^38
    value = F.aggregate(digits, F.lit(0).cast("decimal(38,0)"), lambda acc, d: (acc * F.lit(256).cast("decimal(3,0)") + d).cast("decimal(38,0)"))
    known = (_get(payload, "kind") == "BigInt") & (F.octet_length(raw) <= 15)
    return F.when(known, F.when(_get(payload, "negative") == "true", -value).otherwise(value).cast("decimal(38,0)"))


def _children(payload: Column) -> Column:
    listed = lambda name: F.from_json(_get(payload, name), "array<string>")
    one = lambda name: F.when(_get(payload, name).isNotNull(), F.array(_get(payload, name)))
    return F.coalesce(listed("elements"), listed("field_values"), one("contents"), one("dereferenced"))


def nodes(values: DataFrame) -> DataFrame:
    """(geid, node, parent, pos, kind, type_id, payload) for every record inside the `payload` of (geid, payload) rows.

    A node is named by the positions on its way, as in `0.2`; the record itself is the empty name. One pass for each level of nesting.
    """
    level = values.select("geid", F.lit("").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("pos"), "payload")
    out = level
    while True:
        below = level.select("geid", F.col("node").alias("parent"), F.posexplode(_children(F.col("payload"))).alias("pos", "payload"))
        dotted = F.concat_ws(".", F.when(F.col("parent") != "", F.col("parent")), F.col("pos").cast("string"))
        level = checkpointed(below.select("geid", dotted.alias("node"), "parent", "pos", "payload"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select("geid", "node", "parent", "pos", _get(F.col("payload"), "kind").alias("kind"), _get(F.col("payload"), "type_id").cast("long").alias("type_id"), "payload")
