"""Side tables of a recording: which files it used and where they were mapped."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import importable_on_workers
from strandline.functions.scalars import BASE40, leb128_decode, leb128_encode

# How the tables begin, their version, the size of a region, the kinds of files in the order of their numbers.
MAPPED, FILES, FILES_VERSION, REGION_BYTES = b"MMAP", b"FMAP", 1, 33
FILE_KINDS = ("binary", "debug_symbol", "source_file")
#: Regions meet addresses by cells of this many bytes.
CELL = 1 << 16


def little_endian(raw: Column, at: Column | int, size: int) -> Column:
    """The whole number in `size` bytes of a binary from a position (1 is the first byte)."""
    at = F.lit(at) if isinstance(at, int) else at
    turned = F.concat(*(F.substring(raw, at + i, F.lit(1)) for i in reversed(range(size))))
    return F.conv(F.hex(turned), 16, 10).cast("decimal(20,0)")


def _bound(value: Column, to: Callable[[Column], Column]) -> Column:
    """`to` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), to), 1)


def base40_name(number: Column) -> Column:
    """The name that a number stands for, digit by digit up to the first 0."""
    over = lambda n, by: F.call_function("div", n, by)
    half = F.lit(40**6).cast("decimal(20,0)")
    halves = lambda n: F.array((n % half).cast("long"), over(n, half))  # noqa: E731  # both are below 2^33: the rest is done in longs
    digits = lambda h: F.array(*((over(h[i // 6], F.lit(40 ** (i % 6))) % 40).cast("int") for i in range(12)))
    upto = lambda d: F.when(F.array_position(d, F.lit(0)) > 0, F.slice(d, F.lit(1), (F.array_position(d, F.lit(0)) - 1).cast("int"))).otherwise(d)
    held = _bound(_bound(_bound(number.cast("decimal(20,0)"), halves), digits), upto)
    return F.when(number.isNotNull(), F.array_join(F.transform(held, lambda d: F.substring(F.lit(BASE40[1:]), d, F.lit(1))), ""))


def encode_regions(rows: list[tuple[int, int, int, int, int]]) -> bytes:
    """(address, size, binary, file offset, permissions) rows."""
    return MAPPED + struct.pack("<I", len(rows)) + b"".join(struct.pack("<QQQQB", *row) for row in rows)


def regions(tables: DataFrame, *keep: str) -> DataFrame:
    """A row a region of the `content` of each table, with built-in functions alone; a bad or cut-off table raises."""
    raw = F.col("content")
    count = little_endian(raw, 5, 4).cast("long")
    good = (F.substring(raw, 1, 4) == F.lit(MAPPED)) & (F.octet_length(raw) >= 8 + REGION_BYTES * count)
    # each region's bytes by themselves: a row for each region must not hold the whole table
    piece = lambda i: F.substring(raw, (9 + i * REGION_BYTES).cast("int"), F.lit(REGION_BYTES))
    pieces = F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), piece))
    listed = F.when(~F.coalesce(good, F.lit(False)), F.raise_error(F.lit("not a table of mapped regions, or cut off"))).otherwise(pieces)
    number = lambda offset, name, size=8, kind="long": little_endian(F.col("piece"), 1 + offset, size).cast(kind).alias(name)
    rows = tables.select(*keep, F.posexplode(listed).alias("region", "piece")).select(
        *keep, "region", number(0, "address"), number(8, "size"), number(16, "binary", kind="decimal(20,0)"), number(24, "file_offset"), number(32, "permissions", 1)
    )
    return rows.withColumn("binary", base40_name(F.col("binary")))


def located(asked: DataFrame, held: DataFrame, *keys: str) -> DataFrame:
    """`asked` (keys, address) rows with the region that holds each address, null where none does; regions do not overlap."""
    cells = held.where("size > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("address") / CELL), F.floor((F.col("address") + F.col("size") - 1) / CELL))))
    cells = cells.select(*keys, "cell", "region", "binary", F.col("address").alias("start"), F.col("size").alias("length"))
    a = asked.withColumn("cell", F.floor(F.col("address") / CELL))
    same = [F.col(f"a.{k}") == F.col(f"c.{k}") for k in (*keys, "cell")]
    inside = (F.col("a.address") >= F.col("c.start")) & (F.col("a.address") < F.col("c.start") + F.col("c.length"))
    return a.alias("a").join(cells.alias("c"), [*same, inside], "left").select("a.*", "c.region", "c.binary", (F.col("a.address") - F.col("c.start")).alias("offset")).drop("cell")


def encode_files(entries: list[dict]) -> bytes:
    """Entries of (name as a number, kind, flags, build_id, path) and binary (a number) or folder, as the kind has it."""
    out = [FILES, struct.pack("<HH", FILES_VERSION, len(entries))]
    sized = lambda text: leb128_encode(len(text.encode())) + text.encode()
    for e in entries:
        out.append(struct.pack("<QBBB", e["name"], FILE_KINDS.index(e["kind"]), e["flags"], len(e["build_id"])) + e["build_id"] + sized(e["path"]))
        if e["kind"] == "debug_symbol":
            out.append(struct.pack("<Q", e["binary"]))
        elif e["kind"] == "source_file":
            out.append(sized(e["folder"]))
    return b"".join(out)


def decode_files(data: bytes) -> list[dict]:
    """The entries of a table of files; a bad or cut-off one raises ValueError."""
    if data[:4] != FILES or len(data) < 8:
        raise ValueError("not a table of files")
    version, count = struct.unpack_from("<HH", data, 4)
    if version != FILES_VERSION:
        raise ValueError(f"version {version} of the table of files is not supported")
    at, out = 8, []

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError(f"the table of files is cut off at byte {at}")
        at += n
        return data[at - n : at]

    def text() -> str:
        nonlocal at
        n, at = leb128_decode(data, at)
        return take(n).decode()

    for _ in range(count):
        name, kind, flags, n = struct.unpack("<QBBB", take(11))
        if kind >= len(FILE_KINDS):
            raise ValueError(f"unknown kind of file {kind}")
        entry = {"name": name, "kind": FILE_KINDS[kind], "flags": flags, "build_id": take(n), "path": text(), "binary": None, "folder": None}
        if entry["kind"] == "debug_symbol":
            entry["binary"] = struct.unpack("<Q", take(8))[0]
        elif entry["kind"] == "source_file":
            entry["folder"] = text()
        out.append(entry)
    return out


def files(tables: DataFrame) -> DataFrame:
    """recording and a row for every file in the `content` of each table; names are text."""
    importable_on_workers(tables.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for recording, data in zip(rows["recording"], rows["content"], strict=True):
                found = pd.DataFrame([(recording, e["name"], e["kind"], e["flags"], e["build_id"].hex(), e["path"], e["binary"], e["folder"]) for e in decode_files(bytes(data))],
                                     columns=["recording", "number", "kind", "flags", "build_id", "path", "of", "folder"])
                yield found.astype({"of": "Int64"})

    rows = tables.select("recording", "content").mapInPandas(run, "recording long, number decimal(20,0), kind string, flags int, build_id string, path string, of decimal(20,0), folder string")
    return rows.select("recording", base40_name(F.col("number")).alias("name"), "kind", "flags", "build_id", "path", base40_name(F.col("of")).alias("binary"), "folder")
