"""Event streams as rows of chunks: written and read by executors, a task for some chunks, whatever the length of a trace.

A chunk holds up to EVENTS_A_CHUNK consecutive events, binary or as a CBOR sequence, in one zstd frame. The first frame of a stream follows
its header in a file; here each is a row (chunk_id, first_geid, event_count, codec, body), which Parquet keeps, prunes and splits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import importable_on_workers
from strandline.operators import positions
from strandline.schema import EVENT_KINDS, EVENTS_A_CHUNK
from strandline.sources import cbor, split_binary

LEVEL = 3
CODECS = ("split-binary", "cbor")
#: How files of each format begin.
MAGIC = bytes.fromhex("C0DE72ACE2")
BEGINNINGS = {"binary-v0": MAGIC + bytes(3), "cbor-zstd": MAGIC + bytes([1, 0, 0])}
CONTAINER_VERSIONS = (2, 3, 4)
FIELDS = "kind string, path_id long, line long, function_id long, variable_id long, log_kind int, metadata string, content string, payload string"
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def detected(content: Column) -> Column:
    """The format of a file by its first bytes: json, binary-v0, cbor-zstd, container; null for others."""
    begins = lambda raw: F.substring(content, 1, len(raw)) == F.lit(raw)
    version = F.conv(F.hex(F.substring(content, 6, 1)), 16, 10).cast("int")
    out = F.when(F.substring(content, 1, 64).cast("string").rlike(r"^\s*\["), "json")
    for name, raw in BEGINNINGS.items():
        out = out.when(begins(raw), name)
    return out.when(begins(MAGIC) & version.isin(*CONTAINER_VERSIONS), "container")


def _fields(row: dict) -> dict:
    """A row's event with the fields of its kind, whole numbers as such."""
    out = {"kind": row["kind"]}
    for name, form in split_binary.LAYOUT[row["kind"]]:
        value = row[name]
        out[name] = int(value) if len(form) == 1 else value
    return out


def _to_cbor(event: dict) -> bytes:
    kind, fields = event["kind"], {k: v for k, v in event.items() if k != "kind"}
    return cbor.dumps({kind: {k: json.loads(v) if k == "payload" else v for k, v in fields.items()}})


def _from_cbor(item: dict) -> dict:
    (kind, fields), = item.items()
    return {"kind": kind} | {k: json.dumps(v, separators=(",", ":")) if k == "payload" else v for k, v in fields.items()}


def encode(events: DataFrame, codec: str = "split-binary", size: int = EVENTS_A_CHUNK) -> DataFrame:
    """Chunks of `size` events of (geid and FIELDS) rows, in the order of geid."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec}")
    importable_on_workers(events.sparkSession)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("geid")
        one = split_binary.encode if codec == "split-binary" else _to_cbor
        body = b"".join(one(_fields(row)) for row in rows.to_dict("records"))
        return pd.DataFrame({"chunk_id": rows["chunk_id"].iloc[:1], "first_geid": rows["geid"].iloc[:1], "event_count": [len(rows)], "codec": [codec],
                             "body": [zstandard.compress(body, LEVEL)], "geids": [rows["geid"].tolist()]})

    placed = positions.ordinals(events.select("geid", *_NAMES), "i").withColumn("chunk_id", F.floor(F.col("i") / size)).drop("i")
    return placed.groupBy("chunk_id").applyInPandas(pack, "chunk_id long, first_geid long, event_count long, codec string, body binary, geids array<long>")


def decode(chunks: DataFrame, first: int | None = None, count: int | None = None) -> DataFrame:
    """Events of chunk rows; with `first` and `count` only chunks that can hold such geids are decompressed. A cut-off chunk raises."""
    importable_on_workers(chunks.sparkSession)
    held = chunks
    if first is not None:
        held = held.where((F.element_at("geids", -1) >= first) & (F.col("first_geid") < first + count))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for geids, n, codec, body in zip(rows["geids"], rows["event_count"], rows["codec"], rows["body"], strict=True):
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(bytes(body))
                found = split_binary.decode_all(raw, permissive=False) if codec == "split-binary" else list(map(_from_cbor, cbor.sequence(raw)))
                if len(found) != n:
                    raise ValueError(f"a chunk of {n} events holds {len(found)}")
                frame = pd.DataFrame([[g, *(e.get(c) for c in _NAMES)] for g, e in zip(geids, found, strict=True)], columns=["geid", *_NAMES])
                yield frame.astype({c: "Int64" for c in ("geid", "path_id", "line", "function_id", "variable_id")} | {"log_kind": "Int32"})

    out = held.mapInPandas(unpack, f"geid long, {FIELDS}")
    return out if first is None else out.where((F.col("geid") >= first) & (F.col("geid") < first + count))


def known_kinds() -> tuple[str, ...]:
    return tuple(k for k in EVENT_KINDS if all(name in _NAMES for name, _ in split_binary.LAYOUT[k]))
