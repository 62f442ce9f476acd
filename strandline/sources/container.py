"""Reading trace containers: a block file system in one file, and event streams in its members."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import importable_on_workers
from strandline.functions.scalars import base40_decode
from strandline.schema import EVENT_KINDS, EVENT_SCHEMA
from strandline.sources import cbor, split_binary

MAGIC = bytes.fromhex("C0DE72ACE2")  # fixed value, as are versions and block sizes
VERSIONS, BLOCK_SIZES = (2, 3, 4), (1024, 2048, 4096)
STREAM_HEADER = MAGIC + bytes([1, 0, 0])


def chunk_headers(stream: bytes, whole: bool = True) -> list[tuple[int, int, int, int]]:
    """(first geid, events, start of the body, its size); a cut-off last chunk raises, or is left out unless `whole`."""
    out, at = [], 0
    while at < len(stream):
        size, count, geid = struct.unpack_from("<IIQ", stream, at) if at + 16 <= len(stream) else (0, 0, 0)
        if at + 16 + size > len(stream):
            if whole:
                raise ValueError(f"the chunk at byte {at} is cut off")
            break
        out.append((geid, count, at + 16, size))
        at += 16 + size
    return out


class Container:
    """Members of a container's bytes."""

    def __init__(self, data: bytes):
        if data[:5] != MAGIC or len(data) < 16:
            raise ValueError("not a trace container")
        if data[5] not in VERSIONS:
            raise ValueError(f"container version {data[5]} is not supported")
        self.data, self.version, self.compression, self.encryption = data, data[5], data[6], data[7]
        self.block, entries = struct.unpack_from("<II", data, 8)
        if self.block not in BLOCK_SIZES:
            raise ValueError(f"block size {self.block}")
        self.members: dict[str, tuple[int, int]] = {}
        for i in range(entries):
            size, root, name = struct.unpack_from("<QQQ", data, 16 + 24 * i)
            if name:
                self.members[base40_decode(name)] = (size, root)

    def _pointer(self, block: int, i: int) -> int:
        at = block * self.block + 8 * i
        found = struct.unpack("<Q", self.data[at : at + 8])[0]
        if not found:
            raise ValueError(f"null pointer {i} in block {block}")
        return found

    def place(self, root: int, index: int) -> int:
        """Physical block of a member's data block: levels hold u, u^2, u^3... blocks, each reached from the last slot of the one below."""
        u = self.block // 8 - 1
        level = 1
        while index >= u**level:
            index, root, level = index - u**level, self._pointer(root, u), level + 1
            if level > 5:
                raise ValueError("a member has at most five levels")
        for k in range(level - 1, -1, -1):
            step, index = divmod(index, u**k)
            root = self._pointer(root, step)
        return root

    def codec(self) -> str:
        """What events are stored as; containers that do not say so hold CBOR."""
        stated = self.read("events.fmt").decode("utf-8", "replace").strip() if "events.fmt" in self.members else ""
        return "split-binary" if stated == "split-binary" else "cbor"

    def read_at(self, name: str, offset: int, size: int) -> bytes:
        """Part of a member: only the blocks that it touches are read; less than `size` at the end, nothing beyond."""
        whole, root = self.members[name]
        end = min(whole, offset + size)
        if offset >= end:
            return b""
        first = offset // self.block
        parts = [self.data[at : at + self.block] for at in (self.place(root, i) * self.block for i in range(first, (end - 1) // self.block + 1))]
        return b"".join(parts)[offset - first * self.block : end - first * self.block]

    def read(self, name: str) -> bytes:
        size, root = self.members[name]
        blocks = (self.place(root, i) * self.block for i in range(-(-size // self.block)))
        return b"".join(self.data[at : at + self.block] for at in blocks)[:size]


def files(spark: SparkSession, path: str) -> DataFrame:
    """Every member of the containers at `path`, with what the container's header says."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for p, data in zip(rows["path"], rows["content"], strict=True):
                c = Container(bytes(data))
                rows_ = [(p, n, s, r, c.block, c.version, c.compression, c.encryption) for n, (s, r) in c.members.items()]
                yield pd.DataFrame(rows_, columns=["path", "name", "size", "map_block", "block_size", "version", "compression", "encryption"])

    importable_on_workers(spark)
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.mapInPandas(run, "path string, name string, size long, map_block long, block_size int, version int, compression int, encryption int")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """path, codec, first_geid, event_count, compressed_size and body of every chunk: the seek index with its data.

    A container of CBOR events has one chunk, its frames one after another, whose number of events is not known.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for p, data in zip(rows["path"], rows["content"], strict=True):
                held = Container(bytes(data))
                stream, codec = held.read("events.log"), held.codec()
                if stream[:8] != STREAM_HEADER:
                    raise ValueError(f"{p}: unknown event stream")
                stream = stream[8:]
                found = chunk_headers(stream) if codec == "split-binary" else [(0, None, 0, len(stream))]
                yield pd.DataFrame([(p, codec, g, n, s, stream[at : at + s]) for g, n, at, s in found],
                                   columns=["path", "codec", "first_geid", "event_count", "compressed_size", "body"]).astype({"event_count": "Int64"})

    importable_on_workers(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(
        run, "path string, codec string, first_geid long, event_count long, compressed_size long, body binary"
    )


def frames(data: bytes) -> bytes:
    """The content of zstd frames that follow each other."""
    return zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()


def from_cbor(items: list) -> Iterator[dict]:
    """Events of a CBOR sequence: a map from the kind to its fields, its only field or text, or the kind alone."""
    for item in items:
        (kind, value), = item.items() if isinstance(item, dict) else ((item, {}),)
        names = [name for name, _ in split_binary.LAYOUT[kind]]
        fields = value if isinstance(value, dict) and set(value) <= set(names) else {names[0]: value}
        yield {"tag": EVENT_KINDS.index(kind), "kind": kind} | {k: json.dumps(v, separators=(",", ":")) if k == "payload" else v for k, v in fields.items()}


def events(spark: SparkSession, path: str, first: int | None = None, count: int | None = None) -> DataFrame:
    """Decoded events of either codec, one task a group of chunks; with `first` and `count` only chunks that can hold such geids
    are decompressed."""
    held = chunks(spark, path)
    if first is not None:
        last = F.col("first_geid") + F.col("event_count")
        held = held.where((last.isNull() | (last > first)) & (F.col("first_geid") < first + count))
    names = [c.strip().split()[0].strip("`") for c in EVENT_SCHEMA.replace("array<", "array").split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for codec, geid, body in zip(rows["codec"], rows["first_geid"], rows["body"], strict=True):
                raw = frames(bytes(body))
                found = split_binary.decode_all(raw) if codec == "split-binary" else from_cbor(cbor.sequence(raw))
                frame = pd.DataFrame([[geid + i, *(e.get(n) for n in names[1:])] for i, e in enumerate(found)], columns=names)
                yield frame.astype({n: "Int64" for n in names if n in _WHOLE})

    out = held.repartition(F.col("path"), F.col("first_geid")).mapInPandas(run, EVENT_SCHEMA)
    return out if first is None else out.where((F.col("geid") >= first) & (F.col("geid") < first + count))


_WHOLE = {"geid", "tag", "thread_id", "path_id", "line", "function_id", "variable_id", "place", "item_place", "index", "log_kind", "type_kind"}
