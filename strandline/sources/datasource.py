"""Traces as a Spark data source: `spark.read.format("strandline").load(folder)`.

Planning reads headers only: of a container its member table and the sixteen bytes before each chunk, so that a task gets some chunks of
one file and opens nothing else. Files must be where executors can open them; for stores that only Spark's readers reach, use
`container.events`. Options: `first` and `count` (geids), `chunks` (chunks a task).
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandline import importable_on_workers
from strandline.schema import EVENT_SCHEMA
from strandline.sources import cbor, chunked, container, split_binary

_COLUMNS = [c.strip().split()[0].strip("`") for c in EVENT_SCHEMA.replace("array<", "array").split(",")]


class _File:
    """A file's bytes by slices, so that a container reads only the blocks that it needs."""

    def __init__(self, path: str):
        self.held, self.size = open(path, "rb"), os.path.getsize(path)  # noqa: SIM115

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at) -> bytes | int:
        start, stop, _ = at.indices(self.size) if isinstance(at, slice) else (at, at + 1, 1)
        self.held.seek(start)
        data = self.held.read(max(0, stop - start))
        return data if isinstance(at, slice) else data[0]


def open_container(path: str) -> container.Container:
    file = _File(path)
    head = file[0:4096]
    entries = struct.unpack_from("<I", head, 12)[0] if len(head) >= 16 else 0
    out = container.Container(head if len(head) >= 16 + 24 * entries else file[0 : 16 + 24 * entries])
    out.data = file
    return out


@dataclass
class Chunks(InputPartition):
    """Chunks of one file: (offset in the event stream, size, first geid); no chunks stand for a whole stream of another format."""

    path: str
    form: str
    chunks: tuple[tuple[int, int, int], ...] = ()

    def __post_init__(self):
        super().__init__(None)


class TraceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted(_listed(options["path"]))
        self.first = int(options["first"]) if "first" in options else None
        self.last = self.first + int(options.get("count", 1)) if self.first is not None else None
        self.a_task = int(options.get("chunks", 16))

    def partitions(self) -> Sequence[InputPartition]:
        return [p for path in self.paths for p in self._plan(path)]

    def _plan(self, path: str) -> Iterator[Chunks]:
        with open(path, "rb") as file:
            head = file.read(64)
        if head[:8] == chunked.BEGINNINGS["cbor-zstd"]:
            yield Chunks(path, "cbor-zstd")
            return
        if head[:5] != container.MAGIC or head[5] not in container.VERSIONS:
            raise ValueError(f"{path}: not a trace that can be read")
        held = open_container(path)
        if held.codec() != "split-binary":
            yield Chunks(path, "cbor")
            return
        size, at, some = held.members["events.log"][0], 8, []
        while at < size:
            header = held.read_at("events.log", at, 16)
            n, count, geid = struct.unpack("<IIQ", header) if len(header) == 16 else (size, 0, 0)
            if at + 16 + n > size:
                raise ValueError(f"{path}: the chunk at byte {at} is cut off")
            if self.first is None or (geid < self.last and geid + count > self.first):
                some.append((at + 16, n, geid))
            at += 16 + n
        for i in range(0, len(some), self.a_task):
            yield Chunks(path, "split-binary", tuple(some[i : i + self.a_task]))

    def read(self, partition: Chunks) -> Iterator[tuple]:
        for geid, event in self._events(partition):
            if self.first is None or self.first <= geid < self.last:
                yield (geid, *(event.get(c) for c in _COLUMNS[1:]))

    def _events(self, p: Chunks) -> Iterator[tuple[int, dict]]:
        if p.form == "split-binary":
            held = open_container(p.path)
            for at, size, geid in p.chunks:
                raw = container.frames(held.read_at("events.log", at, size))
                yield from enumerate(split_binary.decode_all(raw, permissive=False), geid)
            return
        if p.form == "cbor":
            stream = open_container(p.path).read("events.log")
        else:
            with open(p.path, "rb") as file:
                stream = file.read()
        yield from enumerate(container.from_cbor(cbor.sequence(container.frames(stream[8:]))))


def _listed(path: str) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(path):
        return [os.path.join(path, name) for name in os.listdir(path) if not name.startswith((".", "_"))]
    return [path]


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandline"

    def schema(self) -> str:
        return EVENT_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TraceReader(self.options)


def register(spark: SparkSession) -> None:
    importable_on_workers(spark)
    spark.dataSource.register(TraceSource)
