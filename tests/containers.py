"""Small containers for tests, made from lists."""

import json
import struct

import zstandard

from strandline.functions.scalars import base40_encode
from strandline.schema import EVENTS_A_CHUNK
from strandline.sources import cbor, split_binary
from strandline.sources.container import MAGIC, STREAM_HEADER

LEVEL = 3


def pack_chunks(events: list[dict], first_geid: int = 0, size: int = EVENTS_A_CHUNK) -> bytes:
    """Chunks of `size` events, each behind (compressed size, events, first geid)."""
    out = []
    for i in range(0, len(events), size):
        some = events[i : i + size]
        body = zstandard.compress(b"".join(map(split_binary.encode, some)), LEVEL)
        out.append(struct.pack("<IIQ", len(body), len(some), first_geid + i) + body)
    return b"".join(out)


def build(members: dict[str, bytes], block: int = 4096, slots: int = 31) -> bytes:
    """A container's bytes."""
    if len(members) > slots:
        raise ValueError(f"a container has at most {slots} members")
    u, blocks = block // 8 - 1, [bytearray(block)]

    def new(data: bytes = b"") -> int:
        blocks.append(bytearray(data.ljust(block, b"\0")))
        return len(blocks) - 1

    def put(at: int, slot: int, value: int) -> None:
        struct.pack_into("<Q", blocks[at], 8 * slot, value)

    def tree(level: int, left: list[int]) -> int:
        """A mapping block of this level over as many of the data blocks as fit; they are taken from the list."""
        at = new()
        for slot in range(u):
            if left:
                put(at, slot, left.pop(0) if level == 1 else tree(level - 1, left))
        return at

    root_block = blocks[0]
    root_block[:16] = MAGIC + bytes([3, 1, 0]) + struct.pack("<II", block, slots)
    for i, (name, data) in enumerate(members.items()):
        left = [new(data[x : x + block]) for x in range(0, len(data), block)]
        first = at = tree(1, left)
        level = 1
        while left:
            level += 1
            upper = tree(level, left)
            put(at, u, upper)
            at = upper
        struct.pack_into("<QQQ", root_block, 16 + 24 * i, len(data), first, base40_encode(name))
    return b"".join(blocks)


def cbor_container(events: list[dict], stated: bool = True, a_frame: int = 5) -> bytes:
    """Events as CBOR maps in several frames; the format member may be missing."""
    one = lambda e: cbor.dumps({e["kind"]: {k: json.loads(v) if k == "payload" else v for k, v in e.items() if k != "kind"}})
    frames = [zstandard.compress(b"".join(map(one, events[i : i + a_frame])), LEVEL) for i in range(0, len(events), a_frame)]
    return build({"events.log": STREAM_HEADER + b"".join(frames)} | ({"events.fmt": b"cbor"} if stated else {}))


def cbor_file(events: list[dict]) -> bytes:
    one = lambda e: cbor.dumps({e["kind"]: {k: json.loads(v) if k == "payload" else v for k, v in e.items() if k != "kind"}})
    return STREAM_HEADER + zstandard.compress(b"".join(map(one, events)), LEVEL)


def trace_container(events: list[dict], paths: list[str] = (), meta: dict | None = None) -> bytes:
    return build({
        "events.log": STREAM_HEADER + pack_chunks(events), "events.fmt": b"split-binary", "meta.json": json.dumps(meta or {}).encode(),
        "paths.json": json.dumps(list(paths)).encode(),
    })
