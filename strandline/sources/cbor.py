"""The part of CBOR that trace payloads use: numbers, text, bytes, arrays, maps, booleans, null, floats and tags."""

from __future__ import annotations

import struct


def dumps(value) -> bytes:
    if value is None or isinstance(value, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[value]
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, bytes):
        return _head(2, len(value)) + value
    if isinstance(value, str):
        raw = value.encode()
        return _head(3, len(raw)) + raw
    if isinstance(value, dict):
        return _head(5, len(value)) + b"".join(dumps(k) + dumps(v) for k, v in value.items())
    return _head(4, len(value)) + b"".join(map(dumps, value))


def _head(major: int, n: int) -> bytes:
    for limit, code, form in ((24, None, None), (1 << 8, 24, ">B"), (1 << 16, 25, ">H"), (1 << 32, 26, ">I"), (1 << 64, 27, ">Q")):
        if n < limit:
            return bytes([major << 5 | n]) if code is None else bytes([major << 5 | code]) + struct.pack(form, n)
    raise ValueError("number needs more than 64 bits")


def loads(data: bytes):
    value, end = _item(data, 0)
    if end != len(data):
        raise ValueError("bytes after the value")
    return value


def sequence(data: bytes) -> list:
    """All values of a CBOR sequence; a cut-off last one raises."""
    out, at = [], 0
    while at < len(data):
        value, at = _item(data, at)
        out.append(value)
    return out


def _take(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise ValueError("truncated value")
    return data[at : at + n]


def _item(data: bytes, at: int):
    first = _take(data, at, 1)[0]
    major, info, at = first >> 5, first & 31, at + 1
    if major == 7:
        if info in (20, 21, 22, 23):
            return (False, True, None, None)[info - 20], at
        size, form = {25: (2, ">e"), 26: (4, ">f"), 27: (8, ">d")}[info]
        return struct.unpack(form, _take(data, at, size))[0], at + size
    if info == 31:
        raise ValueError("values of open length are not used in traces")
    if info < 24:
        n = info
    else:
        size, form = {24: (1, ">B"), 25: (2, ">H"), 26: (4, ">I"), 27: (8, ">Q")}[info]
        n, at = struct.unpack(form, _take(data, at, size))[0], at + size
    if major in (0, 1):
        return (n if major == 0 else -1 - n), at
    if major in (2, 3):
        raw = _take(data, at, n)
        return (raw if major == 2 else raw.decode()), at + n
    if major == 6:  # a tag: the tagged value stands for itself
        return _item(data, at)
    out = []
    for _ in range(n * (1 + (major == 5))):
        value, at = _item(data, at)
        out.append(value)
    return (out if major == 4 else dict(zip(out[::2], out[1::2], strict=True))), at
