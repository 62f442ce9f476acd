"""Binary events: a tag byte and the fields that the tag's layout lists."""

from __future__ import annotations

import json
import struct

from strandline.schema import EVENT_KINDS
from strandline.sources import cbor

#: The fields of each event kind in stored order. Numbers are little-endian; text, CBOR and lists have a 32-bit length.
LAYOUT = {
    "Step": (("path_id", "Q"), ("line", "q")),
    "Path": (("text", "text"),),
    "VariableName": (("text", "text"),),
    "Variable": (("text", "text"),),
    "Type": (("payload", "cbor"),),
    "Value": (("variable_id", "Q"), ("payload", "cbor")),
    "Function": (("path_id", "Q"), ("line", "q"), ("text", "text")),
    "Call": (("function_id", "Q"), ("payload", "cbor")),
    "Return": (("payload", "cbor"),),
    "Event": (("log_kind", "B"), ("metadata", "text"), ("content", "text")),
    "Asm": (("asm", "texts"),),
    "BindVariable": (("variable_id", "Q"), ("place", "q")),
    "Assignment": (("payload", "cbor"),),
    "DropVariables": (("variable_ids", "numbers"),),
    "CompoundValue": (("place", "q"), ("payload", "cbor")),
    "CellValue": (("place", "q"), ("payload", "cbor")),
    "AssignCompoundItem": (("place", "q"), ("index", "Q"), ("item_place", "q")),
    "AssignCell": (("place", "q"), ("payload", "cbor")),
    "VariableCell": (("variable_id", "Q"), ("place", "q")),
    "DropVariable": (("variable_id", "Q"),),
    "ThreadStart": (("thread_id", "Q"),),
    "ThreadExit": (("thread_id", "Q"),),
    "ThreadSwitch": (("thread_id", "Q"),),
    "DropLastStep": (),
}


def encode(event: dict) -> bytes:
    """One event: its `kind` and that kind's fields; payloads are JSON text."""
    out = [bytes([EVENT_KINDS.index(event["kind"])])]
    sized = lambda raw, n=None: struct.pack("<I", len(raw) if n is None else n) + raw
    for name, form in LAYOUT[event["kind"]]:
        value = event[name]
        if form == "text":
            out.append(sized(value.encode()))
        elif form == "cbor":
            out.append(sized(cbor.dumps(json.loads(value))))
        elif form == "texts":
            out.append(sized(b"".join(sized(x.encode()) for x in value), len(value)))
        elif form == "numbers":
            out.append(sized(struct.pack(f"<{len(value)}Q", *value), len(value)))
        else:
            out.append(struct.pack("<" + form, value))
    return b"".join(out)


def decode(data: bytes, at: int = 0) -> tuple[dict, int]:
    """(event, next position); a bad or cut-off one raises ValueError."""
    try:
        kind = EVENT_KINDS[data[at]]
        event, at = {"tag": data[at], "kind": kind}, at + 1
        for name, form in LAYOUT[kind]:
            if len(form) == 1:
                event[name] = struct.unpack_from("<" + form, data, at)[0]
                at += struct.calcsize("<" + form)
                continue
            n = struct.unpack_from("<I", data, at)[0]
            at += 4
            if form == "numbers":
                event[name] = list(struct.unpack_from(f"<{n}Q", data, at))
                at += 8 * n
            elif form == "texts":
                event[name] = []
                for _ in range(n):
                    size = struct.unpack_from("<I", data, at)[0]
                    event[name].append(_piece(data, at + 4, size).decode())
                    at += 4 + size
            else:
                raw = _piece(data, at, n)
                event[name] = raw.decode() if form == "text" else json.dumps(cbor.loads(raw), separators=(",", ":"))
                at += n
    except (IndexError, struct.error) as e:
        raise ValueError(f"bad event at byte {at}: {e}") from e
    return event, at


def _piece(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise ValueError("truncated event")
    return data[at : at + n]


def decode_all(data: bytes, permissive: bool = True) -> list[dict]:
    """Events up to the end, or up to the first bad one if permissive."""
    out, at = [], 0
    while at < len(data):
        try:
            event, at = decode(data, at)
        except ValueError:
            if permissive:
                break
            raise
        out.append(event)
    return out
