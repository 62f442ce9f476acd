"""Constants, enumerations and explicit schemas of a trace."""

from __future__ import annotations

# Event kinds in the order of their tags, 0 to 23.
EVENT_KINDS = (
    "Step", "Path", "VariableName", "Variable", "Type", "Value", "Function", "Call", "Return", "Event", "Asm", "BindVariable",
    "Assignment", "DropVariables", "CompoundValue", "CellValue", "AssignCompoundItem", "AssignCell", "VariableCell", "DropVariable",
    "ThreadStart", "ThreadExit", "ThreadSwitch", "DropLastStep",
)
# Type kinds, 0 to 33.
TYPE_KINDS = (
    "Seq", "Set", "HashSet", "OrderedSet", "Array", "Varargs", "Struct", "Int", "Float", "String", "CString", "Char", "Bool",
    "Literal", "Ref", "Recursion", "Raw", "Enum", "Enum16", "Enum32", "C", "TableKind", "Union", "Pointer", "Error", "FunctionKind",
    "TypeValue", "Tuple", "Variant", "Html", "None", "NonExpanded", "Any", "Slice",
)
# Kinds of logged events, 0 to 13.
LOG_KINDS = (
    "Write", "WriteFile", "WriteOther", "Read", "ReadFile", "ReadOther", "ReadDir", "OpenDir", "CloseDir", "Socket", "Open", "Error",
    "TraceLogEvent", "EvmEvent",
)
NO_KEY, NONE_TYPE_ID, TOP_LEVEL_FUNCTION_ID = -1, 0, 0
EVENTS_A_CHUNK = 4096

EVENT_SCHEMA = (
    "geid long, tag int, kind string, thread_id long, path_id long, line long, function_id long, variable_id long, place long, "
    "item_place long, `index` long, log_kind int, metadata string, content string, text string, type_kind int, asm array<string>, "
    "pass_by string, rvalue_kind string, from_ids array<long>, variable_ids array<long>, payload string"
)

OBJECT = "struct<object_id: string, uri: string, size_bytes: bigint, sha256: string, placement: struct<pool: string, server_id: string>, upload: string, data_state: string>"
MANIFEST_SCHEMA = f"""
schema string, recording_id string,
source struct<kind: string, file: {OBJECT}, segments: array<struct<`index`: int, geid_start: bigint, geid_end: bigint, file: {OBJECT},
  shards: array<struct<shard_index: int, block_start: bigint, block_end: bigint, replicas: array<{OBJECT}>>>>>,
  language: string, artifacts: array<{OBJECT}>>,
lifecycle string, retention string
"""
