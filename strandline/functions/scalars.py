"""Scalar functions as column expressions, and registration of the few that SQL lacks."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def format_size(n: Column) -> Column:
    """1.0 MB, 1.0 KB or 17 B; halves go to the even tenth."""
    tenth = lambda x: F.format_string("%.1f", F.bround(x, 1))
    return (
        F.when(n >= 1 << 20, F.concat(tenth(n / float(1 << 20)), F.lit(" MB")))
        .when(n >= 1 << 10, F.concat(tenth(n / float(1 << 10)), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def uuid7_millis(uuid: Column) -> Column:
    return F.conv(F.substring(F.regexp_replace(uuid, "-", ""), 1, 12), 16, 10).cast("long")


def posix_path(path: Column) -> Column:
    """Slashes only, without empty and "." components, ".." taking its parent along; null if a ".." leaves the root."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    step = lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def module_name(relative: Column) -> Column:
    """app/util/__init__.py is app.util; null where a part is no identifier or nothing is left."""
    parts = F.filter(F.split(F.regexp_replace(relative, r"\.py$", ""), "/"), lambda x: x != "")
    package = relative.rlike(r"(^|/)__init__\.py$")
    name = F.array_join(F.when(package, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts), ".")
    return F.when(name.rlike(r"^[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*\z"), name)


def shortened(text: Column, limit: int = 120) -> Column:
    """At most `limit` characters of a text, with a sign where something is missing."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


# What a value is to its scope, in the order of their numbers.
VALUE_KINDS = ("local", "global", "argument", "return", "attribute")


def value_kind_number(label: Column) -> Column:
    """0 to 4; null for a label that is none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, VALUE_KINDS)), label), F.lit(0)).cast("int") - 1


def language(name: Column) -> Column:
    """The languages that materialized traces come in, by any of their names; null for others."""
    low = F.lower(F.trim(name))
    return F.when(low.isin("python", "ruby"), low).when(low.isin("javascript", "js"), "javascript")


def is_uuid7(uuid: Column) -> Column:
    """Whether a text is a UUID of version 7 and the usual variant."""
    return F.lower(uuid).rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z")


def relative_path(text: Column) -> Column:
    """What follows the last /src/ of an absolute path, shown relative to the recording."""
    return F.regexp_replace(text, r"^/.*/src/", "<relative-to-this>/src/")


def http_error_class(status: Column) -> Column:
    return F.when(status < 400, "ok").when(status.isin(408, 429), "retryable").when(status < 500, "fatal").otherwise("retryable")


def content_type(kind: Column) -> Column:
    return F.when(kind.isin("json", "manifest"), "application/json").otherwise("application/octet-stream")


def glob_to_regex(pattern: str) -> str:
    """Anchored Java expression of a glob: * and ? stop at a slash, ** does not; [..] and {a,b} work."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern[i : i + 3] == "**/" and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern[i : i + 2] == "**":
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", r"\\") + "]")
            i = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


BASE40 = "\0" + "0123456789abcdefghijklmnopqrstuvwxyz./-"  # fixed value: digit 0 ends a name


def base40_encode(name: str) -> int:
    if len(name) > 12:
        raise ValueError("a name has at most 12 characters")
    n = 0
    for c in reversed(name):
        if c == "\0" or c not in BASE40:
            raise ValueError(f"not a name character: {c!r}")
        n = n * 40 + BASE40.index(c)
    return n


def base40_decode(n: int) -> str:
    out = []
    while n:
        n, d = divmod(n, 40)
        if not d:  # digit 0 ends a name
            break
        out.append(BASE40[d])
    return "".join(out)


def leb128_encode(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def leb128_decode(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, next position)."""
    n = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("truncated number")
        n |= (data[at] & 127) << shift
        if n >= 1 << 64:
            raise ValueError("number overflows 64 bits")
        at += 1
        if data[at - 1] < 128:
            return n, at
        shift += 7


#: SQL functions without Python code: name and parameters, type, body.
SQL_FUNCTIONS = (
    ("uuid7_millis(u STRING)", "BIGINT", "CAST(conv(substr(replace(u, '-', ''), 1, 12), 16, 10) AS BIGINT)"),
    ("relative_path(p STRING)", "STRING", "regexp_replace(p, '^/.*/src/', '<relative-to-this>/src/')"),
    ("shortened(t STRING)", "STRING", "CASE WHEN length(t) > 120 THEN concat(left(t, 120), '…') ELSE t END"),
    ("trace_language(n STRING)", "STRING", "CASE WHEN lower(trim(n)) IN ('python', 'ruby') THEN lower(trim(n)) WHEN lower(trim(n)) IN ('javascript', 'js') THEN 'javascript' END"),
)


def register(spark: SparkSession) -> None:
    """The functions of SQL_FUNCTIONS, for this session."""
    for name, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {kind} RETURN {body}")
