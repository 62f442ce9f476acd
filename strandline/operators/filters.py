"""Trace filters: rules from TOML, compiled once on the driver to column expressions over distinct scopes.

Of the scope rules the last one that matches decides, attribute by attribute, and its value patterns replace earlier ones; of
value patterns of one kind the first that matches decides. A default of drop prunes patterns of older sources.
"""

from __future__ import annotations

import hashlib
import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import glob_to_regex, module_name

#: A dotted module name.
MODULE = r"^[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*\z"
SCOPE_KINDS, VALUE_KINDS = ("pkg", "file", "obj"), ("local", "global", "arg", "ret", "attr")
MATCH_TYPES = ("glob", "regex", "literal")
EXEC, ACTIONS = ("trace", "skip"), ("allow", "redact", "drop", "deny")


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Selector:
    kind: str
    how: str
    pattern: str

    @classmethod
    def parse(cls, raw: str, permitted: tuple[str, ...]) -> Selector:
        if not raw.strip():
            raise FilterError("empty selector")
        kind, colon, rest = raw.partition(":")
        if not colon:
            raise FilterError(f"{raw!r} has no pattern")
        if kind not in SCOPE_KINDS + VALUE_KINDS:
            raise FilterError(f"unknown selector kind {kind!r}")
        if kind not in permitted:
            raise FilterError(f"{kind!r} is not allowed here")
        how, colon, pattern = rest.partition(":")
        if not colon:
            how, pattern = "glob", rest
        elif how not in MATCH_TYPES:
            raise FilterError(f"unknown match type {how!r}")
        if not pattern:
            raise FilterError(f"{raw!r} has an empty pattern")
        if how == "regex":
            try:
                re.compile(pattern)
            except re.error as e:
                raise FilterError(f"{raw!r}: {e}") from e
        return cls(kind, how, pattern)

    def matches(self, c: Column) -> Column:
        if self.how == "literal":
            found = c == self.pattern
        elif self.how == "glob":
            found = c.rlike(glob_to_regex(self.pattern))
        else:
            found = c.rlike("(?Ud)" + re.sub(r"(?<!\\)\$$", r"\\z", self.pattern))
        return F.coalesce(found, F.lit(False))


@dataclass(frozen=True)
class Pattern:
    selector: Selector
    action: str
    source: int


@dataclass(frozen=True)
class Rule:
    selector: Selector
    exec: str | None
    value_default: str | None
    patterns: tuple[Pattern, ...]
    source: int


@dataclass
class Filter:
    """Filter files in order; later rules come after earlier ones."""

    default_exec: str | None = None
    default_value: str | None = None
    default_source: int = 0
    rules: list[Rule] = field(default_factory=list)
    sources: list[dict] = field(default_factory=list)

    @classmethod
    def from_texts(cls, *texts: str) -> Filter:
        out = cls()
        for text in texts:
            out._ingest(text)
        if out.default_exec is None or out.default_value is None:
            raise FilterError("no source sets the defaults")
        return out

    def _ingest(self, text: str) -> None:
        try:
            doc = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise FilterError(str(e)) from e
        _only(doc, "meta", "scope", "io")
        meta, scope, io = doc.get("meta", {}), doc.get("scope", {}), doc.get("io", {})
        _only(meta, "name", "version", "description", "labels")
        _only(scope, "default_exec", "default_value_action", "rules")
        _only(io, "capture", "streams", "modes")
        if meta.get("version") != 1:
            raise FilterError(f"schema version {meta.get('version')} is not supported")
        if not str(meta.get("name", "")).strip():
            raise FilterError("a filter needs a name")
        if io.get("capture") and not io.get("streams"):
            raise FilterError("capture needs streams")
        if io.get("modes"):
            raise FilterError("modes are reserved")
        source = len(self.sources)
        self.sources.append({"name": meta["name"], "version": 1, "sha256": hashlib.sha256(text.encode()).hexdigest()})
        for key, name, allowed in (("default_exec", "default_exec", EXEC), ("default_value_action", "default_value", ACTIONS)):
            if (value := scope.get(key, "inherit")) == "inherit":
                if source == 0 and key in scope:
                    raise FilterError(f"{key} has nothing to inherit")
                continue
            setattr(self, name, _action(value, allowed))
            if name == "default_value":
                self.default_source = source
        for raw in scope.get("rules", []):
            _only(raw, "selector", "exec", "value_default", "value_patterns", "reason")
            patterns = []
            for p in raw.get("value_patterns", []):
                _only(p, "selector", "action", "reason")
                patterns.append(Pattern(Selector.parse(p["selector"], VALUE_KINDS), _action(p["action"], ACTIONS), source))
            given = lambda key, allowed: None if raw.get(key, "inherit") == "inherit" else _action(raw[key], allowed)  # noqa: B023, E731
            self.rules.append(Rule(Selector.parse(raw["selector"], SCOPE_KINDS), given("exec", EXEC), given("value_default", ACTIONS), tuple(patterns), source))

    def summary(self) -> list[dict]:
        return self.sources

    def classify(self, scopes: DataFrame, module: str = "module", file: str = "file", obj: str = "object") -> DataFrame:
        """`scopes` with exec, value_default, its source, the last matching rule and the rule whose patterns hold."""
        by_kind = {"pkg": F.col(module), "file": F.col(file), "obj": F.col(obj)}

        def last(values: list[tuple[Rule, Column]], otherwise: Column) -> Column:
            """The value of the last rule that matches: the first hit of the reversed list."""
            return F.coalesce(*(F.when(r.selector.matches(by_kind[r.selector.kind]), v) for r, v in reversed(values)), otherwise)

        numbered = list(enumerate(self.rules))
        return scopes.select(
            "*",
            last([(r, F.lit(r.exec)) for r in self.rules if r.exec], F.lit(self.default_exec)).alias("exec"),
            last([(r, F.lit(r.value_default)) for r in self.rules if r.value_default], F.lit(self.default_value)).alias("value_default"),
            last([(r, F.lit(r.source)) for r in self.rules if r.value_default], F.lit(self.default_source)).alias("default_source"),
            last([(r, F.lit(i)) for i, r in numbered], F.lit(-1)).alias("matched_rule"),
        )

    def decide(self, classified: DataFrame, kind: str, name: Column) -> DataFrame:
        """`classified` with the action for a value of this kind and name."""
        action = F.col("value_default")
        for i, rule in enumerate(self.rules):
            chain = F.col("value_default")
            for p in reversed([p for p in rule.patterns if p.selector.kind == kind]):
                pruned = (F.col("value_default") == "drop") & (F.lit(p.source) < F.col("default_source"))
                chain = F.when(~pruned & p.selector.matches(name), p.action).otherwise(chain)
            action = F.when(F.col("matched_rule") == i, chain).otherwise(action)
        return classified.withColumn("action", action)


def _only(doc: dict, *keys: str) -> None:
    if unknown := set(doc) - set(keys):
        raise FilterError(f"unknown fields: {sorted(unknown)}")


def _action(value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise FilterError(f"{value!r} is none of {allowed}")
    return "redact" if value == "deny" else value


def with_root(files: DataFrame, path: str, roots: list[str]) -> DataFrame:
    """`files` with the deepest of a few roots that holds each file (ties: the earlier) and the path relative to it."""
    order = sorted(range(len(roots)), key=lambda i: (-len(roots[i]), i))
    root = F.coalesce(*(F.when(F.col(path).startswith(roots[i].rstrip("/") + "/"), F.lit(roots[i])) for i in order))
    return files.withColumn("root", root).withColumn("relative", F.expr(f"substring({path}, length(root) + 2)"))


def with_table_root(files: DataFrame, path: str, roots: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """As `with_root` for any number of roots, (root, source) rows: each file's folders meet the roots by equality.

    Of equally deep roots, which are the same folder, the earliest source counts. `keys` name a file.
    """
    parts = F.split(F.col(path), "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    known = roots.select(F.regexp_replace("root", "/+$", "").alias("__folder"), "root", "source").groupBy("__folder").agg(F.min(F.struct("source", "root")).alias("__r"))
    above = files.select(*keys, F.explode(folders).alias("__folder")).join(known, "__folder")
    deepest = above.groupBy(*keys).agg(F.max_by("__r", F.length("__folder")).alias("__r"))
    found = files.join(deepest, list(keys), "left").select("*", F.col("__r.root").alias("root"), F.col("__r.source").alias("source")).drop("__r")
    return found.withColumn("relative", F.expr(f"substring({path}, length(regexp_replace(root, '/+$', '')) + 2)"))


def with_hint(scopes: DataFrame, hint: str, name: str) -> DataFrame:
    """`scopes` with their module replaced by a valid dotted hint, and `object` (module and qualified name, as far as known) anew."""
    module = F.when(F.col(hint).rlike(MODULE), F.col(hint)).otherwise(F.col("module"))
    return scopes.withColumn("module", module).withColumn("object", F.nullif(F.concat_ws(".", "module", name), F.lit("")))


def demo_scopes(trace: DataFrame) -> DataFrame:
    """The distinct (path, function) scopes of a trace with names for rules to match."""
    scopes = trace.select("path_id", "function_id").distinct()
    file = F.concat(F.lit("app/m"), F.col("path_id").cast("string"), F.lit(".py"))
    named = scopes.withColumn("file", file).withColumn("module", module_name(F.col("file")))
    return named.withColumn("object", F.concat("module", F.lit(".f"), F.col("function_id").cast("string")))


DEMO = Filter.from_texts(
    """
[meta]
name = "demo"
version = 1
[scope]
default_exec = "skip"
default_value_action = "redact"
[[scope.rules]]
selector = "pkg:glob:app.m*"
exec = "trace"
value_default = "allow"
[[scope.rules.value_patterns]]
selector = "local:glob:v[1-4]"
action = "deny"
[[scope.rules.value_patterns]]
selector = "local:regex:^v"
action = "drop"
[[scope.rules]]
selector = "file:literal:app/m2.py"
exec = "skip"
[[scope.rules]]
selector = "obj:regex:f[78]$"
value_default = "drop"
"""
)


#: A second source on top of the first: its default prunes the older patterns where it drops.
INLINE = """
[meta]
name = "inline"
version = 1
[scope]
default_exec = "trace"
default_value_action = "allow"
[[scope.rules]]
selector = "pkg:glob:app.*"
value_default = "redact"
[[scope.rules.value_patterns]]
selector = "local:literal:v3"
action = "allow"
[[scope.rules.value_patterns]]
selector = "arg:glob:v?"
action = "allow"
"""
PROJECT = """
[meta]
name = "project"
version = 1
[scope]
default_exec = "inherit"
default_value_action = "inherit"
[[scope.rules]]
selector = "file:glob:app/m[0-2].py"
value_default = "drop"
[[scope.rules.value_patterns]]
selector = "local:regex:[1-3]$"
action = "allow"
[[scope.rules]]
selector = "obj:glob:app.m1.f*"
exec = "skip"
"""
CHAINED = Filter.from_texts(INLINE, PROJECT)
