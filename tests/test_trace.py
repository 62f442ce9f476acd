"""Trace operators against sequential Python, filters against worked cases, and all queries against DuckDB."""

import json
import random

import duckdb
import pytest

from strandline.functions import scalars
from strandline.operators import brackets, filters, positions, storage
from strandline.plans import oracles, queries, source_oracles, source_queries, storage_oracles, storage_rules, value_oracles, values

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries.QUERIES | values.QUERIES | storage_rules.QUERIES | source_queries.QUERIES, oracles.ORACLES | value_oracles.ORACLES | storage_oracles.ORACLES | source_oracles.ORACLES


def stack_run(kinds):
    """Sequential stacks: (geid, thread, kind) to (depth, enclosing)."""
    stacks, out = {}, {}
    for geid, thread, kind in kinds:
        stack = stacks.setdefault(thread, [])
        if kind == "Call":
            around = stack[-1] if stack else None
            stack.append(geid)
        elif kind == "Return":
            around = stack.pop() if stack else None
        else:
            around = stack[-1] if stack else None
        out[geid] = (len(stack), around)
    return out


@pytest.mark.parametrize(("seed", "threads", "run"), [(0, 3, 1 << 16), (1, 1, 7), (2, 3, 20), (3, 1, 1), (4, 2, 100)])
def test_brackets_follow_a_stack(spark, monkeypatch, seed, threads, run):
    """Also where all is one thread and a run holds a few rows only, with gaps between geids."""
    monkeypatch.setattr(positions, "RUN", run)
    r = random.Random(seed)
    rows = [(3 * i + r.randrange(3), r.randrange(threads), r.choice(["Call", "Call", "Return", "Step"] if seed % 2 else ["Call", "Return", "Return", "Step"])) for i in range(400)]
    df = spark.createDataFrame(rows, "geid long, thread_id long, kind string")
    got = {x["geid"]: (x["depth"], x["enclosing"]) for x in brackets.enclosing_calls(df).collect()}
    assert got == stack_run(rows)


def test_no_task_reads_more_than_a_run(spark, monkeypatch):
    """One thread: every window sees the rows of a run, or a summary for each run and level."""
    monkeypatch.setattr(positions, "RUN", 50)
    from pyspark.sql import functions as F

    df = spark.range(5000).select(F.col("id").alias("geid"), F.lit(1).cast("long").alias("thread_id"), F.expr("CASE id % 4 WHEN 0 THEN 'Call' WHEN 3 THEN 'Return' ELSE 'Step' END").alias("kind"))
    plan = brackets.enclosing_calls(df)._jdf.queryExecution().executedPlan().toString()
    by_run = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert by_run and not any("hashpartitioning(thread_id#" in line and "__run" not in line and "__at" not in line.split("Arguments")[0] and "geid" in line for line in by_run)
    assert {r["depth"] for r in brackets.enclosing_calls(df).collect()} == {0, 1}


def test_values_carried_over_runs(spark, monkeypatch):
    monkeypatch.setattr(positions, "RUN", 9)
    from pyspark.sql import functions as F

    r = random.Random(4)
    rows = [(i, r.choice([None, 1, 2]), r.choice([None, None, None, 5 * i])) for i in sorted(r.sample(range(900), 250))]
    df = spark.createDataFrame(rows, "geid long, g long, v long")
    for group in ((), ("g",)):
        got = positions.latest(df, F.col("v"), "up", group=group)
        got = positions.latest(got, F.col("v"), "before", group=group, itself=False)
        got = positions.following(got, F.col("v"), "after", group=group)
        got = positions.ordinals(got, "n", group=group)
        got = {x["geid"]: (x["up"], x["before"], x["after"], x["n"]) for x in got.collect()}
        for i, (geid, g, v) in enumerate(rows):
            mine = [x for x in rows if not group or x[1] == g]
            at = mine.index((geid, g, v))
            held = [x[2] for x in mine[:at] if x[2] is not None]
            later = [x[2] for x in mine[at + 1 :] if x[2] is not None]
            before = held[-1] if held else None
            assert got[geid] == (before if v is None else v, before, later[0] if later else None, at)


def test_long_chains_are_followed_to_their_end(spark):
    from strandline.operators import lineage

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 7), (None, 1)], "a long, b long")
    got = {(r["a"], r["b"]) for r in lineage.reachable(edges).collect()}
    assert len(got) == sum(40 - i for i in range(7)) + 34 * 34 and (0, 40) in got
    assert lineage.reachable(edges.limit(0)).collect() == []


def test_dropped_steps_follow_a_stack(spark, monkeypatch):
    monkeypatch.setattr(positions, "RUN", 11)
    r = random.Random(5)
    rows = [(i, r.choice(["Step", "Step", "Drop", "Other"])) for i in range(500)]
    left = []
    for i, kind in rows:
        if kind == "Step":
            left.append(i)
        elif kind == "Drop" and left:
            left.pop()
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "geid long, kind string")
    got = brackets.without_dropped_steps(df, F.col("kind") == "Step", F.col("kind") == "Drop")
    assert sorted(x["geid"] for x in got.collect()) == left


def test_positions_cross_runs(spark, monkeypatch):
    monkeypatch.setattr(positions, "RUN", 7)
    ids = random.Random(1).sample(range(1000), 100)
    got = positions.ordinals(spark.createDataFrame([(i,) for i in ids], "geid long"), "n").collect()
    assert [x["geid"] for x in sorted(got, key=lambda x: x["n"])] == sorted(ids)
    assert sorted(x["n"] for x in got) == list(range(100))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_duckdb(spark, name):
    db = duckdb.connect()
    for t in ("events", "documents", "pages", "conversations", "lineitem", "orders", "supplier", "nation", "part", "customer"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert got == sorted(map(str, want))


@pytest.mark.parametrize("name", ["manifest_texts", "finalize_violations", "segment_counts", "geid_ranges"])
def test_lines_are_shuffled_as_numbers(spark, name):
    """Objects are built above the shuffle; texts are made and parsed in the same pass, without tables between."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("Exchange hashpartitioning(l_orderkey")
    assert below and "l_partkey" in below and not any(word in below for word in ("sha2", "s3://", "object_id"))
    assert "ExistingRDD" not in plan and ("from_json" in above) == ("structstojson" in above.lower() or "to_json" in above.lower()) == (name == "manifest_texts")


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize(("raw", "what"), [
    ("", "empty"), ("pkg", "no pattern"), ("zzz:x", "unknown selector"), ("local:x", "not allowed"), ("pkg:weird:x", "unknown match"),
    ("pkg:glob:", "empty pattern"), ("pkg:regex:(", "regex"),
])
def test_bad_selectors(raw, what):
    with pytest.raises(filters.FilterError):
        filters.Selector.parse(raw, filters.SCOPE_KINDS)


def test_selector_forms():
    parse = lambda raw: filters.Selector.parse(raw, filters.SCOPE_KINDS)
    assert parse("pkg:app.*") == filters.Selector("pkg", "glob", "app.*")
    assert parse("file:regex:a:b") == filters.Selector("file", "regex", "a:b")


HEAD = '[meta]\nname = "x"\nversion = {v}\n[scope]\ndefault_exec = "skip"\ndefault_value_action = "redact"\n'


@pytest.mark.parametrize("text", [
    HEAD.format(v=2), HEAD.format(v=1) + '[[scope.rules]]\nselector = "pkg:a"\nexec = "skipp"\n', HEAD.format(v=1) + "[zzz]\n",
    '[meta]\nname = "x"\nversion = 1\n', HEAD.format(v=1) + "[io]\ncapture = true\n", HEAD.format(v=1) + '[io]\nmodes = ["a"]\n',
])
def test_bad_filters(text):
    with pytest.raises(filters.FilterError):
        filters.Filter.from_texts(text)


def test_last_rule_wins_and_first_pattern_wins(spark):
    f = filters.Filter.from_texts(HEAD.format(v=1) + """
[[scope.rules]]
selector = "pkg:app.*"
exec = "trace"
value_default = "allow"
[[scope.rules.value_patterns]]
selector = "arg:literal:password"
action = "redact"
[[scope.rules.value_patterns]]
selector = "arg:glob:pass*"
action = "drop"
[[scope.rules]]
selector = "obj:app.foo.bar"
value_default = "redact"
""")
    scopes = spark.createDataFrame([("app.foo", "app/foo.py", "app.foo.x"), ("app.foo", "app/foo.py", "app.foo.bar"), ("lib", None, None)], "module string, file string, object string")
    rows = [tuple(r) for r in f.decide(f.classify(scopes), "arg", __import__("pyspark").sql.functions.lit("password")).select("exec", "value_default", "matched_rule", "action").collect()]
    assert rows == [("trace", "allow", 0, "redact"), ("trace", "redact", 1, "redact"), ("skip", "redact", -1, "redact")]
    assert f.summary()[0]["name"] == "x" and len(f.summary()[0]["sha256"]) == 64


@pytest.mark.parametrize(("pattern", "text", "hit"), [
    ("*.py", "a.py", True), ("*.py", "d/a.py", False), ("**/*.py", "d/e/a.py", True), ("**/*.py", "a.py", True), ("a?c", "abc", True), ("a?c", "a/c", False),
    ("[a-c]x", "bx", True), ("[!a]x", "ax", False), ("{foo,bar}.x", "bar.x", True), (r"a\*", "a*", True), ("a.b", "axb", False), ("app.*", "app.a.b", True),
])
def test_globs(spark, pattern, text, hit):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(scalars.glob_to_regex(pattern))).first()[0] is hit


def test_codecs_of_names_and_numbers():
    for name in ("", "events.log", "a/b-c.0", "z" * 12):
        assert scalars.base40_decode(scalars.base40_encode(name)) == name
    assert scalars.base40_encode("z" * 12) > 2**63
    for bad in ("a" * 13, "A", "ä"):
        with pytest.raises(ValueError):
            scalars.base40_encode(bad)
    for n in (0, 127, 128, 300, 2**64 - 1):
        assert scalars.leb128_decode(scalars.leb128_encode(n)) == (n, len(scalars.leb128_encode(n)))
    for bad in (b"", b"\x80", b"\xff" * 10):
        with pytest.raises(ValueError):
            scalars.leb128_decode(bad)


def test_blocks_fail_over(spark):
    item = lambda name: {"object_id": name, "uri": f"s3://pool/{name}", "size_bytes": 4096, "sha256": "0" * 64, "upload": "uploaded"}
    shard = lambda s, k, name: {"shard_index": k, "block_start": 64 * k, "block_end": 64 * k + 63, "replicas": [item(f"segment-{s}-{name}-{r}") for r in "ab"]}
    segments = [{"index": s, "geid_start": 100 * s + 1, "geid_end": 100 * s + 100, "shards": [shard(s, 0, "low"), shard(s, 1, "high")]} for s in range(4)]
    text = json.dumps({"schema": "v1", "recording_id": "r", "source": {"kind": "sharded_split_ctfs", "segments": segments}})
    shards = storage.shards(storage.parse(spark.createDataFrame([(text,)], "json string")))
    asked = spark.createDataFrame([(1, 70), (1, 63), (3, 127), (1, 200)], "segment int, block long")
    first = {(r["segment"], r["block"]): r["object_id"] for r in storage.resolve_blocks(shards, asked).collect()}
    assert first == {(1, 70): "segment-1-high-a", (1, 63): "segment-1-low-a", (3, 127): "segment-3-high-a"}
    second = storage.resolve_blocks(shards, asked, lambda r: ~r["object_id"].endswith("-a")).collect()
    assert {r["object_id"] for r in second} == {"segment-1-high-b", "segment-1-low-b", "segment-3-high-b"}


def test_paths(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("/a//b/./c/../d",), ("a\\b",), ("../x",)], "p string")
    assert [r[0] for r in df.select(scalars.posix_path(F.col("p"))).collect()] == ["a/b/d", "a/b", None]
    names = spark.createDataFrame([("a/b.py",), ("a/__init__.py",), ("a-b.py",), ("a/__init__",), ("a//b.py",), ("__init__.py",)], "p string")
    assert [r[0] for r in names.select(scalars.module_name(F.col("p"))).collect()] == ["a.b", "a", None, "a.__init__", "a.b", None]
    assert scalars.base40_decode(40 * 40 * 3 + 2) == "1"
    words = spark.createDataFrame([("x" * 121, "JS ", "return", "018f0000-0000-7000-8000-000000000000"), ("y" * 120, "go", "?", "018f0000-0000-4000-8000-000000000000")], "a string, b string, c string, d string")
    got = words.select(scalars.shortened(F.col("a")), scalars.language(F.col("b")), scalars.value_kind_number(F.col("c")), scalars.is_uuid7(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [("x" * 120 + "…", "javascript", 3, True), ("y" * 120, None, None, False)]
    scalars.register(spark)
    words.createOrReplaceTempView("words")
    got = spark.sql("SELECT shortened(a), trace_language(b), uuid7_millis(d), relative_path('/x/src/y') FROM words").collect()
    assert tuple(got[0]) == ("x" * 120 + "…", "javascript", 0x018F00000000, "<relative-to-this>/src/y")
