"""Codecs, containers, JSON traces and streams."""

import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.functions.scalars import base40_decode, base40_encode
from strandline.operators import records
from strandline.plans import source_oracles, source_queries
from strandline.plans.adapter import trace
from strandline.schema import EVENT_KINDS, EVENT_SCHEMA
from strandline.sources import cbor, chunked, container, datasource, json_trace, side_tables, split_binary
from strandline.streaming import tail
from tests import containers

SAMPLES = {"Q": 7, "q": -3, "B": 11, "text": "é text", "cbor": '{"kind":"Int","i":42,"type_id":1}', "texts": ["mov", ""], "numbers": [1, 2**60]}
ONE_OF_EACH = [{"kind": k, **{name: SAMPLES[form] for name, form in split_binary.LAYOUT[k]}} for k in EVENT_KINDS]


@pytest.mark.parametrize("event", ONE_OF_EACH, ids=lambda e: e["kind"])
def test_events_round_trip(event):
    raw = split_binary.encode(event)
    got, end = split_binary.decode(raw)
    assert end == len(raw) and got == {"tag": EVENT_KINDS.index(event["kind"]), **event}
    for cut in range(1, len(raw)):
        with pytest.raises(ValueError):
            split_binary.decode(raw[:cut])


def test_fixed_sizes():
    size = {e["kind"]: len(split_binary.encode(e)) for e in ONE_OF_EACH}
    assert [size[k] for k in ("Step", "BindVariable", "AssignCompoundItem", "DropVariable", "ThreadStart", "DropLastStep")] == [17, 17, 25, 9, 9, 1]


def test_decoding_stops_or_raises():
    data = split_binary.encode(ONE_OF_EACH[0]) + b"\xff"
    assert len(split_binary.decode_all(data)) == 1
    with pytest.raises(ValueError):
        split_binary.decode_all(data, permissive=False)


@pytest.mark.parametrize("value", [0, 23, 24, 255, 256, 65536, 2**63, -1, -25, 1.5, "é", b"\0\1", [], [1, [2]], {"a": {"b": None}}, True, False, None])
def test_cbor(value):
    assert cbor.loads(cbor.dumps(value)) == value
    assert cbor.sequence(cbor.dumps(value) * 3) == [value] * 3


def test_container_levels():
    r = random.Random(0)
    members = {"empty": b"", "one": b"x", "deep": r.randbytes(1024 * (127 + 127**2 // 40)), "edge": b"y" * 1024 * 127}
    held = container.Container(containers.build(members, block=1024))
    assert {n: held.read(n) for n in members} == members
    with pytest.raises(ValueError):
        containers.build({f"m{i}": b"" for i in range(32)})
    with pytest.raises(ValueError):
        container.Container(b"nonsense" * 4)


def test_container_scan_and_seek(spark, tmp_path):
    steps = [{"kind": "Step", "path_id": 0, "line": i + 1} for i in range(10000)]
    (tmp_path / "a.ct").write_bytes(containers.trace_container(steps, ["main.py"], {"program": "p"}))
    path = str(tmp_path / "*.ct")
    assert {r["name"] for r in container.files(spark, path).collect()} == {"events.log", "events.fmt", "meta.json", "paths.json"}
    assert [(r[0], r[1]) for r in container.chunks(spark, path).select("first_geid", "event_count").orderBy("first_geid").collect()] == [(0, 4096), (4096, 4096), (8192, 1808)]
    assert container.events(spark, path).count() == 10000
    got = container.events(spark, path, 4090, 100).orderBy("geid").collect()  # over a chunk's edge
    assert [r["line"] for r in got] == list(range(4091, 4191)) and got[0]["kind"] == "Step" and got[0]["thread_id"] is None
    assert container.events(spark, path, 20000, 10).count() == 0


def test_container_of_every_kind(spark, tmp_path):
    (tmp_path / "b.ct").write_bytes(containers.trace_container(ONE_OF_EACH))
    rows = container.events(spark, str(tmp_path / "b.ct")).orderBy("geid").collect()
    assert [r["kind"] for r in rows] == list(EVENT_KINDS)
    assert rows[13]["variable_ids"] == [1, 2**60] and rows[10]["asm"] == ["mov", ""] and json.loads(rows[5]["payload"])["i"] == 42


@pytest.mark.parametrize("stated", [True, False])
def test_containers_of_cbor(spark, tmp_path, stated):
    (tmp_path / "c.ct").write_bytes(containers.cbor_container(ONE_OF_EACH, stated))
    rows = container.events(spark, str(tmp_path / "c.ct")).orderBy("geid").collect()
    assert [r["kind"] for r in rows] == list(EVENT_KINDS)
    assert rows[13]["variable_ids"] == [1, 2**60] and rows[10]["asm"] == ["mov", ""] and json.loads(rows[5]["payload"])["i"] == 42
    assert [r["geid"] for r in container.events(spark, str(tmp_path / "c.ct"), 3, 4).collect()] == [3, 4, 5, 6]
    one = container.files(spark, str(tmp_path / "c.ct")).where("name = 'events.log'").first()
    assert (one["block_size"], one["version"], one["compression"], one["encryption"]) == (4096, 3, 1, 0)


def test_data_source(spark, tmp_path):
    datasource.register(spark)
    steps = [{"kind": "Step", "path_id": i % 3, "line": i} for i in range(10000)]
    folder = tmp_path / "traces"
    folder.mkdir()
    (folder / "a.ct").write_bytes(containers.trace_container(steps))
    df = spark.read.format("strandline").option("chunks", 1).load(str(folder))
    assert df.rdd.getNumPartitions() == 3 and sorted(r[0] for r in df.select("line").collect()) == list(range(10000))
    seek = spark.read.format("strandline").option("chunks", 1).option("first", 4090).option("count", 3).load(str(folder))
    assert seek.rdd.getNumPartitions() == 1 and sorted(r[0] for r in seek.select("geid").collect()) == [4090, 4091, 4092]
    (folder / "b.ct").write_bytes(containers.cbor_container(ONE_OF_EACH))
    (folder / "c.bin").write_bytes(containers.cbor_file(ONE_OF_EACH))
    kinds = [r[0] for r in spark.read.format("strandline").load(str(folder)).where("line IS NULL OR kind <> 'Step'").select("kind").collect()]
    assert sorted(kinds) == sorted(2 * [k for k in EVENT_KINDS if k != "Step"])
    (folder / "d.txt").write_bytes(b"something else")
    with pytest.raises(Exception, match="not a trace"):
        spark.read.format("strandline").load(str(folder)).collect()


def test_parts_of_members():
    data = bytes(range(256)) * 200
    held = container.Container(containers.build({"a": data, "b": b"x"}, block=1024))
    for at, n in ((0, 10), (1020, 10), (5000, 30000), (51190, 100), (51200, 5), (10**9, 1)):
        assert held.read_at("a", at, n) == data[at : at + n]


def test_cut_off_chunks_raise():
    stream = containers.pack_chunks([{"kind": "DropLastStep"}] * 9, size=3)
    assert len(container.chunk_headers(stream)) == 3
    for cut in (1, 10, len(stream) // 2):
        with pytest.raises(ValueError, match="cut off"):
            container.chunk_headers(stream[:-cut])
        assert len(container.chunk_headers(stream[:-cut], whole=False)) < 3


def test_side_tables_raise_where_cut_off(spark):
    whole = side_tables.encode_files([{"name": 7, "kind": k, "flags": 0, "build_id": b"ab", "path": "p", "binary": 9, "folder": "é"} for k in side_tables.FILE_KINDS])
    assert [e["kind"] for e in side_tables.decode_files(whole)] == list(side_tables.FILE_KINDS)
    for cut in range(len(whole)):
        with pytest.raises(ValueError):
            side_tables.decode_files(whole[:cut])
    held = side_tables.encode_regions([(2**62, 1, 40**11, 0, 7)])
    read = lambda raw: side_tables.regions(spark.createDataFrame([(bytearray(raw),)], "content binary")).collect()
    assert [tuple(r) for r in read(held)] == [(0, 2**62, 1, "", 0, 7)] and read(side_tables.encode_regions([])) == []
    for bad in (held[:-1], b"XXXX" + held[4:], b""):
        with pytest.raises(Exception, match="mapped regions"):
            read(bad)


def test_names_just_below_a_power(spark):
    """Where the quotient of a decimal division would round up to the next whole number."""
    numbers = [2 * 40**11 - 1, 3 * 40**8 - 1, 40**12 - 1, 0, 40**6, base40_encode("bin3"), base40_encode("z" * 12), None]
    rows = spark.createDataFrame([(None if n is None else str(n),) for n in numbers], "n string").select(F.col("n").cast("decimal(20,0)"))
    assert [r[0] for r in rows.select(side_tables.base40_name(F.col("n"))).collect()] == [None if n is None else base40_decode(n) for n in numbers]


def test_rows_of_regions_do_not_hold_their_table(spark):
    held = [(2**17 * k, 4096 * k, base40_encode(f"b{k % 7}"), k, k % 8) for k in range(1, 3001)]
    tables = spark.createDataFrame([(5, bytearray(side_tables.encode_regions(held)))], "recording long, content binary")
    read = side_tables.regions(tables, "recording")
    kept = re.findall(r"Generate .*, \[([^\[\]]*)\], (?:true|false), \[[^\[\]]*\]", read._jdf.queryExecution().optimizedPlan().toString())
    assert len(kept) == 1 and "content" not in kept[0]
    assert sorted(tuple(r) for r in read.collect()) == [(5, i, a, n, f"b{(i + 1) % 7}", o, p) for i, (a, n, _, o, p) in enumerate(held)]


@pytest.mark.parametrize("name", ["mapped_regions", "address_regions"])
def test_tables_of_regions_in_parts(spark, monkeypatch, name):
    """No part holds more than three regions, and the numbers of the regions go on from part to part."""
    monkeypatch.setattr(source_queries, "REGIONS_A_PART", 3)
    sf, sizes, pack = "/root/testdata/sf0.01", [], side_tables.regions

    def counted(tables, *keep):
        sizes.extend(r[0] for r in tables.select(F.octet_length("content")).collect())
        return pack(tables, *keep)

    monkeypatch.setattr(side_tables, "regions", counted)
    df = source_queries.QUERIES[name](spark, sf)
    assert max(sizes) == 8 + 3 * side_tables.REGION_BYTES and len(sizes) > 25
    columns = ", ".join(f'"{c}"' for c in df.columns)
    db = duckdb.connect()
    for t in ("supplier", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, db.execute(f"SELECT {columns} FROM ({source_oracles.ORACLES[name]})").fetchall()))


def test_json_trace(spark, tmp_path):
    items = [{"Path": "foo.rs"}, {"Function": {"path_id": 0, "line": 1, "name": "main"}}, {"Step": {"path_id": 0, "line": 1}}, {"Call": {"function_id": 0, "args": []}},
             {"Return": {"return_value": {"kind": "Float", "f": "inf", "type_id": 0}}}, "DropLastStep", {"ThreadSwitch": 3}]
    (tmp_path / "t.json").write_text(json.dumps(items))
    df = json_trace.read(spark, str(tmp_path / "t.json"))
    rows = df.orderBy("geid").collect()
    assert [r["kind"] for r in rows] == ["Path", "Function", "Step", "Call", "Return", "DropLastStep", "ThreadSwitch"]
    assert rows[0]["payload"] == "foo.rs" and rows[1]["name"] == "main" and rows[2]["line"] == 1 and rows[5]["payload"] is None and rows[6]["thread_id"] == 3
    shown = df.where("kind = 'Return'").select(records.rendered(F.get_json_object("payload", "$.return_value")).alias("v")).first()
    assert shown["v"] == "inf"
    json_trace.write(df, str(tmp_path / "out"))
    back = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert back == items


def test_json_lines_come_back_in_order(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 5).selectExpr("id * 3 AS geid", "'Step' AS kind", """concat('{"path_id":', id % 7, ',"line":', id, '}') AS payload""")
    json_trace.write(rows, str(tmp_path / "lines"))
    got = json_trace.read_lines(spark, str(tmp_path / "lines")).orderBy("position").collect()
    assert [(r["position"], r["line"]) for r in got] == [(i, i) for i in range(3000)]


@pytest.mark.parametrize("codec", chunked.CODECS)
def test_chunks_of_every_kind(spark, codec):
    kinds = [e for e in ONE_OF_EACH if e["kind"] in chunked.known_kinds()]
    assert len(kinds) >= 9
    names = [f.split()[0] for f in chunked.FIELDS.split(", ")]
    rows = [(7 * i, *(e.get(n) for n in names)) for i, e in enumerate(kinds * 3)]
    df = spark.createDataFrame(rows, f"geid long, {chunked.FIELDS}").repartition(4)
    held = chunked.encode(df, codec, size=5)
    assert sorted(tuple(r) for r in chunked.decode(held).collect()) == sorted(rows, key=lambda r: r[0])
    part = chunked.decode(held, 35, 50).collect()
    assert sorted(r["geid"] for r in part) == [g for g in range(0, 7 * len(rows), 7) if 35 <= g < 85]
    broken = held.withColumn("event_count", F.col("event_count") + 1)
    with pytest.raises(Exception, match="holds"):
        chunked.decode(broken).collect()
    assert chunked.decode(chunked.encode(df.limit(0), codec)).collect() == []


def test_rates_close_with_the_watermark(spark, tmp_path):
    """A late event is left out once its window is closed."""
    source = str(tmp_path / "in")
    batches = [["2024-01-01 00:10:00", "2024-01-01 00:50:00"], ["2024-01-01 03:00:00"], ["2024-01-01 03:30:00"], ["2024-01-01 00:20:00", "2024-01-01 05:00:00"], ["2024-01-01 09:00:00"]]
    for i, part in enumerate(batches):
        spark.createDataFrame([(t, "Step") for t in part], "t string, kind string").selectExpr("CAST(t AS TIMESTAMP) AS ts", "kind").coalesce(1).write.mode("append").parquet(source)
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    import os

    for i, p in enumerate(files):
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = tail.event_rate(tail.follow(spark, source, "ts timestamp, kind string", 1))
    query = stream.writeStream.format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {str(r["window"]["start"]): r["n"] for r in spark.table("rates").collect()}
    assert got["2024-01-01 00:00:00"] == 2 and got["2024-01-01 03:00:00"] == 2 and got["2024-01-01 05:00:00"] == 1


def test_stream_keeps_stacks(spark, tmp_path):
    from tests.test_trace import stack_run

    rows = trace(spark, "/root/testdata/sf0.001").where("geid < 600").select("geid", "thread_id", "kind")
    source = str(tmp_path / "in")
    for part in range(3):
        rows.where(f"geid >= {200 * part} AND geid < {200 * part + 200}").coalesce(1).write.mode("append").parquet(source)
    query = (
        tail.call_depths(tail.follow(spark, source, "geid long, thread_id long, kind string", 1)).writeStream.format("memory").queryName("depths")
        .option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {r["geid"]: (r["depth"], r["enclosing"]) for r in spark.table("depths").collect()}
    assert got == stack_run(sorted((r["geid"], r["thread_id"], r["kind"]) for r in rows.collect()))


def test_schema_has_all_columns():
    assert EVENT_SCHEMA.count(",") == 21
