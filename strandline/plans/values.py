"""Queries over values, types, dictionaries, calls with arguments, and IO events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline import schema
from strandline.operators import brackets, positions, records
from strandline.plans.adapter import table, trace

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _count(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def with_payload(rows: DataFrame) -> DataFrame:
    """The trace with a value record for every event: all fifteen kinds in turn, nested ones with children."""
    line = F.col("line")
    record = lambda kind, **fields: F.to_json(F.struct(F.lit(kind).alias("kind"), *(v.alias(k) for k, v in fields.items())))
    inner = lambda kind, **fields: F.struct(F.lit(kind).alias("kind"), *(v.alias(k) for k, v in fields.items()))
    t, child = (F.col("geid") % 34).alias("type_id"), F.lit(7).cast("long")
    number = lambda n: inner("Int", i=line + n, type_id=child)
    kinds = [
        record("Int", i=line, type_id=t), record("Float", f=F.concat(line.cast("string"), F.lit(".5")), type_id=t), record("Bool", b=line % 2 == 0, type_id=t),
        record("String", text=F.concat(F.lit('s"'), line.cast("string")), type_id=t), record("Sequence", elements=F.array(number(0), number(1)), is_slice=F.lit(False), type_id=t),
        record("Tuple", elements=F.struct(number(0).alias("a"), inner("Bool", b=F.lit(True), type_id=child).alias("b")), type_id=t),
        record("Struct", field_values=F.array(number(5), number(6), number(7)), type_id=F.lit(6)),
        record("Variant", discriminator=F.concat(F.lit("Case"), (line % 3).cast("string")), contents=inner("Sequence", elements=F.array(number(2)), type_id=child), type_id=t),
        record("Reference", dereferenced=number(3), address=F.col("geid") * 4096 + line, mutable=F.lit(True), type_id=t),
        record("Raw", r=F.concat(F.lit("raw "), line.cast("string")), type_id=t), record("Error", msg=F.lit("no value"), type_id=t), record("None", type_id=t),
        record("Cell", place=line), record("BigInt", b=F.base64(F.unhex(F.lpad(F.hex(F.col("geid") * 1000003 + line), 24, "01"))), negative=line % 2 == 1, type_id=t),
        record("Char", c=F.char(97 + line % 26), type_id=t),
    ]
    # a tuple's elements differ in kind, which an array of structs cannot hold: they are written as a pair and joined up
    kinds[5] = F.regexp_replace(F.regexp_replace(kinds[5], r'"elements":\{"a":', '"elements":['), r',"b":(\{[^{}]*\})\}', r",$1]")
    payload = F.when(F.lit(False), F.lit(""))
    for i, kind in enumerate(kinds):
        payload = payload.when(F.col("geid") % len(kinds) == i, kind)
    return rows.withColumn("payload", payload)


def recorded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_payload(trace(spark, sf_dir).where("kind = 'Value'"))


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geid, kind and name of the type of every value; names are what identifies a type."""
    rows = trace(spark, sf_dir).where("kind = 'Value'")
    return rows.select("geid", (F.col("geid") % 34).alias("kind"), F.concat(F.lit("T"), (F.col("geid") % 34 % 20).cast("string")).alias("name"))


@query
def rendered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.col("payload")
    return recorded_values(spark, sf_dir).select("geid", records.rendered(payload).alias("shown"), records.type_kind(payload).alias("type_kind"), records.type_name(payload).alias("type_name"))


@query
def big_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recorded_values(spark, sf_dir).withColumn("number", records.big_integer(F.col("payload"))).where("number IS NOT NULL")
    return rows.select("geid", F.col("number").cast("string").alias("number"))


@query
def value_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.nodes(recorded_values(spark, sf_dir).select("geid", "payload"))
    return found.select("geid", "node", "parent", F.col("pos").cast("int").alias("pos"), "kind", records.rendered(F.col("payload")).alias("shown"))


@query
def struct_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Struct values with the names that their type gives to the positions; the type table has one row a field."""
    fields = spark.createDataFrame([(6, 0, "x"), (6, 1, "y"), (6, 2, "label")], "type_id long, pos int, name string")
    found = records.nodes(recorded_values(spark, sf_dir).select("geid", "payload").where(F.get_json_object("payload", "$.kind") == "Struct"))
    owners = found.where("kind = 'Struct'").select("geid", F.col("node").alias("parent"), F.col("type_id").alias("owner_type"))
    named = found.join(owners, ["geid", "parent"]).join(F.broadcast(fields), (F.col("owner_type") == fields.type_id) & (found.pos == fields.pos))
    return named.select("geid", "name", records.rendered(F.col("payload")).alias("shown"))


@query
def dictionary_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interning by name: ids in the order of first calls, after the top level, which is 0."""
    seen = trace(spark, sf_dir).where("kind = 'Call'").groupBy(F.concat(F.lit("fn_"), F.col("function_id").cast("string")).alias("name")).agg(F.min("geid").alias("first_geid"))
    top = spark.createDataFrame([("<toplevel>", -1)], "name string, first_geid long")
    return top.unionByName(seen).withColumn("id", (F.row_number().over(Window.orderBy("first_geid")) - 1).cast("long"))


@query
def dictionary_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interning by name alone: the kind is that of the first use; id 0 is the type of nothing."""
    seen = types(spark, sf_dir).groupBy("name").agg(F.min("geid").alias("first_geid"), F.min_by("kind", "geid").alias("kind"))
    none = spark.createDataFrame([("None", -1, schema.TYPE_KINDS.index("None"))], "name string, first_geid long, kind long")
    return none.unionByName(seen.select("name", "first_geid", "kind")).withColumn("id", (F.row_number().over(Window.orderBy("first_geid")) - 1).cast("long"))


@query
def dictionary_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = trace(spark, sf_dir).where("kind = 'Value'").groupBy(F.concat(F.lit("v"), F.col("function_id").cast("string")).alias("name")).agg(F.min("geid").alias("first_geid"))
    return seen.withColumn("id", (F.row_number().over(Window.orderBy("first_geid")) - 1).cast("long"))


@query
def step_values_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each step as one JSON array in the order in which they were recorded."""
    rows = positions.latest(with_payload(trace(spark, sf_dir)), F.when(F.col("kind") == "Step", F.col("geid")), "step_geid", group=("thread_id",))
    rows = rows.where("kind = 'Value' AND step_geid IS NOT NULL")
    item = F.struct("geid", F.struct(F.col("function_id").alias("varname_id"), records.type_name(F.col("payload")).alias("type"), records.rendered(F.col("payload")).alias("value")).alias("x"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["x"])
    return rows.groupBy("step_geid").agg(F.to_json(listed).alias("json"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_key, call_geid, parent_key, function_id, depth, entry_step, exit_step, children_count.

    Steps are those of the thread: the latest one at the call, and at its return or null while it runs.
    """
    rows = trace(spark, sf_dir)
    steps = positions.ordinals(rows.where("kind = 'Step'").select("geid", "thread_id"), "step_id").select("geid", "step_id")
    at = rows.select("geid", "thread_id", "kind").join(steps, "geid", "left")
    at = positions.latest(at, F.col("step_id"), "latest_step", group=("thread_id",)).where("kind IN ('Call', 'Return')").select("geid", "latest_step")
    tree = positions.ordinals(brackets.call_tree(rows), "call_key", order="call_geid")
    parents = tree.select(F.col("call_geid").alias("parent_geid"), F.col("call_key").alias("parent_key"))
    entry, leave = at.toDF("call_geid", "entry_step"), at.toDF("exit_geid", "exit_step")
    return tree.join(parents, "parent_geid", "left").join(entry, "call_geid").join(leave, "exit_geid", "left").select(
        "call_key", "call_geid", F.coalesce("parent_key", F.lit(schema.NO_KEY)).alias("parent_key"), "function_id", "depth", "entry_step", "exit_step", "children_count"
    )


@query
def call_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir)


def arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_geid, i, variable_id, payload: values between a thread's last step and a call are the call's arguments."""
    rows = with_payload(trace(spark, sf_dir))
    ends = F.when(F.col("kind").isin("Call", "Step", "Return"), F.struct("geid", "kind"))
    staged = positions.following(rows, ends, "end", group=("thread_id",)).where("kind = 'Value' AND end.kind = 'Call'")
    staged = staged.select("geid", F.col("end.geid").alias("call_geid"), F.col("function_id").alias("variable_id"), "payload")
    return positions.ordinals(staged, "i", group=("call_geid",)).select("call_geid", "i", "variable_id", "payload")


@query
def call_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arguments(spark, sf_dir).select("call_geid", "i", "variable_id", records.rendered(F.col("payload")).alias("shown"))


@query
def call_arg_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = arguments(spark, sf_dir).groupBy("call_geid").agg(_count())
    every = trace(spark, sf_dir).where("kind = 'Call'").select(F.col("geid").alias("call_geid"))
    return every.join(counted, "call_geid", "left").select("call_geid", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query
def call_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("i", F.struct("variable_id", records.rendered(F.col("payload")).alias("value")).alias("x"))
    args = arguments(spark, sf_dir).groupBy("call_geid").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["x"]).alias("args"))
    nothing = F.array().cast("array<struct<variable_id:bigint,value:string>>")
    record = F.struct("function_id", "parent_key", "depth", "children_count", F.coalesce("args", nothing).alias("args"))
    return calls(spark, sf_dir).join(args, "call_geid", "left").select("call_key", F.to_json(record).alias("json"))


@query
def calls_without_their_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that do not follow a step on their function's line (here ten times its id), arguments aside."""
    rows = trace(spark, sf_dir)
    before = F.when(F.col("kind") != "Value", F.struct("kind", "line"))
    found = positions.latest(rows, before, "before", group=("thread_id",), itself=False).where("kind = 'Call'")
    good = (F.col("before.kind") == "Step") & (F.floor(F.col("before.line") / 10) == F.col("function_id"))
    return found.where(~F.coalesce(good, F.lit(False))).select(F.col("geid").alias("call_geid"), F.col("before.kind").alias("before"))


def exec_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, kind, thread_id, path_id, line of steps and of the switches before them, which count as entries of their own."""
    rows = positions.latest(trace(spark, sf_dir).where("kind = 'Step'"), F.col("thread_id"), "running", itself=False)
    switched = F.col("running").isNotNull() & (F.col("running") != F.col("thread_id"))
    both = rows.withColumn("part", F.explode(F.when(switched, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    placed = positions.ordinals(both.withColumn("at", F.col("geid") * 2 + F.col("part")), "n", order="at")
    return placed.withColumn("entry", F.when(F.col("part") == 0, "thread_switch").otherwise("step"))


@query
def exec_stream_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.to_json(F.struct(F.lit("step").alias("kind"), "path_id", "line"))
    switch = F.to_json(F.struct(F.lit("thread_switch").alias("kind"), "thread_id"))
    return exec_stream(spark, sf_dir).select("n", F.when(F.col("entry") == "step", step).otherwise(switch).alias("json"))


@query
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cardinalities: entries of the execution stream with switches, calls, events and all four dictionaries."""
    rows = trace(spark, sf_dir)
    counted = rows.agg(
        F.count(F.when(F.col("kind") == "Call", 1)).alias("calls"), F.count(F.when(F.col("kind") == "Event", 1)).alias("events"),
        F.count_distinct("path_id").alias("paths"), (F.count_distinct(F.when(F.col("kind") == "Call", F.col("function_id"))) + 1).alias("functions"),
        F.count_distinct(F.when(F.col("kind") == "Value", F.col("function_id"))).alias("variables"),
    )
    listed = counted.unpivot([], counted.columns, "what", "n")
    entries = exec_stream(spark, sf_dir).agg(F.lit("entries").alias("what"), _count())
    kinds = types(spark, sf_dir).agg(F.lit("types").alias("what"), (F.count_distinct("name") + 1).alias("n"))
    return listed.unionByName(entries).unionByName(kinds)


def io_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, kind, log_kind, step_id, data of every logged event; kinds are folded to 0 output, 1 errors' output, 2 file operation, 3 error."""
    rows = trace(spark, sf_dir)
    steps = positions.ordinals(rows.where("kind = 'Step'").select("geid"), "step_id")
    rows = rows.join(steps, "geid", "left")
    rows = positions.latest(rows, F.col("step_id"), "at_step").where("kind = 'Event'")
    log = F.col("line") % len(schema.LOG_KINDS)
    folded = F.when(log == schema.LOG_KINDS.index("Write"), 0).when(log == schema.LOG_KINDS.index("Error"), 3).otherwise(2)
    return positions.ordinals(rows.select("geid", log.cast("int").alias("log_kind"), folded.alias("kind"), F.col("at_step").alias("step_id"), F.col("content").alias("data")), "i")


@query
def event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io_events(spark, sf_dir).select("i", "kind", "log_kind", "step_id", "data")


@query
def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io_events(spark, sf_dir).select("i", F.to_json(F.struct("kind", "step_id", F.length("data").alias("size"))).alias("json"))


@query
def place_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each place held a value: until it is written again or dropped (events drop the place that they name)."""
    key = ("place",)
    rows = trace(spark, sf_dir).where("kind IN ('Value', 'Event')").select("geid", "kind", (F.col("line") % 50).alias("place"))
    rows = positions.following(rows, F.struct("geid", "kind"), "end", group=key).where("kind = 'Value'")
    rows = positions.ordinals(rows, "version", group=key)
    return rows.select("place", "version", F.col("geid").alias("from_geid"), F.col("end.geid").alias("to_geid"), (F.col("end.kind") == "Event").alias("dropped"))


@query
def asm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of instructions per event, a row each."""
    listed = F.split(F.regexp_replace("content", r'[{}":]', ""), " ")
    return trace(spark, sf_dir).where("kind = 'Event'").select("geid", F.posexplode(listed).alias("i", "instruction"))


@query
def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Program, working folder and arguments out of each recording's metadata text."""
    meta = F.to_json(F.struct(F.col("c_name").alias("program"), F.concat(F.lit("/w/"), F.col("c_custkey").cast("string")).alias("workdir"), F.array(F.lit("-n"), F.col("c_nationkey").cast("string")).alias("args")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.from_json(meta, "program string, workdir string, args array<string>").alias("m"))
    return rows.select("c_custkey", "m.program", "m.workdir", F.size("m.args").alias("n_args"), F.element_at("m.args", -1).alias("last_arg"))


@query
def rate_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of lines among a path's lines by hits: rank, tile, n-th value and a range frame."""
    hits = trace(spark, sf_dir).where("kind = 'Step'").groupBy("path_id", "line").agg(_count("hits"))
    by_hits = Window.partitionBy("path_id").orderBy(F.col("hits").desc())
    by_line = Window.partitionBy("path_id").orderBy("line")
    return hits.select(
        "path_id", "line", F.rank().over(by_hits).cast("long").alias("rank"), F.ntile(4).over(by_line).cast("long").alias("quarter"),
        F.nth_value("line", 3).over(by_line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("third_line"),
        F.sum("hits").over(by_line.rangeBetween(-5, 5)).alias("around"),
    )


@query
def approximate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches against exact figures: whether they agree within their error."""
    rows = trace(spark, sf_dir).groupBy("kind").agg(
        F.approx_count_distinct("line", 0.02).alias("about"), F.count_distinct("line").alias("exact"), F.percentile_approx("line", 0.5, 10000).alias("middle"),
    )
    return rows.select("kind", (F.abs(F.col("about") - F.col("exact")) <= 0.1 * F.col("exact")).alias("close"), F.col("middle").cast("long").alias("middle"))
