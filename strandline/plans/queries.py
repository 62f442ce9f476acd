"""Queries over traces: one function each, named as in the driver contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline import schema
from strandline.functions import scalars
from strandline.operators import brackets, filters, lineage, positions
from strandline.plans.adapter import table, trace

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _count(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


# --- lookups and scans


@query
def step_enclosing_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = brackets.enclosing_calls(trace(spark, sf_dir)).where("kind = 'Step'")
    ranked = positions.ordinals(steps.select("geid", "thread_id", "path_id", "line", F.col("enclosing").alias("call_geid"), F.col("depth").cast("long").alias("depth")), "step_id")
    return ranked.select("step_id", "geid", "thread_id", "path_id", "line", "call_geid", "depth")


@query
def call_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brackets.call_tree(trace(spark, sf_dir))


@query
def call_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = brackets.enclosing_calls(trace(spark, sf_dir)).where("kind = 'Call' AND enclosing IS NOT NULL")
    ranked = positions.ordinals(calls.select("geid", "enclosing"), "child_index", group=("enclosing",))
    return ranked.select(F.col("enclosing").alias("call_geid"), "child_index", F.col("geid").alias("child_geid"))


@query
def return_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = brackets.enclosing_calls(trace(spark, sf_dir)).where("kind = 'Return'")
    return rows.select(F.col("geid").alias("return_geid"), F.col("enclosing").alias("call_geid"))


@query
def drop_last_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace(spark, sf_dir)
    kept = brackets.without_dropped_steps(rows, F.col("kind") == "Step", F.col("kind") == "Event")
    return kept.select("geid", "path_id", "line")


@query
def step_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.ordinals(trace(spark, sf_dir).where("kind = 'Step'").select("geid", "path_id", "line"), "step_id")


@query
def step_locations_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return step_ids(spark, sf_dir).where("step_id >= 100 AND step_id < 150").select("step_id", "path_id", "line")


@query
def seek_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).where("geid >= 4090 AND geid < 4190").select("geid", "kind", "thread_id")


@query
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).groupBy("kind").agg(_count())


@query
def cardinalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).agg(
        F.count(F.when(F.col("kind") == "Step", 1)).alias("steps"), F.count(F.when(F.col("kind") == "Call", 1)).alias("calls"),
        F.count(F.when(F.col("kind") == "Event", 1)).alias("events"), F.count_distinct("path_id").alias("paths"), F.count_distinct("function_id").alias("functions"),
    )


@query
def dictionary_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interning: ids in the order of first appearance; the window runs over distinct names only."""
    seen = trace(spark, sf_dir).groupBy(F.concat(F.lit("src/file_"), F.col("path_id").cast("string")).alias("path")).agg(F.min("geid").alias("first_geid"))
    return seen.withColumn("id", (F.row_number().over(Window.orderBy("first_geid")) - 1).cast("long"))


@query
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id to name with placeholders for ids that the dictionary lacks; at most 34 dictionary rows are broadcast."""
    names = spark.createDataFrame(list(enumerate(schema.TYPE_KINDS[:8])), "function_id long, name string")
    rows = trace(spark, sf_dir).where("kind = 'Call'").join(F.broadcast(names), "function_id", "left")
    return rows.groupBy(F.coalesce("name", F.concat(F.lit("var_"), F.col("function_id").cast("string"))).alias("name")).agg(_count())


@query
def type_kind_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame(list(enumerate(schema.TYPE_KINDS)), "kind_id long, label string")
    rows = trace(spark, sf_dir).select((F.col("line") % 40).alias("kind_id"))
    return rows.join(F.broadcast(labels), "kind_id", "left").groupBy("kind_id", "label").agg(_count())


@query
def step_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = step_ids(spark, sf_dir)
    return rows.select("step_id", F.to_json(F.struct(F.lit("step").alias("kind"), "path_id", "line")).alias("json"))


# --- values, places, threads


def _with_step(rows: DataFrame) -> DataFrame:
    return positions.latest(rows, F.when(F.col("kind") == "Step", F.col("geid")), "step_geid", group=("thread_id",))


@query
def values_per_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_step(trace(spark, sf_dir)).where("step_geid IS NOT NULL")
    return rows.groupBy("step_geid").agg(F.count(F.when(F.col("kind") == "Value", 1)).alias("n_values"))


@query
def value_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_step(trace(spark, sf_dir)).where("kind = 'Value' AND step_geid IS NOT NULL")
    ranked = positions.ordinals(rows, "i", group=("step_geid",))
    return ranked.select("step_geid", "i", F.col("function_id").alias("variable_id"), "value")


@query
def values_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "variable_id"))), lambda x: x["variable_id"].cast("string")), ",")
    return value_at(spark, sf_dir).groupBy("step_geid").agg(listed.alias("variables"))


@query
def value_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each value of a thread's variable held: until the next assignment."""
    key = ("thread_id", "variable_id")
    rows = trace(spark, sf_dir).where("kind = 'Value'").select("thread_id", F.col("function_id").alias("variable_id"), F.col("geid"))
    rows = positions.following(positions.ordinals(rows, "version", group=key), F.col("geid"), "to_geid", group=key)
    return rows.select("thread_id", "variable_id", F.col("geid").alias("from_geid"), "to_geid", "version")


@query
def asof_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each logged event, the latest value before it in its thread."""
    value = F.when(F.col("kind") == "Value", F.col("geid"))
    return positions.latest(trace(spark, sf_dir), value, "value_geid", group=("thread_id",), itself=False).where("kind = 'Event'").select("geid", "value_geid")


@query
def thread_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in global order that differ in thread, whatever the gaps between their geids."""
    rows = positions.following(trace(spark, sf_dir).select("geid", "thread_id"), F.col("thread_id"), "next_thread")
    return rows.where("thread_id <> next_thread").groupBy("thread_id").agg(_count("switches"))


@query
def current_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thread that each event runs on where only switches name one: a switch holds until the next."""
    rows = trace(spark, sf_dir).select("geid", F.when(F.col("kind") == "Event", F.col("thread_id")).alias("switched_to"))
    return positions.latest(rows, F.col("switched_to"), "thread_id").select("geid", F.coalesce("thread_id", F.lit(0)).alias("thread_id"))


@query
def thread_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).groupBy("thread_id").agg(F.min("geid").alias("start_geid"), F.max("geid").alias("exit_geid"), _count())


@query
def dropped_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of ids per event, exploded: the last event that mentions each."""
    ids = F.explode(F.array("function_id", F.col("function_id") + 10, F.col("path_id") + 20)).alias("variable_id")
    return trace(spark, sf_dir).where("kind = 'Event'").select("geid", ids).groupBy("variable_id").agg(F.max("geid").alias("dropped_at"), _count())


@query
def assignment_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables reachable over assignment edges."""
    edges = trace(spark, sf_dir).where("kind = 'Value'").select(F.col("path_id").alias("a"), F.col("function_id").alias("b")).where("a < b").distinct()
    return lineage.reachable(edges).groupBy("a").agg(_count("reachable"))


# --- chunks, containers


@query
def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("content") + 17
    rows = positions.ordinals(trace(spark, sf_dir).select("geid", "content"), "i")
    return rows.groupBy(F.floor(F.col("i") / schema.EVENTS_A_CHUNK).alias("chunk_id")).agg(
        F.min("geid").alias("first_geid"), F.count(F.lit(1)).alias("event_count"), F.sum(size).alias("bytes")
    )


@query
def chunk_for_geid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of lookup of the chunk of some events: an interval equality on the chunk number."""
    chunks = chunk_index(spark, sf_dir).select("chunk_id", "first_geid", "event_count")
    asked = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7 % 12000).alias("g"), "o_orderkey")
    return (
        asked.withColumn("chunk_id", F.floor(F.col("g") / schema.EVENTS_A_CHUNK)).join(chunks, "chunk_id")
        .where("g >= first_geid AND g < first_geid + event_count").select("o_orderkey", "g", "chunk_id", "first_geid")
    )


@query
def event_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = trace(spark, sf_dir).select("geid", (F.octet_length("content") + 17).cast("long").alias("size"))
    return positions.running(sized, F.col("size"), "byte_offset")


@query
def container_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, mapping blocks and waste of documents as members of a container with 4096-byte blocks."""
    block, usable = 4096, 511
    docs = table(spark, sf_dir, "documents").select("source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    data = F.ceil(F.col("size") / block)
    mapping = F.when(F.col("size") > 0, F.ceil(F.ceil(F.col("size") / block) / usable)).otherwise(0)
    out = docs.groupBy("source").agg(_count("files"), F.sum("size").alias("bytes"), F.sum(data).cast("long").alias("data_blocks"), F.sum(mapping).cast("long").alias("mapping_blocks"))
    return out.withColumn("waste", F.greatest(F.lit(0), F.col("data_blocks") * block - F.col("bytes")).cast("long"))


@query
def size_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalars.format_size(F.col("n_chars") * 97).alias("shown"))


@query
def file_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


@query
def hex_and_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("props").cast("binary")
    return table(spark, sf_dir, "events").select("event_id", F.lower(F.hex(raw)).alias("hex"), F.base64(raw).alias("base64"), F.base64(F.unbase64(F.base64(raw))).alias("again"))


@query
def uuid7_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower(F.lpad(F.hex(F.col("event_id") * 1000003 + 1700000000000), 12, "0"))
    uuid = F.concat(F.substring(text, 1, 8), F.lit("-"), F.substring(text, 9, 4), F.lit("-7000-8000-000000000000"))
    return table(spark, sf_dir, "events").select("event_id", uuid.alias("uuid"), scalars.uuid7_millis(uuid).alias("millis"))


@query
def http_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (200, 201, 400, 404, 408, 429, 500, 503))), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "orders").groupBy(scalars.http_error_class(status).alias("class")).agg(_count())


@query
def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", r"^[a-z]+://[^/]*", "")
    return table(spark, sf_dir, "pages").select("page_id", scalars.posix_path(F.concat(path, F.lit("/./a/../b"))).alias("path"))


@query
def correct_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/home/u/src/x/src/"), F.col("page_id").cast("string"), F.lit(".nr"))
    return table(spark, sf_dir, "pages").select("page_id", scalars.relative_path(path).alias("path"))


@query
def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("app/m"), (F.col("p_partkey") % 9).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "/__init__.py").when(F.col("p_partkey") % 3 == 1, ".py").otherwise("-x.py"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.module_name(path).alias("module"))


# --- rules


@query
def filter_exec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification of distinct scopes by compiled rules, then counted over events."""
    scopes = filters.demo_scopes(trace(spark, sf_dir))
    decided = filters.DEMO.classify(scopes)
    rows = trace(spark, sf_dir).join(decided, ["path_id", "function_id"])
    return rows.groupBy("exec", "matched_rule").agg(_count())


@query
def filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = filters.demo_scopes(trace(spark, sf_dir)).withColumn("value_name", F.concat(F.lit("v"), (F.col("function_id") * 7 % 10).cast("string")))
    return filters.DEMO.decide(filters.DEMO.classify(scopes), "local", F.col("value_name")).select("path_id", "function_id", "value_name", "action")


@query
def redacted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = filters.DEMO.classify(filters.demo_scopes(trace(spark, sf_dir))).withColumn("value_name", F.lit("secret_key"))
    decided = filters.DEMO.decide(scopes, "local", F.col("value_name")).select("path_id", "function_id", "exec", "action")
    rows = trace(spark, sf_dir).where("kind = 'Value'").join(decided, ["path_id", "function_id"]).where("exec = 'trace' AND action <> 'drop'")
    return rows.select("geid", F.when(F.col("action") == "redact", F.lit(None)).otherwise(F.col("line")).alias("shown"))


@query
def longest_project_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/w/p"), (F.col("p_partkey") % 4).cast("string"), F.lit("/q"), (F.col("p_partkey") % 3).cast("string"), F.lit("/f.py")).alias("path"))
    return filters.with_root(files, "path", ["/w", "/w/p1", "/w/p1/q2", "/w/p2"]).select("p_partkey", "root", "relative")


@query
def chained_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inline source and a project's on top of it: decisions for locals and arguments of every scope."""
    scopes = filters.CHAINED.classify(filters.demo_scopes(trace(spark, sf_dir))).withColumn("value_name", F.concat(F.lit("v"), (F.col("function_id") % 5).cast("string")))
    kinds = [filters.CHAINED.decide(scopes, kind, F.col("value_name")).withColumn("value_kind", F.lit(kind)) for kind in ("local", "arg")]
    return kinds[0].unionByName(kinds[1]).select("path_id", "function_id", "value_kind", "value_name", "exec", "value_default", "matched_rule", "action")


@query
def hinted_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorder's hint of the module overrides the derived one if it is a dotted name."""
    hint = F.when(F.col("function_id") % 3 == 0, F.concat(F.lit("pkg.f"), F.col("function_id").cast("string"))).when(F.col("function_id") % 3 == 1, "not-a module")
    scopes = filters.demo_scopes(trace(spark, sf_dir)).withColumn("hint", hint).withColumn("qualname", F.when(F.col("path_id") != 3, F.concat(F.lit("run"), F.col("function_id").cast("string"))))
    return filters.with_hint(scopes, "hint", "qualname").select("path_id", "function_id", "module", "object")


@query
def project_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest of many roots above each file, and the earliest source where two name one folder."""
    k = F.col("p_partkey").cast("string")
    files = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/w/p"), (F.col("p_partkey") % 40).cast("string"), F.lit("/q"), (F.col("p_partkey") % 7).cast("string"), F.lit("/f"), k, F.lit(".py")).alias("path"))
    s = F.col("s_suppkey")
    root = F.concat(F.lit("/w/p"), (s % 60).cast("string"), F.when(s % 2 == 0, F.concat(F.lit("/q"), (s % 9).cast("string"), F.lit("/"))).otherwise(""))
    roots = table(spark, sf_dir, "supplier").select(root.alias("root"), s.alias("source"))
    return filters.with_table_root(files, "path", roots, ("p_partkey",)).select("p_partkey", "root", "source", "relative")


# --- storage (configurations and manifests are in storage_rules.py)


@query
def retry_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each object; those to send again."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag")
    state = F.when(F.col("l_returnflag") == "A", "uploaded").when(F.col("l_returnflag") == "R", "retryable_failure").otherwise("fatal_failure")
    latest = rows.groupBy("l_partkey").agg(F.max(F.struct("l_orderkey", "l_linenumber", state.alias("state"))).alias("x"), _count("attempts"))
    return latest.where("x.state = 'retryable_failure'").select("l_partkey", "attempts")


# --- analytics


@query
def line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).where("kind = 'Step'").groupBy("path_id", "line").agg(_count("hits"))


@query
def hot_lines_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("path_id").orderBy(F.col("hits").desc(), "line")
    return line_coverage(spark, sf_dir).withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 3")


@query
def function_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_tree(spark, sf_dir).groupBy("function_id").agg(
        _count("calls"), F.sum("own_steps").alias("steps"), F.max("depth").alias("max_depth"), F.count("exit_geid").alias("returned")
    )


@query
def trace_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that only even threads step on, against those of odd threads."""
    steps = trace(spark, sf_dir).where("kind = 'Step'")
    lines = lambda part: steps.where(F.col("thread_id") % 2 == part).select("path_id", "line").distinct()
    return lines(0).exceptAll(lines(1))


@query
def shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = trace(spark, sf_dir).where("kind = 'Step'")
    lines = lambda part: steps.where(F.col("thread_id") % 2 == part).select("path_id", "line")
    return lines(0).intersect(lines(1))


@query
def kind_path_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).cube("kind", "path_id").agg(_count())


@query
def path_function_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).rollup("path_id", "function_id").agg(_count(), F.min("geid").alias("first_geid"))


@query
def kind_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["Call", "Event", "Return", "Step", "Value"]
    return trace(spark, sf_dir).groupBy("path_id").pivot("kind", kinds).count().na.fill(0)


@query
def value_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change to the value before in the thread, sum of the last three, rank of the line among the thread's lines."""
    key = ("thread_id",)
    rows = positions.ordinals(trace(spark, sf_dir).where("kind = 'Value'").select("geid", "thread_id", "line"), "i", group=key)
    total = positions.running(rows, F.col("line"), "upto", group=key).withColumn("upto", F.col("upto") + F.col("line"))
    back = lambda n, name, c: total.select("thread_id", (F.col("i") + n).alias("i"), F.col(c).alias(name))
    lines = rows.select("thread_id", "line").distinct()  # a thread's different lines, which is what a rank is over
    places = lines.withColumn("place", F.row_number().over(Window.partitionBy("thread_id").orderBy("line")).cast("long"))
    out = total.join(back(1, "before", "line"), ["thread_id", "i"], "left").join(back(3, "third", "upto"), ["thread_id", "i"], "left").join(places, ["thread_id", "line"])
    return out.select("geid", (F.col("line") - F.col("before")).alias("change"), (F.col("upto") - F.coalesce("third", F.lit(0))).alias("recent"), "place")


@query
def windowed_event_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(_count())
    return rows.select(F.unix_timestamp("w.start").alias("start_s"), "kind", "n")


@query
def thread_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a thread's events with gaps of at most 200 positions."""
    key = ("thread_id",)
    rows = positions.latest(trace(spark, sf_dir).select("thread_id", "geid"), F.col("geid"), "before", group=key, itself=False)
    cut = F.when(F.col("geid") - F.col("before") > 200, 1).otherwise(0)
    rows = positions.running(rows.withColumn("cut", cut), F.col("cut"), "cuts", group=key).withColumn("session", F.col("cuts") + F.col("cut"))
    return rows.groupBy("thread_id", "session").agg(_count(), F.min("geid").alias("from_geid"))


@query
def log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen kinds of log events folded to stdout, file operation and error."""
    kind = F.col("line") % 14
    folded = F.when(kind == 0, 0).when(kind == 11, 3).otherwise(2)
    return trace(spark, sf_dir).where("kind = 'Event'").groupBy(folded.alias("folded")).agg(_count())


@query
def conversation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.lag("role").over(order).alias("before"), F.sum(F.length("text")).over(order).alias("offset_after"))
