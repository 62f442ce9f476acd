"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share one and a half times
all words; a target stops at twice its source's size and the excess is shared among the others by weight.

Schedule: slot k of the mix gets the golden-ratio point frac(k * 0.618...), which the cumulative shares of
the sources map to a source; the slots of a source are ranked in order. Each source's documents, shuffled by
a hash, form a stream of words that is cut into blocks of BLOCK words; slot rank r takes block r of the
stream (a second pass starts where the first ends). A source's last block is cut where its target is met,
and the few slots by which the points miss a source's need are put at the end of the mix.

`mix` says per document how many of its words the mix takes and in which slots they begin and end;
`mixed_documents` is the mix itself, in the order of the slots: each document once for every pass that takes it.

Rows are numbered once, in a written table, so that rows which repeat an id or have none are told apart. Only
(number, source, size) rows move until then. Running sums go over (source, hash prefix) buckets of about a hundred
rows and two levels of bucket totals, so that a source with a third of all rows is no single task's work. Joins
of tables that grow with the documents are merge joins. Everything is built-in DataFrame operations, and
nothing depends on the order in which rows arrive.

Defined results: null and empty texts have size 0, take 0 words, and come last in the mix, once; a null source is
a source of its own; repeated rows are separate documents; a document that the target cuts keeps its first words,
with a blank between two of them; extra columns come along unchanged; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.shared import WORD, written

WEIGHTS = (5, 2, 1)
VOLUME, MOST_PASSES = 1.5, 2
GOLDEN = 0.6180339887498949
#: Words of a block; rows of a bucket of a stream; slots that are ranked together; cells that the slots fall into.
BLOCK, ROWS_A_BUCKET, RUN, CELLS = 256, 128, 1 << 11, 1 << 16
ROW = "__row"


def numbered(documents: DataFrame) -> DataFrame:
    """`documents` with a number for each row; to be written before it is used twice."""
    return documents.withColumn(ROW, F.monotonically_increasing_id())


def sized(documents: DataFrame) -> DataFrame:
    """One thin row a numbered document; `skey` names its source without nulls, `h` and `t` give its place in the shuffle."""
    return documents.select(
        ROW, "doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("skey"), F.col("source").isNull().alias("no_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), F.xxhash64("text").alias("t"),
    )


def targets(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """skey, source_size, target, quota (target in whole words): one row a source."""
    sources = documents.groupBy("skey", "no_source").agg(F.sum("size").alias("source_size"))
    by_name, by_cap = Window.orderBy("no_source", "skey"), Window.orderBy("cap", "skey")
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    weighed = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn).cast("double")).withColumn(
        "cap", MOST_PASSES * F.col("source_size") / F.col("w")
    )
    before, onwards = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    # what a unit of weight gets if this source is the first below its limit
    level = (VOLUME * F.sum("source_size").over(whole) - F.coalesce(MOST_PASSES * F.sum("source_size").over(before), F.lit(0.0))) / F.sum("w").over(onwards)
    leveled = weighed.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("cap"), F.struct("cap", "skey", "level"))).over(whole)["level"]
    return (
        leveled.withColumn("unit", first)
        .withColumn("target", F.least(F.col("w") * F.col("unit"), (MOST_PASSES * F.col("source_size")).cast("double")))
        .select("skey", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("quota"))
    )


def schedule(shares: DataFrame, block: int) -> DataFrame:
    """(slot, skey, rank): the order of the mix; rank r of a source takes its block r."""
    spark = shares.sparkSession
    need = shares.select("skey", F.ceil(F.col("quota") / block).cast("long").alias("need")).where("need > 0")
    up_to = F.sum("need").over(Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0))
    need = written(need.withColumn("upper", up_to).withColumn("lower", F.col("upper") - F.col("need")), "need")
    slots = int(need.agg(F.sum("need")).first()[0] or 0)
    point = F.col("id") * GOLDEN - F.floor(F.col("id") * GOLDEN)
    # a point's place among the needed blocks falls to one source: cells make it an equality join
    drawn = spark.range(1, slots + 1).select(F.col("id").alias("slot"), F.floor(point * slots).cast("long").alias("place"))
    width = max(1, -(-slots // CELLS))
    cells = need.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lower") / width), F.floor((F.col("upper") - 1) / width))))
    at = drawn.withColumn("cell", F.floor(F.col("place") / width))
    mapped = at.join(cells.hint("merge"), "cell").where("lower <= place AND place < upper").select("slot", "skey", "need")
    # ranks: per source and run of slots, then within the run
    mapped = written(mapped.withColumn("run", F.floor(F.col("slot") / RUN)), "mapped")
    sizes = mapped.groupBy("skey", "run").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("skey").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    offset = sizes.select("skey", "run", F.coalesce(so_far, F.lit(0)).alias("offset"))
    ranked = mapped.withColumn("r", F.row_number().over(Window.partitionBy("skey", "run").orderBy("slot")) - 1).join(offset.hint("merge"), ["skey", "run"])
    ranked = ranked.select("slot", "skey", (F.col("r") + F.col("offset")).alias("rank"), "need").where("rank < need")
    got = need.join(sizes.groupBy("skey").agg(F.sum("n").alias("got")), "skey", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    late = got.where("got < need").select(F.lit(slots + 1).cast("long").alias("slot"), "skey", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank"), "need")
    return ranked.unionByName(late).select("slot", "skey", "rank")


def _streams(documents: DataFrame, rows: int) -> DataFrame:
    """Each document's place (start) in its source's shuffled stream of words."""
    digits, buckets = 1, max(1, rows // ROWS_A_BUCKET)
    while 16**digits < buckets:
        digits += 1
    keyed = documents.withColumn("bucket", F.conv(F.substring("h", 1, digits), 16, 10).cast("long"))
    sums = keyed.groupBy("skey", "bucket").agg(F.sum("size").alias("total")).withColumn("coarse", F.floor(F.col("bucket") / 1024))
    so_far = lambda *by: F.sum("total").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1))
    coarse = sums.groupBy("skey", "coarse").agg(F.sum("total").alias("total"))
    coarse = coarse.select("skey", "coarse", F.coalesce(so_far("skey", "coarse"), F.lit(0)).alias("above"))
    fine = sums.select("skey", "coarse", "bucket", F.coalesce(so_far("skey", "coarse", "bucket"), F.lit(0)).alias("within"))
    offsets = fine.join(coarse.hint("merge"), ["skey", "coarse"]).select("skey", "bucket", (F.col("above") + F.col("within")).alias("offset"))
    order = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size", "t")
    placed = keyed.withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(offsets.hint("merge"), ["skey", "bucket"]).withColumn("start", F.col("before") + F.col("offset"))


def takes(thin: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The (written) thin rows with their source's size and target, and one row for every pass that takes a document:
    row, pass, size, take (words), and the slots in which they begin and end."""
    rows = thin.count()
    shares = written(targets(thin), "shares")
    slots = schedule(shares, block)
    placed = written(_streams(thin, rows).join(shares, "skey"), "placed")
    # the blocks that a document's words fall into, in each pass over its source
    begin = F.col("start") + F.col("pass") * F.col("source_size")
    spread = (
        placed.where("size > 0").withColumn("pass", F.explode(F.array(*map(F.lit, range(MOST_PASSES)))))
        .withColumn("begin", begin).where("begin < quota").withColumn("stop", F.least(F.col("begin") + F.col("size"), F.col("quota")))
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("stop") - 1) / block))))
    )
    part = F.least("stop", (F.col("rank") + 1) * block) - F.greatest("begin", F.col("rank") * block)
    taken = spread.join(slots.select("skey", "rank", "slot").hint("merge"), ["skey", "rank"]).groupBy(ROW, "pass", "size").agg(
        F.sum(part).cast("long").alias("take"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")
    )
    return placed, taken


def mix(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot and last_slot for every document, and its source key."""
    placed, taken = takes(written(sized(numbered(documents)), "sized"), block)
    whole = taken.groupBy(ROW).agg(F.sum("take").alias("taken"), F.min("first_slot").alias("first_slot"), F.max("last_slot").alias("last_slot"))
    return placed.join(whole.hint("merge"), ROW, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "last_slot", "skey"
    )


def mixed_documents(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: a row of `documents` for every pass that takes it, in the order of the slots, with all their columns."""
    base = written(numbered(documents), "numbered")
    thin = written(sized(base), "sized")
    _, taken = takes(thin, block)
    empty = thin.where("size = 0").select(ROW, F.lit(0).alias("pass"), "size", F.lit(0).cast("long").alias("take"), F.lit(None).cast("long").alias("first_slot"))
    some = taken.select(ROW, "pass", "size", "take", "first_slot").unionByName(empty)
    some = written(some.toDF(ROW, "__pass", "__size", "__take", "__slot"), "takes")
    words = F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("__take").cast("int"))
    cut = F.when(F.col("__take") < F.col("__size"), F.array_join(words, " ")).otherwise(F.col("text"))
    return (
        base.join(some.hint("merge"), ROW).withColumn("text", cut).orderBy(F.col("__slot").asc_nulls_last(), ROW, "__pass")
        .select(*documents.columns)
    )
