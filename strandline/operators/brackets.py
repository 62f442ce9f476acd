"""Bracket matching in runs: call trees, returns, dropped steps.

A trace usually has one thread, so a window over a thread would be one task. Rows are matched inside runs of consecutive geids instead; a
run's summary (its sum of brackets, its lowest level, the last opening of each level) carries what is open from one run to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators.positions import beside, with_run


def matched(events: DataFrame, opens: Column, closes: Column, *group: str) -> DataFrame:
    """`events` with `depth` (open brackets after the row, surplus closings ignored) and `enclosing` (geid of the innermost
    bracket around the row: of an opening row its parent, of a closing row the bracket it closes; null outside).

    A level is a sum of brackets that never falls below 0: after a run that begins at level d it is total + max(d, -lowest), so running
    sums and maxima over the summaries give the level at which each run begins. The latest opening at a row's level is the answer: of the
    row's own run if there is one, else of the last run before that has one.
    """
    keys = [*group, "__run"]
    inside = Window.partitionBy(*keys).orderBy("geid")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = with_run(events).withColumn("__d", F.when(opens, 1).when(closes, -1).otherwise(0).cast("long"))
    rows = rows.withColumn("__s", F.sum("__d").over(upto)).withColumn("__low", F.least(F.lit(0), F.min("__s").over(upto)))

    runs = rows.groupBy(*keys).agg(F.sum("__d").alias("__total"), F.min("__low").alias("__least"))
    before = Window.partitionBy(*group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__sum", F.coalesce(F.sum("__total").over(before), F.lit(0)))
    lowest = F.greatest(F.lit(0), F.coalesce(F.max(-F.col("__least") - F.col("__sum")).over(before), F.lit(0)))
    begins = runs.select(*keys, (F.col("__sum") + lowest).alias("__begin"))
    rows = beside(rows, begins, keys)
    rows = rows.withColumn("depth", F.col("__s") + F.greatest(F.col("__begin"), -F.col("__low")))
    previous = F.coalesce(F.lag("depth").over(inside), F.col("__begin"))
    rows = rows.withColumn("__level", F.when(F.col("__d") != 0, previous).otherwise(F.col("depth")))

    # an opening row answers for rows after it at its own depth and is itself asked about at the level above
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("__level").alias("level"), F.lit(None).cast("long").alias("open")),
        F.struct(F.lit(1).alias("side"), F.col("depth").alias("level"), F.col("geid").alias("open")),
    )
    both = rows.withColumn("__x", F.explode(F.when(F.col("__d") == 1, sides).otherwise(F.slice(sides, 1, 1))))
    both = both.withColumn("__at", F.col("__x.level"))
    latest = Window.partitionBy(*keys, "__at").orderBy("geid", "__x.side").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("__here", F.last("__x.open", ignorenulls=True).over(latest)).where(F.col("__x.side") == 0)

    # levels that were open when a run began: at most one row for each run, group and level
    spots = both.where("__at > 0").groupBy(*keys, "__at").agg(F.max("__x.open").alias("__open"))
    earlier = Window.partitionBy(*group, "__at").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.select(*keys, "__at", F.last("__open", ignorenulls=True).over(earlier).alias("__carried"))
    found = beside(found, carried, [*keys, "__at"])
    found = found.withColumn("enclosing", F.when(F.col("__at") > 0, F.coalesce("__here", "__carried")))
    return found.drop("__run", "__d", "__s", "__low", "__begin", "__level", "__x", "__at", "__here", "__carried")


def enclosing_calls(trace: DataFrame) -> DataFrame:
    return matched(trace, F.col("kind") == "Call", F.col("kind") == "Return", "thread_id")


def call_tree(trace: DataFrame) -> DataFrame:
    """One row a call: parent, return, depth from 0, steps and children directly inside."""
    rows = enclosing_calls(trace)
    calls = rows.where("kind = 'Call'").select(
        F.col("geid").alias("call_geid"), "thread_id", "function_id", F.col("enclosing").alias("parent_geid"), (F.col("depth") - 1).cast("long").alias("depth")
    )
    inner = rows.where("enclosing IS NOT NULL").groupBy(F.col("enclosing").alias("call_geid")).agg(
        F.min(F.when(F.col("kind") == "Return", F.col("geid"))).alias("exit_geid"),
        F.count(F.when(F.col("kind") == "Call", 1)).alias("children_count"),
        F.count(F.when(F.col("kind") == "Step", 1)).alias("own_steps"),
    )
    return calls.join(inner, "call_geid", "left").select(
        "call_geid", "thread_id", "function_id", "parent_geid", "depth", "exit_geid",
        F.coalesce("children_count", F.lit(0)).alias("children_count"), F.coalesce("own_steps", F.lit(0)).alias("own_steps"),
    )


def without_dropped_steps(trace: DataFrame, step: Column, drop: Column) -> DataFrame:
    """The steps that no later marker takes back; a marker takes the latest step that is left, of whatever thread or path."""
    rows = matched(trace.where(step | drop), step, drop)
    dropped = rows.where(drop & F.col("enclosing").isNotNull()).select(F.col("enclosing").alias("geid"))
    return trace.where(step).join(dropped, "geid", "left_anti")
