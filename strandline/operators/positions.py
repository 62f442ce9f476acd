"""Positions, running totals and latest values in global order without a global window.

Rows fall into runs of `RUN` consecutive geids. Windows work inside runs (and groups, if any); summaries of the runs, one row for each run
and group, carry what comes from before. So no task sees more than a run of a group, whatever the length of the trace or of a thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RUN = 1 << 16


def with_run(df: DataFrame, order: str = "geid") -> DataFrame:
    return df.withColumn("__run", F.floor(F.col(order) / RUN))


def beside(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """`df` with the columns of the row of `other` that has the same keys, nulls included; `other` has them all."""
    named = other.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c for c in other.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return df.join(named, same, "left").drop(*(f"__k{i}" for i in range(len(keys))))


def running(df: DataFrame, value: Column, name: str, order: str = "geid", group: tuple[str, ...] = ()) -> DataFrame:
    """`df` with the sum of `value` over all rows (of the group) before each row, in the order of a whole-number column."""
    keys = [*group, "__run"]
    keyed = with_run(df, order).withColumn("__v", value.cast("long"))
    before = Window.partitionBy(*group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(*keys).agg(F.sum("__v").alias("__total"))
    offsets = sums.select(*keys, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        beside(keyed.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0))), offsets, keys)
        .withColumn(name, (F.col("__in") + F.col("__offset")).cast("long")).drop("__v", "__run", "__in", "__offset")
    )


def ordinals(df: DataFrame, name: str, order: str = "geid", group: tuple[str, ...] = ()) -> DataFrame:
    """`df` with its dense position from 0, in each group if there are any."""
    return running(df, F.lit(1), name, order, group)


def latest(df: DataFrame, value: Column, name: str, order: str = "geid", group: tuple[str, ...] = (), itself: bool = True) -> DataFrame:
    """`df` with the last `value` that is not null up to each row (of the group); with `itself` false, before it."""
    return _carried(df, value, name, order, group, itself, forward=True)


def following(df: DataFrame, value: Column, name: str, order: str = "geid", group: tuple[str, ...] = ()) -> DataFrame:
    """`df` with the first `value` that is not null after each row (of the group)."""
    return _carried(df, value, name, order, group, itself=False, forward=False)


def _carried(df: DataFrame, value: Column, name: str, order: str, group: tuple[str, ...], itself: bool, forward: bool) -> DataFrame:
    keys, way = [*group, "__run"], (lambda c: F.col(c)) if forward else (lambda c: F.col(c).desc())
    keyed = with_run(df, order).withColumn("__v", value)
    pick, at = (F.max_by, F.col(order)) if forward else (F.min_by, F.col(order))
    ends = keyed.where("__v IS NOT NULL").groupBy(*keys).agg(pick("__v", at).alias("__end"))
    runs = keyed.select(*keys).distinct()
    over_runs = Window.partitionBy(*group).orderBy(way("__run")).rowsBetween(Window.unboundedPreceding, -1)
    carried = beside(runs, ends, keys).select(*keys, F.last("__end", ignorenulls=True).over(over_runs).alias("__carried"))
    inside = Window.partitionBy(*keys).orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    return (
        beside(keyed.withColumn("__in", F.last("__v", ignorenulls=True).over(inside)), carried, keys)
        .withColumn(name, F.coalesce("__in", "__carried")).drop("__v", "__run", "__in", "__carried")
    )
