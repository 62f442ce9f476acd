"""Following traces that are still being written."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """Events of the Parquet files that appear in a folder; each file is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def call_depths(events: DataFrame) -> DataFrame:
    """thread_id, geid, kind, depth, enclosing of each event, from a call stack that is kept per thread between batches.

    Bracket matching needs a whole prefix, which a streaming window does not have; the open calls of a thread are all it takes.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stack = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("geid")
        out = []
        for geid, kind in zip(rows["geid"], rows["kind"], strict=True):
            around = stack[-1] if stack else None
            if kind == "Call":
                stack.append(int(geid))
            elif kind == "Return" and stack:
                stack.pop()
            out.append((key[0], geid, kind, len(stack), around))
        state.update((stack,))
        yield pd.DataFrame(out, columns=["thread_id", "geid", "kind", "depth", "enclosing"]).astype({"enclosing": "Int64"})

    return events.select("thread_id", "geid", "kind").groupBy("thread_id").applyInPandasWithState(
        run, "thread_id long, geid long, kind string, depth long, enclosing long", "stack array<long>", "append", GroupStateTimeout.NoTimeout
    )


def event_rate(events: DataFrame, late: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """Events per kind and time window, final once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", span), "kind").agg(F.count(F.lit(1)).alias("n"))
