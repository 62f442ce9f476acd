"""Reachability over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.scratch import checkpointed


def reachable(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """All (a, b) with a path from a to b. Lengths double each round, until a round adds nothing; each round cuts the lineage."""
    reach = checkpointed(edges.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct())
    n = reach.count()
    while True:
        longer = reach.join(reach.select(F.col(a).alias(b), F.col(b).alias("__c")), b).select(a, F.col("__c").alias(b))
        reach = checkpointed(reach.unionByName(longer).distinct())
        before, n = n, reach.count()
        if n == before:
            return reach
