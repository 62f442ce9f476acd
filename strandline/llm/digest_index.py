"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the text. New data is reduced to one row per
digest (partial aggregation first, so that a digest with very many copies costs one row per task). Digests that the
index lacks are found by a sort-merge anti-join and appended with the document that stays; of digests that it has,
the number of new copies is appended. The index side of that join is never shuffled, and reading the index adds up
its rows without a shuffle. Only digests move: no text is shuffled.

`exact_groups` loads the upper half of the documents by doc_id, then adds the lower half to what is there: what was
loaded first stays, so the largest doc_id of equal texts does.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays (null
ids count as smallest; if all are null, the group's rows all report a null keep_id and none is kept, but `survivors` keeps one);
repeated rows with the same doc_id are both kept rows of their group; extra columns are ignored. With an index that
holds earlier documents, a digest that it has keeps the document that it has.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.shared import delete, scratch, shared_folder, shuffle_partitions, written

#: A digest that holds at least this share of all rows is joined by broadcast: there are at most 1000 such.
HOT_SHARE = 0.001


def digests(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("digest"))


class DigestIndex:
    """A bucketed, sorted table of (digest, keep_id, group_size); further rows of a digest have a null keep_id."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or shuffle_partitions(spark)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        """One row a digest."""
        return self.spark.table(self.name).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def append(self, rows: DataFrame) -> None:
        """Append groups (digest, keep_id, group_size); one file a bucket and call."""
        put = rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest")
        put = put.option("path", self.path) if self.path else put
        put.option("compression", "zstd").format("parquet").mode("append").saveAsTable(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest is not in the index yet."""
        if not self.exists():
            return groups
        return groups.join(self.spark.table(self.name).select("digest").hint("merge"), "digest", "left_anti")

    def add(self, hashed: DataFrame) -> None:
        """Dedupe (doc_id, digest) rows among themselves and against the index, and append what is new."""
        groups = hashed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        if not self.exists():
            self.append(groups)
            return
        with scratch(self.spark):  # an append must not read the table that it writes
            groups = written(groups, "digests")
            new = self.unseen(groups)
            seen = groups.join(self.spark.table(self.name).select("digest").distinct().hint("merge"), "digest", "left_semi")
            self.append(written(new.unionByName(seen.withColumn("keep_id", F.lit(None).cast("long"))), "new"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if self.path:
            delete(self.spark, self.path)


def fresh_index(spark: SparkSession) -> DigestIndex:
    name = f"strandline_digests_{uuid.uuid4().hex}"
    return DigestIndex(spark, name, path=f"{shared_folder(spark)}/{name}")


def resolve(hashed: DataFrame, known: DataFrame) -> DataFrame:
    """Every (doc_id, digest) row with the keep_id and group_size that `known` has for its digest.

    Digests of at least HOT_SHARE of the rows are broadcast (at most 1 / HOT_SHARE rows, by counting); the
    rest meet in a merge join in which no key holds more than that share.
    """
    total = known.agg(F.sum("group_size")).first()[0] or 0
    hot = [r[0] for r in known.where(F.col("group_size") >= max(1000, HOT_SHARE * total)).select("digest").collect()]
    if not hot:
        return hashed.join(known.hint("merge"), "digest")
    is_hot = F.col("digest").isin(hot)
    return (
        hashed.where(~is_hot).join(known.where(~is_hot).hint("merge"), "digest")
        .unionByName(hashed.where(is_hot).join(F.broadcast(known.where(is_hot)), "digest"))
    )


def exact_groups(documents: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; without an index one is made and dropped."""
    spark = documents.sparkSession
    held = index or fresh_index(spark)
    hashed = written(digests(documents), "hashed")
    middle = hashed.agg(F.percentile_approx("doc_id", 0.5, 1000)).first()[0]
    upper = F.coalesce(F.col("doc_id") >= F.lit(middle), F.lit(False))
    held.add(hashed.where(upper))
    held.add(hashed.where(~upper))
    known = held.read()
    if index is None:
        known = written(known, "known")
        held.drop()
    return resolve(hashed, known).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def survivors(documents: DataFrame) -> DataFrame:
    """The rows of `documents` that stay, with all their columns: one for each different text.

    Which rows go is settled on digests alone; repeated rows of one doc_id and text stay together. Where all
    ids of a text are null, any one of its rows stays; partial aggregation leaves one a task.
    """
    groups = exact_groups(documents)
    # a row with a null id never stays beside a row with an id, and null ids alone are settled below
    dropped = groups.where(~F.col("kept") & F.col("keep_id").isNotNull())
    dropped = dropped.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest")).distinct()
    hashed = documents.withColumn("__sha", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__digest"))
    left = hashed.where("doc_id IS NOT NULL").join(dropped, same, "left_anti").select(*documents.columns)
    nameless = hashed.where("doc_id IS NULL").join(dropped, same, "left_anti")
    one = nameless.groupBy("__sha").agg(F.any_value(F.struct(*documents.columns)).alias("__row"))
    return left.unionByName(one.select("__row.*"))
