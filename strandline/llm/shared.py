"""Scratch tables, defensive reads and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import importable_on_workers

#: ASCII white space, the word separator of every contract: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share, as `spark.checkpoint.dir` names it.

    A folder of our own is made only where the setting is absent and everything runs in one JVM.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strandline-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


_made = threading.local()


def written(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """`df` as a compressed Parquet table in the shared folder: cuts lineage, survives lost executors.

    Inside `scratch` it is deleted at the end, unless `keep`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandline-{tag}-{uuid.uuid4().hex}"
    if not keep and getattr(_made, "paths", None) is not None:
        _made.paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end: what is to last must be written with `keep` by then."""
    before, _made.paths = getattr(_made, "paths", None), []
    try:
        yield
    finally:
        done, _made.paths = _made.paths, before
        for path in done:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """A folder, in whatever file system it is."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable_on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns the input has; a null text counts as empty."""
    importable_on_workers(df.sparkSession)
    return df.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    importable_on_workers(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
