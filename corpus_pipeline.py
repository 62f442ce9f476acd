"""A training corpus from `documents`, in five stages, each written as Parquet and read again by the next.

Any column may hold nulls, rows may repeat, tables may be empty, and extra columns, whatever their names, come along
until the last stage, which gives doc_id, n_tokens, ids_sha256 and decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import byte_pieces, digest_index, near_copies, source_mix, toxicity
from strandline.llm.queries import _pattern, _tokenizer
from strandline.llm.shared import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score of 0.5 or more) go; null texts are scored as empty ones."""
    model = toxicity.train(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return docs.where(toxicity.score_of(model)(F.coalesce(F.col("text"), F.lit(""))) < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty) the row with the largest doc_id stays; rows that repeat it stay, of rows without ids one."""
    return digest_index.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) the document with the smallest doc_id stays; without ids all do."""
    return near_copies.survivors(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for every pass that takes it, in the order of the mix; the one that a target cuts is shortened."""
    return source_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, per document."""
    return byte_pieces.round_trip(docs, _tokenizer("byte_bpe_multi_50k.tiktoken"), _pattern())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The classifier and the tokenizer have no SQL form; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
