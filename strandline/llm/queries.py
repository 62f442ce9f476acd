"""The queries opN_<name> of this subpackage, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import (
    backoff_scores, byte_pieces, digest_index, mixed_coder, near_copies, personal_data, secret_links, source_mix, toxicity, vantage_trees,
)
from strandline.llm.shared import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff_scores.scores(table(spark, sf_dir, "documents"))
    return found.withColumn("score", F.round("score", 6))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_components(table(spark, sf_dir, "documents"))


def op4_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.digest(secret_links.scan(table(spark, sf_dir, "documents")))


def op5_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.exact_groups(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).drop("skey")


def op7_byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pieces.round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), _pattern())


def op8_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage_trees.nearest(table(spark, sf_dir, "embeddings"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.find(table(spark, sf_dir, "documents")))


def op10_mixed_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = mixed_coder.write_ids(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _pattern())
    return mixed_coder.read_digests(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_backoff_scores, op2_toxicity, op3_near_copies, op4_secret_links, op5_digest_index, op6_source_mix, op7_byte_pieces,
            op8_vantage_trees, op9_personal_data, op10_mixed_coder,
        )
    }
