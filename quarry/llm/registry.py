"""The queries of this subpackage, bound to the test tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import approximate_neighbours, jaccard_join, packing, piece_encoding, quality_classifier, tool_calls, toxicity
from quarry.llm.common import documents
from quarry.llm.document_fingerprints import edited_fingerprints
from quarry.llm.secret_scans import digest, find_secrets
from quarry.llm.token_counts import token_counts


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = piece_encoding.vocabulary(vocabulary("piece_bpe_32k.model"))
    return piece_encoding.encode_digest(documents(spark, sf_dir), pieces)


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.conversation_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.words(documents(spark, sf_dir)))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(documents(spark, sf_dir)))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_classifier.score(docs, quality_classifier.fit(docs, labels(spark, sf_dir)))


def op10_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = approximate_neighbours.index(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return approximate_neighbours.nearest(indexed, indexed.rows.where("vec_id % 50 = 0"), 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda kf: int(kf[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op2_tool_calls": tool_calls.ORACLE, "op3_packing": packing.oracle(), "op6_jaccard_join": jaccard_join.ORACLE, "op10_approximate_neighbours": approximate_neighbours.ORACLE}
