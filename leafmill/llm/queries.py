"""The queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, language, mixing, near_dup, pieces, pii, quality, sharding, token_store, top_k
from .common import read


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; only queries look it up, operators take the path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_verify(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), near_dup.CONTRACT)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(read(spark, sf_dir, "documents"), 24)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model, counts = mixing.fit(docs)
    return mixing.score(docs, model, counts)


#: Toxic documents are rated lowest, then poor ones, then good ones.
GRADE = "case when toxic = 1 then 0 when quality = 0 then 1 when quality = 1 then 2 end"


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    ratings = read(spark, sf_dir, "labels").select("doc_id", F.expr(GRADE).alias("grade"))
    return quality.grade(docs, quality.fit(quality.sample(docs, ratings), 3))


#: A stand-in: a real run takes its key from a secret store.
PII_KEY = "key of the registered queries"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, "n_replaced")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(language.sample(docs)))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op4_near_duplicates": op4_near_duplicates,
    "op6_sharding": op6_sharding,
    "op10_decontamination": op10_decontamination,
    "op7_top_k": op7_top_k,
    "op9_pii": op9_pii,
    "op2_language": op2_language,
    "op5_sentencepiece": op5_sentencepiece,
    "op8_language_model": op8_language_model,
    "op3_quality": op3_quality,
}

ORACLES: dict[str, str] = {}
