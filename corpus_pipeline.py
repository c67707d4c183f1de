"""A corpus from raw documents: five stages, each over all that the one before it kept.

Each function takes (spark, docs, sf_dir) and returns the next stage's documents; the last returns the encoded corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontam, language, near_dup, pieces, pii
from leafmill.llm.common import drop_all_saved, n_saved, new_path, read, saved
from leafmill.llm.queries import PII_KEY, tokenizer_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those unlike every language learnt: about 1 in 1,000 of those in a learnt language
    (language.FALSE_REJECTION). Null and empty texts go; a row that is there twice is judged twice alike."""
    return language.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id: five-word shingles, a similarity of
    0.8. Documents without words stay; of rows with equal doc_id and text one stays; rows without doc_id all stay."""
    return near_dup.one_of_each(docs, near_dup.CORPUS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by pseudonyms of their format; n_chars follows the text. A null text stays."""
    out = pii.pseudonymise(docs, PII_KEY)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, ids_crc32 and exact (the ids decode to the text). A null or empty text has no ids."""
    return pieces.round_trip(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", encoded),
]

#: No SQL: models, Feistel networks and pieces are beyond it. tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = n_saved()
        docs = saved(stage(spark, docs, sf_dir), name, new_path(spark, f"stage-{name.split()[0].lower()}"))
        # The stage's own tables have served.
        drop_all_saved(spark, before)
    return docs
