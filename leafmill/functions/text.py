"""Normalization of text. Spark has no NFC, and a JVM's Unicode version varies: Python's tables are pinned instead."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNICODE = "15.1.0"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(s: Column, any_text: bool = True) -> Column:
    """The NFC form. ASCII, which is normal as it is, doesn't reach Python's normalizer; any_text=False promises ASCII."""
    if not any_text:
        return s
    ascii_only = s.rlike(r"\A[\x00-\x7F]*\z")
    return F.when(ascii_only, s).otherwise(_nfc(F.when(~ascii_only, s)))


def unicode_versions(spark: SparkSession) -> DataFrame:
    """The Unicode version of every executor's Python, one row each, and whether it is the pinned one."""

    @F.pandas_udf("string")
    def version(n: pd.Series) -> pd.Series:
        return pd.Series([unicodedata.unidata_version] * len(n))

    n = spark.sparkContext.defaultParallelism
    return spark.range(0, n, 1, n).select(version("id").alias("version")).distinct().withColumn("pinned", F.col("version") == UNICODE)
