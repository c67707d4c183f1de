"""What the operators of this package share: the shared folder, saved tables and word splitting."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Lower-cases A-Z and leaves every other byte as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: As LOWER; ASCII that is neither a digit nor a letter becomes a space. Bytes from 0x80 on belong to words.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or a temporary one where it is unset and
    everything runs in one process (tests). On a cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
        if not folder:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafmill-"))
            folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/leafmill/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor costs no work before it."""
    if path is None:
        path = new_path(df.sparkSession, what)
        _made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables that ``saved`` has made and nothing has removed yet.
_made: list[str] = []


def drop_all_saved(spark: SparkSession, but: int = 0) -> None:
    """Removes the tables that operators have saved in this process since the first ``but`` of them; for when their results
    have been written elsewhere, since what operators return reads these tables."""
    while len(_made) > but:
        drop_saved(spark, _made.pop())


def n_saved() -> int:
    return len(_made)


def drop_saved(spark: SparkSession, path: str) -> None:
    """Removes a saved table that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches, rows: int = 500):
    """Arrow batches in parts of at most so many rows, which bounds what a worker holds at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """A column name like name that is not taken."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
