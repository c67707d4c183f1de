"""Commitment of records as they arrive. Records are independent, so a micro-batch is committed like a table; salts are
drawn and stored before anything uses them, and a batch that is run again finds what it stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.functions.paths import encode_path
from leafmill.operators import leaves


def commit_stream(records: DataFrame, typed: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, ordering: str = "path", once: bool = False) -> StreamingQuery:
    """records: a stream of record_id, identity columns and what ``typed`` needs to give leaves (record_id, path, tag,
    json_kind, literal). Writes out/leaves and out/roots, a folder for each batch, and keeps salts in out/salts."""

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        own = typed(rows)
        store = f"{out}/salts/batch={n}"
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/_SUCCESS")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            salts = spark.read.parquet(store)
        else:
            named = own.select("record_id", "path").unionByName(leaves.reserved_leaves(rows, ordering).select("record_id", "path"))
            keyed = named.select("record_id", encode_path(leaves.normal_path(F.col("path"))).alias("encoded_path"))
            salts = leaves.draw_salts(keyed, store, mode="overwrite")
        committed, roots = leaves.commit(rows, own, salts, ordering)
        committed.write.mode("overwrite").parquet(f"{out}/leaves/batch={n}")
        roots.write.mode("overwrite").parquet(f"{out}/roots/batch={n}")

    writer = records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
