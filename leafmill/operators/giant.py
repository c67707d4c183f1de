"""The root over a whole table of leaves, by blocks.

Leaves are dealt to partitions by range of their order and numbered from the partitions' counts, not by a window over
everything. An aligned block of 2^k leaves is a subtree of the tree, so each round replaces blocks by their roots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import merkle

BLOCK = 1 << 10


def table_root(leaves: DataFrame, order: list[str], work: str) -> DataFrame:
    """One row, leaf_count and root, of leaves (leaf_hash and the columns of order, unique together). work: a folder that
    all executors see."""
    spark = leaves.sparkSession
    dealt = leaves.select("leaf_hash", *order).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("leaf_hash", F.monotonically_increasing_id().alias("at")).write.parquet(f"{work}/ordered")
    rows = spark.read.parquet(f"{work}/ordered").withColumn("part", F.shiftright("at", 33))
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    # One row for each partition of the ordered table.
    offset = F.broadcast(spark.createDataFrame(offsets, "part long, offset long"))
    level = rows.join(offset, "part").select((F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("i"), F.col("leaf_hash").alias("h"))
    n, k = total, 0
    while n > 1:
        blocks = level.groupBy(F.floor(F.col("i") / BLOCK).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("b"))
        level = blocks.select("i", merkle.root(F.transform("b", lambda x: x["h"])).alias("h"))
        n, k = -(-n // BLOCK), k + 1
        level.write.parquet(f"{work}/level-{k}")
        level = spark.read.parquet(f"{work}/level-{k}")
    if total == 0:
        return spark.range(1).select(F.lit(0).cast("bigint").alias("leaf_count"), merkle.sha256(F.lit(bytearray(b""))).alias("root"))
    return level.select(F.lit(total).cast("bigint").alias("leaf_count"), F.col("h").alias("root"))
