"""Shards of near-equal bytes by a k-d tree over the rows' metadata, in DataFrame operations only.

A node that stands for n shards is split where floor(n / 2) / n of its bytes lie below, along the dimension in which it
is widest. All nodes of a level are split together. A weighted median is found by histograms: each pass deals the rows
of every node into bins of its current interval, sums bytes per node and bin (at most ``n_shards * BINS`` sums reach the
driver, whatever the rows), and goes on in the bin that holds the median, until that bin weighs almost nothing.

Equal texts stay together: they are one point of the tree. Only a text whose rows are too large a part of a shard
(PART_OF_SHARD), in bytes or in number, is dealt by row. Points that agree in a dimension are ordered by a hash, so one hot source or
a document repeated a billion times is split like anything else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

BINS = 1024
#: A key has this many bits of the dimension above TIE_BITS of the row's hash.
DIM_BITS, TIE_BITS = 29, 32
#: A median is settled once its bin weighs less than this part of a shard.
TOLERANCE = 0.0005
#: A text is dealt by row if its rows weigh more than this part of a shard and more than the heaviest row, or are more in
#: number than this part of a shard and than MANY.
PART_OF_SHARD, MANY = 0.02, 1000


@dataclass
class Node:
    first: int
    shards: int
    dim: str = ""
    threshold: int = 0
    left: Node | None = None
    right: Node | None = None


def _leaf_of(node: Node, value) -> Column:
    """The expression that walks the tree; value gives a node's literal."""
    if node.left is None or node.right is None:
        return F.lit(value(node))
    return F.when(F.col(node.dim) < F.lit(node.threshold), _leaf_of(node.left, value)).otherwise(_leaf_of(node.right, value))


def _pending(node: Node) -> list[Node]:
    if node.left is None or node.right is None:
        return [node] if node.shards > 1 else []
    return _pending(node.left) + _pending(node.right)


def kd_tree(meta: DataFrame, dims: list[str], n_shards: int) -> Node:
    """The tree over meta: integer key columns ``dims`` and ``size``. Returns a root whose leaves are single shards."""
    root, spark = Node(0, n_shards), meta.sparkSession
    while todo := _pending(root):
        rows = meta.withColumn("_node", _leaf_of(root, lambda n: n.first if n.shards > 1 else -1)).filter("_node >= 0")
        wide = {r["_node"]: r for r in rows.groupBy("_node").agg(F.sum("size").alias("size"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        lo, hi, want, at = {}, {}, {}, {}
        for node in todo:
            r, n = wide.get(node.first), node.first
            node.dim = max(dims, key=lambda d: (r[f"hi_{d}"] >> TIE_BITS) - (r[f"lo_{d}"] >> TIE_BITS)) if r else dims[0]
            at[n] = dims.index(node.dim)
            lo[n], hi[n] = (r[f"lo_{node.dim}"], r[f"hi_{node.dim}"] + 1) if r else (0, 0)
            want[n] = (r["size"] if r else 0) * (node.shards // 2) / node.shards
        per_shard = max((r["size"] / n.shards for n in todo if (r := wide.get(n.first))), default=0)
        below, open_ = dict.fromkeys(lo, 0), set(wide)
        while open_:
            width = {n: max(1, -(-(hi[n] - lo[n]) // BINS)) for n in open_}
            bounds = spark.createDataFrame([(n, at[n], lo[n], hi[n], width[n]) for n in sorted(open_)], "_node int, _dim int, _lo long, _hi long, _width long")
            key = F.element_at(F.array(*dims), F.col("_dim") + 1)
            inside = rows.join(F.broadcast(bounds), "_node").select("_node", key.alias("_key"), "_lo", "_hi", "_width", "size").filter("_key >= _lo and _key < _hi")  # bounds: a row a node
            bins = inside.groupBy("_node", F.expr("(_key - _lo) div _width").alias("_bin")).agg(F.sum("size").alias("size")).collect()
            for n in list(open_):
                for b, size in sorted((r["_bin"], r["size"]) for r in bins if r["_node"] == n):
                    if below[n] + size >= want[n]:
                        lo[n], hi[n] = lo[n] + b * width[n], min(hi[n], lo[n] + (b + 1) * width[n])
                        # A settled median is put at the nearer end of its bin.
                        if width[n] == 1 or size <= TOLERANCE * per_shard:
                            if below[n] + size - want[n] <= want[n] - below[n]:
                                lo[n] = hi[n]
                            open_.discard(n)
                        break
                    below[n] += size
                else:
                    lo[n] = hi[n]
                    open_.discard(n)
        for node in todo:
            half = node.shards // 2
            node.threshold = lo[node.first]
            node.left, node.right = Node(node.first, half), Node(node.first + half, node.shards - half)
    return root


def kd_shards(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: shards of near-equal bytes, in which equal texts share a
    shard unless they are a large part of one. A null text has size 8 and the checksum of no bytes, 0. Null
    metadata sorts below all other. Repeated rows are rows of their own, each with a slot of its own. An empty table
    gives no rows. Columns other than doc_id, text, lang and source are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    have = set(docs.columns)
    label = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(1 << 20)) if c in have else F.lit(0)
    raw = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        label("lang").cast("double").alias("d_lang"),
        label("source").cast("double").alias("d_source"),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)).alias("d_id"),
        F.log2(F.octet_length(text) + F.lit(8.0)).alias("d_length"),
        F.monotonically_increasing_id().alias("_row"),
    )
    raw = saved(raw, "shard-meta")
    dims = ["d_lang", "d_source", "d_id", "d_length"]
    # Equal texts are one point of the tree, at the least of their labels, unless they are too large a part of a shard.
    # A text by two checksums and its size; at most 2 * n_shards / PART_OF_SHARD are too large, which bounds what is broadcast.
    same = ["text_hash", "text_crc32", "size"]
    groups = raw.groupBy(*same).agg(F.sum(F.col("size")).alias("_all"), F.count(F.lit(1)).alias("_n"), *[F.min(d).alias(d) for d in dims])
    total = raw.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("size").alias("most")).first()
    too_large = (F.col("_all") > max(total["most"] or 0, PART_OF_SHARD * (total["size"] or 0) / n_shards)) | (F.col("_n") > max(MANY, PART_OF_SHARD * total["n"] / n_shards))
    large = groups.filter(too_large).select(*same).withColumn("_large", F.lit(True))
    marked = raw.join(F.broadcast(large), same, "left")
    alone = marked.filter("_large").select("doc_id", *same, "_row", *dims, F.col("size").alias("weight"))
    points = groups.filter(~too_large).select(F.lit(None).cast("long").alias("doc_id"), *same, F.lit(None).cast("long").alias("_row"), *dims, F.col("_all").alias("weight"))
    points = saved(alone.unionByName(points), "shard-points")
    ends = points.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def key(d: str) -> Column:
        lo, hi = ends[f"lo_{d}"] or 0.0, ends[f"hi_{d}"] or 0.0
        part = (F.col(d) - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.lit(0.0)
        return (F.shiftleft(F.floor(part * F.lit(float((1 << DIM_BITS) - 1))).cast("long"), TIE_BITS) + F.col("_tie")).alias(d)

    tie = F.when(F.col("_row").isNull(), F.xxhash64(*same)).otherwise(F.xxhash64("doc_id", "_row"))
    points = points.withColumn("_tie", F.pmod(tie, F.lit(1 << TIE_BITS)))
    meta = saved(points.select("doc_id", *same, "_row", F.col("weight").alias("_bytes"), *[key(d) for d in dims]), "shard-keys")
    tree = kd_tree(meta.withColumn("size", F.col("_bytes")), dims, n_shards)
    at = meta.select(*same, "doc_id", "_row", _leaf_of(tree, lambda n: n.first).cast("int").alias("shard"))
    # Rows of a large text were points themselves; all others meet their group, which is small.
    few = marked.filter("_large is null").select("doc_id", *same, "_row").join(at.filter("_row is null").select(*same, "shard"), same)
    placed = few.unionByName(at.filter("_row is not null").select("doc_id", *same, "_row", "shard")).select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "_row"), F.lit(1 << TIE_BITS)).alias("_tie"))
    # The position in the whole order, from the partition (its high bits) and the row in it, gives slots without a window.
    ordered = placed.repartitionByRange("shard", "doc_id", "_tie").sortWithinPartitions("shard", "doc_id", "_tie")
    ordered = saved(ordered.withColumn("_at", F.monotonically_increasing_id()), "shards")
    part, shards = {}, dict.fromkeys(range(n_shards + 1), 0)
    for r in ordered.groupBy(F.shiftright("_at", 33).alias("part"), "shard").count().collect():
        part[r["part"]] = part.get(r["part"], 0) + r["count"]
        shards[r["shard"]] += r["count"]
    spark, at, offsets = docs.sparkSession, 0, []
    for p in sorted(part):
        offsets.append((p, at))
        at += part[p]
    begins, at = [], 0
    for s in range(n_shards):
        begins.append(at)
        at += shards[s]
    # One row for each partition of the sorted table, a number the session sets.
    offset = spark.createDataFrame(offsets, "part long, offset long")
    begin = F.element_at(F.array(*[F.lit(b).cast("long") for b in begins]), F.col("shard") + 1)
    return (
        ordered.withColumn("part", F.shiftright("_at", 33))
        .join(F.broadcast(offset), "part")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("_at").bitwiseAND((1 << 33) - 1) - begin).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Writes docs to ``path/shard=N``, each shard in slot order of documents. doc_id must be unique."""
    rows = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
