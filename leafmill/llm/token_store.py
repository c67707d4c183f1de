"""A content-addressed store of token ids.

A rolling sum of hashed ids over ``ROLL`` ids cuts each document's ids where its mixed bits are zero, so equal passages
are cut alike wherever they stand. Layout of a store, all Parquet under one path:

* ``chunks``: digest (BLAKE2b, 16 bytes, of the payload), payload (ids as little-endian unsigned 16 or 32 bits); once each
* ``recipes``: documents in ascending doc_id order - part and at (place in the order), doc_id, local_start, n_tokens,
  digests in order, and the Merkle root over them
* ``manifest``: for each part its documents, ids and the Merkle root over its documents' roots

Reading takes each chunk once, checks its digest against its bytes, checks every document's Merkle root over the digests
found, and computes a document's CRC-32 from its chunks' by the polynomial identity crc(A|B) = shift(crc(A), |B|) xor
crc(B); ids themselves move only if asked for (``read_ids``).
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe
from .common import drop_saved, new_path, slices

ROLL, MEAN_BITS, SHORTEST, LONGEST = 16, 8, 64, 2048


def cuts(ids: np.ndarray) -> list[int]:
    """The ends of the chunks of ids."""
    n = len(ids)
    if n <= SHORTEST:
        return [n] if n else []
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total = np.cumsum(mixed ^ (mixed >> np.uint64(29)), dtype=np.uint64)
    rolled = total.copy()
    rolled[ROLL:] -= total[:-ROLL]
    rolled *= np.uint64(0xD6E8FEB86659FD93)
    out, last = [], 0
    for i in (np.flatnonzero(rolled >> np.uint64(64 - MEAN_BITS) == 0) + 1).tolist():
        if i < last + SHORTEST:
            continue
        while i - last > LONGEST:
            last += LONGEST
            out.append(last)
        if i - last >= SHORTEST:
            out.append(i)
            last = i
    while n - last > LONGEST:
        last += LONGEST
        out.append(last)
    return [*out, n] if n > last else out


def values(column: pa.Array) -> list:
    """Those of a column without nulls, which is faster this way than one by one."""
    return column.to_numpy(zero_copy_only=False).tolist()


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over leaves, pairwise, an odd node moving up; the root of nothing is the digest of nothing."""
    level = [digest(b"\0" + x) for x in leaves]
    while len(level) > 1:
        level = [digest(b"\1" + a + b) if b else a for a, b in itertools.zip_longest(level[::2], level[1::2], fillvalue=b"")]
    return level[0] if level else digest(b"")


@functools.lru_cache(4096)
def _shift(n: int) -> tuple[list[int], ...]:
    """Tables, one for each byte of a CRC-32, of what n zero bytes after it make of it."""
    columns = [zlib.crc32(bytes(n), 1 << k ^ 0xFFFFFFFF) ^ 0xFFFFFFFF ^ 0 for k in range(32)]
    base = zlib.crc32(bytes(n), 0xFFFFFFFF) ^ 0xFFFFFFFF
    columns = [c ^ base for c in columns]
    tables = []
    for byte in range(4):
        t = [0] * 256
        for v in range(1, 256):
            low = v & -v
            t[v] = t[v ^ low] ^ columns[8 * byte + low.bit_length() - 1]
        tables.append(t)
    return tuple(tables)


def crc_join(a: int, b: int, bytes_b: int) -> int:
    """The CRC-32 of A|B from those of A and B."""
    t = _shift(bytes_b)
    return t[0][a & 255] ^ t[1][a >> 8 & 255] ^ t[2][a >> 16 & 255] ^ t[3][a >> 24] ^ b


_STAGE = "doc_id long, n_tokens long, digests array<binary>, root binary, new array<struct<digest:binary,payload:binary>>"


def _encoded(docs: DataFrame, path: str, end_id: int, width: int) -> DataFrame:
    """Per document its recipe, and the chunks that its task has not met before."""

    def lists(ends: list[int], values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values)

    def encode(batches):
        enc, met = byte_bpe.encoder(path), set()
        for batch in slices(batches, 1000):
            n, digests, ends, roots, new, payloads, new_ends = [], [], [], [], [], [], []
            for ids in enc.encode(batch.column(1).fill_null("").to_pylist()):
                ids = np.append(ids, np.uint32(end_id))
                data, own, last = ids.astype(f"<u{width}").tobytes(), [], 0
                for end in cuts(ids):
                    payload = data[last * width : end * width]
                    last = end
                    own.append(d := digest(payload))
                    if d not in met:
                        if len(met) < 200_000:
                            met.add(d)
                        new.append(d)
                        payloads.append(payload)
                n.append(len(ids))
                digests += own
                ends.append(len(digests))
                roots.append(merkle(own))
                new_ends.append(len(new))
            chunks = pa.StructArray.from_arrays([pa.array(new, pa.binary()), pa.array(payloads, pa.binary())], ["digest", "payload"])
            columns = {"n_tokens": pa.array(n, pa.int64()), "digests": lists(ends, pa.array(digests, pa.binary())), "root": pa.array(roots, pa.binary()), "new": lists(new_ends, chunks)}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, _STAGE)


def write(docs: DataFrame, tokenizer: str, store: str, end_id: int = 2, width: int = 2) -> None:
    """Encodes docs and writes a store. width: bytes of an id, 2 while the vocabulary has at most 65,536 ids, else 4.

    A null text is empty: its ids are the end id alone. Documents without doc_id come first; documents of equal doc_id
    all stay, in an order that is fixed once written. An empty table gives an empty store.
    """
    spark, staged = docs.sparkSession, f"{store}/_stage"
    _encoded(docs, tokenizer, end_id, width).write.option("compression", "zstd").parquet(staged)
    stage = spark.read.parquet(staged)
    chunks = stage.select(F.explode("new").alias("c")).select("c.*").groupBy("digest").agg(F.first("payload").alias("payload"))
    chunks.write.option("compression", "zstd").parquet(f"{store}/chunks")

    def place(batches):
        part, at, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = start + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int64()), pa.array(np.arange(at, at + len(n))), batch.column(0), pa.array(ends - n, pa.int64()), *batch.columns[1:]], names=["part", "at", "doc_id", "local_start", "n_tokens", "digests", "root"])
            at, start = at + len(n), int(ends[-1]) if len(n) else start

    ordered = stage.select("doc_id", "n_tokens", "digests", "root").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    ordered.mapInArrow(place, "part long, at long, doc_id long, local_start long, n_tokens long, digests array<binary>, root binary").write.option("compression", "zstd").parquet(f"{store}/recipes")

    _sealed(spark.read.parquet(f"{store}/recipes")).write.parquet(f"{store}/manifest")
    drop_saved(spark, staged)


def _sealed(recipes: DataFrame) -> DataFrame:
    """One row for each part of the recipes: documents, ids and the Merkle root over the documents' roots in order."""

    def seal(batches):
        now, roots, ids = None, [], 0
        for batch in batches:
            for part, n, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and now is not None:
                    yield pa.RecordBatch.from_pylist([{"part": now, "n_docs": len(roots), "n_tokens": ids, "root": merkle(roots)}])
                    roots, ids = [], 0
                now = part
                roots.append(root)
                ids += n
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"part": now, "n_docs": len(roots), "n_tokens": ids, "root": merkle(roots)}])

    rows = recipes.select("part", "n_tokens", "root", "at").repartition("part").sortWithinPartitions("part", "at").drop("at")
    return rows.mapInArrow(seal, "part long, n_docs long, n_tokens long, root binary")


def _chunk_facts(spark: SparkSession, store: str, width: int) -> DataFrame:
    """From the stored bytes of each chunk: digest, ids, CRC-32 of the ids as 32-bit integers. A damaged chunk fails."""

    def facts(batches):
        for batch in batches:
            payloads = values(batch.column(1))
            for d, payload in zip(values(batch.column(0)), payloads, strict=True):
                if digest(payload) != d:
                    raise ValueError(f"chunk {d.hex()} doesn't have its digest")
            wide = memoryview(np.frombuffer(b"".join(payloads), f"<u{width}").astype("<u4").view(np.uint8))
            n = [len(payload) // width for payload in payloads]
            crcs = [zlib.crc32(wide[4 * (end - k) : 4 * end]) for k, end in zip(n, itertools.accumulate(n), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])

    return spark.read.parquet(f"{store}/chunks").select("digest", "payload").mapInArrow(facts, "digest binary, n long, crc long")


def verify(spark: SparkSession, store: str, width: int = 2) -> DataFrame:
    """Reads a store back: doc_id, start, n_tokens, ids_crc32, verified: lengths and Merkle roots agree, those of the
    document and those of its part with the manifest, so a lost, repeated or exchanged recipe shows in its whole part."""
    recipes = spark.read.parquet(f"{store}/recipes")
    uses = recipes.select("part", "at", F.posexplode("digests").alias("pos", "digest"))
    found = uses.join(_chunk_facts(spark, store, width), "digest").groupBy("part", "at").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "crc", "digest"))).alias("chunks"))
    manifest = spark.read.parquet(f"{store}/manifest")
    totals = manifest.select("part", "n_tokens").orderBy("part").collect()  # one row a partition
    same = {r["part"] for r in manifest.join(_sealed(recipes), ["part", "n_docs", "n_tokens", "root"]).select("part").collect()}
    offsets = [(r["part"], o - r["n_tokens"], r["part"] in same) for r, o in zip(totals, itertools.accumulate(r["n_tokens"] for r in totals), strict=True)]
    docs = recipes.select("part", "at", "doc_id", "local_start", "n_tokens", "root").join(found, ["part", "at"], "left").join(F.broadcast(spark.createDataFrame(offsets, "part long, offset long, sealed boolean")), "part")

    def check(batches):
        for batch in batches:
            flat = batch.column(4).flatten()
            lengths, parts, digests = (values(pc.struct_field(flat, x)) for x in ("n", "crc", "digest"))
            crcs, good, last = [], [], 0
            for n, root, many, sealed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), pc.list_value_length(batch.column(4)).to_pylist(), batch.column(5).to_pylist(), strict=True):
                end, crc = last + (many or 0), 0
                for c, k in zip(parts[last:end], lengths[last:end], strict=True):
                    crc = crc_join(crc, c, 4 * k)
                crcs.append(crc)
                good.append(sealed and sum(lengths[last:end]) == n and merkle(digests[last:end]) == root)
                last = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crcs, pa.int64()), pa.array(good, pa.bool_())], names=["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    return docs.select("doc_id", (F.col("local_start") + F.col("offset")).alias("start"), "n_tokens", "root", "chunks", "sealed").mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")


def read_ids(spark: SparkSession, store: str, width: int = 2) -> DataFrame:
    """doc_id and ids (array of long) of every document, put together from its chunks."""
    recipes = spark.read.parquet(f"{store}/recipes")
    uses = recipes.select("part", "at", "doc_id", F.posexplode("digests").alias("pos", "digest")).join(spark.read.parquet(f"{store}/chunks"), "digest")
    whole = uses.groupBy("part", "at").agg(F.first("doc_id").alias("doc_id"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "payload"))), lambda c: c["payload"]).alias("payloads"))

    def join(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(p), f"<u{width}").astype(np.int64) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return whole.select("doc_id", "payloads").mapInArrow(join, "doc_id long, ids array<long>")


def store_and_verify(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes docs to a new store in the shared folder and reads it back (see ``verify``)."""
    store = new_path(docs.sparkSession, "tokens")
    write(docs, tokenizer, store, end_id)
    return verify(docs.sparkSession, store)
