"""Benchmark decontamination by a prefix-filtered set join.

Every item is cut into windows of ten consecutive words (a shorter item is one window). A document contains a window
only if it contains all of the window's shingles, so one necessary shingle a window is enough to find it: the rarest,
counted over all documents. Those prefix shingles are looked up in the documents; the place of the shingle in its
window bounds where the window would begin and end; the words there are then compared one by one.

Words are numbered by the items' vocabulary, so shingle keys are exact and nothing is decided by a hash. The items are
sent out in blocks of at most ``block_windows`` windows; more items mean more blocks, each a pass over the documents.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, saved, slices, utf8

WINDOW = 10
SHINGLE = 3
#: At most two million words, so that three of their numbers fit 64 bits.
BLOCK_WINDOWS = 200_000

_RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM).split() if text else []


class Block:
    """A bounded part of the windows, ready for look-ups."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: list[np.ndarray] = []
        self.items: list[list[str]] = []
        for window, items in windows.items():
            self.windows.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window], np.int64))
            self.items.append(sorted(items))
        self.base = np.int64(len(self.vocabulary) + 1)
        self.keys = np.empty(0, np.int64)
        self.places: list[list[tuple[int, int]]] = []

    def shingles(self, window: np.ndarray) -> np.ndarray:
        """Keys of the window's shingles, in order. A window of fewer words than a shingle has is padded with 0s, no word's number."""
        if len(window) < SHINGLE:
            return np.array([self.short_key(window)])
        return (window[:-2] * self.base + window[1:-1]) * self.base + window[2:]

    def short_key(self, window: np.ndarray) -> int:
        key = 0
        for w in window:
            key = key * int(self.base) + int(w)
        return key

    def all_keys(self) -> np.ndarray:
        return np.unique(np.concatenate([self.shingles(w) for w in self.windows])) if self.windows else np.empty(0, np.int64)

    def choose(self, count: dict[int, int]) -> None:
        """Takes each window's rarest shingle as its prefix."""
        prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, w in enumerate(self.windows):
            keys = self.shingles(w).tolist()
            at = min(range(len(keys)), key=lambda i: (count.get(keys[i], 0), keys[i], i))
            prefix[keys[at]].append((n, at))
        self.keys = np.array(sorted(prefix), np.int64)
        self.places = [prefix[k] for k in self.keys.tolist()]
        self.shortest = min(map(len, self.windows), default=0)

    def numbered(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers of all texts, with 0 for unknown words and between texts, and where each text begins."""
        get, ids, begins = self.vocabulary.get, [0], [1]
        for text in texts:
            ids.extend([get(w, 0) for w in words(text)])
            ids.append(0)
            begins.append(len(ids))
        ids.append(0)
        return np.array(ids, np.int64), np.array(begins, np.int64)

    def keys_at(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, keys) of all shingles of known words; those of one and two words only if windows that short exist."""
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        at = np.flatnonzero((a != 0) & (b != 0) & (c != 0))
        found = [(at, (a[at] * self.base + b[at]) * self.base + c[at])]
        if self.shortest == 1:
            at = np.flatnonzero(a)
            found.append((at, a[at]))
        if self.shortest <= 2:
            at = np.flatnonzero((a != 0) & (b != 0))
            found.append((at, a[at] * self.base + b[at]))
        return found

    def counts(self, texts: list[bytes | None], keys: np.ndarray, into: np.ndarray) -> None:
        ids, _ = self.numbered(texts)
        for _, found in self.keys_at(ids):
            i = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            into += np.bincount(i[keys[i] == found], minlength=len(keys))

    def hits(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
        """Words of each text, and for each the (begin, end, window) of what occurs in it."""
        ids, begins = self.numbered(texts)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if len(self.keys):
            for at, found in self.keys_at(ids):
                i = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
                ok = self.keys[i] == found
                at, i = at[ok], i[ok]
                doc = np.searchsorted(begins, at, side="right") - 1
                for p, k, d in zip(at.tolist(), i.tolist(), doc.tolist(), strict=True):
                    first, last = int(begins[d]), int(begins[d + 1]) - 1
                    for n, offset in self.places[k]:
                        w = self.windows[n]
                        start = p - offset
                        if start >= first and start + len(w) <= last and np.array_equal(ids[start : start + len(w)], w):
                            out[d].append((start - first, start - first + len(w), n))
        return np.diff(begins) - 1, out


def blocks(benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> Iterator[Block]:
    """The windows of all items, in blocks of bounded size, one after another. Items without id or words have none."""

    def cut(batches):
        for batch in batches:
            rows: dict[str, list] = {"item": [], "window": []}
            for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                w = words(text)
                for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
                    rows["item"].append(item)
                    rows["window"].append(b" ".join(w[i : i + WINDOW]))
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("item", pa.string()), ("window", pa.binary())]))

    table = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    windows = saved(table.mapInArrow(cut, "item string, window binary").distinct(), "windows")
    n = -(-windows.count() // block_windows)
    for b in range(n):
        part: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        # The driver holds one block at a time, however many items there are.
        for r in windows.filter(F.pmod(F.xxhash64("window"), F.lit(n)) == b).toLocalIterator():
            part[tuple(bytes(r["window"]).split(b" "))].add(r["item"])
        yield Block(part)


def _count(docs: DataFrame, block: Block) -> dict[int, int]:
    """How often each of the block's shingles occurs in all documents."""
    keys = block.all_keys()
    block.shortest = min(map(len, block.windows), default=0)
    sent = docs.sparkSession.sparkContext.broadcast((block, keys))

    def count(batches):
        block, keys = sent.value
        total = np.zeros(len(keys), np.int64)
        for batch in slices(batches):
            block.counts(utf8(batch.column(0)), keys, total)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i), "n": pa.array(total[i])})

    rows = docs.select("text").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    return {int(keys[r["i"]]): r["n"] for r in rows}


def prepared(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> list[Broadcast]:
    """Blocks whose windows have the prefixes that are rarest in docs, as broadcasts: Spark keeps them on disk, the driver
    only their names."""
    out = []
    for b in blocks(benchmark, block_windows):
        b.choose(_count(docs, b))
        out.append(docs.sparkSession.sparkContext.broadcast(b))
    return out


_HITS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("items", pa.list_(pa.string()))]))


def spans(docs: DataFrame, prepared_blocks: list[Broadcast]) -> DataFrame:
    """docs' doc_id and text with ``hits``: (begin, end, items) for each window that occurs, in words from 0. A null text has none."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("hits", F.expr("cast(array() as array<struct<begin:bigint,end:bigint,items:array<string>>>)")).withColumn("n_words", F.lit(0).cast("long"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("hits", _HITS), ("n_words", pa.int64())])
    for k, sent in enumerate(prepared_blocks or [docs.sparkSession.sparkContext.broadcast(Block({}))]):

        def find(batches, sent=sent):
            block = sent.value
            for batch in slices(batches):
                n, found = block.hits(utf8(batch.column(1)))
                before = batch.column(2).to_pylist()
                hits = [old + [{"begin": b, "end": e, "items": block.items[w]} for b, e, w in new] for old, new in zip(before, found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, _HITS), pa.array(n, pa.int64())], schema=schema)

        df = saved(df, "spans") if k else df
        df = df.mapInArrow(find, "doc_id long, text string, hits array<struct<begin:bigint,end:bigint,items:array<string>>>, n_words long")
    return df


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and is clean; a null doc_id stays null; repeated rows give repeated results; an
    empty benchmark leaves all documents clean; other columns of docs are not looked at.
    """

    def digest(batches):
        for batch in batches:
            rows: dict[str, list] = {"n_hit": [], "n_items": [], "items_sha256": []}
            for hits in batch.column(2).to_pylist():
                end = n = 0
                for h in sorted(hits, key=lambda h: h["begin"]):
                    n += max(0, h["end"] - max(end, h["begin"]))
                    end = max(end, h["end"])
                items = sorted({i for h in hits for i in h["items"]})
                rows["n_hit"].append(n)
                rows["n_items"].append(len(items))
                rows["items_sha256"].append(hashlib.sha256(",".join(items).encode()).hexdigest())
            n_hit = pa.array(rows["n_hit"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), n_hit, pa.array(rows["n_items"], pa.int64()), pa.array(rows["items_sha256"], pa.string()), pa.array([x > 0 for x in rows["n_hit"]], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    found = spans(docs, prepared(docs, benchmark, block_windows))
    return found.withColumn("text", F.lit(None).cast("string")).select("doc_id", "text", "hits", "n_words").mapInArrow(digest, _RESULT)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of any item."""
    df = docs
    for sent in prepared(docs, benchmark):

        def keep(batches, sent=sent, at=docs.columns.index("text")):
            for batch in slices(batches):
                _, found = sent.value.hits(utf8(batch.column(at)))
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))

        df = df.mapInArrow(keep, docs.schema)
    return df
