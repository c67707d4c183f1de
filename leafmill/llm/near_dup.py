"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

Each document's set of word shingles becomes a signature of ``chunks * symbols`` symbols of 16 bits (b-bit MinHash).
If two signatures differ in at most ``2 * chunks - 1`` symbols, then by the pigeonhole principle they differ in at most
one symbol of some chunk; the allowed error is enumerated by masking each of the chunk's symbols in turn, so equal
masked chunks find all pairs within that distance, which is ``near``; they are confirmed on the full sets. At a similarity
of 0.85 a symbol differs with probability 0.15: with CONTRACT's numbers the signatures of such a pair are farther apart
than that with probability 2e-7; with CORPUS', at 0.8, with 5e-7; more alike, with less.

Documents with equal sets are one class from the start. In a bucket all classes are first compared with its smallest
one; then, once the links found are joined to components, only classes of different components are. Of these a pair is
looked at only if it shares one of the shingles that come first in each set, rarest first: sets that are similar enough
must share one, within bounds on lengths and places. In a large group of near copies the rare shingles are each copy's
own changes, so copies that changed too much meet nobody, and those that changed little are in one component already:
the group costs about its size and not its square, and no link is left untested.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, saved, utf8


@dataclass(frozen=True)
class Rules:
    """Words of a shingle, least similarity in percent, chunks of a signature, symbols of a chunk, greatest distance (at
    most 2 * chunks - 1, for which the join is exact)."""

    shingle: int
    percent: int
    chunks: int
    symbols: int
    near: int

    def __post_init__(self):
        if self.near > 2 * self.chunks - 1:
            raise ValueError("the join can't guarantee that distance")

    @property
    def k(self) -> int:
        return self.chunks * self.symbols


CONTRACT = Rules(3, 85, 10, 4, 19)
CORPUS = Rules(5, 80, 14, 4, 27)
#: Up to so many classes to confirm, their ids (24 bytes each) are broadcast to the second scan; beyond, shuffled.
BROADCAST_CLASSES = 200_000
RARITY_SLOTS = 1 << 21

_RNG = np.random.default_rng(20240607)
_MUL = _RNG.integers(1, 2**62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, 256, dtype=np.uint64)
#: A shingle's hash adds its words' hashes, each times its own odd number.
_PLACE = _RNG.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P1, _P2 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """64-bit hashes of words, each made once."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P2
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[bytes | None], known: _Hashes, size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    if len(known) > 150_000:
        known.clear()
    out = []
    for text in texts:
        w = text.translate(LOWER).split() if text else []
        h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
        if len(h) >= size:
            n = len(h) - size + 1
            out.append(np.unique(_mixed(sum(h[i : i + n] * _PLACE[i] for i in range(size)))))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], np.uint64) if w else np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray, k_: int) -> np.ndarray:
    least = np.full(k_, 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[k : k + 4096, None] * _MUL[:k_] + _ADD[:k_]).min(axis=0), out=least)
    return (_mixed(least * _P1) >> np.uint64(48)).astype("<u2")


def _signed(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, n_shingles, set_digest and sig of every row; no digest and sig if the set is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_digest", pa.binary()), ("sig", pa.binary())])

    def sign(batches):
        known, last = _Hashes(), {}
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in schema.names}
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows["doc_id"] += part.column(0).to_pylist()
                for s in shingle_sets(utf8(part.column(1)), known, rules.shingle):
                    rows["n_shingles"].append(len(s))
                    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                    rows["set_digest"].append(d)
                    if d is not None and d not in last:
                        if len(last) > 5000:
                            last.clear()
                        last[d] = signature(s, rules.k).tobytes()
                    rows["sig"].append(last[d] if d is not None else None)
            yield pa.RecordBatch.from_pydict(rows, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n_shingles long, set_digest binary, sig binary")


def _keys(classes: DataFrame, rules: Rules) -> DataFrame:
    """(key, class_id): for every chunk and every masked symbol a hash of the rest."""

    chunks, symbols = rules.chunks, rules.symbols

    def enumerate_errors(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, chunks, symbols).astype(np.uint64) + np.uint64(1)
            keys = np.empty((len(sig), chunks, symbols), np.uint64)
            for masked in range(symbols):
                h = np.arange(chunks, dtype=np.uint64)[None, :] * np.uint64(symbols) + np.uint64(masked + 1)
                h = np.repeat(h, len(sig), axis=0)
                for s in range(symbols):
                    if s != masked:
                        h = _mixed(h * _P1 + sig[:, :, s])
                keys[:, :, masked] = _mixed(h)
            ids = np.repeat(batch.column(0).to_numpy(), rules.k)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "class_id"])

    return classes.select("class_id", "sig").mapInArrow(enumerate_errors, "key long, class_id long")


def _near(pairs: DataFrame, classes: DataFrame, rules: Rules) -> DataFrame:
    """The pairs (a, b) whose signatures are within rules.near symbols."""
    sig = classes.groupBy("class_id").agg(F.first("sig").alias("sig"))
    both = pairs.join(sig.select(F.col("class_id").alias("b"), F.col("sig").alias("sig_b")), "b").join(sig.select(F.col("class_id").alias("a"), F.col("sig").alias("sig_a")), "a")

    def within(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, rules.k) for i in (2, 3))
                ok = pa.array((x != y).sum(axis=1) <= rules.near)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(within, "a long, b long")


def _sets(wanted: DataFrame, docs: DataFrame, rules: Rules) -> DataFrame:
    """(class_id, shingles) of the wanted classes (class_id, set_digest), from a second look at their texts."""
    few = wanted.count() <= BROADCAST_CLASSES
    texts = docs.select(F.col("doc_id").cast("long").alias("class_id"), "text").join(F.broadcast(wanted) if few else wanted, "class_id")

    def build(batches):
        known = _Hashes()
        for batch in batches:
            rows: dict[str, list] = {"class_id": [], "shingles": []}
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                for c, d, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), shingle_sets(utf8(part.column(1)), known, rules.shingle), strict=True):
                    if len(s) and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d:
                        rows["class_id"].append(c)
                        rows["shingles"].append(s.astype("<u8").tobytes())
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("class_id", pa.int64()), ("shingles", pa.binary())]))

    return texts.select("class_id", "text", "set_digest").mapInArrow(build, "class_id long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, rules: Rules) -> DataFrame:
    """The pairs with 100 * intersection >= rules.percent * union, counted on the full sets."""
    both = pairs.join(sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("set_b")), "b").join(sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("set_a")), "a")

    def confirm(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                inside = int((y[at] == x).sum())
                ok.append(100 * inside >= rules.percent * (len(x) + len(y) - inside))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "set_a", "set_b").mapInArrow(confirm, "a long, b long").distinct()


def _rarity(sets: DataFrame) -> np.ndarray:
    """Counts of shingles by slot; at most RARITY_SLOTS, fewer for small inputs. Any fixed order of shingles is right:
    where two share a slot the order is only less good."""
    n = sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    slots = 1 << min(RARITY_SLOTS.bit_length() - 1, max(10, (n // 8).bit_length()))

    def count(batches):
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                flat = np.frombuffer(b"".join(batch.column(0).slice(k, 200).to_pylist()), "<u8")
                at, n = np.unique((flat & np.uint64(slots - 1)).astype(np.int64), return_counts=True)
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    found = sets.select("shingles").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(slots, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def _across(sets: DataFrame, placed: DataFrame, rules: Rules) -> DataFrame:
    """Pairs (a, b) of classes in different components that could be similar enough. placed: class_id, component."""
    sent = sets.sparkSession.sparkContext.broadcast(_rarity(sets))

    def first(batches):
        count = sent.value
        mask = np.uint64(len(count) - 1)
        for batch in batches:
            ids, tokens, sizes, places = [], [], [], []
            for c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(s, "<u8")
                n = len(x) - -(-rules.percent * len(x) // 100) + 1
                rank = count[(x & mask).astype(np.int64)]
                tokens.append(x[np.lexsort((x, rank))[:n]])
                ids.append(np.full(n, c))
                sizes.append(np.full(n, len(x)))
                places.append(np.arange(n))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], names=["token", "class_id", "n", "place"])

    rows = sets.select("class_id", "shingles").mapInArrow(first, "token long, class_id long, n long, place long")
    rows = saved(rows.join(placed, "class_id"), "prefixes")
    kinds = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    # Tokens of one component only are done with; of the others, the commonest component needn't meet itself.
    mixed = kinds.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1").select("token", "most")
    open_ = saved(rows.join(mixed, "token"), "open")
    x, y = (open_.select("token", "most", F.col("class_id").alias(n), F.col("component").alias(f"c{n}"), F.col("n").alias(f"n{n}"), F.col("place").alias(f"p{n}")) for n in "xy")
    t = rules.percent
    shared = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    near = (F.col("cx") != F.col("cy")) & (100 * F.least("nx", "ny") >= t * F.greatest("nx", "ny")) & (shared * (100 + t) >= t * (F.col("nx") + F.col("ny")))
    met = x.filter("cx <> most").join(y.drop("most"), "token").filter(near)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable by links (a, b), for every node that has a link.

    Alternating large-star and small-star steps: each moves edges towards the smallest neighbour, in joins on the
    smaller table of minima; it ends when an iteration changes nothing.
    """
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        edges = saved(small, "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, rules: Rules = CORPUS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    A null, empty or blank text has no shingles, is linked with nothing and kept. A null doc_id takes no part: its row has a null component
    and is kept. Rows of equal doc_id and text all have their component and are all kept or all not; rows of equal
    doc_id and different texts are looked at one by one. An empty table gives no rows; other columns aren't looked at.
    """
    signed = saved(_signed(docs, rules), "signed")
    full = signed.filter("set_digest is not null and doc_id is not null")
    classes = saved(full.groupBy("set_digest", "sig").agg(F.min("doc_id").alias("class_id")), "classes")
    keys = _keys(classes, rules)
    shared = keys.groupBy("key").agg(F.min("class_id").alias("first"), F.max("class_id").alias("last")).filter("first < last")
    hits = saved(keys.join(shared.select("key", "first"), "key"), "hits")
    stars = saved(_near(hits.filter("class_id <> first").select(F.col("first").alias("a"), F.col("class_id").alias("b")).distinct(), classes, rules), "stars")
    wanted = saved(classes.select("class_id", "set_digest").join(hits.select("class_id").distinct(), "class_id"), "wanted")
    sets = saved(_sets(wanted, docs, rules), "sets")
    links = saved(_confirmed(stars, sets, rules), "links")
    joined = components(links)
    # What is left: classes that share a bucket and are not yet in one component.
    placed = hits.join(joined, hits["class_id"] == joined["node"], "left").select("key", "class_id", F.coalesce("component", "class_id").alias("component"))
    placed = saved(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1").select("key")
    open_ = saved(placed.join(mixed, "key").select("class_id", "component").distinct(), "open")
    across = _across(saved(sets.join(open_, "class_id", "left_semi"), "open-sets"), open_, rules)
    rest = saved(_near(across.join(stars, ["a", "b"], "left_anti"), classes, rules), "rest")
    more = saved(_confirmed(rest, sets, rules), "links")
    if not more.isEmpty():
        joined = components(links.unionByName(more))
    by_set = classes.join(joined, classes["class_id"] == joined["node"], "left").select("set_digest", F.coalesce("component", "class_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_digest").join(saved(by_set, "by-set"), "set_digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, rules: Rules = CORPUS) -> DataFrame:
    """docs' rows, with all their columns, without those that ``near_duplicates`` doesn't keep; of rows with equal
    doc_id and text one stays."""
    kept = near_duplicates(docs, rules).filter("kept and doc_id is not null").select(F.col("doc_id").alias("_kept_id")).distinct()
    named = docs.filter("doc_id is not null")
    stay = named.join(kept, named["doc_id"] == kept["_kept_id"], "left_semi").unionByName(docs.filter("doc_id is null"))
    again = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return stay
    again = saved(again, "again")
    return stay.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(stay.join(again, "doc_id", "left_anti"))
