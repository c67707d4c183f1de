"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into bands and, within a band, by the coordinates that dominate them; buckets are cut from
that order, so the vectors of one are alike in length and, where the data has clusters, in direction. A query needs from
a bucket only vectors that reach its local threshold theta, the score it is sure to find k of. For each bucket it is
chosen from theta what to do:

* by length and direction: no product can be above |q| times the longest vector, the sum over coordinates of the better
  end of the bucket's range, or q's product with the centre plus |q| times the bucket's radius. Is the least of these
  bounds below theta, the whole bucket is skipped;
* by coordinates: the products over the FIRST largest coordinates of q, plus the lengths of what is left of q and of each
  vector, bound each product; where few vectors stay above theta, only these are multiplied;
* else the bucket is multiplied.

theta begins at the k-th best score among a bounded sample of all vectors (SEEDS of them), which is a lower bound
whatever the sample, and rises with what is found. Scores are exact integers.

Queries are sent out in groups of at most GROUP_BYTES; each group is a pass over the buckets, in which every task keeps
k results a query.
"""

from __future__ import annotations

from collections import Counter
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BUCKET, SEEDS = 512, 4096
GROUP_BYTES = 24_000_000
FIRST = 8
#: Coordinates are looked at where this many queries or fewer are left to a bucket, and used where they leave at most this
#: part of it; otherwise one matrix product is cheaper.
FEW_QUERIES, FEW = 64, 0.2
#: Bands of length: so many to each doubling.
BANDS = 4
#: Above this sum of squares, products of float64 could be inexact.
EXACT = 2.0**52
LEAST, MOST = -(2**63), 2**63 - 1


def _quantised(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, dim, band, key, values of the vectors that take part. values: floor(scale * x) as float64, which holds these
    whole numbers exactly; where scale * x is beyond float64, x itself (huge). key: where the largest coordinates stand."""

    def quantise(batches):
        schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int64()), ("huge", pa.bool_()), ("band", pa.int64()), ("key", pa.int64()), ("values", pa.binary())])
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in schema.names}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                raw = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(raw).all():
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(scale * raw)
                    huge = not np.isfinite(x).all()
                    norm = float(np.sqrt((x * x).sum()))
                two = np.argsort(-np.abs(raw), kind="stable")[:2]
                key = 0
                for k in two.tolist():
                    key = key * (2 * len(raw) + 1) + 2 * k + (raw[k] < 0)
                for n, value in zip(schema.names, (i, len(raw), huge, 1 << 20 if not np.isfinite(norm) else int(np.floor(BANDS * np.log2(norm + 1))), key, (raw if huge else x).astype("<f8").tobytes()), strict=True):
                    rows[n].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema)

    return vectors.mapInArrow(quantise, "vec_id long, dim long, huge boolean, band long, key long, values binary")


def _buckets(rows: DataFrame) -> DataFrame:
    """Buckets of equal dimension, longest bands first: dim, huge, ids, values. Repeated rows are one."""

    def pack(batches):
        at, ids, values, last = None, [], [], None

        def bucket():
            return pa.RecordBatch.from_pydict({"dim": pa.array([at[0]], pa.int64()), "huge": [at[1]], "ids": [np.array(ids, "<i8").tobytes()], "values": [b"".join(values)]})

        for batch in batches:
            for i, d, h, v in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 5)), strict=True):
                if (i, h, v) == last:
                    continue
                if ids and ((d, h) != at or len(ids) == BUCKET):
                    yield bucket()
                    ids, values = [], []
                at, last = (d, h), (i, h, v)
                ids.append(i)
                values.append(v)
        if ids:
            yield bucket()

    order = ["dim", "huge", F.desc("band"), "key", F.xxhash64("vec_id"), "vec_id", "values"]
    return rows.repartitionByRange(*order[:6]).sortWithinPartitions(*order).mapInArrow(pack, "dim long, huge boolean, ids binary, values binary")


def _whole_numbers(x: np.ndarray, huge: bool, scale: float) -> np.ndarray:
    """Rows as Python's integers."""
    number = (lambda v: floor(Fraction(v) * Fraction(scale))) if huge else int
    return np.array([[number(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


class _Best:
    """The k best (score, id) of each query of a group: scores falling, ids rising."""

    def __init__(self, n: int, k: int):
        self.k, self.found = k, [[] for _ in range(n)]
        self.theta: list[int | None] = [None] * n

    def add(self, q: int, scores, ids) -> None:
        new = sorted([*self.found[q], *((-int(s), int(i)) for s, i in zip(scores, ids, strict=True))])[: self.k]
        self.found[q] = new
        if len(new) == self.k:
            self.theta[q] = -new[-1][0]


class Queries:
    """Queries of one dimension, with the k best of each so far and what was done with the buckets."""

    def __init__(self, rows: list[tuple[int, bool, bytes]], dim: int, k: int, scale: float):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.huge = np.array([r[1] for r in rows], bool)
        self.x = np.frombuffer(b"".join(r[2] for r in rows), "<f8").reshape(len(rows), dim)
        self.scale, self.best = scale, _Best(len(rows), k)
        with np.errstate(over="ignore"):
            self.norm = np.where(self.huge, np.inf, np.sqrt((self.x * self.x).sum(axis=1)))
        self.first = np.argsort(-np.abs(self.x), axis=1, kind="stable")[:, :FIRST]
        self.done: Counter[str] = Counter()  #: pairs of query and bucket by what was done

    def _scores(self, at: np.ndarray, y: np.ndarray, huge: bool) -> np.ndarray:
        """Exact products of queries at with rows of y, as int64 where they fit, else as Python's integers."""
        x = self.x[at]
        if not huge and not self.huge[at].any() and float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1]) < EXACT:
            return (x @ y.T).astype(np.int64)
        rows = [_whole_numbers(x[i : i + 1], bool(h), self.scale) for i, h in enumerate(self.huge[at])]
        return np.concatenate(rows) @ _whole_numbers(y, huge, self.scale).T

    def seed(self, y: np.ndarray, ids: np.ndarray, huge: bool) -> None:
        """Thresholds from a sample of vectors; of their scores only the k-th best counts."""
        if len(y) and not huge and not self.huge.any():
            k = self.best.k
            for a in range(0, len(self.ids), 256):
                at = np.arange(a, min(a + 256, len(self.ids)))
                for q, row in zip(at.tolist(), self._scores(at, y, huge), strict=True):
                    row = row[ids != self.ids[q]]
                    if len(row) >= k:
                        self.best.theta[q] = int(np.partition(row, len(row) - k)[len(row) - k])

    def search(self, y: np.ndarray, ids: np.ndarray, huge: bool) -> None:
        n = len(self.ids)
        theta = np.array([-np.inf if t is None else float(np.clip(t, -1e300, 1e300)) for t in self.best.theta])
        with np.errstate(all="ignore"):
            norm = np.sqrt((y * y).sum(axis=1))
            plain = not huge and bool(np.isfinite(norm).all())
            if plain:
                # Bounds are loosened a little, against rounding; equal scores must stay, for their ids.
                centre = y.mean(axis=0)
                radius = float(np.sqrt(((y - centre) ** 2).sum(axis=1).max(initial=0)))
                box = np.maximum(self.x, 0) @ y.max(axis=0) + np.minimum(self.x, 0) @ y.min(axis=0)
                bound = np.minimum(np.minimum(self.norm * norm.max(initial=0), box), self.x @ centre + self.norm * radius)
                bound += 1e-9 * (np.abs(bound) + self.norm * norm.max(initial=0)) + 1
                left = np.flatnonzero(~(bound < theta) | ~np.isfinite(self.norm))
            else:
                left = np.arange(n)
        self.done["skipped"] += n - len(left)
        whole = left
        if plain and len(left) <= FEW_QUERIES:
            whole = []
            for q in left.tolist():
                rows = None
                if np.isfinite(theta[q]) and np.isfinite(self.norm[q]):
                    f = self.first[q]
                    rest_q = np.sqrt(max(0.0, self.norm[q] ** 2 - (self.x[q, f] ** 2).sum()))
                    part = y[:, f]
                    rest = np.sqrt(np.maximum(0, norm * norm - (part * part).sum(axis=1)))
                    reach = part @ self.x[q, f] + rest_q * rest
                    rows = np.flatnonzero(reach + 1e-9 * (np.abs(reach) + self.norm[q] * norm) + 1 >= theta[q])
                if rows is None or len(rows) > FEW * len(y):
                    whole.append(q)
                    continue
                self.done["filtered"] += 1
                rows = rows[ids[rows] != self.ids[q]]
                if len(rows):
                    self.best.add(q, self._scores(np.array([q]), y[rows], huge)[0], ids[rows])
        self.done["whole"] += len(whole)
        if len(whole):
            at = np.array(whole)
            for row, q in zip(self._scores(at, y, huge), at.tolist(), strict=True):
                self._take(q, row, ids)

    def _take(self, q: int, row: np.ndarray, ids: np.ndarray) -> None:
        """The best of a row of scores, ties by id."""
        best = self.best
        ok = ids != self.ids[q]
        if (theta := best.theta[q]) is not None:
            ok &= row >= theta
        row, named = row[ok], ids[ok]
        if len(row) > best.k:
            least = np.sort(row)[len(row) - best.k]
            over, tied = np.flatnonzero(row > least), np.flatnonzero(row == least)
            tied = tied[np.argsort(named[tied], kind="stable")[: best.k - len(over)]]
            at = np.concatenate([over, tied])
            row, named = row[at], named[at]
        if len(row):
            best.add(q, row, named)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer products of floor(scale * x).

    vectors: vec_id and vector, in this order. is_query: a condition on vec_id. Ties go to the smaller vec_id; fewer
    candidates give fewer rows. Null vec_ids, null vectors and vectors with null or non-finite components take no part;
    rows equal in vec_id and vector are one row; a query's own vec_id is no candidate of it; vectors of other length than
    the query's aren't either. Components of any finite size take part: ranks are those of exact products, and a score
    outside 64 bits is given as the nearest number inside. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = saved(_quantised(vectors, scale), "vectors")
    buckets = saved(_buckets(rows), "buckets")
    queries = saved(rows.filter(is_query).select("vec_id", "dim", "huge", "values").distinct(), "queries")
    size = queries.agg(F.sum(F.col("dim") * 8 + 8)).first()[0] or 0
    total = rows.count()
    # A hash of the row picks about SEEDS vectors; a vector that is there twice counts once.
    rate = min(1.0, SEEDS / max(1, total))
    few = rows.filter(~F.col("huge") & (F.pmod(F.xxhash64("vec_id", "values"), F.lit(1 << 30)) < int(rate * (1 << 30)))).select("vec_id", "dim", "values").distinct()
    seeds = spark.sparkContext.broadcast([(r["vec_id"], r["dim"], bytes(r["values"])) for r in few.collect()])
    groups = max(1, -(-size // GROUP_BYTES))

    def scanned(g: int) -> DataFrame:
        sent = spark.sparkContext.broadcast([(r["dim"], r["vec_id"], r["huge"], bytes(r["values"])) for r in queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).collect()])

        def scan(batches):
            by_dim: dict[int, Queries] = {}
            for dim in {r[0] for r in sent.value}:
                by_dim[dim] = Queries([r[1:] for r in sent.value if r[0] == dim], dim, k, scale)
                known = [s for s in seeds.value if s[1] == dim]
                by_dim[dim].seed(np.frombuffer(b"".join(s[2] for s in known), "<f8").reshape(len(known), dim), np.array([s[0] for s in known], np.int64), False)
            for batch in batches:
                for dim, huge, ids, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if dim in by_dim:
                        ids = np.frombuffer(ids, "<i8")
                        by_dim[dim].search(np.frombuffer(values, "<f8").reshape(len(ids), dim), ids, huge)
            for mine in by_dim.values():
                found = [(int(i), v, min(MOST, max(LEAST, -s)), str(-s).encode()) for i, f in zip(mine.ids, mine.best.found, strict=True) for s, v in f]
                if found:
                    q, v, s, _ = zip(*found, strict=True)
                    # Of scores beyond 64 bits, how many digits and which: their order as text is that of numbers.
                    order = [((b"0%09d" % (10**9 - 1 - len(t)) + bytes(105 - c for c in t[1:])) if t[:1] == b"-" else b"1%09d" % len(t) + t) for *_, t in found]
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64()), "exact": pa.array(order, pa.binary())})

        return buckets.mapInArrow(scan, "query_id long, vec_id long, score long, exact binary")

    found = scanned(0)
    if groups > 1:
        # Each group's results are written before the next is sent, so only one group of queries is held.
        found = saved(found, "found-0")
        for g in range(1, groups):
            found = found.unionByName(saved(scanned(g), f"found-{g}"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
