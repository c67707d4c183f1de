"""Graded quality by ordinal cumulative-link regression on hashed text.

A document's score f is one weighted sum of its hashed features; ordered thresholds t_0 < t_1 < ... turn it into
P(grade <= k) = sigmoid(t_k - f). All grades share the weights, so what tells grade 0 from 1 also helps to tell 1 from 2.
Features: each different word and its beginnings of four and five letters, once; and what part of the words has which
shape (letters, capitals, digits, marks). Weights are fitted by FTRL-proximal with an L1 penalty, which leaves the
weights of indifferent words at exactly zero.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, utf8

BITS = 20
#: The bounded sample for fitting: about so many rated documents, of at most so many bytes.
SAMPLE, TEXT_BYTES = 16_000, 100_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.08, 1.0, 1.5, 1.0
SHAPE_WEIGHT = 4.0
#: A document is selected from this tail probability on; below one half, so that good documents stay.
SELECT = 0.4
_MARKS = re.compile(rb"[^a-z\x80-\xff]+")
_SHAPES = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"9")]


class _Tokens(dict):
    """Numbers of tokens, with each one's hashed features: word, two beginnings, shape."""

    def __init__(self):
        self.features: list[list[int]] = []

    def __missing__(self, token: bytes) -> int:
        n = self[token] = len(self)
        word, shape = _MARKS.sub(b"", token.translate(LOWER)), token
        for pattern, to in _SHAPES:
            shape = pattern.sub(to, shape)
        self.features.append([xxhash.xxh32_intdigest(x) >> (32 - BITS) for x in (b"w" + word, b"4" + word[:4], b"5" + word[:5], b"s" + shape[:12])])
        return n


def features(texts: list[bytes | None], known: _Tokens | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """The features and their values of each text."""
    known = _Tokens() if known is None or len(known) > 300_000 else known
    ids = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in ((t or b"").split() for t in texts)]
    table = np.array(known.features, np.int64).reshape(-1, 4)
    out = []
    for i in ids:
        if not len(i):
            out.append((np.empty(0, np.int32), np.empty(0, np.float32)))
            continue
        words = np.unique(table[np.unique(i), :3])
        shapes, n = np.unique(table[i, 3], return_counts=True)
        out.append((np.concatenate([words, shapes]).astype(np.int32), np.concatenate([np.ones(len(words)), SHAPE_WEIGHT * n / len(i)]).astype(np.float32)))
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: list[bytes | None], known: _Tokens | None = None) -> np.ndarray:
        """P(grade >= k) of each text, for k = 1, 2, ..."""
        f = np.array([float(v @ self.weights[i]) for i, v in features(texts, known)])
        return 1 - _sigmoid(self.thresholds[None, :] - f[:, None])


def fit(rows: list[tuple[bytes, int]], grades: int) -> Model:
    """rows: (text, grade from 0), in any order; they are used in an order of their hashes."""
    z, n, w = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
    rows = sorted(rows, key=lambda r: (xxhash.xxh64_intdigest(r[0]), r[1]))
    share = np.cumsum(np.bincount([g for _, g in rows], minlength=grades) + 1.0)
    t = np.log(share[:-1] / (share[-1] - share[:-1]))
    known = _Tokens()
    data = [x for k in range(0, len(rows), 500) for x in features([r[0] for r in rows[k : k + 500]], known)]
    for epoch in range(EPOCHS):
        rate = 0.02 / (1 + epoch)
        for (i, v), (_, y) in zip(data, rows, strict=True):
            low = _sigmoid(t[y - 1] - float(v @ w[i])) if y else 0.0
            f = float(v @ w[i])
            high = _sigmoid(t[y] - f) if y < grades - 1 else 1.0
            p = max(high - low, 1e-9)
            # The loss is -log(high - low); its slope in f is 1 - high - low for all grades.
            g = (1 - high - low) * v
            if y < grades - 1:
                t[y] += rate * min(5.0, high * (1 - high) / p)
            if y:
                t[y - 1] -= rate * min(5.0, low * (1 - low) / p)
            t = np.maximum.accumulate(t + np.arange(len(t)) * 1e-6)
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
            w[i] = np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))
    return Model(w.astype(np.float32), t)


def sample(docs: DataFrame, ratings: DataFrame) -> list[tuple[bytes, int]]:
    """About SAMPLE texts with their grades. ratings: doc_id, grade (null: none)."""
    rated = ratings.filter("doc_id is not null and grade is not null").select(F.col("doc_id").cast("long").alias("rated_id"), F.col("grade").cast("int").alias("grade"))
    n = rated.count()
    rate = min(1.0, SAMPLE / max(1, n))
    some = rated.filter(F.pmod(F.xxhash64("rated_id"), F.lit(1 << 40)) < F.lit(int(rate * (1 << 40))))
    some = some.groupBy("rated_id", "grade").count().drop("count")
    texts = docs.filter(F.octet_length("text") <= TEXT_BYTES).select(F.col("doc_id").cast("long").alias("rated_id"), "text")
    # The sample's bound holds for the broadcast as well.
    return [(r["text"].encode(), r["grade"]) for r in texts.join(F.broadcast(some), "rated_id").select("text", "grade").distinct().collect()]


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, expected_grade, p_tail (probability of the highest grade), p_above_lowest, selected
    (p_tail of at least SELECT).

    A null or empty text has no features and gets what the thresholds say. A null doc_id stays null; repeated rows
    give repeated results; an empty table gives no rows; columns other than doc_id and text aren't looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = _Tokens()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                if len(known) > 300_000:
                    known = _Tokens()
                tails = sent.value.tails(utf8(part.column(1)), known)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, 0]), pa.array(tails[:, -1] >= SELECT)], names=["doc_id", "expected_grade", "p_tail", "p_above_lowest", "selected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected_grade double, p_tail double, p_above_lowest double, selected boolean")
