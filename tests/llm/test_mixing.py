"""The language model bit by bit, in plain loops, against the operator; and what it is worth on texts held out."""

import math
import tracemalloc
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import mixing as M

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, counts = M.fit(docs)
    return docs, model, counts, {bytes(w): c for w, c in counts.collect()}


def _out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _words(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()


def _hash(x, y, bits):
    h = (x + 1) * 0xC2B2AE3D27D4EB4F % 2**64 ^ (y + 1) * 0x9E3779B97F4A7C15 % 2**64
    return (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64 >> 64 - bits


def _odds(p):
    p = min(max(p, 1e-5), 1 - 1e-5)
    return math.log(p / (1 - p))


def _pair(code):
    return M._COUNTS[int(code) & 255], M._COUNTS[int(code) >> 8]


def _spelled(model, word, skip):
    total, done = 0.0, b" " * 6
    for k, byte in enumerate(word + b" "):
        node = 1
        for j in range(7, -1, -1):
            bit, p, z = byte >> j & 1, 0.5, 0.0
            for o, (order, bits, w) in enumerate(zip(M.ORDERS, M.SPELL_BITS, M.SPELL_WEIGHTS)):
                h = (int.from_bytes(done[-order:], "big") * 0xC2B2AE3D27D4EB4F + order) % 2**64 ^ node * 0x9E3779B97F4A7C15 % 2**64
                n0, n1 = _pair(model.spelling[M._SPELL_AT[o] + ((h ^ h >> 29) * 0xD6E8FEB86659FD93 % 2**64 >> 64 - bits)])
                own = 4 if o else 0.8
                p = (n1 + own * p) / (n0 + n1 + own)
                z += w * _odds(p)
            q = 1 / (1 + math.exp(-min(max(z, -11), 11)))
            if k >= skip:
                total += math.log10(q if bit else 1 - q)
            node = 2 * node + bit
        done += bytes([byte])
    return total


def _slow(model, counts, text):
    """log10 of the probability of a text, one decision after another."""
    tree, total = model.tree, 0.0
    own, weights = defaultdict(lambda: [0.0, 0.0]), [list(M.WEIGHTS) for _ in range(16)]
    refined = [1 / (1 + math.exp(6 - 12 * k / 23)) for k in range(24)]
    last, before, waiting = M.CLASSES - 1, tree.end, []
    place = {w: i for i, w in enumerate(tree.words)}
    words = [*_words(text), None]
    for t, word in enumerate(words):
        leaf = tree.end if word is None else place.get(word)
        if leaf is None:
            leaf = tree.leaf(word)
            c, known = counts.get(word, 0), model.drawn[leaf] + model.kinds[leaf]
            if M.hashes(pa.array([word]))[0] in model.known:
                total += math.log10(c / known)
            else:
                skip = 0 if leaf == tree.end + 1 else 2
                old, new = (c / known, model.kinds[leaf] / known) if known else (0, 1)
                total += math.log10(old + new * 10 ** _spelled(model, word, skip)) if c else math.log10(new) + _spelled(model, word, skip)
        for at in range(tree.offset[leaf], tree.offset[leaf + 1]):
            node, bit = int(tree.nodes[at]), int(tree.bits[at])
            p = float(tree.chance[node])
            x = []
            for slot in (last * M.NODES + min(node, M.NODES - 1), M.CLASSES * M.NODES + _hash(before, node, model.bits)):
                n0, n1 = _pair(model.table[slot])
                p = (n1 + 2 * p) / (n0 + n1 + 2)
                x.append(_odds(p))
            n = n0 + n1
            o0, o1 = own[node] if node < M.OWN else (0, 0)
            x.append(_odds((o1 + 8 * p) / (o0 + o1 + 8)))
            gate = 4 * sum(bool(n >= k) for k in (1, 8, 64)) + sum(o0 + o1 >= k for k in (1, 8, 64))
            z = min(max(sum(a * b for a, b in zip(x, weights[gate])), -11), 11)
            q = 1 / (1 + math.exp(-z))
            k = int(min(max((z + 6) * 23 / 12 + 0.5, 0), 23))
            final = 0.75 * q + 0.25 * refined[k]
            total += math.log10(max(final if bit else 1 - final, 1e-5))
            waiting.append((node, bit, x, gate, q, k, refined[k]))
        if leaf < M.CLASSES - 1 and leaf != tree.end:
            last = leaf
        before = leaf
        if t % M.BLOCK == M.BLOCK - 1:
            steep = Counter()
            for _, _, x, gate, q, _, _ in waiting:
                steep[gate] += q * (1 - q) * sum(a * a for a in x)
            times = Counter(w[5] for w in waiting)
            for node, bit, x, gate, q, k, r in waiting:
                own[node][bit] += 1
                refined[k] += (bit - r) / (times[k] + 20)
                for j in range(3):
                    weights[gate][j] += 0.6 * (bit - q) * x[j] / (steep[gate] + 20)
            waiting = []
    return total


def test_score_bit_by_bit(spark, fitted):
    docs, model, counts, all_counts = fitted
    texts = [r["text"] for r in docs.filter("n_chars < 1500").orderBy("doc_id").limit(12).collect()]
    texts += ["", None, " \t ", "qqqqz \x01\x02 漢字 zzzzzzzz zzzzzzzz", "The THE the " * 30, texts[0]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in M.score(rows, model, counts).collect()}
    for i, t in enumerate(texts):
        assert math.isclose(got[i], _slow(model, all_counts, t), rel_tol=2e-4), i
    assert got[0] == got[len(texts) - 1]


def test_worth_on_texts_held_out(fitted):
    """Although the base score needn't spell unknown words, the model's is better in all."""
    docs, model, counts, all_counts = fitted
    got = M.score(docs, model, counts).collect()
    assert all(r["held_out"] == _out(r["doc_id"]) for r in got)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    n, v = sum(all_counts.values()), len(all_counts)
    for r in got[::50]:
        want = sum(math.log10((all_counts.get(w, 0) + 1) / (n + v + 1)) for w in [*_words(text[r["doc_id"]]), b" "])
        assert math.isclose(r["base_score"], want, rel_tol=1e-9)
        assert math.isclose(r["bits_per_byte"], -r["score"] * math.log2(10) / len(text[r["doc_id"]].encode()), rel_tol=1e-9)


def test_leaves_fill_the_tree():
    tree = M.Tree.build([b"a", b"b", b"c"], [5, 3, 1], 2, {b"d ": 4, b"ef": 1})
    codes = [tuple(zip(tree.nodes[a:b].tolist(), tree.bits[a:b].tolist())) for a, b in zip(tree.offset[:-1], tree.offset[1:])]
    assert math.isclose(sum(2.0 ** -len(c) for c in codes), 1) and len(set(codes)) == 7
    assert [tree.leaf(w) for w in (b"d", b"efg", b"x")] == [5, 6, 4]


def test_words():
    texts = ["  Ab cd\nefghijklmnop q\trs ", "", None, " \t ", "\x0b\x0c\r x\x1cy\x00 É É", "q"]
    different, at, n = M.words(pa.array(texts, pa.string()))
    assert [different[int(i)].as_py() for i in at] == [w for t in texts for w in _words(t)] and n.tolist() == [len(_words(t)) for t in texts]


def test_a_text_in_windows(fitted, monkeypatch):
    """What a long text's windows learn goes on into the next."""
    docs, model, *_ = fitted
    text = "\n".join(r["text"] for r in docs.filter("n_chars < 900").orderBy("doc_id").limit(30).collect())
    whole = model.score(pa.array([text, "short one", None]))["score"]
    monkeypatch.setattr(M, "TOKENS", 40)
    assert np.allclose(model.score(pa.array([text, "short one", None]))["score"], whole, rtol=1e-5)
    assert len({int(h) for h in M.hashes(pa.array([b"a", b"b", b"ab", b"ba", b"aa", b"aaa"]))}) == 6


def test_counts_follow_the_codes():
    table = np.zeros(M.PIECE * 4, np.uint32)
    table[[0, 1, 2 * M.PIECE + 5]] = 7, 300, 70_000
    (batch,) = M._pieces(table, 3 * M.PIECE)
    assert batch.column(0).to_pylist() == [3, 4]
    assert M._COUNTS[47] == 47 and abs(M._COUNTS[255] - 2**25) < 1


def test_hot_words(spark):
    """A third of all rows are one text; a group of words holds none of the head."""
    rows = [(i, "same line again and again") for i in range(60)] + [(100 + i, f"word{i} an{i} an{i + 1}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    model, counts = M.fit(docs.withColumn("score", F.lit("mine")))
    got = M.score(docs, model, counts).collect()
    assert len(got) == 180 and len({r["score"] for r in got if r["doc_id"] < 60}) == 1


def test_slots_cost_what_is_added():
    """Not what the table holds, which is far more than a batch adds."""
    rng = np.random.default_rng(5)
    slot, bit = rng.integers(0, 3_000_000, 5000).astype(np.int32), rng.integers(0, 2, 5000).astype(np.uint8)
    found = M.Slots(3_000_000)
    tracemalloc.start()
    found.add(slot, bit)
    found.add(slot[:100].reshape(50, 2), bit[:100].reshape(50, 2))
    found.add(slot[:9], bit[:9], np.arange(1, 10))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = Counter(zip(slot.tolist(), bit.tolist())) + Counter(zip(slot[:100].tolist(), bit[:100].tolist()))
    for k in range(9):
        want[int(slot[k]), int(bit[k])] += k + 1
    got = found.table.reshape(-1, 2)
    assert peak < 1_000_000 and got.sum() == 5145 and all(got[key] == c for key, c in want.items())


def test_what_is_held_at_once(fitted, monkeypatch):
    """A window of decisions stays in a core's cache, however many texts a part has; how texts are grouped changes nothing."""
    docs, model, *_ = fitted
    texts = pa.array([r["text"] for r in docs.orderBy("doc_id").limit(600).collect()])
    held, decisions = [], M.decisions
    monkeypatch.setattr(M, "decisions", lambda tree, leaf: held.append(len(leaf)) or decisions(tree, leaf))
    score = model.score(texts)["score"].to_numpy()
    assert sum(held) > 100_000 and max(held) <= 4096
    monkeypatch.setattr(M, "SIDE", 7)
    assert np.allclose(model.score(texts)["score"].to_numpy(), score, rtol=1e-9)


def test_nodes_that_share_a_slot(fitted, monkeypatch):
    """All nodes from the last slot on share it, each with its own chance."""
    docs, model, _, all_counts = fitted
    monkeypatch.setattr(M, "NODES", 64)
    model = replace(model, by_class=None)
    texts = [r["text"] for r in docs.filter(~M.held_out() & (F.col("n_chars") < 1500)).orderBy("doc_id").limit(5).collect()]
    for text, got in zip(texts, model.score(pa.array(texts))["score"].to_pylist(), strict=True):
        assert math.isclose(got, _slow(model, all_counts, text), rel_tol=2e-4)
