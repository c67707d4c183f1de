"""Language-model scores by online logistic context mixing.

A text is a sequence of words and one end. Each token is a path of binary decisions in a Huffman tree whose leaves are
the HEAD commonest words, the end, and groups of all other words by their first two bytes. Within its group a word is
drawn from two sources, weighted as often as training met a new word there: the counts of the group's training words, or
its spelling in bytes of eight decisions. A group that training never met is spelled from the first byte.

For a token's decision four predictors tell the chance of a one: at the tree's node alone; with the last of the
commonest words (which tells languages and kinds of text apart); with the word before (hashed into a table whose size
follows the training tokens up to 2^MOST_BITS slots); and with what the text itself has had at this node so far. Each is
smoothed by the one before. The log-odds of the last three are mixed by weights from a set that is chosen by how much the last two have
been seen, and a small adaptive table refines the result. Weights, refinement and the text's own counts are learnt
online and go on through the whole text: all decisions of BLOCK tokens take what the blocks before them have taught,
then move it against their error together, so the texts of a batch are scored side by side.

What training counts, in all its documents, reaches the driver as tables of bounded size; the counts of words, which are
not bounded, stay in a saved table that words outside the BASE_HEAD commonest are joined to.

The probability of the text is the product over all decisions. Beside it stands the base score, the exact add-one
unigram model over all training tokens.
"""

from __future__ import annotations

import heapq
import itertools
import math
from dataclasses import InitVar, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

HEAD, BASE_HEAD = 8192, 300_000
#: Texts are taken in parts of about so many bytes and at most so many rows, and decisions made of so many tokens (or
#: grams or words to spell) at a time, which bounds a worker's memory and keeps what it works on in a core's cache.
PART, ROWS, TOKENS, GRAMS = 4 << 20, 2000, 1 << 12, 1 << 11
#: Texts whose decisions are mixed side by side.
SIDE = 256
#: The commonest words that serve as contexts, and the last of these, which stands for none yet.
CLASSES = 64
#: Nodes, the heaviest first, that are told apart with a class; nodes of which a text's own counts are kept.
NODES, OWN = 16_384, 512
LEAST_BITS, MOST_BITS = 16, 22
BLOCK = 16
RATE, STILL, LIMIT = 0.6, np.float32(20), np.float32(11)
BUCKETS = 24
#: How much the predictor before counts in each one.
PRIORS = (np.float32(2), np.float32(2), np.float32(8))
#: Where the weights begin, for all predictors but the first, which the others build on.
WEIGHTS = (0.3, 0.4, 0.4)
#: Bytes before the one that is spelled, the bits of each table, and how each counts.
ORDERS = (2, 3, 4, 6)
SPELL_BITS = (18, 20, 20, 20)
SPELL_WEIGHTS, SPELL_PRIOR = (0.1, 0.3, 0.4, 0.3), np.float32(4)
#: Slots of a piece of a table on its way.
PIECE = 1 << 12
_FLOOR = np.float32(1e-5)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of a column of texts, the words of all texts as places among them, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    found = pc.dictionary_encode(lists.flatten().cast(pa.binary()))
    different, at = found.dictionary, found.indices.to_numpy()
    n = np.diff(lists.offsets.to_numpy())
    # Space at either end of a text leaves an empty word there.
    empty = pc.index(different, b"").as_py()
    if empty >= 0:
        keep = at != empty
        sums = np.concatenate([[0], np.cumsum(keep)])
        ends = np.cumsum(n)
        n, at = sums[ends] - sums[ends - n], at[keep]
        at = at - (at > empty)
        different = different.filter(pc.not_equal(different, b""))
    return different, at, n


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a binary column without nulls begins (and the last one ends), and all bytes."""
    column = pa.concat_arrays([column])  # from offset 0 on
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int32, len(column) + 1)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)


def hashes(column: pa.Array) -> np.ndarray:
    """64 bits of each word: a polynomial in an odd number, stirred."""
    if not len(column):
        return np.zeros(0, np.uint64)
    offsets, data = _buffers(column)
    n = np.diff(offsets)
    powers = np.cumprod(np.full(int(n.max()), 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], n)
    h = np.add.reduceat((data[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)) * powers[place], offsets[:-1] - offsets[0])
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def prefix(word: bytes) -> bytes:
    """What a word's group is known by."""
    return (word + b" ")[:2]


def prefixes(column: pa.Array) -> np.ndarray:
    """prefix of every word, as a number."""
    if not len(column):
        return np.zeros(0, np.int64)
    offsets, data = _buffers(column)
    second = np.where(np.diff(offsets) > 1, data[np.minimum(offsets[:-1] + 1, len(data) - 1)], 32)
    return data[offsets[:-1]].astype(np.int64) << 8 | second


# ---- counts, in tables


def _steps_of_counts() -> np.ndarray:
    """What the 256 codes of a count stand for: exact up to 47, then in steps of a fifteenth, to 2^25."""
    return np.concatenate([np.arange(48), 48 * np.exp(np.arange(1, 209) * (math.log(2**25 / 48) / 208))])


_COUNTS = _steps_of_counts()
_SHORT = _COUNTS.astype(np.float32)


def _seen(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The decisions counted in each slot, by its two codes, and the ones among them."""
    ones = _SHORT.take((codes >> np.uint16(8)).astype(np.intp))
    return _SHORT.take((codes & np.uint16(255)).astype(np.intp)) + ones, ones


def _pieces(table: np.ndarray, at: int):
    """Pieces of a table of (zeros, ones) that hold any, numbered from slot at on."""
    rows = table.reshape(-1, PIECE * 2)
    n = np.flatnonzero(rows.any(axis=1))
    for k in range(0, len(n), 256):
        blobs = [pa.compress(rows[i].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True) for i in n[k : k + 256].tolist()]
        yield pa.RecordBatch.from_pydict({"piece": pa.array(n[k : k + 256] + at // PIECE, pa.int32()), "counts": pa.array(blobs, pa.binary())})


def _totals(pieces: DataFrame) -> DataFrame:
    """One coded piece for all of the same number."""

    def run(batches):
        now, total = None, None

        def coded():
            codes = np.searchsorted(_COUNTS, total * (1 + 1e-9), side="right") - 1
            return pa.RecordBatch.from_pydict({"piece": pa.array([now], pa.int32()), "codes": pa.array([codes.astype(np.uint8).tobytes()], pa.binary())})

        for batch in batches:
            for piece, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if piece != now:
                    if now is not None:
                        yield coded()
                    now, total = piece, np.zeros(PIECE * 2, np.int64)
                raw = pa.decompress(blob, decompressed_size=PIECE * 8, codec="zstd", asbytes=True)
                total += np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0]
        if now is not None:
            yield coded()

    return pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(run, "piece int, codes binary")


# ---- the tree


@dataclass
class Tree:
    """Leaves: the head's words, then the end, then what no group holds, then groups."""

    words: list[bytes]
    group_of: np.ndarray  #: the leaf of each prefix, as a number
    offset: np.ndarray
    nodes: np.ndarray  #: numbered from the heaviest on
    bits: np.ndarray
    chance: np.ndarray  #: of a one, at each node

    @property
    def end(self) -> int:
        return len(self.words)

    @classmethod
    def build(cls, words: list[bytes], counts: list[int], ends: int, groups: dict[bytes, int]) -> Tree:
        weights = [max(1, w) for w in (*counts, ends, 1, *groups.values())]
        n = len(weights)
        heap = list(zip(weights, range(n), strict=True))
        heapq.heapify(heap)
        up, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint8)
        for inner in range(n, 2 * n - 1):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[1]] = up[b[1]] = inner
            side[b[1]] = 1
            weights.append(a[0] + b[0])
            heapq.heappush(heap, (a[0] + b[0], inner))
        root, w = 2 * n - 2, np.array(weights)
        number = np.zeros(2 * n, np.int64)
        number[n + np.argsort(-w[n:], kind="stable")] = np.arange(n - 1)
        # From all leaves upwards at once.
        leaf, at, depth = np.arange(n), np.arange(n), 0
        found = []
        while len(leaf):
            going = at != root
            leaf, at = leaf[going], at[going]
            found.append((leaf, np.full(len(leaf), depth), number[up[at]], side[at]))
            at, depth = up[at], depth + 1
        leaf, depth, nodes, bits = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-depth, leaf))
        leaf, nodes, bits = leaf[order], nodes[order], bits[order]
        own = w[:n][leaf]
        ones, all_ = np.bincount(nodes[bits == 1], own[bits == 1], minlength=n - 1), np.bincount(nodes, own, minlength=n - 1)
        offset = np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=n))])
        group_of = np.full(1 << 16, len(words) + 1, np.int64)
        group_of[[int.from_bytes(g, "big") for g in groups]] = np.arange(len(words) + 2, n)
        return cls(words, group_of, offset, nodes.astype(np.int32), bits, ((ones + 0.4) / (all_ + 0.8)).astype(np.float32))

    def leaf(self, word: bytes) -> int:
        """The leaf of a word that isn't in the head."""
        return int(self.group_of[int.from_bytes(prefix(word), "big")])


@dataclass
class Batch:
    """Tokens of some texts, text by text, each with its end. Numbers: the known words' places, then the end, then others."""

    ids: np.ndarray
    doc: np.ndarray
    others: pa.Array
    leaf_of: np.ndarray  #: of every number


def begins(doc: np.ndarray) -> np.ndarray:
    """Of every token, where its text begins."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    return np.repeat(first, np.diff(first, append=len(doc)))


def contexts(leaf: np.ndarray, doc: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every token: the last of the commonest words before it in its text, and the leaf before it (at first the end)."""
    n = len(leaf)
    place = np.arange(n)
    begin = begins(doc)
    last = np.maximum.accumulate(np.where(leaf < min(CLASSES - 1, end), place, -1))
    last = np.concatenate([[-1], last[:-1]])
    before = np.concatenate([[end], leaf[:-1]])
    return np.where(last >= begin, leaf[np.maximum(last, 0)], CLASSES - 1), np.where(place == begin, end, before)


def decisions(tree: Tree, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every decision: its token's place, its node and its bit."""
    n = (tree.offset[1:] - tree.offset[:-1])[leaf]
    token = np.repeat(np.arange(len(leaf)), n)
    at = np.arange(len(token)) + np.repeat(tree.offset[leaf] - (np.cumsum(n) - n), n)
    return token, tree.nodes.take(at), tree.bits.take(at)


def slots_of_class(last: np.ndarray, token: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Of every decision, its slot with the last of the commonest words."""
    return (last * NODES).take(token) + np.minimum(node, NODES - 1)


def slots_before(before: np.ndarray, token: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Of every decision, its slot with the word before; these tables follow those of classes."""
    mixed = ((before + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).take(token) ^ (node + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - bits)).view(np.int64) + CLASSES * NODES


# ---- spelling


def _bytes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each byte to spell with the six before it, as one number; its word; and its place in it. A space ends a word."""
    pad = max(ORDERS)
    s = np.frombuffer(b"".join(b" " * pad + w + b" " for w in words), np.uint8).astype(np.uint64)
    n = np.array([len(w) + 1 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), n)
    at = np.arange(n.sum()) + pad * (word + 1)
    gram = np.zeros(len(at), np.uint64)
    for k in range(pad, -1, -1):
        gram = gram << np.uint64(8) | s[at - k]
    return gram, word, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


_SPELL_AT = [0, *itertools.accumulate(1 << b for b in SPELL_BITS)]


def _spelled(grams: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Slots (for each of ORDERS, in one row of tables) and bits of the eight decisions of each gram's last byte."""
    byte = grams & np.uint64(255)
    bits = (byte[:, None] >> np.arange(7, -1, -1, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    node = (byte | np.uint64(256))[:, None] >> np.arange(8, 0, -1, dtype=np.uint64)
    out = []
    for order, table, at in zip(ORDERS, SPELL_BITS, _SPELL_AT, strict=False):
        context = grams >> np.uint64(8) & np.uint64((1 << 8 * order) - 1)
        h = (context * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(order))[:, None] ^ node * np.uint64(0x9E3779B97F4A7C15)
        out.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - table)).astype(np.int64) + at)
    return out, bits


def _level(n: np.ndarray) -> np.ndarray:
    """How much has been seen, from 0 to 3."""
    return (n >= 1).view(np.int8) + (n >= 8).view(np.int8) + (n >= 64).view(np.int8)


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, _FLOOR, 1 - _FLOOR)
    return np.log(p / (1 - p))


class State:
    """What each text has taught so far: its own counts by node, weights by gate, and the refinement."""

    def __init__(self, texts: int):
        self.own = np.zeros(2 * texts * (OWN + 1), np.float32)  #: zeros and ones, by turns
        self.weights = np.repeat(np.array(WEIGHTS, np.float32)[:, None], 16 * texts, axis=1)
        self.refined = np.tile((1 / (1 + np.exp(-np.linspace(-6, 6, BUCKETS)))).astype(np.float32), texts)


@dataclass
class Model:
    tree: Tree
    total: int
    distinct: int
    ends: int
    drawn: np.ndarray  #: training tokens of each leaf's group, zero for others
    kinds: np.ndarray  #: different words of these
    bits: int  #: of the table with the word before
    known: np.ndarray  #: hashes of the base head's words, sorted
    count_of: np.ndarray
    leaf_of: np.ndarray
    log_of: np.ndarray  #: of a word within its group, by its count; that it might have been spelled would add next to nothing
    table: np.ndarray | None = None  #: coded counts: with the class, with the word before
    spelling: np.ndarray | None = None  #: coded counts of spelling
    by_class: np.ndarray | None = None  #: chances and log-odds with the class, which the first scoring works out

    @classmethod
    def plain(cls, tree: Tree, head: dict[bytes, int], total: int, distinct: int, ends: int, drawn: np.ndarray, kinds: np.ndarray, bits: int) -> Model:
        """Without tables. head: the base head's counts, the tree's words first."""
        column = pa.array(list(head), pa.binary())
        h, n = hashes(column), len(tree.words)
        count = np.fromiter(head.values(), np.float64, len(head))
        leaf = np.concatenate([np.arange(n), tree.group_of[prefixes(column[n:])]])
        log = np.concatenate([np.zeros(n), np.log10(count[n:] / (drawn + kinds)[leaf[n:]])])
        order = np.argsort(h)
        return cls(tree, total, distinct, ends, drawn, kinds, bits, h[order], count[order], leaf[order], log[order])

    def numbered(self, texts: pa.Array) -> Batch:
        different, at, n = words(texts)
        size = len(self.known)
        h = hashes(different)
        place = np.minimum(np.searchsorted(self.known, h), max(0, size - 1))
        is_known = self.known[place] == h if size else np.zeros(len(h), bool)
        number = np.where(is_known, place, size + np.cumsum(~is_known))
        ids = np.full(len(at) + len(n), size, np.int32)
        is_word = np.ones(len(ids), bool)
        is_word[np.cumsum(n + 1) - 1] = False
        ids[is_word] = number[at]
        others = different.filter(pa.array(~is_known))
        leaf_of = np.concatenate([self.leaf_of, [self.tree.end], self.tree.group_of[prefixes(others)]])
        return Batch(ids, np.repeat(np.arange(len(n), dtype=np.int32), n + 1), others, leaf_of)

    def spell(self, words: list[bytes], skip: np.ndarray) -> np.ndarray:
        """log10 of the probability of each word's spelling, from the byte at place skip on."""
        grams, word, place = _bytes(words)
        keep = place >= skip[word]
        grams, word = grams[keep], word[keep]
        different, inverse = np.unique(grams, return_inverse=True)
        score = np.empty(len(different))
        for k in range(0, len(different), GRAMS):
            at, bits = _spelled(different[k : k + GRAMS])
            p, z = np.float32(0.5), np.float32(0)
            for j, (slot, w) in enumerate(zip(at, SPELL_WEIGHTS, strict=True)):
                n, ones = _seen(self.spelling.take(slot))
                own = SPELL_PRIOR if j else np.float32(0.8)
                p = (ones + own * p) / (n + own)
                z = z + np.float32(w) * _odds(p)
            z = np.clip(z, -LIMIT, LIMIT)
            score[k : k + GRAMS] = -np.logaddexp(0, np.where(bits == 1, -z, z)).sum(axis=1)
        return np.bincount(word, score[inverse], minlength=len(words)) / math.log(10)

    def mix(self, leaf: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token's decisions."""
        if not len(leaf):
            return np.zeros(0)
        n_docs = int(doc[-1]) + 1
        last, before = contexts(leaf, doc, self.tree.end)
        # Texts of like length side by side, the longest first, block by block, so that a step has all its decisions in one piece.
        length = np.bincount(doc, minlength=n_docs)
        rank = np.empty(n_docs, np.int64)
        rank[np.argsort(-length, kind="stable")] = np.arange(n_docs)
        row = rank[doc]
        step = row // SIDE * (int(length.max()) // BLOCK + 1) + (np.arange(len(leaf)) - begins(doc)) // BLOCK
        order = np.argsort(step * SIDE + row % SIDE, kind="stable")
        row, step, leaf, last, before = row[order], step[order], leaf[order], last[order], before[order]
        log_p = np.empty(len(leaf))
        edges = np.append(np.flatnonzero(np.diff(step, prepend=-1)), len(leaf))
        side = row[edges[:-1]] // SIDE
        row %= SIDE
        # Whole steps, of about TOKENS tokens together.
        for steps in np.split(np.arange(len(side)), np.flatnonzero(np.diff(side)) + 1):
            at, end = int(steps[0]), int(steps[-1]) + 1
            state = State(int(row[edges[at + 1] - 1]) + 1)
            while at < end:
                to = min(end, max(at + 1, int(np.searchsorted(edges, edges[at] + TOKENS, side="right")) - 1))
                some = slice(edges[at], edges[to])
                log_p[some] = self._steps(state, leaf[some], last[some], before[some], row[some], edges[at : to + 1] - edges[at])
                at = to
        out = np.empty(len(leaf))
        out[order] = log_p
        return out

    def with_class(self, last: np.ndarray, token: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every decision, the chance of a one with the class, and its log-odds: worked out once for all but the nodes
        that share a slot."""
        own = min(NODES - 1, len(self.tree.chance))
        if self.by_class is None:
            self.by_class = np.empty((CLASSES, own), np.complex64)
            for k, row in enumerate(self.by_class):
                row.real, row.imag = self._with_class(k * NODES + np.arange(own), np.arange(own))
        found = self.by_class.take((last * own).take(token) + np.minimum(node, own - 1))
        p, x = found.real, found.imag
        if own < len(self.tree.chance):
            at = np.flatnonzero(node >= own)
            p[at], x[at] = self._with_class(slots_of_class(last, token[at], node[at]), node[at])
        return p, x

    def _with_class(self, slot: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, ones = _seen(self.table.take(slot))
        p = (ones + PRIORS[0] * self.tree.chance.take(node)) / (n + PRIORS[0])
        return p, _odds(p)

    def _steps(self, state: State, leaf: np.ndarray, last: np.ndarray, before: np.ndarray, row: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token's decisions; edges: where each step's tokens begin."""
        token, node, bit = decisions(self.tree, leaf)
        x = np.empty((3, len(token)), np.float32)
        p, x[0] = self.with_class(last, token, node)
        n, ones = _seen(self.table.take(slots_before(before, token, node, self.bits)))
        p = (ones + PRIORS[1] * p) / (n + PRIORS[1])
        x[1] = _odds(p)
        at = row.take(token)
        gate = at * 16 + 4 * _level(n)
        own_at = at * (OWN + 1) + np.minimum(node, OWN)
        bucket_of = at * BUCKETS
        weights, refined, counts = state.weights, state.refined, state.own
        own = counts.view(np.complex64)
        own_bit = 2 * own_at + bit
        prior = PRIORS[2] * p
        y = bit.astype(np.float32)
        final = np.empty(len(token), np.float32)
        for f, t in itertools.pairwise(np.searchsorted(token, edges).tolist()):
            texts = int(row[token[t - 1]]) + 1
            bits, (v0, v1, v2) = y[f:t], x[:, f:t]
            seen = own.take(own_at[f:t])
            n = seen.real + seen.imag
            v2[:] = _odds((seen.imag + prior[f:t]) / (n + PRIORS[2]))
            g = gate[f:t] + _level(n)
            z = np.clip(v0 * weights[0].take(g) + v1 * weights[1].take(g) + v2 * weights[2].take(g), -LIMIT, LIMIT)
            q = 1 / (1 + np.exp(-z))
            bucket = bucket_of[f:t] + np.clip((z + 6) * ((BUCKETS - 1) / 12) + 0.5, 0, BUCKETS - 1).astype(np.int32)
            final[f:t] = np.abs(0.75 * q + 0.25 * refined.take(bucket) + bits - 1)
            # Towards less error, at most as far as the curvature of all inputs together allows.
            error = bits - q
            steep = np.bincount(g, q * (1 - q) * (v0 * v0 + v1 * v1 + v2 * v2), minlength=16 * texts) + STILL
            for j, v in enumerate((v0, v1, v2)):
                weights[j, : 16 * texts] += RATE * np.bincount(g, error * v, minlength=16 * texts) / steep
            size = BUCKETS * texts
            k = np.bincount(2 * bucket + bit[f:t], minlength=2 * size).reshape(-1, 2)
            n = k[:, 0] + k[:, 1]
            refined[:size] += (k[:, 1] - n * refined[:size]) / (n + STILL)
            size = texts * (OWN + 1)
            np.add.at(counts, own_bit[f:t], np.float32(1))
            own[OWN : size : OWN + 1] = 0
        return np.bincount(token, np.log(np.maximum(final, _FLOOR)), minlength=len(leaf)) / math.log(10)

    def score(self, texts: pa.Array) -> dict[str, pa.Array]:
        batch = self.numbered(texts)
        size, known = len(texts), len(self.known)
        log_p = self.mix(batch.leaf_of[batch.ids], batch.doc)
        new = batch.ids > known
        at = np.minimum(batch.ids, known)
        c = np.where(new, 0, np.append(self.count_of, self.ends)[at])
        local = np.where(new, 0, np.append(self.log_of, 0)[at])
        total = lambda x: np.bincount(batch.doc, x, minlength=size)
        # Words to look up in all counts, once for each text.
        n = len(batch.others)
        of = batch.leaf_of[known + 1 :]
        if n:
            others = batch.others.to_pylist()
            spelled = self.spell(others, np.where(of == self.tree.end + 1, 0, np.minimum(2, pc.binary_length(batch.others).to_numpy() + 1)))
        one = 1 / np.maximum(1, self.drawn[of] + self.kinds[of])
        old, fresh = np.where(self.drawn[of] > 0, one, 0), np.where(self.drawn[of] > 0, one * self.kinds[of], 1)
        pair, times = np.unique(batch.doc[new].astype(np.int64) * n + batch.ids[new] - known - 1, return_counts=True)
        doc, i = pair // max(1, n), pair % max(1, n)
        columns = [batch.others.take(pa.array(i)), pa.array(times, pa.int32()), *(pa.array(x[i], pa.float64()) for x in (spelled if n else one, old, fresh))]
        rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(size + 1)), pa.int32()), pa.StructArray.from_arrays(columns, ["word", "times", "spelled", "old", "new"]))
        return {
            "n_tokens": pa.array(total(None), pa.int64()),
            "n_head": pa.array(total(c > 0).astype(np.int64)),
            "log_head": pa.array(total(np.where(new, 0, np.log10(c + 1)))),
            "score": pa.array(total(log_p + local)),
            "rest": rest,
        }


def _parts(batch: pa.RecordBatch, column: int):
    """Slices of batch of about PART bytes of text and at most ROWS rows. A larger text is a slice of its own."""
    start = total = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if k - start == ROWS or total and total + n > PART:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _word_counts(training: DataFrame) -> DataFrame:
    """word (binary) and c, over all training texts; the end is the word of a single space."""

    def count(batches):
        for batch in batches:
            for part in _parts(batch, 0):
                different, at, n = words(part.column(0))
                c = np.bincount(at, minlength=len(different)).tolist()
                yield pa.RecordBatch.from_pydict({"word": pa.concat_arrays([different, pa.array([b" "], pa.binary())]), "c": pa.array([*c, len(n)], pa.int64())})

    return training.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _fewer(rows: DataFrame) -> DataFrame:
    """A fourth of the partitions: each sends tables of the same size, however few its words."""
    return rows.coalesce(max(1, rows.rdd.getNumPartitions() // 4))


class Slots:
    """Counts (zeros, ones) by slot. Each decision is added in its place, so its cost doesn't grow with the table."""

    def __init__(self, size: int):
        self.table = np.zeros(size * 2, np.uint32)

    def add(self, slot: np.ndarray, bit: np.ndarray, times: np.ndarray | None = None) -> None:
        at = slot.reshape(-1).astype(np.intp) * 2 + bit.reshape(-1)
        np.add.at(self.table, at, np.uint32(1) if times is None else times.astype(np.uint32))


def _common(counts: DataFrame) -> tuple[dict[bytes, int], int, int]:
    """The counts of the BASE_HEAD commonest words at most (all words of a level of counts, 64 levels a doubling, or none
    of it), and tokens and different words in all."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("c")).collect()
    least, n = 1 << 30, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        if (n := n + r["words"]) > BASE_HEAD:
            break
        least = r["level"]
    head = {bytes(w): c for w, c in counts.filter(level >= least).collect()}
    return head, sum(r["c"] for r in levels), sum(r["words"] for r in levels)


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the table of all counts (word, c), from the documents that aren't held out."""
    training = docs.select("doc_id", "text").filter(~held_out())
    counts = saved(_word_counts(training), "counts")
    head, total, distinct = _common(counts)
    end = F.lit(bytearray(b" "))
    if b" " not in head and total:
        head[b" "] = counts.filter(F.col("word") == end).agg(F.sum("c")).first()[0]
    ends = head.pop(b" ", 0)
    head = dict(sorted(head.items(), key=lambda x: (-x[1], x[0])))
    top = list(head.items())[:HEAD]
    # At most 65,536 groups, whatever the words.
    groups = {bytes(g): [c, n] for g, c, n in counts.filter(F.col("word") != end).groupBy(F.substring(F.concat("word", end), 1, 2).alias("g")).agg(F.sum("c"), F.count(F.lit(1))).collect()}
    for w, c in top:
        g = groups[prefix(w)]
        g[0], g[1] = g[0] - c, g[1] - 1
    groups = {g: groups[g] for g in sorted(groups) if groups[g][1]}
    tree = Tree.build([w for w, _ in top], [c for _, c in top], ends, {g: c for g, (c, _) in groups.items()})
    drawn, kinds = (np.concatenate([np.zeros(len(top) + 2), np.array([x[k] for x in groups.values()], float)]) for k in (0, 1))
    bits = min(MOST_BITS, max(LEAST_BITS, int(total).bit_length() + 2))
    size = CLASSES * NODES + (1 << bits)
    model = Model.plain(tree, head, total, distinct, ends, drawn, kinds, bits)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def learn(batches):
        tree, found = sent.value.tree, Slots(size)
        # With a class: the leaves are counted, and their decisions taken once.
        leaves = len(tree.offset) - 1
        by_class = np.zeros(CLASSES * leaves, np.int64)
        for batch in batches:
            for part in _parts(batch, 0):
                got = sent.value.numbered(part.column(0))
                leaf = got.leaf_of[got.ids]
                last, before = contexts(leaf, got.doc, tree.end)
                by_class += np.bincount(last * leaves + leaf, minlength=len(by_class))
                for k in range(0, len(leaf), TOKENS):
                    token, node, bit = decisions(tree, leaf[k : k + TOKENS])
                    found.add(slots_before(before[k : k + TOKENS], token, node, bits), bit)
        seen = np.flatnonzero(by_class)
        for k in range(0, len(seen), TOKENS):
            some = seen[k : k + TOKENS]
            token, node, bit = decisions(tree, some % leaves)
            found.add(slots_of_class(some // leaves, token, node), bit, by_class[some][token])
        yield from _pieces(found.table, 0)

    def learn_spelling(batches):
        found = Slots(_SPELL_AT[-1])
        for batch in batches:
            some = [w for w in batch.column(0).to_pylist() if w != b" "]
            for k in range(0, len(some), GRAMS):
                at, bit = _spelled(_bytes(some[k : k + GRAMS])[0])
                for slot in at:
                    found.add(slot, bit)
        yield from _pieces(found.table, size)

    shape = "piece int, counts binary"
    learnt = training.select("text").mapInArrow(learn, shape).unionByName(_fewer(counts.select("word")).mapInArrow(learn_spelling, shape))
    codes = np.zeros((size + _SPELL_AT[-1]) // PIECE * PIECE, np.uint16).reshape(-1, PIECE)
    for piece, blob in zip(*(c.to_pylist() for c in _totals(learnt).toArrow().columns), strict=True):
        codes[piece] = np.frombuffer(blob, np.uint16)
    codes = codes.reshape(-1)
    model.table, model.spelling = codes[:size].copy(), codes[size:].copy()
    return model, counts


_REST = "array<struct<word:binary,times:int,spelled:double,old:double,new:double>>"
_SCORED = f"rid long, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_head long, log_head double, score double, rest {_REST}"


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    A null or empty text has its end as only token (bits_per_byte is null: there are no bytes). A null doc_id stays
    null and isn't held out; repeated rows give repeated results; without training documents base scores are 0 and
    the model spells everything from even odds. Columns other than doc_id and text aren't looked at. Within its group a
    word of the base head is scored by its count, without the chance that it had been spelled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in _parts(batch, 2):
                texts = part.column(2)
                ids = pa.array(range(rid, rid + len(texts)), pa.int64())
                rid += len(texts)
                columns = {"rid": ids, "doc_id": part.column(0), "held_out": part.column(1), "n_bytes": pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())}
                yield pa.RecordBatch.from_pydict(columns | sent.value.score(texts))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    scored = saved(rows.mapInArrow(run, _SCORED), "scored")
    c = F.coalesce("c", F.lit(0))
    drawn = F.col("times") * F.log10(F.col("old") * c + F.col("new") * F.pow(F.lit(10.0), F.col("spelled")))
    # A chance too small for a double keeps the spelling's logarithm.
    drawn = F.when(c > 0, drawn).otherwise(F.col("times") * (F.log10("new") + F.col("spelled")))
    rest = scored.select("rid", F.inline("rest")).join(counts, "word", "left").groupBy("rid").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("n_rest"), F.sum(F.col("times") * F.log10(c + 1)).alias("log_rest"), F.sum(drawn).alias("drawn"))
    base = F.col("log_head") + F.coalesce("log_rest", F.lit(0.0)) - F.col("n_tokens") * math.log10(model.total + model.distinct + 1)
    whole = F.col("score") + F.coalesce("drawn", F.lit(0.0))
    return scored.join(rest, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rest", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        whole.alias("score"),
        F.when(F.col("n_bytes") > 0, -whole * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
