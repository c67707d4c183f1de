"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The vocabulary is a BPE model, whose encoding of a string is the only sequence of pieces in which every two neighbours
are compatible: encoded together, they give themselves. As a max-plus problem an arc between compatible neighbours
weighs 0 and any other minus infinity; the best path is the encoding, not an approximation of it.

A document of more than GIANT characters is split into chunks of about CHUNK. The state at a cut is the piece that
covers the character before it and where that piece ends. Each chunk gives, for every state at its left and every state
at its right cut, the weight of the best path between them; these matrices are combined associatively, which settles
the state at every cut; then each chunk is traced back by itself. No piece goes on with a space after another
character, so where a space is near a cut is put before it: it has a single state, the matrix is 1 x 1, and inside the
chunk the library encodes as usual. Only long runs without spaces need more states.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices

GIANT, CHUNK, NEAR = 65_536, 32_768, 512
KEEP = 200_000
SPACE = "▁"
#: A segment: spaces and what follows up to the next space. Segments are encoded independently of each other.
_SEGMENT = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
_EDGE = re.compile(f"[^ {SPACE}](?=[ {SPACE}])")

State = tuple[str, int]  #: the piece at a cut, and by how many characters it goes beyond
CLEAN: State = ("", 0)


class Pieces:
    """A model with what the scan needs of it."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces of this model go on over spaces")
        self.score = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        is_byte = {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.spelled = [is_byte.get(i, b"" if special[i] else p.replace(SPACE, " ").encode()) for i, p in enumerate(names)]
        self.known: dict[str, bytes] = {}
        self.compatible = functools.lru_cache(1 << 20)(self._compatible)

    def ids_of(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode()]

    def merged(self, s: str) -> list[str]:
        """BPE of a short string whose spaces are written as the space piece."""
        parts = list(s)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], -np.inf), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _compatible(self, a: str, b: str) -> bool:
        return self.merged(a + b) == [x for x in (a, b) if x]

    def encode_segments(self, texts: list[str], first: list[bool]) -> list[np.ndarray]:
        """Ids of each text. first: it begins a document; else it begins with a space, which is the library's own."""
        cut = []
        for text, begins in zip(texts, first, strict=True):
            keys = [s[1:] for s in _SEGMENT.findall(text)]
            if begins and keys:
                keys[0] = _SEGMENT.match(text)[0]
            cut.append(keys)
        known = self.known
        missing = list({k for keys in cut for k in keys if k not in known})
        if len(known) + len(missing) > KEEP:
            known = dict(known)
        for k in range(0, len(missing), 10_000):
            part = missing[k : k + 10_000]
            for key, ids in zip(part, self.library.encode(part, num_threads=1), strict=True):
                known[key] = np.array(ids if key else [self.ids[SPACE]], "<u4").tobytes()
        return [np.frombuffer(b"".join([known[k] for k in keys]), "<u4") for keys in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters, as in the library."""
        text = b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def states(self, before: str, after: str) -> list[State]:
        """All states at a cut between before and after (normalised, ``longest`` characters of each)."""
        if not after or after[0] == SPACE and before[-1:] != SPACE:
            return [CLEAN]
        out = []
        for i in range(1, len(before) + 1):
            for j in range(0, min(len(after), self.longest - i) + 1):
                p = before[len(before) - i :] + after[:j]
                if p in self.ids or len(p) == 1:
                    out.append((p, j))
        return out

    def paths(self, start: State, text: str, after: str) -> dict[int, str]:
        """From start: for every place in text (and a piece beyond, in after) that a valid sequence reaches, its last piece."""
        s, last = text + after[: self.longest], {start[1]: start[0]}
        for p in range(start[1] + 1, len(s) + 1):
            for n in range(min(self.longest, p - start[1]), 0, -1):
                u = s[p - n : p]
                if p - n in last and p - n < max(1, len(text)) and (u in self.ids or n == 1) and self.compatible(last[p - n], u):
                    last[p] = u
                    break
        return last

    def matrix(self, lefts: list[State], rights: list[State], text: str, after: str) -> list[list[float]]:
        """Weights of the best paths over text from each state at its left to each at its right."""
        if lefts == [CLEAN] and rights == [CLEAN]:
            return [[0.0]]
        out = []
        for left in lefts:
            last = self.paths(left, text, after)
            row = []
            for piece, j in rights:
                end = len(text) + j
                row.append(0.0 if end in last and (piece == "" or last[end] == piece) else -np.inf)
            out.append(row)
        return out

    def trace(self, left: State, right: State, text: str, after: str) -> list[int]:
        """Ids of the pieces that begin in text, on the path between the two states."""
        last, p, out = self.paths(left, text, after), len(text) + right[1], []
        while p > left[1]:
            out.append(last[p])
            p -= len(last[p])
        return [i for piece in reversed(out) for i in self.ids_of(piece)]


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One for each worker process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def cut_places(text: str, chunk: int = CHUNK, near: int = NEAR) -> list[int]:
    """Where text is cut: before a space if there is one near, else wherever it is."""
    out, at = [], chunk
    while at < len(text):
        m = _EDGE.search(text, max(at, 1) - 1, min(len(text), at + near))
        out.append(m.end() if m else at)
        at = out[-1] + chunk
    return [0, *out, len(text)]


def product(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    """The max-plus product of two matrices, which is associative."""
    return [[max(x + y for x, y in zip(row, col, strict=True)) for col in zip(*b, strict=True)] for row in a]


def settle(matrices: list[list[list[float]]]) -> list[int]:
    """The state's index at every inner cut on the best path, by products over halves."""

    @functools.cache
    def whole(lo: int, hi: int) -> list[list[float]]:
        return matrices[lo] if hi - lo == 1 else product(whole(lo, (lo + hi) // 2), whole((lo + hi) // 2, hi))

    out: dict[int, int] = {}

    def descend(lo: int, hi: int, left: int, right: int) -> None:
        if hi - lo > 1:
            mid = (lo + hi) // 2
            a, b = whole(lo, mid)[left], [row[right] for row in whole(mid, hi)]
            out[mid] = max(range(len(b)), key=lambda s: a[s] + b[s])
            descend(lo, mid, left, out[mid])
            descend(mid, hi, out[mid], right)

    descend(0, len(matrices), 0, 0)
    return [out[k] for k in range(1, len(matrices))]


_IDS = pa.list_(pa.int32())
_STATE = pa.struct([("piece", pa.string()), ("beyond", pa.int32())])
_CHUNK = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("text_crc32", pa.int64()), ("k", pa.int32()), ("text", pa.string()), ("after", pa.string()), ("lefts", pa.list_(_STATE)), ("rights", pa.list_(_STATE)), ("weights", pa.list_(pa.list_(pa.float64())))])
_STATE_SQL = "struct<piece:string,beyond:int>"


def _small(docs: DataFrame, path: str, check: bool = False) -> DataFrame:
    """doc_id, text_crc32, ids; with check instead doc_id, ids, ids_crc32, exact: decoded at once, by the same worker."""

    def encode(batches):
        model = pieces(path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = model.encode_segments(texts, [True] * len(texts))
            flat = pa.array(np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, flat)
            if check:
                crcs = pa.array([zlib.crc32(f.astype("<u4").tobytes()) for f in found], pa.int64())
                exact = pa.array([model.decode(f) == t for f, t in zip(found, texts, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, crcs, exact], names=["doc_id", "ids", "ids_crc32", "exact"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), ids], names=["doc_id", "text_crc32", "ids"])

    return docs.mapInArrow(encode, "doc_id long, ids array<int>, ids_crc32 long, exact boolean" if check else "doc_id long, text_crc32 long, ids array<int>")


def _giant(docs: DataFrame, path: str, chunk: int, near: int) -> DataFrame:
    def split(batches):
        """Chunk texts keep what is needed to encode them: spaces as they are, and what follows the cut."""
        for batch in batches:
            for rid, doc_id, text, crc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = cut_places(text, max(chunk, 128), near)
                rows = [{"rid": rid, "doc_id": doc_id, "text_crc32": crc, "k": k, "text": text[a:b], "before": f" {text[:a]}"[-64:] if a < 64 else text[a - 64 : a], "after": text[b : b + 64]} for k, (a, b) in enumerate(itertools.pairwise(at))]
                for j in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_pylist(rows[j : j + 64], pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("text_crc32", pa.int64()), ("k", pa.int32()), ("text", pa.string()), ("before", pa.string()), ("after", pa.string())]))

    def weigh(batches):
        model = pieces(path)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                before, text, after = (r[n].replace(" ", SPACE) for n in ("before", "text", "after"))
                # The library's space before a document stands where the document begins.
                lefts = model.states(before[-model.longest :], text[: model.longest]) if r["k"] else [CLEAN]
                text = text if r["k"] else SPACE + text
                rights = model.states((before + r["text"].replace(" ", SPACE))[-model.longest :], after[: model.longest])
                weights = model.matrix(lefts, rights, text, after)
                dicts = [[{"piece": p, "beyond": j} for p, j in x] for x in (lefts, rights)]
                out.append({n: r[n] for n in ("rid", "doc_id", "text_crc32", "k", "text", "after")} | {"lefts": dicts[0], "rights": dicts[1], "weights": weights})
            yield pa.RecordBatch.from_pylist(out, _CHUNK)

    def choose(batches):
        for batch in batches:
            for rid, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = [0, *settle([p["weights"] for p in parts]), 0]
                rows = [{"rid": rid, "k": p["k"], "left": p["lefts"][a], "right": p["rights"][b]} for p, (a, b) in zip(parts, itertools.pairwise(at), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("rid", pa.int64()), ("k", pa.int32()), ("left", _STATE), ("right", _STATE)]))

    def trace(batches):
        model = pieces(path)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                left, right = (tuple(r[n].values()) for n in ("left", "right"))
                if left == CLEAN == right:
                    ids = model.encode_segments([r["text"]], [r["k"] == 0])[0].tolist()
                else:
                    text = r["text"].replace(" ", SPACE)
                    ids = model.trace(left, right, text if r["k"] else SPACE + text, r["after"].replace(" ", SPACE))
                out.append({"rid": r["rid"], "doc_id": r["doc_id"], "text_crc32": r["text_crc32"], "k": r["k"], "ids": ids})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("text_crc32", pa.int64()), ("k", pa.int32()), ("ids", _IDS)]))

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", "text_crc32")
    chunks = saved(rows.mapInArrow(split, "rid long, doc_id long, text_crc32 long, k int, text string, before string, after string"), "chunks")
    weighed = chunks.repartition("rid", "k").mapInArrow(weigh, f"rid long, doc_id long, text_crc32 long, k int, text string, after string, lefts array<{_STATE_SQL}>, rights array<{_STATE_SQL}>, weights array<array<double>>")
    weighed = saved(weighed, "weighed")
    grouped = weighed.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("k", "lefts", "rights", "weights"))).alias("parts"))
    chosen = grouped.mapInArrow(choose, f"rid long, k int, left {_STATE_SQL}, right {_STATE_SQL}")
    traced = weighed.select("rid", "doc_id", "text_crc32", "k", "text", "after").join(chosen, ["rid", "k"]).mapInArrow(trace, "rid long, doc_id long, text_crc32 long, k int, ids array<int>")
    whole = traced.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("text_crc32").alias("text_crc32"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    return whole.select("doc_id", "text_crc32", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def encode(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK, near: int = NEAR) -> DataFrame:
    """doc_id, text_crc32 and ids (array of int) of every document, as the library gives them for the whole text.

    A null or empty text has no ids; a null doc_id stays null; repeated rows give repeated results; an empty table gives
    none; columns other than doc_id and text aren't looked at. A document's ids are one row, whatever its length.
    """
    small, large = _by_size(docs, giant)
    return _small(small, path).unionByName(_giant(large, path, chunk, near))


def _by_size(docs: DataFrame, giant: int) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"))
    large = F.coalesce(F.char_length("text") > giant, F.lit(False))
    return rows.filter(~large), rows.filter(large)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded's doc_id, text_crc32 and ids with ``text``, decoded, and ``ids_crc32`` (of ids as little-endian 32-bit integers). Null ids give an empty text."""

    def spell(batches):
        model = pieces(path)
        for batch in slices(batches):
            texts, crcs = [], []
            for x in batch.column(2):
                ids = x.values.to_numpy() if x.is_valid else np.empty(0, np.int32)
                texts.append(model.decode(ids))
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(crcs, pa.int64())], names=["doc_id", "text_crc32", "ids", "text", "ids_crc32"])

    return encoded.select("doc_id", "text_crc32", "ids").mapInArrow(spell, "doc_id long, text_crc32 long, ids array<int>, text string, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK, near: int = NEAR) -> DataFrame:
    """doc_id, n_ids, ids, ids_crc32 and exact: the ids decode to the document's text (of a giant one: to its CRC-32)."""
    small, large = _by_size(docs, giant)
    back = decode(_giant(large, path, chunk, near), path).select("doc_id", "ids", "ids_crc32", (F.crc32("text") == F.col("text_crc32")).alias("exact"))
    return _small(small, path, check=True).unionByName(back).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "ids_crc32", "exact")
