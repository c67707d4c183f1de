"""Byte-level BPE by the tokenizers library, with a bounded memory of words already encoded.

The library first cuts a text at fixed places (its word pattern) and then encodes each piece by itself. Texts of Latin
script are cut here, by the classes of their characters and many texts at once, and every different piece goes to the
library once, or once for every call after KEEP others; texts with any other character are handed to the library whole,
so no result depends on two libraries agreeing about Unicode.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa

#: Pieces kept by a worker, of at most so many bytes, which take about 200 each. Others are encoded again.
KEEP, LONGEST = 500_000, 40


#: Texts are cut in groups of about so many characters, which bounds a worker's memory.
GROUP = 3 << 20
#: Classes of characters: what is none of the others, letters, numbers, space.
_MARK, _LETTER, _NUMBER, _SPACE = range(4)


def _classes() -> np.ndarray:
    """Of the first 0x250 characters."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    of = np.array([kinds.get(unicodedata.category(chr(c))[0], _MARK) for c in range(0x250)], np.uint8)
    of[[*range(9, 14), 32, 0x85, 0xA0]] = _SPACE
    return of


_CLASS = _classes()
#: Of bytes; those of longer characters are marks at first.
_OF_BYTE = _CLASS[:128].tobytes() + bytes(128)
_OTHER = re.compile(r"[^\x00-ɏ‐-‧‰-⁞₠-₿]")


def starts(text: bytes, texts: np.ndarray) -> np.ndarray:
    """Where the pieces of byte-level BPE begin (a fixed pattern of the published format) in texts that _OTHER doesn't match.
    text: all of them in UTF-8, one after another; texts: where each begins.

    A run of letters, of numbers or of marks is a piece, with the space character right before it. A run of space is a
    piece up to its last character if anything follows in its text; that character is one too, unless it is a space
    character. An apostrophe by itself, not after a space character, takes s, t, m, d, re, ve or ll after it along.
    """
    data = np.frombuffer(text, np.uint8)
    of = np.frombuffer(bytearray(text.translate(_OF_BYTE)), np.uint8)
    two = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
    of[two] = of[two + 1] = _CLASS[(data[two].astype(np.intp) & 31) << 6 | data[two + 1] & 63]
    begins = np.ones(len(data) + 4, bool)
    np.not_equal(of[1:], of[:-1], out=begins[1 : len(data)])
    first = np.zeros(len(data) + 4, bool)
    first[texts] = True
    first[len(data) :] = True
    # Apostrophes, before runs of space move what begins.
    at = np.flatnonzero(data == 39)
    at = at[(begins[at] | first[at]) & (first[at] | (data[at - 1] != 32)) & ~first[at + 1]]
    more = np.append(data, np.zeros(4, np.uint8))
    one, other = more[at + 1], more[at + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ~first[at + 2] & ((np.isin(one, np.frombuffer(b"rv", np.uint8)) & (other == 101)) | ((one == 108) & (other == 108)))
    # Runs of space that something follows in the same text.
    after = np.flatnonzero(begins[1 : len(data)] & (of[:-1] == _SPACE)) + 1
    after = after[~first[after]]
    last = data[after - 1]
    begins[after[last == 32]] = False
    begins[after - 1 - (last >= 0x80)] = True
    begins[at[short | long] + 1] = False
    begins[at[short] + 2] = True
    begins[at[long] + 3] = True
    return np.flatnonzero(begins[: len(data)] | first[: len(data)])


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[bytes, bytes] = {}
        ids = self.library.encode("\n", add_special_tokens=False).ids
        self.line = ids[0] if len(ids) == 1 else None

    def _encoded(self, pieces: list[str]):
        """Pairs of a piece and its ids' bytes. Many are sent as lines of one text: a line's end is a piece and an id of its
        own, which no other piece holds, so what stands between two of them is the piece's encoding. Pieces of space go alone."""
        alone = [p for p in pieces if p.isspace()] if self.line is not None else pieces
        lines = [p for p in pieces if not p.isspace()] if self.line is not None else []
        parts = [lines[k : k + 500] for k in range(0, len(lines), 500)]
        for k in range(0, len(parts), 50):
            some = parts[k : k + 50]
            for part, e in zip(some, self.library.encode_batch_fast(["\n".join(p) for p in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = np.flatnonzero(ids == self.line)
                if len(ends) != len(part) - 1:
                    alone += part
                    continue
                data = ids.tobytes()
                begins = [0, *(4 * ends + 4).tolist()]
                yield from zip(part, (data[x:y] for x, y in zip(begins, [*(4 * ends).tolist(), len(data)], strict=True)), strict=True)
        for k in range(0, len(alone), 10_000):
            part = alone[k : k + 10_000]
            for p, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                yield p, np.array(e.ids, "<u4").tobytes()

    def _cut(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each of some texts that _OTHER doesn't match."""
        data, known = b"".join(texts), self.known
        if not data:
            return [np.zeros(0, "<u4") for _ in texts]
        ends = np.cumsum([len(t) for t in texts])
        begins = starts(data, ends - [len(t) for t in texts])
        offsets = pa.py_buffer(np.append(begins, len(data)).astype(np.int32))
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        different, at = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy()
        values = list(map(known.get, different))
        missing = [i for i, v in enumerate(values) if v is None]
        place = {different[i].decode(): i for i in missing}
        for piece, ids in self._encoded(list(place)):
            values[i := place[piece]] = ids
            if len(known) < KEEP and len(different[i]) <= LONGEST:
                known[different[i]] = ids
        # All ids, piece by piece.
        n = np.fromiter(map(len, values), np.intp, len(values)) // 4
        begin, n_at = (np.cumsum(n) - n)[at], n[at]
        to = np.cumsum(n_at)
        ids = np.frombuffer(b"".join(values), "<u4")[np.repeat(begin - (to - n_at), n_at) + np.arange(to[-1])]
        return np.split(ids, np.append(0, to)[np.searchsorted(begins, ends[:-1])])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (unsigned 32 bits) of each text."""
        out: list[np.ndarray] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if not t.isascii() and _OTHER.search(t)]
        if whole:
            for i, e in zip(whole, self.library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4")
        rest = [i for i in range(len(texts)) if out[i] is None]
        group, size = [], 0
        for i in rest:
            group.append(i)
            size += len(texts[i])
            if size > GROUP or i == rest[-1]:
                for j, ids in zip(group, self._cut([texts[j].encode() for j in group]), strict=True):
                    out[j] = ids
                group, size = [], 0
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
