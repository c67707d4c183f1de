"""The encoder of op1 against the library, and what a worker keeps."""

import tracemalloc

import numpy as np
import public_tokenizers

from leafmill.llm import byte_bpe

BPE = public_tokenizers.path("byte_bpe_50k.json")


def same(encoder: byte_bpe.Encoder, texts: list[str]) -> bool:
    want = [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
    return [x.tolist() for x in encoder.encode(texts)] == want


def test_pieces_kept_are_few_and_short(monkeypatch):
    enc = byte_bpe.Encoder(BPE)
    assert same(enc, ["y" * 70_000, "z" * 50_000 + " end"])
    assert max(map(len, enc.known), default=0) <= 100
    # What is over the bound costs nothing once encoded, nor a copy of what is kept.
    monkeypatch.setattr(byte_bpe, "KEEP", 100_000)
    letters = np.random.default_rng(3).integers(97, 123, (120_000, 8)).astype(np.uint8)
    words = [bytes(w).decode() for w in letters]
    enc.encode([" ".join(words[:110_000])])
    assert len(enc.known) <= 100_000
    tracemalloc.start()
    got = same(enc, [" ".join(words[110_000:110_100])])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got and peak < 2_000_000


def test_pieces_are_the_librarys():
    """Cut many texts at once as the library cuts each: space of all kinds, apostrophes, letters of one and two bytes."""
    enc, rng = byte_bpe.Encoder(BPE), np.random.default_rng(7)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x85", "\xa0", "\x00", "\x1c", "\x1f", "'", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "'r", "'l", "''", "a", "bc", "The", "é", "ǆ", "ɏ", "ª", "²", "½", "7", "42", ".", "!!", "—", "’", "€", "×", "<|endoftext|>", "漢", "ɐ", " ", "😀"]
    texts = ["", "'", "'s", "s", " ", "'l", "'r"]
    for k in (4, 12):
        texts += ["".join(parts[i] for i in rng.integers(0, len(parts) - 4 * (j % 4 > 0), k)) for j in range(6000)]
    assert same(enc, texts)
    cuts = enc.library.pre_tokenizer.pre_tokenize_str
    plain = [t for t in texts if not byte_bpe._OTHER.search(t)]
    ends = np.cumsum([len(t.encode()) for t in plain])
    data = "".join(plain).encode()
    got = byte_bpe.starts(data, ends - [len(t.encode()) for t in plain])
    assert len(got) == sum(len(cuts(t)) for t in plain)
