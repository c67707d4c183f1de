"""Language identification by interpolated Kneser-Ney character models.

A text is lower-cased and cut into words of letters; each language has a model of a word's characters, its end included,
given up to ORDER - 1 characters before, starting anew with each word. Counts of the highest order are occurrences, of
lower orders different continuations to the left; discounts are n1 / (n1 + 2 * n2) of each order. The n-grams of all
languages are stored together: for each order a sorted array of 64-bit hashes beside a matrix of log-probabilities, a
column a language, and the same for contexts and their back-off weights.

The language of the lowest cross-entropy per character is chosen. Rejection is calibrated on texts that the counts don't
have, cut into pieces of some length: a text is rejected if its cross-entropy is above what all but FALSE_REJECTION of the
pieces of its language and of its class of length have. Shorter texts than the least of LENGTHS are never rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

ORDER = 5
#: The bounded sample for fitting: at most so many different texts a language, and about so many bytes of them in all
#: languages together, each text of at most so many bytes, whole. The driver gets about twice that.
TEXTS_PER_LANGUAGE, SAMPLE_BYTES, TEXT_BYTES = 400, 12_000_000, 100_000
#: Of texts in a learnt language at most about this part is rejected; classes of length, in scored characters.
FALSE_REJECTION, LENGTHS = 0.001, (24, 48, 96, 192, 384)
#: Fewer pieces than this say nothing about a class: it takes the limit of the next shorter one.
ENOUGH = 200
#: Of the sample every fourth text is kept from the counts, for the thresholds.
CALIBRATION = 4
#: Confidence grows with a text's length up to so many characters.
SURE = 40

_WORD = re.compile(r"[^\W\d_]+")
_START, _END = "\x02", "\x03"
_RNG = np.random.default_rng(7)
_FACTOR = _RNG.integers(1, 2**63, ORDER + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _slices(text: str, size: int = 1 << 20):
    """text in pieces of about size, cut at spaces where there are any."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind(" ", at, at + size) + 1
        cut = cut if cut > at else at + size
        yield text[at:cut]
        at = cut
    yield text[at:]


def _words(text: str) -> list[str]:
    """Lower-case runs of letters. Other numerals than digits (a half, a Roman two) aren't letters."""
    found = _WORD.findall(text.lower())
    if text.isascii():
        return found
    return [v for w in found for v in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def _hashed(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of every scored place in words: its word, its n-gram hashes and context hashes of orders 1 to ORDER."""
    pad = _START * (ORDER - 1)
    s = np.frombuffer("".join(f"{pad}{w}{_END}" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    places = np.flatnonzero(s != ord(_START))
    lengths = np.array([len(w) + 1 for w in words])
    context, grams, contexts = np.zeros(len(places), np.uint64), [], []
    for k in range(1, ORDER + 1):
        if k > 1:
            context = context + (s[places - (k - 1)] + np.uint64(1)) * _FACTOR[k]
        h = context + s[places] * _FACTOR[1]
        for x, out in ((h, grams), (context * np.uint64(3) + np.uint64(k), contexts)):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            out.append(x ^ (x >> np.uint64(29)))
    return np.repeat(np.arange(len(words)), lengths), grams, contexts


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in the sorted keys, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]
    log_p: list[np.ndarray]
    contexts: list[np.ndarray]
    log_backoff: list[np.ndarray]
    floor: float
    limits: np.ndarray  #: of each language and class of length

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each word in each language, and its scored characters."""
        n = np.array([len(w) + 1 for w in words])
        total = np.zeros((len(words), len(self.languages)))
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            word, grams, contexts = _hashed(part)
            score = np.zeros((len(word), len(self.languages)), np.float32)
            left = np.arange(len(word))
            for order in range(ORDER - 1, -1, -1):
                at, there = _find(self.grams[order], grams[order][left])
                score[left[there]] += self.log_p[order][at[there]]
                left = left[~there]
                if len(left):
                    at, there = _find(self.contexts[order], contexts[order][left])
                    score[left[there]] += self.log_backoff[order][at[there]]
            score[left] += self.floor
            begins = np.concatenate([[0], np.cumsum(n[k : k + len(part)])[:-1]])
            total[k : k + len(part)] = np.add.reduceat(score.astype(np.float64), begins, axis=0)
        return total, n

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: cross-entropies per scored character (a column a language), and scored characters."""
        total, chars = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        pieces = [(t, piece) for t, text in enumerate(texts) for piece in _slices(text or "")]
        while pieces:
            number: dict[str, int] = {}
            group, size = [], 0
            while pieces and size < 1 << 21:
                t, piece = pieces.pop()
                size += len(piece)
                words = _words(piece)
                if words:
                    group.append((t, np.array([number.setdefault(w, len(number)) for w in words])))
            scores, n = self.words(list(number))
            for t, ids in group:
                total[t] += scores[ids].sum(axis=0)
                chars[t] += n[ids].sum()
        return -total / np.maximum(chars, 1)[:, None], chars

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language, a confidence from 0 to 1, and whether it is rejected, of each text."""
        entropy, chars = self.texts(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(best)), best]
        odds = np.exp((least[:, None] - entropy) * np.minimum(chars, SURE)[:, None])
        score = np.where(chars > 0, 1 / odds.sum(axis=1), 0.0)
        length = np.searchsorted(LENGTHS, chars, side="right") - 1
        rejected = (chars == 0) | ((length >= 0) & (least > self.limits[best, np.maximum(length, 0)]))
        return [self.languages[b] if c else "und" for b, c in zip(best, chars, strict=True)], score, rejected


def fit(samples: dict[str, list[str]]) -> Model:
    """Models of the languages from some texts of each."""
    languages = sorted(samples)
    counted, held = {}, {}
    for lang in languages:
        texts = sorted(samples[lang])
        held[lang] = texts[::CALIBRATION] if len(texts) >= 2 * CALIBRATION else []
        counted[lang] = [t for t in texts if t not in set(held[lang])] or texts
    tables = []  # of each language and order: n-gram hashes, their counts, contexts and next lower n-grams
    symbols: set[str] = set()
    for lang in languages:
        count: dict[str, int] = {}
        for text in counted[lang]:
            for w in _words(text):
                count[w] = count.get(w, 0) + 1
        words = list(count) or ["a"]
        symbols |= {c for w in words for c in w}
        word, grams, contexts = _hashed(words)
        weight = np.array([count.get(w, 1) for w in words], np.float64)[word]
        # A representative place and the count of each different n-gram; below the top, of each different longer one.
        by_order = [None] * ORDER
        use, n = np.arange(len(word)), weight
        for order in range(ORDER - 1, -1, -1):
            keys, first, inverse = np.unique(grams[order][use], return_index=True, return_inverse=True)
            c = np.bincount(inverse, n)
            at = use[first]
            by_order[order] = (keys, c, contexts[order][at], grams[order - 1][at] if order else keys)
            use, n = at, np.ones(len(at))
        tables.append(by_order)
    floor = -float(np.log(len(symbols) + 2))
    model = Model(languages, [], [], [], [], floor, np.full((len(languages), len(LENGTHS)), np.inf))
    for order in range(ORDER):
        keys, first = np.unique(np.concatenate([t[order][0] for t in tables] or [np.empty(0, np.uint64)]), return_index=True)
        context = np.concatenate([t[order][2] for t in tables] or [keys])[first]
        lower = np.concatenate([t[order][3] for t in tables] or [keys])[first]
        all_contexts = np.unique(context)
        p, backoff = np.empty((len(keys), len(languages))), np.ones((len(all_contexts), len(languages)))
        for i, table in enumerate(tables):
            mine, c, ctx, _ = table[order]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
            own, where = np.unique(ctx, return_inverse=True)
            total, kinds = np.bincount(where, c), np.bincount(where)
            at, there = _find(own, all_contexts)
            backoff[there, i] = (discount * kinds / total)[at[there]]
            raw = np.zeros(len(keys))
            at, _ = _find(keys, mine)
            raw[at] = (c - discount) / total[where]
            at, _ = _find(all_contexts, context)
            down = np.exp(model.log_p[order - 1][_find(model.grams[order - 1], lower)[0], i]) if order else np.exp(floor)
            p[:, i] = raw + backoff[at, i] * down
        model.grams.append(keys)
        model.log_p.append(np.log(p).astype(np.float32))
        model.contexts.append(all_contexts)
        model.log_backoff.append(np.log(backoff).astype(np.float32))
    for i, lang in enumerate(languages):
        for c, least in enumerate(LENGTHS):
            pieces = [p for text in held[lang] for p in _cut(text, least)]
            entropy, chars = model.texts(pieces)
            ok = chars >= least
            if ok.sum() >= ENOUGH:
                # What is chosen is the least over all languages; so is what the limit is set by.
                model.limits[i, c] = np.quantile(entropy[ok].min(axis=1), 1 - FALSE_REJECTION, method="higher")
            elif c:
                model.limits[i, c] = model.limits[i, c - 1]
    return model


def _cut(text: str, least: int):
    """Pieces of text of at least so many scored characters, whole words."""
    piece, n = [], 0
    for w in _words(text):
        piece.append(w)
        n += len(w) + 1
        if n >= least:
            yield " ".join(piece)
            piece, n = [], 0


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """Some different texts of every language, not held out, by the least hashes of the texts: at most TEXTS_PER_LANGUAGE
    each, and an equal part of SAMPLE_BYTES, of those of at most TEXT_BYTES bytes. A language that has only longer ones
    is learnt from the beginning of its shortest."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & F.col("doc_id").isNotNull())
    size = F.octet_length("text")
    short = size <= TEXT_BYTES
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40)
    # One row a language; the estimate of different texts keeps copies from thinning the sample.
    begin = F.min_by(F.substring("text", 1, TEXT_BYTES // 4), F.when(~short, F.struct(size, h)))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(F.when(short, F.xxhash64("text"))).alias("n"), F.avg(F.when(short, size)).alias("size"), begin.alias("begin")).collect()
    bytes_each = SAMPLE_BYTES / max(1, len(counts))
    wanted = {r["lang"]: min(TEXTS_PER_LANGUAGE, max(1, int(bytes_each / max(1.0, r["size"])))) for r in counts if r["n"]}
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (2.0 * wanted[r["lang"]] + 8) / r["n"])) for r in counts if r["n"]], "lang string, rate double")
    out: dict[str, list] = {r["lang"]: [] if r["n"] else [(0.0, r["begin"])] for r in counts}
    # rates: a row a language, as was collected.
    for r in rows.filter(short).withColumn("h", h).join(F.broadcast(rates), "lang").filter(F.col("h") < F.col("rate")).groupBy("lang", "text").agg(F.first("h").alias("h")).collect():
        out[r["lang"]].append((r["h"], r["text"]))
    return {lang: [t for _, t in sorted(found)[: wanted.get(lang, 1)]] for lang, found in out.items() if found}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score (0 to 1), rejected.

    A null text or one without letters is ``und`` with score 0, and rejected. A null doc_id stays null and isn't held
    out; repeated rows give repeated results; of equal cross-entropies the language first in the alphabet is chosen.
    An empty table gives no rows; a model of no language calls everything ``und``. Only the text is looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in slices(batches):
            lang, score, rejected = sent.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text isn't rejected by a model fitted on docs themselves."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(sample(docs)))

    def keep(batches, at=docs.columns.index("text")):
        for batch in slices(batches):
            yield batch.filter(pa.array(~sent.value.predict(batch.column(at).to_pylist())[2]))

    return docs.mapInArrow(keep, docs.schema)
