"""Language identification by prediction by partial matching.

For each language a variable-order tree of byte contexts holds how often each
byte followed each context.  A byte's probability at its longest known context
is count / (total + kinds); a byte not seen there pays the escape
kinds / (total + kinds) (method C) and is coded by the next shorter context,
and at last uniformly over the 256 bytes.  The counts are frozen after
training, so code lengths do not depend on what else is scored.

Every context and every byte seen after it is kept.  Contexts are numbers of at
most four bytes, held in hash tables with the code lengths of the bytes that
follow, for some languages at a time; what escapes cost from a context down is
summed beforehand, so a byte takes one or two lookups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, in_slices, pick, positions, text_batches

#: Longest context in bytes, at most 4.
ORDER = 4
#: Training documents for each language: a bounded sample, drawn by a hash of the id.
SAMPLE_ROWS = 400
#: Languages that share a table.
TOGETHER = 8
#: A text is in none of the languages if the letters of its words cost over FOREIGN bits a byte in the best one;
#: texts with fewer such bytes than LETTERS are not judged by that.
FOREIGN, LETTERS = 7.0, 48
#: Unknown language.
UNDETERMINED = "und"

_RUN = re.compile(rb"\S+")
_HASH = np.uint64(0x9E3779B97F4A7C15)


class _Index:
    """Places of numbers, by open addressing; a quarter full at most."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.keys, self.places = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == -1
            at, first = np.unique(slot[free], return_index=True)
            mine = left[free][first]
            self.keys[at], self.places[at] = keys[mine], mine
            rest = np.ones(len(left), bool)
            rest[np.flatnonzero(free)[first]] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each number, -1 where it is unknown."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.places[slot], -1)
        left = np.flatnonzero((held != keys) & (held != -1))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot]
            good = held == keys[left]
            out[left[good]] = self.places[slot[good]]
            more = ~good & (held != -1)
            left, slot = left[more], slot[more]
        return out


class _Tables:
    """Code lengths under some languages."""

    def __init__(self, streams: list[list[bytes]], order: int):
        n = len(streams)
        seen: list[list[tuple[np.ndarray, np.ndarray]]] = []  # language, order -> (context and byte, count)
        for texts in streams:
            sizes = np.array([len(t) for t in texts], np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
            within = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            context, levels = np.zeros(len(data), np.int64), []
            for k in range(order + 1):
                if k:
                    some = np.flatnonzero(within >= k)
                    context[some] += data[some - k] << (8 * (k - 1))
                some = within >= k
                levels.append(np.unique(context[some] << 8 | data[some], return_counts=True))
            seen.append(levels)
        pairs, contexts, direct, over, escapes = [], [], [], [], []
        lower_pairs, lower_bits = np.arange(256), np.full((256, n), 8.0)
        lower_contexts, lower_escapes = np.zeros(1, np.int64), np.zeros((1, n))
        for k in range(order + 1):
            pair = np.unique(np.concatenate([levels[k][0] for levels in seen]))
            count = np.zeros((len(pair), n))
            for j, levels in enumerate(seen):
                count[np.searchsorted(pair, levels[k][0]), j] = levels[k][1]
            context, of = np.unique(pair >> 8, return_inverse=True)
            total, kinds = np.zeros((len(context), n)), np.zeros((len(context), n))
            np.add.at(total, of, count)
            np.add.at(kinds, of, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                found = -np.log2(count / (total + kinds)[of])
            shorter = (1 << (8 * max(0, k - 1))) - 1  # a context without its farthest byte
            below = lower_bits[np.searchsorted(lower_pairs, (pair >> 8 & shorter) << 8 | pair & 255)] if len(pair) else np.zeros((0, n))
            bits = np.where(count > 0, found, escape[of] + below)
            down = escape + (lower_escapes[np.searchsorted(lower_contexts, context & shorter)] if k and len(context) else 0.0)
            pairs.append(pair | (k + 1) << 40)
            contexts.append(context | (k + 1) << 40)
            direct.append(bits)
            over.append(bits - down[of])
            escapes.append(down)
            lower_pairs, lower_bits, lower_contexts, lower_escapes = pair, bits, context, down
        self.order, self.n = order, n
        self.pairs, self.contexts = _Index(np.concatenate(pairs)), _Index(np.concatenate(contexts))
        self.direct, self.over, self.escapes = (np.concatenate(x).astype(np.float32) for x in (direct, over, escapes))

    def bits(self, data: np.ndarray, before: np.ndarray, within: np.ndarray) -> np.ndarray:
        """Code length of each byte under each language; ``before`` has the four bytes before it, the nearest lowest."""
        out = np.empty((len(data), self.n), np.float32)
        left, done = np.arange(len(data)), np.zeros(len(data), bool)  # bytes not yet found after a context
        known = np.full(len(data), -1, np.int32)  # the longest known context of those left
        have = np.minimum(within, self.order)
        for k in range(self.order, -1, -1):
            some = left if k == 0 else left[have[left] >= k]
            context = before[some] & ((1 << (8 * k)) - 1)
            place = self.pairs.find((context << 8 | data[some]) | (k + 1) << 40)
            good = place >= 0
            hit, place = some[good], place[good]
            out[hit] = np.where((known[hit] < 0)[:, None], self.direct[place], self.over[place] + self.escapes[known[hit]])
            missed, context = some[~good], context[~good]
            new = known[missed] < 0
            known[missed[new]] = self.contexts.find(context[new] | (k + 1) << 40)
            done[hit] = True
            left = left[~done[left]]
        out[left] = 8 + np.where((known[left] < 0)[:, None], np.float32(0), self.escapes[known[left]] if len(self.escapes) else np.float32(0))
        return out


@dataclass
class Model:
    langs: list[str]
    tables: list[_Tables]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        return self.sums(texts, None)

    def each(self, text: bytes) -> np.ndarray:
        """Bits of each byte of one text under each language."""
        data = np.frombuffer(text, np.uint8).astype(np.int64)
        before = np.zeros(len(data), np.int64)
        for k in range(1, 5):
            before[k:] |= data[:-k] << (8 * (k - 1))
        return np.concatenate([t.bits(data, before, np.arange(len(data))) for t in self.tables], axis=1)

    def sums(self, texts: list[bytes], counted: np.ndarray | None) -> np.ndarray:
        """Bits of the counted bytes (all if None) of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
        if not len(data):
            return out
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        within = np.arange(len(data)) - np.repeat(starts, sizes)
        before = np.zeros(len(data), np.int64)
        for k in range(1, 5):
            before[k:] |= data[:-k] << (8 * (k - 1))
        some, at = sizes > 0, 0
        for table in self.tables:
            bits = table.bits(data, before, within)
            if counted is not None:
                bits = bits * counted[:, None]
            out[some, at : at + table.n] = np.add.reduceat(bits, starts[some], axis=0, dtype=np.float64)
            at += table.n
        return out


def train(samples: list[tuple[str, str]], order: int = ORDER) -> Model:
    """A model of (text, language) pairs."""
    langs = sorted({lang for _, lang in samples})
    streams = {lang: [t.encode("utf-8", "replace") for t, x in samples if x == lang and t] for lang in langs}
    return Model(langs, [_Tables([streams[x] for x in langs[i : i + TOGETHER]], order) for i in range(0, len(langs), TOGETHER)])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Model | None:
    """Train on about ``rows`` documents of each language, drawn by a hash of the id.

    Rows with a null text or language are left out; None where nothing is left.
    The sample's bound is the number of languages times ``rows`` (and a
    twentieth); the model's size follows the sample's, some 5 MB a language.
    """
    source = pick(labelled, id_col, text_col, lang_col).filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in source.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows / n))])
    draw = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    got = source.filter(draw < share[F.col(lang_col)]).select(id_col, text_col, lang_col).collect()
    if not got:
        got = source.select(id_col, text_col, lang_col).limit(rows).collect()
    got.sort(key=lambda r: (r[2], str(r[0]), r[1]))
    return train([(r[1], r[2]) for r in got])


def _judge(m: Model | None, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
    """Language, score and bits per byte of each text."""
    known = [m is not None and t is not None and any(map(str.isalpha, t)) for t in texts]
    raw = [t.encode("utf-8", "replace") if k else b"" for t, k in zip(texts, known)]
    langs, scores, rates = [UNDETERMINED] * len(texts), [0.0] * len(texts), [None] * len(texts)
    if any(known):
        bits = m.code_lengths(raw)
        best = bits.argmin(1)
        least = bits[np.arange(len(texts)), best]
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        for i, k in enumerate(known):
            if k:
                langs[i], scores[i], rates[i] = m.langs[best[i]], float(share[i]), float(least[i] / len(raw[i]))
    return langs, scores, rates


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred, score (the language's share of the probability), bits_per_byte.

    Texts that are null or without a letter give ``und``, 0 and null; so do all
    texts where there is no model.  Ties go to the language first by name.
    Every row gets a row.  Whole texts are scored, some MB of them at a time.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    text_batches(spark)
    source = pick(docs, id_col, text_col)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1, 500_000):
            langs, scores, rates = _judge(held.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], [id_col, "lang_pred", "score", "bits_per_byte"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double")


def word_letters(texts: list[bytes]) -> np.ndarray:
    """Which bytes of the joined texts are letters of words: of runs between white space without digits or ``_@/=``."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    kind = _KINDS[data]
    space = kind == 0
    token = np.cumsum(space)
    odd = np.bincount(token, kind == 2, minlength=int(token[-1]) + 1 if len(token) else 1) > 0
    good = (kind == 1) & ~odd[token]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # the white space between texts
    inside = np.ones(len(data), bool)
    inside[ends] = False
    return good[inside]


#: White space 0, letters 1 (every byte above ASCII with them), marks that words do not have 2, other marks 3.
_KINDS = np.array([0 if chr(b).isspace() else 1 if b > 127 or chr(b).isalpha() else 2 if chr(b).isdigit() or chr(b) in "_@/=" else 3 for b in range(256)], np.uint8)
_KINDS[128:] = 1


def keep_known(docs: DataFrame, model: Model | None, text_col: str = "text", foreign: float = FOREIGN, letters: int = LETTERS) -> DataFrame:
    """The rows whose text is in a learned language, all columns as they are.

    Rejected are texts that are null or without a letter, and those that the
    best language explains badly: the letters of their words cost more than
    ``foreign`` bits a byte even there, on average and for the median of their
    different words, so that neither a key among few words nor a word repeated
    many times decides.  Texts in a learned language
    take two to six, other languages, other scripts and gibberish nine and
    more (a byte by itself is eight, and every escape is paid on top).  Keys, numbers and addresses are left out
    of that sum, and texts with fewer than ``letters`` such bytes are too short
    to be judged by it and stay.  Without a model every text with a letter stays.
    """
    flat, names = positions(docs)
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in in_slices(batches, at, 500_000):
            texts = batch.column(at).to_pylist()
            good = [t is not None and any(map(str.isalpha, t)) for t in texts]
            if held.value is not None and any(good):
                raw = [t.encode("utf-8", "replace") if g else b"" for t, g in zip(texts, good)]
                rate, size = word_bits(held.value, raw)
                odd = (size >= letters) & (rate > foreign)
                for k in np.flatnonzero(odd).tolist():
                    good[k] = typical_word(held.value, raw[k]) <= foreign
            yield batch.filter(pa.array(good))

    return flat.mapInArrow(run, flat.schema).toDF(*names)


def typical_word(model: Model, text: bytes) -> float:
    """The median over the different words of what a byte of their letters costs, in the language where it is least."""
    bits, counted, words = model.each(text), word_letters([text]), {}
    for m in _RUN.finditer(text):
        some = counted[m.start() : m.end()]
        if some.any():
            words.setdefault(m[0], bits[m.start() : m.end()][some].mean(0))
    return float(np.median(list(words.values()), axis=0).min()) if words else 0.0


def word_bits(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bits a byte of the letters of words under the best language, and the number of such bytes."""
    counted = word_letters(texts)
    sizes = np.array([len(t) for t in texts])
    n = np.zeros(len(texts))
    some = sizes > 0
    n[some] = np.add.reduceat(counted.astype(np.int64), (np.cumsum(sizes) - sizes)[some]) if some.any() else 0
    return model.sums(texts, counted).min(1) / np.maximum(n, 1), n


def identify(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predictions for all rows by a model of the rows outside fold 0.

    The fold is crc32 of the id as text, modulo ``folds``.  Gives id, held_out
    (fold 0), lang_pred, score, bits_per_byte.
    """
    fold = F.pmod(crc_of_id(F.col(id_col)), F.lit(folds))
    source = pick(docs, id_col, text_col, lang_col)
    model = fit(source.filter(fold != 0), id_col, text_col, lang_col)
    found = predict(source, model, id_col, text_col)
    return found.select(id_col, (fold == 0).alias("held_out"), "lang_pred", "score", "bits_per_byte")
