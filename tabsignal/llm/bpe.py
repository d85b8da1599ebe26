"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 32 characters cuts each text into chunks whose
borders depend on nearby content alone, so documents that share a passage
share its chunks wherever it stands.  Each different chunk is encoded once and
its ids are reused.  At every join the ids around the cut may be wrong (the
cut may split a word), so the text from a white space before the cut to one
after it is encoded anew; the window grows until the ids of its two outer
parts agree with the ids that the chunks gave for the same characters.  White
space is never inside a token of these vocabularies, so agreement there is
exact, and a text without white space near a cut is simply not cut there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, pick, text_batches
from .tokenization import SPACE, PieceEncoder, encoder

#: Chunk lengths in characters.
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 256, 1024, 8192
#: Bytes of ids of known chunks that a worker keeps before it starts anew.
CACHE_BYTES = 48_000_000
#: Characters from a cut to the first window border tried.
WINDOW = 24

_LAST_SPACE = re.compile(f"[{re.escape(SPACE)}](?=[^{re.escape(SPACE)}]*$)")
_SPACE = re.compile(f"[{re.escape(SPACE)}]")
_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(text: str) -> list[int]:
    """Content-defined cut positions of a text, without 0 and its length."""
    n = len(text)
    if n <= MIN_CHUNK:
        return []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    h = _GEAR[(points ^ (points >> np.uint32(8))) & np.uint32(255)]
    for k in (1, 2, 4, 8, 16):  # h[i] becomes the sum of gear[i - j] << j over the last 32 characters
        step = h.copy()
        step[k:] += h[:-k] << np.uint32(k)
        h = step
    candidates = np.flatnonzero((h >> np.uint32(8)) % np.uint32(MEAN_CHUNK - MIN_CHUNK) == 0) + 1
    out, last = [], 0
    for c in candidates.tolist():
        while c - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if c - last >= MIN_CHUNK and c < n:
            out.append(c)
            last = c
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        out.append(last)
    return out


class ChunkEncoder:
    """Encodes texts chunk by chunk and reuses what it knows."""

    def __init__(self, pieces: PieceEncoder):
        self.pieces = pieces
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        self.seen = self.encoded = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        plans = [self._plan(t) for t in texts]
        chunks = {}
        for bounds, _ in plans:
            for chunk in bounds:
                chunks.setdefault(chunk, hashlib.blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        new = [c for c, d in chunks.items() if d not in self.known]
        self.seen += sum(len(b) for b, _ in plans)
        self.encoded += len(new)
        for c, ids in zip(new, self.pieces.encode(new)):
            self.known[chunks[c]] = ids
            self.held += len(ids) + 100
        return self._join(plans, [[self.known[chunks[c]] for c in bounds] for bounds, _ in plans])

    def _plan(self, text: str) -> tuple[list[str], list[tuple[int, int]]]:
        """Chunks, and for each join where the windows' outer borders first lie: characters before and after the cut."""
        where, at, windows = [0], 0, []
        ends = [*cuts(text), len(text)]
        for c, end in zip(ends, ends[1:]):
            left, right = self._left(text, at, c, WINDOW), self._right(text, c, end, WINDOW)
            if left is None or right is None:  # no white space to stand on: not cut here
                continue
            where.append(c)
            windows.append((c - left, right - c))
            at = c
        where.append(len(text))
        return [text[a:b] for a, b in zip(where, where[1:])], windows

    @staticmethod
    def _left(text: str, low: int, cut: int, reach: int) -> int | None:
        """The last white space that is at least ``reach`` before the cut, else the last before it."""
        for high in (cut - reach, cut):
            for span in (128, MAX_CHUNK):
                begin = max(low, high - span)
                if high > begin and (m := _LAST_SPACE.search(text[begin:high])):
                    return begin + m.start()
        return None

    @staticmethod
    def _right(text: str, cut: int, high: int, reach: int) -> int | None:
        """The first white space that is at least ``reach`` after the cut, else the first after it."""
        for low in (cut + reach, cut + 1):
            if low < high and (m := _SPACE.search(text, low, high)):
                return m.start()
        return None

    def _join(self, plans, encoded: list[list[bytes]]) -> list[bytes]:
        seams = []
        for (chunks, windows) in plans:
            for k, (left, right) in enumerate(windows):
                a, b = chunks[k][len(chunks[k]) - left :], chunks[k + 1][:right]
                seams += [a, b, a + b]
        fixed = iter(self.pieces.encode(seams))
        out = []
        for (chunks, windows), ids in zip(plans, encoded):
            if not windows:
                out.append(ids[0])
                continue
            parts, start = [], 0
            for k, _ in enumerate(windows):
                a, b, both = next(fixed), next(fixed), next(fixed)
                here, there = ids[k], ids[k + 1]
                if len(here) - len(a) < start or not here.endswith(a) or not there.startswith(b):
                    parts = None  # the window has to grow
                    for _ in range(3 * (len(windows) - k - 1)):
                        next(fixed)
                    break
                parts += [here[start : len(here) - len(a)], both]
                start = len(b)
            if parts is None:
                out.append(self._grow(chunks, ids))
            else:
                parts.append(ids[-1][start:])
                out.append(b"".join(parts))
        return out

    def _grow(self, chunks: list[str], ids: list[bytes]) -> bytes:
        """Joins chunks one by one, each window growing fourfold until its outer parts agree, at last over both chunks."""
        out, held, held_ids, used, used_ids = [], chunks[0], ids[0], 0, 0
        for after, after_ids in zip(chunks[1:], ids[1:]):
            reach = WINDOW
            while True:
                left, right = self._left(held, used, len(held), reach), self._right(after, 0, len(after), reach)
                if reach > MAX_CHUNK or left is None or right is None:
                    held = held[used:] + after
                    held_ids, used, used_ids = self.pieces.encode([held])[0], 0, 0
                    break
                a, b, both = self.pieces.encode([held[left:], after[:right], held[left:] + after[:right]])
                if len(held_ids) - len(a) >= used_ids and held_ids.endswith(a) and after_ids.startswith(b):
                    out += [held_ids[used_ids : len(held_ids) - len(a)], both]
                    held, held_ids, used, used_ids = after, after_ids, right, len(b)
                    break
                reach *= 4
        out.append(held_ids[used_ids:])
        return b"".join(out)


_CHUNKERS: dict[str, ChunkEncoder] = {}


def _chunker(path: str) -> ChunkEncoder:
    if path not in _CHUNKERS:
        _CHUNKERS[path] = ChunkEncoder(encoder(path))
    return _CHUNKERS[path]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: ``id_col``, ids binary (little-endian unsigned 32-bit integers).

    A null text counts as empty; empty texts have no ids; equal rows each get
    their own row; an empty table gives an empty table.  Workers keep at most
    CACHE_BYTES of chunk ids, and one slice of texts, whatever the input.
    """
    import pyarrow as pa

    text_batches(docs.sparkSession)
    source = pick(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = _chunker(tokenizer_path)
        for batch in in_slices(batches, 1):
            ids = chunker.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [id_col, "ids"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id") -> DataFrame:
    """Adds ``decoded`` string, the library's decode of ``ids``; null ids decode to the empty text."""
    import pyarrow as pa

    source = pick(encoded, id_col, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(tokenizer_path)
        for batch in in_slices(batches, 1, 4_000_000):
            texts = pieces.decode([i or b"" for i in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, "ids", "decoded"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, ids binary, decoded string")


def codec(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass: ``id_col``, ids, decoded.

    One Python worker serves a task, where the two operators in a row would
    hold two with a cache each.
    """
    import pyarrow as pa

    text_batches(docs.sparkSession)
    source = pick(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker, pieces = _chunker(tokenizer_path), encoder(tokenizer_path)
        for batch in in_slices(batches, 1):
            ids = chunker.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(pieces.decode(ids), pa.string())], [id_col, "ids", "decoded"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, ids binary, decoded string")


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of what :func:`decode` returns."""
    return decoded.select(
        F.col(id_col),
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
