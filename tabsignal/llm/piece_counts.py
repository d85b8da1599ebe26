"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie.  A failure link of a trie node leads to the node that
stands for what is left of its string after the pieces that longest match would
take from the front; how many pieces those are is precomputed as a number, so
counting walks a word once, adds a number at each failure, and never builds a
piece.  All different words of a slice walk in step as arrays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import in_slices, pick, text_batches

#: Words whose counts a worker keeps before it starts anew.
CACHE_WORDS = 500_000
#: Word: letters and digits, or one other visible character.
WORDS = re.compile(r"\w+|[^\w\s]")


class Automaton:
    """``initial`` pieces begin a word; ``inner`` pieces go on with it."""

    def __init__(self, initial: list[str], inner: list[str]):
        alphabet = sorted({c for p in (*initial, *inner) for c in p})
        self.symbol = {c: i for i, c in enumerate(alphabet)}
        self.width = len(alphabet) + 1  # the last symbol stands for all others
        edges: list[dict[int, int]] = [{}, {}]  # nodes 0 and 1: roots of initial and of inner pieces
        token = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                at = root
                for c in piece:
                    k = self.symbol[c]
                    nxt = edges[at].get(k)
                    if nxt is None:
                        nxt = edges[at][k] = len(edges)
                        edges.append({})
                        token.append(False)
                    at = nxt
                token[at] = len(piece) > 0
        n = len(edges)
        link, popped = [-1] * n, [0] * n
        level = [0, 1]
        while level:  # breadth first: links lead to shallower nodes
            deeper = []
            for v in level:
                for c, w in edges[v].items():
                    deeper.append(w)
                    if token[w]:
                        link[w], popped[w] = 1, 1
                        continue
                    z, count = link[v], popped[v]
                    while z >= 0 and c not in edges[z]:
                        z, count = link[z], count + popped[z]
                    if z >= 0:
                        link[w], popped[w] = edges[z][c], count
            level = deeper
        self.link, self.popped = np.array(link, np.int32), np.array(popped, np.int32)
        keys = np.array([v * self.width + c for v, e in enumerate(edges) for c in e], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array([w for e in edges for w in e.values()], np.int32)[order]

    def _go(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = at.astype(np.int64) * self.width + symbol
        where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[where] == key, self.to[where], -1)

    def count(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each word, and whether it is unknown; an unknown word counts as one piece."""
        n = len(words)
        pieces, known = np.zeros(n, np.int64), np.ones(n, bool)
        if not n or not len(self.keys):
            return np.ones(n, np.int64), np.zeros(n, bool) if not n else np.ones(n, bool)
        sizes = np.array([len(w) for w in words])
        order = np.argsort(-sizes, kind="stable")
        flat = np.array([self.symbol.get(c, self.width - 1) for k in order for c in words[k]], np.int64)
        starts = np.cumsum(sizes[order]) - sizes[order]
        at, counts, good, lengths = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool), sizes[order]
        for step in range(int(sizes.max(initial=0))):
            rows = np.flatnonzero(good[: np.searchsorted(-lengths, -step, side="left")])
            if not len(rows):
                break
            symbol = flat[starts[rows] + step]
            while len(rows):
                to = self._go(at[rows], symbol)
                ok = to >= 0
                at[rows[ok]] = to[ok]
                rows, symbol = rows[~ok], symbol[~ok]
                counts[rows] += self.popped[at[rows]]
                at[rows] = self.link[at[rows]]
                lost = at[rows] < 0
                good[rows[lost]] = False
                rows, symbol = rows[~lost], symbol[~lost]
        rows = np.flatnonzero(good)
        while len(rows):  # take what is left at the words' ends
            rows = rows[at[rows] > 1]
            counts[rows] += self.popped[at[rows]]
            at[rows] = self.link[at[rows]]
            good[rows[at[rows] < 0]] = False
            rows = rows[at[rows] > 1]
        pieces[order], known[order] = np.where(good, counts, 1), good
        return pieces, ~known


def piece_vocabulary(model_path: str) -> tuple[list[str], list[str]]:
    """Initial and inner pieces of a sentencepiece model: those with and without its word mark, lower case and not special."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    initial, inner = set(), set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        (initial if piece.startswith("▁") else inner).add(piece.lstrip("▁").lower())
    return sorted(p for p in initial | {x for x in inner if len(x) == 1} if p), sorted(p for p in inner if p)


_AUTOMATA: dict[str, Automaton] = {}
_COUNTS: dict[str, dict[str, tuple[int, int]]] = {}


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, n_tokens, n_unknown of every whole text.

    Texts are lower-cased and split into runs of letters and digits and single
    other visible characters.  Each word is split by greedy longest match; a
    word that cannot be split is one unknown token.  Null and empty texts have
    none; every row gets a row.
    """
    import pyarrow as pa

    text_batches(docs.sparkSession)
    source = pick(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _AUTOMATA:
            _AUTOMATA[model_path], _COUNTS[model_path] = Automaton(*piece_vocabulary(model_path)), {}
        automaton, known = _AUTOMATA[model_path], _COUNTS[model_path]
        for batch in in_slices(batches, 1):
            words = [WORDS.findall((t or "").lower()) for t in batch.column(1).to_pylist()]
            if len(known) > CACHE_WORDS:
                known.clear()
            new = set()
            for w in words:
                new.update(w)
            new = [w for w in new if w not in known]
            pieces, unknown = automaton.count(new)
            known.update(zip(new, zip(pieces.tolist(), unknown.tolist())))
            tokens, lost = [], []
            for w in words:
                pairs = Counter(w).items()
                tokens.append(sum(known[x][0] * n for x, n in pairs))
                lost.append(sum(known[x][1] * n for x, n in pairs))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in ([len(w) for w in words], tokens, lost))], [id_col, "n_words", "n_tokens", "n_unknown"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")
