"""Language-model scores by a gated recurrent network, and a unigram base.

Words are what stands between ASCII white space, A-Z in lower case; each text
ends with one end token.  Counts are taken over all training texts.  The
network predicts one of the most frequent words or, for any other word, the
bucket of its ending; the word's share of its bucket comes from the counts, so
every token has a probability.  The output is factored: a class first, then a
member of the class.  Training is truncated backpropagation through time in
numpy: the driver starts the network on a bounded sample, then tasks read every
training document in whole, in rounds after each of which their weights are
averaged by tokens.  In training and in scoring the state runs on from window to
window, so a document's score is the log-likelihood of the whole of it.

The most frequent words' counts go to all workers (at most HOT words).  Other
words are counted by a join, each document's words collapsed first, so no key
of that join is frequent.
"""

from __future__ import annotations

import copy
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, in_slices, pick, saved, scratch, text_batches

#: Words whose counts are sent to all workers, at most.
HOT = 150_000
#: Outputs: frequent words and ending buckets, in classes of equal size.
OUTPUTS, BUCKETS, CLASSES = 1536, 256, 48
#: Network width, window of truncated backpropagation, lanes at the start, in the rounds and in scoring.
HIDDEN, WINDOW, TRAIN_LANES, ROUND_LANES, LANES = 16, 20, 64, 512, 256
#: Steps that scoring takes before it looks outputs up.
BLOCK = 128
#: Documents on which the network is started, drawn by a hash of the id, before it reads all of them.
SAMPLE_ROWS, UPDATES, RATE = 300, 700, 0.01
#: Rounds in which all documents are read once, and the rate of the first; weights go to be averaged in pieces of so many.
ROUNDS, ROUND_RATE, PIECE = 4, 0.003, 4096
#: Tokens of a text that one lane reads in training; scoring never cuts a text.
SPAN = 2000
#: Words longer than this many bytes are known by their digest.
LONG = 48
#: Bytes of text that are tokenised together.
TOKENISED_BYTES = 6_000_000
#: Tokens that a worker scores at once.
BUFFER_TOKENS = 6_000_000
#: The end token's key; no word holds a space.
END = b" end"


def words_of(text: str | None) -> list[bytes]:
    """The text's words in lower case (A-Z only), long ones by digest."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if any(len(w) > LONG for w in words):
        words = [w if len(w) <= LONG else b" " + hashlib.sha256(w).hexdigest().encode() for w in words]
    return words


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


def _coded(texts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """:func:`words_of` for an Arrow column: different words, then the number of each word and where each text begins.

    Each text is followed by the end token; the last of the borders is the length.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = lists.flatten().dictionary_encode()
    codes, different = flat.indices.to_numpy().astype(np.int64), flat.dictionary.cast(pa.large_binary()).to_pylist()
    size = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(size)), size)
    if b"" in different:  # before leading and after trailing white space
        real = codes != different.index(b"")
        codes, owner = codes[real], owner[real]
    size = np.bincount(owner, minlength=len(size))
    if any(len(w) > LONG for w in different):
        different = [w if len(w) <= LONG else b" " + hashlib.sha256(w).hexdigest().encode() for w in different]
    different.append(END)
    return different, np.insert(codes, np.cumsum(size), len(different) - 1), np.concatenate([[0], np.cumsum(size + 1)])


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, bucket, n over all rows; counts are summed over many texts at once and in each task before they are sent."""
    import pyarrow as pa

    source = pick(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches, 0, TOKENISED_BYTES):
            different, codes, _ = _coded(batch.column(0))
            times = np.bincount(codes, minlength=len(different))
            real = np.flatnonzero(times)  # the empty word is none
            words = pa.array(different, pa.binary()).take(pa.array(real)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([words, pa.array(times[real], pa.int64())], ["word", "n"])

    counts = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    ending = F.substring(F.col("word").cast("binary"), -3, 3)  # as :func:`bucket` does
    return counts.select("word", (F.crc32(ending) % BUCKETS).cast("int").alias("bucket"), "n")


@dataclass
class Vocabulary:
    """What workers need to know of the counts."""

    hot: dict[bytes, int]  # word -> place in the arrays below
    output: np.ndarray  # network output of each hot word
    log_count: np.ndarray  # log10(count + 1)
    rest: np.ndarray  # log10 of the word's share of its output; 0 for words with an output of their own
    log_mass: np.ndarray  # log10 of each bucket's mass
    total: int
    distinct: int
    prior: np.ndarray  # unigram probability of each output

    def place(self, words: list[bytes]) -> np.ndarray:
        get = self.hot.get
        return np.array([get(w, -1) for w in words], np.int64)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From word counts: the most frequent words by count, at most HOT, and bucket masses over all others."""
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    total, distinct = total or 0, distinct or 0
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    tally = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, seen = 1 << 30, 0  # whole levels only, so ties are not split
    for at, n in tally:
        if seen + n > HOT:
            break
        least, seen = at, seen + n
    hot = [(r[0].encode(), r[1], r[2]) for r in counts.filter(level >= least).select("word", "bucket", "n").collect()] if seen else []
    hot.sort(key=lambda r: (-r[2], r[0]))
    own = OUTPUTS - BUCKETS
    mass = np.ones(BUCKETS)
    for b, n, k in counts.groupBy("bucket").agg(F.sum("n"), F.count(F.lit(1))).collect():
        mass[b] += n + k
    for w, b, n in hot[:own]:
        mass[b] -= n + 1
    output = np.array([i if i < own else own + b for i, (_, b, _) in enumerate(hot)], np.int64)
    log_count = np.log10(np.array([n for _, _, n in hot], float) + 1)
    prior = np.ones(OUTPUTS)
    prior[own:] = mass
    prior[: min(own, len(hot))] += [n for _, _, n in hot[:own]]
    log_mass = np.log10(np.maximum(mass, 1))
    rest = np.where(np.arange(len(hot)) < own, 0.0, log_count - log_mass[np.array([b for _, b, _ in hot], np.int64)] if hot else 0.0)
    return Vocabulary({w: i for i, (w, _, _) in enumerate(hot)}, output, log_count, rest, log_mass, int(total), int(distinct), prior / prior.sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= x.dtype.type(0.5)
    np.tanh(x, out=x)
    x += 1
    x *= x.dtype.type(0.5)
    return x


def _exponents(logits: np.ndarray, bounded: bool) -> np.ndarray:
    """exp in place, less the row's largest unless no logit can be out of range."""
    if not bounded:
        logits -= logits.max(1, keepdims=True)
    return np.exp(logits, out=logits)


def _with_ones(h: np.ndarray) -> np.ndarray:
    """A last column of ones, which takes the biases of :meth:`Network._heads`."""
    out = np.ones((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    return out


def _row_sums(x: np.ndarray) -> np.ndarray:
    """By a product with ones, which is faster than a sum over short rows."""
    return x @ np.ones(x.shape[1], x.dtype)


class Network:
    """A gated recurrent unit with a class-factored softmax; float32 throughout."""

    def __init__(self, prior: np.ndarray, seed: int = 3):
        r = np.random.default_rng(seed)
        f = np.float32
        self.size = len(prior) // CLASSES
        order = np.argsort(-prior, kind="stable")
        self.slot = np.empty(len(prior), np.int32)  # output -> class * size + member
        self.slot[order] = np.arange(len(prior))
        sorted_prior = prior[order].reshape(CLASSES, self.size)
        self.p = {
            "x": (r.standard_normal((len(prior), 3 * HIDDEN)) * 0.1).astype(f),
            "u": (r.standard_normal((HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(f),
            "b": np.zeros(3 * HIDDEN, f),
            "c": np.zeros((HIDDEN, CLASSES), f),
            "cb": np.log(sorted_prior.sum(1)).astype(f),
            "o": np.zeros((CLASSES, HIDDEN, self.size), f),
            "ob": np.log(sorted_prior).astype(f),
        }

    def _inputs(self) -> np.ndarray:
        """What each slot adds to the gates, the bias among it."""
        return self.p["x"] + self.p["b"]

    def step(self, h: np.ndarray, tokens: np.ndarray) -> tuple:
        """New state; tokens are slots."""
        return self._move(h, self._inputs()[tokens])

    def _move(self, h: np.ndarray, a: np.ndarray) -> tuple:
        """New state; a: rows of :meth:`_inputs`."""
        g = h @ self.p["u"]
        gates = _sigmoid(a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        return n + z * (h - n), z, r, n, g[:, 2 * HIDDEN :]

    def _heads(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of the classes and of their members, the biases as a last row."""
        p = self.p
        return np.concatenate([p["c"], p["cb"][None]]), np.concatenate([p["o"], p["ob"][:, None]], axis=1)

    def _bounded(self) -> bool:
        """Whether every logit lies within what exp can hold; states are between -1 and 1."""
        p = self.p
        return max(np.abs(p["cb"]).max() + np.abs(p["c"]).sum(0).max(), np.abs(p["ob"]).max() + np.abs(p["o"]).sum(1).max()) < 80

    def log_prob(self, h: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Natural log-probability of each slot after state h."""
        cls, member = slots // self.size, slots % self.size
        bounded, rows = self._bounded(), np.arange(len(slots))
        order = np.argsort(slots.astype(np.uint16), kind="stable")  # of 16 bits: by digits
        h, cls, member = _with_ones(h[order]), cls[order], member[order]
        classes, members = self._heads()
        share = _exponents(h @ classes, bounded)
        chance = np.log(share[rows, cls] / _row_sums(share) + 1e-30)
        ends = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        for k in range(CLASSES):
            i, j = ends[k], ends[k + 1]
            if i < j:
                inner = _exponents(h[i:j] @ members[k], bounded)
                chance[i:j] += np.log(inner[rows[: j - i], member[i:j]] / _row_sums(inner) + 1e-30)
        out = np.empty(len(slots), chance.dtype)
        out[order] = chance
        return out

    def _gradient(self, h0: np.ndarray, x: np.ndarray, first: np.ndarray, good: np.ndarray | None = None) -> tuple[dict, np.ndarray, float]:
        """Gradients over one window: x slots (time, lane), first: whether a document begins there, good: whether there is a token."""
        p, t_max, h, inputs = self.p, len(x), h0, self._inputs()[x]
        states, z, r, cand, inner = np.empty((5, t_max, len(h0), HIDDEN), np.result_type(h0, inputs))
        for t in range(t_max):
            if first[t].any():
                h = np.where(first[t][:, None], np.float32(0), h)
            states[t] = h
            h, z[t], r[t], cand[t], inner[t] = self._move(h, inputs[t])
        g = {k: np.zeros_like(v) for k, v in p.items()}
        every, slots = states.reshape(-1, HIDDEN), x.ravel()
        order = np.argsort(slots.astype(np.uint16), kind="stable")  # by class, then by member
        if good is not None:
            order = order[good.ravel()[order]]
        hs, slots, (classes, members) = _with_ones(every[order]), slots[order], self._heads()
        n, rows = len(slots), np.arange(len(slots))
        cls, member = slots // self.size, slots % self.size
        bounded = self._bounded()
        prob = _exponents(hs @ classes, bounded)
        part = 1 / _row_sums(prob)
        loss = -np.log(prob[rows, cls] * part + 1e-30).sum()
        prob *= (part / n)[:, None]
        prob[rows, cls] -= 1 / max(1, n)
        both = hs.T @ prob
        g["c"], g["cb"] = both[:-1], both[-1]
        dh, chance = prob @ p["c"].T, np.empty(n, prob.dtype)
        ends = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        for k in range(CLASSES):
            i, j = ends[k], ends[k + 1]
            if i < j:
                q = _exponents(hs[i:j] @ members[k], bounded)
                part, at, m = 1 / _row_sums(q), rows[: j - i], member[i:j]
                chance[i:j] = q[at, m] * part
                q *= (part / n)[:, None]
                q[at, m] -= 1 / n
                both = hs[i:j].T @ q
                g["o"][k], g["ob"][k] = both[:-1], both[-1]
                dh[i:j] += q @ p["o"][k].T
        loss -= np.log(chance + 1e-30).sum()
        back = np.zeros_like(every)
        back[order] = dh
        dh = back.reshape(t_max, -1, HIDDEN)
        keep, fr = 1 - z, inner * r
        fr *= 1 - r
        fz, fn = (states - cand) * z, 1 - cand * cand
        fz *= keep
        fn *= keep
        da, after, ut = np.empty((t_max, len(h0), 3 * HIDDEN), fz.dtype), np.zeros_like(h0), np.ascontiguousarray(p["u"].T)
        dg = np.empty_like(da)
        for t in range(t_max - 1, -1, -1):
            dn, back = after * fn[t], dg[t]
            np.multiply(after, fz[t], out=back[:, :HIDDEN])
            np.multiply(dn, fr[t], out=back[:, HIDDEN : 2 * HIDDEN])
            np.multiply(dn, r[t], out=back[:, 2 * HIDDEN :])
            da[t, :, 2 * HIDDEN :] = dn
            after = after * z[t]
            after += back @ ut
            after += dh[t]
            if first[t].any():
                after[first[t]] = 0
        da[:, :, : 2 * HIDDEN] = dg[:, :, : 2 * HIDDEN]
        da, dg = da.reshape(-1, 3 * HIDDEN), dg.reshape(-1, 3 * HIDDEN)
        starts = np.flatnonzero(np.diff(slots, prepend=-1))
        if n:
            g["x"][slots[starts]] = np.add.reduceat(da[order], starts, axis=0)
        g["b"], g["u"] = da.sum(0), every.T @ dg
        return g, h, loss / max(1, n)

    def _adam(self, g: dict, m1: dict, m2: dict, step: int, pace: float) -> None:
        """One step of Adam, the gradient no longer than 1."""
        scale = min(1.0, 1.0 / (1e-8 + float(np.sqrt(sum((v * v).sum() for v in g.values())))))
        for k, v in g.items():
            v *= np.float32(scale)
            m1[k] += np.float32(0.1) * (v - m1[k])
            m2[k] += np.float32(0.01) * (v * v - m2[k])
            self.p[k] -= np.float32(pace) * (m1[k] / np.float32(1 - 0.9**step)) / (np.sqrt(m2[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))

    def fit(self, texts: list[np.ndarray], updates: int = UPDATES, rate: float = RATE) -> "Network":
        """Adam over windows; lanes read one document after another, the state running on."""
        texts = [t for t in texts if len(t)]
        if not texts:
            return self
        stream = self.slot[np.concatenate(texts)]
        begins = np.zeros(len(stream), bool)
        begins[np.cumsum([0, *[len(t) for t in texts[:-1]]])] = True
        lanes = max(1, min(TRAIN_LANES, len(stream) // (2 * WINDOW) or 1))
        span = len(stream) // lanes
        x, first = stream[: lanes * span].reshape(lanes, span).T, begins[: lanes * span].reshape(lanes, span).T.copy()
        first[0] = True
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        h, at = np.zeros((lanes, HIDDEN), np.float32), 0
        for step in range(1, updates + 1):
            if at >= span:
                at = 0
            g, h, _ = self._gradient(h, x[at : at + WINDOW], first[at : at + WINDOW])
            at += WINDOW
            self._adam(g, m1, m2, step, rate * (1 - 0.9 * step / updates))
        return self

    def read(self, texts: Iterator[np.ndarray], rate: float = ROUND_RATE) -> int:
        """Adam over every window of every text, once; gives the tokens read.

        A lane takes the next text when its own ends; the state runs on from
        window to window, and a very long text is read in several lanes, SPAN
        tokens in each.  Towards the end, when
        lanes are empty, windows are summed until there is a full one's worth.
        """
        texts = (self.slot[t[i : i + SPAN]] for t in texts for i in range(0, len(t), SPAN))
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        held: list[np.ndarray] = []
        for t in texts:
            held.append(t)
            if len(held) == ROUND_LANES:
                break
        lanes = len(held)
        full, at, h = lanes * WINDOW, [0] * lanes, np.zeros((lanes, HIDDEN), np.float32)
        total, gathered, summed, step = 0, 0, None, 0
        while held:
            x, first, good = np.zeros((len(held), WINDOW), np.int64), np.zeros((len(held), WINDOW), bool), np.zeros((len(held), WINDOW), bool)
            for k, text in enumerate(held):
                filled = 0
                while filled < WINDOW:
                    i = at[k]
                    if i >= len(text):
                        text = next(texts, None)
                        if text is None:
                            text = held[k]
                            break
                        held[k], i = text, 0
                    if not i:
                        first[k, filled] = True
                    part = text[i : i + WINDOW - filled]
                    x[k, filled : filled + len(part)] = part
                    filled += len(part)
                    at[k] = i + len(part)
                good[k, :filled] = True
            live = np.flatnonzero(good[:, 0])
            if len(live) < len(held):
                held, at = [held[k] for k in live.tolist()], [at[k] for k in live.tolist()]
                x, first, good, h = x[live], first[live], good[live], h[live]
                if not held:
                    break
            n = int(good.sum())
            g, h, _ = self._gradient(h, x.T, first.T, None if n == good.size else good.T)
            if summed is None:
                summed, gathered = g, n
            else:
                for k, v in g.items():
                    summed[k] = (summed[k] * np.float32(gathered) + v * np.float32(n)) / np.float32(gathered + n)
                gathered += n
            total += n
            if gathered >= full:
                step += 1
                self._adam(summed, m1, m2, step, rate)
                summed = None
        if summed is not None:
            self._adam(summed, m1, m2, step + 1, rate * gathered / full)
        return total

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10-likelihood of each whole text (outputs of the network, the end among them)."""
        out = np.zeros(len(texts))
        order = sorted((i for i, t in enumerate(texts) if len(t)), key=lambda i: -len(texts[i]))
        if not order:
            return out
        lanes: list[list[int]] = [[] for _ in range(min(LANES, len(order)))]
        load = np.zeros(len(lanes), np.int64)
        for i in order:
            k = int(load.argmin())
            lanes[k].append(i)
            load[k] += len(texts[i])
        by_load = np.argsort(-load, kind="stable")
        lanes, load = [lanes[k] for k in by_load], load[by_load]
        flat = [self.slot[np.concatenate([texts[i] for i in lane])] for lane in lanes]
        owner = [np.repeat(lane, [len(texts[i]) for i in lane]) for lane in lanes]
        h, inputs = np.zeros((len(lanes), HIDDEN), np.float32), self._inputs()
        for at in range(0, int(load[0]), BLOCK):
            until = min(at + BLOCK, int(load[0]))
            live = int(np.searchsorted(-load, -at, side="left"))
            x, who = np.zeros((until - at, live), np.int64), np.full((until - at, live), -1, np.int64)
            for k in range(live):
                part = flat[k][at:until]
                x[: len(part), k] = part
                who[: len(part), k] = owner[k][at:until]
            last = np.array([owner[k][at - 1] if at else -1 for k in range(live)])
            first = np.concatenate([last[None, :], who[:-1]]) != who
            h = h[:live]
            states = np.empty((until - at, live, HIDDEN), np.float32)
            for t in range(until - at):
                if first[t].any():
                    h = np.where(first[t][:, None], np.float32(0), h)
                states[t] = h
                h = self._move(h, inputs[x[t]])[0]
            good = who >= 0
            gained = self.log_prob(states[good], x[good])
            out += np.bincount(who[good], gained, len(texts))
        return out / np.log(10)


def _outputs(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Network outputs and hot places of words, the end included."""
    words = [*words, END]
    place = vocab.place(words)
    output = np.where(place >= 0, vocab.output[np.maximum(place, 0)] if len(vocab.output) else 0, 0)
    for k in np.flatnonzero(place < 0).tolist():
        output[k] = OUTPUTS - BUCKETS + bucket(words[k])
    return output, place


def _joined(batches: Iterator, text_index: int, size: int) -> Iterator:
    """Batches put together until their texts have so many bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, total = [], 0
    for batch in in_slices(batches, text_index):
        held.append(batch)
        total += pc.sum(pc.binary_length(batch.column(text_index))).as_py() or 0
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def tokenise(docs: DataFrame, vocab, part, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row as the network reads it: id, row (its own number), counts by the hot words, outputs, other words; by ``part``.

    The table is written to the shared folder once and read by every round and
    by the scoring.
    """
    import pyarrow as pa

    source = pick(docs, id_col, text_col).withColumn("_part", part)
    cold_type = pa.list_(pa.struct([("word", pa.string()), ("bucket", pa.int32()), ("times", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known_words, serial = vocab.value, TaskContext.get().partitionId() << 36
        for batch in _joined(batches, 1, TOKENISED_BYTES):
            different, codes, border = _coded(batch.column(1))
            place = known_words.place(different)
            is_hot, code = place >= 0, np.maximum(place, 0)
            buckets = np.array([-1 if h else bucket(w) for w, h in zip(different, is_hot.tolist())], np.int64)
            some = len(known_words.output) > 0
            outputs = np.where(is_hot, known_words.output[code] if some else 0, OUTPUTS - BUCKETS + buckets).astype(np.uint16)[codes]

            def sums(values: np.ndarray) -> np.ndarray:
                run = np.concatenate([[0], np.cumsum(np.where(is_hot, values, 0)[codes])])
                return run[border[1:]] - run[border[:-1]]

            n = np.diff(border)
            base, rest = (sums(x[code] if some else np.zeros(len(code))) for x in (known_words.log_count, known_words.rest))
            owner = np.repeat(np.arange(len(n)), n)
            strange = ~is_hot[codes]
            pair, times = np.unique(owner[strange] << 32 | codes[strange], return_counts=True)
            word = pair & 0xFFFFFFFF
            others = pa.StructArray.from_arrays([pa.array(different, pa.binary()).take(pa.array(word)).cast(pa.string()), pa.array(buckets[word], pa.int32()), pa.array(times, pa.int32())], ["word", "bucket", "times"])
            ends = np.searchsorted(pair >> 32, np.arange(len(n) + 1))
            rows = pa.array(range(serial, serial + len(n)), pa.int64())
            serial += len(n)
            packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((2 * border).astype(np.int64)), pa.py_buffer(outputs.tobytes())]).cast(pa.binary())
            columns = [batch.column(0), rows, pa.array(n, pa.int64()), pa.array(sums(np.ones(len(code))).astype(np.int64), pa.int64()), pa.array(base, pa.float64()), pa.array(rest, pa.float64()), packed, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), others).cast(cold_type), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "row", "n_tokens", "known", "base", "rest", "outputs", "cold", "part"])

    kind = source.schema[id_col].dataType.simpleString()
    made = source.mapInArrow(run, f"id {kind}, row long, n_tokens long, known long, base double, rest double, outputs binary, cold array<struct<word:string,bucket:int,times:int>>, part int")
    path = scratch(docs.sparkSession, "tokens")
    made.write.partitionBy("part").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def round_of(id_col: str):
    """The round in which a training document is read."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(10)), F.lit(ROUNDS)).cast("int")


def fit(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, tokens: DataFrame | None = None) -> Network:
    """A network started on about ``rows`` of the training documents ``docs``, then trained on all of them once.

    The start is drawn by a hash of the id.  Round k reads the part k of
    ``tokens`` (:func:`tokenise`, made here if not given); each of its tasks trains the weights of the round before on
    what it reads, and the weights are averaged by tokens.  ``read_tokens`` is
    how many the rounds read.
    """
    if tokens is None:
        text_batches(docs.sparkSession)
        tokens = tokenise(pick(docs, id_col, text_col), docs.sparkSession.sparkContext.broadcast(vocab), round_of(id_col), id_col, text_col)
    own = tokens.filter(F.col("part") < ROUNDS)
    count = own.count()
    draw = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    got = sorted((str(r[0]), bytes(r[1])) for r in own.filter(draw < min(1.0, rows / max(1, count))).select("id", "outputs").collect())
    network = Network(vocab.prior).fit([np.frombuffer(t, np.uint16) for _, t in got])
    network.read_tokens = 0
    if count:
        for k in range(ROUNDS):
            network.read_tokens += _round(tokens.filter(F.col("part") == k).select("outputs"), network, ROUND_RATE * (1 - 0.8 * k / ROUNDS))
    return network


def _round(tokens: DataFrame, network: Network, rate: float) -> int:
    """Sets the network's weights to the average of what tasks learn from their documents; gives the tokens read.

    Weights travel in pieces and are summed in the order of the tasks.
    """
    import pyarrow as pa

    context = tokens.sparkSession.sparkContext
    start = context.broadcast(network)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        net = copy.deepcopy(start.value)  # a worker's later tasks begin with the same weights
        n = net.read((np.frombuffer(t, np.uint16) for batch in batches for t in batch.column(0).to_pylist()), rate)
        if n:
            flat, task = np.concatenate([net.p[k].ravel() for k in sorted(net.p)]).astype(np.float32), TaskContext.get().partitionId()
            pieces = [flat[i : i + PIECE].tobytes() for i in range(0, len(flat), PIECE)]
            k = len(pieces)
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([task] * k, pa.int32()), pa.array([n] * k, pa.int64()), pa.array(pieces, pa.binary())], ["piece", "task", "tokens", "weights"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, n, w in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                held = sums.setdefault(piece, [0, 0.0])
                held[0] += n
                held[1] = held[1] + n * np.frombuffer(w, np.float32).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([(w / n).tobytes() for n, w in sums.values()], pa.binary())], ["piece", "tokens", "weights"])

    learned = tokens.mapInArrow(learn, "piece int, task int, tokens long, weights binary")
    got = sorted(tuple(r) for r in learned.repartition(8, "piece").sortWithinPartitions("piece", "task").mapInArrow(add, "piece int, tokens long, weights binary").collect())
    start.unpersist()
    if not got:
        return 0
    flat, at = np.concatenate([np.frombuffer(w, np.float64) for *_, w in got]).astype(np.float32), 0
    for k in sorted(network.p):
        v = network.p[k]
        network.p[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return got[0][1]


def score(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all whole texts by what is learned outside fold ``held``.

    The fold is crc32 of the id as text, modulo ``folds``.  Gives id, held_out,
    n_tokens, n_known, train_tokens, base_score, score.  A null text counts as
    empty and scores its end token alone; repeated rows each get a row; an
    empty table gives an empty one; without training texts all counts are 0.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    text_batches(spark)
    source = pick(docs, id_col, text_col)
    fold = F.pmod(crc_of_id(F.col(id_col)), F.lit(folds))
    learn = source.filter(fold != held)
    counts = saved(count_words(learn, text_col), "word-counts")
    vocab = vocabulary(counts)
    words = spark.sparkContext.broadcast(vocab)
    part = F.when(fold == held, F.lit(ROUNDS)).otherwise(round_of(id_col)).cast("int")
    tokens = tokenise(source, words, part, id_col, text_col)
    sent = spark.sparkContext.broadcast(fit(learn, vocab, id_col, text_col, tokens=tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, names = sent.value, ["id", "row", "n_tokens", "known", "base", "gained"]
        ready, waiting = [], 0

        def flush():
            nonlocal ready, waiting
            found = network.score([np.frombuffer(t, np.uint16) for batch in ready for t in batch.column(6).to_pylist()])
            at, out = 0, []
            for batch in ready:
                gained = found[at : at + batch.num_rows] + batch.column(5).to_numpy()
                at += batch.num_rows
                out.append(pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(gained, pa.float64())], names))
            ready, waiting = [], 0
            return out

        for batch in batches:
            ready.append(batch)
            waiting += sum(batch.column(2).to_pylist())
            if waiting > BUFFER_TOKENS:
                yield from flush()
        if ready:
            yield from flush()

    kind = source.schema[id_col].dataType.simpleString()
    scored = tokens.select("id", "row", "n_tokens", "known", "base", "rest", "outputs").mapInArrow(run, f"id {kind}, row long, n_tokens long, known long, base double, gained double")
    cold = tokens.select("row", F.explode("cold").alias("c")).select("row", "c.word", "c.bucket", "c.times").join(counts.select("word", "n"), "word", "left")
    mass = F.element_at(F.array(*[F.lit(float(x)) for x in vocab.log_mass]), F.col("bucket") + 1)
    log_count = F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))
    cold = cold.groupBy("row").agg(
        F.sum(F.col("times") * log_count).alias("cold_base"),
        F.sum(F.col("times") * (log_count - mass)).alias("cold_gained"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("cold_known"),
    )
    both = scored.join(cold, "row", "left")
    zero = F.lit(0.0)
    every = float(np.log10(vocab.total + vocab.distinct + 1))
    return both.select(
        F.col("id").alias(id_col),
        (F.pmod(crc_of_id(F.col("id")), F.lit(folds)) == held).alias("held_out"),
        F.col("n_tokens"),
        (F.col("known") + F.coalesce("cold_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("cold_base", zero) - F.col("n_tokens") * F.lit(every)).alias("base_score"),
        (F.col("gained") + F.coalesce("cold_gained", zero)).alias("score"),
    )
