"""Benchmark passages in documents, by the q-gram lemma.

A passage of m characters with at most k edits keeps at least m - q + 1 - k q
of an item's q-grams, and they lie on diagonals (document position less item
position) at most k apart.  So shared q-grams are counted in overlapping bands
of diagonals, bands that reach the bound are kept, and the region of each is
verified by a banded alignment of the whole item.  No passage within the edit
budget can be missed.  Characters are compared in lower case; a run of anything
but letters and digits counts as one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .common import in_slices, pick, positions, text_batches

#: Length of q-grams, and edits as a share of an item's length.
Q, EDITS = 8, 0.10
#: Characters of items that one pass holds; further items take further passes.
BLOCK_CHARS = 2_000_000
#: Shared q-grams that are listed at a time, and places of one q-gram in an item from which on bands are listed instead.
LISTED, HEAVY = 2_000_000, 16
#: Items longer than this are aligned by furthest-reaching diagonals.
LONG_ITEM = 2048

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22

_TABLE: np.ndarray | None = None


def _table() -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        def code(c: int) -> int:
            s = chr(c)
            if not s.isalnum():
                return 32
            low = s.lower()
            return ord(low) if len(low) == 1 else c

        _TABLE = np.array([code(c) for c in range(0x10000)], np.uint32)
    return _TABLE


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Compared characters as numbers, and where in the text each stands."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    table = _table()
    codes = np.where(points < 0x10000, table[np.minimum(points, 0xFFFF)], points) if len(points) and int(points.max()) >= 0x10000 else table[points]
    space = codes == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    if len(keep):
        keep[0] = not space[0]
    where = np.flatnonzero(keep)
    codes = codes[where]
    if len(codes) and codes[-1] == 32:
        codes, where = codes[:-1], where[:-1]
    return codes, where


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each position on."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, length, power = codes.astype(np.uint64) + np.uint64(1), 1, _BASE
    out, done = None, 0
    with np.errstate(over="ignore"):
        rest = q
        while rest:
            if rest & 1:
                part = h[done : done + n]
                out = part.copy() if out is None else out * power + part
                done += length
            rest >>= 1
            if rest:
                h = h[:-length] * power + h[length:]
                length, power = 2 * length, power * power
        return (out ^ (out >> np.uint64(29))) * _BASE


@dataclass
class Items:
    """Benchmark items of one block, with their q-grams sorted.

    ``hashes`` are the different q-grams; those of number h stand in the groups
    from ``group[h]`` on, one for each item that has it; group g is of
    ``item[g]`` and has the places ``offset[place[g] : place[g + 1]]``.
    """

    ids: list
    codes: list[np.ndarray]
    budget: np.ndarray
    least: np.ndarray
    hashes: np.ndarray
    group: np.ndarray
    item: np.ndarray
    place: np.ndarray
    offset: np.ndarray
    filter: np.ndarray
    short: list[int]
    longest: int
    origin: int  # diagonals are numbered from -origin on

    @classmethod
    def of(cls, rows: list[tuple], q: int = Q, edits: float = EDITS) -> "Items":
        ids, codes = [], []
        for item_id, text in rows:
            c, _ = normal(text or "")
            if len(c):
                ids.append(item_id)
                codes.append(c)
        sizes = np.array([len(c) for c in codes], np.int64)
        budget = np.minimum((edits * sizes).astype(np.int64), np.maximum(0, (sizes - q) // q))
        least = sizes - q + 1 - budget * q
        short = [i for i, n in enumerate(sizes) if n < q]
        parts = [(grams(c, q), i) for i, c in enumerate(codes) if len(c) >= q]
        hashes = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64)
        item = np.concatenate([np.full(len(h), i) for h, i in parts]) if parts else np.zeros(0, np.int64)
        offset = np.concatenate([np.arange(len(h)) for h, _ in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")  # within a q-gram by item, then by place
        hashes, item, offset = hashes[order], item[order], offset[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        begins = new.copy()
        begins[1:] |= item[1:] != item[:-1]
        first = np.flatnonzero(begins)
        seen = np.zeros(1 << _BITS, bool)
        seen[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        group = np.append(np.flatnonzero(new[first]), len(first))
        return cls(ids, codes, budget, least, hashes[new], group, item[first], np.append(first, len(hashes)), offset, seen, short, int(sizes.max()) if len(sizes) else 0, int(sizes.max() + budget.max() + 1) if len(sizes) else 0)


_POWERS = np.ones(1, np.uint64)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def _sums(codes: np.ndarray) -> np.ndarray:
    """Sum of code times power up to each place; equal parts have equal differences but for a power."""
    global _POWERS
    if len(_POWERS) <= len(codes):
        up = np.full(max(1 << 16, 2 * len(codes)), _ODD)
        up[0] = 1
        _POWERS = np.multiply.accumulate(up)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(codes)], dtype=np.uint64)])


def _common(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, m: int, n: int) -> np.ndarray:
    """How far two texts, given by their sums, agree from places i and j on."""
    most = np.minimum(m - i, n - j)
    length, step, growing = np.zeros(len(i), np.int64), np.ones(len(i), np.int64), np.ones(len(i), bool)
    live = np.flatnonzero(most > 0)
    while len(live):  # the step doubles while they agree, then halves what is left open
        reach = np.minimum(step[live], most[live] - length[live])
        x, y = i[live] + length[live], j[live] + length[live]
        same = (a[x + reach] - a[x]) * _POWERS[y] == (b[y + reach] - b[y]) * _POWERS[x]
        most[live] = np.where(same, most[live], length[live] + reach - 1)
        length[live] += np.where(same, reach, 0)
        growing[live] &= same
        step[live] = np.where(growing[live], 2 * reach, (most[live] - length[live] + 1) >> 1)
        live = live[length[live] < most[live]]
    return length


def align_long(item: np.ndarray, text: np.ndarray, first: int, width: int, budget: int) -> tuple[int, int, int]:
    """:func:`align` of one long item: (edits, start, end), edits over the budget if there is no such alignment.

    For each number of edits the farthest place of the item reached on each
    diagonal is kept; how far two texts agree is found on sums of their
    characters, so a copy costs one look at each diagonal of the band, and every
    edit another.  Of equal alignments the one that ends first wins.
    """
    m, n = len(item), len(text)
    a, b = _sums(item), _sums(text)
    _sums(np.zeros(max(m, n) + 1, np.uint32))
    diagonal = first + np.arange(width)
    never, limit = np.int64(-(1 << 50)), np.minimum(m, n - diagonal)
    reach = np.where((diagonal >= 0) & (diagonal <= n), 0, never)
    start = diagonal.copy()
    for edits in range(budget + 1):
        if edits:
            left, right = np.full(width, never), np.full(width, never)
            left[1:], right[:-1] = reach[:-1], reach[1:] + 1  # a text character, an item character without partner
            both = np.stack([reach + 1, left, right])
            best = both.argmax(0)
            start = np.where(best == 0, start, np.where(best == 1, np.roll(start, 1), np.roll(start, -1)))
            reach = np.minimum(both[best, np.arange(width)], limit)
            reach[reach < 0] = never
        some = np.flatnonzero(reach >= 0)
        reach[some] += _common(a, b, reach[some], reach[some] + diagonal[some], m, n)
        done = np.flatnonzero(reach == m)
        if len(done):
            k = int(done[0])
            return edits, int(start[k]), int(m + diagonal[k])
    return budget + 1, 0, 0


def _spread(begin: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers from begin[i] on, times[i] of them; and i for each."""
    owner = np.repeat(np.arange(len(times)), times)
    return np.repeat(begin - (np.cumsum(times) - times), times) + np.arange(int(times.sum())), owner


def align(items: list[np.ndarray], text: np.ndarray, first: np.ndarray, width: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of whole items against parts of ``text``, many alignments in step: (edits, start, end) of each.

    Alignment r stays inside text positions low[r] to high[r] and on the
    diagonals (text position less item position) from first[r] on, width[r] of
    them.  Of equal alignments the one that ends first wins.
    """
    n, widest, far = len(items), int(width.max()), np.int64(1 << 20)
    sizes = np.array([len(c) for c in items])
    padded = np.zeros((n, int(sizes.max())), np.uint32)
    for r, c in enumerate(items):
        padded[r, : len(c)] = c
    steps = np.arange(widest)
    here = first[:, None] + steps
    inside = steps < width[:, None]
    low, high = low[:, None], high[:, None]
    cost = np.where(inside & (here >= low) & (here <= high), 0, far)
    start = here.copy()
    done_cost, done_start = np.full(cost.shape, far), start.copy()
    rank = np.int64(widest + 1)
    column, edge = np.full((n, 1), far), np.zeros((n, 1), np.int64)
    for i in range(padded.shape[1]):
        at = here + i
        ok = inside & (at >= low) & (at < high)
        differs = np.where(ok, text[np.clip(at, 0, len(text) - 1)] != padded[:, i : i + 1], far)
        diagonal = cost + differs
        skip = np.concatenate([cost[:, 1:], column], 1) + 1  # the item's character has no partner
        new = np.minimum(diagonal, skip)
        origin = np.where(diagonal <= skip, start, np.concatenate([start[:, 1:], edge], 1))
        best = np.minimum.accumulate((new - steps) * rank + (widest - steps), 1)  # text characters without partner
        source = widest - best % rank
        cost = np.minimum(np.take_along_axis(new, source, 1) + steps - source, far)
        start = np.take_along_axis(origin, source, 1)
        end = at + 1
        cost = np.where(inside & (end >= low) & (end <= high), cost, far)
        over = sizes == i + 1
        if over.any():
            done_cost[over], done_start[over] = cost[over], start[over]
    k = done_cost.argmin(1)
    rows = np.arange(n)
    return done_cost[rows, k], done_start[rows, k], first + sizes + k


#: Bands of an item, at most.
_SPACE = np.int64(1) << 34


def _hits(items: Items, spots: np.ndarray, number: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shared q-grams as (key of item and band, whether this text place is new to it, place in the item), LISTED or so at a time.

    Band b has the diagonals from b * (budget + 1) - origin on, twice the
    budget and two of them.  Of a q-gram that an item holds HEAVY times or more
    not its places are listed but the bands that they reach, with the place -1,
    so repetitive texts and items do not multiply.
    """
    times = items.group[number + 1] - items.group[number]
    part = np.cumsum(times * HEAVY) // LISTED
    for at in np.split(np.arange(len(spots)), np.flatnonzero(np.diff(part)) + 1):
        group, owner = _spread(items.group[number[at]], times[at])
        spot, step = spots[at][owner], items.budget[items.item[group]] + 1
        size = items.place[group + 1] - items.place[group]
        light = np.flatnonzero(size < HEAVY)
        index, owner = _spread(items.place[group[light]], size[light])
        owner = light[owner]
        band = (spot[owner] - items.offset[index] + items.origin) // step[owner]
        listed = [(owner, band, items.offset[index])]
        heavy = np.flatnonzero(size >= HEAVY)
        if len(heavy):
            g, s, w = group[heavy], spot[heavy], step[heavy]
            low = (s - items.offset[items.place[g + 1] - 1] + items.origin) // w
            high = (s - items.offset[items.place[g]] + items.origin) // w
            band, owner = _spread(low, high - low + 1)
            # the band is reached if there is a place from s + origin - (band + 1) * step + 1 to s + origin - band * step
            top = s[owner] + items.origin - band * w[owner]
            wide = np.int64(length + 2 * items.origin + 2)
            flat = np.repeat(np.arange(len(g)), items.place[g + 1] - items.place[g]) * wide + items.offset[_spread(items.place[g], items.place[g + 1] - items.place[g])[0]]
            reached = np.searchsorted(flat, owner * wide + np.minimum(top, wide - 1), "right") > np.searchsorted(flat, owner * wide + np.maximum(top - w[owner] + 1, 0), "left")
            listed.append((heavy[owner[reached]], band[reached], np.full(int(reached.sum()), -1)))
        owner, band, offset = (np.concatenate(x) for x in zip(*listed))
        both = np.concatenate([items.item[group][owner] * _SPACE + band, items.item[group][owner] * _SPACE + band - 1])
        owner, offset = np.concatenate([owner, owner]), np.concatenate([offset, offset])
        order = np.lexsort((owner, both))
        both, owner, offset = both[order], owner[order], offset[order]
        new = np.ones(len(both), bool)
        new[1:] = (both[1:] != both[:-1]) | (owner[1:] != owner[:-1])
        yield both, new, offset


def _find(items: Items, text: np.ndarray, lows: np.ndarray, q: int) -> list[tuple[int, int, int, int, int]]:
    """(document, item, start, end, edits) in a joined text of documents that begin at ``lows``."""
    found: list[tuple[int, int, int, int, int]] = []
    highs = np.append(lows[1:], len(text) + 1) - 1  # a separator stands after each document
    h = grams(text, q)
    if len(h) and len(items.hashes):
        spots = np.flatnonzero(items.filter[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        number = np.minimum(np.searchsorted(items.hashes, h[spots]), len(items.hashes) - 1)
        real = items.hashes[number] == h[spots]
        spots, number = spots[real], number[real]
        if len(spots):
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for key, new, _ in _hits(items, spots, number, len(text)):
                more, n = np.unique(key[new], return_counts=True)
                keys, inverse = np.unique(np.concatenate([keys, more]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            keys = keys[counts >= items.least[keys // _SPACE]]
            if len(keys):
                # an item's characters have one partner each too, so its places must reach the bound as well
                places, free = np.zeros(0, np.int64), np.zeros(len(keys), bool)
                wide = np.int64(items.longest + 1)
                for key, _, offset in _hits(items, spots, number, len(text)):
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    ok = keys[at] == key
                    free[at[ok & (offset < 0)]] = True
                    ok &= offset >= 0
                    places = np.union1d(places, at[ok] * wide + offset[ok])
                item, band = keys // _SPACE, keys % _SPACE
                good = free | (np.bincount(places // wide, minlength=len(keys)) >= items.least[item])
                found += _verify(items, text, lows, highs, item[good], band[good])
    for i in items.short:
        c = items.codes[i]
        places = np.flatnonzero(text[: len(text) - len(c) + 1] == c[0]) if len(text) >= len(c) else np.zeros(0, np.int64)
        for j in range(1, len(c)):
            places = places[text[places + j] == c[j]]
        d = np.searchsorted(lows, places, "right") - 1
        found += [(int(x), i, int(p), int(p) + len(c), 0) for x, p in zip(d, places) if _whole(text, int(p), int(p) + len(c))]
    return found


def _whole(text: np.ndarray, a: int, b: int) -> bool:
    """Whether a short match begins and ends at word borders."""
    return (a == 0 or text[a - 1] in (0, 32)) and (b >= len(text) or text[b] in (0, 32))


def _verify(items: Items, text, lows, highs, item: np.ndarray, band: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Align each item with the documents that its band crosses."""
    jobs = []
    for i, b in zip(item.tolist(), band.tolist()):
        k, size = int(items.budget[i]), len(items.codes[i])
        first = b * (k + 1) - items.origin
        last = first + 2 * k + 1
        d = max(0, int(np.searchsorted(lows, max(first, 0), "right")) - 1)
        while d < len(lows) and lows[d] <= last + size:
            if min(highs[d], last + size) - max(lows[d], first) >= size - k:
                jobs.append((k, i, first, 2 * k + 2, int(lows[d]), int(highs[d]), d))
            d += 1
    jobs.sort()
    found, long = [], [j for j in jobs if len(items.codes[j[1]]) > LONG_ITEM]
    jobs = [j for j in jobs if len(items.codes[j[1]]) <= LONG_ITEM]
    for k, i, first, width, low, high, d in long:
        edits, start, end = align_long(items.codes[i], text[low:high], first - low, width, k)
        if edits <= k:
            found.append((d, i, start + low, end + low, edits))
    for at in range(0, len(jobs), 128):
        part = jobs[at : at + 128]
        first, width, low, high = (np.array([j[c] for j in part], np.int64) for c in (2, 3, 4, 5))
        edits, start, end = align([items.codes[j[1]] for j in part], text, first, width, low, high)
        found += [(j[6], j[1], int(s), int(e), int(x)) for j, x, s, e in zip(part, edits, start, end) if x <= j[0]]
    return found


def _search(items: Items, texts: list[str], q: int) -> list[list[tuple]]:
    """For each text: (item id, start, end, edits) in characters of the text, regions of an item apart from each other."""
    parts, wheres, lows, at = [], [], [], 0
    for t in texts:
        c, w = normal(t)
        parts += [c, np.zeros(1, np.uint32)]
        wheres.append(w)
        lows.append(at)
        at += len(c) + 1
    text, lows = np.concatenate(parts), np.array(lows, np.int64)
    out: list[list[tuple]] = [[] for _ in texts]
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, i, start, end, edits in sorted(set(_find(items, text, lows, q)), key=lambda x: (x[0], x[1], x[4], x[2], x[3])):
        spans = taken.setdefault((d, i), [])
        if any(start < e and s < end for s, e in spans):
            continue
        spans.append((start, end))
        w = wheres[d]
        a, b = start - int(lows[d]), end - int(lows[d])
        if b > a:
            out[d].append((items.ids[i], int(w[a]), int(w[b - 1]) + 1, edits))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in pick(benchmark, item_col, text_col).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1] or "")
        if size > BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Regions of documents that match a whole benchmark item within its edit budget.

    Gives ``id_col``, ``item_col``, start and length (code points), edits,
    similarity; a row for each region, regions of one item not overlapping.
    The budget is ``edits`` of the item's compared length, less for items so
    short that the bound would fall to nothing.  Null and empty texts and items
    match nothing; items under q characters must occur exactly as whole words;
    repeated rows are each searched; items may have any length (of long ones
    those with many edits take longest: edits times twice the budget steps).  Items are sent to the workers in blocks
    of at most BLOCK_CHARS; each block is one pass over the documents.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    text_batches(spark)
    source = pick(docs, id_col, text_col)
    item_type = to_arrow_type(pick(benchmark, item_col).schema[item_col].dataType)
    kinds = f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, `{item_col}` {pick(benchmark, item_col).schema[item_col].dataType.simpleString()}, start int, length int, edits int, similarity double"
    found = None

    def searcher(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in in_slices(batches, 1, 1_000_000):
                rows, hits = [], []
                for r, spans in enumerate(_search(items, [t or "" for t in batch.column(1).to_pylist()], q)):
                    for s in spans:
                        rows.append(r)
                        hits.append(s)
                if not rows:
                    continue
                lengths = {i: len(c) for i, c in zip(items.ids, items.codes)}
                columns = [pa.array([h[0] for h in hits], item_type), *(pa.array(x, pa.int32()) for x in ([h[1] for h in hits], [h[2] - h[1] for h in hits], [h[3] for h in hits]))]
                columns.append(pa.array([1 - h[3] / lengths[h[0]] for h in hits], pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], [id_col, item_col, "start", "length", "edits", "similarity"])

        return run

    for rows in _blocks(benchmark, item_col, item_text_col):
        part = source.mapInArrow(searcher(spark.sparkContext.broadcast(Items.of(rows, q, edits))), kinds)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], kinds)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows in whose text :func:`leaks` finds nothing, all columns as they are."""
    import pyarrow as pa

    spark = docs.sparkSession
    text_batches(spark)
    left, names = positions(docs)
    at = names.index(text_col)

    def cleaner(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_slices(batches, at, 1_000_000):
                yield batch.filter(pa.array([not spans for spans in _search(held.value, [t or "" for t in batch.column(at).to_pylist()], q)]))

        return run

    for rows in _blocks(benchmark, item_col, item_text_col):
        left = left.mapInArrow(cleaner(spark.sparkContext.broadcast(Items.of(rows, q, edits))), left.schema)
    return left.toDF(*names)
