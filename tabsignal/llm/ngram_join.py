"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact sets decide.

Texts with the same set of word n-grams form a class and are compared once.  A
class has a signature of minhash labels, cut into trees; in each tree its labels
are a path.  All paths of all trees are sorted once over the cluster, which is
the forest: the classes under a trie node stand next to each other, and the
common prefix with the row before tells where nodes end.  Nodes that reach over
the border of a partition are put together from the partitions' counts of them.

A class begins with the whole path matched in every tree and shortens its
matched prefixes step by step, in whichever tree that brings in the fewest
other classes for the recall gained, until sets of the wanted similarity share
one of its prefixes with at least the target recall.  A crowded tree keeps a
long prefix that way, and an empty one is followed up to a short one.  Classes
alone at the shortest prefix of every tree have no partner at all.

A node that some class asks for, and no larger one around it, is a bucket.  A
pair is examined in the first tree in which it shares a bucket, so once.  There
whole signatures are compared first (the pair is dropped if they agree five
standard deviations less than sets of the wanted similarity do), then the exact
n-gram sets of the classes that are left.  Large buckets are compared block by
block, in a task for each pair of blocks.  A task returns, for each class, how
many documents it is linked to and one edge of a spanning forest, so results
grow with the documents and not with the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, in_slices, pick, positions, saved, text_batches
from .decontaminate import normal
from .graph import components, look_up

#: Words in a shingle, and the least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Trees of the forest, labels of a whole path, bits of a label, least share of links found.
TREES, DEPTH, BITS, RECALL = 24, 6, 10, 0.99999
#: Prefixes may become so much shorter than they would have to be if all trees were alike.
SLACK = 2
#: Signatures of a pair may agree so many standard deviations less than the wanted similarity.
DEVIATIONS = 5
#: Members of a block of a bucket.
BLOCK = 512

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)
_DRAW = np.random.default_rng(1)
_MULTIPLY = _DRAW.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _DRAW.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _A), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _POWERS = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted different hashes of the text's n-word shingles.

    Words are runs of letters and digits in lower case.  A text of fewer words
    has one shingle of all of them; a text without words has none.
    """
    codes, _ = normal(text)
    if not len(codes):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)])
    gaps = np.flatnonzero(codes == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(codes)]])
    words = _mix((sums[ends] - sums[starts]) * down[starts])
    size = min(n, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * _A + words[k : k + len(out)]
    return np.unique(_mix(out + np.uint64(size)))


def misses(similarity: float) -> np.ndarray:
    """Log probability that sets of this similarity differ in a prefix of 0, 1, ... DEPTH labels."""
    with np.errstate(divide="ignore"):
        return np.log1p(-np.minimum(similarity ** np.arange(DEPTH + 1.0), 1.0))


def shortest_prefix(similarity: float, recall: float) -> int:
    """The shortest prefix that is ever matched: SLACK labels under what trees that are all alike would need."""
    alike = [d for d in range(1, DEPTH + 1) if TREES * misses(similarity)[d] <= np.log(1 - recall)]
    if not alike:
        raise ValueError(f"{TREES} trees cannot find pairs of similarity {similarity} with a recall of {recall}")
    return max(1, max(alike) - SLACK)


def shorten(sizes: np.ndarray, similarity: float, recall: float) -> np.ndarray:
    """Matched prefix lengths, class by tree.

    ``sizes`` (class, tree, length from the shortest to DEPTH) is how many
    classes share the prefix of that length.  The prefix that brings in the
    fewest classes for the recall it gains is shortened next.
    """
    miss, goal = misses(similarity), np.log(1 - recall)
    least = DEPTH + 1 - sizes.shape[2]
    depth = np.full(sizes.shape[:2], DEPTH)
    total = depth.shape[1] * np.full(len(depth), miss[DEPTH])
    while len(rows := np.flatnonzero(total > goal)):
        now = depth[rows]
        at = np.maximum(now - 1 - least, 0)[..., None]
        more = np.take_along_axis(sizes[rows], at, 2)[..., 0] - np.take_along_axis(sizes[rows], at + (now > least)[..., None], 2)[..., 0]
        price = np.where(now > least, (more + 1e-3) / (miss[now] - miss[np.maximum(now - 1, 1)]), np.inf)
        tree = price.argmin(1)
        some = np.isfinite(price[np.arange(len(rows)), tree])
        if not some.any():
            break
        rows, tree = rows[some], tree[some]
        old = depth[rows, tree]
        depth[rows, tree] = old - 1
        total[rows] += miss[old - 1] - miss[old]
    return depth


def paths(hashes: np.ndarray) -> np.ndarray:
    """The path in each tree: DEPTH labels of BITS bits in a number, the first label highest."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * _MULTIPLY + _ADD).min(0), out=least)
    labels = (_mix(_mix(least) + _ADD) >> np.uint64(64 - BITS)).reshape(TREES, DEPTH)
    out = np.zeros(TREES, np.uint64)
    for j in range(DEPTH):
        out = (out << np.uint64(BITS)) | labels[:, j]
    return out.view(np.int64)


def _labels(path: np.ndarray) -> np.ndarray:
    """All labels of signatures, class by label."""
    shift = np.arange(DEPTH - 1, -1, -1, dtype=np.int64) * BITS
    return ((path[:, :, None] >> shift) & ((1 << BITS) - 1)).astype(np.int16).reshape(len(path), -1)


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """id, mark (hash of the text), cls binary (digest of the n-gram set, null without words), paths array<long>."""
    import pyarrow as pa

    source = pick(docs, id_col, text_col).withColumn("_mark", F.xxhash64(F.col(text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            digests, found, known = [], [], {}
            for text in batch.column(1).to_pylist():
                hashes = shingles(text or "", n)
                digest = _digest(hashes) if len(hashes) else None
                if digest not in known:
                    known[digest] = paths(hashes).tolist() if digest else None
                digests.append(digest)
                found.append(known[digest])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["id", "mark", "cls", "paths"])

    return source.mapInArrow(run, f"id {source.schema[id_col].dataType.simpleString()}, mark bigint, cls binary, paths array<bigint>")


def _sorted(rows: DataFrame, what: str, store=saved) -> DataFrame:
    """Rows with tree and path as a sorted forest: ranges of it in runs, each run in order."""
    order = ["tree", "path", "cls"]
    return store(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("run", F.spark_partition_id()), what)


def _runs(batches, names: list[str]) -> Iterator[dict]:
    """Columns of each run of sorted rows, whole: tree and path as arrays, the others as lists."""
    import pyarrow as pa

    held: list = []

    def whole() -> dict:
        table = pa.Table.from_batches(held)
        return {c: table.column(c).to_numpy() if c in ("tree", "path", "depth") else table.column(c).to_pylist() for c in names}

    for batch in batches:
        run = batch.column(batch.schema.get_field_index("run")).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and held[-1].column(held[-1].schema.get_field_index("run"))[0].as_py() != run[a]:
                yield whole()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def _nodes(run: dict, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each prefix length: length, first row of each trie node, rows of each node, node of each row."""
    tree, path = run["tree"].astype(np.int64), run["path"].astype(np.int64)
    for d in range(least, DEPTH + 1):
        prefix = path >> (BITS * (DEPTH - d))
        new = np.ones(len(path), bool)
        new[1:] = (prefix[1:] != prefix[:-1]) | (tree[1:] != tree[:-1])
        first = np.flatnonzero(new)
        yield d, first, np.diff(first, append=len(path)), np.cumsum(new) - 1


def _borders(forest: DataFrame, least: int, with_depth: bool) -> dict[tuple[int, int, int], tuple[int, int]]:
    """(tree, length, prefix) of the nodes that begin or end a run -> classes under it, least depth asked for.

    A run sends two nodes for each prefix length, whatever its rows, so what
    comes to the driver grows with the number of partitions.
    """
    import pyarrow as pa

    def ends(batches):
        for run in _runs(batches, ["tree", "path", *(["depth"] if with_depth else [])]):
            out = []
            for d, first, size, _ in _nodes(run, least):
                asked = np.minimum.reduceat(run["depth"], first) if with_depth else np.full(len(first), DEPTH)
                for k in {0, len(first) - 1}:
                    out.append((int(run["tree"][first[k]]), d, int(run["path"][first[k]]) >> (BITS * (DEPTH - d)), int(size[k]), int(asked[k])))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], ["tree", "d", "prefix", "n", "asked"])

    columns = ["tree", "path", "run", *(["depth"] if with_depth else [])]
    found: dict[tuple[int, int, int], tuple[int, int]] = {}
    for *key, n, asked in forest.select(*columns).mapInArrow(ends, "tree long, d long, prefix long, n long, asked long").collect():
        before = found.get(tuple(key), (0, DEPTH))
        found[tuple(key)] = before[0] + n, min(before[1], asked)
    return found


def company(forest: DataFrame, least: int) -> DataFrame:
    """tree, path, cls, sizes (classes that share the prefix, from the shortest length on) of rows not alone."""
    import pyarrow as pa

    held = forest.sparkSession.sparkContext.broadcast(_borders(forest, least, False))

    def run(batches):
        for part in _runs(batches, ["tree", "path", "cls"]):
            sizes = []
            for d, first, size, node in _nodes(part, least):
                for k in {0, len(first) - 1}:
                    size[k] = held.value[(int(part["tree"][first[k]]), d, int(part["path"][first[k]]) >> (BITS * (DEPTH - d)))][0]
                sizes.append(size[node])
            sizes = np.stack(sizes, 1)
            some = np.flatnonzero(sizes[:, 0] > 1)
            for at in range(0, len(some), 4096):
                rows = some[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(part["tree"][rows], pa.int32()), pa.array(part["path"][rows], pa.int64()), pa.array([part["cls"][i] for i in rows.tolist()], pa.binary()), pa.array(sizes[rows].tolist(), pa.list_(pa.int64()))], ["tree", "path", "cls", "sizes"])

    return forest.mapInArrow(run, "tree int, path bigint, cls binary, sizes array<bigint>")


def matched(near: DataFrame, least: int, similarity: float, recall: float) -> DataFrame:
    """tree, path, cls, depth: the prefix length that each class matches in each tree where it is not alone."""
    import pyarrow as pa

    gathered = near.groupBy("cls").agg(F.collect_list(F.struct("tree", "path", "sizes")).alias("places"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.column(1)
            flat, count = places.flatten(), np.diff(places.offsets.to_numpy())
            owner = np.repeat(np.arange(len(count)), count)
            tree, path = flat.field("tree").to_numpy(), flat.field("path").to_numpy()
            sizes = np.ones((len(count), TREES, DEPTH + 1 - least), np.int64)
            sizes[owner, tree] = flat.field("sizes").flatten().to_numpy().reshape(len(owner), -1)
            depth = shorten(sizes, similarity, recall)[owner, tree]
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(path, pa.int64()), batch.column(0).take(pa.array(owner)), pa.array(depth, pa.int32())], ["tree", "path", "cls", "depth"])

    return gathered.mapInArrow(run, "tree int, path bigint, cls binary, depth int")


def buckets(forest: DataFrame, least: int) -> DataFrame:
    """cls, bucket (the tree in the top byte), n: the largest node asked for around each row, of n > 1 classes."""
    import pyarrow as pa

    held = forest.sparkSession.sparkContext.broadcast(_borders(forest, least, True))

    def run(batches):
        for part in _runs(batches, ["tree", "path", "cls", "depth"]):
            top, n, prefix = np.zeros(len(part["path"]), np.int64), np.zeros(len(part["path"]), np.int64), np.zeros(len(part["path"]), np.int64)
            for d, first, size, node in _nodes(part, least):
                asked = np.minimum.reduceat(part["depth"], first)
                for k in {0, len(first) - 1}:
                    size[k], asked[k] = held.value[(int(part["tree"][first[k]]), d, int(part["path"][first[k]]) >> (BITS * (DEPTH - d)))]
                now = (top == 0) & (asked[node] <= d)
                top[now], n[now], prefix[now] = d, size[node][now], part["path"][now] >> (BITS * (DEPTH - d))
            key = _mix(_mix(prefix.astype(np.uint64) * _A + top.astype(np.uint64)) + part["tree"].astype(np.uint64))
            key = ((key >> np.uint64(8)) | (part["tree"].astype(np.uint64) << np.uint64(56))).view(np.int64)
            some = np.flatnonzero(n > 1)
            for at in range(0, len(some), 4096):
                rows = some[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([part["cls"][i] for i in rows.tolist()], pa.binary()), pa.array(key[rows], pa.int64()), pa.array(n[rows], pa.int64())], ["cls", "bucket", "n"])

    return forest.mapInArrow(run, "cls binary, bucket bigint, n bigint")


def _by_tree(seats: list[list[int]]) -> np.ndarray:
    """Bucket of each class in each tree, -1 where it has none."""
    out = np.full((len(seats), TREES), -1, np.int64)
    for i, s in enumerate(seats):
        for b in s:
            out[i, b >> 56] = b
    return out


def _owned(seats: np.ndarray, left: np.ndarray, right: np.ndarray, bucket: int) -> np.ndarray:
    """Which of ``left`` by ``right`` share no bucket of an earlier tree."""
    out = np.ones((len(left), len(right)), bool)
    for t in range(bucket >> 56):
        a, b = seats[left, t], seats[right, t]
        out &= (a[:, None] != b[None, :]) | (a < 0)[:, None]
    return out


def _sides(block: np.ndarray, first: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(block == first), np.flatnonzero(block == second)


def _plausible(rows: list[tuple], least: int) -> np.ndarray:
    """Rows that have a partner whose signature agrees in ``least`` labels or more, in a pair that belongs here.

    Rows are (bucket, first, second, block, cls, paths, seats).
    """
    bucket, first, second = rows[0][:3]
    left, right = _sides(np.array([r[3] for r in rows]), first, second)
    if not len(left) or not len(right):
        return np.zeros(0, np.int64)
    hit = _owned(_by_tree([r[6] for r in rows]), left, right, bucket)
    if first == second:
        np.fill_diagonal(hit, False)
    if not hit.any():
        return np.zeros(0, np.int64)
    labels = _labels(np.array([r[5] for r in rows], np.int64))
    a, b = labels[left], labels[right]
    if a.shape[0] * b.shape[0] * a.shape[1] < 2_000_000:
        same = (a[:, None] == b[None]).sum(2)
    else:
        same = np.zeros(hit.shape, np.int16)
        for j in range(a.shape[1]):
            same += a[:, j, None] == b[None, :, j]
    hit &= same >= least
    return np.union1d(left[hit.any(1)], right[hit.any(0)])


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which of ``left`` by ``right`` (numbers of sets) are similar enough, by exact intersections."""
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[inverse] > 1
    owner, column = owner[shared], np.cumsum(counts > 1)[inverse[shared]] - 1
    total = int((counts > 1).sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    step = max(64, min(8192, 16_000_000 // max(1, len(sets))))
    for at in range(0, total, step):
        a, b = np.searchsorted(column, [at, at + step])
        table = np.zeros((len(sets), min(step, total - at)), np.float32)
        table[owner[a:b], column[a:b] - at] = 1
        common += table[left] @ table[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return common >= similarity * union - 1e-6


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each member's component."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = label[label]
        if (label == before).all():
            return label


def _compare(rows: list[tuple], similarity: float) -> list[tuple[bytes, int, bytes]]:
    """(class, linked documents, a class it hangs together with) of the pairs that belong to one pair of blocks.

    Rows are (bucket, first, second, block, cls, size, seats, hashes).
    """
    bucket, first, second = rows[0][:3]
    left, right = _sides(np.array([r[3] for r in rows]), first, second)
    if not len(left) or not len(right):
        return []
    owned = _owned(_by_tree([r[6] for r in rows]), left, right, bucket)
    if first == second:
        np.fill_diagonal(owned, False)
    if not owned.any():
        return []
    names, sizes = [r[4] for r in rows], np.array([r[5] for r in rows])
    hit = owned & _linked([np.frombuffer(r[7], np.uint64) for r in rows], left, right, similarity)
    linked = np.zeros(len(rows), np.int64)
    linked[left] += hit @ sizes[right]
    if first != second:
        linked[right] += hit.T @ sizes[left]
    a, b = np.nonzero(hit)
    label = _forest(len(rows), left[a], right[b])
    return [(names[i], int(linked[i]), names[label[i]]) for i in np.flatnonzero(linked)]


def _by_key(batches, work) -> Iterator[list]:
    """What ``work`` makes of the rows of each (bucket, first, second), which come together."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[:3] != key:
                if len(held) > 1:
                    yield work(held)
                held, key = [], row[:3]
            held.append(row)
    if len(held) > 1:
        yield work(held)


def _pairs_of_blocks(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with bucket and n, one for each pair of blocks that they belong to, brought together."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.select("bucket", F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"), *columns)
    rows = rows.select("bucket", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", *columns)
    return _together(rows)


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second", "cls")


def _classes(docs: DataFrame, similarity: float, n: int, recall: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, mark, cls) of all documents, and classes (cls, class_id, component, group_id, n_links).

    Both are stored tables; what is stored on the way is deleted at the end.
    """
    import pyarrow as pa

    text_batches(docs.sparkSession)
    least, between = shortest_prefix(similarity, recall), []

    def store(df: DataFrame, what: str) -> DataFrame:
        between.append(saved(df, what))
        return between[-1]

    rows = saved(signatures(docs, n, id_col, text_col), "signatures")
    classes = store(rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("size"), F.first("paths").alias("paths")), "classes")

    near = company(_sorted(classes.select(F.posexplode("paths").alias("tree", "path"), "cls"), "forest", store), least)
    seats = buckets(_sorted(matched(near, least, similarity, recall), "matched", store), least)
    seats = seats.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("places"))
    members = store(seats.join(classes, "cls").withColumn("seats", F.col("places.bucket")), "members")

    agree = int(TREES * DEPTH * similarity - DEVIATIONS * np.sqrt(TREES * DEPTH * similarity * (1 - similarity)))

    def filtered(batches):
        def work(held):
            return [held[i][:5] for i in _plausible(held, agree).tolist()]

        for out in _by_key(batches, work):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["bucket", "first", "second", "block", "cls"])

    asked = _pairs_of_blocks(members.select("cls", "paths", "seats", F.explode("places").alias("p")).select("cls", "paths", "seats", "p.*"), "cls", "paths", "seats")
    wanted = asked.mapInArrow(filtered, "bucket bigint, first int, second int, block int, cls binary")
    wanted = wanted.groupBy("cls").agg(F.collect_list(F.struct("bucket", "first", "second", "block")).alias("wanted"))
    wanted = store(wanted.join(members.select("cls", "class_id", "size", "seats"), "cls"), "wanted")

    texts = pick(docs, id_col, text_col).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # the members' size has no bound, so they are not broadcast, at any size
    found = texts.join(wanted.hint("merge"), F.col("_id").eqNullSafe(F.col("class_id"))).select("_text", "cls", "size", "seats", "wanted")

    def sets(batches):
        for batch in in_slices(batches, 0):
            hashes = [shingles(t or "", n) for t in batch.column(0).to_pylist()]
            ok = [i for i, (h, d) in enumerate(zip(hashes, batch.column(1).to_pylist())) if len(h) and _digest(h) == d]  # else another text of the same id
            part = batch.take(pa.array(ok, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(1, 5)), pa.array([hashes[i].tobytes() for i in ok], pa.binary())], ["cls", "size", "seats", "wanted", "hashes"])

    sent = found.mapInArrow(sets, "cls binary, size long, seats array<bigint>, wanted array<struct<bucket:bigint,first:int,second:int,block:int>>, hashes binary")
    sent = sent.select("cls", "size", "seats", "hashes", F.explode("wanted").alias("w"))
    # the text of a class may stand in several rows of one id
    sent = _together(sent.select("w.*", "cls", "size", "seats", "hashes"))

    def compare(batches):
        def work(held):
            unique = {r[4]: r for r in held}
            return _compare(list(unique.values()), similarity) if len(unique) > 1 else []

        for out in _by_key(batches, work):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary()))], ["node", "linked", "peer"])

    verified = store(sent.mapInArrow(compare, "node binary, linked long, peer binary"), "verified")
    groups = components(verified.select(F.col("node").alias("u"), F.col("peer").alias("v")))
    linked = verified.groupBy("node").agg(F.sum("linked").alias("linked"))
    table = classes.select("cls", "class_id", "size").join(linked.withColumnRenamed("node", "cls"), "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    table = store(table.select("cls", "class_id", F.coalesce("component", "cls").alias("component"), (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "linked")
    least_id = table.groupBy("component").agg(F.min("class_id").alias("group_id"))
    found = saved(look_up(table, "component", least_id, "cls"), "groups")
    for passed in (groups, *between):
        drop_saved(passed)
    return rows.select("id", "mark", "cls"), found


def links(docs: DataFrame, similarity: float = SIMILARITY, n: int = WORDS, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, class_id, group_id, n_links.

    ``class_id`` is the least id with the same n-gram set, ``group_id`` the
    least id of all that hang together by links, ``n_links`` the number of other
    documents with similarity at least ``similarity``.  Null texts and texts
    without words link to nothing and are classes of their own; texts of fewer
    than n words link to texts of the same words only; repeated rows are
    documents like others; an empty table gives an empty one.  A recall that
    the forest cannot reach at this similarity raises ValueError.
    """
    rows, table = _classes(docs, similarity, n, recall, id_col, text_col)
    out = look_up(rows.select("id", "cls", "mark", F.monotonically_increasing_id().alias("_row")), "cls", table, "_row", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("group_id", "id").alias("group_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, n: int = WORDS, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each group; all columns as they are.

    The row of the least id stays; of rows of that id the one whose text hashes
    lowest; of rows that agree in id and text the one that hashes lowest as a
    whole.  Different texts under one id are different documents.  Rows without
    words are in no group and all stay.
    """
    flat, names = positions(docs)
    at, text = f"_p{names.index(id_col)}", f"_p{names.index(text_col)}"
    rows, table = _classes(docs, similarity, n, recall, id_col, text_col)
    place = F.struct("id", "mark")
    spread = rows.filter("cls IS NOT NULL").select("id", "mark", "cls", F.monotonically_increasing_id().alias("_row"))
    placed = saved(look_up(spread, "cls", table.select("cls", "component"), "_row").groupBy("component", "id", "mark").agg(F.count(F.lit(1)).alias("n")), "places")
    best = placed.groupBy("component").agg(F.min(place).alias("best"))
    judged = look_up(placed.withColumn("_spread", F.hash("id", "mark")), "component", best, "_spread")
    judged = saved(judged.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), (place == F.col("best")).alias("_stays"), "n"), "judged")
    marked = flat.withColumn("_m", F.xxhash64(F.col(text)))
    same = marked[at].eqNullSafe(F.col("_id")) & (F.col("_m") == F.col("_mark"))
    drop_saved(placed)
    left = marked.join(judged.filter(~F.col("_stays")), same, "left_anti")
    again = judged.filter("_stays AND n > 1").select("_id", "_mark")
    if again.limit(1).count():
        columns = [c for c in flat.columns]
        repeated = left.join(again, left[at].eqNullSafe(F.col("_id")) & (left["_m"] == F.col("_mark")), "left_semi")
        one = repeated.groupBy(at, "_m").agg(F.min_by(F.struct(*columns), F.struct(F.xxhash64(*columns), F.xxhash64(*columns, F.lit(1)))).alias("one"))
        left = left.join(again, left[at].eqNullSafe(F.col("_id")) & (left["_m"] == F.col("_mark")), "left_anti").select(*columns).unionByName(one.select("one.*"))
    return left.select(*flat.columns).toDF(*names)
