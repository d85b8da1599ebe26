"""Token-ID binary output: length-delimited records with masked checksums and an offset index.

A record is: payload length (8 bytes), masked checksum of those 8 bytes (4),
payload, masked checksum of the payload (4); all little-endian.  The payload is
the document id (8 bytes), a flag byte (1: null id), the width of an id (2 or
4) and the ids.  The checksum is CRC-32 (zlib's), rotated right by 15 bits plus
a constant, so that checksums of data that hold checksums stay sound.  Beside
each shard ``x.rec`` stands ``x.idx``: one 8-byte offset for each record, so a
reader can fetch records in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slices, pick, saved, scratch, text_batches
from .tokenization import encoder

#: Fixed value: the mask's addend of the common record format.
MASK_DELTA = 0xA282EAD8

MANIFEST = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("n_records", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
    ]
)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(read) -> bytes | None:
    """The next payload of ``read(n)``, None at the end; ValueError where a length or checksum is wrong."""
    head = read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack_from("<I", head, 8)[0] != masked(head[:8]):
        raise ValueError("record length is damaged")
    size = struct.unpack_from("<Q", head)[0]
    body = read(size + 4)
    if len(body) < size + 4 or struct.unpack_from("<I", body, size)[0] != masked(body[:size]):
        raise ValueError("record payload is damaged")
    return body[:size]


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """ids: little-endian unsigned 32-bit."""
    body = ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    return struct.pack("<qBB", doc_id or 0, doc_id is None, width) + body


def unpack(payload: bytes) -> tuple[int | None, bytes]:
    doc_id, null, width = struct.unpack_from("<qBB", payload)
    body = payload[10:]
    return (None if null else doc_id), (body if width == 4 else np.frombuffer(body, "<u2").astype("<u4").tobytes())


def _open(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system, at


def write(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id`` and write records in ascending id order.

    Returns the manifest, a row for each shard; shards in order hold ids in
    order.  Null texts count as empty and null ids come first; repeated ids
    each get a record, ordered by text.  An empty table has no shards.
    Range partitioning sends texts once over the network; a task streams its
    shard to a name of its own and renames it, so a task that runs again
    leaves the same file.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    text_batches(spark)
    folder = folder or scratch(spark, "records")
    source = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")  # the sampled keys are ids alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        pieces = encoder(tokenizer_path)
        width = 2 if pieces.tok.get_vocab_size(with_added_tokens=True) <= 65536 and end_id < 65536 else 4
        end, offsets, n_ids, at = np.array([end_id], "<u4").tobytes(), [], 0, 0
        own = f"{base}/_{shard:06d}-{attempt}"

        def rest():
            yield first
            yield from batches

        with system.open_output_stream(own + ".rec") as out, system.open_output_stream(own + ".idx") as index:
            for batch in in_slices(rest(), 1):
                frames = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), pieces.encode([t or "" for t in batch.column(1).to_pylist()])):
                    framed = frame(pack(doc_id, ids + end, width))
                    frames.append(framed)
                    offsets.append(at)
                    at += len(framed)
                    n_ids += len(ids) // 4 + 1
                out.write(b"".join(frames))
                index.write(np.array(offsets[-len(frames) :], "<u8").tobytes())
        name = f"{folder}/shard-{shard:06d}"
        for kind in (".rec", ".idx"):
            system.move(own + kind, f"{base}/shard-{shard:06d}{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name + ".rec"]), *(pa.array([x], pa.int64()) for x in (len(offsets), n_ids, at))], [f.name for f in MANIFEST])

    return saved(ordered.mapInArrow(run, MANIFEST), "record-manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Records of the shards: doc_id, start (ids before it over all shards), ids binary (unsigned 32-bit).

    Lengths and checksums are verified; damage raises ValueError.
    """
    import pyarrow as pa

    shards = sorted(manifest.collect(), key=lambda r: r["shard"])  # a row for each file
    plan, before = [], 0
    for r in shards:
        plan.append((r["path"], before))
        before += r["n_ids"]
    files = spark.createDataFrame(plan, "path string, before long")
    files = files.repartition(max(1, len(plan)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, at = _open(path)
                with system.open_input_stream(at, buffer_size=1 << 20) as stream:
                    rows, held = [], 0
                    while (payload := unframe(stream.read)) is not None:
                        doc_id, ids = unpack(payload)
                        rows.append((doc_id, start, ids))
                        start += len(ids) // 4
                        held += len(ids)
                        if held > 4_000_000:
                            yield _rows(pa, rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(pa, rows)

    return files.mapInArrow(run, "doc_id long, start long, ids binary")


def _rows(pa, rows):
    ids, starts, bodies = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(bodies, pa.binary())], ["doc_id", "start", "ids"])


def offsets(path: str) -> np.ndarray:
    """Offsets of a shard's records, from its index."""
    system, at = _open(path[: -len(".rec")] + ".idx")
    with system.open_input_stream(at) as stream:
        return np.frombuffer(stream.read(), "<u8")


def read_shuffled(spark: SparkSession, manifest: DataFrame, seed: int) -> DataFrame:
    """All records in an order drawn anew for each seed: shards in random order, each read through its index at random."""
    import pyarrow as pa

    files = pick(manifest, "path").orderBy(F.xxhash64("path", F.lit(seed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = _open(path)
                where = offsets(path)
                order = np.random.default_rng([seed, zlib.crc32(path.rsplit("/", 1)[-1].encode())]).permutation(len(where))
                with system.open_input_file(at) as file:
                    for part in np.array_split(order, max(1, len(order) // 512)):
                        rows = []
                        for k in part:
                            file.seek(int(where[k]))
                            doc_id, ids = unpack(unframe(file.read))
                            rows.append((doc_id, None, ids))
                        if rows:
                            yield _rows(pa, rows)

    return files.mapInArrow(run, "doc_id long, start long, ids binary").select("doc_id", "ids")
