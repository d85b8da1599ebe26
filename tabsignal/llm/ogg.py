"""Media columns: Ogg files of 8-bit samples, written and read without a codec.

A text's bytes, padded with spaces to a multiple of 192, are the samples of one
logical stream at 8000 samples a second.  A second logical stream holds notes:
the unpadded length, and with each note the sample count and checksum of the
first stream so far.  Pages of both are interleaved.  The reader verifies every
page's checksum, puts packets together from lacing values (also over pages),
tells the streams apart by serial number, checks page sequence numbers, and
derives times from granule positions.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, pick, text_batches

FRAME = 192
#: Samples in a packet; not a multiple of 255, so lacing ends inside a segment.
PACKET = 20 * FRAME
RATE = 8000
#: Segments in a page at most; under 255, so that packets also run over pages.
SEGMENTS = 120
#: Data packets between two notes.
NOTE_EVERY = 16
SAMPLES_MAGIC, NOTES_MAGIC = b"\x01pcm8\0\0\0", b"\x02note\0\0\0"

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_REVERSED_ARRAY = np.frombuffer(_REVERSED, np.uint8)


def page_crc(data: bytes) -> int:
    """Ogg's checksum (0x04C11DB7, most significant bit first, from zero) by way of zlib's, which reads bits the other way."""
    low = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low.to_bytes(4, "little").translate(_REVERSED), "big")


class _Writer:
    """Pages of one logical stream."""

    def __init__(self, serial: int):
        self.serial, self.sequence = serial, 0
        self.lacing: list[int] = []
        self.body = bytearray()
        self.granule = -1
        self.continued = False

    def page(self, first: bool = False, last: bool = False, unfinished: bool = False) -> bytes:
        flags = (1 if self.continued else 0) | (2 if first else 0) | (4 if last else 0)
        head = struct.pack("<4sBBqIII", b"OggS", 0, flags, self.granule, self.serial, self.sequence, 0) + bytes([len(self.lacing)]) + bytes(self.lacing)
        whole = bytearray(head + self.body)
        struct.pack_into("<I", whole, 22, page_crc(bytes(whole)))
        self.sequence += 1
        self.lacing, self.body, self.granule, self.continued = [], bytearray(), -1, unfinished
        return bytes(whole)

    def packet(self, data: bytes, granule: int) -> Iterator[bytes]:
        """Add a packet; yields each page that it fills."""
        values = [255] * (len(data) // 255) + [len(data) % 255]
        at = 0
        for k, v in enumerate(values):
            if len(self.lacing) == SEGMENTS:
                yield self.page(unfinished=k > 0)
            self.lacing.append(v)
            self.body += data[at : at + v]
            at += v
        self.granule = granule  # of the last packet that ends on the page


def mux(data: bytes) -> bytes:
    """An Ogg file of ``data`` padded with spaces to a positive multiple of 192."""
    payload = data + b" " * (-len(data) % FRAME if data else FRAME)
    seed = zlib.crc32(payload)
    samples, notes = _Writer(seed), _Writer(seed ^ 0xFFFFFFFF)
    out: list[bytes] = []
    for stream, magic in ((samples, SAMPLES_MAGIC), (notes, NOTES_MAGIC)):
        out += stream.packet(magic + struct.pack("<II", RATE, 1), 0)
        out.append(stream.page(first=True))
    out += notes.packet(b"n_bytes" + struct.pack("<Q", len(data)), 0)
    out.append(notes.page())
    done = crc = 0
    for k, at in enumerate(range(0, len(payload), PACKET)):
        part = payload[at : at + PACKET]
        done += len(part)
        crc = zlib.crc32(part, crc)
        out += samples.packet(part, done)
        if k % NOTE_EVERY == NOTE_EVERY - 1:
            out += notes.packet(b"so_far\0" + struct.pack("<QI", done, crc), done)
            out.append(notes.page())
    out.append(samples.page(last=True))
    out += notes.packet(b"end\0\0\0\0" + struct.pack("<QI", done, crc), done)
    out.append(notes.page(last=True))
    return b"".join(out)


class Stream:
    def __init__(self) -> None:
        self.packets: list[bytes] = []
        self.granules: list[int] = []  # of pages on which a packet ends
        self.open = bytearray()
        self.sequence = self.pages = 0
        self.ended = False


def demux(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number in order of appearance; damage raises ValueError."""
    streams: dict[int, Stream] = {}
    at, size = 0, len(media)
    while at < size:
        if size - at < 27 or media[at : at + 4] != b"OggS":
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, sequence, crc, count = struct.unpack_from("<4sBBqIIIB", media, at)
        lacing = media[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        if version or len(lacing) < count or end > size:
            raise ValueError(f"page at byte {at} is cut off")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at byte {at} is wrong")
        if flags & 2:
            if serial in streams:
                raise ValueError(f"stream {serial} begins twice")
            streams[serial] = Stream()
        stream = streams.get(serial)
        if stream is None or stream.ended or sequence != stream.sequence:
            raise ValueError(f"page at byte {at} is out of order")
        if bool(flags & 1) != bool(stream.open):
            raise ValueError(f"a packet's rest is missing at byte {at}")
        stream.sequence += 1
        stream.pages += 1
        body = at + 27 + count
        ended = len(stream.packets)
        for v in lacing:
            stream.open += media[body : body + v]
            body += v
            if v < 255:
                stream.packets.append(bytes(stream.open))
                stream.open.clear()
        if len(stream.packets) > ended:
            stream.granules.append(granule)
        stream.ended = bool(flags & 4)
        at = end
    for serial, stream in streams.items():
        if stream.open or not stream.ended:
            raise ValueError(f"stream {serial} does not end")
    return streams


def read_samples(media: bytes) -> tuple[bytes, int, str]:
    """Payload, unpadded length and features of a file that :func:`mux` wrote."""
    streams = demux(media)
    samples = next(s for s in streams.values() if s.packets[0].startswith(SAMPLES_MAGIC))
    notes = next(s for s in streams.values() if s.packets[0].startswith(NOTES_MAGIC))
    rate = struct.unpack_from("<I", samples.packets[0], 8)[0]
    payload = b"".join(samples.packets[1:])
    n_bytes = struct.unpack_from("<Q", notes.packets[1], 7)[0]
    for note in notes.packets[2:]:
        done, crc = struct.unpack_from("<QI", note, 7)
        if note.startswith(b"end") and (done != len(payload) or crc != zlib.crc32(payload)):
            raise ValueError("samples differ from the notes")
    if samples.granules[-1] != len(payload):
        raise ValueError("the last granule position is not the number of samples")
    wave = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    feature = (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};"
        f"seconds={samples.granules[-1] / rate:.3f};first_page_end={samples.granules[min(1, len(samples.granules) - 1)] / rate:.3f};"
        f"sum={int(wave.sum())};energy={int((wave * wave).sum())};crossings={int((np.diff(np.sign(wave)) != 0).sum())};peak={int(np.abs(wave).max())}"
    )
    return payload, n_bytes, feature


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, media binary: an Ogg file of each whole text.

    Null and empty texts give 192 spaces; equal texts give equal files; every
    row gets a row, an empty table an empty one.
    """
    import pyarrow as pa

    text_batches(docs.sparkSession)
    source = pick(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([mux(t or b"") for t in texts], pa.binary())], [id_col, "media"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, media binary")


def from_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, media, payload binary, n_bytes long, feature string, read from the stored bytes.

    A null file gives nulls; a damaged one raises ValueError.
    """
    import pyarrow as pa

    source = pick(media, id_col, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            got = [(None, None, None) if m is None else read_samples(m) for m in batch.column(1).to_pylist()]
            payload, n_bytes, feature = zip(*got)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(payload, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(feature, pa.string())], [id_col, "media", "payload", "n_bytes", "feature"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, media binary, payload binary, n_bytes long, feature string")


def digests(read: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lengths, checksums and digests of what :func:`from_media` returns."""
    return read.select(
        F.col(id_col),
        F.col("n_bytes"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("feature"),
    )
