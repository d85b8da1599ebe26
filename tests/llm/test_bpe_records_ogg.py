"""Operators 2, 3 and 8: exact against the library, exact round trips."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabsignal.llm import bpe, ogg, records
from tabsignal.llm.tokenization import PieceEncoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n\t ", "x" * 30_000, "a<|endoftext|>b <|startoftext|> c" * 200, "ΑΣ ΟΔΟΣ é İ Ⱥ" * 300, "漢字" * 3000, "it's 'RE don't \x1c\x1d \x85\xa0 " * 300, "e\u0301 " * 900]


def texts() -> list[str]:
    r = random.Random(1)
    letters = [chr(c) for c in range(0x300)] + ["'s", " ", " ", " ", "e", "<|endoftext|>", "\u0301", "한"]
    words = ["".join(r.choice("abcdeéüñ") for _ in range(r.randint(1, 9))) for _ in range(300)]
    shared = " ".join(r.choice(words) for _ in range(900))
    out = [" ".join(r.choice(words) for _ in range(r.randint(1, 1500))) for _ in range(30)]
    out += [" ".join(r.choice(words) for _ in range(r.randint(1, 99))) + " " + shared for _ in range(10)]
    return ODD + out + ["".join(r.choice(letters) for _ in range(r.randint(0, 1500))) for _ in range(60)]


def frame(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names clash."""
    return spark.createDataFrame([(t, i, 0, "z") for i, t in rows], "text string, doc_id long, ids int, other string").toDF("text", "doc_id", "ids", "Text")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_equal_the_library(path):
    t = texts()
    tok = Tokenizer.from_file(path)
    want = [e.ids for e in tok.encode_batch(t, add_special_tokens=False)]
    encoder = PieceEncoder(path)
    got = encoder.encode(t)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert encoder.decode(got) == [tok.decode(w, skip_special_tokens=False) for w in want]
    specials = PieceEncoder(path, specials_as_text=True)
    tok.encode_special_tokens = True
    assert [np.frombuffer(g, "<u4").tolist() for g in specials.encode(t)] == [e.ids for e in tok.encode_batch(t, add_special_tokens=False)]


def test_chunks_are_reused_and_joins_repaired():
    t = texts()
    tok = Tokenizer.from_file(WORD)
    chunker = bpe.ChunkEncoder(PieceEncoder(WORD))
    got = [np.frombuffer(g, "<u4").tolist() for g in chunker.encode(t)]
    assert got == [e.ids for e in tok.encode_batch(t, add_special_tokens=False)]
    assert chunker.encoded < chunker.seen  # the shared passage was encoded once
    assert chunker.encode(t[-3:] + t[:3]) and chunker.encoded < chunker.seen
    long = "ab cd " * 200_000
    assert np.frombuffer(chunker.encode([long])[0], "<u4").tolist() == tok.encode(long, add_special_tokens=False).ids


def test_cuts_follow_content():
    r = random.Random(2)
    shared = "".join(r.choice("abcdef ") for _ in range(20_000))
    a, b = bpe.cuts("x" * 777 + shared), bpe.cuts("yz" * 1500 + shared)
    assert len({c - 777 for c in a if c > 3000} & {c - 3000 for c in b if c > 6000}) > 5


def test_codec_frame(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a b"), (7, None), (7, None), (3, "same"), (3, "same")]
    got = sorted(map(tuple, bpe.digests(bpe.decode(bpe.encode(frame(spark, rows), WORD), WORD)).collect()), key=str)
    tok = Tokenizer.from_file(WORD)
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(b"".join(struct.pack("<I", x) for x in ids)).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert sorted(map(tuple, bpe.digests(bpe.codec(frame(spark, rows), WORD)).collect()), key=str) == got
    assert bpe.encode(frame(spark, []), WORD).count() == 0 and bpe.codec(frame(spark, []), WORD).count() == 0


def test_records_round_trip(spark):
    rows = [(5, "b"), (2, "a b c"), (9, None), (2, "a"), (None, "n"), (-3, "x " * 5000), (7, ""), (5, "b")]
    manifest = records.write(frame(spark, rows), BYTE, 2)
    got = [tuple(r) for r in records.read(spark, manifest).orderBy("start").collect()]
    tok = Tokenizer.from_file(BYTE)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for i, t in ordered:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, b"".join(struct.pack("<I", x) for x in ids)))
        start += len(ids)
    assert [(i, s, bytes(b)) for i, s, b in got] == want
    shuffled = records.read_shuffled(spark, manifest, 3).collect()
    assert sorted((str(r[0]), bytes(r[1])) for r in shuffled) == sorted((str(i), b) for i, _, b in want)
    assert records.read(spark, records.write(frame(spark, []), BYTE, 2)).count() == 0


def test_damaged_records_are_found():
    import io

    good = records.frame(records.pack(4, struct.pack("<3I", 1, 70000, 2), 4))
    assert records.unpack(records.unframe(io.BytesIO(good).read)) == (4, struct.pack("<3I", 1, 70000, 2))
    assert records.unframe(io.BytesIO(b"").read) is None
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            records.unframe(io.BytesIO(bytes(bad)).read)


def slow_crc(data: bytes) -> int:
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_ogg_pages():
    data = random.Random(4).randbytes(70_000)
    assert ogg.page_crc(data[:999]) == slow_crc(data[:999])
    media = ogg.mux(data)
    streams = ogg.demux(media)
    assert len(streams) == 2 and len({*streams}) == 2
    samples = next(iter(streams.values()))
    assert samples.granules == sorted(samples.granules) and samples.granules[-1] == len(data) + (-len(data) % 192)
    assert samples.packets[1] == data[: ogg.PACKET]
    for at in (30, len(media) // 3, len(media) - 2):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            ogg.demux(bytes(bad))
    for cut in (1, 26, 27, 100, len(media) - 1):
        with pytest.raises(ValueError):
            ogg.demux(media[:cut])


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 254, 255, 256, 3839, 3840, 3841, 255 * 120, 255 * 120 + 1, 1_000_000])
def test_ogg_round_trip(n):
    data = random.Random(n).randbytes(n)
    payload, size, feature = ogg.read_samples(ogg.mux(data))
    assert size == n and payload[:n] == data and set(payload[n:]) <= {32} and len(payload) % 192 == 0 and payload
    assert f"seconds={len(payload) / 8000:.3f}" in feature


def test_ogg_frame(spark):
    rows = [(0, "héllo"), (1, None), (2, ""), (3, "x" * 200_000), (4, "same"), (5, "same"), (None, "q"), (4, "same")]
    got = ogg.digests(ogg.from_media(ogg.to_media(frame(spark, rows)))).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"])
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] in (4, 5)}) == 1
    assert ogg.to_media(frame(spark, [])).count() == 0


class Runs:
    """A stand-in for a tokenizer: words and whole runs of spaces are tokens."""

    def __init__(self):
        self.longest = 0

    def encode(self, texts):
        self.longest = max([self.longest, *map(len, texts)])
        return [b"".join(zlib.crc32(t.encode()).to_bytes(4, "little") for t in re.findall(r"\s+|\S+", text)) for text in texts]


def test_windows_grow_until_they_agree(monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
    gap = lambda: " " * (400 if r.random() < 1 / 100 else 1)
    for _ in range(30):
        text = "".join(word() + gap() for _ in range(900))
        runs = [m.start() + 200 for m in re.finditer(" {400}", text)]
        monkeypatch.setattr(bpe, "cuts", lambda t: [c for k, c in enumerate(runs) if not k or c - runs[k - 1] > 900])
        pieces = Runs()
        got = bpe.ChunkEncoder(pieces).encode([text])
        assert pieces.longest < len(text) or len(runs) < 3  # never the whole text
        assert got == Runs().encode([text])
