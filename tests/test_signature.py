"""Signatures against hand-made bytes, and against a plain byte-by-byte reading."""

import random

import pytest
from pyspark.sql import functions as F

from mediasift.functions import signature as G

CASES = [
    (b"\xff\xd8\xff\xe0", "jpeg", None, None),
    (b"\x89PNG\r\n\x1a\n", "png", None, None),
    (b"RIFF\x00\x00\x00\x00WEBP", "webp", None, None),
    (b"RIFF\x00\x00\x00\x00WAVE", "wav", None, None),
    (b"RIFF\x00\x00\x00\x00AVI ", "avi", None, None),
    (b"RIFF\x00\x00\x00\x00XXXX\xff\xe2\x00\x00\x00", None, None, None),
    (b"RIFF\x00\x00\x00\xff\xfb\x00\x00", None, None, None),
    (b"fLaC", "flac", None, None),
    (b"ID3", "mp3", None, None),
    (b"\x00\xff\xe2\x00\x00\x00", "mp3", None, None),
    (b"\x00\xff\xe2\x00\x00", None, None, None),
    (b"\x00\xff\xe0\x00\x00\x00", None, None, None),
    (b"\x00\xff\xf6\x00\x00\x00", None, None, None),
    (b"\x1aE\xdf\xa3\x8b\x42\x82\x88matroska", "matroska", "matroska", None),
    (b"\x1aE\xdf\xa3\x87\x42\x82\x84webm", "matroska", "webm", None),
    (b"\x1aE\xdf\xa3\x01\x00\x00\x00\x00\x00\x00\x0b\x42\x82\x88matroska", "matroska", "matroska", None),
    (b"\x1aE\xdf\xa3\x94\x42\x87\x86webm\xff\xe2\x42\x82\x88matroska", "matroska", "matroska", None),
    (b"\x1aE\xdf\xa3", None, None, None),
    (b"\x1aE\xdf\xa3\x00", None, None, None),
    (b"\x1aE\xdf\xa3\xff", None, None, None),
    (b"\x1aE\xdf\xa3\x90\x42\x82\x88matroska", None, None, None),
    (b"\x1aE\xdf\xa3\x81\x00", None, None, None),
    (b"\x1aE\xdf\xa3\x82\x42\x82", None, None, None),
    (b"\x1aE\xdf\xa3\x83\x42\x82\x00", None, None, None),
    (b"\x1aE\xdf\xa3\x84\x42\x82\x85x", None, None, None),
    (b"\x1aE\xdf\xa3\x83\x42\x86\x80", None, None, None),
    (b"\x1aE\xdf\xa3\x88\x42\x82\x85other", None, None, None),
    (b"\x1aE\xdf\xa3\x8e\x42\x82\x84webm\x42\x82\x84webm", None, None, None),
    (b"\x00\x00\x00\x18ftypisom\x00\x00\x02\x00isommp41", "isobmff", None, ["isom", "mp41"]),
    (b"\x00\x00\x00\x14ftypqt  \x00\x00\x02\x00qt  ", "isobmff", None, ["qt  "]),
    (b"\x00\x00\x00\x10ftypM4A \x00\x00\x02\x00", "isobmff", None, ["M4A "]),
    (b"\x00\x00\x00\x08free\x00\x00\x00\x10ftypM4A \x00\x00\x02\x00", "isobmff", None, ["M4A "]),
    (b"\x00\x00\x00\x01free\x00\x00\x00\x00\x00\x00\x00\x10\x00\x00\x00\x10ftypM4A \x00\x00\x02\x00", "isobmff", None, ["M4A "]),
    (b"\x00\x00\x00\x01ftyp\x00\x00\x00\x00\x00\x00\x00\x18qt  \x00\x00\x00\x00", "isobmff", None, ["qt  "]),
    (b"\x00\x00\x00\x0fftypM4A \x00\x00\x02\x00", None, None, None),
    (b"\x00\x00\x00\x20ftypM4A \x00\x00\x02\x00", None, None, None),
    (b"\x00\x00\x00\x00free", None, None, None),
    (b"\x00\x00\x00\x01free\x7f\xff\xff\xff\xff\xff\x00\xff", None, None, None),
    (b"", None, None, None),
]


def run(spark, headers, **switches):
    df = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(headers)], "i int, h binary")
    out = df.select("i", G.classify(F.col("h"), **switches).alias("c")).orderBy("i").collect()
    found = []
    for row in out:
        c = row["c"]
        names = sorted(bytes.fromhex(b).decode("latin-1") for b in c["brands"]) if c["brands"] else None
        found.append((c["kind"], c["document_type"], names))
    return found


def test_cases(spark):
    got = run(spark, [c[0] for c in CASES])
    for (header, *want), have in zip(CASES, got, strict=True):
        assert have == (want[0], want[1], want[2] and sorted(want[2])), header


def test_sync_pair_outranks_boxes_unless_switched(spark):
    movie = b"\x00\x00\x00\x10ftypisom\x00\x00\x02\x00" + b"\xff\xfb\x90\x00\x00\x00"
    assert run(spark, [movie])[0][0] == "mp3"
    assert run(spark, [movie], mpeg_before_bmff=False)[0][0] == "isobmff"


def test_only_the_first_64_kib_count(spark):
    late = b"\x00" * 65536 + b"\xff\xfb\x00\x00\x00"
    df = spark.createDataFrame([(bytearray(late),)], "h binary")
    assert df.select(G.classify(G.header_of(F.col("h")))["kind"].alias("k")).first()[0] is None
    assert df.select(G.classify(F.col("h"))["kind"].alias("k")).first()[0] == "mp3"


def brute_force_brands(data):
    """First `ftyp` of a box chain, read with slices."""
    at = 0
    while len(data) - at >= 8:
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
            if len(data) - at < 16:
                return None
        if size < head:
            return None
        if data[at + 4 : at + 8] == b"ftyp":
            box = data[at + head : at + size]
            if at + size > len(data) or len(box) < 8:
                return None
            words = [box[i : i + 4] for i in range(0, len(box) // 4 * 4, 4)]
            return sorted({w.decode("latin-1") for i, w in enumerate(words) if i != 1})
        at += size
    return None


@pytest.mark.parametrize("seed", range(3))
def test_random_box_chains(spark, seed):
    rng = random.Random(seed)
    headers = []
    for _ in range(120):
        data = b""
        for _ in range(rng.randrange(0, 4)):
            body = bytes(rng.randrange(0, 128) for _ in range(rng.randrange(0, 12)))
            if rng.random() < 0.3:
                size = len(body) + 16 + rng.choice([0, 0, 0, -20])
                data += b"\x00\x00\x00\x01moov" + max(size, 0).to_bytes(8, "big") + body
            else:
                data += (len(body) + 8).to_bytes(4, "big") + rng.choice([b"free", b"moov"]) + body
        brands = b"".join(rng.choice([b"isom", b"qt  ", b"mp42"]) for _ in range(rng.randrange(0, 5)))
        tail = rng.choice([b"", b"x", b"xyz"])
        box = b"mp41\x00\x00\x00\x00" + brands + tail
        data += (len(box) + 8 + rng.choice([0, 0, 0, 5])).to_bytes(4, "big") + b"ftyp" + box
        headers.append(data)
    df = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(headers)], "i int, h binary")
    rows = df.select("i", G.iso_bmff_brands(F.col("h")).alias("b")).orderBy("i").collect()
    for row, header in zip(rows, headers, strict=True):
        have = row["b"] and sorted(bytes.fromhex(b).decode("latin-1") for b in row["b"])
        assert have == brute_force_brands(header), header
