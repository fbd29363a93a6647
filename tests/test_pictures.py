"""Picture headers of every kind, written with struct, and headers that are cut short or wrong."""

from __future__ import annotations

import datetime as dt
import itertools
import struct

from weir.functions.pictures import picture_facts


def tiff(order: str, entries: list[tuple], sub: list[tuple] = ()) -> bytes:
    """Directories at 8 and behind it; texts of over four bytes lie behind the directories."""
    held, pool = {}, b""
    base = 8 + 2 + 12 * (len(entries) + bool(sub)) + 4

    def directory(rows, texts_at):
        nonlocal pool
        out = struct.pack(order + "H", len(rows))
        for tag, kind, value in rows:
            if kind == 2:
                data = value.encode("latin-1") + b"\0"
                field = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", texts_at + len(pool))
                pool += data if len(data) > 4 else b""
                out += struct.pack(order + "HHI", tag, kind, len(data)) + field
            else:
                out += struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
        return out + struct.pack(order + "I", 0)

    sub_size = 2 + 12 * len(sub) + 4 if sub else 0
    rows = [*entries, *([(0x8769, 4, base)] if sub else [])]
    held = directory(rows, base + sub_size) + (directory(sub, base + sub_size) if sub else b"")
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + held + pool


def jpeg(width: int, height: int, tags: bytes | None, fillers: int = 0) -> bytes:
    segment = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + b"".join(segment(0xE2, b"\xff\xc0\0\x11\x08" * 9) for _ in range(fillers))
    out += segment(0xE1, b"http://ns\0") + (segment(0xE1, b"Exif\0\0" + tags) if tags else b"")
    return out + b"\xff\xff" + segment(0xC2, struct.pack(">BHHB", 8, height, width, 3)) + b"\xff\xda\0\x02"


def png(width: int, height: int, tags: bytes | None) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"crc!"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"eXIf") + (chunk(b"eXIf", tags) if tags else b"") + chunk(b"IEND", b"")


WHEN, LATER = "2025:07:31 12:30:00", "2025:08:01 00:00:00"
A, B = dt.datetime(2025, 7, 31, 12, 30), dt.datetime(2025, 8, 1)


def test_picture_facts(spark):
    cases = []
    for order, turn in itertools.product("<>", (1, 3, 5, 8, 9)):
        size = (300, 400) if turn in (5, 8) else (400, 300)
        tags = tiff(order, [(0x010F, 2, "maker"), (0x0112, 3, turn), (0x0132, 2, LATER)], [(0x9003, 2, WHEN), (0x9004, 2, LATER)])
        cases += [(jpeg(400, 300, tags, 30), ("jpeg", *size, A)), (png(400, 300, tags), ("png", *size, A))]
    for order in "<>":
        cases += [
            (jpeg(7, 9, tiff(order, [(0x0132, 2, LATER)])), ("jpeg", 7, 9, B)), (jpeg(7, 9, tiff(order, [(0x0132, 2, LATER)], [(0x9003, 2, "0000:00:00 00:00:00")])), ("jpeg", 7, 9, B)),
            (jpeg(7, 9, tiff(order, [], [(0x9003, 2, ""), (0x9004, 2, "2025:08:01")])), ("jpeg", 7, 9, B)),
            (tiff(order, [(0x0100, 3, 640), (0x0101, 4, 480), (0x0112, 3, 6), (0x0132, 2, WHEN)]), ("tiff", 480, 640, A)),
        ]
    cases += [
        (jpeg(65535, 1, None), ("jpeg", 65535, 1, None)), (png(5, 6, None), ("png", 5, 6, None)), (b"GIF89a" + struct.pack("<HH", 10, 20), ("gif", 10, 20, None)),
        (b"BM" + b"\0" * 16 + struct.pack("<ii", 33, -44), ("bmp", 33, 44, None)), (b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + struct.pack("<I", 99)[:3] + struct.pack("<I", 49)[:3], ("webp", 100, 50, None)),
        (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 76 | 54 << 14), ("webp", 77, 55, None)), (b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 7 + b"\x9d\x01\x2a" + struct.pack("<HH", 12, 13), ("webp", 12, 13, None)),
        # not pictures, cut short, or wrong
        (None, None), (b"", None), (b"text", None), (b"\xff\xd8\xff", ("jpeg", None, None, None)), (jpeg(7, 9, None)[:20], ("jpeg", None, None, None)), (b"\x89PNG\r\n\x1a\n", ("png", None, None, None)),
        (jpeg(7, 9, b"II*\0\xff\xff\xff\x7f"), ("jpeg", 7, 9, None)), (jpeg(7, 9, b"II*\0\x08\0\0\0\xff\xff"), ("jpeg", 7, 9, None)), (b"MM\0*", ("tiff", None, None, None)), (b"\xff\xd8\xff\xe1\0\0" * 9, ("jpeg", None, None, None)),
    ]
    df = spark.createDataFrame([(k, bytearray(c) if c is not None else None) for k, (c, _) in enumerate(cases)], "k int, content binary").repartition(2)
    got = {r.k: tuple(r.f) if r.f is not None else None for r in df.select("k", picture_facts("content").alias("f")).collect()}
    for k, (_, want) in enumerate(cases):
        assert got[k] == want, (k, got[k], want)
