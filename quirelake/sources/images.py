"""Pixel sizes from the first bytes of pictures."""

from __future__ import annotations

import struct


def _jpeg(b: bytes) -> tuple[int, int]:
    at, turned = 2, False
    while at + 9 < len(b):
        if b[at] != 0xFF:
            at += 1
            continue
        kind = b[at + 1]
        if kind in (0xFF, 0x00, 0x01) or 0xD0 <= kind <= 0xD9:
            at += 1 if kind == 0xFF else 2
            continue
        size = struct.unpack(">H", b[at + 2 : at + 4])[0]
        if kind == 0xE1 and b[at + 4 : at + 10] == b"Exif\0\0":
            turned = _turned(b[at + 10 : at + 2 + size])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return (h, w) if turned else (w, h)
        at += 2 + size
    return 0, 0


def _turned(tiff: bytes) -> bool:
    """Whether the orientation swaps width and height."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order or len(tiff) < 10:
        return False
    at = struct.unpack(order + "I", tiff[4:8])[0]
    n = struct.unpack(order + "H", tiff[at : at + 2])[0] if at + 2 <= len(tiff) else 0
    for i in range(n):
        entry = tiff[at + 2 + 12 * i : at + 14 + 12 * i]
        if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
            return 5 <= struct.unpack(order + "H", entry[8:10])[0] <= 8
    return False


def size(b: bytes) -> tuple[int, int]:
    """(width, height); (0, 0) where the header tells none."""
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", b[16:24])
        if b[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", b[6:10])
        if b[:2] == b"\xff\xd8":
            return _jpeg(b)
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            if b[12:16] == b"VP8 ":
                w, h = struct.unpack("<HH", b[26:30])
                return w & 0x3FFF, h & 0x3FFF
            if b[12:16] == b"VP8L":
                bits = struct.unpack("<I", b[21:25])[0]
                return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            if b[12:16] == b"VP8X":
                return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
        if b[:2] == b"BM":
            w, h = struct.unpack("<ii", b[18:26])
            return abs(w), abs(h)
    except (struct.error, IndexError):
        pass
    return 0, 0
