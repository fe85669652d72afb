"""Image files of samples: PNG and PNM."""

from __future__ import annotations

import struct
import zlib


def png(width: int, height: int, components: int, data: bytes) -> bytes:
    """An 8-bit grey or RGB image."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    row = width * components
    raw = b"".join(b"\0" + data[k * row:(k + 1) * row].ljust(row, b"\0") for k in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0 if components == 1 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def pnm(width: int, height: int, components: int, data: bytes) -> bytes:
    return f"P{5 if components == 1 else 6}\n{width} {height}\n255\n".encode() + data[:width * height * components]


def tiff(width: int, height: int, components: int, data: bytes) -> bytes:
    """An 8-bit grey or RGB image in one strip."""
    n = 1 if components == 1 else 3
    body = data[:width * height * n].ljust(width * height * n, b"\0")
    head = 8
    entries = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, n, 8 if n == 1 else head + len(body)), (259, 3, 1, 1), (262, 3, 1, 1 if n == 1 else 2), (273, 4, 1, head), (277, 3, 1, n), (278, 4, 1, height), (279, 4, 1, len(body))]
    more = b"" if n == 1 else struct.pack("<HHH", 8, 8, 8)
    pad = b"\0" * ((len(body) + len(more)) % 2)
    at = head + len(body) + len(more) + len(pad)
    return struct.pack("<2sHI", b"II", 42, at) + body + more + pad + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
