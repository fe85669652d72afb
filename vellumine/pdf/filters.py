"""Stream filters, decoded in the order a stream names them, with a bound on what comes out."""

from __future__ import annotations

import re
import zlib
from typing import Any

import numpy as np

#: Bytes that a stream may decode to.
MOST = 256 << 20
#: Filters by their short names (fixed values).
SHORT = {"AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "Fl": "FlateDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
#: Filters of images, whose bytes stay as they are.
IMAGES = {"DCTDecode", "JPXDecode", "JBIG2Decode", "CCITTFaxDecode"}


class FilterFault(ValueError):
    """A filter that is unknown, or bytes that it can't decode."""


def flate(data: bytes) -> bytes:
    """Zlib, with what can be had of broken data."""
    for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
        d, out = zlib.decompressobj(bits), b""
        try:
            out = d.decompress(data, MOST + 1)
        except zlib.error:
            d, parts = zlib.decompressobj(bits), []
            try:
                for k in range(0, len(data), 64):
                    parts.append(d.decompress(data[k:k + 64], MOST))
            except zlib.error:
                pass
            out = b"".join(parts)
        if len(out) > MOST:
            raise FilterFault("a stream decodes to too much")
        if out or d.eof or not data:
            return out
    raise FilterFault("not flate data")


def ascii_hex(data: bytes) -> bytes:
    body = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">", 1)[0])
    return bytes.fromhex((body + b"0" if len(body) % 2 else body).decode())


def ascii_85(data: bytes) -> bytes:
    body = re.sub(rb"[\0\t\n\f\r ]", b"", data)
    body = body[2:] if body.startswith(b"<~") else body
    out, group = bytearray(), []
    for c in body.split(b"~", 1)[0]:
        if c == 122 and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                n = 0
                for g in group:
                    n = n * 85 + g
                out += (n & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
        else:
            raise FilterFault("not base-85 data")
    if len(group) > 1:
        n = 0
        for g in group + [84] * (5 - len(group)):
            n = n * 85 + g
        out += (n & 0xFFFFFFFF).to_bytes(4, "big")[:len(group) - 1]
    return bytes(out)


def lzw(data: bytes, early: int = 1) -> bytes:
    """Variable-width LZW: codes of 9 to 12 bits, 256 clears, 257 ends."""
    table: list[bytes] = []
    out, size = [], 0
    held = width = 0
    bits, before = 9, b""
    for byte in data:
        held, width = held << 8 | byte, width + 8
        while width >= bits:
            code = held >> (width - bits) & ((1 << bits) - 1)
            width -= bits
            held &= (1 << width) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, bits, before = [], 9, b""
                continue
            if code < 256:
                entry = bytes([code])
            elif code - 258 < len(table):
                entry = table[code - 258]
            elif before and code - 258 == len(table):
                entry = before + before[:1]
            else:
                raise FilterFault("not LZW data")
            if before and len(table) < 3838:
                table.append(before + entry[:1])
            before = entry
            out.append(entry)
            size += len(entry)
            if size > MOST:
                raise FilterFault("a stream decodes to too much")
            n = len(table) + 258 + early
            bits = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
    return b"".join(out)


def run_length(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        n = data[k]
        if n == 128:
            break
        if n < 128:
            out += data[k + 1:k + 2 + n]
            k += n + 2
        else:
            out += data[k + 1:k + 2] * (257 - n)
            k += 2
    return bytes(out)


def unpredicted(data: bytes, attrs: dict) -> bytes:
    """PNG and TIFF predictors undone."""
    kind = attrs.get("Predictor", 1)
    if not isinstance(kind, int) or kind < 2:
        return data
    colors, bpc, columns = (attrs.get(k, d) for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    width, step = (columns * colors * bpc + 7) // 8, max(1, colors * bpc // 8)
    if kind == 2:
        if bpc != 8 or not width:
            return data
        whole = len(data) // width * width
        rows = np.frombuffer(data[:whole], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes() + data[whole:]
    out, above = bytearray(), bytearray(width)
    for k in range(0, len(data), width + 1):
        how, row = data[k], bytearray(data[k + 1:k + 1 + width])
        row += bytes(width - len(row))
        if how == 1:
            for i in range(step, width):
                row[i] = (row[i] + row[i - step]) & 255
        elif how == 2:
            row = bytearray((np.frombuffer(row, np.uint8) + np.frombuffer(above, np.uint8)).tobytes())
        elif how == 3:
            for i in range(width):
                row[i] = (row[i] + ((row[i - step] if i >= step else 0) + above[i]) // 2) & 255
        elif how == 4:
            for i in range(width):
                a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
                p = a + b - c
                pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                row[i] = (row[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
        out += row
        above = row
    return bytes(out)


def names_of(attrs: dict, resolve=lambda x: x) -> list[str]:
    own = resolve(attrs.get("Filter", attrs.get("F")))
    own = own if isinstance(own, list) else [own] if own is not None else []
    return [SHORT.get(str(resolve(f)), str(resolve(f))) for f in own]


def decode(raw: bytes, attrs: dict, resolve=lambda x: x) -> bytes:
    """A stream's bytes with its filters undone; those of image filters as they are."""
    own = names_of(attrs, resolve)
    parms: Any = resolve(attrs.get("DecodeParms", attrs.get("DP")))
    parms = parms if isinstance(parms, list) else [parms] * len(own)
    for k, name in enumerate(own):
        p = resolve(parms[k]) if k < len(parms) else None
        p = {a: resolve(b) for a, b in p.items()} if isinstance(p, dict) else {}
        if name == "FlateDecode":
            raw = unpredicted(flate(raw), p)
        elif name == "LZWDecode":
            raw = unpredicted(lzw(raw, p.get("EarlyChange", 1)), p)
        elif name == "ASCIIHexDecode":
            raw = ascii_hex(raw)
        elif name == "ASCII85Decode":
            raw = ascii_85(raw)
        elif name == "RunLengthDecode":
            raw = run_length(raw)
        elif name in IMAGES or name == "Crypt":
            continue
        else:
            raise FilterFault(f"unknown filter {name}")
    return raw
