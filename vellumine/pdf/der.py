"""Certificates of a signature: a walker over DER, without a cryptographic library."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

#: Names of object identifiers (fixed values).
NAMES = {"2.5.4.3": "CN", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.10": "O", "2.5.4.11": "OU", "2.5.4.5": "serialNumber", "1.2.840.113549.1.9.1": "emailAddress", "0.9.2342.19200300.100.1.25": "DC"}
ALGORITHMS = {"1.2.840.113549.1.1.5": "SHA1-RSA", "1.2.840.113549.1.1.11": "SHA256-RSA", "1.2.840.113549.1.1.12": "SHA384-RSA", "1.2.840.113549.1.1.13": "SHA512-RSA", "1.2.840.10045.4.3.2": "ECDSA-SHA256", "1.2.840.10045.4.3.3": "ECDSA-SHA384"}
MOST_NODES, DEPTH = 20_000, 24


def nodes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(tag, start of the element, start and end of its content), one after another."""
    end = len(data) if end is None else end
    while at + 2 <= end:
        tag, n, k = data[at], data[at + 1], at + 2
        if n & 0x80:
            m = n & 0x7F
            if m == 0 or m > 4:
                return
            n, k = int.from_bytes(data[k:k + m], "big"), k + m
        if k + n > end:
            return
        yield tag, at, k, k + n
        at = k + n


def identifier(raw: bytes) -> str:
    if not raw:
        return ""
    out, n = [], 0
    for b in raw:
        n = n << 7 | b & 0x7F
        if not b & 0x80:
            out.append(n)
            n = 0
    first = min(2, out[0] // 40) if out else 0
    return ".".join(map(str, [first, out[0] - 40 * first, *out[1:]])) if out else ""


def name(data: bytes, at: int, end: int) -> str:
    parts = []
    for _, _, a, b in nodes(data, at, end):
        for _, _, c, d in nodes(data, a, b):
            pair = list(nodes(data, c, d))
            if len(pair) == 2:
                key = identifier(data[pair[0][2]:pair[0][3]])
                raw = data[pair[1][2]:pair[1][3]]
                parts.append(f"{NAMES.get(key, key)}={raw.decode('utf-16-be' if pair[1][0] == 0x1E else 'utf-8', 'replace')}")
    return ", ".join(parts)


def moment(tag: int, raw: bytes) -> str:
    s = raw.decode("ascii", "replace").rstrip("Z")
    s = ("19" if s[:2] >= "50" else "20") + s if tag == 0x17 else s
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14] or '00'}Z"


def certificate(data: bytes, at: int, end: int) -> dict | None:
    """Fields of an element that has the shape of an X.509 certificate."""
    top = list(nodes(data, at, end))
    if len(top) != 3 or [t[0] for t in top] != [0x30, 0x30, 0x03]:
        return None
    body = list(nodes(data, top[0][2], top[0][3]))
    body = body[1:] if body and body[0][0] == 0xA0 else body
    if len(body) < 6 or [b[0] for b in body[:5]] != [0x02, 0x30, 0x30, 0x30, 0x30]:
        return None
    serial, algorithm, issuer, valid, subject = body[:5]
    times = list(nodes(data, valid[2], valid[3]))
    kind = list(nodes(data, algorithm[2], algorithm[3]))
    if len(times) != 2 or not kind:
        return None
    oid = identifier(data[kind[0][2]:kind[0][3]])
    return {
        "subject": name(data, subject[2], subject[3]), "issuer": name(data, issuer[2], issuer[3]), "serial": data[serial[2]:serial[3]].hex(), "algorithm": ALGORITHMS.get(oid, oid),
        "not_before": moment(times[0][0], data[times[0][2]:times[0][3]]), "not_after": moment(times[1][0], data[times[1][2]:times[1][3]]),
    }


def certificates(blob: bytes) -> Iterator[dict]:
    """Certificates anywhere in a PKCS#7 message, with digests of their bytes; too many elements are a fault."""
    todo, seen = [(0, len(blob), 0)], 0
    while todo:
        if seen >= MOST_NODES:
            raise ValueError(f"more than {MOST_NODES} elements in a signature")
        at, end, depth = todo.pop(0)
        for tag, start, a, b in nodes(blob, at, end):
            seen += 1
            if tag == 0x30 and (c := certificate(blob, a, b)) is not None:
                yield {**c, "sha256": hashlib.sha256(blob[start:b]).hexdigest(), "n_bytes": b - start}
            elif tag & 0x20 and depth < DEPTH:
                todo.append((a, b, depth + 1))
