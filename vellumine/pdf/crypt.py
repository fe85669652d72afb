"""The standard security handler: RC4 and AES, revisions 2 to 6."""

from __future__ import annotations

import hashlib
from typing import Any

from vellumine.pdf.syntax import Ref, Stream

#: The padding of passwords (fixed value).
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
PERMISSIONS = (("print", 4), ("modify", 8), ("copy", 16), ("annotate", 32))


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    """AES's substitution box, from inverses in its field, and the box that undoes it."""
    box, back = [0] * 256, [0] * 256
    inverse = _inverses()
    for x in range(256):
        i = inverse[x]
        y = 0x63
        for k in range(5):
            y ^= (i << k | i >> (8 - k)) & 255
        box[x], back[y] = y, x
    return box, back


def _inverses() -> list[int]:
    powers, logs, x = [0] * 256, [0] * 256, 1
    for k in range(255):
        powers[k], logs[x] = x, k
        x = _times(x, 3)
    return [0] + [powers[(255 - logs[x]) % 255] for x in range(1, 256)]


_BOX, _BACK = _boxes()
_BY = {n: [_times(x, n) for x in range(256)] for n in (2, 3, 9, 11, 13, 14)}


def _keys(key: bytes) -> list[bytes]:
    n, words = len(key) // 4, [key[i:i + 4] for i in range(0, len(key), 4)]
    turn = 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = bytes([_BOX[w[1]] ^ turn, _BOX[w[2]], _BOX[w[3]], _BOX[w[0]]])
            turn = _times(turn, 2)
        elif n > 6 and i % n == 4:
            w = bytes(_BOX[b] for b in w)
        words.append(bytes(a ^ b for a, b in zip(w, words[-n], strict=True)))
    return [b"".join(words[i:i + 4]) for i in range(0, len(words), 4)]


def _decrypt_block(block: bytes, keys: list[bytes]) -> bytes:
    s = [a ^ b for a, b in zip(block, keys[-1], strict=True)]
    for r in range(len(keys) - 2, -1, -1):
        s = [_BACK[s[(i - 4 * (i % 4)) % 16]] for i in range(16)]
        s = [a ^ b for a, b in zip(s, keys[r], strict=True)]
        if r:
            s = [_BY[14][s[c]] ^ _BY[11][s[c + (i + 1) % 4 - i]] ^ _BY[13][s[c + (i + 2) % 4 - i]] ^ _BY[9][s[c + (i + 3) % 4 - i]] for c in range(16) for i in (c % 4,)]
    return bytes(s)


def _encrypt_block(block: bytes, keys: list[bytes]) -> bytes:
    s = [a ^ b for a, b in zip(block, keys[0], strict=True)]
    for r in range(1, len(keys)):
        s = [_BOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
        if r < len(keys) - 1:
            s = [_BY[2][s[c]] ^ _BY[3][s[c + (i + 1) % 4 - i]] ^ s[c + (i + 2) % 4 - i] ^ s[c + (i + 3) % 4 - i] for c in range(16) for i in (c % 4,)]
        s = [a ^ b for a, b in zip(s, keys[r], strict=True)]
    return bytes(s)


def aes_decrypt(key: bytes, data: bytes, iv: bytes | None = None, pad: bool = True) -> bytes:
    """AES-CBC; the first block is the vector unless one is given. Bad padding leaves the bytes."""
    if iv is None:
        iv, data = data[:16], data[16:]
    keys, out = _keys(key), bytearray()
    for k in range(0, len(data) - 15, 16):
        block = data[k:k + 16]
        out += bytes(a ^ b for a, b in zip(_decrypt_block(block, keys), iv, strict=True))
        iv = block
    if pad and out and 1 <= out[-1] <= 16 and out[-out[-1]:] == bytes([out[-1]]) * out[-1]:
        del out[-out[-1]:]
    return bytes(out)


def aes_encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    """AES-CBC without padding."""
    keys, out = _keys(key), bytearray()
    for k in range(0, len(data), 16):
        iv = _encrypt_block(bytes(a ^ b for a, b in zip(data[k:k + 16], iv, strict=True)), keys)
        out += iv
    return bytes(out)


def _hash_r6(password: bytes, salt: bytes, user: bytes = b"", revision: int = 6) -> bytes:
    k = hashlib.sha256(password + salt + user).digest()
    if revision < 6:
        return k
    n = 0
    while True:
        e = aes_encrypt(k[:16], (password + k + user) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


class Handler:
    """Of an encryption dictionary and the file's first id; ``key`` is None until a password fits."""

    def __init__(self, attrs: dict, first_id: bytes) -> None:
        self.attrs, self.id = attrs, first_id
        self.v, self.r = attrs.get("V", 0), attrs.get("R", 2)
        self.length = attrs.get("Length", 40) // 8 if self.v > 1 else 5
        self.o, self.u, self.p = attrs.get("O", b""), attrs.get("U", b""), attrs.get("P", 0)
        method = "RC4"
        if self.v >= 4:
            crypt = attrs.get("CF", {}).get(attrs.get("StmF", "Identity"), {})
            method = {"V2": "RC4", "AESV2": "AES", "AESV3": "AES", "None": "None"}.get(str(crypt.get("CFM", "None")), "None")
            self.length = 16 if self.v == 4 else 32
        self.method = method
        self.key: bytes | None = None
        self.meta = attrs.get("EncryptMetadata", True)

    def file_key(self, password: bytes) -> bytes:
        data = (password + PAD)[:32] + self.o[:32] + (self.p & 0xFFFFFFFF).to_bytes(4, "little") + self.id
        if self.r >= 4 and self.meta is False:
            data += b"\xff\xff\xff\xff"
        k = hashlib.md5(data).digest()
        for _ in range(50 if self.r >= 3 else 0):
            k = hashlib.md5(k[:self.length]).digest()
        return k[:self.length]

    def fits(self, key: bytes) -> bool:
        if self.r == 2:
            return rc4(key, PAD) == self.u[:32]
        x = rc4(key, hashlib.md5(PAD + self.id).digest())
        for i in range(1, 20):
            x = rc4(bytes(b ^ i for b in key), x)
        return x == self.u[:16]

    def authenticate(self, password: str = "") -> bool:
        """With a user or an owner password."""
        if self.r >= 5:
            raw = password.encode("utf-8")[:127]
            for hashed, user, sealed in ((self.u, b"", "UE"), (self.o, self.u[:48], "OE")):
                if _hash_r6(raw, hashed[32:40], user, self.r) == hashed[:32]:
                    self.key = aes_decrypt(_hash_r6(raw, hashed[40:48], user, self.r), self.attrs[sealed][:32], bytes(16), False)
                    return True
            return False
        raw = password.encode("latin-1", "replace")
        key = self.file_key(raw)
        if not self.fits(key):
            k = hashlib.md5((raw + PAD)[:32]).digest()
            for _ in range(50 if self.r >= 3 else 0):
                k = hashlib.md5(k).digest()
            user = self.o[:32]
            for i in range(19 if self.r >= 3 else 0, -1, -1):
                user = rc4(bytes(b ^ i for b in k[:self.length]), user)
            key = self.file_key(user)
            if not self.fits(key):
                return False
        self.key = key
        return True

    def open_bytes(self, data: bytes, num: int, gen: int) -> bytes:
        if self.key is None or self.method == "None":
            return data
        key = self.key
        if self.v < 5:
            salt = b"sAlT" if self.method == "AES" else b""
            key = hashlib.md5(key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + salt).digest()[:min(16, len(key) + 5)]
        return aes_decrypt(key, data) if self.method == "AES" else rc4(key, data)

    def open(self, value: Any, num: int, gen: int) -> Any:
        """An object with its strings and stream decrypted."""
        if isinstance(value, Ref):
            return value
        if isinstance(value, bytes):
            return self.open_bytes(value, num, gen)
        if isinstance(value, list):
            return [self.open(v, num, gen) for v in value]
        if isinstance(value, dict):
            return {k: self.open(v, num, gen) for k, v in value.items()}
        if isinstance(value, Stream):
            kind = value.attrs.get("Type")
            bare = kind == "XRef" or (kind == "Metadata" and self.meta is False)
            return Stream({k: self.open(v, num, gen) for k, v in value.attrs.items()}, value.raw if bare else self.open_bytes(value.raw, num, gen))
        return value


def permissions(p: int) -> dict[str, bool]:
    return {name: bool(p & bit) for name, bit in PERMISSIONS}
