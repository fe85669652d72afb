"""Objects, tokens and the parser of PDF syntax, for files and for content streams.

Null is None; booleans, integers and reals are Python's; strings are bytes; names are ``Name``;
arrays are lists, dictionaries dicts by str; ``Ref`` and ``Stream`` are what they say; any other
bare word is a ``Word`` (an operator in a content stream).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any, NamedTuple

#: How deep arrays and dictionaries may stand in each other.
DEPTH = 200


class Name(str):
    __slots__ = ()


class Word(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


@dataclass
class Stream:
    attrs: dict
    raw: bytes


class SyntaxFault(ValueError):
    """Bytes that aren't PDF syntax."""


_TOKEN = re.compile(
    rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*"
    rb"(?:(?P<real>[+-]?(?:\d+\.\d*|\.\d+))|(?P<int>[+-]?\d+)|/(?P<name>[^\0\t\n\f\r ()<>\[\]{}/%]*)|(?P<mark><<|>>|[\[\]{}])|<(?P<hex>[^<>]*)>|(?P<text>\()|(?P<word>[^\0\t\n\f\r ()<>\[\]{}/%]+)|(?P<odd>[)>]))"
)
_PART = re.compile(rb"[()\\]")
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_HEX_NAME = re.compile(r"#([0-9A-Fa-f]{2})")
_CONSTANTS = {b"true": True, b"false": False, b"null": None}
_END = object()
_CLOSE = {b"]": "]", b">>": ">>"}


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses whose first one is before ``at``."""
    out, depth = bytearray(), 1
    while True:
        m = _PART.search(data, at)
        if m is None:
            raise SyntaxFault("a string doesn't end")
        out += data[at:m.start()].replace(b"\r\n", b"\n").replace(b"\r", b"\n")
        at = m.end()
        c = m[0]
        if c == b"(":
            depth += 1
            out += c
        elif c == b")":
            depth -= 1
            if not depth:
                return bytes(out), at
            out += c
        else:
            e = data[at:at + 1]
            if e in _ESCAPED:
                out += _ESCAPED[e]
                at += 1
            elif e.isdigit() and e < b"8":
                n = re.compile(rb"[0-7]{1,3}").match(data, at)
                out.append(int(n[0], 8) & 0xFF)
                at = n.end()
            elif e in (b"\r", b"\n"):
                at += 2 if data[at:at + 2] == b"\r\n" else 1
            else:
                out += e
                at += 1


def unhex(digits: bytes) -> bytes:
    clean = re.sub(rb"[^0-9A-Fa-f]", b"", digits)
    return bytes.fromhex((clean + b"0" if len(clean) % 2 else clean).decode())


def name_of(raw: bytes) -> Name:
    return Name(_HEX_NAME.sub(lambda m: chr(int(m[1], 16)), raw.decode("latin-1")))


class Parser:
    """Reads objects from bytes at a position that moves on."""

    def __init__(self, data: bytes, at: int = 0, references: bool = True) -> None:
        self.data, self.at, self.references = data, at, references

    def token(self) -> Any:
        m = _TOKEN.match(self.data, self.at)
        if m is None:
            self.at = len(self.data)
            return _END
        self.at = m.end()
        kind = m.lastgroup
        if kind == "int":
            return int(m["int"])
        if kind == "real":
            return float(m["real"])
        if kind == "name":
            return name_of(m["name"])
        if kind == "mark":
            return Mark(m["mark"].decode())
        if kind == "hex":
            return unhex(m["hex"])
        if kind == "text":
            out, self.at = literal(self.data, self.at)
            return out
        if kind == "word":
            w = m["word"]
            return _CONSTANTS[w] if w in _CONSTANTS else Word(w.decode("latin-1"))
        return Word(m["odd"].decode())

    def object(self, depth: int = 0) -> Any:
        """The next object, ``END`` at the end; closing marks come back as they are."""
        if depth > DEPTH:
            raise SyntaxFault("nested too deep")
        t = self.token()
        if type(t) is int and t >= 0 and self.references:
            m = _REFERENCE.match(self.data, self.at)
            if m is not None:
                self.at = m.end()
                return Ref(t, int(m[1]))
        if type(t) is Mark:
            if t == "[":
                out: list = []
                while (x := self.object(depth + 1)) is not _END and not (type(x) is Mark and x == "]"):
                    if not isinstance(x, (Mark,)):
                        out.append(x)
                return out
            if t == "<<":
                attrs: dict = {}
                while (k := self.object(depth + 1)) is not _END and not (type(k) is Mark and k == ">>"):
                    if not isinstance(k, Name):
                        continue
                    v = self.object(depth + 1)
                    if v is _END or (type(v) is Mark and v == ">>"):
                        break
                    attrs[str(k)] = v
                return attrs
        return t

    def indirect(self, length_of=None) -> tuple[int, int, Any]:
        """``n g obj ... endobj``; a stream's length is asked of ``length_of``, else its end is looked for."""
        head = _INDIRECT.match(self.data, self.at)
        if head is None:
            raise SyntaxFault(f"no object at byte {self.at}")
        self.at = head.end()
        value = self.object()
        if isinstance(value, dict):
            m = _STREAM.match(self.data, self.at)
            if m is not None:
                begin = m.end()
                n = length_of(value.get("Length")) if length_of else value.get("Length")
                if not isinstance(n, int) or n < 0 or _ENDSTREAM.match(self.data, begin + n) is None:
                    end = self.data.find(b"endstream", begin)
                    if end < 0:
                        raise SyntaxFault("a stream doesn't end")
                    n = end - begin
                    if self.data[begin + n - 2:begin + n] == b"\r\n":
                        n -= 2
                    elif n and self.data[begin + n - 1:begin + n] in (b"\n", b"\r"):
                        n -= 1
                value = Stream(value, self.data[begin:begin + n])
                self.at = begin + n
        return int(head[1]), int(head[2]), value


class Mark(str):
    __slots__ = ()


END = _END
_REFERENCE = re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_INDIRECT = re.compile(rb"[\0\t\n\f\r ]*(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj")
_STREAM = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*stream(?:\r\n|\n|\r)")
_ENDSTREAM = re.compile(rb"[\0\t\n\f\r ]*endstream")


def written(value: Any) -> str:
    """An object as text: integers 42, names /Test, strings (x), references 1 0 R; dictionary keys in order."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, Ref):
        return f"{value.num} {value.gen} R"
    if isinstance(value, Name):
        return "/" + re.sub(r"[^!-~]|[#()<>\[\]{}/%]", lambda m: "".join(f"#{b:02X}" for b in m[0].encode("latin-1", "replace")), value)
    if isinstance(value, str):
        return str(value)
    if isinstance(value, float):
        return f"{value:.10f}".rstrip("0").rstrip(".")
    if isinstance(value, bytes):
        return f"<{value.hex().upper()}>" if any(b < 32 or b > 126 for b in value) else "(" + value.decode("latin-1").replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ")"
    if isinstance(value, list):
        return "[" + " ".join(map(written, value)) + "]"
    if isinstance(value, dict):
        return "<<" + " ".join(f"{written(Name(k))} {written(value[k])}" for k in sorted(value)) + ">>"
    if isinstance(value, Stream):
        return written(value.attrs) + f" stream[{len(value.raw)}]"
    return str(value)


def text_of(value: Any) -> str | None:
    """A text string: UTF-16BE or UTF-8 by its mark, else Latin-1."""
    if not isinstance(value, bytes):
        return str(value) if isinstance(value, Name) else None
    if value[:2] == b"\xfe\xff":
        return value[2:].decode("utf-16-be", "replace")
    if value[:3] == b"\xef\xbb\xbf":
        return value[3:].decode("utf-8", "replace")
    return value.decode("latin-1")


def plain(value: Any) -> Any:
    """An object as JSON holds it: names with a slash, strings as text, references as text."""
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, Stream):
        return {"stream": plain(value.attrs), "bytes": len(value.raw)}
    if isinstance(value, (Name, Ref)):
        return written(value)
    if isinstance(value, bytes):
        return text_of(value)
    return value
