"""Content streams: operations, and the text that they show."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

from vellumine.pdf import filters
from vellumine.pdf.document import Document, DocumentFault, Page
from vellumine.pdf.syntax import END, Mark, Name, Parser, Ref, Stream, SyntaxFault, Word

#: Operators by family (fixed values).
FAMILIES = {
    "graphics state": "q Q cm w J j M d ri i gs", "path": "m l c v y h re", "paint": "S s f F f* B B* b b* n", "clip": "W W*",
    "text object": "BT ET", "text state": "Tc Tw Tz TL Tf Tr Ts", "text position": "Td TD Tm T*", "text show": "Tj TJ ' \"",
    "type 3": "d0 d1", "color": "CS cs SC SCN sc scn G g RG rg K k", "shading": "sh", "inline image": "BI ID EI", "object": "Do", "marked content": "MP DP BMC BDC EMC", "compatibility": "BX EX",
}
OPERATORS = {op: family for family, ops in FAMILIES.items() for op in ops.split()}
MOST_OPERATIONS, MOST_FORMS = 5_000_000, 16


def operations(data: bytes) -> Iterator[tuple[str, list]]:
    """(operator, operands) in order; inline images come as BI with their attributes and bytes. Too many are a fault."""
    p = Parser(data, references=False)
    operands: list = []
    n = 0
    while True:
        try:
            x = p.object()
        except SyntaxFault:
            return
        if x is END:
            return
        if isinstance(x, Word):
            n += 1
            if n > MOST_OPERATIONS:
                raise DocumentFault(f"more than {MOST_OPERATIONS} operations in a content stream")
            if x == "BI":
                attrs: dict = {}
                while (k := p.object()) is not END and not (isinstance(k, Word) and k == "ID"):
                    attrs[str(k)] = p.object()
                m = re.compile(rb"\s(.*?)[\r\n \t]EI(?=[\0\t\n\f\r ]|$)", re.S).match(data, p.at)
                p.at = m.end() if m else len(data)
                yield "BI", [attrs, m[1] if m else b""]
            else:
                yield str(x), operands
            operands = []
        elif not isinstance(x, Mark):
            operands.append(x)


# --- fonts -----------------------------------------------------------------------------------

@lru_cache(maxsize=4)
def glyphs() -> dict[str, str]:
    """Names of Latin glyphs, made from Unicode's own names of letters with accents, and the plain signs."""
    import unicodedata

    marks = {"GRAVE": "grave", "ACUTE": "acute", "CIRCUMFLEX": "circumflex", "TILDE": "tilde", "DIAERESIS": "dieresis", "RING ABOVE": "ring", "CEDILLA": "cedilla", "CARON": "caron", "OGONEK": "ogonek", "MACRON": "macron", "BREVE": "breve", "DOT ABOVE": "dotaccent"}
    signs = "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at".split()
    more = {"bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "eth": "ð", "Eth": "Ð", "thorn": "þ", "Thorn": "Þ", "bullet": "•", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "guillemotleft": "«", "guillemotright": "»", "ellipsis": "…", "fi": "ﬁ", "fl": "ﬂ", "Euro": "€", "sterling": "£", "section": "§", "degree": "°", "copyright": "©", "registered": "®", "trademark": "™"}
    out = {n: chr(32 + i) for i, n in enumerate(signs)} | {c: c for c in map(chr, range(65, 91))} | {c: c for c in map(chr, range(97, 123))} | more
    for c in map(chr, range(0xC0, 0x180)):
        m = re.fullmatch(r"LATIN (SMALL|CAPITAL) LETTER ([A-Z]) WITH (.+)", unicodedata.name(c, ""))
        if m and m[3] in marks:
            out[(m[2] if m[1] == "CAPITAL" else m[2].lower()) + marks[m[3]]] = c
    return out


def glyph(name: str) -> str:
    if name in glyphs():
        return glyphs()[name]
    m = re.match(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})$", name)
    return chr(int(m[1] or m[2], 16)) if m else "�"


def cmap_tokens(data: bytes) -> Iterator[Any]:
    p = Parser(data, references=False)
    while (x := p.object()) is not END:
        yield x


def unicode_of(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace") if len(raw) > 1 else raw.decode("latin-1")


class CMap:
    """A ToUnicode map: byte widths of codes, single codes, and ranges."""

    MOST = 1 << 20

    def __init__(self, data: bytes) -> None:
        self.chars: dict[tuple[int, int], str] = {}
        self.widths: set[int] = set()
        held: list = []
        for x in cmap_tokens(data):
            if not isinstance(x, Word):
                held.append(x)
                continue
            if x == "endcodespacerange":
                self.widths |= {len(v) for v in held if isinstance(v, bytes) and v}
            elif x == "endbfchar":
                pairs = [v for v in held if isinstance(v, (bytes, Name))]
                for a, b in zip(pairs[::2], pairs[1::2]):
                    if isinstance(a, bytes):
                        self.chars[len(a), int.from_bytes(a, "big")] = unicode_of(b) if isinstance(b, bytes) else glyph(b)
            elif x == "endbfrange":
                parts = [v for v in held if isinstance(v, (bytes, list))]
                for a, b, to in zip(parts[::3], parts[1::3], parts[2::3]):
                    if not isinstance(a, bytes) or not isinstance(b, bytes):
                        continue
                    first, last = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                    for k in range(min(last - first + 1, 0x10000)):
                        if len(self.chars) > self.MOST:
                            break
                        if isinstance(to, list):
                            if k < len(to) and isinstance(to[k], bytes):
                                self.chars[len(a), first + k] = unicode_of(to[k])
                        elif to:
                            n = int.from_bytes(to, "big") + k
                            self.chars[len(a), first + k] = unicode_of((n & ((1 << 8 * len(to)) - 1)).to_bytes(len(to), "big"))
            if x.startswith("begin") or x.startswith("end"):
                held = []
        self.widths |= {w for w, _ in self.chars}


#: Python codecs of CID orderings whose character codes encodings like GBK-EUC-H use (fixed values).
CODECS = {"GB": "gbk", "B5": "big5", "ETen": "big5", "90ms": "cp932", "90pv": "cp932", "EUC-": "euc_jp", "KSC": "cp949", "UniGB-UCS2": "utf-16-be", "UniCNS-UCS2": "utf-16-be", "UniJIS-UCS2": "utf-16-be", "UniKS-UCS2": "utf-16-be", "UniGB-UTF16": "utf-16-be", "UniCNS-UTF16": "utf-16-be", "UniJIS-UTF16": "utf-16-be", "UniKS-UTF16": "utf-16-be"}


class Font:
    """How a font's bytes are text, and how wide they are."""

    def __init__(self, doc: Document | None, attrs: dict, cid_text: dict[str, list[int]] | None = None) -> None:
        get = doc.resolve if doc else (lambda x: x)
        self.name = str(get(attrs.get("BaseFont")) or "")
        self.kind = str(get(attrs.get("Subtype")) or "")
        encoding = get(attrs.get("Encoding"))
        self.two = self.kind == "Type0"
        self.codec = next((c for p, c in CODECS.items() if isinstance(encoding, Name) and encoding.startswith(p)), None)
        map_ = get(attrs.get("ToUnicode"))
        self.cmap = None
        if isinstance(map_, Stream):
            try:
                self.cmap = CMap(doc.decoded(map_) if doc else map_.raw)
            except (filters.FilterFault, SyntaxFault):
                self.cmap = None
        base = {"MacRomanEncoding": "mac_roman", "WinAnsiEncoding": "cp1252"}.get(str(get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding), "latin-1")
        self.single = {k: bytes([k]).decode(base, "replace") for k in range(256)}
        if isinstance(encoding, dict):
            at = 0
            for d in get(encoding.get("Differences")) or []:
                if isinstance(d, int):
                    at = d
                elif isinstance(d, Name):
                    self.single[at] = glyph(d)
                    at += 1
        self.widths: dict[int, float] = {}
        self.default: float | None = None
        kids = get(attrs.get("DescendantFonts"))
        below = get(kids[0]) if isinstance(kids, list) and kids else None
        self.cids: list[int] | None = None
        if isinstance(below, dict):
            self.default = float(get(below.get("DW")) or 1000)
            w = get(below.get("W")) or []
            k = 0
            while k + 1 < len(w):
                first, second = get(w[k]), get(w[k + 1])
                if isinstance(second, list):
                    self.widths |= {first + i: float(get(x) or 0) for i, x in enumerate(second)}
                    k += 2
                elif k + 2 < len(w):
                    self.widths |= dict.fromkeys(range(first, min(second, first + 0xFFFF) + 1), float(get(w[k + 2]) or 0))
                    k += 3
                else:
                    break
            system = get(below.get("CIDSystemInfo"))
            if isinstance(system, dict) and cid_text:
                order = get(system.get("Ordering"))
                self.cids = cid_text.get(order.decode("latin-1") if isinstance(order, bytes) else str(order))
        else:
            first = get(attrs.get("FirstChar")) or 0
            for i, x in enumerate(get(attrs.get("Widths")) or []):
                x = get(x)
                if isinstance(x, (int, float)):
                    self.widths[first + i] = float(x)

    def codes(self, raw: bytes) -> Iterator[tuple[int, int]]:
        """(bytes of the code, code)."""
        widths = sorted(self.cmap.widths) if self.cmap and self.cmap.widths else []
        two = self.two or widths == [2]
        if self.cmap and len(widths) > 1 and not self.two:
            k = 0
            while k < len(raw):
                n = next((n for n in widths if (n, int.from_bytes(raw[k:k + n], "big")) in self.cmap.chars), widths[0])
                yield n, int.from_bytes(raw[k:k + n], "big")
                k += n
        elif two:
            for k in range(0, len(raw) - 1, 2):
                yield 2, raw[k] << 8 | raw[k + 1]
            if len(raw) % 2:
                yield 1, raw[-1]
        else:
            for b in raw:
                yield 1, b

    def decode(self, raw: bytes) -> tuple[str, list[int]]:
        """Text and the codes it came of."""
        codes = list(self.codes(raw))
        if self.cmap is not None and self.cmap.chars:
            return "".join(self.cmap.chars.get(c) or self.cmap.chars.get((3 - c[0], c[1])) or chr(c[1]) for c in codes), [c for _, c in codes]
        if raw[:2] == b"\xfe\xff":
            return raw[2:].decode("utf-16-be", "replace"), [c for _, c in codes]
        if self.codec:
            return raw.decode(self.codec, "replace"), [c for _, c in codes]
        if self.two:
            return "".join(chr(self.cids[c]) if self.cids and c < len(self.cids) and self.cids[c] else chr(c) for _, c in codes), [c for _, c in codes]
        return "".join(self.single[c] for _, c in codes), [c for _, c in codes]


def is_wide(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "가" <= c <= "힯" or "豈" <= c <= "﫿" or "\U00020000" <= c <= "\U0002ceaf"


def width_of(text: str, codes: list[int], font: Font | None, size: float) -> float:
    """By the font's widths; else an em for wide letters and half of one for others."""
    if font is not None and (font.widths or font.default is not None):
        return sum(font.widths.get(c, font.default if font.default is not None else 500.0) for c in codes) / 1000 * size
    return sum(1.0 if is_wide(c) else 0.5 for c in text) * size


# --- text ------------------------------------------------------------------------------------

def times(m: tuple, n: tuple) -> tuple:
    """Affine matrices: m, then n."""
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o


ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class State:
    __slots__ = ("color", "ctm", "font", "leading", "mode", "rise", "scale", "size", "space", "word")

    def __init__(self) -> None:
        self.ctm, self.font, self.size = ONE, None, 0.0
        self.space = self.word = self.leading = self.rise = 0.0
        self.scale, self.mode, self.color = 100.0, 0, (0.0, 0.0, 0.0)

    def copy(self) -> State:
        s = State.__new__(State)
        for k in State.__slots__:
            setattr(s, k, getattr(self, k))
        return s


def number(x: Any) -> float:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else 0.0


class TextReader:
    """Runs a page's operations and gathers items: text, place, size, font, colour, matrix."""

    def __init__(self, doc: Document, page: Page, cid_text: dict | None = None, fonts: dict | None = None) -> None:
        self.doc, self.page, self.cid_text = doc, page, cid_text
        self.items: list[dict] = []
        self.images: list[dict] = []
        self.opened: list[int] = []  # forms that are being shown
        self.fonts = fonts if fonts is not None else {}

    def run(self) -> list[dict]:
        self.stream(self.page.contents(), self.page.resources(), State(), 0)
        return self.items

    def font(self, resources: dict, key: Any) -> Font | None:
        own = self.doc.resolve(resources.get("Font"))
        ref = own.get(str(key)) if isinstance(own, dict) else None
        mark = ref.num if isinstance(ref, Ref) else id(ref)
        if mark not in self.fonts:
            attrs = self.doc.resolve(ref)
            self.fonts[mark] = Font(self.doc, attrs, self.cid_text) if isinstance(attrs, dict) else None
        return self.fonts[mark]

    def show(self, s: State, raw: bytes, tm: tuple) -> tuple:
        text, codes = s.font.decode(raw) if s.font else (raw.decode("latin-1"), list(raw))
        z = s.scale / 100
        spaces = sum(c == 32 for c in codes) if not (s.font and s.font.two) else 0
        width = (width_of(text, codes, s.font, s.size) + s.space * len(codes) + s.word * spaces) * z
        whole = times((s.size * z, 0.0, 0.0, s.size, 0.0, s.rise), times(tm, s.ctm))
        start = times((1, 0, 0, 1, 0, s.rise), times(tm, s.ctm))
        end = times((1, 0, 0, 1, width, s.rise), times(tm, s.ctm))
        if text:
            self.items.append({
                "seq": len(self.items), "text": text, "x": start[4], "y": start[5], "x_end": end[4], "y_end": end[5], "size": math.hypot(whole[2], whole[3]) if s.size else 0.0,
                "font": s.font.name if s.font else None, "color": s.color, "invisible": s.mode == 3, "matrix": whole,
            })
        return times((1, 0, 0, 1, width, 0), tm)

    def stream(self, data: bytes, resources: dict, s: State, depth: int) -> None:
        stack: list[State] = []
        tm = line = ONE
        for op, x in operations(data):
            if op == "q":
                stack.append(s.copy())
            elif op == "Q":
                s = stack.pop() if stack else s
            elif op == "cm" and len(x) == 6:
                s.ctm = times(tuple(map(number, x)), s.ctm)
            elif op == "BT":
                tm = line = ONE
            elif op == "Tf" and len(x) >= 2:
                s.font, s.size = self.font(resources, x[-2]), number(x[-1])
            elif op in ("Tc", "Tw", "Tz", "TL", "Ts", "Tr") and x:
                v = number(x[-1])
                if op == "Tr":
                    s.mode = int(v)
                else:
                    setattr(s, {"Tc": "space", "Tw": "word", "Tz": "scale", "TL": "leading", "Ts": "rise"}[op], v)
            elif op in ("Td", "TD") and len(x) >= 2:
                if op == "TD":
                    s.leading = -number(x[1])
                tm = line = times((1, 0, 0, 1, number(x[0]), number(x[1])), line)
            elif op == "Tm" and len(x) == 6:
                tm = line = tuple(map(number, x))
            elif op in ("T*", "'", '"'):
                if op == '"' and len(x) >= 3:
                    s.word, s.space = number(x[0]), number(x[1])
                tm = line = times((1, 0, 0, 1, 0, -s.leading), line)
                if op != "T*" and x and isinstance(x[-1], bytes):
                    tm = self.show(s, x[-1], tm)
            elif op == "Tj" and x and isinstance(x[-1], bytes):
                tm = self.show(s, x[-1], tm)
            elif op == "TJ" and x and isinstance(x[-1], list):
                for part in x[-1]:
                    if isinstance(part, bytes):
                        tm = self.show(s, part, tm)
                    else:
                        tm = times((1, 0, 0, 1, -number(part) * s.size * s.scale / 100 / 1000, 0), tm)
            elif op == "g" and x:
                s.color = (number(x[0]),) * 3
            elif op == "rg" and len(x) >= 3:
                s.color = tuple(map(number, x[:3]))
            elif op == "k" and len(x) >= 4:
                c, m, y, k = map(number, x[:4])
                s.color = tuple(1 - min(1.0, v + k) for v in (c, m, y))
            elif op == "Do" and x:
                own = self.doc.resolve(resources.get("XObject"))
                form = self.doc.resolve(own.get(str(x[-1]))) if isinstance(own, dict) else None
                if not isinstance(form, Stream):
                    continue
                if self.doc.resolve(form.attrs.get("Subtype")) == "Image":
                    self.images.append({"name": str(x[-1]), "matrix": s.ctm})
                elif isinstance(own[str(x[-1])], Ref) and own[str(x[-1])].num in self.opened:
                    continue  # a form that shows itself
                elif depth >= MOST_FORMS:
                    raise DocumentFault(f"forms in forms, over {MOST_FORMS} deep")
                else:
                    inner = self.doc.resolve(form.attrs.get("Resources"))
                    matrix = self.doc.resolve(form.attrs.get("Matrix"))
                    below = s.copy()
                    if isinstance(matrix, list) and len(matrix) == 6:
                        below.ctm = times(tuple(number(self.doc.resolve(v)) for v in matrix), s.ctm)
                    self.opened.append(own[str(x[-1])].num if isinstance(own[str(x[-1])], Ref) else -1)
                    try:
                        self.stream(self.doc.decoded(form), inner if isinstance(inner, dict) else resources, below, depth + 1)
                    except filters.FilterFault:
                        continue
                    finally:
                        self.opened.pop()


