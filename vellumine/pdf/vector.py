"""Pages as vector graphics: SVG and PostScript, from the operations of their content."""

from __future__ import annotations

from html import escape

from vellumine.pdf.content import ONE, TextReader, number, operations, times
from vellumine.pdf.document import Document, Page

#: PostScript operators that take a PDF operator's operands as they are (fixed values).
PLAIN = {"m": "moveto", "l": "lineto", "c": "curveto", "h": "closepath", "w": "setlinewidth", "J": "setlinecap", "j": "setlinejoin", "M": "setmiterlimit", "q": "gsave", "Q": "grestore", "g": "setgray", "rg": "setrgbcolor", "k": "setcmykcolor", "n": "newpath"}
PAINT = {"S": "stroke", "f": "fill", "F": "fill", "f*": "eofill", "B": "gsave fill grestore stroke", "B*": "gsave eofill grestore stroke", "s": "closepath stroke", "b": "closepath gsave fill grestore stroke", "b*": "closepath gsave eofill grestore stroke"}


def f(x: float) -> str:
    return f"{x:.4f}".rstrip("0").rstrip(".") or "0"


def rgb(c: tuple) -> str:
    return "#" + "".join(f"{round(255 * min(1.0, max(0.0, v))):02x}" for v in c)


def color_of(op: str, x: list) -> tuple | None:
    v = [number(i) for i in x if not isinstance(i, str)]
    if op in ("g", "G") and v:
        return (v[0],) * 3
    if op in ("rg", "RG", "sc", "scn", "SC", "SCN") and len(v) >= 3 and len(v) != 4:
        return tuple(v[:3])
    if op in ("k", "K", "sc", "scn", "SC", "SCN") and len(v) >= 4:
        return tuple(1 - min(1.0, i + v[3]) for i in v[:3])
    return (v[0],) * 3 if op in ("sc", "scn", "SC", "SCN") and v else None


class Paths:
    """Runs a page's path operations and gives painted paths: (data, fill, stroke, width, even-odd)."""

    def __init__(self, page: Page) -> None:
        self.page = page

    def run(self) -> list[tuple[str, str | None, str | None, float, bool]]:
        ctm, stack, out = ONE, [], []
        fill, stroke, width = (0.0,) * 3, (0.0,) * 3, 1.0
        path: list[str] = []
        here = start = (0.0, 0.0)
        at = lambda x, y: " ".join(f(v) for v in (ctm[0] * x + ctm[2] * y + ctm[4], ctm[1] * x + ctm[3] * y + ctm[5]))
        for op, raw in operations(self.page.contents()):
            x = [number(v) for v in raw]
            if op == "q":
                stack.append((ctm, fill, stroke, width))
            elif op == "Q" and stack:
                ctm, fill, stroke, width = stack.pop()
            elif op == "cm" and len(x) == 6:
                ctm = times(tuple(x), ctm)
            elif op == "w" and x:
                width = x[0]
            elif op in ("g", "rg", "k", "sc", "scn"):
                fill = color_of(op, raw) or fill
            elif op in ("G", "RG", "K", "SC", "SCN"):
                stroke = color_of(op, raw) or stroke
            elif op == "m" and len(x) == 2:
                path.append(f"M {at(*x)}")
                here = start = (x[0], x[1])
            elif op == "l" and len(x) == 2:
                path.append(f"L {at(*x)}")
                here = (x[0], x[1])
            elif op == "c" and len(x) == 6:
                path.append(f"C {at(*x[:2])} {at(*x[2:4])} {at(*x[4:])}")
                here = (x[4], x[5])
            elif op == "v" and len(x) == 4:
                path.append(f"C {at(*here)} {at(*x[:2])} {at(*x[2:])}")
                here = (x[2], x[3])
            elif op == "y" and len(x) == 4:
                path.append(f"C {at(*x[:2])} {at(*x[2:])} {at(*x[2:])}")
                here = (x[2], x[3])
            elif op == "re" and len(x) == 4:
                a, b, w, h = x
                path.append(f"M {at(a, b)} L {at(a + w, b)} L {at(a + w, b + h)} L {at(a, b + h)} Z")
                here = start = (a, b)
            elif op == "h":
                path.append("Z")
                here = start
            elif op in PAINT or op == "n":
                if op in ("s", "b", "b*"):
                    path.append("Z")
                if path and op != "n":
                    out.append((" ".join(path), rgb(fill) if op not in ("S", "s") else None, rgb(stroke) if op in ("S", "s", "B", "B*", "b", "b*") else None, width * abs(ctm[0] * ctm[3] - ctm[1] * ctm[2]) ** 0.5, "*" in op))
                path = []
        return out


def svg(doc: Document, page: Page) -> str:
    """The page as SVG: its paths, then its text at its place, size and colour."""
    a, b, c, d = page.boxes()["crop"]
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{f(c - a)}" height="{f(d - b)}" viewBox="0 0 {f(c - a)} {f(d - b)}">', f'<g transform="matrix(1 0 0 -1 {f(-a)} {f(d)})">']
    for data, fill, stroke, width, even in Paths(page).run():
        out.append(f'<path d="{data}" fill="{fill or "none"}" stroke="{stroke or "none"}" stroke-width="{f(width)}"{" fill-rule=" + chr(34) + "evenodd" + chr(34) if even else ""}/>')
    out.append("</g>")
    for i in TextReader(doc, page).run():
        if not i["invisible"]:
            out.append(f'<text x="{f(i["x"] - a)}" y="{f(d - i["y"])}" font-size="{f(i["size"])}" fill="{rgb(i["color"])}">{escape(i["text"])}</text>')
    return "\n".join([*out, "</svg>"])


def postscript(doc: Document, page: Page, encapsulated: bool = False) -> str:
    """The page as PostScript: operators that correspond, text shown at its place."""
    a, b, c, d = page.boxes()["crop"]
    out = [f"%!PS-Adobe-3.0{' EPSF-3.0' if encapsulated else ''}", f"%%BoundingBox: {int(a)} {int(b)} {int(-(-c // 1))} {int(-(-d // 1))}", "%%EndComments", "gsave"]
    here = (0.0, 0.0)
    for op, raw in operations(page.contents()):
        x = [number(v) for v in raw]
        args = " ".join(map(f, x))
        if op == "cm" and len(x) == 6:
            out.append(f"[{args}] concat")
        elif op == "re" and len(x) == 4:
            l, t, w, h = x
            out.append(f"{f(l)} {f(t)} moveto {f(w)} 0 rlineto 0 {f(h)} rlineto {f(-w)} 0 rlineto closepath")
        elif op in ("v", "y") and len(x) == 4:
            out.append(" ".join(map(f, [*(here if op == "v" else x[:2]), *(x[:2] if op == "v" else x[2:]), *x[2:]])) + " curveto")
        elif op in ("W", "W*"):
            out.append("clip" if op == "W" else "eoclip")
        elif op == "d" and raw and isinstance(raw[0], list):
            out.append(f"[{' '.join(f(number(v)) for v in raw[0])}] {f(number(raw[-1]))} setdash")
        elif op in ("G", "RG", "K"):
            out.append(f"{args} {PLAIN[op.lower()]}")
        elif op in PLAIN:
            out.append(f"{args} {PLAIN[op]}".strip())
        elif op in PAINT:
            out.append(PAINT[op])
        if op in ("m", "l", "c", "v", "y") and len(x) >= 2:
            here = (x[-2], x[-1])
    out.append("grestore")
    for i in TextReader(doc, page).run():
        if not i["invisible"]:
            safe = i["text"].encode("latin-1", "replace").decode("latin-1").replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
            out.append(f"/Helvetica findfont {f(i['size'])} scalefont setfont {' '.join(f(v) for v in i['color'])} setrgbcolor {f(i['x'])} {f(i['y'])} moveto ({safe}) show")
    return "\n".join([*out, "showpage", "%%EOF"])
