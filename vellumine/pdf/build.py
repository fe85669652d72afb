"""Writing PDF files: pages of lines, single pages, and pages of several files as one."""

from __future__ import annotations

import zlib
from typing import Any

from vellumine.pdf.document import Document, Page
from vellumine.pdf.syntax import Name, Ref, Stream, written

SIZE, LEADING, PER_PAGE, LEFT, TOP = 12, 14, 50, 72, 740


def serialise(value: Any) -> bytes:
    if isinstance(value, list):
        return b"[" + b" ".join(map(serialise, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b" ".join(written(Name(k)).encode("latin-1") + b" " + serialise(v) for k, v in value.items()) + b">>"
    if isinstance(value, Stream):
        return serialise({**value.attrs, "Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    if isinstance(value, bytes):
        return b"<" + value.hex().upper().encode() + b">"
    return written(value).encode("latin-1", "replace")


class Writer:
    """Objects by number; ``finish`` puts them in a file."""

    def __init__(self) -> None:
        self.objects: list[Any] = []

    def add(self, value: Any = None) -> Ref:
        self.objects.append(value)
        return Ref(len(self.objects), 0)

    def put(self, ref: Ref, value: Any) -> None:
        self.objects[ref.num - 1] = value

    def finish(self, root: Ref, info: Ref | None = None, version: str = "1.7", compact: bool = False) -> bytes:
        """With a cross-reference table, or (``compact``) objects and cross-references in streams."""
        out, places = bytearray(f"%PDF-{version}\n%\xe2\xe3\xcf\xd3\n".encode("latin-1")), {}
        extra = {"Info": info} if info else {}
        packed: dict[int, tuple[int, int]] = {}
        objects = list(self.objects)
        if compact:
            inner = [(k, v) for k, v in enumerate(objects, 1) if not isinstance(v, Stream)]
            bodies, head, at = [], [], 0
            for k, v in inner:
                b = serialise(v)
                head.append(f"{k} {at}")
                bodies.append(b)
                at += len(b) + 1
            first = " ".join(head).encode() + b" "
            objects.append(Stream({"Type": Name("ObjStm"), "N": len(inner), "First": len(first), "Filter": Name("FlateDecode")}, zlib.compress(first + b"\n".join(bodies))))
            packed = {k: (len(objects), i) for i, (k, _) in enumerate(inner)}
        for k, v in enumerate(objects, 1):
            if k not in packed:
                places[k] = len(out)
                out += f"{k} 0 obj\n".encode() + serialise(v) + b"\nendobj\n"
        start, n = len(out), len(objects) + 1
        if compact:
            rows = bytes([0, 0, 0, 0, 0, 255, 255])
            for k in range(1, n):
                rows += b"\2" + packed[k][0].to_bytes(4, "big") + packed[k][1].to_bytes(2, "big") if k in packed else b"\1" + places[k].to_bytes(4, "big") + b"\0\0"
            rows += b"\1" + start.to_bytes(4, "big") + b"\0\0"
            # rows with the PNG predictor "up", as most writers store them
            above, filtered = bytes(7), b""
            for i in range(0, len(rows), 7):
                row = rows[i:i + 7]
                filtered += b"\2" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
                above = row
            s = Stream({"Type": Name("XRef"), "Size": n + 1, "W": [1, 4, 2], "Root": root, **extra, "Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 7}}, zlib.compress(filtered))
            out += f"{n} 0 obj\n".encode() + serialise(s) + b"\nendobj\n"
        else:
            out += f"xref\n0 {n}\n0000000000 65535 f \n".encode() + b"".join(f"{places[k]:010d} 00000 n \n".encode() for k in range(1, n))
            out += b"trailer\n" + serialise({"Size": n, "Root": root, **extra}) + b"\n"
        return bytes(out) + f"startxref\n{start}\n%%EOF\n".encode()


def to_unicode(chars: list[str]) -> bytes:
    """A ToUnicode map whose code k + 1 is the k-th character."""
    rows = [f"<{k:04X}> <{c.encode('utf-16-be', 'surrogatepass').hex().upper()}>" for k, c in enumerate(chars, 1)]
    parts = "".join(f"{len(rows[i:i + 100])} beginbfchar\n" + "\n".join(rows[i:i + 100]) + "\nendbfchar\n" for i in range(0, len(rows), 100))
    return f"/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n{parts}endcmap\nend\nend".encode()


def from_lines(lines: list[str], title: str | None = None, per_page: int = PER_PAGE, kerned: bool = True, compact: bool = False, flate: bool = True) -> bytes:
    """A document of these lines: each one shown once, in a composite font with a map to Unicode."""
    w = Writer()
    root, pages, font = w.add(), w.add(), w.add()
    chars = sorted(set("".join(lines)))
    if len(chars) > 0xFFFE:
        raise ValueError("more characters than a font has codes")
    code = {c: k for k, c in enumerate(chars, 1)}
    pack = lambda data: Stream({"Filter": Name("FlateDecode")}, zlib.compress(data)) if flate else Stream({}, data)
    below = w.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Vellum"), "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}, "DW": 500})
    w.put(font, {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Vellum"), "Encoding": Name("Identity-H"), "DescendantFonts": [below], "ToUnicode": w.add(pack(to_unicode(chars)))})
    hexed = lambda s: "<" + "".join(f"{code[c]:04X}" for c in s) + ">"
    kids = []
    for k in range(0, max(1, len(lines)), per_page):
        ops = [f"BT /F1 {SIZE} Tf {LEADING} TL {LEFT} {TOP} Td"]
        for n, line in enumerate(lines[k:k + per_page]):
            half = len(line) // 2
            shown = f"[{hexed(line[:half])} 0 {hexed(line[half:])}] TJ" if kerned and n % 2 and half else f"{hexed(line)} Tj"
            ops.append(("T* " if n else "") + shown)
        body = w.add(pack("\n".join([*ops, "ET"]).encode()))
        kids.append(w.add({"Type": Name("Page"), "Parent": pages, "MediaBox": [0, 0, 612, 792], "Resources": {"Font": {"F1": font}}, "Contents": body}))
    w.put(pages, {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)})
    w.put(root, {"Type": Name("Catalog"), "Pages": pages})
    info = w.add({"Title": b"\xfe\xff" + title.encode("utf-16-be")}) if title else None
    return w.finish(root, info, compact=compact)


def furnished(number: int, title: str) -> bytes:
    """A document of one page with one or more of each interactive thing, named and placed by its number."""
    w = Writer()
    root, pages, page = w.add(), w.add(), w.add()
    link = w.add({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [10, 20, 110 + number % 50, 40], "A": {"S": Name("URI"), "URI": f"https://example.com/{number}".encode()}})
    note = w.add({"Type": Name("Annot"), "Subtype": Name("Text"), "Rect": [200, 200, 220, 220], "Contents": b"\xfe\xff" + title.encode("utf-16-be"), "F": number % 4})
    field = w.add({"FT": Name("Tx"), "T": f"field{number}".encode(), "V": f"value {number}".encode(), "Ff": number % 8, "MaxLen": number % 100 + 1, "Subtype": Name("Widget"), "Rect": [0, 0, 100, 20]})
    below = w.add({"T": b"below", "FT": Name("Btn"), "Subtype": Name("Widget"), "Rect": [0, 30, 10, 40]})
    group = w.add({"T": f"group{number}".encode(), "Kids": [below]})
    data = f"attachment of {number}\n".encode() * (number % 5 + 1)
    held = w.add(Stream({"Type": Name("EmbeddedFile"), "Subtype": Name("text/plain"), "Params": {"Size": len(data)}, "Filter": Name("FlateDecode")}, zlib.compress(data)))
    attachment = w.add({"Type": Name("Filespec"), "F": f"../notes{number}.txt".encode(), "EF": {"F": held}, "Desc": b"notes"})
    side = number % 7 + 1
    kind, parts = (("DeviceGray", 1), ("DeviceRGB", 3), ("DeviceCMYK", 4))[number % 3]
    image = w.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": side, "Height": 2, "ColorSpace": Name(kind), "BitsPerComponent": 8}, bytes((number + k) % 256 for k in range(2 * side * parts))))
    layers = [w.add({"Type": Name("OCG"), "Name": f"layer {number}.{k}".encode()}) for k in range(3)]
    body = w.add(Stream({}, f"q {side * 10} 0 0 20 50 60 cm /Im1 Do Q".encode()))
    w.put(page, {"Type": Name("Page"), "Parent": pages, "MediaBox": [0, 0, 300, 400], "Rotate": 90 * (number % 4), "Annots": [link, note], "Resources": {"XObject": {"Im1": image}}, "Contents": body})
    w.put(pages, {"Type": Name("Pages"), "Kids": [page], "Count": 1})
    w.put(root, {
        "Type": Name("Catalog"), "Pages": pages, "AcroForm": {"Fields": [field, group]}, "OCProperties": {"OCGs": layers, "D": {"OFF": [layers[number % 3]]}},
        "Names": {"EmbeddedFiles": {"Names": [f"notes{number}".encode(), attachment]}, "Dests": {"Names": [f"place{number}".encode(), [page, Name("Fit")]]}, "JavaScript": {"Names": [b"greet", {"S": Name("JavaScript"), "JS": f"app.alert({number})".encode()}]}},
    })
    info = w.add({"Title": b"\xfe\xff" + title.encode("utf-16-be"), "Author": f"author {number}".encode(), "CreationDate": b"D:20240102030405Z"})
    return w.finish(root, info)


def broken_page(data: bytes) -> bytes:
    """The file with an incremental update in which the first page shows forms within forms, more than are entered."""
    d = Document(data)
    page = d.pages[0]
    n = max(d.table) + 1
    deep = 20
    form = lambda k: Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 1, 1], "Resources": {"XObject": {"Fm": Ref(n + k + 1, 0)}}}, b"/Fm Do")
    own = {**page.attrs, "Resources": {"XObject": {"Fm": Ref(n, 0)}}, "Contents": Ref(n + deep, 0)}
    out, places = bytearray(data), {}
    for num, value in ((page.ref.num, own), *((n + k, form(k)) for k in range(deep)), (n + deep, Stream({}, b"/Fm Do"))):
        places[num] = len(out)
        out += f"{num} 0 obj\n".encode() + serialise(value) + b"\nendobj\n"
    start = len(out)
    out += b"xref\n" + b"".join(f"{k} 1\n{places[k]:010d} 00000 n \n".encode() for k in sorted(places))
    return bytes(out) + b"trailer\n" + serialise({"Size": n + deep + 1, "Root": d.trailer["Root"], "Prev": int(data[data.rindex(b"startxref") + 9:].split()[0])}) + f"\nstartxref\n{start}\n%%EOF\n".encode()


def from_pages(pages: list[Page]) -> bytes:
    """The pages, of one document or several, as a document; what they refer to comes along, each object once."""
    w = Writer()
    root, tree = w.add(), w.add()
    moved: dict[tuple[int, int], Ref] = {}

    def copy(doc: Document, value: Any) -> Any:
        todo: list[tuple[Ref, Any]] = []

        def shallow(v: Any) -> Any:
            if isinstance(v, Ref):
                key = (id(doc), v.num)
                if key not in moved:
                    target = doc.resolve(v)
                    if isinstance(target, dict) and target.get("Type") in ("Page", "Pages", "Catalog"):
                        return None
                    moved[key] = w.add()
                    todo.append((moved[key], target))
                return moved[key]
            if isinstance(v, list):
                return [shallow(x) for x in v]
            if isinstance(v, dict):
                return {k: shallow(x) for k, x in v.items() if k != "Parent"}
            if isinstance(v, Stream):
                return Stream({k: shallow(x) for k, x in v.attrs.items() if k != "Length"}, v.raw)
            return v

        out = shallow(value)
        while todo:
            ref, target = todo.pop()
            w.put(ref, shallow(target))
        return out

    kids = [w.add({**copy(p.doc, {k: v for k, v in p.attrs.items() if k not in ("Parent", "Annots", "StructParents")}), "Parent": tree}) for p in pages]
    w.put(tree, {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)})
    w.put(root, {"Type": Name("Catalog"), "Pages": tree})
    return w.finish(root)


def split(data: bytes, first: int = 1, last: int = 0) -> list[bytes]:
    """Each page of a range as a document; ``last`` 0 is the end."""
    doc = Document(data)
    first, last = max(1, first), len(doc.pages) if last <= 0 else min(last, len(doc.pages))
    return [from_pages([p]) for p in doc.pages[first - 1:last]]


def merge(files: list[bytes]) -> bytes:
    return from_pages([p for data in files for p in Document(data).pages])


def attach(data: bytes, name: str, content: bytes, mime: str | None = None) -> bytes:
    """The file with an attachment, as an incremental update: bytes before it stay as they are."""
    doc = Document(data)
    if doc.handler is not None:
        raise ValueError("files are attached to plain documents only")
    root = doc.trailer["Root"]
    n = max([*doc.table, doc.resolve(doc.trailer.get("Size")) or 1]) + 1
    held = [x for key, spec in doc.names("EmbeddedFiles") for x in (key.encode("latin-1", "replace"), spec)]
    text = b"\xfe\xff" + name.encode("utf-16-be")
    file = Stream({"Type": Name("EmbeddedFile"), **({"Subtype": Name(mime)} if mime else {}), "Params": {"Size": len(content)}, "Filter": Name("FlateDecode")}, zlib.compress(content))
    spec = {"Type": Name("Filespec"), "F": name.encode("latin-1", "replace"), "UF": text, "EF": {"F": Ref(n, 0), "UF": Ref(n, 0)}}
    pairs = sorted([*zip(held[::2], held[1::2], strict=True), (name.encode("latin-1", "replace"), Ref(n + 1, 0))], key=lambda p: p[0])
    names = doc.resolve(doc.root.get("Names"))
    catalog = {**doc.root, "Names": {**(names if isinstance(names, dict) else {}), "EmbeddedFiles": {"Names": [x for p in pairs for x in p]}}}
    out, places = bytearray(data if data.endswith(b"\n") else data + b"\n"), {}
    for num, value in ((root.num, catalog), (n, file), (n + 1, spec)):
        places[num] = len(out)
        out += f"{num} 0 obj\n".encode() + serialise(value) + b"\nendobj\n"
    before = int(data[data.rfind(b"startxref") + 9:].split()[0])
    start = len(out)
    out += b"xref\n" + b"".join(f"{k} 1\n{at:010d} 00000 n \n".encode() for k, at in sorted(places.items()))
    out += b"trailer\n" + serialise({"Size": n + 2, "Root": root, "Prev": before, **({"Info": doc.trailer["Info"]} if "Info" in doc.trailer else {}), **({"ID": doc.trailer["ID"]} if "ID" in doc.trailer else {})})
    return bytes(out) + f"\nstartxref\n{start}\n%%EOF\n".encode()
