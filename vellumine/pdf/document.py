"""A document: cross-references, objects, the page tree and the relations that hang on the catalog."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from vellumine.pdf import filters
from vellumine.pdf.crypt import Handler, permissions
from vellumine.pdf.syntax import Name, Parser, Ref, Stream, SyntaxFault, text_of, written

#: Bounds on what hostile files can ask for.
MOST_PAGES, MOST_NODES, MOST_OBJECTS = 200_000, 400_000, 5_000_000
MOST_ACTIONS = 1_000
INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")


class DocumentFault(ValueError):
    """A file that isn't a PDF document, or one that no password given opens."""


class Page:
    def __init__(self, doc: Document, number: int, attrs: dict, ref: Ref | None) -> None:
        self.doc, self.number, self.attrs, self.ref = doc, number, attrs, ref

    def get(self, key: str) -> Any:
        return self.doc.resolve(self.attrs.get(key))

    def box(self, name: str) -> tuple[float, float, float, float] | None:
        value = self.get(name)
        if not isinstance(value, list) or len(value) != 4:
            return None
        x = [v if isinstance(v, (int, float)) else 0 for v in map(self.doc.resolve, value)]
        return float(min(x[0], x[2])), float(min(x[1], x[3])), float(max(x[0], x[2])), float(max(x[1], x[3]))

    def boxes(self) -> dict[str, tuple[float, float, float, float]]:
        """Media box (letter size without one), crop box or that, and the others or the crop box."""
        media = self.box("MediaBox") or (0.0, 0.0, 612.0, 792.0)
        crop = self.box("CropBox") or media
        return {"media": media, "crop": crop} | {k: self.box(f"{k.title()}Box") or crop for k in ("bleed", "trim", "art")}

    def rotate(self) -> int:
        r = self.get("Rotate")
        return r % 360 if isinstance(r, int) else 0

    def resources(self) -> dict:
        r = self.get("Resources")
        return r if isinstance(r, dict) else {}

    def contents(self) -> bytes:
        """Its streams on end, a line break between; those that can't be decoded are left out."""
        own = self.get("Contents")
        parts = []
        for s in own if isinstance(own, list) else [own]:
            s = self.doc.resolve(s)
            if isinstance(s, Stream):
                try:
                    parts.append(self.doc.decoded(s))
                except filters.FilterFault:
                    continue
        return b"\n".join(parts)


class Document:
    def __init__(self, data: bytes, password: str = "") -> None:
        self.data = data
        self.table: dict[int, tuple] = {}
        self.cache: dict[int, Any] = {}
        self.members: dict[int, list] = {}
        self.open_now: set[int] = set()
        self.handler: Handler | None = None
        if data[:5] != b"%PDF-":
            raise DocumentFault("no %PDF- at the start")
        self.version = re.split(rb"[\r\n]", data[5:25], maxsplit=1)[0].decode("latin-1").strip()
        at = data.rfind(b"startxref", max(0, len(data) - 1024))
        m = re.compile(rb"startxref\s+(\d+)").match(data, at) if at >= 0 else None
        if m is None:
            raise DocumentFault("no startxref")
        self.trailer: dict = {}
        self.revisions = 0
        self.cross_references(int(m[1]))
        if "Encrypt" in self.trailer:
            attrs = self.resolve(self.trailer["Encrypt"])
            ids = self.resolve(self.trailer.get("ID"))
            first = self.resolve(ids[0]) if isinstance(ids, list) and ids else b""
            if not isinstance(attrs, dict):
                raise DocumentFault("no encryption dictionary")
            own = {k: self.deep(v) for k, v in attrs.items()}
            self.cache.clear()
            self.members.clear()
            self.handler = Handler(own, first if isinstance(first, bytes) else b"")
            self.sealed = self.trailer["Encrypt"].num if isinstance(self.trailer["Encrypt"], Ref) else -1
            if not (self.handler.authenticate(password) or (password and self.handler.authenticate(""))):
                raise DocumentFault("the password doesn't fit")
        self.root = self.resolve(self.trailer.get("Root"))
        if not isinstance(self.root, dict):
            raise DocumentFault("no catalog")
        self.pages = list(self.page_tree())

    # --- cross-references ---

    def cross_references(self, at: int) -> None:
        """Tables and streams, newest first: what is seen first holds. Each offset is read once."""
        todo, seen = [at], set()
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                if at not in seen and not seen:
                    raise DocumentFault("startxref points outside the file")
                continue
            seen.add(at)
            self.revisions += 1
            m = re.compile(rb"[\0\t\n\f\r ]*xref").match(self.data, at)
            attrs = self.classic(m.end()) if m else self.stream_table(at)
            self.trailer = {**attrs, **self.trailer}
            todo += [x for x in (attrs.get("XRefStm"), attrs.get("Prev")) if isinstance(x, int)]

    def classic(self, at: int) -> dict:
        section = re.compile(rb"[\0\t\n\f\r ]*(\d+)[ \t]+(\d+)[\0\t\n\f\r ]*")
        entry = re.compile(rb"[\0\t\n\f\r ]*(\d{1,10})[ \t]+(\d{1,5})[ \t]+([nf])")
        while (m := section.match(self.data, at)) is not None:
            at, first, n = m.end(), int(m[1]), int(m[2])
            for k in range(min(n, MOST_OBJECTS)):
                e = entry.match(self.data, at)
                if e is None:
                    break
                at = e.end()
                self.table.setdefault(first + k, ("at", int(e[1]), int(e[2])) if e[3] == b"n" else ("free", 0, int(e[2])))
        m = re.compile(rb"[\0\t\n\f\r ]*trailer").match(self.data, at)
        if m is None:
            raise DocumentFault("a cross-reference table has no trailer")
        attrs = Parser(self.data, m.end()).object()
        if not isinstance(attrs, dict):
            raise DocumentFault("a trailer isn't a dictionary")
        return attrs

    def stream_table(self, at: int) -> dict:
        try:
            _, _, s = Parser(self.data, at).indirect()
        except SyntaxFault as e:
            raise DocumentFault(f"no cross-references: {e}") from None
        if not isinstance(s, Stream):
            raise DocumentFault("cross-references aren't a stream")
        rows = filters.decode(s.raw, s.attrs)
        w = [x if isinstance(x, int) and 0 <= x <= 8 else 0 for x in s.attrs.get("W", [0, 0, 0])][:3]
        size = sum(w)
        index = s.attrs.get("Index", [0, s.attrs.get("Size", 0)])
        k = 0
        for first, n in zip(index[::2], index[1::2]):
            for i in range(min(n, MOST_OBJECTS)):
                row = rows[k:k + size]
                if len(row) < size or not size:
                    break
                k += size
                a, b, c = row[:w[0]], row[w[0]:w[0] + w[1]], row[w[0] + w[1]:]
                kind = int.from_bytes(a, "big") if w[0] else 1
                x, y = int.from_bytes(b, "big"), int.from_bytes(c, "big")
                self.table.setdefault(first + i, ("free", x, y) if kind == 0 else ("at", x, y) if kind == 1 else ("in", x, y))
        return s.attrs

    # --- objects ---

    def length_of(self, value: Any) -> Any:
        return self.resolve(value)

    def resolve(self, value: Any) -> Any:
        """What references stand for; those to nothing, or to themselves, are null."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.get(value.num)
        return None

    def deep(self, value: Any, depth: int = 0) -> Any:
        value = self.resolve(value)
        if depth > 20:
            return None
        if isinstance(value, list):
            return [self.deep(v, depth + 1) for v in value]
        if isinstance(value, dict):
            return {k: self.deep(v, depth + 1) for k, v in value.items()}
        return value

    def get(self, num: int) -> Any:
        if num in self.cache:
            return self.cache[num]
        kind, a, b = self.table.get(num, ("free", 0, 0))
        value = None
        if kind != "free" and num not in self.open_now:
            self.open_now.add(num)
            try:
                if kind == "at":
                    n, gen, value = Parser(self.data, a).indirect(self.length_of)
                    if n != num:
                        value = None
                    elif self.handler is not None and num != self.sealed:
                        value = self.handler.open(value, n, gen)
                else:
                    value = self.member(a, b, num)
            except (SyntaxFault, filters.FilterFault):
                value = None
            finally:
                self.open_now.discard(num)
        self.cache[num] = value
        return value

    def member(self, stream: int, index: int, num: int) -> Any:
        if stream not in self.members:
            s = self.get(stream)
            found: list = []
            if isinstance(s, Stream):
                body = self.decoded(s)
                first = self.resolve(s.attrs.get("First")) or 0
                head = [int(x) for x in re.findall(rb"\d+", body[:first])]
                found = [(n, Parser(body, first + at).object()) for n, at in zip(head[::2], head[1::2])]
            self.members[stream] = found
        held = self.members[stream]
        if index < len(held) and held[index][0] == num:
            return held[index][1]
        return next((v for n, v in held if n == num), None)

    def decoded(self, s: Stream) -> bytes:
        return filters.decode(s.raw, s.attrs, self.resolve)

    def objects(self) -> Iterator[tuple[int, int, str, Any]]:
        """(number, generation, kind, value) of every object in use."""
        for num in sorted(self.table):
            kind, _, gen = self.table[num]
            if kind == "free":
                continue
            v = self.get(num)
            name = ("null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "real" if isinstance(v, float) else "name" if isinstance(v, Name)
                    else "string" if isinstance(v, bytes) else "array" if isinstance(v, list) else "dictionary" if isinstance(v, dict) else "stream" if isinstance(v, Stream) else "word")
            yield num, gen if kind == "at" else 0, name, v

    # --- pages ---

    def page_tree(self) -> Iterator[Page]:
        """Leaves in order, with what their ancestors give them. A node is visited once; too many are a fault."""
        todo: list[tuple[Any, dict]] = [(self.root.get("Pages"), {})]
        seen: set = set()
        number = 0
        while todo:
            if len(seen) >= MOST_NODES:
                raise DocumentFault(f"more than {MOST_NODES} nodes in the page tree")
            ref, above = todo.pop()
            if isinstance(ref, Ref):
                if ref.num in seen:
                    continue
                seen.add(ref.num)
            node = self.resolve(ref)
            if not isinstance(node, dict):
                continue
            own = above | {k: node[k] for k in INHERITED if k in node}
            kids = self.resolve(node.get("Kids"))
            if node.get("Type") == "Pages" or (isinstance(kids, list) and node.get("Type") != "Page"):
                todo += [(k, own) for k in reversed(kids if isinstance(kids, list) else [])]
            elif node.get("Type") == "Page":
                number += 1
                if number > MOST_PAGES:
                    raise DocumentFault(f"more than {MOST_PAGES} pages")
                yield Page(self, number, {**own, **node}, ref if isinstance(ref, Ref) else None)

    # --- metadata ---

    def info(self) -> dict:
        attrs = self.resolve(self.trailer.get("Info"))
        own = {k: text_of(self.resolve(v)) for k, v in attrs.items()} if isinstance(attrs, dict) else {}
        form = self.resolve(self.root.get("AcroForm"))
        mark = self.resolve(self.root.get("MarkInfo"))
        mark = mark if isinstance(mark, dict) else {}
        standard = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")
        return {
            **{k.lower(): own.get(k) for k in standard},
            "custom": {k: v for k, v in own.items() if k not in standard and k != "Trapped" and v is not None},
            "version": self.version, "n_pages": len(self.pages), "encrypted": "Encrypt" in self.trailer,
            "tagged": self.resolve(mark.get("Marked")) is True, "suspects": self.resolve(mark.get("Suspects")) is True,
            "form": "none" if not isinstance(form, dict) else "XFA" if "XFA" in form else "AcroForm",
            "javascript": bool(self.javascript()), "optimized": b"/Linearized" in self.data[:1024],
            "incremental": self.data.count(b"%%EOF") > 1,
            "permissions": permissions(self.handler.p) if self.handler else permissions(-1),
        }

    def metadata(self) -> str | None:
        s = self.resolve(self.root.get("Metadata"))
        return self.decoded(s).decode("utf-8", "replace") if isinstance(s, Stream) else None

    def name_tree(self, node: Any) -> Iterator[tuple[str, Any]]:
        todo, seen = [node], set()
        while todo and len(seen) < MOST_NODES:
            ref = todo.pop(0)
            if isinstance(ref, Ref):
                if ref.num in seen:
                    continue
                seen.add(ref.num)
            own = self.resolve(ref)
            if not isinstance(own, dict):
                continue
            pairs = self.resolve(own.get("Names"))
            if isinstance(pairs, list):
                for k, v in zip(pairs[::2], pairs[1::2]):
                    yield text_of(self.resolve(k)) or "", self.resolve(v)
            kids = self.resolve(own.get("Kids"))
            todo += kids if isinstance(kids, list) else []

    def names(self, key: str) -> list[tuple[str, Any]]:
        own = self.resolve(self.root.get("Names"))
        return list(self.name_tree(own.get(key))) if isinstance(own, dict) and key in own else []

    def script(self, action: Any) -> str | None:
        action = self.resolve(action)
        code = self.resolve(action.get("JS")) if isinstance(action, dict) else None
        return self.decoded(code).decode("latin-1") if isinstance(code, Stream) else text_of(code)

    def javascript(self) -> list[tuple[str, str]]:
        found = [(k, s) for k, v in self.names("JavaScript") if (s := self.script(v)) is not None]
        opened = self.script(self.root.get("OpenAction")) if isinstance(self.resolve(self.root.get("OpenAction")), dict) else None
        return found + ([("OpenAction", opened)] if opened is not None else [])

    def destinations(self) -> list[tuple[str, str]]:
        own = self.resolve(self.root.get("Dests"))
        old = [(k, self.resolve(v)) for k, v in own.items()] if isinstance(own, dict) else []
        return [(k, written(self.deep(v.get("D") if isinstance(v, dict) else v))) for k, v in dict(old + self.names("Dests")).items()]

    # --- what pages and the catalog hold ---

    def number(self, v: Any, default: float | None = None) -> float | None:
        v = self.resolve(v)
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else default

    def rect(self, v: Any) -> list[float] | None:
        v = self.resolve(v)
        return [self.number(x, 0.0) for x in v] if isinstance(v, list) and len(v) == 4 else None

    def actions(self, value: Any) -> list[dict]:
        """An action and those that follow it, each once; too many are a fault."""
        out, todo, seen = [], [value], set()
        while todo:
            if len(out) >= MOST_ACTIONS:
                raise DocumentFault(f"more than {MOST_ACTIONS} actions in a chain")
            ref = todo.pop(0)
            if isinstance(ref, Ref):
                if ref.num in seen:
                    continue
                seen.add(ref.num)
            a = self.resolve(ref)
            if not isinstance(a, dict):
                continue
            kind = str(self.resolve(a.get("S")) or "")
            target = {"URI": "URI", "GoTo": "D", "GoToR": "F", "Launch": "F"}.get(kind)
            value = self.deep(a.get(target)) if target else None
            if isinstance(value, dict):
                value = value.get("UF", value.get("F"))
            out.append({"kind": kind, "target": self.script(a) if kind == "JavaScript" else text_of(value) if isinstance(value, (bytes, Name)) else written(value) if value is not None else None})
            after = self.resolve(a.get("Next"))
            todo += after if isinstance(after, list) else [a.get("Next")] if after is not None else []
        return out

    def annotations(self, page: Page) -> Iterator[dict]:
        own = page.get("Annots")
        for k, ref in enumerate(own if isinstance(own, list) else []):
            a = self.resolve(ref)
            if not isinstance(a, dict):
                continue
            nm = self.resolve(a.get("NM"))
            color = self.resolve(a.get("C"))
            dest = self.deep(a.get("Dest"))
            yield {
                "page_no": page.number, "index": k, "subtype": str(self.resolve(a.get("Subtype")) or "Text"), "rect": self.rect(a.get("Rect")),
                "contents": text_of(self.resolve(a.get("Contents"))), "name": text_of(nm), "flags": int(self.number(a.get("F"), 0) or 0),
                "color": [self.number(x, 0.0) for x in color] if isinstance(color, list) else None,
                "border": self.border(a),
                "dest": written(dest) if dest is not None else None, "actions": self.actions(a.get("A")),
            }

    def border(self, a: dict) -> float:
        """Width of an annotation's border: of its style, else the third of its border array, else 1."""
        style, old = self.resolve(a.get("BS")), self.resolve(a.get("Border"))
        if isinstance(style, dict):
            return self.number(style.get("W"), 1.0)
        return self.number(old[2], 1.0) if isinstance(old, list) and len(old) > 2 else 1.0

    def form_fields(self) -> Iterator[dict]:
        """Fields under dotted names; type, flags, value and default come down from parents."""
        form = self.resolve(self.root.get("AcroForm"))
        roots = self.resolve(form.get("Fields")) if isinstance(form, dict) else None
        todo = [(r, "", 0, {}) for r in reversed(roots if isinstance(roots, list) else [])]
        seen: set = set()
        while todo and len(seen) < MOST_NODES:
            ref, above, depth, given = todo.pop()
            if isinstance(ref, Ref):
                if ref.num in seen:
                    continue
                seen.add(ref.num)
            f = self.resolve(ref)
            if not isinstance(f, dict):
                continue
            own = given | {k: f[k] for k in ("FT", "Ff", "V", "DV", "MaxLen") if k in f}
            part = text_of(self.resolve(f.get("T")))
            name = ".".join(x for x in (above, part) if x)
            kids = self.resolve(f.get("Kids"))
            children = [k for k in kids if isinstance(self.resolve(k), dict) and "T" in self.resolve(k)] if isinstance(kids, list) else []
            flags = int(self.number(own.get("Ff"), 0) or 0)
            value = self.deep(own.get("V"))
            if not children or "FT" in own:
                options = self.deep(f.get("Opt"))
                yield {
                    "name": name, "parent": above or None, "depth": depth, "type": str(self.resolve(own.get("FT")) or "") or None,
                    "value": text_of(value) if isinstance(value, (bytes, Name)) else written(value) if value is not None and not isinstance(value, dict) else None,
                    "default": text_of(self.resolve(own.get("DV"))), "flags": flags, "read_only": bool(flags & 1), "required": bool(flags & 2), "no_export": bool(flags & 4),
                    "max_len": int(x) if (x := self.number(own.get("MaxLen"))) is not None else None, "rect": self.rect(f.get("Rect")),
                    "options": [text_of(o[-1] if isinstance(o, list) and o else o) or "" for o in options] if isinstance(options, list) else [],
                    "signature": value if isinstance(value, dict) else None,
                }
            todo += [(k, name, depth + 1, own) for k in reversed(children)]

    def attachments(self) -> Iterator[dict]:
        for key, spec in self.names("EmbeddedFiles"):
            if not isinstance(spec, dict):
                continue
            held = self.resolve(spec.get("EF"))
            s = self.resolve(held.get("UF", held.get("F"))) if isinstance(held, dict) else None
            params = self.resolve(s.attrs.get("Params")) if isinstance(s, Stream) else None
            params = params if isinstance(params, dict) else {}
            try:
                data = self.decoded(s) if isinstance(s, Stream) else None
            except filters.FilterFault:
                data = None
            named = text_of(self.resolve(spec.get("UF"))) or text_of(self.resolve(spec.get("F"))) or key
            size = self.number(params.get("Size"))
            yield {
                "name": named, "safe_name": re.sub(r"[\0-\x1f]", "_", re.split(r"[/\\]", named)[-1]).strip(". ") or "attachment", "description": text_of(self.resolve(spec.get("Desc"))),
                "mime": str(self.resolve(s.attrs.get("Subtype")) or "") or None if isinstance(s, Stream) else None, "size": int(size) if size is not None else len(data) if data is not None else None,
                "created": text_of(self.resolve(params.get("CreationDate"))), "modified": text_of(self.resolve(params.get("ModDate"))), "data": data,
            }

    def signatures(self) -> Iterator[dict]:
        """Metadata; whether a signature is valid isn't judged here."""
        for f in self.form_fields():
            v = f["signature"]
            if f["type"] != "Sig" or v is None:
                continue
            ranges = [int(x) for x in v.get("ByteRange", []) if isinstance(x, (int, float))]
            blob = v.get("Contents") if isinstance(v.get("Contents"), bytes) else b""
            yield {
                "field": f["name"], "filter": str(v.get("Filter", "")) or None, "sub_filter": str(v.get("SubFilter", "")) or None, "signer": text_of(v.get("Name")), "reason": text_of(v.get("Reason")),
                "location": text_of(v.get("Location")), "contact": text_of(v.get("ContactInfo")), "signed": text_of(v.get("M")), "byte_range": ranges,
                "covers_all": len(ranges) == 4 and ranges[0] == 0 and ranges[2] + ranges[3] == len(self.data), "contents_bytes": len(blob.rstrip(b"\0")), "valid": None,
            }

    def layers(self) -> Iterator[dict]:
        """Optional-content groups under the default configuration: base state, then ON, then OFF."""
        own = self.resolve(self.root.get("OCProperties"))
        if not isinstance(own, dict):
            return
        d = self.resolve(own.get("D"))
        d = d if isinstance(d, dict) else {}
        listed = lambda key: {r.num for r in self.resolve(d.get(key)) or [] if isinstance(r, Ref)} if isinstance(self.resolve(d.get(key)), list) else set()
        on, off, locked = listed("ON"), listed("OFF"), listed("Locked")
        radio = [{r.num for r in self.resolve(g) if isinstance(r, Ref)} for g in self.resolve(d.get("RBGroups")) or [] if isinstance(self.resolve(g), list)]
        base = str(self.resolve(d.get("BaseState")) or "ON")
        groups = self.resolve(own.get("OCGs"))
        for k, ref in enumerate(groups if isinstance(groups, list) else []):
            g = self.resolve(ref)
            if not isinstance(g, dict) or not isinstance(ref, Ref):
                continue
            usage = self.deep(g.get("Usage"))
            usage = usage if isinstance(usage, dict) else {}
            state = lambda part, key: str(usage.get(part, {}).get(key, "Unchanged")) if isinstance(usage.get(part), dict) else "Unchanged"
            visible = ref.num not in off and (ref.num in on or base != "OFF")
            intent = self.resolve(g.get("Intent"))
            yield {
                "index": k, "num": ref.num, "name": text_of(self.resolve(g.get("Name"))), "visible": visible, "locked": ref.num in locked,
                "intent": ",".join(map(str, intent)) if isinstance(intent, list) else str(intent or "View"),
                "print_state": state("Print", "PrintState"), "view_state": state("View", "ViewState"), "export_state": state("Export", "ExportState"),
                "radio_group": next((i for i, r in enumerate(radio) if ref.num in r), None),
            }

    def fonts(self, page: Page) -> Iterator[dict]:
        own = self.resolve(page.resources().get("Font"))
        for key, ref in sorted(own.items()) if isinstance(own, dict) else ():
            f = self.resolve(ref)
            if not isinstance(f, dict):
                continue
            kids = self.resolve(f.get("DescendantFonts"))
            below = self.resolve(kids[0]) if isinstance(kids, list) and kids else None
            below = below if isinstance(below, dict) else {}
            descriptor = self.resolve(f.get("FontDescriptor", below.get("FontDescriptor")))
            descriptor = descriptor if isinstance(descriptor, dict) else {}
            encoding = self.resolve(f.get("Encoding"))
            name = str(self.resolve(f.get("BaseFont")) or "")
            kind = str(self.resolve(f.get("Subtype")) or "")
            yield {
                "page_no": page.number, "resource": key, "name": name, "type": kind, "descendant": str(self.resolve(below.get("Subtype")) or "") or None,
                "encoding": "Standard" if encoding is None else str(encoding) if isinstance(encoding, Name) else str(self.resolve(encoding.get("BaseEncoding")) or "Custom") if isinstance(encoding, dict) else "Custom",
                "embedded": any(k in descriptor for k in ("FontFile", "FontFile2", "FontFile3")), "subset": bool(re.match(r"[A-Z]{6}\+.", name)),
                "unicode": "ToUnicode" in f or kind == "Type0", "flags": int(self.number(descriptor.get("Flags"), 0) or 0),
                "italic_angle": self.number(descriptor.get("ItalicAngle"), 0.0), "weight": self.number(descriptor.get("FontWeight")), "stem_v": self.number(descriptor.get("StemV")), "num": ref.num if isinstance(ref, Ref) else None,
            }

    def color_space(self, value: Any, resources: dict) -> tuple[str, int]:
        value = self.resolve(value)
        named = self.resolve(resources.get("ColorSpace"))
        if isinstance(value, Name) and isinstance(named, dict) and value in named:
            value = self.resolve(named[value])
        plainly = {"DeviceGray": ("gray", 1), "G": ("gray", 1), "CalGray": ("gray", 1), "DeviceRGB": ("rgb", 3), "RGB": ("rgb", 3), "CalRGB": ("rgb", 3), "DeviceCMYK": ("cmyk", 4), "CMYK": ("cmyk", 4), "Indexed": ("index", 1), "I": ("index", 1), "Separation": ("sep", 1), "Lab": ("lab", 3), "Pattern": ("pattern", 1)}
        if isinstance(value, list) and value:
            head = str(self.resolve(value[0]))
            if head == "ICCBased":
                s = self.resolve(value[1]) if len(value) > 1 else None
                n = int(self.number(s.attrs.get("N"), 3) or 3) if isinstance(s, Stream) else 3
                return {1: "icc-gray", 3: "icc-rgb", 4: "icc-cmyk"}.get(n, "icc"), n
            if head == "DeviceN":
                inks = self.resolve(value[1]) if len(value) > 1 else []
                return "devn", len(inks) if isinstance(inks, list) else 1
            return plainly.get(head, (head, 1))
        return plainly.get(str(value), ("gray", 1))

    def images(self, page: Page, data: bool = False) -> Iterator[dict]:
        """Image XObjects of a page and of the forms it draws, in order of name."""
        todo, seen, index = [("", page.resources())], set(), 0
        while todo:
            path, resources = todo.pop(0)
            own = self.resolve(resources.get("XObject"))
            for key, ref in sorted(own.items()) if isinstance(own, dict) else ():
                s = self.resolve(ref)
                if not isinstance(s, Stream) or (isinstance(ref, Ref) and ref.num in seen):
                    continue
                if isinstance(ref, Ref):
                    seen.add(ref.num)
                kind = str(self.resolve(s.attrs.get("Subtype")))
                if kind == "Form":
                    inner = self.resolve(s.attrs.get("Resources"))
                    if isinstance(inner, dict):
                        todo.append((f"{path}{key}/", inner))
                    continue
                if kind != "Image":
                    continue
                mask = self.resolve(s.attrs.get("ImageMask")) is True
                space, n = ("gray", 1) if mask else self.color_space(s.attrs.get("ColorSpace"), resources)
                width, height = (int(self.number(s.attrs.get(k), 0) or 0) for k in ("Width", "Height"))
                bpc = 1 if mask else int(self.number(s.attrs.get("BitsPerComponent"), 8) or 8)
                names = filters.names_of(s.attrs, self.resolve)
                full = width * height * n * bpc // 8
                held = None
                if data:
                    try:
                        held = self.decoded(s)
                    except filters.FilterFault:
                        held = None
                yield {
                    "page_no": page.number, "index": index, "name": path + key, "width": width, "height": height, "color": space, "components": n, "bpc": bpc,
                    "filter": names[0] if names else None, "n_bytes": len(s.raw), "ratio": len(s.raw) * 100 // full if full else None, "is_mask": mask,
                    "interpolate": self.resolve(s.attrs.get("Interpolate")) is True, "intent": str(self.resolve(s.attrs.get("Intent")) or "RelativeColorimetric"), "num": ref.num if isinstance(ref, Ref) else None, "data": held,
                }
                index += 1

    def xfa(self) -> bytes | None:
        form = self.resolve(self.root.get("AcroForm"))
        own = self.resolve(form.get("XFA")) if isinstance(form, dict) else None
        parts = own[1::2] if isinstance(own, list) else [own]
        held = [self.decoded(s) for s in map(self.resolve, parts) if isinstance(s, Stream)]
        return b"".join(held) if held else None
