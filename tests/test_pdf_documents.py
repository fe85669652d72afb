"""Documents made for the purpose: structure, revisions, encryption, forms, layers, attachments, hostile files."""

import hashlib

import pytest

from vellumine.pdf import build, layout
from vellumine.pdf.content import TextReader
from vellumine.pdf.crypt import PAD, rc4
from vellumine.pdf.document import Document, DocumentFault
from vellumine.pdf.syntax import Name, Ref, Stream


def made(catalog=None, pages=1, extra=None, compact=False, page=None):
    """A document with these catalog entries; extra(writer) may add objects and return more entries."""
    w = build.Writer()
    root, tree = w.add(), w.add()
    more = extra(w) if extra else {}
    kids = [w.add({"Type": Name("Page"), "Parent": tree, **(page(w) if page else {})}) for _ in range(pages)]
    w.put(tree, {"Type": Name("Pages"), "Kids": kids, "Count": pages, "MediaBox": [0, 0, 300, 400], "Rotate": 90})
    w.put(root, {"Type": Name("Catalog"), "Pages": tree, **(catalog or {}), **more})
    return w.finish(root, compact=compact)


def page_items(body, resources=None):
    def page(w):
        return {"Contents": w.add(Stream({}, body)), "Resources": resources(w) if resources else {}}
    d = Document(made(page=page))
    return TextReader(d, d.pages[0]).run()


MINIMAL = b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] >>\nendobj\n"


def minimal():
    at = [MINIMAL.index(f"{k} 0 obj".encode()) for k in (1, 2, 3)]
    table = b"xref\n0 4\n0000000000 65535 f \n" + b"".join(f"{a:010d} 00000 n \n".encode() for a in at)
    return MINIMAL + table + f"trailer\n<< /Size 4 /Root 1 0 R >>\nstartxref\n{len(MINIMAL)}\n%%EOF".encode()


def test_minimal():
    d = Document(minimal())
    assert d.version == "1.4" and len(d.pages) == 1 and d.pages[0].boxes()["media"] == (0, 0, 612, 792) and d.pages[0].contents() == b""


@pytest.mark.parametrize("data", [b"", b"plain text", b"%PDF-"])
def test_invalid(data):
    with pytest.raises(DocumentFault):
        Document(data)


@pytest.mark.parametrize("compact", [False, True])
def test_inheritance_and_both_kinds_of_tables(compact):
    d = Document(made(pages=3, compact=compact))
    assert len(d.pages) == 3 and d.pages[2].boxes()["crop"] == (0, 0, 300, 400) and d.pages[1].rotate() == 90


def test_newest_revision_wins():
    first = minimal()
    new = first + b"\n3 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 100 200] >>\nendobj\n"
    at = len(first) + 1
    start = len(new)
    new += f"xref\n3 1\n{at:010d} 00000 n \ntrailer\n<< /Size 4 /Root 1 0 R /Prev {len(MINIMAL)} >>\nstartxref\n{start}\n%%EOF".encode()
    d = Document(new)
    assert d.pages[0].boxes()["media"] == (0, 0, 100, 200) and d.revisions == 2 and d.info()["incremental"]


def test_loops_end():
    looped = minimal().replace(b"/Root 1 0 R", f"/Root 1 0 R /Prev {len(MINIMAL)}".encode())
    assert len(Document(looped).pages) == 1
    w = build.Writer()
    root, tree = w.add(), w.add()
    w.put(tree, {"Type": Name("Pages"), "Kids": [tree, tree]})
    w.put(root, {"Type": Name("Catalog"), "Pages": tree})
    assert Document(w.finish(root)).pages == []


def test_arrays_in_shown_text_move_it():
    items = page_items(b"BT 0 g 2 Tr 1 w /F 10 Tf 100 700 Td [(AB) -500 (CD)] TJ ET")
    assert [i["text"] for i in items] == ["AB", "CD"]
    assert items[0]["x"] == 100 and items[1]["x"] == pytest.approx(items[0]["x_end"] + 5) and items[0]["size"] == 10


def test_matrices_and_states():
    items = page_items(b"q 2 0 0 2 10 20 cm BT /F 5 Tf 1 0 0 1 3 4 Tm (A) Tj ET Q BT /F 5 Tf 12 TL 0 50 Td (B) Tj (C) ' ET")
    assert [(i["text"], i["x"], i["y"]) for i in items] == [("A", 16, 28), ("B", 0, 50), ("C", 0, 38)] and items[0]["size"] == 10


def test_forms_are_entered_and_loops_end():
    def resources(w):
        form = w.add()
        w.put(form, Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "Matrix": [1, 0, 0, 1, 7, 0], "Resources": {"XObject": {"X": form}}}, b"BT 0 0 Td (in) Tj ET /X Do"))
        return {"XObject": {"X": form}}
    items = page_items(b"/X Do", resources)
    assert items[0]["text"] == "in" and items[0]["x"] == 7 and len(items) <= 20


def test_rc4_encryption():
    ids, p = b"0123456789abcdef", -44
    o = rc4(hashlib.md5(PAD).digest()[:5], PAD)
    key = hashlib.md5(PAD + o + (p & 0xFFFFFFFF).to_bytes(4, "little") + ids).digest()[:5]
    w = build.Writer()
    root, tree, page, body, lock = (w.add() for _ in range(5))
    own = hashlib.md5(key + (4).to_bytes(3, "little") + b"\0\0").digest()[:10]
    w.put(body, Stream({}, rc4(own, b"BT /F 10 Tf (secret) Tj ET")))
    w.put(page, {"Type": Name("Page"), "Contents": body})
    w.put(tree, {"Type": Name("Pages"), "Kids": [page], "Count": 1})
    w.put(root, {"Type": Name("Catalog"), "Pages": tree})
    w.put(lock, {"Filter": Name("Standard"), "V": 1, "R": 2, "O": o, "U": rc4(key, PAD), "P": p})
    data = w.finish(root).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 5 0 R /ID [<" + ids.hex().encode() + b"> <00>]")
    d = Document(data)
    assert TextReader(d, d.pages[0]).run()[0]["text"] == "secret"
    i = d.info()
    assert i["encrypted"] and i["permissions"] == {"print": True, "modify": False, "copy": True, "annotate": False}
    with pytest.raises(DocumentFault):
        Document(data.replace(rc4(key, PAD).hex().upper().encode(), b"00" * 32))


def test_form_fields_inherit():
    def extra(w):
        kid = w.add({"T": b"b", "Rect": [0, 0, 1, 1], "V": b"value"})
        field = w.add({"T": b"a", "FT": Name("Tx"), "Ff": 3, "Kids": [kid]})
        sig = w.add({"T": b"s", "FT": Name("Sig"), "V": w.add({"Filter": Name("Adobe.PPKLite"), "Name": b"me", "ByteRange": [0, 1, 2, 3], "Contents": b"abc\0\0"})})
        return {"AcroForm": {"Fields": [field, sig]}}
    d = Document(made(extra=extra))
    fields = {f["name"]: f for f in d.form_fields()}
    assert fields["a.b"]["type"] == "Tx" and fields["a.b"]["value"] == "value" and fields["a.b"]["read_only"] and fields["a.b"]["required"]
    (s,) = d.signatures()
    assert s["signer"] == "me" and s["valid"] is None and s["contents_bytes"] == 3
    assert d.info()["form"] == "AcroForm"


def test_attachments_layers_scripts_destinations():
    def extra(w):
        file = w.add(Stream({"Subtype": Name("text/plain"), "Params": {"Size": 4}}, b"data"))
        spec = w.add({"F": b"../../x.txt", "EF": {"F": file}})
        a, b, c = (w.add({"Type": Name("OCG"), "Name": n}) for n in (b"A", b"B", b"C"))
        return {"Names": {"EmbeddedFiles": {"Kids": [w.add({"Names": [b"x", spec]})]}, "JavaScript": {"Names": [b"j", {"S": Name("JavaScript"), "JS": b"app.alert(1)"}]}, "Dests": {"Names": [b"top", [Ref(3, 0), Name("Fit")]]}},
                "OCProperties": {"OCGs": [a, b, c], "D": {"BaseState": Name("OFF"), "ON": [a, b], "OFF": [b], "Locked": [c]}}}
    d = Document(made(extra=extra))
    (file,) = d.attachments()
    assert file["name"] == "../../x.txt" and file["safe_name"] == "x.txt" and file["data"] == b"data"
    assert [(x["name"], x["visible"], x["locked"]) for x in d.layers()] == [("A", True, False), ("B", False, False), ("C", False, True)]
    assert d.javascript() == [("j", "app.alert(1)")] and d.destinations()[0][0] == "top"


def test_annotations_and_action_chains():
    def page(w):
        second = w.add()
        first = w.add({"S": Name("URI"), "URI": b"http://x", "Next": second})
        w.put(second, {"S": Name("JavaScript"), "JS": b"f()", "Next": first})
        return {"Annots": [{"Subtype": Name("Link"), "Rect": [1, 2, 3, 4], "A": first, "NM": b"n", "F": 4}]}
    d = Document(made(page=page))
    (a,) = d.annotations(d.pages[0])
    assert a["subtype"] == "Link" and a["name"] == "n" and [x["kind"] for x in a["actions"]] == ["URI", "JavaScript"] and a["actions"][0]["target"] == "http://x"


def test_images():
    def page(w):
        image = w.add(Stream({"Subtype": Name("Image"), "Width": 2, "Height": 2, "ColorSpace": Name("DeviceRGB"), "BitsPerComponent": 8}, bytes(range(12))))
        return {"Resources": {"XObject": {"I": image}}}
    d = Document(made(page=page))
    (i,) = d.images(d.pages[0], True)
    assert (i["color"], i["components"], i["ratio"], i["data"]) == ("rgb", 3, 100, bytes(range(12)))


def test_split_and_merge_keep_fonts():
    data = build.from_lines([f"line é {k}" for k in range(120)])
    parts = build.split(data)
    assert len(parts) == 3
    d = Document(build.merge(parts))
    text = "\n".join(layout.page_text(TextReader(d, p).run()) for p in d.pages)
    assert text.split("\n") == [f"line é {k}" for k in range(120)]


def test_layout_modes():
    left = [{"seq": k, "text": f"L{k}", "x": 10.0, "x_end": 20.0, "y": 700.0 - 14 * k, "size": 10.0} for k in range(3)]
    right = [{"seq": 3 + k, "text": f"R{k}", "x": 200.0, "x_end": 210.0, "y": 700.0 - 14 * k, "size": 10.0} for k in range(3)]
    assert layout.page_text(left + right, "columns") == "L0\nL1\nL2\n\n--- Column 2 ---\n\nR0\nR1\nR2"
    assert layout.page_text(left + right).split("\n")[0] == "L0 R0"
    assert layout.page_text(left + right, "layout").split("\n")[0] == " L0" + " " * 23 + "R0"
    assert layout.column_bounds([0, 30, 90, 300]) == sorted(layout.column_bounds([0, 30, 90, 300]))
    far = [{"seq": 0, "text": "a", "x": 0.0, "x_end": 5.0, "y": 100.0, "size": 10.0}, {"seq": 1, "text": "b", "x": 0.0, "x_end": 5.0, "y": 60.0, "size": 10.0}]
    assert layout.page_text(far) == "a\n\nb" and layout.page_text([], "flow") == ""
