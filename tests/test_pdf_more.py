"""XFA, certificates, vector and raster output, CID tables, fonts and their matches."""

import datetime

import pytest
from pyspark.sql import functions as F

from vellumine.operators import fonts as FO
from vellumine.operators import pdf as P
from vellumine.pdf import build, der, raster, vector, xfa
from vellumine.pdf.document import Document
from vellumine.pdf.syntax import Name, Stream

FORM = """<xdp:xdp><template><subform name="form1"><field name="a&amp;b"><ui><textEdit/></ui><value><text>&lt;x&gt;</text></value><caption><value><text>First</text></value></caption></field>
<subform name="inner"><field name="pick"><ui><choiceList/></ui><items><text>one</text><text>two</text></items></field></subform></subform></template><xfa:datasets><xfa:data><form1><pick>two</pick></form1></xfa:data></xfa:datasets></xdp:xdp>"""


def test_xfa():
    got = list(xfa.fields(FORM))
    assert [f["path"] for f in got] == ["form1.a&b", "form1.inner.pick"] and got[1]["items"] == ["one", "two"]
    assert xfa.value(FORM, "pick") == "two" and xfa.value(xfa.with_value(FORM, "pick", "<1>"), "pick") == "&lt;1&gt;"
    page = xfa.html(FORM)
    assert "&lt;x&gt;" in page and "<option selected>two</option>" in page and "<x>" not in page
    assert xfa.parsed("<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>") is None


def tlv(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def test_certificates():
    cn = lambda s: tlv(0x30, tlv(0x31, tlv(0x30, tlv(0x06, bytes([0x55, 4, 3])), tlv(0x0C, s.encode()))))
    algorithm = tlv(0x30, tlv(0x06, bytes.fromhex("2A864886F70D01010B")), tlv(0x05))
    body = tlv(0x30, tlv(0xA0, tlv(0x02, b"\x02")), tlv(0x02, b"\x0a\x0b"), algorithm, cn("Issuer"), tlv(0x30, tlv(0x17, b"200102030405Z"), tlv(0x18, b"20300102030405Z")), cn("Sübject"), tlv(0x30, algorithm))
    message = tlv(0x30, tlv(0x06, b"\x2a\x03"), tlv(0xA0, tlv(0x30, tlv(0xA0, tlv(0x30, body, algorithm, tlv(0x03, b"\0sig"))))))
    (c,) = der.certificates(message)
    assert (c["subject"], c["issuer"], c["serial"], c["algorithm"], c["not_before"], c["not_after"]) == ("CN=Sübject", "CN=Issuer", "0a0b", "SHA256-RSA", "2020-01-02T03:04:05Z", "2030-01-02T03:04:05Z")
    assert list(der.certificates(b"\x30\x84\xff\xff\xff\xff")) == [] and list(der.certificates(b"")) == []


@pytest.fixture(scope="module")
def drawn():
    w = build.Writer()
    root, tree, page = w.add(), w.add(), w.add()
    image = w.add(Stream({"Subtype": Name("Image"), "Width": 2, "Height": 1, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}, b"\x00\xff"))
    body = w.add(Stream({}, b"q 1 0 0 RG 2 w 10 10 20 30 re S Q 0 0 1 rg 0 0 m 5 0 l 5 5 l h f* q 40 0 0 20 30 50 cm /I Do Q BT /F 8 Tf 20 70 Td (a<b) Tj ET"))
    w.put(page, {"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, 100, 100], "Contents": body, "Resources": {"XObject": {"I": image}}})
    w.put(tree, {"Type": Name("Pages"), "Kids": [page], "Count": 1})
    w.put(root, {"Type": Name("Catalog"), "Pages": tree})
    return w.finish(root)


def test_vector(drawn):
    d = Document(drawn)
    s = vector.svg(d, d.pages[0])
    assert 'stroke="#ff0000" stroke-width="2"' in s and "M 10 10 L 30 10 L 30 40 L 10 40 Z" in s and 'fill="#0000ff"' in s and "evenodd" in s and "a&lt;b</text>" in s
    p = vector.postscript(d, d.pages[0], True)
    assert p.startswith("%!PS-Adobe-3.0 EPSF-3.0\n%%BoundingBox: 0 0 100 100") and "[40 0 0 20 30 50] concat" in p and "eofill" in p and "(a<b) show" in p


def test_raster(drawn):
    d = Document(drawn)
    x = raster.render(d, d.pages[0], dpi=72)
    assert x.shape == (100, 100, 3) and (x[30:50, 30:50] == 0).all() and (x[30:50, 50:70] == 255).all() and (x[:30] == 255).all()
    assert raster.pixel_size(612, 792) == (1275, 1650) and raster.pixel_size(612, 792, scale_to=100) == (78, 100) and raster.thumbnail_dpi(220) == 20
    siz = b"\xff\x4f\xff\x51\x00\x2f\x00\x00" + b"".join(n.to_bytes(4, "big") for n in (64, 32, 0, 0, 64, 32, 0, 0)) + b"\x00\x03"
    assert raster.jpeg2000_header(b"jp2" + siz) == {"width": 64, "height": 32, "components": 3}


def test_relations_of_drawings(spark, drawn):
    files = spark.createDataFrame([(1, bytearray(drawn))], "doc_id long, content binary")
    assert P.relation(files, "rendered", dpi=36).first()["width"] == 50
    rows = P.relation(files, "pixel_rows", dpi=72).collect()
    assert [(r["y"], r["dark"], r["first_x"], r["last_x"]) for r in rows] == [(y, 20, 30, 49) for y in range(30, 50)]
    assert P.relation(files, "svg").count() == P.relation(files, "postscript").count() == 1


def test_cid_tables(spark, tmp_path):
    (tmp_path / "Adobe-Test1").write_text("0\n41\n4e2d\n")
    w = build.Writer()
    root, tree, page = w.add(), w.add(), w.add()
    below = w.add({"Subtype": Name("CIDFontType0"), "CIDSystemInfo": {"Ordering": b"Test1"}})
    body = w.add(Stream({}, b"BT /F 8 Tf <00010002> Tj ET"))
    w.put(page, {"Type": Name("Page"), "Contents": body, "Resources": {"Font": {"F": w.add({"Subtype": Name("Type0"), "Encoding": Name("Identity-H"), "DescendantFonts": [below]})}}})
    w.put(tree, {"Type": Name("Pages"), "Kids": [page], "Count": 1})
    w.put(root, {"Type": Name("Catalog"), "Pages": tree})
    files = spark.createDataFrame([(1, bytearray(w.finish(root)))], "doc_id long, content binary")
    assert P.relation(files, "text", cid_dir=str(tmp_path)).first()["text"] == "A中"


def test_fonts(spark):
    rows = spark.createDataFrame([("ABCDEF+DejaVuSans-Bold", 0, 0.0, None, None), ("Liberation", 1 << 6, 0.0, 700.0, None), ("Nothing", 0, 0.0, None, 50.0)], "name string, flags int, italic_angle double, weight double, stem_v double")
    s = FO.style(*(F.col(c) for c in rows.columns))
    assert [tuple(r) for r in rows.select(s["bold"], s["italic"]).collect()] == [(True, False), (True, True), (False, False)]
    held = spark.createDataFrame([("dejavusans-bold", "/f/dejavusans-bold.ttf", False), ("dejavusans", "/f/dejavusans.ttf", False), ("liberationserif", "/f/ls.ttf", False)], "name string, path string, cjk boolean")
    got = {r["name"]: (r["path"], r["rank"]) for r in FO.matched(rows, held).collect()}
    assert got == {"ABCDEF+DejaVuSans-Bold": ("/f/dejavusans-bold.ttf", 0), "Liberation": ("/f/ls.ttf", 2), "Nothing": (None, None)}
    assert set(FO.system_fonts(spark).columns) == {"name", "path", "cjk"}


def test_dates(spark):
    from vellumine.functions.text import pdf_date

    rows = spark.createDataFrame([("D:20200102030405+05'30'",), ("D:2020",), ("D:20201301",), ("nonsense",), (None,), ("D:20200102030405Z",)], "s string")
    got = [r[0] for r in rows.select(pdf_date(F.col("s"))).collect()]
    assert got == [datetime.datetime(2020, 1, 1, 21, 34, 5), datetime.datetime(2020, 1, 1), None, None, None, datetime.datetime(2020, 1, 2, 3, 4, 5)]


def test_attach(spark, drawn):
    once = build.attach(drawn, "é.txt", b"one", "text/plain")
    twice = build.attach(once, "b.bin", b"two" * 100)
    assert twice.startswith(once) and once.startswith(drawn)
    d = Document(twice)
    assert {(a["name"], a["data"]) for a in d.attachments()} == {("é.txt", b"one"), ("b.bin", b"two" * 100)} and len(d.pages) == 1
    compact = build.attach(build.from_lines(["x"], compact=True), "c", b"3")
    assert [a["data"] for a in Document(compact).attachments()] == [b"3"]
    files = spark.createDataFrame([(1, bytearray(drawn), "n.txt", bytearray(b"data"))], "doc_id long, content binary, name string, attachment binary")
    assert P.relation(P.attached(files), "attachments").first()["name"] == "n.txt"


def test_tiff():
    import struct

    from vellumine.pdf.images import tiff

    x = tiff(2, 1, 3, bytes(range(6)))
    at = struct.unpack("<I", x[4:8])[0]
    tags = {t: v for t, _, _, v in (struct.unpack("<HHII", x[at + 2 + 12 * k:at + 14 + 12 * k]) for k in range(struct.unpack("<H", x[at:at + 2])[0]))}
    assert tags[256] == 2 and tags[257] == 1 and x[tags[273]:tags[273] + tags[279]] == bytes(range(6)) and struct.unpack("<HHH", x[tags[258]:tags[258] + 6]) == (8, 8, 8)


def test_caps_are_faults(monkeypatch):
    from vellumine.pdf import build, content, der, document, xfa

    many = build.from_lines([f"line {k}" for k in range(120)], per_page=5)
    monkeypatch.setattr(document, "MOST_PAGES", 20)
    with pytest.raises(document.DocumentFault):
        document.Document(many).pages
    monkeypatch.setattr(document, "MOST_PAGES", 200)
    monkeypatch.setattr(document, "MOST_NODES", 10)
    with pytest.raises(document.DocumentFault):
        document.Document(many).pages
    monkeypatch.setattr(content, "MOST_OPERATIONS", 3)
    with pytest.raises(document.DocumentFault):
        list(content.operations(b"q Q q Q q"))
    assert len(list(content.operations(b"q Q q"))) == 3
    monkeypatch.setattr(xfa, "MOST_FIELDS", 1)
    with pytest.raises(ValueError):
        list(xfa.fields('<template><subform name="a"><field name="b"/><field name="c"/></subform></template>'))
    monkeypatch.setattr(der, "MOST_NODES", 2)
    with pytest.raises(ValueError):
        list(der.certificates(bytes.fromhex("30043002300030023000")))


def test_broken_pages_are_told_and_leave_the_others(spark):
    from vellumine.operators import pdf as P
    from vellumine.pdf import build

    whole = build.from_lines([f"line {k}" for k in range(12)], per_page=5)
    files = spark.createDataFrame([(1, whole, "x"), (2, build.broken_page(whole), "y"), (3, b"plain", "z"), (None, None, None)], "doc_id long, content binary, own string")
    text = {(r["doc_id"], r["page_no"]): r["own"] for r in P.relation(files, "text", carry=("own",)).collect()}
    assert text == {(1, 1): "x", (1, 2): "x", (1, 3): "x", (2, 2): "y", (2, 3): "y"}
    told = sorted((r["doc_id"] or 0, r["relation"], r["page_no"], "forms in forms" in r["error"]) for r in P.relation(files, "errors", reads=("text", "pages")).collect())
    assert told == [(0, None, None, False), (2, "text", 1, True), (3, None, None, False)]


def test_hostile_rectangles_make_few_cells(spark):
    from vellumine.operators import pdf as P

    words = spark.createDataFrame([("d", 1, 0, "w", 10.0, 20.0, 30.0)], "doc_id string, page_no int, word_no int, text string, x double, x_end double, y double")
    links = spark.createDataFrame([("d", 1, 0, "Link", [-1e12, -1e12, 1e12, 1e12])], "doc_id string, page_no int, index int, subtype string, rect array<double>")
    assert P.linked_words(words, links).count() == 1


def test_links_meet_words_in_strips_and_are_not_broadcast(spark):
    from vellumine.operators import pdf as P

    spots = [-300.0, -256.0, -1.0, 0.0, 255.9, 256.0, 511.0, 512.0, None]
    words = [("d", k % 2, n, "w", x, None if x is None else x + 40, y) for n, (x, y, k) in enumerate((x, y, k) for x in spots for y in spots for k in range(2))]
    rects = [[0.0, 0.0, 256.0, 256.0], [512.0, 600.0, -256.0, -300.0], [255.9, 255.9, 255.9, 255.9], [-1e12, 256.0, 1e12, 511.0], None]
    links = [("d", k % 2, n, "Link", r) for n, (r, k) in enumerate((r, k) for r in rects for k in range(2))]
    w = spark.createDataFrame(words + words[:50], "doc_id string, page_no int, word_no int, text string, x double, x_end double, y double")
    a = spark.createDataFrame([*links, ("d", 0, 99, "Text", rects[0])], "doc_id string, page_no int, index int, subtype string, rect array<double>")
    under = lambda x, y, r: x <= max(r[0], r[2]) and x + 40 >= min(r[0], r[2]) and min(r[1], r[3]) <= y <= max(r[1], r[3])
    full = sorted((n, i) for _, p, n, _, x, _, y in words for _, q, i, _, r in links if p == q and r and x is not None and y is not None and under(x, y, r))
    met = P.linked_words(w, a)
    assert sorted((r["word_no"], r["link"]) for r in met.collect()) == full and len(full) > 100
    # a row a strip: broadcast, these rows filled the driver, which counts them as one
    plan = met._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and plan.count("explode(") == 1


def test_words_of_odd_rows_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from vellumine.plans import scalars

    keys = [(1, 1, 1), (1, 4, 2), (1, None, 3), (1, 2, 4), (1, 3, None), (1, 4, None), (2, -3, 1), (2, -1, 2), (2, 7, 3), (3, None, 1), (3, 4, 2), (4, 4, None), (4, 4, 1), (4, 4, 2), (None, 4, 1), (None, 4, 2), (None, None, None)]
    keys += [(5, -4, 0), (5, 4, -1), (5, 4, -2), (6, 4, 1), (6, 4, 2), (6, None, 2), (6, 1, 3), (7, None, None), (8, 4, 10), (8, 4, 9), (9, 4, 3), (9, 4, 4), (9, 4, 4), (9, 4, 5)]
    spark.createDataFrame(keys, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect(config={"threads": 1})  # items alike may change places between the SQL's windows where threads share the work
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    rows = lambda got: sorted(map(str, map(tuple, got)))
    assert rows(scalars.q_words(spark, str(tmp_path)).collect()) == rows(c.sql(scalars.S_WORDS).fetchall())


def test_words_do_not_depend_on_the_order_of_items(spark):
    from vellumine.operators import geometry as G

    items = [(1, 0.0, 0.0, 10.0, 10.0, "a"), (1, 0.0, 12.0, 12.0, 10.0, "b"), (1, 0.0, 12.0, 12.0, 1.0, "b")]
    for order in (items, items[::-1]):
        got = G.words(spark.createDataFrame(order, "page int, y double, x double, x_end double, size double, text string").coalesce(1))
        assert sorted(r["text"] for r in got.collect()) == ["a", "bb"]
