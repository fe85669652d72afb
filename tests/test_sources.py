"""The PDF data source, sinks and streams over a folder of files."""

import pytest
from pyspark.sql import functions as F

from vellumine.operators import pdf as P
from vellumine.pdf import build
from vellumine.sources import pdf_source, sinks
from vellumine.streaming import ingest


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("pdfs")
    for k in range(3):
        (d / f"{k}.pdf").write_bytes(build.from_lines([f"file {k} line {n}" for n in range(60)], compact=k == 1))
    (d / "bad.pdf").write_bytes(b"nothing")
    return str(d)


def test_data_source(spark, folder):
    pdf_source.register(spark)
    text = spark.read.format("vellumine_pdf").option("path", folder).option("relation", "text").load()
    assert text.count() == 6
    second = text.where("page_no = 2").orderBy("path").collect()
    assert len(second) == 3 and second[0]["text"].startswith("file 0 line 50")
    errors = spark.read.format("vellumine_pdf").option("path", folder).option("relation", "errors").load().collect()
    assert len(errors) == 1 and errors[0]["path"].endswith("bad.pdf")


def test_binary_files(spark, folder):
    got = P.relation(P.read_files(spark, folder), "lines", first=2)
    assert got.count() == 30 and got.agg(F.min("page_no")).first()[0] == 2


@pytest.mark.parametrize("name", [n for n in P.SCHEMAS if n != "errors"])
def test_every_relation(spark, folder, name):
    P.relation(P.read_files(spark, folder), name).count()


def test_streams(spark, folder):
    pages = ingest.text_stream(ingest.once(ingest.arriving(spark, folder)).drop("digest", "seen"))
    q = pages.writeStream.format("memory").queryName("pages_in").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("pages_in").count() == 6


def test_event_windows_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ingest.windows(stream).writeStream.format("memory").queryName("windows_in").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows_in").agg(F.sum("n")).first()[0] == events.count()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("../a.md", "x"), ("b.md", "yy")], "name string, content string")
    written = sinks.write_files(rows, str(tmp_path / "out")).collect()
    assert sorted((r["name"], r["n_bytes"]) for r in written) == [("a.md", 1), ("b.md", 2)]
    assert (tmp_path / "out" / "a.md").read_text() == "x"
    front = spark.range(1).select(sinks.front_matter(F.lit('a "b"'), F.lit(None).cast("string"), F.lit("")).alias("f")).first()["f"]
    assert front == '---\ntitle: "a \\"b\\""\n---\n\n'


def test_image_export(spark):
    rows = spark.createDataFrame([(1, 1, 0, 2, 1, 3, 8, None, bytearray(b"\0\1\2\3\4\5")), (1, 1, 1, 2, 1, 3, 8, "DCTDecode", bytearray(b"jpeg"))], "doc_id long, page_no int, index int, width int, height int, components int, bpc int, filter string, data binary")
    got = {r["index"]: (r["extension"], bytes(r["content"])) for r in sinks.exported(rows).collect()}
    assert got[0][0] == "png" and got[0][1][:4] == b"\x89PNG" and got[1] == ("jpg", b"jpeg")
