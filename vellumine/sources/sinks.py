"""Writers of what documents become: text, Markdown, HTML and XML files, attachments and images by executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.text import escape_html
from vellumine.pdf.images import png, pnm, tiff
from vellumine.sources.pdf_source import open_path


def front_matter(title: Column, author: Column, subject: Column) -> Column:
    """Markdown front matter where any of the three is there; quotes escaped."""
    line = lambda k, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f'{k}: "'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"\n'))).otherwise("")
    body = F.concat(line("title", title), line("author", author), line("subject", subject))
    return F.when(body != "", F.concat(F.lit("---\n"), body, F.lit("---\n\n"))).otherwise("")


def html_document(title: Column, body: Column) -> Column:
    return F.concat(F.lit('<!DOCTYPE html>\n<html>\n<head>\n<meta charset="UTF-8">\n<title>'), escape_html(F.coalesce(title, F.lit(""))), F.lit("</title>\n</head>\n<body>\n"), body, F.lit("\n</body>\n</html>\n"))


def write_files(rows: DataFrame, where: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write each row's text or bytes as a file of its own; (name, n_bytes) of each.

    Names lose folders and odd characters. A file is written under another name first and
    moved, so a task that is run again leaves whole files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_path(where)
        fs.create_dir(base, recursive=True)
        for b in batches:
            names, sizes = [], []
            for own, data in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                safe = "".join(c if c.isalnum() or c in "._- " else "_" for c in own.replace("\\", "/").split("/")[-1]).strip(". ") or "file"
                with fs.open_output_stream(f"{base}/.{safe}.part") as f:
                    f.write(data or b"")
                fs.move(f"{base}/.{safe}.part", f"{base}/{safe}")
                names.append(safe)
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "n_bytes"])

    return rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "name string, n_bytes long")


def exported(images: DataFrame, kind: str = "png") -> DataFrame:
    """(doc_id, page_no, index, extension, content): images as PNG, PNM or TIFF, or in their own format where they have one."""
    from vellumine.operators.pdf import native_extension

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, h, n, bpc, own, data in zip(*(b.column(c).to_pylist() for c in ("width", "height", "components", "bpc", "extension", "data")), strict=True):
                if data is None or own != "png":
                    out.append(data)
                    continue
                if bpc == 1:
                    row = (w * n + 7) // 8
                    data = bytes(255 * (data[y * row + x // 8] >> (7 - x % 8) & 1) for y in range(h) for x in range(w * n) if y * row + x // 8 < len(data))
                if n == 4:
                    data = bytes(255 - min(255, data[k + c] + data[k + 3]) for k in range(0, len(data) - 3, 4) for c in range(3))
                    n = 3
                out.append({"png": png, "pnm": pnm, "tiff": tiff}[kind](w, h, 3 if n >= 3 else 1, data))
            at = b.schema.get_field_index("data")
            yield b.set_column(at, "data", pa.array(out, pa.binary())).select(["doc_id", "page_no", "index", "extension", "data"])

    named = images.withColumn("extension", native_extension(F.col("filter"))).select("doc_id", "page_no", "index", "width", "height", "components", "bpc", "extension", "data")
    kept = named.select("doc_id", "page_no", "index", "extension", "data").schema
    return named.mapInArrow(convert, kept).withColumnRenamed("data", "content")
