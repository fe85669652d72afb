"""PDF files as relations: one Python step turns a column of bytes into rows, the rest is Spark.

``relation(files, name)`` takes rows of (doc_id, content) and gives one of ``SCHEMAS``. Bytes are
parsed in Arrow batches, and what a relation doesn't need isn't read: page contents and images
are decoded only by the relations that hold them. A file that can't be parsed is a row of the relation
``errors``, never a failed job. So is a page: relations of pages give all rows of a page or none, and ``errors`` names
the pages (or whole files) that the relations of its option ``reads`` leave out, and why.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vellumine.functions import text as X
from vellumine.pdf import build, der, layout, raster, vector, xfa
from vellumine.pdf.content import OPERATORS, TextReader, operations
from vellumine.pdf.document import Document, DocumentFault, Page
from vellumine.pdf.images import png
from vellumine.pdf.syntax import plain, written

BOX = "struct<llx:double,lly:double,urx:double,ury:double>"
SCHEMAS = {
    "docs": "n_bytes long, version string, n_pages long, title string, author string, subject string, keywords string, creator string, producer string, creation_raw string, modified_raw string, custom map<string,string>, encrypted boolean, tagged boolean, form string, javascript boolean, optimized boolean, incremental boolean, can_print boolean, can_modify boolean, can_copy boolean, can_annotate boolean, xmp string",
    "pages": f"page_no int, media {BOX}, crop {BOX}, bleed {BOX}, trim {BOX}, art {BOX}, rotate int, n_content_bytes long",
    "ops": "page_no int, seq long, op string, family string, operands string",
    "items": "page_no int, seq long, text string, x double, y double, x_end double, size double, font string, color array<double>, invisible boolean, matrix array<double>",
    "lines": "page_no int, line_no int, text string, x double, x_end double, y double, size double",
    "words": "page_no int, word_no int, text string, x double, x_end double, y double, size double",
    "text": "page_no int, text string",
    "structured": "page_no int, flows string",
    "page_stats": "page_no int, chars long, words long, lines long, blocks long, flows long, wide long, ascii long",
    "fonts": "page_no int, resource string, name string, type string, descendant string, encoding string, embedded boolean, subset boolean, unicode boolean, flags int, italic_angle double, weight double, stem_v double, num int",
    "images": "page_no int, index int, name string, width int, height int, color string, components int, bpc int, filter string, n_bytes long, ratio long, is_mask boolean, interpolate boolean, intent string, num int",
    "image_data": "page_no int, index int, name string, width int, height int, color string, components int, bpc int, filter string, data binary",
    "placements": "page_no int, name string, matrix array<double>",
    "annotations": "page_no int, index int, subtype string, rect array<double>, contents string, name string, flags int, color array<double>, border double, dest string, actions array<struct<kind:string,target:string>>",
    "form_fields": "name string, parent string, depth int, type string, value string, default string, flags int, read_only boolean, required boolean, no_export boolean, max_len int, rect array<double>, options array<string>",
    "attachments": "name string, safe_name string, description string, mime string, size long, created string, modified string, data binary",
    "signatures": "field string, filter string, sub_filter string, signer string, reason string, location string, contact string, signed string, byte_range array<long>, covers_all boolean, contents_bytes long, valid boolean",
    "layers": "index int, num int, name string, visible boolean, locked boolean, intent string, print_state string, view_state string, export_state string, radio_group int",
    "destinations": "name string, dest string",
    "javascript": "name string, code string",
    "xref": "obj_num int, kind string, a long, b long",
    "objects": "obj_num int, gen int, kind string, value string",
    "xfa": "data string",
    "xfa_fields": "name string, path string, ui string, value string, caption string, items array<string>, access string",
    "certificates": "field string, subject string, issuer string, serial string, algorithm string, not_before string, not_after string, sha256 string, n_bytes int",
    "svg": "page_no int, svg string",
    "postscript": "page_no int, postscript string",
    "rendered": "page_no int, width int, height int, png binary",
    "pixel_rows": "page_no int, y int, dark long, first_x int, last_x int",
    "errors": "relation string, page_no int, error string",
}


def cid_tables(folder: str) -> dict[str, list[int]]:
    """Unicode by CID for each ordering, of a folder of tables: a hexadecimal code point a line, the line's number its CID.

    The tables have licences of their own, so their folder is an option and they aren't kept here.
    """
    out = {}
    for p in sorted(Path(folder).glob("Adobe-*")):
        out[p.name.removeprefix("Adobe-")] = [int(x, 16) if x.strip() else 0 for x in p.read_text().split("\n")]
    return out


def _box(b: tuple) -> dict:
    return dict(zip(("llx", "lly", "urx", "ury"), b, strict=True))


def _docs(d: Document) -> Iterator[dict]:
    i = d.info()
    yield {**i, "n_bytes": len(d.data), "creation_raw": i["creationdate"], "modified_raw": i["moddate"], "custom": list(i["custom"].items()), **{f"can_{k}": v for k, v in i["permissions"].items()}, "xmp": d.metadata()}


#: Relations that are read page by page.
PAGED = frozenset("pages ops items lines words text structured page_stats fonts images image_data placements annotations svg postscript rendered pixel_rows".split())
#: Relations whose faults ``errors`` tells unless it is asked for others.
READS = ("text",)


def parts_of(d: Document, name: str, pages: list[Page], options: dict) -> Iterator[tuple[list[dict], dict | None]]:
    """The rows of a relation, page by page where it has pages; in place of rows that can't be read, a row of ``errors``."""
    own = options | {"fonts": {}}
    for part in [[p] for p in pages] if name in PAGED else [pages]:
        try:
            yield list(rows_of(d, name, part, own)), None
        except Exception as e:  # a hostile page is a row of errors, not a failed task
            yield [], {"relation": name, "page_no": part[0].number if name in PAGED else None, "error": told(e)}


def told(e: Exception) -> str:
    return str(e) if isinstance(e, DocumentFault) else f"{type(e).__name__}: {e}"[:500]


def file_rows(data: bytes, name: str, options: dict, first: int = 1, last: int = 0) -> Iterator[list[dict]]:
    """The rows of a relation of one file, in parts; of ``errors``, what the relations ``reads`` can't read."""
    try:
        d = Document(data, options.get("password", ""))
        pages = d.pages[max(1, first) - 1:last if last > 0 else None]
    except Exception as e:  # a hostile file is a row of errors, not a failed task
        if name == "errors":
            yield [{"error": told(e)}]
        return
    reads = options.get("reads") or READS
    for own in (reads.split(",") if isinstance(reads, str) else reads) if name == "errors" else (name,):
        for rows, fault in parts_of(d, own, pages, options):
            yield ([fault] if fault else []) if name == "errors" else rows


def rows_of(d: Document, name: str, pages: list[Page], options: dict) -> Iterator[dict]:
    """The rows of one relation of a document."""
    if name == "docs":
        yield from _docs(d)
    elif name == "pages":
        for p in pages:
            yield {"page_no": p.number, **{k: _box(b) for k, b in p.boxes().items()}, "rotate": p.rotate(), "n_content_bytes": len(p.contents())}
    elif name == "ops":
        for p in pages:
            for n, (op, x) in enumerate(operations(p.contents())):
                yield {"page_no": p.number, "seq": n, "op": op, "family": OPERATORS.get(op), "operands": json.dumps([written(v) if isinstance(v, (bytes, str)) else plain(v) for v in x], ensure_ascii=False)}
    elif name in ("items", "lines", "words", "text", "structured", "page_stats", "placements"):
        fonts: dict = options.get("fonts", {})
        for p in pages:
            reader = TextReader(d, p, options.get("cid_text"), fonts)
            yield from _text_rows(reader, reader.run(), name, p, options)
    elif name in ("fonts", "annotations"):
        for p in pages:
            yield from getattr(d, name)(p)
    elif name in ("images", "image_data"):
        for p in pages:
            yield from d.images(p, name == "image_data")
    elif name in ("form_fields", "attachments", "signatures", "layers"):
        yield from getattr(d, name)()
    elif name == "destinations":
        yield from ({"name": k, "dest": v} for k, v in d.destinations())
    elif name == "javascript":
        yield from ({"name": k, "code": v} for k, v in d.javascript())
    elif name == "xref":
        yield from ({"obj_num": k, "kind": v[0], "a": v[1], "b": v[2]} for k, v in sorted(d.table.items()))
    elif name == "objects":
        yield from ({"obj_num": n, "gen": g, "kind": k, "value": json.dumps(plain(v), ensure_ascii=False)} for n, g, k, v in d.objects())
    elif name == "xfa_fields":
        data = d.xfa()
        yield from xfa.fields(data.decode("utf-8", "replace")) if data is not None else ()
    elif name == "certificates":
        for f in d.form_fields():
            blob = (f["signature"] or {}).get("Contents") if f["type"] == "Sig" else None
            yield from ({"field": f["name"], **c} for c in der.certificates(blob)) if isinstance(blob, bytes) else ()
    elif name == "svg":
        yield from ({"page_no": p.number, "svg": vector.svg(d, p)} for p in pages)
    elif name == "postscript":
        yield from ({"page_no": p.number, "postscript": vector.postscript(d, p, options.get("eps", False))} for p in pages)
    elif name in ("rendered", "pixel_rows"):
        for p in pages:
            x = raster.render(d, p, float(options.get("dpi", 150)), int(options.get("scale_to", 0)))
            if name == "rendered":
                yield {"page_no": p.number, "width": x.shape[1], "height": x.shape[0], "png": png(x.shape[1], x.shape[0], 3, x.tobytes())}
            else:
                dark = (x < 10).all(axis=2)
                for y in dark.any(axis=1).nonzero()[0].tolist():
                    at = dark[y].nonzero()[0]
                    yield {"page_no": p.number, "y": y, "dark": len(at), "first_x": int(at[0]), "last_x": int(at[-1])}
    elif name == "xfa":
        data = d.xfa()
        if data is not None:
            yield {"data": data.decode("utf-8", "replace")}


def _text_rows(reader: TextReader, items: list[dict], name: str, p: Page, options: dict) -> Iterator[dict]:
    if name == "items":
        for i in items:
            yield {"page_no": p.number, **i, "color": list(i["color"]), "matrix": list(i["matrix"])}
    elif name == "lines":
        for n, line in enumerate(layout.cluster(items, options.get("policy", "last_font")), 1):
            yield {"page_no": p.number, "line_no": n, **line}
    elif name == "words":
        for n, w in enumerate(layout.words_of(items), 1):
            yield {"page_no": p.number, "word_no": n, **w}
    elif name == "text":
        yield {"page_no": p.number, "text": layout.page_text(items, options.get("mode", "default"), options.get("policy", "last_font"))}
    elif name == "structured":
        yield {"page_no": p.number, "flows": json.dumps(layout.structured(items), ensure_ascii=False)}
    elif name == "page_stats":
        yield {"page_no": p.number, **layout.counts(layout.page_text(items), layout.blocks_of(items))}
    elif name == "placements":
        yield from ({"page_no": p.number, "name": i["name"], "matrix": list(i["matrix"])} for i in reader.images)


#: Rows of output that are gathered before they go to Spark.
ROWS = 5_000


def relation(files: DataFrame, name: str, doc_id: str = "doc_id", content: str = "content", first: int = 1, last: int = 0, carry: tuple[str, ...] = (), **options: Any) -> DataFrame:
    """A relation of the files, keyed by their id, with columns of the files ``carry``. Pages from ``first`` to ``last`` (0: the end).

    Edge cases: null or empty content is a file that can't be parsed; repeated rows give their rows again; a null
    id stays null; an empty table gives no rows; other columns are left out."""
    schema = T.StructType([T.StructField("doc_id", files.schema[doc_id].dataType), *T._parse_datatype_string(SCHEMAS[name]).fields, *(files.schema[c] for c in carry)])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in T._parse_datatype_string(SCHEMAS[name]).fields]
    cid_dir = options.pop("cid_dir", None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_options = options | ({"cid_text": cid_tables(cid_dir)} if cid_dir else {})
        held: list[dict] = []
        owners: list[int] = []

        def out(b: pa.RecordBatch) -> pa.RecordBatch:
            at = pa.array(owners, pa.int32())
            kept = {c: b.column(c).take(at) for c in ("doc_id", *carry)}
            made = [pa.array([r.get(n) for r in held], type=arrow.field(n).type) for n in names]
            held.clear()
            owners.clear()
            return pa.RecordBatch.from_arrays([kept["doc_id"], *made, *(kept[c] for c in carry)], schema=arrow)

        for b in batches:
            for k in range(b.num_rows):
                for rows in file_rows(b.column("content")[k].as_py() or b"", name, own_options, first, last):
                    held += rows
                    owners += [k] * len(rows)
                    if len(held) >= ROWS:
                        yield out(b)
            if held:
                yield out(b)

    return files.select(F.col(doc_id).alias("doc_id"), F.col(content).alias("content"), *carry).mapInArrow(run, schema)


def made(fn: Callable[[Any], Any], argument: Column, kind: str) -> Column:
    """A column of bytes made from a column by an Arrow-batched function."""

    def apply(values: pd.Series) -> pd.Series:
        return values.map(fn)

    return F.pandas_udf(apply, kind)(argument)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where an input has fewer splits than they are; a large input has enough and isn't shuffled."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * n) if df.rdd.getNumPartitions() < 2 * n else df


def synthesise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", compact: bool = False, per_page: int = build.PER_PAGE, carry: tuple[str, ...] = (), kerned: bool = True) -> DataFrame:
    """(doc_id, content) and columns ``carry``: a PDF of each text, a line for each of its lines that isn't blank."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda s: X.trim(s)), lambda s: s != "")
    return spread(docs.select(F.col(doc_id).alias("doc_id"), lines.alias("lines"), *carry)).select("doc_id", *carry, made(lambda x: build.from_lines(list(x), per_page=per_page, compact=compact, kerned=kerned), F.col("lines"), "binary").alias("content"))


def furnish(docs: DataFrame, doc_id: str = "doc_id", title: str = "title") -> DataFrame:
    """(doc_id, content): for each row a PDF with links, notes, fields, an attachment, an image, layers, a destination and a script, by its id."""
    parts = F.struct(F.col(doc_id).cast("long").alias("number"), F.col(title).alias("title"))

    def apply(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([build.furnished(int(n), t or "") for n, t in zip(rows["number"], rows["title"], strict=True)])

    return spread(docs.select(doc_id, title)).select(F.col(doc_id).alias("doc_id"), F.pandas_udf(apply, "binary")(parts).alias("content"))


def broken(files: DataFrame) -> DataFrame:
    """Files of which those with ``break`` name a first page's contents that hold a form within itself: such a page can't be read."""
    return files.select("doc_id", F.when(F.col("break"), made(build.broken_page, F.col("content"), "binary")).otherwise(F.col("content")).alias("content"))


def split(files: DataFrame, first: int = 1, last: int = 0) -> DataFrame:
    """(doc_id, page_no, content): each page a file."""
    parts = made(lambda data: build.split(data, first, last), F.col("content"), "array<binary>")
    return files.select("doc_id", F.posexplode(parts).alias("page_no", "content")).withColumn("page_no", F.col("page_no") + max(1, first))


def attached(files: DataFrame, name: str = "name", attachment: str = "attachment") -> DataFrame:
    """(doc_id, content): files with a file attached, from columns of its name and bytes."""
    parts = F.struct(F.col("content").alias("content"), F.col(name).alias("name"), F.col(attachment).alias("data"))

    def apply(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([build.attach(c, n, d or b"") for c, n, d in zip(rows["content"], rows["name"], rows["data"], strict=True)])

    return files.select("doc_id", F.pandas_udf(apply, "binary")(parts).alias("content"))


def merge(files: DataFrame, by: str = "doc_id", order: str = "page_no") -> DataFrame:
    """(by, content): the files of a group as one, in order. A group's files meet in one task, as they do in the file."""
    gathered = files.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "content"))).alias("parts"))
    return gathered.select(by, made(lambda parts: build.merge(list(parts)), F.transform("parts", lambda s: s["content"]), "binary").alias("content"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content, n_bytes) of PDF files under a path: Spark lists and splits them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select(F.col("path").alias("doc_id"), "content", F.col("length").alias("n_bytes"))


def document_text(pages: DataFrame, separator: str = "\f") -> DataFrame:
    """(doc_id, text): pages on end, a separator between."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), separator).alias("text"))


#: Paper sizes in points (fixed values).
PAPER = {"letter": (612, 792), "legal": (612, 1008), "A3": (842, 1191), "A4": (595, 842), "A5": (420, 595), "B5": (499, 709), "executive": (522, 756), "tabloid": (792, 1224)}


def paper_size(width: Column, height: Column, within: float = 5.0) -> Column:
    """``name, portrait`` or ``name, landscape`` of the first size within five points, else null."""
    hits = []
    for name, (w, h) in PAPER.items():
        upright = (F.abs(width - w) <= within) & (F.abs(height - h) <= within)
        turned = (F.abs(width - h) <= within) & (F.abs(height - w) <= within)
        hits.append(F.when(upright | turned, F.lit(name)))
    return F.concat(F.coalesce(*hits), F.when(width > height, ", landscape").otherwise(", portrait"))


def pixel_size(width: Column, height: Column, dpi: float = 150.0) -> tuple[Column, Column]:
    """Pixels of a page at a resolution, rounded up."""
    return tuple(F.greatest(F.lit(1), F.ceil(side * dpi / 72 - 1e-9)).cast("long") for side in (width, height))


def distinct_fonts(fonts: DataFrame) -> DataFrame:
    """Fonts of documents once by name and type, at their first page."""
    return fonts.groupBy("doc_id", "name", "type").agg(F.min("page_no").alias("first_page"), F.max("embedded").alias("embedded"), F.max("subset").alias("subset"), F.max("unicode").alias("unicode"))


def native_extension(name: Column) -> Column:
    return F.when(name == "DCTDecode", "jpg").when(name == "JPXDecode", "jp2").when(name == "CCITTFaxDecode", "tif").when(name == "JBIG2Decode", "jb2").otherwise("png")


#: Points that a page's side has at most.
REACH = 14_400.0


def linked_words(words: DataFrame, annotations: DataFrame, strip: float = 256.0) -> DataFrame:
    """Words under link annotations: a range join by strips of the page, so equal keys meet and nothing is crossed.

    A word has a base line and so one strip; only links are repeated, a row for each strip they cross. The planner
    doesn't count those rows and takes the links for small enough to broadcast: the sides are merged instead.
    """
    w = words.where(F.greatest(F.abs("x"), F.abs("x_end"), F.abs("y")) <= REACH).select("doc_id", "page_no", "word_no", "text", "x", "x_end", "y", F.floor(F.col("y") / strip).alias("strip_no"))
    a = annotations.where("subtype = 'Link' AND rect IS NOT NULL").select("doc_id", "page_no", F.col("index").alias("link"), F.least(F.col("rect")[0], F.col("rect")[2]).alias("l"), F.greatest(F.col("rect")[0], F.col("rect")[2]).alias("r"), F.least(F.col("rect")[1], F.col("rect")[3]).alias("b"), F.greatest(F.col("rect")[1], F.col("rect")[3]).alias("t"))
    # no page is larger: a hostile rectangle makes as many strips as a page has, not more
    a = a.select("doc_id", "page_no", "link", *[F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.col(c))).alias(c) for c in "lrbt"])
    a = a.withColumn("strip_no", F.explode(F.sequence(F.floor(F.col("b") / strip), F.floor(F.col("t") / strip))))
    met = w.join(a.hint("merge"), ["doc_id", "page_no", "strip_no"]).where("x <= r AND x_end >= l AND y BETWEEN b AND t")
    return met.select("doc_id", "page_no", "link", "word_no", "text").distinct()
