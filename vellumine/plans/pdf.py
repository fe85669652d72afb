"""Round-trip queries: PDF files made of documents, read back as relations, against SQL on the source lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.functions import text as X
from vellumine.operators import lines as L
from vellumine.operators import pdf as P
from vellumine.plans.lines import LINES, MARKDOWN, VARIED, documents, s_bullet, s_caps, s_escape, s_trim
from vellumine.sources import sinks

SHOWN = f"{LINES}, shown AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS n, t FROM (SELECT doc_id, line_no, {s_trim('line')} AS t FROM lines) WHERE t <> '')"


def files(spark, d, compact=False, per_page=50):
    return P.synthesise(documents(spark, d), compact=compact, per_page=per_page)


def q_line_kinds(spark, d):
    """By language, how many lines, headings, list items and characters come out of the files."""
    got = P.relation(P.synthesise(documents(spark, d), carry=("lang",)), "lines", carry=("lang",))
    t = F.col("text")
    return (got.groupBy("lang").agg(
        F.count(F.lit(1)).alias("lines"), F.count(F.when(X.is_all_caps(t), 1)).alias("caps"), F.count(F.when(X.is_bullet(t), 1)).alias("bullets"), F.sum(F.length(t).cast("long")).alias("chars")))


def q_lines(spark, d):
    got = P.relation(files(spark, d, compact=True), "lines")
    return got.select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.col("line_no").cast("long").alias("line_no"), F.col("text").alias("line"))


def q_text(spark, d):
    return P.document_text(P.relation(files(spark, d), "text"))


def q_pages(spark, d):
    got = P.relation(files(spark, d, per_page=5), "pages")
    width, height = F.col("crop.urx") - F.col("crop.llx"), F.col("crop.ury") - F.col("crop.lly")
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.min(P.paper_size(width, height)).alias("paper"))


def q_ops(spark, d):
    return P.relation(files(spark, d), "ops").groupBy("op").agg(F.count(F.lit(1)).alias("n"))


def q_boxes(spark, d):
    got = P.relation(files(spark, d), "lines")
    return got.select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.col("line_no").cast("long").alias("line_no"), F.round("x", 3).alias("x"), F.round("x_end", 3).alias("x_end"), F.round("y", 3).alias("y"))


def q_split_merge(spark, d):
    whole = files(spark, d, per_page=5)
    return P.document_text(P.relation(P.merge(P.split(whole)), "text"))


def q_fonts(spark, d):
    f = P.distinct_fonts(P.relation(files(spark, d, per_page=5), "fonts"))
    return f.groupBy("name", "type", "unicode", "embedded", "subset").agg(F.count(F.lit(1)).alias("docs"))


def q_docs(spark, d):
    got = P.relation(files(spark, d, compact=True), "docs")
    return got.select("doc_id", "version", "n_pages", "encrypted", "form", "optimized", "incremental", "can_print")


def q_page_stats(spark, d):
    got = P.relation(files(spark, d), "page_stats")
    return got.groupBy("doc_id").agg(F.sum("lines").alias("lines"), F.sum("ascii").alias("ascii"), F.sum("wide").alias("wide"))


def q_search(spark, d):
    got = P.relation(files(spark, d), "lines").select("doc_id", (F.col("page_no") * 1000 + F.col("line_no")).cast("long").alias("line_no"), F.col("text").alias("line"))
    return L.search(got, "tion").select("doc_id", "line_no", "at")


def q_markdown(spark, d):
    got = P.relation(files(spark, d), "lines").select("doc_id", (F.col("page_no") * 1000 + F.col("line_no")).cast("long").alias("line_no"), F.col("text").alias("line"))
    return L.markdown(got)


def q_objects(spark, d):
    return P.relation(files(spark, d), "objects").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def q_errors(spark, d):
    """Every third file is cut short, every fifth isn't a PDF."""
    f = files(spark, d)
    broken = F.when(F.col("doc_id") % 3 == 0, F.substring("content", 1, 200)).when(F.col("doc_id") % 5 == 0, F.lit(b"plain text")).otherwise(F.col("content"))
    return P.relation(f.withColumn("content", broken), "errors").select("doc_id", "error")


def q_words(spark, d):
    got = P.relation(files(spark, d), "words")
    return got.select("doc_id", F.col("page_no").cast("long").alias("page_no"), "text", F.round("x_end", 3).alias("x_end"))


def q_mode(mode):
    return lambda spark, d: P.document_text(P.relation(files(spark, d), "text", mode=mode))


def q_column_text(spark, d):
    """Lines shown in one piece stand in one column."""
    return P.document_text(P.relation(P.synthesise(documents(spark, d), kerned=False), "text", mode="columns"))


def q_sizes(spark, d):
    got = P.relation(files(spark, d), "pages")
    w, h = P.pixel_size(F.col("crop.urx") - F.col("crop.llx"), F.col("crop.ury") - F.col("crop.lly"), 150)
    return got.select("doc_id", F.col("page_no").cast("long").alias("page_no"), w.alias("width"), h.alias("height"))


def q_svg(spark, d):
    got = P.relation(files(spark, d), "svg")
    return got.groupBy("doc_id").agg(F.sum(F.regexp_count("svg", F.lit("<text ")).cast("long")).alias("texts"))


def q_html(spark, d):
    """Documents as HTML, a paragraph a run of lines, and Markdown front matter of their languages and sources."""
    body = L.html_paragraphs(L.lines(documents(spark, d))).groupBy("doc_id").agg(L.joined("html", "paragraph", "\n").alias("body"))
    docs = documents(spark, d).select("doc_id", "lang", "source")
    whole = docs.join(body, "doc_id", "left")
    return whole.select("doc_id", F.md5(sinks.html_document(F.col("source"), F.coalesce("body", F.lit("")))).alias("html"), sinks.front_matter(F.col("lang"), F.col("source"), F.lit(None).cast("string")).alias("front"))


def furnished(spark, d):
    """Suppliers, parts and customers are few: every document's id and language make a file with all interactive things."""
    return P.furnish(documents(spark, d).select("doc_id", F.col("lang").alias("title")))


def q_annotations(spark, d):
    got = P.relation(furnished(spark, d), "annotations")
    return got.select("doc_id", F.col("index").cast("long").alias("index"), "subtype", F.element_at("rect", 3).alias("right"), "contents", F.col("flags").cast("long").alias("flags"), F.try_element_at("actions", F.lit(1))["target"].alias("target"))


def q_form_fields(spark, d):
    got = P.relation(furnished(spark, d), "form_fields")
    return got.select("doc_id", "name", "type", "value", F.col("max_len").cast("long").alias("max_len"), "read_only", "required", "no_export")


def q_attachments(spark, d):
    got = P.relation(furnished(spark, d), "attachments")
    return got.select("doc_id", "safe_name", "description", "mime", "size", F.sha2("data", 256).alias("sha256"))


def q_images(spark, d):
    got = P.relation(furnished(spark, d), "images")
    return got.select("doc_id", "name", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "color", F.col("components").cast("long").alias("components"), "n_bytes", "ratio")


def q_placements(spark, d):
    got = P.relation(furnished(spark, d), "placements")
    return got.select("doc_id", "name", *[F.col("matrix")[k].alias(c) for k, c in enumerate("abcdef")])


def q_layers(spark, d):
    got = P.relation(furnished(spark, d), "layers")
    return got.select("doc_id", F.col("index").cast("long").alias("index"), "name", "visible")


def q_names(spark, d):
    f = furnished(spark, d)
    places = P.relation(f, "destinations").select("doc_id", F.lit("destination").alias("kind"), "name", F.regexp_extract("dest", "/(Fit)", 1).alias("what"))
    return places.unionByName(P.relation(f, "javascript").select("doc_id", F.lit("script").alias("kind"), "name", F.col("code").alias("what")))


def q_info(spark, d):
    got = P.relation(furnished(spark, d), "docs")
    return got.select("doc_id", "title", "author", F.date_format(X.pdf_date(F.col("creation_raw")), "yyyy-MM-dd HH:mm:ss").alias("created"), "form", "javascript", "encrypted")


def q_rotated(spark, d):
    got = P.relation(furnished(spark, d), "pages")
    return got.groupBy("rotate").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("media.urx")).alias("width"), F.max(F.col("media.ury")).alias("height"))


def q_attached(spark, d):
    """Files with one more attachment, by incremental update."""
    more = P.attached(files(spark, d).withColumn("name", F.concat(F.lit("extra"), "doc_id", F.lit(".bin"))).withColumn("attachment", F.encode(F.col("doc_id").cast("string"), "UTF-8")))
    got = P.relation(more, "attachments")
    return got.select("doc_id", "safe_name", F.decode("data", "UTF-8").alias("data"))


def q_page_errors(spark, d):
    """Every fourth file has a first page that can't be read: its other pages are, and the fault is told."""
    f = P.synthesise(documents(spark, d), per_page=5)
    return P.relation(P.broken(f.withColumn("break", F.col("doc_id") % 4 == 0)), "errors", reads=("text",)).select("doc_id", "relation", F.col("page_no").cast("long").alias("page_no"))


def q_page_errors_text(spark, d):
    f = P.synthesise(documents(spark, d), per_page=5)
    return P.relation(P.broken(f.withColumn("break", F.col("doc_id") % 4 == 0)), "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.min("page_no").cast("long").alias("first"))


QUERIES = {
    "pdf_annotations": q_annotations, "pdf_form_fields": q_form_fields, "pdf_attachments": q_attachments, "pdf_images": q_images, "pdf_placements": q_placements, "pdf_layers": q_layers, "pdf_names": q_names,
    "pdf_info": q_info, "pdf_rotated_pages": q_rotated, "pdf_attach_file": q_attached, "pdf_page_errors": q_page_errors, "pdf_pages_beside_errors": q_page_errors_text,
    "pdf_words": q_words, "pdf_layout_text": q_mode("layout"), "pdf_column_text": q_column_text, "pdf_flow_text": q_mode("flow"), "pdf_pixel_sizes": q_sizes, "pdf_svg": q_svg, "html_documents": q_html,
    "roundtrip_line_kinds": q_line_kinds, "roundtrip_lines": q_lines, "roundtrip_text": q_text, "roundtrip_pages": q_pages, "roundtrip_operators": q_ops, "roundtrip_boxes": q_boxes,
    "pdf_split_merge": q_split_merge, "pdf_fonts": q_fonts, "pdf_docs": q_docs, "pdf_page_stats": q_page_stats, "pdf_search": q_search, "pdf_markdown": q_markdown, "pdf_objects": q_objects, "pdf_errors": q_errors,
}

TEXT = f"WITH {SHOWN}, p AS (SELECT doc_id, n // PER_PAGE AS page, string_agg(t, chr(10) ORDER BY n) AS body FROM shown GROUP BY ALL) SELECT d.doc_id, coalesce(string_agg(body, chr(12) ORDER BY page), '') AS text FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id GROUP BY d.doc_id"
PAGES_OF_5 = f"WITH {SHOWN}, k AS (SELECT d.doc_id, greatest(1, ceil(count(s.n) / 5.0))::BIGINT AS k FROM documents d LEFT JOIN shown s ON d.doc_id = s.doc_id GROUP BY d.doc_id)"
ORACLE = {
    "pdf_annotations": """SELECT doc_id, 0::BIGINT AS index, 'Link' AS subtype, (110 + doc_id % 50)::DOUBLE AS right, NULL AS contents, 0::BIGINT AS flags, 'https://example.com/' || doc_id AS target FROM documents
UNION ALL SELECT doc_id, 1, 'Text', 220.0::DOUBLE, coalesce(lang, ''), doc_id % 4, NULL FROM documents""",
    "pdf_form_fields": """SELECT doc_id, 'field' || doc_id AS name, 'Tx' AS type, 'value ' || doc_id AS value, doc_id % 100 + 1 AS max_len, doc_id & 1 <> 0 AS read_only, doc_id & 2 <> 0 AS required, doc_id & 4 <> 0 AS no_export FROM documents
UNION ALL SELECT doc_id, 'group' || doc_id || '.below', 'Btn', NULL, NULL, false, false, false FROM documents""",
    "pdf_attachments": "SELECT doc_id, 'notes' || doc_id || '.txt' AS safe_name, 'notes' AS description, 'text/plain' AS mime, length(repeat('attachment of ' || doc_id || chr(10), (doc_id % 5 + 1)::INTEGER))::BIGINT AS size, sha256(repeat('attachment of ' || doc_id || chr(10), (doc_id % 5 + 1)::INTEGER)) AS sha256 FROM documents",
    "pdf_images": "SELECT doc_id, 'Im1' AS name, doc_id % 7 + 1 AS width, 2::BIGINT AS height, ['gray', 'rgb', 'cmyk'][doc_id % 3 + 1] AS color, [1, 3, 4][doc_id % 3 + 1]::BIGINT AS components, (2 * (doc_id % 7 + 1) * [1, 3, 4][doc_id % 3 + 1])::BIGINT AS n_bytes, 100::BIGINT AS ratio FROM documents",
    "pdf_placements": "SELECT doc_id, 'Im1' AS name, (10 * (doc_id % 7 + 1))::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 20.0::DOUBLE AS d, 50.0::DOUBLE AS e, 60.0::DOUBLE AS f FROM documents",
    "pdf_layers": "SELECT doc_id, k AS index, 'layer ' || doc_id || '.' || k AS name, doc_id % 3 <> k AS visible FROM documents, (SELECT unnest(range(3)) AS k)",
    "pdf_names": "SELECT doc_id, 'destination' AS kind, 'place' || doc_id AS name, 'Fit' AS what FROM documents UNION ALL SELECT doc_id, 'script', 'greet', 'app.alert(' || doc_id || ')' FROM documents",
    "pdf_info": "SELECT doc_id, coalesce(lang, '') AS title, 'author ' || doc_id AS author, '2024-01-02 03:04:05' AS created, 'AcroForm' AS form, true AS javascript, false AS encrypted FROM documents",
    "pdf_rotated_pages": "SELECT (90 * (doc_id % 4))::INTEGER AS rotate, count(*) AS n, 300.0::DOUBLE AS width, 400.0::DOUBLE AS height FROM documents GROUP BY 1",
    "pdf_attach_file": "SELECT doc_id, 'extra' || doc_id || '.bin' AS safe_name, doc_id::VARCHAR AS data FROM documents",
    "pdf_page_errors": "SELECT doc_id, 'text' AS relation, 1::BIGINT AS page_no FROM documents WHERE doc_id % 4 = 0",
    "pdf_pages_beside_errors": f"{PAGES_OF_5} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN k - 1 ELSE k END AS pages, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS first FROM k WHERE doc_id % 4 <> 0 OR k > 1",
    "pdf_markdown": MARKDOWN.replace(VARIED, f"{SHOWN}, varied AS (SELECT doc_id, n AS line_no, t AS line FROM shown)"),
    "pdf_objects": f"WITH {SHOWN}, k AS (SELECT greatest(1, ceil(count(s.n) / 50.0))::BIGINT AS k FROM documents d LEFT JOIN shown s ON d.doc_id = s.doc_id GROUP BY d.doc_id) SELECT unnest(['dictionary', 'stream']) AS kind, unnest([sum(k + 4), sum(k + 1)])::BIGINT AS n FROM k",
    "pdf_column_text": TEXT.replace("PER_PAGE", "50"),
    "pdf_flow_text": TEXT.replace("PER_PAGE", "50"),
    "pdf_page_stats": f"WITH {SHOWN} SELECT d.doc_id, count(s.n) AS lines, (coalesce(sum(length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g'))), 0) + count(s.n) FILTER (n % 50 > 0))::BIGINT AS ascii, coalesce(sum(length(t) - length(regexp_replace(t, '{X.CJK}', '', 'g'))), 0)::BIGINT AS wide FROM documents d LEFT JOIN shown s ON d.doc_id = s.doc_id GROUP BY d.doc_id",
    "pdf_words": f"WITH {SHOWN} SELECT doc_id, n // 50 + 1 AS page_no, t AS text, (72 + 6 * length(t))::DOUBLE AS x_end FROM shown",
    "pdf_layout_text": TEXT.replace("PER_PAGE", "50").replace("string_agg(t,", "string_agg(repeat(' ', 9) || t,"),
    "pdf_pixel_sizes": f"WITH {SHOWN}, k AS (SELECT d.doc_id, greatest(1, ceil(count(s.n) / 50.0))::BIGINT AS k FROM documents d LEFT JOIN shown s ON d.doc_id = s.doc_id GROUP BY d.doc_id) SELECT doc_id, unnest(range(1, k + 1)) AS page_no, 1275::BIGINT AS width, 1650::BIGINT AS height FROM k",
    "pdf_svg": f"WITH {SHOWN} SELECT d.doc_id, coalesce(sum(CASE WHEN n % 2 = 1 AND length(t) > 1 THEN 2 WHEN n IS NOT NULL THEN 1 END), 0)::BIGINT AS texts FROM documents d LEFT JOIN shown s ON d.doc_id = s.doc_id GROUP BY d.doc_id",
    "html_documents": f"""WITH {LINES}, trimmed AS (SELECT doc_id, line_no, {s_trim('line')} AS t FROM lines), islands AS (
  SELECT *, sum(CASE WHEN t = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS paragraph FROM trimmed
), j AS (SELECT doc_id, paragraph, '<p>' || {s_escape("string_agg(t, ' ' ORDER BY line_no)")} || '</p>' AS html FROM islands WHERE t <> '' GROUP BY ALL), b AS (SELECT doc_id, string_agg(html, chr(10) ORDER BY paragraph) AS body FROM j GROUP BY doc_id)
SELECT d.doc_id, md5('<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || '<meta charset="UTF-8">' || chr(10) || '<title>' || coalesce(source, '') || '</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || coalesce(body, '') || chr(10) || '</body>' || chr(10) || '</html>' || chr(10)) AS html,
 '---' || chr(10) || 'title: "' || lang || '"' || chr(10) || 'author: "' || source || '"' || chr(10) || '---' || chr(10) || chr(10) AS front FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id""",
    "roundtrip_line_kinds": f"WITH {SHOWN} SELECT lang, count(*) AS lines, count(*) FILTER ({s_caps('t')}) AS caps, count(*) FILTER ({s_bullet('t')}) AS bullets, sum(length(t))::BIGINT AS chars FROM shown JOIN documents USING (doc_id) GROUP BY lang",
    "roundtrip_lines": f"WITH {SHOWN} SELECT doc_id, n // 50 + 1 AS page_no, n % 50 + 1 AS line_no, t AS line FROM shown",
    "roundtrip_text": TEXT.replace("PER_PAGE", "50"),
    "roundtrip_pages": f"WITH {SHOWN} SELECT d.doc_id, greatest(1, ceil(count(s.n) / 5.0))::BIGINT AS pages, 'letter, portrait' AS paper FROM documents d LEFT JOIN shown s ON d.doc_id = s.doc_id GROUP BY d.doc_id",
    "roundtrip_operators": f"""WITH {SHOWN}, pages AS (SELECT d.doc_id, greatest(1, ceil(count(s.n) / 50.0))::BIGINT AS p, count(s.n) AS k FROM documents d LEFT JOIN shown s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
shows AS (SELECT count(*) FILTER (n % 2 = 1 AND length(t) > 1) AS tj, count(*) AS k, count(*) FILTER (n % 50 > 0) AS breaks FROM shown), s AS (SELECT sum(p)::BIGINT AS p FROM pages)
SELECT * FROM (SELECT unnest(['BT', 'ET', 'Tf', 'TL', 'Td', 'T*', 'TJ', 'Tj']) AS op, unnest([p, p, p, p, p, breaks, tj, k - tj]) AS n FROM shows, s) WHERE n > 0""",
    "roundtrip_boxes": f"WITH {SHOWN} SELECT doc_id, n // 50 + 1 AS page_no, n % 50 + 1 AS line_no, 72.0::DOUBLE AS x, (72 + 6 * length(t))::DOUBLE AS x_end, (740 - 14 * (n % 50))::DOUBLE AS y FROM shown",
    "pdf_split_merge": TEXT.replace("PER_PAGE", "5"),
    "pdf_fonts": "SELECT 'Vellum' AS name, 'Type0' AS type, true AS unicode, false AS embedded, false AS subset, count(*) AS docs FROM documents",
    "pdf_docs": f"WITH {SHOWN} SELECT d.doc_id, '1.7' AS version, greatest(1, ceil(count(s.n) / 50.0))::BIGINT AS n_pages, false AS encrypted, 'none' AS form, false AS optimized, false AS incremental, true AS can_print FROM documents d LEFT JOIN shown s ON d.doc_id = s.doc_id GROUP BY d.doc_id",
    "pdf_search": f"""WITH {SHOWN}, h AS (SELECT doc_id, (n // 50 + 1) * 1000 + n % 50 + 1 AS line_no, translate(t, '{X.UPPER}{X.ZERO_WIDTH}', '{X.LOWER}') AS hay FROM shown)
SELECT doc_id, line_no, unnest(list_filter(range(1, length(hay) - 2), lambda i: substr(hay, i, 4) = 'tion')) - 1 AS at FROM h WHERE contains(hay, 'tion')""",
    "pdf_errors": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'no startxref' ELSE 'no %PDF- at the start' END AS error FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0",
}
