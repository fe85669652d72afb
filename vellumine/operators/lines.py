"""Lines of documents and what is made of them: kinds, Markdown, HTML, XML, search, words, statistics.

Edge cases: a null text has no lines, an empty one has one blank line; texts of any length are taken whole, though windows
over a document's lines hold its order in one task; repeated documents share an id's lines where a result is by id; an
empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions import text as X


def lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no from 0, line)."""
    return docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def beside(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, line, t, next_t): lines, trimmed, with the next one beside them.

    Neighbours come of the array before it is exploded, so nothing is shuffled.
    """
    parts = docs.select(F.col(doc).alias("doc_id"), F.split(F.col(text), "\n", -1).alias("line"))
    parts = parts.withColumn("t", F.transform("line", lambda c: X.trim(c)))
    rows = parts.select("doc_id", F.posexplode(F.arrays_zip("line", "t", F.slice("t", F.lit(2), F.greatest(F.size("t"), F.lit(0))).alias("next_t"))).alias("line_no", "s"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "s.line", "s.t", "s.next_t")


def variation(doc_id: Column, line_no: Column, line: Column) -> Column:
    """A line as one or two: with a list mark, number or indent, or with a blank or heading line beside it, by a
    rule of document and line. Inputs then hold every kind of line, and every line is whole."""
    k = F.pmod(doc_id * 7 + line_no * 5, F.lit(11))
    marked = F.when(k == 0, F.concat(F.lit("- "), line)).when(k == 1, F.concat(F.lit("• "), line)).when(k == 2, F.concat(F.lit("3) "), line)).when(k == 3, F.concat(F.lit("2.1 "), line)).when(k == 4, F.concat(F.lit("    "), line)).otherwise(line)
    return (
        F.when(k == 5, F.array(marked, F.lit(""))).when(k == 6, F.array(F.translate(F.substring(line, 1, 40), X.LOWER, X.UPPER), marked))
        .when(k == 7, F.array(F.lit(""), F.substring(line, 1, 30), F.lit(""), marked)).otherwise(F.array(marked))
    )


def varied(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents whose lines are varied."""
    parts = F.transform(F.split(F.col(text), "\n", -1), lambda c, i: variation(F.col("doc_id"), i, c))
    return docs.withColumn(text, F.array_join(F.flatten(parts), "\n"))


def _in_order() -> Window:
    return Window.partitionBy("doc_id").orderBy("line_no")


def kinds(rows: DataFrame) -> DataFrame:
    """Lines with ``t`` (trimmed), ``next_t`` and kind: blank, heading, bullet, code or paragraph.

    Rows of ``beside`` have their neighbours and stay where they are; for others a window looks ahead.
    """
    named = rows if "next_t" in rows.columns else rows.withColumn("t", X.trim(F.col("line"))).withColumn("next_t", F.lead("t").over(_in_order()))
    kind = F.when(F.col("t") == "", "blank").when(X.is_heading(F.col("t"), F.col("next_t")), "heading").when(X.is_bullet(F.col("t")), "bullet").when(X.is_code(F.col("line")), "code").otherwise("paragraph")
    return named.withColumn("kind", kind)


def markdown(rows: DataFrame) -> DataFrame:
    """(doc_id, body): Markdown of each document's lines.

    What a line writes depends on the last line that wasn't blank (in a list?), on the last code
    or paragraph line (in a fence?) and on the line before, so windows take the place of a fold.
    """
    w = _in_order()
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    told = kinds(rows).withColumn("last_kind", F.last(F.when(F.col("kind") != "blank", F.col("kind")), ignorenulls=True).over(past))
    # an indented line in a list is a paragraph that ends it
    told = told.withColumn("kind", F.when((F.col("kind") == "code") & (F.col("last_kind") == "bullet"), "paragraph").otherwise(F.col("kind"))).withColumn("next_kind", F.lead("kind").over(w))
    bullet = X.is_bullet(F.col("t"))
    breaks = F.col("next_t").isNotNull() & ((F.col("next_t") == "") | (F.col("next_kind") == "heading") | (X.is_bullet(F.col("next_t")) != bullet))
    after = F.when(F.col("kind") == "blank", True).when(F.col("kind") == "paragraph", breaks).otherwise(False)
    told = (
        told.withColumn("empty", F.coalesce(F.lag(after).over(w), F.lit(True)))
        .withColumn("in_list", F.coalesce(F.last(F.when(F.col("kind") != "blank", F.col("kind") == "bullet"), ignorenulls=True).over(past), F.lit(False)))
        .withColumn("in_code", F.coalesce(F.last(F.when(F.col("kind").isin("code", "paragraph"), F.col("kind") == "code"), ignorenulls=True).over(past), F.lit(False)))
        .withColumn("breaks", breaks)
    )
    if_ = lambda c, s: F.when(c, s).otherwise("")
    paragraph = F.concat(if_(F.col("in_code"), "```\n\n"), if_(F.col("in_list"), "\n"), if_(~F.col("empty"), " "), "t", F.when(F.col("next_t").isNull(), "\n").when(F.col("breaks"), "\n\n").otherwise(""))
    closing = if_(F.col("next_t").isNull() & F.when(F.col("kind") == "code", True).when(F.col("kind") == "paragraph", False).otherwise(F.col("in_code")), "```\n")
    piece = (
        F.when(F.col("kind") == "blank", if_(~F.col("empty") & ~F.col("in_code"), "\n"))
        .when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), X.heading_level(F.col("t"))), F.lit(" "), "t", F.lit("\n\n")))
        .when(F.col("kind") == "bullet", F.concat(if_(~F.col("in_list") & ~F.col("empty"), "\n"), X.list_item(F.col("t")), F.lit("\n")))
        .when(F.col("kind") == "code", F.concat(if_(~F.col("in_code"), "```\n"), "line", F.lit("\n")))
        .otherwise(paragraph)
    )
    return told.withColumn("piece", F.concat(piece, closing)).groupBy("doc_id").agg(joined("piece", "line_no", "").alias("body"))


def joined(what: str, order: str, by: str) -> Column:
    """Strings of a group in order, with a separator."""
    ordered = F.array_sort(F.collect_list(F.struct(order, what)))
    return F.array_join(F.transform(ordered, lambda s: s[what]), by)


def html_paragraphs(rows: DataFrame) -> DataFrame:
    """(doc_id, paragraph, html): blank lines end paragraphs, lines are joined by a blank and escaped."""
    t = rows.withColumn("t", X.trim(F.col("line")))
    island = F.sum(F.when(F.col("t") == "", 1).otherwise(0)).over(_in_order().rowsBetween(Window.unboundedPreceding, 0))
    kept = t.withColumn("paragraph", island.cast("long")).where(F.col("t") != "")
    return kept.groupBy("doc_id", "paragraph").agg(joined("t", "line_no", " ").alias("t")).select("doc_id", "paragraph", F.concat(F.lit("<p>"), X.escape_html(F.col("t")), F.lit("</p>")).alias("html"))


def xml_lines(rows: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """(doc_id, xml): a page element with a text element for each line that isn't blank."""
    kept = rows.withColumn("t", X.trim(F.col("line"))).where(F.col("t") != "").withColumn("x", F.concat(F.lit("<text>"), X.escape_html(F.col("t")), F.lit("</text>")))
    return kept.groupBy("doc_id").agg(F.concat(F.format_string('<page number="1" width="%.2f" height="%.2f">\n', F.lit(width), F.lit(height)), joined("x", "line_no", "\n"), F.lit("\n</page>")).alias("xml"))


def search(rows: DataFrame, needle: str, case_sensitive: bool = False, around: int = 20) -> DataFrame:
    """(doc_id, line_no, at from 0, found, context): every occurrence in a line, overlapping ones too."""
    if not needle:
        return rows.select("doc_id", "line_no", F.lit(0).cast("long").alias("at"), "line", F.col("line").alias("context")).where(F.lit(False)).withColumnRenamed("line", "found")
    wanted = needle if case_sensitive else needle.lower()
    n = len(wanted)
    hay = rows.withColumn("hay", F.col("line") if case_sensitive else X.normalise(F.col("line"))).where(F.contains("hay", F.lit(wanted)))
    # occurrences are counted, overlapping ones too, then each is located from the one before:
    # work grows with the hits of a line, not with its positions (their array is copied for each, so lines of thousands of hits cost more)
    quoted = r"(?=\Q" + wanted.replace("\\E", r"\E\\E\Q") + r"\E)"
    after = lambda found: F.call_function("locate", F.lit(wanted), F.col("hay"), F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(0)) + 1)
    many = F.regexp_count("hay", F.lit(quoted))
    places = F.aggregate(F.sequence(F.lit(1), many), F.array().cast("array<int>"), lambda found, _: F.array_append(found, after(found)))
    hits = hay.select("doc_id", "line_no", "hay", F.explode(places).alias("p"))
    start = F.greatest(F.lit(1), F.col("p") - around)
    return hits.select("doc_id", "line_no", (F.col("p") - 1).cast("long").alias("at"), F.col("hay").substr(F.col("p"), F.lit(n)).alias("found"), F.col("hay").substr(start, F.col("p") + n + around - start).alias("context"))


def words(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos from 0, word): runs without white space."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.select(F.col(doc).alias("doc_id"), F.posexplode(found).alias("pos", "word"))


def statistics(docs: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """Characters, words, lines, CJK and ASCII characters, summed by columns: counted in each row first, then a partial sum."""
    t = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(
        *by, F.length(t).cast("long").alias("chars"), F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"),
        F.regexp_count(t, F.lit(X.CJK)).cast("long").alias("cjk"), F.length(F.regexp_replace(t, r"[^\x00-\x7F]+", "")).cast("long").alias("ascii"))
    return counted.groupBy(*by).agg(F.count(F.lit(1)).alias("docs"), *[F.sum(c).alias(c) for c in ("chars", "words", "lines", "cjk", "ascii")])


def paged(rows: DataFrame, per_page: int = 50) -> DataFrame:
    """(doc_id, pages, body): lines that aren't blank, in pages joined by form feeds."""
    t = rows.withColumn("t", X.trim(F.col("line"))).where(F.col("t") != "")
    numbered = t.withColumn("n", F.row_number().over(_in_order()) - 1)
    pages = numbered.groupBy("doc_id", F.floor(F.col("n") / per_page).cast("long").alias("page")).agg(joined("t", "n", "\n").alias("body"))
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), joined("body", "page", "\f").alias("body"))
