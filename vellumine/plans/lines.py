"""Queries over the lines of documents, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.functions import text as X
from vellumine.operators import lines as L


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source")


def varied(spark: SparkSession, d: str) -> DataFrame:
    return L.lines(L.varied(documents(spark, d)))


def varied_beside(spark: SparkSession, d: str) -> DataFrame:
    return L.beside(L.varied(documents(spark, d)))


# --- SQL parts -------------------------------------------------------------------------------

LINES = "lines AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
VARIED = f"""parts AS (
  SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda line, i: CASE (doc_id * 7 + (i - 1) * 5) % 11 WHEN 0 THEN ['- ' || line] WHEN 1 THEN ['• ' || line] WHEN 2 THEN ['3) ' || line] WHEN 3 THEN ['2.1 ' || line]
    WHEN 4 THEN ['    ' || line] WHEN 5 THEN [line, ''] WHEN 6 THEN [translate(substr(line, 1, 40), '{X.LOWER}', '{X.UPPER}'), line] WHEN 7 THEN ['', substr(line, 1, 30), '', line] ELSE [line] END)) AS l FROM documents
), varied AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM parts)"""


def s_trim(c: str) -> str:
    return f"regexp_replace({c}, '^{X.SPACE}+|{X.SPACE}+\\z', '', 'g')"


def s_caps(c: str) -> str:
    return f"(regexp_matches({c}, '[A-Z]') AND NOT regexp_matches({c}, '[a-z]'))"


def s_bullet(c: str) -> str:
    return f"(regexp_matches({c}, '^[{X.BULLETS}*+\\-]') OR regexp_matches({c}, '{X.NUMBERED}'))"


def s_heading(t: str, n: str) -> str:
    return (f"({t} <> '' AND strlen({t}) <= 100 AND (({s_caps(t)} AND strlen({t}) > 3) OR (coalesce({n} = '', false) AND NOT ends_with({t}, '.') AND NOT ends_with({t}, ',') AND strlen({t}) < 80)"
            f" OR regexp_matches({t}, '{X.NUMBERED_HEADING}')))")


def s_level(t: str) -> str:
    return (f"(CASE WHEN regexp_matches({t}, '^\\d+\\.{X.BLANK}+') THEN 1 WHEN regexp_matches({t}, '^\\d+\\.\\d+{X.BLANK}+') THEN 2 WHEN regexp_matches({t}, '^\\d+\\.\\d+\\.\\d+{X.BLANK}+') THEN 3"
            f" WHEN {s_caps(t)} THEN 1 ELSE 2 END)")


def s_item(t: str) -> str:
    return (f"(CASE WHEN regexp_matches({t}, '^[{X.BULLETS}]') THEN '- ' || {s_trim(f'substr({t}, 2)')} WHEN regexp_matches({t}, '{X.NUMBERED}') THEN regexp_replace({t}, '^(\\d+)\\){X.BLANK}+', '\\1. ')"
            f" WHEN regexp_matches({t}, '^[-*+] ') THEN {t} ELSE '- ' || {t} END)")


def s_code(c: str) -> str:
    i = f"regexp_extract({c}, '^[ \\t]*')"
    return f"(length({i}) + 3 * len(regexp_extract_all({i}, '\\t')) >= 4)"


def s_escape(c: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


def s_normal(c: str) -> str:
    return f"translate({c}, '{X.UPPER}{X.ZERO_WIDTH}', '{X.LOWER}')"


KINDS = f"""{VARIED}, trimmed AS (
  SELECT *, {s_trim('line')} AS t FROM varied
), ahead AS (
  SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_t FROM trimmed
), kinds AS (
  SELECT *, CASE WHEN t = '' THEN 'blank' WHEN {s_heading('t', 'next_t')} THEN 'heading' WHEN {s_bullet('t')} THEN 'bullet' WHEN {s_code('line')} THEN 'code' ELSE 'paragraph' END AS kind FROM ahead
)"""

MARKDOWN = f"""WITH {KINDS}, a AS (
  SELECT *, last_value(CASE WHEN kind <> 'blank' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_kind FROM kinds
), b AS (
  SELECT * REPLACE (CASE WHEN kind = 'code' AND last_kind = 'bullet' THEN 'paragraph' ELSE kind END AS kind) FROM a
), c AS (
  SELECT *, lead(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_kind FROM b
), d AS (
  SELECT *, next_t IS NOT NULL AND (next_t = '' OR next_kind = 'heading' OR {s_bullet('next_t')} <> {s_bullet('t')}) AS breaks FROM c
), e AS (
  SELECT *,
    coalesce(lag(CASE kind WHEN 'blank' THEN true WHEN 'paragraph' THEN breaks ELSE false END) OVER (PARTITION BY doc_id ORDER BY line_no), true) AS empty,
    coalesce(last_value(CASE WHEN kind <> 'blank' THEN kind = 'bullet' END IGNORE NULLS) OVER p, false) AS in_list,
    coalesce(last_value(CASE WHEN kind IN ('code', 'paragraph') THEN kind = 'code' END IGNORE NULLS) OVER p, false) AS in_code
  FROM d WINDOW p AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT doc_id, line_no, CASE kind
    WHEN 'blank' THEN CASE WHEN NOT empty AND NOT in_code THEN chr(10) ELSE '' END
    WHEN 'heading' THEN repeat('#', {s_level('t')}) || ' ' || t || chr(10) || chr(10)
    WHEN 'bullet' THEN CASE WHEN NOT in_list AND NOT empty THEN chr(10) ELSE '' END || {s_item('t')} || chr(10)
    WHEN 'code' THEN CASE WHEN NOT in_code THEN '```' || chr(10) ELSE '' END || line || chr(10)
    ELSE CASE WHEN in_code THEN '```' || chr(10) || chr(10) ELSE '' END || CASE WHEN in_list THEN chr(10) ELSE '' END || CASE WHEN NOT empty THEN ' ' ELSE '' END || t
      || CASE WHEN next_t IS NULL THEN chr(10) WHEN breaks THEN chr(10) || chr(10) ELSE '' END
    END || CASE WHEN next_t IS NULL AND CASE kind WHEN 'code' THEN true WHEN 'paragraph' THEN false ELSE in_code END THEN '```' || chr(10) ELSE '' END AS piece FROM e
) SELECT doc_id, string_agg(piece, '' ORDER BY line_no) AS body FROM f GROUP BY doc_id"""

PARAGRAPHS = f"""WITH {VARIED}, trimmed AS (SELECT *, {s_trim('line')} AS t FROM varied), islands AS (
  SELECT *, sum(CASE WHEN t = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS paragraph FROM trimmed
), j AS (SELECT doc_id, paragraph, string_agg(t, ' ' ORDER BY line_no) AS t FROM islands WHERE t <> '' GROUP BY ALL)
SELECT doc_id, paragraph, '<p>' || {s_escape('t')} || '</p>' AS html FROM j"""

STATS = """sum(length(t))::BIGINT AS chars, sum(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')))::BIGINT AS words,
  sum(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END)::BIGINT AS lines, sum(len(regexp_extract_all(t, '[\\x{4E00}-\\x{9FFF}]')))::BIGINT AS cjk,
  sum(length(regexp_replace(t, '[^\\x00-\\x7F]+', '', 'g')))::BIGINT AS ascii"""
TEXTS = "texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents)"


def q_kind_counts(spark, d):
    return L.kinds(varied_beside(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t").cast("long")).alias("chars"))


def q_headings(spark, d):
    k = L.kinds(varied_beside(spark, d)).where(F.col("kind") == "heading")
    return k.select("doc_id", "line_no", X.heading_level(F.col("t")).cast("long").alias("level"), F.col("t").alias("title"))


def q_items(spark, d):
    k = L.kinds(varied_beside(spark, d)).where(F.col("kind") == "bullet")
    return k.select("doc_id", "line_no", X.list_item(F.col("t")).alias("item"))


def q_caps(spark, d):
    v = varied(spark, d)
    return v.where(X.is_all_caps(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def q_hyphens(spark, d):
    rows = L.lines(documents(spark, d)).withColumn("line", F.when(F.col("line_no") % 3 == 0, F.concat("line", F.lit("-"))).when(F.col("line_no") % 3 == 1, F.concat("line", F.lit("­"))).otherwise(F.col("line")))
    return rows.where(X.is_hyphenated(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def q_folds(spark, d):
    t = documents(spark, d)
    return t.select("doc_id", F.md5(X.normalise(F.col("text"))).alias("normal"), F.md5(X.ascii_fold(F.col("text"))).alias("folded"))


def q_escape(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", F.md5(X.escape_html(F.col("html"))).alias("escaped"), F.length(X.escape_html(F.col("html"))).cast("long").alias("chars"))


def q_word_top(spark, d):
    w = documents(spark, d).select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))
    counts = w.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return counts.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 20")


def q_word_list(spark, d):
    w = L.words(documents(spark, d))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("word").alias("kinds"), F.max(F.length("word").cast("long")).alias("longest"))


def q_cjk_runs(spark, d):
    """Runs of CJK and other characters, for the choice of a font: lines get CJK marks by a rule."""
    rows = L.lines(documents(spark, d)).withColumn("line", F.concat(F.lit("漢字"), "line", F.lit("かな"), F.col("line_no").cast("string")))
    runs = F.regexp_extract_all("line", F.lit(rf"{X.CJK_WIDE}+|[^{X.CJK_WIDE[1:]}+"), F.lit(0))
    return rows.select("doc_id", "line_no", F.posexplode(runs).alias("run", "part")).select("doc_id", "line_no", F.col("run").cast("long").alias("run"), "part", F.col("part").rlike(X.CJK_WIDE).alias("is_cjk"))


def q_duplicates(spark, d):
    t = documents(spark, d).where(F.col("text").isNotNull())
    return t.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


QUERIES = {
    "text_lines": lambda s, d: L.lines(documents(s, d)),
    "line_kinds": q_kind_counts,
    "heading_levels": q_headings,
    "list_items": q_items,
    "all_caps_lines": q_caps,
    "hyphenated_lines": q_hyphens,
    "markdown_body": lambda s, d: L.markdown(varied_beside(s, d)),
    "html_paragraphs": lambda s, d: L.html_paragraphs(varied(s, d)),
    "xml_lines": lambda s, d: L.xml_lines(varied(s, d)),
    "html_escape": q_escape,
    "normalise_and_fold": q_folds,
    "search_hits": lambda s, d: L.search(L.lines(documents(s, d)), "Ere"),
    "search_hits_case": lambda s, d: L.search(L.lines(documents(s, d)), "The", True),
    "statistics_by_document": lambda s, d: L.statistics(documents(s, d), "doc_id"),
    "statistics_rollup": lambda s, d: L.statistics(documents(s, d), "lang", "source").rollup("lang", "source").agg(*[F.sum(c).alias(c) for c in ("docs", "chars", "words", "lines", "cjk", "ascii")], F.grouping_id().alias("level")),
    "word_list": q_word_list,
    "word_top": q_word_top,
    "page_breaks": lambda s, d: L.paged(L.lines(documents(s, d)), 5),
    "cjk_runs": q_cjk_runs,
    "exact_duplicates": q_duplicates,
}

ORACLE = {
    "text_lines": f"WITH {LINES} SELECT * FROM lines",
    "line_kinds": f"WITH {KINDS} SELECT kind, count(*) AS n, sum(length(t))::BIGINT AS chars FROM kinds GROUP BY kind",
    "heading_levels": f"WITH {KINDS} SELECT doc_id, line_no, {s_level('t')}::BIGINT AS level, t AS title FROM kinds WHERE kind = 'heading'",
    "list_items": f"WITH {KINDS} SELECT doc_id, line_no, {s_item('t')} AS item FROM kinds WHERE kind = 'bullet'",
    "all_caps_lines": f"WITH {VARIED} SELECT doc_id, count(*) AS n FROM varied WHERE {s_caps('line')} GROUP BY doc_id",
    "hyphenated_lines": f"WITH {LINES} SELECT doc_id, count(*) AS n FROM (SELECT doc_id, CASE line_no % 3 WHEN 0 THEN line || '-' WHEN 1 THEN line || chr(173) ELSE line END AS line FROM lines) WHERE regexp_matches(line, '[-­]\\z') GROUP BY doc_id",
    "markdown_body": MARKDOWN,
    "html_paragraphs": PARAGRAPHS,
    "xml_lines": f"""WITH {VARIED}, trimmed AS (SELECT *, {s_trim('line')} AS t FROM varied)
SELECT doc_id, '<page number="1" width="612.00" height="792.00">' || chr(10) || string_agg('<text>' || {s_escape('t')} || '</text>', chr(10) ORDER BY line_no) || chr(10) || '</page>' AS xml FROM trimmed WHERE t <> '' GROUP BY doc_id""",
    "html_escape": f"SELECT page_id, md5({s_escape('html')}) AS escaped, length({s_escape('html')}) AS chars FROM pages",
    "normalise_and_fold": f"SELECT doc_id, md5({s_normal('text')}) AS normal, md5(regexp_replace(translate({s_normal('text')}, '{X.FOLD_FROM}', '{X.FOLD_TO}'), '[^\\x00-\\x7F]', '', 'g')) AS folded FROM documents",
    "search_hits": f"""WITH {LINES}, hay AS (SELECT doc_id, line_no, {s_normal('line')} AS hay FROM lines), hits AS (
  SELECT doc_id, line_no, hay, unnest(list_filter(range(1, length(hay) - 1), lambda i: substr(hay, i, 3) = 'ere')) AS p FROM hay WHERE contains(hay, 'ere'))
SELECT doc_id, line_no, p - 1 AS at, substr(hay, p, 3) AS found, substr(hay, greatest(1, p - 20), p + 23 - greatest(1, p - 20)) AS context FROM hits""",
    "search_hits_case": f"""WITH {LINES}, hits AS (
  SELECT doc_id, line_no, line, unnest(list_filter(range(1, length(line) - 1), lambda i: substr(line, i, 3) = 'The')) AS p FROM lines WHERE contains(line, 'The'))
SELECT doc_id, line_no, p - 1 AS at, substr(line, p, 3) AS found, substr(line, greatest(1, p - 20), p + 23 - greatest(1, p - 20)) AS context FROM hits""",
    "statistics_by_document": f"WITH {TEXTS} SELECT doc_id, count(*) AS docs, {STATS} FROM texts GROUP BY doc_id",
    "statistics_rollup": f"WITH {TEXTS} SELECT lang, source, count(*) AS docs, {STATS}, grouping(lang, source) AS level FROM texts GROUP BY ROLLUP (lang, source)",
    "word_list": "SELECT doc_id, count(*) AS n, count(DISTINCT word) AS kinds, max(length(word)) AS longest FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word FROM documents) GROUP BY doc_id",
    "word_top": "SELECT lang, word, n, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word FROM documents) GROUP BY ALL)) WHERE place <= 20",
    "page_breaks": f"""WITH {LINES}, t AS (SELECT doc_id, line_no, {s_trim('line')} AS t FROM lines), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS n FROM t WHERE t <> ''),
p AS (SELECT doc_id, n // 5 AS page, string_agg(t, chr(10) ORDER BY n) AS body FROM n GROUP BY ALL) SELECT doc_id, count(*) AS pages, string_agg(body, chr(12) ORDER BY page) AS body FROM p GROUP BY doc_id""",
    "cjk_runs": f"""WITH {LINES}, m AS (SELECT doc_id, line_no, '漢字' || line || 'かな' || line_no::VARCHAR AS line FROM lines),
r AS (SELECT doc_id, line_no, regexp_extract_all(line, '{X.CJK_WIDE}+|[^{X.CJK_WIDE[1:]}+') AS r FROM m), u AS (SELECT doc_id, line_no, unnest(range(len(r))) AS run, unnest(r) AS part FROM r)
SELECT *, regexp_matches(part, '{X.CJK_WIDE}') AS is_cjk FROM u""",
    "exact_duplicates": "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
}
