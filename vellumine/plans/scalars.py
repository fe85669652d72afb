"""Queries over the star schema and events: dates, paper, geometry, colours, flags, forms' functions, layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.functions import text as X
from vellumine.operators import geometry as G
from vellumine.operators import pdf as P
from vellumine.streaming import ingest


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def q_dates(spark, d):
    """Order dates written as PDF dates, with zones by key and some parts out of range, read back."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey") % 5
    raw = (F.when(k == 0, F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("Z"))).when(k == 1, F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+05'30'")))
           .when(k == 2, F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"))).when(k == 3, F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyy"), F.lit("13"))).otherwise(F.concat(F.date_format("o_orderdate", "yyyyMMddHHmm"), F.lit("-0200"))))
    at = X.pdf_date(raw)
    return o.select("o_orderkey", raw.alias("raw"), F.unix_timestamp(at).alias("epoch"))


S_DATES = """WITH r AS (SELECT o_orderkey, o_orderdate AS t, CASE o_orderkey % 5 WHEN 0 THEN 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') || 'Z' WHEN 1 THEN 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '+05''30'''
 WHEN 2 THEN 'D:' || strftime(o_orderdate, '%Y%m%d') WHEN 3 THEN 'D:' || strftime(o_orderdate, '%Y') || '13' ELSE strftime(o_orderdate, '%Y%m%d%H%M') || '-0200' END AS raw FROM orders)
SELECT o_orderkey, raw, (CASE o_orderkey % 5 WHEN 0 THEN epoch(date_trunc('second', t)) WHEN 1 THEN epoch(date_trunc('second', t)) - 19800 WHEN 2 THEN epoch(date_trunc('day', t)) WHEN 3 THEN NULL ELSE epoch(date_trunc('minute', t)) + 7200 END)::BIGINT AS epoch FROM r"""


def q_paper(spark, d):
    """Sizes about the known ones, by part: some within five points, some turned, some none."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    names = list(P.PAPER.items())
    pick = F.pmod("p_partkey", F.lit(len(names)))
    w = F.coalesce(*[F.when(pick == i, F.lit(float(a))) for i, (_, (a, _)) in enumerate(names)]) + F.pmod("p_size", F.lit(9)) - 2
    h = F.coalesce(*[F.when(pick == i, F.lit(float(b))) for i, (_, (_, b)) in enumerate(names)])
    turned = F.col("p_partkey") % 3 == 0
    sized = p.select("p_partkey", F.when(turned, h).otherwise(w).alias("w"), F.when(turned, w).otherwise(h).alias("h"))
    return sized.groupBy(P.paper_size(F.col("w"), F.col("h")).alias("paper")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("width"))


_N = list(P.PAPER.items())
_CASES = " ".join(f"WHEN (abs(w - {a}) <= 5 AND abs(h - {b}) <= 5) OR (abs(w - {b}) <= 5 AND abs(h - {a}) <= 5) THEN '{n}'" for n, (a, b) in _N)
S_PAPER = f"""WITH s AS (SELECT p_partkey, {list(a for _, (a, _) in _N)}[p_partkey % {len(_N)} + 1]::DOUBLE + p_size % 9 - 2 AS w, {list(b for _, (_, b) in _N)}[p_partkey % {len(_N)} + 1]::DOUBLE AS h FROM part),
t AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN h ELSE w END AS w, CASE WHEN p_partkey % 3 = 0 THEN w ELSE h END AS h FROM s)
SELECT (CASE {_CASES} END) || (CASE WHEN w > h THEN ', landscape' ELSE ', portrait' END) AS paper, count(*) AS n, sum(w) AS width FROM t GROUP BY 1"""


def items(spark, d):
    """Items of made-up pages: x in up to four bands by line number, some pages in one."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    page = F.col("l_orderkey") % 500
    band = F.pmod(F.col("l_linenumber"), F.pmod(page, F.lit(4)) + 1)
    return li.select(page.alias("page"), (F.lit(40.0) + band * 130 + F.pmod("l_partkey", F.lit(3)) * 5).alias("x"), (F.col("l_orderkey") % 50 * 14).alias("y"), F.col("l_partkey").alias("item"))


S_ITEMS = "items AS (SELECT l_orderkey % 500 AS page, 40.0::DOUBLE + (l_linenumber % (l_orderkey % 500 % 4 + 1)) * 130 + l_partkey % 3 * 5 AS x FROM lineitem)"


def q_columns(spark, d):
    i = items(spark, d)
    return G.in_columns(i, G.column_bounds(i)).groupBy("page", "column_no").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x"))


S_COLUMNS = f"""WITH {S_ITEMS}, b AS (SELECT DISTINCT page, round(x / 5) * 5 AS b FROM items), g AS (SELECT page, b AS a, lead(b) OVER (PARTITION BY page ORDER BY b) AS z FROM b), h AS (SELECT * FROM g WHERE z - a >= 20),
m AS (SELECT *, sum(CASE WHEN away < 20 THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY a ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, a - lag(z) OVER (PARTITION BY page ORDER BY a) AS away FROM h)),
w AS (SELECT page, min(a) AS a, max(z) AS z FROM m GROUP BY page, island), k AS (SELECT page, (a + z) / 2 AS cut, row_number() OVER (PARTITION BY page ORDER BY z - a DESC, a) AS k FROM w),
c AS (SELECT page, list(cut ORDER BY cut) AS cuts FROM k WHERE k < 4 GROUP BY page)
SELECT i.page, (1 + coalesce(len(list_filter(c.cuts, lambda v: v <= i.x)), 0))::BIGINT AS column_no, count(*) AS n, min(x) AS x FROM items i LEFT JOIN c ON i.page = c.page GROUP BY ALL"""


def q_words(spark, d):
    """Pieces of lines (line numbers as places) merged into words where the gap allows it."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.lit(0.0).alias("y"), (F.col("l_linenumber") * 10.0).alias("x"), (F.col("l_linenumber") * 10.0 + 6 + F.col("l_partkey") % 5).alias("x_end"), F.lit(10.0).alias("size"), F.col("l_linenumber").cast("string").alias("text"))
    return G.words(li).select("page", F.col("word_no").cast("long").alias("word_no"), "text", "x", "x_end")


S_WORDS = """WITH i AS (SELECT l_orderkey AS page, l_linenumber * 10.0::DOUBLE AS x, l_linenumber * 10.0::DOUBLE + 6 + l_partkey % 5 AS x_end, l_linenumber::VARCHAR AS text FROM lineitem),
g AS (SELECT *, x - lag(x_end) OVER (PARTITION BY page ORDER BY x, x_end, text) AS gap FROM i), n AS (SELECT *, sum(CASE WHEN gap >= 0 AND gap <= 3.0 THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY x, x_end, text ROWS UNBOUNDED PRECEDING)::BIGINT AS word_no FROM g)
SELECT page, word_no, string_agg(text, '' ORDER BY x, x_end, text) AS text, min(x) AS x, max(x_end) AS x_end FROM n GROUP BY page, word_no"""


def q_matrix(spark, d):
    li = table(spark, d, "lineitem")
    q = F.pmod("l_orderkey", F.lit(4))
    m = [F.when(q == 0, 2.0).when(q == 2, -2.0).otherwise(0.0), F.when(q == 1, 2.0).when(q == 3, -2.0).otherwise(0.0), F.when(q == 1, -3.0).when(q == 3, 3.0).otherwise(0.0), F.when(q == 0, 3.0).when(q == 2, -3.0).otherwise(0.0), F.lit(10.0), F.lit(20.0)]
    x, y = G.transformed(m, F.col("l_quantity"), F.col("l_linenumber").cast("double"))
    p = G.placement(m)
    return li.select(x.alias("x"), y.alias("y"), X.rotation(m[0], m[1]).cast("long").alias("turns"), p["scale_x"].alias("sx"), p["scale_y"].alias("sy")).groupBy("turns").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.min("sx").alias("sx"), F.min("sy").alias("sy"))


S_MATRIX = """WITH m AS (SELECT l_quantity AS u, l_linenumber::DOUBLE AS v, l_orderkey % 4 AS q, [2, 0, -2, 0][l_orderkey % 4 + 1]::DOUBLE AS a, [0, 2, 0, -2][l_orderkey % 4 + 1]::DOUBLE AS b, [0, -3, 0, 3][l_orderkey % 4 + 1]::DOUBLE AS c, [3, 0, -3, 0][l_orderkey % 4 + 1]::DOUBLE AS d FROM lineitem)
SELECT q::BIGINT AS turns, count(*) AS n, sum(a * u + c * v + 10) AS x, sum(b * u + d * v + 20) AS y, min(sqrt(a * a + b * b)) AS sx, min(sqrt(c * c + d * d) * CASE WHEN a * d - b * c < 0 THEN -1 ELSE 1 END) AS sy FROM m GROUP BY q"""


def q_cmyk(spark, d):
    p = table(spark, d, "part")
    r, g, b = (F.pmod(F.col("p_partkey") * k, F.lit(5)) / 4 for k in (1, 2, 3))
    c, m, y, k = X.cmyk(r, g, b)
    return p.select("p_partkey", F.round(c, 6).alias("c"), F.round(m, 6).alias("m"), F.round(y, 6).alias("y"), F.round(k, 6).alias("k"))


S_CMYK = """WITH p AS (SELECT p_partkey, (p_partkey % 5) / 4.0::DOUBLE AS r, (p_partkey * 2 % 5) / 4.0::DOUBLE AS g, (p_partkey * 3 % 5) / 4.0::DOUBLE AS b FROM part), q AS (SELECT *, 1 - greatest(r, g, b) AS k FROM p)
SELECT p_partkey, round(CASE WHEN k >= 1 THEN 0 ELSE (1 - r - k) / (1 - k) END, 6) AS c, round(CASE WHEN k >= 1 THEN 0 ELSE (1 - g - k) / (1 - k) END, 6) AS m, round(CASE WHEN k >= 1 THEN 0 ELSE (1 - b - k) / (1 - k) END, 6) AS y, round(k, 6) AS k FROM q"""


def q_permissions(spark, d):
    p = F.col("p_partkey")
    return table(spark, d, "part").groupBy(*[X.permission(p, n).alias(n) for n in ("print", "modify", "copy", "annotate")]).agg(F.count(F.lit(1)).alias("n"))


def q_ratio(spark, d):
    """Compression of made-up images in whole percent, and their native extensions."""
    p = table(spark, d, "part").withColumn("w", F.col("p_size") + 1).withColumn("f", F.element_at(F.array(*map(F.lit, ("DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode", "FlateDecode"))), (F.col("p_partkey") % 5 + 1).cast("int")))
    full = F.expr("(w * w * 3 * 8) div 8")
    return p.groupBy(P.native_extension(F.col("f")).alias("extension")).agg(F.sum(X.compression_ratio(F.col("p_partkey"), F.col("w"), F.col("w"), F.lit(3), F.lit(8))).alias("percent"), F.sum(full).alias("bytes"))


S_RATIO = """SELECT ['jpg', 'jp2', 'tif', 'jb2', 'png'][p_partkey % 5 + 1] AS extension, sum((p_partkey * 100) // (((p_size + 1) * (p_size + 1) * 3 * 8)::BIGINT // 8))::BIGINT AS percent, sum(((p_size + 1) * (p_size + 1) * 3 * 8)::BIGINT // 8)::BIGINT AS bytes FROM part GROUP BY 1"""


def q_validators(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    bare = F.regexp_replace("w", r"[.,;:]+$", "")
    return w.select(bare.alias("w")).groupBy(X.is_number(F.col("w")).alias("number"), X.is_email(F.col("w")).alias("email"), X.is_phone(F.col("w")).alias("phone")).agg(F.count(F.lit(1)).alias("n"))


S_VALIDATORS = f"""WITH w AS (SELECT regexp_replace(unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), '[.,;:]+$', '') AS w FROM documents)
SELECT regexp_matches(w, '{X.NUMBER}') AS number, regexp_matches(w, '{X.EMAIL}') AS email, regexp_matches(w, '{X.PHONE}') AS phone, count(*) AS n FROM w GROUP BY ALL"""


def q_script(spark, d):
    """The script functions on numbers and strings of line items."""
    li = table(spark, d, "lineitem")
    q, p, s = F.col("l_quantity"), F.col("l_extendedprice"), F.concat("l_returnflag", "l_linestatus")
    return li.select(
        "l_orderkey", "l_linenumber", F.abs(q - 25).alias("abs"), F.ceil(p / 1000).cast("long").alias("ceil"), F.floor((q - 25) / 3).cast("long").alias("floor"), F.floor(p / 100 + 0.5).cast("long").alias("round"),
        F.greatest(q, F.col("l_linenumber").cast("double")).alias("max"), F.least(q, F.col("l_linenumber").cast("double")).alias("min"), F.round(F.pow(F.col("l_linenumber").cast("double"), F.lit(2.0)), 6).alias("pow"), F.round(F.sqrt(q), 6).alias("sqrt"),
        F.octet_length(s).cast("long").alias("strlen"), F.substring(s, 2, 1).alias("substr"), (F.instr(s, "F") - 1).cast("long").alias("index_of"), F.lower(s).alias("lower"), F.replace(s, F.lit("O"), F.lit("0")).alias("replaced"), X.to_number(F.col("l_returnflag")).alias("number"))


S_SCRIPT = """SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS abs, ceil(l_extendedprice / 1000)::BIGINT AS ceil, floor((l_quantity - 25) / 3)::BIGINT AS floor, floor(l_extendedprice / 100 + 0.5::DOUBLE)::BIGINT AS round,
 greatest(l_quantity, l_linenumber::DOUBLE) AS max, least(l_quantity, l_linenumber::DOUBLE) AS min, round(pow(l_linenumber::DOUBLE, 2), 6) AS pow, round(sqrt(l_quantity), 6) AS sqrt,
 strlen(s)::BIGINT AS strlen, substr(s, 2, 1) AS substr, (instr(s, 'F') - 1)::BIGINT AS index_of, lower(s) AS lower, replace(s, 'O', '0') AS replaced, coalesce(try_cast(l_returnflag AS DOUBLE), 0.0::DOUBLE) AS number FROM (SELECT *, l_returnflag || l_linestatus AS s FROM lineitem)"""


def q_layers(spark, d):
    """Customers as layers of nations' documents: ON and OFF lists by key; content of hidden ones is left out."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("num"))
    seen = G.visible_layers(c, c.where("num % 3 = 0"), c.where("num % 7 = 0"), base="OFF")
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select(F.col("c_nationkey").alias("doc_id"), F.col("o_custkey").alias("num"), "o_orderkey")
    return G.unhidden(o, seen).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("num").alias("layers"))


S_LAYERS = "SELECT c_nationkey AS doc_id, count(*) AS n, count(DISTINCT o_custkey) AS layers FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 3 = 0 AND o_custkey % 7 <> 0 GROUP BY c_nationkey"


def q_links(spark, d):
    """Words under links: orders as pages, items as words, a link on each whose place follows the customer."""
    li = table(spark, d, "lineitem")
    w = li.select((F.col("l_orderkey") % 200).alias("doc_id"), F.col("l_orderkey").cast("int").alias("page_no"), "l_linenumber", F.col("l_returnflag").alias("text"), (F.col("l_linenumber") * 80.0).alias("x"), (F.col("l_linenumber") * 80.0 + 40).alias("x_end"), (F.pmod("l_partkey", F.lit(50)) * 15.0).alias("y"), F.col("l_linenumber").cast("int").alias("word_no"))
    left = (F.col("o_custkey") % 4) * 100.0
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 200).alias("doc_id"), F.col("o_orderkey").cast("int").alias("page_no"), F.lit(0).alias("index"), F.lit("Link").alias("subtype"), F.array(left, F.lit(100.0), left + 230, F.lit(500.0)).alias("rect"))
    return P.linked_words(w, o).groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n"), F.min("word_no").alias("first"))


S_LINKS = """SELECT doc_id, page_no, count(*) AS n, min(word_no) AS first FROM (SELECT DISTINCT l_orderkey % 200 AS doc_id, l_orderkey::INTEGER AS page_no, l_linenumber::INTEGER AS word_no, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey
 WHERE l_linenumber * 80.0 <= o_custkey % 4 * 100.0 + 230 AND l_linenumber * 80.0 + 40 >= o_custkey % 4 * 100.0 AND (l_partkey % 50) * 15.0 BETWEEN 100 AND 500) GROUP BY ALL"""


def q_windows(spark, d):
    w = ingest.windows(table(spark, d, "events"), "1 hour")
    return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


S_WINDOWS = "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL"


QUERIES = {"pdf_dates": q_dates, "paper_sizes": q_paper, "column_detect": q_columns, "word_grouping": q_words, "matrix_transform": q_matrix, "cmyk_colors": q_cmyk, "permission_bits": q_permissions, "image_ratio": q_ratio, "validators": q_validators, "script_functions": q_script, "layer_visibility": q_layers, "linked_words": q_links, "event_windows": q_windows}
ORACLE = {"pdf_dates": S_DATES, "paper_sizes": S_PAPER, "column_detect": S_COLUMNS, "word_grouping": S_WORDS, "matrix_transform": S_MATRIX, "cmyk_colors": S_CMYK, "permission_bits": "SELECT p_partkey & 4 <> 0 AS print, p_partkey & 8 <> 0 AS modify, p_partkey & 16 <> 0 AS copy, p_partkey & 32 <> 0 AS annotate, count(*) AS n FROM part GROUP BY ALL", "image_ratio": S_RATIO, "validators": S_VALIDATORS, "script_functions": S_SCRIPT, "layer_visibility": S_LAYERS, "linked_words": S_LINKS, "event_windows": S_WINDOWS}
