"""Mixing sources to target weights by systematic sampling, in native DataFrame operations.

Each document of a source is expected ``r = target / source_size`` times. In an order by size
the expected copies are prefix-summed, one random offset of the source is added, and a document
is emitted once for each integer that the sum passes. As the order is by size, the words taken
differ from the target by less than the longest document.

Scale: no window holds more than ``rows_per_bucket`` rows of documents. Prefix sums have two
levels: counts of buckets (source, size, salt) are summed within a source, ranks are taken within
a bucket. Only buckets over the bound are salted; there are at most rows / rows_per_bucket of them. Salts
follow the id, for null ids a digest of the text; within a bucket ids decide, then what is carried, so reruns agree.
The bound decides which of the documents of one size are taken, never how many words.

Edge cases: null or empty text has size 0; null sources are one source, last in order; a source
without words has target 0 and takes nothing; repeated rows are rows of their own; an empty table
gives no rows; columns other than the three used are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.session import cut

WORDS = r"[^\x20\x09-\x0D]+"
ROWS_PER_BUCKET = 200_000


def word_count(text: Column) -> Column:
    """Words of a text: one more than its inner breaks, after white space is made one kind."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Target words of each source (columns source, source_size), water-filled exactly.

    Shares follow the weights, stop at ``most`` times a source's size, and what is over is shared
    again by weight. In order of size / weight the stopped sources are a prefix; comparisons are in
    exact decimals. One row a source, so windows over all of them are small.
    """
    long = lambda c: c.cast("decimal(38,0)")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("long"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy((F.col("source_size").cast("double") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.select(
        "source", "source_size", "weight",
        F.sum("source_size").over(everything).alias("whole"),
        F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)).alias("stopped"),
        F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("weights"),
    )
    free = long(F.col("source_size") * most) * long(F.col("weights")) > long(F.col("weight")) * long(F.col("whole") - F.col("stopped"))
    level = filled.withColumn("free", free).withColumn("first", F.min(F.when(F.col("free"), F.struct(F.col("source_size").cast("double") / F.col("weight"), "stopped", "weights", "whole"))).over(everything))
    share = F.col("weight") * (F.col("first.whole") - F.col("first.stopped"))
    return level.select("source", "source_size", F.when(F.col("free"), share.cast("double") / F.col("first.weights").cast("double")).otherwise((F.col("source_size") * most).cast("double")).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """The random offset of a source: in 1024ths, so that adding it to a whole number is exact."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit("")))), 1, 4)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(1024)).cast("double") / 1024.0


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix:", rows_per_bucket: int = ROWS_PER_BUCKET, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken (and ``carry``)."""
    own = F.col(source)
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col(text), F.lit(""))), 1, 8), 16, 10).cast("long")
    number = F.coalesce(F.col(doc_id), digest)
    sized = docs.select(F.col(doc_id).alias("doc_id"), number.alias("__number"), F.coalesce(own, F.lit("")).alias("key"), own.isNull().alias("none"), word_count(F.col(text)).alias("size"), *carry)
    sized = sized if carry else cut(sized)  # what is carried may be long: then words are counted twice instead
    named = F.when(~F.col("none"), F.col("key")).alias("source")  # a null source is a key of its own, so that joins and windows share one partitioning
    counts = cut(sized.groupBy("key", "none", "size").agg(F.count(F.lit(1)).alias("n")))
    aims = targets(counts.groupBy("key", "none").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).select(named, "source_size"), weights, most)
    aims = aims.select(F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none"), "source_size", "target")
    # at most rows / rows_per_bucket rows, hence small beside the input
    hot = counts.where(F.col("n") > rows_per_bucket).select("key", "none", "size", F.ceil(F.col("n") / F.lit(rows_per_bucket)).alias("salts"))
    cells, salted, keys = counts.withColumn("salt", F.lit(0).cast("long")), sized, ["key", "none", "size"]
    if not hot.isEmpty():
        keys = [*keys, "salt"]
        salted = sized.join(F.broadcast(hot), ["key", "none", "size"], "left").withColumn("salt", F.coalesce(F.pmod("__number", "salts"), F.lit(0)).cast("long")).drop("salts")
        again = salted.join(F.broadcast(hot), ["key", "none", "size"], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        cells = cells.where(F.col("n") <= rows_per_bucket).unionByName(again)
    upto = Window.partitionBy("key", "none").orderBy("size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    starts = cells.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n").join(aims, ["key", "none"]).withColumn("rate", rate)
    # one shuffle of documents serves the ranks within buckets and the join with the buckets' starts
    inside = Window.partitionBy(*keys).orderBy("doc_id", *([F.xxhash64(*carry)] if carry else []))
    ranked = salted.withColumn("at", F.row_number().over(inside)).join(starts, keys)
    rank = (F.col("before") + F.col("at")).cast("double")
    shift = offset(F.col("key"), seed)
    crossed = F.floor(F.col("rate") * rank + shift) - F.floor(F.col("rate") * (rank - 1) + shift)
    return ranked.withColumn("copies", crossed.cast("long")).select("doc_id", named, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry)


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each copy, numbered from 1 in ``copy``."""
    return mixed.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def op7(spark, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 5, 2, 1 by source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def sql(table: str = "documents", rows_per_bucket: int = ROWS_PER_BUCKET) -> str:
    """DuckDB SQL for op7: the same order, offsets and water-filling."""
    return rf"""
WITH sized AS (
  SELECT doc_id, coalesce(doc_id, ('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT) AS number, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {table}
), counts AS (
  SELECT source, size, count(*) AS n FROM sized GROUP BY ALL
), sources AS (
  SELECT source, sum(size * n)::HUGEINT AS source_size FROM counts GROUP BY ALL
), weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::HUGEINT AS weight FROM sources
), filled AS (
  SELECT *, sum(source_size) OVER () AS whole,
    coalesce(sum(3 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM weighed
), freed AS (
  SELECT *, 3 * source_size * weights > weight * (whole - stopped) AS free FROM filled
), level AS (
  SELECT arg_min(whole - stopped, source_size::DOUBLE / weight) AS rest, arg_min(weights, source_size::DOUBLE / weight) AS weights FROM freed WHERE free
), aims AS (
  SELECT source, source_size, CASE WHEN free THEN (weight * rest)::DOUBLE / level.weights::DOUBLE ELSE (3 * source_size)::DOUBLE END AS target,
    (('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 4))::INTEGER % 1024)::DOUBLE / 1024.0 AS shift
  FROM freed LEFT JOIN level ON true
), ranked AS (
  SELECT s.doc_id, s.source, s.size, row_number() OVER (PARTITION BY s.source ORDER BY s.size,
    CASE WHEN n > {rows_per_bucket} THEN (s.number % ceil(n / {rows_per_bucket}.0)::BIGINT + ceil(n / {rows_per_bucket}.0)::BIGINT) % ceil(n / {rows_per_bucket}.0)::BIGINT ELSE 0 END,
    s.doc_id NULLS FIRST)::DOUBLE AS place
  FROM sized s JOIN counts c ON s.size = c.size AND s.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (copies * size)::BIGINT AS taken, copies FROM (
  SELECT r.doc_id, r.size, a.source_size, a.target,
    (floor(rate * place + shift) - floor(rate * (place - 1) + shift))::BIGINT AS copies
  FROM ranked r JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate FROM aims) a
    ON r.source IS NOT DISTINCT FROM a.source)
"""
