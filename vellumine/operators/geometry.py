"""Geometry of items as relations: columns, words and layers by windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_bounds(items: DataFrame, page: str = "page", x: str = "x", bucket: float = 5.0, least: float = 20.0, most: int = 4) -> DataFrame:
    """(page, column_no, start, stop): columns between the widest gaps of occupied buckets.

    Distinct buckets are few a page, so windows work on them, not on items.
    """
    held = items.select(F.col(page).alias("page"), (F.round(F.col(x) / bucket) * bucket).alias("b")).distinct()
    w = Window.partitionBy("page").orderBy("b")
    gaps = held.withColumn("next", F.lead("b").over(w)).where(F.col("next") - F.col("b") >= least).select("page", F.col("b").alias("a"), F.col("next").alias("z"))
    # gaps closer than ``least`` are one: islands of gaps
    o = Window.partitionBy("page").orderBy("a")
    new = F.when(F.col("a") - F.lag("z").over(o) < least, 0).otherwise(1)
    merged = gaps.withColumn("new", new).withColumn("island", F.sum("new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    whole = merged.groupBy("page", "island").agg(F.min("a").alias("a"), F.max("z").alias("z"))
    widest = whole.withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy(F.desc(F.col("z") - F.col("a")), "a"))).where(F.col("k") < most)
    cuts = widest.groupBy("page").agg(F.array_sort(F.collect_list((F.col("a") + F.col("z")) / 2)).alias("cuts"))
    pages = held.select("page").distinct().join(cuts, "page", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))
    edges = F.concat(F.array(F.lit(float("-inf"))), "cuts", F.array(F.lit(float("inf"))))
    spans = pages.select("page", F.posexplode(F.zip_with(F.slice(edges, 1, F.size("cuts") + 1), F.slice(edges, 2, F.size("cuts") + 1), lambda a, b: F.struct(a.alias("start"), b.alias("stop")))).alias("column_no", "s"))
    return spans.select("page", (F.col("column_no") + 1).cast("long").alias("column_no"), "s.start", "s.stop")


def in_columns(items: DataFrame, bounds: DataFrame, page: str = "page", x: str = "x") -> DataFrame:
    """Items with the number of their column: an equi-join by page, a page having four columns at most."""
    return items.join(bounds.withColumnRenamed("page", "__page"), (F.col(page) == F.col("__page")) & (F.col(x) >= F.col("start")) & (F.col(x) < F.col("stop"))).drop("__page", "start", "stop")


def words(items: DataFrame, page: str = "page", base: str = "y", x: str = "x", end: str = "x_end", text: str = "text", within: float = 0.3, size: str = "size") -> DataFrame:
    """(page, base, word_no, text, x, x_end): items merged where the gap is 0 to ``within`` of the size.

    Items without a place come last, each a word; items of one place, end and text go by size. A word without any text has null.
    """
    w = Window.partitionBy(page, base).orderBy(*[F.col(c).asc_nulls_last() for c in (x, end, text, size)])
    gap = F.col(x) - F.lag(end).over(w)
    broken = F.when((gap >= 0) & (gap <= F.col(size) * within), 0).otherwise(1)
    numbered = items.withColumn("__broken", broken).withColumn("__at", F.row_number().over(w)).withColumn("word_no", F.sum("__broken").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("__at", text)))
    return numbered.groupBy(page, base, "word_no").agg(F.when(F.count(text) > 0, F.array_join(F.transform(ordered, lambda s: s[text]), "")).alias("text"), F.min(x).alias("x"), F.max(end).alias("x_end"))


def visible_layers(layers: DataFrame, on: DataFrame, off: DataFrame, base: str = "ON") -> DataFrame:
    """Layers with their visibility: OFF wins over ON, and ON over the base state (columns doc_id, num)."""
    lists = layers.join(on.select("doc_id", "num").distinct().withColumn("on", F.lit(True)), ["doc_id", "num"], "left").join(off.select("doc_id", "num").distinct().withColumn("off", F.lit(True)), ["doc_id", "num"], "left")
    return lists.withColumn("visible", F.when(F.col("off"), False).when(F.col("on"), True).otherwise(F.lit(base != "OFF"))).drop("on", "off")


def unhidden(content: DataFrame, layers: DataFrame) -> DataFrame:
    """Content (doc_id, num) whose layer is visible or unknown: an anti-join with the hidden ones."""
    return content.join(layers.where(~F.col("visible")).select("doc_id", "num"), ["doc_id", "num"], "left_anti")


def transformed(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under an affine matrix."""
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def placement(m: list[Column]) -> dict[str, Column]:
    """Place, scales and rotation of an image matrix; a mirrored one has a negative vertical scale."""
    det = m[0] * m[3] - m[1] * m[2]
    return {"x": m[4], "y": m[5], "scale_x": F.sqrt(m[0] * m[0] + m[1] * m[1]), "scale_y": F.sqrt(m[2] * m[2] + m[3] * m[3]) * F.when(det < 0, -1).otherwise(1), "degrees": F.degrees(F.atan2(m[1], m[0]))}
