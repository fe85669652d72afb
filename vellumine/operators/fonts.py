"""Fonts: styles from names and flags, the machine's fonts as a table, and matches between both."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOLDERS = ("/usr/share/fonts", "/usr/local/share/fonts", "~/.fonts", "/System/Library/Fonts", "/Library/Fonts", "C:/Windows/Fonts")
KINDS = (".ttf", ".otf", ".ttc", ".pfb")
#: Marks of fonts for Chinese, Japanese and Korean (fixed values).
CJK_MARKS = ("cjk", "han", "song", "hei", "ming", "gothic", "mincho", "simsun", "noto sans sc", "wqy", "droidsansfallback", "nanum", "batang")


def style(name: Column, flags: Column, italic_angle: Column, weight: Column, stem_v: Column) -> dict[str, Column]:
    """Bold, italic and light, from a font's name, its descriptor's flags and measures."""
    low = F.lower(name)
    bold = low.rlike("bold|black|heavy") | (flags.bitwiseAND(1 << 18) != 0) | F.coalesce(weight >= 700, F.lit(False)) | F.coalesce(stem_v > 100, F.lit(False))
    italic = low.rlike("italic|oblique") | (flags.bitwiseAND(1 << 6) != 0) | F.coalesce(italic_angle != 0, F.lit(False))
    return {"bold": bold, "italic": italic, "light": low.rlike("light|thin")}


def plain_name(name: Column) -> Column:
    """A font's name as files spell it: no subset mark, lower case, no joints, no style at the end."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(name, r"^[A-Z]{6}\+", "")), r"[\s_,-]+", "")
    return F.regexp_replace(bare, r"(regular|roman|bold|italic|oblique|light|medium|black|mt|ps)+\z", "")


def system_fonts(spark: SparkSession, folders: tuple[str, ...] = FOLDERS) -> DataFrame:
    """(name, path, cjk) of font files on the driver's machine: a small table."""
    rows = []
    for top in folders:
        for d, _, names in os.walk(os.path.expanduser(top)):
            rows += [(Path(n).stem.lower(), os.path.join(d, n), any(m in n.lower() for m in CJK_MARKS)) for n in sorted(names) if n.lower().endswith(KINDS)]
    return spark.createDataFrame(rows, "name string, path string, cjk boolean")


#: Rows of a font table that are sent to every task.
FEW = 20_000


def matched(fonts: DataFrame, held: DataFrame, name: str = "name") -> DataFrame:
    """Fonts with the file that fits best: the same name, then the same plain name, then the longest common beginning of four letters or more.

    Equi-joins only: names are compared by keys (whole, plain, first four letters), so nothing is crossed.
    """
    asked = fonts.select(F.col(name).alias("asked")).distinct().withColumn("plain", plain_name(F.col("asked")))
    files = held.select("name", "path", plain_name(F.col("name")).alias("plain"))
    files = F.broadcast(files) if held.limit(FEW + 1).count() <= FEW else files
    same = asked.join(files.select("path", F.col("name").alias("file")), F.regexp_replace(F.lower("asked"), r"^[a-z]{6}\+", "") == F.col("file")).select("asked", "path", F.lit(0).alias("rank"), F.lit(0).alias("common"))
    plain = asked.join(files.select("path", "plain"), "plain").where("plain <> ''").select("asked", "path", F.lit(1).alias("rank"), F.lit(0).alias("common"))
    begin = asked.withColumn("start", F.substring("plain", 1, 4)).join(files.select("path", F.col("plain").alias("other"), F.substring("plain", 1, 4).alias("start")), "start").where("length(start) = 4 AND (startswith(other, plain) OR startswith(plain, other))")
    begin = begin.select("asked", "path", F.lit(2).alias("rank"), F.least(F.length("plain"), F.length("other")).alias("common"))
    best = same.unionByName(plain).unionByName(begin).withColumn("k", F.row_number().over(Window.partitionBy("asked").orderBy("rank", F.desc("common"), "path"))).where("k = 1")
    return fonts.join(best.select(F.col("asked").alias(name), "path", "rank"), name, "left")
