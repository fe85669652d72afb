"""Equi-joins in which few keys hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.session import cut

#: Rows of one key from which it is joined apart (raised where more than FEW_KEYS keys have them).
HOT, FEW_KEYS = 100_000, 200_000
#: Rows up to which a side of short rows is broadcast.
FEW = 1_000_000


def small(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df`` (cut, of short rows) marked for broadcast if it is counted to hold at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner", hot: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` (one row a key; ``weight`` is about how many rows of ``left`` it meets).

    Keys of more than ``hot`` rows are joined by broadcast, so their rows stay where they are; the
    others meet by a shuffle. ``how`` is inner or left; left rows without a key go round the join.
    """
    hot = HOT if hot is None else hot
    right = cut(right)
    if how == "left":
        alone = left.where(F.col(key).isNull())
        left = left.where(F.col(key).isNotNull())
    while (n := right.where(F.col(weight) > hot).count()) > FEW_KEYS:
        hot *= 4
    if n:
        # one broadcast serves both parts
        heavy, mark = right.where(F.col(weight) > hot).withColumn("__heavy", F.lit(True)), left.columns
        marked = left.join(F.broadcast(heavy), key, "left")
        light = marked.where(F.col("__heavy").isNull()).select(*mark).join(right.where(~(F.col(weight) > hot)), key, how)
        out = marked.where("__heavy").drop("__heavy").unionByName(light)
    else:
        out = left.join(right, key, how)
    return out.unionByName(alone, allowMissingColumns=True) if how == "left" else out
