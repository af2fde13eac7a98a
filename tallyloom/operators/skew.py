"""Joins that survive a key holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the left side's rows on, so there are at most 1,000 hot keys.
HOT_SHARE = 1000
#: Below this many rows no key needs splitting.
HOT_ROWS = 200_000


def hot_split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key``, where ``right`` has one row a key at most.

    Keys with more than ``max(HOT_ROWS, rows / HOT_SHARE)`` left rows number at
    most ``HOT_SHARE``; their right rows are broadcast, so their left rows are not
    shuffled. All other keys go through an ordinary join. ``left`` should be a
    written table: it is read twice. Null keys match nothing, as in SQL; with
    ``how='left'`` they stay.
    """
    rows = left.count()
    if rows <= HOT_ROWS:
        return left.join(right, key, how)
    limit = max(HOT_ROWS, rows // HOT_SHARE)
    hot = [r[0] for r in left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > limit).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = right.where(F.col(key).isin(hot))
    return left.where(is_hot).join(F.broadcast(few), key, how).unionByName(left.where(~is_hot).join(right.where(~F.col(key).isin(hot)), key, how))
