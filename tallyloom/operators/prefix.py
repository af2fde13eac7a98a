"""Running sums, ranks and quantiles of keys that hold any share of the rows.

A window over a key puts all its rows in one task. Here rows are range-partitioned
by key and order instead, a key over as many tasks as its rows take: each task sums
its own part, the parts' sums (one row per key and part) are added up, and each row
gets what comes before its part on top of what comes before it there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import materialise


def same(keys: Sequence[str], prefix: str) -> Column:
    """Each key equal to the one named with the prefix, null to null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(prefix + k))
    return out


def _renamed(keys: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(k).alias(prefix + k) for k in keys]


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, str], totals: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with the sums over the rows before each row of its keys, and over all of its keys.

    sums: new name -> column; the row itself is left out, and the first row has 0.
    totals: new name -> column. order must be total within the keys, as after
    grouping by key and value. Null keys are a key. Nulls count as 0.
    """
    totals = totals or {}
    cut = materialise(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "running")
    every = {**{f"_s{i}": c for i, c in enumerate(sums.values())}, **{f"_t{i}": c for i, c in enumerate(totals.values())}}
    parts = cut.groupBy(*keys, "_part").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in every.items()])
    # One row per key and part: as many as there are keys and tasks.
    whole, before = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    placed = parts.select(
        *_renamed(keys, "_k"), F.col("_part").alias("_at"), *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))],
        *[F.sum(f"_t{i}").over(whole).alias(n) for i, n in enumerate(totals)],
    )
    inside = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = cut.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l{i}") for i, c in enumerate(sums.values())])
    joined = local.join(placed, same(keys, "_k") & (F.col("_part") == F.col("_at")))
    return joined.select(*df.columns, *[(F.col(f"_l{i}") + F.col(f"_b{i}")).alias(n) for i, n in enumerate(sums)], *totals)


def least_after(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, name: str) -> DataFrame:
    """``df`` with the least value of each row and the rows after it in its keys; parts meet as in ``running``."""
    cut = materialise(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "least-after")
    parts = cut.groupBy(*keys, "_part").agg(F.min(value).alias("_m"))
    later = W.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    placed = parts.select(*_renamed(keys, "_k"), F.col("_part").alias("_at"), F.min("_m").over(later).alias("_after"))
    # The last rows first, so that the frame behind a row is the rows after it.
    inside = W.partitionBy(*keys, "_part").orderBy(*[F.col(c).desc() if isinstance(c, str) else c for c in order]).rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumn("_l", F.min(value).over(inside))
    joined = local.join(placed, same(keys, "_k") & (F.col("_part") == F.col("_at")))
    return joined.select(*df.columns, F.least("_l", "_after").alias(name))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with the place of each row, from 0, in a total order within its keys."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), keys, order, {name: "_one"}).drop("_one")


def counted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value and ``n``, its rows; what ranks and quantiles are made of."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the rank of each value within its keys, from 1, equal values sharing the mean of their ranks; null for null values."""
    ranks = running(counted(df.where(F.col(value).isNotNull()), keys, value), keys, [value], {"_below": "n"})
    ranks = ranks.select(*_renamed(keys, "_k"), F.col(value).alias("_kvalue"), (F.col("_below") + (F.col("n") + 1) / 2.0).alias(name))
    return df.join(ranks, same(keys, "_k") & (F.col(value) == F.col("_kvalue")), "left").select(*df.columns, name)


def quantiles(count: DataFrame, keys: Sequence[str], value: str, at: Mapping[str, float], n: str = "n") -> DataFrame:
    """keys and a column for each share asked, between the two nearest values by distance, as the median of an even number is.

    count: one row per key and value with its rows ``n``.
    """
    ranked = running(count, keys, [value], {"_below": n}, {"_all": n})
    found = []
    for name, q in at.items():
        place = q * (F.col("_all") - 1)
        for half, k in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            found.append(F.max(F.when((F.col("_below") <= k) & (k < F.col("_below") + F.col(n)), F.col(value))).alias(f"_{name}_{half}"))
        found.append(F.max(place - F.floor(place)).alias(f"_{name}_f"))
    got = ranked.groupBy(*keys).agg(*found)
    return got.select(*keys, *[(F.col(f"_{x}_lo") + (F.col(f"_{x}_hi") - F.col(f"_{x}_lo")) * F.col(f"_{x}_f")).alias(x) for x in at])
