"""Operators over ordered rows: runs, windows of time, intervals, nearest rows, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """Longest runs of one state: keys, run_no (from 1), state and n rows of each. ``order`` must be total within keys."""
    at = W.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(state).over(at).eqNullSafe(F.col(state)) & (F.row_number().over(at) > 1), 0).otherwise(1)
    marked = df.withColumn("_c", changed).withColumn("run_no", F.sum("_c").over(at.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run_no").agg(F.first(state).alias(state), F.count("*").alias("n"))


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """The last non-null value at or before each row."""
    return df.withColumn(name, F.last(column, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def dilate(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str, reach: int = 1) -> DataFrame:
    """Largest value within ``reach`` rows on either side."""
    return df.withColumn(name, F.max(column).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, reach)))


def tumbling(seconds: Column, size: float) -> Column:
    """Index of the window of ``size`` seconds that holds an offset."""
    return F.floor(seconds / size).cast("long")


def sliding_starts(length: Column, size: int, step: int) -> Column:
    """Starts of windows of ``size`` every ``step`` units over 0..length, with one more that ends at the end if they leave a rest.

    Anything no longer than a window has the one start 0; null and non-positive lengths have none.
    """
    regular = F.sequence(F.lit(0).cast("long"), F.greatest(length - size, F.lit(0)).cast("long"), F.lit(step).cast("long"))
    tail = F.array((length - size).cast("long"))
    every = F.when((length > size) & ((length - size) % step != 0), F.concat(regular, tail)).otherwise(regular)
    return F.when(length > 0, every).otherwise(F.array().cast("array<bigint>"))


def within_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str], cost: str, budget: float) -> DataFrame:
    """Rows in order while their running cost, their own left out, stays under the budget."""
    before = F.coalesce(F.sum(cost).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn("_b", before).where(F.col("_b") < budget).drop("_b")


#: Cells that one interval is entered in; a longer one is entered in a coarser grid, eight times as wide at each level.
MOST_CELLS, COARSER = 64, 8
#: Levels of grids.
LEVELS = 8


def _entered(df: DataFrame, key: str, side: str, grain: float) -> DataFrame:
    """Each interval with its own level, the finest at which it touches at most ``MOST_CELLS`` cells."""
    s, e = F.col("start"), F.col("end")
    level = F.lit(LEVELS - 1)
    for n in reversed(range(LEVELS - 1)):
        level = F.when((e - s) / (grain * COARSER**n) < MOST_CELLS - 1, n).otherwise(level)
    return df.where("start <= end").select(F.col(key), F.col("id").alias(f"{side}_id"), s.alias(f"_{side}s"), e.alias(f"_{side}e"), level.alias(f"_{side}n"))


def overlaps(a: DataFrame, b: DataFrame, key: str, grain: float) -> DataFrame:
    """Pairs of intervals of one key that overlap: key, a_id, b_id, start, end of the shared part.

    a and b: key, id, start, end. Each interval is entered in the cells it touches of
    the grid its length asks for, and pairs meet by equality in the first cell both
    touch, in the coarser grid of the two: so the join is no cross join, each pair
    comes once, and an interval however long fills ``MOST_CELLS`` cells of its own
    grid. A short interval looks into the coarser grids too, one or two cells each;
    only levels that hold intervals of the other side are looked into. Neither side is
    broadcast: the planner takes them for as small as they are before they are entered.
    """
    x, y = _entered(a, key, "a", grain), _entered(b, key, "b", grain)
    width = F.lit(float(grain)) * F.pow(F.lit(float(COARSER)), F.col("_n"))

    def cells(df: DataFrame, side: str) -> DataFrame:
        levels = df.withColumn("_n", F.explode(F.sequence(F.col(f"_{side}n"), F.lit(LEVELS - 1))))
        return levels.withColumn("_c", F.explode(F.sequence(F.floor(F.col(f"_{side}s") / width).cast("long"), F.floor(F.col(f"_{side}e") / width).cast("long"))))

    lo, hi = F.greatest("_as", "_bs"), F.least("_ae", "_be")
    met = cells(x, "a").hint("merge").join(cells(y, "b"), [key, "_n", "_c"])
    return met.where((F.col("_n") == F.greatest("_an", "_bn")) & (hi > lo) & (F.col("_c") == F.floor(lo / width))).select(key, "a_id", "b_id", lo.alias("start"), hi.alias("end"))


def window_cover(spans: DataFrame, windows: DataFrame, key: str, size: float) -> DataFrame:
    """Seconds of each window of ``size`` seconds that intervals of its key cover: key, b_id (the window, from 0), seconds.

    spans: key, start, end; a null start lies before every window, a null end behind.
    windows: key, n; the key has windows 0 to n - 1, once for each of its rows, and none if n is null or not above 0.
    Keys meet before anything is multiplied, and an interval then becomes the windows
    it covers and no others: so no row is made for a window without seconds, and the
    sums need no shuffle after the join. Neither side is broadcast: both grow with the
    recordings, and the planner takes intervals for as small as the texts they come from.
    """
    counted = windows.groupBy(key, "n").agg(F.count("*").alias("_m"))
    first = F.greatest(F.lit(0).cast("long"), F.floor(F.col("start") / size).cast("long"))
    behind = F.least(F.col("n").cast("long"), F.ceil(F.col("end") / size).cast("long"))
    met = spans.hint("merge").join(counted, key).withColumn("_f", first).withColumn("_t", behind).where("_f < _t")
    k = met.withColumn("b_id", F.explode(F.sequence(F.col("_f"), F.col("_t") - 1)))
    lo, hi = F.greatest("start", size * F.col("b_id")), F.least("end", size * (F.col("b_id") + 1))
    return k.where(hi > lo).groupBy(key, "b_id").agg(F.sum((hi - lo) * F.col("_m")).alias("seconds"))


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """Each left row with the right row of its keys nearest in ``at``; the later of two equally near.

    One sort of both sides together: the last right row before and the first after
    are carried to each left row, and no pairs are built. Left rows need no partner.
    """
    l = left.select(*left.columns, F.lit(None).cast("struct<t:double,v:double>").alias("_r"))
    r = right.select(*keys, F.col(at), F.struct(F.col(at).cast("double").alias("t"), F.col(value).cast("double").alias("v")).alias("_r"))
    both = l.withColumn("_is_left", F.lit(True)).unionByName(r.withColumn("_is_left", F.lit(False)), allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(at)
    both = both.withColumn("_before", F.last("_r", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, 0))).withColumn("_after", F.first("_r", ignorenulls=True).over(w.rangeBetween(0, W.unboundedFollowing)))
    x = F.col(at).cast("double")
    use_before = F.col("_after").isNull() | (F.col("_before").isNotNull() & (x - F.col("_before.t") < F.col("_after.t") - x))
    return both.where("_is_left").select(*left.columns, F.when(use_before, F.col("_before")).otherwise(F.col("_after")).alias("_n")).select(*left.columns, F.col("_n.t").alias("nearest_at"), F.col("_n.v").alias("nearest_value"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key; ``order`` should end in a unique column. Spark prunes within tasks before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def diversified(df: DataFrame, keys: Sequence[str], kind: Sequence[str], order: Sequence[Column], fill: Sequence[Column], k: int) -> DataFrame:
    """k rows of each key: first the best of each kind, in order, then the rest in the order ``fill``."""
    best = F.row_number().over(W.partitionBy(*keys, *kind).orderBy(*order)) == 1
    marked = df.withColumn("_first", best)
    lead = W.partitionBy(*keys, "_first")
    place = F.when(F.col("_first"), F.row_number().over(lead.orderBy(*order))).otherwise(F.row_number().over(lead.orderBy(*fill)) + 1_000_000_000)
    return marked.withColumn("_p", place).withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("_p"))).where(F.col("rank") <= k).drop("_p", "_first")


def shadowed(df: DataFrame, keys: Sequence[str], scope: str, whole: str) -> DataFrame:
    """Rows without those of the scope ``whole`` where their key also has a narrower scope."""
    narrow = F.max(F.when(F.col(scope) != whole, 1).otherwise(0)).over(W.partitionBy(*keys))
    return df.withColumn("_n", narrow).where((F.col(scope) != whole) | (F.col("_n") == 0)).drop("_n")


def average_rank(keys: Sequence[str], value: str) -> Column:
    """Rank from 1 with equal values sharing the mean of their ranks, for keys whose rows fit one task; ``prefix.average_ranks`` for others."""
    w = W.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(W.partitionBy(*keys, value)) - 1) / 2.0


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the least SHA-256 of their key: the same sample in any order of rows."""
    return df.withColumn("_h", F.sha2(F.col(key).cast("string"), 256)).orderBy("_h", key).limit(n).drop("_h")


def below_share(share: Column, *key: Column | str) -> Column:
    """Whether a row's hash lies in the lowest ``share`` of all hashes: the same rows in any order and partitioning."""
    return F.xxhash64(*key).cast("double") < -(2.0**63) + 2.0**64 * share
