"""Filling containers of fixed capacity with items of varying length.

Method: optimal length buckets. The global histogram of lengths goes to the
driver, whose size is bounded by the capacity; dynamic programming over it
chooses the bucket boundaries with the least padding. Batches form inside each
bucket up to the token budget: a container takes as many of the bucket's items
as fit. The space that such a batch leaves is given to items of smaller buckets,
on the same bucket counts, so the plan stays a small table; items find their
container by their rank within their bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import materialise

#: The capacity bounds the histogram that the driver holds.
MAX_CAPACITY = 1 << 16
#: Pieces that one task ranks within their bucket, about.
RANKED = 1_000_000


@dataclass(frozen=True)
class Shelf:
    """Ranks [first, last) of a bucket, ``each`` in a container, the first in ``container`` at ``offset``."""

    bucket: int
    bound: int
    first: int
    last: int
    container: int
    each: int
    offset: int


def optimal_bounds(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise padding.

    counts[s] is the number of items of length s; an item is padded to the bound
    of its bucket. Only lengths that occur can be bounds. The padding of a bucket
    is a Monge cost, so the best split never moves back as the lengths grow, and
    each bucket takes O(lengths log lengths) steps and O(lengths) memory.
    """
    sizes = np.flatnonzero(counts)
    sizes = sizes[sizes > 0]
    k = len(sizes)
    if k <= buckets:
        return [int(s) for s in sizes]
    n = np.concatenate(([0.0], np.cumsum(counts[sizes], dtype=np.float64)))
    total = np.concatenate(([0.0], np.cumsum(counts[sizes] * sizes, dtype=np.float64)))
    bound = np.concatenate(([0.0], sizes.astype(np.float64)))
    # best[j]: least padding of the j shortest lengths in the buckets so far
    best = bound * n - total
    back = np.zeros((buckets, k + 1), dtype=np.int32)
    for b in range(1, buckets):
        best, back[b] = _one_more_bucket(best, bound, n, total)
    bounds, j = set(), k
    for b in reversed(range(buckets)):
        if j and back[b][j] < j:
            bounds.add(int(sizes[j - 1]))
        j = int(back[b][j])
    return sorted(bounds)


def _one_more_bucket(best: np.ndarray, bound: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padding with one more bucket, and where that bucket begins; all middles of a depth of the division at once."""
    size = len(best)
    out, split = np.empty(size), np.zeros(size, dtype=np.int32)
    first, last = np.array([0]), np.array([size - 1])
    low, high = np.array([0]), np.array([size - 1])
    while len(first):
        mid = (first + last) // 2
        width = np.minimum(high, mid) - low + 1
        starts = np.concatenate(([0], np.cumsum(width)[:-1]))
        i = np.arange(width.sum()) - np.repeat(starts - low, width)
        j = np.repeat(mid, width)
        cost = best[i] + bound[j] * (n[j] - n[i]) - (total[j] - total[i])
        least = np.minimum.reduceat(cost, starts)
        # The first of equal splits.
        at = np.flatnonzero(cost == np.repeat(least, width))
        at = i[at[np.searchsorted(at, starts)]]
        out[mid], split[mid] = least, at
        first, last = np.concatenate((first, mid + 1)), np.concatenate((mid - 1, last))
        low, high = np.concatenate((low, at)), np.concatenate((at, high))
        some = first <= last
        first, last, low, high = first[some], last[some], low[some], high[some]
    return out, split


def plan(bounds: list[int], counts: list[int], capacity: int) -> tuple[list[Shelf], int]:
    """Shelves for all items of the buckets, and the number of containers.

    Largest bucket first: its batch, then from what is left the largest bucket
    that fits, and so on; the pattern repeats while its counts last. Every pattern
    leaves a bucket with fewer items than the pattern takes, so patterns are few.
    """
    left, done = list(counts), [0] * len(bounds)
    shelves: list[Shelf] = []
    containers = 0
    for b in reversed(range(len(bounds))):
        while left[b]:
            pattern, room = [], capacity
            for c in range(b, -1, -1):
                each = min(room // bounds[c], left[c])
                if each:
                    pattern.append((c, each, capacity - room))
                    room -= each * bounds[c]
            times = min(left[c] // each for c, each, _ in pattern)
            for c, each, offset in pattern:
                shelves.append(Shelf(c, bounds[c], done[c], done[c] + each * times, containers, each, offset))
                left[c] -= each * times
                done[c] += each * times
            containers += times
    return shelves, containers


def pack(items: DataFrame, item_id: str = "doc_id", size: str = "n_tokens", capacity: int = 2048, buckets: int = 256) -> DataFrame:
    """item_id, piece_no (from 0), piece_from, piece_size, container and place of every piece.

    An item of at most ``capacity`` is one piece; a longer one is divided into
    pieces of the capacity and a rest. piece_from is the piece's first unit in its
    item, place its first unit in the container; pieces of a container do not
    overlap. Items of size 0 or null have one row with piece_size 0 and no
    container. Negative sizes are refused. Repeated rows are items of their own.

    Ranks within a bucket come from counts per hash part of the ids and row numbers
    inside a part, so a bucket holding most items is still ranked by many tasks, and
    the containers depend on the items and not on how their rows lie.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be from 1 to {MAX_CAPACITY}")
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    checked = F.when(n < 0, F.raise_error(F.lit("negative size"))).otherwise(n)
    sized = items.select(F.col(item_id), checked.alias("_n"))
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("_n", F.lit(1)) - 1) / capacity).cast("long"))
    cut = sized.select(item_id, "_n", F.explode(steps).alias("piece_no"))
    pieces = cut.select(item_id, "piece_no", (F.col("piece_no") * capacity).alias("piece_from"), F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("piece_no") * capacity).alias("piece_size"))
    held = materialise(pieces, "pack-pieces")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in held.where("piece_size > 0").groupBy("piece_size").count().collect():  # at most ``capacity`` rows
        histogram[r.piece_size] = r["count"]
    bounds = optimal_bounds(histogram, buckets)
    spark = items.sparkSession
    nowhere = held.where("piece_size = 0").select(item_id, "piece_no", "piece_from", "piece_size", F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("place"))
    if not bounds:
        return nowhere
    edges = [0, *bounds]
    counts = [int(histogram[a + 1 : b + 1].sum()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    shelves, _ = plan(bounds, counts, capacity)
    table = spark.createDataFrame([(s.bucket, s.bound, s.first, s.last, s.container, s.each, s.offset) for s in shelves], "bucket int, bound int, first long, last long, base long, each int, shift int")
    bucket_of = np.searchsorted(np.array(bounds), np.arange(1, capacity + 1)).tolist()
    part = F.pmod(F.xxhash64(item_id, "piece_no"), F.lit(int(histogram.sum()) // RANKED + 1))
    placed = held.where("piece_size > 0").withColumn("bucket", F.element_at(F.lit(bucket_of), F.col("piece_size").cast("int"))).withColumn("_part", part)
    ranked = placed.withColumn("_local", F.row_number().over(W.partitionBy("bucket", "_part").orderBy(item_id, "piece_no", "piece_size")).cast("long") - 1)
    parts = placed.groupBy("bucket", "_part").count()
    before = parts.withColumn("_skip", F.coalesce(F.sum("count").over(W.partitionBy("bucket").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = ranked.join(before, ["bucket", "_part"]).withColumn("_rank", F.col("_skip") + F.col("_local"))
    # The plan's rows are bounded by the bucket counts and not by the data.
    at = F.broadcast(table.withColumnRenamed("bucket", "_b"))
    found = ranked.join(at, (F.col("bucket") == F.col("_b")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("last")))
    step = F.col("_rank") - F.col("first")
    out = found.select(item_id, "piece_no", "piece_from", "piece_size", (F.col("base") + F.floor(step / F.col("each"))).cast("long").alias("container"), (F.col("shift") + (step % F.col("each")) * F.col("bound")).cast("int").alias("place"))
    return out.unionByName(nowhere)


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, items' units in them, and the share of their space that is used."""
    per = packed.where(F.col("container").isNotNull())
    return per.agg(F.count_distinct("container").alias("containers"), F.sum("piece_size").alias("units")).withColumn("used_share", F.col("units") / (F.col("containers") * capacity))
