"""Revisions of evidence as tables: compiled batches, guarded and atomic application, and traces of what is cited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a revision may do, the strongest first. Fixed values.
ACTIONS = ("unavailable", "invalidate", "downweight")


def strength(action: Column) -> Column:
    """1 for the strongest action; null for none of them."""
    return F.nullif(F.array_position(F.array(*map(F.lit, ACTIONS)), action), F.lit(0))


def compiled(revisions: DataFrame, batch: str, key: str, action: str, guard: str) -> DataFrame:
    """One revision a batch and key: the strongest action, the least factor, and what was merged.

    revisions: batch, key, action, factor, and the guard (the hash of the row that the
    revision was made for). merged: how many rows fell together; conflict: they
    named different actions or different guards. Repeated revisions merge without a
    conflict. Rows with a null key or an unknown action stay as they are and make
    their batch invalid on application.
    """
    rank = strength(F.col(action))
    return revisions.groupBy(batch, key).agg(
        F.min_by(action, F.struct(F.coalesce(rank, F.lit(0)), F.col(action))).alias(action), F.min("factor").alias("factor"), F.min(guard).alias(guard),
        F.count("*").alias("merged"), ((F.count_distinct(action) > 1) | (F.count_distinct(guard) > 1)).alias("conflict"), F.bool_and(rank.isNotNull()).alias("_known"),
    )


def applied(base: DataFrame, plan: DataFrame, batch: str, key: str, guard: str, weight: str) -> DataFrame:
    """The base rows after the compiled revisions: batch, key, action (``kept`` where none), the new weight, and status.

    A batch is applied whole or not at all: it is rejected where one of its revisions
    names no row of the base, an unknown action, conflicting ones, or a guard that
    the base row no longer has. A rejected batch leaves its rows as they were. base
    has one row a batch and key; its guard is the row's present hash. unavailable and
    invalidate set the weight to 0, downweight multiplies it by the factor.
    """
    now = base.select(F.col(batch).alias("_b"), F.col(key).alias("_k"), F.col(guard).alias("_now"))
    checked = plan.join(now, plan[batch].eqNullSafe(F.col("_b")) & (plan[key] == F.col("_k")), "left")
    bad = F.col("_k").isNull() | ~F.col("_known") | F.col("conflict") | ~F.col("_now").eqNullSafe(F.col(guard))
    verdict = checked.groupBy(batch).agg(F.max(bad).alias("_rejected")).select(F.col(batch).alias("_vb"), "_rejected")
    steps = plan.select(F.col(batch).alias("_pb"), F.col(key).alias("_pk"), "action", "factor")
    x = base.join(verdict, base[batch].eqNullSafe(F.col("_vb")), "left").join(steps, base[batch].eqNullSafe(F.col("_pb")) & (base[key] == F.col("_pk")), "left")
    live = F.col("action").isNotNull() & ~F.coalesce("_rejected", F.lit(False))
    new = F.when(~live, F.col(weight)).when(F.col("action").isin("unavailable", "invalidate"), 0.0).otherwise(F.col(weight) * F.col("factor"))
    status = F.when(F.col("_rejected").isNull(), "untouched").when(F.col("_rejected"), "rejected").otherwise("applied")
    return x.select(base[batch], base[key], F.when(live, F.col("action")).otherwise("kept").alias("action"), new.alias(weight), status.alias("status"))
