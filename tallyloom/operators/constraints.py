"""Checks that tables hold what later steps rely on; violations are rows, and the strict forms stop the query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The table itself; raises before any job if a column is absent."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once or have a null or blank part, with their number of rows ``n``."""
    blank = None
    for k in keys:
        b = F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
        blank = b if blank is None else blank | b
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | blank)


def outside_domain(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values that are null or not allowed, with their number of rows."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed)).groupBy(column).agg(F.count("*").alias("n"))


def not_constant(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Keys under which a column has several different non-null values."""
    return df.groupBy(*keys).agg(F.min(column).alias("least"), F.max(column).alias("greatest")).where("least <> greatest")


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of only one of two tables, with ``side`` left or right. Null keys count as equal."""
    tag = lambda df, n: df.select(*keys, F.lit(n).alias("_s"))
    both = tag(a, 1).unionByName(tag(b, 2)).groupBy(*keys).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    return both.where("_lo = _hi").select(*keys, F.when(F.col("_lo") == 1, "left").otherwise("right").alias("side"))


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """A join whose stated cardinality is checked inside the plan.

    A side that must be unique is counted by key and stops the query at the first
    key that occurs twice, so no job runs beforehand. ``left`` columns win over
    none: the sides must share only the keys.
    """

    def unique(df: DataFrame, side: str) -> DataFrame:
        others = [c for c in df.columns if c not in keys]
        one = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(F.struct(*others) if others else F.lit(0)).alias("_row"))
        checked = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{side} side of a {validate} join repeats a key"))).otherwise(F.col("_row"))
        return one.select(*keys, checked.alias("_row")).select(*keys, *([F.col(f"_row.{c}").alias(c) for c in others] if others else []))

    lefts, rights = validate.split("_to_")
    return (unique(left, "left") if lefts == "one" else left).join(unique(right, "right") if rights == "one" else right, list(keys), how)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equality join in which null keys match null keys; the left side's keys are kept."""
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on: Column | None = None
    for k in keys:
        one = left[k].eqNullSafe(r[f"__{k}"])
        on = one if on is None else on & one
    return left.join(r, on, how).drop(*[f"__{k}" for k in keys])


def pivot_unique(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, value: str, prefix: str = "") -> DataFrame:
    """keys and one column per listed value of ``column``, holding the row's ``value``; two rows for one cell raise.

    A cell without a row, or with a null value, is null; rows of other values of ``column`` are left out.
    """
    cells = []
    for v in values:
        own = F.col(column) == v
        cells.append(F.when(F.count_if(own) > 1, F.raise_error(F.lit(f"two rows for {column} {v}"))).otherwise(F.max(F.when(own, F.col(value)))).alias(f"{prefix}{v}"))
    return df.groupBy(*keys).agg(*cells)
