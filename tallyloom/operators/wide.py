"""Attribute-value rows into one typed wide row per entity.

Method: characteristic sets. Each entity's exact set of attributes is its
signature; entities of one signature fit a dense table with no empty cells, and
the wide table is the union by name of those tables. Where sets are as varied as
in measurement data (almost every entity has its own), one table a signature
would give a plan that grows with the data. So signatures are merged, from the
bottom up, into ``tables`` super-signatures: of all pairs, the one whose union
adds the fewest empty cells. Each super-signature has a table of its own
attributes; an entity goes to the smallest table that has all of its own.
The last table has every attribute, so none is left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import materialise

#: Most attributes a registry may have: it is held by the driver and becomes columns.
MAX_ATTRIBUTES = 2000

#: Most frequent signatures that the layout of the tables is made from; the others go to the tables that hold them.
LAYOUT_SIGNATURES = 512
#: Attributes that share a word of a signature.
WORD = 62

CASTS = {"double": "double", "bigint": "bigint", "boolean": "boolean"}


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str
    column: str


def spelling_key(name: Column) -> Column:
    """What differently spelled attribute names share.

    Case, separators, a leading ``metric:`` and white space do not count:
    ``metric:word_count``, ``Word Count`` and ``wordCount`` give ``wordcount``.
    """
    bare = F.regexp_replace(F.lower(F.trim(name)), r"^\s*metric\s*:", "")
    return F.regexp_replace(bare, r"[^\p{L}\p{N}]", "")


def read_registry(registry: DataFrame, taken: Sequence[str], name: str = "metric_id", kind: str = "value_type") -> list[Attribute]:
    """The attributes, in order of name. Rows without a name or with an unknown type are refused or left out.

    A null name is left out; a repeated name must repeat its type; a column that
    would clash with an entity column gets the suffix ``_value``.
    """
    rows = registry.select(F.col(name).alias("n"), F.lower(F.col(kind)).alias("k")).where("n is not null").distinct().limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"the registry has more than {MAX_ATTRIBUTES} attributes")
    if len({r.n for r in rows}) < len(rows):
        raise ValueError("an attribute has two types")
    if bad := [r.n for r in rows if r.k not in CASTS]:
        raise ValueError(f"no known type: {bad}")
    low = {t.lower() for t in taken}
    return [Attribute(r.n, r.k, r.n + "_value" if r.n.lower() in low else r.n) for r in sorted(rows)]


def attribute_index(attributes: list[Attribute], name: Column) -> Column:
    """Position of the attribute a spelling stands for, null for none.

    An exact name wins over a shared spelling, so two registry names that differ
    only in separators stay apart.
    """
    exact = F.create_map(*[F.lit(x) for i, a in enumerate(attributes) for x in (a.name, i)])
    keys: dict[str, set[int]] = {}
    for i, a in enumerate(attributes):
        keys.setdefault("".join(c for c in a.name.lower().removeprefix("metric:") if c.isalnum()), set()).add(i)
    spelled = F.create_map(*[F.lit(x) for k, ids in sorted(keys.items()) if len(ids) == 1 for x in (k, next(iter(ids)))])
    return F.coalesce(F.try_element_at(exact, name), F.try_element_at(spelled, spelling_key(name)))


def gather_cells(rows: DataFrame, attributes: list[Attribute], entity: Sequence[str], attribute: str, value: str, tolerance: float) -> DataFrame:
    """One row per entity and attribute: the least and largest finite value, and whether one value fills the cell.

    Partial aggregation runs before the shuffle, so an entity holding a third of
    all rows sends one row per attribute and task.
    """
    kind = F.element_at(F.array(*[F.lit(a.kind) for a in attributes]), F.col("_at") + 1)
    v = F.col("_v")
    misfit = F.when(kind == "bigint", (F.rint(v) != v) | (F.abs(v) >= 9.2e18)).when(kind == "boolean", ~v.isin(0.0, 1.0)).otherwise(F.lit(False))
    return (
        rows.select(*[F.col(c) for c in entity], attribute_index(attributes, F.col(attribute)).alias("_at"), F.col(value).cast("double").alias("_v"))
        .where(F.col(entity[0]).cast("string").rlike(r"\S") & F.col("_at").isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
        .withColumn("_misfit", misfit)
        .groupBy(*entity, "_at")
        .agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.max("_misfit").alias("_misfit"))
        .select(*entity, "_at", "_lo", ((F.col("_hi") - F.col("_lo") > tolerance) | F.col("_misfit")).alias("_open"))
    )


def layout(signatures: Sequence[tuple[Sequence[int], int]], width: int, tables: int) -> list[list[int]]:
    """Super-signatures of (attribute set, entities) pairs: at most ``tables``, small ones first, the last with all ``width`` attributes.

    Two sets are merged where their union adds the fewest empty cells over their
    entities, until few enough are left.
    """
    sets = np.zeros((len(signatures) + 1, width), dtype=bool)
    for i, (ats, _) in enumerate(signatures, 1):
        sets[i, list(ats)] = True
    # The whole set takes part with no entities of its own.
    sets[0] = True
    weight = np.array([0, *(n for _, n in signatures)], dtype=float)
    while len(sets) > max(tables, 1):
        size = sets.sum(axis=1).astype(float)
        union = size[:, None] + size[None, :] - sets.astype(float) @ sets.T.astype(float)
        added = weight[:, None] * (union - size[:, None]) + weight[None, :] * (union - size[None, :])
        np.fill_diagonal(added, np.inf)
        # The cheapest disjoint pairs of this round, a part of what is still too many, so that rounds stay few.
        most = max(1, (len(sets) - tables) // 4)
        used, gone = set(), []
        upper = np.triu_indices(len(sets), 1)
        for at in np.argsort(added[upper], kind="stable"):
            i, j = int(upper[0][at]), int(upper[1][at])
            if i not in used and j not in used:
                used |= {i, j}
                sets[i] |= sets[j]
                weight[i] += weight[j]
                gone.append(j)
                if len(gone) == most:
                    break
        sets, weight = np.delete(sets, gone, axis=0), np.delete(weight, gone)
    found = {tuple(np.flatnonzero(x).tolist()) for x in sets} | {tuple(range(width))}
    return [list(x) for x in sorted(found, key=lambda x: (len(x), x))]


def _word(name: str, i: int) -> Column:
    return F.col(name)[i // WORD]


def _signed(rows: DataFrame, attributes: list[Attribute], entity: Sequence[str], attribute: str, value: str, tolerance: float) -> DataFrame:
    """One written row per entity: its filled cells in order of attribute (``_dense``), the open ones, and its signature.

    ``_mask`` is the signature as words of ``WORD`` bits, ``_skip`` the cells before each word.
    """
    cells = gather_cells(rows, attributes, entity, attribute, value, tolerance)
    # At most one cell per attribute reaches a group here.
    words = range(-(-len(attributes) // WORD))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_at") % WORD).cast("int"))
    mask = F.array(*[F.bit_or(F.when(F.floor(F.col("_at") / WORD) == w, bit).otherwise(F.lit(0).cast("long"))) for w in words])
    packed = cells.groupBy(*entity).agg(F.array_sort(F.collect_list(F.struct("_at", "_lo", "_open"))).alias("_c"), mask.alias("_mask"))
    signed = packed.select(*entity, F.col("_c._lo").alias("_dense"), F.transform(F.filter("_c", lambda c: c["_open"]), lambda c: c["_at"]).alias("_open"), "_mask")
    skip, before = [], F.lit(0)
    for w in words:
        skip.append(before)
        before = before + F.bit_count(F.col("_mask")[w])
    return materialise(signed.withColumn("_skip", F.array(*skip)), "wide-signed")


def _layout_of(held: DataFrame, width: int, tables: int) -> list[list[int]]:
    top = held.groupBy("_mask").count().orderBy(F.desc("count"), "_mask").limit(LAYOUT_SIGNATURES).collect()
    return layout([([i for i in range(width) if r._mask[i // WORD] >> (i % WORD) & 1], r["count"]) for r in top], width, tables)


def _table_of(sets: list[list[int]], width: int) -> Column:
    """The first, smallest, super-signature that has all of an entity's attributes."""
    out = F.lit(len(sets) - 1)
    for k in reversed(range(len(sets) - 1)):
        words = [sum(1 << (i % WORD) for i in sets[k] if i // WORD == w) for w in range(-(-width // WORD))]
        inside = F.lit(True)
        for w, own in enumerate(words):
            inside = inside & (F.col("_mask")[w].bitwiseAND(F.lit(~own).cast("long")) == 0)
        out = F.when(inside, k).otherwise(out)
    return out


def widen(
    rows: DataFrame,
    registry: DataFrame,
    entity: Sequence[str] = ("subject_id", "task_scope"),
    attribute: str = "metric_id",
    value: str = "value",
    tolerance: float = 1e-6,
    tables: int = 4,
) -> DataFrame:
    """One row per entity with a typed column per registered attribute.

    rows: long rows; only the entity, attribute and value columns are read, other
    columns of any name are ignored. registry: attribute names and types
    (double, bigint, boolean).

    Result: the entity columns, one column per attribute, and ``unfilled``, the
    sorted attributes whose rows agree on no single value: two values differ by
    more than ``tolerance``, or one does not fit the type. Those cells are null,
    as are cells with no finite value. Where values agree, the least is kept.

    Rows whose first entity column is null, empty or blank, whose attribute is
    not registered, or whose value is null, NaN or infinite fill no cell; an
    entity with no filled or open cell has no row. Null in another entity column
    is an entity of its own. Repeated rows change nothing. No rows give no rows
    with the full schema.
    """
    attributes = read_registry(registry, [*entity, "unfilled"])
    if not attributes:
        raise ValueError("the registry has no attributes")
    held = _signed(rows, attributes, entity, attribute, value, tolerance)
    sets = _layout_of(held, len(attributes), tables)
    names = F.array(*[F.lit(a.name) for a in attributes])

    def cell(i: int) -> Column:
        """The value of attribute i: as many places in as the entity has attributes before it."""
        bit = 1 << (i % WORD)
        at = _word("_skip", i) + F.bit_count(_word("_mask", i).bitwiseAND(F.lit(bit - 1).cast("long"))) + 1
        has = (_word("_mask", i).bitwiseAND(F.lit(bit).cast("long")) != 0) & ~F.array_contains("_open", i)
        kept = F.when(has, F.try_element_at("_dense", at.cast("int")))
        return (kept == 1.0 if attributes[i].kind == "boolean" else kept.cast(CASTS[attributes[i].kind])).alias(attributes[i].column)

    def table(k: int) -> DataFrame:
        own = held.where(_table_of(sets, len(attributes)) == k)
        return own.select(*entity, *[cell(i) for i in sets[k]], F.array_sort(F.transform("_open", lambda i: F.element_at(names, i + 1))).alias("unfilled"))

    # The last table has every column, in order: it is the schema.
    out = table(len(sets) - 1)
    for k in range(len(sets) - 1):
        out = out.unionByName(table(k), allowMissingColumns=True)
    return out


def table_shares(rows: DataFrame, registry: DataFrame, entity: Sequence[str] = ("subject_id", "task_scope"), attribute: str = "metric_id", value: str = "value", tolerance: float = 1e-6, tables: int = 4) -> DataFrame:
    """One row per table of ``widen``: its number, attributes, entities, cells with a value or an open one, and the share of its cells that are empty."""
    attributes = read_registry(registry, [*entity, "unfilled"])
    held = _signed(rows, attributes, entity, attribute, value, tolerance)
    sets = _layout_of(held, len(attributes), tables)
    sizes = F.array(*[F.lit(len(x)) for x in sets])
    per = held.groupBy(_table_of(sets, len(attributes)).alias("table_no")).agg(F.count("*").alias("entities"), F.sum(F.size("_dense")).alias("cells"))
    width = F.element_at(sizes, F.col("table_no") + 1)
    return per.select("table_no", width.alias("attributes"), "entities", "cells", (1 - F.col("cells") / (F.col("entities") * width)).alias("empty_share"))


def unfilled_cells(wide: DataFrame, entity: Sequence[str] = ("subject_id", "task_scope"), attribute: str = "metric_id") -> DataFrame:
    """The cells of a wide table that no single value fills, one row each."""
    return wide.select(*entity, F.explode("unfilled").alias(attribute))


def melt(wide: DataFrame, entity: Sequence[str] = ("subject_id", "task_scope")) -> DataFrame:
    """Back to one row per filled cell, with values as doubles; the inverse of ``widen`` on agreed cells."""
    columns = [c for c in wide.columns if c not in {*entity, "unfilled"}]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric_id"), F.col(c).cast("double").alias("value")) for c in columns])
    return wide.select(*entity, F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("_p")).select(*entity, "_p.metric_id", "_p.value")
