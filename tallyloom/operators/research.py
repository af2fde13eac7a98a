"""Overlap and inference studies over long measurements."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyloom.operators import prefix
from tallyloom.operators.sequence import average_rank
from tallyloom.session import materialise


def pairs_long(df: DataFrame, keys: Sequence[str], unit: str, metric: str, value: str) -> DataFrame:
    """Values of two metrics of one unit side by side, each unordered pair once: keys, unit, a, b, x, y.

    A unit's metrics meet by equality on the unit; their number is bounded by the
    registry of metrics, so a unit gives a bounded number of pairs.
    """
    left = df.select(*keys, unit, F.col(metric).alias("a"), F.col(value).alias("x"))
    right = df.select(*keys, unit, F.col(metric).alias("b"), F.col(value).alias("y"))
    return left.join(right, [*keys, unit]).where("a < b")


#: Units of one pair of metrics that a task ranks at once; where a pair has more, running counts spread it over tasks, with the same ranks.
RANKED_UNITS = 2_000_000


def spearman(df: DataFrame, keys: Sequence[str], unit: str, metric: str, value: str) -> DataFrame:
    """keys, a, b, n and rho of every pair of metrics over the units that have both; null where a side is constant.

    Ranks are of the values of a pair's common units, so each pair has its own. The
    units of the largest pair are counted first (``RANKED_UNITS``).
    """
    p = materialise(pairs_long(df, keys, unit, metric, value), "spearman-pairs")
    group = [*keys, "a", "b"]
    most = p.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if most <= RANKED_UNITS:
        both = p.withColumns({"_rx": average_rank(group, "x"), "_ry": average_rank(group, "y")})
    else:
        both = prefix.average_ranks(prefix.average_ranks(p, group, "x", "_rx"), group, "y", "_ry")
    out = both.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.col("_rx") * F.col("_ry")).alias("_xy"), F.sum(F.col("_rx") ** 2).alias("_qx"), F.sum(F.col("_ry") ** 2).alias("_qy"))
    # Ranks always have the mean (n + 1) / 2.
    middle = F.col("n") * ((F.col("n") + 1) / 2.0) ** 2
    cov, vx, vy = F.col("_xy") - middle, F.col("_qx") - middle, F.col("_qy") - middle
    return out.select(*group, "n", F.when((vx > 1e-9) & (vy > 1e-9), cov / F.sqrt(vx * vy)).alias("rho"))


def copies(df: DataFrame, keys: Sequence[str], unit: str, metric: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """For every pair of metrics: n, whether all values are equal, all sum to 1, and the slope, intercept and largest residual of the line of y on x; null where x is constant."""
    p = materialise(pairs_long(df, keys, unit, metric, value), "copies")
    spread = F.var_pop("x")
    slope = F.when(spread > 1e-12, F.covar_pop("x", "y") / spread)
    g = p.groupBy(*keys, "a", "b").agg(
        F.count("*").alias("n"), F.bool_and(F.abs(F.col("x") - F.col("y")) <= tolerance).alias("equal"), F.bool_and(F.abs(F.col("x") + F.col("y") - 1) <= tolerance).alias("complement"),
        slope.alias("slope"), (F.avg("y") - slope * F.avg("x")).alias("intercept"),
    )
    # The pairs of metrics are few beside the units.
    line = g.select(*[F.col(k).alias(f"_k{k}") for k in (*keys, "a", "b")], F.col("slope").alias("_s"), F.col("intercept").alias("_i"))
    on = prefix.same([*keys, "a", "b"], "_k")
    off = p.join(line, on).groupBy(*keys, "a", "b").agg(F.max(F.abs(F.col("y") - F.col("_i") - F.col("_s") * F.col("x"))).alias("largest_residual"))
    return g.join(off.select(*[F.col(k).alias(f"_k{k}") for k in (*keys, "a", "b")], "largest_residual"), on).select(*g.columns, "largest_residual")


#: Groups of one item that are paired in one task; the pairs of an item in more groups come from several.
GROUP_BLOCK = 1000


def jaccard(df: DataFrame, group: str, item: str) -> DataFrame:
    """Shared items over all items of each two groups that share one: a, b, shared, jaccard. Pairs without a shared item are absent.

    An item's groups are cut into blocks by hash, and two blocks meet in one task,
    so an item that is in every group is paired by as many tasks as it needs. The
    result has a row per pair of groups; it is meant for groups of a registry.
    """
    d = materialise(df.select(F.col(group).alias("g"), F.col(item).alias("i")).where(F.col(item).isNotNull()).distinct(), "jaccard")
    size = d.groupBy("g").agg(F.count("*").alias("_n"))
    blocks = d.groupBy("i").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("_blocks"))
    cut = d.join(blocks, "i").withColumn("_own", F.pmod(F.xxhash64("g"), F.col("_blocks")).cast("int"))
    # Each row goes to the meetings of its block with every other; a block meets itself once.
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda x: F.struct(F.least(x, F.col("_own")).alias("lo"), F.greatest(x, F.col("_own")).alias("hi"))))
    sides = cut.select("g", "i", "_own", meets.alias("_m"))
    left, right = sides.select(F.col("g").alias("a"), "i", "_m", F.col("_own").alias("_oa")), sides.select(F.col("g").alias("b"), "i", "_m", F.col("_own").alias("_ob"))
    across = ((F.col("_m.lo") == F.col("_m.hi")) | (F.col("_oa") != F.col("_ob"))) & (F.col("a") < F.col("b"))
    shared = left.join(right, ["i", "_m"]).where(across).groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = shared.join(size.select(F.col("g").alias("a"), F.col("_n").alias("_na")), "a").join(size.select(F.col("g").alias("b"), F.col("_n").alias("_nb")), "b")
    return out.select("a", "b", "shared", (F.col("shared") / (F.col("_na") + F.col("_nb") - F.col("shared"))).alias("jaccard"))


def kruskal(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """n, groups, the tie-corrected Kruskal-Wallis h, its p_value and epsilon squared; null where all values are equal or one group is left."""
    held = materialise(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_c")), "kruskal")
    values = held.groupBy(*keys, "_v").agg(F.sum("_c").alias("_t"))
    ranks = prefix.running(values, keys, ["_v"], {"_below": "_t"})
    named = ranks.select(*[F.col(k).alias(f"_k{k}") for k in keys], F.col("_v").alias("_kv"), (F.col("_below") + (F.col("_t") + 1) / 2.0).alias("_r"))
    per = held.join(named, prefix.same(keys, "_k") & (F.col("_v") == F.col("_kv"))).groupBy(*keys, "_g").agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.col("_r")).alias("_s"))
    h = per.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("_q"))
    ties = values.groupBy(*keys).agg(F.sum(F.col("_t").cast("double") ** 3 - F.col("_t")).alias("_t")).select(*[F.col(k).alias(f"_k{k}") for k in keys], "_t")
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)
    fix = 1 - F.col("_t") / (n**3 - n)
    value_h = F.when((F.col("groups") > 1) & (n > 1) & (fix > 0), raw / fix)
    return h.join(ties, prefix.same(keys, "_k")).select(*keys, "n", "groups", value_h.alias("h"), chi_square_tail(value_h, F.col("groups") - 1).alias("p_value"), (value_h / (n - 1)).alias("epsilon2"))


@F.pandas_udf(DoubleType())
def chi_square_tail(x: pd.Series, freedom: pd.Series) -> pd.Series:
    """The upper tail of the chi-square distribution; null for null."""
    return pd.Series([None if h is None or h != h else _upper_gamma(float(f) / 2, float(h) / 2) for h, f in zip(x, freedom, strict=True)], dtype="float64")


def _upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function of a half-integer a: from its closed form at 1/2 or 1, by the recurrence in a."""
    if x <= 0:
        return 1.0
    at, tail = (0.5, math.erfc(math.sqrt(x))) if a % 1 else (1.0, math.exp(-x))
    while at < a:
        tail += math.exp(at * math.log(x) - x - math.lgamma(at + 1))
        at += 1
    return min(1.0, tail)


def benjamini_hochberg(df: DataFrame, keys: Sequence[str], p: str, order: str) -> DataFrame:
    """The table with ``q_value``: p times tests over rank, made monotone from the largest p down, at most 1. Null p has none.

    Equal p have the rank of the last of them, which the step down from larger p
    would give them anyway. Values of p are counted and ranked by running counts;
    the least ratio of a later part reaches a part as one number, so a family may
    hold any share of the tests. ``order`` is not needed to break ties and is kept
    for callers that name one.
    """
    values = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("_c"))
    ranked = prefix.running(values, keys, [p], {"_below": "_c"}, {"_m": "_c"}).withColumn("_raw", F.col(p) * F.col("_m") / (F.col("_below") + F.col("_c")))
    q = prefix.least_after(ranked, keys, [p], "_raw", "_q").select(*[F.col(k).alias(f"_k{k}") for k in keys], F.col(p).alias("_kp"), F.least(F.lit(1.0), F.col("_q")).alias("q_value"))
    return df.join(q, prefix.same(keys, "_k") & (F.col(p) == F.col("_kp")), "left").select(*df.columns, "q_value")


def effective_rank(df: DataFrame, keys: Sequence[str], unit: str, metric: str, value: str) -> DataFrame:
    """metrics, effective_rank (exp of the entropy of the eigenvalue shares), leading share and dims for 90 % of a group's rank correlations.

    Correlations are aggregated in Spark; what reaches a task is one group's matrix
    of metrics, whose side is bounded by the registry.
    """
    rho = spearman(df, keys, unit, metric, value).where("rho is not null")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["a"], *pdf["b"]})
        at = {m: i for i, m in enumerate(names)}
        c = np.eye(len(names))
        for a, b, r in zip(pdf["a"], pdf["b"], pdf["rho"], strict=True):
            c[at[a], at[b]] = c[at[b], at[a]] = r
        share = np.clip(np.linalg.eigvalsh(c)[::-1], 0, None)
        share = share / share.sum()
        kept = share[share > 0]
        out = {k: pdf[k].iloc[0] for k in keys} | {"metrics": len(names), "effective_rank": float(np.exp(-(kept * np.log(kept)).sum())), "leading_share": float(share[0]), "dims90": int(np.searchsorted(np.cumsum(share), 0.9 - 1e-12) + 1)}
        return pd.DataFrame([out])

    kinds = dict(df.dtypes)
    return rho.groupBy(*keys).applyInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", metrics int, effective_rank double, leading_share double, dims90 int")


def reachable(edges: DataFrame, start: DataFrame, rounds: int = 100) -> DataFrame:
    """Every node reachable from the start nodes along edges parent -> child, with its least depth.

    One join a round on the newest nodes only; each round is written to the shared
    folder, so lineage does not grow. Cycles end, as a node is entered once.
    """
    seen = materialise(start.select(F.col("node"), F.lit(0).alias("depth")).distinct(), "reach")
    new = seen
    for depth in range(1, rounds + 1):
        step = new.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti")
        new = materialise(step.select("node", F.lit(depth).alias("depth")), "reach")
        if new.isEmpty():
            return seen
        seen = materialise(seen.unionByName(new), "reach")
    raise RuntimeError(f"not settled after {rounds} rounds")


def linked_groups(pairs: DataFrame, items: DataFrame, a: str = "a", b: str = "b", item: str = "item", rounds: int = 50) -> DataFrame:
    """item, group (the least item of its group) and size; items without a pair are groups of their own.

    Least labels travel along the pairs until none changes, each round one join and
    a partial aggregation, written to the shared folder. Meant for graphs of short
    diameter, as thresholded correlations give.
    """
    both = materialise(pairs.select(F.col(a).alias("_p"), F.col(b).alias("_q")).unionByName(pairs.select(F.col(b).alias("_p"), F.col(a).alias("_q"))).distinct(), "groups-pairs")
    label = materialise(items.select(F.col(item).alias("item"), F.col(item).alias("group")).distinct(), "groups")
    for _ in range(rounds):
        near = both.join(label, F.col("_q") == F.col("item")).groupBy("_p").agg(F.min("group").alias("_g"))
        new = label.join(near, F.col("item") == F.col("_p"), "left").select("item", F.least("group", F.coalesce("_g", "group")).alias("group"), (F.col("_g") < F.col("group")).alias("_moved"))
        new = materialise(new, "groups")
        label = new.drop("_moved")
        if new.where("_moved").isEmpty():
            return label.withColumn("size", F.count("*").over(W.partitionBy("group")))
    raise RuntimeError(f"not settled after {rounds} rounds")


def term_vectors(texts: DataFrame, documents: DataFrame, doc_id: str, terms: str, least: int) -> DataFrame:
    """doc_id, term, weight and length: the sublinear term weight times the smoothed inverse document frequency, over the length of the document's vector.

    texts: doc_id and an array of terms, one row a document. documents: all of them,
    texts without terms too. Terms in fewer than ``least`` documents have no place.
    A document's counts are made before the shuffle; the lengths join back on its id.
    """
    tf = materialise(texts.select(doc_id, F.explode(terms).alias("term")).groupBy(doc_id, "term").agg(F.count("*").alias("n")), "terms")
    df = tf.groupBy("term").agg(F.count("*").alias("_d")).where(F.col("_d") >= least)
    docs = documents.agg(F.count("*").alias("_docs"))
    raw = (1 + F.log("n")) * (F.log((1 + F.col("_docs")) / (1 + F.col("_d"))) + 1)
    w = materialise(tf.join(df, "term").join(F.broadcast(docs)).select(doc_id, "term", raw.alias("_w")), "term-weights")
    length = w.groupBy(doc_id).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("length"))
    return w.join(length, doc_id).select(doc_id, "term", (F.col("_w") / F.col("length")).alias("weight"), "length")
