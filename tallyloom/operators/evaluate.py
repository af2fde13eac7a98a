"""Evaluation of predictions as aggregates: one pass over rows where the measure allows it.

Predictions: group columns, truth and predicted (places from 1 in the class
order), probs (array of doubles in that order).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyloom.functions import vectors as V
from tallyloom.operators import prefix
from tallyloom.session import materialise


def ratio(a: Column, b: Column) -> Column:
    """a over b; null where b is 0."""
    return F.when(b != 0, a / b)


def confusion(p: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """keys, truth, predicted, n for every pair of classes, zeros included."""
    counted = p.groupBy(*keys).agg(*[F.count_if((F.col("truth") == t) & (F.col("predicted") == q)).alias(f"_{t}_{q}") for t in range(1, classes + 1) for q in range(1, classes + 1)])
    cells = [F.struct(F.lit(t).alias("truth"), F.lit(q).alias("predicted"), F.col(f"_{t}_{q}").alias("n")) for t in range(1, classes + 1) for q in range(1, classes + 1)]
    return counted.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def per_class(p: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """precision, sensitivity, specificity, f1 and support by class; null where a denominator is 0."""
    c = confusion(p, keys, classes)
    w, t = W.partitionBy(*keys), W.partitionBy(*keys, "truth")
    q = W.partitionBy(*keys, "predicted")
    full = c.withColumn("_all", F.sum("n").over(w)).withColumn("_support", F.sum("n").over(t)).withColumn("_called", F.sum("n").over(q)).where("truth = predicted")
    tp, fn, fp = F.col("n"), F.col("_support") - F.col("n"), F.col("_called") - F.col("n")
    tn = F.col("_all") - tp - fn - fp
    return full.select(*keys, F.col("truth").alias("class"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), F.col("_support").alias("support"))


def summary(p: DataFrame, keys: Sequence[str], classes: int, bins: int = 10) -> DataFrame:
    """n, accuracy, balanced_accuracy, macro_f1, weighted_f1, mcc, brier, log_loss, near_threshold and high_confidence_error."""
    t, q, probs = F.col("truth"), F.col("predicted"), F.col("probs")
    confidence = F.array_max(probs)
    cells = [F.count_if((t == i) & (q == j)).alias(f"_{i}_{j}") for i in range(1, classes + 1) for j in range(1, classes + 1)]
    agg = p.groupBy(*keys).agg(
        F.count("*").alias("n"), *cells, F.avg(V.brier(probs, t)).alias("brier"), F.avg(V.log_loss(probs, t)).alias("log_loss"),
        F.avg((V.margin(probs) <= 0.10).cast("double")).alias("near_threshold"), F.avg(((t != q) & (confidence >= 0.80)).cast("double")).alias("high_confidence_error"),
    )
    at = lambda i, j: F.col(f"_{i}_{j}")
    r = range(1, classes + 1)
    total = lambda xs: sum(xs, F.lit(0))
    support = {i: total(at(i, j) for j in r) for i in r}
    called = {j: total(at(i, j) for i in r) for j in r}
    recall = [ratio(at(i, i), support[i]) for i in r]
    f1 = [F.coalesce(ratio(2 * at(i, i), support[i] + called[i]), F.lit(0.0)) for i in r]
    present = total(F.when(support[i] > 0, 1).otherwise(0) for i in r)
    right = total(at(i, i) for i in r)
    n = F.col("n")
    cov = right * n - total(support[i] * called[i] for i in r)
    left = n * n - total(called[i] * called[i] for i in r)
    down = n * n - total(support[i] * support[i] for i in r)
    return agg.select(
        *keys, "n", (right / n).alias("accuracy"), (total(F.coalesce(x, F.lit(0.0)) for x in recall) / present).alias("balanced_accuracy"), (total(f1) / classes).alias("macro_f1"),
        (total(f * support[i] for i, f in zip(r, f1, strict=True)) / n).alias("weighted_f1"), F.when((left > 0) & (down > 0), cov / F.sqrt(left.cast("double") * down.cast("double"))).otherwise(0.0).alias("mcc"),
        "brier", "log_loss", "near_threshold", "high_confidence_error",
    )


def auroc(scores: DataFrame, keys: Sequence[str], score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by ranks, equal scores half each; null with one class only.

    Scores are counted by distinct value first, and their running counts spread
    over tasks however many values a key has.
    """
    v = scores.groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("_p"), F.count_if(~F.col(positive)).alias("_n"))
    held = prefix.running(v, keys, [score], {"_below": "_n"}).withColumn("_w", F.col("_p") * (F.col("_below") + F.col("_n") / 2.0))
    return held.groupBy(*keys).agg(F.sum("_w").alias("_w"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n")).select(*keys, ratio(F.col("_w"), F.col("_p").cast("double") * F.col("_n")).alias("auroc"))


def average_precision(scores: DataFrame, keys: Sequence[str], score: str, positive: str) -> DataFrame:
    """Sum over distinct thresholds of precision times the gain in recall; null without a positive."""
    v = scores.groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("_p"), F.count("*").alias("_c"))
    held = prefix.running(v, keys, [score], {"_p_below": "_p", "_c_below": "_c"}, {"_p_all": "_p", "_c_all": "_c"})
    # At a threshold: everything that is not below it.
    precision = (F.col("_p_all") - F.col("_p_below")) / (F.col("_c_all") - F.col("_c_below"))
    return held.groupBy(*keys).agg(F.sum(F.col("_p") * precision).alias("_s"), F.sum("_p").alias("_all")).select(*keys, ratio(F.col("_s"), F.col("_all")).alias("average_precision"))


def one_vs_rest(p: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """keys, class, score and positive: each prediction once per class."""
    each = F.explode(F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda c: F.struct(c.alias("class"), F.element_at("probs", c).alias("score"), (F.col("truth") == c).alias("positive"))))
    return p.select(*keys, each.alias("_x")).select(*keys, "_x.*")


def averaged(p: DataFrame, keys: Sequence[str], classes: int, measure: Callable[..., DataFrame], name: str) -> DataFrame:
    """keys and the macro (mean of the classes that have a value), weighted (by support) and micro (all pairs as one class) form of a measure of scores."""
    long = materialise(one_vs_rest(p, keys, classes), "one-vs-rest")
    by = measure(long, [*keys, "class"], "score", "positive")
    support = long.groupBy(*keys, "class").agg(F.count_if("positive").alias("_n"))
    m = F.col(name)
    per = by.join(support.select(*[F.col(k).alias(f"_k{k}") for k in (*keys, "class")], "_n"), prefix.same([*keys, "class"], "_k"))
    macro = per.groupBy(*keys).agg(F.avg(m).alias("macro"), ratio(F.sum(m * F.col("_n")), F.sum(F.when(m.isNotNull(), F.col("_n")))).alias("weighted"))
    micro = measure(long, keys, "score", "positive").select(*[F.col(k).alias(f"_k{k}") for k in keys], m.alias("micro"))
    return macro.join(micro, prefix.same(keys, "_k")).select(*keys, "macro", "micro", "weighted")


def expected_calibration_error(p: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Mean gap of accuracy and confidence over equal bins (lo, hi]; a confidence of 0 is in none."""
    c = F.array_max("probs")
    rows = p.select(*keys, F.ceil(c * bins).alias("_b"), c.alias("_c"), (F.col("truth") == F.col("predicted")).cast("double").alias("_r"))
    per = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"), F.avg("_c").alias("_c"), F.avg("_r").alias("_r"))
    return per.groupBy(*keys).agg((F.sum(F.when(F.col("_b") > 0, F.col("_n") * F.abs(F.col("_r") - F.col("_c"))).otherwise(0.0)) / F.sum("_n")).alias("ece"))


def operating_point(scores: DataFrame, keys: Sequence[str], score: str, positive: str, threshold: float) -> DataFrame:
    """sensitivity, specificity, ppv and npv at a locked threshold."""
    yes = F.col(score) >= min(1.0, max(0.0, threshold))
    a = scores.groupBy(*keys).agg(F.count_if(yes & F.col(positive)).alias("tp"), F.count_if(~yes & F.col(positive)).alias("fn"), F.count_if(yes & ~F.col(positive)).alias("fp"), F.count_if(~yes & ~F.col(positive)).alias("tn"))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return a.select(*keys, ratio(tp, tp + fn).alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"), ratio(tp, tp + fp).alias("ppv"), ratio(tn, tn + fn).alias("npv"))


@F.pandas_udf(DoubleType())
def _two_sided(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([binomial_p_value(int(x), int(y)) for x, y in zip(a, b, strict=True)])


def binomial_p_value(a: int, b: int) -> float:
    """Exact two-sided p-value of a and b under even odds.

    The tail is summed from its largest term down, in blocks, until the terms no
    longer count: some ten times the root of a + b terms, however large they are.
    """
    n, k = a + b, min(a, b)
    if n == 0:
        return 1.0
    first = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2.0))
    total, term, i = first, first, k
    while i > 0 and term > total * 1e-18:
        step = np.arange(i, max(0, i - 4096), -1, dtype=float)
        terms = term * np.cumprod(step / (n - step + 1))
        total, term, i = total + float(terms.sum()), float(terms[-1]), i - len(step)
    return min(1.0, 2.0 * total)


def mcnemar(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Discordant counts of two boolean columns and the exact two-sided p-value, one row a key."""
    c = df.groupBy(*keys).agg(F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))
    return c.select(*keys, "only_a", "only_b", _two_sided("only_a", "only_b").alias("p_value"))


def draw(replicate: Column, row: Column, n: Column) -> Column:
    """A row number 0..n-1 from a replicate and a draw number: a linear congruential step, the same in any engine."""
    return ((replicate * 7919 + row * 104729 + replicate * row * 31 + 12345) * 1103515245 + 12345) % 2147483648 % n


def bootstrap_mean(df: DataFrame, order: str, value: str, replicates: int) -> DataFrame:
    """replicate and mean of a resample of the rows with replacement, for each replicate.

    Draws are counted by row and replicate and joined to the rows once: values
    never multiply before the join, and the draws are what is distributed.
    """
    rows = materialise(prefix.numbered(df.select(F.col(order).alias("_o"), F.col(value).alias("_v")), ["_o", "_v"], "_i"), "bootstrap")
    return resampled(rows, replicates).groupBy("replicate").agg((F.sum(F.col("_c") * F.col("_v")) / F.sum("_c")).alias("mean"))


def resampled(rows: DataFrame, replicates: int, first: int = 0) -> DataFrame:
    """The numbered rows (``_i`` from 0) that each replicate, from ``first`` on, draws, and how often (``_c``)."""
    n = rows.agg(F.count("*").alias("_n"))
    reps = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + replicates - 1).cast("long"))).alias("replicate")
    # One draw for each row and replicate: the rows say how many, so no sequence is built.
    draws = rows.select("_i", reps).join(F.broadcast(n)).select("replicate", draw(F.col("replicate"), F.col("_i"), F.col("_n")).alias("_d"))
    counted = draws.groupBy("replicate", "_d").agg(F.count("*").alias("_c"))
    return counted.join(rows, F.col("_d") == F.col("_i")).drop("_d")


#: Of a bootstrap, how many times the wanted replicates are drawn at most while some are not valid.
ATTEMPTS = 8


def _from_counts(classes: int, name: str) -> dict[str, Column]:
    """accuracy, balanced_accuracy and macro_f1 of the weighted counts ``{name}_i_j``."""
    at = lambda i, j: F.col(f"{name}_{i}_{j}")
    r = range(1, classes + 1)
    total = lambda xs: sum(xs, F.lit(0))
    support, called = {i: total(at(i, j) for j in r) for i in r}, {j: total(at(i, j) for i in r) for j in r}
    f1 = [F.coalesce(ratio(2 * at(i, i), support[i] + called[i]), F.lit(0.0)) for i in r]
    return {
        "accuracy": total(at(i, i) for i in r) / total(support.values()),
        "balanced_accuracy": total(ratio(at(i, i), support[i]) for i in r) / classes,
        "macro_f1": total(f1) / classes,
    }


def _replicates(p: DataFrame, order: str, predicted: Sequence[str], replicates: int, classes: int) -> DataFrame:
    """The first valid replicates with the counts of each predicted column; valid ones hold every class.

    Rounds of ``replicates`` draws follow until enough are valid, ``ATTEMPTS`` at most.
    """
    rows = materialise(prefix.numbered(p.select(F.col(order).alias("_o"), "truth", *predicted), ["_o"], "_i"), "bootstrap")
    r = range(1, classes + 1)
    found = None
    for attempt in range(ATTEMPTS):
        cells = [F.sum(F.when((F.col("truth") == i) & (F.col(c) == j), F.col("_c")).otherwise(0)).alias(f"{c}_{i}_{j}") for c in predicted for i in r for j in r]
        drawn = resampled(rows, replicates, attempt * replicates).groupBy("replicate").agg(*cells)
        every = F.lit(True)
        for i in r:
            every = every & (sum((F.col(f"{predicted[0]}_{i}_{j}") for j in r), F.lit(0)) > 0)
        found = drawn.where(every) if found is None else found.unionByName(drawn.where(every))
        found = materialise(found, "replicates")
        if found.count() >= replicates:
            break
    return found.orderBy("replicate").limit(replicates)


def bootstrap_intervals(p: DataFrame, order: str, predicted: str = "predicted", replicates: int = 200, classes: int = 3) -> DataFrame:
    """measure, estimate on the rows themselves, ci_low and ci_high (2.5 and 97.5 percent of the replicates) and replicates used."""
    return _intervals(p, order, [predicted], replicates, classes)


def paired_bootstrap(p: DataFrame, order: str, a: str, b: str, replicates: int = 200, classes: int = 3) -> DataFrame:
    """The same of what predictions a gain over b on the same draws, with the discordant counts and the exact p-value of McNemar's test."""
    out = _intervals(p, order, [a, b], replicates, classes)
    hits = p.select((F.col(a) == F.col("truth")).alias("_a"), (F.col(b) == F.col("truth")).alias("_b"))
    return out.join(F.broadcast(mcnemar(hits, [], "_a", "_b")))


def _intervals(p: DataFrame, order: str, predicted: Sequence[str], replicates: int, classes: int) -> DataFrame:
    r = range(1, classes + 1)
    measures = [_from_counts(classes, c) for c in predicted]
    value = {m: measures[0][m] - measures[1][m] if len(predicted) > 1 else measures[0][m] for m in measures[0]}
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), x.cast("double").alias("value")) for m, x in value.items()])).alias("x")
    drawn = _replicates(p, order, predicted, replicates, classes).select(long).select("x.*")
    whole = p.agg(*[F.count_if((F.col("truth") == i) & (F.col(c) == j)).alias(f"{c}_{i}_{j}") for c in predicted for i in r for j in r]).select(long).select(F.col("x.measure").alias("_m"), F.col("x.value").alias("estimate"))
    # As many rows a measure as replicates.
    per = drawn.groupBy("measure").agg(F.percentile("value", 0.025).alias("ci_low"), F.percentile("value", 0.975).alias("ci_high"), F.count("*").alias("replicates"))
    return per.join(whole, F.col("measure") == F.col("_m")).select("measure", "estimate", "ci_low", "ci_high", "replicates")
