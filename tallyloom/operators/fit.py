"""Small models fitted from aggregates: each step is one pass that returns a few numbers to the driver."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import vectors as V
from tallyloom.operators import evaluate as E
from tallyloom.session import materialise


def ridge(df: DataFrame, inputs: Sequence[str], targets: Sequence[str], alpha: float = 1.0) -> dict[str, tuple[float, list[float]]]:
    """Intercept and weights of each target on the inputs; the intercept is not shrunken.

    One pass sums the products of all pairs of columns; rows with a null take the
    column's mean. The system solved on the driver has as many rows as inputs.
    """
    if not inputs:
        means = df.agg(*[F.avg(t).alias(t) for t in targets]).first()
        return {t: (means[t] or 0.0, []) for t in targets}
    names = [*inputs, *targets]
    means = df.agg(*[F.avg(c).alias(c) for c in names]).first().asDict()
    centred = {c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) - F.lit(means[c] or 0.0) for c in names}
    pairs = [(a, b) for i, a in enumerate(inputs) for b in names[i:]]
    sums = df.agg(*[F.sum(centred[a] * centred[b]).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]).first()
    at = {p: sums[f"_{i}"] or 0.0 for i, p in enumerate(pairs)}
    k = len(inputs)
    gram = np.array([[at.get((a, b), at.get((b, a))) for b in inputs] for a in inputs]) + alpha * np.eye(k)
    out = {}
    for t in targets:
        w = np.linalg.solve(gram, np.array([at[a, t] for a in inputs]))
        out[t] = ((means[t] or 0.0) - float(sum(x * (means[a] or 0.0) for x, a in zip(w, inputs, strict=True))), [float(x) for x in w])
    return out


def residuals(df: DataFrame, inputs: Sequence[str], targets: Sequence[str], model: dict[str, tuple[float, list[float]]]) -> DataFrame:
    """The table with each target less what the inputs predict; a null input predicts null."""
    out = {}
    for t in targets:
        b, w = model[t]
        out[t] = F.col(t) - (sum((F.lit(x) * F.col(a) for x, a in zip(w, inputs, strict=True)), F.lit(0.0)) + b)
    return df.withColumns(out)


def logistic(df: DataFrame, inputs: Sequence[Column], positive: Column, l2: float = 1e-6, weight: Column | None = None, steps: int = 30) -> list[float]:
    """Intercept and weights of a binary logistic regression by Newton steps, one aggregate a step.

    Rows with a null in an input, the target or the weight do not count. Stops when
    no weight moves by 1e-10. The intercept is not shrunken.
    """
    k = len(inputs) + 1
    base = df.select(*[x.cast("double").alias(f"_x{i + 1}") for i, x in enumerate(inputs)], positive.cast("double").alias("_y"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("_w")).na.drop()
    xs = [F.lit(1.0)] + [F.col(f"_x{i}") for i in range(1, k)]
    at = np.zeros(k)
    for _ in range(steps):
        p = V.sigmoid(sum((F.lit(float(a)) * x for a, x in zip(at, xs, strict=True)), F.lit(0.0)), 35.0)
        sums = [F.sum(F.col("_w") * (F.col("_y") - p) * x).alias(f"_g{i}") for i, x in enumerate(xs)]
        sums += [F.sum(F.col("_w") * p * (1 - p) * xs[i] * xs[j]).alias(f"_h{i}_{j}") for i in range(k) for j in range(i, k)]
        r = base.agg(*sums).first()
        if r["_g0"] is None:
            raise ValueError("no row to fit on")
        shrink = np.diag([0.0] + [l2] * (k - 1))
        g = np.array([r[f"_g{i}"] for i in range(k)]) - shrink @ at
        h = np.array([[r[f"_h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + shrink + 1e-12 * np.eye(k)
        move = np.linalg.solve(h, g)
        move *= min(1.0, 5.0 / max(1e-12, float(np.abs(move).max())))
        at = at + move
        if float(np.abs(move).max()) < 1e-10:
            break
    return [float(x) for x in at]


@dataclass(frozen=True)
class Fit:
    """One of several logistic fits: its inputs, the rows it is fitted on, and its ridge."""

    inputs: Sequence[Column]
    rows: Column
    l2: float = 1e-6


def logistic_many(df: DataFrame, fits: Sequence[Fit], positive: Column, steps: int = 30) -> list[list[float]]:
    """Intercept and weights of several binary logistic regressions of one target, as ``logistic``; every Newton step is one pass for all of them.

    A row with a null in an input or the target does not count for that fit. A fit without rows has weights of 0.
    """
    width = max(len(f.inputs) for f in fits)
    # A row for each fit it belongs to; a fit with fewer inputs has zeros, which get no weight.
    parts = [F.struct(F.lit(n).alias("n"), f.rows.alias("own"), *[(f.inputs[i].cast("double") if i < len(f.inputs) else F.lit(0.0)).alias(f"x{i}") for i in range(width)]) for n, f in enumerate(fits)]
    long = df.select(positive.cast("double").alias("y"), F.explode(F.filter(F.array(*parts), lambda x: x["own"])).alias("_p")).select("y", "_p.n", *[f"_p.x{i}" for i in range(width)])
    base = materialise(long.na.drop(), "fits")
    k = width + 1
    at = np.zeros((len(fits), k))
    xs = [F.lit(1.0)] + [F.col(f"x{i}") for i in range(width)]
    p = V.sigmoid(sum((F.col(f"a{i}") * x for i, x in enumerate(xs)), F.lit(0.0)), 35.0)
    scored = [F.col("n"), *[x.alias(f"v{i}") for i, x in enumerate(xs)], (F.col("y") - p).alias("e"), (p * (1 - p)).alias("w")]
    v = [F.col(f"v{i}") for i in range(k)]
    sums = [F.sum(F.col("e") * x).alias(f"g{i}") for i, x in enumerate(v)] + [F.sum(F.col("w") * v[i] * v[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
    for _ in range(steps):
        # The weights come as rows, so every step is the same compiled plan.
        weights = df.sparkSession.createDataFrame([(n, *map(float, a)) for n, a in enumerate(at)], "n int, " + ", ".join(f"a{i} double" for i in range(k)))
        moved = 0.0
        for r in base.join(F.broadcast(weights), "n").select(*scored).groupBy("n").agg(*sums).collect():  # a row a fit
            shrink = np.diag([0.0] + [fits[r.n].l2] * width)
            g = np.array([r[f"g{i}"] for i in range(k)]) - shrink @ at[r.n]
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + shrink + 1e-12 * np.eye(k)
            move = np.linalg.solve(h, g)
            move *= min(1.0, 5.0 / max(1e-12, float(np.abs(move).max())))
            at[r.n] += move
            moved = max(moved, float(np.abs(move).max()))
        if moved < 1e-10:
            break
    return [[float(x) for x in a[: len(f.inputs) + 1]] for a, f in zip(at, fits, strict=True)]


def linear(weights: Sequence[float], inputs: Sequence[Column]) -> Column:
    """Probability of a logistic fit."""
    return V.sigmoid(sum((F.lit(w) * x.cast("double") for w, x in zip(weights[1:], inputs, strict=True)), F.lit(weights[0])), 35.0)


def left_out(df: DataFrame, branches: Mapping[str, tuple[Sequence[Column], float]], positive: Column, fold: str, folds: int) -> DataFrame:
    """``df`` with the probability of each branch (inputs and ridge) from the fit that left the row's fold out; all branches and folds are fitted together."""
    fits = [Fit(inputs, F.col(fold) != k, l2) for inputs, l2 in branches.values() for k in range(folds)]
    weights = iter(logistic_many(df, fits, positive))
    out = {}
    for name, (inputs, _) in branches.items():
        own = F.lit(None).cast("double")
        for k in range(folds):
            own = F.when(F.col(fold) == k, linear(next(weights), inputs)).otherwise(own)
        out[name] = own
    return df.withColumns(out)


def branch_reliability(df: DataFrame, branches: Sequence[str], positive: Column) -> DataFrame:
    """branch, auroc of its left-out scores, and reliability: how far it lies above one half, 0 to 1."""
    long = df.select(positive.alias("positive"), F.explode(F.array(*[F.struct(F.lit(b).alias("branch"), F.col(b).alias("score")) for b in branches])).alias("x")).select("x.*", "positive")
    a = E.auroc(long.where(F.col("score").isNotNull()), ["branch"], "score", "positive")
    return a.select("branch", "auroc", F.greatest(F.lit(0.0), 2 * F.coalesce("auroc", F.lit(0.5)) - 1).alias("reliability"))


def calibration(scores: DataFrame, score: str, positive: str) -> tuple[float, float]:
    """Intercept and slope of the outcome on the logit of the score (bounded to 1e-5 from 0 and 1)."""
    s = F.greatest(F.lit(1e-5), F.least(F.lit(1 - 1e-5), F.col(score)))
    b, w = logistic(scores, [F.log(s / (1 - s))], F.col(positive))
    return b, w


def temperature(predictions: DataFrame, low: float = 0.5, high: float = 5.0, rounds: int = 6, points: int = 9) -> float:
    """The temperature of least log loss: each round tries a grid in one pass and narrows to its best cell."""
    for _ in range(rounds):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        losses = predictions.agg(*[F.avg(V.log_loss(V.temperature(F.col("probs"), t), F.col("truth"))).alias(f"_{i}") for i, t in enumerate(grid)]).first()
        if losses[0] is None:
            return 1.0
        best = min(range(points), key=lambda i: losses[i])
        low, high = grid[max(0, best - 1)], grid[min(points - 1, best + 1)]
    return (low + high) / 2


def stable_offsets(folds: DataFrame, agreement: float = 0.8, least: int = 3) -> DataFrame:
    """class and selected offset: the median over folds where their sign agrees, else 0. folds: fold, class, offset."""
    c = folds.groupBy("class").agg(F.count_if(F.col("offset") > 0).alias("_p"), F.count_if(F.col("offset") < 0).alias("_n"), F.count("*").alias("_k"), F.median("offset").alias("_m"))
    most = F.greatest("_p", "_n")
    return c.select("class", F.when((most >= least) & (most / F.col("_k") >= agreement), F.col("_m")).otherwise(0.0).alias("offset"))


def over_grid(predictions: DataFrame, name: str, grid: Sequence[float], blended, classes: int) -> DataFrame:
    """One row of ``summary`` for each value of a grid, in one pass. blended: the probability column for a value column."""
    p = predictions.withColumn(name, F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    p = p.withColumn("probs", blended(F.col(name))).withColumn("predicted", V.argmax(F.col("probs")))
    return E.summary(p, [name], classes)


def choose_strength(rows: DataFrame, name: str, gain: float = 0.0, margin: float = 0.001) -> float:
    """The strength of best macro F1 that gains more than ``gain`` over strength 0 and keeps accuracy within ``margin``; else 0.

    rows: one a strength, as ``over_grid`` gives them. Ties go to the least strength.
    """
    got = {r[name]: r for r in rows.select(name, "macro_f1", "accuracy").collect()}
    if 0.0 not in got:
        raise ValueError("the grid needs strength 0")
    base = got[0.0]
    ok = [r for s, r in got.items() if s and r.macro_f1 > base.macro_f1 + gain and r.accuracy >= base.accuracy - margin]
    return min(ok, key=lambda r: (-r.macro_f1, r[name]))[name] if ok else 0.0


def choose_offsets(predictions: DataFrame, grid: Sequence[float], classes: int) -> tuple[float, ...]:
    """Logit offsets by class, the first 0, of best macro F1, then least log loss: all combinations in one pass.

    grid ** (classes - 1) combinations are exploded by row, so keep the grid short.
    """
    combos = [(0.0, *c) for c in itertools.product([float(g) for g in grid], repeat=classes - 1)]
    p = predictions.withColumn("offsets", F.explode(F.array(*[F.array(*map(F.lit, c)) for c in combos])))
    p = p.withColumn("probs", V.offset(F.col("probs"), F.col("offsets"))).withColumn("predicted", V.argmax(F.col("probs")))
    rows = E.summary(p, ["offsets"], classes).select("offsets", "macro_f1", "log_loss").collect()
    best = max(rows, key=lambda r: (round(r.macro_f1, 12), -r.log_loss, [-abs(x) for x in r.offsets]))
    return tuple(best.offsets)


def guard(folds: DataFrame, small: bool, noninferior: float = 0.6, better: float = 0.4, tolerance: float = 1e-6) -> DataFrame:
    """One row that says whether a correction is dropped. folds: fold (null for the whole), base, final.

    It is dropped if it is worse overall, or if the sample is small and too few
    folds are no worse or too few are better.
    """
    d = F.col("final") - F.col("base")
    a = folds.agg(F.avg(F.when(F.col("fold").isNotNull(), (d >= -tolerance).cast("double"))).alias("noninferior_share"), F.avg(F.when(F.col("fold").isNotNull(), (d > tolerance).cast("double"))).alias("better_share"), F.min(F.when(F.col("fold").isNull(), d)).alias("_all"))
    dropped = (F.coalesce("_all", F.lit(0.0)) < -tolerance) | (F.lit(small) & ((F.col("noninferior_share") < noninferior) | (F.col("better_share") < better)))
    return a.select("noninferior_share", "better_share", F.coalesce(dropped, F.lit(False)).alias("dropped"))


def state_support(values: DataFrame, prototypes: DataFrame, unit: str) -> DataFrame:
    """unit, label and support: softmax over labels of the negative weighted distance to the labels' prototypes.

    values: unit, state, value. prototypes (a small table): state, label, center,
    scale, weight. States a unit lacks do not count; a unit without any has no row.
    """
    d = values.join(prototypes, "state").groupBy(unit, "label").agg((F.sum(F.col("weight") * F.abs(F.col("value") - F.col("center")) / F.col("scale")) / F.sum("weight")).alias("_d"))
    from pyspark.sql import Window as W

    w = W.partitionBy(unit)
    e = F.exp(F.min("_d").over(w) - F.col("_d"))
    return d.withColumn("_e", e).select(unit, "label", (F.col("_e") / F.sum("_e").over(w)).alias("support"))


#: Labels whose rows are counted on the driver.
MAX_LABELS = 10_000


def balanced_weights(df: DataFrame, label: str) -> Column:
    """Row weights that give every label the same total: rows over labels times the label's rows. More than ``MAX_LABELS`` labels raise."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().limit(MAX_LABELS + 1).collect()}
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    total = sum(counts.values())
    return F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() if k is not None for x in (k, total / (len(counts) * n))]), F.col(label))


def multinomial(df: DataFrame, features: Sequence[str], label: str, c: float = 1.0):
    """Pipeline of median imputation, missing indicators, scaling and balanced multinomial logistic regression, fitted.

    ``label`` holds places from 0. The result is a pyspark.ml model whose
    ``probability`` is in order of place.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    prepared = with_indicators(df, features).withColumn("_weight", balanced_weights(df, label))
    n = prepared.count()
    filled = [f"_f_{f}" for f in features]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=list(features), outputCols=filled),
            VectorAssembler(inputCols=[*filled, *[f"_m_{f}" for f in features]], outputCol="_raw"),
            StandardScaler(withMean=True, inputCol="_raw", outputCol="_scaled"),
            LogisticRegression(featuresCol="_scaled", labelCol=label, weightCol="_weight", family="multinomial", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, maxIter=200, standardization=False),
        ]
    ).fit(prepared)


def with_indicators(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles with nulls as NaN for the imputer, and a 0/1 column for each that is missing."""
    out = df
    for f in features:
        x = F.col(f).cast("double")
        gone = x.isNull() | F.isnan(x)
        out = out.withColumn(f"_m_{f}", gone.cast("double")).withColumn(f, F.when(gone, F.lit(math.nan)).otherwise(x))
    return out
