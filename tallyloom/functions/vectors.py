"""Probability vectors: arrays of doubles in a fixed class order, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def is_simplex(p: Column, tolerance: float = 1e-6) -> Column:
    """Non-null, finite, each between 0 and 1, sum 1; false for null. Never repaired."""
    return F.coalesce(F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1)) & (F.abs(total(p) - 1) <= tolerance), F.lit(False))


def normalise(p: Column) -> Column:
    """Non-negative parts over their sum; uniform where nothing positive is left. Null and NaN parts count as 0."""
    kept = F.transform(p, lambda x: F.when(x.isNull() | F.isnan(x) | (x < 0), 0.0).otherwise(x))
    return let(kept, lambda k: let(total(k), lambda s: F.transform(k, lambda x: F.when(s > 0, x / s).otherwise(1.0 / F.size(k)))))


def softmax(z: Column) -> Column:
    powers = let(z, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    return let(powers, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def logs(p: Column, floor: float = TINY) -> Column:
    return F.transform(p, lambda x: F.log(F.greatest(x, F.lit(floor))))


def temperature(p: Column, t: float) -> Column:
    """Softmax of the logarithms over ``t``."""
    return softmax(F.transform(logs(p), lambda x: x / t))


def offset(p: Column, by: Column) -> Column:
    """Softmax of the logarithms plus offsets by class."""
    return softmax(F.zip_with(logs(p), by, lambda a, b: a + b))


def log_pool(p: Column, q: Column, weight: Column | float) -> Column:
    """Log opinion pool: ``weight`` of q, the rest of p."""
    w = F.lit(weight) if isinstance(weight, (int, float)) else weight
    return softmax(F.zip_with(logs(p), logs(q), lambda a, b: (1 - w) * a + w * b))


def blend(base: Column, target: Column, strength: Column) -> Column:
    """base moved toward target by ``strength``; exactly base where strength is 0."""
    return F.when(strength == 0, base).otherwise(F.zip_with(base, target, lambda a, b: a + strength * (b - a)))


def evidence_gate(coverage: Column, reliability: Column, missing: Column) -> Column:
    """sqrt(coverage x reliability) x sqrt(1 - missing), parts bounded to 0..1."""
    one = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))
    return F.sqrt(one(coverage) * one(reliability)) * F.sqrt(1 - one(missing))


def entropy(p: Column) -> Column:
    """Shannon entropy over the logarithm of the number of classes; 0 log 0 is 0."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0)) / F.log(F.size(p).cast("double"))


def margin(p: Column) -> Column:
    """Largest minus second largest."""
    s = F.sort_array(p, asc=False)
    return F.element_at(s, 1) - F.element_at(s, 2)


def argmax(p: Column) -> Column:
    """Place (from 1) of the largest part, the first of equals."""
    return F.array_position(p, F.array_max(p)).cast("int")


def centred_logits(p: Column, bound: float) -> Column:
    """Logarithms less their mean, bounded to +-bound."""
    z = logs(p)
    mean = total(z) / F.size(z)
    return F.transform(z, lambda x: F.greatest(F.lit(-bound), F.least(F.lit(bound), x - mean)))


def zero_sum(delta: Column, bound: float) -> Column:
    """A correction recentred to sum 0 and scaled so that no part exceeds the bound."""
    mean = total(delta) / F.size(delta)
    c = F.transform(delta, lambda x: x - mean)
    most = F.array_max(F.transform(c, F.abs))
    return F.when(most > bound, F.transform(c, lambda x: x * bound / most)).otherwise(c)


def capped_weights(w: Column, cap: float, rounds: int) -> Column:
    """Weights on the simplex with no part above ``cap``: what exceeds it is spread over the others in proportion.

    ``rounds`` is at most the number of parts; a cap below 1 / parts gives the uniform weights.
    """
    def spread(out: Column) -> Column:
        over = F.aggregate(out, F.lit(0.0), lambda a, x: a + F.greatest(x - cap, F.lit(0.0)))
        room = F.aggregate(out, F.lit(0.0), lambda a, x: a + F.when(x < cap, x).otherwise(0.0))
        return let(over, lambda o: let(room, lambda r: F.transform(out, lambda x: F.when(x >= cap, F.lit(float(cap))).otherwise(F.when(r > 0, x + o * x / r).otherwise(x)))))

    out = normalise(w)
    for _ in range(rounds):
        out = let(out, spread)
    return F.when(F.size(w) * cap <= 1, F.transform(w, lambda x: 1.0 / F.size(w))).otherwise(out)


def brier(p: Column, truth: Column) -> Column:
    """Sum of squared differences to the one-hot truth (its place from 1)."""
    return F.aggregate(F.transform(p, lambda x, i: F.pow(x - F.when(i + 1 == truth, 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, x: a + x)


def log_loss(p: Column, truth: Column, floor: float = 1e-15) -> Column:
    return -F.log(F.greatest(F.lit(floor), F.least(F.lit(1 - floor), F.element_at(p, truth))))


def sigmoid(x: Column, bound: float | None = None) -> Column:
    z = x if bound is None else F.greatest(F.lit(-bound), F.least(F.lit(bound), x))
    return 1 / (1 + F.exp(-z))
