"""Blends of a frozen prediction with later evidence, as columns on class-probability vectors.

The classes stand in a fixed order; ``reference`` is the place (from 0) of the
class that the others are held against, as in healthy against impaired.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import vectors as V

#: Least probability whose logarithm is taken. Fixed values.
POOL_FLOOR, LOGIT_FLOOR = 1e-8, 1e-12


def _one(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _pooled(prior: Column, likelihood: Column, beta: Column) -> Column:
    return V.softmax(F.zip_with(V.logs(prior, POOL_FLOOR), V.logs(likelihood, POOL_FLOOR), lambda a, b: a + beta * b))


def pool(base: Column, likelihood: Column, beta: Column) -> Column:
    """Every class's logarithm plus beta times that of its likelihood, normalised."""
    return _pooled(base, likelihood, beta)


def split_at(p: Column, reference: int) -> tuple[Column, Column, Column]:
    """The reference's probability, the others' sum, and their shares of it (even where it is 0)."""
    rest = F.filter(p, lambda _, i: i != reference)
    mass = V.total(rest)
    return F.get(p, F.lit(reference)), mass, F.transform(rest, lambda x: F.when(mass > 0, x / mass).otherwise(1.0 / F.size(rest)))


def joined_at(reference_part: Column, rest: Column, shares: Column, reference: int, classes: int) -> Column:
    """The vector whose reference class has one part and whose others share the rest."""
    places = [i - (i > reference) for i in range(classes)]
    return F.array(*[reference_part if i == reference else rest * F.get(shares, F.lit(k)) for i, k in enumerate(places)])


def hierarchical_pool(base: Column, likelihood: Column, beta: Column, reference: int, classes: int) -> Column:
    """A pool of the reference against all others; the others keep their shares.

    Their likelihood is the mean under those shares, so an even likelihood moves nothing.
    """
    own, mass, shares = split_at(base, reference)
    others = F.filter(likelihood, lambda _, i: i != reference)
    seen = V.total(F.zip_with(others, shares, lambda a, b: a * b))
    two = _pooled(F.array(own, mass), F.array(F.get(likelihood, F.lit(reference)), seen), beta)
    return V.let(two, lambda x: V.let(shares, lambda y: joined_at(F.get(x, F.lit(0)), F.get(x, F.lit(1)), y, reference, classes)))


def two_stage_pool(base: Column, screening: Column, staging: Column, screening_beta: Column, staging_beta: Column) -> Column:
    """Three classes: the first against the rest by one likelihood of two parts, then the second against the third by another."""
    own, mass, shares = split_at(base, 0)
    first = _pooled(F.array(own, mass), V.normalise(screening), screening_beta)
    second = _pooled(shares, V.normalise(staging), staging_beta)
    return V.let(first, lambda a: V.let(second, lambda b: V.normalise(joined_at(F.get(a, F.lit(0)), F.get(a, F.lit(1)), b, 0, 3))))


#: Thresholds of the routes and what a route leaves of a correction. Fixed values.
LOW_GATE, BOUNDARY, STABLE = 0.25, 0.15, 0.80
MULTIPLIERS = {"quality_limited": 0.0, "model_evidence_conflict": 1.0, "boundary_case": 1.0, "stable_agreement": 0.25, "routine_review": 0.60}


def route(base: Column, likelihood: Column, gate: Column, reference: int | None = None) -> Column:
    """The route of a case, blind to its label: by the gate, agreement, margin and confidence, in this order.

    With a reference, all are of the reference against the others.
    """
    p, q = V.normalise(base), V.normalise(likelihood)
    if reference is not None:
        own, mass, shares = split_at(p, reference)
        others = F.filter(q, lambda _, i: i != reference)
        q = V.normalise(F.array(F.get(q, F.lit(reference)), V.total(F.zip_with(others, shares, lambda a, b: a * b))))
        p = F.array(own, mass)
    return (
        F.when(gate < LOW_GATE, "quality_limited").when(V.argmax(p) != V.argmax(q), "model_evidence_conflict").when(V.margin(p) <= BOUNDARY, "boundary_case")
        .when(F.array_max(p) >= STABLE, "stable_agreement").otherwise("routine_review")
    )


def route_multiplier(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in MULTIPLIERS.items() for x in pair]), name)


@dataclass(frozen=True)
class Authority:
    """How far each kind of evidence may move a frozen prediction."""

    state: float = 0.0
    scores: float = 0.0
    staging: float = 0.0
    bound: float = 1.0
    temperature: float = 1.0
    gated: bool = True
    least_state_uncertainty: float = 0.65
    least_uncertainty: float = 0.75
    least_margin: float = 0.75


#: Ordinal scores run from 0 to this.
TOP_SCORE = 4.0
#: The channel whose evidence is reported and moves nothing.
REPORT_ONLY = "public_speech"


def _logit(p: Column) -> Column:
    b = F.greatest(F.lit(LOGIT_FLOOR), F.least(F.lit(1 - LOGIT_FLOOR), p))
    return F.log(b / (1 - b))


def _two_part_entropy(a: Column, b: Column) -> Column:
    part = lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0)
    return (part(a) + part(b)) / F.log(F.lit(2.0))


def joint_authority(df: DataFrame, c: Authority, frozen: str = "frozen", before: str = "before", after: str = "after", scores: str = "scores", channel: str = "channel") -> DataFrame:
    """``df`` with the fused probabilities of healthy, mild and severe and why: ``fused``, ``state_gate``, ``score_gate``, ``staging_gate``, ``conflict``, ``parity``.

    before and after: probabilities around a change of the states; what counts is
    the change of impairment's logit, centred over the classes and bounded. scores:
    whole numbers from 0 to 4 by class, given without sight of the prediction: the
    better of the two impaired ones against the healthy one decides on impairment,
    and the two against each other on the stage. Evidence counts only against the
    frozen decision and where that is uncertain or the margin large; state evidence
    goes first. Where nothing counts, fused is the frozen vector itself, bit for bit.
    """
    part = lambda name, i: F.get(name, F.lit(i))
    f, o = [part(frozen, i) for i in range(3)], [part(scores, i).cast("double") for i in range(3)]
    impaired = lambda name: part(name, 1) + part(name, 2)
    clip = lambda x: F.greatest(F.lit(-c.bound), F.least(F.lit(c.bound), x))
    shift = _logit(impaired(after)) - _logit(impaired(before))
    # Evidence.
    x = df.withColumns(
        {
            "_ill": f[1] + f[2], "_open": F.coalesce(F.lower(F.trim(channel)), F.lit("unknown")) != REPORT_ONLY,
            "_s0": clip(-2.0 * shift / 3.0), "_s1": clip(shift / 3.0),
            "_lead": F.greatest(o[1], o[2]) - o[0], "_step": o[2] - o[1],
            "_same": F.col(before) == F.col(after), "_flat": (o[0] == o[1]) & (o[1] == o[2]),
        }
    )
    toward = F.col("_s1") - F.col("_s0")
    x = x.withColumns(
        {
            "_doubt": _two_part_entropy(f[0], F.col("_ill")),
            "_stage_doubt": F.when(F.col("_ill") > 0, _two_part_entropy(f[1] / F.col("_ill"), f[2] / F.col("_ill"))).otherwise(1.0),
            "conflict": toward * F.col("_lead") < 0,
            "_against": F.when(F.col("_ill") >= 0.5, toward < 0).otherwise(toward > 0),
        }
    )
    # Gates.
    has_state = F.lit(c.state != 0) & ~F.col("_same") & ((F.col("_s0") != 0) | (F.col("_s1") != 0)) & F.col("_open")
    state_ok = F.col("_against") & ~F.col("conflict") & (F.col("_doubt") >= c.least_state_uncertainty) if c.gated else F.lit(True)
    x = x.withColumn("state_gate", (has_state & state_ok).cast("double"))

    def gate(agrees: Column, doubt: Column, margin: Column) -> Column:
        return F.when(agrees, 0.0).when(doubt >= c.least_uncertainty, doubt * margin).when(margin >= c.least_margin, margin).otherwise(0.0)

    says_ill = F.col("_lead") > 0
    score_gate = gate((F.col("state_gate") != 0) | (says_ill == (F.col("_ill") >= 0.5)), F.col("_doubt"), F.abs("_lead") / TOP_SCORE) if c.gated else F.lit(1.0)
    staging_gate = gate((f[1] >= f[2]) == (o[1] >= o[2]), F.col("_stage_doubt"), F.abs("_step") / TOP_SCORE) if c.gated else F.lit(1.0)
    x = x.withColumns(
        {
            "score_gate": F.when(F.lit(c.scores != 0) & ~F.col("_flat") & F.col("_open"), score_gate).otherwise(0.0),
            "staging_gate": F.when(F.lit(c.staging != 0) & (F.col("_step") != 0) & F.col("_open"), staging_gate).otherwise(0.0),
        }
    )
    x = x.withColumn("parity", (F.col("state_gate") == 0) & (F.col("score_gate") == 0) & (F.col("staging_gate") == 0))
    by_state, by_score, by_stage = F.col("state_gate") * c.state, F.col("score_gate") * (c.scores / c.temperature), F.col("staging_gate") * (c.staging / c.temperature)
    moved = [
        by_state * F.col("_s0") - by_score * 2.0 * F.col("_lead") / 3.0,
        by_state * F.col("_s1") + by_score * F.col("_lead") / 3.0 - by_stage * F.col("_step") / 2.0,
        by_state * F.col("_s1") + by_score * F.col("_lead") / 3.0 + by_stage * F.col("_step") / 2.0,
    ]
    fused = V.softmax(F.zip_with(V.logs(F.col(frozen), LOGIT_FLOOR), F.array(*moved), lambda a, b: a + b))
    return x.withColumn("fused", F.when(F.col("parity"), F.col(frozen)).otherwise(fused)).select(*df.columns, "fused", "state_gate", "score_gate", "staging_gate", "conflict", "parity")
