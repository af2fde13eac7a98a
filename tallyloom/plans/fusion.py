"""Blends of frozen predictions with later evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import fusion as U
from tallyloom.plans.catalog import Catalog, Tables, r
from tallyloom.plans.vectors import PRED_SQL, predictions

catalog = Catalog()
add = catalog.add
QUERIES, ORACLES = catalog.queries, catalog.oracles

#: Predictions with a likelihood that turns them by a class, a gate, and blind scores from 0 to 4.
_CASES = f"""(SELECT *, p2 AS l1, p3 AS l2, p1 AS l3, (vec_id % 10) / 10.0 AS gate, CAST(vec_id % 5 AS DOUBLE) AS o1, CAST((vec_id // 5) % 5 AS DOUBLE) AS o2, CAST((vec_id // 25) % 5 AS DOUBLE) AS o3 FROM {PRED_SQL})"""


def _cases(t: Tables) -> DataFrame:
    p = predictions(t)
    turned = F.array(*[F.element_at("probs", i) for i in (2, 3, 1)])
    scores = F.array(*[(F.floor(F.col("vec_id") / n) % 5).cast("long") for n in (1, 5, 25)])
    return p.withColumns({"likelihood": turned, "gate": (F.col("vec_id") % 10) / F.lit(10.0), "scores": scores})


def _three(p) -> list:
    return [r(F.element_at(p, i)).alias(f"p{i}") for i in (1, 2, 3)]


def _ln(x: str, floor: str = "1e-8") -> str:
    return f"ln(greatest({x}, {floor}))"


@add(
    "m12_hierarchical_pool",
    f"""WITH s AS (SELECT vec_id, gate, p1, p2 + p3 AS rest, CASE WHEN p2 + p3 > 0 THEN p2 / (p2 + p3) ELSE 0.5 END AS a, CASE WHEN p2 + p3 > 0 THEN p3 / (p2 + p3) ELSE 0.5 END AS b, l1, l2, l3 FROM {_CASES}),
z AS (SELECT *, {_ln('p1')} + gate * {_ln('l1')} AS x, {_ln('rest')} + gate * {_ln('l2 * a + l3 * b')} AS y FROM s)
SELECT vec_id, round(exp(x - greatest(x, y)) / (exp(x - greatest(x, y)) + exp(y - greatest(x, y))), 9) AS p1,
round(a * exp(y - greatest(x, y)) / (exp(x - greatest(x, y)) + exp(y - greatest(x, y))), 9) AS p2, round(b * exp(y - greatest(x, y)) / (exp(x - greatest(x, y)) + exp(y - greatest(x, y))), 9) AS p3 FROM z""",
)
def _(t: Tables) -> DataFrame:
    return _cases(t).select("vec_id", *_three(U.hierarchical_pool(F.col("probs"), F.col("likelihood"), F.col("gate"), 0, 3)))


@add(
    "m13_two_stage",
    f"""WITH s AS (SELECT vec_id, gate, p1, p2 + p3 AS rest, p2 / (p2 + p3) AS a, p3 / (p2 + p3) AS b, l1 / (l1 + l2) AS u, l2 / (l1 + l2) AS v, l2 / (l2 + l3) AS m, l3 / (l2 + l3) AS n, 0.8 * gate AS g, 0.5 * (1 - gate) AS h FROM {_CASES}),
z AS (SELECT *, {_ln('p1')} + g * {_ln('u')} AS x, {_ln('rest')} + g * {_ln('v')} AS y, {_ln('a')} + h * {_ln('m')} AS c, {_ln('b')} + h * {_ln('n')} AS d FROM s),
k AS (SELECT vec_id, 1 / (1 + exp(y - x)) AS p1, 1 / (1 + exp(x - y)) AS ill, 1 / (1 + exp(d - c)) AS mild, 1 / (1 + exp(c - d)) AS severe FROM z)
SELECT vec_id, round(p1, 9) AS p1, round(ill * mild, 9) AS p2, round(ill * severe, 9) AS p3 FROM k""",
)
def _(t: Tables) -> DataFrame:
    part = lambda i: F.element_at("likelihood", i)
    p = U.two_stage_pool(F.col("probs"), F.array(part(1), part(2)), F.array(part(2), part(3)), 0.8 * F.col("gate"), 0.5 * (1 - F.col("gate")))
    return _cases(t).select("vec_id", *_three(p))


@add(
    "m14_routes",
    f"""WITH s AS (SELECT vec_id, gate, p1, p2 + p3 AS rest, l1 / (l1 + l2 + l3) AS u, (l2 * p2 + l3 * p3) / (p2 + p3) / (l1 + l2 + l3) AS v FROM {_CASES}),
k AS (SELECT vec_id, CASE WHEN gate < 0.25 THEN 'quality_limited' WHEN (p1 >= rest) <> (u >= v) THEN 'model_evidence_conflict' WHEN abs(p1 - rest) <= 0.15 THEN 'boundary_case' WHEN greatest(p1, rest) >= 0.8 THEN 'stable_agreement' ELSE 'routine_review' END AS route FROM s)
SELECT vec_id, route, CASE route WHEN 'quality_limited' THEN 0.0 WHEN 'stable_agreement' THEN 0.25 WHEN 'routine_review' THEN 0.6 ELSE 1.0 END AS multiplier FROM k""",
)
def _(t: Tables) -> DataFrame:
    k = _cases(t).select("vec_id", U.route(F.col("probs"), F.col("likelihood"), F.col("gate"), 0).alias("route"))
    return k.select("vec_id", "route", U.route_multiplier(F.col("route")).alias("multiplier"))


_AUTHORITY = U.Authority(state=0.8, scores=0.6, staging=0.5, bound=0.9, temperature=1.5)


def _joint_sql(gated: bool) -> str:
    state = "AND against AND NOT conflict AND doubt >= 0.65" if gated else ""
    gate = lambda agrees, doubt, margin: f"CASE WHEN {agrees} THEN 0.0 WHEN {doubt} >= 0.75 THEN {doubt} * {margin} WHEN {margin} >= 0.75 THEN {margin} ELSE 0.0 END" if gated else "1.0"
    h = lambda a, b: f"(-(CASE WHEN {a} > 0 THEN {a} * ln({a}) ELSE 0 END) - (CASE WHEN {b} > 0 THEN {b} * ln({b}) ELSE 0 END)) / ln(2.0)"
    return f"""WITH i AS (SELECT *, vec_id % 7 = 0 AS shut, p2 + p3 AS ill, CASE WHEN vec_id % 11 = 0 THEN p1 ELSE (p1 + l1) / 2 END AS a1, CASE WHEN vec_id % 11 = 0 THEN p2 + p3 ELSE (p2 + l2) / 2 + (p3 + l3) / 2 END AS after FROM {_CASES}),
s AS (SELECT *, CASE WHEN vec_id % 11 = 0 THEN 0.0 ELSE ln(greatest(1e-12, least(1 - 1e-12, after)) / (1 - greatest(1e-12, least(1 - 1e-12, after)))) - ln(greatest(1e-12, least(1 - 1e-12, ill)) / (1 - greatest(1e-12, least(1 - 1e-12, ill)))) END AS shift FROM i),
e AS (SELECT *, greatest(-0.9, least(0.9, -2 * shift / 3)) AS s0, greatest(-0.9, least(0.9, shift / 3)) AS s1, greatest(o2, o3) - o1 AS lead, o3 - o2 AS step, {h('p1', 'ill')} AS doubt, {h('(p2 / ill)', '(p3 / ill)')} AS stage_doubt FROM s),
w AS (SELECT *, (s1 - s0) * lead < 0 AS conflict, CASE WHEN ill >= 0.5 THEN s1 - s0 < 0 ELSE s1 - s0 > 0 END AS against FROM e),
g AS (SELECT *, CASE WHEN NOT shut AND vec_id % 11 <> 0 AND (s0 <> 0 OR s1 <> 0) {state} THEN 1.0 ELSE 0.0 END AS sg FROM w),
k AS (SELECT *, CASE WHEN shut OR (o1 = o2 AND o2 = o3) THEN 0.0 ELSE {gate("sg <> 0 OR (lead > 0) = (ill >= 0.5)", "doubt", "abs(lead) / 4")} END AS ag, CASE WHEN shut OR step = 0 THEN 0.0 ELSE {gate("(p2 >= p3) = (o2 >= o3)", "stage_doubt", "abs(step) / 4")} END AS tg FROM g),
z AS (SELECT *, ln(p1) + 0.8 * sg * s0 - 0.4 * ag * 2 * lead / 3 AS z1, ln(p2) + 0.8 * sg * s1 + 0.4 * ag * lead / 3 - tg * step / 6 AS z2, ln(p3) + 0.8 * sg * s1 + 0.4 * ag * lead / 3 + tg * step / 6 AS z3 FROM k)
SELECT vec_id, {", ".join(f"round(exp(z{i}) / (exp(z1) + exp(z2) + exp(z3)), 9) AS p{i}" for i in (1, 2, 3))}, sg AS state_gate, round(ag, 9) AS score_gate, round(tg, 9) AS staging_gate, conflict, sg = 0 AND ag = 0 AND tg = 0 AS parity FROM z"""


def _joint(t: Tables, gated: bool) -> DataFrame:
    same = F.col("vec_id") % 11 == 0
    after = F.when(same, F.col("probs")).otherwise(F.zip_with("probs", "likelihood", lambda a, b: (a + b) / 2))
    x = _cases(t).withColumns({"after": after, "channel": F.when(F.col("vec_id") % 7 == 0, " Public_Speech ").otherwise("clinic")})
    c = U.Authority(**{**_AUTHORITY.__dict__, "gated": gated})
    x = U.joint_authority(x, c, frozen="probs", before="probs")
    return x.select("vec_id", *_three(F.col("fused")), "state_gate", r(F.col("score_gate")).alias("score_gate"), r(F.col("staging_gate")).alias("staging_gate"), "conflict", "parity")


@add("m15_joint_authority", _joint_sql(True))
def _(t: Tables) -> DataFrame:
    return _joint(t, True)


@add("m15_joint_authority_ungated", _joint_sql(False))
def _(t: Tables) -> DataFrame:
    return _joint(t, False)
