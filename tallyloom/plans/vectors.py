"""Expressions on class-probability vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import vectors as V
from tallyloom.plans.catalog import Catalog, Tables, r

catalog = Catalog()
add = catalog.add
QUERIES, ORACLES = catalog.queries, catalog.oracles

CLASSES = ("HC", "MCI", "AD")

#: Three whole-number weights by row from an embedding, with a bonus on the true class of two rows in three.
_W = [f"CAST(floor(abs(CAST(embedding[{i}] AS DOUBLE)) * 1000) AS BIGINT) + 1 + CASE WHEN label % 3 = {i - 1} AND vec_id % 3 <> 0 THEN 120 ELSE 0 END" for i in (1, 2, 3)]
PRED_SQL = f"""(SELECT vec_id, label % 3 + 1 AS truth, CASE WHEN w1 >= w2 AND w1 >= w3 THEN 1 WHEN w2 >= w3 THEN 2 ELSE 3 END AS predicted,
 w1 / (w1 + w2 + w3) AS p1, w2 / (w1 + w2 + w3) AS p2, w3 / (w1 + w2 + w3) AS p3, 0.2 AS q1, 0.3 AS q2, 0.5 AS q3
 FROM (SELECT vec_id, label, {_W[0]} AS w1, {_W[1]} AS w2, {_W[2]} AS w3 FROM embeddings))"""


def predictions(t: Tables) -> DataFrame:
    """vec_id, truth, predicted (places from 1), probs and a second fixed vector ``prior``."""
    w = [F.floor(F.abs(F.element_at("embedding", i).cast("double")) * 1000).cast("long") + 1 + F.when((F.col("label") % 3 == i - 1) & (F.col("vec_id") % 3 != 0), 120).otherwise(0) for i in (1, 2, 3)]
    e = t.embeddings.select("vec_id", (F.col("label") % 3 + 1).alias("truth"), F.array(*w).alias("w"))
    total = F.element_at("w", 1) + F.element_at("w", 2) + F.element_at("w", 3)
    p = e.select("vec_id", "truth", F.transform("w", lambda x: x / total).alias("probs"), F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5)).alias("prior"))
    return p.withColumn("predicted", V.argmax(F.col("probs")))


def _three(p, name: str = "p"):
    return [r(F.element_at(p, i)).alias(f"{name}{i}") for i in (1, 2, 3)]


def _soft(z: list[str]) -> str:
    """Columns p1..p3 of the softmax of three SQL expressions over a subquery that has them as z1..z3."""
    del z
    return ", ".join(f"round(exp(z{i} - greatest(z1, z2, z3)) / (exp(z1 - greatest(z1, z2, z3)) + exp(z2 - greatest(z1, z2, z3)) + exp(z3 - greatest(z1, z2, z3))), 9) AS p{i}" for i in (1, 2, 3))


@add("f22_simplex", f"SELECT count(*) AS n, count(*) FILTER (abs(p1 + p2 + p3 - 1) <= 1e-6) AS valid FROM {PRED_SQL}")
def _(t: Tables) -> DataFrame:
    return predictions(t).agg(F.count("*").alias("n"), F.count_if(V.is_simplex(F.col("probs"))).alias("valid"))


@add("f22_simplex_of_records", "SELECT record_id, coalesce(list_bool_and(list_transform(map_values(base_probabilities), lambda x: x IS NOT NULL AND x >= 0 AND x <= 1)) AND abs(list_sum(map_values(base_probabilities)) - 1) <= 0.0015, false) AS valid FROM synthetic_workspace")
def _(t: Tables) -> DataFrame:
    return t.synthetic_workspace.select("record_id", V.is_simplex(F.map_values("base_probabilities"), 0.0015).alias("valid"))


@add("f30_normalise", "SELECT event_id, " + ", ".join(f"round(CASE WHEN s > 0 THEN {x} / s ELSE 1.0 / 2 END, 9) AS p{i}" for i, x in ((1, "a"), (2, "b"))) + " FROM (SELECT event_id, a, b, a + b AS s FROM (SELECT event_id, greatest(value - 30, 0) AS a, greatest(event_id % 3 - 1.0, 0) AS b FROM events))")
def _(t: Tables) -> DataFrame:
    p = V.normalise(F.array(F.col("value") - 30, F.col("event_id") % 3 - 1.0))
    return t.events.select("event_id", r(F.element_at(p, 1)).alias("p1"), r(F.element_at(p, 2)).alias("p2"))


@add("m03_sigmoid", "SELECT event_id, round(1 / (1 + exp(-greatest(-12.0, least(12.0, value / 10 - 5)))), 9) AS severity FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", r(V.sigmoid(F.col("value") / 10 - 5, 12.0)).alias("severity"))


@add("m04_category", "SELECT evidence_status, CASE WHEN reliability IS NULL OR reliability < 0.45 THEN 'insufficient' WHEN abs(directional_z) < 0.5 THEN 'typical' WHEN abs(directional_z) < 1 THEN 'mild' WHEN abs(directional_z) < 2 THEN 'moderate' ELSE 'marked' END AS category, count(*) AS n FROM metric_evidence WHERE isfinite(directional_z) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    z = F.abs("directional_z")
    e = t.metric_evidence.where(F.col("directional_z").isNotNull() & ~F.isnan("directional_z") & (z < float("inf")))
    c = F.when(F.col("reliability").isNull() | (F.col("reliability") < 0.45), "insufficient").when(z < 0.5, "typical").when(z < 1, "mild").when(z < 2, "moderate").otherwise("marked")
    return e.groupBy("evidence_status", c.alias("category")).agg(F.count("*").alias("n"))


@add("m06_softmax", "SELECT vec_id, " + _soft([]) + " FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS z1, CAST(embedding[2] AS DOUBLE) AS z2, CAST(embedding[3] AS DOUBLE) AS z3 FROM embeddings)")
def _(t: Tables) -> DataFrame:
    p = V.softmax(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")))
    return t.embeddings.select("vec_id", *_three(p))


@add("m07_temperature", f"SELECT vec_id, {_soft([])} FROM (SELECT vec_id, ln(p1) / 1.7 AS z1, ln(p2) / 1.7 AS z2, ln(p3) / 1.7 AS z3 FROM {PRED_SQL})")
def _(t: Tables) -> DataFrame:
    return predictions(t).select("vec_id", *_three(V.temperature(F.col("probs"), 1.7)))


@add("m08_offsets", f"SELECT vec_id, {_soft([])} FROM (SELECT vec_id, ln(p1) + 0.1 AS z1, ln(p2) - 0.3 AS z2, ln(p3) AS z3 FROM {PRED_SQL})")
def _(t: Tables) -> DataFrame:
    return predictions(t).select("vec_id", *_three(V.offset(F.col("probs"), F.array(F.lit(0.1), F.lit(-0.3), F.lit(0.0)))))


@add("m09_blend", f"SELECT vec_id, " + ", ".join(f"round(CASE WHEN g = 0 THEN p{i} ELSE p{i} + g * (q{i} - p{i}) END, 9) AS p{i}" for i in (1, 2, 3)) + f" FROM (SELECT *, (vec_id % 5) / 10.0 AS g FROM {PRED_SQL})")
def _(t: Tables) -> DataFrame:
    return predictions(t).select("vec_id", *_three(V.blend(F.col("probs"), F.col("prior"), F.col("vec_id") % 5 / F.lit(10.0))))


@add("m10_evidence_gate", "SELECT record_id, i, round(sqrt(greatest(0.0, least(1.0, coalesce(s.confidence, 0.0))) * 0.8) * sqrt(1 - greatest(0.0, least(1.0, coalesce(s.missing_fraction, 0.0)))), 9) AS gate FROM (SELECT record_id, unnest(state_observations) AS s, unnest(range(len(state_observations))) AS i FROM synthetic_workspace)")
def _(t: Tables) -> DataFrame:
    s = t.synthetic_workspace.select("record_id", F.posexplode("state_observations").alias("i", "s"))
    return s.select("record_id", F.col("i").cast("long").alias("i"), r(V.evidence_gate(F.col("s.confidence"), F.lit(0.8), F.col("s.missing_fraction"))).alias("gate"))


@add("m11_log_pool", f"SELECT vec_id, {_soft([])} FROM (SELECT vec_id, 0.7 * ln(p1) + 0.3 * ln(q1) AS z1, 0.7 * ln(p2) + 0.3 * ln(q2) AS z2, 0.7 * ln(p3) + 0.3 * ln(q3) AS z3 FROM {PRED_SQL})")
def _(t: Tables) -> DataFrame:
    return predictions(t).select("vec_id", *_three(V.log_pool(F.col("probs"), F.col("prior"), 0.3)))


@add("m16_entropy", f"SELECT vec_id, round(-(p1 * ln(p1) + p2 * ln(p2) + p3 * ln(p3)) / ln(3.0), 9) AS entropy FROM {PRED_SQL}")
def _(t: Tables) -> DataFrame:
    return predictions(t).select("vec_id", r(V.entropy(F.col("probs"))).alias("entropy"))


@add("m16_centred_logits", f"SELECT vec_id, " + ", ".join(f"round(greatest(-1.5, least(1.5, ln(p{i}) - m)), 9) AS p{i}" for i in (1, 2, 3)) + f" FROM (SELECT *, (ln(p1) + ln(p2) + ln(p3)) / 3 AS m FROM {PRED_SQL})")
def _(t: Tables) -> DataFrame:
    return predictions(t).select("vec_id", *_three(V.centred_logits(F.col("probs"), 1.5)))


@add(
    "m17_bounded_delta",
    f"""WITH d AS (SELECT vec_id, p1, p2, p3, q1 - p1 AS a, q2 - p2 AS b, q3 - p3 AS c FROM {PRED_SQL}), m AS (SELECT *, (a + b + c) / 3 AS m FROM d), k AS (SELECT *, a - m AS x1, b - m AS x2, c - m AS x3 FROM m),
s AS (SELECT *, CASE WHEN greatest(abs(x1), abs(x2), abs(x3)) > 0.25 THEN 0.25 / greatest(abs(x1), abs(x2), abs(x3)) ELSE 1.0 END AS f FROM k)
SELECT vec_id, round(x1 * f, 9) AS p1, round(x2 * f, 9) AS p2, round(x3 * f, 9) AS p3 FROM s""",
)
def _(t: Tables) -> DataFrame:
    delta = F.zip_with("prior", "probs", lambda a, b: a - b)
    return predictions(t).select("vec_id", *_three(V.zero_sum(delta, 0.25)))


@add(
    "m18_capped_weights",
    f"""WITH c AS (SELECT vec_id, p1, p2, p3, 0.45 AS cap FROM {PRED_SQL}),
a AS (SELECT *, greatest(p1 - cap, 0) + greatest(p2 - cap, 0) + greatest(p3 - cap, 0) AS o, (CASE WHEN p1 < cap THEN p1 ELSE 0 END + CASE WHEN p2 < cap THEN p2 ELSE 0 END + CASE WHEN p3 < cap THEN p3 ELSE 0 END) AS m FROM c),
b AS (SELECT vec_id, cap, {", ".join(f"CASE WHEN p{i} >= cap THEN cap WHEN m > 0 THEN p{i} + o * p{i} / m ELSE p{i} END AS p{i}" for i in (1, 2, 3))} FROM a),
a2 AS (SELECT *, greatest(p1 - cap, 0) + greatest(p2 - cap, 0) + greatest(p3 - cap, 0) AS o, (CASE WHEN p1 < cap THEN p1 ELSE 0 END + CASE WHEN p2 < cap THEN p2 ELSE 0 END + CASE WHEN p3 < cap THEN p3 ELSE 0 END) AS m FROM b),
b2 AS (SELECT vec_id, {", ".join(f"CASE WHEN p{i} >= cap THEN cap WHEN m > 0 THEN p{i} + o * p{i} / m ELSE p{i} END AS p{i}" for i in (1, 2, 3))} FROM a2)
SELECT vec_id, round(p1, 9) AS p1, round(p2, 9) AS p2, round(p3, 9) AS p3 FROM b2""",
)
def _(t: Tables) -> DataFrame:
    return predictions(t).select("vec_id", *_three(V.capped_weights(F.col("probs"), 0.45, 3)))


@add("m19_gate_weights", f"SELECT vec_id, {_soft([])} FROM (SELECT vec_id, 0.2 + ln(1 + exp(0.5)) * ln(p1) AS z1, -0.1 + ln(1 + exp(0.5)) * ln(p2) AS z2, ln(1 + exp(0.5)) * ln(p3) AS z3 FROM {PRED_SQL})")
def _(t: Tables) -> DataFrame:
    b = F.log(1 + F.exp(F.lit(0.5)))
    z = F.zip_with(F.array(F.lit(0.2), F.lit(-0.1), F.lit(0.0)), V.logs(F.col("probs")), lambda a, x: a + b * x)
    return predictions(t).select("vec_id", *_three(V.softmax(z)))


@add("m23_authority", f"SELECT vec_id, round(p1 * p2 * (1 - p3) * 0.9, 9) AS authority FROM {PRED_SQL}")
def _(t: Tables) -> DataFrame:
    p = [F.element_at("probs", i) for i in (1, 2, 3)]
    return predictions(t).select("vec_id", r(p[0] * p[1] * (1 - p[2]) * 0.9).alias("authority"))


@add("m25_convex", f"SELECT vec_id, " + ", ".join(f"round(0.8 * p{i} + 0.2 * q{i}, 9) AS p{i}" for i in (1, 2, 3)) + f" FROM {PRED_SQL}")
def _(t: Tables) -> DataFrame:
    mixed = F.zip_with("probs", "prior", lambda a, b: 0.8 * a + 0.2 * b)
    return predictions(t).select("vec_id", *_three(mixed))


@add("m26_calibrator", f"SELECT vec_id, round(1 / (1 + exp(-(-0.2 + 1.3 * ln(p3 / (1 - p3))))), 9) AS p FROM {PRED_SQL}")
def _(t: Tables) -> DataFrame:
    p = F.element_at("probs", 3)
    return predictions(t).select("vec_id", r(V.sigmoid(-0.2 + 1.3 * F.log(p / (1 - p)))).alias("p"))


@add("m27_age_bands", "SELECT CASE WHEN age IS NULL THEN 'unknown' WHEN age < 60 THEN 'under_60' WHEN age < 70 THEN '60s' WHEN age < 80 THEN '70s' ELSE '80_plus' END AS band, count(*) AS n FROM manifest GROUP BY 1")
def _(t: Tables) -> DataFrame:
    a = F.col("age")
    return t.manifest.groupBy(F.when(a.isNull(), "unknown").when(a < 60, "under_60").when(a < 70, "60s").when(a < 80, "70s").otherwise("80_plus").alias("band")).agg(F.count("*").alias("n"))


@add("m28_nearly_equal", "SELECT metric_instance_id, count(*) FILTER (abs(reference_median - cn_train_median) <= 1e-9 + 1e-6 * abs(cn_train_median)) AS close, count(*) AS n FROM metric_evidence GROUP BY 1")
def _(t: Tables) -> DataFrame:
    close = F.abs(F.col("reference_median") - F.col("cn_train_median")) <= 1e-9 + 1e-6 * F.abs("cn_train_median")
    return t.metric_evidence.groupBy("metric_instance_id").agg(F.count_if(close).alias("close"), F.count("*").alias("n"))


@add("w23_argmax", f"SELECT vec_id, predicted FROM {PRED_SQL}")
def _(t: Tables) -> DataFrame:
    return predictions(t).select("vec_id", V.argmax(F.col("probs")).alias("predicted"))


@add("w24_margin", f"SELECT vec_id, round(greatest(p1, p2, p3) - (p1 + p2 + p3 - greatest(p1, p2, p3) - least(p1, p2, p3)), 9) AS margin FROM {PRED_SQL}")
def _(t: Tables) -> DataFrame:
    return predictions(t).select("vec_id", r(V.margin(F.col("probs"))).alias("margin"))
