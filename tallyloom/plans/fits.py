"""Model fits and selections from aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import vectors as V
from tallyloom.operators import fit
from tallyloom.plans.catalog import Catalog, Tables, r
from tallyloom.plans.relational import EV_SQL, ev
from tallyloom.plans.vectors import PRED_SQL, predictions

catalog = Catalog()
add = catalog.add
QUERIES, ORACLES = catalog.queries, catalog.oracles


@add("e10_calibration", None)
def _(t: Tables) -> DataFrame:
    """Intercept and slope of every class on the logit of its own probability, fitted together."""
    p = predictions(t)
    rows = []
    for c in (1, 2, 3):
        s = F.greatest(F.lit(1e-5), F.least(F.lit(1 - 1e-5), F.element_at("probs", c)))
        rows.append(fit.calibration(p.select(s.alias("s"), (F.col("truth") == c).alias("y")), "s", "y"))
    return t.spark.createDataFrame([(c, round(b, 6), round(w, 6)) for c, (b, w) in enumerate(rows, 1)], "class int, intercept double, slope double")


@add(
    "e25_ridge_residuals",
    """WITH m AS (SELECT case_id, duration_sec AS x, age AS y FROM manifest WHERE duration_sec IS NOT NULL AND age IS NOT NULL), s AS (SELECT avg(x) AS mx, avg(y) AS my FROM m),
w AS (SELECT sum((x - mx) * (y - my)) / (sum((x - mx) * (x - mx)) + 1.0) AS w, any_value(mx) AS mx, any_value(my) AS my FROM m CROSS JOIN s) SELECT case_id, round(y - my - w * (x - mx), 7) AS residual FROM m CROSS JOIN w""",
)
def _(t: Tables) -> DataFrame:
    """Age without what the recording's length predicts."""
    m = t.manifest.select("case_id", "duration_sec", "age").na.drop(subset=["duration_sec", "age"])
    model = fit.ridge(m, ["duration_sec"], ["age"])
    return fit.residuals(m, ["duration_sec"], ["age"], model).select("case_id", F.round("age", 7).alias("residual"))


@add("e23_multinomial", None)
def _(t: Tables) -> DataFrame:
    """Class probabilities of a balanced multinomial regression on every embedding dimension."""
    wide = len(t.embeddings.select("embedding").first()[0])
    names = [f"x{i}" for i in range(1, wide + 1)]
    e = t.embeddings.select("vec_id", (F.col("label") % 3).alias("y"), *[F.element_at("embedding", i).cast("double").alias(c) for i, c in enumerate(names, 1)])
    model = fit.multinomial(e, names, "y")
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")
    return model.transform(fit.with_indicators(e, names)).select("vec_id", *[r(F.element_at(p, i), 6).alias(f"p{i}") for i in (1, 2, 3)])


@add("e29_temperature", None)
def _(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(round(fit.temperature(predictions(t)), 3),)], "temperature double")


@add(
    "e30_stable_offsets",
    "WITH f AS (SELECT vec_id % 5 AS fold, label AS class, avg(CAST(embedding[1] AS DOUBLE)) AS o FROM embeddings GROUP BY ALL), c AS (SELECT class, count(*) FILTER (o > 0) AS p, count(*) FILTER (o < 0) AS n, count(*) AS k, median(o) AS m FROM f GROUP BY 1) SELECT class, round(CASE WHEN greatest(p, n) >= 3 AND greatest(p, n) / k >= 0.8 THEN m ELSE 0 END, 9) AS \"offset\" FROM c",
)
def _(t: Tables) -> DataFrame:
    f = t.embeddings.groupBy((F.col("vec_id") % 5).alias("fold"), F.col("label").alias("class")).agg(F.avg(F.element_at("embedding", 1).cast("double")).alias("offset"))
    return fit.stable_offsets(f).select("class", r(F.col("offset")).alias("offset"))


@add("e32_correction_strength", None)
def _(t: Tables) -> DataFrame:
    p = predictions(t)
    rows = fit.over_grid(p, "strength", [0.0, 0.1, 0.25, 0.5], lambda s: V.log_pool(F.col("probs"), F.col("prior"), s), 3)
    return t.spark.createDataFrame([(fit.choose_strength(rows, "strength"),)], "strength double")


@add("e48_offset_grid", None)
def _(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([fit.choose_offsets(predictions(t), [-0.2, 0.0, 0.2], 3)], "o1 double, o2 double, o3 double")


@add(
    "e35_guard",
    f"""WITH p AS (SELECT vec_id % 5 AS fold, truth, predicted, 0.8 * ln(p1) + 0.2 * ln(q1) AS z1, 0.8 * ln(p2) + 0.2 * ln(q2) AS z2, 0.8 * ln(p3) + 0.2 * ln(q3) AS z3 FROM {PRED_SQL}),
h AS (SELECT fold, CAST(truth = predicted AS INT) AS base, CAST(truth = CASE WHEN z1 >= z2 AND z1 >= z3 THEN 1 WHEN z2 >= z3 THEN 2 ELSE 3 END AS INT) AS final FROM p),
f AS (SELECT fold, avg(final) - avg(base) AS d FROM h GROUP BY 1), w AS (SELECT avg(final) - avg(base) AS d FROM h),
a AS (SELECT avg(CAST(d >= -1e-6 AS INT)) AS n, avg(CAST(d > 1e-6 AS INT)) AS b FROM f)
SELECT n AS noninferior_share, b AS better_share, w.d < -1e-6 OR n < 0.6 OR b < 0.4 AS dropped FROM a CROSS JOIN w""",
)
def _(t: Tables) -> DataFrame:
    """Whether mixing in the prior is dropped, by folds of the prediction's number."""
    p = predictions(t).withColumn("mixed", V.log_pool(F.col("probs"), F.col("prior"), 0.2)).withColumn("fold", F.col("vec_id") % 5)
    right = lambda c: F.avg((V.argmax(F.col(c)) == F.col("truth")).cast("double"))
    whole = p.agg(F.lit(None).cast("long").alias("fold"), right("probs").alias("base"), right("mixed").alias("final"))
    return fit.guard(p.groupBy("fold").agg(right("probs").alias("base"), right("mixed").alias("final")).unionByName(whole), True)


@add(
    "m20_state_support",
    f"""WITH v AS (SELECT subject_id, state_id AS state, avg(directional_z) AS value FROM {EV_SQL} WHERE isfinite(directional_z) GROUP BY ALL), l AS (SELECT * FROM (VALUES ('HC', 0.0), ('MCI', 0.8), ('AD', 1.6)) x(label, center)),
d AS (SELECT subject_id, label, avg(abs(value - center) / 1.5) AS d FROM v CROSS JOIN l GROUP BY ALL), e AS (SELECT *, exp(min(d) OVER (PARTITION BY subject_id) - d) AS e FROM d) SELECT subject_id, label, round(e / sum(e) OVER (PARTITION BY subject_id), 9) AS support FROM e""",
)
def _(t: Tables) -> DataFrame:
    z = F.col("directional_z")
    v = ev(t).where(z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf"))).groupBy("subject_id", F.col("state_id").alias("state")).agg(F.avg("directional_z").alias("value"))
    labels = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(c).alias("center")) for a, c in (("HC", 0.0), ("MCI", 0.8), ("AD", 1.6))])
    protos = t.metric_registry.select(F.col("state_id").alias("state")).distinct().select("state", F.explode(labels).alias("x")).select("state", "x.*", F.lit(1.5).alias("scale"), F.lit(1.0).alias("weight"))
    return fit.state_support(v, protos, "subject_id").select("subject_id", "label", r(F.col("support")).alias("support"))


@add("e39_contributions", f"SELECT vec_id, round(0.5 * ln(p1), 9) AS c1, round(-0.2 * ln(p2), 9) AS c2, round(0.1 * ln(p3), 9) AS c3, round(0.5 * ln(p1) - 0.2 * ln(p2) + 0.1 * ln(p3), 9) AS total FROM {PRED_SQL}")
def _(t: Tables) -> DataFrame:
    c = F.zip_with(F.array(F.lit(0.5), F.lit(-0.2), F.lit(0.1)), V.logs(F.col("probs")), lambda w, x: w * x)
    return predictions(t).select("vec_id", *[r(F.element_at(c, i)).alias(f"c{i}") for i in (1, 2, 3)], r(V.total(c)).alias("total"))
