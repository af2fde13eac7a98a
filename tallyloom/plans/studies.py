"""Robust references, the evidence cube, evaluation, overlap studies and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import parse
from tallyloom.operators import evaluate as E
from tallyloom.operators import research as S
from tallyloom.operators import robust as R
from tallyloom.plans.catalog import Catalog, Tables, r
from tallyloom.plans.relational import EV_SQL, ev
from tallyloom.plans.vectors import PRED_SQL, predictions

catalog = Catalog()
add = catalog.add
QUERIES, ORACLES = catalog.queries, catalog.oracles

# --- robust references ------------------------------------------------------------

_REF = """, m AS (SELECT k, median(value) AS med, stddev_pop(value) AS sd, count(*) AS n, min(value) AS lo, max(value) AS hi FROM c GROUP BY 1),
d AS (SELECT c.k, median(abs(c.value - m.med)) AS mad FROM c JOIN m USING (k) GROUP BY 1),
ref AS (SELECT k, n, med, greatest(1.4826 * mad, 0.25 * sd) AS s, lo < hi AND greatest(1.4826 * mad, 0.25 * sd) > greatest(1e-8, abs(med) * 1e-8) AS ok FROM m JOIN d USING (k)) """


@add("a07_robust_reference", f"WITH c AS (SELECT metric_instance_id AS k, value FROM {EV_SQL} WHERE split = 'train' AND label = 'HC')" + _REF + "SELECT k AS metric_instance_id, n, round(med, 9) AS median, round(CASE WHEN ok THEN s ELSE 1.0 END, 9) AS scale, ok AS available FROM ref")
def _(t: Tables) -> DataFrame:
    cohort = ev(t).where("split = 'train' AND label = 'HC'")
    x = R.robust_reference(cohort, ["metric_instance_id"], "value")
    return x.select("metric_instance_id", "n", r(F.col("median")).alias("median"), r(F.col("scale")).alias("scale"), "available")


@add("a08_reference_by_language", f"WITH c AS (SELECT metric_instance_id || '|' || language AS k, value FROM {EV_SQL} WHERE split = 'train' AND label = 'HC' AND language IS NOT NULL)" + _REF + "SELECT k, n, round(med, 9) AS median, round(CASE WHEN ok AND n >= 8 THEN s ELSE 1.0 END, 9) AS scale, ok AND n >= 8 AS available FROM ref")
def _(t: Tables) -> DataFrame:
    cohort = ev(t).where("split = 'train' AND label = 'HC' AND language IS NOT NULL").withColumn("k", F.concat_ws("|", "metric_instance_id", "language"))
    x = R.robust_reference(cohort, ["k"], "value", least=8)
    return x.select("k", "n", r(F.col("median")).alias("median"), r(F.col("scale")).alias("scale"), "available")


@add("a09_recalibrated_z", f"WITH c AS (SELECT metric_instance_id AS k, value FROM {EV_SQL} WHERE split = 'train' AND label = 'HC')" + _REF + f"SELECT e.label, e.metric_instance_id, count(*) AS n, round(avg(CASE WHEN ok THEN (e.value - med) / s END), 9) AS mean_z FROM {EV_SQL} e JOIN ref ON e.metric_instance_id = ref.k WHERE e.split = 'test' GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    """References of the training cohort applied to the test rows."""
    ref = R.robust_reference(ev(t).where("split = 'train' AND label = 'HC'"), ["metric_instance_id"], "value")
    e = ev(t).where("split = 'test'").join(ref.drop("n"), "metric_instance_id")
    z = F.when(F.col("available"), (F.col("value") - F.col("median")) / F.col("scale"))
    return e.groupBy("label", "metric_instance_id").agg(F.count("*").alias("n"), r(F.avg(z)).alias("mean_z"))


@add(
    "a10_fold_references",
    f"""WITH f AS (SELECT metric_instance_id, value, CAST(right(regexp_replace(subject_id, '[^0-9]', '', 'g'), 2) AS INT) % 3 AS own FROM {EV_SQL} WHERE split = 'train' AND label = 'HC' AND regexp_matches(subject_id, '[0-9]')),
c AS (SELECT metric_instance_id || '|' || fold AS k, value FROM f CROSS JOIN (SELECT unnest([0, 1, 2]) AS fold) WHERE own <> fold)""" + _REF + "SELECT k, n, round(med, 9) AS median, round(CASE WHEN ok THEN s ELSE 1.0 END, 9) AS scale FROM ref",
)
def _(t: Tables) -> DataFrame:
    """The references of all folds in one job: each row enters the folds it is not held out of."""
    digits = F.regexp_replace("subject_id", "[^0-9]", "")
    e = ev(t).where("split = 'train' AND label = 'HC'").where(F.col("subject_id").rlike("[0-9]")).withColumn("own", F.right(digits, F.lit(2)).cast("int") % 3)
    folds = e.withColumn("fold", F.explode(F.filter(F.array(*map(F.lit, range(3))), lambda x: x != F.col("own")))).withColumn("k", F.concat_ws("|", "metric_instance_id", F.col("fold").cast("string")))
    x = R.robust_reference(folds, ["k"], "value")
    return x.select("k", "n", r(F.col("median")).alias("median"), r(F.col("scale")).alias("scale"))


@add("a11_weighted_mean", f"SELECT metric_instance_id, round(sum(value * reliability) / sum(reliability), 9) AS mean FROM {EV_SQL} WHERE reliability > 0 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return ev(t).where("reliability > 0").groupBy("metric_instance_id").agg(r(F.sum(F.col("value") * F.col("reliability")) / F.sum("reliability")).alias("mean"))


@add("a12_weighted_median", "WITH w AS (SELECT l_returnflag, l_extendedprice, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), k AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY l_returnflag) AS a FROM w) SELECT l_returnflag, min(l_extendedprice) AS weighted_median FROM k WHERE run >= a / 2 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return R.weighted_median(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity")


@add("a14_family_scores", None)
def _(t: Tables) -> DataFrame:
    """State scores of correlated families: one family a state and evidence role of the registry."""
    e = ev(t).select("subject_id", F.col("metric_instance_id").alias("metric_id"), parse.finite(F.col("directional_z")).alias("z"), "reliability")
    families = t.metric_registry.select("state_id", F.concat_ws("/", "state_id", "evidence_role").alias("family_id"), "metric_id", F.lit(1.0).alias("weight"), F.when(F.col("evidence_role") == "primary", 1.0).otherwise(0.5).alias("budget"))
    return R.family_scores(e, families, ["subject_id"])


@add("a15_shared_and_residual", f"WITH s AS (SELECT subject_id, state_id, task_scope, avg(directional_z) AS z FROM {EV_SQL} WHERE isfinite(directional_z) GROUP BY ALL), x AS (SELECT subject_id, state_id, avg(z) AS shared, count(*) AS n FROM s WHERE task_scope <> 'global' GROUP BY ALL) SELECT s.subject_id, s.state_id, s.task_scope, round(x.shared, 9) AS shared, CASE WHEN x.n >= 2 THEN round((s.z - x.shared) * x.n / (x.n + 1.0), 9) ELSE 0.0 END AS residual FROM s JOIN x USING (subject_id, state_id) WHERE s.task_scope <> 'global'")
def _(t: Tables) -> DataFrame:
    """A state shared by the named tasks, and what each task adds, shrunken by the number of tasks."""
    z = parse.finite(F.col("directional_z"))
    s = ev(t).where(z.isNotNull()).groupBy("subject_id", "state_id", "task_scope").agg(F.avg("directional_z").alias("z")).where("task_scope <> 'global'")
    x = s.groupBy("subject_id", "state_id").agg(F.avg("z").alias("shared"), F.count("*").alias("n"))
    residual = F.when(F.col("n") >= 2, r((F.col("z") - F.col("shared")) * F.col("n") / (F.col("n") + 1.0))).otherwise(0.0)
    return s.join(x, ["subject_id", "state_id"]).select("subject_id", "state_id", "task_scope", r(F.col("shared")).alias("shared"), residual.alias("residual"))


@add("a16_state_cards", f"SELECT subject_id, state_id, round(sum(reliability * greatest(-5.0, least(5.0, directional_z))) / nullif(sum(reliability), 0), 9) AS state_z, round(avg(reliability), 9) AS reliability, round(avg(CAST(missing AS INT)), 9) AS missing_fraction, bool_and(report_permission) AS report_permission FROM {EV_SQL} WHERE isfinite(directional_z) AND reliability IS NOT NULL GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    z = parse.finite(F.col("directional_z"))
    e = ev(t).where(z.isNotNull() & F.col("reliability").isNotNull())
    w = F.sum("reliability")
    return e.groupBy("subject_id", "state_id").agg(r(F.sum(F.col("reliability") * parse.clip(z, -5.0, 5.0)) / F.nullif(w, F.lit(0.0))).alias("state_z"), r(F.avg("reliability")).alias("reliability"), r(F.avg(F.col("missing").cast("int"))).alias("missing_fraction"), F.bool_and("report_permission").alias("report_permission"))


_STATES = [f"S{i:02d}" for i in range(1, 14)]


@add("a17_state_wide", "SELECT subject_id, " + ", ".join(f"round(avg(directional_z) FILTER (state_id = '{s}'), 9) AS state_{s}" for s in _STATES) + f" FROM {EV_SQL} WHERE isfinite(directional_z) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    z = parse.finite(F.col("directional_z"))
    return ev(t).where(z.isNotNull()).groupBy("subject_id").agg(*[r(F.avg(F.when(F.col("state_id") == s, z))).alias(f"state_{s}") for s in _STATES])


@add("m01_robust_z", f"SELECT subject_id, metric_instance_id, task_scope, value, round((value - reference_median) / reference_scale, 9) AS z FROM {EV_SQL} WHERE reference_scale > 0")
def _(t: Tables) -> DataFrame:
    return ev(t).where("reference_scale > 0").select("subject_id", "metric_instance_id", "task_scope", "value", r((F.col("value") - F.col("reference_median")) / F.col("reference_scale")).alias("z"))


# --- evaluation ---------------------------------------------------------------------


@add("e01_confusion", f"SELECT t AS truth, p AS predicted, (SELECT count(*) FROM {PRED_SQL} WHERE truth = t AND predicted = p) AS n FROM (SELECT unnest([1, 2, 3]) AS t) CROSS JOIN (SELECT unnest([1, 2, 3]) AS p)")
def _(t: Tables) -> DataFrame:
    return E.confusion(predictions(t), [], 3)


@add(
    "e02_per_class",
    f"""WITH p AS {PRED_SQL}, c AS (SELECT k AS class, count(*) FILTER (truth = k AND predicted = k) AS tp, count(*) FILTER (truth = k AND predicted <> k) AS fn, count(*) FILTER (truth <> k AND predicted = k) AS fp, count(*) FILTER (truth <> k AND predicted <> k) AS tn FROM p CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) GROUP BY 1)
SELECT class, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS sensitivity, tn / nullif(tn + fp, 0) AS specificity, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, tp + fn AS support FROM c""",
)
def _(t: Tables) -> DataFrame:
    return E.per_class(predictions(t), [], 3)


@add(
    "e03_summary",
    f"""WITH p AS {PRED_SQL}, k AS (SELECT unnest([1, 2, 3]) AS k), c AS (SELECT k, count(*) FILTER (truth = k AND predicted = k) AS tp, count(*) FILTER (truth = k) AS s, count(*) FILTER (predicted = k) AS q, count(*) AS n FROM p CROSS JOIN k GROUP BY 1),
x AS (SELECT sum(tp) / any_value(n) AS accuracy, avg(tp / nullif(s, 0)) AS balanced_accuracy, avg(coalesce(2 * tp / nullif(s + q, 0), 0)) AS macro_f1, sum(s * coalesce(2 * tp / nullif(s + q, 0), 0)) / any_value(n) AS weighted_f1,
(sum(tp) * any_value(n) - sum(s * q)) / sqrt((any_value(n) * any_value(n) - sum(q * q)) * (any_value(n) * any_value(n) - sum(s * s))) AS mcc FROM c),
y AS (SELECT count(*) AS n, avg((p1 - CAST(truth = 1 AS INT)) ** 2 + (p2 - CAST(truth = 2 AS INT)) ** 2 + (p3 - CAST(truth = 3 AS INT)) ** 2) AS brier, avg(-ln(CASE truth WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END)) AS log_loss,
avg(CAST(greatest(p1, p2, p3) - (p1 + p2 + p3 - greatest(p1, p2, p3) - least(p1, p2, p3)) <= 0.1 AS INT)) AS near_threshold, avg(CAST(truth <> predicted AND greatest(p1, p2, p3) >= 0.8 AS INT)) AS high_confidence_error FROM p)
SELECT n, round(accuracy, 9) AS accuracy, round(balanced_accuracy, 9) AS balanced_accuracy, round(macro_f1, 9) AS macro_f1, round(weighted_f1, 9) AS weighted_f1, round(mcc, 9) AS mcc, round(brier, 9) AS brier, round(log_loss, 9) AS log_loss, round(near_threshold, 9) AS near_threshold, round(high_confidence_error, 9) AS high_confidence_error FROM x CROSS JOIN y""",
)
def _(t: Tables) -> DataFrame:
    s = E.summary(predictions(t), [], 3)
    return s.select("n", *[r(F.col(c)).alias(c) for c in s.columns if c != "n"])


def _one_vs_rest(t: Tables) -> DataFrame:
    return predictions(t).select("vec_id", "truth", F.posexplode("probs").alias("c", "score")).select((F.col("c") + 1).alias("class"), "score", (F.col("truth") == F.col("c") + 1).alias("positive"))


_OVR = f"(SELECT k AS class, CASE k WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS score, truth = k AS positive FROM {PRED_SQL} CROSS JOIN (SELECT unnest([1, 2, 3]) AS k))"


@add("e04_auroc", f"WITH s AS {_OVR}, v AS (SELECT class, score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM s GROUP BY ALL), w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v) SELECT class, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 9) AS auroc FROM w GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return E.auroc(_one_vs_rest(t), ["class"], "score", "positive").select("class", r(F.col("auroc")).alias("auroc"))


@add("e05_average_precision", f"WITH s AS {_OVR}, v AS (SELECT class, score, count(*) FILTER (positive) AS p, count(*) AS c FROM s GROUP BY ALL), w AS (SELECT *, sum(p) OVER (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(c) OVER (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS upto FROM v) SELECT class, round(sum(p * tp / upto) / sum(p), 9) AS average_precision FROM w GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return E.average_precision(_one_vs_rest(t), ["class"], "score", "positive").select("class", r(F.col("average_precision")).alias("average_precision"))


@add("e07_calibration_error", f"WITH p AS (SELECT greatest(p1, p2, p3) AS c, CAST(truth = predicted AS INT) AS k FROM {PRED_SQL}), b AS (SELECT ceil(c * 10) AS b, count(*) AS n, avg(c) AS c, avg(k) AS k FROM p GROUP BY 1) SELECT round(sum(n * abs(k - c)) / sum(n), 9) AS ece FROM b WHERE b > 0")
def _(t: Tables) -> DataFrame:
    return E.expected_calibration_error(predictions(t), []).select(r(F.col("ece")).alias("ece"))


@add("e09_operating_point", f"SELECT class, count(*) FILTER (score >= 0.4 AND positive) / nullif(count(*) FILTER (positive), 0) AS sensitivity, count(*) FILTER (score < 0.4 AND NOT positive) / nullif(count(*) FILTER (NOT positive), 0) AS specificity, count(*) FILTER (score >= 0.4 AND positive) / nullif(count(*) FILTER (score >= 0.4), 0) AS ppv, count(*) FILTER (score < 0.4 AND NOT positive) / nullif(count(*) FILTER (score < 0.4), 0) AS npv FROM {_OVR} GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return E.operating_point(_one_vs_rest(t), ["class"], "score", "positive", 0.4)


@add(
    "e12_bootstrap",
    """WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), n AS (SELECT count(*) AS n FROM v),
d AS (SELECT r AS replicate, ((r * 7919 + k * 104729 + r * k * 31 + 12345) * 1103515245 + 12345) % 2147483648 % n AS i FROM (SELECT unnest(range(20)) AS r) CROSS JOIN n CROSS JOIN (SELECT i AS k FROM v))
SELECT replicate, round(avg(x), 9) AS mean FROM d JOIN v USING (i) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", F.element_at("embedding", 1).cast("double").alias("x"))
    return E.bootstrap_mean(e, "vec_id", "x", 20).select("replicate", r(F.col("mean")).alias("mean"))


@add("e31_grid_selection", f"WITH g AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS a), s AS (SELECT a, avg(-ln((1 - a) * CASE truth WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END + a * CASE truth WHEN 1 THEN q1 WHEN 2 THEN q2 ELSE q3 END)) AS loss FROM {PRED_SQL} CROSS JOIN g GROUP BY 1) SELECT a AS strength, round(loss, 9) AS loss, loss = (SELECT min(loss) FROM s) AS chosen FROM s")
def _(t: Tables) -> DataFrame:
    """The loss of every blend strength of a grid, in one pass: the grid is a fixed few values exploded by row."""
    from pyspark.sql import Window as W

    p = predictions(t).withColumn("strength", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])))
    a = F.col("strength")
    s = p.groupBy("strength").agg(F.avg(-F.log((1 - a) * F.element_at("probs", F.col("truth")) + a * F.element_at("prior", F.col("truth")))).alias("loss"))
    return s.select("strength", r(F.col("loss")).alias("loss"), (F.col("loss") == F.min("loss").over(W.partitionBy())).alias("chosen"))


# --- overlap and inference studies ------------------------------------------------------

_LONG = f"(SELECT split, task_scope, subject_id, metric_instance_id AS m, avg(value) AS v FROM {EV_SQL} WHERE split IS NOT NULL AND task_scope IS NOT NULL GROUP BY ALL)"
_SIDES = "p AS (SELECT split, task_scope, x.m AS a, y.m AS b, x.v AS x, y.v AS y FROM l x JOIN l y USING (split, task_scope, subject_id) WHERE x.m < y.m)"
_STRATA = ["split", "task_scope"]


def _long(t: Tables) -> DataFrame:
    e = ev(t).where(F.col("split").isNotNull() & F.col("task_scope").isNotNull())
    return e.groupBy("split", "task_scope", "subject_id", F.col("metric_instance_id").alias("m")).agg(F.avg("value").alias("v"))


@add("e15_spearman", f"WITH l AS {_LONG}, {_SIDES}, k AS (SELECT split, task_scope, a, b, rank() OVER (PARTITION BY split, task_scope, a, b ORDER BY x) + (count(*) OVER (PARTITION BY split, task_scope, a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY split, task_scope, a, b ORDER BY y) + (count(*) OVER (PARTITION BY split, task_scope, a, b, y) - 1) / 2.0 AS ry FROM p) SELECT split, task_scope, a, b, count(*) AS n, CASE WHEN var_pop(rx) > 1e-9 AND var_pop(ry) > 1e-9 THEN round(corr(rx, ry), 7) END AS rho FROM k GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return S.spearman(_long(t), _STRATA, "subject_id", "m", "v").select(*_STRATA, "a", "b", "n", F.round("rho", 7).alias("rho"))


@add(
    "e16_copies",
    f"""WITH l AS {_LONG}, {_SIDES}, g AS (SELECT split, task_scope, a, b, count(*) AS n, bool_and(abs(x - y) <= 1e-9) AS equal, bool_and(abs(x + y - 1) <= 1e-9) AS complement, CASE WHEN var_pop(x) > 1e-12 THEN covar_pop(y, x) / var_pop(x) END AS slope, avg(x) AS mx, avg(y) AS my FROM p GROUP BY ALL)
SELECT split, task_scope, a, b, g.n, equal, complement, round(slope, 9) AS slope, round(max(abs(y - (my - slope * mx) - slope * x)), 8) AS largest_residual FROM g JOIN p USING (split, task_scope, a, b) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    x = S.copies(_long(t), _STRATA, "subject_id", "m", "v")
    return x.select(*_STRATA, "a", "b", "n", "equal", "complement", F.round("slope", 9).alias("slope"), F.round("largest_residual", 8).alias("largest_residual"))


@add("e18_effective_rank", None)
def _(t: Tables) -> DataFrame:
    return S.effective_rank(_long(t), _STRATA, "subject_id", "m", "v")


@add("e17_overlap_groups", None)
def _(t: Tables) -> DataFrame:
    """Metrics linked in some stratum by rank correlations of 0.6 or more either way over 20 units or more, isolated ones kept."""
    rho = S.spearman(_long(t), _STRATA, "subject_id", "m", "v").where((F.abs("rho") >= 0.6) & (F.col("n") >= 20)).select("a", "b").distinct()
    return S.linked_groups(rho, t.metric_registry.select(F.col("metric_id").alias("item")))


@add("e20_kruskal", f"WITH e AS (SELECT metric_instance_id AS m, label, value FROM {EV_SQL} WHERE label IS NOT NULL), k AS (SELECT m, label, rank() OVER (PARTITION BY m ORDER BY value) + (count(*) OVER (PARTITION BY m, value) - 1) / 2.0 AS r FROM e), g AS (SELECT m, label, count(*) AS n, sum(r) AS s FROM k GROUP BY ALL), h AS (SELECT m, CAST(sum(n) AS DOUBLE) AS n, count(*) AS groups, sum(s * s / n) AS q FROM g GROUP BY 1), t AS (SELECT m, sum(CAST(c AS DOUBLE) ** 3 - c) AS t FROM (SELECT m, value, count(*) AS c FROM e GROUP BY ALL) GROUP BY 1) SELECT m AS metric_instance_id, CAST(n AS BIGINT) AS n, groups, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n ** 3 - n)), 4) AS h, CASE WHEN groups = 3 THEN round(exp(-(12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n ** 3 - n)) / 2), 5) END AS p_value FROM h JOIN t USING (m) WHERE groups > 1")
def _(t: Tables) -> DataFrame:
    """With three groups the tail is an exponential, which SQL can give too; other numbers of groups are tested in pytest."""
    k = S.kruskal(ev(t).where(F.col("label").isNotNull()), ["metric_instance_id"], "label", "value")
    return k.where("groups > 1").select("metric_instance_id", "n", "groups", F.round("h", 4).alias("h"), F.when(F.col("groups") == 3, F.round("p_value", 5)).alias("p_value"))


@add("e21_benjamini_hochberg", "WITH p AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) / 10 AS p FROM embeddings), r AS (SELECT vec_id, p, row_number() OVER (ORDER BY p, vec_id) AS k, count(*) OVER () AS m FROM p) SELECT vec_id, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 9) AS q_value FROM r")
def _(t: Tables) -> DataFrame:
    p = t.embeddings.select(F.lit(1).alias("family"), "vec_id", (F.abs(F.element_at("embedding", 1).cast("double")) / 10).alias("p"))
    return S.benjamini_hochberg(p, ["family"], "p", "vec_id").select("vec_id", r(F.col("q_value")).alias("q_value"))


@add("j15_jaccard", "WITH d AS (SELECT state_id AS g, unnest(confounds) AS i FROM metric_registry), u AS (SELECT DISTINCT g, i FROM d), s AS (SELECT g, count(*) AS n FROM u GROUP BY 1) SELECT x.g AS a, y.g AS b, count(*) AS shared, round(count(*) / (any_value(sx.n) + any_value(sy.n) - count(*)), 9) AS jaccard FROM u x JOIN u y ON x.i = y.i AND x.g < y.g JOIN s sx ON sx.g = x.g JOIN s sy ON sy.g = y.g GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    d = t.metric_registry.select("state_id", F.explode("confounds").alias("i"))
    return S.jaccard(d, "state_id", "i").select("a", "b", "shared", r(F.col("jaccard")).alias("jaccard"))


# --- audits ----------------------------------------------------------------------------


@add(
    "g01_manifest_audit",
    """SELECT count(*) AS n, count(*) - count(DISTINCT case_id) AS repeated_cases, count(*) FILTER (split IS NULL) AS no_split, (SELECT count(*) FROM (SELECT subject_id FROM manifest WHERE subject_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS subjects_across,
(SELECT count(*) FROM (SELECT audio_sha256 FROM manifest WHERE audio_sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS hashes_across, (SELECT count(*) FROM (SELECT subject_id FROM manifest WHERE subject_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label) > 1)) AS label_conflicts FROM manifest""",
)
def _(t: Tables) -> DataFrame:
    m = t.manifest.select("case_id", "split", "subject_id", "audio_sha256", "label")

    def conflicts(key: str, column: str, name: str) -> DataFrame:
        return m.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(column).alias("a"), F.max(column).alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias(name))

    out = m.agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("case_id")).alias("repeated_cases"), F.count_if(F.col("split").isNull()).alias("no_split"))
    # Each side is one row.
    for part in (conflicts("subject_id", "split", "subjects_across"), conflicts("audio_sha256", "split", "hashes_across"), conflicts("subject_id", "label", "label_conflicts")):
        out = out.join(F.broadcast(part))
    return out


@add("g03_trace_presence", "SELECT round(avg(CAST(coalesce(len(s.evidence_segments), 0) > 0 AS INT)), 9) AS with_segments, round(avg(CAST(coalesce(len(s.metric_evidence_ids), 0) > 0 AS INT)), 9) AS with_metrics FROM (SELECT unnest(state_observations) AS s FROM synthetic_workspace) WHERE s IS NOT NULL")
def _(t: Tables) -> DataFrame:
    s = t.synthetic_workspace.select(F.explode("state_observations").alias("s")).where(F.col("s").isNotNull())
    rate = lambda c: r(F.avg((F.coalesce(F.size(c), F.lit(0)) > 0).cast("int")))
    return s.agg(rate("s.evidence_segments").alias("with_segments"), rate("s.metric_evidence_ids").alias("with_metrics"))


@add("g05_permission_rate", "SELECT g.report_permission AS allowed, count(*) AS n FROM (SELECT unnest(s.supporting_metrics) AS m FROM (SELECT unnest(state_observations) AS s FROM synthetic_workspace)) x JOIN metric_registry g ON g.metric_id = x.m.metric_id GROUP BY 1")
def _(t: Tables) -> DataFrame:
    m = t.synthetic_workspace.select(F.explode("state_observations").alias("s")).select(F.explode("s.supporting_metrics").alias("m")).select(F.col("m.metric_id").alias("metric_id"))
    return m.join(t.metric_registry.select("metric_id", F.col("report_permission").alias("allowed")), "metric_id").groupBy("allowed").agg(F.count("*").alias("n"))


@add("g08_extreme_rates", "SELECT state_id, round(avg(CAST(abs(directional_z) >= 3 AS INT)), 9) AS extreme FROM metric_evidence WHERE isfinite(directional_z) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    e = t.metric_evidence.where(parse.finite(F.col("directional_z")).isNotNull())
    return e.groupBy("state_id").agg(r(F.avg((F.abs("directional_z") >= 3).cast("int"))).alias("extreme"))


@add("g09_leak_rate", "SELECT doc_kind, round(avg(CAST(regexp_matches(text, 'case_[0-9]{2}_[0-9]+|SUB-[0-9]{2}') AS INT)), 9) AS leaks FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.documents.where(F.col("text").isNotNull()).groupBy("doc_kind").agg(r(F.avg(F.col("text").rlike("case_[0-9]{2}_[0-9]+|SUB-[0-9]{2}").cast("int"))).alias("leaks"))


@add("g12_check_rows", "SELECT 'missing_split' AS check_name, avg(CAST(split IS NULL AS DOUBLE)) AS value, avg(CAST(split IS NULL AS DOUBLE)) <= 0.05 AS passed FROM manifest UNION ALL SELECT 'missing_label', avg(CAST(label IS NULL AS DOUBLE)), avg(CAST(label IS NULL AS DOUBLE)) <= 0.0001 FROM manifest")
def _(t: Tables) -> DataFrame:
    one = t.manifest.agg(F.avg(F.col("split").isNull().cast("double")).alias("a"), F.avg(F.col("label").isNull().cast("double")).alias("b"))
    rows = F.array(F.struct(F.lit("missing_split").alias("check_name"), F.col("a").alias("value"), (F.col("a") <= 0.05).alias("passed")), F.struct(F.lit("missing_label").alias("check_name"), F.col("b").alias("value"), (F.col("b") <= 0.0001).alias("passed")))
    return one.select(F.explode(rows).alias("x")).select("x.*")
