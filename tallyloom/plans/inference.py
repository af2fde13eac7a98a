"""Averaged areas, resampling with intervals, folds, grids and left-out fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import fusion as U
from tallyloom.functions import vectors as V
from tallyloom.operators import evaluate as E
from tallyloom.operators import fit, prefix
from tallyloom.plans.catalog import Catalog, Tables, r
from tallyloom.plans.vectors import PRED_SQL, predictions

catalog = Catalog()
add = catalog.add
QUERIES, ORACLES = catalog.queries, catalog.oracles

_LONG = f"(SELECT c AS class, CASE c WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS score, truth = c AS pos FROM {PRED_SQL} CROSS JOIN (SELECT unnest([1, 2, 3]) AS c))"


def _averages(of: str) -> str:
    """macro, micro and weighted of a measure. of: SQL of ``v`` by group ``g`` over the rows ``l``."""
    return f"""WITH l0 AS (SELECT * FROM {_LONG}), l AS (SELECT CAST(class AS VARCHAR) AS g, score, pos FROM l0 UNION ALL SELECT 'all', score, pos FROM l0), {of},
s AS (SELECT g, count(*) FILTER (pos) AS n FROM l GROUP BY 1)
SELECT round(avg(v) FILTER (g <> 'all'), 9) AS macro, round(max(v) FILTER (g = 'all'), 9) AS micro, round(sum(v * n) FILTER (g <> 'all') / sum(n) FILTER (g <> 'all'), 9) AS weighted FROM m JOIN s USING (g)"""


def _rounded(x: DataFrame) -> DataFrame:
    return x.select(*[r(F.col(c)).alias(c) for c in ("macro", "micro", "weighted")])


@add(
    "e04_auroc_averages",
    _averages(
        "k AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY score) + (count(*) OVER (PARTITION BY g, score) - 1) / 2.0 AS r FROM l), m AS (SELECT g, (sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS v FROM k GROUP BY 1)"
    ),
)
def _(t: Tables) -> DataFrame:
    return _rounded(E.averaged(predictions(t), [], 3, E.auroc, "auroc"))


@add(
    "e05_average_precision_averages",
    _averages(
        "c AS (SELECT g, score, count(*) FILTER (pos) AS p, count(*) AS c FROM l GROUP BY ALL), k AS (SELECT g, p, sum(p) OVER (PARTITION BY g ORDER BY score DESC) AS tp, sum(c) OVER (PARTITION BY g ORDER BY score DESC) AS a FROM c), m AS (SELECT g, sum(p * tp / a) / sum(p) AS v FROM k GROUP BY 1)"
    ),
)
def _(t: Tables) -> DataFrame:
    return _rounded(E.averaged(predictions(t), [], 3, E.average_precision, "average_precision"))


#: Replicates of the resampling queries; the SQL allows as many more draws as the operator does.
_REPLICATES = 25

_DRAWN = f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, truth, predicted AS a, CASE WHEN p2 >= p3 AND p2 >= p1 THEN 1 WHEN p3 >= p1 THEN 2 ELSE 3 END AS b FROM {PRED_SQL}), n AS (SELECT count(*) AS n FROM v),
d AS (SELECT rep, ((rep * 7919 + k * 104729 + rep * k * 31 + 12345) * 1103515245 + 12345) % 2147483648 % n AS i FROM (SELECT unnest(range({_REPLICATES} * 8)) AS rep) CROSS JOIN n CROSS JOIN (SELECT i AS k FROM v)),
w AS (SELECT rep, v.* FROM d JOIN v USING (i) UNION ALL SELECT -1, v.* FROM v),
c AS (SELECT rep, {", ".join(f"count(*) FILTER (truth = {i} AND {x} = {j}) AS {x}{i}{j}" for x in "ab" for i in (1, 2, 3) for j in (1, 2, 3))} FROM w GROUP BY 1),
k AS (SELECT * FROM c WHERE rep = -1 OR (a11 + a12 + a13 > 0 AND a21 + a22 + a23 > 0 AND a31 + a32 + a33 > 0)),
f AS (SELECT *, row_number() OVER (ORDER BY rep) AS place FROM k)"""


def _measures(x: str) -> dict[str, str]:
    n = "(" + " + ".join(f"{x}{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)) + ")"
    row = lambda i: f"({x}{i}1 + {x}{i}2 + {x}{i}3)"
    col = lambda j: f"({x}1{j} + {x}2{j} + {x}3{j})"
    return {
        "accuracy": f"(({x}11 + {x}22 + {x}33) / {n})",
        "balanced_accuracy": "((" + " + ".join(f"{x}{i}{i} / {row(i)}" for i in (1, 2, 3)) + ") / 3)",
        "macro_f1": "((" + " + ".join(f"coalesce(2 * {x}{i}{i} / nullif({row(i)} + {col(i)}, 0), 0)" for i in (1, 2, 3)) + ") / 3)",
    }


def _intervals_sql(value: dict[str, str], more: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT '{m}' AS measure, round(max({x}) FILTER (rep = -1), 9) AS estimate, round(quantile_cont({x}, 0.025) FILTER (rep >= 0), 9) AS ci_low, round(quantile_cont({x}, 0.975) FILTER (rep >= 0), 9) AS ci_high, count(*) FILTER (rep >= 0) AS replicates FROM f WHERE place <= {_REPLICATES} + 1" for m, x in value.items())
    return f"{_DRAWN} SELECT * FROM ({parts}){more}"


def _pair(t: Tables) -> DataFrame:
    turned = V.argmax(F.array(*[F.element_at("probs", i) for i in (2, 3, 1)]))
    return predictions(t).withColumn("other", turned)


def _rounded_intervals(x: DataFrame, *more) -> DataFrame:
    return x.select("measure", *[r(F.col(c)).alias(c) for c in ("estimate", "ci_low", "ci_high")], "replicates", *more)


@add("e12_bootstrap_intervals", _intervals_sql(_measures("a")))
def _(t: Tables) -> DataFrame:
    return _rounded_intervals(E.bootstrap_intervals(_pair(t), "vec_id", "predicted", _REPLICATES))


@add(
    "e13_paired_bootstrap",
    _intervals_sql(
        {m: f"({x} - {_measures('b')[m]})" for m, x in _measures("a").items()},
        """ CROSS JOIN (SELECT x AS only_a, y AS only_b, round(least(1.0, 2 * list_sum(list_transform(range(least(x, y) + 1), lambda i: exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2.0))))), 9) AS p_value
FROM (SELECT count(*) FILTER (a = truth AND b <> truth) AS x, count(*) FILTER (a <> truth AND b = truth) AS y FROM v))""",
    ),
)
def _(t: Tables) -> DataFrame:
    return _rounded_intervals(E.paired_bootstrap(_pair(t), "vec_id", "predicted", "other", _REPLICATES), "only_a", "only_b", r(F.col("p_value")).alias("p_value"))


@add(
    "e13_mcnemar",
    f"""WITH c AS (SELECT count(*) FILTER (predicted = truth AND truth <> 3) AS x, count(*) FILTER (predicted <> truth AND truth = 3) AS y FROM {PRED_SQL})
SELECT x AS only_a, y AS only_b, round(least(1.0, 2 * list_sum(list_transform(range(least(x, y) + 1), lambda i: exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2.0))))), 9) AS p_value FROM c""",
)
def _(t: Tables) -> DataFrame:
    p = predictions(t).withColumn("a", F.col("truth") == F.col("predicted")).withColumn("b", V.argmax(F.col("prior")) == F.col("truth"))
    return E.mcnemar(p, [], "a", "b").select("only_a", "only_b", r(F.col("p_value")).alias("p_value"))


@add(
    "e14_stratified_bootstrap",
    f"""WITH v AS (SELECT truth, row_number() OVER (PARTITION BY truth ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY truth) AS n, CAST(truth = predicted AS INT) AS hit FROM {PRED_SQL}),
d AS (SELECT truth, rep AS replicate, ((rep * 7919 + i * 104729 + rep * i * 31 + 12345) * 1103515245 + 12345) % 2147483648 % n AS i FROM v CROSS JOIN (SELECT unnest(range(10)) AS rep))
SELECT replicate, round(avg(hit), 9) AS accuracy FROM d JOIN v USING (truth, i) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    """Accuracy of resamples drawn within each class: draws stay in their stratum's rows."""
    p = predictions(t).select("vec_id", "truth", (F.col("truth") == F.col("predicted")).cast("double").alias("hit"))
    rows = prefix.numbered(p, ["vec_id"], "i", ["truth"])
    sizes = p.groupBy("truth").agg(F.count("*").alias("n"))
    draws = rows.join(F.broadcast(sizes), "truth").withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")))).select("truth", "replicate", E.draw(F.col("replicate"), F.col("i"), F.col("n")).alias("i"))
    counted = draws.groupBy("truth", "replicate", "i").agg(F.count("*").alias("c"))
    return counted.join(rows.select("truth", "i", "hit"), ["truth", "i"]).groupBy("replicate").agg(r(F.sum(F.col("c") * F.col("hit")) / F.sum("c")).alias("accuracy"))


_PAIRS = "(VALUES (1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)) x(a, b)"


@add(
    "e49_auroc_one_vs_one",
    f"""WITH s AS (SELECT a, b, CASE a WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS score, truth = a AS pos FROM {PRED_SQL} JOIN {_PAIRS} ON truth = a OR truth = b),
k AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY score) + (count(*) OVER (PARTITION BY a, b, score) - 1) / 2.0 AS r FROM s)
SELECT round(avg(v), 9) AS macro_auroc_ovo FROM (SELECT (sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS v FROM k GROUP BY a, b)""",
)
def _(t: Tables) -> DataFrame:
    """Mean over class pairs of the area between the two classes, each scored by its own probability."""
    p = predictions(t)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (1, 2, 3) for b in (1, 2, 3) if a != b])
    s = p.withColumn("ab", F.explode(pairs)).where((F.col("truth") == F.col("ab.a")) | (F.col("truth") == F.col("ab.b")))
    s = s.select(F.col("ab.a").alias("a"), F.col("ab.b").alias("b"), F.element_at("probs", F.col("ab.a")).alias("score"), (F.col("truth") == F.col("ab.a")).alias("positive"))
    return E.auroc(s, ["a", "b"], "score", "positive").agg(r(F.avg("auroc")).alias("macro_auroc_ovo"))


_SUBJECTS = "(SELECT subject_id, min(label) AS label FROM manifest WHERE subject_id IS NOT NULL GROUP BY 1)"


def _placed(t: Tables) -> DataFrame:
    """Subjects with their place within their label in order of hash."""
    s = t.manifest.where(F.col("subject_id").isNotNull()).groupBy("subject_id").agg(F.min("label").alias("label"))
    return prefix.numbered(s.withColumn("h", F.sha2("subject_id", 256)), ["h", "subject_id"], "place", ["label"])


@add("e22_hash_folds", f"SELECT label, fold, count(*) AS n FROM (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY sha256(subject_id), subject_id) - 1) % 5 AS fold FROM {_SUBJECTS}) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return _placed(t).select("label", (F.col("place") % 5).alias("fold")).groupBy("label", "fold").agg(F.count("*").alias("n"))


@add(
    "e22_shuffle_split",
    f"SELECT label, part, count(*) AS n, min(subject_id) AS first_subject FROM (SELECT label, subject_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY sha256(subject_id), subject_id) <= floor(0.2 * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS part FROM {_SUBJECTS}) GROUP BY ALL",
)
def _(t: Tables) -> DataFrame:
    """A fifth of each label's subjects, in order of hash, is the test part."""
    s = prefix.running(_placed(t).withColumn("one", F.lit(1)), ["label"], ["place"], {}, {"n": "one"})
    part = F.when(F.col("place") < F.floor(0.2 * F.col("n")), "test").otherwise("train").alias("part")
    return s.select("label", "subject_id", part).groupBy("label", "part").agg(F.count("*").alias("n"), F.min("subject_id").alias("first_subject"))


_GRID = (0.0, 0.5, 1.0)


@add(
    "e33_two_stage_grid",
    f"""WITH g AS (SELECT x.s AS screening, y.s AS staging FROM (SELECT unnest([0.0, 0.5, 1.0]) AS s) x CROSS JOIN (SELECT unnest([0.0, 0.5, 1.0]) AS s) y),
s AS (SELECT *, p2 + p3 AS rest, p2 / (p2 + p3) AS a, p3 / (p2 + p3) AS b, p2 / (p2 + p3) AS u, p3 / (p2 + p3) AS v, p3 / (p1 + p3) AS m, p1 / (p1 + p3) AS n FROM {PRED_SQL} CROSS JOIN g),
z AS (SELECT *, ln(p1) + screening * ln(u) AS x, ln(rest) + screening * ln(v) AS y, ln(a) + staging * ln(m) AS c, ln(b) + staging * ln(n) AS d FROM s),
k AS (SELECT screening, staging, truth, 1 / (1 + exp(y - x)) AS h, 1 / (1 + exp(x - y)) AS ill, 1 / (1 + exp(d - c)) AS mild FROM z),
l AS (SELECT screening, staging, avg(-ln(CASE truth WHEN 1 THEN h WHEN 2 THEN ill * mild ELSE ill * (1 - mild) END)) AS loss FROM k GROUP BY ALL)
SELECT screening, staging, round(loss, 7) AS loss, loss = (SELECT min(loss) FROM l) AS chosen FROM l""",
)
def _(t: Tables) -> DataFrame:
    """The loss of every pair of strengths of a grid, in one pass, and the least."""
    grid = F.array(*[F.struct(F.lit(a).alias("screening"), F.lit(b).alias("staging")) for a in _GRID for b in _GRID])
    p = predictions(t).withColumn("g", F.explode(grid))
    part = lambda i: F.element_at("probs", i)
    fused = U.two_stage_pool(F.col("probs"), F.array(part(2), part(3)), F.array(part(3), part(1)), F.col("g.screening"), F.col("g.staging"))
    l = p.withColumn("fused", fused).groupBy("g.screening", "g.staging").agg(F.avg(V.log_loss(F.col("fused"), F.col("truth"))).alias("loss"))
    least = l.agg(F.min("loss").alias("_least"))
    return l.join(F.broadcast(least)).select("screening", "staging", r(F.col("loss"), 7).alias("loss"), (F.col("loss") == F.col("_least")).alias("chosen"))


_TEMPERATURES = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0)


@add(
    "e37_calibration_partition",
    f"""WITH p AS (SELECT *, CASE WHEN vec_id % 4 = 0 THEN 'calibration' ELSE 'evaluation' END AS part FROM {PRED_SQL} CROSS JOIN (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5, 2.0]) AS t)),
l AS (SELECT part, t, count(*) AS n, avg(-ln(p / s)) AS loss FROM (SELECT part, t, exp(ln(CASE truth WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END) / t) AS p, exp(ln(p1) / t) + exp(ln(p2) / t) + exp(ln(p3) / t) AS s FROM p) GROUP BY ALL),
b AS (SELECT t FROM l WHERE part = 'calibration' ORDER BY loss, t LIMIT 1)
SELECT part, n, t AS temperature, round(loss, 9) AS loss, round((SELECT loss FROM l o WHERE o.part = l.part AND o.t = 1.0), 9) AS loss_before FROM l WHERE t = (SELECT t FROM b)""",
)
def _(t: Tables) -> DataFrame:
    """The temperature that a partition of its own chooses, and the loss before and after on both parts."""
    p = predictions(t).withColumn("part", F.when(F.col("vec_id") % 4 == 0, "calibration").otherwise("evaluation"))
    each = F.array(*[F.struct(F.lit(x).alias("t"), V.log_loss(V.temperature(F.col("probs"), x), F.col("truth")).alias("loss")) for x in _TEMPERATURES])
    l = p.select("part", F.explode(each).alias("x")).groupBy("part", F.col("x.t").alias("t")).agg(F.count("*").alias("n"), F.avg("x.loss").alias("loss"))
    best = l.where("part = 'calibration'").agg(F.min_by("t", F.struct("loss", "t")).alias("_t"))
    before = l.where("t = 1.0").select("part", F.col("loss").alias("_before"))
    chosen = l.join(F.broadcast(best)).where(F.col("t") == F.col("_t")).join(before, "part")
    return chosen.select("part", "n", F.col("t").alias("temperature"), r(F.col("loss")).alias("loss"), r(F.col("_before")).alias("loss_before"))


def _branches(t: Tables) -> tuple[DataFrame, dict[str, list]]:
    """Rows with a target, folds, and inputs in three branches."""
    e = t.embeddings.select("vec_id", (F.col("label") % 3 == 0).alias("y"), (F.col("vec_id") % 3).cast("int").alias("fold"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    at = lambda *places: [F.element_at("x", i) for i in places]
    return e, {"first": at(1, 2, 3), "second": at(4, 5, 6), "both": at(1, 2, 3, 4, 5, 6)}


@add("e24_ridge_grid", None)
def _(t: Tables) -> DataFrame:
    """Strengths of regularisation by left-out AUROC: folds times strengths are fitted together, a pass a step."""
    e, branches = _branches(t)
    grid = {f"c{k}": (branches["both"], 1.0 / c) for k, c in enumerate((0.01, 0.1, 1.0, 10.0))}
    found = fit.branch_reliability(fit.left_out(e, grid, F.col("y"), "fold", 3), list(grid), F.col("y"))
    best = found.agg(F.max_by("branch", F.struct("auroc", "branch")).alias("_b"))
    return found.join(F.broadcast(best)).select(F.col("branch").alias("strength"), F.round("auroc", 6).alias("auroc"), (F.col("branch") == F.col("_b")).alias("chosen"))


@add("e26_branch_reliability", None)
def _(t: Tables) -> DataFrame:
    """Left-out scores of branches of inputs, how far each can be relied on, and its share of the blend."""
    e, branches = _branches(t)
    found = fit.branch_reliability(fit.left_out(e, {k: (v, 1.0) for k, v in branches.items()}, F.col("y"), "fold", 3), list(branches), F.col("y"))
    whole = found.agg(F.sum("reliability").alias("_s"), F.count("*").alias("_n"))
    share = F.when(F.col("_s") > 0, F.col("reliability") / F.col("_s")).otherwise(1 / F.col("_n"))
    return found.join(F.broadcast(whole)).select("branch", F.round("auroc", 6).alias("auroc"), F.round("reliability", 6).alias("reliability"), F.round(share, 6).alias("share"))


@add("e34_left_out_calibrator", None)
def _(t: Tables) -> DataFrame:
    """A binary calibrator on the logit of the severe class, fitted without each row's fold: Brier score before and after."""
    p = predictions(t).select("vec_id", (F.col("truth") == 3).alias("y"), F.greatest(F.lit(1e-5), F.least(F.lit(1 - 1e-5), F.element_at("probs", 3))).alias("s")).withColumn("fold", (F.col("vec_id") % 5).cast("int"))
    z = [F.log(F.col("s") / (1 - F.col("s")))]
    x = fit.left_out(p, {"calibrated": (z, 1e-6)}, F.col("y"), "fold", 5)
    brier = lambda c: F.avg((F.col(c) - F.col("y").cast("double")) ** 2)
    return x.groupBy("fold").agg(F.count("*").alias("n"), F.round(brier("s"), 6).alias("brier_before"), F.round(brier("calibrated"), 6).alias("brier_after"))


@add("e36_negative_controls", None)
def _(t: Tables) -> DataFrame:
    """Left-out AUROC of the inputs, of the number of the row alone, and of targets dealt out by hash: what carries no signal must stay near one half."""
    e, branches = _branches(t)
    e = e.withColumns({"dealt": F.pmod(F.xxhash64(F.lit("control"), "vec_id"), F.lit(3)) == 0, "number": F.col("vec_id").cast("double") / 1e6})
    real = fit.left_out(e, {"inputs": (branches["both"], 1.0), "row_number": ([F.col("number")], 1.0)}, F.col("y"), "fold", 3)
    dealt = fit.left_out(e, {"dealt_targets": (branches["both"], 1.0)}, F.col("dealt"), "fold", 3)
    rows = fit.branch_reliability(real, ["inputs", "row_number"], F.col("y")).unionByName(fit.branch_reliability(dealt, ["dealt_targets"], F.col("dealt")))
    return rows.select(F.col("branch").alias("control"), F.round("auroc", 6).alias("auroc"))


_BLEND = "(1 - a) * CASE truth WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END + a * CASE truth WHEN 1 THEN p2 WHEN 2 THEN p3 ELSE p1 END"


@add(
    "e27_nested_selection",
    f"""WITH p AS (SELECT *, vec_id % 4 AS fold FROM {PRED_SQL}), g AS (SELECT unnest([0.0, 0.1, 0.25, 0.5]) AS a), o AS (SELECT unnest(range(4)) AS held),
l AS (SELECT held, a, avg(-ln({_BLEND})) AS loss FROM p JOIN o ON p.fold <> o.held CROSS JOIN g GROUP BY ALL), b AS (SELECT held, arg_min(a, (loss, a)) AS a FROM l GROUP BY 1),
x AS (SELECT b.held, b.a, truth, predicted, -ln({_BLEND}) AS loss, CASE WHEN (1 - a) * p1 + a * p2 >= (1 - a) * p2 + a * p3 AND (1 - a) * p1 + a * p2 >= (1 - a) * p3 + a * p1 THEN 1 WHEN (1 - a) * p2 + a * p3 >= (1 - a) * p3 + a * p1 THEN 2 ELSE 3 END AS said FROM p JOIN b ON p.fold = b.held)
SELECT held AS fold, a AS strength, count(*) AS n, round(avg(CAST(predicted = truth AS INT)), 9) AS accuracy_before, round(avg(CAST(said = truth AS INT)), 9) AS accuracy, round(avg(loss), 9) AS loss FROM x GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    """A blend's strength chosen on all folds but one and judged on that one: every outer fold and strength in one pass."""
    strengths = (0.0, 0.1, 0.25, 0.5)
    turned = F.array(*[F.element_at("probs", i) for i in (2, 3, 1)])
    p = predictions(t).withColumns({"fold": F.col("vec_id") % 4, "turned": turned})
    blended = lambda a: F.zip_with("probs", "turned", lambda x, y: (1 - a) * x + a * y)
    each = F.array(*[F.struct(F.lit(a).alias("a"), V.log_loss(blended(F.lit(a)), F.col("truth")).alias("loss")) for a in strengths])
    outer = F.explode(F.filter(F.array(*[F.lit(k).cast("long") for k in range(4)]), lambda k: k != F.col("fold")))
    l = p.select("fold", each.alias("e"), outer.alias("held")).select("held", F.explode("e").alias("e")).groupBy("held", "e.a").agg(F.avg("e.loss").alias("loss"))
    best = l.groupBy("held").agg(F.min_by("a", F.struct("loss", "a")).alias("strength"))
    x = p.join(F.broadcast(best), F.col("fold") == F.col("held")).withColumn("final", blended(F.col("strength")))
    hit = lambda c: r(F.avg((c == F.col("truth")).cast("int")))
    return x.groupBy("fold", "strength").agg(F.count("*").alias("n"), hit(F.col("predicted")).alias("accuracy_before"), hit(V.argmax(F.col("final"))).alias("accuracy"), r(F.avg(V.log_loss(F.col("final"), F.col("truth")))).alias("loss"))


@add(
    "e43_gate_against_published",
    f"""WITH m AS (SELECT avg(CAST(truth = predicted AS INT)) AS accuracy, avg(-ln(CASE truth WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END)) AS log_loss FROM {PRED_SQL}),
b AS (SELECT * FROM (VALUES ('accuracy', 0.5, true), ('log_loss', 1.0, false)) x(measure, published, higher)), v AS (SELECT 'accuracy' AS measure, accuracy AS value FROM m UNION ALL SELECT 'log_loss', log_loss FROM m)
SELECT measure, round(value, 9) AS value, published, round(value - published, 9) AS difference, CASE WHEN higher THEN value >= published ELSE value <= published END AS passed FROM v JOIN b USING (measure)""",
)
def _(t: Tables) -> DataFrame:
    """Measures beside stated figures, and whether each reaches its own."""
    published = {"accuracy": (0.5, True), "log_loss": (1.0, False)}
    m = E.summary(predictions(t), [], 3)
    rows = F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).cast("double").alias("value"), F.lit(p).alias("published"), F.lit(up).alias("up")) for k, (p, up) in published.items()])
    x = m.select(F.explode(rows).alias("x")).select("x.*")
    passed = F.when(F.col("up"), F.col("value") >= F.col("published")).otherwise(F.col("value") <= F.col("published"))
    return x.select("measure", r(F.col("value")).alias("value"), "published", r(F.col("value") - F.col("published")).alias("difference"), passed.alias("passed"))


@add("e45_task_conditioned", None)
def _(t: Tables) -> DataFrame:
    """Left-out AUROC of one model for all tasks, of one with a shift for each task, and of one whose weights differ by task too."""
    e, branches = _branches(t)
    e = e.withColumn("task", F.col("vec_id") % 3)
    shared = branches["first"]
    is_task = [(F.col("task") == k).cast("double") for k in (1, 2)]
    fits = {"shared": (shared, 1.0), "shifted": ([*shared, *is_task], 1.0), "conditioned": ([*shared, *is_task, *[x * i for x in shared for i in is_task]], 1.0)}
    return fit.branch_reliability(fit.left_out(e, fits, F.col("y"), "fold", 3), list(fits), F.col("y")).select(F.col("branch").alias("model"), F.round("auroc", 6).alias("auroc"), F.round("reliability", 6).alias("reliability"))


@add("e46_arbitrator", None)
def _(t: Tables) -> DataFrame:
    """Which of two predictions to take, by a ridge of the second's gain on margins and entropies, fitted without each row's fold; it qualifies if the gain's lower bound is above 0."""
    p = _pair(t).withColumn("fold", (F.col("vec_id") % 3).cast("int"))
    hit = lambda c: (F.col(c) == F.col("truth")).cast("double")
    p = p.select("fold", hit("predicted").alias("base"), hit("other").alias("second"), V.margin(F.col("probs")).alias("margin"), V.entropy(F.col("probs")).alias("doubt"), (F.col("predicted") == F.col("other")).cast("double").alias("agree")).withColumn("gain", F.col("second") - F.col("base"))
    inputs = ["margin", "doubt", "agree"]
    said = F.lit(None).cast("double")
    for k in range(3):
        b, w = fit.ridge(p.where(F.col("fold") != k), inputs, ["gain"])["gain"]
        said = F.when(F.col("fold") == k, sum((F.lit(x) * F.col(c) for x, c in zip(w, inputs, strict=True)), F.lit(b))).otherwise(said)
    x = p.withColumn("take", said > 0).withColumn("final", F.when(F.col("take"), F.col("second")).otherwise(F.col("base")))
    d = F.col("final") - F.col("base")
    lower = F.avg(d) - 1.96 * F.stddev_samp(d) / F.sqrt(F.count("*").cast("double"))
    return x.agg(F.count("*").alias("n"), F.round(F.avg(F.col("take").cast("int")), 6).alias("taken"), F.round(F.avg("base"), 6).alias("accuracy_before"), F.round(F.avg("final"), 6).alias("accuracy"), (lower > 0).alias("qualified"))
