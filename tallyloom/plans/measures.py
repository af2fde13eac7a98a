"""Error measures, coverage, weights and text measures in full."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import parse
from tallyloom.functions import text as T
from tallyloom.functions import vectors as V
from tallyloom.operators import evaluate as E
from tallyloom.operators import research as S
from tallyloom.plans.catalog import Catalog, Tables, r
from tallyloom.plans.relational import EV_SQL, ev
from tallyloom.plans.texts import TOKENS_SQL, tokens
from tallyloom.plans.vectors import PRED_SQL, predictions

catalog = Catalog()
add = catalog.add
QUERIES, ORACLES = catalog.queries, catalog.oracles

_MARGIN = "greatest(p1, p2, p3) - (p1 + p2 + p3 - greatest(p1, p2, p3) - least(p1, p2, p3))"


@add(
    "e08_error_rates",
    f"""WITH p AS (SELECT *, {_MARGIN} AS m FROM {PRED_SQL}),
c AS (SELECT k, count(*) FILTER (truth = k) AS pos, count(*) FILTER (truth <> k) AS neg, count(*) FILTER (truth = k AND predicted <> k) AS fn, count(*) FILTER (truth <> k AND predicted = k) AS fp FROM p CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) GROUP BY 1)
SELECT round(avg(CAST(truth <> predicted AS INT)), 9) AS error, round(avg(CAST(m <= 0.10 AS INT)), 9) AS near_threshold, round(avg(CAST(truth <> predicted AND greatest(p1, p2, p3) >= 0.8 AS INT)), 9) AS high_confidence_error,
(SELECT round(avg(fn / pos), 9) FROM c) AS macro_fnr, (SELECT round(avg(fp / neg), 9) FROM c) AS macro_fpr FROM p""",
)
def _(t: Tables) -> DataFrame:
    wrong, p = F.col("truth") != F.col("predicted"), F.col("probs")
    classes = (1, 2, 3)
    fnr = sum((F.count_if((F.col("truth") == k) & wrong) / F.count_if(F.col("truth") == k) for k in classes), F.lit(0.0)) / len(classes)
    fpr = sum((F.count_if((F.col("predicted") == k) & wrong) / F.count_if(F.col("truth") != k) for k in classes), F.lit(0.0)) / len(classes)
    rate = lambda c: r(F.avg(c.cast("int")))
    return predictions(t).agg(rate(wrong).alias("error"), rate(V.margin(p) <= 0.10).alias("near_threshold"), rate(wrong & (F.array_max(p) >= 0.8)).alias("high_confidence_error"), r(fnr).alias("macro_fnr"), r(fpr).alias("macro_fpr"))


@add(
    "e11_referral",
    f"""WITH s AS (SELECT 1 - p1 AS s, truth > 1 AS pos FROM {PRED_SQL}), k AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM s),
v AS (SELECT s, count(*) FILTER (pos) AS p, count(*) AS c FROM s GROUP BY 1), w AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(c) OVER (ORDER BY s DESC) AS a FROM v)
SELECT count(*) FILTER (pos) AS referred, count(*) FILTER (pos AND s >= 0.5) AS found, round(avg((s - CAST(pos AS INT)) ** 2), 9) AS brier,
round((sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 9) AS auroc, (SELECT round(sum(p * tp / a) / sum(p), 9) FROM w) AS average_precision,
round(count(*) FILTER (pos AND s >= 0.5) / count(*) FILTER (pos), 9) AS sensitivity, round(count(*) FILTER (NOT pos AND s < 0.5) / count(*) FILTER (NOT pos), 9) AS specificity FROM k""",
)
def _(t: Tables) -> DataFrame:
    """Three classes as one question, refer or not: the measures of the collapsed score."""
    s = predictions(t).select((1 - F.element_at("probs", 1)).alias("s"), (F.col("truth") > 1).alias("pos"))
    one = s.agg(F.count_if("pos").alias("referred"), F.count_if(F.col("pos") & (F.col("s") >= 0.5)).alias("found"), r(F.avg(F.pow(F.col("s") - F.col("pos").cast("int"), 2))).alias("brier"))
    # Each part is one row.
    parts = [E.auroc(s, [], "s", "pos"), E.average_precision(s, [], "s", "pos"), E.operating_point(s, [], "s", "pos", 0.5).select("sensitivity", "specificity")]
    for part in parts:
        one = one.join(F.broadcast(part.select(*[r(F.col(c)).alias(c) for c in part.columns])))
    return one


@add(
    "e40_with_abstention",
    f"""WITH d AS (SELECT truth, CASE WHEN greatest(p1, p2, p3) >= 0.5 THEN predicted END AS said FROM {PRED_SQL})
SELECT truth, count(*) AS n, {", ".join(f"count(*) FILTER (said = {k}) AS said_{k}" for k in (1, 2, 3))}, count(*) FILTER (said IS NULL) AS abstained, round(count(said) / count(*), 9) AS coverage,
round(count(*) FILTER (said = truth) / nullif(count(said), 0), 9) AS conditional_accuracy, round(count(*) FILTER (said = truth) / count(*), 9) AS accuracy FROM d GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    """A confusion with a column for no decision, and accuracy with and without it."""
    said = F.when(F.array_max("probs") >= 0.5, F.col("predicted"))
    d = predictions(t).select("truth", said.alias("said"))
    right, decided, n = F.count_if(F.col("said") == F.col("truth")), F.count("said"), F.count("*")
    return d.groupBy("truth").agg(
        n.alias("n"), *[F.count_if(F.col("said") == k).alias(f"said_{k}") for k in (1, 2, 3)], F.count_if(F.col("said").isNull()).alias("abstained"), r(decided / n).alias("coverage"),
        r(E.ratio(right, decided)).alias("conditional_accuracy"), r(right / n).alias("accuracy"),
    )


@add("a37_coverage", "SELECT metric_instance_id, split, n, valued, distinct_values, round(valued / n, 9) AS coverage, CASE WHEN valued = 0 THEN 'absent' WHEN valued < 8 THEN 'sparse' WHEN distinct_values = 1 THEN 'constant' WHEN valued / n < 0.5 THEN 'patchy' ELSE 'usable' END AS status FROM (SELECT metric_instance_id, split, count(*) AS n, count(*) FILTER (isfinite(value)) AS valued, count(DISTINCT CASE WHEN isfinite(value) THEN value END) AS distinct_values FROM metric_evidence GROUP BY ALL)")
def _(t: Tables) -> DataFrame:
    x = parse.finite(F.col("value"))
    g = t.metric_evidence.groupBy("metric_instance_id", "split").agg(F.count("*").alias("n"), F.count(x).alias("valued"), F.count_distinct(x).alias("distinct_values"))
    share = F.col("valued") / F.col("n")
    status = F.when(F.col("valued") == 0, "absent").when(F.col("valued") < 8, "sparse").when(F.col("distinct_values") == 1, "constant").when(share < 0.5, "patchy").otherwise("usable")
    return g.withColumns({"coverage": r(share), "status": status})


@add(
    "a43_subgroups",
    f"""WITH p AS (SELECT vec_id % 6 AS subgroup, truth, predicted FROM {PRED_SQL}), n AS (SELECT subgroup, count(*) AS n, avg(CAST(truth = predicted AS INT)) AS a FROM p GROUP BY 1 HAVING count(*) >= 5),
c AS (SELECT subgroup, k, count(*) FILTER (truth = k) AS pos, count(*) FILTER (predicted = k) AS said, count(*) FILTER (truth = k AND predicted = k) AS tp FROM p CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) GROUP BY ALL)
SELECT subgroup, n.n, round(any_value(n.a), 9) AS accuracy, round(avg(coalesce(2 * tp / nullif(pos + said, 0), 0)), 9) AS macro_f1, round(avg(tp / nullif(pos, 0)), 9) AS balanced_accuracy FROM c JOIN n USING (subgroup) GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    """The measures of every subgroup of at least five."""
    s = E.summary(predictions(t).withColumn("subgroup", F.col("vec_id") % 6), ["subgroup"], 3)
    return s.where("n >= 5").select("subgroup", "n", *[r(F.col(c)).alias(c) for c in ("accuracy", "macro_f1", "balanced_accuracy")])


@add("a42_helped_hurt", f"SELECT truth, count(*) FILTER (predicted <> truth AND b = truth) AS helped, count(*) FILTER (predicted = truth AND b <> truth) AS hurt, count(*) FILTER (predicted <> b) AS changed, count(*) AS n FROM (SELECT *, CASE WHEN p2 >= p3 AND p2 >= p1 THEN 1 WHEN p3 >= p1 THEN 2 ELSE 3 END AS b FROM {PRED_SQL}) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """What a second opinion mends, spoils and changes, by true class."""
    other = V.argmax(F.array(*[F.element_at("probs", i) for i in (2, 3, 1)]))
    p = predictions(t).withColumn("b", other)
    was, now = F.col("predicted") == F.col("truth"), F.col("b") == F.col("truth")
    return p.groupBy("truth").agg(F.count_if(~was & now).alias("helped"), F.count_if(was & ~now).alias("hurt"), F.count_if(F.col("predicted") != F.col("b")).alias("changed"), F.count("*").alias("n"))


@add(
    "a32_structured_coverage",
    """WITH o AS (SELECT record_id, unnest(state_observations) AS s FROM synthetic_workspace), x AS (SELECT DISTINCT record_id, s.state_id AS state_id, s.task_scope AS task_scope FROM o WHERE s IS NOT NULL),
g AS (SELECT DISTINCT state_id, branch FROM metric_registry), n AS (SELECT count(DISTINCT state_id) AS states, count(DISTINCT branch) AS branches FROM g),
b AS (SELECT x.record_id, count(DISTINCT g.state_id) AS s, count(DISTINCT g.branch) AS b FROM x JOIN g USING (state_id) GROUP BY 1),
w AS (SELECT record_id, unnest(case_context.task_scopes) AS task_scope FROM synthetic_workspace), k AS (SELECT record_id, count(DISTINCT w.task_scope) AS wanted, count(DISTINCT x.task_scope) AS seen FROM w LEFT JOIN x USING (record_id, task_scope) WHERE w.task_scope IS NOT NULL GROUP BY 1)
SELECT m.record_id, round(coalesce(b.s, 0) / n.states, 9) AS state, round(CASE WHEN k.wanted > 0 THEN k.seen / k.wanted ELSE coalesce(b.s, 0) / n.states END, 9) AS task, round(coalesce(b.b, 0) / n.branches, 9) AS branch,
round(0.6 * coalesce(b.s, 0) / n.states + 0.25 * CASE WHEN k.wanted > 0 THEN k.seen / k.wanted ELSE coalesce(b.s, 0) / n.states END + 0.15 * coalesce(b.b, 0) / n.branches, 9) AS coverage
FROM synthetic_workspace m CROSS JOIN n LEFT JOIN b USING (record_id) LEFT JOIN k USING (record_id)""",
)
def _(t: Tables) -> DataFrame:
    """How much of the registry's states and branches, and of the case's own tasks, a record's observations cover."""
    w = t.synthetic_workspace.select("record_id", "case_context", "state_observations")
    x = w.select("record_id", F.explode("state_observations").alias("s")).where(F.col("s").isNotNull()).select("record_id", "s.state_id", "s.task_scope").distinct()
    g = t.metric_registry.select("state_id", "branch").distinct()
    n = g.agg(F.count_distinct("state_id").alias("states"), F.count_distinct("branch").alias("branches"))
    b = x.join(g, "state_id").groupBy("record_id").agg(F.count_distinct("state_id").alias("s"), F.count_distinct("branch").alias("b"))
    seen = x.groupBy("record_id").agg(F.collect_set("task_scope").alias("scopes"))
    wanted = F.array_distinct(F.filter("case_context.task_scopes", lambda c: c.isNotNull()))
    y = w.select("record_id", wanted.alias("wanted")).join(F.broadcast(n)).join(b, "record_id", "left").join(seen, "record_id", "left")
    state, branch = F.coalesce("s", F.lit(0)) / F.col("states"), F.coalesce("b", F.lit(0)) / F.col("branches")
    found = F.size(F.array_intersect("wanted", F.coalesce("scopes", F.array().cast("array<string>"))))
    task = F.when(F.size("wanted") > 0, found / F.size("wanted")).otherwise(state)
    return y.select("record_id", r(state).alias("state"), r(task).alias("task"), r(branch).alias("branch"), r(0.6 * state + 0.25 * task + 0.15 * branch).alias("coverage"))


@add("a29_masked_prototypes", f"SELECT metric_instance_id, label, round(median(value), 9) AS center, round(greatest((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349, 0.75), 9) AS spread, count(*) AS support FROM {EV_SQL} WHERE reliability > 0 AND NOT coalesce(missing, true) AND label IS NOT NULL GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    """Centre and spread of each class over what can be relied on, the spread no less than 0.75, with its support."""
    e = ev(t).where("reliability > 0 AND NOT coalesce(missing, true) AND label IS NOT NULL")
    spread = F.greatest((F.percentile("value", 0.75) - F.percentile("value", 0.25)) / 1.349, F.lit(0.75))
    return e.groupBy("metric_instance_id", "label").agg(r(F.median("value")).alias("center"), r(spread).alias("spread"), F.count("*").alias("support"))


@add(
    "a30_hierarchical_weights",
    f"""WITH w AS (SELECT state_id, task_scope, avg(reliability) AS w FROM {EV_SQL} WHERE reliability > 0 AND state_id IS NOT NULL AND task_scope IS NOT NULL GROUP BY ALL), b AS (SELECT *, max(w) OVER (PARTITION BY state_id) AS base, w / sum(w) OVER (PARTITION BY state_id) AS share FROM w)
SELECT state_id, task_scope, round(base, 9) AS base, round(share, 9) AS share, round(base * share, 9) AS weight FROM b""",
)
def _(t: Tables) -> DataFrame:
    """A state weighs as much as its most reliable view, and its views share that."""
    w = ev(t).where("reliability > 0 AND state_id IS NOT NULL AND task_scope IS NOT NULL").groupBy("state_id", "task_scope").agg(F.avg("reliability").alias("w"))
    per = w.groupBy("state_id").agg(F.max("w").alias("base"), F.sum("w").alias("_s"))
    share = F.col("w") / F.col("_s")
    return w.join(per, "state_id").select("state_id", "task_scope", r(F.col("base")).alias("base"), r(share).alias("share"), r(F.col("base") * share).alias("weight"))


_DATASETS = ("HARBOR_PIC", "LANTERN_INT", "ORCHARD_TASK", "TIDE_MULTI", "MEADOW_PROG", "QUARRY_PUB")


@add("a39_incidence", "SELECT metric_instance_id, " + ", ".join(f"bool_or(dataset_id = '{d}') AS {d.lower()}" for d in _DATASETS) + f" FROM {EV_SQL} WHERE dataset_id IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Which metric has a value in which dataset."""
    return ev(t).where(F.col("dataset_id").isNotNull()).groupBy("metric_instance_id").agg(*[F.bool_or(F.col("dataset_id") == d).alias(d.lower()) for d in _DATASETS])


@add("a39_subject_likeness", f"WITH u AS (SELECT DISTINCT state_id AS g, subject_id AS i FROM {EV_SQL} WHERE state_id IS NOT NULL), s AS (SELECT g, count(*) AS n FROM u GROUP BY 1) SELECT x.g AS a, y.g AS b, count(*) AS shared, round(count(*) / (any_value(sx.n) + any_value(sy.n) - count(*)), 9) AS jaccard FROM u x JOIN u y ON x.i = y.i AND x.g < y.g JOIN s sx ON sx.g = x.g JOIN s sy ON sy.g = y.g GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    """How alike two states are in the subjects that have them."""
    return S.jaccard(ev(t).where(F.col("state_id").isNotNull()), "state_id", "subject_id").select("a", "b", "shared", r(F.col("jaccard")).alias("jaccard"))


@add("m02_reliability_product", "SELECT branch, count(*) AS n, round(avg(x), 9) AS reliability FROM (SELECT branch, CASE WHEN NOT reference_available THEN 0.0 ELSE 0.9 * CASE WHEN branch = 'interaction' THEN least(source_reliability, 0.55) ELSE source_reliability END * CASE WHEN starts_with(metric_instance_id, 'f0') OR contains(metric_instance_id, '__f0') THEN greatest(0.0, least(1.0, source_reliability / 0.45)) ELSE 1.0 END END AS x FROM metric_evidence) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Source reliability, capped where turns are mixed, times what a pitch can be trusted for where little is voiced."""
    s = F.col("source_reliability")
    base = F.when(F.col("branch") == "interaction", F.least(s, F.lit(0.55))).otherwise(s)
    pitch = F.when(F.col("metric_instance_id").startswith("f0") | F.col("metric_instance_id").contains("__f0"), parse.clip(s / 0.45, 0.0, 1.0)).otherwise(1.0)
    x = F.when(~F.col("reference_available"), 0.0).otherwise(0.9 * base * pitch)
    return t.metric_evidence.groupBy("branch").agg(F.count("*").alias("n"), r(F.avg(x)).alias("reliability"))


@add("t10_tier_counts", "SELECT case_id, par, inv, CASE WHEN par + inv > 0 THEN round(par / (par + inv), 9) END AS participant_share FROM (SELECT case_id, len(regexp_extract_all(lower(transcript), '\\*par:')) AS par, len(regexp_extract_all(lower(transcript), '\\*inv:')) AS inv FROM prepared_authority_study_case WHERE transcript IS NOT NULL)")
def _(t: Tables) -> DataFrame:
    n = lambda x: F.regexp_count(F.lower("transcript"), F.lit(x)).cast("long")
    p = t.prepared_authority_study_case.where(F.col("transcript").isNotNull()).select("case_id", n(r"\*par:").alias("par"), n(r"\*inv:").alias("inv"))
    both = F.col("par") + F.col("inv")
    return p.withColumn("participant_share", F.when(both > 0, r(F.col("par") / both)))


#: Content units of the picture by language, and words that say one is not sure. Fixed values.
UNITS = {"kite": ("kite", "cometa", "drachen", "cerf-volant", "风筝"), "boat": ("boat", "barca", "boot", "bateau", "船"), "bucket": ("bucket", "cubo", "eimer", "seau", "桶"), "bread": ("bread", "pan caliente", "brot", "pain", "面包"), "keys": ("keys", "llaves", "schlüssel", "clés", "钥匙")}
UNSURE = ("maybe", "perhaps", "quizá", "tal vez", "vielleicht", "peut-être", "也许", "可能")


def _times(x: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"(length({x}) - length(replace({x}, '{w}', ''))) // {len(w)}" for w in words) + ")"


@add(
    "t11_content_units",
    f"""WITH c AS (SELECT doc_id, lower(text) AS x, len({TOKENS_SQL}) AS n FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, n, {", ".join(f"{_times('x', w)} AS {k}" for k, w in UNITS.items())}, {_times("x", UNSURE)} AS unsure FROM c),
s AS (SELECT *, {" + ".join(f"CAST({k} > 0 AS INT)" for k in UNITS)} AS units, {" + ".join(UNITS)} AS mentions FROM m)
SELECT doc_id, units, mentions, round(units / {len(UNITS)}, 9) AS coverage, CASE WHEN n > 0 THEN round(mentions / n, 9) END AS density, CASE WHEN mentions > 0 THEN round(1 - units / mentions, 9) END AS redundancy, CASE WHEN n > 0 THEN round(unsure / n, 9) END AS uncertainty FROM s""",
)
def _(t: Tables) -> DataFrame:
    """Units of the picture that a text names in any of five languages, how densely and how often again, and how unsurely."""
    x = F.lower("text")
    count = lambda words: sum((T.occurrences(x, w) for w in words), F.lit(0)).cast("long")
    per = {k: count(w) for k, w in UNITS.items()}
    m = tokens(t).select("doc_id", "text", F.size("tokens").alias("n")).select("doc_id", "n", *[c.alias(k) for k, c in per.items()], count(UNSURE).alias("unsure"))
    units, mentions, n = sum((F.when(F.col(k) > 0, 1).otherwise(0) for k in UNITS), F.lit(0)), sum((F.col(k) for k in UNITS), F.lit(0)), F.col("n")
    s = m.select("doc_id", "n", "unsure", units.cast("long").alias("units"), mentions.cast("long").alias("mentions"))
    return s.select("doc_id", "units", "mentions", r(F.col("units") / len(UNITS)).alias("coverage"), F.when(n > 0, r(F.col("mentions") / n)).alias("density"), F.when(F.col("mentions") > 0, r(1 - F.col("units") / F.col("mentions"))).alias("redundancy"), F.when(n > 0, r(F.col("unsure") / n)).alias("uncertainty"))


_GRAMS = f"""k AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(list_concat(list_transform(w, lambda x: 'w:' || x), list_transform(range(1, len(w)), lambda i: 'w:' || w[i] || ' ' || w[i + 1]),
 flatten(list_transform(w, lambda x: list_transform(range(1, length(x) + 1), lambda i: 'c:' || substr(' ' || x || ' ', CAST(i AS INT), 3)))))) AS g FROM k)"""


@add(
    "t20_document_vectors",
    f"""WITH {_GRAMS}, tf AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL), df AS (SELECT g, count(*) AS d FROM tf GROUP BY 1 HAVING count(*) >= 5), c AS (SELECT count(*) AS docs FROM documents),
w AS (SELECT doc_id, (1 + ln(n)) * (ln((1 + docs) / (1 + d)) + 1) AS w FROM tf JOIN df USING (g) CROSS JOIN c)
SELECT doc_id, count(*) AS terms, round(sqrt(sum(w * w)), 6) AS length, round(max(w) / sqrt(sum(w * w)), 6) AS largest FROM w GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    """The vectors of documents over words, word pairs and parts of words, scaled to length 1: their terms, their length before, and their largest weight."""
    vectors = S.term_vectors(tokens(t).select("doc_id", T.grams(F.col("tokens")).alias("terms")), t.documents, "doc_id", "terms", 5)
    return vectors.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.max("length"), 6).alias("length"), F.round(F.max("weight"), 6).alias("largest"))
