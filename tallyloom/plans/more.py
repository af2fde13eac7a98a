"""Further joins, aggregates, evaluation and audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import parse
from tallyloom.functions import vectors as V
from tallyloom.operators import robust as R
from tallyloom.operators import sequence as Q
from tallyloom.plans.catalog import Catalog, Tables, r
from tallyloom.plans.relational import EV_SQL, ev
from tallyloom.plans.vectors import PRED_SQL, predictions

catalog = Catalog()
add = catalog.add
QUERIES, ORACLES = catalog.queries, catalog.oracles

FORBIDDEN = ("label", "split", "diagnosis_source")


@add("f27_allowed_features", "SELECT case_id, age, duration_sec, sex FROM manifest")
def _(t: Tables) -> DataFrame:
    """Wanted columns without those that would give the answer away."""
    wanted = ["case_id", "age", "duration_sec", "sex", *FORBIDDEN]
    return t.manifest.select([c for c in wanted if c not in FORBIDDEN])


@add("f28_cohort_equality", "SELECT channel, count(DISTINCT subject_id) AS subjects, count(DISTINCT subject_id) = (SELECT count(DISTINCT subject_id) FROM manifest) AS whole FROM manifest GROUP BY 1")
def _(t: Tables) -> DataFrame:
    m = t.manifest.select("channel", "subject_id")
    every = m.agg(F.count_distinct("subject_id").alias("_n"))
    return m.groupBy("channel").agg(F.count_distinct("subject_id").alias("subjects")).join(F.broadcast(every)).select("channel", "subjects", (F.col("subjects") == F.col("_n")).alias("whole"))


@add("j05_segments_of_recordings", "SELECT m.case_id, m.channel, p.asr_model FROM (SELECT DISTINCT case_id, dataset_id AS channel FROM public_cases) m JOIN (SELECT DISTINCT case_id, asr_model FROM prepared_authority_study_case) p USING (case_id)")
def _(t: Tables) -> DataFrame:
    p = t.prepared_authority_study_case.select("case_id", "asr_model").distinct()
    return t.public_cases.select("case_id", F.col("dataset_id").alias("channel")).distinct().join(p, "case_id")


@add("j07_off_and_on", f"SELECT vec_id, predicted AS off, CASE WHEN q3 >= q2 AND q3 >= q1 THEN 3 ELSE 1 END AS \"on\" FROM {PRED_SQL}")
def _(t: Tables) -> DataFrame:
    p = predictions(t)
    return p.select("vec_id", F.col("predicted").alias("off")).join(p.select("vec_id", V.argmax(F.col("prior")).alias("on")), "vec_id")


@add("j09_differing_names", "SELECT l.l_orderkey, l.l_linenumber, p.p_brand FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_size > 40")
def _(t: Tables) -> DataFrame:
    p = t.part.where("p_size > 40").select("p_partkey", "p_brand")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand")


@add("j22_by_row_id", "SELECT e.event_id, e.event_type, k.v FROM events e JOIN (SELECT event_id, value * 2 AS v FROM events) k USING (event_id)")
def _(t: Tables) -> DataFrame:
    """Columns put side by side by an explicit id, never by position."""
    return t.events.select("event_id", "event_type").join(t.events.select("event_id", (F.col("value") * 2).alias("v")), "event_id")


@add("j23_one_pivot", "SELECT o_custkey, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS f_sum, count(*) FILTER (o_orderstatus = 'F') AS f_n, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS o_sum, count(*) FILTER (o_orderstatus = 'O') AS o_n FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Two aggregates of one pivot in one pass."""
    s = F.col("o_orderstatus")
    pick = lambda v: [F.round(F.sum(F.when(s == v, F.col("o_totalprice"))), 2).alias(f"{v.lower()}_sum"), F.count_if(s == v).alias(f"{v.lower()}_n")]
    return t.orders.groupBy("o_custkey").agg(*pick("F"), *pick("O"))


@add("a02_group_size_joined", "SELECT case_id, count(*) OVER (PARTITION BY dataset_id) AS dataset_rows FROM manifest")
def _(t: Tables) -> DataFrame:
    n = t.manifest.groupBy("dataset_id").agg(F.count("*").alias("dataset_rows"))
    return t.manifest.select("case_id", "dataset_id").join(n, "dataset_id").select("case_id", "dataset_rows")


@add("a13_huber_location", None)
def _(t: Tables) -> DataFrame:
    """Robust location of a subject's values of a metric, weighted by reliability."""
    return R.huber_by_group(ev(t), ["subject_id", "metric_instance_id"], "value", "reliability")


@add("a18_pivot_first", "SELECT state_id, max(metric_id) FILTER (evidence_role = 'primary') AS \"primary\", max(metric_id) FILTER (evidence_role = 'secondary') AS secondary FROM metric_registry WHERE evidence_role IN ('primary', 'secondary') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    m = t.metric_registry.where(F.col("evidence_role").isin("primary", "secondary"))
    return m.groupBy("state_id").pivot("evidence_role", ["primary", "secondary"]).agg(F.max("metric_id"))


@add("a20_sizes_unstacked", "SELECT branch, count(*) FILTER (evidence_status = 'available') AS available, count(*) FILTER (evidence_status = 'missing') AS missing, count(*) FILTER (evidence_status = 'unavailable') AS unavailable FROM metric_evidence GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.metric_evidence.groupBy("branch").agg(*[F.count_if(F.col("evidence_status") == s).alias(s) for s in ("available", "missing", "unavailable")])


@add("a33_mode_near_default", "SELECT dataset_id, recording_index FROM (SELECT dataset_id, recording_index, count(*) AS n FROM manifest WHERE recording_index IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY n DESC, abs(recording_index - 2), recording_index) = 1")
def _(t: Tables) -> DataFrame:
    c = t.manifest.where(F.col("recording_index").isNotNull()).groupBy("dataset_id", "recording_index").agg(F.count("*").alias("n"))
    return Q.top_k(c, ["dataset_id"], [F.desc("n"), F.abs(F.col("recording_index") - 2).asc(), F.asc("recording_index")], 1).select("dataset_id", "recording_index")


@add("a36_paired_gain", f"SELECT count(*) AS n, round(avg(g), 9) AS gain, round(avg(g) - 1.96 * stddev_samp(g) / sqrt(count(*)), 9) AS lower95 FROM (SELECT CAST(truth = predicted AS INT) - CAST(truth = 3 AS INT) AS g FROM {PRED_SQL})")
def _(t: Tables) -> DataFrame:
    g = (F.col("truth") == F.col("predicted")).cast("int") - (F.col("truth") == V.argmax(F.col("prior"))).cast("int")
    return predictions(t).select(g.alias("g")).agg(F.count("*").alias("n"), r(F.avg("g")).alias("gain"), r(F.avg("g") - 1.96 * F.stddev_samp("g") / F.sqrt(F.count("*").cast("double"))).alias("lower95"))


@add("a40_reverse_lineage", "SELECT state_id, string_agg(DISTINCT metric_id, ';' ORDER BY metric_id) AS metrics FROM metric_evidence WHERE metric_id IN (SELECT metric_id FROM metric_registry) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    known = t.metric_registry.select("metric_id")
    return t.metric_evidence.select("state_id", "metric_id").join(known, "metric_id", "left_semi").groupBy("state_id").agg(F.array_join(F.array_sort(F.collect_set("metric_id")), ";").alias("metrics"))


@add("a41_state_coverage", "SELECT g.state_id, count(DISTINCT e.metric_instance_id) AS seen, count(DISTINCT g.metric_id) AS defined FROM metric_registry g LEFT JOIN (SELECT DISTINCT metric_instance_id FROM metric_evidence WHERE evidence_status = 'available') e ON e.metric_instance_id = g.metric_id GROUP BY 1")
def _(t: Tables) -> DataFrame:
    seen = t.metric_evidence.where("evidence_status = 'available'").select(F.col("metric_instance_id").alias("metric_id")).distinct().withColumn("_s", F.lit(1))
    return t.metric_registry.join(seen, "metric_id", "left").groupBy("state_id").agg(F.count("_s").alias("seen"), F.count("*").alias("defined"))


@add("a47_quality_prior", "SELECT branch, round(CASE WHEN sum(w) > 0 THEN sum(w * source_reliability) / sum(w) ELSE avg(source_reliability) END, 9) AS reliability FROM (SELECT branch, source_reliability, reliability * exp(2 * (source_reliability - avg(source_reliability) OVER (PARTITION BY branch))) AS w FROM metric_evidence WHERE reliability IS NOT NULL AND source_reliability IS NOT NULL) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    m = t.metric_evidence.where("reliability IS NOT NULL AND source_reliability IS NOT NULL").select("branch", "source_reliability", "reliability")
    mean = m.groupBy("branch").agg(F.avg("source_reliability").alias("_m"))
    w = F.col("reliability") * F.exp(2 * (F.col("source_reliability") - F.col("_m")))
    g = m.join(mean, "branch").groupBy("branch").agg(F.sum(w).alias("w"), F.sum(w * F.col("source_reliability")).alias("s"), F.avg("source_reliability").alias("a"))
    return g.select("branch", r(F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(F.col("a"))).alias("reliability"))


@add("w03_refreshed_top", "SELECT subject_id, metric_instance_id, rank FROM (SELECT subject_id, metric_instance_id, row_number() OVER (PARTITION BY subject_id ORDER BY max(abs(directional_z) * reliability) DESC, metric_instance_id) AS rank FROM " + EV_SQL + " WHERE isfinite(directional_z) AND reliability IS NOT NULL GROUP BY subject_id, metric_instance_id) WHERE rank <= 3")
def _(t: Tables) -> DataFrame:
    z = parse.finite(F.col("directional_z"))
    e = ev(t).where(z.isNotNull() & F.col("reliability").isNotNull()).groupBy("subject_id", "metric_instance_id").agg(F.max(F.abs("directional_z") * F.col("reliability")).alias("s"))
    return Q.top_k(e, ["subject_id"], [F.desc("s"), F.asc("metric_instance_id")], 3).select("subject_id", "metric_instance_id", "rank")


@add("w26_mass_dims", "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), k AS (SELECT *, sum(n) OVER (ORDER BY n DESC, source ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER () AS a FROM c) SELECT count(*) FILTER (run - n < 0.9 * a) AS sources_for_90 FROM k")
def _(t: Tables) -> DataFrame:
    """How many sources, largest first, hold nine tenths of the documents."""
    c = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    k = c.withColumn("run", F.sum("n").over(W.orderBy(F.desc("n"), "source").rowsBetween(W.unboundedPreceding, 0)))
    return k.join(F.broadcast(c.agg(F.sum("n").alias("a")))).agg(F.count_if(F.col("run") - F.col("n") < 0.9 * F.col("a")).alias("sources_for_90"))


@add("o02_total_order", "SELECT case_id, row_number() OVER (PARTITION BY dataset_id ORDER BY age DESC NULLS LAST, recording_index, case_id, audio_path, ingested_at) AS place FROM manifest")
def _(t: Tables) -> DataFrame:
    w = W.partitionBy("dataset_id").orderBy(F.desc_nulls_last("age"), "recording_index", "case_id", "audio_path", "ingested_at")
    return t.manifest.select("case_id", F.row_number().over(w).alias("place"))


@add("o03_kept_order", "SELECT line_no, exporter FROM workspace_lines WHERE payload IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """The order of the lines is a column of theirs, so it comes through a join that moves the rows."""
    lines = t.workspace_lines.where("payload IS NOT NULL")
    return lines.select("line_no", "exporter").join(lines.select("line_no", "received_at"), "line_no").select("line_no", "exporter")


@add("m05_audio_reliability", "SELECT case_id, round(0.25 * least(coalesce(duration_sec, 0) / 30, 1) + 0.25 * least(sample_rate / 16000.0, 1) + 0.25 * CAST(channels = 1 AS INT) + 0.15 * CAST(role_filter_required AS INT) + 0.1, 9) AS reliability FROM manifest")
def _(t: Tables) -> DataFrame:
    one = F.lit(1.0)
    x = 0.25 * F.least(F.coalesce("duration_sec", F.lit(0.0)) / 30, one) + 0.25 * F.least(F.col("sample_rate") / F.lit(16000.0), one) + 0.25 * (F.col("channels") == 1).cast("int") + 0.15 * F.col("role_filter_required").cast("int") + 0.1
    return t.manifest.select("case_id", r(x).alias("reliability"))


@add("m21_huber_distance", f"SELECT subject_id, round(avg(CASE WHEN abs(z) <= 1.5 THEN z * z / 2 ELSE 1.5 * (abs(z) - 0.75) END), 9) AS distance FROM (SELECT subject_id, directional_z AS z FROM {EV_SQL} WHERE isfinite(directional_z)) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    e = ev(t).select("subject_id", parse.finite(F.col("directional_z")).alias("z")).where(F.col("z").isNotNull())
    a = F.abs("z")
    return e.groupBy("subject_id").agg(r(F.avg(F.when(a <= 1.5, F.col("z") * F.col("z") / 2).otherwise(1.5 * (a - 0.75)))).alias("distance"))


@add("m22_update_factor", f"WITH m AS (SELECT subject_id, state_id, min(reliability) AS f, count(*) AS n FROM {EV_SQL} WHERE reliability IS NOT NULL GROUP BY ALL) SELECT subject_id, round(sum(f * n) / sum(n), 9) AS factor FROM m GROUP BY 1")
def _(t: Tables) -> DataFrame:
    m = ev(t).where(F.col("reliability").isNotNull()).groupBy("subject_id", "state_id").agg(F.min("reliability").alias("f"), F.count("*").alias("n"))
    return m.groupBy("subject_id").agg(r(F.sum(F.col("f") * F.col("n")) / F.sum("n")).alias("factor"))


@add(
    "m24_corrected_logits",
    f"""WITH d AS (SELECT vec_id, p1, p2, p3, q1 - p1 - (1 - p1 - p2 - p3) / 3 AS a, q2 - p2 - (1 - p1 - p2 - p3) / 3 AS b, q3 - p3 - (1 - p1 - p2 - p3) / 3 AS c FROM {PRED_SQL}),
f AS (SELECT *, CASE WHEN greatest(abs(a), abs(b), abs(c)) > 0.2 THEN 0.2 / greatest(abs(a), abs(b), abs(c)) ELSE 1.0 END AS f FROM d),
e AS (SELECT vec_id, p1 * exp(a * f) AS e1, p2 * exp(b * f) AS e2, p3 * exp(c * f) AS e3 FROM f)
SELECT vec_id, round(e1 / (e1 + e2 + e3), 9) AS p1, round(e2 / (e1 + e2 + e3), 9) AS p2, round(e3 / (e1 + e2 + e3), 9) AS p3 FROM e""",
)
def _(t: Tables) -> DataFrame:
    """Probabilities after a bounded zero-sum correction of their logits toward the prior."""
    delta = V.zero_sum(F.zip_with("prior", "probs", lambda a, b: a - b), 0.2)
    p = V.softmax(F.zip_with(V.logs(F.col("probs")), delta, lambda a, b: a + b))
    return predictions(t).select("vec_id", *[r(F.element_at(p, i)).alias(f"p{i}") for i in (1, 2, 3)])


@add("n07_forbidden_fields", r"""SELECT line_no, coalesce(regexp_matches(payload, '\\?"(reviewer|diagnosis|subject_name)\\?"\s*:'), false) AS forbidden FROM workspace_lines""")
def _(t: Tables) -> DataFrame:
    """Whether a payload names a field that must not leave the house, at any depth."""
    return t.workspace_lines.select("line_no", F.coalesce(F.col("payload").rlike(r'\\?"(reviewer|diagnosis|subject_name)\\?"\s*:'), F.lit(False)).alias("forbidden"))


@add("e06_losses", f"SELECT truth, round(avg((p1 - CAST(truth = 1 AS INT)) ** 2 + (p2 - CAST(truth = 2 AS INT)) ** 2 + (p3 - CAST(truth = 3 AS INT)) ** 2), 9) AS brier, round(avg(-ln(CASE truth WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END)), 9) AS log_loss FROM {PRED_SQL} GROUP BY 1")
def _(t: Tables) -> DataFrame:
    p = F.col("probs")
    return predictions(t).groupBy("truth").agg(r(F.avg(V.brier(p, F.col("truth")))).alias("brier"), r(F.avg(V.log_loss(p, F.col("truth")))).alias("log_loss"))


@add("e38_intervention", f"WITH s AS (SELECT subject_id, state_id, avg(directional_z) AS z FROM {EV_SQL} WHERE isfinite(directional_z) GROUP BY ALL), m AS (SELECT state_id, median(z) AS m FROM s GROUP BY 1), x AS (SELECT subject_id, avg(s.z) AS before, avg(CASE WHEN k = 1 THEN m.m ELSE s.z END) AS after FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY abs(z) DESC, state_id) AS k FROM s) s JOIN m USING (state_id) GROUP BY 1) SELECT subject_id, round(before, 9) AS before, round(after, 9) AS after FROM x")
def _(t: Tables) -> DataFrame:
    """Each subject's mean state score, and the same with its most extreme state put to the cohort's median."""
    z = parse.finite(F.col("directional_z"))
    s = ev(t).where(z.isNotNull()).groupBy("subject_id", "state_id").agg(F.avg("directional_z").alias("z"))
    m = s.groupBy("state_id").agg(F.median("z").alias("m"))
    top = F.row_number().over(W.partitionBy("subject_id").orderBy(F.abs("z").desc(), "state_id")) == 1
    x = s.withColumn("top", top).join(m, "state_id").groupBy("subject_id").agg(F.avg("z").alias("before"), F.avg(F.when(F.col("top"), F.col("m")).otherwise(F.col("z"))).alias("after"))
    return x.select("subject_id", r(F.col("before")).alias("before"), r(F.col("after")).alias("after"))


@add("e41_insufficient_classes", "SELECT dataset_id, count(DISTINCT label) AS classes, CASE WHEN count(DISTINCT label) < 2 THEN 'insufficient_classes' ELSE 'ok' END AS status FROM manifest GROUP BY 1")
def _(t: Tables) -> DataFrame:
    n = F.count_distinct("label")
    return t.manifest.groupBy("dataset_id").agg(n.alias("classes"), F.when(n < 2, "insufficient_classes").otherwise("ok").alias("status"))


@add("e42_repeated_holdout", f"WITH h AS (SELECT rep, CAST(truth = predicted AS INT) AS hit FROM {PRED_SQL} CROSS JOIN (SELECT unnest(range(5)) AS rep) WHERE (vec_id * 7 + rep * 13) % 3 = 0), a AS (SELECT rep, avg(hit) AS a FROM h GROUP BY 1) SELECT count(*) AS repeats, round(avg(a), 9) AS mean, round(stddev_samp(a), 9) AS sd FROM a")
def _(t: Tables) -> DataFrame:
    p = predictions(t).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(4)))).where((F.col("vec_id") * 7 + F.col("rep") * 13) % 3 == 0)
    a = p.groupBy("rep").agg(F.avg((F.col("truth") == F.col("predicted")).cast("int")).alias("a"))
    return a.agg(F.count("*").alias("repeats"), r(F.avg("a")).alias("mean"), r(F.stddev_samp("a")).alias("sd"))


@add("e44_learning_curve", f"SELECT share, count(*) AS n, round(avg(CAST(truth = predicted AS INT)), 9) AS accuracy FROM {PRED_SQL} CROSS JOIN (SELECT unnest([2, 5, 10]) AS share) WHERE vec_id % 10 < share GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Accuracy on growing nested shares of the rows, all in one pass."""
    p = predictions(t).withColumn("share", F.explode(F.array(F.lit(2), F.lit(5), F.lit(10)))).where(F.col("vec_id") % 10 < F.col("share"))
    return p.groupBy("share").agg(F.count("*").alias("n"), r(F.avg((F.col("truth") == F.col("predicted")).cast("int"))).alias("accuracy"))


@add("g02_completeness_by_split", "SELECT split, round(avg(CAST(value IS NOT NULL AND isfinite(value) AS INT)), 9) AS values_present, round(avg(CAST(reference_available AS INT)), 9) AS references_present FROM metric_evidence GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.metric_evidence.groupBy("split").agg(r(F.avg(parse.finite(F.col("value")).isNotNull().cast("int"))).alias("values_present"), r(F.avg(F.col("reference_available").cast("int"))).alias("references_present"))


@add("g04_shares_sum", "SELECT count(*) AS n, count(*) FILTER (list_min(map_values(base_probabilities)) >= 0 AND abs(list_sum(map_values(base_probabilities)) - 1) <= 0.0015) AS valid FROM synthetic_workspace WHERE base_probabilities IS NOT NULL AND cardinality(base_probabilities) > 0")
def _(t: Tables) -> DataFrame:
    w = t.synthetic_workspace.where(F.size("base_probabilities") > 0)
    v = F.map_values("base_probabilities")
    return w.agg(F.count("*").alias("n"), F.count_if((F.array_min(v) >= 0) & (F.abs(V.total(v) - 1) <= 0.0015)).alias("valid"))


@add("g06_quality_separation", "SELECT g.evidence_role, count(*) AS n FROM (SELECT unnest(s.counter_evidence) AS m FROM (SELECT unnest(state_observations) AS s FROM synthetic_workspace)) x JOIN metric_registry g ON g.metric_id = x.m.metric_id GROUP BY 1")
def _(t: Tables) -> DataFrame:
    m = t.synthetic_workspace.select(F.explode("state_observations").alias("s")).select(F.explode("s.counter_evidence").alias("m")).select(F.col("m.metric_id").alias("metric_id"))
    return m.join(t.metric_registry.select("metric_id", "evidence_role"), "metric_id").groupBy("evidence_role").agg(F.count("*").alias("n"))


@add("g10_coverage_counts", "SELECT count(*) AS records, count(*) FILTER (case_transcript IS NOT NULL) AS with_transcript, count(*) FILTER (len(state_observations) > 0) AS with_observations, count(*) FILTER (base_probabilities IS NOT NULL) AS with_probabilities FROM synthetic_workspace")
def _(t: Tables) -> DataFrame:
    return t.synthetic_workspace.agg(F.count("*").alias("records"), F.count_if(F.col("case_transcript").isNotNull()).alias("with_transcript"), F.count_if(F.size("state_observations") > 0).alias("with_observations"), F.count_if(F.col("base_probabilities").isNotNull()).alias("with_probabilities"))


@add("g24_blind_projection", "SELECT substr(sha256('blind::' || case_id), 1, 16) AS case_alias, task_type, language, duration_sec FROM manifest")
def _(t: Tables) -> DataFrame:
    """Whitelisted columns only, with cases under aliases that do not lead back."""
    from tallyloom.functions.text import pseudonym

    return t.manifest.select(pseudonym(F.col("case_id"), "blind", 16).alias("case_alias"), "task_type", "language", "duration_sec")
