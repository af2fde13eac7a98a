"""Projections, filters, constraints, joins, aggregations, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import parse
from tallyloom.operators import constraints as C
from tallyloom.operators import sequence as Q
from tallyloom.plans.catalog import Catalog, Tables, r

catalog = Catalog()
add = catalog.add
QUERIES, ORACLES = catalog.queries, catalog.oracles

#: Finite values of known subjects, as most queries here read them.
EV_SQL = "(SELECT * FROM metric_evidence WHERE subject_id IS NOT NULL AND trim(subject_id) <> '' AND isfinite(value))"


def ev(t: Tables) -> DataFrame:
    return t.metric_evidence.where((F.trim("subject_id") != "") & parse.finite(F.col("value")).isNotNull())


# --- filters and projections -------------------------------------------------


@add("f01_equality_filter", "SELECT case_id, subject_id, label FROM manifest WHERE split = 'train' AND label = 'HC'")
def _(t: Tables) -> DataFrame:
    return t.manifest.where((F.col("split") == "train") & (F.col("label") == "HC")).select("case_id", "subject_id", "label")


@add("f02_in_filter", "SELECT case_id, task_type FROM manifest WHERE task_type IN ('clinical_interview', 'story_recall')")
def _(t: Tables) -> DataFrame:
    return t.manifest.where(F.col("task_type").isin("clinical_interview", "story_recall")).select("case_id", "task_type")


@add("f03_not_in_filter", "SELECT c.case_id, c.language FROM public_cases c WHERE NOT EXISTS (SELECT 1 FROM prepared_authority_study_case p WHERE p.case_id = c.case_id)")
def _(t: Tables) -> DataFrame:
    return t.public_cases.join(t.prepared_authority_study_case.select("case_id"), "case_id", "left_anti").select("case_id", "language")


@add("f04_between", "SELECT case_id, age FROM manifest WHERE age BETWEEN 60 AND 75")
def _(t: Tables) -> DataFrame:
    return t.manifest.where(F.col("age").between(60, 75)).select("case_id", "age")


@add("f05_pattern_filter", "SELECT case_id, audio_path FROM manifest WHERE regexp_matches(audio_path, '^audio/[a-m]') AND contains(transcript_path, '.cha')")
def _(t: Tables) -> DataFrame:
    return t.manifest.where(F.col("audio_path").rlike("^audio/[a-m]") & F.col("transcript_path").contains(".cha")).select("case_id", "audio_path")


@add("f06_columns_by_pattern", "SELECT reference_label, reference_scope, reference_median, reference_scale, reference_available FROM metric_evidence")
def _(t: Tables) -> DataFrame:
    e = t.metric_evidence
    return e.select([c for c in e.columns if c.startswith("reference_")])


@add("f07_numeric_coercion", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS bad FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", parse.number(F.get_json_object("props", "$.k")).alias("k"), parse.number(F.col("event_type")).alias("bad"))


@add("f08_non_finite_to_null", "SELECT metric_instance_id, count(*) AS n, count(CASE WHEN isfinite(value) THEN 1 END) AS finite FROM metric_evidence GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.metric_evidence.groupBy("metric_instance_id").agg(F.count("*").alias("n"), F.count(parse.finite(F.col("value"))).alias("finite"))


@add(
    "f09_conditional_status",
    "SELECT evidence_status, CASE WHEN value IS NULL OR NOT isfinite(value) THEN 'missing' WHEN NOT reference_available THEN 'unavailable' ELSE 'available' END AS derived, count(*) AS n FROM metric_evidence GROUP BY ALL",
)
def _(t: Tables) -> DataFrame:
    derived = F.when(parse.finite(F.col("value")).isNull(), "missing").when(~F.col("reference_available"), "unavailable").otherwise("available")
    return t.metric_evidence.groupBy("evidence_status", derived.alias("derived")).agg(F.count("*").alias("n"))


@add(
    "f10_choose_by_threshold",
    "SELECT vec_id, CASE WHEN s < -0.5 THEN 'low' WHEN s < 0.5 THEN 'middle' WHEN s < 2 THEN 'high' ELSE 'extreme' END AS band FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 4 AS s FROM embeddings)",
)
def _(t: Tables) -> DataFrame:
    s = F.element_at("embedding", 1).cast("double") * 4
    return t.embeddings.select("vec_id", F.when(s < -0.5, "low").when(s < 0.5, "middle").when(s < 2, "high").otherwise("extreme").alias("band"))


@add("f11_defaults", "SELECT case_id, coalesce(split, 'none') AS split, coalesce(age, -1.0) AS age, 0.5 AS threshold FROM manifest")
def _(t: Tables) -> DataFrame:
    m = t.manifest
    threshold = F.col("threshold") if "threshold" in m.columns else F.lit(0.5)
    return m.select("case_id", F.coalesce("split", F.lit("none")).alias("split"), F.coalesce("age", F.lit(-1.0)).alias("age"), threshold.alias("threshold"))


@add("f12_keep_where", "SELECT case_id, CASE WHEN duration_sec > 20 THEN duration_sec ELSE 20.0 END AS duration_sec FROM manifest")
def _(t: Tables) -> DataFrame:
    return t.manifest.select("case_id", F.when(F.col("duration_sec") > 20, F.col("duration_sec")).otherwise(20.0).alias("duration_sec"))


@add("f13_clip", "SELECT event_id, greatest(1.0, least(50.0, value)) AS value FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", parse.clip(F.col("value"), 1.0, 50.0, 0.0).alias("value"))


@add("f14_prefix_columns", "SELECT vec_id AS emb_vec_id, label AS emb_label FROM embeddings")
def _(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", "label")
    return e.withColumnsRenamed({c: f"emb_{c}" for c in e.columns})


_WORDS = "(SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'y' WHEN 2 THEN '1' WHEN 3 THEN '1.0' WHEN 4 THEN 'no' WHEN 5 THEN ' TRUE ' END AS w FROM events)"


def _flag_words(t: Tables) -> DataFrame:
    k, w = F.col("event_id") % 7, F.lit(None).cast("string")
    for i, word in enumerate(("Yes", "y", "1", "1.0", "no", " TRUE ")):
        w = F.when(k == i, word).otherwise(w)
    return t.events.select("event_id", w.alias("w"))


@add("f15_flag_yes", f"SELECT event_id, coalesce(lower(trim(w)) IN ('1', 'true', 'yes', 'y'), false) AS flag FROM {_WORDS}")
def _(t: Tables) -> DataFrame:
    return _flag_words(t).select("event_id", parse.flag_yes(F.col("w")).alias("flag"))


@add("f16_flag_true", f"SELECT event_id, coalesce(lower(trim(w)) IN ('1', 'true', 'yes'), false) AS flag FROM {_WORDS}")
def _(t: Tables) -> DataFrame:
    return _flag_words(t).select("event_id", parse.flag_true(F.col("w")).alias("flag"))


@add("f17_flag_mapped", f"SELECT event_id, CASE WHEN lower(trim(w)) IN ('true', '1', '1.0') THEN true WHEN lower(trim(w)) IN ('false', '0', '0.0') THEN false ELSE true END AS flag FROM {_WORDS}")
def _(t: Tables) -> DataFrame:
    return _flag_words(t).select("event_id", parse.flag_mapped(F.col("w"), True).alias("flag"))


@add("f18_flag_strict", "SELECT case_id, role_filter_required AS flag FROM manifest WHERE role_filter_required IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.manifest.where(F.col("role_filter_required").isNotNull()).select("case_id", parse.flag_strict(F.col("role_filter_required").cast("string"), "role_filter_required").alias("flag"))


@add("f19_required_columns", "SELECT case_id, subject_id FROM manifest")
def _(t: Tables) -> DataFrame:
    return C.require_columns(t.manifest, ["case_id", "subject_id", "split"]).select("case_id", "subject_id")


@add("f20_duplicate_keys", "SELECT case_id, count(*) AS n FROM manifest GROUP BY 1 HAVING count(*) > 1 OR case_id IS NULL OR trim(case_id) = ''")
def _(t: Tables) -> DataFrame:
    return C.duplicate_keys(t.manifest, ["case_id"])


@add("f21_outside_domain", "SELECT split, count(*) AS n FROM manifest WHERE split IS NULL OR split NOT IN ('train', 'test') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return C.outside_domain(t.manifest, "split", ["train", "test"])


@add(
    "f23_train_gate",
    "SELECT dataset_id, count(*) AS n, count(DISTINCT subject_id) AS subjects, bool_or(subject_id IS NULL OR trim(subject_id) = '') AS blank, bool_or(subject_id <> trim(subject_id)) AS padded FROM manifest WHERE split = 'train' GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    s = F.col("subject_id")
    return t.manifest.where(F.col("split") == "train").groupBy("dataset_id").agg(F.count("*").alias("n"), F.count_distinct(s).alias("subjects"), F.bool_or(s.isNull() | (F.trim(s) == "")).alias("blank"), F.bool_or(s != F.trim(s)).alias("padded"))


@add("f24_label_not_constant", "SELECT subject_id, min(label) AS least, max(label) AS greatest FROM manifest GROUP BY 1 HAVING min(label) <> max(label)")
def _(t: Tables) -> DataFrame:
    return C.not_constant(t.manifest, ["subject_id"], "label")


@add(
    "f25_key_difference",
    "SELECT subject_id, CASE WHEN min(s) = 1 THEN 'left' ELSE 'right' END AS side FROM (SELECT subject_id, 1 AS s FROM manifest UNION ALL SELECT subject_id, 2 FROM metric_evidence) GROUP BY 1 HAVING min(s) = max(s)",
)
def _(t: Tables) -> DataFrame:
    return C.key_difference(t.manifest, t.metric_evidence, ["subject_id"])


@add(
    "f26_label_copies",
    "SELECT bool_and(label IS NOT DISTINCT FROM diagnosis_source) AS diagnosis_source, bool_and(label IS NOT DISTINCT FROM sex) AS sex, bool_and(label IS NOT DISTINCT FROM label) AS label FROM manifest WHERE split = 'test'",
)
def _(t: Tables) -> DataFrame:
    return t.manifest.where(F.col("split") == "test").agg(*[F.bool_and(F.col("label").eqNullSafe(F.col(c))).alias(c) for c in ("diagnosis_source", "sex", "label")])


@add("f31_known_labels", "SELECT case_id, CASE WHEN language IS NULL OR lower(trim(language)) IN ('', 'nan', 'none', 'null', 'na', 'n/a', 'unknown') THEN 'unknown' ELSE trim(language) END AS language FROM public_cases")
def _(t: Tables) -> DataFrame:
    return t.public_cases.select("case_id", parse.known_label(F.col("language")).alias("language"))


# --- joins --------------------------------------------------------------------


@add("j01_inner_composite", "SELECT DISTINCT m.case_id, m.dataset_id, p.channel_id FROM prepared_authority_study_case m JOIN public_cases p ON m.case_id = p.case_id AND m.dataset_id = p.dataset_id")
def _(t: Tables) -> DataFrame:
    return t.prepared_authority_study_case.select("case_id", "dataset_id").join(t.public_cases.select("case_id", "dataset_id", "channel_id"), ["case_id", "dataset_id"]).distinct()


@add("j02_left_equi", "SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def _(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@add("j03_lookup", "SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
def _(t: Tables) -> DataFrame:
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


@add("j04_many_to_many", "SELECT g.state_id, count(*) AS n FROM metric_evidence e JOIN (SELECT metric_id, unnest([state_id, branch]) AS state_id FROM metric_registry) g ON e.metric_id = g.metric_id GROUP BY 1")
def _(t: Tables) -> DataFrame:
    g = t.metric_registry.select("metric_id", F.explode(F.array("state_id", "branch")).alias("state_id"))
    return t.metric_evidence.select("metric_id").join(g, "metric_id").groupBy("state_id").agg(F.count("*").alias("n"))


@add("j06_suffixes", "SELECT a.case_id, a.label AS label_ours, b.label AS label_base FROM (SELECT DISTINCT case_id, label FROM manifest WHERE split = 'train') a JOIN (SELECT DISTINCT case_id, label FROM manifest WHERE channel = 'studio') b USING (case_id)")
def _(t: Tables) -> DataFrame:
    a = t.manifest.where("split = 'train'").select("case_id", F.col("label").alias("label_ours")).distinct()
    return a.join(t.manifest.where("channel = 'studio'").select("case_id", F.col("label").alias("label_base")).distinct(), "case_id")


@add("j08_chain", "SELECT c.c_custkey, o.o_orderkey, count(*) AS lines FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    c = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return o.join(c, "c_custkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").groupBy("c_custkey", "o_orderkey").agg(F.count("*").alias("lines"))


@add("j10_map_lookup", "SELECT event_id, CASE event_type WHEN 'view' THEN 'passive' WHEN 'click' THEN 'active' WHEN 'purchase' THEN 'active' ELSE 'other' END AS kind FROM events")
def _(t: Tables) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for x in ("view", "passive", "click", "active", "purchase", "active")])
    return t.events.select("event_id", F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("other")).alias("kind"))


@add("j11_semi", "SELECT case_id, label FROM manifest WHERE subject_id IN (SELECT subject_id FROM metric_evidence WHERE metric_id = 'transcript_truncated')")
def _(t: Tables) -> DataFrame:
    return t.manifest.join(t.metric_evidence.where("metric_id = 'transcript_truncated'").select("subject_id"), "subject_id", "left_semi").select("case_id", "label")


@add("j12_anti", "SELECT case_id, subject_id FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM manifest d WHERE d.split = 'test' AND d.subject_id = m.subject_id)")
def _(t: Tables) -> DataFrame:
    return t.manifest.join(t.manifest.where("split = 'test'").select("subject_id").distinct(), "subject_id", "left_anti").select("case_id", "subject_id")


@add(
    "j13_expected_grid",
    f"""WITH e AS {EV_SQL}, s AS (SELECT DISTINCT subject_id, task_scope FROM e), v AS (SELECT subject_id, task_scope, metric_id, min(value) AS value FROM e GROUP BY ALL)
SELECT g.metric_id, s.task_scope, count(*) AS expected, count(v.value) AS present FROM s CROSS JOIN metric_registry g LEFT JOIN v USING (subject_id, task_scope, metric_id) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    """Every subject and scope it performed, times the registry, with what is there. The registry is a small table, broadcast whole."""
    e = ev(t)
    grid = e.select("subject_id", "task_scope").distinct().crossJoin(F.broadcast(t.metric_registry.select("metric_id").distinct()))
    v = e.groupBy("subject_id", "task_scope", "metric_id").agg(F.min("value").alias("value"))
    return grid.join(v, ["subject_id", "task_scope", "metric_id"], "left").groupBy("metric_id", "task_scope").agg(F.count("*").alias("expected"), F.count("value").alias("present"))


@add("j18_exactly_one", "SELECT subject_id, min(case_id) AS case_id FROM (SELECT DISTINCT subject_id, case_id FROM manifest WHERE subject_id IS NOT NULL) GROUP BY 1 HAVING count(*) = 1")
def _(t: Tables) -> DataFrame:
    d = t.manifest.where(F.col("subject_id").isNotNull()).select("subject_id", "case_id").distinct()
    return d.groupBy("subject_id").agg(F.min("case_id").alias("case_id"), F.count("*").alias("_n")).where("_n = 1").drop("_n")


@add(
    "j19_lookup_with_fallback",
    """WITH one AS (SELECT metric_id, max(state_id) AS state_id FROM metric_registry GROUP BY 1 HAVING count(*) = 1)
SELECT e.evidence_role, coalesce(a.state_id, b.state_id, 'none') AS state_id, count(*) AS n FROM metric_evidence e
LEFT JOIN metric_registry a ON e.metric_id = a.metric_id AND e.branch = a.branch LEFT JOIN one b ON e.metric_instance_id = b.metric_id GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    a = t.metric_registry.select("metric_id", "branch", F.col("state_id").alias("_a"))
    b = t.metric_registry.groupBy(F.col("metric_id").alias("metric_instance_id")).agg(F.max("state_id").alias("_b"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    e = t.metric_evidence.select("metric_id", "branch", "metric_instance_id", "evidence_role")
    return e.join(a, ["metric_id", "branch"], "left").join(b, "metric_instance_id", "left").groupBy("evidence_role", F.coalesce("_a", "_b", F.lit("none")).alias("state_id")).agg(F.count("*").alias("n"))


@add("j21_pseudonym_join", "SELECT a.case_id, b.language FROM (SELECT DISTINCT case_id, substr(sha256('demo::' || case_id), 1, 12) AS k FROM prepared_authority_study_case) a JOIN (SELECT DISTINCT substr(sha256('demo::' || case_id), 1, 12) AS k, language FROM public_cases) b USING (k)")
def _(t: Tables) -> DataFrame:
    from tallyloom.functions.text import pseudonym

    key = pseudonym(F.col("case_id"), "demo").alias("k")
    return t.prepared_authority_study_case.select("case_id", key).distinct().join(t.public_cases.select(key, "language").distinct(), "k").select("case_id", "language")


@add("j24_null_safe", "SELECT a.task_type, a.sex, a.n, b.age FROM (SELECT task_type, sex, count(*) AS n FROM manifest GROUP BY ALL) a JOIN (SELECT sex, max(age) AS age FROM manifest GROUP BY 1) b ON a.sex IS NOT DISTINCT FROM b.sex")
def _(t: Tables) -> DataFrame:
    a = t.manifest.groupBy("task_type", "sex").agg(F.count("*").alias("n"))
    return C.null_safe(a, t.manifest.groupBy("sex").agg(F.max("age").alias("age")), ["sex"])


@add("j29_checked_join", "SELECT o.o_orderkey, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def _(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return C.checked_join(t.orders.select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "c_mktsegment")


# --- aggregations ----------------------------------------------------------------


@add("a01_mean_all_numeric", "SELECT subject_id, round(avg(age), 9) AS age, round(avg(recording_index), 9) AS recording_index, round(avg(sample_rate), 9) AS sample_rate, round(avg(channels), 9) AS channels, round(avg(duration_sec), 9) AS duration_sec, count(*) AS recordings FROM manifest GROUP BY 1")
def _(t: Tables) -> DataFrame:
    m = t.manifest
    numeric = [f.name for f in m.schema if f.dataType.typeName() in ("double", "integer", "long", "float")]
    return m.groupBy("subject_id").agg(*[r(F.avg(c)).alias(c) for c in numeric], F.count("*").alias("recordings"))


@add("a03_single_or_mixed", "SELECT subject_id, CASE count(DISTINCT language) WHEN 0 THEN 'unknown' WHEN 1 THEN min(language) ELSE 'multilingual' END AS language FROM manifest GROUP BY 1")
def _(t: Tables) -> DataFrame:
    lo, hi = F.min("language"), F.max("language")
    return t.manifest.groupBy("subject_id").agg(F.when(lo.isNull(), "unknown").when(lo == hi, lo).otherwise("multilingual").alias("language"))


@add("a04_first_by_order", "SELECT subject_id, arg_min(channel, (recording_index, case_id, channel)) AS channel FROM manifest WHERE channel IS NOT NULL AND recording_index IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.manifest.where(F.col("channel").isNotNull() & F.col("recording_index").isNotNull()).groupBy("subject_id").agg(F.min_by("channel", F.struct("recording_index", "case_id", "channel")).alias("channel"))


@add("a05_having_distinct", "SELECT audio_sha256, count(DISTINCT subject_id) AS subjects FROM manifest WHERE audio_sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT subject_id) > 1")
def _(t: Tables) -> DataFrame:
    return t.manifest.where(F.col("audio_sha256").isNotNull()).groupBy("audio_sha256").agg(F.count_distinct("subject_id").alias("subjects")).where("subjects > 1")


@add("a06_weighted_ratio", f"SELECT subject_id, task_scope, CASE WHEN sum(reliability) > 0 THEN round(sum(reliability * value) / sum(reliability), 9) ELSE 0.0 END AS score FROM {EV_SQL} WHERE reliability IS NOT NULL GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    w = F.sum("reliability")
    return ev(t).where(F.col("reliability").isNotNull()).groupBy("subject_id", "task_scope").agg(F.when(w > 0, r(F.sum(F.col("reliability") * F.col("value")) / w)).otherwise(0.0).alias("score"))


@add("a17_pivot", "SELECT o_orderstatus, " + ", ".join(f"round(sum(o_totalprice) FILTER (o_orderpriority = '{p}'), 2) AS \"{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM")) + " FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    p = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
    return t.orders.where(F.col("o_orderpriority").isin(p)).groupBy("o_orderstatus").pivot("o_orderpriority", p).agg(r(F.sum("o_totalprice"), 2))


@add("a19_crosstab", "SELECT task_type, " + ", ".join(f"count(*) FILTER (label = '{x}') AS {x}" for x in ("HC", "MCI", "AD")) + " FROM manifest GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.manifest.groupBy("task_type").agg(*[F.count_if(F.col("label") == x).alias(x) for x in ("HC", "MCI", "AD")])


@add("a21_purity", "WITH c AS (SELECT acquisition_group, label, count(*) AS n FROM manifest WHERE label IS NOT NULL GROUP BY ALL) SELECT acquisition_group, round(max(n) / sum(n), 9) AS purity, max(n) / sum(n) >= 0.95 AS confounded FROM c GROUP BY 1")
def _(t: Tables) -> DataFrame:
    c = t.manifest.where(F.col("label").isNotNull()).groupBy("acquisition_group", "label").agg(F.count("*").alias("n"))
    p = F.max("n") / F.sum("n")
    return c.groupBy("acquisition_group").agg(r(p).alias("purity"), (p >= 0.95).alias("confounded"))


@add(
    "a22_balanced_group",
    """WITH c AS (SELECT acquisition_group, count(*) FILTER (label = 'HC') AS a, count(*) FILTER (label = 'AD') AS b FROM manifest WHERE acquisition_group IS NOT NULL GROUP BY 1)
SELECT acquisition_group, abs(a - b) AS imbalance, a + b AS total FROM c WHERE a > 0 AND b > 0 ORDER BY imbalance, total DESC, acquisition_group LIMIT 1""",
)
def _(t: Tables) -> DataFrame:
    c = t.manifest.where(F.col("acquisition_group").isNotNull()).groupBy("acquisition_group").agg(F.count_if(F.col("label") == "HC").alias("a"), F.count_if(F.col("label") == "AD").alias("b"))
    return c.where("a > 0 AND b > 0").select("acquisition_group", F.abs(F.col("a") - F.col("b")).alias("imbalance"), (F.col("a") + F.col("b")).alias("total")).orderBy("imbalance", F.desc("total"), "acquisition_group").limit(1)


@add("a23_value_counts", "SELECT language, count(*) AS n FROM manifest GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.manifest.groupBy("language").agg(F.count("*").alias("n"))


@add("a24_keep_last", "SELECT case_id, language FROM (SELECT case_id, language, row_number() OVER (PARTITION BY case_id ORDER BY published_at DESC, created_at DESC, language) AS k FROM public_cases) WHERE k = 1")
def _(t: Tables) -> DataFrame:
    w = W.partitionBy("case_id").orderBy(F.desc("published_at"), F.desc("created_at"), "language")
    return t.public_cases.withColumn("k", F.row_number().over(w)).where("k = 1").select("case_id", "language")


@add("a25_any_all", "SELECT metric_instance_id, bool_or(missing) AS any_missing, bool_and(reference_available) AS all_available FROM metric_evidence GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.metric_evidence.groupBy("metric_instance_id").agg(F.bool_or("missing").alias("any_missing"), F.bool_and("reference_available").alias("all_available"))


@add("a26_completeness", "SELECT round((avg(CAST(subject_id IS NOT NULL AS INT)) + avg(CAST(split IS NOT NULL AS INT)) + avg(CAST(label IS NOT NULL AS INT)) + avg(CAST(age IS NOT NULL AS INT))) / 4, 9) AS completeness FROM manifest")
def _(t: Tables) -> DataFrame:
    parts = [F.avg(F.col(c).isNotNull().cast("int")) for c in ("subject_id", "split", "label", "age")]
    return t.manifest.agg(r(sum(parts[1:], parts[0]) / len(parts)).alias("completeness"))


@add("a27_impute_median", "SELECT case_id, coalesce(age, (SELECT median(age) FROM manifest)) AS age, age IS NULL AS age_missing FROM manifest")
def _(t: Tables) -> DataFrame:
    m = t.manifest.select("case_id", "age")
    return m.join(F.broadcast(m.agg(F.median("age").alias("_m")))).select("case_id", F.coalesce("age", "_m").alias("age"), F.col("age").isNull().alias("age_missing"))


@add(
    "a28_prototypes",
    f"""WITH e AS (SELECT metric_instance_id AS metric_id, label, value FROM {EV_SQL} WHERE label IS NOT NULL), g AS (SELECT metric_id, median(value) AS center, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM e GROUP BY 1)
SELECT metric_id, label, round(median(value), 9) AS class_median, round(any_value(center), 9) AS center, round(any_value(iqr), 9) AS iqr FROM e JOIN g USING (metric_id) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    e = ev(t).where(F.col("label").isNotNull()).select(F.col("metric_instance_id").alias("metric_id"), "label", "value")
    g = e.groupBy("metric_id").agg(r(F.median("value")).alias("center"), r(F.percentile("value", 0.75) - F.percentile("value", 0.25)).alias("iqr"))
    return e.groupBy("metric_id", "label").agg(r(F.median("value")).alias("class_median")).join(g, "metric_id")


@add(
    "a31_evidence_quality",
    "SELECT subject_id, round(avg(CAST(NOT missing AS INT)), 9) AS coverage, round(avg(CASE WHEN NOT missing THEN reliability END), 9) AS mean_reliability, round(avg(json_array_length(confound_tags)), 9) AS confounds FROM metric_evidence WHERE subject_id IS NOT NULL GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    m = F.col("missing")
    return t.metric_evidence.where(F.col("subject_id").isNotNull()).groupBy("subject_id").agg(r(F.avg((~m).cast("int"))).alias("coverage"), r(F.avg(F.when(~m, F.col("reliability")))).alias("mean_reliability"), r(F.avg(F.json_array_length("confound_tags"))).alias("confounds"))


@add("a34_mode_smallest", "SELECT subject_id, channel FROM (SELECT subject_id, channel, count(*) AS n FROM manifest WHERE channel IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY n DESC, channel) = 1")
def _(t: Tables) -> DataFrame:
    c = t.manifest.where(F.col("channel").isNotNull()).groupBy("subject_id", "channel").agg(F.count("*").alias("n"))
    w = W.partitionBy("subject_id").orderBy(F.desc("n"), "channel")
    return c.withColumn("k", F.row_number().over(w)).where("k = 1").select("subject_id", "channel")


@add("a35_mean_sd", "SELECT event_type, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)), 9) AS lower95 FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    m, s = F.avg("value"), F.stddev_samp("value")
    return t.events.groupBy("event_type").agg(r(m).alias("mean"), r(s).alias("sd"), r(m - 1.96 * s / F.sqrt(F.count("*").cast("double"))).alias("lower95"))


@add("a38_reuse_rollup", "SELECT c, count(*) AS n, string_agg(metric_id, ';' ORDER BY metric_id) AS metrics FROM (SELECT metric_id, unnest(confounds) AS c FROM metric_registry) GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    x = t.metric_registry.select("metric_id", F.explode("confounds").alias("c"))
    return x.groupBy("c").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("metric_id")), ";").alias("metrics")).where("n > 1")


@add("a44_quality_rates", "SELECT metric_instance_id, round(avg(CAST(value = 0 AS INT)), 9) AS zero, round(avg(CAST(value = 1 AS INT)), 9) AS one FROM metric_evidence WHERE isfinite(value) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    e = t.metric_evidence.where(parse.finite(F.col("value")).isNotNull())
    return e.groupBy("metric_instance_id").agg(r(F.avg((F.col("value") == 0).cast("int"))).alias("zero"), r(F.avg((F.col("value") == 1).cast("int"))).alias("one"))


@add("a45_mean_of_means", "SELECT dataset_id, round(avg(m), 9) AS mean FROM (SELECT dataset_id, subject_id, avg(duration_sec) AS m FROM manifest GROUP BY ALL) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.manifest.groupBy("dataset_id", "subject_id").agg(F.avg("duration_sec").alias("m")).groupBy("dataset_id").agg(r(F.avg("m")).alias("mean"))


# --- sort, limit and sets ----------------------------------------------------------


@add("o01_sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@add("o05_best_row", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))


@add("o06_union_by_name", "SELECT case_id, language, NULL AS age FROM public_cases UNION ALL SELECT case_id, language, age FROM manifest")
def _(t: Tables) -> DataFrame:
    return t.public_cases.select("case_id", "language").unionByName(t.manifest.select("age", "language", "case_id"), allowMissingColumns=True)


@add("o07_intersect", "SELECT subject_id FROM manifest INTERSECT SELECT subject_id FROM metric_evidence")
def _(t: Tables) -> DataFrame:
    return t.manifest.select("subject_id").intersect(t.metric_evidence.select("subject_id"))


@add("o08_except", "SELECT subject_id FROM metric_evidence EXCEPT SELECT subject_id FROM manifest")
def _(t: Tables) -> DataFrame:
    return t.metric_evidence.select("subject_id").subtract(t.manifest.select("subject_id"))


@add("o09_array_union", "SELECT metric_id, list_sort(list_distinct(list_concat(confounds, [state_id, branch, state_id]))) AS tags FROM metric_registry")
def _(t: Tables) -> DataFrame:
    return t.metric_registry.select("metric_id", F.array_sort(F.array_union("confounds", F.array("state_id", "branch", "state_id"))).alias("tags"))


@add("o10_winners_with_ties", "WITH c AS (SELECT dataset_id, label, count(*) AS n FROM manifest WHERE label IS NOT NULL GROUP BY ALL) SELECT dataset_id, label, n FROM c QUALIFY abs(n - max(n) OVER (PARTITION BY dataset_id)) <= 1e-12")
def _(t: Tables) -> DataFrame:
    c = t.manifest.where(F.col("label").isNotNull()).groupBy("dataset_id", "label").agg(F.count("*").alias("n"))
    return c.withColumn("_m", F.max("n").over(W.partitionBy("dataset_id"))).where(F.abs(F.col("n") - F.col("_m")) <= 1e-12).drop("_m")


@add("o11_longest_first", "SELECT case_id, length(transcript) AS n FROM (SELECT DISTINCT case_id, transcript FROM prepared_authority_study_case WHERE transcript IS NOT NULL) ORDER BY length(transcript) DESC, case_id LIMIT 20")
def _(t: Tables) -> DataFrame:
    d = t.prepared_authority_study_case.where(F.col("transcript").isNotNull()).select("case_id", "transcript").distinct()
    return d.select("case_id", F.length("transcript").cast("long").alias("n")).orderBy(F.desc("n"), "case_id").limit(20)


@add("w06_hash_sample", "SELECT case_id FROM (SELECT DISTINCT case_id FROM public_cases) ORDER BY sha256(case_id), case_id LIMIT 30")
def _(t: Tables) -> DataFrame:
    return Q.hash_sample(t.public_cases.select("case_id").distinct(), "case_id", 30)
