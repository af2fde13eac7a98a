"""Revisions, traces, replay closure and views of the states, over the nested workspaces and the evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import parse
from tallyloom.operators import constraints as C
from tallyloom.operators import research as S
from tallyloom.operators import revise
from tallyloom.plans.catalog import Catalog, Tables, r
from tallyloom.plans.relational import EV_SQL, ev

catalog = Catalog()
add = catalog.add
QUERIES, ORACLES = catalog.queries, catalog.oracles

# One row per record and evidence id: the least confidence and the largest missing fraction of its observations, in thousandths.
_BASE = """b AS (SELECT record_id, s.evidence_id AS evidence_id, min(CAST(floor(s.confidence * 1000) AS BIGINT)) AS confidence, max(CAST(floor(s.missing_fraction * 1000) AS BIGINT)) AS missing
FROM (SELECT record_id, unnest(state_observations) AS s FROM synthetic_workspace) WHERE s.evidence_id IS NOT NULL GROUP BY ALL),
h AS (SELECT *, sha256(evidence_id || '|' || coalesce(CAST(confidence AS VARCHAR), '')) AS hash FROM b),
v AS (SELECT record_id, evidence_id, 'unavailable' AS action, 0.0 AS factor, CASE WHEN record_id % 5 = 0 THEN 'stale' ELSE hash END AS guard FROM h WHERE missing > 400
UNION ALL SELECT record_id, evidence_id, 'downweight', 0.5, hash FROM h WHERE confidence < 500
UNION ALL SELECT record_id, evidence_id, 'downweight', 0.5, hash FROM h WHERE confidence < 250
UNION ALL SELECT record_id, 'nowhere', 'downweight', 0.5, 'x' FROM h WHERE record_id % 13 = 0 GROUP BY 1),
c AS (SELECT record_id, evidence_id, arg_min(action, CASE action WHEN 'unavailable' THEN 1 WHEN 'invalidate' THEN 2 ELSE 3 END) AS action, min(factor) AS factor, min(guard) AS guard, count(*) AS merged,
count(DISTINCT action) > 1 OR count(DISTINCT guard) > 1 AS conflict FROM v GROUP BY ALL)"""


def _base(t: Tables) -> DataFrame:
    s = t.synthetic_workspace.select("record_id", F.explode("state_observations").alias("s")).where(F.col("s.evidence_id").isNotNull())
    thousandths = lambda c: F.floor(F.col(c) * 1000).cast("long")
    b = s.groupBy("record_id", F.col("s.evidence_id").alias("evidence_id")).agg(F.min(thousandths("s.confidence")).alias("confidence"), F.max(thousandths("s.missing_fraction")).alias("missing"))
    return b.withColumn("guard", F.sha2(F.concat("evidence_id", F.lit("|"), F.coalesce(F.col("confidence").cast("string"), F.lit(""))), 256))


def _revisions(base: DataFrame) -> DataFrame:
    """Three rules that may name the same evidence; some batches are stale, some name evidence that does not exist."""
    columns = ("record_id", "evidence_id", "action", "factor", "guard")
    rule = lambda rows, action, factor, guard: rows.select("record_id", "evidence_id", F.lit(action).alias("action"), F.lit(factor).alias("factor"), guard.alias("guard"))
    stale = F.when(F.col("record_id") % 5 == 0, "stale").otherwise(F.col("guard"))
    nowhere = base.where("record_id % 13 = 0").select("record_id").distinct().withColumns({"evidence_id": F.lit("nowhere"), "guard": F.lit("x")})
    out = rule(base.where("missing > 400"), "unavailable", 0.0, stale)
    for rows in (base.where("confidence < 500"), base.where("confidence < 250"), nowhere):
        out = out.unionByName(rule(rows, "downweight", 0.5, F.col("guard")))
    return out.select(*columns)


@add("g14_compiled_batches", f"WITH {_BASE} SELECT record_id, count(*) AS revisions, sum(merged) AS merged, count(*) FILTER (conflict) AS conflicts, sha256(string_agg(evidence_id || ':' || action, ';' ORDER BY evidence_id)) AS batch_hash FROM c GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Each record's revisions as one batch with the hash of its steps."""
    c = revise.compiled(_revisions(_base(t)), "record_id", "evidence_id", "action", "guard")
    # A record's steps are as many as its observations.
    steps = F.array_sort(F.collect_list(F.struct("evidence_id", "action")))
    g = c.groupBy("record_id").agg(F.count("*").alias("revisions"), F.sum("merged").alias("merged"), F.count_if("conflict").alias("conflicts"), steps.alias("s"))
    return g.select("record_id", "revisions", "merged", "conflicts", F.sha2(F.array_join(F.transform("s", lambda x: F.concat(x["evidence_id"], F.lit(":"), x["action"])), ";"), 256).alias("batch_hash"))


@add(
    "g13_revision",
    f"""WITH {_BASE}, k AS (SELECT c.record_id, bool_or(h.evidence_id IS NULL OR c.conflict OR h.hash <> c.guard) AS rejected FROM c LEFT JOIN h ON h.record_id = c.record_id AND h.evidence_id = c.evidence_id GROUP BY 1)
SELECT h.record_id, h.evidence_id, CASE WHEN c.action IS NULL OR k.rejected THEN 'kept' ELSE c.action END AS action,
round(CASE WHEN c.action IS NULL OR k.rejected THEN CAST(h.confidence AS DOUBLE) WHEN c.action = 'downweight' THEN h.confidence * c.factor ELSE 0.0 END, 6) AS confidence,
CASE WHEN k.rejected IS NULL THEN 'untouched' WHEN k.rejected THEN 'rejected' ELSE 'applied' END AS status
FROM h LEFT JOIN c ON h.record_id = c.record_id AND h.evidence_id = c.evidence_id LEFT JOIN k ON k.record_id = h.record_id""",
)
def _(t: Tables) -> DataFrame:
    """Evidence after its batch: applied whole, or rejected whole for a stale hash, an unknown id or a conflict."""
    base = _base(t).withColumn("confidence", F.col("confidence").cast("double"))
    plan = revise.compiled(_revisions(_base(t)), "record_id", "evidence_id", "action", "guard")
    return revise.applied(base, plan, "record_id", "evidence_id", "guard", "confidence").withColumn("confidence", F.round("confidence", 6))


@add(
    "g15_affected",
    """WITH RECURSIVE o AS (SELECT record_id, s.evidence_id AS e, unnest(s.metric_evidence_ids) AS m, s.state_id AS st FROM (SELECT record_id, unnest(state_observations) AS s FROM synthetic_workspace) WHERE s.evidence_id IS NOT NULL),
e AS (SELECT DISTINCT m AS parent, 'obs:' || record_id || ':' || e AS child FROM o WHERE m IS NOT NULL UNION SELECT DISTINCT 'obs:' || record_id || ':' || e, 'record:' || record_id FROM o UNION SELECT DISTINCT 'record:' || record_id, 'case:' || case_id FROM synthetic_workspace WHERE case_id IS NOT NULL),
w AS (SELECT 'metric:pause_mean_sec' AS node, 0 AS depth UNION SELECT e.child, w.depth + 1 FROM w JOIN e ON e.parent = w.node) SELECT node, min(depth) AS depth FROM w GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    """What a change of one metric invalidates: the observations that cite it, their records, and the cases of those."""
    o = t.synthetic_workspace.select("record_id", "case_id", F.explode_outer("state_observations").alias("s"))
    record = F.concat(F.lit("record:"), F.col("record_id").cast("string"))
    own = F.concat(F.lit("obs:"), F.col("record_id").cast("string"), F.lit(":"), F.col("s.evidence_id"))
    seen = o.where(F.col("s.evidence_id").isNotNull())
    edges = seen.select(F.explode("s.metric_evidence_ids").alias("parent"), own.alias("child")).where("parent IS NOT NULL")
    edges = edges.unionByName(seen.where(F.size("s.metric_evidence_ids") > 0).select(own.alias("parent"), record.alias("child")))
    edges = edges.unionByName(o.where(F.col("case_id").isNotNull()).select(record.alias("parent"), F.concat(F.lit("case:"), F.col("case_id")).alias("child")))
    return S.reachable(edges.distinct(), t.spark.createDataFrame([("metric:pause_mean_sec",)], "node string"))


@add(
    "j20_trace",
    """WITH o AS (SELECT record_id, case_id, unnest(state_observations) AS s, coalesce(evidence_registry, []) AS g FROM synthetic_workspace),
x AS (SELECT record_id, case_id, s.evidence_id AS evidence_id, s.state_id AS state_id,
len(list_filter(coalesce(s.metric_evidence_ids, []), lambda m: m IS NOT NULL)) AS metrics,
len(list_filter(coalesce(s.metric_evidence_ids, []), lambda m: m IS NOT NULL AND NOT list_contains(list_transform(g, lambda y: y.evidence_id), m))) AS unregistered,
len(list_filter(coalesce(s.evidence_segments, []), lambda y: y IS NOT NULL)) AS segments,
len(list_filter(coalesce(s.evidence_segments, []), lambda y: y IS NOT NULL AND NOT coalesce(y.start_sec >= 0 AND y.end_sec > y.start_sec, false))) AS bad_segments FROM o WHERE s.evidence_id IS NOT NULL),
k AS (SELECT x.*, state_id IN (SELECT state_id FROM metric_registry) AS known_state, case_id IN (SELECT case_id FROM public_cases WHERE case_id IS NOT NULL) AS known_asset FROM x)
SELECT record_id, evidence_id, metrics, unregistered, segments, bad_segments, coalesce(known_state, false) AS known_state, coalesce(known_asset, false) AS known_asset,
coalesce(known_state, false) AND coalesce(known_asset, false) AND unregistered = 0 AND bad_segments = 0 AND metrics > 0 AS whole FROM k""",
)
def _(t: Tables) -> DataFrame:
    """Every link of a claim's chain: its state, its metrics in the record's registry, its segments' bounds, and its asset among the cases."""
    o = t.synthetic_workspace.select("record_id", "case_id", F.explode("state_observations").alias("s"), F.coalesce("evidence_registry", F.array().cast("array<struct<evidence_id:string,evidence_type:string>>")).alias("g")).where(F.col("s.evidence_id").isNotNull())
    there = lambda c: F.coalesce(F.filter(F.col(c), lambda m: m.isNotNull()), F.filter(F.col(c), lambda m: F.lit(False)))
    count = lambda a: F.greatest(F.coalesce(F.size(a), F.lit(0)), F.lit(0)).cast("long")
    known = F.col("g.evidence_id")
    # A registered id may be null, so membership is asked for without three-valued logic.
    missing = F.filter(there("s.metric_evidence_ids"), lambda m: ~F.exists(known, lambda k: k.eqNullSafe(m)))
    bad = F.filter(there("s.evidence_segments"), lambda y: ~F.coalesce((y["start_sec"] >= 0) & (y["end_sec"] > y["start_sec"]), F.lit(False)))
    x = o.select("record_id", "case_id", F.col("s.evidence_id").alias("evidence_id"), F.col("s.state_id").alias("state_id"), count(there("s.metric_evidence_ids")).alias("metrics"), count(missing).alias("unregistered"), count(there("s.evidence_segments")).alias("segments"), count(bad).alias("bad_segments"))
    states = t.metric_registry.select("state_id").distinct().withColumn("known_state", F.lit(True))
    assets = t.public_cases.where(F.col("case_id").isNotNull()).select("case_id").distinct().withColumn("known_asset", F.lit(True))
    k = x.join(states, "state_id", "left").join(assets, "case_id", "left").na.fill(False, ["known_state", "known_asset"])
    whole = F.col("known_state") & F.col("known_asset") & (F.col("unregistered") == 0) & (F.col("bad_segments") == 0) & (F.col("metrics") > 0)
    return k.select("record_id", "evidence_id", "metrics", "unregistered", "segments", "bad_segments", "known_state", "known_asset", whole.alias("whole"))


_STATE = f"(SELECT subject_id, state_id, task_scope, avg(directional_z) AS z FROM {EV_SQL} WHERE isfinite(directional_z) AND state_id IS NOT NULL AND task_scope IS NOT NULL GROUP BY ALL)"


def _states(t: Tables) -> DataFrame:
    z = parse.finite(F.col("directional_z"))
    return ev(t).where(z.isNotNull() & F.col("state_id").isNotNull() & F.col("task_scope").isNotNull()).groupBy("subject_id", "state_id", "task_scope").agg(F.avg("directional_z").alias("z"))


_ACTIVE = f"""s AS {_STATE}, a AS (SELECT subject_id, state_id, coalesce(max(z) FILTER (task_scope = 'picture_description'), max(z) FILTER (task_scope = 'global')) AS z,
CASE WHEN count(*) FILTER (task_scope = 'picture_description') > 0 THEN 'task' ELSE 'overall' END AS source FROM s WHERE task_scope IN ('picture_description', 'global') GROUP BY ALL)"""


def _active(t: Tables) -> DataFrame:
    s = _states(t).where(F.col("task_scope").isin("picture_description", "global"))
    at = lambda scope: F.max(F.when(F.col("task_scope") == scope, F.col("z")))
    has = F.count_if(F.col("task_scope") == "picture_description") > 0
    return s.groupBy("subject_id", "state_id").agg(F.coalesce(at("picture_description"), at("global")).alias("z"), F.when(has, "task").otherwise("overall").alias("source"))


@add(
    "a46_active_task_view",
    f"""WITH {_ACTIVE}, w AS (SELECT x.state_id AS a, y.state_id AS b, bool_and(abs(x.z - y.z) <= 1e-12) AS equal, count(*) AS n FROM a x JOIN a y ON x.subject_id = y.subject_id AND x.state_id < y.state_id GROUP BY ALL),
n AS (SELECT state_id, count(*) AS n FROM a GROUP BY 1), d AS (SELECT w.b FROM w JOIN n x ON x.state_id = w.a JOIN n y ON y.state_id = w.b WHERE w.equal AND w.n = x.n AND w.n = y.n)
SELECT subject_id, state_id, round(z, 9) AS z, source FROM a WHERE state_id NOT IN (SELECT b FROM d)""",
)
def _(t: Tables) -> DataFrame:
    """Each subject's states as its active task shows them, else overall; states that copy an earlier one in every subject are left out."""
    a = _active(t)
    pairs = S.copies(a, [], "subject_id", "state_id", "z", 1e-12)
    n = a.groupBy("state_id").agg(F.count("*").alias("_c"))
    # The states are a registry's, so these tables have tens of rows.
    same = pairs.where("equal").join(n.select(F.col("state_id").alias("a"), F.col("_c").alias("_ca")), "a").join(n.select(F.col("state_id").alias("b"), F.col("_c").alias("_cb")), "b")
    copies = same.where((F.col("n") == F.col("_ca")) & (F.col("n") == F.col("_cb"))).select(F.col("b").alias("state_id"))
    return a.join(copies, "state_id", "left_anti").select("subject_id", "state_id", r(F.col("z")).alias("z"), "source")


@add("w22_task_disagreement", f"WITH s AS {_STATE} SELECT t.subject_id, count(*) AS pairs, round(avg(abs(t.z - g.z)), 9) AS disagreement FROM s t JOIN s g ON t.subject_id = g.subject_id AND t.state_id = g.state_id WHERE t.task_scope <> 'global' AND g.task_scope = 'global' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """How far a subject's states within tasks lie from the same states overall."""
    s = _states(t)
    g = s.where("task_scope = 'global'").select("subject_id", "state_id", F.col("z").alias("whole"))
    return s.where("task_scope <> 'global'").join(g, ["subject_id", "state_id"]).groupBy("subject_id").agg(F.count("*").alias("pairs"), r(F.avg(F.abs(F.col("z") - F.col("whole")))).alias("disagreement"))


@add("e19_scope_reuse", f"WITH s AS {_STATE} SELECT t.state_id, t.task_scope, count(*) AS n, bool_and(abs(t.z - g.z) <= 1e-9) AS copied, CASE WHEN var_pop(g.z) > 1e-12 AND var_pop(t.z) > 1e-12 THEN round(covar_pop(t.z, g.z) / sqrt(var_pop(t.z) * var_pop(g.z)), 6) END AS correlation, CASE WHEN var_pop(g.z) > 1e-12 THEN round(covar_pop(t.z, g.z) / var_pop(g.z), 6) END AS slope FROM s t JOIN s g ON t.subject_id = g.subject_id AND t.state_id = g.state_id WHERE t.task_scope <> 'global' AND g.task_scope = 'global' GROUP BY ALL HAVING count(*) > 2")
def _(t: Tables) -> DataFrame:
    """Whether a state within a task is the overall one again, exactly or along a line."""
    s = _states(t)
    g = s.where("task_scope = 'global'").select("subject_id", "state_id", F.col("z").alias("whole"))
    x = s.where("task_scope <> 'global'").join(g, ["subject_id", "state_id"]).groupBy("state_id", "task_scope")
    both, own, other = F.covar_pop("z", "whole"), F.var_pop("z"), F.var_pop("whole")
    line = [F.when((own > 1e-12) & (other > 1e-12), F.round(both / F.sqrt(own * other), 6)).alias("correlation"), F.when(other > 1e-12, F.round(both / other, 6)).alias("slope")]
    return x.agg(F.count("*").alias("n"), F.bool_and(F.abs(F.col("z") - F.col("whole")) <= 1e-9).alias("copied"), *line).where("n > 2")


@add("a17_pivot_unique", "SELECT o_orderkey, " + ", ".join(f"max(o_totalprice) FILTER (o_orderstatus = '{x}') AS status_{x}" for x in "FOP") + " FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """An order's price under its status; two rows for one cell raise."""
    return C.pivot_unique(t.orders, ["o_orderkey"], "o_orderstatus", ["F", "O", "P"], "o_totalprice", "status_")


@add("g17_assembled_records", f"SELECT subject_id, count(DISTINCT state_id) AS states, string_agg(state_id || '=' || z, ';' ORDER BY state_id) AS document FROM (SELECT subject_id, state_id, CAST(floor(avg(directional_z) * 1000 + 0.5) AS BIGINT) AS z FROM {EV_SQL} WHERE isfinite(directional_z) AND state_id IS NOT NULL GROUP BY ALL) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """One nested document a subject, written as text: its states in order, each with its mean score in thousandths."""
    z = parse.finite(F.col("directional_z"))
    s = ev(t).where(z.isNotNull() & F.col("state_id").isNotNull()).groupBy("subject_id", "state_id").agg(F.floor(F.avg("directional_z") * 1000 + 0.5).cast("long").alias("z"))
    doc = s.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("state_id", "z"))).alias("d"))
    return doc.select("subject_id", F.size("d").cast("long").alias("states"), F.array_join(F.transform("d", lambda x: F.concat(x["state_id"], F.lit("="), x["z"].cast("string"))), ";").alias("document"))


@add("g25_typed_rows", "SELECT subject_id, metric_instance_id AS instance, evidence_status, CASE WHEN reference_available THEN reference_scope END AS scope, round(CASE WHEN reference_available THEN (value - reference_median) / nullif(reference_scale, 0) END, 6) AS z, reliability IS NOT NULL AND dataset_id IS NOT NULL AS provenance FROM metric_evidence WHERE isfinite(value)")
def _(t: Tables) -> DataFrame:
    """Flat rows as typed evidence: a reference that counts only where it is available, quality and provenance, read back field by field."""
    e = t.metric_evidence.where(parse.finite(F.col("value")).isNotNull()).select(
        "subject_id", "evidence_status", "value", F.when(F.col("reference_available"), F.struct(F.col("reference_median").alias("median"), F.col("reference_scale").alias("scale"), F.col("reference_scope").alias("scope"))).alias("reference"),
        F.struct(F.col("reliability").alias("total"), F.col("dataset_id").alias("dataset"), F.col("metric_instance_id").alias("instance")).alias("source"),
    )
    z = (F.col("value") - F.col("reference.median")) / F.nullif(F.col("reference.scale"), F.lit(0.0))
    return e.select("subject_id", "source.instance", "evidence_status", "reference.scope", F.round(z, 6).alias("z"), (F.col("source.total").isNotNull() & F.col("source.dataset").isNotNull()).alias("provenance"))


@add("n06_without_fields", "SELECT record_id, array_to_string(list_transform(list_filter(state_observations, lambda s: s IS NOT NULL), lambda s: coalesce(s.evidence_id, '-') || ':' || coalesce(CAST(CAST(floor(CASE WHEN isfinite(s.state_z) THEN s.state_z END * 100) AS BIGINT) AS VARCHAR), 'null')), ';') AS kept FROM synthetic_workspace WHERE state_observations IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """Observations without two fields and with non-finite scores as null, at any depth of the array, written as text."""
    there = F.filter("state_observations", lambda s: s.isNotNull())
    slim = F.transform(there, lambda s: s.dropFields("evidence_segments", "counter_evidence").withField("state_z", parse.finite(s["state_z"])))
    text = lambda s: F.concat(F.coalesce(s["evidence_id"], F.lit("-")), F.lit(":"), F.coalesce(F.floor(s["state_z"] * 100).cast("long").cast("string"), F.lit("null")))
    return t.synthetic_workspace.where(F.col("state_observations").isNotNull()).select("record_id", F.array_join(F.transform(slim, text), ";").alias("kept"))


@add("g21_reviewed", "SELECT record_id, array_to_string(list_transform(list_filter(state_observations, lambda s: s IS NOT NULL AND coalesce(s.report_permission, false)), lambda s: coalesce(s.evidence_id, '-')), ';') AS kept FROM synthetic_workspace WHERE state_observations IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """The observations left after those without permission are dropped inside the record."""
    kept = F.filter("state_observations", lambda s: F.coalesce(s["report_permission"], F.lit(False)))
    return t.synthetic_workspace.where(F.col("state_observations").isNotNull()).select("record_id", F.array_join(F.transform(kept, lambda s: F.coalesce(s["evidence_id"], F.lit("-"))), ";").alias("kept"))


@add(
    "g11_off_against_on",
    """WITH w AS (SELECT record_id, base_probabilities AS b, corrected_probabilities AS c FROM synthetic_workspace WHERE base_probabilities IS NOT NULL AND corrected_probabilities IS NOT NULL),
x AS (SELECT record_id, unnest(map_entries(b)) AS e, c FROM w), d AS (SELECT record_id, sum(abs(e.value - coalesce(c[e.key], 0))) AS d, arg_max(e.key, (e.value, e.key)) AS was FROM x GROUP BY 1),
y AS (SELECT record_id, unnest(map_entries(c)) AS e FROM w), n AS (SELECT record_id, arg_max(e.key, (e.value, e.key)) AS now FROM y GROUP BY 1)
SELECT round(avg(d), 9) AS mean_change, count(*) FILTER (d > 0) AS changed, count(*) AS n, count(*) FILTER (was <> now) AS decisions_changed FROM d LEFT JOIN n USING (record_id)""",
)
def _(t: Tables) -> DataFrame:
    """How far corrected probabilities lie from the base, and how many decisions they change."""
    w = t.synthetic_workspace.where("base_probabilities IS NOT NULL AND corrected_probabilities IS NOT NULL").where(F.size("base_probabilities") > 0)
    change = F.aggregate(F.map_entries("base_probabilities"), F.lit(0.0), lambda a, e: a + F.abs(e["value"] - F.coalesce(F.try_element_at("corrected_probabilities", e["key"]), F.lit(0.0))))
    # The key of the largest value, of equal ones the last by name.
    top = lambda m: F.array_max(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))["key"]
    x = w.select(change.alias("d"), (top("base_probabilities") != top("corrected_probabilities")).alias("moved"))
    return x.agg(r(F.avg("d")).alias("mean_change"), F.count_if(F.col("d") > 0).alias("changed"), F.count("*").alias("n"), F.count_if("moved").alias("decisions_changed"))


@add(
    "g07_segment_faithfulness",
    """WITH g AS (SELECT record_id, case_transcript.text AS whole, unnest(s.evidence_segments) AS g FROM (SELECT record_id, case_transcript, unnest(state_observations) AS s FROM synthetic_workspace)),
k AS (SELECT record_id, g.segment_id AS id, count(*) AS times, count(DISTINCT struct_pack(a := g.start_sec, b := g.end_sec, c := g.text)) AS forms, bool_and(coalesce(g.start_sec >= 0 AND g.end_sec > g.start_sec, false)) AS bounds,
bool_and(coalesce(contains(whole, g.text), false)) AS said FROM g WHERE g.segment_id IS NOT NULL GROUP BY ALL)
SELECT record_id, count(*) AS segments, count(*) FILTER (times > 1) AS cited_again, count(*) FILTER (forms > 1) AS contradictory, count(*) FILTER (NOT bounds) AS bad_bounds, count(*) FILTER (said) AS in_transcript FROM k GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    """A record's segments: cited more than once, told in different forms, out of bounds, and found in its own transcript."""
    o = t.synthetic_workspace.select("record_id", F.col("case_transcript.text").alias("whole"), F.explode("state_observations").alias("s"))
    g = o.select("record_id", "whole", F.explode("s.evidence_segments").alias("g")).where(F.col("g.segment_id").isNotNull())
    bounds = F.coalesce((F.col("g.start_sec") >= 0) & (F.col("g.end_sec") > F.col("g.start_sec")), F.lit(False))
    said = F.coalesce(F.col("whole").contains(F.col("g.text")), F.lit(False))
    form = F.struct(F.col("g.start_sec").alias("a"), F.col("g.end_sec").alias("b"), F.col("g.text").alias("c"))
    k = g.groupBy("record_id", F.col("g.segment_id").alias("id")).agg(F.count("*").alias("times"), F.size(F.collect_set(form)).alias("forms"), F.bool_and(bounds).alias("bounds"), F.bool_and(said).alias("said"))
    return k.groupBy("record_id").agg(F.count("*").alias("segments"), F.count_if(F.col("times") > 1).alias("cited_again"), F.count_if(F.col("forms") > 1).alias("contradictory"), F.count_if(~F.col("bounds")).alias("bad_bounds"), F.count_if("said").alias("in_transcript"))


@add(
    "g18_candidate_validation",
    """WITH o AS (SELECT record_id, list_filter(list_transform(coalesce(state_observations, []), lambda s: s.evidence_id), lambda e: e IS NOT NULL) AS cited, list_filter(list_transform(coalesce(evidence_registry, []), lambda g: g.evidence_id), lambda e: e IS NOT NULL) AS allowed, coalesce(list_bool_and(list_transform(map_values(corrected_probabilities), lambda x: x IS NOT NULL AND x >= 0 AND x <= 1)) AND abs(list_sum(map_values(corrected_probabilities)) - 1) <= 0.0015, false) AS simplex FROM synthetic_workspace),
x AS (SELECT record_id, len(cited) AS cited, len(list_filter(cited, lambda e: NOT list_contains(allowed, e))) AS uncited, len(cited) - len(list_distinct(cited)) AS repeated, simplex FROM o)
SELECT record_id, cited, uncited, repeated, simplex, cited > 0 AND uncited = 0 AND simplex AS accepted FROM x""",
)
def _(t: Tables) -> DataFrame:
    """A candidate is accepted if it cites something, nothing beyond its registry, and its probabilities are some."""
    from tallyloom.functions import vectors as V

    there = lambda c: F.coalesce(F.filter(F.col(c), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    o = t.synthetic_workspace.select("record_id", there("state_observations.evidence_id").alias("c"), there("evidence_registry.evidence_id").alias("a"), V.is_simplex(F.map_values("corrected_probabilities"), 0.0015).alias("simplex"))
    x = o.select("record_id", F.size("c").cast("long").alias("cited"), F.size(F.filter("c", lambda e: ~F.array_contains("a", e))).cast("long").alias("uncited"), (F.size("c") - F.size(F.array_distinct("c"))).cast("long").alias("repeated"), "simplex")
    return x.withColumn("accepted", (F.col("cited") > 0) & (F.col("uncited") == 0) & F.col("simplex"))
