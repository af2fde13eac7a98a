"""Runs, windows, ranks and alignments over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators import prefix
from tallyloom.operators import sequence as Q
from tallyloom.plans.catalog import Catalog, Tables, r
from tallyloom.plans.relational import EV_SQL, ev

catalog = Catalog()
add = catalog.add
QUERIES, ORACLES = catalog.queries, catalog.oracles

#: Seconds since the first of January 2024.
SEC_SQL = "(epoch_us(ts) - 1704067200000000) / 1000000.0"


def _events(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_id", "event_type", "value", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / F.lit(1000000.0)).alias("sec"), (F.col("event_type") != "error").alias("voiced"))


@add("w01_top_k", "SELECT subject_id, metric_id, value, rank FROM (SELECT subject_id, metric_id, value, row_number() OVER (PARTITION BY subject_id ORDER BY reliability DESC NULLS LAST, value DESC, metric_id, recorded_at, exported_at) AS rank FROM " + EV_SQL + ") WHERE rank <= 3")
def _(t: Tables) -> DataFrame:
    order = [F.desc_nulls_last("reliability"), F.desc("value"), F.asc("metric_id"), F.asc("recorded_at"), F.asc("exported_at")]
    return Q.top_k(ev(t).select("subject_id", "metric_id", "value", "reliability", "recorded_at", "exported_at"), ["subject_id"], order, 3).select("subject_id", "metric_id", "value", "rank")


@add("w02_bottom_two", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def _(t: Tables) -> DataFrame:
    return Q.top_k(t.orders, ["o_custkey"], [F.asc("o_totalprice"), F.asc("o_orderkey")], 2).select("o_custkey", "o_orderkey", "rank")


@add(
    "w04_diversified_top_k",
    """WITH m AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1 AS f FROM orders),
p AS (SELECT *, CASE WHEN f THEN row_number() OVER (PARTITION BY o_custkey, f ORDER BY o_totalprice DESC, o_orderkey) ELSE 1000000000 + row_number() OVER (PARTITION BY o_custkey, f ORDER BY o_orderkey) END AS p FROM m)
SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY p) AS rank FROM p) WHERE rank <= 4""",
)
def _(t: Tables) -> DataFrame:
    return Q.diversified(t.orders, ["o_custkey"], ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], [F.asc("o_orderkey")], 4).select("o_custkey", "o_orderkey", "rank")


@add("w05_shadowed_scopes", "WITH d AS (SELECT DISTINCT subject_id, metric_instance_id, task_scope FROM metric_evidence) SELECT * FROM d WHERE task_scope <> 'global' OR NOT EXISTS (SELECT 1 FROM d x WHERE x.subject_id IS NOT DISTINCT FROM d.subject_id AND x.metric_instance_id = d.metric_instance_id AND x.task_scope <> 'global')")
def _(t: Tables) -> DataFrame:
    return Q.shadowed(t.metric_evidence.select("subject_id", "metric_instance_id", "task_scope").distinct(), ["subject_id", "metric_instance_id"], "task_scope", "global")


@add("w07_average_rank", "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rank FROM events")
def _(t: Tables) -> DataFrame:
    return prefix.average_ranks(t.events.select("event_id", "event_type", "value"), ["event_type"], "value", "rank").select("event_id", "rank")


_RUNS = """WITH c AS (SELECT user_id, event_id, ts, event_type <> 'error' AS voiced, CASE WHEN lag(event_type <> 'error') OVER w IS NOT DISTINCT FROM (event_type <> 'error') THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, voiced, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_no FROM c), q AS (SELECT user_id, run_no, any_value(voiced) AS voiced, count(*) AS n FROM g GROUP BY ALL) """


@add("w08_runs", _RUNS + "SELECT user_id, run_no, voiced, n FROM q")
def _(t: Tables) -> DataFrame:
    return Q.runs(_events(t), ["user_id"], ["sec", "event_id"], "voiced")


@add("w09_run_statistics", _RUNS + "SELECT user_id, count(*) FILTER (NOT voiced AND n >= 2) AS long_pauses, round(avg(n) FILTER (voiced), 9) AS mean_run, round(quantile_cont(n, 0.9) FILTER (voiced), 9) AS p90, round(stddev_pop(n) FILTER (voiced), 9) AS sd FROM q GROUP BY 1")
def _(t: Tables) -> DataFrame:
    q = Q.runs(_events(t), ["user_id"], ["sec", "event_id"], "voiced")
    n = F.when(F.col("voiced"), F.col("n"))
    return q.groupBy("user_id").agg(F.count_if(~F.col("voiced") & (F.col("n") >= 2)).alias("long_pauses"), r(F.avg(n)).alias("mean_run"), r(F.percentile(n, 0.9)).alias("p90"), r(F.stddev_pop(n)).alias("sd"))


@add("w10_tumbling", f"SELECT user_id, CAST(floor({SEC_SQL} / 86400) AS BIGINT) AS day, count(*) AS n, round(avg(CAST(event_type <> 'error' AS INT)), 9) AS voiced FROM events GROUP BY ALL HAVING count(*) >= 2")
def _(t: Tables) -> DataFrame:
    return _events(t).groupBy("user_id", Q.tumbling(F.col("sec"), 86400).alias("day")).agg(F.count("*").alias("n"), r(F.avg(F.col("voiced").cast("int"))).alias("voiced")).where("n >= 2")


@add("w11_transition_rate", f"WITH c AS (SELECT user_id, floor({SEC_SQL} / 604800) AS week, CASE WHEN lag(event_type <> 'error') OVER (PARTITION BY user_id, floor({SEC_SQL} / 604800) ORDER BY ts, event_id) <> (event_type <> 'error') THEN 1 ELSE 0 END AS c FROM events) SELECT user_id, CAST(week AS BIGINT) AS week, sum(c) AS transitions FROM c GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    e = _events(t).withColumn("week", Q.tumbling(F.col("sec"), 604800))
    before = F.lag("voiced").over(W.partitionBy("user_id", "week").orderBy("sec", "event_id"))
    return e.withColumn("_c", F.when(before != F.col("voiced"), 1).otherwise(0)).groupBy("user_id", "week").agg(F.sum("_c").alias("transitions"))


@add(
    "w12_sliding_starts",
    """WITH d AS (SELECT case_id, CAST(floor(duration_sec) AS BIGINT) AS n FROM manifest WHERE duration_sec > 1),
s AS (SELECT case_id, unnest(CASE WHEN n > 10 AND (n - 10) % 4 <> 0 THEN list_append(range(0, n - 10 + 1, 4), n - 10) ELSE range(0, greatest(n - 10, 0) + 1, 4) END) AS start FROM d) SELECT case_id, start, count(*) AS n FROM s GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    d = t.manifest.where("duration_sec > 1").select("case_id", F.floor("duration_sec").cast("long").alias("n"))
    return d.select("case_id", F.explode(Q.sliding_starts(F.col("n"), 10, 4)).alias("start")).groupBy("case_id", "start").agg(F.count("*").alias("n"))


@add("w13_within_budget", "SELECT subject_id, case_id FROM (SELECT subject_id, case_id, coalesce(sum(duration_sec) OVER (PARTITION BY subject_id ORDER BY recording_index, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT DISTINCT subject_id, case_id, recording_index, duration_sec FROM manifest WHERE subject_id IS NOT NULL AND duration_sec IS NOT NULL)) WHERE b < 60")
def _(t: Tables) -> DataFrame:
    m = t.manifest.where("subject_id IS NOT NULL AND duration_sec IS NOT NULL").select("subject_id", "case_id", "recording_index", "duration_sec").distinct()
    return Q.within_budget(m, ["subject_id"], ["recording_index", "case_id"], "duration_sec", 60.0).select("subject_id", "case_id")


@add("w14_pooling", "SELECT label, i AS dim, round(avg(x), 7) AS mean, round(stddev_pop(x), 7) AS sd FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    e = t.embeddings.select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", "dim").agg(r(F.avg(F.col("x").cast("double")), 7).alias("mean"), r(F.stddev_pop(F.col("x").cast("double")), 7).alias("sd"))


@add("w15_interval_totals", "WITH p AS (SELECT DISTINCT case_id, analysis_intervals AS j FROM manifest WHERE analysis_intervals IS NOT NULL), x AS (SELECT case_id, unnest(from_json(j, '[[\"DOUBLE\"]]')) AS v FROM p) SELECT case_id, round(sum(v[2] - v[1]), 9) AS seconds, count(*) AS spans FROM x WHERE v[2] > v[1] GROUP BY 1")
def _(t: Tables) -> DataFrame:
    p = t.manifest.where(F.col("analysis_intervals").isNotNull()).select("case_id", "analysis_intervals").distinct()
    v = p.select("case_id", F.explode(F.from_json("analysis_intervals", "array<array<double>>")).alias("v"))
    return v.where(F.element_at("v", 2) > F.element_at("v", 1)).groupBy("case_id").agg(r(F.sum(F.element_at("v", 2) - F.element_at("v", 1))).alias("seconds"), F.count("*").alias("spans"))


@add("w19_fill_forward", "SELECT event_id, last_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS p FROM events)")
def _(t: Tables) -> DataFrame:
    e = _events(t).withColumn("p", F.when(F.col("event_type") == "purchase", F.col("value")))
    return Q.fill_forward(e, ["user_id"], ["sec", "event_id"], "p", "last_purchase").select("event_id", "last_purchase")


@add("w20_dilate", "SELECT event_id, max(CAST(event_type <> 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS hang FROM events")
def _(t: Tables) -> DataFrame:
    return Q.dilate(_events(t).withColumn("v", F.col("voiced").cast("int")), ["user_id"], ["sec", "event_id"], "v", "hang").select("event_id", "hang")


@add("w21_adaptive_threshold", "SELECT user_id, round(greatest(2.0, quantile_cont(value, 0.2) + 6, quantile_cont(value, 0.9) - 28), 9) AS threshold FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(r(F.greatest(F.lit(2.0), F.percentile("value", 0.2) + 6, F.percentile("value", 0.9) - 28)).alias("threshold"))


@add("w25_ordered_concat", "SELECT state_id, string_agg(k || ':' || metric_id, ' ' ORDER BY k) AS metrics FROM (SELECT state_id, metric_id, row_number() OVER (PARTITION BY state_id ORDER BY metric_id) AS k FROM metric_registry) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Texts of a group in order, each behind its ordinal; a group is bounded by the registry."""
    d = t.metric_registry.groupBy("state_id").agg(F.array_sort(F.collect_list("metric_id")).alias("c"))
    return d.select("state_id", F.array_join(F.transform("c", lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x)), " ").alias("metrics"))


@add(
    "j16_interval_overlap",
    """WITH p AS (SELECT DISTINCT case_id, analysis_intervals AS j, duration_sec AS d FROM manifest WHERE analysis_intervals IS NOT NULL AND duration_sec IS NOT NULL),
a AS (SELECT case_id, v[1] AS s, v[2] AS e FROM (SELECT case_id, unnest(from_json(j, '[["DOUBLE"]]')) AS v FROM p)), w AS (SELECT case_id, unnest(range(0, CAST(ceil(d / 2) AS BIGINT))) AS k FROM p)
SELECT a.case_id, k AS b_id, round(sum(least(e, 2.0 * (k + 1)) - greatest(s, 2.0 * k)), 9) AS seconds FROM a JOIN w ON a.case_id = w.case_id AND least(e, 2.0 * (k + 1)) > greatest(s, 2.0 * k) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    """Seconds of each two-second window that lie in an analysis interval."""
    p = t.manifest.where("analysis_intervals IS NOT NULL AND duration_sec IS NOT NULL").select("case_id", "analysis_intervals", "duration_sec").distinct()
    v = p.select("case_id", F.explode(F.from_json("analysis_intervals", "array<array<double>>")).alias("v"))
    a = v.select("case_id", F.get("v", F.lit(0)).alias("start"), F.get("v", F.lit(1)).alias("end"))
    n = p.select("case_id", F.ceil(F.col("duration_sec") / 2).cast("long").alias("n"))
    return Q.window_cover(a, n, "case_id", 2.0).select("case_id", "b_id", r(F.col("seconds")).alias("seconds"))


@add(
    "j17_nearest",
    f"""WITH l AS (SELECT user_id, event_id, {SEC_SQL} AS sec FROM events WHERE event_type = 'click'), q AS (SELECT user_id, {SEC_SQL} AS sec FROM events WHERE event_type = 'purchase'),
b AS (SELECT l.*, q.sec AS before FROM l ASOF LEFT JOIN q ON l.user_id = q.user_id AND l.sec >= q.sec), a AS (SELECT b.*, q.sec AS after FROM b ASOF LEFT JOIN q ON b.user_id = q.user_id AND b.sec <= q.sec)
SELECT event_id, CASE WHEN after IS NULL OR sec - before < after - sec THEN before ELSE after END AS nearest_at FROM a""",
)
def _(t: Tables) -> DataFrame:
    e = _events(t)
    return Q.nearest(e.where("event_type = 'click'").select("user_id", "event_id", "sec"), e.where("event_type = 'purchase'").select("user_id", "sec", "value"), ["user_id"], "sec", "value").select("event_id", "nearest_at")
