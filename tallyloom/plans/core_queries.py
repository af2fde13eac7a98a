"""Queries of the two general training-data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.operators import nested, wide
from tallyloom.sources.tables import table


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.widen(table(spark, d, "metric_evidence"), table(spark, d, "metric_registry"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.unfilled_cells(_wide(spark, d))


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d)


def p1_wide_cells(spark: SparkSession, d: str) -> DataFrame:
    return wide.melt(_wide(spark, d))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return nested.records_of_workspaces(table(spark, d, "synthetic_workspace")).unionByName(nested.records_of_lines(table(spark, d, "workspace_lines")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.all_links(_records(spark, d))


def _p6(name: str):
    return lambda spark, d: nested.flatten(_records(spark, d))[name]


def _p6_typed(name: str):
    return lambda spark, d: nested.flatten(nested.records_of_workspaces(table(spark, d, "synthetic_workspace")))[name]


def p6_workspace_links(spark: SparkSession, d: str) -> DataFrame:
    return nested.all_links(nested.records_of_workspaces(table(spark, d, "synthetic_workspace")))


_TYPED = ("task_scopes", "classes", "observations", "metric_ids", "supporting", "counter", "timed_segments")

QUERIES = {
    "p6_workspace_links": p6_workspace_links,
    **{f"p6_workspace_{n}": _p6_typed(n) for n in _TYPED},
    "p1_found": p1_found,
    "p1_wide": p1_wide,
    "p1_wide_cells": p1_wide_cells,
    "p6_found": p6_found,
    **{f"p6_{n}": _p6(n) for n in ("cases", "task_scopes", "classes", "observations", "metric_ids", "supporting", "counter", "timed_segments", "segment_references", "extra_fields")},
}

_CELLS = r"""
WITH k AS (
  SELECT metric_id, value_type, lower(regexp_replace(metric_id, '[^\pL\pN]', '', 'g')) AS key FROM metric_registry
), c AS (
  SELECT e.subject_id, e.task_scope, k.metric_id, k.value_type, min(e.value) AS lo, max(e.value) AS hi,
         bool_or(CASE k.value_type WHEN 'bigint' THEN e.value <> round(e.value) WHEN 'boolean' THEN e.value NOT IN (0, 1) ELSE false END) AS misfit
  FROM metric_evidence e JOIN k
    ON lower(regexp_replace(regexp_replace(lower(trim(e.metric_id)), '^\s*metric\s*:', ''), '[^\pL\pN]', '', 'g')) = k.key
  WHERE trim(e.subject_id) <> '' AND isfinite(e.value)
  GROUP BY ALL
)
"""

#: The registry's metrics by type, for the SQL of the wide table. Fixed values.
_METRICS = {
    "bigint": "interviewer_turn_count patient_turn_count word_count",
    "boolean": "role_filter_applied transcript_truncated",
    "double": "content_word_ratio f0_median_hz filler_rate_100w lexical_mattr50 lexical_ttr long_pause_rate_min mean_utterance_words pause_mean_sec pause_p90_sec picture_information_density pronoun_ratio repair_rate_100w rms_db_mean silence_fraction spectral_centroid_mean speech_rate_wpm speech_run_cv speech_run_mean_sec voiced_fraction",
}
_OPEN = "(hi - lo > 0.000001 OR misfit)"
_WIDE = ", ".join(
    f"max(CASE WHEN metric_id = '{m}' AND NOT {_OPEN} THEN {'CAST(lo AS INT)' if kind == 'boolean' else f'CAST(lo AS {kind})'} END)" + (" = 1" if kind == "boolean" else "") + f" AS {m}"
    for kind, names in _METRICS.items() for m in names.split()
)

ORACLES = {
    "p1_wide": _CELLS + f"SELECT subject_id, task_scope, {_WIDE}, coalesce(list_sort(list(metric_id) FILTER ({_OPEN})), []) AS unfilled FROM c GROUP BY ALL",
    "p1_found": _CELLS + "SELECT subject_id, task_scope, metric_id FROM c WHERE hi - lo > 0.000001 OR misfit",
    "p1_wide_cells": _CELLS + "SELECT subject_id, task_scope, metric_id, lo AS value FROM c WHERE NOT (hi - lo > 0.000001 OR misfit)",
}

# The tables of synthetic_workspace alone; the shapes of workspace_lines are beyond SQL.
_W = """WITH w AS (SELECT 'record:' || record_id AS record_key, * FROM synthetic_workspace WHERE trim(case_id) <> ''),
s AS (SELECT record_key, case_id, unnest(case_context.task_scopes) AS task_scope, generate_subscripts(case_context.task_scopes, 1)::INT - 1 AS ordinal FROM w),
c AS (SELECT record_key, case_id, unnest(map_entries(base_probabilities)) AS e FROM w),
q AS (SELECT record_key, case_id, unnest(state_observations) AS o, generate_subscripts(state_observations, 1)::INT - 1 AS ordinal FROM w),
o AS (SELECT * FROM q WHERE trim(o.evidence_id) <> ''),
m AS (SELECT record_key, case_id, o.evidence_id AS parent_id, unnest(o.metric_evidence_ids) AS id, generate_subscripts(o.metric_evidence_ids, 1)::INT - 1 AS ordinal FROM o),
p AS (SELECT record_key, case_id, o.evidence_id AS parent_id, unnest(o.supporting_metrics) AS r, generate_subscripts(o.supporting_metrics, 1)::INT - 1 AS ordinal FROM o),
n AS (SELECT record_key, case_id, o.evidence_id AS parent_id, unnest(o.counter_evidence) AS r, generate_subscripts(o.counter_evidence, 1)::INT - 1 AS ordinal FROM o),
g AS (SELECT record_key, case_id, o.evidence_id AS parent_id, unnest(o.evidence_segments) AS r, generate_subscripts(o.evidence_segments, 1)::INT - 1 AS ordinal FROM o)
"""
_TIMED = "(r.start_sec IS NOT NULL OR r.end_sec IS NOT NULL OR trim(r.text) <> '')"
_VALUE = "CASE WHEN isfinite(r.value) THEN r.value END AS value"

ORACLES |= {
    "p6_workspace_links": _W + """SELECT DISTINCT case_id, parent_id, child_kind, child_id FROM (
SELECT case_id, case_id AS parent_id, 'task_scope' AS child_kind, task_scope AS child_id FROM s
UNION ALL SELECT case_id, case_id, 'class', e.key FROM c UNION ALL SELECT case_id, case_id, 'state', o.evidence_id FROM o
UNION ALL SELECT case_id, parent_id, 'metric', id FROM m UNION ALL SELECT case_id, parent_id, 'supporting', r.metric_id FROM p
UNION ALL SELECT case_id, parent_id, 'counter', r.metric_id FROM n UNION ALL SELECT case_id, parent_id, 'segment', r.segment_id FROM g) WHERE trim(child_id) <> ''""",
    "p6_workspace_task_scopes": _W + "SELECT record_key, case_id, ordinal, task_scope FROM s WHERE trim(task_scope) <> ''",
    "p6_workspace_classes": _W + "SELECT record_key, case_id, e.key AS class, e.value AS probability FROM c WHERE trim(e.key) <> ''",
    # Every state of this table is its fields' own type, so a variant is what is not null in it.
    "p6_workspace_observations": _W + r"""SELECT record_key, case_id, ordinal, o.evidence_id AS evidence_id, o.state_id AS state_id, o.task_scope AS task_scope, o.state_z AS state_z, o.confidence AS confidence,
o.missing_fraction AS missing_fraction, o.report_permission AS report_permission,
concat_ws(',',
 CASE WHEN o.confidence IS NOT NULL THEN 'confidence:number' END,
 CASE WHEN o.counter_evidence IS NOT NULL THEN 'counter_evidence:list<' || CASE WHEN len(list_filter(o.counter_evidence, lambda x: x IS NOT NULL)) > 0 THEN 'reading' ELSE '' END || '>' END,
 'evidence_id:' || CASE WHEN regexp_full_match(o.evidence_id, '\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*') THEN 'numeric_text' ELSE 'text' END,
 CASE WHEN o.evidence_segments IS NOT NULL THEN 'evidence_segments:list<' || CASE WHEN len(list_filter(o.evidence_segments, lambda x: x IS NOT NULL)) > 0 THEN 'segment' ELSE '' END || '>' END,
 CASE WHEN o.metric_evidence_ids IS NOT NULL THEN 'metric_evidence_ids:list<' || array_to_string(list_sort(list_distinct(list_transform(list_filter(o.metric_evidence_ids, lambda x: x IS NOT NULL), lambda x: CASE WHEN regexp_full_match(x, '\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*') THEN 'numeric_text' ELSE 'text' END))), '|') || '>' END,
 CASE WHEN o.missing_fraction IS NOT NULL THEN 'missing_fraction:number' END,
 CASE WHEN o.report_permission IS NOT NULL THEN 'report_permission:flag' END,
 'state_id:' || CASE WHEN regexp_full_match(o.state_id, '\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*') THEN 'numeric_text' WHEN o.state_id IS NOT NULL THEN 'text' END,
 CASE WHEN o.state_z IS NOT NULL THEN 'state_z:number' END,
 CASE WHEN o.supporting_metrics IS NOT NULL THEN 'supporting_metrics:list<' || CASE WHEN len(list_filter(o.supporting_metrics, lambda x: x IS NOT NULL)) > 0 THEN 'reading' ELSE '' END || '>' END,
 'task_scope:' || CASE WHEN regexp_full_match(o.task_scope, '\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*') THEN 'numeric_text' WHEN o.task_scope IS NOT NULL THEN 'text' END
) AS variant FROM o""",
    "p6_workspace_metric_ids": _W + "SELECT record_key, case_id, parent_id, ordinal, id AS metric_evidence_id FROM m WHERE trim(id) <> ''",
    "p6_workspace_supporting": _W + f"SELECT record_key, case_id, parent_id, ordinal, r.metric_id AS metric_id, {_VALUE}, CASE WHEN trim(r.description) <> '' THEN r.description END AS description FROM p WHERE trim(r.metric_id) <> ''",
    "p6_workspace_counter": _W + f"SELECT record_key, case_id, parent_id, ordinal, r.metric_id AS metric_id, {_VALUE} FROM n WHERE trim(r.metric_id) <> ''",
    "p6_workspace_timed_segments": _W + f"SELECT record_key, case_id, parent_id, ordinal, r.segment_id AS segment_id, r.start_sec AS start_sec, r.end_sec AS end_sec, CASE WHEN trim(r.text) <> '' THEN r.text END AS text FROM g WHERE trim(r.segment_id) <> '' AND {_TIMED}",
}
