"""Nested records of every shape into links and flat tables."""

import json

import pytest

from tallyloom.operators import nested
from tallyloom.operators import shape_automaton as shapes

OBS = {"evidence_id": "e1", "state_id": "S1", "state_z": "0.5", "metric_evidence_ids": ["m1", None, "m2"], "supporting_metrics": [{"metric_id": "a", "value": 1.5}], "counter_evidence": {"metric_id": "b", "value": None}, "evidence_segments": ["s1", {"segment_id": "s2", "start_sec": 1, "end_sec": 2, "text": "t"}]}
WS = {"case_id": "c", "case_context": {"task_scopes": "one"}, "base_probabilities": {"HC": "0.4", "AD": 0.6}, "state_observations": [OBS, None, {"state_id": "S2", "metric_evidence_ids": ["lost"]}], "unknown": [1]}
LINKS = {("c", "c", "task_scope", "one"), ("c", "c", "class", "HC"), ("c", "c", "class", "AD"), ("c", "c", "state", "e1"), ("c", "e1", "metric", "m1"), ("c", "e1", "metric", "m2"), ("c", "e1", "supporting", "a"), ("c", "e1", "counter", "b"), ("c", "e1", "segment", "s1"), ("c", "e1", "segment", "s2")}


def links(spark, payloads):
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "line_no long, payload string, case_id string")
    return {tuple(r) for r in nested.all_links(nested.records_of_lines(df)).collect()}


@pytest.mark.parametrize(
    "payload",
    [
        json.dumps(WS),
        "﻿  " + json.dumps(WS) + " ,\r\n",
        json.dumps(json.dumps(WS)),
        json.dumps({"schema_version": 2, "workspace": WS}),
        json.dumps(WS | {"state_observations": json.dumps(WS["state_observations"])}),
        json.dumps(WS | {"state_observations": OBS}),
        json.dumps([WS]),
        json.dumps(WS | {"state_observations": {"e1": {k: v for k, v in OBS.items() if k != "evidence_id"}}}),
    ],
)
def test_every_shape_gives_the_same_links(spark, payload):
    assert links(spark, [payload, payload]) == LINKS


def test_payloads_without_a_record(spark):
    torn = json.dumps(WS)[:-30]
    assert links(spark, [None, "", "  ", torn, '"' + torn, "[]", "17", "null", '{"a": 1}', "{" * 5000]) == set()
    assert links(spark, []) == set()
    assert links(spark, [json.dumps(WS | {"case_id": None}), json.dumps(WS | {"case_id": " "})]) == set()


def test_flat_tables_keep_parents_and_subtypes(spark):
    df = spark.createDataFrame([(7, json.dumps(WS))], "line_no long, payload string")
    t = nested.flatten(nested.records_of_lines(df))
    assert [tuple(r) for r in t["segment_references"].collect()] == [("line:7", "c", "e1", 0, "s1")]
    assert [tuple(r) for r in t["timed_segments"].collect()] == [("line:7", "c", "e1", 1, "s2", 1.0, 2.0, "t")]
    assert [tuple(r) for r in t["counter"].collect()] == [("line:7", "c", "e1", 0, "b", None)]
    assert [r.state_z for r in t["observations"].collect()] == [0.5]
    assert {(r["class"], r.probability) for r in t["classes"].collect()} == {("HC", 0.4), ("AD", 0.6)}
    assert "metric_evidence_ids:list<text>" in t["observations"].first().variant


def test_states():
    assert shapes.state({"metric_id": "x"}) == "reading"
    assert shapes.state([None, {"segment_id": 1}, "a"]) == "list<segment|text>"
    assert shapes.state("[1, 2") == "torn"
    assert shapes.state({"HC": "0.5", "AD": 1}) == "scores"
    assert shapes.state({"workspace": {"case_id": 1}}) == "envelope"
    assert shapes.parse("x") is None and shapes.parse(None) is None


def test_typed_workspaces_with_nulls(spark):
    obs = "array<struct<evidence_id:string,state_id:string,task_scope:string,state_z:double,confidence:double,missing_fraction:double,report_permission:boolean,metric_evidence_ids:array<string>,supporting_metrics:array<struct<metric_id:string,value:double,description:string>>,counter_evidence:array<struct<metric_id:string,value:double>>,evidence_segments:array<struct<segment_id:string,start_sec:double,end_sec:double,text:string>>>>"
    schema = f"record_id long, case_id string, case_context struct<task_scopes:array<string>>, base_probabilities map<string,double>, state_observations {obs}"
    full = ("e", "S", None, 0.1, None, None, True, ["m", None, "m"], [("a", 1.0, None), None], None, [])
    rows = [(1, "c", None, None, None), (2, "c", (["t", None],), {"HC": None}, [full, None, (None, "S", None, None, None, None, None, ["no"], None, None, None)]), (3, None, (["x"],), None, None)]
    got = {tuple(r) for r in nested.all_links(nested.records_of_workspaces(spark.createDataFrame(rows, schema))).collect()}
    assert got == {("c", "c", "task_scope", "t"), ("c", "c", "class", "HC"), ("c", "c", "state", "e"), ("c", "e", "metric", "m"), ("c", "e", "supporting", "a")}


def test_a_record_and_its_json_give_the_same_parts(spark):
    obs = "array<struct<evidence_id:string,state_id:string,task_scope:string,state_z:double,confidence:double,missing_fraction:double,report_permission:boolean,metric_evidence_ids:array<string>,supporting_metrics:array<struct<metric_id:string,value:double,description:string>>,counter_evidence:array<struct<metric_id:string,value:double>>,evidence_segments:array<struct<segment_id:string,start_sec:double,end_sec:double,text:string>>>>"
    schema = f"record_id long, case_id string, case_context struct<task_scopes:array<string>>, base_probabilities map<string,double>, state_observations {obs}"
    full = ("e", "7", None, 0.1, None, None, True, ["m", None, "12", "m"], [("a", 1.0, "d"), None, ("b", None, None)], [("k", 2.0)], [("s", 1.0, None, None), ("r", None, None, None)])
    rows = [(1, "c", (["t", None, "u"],), {"HC": 0.25, "AD": 0.75}, [full, None, ("f", None, None, None, None, None, None, [], [None], None, None)]), (2, "12", None, {}, [])]
    typed = spark.createDataFrame(rows, schema)
    lines = typed.selectExpr("record_id AS line_no", "to_json(struct(case_id, case_context, base_probabilities, state_observations)) AS payload")
    columns = [c for c in nested.records_of_lines(lines).columns if c not in ("record_key", "extra")]
    get = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert get(nested.records_of_workspaces(typed)) == get(nested.records_of_lines(lines))


def test_deep_records_are_walked_without_recursion(spark):
    deep = '{"a":' * 3000 + json.dumps(WS) + "}" * 3000
    deeper = '{"workspace": ' + json.dumps(WS | {"state_observations": [OBS | {"more": 1}]})[:-1] + ', "x": ' + "[" * 5000 + "]" * 5000 + "}}"
    assert shapes.Tree(json.loads("[" * 2000 + "]" * 2000)).root is not None
    assert links(spark, [deep]) == LINKS
    assert links(spark, [deeper]) == LINKS


def test_routed_tables_hold_what_links_are_made_of(spark, monkeypatch):
    df = spark.createDataFrame([(7, json.dumps(WS))], "line_no long, payload string")
    records = nested.records_of_lines(df)
    t = nested.route(records)
    assert {k: x.count() for k, x in t.items()} == {"case": 1, "task_scope": 1, "class": 2, "observation": 1, "evidence_reference": 2, "valued_reading": 1, "bare_reading": 1, "timed_segment": 1, "segment_reference": 1}
    assert [(r.child_id, r.value) for r in t["valued_reading"].collect()] == [("a", 1.5)] and "start_sec" not in t["bare_reading"].columns
    original = nested.route
    monkeypatch.setattr(nested, "route", lambda *a: {k: x.limit(0) for k, x in original(*a).items()})
    assert nested.all_links(records).count() == 0


def test_fields_of_a_variant_that_no_subtype_has_are_kept(spark):
    ws = {"case_id": "c", "reviewer": "x", "state_observations": [{"evidence_id": "e", "state_id": "S", "reviewed": True, "by": {"name": "y"}, "supporting_metrics": [{"metric_id": "a", "unit": "Hz"}]}]}
    df = spark.createDataFrame([(1, json.dumps(ws))], "line_no long, payload string")
    got = {(r.child_kind, r.child_id, r.field, r.content) for r in nested.flatten(nested.records_of_lines(df))["extra_fields"].collect()}
    assert got == {("case", "c", "reviewer", "x"), ("state", "e", "reviewed", "true"), ("state", "e", "by", '{"name": "y"}'), ("supporting", "a", "unit", "Hz")}


def test_rules_look_at_children():
    assert shapes.state({"case_id": {"id": 1}}) == "keyed" and shapes.state({"case_id": 5}) == "workspace"
    assert shapes.state({"start_sec": 1, "end_sec": "2"}) == "segment" and shapes.state({"start_sec": [1], "end_sec": 2}) == "other"
    assert shapes.state({"e1": {"state_id": 1}, "e2": {"state_id": 2}}) == "keyed"
    assert shapes.state([[{"case_id": 1}]]) == "list<list<workspace>>" and shapes.state({"a": [[{"case_id": 1}]]}) == "envelope"
