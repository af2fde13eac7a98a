"""Components against union-find, and splits that keep groups whole."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import splits


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def components(spark, edges):
    got = {}
    for r in splits.connected_components(spark.createDataFrame(edges, "a string, b string")).collect():
        assert r.node not in [n for g in got.values() for n in g]
        got.setdefault(r.component, set()).add(r.node)
    assert all(min(g) == c for c, g in got.items())
    return {frozenset(g) for g in got.values()}


@pytest.mark.parametrize("seed", [0, 1])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)]
    assert components(spark, edges) == union_find(edges)


def test_a_long_chain_and_a_star(spark):
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"leaf{i}") for i in range(40)]
    assert components(spark, edges) == union_find(edges)


def test_no_edges_nulls_and_loops(spark):
    assert components(spark, []) == set()
    assert components(spark, [("a", "a"), ("a", None), (None, None)]) == set()


def keyed(spark, rows):
    df = spark.createDataFrame(rows, "case_id string, subject_id string, sha string, split string, label string, component_note string")
    return splits.with_component(df, "case_id", [splits.subject_key(F.col("subject_id")), splits.digest_key(F.col("sha"))])


H = ["%064x" % (i + 17) for i in range(5)]


def test_relations_and_placeholders(spark):
    rows = [
        ("1", "Sub-01", H[0], "train", "HC", ""), ("2", "sub 01", None, "test", "HC", ""), ("3", "other", H[0].upper(), None, "AD", ""),
        ("4", "n/a", H[1], "train", None, ""), ("5", "N.A.", H[2], "test", None, ""), ("6", None, "0" * 64, "train", "HC", ""), ("7", "", "0" * 64, "test", "HC", ""),
        ("8", "unknown", "pending", "train", "HC", ""), ("9", "x1", H[3], "train", "HC", ""), ("10", "x2", H[3], "train", "HC", ""), ("11", "?", None, None, None, ""),
    ]
    got = {r.case_id: r.component for r in keyed(spark, rows).collect()}
    assert got["1"] == got["2"] == got["3"] and got["9"] == got["10"]
    assert len(set(got.values())) == len(rows) - 3
    df = keyed(spark, rows)
    assert {r.component for r in splits.leaking_components(df).collect()} == {got["1"]}
    assert keyed(spark, []).count() == 0


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(3)
    rows = [(str(i), f"s{rng.randrange(700)}", None, None, rng.choice(["HC", "AD", None]), "") for i in range(3000)]
    df = keyed(spark, rows).cache()
    out = df.join(splits.assign_splits(df), "component").collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.component, set()).add(r.new_split)
    assert all(len(s) == 1 for s in by.values())
    for label in ("HC", "AD", None):
        own = [r for r in out if r.stratum == label]
        assert abs(sum(r.new_split == "train" for r in own) / len(own) - 0.8) < 0.03
    again = df.join(splits.assign_splits(df.orderBy(F.rand())), "component").collect()
    assert {(r.case_id, r.new_split) for r in again} == {(r.case_id, r.new_split) for r in out}
