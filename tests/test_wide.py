"""The wide table against a brute-force version, and its stated cases."""

import math
import random

import pytest

from tallyloom.operators import wide

SCHEMA = "subject_id string, task_scope string, metric_id string, value double, extra string"


def registry(spark):
    return spark.createDataFrame([("word_count", "bigint"), ("ttr", "double"), ("flag_set", "boolean")], "metric_id string, value_type string")


def brute(rows):
    cells = {}
    names = {"wordcount": "word_count", "ttr": "ttr", "flagset": "flag_set"}
    for s, t, m, v, _ in rows:
        k = names.get("".join(c for c in (m or "").lower().replace("metric:", "") if c.isalnum()))
        if s and s.strip() and k and v is not None and math.isfinite(v):
            cells.setdefault((s, t, k), []).append(v)
    fit = {"word_count": lambda v: v == int(v), "flag_set": lambda v: v in (0, 1), "ttr": lambda v: True}
    open_ = {c for c, vs in cells.items() if max(vs) - min(vs) > 1e-6 or not all(map(fit[c[2]], vs))}
    return cells, open_


def test_against_brute_force(spark):
    rng = random.Random(1)
    names = ["word_count", "Word Count", "metric:ttr", "TTR", "flagSet", "flag_set", "unknown_one", None]
    rows = [(rng.choice(["a", "b", "c", "d", "", " ", None]), rng.choice(["x", "y", None]), rng.choice(names), rng.choice([0.0, 1.0, 2.0, 2.5, None, float("nan"), float("inf")]), "z") for _ in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    w = wide.widen(df, registry(spark), tables=2)
    assert [f.dataType.typeName() for f in w.select("flag_set", "ttr", "word_count").schema] == ["boolean", "double", "long"]
    cells, open_ = brute(rows)
    assert {tuple(r) for r in wide.unfilled_cells(w).collect()} == open_
    assert {tuple(r) for r in wide.melt(w).collect()} == {(*c, min(vs)) for c, vs in cells.items() if c not in open_}
    assert w.count() == len({c[:2] for c in cells})


def test_no_rows_and_all_null(spark):
    for rows in ([], [(None, None, None, None, None)], [("", "x", "ttr", 1.0, "e")]):
        w = wide.widen(spark.createDataFrame(rows, SCHEMA), registry(spark))
        assert w.columns == ["subject_id", "task_scope", "flag_set", "ttr", "word_count", "unfilled"] and w.count() == 0


def test_one_signature_has_a_dense_table(spark):
    rows = [(f"s{i}", "x", m, float(i % 2), "e") for i in range(20) for m in ("ttr", "flag_set")]
    w = wide.widen(spark.createDataFrame(rows, SCHEMA), registry(spark), tables=1)
    assert w.where("word_count is null and ttr is not null and flag_set is not null").count() == 20


def test_repeated_rows_and_extra_columns(spark):
    rows = [("s", "x", "ttr", 0.5, "e")] * 5 + [("s", "x", "TTR", 0.5 + 5e-7, "f")]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("extra", "unfilled")
    assert wide.widen(df, registry(spark)).select("ttr", "unfilled").collect()[0] == (0.5, [])


def test_clashing_attribute_name(spark):
    reg = spark.createDataFrame([("task_scope", "double")], "metric_id string, value_type string")
    w = wide.widen(spark.createDataFrame([("s", "x", "task_scope", 1.0, "")], SCHEMA), reg)
    assert w.first().task_scope_value == 1.0


def test_registry_is_checked(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError, match="two types"):
        wide.widen(df, spark.createDataFrame([("a", "double"), ("a", "bigint")], "metric_id string, value_type string"))
    with pytest.raises(ValueError, match="no known type"):
        wide.widen(df, spark.createDataFrame([("a", "text")], "metric_id string, value_type string"))


def test_layout_merges_what_adds_fewest_empty_cells():
    sets = [((0, 1), 50), ((0, 1, 2), 50), ((7, 8), 40), ((7, 8, 9), 40), ((3, 4, 5), 1)]
    # {3, 4, 5} goes to the whole set for 7 cells, {7, 8} to {7, 8, 9} for 40; {0, 1} would cost 50.
    assert wide.layout(sets, 10, 4) == [[0, 1], [0, 1, 2], [7, 8, 9], list(range(10))]
    assert wide.layout(sets, 10, 1) == [list(range(10))] == wide.layout([], 10, 6)
    rng = random.Random(3)
    many = [(sorted(rng.sample(range(10), rng.randrange(1, 9))), rng.randrange(1, 9)) for _ in range(300)]
    got = wide.layout(many, 10, 6)
    assert len(got) <= 6 and got[-1] == list(range(10)) and all(any(set(s) <= set(g) for g in got) for s, _ in many)


def test_many_attributes_and_every_table(spark):
    """70 attributes take two words of a signature; every entity lies in one table and keeps its cells."""
    rng = random.Random(9)
    names = [f"m{i:02d}" for i in range(70)]
    reg = spark.createDataFrame([(n, "double") for n in names], "metric_id string, value_type string")
    groups = [names[:5], names[60:], names[30:64]]
    rows = [(f"s{i}", "x", n, float(rng.randrange(9)), "e") for i in range(60) for n in (groups[i % 3] if i < 50 else rng.sample(names, 40))]
    df = spark.createDataFrame(rows, SCHEMA)
    w = wide.widen(df, reg, tables=4)
    assert w.columns == ["subject_id", "task_scope", *names, "unfilled"] and w.count() == 60
    assert {tuple(r) for r in wide.melt(w).collect()} == {r[:4] for r in rows}
    shares = {r.attributes: r for r in wide.table_shares(df, reg, tables=4).collect()}
    assert sum(r.entities for r in shares.values()) == 60 and sum(r.cells for r in shares.values()) == len(rows)
    assert {5, 10, 34, 70} == set(shares) and shares[5].empty_share == shares[34].empty_share == 0


def test_blank_subjects_of_any_white_space(spark):
    df = spark.createDataFrame([("\t ", "x", "ttr", 1.0, "e"), (" s\t", "x", "ttr", 1.0, "e")], SCHEMA)
    assert [r.subject_id for r in wide.widen(df, registry(spark)).collect()] == [" s\t"]
