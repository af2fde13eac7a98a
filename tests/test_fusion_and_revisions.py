"""Blends of predictions against plain arithmetic, and revisions that apply whole or not at all."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import fusion as U
from tallyloom.operators import constraints as C
from tallyloom.operators import revise

KINDS = "id int, frozen array<double>, before array<double>, after array<double>, scores array<int>, channel string"


def fuse(spark, rows, **config):
    return {r.id: r for r in U.joint_authority(spark.createDataFrame(rows, KINDS), U.Authority(**config)).collect()}


def test_nothing_counts_leaves_the_frozen_vector(spark):
    """Zero strengths, an unchanged state with even scores, a report-only channel and agreement all give the input back, bit for bit."""
    p, q = [0.1 + 0.2, 0.4, 0.3], [0.2, 0.5, 0.3]
    rows = [(1, p, p, q, [0, 4, 1], "clinic"), (2, p, p, p, [2, 2, 2], None), (3, p, p, q, [4, 0, 1], " PUBLIC_SPEECH")]
    for r in fuse(spark, rows[:1]).values():
        assert r.fused == p and r.parity
    got = fuse(spark, rows, state=1.0, scores=1.0, staging=1.0, gated=False)
    assert not got[1].parity and got[2].fused == p and got[3].fused == p and got[2].parity and got[3].parity


def test_log_linear_arithmetic(spark):
    frozen, before, after = [0.2, 0.5, 0.3], [0.6, 0.3, 0.1], [0.3, 0.4, 0.3]
    got = fuse(spark, [(1, frozen, before, after, [3, 1, 4], "x")], state=0.5, scores=0.4, staging=0.3, bound=5.0, temperature=2.0, gated=False)[1]
    shift = math.log(0.7 / 0.3) - math.log(0.4 / 0.6)
    lead, step = 4 - 3, 4 - 1
    z = np.log(frozen) + 0.5 * shift * np.array([-2, 1, 1]) / 3 + 0.4 * lead / 2.0 * np.array([-2, 1, 1]) / 3 + 0.3 * step / 2.0 * np.array([0, -0.5, 0.5])
    assert np.allclose(got.fused, np.exp(z) / np.exp(z).sum()) and (got.state_gate, got.score_gate, got.staging_gate) == (1.0, 1.0, 1.0)


def test_gates_ask_for_doubt_and_counterevidence(spark):
    sure, unsure = [0.97, 0.02, 0.01], [0.55, 0.27, 0.18]
    worse = [0.1, 0.5, 0.4]
    rows = [(1, sure, sure, worse, [0, 1, 1], "x"), (2, unsure, unsure, worse, [0, 2, 2], "x"), (3, unsure, unsure, worse, [4, 0, 0], "x"), (4, sure, sure, sure, [0, 4, 0], "x"), (5, sure, sure, sure, [0, 2, 0], "x")]
    got = fuse(spark, rows, state=1.0, scores=1.0)
    # A sure prediction is not moved by a state; by scores only where their margin is large.
    assert got[1].state_gate == 0 and got[1].score_gate == 0 and got[4].score_gate == 1.0 and got[5].score_gate == 0
    # An unsure one is, unless the scores point the other way.
    assert got[2].state_gate == 1 and got[2].score_gate == 0 and got[3].state_gate == 0 and got[3].conflict


def test_pools(spark):
    df = spark.createDataFrame([([0.5, 0.3, 0.2], [1 / 3] * 3, 2.0), ([0.0, 0.0, 1.0], [0.2, 0.2, 0.6], 1.0)], "p array<double>, l array<double>, b double")
    rows = df.select("p", U.hierarchical_pool(F.col("p"), F.col("l"), F.col("b"), 0, 3).alias("h"), U.two_stage_pool(F.col("p"), F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.0), F.lit(0.0)), F.col("b"), F.col("b")).alias("t")).collect()
    assert np.allclose(rows[0].h, rows[0].p) and np.allclose(rows[0].t, rows[0].p)
    assert all(abs(sum(x) - 1) < 1e-12 for r in rows for x in (r.h, r.t))


def test_batches_apply_whole_or_not_at_all(spark):
    base = spark.createDataFrame([(b, k, f"{b}{k}", 0.8) for b in ("ok", "stale", "odd", "clash", "none") for k in ("x", "y")], "batch string, key string, guard string, weight double")
    revisions = [
        ("ok", "x", "downweight", 0.5, "okx"), ("ok", "x", "downweight", 0.5, "okx"), ("ok", "y", "unavailable", 0.0, "oky"), ("stale", "x", "downweight", 0.5, "stalex"), ("stale", "y", "downweight", 0.5, "old"),
        ("odd", "x", "erase", 0.5, "oddx"), ("clash", "x", "downweight", 0.5, "clashx"), ("clash", "x", "invalidate", 0.0, "clashx"), ("gone", "z", "downweight", 0.5, "q"),
    ]
    plan = revise.compiled(spark.createDataFrame(revisions, "batch string, key string, action string, factor double, guard string"), "batch", "key", "action", "guard")
    got = {(r.batch, r.key): (r.action, r.weight, r.status) for r in revise.applied(base, plan, "batch", "key", "guard", "weight").collect()}
    assert got[("ok", "x")] == ("downweight", 0.4, "applied") and got[("ok", "y")] == ("unavailable", 0.0, "applied")
    assert all(got[b, k] == ("kept", 0.8, "rejected") for b in ("stale", "odd", "clash") for k in "xy")
    assert got[("none", "x")] == ("kept", 0.8, "untouched") and len(got) == 10
    none = revise.applied(base, plan.limit(0), "batch", "key", "guard", "weight").collect()
    assert {r.status for r in none} == {"untouched"}


def test_pivot_of_repeated_cells_raises(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", None), ("b", "z", 9)], "k string, c string, v int")
    assert {tuple(r) for r in C.pivot_unique(df, ["k"], "c", ["x", "y"], "v", "c_").collect()} == {("a", 1, 2), ("b", None, None)}
    with pytest.raises(Exception, match="two rows for c x"):
        C.pivot_unique(df.union(df), ["k"], "c", ["x"], "v").collect()
