"""Fits against numpy and known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import fit


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    y = x @ [1.5, -2.0] + 3 + rng.normal(size=80) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    b0, w = fit.ridge(df, ["a", "b"], ["y"], alpha=2.0)["y"]
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 2 * np.eye(2), xc.T @ yc)
    assert np.allclose(w, want) and b0 == pytest.approx(y.mean() - want @ x.mean(0))
    left = fit.residuals(df, ["a", "b"], ["y"], {"y": (b0, w)}).agg(F.avg("y")).first()[0]
    assert left == pytest.approx(0, abs=1e-9)
    assert fit.ridge(df, [], ["y"])["y"] == (pytest.approx(y.mean()), [])


def test_logistic_finds_the_generating_weights(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 1.2 * x)))
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x, y, strict=True)] + [(None, True)], "x double, y boolean")
    b, w = fit.logistic(df, [F.col("x")], F.col("y"))
    assert abs(b - 0.5) < 0.15 and abs(w - 1.2) < 0.15
    with pytest.raises(ValueError, match="no row"):
        fit.logistic(df.limit(0), [F.col("x")], F.col("y"))


def test_temperature_of_overconfident_predictions(spark):
    rows = [([0.95, 0.05], 1 if i % 10 < 7 else 2) for i in range(200)]
    df = spark.createDataFrame(rows, "probs array<double>, truth int")
    t = fit.temperature(df)
    assert t == pytest.approx(np.log(19) / np.log(7 / 3), abs=0.02)
    assert fit.temperature(df.limit(0)) == 1.0


def test_selection_and_guard(spark):
    f = spark.createDataFrame([(i, c, o) for i in range(5) for c, o in ((0, 0.1 * (i + 1)), (1, (-1.0) ** i))], "fold int, class int, offset double")
    assert {r["class"]: r.offset for r in fit.stable_offsets(f).collect()} == {0: pytest.approx(0.3), 1: 0.0}
    rows = spark.createDataFrame([(0.0, 0.5, 0.5), (0.1, 0.6, 0.5), (0.5, 0.7, 0.4)], "s double, macro_f1 double, accuracy double")
    assert fit.choose_strength(rows, "s") == 0.1 and fit.choose_strength(rows, "s", gain=0.2) == 0.0
    folds = spark.createDataFrame([(0, 0.5, 0.6), (1, 0.5, 0.4), (2, 0.5, 0.4), (None, 0.5, 0.5)], "fold int, base double, final double")
    assert fit.guard(folds, True).first().dropped and not fit.guard(folds, False).first().dropped


def test_state_support_prefers_the_nearer_prototype(spark):
    v = spark.createDataFrame([("u", "S", 1.9), ("u", "X", 5.0)], "unit string, state string, value double")
    p = spark.createDataFrame([("S", "HC", 0.0, 1.0, 1.0), ("S", "AD", 2.0, 1.0, 1.0)], "state string, label string, center double, scale double, weight double")
    got = {r.label: r.support for r in fit.state_support(v, p, "unit").collect()}
    assert got["AD"] > 0.8 and sum(got.values()) == pytest.approx(1)


def test_multinomial_with_missing_values(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), None if i % 7 == 0 else float(rng.normal()), float(int(x > 0))) for i, x in enumerate(rng.normal(size=150))]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    model = fit.multinomial(df, ["a", "b"], "y")
    out = model.transform(fit.with_indicators(df, ["a", "b"]))
    assert out.where("prediction = y").count() > 140


def test_balanced_weights_refuse_more_labels_than_they_hold(spark):
    with pytest.raises(ValueError, match="10000 labels"):
        fit.balanced_weights(spark.range(10_001), "id")


def test_expected_grid_has_every_name_of_a_long_registry(spark, tmp_path):
    import shutil

    import __spark_entry__

    shutil.copy(f"{__spark_entry__.SMOKE}/metric_evidence.parquet", tmp_path)
    registry = spark.read.parquet(f"{__spark_entry__.SMOKE}/metric_registry.parquet").limit(1).drop("metric_id").crossJoin(spark.range(2100).select(F.format_string("m%d", "id").alias("metric_id")))
    registry.write.parquet(f"{tmp_path}/metric_registry.parquet")
    got = __spark_entry__.queries()["j13_expected_grid"](spark, str(tmp_path))
    assert got.select("metric_id").distinct().count() == 2100


def test_many_logistic_fits_are_each_their_own(spark):
    """Fits of different rows, inputs and ridges in shared passes, against one fit at a time."""
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), bool(rng.random() < 1 / (1 + np.exp(-a))), int(i % 3)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame([*rows, (None, 1.0, True, 0)], "a double, b double, y boolean, f int")
    fits = [fit.Fit([F.col("a"), F.col("b")], F.lit(True)), fit.Fit([F.col("b")], F.col("f") != 1, 0.5), fit.Fit([F.col("a")], F.col("f") == 7)]
    got = fit.logistic_many(df, fits, F.col("y"))
    assert np.allclose(got[0], fit.logistic(df, [F.col("a"), F.col("b")], F.col("y")), atol=1e-8)
    assert np.allclose(got[1], fit.logistic(df.where("f <> 1").na.drop(), [F.col("b")], F.col("y"), l2=0.5), atol=1e-2) and got[2] == [0.0, 0.0]


def test_left_out_scores_do_not_see_their_fold(spark):
    rows = [(float(i % 7), bool((i % 7 > 3) != (i % 3 == 0)), i % 3) for i in range(210)]
    df = spark.createDataFrame(rows, "x double, y boolean, fold int")
    out = fit.left_out(df, {"p": ([F.col("x")], 1e-6)}, F.col("y"), "fold", 3)
    one = fit.logistic(df.where("fold <> 2"), [F.col("x")], F.col("y"))
    for r in out.where("fold = 2").limit(5).collect():
        assert abs(r.p - 1 / (1 + np.exp(-one[0] - one[1] * r.x))) < 1e-8
