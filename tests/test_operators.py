"""Core operators on tiny frames: order, duplicates, nulls and fail-closed checks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import parse
from tallyloom.functions import text as T
from tallyloom.functions import vectors as V
from tallyloom.operators import constraints as C
from tallyloom.operators import evaluate as E
from tallyloom.operators import research as S
from tallyloom.operators import robust as R
from tallyloom.operators import sequence as Q
from tallyloom.operators.skew import hot_split_join
from tallyloom.plans import sequences as SEQ


def one(spark, column, value, kind):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_constant_reference_is_not_available(spark):
    df = spark.createDataFrame([("a", 0.0)] * 4 + [("b", None)], "k string, v double")
    got = {r.k: (r.n, r["median"], r.scale, r.available) for r in R.robust_reference(df, ["k"], "v").collect()}
    assert got == {"a": (4, 0.0, 1.0, False)} or got == {"a": (4, 0.0, 1.0, False), "b": (0, 0.0, 1.0, False)}


def test_reference_against_numpy(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=101)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("a", float("nan")), ("a", float("inf"))], "k string, v double")
    r = R.robust_reference(df, ["k"], "v").first()
    mad = np.median(np.abs(v - np.median(v)))
    assert math.isclose(r["median"], np.median(v)) and math.isclose(r.scale, max(1.4826 * mad, 0.25 * v.std())) and r.n == 101


def test_huber_ignores_an_outlier_and_order():
    v, w = np.array([1.0, 1.1, 0.9, 1.0, 50.0]), np.ones(5)
    assert abs(R.huber_location(v, w) - 1.0) < 0.5
    assert R.huber_location(v, w) == R.huber_location(v[::-1], w[::-1])
    assert R.huber_location(np.array([]), np.array([])) == 0.0


def test_large_groups_are_solved_by_passes(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(["big", "small", None][0 if i < 400 else 1 + i % 2], float(v), float(w)) for i, (v, w) in enumerate(zip(rng.normal(size=420) * 3, rng.random(420) + 0.1, strict=True))]
    df = spark.createDataFrame(rows + [("big", None, 1.0), ("big", 9.0, 0.0)], "k string, v double, w double")
    one = {r.k: r.location for r in R.huber_by_group(df, ["k"], "v", "w").collect()}
    monkeypatch.setattr(R, "MOST_VALUES", 50)
    two = {r.k: r.location for r in R.huber_by_group(df, ["k"], "v", "w", steps=60).collect()}
    assert set(one) == set(two) == {"big", "small", None} and all(two[k] == pytest.approx(one[k], abs=1e-6) for k in one)


def test_repeating_a_correlated_metric_changes_nothing(spark):
    families = spark.createDataFrame([("S", "f", "a", 1.0, 1.0), ("S", "f", "b", 1.0, 1.0)], "state_id string, family_id string, metric_id string, weight double, budget double")
    rows = [("u", "a", 2.0, 0.8), ("u", "b", 2.0, 0.8)]
    kinds = "unit string, metric_id string, z double, reliability double"
    for extra in ([], [("u", "a", 2.0, 0.8)] * 3):
        r = R.family_scores(spark.createDataFrame(rows + extra, kinds), families, ["unit"]).first()
        assert (round(r.state_z, 9), round(r.confidence, 9), r.available) == (2.0, 0.8, True)


def test_runs_and_ranks(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate("xxyyyxz")], "k string, i int, s string")
    assert [(r.s, r.n) for r in Q.runs(df, ["k"], ["i"], "s").orderBy("run_no").collect()] == [("x", 2), ("y", 3), ("x", 1), ("z", 1)]
    ranks = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 3.0)], "k int, v double").select(Q.average_rank(["k"], "v").alias("r"))
    assert sorted(r.r for r in ranks.collect()) == [1.5, 1.5, 3.0]


@pytest.mark.parametrize(("n", "want"), [(0, []), (5, [0]), (10, [0]), (14, [0, 4]), (15, [0, 4, 5]), (None, [])])
def test_sliding_starts(spark, n, want):
    got = spark.createDataFrame([(n,)], "n long").select(F.coalesce(Q.sliding_starts(F.col("n"), 10, 4), F.array().cast("array<bigint>")).alias("s")).first().s
    assert got == want


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(4)
    mk = lambda n: [("k", i, s := rng.random() * 20, s + rng.random() * 5) for i in range(n)]
    a, b = mk(30), mk(40)
    kinds = "key string, id int, start double, end double"
    got = {(r.a_id, r.b_id) for r in Q.overlaps(spark.createDataFrame(a, kinds), spark.createDataFrame(b, kinds), "key", 2.0).collect()}
    assert got == {(x[1], y[1]) for x in a for y in b if min(x[3], y[3]) > max(x[2], y[2])}
    assert Q.overlaps(spark.createDataFrame(a, kinds), spark.createDataFrame(b, kinds), "key", 2.0).count() == len(got)


def test_nearest_ties_go_to_the_later(spark):
    left = spark.createDataFrame([("k", 5.0), ("k", 0.0), ("z", 1.0)], "k string, t double")
    right = spark.createDataFrame([("k", 4.0, 1.0), ("k", 6.0, 2.0)], "k string, t double, v double")
    got = {(r.k, r.t): r.nearest_at for r in Q.nearest(left, right, ["k"], "t", "v").collect()}
    assert got == {("k", 5.0): 6.0, ("k", 0.0): 4.0, ("z", 1.0): None}


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    assert [tuple(r) for r in C.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    assert {tuple(r) for r in C.outside_domain(df, "v", ["a"]).collect()} == {("b", 1), (None, 1)}
    assert [r.k for r in C.not_constant(df, ["k"], "v").collect()] == [1]
    with pytest.raises(ValueError, match="missing columns"):
        C.require_columns(df, ["q"])
    with pytest.raises(Exception, match="repeats a key"):
        C.checked_join(df, df.withColumnRenamed("v", "w"), ["k"]).collect()
    other = spark.createDataFrame([(None, 1), (1, 2)], "k int, w int")
    assert {tuple(r) for r in C.null_safe(spark.createDataFrame([(None, "n"), (1, "o")], "k int, v string"), other, ["k"]).collect()} == {(None, "n", 1), (1, "o", 2)}


def test_hot_split_join_is_a_join(spark, monkeypatch):
    import tallyloom.operators.skew as skew

    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    left = spark.createDataFrame([("hot", i) for i in range(90)] + [("cold", 1), (None, 2), ("alone", 3)], "k string, i int")
    right = spark.createDataFrame([("hot", 1.0), ("cold", 2.0)], "k string, v double")
    for how in ("inner", "left"):
        key = lambda df: sorted(map(str, df.select("k", "i", "v").collect()))
        assert key(hot_split_join(left, right, "k", how)) == key(left.join(right, "k", how))


def test_flags(spark):
    assert [one(spark, parse.flag_yes, v, "string") for v in ("Y", "1.0", None, " true ")] == [True, False, False, True]
    assert [one(spark, parse.flag_true, v, "string") for v in ("Y", "yes")] == [False, True]
    assert [one(spark, lambda x: parse.flag_mapped(x, True), v, "string") for v in ("0.0", "y", "1.0")] == [False, True, True]
    with pytest.raises(Exception, match="is no boolean"):
        one(spark, lambda x: parse.flag_strict(x, "f"), "maybe", "string")
    assert [one(spark, parse.number, v, "string") for v in ("1.5", "x", None, "NaN", "Infinity")] == [1.5, None, None, None, None]
    assert one(spark, parse.json_strings, '["a", "b"]', "string") == ["a", "b"] and one(spark, parse.json_strings, "[torn", "string") in ([], [None])


def test_text_functions(spark):
    assert one(spark, T.slug, "  The Cookie-Theft! ", "string") == "the_cookie_theft"
    assert one(spark, T.words, "Don't stop; l'été 3 x2", "string") == ["don't", "stop", "l'été", "x"]
    assert one(spark, T.canonical_language, "zh_CN", "string") == "zh" and one(spark, T.canonical_language, None, "string") == "unknown"
    assert one(spark, T.repair_mojibake, "mÃ©dico", "string") == "médico" and one(spark, T.repair_mojibake, "médico", "string") == "médico"
    assert one(spark, lambda x: T.mattr(T.words(x), 3), "a b a b c", "string") == pytest.approx((2 + 2 + 3) / 9)
    assert one(spark, lambda x: T.mtld(T.words(x)), "a b c", "string") is None
    assert one(spark, lambda x: T.redact(x, "doctor"), "I saw. The doctor came. We left.", "string") == "I saw. [redacted] We left."


def test_vectors(spark):
    close = lambda a, b: all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(a, b, strict=True))
    assert close(one(spark, V.normalise, [1.0, -3.0, 3.0], "array<double>"), [0.25, 0, 0.75])
    assert close(one(spark, V.normalise, [0.0, None], "array<double>"), [0.5, 0.5])
    assert one(spark, V.argmax, [0.4, 0.4, 0.2], "array<double>") == 1
    assert [one(spark, V.is_simplex, v, "array<double>") for v in ([0.5, 0.5], [0.5, 0.6], None, [1.0, None])] == [True, False, False, False]
    got = one(spark, lambda p: V.capped_weights(p, 0.4, 3), [0.7, 0.2, 0.1], "array<double>")
    assert math.isclose(sum(got), 1) and max(got) <= 0.4 + 1e-9 and close(got, [0.4, 0.4, 0.2])
    assert one(spark, lambda p: V.temperature(p, 1.0), [0.3, 0.7], "array<double>") == pytest.approx([0.3, 0.7])


def test_auroc_against_pairs(spark):
    rng = random.Random(5)
    rows = [("g", round(rng.random(), 1), rng.random() < 0.4) for _ in range(200)]
    got = E.auroc(spark.createDataFrame(rows, "g string, s double, p boolean"), ["g"], "s", "p").first().auroc
    pos, neg = [s for _, s, p in rows if p], [s for _, s, p in rows if not p]
    assert got == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))


def test_mcnemar(spark):
    df = spark.createDataFrame([(True, False)] * 2 + [(True, True)], "a boolean, b boolean")
    r = E.mcnemar(df, [], "a", "b").first()
    assert (r.only_a, r.only_b) == (2, 0) and r.p_value == pytest.approx(0.5)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, 0.03), ("f", 4, None)], "f string, i int, p double")
    got = {r.i: r.q_value for r in S.benjamini_hochberg(df, ["f"], "p", "i").collect()}
    assert got[1] == pytest.approx(0.03) and got[2] == pytest.approx(0.04) and got[3] == pytest.approx(0.04) and got[4] is None


def test_spearman_of_complements(spark):
    rows = [("u", f"s{i}", m, v) for i in range(25) for m, v in (("x", i / 24), ("y", 1 - i / 24))]
    df = spark.createDataFrame(rows, "g string, s string, m string, v double")
    assert S.spearman(df, ["g"], "s", "m", "v").first().rho == pytest.approx(-1)
    c = S.copies(df, ["g"], "s", "m", "v").first()
    assert c.complement and not c.equal and c.slope == pytest.approx(-1) and c.intercept == pytest.approx(1)


def test_reachable_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in S.reachable(edges, start).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_prefix_sums_over_many_parts(spark):
    """Running sums, totals, ranks, least-after and quantiles of keys that lie over several parts, null keys and ties included."""
    from tallyloom.operators import prefix

    rng = random.Random(12)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(60) / 4, rng.randrange(5)) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, v double, w long").groupBy("k", "v").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix.running(df, ["k"], ["v"], {"before": "w"}, {"all": "w"}).collect()
        low = prefix.least_after(df.withColumn("x", F.sin("v") * 10), ["k"], ["v"], "x", "low").collect()
        median = {r.k: r for r in prefix.quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}).collect()}
        ranks = prefix.average_ranks(spark.createDataFrame(rows + [("b", None, 1)], "k string, v double, w long"), ["k"], "v", "r").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for r in got:
        assert r.before == sum(w for k, v, w in rows if k == r.k and v < r.v) and r["all"] == sum(w for k, _, w in rows if k == r.k)
    for r in low:
        assert r.low == min(math.sin(v) * 10 for k, v, _ in rows if k == r.k and v >= r.v)
    for k in ("hot", "b", None):
        own = [v for x, v, _ in rows if x == k]
        assert (median[k].m, median[k].q) == pytest.approx((np.median(own), np.quantile(own, 0.9)))
    assert len(ranks) == len(rows) + 1 and [r.r for r in ranks if r.v is None] == [None]
    for r in ranks[:60]:
        own = [v for x, v, _ in rows if x == r.k]
        assert r.v is None or r.r == sum(v < r.v for v in own) + (sum(v == r.v for v in own) + 1) / 2
    assert prefix.running(df.limit(0), ["k"], ["v"], {"before": "w"}).count() == 0
    assert sorted(r.i for r in prefix.numbered(spark.range(50).repartition(7), ["id"], "i").collect()) == list(range(50))


def test_huber_of_keys_with_nulls_on_both_sides_of_the_switch(spark, monkeypatch):
    """('a', null), (null, 'a') and ('a', 'a') stay apart, in one row and by passes, with the same locations."""
    rng = np.random.default_rng(11)
    rows = [(k, j, float(v), float(w)) for i, (k, j) in enumerate([("a", None), (None, "a"), ("a", "a"), (None, None)]) for v, w in zip(rng.normal(size=300) * 4 + 20 * i, rng.random(300) + 0.1, strict=True)]
    df = spark.createDataFrame(rows, "k string, j string, v double, w double")
    one = {(r.k, r.j): r.location for r in R.huber_by_group(df, ["k", "j"], "v", "w").collect()}
    monkeypatch.setattr(R, "MOST_VALUES", 50)
    two = {(r.k, r.j): r.location for r in R.huber_by_group(df, ["k", "j"], "v", "w").collect()}
    assert set(one) == set(two) == {(r[0], r[1]) for r in rows}
    for key, at in one.items():
        own = [r for r in rows if r[:2] == key]
        assert at == pytest.approx(two[key], abs=1e-9) == pytest.approx(R.huber_location(np.array([r[2] for r in own]), np.array([r[3] for r in own])), abs=1e-9)


def test_mtld_against_a_plain_fold(spark):
    def fold(tokens):
        factors, start = 0.0, 0
        for i in range(1, len(tokens) + 1):
            if len(set(tokens[start:i])) / (i - start) <= 0.72:
                factors, start = factors + 1, i
        rest = tokens[start:]
        factors += (1 - len(set(rest)) / len(rest)) / 0.28 if rest else 0
        return len(tokens) / factors if factors else len(tokens)

    rng = random.Random(13)
    for n, words in ((10, 100), (40, 8), (400, 60), (900, 900), (700, 3)):
        t = [f"w{chr(97 + rng.randrange(words) % 26)}{chr(97 + rng.randrange(words) // 26 % 26)}" for _ in range(n)]
        assert one(spark, lambda x: T.mtld(F.split(x, " ")), " ".join(t), "string") == pytest.approx((fold(t) + fold(t[::-1])) / 2)


def test_binomial_and_chi_square_tails():
    from fractions import Fraction

    for a, b in ((0, 0), (3, 9), (1, 0), (25, 25), (40, 90)):
        n, k = a + b, min(a, b)
        assert E.binomial_p_value(a, b) == pytest.approx(min(1.0, float(2 * sum(Fraction(math.comb(n, i), 2**n) for i in range(k + 1)))), rel=1e-9)
    assert 0 <= E.binomial_p_value(50_000_000, 50_010_000) < 1 and E.binomial_p_value(0, 10_000) == 0.0
    assert S._upper_gamma(1.0, 3.0) == pytest.approx(math.exp(-3)) and S._upper_gamma(0.5, 1.92) == pytest.approx(0.05004, abs=1e-4) and S._upper_gamma(2.0, 2.5) == pytest.approx(math.exp(-2.5) * 3.5)


def test_an_item_in_every_group(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_BLOCK", 4)
    rows = [(f"g{g:02d}", i) for g in range(30) for i in ("hot", f"i{g % 3}", f"own{g}")] + [("g00", None), ("g00", "hot")]
    got = {(r.a, r.b): (r.shared, r.jaccard) for r in S.jaccard(spark.createDataFrame(rows, "g string, i string"), "g", "i").collect()}
    assert len(got) == 30 * 29 // 2
    assert all(v == ((2, 0.5) if int(a[1:]) % 3 == int(b[1:]) % 3 else (1, 0.2)) for (a, b), v in got.items())


def test_overlaps_of_short_and_very_long_intervals(spark):
    rng = random.Random(14)
    mk = lambda n: [("k", i, s := rng.random() * 5000, s + (rng.random() * 3 if i % 5 else rng.random() * 5000)) for i in range(n)]
    a, b = mk(60) + [("k", 99, 0.0, 1e9)], mk(60) + [("k", 98, 10.0, 10.0)]
    kinds = "key string, id int, start double, end double"
    rows = Q.overlaps(spark.createDataFrame(a, kinds), spark.createDataFrame(b, kinds), "key", 1.0).collect()
    want = {(x[1], y[1]) for x in a for y in b if min(x[3], y[3]) > max(x[2], y[2])}
    assert len(rows) == len(want) and {(r.a_id, r.b_id) for r in rows} == want


def test_rank_correlations_of_small_and_spread_pairs(spark, monkeypatch):
    rng = np.random.default_rng(15)
    rows = [(["s", None][i % 2], i // 2, m, float(v)) for i in range(160) for m, v in zip("abc", np.round(rng.normal(size=3), 1), strict=True) if rng.random() > 0.2]
    df = spark.createDataFrame(rows, "k string, unit int, m string, v double").where("k = 's'")
    get = lambda: {(r.a, r.b): (r.n, round(r.rho, 9)) for r in S.spearman(df, ["k"], "unit", "m", "v").collect()}
    one = get()
    monkeypatch.setattr(S, "RANKED_UNITS", 10)
    assert one == get() and len(one) == 3
    own = {m: {u: v for k, u, x, v in rows if k == "s" and x == m} for m in "ab"}
    common = sorted(own["a"].keys() & own["b"].keys())
    rank = lambda v: np.array([(np.array(v) < x).sum() + ((np.array(v) == x).sum() + 1) / 2 for x in v])
    x, y = (rank([own[m][u] for u in common]) for m in "ab")
    assert one["a", "b"] == (len(common), pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-8))


def test_seconds_of_windows_against_sql_and_without_broadcast(spark, tmp_path):
    """Repeats, revisions of a recording, open and reversed intervals, no duration; and a recording whose windows would fill no array."""
    import duckdb

    rows = [("a", "[[0.5, 4.5], [1, 3]]", 9.0), ("a", "[[0.5, 4.5], [1, 3]]", 9.0), ("a", "[[3, 7.25]]", 5.0), ("a", "[]", 3.0), ("b", "[[0, 2]]", 0.0), ("b", "[[0, 2]]", -3.0), ("c", "[[1.0]]", 5.0), ("d", "[[null, 3.0], null, []]", 3.5)]
    rows += [("e", None, 5.0), ("e", "[[0, 1]]", None), (None, "[[0, 1]]", 4.0), ("g", "[[-3, 1], [7, 20]]", 8.5), ("h", "[[3, 1], [2, 2]]", 5.0), ("i", "[[-1e300, 1e300], [1e300, 2e300]]", 5.0)]
    kinds = "case_id string, analysis_intervals string, duration_sec double"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/manifest.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW manifest AS SELECT * FROM read_parquet('{tmp_path}/manifest.parquet/*.parquet')")
    df = SEQ.QUERIES["j16_interval_overlap"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(db.execute(SEQ.ORACLES["j16_interval_overlap"]).fetchall())
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    spark.createDataFrame([("long", "[[1, 3]]", 6e10)], kinds).write.parquet(f"{tmp_path}/long/manifest.parquet")
    assert sorted(map(tuple, SEQ.QUERIES["j16_interval_overlap"](spark, f"{tmp_path}/long").collect())) == [("long", 0, 1.0), ("long", 1, 1.0)]


def test_no_side_of_overlaps_is_broadcast(spark):
    few = spark.range(1).selectExpr("'k' AS key", "id", "0.0D AS start", "3.0D AS end")
    pairs = Q.overlaps(few, few, "key", 2.0)
    assert pairs.count() == 1 and "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
