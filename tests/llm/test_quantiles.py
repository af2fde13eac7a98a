"""Sketch percentiles against exact ranks; merging, deletion and the stated cases."""

import numpy as np
import pytest

from tallyloom.llm import quantiles as Q

KINDS = "k string, day int, v double, n string"


def frame(spark, rows):
    return spark.createDataFrame(rows, KINDS)


def test_encoding_keeps_order_and_round_trips():
    v = np.array([-np.finfo(float).max, -5.5, -1e-300, -0.0, 0.0, 1e-300, 0.25, 3.0, 1e308])
    codes = Q.encode(v, 64)
    assert (np.diff(codes.astype(object)) >= 0).all() and codes[3] == codes[4]
    assert (Q.decode(codes, 64) == v + 0.0).all()
    x = np.random.default_rng(0).normal(size=1000) * 100
    assert (np.abs(Q.decode(Q.encode(x)) - x) <= np.abs(x) * 2.0**-19).all()


@pytest.mark.parametrize("kind", ["normal", "heavy ties", "booleans", "wide"])
def test_ranks_and_quantiles_within_the_bound(kind):
    rng = np.random.default_rng(2)
    v = {"normal": rng.normal(size=20_000), "heavy ties": rng.integers(0, 9, 20_000).astype(float), "booleans": (rng.random(20_000) < 0.3).astype(float), "wide": np.exp(rng.normal(size=20_000) * 20)}[kind]
    s = Q.Sketch()
    s.add(Q.encode(v))
    codes = np.sort(Q.encode(v))
    bound = s.rank_error()
    assert bound < 0.05 * len(v)
    for q in (0.01, 0.25, 0.5, 0.9, 0.99):
        c = int(codes[int(q * len(v))])
        assert abs(s.rank(c) - np.searchsorted(codes, c)) <= bound + 1e-6
        got = int(Q.encode(np.array([s.quantile(q)]))[0])
        lo, hi = np.searchsorted(codes, got), np.searchsorted(codes, got + 1)
        assert lo - 2 * bound - 1 <= q * (len(v) - 1) <= hi + 2 * bound + 1


def test_packing():
    for c in (np.zeros(10, np.int64), np.arange(-300, 300, dtype=np.int64), np.array([0, 2**40, 0, -1])):
        assert (Q._unpack(Q._pack(c)) == c).all()


def test_parts_days_and_deletions_merge(spark):
    rng = np.random.default_rng(4)
    rows = [(["a", "b", None][i % 3], i % 5, float(x), "x") for i, x in enumerate(rng.normal(size=3000))]
    whole = Q.merge(Q.sketch(frame(spark, rows).repartition(1), ["k"], "v"), ["k"])
    days = [Q.sketch(frame(spark, rows).where(f"day = {d}"), ["k", "day"], "v") for d in range(5)]
    joined = days[0]
    for d in days[1:]:
        joined = joined.unionByName(d)
    extra = [("a", 9, 123.0, "x")] * 40
    gone = [(*r, -1) for r in extra]
    more = Q.sketch(frame(spark, extra), ["k"], "v").unionByName(Q.sketch(spark.createDataFrame(gone, KINDS + ", w int"), ["k"], "v", "w"))
    later = Q.merge(joined.drop("day").unionByName(more), ["k"])
    get = lambda m: sorted(((r.k or "", r.level), r.n, tuple(Q._unpack(bytes(r.counters)))) for r in m.collect())
    assert get(whole) == get(later)


def test_stated_cases(spark):
    rows = [("a", 0, None, "x"), ("a", 0, float("nan"), "x"), ("a", 0, float("inf"), "x"), ("b", 0, 2.0, "x")]
    got = Q.percentiles(Q.merge(Q.sketch(frame(spark, rows), ["k"], "v"), ["k"]), ["k"]).collect()
    assert [(r.k, r.n, r.p50) for r in got] == [("b", 1, 2.0)]
    assert Q.percentiles(Q.merge(Q.sketch(frame(spark, []), ["k"], "v"), ["k"]), ["k"]).count() == 0


def test_rank_bounds(spark):
    rows = [("a", 0, float(i), "x") for i in range(100)] + [(None, 0, 5.0, "x")] * 10
    points = spark.createDataFrame([("a", 30.0), (None, 5.0), ("none", 1.0)], "k string, p double")
    got = {r.k: r for r in Q.rank_bounds(Q.merge(Q.sketch(frame(spark, rows), ["k"], "v"), ["k"]), ["k"], points, "p").collect()}
    assert set(got) == {"a", None}
    assert got["a"].below_least <= 30 <= got["a"].below_most and got["a"].above_least <= 69 <= got["a"].above_most
    assert got[None].below_least <= 0 <= got[None].below_most and got[None].n == 10


def test_bounds_hold_where_heavy_values_collide():
    rng = np.random.default_rng(5)
    beyond_tail = 0
    for _ in range(60):
        v = np.repeat(rng.uniform(1, 2, 60), 100)
        s = Q.Sketch()
        s.add(Q.encode(v))
        codes = np.sort(Q.encode(v))
        for c in np.unique(codes).tolist():
            true = int(np.searchsorted(codes, c))
            low, high = s.rank_between(c)
            assert low - 1e-6 <= true <= high + 1e-6
            beyond_tail += abs(s.rank(c) - true) > s.rank_error() + 1e-6
    assert beyond_tail > 0


def test_rank_bounds_hold_where_heavy_values_collide(spark):
    rng = np.random.default_rng(5)
    rows, points, want = [], [], {}
    for i in range(60):
        v = np.repeat(rng.uniform(1, 2, 60), 2)
        p = float(np.sort(v)[40])
        rows += [(str(i), 0, float(x), "x") for x in v]
        points.append((str(i), p))
        want[str(i)] = (int((v < p).sum()), int((v > p).sum()))
    got = Q.rank_bounds(Q.merge(Q.sketch(frame(spark, rows), ["k"], "v"), ["k"]), ["k"], spark.createDataFrame(points, "k string, p double"), "p").collect()
    assert len(got) == 60
    for r in got:
        below, above = want[r.k]
        assert r.below_least <= below <= r.below_most and r.above_least <= above <= r.above_most


def test_many_groups_in_one_task_leave_as_they_come():
    """Memory does not grow with the groups: 40,000 of them, and 300 large ones, through the fold of one task."""
    import tracemalloc

    import pyarrow as pa

    def batches():
        for i in range(4):
            k = [f"g{j}" for j in range(i * 10_000, i * 10_000 + 10_000) for _ in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.arange(20_000) / 7), pa.array(np.ones(20_000, np.int64))], names=["k", "__v", "__w"])
        for i in range(300):
            yield pa.RecordBatch.from_arrays([pa.array([f"big{i}"] * 1500), pa.array(np.arange(1500) / 7 + i), pa.array(np.ones(1500, np.int64))], names=["k", "__v", "__w"])

    tracemalloc.start()
    groups, levels, total = set(), {}, 0
    for names, level, n, _ in Q._folded(batches(), ["k"], Q.DEFAULT):
        groups.add(names)
        levels[level] = levels.get(level, 0) + 1
        total += n if level < 0 else 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(groups) == 40_300 and total == 80_000 + 450_000
    assert levels[Q.PLAIN] == 40_000 and levels[Q.EXACT] == 300
    # A sketch holds 0.44 MB; all groups' sketches would be 17 GB.
    assert peak < 300 << 20


def test_plain_codes_and_sketches_of_a_group_add_up(spark):
    rng = np.random.default_rng(7)
    big, small = rng.normal(size=5000), rng.normal(size=50)
    a = Q.sketch(frame(spark, [("a", 0, float(x), "x") for x in big]).repartition(1), ["k"], "v")
    b = Q.sketch(frame(spark, [("a", 1, float(x), "x") for x in small]).repartition(1), ["k"], "v")
    assert {r.level for r in b.collect()} == {Q.PLAIN} and Q.PLAIN not in {r.level for r in a.collect()}
    got = Q.percentiles(Q.merge(a.unionByName(b), ["k"]), ["k"]).first()
    both = np.sort(np.concatenate((big, small)))
    assert got.n == 5050 and abs(np.searchsorted(both, got.p50) - 2525) <= got.rank_error * 5050 + 1
    # Plain parts alone grow into a sketch when they are many.
    many = [Q.sketch(frame(spark, [("a", i, float(x), "x") for x in big[i * 900 : i * 900 + 900]]).repartition(1), ["k"], "v") for i in range(5)]
    codes = [Q._unpack_codes(bytes(r.counters)) for m in many for r in m.collect()]
    rows = [(("a", Q.PLAIN, int(w.sum()), Q._pack_codes(c, w))) for c, w in codes] * 1
    grown = dict.fromkeys(lv for _, lv, _, _ in Q._summed(iter([_batch_of(rows)]), 1, Q.Shape()))
    assert set(grown) == {Q.PLAIN}
    more = [("a", Q.PLAIN, 900, Q._pack_codes(np.sort(rng.integers(0, 2**32, 900).astype(np.uint64)), np.ones(900, np.int64))) for _ in range(12)]
    assert Q.PLAIN not in {lv for _, lv, _, _ in Q._summed(iter([_batch_of(more)]), 1, Q.Shape())}


def _batch_of(rows):
    import pyarrow as pa

    k, level, n, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(level, pa.int32()), pa.array(n, pa.int64()), pa.array(c, pa.binary())], names=["k", "level", "n", "counters"])
