"""Packing: nothing lost, nothing overlapping, little unused."""

import itertools
import random

import numpy as np
import pytest

from tallyloom.llm import pack


def test_bounds_against_brute_force():
    rng = random.Random(1)
    for _ in range(20):
        counts = np.array([0] + [rng.randrange(4) for _ in range(9)])
        sizes = [s for s in range(1, 10) if counts[s]]
        if not sizes:
            continue
        for b in (1, 2, 3):
            def cost(bounds):
                return sum(counts[s] * (min(x for x in bounds if x >= s) - s) for s in sizes)

            best = min(cost(c) for k in range(1, b + 1) for c in itertools.combinations(sizes, min(k, len(sizes))) if c[-1] == sizes[-1])
            got = pack.optimal_bounds(counts, b)
            assert got[-1] == sizes[-1] and len(got) <= b and cost(got) == best


def test_the_largest_capacity_is_planned_soon_and_small():
    """65,536 different lengths in 256 buckets; no worse than even steps, and the true optimum of a part of it."""
    import time
    import tracemalloc

    rng = np.random.default_rng(3)
    counts = np.concatenate(([0], rng.integers(1, 1000, pack.MAX_CAPACITY)))
    tracemalloc.start()
    began = time.monotonic()
    got = np.array(pack.optimal_bounds(counts, 256))
    assert time.monotonic() - began < 60 and tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()

    def padding(bounds, counts):
        sizes = np.arange(len(counts))
        return int((counts * (bounds[np.searchsorted(bounds, sizes)] - sizes)).sum())

    assert len(got) == 256 and padding(got, counts) < padding(np.arange(256, pack.MAX_CAPACITY + 1, 256), counts)
    few = counts[:120]
    cost = [[0 if i >= j else int((few[i + 1 : j + 1] * (j - np.arange(i + 1, j + 1))).sum()) for j in range(120)] for i in range(120)]
    best = [cost[0][j] for j in range(120)]
    for _ in range(8):
        best = [min(best[i] + cost[i][j] for i in range(j + 1)) for j in range(120)]
    assert padding(np.array(pack.optimal_bounds(few, 9)), few) == best[-1]


def test_containers_do_not_depend_on_where_rows_lie(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.randrange(1, 60)) for i in range(500)], "doc_id long, n_tokens long")
    get = lambda d: sorted(map(tuple, pack.pack(d, capacity=64, buckets=9).collect()))
    assert get(df.repartition(7)) == get(df.orderBy("n_tokens").coalesce(1))


def check(spark, sizes, capacity, buckets=64):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id long, n_tokens long, place string").repartition(5)
    rows = pack.pack(df, capacity=capacity, buckets=buckets).collect()
    pieces, containers = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece_no, r.piece_from, r.piece_size))
        if r.container is not None:
            containers.setdefault(r.container, []).append((r.place, r.place + r.piece_size))
        else:
            assert r.piece_size == 0
    for i, n in enumerate(sizes):
        got = sorted(pieces[i])
        assert [p[0] for p in got] == list(range(max(1, -(-(n or 0) // capacity))))
        assert sum(p[2] for p in got) == (n or 0) and all(p[1] == p[0] * capacity for p in got)
    for spans in containers.values():
        spans.sort()
        assert spans[0][0] >= 0 and spans[-1][1] <= capacity and all(a[1] <= b[0] for a, b in itertools.pairwise(spans))
    return rows, containers


def test_random_sizes(spark):
    rng = random.Random(2)
    sizes = [int(rng.lognormvariate(3, 1)) for _ in range(800)] + [None, 0, 0, 128, 129, 1000]
    rows, containers = check(spark, sizes, 128, 100)
    used = sum(r.piece_size for r in rows) / (128 * len(containers))
    assert used > 0.97
    assert sorted(containers) == list(range(len(containers)))


def test_one_size_and_empty(spark):
    _, containers = check(spark, [10] * 95, 30)
    assert len(containers) == 32
    check(spark, [0, None], 30)
    assert pack.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
    check(spark, [1], 1)


def test_fill_and_refusals(spark):
    df = spark.createDataFrame([(1, 10), (2, 20)], "doc_id long, n_tokens long")
    r = pack.fill(pack.pack(df, capacity=30), 30).first()
    assert (r.containers, r.units, r.used_share) == (1, 30, 1.0)
    with pytest.raises(ValueError, match="capacity"):
        pack.pack(df, capacity=0)
    with pytest.raises(Exception, match="negative size"):
        pack.pack(spark.createDataFrame([(1, -1)], "doc_id long, n_tokens long")).collect()
