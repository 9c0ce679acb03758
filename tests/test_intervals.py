"""Overlapping intervals against all pairs."""

import random

import pytest

from postlake.operators.intervals import overlap_join


def intervals(seed, n, longest):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.choice([rng.randrange(-200, 2_000), 500])
        out.append((i, rng.choice("ab"), start, start + rng.choice([0, 0, 1, 3, rng.randrange(longest), longest])))
    return out + [(n, "a", None, 5), (n + 1, "a", 5, None), (n + 2, "a", 9, 3), (n + 3, None, 0, 9), (0, *out[0][1:])]


@pytest.mark.parametrize("on", [(), ("k",)])
@pytest.mark.parametrize("longest", [1, 40, 5_000])
def test_each_pair_once(spark, longest, on):
    a, b = intervals(1, 120, longest), intervals(2, 150, 60)
    left = spark.createDataFrame(a, "i int, k string, s long, e long")
    right = spark.createDataFrame(b, "j int, k2 string, t long, u long")
    if on:
        right = right.withColumnRenamed("k2", "k")
    got = overlap_join(left.repartition(3), right, ("s", "e"), ("t", "u"), on)
    good = lambda x: x[2] is not None and x[3] is not None and x[2] <= x[3]
    want = sorted((x[0], y[0]) for x in a for y in b if good(x) and good(y) and x[2] <= y[3] and y[2] <= x[3] and (not on or (x[1] == y[1] and x[1] is not None)))
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want and len(want) > 300
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_empty_sides(spark):
    left = spark.createDataFrame([(1, 0, 5)], "i int, s long, e long")
    right = spark.createDataFrame([(1, 0, 5)], "j int, t long, u long")
    assert overlap_join(left.limit(0), right, ("s", "e"), ("t", "u")).collect() == []
    assert overlap_join(left, right.limit(0), ("s", "e"), ("t", "u")).collect() == []
    assert [tuple(r) for r in overlap_join(left, right, ("s", "e"), ("t", "u")).collect()] == [(1, 0, 5, 1, 0, 5)]
