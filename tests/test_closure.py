"""Closure by doubling against plain Python, and on a long chain."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators.closure import reach


def followed(edges, seeds, backward):
    known, last = set(seeds), set(seeds)
    while last:
        new = {(a, y) for x, y in last for a, b in edges if b == x} if backward else {(x, b) for x, y in last for a, b in edges if a == y}
        last = new - known
        known |= last
    return known


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = rng.choice((6, 14))
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(n + seed)} | ({(i, i + 1) for i in range(n)} if seed % 2 else set())
    frame = spark.createDataFrame(sorted(edges), "x int, y int")
    for seeds, backward, single in ((edges, False, 0), ({p for p in edges if p[0] == 1}, False, 2), ({p for p in edges if p[1] == 3}, True, 2)):
        start = frame.filter("true" if seeds == edges else "y = 3" if backward else "x = 1")
        got = [tuple(r) for r in reach(frame, start, backward, single).collect()]
        assert len(got) == len(set(got)) and set(got) == followed(edges, seeds, backward)


def test_a_chain_of_ten_thousand_steps(spark):
    edges = spark.range(10_000).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    found = reach(edges, edges.filter("x = 0"), single=3)
    assert found.agg(F.count("*"), F.count_distinct("y"), F.max("y"), F.max("x")).first()[:] == (10_000, 10_000, 10_000, 0)
