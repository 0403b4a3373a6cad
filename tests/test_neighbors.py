"""Counts and nearest points through the space partition, against brute force and in crowded spots."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickfield.operators import neighbors as N


def brute(left, right, k, own=False):
    out = []
    for i, *a in left:
        near = sorted((sum((x - y) ** 2 for x, y in zip(a, b)), j) for j, *b in right if own or j != i)[:k]
        out += [(i, r + 1, j, d) for r, (d, j) in enumerate(near)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    pts = [*rng.integers(0, 9, (150, 2)), *rng.normal(100, 0.5, (150, 2)), *[(3.0, 3.0)] * 60, (1e6, -1e6), (-5e5, 0.0), (-0.0, 0.0), (0.0, 0.0)]
    return [(i, float(y), float(x)) for i, (y, x) in enumerate(pts)]


@pytest.mark.parametrize("sizes", [{}, {"CELL": 8, "ASKED": 20}, {"CELL": 8, "SAMPLE": 64, "PAIRS": 50, "ASKED": 7}])
def test_matches_brute_force(spark, monkeypatch, rows, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(N, name, value)
    p = spark.createDataFrame(rows, "id long, y double, x double").repartition(3)
    some = spark.createDataFrame([*rows, (900, None, 1.0), (901, float("nan"), 1.0)], p.schema)
    got = {r["id"]: r["n"] for r in N.count_within(some, ("y", "x"), 2.5).collect()}
    assert got == {i: sum((y - b) ** 2 + (x - c) ** 2 <= 6.25 for _, b, c in rows) for i, y, x in rows}
    for k in (1, 4):
        found = sorted((r["id"], r["rank"], r["id_r"], r["d2"]) for r in N.k_nearest(some, p, ("y", "x"), k, "id", "id").collect())
        assert found == brute(rows, rows, k)
    few = rows[:7]
    q = spark.createDataFrame([(i, y + 0.5, x) for i, y, x in rows[::9]], "q long, y double, x double")
    found = sorted((r["q"], r["rank"], r["id_r"], r["d2"]) for r in N.k_nearest(q, p.where("id < 7"), ("y", "x"), 9, "q", "id", own=True).collect())
    assert found == brute([(i, y + 0.5, x) for i, y, x in rows[::9]], few, 9, own=True)


def test_none(spark):
    p = spark.createDataFrame([], "id long, y double")
    assert N.count_within(p, ("y",), 1.0).count() == 0 and N.k_nearest(p, p, ("y",), 2, "id", "id").count() == 0
    one = spark.createDataFrame([(1, 0.0)], p.schema)
    assert N.k_nearest(one, p, ("y",), 2, "id", "id").count() == 0 and N.k_nearest(one, one, ("y",), 2, "id", "id").count() == 0


def busy(df):
    """How many tasks of the last stage had rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.mark.parametrize("spread", [4.0, 0.0])
def test_a_crowded_spot_is_many_tasks_work(spark, spread, monkeypatch):
    """50 000 points within a unit of each other, or at one place."""
    p = spark.range(50_000).selectExpr("id", f"(id * 7919 % 10007) / 10007.0D * {spread} AS y", f"(id * 104729 % 10009) / 10009.0D * {spread} AS x").repartition(4)
    parts = []
    asked = N.asked
    monkeypatch.setattr(N, "asked", lambda *a: (parts.append(a[1].groupBy("leaf").count().count()), asked(*a))[1])
    p.count()
    began = time.perf_counter()
    counts = N.count_within(p, ("y", "x"), 5.0 if spread else 1.0).select("n").groupBy("n").count().collect()
    took = time.perf_counter() - began
    began = time.perf_counter()
    near = N.k_nearest(p, p, ("y", "x"), 3, "id", "id").groupBy("rank").agg(F.count("*").alias("n"), F.max("d2").alias("d2")).collect()
    print("seconds", took, time.perf_counter() - began, parts)
    assert took < 20 and time.perf_counter() - began < 20
    assert sum(r["count"] for r in counts) == 50_000 and sorted((r["rank"], r["n"]) for r in near) == [(1, 50_000), (2, 50_000), (3, 50_000)]
    if spread:
        assert parts[1] > 16  # leaves that are asked, a task's work each
    else:
        assert counts[0]["n"] == 50_000 and {r["d2"] for r in near} == {0.0}
