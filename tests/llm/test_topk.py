import math
import random

import duckdb
import pytest

from brickfield.llm import topk
from brickfield.llm.oracles import ORACLE_SQL


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(90)]
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (600, [1.0, 2.0]), (700, []), (None, [1.0] * 6)]
    rows += [rows[20], rows[100]]
    return rows


def expected(rows, k=10, every=100):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard, block, leaf", [(1 << 16, 1 << 13, 256), (60, 2, 8)])
def test_matches_brute_force(spark, vectors, monkeypatch, shard, block, leaf):
    for name, value in (("SHARD", shard), ("BLOCK", block), ("LEAF", leaf)):
        monkeypatch.setattr(topk, name, value)
    once = vectors[:-1]  # a query that repeats is told apart from itself by nothing
    df = spark.createDataFrame([(*r, 1) for r in once], "vec_id long, embedding array<float>, rank int").repartition(4)
    floats = spark.createDataFrame(once, "vec_id long, embedding array<float>").collect()
    assert sorted(map(tuple, topk.top_k(df).collect())) == expected([(r[0], r[1]) for r in floats])


@pytest.mark.parametrize("shard, block, leaf", [(1 << 16, 1 << 13, 256), (60, 2, 8)])
def test_repeated_queries_equal_sql(spark, vectors, monkeypatch, tmp_path, shard, block, leaf):
    for name, value in (("SHARD", shard), ("BLOCK", block), ("LEAF", leaf)):
        monkeypatch.setattr(topk, name, value)
    again = [*[r for r in vectors if r[1] != []], (200, [-1.0] * 6), (200, [0.5, 2.0]), vectors[300], vectors[300]]
    df = spark.createDataFrame(again, "vec_id long, embedding array<float>").repartition(4)
    df.write.parquet(f"{tmp_path}/v")
    want = duckdb.connect().execute(ORACLE_SQL["op5_topk"].replace("FROM embeddings", f"FROM '{tmp_path}/v/*.parquet'")).fetchall()
    assert len(want) > 10 and sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)


def test_queries_stay_in_tables(spark, monkeypatch):
    """However many blocks the queries fill, none of them reaches the driver."""
    monkeypatch.setattr(topk, "BLOCK", 4)
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    got, collect = [], type(df).collect
    with monkeypatch.context() as m:
        m.setattr(type(df), "collect", lambda self: got.append(rows := collect(self)) or rows)
        broadcast = type(spark.sparkContext).broadcast
        shards = lambda x: isinstance(x, dict) or isinstance(x, tuple) and len(x[1]) < 60  # noqa: E731  the cuts or the boxes of shards
        m.setattr(type(spark.sparkContext), "broadcast", lambda self, x: broadcast(self, x) if shards(x) else pytest.fail("queries were broadcast"))
        found = topk.top_k(df, every=3)
    assert max(map(len, got)) <= topk.SAMPLE // topk.FEW * 2 and found.count() == 20 * 10


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, -1.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 0)]
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [1 << 16, 60])
def test_each_query_row_has_its_own_answers(spark, vectors, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    again = [*vectors, (200, [-1.0] * 6), (200, [0.5, 2.0]), vectors[300], vectors[300]]
    df = spark.createDataFrame(again, "vec_id long, embedding array<float>").repartition(4)
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in df.collect() if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:10]
            want.append((q, [(i, -s) for s, i in best]))
    got = {}
    for r in topk.top_k(df, by_row=True).orderBy("rank").collect():
        got.setdefault((r["query_id"], r["query_row"]), []).append((r["vec_id"], r["score"]))
    assert sorted((q, found) for (q, _), found in got.items()) == sorted(want) and len(want) > 8


def test_large_components_are_exact(spark):
    """Sums past what a double holds, within a signed long."""
    rows = [(0, [2.0**19 + 1 / 1024, 3.0]), (1, [2.0**20 + 1 / 1024, -1.0]), (2, [2.0**20, 2.0**20]), (3, [-(2.0**20), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    scores = sorted((-sum(a * b for a, b in zip(whole[0], whole[i])), i) for i in (1, 2, 3))
    assert abs(scores[0][0]) > 1 << 53
    assert [(r["vec_id"], -r["score"]) for r in topk.top_k(df).orderBy("rank").collect()] == [(i, s) for s, i in scores]


def test_shards_for_idle_cores(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_SHARD", 16)
    rows = [(i, [math.sin(i), math.cos(3 * i), float(i % 5)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, topk.top_k(df, every=10).collect())) == expected(rows, every=10)


def test_clustered_vectors_ask_few_shards(spark, monkeypatch):
    """Shards cut by a tree: queries go to those alone whose box may reach their kth score."""
    import numpy as np

    for name, value in (("SHARD", 100), ("LEAST_SHARD", 100), ("LEAF", 16)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((16, 8)) * 4
    rows = [(i, [float(x) for x in centres[i % 16] + 0.05 * rng.standard_normal(8)]) for i in range(1600)]
    asked, reached = [], topk.reached
    monkeypatch.setattr(topk, "reached", lambda own, boxes: (asked.append((own.count(), len(boxes[0]), (found := reached(own, boxes)).count())), found)[1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, topk.top_k(df, every=10).collect())) == expected(rows, every=10)
    queries, shards, sent = asked[0]
    print("queries", queries, "shards", shards, "sent", sent, "of", queries * (shards - 1))
    assert queries == 160 and shards >= 16 and sent < queries * (shards - 1) / 4


def test_a_crowd_of_equal_vectors_is_many_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 50)
    rows = [(i, [1.0, 2.0]) for i in range(700)] + [(1000 + i, [0.1 * i, -1.0]) for i in range(30)]
    parts, own = [], topk.own_answers
    monkeypatch.setattr(topk, "own_answers", lambda sharded, *a: (parts.append(sharded.groupBy("shard").count().agg({"count": "max"}).first()[0]), own(sharded, *a))[1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, topk.top_k(df).collect())) == expected(rows) and parts[0] <= 150
