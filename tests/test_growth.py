"""Plans that grow with their input: nothing that has grown is broadcast or shuffled."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickfield.operators import graphs as G, neighbors as N
from brickfield.plans import graph_queries as Q

SF = "/root/testdata/sf0.001"


def plan(df):
    """The physical plan, from its result down, as first planned."""
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_nearest_points_joins_no_exploded_points(spark):
    assert "explode(array(" not in plan(Q.QUERIES["nearest_points"](spark, SF))


@pytest.mark.parametrize("name", ["rasterize_mask", "vector_map_within", "blobs_from_points"])
def test_grown_labels_are_not_broadcast(spark, name):
    text = plan(Q.QUERIES[name](spark, SF))
    joins = [line for line in text.splitlines() if "BroadcastHashJoin" in line]
    assert "SortMergeJoin" in text and not [j for j in joins if re.search(r"\bz#\w+", j)]


@pytest.mark.parametrize("name", ["rasterize_ball", "rasterize_hollow", "vector_map_min", "vector_map_split"])
def test_voxels_are_not_shuffled(spark, name):
    text = plan(Q.QUERIES[name](spark, SF))
    assert "Exchange" not in text[: text.index("MapInArrow")]


@pytest.mark.parametrize("name", ["rasterize_tube", "rasterize_tube_cells"])
def test_voxels_of_tubes_are_only_counted(spark, name):
    text = plan(Q.QUERIES[name](spark, SF))
    assert text[: text.index("MapInArrow")].count("Exchange") == 1  # of the counts


@pytest.mark.parametrize("size", [(1, 1, 1), (2.0, 0.5, 1.5)])
def test_edges_are_drawn_as_their_points(spark, size):
    """Across tiles and below 0, against balls around each point along the edges."""
    some = np.random.default_rng(3).integers(-150, 150, (12, 3)).astype(float).tolist()
    nodes = spark.createDataFrame([(i, p) for i, p in enumerate(some)], "id long, loc array<double>")
    edges = spark.createDataFrame([(i, i + 1) for i in range(11)] + [(5, 5)], "u long, v long")
    at = [F.floor(F.col("loc")[i] / s) * s + s / 2 for i, s in enumerate(size)]
    line = G.along_edges(nodes, edges, size).select(F.array(*at).alias("loc")).distinct()
    want = sorted(map(tuple, G.rasterize(line, 2.0, size).select("z", "y", "x").collect()))
    assert sorted(map(tuple, G.rasterize_edges(nodes, edges, 2.0, size).select("z", "y", "x").collect())) == want


def test_leaves_met_through_the_tree(spark):
    """Those within reach, and what lies wholly within it, as by comparing every box."""
    rng = np.random.default_rng(5)
    p = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.random((4000, 3)))], "p long, z double, y double, x double")
    axes = ["z", "y", "x"]
    boxes = N.Boxes(N.dealt(p, axes, N.partition(p, axes, 64)), axes, None)
    at, reach, whole = rng.random((50, 3)), rng.random(50) * 0.3, np.zeros(50, dtype=np.int64)
    near, far = N.between(at, boxes.low, boxes.high)
    inside = far <= reach[:, None]
    found = sorted((int(i), int(leaf)) for rows, leaves in boxes.met(at, reach, whole) for i, leaf in zip(rows, leaves))
    assert whole.tolist() == (inside @ boxes.n).tolist()
    assert found == sorted((int(i), int(boxes.leaf[j])) for i, j in zip(*np.nonzero((near <= reach[:, None]) & ~inside)))


def test_nearest_within_a_radius(spark):
    rng = np.random.default_rng(7)
    rows = [(i, *map(float, r)) for i, r in enumerate(rng.integers(0, 30, (900, 2)))]
    p = spark.createDataFrame(rows, "id long, y double, x double")
    want = []
    for i, y, x in rows:
        near = sorted(((y - b) ** 2 + (x - c) ** 2, j) for j, b, c in rows if j != i and (y - b) ** 2 + (x - c) ** 2 <= 1)
        want += [(i, k + 1, j) for k, (_, j) in enumerate(near[:2])]
    assert sorted((r["id"], r["rank"], r["id_r"]) for r in N.k_nearest(p, p, ("y", "x"), 2, "id", "id", radius=1.0).collect()) == sorted(want)


def test_draws_are_judged_where_they_are_drawn(spark):
    """By a table joined to the requests, as by one joined to the draws; no draw is shuffled."""
    from brickfield.functions.geometry import Box
    from brickfield.operators import locate as L

    requests = spark.range(300).selectExpr("id AS request", "id AS seed", "id % 3 AS volume")
    rows = spark.createDataFrame([(v, b, (v + b) % 4 == 0) for v in range(3) for b in range(9)], "volume long, b_z long, good boolean")
    by_draw = L.shift_until(requests, (2,), Box((0,), (9,)), (1,), lambda drawn: drawn.join(rows, ["volume", "b_z"]).where("good"), "z")
    known = rows.groupBy("volume").agg(F.map_from_entries(F.collect_list(F.struct("b_z", "good"))).alias("good"))
    found = L.shift_until(requests, (2,), Box((0,), (9,)), (1,), F.col("good")[F.col("b_z")], "z", known=(known, ["volume"]))
    assert sorted(map(tuple, found.select("request", "attempt", "b_z").collect())) == sorted(map(tuple, by_draw.select("request", "attempt", "b_z").collect()))


def test_kernels_compute_few_blocks_at_once(spark):
    """However many come in a batch; nulls stay where they are."""
    from brickfield.functions import cells as C

    grid, seen = C.Grid((8, 8, 8)), []
    found = C.in_pieces(lambda a: (seen.append(len(a)), a)[1], grid.size)
    rows = C.pa.array([None if i % 7 == 0 else [float(i)] * 3 for i in range(2000)])
    assert found(rows).equals(rows) and max(seen) * grid.size <= C.AT_ONCE and sum(seen) == 2000
    made = spark.range(2000, numPartitions=1).select("id", F.when(F.col("id") % 7 > 0, F.transform(F.sequence(F.lit(1), F.lit(512)), lambda i: i + F.col("id").cast("double"))).alias("a"))
    most = made.select("id", C.kernel(lambda v: np.full_like(v, len(v)), grid, "double", F.col("a")).alias("n")).selectExpr("id", "n[0] AS n")
    got = {r["id"]: r["n"] for r in most.collect()}
    assert all((got[i] is None) == (i % 7 == 0) for i in range(2000)) and max(n for n in got.values() if n) * grid.size <= C.AT_ONCE


def test_a_bucket_of_boxes_is_many_tasks_work(spark, monkeypatch):
    """All pairs of overlapping boxes, once each, also of boxes that stand twice; one bucket's from one file are made by many tasks."""
    from brickfield.operators import joins as J

    rng = np.random.default_rng(11)
    rows = lambda n, wide: [(i, *map(int, (b, b + e, c, c + f))) for i, (b, c, e, f) in enumerate(np.hstack([rng.integers(-40, 40, (n, 2)), rng.integers(1, wide, (n, 2))]))]
    a, b = rows(200, 30), rows(150, 9)
    a, b = a + a[:20], b + [(900, 0, 1, 200, 201)]
    schema = "id long, b_z long, e_z long, b_y long, e_y long"
    one, other = (spark.createDataFrame(r, schema).coalesce(1) for r in (a, b))
    want = sorted((r[0], s[0]) for r in a for s in b if r[1] < s[2] and s[1] < r[2] and r[3] < s[4] and s[3] < r[4])
    for most in (1 << 24, 50):
        monkeypatch.setattr(J, "CANDIDATES", most)
        assert sorted(map(tuple, J.overlap(one, other, ("z", "y"), (16, 8)).select("id", "id_o").collect())) == want
    monkeypatch.setattr(J, "CANDIDATES", 1000)
    assert busy(J.overlap(one, other, ("z",), (1000,))) > 4


def test_pairs_of_boxes_come_in_the_order_of_places(spark, monkeypatch):
    """However boxes lie in their files: by the other's place, and there each box meets the same run of others, so that pairs pack well when written."""
    from brickfield.operators import joins as J

    boxes = spark.range(800, numPartitions=1).selectExpr("id", "id * 211 % 200 AS b_z", "id * 211 % 200 + 5 AS e_z")
    others = spark.range(600, numPartitions=1).selectExpr("id", "id * 113 % 150 AS b_z", "id * 113 % 150 + 3 AS e_z")
    rows = J.overlap(boxes, others, ("z",), (2000,)).select("b_z", "id", "b_z_o", "id_o").collect()  # of one bucket, so one task
    assert [(r.b_z_o, r.b_z) for r in rows] == sorted((r.b_z_o, r.b_z) for r in rows)
    runs = {}
    for r, before in zip(rows, [None, *rows]):
        if before is None or (r.b_z_o, r.id) != (before.b_z_o, before.id):
            assert (r.b_z_o, r.id) not in runs
            runs[r.b_z_o, r.id] = []
        runs[r.b_z_o, r.id].append(r.id_o)
    assert len({(p, tuple(run)) for (p, _), run in runs.items()}) == 150 and all(len(run) == 4 for run in runs.values())
    monkeypatch.setattr(J, "GROUP", 3)
    again = J.overlap(boxes, others, ("z",), (16,)).select("b_z", "id", "b_z_o", "id_o").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows)) and len(set(map(tuple, again))) == len(again)


def test_a_query_looks_at_few_of_a_leafs_cells(monkeypatch):
    """However large the leaf; counts and nearest points as by brute force, also of queries beside it."""
    monkeypatch.setattr(N, "INNER", 16)
    rng = np.random.default_rng(13)
    points, queries, seen = rng.permutation(60 * 60 * 10)[:20_000], rng.integers(-5, 65, (300, 3)).astype(float), []
    points = np.stack([points // 600, points // 10 % 60, points % 10], axis=1).astype(float)
    d2 = N.squared(queries, points)
    between = N.between
    monkeypatch.setattr(N, "between", lambda p, low, *a: (seen.append(len(p) * len(low)), between(p, low, *a))[1])
    for numbers in (np.ones(len(points), dtype=np.int64), rng.integers(1, 5, len(points))):
        assert (N.Leaf(points, numbers).count(queries, 4.0) == (d2 <= 16) @ numbers).all()
    ids = rng.permutation(len(points))
    far, found = N.Leaf(points, ids).nearest(queries, 3, np.where(np.arange(300) % 3, np.inf, 4.0))
    for i, (limit, row) in enumerate(zip(np.where(np.arange(300) % 3, np.inf, 4.0), d2)):
        near = sorted((d, j) for d, j in zip(row.tolist(), ids.tolist()) if d <= limit)[:3]
        near += [(np.inf, -1)] * (3 - len(near))
        assert list(zip(far[i].tolist(), found[i].tolist())) == near
    assert sum(seen) < 3 * 300 * 200  # of more than 1250 cells


def test_rows_are_dealt_to_leaves_together():
    batches = [N.pa.record_batch({"z": np.arange(1000.0) + 1000 * i}) for i in range(300)]
    found = list(N.gathered(iter(batches)))
    assert len(found) == 3 and np.concatenate([b.column("z").to_numpy() for b in found]).tolist() == list(range(300_000))
    assert list(N.gathered(iter([]))) == []


def test_broadcasts_need_no_package_on_executors(spark, monkeypatch):
    """Broadcasts, unlike kernels, are pickled by the names of their classes."""
    import pickle

    sent, context = [], type(spark.sparkContext)
    broadcast = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: (sent.append(value), broadcast(self, value))[1])
    p = spark.range(2000).selectExpr("id", "double(id % 50) AS y", "double(id % 41) AS x")
    assert N.count_within(p, ("y", "x"), 2.0).count() == N.k_nearest(p, p, ("y", "x"), 1, "id", "id").count() == 2000
    assert len(sent) >= 4 and not any(b"brickfield" in pickle.dumps(value) for value in sent)


def busy(df):
    """How many tasks have rows of the result."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.mark.parametrize("name", ["rasterize_mask", "vector_map_within"])
def test_voxels_within_labels_are_not_shuffled(spark, name):
    text = plan(Q.QUERIES[name](spark, SF))
    assert "Exchange" not in text[: text.index("MapInArrow")]


@pytest.mark.parametrize("each", [(3, 40, 20), (16, 128, 64), (5, 7, 100)])
def test_labels_by_tiles_are_those_of_their_voxels(spark, each):
    """Across tiles and below 0, where cells don't end at tiles and some have no label; against labels by voxel."""
    rng = np.random.default_rng(17)
    at = np.concatenate([rng.integers(-150, 150, (60, 3)), rng.integers(-9, 9, (60, 3))])
    nodes = spark.createDataFrame([(i, p) for i, p in enumerate([*(at + 0.5).tolist(), at[0].astype(float).tolist(), None])], "id long, loc array<double>")
    edges = spark.createDataFrame([(i, i + 1) for i in range(119)] + [(5, 90)], "u long, v long")
    label = lambda cell: None if (found := (cell[0] * 5 + cell[1] * 3 + cell[2]) % 7) == 3 else found % 2
    tiles = G.touched_tiles(nodes, 3.0)
    rows = []
    for t in map(tuple, tiles.collect()):
        low = [c * n // e for c, n, e in zip(t, G.TILE, each)]
        rows.append((*t, [label([a + b for a, b in zip(low, c)]) for c in np.ndindex(*G.TiledLabels(tiles, each).shape)]))
    by_tile = G.TiledLabels(spark.createDataFrame(rows, tiles.schema.simpleString()[7:-1] + ",labels array<long>"), each)
    voxels = [tuple(r) for r in G.rasterize(nodes, 3.0).select("z", "y", "x").collect()]
    by_voxel = spark.createDataFrame([(*v, label([c // e for c, e in zip(v, each)])) for v in voxels], "z long, y long, x long, label long")
    got, want = (sorted(map(tuple, G.rasterize_in_labels(nodes, x, 3.0).collect())) for x in (by_tile, by_voxel))
    assert got == want and len({r[:3] for r in got}) == len(got) > 1000
    got, want = (sorted(map(tuple, G.vector_map(nodes, edges, nodes, 3.0, labels=x).collect())) for x in (by_tile, by_voxel))
    assert got == want and len(got) > 1000


def test_slopes_of_a_volume_make_no_rows_of_blocks(spark):
    from brickfield.plans import lattice_queries as L

    text = plan(L.QUERIES["volume_distance_gradients"](spark, SF))
    assert "ArrowEvalPython" not in text and "collect_list" not in text


@pytest.mark.parametrize("most", [1, 3000, 1 << 18])
def test_sorted_volume_is_the_whole_volume(spark, monkeypatch, most):
    """However many cells come at once; with gaps, nulls, places below 0 and voxels of no batch."""
    from brickfield.operators import blocks as B

    rng = np.random.default_rng(19)
    rows = [(batch, *map(int, p), float(v) if v < 0.9 else None) for batch in (3, None, 7) for p, v in zip(np.unique(rng.integers(-9, 23, (3000, 3)), axis=0), rng.random(3000))]
    voxels = spark.createDataFrame(rows, "batch_id long, z long, y long, x long, value double").repartition(3)
    want = B.whole_volume(voxels, (8, 4, 16), (1, 2, 1), lambda v, g: {f"d{a}": B.gradient(v, g, i) for i, a in enumerate("zyx")})
    monkeypatch.setattr(B, "AT_ONCE", most)
    got = B.sorted_volume(voxels, (8, 4, 16), (1, 2, 1), lambda v: {f"d{a}": B.slope(v, i, 1.0) for i, a in enumerate("zyx", 1)}, ["dz", "dy", "dx"])
    assert got.dtypes == want.dtypes
    key = lambda r: (r[0] is not None, *(x if x is not None else 0 for x in r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key) and got.count() > 6000
