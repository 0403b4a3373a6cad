import math

import pytest
from pyspark.sql import functions as F

from brickfield.functions.geometry import Box
from brickfield.operators import graphs as G, joins as J, locate as L, neighbors as N

PATH = [(1, [4.0, 7.0, 5.0]), (2, [310.0, 90.0, 45.0]), (3, [330.0, 120.0, 60.0])]


def graph(spark, nodes, edges):
    return spark.createDataFrame(nodes, "id long, loc array<double>"), spark.createDataFrame(edges, "u long, v long")


def pairs(df):
    return sorted((r["u"], r["v"]) for r in df.collect())


def test_crop_keeps_dangling_ends(spark):
    nodes, edges = graph(spark, PATH, [(1, 2), (2, 3)])
    n, e = G.crop(nodes, edges, Box((0, 0, 0), (64, 64, 64)))
    assert {r["id"] for r in n.collect()} == {1, 2} and pairs(e) == [(1, 2)]


def test_trim_adds_a_node_on_the_border(spark):
    nodes, edges = graph(spark, PATH, [(1, 2), (2, 3)])
    n, e = G.trim(nodes, edges, Box((0, 0, 0), (64, 64, 64)))
    rows = {r["id"]: r for r in n.collect()}
    part = 60 / 306  # the line leaves the box along the first axis
    assert set(rows) == {1, 4} and rows[4]["temporary"] and rows[4]["loc"] == pytest.approx([64.0, 7 + 83 * part, 5 + 40 * part], abs=1e-3) and rows[4]["loc"][0] < 64
    assert pairs(e) == [(1, 4)]


def test_trim_below_zero(spark):
    nodes, edges = graph(spark, [(1, [-5.0]), (2, [-20.0]), (3, [4.0])], [(1, 2), (3, 1)])
    n, _ = G.trim(nodes, edges, Box((-10,), (9,)))
    at = sorted(r["loc"][0] for r in n.collect())
    assert at == pytest.approx([-10.0, -5.0, -1.000001])


def test_cycle(spark):
    nodes, edges = graph(spark, [(i, [float(i)] * 3) for i in range(5)], [(i, (i + 1) % 5) for i in range(5)])
    assert {r["component"] for r in G.label_components(nodes, edges).collect()} == {0}
    assert {(r["other"], r["side"]) for r in G.neighbors(edges).where("id = 0").collect()} == {(1, "successor"), (4, "predecessor")}
    assert {r["in_degree"] for r in G.in_degree(nodes, edges).collect()} == {1}
    left, kept = G.remove_nodes(nodes, edges, spark.createDataFrame([(2,)], "id long"))
    assert left.count() == 4 and pairs(kept) == [(0, 1), (1, 3), (3, 4), (4, 0)]
    assert pairs(G.remove_nodes(nodes, edges, spark.createDataFrame([(2,)], "id long"), False)[1]) == [(0, 1), (3, 4), (4, 0)]


def test_components_without_edges(spark):
    nodes, edges = graph(spark, [(3, [0.0]), (9, [1.0])], [])
    assert {(r["id"], r["component"]) for r in G.label_components(nodes, edges).collect()} == {(3, 3), (9, 9)}


def test_upsert(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id long, tag string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "id long, tag string")
    assert sorted(map(tuple, G.upsert(a, b).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_ball_and_line(spark):
    nodes, edges = graph(spark, [(1, [0.0, 4.0, 4.0]), (2, [9.0, 4.0, 4.0])], [(1, 2)])
    assert G.rasterize(nodes, 1.0).count() == 14
    assert G.rasterize(nodes, 40.0, (40, 4, 4)).where("z = 0").count() == sum(1 for y in range(-10, 11) for x in range(-10, 11) if y * y + x * x <= 100)
    line = G.along_edges(nodes, edges)
    assert G.rasterize(line, 0.5).count() == 10
    assert G.rasterize_peak(nodes, 1.0).agg(F.max("value")).first()[0] == 1.0


def test_own_label_alone(spark):
    nodes, _ = graph(spark, [(1, [0.5, 0.5, 0.5])], [])
    labels = spark.createDataFrame([(0, 0, x, 1 if x < 2 else 2) for x in range(-2, 5)], "z long, y long, x long, label int")
    assert sorted(r["x"] for r in G.rasterize_in_labels(nodes, labels, 3.0).collect()) == [-2, -1, 0, 1]


def test_joins_match_plain_loops(spark):
    points = [(i, (i * 37) % 50, (i * 11) % 40) for i in range(80)]
    boxes = [(k, k * 3 % 45, k * 3 % 45 + k % 9, k * 7 % 30, k * 7 % 30 + 6) for k in range(30)]
    p = spark.createDataFrame(points, "id long, y long, x long")
    b = spark.createDataFrame(boxes, "box long, b_y long, e_y long, b_x long, e_x long")
    got = sorted((r["box"], r["id"]) for r in J.points_in_boxes(p, b, ("y", "x"), (8, 8)).collect())
    assert got == sorted((k, i) for k, y0, y1, x0, x1 in boxes for i, y, x in points if y0 <= y < y1 and x0 <= x < x1)
    near = sorted((r["id"], r["id_r"]) for r in J.within_radius(p, p, ("y", "x"), 6.0).collect())
    assert near == sorted((i, j) for i, y, x in points for j, v, w in points if math.hypot(y - v, x - w) <= 6)
    first = {r["id"]: r["id_r"] for r in J.nearest(p, p, ("y", "x"), 1, 6.0, "id", "id").collect()}
    assert all(first[i] <= i for i, *_ in points)


def test_requests(spark):
    requests = spark.range(300).selectExpr("id AS request", "id AS seed", "id AS turn")
    box = Box((-96, -35, 14), (900, 130, 84))
    rows = L.random_shift(requests, (180, 24, 16), box, (12, 2, 2)).collect()
    assert all(box.contains(Box((r["b_z"], r["b_y"], r["b_x"]), (180, 24, 16))) and r["b_z"] % 12 == 0 for r in rows)
    assert len({(r["b_z"], r["b_y"], r["b_x"]) for r in rows}) > 250
    with pytest.raises(ValueError):
        L.random_shift(requests, (2000, 24, 16), box, (12, 2, 2))
    places = spark.createDataFrame([(0, 0, 0, 0), (1, 100, 100, 100), (2, 91, 20, 20), (3, 42, 24, 57)], "location long, z long, y long, x long")
    got = L.specified(requests, places, (10, 10, 10), Box((0, 0, 0), (100, 100, 100)), (1, 1, 1)).where("request < 4").orderBy("request").collect()
    assert [r["location"] for r in got] == [2, 3, 2, 3] and (got[0]["b_z"], got[0]["b_y"], got[0]["b_x"]) == (86, 15, 15)
    with pytest.raises(ValueError):
        L.specified(requests, places.limit(0), (10, 10, 10), box, (1, 1, 1))


def test_weighted_points_follow_their_weights(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.0), (3, 90.0, 90.0)], "id long, y double, x double")
    weights = L.point_weights(points, ("y", "x"), 5.0)
    assert {r["id"]: r["weight"] for r in weights.collect()} == {1: 0.5, 2: 0.5, 3: 1.0}
    requests = spark.range(2000).selectExpr("id AS request", "id AS seed")
    counts = {r["id"]: r["count"] for r in L.weighted_choice(requests, weights).groupBy("id").count().collect()}
    assert sum(counts.values()) == 2000 and abs(counts[3] - 1000) < 120


def test_providers(spark):
    rows = spark.range(4000).select(L.choose_provider(F.col("id"), (1, 3)).alias("p")).groupBy("p").count().collect()
    counts = {r["p"]: r["count"] for r in rows}
    assert abs(counts[1] / 4000 - 0.75) < 0.05


def test_k_nearest_at_any_distance(spark):
    rows = [(i, (i * 7) % 13, (i * 5) % 11) for i in range(20)] + [(50, 300, 0), (51, 900, 900), (52, 905, 900)]
    p = spark.createDataFrame(rows, "id long, y long, x long")
    for k in (3, 30):
        got = sorted((r["id"], r["rank"], r["id_r"]) for r in N.k_nearest(p, p, ("y", "x"), k, "id", "id").collect())
        order = {i: sorted(((y - b) ** 2 + (x - c) ** 2, j) for j, b, c in rows if j != i)[:k] for i, y, x in rows}
        assert got == sorted((i, n + 1, j) for i, near in order.items() for n, (_, j) in enumerate(near))


@pytest.mark.parametrize("run", [(1, 2), (1, 2, 3, 5), (0, 1, 2, 3, 4, 5, 6)])
def test_runs_of_removed_nodes_are_bridged(spark, run):
    chain = [(i, i + 1) for i in range(7)] + [(2, 2), (3, 1)]
    nodes, edges = graph(spark, [(i, [float(i)]) for i in range(8)], chain)
    left, kept = G.remove_nodes(nodes, edges, spark.createDataFrame([(i,) for i in run], "id long"))
    stay = [i for i in range(8) if i not in run]
    reach = set()
    for s in stay:  # the nodes that stay and are reached through removed ones alone
        seen, todo = set(), [v for u, v in chain if u == s]
        while todo:
            if (v := todo.pop()) in run:
                todo += [w for u, w in chain if u == v and w not in seen and not seen.add(w)]
            elif v != s or (s, s) in chain:
                reach.add((s, v))
    assert sorted(r["id"] for r in left.collect()) == stay and pairs(kept) == sorted(reach)


def test_a_long_run_is_bridged(spark):
    nodes, edges = graph(spark, [(i, [0.0]) for i in range(400)], [(i, i + 1) for i in range(399)])
    _, kept = G.remove_nodes(nodes, edges, spark.range(1, 399).toDF("id"))
    assert pairs(kept) == [(0, 399)]


def test_components_of_chains_and_stars(spark):
    import random

    rng = random.Random(1)
    ids = list(range(600))
    rng.shuffle(ids)
    chains = [(ids[i], ids[i + 1]) for i in range(300)] + [(ids[400], ids[i]) for i in range(401, 600)] + [(7, 7), (ids[3], ids[2])]
    nodes, edges = graph(spark, [(i, [0.0]) for i in ids], chains)
    found = {r["id"]: r["component"] for r in G.label_components(nodes, edges.repartition(7)).collect()}
    groups = [ids[:301], ids[400:], *[[i] for i in ids[301:400]]]
    assert found == {i: min(g) for g in groups for i in g}


def test_counts_in_a_dense_cell(spark):
    """50 000 points in one cell beside a few far apart."""
    dense = spark.range(50_000).selectExpr("id", "(id * 7919 % 10007) / 10007.0D * 4 AS y", "(id * 104729 % 10009) / 10009.0D * 4 AS x")
    few = spark.createDataFrame([(60_000, 2.0, 9.0), (60_001, 90.0, 9.0), (60_002, 2.0, -4.0), (60_003, 7.0, 2.0)], "id long, y double, x double")
    got = {r["id"]: r["n"] for r in N.count_within(dense.unionByName(few), ("y", "x"), 5.0).collect()}
    rows = [tuple(r) for r in dense.unionByName(few).collect()]
    for i, y, x in rows[::5000] + rows[-4:]:
        assert got[i] == sum((y - b) ** 2 + (x - c) ** 2 <= 25.0 for _, b, c in rows)
    assert len(got) == len(rows)


def test_vector_map_within_the_own_label(spark):
    nodes, edges = graph(spark, [(1, [0.0, 0.0, 2.0]), (2, [0.0, 0.0, 9.0])], [(1, 2)])
    labels = spark.createDataFrame([(0, 0, x, 1 if x < 3 else 2) for x in range(8)], "z long, y long, x long, label int")
    rows = sorted((r["x"], r["dx"]) for r in G.vector_map(nodes, edges, nodes, 2.0, labels=labels).collect())
    assert rows == [(0, 9.0), (1, 8.0), (2, 7.0)]


def test_a_draw_that_nothing_serves_is_an_error(spark):
    requests = spark.range(5).selectExpr("id AS request", "id AS seed")
    with pytest.raises(ValueError, match="no accepted location"):
        L.shift_until(requests, (2,), Box((0,), (9,)), (1,), F.col("b_z") < 0, "z", rounds=3)
    with pytest.raises(ValueError, match="no point"):
        points = spark.createDataFrame([(1, 50.0)], "id long, z double")
        L.around_points(requests, points.selectExpr("id", "1.0D AS weight"), points, (2,), Box((0,), (9,)), "z")


def test_centered_boxes(spark):
    requests = spark.range(40).selectExpr("id AS request", "id AS seed")
    points = spark.createDataFrame([(1, 4.5), (2, 8.0), (3, 0.0)], "id long, z double")
    rows = L.around_points(requests, points.selectExpr("id", "1.0D AS weight"), points, (4,), Box((0,), (12,)), "z", centered=True).collect()
    assert {(r["id"], r["b_z"]) for r in rows} == {(1, 2), (2, 6)} and len(rows) == 40


def test_some_boxes_hold_a_point(spark):
    requests = spark.range(500).selectExpr("id AS request", "id AS seed")
    points = spark.createDataFrame([(1, 4.5), (2, 80.0)], "id long, z double")
    rows = L.around_points(requests, points.selectExpr("id", "1.0D AS weight"), points, (4,), Box((0,), (100,)), "z", p=0.3).collect()
    near = [r for r in rows if r["id"] is not None]
    assert len(rows) == 500 and 100 < len(near) < 200 and len({r["b_z"] for r in rows if r["id"] is None}) > 60
    assert all(r["b_z"] <= {1: 4.5, 2: 80.0}[r["id"]] < r["b_z"] + 4 for r in near)


def test_nodes_of_one_voxel_have_one_ball_and_grow_over_all_tasks(spark):
    """A third of all nodes lie in one voxel; what grows is dealt to every task first, and the hot voxel counts once."""
    at = [(5.0, 5.0, 5.0)] * 100 + [(float(i % 7), float(i % 11), float(i % 13)) for i in range(200)]
    nodes = spark.createDataFrame([(i, list(p)) for i, p in enumerate(at)], "id long, loc array<double>").coalesce(1)
    offsets = [(a, b, c) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3) if a * a + b * b + c * c <= 4]
    around = lambda p: [tuple(int(x) + o for x, o in zip(p, d)) for d in offsets]
    largest, sums = {}, {}
    for i, p in enumerate(at):
        for d, cell in zip(offsets, around(p)):
            largest[cell] = max(largest.get(cell, -1), i)
            sums[cell] = sums.get(cell, 0.0) + math.exp(-sum(x * x for x in d) / 2)
    assert {(r.z, r.y, r.x): r.value for r in G.rasterize(nodes, 2.0, color="id").collect()} == largest
    top = max(sums.values())
    peak = {(r.z, r.y, r.x): r.value for r in G.rasterize_peak(nodes, 1.0).collect()}
    assert peak.keys() == sums.keys() and all(abs(peak[c] - v / top) < 1e-9 for c, v in sums.items())
    inner = Box((2, 2, 2), (9, 9, 9))  # up to 11
    own = {c: 1 + (sum(c) % 2) for c in largest}
    labels = spark.createDataFrame([(*c, v) for c, v in own.items()], "z long, y long, x long, label long")
    blob = {}
    for i, p in enumerate(at):
        if all(4 <= x < 9 for x in p):
            for cell in around(p):
                if own[cell] == own[tuple(map(int, p))]:
                    blob[cell] = max(blob.get(cell, -1), i)
    assert {(r.z, r.y, r.x): r.value for r in G.blobs(nodes, labels, 2.0, inner).collect()} == blob
    tasks = G.dealt(nodes).select(F.spark_partition_id()).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
