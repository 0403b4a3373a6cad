"""Graphs from tiles, vectors shared among partners, folded sections."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickfield.functions.geometry import Box
from brickfield.operators import graphs as G, scan as S, voxels as V


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(6)
    at = rng.uniform(0, 60, (80, 3))
    near = [(i, int(j)) for i in range(80) for j in np.argsort(((at - at[i]) ** 2).sum(1))[1:4]]
    nodes = spark.createDataFrame([(i, [float(c) for c in p]) for i, p in enumerate(at)], "id long, loc array<double>")
    return nodes, spark.createDataFrame(sorted(set(near)), "u long, v long"), at, sorted(set(near))


@pytest.mark.parametrize("shape, stride", [((20, 20, 20), (20, 20, 20)), ((30, 30, 30), (10, 10, 10)), ((60, 60, 60), (60, 60, 60))])
def test_a_graph_from_tiles(spark, graph, shape, stride):
    nodes, edges, at, pairs = graph
    boxes = S.tiles(spark, Box((0, 0, 0), (60, 60, 60)), shape, stride)
    served, kept = S.graph_of_tiles(nodes, edges, boxes, shape)
    tiles = [(r["tile"], np.array([r[f"b_{a}"] for a in "zyx"]), np.array([r[f"e_{a}"] for a in "zyx"])) for r in boxes.collect()]
    rows = served.collect()
    ids = [r["id"] for r in rows if r["temporary"]]
    assert len(set(ids)) == len(ids) and min(ids, default=80) >= 80
    for t, b, e in tiles:
        own = {i for i in range(80) if (at[i] >= b).all() and (at[i] < e).all()}
        assert {r["id"] for r in rows if r["tile"] == t and not r["temporary"]} == own
        new = [r["loc"] for r in rows if r["tile"] == t and r["temporary"]]
        assert len(new) == sum((u in own) != (v in own) for u, v in pairs)
        assert all((np.array(p) >= b - 1e-9).all() and (np.array(p) <= e).all() and (np.isclose(p, b) | np.isclose(p, e, rtol=1e-5)).any() for p in new)
    got, found = S.assemble_graph(served, kept)
    assert sorted((r["id"], tuple(r["loc"])) for r in got.collect()) == [(i, tuple(p)) for i, p in enumerate(at.tolist())]
    inside = lambda i, b, e: (at[i] >= b).all() and (at[i] < e).all()
    whole = [(u, v) for u, v in pairs if any(inside(u, b, e) and inside(v, b, e) for _, b, e in tiles)]
    assert sorted(map(tuple, found.collect())) == whole and (len(whole) == len(pairs)) == (shape[0] > 20)


def test_temporary_ids_may_be_taken_elsewhere(spark):
    nodes = spark.createDataFrame([(0, 1, False, "a"), (0, 2, True, "t"), (1, 2, False, "b"), (1, 3, False, "c"), (1, 1, False, "later")], "tile long, id long, temporary boolean, kind string")
    edges = spark.createDataFrame([(0, 1, 2), (1, 2, 3), (1, 3, 9)], "tile long, u long, v long")
    got, kept = S.assemble_graph(nodes, edges)
    assert sorted(map(tuple, got.collect())) == [(1, "later"), (2, "b"), (3, "c")] and [tuple(r) for r in kept.collect()] == [(2, 3)]


def brute_split(sources, pairs, targets, radius, size, labels=None):
    out = {}
    reach = [int(radius // s) + 1 for s in size]
    offsets = [(a, b, c) for a in range(-reach[0], reach[0] + 1) for b in range(-reach[1], reach[1] + 1) for c in range(-reach[2], reach[2] + 1) if sum((o * s) ** 2 for o, s in zip((a, b, c), size)) <= radius**2]
    for i in sorted(sources):
        at = tuple(int(c // s) for c, s in zip(sources[i], size))
        cells = sorted(tuple(a + o for a, o in zip(at, off)) for off in offsets)
        if labels is not None:
            cells = [c for c in cells if at in labels and labels.get(c) == labels[at]]
        d2 = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q))
        goals = sorted({t for s, t in pairs if s == i and t in targets}, key=lambda t: (-d2(sources[i], targets[t]), -t))
        if not goals or len(cells) < len(goals):
            continue
        share = len(cells) // len(goals)
        for k, t in enumerate(goals):
            cells.sort(key=lambda c: (d2([a * s for a, s in zip(c, size)], targets[t]), c))
            taken, cells = (cells, []) if k == len(goals) - 1 else (cells[:share], cells[share:])
            out |= {c: tuple(float(q - a * s) for q, a, s in zip(targets[t], c, size)) for c in taken}
    return out


@pytest.mark.parametrize("masked", [False, True])
def test_partners_share_a_ball(spark, masked):
    rng = np.random.default_rng(7)
    at = {i: [float(c) for c in rng.integers(0, 30, 3)] for i in range(12)}
    pairs = [(i, int(j)) for i in range(12) for j in rng.choice(12, rng.integers(0, 5), replace=False)] + [(3, j) for j in range(12)] + [(2, 99)]
    size, radius = (2, 1, 1), 2.0
    labels = {(z, y, x): int((z + y // 2) % 2) for z in range(-2, 18) for y in range(-3, 33) for x in range(-3, 33)} if masked else None
    nodes = spark.createDataFrame(sorted(at.items()), "id long, loc array<double>")
    volume = labels and spark.createDataFrame([(*k, v) for k, v in labels.items()], "z long, y long, x long, label long")
    found = G.vector_map_split(nodes, spark.createDataFrame(pairs, "u long, v long"), nodes, radius, size, volume)
    want = brute_split(at, pairs, at, radius, size, labels)
    assert {(r["z"], r["y"], r["x"]): (r["dz"], r["dy"], r["dx"]) for r in found.collect()} == want and len(want) > 40


def test_more_partners_than_voxels(spark):
    nodes = spark.createDataFrame([(i, [0.0, 0.0, float(i)]) for i in range(5)], "id long, loc array<double>")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 5)], "u long, v long")
    assert G.vector_map_split(nodes, pairs, nodes, 0.5).count() == 0


def test_folds(spark):
    """Far from the line a folded section shows what lies `strength` farther; the line is black, other sections stay."""
    n, strength, width = 24, 3, 2
    rows = [(0, z, y, x, float(100 * y + x)) for z in range(12) for y in range(-4, n + 4) for x in range(-4, n + 4)]
    df = spark.createDataFrame(rows, "batch_id long, z long, y long, x long, value double").repartition(3)
    out = V.fold_sections(df, F.col("z") * 31 + 7, F.col("z") < 9, strength, (0, 0), (n, n), width).toPandas()
    assert len(out) == 12 * n * n and not out.duplicated(["z", "y", "x"]).any()
    plain = out[out.z >= 9]
    assert (plain.value == 100 * plain.y + plain.x).all()
    for z in range(9):
        cells = out[out.z == z].sort_values(["y", "x"]).value.to_numpy().reshape(n, n)
        shift = cells - np.add.outer(100 * np.arange(n), np.arange(n))
        seen = cells != 0
        steps = set(np.round(shift[seen], 3).tolist())
        assert len(steps) <= 2 and (len(steps) < 2 or abs(sum(steps)) < 0.01)  # one displacement on each side, opposite ones
        for s in steps:  # 100 dy + dx = s with dy ** 2 + dx ** 2 = strength ** 2
            assert np.isreal(np.roots([1 + 100**2, -2 * 100 * s, s**2 - strength**2])).all()
        assert (~seen).any() and (~seen).sum() < n * n / 2
