"""Operators on volumes of many blocks against the whole volume in one array."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickfield.functions.cells import Grid
from brickfield.operators import blocks as B, deform as D, volumes as U

SHAPE, BLOCK = (7, 9, 10), (3, 4, 4)


def rows_of(spark, cells, name="value", keep=None, kind="double"):
    """Voxel rows of arrays, a batch each."""
    rows = [(b, *map(int, i), v.item()) for b, c in enumerate(cells) for i, v in np.ndenumerate(c) if keep is None or keep[i]]
    return spark.createDataFrame(rows, f"batch_id long, z long, y long, x long, {name} {kind}").repartition(3)


def array_of(df, name, shape, low=(0, 0, 0), batches=2):
    out = np.full((batches, *shape), np.nan)
    for r in df.collect():
        at = (r["batch_id"], r["z"] - low[0], r["y"] - low[1], r["x"] - low[2])
        assert np.isnan(out[at])  # each place once
        out[at] = r[name]
    return out


@pytest.fixture(scope="module")
def cells():
    return np.random.default_rng(1).integers(-5, 9, (2, *SHAPE))


@pytest.mark.parametrize("kind", ["long", "double"])
def test_integral(spark, cells, kind):
    keep = np.random.default_rng(2).random(SHAPE) < 0.6
    keep[:3, :4, :4] = False  # a block without voxels
    found = array_of(U.integral(rows_of(spark, cells.astype("float" if kind == "double" else int), keep=keep, kind=kind), SHAPE, BLOCK), "integral", SHAPE)
    assert (found == np.where(keep, cells, 0).cumsum(1).cumsum(2).cumsum(3)).all()


def test_an_integral_shuffles_voxels_once(spark, cells):
    df = U.integral(rows_of(spark, cells, kind="long"), SHAPE, BLOCK)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "Window" not in plan


def brute_distance(label, size):
    faces = []
    for k in range(3):
        low, high = ([slice(None)] * 3 for _ in "ab")
        low[k], high[k] = slice(None, -1), slice(1, None)
        at = np.argwhere(label[tuple(low)] != label[tuple(high)]) * 2.0
        at[:, k] += 1
        faces.append(at)
    faces = np.concatenate(faces) / 2 * size
    out = np.zeros(label.shape)
    for i in np.argwhere(label > 0):
        out[tuple(i)] = np.sqrt(((faces - i * size) ** 2).sum(1).min()) if len(faces) else 0.0
    return out


@pytest.mark.parametrize("size", [(1, 1, 1), (40, 4, 3)])
@pytest.mark.parametrize("width", [64, 3])
def test_distances(spark, size, width):
    rng = np.random.default_rng(4)
    labels = [np.where(rng.random(SHAPE) < 0.02, rng.integers(0, 3, SHAPE), 1), np.full(SHAPE, 2)]
    found = array_of(U.boundary_distance(rows_of(spark, np.array(labels), "label", kind="int"), SHAPE, size, width), "distance", SHAPE)
    assert np.allclose(found, [brute_distance(x, np.array(size, float)) for x in labels])


def test_envelopes():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = rng.integers(1, 40)
        at = np.sort(rng.choice(80, n, replace=False)).astype(float) * rng.choice([0.5, 1, 3.7])
        costs = np.where(rng.random((n, 6)) < 0.3, np.inf, rng.integers(0, 900, (n, 6)).astype(float))
        out = np.arange(30) * 1.3
        assert np.allclose(U.envelope(costs, at, out), (costs[:, None, :] + ((at[:, None] - out) ** 2)[:, :, None]).min(0))


def test_a_rotation_reads_blocks_far_away(spark, cells):
    """A quarter turn, which takes a block's values from another corner, and a shift of a whole volume."""
    square = cells[:, :, :9, :9].astype(float)
    turned = lambda at: (at[0], at[2], 8 - at[1])
    found = array_of(U.deform(rows_of(spark, square), (7, 9, 9), BLOCK, turned), "value", (7, 9, 9))
    assert (found == np.rot90(square, 1, (3, 2)).transpose(0, 1, 2, 3)).all() or (found == np.rot90(square, 1, (2, 3))).all()
    far = array_of(U.deform(rows_of(spark, square), (7, 9, 9), BLOCK, lambda at: (at[0] - 5, at[1] + 2.4, at[2])), "value", (7, 9, 9))
    want = np.zeros_like(square)
    want[:, 5:, :7] = square[:, :2, 2:]
    assert (far == want).all()


def test_an_elastic_field_equals_the_formula(spark):
    """The field as data, from control points that are drawn once, and the formula of each place."""
    extent, spacing, sigma = (5, 6, 7), (3, 2, 4), (1.0, 0.0, 2.0)
    batches = spark.createDataFrame([(0, 11), (1, 12)], "batch_id long, seed long")
    angle, scale = F.col("seed") * 0.1, F.col("seed") * 0.05
    field = D.elastic_field(batches, extent, spacing, sigma, angle=angle, scale=scale)
    places = batches.crossJoin(spark.range(5 * 6 * 7).select(*[c.alias(a) for a, c in zip("zyx", Grid(extent).at(F.col("id")))]))
    draw = lambda point, axis: D.jitter(F.col("seed"), point, axis, sigma[axis])
    want = D.field(draw, [F.col(a) for a in "zyx"], [(n - 1) / 2 for n in extent], spacing, sigma, angle, scale)
    key = lambda r: (r["batch_id"], r["z"], r["y"], r["x"])
    got = {key(r): [r["s_z"], r["s_y"], r["s_x"]] for r in field.collect()}
    wanted = {key(r): [r["a"], r["b"], r["c"]] for r in places.select("batch_id", *"zyx", *[c.alias(n) for c, n in zip(want, "abc")]).collect()}
    assert len(got) == 2 * 5 * 6 * 7 and got.keys() == wanted.keys() and all(np.allclose(got[k], wanted[k]) for k in wanted)


def test_sections_slip_and_shift(spark):
    batches = spark.createDataFrame([(b, b * 7) for b in range(40)], "batch_id long, seed long")
    moves = {(r["batch_id"], r["z"]): (r["dy"], r["dx"]) for r in D.misaligned(batches, 20, 0.0, 0.2, 3).collect()}
    steps = [tuple(a - b for a, b in zip(moves[b, z + 1], moves[b, z])) for b in range(40) for z in range(19)]
    assert 0.1 < sum(s != (0, 0) for s in steps) / len(steps) < 0.3 and max(max(map(abs, s)) for s in steps) == 3
    slips = [(r["dy"], r["dx"]) for r in D.misaligned(batches, 20, 0.3, 0.0, 2).collect()]
    assert 0.2 < sum(s != (0, 0) for s in slips) / len(slips) < 0.4 and max(abs(v) for s in slips for v in s) == 2


@pytest.mark.parametrize("order", [0, 1, 3])
@pytest.mark.parametrize("size, target", [((2, 2, 2), (1, 3, 2)), ((3, 1, 4), (2, 1, 3)), ((1, 1, 1), (2, 3, 1))])
def test_resampling_equals_one_block(spark, cells, order, size, target):
    rows = cells.astype(float)
    found, extent = U.resample(rows_of(spark, rows), SHAPE, size, target, order, (2, 3, 4))
    one = spark.createDataFrame([(b, c.ravel().tolist()) for b, c in enumerate(rows)], "batch_id long, v array<double>")
    data, grid = B.resample(F.col("v"), Grid(SHAPE), size, target, order)
    want = np.array([np.array(r["v"]).reshape(grid.shape) for r in one.select("batch_id", data.alias("v")).orderBy("batch_id").collect()])
    assert extent == grid.shape and np.allclose(array_of(found, "value", extent), want)


def test_padding(spark, cells):
    rows = rows_of(spark, cells.astype(float))
    for margin in ((1, 0, 3), (8, 20, 2)):
        shape = tuple(n + 2 * p for n, p in zip(SHAPE, margin))
        low = [-p for p in margin]
        pads = [(0, 0), *[(p, p) for p in margin]]
        assert (array_of(U.pad(rows, SHAPE, margin, "reflect"), "value", shape, low) == np.pad(cells, pads, "reflect")).all()
        assert (array_of(U.pad(rows, SHAPE, margin, "constant", 4.0), "value", shape, low) == np.pad(cells, pads, constant_values=4)).all()
    one = rows_of(spark, cells[:, :1].astype(float))
    assert (array_of(U.pad(one, (1, 9, 10), (2, 0, 0), "reflect"), "value", (5, 9, 10), (-2, 0, 0)) == np.pad(cells[:, :1], [(0, 0), (2, 2), (0, 0), (0, 0)], "reflect")).all()


def test_none(spark):
    none = spark.createDataFrame([], "batch_id long, z long, y long, x long, value double")
    assert U.integral(none, SHAPE, BLOCK).count() == 0 and U.pad(none, SHAPE, (1, 1, 1)).count() == 0
    assert U.resample(none, SHAPE, (1, 1, 1), (2, 2, 2), 3, BLOCK)[0].count() == 0 and U.boundary_distance(none.withColumnRenamed("value", "label"), SHAPE).count() == 0
