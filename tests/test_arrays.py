"""Small volumes whose value is z + y + x or their own number, so any shift or stride shows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickfield.functions.cells import Grid, explode, gather
from brickfield.functions.draws import mixed, uniform
from brickfield.functions.geometry import Box
from brickfield.operators import blocks as B, labels as L, scan as S, voxels as V


def block(spark, arr, name="value", batch=0):
    kind = "double" if arr.dtype.kind == "f" else "int"
    return spark.createDataFrame([(batch, arr.ravel().tolist())], f"batch_id long, {name} array<{kind}>"), Grid(arr.shape)


def run(df, grid, col):
    return np.array(df.select(col.alias("o")).first()["o"], dtype=float).reshape(grid.shape)


@pytest.fixture(scope="module")
def ramp():
    return np.add.outer(np.add.outer(np.arange(3), np.arange(4)), np.arange(5)).astype(float)


def test_pad_is_numpy_pad(spark, ramp):
    df, g = block(spark, ramp)
    for mode in ("constant", "reflect"):
        col, out = B.pad_block(F.col("value"), g, (1, 2, 3), mode, 7.0)
        pads = ((1, 1), (2, 2), (3, 3))
        want = np.pad(ramp, pads, mode, constant_values=7.0) if mode == "constant" else np.pad(ramp, pads, mode)
        assert (run(df, out, col) == want).all()


def test_crop_undoes_pad(spark, ramp):
    df, g = block(spark, ramp)
    padded, out = B.pad_block(F.col("value"), g, (1, 1, 1))
    back, small = B.crop_block(F.col("p"), out, (1, 1, 1), g.shape)
    assert (run(df.withColumn("p", padded), small, back) == ramp).all()


def test_strides(spark, ramp):
    df, g = block(spark, ramp)
    rows = explode(df, g, "value")
    down = {(r["z"], r["y"], r["x"]): r["value"] for r in V.downsample(rows, (1, 2, 3)).collect()}
    want = ramp[:, ::2, ::3]
    assert len(down) == want.size and all(want[k] == v for k, v in down.items())
    up = V.upsample(rows, (2, 1, 3))
    assert up.count() == ramp.size * 6
    again = {(r["z"], r["y"], r["x"]): r["value"] for r in V.downsample(up, (2, 1, 3)).collect()}
    assert all(ramp[k] == v for k, v in again.items()) and len(again) == ramp.size


def test_mirror_twice_is_nothing(spark, ramp):
    df, g = block(spark, ramp)
    rows, box = explode(df, g, "value"), Box((0, 0, 0), ramp.shape)
    twice = V.mirror(V.mirror(rows, box, "zyx"), box, "zyx")
    assert sorted(map(tuple, twice.select("z", "y", "x", "value").collect())) == sorted(map(tuple, rows.select("z", "y", "x", "value").collect()))


def test_wraparound(spark):
    values = [-1.5, 0.0, 255.9, 256.0, 300.0, -129.0, 128.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for kind in ("uint8", "int8", "uint16", "int32"):
        got = [r[0] for r in df.select(V.as_type(F.col("v"), kind)).collect()]
        assert got == np.array(values).astype(np.int64).astype(kind).tolist()


def test_affinities_are_symmetric(spark):
    lab = np.random.default_rng(0).integers(0, 3, (3, 4, 4))
    df, g = block(spark, lab, "label")
    ahead = run(df, g, B.affinities(F.col("label"), g, (1, 0, -1)))
    back = run(df, g, B.affinities(F.col("label"), g, (-1, 0, 1)))
    assert (ahead[:-1, :, 1:] == back[1:, :, :-1]).all()
    want = (lab[:-1, :, 1:] == lab[1:, :, :-1]) & (lab[:-1, :, 1:] > 0)
    assert (ahead[:-1, :, 1:] == want).all() and ahead[-1].sum() == 0


def test_balance_weights_sum(spark):
    lab = np.array([[[0, 0, 0, 1]]])
    df, g = block(spark, lab, "label")
    rows = {r["x"]: r["weight"] for r in L.balance(explode(df, g, "label")).collect()}
    assert rows == {0: 1 / 1.5, 1: 1 / 1.5, 2: 1 / 1.5, 3: 2.0}
    clipped = np.zeros((1, 1, 100), dtype=int)
    clipped[0, 0, 0] = 1
    df, g = block(spark, clipped, "label")
    assert {r["x"]: round(r["weight"], 6) for r in L.balance(explode(df, g, "label")).where("x < 2").collect()} == {0: 10.0, 1: round(1 / 1.9, 6)}


def test_balance_all_masked_out(spark):
    df, g = block(spark, np.array([[[0, 1]]]), "label")
    assert {r["weight"] for r in L.balance(explode(df, g, "label"), scale=F.lit(0.0)).collect()} == {0.0}


def test_uniform_mask_is_not_enlarged(spark):
    for v in (0, 1):
        df, g = block(spark, np.full((2, 2, 2), v), "m")
        assert (run(df, g, B.enlarge(F.col("m"), g, 2.0)) == v).all()


def test_halo_gives_what_one_block_gives(spark):
    lab = np.random.default_rng(2).integers(0, 3, (4, 6, 8))
    df, g = block(spark, lab, "label")
    whole = run(df, g, B.affinities(F.col("label"), g, (0, 1, 1)))
    grown, out = B.with_halo(explode(df, g, "label"), (2, 3, 4), (0, 1, 1), "label")
    cells = grown.select("bz", "by", "bx", B.affinities(F.transform("label", lambda v: F.coalesce(v, F.lit(0))), out, (0, 1, 1)).alias("a"))
    got = np.zeros(lab.shape)
    for r in cells.where("bz < 2 AND by < 2 AND bx < 2 AND bz >= 0 AND by >= 0 AND bx >= 0").collect():
        inner = np.array(r["a"]).reshape(out.shape)[:, 1:-1, 1:-1]
        got[r["bz"] * 2 : r["bz"] * 2 + 2, r["by"] * 3 : r["by"] * 3 + 3, r["bx"] * 4 : r["bx"] * 4 + 4] = inner
    assert (got == whole).all()


def test_gather_undoes_explode(spark, ramp):
    df, g = block(spark, ramp)
    assert gather(explode(df, g, "value"), g, ["batch_id"], "value").first()["value"] == ramp.ravel().tolist()


@pytest.mark.parametrize("shape", [(2, 2, 2), (3, 4, 5), (1, 3, 2)])
def test_scan_of_any_tiles_is_the_source(spark, ramp, shape):
    df, g = block(spark, ramp)
    rows = explode(df, g, "value")
    boxes = S.tiles(spark, Box((0, 0, 0), ramp.shape), shape)
    assert boxes.agg(F.max("e_x")).first()[0] == 5
    whole = S.assemble(S.cut(rows, boxes, (2, 2, 2)))
    assert sorted(map(tuple, whole.select("z", "y", "x", "value").collect())) == sorted(map(tuple, rows.select("z", "y", "x", "value").collect()))


def test_tile_too_large(spark):
    with pytest.raises(ValueError):
        S.tiles(spark, Box((0, 0, 0), (2, 2, 2)), (3, 1, 1))


def test_draws(spark):
    df = spark.range(20000)
    rows = df.select(uniform(F.col("id"), 3).alias("u"), mixed(F.col("id"), 3).alias("m")).toPandas()
    assert rows["u"].between(0, 1, "left").all() and abs(rows["u"].mean() - 0.5) < 0.02 and rows["m"].nunique() > 19900


def test_noise_is_the_same_in_any_partitioning(spark, ramp):
    df, g = block(spark, ramp / 10)
    rows = explode(df, g, "value")
    for mode in ("gaussian", "speckle", "s&p"):
        a, b = (sorted(map(tuple, V.add_noise(x, F.lit(5), mode).collect())) for x in (rows, rows.repartition(5)))
        assert a == b and all(0 <= r[-1] <= 1 for r in a)
    with pytest.raises(ValueError):
        V.add_noise(rows, F.lit(5), "pink")


def test_components_across_blocks(spark):
    local = spark.createDataFrame([(0, 0), (1, 0), (8, 8), (9, 8), (20, 20)], "node long, root long")
    faces = spark.createDataFrame([(1, 8)], "u long, v long")
    assert {r["node"]: r["root"] for r in L.joined_components(local, faces).collect()} == {0: 0, 1: 0, 8: 0, 9: 0, 20: 20}


def test_bad_crop_fraction():
    with pytest.raises(ValueError):
        V.crop_fraction(Box((0, 0, 0), (4, 4, 4)), (0.5, 0, 0), (0.5, 0, 0))
    assert V.crop_fraction(Box((120, 8, 6), (1600, 90, 70)), (0.25, 0, 0), (0.125, 0.1, 0)) == Box((520, 8, 6), (1000, 81, 70))


def test_draws_of_neighbouring_salts_are_apart(spark):
    df = spark.range(5000)
    u = df.select(*[uniform(F.col("id"), k).alias(f"u{k}") for k in range(4)]).toPandas()
    assert u.corr().to_numpy()[~np.eye(4, dtype=bool)].__abs__().max() < 0.06
    assert len({tuple(r) for r in (u * 6).astype(int).to_numpy()}) > 1150


def test_null_blocks_and_cells(spark):
    df = spark.createDataFrame([(1, [1, 1, 2, None]), (2, None), (3, [2, 2, 2, 2]), (4, None)], "batch_id long, label array<int>").coalesce(1)
    g = Grid((1, 1, 4))
    rows = df.select("batch_id", B.affinities(F.col("label"), g, (0, 0, 1)).alias("a"), B.grow_boundary(F.col("label"), g).alias("e"), B.gradient(F.transform("label", lambda v: v.cast("double")), g, 2).alias("d"))
    got = {r["batch_id"]: (r["a"], r["e"], r["d"]) for r in rows.collect()}
    assert got[2] == got[4] == (None, None, None)
    assert got[1] == ([1, 0, 0, 0], [1, 0, 0, 0], [0.0, 0.5, 1.0, None]) and got[3] == ([1, 1, 1, 0], [2] * 4, [0.0] * 4)
    assert df.where("batch_id = 2").select(B.affinities(F.col("label"), g, (0, 0, 1)).alias("a")).first()["a"] is None


def test_whole_volume_equals_one_block(spark):
    rng = np.random.default_rng(6)
    lab = rng.integers(0, 3, (5, 7, 9))
    df, g = block(spark, lab, "label")
    rows = explode(df, g, "label")
    compute = lambda v, grid: {"a": B.affinities(v, grid, (1, -1, 2)), "e": B.grow_boundary(v, grid, 2), "far": B.limited_distance(v, grid, 1.5)}
    one = df.select(*[c.alias(n) for n, c in compute(F.col("label"), g).items()]).first()
    got = B.whole_volume(rows, (2, 3, 4), (3, 3, 3), compute, "label").collect()
    assert len(got) == lab.size
    for n in ("a", "e", "far"):
        want = np.array(one[n]).reshape(lab.shape)
        assert all(abs(want[r["z"], r["y"], r["x"]] - r[n]) < 1e-12 for r in got), n


def test_components_of_a_whole_volume(spark):
    """A label that winds through many blocks, and lone voxels."""
    lab = np.zeros((6, 6, 9), dtype=int)
    lab[0, 0, :], lab[0, :, 8], lab[:, 5, 8], lab[5, :, 8], lab[5, 0, 2:8] = 1, 1, 1, 1, 1
    lab[2, 2, 2], lab[2, 2, 3], lab[2, 2, 4] = 1, 2, 1
    df, g = block(spark, lab, "label")
    two = explode(df, g, "label").unionByName(explode(df, g, "label").withColumn("batch_id", F.col("batch_id") + 1))
    for shape in ((2, 2, 2), (4, 3, 5), (6, 6, 9)):
        rows = L.whole_components(two, shape, lab.shape).collect()
        first = min(r["batch_id"] for r in rows)
        got = {(r["batch_id"] - first, r["z"], r["y"], r["x"]): r["component"] for r in rows}
        assert len(got) == 2 * (lab > 0).sum() and len(set(got.values())) == 8
        number = lambda b, z, y, x: (((first + b) * 6 + z) * 6 + y) * 9 + x
        for b in (0, 1):
            assert got[(b, 5, 0, 2)] == got[(b, 0, 0, 0)] == number(b, 0, 0, 0) and got[(b, 2, 2, 3)] == number(b, 2, 2, 3)


def test_labels_outside_the_classes_are_refused(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0, 1), (0, 0, 0, 1, 2)], "batch_id long, z int, y int, x int, label int")
    assert L.balance(rows, 3).count() == 2
    for label in (2, -1, None):
        with pytest.raises(Exception, match="label outside"):
            L.balance(rows.withColumn("label", F.lit(label).cast("int")), 2).select("weight").collect()


def test_mirrored_and_transposed(spark):
    cube = np.arange(27).reshape(3, 3, 3)
    df, g = block(spark, cube)
    many = explode(df, g, "value").drop("batch_id").crossJoin(spark.range(400).withColumnRenamed("id", "batch_id"))
    box = Box((0, 0, 0), (3, 3, 3))
    turned, seen = {}, {np.transpose(cube[tuple(slice(None, None, s) for s in signs)], o).tobytes() for signs in itertools.product((1, -1), repeat=3) for o in itertools.permutations(range(3))}
    for r in V.simple_augment(many, F.col("batch_id"), box).collect():
        turned.setdefault(r["batch_id"], np.full((3, 3, 3), -1))[r["z"], r["y"], r["x"]] = r["value"]
    kinds = [a.tobytes() for a in turned.values()]
    assert set(kinds) <= seen and len(set(kinds)) > 40
    still = V.simple_augment(many, F.col("batch_id"), box, mirror=(0, 0, 0), orders={(0, 1, 2): 1.0})
    assert still.select("batch_id", *"zyx", "value").exceptAll(many.select("batch_id", *"zyx", "value")).isEmpty()
    with pytest.raises(ValueError, match="different lengths"):
        V.simple_augment(many, F.col("batch_id"), Box((0, 0, 0), (3, 3, 4)))
    points = spark.createDataFrame([(0.0, 1.0, 2.0, 0), (0.5, 0.25, 2.5, 1)], "z double, y double, x double, id long")
    moved = V.simple_augment(points, F.lit(0), box, mirror=(1, 0, 0), orders={(0, 2, 1): 1.0}, points=True).collect()
    assert [(r["z"], r["y"], r["x"], r["id"]) for r in moved] == [(2.5, 2.5, 0.25, 1)]  # the other one now lies on the far side


def test_slips_and_shifts(spark):
    sections = spark.range(60).withColumnRenamed("id", "z").withColumn("batch_id", F.lit(3).cast("long"))
    of = lambda slip, shift: [(r["dy"], r["dx"]) for r in V.section_moves(sections, F.col("batch_id"), slip, shift, (3.0, 0.0)).orderBy("z").collect()]
    alone, along = of(1.0, 0.0), of(0.0, 1.0)
    assert all(dx == 0 for _, dx in alone + along) and of(0.0, 0.0) == [(0, 0)] * 60
    assert np.cumsum([dy for dy, _ in alone]).tolist() == [dy for dy, _ in along] and len({dy for dy, _ in alone}) > 4
    with pytest.raises(ValueError, match="either slips or shifts"):
        of(0.6, 0.6)


def test_cubic_keeps_a_ramp(spark):
    ramp = np.broadcast_to(np.arange(12.0), (3, 3, 12))
    df, g = block(spark, ramp)
    data, fine = B.resample(F.col("value"), g, (1, 1, 4), (1, 1, 3), 3)
    got = np.array(df.select(data.alias("v")).first()["v"]).reshape(fine.shape)
    assert fine.shape == (3, 3, 16) and np.allclose(got[:, :, 3:-3], ((np.arange(16) + 0.5) * 0.75 - 0.5)[3:-3])
