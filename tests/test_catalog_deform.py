import numpy as np
import pytest
from pyspark.sql import functions as F

from brickfield.functions.cells import Grid
from brickfield.functions.geometry import Box
from brickfield.operators import deform as D
from brickfield.plans.catalog import Catalog, Spec


def test_requests_are_centred():
    asked = Catalog().asked({"raw": (400, 30, 34), "labels": (200, 10, 14)})
    assert asked.specs["labels"].box == Box((100, 10, 10), (200, 10, 14)) and asked.total == asked.specs["raw"].box
    assert asked.common == asked.specs["labels"].box


def test_specs():
    a = Spec(Box((0,), (10,)), (2,), "uint8")
    b = a.updated(Spec(Box((20,), (5,)), dtype="float32"))
    assert b.box == Box((0,), (25,)) and b.dtype == "float32" and b.voxel_size == (2,) and a.smooth and not Spec(dtype="uint64").smooth
    assert a.unsqueezed().channels == (1,) and a.unsqueezed().squeezed() == a
    for bad in (lambda: a.squeezed(), lambda: a.unsqueezed(2), lambda: Spec(Box((0,), (1,)), nonspatial=True)):
        with pytest.raises(ValueError):
            bad()


def test_catalogs(spark):
    offer = Catalog({"raw": Spec(Box((0, 0), (100, 100)), (4, 2), "float32"), "seg": Spec(Box((20, 20), (40, 40)), (2, 3), "uint64"), "n": Spec(Box((0, 0), (None, 9)), graph=True, directed=True)})
    assert Catalog({k: offer.specs[k] for k in ("raw", "seg")}).voxel_size == (4, 6) and offer.common_keys(Catalog({"seg": Spec()})) == {"seg"}
    offer.check(Catalog({"raw": Spec(Box((4, 2), (8, 8)), (4, 2))}))
    for bad in ({"x": Spec()}, {"raw": Spec(Box((0, 0), (101, 1)))}, {"raw": Spec(Box((1, 0), (4, 4)))}, {"raw": Spec(voxel_size=(1, 1))}, {"raw": Spec(dtype="uint8")}, {"n": Spec(directed=False)}):
        with pytest.raises(ValueError):
            offer.check(Catalog(bad))
    with pytest.raises(ValueError):
        offer.merged(Catalog({"raw": Spec()}))
    rows = {r["key"]: r for r in offer.table(spark).collect()}
    assert rows["n"]["kind"] == "graph" and rows["n"]["shape"] == [None, 9] and rows["raw"]["interpolatable"]


def test_points_move_with_the_volume(spark):
    shape = (6, 12, 12)
    g, lab = Grid(shape), np.zeros((6, 12, 12))
    at = {1: (2, 4, 4), 2: (3, 8, 7)}
    for i, (z, y, x) in at.items():
        lab[z, y - 1 : y + 2, x - 1 : x + 2] = i
    df = spark.createDataFrame([(5, lab.ravel().tolist())], "seed long, v array<double>")
    out = np.array(df.select(D.deform_block(F.col("v"), g, F.col("seed"), (4, 4, 4), (0.0, 1.0, 1.0)).alias("o")).first()["o"]).reshape(shape)
    places = spark.range(g.size).select(*[c.alias(a) for a, c in zip("zyx", g.at(F.col("id")))])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in at.items()], "id long, z double, y double, x double")
    moved = {r["id"]: r for r in D.deform_points(points, places, F.lit(5), [(n - 1) / 2 for n in shape], (4, 4, 4), (0.0, 1.0, 1.0)).collect()}
    for i in at:
        center = np.argwhere(out == i).mean(axis=0)
        assert np.abs(center - [moved[i][a] for a in "zyx"]).max() < 2


def test_no_jitter_is_nothing(spark):
    v = np.arange(27.0)
    df = spark.createDataFrame([(1, v.tolist())], "seed long, v array<double>")
    turned = D.deform_block(F.col("v"), Grid((3, 3, 3)), F.col("seed"), (2, 2, 2), (0, 0, 0), angle=F.lit(np.pi / 2), scale=F.lit(1.0))
    row = df.select(D.deform_block(F.col("v"), Grid((3, 3, 3)), F.col("seed"), (2, 2, 2), (0, 0, 0)).alias("a"), turned.alias("b")).first()
    assert row["a"] == v.tolist() and (np.array(row["b"]).reshape(3, 3, 3) == np.rot90(v.reshape(3, 3, 3), 1, (2, 1))).all()


def test_recomputed_points_are_all_there(spark):
    """A field that stretches strongly leaves points out, unless their nearest place is sought at any distance."""
    shape, sigma, spacing = (6, 12, 12), (0.0, 4.0, 4.0), (4, 4, 4)
    center = [(n - 1) / 2 for n in shape]
    places = spark.range(6 * 12 * 12).select(*[c.alias(a) for a, c in zip("zyx", Grid(shape).at(F.col("id")))])
    points = spark.range(60).selectExpr("id", "CAST(id % 6 AS DOUBLE) AS z", "id * 7 % 12 + 0.25D AS y", "id * 5 % 12 + 0.5D AS x")
    few, every = (D.deform_points(points, places, F.lit(3), center, spacing, sigma, again).collect() for again in (False, True))
    assert len(few) < len(every) == 60
    source = D.field(lambda p, axis: D.jitter(F.lit(3), p, axis, sigma[axis]), [F.col(a) for a in "zyx"], center, spacing, sigma)
    spread = [((r["z"], r["y"], r["x"]), np.array([r["sz"], r["sy"], r["sx"]])) for r in places.select(*"zyx", *[c.alias(f"s{a}") for a, c in zip("zyx", source)]).collect()]
    found = {r["id"]: (r["z"], r["y"], r["x"]) for r in every}
    for p in points.collect():
        assert found[p["id"]] == min(spread, key=lambda s: (((s[1] - [p["z"], p["y"], p["x"]]) ** 2).sum().round(9), s[0]))[0]
    assert all(found[r["id"]] == (r["z"], r["y"], r["x"]) for r in few)


def test_turns_about_three_axes(spark):
    v = np.arange(27.0)
    df = spark.createDataFrame([(1, v.tolist())], "seed long, v array<double>")
    cube, g, half = v.reshape(3, 3, 3), Grid((3, 3, 3)), F.lit(np.pi / 2)
    turn = lambda *angles: D.deform_block(F.col("v"), g, F.col("seed"), (2, 2, 2), (0, 0, 0), angle=angles)
    zero = F.lit(0.0)
    row = df.select(turn(half, zero, zero).alias("a"), turn(zero, half, zero).alias("b"), turn(zero, zero, half).alias("c")).first()
    for name, axes in zip("abc", ((2, 1), (2, 0), (1, 0))):
        assert (np.array(row[name]).reshape(3, 3, 3) == np.rot90(cube, 1, axes)).all()


def test_normal_jitter(spark):
    at = [F.col("id") % 20, F.floor(F.col("id") / 20) % 20, F.floor(F.col("id") / 400)]
    rows = spark.range(8000).select(*[D.jitter(F.lit(9), at, k, 2.0, True).alias(f"a{k}") for k in range(3)]).toPandas()
    assert (rows.std() - 2).abs().max() < 0.1 and rows.mean().abs().max() < 0.1 and rows.corr().to_numpy()[0, 1] < 0.05
    assert (rows.abs() > 4).mean().between(0.03, 0.06).all()


def test_placeholders_are_not_read():
    asked = Catalog({"raw": Spec(box=Box((0,), (4,))), "labels": Spec(placeholder=True)})
    assert asked.wanted() == {"raw"} and asked.skips({"labels"}) and not asked.skips({"raw", "labels"})
