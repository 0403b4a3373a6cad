"""The chunked data source: which files a query opens, channels, missing chunks, filters."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickfield.functions.geometry import Box
from brickfield.sources import chunked as C


@pytest.fixture
def array(spark, tmp_path):
    """A volume of 10 x 10 x 10 in chunks of 2 x 2 x 2, value by place."""
    about = C.Chunked((10, 10, 10), (2, 2, 2), "<i4", "gzip", -7)
    path = f"file://{tmp_path}/a"
    C.create_chunked(path, about)
    rows = spark.range(1000).selectExpr("id div 100 AS z", "id div 10 % 10 AS y", "id % 10 AS x", "id AS value")
    assert C.write_chunked(rows, path, about) == 125
    return path, str(tmp_path / "a")


def spoil(folder, keep=()):
    """Makes every chunk but those to keep unreadable."""
    for name in os.listdir(folder):
        if not name.startswith(".") and name not in keep:
            with open(f"{folder}/{name}", "wb") as f:
                f.write(b"no chunk")


def test_only_the_chunks_of_the_box_are_opened(spark, array):
    path, folder = array
    spoil(folder, {"1.2.3", "1.2.4"})
    box = Box((2, 5, 7), (2, 1, 3))
    rows = C.read_chunked(spark, path, box)
    assert rows.rdd.getNumPartitions() == 2
    got = {(r["z"], r["y"], r["x"]): r["value"] for r in rows.collect()}
    assert got == {(z, 5, x): 100.0 * z + 50 + x for z in (2, 3) for x in (7, 8, 9)}
    with pytest.raises(Exception):
        C.read_chunked(spark, path).collect()


def test_filters_reach_the_source(spark, array):
    path, folder = array
    C.register(spark)
    rows = spark.read.format("chunked").load(path)
    spoil(folder, {f"{z}.0.4" for z in range(5)})
    got = rows.where("y = 1 AND x > 7 AND x <= 8 AND value % 2 = 0").select("z", "value").collect()
    assert sorted((r["z"], r["value"]) for r in got) == [(z, 100.0 * z + 18) for z in range(10)]
    assert rows.where("z < 0").count() == 0 and rows.where("z > 3 AND z < 4").count() == 0
    both = rows.where("(y = 1 OR y = 0) AND x = 9 AND y < 2").agg(F.sum("value")).first()[0]
    assert both == sum(100 * z + 10 * y + 9 for z in range(10) for y in (0, 1))


def test_missing_chunks_hold_the_fill_value(spark, array):
    path, folder = array
    for name in os.listdir(folder):
        if not name.startswith(".") and name != "0.0.0":
            os.remove(f"{folder}/{name}")
    rows = C.read_chunked(spark, path, Box((0, 0, 0), (3, 2, 2)))
    assert sorted((r["z"], r["value"]) for r in rows.collect()) == [(z, 100.0 * z + 10 * y + x if z < 2 else -7.0) for z in range(3) for y, x in [(0, 0), (0, 1), (1, 0), (1, 1)]]


@pytest.mark.parametrize("shape, chunks, axes", [((5, 7), (2, 3), ("y", "x")), ((3, 4, 5, 6), (1, 2, 5, 4), ("c", "z", "y", "x")), ((2, 2, 3, 4, 3), (1, 2, 2, 2, 2), ("c0", "c1", "z", "y", "x"))])
def test_any_number_of_dimensions(spark, tmp_path, shape, chunks, axes):
    cells = np.random.default_rng(2).normal(size=shape)
    about, path = C.Chunked(shape, chunks, "<f8", None, 0, "/", named=()), f"file://{tmp_path}/n"
    assert about.axes == axes
    rows = [(*map(int, i), float(v)) for i, v in np.ndenumerate(cells)]
    C.create_chunked(path, about)
    df = spark.createDataFrame(rows, ", ".join(f"{a} long" for a in axes) + ", value double").repartition(4)
    C.write_chunked(df, path, about)
    assert C.describe(path).axes == axes
    got = C.read_chunked(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    part = C.read_chunked(spark, path, Box((1, 2), (2, 3)))
    assert sorted(map(tuple, part.collect())) == sorted(r for r in rows if 1 <= r[-3] < 3 and 2 <= r[-2] < 5)


def test_many_chunks_share_partitions(spark, array, monkeypatch):
    path, _ = array
    monkeypatch.setattr(C, "MOST_PARTITIONS", 4)
    reader = C.ChunkReader(path, C.describe(path))
    parts = reader.partitions()
    assert len(parts) == 4 and sum(p.end - p.first for p in parts) == 125
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 1000
