import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickfield.functions.geometry import Box
from brickfield.functions.model import Linear, checkpoints, predict, train
from brickfield.operators import scan as S
from brickfield.sources import chunked as C, sinks, tables as T
from brickfield.streaming import requests as R


def test_csv_points(spark, tmp_path):
    (tmp_path / "a.csv").write_text("0\t1.5\n2\t3\n-1\t7\n")
    rows = T.read_csv_points(spark, str(tmp_path / "a.csv"), (0, 1), delimiter="\t")
    assert [tuple(r["loc"]) for r in rows.orderBy("id").collect()] == [(0, 1.5), (2, 3), (-1, 7)]
    assert T.points_box(rows, 2) == Box((-1, 1), (4, 7))
    (tmp_path / "b.csv").write_text("x, y, z, id\n1, 2, 3, 40\n4, 5, 6, 0\n")
    rows = T.read_csv_points(spark, str(tmp_path / "b.csv"), (0, 2, 1), header=True, scale=2, id_column=3)
    assert {r["id"]: tuple(r["loc"]) for r in rows.collect()} == {40: (2, 6, 4), 0: (8, 12, 10)}


def test_chunks(spark, tmp_path):
    for i in range(3):
        (np.arange(8, dtype="<u2") + 10 * i).tofile(tmp_path / f"c{i}.raw")
    rows = T.read_chunks(spark, str(tmp_path), "*.raw", (2, 2, 2), "<u2").orderBy("chunk").collect()
    assert [r["data"][0] for r in rows] == [0, 10, 20] and [r["chunk"] for r in rows] == [0, 1, 2]
    with pytest.raises(Exception, match="holds 8 cells"):
        T.read_chunks(spark, str(tmp_path), "*.raw", (2, 2, 3), "<u2").collect()


def test_graph_source(spark):
    nodes = spark.createDataFrame([(1, 1.0, 2.0), (2, 50.0, 2.0), (3, None, 2.0), (4, 3.0, 3.0)], "id long, a double, b double")
    edges = spark.createDataFrame([(1, 2), (1, 4), (3, 4)], "u long, v long")
    n, e = T.read_graph(nodes, edges, ["a", "b"], Box((0, 0), (10, 10)))
    assert {r["id"] for r in n.collect()} == {1, 4} and [tuple(r) for r in e.select("u", "v").collect()] == [(1, 4)]


def test_volume_round_trip_and_pushdown(spark, tmp_path):
    rows = spark.range(64).selectExpr("0L AS batch_id", "CAST(id DIV 16 AS INT) AS z", "CAST(id DIV 4 % 4 AS INT) AS y", "CAST(id % 4 AS INT) AS x", "CAST(id AS DOUBLE) AS value")
    boxes = S.tiles(spark, Box((0, 0, 0), (4, 4, 4)), (3, 3, 3))
    path = str(tmp_path / "volume")
    sinks.write_volume(S.cut(rows, boxes, (2, 2, 2)), path, Box((0, 0, 0), (4, 4, 4)), block=2)
    back = T.read_voxels(spark, path, Box((1, 0, 0), (2, 4, 4)))
    assert sorted(r["value"] for r in back.collect()) == [float(v) for v in range(16, 48)]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "GreaterThanOrEqual(z,1)" in plan


def test_snapshots(spark, tmp_path):
    batches = spark.range(10).selectExpr("id AS iteration", "CAST(id AS DOUBLE) / 2 AS value")
    sinks.write_snapshots(batches, str(tmp_path / "s"), 3)
    assert {r["iteration"] for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {0, 3, 6, 9}
    assert sinks.value_range(batches).where("iteration = 4").first()["low"] == 2.0


def test_stream_of_requests(spark, tmp_path):
    voxels = spark.range(100).selectExpr("CAST(id AS INT) AS z", "CAST(id AS DOUBLE) AS value")
    for i in range(4):
        spark.createDataFrame([(i, i * 20, i * 20 + 5)], "request long, b_z long, e_z long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("request long, b_z long, e_z long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    served, numbers = [], []

    def write(batch, number):
        numbers.append(number)
        served.extend((r["request"], r["value"]) for r in batch.collect())

    R.snapshots(R.serve(stream, voxels, ("z",), (8,)), 2, write, str(tmp_path / "cp")).awaitTermination(120)
    assert numbers == [0, 2] and len(served) == 10
    assert all(r * 20 <= v < r * 20 + 5 for r, v in served)


def test_places_in_turn(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(7, 10 * i + k) for k in range(2)], "client long, request long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client long, request long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = R.in_turn(stream, 4).writeStream.format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["place"] for r in spark.table("turns").collect()) == [0, 0, 1, 1, 2, 3]


def test_event_windows(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b"), ("2024-01-01 09:00:00", "b")], "t string, event_type string")
    events.selectExpr("CAST(t AS TIMESTAMP) AS ts", "event_type").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "e"))
    q = R.events_per_window(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [1, 1, 2]


def test_model_learns_and_skips_empty(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3
    df = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "batch_id long, x array<double>, y double")
    model = Linear(4)
    losses = train(df, model, 25, 0.4)
    assert losses[-1] < 1e-2 * losses[0] and all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))
    blank = df.unionByName(spark.createDataFrame([(999, [0.0] * 4, 0.0)], df.schema))
    got = {r["batch_id"]: r["prediction"] for r in predict(blank, model, 4, skip_empty=True).collect()}
    assert got[999] == 0.0 and len(got) == 201 and abs(got[0] - y[0]) < 0.5
    assert abs(predict(blank, model, 4).where(F.col("batch_id") == 999).first()["prediction"] - 3) < 0.5


def test_csv_numbers_follow_the_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("0,0\n1,0\n")
    (tmp_path / "b.csv").write_text("".join(f"{i + 2},0\n" for i in range(40)))
    rows = T.read_csv_points(spark, str(tmp_path), (0, 1)).collect()
    assert sorted((r["id"], r["loc"][0]) for r in rows) == [(i, float(i)) for i in range(42)]


@pytest.mark.parametrize("packer, separator, dtype", [("zlib", ".", "<u2"), (None, "/", ">f4"), ("gzip", "/", "|i1")])
def test_chunked_arrays(spark, tmp_path, packer, separator, dtype):
    path = f"{tmp_path}/array"
    about = C.Chunked((5, 7, 3), (2, 4, 3), dtype, packer, 9, separator, (20, 2, 2), (100, 0, -4))
    rows = spark.range(105).selectExpr("id DIV 21 AS z", "id DIV 3 % 7 AS y", "id % 3 AS x", "CAST(id % 90 AS INT) AS value")
    C.create_chunked(path, about)
    assert C.describe(path) == about and about.box == Box((100, 0, -4), (100, 14, 6)) and about.smooth == (dtype == ">f4")
    assert C.write_chunked(rows.where("z < 2"), path, about) == 2 and C.write_chunked(rows.where("z = 4 AND y < 4"), path, about) == 1
    want = {(i // 21, i // 3 % 7, i % 3): float(i % 90) for i in range(105) if i < 42 or (i >= 84 and i // 3 % 7 < 4)}
    got = {(r["z"], r["y"], r["x"]): r["value"] for r in C.read_chunked(spark, path).collect()}
    assert got == {(z, y, x): want.get((z, y, x), 9.0) for z in range(5) for y in range(7) for x in range(3)}
    part = C.read_chunked(spark, path, Box((1, 3, 1), (2, 9, 1))).collect()
    assert {(r["z"], r["y"], r["x"]): r["value"] for r in part} == {k: v for k, v in got.items() if k[0] in (1, 2) and k[1] >= 3 and k[2] == 1}


def test_what_no_reader_unpacks_is_refused(tmp_path):
    (tmp_path / ".zarray").write_text(json.dumps({"shape": [1, 1, 1], "chunks": [1, 1, 1], "dtype": "<f4", "compressor": {"id": "blosc"}, "order": "C", "filters": None, "fill_value": 0}))
    with pytest.raises(ValueError, match="packed by blosc"):
        C.describe(str(tmp_path))


def test_tiles_of_a_function(spark):
    tiles = S.tiles(spark, Box((0, 0, 0), (3, 2, 2)), (2, 2, 2))
    rows = T.provided(tiles, lambda box: np.full(box.shape, float(box.begin[0]))).collect()
    assert sorted((r["tile"], r["z"], r["value"]) for r in rows) == sorted((t, t + z, float(t)) for t in (0, 1) for z in (0, 1) for _ in range(4))
    with pytest.raises(Exception, match="served with cells of shape"):
        T.provided(tiles, lambda box: np.zeros((1, 1, 1))).collect()


def test_training_goes_on_from_what_was_saved(spark, tmp_path):
    rows = [(i, [float(i % 5), float(i % 3)], float(2 * (i % 5) - i % 3 + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "batch_id long, x array<double>, y double")
    whole, first, second = Linear(2), Linear(2), Linear(2)
    losses = train(df, whole, 9, 0.05)
    folder = f"{tmp_path}/saved"
    begun = train(df, first, 5, 0.05, folder, every=2)
    assert [n for n, _ in checkpoints(folder)] == [2, 4, 5]
    assert begun + train(df, second, 9, 0.05, folder, every=2) == pytest.approx(losses) and np.allclose(second.weights, whole.weights)


def test_snapshots_on_a_condition(spark, tmp_path):
    batches = spark.range(12).selectExpr("id AS iteration", "CAST(id AS DOUBLE) / 2 AS value")
    sinks.write_snapshots(batches, str(tmp_path / "s"), 3, keep=F.col("value") > 1, kinds={"value": "int"})
    assert {(r["iteration"], r["value"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {(3, 1), (6, 3), (9, 4)}
