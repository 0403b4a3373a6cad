"""Volumes, points and annotations from files that Spark reads: Parquet, CSV, JSON and binary chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from brickfield.functions.cells import AXES
from brickfield.functions.geometry import Box
from brickfield.functions.scratch import written
from brickfield.operators.graphs import numbered


def read_voxels(spark: SparkSession, path: str, box: Box | None = None) -> DataFrame:
    """Voxel rows from Parquet; the box's literal bounds reach the scan."""
    rows = spark.read.parquet(path)
    return rows.where(box.holds(*map(F.col, AXES))) if box else rows


def read_csv_points(spark: SparkSession, path: str, spatial: Sequence[int], *, header: bool = False, scale: float | Sequence[float] = 1.0, id_column: int | None = None, delimiter: str = ",", box: Box | None = None) -> DataFrame:
    """id and loc from columns of a CSV file. Without an id column, ids number the rows, file by file in the order of their names."""
    scales = [scale] * len(spatial) if isinstance(scale, (int, float)) else list(scale)
    raw = spark.read.csv(path, header=header, sep=delimiter)
    raw = raw.toDF(*[f"c{i}" for i in range(len(raw.columns))])
    loc = F.array(*[F.trim(f"c{i}").cast("double") * float(s) for i, s in zip(spatial, scales)])
    if id_column is None:
        # Partitions are dealt by size, not in the order of files, so a file and the place in it tell the order.
        raw = raw.withColumn("_file", F.input_file_name()).withColumn("_i", F.monotonically_increasing_id())
        raw = numbered(written(raw.withColumn("_start", F.input_file_block_start()), "csv"), "_file", "_start", "_i")
        ids = F.col("number")
    else:
        ids = F.trim(f"c{id_column}")
    points = raw.select(ids.cast("long").alias("id"), loc.alias("loc"))
    return points.where(box.holds(*[F.col("loc")[i] for i in range(len(spatial))])) if box else points


def points_box(points: DataFrame, dims: int) -> Box:
    """From the floor of the least to one past the ceiling of the largest location."""
    aggs = [f(F.col("loc")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("a", F.min), ("b", F.max))]
    r = points.agg(*aggs).first()
    import math

    begin = tuple(math.floor(r[f"a{i}"]) for i in range(dims))
    return Box(begin, tuple(math.ceil(r[f"b{i}"]) + 1 - b for i, b in enumerate(begin)))


def read_chunks(spark: SparkSession, path: str, pattern: str, shape: Sequence[int], dtype: str) -> DataFrame:
    """chunk (number of the file in the order of names) and data (doubles) of files that hold raw C-order cells of one dtype."""
    import numpy as np
    import pyarrow as pa

    size = int(np.prod(shape))

    def kernel(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cells = np.frombuffer(content, dtype=dtype)
                if len(cells) != size:
                    raise ValueError(f"{name} holds {len(cells)} cells, not {size}")
                yield pa.record_batch({"path": pa.array([name]), "data": pa.array([cells.astype(float)], pa.list_(pa.float64()))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    names = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    order = numbered(names, "path").select("path", F.col("number").alias("chunk"))
    return files.mapInArrow(kernel, "path string, data array<double>").join(order, "path").select("chunk", "data")


ANNOTATION = T.StructType([
    T.StructField("Pos", T.ArrayType(T.LongType())), T.StructField("Kind", T.StringType()), T.StructField("Tags", T.ArrayType(T.StringType())),
    T.StructField("Prop", T.MapType(T.StringType(), T.StringType())),
    T.StructField("Rels", T.ArrayType(T.StructType([T.StructField("Rel", T.StringType()), T.StructField("To", T.ArrayType(T.LongType()))]))),
])


def read_annotations(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Points (id, kind, loc) and partners (id, relation, partner) of JSON annotations, one a row.

    A partner is named by its location, so partners come from a join of locations.
    """
    a = lines.select(F.from_json(column, ANNOTATION).alias("a")).where("a.Pos IS NOT NULL").select("a.*")
    points = numbered(a.withColumn("key", F.array_join("Pos", ",")), "key")
    loc = F.transform("Pos", lambda v: v.cast("double"))
    rels = points.select(F.col("number").alias("id"), F.explode("Rels").alias("r")).select("id", F.col("r.Rel").alias("relation"), F.array_join("r.To", ",").alias("key"))
    partners = rels.join(points.select("key", F.col("number").alias("partner")), "key").select("id", "relation", "partner")
    return points.select(F.col("number").alias("id"), F.col("Kind").alias("kind"), loc.alias("loc")), partners


def provided(tiles: DataFrame, provide, axes: Sequence[str] = AXES) -> DataFrame:
    """tile, z, y, x and value (double) from a function of the user's: provide(Box) gives the array of a box's voxels.

    tiles has tile, b_<axis> and e_<axis>; each task calls the function for its own.
    """
    import numpy as np
    import pyarrow as pa

    def kernel(batches):
        for b in batches:
            for r in b.to_pylist():
                box = Box(tuple(r[f"b_{a}"] for a in axes), tuple(r[f"e_{a}"] - r[f"b_{a}"] for a in axes))
                cells = np.asarray(provide(box), dtype=float)
                if cells.shape != box.shape:
                    raise ValueError(f"{box} was served with cells of shape {cells.shape}")
                at = [(c + o).ravel() for c, o in zip(np.indices(box.shape), box.begin)]
                yield pa.record_batch({"tile": pa.array(np.full(cells.size, r["tile"]))} | {a: pa.array(c) for a, c in zip(axes, at)} | {"value": pa.array(cells.ravel())})

    rows = tiles.select(F.col("tile").cast("long").alias("tile"), *[F.col(f"{p}_{a}").cast("long").alias(f"{p}_{a}") for a in axes for p in "be"])
    return rows.mapInArrow(kernel, "tile long, " + "".join(f"{a} long, " for a in axes) + "value double")


def read_graph(nodes: DataFrame, edges: DataFrame, position: str | Sequence[str], box: Box) -> tuple[DataFrame, DataFrame]:
    """Nodes in box, with loc from a vector or from scalar columns, and the edges among them. Nodes without a position go."""
    loc = F.col(position) if isinstance(position, str) else F.array(*[F.col(c).cast("double") for c in position])
    rows = nodes.withColumn("loc", loc).where(F.col("loc").isNotNull() & ~F.exists("loc", lambda v: v.isNull()))
    dims = len(box.begin)
    rows = rows.where(box.holds(*[F.col("loc")[i] for i in range(dims)]))
    ids = rows.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi")
    return rows, kept
