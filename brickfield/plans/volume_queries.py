"""Queries on a volume of many blocks, cells summed up from lineitem, each beside its SQL over the whole volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brickfield.functions.cells import AXES
from brickfield.functions.geometry import Box
from brickfield.functions.scratch import new_path
from brickfield.operators import blocks as B, labels as L, scan as S
from brickfield.plans.fixtures import table
from brickfield.sources import chunked as C, sinks, tables as T

QUERIES, SQL = {}, {}
EXTENT, BLOCK = (32, 32, 7), (8, 8, 4)
#: grid (batch_id, z, y, x, q, label): a sparse volume of 32 x 32 x 7 voxels.
GRID = """WITH cells AS (SELECT l_suppkey % 32 AS z, l_partkey % 32 AS y, l_linenumber::BIGINT - 1 AS x, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL),
grid AS (SELECT 0::BIGINT AS batch_id, z, y, x, q, q % 3 AS label FROM cells)
"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def grid(spark: SparkSession, d: str) -> DataFrame:
    at = [(F.col("l_suppkey") % 32).alias("z"), (F.col("l_partkey") % 32).alias("y"), (F.col("l_linenumber").cast("long") - 1).alias("x")]
    cells = table(spark, d, "lineitem").groupBy(*at).agg(F.sum("l_quantity").cast("long").alias("q"))
    return cells.select(F.lit(0).cast("long").alias("batch_id"), *AXES, "q", (F.col("q") % 3).cast("int").alias("label"))


def at(name: str, offset: tuple[int, int, int]) -> str:
    return f"LEFT JOIN grid {name} ON {name}.z = o.z + ({offset[0]}) AND {name}.y = o.y + ({offset[1]}) AND {name}.x = o.x + ({offset[2]})"


STEPS = {"a0": (-1, 0, 0), "a1": (0, -1, 0), "a2": (0, 0, -1), "a3": (2, -1, 1)}


@query(GRID + "SELECT o.z, o.y, o.x, " + ", ".join(f"CASE WHEN o.label > 0 AND {n}.label = o.label THEN 1 ELSE 0 END::BIGINT AS {n}" for n in STEPS) + " FROM grid o " + " ".join(at(n, o) for n, o in STEPS.items()))
def volume_affinities(spark: SparkSession, d: str) -> DataFrame:
    found = B.whole_volume(grid(spark, d), BLOCK, (2, 1, 1), lambda v, g: {n: B.affinities(v, g, o) for n, o in STEPS.items()}, "label")
    return found.select(*AXES, *[F.col(n).cast("long").alias(n) for n in STEPS])


@query(GRID + "SELECT o.z, o.y, o.x, CASE WHEN o.label > 0 AND NOT EXISTS (SELECT 1 FROM grid k WHERE k.label <> o.label AND abs(k.z - o.z) + abs(k.y - o.y) + abs(k.x - o.x) <= 2) THEN o.label ELSE 0 END AS label FROM grid o")
def volume_erosion(spark: SparkSession, d: str) -> DataFrame:
    found = B.whole_volume(grid(spark, d), BLOCK, (2, 2, 2), lambda v, g: {"eroded": B.grow_boundary(v, g, 2)}, "label")
    return found.select(*AXES, F.col("eroded").cast("long").alias("label"))


@query(GRID + """, faces AS (SELECT 2 * o.z + a AS z, 2 * o.y + b AS y, 2 * o.x + c AS x FROM grid o, (VALUES (1, 0, 0), (0, 1, 0), (0, 0, 1)) s(a, b, c), grid n
  WHERE n.z = o.z + a AND n.y = o.y + b AND n.x = o.x + c AND n.label <> o.label)
SELECT o.z, o.y, o.x, round(CASE WHEN label > 0 THEN least(2.0, coalesce(min(sqrt((f.z - 2 * o.z) ** 2 + (f.y - 2 * o.y) ** 2 + (f.x - 2 * o.x) ** 2) / 2), 2.0)) ELSE 0.0 END, 6) + 0.0 AS distance
FROM grid o LEFT JOIN faces f ON abs(f.z - 2 * o.z) <= 4 AND abs(f.y - 2 * o.y) <= 4 AND abs(f.x - 2 * o.x) <= 4 GROUP BY o.z, o.y, o.x, label""")
def volume_distance(spark: SparkSession, d: str) -> DataFrame:
    found = B.whole_volume(grid(spark, d), BLOCK, (3, 3, 3), lambda v, g: {"distance": B.limited_distance(v, g, 2.0)}, "label")
    return found.select(*AXES, (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


def slope(axis: int) -> str:
    step = [int(i == axis) for i in range(3)]
    n, p = f"n{axis}.q", f"p{axis}.q"
    return f"((coalesce({n}, o.q) - coalesce({p}, o.q)) / CASE WHEN {n} IS NOT NULL AND {p} IS NOT NULL THEN 2.0 ELSE 1.0 END)::DOUBLE AS d{AXES[axis]}", at(f"n{axis}", tuple(step)) + " " + at(f"p{axis}", tuple(-s for s in step))


@query(GRID + "SELECT o.z, o.y, o.x, " + ", ".join(slope(i)[0] for i in range(3)) + " FROM grid o " + " ".join(slope(i)[1] for i in range(3)))
def volume_gradient(spark: SparkSession, d: str) -> DataFrame:
    rows = grid(spark, d).withColumn("q", F.col("q").cast("double"))
    return B.whole_volume(rows, BLOCK, (1, 1, 1), lambda v, g: {f"d{a}": B.gradient(v, g, i) for i, a in enumerate(AXES)}, "q").drop("batch_id")


@query("WITH RECURSIVE " + GRID.removeprefix("WITH ") + """, n AS (SELECT z, y, x, label, (z * 32 + y) * 7 + x AS id FROM grid WHERE label > 0),
pairs AS (SELECT a.id AS u, b.id AS v FROM n a JOIN n b ON a.label = b.label AND ((b.z = a.z + 1 AND b.y = a.y AND b.x = a.x) OR (b.z = a.z AND b.y = a.y + 1 AND b.x = a.x) OR (b.z = a.z AND b.y = a.y AND b.x = a.x + 1))),
both_ways AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach(id, root) AS (SELECT id, id FROM n UNION SELECT b.v, r.root FROM reach r JOIN both_ways b ON b.u = r.id)
SELECT n.z, n.y, n.x, min(root) AS component FROM reach JOIN n USING (id) GROUP BY n.z, n.y, n.x""")
def volume_components(spark: SparkSession, d: str) -> DataFrame:
    return L.whole_components(grid(spark, d), BLOCK, EXTENT).drop("batch_id")


@query(GRID + "SELECT z, y, x, q::DOUBLE AS value FROM grid WHERE z >= 5 AND z < 21 AND y >= 9 AND y < 30 AND x >= 1 AND x < 6")
def volume_written(spark: SparkSession, d: str) -> DataFrame:
    """The volume written tile by tile, tiles overlapping, and a box of it read back."""
    path, total = new_path(spark, "volume"), Box((0, 0, 0), EXTENT)
    pieces = S.cut(grid(spark, d).select("batch_id", *AXES, F.col("q").cast("double").alias("value")), S.tiles(spark, total, (20, 20, 7)), (8, 8, 8))
    sinks.write_volume(pieces, path, total, block=8)
    return T.read_voxels(spark, path, Box((5, 9, 1), (16, 21, 5))).select(*AXES, "value")


@query(GRID + """SELECT a.z, b.y, c.x, coalesce(q, -1)::DOUBLE AS value FROM range(5, 30) a(z), range(0, 32) b(y), range(2, 7) c(x) LEFT JOIN grid g ON g.z = a.z AND g.y = b.y AND g.x = c.x""")
def volume_chunked(spark: SparkSession, d: str) -> DataFrame:
    """The volume as a chunked array with chunks that its shape doesn't divide into, written in two disjoint parts, and a box of it read back."""
    path, about = new_path(spark, "chunked"), C.Chunked(EXTENT, (10, 16, 4), "<i8", "zlib", -1)
    rows = grid(spark, d).select(*AXES, F.col("q").alias("value"))
    C.create_chunked(path, about)
    for part in (rows.where("z < 20"), rows.where("z >= 20")):
        C.write_chunked(part, path, about)
    return C.read_chunked(spark, path, Box((5, 0, 2), (25, 32, 5)))
