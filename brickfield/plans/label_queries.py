"""Queries on label volumes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brickfield.functions.cells import AXES, Grid, explode
from brickfield.operators import blocks as B, graphs as G, labels as L
from brickfield.plans.array_queries import cells, tidy
from brickfield.plans.fixtures import GRID, VOX, blocks, labelled

QUERIES, SQL = {}, {}
NEIGHBORS = ((-1, 0, 0), (0, -1, 0), (0, 0, 1), (1, 1, 1))


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def shifted(offset, what: str = "label", name: str = "n") -> str:
    dz, dy, dx = offset
    return f"LEFT JOIN lab {name} ON {name}.batch_id = o.batch_id AND {name}.z = o.z + ({dz}) AND {name}.y = o.y + ({dy}) AND {name}.x = o.x + ({dx})"


SAME = "CASE WHEN o.{w} = coalesce({n}.{w}, 0) AND o.{w} > 0 THEN 1 ELSE 0 END"


@query(VOX + "SELECT o.batch_id, o.z, o.y, o.x, " + ", ".join(f"{SAME.format(w='label', n=f'n{i}')} AS a{i}" for i in range(4)) + " FROM lab o " + " ".join(shifted(o, name=f"n{i}") for i, o in enumerate(NEIGHBORS)))
def affinities(spark: SparkSession, d: str) -> DataFrame:
    cols = [B.affinities(F.col("label"), GRID, o).alias(f"a{i}") for i, o in enumerate(NEIGHBORS)]
    return cells(blocks(spark, d).select("batch_id", *cols), GRID, *[f"a{i}" for i in range(4)])


@query(VOX + ", u AS (SELECT *, CASE WHEN label > 0 THEN 1 ELSE 0 END AS known FROM lab) SELECT o.batch_id, o.z, o.y, o.x, " + SAME.format(w="label", n="n") + " AS affinity, CASE WHEN o.mask = 1 AND coalesce(n.mask, 0) = 1 AND NOT (o.label = 0 AND coalesce(n.label, 1) = 0) THEN 1 ELSE 0 END AS affinity_mask FROM lab o " + shifted((0, 0, 1)))
def affinities_masked(spark: SparkSession, d: str) -> DataFrame:
    unlabelled = F.transform("label", lambda v: F.when(v > 0, 1).otherwise(0))
    affinity, mask = B.affinities(F.col("label"), GRID, (0, 0, 1)), B.affinities_mask(F.col("mask"), F.col("u"), GRID, (0, 0, 1))
    rows = blocks(spark, d).withColumn("u", unlabelled).select("batch_id", affinity.alias("affinity"), mask.alias("affinity_mask"))
    return cells(rows, GRID, "affinity", "affinity_mask")


def weights_sql(keys: str, classes: int) -> str:
    return VOX + f""", b AS (SELECT batch_id, z, y, x, least(label, {classes - 1}) AS label, mask::DOUBLE AS scale FROM lab),
n AS (SELECT {keys}, label, sum(scale) AS n FROM b GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS total FROM n),
w AS (SELECT {keys}, label, CASE WHEN total > 0 THEN 1.0 / ({classes} * greatest(0.05, least(0.95, n / total))) ELSE 0.0 END AS w FROM t)
SELECT b.batch_id, b.z, b.y, b.x, round(b.scale * w.w, 6) + 0.0 AS weight FROM b JOIN w USING ({keys}, label)"""


@query(weights_sql("batch_id", 2))
def balance_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).withColumn("label", F.least("label", F.lit(1)))
    return tidy(L.balance(rows, 2, F.col("mask").cast("double")), "weight", digits=6)


@query(weights_sql("batch_id, z", 3))
def balance_labels_slab(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).withColumn("label", F.least("label", F.lit(2)))
    return tidy(L.balance(rows, 3, F.col("mask").cast("double"), (1, -1, -1)), "weight", digits=6)


@query(VOX + "SELECT batch_id, z, y, x, CASE WHEN label IN (1, 3) THEN 0 ELSE label END AS label FROM lab")
def exclude_labels(spark: SparkSession, d: str) -> DataFrame:
    return tidy(labelled(spark, d).withColumn("label", L.exclude(F.col("label"), (1, 3))), "label")


@query(VOX + "SELECT batch_id, z, y, x, CASE WHEN EXISTS (SELECT 1 FROM lab k WHERE k.batch_id = o.batch_id AND k.label = 2 AND (k.z - o.z) * (k.z - o.z) + (k.y - o.y) * (k.y - o.y) + (k.x - o.x) * (k.x - o.x) < 4) THEN 1 ELSE 0 END AS ignore FROM lab o")
def ignore_mask(spark: SparkSession, d: str) -> DataFrame:
    kept = F.transform("label", lambda v: F.when(v == 2, v).otherwise(0))
    rows = blocks(spark, d).withColumn("kept", kept)
    return cells(rows.select("batch_id", B.ignore_mask(F.col("kept"), GRID, 2.0).alias("ignore")), GRID, "ignore")


def eroded_sql(steps: int, flat: bool, masked: bool = False) -> str:
    near = f"abs(k.z - o.z) + abs(k.y - o.y) + abs(k.x - o.x) <= {steps}" + (" AND k.z = o.z" if flat else "")
    if not masked:
        return VOX + f"SELECT batch_id, z, y, x, CASE WHEN label > 0 AND NOT EXISTS (SELECT 1 FROM lab k WHERE k.batch_id = o.batch_id AND k.label <> o.label AND {near}) THEN label ELSE 0 END AS label FROM lab o"
    return VOX + f""", s AS (SELECT o.batch_id, o.z, o.y, o.x, o.label, o.mask, count(DISTINCT k.label) AS n, count(*) FILTER (k.label = 0) AS zero
FROM lab o LEFT JOIN lab k ON k.batch_id = o.batch_id AND k.mask = 1 AND {near} GROUP BY ALL)
SELECT batch_id, z, y, x, CASE WHEN n <= 1 AND (CASE WHEN mask = 1 THEN label > 0 ELSE zero = 0 END) THEN label ELSE 0 END AS label FROM s"""


@query(eroded_sql(1, False))
def grow_boundary_1(spark: SparkSession, d: str) -> DataFrame:
    return cells(blocks(spark, d).select("batch_id", B.grow_boundary(F.col("label"), GRID).alias("label")), GRID, "label")


@query(eroded_sql(2, True))
def grow_boundary_xy(spark: SparkSession, d: str) -> DataFrame:
    return cells(blocks(spark, d).select("batch_id", B.grow_boundary(F.col("label"), GRID, 2, True).alias("label")), GRID, "label")


@query(eroded_sql(1, False, True))
def grow_boundary_masked(spark: SparkSession, d: str) -> DataFrame:
    return cells(blocks(spark, d).select("batch_id", B.grow_boundary(F.col("label"), GRID, mask=F.col("mask")).alias("label")), GRID, "label")


@query(VOX + "SELECT o.batch_id, o.z, o.y, o.x, CASE WHEN o.label > 0 AND n.mask > 0 THEN 1 ELSE 0 END AS first, CASE WHEN o.mask > 0 AND m.label > 0 THEN 1 ELSE 0 END AS second FROM lab o " + shifted((0, -1, -2)) + " " + shifted((0, 1, 2), name="m"))
def nonsym_affinities(spark: SparkSession, d: str) -> DataFrame:
    first, second = B.nonsymmetric_affinities(F.col("label"), F.col("mask"), GRID, (0, 1, 2))
    return cells(blocks(spark, d).select("batch_id", first.alias("first"), second.alias("second")), GRID, "first", "second")


@query(VOX + "SELECT batch_id, z, y, x, CASE WHEN mask = 0 THEN max(label) OVER (PARTITION BY batch_id) + 1 ELSE label END AS negative, label AS positive FROM lab")
def prepare_malis(spark: SparkSession, d: str) -> DataFrame:
    negative, positive = B.prepare_malis(F.col("label"), F.col("mask"))
    return cells(blocks(spark, d).select("batch_id", negative.alias("negative"), positive.alias("positive")), GRID, "negative", "positive")


@query(VOX + """SELECT batch_id, z, y, x, max(edge) AS edge FROM (
  SELECT o.batch_id, 2 * o.z + a AS z, 2 * o.y + b AS y, 2 * o.x + c AS x, CASE WHEN a + b + c = 1 AND o.label <> n.label THEN 1 ELSE 0 END AS edge
  FROM lab o, (VALUES (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 1, 1)) s(a, b, c), lab n
  WHERE n.batch_id = o.batch_id AND n.z = o.z + a AND n.y = o.y + b AND n.x = o.x + c) GROUP BY ALL""")
def boundary_mask(spark: SparkSession, d: str) -> DataFrame:
    edge, fine = B.boundaries(F.col("label"), GRID)
    return cells(blocks(spark, d).select("batch_id", edge.alias("edge")), fine, "edge")


EDGES = """, faces AS (SELECT o.batch_id, 2 * o.z + a AS z, 2 * o.y + b AS y, 2 * o.x + c AS x FROM lab o, (VALUES (1, 0, 0), (0, 1, 0), (0, 0, 1)) s(a, b, c), lab n
  WHERE n.batch_id = o.batch_id AND n.z = o.z + a AND n.y = o.y + b AND n.x = o.x + c AND n.label <> o.label)"""


@query(VOX + EDGES + """SELECT o.batch_id, o.z, o.y, o.x, round(CASE WHEN label > 0 THEN least(2.0, coalesce(min(sqrt((f.z - 2 * o.z) ** 2 + (f.y - 2 * o.y) ** 2 + (f.x - 2 * o.x) ** 2) / 2), 2.0)) ELSE 0.0 END, 6) + 0.0 AS distance
FROM lab o LEFT JOIN faces f ON f.batch_id = o.batch_id GROUP BY o.batch_id, o.z, o.y, o.x, label""")
def boundary_distance(spark: SparkSession, d: str) -> DataFrame:
    return cells(B.boundary_distance(blocks(spark, d), GRID, 2.0), GRID, "distance", digits=6)


def slope(axis: str) -> str:
    w = f"(PARTITION BY batch_id, {', '.join(a for a in AXES if a != axis)} ORDER BY {axis})"
    return f"round(CASE WHEN {axis} = 0 THEN lead(v) OVER {w} - v WHEN {axis} = 3 THEN v - lag(v) OVER {w} ELSE (lead(v) OVER {w} - lag(v) OVER {w}) / 2 END, 6) + 0.0 AS d{axis}"


@query(VOX + f"SELECT batch_id, z, y, x, {slope('z')}, {slope('y')}, {slope('x')} FROM vox")
def gradient(spark: SparkSession, d: str) -> DataFrame:
    cols = [B.gradient(F.col("value"), GRID, i).alias(f"d{a}") for i, a in enumerate(AXES)]
    return cells(blocks(spark, d).select("batch_id", *cols), GRID, "dz", "dy", "dx", digits=6)


@query("WITH RECURSIVE " + VOX.removeprefix("WITH ") + """, reach(batch_id, i, root) AS (SELECT batch_id, i, i FROM lab WHERE label > 0 UNION
  SELECT n.batch_id, n.i, r.root FROM reach r JOIN lab o ON o.batch_id = r.batch_id AND o.i = r.i JOIN lab n ON n.batch_id = o.batch_id AND n.label = o.label AND abs(n.z - o.z) + abs(n.y - o.y) + abs(n.x - o.x) = 1)
SELECT batch_id, i, min(root) AS component FROM reach GROUP BY batch_id, i""")
def connected_components_vox(spark: SparkSession, d: str) -> DataFrame:
    return L.volume_components(blocks(spark, d), GRID)


@query(VOX + "SELECT batch_id, label, round(avg(z), 6) + 0.0 AS z, round(avg(y), 6) + 0.0 AS y, round(avg(x), 6) + 0.0 AS x FROM lab GROUP BY batch_id, label")
def center_of_mass(spark: SparkSession, d: str) -> DataFrame:
    found = G.center_of_mass(labelled(spark, d).withColumn("label", F.col("label").cast("long")), "batch_id", "label")
    return found.select("batch_id", "label", *[(F.round(a, 6) + F.lit(0.0)).alias(a) for a in AXES])


@query(VOX + "SELECT label::BIGINT AS label, count(*) AS n, count(DISTINCT batch_id) AS volumes FROM lab GROUP BY label")
def unique_labels(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"), F.count_distinct("batch_id").alias("volumes"))


@query(VOX + """, balanced AS (SELECT *, sum(n) OVER (PARTITION BY batch_id) AS total FROM (SELECT batch_id, least(label, 1) AS label, count(*) AS n FROM lab WHERE z >= 1 GROUP BY ALL)),
aff AS (SELECT o.batch_id, least(o.label, 1) AS label, """ + SAME.format(w="label", n="a") + " + " + SAME.format(w="label", n="b") + " + " + SAME.format(w="label", n="c") + " AS s FROM lab o " + " ".join(shifted(o, name=n) for n, o in zip("abc", ((-1, 0, 0), (0, -1, 0), (0, 0, -1)))) + """ WHERE o.z >= 1)
SELECT batch_id, sum(s)::BIGINT AS affine, round(sum(s / (2 * greatest(0.05, least(0.95, n / total)))), 6) + 0.0 AS weighted FROM aff JOIN balanced USING (batch_id, label) GROUP BY batch_id""")
def scan_affinities(spark: SparkSession, d: str) -> DataFrame:
    near = [B.affinities(F.col("label"), GRID, o).alias(f"a{i}") for i, o in enumerate(((-1, 0, 0), (0, -1, 0), (0, 0, -1)))]
    rows = explode(blocks(spark, d).select("batch_id", "label", *near), Grid(GRID.shape), "label", "a0", "a1", "a2").where("z >= 1")
    rows = L.balance(rows.withColumn("label", F.least("label", F.lit(1))))
    s = F.col("a0") + F.col("a1") + F.col("a2")
    return rows.groupBy("batch_id").agg(F.sum(s).alias("affine"), (F.round(F.sum(s * F.col("weight")), 6) + F.lit(0.0)).alias("weighted"))


FAR = EDGES + """, far AS (SELECT o.batch_id, o.z, o.y, o.x, label, CASE WHEN label > 0 THEN coalesce(min(sqrt((f.z - 2 * o.z) ** 2 + (f.y - 2 * o.y) ** 2 + (f.x - 2 * o.x) ** 2) / 2), 0.0) ELSE 0.0 END AS v
FROM lab o LEFT JOIN faces f ON f.batch_id = o.batch_id GROUP BY o.batch_id, o.z, o.y, o.x, label)"""


def raw_slope(axis: str) -> str:
    w = f"(PARTITION BY batch_id, {', '.join(a for a in AXES if a != axis)} ORDER BY {axis})"
    return f"CASE WHEN {axis} = 0 THEN lead(v) OVER {w} - v WHEN {axis} = 3 THEN v - lag(v) OVER {w} ELSE (lead(v) OVER {w} - lag(v) OVER {w}) / 2 END AS d{axis}"


@query(VOX + FAR + f""", g AS (SELECT *, {', '.join(raw_slope(a) for a in AXES)} FROM far), n AS (SELECT *, sqrt(dz ** 2 + dy ** 2 + dx ** 2) AS s FROM g)
SELECT batch_id, z, y, x, {', '.join(f"round(CASE WHEN label = 0 THEN 0.0 ELSE d{a} / (CASE WHEN s < 1e-5 THEN 1.0 ELSE s END) * (exp(-v * 0.5) * 2.0) END, 6) + 0.0 AS d{a}" for a in AXES)} FROM n""")
def distance_gradients(spark: SparkSession, d: str) -> DataFrame:
    slopes = B.distance_gradients(F.col("label"), GRID, norm="l2", decay=(0.5, 2.0))
    return cells(blocks(spark, d).select("batch_id", *[s.alias(f"d{a}") for s, a in zip(slopes, AXES)]), GRID, "dz", "dy", "dx", digits=6)


@query(VOX + FAR + "SELECT batch_id, z, y, x, round(v, 6) + 0.0 AS distance FROM far")
def boundary_distance_whole(spark: SparkSession, d: str) -> DataFrame:
    """boundary_distance, without its reach of 2."""
    return cells(B.boundary_distance(blocks(spark, d), GRID), GRID, "distance", digits=6)


@query(VOX + """, b AS (SELECT batch_id, z, y, x, mask AS m, min(mask) OVER w AS lo, max(mask) OVER w AS hi FROM lab WINDOW w AS (PARTITION BY batch_id)),
far AS (SELECT b.batch_id, b.z, b.y, b.x, b.m, b.lo, b.hi, min((o.z - b.z) ** 2 + (o.y - b.y) ** 2 + (o.x - b.x) ** 2) FILTER (o.m > 0) AS d2 FROM b JOIN b o ON o.batch_id = b.batch_id GROUP BY ALL)
SELECT batch_id, z, y, x, CASE WHEN lo = hi THEN m WHEN d2 <= 4 AND d2 > 1 THEN 1 ELSE 0 END AS mask FROM far""")
def enlarge_ring(spark: SparkSession, d: str) -> DataFrame:
    return cells(blocks(spark, d).select("batch_id", B.enlarge(F.col("mask"), GRID, 2.0, ring=0.5).alias("mask")), GRID, "mask")
