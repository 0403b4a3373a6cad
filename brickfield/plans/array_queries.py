"""Queries on volumes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brickfield.functions.cells import AXES, Grid, explode
from brickfield.functions.draws import normal_sql, uniform, uniform_sql
from brickfield.functions.geometry import Box
from brickfield.operators import blocks as B, voxels as V
from brickfield.plans.fixtures import GRID, VOX, blocks, labelled, voxels

WHOLE = Box((0, 0, 0), (4, 4, 4))
QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tidy(df: DataFrame, *values: str, digits: int | None = None) -> DataFrame:
    """batch_id and whole coordinates as long, then the values, doubles rounded."""
    kinds = dict(df.dtypes)
    cols = [F.col(c).cast("long").alias(c) for c in ("batch_id", *AXES)]
    for v in values:
        cols.append((F.round(F.col(v), digits) + F.lit(0.0)).alias(v) if kinds[v] == "double" and digits is not None else F.col(v).cast("long" if kinds[v] in ("int", "bigint") else kinds[v]).alias(v))
    return df.select(*cols)


def cells(df: DataFrame, grid: Grid, *values: str, digits: int | None = None) -> DataFrame:
    return tidy(explode(df.select("batch_id", *values), grid, *values), *values, digits=digits)


@query(VOX + "SELECT batch_id, z, y, x, v AS value FROM vox WHERE z >= 1 AND z < 4 AND y >= 1 AND y < 4 AND x >= 1 AND x < 3")
def roi_crop(spark: SparkSession, d: str) -> DataFrame:
    return tidy(V.crop(voxels(spark, d), Box((1, 1, 1), (3, 3, 2))), "value")


@query(VOX + "SELECT batch_id, z, y, x, v AS value FROM vox WHERE z IN (1, 2)")
def crop_fraction(spark: SparkSession, d: str) -> DataFrame:
    return tidy(V.crop(voxels(spark, d), V.crop_fraction(WHOLE, (0.25, 0, 0), (0.25, 0, 0))), "value")


GRID_6 = "grid AS (SELECT z, y, x FROM range(0, {n}) a(z), range(0, {n}) b(y), range(0, {n}) c(x)), ids AS (SELECT vec_id AS batch_id FROM embeddings)"


@query(VOX + ", " + GRID_6.format(n=6) + " SELECT i.batch_id, g.z, g.y, g.x, coalesce(v, 1.0) AS value FROM ids i CROSS JOIN grid g LEFT JOIN vox o ON o.batch_id = i.batch_id AND o.z = g.z - 1 AND o.y = g.y - 1 AND o.x = g.x - 1")
def pad_constant(spark: SparkSession, d: str) -> DataFrame:
    data, grid = B.pad_block(F.col("value"), GRID, (1, 1, 1), "constant", 1.0)
    return cells(blocks(spark, d).select("batch_id", data.alias("value")), grid, "value")


FOLD = "(CASE WHEN ({c} - 5 + 12) % 6 < 4 THEN ({c} - 5 + 12) % 6 ELSE 6 - ({c} - 5 + 12) % 6 END)"


@query(VOX + f"SELECT o.batch_id, o.z, o.y, g.x, v AS value FROM range(0, 14) g(x) JOIN vox o ON o.x = {FOLD.format(c='g.x')}")
def pad_reflect(spark: SparkSession, d: str) -> DataFrame:
    data, grid = B.pad_block(F.col("value"), GRID, (0, 0, 5), "reflect")
    return cells(blocks(spark, d).select("batch_id", data.alias("value")), grid, "value")


@query(VOX + "SELECT batch_id, (z - 1) // 2 AS z, y, x // 2 AS x, v AS value FROM vox WHERE z % 2 = 1 AND x % 2 = 0")
def downsample(spark: SparkSession, d: str) -> DataFrame:
    return tidy(V.downsample(V.crop(voxels(spark, d), Box((1, 0, 0), (3, 4, 4))), (2, 1, 2), (1, 0, 0)), "value")


@query(VOX + "SELECT batch_id, z, y * 2 + a AS y, x * 2 + b AS x, v AS value FROM vox, range(0, 2) s(a), range(0, 2) t(b)")
def upsample(spark: SparkSession, d: str) -> DataFrame:
    return tidy(V.upsample(voxels(spark, d), (1, 2, 2)), "value")


NEAR = "least(floor(({c} + 0.5) * 2 / 3)::BIGINT, 3)"


@query(VOX + ", " + GRID_6.format(n=6) + f" SELECT i.batch_id, g.z, g.y, g.x, v AS value FROM ids i CROSS JOIN grid g JOIN vox o ON o.batch_id = i.batch_id AND o.z = {NEAR.format(c='g.z')} AND o.y = {NEAR.format(c='g.y')} AND o.x = {NEAR.format(c='g.x')}")
def resample_nearest(spark: SparkSession, d: str) -> DataFrame:
    data, grid = B.resample(F.col("value"), GRID, (3, 3, 3), (2, 2, 2), False)
    return cells(blocks(spark, d).select("batch_id", data.alias("value")), grid, "value")


AXIS = "w AS (SELECT c, least(floor(p) + k, 3)::BIGINT AS s, sum(CASE WHEN k = 0 THEN 1 - (p - floor(p)) ELSE p - floor(p) END) AS w FROM (SELECT c, greatest(0.0, least(3.0, (c + 0.5) * 2 / 3 - 0.5)) AS p FROM range(0, 6) r(c)), range(0, 2) q(k) GROUP BY ALL)"


@query(VOX + ", " + AXIS + " SELECT o.batch_id, a.c AS z, b.c AS y, e.c AS x, round(sum(v * a.w * b.w * e.w), 6) + 0.0 AS value FROM vox o JOIN w a ON a.s = o.z JOIN w b ON b.s = o.y JOIN w e ON e.s = o.x GROUP BY ALL")
def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    data, grid = B.resample(F.col("value"), GRID, (3, 3, 3), (2, 2, 2), True)
    return cells(blocks(spark, d).select("batch_id", data.alias("value")), grid, "value", digits=6)


@query(VOX + "SELECT batch_id, z, y, x, ((trunc(v * 300)::BIGINT % 256) + 256) % 256 AS value, ((trunc(v * 300)::BIGINT + 128) % 256 + 256) % 256 - 128 AS signed FROM vox")
def astype(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value") * 300
    return tidy(voxels(spark, d).withColumn("signed", V.as_type(v, "int8")).withColumn("value", V.as_type(v, "uint8")), "value", "signed")


@query(VOX + "SELECT batch_id, z, y, x, (((trunc(v * 300)::BIGINT % 256) + 256) % 256)::DOUBLE * (1.0::DOUBLE / 255.0::DOUBLE) AS value FROM vox")
def normalize(spark: SparkSession, d: str) -> DataFrame:
    return tidy(voxels(spark, d).withColumn("value", V.normalize(V.as_type(F.col("value") * 300, "uint8"), "uint8")), "value")


@query(VOX + "SELECT batch_id, z, y, x, v * 2.0::DOUBLE + -1.0::DOUBLE AS value FROM vox")
def scale_shift(spark: SparkSession, d: str) -> DataFrame:
    return tidy(voxels(spark, d).withColumn("value", V.scale_shift(F.col("value"), 2.0, -1.0)), "value")


@query(VOX + f"""SELECT batch_id, z, y, x, round(greatest(0.0, least(1.0, m + (v - m) * (0.5 + {uniform_sql('batch_id', 'z + 40')}) + ({uniform_sql('batch_id', 'z + 80')} - 0.5) * 0.2)), 6) + 0.0 AS value
FROM (SELECT *, avg(v) OVER (PARTITION BY batch_id, z) AS m FROM (SELECT batch_id, z, y, x, abs(v) AS v FROM vox))""")
def intensity_slab(spark: SparkSession, d: str) -> DataFrame:
    rows = voxels(spark, d).withColumn("value", F.abs("value"))
    scale, shift = uniform(F.col("batch_id"), F.col("z") + 40) + 0.5, (uniform(F.col("batch_id"), F.col("z") + 80) - 0.5) * 0.2
    rows = V.with_slab(rows, (1, -1, -1), mean=F.avg("value"))
    return tidy(rows.withColumn("value", V.scale_contrast(F.col("value"), F.col("mean"), scale, shift)), "value", digits=6)


@query(VOX + "SELECT batch_id, z, y, x, CASE WHEN min(label) OVER w = max(label) OVER w THEN 0 ELSE label END AS label FROM (SELECT batch_id, z, y, x, CASE WHEN label > 0 THEN 1 ELSE 0 END AS label FROM lab) WINDOW w AS (PARTITION BY batch_id, z)")
def zero_const_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).select("batch_id", *AXES, F.when(F.col("label") > 0, 1).otherwise(0).alias("label"))
    return tidy(V.zero_const_sections(rows, "label"), "label")


@query(VOX + "SELECT batch_id, 3 - z AS z, y, 3 - x AS x, v AS value FROM vox")
def mirror(spark: SparkSession, d: str) -> DataFrame:
    return tidy(V.mirror(voxels(spark, d), WHOLE, ("z", "x")), "value")


@query(VOX + "SELECT batch_id, x AS z, z AS y, y AS x, v AS value FROM vox")
def transpose(spark: SparkSession, d: str) -> DataFrame:
    return tidy(V.transpose(voxels(spark, d), (2, 0, 1)), "value")


STEP = "(floor({u} * 3)::BIGINT - 1)"


@query(VOX + f""", moves AS (SELECT batch_id, z, sum({STEP.format(u=uniform_sql('batch_id', 'z + 11'))}) OVER w AS dy, sum({STEP.format(u=uniform_sql('batch_id', 'z + 31'))}) OVER w AS dx
  FROM (SELECT DISTINCT batch_id, z FROM vox) WINDOW w AS (PARTITION BY batch_id ORDER BY z))
SELECT batch_id, z, (y + dy)::BIGINT AS y, (x + dx)::BIGINT AS x, v AS value FROM vox JOIN moves USING (batch_id, z) WHERE y + dy BETWEEN 0 AND 3 AND x + dx BETWEEN 0 AND 3""")
def shift_sections(spark: SparkSession, d: str) -> DataFrame:
    sections = blocks(spark, d).select("batch_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("z"))
    step = lambda salt: (F.floor(uniform(F.col("batch_id"), F.col("z") + salt) * 3) - 1).cast("long")
    moves = sections.withColumn("dy", step(11)).withColumn("dx", step(31))
    return tidy(V.shift_sections(voxels(spark, d), moves, WHOLE), "value")


@query(VOX + f"""SELECT batch_id, z, y, x, round(CASE WHEN u < 0.2 THEN 0.0 WHEN u < 0.5 THEN (v - m) * 0.1 + m ELSE v END, 6) + 0.0 AS value
FROM (SELECT *, avg(v) OVER (PARTITION BY batch_id, z) AS m, {uniform_sql('batch_id', 'z + 60')} AS u FROM vox)""")
def defect_sections(spark: SparkSession, d: str) -> DataFrame:
    draw = uniform(F.col("batch_id"), F.col("z") + 60)
    return tidy(V.damage_sections(voxels(spark, d), draw, missing=0.2, low_contrast=0.3, contrast_scale=0.1), "value", digits=6)


@query(VOX + "SELECT batch_id, z, y, x, round(v * (1 - a) + 0.5 * a, 6) + 0.0 AS value FROM (SELECT *, CASE WHEN z = 2 AND batch_id % 3 = 0 THEN 0.25 * x ELSE 0.0 END AS a FROM vox)")
def defect_artifacts(spark: SparkSession, d: str) -> DataFrame:
    rows = voxels(spark, d)
    artifacts = rows.where("z = 2 AND batch_id % 3 = 0").select("batch_id", *AXES, F.lit(0.5).alias("artifact"), (F.col("x") * 0.25).alias("alpha"))
    return tidy(V.blend(rows, artifacts), "value", digits=6)


@query(VOX + "SELECT o.batch_id, o.z, o.y, o.x, coalesce(i.v, 0.0) AS value FROM vox o LEFT JOIN vox i ON i.batch_id = o.batch_id AND i.z = o.z AND i.y = o.x AND i.x = 3 - o.y + (o.z % 2)")
def deform_nearest(spark: SparkSession, d: str) -> DataFrame:
    data = B.deform(F.col("value"), GRID, lambda z, y, x: (z + 0.25, x - 0.25, 3 - y + z % 2))
    return cells(blocks(spark, d).select("batch_id", data.alias("value")), GRID, "value")


@query(VOX + "SELECT batch_id, z, y, x, CASE label WHEN 1 THEN 7 WHEN 2 THEN 5 ELSE label END AS label FROM lab")
def replace_labels(spark: SparkSession, d: str) -> DataFrame:
    return tidy(labelled(spark, d).withColumn("label", V.replace_labels(F.col("label"), {1: 7, 2: 5})), "label")


@query(VOX + """, b AS (SELECT batch_id, z, y, x, CASE WHEN label > 2 THEN 1 ELSE 0 END AS m, min(CASE WHEN label > 2 THEN 1 ELSE 0 END) OVER w AS lo, max(CASE WHEN label > 2 THEN 1 ELSE 0 END) OVER w AS hi FROM lab WINDOW w AS (PARTITION BY batch_id))
SELECT batch_id, z, y, x, CASE WHEN lo = hi THEN m WHEN EXISTS (SELECT 1 FROM b o WHERE o.batch_id = b.batch_id AND o.m > 0 AND 4 * (o.z - b.z) * (o.z - b.z) + (o.y - b.y) * (o.y - b.y) + (o.x - b.x) * (o.x - b.x) <= 4) THEN 1 ELSE 0 END AS mask FROM b""")
def enlarge_mask(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks(spark, d).select("batch_id", F.transform("label", lambda v: F.when(v > 2, 1).otherwise(0)).alias("m"))
    return cells(rows.select("batch_id", B.enlarge(F.col("m"), GRID, 2.0, (2, 1, 1)).alias("mask")), GRID, "mask")


@query(VOX + """, b AS (SELECT batch_id, z, y, x, mask AS m, min(mask) OVER w AS lo, max(mask) OVER w AS hi FROM lab WINDOW w AS (PARTITION BY batch_id))
SELECT batch_id, z, y, x, CASE WHEN lo < hi AND m = 0 AND EXISTS (SELECT 1 FROM b o WHERE o.batch_id = b.batch_id AND o.m > 0 AND (o.z - b.z) ** 2 + (o.y - b.y) ** 2 + (o.x - b.x) ** 2 <= 1) THEN 0 ELSE 1 END AS free FROM b""")
def exclusive_zone(spark: SparkSession, d: str) -> DataFrame:
    return cells(blocks(spark, d).select("batch_id", B.exclusive_zone(F.col("mask"), GRID, 1.0).alias("free")), GRID, "free")


def moved_sql(axis: int) -> str:
    """The jitter along an axis between control points four voxels apart: in a volume of four, those of the corners."""
    terms = []
    for corner in range(8):
        step = [corner >> 2 & 1, corner >> 1 & 1, corner & 1]
        weight = " * ".join(f"({a} / 4.0::DOUBLE)" if s else f"(1 - {a} / 4.0::DOUBLE)" for a, s in zip(AXES, step))
        place = (step[0] * 31 + step[1]) * 37 + step[2] + 5003
        terms.append(f"{weight} * ({uniform_sql('batch_id', place * 3 + axis)} - 0.5)")
    return f"({' + '.join(terms)}) * {(12 ** 0.5)}::DOUBLE"


@query(VOX + f""", s AS (SELECT batch_id, z, y, x, {', '.join(f'floor({a} + {moved_sql(i)} + 0.5)::BIGINT AS s{a}' for i, a in enumerate(AXES))} FROM vox)
SELECT s.batch_id, s.z, s.y, s.x, coalesce(v, 0.0) AS value FROM s LEFT JOIN vox o ON o.batch_id = s.batch_id AND o.z = sz AND o.y = sy AND o.x = sx""")
def elastic_deform(spark: SparkSession, d: str) -> DataFrame:
    from brickfield.operators.deform import deform_block

    data = deform_block(F.col("value"), GRID, F.col("batch_id"), (4.0, 4.0, 4.0), (1.0, 1.0, 1.0))
    return cells(blocks(spark, d).select("batch_id", data.alias("value")), GRID, "value")


@query(VOX + f"""SELECT batch_id, z, y, x, round(greatest(0.0, least(1.0, abs(v) + {normal_sql("batch_id * 31 + batch_id * 4099 + (z * 1009 + y) * 1013 + x", 1)} * 0.1)), 6) + 0.0 AS value FROM vox""")
def noise_gaussian(spark: SparkSession, d: str) -> DataFrame:
    rows = voxels(spark, d).withColumn("value", F.abs("value"))
    return tidy(V.add_noise(rows, F.col("batch_id"), "gaussian", 0.1), "value", digits=6)


PLACE = "batch_id * 31 + batch_id * 4099 + (z * 1009 + y) * 1013 + x"


@query(VOX + f"SELECT batch_id, z, y, x, CASE WHEN {uniform_sql(PLACE, 1)} < 0.2 THEN CASE WHEN {uniform_sql(PLACE, 2)} < 0.5 THEN 0.0 ELSE 1.0 END ELSE least(1.0, abs(v)) END AS value FROM vox")
def noise_salt_and_pepper(spark: SparkSession, d: str) -> DataFrame:
    rows = voxels(spark, d).withColumn("value", F.abs("value"))
    return tidy(V.add_noise(rows, F.col("batch_id"), "s&p", 0.2), "value")


@query(VOX + f"SELECT batch_id, z, y, x, CASE WHEN {uniform_sql('batch_id', 55)} < 0.3 THEN v * 2.0 + 1.0 ELSE v END AS value FROM vox")
def augment_sometimes(spark: SparkSession, d: str) -> DataFrame:
    return tidy(V.sometimes(voxels(spark, d), F.col("batch_id"), 55, 0.3, V.scale_shift(F.col("value"), 2.0, 1.0)), "value")


def augmented_sql(rows: str, seed: str, far: int, columns: str) -> str:
    """rows (z, y, x) mirrored by draws 61 to 63 and with axes in the order of draw 67, around the middle of [0, far]."""
    mirrored = ", ".join(f"CASE WHEN {uniform_sql(seed, 61 + k)} < 0.5 THEN {far} - {a} ELSE {a} END AS m{a}" for k, a in enumerate(AXES))
    orders = ["zyx", "zxy", "yzx", "yxz", "xzy", "xyz"]
    taken = ", ".join("CASE o " + " ".join(f"WHEN {i} THEN m{o[k]}" for i, o in enumerate(orders)) + f" END AS {a}" for k, a in enumerate(AXES))
    return f"SELECT {columns}, {taken} FROM (SELECT *, {mirrored}, floor({uniform_sql(seed, 67)} * 6)::BIGINT AS o FROM {rows})"


@query(VOX + augmented_sql("vox", "batch_id", 3, "batch_id, v AS value"))
def simple_augment(spark: SparkSession, d: str) -> DataFrame:
    return tidy(V.simple_augment(voxels(spark, d), F.col("batch_id"), WHOLE), "value")


STEPS = f"""moves AS (SELECT batch_id, z, sum(CASE WHEN u >= 0.3 AND u < 0.6 THEN sy ELSE 0 END) OVER w + CASE WHEN u < 0.3 THEN sy ELSE 0 END AS dy, sum(CASE WHEN u >= 0.3 AND u < 0.6 THEN sx ELSE 0 END) OVER w + CASE WHEN u < 0.3 THEN sx ELSE 0 END AS dx
  FROM (SELECT DISTINCT batch_id, z, {uniform_sql('batch_id * 8191 + z', 71)} AS u, round_even({normal_sql('batch_id * 8191 + z', 72)} * 1.0, 0)::BIGINT AS sy, round_even({normal_sql('batch_id * 8191 + z', 74)} * 1.5, 0)::BIGINT AS sx FROM vox) WINDOW w AS (PARTITION BY batch_id ORDER BY z))"""


@query(VOX + f", {STEPS} SELECT batch_id, z, (y + dy)::BIGINT AS y, (x + dx)::BIGINT AS x, v AS value FROM vox JOIN moves USING (batch_id, z) WHERE y + dy BETWEEN 0 AND 3 AND x + dx BETWEEN 0 AND 3")
def slip_and_shift(spark: SparkSession, d: str) -> DataFrame:
    sections = blocks(spark, d).select("batch_id", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("z"))
    moves = V.section_moves(sections, F.col("batch_id"), 0.3, 0.3, (1.0, 1.5))
    return tidy(V.move_sections(voxels(spark, d), moves, WHOLE), "value")


@query(VOX + f", {STEPS}, p AS (SELECT batch_id, i AS id, z + 0.25 AS pz, y + 0.5 AS py, x + 0.75 AS px, z FROM vox) SELECT batch_id, id, (pz)::DOUBLE AS z, (py + dy)::DOUBLE AS y, (px + dx)::DOUBLE AS x FROM p JOIN moves USING (batch_id, z) WHERE py + dy >= 0 AND py + dy < 4 AND px + dx >= 0 AND px + dx < 4")
def slip_and_shift_points(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks(spark, d)
    sections = rows.select("batch_id", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("z"))
    moves = V.section_moves(sections, F.col("batch_id"), 0.3, 0.3, (1.0, 1.5))
    at = GRID.at(F.col("id"))
    points = rows.select("batch_id", F.explode(F.sequence(F.lit(0), F.lit(63)).cast("array<bigint>")).alias("id"))
    points = points.withColumns({a: c + F.lit(o) for a, c, o in zip(AXES, at, (0.25, 0.5, 0.75))})
    return V.move_sections(points, moves, WHOLE)


CUBIC = """w AS (SELECT c, greatest(0, least(3, floor(p) + k))::BIGINT AS s, sum(CASE k WHEN -1 THEN -0.5 * (1 + t) ** 3 + 2.5 * (1 + t) ** 2 - 4 * (1 + t) + 2 WHEN 0 THEN 1.5 * t ** 3 - 2.5 * t ** 2 + 1
  WHEN 1 THEN 1.5 * (1 - t) ** 3 - 2.5 * (1 - t) ** 2 + 1 ELSE -0.5 * (2 - t) ** 3 + 2.5 * (2 - t) ** 2 - 4 * (2 - t) + 2 END) AS w
  FROM (SELECT c, p, k, p - floor(p) AS t FROM (SELECT c, greatest(0.0, least(3.0, (c + 0.5) * 2 / 3 - 0.5))::DOUBLE AS p FROM range(0, 6) r(c)), range(-1, 3) q(k)) GROUP BY ALL)"""


@query(VOX + ", " + CUBIC + " SELECT o.batch_id, a.c AS z, b.c AS y, e.c AS x, round(sum(v * a.w * b.w * e.w), 6) + 0.0 AS value FROM vox o JOIN w a ON a.s = o.z JOIN w b ON b.s = o.y JOIN w e ON e.s = o.x GROUP BY ALL")
def resample_cubic(spark: SparkSession, d: str) -> DataFrame:
    data, grid = B.resample(F.col("value"), GRID, (3, 3, 3), (2, 2, 2), 3)
    return cells(blocks(spark, d).select("batch_id", data.alias("value")), grid, "value", digits=6)


@query(VOX + f""", a AS (SELECT *, {uniform_sql('batch_id', 21)} * 6.25::DOUBLE AS angle, 0.75::DOUBLE + {uniform_sql('batch_id', 22)} * 0.5::DOUBLE AS scale FROM vox),
s AS (SELECT batch_id, z, y, x, floor((z - 1.5::DOUBLE) * scale + 1.5::DOUBLE + 0.5::DOUBLE)::BIGINT AS sz, floor((cos(angle) * (y - 1.5::DOUBLE) - sin(angle) * (x - 1.5::DOUBLE)) * scale + 1.5::DOUBLE + 0.5::DOUBLE)::BIGINT AS sy,
  floor((sin(angle) * (y - 1.5::DOUBLE) + cos(angle) * (x - 1.5::DOUBLE)) * scale + 1.5::DOUBLE + 0.5::DOUBLE)::BIGINT AS sx FROM a)
SELECT s.batch_id, s.z, s.y, s.x, coalesce(v, 0.0) AS value FROM s LEFT JOIN vox o ON o.batch_id = s.batch_id AND o.z = sz AND o.y = sy AND o.x = sx""")
def deform_rotated(spark: SparkSession, d: str) -> DataFrame:
    from brickfield.operators.deform import deform_block

    seed = F.col("batch_id")
    angle, scale = uniform(seed, 21) * 6.25, uniform(seed, 22) * 0.5 + 0.75
    data = deform_block(F.col("value"), GRID, seed, (4.0, 4.0, 4.0), (0.0, 0.0, 0.0), angle, scale)
    return cells(blocks(spark, d).select("batch_id", data.alias("value")), GRID, "value")


@query(VOX + "SELECT batch_id, z, y, x, v AS value, label FROM vox JOIN lab USING (batch_id, z, y, x)")
def squeeze_channels(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks(spark, d).select("batch_id", *[B.unsqueeze(F.col(c)).alias(c) for c in ("value", "label")])
    return cells(rows.select("batch_id", *[B.squeeze(F.col(c)).alias(c) for c in ("value", "label")]), GRID, "value", "label")


@query(VOX + f""", n AS (SELECT batch_id, pow(2.0, ceil(log2(count(DISTINCT abs(v))))) AS n FROM vox GROUP BY batch_id), l AS (SELECT batch_id, z, y, x, n, abs(v) * n AS l, {uniform_sql(PLACE, 1)} AS u FROM vox JOIN n USING (batch_id)),
c AS (SELECT *, sum(CASE WHEN l > 0 THEN exp(k * ln(l) - l - lgamma(k + 1.0::DOUBLE)) WHEN k = 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY batch_id, z, y, x ORDER BY k) AS upto FROM l, range(0, 160) r(k))
SELECT batch_id, z, y, x, min(k) / any_value(n)::DOUBLE AS value FROM c WHERE u < upto GROUP BY batch_id, z, y, x""")
def noise_poisson(spark: SparkSession, d: str) -> DataFrame:
    return tidy(V.poisson_noise(voxels(spark, d).withColumn("value", F.abs("value")), F.col("batch_id")), "value")
