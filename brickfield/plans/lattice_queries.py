"""Queries on volumes that grow with embeddings: 512 vectors, cubes of 4 x 4 x 4 each, make a volume of 32 x 32 x 32 voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brickfield.functions.cells import AXES
from brickfield.functions.draws import uniform, uniform_sql
from brickfield.functions.scratch import new_path, written
from brickfield.functions import model as M
from brickfield.operators import blocks as B, deform as D, volumes as U, voxels as V
from brickfield.plans.fixtures import PTS, points, table
from brickfield.sources import chunked as C

QUERIES, SQL = {}, {}
EXTENT, BLOCK = (32, 32, 32), (16, 16, 16)
#: vol (batch_id, z, y, x, v); places: every place of every batch.
VOL = """WITH cells AS (SELECT vec_id // 512 AS batch_id, vec_id % 512 AS c, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
vol AS MATERIALIZED (SELECT batch_id, c // 64 * 4 + i // 16 AS z, c // 8 % 8 * 4 + i // 4 % 4 AS y, c % 8 * 4 + i % 4 AS x, v FROM cells),
batches AS (SELECT DISTINCT batch_id FROM vol), places AS MATERIALIZED (SELECT batch_id, a.z, b.y, c.x FROM batches, range(0, 32) a(z), range(0, 32) b(y), range(0, 32) c(x))
"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def volumes(spark: SparkSession, d: str) -> DataFrame:
    """batch_id, z, y, x and value."""
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 512).alias("batch_id"), (F.col("vec_id") % 512).alias("_c"), F.posexplode("embedding").alias("_i", "_v"))
    c, i = F.col("_c"), F.col("_i")
    whole = lambda n, by: F.floor(n / by)
    z, y, x = whole(c, 64) * 4 + whole(i, 16), whole(c, 8) % 8 * 4 + whole(i, 4) % 4, c % 8 * 4 + i % 4
    return rows.select("batch_id", z.alias("z"), y.alias("y"), x.alias("x"), F.col("_v").cast("double").alias("value"))


def batches(spark: SparkSession, d: str) -> DataFrame:
    """batch_id and seed."""
    number = F.floor(F.col("vec_id") / 512)
    return table(spark, d, "embeddings").select(number.alias("batch_id")).distinct().withColumn("seed", F.col("batch_id") + 3)


def tidy(df: DataFrame, *names: str) -> DataFrame:
    return df.select("batch_id", *[F.col(a).cast("long").alias(a) for a in AXES], *[(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names])


@query(VOL + """, n AS (SELECT p.*, coalesce(floor(v * 100), 0)::BIGINT AS n FROM places p LEFT JOIN vol USING (batch_id, z, y, x)),
a AS (SELECT batch_id, z, y, x, sum(n) OVER (PARTITION BY batch_id, y, x ORDER BY z) AS n FROM n), b AS (SELECT batch_id, z, y, x, sum(n) OVER (PARTITION BY batch_id, z, x ORDER BY y) AS n FROM a)
SELECT batch_id, z, y, x, sum(n) OVER (PARTITION BY batch_id, z, y ORDER BY x)::BIGINT AS integral FROM b""")
def volume_integral(spark: SparkSession, d: str) -> DataFrame:
    rows = volumes(spark, d).withColumn("value", F.floor(F.col("value") * 100).cast("long"))
    return U.integral(rows, EXTENT, BLOCK)


@query(VOL + """, lab AS MATERIALIZED (SELECT batch_id, z, y, x, CASE WHEN v > 0.3 THEN 2 ELSE 1 END AS label FROM vol),
faces AS MATERIALIZED (SELECT o.batch_id, 2 * o.z + a AS z, 2 * o.y + b AS y, 2 * o.x + c AS x FROM lab o, (VALUES (1, 0, 0), (0, 1, 0), (0, 0, 1)) s(a, b, c), lab n
  WHERE n.batch_id = o.batch_id AND n.z = o.z + a AND n.y = o.y + b AND n.x = o.x + c AND n.label <> o.label),
near AS (SELECT o.batch_id, o.z, o.y, o.x, min((f.z - 2 * o.z) ** 2 + (f.y - 2 * o.y) ** 2 + (f.x - 2 * o.x) ** 2) AS d FROM lab o JOIN faces f USING (batch_id) GROUP BY ALL)
SELECT batch_id, z, y, x, round(sqrt(coalesce(d, 0)) / 2, 6) + 0.0 AS distance FROM lab LEFT JOIN near USING (batch_id, z, y, x)""")
def volume_distance_exact(spark: SparkSession, d: str) -> DataFrame:
    """Of each voxel to the nearest face between labels, however far."""
    labels = volumes(spark, d).withColumn("label", F.when(F.col("value") > 0.3, 2).otherwise(1)).drop("value")
    return tidy(U.boundary_distance(labels, EXTENT), "distance")


def field_sql(spacing: int, sigma: float) -> str:
    """CTE moved: where each place comes from by the control points alone."""
    axes = [f"({uniform_sql('batch_id + 3', f'((a * 31 + b) * 37 + c + 5003) * 3 + {k}')} - 0.5) * {12**0.5 * sigma!r}::DOUBLE AS d{k}" for k in range(3)]
    weight = " * ".join(f"(CASE WHEN {s} = 1 THEN {a} / {spacing}.0::DOUBLE - {a} // {spacing} ELSE 1 - ({a} / {spacing}.0::DOUBLE - {a} // {spacing}) END)" for s, a in zip("abc", AXES))
    n = 32 // spacing + 1
    return f""", points AS MATERIALIZED (SELECT batch_id, a, b, c, {', '.join(axes)} FROM batches, range(0, {n}) r(a), range(0, {n}) s(b), range(0, {n}) t(c)),
weights AS (SELECT p.*, s.a, s.b, s.c, {weight.replace('CASE WHEN a', 'CASE WHEN s.a').replace('CASE WHEN b', 'CASE WHEN s.b').replace('CASE WHEN c', 'CASE WHEN s.c')} AS w
  FROM places p, (SELECT a, b, c FROM range(0, 2) r(a), range(0, 2) s(b), range(0, 2) t(c)) s),
moved AS (SELECT w.batch_id, w.z, w.y, w.x, w.z + sum(w * d0) AS mz, w.y + sum(w * d1) AS my, w.x + sum(w * d2) AS mx FROM weights w JOIN points q ON q.batch_id = w.batch_id AND q.a = w.z // {spacing} + w.a AND q.b = w.y // {spacing} + w.b AND q.c = w.x // {spacing} + w.c
  GROUP BY w.batch_id, w.z, w.y, w.x)"""


LOOK_UP = """SELECT s.batch_id, s.z, s.y, s.x, {more}round(coalesce(v, 0.0), 6) + 0.0 AS value FROM s
LEFT JOIN vol o ON o.batch_id = s.batch_id AND o.z = floor(s.sz + 0.5) AND o.y = floor(s.sy + 0.5) AND o.x = floor(s.sx + 0.5)"""


@query(VOL + field_sql(8, 2.0) + f""", t AS (SELECT *, {uniform_sql('batch_id + 3', 21)} * 6.25::DOUBLE AS angle, 0.75::DOUBLE + {uniform_sql('batch_id + 3', 22)} * 0.5::DOUBLE AS scale FROM moved),
s AS (SELECT batch_id, z, y, x, (mz - 15.5) * scale + 15.5 AS sz, (cos(angle) * (my - 15.5) - sin(angle) * (mx - 15.5)) * scale + 15.5 AS sy, (sin(angle) * (my - 15.5) + cos(angle) * (mx - 15.5)) * scale + 15.5 AS sx FROM t)
""" + LOOK_UP.format(more=""))
def volume_deformed(spark: SparkSession, d: str) -> DataFrame:
    """Jittered control points, a rotation and a scale for each batch, over volumes of many blocks."""
    seed = F.col("seed")
    field = D.elastic_field(batches(spark, d), EXTENT, (8, 8, 8), (2.0, 2.0, 2.0), angle=uniform(seed, 21) * 6.25, scale=uniform(seed, 22) * 0.5 + 0.75)
    return tidy(U.from_source(volumes(spark, d), EXTENT, BLOCK, field), "value")


@query(VOL + field_sql(8, 1.5) + f""", drawn AS (SELECT batch_id, z, {uniform_sql('batch_id + 3', 'z * 8 + 60')} AS r, floor({uniform_sql('batch_id + 3', 'z * 8 + 61')} * 7)::BIGINT - 3 AS oy, floor({uniform_sql('batch_id + 3', 'z * 8 + 62')} * 7)::BIGINT - 3 AS ox FROM batches, range(0, 32) r(z)),
off AS (SELECT batch_id, z, sum(CASE WHEN r > 0.1 AND r <= 0.2 THEN oy ELSE 0 END) OVER w + CASE WHEN r <= 0.1 THEN oy ELSE 0 END AS dy, sum(CASE WHEN r > 0.1 AND r <= 0.2 THEN ox ELSE 0 END) OVER w + CASE WHEN r <= 0.1 THEN ox ELSE 0 END AS dx
  FROM drawn WINDOW w AS (PARTITION BY batch_id ORDER BY z)),
s AS (SELECT m.batch_id, m.z, m.y, m.x, mz AS sz, my + dy AS sy, mx + dx AS sx FROM moved m JOIN off USING (batch_id, z))
""" + LOOK_UP.format(more="round(s.sz, 6) + 0.0 AS s_z, round(s.sy, 6) + 0.0 AS s_y, round(s.sx, 6) + 0.0 AS s_x, "))
def volume_field(spark: SparkSession, d: str) -> DataFrame:
    """A field with slips and shifts of sections, written as a chunked array of three channels a batch, read back and applied."""
    own = batches(spark, d)
    field = D.elastic_field(own, EXTENT, (8, 8, 8), (1.5, 1.5, 1.5), sections=D.misaligned(own, EXTENT[0], 0.1, 0.1, 3))
    n = own.agg(F.max("batch_id")).first()[0]
    about = C.Chunked((0 if n is None else n + 1, 3, *EXTENT), (1, 3, *BLOCK), named=("batch_id", "c", *AXES))
    path = new_path(spark, "field")
    C.create_chunked(path, about)
    channels = F.posexplode(F.array(*[f"s_{a}" for a in AXES])).alias("c", "value")
    C.write_chunked(field.select("batch_id", *AXES, channels), path, about)
    read = C.read_chunked(spark, path).groupBy("batch_id", *AXES).agg(*[F.max(F.when(F.col("c") == k, F.col("value"))).alias(f"s_{a}") for k, a in enumerate(AXES)])
    read = written(read.join(own.select("batch_id"), "batch_id", "left_semi"), "field-read")
    image = U.from_source(volumes(spark, d), EXTENT, BLOCK, read)
    return tidy(image.join(read, ["batch_id", *AXES]), "s_z", "s_y", "s_x", "value")


def cubic_sql() -> str:
    """CTE w: by new place c the weight of each old place s, from voxels of size 2 to voxels of size 3."""
    return """, w AS (SELECT c, greatest(0, least(31, floor(p) + k))::BIGINT AS s, sum(CASE k WHEN -1 THEN -0.5 * (1 + t) ** 3 + 2.5 * (1 + t) ** 2 - 4 * (1 + t) + 2 WHEN 0 THEN 1.5 * t ** 3 - 2.5 * t ** 2 + 1
  WHEN 1 THEN 1.5 * (1 - t) ** 3 - 2.5 * (1 - t) ** 2 + 1 ELSE -0.5 * (2 - t) ** 3 + 2.5 * (2 - t) ** 2 - 4 * (2 - t) + 2 END) AS w
  FROM (SELECT c, p, k, p - floor(p) AS t FROM (SELECT c, greatest(0.0, least(31.0, (c + 0.5) * 3 / 2 - 0.5))::DOUBLE AS p FROM range(0, 21) r(c)), range(-1, 3) q(k)) GROUP BY ALL)
"""


@query(VOL + cubic_sql() + """, grid AS (SELECT batch_id, a.c AS z, b.c AS y, e.c AS x FROM batches, range(0, 21) a(c), range(0, 21) b(c), range(0, 21) e(c)),
along AS (SELECT batch_id, z, y, e.c AS x, sum(v * e.w) AS v FROM vol JOIN w e ON e.s = x GROUP BY ALL), both_axes AS (SELECT batch_id, z, b.c AS y, x, sum(v * b.w) AS v FROM along JOIN w b ON b.s = y GROUP BY ALL),
new AS (SELECT batch_id, a.c AS z, y, x, sum(v * a.w) AS v FROM both_axes JOIN w a ON a.s = z GROUP BY ALL)
SELECT batch_id, z, y, x, round(coalesce(v, 0.0), 6) + 0.0 AS value FROM grid LEFT JOIN new USING (batch_id, z, y, x)""")
def volume_resampled(spark: SparkSession, d: str) -> DataFrame:
    """Cubic, from voxels of size 2 to voxels of size 3."""
    rows, _ = U.resample(volumes(spark, d), EXTENT, (2, 2, 2), (3, 3, 3), 3, (8, 8, 8))
    whole = batches(spark, d).select("batch_id")
    for a in AXES:
        whole = whole.withColumn(a, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(20).cast("long"))))
    rows = whole.join(rows, ["batch_id", *AXES], "left").fillna(0.0, ["value"])
    return tidy(rows, "value")


@query(VOL + """, turned AS (SELECT i, CASE WHEN i < 0 THEN -i WHEN i > 31 THEN 62 - i ELSE i END AS s FROM range(-6, 38) r(i))
SELECT batch_id, a.i AS z, b.i AS y, c.i AS x, round(v, 6) + 0.0 AS value FROM vol JOIN turned a ON a.s = z JOIN turned b ON b.s = y JOIN turned c ON c.s = x""")
def volume_reflected(spark: SparkSession, d: str) -> DataFrame:
    return tidy(U.pad(volumes(spark, d), EXTENT, (6, 6, 6), "reflect"), "value")


def fold_sql(strength: int, width: int) -> str:
    """CTE lines: of each folded section where its line begins and ends, in the section grown by strength."""
    n, seed = 32 + 2 * strength, "batch_id * 4099 + z + 5"
    draw = lambda k: f"floor({uniform_sql(seed, k)} * {1 << 20})::BIGINT"
    return f""", lines AS MATERIALIZED (SELECT *, (last - first) / {n - 1}.0::DOUBLE AS slope FROM (
  SELECT batch_id, z, {uniform_sql(seed, 81)} < 0.5 AS across, 1 + {draw(82)} % {n - 3} AS first, 1 + {draw(83)} % {n - 3} AS last FROM batches, range(0, 32) r(z) WHERE {uniform_sql(seed, 80)} < 0.25)),
past AS (SELECT l.*, p.y, p.x, CASE WHEN across THEN p.x + {strength} - first - (p.y + {strength}) * slope ELSE p.y + {strength} - first - (p.x + {strength}) * slope END AS past FROM vol p JOIN lines l USING (batch_id, z)),
steps AS (SELECT *, CASE WHEN past > 0 THEN 1 ELSE -1 END * CASE WHEN across THEN -slope ELSE 1 END * {strength}.0::DOUBLE / sqrt(1 + slope * slope) AS sy,
  CASE WHEN past > 0 THEN 1 ELSE -1 END * CASE WHEN across THEN 1 ELSE -slope END * {strength}.0::DOUBLE / sqrt(1 + slope * slope) AS sx, abs(past) <= greatest(1.0, abs(slope)) * {width + 0.5} AS black FROM past),
taken AS (SELECT s.batch_id, s.z, s.y, s.x, sum(CASE WHEN black THEN 0.0 ELSE coalesce(v, 0.0) * (CASE a WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE b WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) END) AS value
  FROM steps s, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(a, b) LEFT JOIN vol o ON o.batch_id = s.batch_id AND o.z = s.z AND o.y = s.y + floor(sy) + a AND o.x = s.x + floor(sx) + b GROUP BY ALL)"""


@query(VOL + fold_sql(3, 1) + """ SELECT batch_id, z, y, x, round(value, 6) + 0.0 AS value FROM taken
UNION ALL SELECT batch_id, z, y, x, round(v, 6) + 0.0 FROM vol WHERE (batch_id, z) NOT IN (SELECT (batch_id, z) FROM lines)""")
def volume_folded(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of all sections folded along a line, which is black."""
    seed = F.col("batch_id") * 4099 + F.col("z") + 5
    return tidy(V.fold_sections(volumes(spark, d), seed, uniform(seed, 80) < 0.25, 3, (0, 0), (32, 32), 1), "value")


POINT_FIELD = field_sql(4, 1.0).replace("batch_id + 3", "7").replace("range(0, 9)", "range(0, 4)")


@query(PTS + """, batches AS (SELECT 0 AS batch_id), places AS MATERIALIZED (SELECT 0 AS batch_id, a.z, b.y, c.x FROM range(0, 9) a(z), range(0, 9) b(y), range(0, 9) c(x))""" + POINT_FIELD + """,
p AS (SELECT id, z % 9 + 0.25 AS z, y % 9 AS y, x % 9 - 0.125 AS x FROM pts),
near AS (SELECT id, min({'d': (m.mz - p.z) ** 2 + (m.my - p.y) ** 2 + (m.mx - p.x) ** 2, 'z': m.z, 'y': m.y, 'x': m.x}) AS n FROM p, moved m GROUP BY id)
SELECT id, n.z::BIGINT AS z, n.y::BIGINT AS y, n.x::BIGINT AS x FROM near""")
def deform_points(spark: SparkSession, d: str) -> DataFrame:
    """Each point at the place whose source lies nearest to it, at any distance."""
    rows = points(spark, d).select("id", *[(F.col(a) % 9 + o).cast("double").alias(a) for a, o in zip(AXES, (0.25, 0.0, -0.125))])
    places = spark.range(9**3).select(*[c.cast("long").alias(a) for a, c in zip(AXES, (F.floor(F.col("id") / 81), F.floor(F.col("id") / 9) % 9, F.col("id") % 9))])
    return D.deform_points(rows, places, F.lit(7), (4.0, 4.0, 4.0), (4, 4, 4), (1.0, 1.0, 1.0)).select("id", *[F.col(a).cast("long").alias(a) for a in AXES])


@query(SQL["volume_distance_exact"].replace("SELECT batch_id, z, y, x, round(sqrt(coalesce(d, 0)) / 2, 6) + 0.0 AS distance FROM lab LEFT JOIN near USING (batch_id, z, y, x)", """,
far AS MATERIALIZED (SELECT batch_id, z, y, x, sqrt(coalesce(d, 0)) / 2 AS d FROM lab LEFT JOIN near USING (batch_id, z, y, x))
SELECT o.batch_id, o.z, o.y, o.x, """ + ", ".join(f"round((coalesce(n{a}.d, o.d) - coalesce(p{a}.d, o.d)) / CASE WHEN n{a}.d IS NOT NULL AND p{a}.d IS NOT NULL THEN 2.0 ELSE 1.0 END, 5) + 0.0 AS d{a}" for a in AXES) + " FROM far o " + " ".join(
    f"LEFT JOIN far {n}{a} ON {n}{a}.batch_id = o.batch_id AND " + " AND ".join(f"{n}{a}.{b} = o.{b}" + (s if a == b else "") for b in AXES) for a in AXES for n, s in (("n", " + 1"), ("p", " - 1")))))
def volume_distance_gradients(spark: SparkSession, d: str) -> DataFrame:
    """By axis the slope of the distance to the nearest boundary, however far, over blocks."""
    labels = volumes(spark, d).withColumn("label", F.when(F.col("value") > 0.3, 2).otherwise(1)).drop("value")
    far = U.boundary_distance(labels, EXTENT)
    made = B.sorted_volume(far, BLOCK, (1, 1, 1), lambda v: {f"d{a}": B.slope(v, i, 1.0) for i, a in enumerate(AXES, 1)}, [f"d{a}" for a in AXES], "distance")
    return made.select("batch_id", *AXES, *[(F.round(f"d{a}", 5) + F.lit(0.0)).alias(f"d{a}") for a in AXES])


def trained_sql(steps: int, rate: float) -> str:
    """CTE w: the weights after so many full-batch steps of least squares from embeddings to their labels."""
    made = [f""", data AS MATERIALIZED (SELECT vec_id, list_concat(list_transform(embedding, lambda e: e::DOUBLE), [1.0::DOUBLE]) AS x, label::DOUBLE AS y FROM embeddings),
w0 AS (SELECT list_transform(range(65), lambda i: 0.0::DOUBLE) AS w)"""]
    for k in range(steps):
        made.append(f""", g{k} AS (SELECT i, sum(miss * x) / count(*) AS g FROM (SELECT list_dot_product(x, w) - y AS miss, unnest(x) AS x, unnest(range(65)) AS i FROM data, w{k}) GROUP BY i),
w{k + 1} AS MATERIALIZED (SELECT list(w[i + 1] - {rate}::DOUBLE * g ORDER BY i) AS w FROM g{k}, w{k})""")
    return "".join(made)


@query(VOL + trained_sql(4, 0.25) + " SELECT vec_id AS batch_id, round(list_dot_product(x, w), 6) + 0.0 AS prediction FROM data, w4")
def model_predicted(spark: SparkSession, d: str) -> DataFrame:
    """A model trained on all vectors and their labels in four full-batch steps, and its predictions."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("batch_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))
    linear = M.Linear(64)
    M.train(rows, linear, 4, 0.25)
    return M.predict(rows, linear, 64).select("batch_id", (F.round("prediction", 6) + F.lit(0.0)).alias("prediction"))
