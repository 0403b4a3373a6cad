"""Queries on requests, locations, tiles and aggregates, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brickfield.functions.cells import AXES
from brickfield.functions.draws import uniform, uniform_sql
from brickfield.functions.geometry import Box
from brickfield.functions.scratch import new_path, written
from brickfield.operators import joins as J, locate as L, scan as S
from brickfield.plans.array_queries import tidy
from brickfield.plans.fixtures import PTS, VOX, labelled, points, requests, table, voxels
from brickfield.sources import tables as T

QUERIES, SQL = {}, {}
UPSTREAM = Box((0, 0, 0), (400, 300, 200))


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def shift_sql(salt: int, axis: int, shape: tuple[int, ...], grid: tuple[int, ...]) -> str:
    first, last = 0, (UPSTREAM.shape[axis] - shape[axis]) // grid[axis]
    return f"(floor({uniform_sql('o_orderkey', salt + axis)} * {last - first + 1})::BIGINT * {grid[axis]})"


@query(f"SELECT o_orderkey AS request, {shift_sql(0, 0, (40, 20, 30), (20, 2, 2))} AS b_z, {shift_sql(0, 1, (40, 20, 30), (20, 2, 2))} AS b_y, {shift_sql(0, 2, (40, 20, 30), (20, 2, 2))} AS b_x FROM orders")
def random_location(spark: SparkSession, d: str) -> DataFrame:
    return L.random_shift(requests(spark, d), (40, 20, 30), UPSTREAM, (20, 2, 2)).select("request", "b_z", "b_y", "b_x")


TRY = "(floor({u} * 3)::BIGINT)"


@query(VOX + f""", tries AS (SELECT o_orderkey AS request, o_orderkey % (SELECT count(*) FROM embeddings) AS batch_id, t AS attempt, {TRY.format(u=uniform_sql('o_orderkey', 't * 10'))} AS bz,
  {TRY.format(u=uniform_sql('o_orderkey', 't * 10 + 1'))} AS by_, {TRY.format(u=uniform_sql('o_orderkey', 't * 10 + 2'))} AS bx FROM orders, range(0, 4) r(t)),
pick AS (SELECT t.*, row_number() OVER (PARTITION BY request ORDER BY attempt) AS n FROM (SELECT t.request, t.attempt, t.bz, t.by_, t.bx FROM tries t JOIN lab l ON l.batch_id = t.batch_id
  AND l.z >= bz AND l.z < bz + 2 AND l.y >= by_ AND l.y < by_ + 2 AND l.x >= bx AND l.x < bx + 2 GROUP BY ALL HAVING sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) >= 4) t)
SELECT request, attempt, bz AS b_z, by_ AS b_y, bx AS b_x FROM pick WHERE n = 1""")
def random_location_masked(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).withColumn("m", F.when(F.col("label") > 0, 1).otherwise(0))
    volumes = table(spark, d, "embeddings").agg(F.count("*").alias("volumes"))
    tries = requests(spark, d).crossJoin(F.broadcast(volumes)).withColumn("batch_id", F.col("request") % F.col("volumes")).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(3))))
    for k, a in enumerate(AXES):
        # Never null, so that the join needs no filter that would compute the draws a second time.
        tries = tries.withColumn(f"b_{a}", F.coalesce(F.floor(uniform(F.col("seed"), F.col("attempt") * 10 + k) * 3), F.lit(-1)).cast("long"))
    places = L.moving_sums(rows, ["batch_id"], "m", (2, 2, 2)).where(F.col("total") >= 4)
    good = L.accepted(tries.join(places, ["batch_id", "b_z", "b_y", "b_x"]), F.col("total") / 8.0, 0.5)
    return good.select("request", F.col("attempt").cast("long").alias("attempt"), "b_z", "b_y", "b_x")


@query(VOX + f""", req AS (SELECT o_orderkey AS request, o_orderkey % (SELECT count(*) FROM embeddings) AS batch_id FROM orders),
good AS (SELECT batch_id, bz, by_, bx, row_number() OVER (PARTITION BY batch_id ORDER BY bz, by_, bx) - 1 AS number, count(*) OVER (PARTITION BY batch_id) AS places
  FROM (SELECT batch_id, bz, by_, bx FROM lab, range(0, 3) r(bz), range(0, 3) s(by_), range(0, 3) q(bx) WHERE z >= bz AND z < bz + 2 AND y >= by_ AND y < by_ + 2 AND x >= bx AND x < bx + 2
  GROUP BY ALL HAVING sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) >= 4)),
tries AS (SELECT request, batch_id, t AS attempt, {TRY.format(u=uniform_sql('request', 't * 10'))} AS bz, {TRY.format(u=uniform_sql('request', 't * 10 + 1'))} AS by_, {TRY.format(u=uniform_sql('request', 't * 10 + 2'))} AS bx FROM req, range(0, 4) r(t)),
pick AS (SELECT request, min(attempt) AS attempt, arg_min(g.bz, attempt) AS bz, arg_min(g.by_, attempt) AS by_, arg_min(g.bx, attempt) AS bx FROM tries t JOIN good g ON g.batch_id = t.batch_id AND g.bz = t.bz AND g.by_ = t.by_ AND g.bx = t.bx GROUP BY request)
SELECT request, attempt, bz AS b_z, by_ AS b_y, bx AS b_x FROM pick UNION ALL
SELECT r.request, CASE WHEN g.bz IS NOT NULL THEN 4 END, g.bz, g.by_, g.bx FROM req r LEFT JOIN good g ON g.batch_id = r.batch_id AND g.number = floor({uniform_sql('r.request', 40)} * g.places)::BIGINT WHERE r.request NOT IN (SELECT request FROM pick)""")
def random_location_masked_all(spark: SparkSession, d: str) -> DataFrame:
    """random_location_masked, with the requests that its four attempts leave out."""
    rows = labelled(spark, d).withColumn("m", F.when(F.col("label") > 0, 1).otherwise(0))
    volumes = table(spark, d, "embeddings").agg(F.count("*").alias("volumes"))
    asked = requests(spark, d).crossJoin(F.broadcast(volumes)).select("request", "seed", (F.col("request") % F.col("volumes")).alias("batch_id"))
    return L.masked(asked, L.integral(rows, ["batch_id"], "m"), ["batch_id"], (2, 2, 2), Box((0, 0, 0), (4, 4, 4)), 0.5)


@query(VOX + "SELECT batch_id, z, y, x, (sum(label) OVER (PARTITION BY batch_id, z, y ORDER BY x))::BIGINT AS row_sum, (SELECT sum(k.label) FROM lab k WHERE k.batch_id = o.batch_id AND k.z <= o.z AND k.y <= o.y AND k.x <= o.x)::BIGINT AS integral FROM lab o")
def integral_image(spark: SparkSession, d: str) -> DataFrame:
    rows = L.integral(labelled(spark, d).withColumn("label", F.col("label").cast("long")), ["batch_id"], "label")
    row = L.integral(rows.withColumnRenamed("integral", "whole"), ["batch_id", "z", "y"], "label", "x")
    return tidy(row.withColumnRenamed("integral", "row_sum").withColumnRenamed("whole", "integral"), "row_sum", "integral")


@query(VOX + "SELECT batch_id, avg(CASE WHEN label > 0 THEN 1.0 ELSE 0.0 END) AS ratio FROM lab GROUP BY batch_id")
def mask_ratio(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).groupBy("batch_id").agg(F.avg(F.when(F.col("label") > 0, 1.0).otherwise(0.0)).alias("ratio"))


@query(VOX + f"SELECT batch_id, ratio FROM (SELECT batch_id, avg(CASE WHEN label > 0 THEN 1.0 ELSE 0.0 END) AS ratio FROM lab GROUP BY batch_id) WHERE ratio > 0.5 OR {uniform_sql('batch_id', 91)} > 0.8")
def reject(spark: SparkSession, d: str) -> DataFrame:
    return L.rejected(mask_ratio(spark, d), F.col("ratio"), 0.5, 0.8, F.col("batch_id"))


@query(PTS + "SELECT a.id, 1.0::DOUBLE / count(*) AS weight FROM pts a JOIN pts b ON abs(a.y - b.y) <= 30 AND abs(a.x - b.x) <= 30 AND abs(a.z - b.z) <= 30 AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 + (a.z - b.z) ** 2 <= 900 GROUP BY a.id")
def point_weights(spark: SparkSession, d: str) -> DataFrame:
    return L.point_weights(points(spark, d), AXES, 30.0)


@query(PTS + f""", w AS (SELECT a.id, 1.0::DOUBLE / count(*) AS weight FROM pts a JOIN pts b ON abs(a.y - b.y) <= 30 AND abs(a.x - b.x) <= 30 AND abs(a.z - b.z) <= 30 AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 + (a.z - b.z) ** 2 <= 900 GROUP BY a.id),
c AS (SELECT id, greatest(1, round_even(weight * 4096, 0)::BIGINT) AS cells FROM w), p AS (SELECT id, cells, sum(cells) OVER (ORDER BY id)::BIGINT AS e, (SELECT sum(cells) FROM c)::BIGINT AS total FROM c),
r AS (SELECT o_orderkey AS request, floor({uniform_sql('o_orderkey', 17)} * (SELECT sum(cells)::BIGINT FROM c))::BIGINT AS cell FROM orders)
SELECT request, id FROM r JOIN p ON cell >= e - cells AND cell < e""")
def weighted_points(spark: SparkSession, d: str) -> DataFrame:
    return L.weighted_choice(requests(spark, d), point_weights(spark, d), 4096)


@query(PTS + f""", w AS (SELECT a.id, 1.0::DOUBLE / count(*) AS weight FROM pts a JOIN pts b ON abs(a.y - b.y) <= 30 AND abs(a.x - b.x) <= 30 AND abs(a.z - b.z) <= 30 AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 + (a.z - b.z) ** 2 <= 900 GROUP BY a.id),
p AS (SELECT id, sum(weight) OVER (ORDER BY id) - weight AS s, sum(weight) OVER (ORDER BY id) AS e, sum(weight) OVER () AS total FROM w),
r AS (SELECT o_orderkey AS request, {uniform_sql('o_orderkey', 17)} * (SELECT sum(weight) FROM w) AS spot FROM orders)
SELECT request, id FROM r JOIN p ON spot >= s AND spot < e""")
def weighted_points_exact(spark: SparkSession, d: str) -> DataFrame:
    """weighted_points, by the weights themselves."""
    return L.weighted_choice(requests(spark, d), point_weights(spark, d))


@query(f"""WITH tries AS (SELECT o_orderkey AS request, t AS attempt, {', '.join(f"(floor({uniform_sql('o_orderkey', f't * 10 + {k}')} * {n})::BIGINT * {g})" + f" AS b_{a}" for k, (a, n, g) in enumerate(zip(AXES, (19, 141, 86), (20, 2, 2))))} FROM orders, range(0, 200) r(t)),
good AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY attempt) AS n FROM tries WHERE (b_z // 20 + b_y // 2 + b_x // 2 + request) % 3 = 0)
SELECT request, attempt, b_z, b_y, b_x FROM good WHERE n = 1""")
def random_location_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Draws until a condition of the user's holds, however many that takes."""
    accepts = (F.col("b_z") / 20 + F.col("b_y") / 2 + F.col("b_x") / 2 + F.col("request")) % 3 == 0
    return L.shift_until(requests(spark, d), (40, 20, 30), UPSTREAM, (20, 2, 2), accepts).select("request", "attempt", "b_z", "b_y", "b_x")


def reach_sql(axis: str, shape: int, end: int) -> str:
    return f"greatest({axis} - {shape} + 1, 0) AS f{axis}, least({axis}, {end} - {shape}) AS l{axis}"


@query(PTS + f""", ends AS (SELECT id, weight, {reach_sql('z', 5, 90)}, {reach_sql('y', 40, 1400)}, {reach_sql('x', 20, 90)} FROM (SELECT id, z, y, x, 1.0::DOUBLE / (1 + id % 3) AS weight FROM pts)),
fit AS (SELECT * FROM ends WHERE fz <= lz AND fy <= ly AND fx <= lx), p AS (SELECT *, sum(weight) OVER (ORDER BY id) - weight AS s, sum(weight) OVER (ORDER BY id) AS e FROM fit),
r AS (SELECT o_orderkey AS request, {uniform_sql('o_orderkey', 17)} * (SELECT sum(weight) FROM fit) AS spot FROM orders)
SELECT request, id, {', '.join(f"f{a} + floor({uniform_sql('request', 31 + k)} * (l{a} - f{a} + 1))::BIGINT AS b_{a}" for k, a in enumerate(AXES))} FROM r JOIN p ON spot >= s AND spot < e""")
def random_location_nonempty(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that hold a point drawn by weight."""
    nodes = points(spark, d)
    weights = nodes.select("id", (F.lit(1.0) / (1 + F.col("id") % 3)).alias("weight"))
    return L.around_points(requests(spark, d), weights, nodes, (5, 40, 20), Box((0, 0, 0), (90, 1400, 90)))


LISTED = "SELECT p_partkey AS location, (p_partkey * 37) % 500 AS z, (p_partkey * 11) % 320 AS y, (p_size * 9)::BIGINT AS x FROM part"


@query(f"""WITH l AS ({LISTED}), b AS (SELECT location, (round_even((z - 20) / 20.0, 0) * 20)::BIGINT AS bz, (round_even((y - 10) / 2.0, 0) * 2)::BIGINT AS by_, (round_even((x - 15) / 2.0, 0) * 2)::BIGINT AS bx FROM l),
f AS (SELECT *, row_number() OVER (ORDER BY location) - 1 AS n FROM b WHERE bz BETWEEN 0 AND 360 AND by_ BETWEEN 0 AND 280 AND bx BETWEEN 0 AND 170)
SELECT o_orderkey AS request, location, bz AS b_z, by_ AS b_y, bx AS b_x FROM orders JOIN f ON f.n = o_custkey % (SELECT count(*) FROM f)""")
def specified_location(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    listed = table(spark, d, "part").select(key.alias("location"), (key * 37 % 500).alias("z"), (key * 11 % 320).alias("y"), (F.col("p_size") * 9).cast("long").alias("x"))
    return L.specified(requests(spark, d), listed, (40, 20, 30), UPSTREAM, (20, 2, 2)).select("request", "location", "b_z", "b_y", "b_x")


@query(f"""WITH l AS ({LISTED}), b AS (SELECT location, (round_even((z - 20) / 20.0, 0) * 20)::BIGINT AS bz, (round_even((y - 10) / 2.0, 0) * 2)::BIGINT AS by_, (round_even((x - 15) / 2.0, 0) * 2)::BIGINT AS bx FROM l),
f AS (SELECT *, row_number() OVER (ORDER BY location) - 1 AS n FROM b WHERE bz BETWEEN 0 AND 360 AND by_ BETWEEN 0 AND 280 AND bx BETWEEN 0 AND 170),
s AS (SELECT * FROM orders JOIN f ON f.n = floor({uniform_sql('o_orderkey', 23)} * (SELECT count(*) FROM f))::BIGINT)
SELECT o_orderkey AS request, location, {', '.join(f"greatest(0, least({most}, round_even(({b} + floor({uniform_sql('o_orderkey', 41 + k)} * {2 * j + 1})::BIGINT - {j}) / {g}.0, 0) * {g}))::BIGINT AS b_{a}" for k, (a, b, j, g, most) in enumerate(zip(AXES, ('bz', 'by_', 'bx'), (40, 5, 5), (20, 2, 2), (360, 280, 170))))} FROM s""")
def specified_at_random(spark: SparkSession, d: str) -> DataFrame:
    """Listed locations drawn at random, and their boxes moved a little."""
    key = F.col("p_partkey")
    listed = table(spark, d, "part").select(key.alias("location"), (key * 37 % 500).alias("z"), (key * 11 % 320).alias("y"), (F.col("p_size") * 9).cast("long").alias("x"))
    served = L.specified(requests(spark, d), listed, (40, 20, 30), UPSTREAM, (20, 2, 2), at_random=True, jitter=(40, 5, 5))
    return served.select("request", "location", "b_z", "b_y", "b_x")


@query(PTS + """, f AS (SELECT id, z - 2 AS bz, y - 5 AS by_, x - 5 AS bx, row_number() OVER (ORDER BY id) - 1 AS n FROM pts WHERE z >= 2 AND z - 2 + 5 <= 400 AND y >= 5 AND y - 5 + 10 <= 1440 AND x >= 5 AND x - 5 + 10 <= 200)
SELECT o_orderkey AS request, id AS location, bz AS b_z, by_ AS b_y, bx AS b_x FROM orders JOIN f ON f.n = o_custkey % (SELECT count(*) FROM f)""")
def iterate_locations(spark: SparkSession, d: str) -> DataFrame:
    nodes = points(spark, d).select(F.col("id").alias("location"), *AXES)
    return L.specified(requests(spark, d), nodes, (5, 10, 10), Box((0, 0, 0), (400, 1440, 200)), (1, 1, 1)).select("request", "location", "b_z", "b_y", "b_x")


@query(f"SELECT o_orderkey AS request, CASE WHEN u < 0.5 / 1.0 THEN 0 WHEN u < 0.75 THEN 1 ELSE 2 END::BIGINT AS provider FROM (SELECT o_orderkey, {uniform_sql('o_orderkey', 5)} AS u FROM orders)")
def random_provider(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select("request", L.choose_provider(F.col("seed"), (0.5, 0.25, 0.25)).cast("long").alias("provider"))


@query(f"SELECT o_orderkey AS request, c, floor({uniform_sql('o_orderkey', 'c + 101')} * 1073741824)::BIGINT AS seed FROM orders, range(0, 3) r(c)")
def stack(spark: SparkSession, d: str) -> DataFrame:
    return L.repetitions(requests(spark, d), 3).select("request", F.col("c").cast("long").alias("c"), "seed")


@query(VOX + "SELECT 'raw' AS key, batch_id, z, y, x, v AS value FROM vox UNION ALL SELECT 'labels', batch_id, z, y, x, label::DOUBLE FROM lab")
def merge_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    keyed = lambda key, v: tidy(rows.withColumn("value", v.cast("double")), "value").withColumn("key", F.lit(key))
    return keyed("raw", F.col("value")).unionByName(keyed("labels", F.col("label")))


TILES = """tiles AS (SELECT a + 5 * b + 20 * c AS tile, least(a * 3, 10) AS bz, least(b * 4, 9) AS by_, least(c * 5, 7) AS bx FROM range(0, 5) r(a), range(0, 4) s(b), range(0, 3) t(c))"""


@query(PTS + ", " + TILES + """, held AS (SELECT id, z % 14 AS z, y % 13 AS y, x % 12 AS x FROM pts)
SELECT tile, bz AS b_z, by_ AS b_y, bx AS b_x, bz + 4 AS e_z, by_ + 4 AS e_y, bx + 5 AS e_x, id FROM tiles JOIN held ON z >= bz AND z < bz + 4 AND y >= by_ AND y < by_ + 4 AND x >= bx AND x < bx + 5""")
def scan_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The tiles of a region, with the points that each serves."""
    rows = points(spark, d).select("id", *[(F.col(a) % n).alias(a) for a, n in zip(AXES, (14, 13, 12))])
    return S.cut(rows, S.tiles(spark, Box((0, 0, 0), (14, 13, 12)), (4, 4, 5), (3, 4, 5)), (4, 4, 5)).drop(*AXES)


@query(VOX + ", tiles AS (SELECT a + 2 * b AS tile, least(a * 3, 1) AS bz, least(b * 3, 1) AS by_ FROM range(0, 2) r(a), range(0, 2) s(b)) SELECT batch_id, z, y, x, max_by(v + tile, tile) AS value FROM vox JOIN tiles ON z >= bz AND z < bz + 3 AND y >= by_ AND y < by_ + 3 GROUP BY ALL")
def scan_assemble(spark: SparkSession, d: str) -> DataFrame:
    boxes = S.tiles(spark, Box((0, 0, 0), (4, 4, 4)), (3, 3, 4))
    pieces = S.cut(voxels(spark, d), boxes, (4, 4, 4)).withColumn("value", F.col("value") + F.col("tile"))
    return tidy(S.assemble(pieces), "value")


@query("""WITH r AS (SELECT s_suppkey AS region, s_suppkey % 9 - 4 AS bz, s_nationkey::BIGINT AS by_, 10 + s_suppkey % 13 AS ez, s_nationkey::BIGINT + 5 + s_suppkey % 4 * 5 AS ey FROM supplier),
n AS (SELECT *, ceil((ez - bz - 5) / 5.0)::BIGINT + 1 AS nz, ceil((ey - by_ - 5) / 5.0)::BIGINT + 1 AS ny FROM r), t AS (SELECT *, unnest(range(0, nz * ny * 2)) AS block FROM n),
b AS (SELECT region, block, least(bz + block % nz * 5, ez - 5) AS b_z, least(by_ + block // nz % ny * 5, ey - 5) AS b_y, block // nz // ny * 5 AS b_x FROM t)
SELECT *, b_z + 5 AS e_z, b_y + 5 AS e_y, b_x + 5 AS e_x, b_z - 2 AS r_z, b_y - 2 AS r_y, b_x - 2 AS r_x, b_z + 7 AS q_z, b_y + 7 AS q_y, b_x + 7 AS q_x FROM b""")
def request_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks to write of a table of regions, with the boxes to read around them."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("long")
    boxes = {"b_z": key % 9 - 4, "b_y": nation, "b_x": F.lit(0), "e_z": 10 + key % 13, "e_y": nation + 5 + key % 4 * 5, "e_x": F.lit(10)}
    regions = table(spark, d, "supplier").select(key.alias("region"), *[c.alias(n) for n, c in boxes.items()])
    return S.block_requests_of(regions, (9, 9, 9), (5, 5, 5)).withColumnRenamed("tile", "block")


@query(VOX + """SELECT batch_id AS iteration, min(v) AS low, max(v) AS high, any_value(label) AS label FROM vox JOIN embeddings ON vec_id = batch_id WHERE batch_id % 10 = 0 GROUP BY batch_id HAVING max(v) > 0.2""")
def snapshot_additional(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots that a condition keeps, each with a label that is requested for snapshots alone."""
    rows = voxels(spark, d).groupBy(F.col("batch_id").alias("iteration")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("iteration"), "label")
    return S.snapshot(rows, 10, "iteration", F.col("high") > 0.2, labels)


@query(VOX + "SELECT batch_id AS iteration, min(v) AS low, max(v) AS high FROM vox WHERE batch_id % 10 = 0 GROUP BY batch_id")
def snapshot_every(spark: SparkSession, d: str) -> DataFrame:
    from brickfield.sources.sinks import value_range

    return value_range(S.snapshot(voxels(spark, d).withColumnRenamed("batch_id", "iteration"), 10, "iteration"))


@query(PTS + "SELECT event_type, min(z) AS b_z, max(z) + 1 AS e_z, min(y) AS b_y, max(y) + 1 AS e_y, min(x) AS b_x, max(x) + 1 AS e_x FROM pts GROUP BY ALL")
def source_bbox(spark: SparkSession, d: str) -> DataFrame:
    ends = [e for a in AXES for e in (F.min(a).alias(f"b_{a}"), (F.max(a) + 1).alias(f"e_{a}"))]
    return points(spark, d).groupBy("event_type").agg(*ends)


@query("SELECT min(o_orderkey % 97) AS total_b, max(o_orderkey % 97 + 40 + o_custkey % 5) AS total_e, max(o_orderkey % 97) AS common_b, min(o_orderkey % 97 + 40 + o_custkey % 5) AS common_e FROM orders")
def total_roi(spark: SparkSession, d: str) -> DataFrame:
    begin, end = F.col("request") % 97, F.col("request") % 97 + 40 + F.col("turn") % 5
    return requests(spark, d).agg(F.min(begin).alias("total_b"), F.max(end).alias("total_e"), F.max(begin).alias("common_b"), F.min(end).alias("common_e"))


@query("SELECT event_type AS node, user_id % 3 AS method, count(*) AS n, min(value) + 0.0 AS low, max(value) + 0.0 AS high, round(avg(value), 6) + 0.0 AS mean, round(median(value), 6) + 0.0 AS mid FROM events GROUP BY ALL")
def profile_stats(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    zero = F.lit(0.0)
    return table(spark, d, "events").groupBy(F.col("event_type").alias("node"), (F.col("user_id") % 3).alias("method")).agg(
        F.count("*").alias("n"), (F.min(v) + zero).alias("low"), (F.max(v) + zero).alias("high"), (F.round(F.avg(v), 6) + zero).alias("mean"), (F.round(F.median(v), 6) + zero).alias("mid"),
    )


@query("SELECT s_suppkey AS id, s_nationkey * 2.0::DOUBLE AS z, s_suppkey * 2.0::DOUBLE AS y FROM supplier WHERE s_nationkey * 2 >= 4 AND s_nationkey * 2 < 40")
def csv_points(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "points")
    table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_name").write.csv(path, sep="\t")
    found = T.read_csv_points(spark, path, (1, 0), scale=2.0, id_column=0, delimiter="\t", box=Box((4, None), (36, None)))
    return found.select("id", F.col("loc")[0].alias("z"), F.col("loc")[1].alias("y"))


@query("SELECT s_suppkey AS a, CASE WHEN s_suppkey = (SELECT max(s_suppkey) FROM supplier) THEN (SELECT min(s_suppkey) FROM supplier) ELSE s_suppkey + 1 END AS b, s_name AS kind FROM supplier")
def json_partners(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers written as annotations that each name the next one by its location, and read back."""
    key = F.col("s_suppkey")
    suppliers = table(spark, d, "supplier")
    ends = suppliers.agg(F.min(key).alias("first"), F.max(key).alias("last"))
    at = lambda c: F.array(c, c * 2, c * 3)
    rows = suppliers.crossJoin(F.broadcast(ends)).withColumn("next", F.when(key == F.col("last"), F.col("first")).otherwise(key + 1))
    rels = F.array(F.struct(F.lit("PreSynTo").alias("Rel"), at(F.col("next")).alias("To")))
    lines = rows.select(F.to_json(F.struct(at(key).alias("Pos"), F.col("s_name").alias("Kind"), rels.alias("Rels"))).alias("value"))
    found, partners = T.read_annotations(lines)
    named = found.select("id", "kind", F.col("loc")[0].cast("long").alias("a"))
    other = named.select(F.col("id").alias("partner"), F.col("a").alias("b"))
    return partners.join(named, "id").join(other, "partner").select("a", "b", "kind")


@query("""WITH b AS (SELECT o_orderkey AS id, (o_orderkey * 7) % 9000 AS b, (o_orderkey * 7) % 9000 + 5 + o_custkey % 20 AS e FROM orders), c AS (SELECT p_partkey AS id, (p_partkey * 13) % 9000 AS b, (p_partkey * 13) % 9000 + 3 AS e FROM part)
SELECT b.id, c.id AS other FROM b JOIN c ON b.b < c.e AND c.b < b.e""")
def overlapping_boxes(spark: SparkSession, d: str) -> DataFrame:
    key, part = F.col("o_orderkey"), F.col("p_partkey")
    boxes = table(spark, d, "orders").select(key.alias("id"), (key * 7 % 9000).alias("b_z"), (key * 7 % 9000 + 5 + F.col("o_custkey") % 20).alias("e_z"))
    others = table(spark, d, "part").select(part.alias("id"), (part * 13 % 9000).alias("b_z"), (part * 13 % 9000 + 3).alias("e_z"))
    return J.overlap(boxes, others, ("z",), (16,)).select("id", F.col("id_o").alias("other"))


@query("SELECT s_suppkey AS tile, z, y, x, (z * 100 + y * 10 + x)::DOUBLE AS value FROM (SELECT s_suppkey, s_nationkey AS n FROM supplier), range(0, 40) a(z), range(0, 30) b(y), range(0, 12) c(x) WHERE z >= n AND z < n + 3 AND y >= n // 2 AND y < n // 2 + 2 AND x >= 5 AND x < 9")
def provided_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles served by a function of the user's."""
    n = F.col("s_nationkey").cast("long")
    begins = {"b_z": n, "b_y": F.floor(n / 2), "b_x": F.lit(5)}
    tiles = table(spark, d, "supplier").select(F.col("s_suppkey").alias("tile"), *[c.alias(k) for k, c in begins.items()], (n + 3).alias("e_z"), (F.floor(n / 2) + 2).alias("e_y"), F.lit(9).alias("e_x"))
    return T.provided(tiles, served)


def served(box: Box):
    """A ramp over the voxels of a box."""
    import numpy as np

    z, y, x = (i + b for i, b in zip(np.indices(box.shape), box.begin))
    return z * 100 + y * 10 + x


@query("WITH RECURSIVE " + VOX.removeprefix("WITH ") + f""", m AS (SELECT batch_id, z, y, x, CASE WHEN label > 1 THEN 1 ELSE 0 END AS m FROM lab),
places AS MATERIALIZED (SELECT batch_id, bz, by_, bx, avg(m) AS ratio FROM m, range(0, 3) r(bz), range(0, 3) s(by_), range(0, 3) q(bx) WHERE z >= bz AND z < bz + 2 AND y >= by_ AND y < by_ + 2 AND x >= bx AND x < bx + 2 GROUP BY ALL),
asked AS MATERIALIZED (SELECT o_orderkey AS request, o_orderkey % (SELECT count(*) FROM embeddings) AS batch_id FROM orders),
tries(request, batch_id, attempt, bz, by_, bx, good) AS (SELECT request, batch_id, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, false FROM asked
  UNION ALL SELECT d.request, d.batch_id, d.attempt, d.bz, d.by_, d.bx, coalesce(ratio > 0.5 OR (ratio IS NOT NULL AND u > 0.8), false) FROM (
    SELECT request, batch_id, attempt + 1 AS attempt, {TRY.format(u=uniform_sql('request', '(attempt + 1) * 10'))} AS bz, {TRY.format(u=uniform_sql('request', '(attempt + 1) * 10 + 1'))} AS by_,
      {TRY.format(u=uniform_sql('request', '(attempt + 1) * 10 + 2'))} AS bx, {uniform_sql('request', '(attempt + 1) + 5000')} AS u FROM tries WHERE NOT good) d
  LEFT JOIN places p ON p.batch_id = d.batch_id AND p.bz = d.bz AND p.by_ = d.by_ AND p.bx = d.bx)
SELECT request, attempt, bz AS b_z, by_ AS b_y, bx AS b_x FROM tries WHERE good""")
def reject_again(spark: SparkSession, d: str) -> DataFrame:
    """Requests are served again until the ratio of their mask is over a half, or their draw lets them pass."""
    rows = labelled(spark, d).withColumn("m", F.when(F.col("label") > 1, 1).otherwise(0))
    volumes = table(spark, d, "embeddings").agg(F.count("*").alias("volumes"))
    asked = requests(spark, d).crossJoin(F.broadcast(volumes)).select("request", "seed", (F.col("request") % F.col("volumes")).alias("batch_id"))
    # A row for each volume, with the sum at each of its few places.
    place = lambda: (F.col("b_z") * 3 + F.col("b_y")) * 3 + F.col("b_x")
    totals = L.moving_sums(rows, ["batch_id"], "m", (2, 2, 2)).groupBy("batch_id").agg(F.map_from_entries(F.collect_list(F.struct(place(), "total"))).alias("totals"))
    totals = written(totals, "places")
    ratio = F.col("totals")[place()] / 8.0
    accepts = (ratio > 0.5) | (ratio.isNotNull() & (uniform(F.col("seed"), F.col("attempt") + 5000) > 0.8))
    found = L.shift_until(asked, (2, 2, 2), Box((0, 0, 0), (4, 4, 4)), (1, 1, 1), accepts, known=(totals, ["batch_id"]))
    return found.select("request", "attempt", "b_z", "b_y", "b_x")


@query("""WITH r AS (SELECT p_partkey AS region, p_partkey % 5 AS bz, p_partkey % 7 AS by_, 2::BIGINT AS bx, p_partkey % 5 + 6 + p_size AS ez, p_partkey % 7 + 9 AS ey, 2 + 5 + p_partkey % 3 AS ex FROM part),
n AS (SELECT *, ceil((ez - bz - 6) / 4.0)::BIGINT + 1 AS nz, 2::BIGINT AS ny, ceil((ex - bx - 5) / 5.0)::BIGINT + 1 AS nx FROM r), t AS (SELECT *, unnest(range(0, nz * ny * nx)) AS tile FROM n)
SELECT region, tile, least(bz + tile % nz * 4, ez - 6) AS b_z, least(by_ + tile // nz % ny * 5, ey - 5) AS b_y, least(bx + tile // nz // ny * 5, ex - 5) AS b_x FROM t""")
def scan_regions(spark: SparkSession, d: str) -> DataFrame:
    """The tiles of a table of regions."""
    key = F.col("p_partkey")
    begins = {"z": key % 5, "y": key % 7, "x": F.lit(2)}
    shapes = {"z": 6 + F.col("p_size"), "y": F.lit(9), "x": 5 + key % 3}
    regions = table(spark, d, "part").select(key.alias("region"), *[begins[a].alias(f"b_{a}") for a in AXES], *[(begins[a] + shapes[a]).alias(f"e_{a}") for a in AXES])
    return S.tiles_of(regions, (6, 5, 5), (4, 5, 5)).select("region", "tile", "b_z", "b_y", "b_x")
