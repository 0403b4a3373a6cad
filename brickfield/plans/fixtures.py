"""Views of the driver's tables as volumes, labels, points and requests, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brickfield.functions.cells import Grid, explode

GRID = Grid((4, 4, 4))

#: SQL over embeddings: vox (batch_id, i, z, y, x, v) and lab (the same with label instead of v).
VOX = """WITH cells AS (SELECT vec_id AS batch_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
vox AS (SELECT batch_id, i, i // 16 AS z, (i // 4) % 4 AS y, i % 4 AS x, v FROM cells),
lab AS (SELECT batch_id, i, z, y, x, greatest(floor((v + 1.0) * 3.0)::INTEGER - 2, 0) AS label, CASE WHEN v > -0.5 THEN 1 ELSE 0 END AS mask FROM vox)
"""
PTS = """WITH pts AS (SELECT event_id AS id, user_id AS z, (extract(hour FROM ts) * 60 + extract(minute FROM ts))::BIGINT AS y, floor(value)::BIGINT AS x, event_type FROM events),
edges AS (SELECT * FROM (SELECT event_id AS u, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events) WHERE v IS NOT NULL)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_of(v: Column) -> Column:
    return F.greatest(F.floor((v + 1.0) * 3.0).cast("int") - 2, F.lit(0))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_id and the arrays value, label and mask."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("batch_id"), F.transform("embedding", lambda e: e.cast("double")).alias("value"))
    return rows.withColumn("label", F.transform("value", label_of)).withColumn("mask", F.transform("value", lambda v: F.when(v > -0.5, 1).otherwise(0)))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_id, z, y, x and value."""
    return explode(blocks(spark, sf_dir).select("batch_id", "value"), GRID, "value")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_id, z, y, x, value, label and mask."""
    rows = voxels(spark, sf_dir)
    return rows.withColumn("label", label_of(F.col("value"))).withColumn("mask", F.when(F.col("value") > -0.5, 1).otherwise(0))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, z (user), y (minute of the day), x (whole value), event_type and loc."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("z"), minute.cast("long").alias("y"), F.floor("value").cast("long").alias("x"), "event_type")
    return rows.withColumn("loc", F.array(*[F.col(a).cast("double") for a in "zyx"]))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of a user."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("u"), F.lead("event_id").over(w).alias("v"))
    return rows.where("v IS NOT NULL")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request, seed and turn of every order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_orderkey").alias("seed"), F.col("o_custkey").alias("turn"))
