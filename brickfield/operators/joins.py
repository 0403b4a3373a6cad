"""Spatial joins as equi-joins on buckets: boxes against points, points within a radius, nearest ones within it.

operators.neighbors counts and finds neighbours where spots may be crowded or the radius isn't known. Bucketing replaces the nested loop of a range predicate; a point lies in one bucket, so no pair comes twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from brickfield.functions.geometry import Box


def points_in_boxes(points: DataFrame, boxes: DataFrame, axes: Sequence[str], bucket: Sequence[int], how: str = "inner") -> DataFrame:
    """points (axes) with each of boxes that holds them; boxes has b_<axis> and e_<axis>, begin and end."""
    for a, n in zip(axes, bucket):
        points = points.withColumn(f"_k{a}", F.floor(F.col(a) / n))
        boxes = boxes.where(F.col(f"e_{a}") > F.col(f"b_{a}")).withColumn(f"_k{a}", F.explode(F.sequence(F.floor(F.col(f"b_{a}") / n), F.floor((F.col(f"e_{a}") - 1) / n))))
    p, b = points.alias("p"), boxes.alias("b")
    test = F.lit(True)
    for a in axes:
        test &= (F.col(f"p._k{a}") == F.col(f"b._k{a}")) & (F.col(f"p.{a}") >= F.col(f"b.b_{a}")) & (F.col(f"p.{a}") < F.col(f"b.e_{a}"))
    joined = p.join(b, test, how)
    return joined.drop(*[f"_k{a}" for a in axes])


def within_radius(left: DataFrame, right: DataFrame, axes: Sequence[str], radius: float) -> DataFrame:
    """Pairs (left columns, and right's with suffix _r) at most radius apart, and d2, their squared distance."""
    right = right.toDF(*[f"{c}_r" for c in right.columns])
    for a in axes:
        right = right.withColumn(f"_k{a}", F.floor(F.col(f"{a}_r") / radius))
        left = left.withColumn(f"_k{a}", F.explode(F.array(*[F.floor(F.col(a) / radius) + d for d in (-1, 0, 1)])))
    d2 = sum(((F.col(a) - F.col(f"{a}_r")) * (F.col(a) - F.col(f"{a}_r")) for a in axes), F.lit(0.0))
    return left.join(right, [f"_k{a}" for a in axes]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop(*[f"_k{a}" for a in axes])


def nearest(left: DataFrame, right: DataFrame, axes: Sequence[str], k: int, radius: float, key: str, other: str) -> DataFrame:
    """The k nearest of right within radius of each of left, ties to the smaller id."""
    w = Window.partitionBy(key).orderBy("d2", f"{other}_r")
    return within_radius(left, right, axes, radius).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Candidate pairs of a part of a bucket, about, and boxes of a group.
CANDIDATES, GROUP = 1 << 24, 1 << 16


def overlap(boxes: DataFrame, others: DataFrame, axes: Sequence[str], bucket: Sequence[int]) -> DataFrame:
    """Pairs of boxes that overlap; others' columns have suffix _o. A pair is kept in its first shared bucket alone.

    A bucket's boxes are dealt to parts, each beside all of the bucket's others, so that all tasks make pairs however few
    files or buckets the boxes come from. Boxes at one place are a group, and groups are compared; pairs of those that overlap
    are made last and not shuffled. They come by the place of the other, each box beside the same run of others, so that
    they pack well when written.
    """
    columns = {c: "_row" for c in boxes.columns} | {f"{c}_o": "_row_o" for c in others.columns}
    others = others.toDF(*[f"{c}_o" for c in others.columns])
    keys = [f"_k{a}" for a in axes]
    tasks = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(df: DataFrame, end: str = "") -> DataFrame:
        """df in each of its buckets, and whether that is its first along an axis."""
        for a, n in zip(axes, bucket):
            first = F.floor(F.col(f"b_{a}{end}") / n)
            df = df.withColumn(f"_k{a}", F.explode(F.sequence(first, F.floor((F.col(f"e_{a}{end}") - 1) / n)))).withColumn(f"_f{a}{end}", F.col(f"_k{a}") == first)
        return df

    def grouped(df: DataFrame, count: Column, end: str = "") -> DataFrame:
        """df by part, a row for the boxes at one place, of so many in the part; in the order of places."""
        place = [f"{e}_{a}{end}" for e in "be" for a in axes] + [f"_f{a}{end}" for a in axes]
        rest = [c for c in df.columns if c not in (*keys, *place, "_hash", "_part", "_parts", "_n", "_m")]
        df = df.withColumn("_piece", F.pmod(F.shiftright("_hash", 20), F.ceil(count / GROUP)))
        rows = df.repartition(tasks, *keys, "_part").groupBy(*keys, "_part", *place, "_piece").agg(F.collect_list(F.struct(*rest)).alias(f"_rows{end}")).drop("_piece")
        # Spark drops a sort below a join, except under a filter that isn't deterministic, as this one of all rows.
        return rows.sortWithinPartitions(*keys, "_part", *place).where(F.spark_partition_id() >= 0)

    hashes = [F.xxhash64(*[f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]) for df in (boxes, others)]
    boxes, others = (spread(df.withColumn("_hash", h), end) for df, h, end in zip((boxes, others), hashes, ("", "_o")))
    counts = boxes.groupBy(*keys).agg(F.count("*").alias("_n")).join(others.groupBy(*keys).agg(F.count("*").alias("_m")), keys)
    parts = counts.select(*keys, "_n", "_m", F.least("_n", F.ceil(F.col("_n") * F.col("_m") / CANDIDATES)).cast("int").alias("_parts"))
    left = grouped(boxes.join(parts, keys).withColumn("_part", F.pmod("_hash", F.col("_parts")).cast("int")), F.col("_n") / F.col("_parts"))
    right = grouped(others.join(parts, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))), F.col("_m"), "_o")
    test: Column = F.lit(True)
    for a in axes:
        test &= (F.col(f"_f{a}") | F.col(f"_f{a}_o")) & (F.col(f"b_{a}") < F.col(f"e_{a}_o")) & (F.col(f"b_{a}_o") < F.col(f"e_{a}"))
    pairs = right.join(left.hint("merge"), [*keys, "_part"]).where(test)
    for end in ("", "_o"):
        pairs = pairs.withColumn(f"_row{end}", F.explode(f"_rows{end}"))
    place = {f"{e}_{a}{end}" for e in "be" for a in axes for end in ("", "_o")}
    return pairs.select(*[F.col(c) if c in place else F.col(f"{row}.{c}") for c, row in columns.items()])
