"""Chunked scans: tiles that cover a region, the boxes each needs, and assembly of their results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brickfield.functions.cells import AXES
from brickfield.functions.geometry import Box
from brickfield.functions.scratch import written
from brickfield.operators import graphs as G
from brickfield.operators.joins import points_in_boxes


def tiles(spark: SparkSession, total: Box, shape: Sequence[int], stride: Sequence[int] | None = None) -> DataFrame:
    """tile (the first axis runs fastest) with b_<axis> and e_<axis>; the last tile of an axis is moved back to end with total."""
    stride = tuple(stride or shape)
    if any(s > t for s, t in zip(shape, total.shape)):
        raise ValueError("a tile is larger than the region")
    counts = [-(-(t - s) // d) + 1 for t, s, d in zip(total.shape, shape, stride)]
    n = 1
    for c in counts:
        n *= c
    rows, before = spark.range(n).withColumnRenamed("id", "tile"), 1
    for a, c, d, b, t, s in zip(AXES, counts, stride, total.begin, total.shape, shape):
        place = F.floor(F.col("tile") / before) % c
        rows = rows.withColumn(f"b_{a}", F.least(b + place * d, F.lit(b + t - s)).cast("long")).withColumn(f"e_{a}", F.col(f"b_{a}") + s)
        before *= c
    return rows


def tiles_of(regions: DataFrame, shape: Sequence[int], stride: Sequence[int] | None = None) -> DataFrame:
    """The tiles of every region, a row with b_<axis> and e_<axis> each: its other columns, tile, and the tile's box.

    Regions are cut where they lie; one that is smaller than a tile along an axis is an error.
    """
    stride = tuple(stride or shape)
    rows = regions.withColumns({f"_{p}{a}": F.col(f"{p}_{a}").cast("long") for a in AXES for p in "be"}).drop(*[f"{p}_{a}" for a in AXES for p in "be"])
    total = F.lit(1).cast("long")
    for a, s, d in zip(AXES, shape, stride):
        room = F.col(f"_e{a}") - F.col(f"_b{a}") - s
        rows = rows.withColumn(f"_n{a}", F.when(room >= 0, F.ceil(room / d) + 1).otherwise(F.raise_error(F.lit("a tile is larger than the region"))).cast("long"))
        total = total * F.col(f"_n{a}")
    rows, left = rows.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), total - 1))), F.col("tile")
    for a, s, d in zip(AXES, shape, stride):
        rows = rows.withColumn(f"b_{a}", F.least(F.col(f"_b{a}") + left % F.col(f"_n{a}") * d, F.col(f"_e{a}") - s)).withColumn(f"e_{a}", F.col(f"b_{a}") + s)
        left = F.floor(left / F.col(f"_n{a}"))
    return rows.drop(*[f"_{p}{a}" for a in AXES for p in "ben"])


def cut(voxels: DataFrame, boxes: DataFrame, bucket: Sequence[int]) -> DataFrame:
    """The voxels of each tile; voxels in several come once for each."""
    return points_in_boxes(voxels, boxes, AXES, bucket)


def assemble(pieces: DataFrame, keys: Sequence[str] = ("batch_id",), value: str = "value", order: str = "tile") -> DataFrame:
    """One voxel for each place: that of the last tile."""
    return pieces.groupBy(*keys, *AXES).agg(F.max_by(value, order).alias(value))


def graph_of_tiles(nodes: DataFrame, edges: DataFrame, boxes: DataFrame, bucket: Sequence[int], keys: Sequence[str] = ("tile",)) -> tuple[DataFrame, DataFrame]:
    """The graph of each tile: its nodes (keys, id, loc, temporary) and edges (keys, u, v), cropped to its box (b_<axis>, e_<axis>) and trimmed.

    Where an edge leaves a tile, that tile has a temporary node at its side, with an id of its own above all others.
    """
    keys = list(keys)
    at = nodes.select("id", "loc", *[F.col("loc")[i].alias(a) for i, a in enumerate(AXES)])
    within = written(points_in_boxes(at, boxes, AXES, bucket).select(*keys, "id", "loc"), "tile-nodes")
    ends = []
    for end in "uv":
        ends.append(edges.select("u", "v").join(within.select(*keys, F.col("id").alias(end)), end).select(*keys, "u", "v", *[F.lit(int(o == end)).alias(f"_{o}") for o in "uv"]))
    served = written(ends[0].unionByName(ends[1]).groupBy(*keys, "u", "v").agg(F.max("_u").alias("_u"), F.max("_v").alias("_v")), "tile-edges")
    crossing = G.with_ends(nodes, served.where("_u <> _v").select("u", "v").distinct()).join(served.where("_u <> _v"), ["u", "v"]).join(boxes.select(*keys, *[f"{p}_{a}" for p in "be" for a in AXES]), keys)
    begin, end = ([F.col(f"{p}_{a}").cast("double") for a in AXES] for p in "be")
    crossing = crossing.withColumn("loc", F.when(F.col("_u") == 1, G.leaving(F.col("u_loc"), F.col("v_loc"), begin, end)).otherwise(G.leaving(F.col("v_loc"), F.col("u_loc"), begin, end)))
    top = nodes.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_top"))  # one row
    crossing = G.numbered(crossing.select(*keys, "u", "v", "_u", "loc"), *keys, "u", "v").crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + 1 + F.col("number"))
    inner, new = F.col("_u") == 1, F.col("id")
    cut = crossing.select(*keys, F.when(inner, F.col("u")).otherwise(new).alias("u"), F.when(inner, new).otherwise(F.col("v")).alias("v"))
    kept = served.where("_u = 1 AND _v = 1").select(*keys, "u", "v").unionByName(cut)
    return within.withColumn("temporary", F.lit(False)).unionByName(crossing.select(*keys, "id", "loc", F.lit(True).alias("temporary"))), kept


def assemble_graph(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ("tile",)) -> tuple[DataFrame, DataFrame]:
    """One graph of the tiles' nodes (keys, id, temporary and others) and edges (keys, u, v).

    Temporary nodes, whose ids may be those of other tiles' nodes, and their edges are left out; a node of several tiles is
    that of the last one; an edge is there where both of its ends stand.
    """
    keys = list(keys)
    others = [c for c in nodes.columns if c not in (*keys, "id", "temporary")]
    stand = nodes.where("NOT temporary").groupBy("id").agg(F.max_by(F.struct(*others), F.struct(*keys)).alias("_n")).select("id", *[F.col(f"_n.{c}").alias(c) for c in others])
    for end in "uv":
        edges = edges.join(nodes.where("temporary").select(*keys, F.col("id").alias(end)), [*keys, end], "left_anti").join(stand.select(F.col("id").alias(end)), end, "left_semi")
    return stand, edges.select("u", "v").distinct()


def snapshot(batches: DataFrame, every: int, number: str, keep: Column | None = None, more: DataFrame | None = None, on: Sequence[str] | None = None) -> DataFrame:
    """Batches whose number is a multiple of every and for which keep, a condition of the user's, holds.

    more is an additional request: data that snapshots alone have, joined on number, or on the columns `on`. It is filtered
    by the same rule first, so nothing else of it is read on.
    """
    rule = lambda df: df.where(F.col(number) % every == 0)
    chosen = rule(batches) if keep is None else rule(batches).where(keep)
    return chosen if more is None else chosen.join(rule(more) if number in more.columns else more, list(on or [number]), "left")


def block_requests_of(regions: DataFrame, read: Sequence[int], write: Sequence[int]) -> DataFrame:
    """For every region, a row with b_<axis> and e_<axis> each: its blocks to write, as tiles_of(), with the larger box to read around each (r_<axis>, q_<axis>)."""
    blocks = tiles_of(regions, write)
    for a, r, w in zip(AXES, read, write):
        margin = (r - w) // 2
        blocks = blocks.withColumn(f"r_{a}", F.col(f"b_{a}") - margin).withColumn(f"q_{a}", F.col(f"e_{a}") + margin)
    return blocks


def block_requests(spark: SparkSession, total: Box, read: Sequence[int], write: Sequence[int]) -> DataFrame:
    """A row for each block to write, with the larger box to read around it (r_<axis>, q_<axis>)."""
    blocks = tiles(spark, total, write)
    for a, r, w in zip(AXES, read, write):
        margin = (r - w) // 2
        blocks = blocks.withColumn(f"r_{a}", F.col(f"b_{a}") - margin).withColumn(f"q_{a}", F.col(f"e_{a}") + margin)
    return blocks
