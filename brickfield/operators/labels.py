"""Label operators on voxel rows, and connected components of volumes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from brickfield.functions.cells import AXES, Grid, stacked
from brickfield.functions.scratch import written
from brickfield.operators.blocks import with_halo
from brickfield.operators.graphs import components
from brickfield.operators.voxels import slab_key


def balance(voxels: DataFrame, classes: int = 2, scale: Column | None = None, slab: Sequence[int] | None = None, clip: tuple[float | None, float | None] = (0.05, 0.95)) -> DataFrame:
    """Adds `weight`: scale / (classes * share of the label among the batch's, or slab's, scaled voxels), the share clipped.

    The shares are aggregated first, one row a label, and joined back. A label outside [0, classes) is an error.
    """
    voxels = voxels.withColumn("label", within_classes(F.col("label"), classes))
    scale = F.lit(1.0) if scale is None else scale
    keys = {f"_s{i}": k for i, k in enumerate(slab_key(slab or (0, 0, 0)))}
    rows = voxels.withColumn("_scale", scale).withColumns(keys)
    names = ["batch_id", *keys]
    of_label = rows.groupBy(*names, "label").agg(F.sum("_scale").alias("_of"))
    total = F.sum("_of").over(Window.partitionBy(*names))
    share = F.col("_of") / total
    low, high = clip
    share = share if low is None else F.greatest(share, F.lit(low))
    share = share if high is None else F.least(share, F.lit(high))
    share = F.when(total > 0, share)
    per = of_label.select(*names, "label", F.coalesce(F.lit(1.0) / (classes * share), F.lit(0.0)).alias("_w"))
    return rows.join(per, [*names, "label"]).withColumn("weight", F.col("_scale") * F.col("_w")).drop("_scale", "_w", *keys)


def within_classes(label: Column, classes: int) -> Column:
    """label; the query fails where it isn't one of 0 .. classes - 1."""
    return F.when((label >= 0) & (label < classes), label).otherwise(F.raise_error(F.concat(F.lit(f"label outside [0, {classes}): "), F.coalesce(label.cast("string"), F.lit("null")))))


def exclude(label: Column, gone: Sequence[int], background: int = 0) -> Column:
    return F.when(label.isin(*gone), background).otherwise(label)


def volume_components(blocks: DataFrame, grid: Grid, labels: str = "label", keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """keys, i and component, the smallest cell number of the same label that faces lead to; background has none.

    A component cannot leave its block, so blocks need no shuffle: each Arrow batch takes the minimum over faces until
    nothing changes. whole_components() joins those of the blocks of one volume.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = stacked(b.column(len(keys)), grid)
            root = np.broadcast_to(np.arange(grid.size).reshape(grid.shape), label.shape).copy()
            while True:
                before = root.copy()
                for axis in (1, 2, 3):
                    low, high = (tuple(s if k == axis else slice(None) for k in range(4)) for s in (slice(None, -1), slice(1, None)))
                    least = np.minimum(root[low], root[high])
                    for side in (low, high):
                        np.minimum(root[side], least, out=root[side], where=label[low] == label[high])
                if (before == root).all():
                    break
            at = np.nonzero(label.reshape(len(label), -1) > 0)
            own = {k: b.column(j).take(pa.array(at[0])) for j, k in enumerate(keys)}
            yield pa.record_batch(own | {"i": pa.array(at[1]), "component": pa.array(root.reshape(len(label), -1)[at])})

    schema = "".join(f"{k} long, " for k in keys) + "i long, component long"
    return blocks.select(*[F.col(k).cast("long").alias(k) for k in keys], labels).mapInArrow(kernel, schema)


def whole_components(voxels: DataFrame, block: Sequence[int], extent: Sequence[int], label: str = "label") -> DataFrame:
    """batch_id, z, y, x and component of the labelled voxels of volumes of any size, with places in [0, extent).

    A component is named by the smallest number of its voxels, ((batch_id * nz + z) * ny + y) * nx + x. Components are
    found within blocks; voxels that face each other over a block's side join those, and only they are compared.
    """
    rows, grid = with_halo(voxels.select("batch_id", *AXES, label), block, (0, 0, 0), label)
    keys = ("batch_id", "bz", "by", "bx")
    found = volume_components(rows, grid, label, keys)

    def number(at: Sequence[Column]) -> Column:
        out = F.col("batch_id")
        for c, n in zip(at, extent):
            out = out * n + c
        return out.cast("long")

    place = lambda cell: [F.col(f"b{a}") * b + c for a, b, c in zip(AXES, block, grid.at(cell))]
    local = found.select("batch_id", *[c.cast("long").alias(a) for c, a in zip(place(F.col("i")), AXES)], number(place(F.col("i"))).alias("node"), number(place(F.col("component"))).alias("root"))
    local = written(local, "components")
    known = voxels.where(F.col(label) > 0).select("batch_id", *[F.col(a).cast("long").alias(a) for a in AXES], label)
    faces = None
    for k, (a, n) in enumerate(zip(AXES, block)):
        here = known.where(F.pmod(F.col(a), F.lit(n)) == n - 1).withColumn("u", number([F.col(c) for c in AXES])).withColumn(a, F.col(a) + 1)
        there = known.where(F.pmod(F.col(a), F.lit(n)) == 0).withColumn("v", number([F.col(c) for c in AXES]))
        met = here.join(there, ["batch_id", *AXES, label]).select("u", "v")
        faces = met if faces is None else faces.unionByName(met)
    return joined_components(local, faces).select("batch_id", *AXES, F.col("root").alias("component"))


def joined_components(local: DataFrame, faces: DataFrame) -> DataFrame:
    """local (node, root: components found within blocks) with the roots of components that faces (u, v) between blocks join."""
    at = local.select("node", "root")
    pairs = faces.join(at.toDF("u", "a"), "u").join(at.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = components(pairs).toDF("root", "_to")
    return local.join(found, "root", "left").withColumn("root", F.coalesce("_to", "root")).drop("_to")
