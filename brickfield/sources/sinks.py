"""Writers: volumes by block, and snapshots of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brickfield.functions.cells import AXES
from brickfield.functions.geometry import Box
from brickfield.operators.scan import assemble, snapshot


def write_volume(pieces: DataFrame, path: str, total: Box, block: int = 64) -> None:
    """Voxels of tiles inside total, the last tile winning, in a folder for each slab of `block` sections."""
    inside = pieces.where(total.holds(*map(F.col, AXES)))
    whole = assemble(inside).withColumn("slab", F.floor(F.col("z") / block))
    whole.repartition("slab", F.floor(F.col("y") / block)).sortWithinPartitions("slab", *AXES).write.mode("overwrite").partitionBy("slab").parquet(path)


def write_snapshots(batches: DataFrame, path: str, every: int, number: str = "iteration", keep: Column | None = None, kinds: dict[str, str] | None = None) -> None:
    """Every so many batches, in a folder each, if keep holds; kinds names the types to which columns are cast before."""
    chosen = snapshot(batches, every, number, keep).withColumns({c: F.col(c).cast(k) for c, k in (kinds or {}).items()})
    chosen.write.mode("append").partitionBy(number).parquet(path)


def value_range(batches: DataFrame, number: str = "iteration", value: str = "value") -> DataFrame:
    return batches.groupBy(number).agg(F.min(value).alias("low"), F.max(value).alias("high"))
