"""Elastic deformation: jittered control points, rotation and scale give a source location for each place.

The field is a formula of the place and the batch's seed, so voxels, points and any block agree on it without a table of
fields, and nothing is shuffled. elastic_field() gives it as data for volumes of any size, from control points that are
drawn once each; operators.volumes.from_source() looks up what it points at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from brickfield.functions.cells import AXES, Grid, let
from brickfield.functions.draws import below, uniform
from brickfield.operators.graphs import numbered
from brickfield.operators.neighbors import k_nearest


def jitter(seed: Column, point: Sequence[Column], axis: int, sigma: float, normal: bool = False) -> Column:
    """The displacement of a control point along an axis: uniform or normal, of standard deviation sigma."""
    place = ((point[0] * 31 + point[1]) * 37 + point[2] + 5003) * 3 + axis
    if normal:
        return F.sqrt(-2 * F.log(1 - uniform(seed, place))) * F.cos(F.lit(2 * math.pi) * uniform(seed, place + (1 << 24))) * sigma
    return (uniform(seed, place) - 0.5) * (sigma * math.sqrt(12))


def field(draw: Callable[[Sequence[Column], int], Column], at: Sequence[Column], center: Sequence[float], spacing: Sequence[float], sigma: Sequence[float], angle: Column | Sequence[Column] | None = None, scale: Column | None = None) -> list[Column]:
    """Where the value at `at` (z, y, x) comes from: draw(control point, axis) between control points, then rotation and scale around center.

    One angle turns about z; three turn about z, then y, then x.
    """
    low = [F.floor(c / s).cast("int") for c, s in zip(at, spacing)]
    part = [c / s - b for c, s, b in zip(at, spacing, low)]
    moved = []
    for axis, c in enumerate(at):
        if not sigma[axis]:
            moved.append(c - center[axis])
            continue
        terms = []
        for corner in range(8):
            step = [corner >> 2 & 1, corner >> 1 & 1, corner & 1]
            weight = reduce(lambda a, b: a * b, [p if s else 1 - p for p, s in zip(part, step)])
            terms.append(weight * draw([b + s for b, s in zip(low, step)], axis))
        moved.append(c + reduce(lambda a, b: a + b, terms) - center[axis])
    return turned(moved, center, angle, scale)


def turned(moved: Sequence[Column], center: Sequence[float], angle: Column | Sequence[Column] | None = None, scale: Column | None = None) -> list[Column]:
    """Places relative to center (z, y, x), rotated and scaled around it, as places again."""
    z, y, x = moved
    if angle is not None:
        about = [angle] if isinstance(angle, Column) else list(angle)
        y, x = F.cos(about[0]) * y - F.sin(about[0]) * x, F.sin(about[0]) * y + F.cos(about[0]) * x
        if len(about) == 3:
            z, x = F.cos(about[1]) * z - F.sin(about[1]) * x, F.sin(about[1]) * z + F.cos(about[1]) * x
            z, y = F.cos(about[2]) * z - F.sin(about[2]) * y, F.sin(about[2]) * z + F.cos(about[2]) * y
    if scale is not None:
        z, y, x = z * scale, y * scale, x * scale
    return [c + m for c, m in zip((z, y, x), center)]


def elastic_field(batches: DataFrame, extent: Sequence[int], spacing: Sequence[int], sigma: Sequence[float], *, angle: Column | Sequence[Column] | None = None, scale: Column | None = None, normal: bool = False, sections: DataFrame | None = None) -> DataFrame:
    """batch_id, z, y, x and s_z, s_y, s_x, where the value at each place of the extent comes from, for each of batches (batch_id, seed).

    Control points, a volume `spacing` times coarser with a channel for each axis, are drawn and brought to the cells between
    them; a cell spreads out its own places. angle and scale are expressions of batches' columns. sections (batch_id, z, dy,
    dx) moves whole sections within themselves, after all else.
    """
    center = [(n - 1) / 2 for n in extent]
    counts = [(n - 1) // s + 2 for n, s in zip(extent, spacing)]
    seeds, points = [c for c in batches.columns if c != "batch_id"], batches
    for a, n in zip(AXES, counts):
        points = points.withColumn(f"_c{a}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = [F.col(f"_c{a}") for a in AXES]
    points = points.withColumns({f"_d{k}": jitter(F.col("seed"), at, k, sigma[k], normal) if sigma[k] else F.lit(0.0) for k in range(3)})
    points = points.withColumn("_corner", F.explode(F.sequence(F.lit(0), F.lit(7))))
    for k, (a, n) in enumerate(zip(AXES, counts)):
        points = points.withColumn(f"_c{a}", F.col(f"_c{a}") - F.shiftright("_corner", 2 - k).bitwiseAND(F.lit(1))).where((F.col(f"_c{a}") >= 0) & (F.col(f"_c{a}") < n - 1))
    corners = F.array_sort(F.collect_list(F.struct("_corner", *[f"_d{k}" for k in range(3)]))).alias("_corners")
    rows = points.groupBy("batch_id", *[f"_c{a}" for a in AXES]).agg(corners, *[F.first(c).alias(c) for c in seeds])
    for k, (a, n, s) in enumerate(zip(AXES, extent, spacing)):
        rows = rows.withColumn(a, F.explode(F.sequence(F.col(f"_c{a}") * s, F.least(F.col(f"_c{a}") * s + s, F.lit(n)) - 1)))
        if not k and sections is not None:
            rows = rows.join(sections.select("batch_id", "z", "dy", "dx"), ["batch_id", "z"], "left")
    part = [F.col(a) / s - F.col(f"_c{a}") for a, s in zip(AXES, spacing)]
    moved = []
    for k, (a, c) in enumerate(zip(AXES, center)):
        terms = []
        for corner in range(8):
            steps = [corner >> 2 & 1, corner >> 1 & 1, corner & 1]
            weight = reduce(lambda x, y: x * y, [p if s else 1 - p for p, s in zip(part, steps)])
            terms.append(weight * F.col("_corners")[corner][f"_d{k}"])
        moved.append(F.col(a) + reduce(lambda x, y: x + y, terms) - c)
    source = turned(moved, center, angle, scale)
    if sections is not None:
        source = [source[0], source[1] + F.coalesce("dy", F.lit(0)), source[2] + F.coalesce("dx", F.lit(0))]
    return rows.select("batch_id", *AXES, *[c.alias(f"s_{a}") for a, c in zip(AXES, source)])


def misaligned(batches: DataFrame, sections: int, slip: float, shift: float, reach: int) -> DataFrame:
    """batch_id, z, dy and dx: how far each section of batches (batch_id, seed) is off.

    With probability `slip` a section is moved alone, with probability `shift` it and all after it are, by up to reach.
    """
    rows = batches.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(sections - 1))))
    draw, seed = uniform(F.col("seed"), F.col("z") * 8 + 60), F.col("seed")
    offset = lambda k: below(seed, F.col("z") * 8 + 61 + k, 2 * reach + 1) - reach
    upto = Window.partitionBy("batch_id").orderBy("z").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_draw": draw, "_oy": offset(0), "_ox": offset(1)})
    own, on = F.col("_draw") <= slip, (F.col("_draw") > slip) & (F.col("_draw") <= slip + shift)
    moved = {f"d{a}": F.sum(F.when(on, F.col(f"_o{a}")).otherwise(0)).over(upto) + F.when(own, F.col(f"_o{a}")).otherwise(0) for a in "yx"}
    return rows.withColumns(moved).select("batch_id", "z", "dy", "dx")


def deform_block(data: Column, grid: Grid, seed: Column, spacing: Sequence[float], sigma: Sequence[float], angle: Column | Sequence[Column] | None = None, scale: Column | None = None, normal: bool = False) -> Column:
    """data by the nearest voxel of its field; 0 outside."""
    center = [(n - 1) / 2 for n in grid.shape]
    control = Grid(tuple(int((n - 1) // s) + 2 for n, s in zip(grid.shape, spacing)))
    jitters = control.fill(lambda z, y, x: F.array(*[jitter(seed, (z, y, x), k, sigma[k], normal) for k in range(3)]))

    def cells(table: Column) -> Column:
        draw = lambda point, axis: F.get(F.get(table, control.index(*point).cast("int")), F.lit(axis))

        def cell(z: Column, y: Column, x: Column) -> Column:
            at = F.array(*[F.floor(c + 0.5).cast("int") for c in field(draw, [z, y, x], center, spacing, sigma, angle, scale)])
            return let(at, lambda p: grid.get(data, *[F.get(p, F.lit(k)) for k in range(3)], F.lit(0.0)))

        return grid.fill(cell)

    return let(jitters, cells)


def deform_points(points: DataFrame, places: DataFrame, seed: Column, center: Sequence[float], spacing: Sequence[float], sigma: Sequence[float], recompute: bool = True) -> DataFrame:
    """points (id, z, y, x) at the place whose source location lies nearest: places are the z, y, x of the target grid.

    The nearest place is sought at any distance; of places equally near the first takes a point. Without recompute, a place
    and a point meet in the cell of the place's source alone: points look in the cells around theirs, and those without a
    place within a voxel's diagonal, as where the field stretches strongly, are left out.
    """
    source = field(lambda point, axis: jitter(seed, point, axis, sigma[axis]), [F.col(a) for a in "zyx"], center, spacing, sigma)
    spread = places.select(*[F.col(a).alias(f"to_{a}") for a in "zyx"], *[c.alias(f"s_{a}") for a, c in zip("zyx", source)])
    if recompute:
        spread = numbered(spread, "to_z", "to_y", "to_x")  # in whose order the first of equal places is found
        found = k_nearest(points.select("id", *"zyx"), spread.select("number", *[F.col(f"s_{a}").alias(a) for a in "zyx"]), "zyx", 1, "id", "number", own=True)
        return found.join(spread.withColumnRenamed("number", "number_r"), "number_r").select("id", *[F.col(f"to_{a}").alias(a) for a in "zyx"])
    for a in "zyx":
        spread = spread.withColumn(f"k_{a}", F.floor(f"s_{a}"))
        points = points.withColumn(f"k_{a}", F.explode(F.array(*[F.floor(a) + d for d in (-1, 0, 1)])))
    far = sum((F.col(f"s_{a}") - F.col(a)) ** 2 for a in "zyx")
    near = points.join(spread, [f"k_{a}" for a in "zyx"]).withColumn("far", far).where("far <= 3")
    best = F.min_by(F.struct("to_z", "to_y", "to_x"), F.struct("far", "to_z", "to_y", "to_x"))
    return near.groupBy("id").agg(best.alias("t")).select("id", *[F.col(f"t.to_{a}").alias(a) for a in "zyx"])
