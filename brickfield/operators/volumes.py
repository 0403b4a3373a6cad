"""Operators on volumes of many blocks whose context is no fixed margin: integrals, distances, deformation, resampling, padding.

A volume is voxel rows (batch_id, z, y, x and a value) from 0 on, within an extent. Blocks are Arrow lists of the cells of
one box; what one block needs of others goes to it as a small summary, a line or the blocks that it reads, never as a
window over voxels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brickfield.functions.cells import AXES, Grid, few, gather, kind_of, stacked
from brickfield.functions.geometry import Box
from brickfield.operators.blocks import KEYS, between


def in_blocks(voxels: DataFrame, block: Sequence[int], name: str, fill: float | None = 0) -> tuple[DataFrame, Grid]:
    """Blocks (batch_id, bz, by, bx and the cells), those that have a voxel. One shuffle."""
    grid = Grid(tuple(block))
    rows = voxels.select("batch_id", name, *[F.floor(F.col(a) / b).cast("int").alias(f"b{a}") for a, b in zip(AXES, block)], *[F.pmod(F.col(a), F.lit(b)).alias(a) for a, b in zip(AXES, block)])
    # Stated here, so that a join doesn't infer it and both uses of the blocks share one exchange.
    rows = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in KEYS))
    return gather(rows, grid, KEYS, name, fill), grid


def lists(arrays: np.ndarray) -> pa.Array:
    """The rows of an array, as lists."""
    flat = np.ascontiguousarray(arrays).reshape(len(arrays), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def voxel_rows(batch: pa.RecordBatch, cells: np.ndarray, shape: Sequence[int], extent: Sequence[int], name: str) -> pa.RecordBatch:
    """A row for each cell, within the extent, of the blocks of a batch."""
    at = [np.repeat(batch.column(f"b{a}").to_numpy().astype(np.int64) * b, math.prod(shape)) + np.tile(i.ravel(), batch.num_rows) for a, b, i in zip(AXES, shape, np.indices(shape))]
    inside = np.logical_and.reduce([a < n for a, n in zip(at, extent)])
    return pa.record_batch({"batch_id": pa.array(np.repeat(batch.column("batch_id").to_numpy(), math.prod(shape))[inside])} | {a: pa.array(c[inside]) for a, c in zip(AXES, at)} | {name: pa.array(cells.ravel()[inside])})


# Integrals


def before(axis: str, sizes: dict[str, int], kind: str) -> Callable[[pa.Table], pa.Table]:
    """For a line of blocks: each of the lists named, of so many numbers, as the sum of those of the blocks before it."""

    def along(group: pa.Table) -> pa.Table:
        group = group.sort_by(axis).combine_chunks()
        out = {n: group.column(n) for n in group.column_names}
        for n, size in sizes.items():
            whole = np.zeros((len(group), size), dtype=np.int64 if kind == "long" else float)
            there = np.flatnonzero(group.column(n).is_valid().to_numpy())
            if len(there):
                whole[there] = group.column(n).combine_chunks().drop_null().flatten().to_numpy().reshape(len(there), size)
            out[n] = lists(np.concatenate([np.zeros_like(whole[:1]), whole.cumsum(0)[:-1]]))
        return pa.table(out)

    return along


def integral(voxels: DataFrame, extent: Sequence[int], block: Sequence[int], name: str = "value") -> DataFrame:
    """batch_id, z, y, x and integral, the sum of the values of all voxels up to and with each place along every axis, for all places of the extent.

    Blocks are summed up on their own. What lies before a block is in the far faces, edges and corners of other blocks'
    sums, which are added up along one axis after the other and joined to it; they are a share of about 3 / block of the
    voxels, and voxels are shuffled once. Places without a voxel count as 0.
    """
    kind = "long" if kind_of(voxels, name) in ("int", "long") else "double"
    blocks, grid = in_blocks(voxels.withColumn(name, F.col(name).cast(kind)), block, name)
    all_blocks = voxels.select("batch_id").distinct()
    for a, n, b in zip(AXES, extent, block):
        all_blocks = all_blocks.withColumn(f"b{a}", F.explode(F.sequence(F.lit(0), F.lit(-(-n // b) - 1))))
    # Of the sums within a block those at its far sides: by the axes along which they are at the end.
    sides = {f"s{''.join(map(str, s))}": s for s in ((0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2))}
    sizes = {n: math.prod(b for k, b in enumerate(block) if k not in s) for n, s in sides.items()}
    element = {"long": "bigint", "double": "double"}[kind]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, grid.size):
            sums = stacked(b.column(name), grid).cumsum(1).cumsum(2).cumsum(3)
            found = {n: lists(sums[(slice(None), *[-1 if k in s else slice(None) for k in range(3)])]) for n, s in sides.items()}
            yield pa.record_batch({k: b.column(k) for k in KEYS} | found)

    batch_kind = voxels.schema["batch_id"].dataType.simpleString()
    schema = f"batch_id {batch_kind}, bz int, by int, bx int, " + ", ".join(f"{n} array<{element}>" for n in sides)
    summary = all_blocks.join(blocks.mapInArrow(ends, schema), KEYS, "left")
    # A side is added up along each axis that it is at the end of: the sum of those before a block.
    for k, a in enumerate(AXES):
        moving = [n for n, s in sides.items() if k in s]

        summary = summary.groupBy("batch_id", *[f"b{o}" for o in AXES if o != a]).applyInArrow(before(f"b{a}", {n: sizes[n] for n in moving}, kind), schema)
    joined = summary.join(blocks, KEYS, "left")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, grid.size):
            cells = b.column(name)
            sums = np.zeros((b.num_rows, *grid.shape), dtype=np.int64 if kind == "long" else float)
            there = np.flatnonzero(cells.is_valid().to_numpy(zero_copy_only=False))
            if len(there):
                sums[there] = stacked(cells.drop_null(), grid)
            sums = sums.cumsum(1).cumsum(2).cumsum(3)
            for n, s in sides.items():
                sums += b.column(n).flatten().to_numpy().reshape(b.num_rows, *[1 if k in s else m for k, m in enumerate(block)])
            yield voxel_rows(b, sums, block, extent, "integral")

    return joined.mapInArrow(whole, f"batch_id {batch_kind}, z long, y long, x long, integral {element}")


# Distances


def envelope(costs: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    """By column of costs: min over i of costs[i] + (at[i] - p) ** 2 for each p of out, both in order; the lower envelope of parabolas, in time linear in the length."""
    n, columns = costs.shape
    place = np.zeros((n + 1, columns), dtype=np.int64)  # the parabolas of the envelope, in order
    start = np.full((n + 1, columns), np.inf)  # from where on each is the lowest
    top = np.full(columns, -1)
    every = np.arange(columns)
    for i in range(n):
        left = every[np.isfinite(costs[i])]
        begin = np.full(columns, -np.inf)
        while len(left):
            under = left[top[left] >= 0]
            if not len(under):
                break
            below = place[top[under], under]
            meet = ((costs[i, under] + at[i] ** 2) - (costs[below, under] + at[below] ** 2)) / (2 * (at[i] - at[below]))
            begin[under] = meet
            left = under[meet <= start[top[under], under]]
            top[left] -= 1
            begin[left] = -np.inf
        new = every[np.isfinite(costs[i])]
        top[new] += 1
        place[top[new], new], start[top[new], new] = i, begin[new]
    found = np.full((len(out), columns), np.inf)
    some = every[top >= 0]
    turn = np.zeros(columns, dtype=np.int64)
    for k, p in enumerate(out):
        ahead = some
        while len(ahead):
            ahead = ahead[turn[ahead] < top[ahead]]
            ahead = ahead[start[turn[ahead] + 1, ahead] <= p]
            turn[ahead] += 1
        i = place[turn[some], some]
        found[k, some] = costs[i, some] + (at[i] - p) ** 2
    return found


def pencils(rows: DataFrame, keys: Sequence[str], along: str, extent: int, step: float, width: int) -> DataFrame:
    """rows (keys, along and d, a list of `width` squared distances) with d at each even place along an axis instead, its nearest of all there."""
    out = np.arange(extent) * 2 * step

    def line(group: pa.Table) -> pa.Table:
        group = group.sort_by(along).combine_chunks()
        at, which = np.unique(group.column(along).to_numpy(), return_inverse=True)
        costs = np.full((len(at), width), np.inf)
        np.minimum.at(costs, which, group.column("d").combine_chunks().flatten().to_numpy().reshape(len(group), width))
        far = envelope(costs, at * step, out)
        return pa.table({k: group.column(k).take(pa.array(np.zeros(extent, dtype=np.int64))) for k in keys} | {along: pa.array(np.arange(extent)), "d": lists(far)})

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInArrow(line, f"{kinds}, {along} long, d array<double>")


def boundary_distance(labels: DataFrame, extent: Sequence[int], size: Sequence[float] = (1, 1, 1), width: int = 64, name: str = "label") -> DataFrame:
    """batch_id, z, y, x and distance: of each voxel of labels to the nearest face between voxels of different labels, at any distance.

    0 on background, and where the batch has no such face. Faces lie at half voxels, the odd places of a grid twice as fine;
    distances go along one axis after the other, a shuffle of lines each, in runs of `width` places along x.
    """
    nz, ny, nx = extent
    width = min(width, nx)
    faces = []
    for k, a in enumerate(AXES):
        here = [F.col(o) * 2 + (1 if o == a else 0) for o in AXES]
        other = labels.select("batch_id", *[F.col(o) - (1 if o == a else 0) if o == a else F.col(o) for o in AXES], F.col(name).alias("_other")).toDF("batch_id", *AXES, "_other")
        pairs = labels.join(other, ["batch_id", *AXES]).where(F.col(name) != F.col("_other"))
        faces.append(pairs.select("batch_id", *[c.cast("long").alias(f"f{o}") for c, o in zip(here, AXES)]))
    fine = faces[0].unionByName(faces[1]).unionByName(faces[2])
    # Along x: each line of faces, in runs of `width`.
    starts = list(range(0, nx, width))
    lines = fine.groupBy("batch_id", "fz", "fy").agg(F.sort_array(F.collect_set("fx")).alias("fx"))
    batch_kind = labels.schema["batch_id"].dataType.simpleString()

    def along_x(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = 2 * np.arange(len(starts) * width)
        for b in few(batches, len(places)):
            column = b.column("fx")
            flat, cuts = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets.to_numpy()[0]
            far = np.empty((b.num_rows, len(places)))
            for r in range(b.num_rows):
                own = flat[cuts[r] : cuts[r + 1]]
                after = np.searchsorted(own, places)
                low, high = own[np.maximum(after - 1, 0)], own[np.minimum(after, len(own) - 1)]
                far[r] = (np.minimum(np.abs(places - low), np.abs(high - places)) * (size[2] / 2)) ** 2
            n = len(starts)
            yield pa.record_batch({k: b.column(k).take(pa.array(np.repeat(np.arange(b.num_rows), n))) for k in ("batch_id", "fz", "fy")} | {"run": pa.array(np.tile(np.arange(n), b.num_rows)), "d": lists(far.reshape(b.num_rows * n, width))})

    first = lines.mapInArrow(along_x, f"batch_id {batch_kind}, fz long, fy long, run long, d array<double>")
    second = pencils(first, ["batch_id", "fz", "run"], "fy", ny, size[1] / 2, width)
    third = pencils(second, ["batch_id", "fy", "run"], "fz", nz, size[0] / 2, width)
    rows = third.select("batch_id", F.col("fz").alias("z"), F.col("fy").alias("y"), "run", F.posexplode("d").alias("_i", "_d"))
    rows = rows.select("batch_id", "z", "y", (F.col("run") * width + F.col("_i")).alias("x"), "_d")
    far = F.when(F.col(name) > 0, F.sqrt(F.coalesce("_d", F.lit(0.0)))).otherwise(F.lit(0.0))
    return labels.join(rows, ["batch_id", *AXES], "left").select("batch_id", *AXES, far.alias("distance"))


# Deformation


def from_source(voxels: DataFrame, extent: Sequence[int], block: Sequence[int], places: DataFrame, name: str = "value", outside: float = 0.0) -> DataFrame:
    """batch_id, z, y, x and value: at each of places (batch_id, z, y, x and s_z, s_y, s_x) the voxel nearest to s, `outside` where there is none.

    Places are dealt to blocks, a block's sources tell which blocks it reads, and those come to it by an equi-join on their
    number, however far away they are and however many. So the margin of a block is what its own field asks for.
    """
    blocks, grid = in_blocks(voxels.withColumn(name, F.col(name).cast("double")), block, name, None)
    for a in AXES:
        places = places.withColumn(f"s_{a}", F.floor(F.col(f"s_{a}") + 0.5))
    cell = F.struct(*[F.pmod(F.col(a), F.lit(b)).cast("int").alias(a) for a, b in zip(AXES, block)], *[F.col(f"s_{a}").cast("int").alias(f"s_{a}") for a in AXES])
    own = [F.floor(F.col(a) / b).cast("int").alias(f"b{a}") for a, b in zip(AXES, block)]
    source = [F.floor(F.col(f"s_{a}") / b).cast("int").alias(f"f{a}") for a, b in zip(AXES, block)]
    asked = places.select("batch_id", *own, *source, cell.alias("c")).groupBy(*KEYS, *[f"f{a}" for a in AXES]).agg(F.collect_list("c").alias("cells"))
    met = asked.join(blocks.toDF("batch_id", *[f"f{a}" for a in AXES], "_data"), ["batch_id", *[f"f{a}" for a in AXES]], "left")
    batch_kind = voxels.schema["batch_id"].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, grid.size):
            cells, data = b.column("cells"), b.column("_data")
            flat = cells.flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(cells.offsets.to_numpy()))
            there = data.is_valid().to_numpy(zero_copy_only=False)
            values = np.full((b.num_rows, grid.size), math.nan)
            if there.any():
                values[there] = stacked(data.drop_null(), grid).reshape(-1, grid.size)
            s = [flat.field(f"s_{a}").to_numpy().astype(np.int64) % n for a, n in zip(AXES, block)]
            found = values[row, (s[0] * block[1] + s[1]) * block[2] + s[2]]
            at = {a: pa.array(b.column(f"b{a}").to_numpy().astype(np.int64)[row] * n + flat.field(a).to_numpy()) for a, n in zip(AXES, block)}
            yield pa.record_batch({"batch_id": b.column("batch_id").take(pa.array(row))} | at | {name: pa.array(np.where(np.isnan(found), outside, found))})

    return met.mapInArrow(look_up, f"batch_id {batch_kind}, z long, y long, x long, {name} double")


def deform(voxels: DataFrame, extent: Sequence[int], block: Sequence[int], source: Callable[[Sequence[Column]], Sequence[Column]], name: str = "value") -> DataFrame:
    """The volume by the nearest voxel of source(z, y, x), a field of places, for all places of the extent; 0 outside.

    source may read columns of voxels that are the same for a whole batch through F.col("batch_id").
    """
    places = voxels.select("batch_id").distinct()
    for a, n in zip(AXES, extent):
        places = places.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    where = [c.alias(f"s_{a}") for c, a in zip(source([F.col(a) for a in AXES]), AXES)]
    return from_source(voxels, extent, block, places.select("batch_id", *AXES, *where), name)


# Grids of other shape


def resample(voxels: DataFrame, extent: Sequence[int], size: Sequence[int], target: Sequence[int], order: int, block: Sequence[int], name: str = "value") -> tuple[DataFrame, tuple[int, ...]]:
    """The volume on voxels of size `target`, in blocks of the new grid, and its extent; order and edges as operators.blocks.resample().

    A voxel goes to the blocks of the new grid whose cells it weighs in on, which its place tells; a block reads the box of
    the old grid that its cells look at. One shuffle. Places without a voxel count as 0.
    """
    reach = {0: 1, 1: 1, 3: 2}[order]
    outer = tuple(n * s // t for n, s, t in zip(extent, size, target))
    wide, begin, rows = [], [], voxels.select("batch_id", *AXES, F.col(name).cast("double").alias(name))
    for a, n, s, t, b, m in zip(AXES, extent, size, target, block, outer):
        first = F.floor(((F.col(a) - reach - 1 + 0.5) * s / t - 0.5) / b)
        last = F.floor(((F.col(a) + reach + 1 + 0.5) * s / t + 0.5) / b)
        rows = rows.withColumn(f"b{a}", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(F.greatest(last, F.lit(0)), F.lit((m - 1) // b))).cast("array<int>")))
        begin.append(lambda k, s=s, t=t, b=b: np.floor((k * b + 0.5) * t / s - 0.5).astype(np.int64) - reach)
        wide.append(math.ceil(b * t / s) + 2 * reach + 2)
    # The first old voxel that a block of the new grid looks at.
    low = [F.floor((F.col(f"b{a}") * b + 0.5) * t / s - 0.5) - reach for a, s, t, b in zip(AXES, size, target, block)]
    here = rows.select(*KEYS, name, *[(F.col(a) - c).cast("int").alias(a) for a, c in zip(AXES, low)])
    inside = F.lit(True)
    for a, w in zip(AXES, wide):
        inside &= (F.col(a) >= 0) & (F.col(a) < w)
    grid = Grid(tuple(wide))
    blocks = gather(here.where(inside), grid, KEYS, name, 0.0)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, grid.size):
            v = stacked(b.column(name), grid)
            for axis, (a, n, s, t, m, lowest) in enumerate(zip(AXES, extent, size, target, block, begin)):
                number = b.column(f"b{a}").to_numpy().astype(np.int64)[:, None]
                centre = (number * m + np.arange(m) + 0.5) * t / s
                base, top = lowest(number), v.shape[axis + 1] - 1
                take = lambda at, v=v, axis=axis: np.take_along_axis(v, np.expand_dims(np.clip(np.clip(at, 0, n - 1) - base, 0, top), [k for k in (1, 2, 3) if k != axis + 1]), axis + 1)  # noqa: B023, E731
                if order == 0:
                    v = take(np.floor(centre).astype(np.int64))
                    continue
                at = np.clip(centre - 0.5, 0, n - 1)
                floor = np.floor(at).astype(np.int64)
                shape = [b.num_rows, *[m if k == axis else 1 for k in range(3)]]
                v = sum(take(floor + d) * w.reshape(shape) for d, w in between(at - floor, order))
            yield voxel_rows(b, v, block, outer, name)

    batch_kind = voxels.schema["batch_id"].dataType.simpleString()
    return blocks.mapInArrow(compute, f"batch_id {batch_kind}, z long, y long, x long, {name} double"), outer


def images(at: Column, n: int, margin: int) -> Column:
    """The places from -margin to n + margin that reflection at the ends of n places shows `at` at."""
    turn = max(1, 2 * (n - 1))
    shifts = F.sequence(F.lit(-((n + margin) // turn + 1)), F.lit((2 * n + margin) // turn + 1))
    every = F.array_distinct(F.flatten(F.transform(shifts, lambda k: F.array(at + k * turn, k * turn - at))))
    return F.filter(every, lambda i: (i >= -margin) & (i < n + margin))


def pad(voxels: DataFrame, extent: Sequence[int], size: Sequence[int], mode: str = "constant", value: float = 0.0, name: str = "value") -> DataFrame:
    """The volume with `size` more places at both ends of each axis, which then begins at -size: of a value, or reflected without repeating the edge.

    Reflection sends each voxel to its images; nothing is shuffled. A constant fills the places that the margin has.
    """
    rows = voxels.select("batch_id", *AXES, name)
    if mode == "reflect":
        for a, n, p in zip(AXES, extent, size):
            rows = rows.withColumn(a, F.explode(images(F.col(a), n, p)))
        return rows
    margin = voxels.select("batch_id").distinct()
    for a, n, p in zip(AXES, extent, size):
        margin = margin.withColumn(a, F.explode(F.sequence(F.lit(-p), F.lit(n + p - 1))))
    outside = margin.where(~Box((0, 0, 0), tuple(extent)).holds(*map(F.col, AXES)))
    kind = voxels.schema[name].dataType
    return rows.unionByName(outside.select("batch_id", *[F.col(a).cast(voxels.schema[a].dataType).alias(a) for a in AXES], F.lit(value).cast(kind).alias(name)))
