"""Operators on dense blocks (functions.cells): each cell is computed from its neighbours in the same row.

Cells that are null, as with_halo() leaves them outside a volume, count as what lies past a block's edge.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from brickfield.functions.cells import ABSENT, AT_ONCE, AXES, Grid, explode, gather, kernel, kind_of, moved

KEYS = ["batch_id", "bz", "by", "bx"]


def with_halo(voxels: DataFrame, block: Sequence[int], margin: Sequence[int], name: str = "value") -> tuple[DataFrame, Grid]:
    """Blocks of a large volume with what lies up to margin past their edges: batch_id, bz, by, bx and the array.

    A voxel goes to each block whose grown box holds it, at most two an axis while margin is below block. The grid
    returned is the grown one; cells outside the volume are null.
    """
    grid = Grid(tuple(b + 2 * m for b, m in zip(block, margin)))
    return gather(beside_blocks(voxels, block, margin), grid, KEYS, name), grid


def beside_blocks(voxels: DataFrame, block: Sequence[int], margin: Sequence[int]) -> DataFrame:
    """voxels beside each block whose grown box holds them, z, y and x being their place in that."""
    for axis, b, m in zip(AXES, block, margin):
        first, last = F.floor((F.col(axis) - m) / b).cast("int"), F.floor((F.col(axis) + m) / b).cast("int")
        voxels = voxels.withColumn(f"b{axis}", F.explode(F.sequence(first, last)))
    for axis, b, m in zip(AXES, block, margin):
        voxels = voxels.withColumn(axis, F.col(axis) - F.col(f"b{axis}") * b + m)
    return voxels


def whole_volume(voxels: DataFrame, block: Sequence[int], margin: Sequence[int], compute: Callable[[Column, Grid], dict[str, Column]], name: str = "value") -> DataFrame:
    """compute(block, grid) over a volume of any size: an operator, by column name, that looks up to margin past a voxel.

    Each block is read with its margin, computed, and cut back to itself, so that the result is that of one block that
    holds everything. It has batch_id, z, y, x and the computed columns, for the voxels of the volume alone.
    """
    rows, grid = with_halo(voxels, block, margin, name)
    made = compute(F.col(name), grid)
    rows = rows.withColumns({f"_{n}": c for n, c in made.items()})
    cut = [crop_block(F.col(c), grid, margin, block, kind_of(rows, c))[0].alias(c) for c in (name, *[f"_{n}" for n in made])]
    cells = explode(rows.select("batch_id", "bz", "by", "bx", *cut), Grid(tuple(block)), name, *[f"_{n}" for n in made]).where(F.col(name).isNotNull())
    return cells.select("batch_id", *[(F.col(f"b{a}") * b + F.col(a)).cast("long").alias(a) for a, b in zip(AXES, block)], *[F.col(f"_{n}").alias(n) for n in made])


def sorted_volume(voxels: DataFrame, block: Sequence[int], margin: Sequence[int], compute: Callable[[np.ndarray], dict[str, np.ndarray]], names: Sequence[str], name: str = "value") -> DataFrame:
    """whole_volume() by a function of arrays: compute(cells) of (block, z, y, x), NaN where there is no voxel, gives such an array of doubles for each of names.

    A task gets its voxels in the order of blocks and puts some AT_ONCE cells of blocks together at once, so that no block is a
    row, and memory grows neither with blocks nor with batches.
    """
    grid = Grid(tuple(b + 2 * m for b, m in zip(block, margin)))
    rows = beside_blocks(voxels.where(F.col(name).isNotNull()), block, margin).select(*KEYS, grid.index(*[F.col(a) for a in AXES]).cast("int").alias("_i"), F.col(name).cast("double").alias("_v"))
    rows = rows.repartition(int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEYS).sortWithinPartitions(*KEYS)
    inside = (slice(None), *[slice(m, m + b) for b, m in zip(block, margin)])
    step = max(1, AT_ONCE // grid.size)

    def starts(rows: pa.Table) -> np.ndarray:
        """The first row of each block."""
        new = np.zeros(max(0, len(rows) - 1), dtype=bool)
        for k in KEYS:
            after, before = rows.column(k).slice(1), rows.column(k).slice(0, len(new))
            new |= pc.or_(pc.not_equal(after, before).fill_null(False), pc.xor(after.is_null(), before.is_null())).to_numpy()
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    def made(rows: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, values = rows.column("_i").to_numpy(), rows.column("_v").to_numpy()
        for k in range(0, len(first), step):
            own = first[k : k + step]
            low, high = own[0], first[k + step] if k + step < len(first) else len(rows)
            cells = np.full((len(own), grid.size), math.nan)
            cells[np.searchsorted(own, np.arange(low, high), side="right") - 1, at[low:high]] = values[low:high]
            cells = cells.reshape(-1, *grid.shape)
            here = np.nonzero(~np.isnan(cells[inside]))
            found = {n: pa.array(v[inside][here]) for n, v in compute(cells).items()}
            places = {a: pa.array(rows.column(f"b{a}").to_numpy()[own].astype(np.int64)[here[0]] * b + c) for a, b, c in zip(AXES, block, here[1:])}
            yield pa.record_batch({"batch_id": rows.column("batch_id").take(pa.array(own[here[0]])).combine_chunks()} | places | found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= AT_ONCE:
                rows = pa.Table.from_batches(held).combine_chunks()
                first = starts(rows)
                yield from made(rows.slice(0, first[-1]), first[:-1])  # the last block may go on
                held = rows.take(pa.array(np.arange(first[-1], len(rows)))).to_batches()
                n = len(rows) - first[-1]
        if n:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from made(rows, starts(rows))

    batch_kind = voxels.schema["batch_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"batch_id {batch_kind}, z long, y long, x long, " + ", ".join(f"{n} double" for n in names))


def crop_block(data: Column, grid: Grid, begin: Sequence[int], shape: Sequence[int], kind: str = "double") -> tuple[Column, Grid]:
    inside = (slice(None), *[slice(b, b + n) for b, n in zip(begin, shape)])
    return kernel(lambda v: v[inside], grid, kind, data), Grid(tuple(shape))


def pad_block(data: Column, grid: Grid, size: Sequence[int], mode: str = "constant", value: float = 0.0) -> tuple[Column, Grid]:
    """data with size more voxels at both ends of each axis: a constant, or reflected without repeating the edge."""
    outer = Grid(tuple(n + 2 * p for n, p in zip(grid.shape, size)))

    def fold(p: int, n: int) -> np.ndarray:
        """The places of an axis, there and back again."""
        if n == 1:
            return np.zeros(1 + 2 * p, dtype=int)
        at = (np.arange(n + 2 * p) - p) % (2 * (n - 1))
        return np.where(at < n, at, 2 * (n - 1) - at)

    def constant(v: np.ndarray) -> np.ndarray:
        return np.pad(v, [(0, 0), *[(p, p) for p in size]], constant_values=value)

    def reflect(v: np.ndarray) -> np.ndarray:
        return v[np.ix_(np.arange(len(v)), *[fold(p, n) for p, n in zip(size, grid.shape)])]

    return kernel(constant if mode == "constant" else reflect, grid, "double", data), outer


def between(part: np.ndarray, order: int) -> list[tuple[int, np.ndarray]]:
    """The weights of the voxels around a place, by their steps from the one before it; part: how far behind that one it lies."""
    if order == 1:
        return [(0, 1 - part), (1, part)]
    far = lambda d: ((-0.5 * d + 2.5) * d - 4) * d + 2
    near = lambda d: (1.5 * d - 2.5) * d * d + 1
    return [(-1, far(1 + part)), (0, near(part)), (1, near(1 - part)), (2, far(2 - part))]


def resample(data: Column, grid: Grid, size: Sequence[int], target: Sequence[int], order: int | bool) -> tuple[Column, Grid]:
    """data of voxel size `size` on voxels of size `target`: the voxel under each centre (order 0), or between centres, linear (1) or cubic (3).

    Past the edge the outermost voxel counts. The cubic kernel is the interpolating one with slopes of -1/2.
    """
    outer = Grid(tuple(n * s // t for n, s, t in zip(grid.shape, size, target)))

    def nearest(v: np.ndarray) -> np.ndarray:
        at = [np.minimum(np.floor((np.arange(m) + 0.5) * t / s).astype(int), n - 1) for m, s, t, n in zip(outer.shape, size, target, grid.shape)]
        return v[np.ix_(np.arange(len(v)), *at)]

    def smooth(v: np.ndarray) -> np.ndarray:
        for axis, (m, s, t, n) in enumerate(zip(outer.shape, size, target, grid.shape), 1):
            at = np.clip((np.arange(m) + 0.5) * t / s - 0.5, 0, n - 1)
            low = np.floor(at).astype(int)
            shape = [m if k == axis else 1 for k in range(4)]
            v = sum(np.take(v, np.clip(low + d, 0, n - 1), axis) * w.reshape(shape) for d, w in between(at - low, order))
        return v

    return kernel(smooth if order else nearest, grid, "double", data), outer


def affinities(labels: Column, grid: Grid, offset: Sequence[int]) -> Column:
    """1 where a voxel and the one at offset hold the same label above 0, else 0; 0 where there is none."""
    return kernel(lambda v: (moved(v, offset, 0) == v) & (v > 0), grid, "int", labels)


def affinities_mask(mask: Column, unlabelled: Column, grid: Grid, offset: Sequence[int]) -> Column:
    """Affinities of mask where those of the unlabelled voxels (0 in `unlabelled`) are 0."""

    def known(m: np.ndarray, u: np.ndarray) -> np.ndarray:
        blank = u == 0
        return (moved(m, offset, 0) == m) & (m > 0) & ~(moved(blank, offset, False) & blank)

    return kernel(known, grid, "int", mask, unlabelled)


def nonsymmetric_affinities(first: Column, second: Column, grid: Grid, vector: Sequence[int]) -> tuple[Column, Column]:
    """first[p] and second[p - vector], and second[p] and first[p + vector]; 0 past the edge."""

    def both(a: Column, b: Column, sign: int) -> Column:
        return kernel(lambda v, w: (v > 0) & (moved(w, [sign * c for c in vector], 0) > 0), grid, "int", a, b)

    return both(first, second, -1), both(second, first, 1)


def ball(radius: float, size: Sequence[float] = (1, 1, 1), least: float = 0.0, l1: bool = False) -> list[tuple[int, int, int]]:
    """Offsets within radius, in world units of voxels of the given size, and at least `least` away."""
    reach = [math.ceil(radius / s) for s in size]
    found = []
    for z in range(-reach[0], reach[0] + 1):
        for y in range(-reach[1], reach[1] + 1):
            for x in range(-reach[2], reach[2] + 1):
                at = [abs(c) * s for c, s in zip((z, y, x), size)]
                far = sum(at) if l1 else math.sqrt(sum(a * a for a in at))
                if least <= far <= radius:
                    found.append((z, y, x))
    return found


def squared_distance(marks: np.ndarray, size: Sequence[float]) -> np.ndarray:
    """Of each cell of (block, z, y, x) to the nearest mark in its block, squared; infinite without any.

    Exact, an axis after the other: the least over an axis of what is known plus the squared step along it.
    """
    far = np.where(marks, 0.0, np.inf)
    for axis, s in enumerate(size):
        known, far = far, far.copy()
        for step in range(1, marks.shape[axis + 1]):
            for by in (-step, step):
                np.minimum(far, moved(known, [by if k == axis else 0 for k in range(3)], np.inf) + (step * s) ** 2, out=far)
    return far


def enlarge(mask: Column, grid: Grid, radius: float, size: Sequence[float] = (1, 1, 1), ring: float | None = None) -> Column:
    """1 within radius of a voxel of mask; with ring, not within the inner share (1 - ring). Uniform masks stay."""

    def grow(m: np.ndarray) -> np.ndarray:
        far = squared_distance(m > 0, size)
        found = far <= radius * radius + 1e-9
        if ring is not None:
            found &= far > (radius * (1 - ring)) ** 2 + 1e-9
        flat = m.reshape(len(m), -1)
        same = (flat.min(axis=1, initial=np.iinfo(np.int64).max, where=flat != ABSENT) >= flat.max(axis=1, initial=ABSENT)).reshape(-1, 1, 1, 1)
        return np.where(same, m, found.astype(np.int64))

    return kernel(grow, grid, "int", mask)


def ignore_mask(kept: Column, grid: Grid, erode: float, size: Sequence[float] = (1, 1, 1)) -> Column:
    """1 where a kept label lies nearer than erode; erode 0 gives none."""
    return kernel(lambda v: squared_distance(v > 0, size) < erode * erode - 1e-9, grid, "int", kept)


def grow_boundary(labels: Column, grid: Grid, steps: int = 1, flat: bool = False, background: int = 0, mask: Column | None = None) -> Column:
    """Each label eroded `steps` times by a cross, within sections if flat; past the edge counts as the label.

    A voxel survives if no unmasked voxel of another label lies within steps in L1 distance; one that is masked out counts
    as any label, and survives if that holds for some label.
    """
    offsets = [o for o in ball(steps, l1=True) if not flat or o[0] == 0]
    most = np.iinfo(np.int64).max

    def erode(v: np.ndarray, m: np.ndarray | None = None) -> np.ndarray:
        seen = v != ABSENT if m is None else (v != ABSENT) & (m > 0)
        low, high = np.where(seen, v, most), np.where(seen, v, ABSENT)
        least, largest = low.copy(), high.copy()
        for o in offsets:
            np.minimum(least, moved(low, o, most), out=least)
            np.maximum(largest, moved(high, o, ABSENT), out=largest)
        # An unmasked voxel must not be background; one masked out must not see background alone.
        stays = (least >= largest) & (v != ABSENT) & (np.where(seen, v, least) != background)
        return np.where(stays, v, background)

    return kernel(erode, grid, "int", *([labels] if mask is None else [labels, mask]))


def find_boundaries(v: np.ndarray) -> np.ndarray:
    """On the grid of 2n - 1 cells an axis: true between voxels of different labels."""
    fine = np.zeros((len(v), *[2 * n - 1 for n in v.shape[1:]]), dtype=bool)
    for axis in (1, 2, 3):
        low, high = (tuple(s if k == axis else slice(None) for k in range(4)) for s in (slice(None, -1), slice(1, None)))
        between = tuple(slice(1, None, 2) if k == axis else slice(None, None, 2) if k else slice(None) for k in range(4))
        fine[between] = (v[low] != v[high]) & (v[low] != ABSENT) & (v[high] != ABSENT)
    return fine


def boundaries(labels: Column, grid: Grid) -> tuple[Column, Grid]:
    """On the grid of 2n - 1 cells an axis: 1 between voxels of different labels."""
    return kernel(find_boundaries, grid, "int", labels), Grid(tuple(2 * n - 1 for n in grid.shape))


def distances(v: np.ndarray, size: Sequence[float]) -> np.ndarray:
    """Of each voxel of labels v to the nearest face or edge between labels of its block; 0 on background, infinite without any."""
    far = np.sqrt(squared_distance(find_boundaries(v), [s / 2 for s in size])[:, ::2, ::2, ::2])
    return np.where(v > 0, far, 0.0)


def limited_distance(labels: Column, grid: Grid, reach: float | None = None, size: Sequence[float] = (1, 1, 1)) -> Column:
    """Of each voxel to the nearest face or edge between labels, 0 on background.

    With reach, at most that, so that blocks with a margin of over reach agree with the whole volume. Without, blocks that
    have no boundary have distance 0.
    """

    def limited(v: np.ndarray) -> np.ndarray:
        far = distances(v, size)
        return np.where(np.isinf(far), 0.0, far) if reach is None else np.minimum(far, float(reach))

    return kernel(limited, grid, "double", labels)


def boundary_distance(blocks: DataFrame, grid: Grid, reach: float | None = None, size: Sequence[float] = (1, 1, 1), labels: str = "label") -> DataFrame:
    """batch_id and distance, as limited_distance()."""
    return blocks.select(F.col("batch_id").cast("long").alias("batch_id"), limited_distance(F.col(labels), grid, reach, size).alias("distance"))


def distance_gradients(labels: Column, grid: Grid, size: Sequence[float] = (1, 1, 1), norm: str | None = None, decay: tuple[float, float] | None = None) -> list[Column]:
    """By axis: the slope of the distance to the nearest boundary, 0 on background.

    norm "l1" or "l2" divides the three by their norm where that is at least 1e-5. decay (alpha, beta) multiplies them by
    beta * exp(-alpha * distance).
    """
    if norm not in (None, "l1", "l2"):
        raise ValueError(f"unknown norm {norm}")

    def slopes(v: np.ndarray) -> list[np.ndarray]:
        far = distances(v, size)
        far = np.where(np.isinf(far), 0.0, far)
        found = [np.where(v > 0, slope(far, k + 1, s), 0.0) for k, s in enumerate(size)]
        if norm:
            length = sum(np.abs(g) for g in found) if norm == "l1" else np.sqrt(sum(g * g for g in found))
            found = [g / np.where(length < 1e-5, 1.0, length) for g in found]
        if decay:
            found = [g * (np.exp(-far * decay[0]) * decay[1]) for g in found]
        return found

    return [kernel(lambda v, k=k: slopes(v)[k], grid, "double", labels) for k in range(3)]


def slope(v: np.ndarray, axis: int, spacing: float) -> np.ndarray:
    """Central differences along an axis, one-sided at its ends and beside NaN; 0 where there is no other cell."""
    step = [1 if k + 1 == axis else 0 for k in range(3)]
    after, before = moved(v, step, math.nan), moved(v, [-c for c in step], math.nan)
    ends = np.isnan(after) | np.isnan(before)
    single = (np.where(np.isnan(after), v, after) - np.where(np.isnan(before), v, before)) / spacing
    return np.where(ends, single, single / 2)


def gradient(data: Column, grid: Grid, axis: int, spacing: float = 1.0) -> Column:
    """Central differences along an axis, one-sided at its ends; 0 where the axis has one voxel."""
    return kernel(lambda v: slope(v, axis + 1, spacing), grid, "double", data)


def deform(data: Column, grid: Grid, source: Callable) -> Column:
    """Each cell from the voxel nearest to source(z, y, x), a triple of arrays of places; 0 where that lies outside."""

    def fill(v: np.ndarray) -> np.ndarray:
        at = [np.rint(np.broadcast_to(c, grid.shape)).astype(int) for c in source(*np.indices(grid.shape))]
        inside = np.logical_and.reduce([(c >= 0) & (c < n) for c, n in zip(at, grid.shape)])
        return np.where(inside, v[(slice(None), *[np.clip(c, 0, n - 1) for c, n in zip(at, grid.shape)])], 0.0)

    return kernel(fill, grid, "double", data)


def prepare_malis(labels: Column, ignore: Column) -> tuple[Column, Column]:
    """The labels for the negative pass, with ignored voxels as a label of their own, and for the positive pass."""
    return F.zip_with(labels, ignore, lambda v, keep: F.when(keep == 0, F.array_max(labels) + 1).otherwise(v)), labels


def exclusive_zone(mask: Column, grid: Grid, radius: float, size: Sequence[float] = (1, 1, 1)) -> Column:
    """0 in the ring that enlarging mask adds to it, 1 elsewhere."""
    return F.zip_with(enlarge(mask, grid, radius, size), mask, lambda e, m: 1 - F.when((e > 0) & ~(m > 0), 1).otherwise(0))


def unsqueeze(data: Column) -> Column:
    """Blocks as the only channel of an array of channels."""
    return F.array(data)


def squeeze(channels: Column) -> Column:
    """The only channel; the query fails where there isn't just one."""
    return F.when(F.size(channels) == 1, F.get(channels, F.lit(0))).otherwise(F.raise_error(F.lit("only channels of one entry can go")))
