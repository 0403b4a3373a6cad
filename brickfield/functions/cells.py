"""Dense blocks: an array column with the cells of a small grid in C order.

A block is one row, so neighbourhood operators are projections over its cells and need no shuffle; operators that look
past a block's edge take blocks with a halo (operators.blocks.with_halo). A value for each cell on its own is a lambda over
the array; one from a cell's neighbours is an Arrow kernel over all blocks of a batch, as lambdas are not compiled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

AXES = ("z", "y", "x")
#: What a null cell of whole numbers is in a kernel; one of floats is NaN, so a cell of NaN counts as null.
ABSENT = np.iinfo(np.int64).min
#: Cells that a kernel computes at once, so that its copies of them stay small beside the batch.
AT_ONCE = 1 << 18
KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


@dataclass(frozen=True)
class Grid:
    """The shape of a block, in voxels, along z, y and x."""

    shape: tuple[int, int, int]

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    def at(self, i: Column) -> tuple[Column, Column, Column]:
        """Coordinates of the cell number i."""
        _, ny, nx = self.shape
        whole = lambda n: F.floor(i / F.lit(n)).cast("int")
        return whole(ny * nx), whole(nx) % ny, (i % nx).cast("int")

    def index(self, z: Column, y: Column, x: Column) -> Column:
        return (z * self.shape[1] + y) * self.shape[2] + x

    def inside(self, z: Column, y: Column, x: Column) -> Column:
        tests = [(c >= 0) & (c < n) for c, n in zip((z, y, x), self.shape)]
        return tests[0] & tests[1] & tests[2]

    def get(self, data: Column, z: Column, y: Column, x: Column, default: Column | None = None) -> Column:
        """The cell at (z, y, x), or default outside."""
        return F.when(self.inside(z, y, x), F.get(data, self.index(z, y, x).cast("int"))).otherwise(default)

    def fill(self, value: Callable[[Column, Column, Column], Column]) -> Column:
        """An array over this grid of value(z, y, x)."""
        return F.transform(F.sequence(F.lit(0), F.lit(self.size - 1)), lambda i: value(*self.at(i)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row. Within a cell function an expression is otherwise computed for each cell."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stacked(blocks: pa.Array, grid: Grid) -> np.ndarray:
    """The cells of blocks, none of them null, as (block, z, y, x): long, null cells being ABSENT, or double."""
    cells = blocks.flatten()
    whole = pa.types.is_integer(cells.type) or pa.types.is_boolean(cells.type)
    cells = cells.cast(pa.int64() if whole else pa.float64())
    return cells.fill_null(ABSENT if whole else math.nan).to_numpy().reshape(-1, *grid.shape)


def listed(cells: np.ndarray, kind: pa.DataType) -> pa.Array:
    """(block, z, y, x) as lists; ABSENT and NaN are null again."""
    flat = np.ascontiguousarray(cells).reshape(-1)
    size = cells[0].size if len(cells) else 0
    absent = flat == ABSENT if flat.dtype == np.int64 else np.isnan(flat) if flat.dtype.kind == "f" else None
    values = pa.array(flat, mask=absent).cast(kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * size), values)


def few(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that rows of so many cells each have AT_ONCE or one row at most."""
    step = max(1, AT_ONCE // max(1, cells))
    return (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step))


def in_pieces(run: Callable[..., pa.Array], cells: int) -> Callable[..., pa.Array]:
    """run over arrays, of so many cells a row, piece by piece."""
    step = max(1, AT_ONCE // max(1, cells))

    def pieces(*arrays: pa.Array) -> pa.Array:
        if len(arrays[0]) <= step:
            return run(*arrays)
        return pa.concat_arrays([run(*[a.slice(i, step) for a in arrays]) for i in range(0, len(arrays[0]), step)])

    return pieces


def kernel(compute: Callable[..., np.ndarray], grid: Grid, kind: str, *columns: Column) -> Column:
    """The block column of compute(arrays), which gets (block, z, y, x) for each column and gives the same over its own grid.

    It is null where one of the columns is. Batches are bounded by Spark's settings in rows and bytes, what is computed at
    once by AT_ONCE.
    """
    out = KINDS[kind]

    def run(*blocks: pa.Array) -> pa.Array:
        there = np.logical_and.reduce([b.is_valid().to_numpy(zero_copy_only=False) for b in blocks])
        if there.all():
            return listed(compute(*[stacked(b, grid) for b in blocks]), out)
        rows = pa.array(np.flatnonzero(there))
        if not len(rows):
            return pa.nulls(len(there), pa.list_(out))
        found = listed(compute(*[stacked(b.take(rows), grid) for b in blocks]), out)
        return found.take(pa.array(np.cumsum(there) - 1, mask=~there))

    def computed(*blocks: pa.Array) -> pa.Array:
        return in_pieces(run, grid.size)(*blocks)

    return F.arrow_udf(computed, f"array<{kind}>")(*columns)


def moved(cells: np.ndarray, by: Sequence[int], outside: float) -> np.ndarray:
    """For each cell that at `by` from it; `outside` where there is none."""
    out = np.full_like(cells, outside)
    to, source = [slice(None)], [slice(None)]
    for d, n in zip(by, cells.shape[1:]):
        to.append(slice(max(0, -d), max(0, n - max(0, d))))
        source.append(slice(min(n, max(0, d)), max(0, n + min(0, d))))
    out[tuple(to)] = cells[tuple(source)]
    return out


def explode(blocks: DataFrame, grid: Grid, *names: str) -> DataFrame:
    """A row for each voxel, with z, y, x and the cells of the named array columns under their names."""
    others = [c for c in blocks.columns if c not in names]
    rows = blocks.select(*others, F.posexplode(F.arrays_zip(*names)).alias("_i", "_c"))
    z, y, x = grid.at(F.col("_i"))
    return rows.select(*others, z.alias("z"), y.alias("y"), x.alias("x"), *[F.col(f"_c.{n}").alias(n) for n in names])


def scattered(entries: Column, grid: Grid, kind: str, fill: float | None = None) -> Column:
    """Block columns from arrays of (place, value) structs; cells without an entry, or with a null one, are `fill` or null."""
    out = KINDS[kind]

    def run(lists: pa.Array) -> pa.Array:
        flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        at = np.repeat(np.arange(len(lists)), sizes) * grid.size + flat.field(0).to_numpy()
        there = np.zeros(len(lists) * grid.size, dtype=bool)
        cells = np.zeros(len(there), dtype=np.float64 if kind == "double" else np.int64)
        known = flat.field(1).is_valid().to_numpy(zero_copy_only=False)
        cells[at[known]], there[at[known]] = flat.field(1).drop_null().to_numpy(zero_copy_only=False), True
        values = pa.array(cells, mask=~there).cast(out)
        values = values if fill is None else values.fill_null(pa.scalar(fill, out))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * grid.size), values)

    def computed(lists: pa.Array) -> pa.Array:
        return in_pieces(run, grid.size)(lists)

    return F.arrow_udf(computed, f"array<{kind}>")(entries)


def kind_of(df: DataFrame, name: str) -> str:
    """The kernel's kind of a column, or of the cells of an array column."""
    kind = df.schema[name].dataType
    kind = getattr(kind, "elementType", kind).simpleString()
    return "double" if kind in ("double", "float") else "long" if kind == "bigint" else "int"


def gather(voxels: DataFrame, grid: Grid, keys: list[str], name: str, fill: float | None = None) -> DataFrame:
    """Blocks of the voxels that share keys; cells without a voxel are `fill` or null. One shuffle on the keys."""
    cell = F.struct(grid.index(F.col("z"), F.col("y"), F.col("x")).cast("int").alias("i"), F.col(name).alias("v"))
    rows = voxels.groupBy(*keys).agg(F.collect_list(cell).alias("_cells"))
    return rows.select(*keys, scattered(F.col("_cells"), grid, kind_of(voxels, name), fill).alias(name))
