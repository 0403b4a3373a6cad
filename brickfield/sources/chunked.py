"""Chunked arrays as folders: a JSON description beside one file for each chunk, in the public Zarr form, version 2.

A data source of Spark's, "chunked", reads them: comparisons of an axis with a number are pushed down to it, so that only
the chunks that a query's box touches are opened, by name and in the tasks; nothing is listed. Chunks are C-order cells of
one kind, plain or packed by zlib or gzip; those at the far edge are whole, with cells past the shape left over, and a
missing chunk holds the fill value. An array has any number of dimensions: the last three are z, y and x, or as many of
them as there are, and those before them channels, c or c0, c1 and on; attributes may name them otherwise (`axes`), and
give the size of a voxel (`resolution`) and the place of the first one (`offset`) in world units.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from brickfield.functions.cells import AXES
from brickfield.functions.geometry import Box

#: Partitions of a scan at most; beyond them a partition has several chunks.
MOST_PARTITIONS = 20_000
PACKERS = {None: lambda b: b, "zlib": zlib.compress, "gzip": lambda b: zlib.compress(b, wbits=31)}


@dataclass(frozen=True)
class Chunked:
    """What the description says of an array."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str = "<f8"
    packer: str | None = "zlib"
    fill: float = 0
    separator: str = "."
    resolution: tuple[int, ...] = (1, 1, 1)
    offset: tuple[int, ...] = (0, 0, 0)
    named: tuple[str, ...] = ()

    @property
    def axes(self) -> tuple[str, ...]:
        more = len(self.shape) - len(AXES)
        channels = () if more <= 0 else ("c",) if more == 1 else tuple(f"c{i}" for i in range(more))
        return self.named or channels + AXES[max(0, -more) :]

    @property
    def box(self) -> Box:
        """In world units, without channels."""
        n = len(self.offset)
        return Box(self.offset, tuple(m * r for m, r in zip(self.shape[-n:], self.resolution)))

    @property
    def smooth(self) -> bool:
        """Whether values between voxels make sense, as by default for floating kinds and bytes."""
        return np.dtype(self.dtype).kind == "f" or np.dtype(self.dtype) == np.uint8

    def name(self, chunk: Sequence[int]) -> str:
        return self.separator.join(map(str, chunk))


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


def describe(path: str) -> Chunked:
    """The description of the array in a folder."""
    fs, local = filesystem(path)
    found = {}
    for info in fs.get_file_info([f"{local}/.zarray", f"{local}/.zattrs"]):
        if info.is_file:
            with fs.open_input_stream(info.path) as source:
                found[info.base_name] = json.loads(source.read())
    about, attributes = found[".zarray"], found.get(".zattrs", {})
    if about.get("order", "C") != "C" or about.get("filters") or not about["shape"]:
        raise ValueError(f"{path} isn't a plain array in C order")
    packer = (about["compressor"] or {}).get("id")
    if packer not in PACKERS:
        raise ValueError(f"{path} is packed by {packer}")
    places = min(len(about["shape"]), len(AXES))
    triple = lambda k, default: tuple(int(v) for v in attributes.get(k, [default] * places))
    return Chunked(
        tuple(about["shape"]), tuple(about["chunks"]), about["dtype"], packer, about.get("fill_value") or 0, about.get("dimension_separator", "."),
        triple("resolution", 1), triple("offset", 0), tuple(attributes.get("axes", ())),
    )


@dataclass
class Chunks(InputPartition):
    """Chunks by their numbers within the box of a scan."""

    first: int
    end: int


class ChunkReader(DataSourceReader):
    """Reads the chunks that a box touches; filters narrow the box."""

    def __init__(self, path: str, about: Chunked):
        self.path, self.about = path, about
        self.begin, self.end = [0] * len(about.shape), list(about.shape)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of an axis with a whole number; gives the others back to Spark."""
        for f in filters:
            axis, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if axis not in self.about.axes or not isinstance(value, int):
                yield f
                continue
            i = self.about.axes.index(axis)
            low = {EqualTo: value, GreaterThanOrEqual: value, GreaterThan: value + 1}.get(type(f))
            high = {EqualTo: value + 1, LessThan: value, LessThanOrEqual: value + 1}.get(type(f))
            if low is None and high is None:
                yield f
            if low is not None:
                self.begin[i] = max(self.begin[i], low)
            if high is not None:
                self.end[i] = min(self.end[i], high)

    def grid(self) -> tuple[list[int], list[int]]:
        """The first chunk along each axis, and how many."""
        sizes = list(zip(self.begin, self.end, self.about.chunks))
        return [b // c for b, _, c in sizes], [max(0, (e - 1) // c - b // c + 1) if e > b else 0 for b, e, c in sizes]

    def partitions(self) -> Sequence[InputPartition]:
        n = int(np.prod(self.grid()[1], dtype=np.int64))
        each = max(1, -(-n // MOST_PARTITIONS))
        return [Chunks(i, min(n, i + each)) for i in range(0, n, each)] or [Chunks(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        about, (first, counts) = self.about, self.grid()
        fs, local = filesystem(self.path)
        for number in range(partition.first, partition.end):
            chunk = [int(i) + f for i, f in zip(np.unravel_index(number, counts), first)]
            try:
                with fs.open_input_stream(f"{local}/{about.name(chunk)}", compression=None) as source:
                    data = source.read()
                data = zlib.decompress(data, wbits=47) if about.packer else data
                cells = np.frombuffer(data, dtype=about.dtype).reshape(about.chunks)
            except FileNotFoundError:
                cells = np.broadcast_to(np.array(about.fill, dtype=about.dtype), about.chunks)
            start = [i * c for i, c in zip(chunk, about.chunks)]
            low = [max(b, s) for b, s in zip(self.begin, start)]
            cells = cells[tuple(slice(b - s, min(e - s, c)) for b, e, s, c in zip(low, self.end, start, about.chunks))]
            at = [(i + o).ravel() for i, o in zip(np.indices(cells.shape), low)]
            yield pa.record_batch({a: pa.array(i) for a, i in zip(about.axes, at)} | {"value": pa.array(cells.ravel().astype(float))})


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunked"

    def schema(self) -> str:
        return ", ".join(f"`{a}` long" for a in describe(self.options["path"]).axes) + ", value double"

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(self.options["path"], describe(self.options["path"]))


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("chunked") known to a session."""
    spark.dataSource.register(ChunkSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_chunked(spark: SparkSession, path: str, box: Box | None = None) -> DataFrame:
    """The axes (voxels from the array's first) and value, a double, of the array or of a box in voxels along its last axes.

    Only the chunks that the box touches are opened; those that aren't there give the fill value.
    """
    register(spark)
    rows = spark.read.format("chunked").load(path)
    return rows.where(box.holds(*[F.col(a) for a in rows.columns[:-1][-len(box.begin) :]])) if box else rows


def create_chunked(path: str, about: Chunked) -> None:
    """Writes the description of a new array, before any of its chunks."""
    fs, local = filesystem(path)
    fs.create_dir(local, recursive=True)
    described = {
        "zarr_format": 2, "shape": about.shape, "chunks": about.chunks, "dtype": about.dtype, "order": "C", "filters": None, "fill_value": about.fill,
        "compressor": about.packer and {"id": about.packer, "level": 6}, "dimension_separator": about.separator,
    }
    for name, content in ((".zarray", described), (".zattrs", {"resolution": about.resolution, "offset": about.offset} | ({"axes": about.named} if about.named else {}))):
        with fs.open_output_stream(f"{local}/{name}") as out:
            out.write(json.dumps(content).encode())


def write_chunked(voxels: DataFrame, path: str, about: Chunked) -> int:
    """Writes the chunks that voxels (the axes and value) touch into an array that create_chunked() made; their number.

    Writes of disjoint chunks may run one after another or together. A chunk is written under another name and renamed, so
    a task that runs again leaves one whole file. Cells without a voxel get the fill value.
    """
    axes, place, chunk = about.axes, F.lit(0).cast("long"), []
    rows = voxels.where(Box((0,) * len(axes), about.shape).holds(*map(F.col, axes)))
    for a, c in zip(axes, about.chunks):
        place = place * c + F.col(a) % c
        chunk.append(F.floor(F.col(a) / c).cast("long").alias(f"_{a}"))
    blocks = rows.groupBy(*chunk).agg(F.collect_list(F.struct(place.alias("i"), F.col("value").cast("double").alias("v"))).alias("cells"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, local = filesystem(path)
        written = 0
        for b in batches:
            numbers = zip(*[b.column(f"_{a}").to_pylist() for a in axes])
            for chunk, cells in zip(numbers, b.column("cells")):
                name = f"{local}/{about.name(chunk)}"
                if about.separator == "/":
                    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
                known = pa.array(cells.values).drop_null()
                values, there = known.field("v"), known.field("v").is_valid()
                data = np.full(about.chunks, about.fill, dtype=about.dtype).ravel()
                data[known.field("i").filter(there).to_numpy()] = values.filter(there).to_numpy().astype(about.dtype)
                own = f"{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as out:
                    out.write(PACKERS[about.packer](data.tobytes()))
                fs.move(own, name)
                written += 1
        yield pa.record_batch({"n": pa.array([written])})

    return sum(r["n"] for r in blocks.mapInArrow(kernel, "n long").collect())  # a number for each task
