"""What a source offers and what a request asks for: keys with their boxes, voxel sizes and kinds."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from brickfield.functions.geometry import Box, bounding, common_multiple, shared


@dataclass(frozen=True)
class Spec:
    """One key. A nonspatial array has neither box nor voxel size; a placeholder takes part in planning and has no data."""

    box: Box | None = None
    voxel_size: tuple[int, ...] | None = None
    dtype: str | None = None
    interpolatable: bool | None = None
    graph: bool = False
    directed: bool | None = None
    nonspatial: bool = False
    placeholder: bool = False
    channels: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        if self.nonspatial and (self.box or self.voxel_size):
            raise ValueError("a nonspatial array has no box and no voxel size")

    def updated(self, other: Spec) -> Spec:
        """The bounding box of both; what other states replaces the rest."""
        box = other.box if self.box is None else self.box if other.box is None else self.box.union(other.box)
        stated = {k: v for k, v in vars(other).items() if v is not None and k != "box"}
        return replace(self, **stated, box=None if other.nonspatial else box)

    @property
    def smooth(self) -> bool:
        """Whether values between voxels make sense; by default for floating kinds and uint8."""
        return self.interpolatable if self.interpolatable is not None else (self.dtype or "").startswith("float") or self.dtype == "uint8"

    def squeezed(self, axis: int = 0) -> Spec:
        if not 0 <= axis < len(self.channels) or self.channels[axis] != 1:
            raise ValueError("only channel axes of one entry can go")
        return replace(self, channels=self.channels[:axis] + self.channels[axis + 1 :])

    def unsqueezed(self, axis: int = 0) -> Spec:
        if not 0 <= axis <= len(self.channels):
            raise ValueError("new axes stand among the channels")
        return replace(self, channels=(*self.channels[:axis], 1, *self.channels[axis:]))


@dataclass(frozen=True)
class Catalog:
    """Specs by key, of what is offered or asked for."""

    specs: dict[str, Spec] = field(default_factory=dict)

    def boxes(self) -> list[Box]:
        return [s.box for s in self.specs.values() if s.box is not None]

    @property
    def total(self) -> Box:
        return bounding(self.boxes())

    @property
    def common(self) -> Box:
        return shared(self.boxes())

    @property
    def voxel_size(self) -> tuple[int, ...]:
        """The smallest voxel size that all arrays' sizes divide."""
        return common_multiple([s.voxel_size for s in self.specs.values()])

    def merged(self, other: Catalog) -> Catalog:
        """Both sources' keys, which must differ."""
        if twice := self.specs.keys() & other.specs.keys():
            raise ValueError(f"offered twice: {sorted(twice)}")
        return Catalog(self.specs | other.specs)

    def common_keys(self, *others: Catalog) -> set[str]:
        return set(self.specs).intersection(*(o.specs for o in others))

    def asked(self, shapes: dict[str, tuple[int, ...]]) -> Catalog:
        """A request of these shapes, all centred where the largest one is."""
        request = {k: Box((0,) * len(s), s) for k, s in shapes.items()}
        center = bounding(list(request.values())).center
        moved = {k: b.shift([c - o for c, o in zip(center, b.center)]) for k, b in request.items()}
        return Catalog({k: Spec(box=b) for k, b in moved.items()})

    def check(self, request: Catalog) -> None:
        """Raises if the request asks for more than is offered."""
        for key, want in request.specs.items():
            have = self.specs.get(key)
            if have is None:
                raise ValueError(f"{key} is not offered")
            if want.box and have.box and not have.box.contains(want.box):
                raise ValueError(f"{key}: {want.box} is outside {have.box}")
            if want.voxel_size and have.voxel_size and want.voxel_size != have.voxel_size:
                raise ValueError(f"{key} has voxels of {have.voxel_size}")
            if want.dtype and have.dtype and want.dtype != have.dtype:
                raise ValueError(f"{key} is {have.dtype}")
            if want.directed is not None and have.directed is not None and want.directed != have.directed:
                raise ValueError(f"{key}: direction differs")
            size = have.voxel_size
            if want.box and size and any(b % v or s % v for b, s, v in zip(want.box.begin, want.box.shape, size)):
                raise ValueError(f"{key}: {want.box} is not made of voxels of {size}")

    def wanted(self) -> set[str]:
        """The keys of a request whose data is to be read or computed: all but placeholders."""
        return {k for k, s in self.specs.items() if not s.placeholder}

    def skips(self, provides: set[str]) -> bool:
        """True if a request needs nothing of what an operator provides, so that it can be left out of the plan."""
        return not self.wanted() & provides

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each key."""
        rows = [
            (k, "graph" if s.graph else "array", *((list(s.box.begin), list(s.box.shape)) if s.box else (None, None)), list(s.voxel_size) if s.voxel_size else None, s.dtype, s.smooth, s.nonspatial, s.placeholder)
            for k, s in sorted(self.specs.items())
        ]
        return spark.createDataFrame(rows, "key string, kind string, begin array<bigint>, shape array<bigint>, voxel_size array<bigint>, dtype string, interpolatable boolean, nonspatial boolean, placeholder boolean")
