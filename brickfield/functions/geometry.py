"""Half-open integer boxes [begin, begin + shape) and the same tests as column expressions.

None as a component means unbounded on that axis. Quotients that don't divide are floored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Box:
    begin: tuple[int | None, ...]
    shape: tuple[int | None, ...]

    @property
    def end(self) -> tuple[int | None, ...]:
        return tuple(None if b is None or s is None else b + s for b, s in zip(self.begin, self.shape))

    @property
    def empty(self) -> bool:
        return any(s is not None and s <= 0 for s in self.shape)

    @property
    def center(self) -> tuple[int, ...]:
        return tuple(b + s // 2 for b, s in zip(self.begin, self.shape))

    @property
    def size(self) -> int:
        return math.prod(max(s, 0) for s in self.shape)

    def grow(self, before: Sequence[int], after: Sequence[int]) -> Box:
        return Box(
            tuple(None if b is None else b - n for b, n in zip(self.begin, before)),
            tuple(None if s is None else s + n + p for s, n, p in zip(self.shape, before, after)),
        )

    def shift(self, by: Sequence[int]) -> Box:
        return Box(tuple(None if b is None else b + d for b, d in zip(self.begin, by)), self.shape)

    def intersect(self, other: Box) -> Box:
        begin = tuple(y if x is None else x if y is None else max(x, y) for x, y in zip(self.begin, other.begin))
        end = tuple(y if x is None else x if y is None else min(x, y) for x, y in zip(self.end, other.end))
        return Box(begin, tuple(None if b is None or e is None else max(0, e - b) for b, e in zip(begin, end)))

    def union(self, other: Box) -> Box:
        """The bounding box of both; an empty box adds nothing."""
        if self.empty or other.empty:
            return other if self.empty else self
        begin = tuple(None if x is None or y is None else min(x, y) for x, y in zip(self.begin, other.begin))
        end = tuple(None if x is None or y is None else max(x, y) for x, y in zip(self.end, other.end))
        return Box(begin, tuple(None if b is None or e is None else e - b for b, e in zip(begin, end)))

    def contains(self, other: Box | Sequence[float]) -> bool:
        if isinstance(other, Box):
            return all(
                (b is None or (ob is not None and ob >= b)) and (e is None or (oe is not None and oe <= e))
                for b, e, ob, oe in zip(self.begin, self.end, other.begin, other.end)
            )
        return all((b is None or p >= b) and (e is None or p < e) for b, e, p in zip(self.begin, self.end, other))

    def snap(self, grid: Sequence[int], mode: str = "grow") -> Box:
        """Begin and end on multiples of grid, moved outwards or ("shrink") inwards."""
        down = lambda v, g: v // g * g
        up = lambda v, g: -(-v // g) * g
        first, last = (down, up) if mode == "grow" else (up, down)
        begin = tuple(first(b, g) for b, g in zip(self.begin, grid))
        return Box(begin, tuple(last(e, g) - b for e, g, b in zip(self.end, grid, begin)))

    def voxels(self, size: Sequence[int]) -> Box:
        """The box in voxel units."""
        return Box(tuple(b // v for b, v in zip(self.begin, size)), tuple(s // v for s, v in zip(self.shape, size)))

    def holds(self, *at: Column) -> Column:
        """True for points inside."""
        tests = [F.lit(True)]
        for c, b, e in zip(at, self.begin, self.end):
            tests += [c >= F.lit(b)] * (b is not None) + [c < F.lit(e)] * (e is not None)
        return reduce(lambda x, y: x & y, tests)


def common_multiple(sizes: Sequence[Sequence[int] | None]) -> tuple[int, ...]:
    """The smallest voxel size that all given ones divide."""
    known = [s for s in sizes if s is not None]
    return tuple(math.lcm(*axis) for axis in zip(*known))


def bounding(boxes: Sequence[Box]) -> Box:
    return reduce(Box.union, boxes)


def shared(boxes: Sequence[Box]) -> Box:
    return reduce(Box.intersect, boxes)
