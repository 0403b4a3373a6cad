import math

from hypothesis import given, strategies as st

from brickfield.functions.geometry import Box, bounding, common_multiple, shared

boxes = st.builds(lambda b, s: Box(tuple(b), tuple(s)), st.lists(st.integers(-20, 20), min_size=3, max_size=3), st.lists(st.integers(1, 20), min_size=3, max_size=3))


@given(boxes, boxes)
def test_intersection_lies_in_both(a, b):
    both = a.intersect(b)
    assert both == b.intersect(a)
    assert both.empty or (a.contains(both) and b.contains(both))


@given(boxes, boxes)
def test_union_holds_both(a, b):
    assert a.union(b).contains(a) and a.union(b).contains(b)
    assert bounding([a, b]) == a.union(b) and shared([a, b]) == a.intersect(b)


@given(boxes, st.lists(st.integers(1, 7), min_size=3, max_size=3))
def test_snapping(a, grid):
    out, inner = a.snap(grid), a.snap(grid, "shrink")
    assert out.contains(a) and all(b % g == 0 for b, g in zip(out.begin, grid))
    assert inner.empty or a.contains(inner)


@given(boxes, st.lists(st.integers(0, 9), min_size=3, max_size=3))
def test_grow_and_back(a, n):
    assert a.grow(n, n).grow([-x for x in n], [-x for x in n]) == a


def test_unbounded():
    free = Box((None, 0, 0), (None, 10, 10))
    assert free.contains((10**9, 5, 5)) and not free.contains((0, 10, 5))
    assert free.intersect(Box((3, -5, 2), (4, 10, 3))) == Box((3, 0, 2), (4, 5, 3))


def test_centre_and_voxels():
    assert Box((90, 14, 7), (300, 40, 25)).center == (240, 34, 19)
    assert Box((-36, 15, 8), (240, 45, 12)).voxels((12, 3, 2)) == Box((-3, 5, 4), (20, 15, 6))
    assert Box((-5,), (10,)).voxels((20,)).begin == (-1,)
    assert Box((90, 14, 7), (300, 40, 25)).grow((60, 4, 3), (60, 4, 3)) == Box((30, 10, 4), (420, 48, 31))


def test_common_multiple():
    assert common_multiple([(4, 4), None, (6, 2)]) == (12, 4)
    assert math.lcm(4, 6) == 12
