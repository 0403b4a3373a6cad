"""Neighbours through a partition of space: counts within a radius, and the nearest points at any distance.

Points at one place are one place, however many they are. A k-d tree is fitted on a bounded sample of the places, so that
its leaves hold about CELL of them, and every place is dealt to its leaf. The leaves' tight boxes, a bounded table, tell
each query which leaves it has to ask: those whose box its ball touches, or that lie nearer than its kth neighbour so far.
A leaf that lies wholly within the radius is counted without being asked. A leaf's queries are dealt to parts of about
ASKED, each beside the leaf's places, so neither a dense spot nor a leaf that many ask is one task's. Within its task a
leaf is cut further, into cells of INNER, found through a tree of their boxes: leaves are a bounded number, so they grow
with the places, and a query must not look at each of a leaf's cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from brickfield.functions.scratch import written

#: Places that a leaf is meant to have, those of a cell within it, places of the sample, about, and those of it that a leaf has at least.
CELL, INNER, SAMPLE, FEW = 512, 128, 1 << 16, 16
#: Queries that a part of a leaf answers, about, distances computed at once, and rows dealt to leaves at once.
ASKED, PAIRS, ROUTED = 1 << 13, 1 << 20, 1 << 17

Cuts = dict[int, tuple[int, float]]


def fit(points: np.ndarray, least: float) -> Cuts:
    """Median splits of the widest axis, by node (the children of i are 2 i and 2 i + 1), until `least` points or fewer are left."""
    cuts: Cuts = {}
    waiting = [(1, points)]
    while waiting:
        node, own = waiting.pop()
        if len(own) <= least:
            continue
        low, high = own.min(axis=0), own.max(axis=0)
        axis = int((high - low).argmax())
        if low[axis] == high[axis]:
            continue
        along = own[:, axis]
        cut = float(np.partition(along, len(own) // 2)[len(own) // 2])
        if cut == high[axis]:  # both sides have points
            cut = float(along[along < cut].max())
        cuts[node] = axis, cut
        waiting += [(2 * node, own[along <= cut]), (2 * node + 1, own[along > cut])]
    return cuts


def route(cuts: Cuts, points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    leaf = np.empty(len(points), dtype=np.int64)
    waiting = [(1, np.arange(len(points)))]
    while waiting:
        node, rows = waiting.pop()
        if node not in cuts:
            leaf[rows] = node
        elif len(rows):
            axis, cut = cuts[node]
            left = points[rows, axis] <= cut
            waiting += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]
    return leaf


def between(points: np.ndarray, low: np.ndarray, high: np.ndarray, both: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of points from the nearest and the farthest place of each box, the latter if `both`."""
    near, far = np.zeros((len(points), len(low))), np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        a, b = low[None, :, k] - points[:, None, k], points[:, None, k] - high[None, :, k]
        near += np.maximum(np.maximum(a, b), 0) ** 2
        if both:
            far += np.maximum(np.abs(a), np.abs(b)) ** 2
    return near, far


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum((a[:, None, k] - b[None, :, k]) ** 2 for k in range(a.shape[1]))


Nodes = dict[int, tuple[int, np.ndarray, np.ndarray]]


def tree(leaves: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> Nodes:
    """What each leaf holds and its box, and those of the splits above, from their own; the children of i are 2 i and 2 i + 1."""
    nodes: Nodes = {}
    for leaf, *own in zip(leaves.tolist(), n.tolist(), low, high):
        node = leaf
        while node:
            if node not in nodes:
                nodes[node] = tuple(own)
            else:
                was = nodes[node]
                nodes[node] = was[0] + own[0], np.minimum(was[1], own[1]), np.maximum(was[2], own[2])
            node //= 2
    return nodes


def descend(nodes: Nodes, points: np.ndarray, reach: np.ndarray, whole: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves, each with the rows of points whose squared distance `reach` its box meets; reach may shrink between them.

    With `whole`, boxes that lie wholly within it add what they hold to it and are left out.
    """
    waiting = [(1, np.arange(len(points)))] if 1 in nodes else []
    while waiting:
        node, rows = waiting.pop()
        holds, low, high = nodes[node]
        near, far = between(points[rows], low[None], high[None], whole is not None)
        meets = near[:, 0] <= reach[rows]
        if whole is not None:
            inside = far[:, 0] <= reach[rows]
            whole[rows[inside]] += holds
            meets &= ~inside
        rows = rows[meets]
        if not len(rows):
            continue
        below = [c for c in (2 * node, 2 * node + 1) if c in nodes]
        waiting += [(c, rows) for c in below]
        if not below:
            yield node, rows


def met(nodes: Nodes, points: np.ndarray, reach: np.ndarray, whole: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows and leaves of descend, about PAIRS at once."""
    found, n = [], 0
    for node, rows in descend(nodes, points, reach, whole):
        found.append((rows, np.full(len(rows), node, dtype=np.int64)))
        n += len(rows)
        if n >= PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*found))
            found, n = [], 0
    if found:
        yield tuple(np.concatenate(x) for x in zip(*found))


class Leaf:
    """Points of a leaf in cells of INNER at most, found through a tree of their boxes: coordinates, and the ids of each, or its weight."""

    def __init__(self, points: np.ndarray, numbers: np.ndarray):
        self.cuts = fit(points, INNER)
        own = route(self.cuts, points)
        order = np.lexsort((numbers, own))
        self.points, self.numbers = points[order], numbers[order]
        starts = np.flatnonzero(np.diff(own[order], prepend=-1))
        cells = own[order][starts]
        self.rows = {c: slice(i, j) for c, i, j in zip(cells.tolist(), starts.tolist(), [*starts[1:].tolist(), len(points)])}
        self.nodes = tree(cells, np.add.reduceat(self.numbers, starts), np.minimum.reduceat(self.points, starts), np.maximum.reduceat(self.points, starts))

    def chunks(self, n: int) -> Iterator[slice]:
        step = max(1, PAIRS // INNER)
        return (slice(i, i + step) for i in range(0, n, step))

    def count(self, queries: np.ndarray, radius: float) -> np.ndarray:
        """The sum of the numbers of all points within radius of each query."""
        out, single = np.zeros(len(queries), dtype=np.int64), bool((self.numbers == 1).all())
        for part in self.chunks(len(queries)):
            q, found = queries[part], out[part]
            for cell, some in descend(self.nodes, q, np.full(len(q), radius * radius), found):
                rows = self.rows[cell]
                within = squared(q[some], self.points[rows]) <= radius * radius
                found[some] += np.count_nonzero(within, axis=1) if single else within @ self.numbers[rows]
        return out

    def nearest(self, queries: np.ndarray, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and ids of each query's k nearest points within the squared distance `reach`, ties to the smaller id; inf and -1 where there are fewer."""
        far, ids = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1, dtype=np.int64)
        for part in self.chunks(len(queries)):
            q, least, best, limit = queries[part], far[part], ids[part], reach[part].copy()
            home = route(self.cuts, q)

            def look(cell: int, some: np.ndarray) -> None:
                rows = self.rows[cell]
                d2, numbers = squared(q[some], self.points[rows]), self.numbers[rows]
                kth = np.partition(d2, k - 1, axis=1)[:, k - 1] if d2.shape[1] > k else np.full(len(some), np.inf)
                i, j = np.nonzero(d2 <= np.minimum(kth, limit[some])[:, None])
                order = np.lexsort((numbers[j], d2[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, place = (x[place < k] for x in (i, j, place))
                more, named = np.full((len(some), 2 * k), np.inf), np.full((len(some), 2 * k), -1, dtype=np.int64)
                more[:, :k], named[:, :k] = least[some], best[some]
                more[i, k + place], named[i, k + place] = d2[i, j], numbers[j]
                pick = np.lexsort((named, more))[:, :k]
                least[some], best[some] = np.take_along_axis(more, pick, 1), np.take_along_axis(named, pick, 1)
                limit[some] = np.minimum(limit[some], least[some, k - 1])

            order = np.argsort(home, kind="stable")  # the cell that a query falls into before the others, for its bound
            for some in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
                if len(some):
                    look(int(home[some[0]]), some)
            for cell, some in descend(self.nodes, q, limit):
                apart = some[home[some] != cell]
                if len(apart):
                    look(cell, apart)
        return far, ids


def places(batch: pa.RecordBatch, axes: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(a).to_numpy() for a in axes], axis=1) if batch.num_rows else np.zeros((0, len(axes)))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches put together to about ROUTED rows, so that a walk through all splits serves many."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= ROUTED:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def coordinates(df: DataFrame, axes: Sequence[str], *more: str) -> DataFrame:
    """df's coordinates as doubles, without -0.0, and further columns; rows without a finite place take no part."""
    rows = df.select(*more, *[(F.col(a).cast("double") + F.lit(0.0)).alias(a) for a in axes])
    return rows.where(" AND ".join(f"abs(`{a}`) < double('infinity')" for a in axes))


def partition(spots: DataFrame, axes: Sequence[str], cell: int) -> Cuts:
    """Splits fitted on a sample of spots, a written table."""
    n = spots.count()
    share = min(1.0, SAMPLE / max(1, n))
    some = spots.where(F.pmod(F.xxhash64(*axes), F.lit(1 << 20)) < share * (1 << 20)) if share < 1 else spots
    sample = some.select(*axes).toArrow()  # SAMPLE rows, about
    points = np.stack([sample.column(a).to_numpy() for a in axes], axis=1) if len(sample) else np.zeros((0, len(axes)))
    return fit(points, cell if share == 1 else max(FEW, cell * share))


def dealt(rows: DataFrame, axes: Sequence[str], cuts: Cuts) -> DataFrame:
    """rows with their leaf."""
    known = rows.sparkSession.sparkContext.broadcast(cuts)  # at most SAMPLE / FEW splits
    schema = T.StructType([*rows.schema.fields, T.StructField("leaf", T.LongType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            yield b.append_column("leaf", pa.array(route(known.value, places(b, axes))))

    return rows.mapInArrow(kernel, schema)


class Boxes:
    """The tight boxes of the leaves, with how many points each has."""

    def __init__(self, rows: DataFrame, axes: Sequence[str], weight: str | None):
        ends = [f(a).alias(f"{n}_{a}") for a in axes for n, f in (("low", F.min), ("high", F.max))]
        found = rows.groupBy("leaf").agg((F.sum(weight) if weight else F.count("*")).cast("long").alias("n"), *ends).toArrow()  # a row for each leaf
        self.leaf, self.n = found.column("leaf").to_numpy(), found.column("n").to_numpy()
        self.low, self.high = (np.stack([found.column(f"{e}_{a}").to_numpy() for a in axes], axis=1).reshape(-1, len(axes)) for e in ("low", "high"))

        self.nodes = tree(self.leaf, self.n, self.low, self.high)

    def met(self, points: np.ndarray, reach: np.ndarray, whole: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of points the rows, and leaves, whose boxes lie within the squared distance `reach` of them; `whole` as in descend."""
        return met(self.nodes, points, reach, whole)


def asked(data: DataFrame, visits: DataFrame, axes: Sequence[str], number: str, answer: Callable[[Leaf, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """answer(leaf, visits) for the visits (leaf, p, reach, axes) to each leaf of data (leaf, axes and a number), a written table each."""
    parts = visits.groupBy("leaf").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("p"), F.col("parts")).cast("int").alias("part")
    cells = data.join(F.broadcast(parts), "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), F.col(number).cast("long").alias("p"), F.lit(0.0).alias("reach"), *axes)
    asks = visits.join(F.broadcast(parts), "leaf").select("leaf", part, F.lit(True).alias("asks"), "p", "reach", *axes)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, leaf = None, [], None
        for b in batches:
            keys = np.stack([b.column("leaf").to_numpy(), b.column("part").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if (key := tuple(keys[i, :2].tolist())) != at:
                    at, held, leaf = key, [], None
                if not keys[i, 2]:
                    held.append((places(b.slice(i, j - i), axes), b.column("p").slice(i, j - i).to_numpy()))
                    continue
                if leaf is None and not held:  # nothing lies there
                    continue
                if leaf is None:
                    leaf, held = Leaf(*(np.concatenate(x) for x in zip(*held))), []
                yield from answer(leaf, b.slice(i, j - i))

    both = cells.unionByName(asks).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "asks")
    return both.mapInArrow(kernel, schema)


def count_within(points: DataFrame, axes: Sequence[str], radius: float, key: str = "id") -> DataFrame:
    """key and n, the number of points at most radius from each, itself included."""
    axes = list(axes)
    rows = coordinates(points, axes, key)
    spots = written(rows.groupBy(*axes).agg(F.count("*").alias("n")).withColumn("p", F.monotonically_increasing_id()), "places")
    cuts = partition(spots, axes, CELL)
    data = written(dealt(spots, axes, cuts), "leaves")
    known = data.sparkSession.sparkContext.broadcast(Boxes(data, axes, "n").nodes)
    spot = ", ".join(f"`{a}` double" for a in axes)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, p, whole = places(b, axes), b.column("p").to_numpy(), np.zeros(b.num_rows, dtype=np.int64)
            row = lambda leaf, p, n, at: pa.record_batch([pa.array(x) for x in (leaf, p, n, np.zeros(len(p)), *at.T)], names=["leaf", "p", "n", "reach", *axes])
            for i, leaf in met(known.value, at, np.full(len(at), float(radius) * float(radius)), whole):
                yield row(leaf, p[i], np.zeros(len(i), dtype=np.int64), at[i])
            # A place's own row, of leaf 0, has what its wholly covered leaves hold.
            yield row(np.zeros(len(at), dtype=np.int64), p, whole, at)

    # In the order of leaves, so that a batch's places lie together and meet few of them.
    near = data.repartitionByRange("leaf").sortWithinPartitions("leaf")
    visits = written(near.mapInArrow(visit, f"leaf long, p long, n long, reach double, {spot}"), "visits")

    def answer(leaf: Leaf, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({"p": b.column("p"), "n": pa.array(leaf.count(places(b, axes), radius))})

    some = asked(data, visits.where("leaf > 0"), axes, "n", answer, "p long, n long")
    counts = visits.where("leaf = 0").select("p", "n").unionByName(some).groupBy("p").agg(F.sum("n").alias("_within"))
    at = spots.select("p", *axes).join(counts, "p").drop("p")
    return rows.join(at, axes).select(key, F.col("_within").alias("n"))


def k_nearest(left: DataFrame, right: DataFrame, axes: Sequence[str], k: int, key: str, other: str, own: bool = False, radius: float = float("inf")) -> DataFrame:
    """key, {other}_r, d2 and rank of the k nearest of right to each of left within radius, at any distance without one, ties to the smaller id; without right's row of the same id, unless `own`.

    Ids are whole numbers, those of right unique. Of points at one place only the k + 1 of the smallest ids can be among the
    nearest, so a crowded place is cut to them before it is shuffled.
    """
    axes, most = list(axes), k if own else k + 1
    here = Window.partitionBy(*axes).orderBy("p")
    some = coordinates(right.withColumn("p", F.col(other).cast("long")), axes, "p").withColumn("_n", F.row_number().over(here)).where(F.col("_n") <= most).drop("_n")
    some = written(some, "places")
    cuts = partition(some, axes, max(CELL, 2 * most))
    data = written(dealt(some, axes, cuts), "leaves")
    asks = coordinates(left, axes, key)
    spots = asks.select(*axes).distinct().withColumn("p", F.monotonically_increasing_id()).withColumn("reach", F.lit(float(radius) * float(radius)))
    spots = written(dealt(spots, axes, cuts), "queries")
    spot = ", ".join(f"`{a}` double" for a in axes)
    known = data.sparkSession.sparkContext.broadcast(Boxes(data, axes, None).nodes)

    def answer(leaf: Leaf, b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        reach = b.column("reach").to_numpy()
        d2, ids = leaf.nearest(places(b, axes), most, reach)
        i, j = np.nonzero(np.isfinite(d2))
        none = np.zeros(len(i))
        columns = [np.zeros(len(i), dtype=np.int64), b.column("p").to_numpy()[i], none, *[none] * len(axes), ids[i, j], d2[i, j]]
        return pa.record_batch([pa.array(c) for c in columns], names=["leaf", "p", "reach", *axes, "other", "d2"]), np.minimum(d2[:, most - 1], reach)

    def at_home(leaf: Leaf, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """What the own leaf has, of leaf 0, and the other leaves to ask."""
        found, bound = answer(leaf, b)
        yield found
        at, p, home = places(b, axes), b.column("p").to_numpy(), b.column("leaf").to_numpy()
        for i, leaves in met(known.value, at, bound):
            apart = leaves != home[i]
            i, leaves = i[apart], leaves[apart]
            yield pa.record_batch([*map(pa.array, (leaves, p[i], bound[i], *at[i].T)), pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.float64())], names=["leaf", "p", "reach", *axes, "other", "d2"])

    first = written(asked(data, spots, axes, "p", at_home, f"leaf long, p long, reach double, {spot}, other long, d2 double"), "nearest")
    visits = first.where("leaf > 0").select("leaf", "p", "reach", *axes)
    more = asked(data, visits, axes, "p", lambda leaf, b: iter([answer(leaf, b)[0].select(["p", "other", "d2"])]), "p long, other long, d2 double")
    found = first.where("leaf = 0").select("p", "other", "d2").unionByName(more)
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy("p").orderBy("d2", "other"))).where(F.col("_n") <= most)
    pairs = asks.join(spots.select("p", *axes), axes).join(ranked, "p")
    pairs = pairs if own else pairs.where(F.col(key) != F.col("other"))
    rank = F.row_number().over(Window.partitionBy(key, "p").orderBy("d2", "other"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(key, F.col("other").alias(f"{other}_r"), "d2", "rank")
