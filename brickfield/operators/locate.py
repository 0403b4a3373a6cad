"""Where requests are served: random, listed and rejected locations, for a whole table of requests at once.

Draws are columns of the request, made from its seed (functions.draws), so any partitioning gives the same locations.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from brickfield.functions.draws import below, chosen, uniform
from brickfield.functions.geometry import Box
from brickfield.functions.scratch import written
from brickfield.operators.graphs import numbered
from brickfield.operators.neighbors import count_within

#: Draws of a request in one round at most.
MOST_DRAWS = 4096


def random_shift(requests: DataFrame, shape: Sequence[int], upstream: Box, grid: Sequence[int], axes: str = "zyx", salt: int | Column = 0) -> DataFrame:
    """requests with b_<axis>: a uniform begin on the grid at which a box of `shape` fits upstream."""
    for k, (a, s, b, n, g) in enumerate(zip(axes, shape, upstream.begin, upstream.shape, grid)):
        first, last = -(-b // g), (b + n - s) // g
        if last < first:
            raise ValueError(f"the requested box does not fit upstream along {a}")
        requests = requests.withColumn(f"b_{a}", (F.lit(first) + below(F.col("seed"), salt + k, last - first + 1)) * g)
    return requests


def integral(voxels: DataFrame, keys: Sequence[str], value: str, axes: str = "zyx") -> DataFrame:
    """Adds `integral`, the sum of value over all voxels up to and with each along every axis."""
    out = voxels.withColumn("integral", F.col(value))
    for a in axes:
        w = Window.partitionBy(*keys, *[o for o in axes if o != a]).orderBy(a).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("integral", F.sum("integral").over(w))
    return out


def box_sums(boxes: DataFrame, integrals: DataFrame, keys: Sequence[str], axes: str = "zyx") -> DataFrame:
    """boxes (id, keys, b_<axis>, e_<axis>) with `total`, from 2**d corners of the integral each."""
    corners = boxes.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << len(axes)) - 1))).alias("_c"))
    sign = F.lit(1)
    for k, a in enumerate(axes):
        low = F.shiftright("_c", k).bitwiseAND(F.lit(1))
        corners = corners.withColumn(a, F.when(low == 1, F.col(f"b_{a}") - 1).otherwise(F.col(f"e_{a}") - 1))
        sign = sign * F.when(low == 1, -1).otherwise(1)
    joined = corners.withColumn("_sign", sign).join(integrals.select(*keys, *axes, "integral"), [*keys, *axes], "left")
    return joined.groupBy("id", *keys).agg(F.sum(F.col("_sign") * F.coalesce("integral", F.lit(0))).alias("total"))


def moving_sums(voxels: DataFrame, keys: Sequence[str], value: str, shape: Sequence[int], axes: str = "zyx") -> DataFrame:
    """keys, b_<axis> and total: the sum of value over the box of `shape` that begins at each voxel, where it fits. One shuffle an axis.

    Volumes are dense: every place along an axis has its voxel.
    """
    out = voxels.select(*keys, *axes, F.col(value).alias("total"))
    for a, s in zip(axes, shape):
        line = Window.partitionBy(*keys, *[o for o in axes if o != a]).orderBy(a)
        out = out.withColumn("_upto", F.sum("total").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.withColumn("total", F.lead("_upto", s - 1).over(line) - F.coalesce(F.lag("_upto", 1).over(line), F.lit(0))).where(F.col("total").isNotNull())
    return out.select(*keys, *[F.col(a).cast("long").alias(f"b_{a}") for a in axes], "total")


def place_sums(integrals: DataFrame, keys: Sequence[str], shape: Sequence[int], axes: str = "zyx") -> DataFrame:
    """As moving_sums(), from an integral."""
    out = integrals.select(*keys, *axes, F.col("integral").alias("total"))
    for a, s in zip(axes, shape):
        line = Window.partitionBy(*keys, *[o for o in axes if o != a]).orderBy(a)
        out = out.withColumn("total", F.lead("total", s - 1).over(line) - F.coalesce(F.lag("total", 1).over(line), F.lit(0))).where(F.col("total").isNotNull())
    return out.select(*keys, *[F.col(a).cast("long").alias(f"b_{a}") for a in axes], "total")


def accepted(candidates: DataFrame, ratio: Column, least: float) -> DataFrame:
    """The first candidate (request, attempt) of each request whose masked ratio is at least `least`."""
    good = candidates.where(ratio >= least)
    w = Window.partitionBy("request").orderBy("attempt")
    return good.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def masked(requests: DataFrame, integrals: DataFrame, keys: Sequence[str], shape: Sequence[int], upstream: Box, least: float, axes: str = "zyx", attempts: int = 4) -> DataFrame:
    """Each of requests (request, seed, keys) with attempt and b_<axis>: a box of `shape` whose masked ratio is at least `least`.

    The first good one of `attempts` draws serves a request; the others draw among all good places of their volume, by
    their numbers, and have `attempts` as attempt. Either way every good place is as likely. Where a volume has none,
    attempt and b_<axis> are null. integrals (keys, axes, integral) are of the mask.
    """
    tries, begins = requests.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))), [f"b_{a}" for a in axes]
    good = place_sums(integrals, keys, shape, axes).where(F.col("total") / float(math.prod(shape)) >= least).select(*keys, *begins)
    for k, (a, s, b, n) in enumerate(zip(axes, shape, upstream.begin, upstream.shape)):
        if s > n:
            raise ValueError(f"the requested box does not fit upstream along {a}")
        # Never null, so that the join needs no filter that would compute the draws a second time.
        tries = tries.withColumn(f"b_{a}", F.lit(b) + F.coalesce(below(F.col("seed"), F.col("attempt") * 10 + k, n - s + 1), F.lit(-1)))
        good = good.where((F.col(f"b_{a}") >= b) & (F.col(f"b_{a}") + s <= b + n))
    good = written(good, "places")
    served = accepted(tries.join(good, [*keys, *begins]), F.lit(1.0), 1.0)
    served = written(served.select("request", F.col("attempt").cast("long").alias("attempt"), *begins), "masked")
    rest = requests.join(served, "request", "left_anti")
    good = good.join(rest.select(*keys).distinct(), list(keys), "left_semi")
    good = numbered(good, *keys, *begins)  # a volume's places follow each other
    spans = good.groupBy(*keys).agg(F.min("number").alias("first"), F.count("*").alias("n"))
    drawn = rest.join(spans, list(keys), "left").withColumn("number", F.col("first") + below(F.col("seed"), attempts * 10, F.col("n")))
    drawn = drawn.join(good.select("number", *begins), "number", "left")
    return served.unionByName(drawn.select("request", F.when(F.col("first").isNotNull(), F.lit(attempts)).cast("long").alias("attempt"), *begins))


def rejected(batches: DataFrame, ratio: Column, least: float, probability: float = 1.0, seed: Column | None = None) -> DataFrame:
    """batches whose masked ratio exceeds `least`; others stay if their draw exceeds probability."""
    keep = ratio > least
    if probability < 1.0:
        keep = keep | (uniform(seed, 91) > probability)
    return batches.where(keep)


def point_weights(points: DataFrame, axes: Sequence[str], radius: float) -> DataFrame:
    """id and weight, one over the number of points within radius, itself included."""
    return count_within(points, axes, radius).select("id", (F.lit(1.0) / F.col("n")).alias("weight"))


def weighted_choice(requests: DataFrame, weights: DataFrame, resolution: int | None = None) -> DataFrame:
    """request and id: a point drawn by its weight.

    Points lie end to end in order of their ids, each as long as its weight, and a draw finds the point under it by an
    equi-join on buckets of the mean weight: as many buckets as points, so twice as many rows at most. With resolution,
    weights are whole shares of it, of one at least.
    """
    kind = "double" if resolution is None else "long"
    share = F.col("weight") if resolution is None else F.greatest(F.lit(1), F.rint(F.col("weight") * resolution).cast("long"))
    order = numbered(weights.withColumn("share", share.cast(kind)).where("share > 0"), "id")
    per = 1024
    block = F.floor(F.col("number") / per).alias("block")
    blocks = order.groupBy(block).agg(F.sum("share").alias("in_block"), F.count("*").alias("n"))
    upto = blocks.withColumn("upto", F.sum("in_block").over(Window.orderBy("block")))  # a row for each 1024 points
    inside = Window.partitionBy("block").orderBy("number")
    placed = order.withColumn("block", block).join(upto.drop("n"), "block")
    placed = placed.withColumn("start", F.col("upto") - F.col("in_block") + F.sum("share").over(inside) - F.col("share"))
    # A point ends where the next begins, so that rounded sums leave no gap between them.
    ends = placed.select("number", "start").select((F.col("number") - 1).alias("number"), F.col("start").alias("end"))
    total = F.broadcast(blocks.agg(F.sum("in_block").alias("total"), F.sum("n").alias("n")))  # one row
    placed = placed.join(ends, "number", "left").crossJoin(total).withColumn("end", F.coalesce("end", "total"))
    bucket = F.col("total") / F.col("n")
    spread = placed.select("id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("k"))
    at = uniform(F.col("seed"), 17) * F.col("total") if resolution is None else below(F.col("seed"), 17, F.col("total"))
    drawn = requests.crossJoin(total).withColumn("at", at).withColumn("k", F.floor(F.col("at") / bucket))
    return drawn.join(spread, "k").where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))).select("request", "id")


def shift_until(requests: DataFrame, shape: Sequence[int], upstream: Box, grid: Sequence[int], accepts: Column | Callable[[DataFrame], DataFrame], axes: str = "zyx", rounds: int | None = None, seconds: float = 3600, known: tuple[DataFrame, Sequence[str]] | None = None) -> DataFrame:
    """requests (request, seed) with attempt and b_<axis>: the first of a request's draws for which accepts holds.

    accepts is a condition on the drawn rows, or a function that gives those of them that are good, by what it reads there.
    A condition may also read what is `known`, a table with a row for each value of its keys, which the requests have too: it
    is joined to a request before it draws, so that no draw is shuffled.
    What a round leaves over is drawn again, twice as often in each round up to MOST_DRAWS, however many rounds that takes: a
    condition that few places meet is met at last. One that none meets can't be told from it, so that a caller's limit of
    time, or of draws a request, ends the search with an error; no request is left out.
    """
    begins, found, left, start, size = [f"b_{a}" for a in axes], None, requests, 0, 1
    until = time.monotonic() + seconds
    while (rounds is None or start < rounds) and time.monotonic() < until:
        end = min(start + size, start + MOST_DRAWS, rounds or start + size)
        asked = left if known is None else left.join(known[0], list(known[1]), "left")
        tries = asked.withColumn("attempt", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end - 1).cast("long"))))
        drawn = random_shift(tries, shape, upstream, grid, axes, F.col("attempt") * 10)
        if isinstance(accepts, Column):
            # A request's draws are in one task, which keeps the first good one before anything is shuffled.
            draw = F.struct("attempt", *begins)
            served = drawn.groupBy(*requests.columns).agg(F.min(F.when(accepts, draw)).alias("_draw"))
            served = written(served, "drawn")
            good = served.where("_draw IS NOT NULL").select(*requests.columns, "_draw.attempt", *[f"_draw.{b}" for b in begins])
            found = good if found is None else found.unionByName(good)
            left = served.where("_draw IS NULL").select(*requests.columns)
            if left.isEmpty():
                return found
            start, size = end, 2 * size
            continue
        good = accepts(drawn)
        first = Window.partitionBy("request").orderBy("attempt")
        good = written(good.select(*requests.columns, "attempt", *begins).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"), "drawn")
        found = good if found is None else found.unionByName(good)
        left = written(left.join(good.select("request"), "request", "left_anti").select(*requests.columns), "drawn-left")
        if left.isEmpty():
            return found
        start, size = end, 2 * size
    raise ValueError(f"no accepted location in {start} draws of some requests")


def around_points(requests: DataFrame, weights: DataFrame, points: DataFrame, shape: Sequence[int], upstream: Box, axes: str = "zyx", centered: bool = False, p: float = 1.0) -> DataFrame:
    """requests (request, seed) with the id of a point drawn by weight (id, weight) and b_<axis>: a box of `shape` that holds it.

    With p below 1, the draw of the other requests takes any box upstream; their id is null.

    Of all boxes upstream that hold the point one is drawn, or, if centered, that with the point in the middle is taken.
    Points that no such box holds don't take part; if none is left, that is an error.
    """
    rows = weights.join(points.select("id", *axes), "id")
    for a, s, b, n in zip(axes, shape, upstream.begin, upstream.shape):
        at = F.floor(a).cast("long")
        first, last = (at - s // 2, at - s // 2) if centered else (at - s + 1, at)
        rows = rows.withColumn(f"first_{a}", F.greatest(first, F.lit(b))).withColumn(f"last_{a}", F.least(last, F.lit(b + n - s)))
        rows = rows.where(F.col(f"first_{a}") <= F.col(f"last_{a}"))
    rows = written(rows, "reachable")
    if rows.isEmpty():
        raise ValueError("no point lies in a box that fits upstream")
    anywhere = requests.where(uniform(F.col("seed"), 37) >= p)
    requests = requests.where(uniform(F.col("seed"), 37) < p)
    drawn = weighted_choice(requests, rows.select("id", "weight")).join(requests.select("request", "seed"), "request").join(rows.drop("weight", *axes), "id")
    for k, a in enumerate(axes):
        drawn = drawn.withColumn(f"b_{a}", F.col(f"first_{a}") + below(F.col("seed"), 31 + k, F.col(f"last_{a}") - F.col(f"first_{a}") + 1))
    drawn = drawn.select("request", "id", *[f"b_{a}" for a in axes])
    if p >= 1:
        return drawn
    free = random_shift(anywhere, shape, upstream, [1] * len(axes), axes, 51)
    return drawn.unionByName(free.select("request", F.lit(None).cast(drawn.schema["id"].dataType).alias("id"), *[f"b_{a}" for a in axes]))


def specified(requests: DataFrame, locations: DataFrame, shape: Sequence[int], upstream: Box, grid: Sequence[int], axes: str = "zyx", at_random: bool = False, jitter: Sequence[int] | None = None) -> DataFrame:
    """requests (request, seed, turn) with the location that serves each and b_<axis>, and any other columns of locations.

    A box of `shape` is centred on its location and its begin rounded, half to even, to the grid. Locations whose box
    doesn't fit upstream are left out; the others are taken in turn, or drawn. With jitter, boxes move by up to so much
    along each axis, as far as they stay upstream.
    """
    for a, s, g in zip(axes, shape, grid):
        locations = locations.withColumn(f"b_{a}", (F.rint((F.col(a) - s // 2) / g) * g).cast("long"))
    for a, s, b, n in zip(axes, shape, upstream.begin, upstream.shape):
        locations = locations.where((F.col(f"b_{a}") >= b) & (F.col(f"b_{a}") + s <= b + n))
    fits = numbered(locations, "location")
    n = fits.count()
    if not n:
        raise ValueError("no location fits upstream")
    turn = below(F.col("seed"), 23, n) if at_random else F.pmod(F.col("turn"), F.lit(n))
    served = requests.withColumn("number", turn).join(fits.drop(*axes), "number").drop("number")
    for k, (a, j, g, b, m, s) in enumerate(zip(axes, jitter or (), grid, upstream.begin, upstream.shape, shape)):
        moved = F.rint((F.col(f"b_{a}") + below(F.col("seed"), 41 + k, 2 * j + 1) - j) / g) * g
        served = served.withColumn(f"b_{a}", F.greatest(F.lit(-(-b // g) * g), F.least(F.lit((b + m - s) // g * g), moved)).cast("long"))
    return served


def choose_provider(seed: Column, probabilities: Sequence[float]) -> Column:
    """The number of the provider that serves a request, by its draw."""
    return chosen(seed, 5, probabilities)


def repetitions(requests: DataFrame, n: int) -> DataFrame:
    """Each request n times, with its repetition `c` and a seed of its own."""
    rows = requests.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("seed", below(F.col("seed"), F.col("c") + 101, 1 << 30))
