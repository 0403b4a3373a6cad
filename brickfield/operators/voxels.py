"""Operators on voxel rows: batch_id, z, y, x (voxel indices) and value. All are projections or filters, but where a
slab's mean or a section's range is joined."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from brickfield.functions.cells import AXES
from brickfield.functions.draws import below, chosen, normal, uniform
from brickfield.functions.geometry import Box

#: Bits and sign of the whole-number kinds.
KINDS = {"uint8": (8, False), "uint16": (16, False), "uint32": (32, False), "int8": (8, True), "int16": (16, True), "int32": (32, True), "int64": (63, True)}
#: Mean of a Poisson draw from which a normal one stands for it.
LARGE_MEAN = 500.0


def crop(voxels: DataFrame, box: Box) -> DataFrame:
    """The voxels inside box."""
    return voxels.where(box.holds(*map(F.col, AXES)))


def crop_fraction(box: Box, before: Sequence[float], after: Sequence[float]) -> Box:
    """box without the given shares at its two ends."""
    if any(a + b >= 1 for a, b in zip(before, after)):
        raise ValueError("nothing would be left")
    low = [int(s * f) for s, f in zip(box.shape, before)]
    high = [int(s * f) for s, f in zip(box.shape, after)]
    return box.grow([-n for n in low], [-n for n in high])


def as_type(value: Column, kind: str) -> Column:
    """Cast with the wraparound of fixed-width numbers; floating kinds are doubles."""
    if kind not in KINDS:
        return value.cast("double")
    bits, signed = KINDS[kind]
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("long")
    if bits == 63:
        return whole
    offset = 1 << (bits - 1) if signed else 0
    return F.pmod(whole + offset, F.lit(1 << bits)) - offset


def normalize(value: Column, kind: str, factor: float | None = None) -> Column:
    """value times factor, by default what maps the kind's range to [0, 1]."""
    known = {"uint8": 1 / 255, "uint16": 1 / 65535, "float32": 1.0}
    if factor is None and kind not in known:
        raise ValueError(f"no factor for {kind}")
    return value.cast("double") * F.lit(known[kind] if factor is None else factor)


def scale_shift(value: Column, scale: float, shift: float) -> Column:
    return value * F.lit(scale) + F.lit(shift)


def downsample(voxels: DataFrame, factor: Sequence[int], begin: Sequence[int] = (0, 0, 0)) -> DataFrame:
    """Every factor-th voxel from begin on; indices count in the new voxels."""
    for axis, f, b in zip(AXES, factor, begin):
        c = F.col(axis) - b
        voxels = voxels.where(F.pmod(c, F.lit(f)) == 0).withColumn(axis, F.floor(c / f).cast("int"))
    return voxels


def upsample(voxels: DataFrame, factor: Sequence[int]) -> DataFrame:
    """Each voxel factor times along each axis."""
    for axis, f in zip(AXES, factor):
        if f > 1:
            voxels = voxels.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(f - 1)))).withColumn(axis, F.col(axis) * f + F.col("_d")).drop("_d")
    return voxels


def mirror(voxels: DataFrame, box: Box, axes: Sequence[str]) -> DataFrame:
    """Reflects along the named axes of box."""
    for axis, b, e in zip(AXES, box.begin, box.end):
        if axis in axes:
            voxels = voxels.withColumn(axis, F.lit(b + e - 1) - F.col(axis))
    return voxels


def transpose(voxels: DataFrame, order: Sequence[int]) -> DataFrame:
    """Axis number i takes the coordinates of axis order[i]."""
    taken = [F.col(AXES[o]).alias(a) for a, o in zip(AXES, order)]
    return voxels.select(*[c for c in voxels.columns if c not in AXES], *taken)


def slab_key(slab: Sequence[int]) -> list[Column]:
    """Numbers of the slab along each axis; -1 spans the axis."""
    return [F.floor(F.col(a) / s) if s > 0 else F.lit(0) for a, s in zip(AXES, slab)]


def with_slab(voxels: DataFrame, slab: Sequence[int], **aggregates: Column) -> DataFrame:
    """voxels with aggregates over each batch's slab.

    They are summed up where the voxels lie and joined back, one row a slab, so no slab meets in one task; the joined side
    is small enough to be broadcast unless volumes have very many slabs.
    """
    keys = {f"_s{i}": k for i, k in enumerate(slab_key(slab))}
    rows = voxels.withColumns(keys)
    per = rows.groupBy("batch_id", *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return rows.join(per, ["batch_id", *keys]).drop(*keys)


def scale_contrast(value: Column, mean: Column, scale: Column, shift: Column, clip: bool = True) -> Column:
    """mean + (value - mean) * scale + shift, kept in [0, 1] if clip."""
    moved = mean + (value - mean) * scale + shift
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)) if clip else moved


def zero_const_sections(voxels: DataFrame, value: str = "value") -> DataFrame:
    """Sections along z that hold one value become 0."""
    kind = voxels.schema[value].dataType
    rows = with_slab(voxels, (1, -1, -1), _low=F.min(value), _high=F.max(value))
    return rows.withColumn(value, F.when(F.col("_low") == F.col("_high"), F.lit(0).cast(kind)).otherwise(F.col(value))).drop("_low", "_high")


def shift_sections(voxels: DataFrame, moves: DataFrame, box: Box) -> DataFrame:
    """Moves each section by the running sum of moves (batch_id, z, dy, dx); what leaves box is dropped.

    Draws are one row a section, so their join is on (batch_id, z).
    """
    walk = Window.partitionBy("batch_id").orderBy("z").rowsBetween(Window.unboundedPreceding, 0)
    moves = moves.select("batch_id", "z", F.sum("dy").over(walk).alias("dy"), F.sum("dx").over(walk).alias("dx"))
    moved = voxels.join(moves, ["batch_id", "z"]).withColumn("y", F.col("y") + F.col("dy")).withColumn("x", F.col("x") + F.col("dx"))
    return crop(moved.drop("dy", "dx"), box)


def damage_sections(voxels: DataFrame, draw: Column, *, missing: float, low_contrast: float, contrast_scale: float) -> DataFrame:
    """Each section by its draw in [0, 1): missing (0), of low contrast around its mean, or as it is."""
    rows = with_slab(voxels, (1, -1, -1), _mean=F.avg("value")).withColumn("_u", draw)
    flat = (F.col("value") - F.col("_mean")) * contrast_scale + F.col("_mean")
    value = F.when(F.col("_u") < missing, 0.0).when(F.col("_u") < missing + low_contrast, flat).otherwise(F.col("value"))
    return rows.withColumn("value", value).drop("_u", "_mean")


def fold_sections(voxels: DataFrame, seed: Column, fold: Column, strength: int, begin: Sequence[int], shape: Sequence[int], width: int = 10) -> DataFrame:
    """Sections that are folded (fold, a condition of batch_id and z) along a line through them; z and the others as they are, cut to the box of y and x.

    The line runs from a drawn place of one side of the section, grown by strength, to one of the opposite side. On both
    sides of it each place shows, linearly interpolated, what lies strength farther from the line, so that a strip is folded
    away; places within width and a half of the line, along the shorter axis of its slope, are 0. voxels reach strength + 1
    past the box where they are to be seen there; what isn't there counts as 0. Only folded sections are shuffled.
    """
    (ny, nx), (oy, ox) = shape, begin
    drawn = voxels.withColumns({"_fold": fold, "_across": uniform(seed, 81) < 0.5, "_p": below(seed, 82, 1 << 20), "_q": below(seed, 83, 1 << 20)})
    grown = F.when(F.col("_across"), nx + 2 * strength).otherwise(ny + 2 * strength) - 3  # places that a line may begin at
    along = F.when(F.col("_across"), ny + 2 * strength - 1).otherwise(nx + 2 * strength - 1).cast("double")
    # In the grown section, where a is the axis that the line runs along and b the other: from (0, first) to (along, last).
    rows = drawn.withColumns({"_first": 1 + F.col("_p") % grown, "_last": 1 + F.col("_q") % grown, "_along": along})
    slope = (F.col("_last") - F.col("_first")) / F.col("_along")
    length = F.sqrt(1 + slope * slope)
    step = lambda n: F.when(F.col("_across"), F.lit(float(strength)) * (1 if n else -slope) / length).otherwise(F.lit(float(strength)) * (-slope if n else 1) / length)
    rows = rows.withColumns({"_sy": step(0), "_sx": step(1), "_slope": slope})
    keep = [c for c in voxels.columns if c != "value"]
    box = (F.col("y") >= oy) & (F.col("y") < oy + ny) & (F.col("x") >= ox) & (F.col("x") < ox + nx)

    def above(y: Column, x: Column) -> Column:
        """How far a place lies past the line, along the other axis."""
        gy, gx = y - oy + strength, x - ox + strength
        return F.when(F.col("_across"), gx - F.col("_first") - gy * F.col("_slope")).otherwise(gy - F.col("_first") - gx * F.col("_slope"))

    folded = rows.where("_fold")
    # A voxel weighs in on up to four places of each side.
    targets = []
    for side in (1, -1):
        for dy in (0, 1):
            for dx in (0, 1):
                sy, sx = F.col("_sy") * side, F.col("_sx") * side
                wy, wx = sy - F.floor(sy), sx - F.floor(sx)
                weight = (wy if dy else 1 - wy) * (wx if dx else 1 - wx)
                targets.append(F.struct((F.col("y") - F.floor(sy) - dy).alias("y"), (F.col("x") - F.floor(sx) - dx).alias("x"), weight.alias("w"), F.lit(side).alias("side")))
    spread = folded.select(*[c for c in keep if c not in ("y", "x")], "value", "_across", "_first", "_slope", F.explode(F.array(*targets)).alias("_t")).select("*", "_t.y", "_t.x")
    past = above(F.col("y"), F.col("x"))
    spread = spread.where(box & (F.col("_t.w") > 0) & ((past > 0) == (F.col("_t.side") > 0)))
    black = F.abs(past) <= F.greatest(F.lit(1.0), F.abs("_slope")) * (width + 0.5)
    part = F.when(black, 0.0).otherwise(F.col("_t.w") * F.col("value"))
    there = folded.where(box).select(*keep, F.lit(0.0).alias("value"), F.lit(True).alias("_there"))
    sums = spread.select(*keep, part.alias("value"), F.lit(False).alias("_there")).unionByName(there).groupBy(*keep).agg(F.sum("value").alias("value"), F.max("_there").alias("_there"))
    made = sums.where("_there")
    return rows.where("NOT _fold").where(box).select(*voxels.columns).unionByName(made.select(*voxels.columns))


def blend(voxels: DataFrame, artifacts: DataFrame) -> DataFrame:
    """value * (1 - alpha) + artifact * alpha where artifacts (z, y, x, artifact, alpha, batch_id) covers a voxel."""
    joined = voxels.join(artifacts, ["batch_id", *AXES], "left")
    a = F.coalesce("alpha", F.lit(0.0))
    return joined.withColumn("value", F.col("value") * (1 - a) + F.coalesce("artifact", F.lit(0.0)) * a).drop("alpha", "artifact")


def replace_labels(labels: Column, table: dict[int, int]) -> Column:
    """labels by a small table; others stay."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, labels), labels) if table else labels


def add_noise(voxels: DataFrame, seed: Column, mode: str = "gaussian", amount: float = 0.1, clip: bool = True) -> DataFrame:
    """Gaussian, speckle or salt-and-pepper noise; a voxel's draws depend on seed, its batch and its place alone."""
    place = seed * 31 + F.col("batch_id") * 4099 + (F.col("z") * 1009 + F.col("y")) * 1013 + F.col("x")
    value = F.col("value")
    if mode == "gaussian":
        noisy = value + normal(place, 1) * amount
    elif mode == "speckle":
        noisy = value + value * normal(place, 1) * amount
    elif mode == "s&p":
        noisy = F.when(uniform(place, 1) < amount, F.when(uniform(place, 2) < 0.5, 0.0).otherwise(1.0)).otherwise(value)
    else:
        raise ValueError(f"unknown noise {mode}")
    return voxels.withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), noisy)) if clip else noisy)


def poisson_noise(voxels: DataFrame, seed: Column) -> DataFrame:
    """Each value as the mean of a Poisson draw: value * n drawn and divided by n, the least power of two that isn't below the batch's number of values.

    A draw is the inverse of the distribution at a uniform number, that of means over LARGE_MEAN the nearest whole number
    to a normal one.
    """
    place = seed * 31 + F.col("batch_id") * 4099 + (F.col("z") * 1009 + F.col("y")) * 1013 + F.col("x")

    def draw(mean: pa.Array, u: pa.Array, z: pa.Array) -> pa.Array:
        lam, u, z = (c.to_numpy(zero_copy_only=False) for c in (mean, u, z))
        out = np.rint(np.maximum(lam + np.sqrt(np.maximum(lam, 0)) * z, 0))
        at = np.flatnonzero(lam <= LARGE_MEAN)
        k, part = 0, np.exp(-np.maximum(lam[at], 0))
        upto = part.copy()
        while len(at):
            done = u[at] < upto
            out[at[done]] = k
            k, at = k + 1, at[~done]
            part = part[~done] * np.maximum(lam[at], 0) / k
            # Past the last digit of a double nothing is added; such a draw ends here.
            ends = (part == 0) & (k > lam[at])
            out[at[ends]] = k
            upto, at, part = (upto[~done] + part)[~ends], at[~ends], part[~ends]
        return pa.array(out)

    kinds = voxels.groupBy("batch_id").agg(F.count_distinct("value").alias("_n"))
    rows = voxels.join(kinds, "batch_id").withColumn("_n", F.pow(F.lit(2.0), F.ceil(F.log2("_n"))))
    drawn = F.arrow_udf(draw, "double")(F.col("value") * F.col("_n"), uniform(place, 1), normal(place, 2))
    return rows.withColumn("value", drawn / F.col("_n")).drop("_n")


def sometimes(voxels: DataFrame, seed: Column, salt: int, p: float, value: Column) -> DataFrame:
    """value in the batches that their draw picks, with probability p; the others stay as they are."""
    return voxels.withColumn("value", F.when(uniform(seed, salt) < p, value).otherwise(F.col("value")))


def simple_augment(rows: DataFrame, seed: Column, box: Box, *, mirror: Sequence[float] = (0.5, 0.5, 0.5), orders: dict[tuple[int, ...], float] | None = None, points: bool = False) -> DataFrame:
    """rows (z, y, x) of each request mirrored along the axes, and with the axes in the order, that the request's seed draws.

    mirror has a probability for each axis; orders maps orders of axes, all equally likely by default, to weights. Voxels
    are reflected as cells, points as places, those on the far side then lying outside box and being left out. Axes are
    exchanged around the centre of box, so voxels need it to be as long along axes that may change places.
    """
    orders = orders or {o: 1.0 for o in itertools.permutations(range(len(AXES)))}
    if not points and any(box.shape[o] != box.shape[i] for order in orders for i, o in enumerate(order)):
        raise ValueError("axes of different lengths can't change places")
    reflected = []
    for k, (a, b, e, p) in enumerate(zip(AXES, box.begin, box.end, mirror)):
        c = F.col(a)
        reflected.append(F.when(uniform(seed, 61 + k) < p, F.lit(b + e - (0 if points else 1)) - c).otherwise(c) if p else c)
    order = chosen(seed, 67, list(orders.values()))
    middle = box.center
    taken = [F.lit(None)] * len(AXES)
    for i in range(len(AXES)):
        cases = F.array(*[reflected[o[i]] + F.lit(middle[i] - middle[o[i]]) for o in orders])
        taken[i] = F.get(cases, order)
    moved = rows.withColumns(dict(zip(AXES, taken)))
    return moved.where(box.holds(*map(F.col, AXES))) if points else moved


def section_moves(sections: DataFrame, seed: Column, slip: float, shift: float, sigma: Sequence[float]) -> DataFrame:
    """batch_id, z, dy and dx, how far each section lies from its place: sections has batch_id and z.

    A section's draw makes it slip, alone, or shift together with all after it; either by a normal step of deviation sigma.
    """
    if slip + shift > 1:
        raise ValueError("a section either slips or shifts")
    place = seed * 8191 + F.col("z")
    u = uniform(place, 71)
    rows = sections.withColumn("_u", u).withColumns({f"_{a}": F.rint(normal(place, 72 + 2 * k) * s).cast("long") for k, (a, s) in enumerate(zip("yx", sigma))})
    upto = Window.partitionBy("batch_id").orderBy("z").rowsBetween(Window.unboundedPreceding, 0)
    moves = []
    for a in "yx":
        base = F.sum(F.when((F.col("_u") >= slip) & (F.col("_u") < slip + shift), F.col(f"_{a}")).otherwise(0)).over(upto)
        moves.append((base + F.when(F.col("_u") < slip, F.col(f"_{a}")).otherwise(0)).alias(f"d{a}"))
    return rows.select("batch_id", "z", *moves)


def move_sections(rows: DataFrame, moves: DataFrame, box: Box) -> DataFrame:
    """Voxels, or points whose z lies in a section, moved as section_moves() says; what leaves box is dropped."""
    at = moves.withColumnRenamed("z", "_z")
    moved = rows.withColumn("_z", F.floor("z").cast("long")).join(at, ["batch_id", "_z"]).withColumn("y", F.col("y") + F.col("dy")).withColumn("x", F.col("x") + F.col("dx"))
    return crop(moved.drop("dy", "dx", "_z"), box)
