"""Reproducible draws: integer arithmetic on a seed and a salt, the same in any engine and under any partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed values of a linear congruential generator modulo 2**31.
FACTOR, STEP, MODULUS = 1103515245, 12345, 1 << 31
#: Rounds; each folds the high bits, which a generator of this kind mixes well, into the low ones. Without that, draws of
#: neighbouring salts would differ by a constant.
ROUNDS = 2


def mixed(seed: Column, salt: Column | int) -> Column:
    """A whole number in [0, 2**31)."""
    salt = salt if isinstance(salt, Column) else F.lit(salt)
    x = F.pmod(F.pmod(seed.cast("long"), F.lit(MODULUS)) * 48271 + salt.cast("long") * 69621 + 7, F.lit(MODULUS))
    for _ in range(ROUNDS):
        x = F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) * FACTOR + STEP, F.lit(MODULUS))
    return x.bitwiseXOR(F.shiftright(x, 15))


def uniform(seed: Column, salt: Column | int) -> Column:
    """A double in [0, 1)."""
    return mixed(seed, salt) / F.lit(float(MODULUS))


def below(seed: Column, salt: Column | int, n: Column | int) -> Column:
    """A whole number in [0, n)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.floor(uniform(seed, salt) * n).cast("long")


def normal(seed: Column, salt: int) -> Column:
    """A standard normal number, from the draws of salt and salt + 1."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, salt))) * F.cos(F.lit(2 * math.pi) * uniform(seed, salt + 1))


def chosen(seed: Column, salt: int, weights: Sequence[float]) -> Column:
    """A whole number below len(weights), drawn by weight."""
    u, total, at, out = uniform(seed, salt), sum(weights), 0.0, F.lit(len(weights) - 1)
    ends = []
    for w in weights[:-1]:
        at += w / total
        ends.append(at)
    for i in reversed(range(len(ends))):
        out = F.when(u < ends[i], i).otherwise(out)
    return out


def mixed_sql(seed: str, salt: str | int) -> str:
    """The same as mixed(), as SQL over numbers that are not negative."""
    x = f"((({seed})::BIGINT % {MODULUS} * 48271 + ({salt})::BIGINT * 69621 + 7) % {MODULUS})"
    for _ in range(ROUNDS):
        x = f"((xor({x}, {x} >> 15) * {FACTOR} + {STEP}) % {MODULUS})"
    return f"xor({x}, {x} >> 15)"


def uniform_sql(seed: str, salt: str | int) -> str:
    return f"({mixed_sql(seed, salt)} / {MODULUS}.0::DOUBLE)"


def normal_sql(seed: str, salt: int) -> str:
    return f"(sqrt(-2 * ln(1 - {uniform_sql(seed, salt)})) * cos({2 * math.pi!r}::DOUBLE * {uniform_sql(seed, salt + 1)}))"
