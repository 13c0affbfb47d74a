"""Scalar functions: rounding towards zero, remainders, integers, stamps, conditions of 3 x 3 matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import vector as V


def fix(x: Column) -> Column:
    """Towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def rem(x: Column, y: Column) -> Column:
    """x - fix(x / y) y: the sign is that of x; null for y = 0."""
    return F.when(y != 0, x - fix(x / y) * y)


def mod(x: Column, y: Column) -> Column:
    """x - floor(x / y) y: the sign is that of y; x for y = 0."""
    return F.when(y != 0, x - F.floor(x / y) * y).otherwise(x)


def gcd(x: Column, y: Column) -> Column:
    """Greatest common divisor of two long integers: Euclid's steps, of which 64-bit numbers take 92 at most."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    start = F.struct(F.abs(x.cast("long")).alias("a"), F.abs(y.cast("long")).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def factorial(n: Column) -> Column:
    """n! as a long for 0 to 20, else null."""
    return F.factorial(n.cast("int"))


def stamp(ts: Column) -> Column:
    """A time as yyyymmddThhmmss, for file names."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmss")


def inverse3(m: list[V.Vec]) -> list[V.Vec]:
    """The inverse of a 3 x 3 matrix by rows; null if it is singular."""
    one = [[F.lit(float(i == j)) for j in range(3)] for i in range(3)]
    return V.right_divide(one, m)
