"""N-dimensional sparse arrays as coordinate tables (i1, ..., iN, val): absent cells are zero, indices start at 1."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def axes(a: DataFrame) -> list[str]:
    return [c for c in a.columns if c != "val"]


def build(rows: DataFrame, how: Callable[[str], Column] = F.sum) -> DataFrame:
    """One cell a coordinate; repeated coordinates are combined."""
    return rows.groupBy(*axes(rows)).agg(how("val").alias("val")).filter("val <> 0")


def random(spark: SparkSession, shape: dict[str, int], density: float, seed: int = 1, m: int = 104_729) -> DataFrame:
    """Cells kept and valued by a fixed rule of their place and the seed: the same on every run and for every partitioning."""
    place = F.col("id") + seed
    keep = place * 7919 % m < int(density * m)
    total = 1
    for n in shape.values():
        total *= n
    flat = spark.range(total).filter(keep).select("id", ((place * 31_337 % m + 1) / F.lit(float(m))).alias("val"))
    return unflat(flat, "id", shape)


def unflat(rows: DataFrame, at: str, shape: dict[str, int]) -> DataFrame:
    """Column-major places from 0 as coordinates."""
    out, left = [], F.col(at)
    for c, n in shape.items():
        out.append((left % n + 1).alias(c))
        left = F.floor(left / n)
    return rows.select(*out, "val")


# inspection


def flat(shape: dict[str, int]) -> Column:
    """A cell's column-major place, from 1."""
    out, step = F.lit(1).cast("long"), 1
    for c, n in shape.items():
        out = out + (F.col(c) - 1) * step
        step *= n
    return out


def find(a: DataFrame, shape: dict[str, int]) -> DataFrame:
    """place (column-major, from 1) and val of every cell that is not zero."""
    return a.filter("val <> 0").select(flat(shape).alias("place"), "val")


def inspect(a: DataFrame) -> DataFrame:
    """One row: nnz, and the largest index of each axis."""
    return a.filter("val <> 0").agg(F.count("*").alias("nnz"), *(F.max(c).alias(f"max_{c}") for c in axes(a)))


def apply(a: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """f of each cell that is not zero (abs, sqrt, a power, ...); f(0) is taken for 0."""
    return a.filter("val <> 0").withColumn("val", f(F.col("val"))).filter("val <> 0")


def _places(a: DataFrame, where: dict[str, list[int]]) -> DataFrame:
    """a with the new index of each axis that is listed: a row for every time that a cell's index is named."""
    for c, wanted in where.items():
        at: dict[int, list[int]] = {}
        for k, i in enumerate(wanted):
            at.setdefault(i, []).append(k + 1)
        named = a.sparkSession.createDataFrame(list(at.items()) or [(0, [0])], f"`{c}` long, _at array<long>")
        a = a.join(named, c).withColumn(c, F.explode("_at")).drop("_at")
    return a


def index(a: DataFrame, where: dict[str, list[int]]) -> DataFrame:
    """a(where): the listed indices of each axis in their order, repeated ones again; axes that are not listed whole."""
    return _places(a, where).select(*axes(a), "val")


def assign(a: DataFrame, where: dict[str, list[int]], b: DataFrame | None = None) -> DataFrame:
    """a(where) = b: the cells of the listed indices are replaced by b's, or by zero without b."""
    inside = F.lit(True)
    for c, wanted in where.items():
        inside = inside & F.col(c).isin(wanted)
    out = a.filter(~inside)
    if b is None:
        return out
    for c, wanted in where.items():
        b = b.withColumn(c, F.get(F.array(*map(F.lit, wanted)), (F.col(c) - 1).cast("int")).cast("long"))
    return out.unionByName(b.select(*a.columns).filter("val <> 0"))


def reduce(a: DataFrame, along: str, size: int, how: str) -> DataFrame:
    """sum, mean, any, all, max or min along an axis of the given size; zeros that are not stored count."""
    keep = [c for c in axes(a) if c != along]
    n = F.count("*")
    low, high = F.min("val"), F.max("val")
    agg = {"sum": F.sum("val"), "mean": F.sum("val") / size, "any": F.max((F.col("val") != 0).cast("int")).cast("double"), "all": F.when(n < size, 0.0).otherwise(F.min((F.col("val") != 0).cast("int")).cast("double")), "max": F.when(n < size, F.greatest(high, F.lit(0.0))).otherwise(high), "min": F.when(n < size, F.least(low, F.lit(0.0))).otherwise(low)}[how]
    return a.groupBy(*keep).agg(agg.alias("val"))


def elementwise(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """f of two arrays of one shape, f(0, 0) = 0."""
    k = axes(a)
    j = a.withColumnRenamed("val", "_a").join(b.withColumnRenamed("val", "_b"), k, "full")
    return j.select(*k, f(F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))).alias("val")).filter("val <> 0")


def compare(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column], shape: dict[str, int] | None = None) -> DataFrame:
    """1 where f holds. A relation that holds of two zeros (=, <=, >=, not or) needs the shape: absent cells count then."""
    one = lambda x, y: F.when(f(x, y), 1.0).otherwise(0.0)
    if shape is None:
        return elementwise(a, b, one)
    d = dense(a, shape).withColumnRenamed("val", "_a").join(b.withColumnRenamed("val", "_b"), axes(a), "left")
    return d.select(*axes(a), one(F.col("_a"), F.coalesce("_b", F.lit(0.0))).alias("val")).filter("val <> 0")


def matrix_power(a: DataFrame, n: int) -> DataFrame:
    """a (axes row, column) times itself, n > 0 times in all, by squaring."""
    row, col = axes(a)
    if n < 1:
        raise ValueError("the power is a positive integer")
    times = lambda x, y: multiply(x.select(F.col(row), F.col(col).alias("_k"), "val"), y.select(F.col(row).alias("_k"), F.col(col), "val"), "_k")
    out = None
    while n:
        if n % 2:
            out = a if out is None else times(out, a)
        n //= 2
        a = times(a, a) if n else a
    return out


def rotate90(a: DataFrame, row: str, col: str, columns: int) -> DataFrame:
    """A quarter turn to the left in the plane of two axes."""
    return a.select(*((F.lit(columns + 1) - F.col(col)).alias(c) if c == row else F.col(row).alias(c) if c == col else F.col(c) for c in axes(a)), "val")


def squeeze(a: DataFrame, shape: dict[str, int]) -> DataFrame:
    """Without the axes of size one."""
    return a.select(*(c for c in axes(a) if shape[c] != 1), "val")


def multiply(a: DataFrame, b: DataFrame, inner: str) -> DataFrame:
    """Product over the shared axis; the others are kept."""
    rest = [*(c for c in axes(a) if c != inner), *(c for c in axes(b) if c != inner)]
    j = a.withColumnRenamed("val", "_a").join(b.withColumnRenamed("val", "_b"), inner)
    return j.groupBy(*rest).agg(F.sum(F.col("_a") * F.col("_b")).alias("val")).filter("val <> 0")


def spread(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """f of each stored cell of a with the cell of b on their shared axes (0 where b has none)."""
    shared = [c for c in axes(b) if c in axes(a)]
    j = a.withColumnRenamed("val", "_a").join(b.withColumnRenamed("val", "_b"), shared, "left")
    return j.select(*axes(a), f(F.col("_a"), F.coalesce("_b", F.lit(0.0))).alias("val")).filter("val <> 0")


def permute(a: DataFrame, order: list[str]) -> DataFrame:
    k = axes(a)
    return a.select(*(F.col(o).alias(n) for o, n in zip(order, k, strict=True)), "val")


def reshape(a: DataFrame, shape: dict[str, int], new: dict[str, int]) -> DataFrame:
    """Column-major: the first axis runs fastest."""
    return unflat(a.select((flat(shape) - 1).alias("_f"), "val"), "_f", new)


def shift(a: DataFrame, axis: str, size: int, by: int) -> DataFrame:
    return a.withColumn(axis, F.pmod(F.col(axis) - 1 + by, F.lit(size)) + 1)


def flip(a: DataFrame, axis: str, size: int) -> DataFrame:
    return a.withColumn(axis, F.lit(size + 1) - F.col(axis))


def repeat(a: DataFrame, axis: str, size: int, times: int) -> DataFrame:
    return a.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(axis, F.col(axis) + F.col("_r") * size).drop("_r").select(*a.columns)


def concat(a: DataFrame, b: DataFrame, axis: str, size: int) -> DataFrame:
    return a.unionByName(b.withColumn(axis, F.col(axis) + size))


def dense(a: DataFrame, shape: dict[str, int]) -> DataFrame:
    """All cells of a small array."""
    grid = a.sparkSession.range(1)
    for c, n in shape.items():
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(1), F.lit(n))))
    return grid.drop("id").join(a, list(shape), "left").fillna(0.0, ["val"])


def triangle(a: DataFrame, row: str, col: str, upper: bool = True, k: int = 0) -> DataFrame:
    d = F.col(col) - F.col(row)
    return a.filter(d >= k if upper else d <= k)


def occupancy(a: DataFrame, cells: int) -> DataFrame:
    """Share of the cells that are not zero."""
    return a.agg((F.sum((F.col("val") != 0).cast("long")) / F.lit(cells)).alias("ratio"))


def convolve(a: DataFrame, kernel: DataFrame, limit: int = 100_000) -> DataFrame:
    """Full convolution over the axes they share. A kernel of at most ``limit`` cells goes to the array's rows as one array."""
    k = axes(a)
    cells = kernel.limit(limit + 1).collect()
    if len(cells) > limit:
        raise ValueError(f"a kernel has at most {limit} cells")
    if not cells:
        return a.limit(0)
    every = F.from_json(F.lit(json.dumps([r.asDict() for r in cells])), f"array<struct<{', '.join(f'{c}: long' for c in k)}, val: double>>")
    j = a.withColumnRenamed("val", "_a").select(*k, "_a", F.explode(every).alias("_c"))
    return j.select(*((F.col(c) + F.col(f"_c.{c}") - 1).alias(c) for c in k), (F.col("_a") * F.col("_c.val")).alias("val")).groupBy(*k).agg(F.sum("val").alias("val")).filter("val <> 0")


def solve(a: DataFrame, b: DataFrame, tol: float = 1e-10, rounds: int | None = None) -> DataFrame:
    """x (j, val) with A x = b for A (i, j, val) and b (i, val); least squares where A is not square.

    b may have further axes, a system each. See linear.least_squares.
    """
    from strandline.operators.linear import least_squares

    return least_squares(a, b, tol, rounds)


def inverse(a: DataFrame, tol: float = 1e-12) -> DataFrame:
    """The inverse (i, j, val) of a square matrix (i, j, val), a system a column, all solved together."""
    from strandline.operators.linear import least_squares

    one = a.select(F.col("i")).distinct().select("i", F.col("i").alias("column"), F.lit(1.0).alias("val"))
    return least_squares(a, one, tol).select(F.col("j").alias("i"), F.col("column").alias("j"), "val")
