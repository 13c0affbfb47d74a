"""Column expressions for small vectors, 3 x 3 matrices and quaternions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16
Vec = list[Column]


def cols(*names: str) -> Vec:
    return [F.col(n) for n in names]


def sub(a: Vec, b: Vec) -> Vec:
    return [x - y for x, y in zip(a, b, strict=True)]


def add(a: Vec, b: Vec) -> Vec:
    return [x + y for x, y in zip(a, b, strict=True)]


def scale(a: Vec, k: Column) -> Vec:
    return [x * k for x in a]


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def det3(a: Vec, b: Vec, c: Vec) -> Column:
    return dot(a, cross(b, c))


def over(num: Column, den: Column) -> Column:
    """num / den, null where den is 0 or null."""
    return F.when(den != 0, num / den)


def unit(a: Vec) -> Vec:
    n = norm(a)
    return [over(x, n) for x in a]


def square_root_velocity(v: Vec) -> Vec:
    n = F.sqrt(norm(v) + F.lit(EPS))
    return [x / n for x in v]


def circumcentre(a: Vec, b: Vec, c: Vec) -> Vec:
    """Circumcentre relative to a; null for collinear points."""
    u, v = sub(b, a), sub(c, a)
    w = cross(u, v)
    den = F.lit(2.0) * dot(w, w)
    num = cross(sub(scale(v, dot(u, u)), scale(u, dot(v, v))), w)
    return [over(x, den) for x in num]


def right_divide(a: list[Vec], b: list[Vec]) -> list[Vec]:
    """a b^-1 for matrices given by rows, by cofactors; null for singular b."""
    det = det3(*b)

    inv_rows = [[over(x, det) for x in r] for r in zip(*[cross(b[1], b[2]), cross(b[2], b[0]), cross(b[0], b[1])], strict=True)]

    inv_cols = [[inv_rows[r][k] for r in range(3)] for k in range(3)]
    return [[dot(row, col) for col in inv_cols] for row in a]


def quaternion(m: list[Vec]) -> Vec:
    """Unit quaternion [w, x, y, z], w >= 0, of a rotation matrix by rows: from its largest component."""
    tr = m[0][0] + m[1][1] + m[2][2]
    squares = [tr, m[0][0], m[1][1], m[2][2]]
    big = F.greatest(*squares)
    s = lambda k: F.sqrt(F.greatest(1 + 2 * squares[k] - tr if k else 1 + tr, F.lit(0.0))) / 2
    off = {(0, 1): m[2][1] - m[1][2], (0, 2): m[0][2] - m[2][0], (0, 3): m[1][0] - m[0][1], (1, 2): m[0][1] + m[1][0], (1, 3): m[0][2] + m[2][0], (2, 3): m[1][2] + m[2][1]}
    choice = [[s(k) if j == k else over(off[min(j, k), max(j, k)], 4 * s(k)) for j in range(4)] for k in range(4)]
    pick = lambda j: F.when(squares[0] == big, choice[0][j]).when(squares[1] == big, choice[1][j]).when(squares[2] == big, choice[2][j]).otherwise(choice[3][j])
    q = [pick(j) for j in range(4)]
    n = norm(q) * F.when(q[0] < 0, -1.0).otherwise(1.0)
    return [over(x, n) for x in q]


def l2(a: Column, guard: bool = True) -> Column:
    """An array over its length; with guard a zero vector stays, without it is null."""
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    # the length is bound once, not taken anew for every entry
    return F.get(F.transform(F.array(n), lambda m: F.when(m > 0, F.transform(a, lambda x: x / m)).otherwise(a if guard else F.lit(None))), F.lit(0))


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda c: F.when(c == label, 1.0).otherwise(0.0))


def arg_max(scores: Column) -> Column:
    """1-based place of the first largest score."""
    return F.array_position(scores, F.array_max(scores))
