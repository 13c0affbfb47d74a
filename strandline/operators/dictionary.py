"""Sparse codes by feature-sign search and dictionaries by the Lagrange dual of their length bound.

Both work on small sums or on batches of rows in the tasks; what grows with the data never reaches the driver.
"""

from __future__ import annotations

import numpy as np

#: Bytes of the systems that are solved side by side.
SYSTEMS = 1 << 26


def feature_sign(a: np.ndarray, b: np.ndarray, lam: float, on: np.ndarray | None = None, tol: float = 1e-10, rounds: int = 10_000) -> tuple[np.ndarray, int]:
    """For each row of b: argmin x'Ax/2 + b'x + lam |x|_1 over the coordinates that are ``on``, and the rounds it took.

    A row keeps a set of active coordinates and their signs. Where it is optimal on those, the coordinate that breaks the conditions
    most joins with the sign against its gradient. With signs fixed the problem is a linear system; the row moves
    towards its solution as far as the objective falls, counting the points where a coordinate changes sign, and those at zero leave.
    Each move lowers the objective, so no set of signs comes twice. All rows take their moves together: systems of
    one size are solved side by side.
    """
    n, k = b.shape
    x, g = np.zeros((n, k)), b.copy()
    free = np.ones((n, k), bool) if on is None else on
    live, used = np.arange(n), 0
    while len(live) and used < rounds:
        used += 1
        xl, gl = x[live], g[live]
        sign = np.sign(xl)
        off = np.where(sign != 0, np.abs(gl + lam * sign), 0.0).max(1, initial=0.0)
        worst = np.where((sign == 0) & free[live], np.abs(gl), -1.0)
        j = worst.argmax(1)
        settled = off <= tol
        joins = settled & (worst[np.arange(len(live)), j] > lam + tol)
        sign[joins, j[joins]] = -np.sign(gl[joins, j[joins]])
        keep = ~settled | joins
        live, sign = live[keep], sign[keep]
        many = (sign != 0).sum(1)
        for c in np.unique(many):
            rows = np.flatnonzero(many == c)
            for part in np.array_split(rows, -(-len(rows) * int(c) * int(c) * 8 // SYSTEMS) or 1):
                _move(a, b, lam, x, g, live[part], sign[part])
    return x, used


def by_signs(a: np.ndarray, b: np.ndarray, lam: float, known: list[np.ndarray], tol: float = 1e-10, sample: int = 256) -> np.ndarray:
    """feature_sign's codes of many rows. The signs that some of them end with are tried on all: with signs fixed a code is a product, and one
    that meets the conditions of a minimum is the only one. Rows that none of these signs suits are searched. ``known`` keeps the signs from one
    batch to the next.
    """
    x, left = np.zeros(b.shape), np.arange(len(b))
    if not known and len(b) > 4 * sample:
        some, _ = feature_sign(a, b[np.linspace(0, len(b) - 1, sample).astype(int)], lam, tol=tol)
        signs, times = np.unique(np.sign(some), axis=0, return_counts=True)
        known += list(signs[np.argsort(-times, kind="stable")])
    for s in known:
        on, own = s != 0, b[left]
        c = np.zeros(own.shape)
        c[:, on] = -(own[:, on] + lam * s[on]) @ np.linalg.inv(a[np.ix_(on, on)])
        g = c @ a + own
        fits = (np.sign(c) == s).all(1) & (np.abs(g + lam * s) <= np.where(on, tol, lam + tol)).all(1)
        x[left[fits]], left = c[fits], left[~fits]
    if len(left):
        x[left] = feature_sign(a, b[left], lam, tol=tol)[0]
    return x


def _move(a: np.ndarray, b: np.ndarray, lam: float, x: np.ndarray, g: np.ndarray, rows: np.ndarray, sign: np.ndarray) -> None:
    """One step of rows that have equally many active coordinates."""
    at = np.nonzero(sign)[1].reshape(len(rows), -1)
    take = lambda v: np.take_along_axis(v, at, 1)
    own = a[at[:, :, None], at[:, None, :]]
    old, theta = take(x[rows]), take(sign)
    d = np.linalg.solve(own, -(take(b[rows]) + lam * theta)[:, :, None])[:, :, 0] - old
    slope = (take(g[rows]) * d).sum(1)
    bend = (d * (own @ d[:, :, None])[:, :, 0]).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = np.where((old != 0) & (np.sign(old) != np.sign(old + d)), -old / d, 1.0)
    turn = np.concatenate([np.clip(turn, 0.0, 1.0), np.ones((len(rows), 1))], axis=1)
    best, value = np.ones(len(rows)), np.full(len(rows), np.inf)
    for s in turn.T:
        v = s * slope + s * s * bend / 2 + lam * np.abs(old + s[:, None] * d).sum(1)
        better = v < value
        best, value = np.where(better, s, best), np.where(better, v, value)
    new = old + best[:, None] * d
    new[(turn[:, :-1] == best[:, None]) & (old != 0) & (np.sign(old) != np.sign(old + d))] = 0.0  # those that turned here
    full = x[rows]
    np.put_along_axis(full, at, new, 1)
    x[rows] = full
    g[rows] = full @ a + b[rows]


def dual_basis(ss: np.ndarray, xs: np.ndarray, before: np.ndarray, length: float = 1.0, rounds: int = 200, tol: float = 1e-12) -> tuple[np.ndarray, float]:
    """argmin |X - B S|^2 / 2 over atoms (columns of B) of at most ``length``, from S S' and X S' alone, and the duality gap.

    Newton's method on the dual variables, one an atom and none negative: those at zero that would fall stay there. Atoms that no row uses
    keep their place in ``before``.
    """
    used = np.diag(ss) > 1e-12 * max(np.diag(ss).max(initial=0.0), 1e-300)
    basis, m, c = before.copy(), int(used.sum()), length * length
    if not m:
        return basis, 0.0
    q, p = ss[np.ix_(used, used)], xs[:, used]
    q = q + 1e-12 * np.trace(q) / m * np.eye(m)
    scale = max(1.0, float(np.abs(p).max()))

    def at(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        inverse = np.linalg.inv(q + np.diag(u))
        b = p @ inverse
        return float((b * p).sum() + c * u.sum()), c - (b * b).sum(0), 2 * (b.T @ b) * inverse, b

    u = np.maximum(np.linalg.norm(p, axis=0) / length - np.diag(q), 0.0)
    v, g, h, b = at(u)
    for _ in range(rounds):
        moving = (u > 0) | (g < 0)
        if not moving.any() or np.abs(np.where(u > 0, g, np.minimum(g, 0.0))).max() < tol * c:
            break
        step = np.zeros(m)
        sub = h[np.ix_(moving, moving)]
        step[moving] = -np.linalg.solve(sub + 1e-14 * np.trace(sub) * np.eye(len(sub)), g[moving])
        t = 1.0
        while t > 1e-12:
            nu = np.maximum(u + t * step, 0.0)
            new = at(nu)
            if new[0] <= v + 1e-4 * g @ (nu - u) + 1e-15 * scale:
                break
            t /= 2
        else:
            break
        if (nu == u).all():
            break
        u, (v, g, h, b) = nu, new
    b = b / np.maximum(1.0, np.linalg.norm(b, axis=0) / length)
    primal, dual = 0.5 * float((b @ q * b).sum()) - float((b * p).sum()), -0.5 * v
    basis[:, used] = b
    return basis, primal - dual
