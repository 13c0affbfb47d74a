"""Conjugate gradients with a Wolfe-Powell line search by polynomial fits."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

# fixed values of the search: decrease and curvature conditions, guard of a bracket's ends, largest extrapolation, evaluations a
# search, largest ratio of successive slopes
RHO, SIGMA, GUARD, EXTEND, MOST, RATIO = 0.01, 0.5, 0.1, 3.0, 20, 100.0

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


class Probe(NamedTuple):
    """A step along a direction: the value, slope and gradient there."""

    at: float
    value: float
    slope: float
    grad: np.ndarray


def _parabola(a: Probe, b: Probe) -> float:
    """Minimum of the parabola through a's value and slope and b's value."""
    w = b.at - a.at
    below = 2 * (b.value - a.value - a.slope * w)
    return a.at - a.slope * w * w / below if below else math.nan


def _cubic(a: Probe, b: Probe) -> float:
    """Minimum of the cubic through both values and slopes."""
    w = b.at - a.at
    c = a.slope + b.slope - 3 * (b.value - a.value) / w
    inner = c * c - a.slope * b.slope
    if not inner >= 0:
        return math.nan
    root = math.copysign(math.sqrt(inner), w)
    below = b.slope - a.slope + 2 * root
    return b.at - w * (b.slope + root - c) / below if below else math.nan


def line_search(f: Objective, x: np.ndarray, d: np.ndarray, start: Probe, step: float, most: int = MOST) -> tuple[Probe | None, int]:
    """A step that meets both conditions, or None, and the evaluations it took: one and ``most`` more."""
    used = 0

    def probe(z: float) -> Probe:
        nonlocal used
        used += 1
        v, g = f(x + z * d)
        s = float(g @ d)
        return Probe(z, float(v), s, g) if math.isfinite(v) and math.isfinite(s) else Probe(z, math.inf, math.inf, g)

    beyond = lambda p: p.value > start.value + RHO * p.at * start.slope or p.slope > -SIGMA * start.slope
    behind, now, limit = start, probe(step), math.inf
    while True:
        while beyond(now) and used <= most:  # the minimum lies between: tighten
            limit, w = now.at, now.at - behind.at
            z = _parabola(behind, now) if now.value > start.value else _cubic(behind, now)
            z = z if math.isfinite(z) else behind.at + w / 2
            now = probe(min(max(z, behind.at + GUARD * w), now.at - GUARD * w))
        if beyond(now):
            return None, used
        if now.slope > SIGMA * start.slope:
            return now, used
        if used > most:
            return None, used
        z, w = _cubic(behind, now), now.at - behind.at  # still falling: go on
        if math.isinf(limit):
            z = min(z, EXTEND * now.at) if math.isfinite(z) and z >= now.at else EXTEND * now.at
            z = max(z, min(now.at + GUARD * w, EXTEND * now.at))
        elif not now.at <= z <= limit:
            z = (now.at + limit) / 2
        else:
            z = now.at + GUARD * w if z < now.at + GUARD * w else max(z, now.at + (1 - GUARD) * (limit - now.at))
        behind, now = now, probe(z)


def minimise(f: Objective, x: np.ndarray, rounds: int, expected: float = 1.0, tol: float = 0.0) -> tuple[np.ndarray, list[float], int]:
    """The point reached, the value at the start and after every search, and the evaluations used.

    Directions are Polak-Ribiere's; the first step of a search follows from the ratio of slopes, the very first from the decrease that
    is ``expected``. A positive ``rounds`` is a number of searches, a negative one of evaluations. After a search that fails,
    steepest descent is tried once. Ends early where the slope is under tol times the value.
    """
    v, g = f(x)
    values, used, done, failed = [float(v)], 1, 0, False
    d, slope = -g, -float(g @ g)
    step = expected / (1 - slope)
    while done < rounds if rounds > 0 else used < -rounds:
        if slope == 0 or -slope < tol * max(1.0, abs(v)):
            break
        done += 1
        most = MOST if rounds > 0 else min(MOST, -rounds - used - 1)
        got, n = line_search(f, x, d, Probe(0.0, v, slope, g), step, most)
        used += n
        if got is None:
            if failed:
                break
            d, slope, failed = -g, -float(g @ g), True
            step = 1 / (1 - slope)
            continue
        x, v, before, failed = x + got.at * d, got.value, g, False
        values.append(v)
        g = got.grad
        d = float((g @ g - before @ g) / (before @ before)) * d - g
        new = float(g @ d)
        if new > 0:
            d, new = -g, -float(g @ g)
        step, slope = got.at * min(RATIO, slope / (new - np.finfo(float).tiny)), new
    return x, values, used
