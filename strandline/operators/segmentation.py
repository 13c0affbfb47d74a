"""Maximal blurred segments of integer curves, and what is built on them.

A digitised curve piece is a blurred segment of a width if, in one of four orientations, its abscissa never
falls and the vertical distance between the upper and lower border of its convex hull stays under the width (exact
rational arithmetic). The scan of a sequence is sequential by nature; what it asks of short pieces is worked out for many sequences at once.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators.sequence import spread

#: The four views of a point in which a segment may run.
VIEWS = (lambda x, y: (x, y), lambda x, y: (-x, y), lambda x, y: (-y, -x), lambda x, y: (y, x))
SEGMENTS = "seq_id long, seg_id long, b long, e long, status string"
#: Points of a piece up to which all pieces of a block of rows are worked out side by side.
AHEAD = 8
#: Coordinates from here on could leave 64 bits in a product; they are worked out in Python's integers.
FAR = 2**29


def _turn(o, a, b) -> int:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


class Run:
    """One view of a growing piece: the hull's borders, the number of points it takes, and the first that gives it an extent."""

    __slots__ = ("up", "low", "n", "wide", "open")

    def __init__(self):
        self.up, self.low, self.n, self.wide, self.open = [], [], 0, 0, True

    def add(self, q: tuple[int, int], width: int) -> None:
        """Take q unless its abscissa falls or the borders come to stand ``width`` apart; then the view is closed."""
        up, low = self.up, self.low
        if up:
            if q[0] < up[-1][0]:
                self.open = False
                return
            _extend(up, q, 1)
            _extend(low, q, -1)
            if not (_near(up, low, width) and _near(low, up, width)):
                self.open = False
                return
            if not self.wide and up[0][0] != up[-1][0]:
                self.wide = self.n
        else:
            up.append(q)
            low.append(q)
        self.n += 1


def _extend(p: list[tuple[int, int]], q: tuple[int, int], sign: int) -> None:
    """The upper (1) or lower (-1) border of a hull, with a point at its right end."""
    if q[0] == p[-1][0]:
        if sign * (q[1] - p[-1][1]) <= 0:
            return
        if len(p) == 1:
            p[0] = q
            return
    while len(p) > 1 and sign * _turn(p[-2], p[-1], q) >= 0:
        p.pop()
    p.append(q)


def _near(own: list[tuple[int, int]], other: list[tuple[int, int]], width: int) -> bool:
    """Do the vertices of the other border stand less than ``width`` from the last edge of this one? All before did."""
    bx, by = own[-1]
    if len(own) == 1:
        return abs(by - other[-1][1]) < width
    ax, ay = own[-2]
    dx, dy = bx - ax, by - ay
    for k in range(len(other) - 1, -1, -1):
        x, y = other[k]
        if x < ax:
            break
        if abs((y - ay) * dx - dy * (x - ax)) >= width * dx:
            return False
    return True


class Piece:
    """A growing piece of an integer curve in both projections, each in all views."""

    def __init__(self, views: list[list[list[tuple[int, int]]]], begin: int, end: int, width: int, recheck: bool):
        self.views, self.width, self.recheck, self.size = views, width, recheck, end - begin
        self.runs = [[Run() for _ in v] for v in views]
        for runs, each in zip(self.runs, views, strict=True):
            for run, points in zip(runs, each, strict=True):
                for k in range(begin, end):
                    run.add(points[k], width)
                    if not run.open:
                        break

    def add(self, k: int) -> None:
        self.size += 1
        for runs, each in zip(self.runs, self.views, strict=True):
            for run, points in zip(runs, each, strict=True):
                if run.open:
                    run.add(points[k], self.width)

    def accepted(self) -> int:
        """Longest prefix that both projections accept; a projection without extent has none of its own."""
        return min(prefix(runs, self.recheck) or self.size + 1 for runs in self.runs)


def prefix(runs: list[Run], recheck: bool) -> int:
    """Length of the longest prefix that is a blurred segment; 0 if none has an extent.

    Views share their best: once some view has an extent, another that reaches as far extends it without one of its own, unless
    ``recheck``.
    """
    best = 0
    for r in runs:
        if best == 0:
            best = r.n if r.wide else 0
        elif not recheck or r.wide and r.n > r.wide:
            best = max(best, r.n)
    return best


def longest_prefix(points: list[tuple[int, int]], width: int, recheck: bool = False) -> int:
    return prefix(Piece([[[view(int(x), int(y)) for x, y in points] for view in VIEWS]], 0, len(points), width, recheck).runs[0], recheck)


def _ahead(g: np.ndarray, ends: np.ndarray, width: int, recheck: bool) -> np.ndarray:
    """(rows, AHEAD): what Piece.accepted says of the 1, 2, ... points that begin at a row, for integers below FAR.

    All rows and views take their next point at once. A piece stays under the width if no point of it stands ``width`` above or below
    a chord of two others; with each new point only the chords that end there are new.
    """
    n, own = len(g), np.minimum(ends, len(g)) - np.arange(len(g))
    x, y = (np.stack(c) for c in zip(*(view(g[:, 0], g[:, axis]) for axis in (1, 2) for view in VIEWS), strict=True))
    taken, wide = np.ones(x.shape, np.int8), np.zeros(x.shape, np.int8)
    run, at = np.divmod(np.arange(x.size), n)
    for s in range(1, AHEAD):
        go = own[at] > s
        run, at = run[go], at[go]
        go = x[run, at + s] >= x[run, at + s - 1]
        run, at = run[go], at[go]
        px, py = ([c[run, at + i] for i in range(s + 1)] for c in (x, y))
        far = np.zeros(len(at), bool)
        for i in range(s):
            dx, dy = px[s] - px[i], py[s] - py[i]
            far |= (dx == 0) & (np.abs(dy) >= width)
            for j in range(i + 1, s):
                far |= (dx > 0) & (np.abs((py[j] - py[i]) * dx - dy * (px[j] - px[i])) >= width * dx)
        extent = (px[s] > px[0])[~far]
        run, at = run[~far], at[~far]
        taken[run, at] = s + 1
        first = extent & (wide[run, at] == 0)
        wide[run[first], at[first]] = s
    out = np.empty((n, AHEAD), np.int8)
    for s in range(1, AHEAD + 1):
        both = []
        for plane in (0, len(VIEWS)):
            best = np.zeros(n, np.int8)
            for v in range(plane, plane + len(VIEWS)):
                size = np.minimum(taken[v], s)
                has = (wide[v] > 0) & (wide[v] < size)
                best = np.where(best == 0, np.where(has, size, 0), np.where(has | (not recheck), np.maximum(best, size), best))
            both.append(np.where(best == 0, s + 1, best))
        out[:, s - 1] = np.minimum(*both)
    return out


def _scan(rows: np.ndarray, ahead: list[list[int]] | None, width: int, recheck: bool) -> list[tuple[int, int]]:
    n, piece, begin, views = len(rows), None, -1, None

    def accepted(b: int, k: int) -> int:
        """Of the points from b (from 1) to k; a piece longer than is known ahead grows by one point a step, and a begin that slides starts it anew."""
        nonlocal piece, begin, views
        if ahead is not None and k - b < AHEAD:
            return ahead[b - 1][k - b]
        if begin != b:
            if views is None:
                g = rows.tolist()
                views = [[[view(p[0], p[axis]) for p in g] for view in VIEWS] for axis in (1, 2)]
            piece, begin = Piece(views, b - 1, k, width, recheck), b
        while piece.size < k - b + 1:
            piece.add(b - 1 + piece.size)
        return piece.accepted()

    if n < 2:
        return []
    out, b, k, first = [], 1, 1, 0
    while k < n:
        k += 1
        first = accepted(1, k)
        if first < k:
            break
    out.append((1, min(first, n)))
    while k < n:
        while b < k:
            b += 1
            if b == k or accepted(b, k) == k - b + 1:
                break
        while k < n:
            k += 1
            if accepted(b, k) < k - b + 1:
                break
        out.append((b, k - 1))
    return out


def segments_of(g: np.ndarray, ends: np.ndarray, width: int, recheck: bool = False, block: int = 8192) -> list[list[tuple[int, int]]]:
    """``segments`` of many curves that lie one after another in g and end before the rows ``ends``.

    Short pieces are worked out for all rows side by side, ``block`` rows at a time; only longer ones grow point by point.
    """
    begins, ahead = ends - np.diff(ends, prepend=0), None
    if len(g) and -FAR < g.min() and g.max() < FAR:
        end, ahead = np.repeat(ends, ends - begins), []
        for lo in range(0, len(g), block):
            hi = min(lo + block, len(g))
            stop = min(hi + AHEAD - 1, len(g))
            ahead += _ahead(g[lo:stop], end[lo:stop] - lo, width, recheck)[: hi - lo].tolist()
    return [_scan(g[i:j], ahead and ahead[i:j], width, recheck) for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]


def segments(g: np.ndarray, width: int, recheck: bool = False) -> list[tuple[int, int]]:
    """Overlapping maximal segments (1-based, inclusive) of an integer curve: grow, then slide the begin until the piece
    is accepted again. The last one ends before the last point if the curve ends while it grows.
    """
    return segments_of(g, np.array([len(g)]), width, recheck)[0]


def maximal_segments(grid: DataFrame, width: int = 5, recheck: bool = False) -> DataFrame:
    """(seq_id, t, gx, gy, gz) -> (seq_id, seg_id, b, e, status); a sequence without segments gives one row, status short.

    Sequences come to Python as rows of an Arrow batch, many at a time.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                g = part.column("g")
                ends, flat = np.cumsum(g.value_lengths().to_numpy()), g.flatten()
                axes = [flat.field(c) for c in ("gx", "gy", "gz")]
                there = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in axes])
                points = np.column_stack([c.fill_null(0).to_numpy() for c in axes])
                found = segments_of(points[there], np.concatenate([[0], np.cumsum(there)])[ends], width, recheck)
                rows = [(k, n, b, e, "ok" if s else "short") for k, s in enumerate(found) for n, (b, e) in enumerate(s or [(0, 0)], 1 if s else 0)]
                k, n, b, e, status = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("seq_id").take(pa.array(k)), *(pa.array(v, pa.int64()) for v in (n, b, e)), pa.array(status)], ["seq_id", "seg_id", "b", "e", "status"])

    rows = spread(grid).groupBy(F.col("seq_id").cast("long").alias("seq_id")).agg(F.sort_array(F.collect_list(F.struct("t", "gx", "gy", "gz"))).alias("g"))
    return rows.mapInArrow(run, SEGMENTS)


def digital_line(points: list[tuple[int, int]], width: int) -> tuple[int, ...] | None:
    """(view, a, b, low, high, x0, x1, y0, y1) of the first view that takes all points with an extent; else None.

    In that view all points have low <= a x + b y <= high, b > 0, along the slope of least vertical width. Of the slopes of equal
    width it is the least, or the greatest where the borders stand widest apart at the right end. ``high`` leaves room for a point at each x.
    """
    for view, turn in enumerate(VIEWS):
        run, seen = Run(), [turn(*p) for p in points]
        for q in seen:
            run.add(q, width)
            if not run.open:
                break
        if run.open and run.wide:
            break
    else:
        return None
    best: list = []
    for own, other, sign in ((run.up, run.low, 1), (run.low, run.up, -1)):
        k = 0
        for (ax, ay), (bx, by) in zip(own[-2::-1], own[:0:-1], strict=True):  # so the touching vertex moves right
            dx, dy = bx - ax, by - ay
            height = lambda q: sign * (q[1] * dx - dy * q[0])  # noqa: B023, E731
            while k + 1 < len(other) and height(other[k + 1]) <= height(other[k]):
                k += 1
            best.append((Fraction(height((ax, ay)) - height(other[k]), dx), Fraction(dy, dx)))
    least = min(best)[0]
    end = run.up[-1][1] - run.low[-1][1]
    slope = (max if end == least else min)(s for w, s in best if w == least)
    a, b = -slope.numerator, slope.denominator
    g = [a * x + b * y for x, y in (*run.up, *run.low)]
    y = [q[1] for q in seen]
    return view + 1, a, b, min(g), max(max(g), min(g) + b - 1), seen[0][0], seen[-1][0], min(y), max(y)


def strips(grid: DataFrame, seg: DataFrame, width: int = 5) -> DataFrame:
    """The digital lines of segments: seq_id, seg_id, plane (1: gx, gy; 2: gx, gz), view, a, b, low, high and the box x0, x1, y0, y1.

    A plane in which no view has an extent has none. A segment's points are joined by time and gathered, one row a segment.
    """
    at = seg.filter("status = 'ok'").select("seq_id", "seg_id", F.explode(F.sequence("b", "e")).alias("t"))
    g = at.join(grid.select("seq_id", F.col("t").cast("long").alias("t"), "gx", "gy", "gz"), ["seq_id", "t"])
    g = g.groupBy("seq_id", "seg_id").agg(F.sort_array(F.collect_list(F.struct("t", "gx", "gy", "gz"))).alias("g"))
    names = ["plane", "view", "a", "b", "low", "high", "x0", "x1", "y0", "y1"]

    def lines(batches):
        for b in batches:
            rows = [(i, j, plane + 1, *x) for i, j, g in zip(*(b[c].to_pylist() for c in ("seq_id", "seg_id", "g")), strict=True) for plane, axis in enumerate(("gy", "gz")) if (x := digital_line([(q["gx"], q[axis]) for q in g], width))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(12)], ["seq_id", "seg_id", *names])

    return g.mapInArrow(lines, ", ".join(f"{n} long" for n in ["seq_id", "seg_id", *names]))


def strip_points(lines: DataFrame, *keep: str) -> DataFrame:
    """The integer points of strips within their boxes: seq_id, seg_id, plane, gx, h (gy or gz), and other columns of theirs."""
    x = lines.withColumn("x", F.explode(F.sequence("x0", "x1")))
    low = F.greatest(F.expr("-floor((a * x - low) / b)"), "y0")
    high = F.least(F.expr("floor((high - a * x) / b)"), "y1")
    x = x.withColumn("lo", low).withColumn("hi", high).filter("lo <= hi").withColumn("y", F.explode(F.sequence("lo", "hi")))
    back = lambda *c: F.expr(f"CASE view WHEN 1 THEN {c[0]} WHEN 2 THEN {c[1]} WHEN 3 THEN {c[2]} ELSE {c[3]} END")
    return x.select("seq_id", "seg_id", "plane", back("x", "-x", "-y", "y").alias("gx"), back("y", "y", "-x", "x").alias("h"), *keep)


def local_descriptor(df: DataFrame, width: int = 5, mean: DataFrame | None = None) -> DataFrame:
    """The whole descriptor: repeats removed, grid, segments, key points, frames, rotation and velocity.

    With ``mean`` (seq_id, mean_dist) the grid is by mean distance, else by range.
    """
    from strandline.operators import geometry, sequence

    kept = sequence.remove_repeats(sequence.drop_missing(df))
    if mean is None:
        grid = sequence.grid_range(kept)
    else:
        grid = sequence.grid_mean(kept.join(mean, "seq_id"), F.col("mean_dist"))
    seg = maximal_segments(grid, width).filter("status = 'ok'")
    keys = geometry.key_points(kept, seg)
    # through a window no filter is pushed into the frames, whose algebra would be copied into it
    own = F.first("status").over(W.partitionBy("seq_id").orderBy("t").rowsBetween(0, 0))
    frame = geometry.frames(kept, keys).withColumn("own", own).filter("own <> 'degenerate'").drop("own", "status").join(kept.select("seq_id", "t", "orig_t"), ["seq_id", "t"])
    full = sequence.fill_repeats(df, frame.drop("t"), *geometry.AXES)
    return geometry.rotation_velocity(df, full)
