"""Digital lines of segments against all slopes of pairs, and the strips that cover their points."""

import random
from fractions import Fraction

from strandline.operators import segmentation


def curve(r):
    x, y, out = 0, 0, []
    sx, sy = r.choice([-1, 1]), r.choice([-1, 1])
    for _ in range(r.randint(2, 25)):
        x, y = x + sx * r.randint(0, 4), y + sy * r.randint(0, 3) + r.choice([0, 0, 0, 1, -1])
        out.append((x, y))
    return out


def test_least_width_of_all_slopes():
    r = random.Random(4)
    found = 0
    for _ in range(600):
        points = curve(r)
        got = segmentation.digital_line(points, 5)
        want = None
        for k, turn in enumerate(segmentation.VIEWS):
            q = [turn(*p) for p in points]
            if want or any(b[0] < a[0] for a, b in zip(q, q[1:])) or q[0][0] == q[-1][0]:
                continue
            width = lambda s: max(y - s * x for x, y in q) - min(y - s * x for x, y in q)  # noqa: B023, E731
            slopes = {Fraction(b[1] - a[1], b[0] - a[0]) for a in q for b in q if b[0] > a[0]}
            least = min(map(width, slopes))
            if least < 5:
                ends = [y for x, y in q if x == q[-1][0]]
                s = (max if max(ends) - min(ends) == least else min)(s for s in slopes if width(s) == least)
                g = [s.denominator * y - s.numerator * x for x, y in q]
                want = (k + 1, -s.numerator, s.denominator, min(g), max(max(g), min(g) + s.denominator - 1))
        assert (got and got[:5]) == want, points
        found += want is not None
    assert found > 200
    assert segmentation.digital_line([(1, 2)], 5) is None and segmentation.digital_line([(1, 2), (1, 2)], 5) is None


def test_strips_cover_their_points(spark):
    r = random.Random(9)
    rows = [(k, t + 1, x, y, -x) for k in range(12) for t, (x, y) in enumerate(curve(r))]
    grid = spark.createDataFrame(rows, "seq_id long, t long, gx long, gy long, gz long")
    seg = segmentation.maximal_segments(grid)
    lines = segmentation.strips(grid, seg)
    have = {tuple(x) for x in segmentation.strip_points(lines).collect()}
    known = {(x.seq_id, x.seg_id, x.plane) for x in lines.collect()}
    assert {x.view for x in lines.collect()} >= {1, 2}
    at = {(k, t): (x, y, z) for k, t, x, y, z in rows}
    for s in seg.filter("status = 'ok'").collect():
        for t in range(s.b, s.e + 1):
            x, y, z = at[s.seq_id, t]
            for plane, h in ((1, y), (2, z)):
                assert (s.seq_id, s.seg_id, plane) not in known or (s.seq_id, s.seg_id, plane, x, h) in have
    assert segmentation.strip_points(lines.limit(0)).count() == 0
