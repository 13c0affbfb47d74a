"""DuckDB SQL for the queries of the catalog."""

from __future__ import annotations

import numpy as np

TRAJ = """traj AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value AS x,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, CAST(second(ts) AS DOUBLE) AS z, user_id % 2 AS split, user_id % 12 + 1 AS label FROM events)"""
COARSE = TRAJ + """, coarse AS (SELECT seq_id, t, floor(x / 50) AS x, floor(y / 50) AS y, floor(z / 30) AS z FROM traj)"""
REPEATS = COARSE + """, marked AS (SELECT *, coalesce(x = lag(x) OVER w AND y = lag(y) OVER w AND z = lag(z) OVER w, false) AS repeated FROM coarse WINDOW w AS (PARTITION BY seq_id ORDER BY t))"""
GRAD = TRAJ + """, grad AS (SELECT seq_id, t, x, y, z, count(*) OVER (PARTITION BY seq_id) AS n,
  CASE WHEN lag(x) OVER w IS NULL THEN lead(x) OVER w - x WHEN lead(x) OVER w IS NULL THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END AS vx,
  CASE WHEN lag(y) OVER w IS NULL THEN lead(y) OVER w - y WHEN lead(y) OVER w IS NULL THEN y - lag(y) OVER w ELSE (lead(y) OVER w - lag(y) OVER w) / 2 END AS vy,
  CASE WHEN lag(z) OVER w IS NULL THEN lead(z) OVER w - z WHEN lead(z) OVER w IS NULL THEN z - lag(z) OVER w ELSE (lead(z) OVER w - lag(z) OVER w) / 2 END AS vz
  FROM traj WINDOW w AS (PARTITION BY seq_id ORDER BY t))"""
RANGES = TRAJ + """, r AS (SELECT seq_id, min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS span FROM traj GROUP BY seq_id)"""
PAIRS = TRAJ + """, pr AS (SELECT a.seq_id, a.t, b.t AS u, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM traj a JOIN traj b USING (seq_id)),
  md AS (SELECT seq_id, avg(sqrt(dx*dx + dy*dy + dz*dz)) AS mean_dist FROM pr GROUP BY seq_id)"""
PATCH = TRAJ + """, n AS (SELECT seq_id, max(t) AS n FROM traj GROUP BY seq_id),
  off AS (SELECT a.seq_id, a.t, o.o, b.x, b.y, b.z FROM traj a CROSS JOIN (SELECT unnest(range(-2, 3)) AS o) o JOIN traj b ON a.seq_id = b.seq_id AND b.t = a.t + o.o JOIN n ON n.seq_id = a.seq_id WHERE a.t > 2 AND a.t <= n.n - 2),
  ss AS (SELECT p.seq_id, p.t - 2 AS t, q.t - 2 AS u, sqrt(sum((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z))) AS d FROM off p JOIN off q ON p.seq_id = q.seq_id AND p.o = q.o GROUP BY ALL)"""
#: Squares are added in one order, so that both engines cut the image's levels alike.
HOG = PATCH + """, pa AS MATERIALIZED (SELECT seq_id, t - 2 AS t, flatten(list([x, y, z] ORDER BY o)) AS p FROM off GROUP BY seq_id, t),
  dd AS (SELECT a.seq_id, a.t, b.t AS u, sqrt(list_reduce(list_transform(list_zip(a.p, b.p), lambda q: (q[1] - q[2]) * (q[1] - q[2])), lambda s, q: s + q)) AS d FROM pa a JOIN pa b USING (seq_id)),
  g0 AS (SELECT seq_id, t, u, floor(d / coalesce(nullif(max(d) OVER (PARTITION BY seq_id), 0), 1) * 65535) AS g FROM dd),
  g1 AS (SELECT seq_id, t, u, max(t) OVER (PARTITION BY seq_id) AS m, lead(g, 1, 0) OVER r - lag(g, 1, 0) OVER r AS gx, lag(g, 1, 0) OVER c - lead(g, 1, 0) OVER c AS gy FROM g0 WINDOW r AS (PARTITION BY seq_id, t ORDER BY u), c AS (PARTITION BY seq_id, u ORDER BY t)),
  g2 AS (SELECT seq_id, t, u, m, sqrt(gx*gx + gy*gy) AS size, (CASE WHEN atan(gy / (gx + 1e-4)) < 0 THEN pi() ELSE 0 END + atan(gy / (gx + 1e-4))) * 6 / pi() + 0.5 AS o FROM g1),
  votes AS MATERIALIZED (SELECT seq_id, t, u - t AS side, m, floor(o) + k AS z, size * (CASE k WHEN 0 THEN 1 - (o - floor(o)) ELSE o - floor(o) END) AS val FROM g2, (SELECT unnest([0, 1]) AS k) WHERE u >= t AND size >= 1e-5),
  o0 AS (SELECT dy, dx, atan2(dx - dy, dx + dy) * 8 / pi() + 0.5 AS a, ln(sqrt(dx*dx + dy*dy)) * 4 / ln(30) + 0.5 AS b FROM (SELECT unnest(range(-30, 31)) AS dy), (SELECT unnest(range(-30, 31)) AS dx) WHERE dx >= dy AND dx*dx + dy*dy BETWEEN 1 AND 900),
  o1 AS MATERIALIZED (SELECT dy, dx - dy AS side, CAST(floor(a) + i AS INTEGER) AS sector, CAST(floor(b) + j AS INTEGER) AS ring, (CASE i WHEN 0 THEN 1 - (a - floor(a)) ELSE a - floor(a) END) * (CASE j WHEN 0 THEN 1 - (b - floor(b)) ELSE b - floor(b) END) AS share FROM o0, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j) WHERE floor(a) + i BETWEEN 1 AND 8 AND floor(b) + j BETWEEN 1 AND 4),
  cells AS (SELECT seq_id, t - dy AS t, sector, ring, CAST(z AS INTEGER) AS z, greatest(sum(share * val), 0) AS h FROM votes JOIN o1 USING (side) WHERE t - dy BETWEEN 1 AND m AND z BETWEEN 1 AND 6 GROUP BY ALL),
  n1 AS (SELECT * EXCLUDE h, least(h / sqrt(sum(h*h) OVER w + 1e-6), 0.6) AS h FROM cells WINDOW w AS (PARTITION BY seq_id, t)),
  n2 AS (SELECT * EXCLUDE h, h / sqrt(sum(h*h) OVER w + 1e-6) AS h FROM n1 WINDOW w AS (PARTITION BY seq_id, t)),
  hog AS (SELECT seq_id, t, CAST(CASE WHEN ring = 1 THEN 0 ELSE (sector - 1) * 3 + ring - 1 END * 6 + z - 1 AS INTEGER) AS i, round(sum(h), 4) + 0.0 AS v FROM n2 GROUP BY ALL HAVING round(sum(h), 4) <> 0)"""
SHAPE = PAIRS + """, q AS (SELECT pr.seq_id, t, u, sqrt(dx*dx + dy*dy + dz*dz) / mean_dist AS r, CASE WHEN atan2(dy, dx) < 0 THEN atan2(dy, dx) + 2 * pi() ELSE atan2(dy, dx) END AS th, atan2(sqrt(dx*dx + dy*dy), dz) AS al FROM pr JOIN md USING (seq_id) WHERE mean_dist > 0),
  b AS (SELECT seq_id, t, u, CAST(least(floor(th / (pi() * 2 / 18)) + 1, 18) AS INTEGER) AS theta, CAST(least(floor(al / (pi() / 9)) + 1, 9) AS INTEGER) AS alpha,
  CAST((r < 0.125)::INT + (r < 0.25)::INT + (r < 0.5)::INT + (r < 1.0)::INT + (r < 2.0)::INT AS INTEGER) AS radius FROM q)"""
PYR = TRAJ + """, nn AS (SELECT *, count(*) OVER (PARTITION BY seq_id) AS n FROM traj), lv AS (SELECT unnest([1, 2, 4, 8]) AS level),
  pyr AS (SELECT nn.*, level, CAST(ceil(t / (n / level)) AS INTEGER) AS bin FROM nn CROSS JOIN lv),
  bins AS (SELECT seq_id, level, unnest(range(1, level + 1)) AS bin FROM (SELECT DISTINCT seq_id FROM traj) CROSS JOIN lv)"""
#: prior, means and variances of a fixed mixture over x, y, z
GMM = [(0.4, [200.0, 30.0, 20.0], [40000.0, 600.0, 250.0]), (0.6, [600.0, 70.0, 40.0], [60000.0, 500.0, 300.0])]

#: a fixed basis of three rows and six atoms of length one
_RAW = np.array([[((i * 5 + k * 3) % 7) - 3.0 + 0.5 * (i == k % 3) for k in range(6)] for i in range(3)])
BASIS = _RAW / np.linalg.norm(_RAW, axis=0)


def _mixture(source: str) -> str:
    rows = ", ".join(f"({k}, {p}, {m[0]}, {m[1]}, {m[2]}, {v[0]}, {v[1]}, {v[2]})" for k, (p, m, v) in enumerate(GMM))
    return f""", gmm AS (SELECT * FROM (VALUES {rows}) g(k, w, m0, m1, m2, v0, v1, v2)),
  dens AS (SELECT s.*, g.*, ln(w) - 0.5 * (ln(2*pi()*v0) + ln(2*pi()*v1) + ln(2*pi()*v2)) - (x-m0)*(x-m0)/(2*v0) - (y-m1)*(y-m1)/(2*v1) - (z-m2)*(z-m2)/(2*v2) AS l FROM {source} s CROSS JOIN gmm g)"""


def _fisher(by: str, source: str) -> str:
    return _mixture(source) + f""", post AS (SELECT *, exp(l - max(l) OVER (PARTITION BY {by}, t)) / sum(exp(l - ml)) OVER (PARTITION BY {by}, t) AS q0 FROM (SELECT *, max(l) OVER (PARTITION BY {by}, t) AS ml FROM dens)),
  pq AS (SELECT *, CASE WHEN q0 < 1e-6 THEN 0 ELSE q0 END AS q, (x-m0)/sqrt(v0) AS z0, (y-m1)/sqrt(v1) AS z1, (z-m2)/sqrt(v2) AS z2 FROM post),
  fs AS (SELECT {by}, k, any_value(w) AS w, count(*) AS n, [sum(q*z0), sum(q*z1), sum(q*z2)] AS u, [sum(q*(z0*z0-1)), sum(q*(z1*z1-1)), sum(q*(z2*z2-1))] AS v FROM pq GROUP BY {by}, k),
  fl AS (SELECT {by}, k, 'u' AS part, d, u[d+1] / (n * sqrt(w)) AS val FROM fs CROSS JOIN (SELECT unnest([0,1,2]) AS d) UNION ALL SELECT {by}, k, 'v', d, v[d+1] / (n * sqrt(2*w)) FROM fs CROSS JOIN (SELECT unnest([0,1,2]) AS d)),
  fr AS (SELECT {by}, k, part, d, sign(val) * sqrt(abs(val)) AS val FROM fl),
  fn AS (SELECT {by}, k, part, d, val / greatest(sqrt(sum(val*val) OVER (PARTITION BY {by})), 1e-12) AS val FROM fr)"""


SEG = TRAJ + """, nx AS (SELECT seq_id, max(t) AS n FROM traj GROUP BY seq_id), seg AS (SELECT seq_id, k * 4 + 1 AS b, least(k * 4 + 9, n) AS e FROM (SELECT seq_id, n, unnest(range(0, CAST(floor((n - 1) / 4) AS BIGINT) + 1)) AS k FROM nx)),
  keys AS (SELECT t.seq_id, t.t, min(CASE WHEN e >= t.t THEN b END) AS l, max(CASE WHEN b <= t.t THEN e END) AS r FROM traj t JOIN seg USING (seq_id) GROUP BY ALL)"""


def _cross(o: str, a: str, b: str, axes: str = "xyz") -> str:
    x, y, z = axes
    return f"{a}{y}*{b}{z} - {a}{z}*{b}{y} AS {o}x, {a}{z}*{b}{x} - {a}{x}*{b}{z} AS {o}y, {a}{x}*{b}{y} - {a}{y}*{b}{x} AS {o}z"


def _dot(a: str, b: str) -> str:
    return f"({a}x*{b}x + {a}y*{b}y + {a}z*{b}z)"


def _unit(o: str, a: str) -> str:
    n = f"sqrt({_dot(a, a)})"
    return ", ".join(f"CASE WHEN {n} <> 0 THEN {a}{c} / {n} END AS {o}{c}" for c in "xyz")


CENTRE = SEG + f""", pt AS (SELECT k.seq_id, k.t, n.n, p.x - l.x AS ux, p.y - l.y AS uy, p.z - l.z AS uz, r.x - l.x AS wx, r.y - l.y AS wy, r.z - l.z AS wz, r.x - p.x AS fx, r.y - p.y AS fy, r.z - p.z AS fz
  FROM keys k JOIN nx n USING (seq_id) JOIN traj p ON p.seq_id = k.seq_id AND p.t = k.t JOIN traj l ON l.seq_id = k.seq_id AND l.t = k.l JOIN traj r ON r.seq_id = k.seq_id AND r.t = k.r),
  c1 AS (SELECT *, {_cross('c', 'u', 'w')}, {_dot('u', 'u')} AS uu, {_dot('w', 'w')} AS ww FROM pt),
  c2 AS (SELECT *, uu*wx - ww*ux AS gx, uu*wy - ww*uy AS gy, uu*wz - ww*uz AS gz, 2 * {_dot('c', 'c')} AS den FROM c1),
  c3 AS (SELECT *, {_cross('h', 'g', 'c')} FROM c2),
  cc AS (SELECT *, CASE WHEN den <> 0 THEN hx/den END AS ox, CASE WHEN den <> 0 THEN hy/den END AS oy, CASE WHEN den <> 0 THEN hz/den END AS oz FROM c3)"""
FRAMES = CENTRE + f""", d1 AS (SELECT seq_id, t, n, ox - ux AS ix, oy - uy AS iy, oz - uz AS iz, {_unit('p', 'u')}, {_unit('q', 'f')} FROM cc),
  d2 AS (SELECT seq_id, t, n, {_unit('a', 'i')}, {_cross('e', 'p', 'q')} FROM d1), d3 AS (SELECT seq_id, t, n, ax, ay, az, {_unit('s', 'e')} FROM d2),
  fr AS (SELECT seq_id, t, n, (t >= 3 AND t <= n - 2) AS inn, {_cross('t', 'a', 's')}, ax, ay, az, sx, sy, sz FROM d3)"""
QUAT = """, qq AS (SELECT *, 1 + r00 + r11 + r22 AS s0, 1 + 2*r00 - (r00+r11+r22) AS s1, 1 + 2*r11 - (r00+r11+r22) AS s2, 1 + 2*r22 - (r00+r11+r22) AS s3, greatest(r00+r11+r22, r00, r11, r22) AS big FROM rot),
  qs AS (SELECT *, CASE WHEN r00+r11+r22 = big THEN 0 WHEN r00 = big THEN 1 WHEN r11 = big THEN 2 ELSE 3 END AS c FROM qq),
  q4 AS (SELECT *, sqrt(greatest(CASE c WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END, 0)) / 2 AS m FROM qs),
  q5 AS (SELECT *, CASE c WHEN 0 THEN m WHEN 1 THEN (r21-r12)/(4*m) WHEN 2 THEN (r02-r20)/(4*m) ELSE (r10-r01)/(4*m) END AS aw, CASE c WHEN 0 THEN (r21-r12)/(4*m) WHEN 1 THEN m WHEN 2 THEN (r01+r10)/(4*m) ELSE (r02+r20)/(4*m) END AS ax,
  CASE c WHEN 0 THEN (r02-r20)/(4*m) WHEN 1 THEN (r01+r10)/(4*m) WHEN 2 THEN m ELSE (r12+r21)/(4*m) END AS ay, CASE c WHEN 0 THEN (r10-r01)/(4*m) WHEN 1 THEN (r02+r20)/(4*m) WHEN 2 THEN (r12+r21)/(4*m) ELSE m END AS az FROM q4),
  qn AS (SELECT *, sqrt(aw*aw+ax*ax+ay*ay+az*az) * CASE WHEN aw < 0 THEN -1 ELSE 1 END AS nq FROM q5)"""
_ROWS = [[f"{p}{c}" for p in ("t", "a", "s")] for c in "xyz"]
_COF = [[f"(b{(k + 1) % 3}{(r + 1) % 3}*b{(k + 2) % 3}{(r + 2) % 3} - b{(k + 1) % 3}{(r + 2) % 3}*b{(k + 2) % 3}{(r + 1) % 3})" for r in range(3)] for k in range(3)]
TURN = FRAMES + """, ft AS (SELECT fr.*, x, y, z FROM fr JOIN traj USING (seq_id, t) WHERE inn),
  fg AS (SELECT seq_id, t, """ + ", ".join(f"{_ROWS[i][j]} AS b{i}{j}, CASE WHEN lead(t) OVER w IS NULL THEN {_ROWS[i][j]} ELSE lead({_ROWS[i][j]}) OVER w END AS n{i}{j}" for i in range(3) for j in range(3)) + """,
  """ + ", ".join(f"CASE WHEN lag({c}) OVER w IS NULL AND lead({c}) OVER w IS NULL THEN 0 WHEN lag({c}) OVER w IS NULL THEN lead({c}) OVER w - {c} WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END AS v{c}" for c in "xyz") + """ FROM ft WINDOW w AS (PARTITION BY seq_id ORDER BY t)),
  fd AS (SELECT *, """ + " + ".join(f"b0{r} * {_COF[0][r]}" for r in range(3)) + """ AS det FROM fg),
  fm AS (SELECT *, """ + ", ".join("CASE WHEN det <> 0 THEN (" + " + ".join(f"n{i}{r} * {_COF[j][r]}" for r in range(3)) + f") / det END AS m{i}{j}" for i in range(3) for j in range(3)) + """, sqrt(sqrt(vx*vx + vy*vy + vz*vz) + 2.220446049250313e-16) AS vn FROM fd),
  rot AS (SELECT *, """ + ", ".join(f"m{j}{i} AS r{i}{j}" for i in range(3) for j in range(3)) + """ FROM fm)"""
#: Maximal blurred segments by their definition, from all pairs and triples of points instead of a growing hull. J: the first point that with an
#: earlier one and what lies between stands five or more apart; shut: the first point that a piece from b does not take; wide:
#: the first that gives it an extent; ac: how many points of the piece from b to k the views accept; then the scan over (b, k).
MBS = RANGES + """, nx AS (SELECT seq_id, max(t) AS n FROM traj GROUP BY seq_id),
  gr AS (SELECT seq_id, t, CAST(round((x - lx) / (span / 1000)) AS BIGINT) AS gx, CAST(round((y - ly) / (span / 1000)) AS BIGINT) AS gy, CAST(round((z - lz) / (span / 1000)) AS BIGINT) AS gz FROM traj JOIN r USING (seq_id) WHERE span <> 0),
  v0 AS (SELECT seq_id, t, p, v, CASE v WHEN 1 THEN gx WHEN 2 THEN -gx WHEN 3 THEN -h ELSE h END AS x, CASE v WHEN 1 THEN h WHEN 2 THEN h WHEN 3 THEN -gx ELSE gx END AS y FROM (SELECT *, CASE p WHEN 1 THEN gy ELSE gz END AS h FROM gr, (SELECT unnest([1, 2]) AS p), (SELECT unnest([1, 2, 3, 4]) AS v))),
  v1 AS (SELECT *, CASE WHEN x < lag(x) OVER w THEN 1 ELSE 0 END AS falls FROM v0 WINDOW w AS (PARTITION BY seq_id, p, v ORDER BY t)),
  v2 AS MATERIALIZED (SELECT *, sum(falls) OVER (PARTITION BY seq_id, p, v ORDER BY t) AS run FROM v1),
  two AS MATERIALIZED (SELECT i.seq_id, i.p, i.v, i.run, i.t AS i, j.t AS j, i.x AS xi, i.y AS yi, j.x AS xj, j.y AS yj FROM v2 i JOIN v2 j USING (seq_id, p, v, run) WHERE j.t > i.t),
  bad AS (SELECT seq_id, p, v, i, j FROM two WHERE xi = xj AND abs(yi - yj) >= 5 UNION ALL
    SELECT two.seq_id, two.p, two.v, i, j FROM two JOIN v2 m ON m.seq_id = two.seq_id AND m.p = two.p AND m.v = two.v AND m.t > i AND m.t < j WHERE xi < xj AND abs((m.y - yi) * (xj - xi) - (yj - yi) * (m.x - xi)) >= 5 * (xj - xi)),
  v3 AS (SELECT v2.*, J FROM v2 LEFT JOIN (SELECT seq_id, p, v, i AS t, min(j) AS J FROM bad GROUP BY ALL) USING (seq_id, p, v, t)),
  v4 AS (SELECT seq_id, p, v, t AS b, least(coalesce(min(J) OVER (PARTITION BY seq_id, p, v, run ORDER BY t DESC), 1000000000), max(t) OVER (PARTITION BY seq_id, p, v, run) + 1) AS shut FROM v3),
  v5 AS (SELECT v4.*, coalesce(wide, 1000000000) AS wide FROM v4 LEFT JOIN (SELECT seq_id, p, v, i AS b, min(j) AS wide FROM two WHERE xj > xi GROUP BY ALL) USING (seq_id, p, v, b)),
  v6 AS (SELECT seq_id, p, b, list(shut ORDER BY v) AS c, list(wide ORDER BY v) AS w FROM v5 GROUP BY ALL),
  a0 AS (SELECT seq_id, p, b, k, c, w, [least(q, k + 1) - b FOR q IN c] AS m, [w[q] <= k AND w[q] < c[q] FOR q IN [1, 2, 3, 4]] AS has FROM (SELECT v6.*, unnest(range(b, n + 1)) AS k FROM v6 JOIN nx USING (seq_id))),
  ac AS MATERIALIZED (SELECT seq_id, b, k, k - b + 1 AS size, min(CASE WHEN has[1] THEN greatest(m[1], m[2], m[3], m[4]) WHEN has[2] THEN greatest(m[2], m[3], m[4]) WHEN has[3] THEN greatest(m[3], m[4]) WHEN has[4] THEN m[4] ELSE k - b + 2 END) AS a FROM a0 GROUP BY ALL),
  slide AS MATERIALIZED (SELECT seq_id, b, k, min(CASE WHEN a = size OR b = k THEN b END) OVER (PARTITION BY seq_id, k ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM ac),
  grow AS MATERIALIZED (SELECT seq_id, b, k, n, coalesce(min(CASE WHEN a < size THEN k END) OVER (PARTITION BY seq_id, b ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n) AS nk FROM ac JOIN nx USING (seq_id)),
  scan(seq_id, seg_id, b, k, e) AS (SELECT g.seq_id, CAST(1 AS BIGINT), g.b, g.nk, least(ac.a, n) FROM grow g JOIN ac ON ac.seq_id = g.seq_id AND ac.b = 1 AND ac.k = g.nk WHERE g.b = 1 AND g.k = 1 AND n > 1
    UNION ALL SELECT s.seq_id, s.seg_id + 1, g.b, g.nk, g.nk - 1 FROM scan s JOIN slide l ON l.seq_id = s.seq_id AND l.b = s.b AND l.k = s.k JOIN grow g ON g.seq_id = s.seq_id AND g.b = l.nb AND g.k = s.k WHERE s.k < g.n),
  seg AS MATERIALIZED (SELECT seq_id, seg_id, b, e FROM scan)"""
#: The digital lines of segments: all slopes of pairs, the width along each, the first view under the width, and the points between.
STRIPS = MBS + """,
  pt AS MATERIALIZED (SELECT seq_id, seg_id, p, v, x, y, run FROM seg JOIN v2 USING (seq_id) WHERE t BETWEEN b AND e),
  fit AS (SELECT seq_id, seg_id, p, v, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pt GROUP BY ALL HAVING min(run) = max(run) AND min(x) < max(x)),
  slopes AS (SELECT DISTINCT seq_id, seg_id, p, v, CAST((j.y - i.y) / gcd(j.x - i.x, j.y - i.y) AS BIGINT) AS dy, CAST((j.x - i.x) / gcd(j.x - i.x, j.y - i.y) AS BIGINT) AS dx FROM pt i JOIN pt j USING (seq_id, seg_id, p, v) JOIN fit USING (seq_id, seg_id, p, v) WHERE j.x > i.x),
  wide AS (SELECT seq_id, seg_id, p, v, dx, dy, min(y * dx - dy * x) AS low, max(y * dx - dy * x) AS high FROM slopes JOIN pt USING (seq_id, seg_id, p, v) GROUP BY ALL),
  thin AS (SELECT *, (high - low) / dx AS w, min((high - low) / dx) OVER (PARTITION BY seq_id, seg_id, p, v) AS least FROM wide),
  one AS (SELECT seq_id, seg_id, p, min(v) AS v FROM thin WHERE least < 5 GROUP BY ALL),
  tip AS (SELECT seq_id, seg_id, p, v, max(y) - min(y) AS tip FROM pt JOIN fit USING (seq_id, seg_id, p, v) WHERE x = x1 GROUP BY ALL),
  ln AS (SELECT thin.*, greatest(high, low + dx - 1) AS top, row_number() OVER (PARTITION BY seq_id, seg_id, p, v ORDER BY CASE WHEN tip = least THEN -dy / dx ELSE dy / dx END) AS place FROM thin JOIN one USING (seq_id, seg_id, p, v) JOIN tip USING (seq_id, seg_id, p, v) WHERE w = least),
  ct AS (SELECT seq_id, seg_id, p, v, sum(greatest(0, least(y1, CAST(floor((top + dy * x) / dx) AS BIGINT)) - greatest(y0, CAST(ceil((low + dy * x) / dx) AS BIGINT)) + 1)) AS points FROM (SELECT ln.*, fit.y0, fit.y1, unnest(range(x0, x1 + 1)) AS x FROM ln JOIN fit USING (seq_id, seg_id, p, v) WHERE place = 1) GROUP BY ALL)
  SELECT seq_id, seg_id, CAST(p AS BIGINT) AS plane, CAST(v AS BIGINT) AS view, CAST(-dy AS BIGINT) AS a, CAST(dx AS BIGINT) AS b, CAST(low AS BIGINT) AS low, CAST(top AS BIGINT) AS high, CAST(points AS BIGINT) AS points FROM ln JOIN ct USING (seq_id, seg_id, p, v) WHERE place = 1"""
_FILLED = ", ".join(f"last_value(CASE WHEN inn THEN {a}{c} ELSE 0 END IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {a}{c}" for a in "tas" for c in "xyz")
#: The whole descriptor; degenerate frames copy the one before. The events have no point that repeats the one before it.
LOCAL = MBS + """,
  keys AS (SELECT t.seq_id, t.t, min(CASE WHEN e >= t.t THEN b END) AS l, max(CASE WHEN b <= t.t THEN e END) AS r FROM traj t JOIN seg USING (seq_id) GROUP BY ALL)""" + TURN[len(SEG) :].replace(", ft AS (SELECT fr.*, x, y, z FROM fr ", f""", known AS (SELECT traj.seq_id, traj.t, nx.n, traj.t >= 3 AND traj.t <= nx.n - 2 AS inn, {', '.join(f'fr.{a}{c}' for a in 'tas' for c in 'xyz')} FROM traj JOIN nx USING (seq_id) LEFT JOIN fr USING (seq_id, t)),
  filled AS (SELECT seq_id, t, n, inn, {_FILLED} FROM known), ft AS (SELECT filled.*, x, y, z FROM filled """)
#: curvature and torsion of five points around each, and their derivatives
_P = {"a": (2, 1), "b": (3, 2), "c": (3, 1), "d": (4, 3), "e": (4, 2), "f": (4, 1), "g": (1, 0), "k": (2, 0), "m": (3, 0)}


def _gap(i: int, j: int) -> str:
    return "sqrt(" + " + ".join(f"({c}{i}-{c}{j})*({c}{i}-{c}{j})" for c in "xyz") + ")"


def _cofactor(i: int, j: int, o: int) -> list[str]:
    u, v = [f"({c}{i}-{c}{o})" for c in "xyz"], [f"({c}{j}-{c}{o})" for c in "xyz"]
    return [f"({u[(k + 1) % 3]}*{v[(k + 2) % 3]} - {u[(k + 2) % 3]}*{v[(k + 1) % 3]})" for k in range(3)]


def _det(o: int) -> str:
    return " + ".join(f"({c}2-{c}{o})*{x}" for c, x in zip("xyz", _cofactor(1, 3, o), strict=True))


DIFF = TRAJ + """, five AS (SELECT seq_id, t, count(*) OVER (PARTITION BY seq_id) AS n, """ + ", ".join(f"{'lag' if k < 2 else 'lead'}({c}, {abs(k - 2)}) OVER w AS {c}{k}" if k != 2 else f"{c} AS {c}2" for k in range(5) for c in "xyz") + """ FROM traj WINDOW w AS (PARTITION BY seq_id ORDER BY t)),
  gaps AS (SELECT seq_id, t, t >= 3 AND t <= n - 2 AS inn, """ + ", ".join(f"{_gap(*ij)} AS {o}" for o, ij in _P.items()) + ", sqrt(" + " + ".join(f"{x}*{x}" for x in _cofactor(2, 3, 1)) + f") AS w, {_det(4)} AS det1, {_det(0)} AS det2" + """ FROM five),
  heron AS (SELECT *, sqrt(greatest((a+b+c)/2 * ((a+b+c)/2 - a) * ((a+b+c)/2 - b) * ((a+b+c)/2 - c), 0)) AS area FROM gaps),
  curv AS (SELECT *, CASE WHEN inn THEN 4 * area / nullif(a * b * c, 0) ELSE 0 END AS curvature FROM heron),
  tors AS (SELECT *, CASE WHEN inn THEN 3 * (det1 / 2 / nullif(area, 0)) / nullif(d * e * f * curvature, 0) + 3 * (det2 / 2 / nullif(area, 0)) / nullif(g * k * m * curvature, 0) ELSE 0 END AS torsion FROM curv),
  turns AS (SELECT *, lead(curvature) OVER o - lag(curvature) OVER o AS tc, lead(torsion) OVER o - lag(torsion) OVER o AS tt, w / nullif(c, 0) AS h FROM tors WINDOW o AS (PARTITION BY seq_id ORDER BY t)),
  slopes AS (SELECT *, 3 * tc / nullif(2*a + 2*b + d + g, 0) AS kd, 4 * (tt + (2*a + 2*b - 2*d - 3*h + g) * (torsion * (tc / nullif(c, 0)) / nullif(6 * curvature, 0))) / nullif(2*a + 2*b*2*d + h + g, 0) AS td FROM turns),
  diff AS (SELECT seq_id, t, inn, curvature, CASE WHEN inn THEN CASE WHEN kd <> 0 THEN sign(kd) * sqrt(abs(kd)) END ELSE 0 END AS curvature_d, torsion, CASE WHEN inn THEN CASE WHEN td <> 0 THEN sign(td) * sqrt(abs(td)) END ELSE 0 END AS torsion_d FROM slopes)"""
#: fixed weights theta(d, c) over the 64 features of an embedding
THETA = "(((d * 7 + c * 3) % 5) - 2) / 10.0"
EMB = """emb AS (SELECT vec_id, label + 1 AS label, embedding FROM embeddings), el AS (SELECT vec_id, label, unnest(range(0, 64)) AS d, unnest(embedding)::DOUBLE AS v FROM emb),
  th AS (SELECT d, c, """ + THETA + """ AS w FROM (SELECT unnest(range(0, 64)) AS d) CROSS JOIN (SELECT unnest(range(0, 10)) AS c)),
  sc AS (SELECT vec_id, any_value(label) AS label, c, sum(v * w) AS s FROM el JOIN th USING (d) GROUP BY vec_id, c),
  pred AS (SELECT vec_id, label, c + 1 AS prediction, s FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS rk FROM sc) WHERE rk = 1)"""
NDA = "nda AS (SELECT user_id % 7 + 1 AS i, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 + 1 AS j, CAST(floor(value / 100) AS BIGINT) % 4 + 1 AS k, floor(value) AS val FROM events), a AS (SELECT i, j, k, sum(val) AS val FROM nda GROUP BY ALL HAVING sum(val) <> 0)"


def _spline(source: str, name: str) -> str:
    """The not-a-knot spline through source (seq_id, k from 0, n, x, y, z) at steps of 0.1, of four points at least.

    Second derivatives solve m[k-1] + 4 m[k] + m[k+1] = r[k] between the first and last inner knots, where not-a-knot gives m = r / 6.
    The inverse of that matrix is explicit: powers of sqrt(3) - 2, and their reflections at both ends; 60 powers exceed double precision.
    """
    each = lambda f: ", ".join(f(c) for c in "xyz")
    power = lambda e: f"CASE WHEN {e} <= 60 THEN power(sqrt(3) - 2, {e}) ELSE 0 END"
    green = f"({power('abs(a.k - b.k)')} - {power('a.k + b.k - 2')} - {power('2 * a.n - a.k - b.k - 4')}) / (2 * sqrt(3))"
    m = lambda c: f"CASE k WHEN 0 THEN 2 * lead(m{c}, 1) OVER w - lead(m{c}, 2) OVER w WHEN n - 1 THEN 2 * lag(m{c}, 1) OVER w - lag(m{c}, 2) OVER w ELSE m{c} END AS m{c}"
    value = lambda c: f"{c} * (1 - s) + {c}1 * s + ((s*s*s - s) * m{c}1 + ((1-s)*(1-s)*(1-s) - (1-s)) * m{c}) / 6 AS {c}"
    return f""", {name}r AS MATERIALIZED (SELECT seq_id, k, n, {each(lambda c: f"6 * (lead({c}) OVER w - 2 * {c} + lag({c}) OVER w) AS r{c}")} FROM {source} WINDOW w AS (PARTITION BY seq_id ORDER BY k)),
  {name}b AS MATERIALIZED (SELECT seq_id, k, n, {each(lambda c: f"r{c} - CASE WHEN k = 2 THEN lag(r{c}) OVER w / 6 ELSE 0 END - CASE WHEN k = n - 3 THEN lead(r{c}) OVER w / 6 ELSE 0 END AS r{c}")} FROM {name}r WINDOW w AS (PARTITION BY seq_id ORDER BY k)),
  {name}m AS MATERIALIZED (SELECT a.seq_id, a.k, {each(lambda c: f"sum(b.r{c} * g) AS m{c}")} FROM (SELECT a.seq_id, a.k, b.k AS j, {green} AS g FROM {name}b a JOIN {name}b b ON a.seq_id = b.seq_id AND b.k BETWEEN a.k - 60 AND a.k + 60 WHERE a.k BETWEEN 2 AND a.n - 3 AND b.k BETWEEN 2 AND b.n - 3) a JOIN {name}b b ON a.seq_id = b.seq_id AND a.j = b.k GROUP BY a.seq_id, a.k
    UNION ALL SELECT seq_id, k, {each(lambda c: f"r{c} / 6")} FROM {name}r WHERE k IN (1, n - 2) UNION ALL SELECT seq_id, k, NULL, NULL, NULL FROM {name}r WHERE k IN (0, n - 1)),
  {name}f AS MATERIALIZED (SELECT seq_id, k, n, x, y, z, {each(m)} FROM {source} JOIN {name}m USING (seq_id, k) WINDOW w AS (PARTITION BY seq_id ORDER BY k)),
  {name}p AS (SELECT *, {each(lambda c: f"lead({c}) OVER w AS {c}1, lead(m{c}) OVER w AS m{c}1")} FROM {name}f WINDOW w AS (PARTITION BY seq_id ORDER BY k)),
  {name} AS MATERIALIZED (SELECT seq_id, 10 * k + j AS k, 10 * (n - 1) + 1 AS n, {each(value)} FROM (SELECT *, j / 10.0::DOUBLE AS s FROM {name}p, (SELECT unnest(range(0, 11)) AS j) WHERE k <= n - 2 AND (j < 10 OR k = n - 2)))"""


def R(e: str, n: str, k: int = 6) -> str:  # noqa: N802
    return f"round({e}, {k}) + 0.0 AS {n}"


ORACLES = {
    "srvf": f"WITH {GRAD} SELECT seq_id, t, " + ", ".join(R(f"v{c} / sqrt(sqrt(vx*vx+vy*vy+vz*vz) + 2.220446049250313e-16)", f"s{c}") for c in "xyz") + " FROM grad",
    "gradient": f"WITH {GRAD} SELECT seq_id, t, " + ", ".join(R(f"v{c}", f"v{c}") for c in "xyz") + " FROM grad",
    "drop_missing": f"WITH {TRAJ} SELECT seq_id, t FROM traj WHERE NOT (y = 0)",
    "repeat_removal": f"WITH {REPEATS} SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY t) AS t, t AS orig_t, x, y, z FROM marked WHERE NOT repeated",
    "fill_repeat": f"WITH {COARSE} SELECT seq_id, t, x, y, z FROM coarse",
    "grid_range": f"WITH {RANGES} SELECT seq_id, t, " + ", ".join(f"CAST(CASE WHEN span <> 0 THEN round(({c} - l{c}) / (span / 1000)) END AS BIGINT) AS g{c}" for c in "xyz") + " FROM traj JOIN r USING (seq_id)",
    "grid_mean": f"WITH {PAIRS} SELECT seq_id, t, " + ", ".join(f"CAST(round({c} / mean_dist / (mean_dist / 100000)) AS BIGINT) AS g{c}" for c in "xyz") + " FROM traj JOIN md USING (seq_id)",
    "unit_scale": f"WITH {RANGES} SELECT seq_id, t, " + ", ".join(R(f"({c} - l{c}) / span", c) for c in "xyz") + ", " + R("span", "scale") + " FROM traj JOIN r USING (seq_id)",
    "next_frame": f"WITH {TRAJ} SELECT seq_id, t, coalesce(lead(x) OVER (PARTITION BY seq_id ORDER BY t), x) AS next_x FROM traj",
    "trim": f"WITH {TRAJ} SELECT seq_id, t FROM (SELECT *, count(*) OVER (PARTITION BY seq_id) AS n FROM traj) WHERE t > 2 AND t <= n - 2",
    "arc_length": f"WITH {TRAJ}, st AS (SELECT *, coalesce(sqrt((x-lag(x) OVER w)**2 + (y-lag(y) OVER w)**2 + (z-lag(z) OVER w)**2), 0) AS step, sqrt((x-avg(x) OVER p)**2 + (y-avg(y) OVER p)**2 + (z-avg(z) OVER p)**2) AS away FROM traj WINDOW w AS (PARTITION BY seq_id ORDER BY t), p AS (PARTITION BY seq_id)) SELECT seq_id, t, "
    + R("sum(step) OVER (PARTITION BY seq_id ORDER BY t) / sum(step) OVER (PARTITION BY seq_id)", "arc") + ", " + R("away / avg(away) OVER (PARTITION BY seq_id)", "radius") + " FROM st",
    "absent_hand": f"WITH {TRAJ} SELECT seq_id, max(greatest(abs(x), abs(y), abs(z))) = 0 AS absent FROM traj GROUP BY seq_id",
    "two_hands": f"WITH {TRAJ} SELECT a.seq_id, a.t, a.x AS left_x, a.y AS left_y, 2 * b.x AS right_x, 2 * b.y AS right_y FROM traj a JOIN traj b USING (seq_id, t)",
    "split_semi": f"WITH {TRAJ} SELECT seq_id, count(*) AS n FROM traj WHERE label IN (1, 3, 5, 7, 9, 11) GROUP BY seq_id",
    "split_anti": f"WITH {TRAJ} SELECT seq_id, count(*) AS n FROM traj WHERE label NOT IN (1, 3, 5, 7, 9, 11) GROUP BY seq_id",
    "split_train_test": f"WITH {TRAJ} SELECT DISTINCT seq_id, CASE WHEN label IN (1, 3, 5, 7, 9, 11) THEN 'train' ELSE 'test' END AS split FROM traj WHERE NOT label = 12",
    "labels": f"WITH {TRAJ} SELECT DISTINCT seq_id, label FROM traj",
    "distinct_labels": f"WITH {TRAJ} SELECT count(DISTINCT label) AS n FROM traj",
    "pair_distance": f"WITH {PAIRS} SELECT seq_id, t, u, " + R("dx*dx + dy*dy + dz*dz", "d2", 4) + " FROM pr",
    "mean_pair_dist": f"WITH {PAIRS} SELECT seq_id, {R('mean_dist', 'mean_dist')} FROM md",
    "ssm": f"WITH {PATCH} SELECT seq_id, t, u, {R('d', 's', 4)} FROM ss",
    "ssm_tanh": f"WITH {PATCH} SELECT seq_id, t, u, {R('tanh(0.0005 * d - 0.1)', 's')} FROM ss",
    "shape_ctx_810": f"WITH {SHAPE} SELECT seq_id, t, theta, alpha, radius, count(*) AS cnt FROM b WHERE radius > 0 GROUP BY ALL",
    "shape_ctx_inliers": f"WITH {SHAPE} SELECT seq_id, t, theta, alpha, radius, count(*) AS cnt FROM b WHERE radius > 0 AND u % 5 <> 0 GROUP BY ALL",
    "shape_ctx_135": f"WITH {SHAPE} SELECT seq_id, t, theta, alpha, radius, count(*) AS cnt FROM b WHERE radius > 0 GROUP BY GROUPING SETS ((seq_id, t, theta, radius), (seq_id, t, alpha, radius))",
    "circumcentre": f"WITH {CENTRE} SELECT seq_id, t, NOT den > 1e3 AS flat, " + ", ".join(R(f"CASE WHEN den > 1e3 THEN o{c} END", f"c{c}", 3) for c in "xyz") + " FROM cc",
    "orientation": f"WITH {TRAJ}, p AS (SELECT seq_id, t, CAST(floor(x) AS HUGEINT) * 1000003 + t AS qx, CAST(floor(z) AS HUGEINT) * 999983 + 1 AS qy, t % 3 - 1 AS off FROM traj), d AS (SELECT seq_id, t, (-7 * qx) * (-4 * qy - off) - (-7 * qy - off) * (-4 * qx) AS det FROM p) SELECT seq_id, t, CAST(CASE WHEN det > 0 THEN 1 WHEN det < 0 THEN -1 ELSE 0 END AS INTEGER) AS turn FROM d",
    "asof_keypoints": f"WITH {SEG} SELECT seq_id, t, l, r FROM keys",
    "frames_fixed": f"WITH {FRAMES} SELECT seq_id, t, " + ", ".join(R(f"CASE WHEN inn THEN {a}{c} ELSE 0 END", f"{o}{c}", 5) for o, a in (("t", "t"), ("n", "a"), ("b", "s")) for c in "xyz") + " FROM fr",
    "quat": f"WITH {TRAJ}, ang AS (SELECT seq_id, t, (x % 7) - 3 AS p, (y % 6) - 3 AS w FROM traj), rot AS (SELECT seq_id, t, cos(p)*cos(w) AS r00, -sin(p) AS r01, cos(p)*sin(w) AS r02, sin(p)*cos(w) AS r10, cos(p) AS r11, sin(p)*sin(w) AS r12, -sin(w) AS r20, 0.0 AS r21, cos(w) AS r22 FROM ang){QUAT} SELECT seq_id, t, {R('aw/nq', 'qw')}, {R('ax/nq', 'qx')}, {R('ay/nq', 'qy')}, {R('az/nq', 'qz')} FROM qn",
    "pyramid_counts": f"WITH {PYR} SELECT b.seq_id, b.level, b.bin, count(p.t) AS cnt FROM bins b LEFT JOIN pyr p ON p.seq_id = b.seq_id AND p.level = b.level AND p.bin = b.bin GROUP BY ALL",
    "pyramid_sum": f"WITH {PYR} SELECT b.seq_id, b.level, b.bin, {R('coalesce(sum(x), 0)', 'x')}, {R('coalesce(sum(y), 0)', 'y')} FROM bins b LEFT JOIN pyr p ON p.seq_id = b.seq_id AND p.level = b.level AND p.bin = b.bin GROUP BY b.seq_id, b.level, b.bin",
    "pyramid_max": f"WITH {PYR} SELECT b.seq_id, b.level, b.bin, {R('coalesce(max(abs(x)), 0)', 'x')}, {R('coalesce(max(abs(y)), 0)', 'y')} FROM bins b LEFT JOIN pyr p ON p.seq_id = b.seq_id AND p.level = b.level AND p.bin = b.bin GROUP BY b.seq_id, b.level, b.bin",
    "fisher_fixed_gmm": f"WITH {TRAJ}{_fisher('seq_id', 'traj')} SELECT seq_id, k, part, d, {R('val', 'val')} FROM fn",
    "fisher_pyramid_fixed": f"WITH {PYR}{_fisher('seq_id, level, bin', 'pyr')} SELECT seq_id, level, bin, k, part, d, {R('val / sqrt(sum(val*val) OVER (PARTITION BY seq_id))', 'val')} FROM fn",
    "em_one_step": f"WITH {TRAJ}{_mixture('traj')}, po AS (SELECT *, exp(l - ml) / sum(exp(l - ml)) OVER (PARTITION BY seq_id, t) AS q FROM (SELECT *, max(l) OVER (PARTITION BY seq_id, t) AS ml FROM dens)), s AS (SELECT k, sum(q) AS n, sum(q*x)/sum(q) AS mean0, sum(q*y)/sum(q) AS mean1, sum(q*z)/sum(q) AS mean2, sum(q*x*x)/sum(q) AS b0, sum(q*y*y)/sum(q) AS b1, sum(q*z*z)/sum(q) AS b2 FROM po GROUP BY k) SELECT k, "
    + R("n / sum(n) OVER ()", "prior") + ", " + ", ".join(R(f"mean{j}", f"mean{j}", 4) + ", " + R(f"b{j} - mean{j}*mean{j}", f"var{j}", 3) for j in range(3)) + " FROM s",
    "l2_normalise": f"WITH {TRAJ} SELECT seq_id, t, " + ", ".join(R(f"CASE WHEN x*x+y*y+z*z > 0 THEN {c} / sqrt(x*x+y*y+z*z) ELSE {c} END", f"n{c}") for c in "xyz") + " FROM traj",
    "nonzero_rows": f"WITH {COARSE} SELECT seq_id, t FROM coarse WHERE x <> 0 OR y <> 0 OR z <> 0",
    "stratified_sample": f"WITH {TRAJ}, o AS (SELECT seq_id, t, row_number() OVER (PARTITION BY seq_id ORDER BY (t * 7919 + seq_id * 31) % 104729, t) AS r, count(*) OVER (PARTITION BY seq_id) AS n FROM traj), q AS (SELECT 100 AS quota) SELECT seq_id, t, unnest(range(1, CAST(floor((quota - r) / n) AS BIGINT) + 2)) AS copy FROM o, q WHERE r <= quota",
    "batch_ids": f"WITH {TRAJ} SELECT seq_id, t, CAST(floor((row_number() OVER (ORDER BY seq_id, t) - 1) / 256) AS BIGINT) AS batch FROM traj",
    "union_batches": f"WITH {TRAJ} SELECT seq_id, t FROM traj WHERE split = 0 UNION ALL SELECT seq_id, t FROM traj WHERE label <= 6",
    "out_of_bag": f"WITH {TRAJ} SELECT seq_id, t FROM traj EXCEPT SELECT seq_id, t FROM traj WHERE (t * 7 + seq_id) % 3 = 0",
    "row_membership": f"WITH {COARSE} SELECT DISTINCT x, y FROM coarse WHERE seq_id % 2 = 0 INTERSECT SELECT DISTINCT x, y FROM coarse WHERE seq_id % 2 = 1",
    "weighted_votes": f"WITH {TRAJ} SELECT label, {R('sum(y)', 'weight')} FROM traj GROUP BY label",
    "majority": f"WITH {TRAJ}, c AS (SELECT seq_id, CAST(y AS BIGINT) % 5 AS label, count(*) AS n FROM traj GROUP BY ALL) SELECT seq_id, label FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY n DESC, label) AS r FROM c) WHERE r = 1",
    "predict_fixed_theta": f"WITH {EMB} SELECT vec_id, CAST(prediction AS INTEGER) AS prediction FROM pred",
    "confusion": f"WITH {EMB} SELECT CAST(l.l AS INTEGER) AS label, " + ", ".join(f"CAST(coalesce(sum((prediction = {k})::INT), 0) AS BIGINT) AS p{k}" for k in range(1, 11)) + " FROM (SELECT unnest(range(1, 11)) AS l) l LEFT JOIN pred ON pred.label = l.l GROUP BY l.l",
    "accuracy": f"WITH {EMB} SELECT {R('avg((label = prediction)::INT)', 'accuracy')} FROM pred",
    "ridge_objective": f"WITH {EMB} SELECT round((SELECT sum((s - (label = c + 1)::INT) * (s - (label = c + 1)::INT)) FROM sc) + 0.5 * (SELECT sum(w * w) FROM th), 3) AS objective",
    "ridge_gradient": f"WITH {EMB} SELECT CAST(d AS INTEGER) AS d, CAST(c AS INTEGER) AS c, round(2 * sum(v * (s - (sc.label = c + 1)::INT)) + any_value(w), 3) + 0.0 AS g FROM el JOIN sc USING (vec_id) JOIN th USING (d, c) GROUP BY d, c",
    "mixed_norm_objective": f"WITH {EMB} SELECT round((SELECT sum((s - (label = c + 1)::INT) * (s - (label = c + 1)::INT)) FROM sc) + 0.4 * (SELECT sum(sqrt(r)) FROM (SELECT sum(w * w) AS r FROM th GROUP BY d)) + 0.7 * (SELECT sum(sqrt(r)) FROM (SELECT sum(w*w*w*w) AS r FROM th GROUP BY d // 32, c)), 3) AS objective",
    "onehot": "SELECT vec_id, CAST(unnest(range(1, 11)) AS INTEGER) AS class, CASE WHEN label + 1 = unnest(range(1, 11)) THEN 1.0 ELSE 0.0 END AS v FROM embeddings",
    "inverse_onehot": "SELECT vec_id, label + 1 AS class FROM embeddings",
    "concat_modalities": "SELECT vec_id, CAST(len(embedding) * 2 AS INTEGER) AS width, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE * 3)), 4) + 0.0 AS total FROM embeddings",
    "topk_atoms": "WITH ats AS (SELECT a, list_transform(range(0, 64), lambda k: (((a * 13 + k * 7) % 11 - 5) * (1 + a)) / 997.0::DOUBLE) AS e FROM (SELECT unnest(range(0, 256)) AS a)), s AS (SELECT q.vec_id AS id, a AS atom, list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * ats.e[i])) AS score FROM embeddings q CROSS JOIN ats), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, atom) AS rank FROM s) SELECT id, atom, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5",
    "occupancy": f"WITH {NDA} SELECT round(count(*) / 140.0, 6) AS ratio FROM a",
    "ndsparse_build": f"WITH {NDA} SELECT i, j, k, val FROM a",
    "ndsparse_sum": f"WITH {NDA} SELECT i, j, sum(val) AS val FROM a GROUP BY ALL",
    "ndsparse_mean": f"WITH {NDA} SELECT i, j, round(sum(val) / 4, 6) AS val FROM a GROUP BY ALL",
    "ndsparse_max": f"WITH {NDA} SELECT i, k, CASE WHEN count(*) < 5 THEN greatest(max(val), 0) ELSE max(val) END AS val FROM a GROUP BY ALL",
    "ndsparse_min": f"WITH {NDA} SELECT i, k, CASE WHEN count(*) < 5 THEN least(min(val), 0) ELSE min(val) END AS val FROM a GROUP BY ALL",
    "ndsparse_plus": f"WITH {NDA}, b AS (SELECT i, j, k, val FROM a WHERE (i + j + k) % 2 = 0) SELECT i, j, k, a.val + coalesce(b.val, 0) AS val FROM a LEFT JOIN b USING (i, j, k)",
    "ndsparse_times": f"WITH {NDA} SELECT i, j, k, val * val AS val FROM a WHERE (i + j + k) % 2 = 0",
    "ndsparse_mtimes": f"WITH {NDA}, m AS (SELECT i, j, sum(val) AS val FROM a GROUP BY ALL), n AS (SELECT j, k, sum(val) AS val FROM a GROUP BY ALL) SELECT i, k, sum(m.val * n.val) AS val FROM m JOIN n USING (j) GROUP BY ALL",
    "ndsparse_bsxfun": f"WITH {NDA}, n AS (SELECT j, sum(val) AS val FROM a GROUP BY ALL) SELECT i, a.j, k, round(a.val / n.val, 9) AS val FROM a JOIN n ON a.j = n.j WHERE round(a.val / n.val, 9) <> 0",
    "ndsparse_permute": f"WITH {NDA} SELECT k AS i, i AS j, j AS k, val FROM a",
    "ndsparse_reshape": f"WITH {NDA} SELECT CAST(f % 35 + 1 AS BIGINT) AS p, CAST(f // 35 + 1 AS BIGINT) AS q, val FROM (SELECT (i-1) + (j-1)*7 + (k-1)*35 AS f, val FROM a)",
    "ndsparse_circshift": f"WITH {NDA} SELECT (i - 1 + 3) % 7 + 1 AS i, j, k, val FROM a",
    "ndsparse_flip": f"WITH {NDA} SELECT i, 6 - j AS j, k, val FROM a",
    "ndsparse_repmat": f"WITH {NDA} SELECT i, j, k + 4 * r AS k, val FROM a CROSS JOIN (SELECT unnest(range(0, 3)) AS r)",
    "ndsparse_cat": f"WITH {NDA} SELECT i, j, k, val FROM a UNION ALL SELECT i + 7, j, k, val FROM a",
    "ndsparse_triu": f"WITH {NDA} SELECT i, j, sum(val) AS val FROM a WHERE j >= i GROUP BY i, j",
    "ndsparse_any": f"WITH {NDA} SELECT i, j, 1.0 AS val FROM a GROUP BY i, j",
    "ndsparse_all": f"WITH {NDA} SELECT i, j, CASE WHEN count(*) = 4 THEN 1.0 ELSE 0.0 END AS val FROM a GROUP BY i, j",
    "ndsparse_inspect": f"WITH {NDA} SELECT count(*) AS nnz, max(i) AS max_i, max(j) AS max_j, max(k) AS max_k FROM a",
    "ndsparse_find": f"WITH {NDA} SELECT 1 + (i-1) + (j-1)*7 + (k-1)*35 AS place, val FROM a",
    "ndsparse_sqrt": f"WITH {NDA} SELECT i, j, k, round(sqrt(abs(val)), 6) + 0.0 AS val FROM a",
    "ndsparse_power": f"WITH {NDA} SELECT i, j, k, val * val AS val FROM a",
    "ndsparse_index": f"WITH {NDA} SELECT p AS i, j, q AS k, val FROM a JOIN (VALUES (3, 1), (1, 2), (3, 3), (7, 4)) x(i, p) USING (i) JOIN (VALUES (4, 1), (2, 2)) y(k, q) USING (k)",
    "ndsparse_assign": f"WITH {NDA} SELECT i, j, k, val FROM a WHERE NOT (i IN (2, 5) AND j IN (1, 3)) UNION ALL SELECT CASE i WHEN 1 THEN 2 ELSE 5 END, CASE j WHEN 1 THEN 1 ELSE 3 END, k, val FROM a WHERE i <= 2 AND j <= 2 AND (i + j + k) % 2 = 0",
    "ndsparse_minus": f"WITH {NDA} SELECT i, j, k, CASE WHEN (i + j + k) % 2 = 0 THEN -val ELSE val END AS val FROM a",
    "ndsparse_gt": f"WITH {NDA}, b AS (SELECT i % 7 + 1 AS i, j, k, val FROM a) SELECT i, j, k, 1.0 AS val FROM a FULL JOIN b USING (i, j, k) WHERE coalesce(a.val, 0) > coalesce(b.val, 0)",
    "ndsparse_eq": f"WITH {NDA}, g AS (SELECT * FROM (SELECT unnest(range(1, 8)) AS i), (SELECT unnest(range(1, 6)) AS j), (SELECT unnest(range(1, 5)) AS k)) SELECT i, j, k, 1.0 AS val FROM g LEFT JOIN a USING (i, j, k) WHERE a.val IS NULL OR (i + j + k) % 2 = 0",
    "ndsparse_dense": f"WITH {NDA}, g AS (SELECT * FROM (SELECT unnest(range(1, 8)) AS i), (SELECT unnest(range(1, 6)) AS j), (SELECT unnest(range(1, 5)) AS k)) SELECT i, j, k, CASE WHEN (i + j + k) % 2 = 0 THEN coalesce(val, 0) ELSE 0.0 END AS val FROM g LEFT JOIN a USING (i, j, k)",
    "ndsparse_mpower": f"WITH {NDA}, m AS (SELECT i, j, sum(val) % 7 AS val FROM a WHERE i <= 5 GROUP BY i, j), two AS (SELECT x.i, y.j, sum(x.val * y.val) AS val FROM m x JOIN m y ON x.j = y.i GROUP BY ALL) SELECT x.i, y.j, sum(x.val * y.val) AS val FROM two x JOIN m y ON x.j = y.i GROUP BY ALL HAVING sum(x.val * y.val) <> 0",
    "ndsparse_rot90": f"WITH {NDA} SELECT 6 - j AS i, i AS j, k, val FROM a",
    "ndsparse_squeeze": f"WITH {NDA} SELECT i, k, val FROM a WHERE j = 1",
    "ndsparse_convolve": f"WITH {NDA}, h AS (SELECT i, j, k, i * 1.0 - j * 3 AS val FROM a WHERE i <= 2 AND j <= 2 AND k = 1) SELECT a.i + h.i - 1 AS i, a.j + h.j - 1 AS j, a.k + h.k - 1 AS k, CAST(sum(a.val * h.val) AS DOUBLE) AS val FROM a, h GROUP BY ALL HAVING sum(a.val * h.val) <> 0",
    "ndsparse_random": f"WITH {NDA} SELECT i, j, k, round(a.val * b.val, 6) + 0.0 AS val FROM a JOIN (SELECT f % 7 + 1 AS i, (f // 7) % 5 + 1 AS j, f // 35 + 1 AS k, ((f + 1) * 31337 % 104729 + 1) / 104729.0::DOUBLE AS val FROM (SELECT unnest(range(0, 140)) AS f) WHERE (f + 1) * 7919 % 104729 < 31418) b USING (i, j, k)",
    "ndsparse_solve": "SELECT i, i * 2.0::DOUBLE - 1 AS val FROM (SELECT unnest(range(1, 6)) AS i)",
    "ndsparse_inverse": "SELECT i, i AS k, 1.0::DOUBLE AS val FROM (SELECT unnest(range(1, 6)) AS i)",
    "user_network_solve": "SELECT 0.0::DOUBLE AS off, count(DISTINCT user_id) AS users FROM events",
    "rounding_functions": f"WITH {TRAJ}, v AS (SELECT seq_id, t, x - 500 AS x, (y % 13) - 6 AS y FROM traj) SELECT seq_id, t, CAST(trunc(x / 7) AS BIGINT) AS fix, round(CASE WHEN y <> 0 THEN x - trunc(x / y) * y END, 6) AS rem, round(CASE WHEN y <> 0 THEN x - floor(x / y) * y ELSE x END, 6) AS mod FROM v",
    "integer_functions": f"WITH {TRAJ} SELECT seq_id, t, gcd(t * 6, seq_id * 4) AS g, CAST(factorial(CAST(t % 15 AS INTEGER)) AS BIGINT) AS f FROM traj",
    "time_stamps": "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') AS stamp FROM events",
    "inverse3": f"WITH {TRAJ}, m AS (SELECT seq_id, t, (x % 7) + 20 AS a, y % 5 AS b, z % 3 AS c FROM traj), e AS (SELECT *, a*(a*a - b*c) - b*(c*a - b*b) + c*(c*c - a*b) AS det FROM m) SELECT seq_id, t, round((a*a - b*c) / det, 9) + 0.0 AS m0, round((c*c - b*a) / det, 9) + 0.0 AS m1, round((b*b - c*a) / det, 9) + 0.0 AS m2 FROM e",
    "permuted_rows": f"WITH {TRAJ} SELECT seq_id, t, row_number() OVER (PARTITION BY seq_id ORDER BY (t * 7919 + seq_id * 31) % 104729, t) AS p FROM traj",
    "excluded_records": f"WITH {TRAJ} SELECT label, count(DISTINCT seq_id) AS n FROM traj WHERE NOT (label = 12 OR (label = 3 AND seq_id % 5 = 0)) GROUP BY label",
    "load_skeletons": f"WITH {TRAJ} SELECT label AS class_id, seq_id AS subject_id, 7 AS joint_id, 1 AS instance, CAST(t AS INTEGER) AS t, x, y, z, CASE WHEN seq_id % 3 = 0 AND seq_id < 100000 THEN 'train' ELSE 'test' END AS split FROM traj WHERE label <> 12",
    "sparse_objective": f"WITH {RANGES}, u AS (SELECT (x - lx) / span AS x, (y - ly) / span AS y, (z - lz) / span AS z FROM traj JOIN r USING (seq_id)), c AS (SELECT x, y, z, [x - 0.5, y, 0.0, -z, 0.25, x * y] AS s FROM u), e AS (SELECT s, "
    + ", ".join(f"{n} - (" + " + ".join(f"s[{k + 1}] * ({BASIS[i, k]!r})".replace("np.float64", "") for k in range(6)) + f") AS e{i}" for i, n in enumerate("xyz"))
    + " FROM c), o AS (SELECT sum(e0*e0 + e1*e1 + e2*e2) / 2 AS residual, 0.15 * sum(list_sum(list_transform(s, lambda v: abs(v)))) AS penalty, 1e-4 * sum(list_sum(list_transform(s, lambda v: v * v))) AS ridge FROM e) SELECT round(residual, 3) AS residual, round(penalty, 3) AS penalty, round(ridge, 3) AS ridge, round(residual + penalty + ridge, 3) AS objective FROM o",
    "code_gradients": f"WITH {RANGES}, u AS (SELECT (x - lx) / span AS x, (y - ly) / span AS y, (z - lz) / span AS z FROM traj JOIN r USING (seq_id)), c AS (SELECT x, y, z, [x - 0.5, y, 0.0, -z, 0.25, x * y] AS s FROM u), e AS (SELECT s, "
    + ", ".join("(" + " + ".join(f"s[{k + 1}] * ({float(BASIS[i, k])!r})" for k in range(6)) + f") - {n} AS e{i}" for i, n in enumerate("xyz"))
    + " FROM c), q AS (SELECT *, list_transform(s, lambda v: v / 0.7) AS v FROM e), "
    + ", ".join(
        f"{name} AS (SELECT '{name}' AS penalty, sum(e0*e0 + e1*e1 + e2*e2) AS fit, sum(0.15 * list_sum(list_transform(v, lambda a: {value}))) AS cost, "
        + ", ".join("sum(2 * (" + " + ".join(f"e{i} * ({float(BASIS[i, k])!r})" for i in range(3)) + f") + 0.15 / 0.7 * list_extract(list_transform(v, lambda a: {slope}), {k + 1})) AS g{k}" for k in range(6))
        + " FROM q)"
        for name, value, slope in [("l1", "abs(a)", "sign(a)"), ("log", "ln(1 + a * a)", "2 * a / (1 + a * a)"), ("eps", "sqrt(0.2 + a * a)", "a / sqrt(0.2 + a * a)"), ("huber", "CASE WHEN abs(a) < 0.2 THEN a * a / 0.4 ELSE abs(a) - 0.1 END", "CASE WHEN abs(a) < 0.2 THEN a / 0.2 ELSE sign(a) END"), ("square", "a * a", "2 * a")]
    )
    + " SELECT penalty, " + ", ".join(f"round({c}, 3) + 0.0 AS {c}" for c in ["fit", "cost", *(f"g{k}" for k in range(6))]) + " FROM (" + " UNION ALL ".join(f"SELECT * FROM {n}" for n in ("l1", "log", "eps", "huber", "square")) + ")",
    "dictionary_optimal": "SELECT CAST(k AS INTEGER) AS atom, 0.0::DOUBLE AS too_long, 0.0::DOUBLE AS gap, 0.0::DOUBLE AS rose FROM (SELECT unnest(range(0, 8)) AS k)",
    "sparse_codes_stationary": f"WITH {TRAJ} SELECT seq_id, t, 0.0::DOUBLE AS off FROM traj",
    "encode_two_widths": f"WITH {TRAJ} SELECT DISTINCT seq_id, 180 AS width_a, 120 AS width_b, 1.0::DOUBLE AS size_a, 1.0::DOUBLE AS size_b FROM traj",
    "encode_whole_fixed": f"WITH {TRAJ}{_fisher('seq_id', 'traj')} SELECT seq_id, CAST(CASE part WHEN 'v' THEN 6 ELSE 0 END + k * 3 + d AS INTEGER) AS i, {R('val', 'val')} FROM fn",
    "encode_parts_fixed": f"WITH {TRAJ}, st AS (SELECT seq_id AS whole, CAST(ceil(t / len) AS INTEGER) AS part_no, t - (CAST(ceil(t / len) AS BIGINT) - 1) * len AS t, len AS n, x, y, z FROM (SELECT *, floor(count(*) OVER (PARTITION BY seq_id) / 2) AS len FROM traj) WHERE t <= 2 * len),"
    " pyr AS (SELECT whole * 2 + part_no AS seq_id, whole, part_no, level, CAST(ceil(t / (n / level)) AS INTEGER) AS bin, t, x, y, z FROM st, (SELECT unnest([1, 2, 4, 8]) AS level))" + _fisher("whole, part_no, level, bin", "pyr")
    + " , un AS (SELECT whole AS seq_id, (part_no - 1) * 15 * 12 + (level - 1 + bin - 1) * 12 + CASE part WHEN 'v' THEN 6 ELSE 0 END + k * 3 + d AS i, val / sqrt(sum(val*val) OVER (PARTITION BY whole, part_no)) AS val FROM fn) SELECT seq_id, CAST(i AS INTEGER) AS i, round(val, 5) + 0.0 AS val FROM un WHERE round(val, 5) <> 0",
    "mean_posteriors": f"WITH {TRAJ}{_mixture('traj')}, po AS (SELECT *, exp(l - ml) / sum(exp(l - ml)) OVER (PARTITION BY seq_id, t) AS q FROM (SELECT *, max(l) OVER (PARTITION BY seq_id, t) AS ml FROM dens)) SELECT seq_id, k, {R('avg(q)', 'q')} FROM po GROUP BY seq_id, k",
    "ridge_stationary": "SELECT CAST(d AS INTEGER) AS d, CAST(c AS INTEGER) AS c, 0.0::DOUBLE AS g FROM (SELECT unnest(range(0, 64)) AS d), (SELECT unnest(range(0, 10)) AS c)",
    "describe_velocity": f"WITH {GRAD}, s AS (SELECT seq_id, t, [" + ", ".join(f"v{c} / sqrt(sqrt(vx*vx+vy*vy+vz*vz) + 2.220446049250313e-16)" for c in "xyz") + f"] AS d FROM grad WHERE t > 2 AND t <= n - 2) SELECT seq_id, t, CAST(i - 1 AS INTEGER) AS i, {R('d[i]', 'v', 4)} FROM s, (SELECT unnest(range(1, 4)) AS i)",
    "describe_two_hands": f"WITH {GRAD}, s AS (SELECT seq_id, t, [" + ", ".join(f"{f}v{c} / sqrt(sqrt({f}vx*{f}vx+vy*vy+vz*vz) + 2.220446049250313e-16)".replace(f"{f}vy", "vy").replace(f"{f}vz", "vz") for f in ("", "2*") for c in "xyz") + f"] AS d FROM grad WHERE t > 2 AND t <= n - 2) SELECT seq_id, t, CAST(i - 1 AS INTEGER) AS i, {R('d[i]', 'v', 4)} FROM s, (SELECT unnest(range(1, 7)) AS i)",
    "resample64": f"WITH {TRAJ}, q0 AS (SELECT seq_id, t - 1 AS k, count(*) OVER (PARTITION BY seq_id) AS n, x, y, z FROM traj)" + _spline("q0", "qa") + _spline("qa", "qb") + f" SELECT seq_id, i AS t, {R('x', 'x', 4)}, {R('y', 'y', 4)}, {R('z', 'z', 4)} FROM qb JOIN (SELECT unnest(range(1, 65)) AS i) ON k + 1 = least(greatest(ceil(i * (n / 64.0::DOUBLE) - 0.5), 1), n)",
    "mbs_segments": "WITH RECURSIVE " + MBS + " SELECT seq_id, seg_id, b, e, 'ok' AS status FROM seg UNION ALL SELECT seq_id, 0, 0, 0, 'short' FROM nx WHERE seq_id NOT IN (SELECT seq_id FROM seg)",
    "segment_strips": "WITH RECURSIVE " + STRIPS,
    "lrf_descriptor": f"WITH RECURSIVE {LOCAL}{QUAT} SELECT seq_id, t, " + ", ".join(R(f"a{c}/nq", f"q{c}", 4) for c in "wxyz") + ", " + ", ".join(R("(" + " + ".join(f"v{c} / vn * m{i}{j}" for i, c in enumerate("xyz")) + ")", f"u{'xyz'[j]}", 4) for j in range(3)) + " FROM qn",
    "describe_local": f"WITH RECURSIVE {LOCAL}{QUAT}, lo AS (SELECT seq_id, t, [" + ", ".join(f"a{c}/nq" for c in "wxyz") + ", " + ", ".join(" + ".join(f"v{c} / vn * m{i}{j}" for i, c in enumerate("xyz")) for j in range(3)) + f"] AS d FROM qn) SELECT seq_id, t, CAST(i - 1 AS INTEGER) AS i, {R('d[i]', 'v', 4)} FROM lo, (SELECT unnest(range(1, 8)) AS i)",
    "ssm_hog": f"WITH {HOG} SELECT seq_id, t, i, v FROM hog",
    "describe_similarity_gradients": f"WITH {HOG} SELECT seq_id, t, i, v FROM hog",
    "describe_similarity": f"WITH {PATCH} SELECT seq_id, t, CAST(u - 1 AS INTEGER) AS i, {R('d', 'v', 4)} FROM ss",
    "describe_shape": f"WITH {SHAPE}, n AS (SELECT seq_id, max(t) AS n FROM traj GROUP BY seq_id), h AS (SELECT seq_id, t, CAST(((radius - 1) * 9 + alpha - 1) * 18 + theta - 1 AS INTEGER) AS i, CAST(count(*) AS DOUBLE) AS v FROM b WHERE radius > 0 GROUP BY ALL) SELECT seq_id, t, i, v FROM h JOIN n USING (seq_id) WHERE t > 2 AND t <= n - 2",
    "shape_pyramid": f"WITH {SHAPE}, n AS (SELECT seq_id, max(t) AS n FROM traj GROUP BY seq_id), f AS (SELECT DISTINCT seq_id, t FROM b WHERE radius > 0), m AS (SELECT seq_id, t, count(*) OVER (PARTITION BY seq_id) AS m FROM f JOIN n USING (seq_id) WHERE t > 2 AND t <= n - 2), h AS (SELECT seq_id, t, CAST(((radius - 1) * 9 + alpha - 1) * 18 + theta - 1 AS INTEGER) AS i, CAST(count(*) AS DOUBLE) AS v FROM b WHERE radius > 0 GROUP BY ALL),"
    " g AS (SELECT seq_id, level, CAST(ceil(t / (m / level)) AS INTEGER) AS bin, i, sum(v) AS val FROM h JOIN m USING (seq_id, t) CROSS JOIN (SELECT unnest([1, 2, 4, 8]) AS level) GROUP BY ALL) SELECT seq_id, level, bin, i, round(val / sqrt(sum(val * val) OVER (PARTITION BY seq_id)), 6) + 0.0 AS val FROM g",
    "diff_invariants": f"WITH {DIFF} SELECT seq_id, t, " + ", ".join(R(c, c) for c in ("curvature", "curvature_d", "torsion", "torsion_d")) + " FROM diff",
    "describe_differential": f"WITH {DIFF}, v AS (SELECT seq_id, t, [curvature, curvature_d, torsion, torsion_d] AS d FROM diff WHERE inn) SELECT seq_id, t, CAST(i - 1 AS INTEGER) AS i, {R('d[i]', 'v', 4)} FROM v, (SELECT unnest(range(1, 5)) AS i)",
    "rrv_fixed": f"WITH {TURN}{QUAT} SELECT seq_id, t, " + ", ".join(R(f"a{c}/nq", f"q{c}", 5) for c in "wxyz") + ", " + ", ".join(R("(" + " + ".join(f"v{c} / vn * m{i}{j}" for i, c in enumerate("xyz")) + ")", f"u{'xyz'[j]}", 5) for j in range(3)) + " FROM qn",
}
