"""Operators on pairs of frames of one sequence: equi-joins on the sequence, never a cross join.

What returns a row a pair joins frames; means and histograms, which do not, work on tiles of frames.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import vector as V
from strandline.operators.sequence import XYZ, spread

TAU = 2 * math.pi


def pairs(df: DataFrame, *names: str) -> DataFrame:
    """All ordered pairs (t, u) of a sequence's frames, the pair of a frame with itself too."""
    names = names or XYZ
    df = spread(df.select("seq_id", "t", *names))
    a = df.select("seq_id", "t", *(F.col(c).alias(f"{c}1") for c in names))
    b = df.select("seq_id", F.col("t").alias("u"), *(F.col(c).alias(f"{c}2") for c in names))
    return a.join(b, "seq_id")


def distances(df: DataFrame, *names: str) -> DataFrame:
    """Squared distance of every pair."""
    names = names or XYZ
    d = [F.col(f"{c}2") - F.col(f"{c}1") for c in names]
    return pairs(df, *names).select("seq_id", "t", "u", V.dot(d, d).alias("d2"))


#: Frames a tile.
TILE = 256


def tile_pairs(df: DataFrame, *names: str, marked: str | None = None) -> DataFrame:
    """All pairs of a sequence's tiles, as two lists of rows each: (seq_id, at, a, b), of structs of t, the coordinates and, if it is named, a
    mark; ``at`` is the number of tile a.

    A tile holds TILE frames at most, and meets each tile of its sequence in a row of its own, dealt by both numbers: pairs of
    frames are formed in numpy within a row, so none is shuffled, and a long sequence is spread over tasks. Rows with a null
    coordinate take no part.
    """
    names = names or XYZ
    d = df.dropna(subset=list(names)).select("seq_id", "t", *names, *([marked] if marked else []))
    t = d.groupBy("seq_id", F.floor((F.col("t") - 1) / TILE).alias("tile")).agg(F.collect_list(F.struct("t", *names, *([marked] if marked else []))).alias("a"))
    n = t.groupBy("seq_id").agg(F.collect_list("tile").alias("tiles"))
    first = t.join(n, "seq_id").select("seq_id", F.col("tile").alias("at"), "a", F.explode("tiles").alias("tile"))
    return first.join(t.withColumnRenamed("a", "b"), ["seq_id", "tile"]).select("seq_id", "at", "a", "b")


def _tile(batch: pa.RecordBatch, name: str, row: int, names: tuple[str, ...]) -> list[np.ndarray]:
    part = batch.column(name).slice(row, 1).flatten()
    return [part.field(n).to_numpy(zero_copy_only=False) for n in names]


def mean_distance(df: DataFrame) -> DataFrame:
    """Mean distance over all ordered pairs, self-pairs too."""

    def run(batches):
        for b in batches:
            total, count = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for k in range(b.num_rows):
                one, two = (_tile(b, c, k, XYZ) for c in "ab")
                total[k] = np.sqrt(sum((q - p[:, None]) ** 2 for p, q in zip(one, two, strict=True))).sum()
                count[k] = len(one[0]) * len(two[0])
            yield pa.RecordBatch.from_arrays([b.column("seq_id"), pa.array(total), pa.array(count)], ["seq_id", "total", "count"])

    p = tile_pairs(df)
    sums = p.mapInArrow(run, T.StructType([p.schema["seq_id"], T.StructField("total", T.DoubleType()), T.StructField("count", T.LongType())]))
    return sums.groupBy("seq_id").agg((F.sum("total") / F.sum("count")).alias("mean_dist"))


def self_similarity(df: DataFrame, beta: float | None = None, c: float = 0.0) -> DataFrame:
    """Distances between patches (arrays), or tanh(beta * distance - c) of them."""
    p = pairs(df, "patch")
    d = F.sqrt(F.aggregate(F.zip_with("patch1", "patch2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return p.select("seq_id", "t", "u", (d if beta is None else F.tanh(F.lit(beta) * d - F.lit(c))).alias("s"))


def shape_bins(df: DataFrame, mean: DataFrame, frames: DataFrame | None = None, theta: int = 18, alpha: int = 9, radii: int = 5, inner: float = 0.125, outer: float = 2.0) -> DataFrame:
    """Angle and radius bins of every pair within the outer radius, in each frame's own axes (rows t, n, b of ``frames``).

    Radius bin ``radii`` is the innermost. An elevation of exactly pi counts in the last bin.
    """
    p = pairs(df).join(mean, "seq_id").filter("mean_dist > 0")
    d = [F.col(f"{c}2") - F.col(f"{c}1") for c in XYZ]
    if frames is not None:
        p = p.join(frames, ["seq_id", "t"])
        m = [[F.col(f"{a}{c}") for c in XYZ] for a in "tnb"]
        det = V.det3(*m)
        # coordinates in the frame's axes: Cramer's rule on axes given as columns
        local = [V.over(V.det3(d, m[1], m[2]), det), V.over(V.det3(m[0], d, m[2]), det), V.over(V.det3(m[0], m[1], d), det)]
        p = p.select("seq_id", "t", "u", "mean_dist", V.norm(d).alias("r"), *(c.alias(n) for c, n in zip(local, ("lx", "ly", "lz"), strict=True)))
    else:
        p = p.select("seq_id", "t", "u", "mean_dist", V.norm(d).alias("r"), *(c.alias(n) for c, n in zip(d, ("lx", "ly", "lz"), strict=True)))
    edges = [inner * (outer / inner) ** (k / (radii - 1)) for k in range(radii)]
    r = sum((F.when(F.col("r") / F.col("mean_dist") < F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    around = F.atan2("ly", "lx")
    around = F.when(around < 0, around + F.lit(TAU)).otherwise(around)
    up = F.atan2(F.sqrt(F.col("lx") * F.col("lx") + F.col("ly") * F.col("ly")), F.col("lz"))
    b = lambda v, width, n: F.least(F.floor(v / F.lit(width)) + 1, F.lit(n)).cast("int")
    return p.select("seq_id", "t", "u", b(around, TAU / theta, theta).alias("theta"), b(up, math.pi / alpha, alpha).alias("alpha"), r.cast("int").alias("radius")).filter("radius > 0")


def shape_context(bins: DataFrame, inliers: DataFrame | None = None) -> DataFrame:
    """Joint histogram of each frame; outliers are not counted but keep their own rows."""
    b = bins if inliers is None else bins.join(inliers.select("seq_id", F.col("t").alias("u")), ["seq_id", "u"], "left_semi")
    return b.groupBy("seq_id", "t", "theta", "alpha", "radius").agg(F.count("*").alias("cnt"))


#: Counts a batch that leaves a task holds, about.
CELLS = 1 << 20


def _shape_tiles(df: DataFrame, mean: DataFrame, inliers: DataFrame | None, theta: int, alpha: int, radii: int, inner: float, outer: float, marginal: bool, packed: bool) -> DataFrame:
    """Histograms of frames by tiles, whole when they leave their task: (seq_id, t, code, cnt), a row a bin, or with ``packed`` a row a
    frame, its bins in two arrays.

    All rows of a tile a come to one task side by side and are added up there, so no bin is shuffled. A code is the place of a joint bin,
    or of a marginal one: (radius, theta) first, then (radius, alpha).
    """
    d = df.select("seq_id", "t", *XYZ)
    if inliers is None:
        d = d.withColumn("own", F.lit(True))
    else:
        d = d.join(inliers.select("seq_id", "t").distinct().withColumn("own", F.lit(True)), ["seq_id", "t"], "left").fillna(False, ["own"])
    edges = [inner * (outer / inner) ** (k / (radii - 1)) for k in range(radii)]
    size = radii * (theta + alpha) if marginal else radii * theta * alpha

    def places(ring, up, around):
        return [ring * theta + around, radii * theta + ring * alpha + up] if marginal else [(ring * alpha + up) * theta + around]

    def counts(one, two, own, mean, frames, n):
        dx, dy, dz = (q[own.astype(bool)] - p[:, None] for p, q in zip(one, two, strict=True))
        with np.errstate(invalid="ignore"):
            r = np.sqrt(dx * dx + dy * dy + dz * dz) / mean
            ring = sum((r < e).astype(np.int64) for e in edges)
        i, j = np.nonzero(ring)
        dx, dy, dz = dx[i, j], dy[i, j], dz[i, j]
        around = np.arctan2(dy, dx)
        around = np.where(around < 0, around + TAU, around)
        up = np.arctan2(np.sqrt(dx * dx + dy * dy), dz)
        cut = lambda v, width, n: np.minimum(np.floor(v / width).astype(np.int64), n - 1)
        at = places(ring[i, j] - 1, cut(up, math.pi / alpha, alpha), cut(around, TAU / theta, theta))
        return sum(np.bincount(frames[i] * size + x, minlength=n * size) for x in at)

    def run(batches):
        held: list[list[np.ndarray]] = [[], [], [], []]
        seqs, key, total, t = [], None, None, None

        def close():
            """The tile's frames, how many bins each has, and these."""
            full = np.flatnonzero(total)
            some, many = np.unique(full // size, return_counts=True)
            seqs.append((key[0], len(some)))
            for h, v in zip(held, (t[some], many, full % size, total[full]), strict=True):
                h.append(v)

        def out():
            frames, many, codes, cnt = (np.concatenate(h) for h in held)
            ids = pa.array([s for s, _ in seqs], kind).take(pa.array(np.repeat(np.arange(len(seqs)), [k for _, k in seqs])))
            if packed:
                at = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
                cells = [pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))) for v in (codes, cnt)]
            else:
                ids, frames = ids.take(pa.array(np.repeat(np.arange(len(frames)), many))), np.repeat(frames, many)
                cells = [pa.array(codes), pa.array(cnt)]
            held[:], seqs[:] = [[], [], [], []], []
            return pa.RecordBatch.from_arrays([ids, pa.array(frames), *cells], ["seq_id", "t", "code", "cnt"])

        kind = None
        for batch in batches:
            kind = batch.column("seq_id").type
            for k, own_key in enumerate(zip(batch.column("seq_id").to_pylist(), batch.column("at").to_pylist(), strict=True)):
                ts, *one = _tile(batch, "a", k, ("t", *XYZ))
                own, *two = _tile(batch, "b", k, ("own", *XYZ))
                ts, frames = np.unique(ts, return_inverse=True)
                found = counts(one, two, own, batch.column("mean_dist")[k].as_py(), frames, len(ts))
                if own_key == key:
                    total += found
                    continue
                if key is not None:
                    close()
                    if sum(map(len, held[2])) > CELLS:
                        yield out()
                key, total, t = own_key, found, ts
        if key is not None:
            close()
            yield out()

    p = tile_pairs(d, marked="own").join(mean.filter("mean_dist > 0"), "seq_id")
    p = spread(p, "seq_id", "at").sortWithinPartitions("seq_id", "at")
    one = lambda t: T.ArrayType(T.IntegerType()) if packed else t
    return p.mapInArrow(run, T.StructType([p.schema["seq_id"], T.StructField("t", T.LongType()), T.StructField("code", one(T.LongType())), T.StructField("cnt", one(T.LongType()))]))


def shape_rows(df: DataFrame, mean: DataFrame, inliers: DataFrame | None = None, theta: int = 18, alpha: int = 9, radii: int = 5, inner: float = 0.125, outer: float = 2.0) -> DataFrame:
    """shape_histogram with a row a frame: (seq_id, t, code array, cnt array), a code the place ((radius - 1) * alphas + alpha - 1) * thetas + theta - 1
    of a bin that is not empty. A frame without one has no row.
    """
    return _shape_tiles(df, mean, inliers, theta, alpha, radii, inner, outer, False, True)


def shape_histogram(df: DataFrame, mean: DataFrame, inliers: DataFrame | None = None, theta: int = 18, alpha: int = 9, radii: int = 5, inner: float = 0.125, outer: float = 2.0) -> DataFrame:
    """shape_context of shape_bins without frames, by tiles: (seq_id, t, theta, alpha, radius, cnt)."""
    got, code = _shape_tiles(df, mean, inliers, theta, alpha, radii, inner, outer, False, False), F.col("code")
    return got.select("seq_id", "t", (code % theta + 1).cast("int").alias("theta"), (F.floor(code / theta) % alpha + 1).cast("int").alias("alpha"), (F.floor(code / (theta * alpha)) + 1).cast("int").alias("radius"), "cnt")


def shape_marginals(df: DataFrame, mean: DataFrame, inliers: DataFrame | None = None, theta: int = 18, alpha: int = 9, radii: int = 5, inner: float = 0.125, outer: float = 2.0) -> DataFrame:
    """shape_context_marginals of shape_histogram, counted as such within tiles."""
    got, code = _shape_tiles(df, mean, inliers, theta, alpha, radii, inner, outer, True, False), F.col("code")
    first, rest = code < radii * theta, code - radii * theta
    return got.select(
        "seq_id",
        "t",
        F.when(first, code % theta + 1).cast("int").alias("theta"),
        F.when(~first, rest % alpha + 1).cast("int").alias("alpha"),
        F.when(first, F.floor(code / theta) + 1).otherwise(F.floor(rest / alpha) + 1).cast("int").alias("radius"),
        "cnt",
    )


def shape_context_marginals(bins: DataFrame) -> DataFrame:
    """Two histograms, (theta, radius) and (alpha, radius), by grouping sets in one pass over pairs' bins or a joint histogram."""
    k, theta, alpha, radius = [F.col("seq_id"), F.col("t")], F.col("theta"), F.col("alpha"), F.col("radius")
    count = F.sum("cnt") if "cnt" in bins.columns else F.count("*")
    return bins.groupingSets([[*k, theta, radius], [*k, alpha, radius]], *k, theta, alpha, radius).agg(count.alias("cnt"))
