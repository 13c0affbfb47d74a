"""Local frames and the rotation-and-velocity descriptor."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import vector as V
from strandline.operators.sequence import XYZ, gradient, order, trim, whole

AXES = [f"{a}{c}" for a in "tnb" for c in XYZ]


#: Products and differences of doubles in a 2 x 2 determinant err by less than this share of the products' sizes.
_ERROR = (3 + 16 * 2.0**-53) * 2.0**-53


def _exact_turn(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, cx: pd.Series, cy: pd.Series) -> pd.Series:
    """The sign in rational arithmetic, where the rows are not null."""
    rows = pd.concat([ax, ay, bx, by, cx, cy], axis=1)
    there = np.isfinite(rows.to_numpy(float)).all(axis=1)
    out = pd.Series(pd.array([None] * len(rows), dtype="Int32"))
    for k in np.flatnonzero(there):
        x, y, p, q, u, v = map(Fraction, rows.iloc[k].tolist())
        d = (x - u) * (q - v) - (y - v) * (p - u)
        out.iloc[k] = (d > 0) - (d < 0)
    return out


def turn(a: list[Column], b: list[Column], c: list[Column]) -> Column:
    """1, 0 or -1: three points of the plane turn left, are on a line, or turn right; always the right sign.

    The determinant in doubles decides where it exceeds its error bound, as it does for all but nearly collinear points; only rows
    that it leaves open are worked out exactly, in Arrow batches in which all others are null. Null where a coordinate is null or not finite.
    """
    left, right = (a[0] - c[0]) * (b[1] - c[1]), (a[1] - c[1]) * (b[0] - c[0])
    det, size = left - right, F.abs(left) + F.abs(right)
    # products near the smallest doubles have no such bound; infinite ones compare with nothing
    sure = (size > 1e-280) & (size < 1e300) & (F.abs(det) > size * F.lit(_ERROR))
    open_ = F.coalesce(~sure, F.lit(True))
    exact = F.pandas_udf(_exact_turn, T.IntegerType())
    return F.coalesce(F.when(sure, F.signum(det).cast("int")), exact(*(F.when(open_, v.cast("double")) for v in (*a, *b, *c))))


def fixed_segments(df: DataFrame, length: int = 9, step: int = 4) -> DataFrame:
    """Overlapping segments of fixed length: (seq_id, seg_id, b, e)."""
    n = df.groupBy("seq_id").agg(F.max("t").alias("n"))
    s = n.select("seq_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / step))).alias("k"))
    return s.select("seq_id", (F.col("k") + 1).alias("seg_id"), (F.col("k") * step + 1).alias("b"), F.least(F.col("k") * step + length, F.col("n")).cast("long").alias("e"))


def key_points(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Each frame's left key, the begin of the first segment that ends at or after it, and right key, the end of
    the last segment that begins at or before it: an as-of lookup by order. Frames and segments' ends are put in one
    order a sequence, and a running least begin and largest end pass over them; no frame meets a segment it does not need.
    """
    none = F.lit(None).cast("long")
    row = lambda d, at, b, e, kind: d.select("seq_id", F.col(at).cast("long").alias("t"), b.alias("b"), e.alias("e"), F.lit(kind).alias("frame"))
    ends = row(segments, "e", F.col("b").cast("long"), none, False).unionByName(row(segments, "b", none, F.col("e").cast("long"), False))
    every = row(df, "t", none, none, True).unionByName(ends)
    # a segment counts for a frame at its own end, so it comes before the frame in both orders
    down, up = W.partitionBy("seq_id").orderBy(F.col("t").desc(), "frame"), W.partitionBy("seq_id").orderBy("t", "frame")
    ran = lambda w: w.rowsBetween(W.unboundedPreceding, 0)
    every = every.select("seq_id", "t", "frame", F.min("b").over(ran(down)).alias("l"), F.max("e").over(ran(up)).alias("r"))
    known = every.withColumn("some", F.max(~F.col("frame")).over(W.partitionBy("seq_id")))
    return known.filter("frame and some").select("seq_id", "t", "l", "r")


def _beside(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Frames that have both key points, with them (lx.., rx..) and the sequence's number of rows n.

    A frame asks at its keys' places; points and askers of a sequence are put in one order of places, in which a point answers those beside
    it, and a frame's point and answers are added up again. All of it is dealt by sequence, so no step but the first deals anew.
    """
    none, own = F.lit(None).cast("double"), F.col("t").cast("long")
    pts = df.select("seq_id", own.alias("at"), F.lit(0).alias("side"), own.alias("t"), *XYZ)
    asks = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(c).cast("long").alias("at")) for k, c in enumerate(("l", "r"), 1))))
    asks = keys.select("seq_id", F.col("t").cast("long").alias("t"), asks.alias("a")).select("seq_id", "a.at", "a.side", "t", *(none.alias(c) for c in XYZ))
    place = W.partitionBy("seq_id").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    point = F.struct("at", *XYZ)
    every = pts.unionByName(asks).withColumn("_n", F.sum((F.col("side") == 0).cast("long")).over(whole()))
    every = every.withColumn("_p", F.last(F.when(F.col("side") == 0, point), ignorenulls=True).over(place))
    every = every.filter(F.col("_p.at") == F.col("at"))
    named = lambda k, c: F.max(F.when(F.col("side") == k, F.col(f"_p.{c}")))
    got = every.groupBy("seq_id", "t").agg(F.first("_n").alias("n"), F.count("*").alias("_sides"), *(named(k, c).alias(f"{s}{c}") for k, s in enumerate(("", "l", "r")) for c in XYZ))
    return got.filter("_sides = 3").drop("_sides")


def frames(df: DataFrame, keys: DataFrame, points: bool = False) -> DataFrame:
    """Tangent, normal and binormal of each inner frame from its key points' circumcircle; zero for two rows at
    either end, and null (status degenerate) where the three points are on a line. With ``points`` the frame's own point comes along.
    """
    d = _beside(df, keys)
    p, q, o = V.cols("lx", "ly", "lz"), V.cols("rx", "ry", "rz"), V.cols(*XYZ)
    step = lambda df, **v: df.select("*", *(c.alias(f"_{n}{x}") for n, e in v.items() for c, x in zip(e, XYZ, strict=True)))
    own = lambda n: V.cols(*(f"_{n}{x}" for x in XYZ))
    # each step names what the next one reads several times
    d = step(d, u=V.sub(o, p), w=V.sub(q, p), f=V.sub(q, o))
    d = step(d, c=V.circumcentre([F.lit(0.0)] * 3, own("u"), own("w")), g=V.unit(own("u")), h=V.unit(own("f")))
    d = step(d, i=V.sub(own("c"), own("u")), e=V.cross(own("g"), own("h")))
    d = d.select("seq_id", "t", "n", *(c.alias(f"a{x}") for c, x in zip(V.unit(own("i")), XYZ, strict=True)), *(c.alias(f"c{x}") for c, x in zip(V.unit(own("e")), XYZ, strict=True)), *XYZ)
    nrm, bin_ = V.cols("ax", "ay", "az"), V.cols("cx", "cy", "cz")
    inner = (F.col("t") >= 3) & (F.col("t") <= F.col("n") - 2)
    full = [*V.cross(nrm, bin_), *nrm, *bin_]
    bad = inner & full[0].isNull()
    return d.select("seq_id", "t", *(F.when(inner, c).otherwise(0.0).alias(a) for c, a in zip(full, AXES, strict=True)), F.when(bad, "degenerate").when(inner, "ok").otherwise("border").alias("status"), *(XYZ if points else ()))


def rotation_velocity(df: DataFrame, frame: DataFrame) -> DataFrame:
    """Seven numbers a frame: quaternion of the turn to the next frame, and the velocity's square root in it.

    Rows at the ends are trimmed before velocities are taken; degenerate frames give null. Frames of every row that bring their points are not
    joined with them.
    """
    if set(XYZ) <= set(frame.columns):
        f = trim(frame.select("seq_id", "t", *AXES, *XYZ))
    else:
        f = trim(frame.select("seq_id", "t", *AXES)).join(trim(df.select("seq_id", "t", *XYZ)), ["seq_id", "t"])
    f = gradient(f, *XYZ)
    f = f.withColumns({f"_{a}": F.coalesce(F.lead(a).over(order()), F.when(F.lead("t").over(order()).isNull(), F.col(a))) for a in AXES})
    # matrices whose columns are the three axes
    rows = lambda p: [[F.col(f"{p}{a}{c}") for a in "tnb"] for c in XYZ]
    m = V.right_divide(rows("_"), rows(""))
    f = f.select("seq_id", "t", "vx", "vy", "vz", *(m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)))
    m = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    q = V.quaternion([[m[j][i] for j in range(3)] for i in range(3)])
    v = V.square_root_velocity(V.cols("vx", "vy", "vz"))
    out = [*q, *(V.dot(v, [m[i][j] for i in range(3)]) for j in range(3))]
    return f.select("seq_id", "t", *(c.alias(n) for c, n in zip(out, ("qw", "qx", "qy", "qz", "ux", "uy", "uz"), strict=True)))
