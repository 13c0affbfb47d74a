"""One entry for all descriptors: (seq_id, t, d array<double>), two frames trimmed at either end."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators import encoding, integral, pairwise, segmentation, sequence

METHODS = ("local", "differential", "integral", "velocity", "similarity", "similarity_gradients", "shape")


def describe(df: DataFrame, method: str) -> DataFrame:
    """An absent hand (all zeros) has a descriptor of zeros where the method needs no frame; null entries are degenerate."""
    if method == "local":
        d = segmentation.local_descriptor(df)
        return d.select("seq_id", "t", F.array("qw", "qx", "qy", "qz", "ux", "uy", "uz").alias("d"))
    if method == "differential":
        d = sequence.differential_invariants(df).select("seq_id", "t", F.array("curvature", "curvature_d", "torsion", "torsion_d").alias("d"))
    elif method == "integral":
        d = integral.integral_invariants(df).select("seq_id", "t", F.array("osculating", "rectifying").alias("d"))
    elif method == "velocity":
        d = sequence.square_root_velocity(df).select("seq_id", "t", F.array("sx", "sy", "sz").alias("d"))
    elif method in ("similarity", "similarity_gradients"):
        p = sequence.patches(df, 2, *sequence.XYZ)
        if method == "similarity_gradients":
            return integral.path_gradients(p).select("seq_id", "t", F.col("hog").alias("d"))
        s = pairwise.self_similarity(p)
        return s.groupBy("seq_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("u", "s"))), lambda x: x["s"]).alias("d"))
    elif method == "shape":
        return _dense(sequence.trim(pairwise.shape_rows(df, pairwise.mean_distance(df))), 810)
    else:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    return sequence.trim(d)


def _dense(rows: DataFrame, size: int) -> DataFrame:
    """(seq_id, t, code array, cnt array) -> (seq_id, t, d), of ``size`` numbers."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                code, cnt = part.column("code"), part.column("cnt")
                many = np.diff(code.offsets.to_numpy())
                d = np.zeros((part.num_rows, size))
                d[np.repeat(np.arange(len(d)), many), code.flatten().to_numpy()] = cnt.flatten().to_numpy()
                at = pa.array(np.arange(len(d) + 1, dtype=np.int32) * size)
                yield pa.RecordBatch.from_arrays([part.column("seq_id"), part.column("t"), pa.ListArray.from_arrays(at, pa.array(d.ravel()))], ["seq_id", "t", "d"])

    return rows.mapInArrow(run, T.StructType([rows.schema["seq_id"], rows.schema["t"], T.StructField("d", T.ArrayType(T.DoubleType()))]))


def two_hands(left: DataFrame, right: DataFrame, method: str) -> DataFrame:
    """Both hands' descriptors of a frame, one after the other."""
    r = describe(right, method).select("seq_id", "t", F.col("d").alias("_r"))
    return describe(left, method).join(r, ["seq_id", "t"]).select("seq_id", "t", F.concat("d", "_r").alias("d"))


def shape_pyramid(df: DataFrame, guard: bool = False) -> DataFrame:
    """Summed shape contexts of every pyramid bin, in long form, and the sequence's unit length. Only bins that are not empty have rows, so no length is
    zero, with ``guard`` or without.

    Frames come with all their bins in a row, are sorted by sequence, and are added up as they pass: no bin is shuffled or joined.
    """
    size, levels = 810, encoding.LEVELS
    rows = sequence.trim(pairwise.shape_rows(df, pairwise.mean_distance(df))).withColumn("_n", F.count("*").over(sequence.whole()))

    def sums(seq: np.ndarray, t: np.ndarray, n: np.ndarray, part: pa.RecordBatch, more: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """(seq, level, bin, code, cnt) of the rows and of ``more``, added up and in order; seq numbers the sequences from 0."""
        many = np.diff(part.column("code").offsets.to_numpy())
        code, cnt = part.column("code").flatten().to_numpy(), part.column("cnt").flatten().to_numpy()
        each = [(np.repeat(seq, many), np.repeat(np.full(len(t), p), many), np.repeat(np.ceil(t / (n / p)).astype(np.int64), many), code, cnt) for p in levels]
        seq, level, bin_, code, cnt = (np.concatenate(v) for v in zip(*each, more, strict=True))
        place, width = np.unique((level << 40) + bin_, return_inverse=True)
        total = np.bincount((seq * len(place) + width) * size + code, weights=cnt)
        full = np.flatnonzero(total)
        at = place[full // size % len(place)]
        return full // (size * len(place)), at >> 40, at & ((1 << 40) - 1), full % size, total[full]

    def run(batches):
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        key, left = None, none

        def out(ids, seq, level, bin_, code, val):
            square = np.bincount(seq, weights=val * val)
            with np.errstate(invalid="ignore", divide="ignore"):
                val = val / np.sqrt(square)[seq]
            ids = pa.array(ids, kind).take(pa.array(seq))
            return pa.RecordBatch.from_arrays([ids, *(pa.array(v.astype(np.int32)) for v in (level, bin_, code)), pa.array(val)], ["seq_id", "level", "bin", "i", "val"])

        for b in batches:
            kind = b.column("seq_id").type
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                ids = part.column("seq_id").to_pylist()
                new = np.array([i > 0 and ids[i] != ids[i - 1] for i in range(len(ids))])
                seq = np.cumsum(new)
                firsts = [ids[0], *(ids[i] for i in np.flatnonzero(new))]
                if len(left[0]) and key != ids[0]:
                    yield out([key], *left)
                    left = none
                got = sums(seq, part.column("t").to_numpy(), part.column("_n").to_numpy(), part, left)
                # the last sequence may go on
                key, last = ids[-1], got[0] == seq[-1]
                left = (np.zeros(last.sum(), np.int64), *(v[last] for v in got[1:]))
                if not last.all():
                    yield out(firsts, *(v[~last] for v in got))
        if len(left[0]):
            yield out([key], *left)

    rows = rows.sortWithinPartitions("seq_id")
    return rows.mapInArrow(run, T.StructType([rows.schema["seq_id"], *(T.StructField(c, T.IntegerType()) for c in ("level", "bin", "i")), T.StructField("val", T.DoubleType())]))


def velocity_pyramid(df: DataFrame, ends: int = 0) -> DataFrame:
    """Square-root velocities of the sequence at unit scale, summed in every pyramid bin, and the whole code of unit length:
    (seq_id, level, bin, sx, sy, sz).

    ``ends`` rows at either end are left out after velocities are taken. A sequence that never moves, or has no row left, is all zeros.
    Rows are added up once, in the finest bins, and all is dealt by sequence: no row is copied a level, and no bin is joined.
    """
    s, finest = ["sx", "sy", "sz"], max(encoding.LEVELS)
    v = sequence.square_root_velocity(sequence.unit_scale(df))
    v = v.withColumn("_all", F.count("*").over(sequence.whole()))
    v = v.withColumn("_own", (F.col("t") > ends) & (F.col("t") <= F.col("_all") - ends))
    v = v.withColumn("_n", F.count_if("_own").over(sequence.whole()))
    # a bin of a level is a run of the finest one's, as each level halves the bins of the one before; a row of no bin still names its sequence
    bin_ = F.ceil((F.col("t") - ends) / (F.col("_n") / finest)).cast("int")
    v = v.withColumn("_b", F.when(F.col("_own") & F.col("sz").isNotNull() & ~F.isnan("sz"), bin_))
    v = v.groupBy("seq_id", "_b").agg(*(F.sum(k).alias(k) for k in s)).groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("_b", *s))).alias("_c"))
    every = F.array(*(F.struct(F.lit(p).alias("level"), F.lit(i).alias("bin")) for p in encoding.LEVELS for i in range(1, p + 1)))
    c = v.select("seq_id", "_c", F.explode(every).alias("_e")).select("seq_id", "_e.level", "_e.bin", "_c")
    own = F.filter("_c", lambda x: F.ceil(x["_b"] * F.col("level") / finest) == F.col("bin"))
    total = lambda k: F.aggregate("_own", F.lit(0.0), lambda a, x: a + F.coalesce(x[k], F.lit(0.0)))
    c = c.select("seq_id", "level", "bin", own.alias("_own")).select("seq_id", "level", "bin", *(F.nanvl(total(k), F.lit(0.0)).alias(k) for k in s))
    size = F.sqrt(F.sum(sum(F.col(k) * F.col(k) for k in s)).over(W.partitionBy("seq_id")))
    return c.withColumn("_size", size).select("seq_id", "level", "bin", *(F.when(F.col("_size") > 0, F.col(k) / F.col("_size")).otherwise(0.0).alias(k) for k in s))


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """Rows in a fixed pseudo-random order of their content: a sort key, not a draw, so that a repeated task gives the same rows."""
    return df.withColumn("shuffle_key", F.xxhash64(F.lit(seed), *df.columns))
