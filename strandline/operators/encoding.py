"""Temporal pyramids, mixture models, Fisher vectors, sampling and sparse codes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import vector as V
from strandline.operators.dictionary import by_signs, dual_basis, feature_sign
from strandline.operators.sequence import whole
from strandline.session import stored

LEVELS = (1, 2, 4, 8)


def pyramid(df: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Each frame once a level, in bin ceil(t / (n / level)) of its sequence."""
    d = df.withColumn("_n", F.count("*").over(whole())).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    return d.withColumn("bin", F.ceil(F.col("t") / (F.col("_n") / F.col("level"))).cast("int")).drop("_n")


def all_bins(df: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Every bin of every sequence, empty ones too."""
    b = F.array(*(F.struct(F.lit(p).alias("level"), F.lit(i).alias("bin")) for p in levels for i in range(1, p + 1)))
    return df.select("seq_id").distinct().select("seq_id", F.explode(b).alias("b")).select("seq_id", "b.level", "b.bin")


def pool(df: DataFrame, how: str, *names: str, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """count, sum, or max of absolute values a bin; empty bins are zero. Frames whose last feature is NaN are left out."""
    p = pyramid(df, levels)
    if how == "count":
        agg = [F.count("*").alias("cnt")]
    else:
        p = p.filter(F.col(names[-1]).isNotNull() & ~F.isnan(names[-1]))
        agg = [(F.sum(c) if how == "sum" else F.max(F.abs(F.col(c)))).alias(c) for c in names]
    got = p.groupBy("seq_id", "level", "bin").agg(*agg)
    return all_bins(df, levels).join(got, ["seq_id", "level", "bin"], "left").fillna(0)


def drop_zero(df: DataFrame, *names: str) -> DataFrame:
    """Rows with a coordinate that is a number other than zero."""
    any_ = F.lit(False)
    for c in names:
        any_ = any_ | (F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) != 0))
    return df.filter(any_)


def stratified_sample(df: DataFrame, total: int, sequences: int | None = None, a: int = 7919, m: int = 104729) -> DataFrame:
    """round(total / sequences) rows of each sequence in a fixed pseudo-random order; short ones repeat in cycles."""
    if total <= 0:
        raise ValueError("total must be positive")
    n = sequences or df.select("seq_id").distinct().count()
    quota = int(math.floor(total / n + 0.5)) if n else 0
    if quota < 1:
        raise ValueError("the quota of a sequence rounds to zero")
    key = (F.col("t") * a + F.col("seq_id") * 31) % m
    d = df.withColumn("_r", F.row_number().over(W.partitionBy("seq_id").orderBy(key, "t"))).withColumn("_n", F.count("*").over(whole()))
    copies = F.floor((F.lit(quota) - F.col("_r")) / F.col("_n")) + 1
    d = d.filter(F.col("_r") <= quota).withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    return d.drop("_r", "_n")


def fill_to_quota(df: DataFrame, total: int, *names: str, most: int = 20) -> DataFrame:
    """Samples without zero rows until there are total rows; stops with an error after ``most`` passes."""
    sequences = df.select("seq_id").distinct().count()
    total = max(total, sequences)  # a row a sequence at least
    out, have = None, 0
    for k in range(most):
        # a pass is worked out once: it is counted, and read by all that learns from it, as it was written
        batch = stored(drop_zero(stratified_sample(df, total, sequences, a=7919 + 2 * k), *names), "sample")
        got = batch.count()
        out, have = batch if out is None else out.unionByName(batch), have + got
        if have >= total:
            return out
        if not got:
            break
    raise ValueError("the sample cannot be filled: all rows are zero")


Mixture = list[tuple[float, list[float], list[float]]]


def _matrix(batch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])


def _leaves(batch, names: list[str]) -> list[pa.Array]:
    """Columns, structs as their fields."""
    out, stack = [], [batch.column(c) for c in reversed(names)]
    while stack:
        c = stack.pop()
        if pa.types.is_struct(c.type):
            stack += reversed(c.flatten())
        else:
            out.append(c)
    return out


def _posteriors(x: np.ndarray, gmm: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """Rows times components, and each row's log-likelihood."""
    prior, mean, var = (np.array(c, float) for c in zip(*gmm, strict=True))
    logs = np.log(prior) - 0.5 * np.log(2 * np.pi * var).sum(1)
    logs = logs[None, :] - 0.5 * ((x**2) @ (1 / var).T - 2 * x @ (mean / var).T + (mean**2 / var).sum(1))
    top = logs.max(1, keepdims=True)
    q = np.exp(logs - top)
    total = q.sum(1, keepdims=True)
    return q / total, (top + np.log(total))[:, 0]


def posteriors(df: DataFrame, names: list[str], gmm: Mixture, floor: float = 0.0) -> DataFrame:
    """Frames times components, in long form: k and q."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                q, _ = _posteriors(_matrix(part, names), gmm)
                q[q < floor] = 0.0
                rows = part.take(pa.array(np.repeat(np.arange(len(q)), len(gmm))))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.tile(np.arange(len(gmm), dtype=np.int32), len(q))), pa.array(q.ravel())], [*rows.schema.names, "k", "q"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("k", T.IntegerType()), T.StructField("q", T.DoubleType())]))


def moments(df: DataFrame, names: list[str], gmm: Mixture, by: list[str], floor: float = 0.0) -> DataFrame:
    """(by, k): n rows, sums of q, of q z and of q z^2 for z = (x - mean) / deviation, and of the log-likelihood once a group.

    The mixture goes to the tasks as arrays. Each batch is summed by group and component before the shuffle.
    """
    width = 2 + 2 * len(names)

    def run(batches):
        mean, dev = np.array([m for _, m, _ in gmm], float), np.sqrt(np.array([v for _, _, v in gmm], float))
        for b in batches:
            if not b.num_rows:
                continue
            group = np.zeros(b.num_rows, np.int64)
            for c in _leaves(b, by):  # each column's codes, mixed into one number
                codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                group = np.unique(group * (codes.max() + 1) + codes, return_inverse=True)[1]
            n = int(group.max()) + 1
            first = np.full(n, b.num_rows)
            np.minimum.at(first, group, np.arange(b.num_rows))
            order = np.argsort(group, kind="stable")
            start = np.searchsorted(group[order], np.arange(n))
            x = _matrix(b, names)
            q, ll = _posteriors(x, gmm)
            q[q < floor] = 0.0
            sums = np.empty((n, len(gmm), width))
            sums[:, :, 0] = np.add.reduceat(ll[order], start)[:, None]
            sums[:, :, 1] = np.add.reduceat(q[order], start)
            for k in range(len(gmm)):
                z = (x - mean[k]) / dev[k]
                sums[:, k, 2 : 2 + len(names)] = np.add.reduceat((q[:, k : k + 1] * z)[order], start)
                sums[:, k, 2 + len(names) :] = np.add.reduceat((q[:, k : k + 1] * z * z)[order], start)
            count = np.diff(np.append(start, b.num_rows))
            rows = b.select(by).take(pa.array(np.repeat(first, len(gmm)))).columns if by else []
            yield pa.RecordBatch.from_arrays([*rows, pa.array(np.tile(np.arange(len(gmm), dtype=np.int32), n)), pa.array(np.repeat(count, len(gmm))), pa.array(list(sums.reshape(-1, width)), pa.list_(pa.float64()))], [*by, "k", "n", "s"])

    schema = T.StructType([*(df.schema[c] for c in by), T.StructField("k", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.DoubleType()))])
    part = df.select(*by, *names).mapInArrow(run, schema)
    cells = ["ll", "q", *(f"u{j}" for j in range(len(names))), *(f"v{j}" for j in range(len(names)))]
    return part.groupBy(*by, "k").agg(F.sum("n").alias("n"), *(F.sum(F.get("s", F.lit(i))).alias(c) for i, c in enumerate(cells)))


def fisher(df: DataFrame, names: list[str], gmm: Mixture, by: list[str]) -> DataFrame:
    """Improved Fisher vector of each group in long form: (by, part u or v, k, d, val), signed root and unit length."""
    sums = moments(df, names, gmm, by, 1e-6)
    w = F.get(F.lit([p for p, _, _ in gmm]), "k")
    dims = range(len(names))
    cells = F.array(*(F.struct(F.lit("u").alias("part"), F.lit(j).alias("d"), (F.col(f"u{j}") / (F.col("n") * F.sqrt(w))).alias("val")) for j in dims), *(F.struct(F.lit("v").alias("part"), F.lit(j).alias("d"), ((F.col(f"v{j}") - F.col("q")) / (F.col("n") * F.sqrt(2 * w))).alias("val")) for j in dims))
    r = sums.select(*by, "k", F.explode(cells).alias("c")).select(*by, "k", "c.*")
    r = r.withColumn("val", F.signum("val") * F.sqrt(F.abs("val")))
    size = F.sqrt(F.sum(F.col("val") * F.col("val")).over(W.partitionBy(*by)))
    return r.withColumn("val", F.col("val") / F.greatest(size, F.lit(1e-12)))


def fisher_pyramid(df: DataFrame, names: list[str], gmm: list, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Fisher vector of every bin, then unit length a sequence; bins without frames have no rows and stand for zeros."""
    f = fisher(pyramid(df.filter(F.col(names[-1]).isNotNull() & ~F.isnan(names[-1])), levels), names, gmm, ["seq_id", "level", "bin"])
    n = F.sqrt(F.sum(F.col("val") * F.col("val")).over(W.partitionBy("seq_id")))
    return f.withColumn("val", F.when(n > 0, F.col("val") / n).otherwise(0.0))


def em_step(df: DataFrame, names: list[str], gmm: Mixture, floor: float = 1e-6) -> DataFrame:
    """One pass: k, prior, mean and variance of each dimension, and the log-likelihood before the pass."""
    s = moments(df, names, gmm, [])
    mean, var = ([F.get(F.lit([float(c[i][j]) for c in gmm]), "k") for j in range(len(names))] for i in (1, 2))
    z = [V.over(F.col(f"u{j}"), F.col("q")) for j in range(len(names))]
    square = [V.over(F.col(f"v{j}"), F.col("q")) for j in range(len(names))]
    return s.select("k", (F.col("q") / F.sum("q").over(W.partitionBy())).alias("prior"), *((mean[j] + z[j] * F.sqrt(var[j])).alias(f"mean{j}") for j in range(len(names))), *(F.greatest((square[j] - z[j] * z[j]) * var[j], F.lit(floor)).alias(f"var{j}") for j in range(len(names))), "ll")


#: Rows a block of packed rows.
BLOCK = 8192


def _blocks(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows as blocks of up to BLOCK: (rows binary), float64, a row after the other; a pass over them converts none."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(_matrix(b.slice(lo, BLOCK), names)).tobytes()], pa.binary())], ["rows"])

    return df.select(*names).mapInArrow(run, "rows binary")


def _block_step(blocks: DataFrame, dims: int, gmm: Mixture, floor: float) -> tuple[Mixture, float]:
    """em_step on blocks, the same sums: one row of numbers a task, added by place. Components without rows go."""
    k = len(gmm)

    def run(batches):
        mean, dev = np.array([m for _, m, _ in gmm], float), np.sqrt(np.array([v for _, _, v in gmm], float))
        total = np.zeros(1 + k + 2 * k * dims)
        for b in batches:
            for rows in b.column("rows"):
                block = np.frombuffer(rows.as_buffer(), float).reshape(-1, dims)
                for lo in range(0, len(block), 2048):
                    x = block[lo : lo + 2048]
                    q, ll = _posteriors(x, gmm)
                    z = [(x[:, j : j + 1] - mean[:, j]) / dev[:, j] for j in range(dims)]
                    total += np.concatenate([[ll.sum()], q.sum(0), *((q * v).sum(0) for v in z), *((q * v * v).sum(0) for v in z)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    got = blocks.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(1 + k + 2 * k * dims)
    total[[r["i"] for r in got]] = [r["v"] for r in got]
    q, (u, v) = total[1 : 1 + k], total[1 + k :].reshape(2, dims, k)
    out = []
    for c in np.flatnonzero(q != 0):
        m, var, z = gmm[c][1], gmm[c][2], u[:, c] / q[c]
        out.append((max(float(q[c] / q.sum()), 1e-12), [float(m[j] + z[j] * math.sqrt(var[j])) for j in range(dims)], [max(float((v[j, c] / q[c] - z[j] * z[j]) * var[j]), floor) for j in range(dims)]))
    return out, float(total[0])


def fit_gmm(df: DataFrame, names: list[str], k: int, iterations: int = 100, seed: int = 240925, tol: float = 1e-6, floor: float = 1e-6) -> tuple[Mixture, list[float]]:
    """Diagonal mixture by EM: components and the log-likelihood of each round. The rows are worked out once, to blocks; a round is one
    pass over these, and only k rows of sums reach the driver.
    """
    history: list[float] = []
    rows = stored(df.select(*names), "mixture-rows")
    blocks = _blocks(rows, names).persist()
    try:
        start = rows.distinct().orderBy(F.xxhash64(F.lit(seed), *names), *names).limit(k).collect()
        var = rows.agg(*(F.var_pop(c).alias(c) for c in names)).first()
        spread = [max(var[c] or 0.0, floor) for c in names]
        gmm = [(1 / len(start), [float(r[c]) for c in names], list(spread)) for r in start]
        for _ in range(iterations):
            gmm, ll = _block_step(blocks, len(names), gmm, floor)
            history.append(ll)
            if len(history) > 1 and abs(history[-1] - history[-2]) <= tol * abs(history[-2]):
                break
    finally:
        blocks.unpersist()
    return gmm, history


def save_gmm(spark: SparkSession, gmm: Mixture, path: str) -> None:
    """The mixture as a table: k, prior, mean, var."""
    spark.createDataFrame([(k, float(p), list(map(float, m)), list(map(float, v))) for k, (p, m, v) in enumerate(gmm)], "k int, prior double, mean array<double>, var array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_gmm(spark: SparkSession, path: str) -> Mixture:
    return [(r["prior"], list(r["mean"]), list(r["var"])) for r in spark.read.parquet(path).orderBy("k").collect()]


def pca(df: DataFrame, names: list[str], ratio: float = 0.98) -> np.ndarray:
    """Directions (columns) whose cumulative share of the variance is under ratio; from one pass, products of rows summed in the tasks."""
    d = len(names)

    def sums(batches):
        total = np.zeros(1 + d + d * d)
        for b in batches:
            if b.num_rows:
                x = _matrix(b, names)
                total += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    got = df.select(*names).dropna().mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    v = np.array([r["v"] for r in got])
    if not len(v) or v[0] == 0:
        return np.zeros((d, 0))
    mean = v[1 : 1 + d] / v[0]
    c = v[1 + d :].reshape(d, d) / v[0] - np.outer(mean, mean)
    w, v = np.linalg.eigh(c)
    w, v = w[::-1], v[:, ::-1]
    v = v * np.sign(v[np.abs(v).argmax(0), range(d)])
    return v[:, np.cumsum(w) / w.sum() < ratio]


def project(df: DataFrame, names: list[str], directions: np.ndarray) -> DataFrame:
    """Uncentred coordinates on directions, as pc0, pc1, ..., a product a batch."""
    new = [f"pc{k}" for k in range(directions.shape[1])]

    def run(batches):
        for b in batches:
            x = _matrix(b, names) @ directions
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in x.T)], [*b.schema.names, *new])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in new)]))


def encode(df: DataFrame, names: list[str], k: int = 4, samples: int = 2000, parts: int = 2, levels: tuple[int, ...] = LEVELS, gmm: Mixture | None = None, ratio: float | None = None, iterations: int = 20) -> DataFrame:
    """The whole encoder: sample, mixture, and a Fisher pyramid of each of ``parts`` equal stretches of a sequence.

    Rows that do not fill a stretch are dropped. Codes are arrays ordered by stretch, level, bin, u then v, component and dimension.
    A mixture that is given is not fitted again. With ``ratio`` the columns are projected on the principal directions that
    hold that share of the variance.
    """
    sample, df = None, df.select("seq_id", "t", *names)
    if ratio is not None:
        sample = fill_to_quota(df, samples, *names)
        directions = pca(sample, names, ratio)
        if not directions.shape[1]:
            raise ValueError("no direction is under the ratio")
        new = [f"pc{j}" for j in range(directions.shape[1])]
        df, sample, names = project(df, names, directions), project(sample, names, directions), new
    if gmm is None:
        gmm, _ = fit_gmm(sample if sample is not None else fill_to_quota(df, samples, *names), names, k, iterations)
    return _stretch_codes(df, names, gmm, parts, levels)


#: Numbers of sums that a task holds at once, about.
SUMS = 1 << 22


def _stretch_codes(df: DataFrame, names: list[str], gmm: Mixture, parts: int, levels: tuple[int, ...]) -> DataFrame:
    """(seq_id, code): fisher_pyramid of every stretch, laid out as encode says, of unit length a stretch.

    Frames are dealt by sequence and sorted, once; a task adds up a sequence's bins as its frames pass, so only frames are shuffled and only
    whole codes leave. Of a sequence that is longer than a batch it holds the sums.
    """
    n = F.floor(F.count("*").over(whole()) / parts)
    d = df.select("seq_id", "t", *names).withColumn("_len", n).filter((F.col("_len") > 0) & F.col(names[-1]).isNotNull() & ~F.isnan(names[-1]))
    d = d.withColumn("part_no", F.ceil(F.col("t") / F.col("_len"))).filter(F.col("part_no") <= parts)
    d = d.withColumn("_n", F.count("*").over(W.partitionBy("seq_id", "part_no")))
    d = d.select("seq_id", "part_no", (F.col("t") - (F.col("part_no") - 1) * F.col("_len")).alias("t"), "_n", *names).sortWithinPartitions("seq_id")
    k, dims, bins = len(gmm), len(names), sum(levels)
    first = dict(zip(levels, np.cumsum([0, *levels[:-1]]).tolist(), strict=True))
    width = 1 + k * (1 + 2 * dims)  # of a bin: rows, and of each component the sums of q, q z and q z^2

    def sums(b: pa.RecordBatch, seq: np.ndarray, many: int) -> np.ndarray:
        """(sequences, parts * bins, width)"""
        x, t, n = _matrix(b, names), b.column("t").to_numpy(), b.column("_n").to_numpy()
        part = b.column("part_no").to_numpy().astype(np.int64) - 1
        q, _ = _posteriors(x, gmm)
        q[q < 1e-6] = 0.0
        cells = np.empty((len(x), width))
        cells[:, 0], cells[:, 1 : 1 + k] = 1.0, q
        for j in range(dims):
            z = (x[:, j : j + 1] - np.array([m[j] for _, m, _ in gmm])) / np.sqrt([v[j] for _, _, v in gmm])
            cells[:, 1 + k + 2 * j * k : 1 + k + (2 * j + 1) * k] = q * z
            cells[:, 1 + k + (2 * j + 1) * k : 1 + k + (2 * j + 2) * k] = q * z * z
        out = np.zeros((many * parts * bins, width))
        for p in levels:
            # a frame beyond the last bin, as missing ones leave, belongs to it
            place = (seq * parts + part) * bins + first[p] + np.minimum(np.ceil(t / (n / p)).astype(np.int64), p) - 1
            order = np.argsort(place, kind="stable")
            full, start = np.unique(place[order], return_index=True)
            out[full] += np.add.reduceat(cells[order], start)
        return out.reshape(many, parts * bins, width)

    def codes(s: np.ndarray) -> np.ndarray:
        w, count, q = np.array([p for p, _, _ in gmm]), s[..., 0], s[..., 1 : 1 + k]
        uv = s[..., 1 + k :].reshape(*s.shape[:2], dims, 2, k)
        with np.errstate(invalid="ignore", divide="ignore"):
            u = uv[..., 0, :] / (count[..., None, None] * np.sqrt(w))
            v = (uv[..., 1, :] - q[..., None, :]) / (count[..., None, None] * np.sqrt(2 * w))
        val = np.stack([u, v], axis=2).swapaxes(3, 4).reshape(*s.shape[:2], -1)
        val = np.where(count[..., None] > 0, np.sign(val) * np.sqrt(np.abs(val)), 0.0)
        val /= np.maximum(np.sqrt((val * val).sum(2, keepdims=True)), 1e-12)
        val = val.reshape(len(s), parts, -1)
        size = np.sqrt((val * val).sum(2, keepdims=True))
        return np.divide(val, size, out=np.zeros_like(val), where=size > 0).reshape(len(s), -1)

    def run(batches):
        key, left, kind = None, None, None
        step = max(64, min(4096, SUMS // (parts * bins * width)))

        def out(ids, s):
            for lo in range(0, len(ids), 256):
                c = codes(s[lo : lo + 256])
                at = pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 256], kind), pa.ListArray.from_arrays(at, pa.array(c.ravel()))], ["seq_id", "code"])

        for b in batches:
            kind = b.column("seq_id").type
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                ids = part.column("seq_id").to_pylist()
                new = np.array([i > 0 and ids[i] != ids[i - 1] for i in range(len(ids))])
                seq, firsts = np.cumsum(new), [ids[0], *(ids[i] for i in np.flatnonzero(new))]
                got = sums(part, seq, len(firsts))
                if left is not None and key == ids[0]:
                    got[0] += left
                elif left is not None:
                    yield from out([key], left[None])
                # the last sequence may go on
                key, left = ids[-1], got[-1].copy()
                yield from out(firsts[:-1], got[:-1])
        if left is not None:
            yield from out([key], left[None])

    return d.mapInArrow(run, T.StructType([d.schema["seq_id"], T.StructField("code", T.ArrayType(T.DoubleType()))]))


def encode_two(a: DataFrame, names_a: list[str], b: DataFrame, names_b: list[str], **settings) -> DataFrame:
    """Two modalities of the same sequences, each with a mixture of its own, their codes one after the other; and the first's width.

    Codes are never broadcast, as they would pass through the driver.
    """
    one, two = encode(a, names_a, **settings), encode(b, names_b, **settings).withColumnRenamed("code", "_b")
    return one.hint("merge").join(two.hint("merge"), "seq_id").select("seq_id", F.concat("code", "_b").alias("code"), F.size("code").alias("width"))


def write_batches(codes: DataFrame, path: str, size: int = 256) -> DataFrame:
    """Codes in batches of ``size`` sequences, a folder a batch (batch=0, 1, ...), read back."""
    from strandline.sources.trajectories import batch_ids

    batch_ids(codes, size, "seq_id").write.mode("overwrite").partitionBy("batch").parquet(path)
    return codes.sparkSession.read.parquet(path)


# sparse coding


def l1_quadratic(a: np.ndarray, b: np.ndarray, lam: float, on: np.ndarray | None = None, rounds: int = 50_000) -> np.ndarray:
    """For each row of b: argmin x'Ax/2 + b'x + lam |x|_1 over the coordinates that are ``on``, by coordinate descent to
    convergence. All rows take a coordinate's step at once; rows at rest leave.
    """
    out, rows = np.zeros(b.shape), np.arange(len(b))
    x, g, on = np.zeros(b.shape), b.copy(), np.ones(b.shape, bool) if on is None else on
    for _ in range(rounds):
        moved = np.zeros(len(x))
        for j in range(b.shape[1]):
            r = g[:, j] - a[j, j] * x[:, j]
            step = np.where(on[:, j], -np.sign(r) * np.maximum(np.abs(r) - lam, 0.0) / a[j, j], 0.0) - x[:, j]
            if step.any():
                g += step[:, None] * a[j]
                x[:, j] += step
                moved = np.maximum(moved, np.abs(step))
        rest = moved < 1e-14
        if rest.any():
            out[rows[rest]] = x[rest]
            rows, x, g, on = rows[~rest], x[~rest], g[~rest], on[~rest]
            if not len(rows):
                return out
    out[rows] = x
    return out


def sparse_codes(df: DataFrame, names: list[str], basis: np.ndarray, lam: float = 0.15, beta: float = 1e-4, nearest: int | None = None) -> DataFrame:
    """code: each row's coefficients on the basis' columns; with nearest, only on its k best-matching atoms."""

    def run(batches):
        gram, known = basis.T @ basis + 2 * beta * np.eye(basis.shape[1]), []
        for batch in batches:
            inner, on = _matrix(batch, names) @ basis, None
            if nearest:
                on = np.zeros(inner.shape, bool)
                np.put_along_axis(on, np.argsort(-inner, axis=1, kind="stable")[:, :nearest], True, 1)
            codes = by_signs(gram, -inner, lam, known) if on is None else feature_sign(gram, -inner, lam, on)[0]
            at = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(codes.ravel()))], [*batch.schema.names, "code"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("code", T.ArrayType(T.DoubleType()))]))


def sparse_objective(df: DataFrame, names: list[str], basis: np.ndarray, lam: float, beta: float = 0.0) -> DataFrame:
    """One row for rows with a ``code``: residual |x - B s|^2 / 2, penalty lam |s|_1, ridge beta |s|^2, and their sum."""
    hit = [sum((F.get("code", F.lit(k)) * float(basis[i, k]) for k in range(basis.shape[1])), F.lit(0.0)) for i in range(len(names))]
    off = sum(((F.col(c) - h) * (F.col(c) - h) for c, h in zip(names, hit, strict=True)), F.lit(0.0))
    fold = lambda f: F.aggregate("code", F.lit(0.0), lambda s, x: s + f(x))
    d = df.agg((F.sum(off) / 2).alias("residual"), (lam * F.sum(fold(F.abs))).alias("penalty"), (beta * F.sum(fold(lambda x: x * x))).alias("ridge"))
    return d.withColumn("objective", F.col("residual") + F.col("penalty") + F.col("ridge"))


#: Penalties of a coefficient s (over its scale) and their derivatives; e: where the smooth ones bend.
PENALTIES = {
    "l1": (lambda s, e: F.abs(s), lambda s, e: F.signum(s)),
    "log": (lambda s, e: F.log1p(s * s), lambda s, e: 2 * s / (1 + s * s)),
    "eps": (lambda s, e: F.sqrt(e + s * s), lambda s, e: s / F.sqrt(e + s * s)),
    "huber": (lambda s, e: F.when(F.abs(s) < e, s * s / (2 * e)).otherwise(F.abs(s) - e / 2), lambda s, e: F.when(F.abs(s) < e, s / e).otherwise(F.signum(s))),
    "square": (lambda s, e: s * s, lambda s, e: 2 * s),
}


def code_gradient(df: DataFrame, names: list[str], basis: np.ndarray, penalty: str = "l1", beta: float = 0.15, noise: float = 1.0, sigma: float = 1.0, epsilon: float = 1e-3) -> DataFrame:
    """Rows with a ``code`` get ``fit`` |x - B s|^2 / (2 noise), ``cost`` beta times the penalties of s / sigma, and ``gradient`` of their sum by s.

    The objective of codes is the sum of fit and cost; that of codes on nearest atoms has penalty ``square`` and noise 1/2. A null
    coordinate or code gives nulls. At a coefficient of zero the gradient of ``l1`` is that of the fit alone.
    """
    value, slope = PENALTIES[penalty]
    d = df.withColumn("_off", F.array(*(sum((F.get("code", F.lit(k)) * float(basis[i, k]) for k in range(basis.shape[1])), F.lit(0.0)) - F.col(c) for i, c in enumerate(names))))
    fit = F.aggregate("_off", F.lit(0.0), lambda a, x: a + x * x) / (2 * noise)
    cost = F.aggregate("code", F.lit(0.0), lambda a, x: a + value(x / sigma, epsilon)) * beta
    pull = lambda k: sum((F.get("_off", F.lit(i)) * float(basis[i, k] / noise) for i in range(len(names))), F.lit(0.0))
    gradient = F.array(*(pull(k) + slope(F.get("code", F.lit(k)) / sigma, epsilon) * (beta / sigma) for k in range(basis.shape[1])))
    return d.withColumns({"fit": fit, "cost": cost, "gradient": gradient}).drop("_off")


def _code_sums(rows: DataFrame, names: list[str], basis: np.ndarray, lam: float, beta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """S S', X S', and (|X|^2, |S|_1, |S|^2, rows) for the rows' codes S, which never leave their task; sums are added in the tasks and then by
    place, a number each to the driver.
    """
    atoms = basis.shape[1]

    def sums(batches):
        gram, known = basis.T @ basis + 2 * beta * np.eye(atoms), []
        total = np.zeros(atoms * atoms + len(names) * atoms + 4)
        for b in batches:
            x = _matrix(b, names)
            s = by_signs(gram, -(x @ basis), lam, known)
            total += np.concatenate([(s.T @ s).ravel(), (x.T @ s).ravel(), [(x * x).sum(), np.abs(s).sum(), (s * s).sum(), len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    got = rows.mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    v = np.array([r["v"] for r in sorted(got)])
    return v[: atoms * atoms].reshape(atoms, atoms), v[atoms * atoms : -4].reshape(len(names), atoms), v[-4:]


def learn_basis(df: DataFrame, names: list[str], atoms: int, lam: float = 0.15, rounds: int = 50, seed: int = 1, beta: float = 1e-4, history: list[dict] | None = None) -> np.ndarray:
    """Dictionary with atoms of length at most one: in each round rows get codes by feature-sign search, and atoms come from the Lagrange
    dual of S S' and X S'. ``history`` gets every round's objective a row, before the atoms move, and the atoms' duality gap.
    """
    rng = np.random.default_rng(seed)
    basis = rng.normal(size=(len(names), atoms))
    basis /= np.linalg.norm(basis, axis=0)
    rows = stored(df.select(*names), "basis-rows")
    for _ in range(rounds):
        ss, xs, (xx, s1, s2, n) = _code_sums(rows, names, basis, lam, beta)
        fit = 0.5 * (xx - 2 * (basis * xs).sum() + (basis @ ss * basis).sum())
        basis, gap = dual_basis(ss, xs, basis)
        if history is not None:
            history.append({"objective": (fit + lam * s1 + beta * s2) / max(n, 1), "gap": gap / max(n, 1)})
    return basis


def sparse_pyramid(df: DataFrame, names: list[str], basis: np.ndarray, lam: float = 0.15, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Largest absolute code of every bin, in long form (seq_id, level, bin, atom, val)."""
    c = pyramid(sparse_codes(df.select("seq_id", "t", *names), names, basis, lam), levels)
    c = c.select("seq_id", "level", "bin", F.posexplode("code").alias("atom", "v"))
    return c.groupBy("seq_id", "level", "bin", "atom").agg(F.max(F.abs("v")).alias("val"))


def top_atoms(df: DataFrame, atoms: np.ndarray, k: int) -> DataFrame:
    """The k atoms (rows of a learned dictionary) of largest inner product with each row's v: id, atom, score, rank."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                x = np.asarray(part.column("v").flatten().to_numpy(zero_copy_only=False), float).reshape(part.num_rows, -1)
                scores = x @ atoms.T
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(np.repeat(np.arange(len(x)), best.shape[1]))), pa.array(best.ravel().astype(np.int64)), pa.array(np.take_along_axis(scores, best, 1).ravel()), pa.array(np.tile(np.arange(1, best.shape[1] + 1, dtype=np.int32), len(x)))], ["id", "atom", "score", "rank"])

    return df.select("id", "v").mapInArrow(run, T.StructType([df.schema["id"], T.StructField("atom", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
