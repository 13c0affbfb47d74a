"""Classifiers, objectives, optimisers and evaluation. Data stay distributed; the driver holds weights only.

Features are an array column ``features``, labels integers 1..C in ``label``.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.optimise import minimise
from strandline.session import stored
from strandline.sources.trajectories import batch_ids


def _sums(df: DataFrame, size: int, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the rows' batches of f(X, y), a vector of ``size``: one row a task, added before it reaches the driver."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += f(_rows(b), np.asarray(b.column("label")))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "v"])

    got = df.select("features", "label").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in got:
        out[r["i"]] = r["v"]
    return out


def _rows(batch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def conjugate_gradient(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 100, tol: float = 1e-9) -> tuple[np.ndarray, list[float]]:
    """optimise.minimise: the point and the values so far."""
    return minimise(f, x, rounds, tol=tol)[:2]


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 100, memory: int = 10, tol: float = 1e-7) -> tuple[np.ndarray, list[float]]:
    """Limited-memory BFGS with an Armijo-Wolfe bisection."""
    v, g = f(x)
    s, y, values = [], [], [v]
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for a, b in zip(reversed(s), reversed(y), strict=True):
            alphas.append(a @ q / (a @ b))
            q -= alphas[-1] * b
        if s:
            q *= (s[-1] @ y[-1]) / (y[-1] @ y[-1])
        for a, b, al in zip(s, y, reversed(alphas), strict=True):
            q += a * (al - b @ q / (a @ b))
        d, lo, hi, t = -q, 0.0, np.inf, 1.0 if s else 1.0 / max(1.0, np.linalg.norm(g))
        for _ in range(30):
            nv, ng = f(x + t * d)
            if nv > v + 1e-4 * t * (g @ d):
                hi = t
            elif ng @ d < 0.9 * (g @ d):
                lo = t
            else:
                break
            t = (lo + hi) / 2 if np.isfinite(hi) else 2 * t
        if (ng - g) @ d > 1e-12:
            s, y = [*s, t * d][-memory:], [*y, ng - g][-memory:]
        x, v, g = x + t * d, nv, ng
        values.append(v)
        if np.linalg.norm(g) < tol * max(1.0, np.linalg.norm(x)) or abs(values[-2] - v) < tol * max(1.0, abs(v)):
            break
    return x, values


# objectives


def ridge_objective(df: DataFrame, theta: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """Sum of (X theta - Y)^2 + lam |theta|^2 for one-hot Y, and its gradient."""
    d, c = theta.shape

    def f(x, y):
        e = x @ theta - np.eye(c)[y - 1]
        return np.concatenate([[(e**2).sum()], (2 * x.T @ e).ravel()])

    v = _sums(df, d * c + 1, f)
    return v[0] + lam * (theta**2).sum(), v[1:].reshape(d, c) + 2 * lam * theta


def mixed_norm(theta: np.ndarray, groups: list[np.ndarray], lam1: float, lam2: float) -> tuple[float, np.ndarray]:
    """lam1 times the rows' lengths plus lam2 times the root of the sum of fourth powers of each block of rows; subgradient 0 at 0."""
    rows = np.sqrt((theta**2).sum(1))
    g = lam1 * np.divide(theta, rows[:, None], out=np.zeros_like(theta), where=rows[:, None] > 0)
    value = lam1 * rows.sum()
    for idx in groups:
        block = theta[idx]
        n = np.sqrt((block**4).sum(0))
        value += lam2 * n.sum()
        g[idx] += lam2 * np.divide(2 * block**3, n, out=np.zeros_like(block), where=n > 0)
    return float(value), g


#: Features up to which ridge regression is solved by its normal equations; beyond, the Gram matrix would be large in every task.
NORMAL = 1024


def fit_ridge(df: DataFrame, classes: int, lam: float = 1.0, rounds: int = 200) -> np.ndarray:
    """Weights (features, classes) of the ridge regression on one-hot labels, by the normal equations or, of many
    features, by conjugate gradients on them: products with X'X + lam I alone, a pass over the rows each.
    """
    d = len(df.select("features").first()[0])

    def f(x, y):
        return np.concatenate([(x.T @ x).ravel(), (x.T @ np.eye(classes)[y - 1]).ravel()])

    if d <= NORMAL:
        v = _sums(df, d * d + d * classes, f)
        return np.linalg.solve(v[: d * d].reshape(d, d) + lam * np.eye(d), v[d * d :].reshape(d, classes))
    df = df.select("features", "label").persist()
    try:
        r = _sums(df, d * classes, lambda x, y: (x.T @ np.eye(classes)[y - 1]).ravel()).reshape(d, classes)
        theta, p, square = np.zeros((d, classes)), r.copy(), (r**2).sum(0)
        start = square.copy()
        for _ in range(rounds):
            live = square > 1e-20 * np.maximum(start, 1e-300)
            if not live.any():
                break
            q = _sums(df, d * classes, lambda x, y, p=p: (x.T @ (x @ p)).ravel()).reshape(d, classes) + lam * p
            step = np.where(live, square / np.maximum((p * q).sum(0), 1e-300), 0.0)
            theta, r = theta + step * p, r - step * q
            new = (r**2).sum(0)
            p, square = r + np.where(live, new / np.maximum(square, 1e-300), 0.0) * p, new
    finally:
        df.unpersist()
    return theta


def fit_mixed(df: DataFrame, classes: int, groups: list[np.ndarray], lam1: float, lam2: float, rounds: int = 30, checkpoint: str | None = None, every: int = 5) -> tuple[np.ndarray, list[float]]:
    """Least squares with the mixed norm, by conjugate gradients.

    With ``checkpoint`` the weights and the number of rounds done are written there every few rounds, and a later call goes on
    from them.
    """
    spark, d = df.sparkSession, len(df.select("features").first()[0])
    df = df.select("features", "label").persist()

    def f(t):
        t = t.reshape(d, classes)
        v, g = ridge_objective(df, t, 0.0)
        m, h = mixed_norm(t, groups, lam1, lam2)
        return v + m, (g + h).ravel()

    try:
        done, x, values = 0, np.full(d * classes, 1e-3), []
        if checkpoint and (kept := load_weights(spark, checkpoint)):
            done, x = kept[0], kept[1].ravel()
        while done < rounds:
            n = min(every, rounds - done) if checkpoint else rounds - done
            x, more = conjugate_gradient(f, x, n)
            values, done = values + more[bool(values) :], done + n
            if checkpoint:
                save_weights(spark, checkpoint, done, x.reshape(d, classes))
            if len(more) <= n:
                break
    finally:
        df.unpersist()
    return x.reshape(d, classes), values


def fit_two(df: DataFrame, first: str, second: str, classes: int, lam1: float, lam2: float, **settings) -> tuple[np.ndarray, list[float]]:
    """Mixed-norm regression on two modalities (array columns) side by side, each a group of its own."""
    a, b = (len(df.select(c).first()[0]) for c in (first, second))
    both = df.select(F.concat(first, second).alias("features"), "label")
    return fit_mixed(both, classes, [np.arange(a), np.arange(a, a + b)], lam1, lam2, **settings)


#: Batches whose searches one job takes.
STEPS = 64


def fit_batches(df: DataFrame, classes: int, groups: list[np.ndarray], lam1: float, lam2: float, size: int = 256, epochs: int = 40, seed: int = 1, checkpoint: str | None = None) -> np.ndarray:
    """Mini-batch training: in each epoch every batch of ``size`` rows takes one conjugate-gradient search from the weights so far.

    Rows are numbered in the order of a hash and written once, a folder a batch. A job reads the folders of the next ``STEPS`` batches and
    searches on one after the other in a task, which holds their rows; the driver holds weights. Full batches follow in an order of the
    epoch's own, the short one comes last. With ``checkpoint`` the weights are written after each epoch, and a later call goes on from them.
    """
    spark, first = df.sparkSession, df.select("features").first()
    if first is None:
        raise ValueError("no rows to train on")
    d = len(first[0])
    rows = df.select("features", "label").withColumn("_o", F.xxhash64(F.lit(seed), "features", "label"))
    table = stored(batch_ids(rows, size, "_o").drop("_o"), "batches", "batch")
    counts = {r["batch"]: r["n"] for r in table.groupBy("batch").agg(F.count("*").alias("n")).toLocalIterator()}
    full, short = sorted(k for k, n in counts.items() if n == size), sorted(k for k, n in counts.items() if n != size)
    theta, done = np.full((d, classes), 1e-3), 0
    if checkpoint and (kept := load_weights(spark, checkpoint)):
        done, theta = kept
    for epoch in range(done, epochs):
        order = [*np.random.default_rng([seed, epoch]).permutation(full).tolist(), *short]
        for at in range(0, len(order), STEPS):
            theta = _steps(table, order[at : at + STEPS], theta, groups, lam1, lam2)
        if checkpoint:
            save_weights(spark, checkpoint, epoch + 1, theta)
    return theta


def batch_search(x: np.ndarray, label: np.ndarray, theta: np.ndarray, groups: list[np.ndarray], lam1: float, lam2: float) -> np.ndarray:
    """Weights after one search on a batch of rows."""
    y = np.eye(theta.shape[1])[label - 1]

    def f(t):
        t = t.reshape(theta.shape)
        e = x @ t - y
        m, h = mixed_norm(t, groups, lam1, lam2)
        return float((e**2).sum() + m), (2 * x.T @ e + h).ravel()

    return conjugate_gradient(f, theta.ravel(), 1)[0].reshape(theta.shape)


def _steps(table: DataFrame, order: list[int], theta: np.ndarray, groups: list[np.ndarray], lam1: float, lam2: float) -> np.ndarray:
    """Weights after a search on each of some batches, in their order."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        x, y, k = np.concatenate([_rows(b) for b in held]), *(np.concatenate([np.asarray(b.column(c)) for b in held]) for c in ("label", "batch"))
        new = theta
        for own in order:
            at = np.flatnonzero(k == own)
            at = at[np.lexsort((*x[at].T[::-1], y[at]))]  # files come in any order; sums must not
            new = batch_search(x[at], y[at], new, groups, lam1, lam2)
        yield pa.RecordBatch.from_arrays([pa.array([new.tobytes()], pa.binary())], ["w"])

    rows = table.filter(F.col("batch").isin(order)).select("features", "label", "batch")
    # collected, not first(): a task that is cut off takes its Python worker with it, and the next job starts one anew
    return np.frombuffer(rows.coalesce(1).mapInArrow(run, "w binary").collect()[0]["w"]).reshape(theta.shape)


def save_weights(spark: SparkSession, path: str, rounds: int, theta: np.ndarray) -> None:
    """One row a feature under a folder a number of rounds: an older one stays whole while a newer is written."""
    spark.createDataFrame([(i, list(map(float, w))) for i, w in enumerate(theta)], "d long, w array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/rounds={rounds}")


def load_weights(spark: SparkSession, path: str) -> tuple[int, np.ndarray] | None:
    """The rounds and weights of the latest checkpoint that was finished, if any."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(top)] if files.exists(top) else []
    done = [int(x.split("=")[1]) for x in names if x.startswith("rounds=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{x}/_SUCCESS"))]
    if not done:
        return None
    rows = spark.read.parquet(f"{path}/rounds={max(done)}").orderBy("d").collect()
    return max(done), np.array([r["w"] for r in rows])


def fit_squared_hinge(df: DataFrame, classes: int, lam: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """One-versus-rest weights (features + 1, classes): sum of max(0, 1 - y f)^2 + lam |w|^2, the bias free."""
    d = len(df.select("features").first()[0])
    df = df.select("features", "label").persist()

    def f(t):
        w = t.reshape(d + 1, classes)

        def part(x, y):
            s = 2 * np.eye(classes)[y - 1] - 1
            h = np.maximum(0, 1 - s * (x @ w[:-1] + w[-1]))
            e = -2 * s * h
            return np.concatenate([[(h**2).sum()], np.vstack([x.T @ e, e.sum(0)]).ravel()])

        v = _sums(df, (d + 1) * classes + 1, part)
        g = v[1:].reshape(d + 1, classes)
        g[:-1] += 2 * lam * w[:-1]
        return v[0] + lam * (w[:-1] ** 2).sum(), g.ravel()

    try:
        return lbfgs(f, np.zeros((d + 1) * classes), rounds)[0].reshape(d + 1, classes)
    finally:
        df.unpersist()


def first_largest(s: np.ndarray) -> np.ndarray:
    """The first place in each row whose number is the largest, up to rounding."""
    top = s.max(1, keepdims=True)
    return (s >= top - 1e-12 * np.maximum(1.0, np.abs(s).max(1, keepdims=True))).argmax(1).astype(np.int32)


def predict(df: DataFrame, theta: np.ndarray, bias: np.ndarray | None = None) -> DataFrame:
    """scores and prediction, the class of the first largest score; the weights go to the tasks as one array.

    Scores that differ by rounding alone count as equal: a matrix product may add up equal columns in different orders.
    """
    b0 = np.zeros(theta.shape[1]) if bias is None else np.asarray(bias, float)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                s = _rows(part) @ theta + b0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(s), pa.list_(pa.float64())), pa.array(first_largest(s) + 1)], [*part.schema.names, "scores", "prediction"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("prediction", T.IntegerType())]))


# library classifiers


def _vectors(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("vec", array_to_vector(F.col("features").cast("array<double>"))).withColumn("y", F.col("label").cast("double"))


#: Numbers of a pair's rows that are worth a task of their own in a machine's search.
PART = 1 << 22


def fit_pairwise_svm(df: DataFrame, c: float = 1.0, rounds: int = 50, parallel: int = 8) -> dict[tuple[int, int], tuple[np.ndarray, float]]:
    """A linear hinge machine for each pair of classes; ``parallel`` pairs are fitted at a time, each by jobs of its own.

    Rows are written once, a folder a class, so a pair reads its two classes alone. A search is a hundred short jobs, whose time is that of
    their tasks' start: its rows are drawn together into one task for every ``PART`` numbers.
    """
    from pyspark.ml.classification import LinearSVC

    d = stored(df.select("features", "label"), "classes", "label")
    sizes = {r["label"]: r["count"] for r in d.groupBy("label").count().collect()}
    width = len(d.select("features").first()[0]) if sizes else 0

    def one(pair):
        a, b = pair
        n = sizes[a] + sizes[b]
        own = d.filter(F.col("label").isin(a, b)).withColumn("label", (F.col("label") == a).cast("int"))
        two = _vectors(own.coalesce(n * width // PART + 1)).select("vec", "y")
        m = LinearSVC(featuresCol="vec", labelCol="y", maxIter=rounds, standardization=False, regParam=1.0 / (c * n)).fit(two)
        return pair, (m.coefficients.toArray(), m.intercept)

    with ThreadPoolExecutor(parallel) as pool:
        return dict(pool.map(inheritable_thread_target(df.sparkSession)(one), list(combinations(sorted(sizes), 2))))


def fit_sigmoids(df: DataFrame, machines: dict, rounds: int = 100) -> dict[tuple[int, int], tuple[float, float]]:
    """A and B of P(first of a pair | score s) = 1 / (1 + exp(A s + B)) for each pair, by Newton's method on smoothed targets.

    The rows of a pair are summed to two gradients and three curvatures a round; all pairs take their rounds together.
    """
    pairs = sorted(machines)
    w, w0 = np.array([machines[p][0] for p in pairs]).T, np.array([machines[p][1] for p in pairs])
    first, second = (np.array([p[i] for p in pairs]) for i in (0, 1))
    df = df.select("features", "label").persist()
    try:
        n = _sums(df, 2 * len(pairs), lambda x, y: np.concatenate([(y[:, None] == first).sum(0), (y[:, None] == second).sum(0)]).astype(float))
        n1, n2 = n[: len(pairs)], n[len(pairs) :]
        a, b = np.zeros(len(pairs)), np.log((n2 + 1) / (n1 + 1))

        def sums(a, b):
            def f(x, y):
                out = np.zeros((6, len(pairs)))
                for k in np.unique(y):  # a row counts for the pairs of its class alone
                    own = np.flatnonzero((first == k) | (second == k))
                    s = x[y == k] @ w[:, own] + w0[own]
                    t = np.where(first[own] == k, (n1[own] + 1) / (n1[own] + 2), 1 / (n2[own] + 2))
                    z = a[own] * s + b[own]
                    p = 1 / (1 + np.exp(np.clip(z, -500, 500)))
                    loss = t * z + np.logaddexp(0, -z)
                    q, e = p * (1 - p), t - p
                    out[:, own] += [v.sum(0) for v in (loss, e * s, e, q * s * s, q * s, q)]
                return out.ravel()

            return _sums(df, 6 * len(pairs), f).reshape(6, -1)

        loss, ga, gb, haa, hab, hbb = sums(a, b)
        for _ in range(rounds):
            if max(np.abs(ga).max(), np.abs(gb).max()) < 1e-5:
                break
            haa, hbb = haa + 1e-12, hbb + 1e-12
            det = np.maximum(haa * hbb - hab * hab, 1e-300)
            da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
            step = np.ones(len(pairs))
            for _ in range(20):
                new = sums(a + step * da, b + step * db)
                # near the minimum a step's gain drowns in the rounding of a loss that grows with the rows
                worse = new[0] > loss + 1e-4 * step * (ga * da + gb * db) + 1e-12 * np.maximum(1.0, np.abs(loss))
                if not worse.any():
                    break
                step = np.where(worse, step / 2, step)
            a, b = a + step * da, b + step * db
            loss, ga, gb, haa, hab, hbb = new
    finally:
        df.unpersist()
    return {p: (float(x), float(y)) for p, x, y in zip(pairs, a, b, strict=True)}


def coupled(r: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Class probabilities p (rows, classes) from pairwise ones r (rows, i, j): P(i | i or j).

    The minimum of the sum over pairs of (r_ji p_i - r_ij p_j)^2 on the simplex, by its fixed-point iteration.
    """
    n, k, _ = r.shape
    q = -np.swapaxes(r, 1, 2) * r
    at = np.arange(k)
    q[:, at, at] = (np.swapaxes(r, 1, 2) ** 2).sum(2) - np.swapaxes(r, 1, 2)[:, at, at] ** 2
    p = np.full((n, k), 1 / k)
    for _ in range(rounds):
        qp = np.einsum("nij,nj->ni", q, p)
        if np.abs(qp - (p * qp).sum(1, keepdims=True)).max() < 0.005 / k / 100:
            break
        for i in range(k):
            qp = np.einsum("nij,nj->ni", q, p)
            diff = ((p * qp).sum(1) - qp[:, i]) / np.maximum(q[:, i, i], 1e-300)
            p[:, i] += diff
            p /= (1 + diff)[:, None]
    return p


def predict_pairwise(df: DataFrame, machines: dict, sigmoids: dict | None = None) -> DataFrame:
    """prediction: most votes, the lowest class of equals; with sigmoids, the largest of the coupled probabilities (also given)."""
    classes = sorted({k for p in machines for k in p})
    pairs, place = sorted(machines), {c: k for k, c in enumerate(classes)}
    w, w0 = np.array([machines[p][0] for p in pairs]).T, np.array([machines[p][1] for p in pairs])
    first, second = (np.array([place[p[i]] for p in pairs]) for i in (0, 1))
    ab = np.array([sigmoids[p] for p in pairs]) if sigmoids else None

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                s = _rows(part) @ w + w0
                if ab is None:
                    score = np.zeros((len(s), len(classes)))
                    for j in range(len(pairs)):
                        score[np.arange(len(s)), np.where(s[:, j] >= 0, first[j], second[j])] += 1
                else:
                    p = np.clip(1 / (1 + np.exp(np.clip(s * ab[:, 0] + ab[:, 1], -500, 500))), 1e-7, 1 - 1e-7)
                    r = np.zeros((len(s), len(classes), len(classes)))
                    r[:, first, second], r[:, second, first] = p, 1 - p
                    score = coupled(r)
                out = [pa.array(np.array(classes, np.int32)[score.argmax(1)])]
                yield pa.RecordBatch.from_arrays([*part.columns, *([] if ab is None else [pa.array(list(score), pa.list_(pa.float64()))]), *out], [*part.schema.names, *([] if ab is None else ["probabilities"]), "prediction"])

    more = [] if ab is None else [T.StructField("probabilities", T.ArrayType(T.DoubleType()))]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *more, T.StructField("prediction", T.IntegerType())]))


def fit_forest(df: DataFrame, trees: int = 200, depth: int = 10, seed: int = 1):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(featuresCol="vec", labelCol="y", impurity="entropy", featureSubsetStrategy="sqrt", numTrees=trees, maxDepth=depth, seed=seed).fit(_vectors(df))


def predict_forest(df: DataFrame, model) -> DataFrame:
    return model.transform(_vectors(df)).withColumn("prediction", F.col("prediction").cast("int")).drop("vec", "y", "rawPrediction", "probability")


def out_of_bag(df: DataFrame, trees: int = 200, depth: int = 10, seed: int = 1, id_col: str = "vec_id", share: int = 1000, parallel: int = 8) -> float:
    """Accuracy of each row's vote among the trees that did not see it.

    A row is in tree k's sample by a fixed hash, with probability 1 - 1/e, as one of a bootstrap is; ``parallel`` trees are fitted at a time.
    """
    from pyspark.ml.classification import DecisionTreeClassifier

    d = _vectors(df).select(F.col(id_col).alias("id"), "vec", "y").persist()

    def tree(k):
        out = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(share)) < int(share / np.e)
        m = DecisionTreeClassifier(featuresCol="vec", labelCol="y", impurity="entropy", maxDepth=depth, seed=seed + k).fit(d.filter(~out))
        return m.transform(d.filter(out)).select("id", "y", "prediction")

    try:
        with ThreadPoolExecutor(parallel) as pool:
            votes = reduce(DataFrame.unionAll, pool.map(inheritable_thread_target(df.sparkSession)(tree), range(trees)))
        n = votes.groupBy("id", "y", "prediction").agg(F.count("*").alias("n"))
        best = n.groupBy("id", "y").agg(F.max_by("prediction", F.struct("n", -F.col("prediction"))).alias("p"))
        return best.agg(F.avg((F.col("y") == F.col("p")).cast("double"))).first()[0]
    finally:
        d.unpersist()


# evaluation


def confusion(predictions: DataFrame, classes: int) -> DataFrame:
    """label, p1..pC: dense counts, empty classes too."""
    d = predictions.groupBy("label").pivot("prediction", list(range(1, classes + 1))).count()
    every = predictions.sparkSession.range(1, classes + 1).select(F.col("id").cast("int").alias("label"))
    d = every.join(d, "label", "left").fillna(0)
    return d.select("label", *(F.col(str(k)).alias(f"p{k}") for k in range(1, classes + 1)))


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def majority(df: DataFrame, *by: str) -> DataFrame:
    """Most frequent label of each group, the lowest of equals."""
    c = df.groupBy(*by, "label").agg(F.count("*").alias("n"))
    return c.groupBy(*by).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


def weighted_votes(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.sum("weight").alias("weight"))
