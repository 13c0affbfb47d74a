"""k-means of integer vectors by exact block products.

Squared distances come from |x|^2 - 2 x.c + |c|^2: one float64 matrix product a block of vectors. Components are integers, so
the product is exact as long as no sum can reach 2^53; a block whose magnitudes do not prove that is done in 64-bit
integers, and one that could leave those in Python's. Each task brings its clusters' sums and counts into one row, and
treeAggregate adds those in levels; only k sums reach the driver, however many vectors there are.

Nothing is shuffled but these rows. Each round reads the vectors anew, which costs less than to keep a copy.

Defined cases: vectors of another length, null ones, and such with a null or non-finite component are left out; a null id is
kept and comes after all others in the choice of the first centroids; equal ids are ordered by their components; equal
vectors get one cluster, and of equally near centroids the one of smaller number; a centroid with no vectors stays as it is; with fewer
vectors than k there are as many centroids as vectors; a distance or sum beyond 64 bits is null; extra columns are not used; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import table

K, DIM, ROUNDS, SCALE, SEED = 40, 64, 5, 256, 2
#: Rows of a matrix product.
ROWS = 4096
EXACT, LONG = 1 << 53, 1 << 63


def quantised(b: pa.RecordBatch, dim: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and floor(scale * x) of the usable vectors: int64, or Python's integers where one does not fit."""
    ids, v = b.column(0), b.column(1)
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(v), dim), False).to_numpy(zero_copy_only=False))
    v = v.take(pa.array(at))
    x = pc.list_flatten(v)
    x = pc.fill_null(x.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False).reshape(len(at), dim)
    good = np.isfinite(x).all(axis=1)
    x, at = x[good], at[good]
    if not x.size or np.abs(x).max() * scale < 1 << 62:
        q = np.floor(x * scale).astype(np.int64)
    else:  # exact for any scale, and beyond the range of floats
        q = np.array([[math.floor(c) * scale if c == math.floor(c) else math.floor(c * scale) for c in r] for r in x.tolist()], object)
    return ids.take(pa.array(at)), q


def _most(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid (ties: the smaller) and the squared distance, exact."""
    bound = x.shape[1] * (_most(x) + _most(c)) ** 2  # no partial sum of the expansion is larger
    if bound < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        d = a @ (-2 * b.T)
        d += np.einsum("ij,ij->i", a, a)[:, None]
        d += np.einsum("ij,ij->i", b, b)
        k = d.argmin(axis=1)
        return k, d[np.arange(len(k)), k].astype(np.int64)
    kind = np.int64 if bound < LONG else object
    x, c = x.astype(kind), c.astype(kind)
    d = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
    k = d.argmin(axis=1)
    return k, d[np.arange(len(k)), k]


def _totals(x: np.ndarray, k: np.ndarray, n: int) -> np.ndarray:
    """(n, columns) sums of x by k in Python's integers; a block's own in 64 bits where those hold."""
    out = np.zeros((n, x.shape[1]), object)
    if len(x):
        o = np.argsort(k, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(k[o]) != 0]))
        x = x if len(x) * _most(x) < LONG else x.astype(object)
        out[k[o][first]] += np.add.reduceat(x[o], first, axis=0).astype(object)
    return out


def _blocks(batches: Iterable[pa.RecordBatch], dim: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        ids, q = quantised(b, dim, scale)
        for s in range(0, len(q), ROWS):
            yield ids.slice(s, ROWS), q[s : s + ROWS]


def _gather(vectors: DataFrame, c: np.ndarray, dim: int, scale: int) -> np.ndarray:
    """(k, dim + 2) sums of components, counts and distances by nearest centroid."""

    def part(batches):
        total = np.zeros((len(c), dim + 2), object)
        for _, x in _blocks(batches, dim, scale):
            k, d = nearest(x, c)
            total[:, :dim] += _totals(x, k, len(c))
            total[:, dim:] += _totals(np.column_stack([np.ones(len(k), d.dtype), d]), k, len(c))
        yield pa.RecordBatch.from_pydict({"sums": pa.array([pickle.dumps(total)], pa.binary())})

    rows = vectors.mapInArrow(part, "sums binary").rdd
    add = lambda a, b: b if a is None else a if b is None else a + b
    got = rows.treeAggregate(None, lambda a, r: add(a, pickle.loads(r["sums"])), add, depth=3)
    return np.zeros((len(c), dim + 2), object) if got is None else got


def first_centroids(vectors: DataFrame, k: int = K, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """The k usable vectors of smallest sha256 of ``seed:id``."""
    good = (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    top = vectors.filter(good).withColumn("h", name).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).select("id", "v").toArrow()
    return np.concatenate([q for b in top.to_batches() for _, q in [quantised(b, dim, scale)]]) if top.num_rows else np.empty((0, dim), np.int64)


def fit(vectors: DataFrame, k: int = K, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """Centroids of (id, v) after some rounds: each the floor of its vectors' mean."""
    c = first_centroids(vectors, k, dim, scale, seed)
    for _ in range(rounds if len(c) else 0):
        t = _gather(vectors, c, dim, scale)
        new = [[int(s) // int(row[dim]) for s in row[:dim]] if row[dim] else old for row, old in zip(t, c.tolist(), strict=True)]
        c = np.array(new, np.int64 if max(abs(x) for r in new for x in r) < 1 << 62 else object)
    return c


def clustered(df: DataFrame, k: int = K, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row a usable vector: the id, its cluster and squared distance, the distances' sums over its cluster and over all, the
    final centroid and the sha256 of it.
    """
    v = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    c = fit(v, k, dim, rounds, scale, seed)
    if not len(c):
        out = v.limit(0).select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(n) for n in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid"))
    else:
        inertia = [int(x) for x in _gather(v, c, dim, scale)[:, dim + 1]]
        fits = lambda x: x if x < LONG else None

        def assign(batches):
            for ids, x in _blocks(batches, dim, scale):
                n, d = nearest(x, c)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int32()), pa.array([fits(int(y)) for y in d] if d.dtype == object else d, pa.int64())], ["id", "cluster", "distance"])

        assigned = v.mapInArrow(assign, f"id {v.schema['id'].dataType.simpleString()}, cluster int, distance long")
        own = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
        out = assigned.select(F.col("id").alias(id_col), "cluster", "distance", own(map(fits, inertia)).cast("long").alias("cluster_inertia"), F.lit(fits(sum(inertia))).cast("long").alias("inertia"), own(",".join(map(str, r)) for r in c.tolist()).alias("centroid"))
    return out.withColumn("centroid_sha256", F.sha2("centroid", 256))


def query(spark, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings")).drop("centroid")


def _rounds(n: int) -> str:
    near = lambda c: f"SELECT vec_id, k AS cluster, dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, k) AS o FROM (SELECT v.vec_id, {c}.k, sum((v.x - {c}.x) * (v.x - {c}.x)) AS dist FROM v JOIN {c} USING (i) GROUP BY v.vec_id, {c}.k)) WHERE o = 1"
    out = []
    for r in range(n):
        mean = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
        new = f"SELECT cluster AS k, i, CAST({mean} AS BIGINT) AS x FROM a{r} JOIN v USING (vec_id) GROUP BY cluster, i"
        out += [f"a{r} AS MATERIALIZED ({near(f'c{r}')})", f"c{r + 1} AS MATERIALIZED (SELECT k, i, CAST(coalesce(n.x, c{r}.x) AS BIGINT) AS x FROM c{r} LEFT JOIN ({new}) n USING (k, i))"]
    return ",\n".join([*out, f"f AS MATERIALIZED ({near(f'c{n}')})"])


#: Ids are distinct in the given tables.
ORACLE = f"""
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
v AS MATERIALIZED (SELECT vec_id, i, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM (SELECT vec_id, unnest(range(1, {DIM + 1})) AS i, unnest(embedding) AS x FROM e)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k FROM e),
c0 AS MATERIALIZED (SELECT k, i, x FROM s JOIN v USING (vec_id) WHERE k < {K}),
{_rounds(ROUNDS)},
g AS (SELECT cluster, sum(dist) AS ci FROM f GROUP BY cluster),
h AS (SELECT k AS cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(ci AS BIGINT) AS cluster_inertia, CAST((SELECT sum(dist) FROM f) AS BIGINT) AS inertia, centroid_sha256
FROM f JOIN g USING (cluster) JOIN h USING (cluster)
"""
