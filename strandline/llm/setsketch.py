"""Near-duplicates by SetSketch registers.

A text is lower-cased (A-Z), cut into words at ASCII white space, and stands for its set of distinct
five-word shingles (all its words as one shingle if it has fewer; no words: an empty set, linked with
nothing). Each of M registers holds floor(1 - log_B x) cut to Q + 1, x the smallest of the set's
exponentially distributed hash values: registers merge by maximum, and two sets agree in one with
nearly the probability of their Jaccard similarity J. Bands of registers are bucketed, as wide as the threshold of J allows: a
pair at it shares no bucket with a probability under MISS (at 0.85 bands of 5: (1 - 0.85**5)**25 < 5e-7; at 0.80 bands of 4).
Two sketches' wins and ties give a joint maximum-likelihood estimate of J; a pair six standard deviations
below the threshold is left, all others are confirmed on the full sets.

No bucket is expanded into all its pairs. Equal sets are one node. Each bucket's most shared member
(largest total of bucket sizes, which the original of a family of edited copies has) is its leader L and is
compared with the rest; in buckets that then hold several components, so is the most shared member of those not with L. Of the
pairs across components that remain, two members x, y of L's family can be a link only in two ways. With removals
R = L - x and additions A = x - L, if they share no addition,

    J(x, y) <= (|L| - max |R|) / (|L| - min |R| + |A_x| + |A_y|),

which decides most by four counts. If they share s additions, s must reach a number that the same counts give; the least such number over the
family's counts cuts each member's additions, rarest first, to a prefix in which two linked members must meet.
Both kinds are tested, so no link between components is lost and no partner is capped.

Null text: an empty set. Null id: alone, component null, kept. Rows that repeat an id are one document
whose links are those of any of its rows. Extra columns are not used.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import WordIds, mix64, slices, stored, table, unused
from strandline.llm.graph import components

SHINGLE = 5
M, MISS = 128, 5e-7
B, A, Q = 1.001, 20.0, (1 << 16) - 2
THRESHOLD = 0.85
STEP = 2  #: steps of sizes to a doubling, see _least_shared
_MULT = mix64(np.arange(1, 2 * M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_POS = mix64(np.arange(100, 100 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


class Limit:
    """What follows from a threshold of J: a link has inter * |x & y| >= union * |x | y|; least estimate; registers a band."""

    def __init__(self, threshold: float):
        t = Fraction(str(threshold))
        if not 0 < t <= 1:
            raise ValueError("the threshold must be above 0 and at most 1")
        self.inter, self.union = t.denominator, t.numerator
        t = float(t)
        self.floor = t - 6 * (t * (1 - t) / M) ** 0.5
        self.rows = max((r for r in range(1, M + 1) if (1 - t**r) ** (M // r) < MISS), default=0)
        if not self.rows:
            raise ValueError("the sketches are too small for this threshold")


def shingle_sets(datas: list[bytes], ids: WordIds) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = [d.lower().split() for d in datas]
    sizes = [len(w) for w in words]
    flat = ids.of([x for w in words for x in w])
    out, at = [], 0
    with np.errstate(over="ignore"):
        for n in sizes:
            w = flat[at : at + n]
            at += n
            if n == 0:
                out.append(np.empty(0, np.uint64))
                continue
            k = min(n, SHINGLE)
            h = np.full(n - k + 1, k, np.uint64)
            for j in range(k):
                h += w[j : n - k + 1 + j] * _POS[j]
            out.append(np.unique(mix64(h)))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 registers, a row a set; no set may be empty."""
    h = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    mins = np.empty((len(sets), M), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(M):
            mins[:, j] = np.minimum.reduceat((h ^ _MULT[M + j]) * _MULT[j], starts)
    x = -np.log1p(-(mins.astype(np.float64) + 0.5) / 2.0**64) / A
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, Q + 1).astype(np.uint16)


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    keys = np.empty((len(regs), M // rows), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(M // rows):
            h = np.full(len(regs), b + 1, np.uint64)
            for j in range(b * rows, b * rows + rows):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + regs[:, j].astype(np.uint64))
            keys[:, b] = h
    return keys


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, grid: int = 100) -> np.ndarray:
    """Joint maximum-likelihood estimate of J from two sketches and the sets' sizes."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.arange(grid + 1)[None, :] / grid
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (B - 1) / B) / np.log(B)
    win, lose = p(u - v * j), p(v - u * j)
    ll = up * np.log(win) + down * np.log(lose) + (a.shape[1] - up - down) * np.log(np.clip(1 - win - lose, 1e-12, 1))
    return j[np.arange(len(j)), ll.argmax(1)]


def _sign(rows: int):
    def run(batches):
        import hashlib

        ids = WordIds()
        for batch in batches:
            doc, data = batch.column(0), batch.column(1)
            for lo, hi in slices(np.diff(np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4)), 2 << 20):
                sets = shingle_sets(data.slice(lo, hi - lo).to_pylist(), ids)
                full = [i for i, s in enumerate(sets) if len(s)]
                regs = registers([sets[i] for i in full]) if full else np.empty((0, M), np.uint16)
                keys = band_keys(regs, rows).view(np.int64)
                key, reg, band = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                for k, i in enumerate(full):
                    key[i], reg[i], band[i] = hashlib.md5(sets[i].tobytes()).digest(), regs[k].tobytes(), keys[k]
                yield pa.RecordBatch.from_arrays([doc.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), pa.array(reg, pa.binary()), pa.array(band, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "regs", "bands"])

    return run


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row a document: doc_id, n_shingles, set_key, regs (M little-endian uint16), bands."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    return d.mapInArrow(_sign(Limit(threshold).rows), "doc_id long, n_shingles long, set_key binary, regs binary, bands array<long>")


def _likely(limit: Limit):
    """Pairs whose estimate reaches the limit's floor, and those that are to be compared whatever it is."""

    def run(batches):
        for x in batches:
            if x.num_rows:
                a, b = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("ra", "rb"))
                na, nb = x.column("na").to_numpy(), x.column("nb").to_numpy()
                j = np.concatenate([estimate(a[i : i + 2000], b[i : i + 2000], na[i : i + 2000], nb[i : i + 2000]) for i in range(0, len(a), 2000)])
                yield x.select(["a", "b", "whole"]).filter(pa.array((j >= limit.floor) | np.asarray(x.column("whole"))))

    return run


def _compare(limit: Limit):
    """Full sets of a and b: linked, |a - b|, |b - a|, |a|, and where asked for b - a itself."""

    def run(batches):
        ids, sets = WordIds(), {}
        for x in batches:
            cols: list[list] = [[] for _ in range(5)]
            for ta, tb, whole in zip(x.column("ta"), x.column("tb"), x.column("whole").to_pylist(), strict=True):
                pair = []
                for t in (ta.as_py(), tb.as_py()):
                    if t not in sets:
                        if len(sets) >= 64:
                            sets.clear()
                        sets[t] = shingle_sets([t], ids)[0]
                    pair.append(sets[t])
                more = np.setdiff1d(pair[1], pair[0], assume_unique=True)
                both = len(pair[1]) - len(more)
                row = (both > 0 and limit.inter * both >= limit.union * (len(pair[0]) + len(more)), len(pair[0]) - both, len(more), len(pair[0]), more.view(np.int64) if whole else None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), *(pa.array(c, k) for c, k in zip(cols, types, strict=True))], ["a", "b", "linked", "removed", "added", "size", "additions"])

    return run


def compared(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, limit: Limit) -> DataFrame:
    """pairs (a, b, whole): what _compare gives for those that may be links, and for all that are ``whole``."""
    side = lambda c: sigs.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("regs").alias(f"r{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.col("whole") | (limit.inter * F.least("na", "nb") >= limit.union * F.greatest("na", "nb")))
    near = near.select("a", "b", "whole", "na", "nb", "ra", "rb").mapInArrow(_likely(limit), "a long, b long, whole boolean").distinct()
    text = lambda c: texts.select(F.col("doc_id").alias(c), F.col("data").alias(f"t{c}")).hint("merge")
    full = near.join(text("a"), "a").join(text("b"), "b").select("a", "b", "whole", "ta", "tb")
    return full.mapInArrow(_compare(limit), "a long, b long, linked boolean, removed long, added long, size long, additions array<long>")


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """Distinct pairs (x, y) in either order as (a, b), without those tested in either order."""
    key = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    old = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.select(*key).distinct().join(old, ["a", "b"], "left_anti").withColumn("whole", F.lit(False))


def _least_shared(kind: DataFrame, limit: Limit) -> DataFrame:
    """(a, removed, added, need): no fewer than ``need`` additions are shared with any member of the family that may be a link; kinds without
    such a member are left out. kind: distinct (a, size, removed, added).

    Kinds are not paired. Of two with removals r <= r2 the number rises with U added2 + I r2, of two with r >= r2 with U (added2 - r2); both
    are least over a range of removals, which a window in their order gives. As no more than added2 can be shared, this is done apart for every
    STEP of sizes of added2: a kind has a row a step, whatever the family's size. Within a step added2 stands for the step's largest, so ``need`` may be
    lower than over all pairs of kinds, never higher.
    """
    i, u = limit.inter, limit.union
    some = kind.filter("added > 0").withColumn("step", F.floor(F.log2("added") * STEP))
    own = some.groupBy("a", "step", "removed").agg(F.min("added").alias("low"), F.max("added").alias("top"))
    own = own.select("a", "step", "removed", (u * F.col("low") + i * F.col("removed")).alias("up"), (u * (F.col("low") - F.col("removed"))).alias("down"), "top")
    ask = some.withColumn("steps", F.collect_set("step").over(W.partitionBy("a"))).withColumn("step", F.explode("steps")).drop("steps")
    every = own.unionByName(ask, allowMissingColumns=True)
    w = W.partitionBy("a", "step")
    to = w.orderBy("removed")
    every = every.select(
        "a",
        "size",
        "removed",
        "added",
        F.min("up").over(to.rangeBetween(W.currentRow, W.unboundedFollowing)).alias("up"),
        F.min("down").over(to.rangeBetween(W.unboundedPreceding, W.currentRow)).alias("down"),
        F.max("top").over(w).alias("top"),
    ).filter("added is not null")
    least = F.least(u * (F.col("size") - F.col("removed") + F.col("added")) - i * F.col("size") + F.col("up"), u * (F.col("size") + F.col("added")) - i * (F.col("size") - F.col("removed")) + F.col("down"))
    need = F.greatest(F.ceil(least / F.lit(float(i + u)) - 1e-9), F.lit(1))
    return every.select("a", "removed", "added", "top", need.alias("need")).filter(F.col("need") <= F.least("added", "top")).groupBy("a", "removed", "added").agg(F.min("need").alias("need"))


def _meeting(family: DataFrame, limit: Limit) -> DataFrame:
    """Pairs (x, y) of a family, in different components, that may share enough additions to be a link."""
    need = _least_shared(family.select("a", "size", "removed", "added").distinct(), limit)
    by = family.join(need, ["a", "removed", "added"]).select("a", "x", "component", "main", "need", F.explode("additions").alias("h"))
    often = by.groupBy("a", "h").agg(F.count("*").alias("times")).filter("times > 1")
    w = W.partitionBy("a", "x")
    by = by.join(often, ["a", "h"]).withColumn("of", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("times", "h")))
    by = by.filter(F.col("rank") <= F.col("of") - F.col("need") + 1)
    out = by.filter("component <> main").select("a", "h", F.col("x").alias("y"), F.col("component").alias("c2"))
    return by.join(out, ["a", "h"]).filter((F.col("component") != F.col("c2")) & ((F.col("component") == F.col("main")) | (F.col("x") < F.col("y")))).select("x", "y")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id, kept. Documents of J >= threshold are linked."""
    limit = Limit(threshold)
    sig = stored(sketches(docs, id_col, text_col, threshold))
    named = sig.filter("n_shingles > 0 and doc_id is not null")
    reps = stored(named.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    nodes = named.join(reps.hint("merge"), "set_key").filter("doc_id = rep").dropDuplicates(["set_key"])
    band = nodes.select(F.col("doc_id").alias("x"), F.explode(F.array_distinct("bands")).alias("band"))
    count = band.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(band.join(count.hint("merge"), "band"))
    shared = stored(shared.join(shared.groupBy("x").agg(F.sum("n").alias("total")), "x"))

    members = shared.select(F.col("x").alias("doc_id")).distinct().hint("merge")
    sigs = stored(nodes.join(members, "doc_id", "left_semi").select("doc_id", "n_shingles", "regs"))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    texts = stored(d.join(members, "doc_id", "left_semi"))

    first = (-F.max(F.struct("total", (-F.col("x")).alias("m")))["m"]).alias("a")
    lead = stored(shared.groupBy("band").agg(first))
    star = shared.join(lead, "band").filter("a <> x").groupBy("a", F.col("x").alias("b")).agg((F.max("n") > 2).alias("whole"))
    facts = stored(compared(star, sigs, texts, limit))
    tested, links = facts.select("a", "b"), facts.filter("linked").select("a", "b")

    # rows that repeat an id tie their sets together
    ties = named.join(reps, "set_key").select("doc_id", "rep").distinct().groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("r")).filter(F.size("r") > 1).select("a", F.explode("r").alias("b"))
    links = links.union(stored(ties.filter("a <> b")))

    def mixed(label: DataFrame) -> DataFrame:
        """(band, a, x, total, component, main): members of buckets with several components; main is the leader's."""
        of = lambda c, name: label.select(F.col("id").alias(c), F.col("component").alias(name))
        rows = shared.filter("n > 2").join(lead, "band").join(of("x", "_c"), "x", "left").join(of("a", "_m"), "a", "left")
        # written: a hot band is then combined before it is dealt out again, and its join can be split
        rows = stored(rows.select("band", "a", "x", "total", F.coalesce("_c", "x").alias("component"), F.coalesce("_m", "a").alias("main")))
        several = rows.filter("component <> main").select("band").distinct()
        return stored(rows.join(several, "band", "left_semi"))

    label = components(links)
    rows = mixed(label)
    if not rows.isEmpty():
        rest = rows.filter("component <> main")
        second = rest.groupBy("band").agg(first).withColumnRenamed("a", "y")
        more = stored(_untested(rest.join(second, "band").filter("x <> y"), tested))
        links = links.union(stored(compared(more, sigs, texts, limit)).filter("linked").select("a", "b"))
        tested = tested.union(more.select("a", "b"))
        label = components(links)
        rows = mixed(label)
        family = rows.select("a", "x", "component", "main").distinct().join(facts.withColumnRenamed("b", "x"), ["a", "x"])
        family = stored(family.select("a", "x", "component", "main", "removed", "added", "size", "additions"))
        out = family.filter("component <> main").select("a", F.col("x").alias("y"), F.col("component").alias("c2"), F.col("removed").alias("r2"), F.col("added").alias("a2"), F.col("additions").alias("t2"))
        bound = limit.inter * (F.col("size") - F.greatest("removed", "r2")) >= limit.union * (F.col("size") - F.least("removed", "r2") + F.col("added") + F.col("a2"))
        near = family.join(out, "a").filter((F.col("component") != F.col("c2")) & bound).select("x", "y")
        same = _meeting(family, limit)
        last = stored(_untested(near.union(same), tested))
        if not last.isEmpty():
            links = links.union(stored(compared(last, sigs, texts, limit)).filter("linked").select("a", "b"))
            label = components(links)
    res = sig.select("doc_id", "n_shingles", "set_key").join(reps, "set_key", "left")
    res = res.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return res.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the documents that near_duplicates does not keep."""
    (lost,) = unused(docs, "_lost")
    found = stored(near_duplicates(docs, threshold=threshold).filter(~F.col("kept")).select(F.col("doc_id").alias(lost)).distinct())
    return docs.join(found, F.col("doc_id") == F.col(lost), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept FROM s LEFT JOIN c ON c.a = s.doc_id
"""
