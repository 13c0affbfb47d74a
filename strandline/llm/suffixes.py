"""Repeated passages by a sparse suffix sort: deep-shallow sorting of anchored contexts.

Every byte covered by a LENGTH-byte string that also starts earlier is removed. Anchors make this
distributable: of each LENGTH-byte window the position whose KEY-byte string has the smallest hash is an
anchor, so equal windows have equal anchors at equal distances, and about one position in (LENGTH - KEY) / 2 is one.

1. Each block of documents lists its anchors' hashes; hashes that occur twice anywhere go back to their blocks.
2. A block sends the context of each repeated anchor (the bytes that windows around it can cover) to the
   hash. Equal contexts within a block are sent once: the later ones are settled there.
3. The contexts of one hash meet. They are ordered twice, as suffixes from the anchor and as reversed prefixes
   to it, by deep-shallow sorting: multikey quicksort, eight bytes a symbol, to a shallow depth, then
   blind tries for the groups that are still equal. A window at distance r before the anchor is one class with another
   if the orders' common prefixes are r to the left and LENGTH - r to the right; all but the first of a class are repeats.
4. Each document gets its repeated runs back.

A block sends each distinct context once, so a group of copies costs a hash one context a block. An anchor with more than
WIDE occurrences, such as those at the ends of a passage that a third of all documents hold in different
surroundings, is not sent whole: each of its windows goes by its own hash, and equal ones again once a block.

Documents order by doc_id; a null id comes first. Rows that repeat an id are documents of their own, in the order of
their texts' hashes (common.blocked's key), then bytes; an id with more rows than a block should have is dealt over the
blocks by that hash. Rows equal in id and text are compared once: all but the first are repeats throughout. Null text is
empty. Extra columns are not used. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import RANKS, block_of, blocked, mix64, n_blocks, table

LENGTH, KEY, SHALLOW, WIDE = 100, 32, 48, 20_000
LEFT = LENGTH - KEY
_BASE = 0x9E3779B97F4A7C15
NULL_ID = -(1 << 63)


def _shifted(x: np.ndarray, k: int) -> np.ndarray:
    return x[k:] if k < len(x) else x[:0]


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of one text (bytes)."""
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h, power, size = data.astype(np.uint64) + np.uint64(1), _BASE, 1
        while size < KEY:
            h = h[:-size] * np.uint64(power) + h[size:]
            power, size = power * power & (1 << 64) - 1, size * 2
        h = mix64(h)

    def slide(x: np.ndarray, width: int, op) -> np.ndarray:
        size = 1
        while size * 2 <= width:
            x, size = op(x[:-size], x[size:]), size * 2
        return x if size == width else op(x[: len(x) - (width - size)], x[width - size :])

    width = LENGTH - KEY + 1
    least = slide(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    # a window's smallest hash, seen from the positions in it: a position is an anchor if some window's smallest is its own
    most = slide(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero(most == h)
    return at, h[at]


def contexts(data: bytes, at: np.ndarray) -> list[bytes]:
    """For each anchor: bytes to its left within reach (a length byte first), and to its right."""
    n = len(data)
    return [bytes((min(p, LEFT),)) + data[max(0, p - LEFT) : min(n, p + LENGTH)] for p in at.tolist()]


# deep-shallow sorting


class BlindTrie:
    """A Patricia trie over equal-length strings: inner nodes keep only where and how strings branch."""

    def __init__(self, strings: list[bytes]):
        self.s = strings
        self.root: list | int | None = None

    def insert(self, i: int) -> None:
        """Blind descent to a leaf, one comparison for the branching depth, then the split above that depth."""
        if self.root is None:
            self.root = [-1, [], [], [i]]
            return
        s, node = self.s[i], self.root
        while node[0] >= 0:
            k = min(bisect_left(node[1], s[node[0]]), len(node[1]) - 1)
            node = node[2][k]
        other = self.s[node[3][0]]
        if other == s:
            node[3].append(i)
            return
        depth = _common(s, other)
        parent, k, node = None, 0, self.root
        while node[0] >= 0 and node[0] < depth:
            parent, k = node, bisect_left(node[1], s[node[0]])
            node = node[2][k]
        leaf = [-1, [], [], [i]]
        if node[0] == depth:
            j = bisect_left(node[1], s[depth])
            node[1].insert(j, s[depth])
            node[2].insert(j, leaf)
            return
        pair = sorted([(s[depth], leaf), (other[depth], node)], key=lambda x: x[0])
        new = [depth, [c for c, _ in pair], [x for _, x in pair], []]
        if parent is None:
            self.root = new
        else:
            parent[2][k] = new

    def order(self) -> tuple[list[int], list[int]]:
        """The strings' numbers in order, and each one's common prefix with the one before it."""
        out, lcp, stack, between = [], [], [(self.root, 0)], 0
        while stack:
            node, between = stack.pop()
            if node[0] < 0:
                for k, i in enumerate(node[3]):
                    out.append(i)
                    lcp.append(between if k == 0 else len(self.s[i]))
            else:
                kids = node[2]
                for j in range(len(kids) - 1, -1, -1):
                    stack.append((kids[j], between if j == 0 else node[0]))
        return out, lcp


def _common(a: bytes, b: bytes) -> int:
    x, y = int.from_bytes(a, "big"), int.from_bytes(b, "big")
    return len(a) - ((x ^ y).bit_length() + 7) // 8


def deep_shallow(group: np.ndarray, rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of equal-length byte rows within each group, and each row's common prefix with the one before it.

    Multikey quicksort over symbols of eight bytes: rows that are still equal are partitioned by their next
    symbol, down to ``shallow`` bytes. The groups that remain are ordered by blind tries. A group's first row has -1.
    """
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    lcp = np.zeros(n, np.int64)
    own = np.ones(n, bool)
    own[1:] = group[order[1:]] != group[order[:-1]]
    lcp[own] = -1
    bound = own.copy()  # where a run of rows that are equal so far begins
    for d in range(min(shallow // 8, words.shape[1])):
        run = np.cumsum(bound) - 1
        tied = np.flatnonzero(~(bound & np.append(bound[1:], True)))
        if not len(tied):
            break
        w = words[order[tied], d]
        o = np.lexsort((w, run[tied]))
        order[tied], w = order[tied][o], w[o]
        new = tied[1:][(w[1:] != w[:-1]) & (run[tied][1:] == run[tied][:-1])]
        part = slice(8 * d, 8 * d + 8)
        lcp[new] = np.minimum(width, 8 * d + (padded[order[new], part] != padded[order[new - 1], part]).argmax(1))
        bound[new] = True
    starts = np.flatnonzero(bound)
    ends = np.append(starts[1:], n)
    for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        own_rows = order[s:e].copy()
        strings = [rows[i].tobytes() for i in own_rows]
        trie = BlindTrie(strings)
        for i in range(len(strings)):
            trie.insert(i)
        o, common = trie.order()
        order[s:e] = own_rows[o]
        lcp[s + 1 : e] = common[1:]
    return order, lcp


def repeats(group: np.ndarray, left: np.ndarray, ctx: list[bytes], first: np.ndarray) -> np.ndarray:
    """bool (n, LEFT + 1): true where a row has the window that starts r before its anchor, and a row of smaller
    ``first`` in its group has an equal one.
    """
    n = len(ctx)
    right_len = np.array([len(c) - 1 - k for c, k in zip(ctx, left.tolist(), strict=True)])
    right, back = np.zeros((n, LENGTH), np.uint8), np.zeros((n, LEFT), np.uint8)
    for i, c in enumerate(ctx):
        k = int(left[i])
        right[i, : right_len[i]] = np.frombuffer(c, np.uint8, int(right_len[i]), 1 + k)
        if k:
            back[i, :k] = np.frombuffer(c, np.uint8, k, 1)[::-1]
    ro, rl = deep_shallow(group, right)
    bo, bl = deep_shallow(group, back)
    out = np.zeros((n, LEFT + 1), bool)
    rank = np.argsort(np.argsort(first, kind="stable"))
    for r in range(LEFT + 1):
        there = np.flatnonzero((left >= r) & (right_len >= LENGTH - r))
        if len(there) < 2:
            continue
        a, b = np.empty(n, np.int64), np.empty(n, np.int64)
        a[ro], b[bo] = np.cumsum(rl < LENGTH - r), np.cumsum(bl < r)
        key = a[there] * (n + 1) + b[there]
        o = np.lexsort((rank[there], key))
        again = np.zeros(len(there), bool)
        again[o[1:]] = key[o[1:]] == key[o[:-1]]
        out[there, r] = again
    return out


def runs(again: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, start, end) of the bytes that the repeated windows of each row cover."""
    row, r = np.nonzero(again)
    if not len(row):
        return []
    # consecutive distances cover one run
    cut = np.flatnonzero((row[1:] != row[:-1]) | (r[1:] != r[:-1] + 1)) + 1
    lo, hi = np.concatenate([[0], cut]), np.append(cut, len(row)) - 1
    return list(zip(row[lo].tolist(), (at[row[lo]] - r[hi]).tolist(), (at[row[lo]] - r[lo] + LENGTH).tolist(), strict=True))


# the stages


def _ordered(t: pa.Table) -> list[tuple[int, int, bytes, int]]:
    """(doc, copy, data, rows with this id and data) in corpus order.

    copy orders the texts of an id: their number, or for an id that is dealt over many blocks its key and the number after it.
    """
    ids = t.column("doc_id").fill_null(NULL_ID).to_pylist()
    rows = sorted(zip(ids, t.column("key").to_pylist(), t.column("data").to_pylist(), t.column("hot").to_pylist(), strict=True))
    out, last, k = [], None, 0
    for (i, key, d, hot), same in groupby(rows):
        group = (i, key) if hot else i
        k = k + 1 if group == last else 0
        last = group
        out.append((i, key + k if hot else k, d, len(list(same))))
    return out


def _hashes(t: pa.Table) -> pa.Table:
    h = [anchors(np.frombuffer(d, np.uint8))[1] for _, _, d, _ in _ordered(t)]
    u, c = np.unique(np.concatenate(h), return_counts=True)
    block = t.column("block")[0].as_py()
    return pa.table({"h": u.view(np.int64), "block": pa.array(np.full(len(u), block, np.int32)), "times": c.astype(np.int64)})


def _merge(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(found):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_CONTEXT = "route long, h long, doc_id long, copy long, at long, ctx binary, until long"


def _contexts(t: pa.Table, hot: pa.Table) -> pa.Table:
    import xxhash

    cols: list[list] = [[] for _ in range(7)]
    if t.num_rows and hot.num_rows:
        known = hot.column("h").to_numpy().view(np.uint64)
        o = np.argsort(known)
        known, wide = known[o], hot.column("wide").to_numpy(zero_copy_only=False)[o]
        seen: set[tuple[int, bytes]] = set()
        for doc, copy, data, _ in _ordered(t):
            at, h = anchors(np.frombuffer(data, np.uint8))
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            keep = known[k] == h
            at, h, w = at[keep], h[keep], wide[k[keep]]
            settled = []
            one = np.flatnonzero(~w)
            send = list(zip(at[one].tolist(), h[one].view(np.int64).tolist(), contexts(data, at[one]), strict=True))
            for s in sorted({s for p in at[w].tolist() for s in range(max(0, p - LEFT), min(p, len(data) - LENGTH) + 1)}):
                c = data[s : s + LENGTH]
                send.append((s, xxhash.xxh3_64_intdigest(c) - (1 << 63), b"\0" + c))
            for p, x, c in send:
                if (x, c) in seen:
                    right = len(c) - 1 - c[0]
                    if c[0] + right >= LENGTH:
                        settled.append((p - c[0], p + min(right, LENGTH)))
                else:
                    seen.add((x, c))
                    for col, v in zip(cols, (x, x, doc, copy, p, c, None), strict=True):
                        col.append(v)
            for s, e in _merge(settled):
                for col, v in zip(cols, (hash((doc, s)) >> 1, None, doc, copy, s, None, e), strict=True):
                    col.append(v)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["route", "h", "doc_id", "copy", "at", "ctx", "until"])


def _compare(batches):
    """One task's contexts, all of each hash; runs that a block has settled pass through."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    import pyarrow.compute as pc

    done = rows.filter(pc.is_null(rows["h"]))
    if done.num_rows:
        yield from done.select(["doc_id", "copy", "at", "until"]).to_batches()
    rows = rows.filter(pc.is_valid(rows["h"])).sort_by([("h", "ascending"), ("doc_id", "ascending"), ("copy", "ascending"), ("at", "ascending")])
    del done
    h = rows["h"].to_numpy()
    doc, copy, at = rows["doc_id"].to_numpy(), rows["copy"].to_numpy(), rows["at"].to_numpy()
    edge = np.flatnonzero(np.diff(h)) + 1
    starts, ends = np.concatenate([[0], edge]), np.append(edge, len(h))
    lo = 0
    while lo < len(starts):  # some ten thousand rows at a time, whole groups
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 20_000, "right")))
        s, e = int(starts[lo]), int(ends[hi - 1])
        lo = hi
        # equal contexts: all but the first are repeats throughout
        ctx = rows["ctx"].slice(s, e - s).to_pylist()
        first: dict[tuple[int, bytes], int] = {}
        same, one = [], []
        for i, key in enumerate(zip(h[s:e].tolist(), ctx, strict=True)):
            (same if key in first else one).append(i)
            first.setdefault(key, i)
        out = []
        for i in same:
            k, right = ctx[i][0], len(ctx[i]) - 1 - ctx[i][0]
            if k + right >= LENGTH:
                out.append((i, int(at[s + i]) - k, int(at[s + i]) + min(right, LENGTH)))
        g = h[s:e][one]
        alone = np.ones(len(one), bool)
        if len(one) > 1:
            eq = g[1:] == g[:-1]
            alone[1:] &= ~eq
            alone[:-1] &= ~eq
        pick = [i for i, a in zip(one, alone, strict=True) if not a]
        if pick:
            left = np.array([ctx[i][0] for i in pick])
            again = repeats(h[s:e][pick], left, [ctx[i] for i in pick], np.array(pick))
            out += [(pick[i], a, b) for i, a, b in runs(again, at[s:e][pick])]
        if out:
            i = np.array([x[0] for x in out]) + s
            yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(copy[i]), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], ["doc_id", "copy", "at", "until"])


def _cut(t: pa.Table, found: pa.Table) -> pa.Table:
    by: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, c, s, e in zip(*(found.column(x).to_pylist() for x in ("doc_id", "copy", "at", "until")), strict=True):
        by.setdefault((d, c), []).append((s, e))
    rows: list[tuple] = []
    for doc, copy, data, times in _ordered(t):
        spans = _merge(by.get((doc, copy), []))
        sha, done = hashlib.sha256(), 0
        for s, e in spans:
            sha.update(data[done:s])
            done = e
        sha.update(data[done:])
        doc = None if doc == NULL_ID else doc
        rows.append((doc, len(data), sum(e - s for s, e in spans), len(spans), sha.hexdigest(), ",".join(f"{s}:{e}" for s, e in spans)))
        n = len(data)
        rows += (times - 1) * [(doc, n, n, 1, hashlib.sha256().hexdigest(), f"0:{n}") if n >= LENGTH else (doc, n, 0, 0, hashlib.sha256(data).hexdigest(), "")]
    cols = list(zip(*rows, strict=True)) or [()] * 6
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, (*[pa.int64()] * 4, pa.string(), pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: int = WIDE) -> DataFrame:
    """A row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (start:end in bytes, comma-joined)."""
    n = n_blocks(docs, text_col=text_col)
    d = blocked(docs, n, id_col, text_col)
    listed = d.groupBy("block").applyInArrow(_hashes, "h long, block int, times long").repartition(n, "h")
    w = W.partitionBy("h")
    hot = listed.withColumn("all", F.sum("times").over(w)).filter("all > 1").select("h", "block", (F.col("all") > wide).alias("wide"))
    sent = d.groupBy("block").cogroup(hot.groupBy("block")).applyInArrow(_contexts, _CONTEXT)
    found = sent.repartition(n, "route").mapInArrow(_compare, "doc_id long, copy long, at long, until long")
    id_of = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))
    found = found.withColumn("block", block_of(n, id_of, F.col("copy") - F.col("copy") % RANKS))
    return d.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed string")


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("removed")


#: Bytes as pairs of hexadecimal digits.
ORACLE = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i - 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 98)) AS i FROM d)),
a AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM a)),
r AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, s, e FROM r UNION ALL SELECT doc_id, len(h) // 2 + 1, len(h) // 2 + 1 FROM d),
p AS (SELECT k.doc_id, k.s, substr(h, 2 * coalesce(lag(e) OVER (PARTITION BY k.doc_id ORDER BY s, e), 1) - 1, 2 * (s - coalesce(lag(e) OVER (PARTITION BY k.doc_id ORDER BY s, e), 1))) AS part FROM k JOIN d USING (doc_id)),
t AS (SELECT doc_id, sha256(unhex(string_agg(part, '' ORDER BY s))) AS kept_sha256 FROM p GROUP BY doc_id),
n AS (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256 FROM d JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)
"""
