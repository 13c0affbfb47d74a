"""Repeated passages of words by difference-cover anchors.

Every word covered by a LENGTH-word window whose word sequence also starts anywhere else is removed, the first occurrence
too. Of a document's positions only those at cover residues modulo PERIOD are hashed. The residues' differences give every
number modulo PERIOD, so any two equal windows, wherever they start, hold some pair of hashed positions at one distance
from their starts; the KEY = LENGTH - PERIOD + 1 words from there lie in both windows. So:

1. Each block of documents lists the hashes of its anchors (KEY words at a cover position), each once, with whether it
   occurs twice there. Counted over all blocks, anchors that occur once anywhere are done with.
2. The others are extended: each window that holds a repeated anchor goes by a 96-bit fingerprint of all its words, again
   once a block, and is counted over all blocks.
3. The places of windows that occur twice go back to their blocks, which cut the words that these and their equals cover.

A key (anchor or window) has at most one row a block, however many documents hold it, so a passage in a third of all
documents adds no more than that to a task. Blocks grow with the input, up to BLOCK_BYTES * GROW file bytes. Fingerprints
of 10^12 windows agree by chance with probability below 10^-5.

Defined cases: null text has no words; a text shorter than a window stays whole; a very long text is one array in its block;
rows that repeat an id are documents of their own, and rows equal in id and text are counted once and compared as so many,
whichever task they came from; a null id stays null; extra columns are not used; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import block_of, grown_blocks, mix64, table, tallied

LENGTH = 35
#: A perfect difference set (fixed values): every residue but 0 is one difference of two of them.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
ROWS = 65_536
_BASE, _SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def is_cover(period: int, cover: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def prints(words: np.ndarray, n: int, base: int = _BASE) -> np.ndarray:
    """64-bit fingerprints of the n words from each position, by doubling; the last n - 1 positions have none."""
    with np.errstate(over="ignore"):
        part, power, size, out, done = words, base, 1, None, 0
        while size <= n:
            if n & size:  # the next size words after those done
                tail = part[done:]
                out = tail if out is None else out[: len(tail)] * np.uint64(power) + tail
                done += size
            part, power, size = part[:-size] * np.uint64(power) + part[size:], power * power & (1 << 64) - 1, size * 2
        return mix64(out[: max(0, len(words) - n + 1)])


SPACES = np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))
#: Bytes hashed at once; a longer word has a hash of its own kind.
CHUNK = 1 << 20
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_SECOND))


@functools.cache
def _powers(base: int) -> np.ndarray:
    """base^0 to base^CHUNK modulo 2^64."""
    with np.errstate(over="ignore"):
        out, power = np.ones(1, np.uint64), base
        while len(out) <= CHUNK:
            out, power = np.concatenate([out, out * np.uint64(power)]), power * power & (1 << 64) - 1
        return out


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text (bytes that end in a space) begins, and its 64-bit hash: the sum of its bytes' random numbers by powers,
    from a running sum.
    """
    inner = ~SPACES[text]
    edge = np.flatnonzero(np.diff(inner, prepend=False))
    s, e = edge[::2], edge[1::2]
    out = np.zeros(len(s), np.uint64)
    up, down = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
    k = 0
    with np.errstate(over="ignore"):
        while k < len(s):
            to = max(k, int(np.searchsorted(e, s[k] + CHUNK, "right")))
            if to == k:
                out[k], k = xxhash.xxh3_64_intdigest(text[s[k] : e[k]].tobytes()), k + 1
                continue
            part = text[s[k] : e[to - 1]]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[part] * up[: len(part)])])
            a, b = s[k:to] - s[k], e[k:to] - s[k]
            out[k:to] = (total[b] - total[a]) * down[a]
            k = to
    return s, mix64(out)


class Words:
    """The words of a block's documents end to end: their hashes, where each document begins, and the rows each stands for.

    A shuffle brings a block's rows in any order, and places must mean the same in each pass: documents are put in order of id and text.
    """

    def __init__(self, t: pa.Table):
        parts, self.raw = [], []
        ids, data = t.column("doc_id").to_pylist(), t.column("data").to_pylist()
        o = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, data[i]))
        self.ids, self.data = [ids[i] for i in o], [data[i] for i in o]
        at, self.hash = word_hashes(np.frombuffer(b" ".join([*self.data, b""]), np.uint8))
        end = np.cumsum([len(d) + 1 for d in self.data], dtype=np.int64)
        self.size = np.diff(np.searchsorted(at, end), prepend=0)
        self.start = np.cumsum(self.size) - self.size
        self.times = t.column("times").to_numpy()[o] if o else np.empty(0, np.int64)

    def starts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions from which a document has n words more, and the document of each."""
        many = np.maximum(self.size - n + 1, 0)
        doc = np.repeat(np.arange(len(many)), many)
        return np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + self.start[doc], doc


def _once(keys: list[np.ndarray], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each distinct key, and whether its rows stand for two occurrences or more."""
    if not len(times):
        return np.empty(0, np.int64), np.empty(0, bool)
    o = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(o), bool)
    new[1:] = np.any([k[o][1:] != k[o][:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return o[at], np.add.reduceat(np.minimum(times[o], 2), at) > 1


def _block(t: pa.Table) -> int | None:
    return t.column("block")[0].as_py() if t.num_rows else None


def repeated_words(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, n_words, n_removed, kept (the other words, joined by one space), removed (start:end in words,
    comma-joined).
    """
    if not is_cover(period, cover) or not period <= length:
        raise ValueError("the cover's differences must give every number modulo the period, and a window must hold a period")
    key, inside = length - period + 1, np.isin(np.arange(period), cover)

    def anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, documents and hashes of a block's anchors; a document without a window has none."""
        at, doc = w.starts(key)
        keep = inside[(at - w.start[doc]) % period] & (w.size[doc] >= length)
        return at[keep], doc[keep], prints(w.hash, key)[at[keep]]

    def windows(w: Words, at: np.ndarray) -> list[np.ndarray]:
        """The 96-bit fingerprints of the windows at some positions, as 64 and 32 bits."""
        return [prints(w.hash, length)[at], (prints(w.hash, length, _SECOND)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)]

    def listed(t: pa.Table) -> pa.Table:
        w = Words(t)
        _, doc, h = anchors(w)
        at, twice = _once([h], w.times[doc])
        return pa.table({"h": h[at].view(np.int64), "block": np.full(len(at), _block(t) or 0, np.int32), "twice": twice})

    def extended(t: pa.Table, hot: pa.Table) -> pa.Table:
        w = Words(t if hot.num_rows else t.slice(0, 0))
        at, doc, h = anchors(w)
        known = np.isin(h, hot.column("h").to_numpy().view(np.uint64))
        at, doc = at[known], doc[known]
        # windows that start up to length - key words before a repeated anchor, within its document
        edge = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(edge, np.maximum(at - (length - key), w.start[doc]), 1)
        np.add.at(edge, at + 1, -1)
        s, owner = w.starts(length)
        near = np.cumsum(edge)[s] > 0
        s, owner = s[near], owner[near]
        f, g = windows(w, s)
        first, twice = _once([f, g], w.times[owner])
        return pa.table({"f": f[first].view(np.int64), "g": g[first], "block": np.full(len(first), _block(t) or 0, np.int32), "at": (2 * s[first] + twice).astype(np.int32)})

    def cut(t: pa.Table, found: pa.Table) -> pa.Table:
        w = Words(t)
        gone = np.zeros(len(w.hash) + 1, np.int64)
        if found.num_rows:
            s, _ = w.starts(length)
            f, g = windows(w, np.arange(max(0, len(w.hash) - length + 1)))
            at = found.column("at").to_numpy() >> 1
            at = at[np.lexsort((g[at], f[at]))]
            place = np.searchsorted(f[at], f[s])
            hit = np.zeros(len(s), bool)
            for k in range(int(np.unique(f[at], return_counts=True)[1].max())):  # once, but for two windows equal in f alone
                there = at[np.minimum(place + k, len(at) - 1)]
                hit |= (f[there] == f[s]) & (g[there] == g[s])
            np.add.at(gone, s[hit], 1)
            np.add.at(gone, s[hit] + length, -1)
        covered = np.cumsum(gone)[:-1] > 0
        rows: list[tuple] = []
        for i, data in enumerate(w.data):
            words = data.split()
            c = covered[w.start[i] : w.start[i] + len(words)]
            turn = np.flatnonzero(np.diff(np.concatenate([[False], c, [False]]))).tolist()
            spans = list(zip(turn[::2], turn[1::2], strict=True))
            kept, done = [], 0
            for s, e in spans:
                kept += words[done:s]
                done = e
            rows.append((len(words), sum(e - s for s, e in spans), b" ".join(kept + words[done:]), ",".join(f"{s}:{e}" for s, e in spans)))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        new = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)]
        return pa.Table.from_arrays([pa.array(w.ids, pa.int64()), *new, pa.array(w.times, pa.int64())], ["doc_id", "n_words", "n_removed", "kept", "removed", "times"])

    n = grown_blocks(docs, text_col=text_col)
    d = tallied(docs, n, id_col, text_col)
    d = d.withColumn("block", block_of(n, "doc_id", "data")).repartition(n, "block")
    again = lambda df, twice, *k: df.withColumn("rows", F.sum(F.when(twice, 2).otherwise(1)).over(W.partitionBy(*k))).filter("rows > 1")
    hot = again(d.groupBy("block").applyInArrow(listed, "h long, block int, twice boolean").repartition(n, "h"), F.col("twice"), "h").select("h", "block")
    sent = d.groupBy("block").cogroup(hot.groupBy("block")).applyInArrow(extended, "f long, g int, block int, at int")
    # a window goes back by its place alone
    found = again(sent.repartition(n, "f"), F.col("at") % 2 == 1, "f", "g").select("block", "at")
    out = d.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary, removed string, times long")
    # a row for each that was counted, ROWS at a time
    part = F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(ROWS).cast("long"))
    out = out.withColumn("part", F.explode(part)).withColumn("part", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(ROWS), F.col("times") - F.col("part")).cast("int"))))
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept"), "removed")


def query(spark, sf_dir: str) -> DataFrame:
    r = repeated_words(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') AS w FROM documents),
s AS (SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
a AS MATERIALIZED (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS k FROM s) WHERE k > 1),
p AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
c AS (SELECT p.r, p.i, word, coalesce(sum(CASE WHEN a.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) > 0 AS gone FROM p LEFT JOIN a ON a.r = p.r AND a.i = p.i),
t AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""
