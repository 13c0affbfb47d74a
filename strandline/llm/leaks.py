"""Benchmark passages in documents by spaced-seed hashing.

Texts become words (ASCII white space cuts, A-Z lowered, ASCII punctuation stripped at both ends, empty words
dropped). Each mask reads some of the token positions of its span and ignores the others, so a substituted word spoils
only the masks that read it. MASKS meet in every segment of ten matches and up to three mismatches, of nine and two,
of twelve and four, and of fifteen and five. Seeds of the benchmark are held in sorted arrays behind a bit table; every
window of every document is looked up, under every mask. A hit fixes an alignment of an item with the document; the pair is a
leak if any segment along it has MIN_MATCH matches (or 80 % of the item, if less) at an identity of
MIN_IDENTITY or more; of such segments that of most matches is given. Items of MIN_ITEM to SPAN - 1 words have
masks of their own, which between them spare any one or two words that the 80 % leave room for; shorter ones never match.

The benchmark is the stated query set: it is sent to the tasks in blocks of about BLOCK_WORDS words, as many as it takes,
each against all documents. A block's arrays come to about 130 bytes a word; one block is held at a time, and released
when its leaks are written. Seeds that a text and an item repeat give their distinct alignments by shifted bit sets, not
pair by pair.

Null texts have no words, like empty ones; rows that repeat an id give one row for each item; null ids are values like
others. Very long texts are whole. Of alignments of equal matches the leftmost in the document is given. An empty table on
either side gives no rows. Extra columns are not used, and pass through ``decontaminated`` unchanged, whatever their names.
"""

from __future__ import annotations

import string
from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SPACE, WordIds, mix64, slices, stored, table, unused

MASKS = ("11010111", "11100010011", "11101101", "101000001111", "1111000101", "10111011", "110010111", "1111101")
SPAN = 11
MIN_MATCH, MIN_IDENTITY, MIN_ITEM = 10, 0.75, 4
LOSS = Fraction(str(MIN_IDENTITY))
BLOCK_WORDS = 1_000_000
#: Equal seeds of a text and the benchmark that are expanded at once; a seed of more pairs than HEAVY in one text goes by bit sets.
PAIRS, HEAVY = 1 << 20, 1 << 16
_PUNCT = string.punctuation.encode()
_MULT = mix64(np.arange(500, 564, dtype=np.uint64)) | np.uint64(1)


class PlainIds(WordIds):
    """Hash of a word without punctuation at its ends; 0 for a word of nothing else."""

    def __missing__(self, word: bytes) -> int:
        plain = word.strip(_PUNCT)
        h = WordIds.__missing__(self, word) if plain == word else (self.get(plain) or WordIds.__missing__(self, plain)) if plain else 0
        self[word] = h
        return h


def tokens(data: bytes, ids: PlainIds) -> np.ndarray:
    t = ids.of(data.lower().split())
    return t[t != 0]


def seed_hashes(t: np.ndarray, mask: str) -> np.ndarray:
    n = len(t) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, len(mask), np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(mask):
            if c == "1":
                h += t[j : j + n] * _MULT[j]
        return h * np.uint64(0x9E3779B97F4A7C15)


class Seeds:
    """Benchmark seeds of one mask: sorted hashes, and the place of each in the concatenated items."""

    def __init__(self, mask: str, items: list[tuple[int, np.ndarray]]):
        self.mask = mask
        found = [(seed_hashes(t, mask), at) for at, t in items]
        h = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.uint64)
        place = np.concatenate([np.arange(at, at + len(x)) for x, at in found]) if found else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.place = h[order], place[order].astype(np.int32)
        # a bit table, 16 to 32 bits a seed: bit h >> shift
        self.shift = np.uint64(64 - max(10, int(len(h) * 16).bit_length()))
        bits = np.zeros(1 << int(64 - int(self.shift)), bool)
        bits[self.h >> self.shift] = True
        self.bits = np.packbits(bits, bitorder="little")

    def hits(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in t, first, number) of the equal seeds in ``place``."""
        h = seed_hashes(t, self.mask)
        k = h >> self.shift
        at = np.flatnonzero(self.bits[k >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8) & 1)
        lo, hi = np.searchsorted(self.h, h[at], "left"), np.searchsorted(self.h, h[at], "right")
        some = hi > lo
        return at[some], lo[some], (hi - lo)[some]


def expanded(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... n[k] of them, for all k."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def shifts(at: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The distinct differences of places at and pos, by a bit set of one shifted by all of the other."""
    top, low = int(pos.max()), int(at.min())
    bits = np.zeros(int(at.max()) - low + 1, np.uint8)
    bits[at - low] = 1
    one, every = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"), 0
    for p in np.unique(pos).tolist():
        every |= one << (top - p)
    found = np.unpackbits(np.frombuffer(every.to_bytes(every.bit_length() // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.flatnonzero(found) + low - top


def best_segment(match: np.ndarray) -> tuple[int, int, int]:
    """(start, end, matches) of the segment of most matches at an identity of MIN_IDENTITY or more; the first of equals."""
    total = np.concatenate([[0], np.cumsum(np.where(match, LOSS.denominator - LOSS.numerator, -LOSS.numerator))])
    count = np.concatenate([[0], np.cumsum(match)])
    # the first start whose total is not above the end's
    first = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    end = int(np.argmax(count - count[first]))
    start = int(first[end])
    start += int(np.argmax(match[start:end])) if end > start else 0
    return start, end, int(count[end] - count[start])


def alignments(flat: np.ndarray, ends: np.ndarray, starts: np.ndarray, first: np.ndarray, seeds: list[Seeds]) -> np.ndarray:
    """Distinct (document, item, shift) in order: the alignments on which a seed of them is equal."""
    found: list[np.ndarray] = []

    def take(doc: np.ndarray, item: np.ndarray, shift: np.ndarray) -> None:
        x = np.stack([doc, item, shift])
        x = x[:, np.lexsort(x[::-1])]
        found.append(x[:, np.append(True, (np.diff(x) != 0).any(0))[: x.shape[1]]])

    for s in seeds:
        at, lo, n = s.hits(flat)
        doc = np.searchsorted(ends, at, "right")
        ok = at + len(s.mask) <= ends[np.minimum(doc, len(ends) - 1)] if len(at) else np.empty(0, bool)
        at, lo, n, doc = at[ok], lo[ok], n[ok], doc[ok]
        if n.sum() > PAIRS:
            order = np.lexsort((at, lo, doc))
            at, lo, n, doc = at[order], lo[order], n[order], doc[order]
            head = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(lo) != 0)))
            times = np.diff(np.append(head, len(at)))
            heavy = times * n[head] > HEAVY
            for h, k in zip(head[heavy].tolist(), times[heavy].tolist(), strict=True):
                place = s.place[lo[h] : lo[h] + n[h]].astype(np.int64)
                item = np.searchsorted(first, place, "right") - 1
                for i in np.unique(item).tolist():
                    x = shifts(at[h : h + k] - starts[doc[h]], (place - first[i])[item == i])
                    take(np.full(len(x), doc[h]), np.full(len(x), i), x)
            light = ~np.repeat(heavy, times)
            at, lo, n, doc = at[light], lo[light], n[light], doc[light]
        for i, j in slices(n, PAIRS):
            place = s.place[expanded(lo[i:j], n[i:j])].astype(np.int64)
            item = np.searchsorted(first, place, "right") - 1
            take(np.repeat(doc[i:j], n[i:j]), item, np.repeat((at - starts[np.minimum(doc, len(starts) - 1)])[i:j], n[i:j]) - (place - first[item]))
    if not found:
        return np.empty((3, 0), np.int64)
    x = np.concatenate(found, 1)
    x = x[:, np.lexsort(x[::-1])]
    return x[:, np.append(True, (np.diff(x) != 0).any(0))[: x.shape[1]]]


def leaks_in(docs: list[np.ndarray], items: list[np.ndarray], seeds: list[Seeds]) -> list[tuple[int, int, int, int, int]]:
    """(document, item, start token, end token, matches): the best leak of each document and item."""
    flat = np.concatenate(docs) if docs else np.empty(0, np.uint64)
    ends = np.cumsum([len(d) for d in docs])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in items])[:-1]]).astype(np.int64)
    doc, item, shift = alignments(flat, ends, starts, first, seeds)
    head = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(item) != 0))[: len(doc)])
    out = []
    for i, j in zip(head.tolist(), np.append(head, len(doc))[1:].tolist(), strict=True):
        d, b, best = docs[doc[i]], items[item[i]], None
        least = min(MIN_MATCH, -(-len(b) * 4 // 5))
        for k in range(i, j, 4096):
            own = shift[k : min(j, k + 4096)]
            # an overlap that is no longer than the best so far cannot beat it
            own = own[np.minimum(len(d), own + len(b)) - np.maximum(0, own) >= least]
            for x in own.tolist():
                lo, hi = max(0, x), min(len(d), x + len(b))
                if hi - lo < least:
                    continue
                match = d[lo:hi] == b[lo - x : hi - x]
                if np.count_nonzero(match) >= least:
                    start, end, n = best_segment(match)
                    if n >= least:
                        best, least = (int(doc[i]), int(item[i]), lo + start, lo + end, n), n + 1
        if best:
            out.append(best)
    return out


def masks_of(n: int) -> tuple[str, ...]:
    """Masks for an item of n words: of a short one, all words but as many groups as it may have substitutions."""
    if n >= SPAN:
        return MASKS
    groups = [range(i, i + 1 + (n > 5)) for i in range(0, n, 1 + (n > 5))]
    left = combinations(groups, n - -(-n * 4 // 5))
    return tuple(sorted({"".join("01"[all(i not in g for g in out)] for i in range(n)).strip("0") for out in left}))


def prepare(rows: list[tuple[int | None, bytes]]) -> tuple[list, list[np.ndarray], list[Seeds]]:
    ids = PlainIds()
    keys, items = [k for k, _ in rows], [tokens(x, ids) for _, x in rows]
    by_mask: dict[str, list[tuple[int, np.ndarray]]] = {m: [] for m in MASKS}
    at = 0
    for t in items:
        if len(t) >= MIN_ITEM:
            for m in masks_of(len(t)):
                by_mask.setdefault(m, []).append((at, t))
        at += len(t)
    seeds = [Seeds(m, x) for m, x in by_mask.items()]
    return keys, items, seeds


def _scan(batch):
    def run(batches):
        ids = PlainIds()
        keys, items, seeds = batch.value
        for b in batches:
            doc, data = b.column(0), b.column(1)
            for lo, hi in slices(np.asarray(pc.binary_length(data), np.int64), 1 << 20):
                found = leaks_in([tokens(x, ids) for x in data.slice(lo, hi - lo).to_pylist()], items, seeds)
                if found:
                    d, k, s, e, n = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([doc.take(pa.array([lo + i for i in d])), pa.array([keys[i] for i in k], pa.int64()), *(pa.array(x, pa.int64()) for x in (s, e, n))], ["doc_id", "item_id", "start_token", "end_token", "matched"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, start_token, end_token, matched: a row for each document and item that it leaks."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    items = benchmark.select(F.col(item_col).cast("long").alias("k"), F.col(item_text).cast("string").alias("x")).filter("x is not null")
    total = items.select(F.sum(F.size(F.split("x", f"[{SPACE}]+")))).first()[0] or 0
    n = max(1, -(-total // block_words))
    parts = []
    for i in range(n):
        rows = items.filter(F.pmod(F.xxhash64("k", "x"), F.lit(n)) == i).collect()
        block = spark.sparkContext.broadcast(prepare([(r["k"], r["x"].encode()) for r in rows]))
        part = d.mapInArrow(_scan(block), "doc_id long, item_id long, start_token long, end_token long, matched long")
        if n > 1:  # this block's leaks are written before the next block is built
            part = stored(part)
            block.destroy()
        parts.append(part)
    # rows that repeat a document or an item
    out = reduce(DataFrame.union, parts)
    return out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("start_token", "end_token", "matched"), F.struct("matched", -F.col("start_token"))).alias("x")).select("doc_id", "item_id", "x.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that leak an item."""
    (leak,) = unused(docs, "_leak")
    found = stored(leaks(docs, benchmark).select(F.col("doc_id").alias(leak)).distinct())
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(leak)), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
