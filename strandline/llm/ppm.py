"""Scoring by prediction by partial matching, with a unigram base.

The model is a trie of byte contexts up to ORDER bytes, counted over the training documents. A symbol is a byte or
the end of the text; a text is preceded by start symbols. At the longest context that was seen, a seen symbol has
c / (n + d), an escape d / (n + d) (n occurrences, d distinct symbols: method C). After an escape the
symbols of the longer context are excluded: the next shorter context counts only the others. Last, the
symbols never seen share what is left. Contexts nest, so what an escape excludes depends on its
context alone, and a trie node's code length is the same wherever it is met: it is computed once.

Documents are dealt into blocks by id and text, the trie and the words into parts: a gram of ORDER + 1 symbols by its last two context
symbols, so that a part has all contexts of two and more symbols that its grams need, a word by its hash. A block
sends each part its distinct grams and words with their training counts, as sorted arrays; the part adds the
counts up, computes the code lengths and sends each block its answers in the order it asked. Shorter contexts are one
table of 258 x 257 counts. All that is gathered grows with the corpus and is spread over the tasks.
Words are known by 128-bit hashes.

Null text is empty: just its end. A null id has the text ''. Rows that repeat an id are scored each, equal ones alike; only
rows equal in id and text share a block for sure. A text of any length is scored whole, in one block. Extra columns are
not used. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import block_of, mix64, n_blocks, slices, stored, table

ORDER, FOLDS, FOLD = 5, 7, 2
END, START, SYMBOLS, BITS = 256, 257, 257, 9
BLOCK_BYTES = 8 << 20
GRAM, WORD = 0, 1
_CHUNK = 1 << 20


def stream(datas: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the texts' symbols with their contexts (nearest symbols lowest), and each text's number of symbols."""
    sizes = np.array([len(d) for d in datas], np.int64) + 1
    s = np.full(int(sizes.sum()) + order * len(datas), START, np.uint64)
    at = np.concatenate([[0], np.cumsum(sizes + order)[:-1]]) + order
    real = np.zeros(len(s), bool)
    for d, k in zip(datas, at.tolist(), strict=True):
        s[k : k + len(d)] = np.frombuffer(d, np.uint8)
        s[k + len(d)] = END
        real[k : k + len(d) + 1] = True
    key = s.copy()
    for j in range(1, order + 1):
        key[j:] |= s[:-j] << np.uint64(BITS * j)
    return key[real], sizes


def code_lengths(key: np.ndarray, count: np.ndarray, low: np.ndarray, order: int) -> np.ndarray:
    """log10 probability of each gram. key: distinct grams, all of any last two context symbols that occur;
    low: training counts (258, 257) of (previous symbol, symbol).
    """
    own = lambda j: key & np.uint64((1 << BITS * (j + 1)) - 1)
    sym, prev = (key & np.uint64(511)).astype(np.int64), ((key >> np.uint64(BITS)) & np.uint64(511)).astype(np.int64)
    c: dict[int, np.ndarray] = {0: low.sum(0)[sym], 1: low[prev, sym]}
    n = {0: np.full(len(key), low.sum()), 1: low.sum(1)[prev]}
    seen = low > 0
    d = {0: np.full(len(key), (low.sum(0) > 0).sum()), 1: seen.sum(1)[prev]}
    x = {1: (seen * low.sum(0)[None, :]).sum(1)[prev]}
    for j in range(2, order + 1):
        gram, first, inv = np.unique(own(j), return_index=True, return_inverse=True)
        total = np.bincount(inv, weights=count, minlength=len(gram)).astype(np.int64)
        ctx, at = np.unique(gram >> np.uint64(BITS), return_inverse=True)
        sums = lambda w: np.bincount(at, weights=w, minlength=len(ctx)).astype(np.int64)  # noqa: B023, E731
        row = at[inv]
        c[j], n[j], d[j] = total[inv], sums(total)[row], sums(total > 0)[row]
        x[j] = sums((total > 0) * c[j - 1][first])[row]
    out = np.zeros(len(key))
    open_, entered = np.ones(len(key), bool), np.zeros(len(key), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for j in range(order, -1, -1):
            den, esc = n[j] + d[j], d[j]
            if j < order:
                den = np.where(entered, den - x[j + 1] - d[j + 1], den)
                esc = np.where(entered, esc - d[j + 1], esc)
            here = open_ & (n[j] > 0)
            hit = here & (c[j] > 0)
            out[hit] += np.log10(c[j][hit] / den[hit])
            miss = here & ~hit & (den > 0)
            out[miss] += np.log10(esc[miss] / den[miss])
            open_ &= ~hit
            entered |= here
        out[open_] -= np.log10(SYMBOLS - d[0][open_])
    return out


def _pairs(batches):
    """Training counts of (previous symbol, symbol)."""
    total = np.zeros((START + 1) << BITS, np.int64)
    for b in batches:
        data = b.column(0)
        for lo, hi in slices(_sizes(data), _CHUNK):
            total += np.bincount(stream(data.slice(lo, hi - lo).to_pylist(), 1)[0].astype(np.int64), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "c"])


def _sizes(data: pa.BinaryArray) -> np.ndarray:
    return np.diff(np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4))


class Block:
    """A block's texts with its distinct grams and words, numbered alike whenever the block is read: rows in the order of
    (doc_id, text), grams and words in the order they first occur.
    """

    def __init__(self, t: pa.Table, order: int):
        import pandas as pd

        ids, data = t.column("doc_id").to_pylist(), t.column("data").to_pylist()
        rows = sorted(range(t.num_rows), key=lambda i: (ids[i] is not None, ids[i] or 0, data[i]))
        del data
        self.t = t.take(pa.array(rows, pa.int64()))
        self.data = self.t.column("data").combine_chunks()
        self.held = np.asarray(self.t.column("held_out"))
        self.parts = list(slices(_sizes(self.data), _CHUNK))
        firsts, self.count = [], []
        for lo, hi in self.parts:
            key, sizes = stream(self.texts(lo, hi), order)
            code, u = pd.factorize(key)
            firsts.append(u)
            self.count.append(np.bincount(code[np.repeat(~self.held[lo:hi], sizes)], minlength=len(u)))
        at, self.grams = pd.factorize(np.concatenate(firsts))
        self.at = np.split(at, np.cumsum([len(u) for u in firsts])[:-1])  # number of each chunk's distinct grams

    def texts(self, lo: int, hi: int) -> list[bytes]:
        return self.data.slice(lo, hi - lo).to_pylist()

    def words(self) -> dict[bytes, int]:
        """Training counts of the distinct words, in the order they first occur."""
        from collections import Counter

        known: Counter = Counter()
        for lo, hi in self.parts:
            for text, held in zip(self.texts(lo, hi), self.held[lo:hi].tolist(), strict=True):
                w = text.lower().split()
                known.update(dict.fromkeys(w, 0) if held else w)
        return known


def _digests(words) -> np.ndarray:
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2)


def _runs(part: np.ndarray, *keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(part, members) with the members in the order of the keys, the last key first."""
    o = np.lexsort((*keys, part))
    edge = np.flatnonzero(np.diff(part[o])) + 1
    return [(int(part[x[0]]), x) for x in np.split(o, edge)] if len(o) else []


def _plan(grams: np.ndarray, words: np.ndarray, n_parts: int) -> list[tuple[int, int, np.ndarray]]:
    """(kind, part, members): what a block asks each part for, in the order of the answers."""
    with np.errstate(over="ignore"):
        near = mix64((grams >> np.uint64(BITS)) & np.uint64((1 << 2 * BITS) - 1)) % np.uint64(n_parts)
        own = words[:, 0] % np.uint64(n_parts)
    return [(GRAM, p, x) for p, x in _runs(near, grams)] + [(WORD, p, x) for p, x in _runs(own, words[:, 1], words[:, 0])]


def _ask(order: int, n_parts: int):
    def run(t: pa.Table) -> pa.Table:
        x = Block(t, order)
        c = np.bincount(np.concatenate(x.at), weights=np.concatenate(x.count)).astype(np.int64)
        known = x.words()
        words, m = _digests(known), np.fromiter(known.values(), np.int64, len(known))
        rows = []
        for kind, p, x_ in _plan(x.grams, words, n_parts):
            # sorted keys are sent as differences, which compress
            key = np.diff(x.grams[x_], prepend=np.uint64(0)).tobytes() if kind == GRAM else np.diff(words[x_, 0], prepend=np.uint64(0)).tobytes() + words[x_, 1].tobytes()
            rows.append((p, kind, key, (c if kind == GRAM else m)[x_].tobytes()))
        p, kind, key, count = zip(*rows, strict=True) if rows else [()] * 4
        block = t.column("block")[0].as_py()
        return pa.table({"part": pa.array(p, pa.int32()), "block": pa.array([block] * len(p), pa.int32()), "kind": pa.array(kind, pa.int8()), "keys": pa.array(key, pa.binary()), "counts": pa.array(count, pa.binary())})

    return run


def _answer(low: np.ndarray, order: int):
    def run(t: pa.Table) -> pa.Table:
        out, kinds, blocks = [], t.column("kind").to_pylist(), t.column("block").to_pylist()
        keys, counts = t.column("keys").to_pylist(), t.column("counts").to_pylist()
        rows, distinct = [], 0
        for kind in (GRAM, WORD):
            own = [i for i, k in enumerate(kinds) if k == kind]
            if not own:
                continue
            c = np.concatenate([np.frombuffer(counts[i], np.int64) for i in own])
            sizes = [len(counts[i]) // 8 for i in own]
            if kind == GRAM:
                k = np.concatenate([np.cumsum(np.frombuffer(keys[i], np.uint64), dtype=np.uint64) for i in own])
                u, inv = np.unique(k, return_inverse=True)
                v = code_lengths(u, np.bincount(inv, weights=c).astype(np.int64), low, order)[inv].astype(np.float32)
            else:
                k = np.concatenate([np.rec.fromarrays([np.cumsum(np.frombuffer(keys[i], np.uint64, n), dtype=np.uint64), np.frombuffer(keys[i], np.uint64, n, 8 * n)]) for i, n in zip(own, sizes, strict=True)])
                o = np.lexsort((k["f1"], k["f0"]))
                new = np.ones(len(o), bool)
                new[1:] = k[o[1:]] != k[o[:-1]]
                inv = np.empty(len(o), np.int64)
                inv[o] = np.cumsum(new) - 1
                total = np.bincount(inv, weights=c).astype(np.int64)
                distinct, v = int((total > 0).sum()), total[inv]
            for i, x in zip(own, np.split(v, np.cumsum(sizes)[:-1]), strict=True):
                rows.append((blocks[i], kind, x.tobytes()))
        part = t.column("part")[0].as_py()
        b, kind, v = zip(*rows, strict=True)
        out = [distinct] + [0] * (len(rows) - 1)  # a part's distinct training words ride on one of its answers
        return pa.table({"block": pa.array(b, pa.int32()), "part": pa.array([part] * len(b), pa.int32()), "kind": pa.array(kind, pa.int8()), "v": pa.array(v, pa.binary()), "distinct": pa.array(out, pa.int64())})

    return run


def _score(order: int, n_train: int, n_parts: int):
    def run(t: pa.Table, answer: pa.Table) -> pa.Table:
        import pandas as pd

        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_sum", "score", "owned"]
        if not t.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)})
        x = Block(t, order)
        known = x.words()
        got = {(k, p): v for k, p, v in zip(*(answer.column(c).to_pylist() for c in ("kind", "part", "v")), strict=True)}
        owned = np.zeros(t.num_rows, np.int64)
        owned[0] = sum(answer.column("distinct").to_pylist())
        log, total = np.empty(len(x.grams)), np.empty(len(known), np.int64)
        for kind, p, o in _plan(x.grams, _digests(known), n_parts):
            if kind == GRAM:
                log[o] = np.frombuffer(got[kind, p], np.float32)
            else:
                total[o] = np.frombuffer(got[kind, p], np.int64)
        del got, answer
        number = dict(zip(known, np.log10(total + 1.0).tolist(), strict=True))
        cols: list[list] = [[], [], [], []]
        end = math.log10(n_train + 1)
        for (lo, hi), at in zip(x.parts, x.at, strict=True):
            texts = x.texts(lo, hi)
            key, sizes = stream(texts, order)
            code, _ = pd.factorize(key)
            cols[3] += np.add.reduceat(log[at][code], np.concatenate([[0], np.cumsum(sizes)[:-1]])).tolist()
            for text in texts:
                found = list(map(number.__getitem__, text.lower().split()))
                cols[0].append(len(found) + 1)
                cols[1].append(len(found) - found.count(0.0) + (n_train > 0))
                cols[2].append(math.fsum(found) + end)
        types = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.Table.from_arrays([x.t.column("doc_id"), x.t.column("held_out"), *(pa.array(c, k) for c, k in zip(cols, types, strict=True)), pa.array(owned)], names)

    return run


def scores(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, fold: int = FOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A document is held out if crc32 of its id's text, modulo folds, is fold; the others are the training set.
    """
    n = n_blocks(docs, BLOCK_BYTES, text_col)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    d = docs.select(block_of(n, F.col(id_col), F.col(text_col)).alias("block"), F.col(id_col).cast("long").alias("doc_id"), (F.crc32(name) % folds == fold).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    low = np.zeros((START + 1, SYMBOLS), np.int64)
    for r in d.filter(~F.col("held_out")).select("data").mapInArrow(_pairs, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).collect():  # at most 258 * 257 rows
        low[r["pair"] >> BITS, r["pair"] & 511] = r["c"]
    n_train = int(low[:, END].sum())
    d = d.repartition(n, "block")
    parts = 2 * n
    asked = d.groupBy("block").applyInArrow(_ask(order, parts), "part int, block int, kind byte, keys binary, counts binary").repartition(n, "part")
    answer = asked.groupBy("part").applyInArrow(_answer(low, order), "block int, part int, kind byte, v binary, distinct long")
    out = d.groupBy("block").cogroup(answer.groupBy("block")).applyInArrow(_score(order, n_train, parts), "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double, owned long")
    out = stored(out)
    size = out.agg(F.sum("owned").alias("v"), F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))).alias("n")).first()
    v, total = (size["v"] or 0) + (n_train > 0), size["n"] or 0
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base_sum") - F.col("n_tokens") * math.log10(total + v + 1)).alias("base_score"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
