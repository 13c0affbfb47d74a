"""Texts to token ids with the tokenizers library, each distinct word encoded once.

A word's ids do not depend on its neighbours where a pre-tokenizer cuts at white space, so the library
encodes each distinct word once a worker and texts are put together from the cached ids. For byte-level BPE a cut
is safe at a single space or line feed between non-space characters; a text with any other white space
goes to the library whole, and so does a text that holds the string of one of the tokenizer's added tokens. The ids are
those of the plain library call with ``add_special_tokens=False``.
"""

from __future__ import annotations

import os
import string
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import slices

#: Words a worker holds; beyond them it starts anew.
WORDS = 600_000
#: Bytes of text that are cut into words at once.
CUT_BYTES = 6 << 20
#: A word that splits the library's answer; words that hold it are encoded alone.
MARK = "\x01"
PUNCTUATION = string.punctuation
#: Letters that normalisation leaves alone and whose lower case has as many bytes; a word of them is one pre-token.
LETTERS = r"[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{239}\x{23B}-\x{23D}\x{23F}-\x{24F}]+"
#: Byte-level BPE writes each byte as a character: the printable ones as themselves, the rest from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_ENCODERS: dict = {}


def encoder(path: str, byte_level: bool) -> Encoder:
    """This Python worker's encoder: its words outlive the task."""
    if (path, byte_level) not in _ENCODERS:
        _ENCODERS[path, byte_level] = Encoder(path, byte_level)
    return _ENCODERS[path, byte_level]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine: the default of the operators' path parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids:
    """Runs of ids in one flat array, by number."""

    def __init__(self, dtype: str):
        self.flat, self.at, self.n = np.empty(1 << 16, dtype), np.zeros(1 << 12, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        used, most = int(self.at[self.n]), self.n + len(sizes)
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while most >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[used : used + len(ids)] = ids
        self.at[self.n + 1 : most + 1] = used + np.cumsum(sizes)
        self.n = most

    def sizes(self, which: np.ndarray) -> np.ndarray:
        return self.at[which + 1] - self.at[which]

    def put(self, out: np.ndarray, to: np.ndarray, which: np.ndarray) -> None:
        """out[to[k]...] = run which[k], for all k."""
        n = self.sizes(which)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to, n) + step] = self.flat[np.repeat(self.at[which], n) + step]


#: Ids one after another, and how many each word has.
Runs = tuple[array, array]


class Encoder:
    """texts -> ids as little-endian bytes of ``dtype``; uint16 where the vocabulary fits."""

    def __init__(self, path: str, byte_level: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.added = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.byte_level = byte_level
        self.dtype = id_dtype(self.t.get_vocab_size(with_added_tokens=True))
        self.kind = "H" if self.dtype == "<u2" else "I"
        self.plain = f"^\n?{LETTERS}$" if byte_level else f"^{LETTERS}$"
        self.mark = np.asarray(self.raw(["\n" if byte_level else MARK])[0], self.dtype)
        self.tails, self.tail_ids = {"": 0}, Ids(self.dtype)
        self.tail_ids.add(self.mark[:0], np.zeros(1, np.int64))
        self._clear()

    def _clear(self) -> None:
        # word -> its number in ids; number 0 has no ids and stands for a word that the cut may not cross
        self.words, self.ids = {}, Ids(self.dtype)
        self.ids.add(self.mark[:0], np.zeros(1, np.int64))

    def raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, words: list[str], space: str, out: Runs) -> None:
        """Words of LETTERS are one pre-token each and go straight to the library's model."""
        tokenize, lead = self.t.model.tokenize, "\u0120" if space else ""
        ids, sizes = out
        for w in words:
            form = w if w.isascii() else w.encode().decode("latin-1").translate(BYTES)
            got = [x.id for x in tokenize(lead + form)]
            ids.extend(got)
            sizes.append(len(got))

    def _library(self, words: list[str], space: str, out: Runs) -> None:
        """Other words go to the whole library in one call, a mark that no word holds between them."""
        ids, sizes = out
        mark, join = self.mark.tolist(), f"\n{space}" if self.byte_level else f" {MARK} "
        got = np.asarray(self.raw([space + join.join(words)])[0] if words else [], np.int64)
        at = np.flatnonzero(got == mark[0])
        if words and len(mark) == 1 and len(at) == len(words) - 1:
            ids.extend(np.delete(got, at).tolist())
            sizes.extend(np.diff(np.concatenate([[-1], at, [len(got)]])) - 1)
        else:
            for x in self.raw([space + w for w in words]):
                ids.extend(x)
                sizes.append(len(x))

    def _learn(self, words: list[str], plain: list[bool]) -> None:
        """Add the words: plain ones by the model, others by the library, ones that the cut may not cross as number 0."""
        rest = [w for w, p in zip(words, plain, strict=True) if not p]
        later, first = [w for w, p in zip(words, plain, strict=True) if p], []
        if self.byte_level:
            later, first = [w for w in later if w[0] != "\n"], [w[1:] for w in later if w[0] == "\n"]
            rest_first = [w[1:] for w in rest if w[:1] == "\n" and w[1:].split() == [w[1:]]]
            rest_later = [w for w in rest if w.split() == [w]]
            self.words |= dict.fromkeys(set(rest).difference(rest_later, (f"\n{w}" for w in rest_first)), 0)
        else:
            rest_first = [w for w in rest if not w or MARK in w]
            rest_later = [w for w in rest if w and MARK not in w]
        space, lead, mark = (" ", "\n", self.mark) if self.byte_level else ("", "", self.mark[:0])
        got: Runs = (array(self.kind), array("q"))
        self._model(later, space, got)
        self._library(rest_later, space, got)
        self._add([*later, *rest_later], got, mark[:0])
        got = (array(self.kind), array("q"))
        self._model(first, "", got)
        if self.byte_level:
            self._library(rest_first, "", got)
        else:
            for x in self.raw(rest_first):
                got[0].extend(x)
                got[1].append(len(x))
        self._add([lead + w for w in (*first, *rest_first)], got, mark)

    def _add(self, words: list[str], runs: Runs, mark: np.ndarray) -> None:
        """The words' runs, each with ``mark`` before it."""
        flat, sizes = np.frombuffer(runs[0], self.dtype), np.frombuffer(runs[1], np.int64)
        self.words.update(zip(words, range(self.ids.n, self.ids.n + len(words)), strict=True))
        self.ids.add(np.insert(flat, np.cumsum(sizes) - sizes, mark[0]) if len(mark) else flat, sizes + len(mark))

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each of the distinct words, the new ones learnt."""
        names = words.to_numpy(zero_copy_only=False).tolist()
        out = np.fromiter(map(self.words.get, names, repeat(-1)), np.int64, len(names))
        fresh = np.flatnonzero(out < 0)
        if len(fresh):
            plain = pc.match_substring_regex(words.take(pa.array(fresh)), self.plain).to_numpy(zero_copy_only=False).tolist()
            new = [names[k] for k in fresh.tolist()]
            self._learn(new, plain)
            out[fresh] = np.fromiter(map(self.words.__getitem__, new), np.int64, len(new))
        return out

    def _tails(self, words: pa.Array, cores: pa.Array) -> np.ndarray:
        """The number of each word's part behind its core."""
        start, n = np.asarray(pc.binary_length(cores), np.int64), np.asarray(pc.binary_length(words), np.int64)
        begin = np.concatenate([[0], np.cumsum(n)[:-1]]) + start
        size = n - start
        ends = np.concatenate([[0], np.cumsum(size)])
        offsets, data = words.buffers()[1:3]
        first = np.frombuffer(offsets, np.int32)[words.offset]
        data = np.frombuffer(data, np.uint8)[first:] if data else np.zeros(0, np.uint8)
        picked = data[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        tails = pa.StringArray.from_buffers(len(words), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(picked))).dictionary_encode()
        names = tails.dictionary.to_pylist()
        fresh = [x for x in names if x not in self.tails]
        if fresh:
            ids = self.raw(fresh)
            self.tails.update(zip(fresh, range(self.tail_ids.n, self.tail_ids.n + len(fresh)), strict=True))
            self.tail_ids.add(np.asarray([i for x in ids for i in x], self.dtype), np.asarray([len(x) for x in ids]))
        return np.asarray([self.tails[x] for x in names], np.int64)[tails.indices.to_numpy()]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text, a bounded number of bytes at a time."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out: list[bytes] = []
        for lo, hi in slices(np.asarray(pc.binary_length(texts), np.int64), CUT_BYTES):
            out += self._encode(texts.slice(lo, hi - lo))
        return out

    def _encode(self, texts: pa.Array) -> list[bytes]:
        """Arrow cuts the texts, numbers the distinct words and takes punctuation off their ends; only distinct cores meet the cache."""
        if len(self.words) > WORDS:
            self._clear()
        whole = np.zeros(len(texts), bool)
        for x in self.added:
            whole |= np.asarray(pc.match_substring(texts, x), bool)
        cut = pc.if_else(pa.array(whole), pa.scalar(""), texts) if whole.any() else texts
        if self.byte_level:
            # a line feed stands for a text's start, its id is cut off again below; each line feed begins a word
            cut = pc.binary_join_element_wise(pa.scalar(""), cut, pa.scalar("\n"))
            cut = pc.split_pattern(pc.utf8_slice_codeunits(pc.replace_substring(cut, "\n", " \n"), 1), " ")
        else:
            cut = pc.split_pattern(pc.replace_substring(cut, "\n", " "), " ")
        ends, words = np.asarray(cut.offsets) - cut.offsets[0].as_py(), cut.flatten().dictionary_encode()
        which, words = words.indices.to_numpy(), words.dictionary
        cores = pc.utf8_rtrim(words, PUNCTUATION)
        plain = pc.match_substring_regex(cores, self.plain)
        cores = pc.if_else(plain, cores, words)
        keys = (cores if self.byte_level else pc.if_else(plain, pc.utf8_lower(cores), words)).dictionary_encode()
        tail = self._tails(words, cores)
        core = self._numbers(keys.dictionary)[keys.indices.to_numpy()]
        n_core = self.ids.sizes(core)
        size = n_core + self.tail_ids.sizes(tail)
        start = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), self.dtype)
        self.ids.put(flat, start, core)
        self.tail_ids.put(flat, start + n_core, tail)
        n = size[which]
        at = np.concatenate([[0], np.cumsum(n)])
        data = flat[np.repeat(start[which] - at[:-1], n) + np.arange(at[-1])].tobytes()
        width = flat.itemsize
        bounds, skip = (at[ends] * width).tolist(), len(self.mark) * width if self.byte_level else 0
        out = [data[s + skip : e] for s, e in zip(bounds, bounds[1:], strict=False)]
        if self.byte_level:
            odd = np.concatenate([[0], np.cumsum(core[which] == 0)])[ends]
            whole |= odd[1:] > odd[:-1]
        if whole.any():
            rows = np.flatnonzero(whole).tolist()
            for k, x in zip(rows, self.raw(texts.take(pa.array(rows)).to_pylist()), strict=True):
                out[k] = np.asarray(x, self.dtype).tobytes()
        return out


def id_dtype(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def before(totals: DataFrame, order: str, n: str, span: int = 1024) -> DataFrame:
    """totals (order int, n long), a row a part -> with ``base``: the sum of all parts before it.

    Two levels, so that no task sums more than one row per ``span`` parts.
    """
    from pyspark.sql import Window as W

    part = totals.groupBy(order).agg(F.sum(n).cast("long").alias(n)).withColumn("_g", F.floor(F.col(order) / span))
    group = part.groupBy("_g").agg(F.sum(n).alias("_n"))
    group = group.withColumn("_base", F.coalesce(F.sum("_n").over(W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_g", "_base")
    inside = F.coalesce(F.sum(n).over(W.partitionBy("_g").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return part.withColumn("_in", inside).join(group, "_g").select(order, n, (F.col("_base") + F.col("_in")).cast("long").alias("base"))
