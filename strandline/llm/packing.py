"""Mixture-controlled packing of token streams into sequences.

Every source is a queue of its documents' ids (an end id after each document) in doc_id order. Deficit round-robin
fills each sequence of LENGTH ids from all queues in the target proportions: a queue's quantum is its
share of LENGTH, and the fraction of an id that a sequence could not give it is carried to the next as its
deficit, across sequences and partitions. The cumulative allotment of the first w sequences therefore has a
closed form, floor(P_s L w) - floor(P_(s-1) L w) for cumulative shares P, so each task cuts its own
documents alone, and no queue is ever one id away from its target.

Default shares are the sources' own token shares: all queues then end in the same last sequence. Given
weights hold while every weighted queue has ids for a whole sequence's quantum; a queue that has less is set aside, the others'
weights are scaled up, and all that was set aside is packed last by its own shares. Each id
lies in exactly one piece; only the last sequence is short. It is padded to LENGTH unless its size is a power of two.

A queue whose quantum is under one id waits until its deficit covers its next document, as deficit round-robin does with
packets: such queues form one stream, their documents ordered by the share of their queue that ends with their middle,
and the stream is a queue like others. So there may be any number of sources, and at most LENGTH queues have a quantum of
their own: the driver holds figures of those and of the weighted ones alone. A weight that comes to less than one id
a sequence is an error.

Null text: just the end id. Null source: the queue ''. Null and repeated ids are rows like others, and rows of one id may
lie in several tasks. A very long text is one row, cut into as many pieces as it takes. An empty table gives no rows.
Extra columns are not used, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import n_ranges, slices, stored, table
from strandline.llm.encode import CUT_BYTES, before, encoder, tokenizer_path

TOKENIZER, END, LENGTH = "word_bpe_49k.json", 1, 2048


class Share:
    """One queue in a run of sequences: of each it takes the part from lo to hi of den, one id at least.

    ``skip``: its ids given before; ``low`` and ``high``: ids that the queues before it, and they and it, give in this run.
    """

    def __init__(self, first: int, lo: int, hi: int, den: int, length: int, skip: int, low: int, high: int):
        self.first, self.lo, self.hi, self.den, self.length = first, lo, hi, den, length
        self.skip, self.low, self.high, self.take = skip, low, high, high - low

    def edges(self, w: int) -> tuple[int, int]:
        """Ids that queues before it, and they and it, give to the first w sequences."""
        x = self.length * w
        return min(self.lo * x // self.den, self.low), min(self.hi * x // self.den, self.high)

    def allot(self, w: int) -> int:
        lo, hi = self.edges(w)
        return hi - lo

    def sequence(self, x: int) -> int:
        """The sequence of this run that takes the queue's id x."""
        w = max(0, x * self.den // (self.length * (self.hi - self.lo)) - 1)
        while self.allot(w) > x:
            w -= 1
        while self.allot(w + 1) <= x:
            w += 1
        return w


def weighted(totals: dict[str, int], weights: dict[str, float] | None = None, length: int = LENGTH) -> tuple[int, dict[str, list[Share]]]:
    """The number of sequences that weights rule, and each weighted queue's shares in them."""
    first, out = 0, {s: [] for s in totals}
    left = dict(totals)
    active = {s: Fraction(w).limit_denominator(10**6) for s, w in (weights or {}).items() if w > 0 and left.get(s)}
    while active:
        total = sum(active.values())
        share = {s: w / total for s, w in active.items()}
        if min(share.values()) * length < 1:
            raise ValueError("a weight comes to less than one id a sequence")
        # a quantum's rounding never asks for an id that is not there
        n = max(0, int(min(left[s] // (share[s] * length) for s in share)) - 1)
        if n:
            den = math.lcm(*(x.denominator for x in share.values()))
            lo = 0
            for s in sorted(share):
                hi = lo + int(share[s] * den)
                x = Share(first, lo, hi, den, length, totals[s] - left[s], lo * length * n // den, hi * length * n // den)
                out[s].append(x)
                left[s] -= x.take
                lo = hi
            first += n
        active = {s: w for s, w in active.items() if left[s] >= 2 * share[s] * length + 2}
    return first, out


def plan(used: int, large: dict[str, int], first: int, shares: dict[str, list[Share]], length: int) -> dict[str | None, list[Share]]:
    """Each queue's shares: the weighted ones, then its own of what is left. The stream of small queues is None.

    ``used``: ids of all queues; ``large``: what is left in the queues that have a quantum of their own.
    """
    given = sum(x.take for own in shares.values() for x in own)
    den, out, lo = used - given, {s: list(own) for s, own in shares.items()}, 0
    for s, n in [(None, den - sum(large.values())), *sorted(large.items())]:
        if n:
            out.setdefault(s, []).append(Share(first, lo, lo + n, den, length, sum(x.take for x in shares.get(s, ())), lo, lo + n))
        lo += n
    return out


def _encode(path: str, byte_level: bool, end: int):
    def run(batches):
        from pyspark import TaskContext

        enc, pid = encoder(path, byte_level), TaskContext.get().partitionId()
        tail = np.asarray([end], enc.dtype).tobytes()
        queue, start = None, 0
        for batch in batches:
            for lo, hi in slices(np.asarray(pc.binary_length(batch.column("text")), np.int64), CUT_BYTES):
                part = batch.slice(lo, hi - lo)
                ids = [x + tail for x in enc.encode(part.column("text"))]
                sizes, starts = [len(x) // len(tail) for x in ids], []
                for q, n in zip(part.column("queue").to_pylist(), sizes, strict=True):
                    if q != queue:
                        queue, start = q, 0
                    starts.append(start)
                    start += n
                yield pa.RecordBatch.from_arrays([pa.array([pid] * len(ids), pa.int32()), part.column("queue"), part.column("doc_id"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["pid", "queue", "doc_id", "at", "n", "ids"])

    return run


def _cut(shares: dict[str | None, list[Share]], dtype: str, used: int, length: int):
    """Rows of queue, base (the place in it of the row's id ``skip``), n and ids -> pieces."""
    last = max(0, -(-used // length) - 1)
    last_size = used - last * length
    short = last_size if last_size & (last_size - 1) == 0 else length

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out: list[list] = [[] for _ in range(8)]
                for doc, q, base, skip, n, raw in zip(*(batch.slice(lo, 256).column(c).to_pylist() for c in ("doc_id", "queue", "base", "skip", "n", "ids")), strict=True):
                    ids, done = np.frombuffer(raw, dtype).astype("<u4"), skip
                    for p in shares.get(q, ()):
                        x = base + done - skip - p.skip
                        if done == n or not 0 <= x < p.take:
                            continue
                        w = p.sequence(x)
                        start, stop = p.edges(w)
                        while done < n and x < p.take:
                            start2, stop2 = p.edges(w + 1)
                            size = min(stop2 - start2 - x, n - done)
                            if size > 0:
                                row = (doc, done, size, zlib.crc32(ids[done : done + size]), n, p.first + w, start2 - start + x - (stop - start), short if p.first + w == last else length)
                                for c, v in zip(out, row, strict=True):
                                    c.append(v)
                                x, done, w, start, stop = x + size, done + size, w + 1, start2, stop2
                            else:
                                w = p.sequence(x)
                                start, stop = p.edges(w)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"])

    return run


def _numbered(batches):
    """Rows of one partition, each with the ids of the rows before it."""
    from pyspark import TaskContext

    pid, total = TaskContext.get().partitionId(), 0
    for b in batches:
        size = b.column("n").to_numpy() - b.column("skip").to_numpy()
        at = total + np.cumsum(size) - size
        total += int(size.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), pid, np.int32)), pa.array(at), pa.array(size), *b.columns], ["pid", "at", "size", *b.schema.names])


def pack(docs: DataFrame, weights: dict[str, float] | None = None, tokenizer: str | None = None, byte_level: bool = False, end: int = END, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length."""
    path, n_parts = tokenizer or tokenizer_path(TOKENIZER), n_ranges(docs, text_col)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("queue"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("tie", F.xxhash64("text"))  # rows that repeat an id may part here
    d = d.repartitionByRange(n_parts, "queue", "doc_id", "tie").sortWithinPartitions("queue", "doc_id", "tie")
    ids = stored(d.select("queue", "doc_id", "text").mapInArrow(_encode(path, byte_level, end), "pid int, queue string, doc_id long, at long, n long, ids binary"))
    parts = stored(ids.groupBy("pid", "queue").agg(F.sum("n").alias("n")))
    # partitions ascend by queue, so ids before a part are sums over partitions, and over the queues of its own
    inside = F.coalesce(F.sum("n").over(W.partitionBy("pid").orderBy("queue").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = stored(parts.withColumn("inside", inside).join(before(parts, "pid", "n").select("pid", "base"), "pid").select("pid", "queue", "n", (F.col("base") + F.col("inside")).alias("place")))
    queues = places.groupBy("queue").agg(F.min("place").alias("first"), F.sum("n").alias("total"))
    used = places.agg(F.sum("n")).first()[0] or 0
    named = {r["queue"]: r["total"] for r in queues.filter(F.col("queue").isin(sorted(weights))).collect()} if weights else {}
    first, shares = weighted(named, weights, length)
    given = {s: sum(x.take for x in own) for s, own in shares.items()}
    rest = used - sum(given.values())
    # a queue of a quantum of its own has a share of 1 / length: there are no more than length of them
    large = {r["queue"]: r["total"] for r in queues.filter(F.col("total") * length >= rest).collect()}
    large = {s: n - given.get(s, 0) for s, n in large.items()}
    large = {s: n for s, n in large.items() if n and n * length >= rest}
    shares, dtype = plan(used, large, first, shares, length), encoder(path, byte_level).dtype
    # a row a partition and queue: written, so that its size is known when the join is planned
    bases = stored(places.join(queues, "queue").select("pid", "queue", "total", (F.col("place") - F.col("first")).alias("_base")))
    rows = ids.join(bases, ["queue", "pid"]).select("doc_id", "queue", (F.col("_base") + F.col("at")).alias("base"), F.lit(0).cast("long").alias("skip"), "n", "ids", "total")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
    out = rows.drop("total").mapInArrow(_cut(shares, dtype, used, length), schema)
    if None not in shares:
        return out
    told = F.lit(0).cast("long")
    for s, x in given.items():
        told = F.when(F.col("queue") == s, F.lit(x)).otherwise(told)
    small = rows.filter(~F.col("queue").isin(sorted(large))).withColumn("skip", F.greatest(F.lit(0), F.least("n", told - F.col("base")))).filter("skip < n")
    small = small.withColumn("t", (2 * (F.col("base") - told) + F.col("skip") + F.col("n")) / (2 * (F.col("total") - told)))
    small = small.repartitionByRange(n_parts, "t", "queue", "base").sortWithinPartitions("t", "queue", "base").select("doc_id", "skip", "n", "ids")
    small = stored(small.mapInArrow(_numbered, "pid int, at long, size long, doc_id long, skip long, n long, ids binary"))
    small = small.join(stored(before(small.select("pid", "size"), "pid", "size").select("pid", "base")), "pid")
    small = small.select("doc_id", F.lit(None).cast("string").alias("queue"), (F.col("base") + F.col("at")).alias("base"), "skip", "n", "ids")
    return out.unionAll(small.mapInArrow(_cut(shares, dtype, used, length), schema))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
