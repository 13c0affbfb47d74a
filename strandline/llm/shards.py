"""Token-id shards with a minimal perfect hash index from document keys to shard offsets.

File format, in a folder on any store that Spark writes to:

* ``shards``: Parquet, a row a shard of about SHARD_IDS ids: pid (the writing task), shard (ascending with the key order),
  n_ids, payload (raw little-endian ids, uint16 if the vocabulary fits, else uint32), ends (uint32 end of each record, in
  ids), ids and occs (the records' keys, from which the index is built and can be built again).
* ``bases``: shard -> base, the ids in all shards before it.
* ``index``: Parquet, a row a part of about PART_KEYS keys: pilots (int32, a bucket each), then by slot the
  fingerprint (uint32) of the key, its shard, offset and length in ids. part = hash of the key; a lookup is
  one part, one pilot, one slot, one fingerprint: constant time. No key is stored.

A key is (doc_id, occurrence): rows that repeat an id are records 0, 1, ... of it in the order of their
texts' hashes, then bytes; they may lie in several tasks and shards. A null id is a key too and comes first. Null text is
empty: just the end id. A very long text is one record, in a shard of its own size. An empty table gives no shards and no
rows. Extra columns are not used, whatever their names. A key that is not in the index passes the fingerprint test with
probability 2**-32.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import mix64, n_ranges, slices, table, work_dir
from strandline.llm.encode import CUT_BYTES, before, encoder, id_dtype, tokenizer_path

TOKENIZER, END = "byte_bpe_50k.json", 2
SHARD_IDS, PART_KEYS, LOAD = 1 << 19, 20_000, 4


def key_hash(ids: np.ndarray, null: np.ndarray, occ: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        x[null] = np.uint64(0x1234567)
        return mix64(x + occ.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _slot(h: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(h ^ (pilot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(n)).astype(np.int64)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(max(1, n // LOAD))).astype(np.int64)


def build_mph(h: np.ndarray) -> np.ndarray:
    """Pilots (int32) that send the distinct hashes h to 0..n-1, one each.

    Hash and displace: buckets by falling size try pilots 0, 1, ... until all their keys fall on free slots;
    buckets of one key name their slot outright, as -slot-1.
    """
    n = len(h)
    bucket = _bucket(h, n)
    order = np.argsort(bucket, kind="stable")
    count = np.bincount(bucket, minlength=max(1, n // LOAD))
    start = np.concatenate([[0], np.cumsum(count)])
    pilots, taken = np.zeros(len(count), np.int32), np.zeros(n, bool)
    for b in np.argsort(-count, kind="stable"):
        if count[b] < 2:
            break
        own, at, tries = h[order[start[b] : start[b + 1]]], 0, 16
        while True:
            p = np.arange(at, at + tries)
            s = np.sort(_slot(own[None, :], p[:, None], n), axis=1)
            good = ~taken[s].any(1) & (s[:, 1:] != s[:, :-1]).all(1)
            if good.any():
                k = int(good.argmax())
                pilots[b], taken[s[k]] = at + k, True
                break
            at, tries = at + tries, min(4096, tries * 2)
    free = np.flatnonzero(~taken)
    pilots[np.flatnonzero(count == 1)] = -free - 1
    return pilots


def slots(h: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    p = pilots[_bucket(h, n)]
    return np.where(p < 0, -p - 1, _slot(h, np.maximum(p, 0), n))


def _part(n_parts: int):
    return F.pmod(F.xxhash64("doc_id", "occ"), F.lit(n_parts)).cast("int")


def _encoder(path: str, byte_level: bool, end: int):
    def run(batches):
        from pyspark import TaskContext

        enc, pid = encoder(path, byte_level), TaskContext.get().partitionId()
        tail = np.asarray([end], enc.dtype).tobytes()
        held, ends, keys, seq, last, occ = [], [], [], 0, (), 0

        def shard():
            payload = b"".join(held)
            e = np.asarray(ends, np.uint32)
            ids, null, occs = zip(*keys, strict=True)
            return pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "shard": pa.array([pid << 24 | seq], pa.int64()), "n_ids": pa.array([int(e[-1])], pa.int64()), "payload": pa.array([payload], pa.binary()), "ends": pa.array([e.tobytes()], pa.binary()), "ids": pa.array([[None if z else i for i, z in zip(ids, null, strict=True)]], pa.list_(pa.int64())), "occs": pa.array([occs], pa.list_(pa.int32()))})

        size = 0
        for batch in batches:
            for lo, hi in slices(np.asarray(pc.binary_length(batch.column(1)), np.int64), CUT_BYTES):
                part = batch.slice(lo, hi - lo)
                for doc, x in zip(part.column(0).to_pylist(), enc.encode(part.column(1)), strict=True):
                    occ = occ + 1 if last == (doc,) else 0
                    last = (doc,)
                    held.append(x + tail)
                    size += len(held[-1]) // len(tail)
                    ends.append(size)
                    keys.append((doc or 0, doc is None, occ))
                    if size >= SHARD_IDS:
                        yield shard()
                        held, ends, keys, seq, size = [], [], [], seq + 1, 0
        if held:
            yield shard()

    return run


def _index_part(t: pa.Table) -> pa.Table:
    ids = t.column("doc_id").combine_chunks()
    null = np.asarray(ids.is_null())
    h = key_hash(ids.fill_null(0).to_numpy(), null, t.column("occ").to_numpy())
    n, pilots = len(h), build_mph(h)
    s = slots(h, pilots, n)
    place = lambda x, kind: pa.array([(lambda o: (o.__setitem__(s, x), o.tobytes())[1])(np.empty(n, kind))], pa.binary())
    return pa.Table.from_pydict({"part": t.column("part").slice(0, 1), "n": pa.array([n], pa.int64()), "pilots": pa.array([pilots.tobytes()], pa.binary()), "fps": place((h & np.uint64(0xFFFFFFFF)), "<u4"), "shards": place(t.column("shard").to_numpy(), "<i8"), "offsets": place(t.column("offset").to_numpy(), "<u4"), "lengths": place(t.column("length").to_numpy(), "<u4")})


def write(docs: DataFrame, path: str, tokenizer: str | None = None, byte_level: bool = True, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Write docs as shards, bases and index under path; returns the number of index parts."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("tie", F.xxhash64("text"))  # rows that repeat an id may part here
    d = d.repartitionByRange(n_ranges(docs, text_col), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    schema = "pid int, shard long, n_ids long, payload binary, ends binary, ids array<long>, occs array<int>"
    d.mapInArrow(_encoder(tokenizer or tokenizer_path(TOKENIZER), byte_level, end), schema).write.parquet(f"{path}/shards")
    shards = spark.read.parquet(f"{path}/shards")
    inside = shards.select("pid", "shard", "n_ids")
    part = before(inside, "pid", "n_ids").select("pid", F.col("base").alias("_base"))
    own = F.coalesce(F.sum("n_ids").over(W.partitionBy("pid").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside.withColumn("_own", own).join(part, "pid").select("shard", (F.col("_base") + F.col("_own")).cast("long").alias("base")).write.parquet(f"{path}/bases")
    records = shards.select("pid", "shard", "ends", "ids", "occs").mapInArrow(_records, "pid int, doc_id long, occ int, shard long, offset long, length long")
    # an id whose rows part goes on counting in the next task; only a task's last id can go on, as a first one
    edges = shards.groupBy("pid").agg(F.min_by(F.col("ids")[0], "shard").alias("a"), F.max_by(F.element_at("ids", -1), "shard").alias("b"), F.max_by(F.element_at("occs", -1), "shard").alias("c"))
    edges = edges.select("pid", F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(0).alias("last"), F.lit(0).alias("rows")), F.struct(F.col("b").alias("id"), F.lit(1).alias("last"), (F.col("c") + 1).alias("rows")))).alias("x")).select("pid", "x.*")
    earlier = F.sum("rows").over(W.partitionBy("id").orderBy("pid", "last").rowsBetween(W.unboundedPreceding, -1))
    edges = edges.withColumn("earlier", earlier.cast("int")).filter("last = 0 and earlier > 0").select(F.col("pid").alias("_pid"), F.col("id").alias("_id"), "earlier")
    edges.write.parquet(f"{path}/parted")
    edges = spark.read.schema(edges.schema).parquet(f"{path}/parted")
    records = records.join(edges, (F.col("pid") == F.col("_pid")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", (F.col("occ") + F.coalesce("earlier", F.lit(0))).alias("occ"), "shard", "offset", "length")
    n = shards.select(F.sum(F.size("ids"))).first()[0] or 0
    n_parts = max(1, -(-n // PART_KEYS))
    keyed = records.withColumn("part", _part(n_parts))
    keyed.groupBy("part").applyInArrow(_index_part, "part int, n long, pilots binary, fps binary, shards binary, offsets binary, lengths binary").write.parquet(f"{path}/index")
    return n_parts


def _records(batches):
    for b in batches:
        for pid, shard, ends, ids, occs in zip(*(b.column(c) for c in ("pid", "shard", "ends", "ids", "occs")), strict=True):
            e = np.frombuffer(ends.as_py(), np.uint32).astype(np.int64)
            at = np.concatenate([[0], e[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), pid.as_py(), np.int32)), ids.values, occs.values, pa.array(np.full(len(e), shard.as_py())), pa.array(at), pa.array(e - at)], ["pid", "doc_id", "occ", "shard", "offset", "length"])


def _find(strict: bool):
    def run(keys: pa.Table, index: pa.Table) -> pa.Table:
        if not index.num_rows or not keys.num_rows:
            if strict and keys.num_rows:
                raise KeyError(f"{keys.num_rows} keys have no part of the index")
            return pa.table({"doc_id": pa.array([], pa.int64()), "occ": pa.array([], pa.int32()), "shard": pa.array([], pa.int64()), "offset": pa.array([], pa.int64()), "length": pa.array([], pa.int64())})
        x = index.slice(0, 1).to_pylist()[0]
        ids = keys.column("doc_id").combine_chunks()
        h = key_hash(ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()), keys.column("occ").to_numpy())
        s = slots(h, np.frombuffer(x["pilots"], np.int32), x["n"])
        hit = np.frombuffer(x["fps"], "<u4")[s] == (h & np.uint64(0xFFFFFFFF))
        if strict and not hit.all():
            raise KeyError(f"{len(hit) - int(hit.sum())} keys are not in the index")
        out = pa.table({"doc_id": ids, "occ": keys.column("occ"), "shard": np.frombuffer(x["shards"], "<i8")[s], "offset": np.frombuffer(x["offsets"], "<u4")[s].astype(np.int64), "length": np.frombuffer(x["lengths"], "<u4")[s].astype(np.int64)})
        return out.filter(pa.array(hit))

    return run


def locate(keys: DataFrame, path: str, n_parts: int, strict: bool = False) -> DataFrame:
    """keys (doc_id, occ) -> shard, offset and length of those that are in the index; ``strict``: all must be."""
    index = keys.sparkSession.read.parquet(f"{path}/index")
    k = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("occ").cast("int").alias("occ")).withColumn("part", _part(n_parts))
    return k.groupBy("part").cogroup(index.groupBy("part")).applyInArrow(_find(strict), "doc_id long, occ int, shard long, offset long, length long")


def lookup(keys: DataFrame, path: str, n_parts: int, vocabulary: int = 50_257) -> DataFrame:
    """keys (doc_id, occ) -> doc_id, occ, ids array<int>, read from the payloads by the index."""
    at, width = locate(keys, path, n_parts), np.dtype(id_dtype(vocabulary)).itemsize
    shards = keys.sparkSession.read.parquet(f"{path}/shards").select("shard", "payload")
    cut = at.join(shards, "shard").select("doc_id", "occ", F.substring("payload", F.col("offset").cast("int") * width + 1, F.col("length").cast("int") * width).alias("raw"))

    def ids(batches):
        for b in batches:
            raw = [np.frombuffer(x, id_dtype(vocabulary)).astype(np.int32) for x in b.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("occ"), pa.array(raw, pa.list_(pa.int32()))], ["doc_id", "occ", "ids"])

    return cut.mapInArrow(ids, "doc_id long, occ int, ids array<int>")


def _read(dtype: str):
    def run(batches):
        for b in batches:
            for shard, payload, ends in zip(*(b.column(c) for c in ("shard", "payload", "ends")), strict=True):
                ids = np.frombuffer(payload.as_buffer(), dtype).astype("<u4")
                e = np.frombuffer(ends.as_py(), np.uint32).astype(np.int64)
                at = np.concatenate([[0], e[:-1]])
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(at.tolist(), e.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), shard.as_py())), pa.array(at), pa.array(e - at), pa.array(crc, pa.int64())], ["shard", "offset", "n_tokens", "ids_crc32"])

    return run


def read_back(docs: DataFrame, path: str, n_parts: int, vocabulary: int = 50_257) -> DataFrame:
    """Every document's record, found through the index and read from the payloads: start, n_tokens, ids_crc32.

    All keys at once: the payloads, the larger side, are read in place, each by its own record ends, and only a row a record
    moves to meet its key at the shard and offset that the index gives. A key that the index loses, and a record that does
    not stand where the index says, are errors.
    """
    spark = docs.sparkSession
    keys = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("_n"))
    keys = keys.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)).alias("occ"))
    at = locate(keys, path, n_parts, strict=True)
    rows = spark.read.parquet(f"{path}/shards").select("shard", "payload", "ends").mapInArrow(_read(id_dtype(vocabulary)), "shard long, offset long, n_tokens long, ids_crc32 long")
    got = at.join(rows, ["shard", "offset"], "left")
    lost = F.raise_error(F.concat(F.lit("no record as the index says: shard "), F.col("shard"), F.lit(", offset "), F.col("offset")))
    got = got.withColumn("n_tokens", F.when(F.col("length") == F.col("n_tokens"), F.col("n_tokens")).otherwise(lost.cast("long")))
    return got.join(spark.read.parquet(f"{path}/bases"), "shard").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = work_dir(spark)
    return read_back(docs, path, write(docs, path))
