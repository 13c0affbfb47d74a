"""What the operators share: tables, work folders, blocks of documents and words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and tab to carriage return. bytes.split() splits at these six.
SPACE = r"\x20\x09-\x0D"
#: Input file bytes that a block of documents stands for.
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for x in names:
        while x.lower() in taken:
            x += "_"
        taken.add(x.lower())
        out.append(x)
    return out


def work_dir(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder; a temporary one only where none is set and all runs on one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            top = got.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            top = tempfile.mkdtemp(prefix="strandline-")
            spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/work-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = path or work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_blocks(df: DataFrame, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> int:
    """Blocks for df, from Catalyst's size of its files; a frame that has no such size is measured by its text."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if size >> 55 or "Join" in plan.toString():
        size = (df.select(F.sum(F.octet_length(text_col))).first()[0] or 0) // 2
    return max(1, -(-size // block_bytes))


def n_ranges(df: DataFrame, text_col: str = "text") -> int:
    """Partitions for work that streams its rows: small ones for up to a thousand tasks, then 32 times as large."""
    n = n_blocks(df, text_col=text_col)
    return min(n, max(1000, n // 32))


def block_of(n: int, *key: Column | str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


#: Blocks grow with the input beyond a thousand, up to so many times BLOCK_BYTES.
GROW = 8


def grown_blocks(docs: DataFrame, text_col: str = "text") -> int:
    """Blocks for work that sends each key once a block: small ones for up to a thousand tasks, then GROW times as large."""
    n = n_blocks(docs, text_col=text_col)
    return min(n, max(1000, -(-n // GROW)))


def tallied(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, data, times): documents with their text as UTF-8 bytes; rows equal in both that would overfill one of n blocks
    are summed up, in the tasks that read them first, before they are dealt.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    k = d.select("doc_id", F.xxhash64("data").alias("key")).groupBy("doc_id", "key").agg(F.count("*").alias("rows"))
    k = stored(k.groupBy("rows").agg(F.count("*").alias("groups")))
    total = k.select(F.sum(F.col("rows") * F.col("groups"))).first()[0] or 0
    most = -(-total // n)
    once = d.withColumn("times", F.lit(1).cast("long"))
    if k.filter(F.col("rows") > F.lit(max(1, most // 4))).isEmpty():
        return once
    hot = stored(d.select(F.col("doc_id").alias("hot_id"), F.xxhash64("data").alias("hot_key")).groupBy("hot_id", "hot_key").agg(F.count("*").alias("rows")).filter(F.col("rows") > max(1, most // 4)).drop("rows"))
    match = d["doc_id"].eqNullSafe(hot["hot_id"]) & (F.xxhash64(d["data"]) == hot["hot_key"])
    cold = once.join(hot, match, "left_anti")
    return cold.unionByName(d.join(hot, match, "left_semi").groupBy("doc_id", "data").agg(F.count("*").alias("times")))


#: Texts of one id that can be numbered after their shared key.
RANKS = 1 << 20


def hot_ids(docs: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """Ids (null too) with more rows than a block should have, in a written table of at most n rows."""
    ids = docs.select(F.col(id_col).cast("long").alias("hot_id"))
    most = min(-(-ids.count() // n), RANKS)
    return stored(ids.groupBy("hot_id").agg(F.count("*").alias("rows")).filter(F.col("rows") > most).select("hot_id", F.lit(True).alias("hot")))


def blocked(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, doc_id, key, hot, data): documents dealt by a hash of their id; text as UTF-8 bytes.

    The rows of an id that would overfill a block are dealt by a hash of their text as well: ``hot``. Rows of one id and
    one ``key``, a multiple of RANKS, are always in one block.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("data"))
    d = d.withColumn("key", F.shiftrightunsigned(F.xxhash64("data"), 22) * RANKS)
    hot = hot_ids(docs, n, id_col)
    d = d.join(hot, F.col("doc_id").eqNullSafe(F.col("hot_id")), "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    return d.select(block_of(n, F.col("doc_id"), F.when(F.col("hot"), F.col("key")).otherwise(0)).alias("block"), "doc_id", "key", "hot", "data").repartition(n, "block")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordIds(dict):
    """Word -> 64-bit hash, each word hashed once; emptied when it has grown large (values never change)."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def slices(sizes: np.ndarray, most: int):
    """(from, to) runs of rows whose sizes add up to about most."""
    start, total = 0, 0
    for i, x in enumerate(sizes):
        total += int(x)
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
